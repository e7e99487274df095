"""Quality of a build and of retrieval, as one-row aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import NULL_LIKE, citations, has_numeric


CHECKS = ("edges_per_page>=6", "none_node_rate==0", "citation_validity>=0.95", "retrieval_recall@8_proxy>=0.85", "anchor_coverage_rate>=0.9", "citation_context_validity_rate>=0.95")


def build_evals(facts: DataFrame, edges: DataFrame, chunks: DataFrame, tags: DataFrame, pages: int, timings: dict[str, float] | None = None, compositional: dict[str, float] | None = None) -> DataFrame:
    """One row of counts, rates, named checks (a map) and whether all hold.

    tags (kind, key, pos): a map of tags covers a key if it lists a chunk for it. The recall proxy is 0.55 times the share of covered metric
    keys, 0.30 times that of entity keys, and 0.15 * min(1, edges per page / 8); an empty map covers nothing. compositional: the rates of one
    retrieval, which add two checks.
    """
    t, comp = timings or {}, compositional or {}
    f = facts.agg(
        F.count(F.lit(1)).alias("facts"), F.avg((F.trim(F.coalesce("source_ref", F.lit(""))) != "").cast("double")).alias("cited"),
        F.avg((has_numeric(F.col("value")) | has_numeric(F.col("object"))).cast("double")).alias("numeric"),
    )
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").count()
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.avg(F.lower(F.trim("id")).isin(*NULL_LIKE).cast("double")).alias("none"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"))
    c = chunks.agg(F.count(F.lit(1)).alias("retrieval_chunks"))
    keys = tags.groupBy("kind", "key").agg(F.count("pos").alias("listed"))
    covered = lambda kind: F.coalesce(F.avg(F.when(F.col("kind") == kind, (F.col("listed") > 0).cast("double"))), F.lit(0.0)).alias(kind)
    m = keys.agg(covered("metric"), covered("entity"))
    pages = max(1, pages)
    row = f.crossJoin(n).crossJoin(e).crossJoin(c).crossJoin(m).withColumn("epp", F.col("edges") / pages)  # a row each
    proxy = F.least(F.lit(1.0), 0.55 * F.col("metric") + 0.30 * F.col("entity") + 0.15 * F.least(F.lit(1.0), F.col("epp") / 8))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    sec, total = float(t.get("extract_sec", 0.0)), float(t.get("build_total_sec", 0.0))
    rate = lambda k: float(comp.get(k, 0.0))
    holds = [F.col("epp") >= 6, zero(F.col("none")) == 0, zero(F.col("cited")) >= 0.95, proxy >= 0.85]
    if comp:
        holds += [F.lit(rate("anchor_coverage_rate") >= 0.9), F.lit(rate("citation_context_validity_rate") >= 0.95)]
    checks = F.map_from_arrays(F.array(*map(F.lit, CHECKS[: len(holds)])), F.array(*holds))
    return row.select(
        "nodes", "edges", "facts", "retrieval_chunks", F.lit(pages).cast("long").alias("pages"), F.round("epp", 4).alias("edges_per_page"), F.round(zero(F.col("none")), 4).alias("none_node_rate"),
        F.round(zero(F.col("cited")), 4).alias("citation_validity_rate"), F.round(zero(F.col("numeric")), 4).alias("numeric_support_rate"), F.round(proxy, 4).alias("recall_proxy"),
        *(F.lit(round(rate(k), 4)).alias(k) for k in ("anchor_coverage_rate", "derivation_success_rate", "citation_context_validity_rate")),
        F.lit(round(total, 3)).alias("build_total_sec"), F.lit(round(sec, 3)).alias("extract_sec"), F.round(F.when(F.lit(sec > 0), F.col("facts") / F.lit(sec or 1.0)).otherwise(0.0), 4).alias("facts_per_sec"),
        checks.alias("checks"), F.forall(F.map_values(checks), lambda x: x).alias("passed"),
    )


def compositional_evals(evidence: DataFrame) -> DataFrame:
    """(qid, rates) of evidence rows: anchor coverage, derivation success, and the share of allowed citations that the context holds."""
    low = lambda c: F.transform(c, lambda x: F.lower(x))
    allowed = citations(F.array_join("allowed_citations", " "))
    n = F.size(allowed)
    valid = F.when(n > 0, F.size(F.filter(allowed, lambda c: F.array_contains(low("context_citation_ids"), F.lower(c)))) / n).otherwise(1.0)
    return evidence.select(
        "qid", F.round("anchor_coverage", 4).alias("anchor_coverage_rate"),
        F.when((F.col("anchor_coverage") >= 1) & (F.col("temporal_signal") >= 0.5), 1.0).otherwise(0.0).alias("derivation_success_rate"), F.round(valid, 4).alias("citation_context_validity_rate"),
    )


def throughput(done: int, total: int, seconds: float) -> tuple[float, float]:
    """(tasks a second, seconds left)."""
    rate = done / seconds if seconds > 0 else 0.0
    return rate, (total - done) / rate if rate else 0.0
