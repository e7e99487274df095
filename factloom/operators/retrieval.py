"""Candidates, their fusion, and the choice of evidence, for any number of questions in one job."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import anchor_score, blank, citations, lexical_tokens, normalize_ws, ordered_distinct, query_tokens, temporal_score
from factloom.operators.graph import neighbours
from factloom.operators.index import Index, dense_scores, hashed_vectors, top
from factloom.plans.questions import anchors, query_plans, with_intent
from factloom.session import cut, spread


def lexical_scores(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, pos, score): shared words, 2.0 for the whole question if longer than 10, 1.0 for a shared year, 0.7 for a shared quarter."""
    q = asked.select("qid", F.lower(normalize_ws(F.col("question"))).alias("q"))
    q = F.broadcast(q.select("qid", "q", F.array_distinct(lexical_tokens(F.col("q"))).alias("qt"), F.regexp_extract_all("q", F.lit(r"(?:19|20)\d{2}"), 0).alias("qy"), F.regexp_extract_all("q", F.lit("q[1-4]"), 0).alias("qq")))
    c = chunks.select("pos", F.lower(blank(F.col("text"))).alias("t")).withColumn("ct", F.array_distinct(F.regexp_extract_all("t", F.lit("[a-z0-9]{2,}"), 0)))
    has = lambda xs: F.exists(xs, lambda x: F.col("t").contains(x))
    rows = c.join(q, F.arrays_overlap("ct", "qt") | has("qy") | has("qq") | ((F.length("q") > 10) & F.col("t").contains(F.col("q"))))
    score = F.size(F.array_intersect("ct", "qt")) + F.when((F.length("q") > 10) & F.col("t").contains(F.col("q")), 2.0).otherwise(0.0) + F.when(has("qy"), 1.0).otherwise(0.0) + F.when(has("qq"), 0.7).otherwise(0.0)
    return rows.select("qid", "pos", score.alias("score"))


def rank_fusion(dense: DataFrame, lexical: DataFrame, k: int = 8) -> DataFrame:
    """(qid, pos, score, rank): 2.3 and 1.6 times the reversed ranks of both lists, and 0.08 times the lexical score to 1."""
    n = max(10, 2 * k)
    d = top(dense, n).select("qid", "pos", (F.lit(2.3) * (n - F.col("rank") + 1) / n).alias("d"))
    s = top(lexical, n).select("qid", "pos", (F.lit(1.6) * (n - F.col("rank") + 1) / n + F.least(F.lit(1.0), F.col("score") * 0.08)).alias("s"))
    both = d.join(s, ["qid", "pos"], "full").select("qid", "pos", (F.coalesce("d", F.lit(0.0)) + F.coalesce("s", F.lit(0.0))).alias("score"))
    return top(both, k)


def anchor_candidates(asked: DataFrame, chunks: DataFrame, n: int = 6) -> DataFrame:
    """(qid, anchor, pos, score, rank): the best chunks of each anchor with a score over 0.30.

    The anchors of the stated questions are broadcast with their tokens; texts are brought to lower case once, not for each anchor.
    """
    a = asked.select("qid", F.explode(anchors(F.col("question"))).alias("anchor")).withColumn("a", F.lower(normalize_ws(F.col("anchor")))).withColumn("toks", query_tokens(F.col("a")))
    low = spread(chunks.select("pos", F.lower(blank(F.col("text"))).alias("t")))
    rows = low.join(F.broadcast(a), F.exists("toks", lambda k: F.col("t").contains(k)) | F.col("t").contains(F.col("a")))
    share = F.when(F.size("toks") > 0, F.size(F.filter("toks", lambda k: F.col("t").contains(k))) / F.size("toks")).otherwise(0.0)
    score = F.when(F.col("a") == "", 0.0).otherwise(F.when(F.col("t").contains(F.col("a")), 1.5).otherwise(0.0) + F.least(F.lit(1.0), share))
    rows = rows.select("qid", "anchor", "pos", F.round(score, 6).alias("score")).where("score > 0.30")
    w = Window.partitionBy("qid", "anchor").orderBy(F.desc("score"), "pos")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _ends(scores: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, lo, hi) of scores (qid, pos, score) over all chunks: one without a score has 0."""
    ends = scores.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    every = chunks.agg(F.count(F.lit(1)).alias("every"))
    short = F.col("n") < F.col("every")
    return ends.crossJoin(F.broadcast(every)).select("qid", F.when(short, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")).alias("lo"), F.when(short, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")).alias("hi"))


def _scaled(scores: DataFrame, ends: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """Scores scaled to 0..1 over all chunks of a question."""
    rows = pairs.join(scores, ["qid", "pos"], "left").join(F.broadcast(ends), "qid", "left")
    return rows.select("qid", "pos", ((F.coalesce("score", F.lit(0.0)) - F.coalesce("lo", F.lit(0.0))) / (F.coalesce(F.col("hi") - F.col("lo"), F.lit(0.0)) + 1e-8)).alias(name))


def blend(plans: DataFrame, index: Index, dense: DataFrame, sparse: DataFrame, near: DataFrame, k: int = 8) -> DataFrame:
    """(qid, pos, score, covers) of all candidates: .56 dense + .34 sparse (each scaled over all chunks) + a bonus of .35 at most.

    plans: query_plans() of the questions; dense, sparse: scores of the canonical text of each question; near: anchor_candidates().
    Candidates are the best of both scores, chunks tagged with a metric or entity of the plan, and the best of the
    anchors. Bonus: .06 for each entity and .05 for each metric in the text, .08 for tagged chunks and the best of anchors, .10 for each
    anchor's best chunks or .05 for a score of .75, and .18 times the temporal score. covers: the anchors with a score of .65.
    """
    n = max(16, 2 * k)
    plans = plans.select("qid", "entities", "metrics", "comparison_anchors")
    keys = lambda c, kind: plans.select("qid", F.lit(kind).alias("kind"), F.explode(F.transform(c, lambda x: F.lower(x))).alias("key"))
    terms = F.broadcast(keys("metrics", "metric").union(keys("entities", "entity")))
    prior = index.tags.join(terms, ["kind", "key"]).select("qid", "pos").union(near.select("qid", "pos")).distinct()
    prior = cut(prior)
    found = top(dense, n).select("qid", "pos").union(top(sparse, n).select("qid", "pos")).union(prior).distinct()
    found = cut(found)
    rows = _scaled(dense, _ends(dense, index.chunks), found, "d").join(_scaled(sparse, _ends(sparse, index.chunks), found, "s"), ["qid", "pos"])
    best = near.groupBy("qid", "pos").agg(F.collect_set("anchor").alias("near"))
    rows = rows.join(index.chunks.select("pos", "text"), "pos").join(F.broadcast(plans), "qid").join(best, ["qid", "pos"], "left").join(prior.withColumn("tagged", F.lit(True)), ["qid", "pos"], "left")
    low = F.lower(blank(F.col("text")))
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + f(x))
    of_anchor = lambda a: F.round(anchor_score(a, F.col("text")), 6)
    bonus = (
        total("entities", lambda e: F.when((e != "") & low.contains(F.lower(e)), 0.06).otherwise(0.0)) + total("metrics", lambda m: F.when(low.contains(m), 0.05).otherwise(0.0)) + F.when(F.col("tagged"), 0.08).otherwise(0.0)
        + total("comparison_anchors", lambda a: F.when(F.array_contains(F.coalesce("near", F.array().cast("array<string>")), a), 0.10).when(of_anchor(a) >= 0.75, 0.05).otherwise(0.0))
        + F.least(F.lit(0.18), temporal_score(F.col("text")) * 0.18)
    )
    score = F.lit(0.56) * F.col("d") + F.lit(0.34) * F.col("s") + F.least(F.lit(0.35), bonus)
    return rows.select("qid", "pos", score.alias("score"), F.filter("comparison_anchors", lambda a: of_anchor(a) >= 0.65).alias("covers"))


def mmr(scores: np.ndarray, vectors: np.ndarray, k: int, weight: float = 0.72) -> list[int]:
    """Places of k candidates, each with the best weight * score - (1 - weight) * greatest cosine to those taken; ties: the first."""
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.maximum(norms, 1e-12)
    taken: list[int] = []
    near = np.zeros(len(scores))
    left = np.ones(len(scores), bool)
    while len(taken) < min(k, len(scores)):
        value = np.where(left, weight * scores - (1 - weight) * near, -np.inf)
        best = int(value.argmax())
        taken.append(best)
        left[best] = False
        cos = unit @ unit[best]
        near = cos if len(taken) == 1 else np.maximum(near, cos)
    return taken


def select_diverse(scored: DataFrame, vectors: DataFrame, anchored: DataFrame, k: int = 8, weight: float = 0.72) -> DataFrame:
    """(qid, pos, score, rank): k chunks by MMR; then each anchor that none of them covers gets its best chunk, for the worst that isn't kept.

    scored (qid, pos, score, covers: the anchors that a chunk covers, if there is such a column) holds a few dozen candidates for each
    question, so a question is one small group. anchored: (qid, anchor, pos, rank).
    """
    if "covers" not in scored.columns:
        scored = scored.withColumn("covers", F.array().cast("array<string>"))
    a = anchored.where("rank = 1").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("anchor", "pos"))).alias("best"))
    rows = scored.join(vectors.select("pos", "embedding"), "pos").join(F.broadcast(a), "qid", "left")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "pos"], ascending=[False, True]).reset_index(drop=True)
        taken = mmr(pdf["score"].to_numpy(), np.stack(pdf["embedding"].to_numpy()).astype(float), k, weight)
        of_pos = {p: i for i, p in enumerate(pdf["pos"])}
        must: list[int] = []
        best = pdf["best"].iloc[0]
        for x in best if best is not None and not isinstance(best, float) else []:
            if not any(x["anchor"] in pdf["covers"][i] for i in taken) and x["pos"] in of_pos and of_pos[x["pos"]] not in taken:
                taken.append(of_pos[x["pos"]])
                must.append(of_pos[x["pos"]])
        while len(taken) > k:
            free = [i for i in taken if i not in must] or taken
            taken.remove(min(free, key=lambda i: pdf["score"][i]))
        out = pdf.loc[taken, ["qid", "pos", "score"]].copy()
        out["rank"] = range(1, len(out) + 1)
        return out

    return rows.groupBy("qid").applyInPandas(choose, "qid int, pos long, score double, rank int")


def canonical_questions(asked: DataFrame) -> DataFrame:
    """(qid, question) with the canonical text of each question, by which chunks are scored."""
    return with_intent(asked.select("qid", "question")).select("qid", F.col("canonical_retrieval_query").alias("question"))


def ranked_candidates(asked: DataFrame, index: Index, plans: DataFrame, k: int = 8) -> tuple[DataFrame, DataFrame]:
    """(blended candidates, anchor candidates) of the questions (qid, question)."""
    canonical = canonical_questions(asked)
    dense = cut(query_scores(canonical, index.vectors))
    sparse = cut(index.bm25(canonical))
    near = cut(anchor_candidates(asked, index.chunks))
    return blend(plans, index, dense, sparse, near, k), near


def plan_seeds(plans: DataFrame) -> DataFrame:
    """(qid, id, rank): the entities of a plan, the anchors among them, as seeds of the graph."""
    return plans.select("qid", F.posexplode("entities").alias("i", "id")).select("qid", "id", (F.col("i") + 1).alias("rank"))


def evidence(asked: DataFrame, index: Index, edges: DataFrame, nodes: DataFrame, k: int = 8, most_edges: int = 110) -> DataFrame:
    """One row for each question (qid, question): chunks and lines, graph lines, citations, signals and confidence.

    The plan is that of the question; chunks are scored by its canonical text. Temporal signal: the share of anchors one of whose covering
    chunks has one, or the mean of the chosen chunks where there are no anchors. Confidence: .45 mean relevance + .20 diversity
    of citations + .20 anchors + .15 temporal, capped by .35 if a derivation lacks an anchor, and by .45 if it lacks temporal text.
    """
    plans = cut(query_plans(asked, nodes))
    scored, near = ranked_candidates(asked, index, plans, k)
    scored = cut(scored)
    chosen = select_diverse(scored, index.vectors, near, k)
    text = F.col("text")
    line = F.concat(F.lit("[Chunk "), "chunk_id", F.lit("] ("), "source_id", F.lit(") "), F.left(normalize_ws(text), F.lit(760)))
    rows = chosen.join(scored.select("qid", "pos", "covers"), ["qid", "pos"]).join(index.chunks, "pos")
    timed = temporal_score(text)
    per = rows.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("rank", line.alias("line"), "chunk_id", "pos"))).alias("r"), F.avg(F.least(F.lit(1.0), "score")).alias("relevance"), F.avg(timed).alias("mean_temporal"),
        F.array_distinct(F.flatten(F.collect_list("covers"))).alias("covered"), F.array_distinct(F.flatten(F.collect_list(F.when(timed > 0, F.col("covers"))))).alias("timed"),
    )
    lines = neighbours(edges, plan_seeds(plans), most_edges)
    g = lines.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]).alias("graph_lines"))
    none = F.array().cast("array<string>")
    out = plans.join(per, "qid", "left").join(g, "qid", "left").withColumn("graph_lines", F.coalesce("graph_lines", none)).withColumn("r", F.coalesce("r", F.array().cast("array<struct<rank: int, line: string, chunk_id: string, pos: bigint>>")))
    anchors_n = F.size("comparison_anchors")
    coverage = F.when(anchors_n == 0, 1.0).otherwise(F.coalesce(F.size("covered"), F.lit(0)) / anchors_n)
    temporal = F.when(anchors_n == 0, F.least(F.lit(1.0), F.coalesce("mean_temporal", F.lit(0.0)))).otherwise(F.coalesce(F.size("timed"), F.lit(0)) / anchors_n)
    out = out.withColumn("coverage", coverage).withColumn("temporal", temporal)
    chunk_marks = F.transform("r", lambda x: F.concat(F.lit("[Chunk "), x["chunk_id"], F.lit("]")))
    marks = ordered_distinct(F.when(F.size("graph_lines") > 0, F.concat(F.array(F.lit("[Graph]")), chunk_marks)).otherwise(chunk_marks))
    diversity = F.least(F.lit(1.0), F.size(marks) / F.lit(float(max(2, k))))
    conf = F.lit(0.45) * F.coalesce("relevance", F.lit(0.0)) + F.lit(0.20) * diversity + F.lit(0.20) * F.col("coverage") + F.lit(0.15) * F.col("temporal")
    cap = F.least(F.when(F.col("requires_derivation") & (F.col("coverage") < 1), 0.35).otherwise(1.0), F.when(F.col("requires_derivation") & (F.col("temporal") < 0.30), 0.45).otherwise(1.0))
    all_lines = F.array_join(F.concat(F.transform("r", lambda x: x["line"]), "graph_lines"), "\n")
    return out.select(
        "qid", F.transform("r", lambda x: x["chunk_id"]).alias("chunk_ids"), F.transform("r", lambda x: x["line"]).alias("chunk_lines"), "graph_lines", F.col("entities").alias("entity_hits"), F.col("metrics").alias("metric_hits"),
        F.slice(marks, 1, 20).alias("allowed_citations"), citations(all_lines).alias("context_citation_ids"), F.round("coverage", 6).alias("anchor_coverage"), F.round("temporal", 6).alias("temporal_signal"),
        F.round(F.least("coverage", "temporal"), 6).alias("derivation_ready"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf, cap)), 6).alias("confidence"), (cap < 1).alias("confidence_capped"),
        F.left("canonical_retrieval_query", F.lit(240)).alias("canonical_query"), anchors_n.alias("anchor_count"), "requires_derivation",
    )


def query_scores(asked: DataFrame, vectors: DataFrame, dim: int = 64) -> DataFrame:
    """Dense scores of questions by the hashed encoder against vectors made the same way."""
    q = hashed_vectors(asked.select("qid", "question"), "question", dim).select("qid", F.col("embedding").alias("query"))
    return dense_scores(q, vectors)
