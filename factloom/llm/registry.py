"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.dedup import formatting_duplicates
from factloom.llm.names import entity_spellings, spelling_pairs
from factloom.llm.neighbours import nearest_neighbours, neighbour_pairs
from factloom.llm.packing import document_containers
from factloom.llm.scans import page_noise, repaired_texts
from factloom.llm.survivors import surviving_fields, surviving_records
from factloom.llm.tokens import token_ids
from factloom.llm.toxicity import review_scores, source_rates
from factloom.llm.truncation import cut_shares, cut_texts
from factloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return surviving_fields(*(table(spark, d, t) for t in ("facts", "fact_groups", "source_list", "chunks")))


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    return surviving_records(*(table(spark, d, t) for t in ("facts", "fact_groups", "source_list", "chunks")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return page_noise(table(spark, d, "chunks"))


def p2_text(spark: SparkSession, d: str) -> DataFrame:
    return repaired_texts(table(spark, d, "chunks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "facts")
    names = facts.select(F.explode(F.array("subject", "object")).alias("name"))
    return spelling_pairs(entity_spellings(names, table(spark, d, "given_names")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbour_pairs(nearest_neighbours(table(spark, d, "index_vectors")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return formatting_duplicates(table(spark, d, "facts"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return cut_texts(table(spark, d, "extract_cache")).where("is_cut").select("entry_id")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return cut_shares(table(spark, d, "extract_cache"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return document_containers(table(spark, d, "documents"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return review_scores(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_scores(spark, d).where("category IS NOT NULL").select("doc_id", "category")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return source_rates(p10_scores(spark, d))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_records, p2_found, p2_text, p3_found, p4_found, p6_found, p7_found, p7_shares, p8_ids, p9_containers, p10_found, p10_scores, p10_rates)}


_AMOUNT = r"(?i)^[\s\p{Z}'“”*<(\[]*(?:(?:about|approximately|approx\.|approx|around|roughly|circa|ca\.|c\.|nearly|almost|some|~|≈|put at|amounting to)\s*)*[(]?\s*(?:us\$|\p{Sc}|\b(?:eur|usd|gbp|dkk)\b)?\s*[-+−]?\s*(?:us\$|\p{Sc}|\b(?:eur|usd|gbp|dkk)\b)?\s*[.,]?\d"


def _best(field: str, usable: str) -> str:
    return f"SELECT group_id, '{field}' AS field, seq FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY trust DESC, sure DESC, ts DESC, seq) AS rn FROM m WHERE {usable}) WHERE rn = 1"


def oracle_sql() -> dict[str, str]:
    amount = _AMOUNT.replace("'", "''")
    survivors = f"""WITH m AS (SELECT g.group_id, f.seq, f.value, f.source_ref, coalesce(s.trust, -99) AS trust, CASE WHEN f.confidence BETWEEN 0 AND 1 AND NOT isnan(f.confidence) THEN f.confidence ELSE -1 END AS sure, coalesce(f.extracted_at, TIMESTAMP '0001-01-01') AS ts
        FROM (SELECT DISTINCT group_id, seq FROM fact_groups) g JOIN facts f USING (seq) LEFT JOIN source_list s USING (source_id))
        {_best("value", f"regexp_matches(value, '{amount}')")} UNION ALL {_best("confidence", "sure >= 0")}
        UNION ALL {_best("source_ref", "len(list_intersect(regexp_extract_all(source_ref, '(?i)\\[\\s*chunk\\s+([^\\],\\s]+)\\s*\\]', 1), (SELECT list(DISTINCT chunk_id) FROM chunks))) > 0")}"""
    pairs = """WITH v AS (SELECT pos, embedding::DOUBLE[] AS e FROM index_vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (SELECT a.pos AS p, b.pos AS q, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)), 9) AS s FROM v a, v b WHERE a.pos <> b.pos),
        r AS (SELECT p, q, row_number() OVER (PARTITION BY p ORDER BY s DESC, q) AS rn FROM s)
        SELECT DISTINCT least(p, q) AS pos_a, greatest(p, q) AS pos_b FROM r WHERE rn <= 10"""
    records = f"""WITH r AS ({survivors}) SELECT group_id, max(CASE WHEN field = 'value' THEN value END) AS value, max(CASE WHEN field = 'source_ref' THEN source_ref END) AS source_ref, max(CASE WHEN field = 'confidence' THEN confidence END) AS confidence,
        {", ".join(f"max(CASE WHEN field = '{f}' THEN seq END) AS {f}_seq" for f in ("value", "source_ref", "confidence"))} FROM r JOIN facts USING (seq) GROUP BY group_id"""
    return {"p1_found": survivors, "p1_records": records, "p4_found": pairs}
