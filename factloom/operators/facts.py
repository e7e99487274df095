"""Facts from chunks by rules and from model answers, and their removal of repetitions within a chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import normalize_ws, timeline_object

# Fixed patterns of the rules.
SENTENCE = r"[^.!?\n]{0,240}\d[^.!?\n]{0,240}"
METRIC = r"(?i)(revenue|ebitda|ebit|margin|cash flow|fcf|capex|volume|cost|profit|guidance|growth)"
VALUE = r"(?i)(-?\d[\d,]*(?:\.\d+)?)\s*(%|percent|bn|billion|million|m|k|usd|eur|dkk|gbp|teu|tons?)?"
PERIOD = r"(?i)\b((?:19|20)\d{2}|Q[1-4]|FY\s?\d{2})\b"
YEARS = r"(?i)(?:(?:takes place|set)\s+(?:about|around|approximately|nearly)?\s*)?(\d{1,4})\s+years?\s+(before|after)\s+([A-Z][^.;:\n]{2,120})"


def _cited(chunk_id: Column) -> Column:
    return F.concat(F.lit("[Chunk "), chunk_id, F.lit("]"))


def _listed(rows: DataFrame, facts: Column) -> DataFrame:
    """One row for each of the facts of a chunk, with its number and the reference of the chunk. Nothing is shuffled."""
    rows = rows.select("chunk_id", "source_id", F.posexplode(facts).alias("i", "f"))
    return rows.select("chunk_id", "source_id", (F.col("i") + 1).cast("int").alias("n"), "f.*", _cited(F.col("chunk_id")).alias("source_ref"))


def numeric_facts(chunks: DataFrame, subject: Column, most: int = 6, least: int = 40) -> DataFrame:
    """Facts reported_<metric> of sentences with a metric and a number: the first number, its unit and the first period.

    chunks: (chunk_id, source_id, text); the first `most` of a chunk. Null and short texts give none.
    """

    def fact(s: Column) -> Column:
        value, unit = F.regexp_extract(s, VALUE, 1), F.regexp_extract(s, VALUE, 2)
        return F.struct(
            F.concat(F.lit("reported_"), F.replace(F.lower(F.regexp_extract(s, METRIC, 1)), F.lit(" "), F.lit("_"))).alias("predicate"), F.when(unit == "", value).otherwise(F.concat_ws(" ", value, unit)).alias("object"),
            value.alias("value"), unit.alias("unit"), F.regexp_extract(s, PERIOD, 1).alias("timeframe"), F.lit(0.66).alias("confidence"),
        )

    sentences = F.transform(F.regexp_extract_all("text", F.lit(SENTENCE), 0), normalize_ws)
    kept = F.slice(F.filter(sentences, lambda s: (F.length(s) >= 16) & s.rlike(METRIC)), 1, most)
    rows = chunks.where(F.length("text") >= least).withColumn("seed", subject)
    return _with_subject(rows, F.transform(kept, fact))


def _with_subject(rows: DataFrame, facts: Column) -> DataFrame:
    named = F.transform(facts, lambda f: F.struct(F.col("seed").alias("subject"), f.alias("f")))
    out = _listed(rows, named)
    return out.select("chunk_id", "source_id", "n", "subject", "f.*", "source_ref")


def timeline_facts(chunks: DataFrame, subject: Column, most: int = 8, least: int = 20) -> DataFrame:
    """Facts occurs_years_before and occurs_years_after of statements "N years before X"; the first `most` of a chunk."""

    def fact(s: Column) -> Column:
        predicate = F.concat(F.lit("occurs_years_"), F.lower(F.regexp_extract(s, YEARS, 2)))
        return F.struct(predicate.alias("predicate"), timeline_object(F.regexp_extract(s, YEARS, 3)).alias("object"), F.regexp_extract(s, YEARS, 1).alias("value"), F.lit("years").alias("unit"), F.lit("").alias("timeframe"), F.lit(0.68).alias("confidence"))

    found = F.filter(F.transform(F.regexp_extract_all("text", F.lit(YEARS), 0), fact), lambda f: f["object"] != "")
    return _with_subject(chunks.where(F.length("text") >= least).withColumn("seed", subject), F.slice(found, 1, most))


FACT_KIND = "struct<subject: string, predicate: string, object: string, value: string, unit: string, timeframe: string, source_ref: string, confidence: string>"


def facts_of_json(answers: DataFrame, default_confidence: float = 0.76) -> DataFrame:
    """(entry_id, n, fact fields) of answers (entry_id, value) that are JSON: an object with facts, a list, or one fact.

    The confidence is put between 0 and 1, the default where it is no number. Facts without subject, predicate or
    object are left out; answers that aren't JSON give none.
    """
    v = F.trim("value")
    listed = F.from_json(v, f"array<{FACT_KIND}>", {"mode": "PERMISSIVE"})
    inner = F.from_json(v, f"struct<facts: array<{FACT_KIND}>>", {"mode": "PERMISSIVE"})["facts"]
    single = F.array(F.from_json(v, FACT_KIND, {"mode": "PERMISSIVE"}))
    facts = F.when(v.startswith("["), listed).when(v.startswith("{"), F.coalesce(inner, single))
    # from_json repairs what it can; a broken or cut answer, or several in a row, isn't for this reader
    rows = answers.where(F.try_parse_json("value").isNotNull() & ~F.col("value").rlike(r"\}\s*\n\s*\{")).select("entry_id", F.posexplode(facts).alias("n", "f"))
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("f.confidence").try_cast("double"), F.lit(default_confidence))))
    text = [normalize_ws(F.col(f"f.{x}")).alias(x) for x in ("subject", "predicate", "object", "value", "unit", "timeframe")]
    return rows.select("entry_id", "n", *text, c.alias("confidence")).where("subject != '' AND predicate != '' AND object != ''")


def distinct_in_chunk(facts: DataFrame) -> DataFrame:
    """One row for facts of a chunk that agree in their six texts but for case and space: the first place, the surest values.

    Columns source_ref and source_id are kept where there are any.
    """
    texts = ("subject", "predicate", "object", "value", "unit", "timeframe")
    more = tuple(c for c in ("source_ref", "source_id") if c in facts.columns)
    key = [F.lower(normalize_ws(F.col(c))).alias(f"k_{c}") for c in texts]
    sure = F.coalesce(F.nanvl("confidence", F.lit(0.0)), F.lit(0.0))
    best = F.max_by(F.struct(*texts, sure.alias("confidence"), *more), F.struct(sure, -F.col("seq")))
    rows = facts.groupBy("chunk_id", *key).agg(F.min("seq").alias("seq"), best.alias("best"))
    return rows.select("chunk_id", "seq", *(F.col(f"best.{c}").alias(c) for c in (*texts, "confidence", *more)))


def cache_misses(tasks: DataFrame, cache: DataFrame) -> DataFrame:
    """The tasks (cache_key, ...) whose key has no stored answer; stored errors count as none."""
    stored = cache.where("value IS NOT NULL AND NOT startswith(value, '[ERROR]')").select("cache_key")
    return tasks.join(stored, "cache_key", "left_anti")


def upsert_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """(cache_key, value, updated_at): of each key the row written last, by updated_at and then entry_id; empty keys are ignored."""
    both = cache.unionByName(new).where("cache_key IS NOT NULL AND cache_key != ''")
    best = both.groupBy("cache_key").agg(F.max_by(F.struct("value", "updated_at"), F.struct("updated_at", "entry_id")).alias("r"))
    return best.select("cache_key", "r.value", "r.updated_at")
