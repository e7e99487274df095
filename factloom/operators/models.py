"""Model calls with a provider that is handed in: extraction in two passes with a cache, and answers in steps.

A provider is a picklable function (prompt, options) -> text; an error is a text that begins with [ERROR].
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.jsonish import entities_udf, facts_udf
from factloom.functions.text import cache_key, is_model_error, normalize_ws, ordered_distinct
from factloom.operators.facts import distinct_in_chunk, numeric_facts, timeline_facts
from factloom.session import cut

Provider = Callable[[str, dict], str]
FACT_COLUMNS = ("subject", "predicate", "object", "value", "unit", "timeframe")


def scripted(answers: dict[str, str], default: str = "") -> Provider:
    """A provider for tests: the answer of the first key that a prompt holds."""
    return lambda prompt, _: next((a for k, a in answers.items() if k in prompt), default)


def call_model(tasks: DataFrame, provider: Provider, prompt: str = "prompt", out: str = "answer", options: dict | None = None) -> DataFrame:
    """Adds the provider's answer to each row; a call that fails gives [ERROR]."""
    names = tasks.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(p: str) -> str:
            try:
                return provider(p, options or {})
            except Exception as e:  # a failed call is a result like any other
                return f"[ERROR] {e}"

        for pdf in batches:
            pdf[out] = [one(p) for p in pdf[prompt]]
            yield pdf[[*names, out]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tasks.schema.fields if f.name != out)
    return tasks.mapInPandas(run, f"{schema}, `{out}` string")


def cached_calls(tasks: DataFrame, cache: DataFrame, provider: Provider, options: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(tasks with answer, new cache rows). Stored answers are used; only successes are stored."""
    stored = cache.where("value IS NOT NULL AND NOT startswith(value, '[ERROR]')").groupBy("cache_key").agg(F.max_by("value", "updated_at").alias("answer"))
    hit = tasks.join(stored, "cache_key")
    fresh = cut(call_model(tasks.join(stored, "cache_key", "left_anti"), provider, options=options))  # a model is called once
    new = fresh.where(~is_model_error(F.col("answer"))).select("cache_key", F.col("answer").alias("value")).distinct()
    return hit.unionByName(fresh), new


def pass_a_prompt(text: Column) -> Column:
    return F.concat(F.lit('Extract facts as JSON {"facts": [{"subject", "predicate", "object", "value", "unit", "timeframe", "confidence"}], "entities": []} from the text.\n\nText:\n'), text)


def pass_b_prompt(text: Column, entities: Column, known: Column) -> Column:
    return F.concat(F.lit("Find relations between these entities that the known facts lack, in the same JSON form.\n\nEntities: "), F.array_join(entities, ", "), F.lit("\nKnown: "), known, F.lit("\n\nText:\n"), text)


def extract_facts(chunks: DataFrame, cache: DataFrame, provider: Provider, model: str = "scanner") -> tuple[DataFrame, DataFrame]:
    """(facts, new cache rows) of chunks (chunk_id, source_id, section_title, text).

    facts: (chunk_id, seq, fact fields, confidence, source_ref, source_id). Pass A asks for facts and entities; pass B, where there are two
    entities, for what is missing. Rules for numbers and years add theirs, with the first subject or the title as their
    subject. Every fact cites its chunk. Repetitions within a chunk become one. new cache rows (cache_key, value) are the answers that were
    not stored before; upsert them, and the next run calls no model.
    """
    a = chunks.where("trim(coalesce(text, '')) != ''").withColumn("prompt", pass_a_prompt(F.col("text"))).withColumn("cache_key", cache_key(F.lit(model), "v2.1-passA", F.col("prompt")))
    a, new_a = cached_calls(a, cache, provider)
    a = a.withColumn("facts_a", facts_udf("answer")).withColumn("named", entities_udf("answer"))
    ends = F.slice(ordered_distinct(F.concat(F.transform("facts_a", lambda f: f["subject"]), F.transform("facts_a", lambda f: f["object"]))), 1, 20)
    a = cut(a.withColumn("entities", F.when((F.size("named") < 2) & (F.size("facts_a") > 0), ends).otherwise(F.col("named"))).drop("prompt", "cache_key", "answer", "named"))
    b = a.where(F.size("entities") >= 2).withColumn("prompt", pass_b_prompt(F.col("text"), F.col("entities"), F.to_json("facts_a")))
    b, new_b = cached_calls(b.withColumn("cache_key", cache_key(F.lit(model), "v2.1-passB", F.col("prompt"))), cache, provider)
    b = b.withColumn("facts_b", facts_udf("answer", 0.70))
    title = F.nullif(normalize_ws(F.col("section_title")), F.lit(""))
    seeded = a.withColumn("seed", F.coalesce(F.get("facts_a", F.lit(0))["subject"], title, F.concat(F.lit("source:"), "source_id")))

    def listed(df: DataFrame, facts: str, part: int) -> DataFrame:
        rows = df.select("chunk_id", "source_id", F.posexplode(facts).alias("n", "f"))
        return rows.select("chunk_id", (F.lit(part * 1_000_000) + F.col("n")).cast("long").alias("seq"), *(F.col(f"f.{c}").alias(c) for c in (*FACT_COLUMNS, "confidence")), F.concat(F.lit("[Chunk "), "chunk_id", F.lit("]")).alias("source_ref"), "source_id")

    def ruled(df: DataFrame, part: int) -> DataFrame:
        return df.select("chunk_id", (F.lit(part * 1_000_000) + F.col("n")).cast("long").alias("seq"), *FACT_COLUMNS, "confidence", "source_ref", "source_id")

    both = listed(seeded, "facts_a", 0).unionByName(listed(b, "facts_b", 1))
    both = both.unionByName(ruled(numeric_facts(seeded, F.col("seed")), 2)).unionByName(ruled(timeline_facts(seeded, F.col("seed")), 3))
    return distinct_in_chunk(both), new_a.unionByName(new_b)
