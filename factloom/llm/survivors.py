"""Best representative of each duplicate group: field-by-field survivorship in a single aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.amounts import states_amount

CITATION = r"(?i)\[\s*chunk\s+([^\],\s]+)\s*\]"
FIELDS = ("value", "source_ref", "confidence")


def _ranked(usable: Column) -> Column:
    """What is compared: usable first, then trust, confidence, time; of equals the smallest seq."""
    return F.when(usable, F.struct("trust", "sure", "extracted_at", (-F.col("seq")).alias("back")))


def surviving_fields(facts: DataFrame, groups: DataFrame, sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """(group_id, field, seq): the member that each field of a group's surviving fact is taken from.

    Usable: a value that states an amount, a source_ref that cites a chunk found in chunks, a confidence from 0 to 1.
    The best member has the highest trust (null, or a source that isn't listed: lowest), confidence (unusable: lowest),
    extracted_at (null: lowest), and then the smallest seq. A group without a usable field gives no row for it; members
    without a fact, null ids, repeated memberships and empty tables add nothing; further columns play no role.

    Citations are checked by a semi join whose left side has one row for each group and cited chunk, so a chunk that
    many facts cite doesn't swell it. Groups of any size are reduced by partial aggregation.
    """
    sure = F.col("confidence").cast("double")
    usable = F.coalesce(~F.isnan(sure) & sure.between(0, 1), F.lit(False))
    members = groups.select("group_id", "seq").dropna().distinct().join(facts.select("seq", "value", "source_ref", "confidence", "source_id", "extracted_at"), "seq")
    trust = sources.groupBy("source_id").agg(F.max("trust").alias("trust"))
    members = members.join(trust, "source_id", "left").select(
        "group_id", "seq", F.coalesce("trust", F.lit(-(2**31))).alias("trust"), F.when(usable, sure).otherwise(-1.0).alias("sure"),
        F.coalesce("extracted_at", F.lit("0001-01-01").cast("timestamp")).alias("extracted_at"), "source_ref",
        states_amount(F.col("value")).alias("has_amount"), usable.alias("has_confidence"),
    )
    cited = members.withColumn("chunk_id", F.explode(F.array_distinct(F.regexp_extract_all("source_ref", F.lit(CITATION), 1))))
    cited = cited.groupBy("group_id", "chunk_id").agg(F.max(_ranked(F.lit(True))).alias("source_ref"))
    cited = cited.join(chunks.select("chunk_id").dropna(), "chunk_id", "left_semi")
    own = members.select("group_id", _ranked(F.col("has_amount")).alias("value"), _ranked(F.col("has_confidence")).alias("confidence"))
    best = own.unionByName(cited.select("group_id", "source_ref"), allowMissingColumns=True).groupBy("group_id").agg(*(F.max(f).alias(f) for f in FIELDS))
    taken = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), (-F.col(f)["back"]).alias("seq")) for f in FIELDS)))
    return best.select("group_id", taken.alias("x")).select("group_id", "x.field", "x.seq").where("seq IS NOT NULL")


def surviving_records(facts: DataFrame, groups: DataFrame, sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """(group_id, value, source_ref, confidence, value_seq, source_ref_seq, confidence_seq): the surviving record of each group.

    Each field is that of the member surviving_fields() takes it from, null where no member has a usable one; a group without
    any gives no row. Nulls, repeated rows and empty tables: see surviving_fields(). Of repeated facts with one seq the smallest texts count.
    """
    taken = surviving_fields(facts, groups, sources, chunks)
    rows = facts.groupBy("seq").agg(F.min("value").alias("value"), F.min("source_ref").alias("source_ref"), F.min(F.col("confidence").cast("double")).alias("confidence"))
    of = taken.join(rows, "seq")
    one = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    return of.groupBy("group_id").agg(*(one(f, f).alias(f) for f in FIELDS), *(one(f, "seq").alias(f"{f}_seq") for f in FIELDS))
