"""Duplicates hidden by formatting differences.

Rows are reduced to a 128-bit canonical key of (subject, predicate, object) inside the JVM. Hot keys are
found from partial counts of each partition, salted and aggregated in two levels; all other keys take one shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import cut

#: Candidates for hot keys are broadcast up to this number.
MOST_CANDIDATES = 500_000
#: Words that stand for a missing field, in canonical form.
PLACEHOLDERS = ("", "none", "null", "nil", "na", "nan", "unknown", "tbd", "notdisclosed", "notavailable", "missing")

#: Decimal marks, and signs of numbers and exponents, stay (group 1); other punctuation, space and invisible characters go.
_DROP = r"(?![a-z0-9])(?:((?<=\d)[.,](?=\d)|(?<=\de)-(?=\d)|(?<![\p{L}\p{N}])-(?=[.,]?\d))|[\s\p{Z}\p{C}\p{P}<>|`^~´¨¯&&[^%‰‱]])"
_PLAIN = " \t\n.,;:!?'\"*/_-"


def canonical(text: Column) -> Column:
    """Lower-case text without white space and punctuation.

    The sign, decimal mark and exponent of a number and signs such as % or a currency stay; commas that group digits go.
    A number in round brackets, except a year, is a negative number. Null stays null.
    """
    low = F.lower(text)
    x = F.regexp_replace(low, r"\p{Cf}+", "")
    x = F.translate(x, "−﹣－", "---")
    x = F.regexp_replace(x, r"\((?!(?:19|20)\d\d\))(\d[\d.,]*)\)", "-$1")
    x = F.regexp_replace(x, r"(?<=\d),(?=\d{3}(?!\d))", "")
    x = F.regexp_replace(x, _DROP, "$1")
    # without digits there is no sign and no mark to keep
    return F.when(low.rlike(r"^[a-z \t\n.,;:!?'\"*/_-]*$"), F.translate(low, _PLAIN, "")).otherwise(x)


def canonical_listing(text: Column) -> Column:
    """canonical() of a text; the labelled parts of a listing ("a: 1; b: 2") are put in order, each with its label."""
    parts = F.split(F.regexp_replace(text, r"\p{Cf}+", ""), r"(?<![\p{L}\p{N}_])(?=\p{L}[\p{L}\p{N}_]*\s*:)")
    sorted_parts = F.array_join(F.array_sort(F.filter(F.transform(parts, canonical), lambda x: x != "")), "\u001f")
    many = text.contains(":") & (F.regexp_count(text, F.lit(r"\p{L}\s*\p{Cf}*:")) > 1)
    return F.when(many, sorted_parts).otherwise(canonical(text))


def keyed(facts: DataFrame) -> DataFrame:
    """(k1, k2, seq) of the facts that have a usable subject, predicate and object."""
    c = facts.select(
        F.col("seq").alias("seq"), canonical(F.col("subject")).alias("s"), canonical(F.col("predicate")).alias("p"), canonical_listing(F.col("object")).alias("o")
    )
    ok = F.col("seq").isNotNull()
    for x in ("s", "p", "o"):
        ok &= F.col(x).isNotNull() & ~F.col(x).isin(*PLACEHOLDERS)
    keys = c.select(F.when(ok, F.xxhash64("s", "p", "o")).alias("k1"), F.xxhash64(F.lit("second"), "o", "p", "s").alias("k2"), "seq")
    return cut(keys).where("k1 IS NOT NULL")  # filtered after the cut: a filter below would compute the keys twice


def hot_keys(rows: DataFrame, share: float, total: int) -> DataFrame:
    """Exactly the keys that hold at least share * total rows; at most 1 / share of them.

    A key with a share of all rows has it in one partition at least. So the keys that have the share of some partition are candidates,
    1 / share of each partition at most, and their rows are counted again, each partition's partial count first.
    """

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64())])
        seen, fresh, held, n = schema.empty_table(), [], 0, 0

        def merged(parts: list[pa.Table]) -> pa.Table:
            return pa.concat_tables(parts).group_by(["k1", "k2"]).aggregate([("n", "sum")]).rename_columns(["k1", "k2", "n"]).cast(schema)

        for b in batches:
            n += b.num_rows
            fresh.append(pa.Table.from_arrays([b.column(0), b.column(1), pa.repeat(pa.scalar(1, pa.int64()), b.num_rows)], schema=schema))
            held += b.num_rows
            if held > max(200_000, seen.num_rows):  # merged when as much is new as is known, so the work stays in proportion
                seen, fresh, held = merged([seen, *fresh]), [], 0
        seen = merged([seen, *fresh])
        yield from seen.filter(pc.greater_equal(seen["n"], pa.scalar(max(1, math.ceil(share * n)), pa.int64()))).to_batches()

    candidates = rows.select("k1", "k2").mapInArrow(heavy, "k1 long, k2 long, n long").select("k1", "k2").distinct()
    candidates = cut(candidates)
    counted = rows.join(F.broadcast(candidates) if candidates.count() <= MOST_CANDIDATES else candidates, ["k1", "k2"], "left_semi")
    return counted.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(2, share * total)).select("k1", "k2")


def formatting_duplicates(facts: DataFrame, hot_share: float = 0.002, salts: int = 64) -> DataFrame:
    """(seq, copies): one row for each set of two or more facts that differ in formatting only; seq is the smallest.

    A fact with a null, blank or placeholder subject, predicate or object, or without seq, takes no part; an empty table
    gives no rows; repeated rows count as copies; other columns play no role. hot_share: keys that may hold more rows are salted.
    """
    rows = keyed(facts)
    total = rows.count()
    hot = F.broadcast(hot_keys(rows, hot_share, total))  # at most 1 / hot_share rows
    measures = [F.sum("copies").alias("copies"), F.min("seq").alias("seq")]
    first = [F.count(F.lit(1)).alias("copies"), F.min("seq").alias("seq")]
    rest = rows.join(hot, ["k1", "k2"], "left_anti").groupBy("k1", "k2").agg(*first)
    heavy = rows.join(hot, ["k1", "k2"], "left_semi").withColumn("salt", F.pmod(F.xxhash64("seq"), F.lit(salts)))
    heavy = heavy.groupBy("k1", "k2", "salt").agg(*first).groupBy("k1", "k2").agg(*measures)
    return rest.unionByName(heavy).where("copies > 1").select("seq", "copies")
