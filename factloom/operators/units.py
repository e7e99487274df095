"""Quantities recorded in different units.

The columns of a fact are bound by identities: an amount is a number times a scale times a base unit, value and unit give
these parts once, and the object gives the amount again. Every combination of a reading of the number, a scale and a base
that some column states is tried; its residual is the sum of the logs by which the columns miss each other, and the least
residual decides. Combinations that miss by as little and give another amount are rivals: they are decided by product
identities among facts of one subject and period (profit = margin * revenue) where these tell them apart, and flagged otherwise.

What a predicate measures isn't listed: it is the dimension whose units explain most of its facts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.amounts import Unit, UnitReader, numbers
from factloom.session import cut, spread

#: (product, factor, factor, constant): product = factor * factor * constant, in the common units. Shares are percents.
IDENTITIES: tuple[tuple[str, str, str, float], ...] = (
    ("reported_profit", "reported_margin", "reported_revenue", 0.01),
    ("mass", "density", "volume", 1.0),
    ("cost", "price", "quantity", 1.0),
    ("part", "share", "whole", 0.01),
)
#: Tables of predicates up to this size are broadcast.
MOST_PREDICATES = 100_000
#: What a statement in another currency or kind adds to a residual.
_FOREIGN = 9.0
_SCALES = {"": 1.0, "k": 1e3, "m": 1e6, "bn": 1e9}


def _letters(x: str) -> str:
    return "".join(c for c in x.lower() if c.isalpha())


class Converter:
    """Finds the amounts of a fact; made from the rows of a unit catalog (dimension, unit_code, common_unit, factor).

    use_residuals=False leaves the choice to the order of the catalog (for tests of what the residuals decide).
    """

    def __init__(self, catalog: list[tuple[str, str, str, float]], tolerance: float = 0.02, use_residuals: bool = True):
        self.tolerance, self.use_residuals = tolerance, use_residuals
        self.factor = {code: (common, factor) for _, code, common, factor in catalog}
        self.order: dict[str, int] = {}
        self.dimension: dict[str, str] = {}
        for dimension, code, _, _ in catalog:
            base = code.split(" ")[-1]
            self.dimension.setdefault(base, dimension.split(" ")[0])
            self.order.setdefault(base, len(self.order))
        self.reader = UnitReader(self.dimension)
        self.seen: dict[tuple, dict] = {}

    def factor_of(self, scale: str, base: str) -> tuple[str, float]:
        """(common unit, factor) of a scaled unit; a scaled code of the catalog is used where there is one."""
        if scale:
            for code in (f"{scale} {base}", f"{scale}{base}"):
                if code in self.factor and (base, code) != ("m", "km"):
                    return self.factor[code]
        common, f = self.factor[base]
        return common, f * _SCALES[scale]

    def convert(self, value: str | None, unit: str | None, obj: str | None) -> dict[str, tuple[str, float, float, list[tuple[str, float]]]]:
        """By dimension: (common unit, amount, residual, rivals) of the best combination. Empty without an amount or unit."""
        key = (value, unit, obj)
        if key not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[key] = self._convert(*key)
        return self.seen[key]

    def _convert(self, value: str | None, unit: str | None, obj: str | None) -> dict:
        v = (value or "").lower()
        found = numbers(v)
        if not found:
            return {}
        number = found[0]
        head = v[: number.start].strip(" \t\n\"'“”*<(").replace("put at", "").replace("amounting to", "")
        if head.startswith("see "):
            return {}
        o = (obj or "").lower()
        restated = [(n, u) for n in numbers(o) if (u := self.reader.beside(o[: n.start], o[n.end :]))]
        stated = [s for s in (self.reader.beside(v[: number.start], v[number.end :]), self.reader.alone((unit or "").lower()), *(u for _, u in restated)) if s]
        return {d: best for d in {self.dimension[u.base] for s in stated for u in s if u.base} if (best := self._best(d, number.readings, stated, restated))}

    def _best(self, dimension: str, readings: tuple[float, ...], stated: list[list[Unit]], restated: list) -> tuple:
        def here(s: list[Unit]) -> list[Unit]:  # m is metres among distances and millions elsewhere
            return [u for u in s if u.base and self.dimension[u.base] == dimension] or [u for u in s if not u.base]

        said = [s for x in stated if (s := here(x))]
        again = [(n.readings, self.factor_of(u.scale, u.base)) for n, x in restated for u in here(x) if u.base]
        bases = sorted({u.base for s in said for u in s if u.base}, key=self.order.__getitem__)
        scales = sorted({u.scale for s in said for u in s} | {""}, key=_SCALES.__getitem__)
        alone = any(not u.base for s in said for u in s)  # a scale in one column and the base in another make one unit
        options = []
        for i, r in enumerate(readings):
            for base in bases:
                for scale in scales:
                    common, f = self.factor_of(scale, base)
                    total = 0.0
                    for s in said:
                        total += min(self._miss(u, scale, base, common, f, alone) for u in s)
                    # the object states the amount once more
                    misses = [self._apart(r * f, q * g) if c == common else _FOREIGN for qs, (c, g) in again for q in qs]
                    total += min(misses, default=0.0)
                    options.append((total if self.use_residuals else 0.0, i, common, r * f))
        least = min(x[0] for x in options)
        near = [x for x in options if x[0] <= least + self.tolerance]
        best = min(near, key=lambda x: x[1])
        rivals = list(dict.fromkeys((x[2], x[3]) for x in near if (x[2], round(x[3], 9)) != (best[2], round(best[3], 9))))
        return best[2], best[3], best[0], rivals

    def _miss(self, u: Unit, scale: str, base: str, common: str, f: float, alone: bool) -> float:
        """The log by which a stated unit, or its part, misses the tried one."""
        if not u.base:
            return abs(math.log(_SCALES[scale] / _SCALES[u.scale]))
        if not u.scale and alone:  # its scale may stand elsewhere
            c, g = self.factor_of("", u.base)
            return abs(math.log(self.factor_of("", base)[1] / g)) if c == common else _FOREIGN
        c, g = self.factor_of(u.scale, u.base)
        return abs(math.log(f / g)) if c == common else _FOREIGN

    @staticmethod
    def _apart(a: float, b: float) -> float:
        a, b = abs(a), abs(b)
        return 0.0 if a == b else abs(math.log(a / b)) if a and b else _FOREIGN


_READ = "seq long, predicate string, subject string, period string, dimension string, common_unit string, amount double, residual double, rivals array<struct<common_unit: string, amount: double>>"


def read_quantities(facts: DataFrame, catalog: DataFrame, tolerance: float = 0.02, use_residuals: bool = True) -> DataFrame:
    """A row for each fact and dimension in which its columns state an amount: the best combination, its residual and its rivals."""
    rows = catalog.select("dimension", "unit_code", "common_unit", F.col("factor").cast("double")).dropna().limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("a unit catalog has at most 10,000 rows")
    known = [tuple(r) for r in rows]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = Converter(known, tolerance, use_residuals)
        for pdf in batches:
            out = []
            for seq, p, s, t, *texts in zip(*(pdf[x] for x in ("seq", "predicate", "subject", "period", "value", "unit", "object"))):
                out += [(seq, p, s, t, d, unit, amount, residual, rivals) for d, (unit, amount, residual, rivals) in c.convert(*texts).items()]
            yield pd.DataFrame(out, columns=["seq", "predicate", "subject", "period", "dimension", "common_unit", "amount", "residual", "rivals"])

    letters = lambda c, rx: F.regexp_replace(F.lower(F.col(c).cast("string")), rx, "")
    text = [F.regexp_replace(F.col(c).cast("string"), r"[\p{Cf}]+", "").alias(c) for c in ("value", "unit", "object")]
    measured = facts.where(F.col("value").rlike(r"\d") & F.col("seq").isNotNull() & F.col("predicate").isNotNull())
    measured = measured.select("seq", letters("predicate", r"[^\p{L}]+").alias("predicate"), letters("subject", r"[^\p{L}\p{N}]+").alias("subject"), letters("timeframe", r"[^\p{L}\p{N}]+").alias("period"), *text)
    return spread(measured).mapInPandas(read, _READ)


def measured_dimensions(read: DataFrame, least_share: float = 0.5) -> DataFrame:
    """(predicate, dimension): the dimension whose units explain most facts of a predicate, at least least_share of those with a unit."""
    votes = read.groupBy("predicate", "dimension").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("predicate").agg(F.max(F.struct("n", "dimension")).alias("best"))
    of = read.select("predicate", "seq").distinct().groupBy("predicate").agg(F.count(F.lit(1)).alias("facts")) if least_share > 0 else None
    out = best.select("predicate", "best.dimension", "best.n")
    return out if of is None else out.join(of, "predicate").where(F.col("n") >= least_share * F.col("facts")).select("predicate", "dimension")


def decide_by_products(amounts: DataFrame, identities: tuple[tuple[str, str, str, float], ...] = IDENTITIES, tolerance: float = 0.02) -> DataFrame:
    """Amounts with rivals, decided by an identity with two facts of the same subject and period where just one of them fits.

    Every predicate of a subject and period counts with its one amount: where its facts differ by more than the tolerance it decides
    nothing, so each row meets two rows at most and no group is gathered.
    """
    terms = []  # predicate, the other two, and amount = constant * other ** a * third ** b
    for product, x, y, k in identities:
        product, x, y = map(_letters, (product, x, y))
        terms += [(product, x, y, k, 1, 1), (x, product, y, 1 / k, 1, -1), (y, product, x, 1 / k, 1, -1)]
    spark = amounts.sparkSession
    rules = F.broadcast(spark.createDataFrame(terms, "predicate string, p1 string, p2 string, k double, e1 int, e2 int"))  # three rows for an identity
    kept = amounts.where(F.size("rivals") == 0)
    ties = amounts.where(F.size("rivals") > 0)
    named = sorted({p for t in terms for p in t[:3]})
    sure = kept.where(F.col("predicate").isin(named) & (F.length("subject") > 0) & (F.length("period") > 0) & (F.col("amount") != 0))
    sure = sure.groupBy("subject", "period", "predicate").agg(F.min("amount").alias("low"), F.max("amount").alias("high"))
    sure = sure.where(F.abs(F.col("high") - F.col("low")) <= tolerance * F.abs("high")).select("subject", "period", "predicate", "low")
    options = ties.join(rules, "predicate").withColumn("options", F.concat(F.array(F.struct("common_unit", "amount")), "rivals"))
    for i in ("1", "2"):
        options = options.join(sure.select("subject", "period", F.col("predicate").alias(f"p{i}"), F.col("low").alias(f"a{i}")), ["subject", "period", f"p{i}"])
    expected = F.col("k") * F.pow("a1", F.col("e1").cast("double")) * F.pow("a2", F.col("e2").cast("double"))
    fits = F.filter("options", lambda x: F.abs(F.log(F.abs(x["amount"] / expected))) <= tolerance)
    decided = options.select("seq", fits.alias("fits")).where(F.size("fits") == 1).groupBy("seq").agg(F.min(F.get("fits", F.lit(0))).alias("one"), F.max(F.get("fits", F.lit(0))).alias("other"))
    decided = decided.where("one.amount = other.amount").select("seq", "one")
    none = F.array().cast("array<struct<common_unit: string, amount: double>>")
    ties = ties.join(decided, "seq", "left").withColumn("common_unit", F.coalesce("one.common_unit", "common_unit"))
    ties = ties.withColumn("amount", F.coalesce("one.amount", "amount")).withColumn("rivals", F.when(F.col("one").isNull(), F.col("rivals")).otherwise(none)).select(*amounts.columns)
    return kept.unionByName(ties)


def convert_quantities(facts: DataFrame, catalog: DataFrame, tolerance: float = 0.02, use_residuals: bool = True) -> DataFrame:
    """(seq, common_unit, amount, residual, is_unique) of every fact whose value states a number in a unit that is told.

    The unit is told by value, unit or object and must be of the dimension that the facts of the predicate measure. Of combinations
    with rivals that nothing decides the likelier reading of the number is taken, then the first of the catalog, and is_unique
    is false. Facts with a null predicate, a null or wordy value or no unit give no row; repeated rows each give one; further
    columns play no role; an empty table gives no rows. The catalog is a table of fixed size (at most 10,000 rows are taken).
    """
    read = cut(read_quantities(facts, catalog, tolerance, use_residuals))
    dimensions = cut(measured_dimensions(read))
    dimensions = F.broadcast(dimensions) if dimensions.count() <= MOST_PREDICATES else dimensions
    amounts = decide_by_products(read.join(dimensions, ["predicate", "dimension"], "left_semi"), tolerance=tolerance)
    return amounts.select("seq", "common_unit", "amount", "residual", (F.size("rivals") == 0).alias("is_unique"))


def thousandths(amounts: DataFrame) -> DataFrame:
    """(seq, common_unit, thousandths): the amounts as whole thousandths of the common unit."""
    return amounts.select("seq", "common_unit", F.rint(F.col("amount") * 1000).cast("long").alias("thousandths"))
