"""Most similar vectors for every vector, by an inverted multi-index.

Both halves of the unit vectors are quantised apart. A query visits the cells of centroid pairs in order of summed
distance, with a heap, until it has seen enough entries; those are ranked again by their exact cosine.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import cut, spread

#: The centroids are fitted on so many vectors at most, those of the smallest hash of pos.
TRAINING_ROWS = 20_000
#: A task compares a block of so many entries with a block of so many queries at most.
BLOCK = 40_000


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(mask of usable rows, float64 matrix of these)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ok = lengths == dim
    flat = column.filter(pa.array(ok)).flatten()
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)  # null elements become NaN
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    ok[np.flatnonzero(ok)[~good]] = False
    return ok, x[good]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = _distances(x, c).argmin(axis=1)
        n = np.bincount(at, minlength=k)
        for j in range(x.shape[1]):
            s = np.bincount(at, weights=x[:, j], minlength=k)
            c[:, j] = np.where(n > 0, s / np.maximum(n, 1), c[:, j])
        empty = np.flatnonzero(n == 0)
        c[empty] = x[rng.integers(len(x), size=len(empty))]
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)


def cells_in_order(first: np.ndarray, second: np.ndarray, counts: np.ndarray, candidates: int) -> list[int]:
    """Non-empty cells by summed distance of their centroids until they hold so many entries. counts: of all k * k cells."""
    k = len(second)
    a, b = first.argsort(), second.argsort()
    fa, fb = first[a].tolist(), second[b].tolist()
    la, lb = a.tolist(), b.tolist()
    out: list[int] = []
    heap = [(fa[0] + fb[0], 0, 0)]
    n = 0
    while heap and n < candidates:
        _, i, j = heapq.heappop(heap)
        cell = la[i] * k + lb[j]
        if counts[cell]:
            out.append(cell)
            n += counts[cell]
        if i + 1 < len(la):
            heapq.heappush(heap, (fa[i + 1] + fb[j], i + 1, j))
        if i == 0 and j + 1 < k:  # each pair is reached by one way only
            heapq.heappush(heap, (fa[0] + fb[j + 1], 0, j + 1))
    return out


def _rank(entries: pa.Table, queries: pa.Table, dim: int, k: int) -> pa.Table:
    """The best k entries in the visited cells of each query: (rep, sim, pos), a row for each member of the entry's class."""
    schema = pa.schema([("rep", pa.int64()), ("sim", pa.float64()), ("pos", pa.int64())])
    if not entries.num_rows or not queries.num_rows:
        return schema.empty_table()
    x, q = (_unit(_matrix(t["embedding"], dim)[1]) for t in (entries, queries))
    cell = entries["cell"].to_numpy()
    order = np.argsort(cell, kind="stable")
    names, starts = np.unique(cell[order], return_index=True)
    ends = np.append(starts[1:], len(order))
    place = {int(c): (s, e) for c, s, e in zip(names, starts, ends)}
    visits = queries["cells"].combine_chunks()
    who = np.repeat(np.arange(queries.num_rows), visits.value_lengths().to_numpy(zero_copy_only=False))
    which = visits.flatten().to_numpy(zero_copy_only=False)
    by = np.argsort(which, kind="stable")
    cuts = np.flatnonzero(np.diff(which[by])) + 1
    best_q, best_e, best_s = [], [], []
    pending = 0

    def shrink() -> None:
        """Keep the best k + 1 of each query so far."""
        if not best_q:
            return
        qq, ee, ss = (np.concatenate(b) for b in (best_q, best_e, best_s))
        o = np.lexsort((-ss, qq))
        qq, ee, ss = qq[o], ee[o], ss[o]
        first = np.r_[0, np.flatnonzero(np.diff(qq)) + 1]
        nth = np.arange(len(qq)) - np.repeat(first, np.diff(np.r_[first, len(qq)]))
        keep = nth <= k  # the query itself is among them
        # entries as similar as the k-th, to 9 decimals, stay too: their order is by pos
        edge = np.full(queries.num_rows, -2.0)
        np.maximum.at(edge, qq[nth == k], ss[nth == k])
        keep |= ss >= edge[qq] - 2e-9
        best_q[:], best_e[:], best_s[:] = [qq[keep]], [ee[keep]], [ss[keep]]

    for group in np.split(by, cuts) if len(by) else []:
        span = place.get(int(which[group[0]]))
        if span is None:
            continue
        rows, cols = who[group], order[span[0] : span[1]]
        sims = q[rows] @ x[cols].T
        best_q.append(np.repeat(rows, len(cols)))
        best_e.append(np.tile(cols, len(rows)))
        best_s.append(sims.ravel())
        pending += sims.size
        if pending > 4_000_000:
            shrink()
            pending = 0
    shrink()
    if not best_q:
        return schema.empty_table()
    qq, ee, ss = best_q[0], best_e[0], best_s[0]
    reps, own = queries["rep"].to_numpy(), entries["rep"].to_numpy()
    other = reps[qq] != own[ee]
    qq, ee, ss = qq[other], ee[other], ss[other]
    members = entries["members"].combine_chunks()
    n = members.value_lengths().to_numpy(zero_copy_only=False)
    begin = np.cumsum(n) - n
    flat = members.flatten().to_numpy(zero_copy_only=False)
    times = n[ee]
    inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    pos = flat[np.repeat(begin[ee], times) + inner]
    return pa.Table.from_arrays([pa.array(np.repeat(reps[qq], times)), pa.array(np.round(np.repeat(ss, times), 9)), pa.array(pos)], schema=schema)


def _blocks(counts: dict[int, int], groups: int) -> Column:
    """The number of blocks of each group, by the column g."""
    return F.element_at(F.array(*(F.lit(max(1, math.ceil(counts.get(g, 0) / BLOCK))) for g in range(groups))), F.col("g") + 1)


def nearest_neighbours(vectors: DataFrame, k: int = 10, dim: int = 64, candidates: int = 500, most_centroids: int = 1024) -> DataFrame:
    """(pos, neighbour, rank, sim): for every usable vector the k others of highest cosine similarity, nearly all of them right.

    Vectors that are null, all zero, of another length, or hold null, NaN or infinite numbers take no part. Similarities that agree to
    9 decimals are equal; of equals the smaller pos comes first. Vectors that agree but for their length (to 5 decimals of the
    unit vector) form a class, which is searched once and named by its smallest pos, so equal vectors don't fill a
    cell. pos is unique; repeated equal rows count once. Fewer than k + 1 usable vectors: all others. An empty table gives no rows.

    Centroids: about sqrt(n / 3) for each half, most_centroids at most, fitted on TRAINING_ROWS vectors; all are indexed.
    A query sees the cells with the nearest centroids until they hold `candidates` entries, and every entry of them.
    """

    def classes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, x = _matrix(b.column(1), dim)
            u = np.ascontiguousarray(np.round(_unit(x), 5) + 0.0).astype("<f4")
            two = pd.util.hash_array(np.array([r.tobytes() for r in u], dtype=object), categorize=False).view(np.int64) if len(u) else np.zeros(0, np.int64)
            keep = b.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([keep.column(0), keep.column(1).cast(pa.list_(pa.float32())), pa.array(two)], ["pos", "embedding", "class"])

    rows = spread(vectors.select(F.col("pos").cast("long").alias("pos"), F.col("embedding").cast("array<float>").alias("embedding")).where("pos IS NOT NULL AND embedding IS NOT NULL"))
    rows = cut(rows.mapInArrow(classes_of, "pos long, embedding array<float>, class long"))
    w = Window.partitionBy("class").orderBy("pos")
    small = rows.select("class", "pos").distinct().withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k + 1)  # cut off before the shuffle
    lists = small.groupBy("class").agg(F.array_sort(F.collect_list("pos")).alias("members"))
    sizes = rows.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min_by("embedding", "pos").alias("embedding"))
    entries = cut(sizes.join(lists, "class").select(F.col("members")[0].alias("rep"), "class", "embedding", "members", "n"))
    total = entries.count()
    if total == 0:
        return entries.select(F.col("rep").alias("pos"), F.col("rep").alias("neighbour"), F.lit(1).alias("rank"), F.lit(0.0).alias("sim"))

    sample = entries.select("rep", "embedding").orderBy(F.xxhash64("rep"), "rep").limit(TRAINING_ROWS).toArrow()
    x = _unit(_matrix(sample["embedding"], dim)[1])
    c = int(max(1, min(most_centroids, len(x) // 4 or 1, 2 ** round(math.log2(max(1.0, math.sqrt(total / 3)))))))
    half = dim // 2
    first, second = kmeans(x[:, :half], c), kmeans(x[:, half:], c)
    groups = max(1, min(c, round(total / 8192)))
    group_of = _distances(first, kmeans(first, groups)).argmin(axis=1)  # near centroids are searched in one task
    sc = vectors.sparkSession.sparkContext
    book = sc.broadcast((first, second, group_of))  # most_centroids bounds it

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, _ = book.value
        for b in batches:
            u = _unit(_matrix(b.column(0), dim)[1])
            at = _distances(u[:, :half], one).argmin(axis=1) * len(two) + _distances(u[:, half:], two).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32))], ["cell"])

    # at most most_centroids ** 2 rows
    counted = spread(entries.select("embedding")).mapInArrow(quantise, "cell int").groupBy("cell").count().toArrow()
    counts = np.zeros(c * c, np.int64)
    counts[counted["cell"].to_numpy()] = counted["count"].to_numpy()
    filled = sc.broadcast(counts)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, group = book.value
        held = filled.value.tolist()
        for b in batches:
            u = _unit(_matrix(b.column(1), dim)[1])
            da, db = _distances(u[:, :half], one), _distances(u[:, half:], two)
            cell = da.argmin(axis=1) * len(two) + db.argmin(axis=1)
            visits = []
            for r in range(len(u)):
                by: dict[int, list[int]] = {}
                for v in cells_in_order(da[r], db[r], held, candidates):
                    by.setdefault(int(group[v // len(two)]), []).append(v)
                visits.append([{"g": g, "cells": vs} for g, vs in by.items()])
            kind = pa.list_(pa.struct([("g", pa.int32()), ("cells", pa.list_(pa.int32()))]))
            g = pa.array(group[cell // len(two)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), g, pa.array(cell.astype(np.int32)), pa.array(visits, kind)], ["rep", "embedding", "members", "g", "cell", "visits"])

    kinds = "rep long, embedding array<float>, members array<long>, g int, cell int, visits array<struct<g: int, cells: array<int>>>"
    index = cut(spread(entries.select("rep", "embedding", "members")).mapInArrow(visit, kinds))
    in_group = {r["g"]: r["n"] for r in index.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    asked = {r["g"]: r["n"] for r in index.select(F.explode("visits.g").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    eb, qb = _blocks(in_group, groups), _blocks(asked, groups)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = index.select("g", F.pmod(F.xxhash64("rep"), eb).cast("int").alias("e"), every(qb).alias("q"), "rep", "embedding", "members", "cell")
    right = index.select("rep", "embedding", F.explode("visits").alias("v")).select(F.col("v.g").alias("g"), "rep", "embedding", F.col("v.cells").alias("cells"))
    right = right.select("g", every(eb).alias("e"), F.pmod(F.xxhash64("rep"), qb).cast("int").alias("q"), "rep", "embedding", "cells")
    ranked = left.groupBy("g", "e", "q").cogroup(right.groupBy("g", "e", "q")).applyInArrow(lambda a, b: _rank(a, b, dim, k), "rep long, sim double, pos long")
    own = index.select("rep", F.lit(1.0).alias("sim"), F.explode("members").alias("pos"))
    best = Window.partitionBy("rep").orderBy(F.desc("sim"), "pos")
    top = ranked.unionByName(own).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    tops = top.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("minus"), "pos"))).alias("top"))
    # members of small classes are all in the list of members; those of large ones are joined, salted
    large = entries.where(F.col("n") > k + 1).select("rep", "class")
    salts = 32
    many = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = rows.select("class", "pos", F.pmod(F.xxhash64("pos"), F.lit(salts)).cast("int").alias("salt")).join(many, ["class", "salt"]).select("pos", "rep", "salt").distinct()
    salted = tops.join(large.select("rep"), "rep", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    few = tops.join(entries.where(F.col("n") <= k + 1).select("rep", "members"), "rep").select(F.explode("members").alias("pos"), "top")
    each = few.unionByName(joined.join(salted, ["rep", "salt"]).select("pos", "top"))
    others = F.slice(F.filter("top", lambda t: t["pos"] != F.col("pos")), 1, k)
    return each.select("pos", F.posexplode(others).alias("i", "t")).select("pos", F.col("t.pos").alias("neighbour"), (F.col("i") + 1).alias("rank"), (-F.col("t.minus")).alias("sim"))


def neighbour_pairs(neighbours: DataFrame) -> DataFrame:
    """(pos_a, pos_b), pos_a < pos_b, of vectors of which one is a neighbour of the other."""
    return neighbours.select(F.least("pos", "neighbour").alias("pos_a"), F.greatest("pos", "neighbour").alias("pos_b")).distinct()
