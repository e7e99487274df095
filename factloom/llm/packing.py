"""Filling fixed-capacity containers with documents by sum-of-squares packing.

Only ids and sizes move. Documents are split over tasks by a hash of the id; each task packs its own. What stays open
is packed again as items of one size each, in ever fewer tasks, so that the loss at the borders of tasks goes away.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.tokens import TOKENIZER, token_counts
from factloom.session import cut

CAPACITY = 2048
#: Items that one task packs; a task holds some 40 bytes for each.
ITEMS_PER_TASK = 100_000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container of each item, used room of each container). Items of 1 to capacity are placed largest first.

    Each goes where the sum over the gaps of the squared number of open containers of that gap becomes smallest; of
    equals, into the smallest gap. Of containers of one gap the one opened first is taken.
    """
    count = np.zeros(capacity + 1, np.int64)  # open containers by gap; neither full nor untouched ones count
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    used: list[int] = []
    where = np.zeros(len(sizes), np.int64)
    big = np.int64(1) << 60
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        after, before = count[: capacity - s + 1], count[s:]
        change = np.where(before > 0, after - before + 1, big)
        if change[0] != big:
            change[0] = -before[0]
        change[capacity - s] = after[capacity - s]  # a new container
        gap = int(change.argmin()) + s
        if gap == capacity:
            b = len(used)
            used.append(0)
        else:
            b = heapq.heappop(open_by_gap[gap])
            count[gap] -= 1
        used[b] += s
        where[i] = b
        if gap > s:
            heapq.heappush(open_by_gap[gap - s], b)
            count[gap - s] += 1
    return where, np.array(used, np.int64)


def _pack(rows: DataFrame, capacity: int, groups: int, level: int) -> DataFrame:
    """rows (item, size) -> (item, size, bin, used)."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "item"], ascending=[False, True], kind="stable")
        where, used = sum_of_squares(pdf["size"].to_numpy(), capacity)
        name = f"{level}-{int(pdf['part'].iloc[0])}-"
        return pd.DataFrame({"item": pdf["item"].to_numpy(), "size": pdf["size"].to_numpy(), "bin": [f"{name}{b}" for b in where], "used": used[where]})

    part = F.pmod(F.xxhash64("item"), F.lit(groups))
    return rows.withColumn("part", part).groupBy("part").applyInPandas(pack, "item string, size long, bin string, used long")


def fill_containers(sizes: DataFrame, capacity: int = CAPACITY, items_per_task: int = ITEMS_PER_TASK, slack: float = 0.02) -> DataFrame:
    """Pack rows (doc_id, tokens) -> (container, doc_id, piece, first_token, tokens).

    A document of 1 to capacity tokens is one piece. A larger one is split into as few pieces as possible: full ones and
    a rest. Null and empty documents get no container; repeated rows of one id are further pieces, each placed; an empty
    table gives no rows. Containers with more free room than slack * capacity after one round are packed again.
    """
    n = F.col("tokens")
    pieces = sizes.where("tokens > 0").select("doc_id", F.posexplode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / capacity) * capacity, F.lit(capacity).cast("long"))).alias("piece", "first_token"), n)
    pieces = pieces.withColumn("tokens", F.least(F.lit(capacity), F.col("tokens") - F.col("first_token")))
    twin = F.monotonically_increasing_id()  # tells repeated rows apart; kept by the checkpoint
    pieces = cut(pieces.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("piece").cast("string"), twin.cast("string")).alias("item"), "doc_id", "piece", "first_token", F.col("tokens").alias("size")))
    todo = pieces.count()
    groups = max(1, -(-todo // items_per_task))
    full = F.col("size") == capacity
    placed = cut(_pack(pieces.where(~full).select("item", "size"), capacity, groups, 0))
    final = placed.select("item", "bin")
    level = 0
    while groups > 1:
        level += 1
        left = placed.where(F.col("used") < capacity * (1 - slack)).groupBy("bin").agg(F.max("used").alias("size")).select(F.col("bin").alias("item"), "size")
        left = cut(left)
        groups = min(groups // 2, -(-left.count() // items_per_task))
        if groups < 1:
            break
        placed = cut(_pack(left, capacity, groups, level))
        moved = placed.select(F.col("item").alias("bin"), F.col("bin").alias("next"))
        final = final.join(moved, "bin", "left").select("item", F.coalesce("next", "bin").alias("bin"))
    final = final.unionByName(pieces.where(full).select("item", F.concat(F.lit("full-"), "item").alias("bin")))
    return final.join(pieces, "item").select(F.col("bin").alias("container"), "doc_id", "piece", "first_token", F.col("size").alias("tokens"))


def document_containers(documents: DataFrame, capacity: int = CAPACITY, path: str = TOKENIZER, items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """fill_containers() for the texts of documents, measured in tokens of a public tokenizer."""
    return fill_containers(token_counts(documents, path), capacity, items_per_task)
