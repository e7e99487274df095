"""Encoding of a corpus with a public byte-level BPE vocabulary.

Two tiers: a minimal perfect hash answers for whole pre-tokens that are in the vocabulary; all others are merged
with a heap over linked bytes. The hash and the vocabulary are broadcast; their size is that of the vocabulary.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text before merging; fixed by the public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_MASK = (1 << 64) - 1


def _hash(key: bytes) -> int:
    return int.from_bytes(blake2b(key, digest_size=8).digest(), "little")


def _slot(h: int, d: int, n: int) -> int:
    x = (h ^ (d * 0x9E3779B97F4A7C15)) & _MASK
    x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & _MASK
    return (x ^ (x >> 32)) % n


class PerfectHash:
    """Minimal perfect hash from a fixed set of byte strings to numbers: buckets, each with a displacement.

    A bucket of one key holds its slot itself, as -slot - 1. A key outside the set is told apart by comparing bytes.
    """

    def __init__(self, values: dict[bytes, int]):
        n = self.n = len(values)
        self.buckets = max(1, n // 3)
        self.seeds = np.zeros(self.buckets, np.int64)
        self.keys: list[bytes | None] = [None] * n
        self.values = np.zeros(n, np.int64)
        by: list[list[tuple[int, bytes]]] = [[] for _ in range(self.buckets)]
        for k in values:
            h = _hash(k)
            by[h % self.buckets].append((h, k))
        order = sorted(range(self.buckets), key=lambda b: -len(by[b]))
        free = None
        for b in order:
            if not by[b]:
                break
            if len(by[b]) == 1:
                if free is None:
                    free = iter([i for i, k in enumerate(self.keys) if k is None])
                slots, self.seeds[b] = [next(free)], 0
                self.seeds[b] = -slots[0] - 1
            else:
                d = 0
                while True:
                    slots = [_slot(h, d, n) for h, _ in by[b]]
                    if len(set(slots)) == len(slots) and all(self.keys[s] is None for s in slots):
                        break
                    d += 1
                self.seeds[b] = d
            for s, (_, k) in zip(slots, by[b]):
                self.keys[s] = k
                self.values[s] = values[k]

    def get(self, key: bytes) -> int:
        """The number of a key, or -1."""
        if not self.n:
            return -1
        h = _hash(key)
        d = int(self.seeds[h % self.buckets])
        s = -d - 1 if d < 0 else _slot(h, d, self.n)
        return int(self.values[s]) if self.keys[s] == key else -1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_bytes(piece: bytes, rank) -> list[int]:
    """Ids of a pre-token: repeatedly merge the leftmost pair of lowest rank, in a heap over a linked list of parts."""
    n = len(piece)
    end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (r := rank(piece[i : end[j]])) >= 0:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue  # a neighbour has changed since
        alive[j] = False
        end[i] = stop
        if stop < n:
            prev[stop] = i
        offer(i)
        if prev[i] >= 0:
            offer(prev[i])
    out, i = [], 0
    while i < n:
        out.append(rank(piece[i : end[i]]))
        i = end[i]
    return out


class Encoder(dict):
    """Pre-token -> ids; a dict that fills itself and is emptied when it holds too many of them."""

    def __init__(self, table: PerfectHash, most: int = 400_000):
        super().__init__()
        import regex

        self.table, self.most, self.split = table, most, regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> tuple[int, ...]:
        b = piece.encode("utf-8", "surrogatepass")
        i = self.table.get(b)
        ids = (i,) if i >= 0 else tuple(merge_bytes(b, self.table.get))
        if len(self) >= self.most:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for p in self.split(text or ""):
            out += self[p]
        return out


_ENCODERS: dict[str, Encoder] = {}
_TABLES: dict[str, PerfectHash] = {}


def perfect_hash(path: str) -> PerfectHash:
    if path not in _TABLES:
        _TABLES[path] = PerfectHash(load_ranks(path))
    return _TABLES[path]


def shared_encoder(spark: SparkSession, path: str):
    """A function without arguments that gives a worker's encoder; the hash travels as a broadcast."""
    sent = spark.sparkContext.broadcast(perfect_hash(path))

    def get() -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(sent.value)
        return _ENCODERS[path]

    return get


def token_ids(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, ids) of every document, without special tokens; their strings are ordinary text.

    Null, empty: an empty list. Blank text is encoded like any other. Repeated rows each give a row; an empty table
    gives none; columns other than doc_id and text play no role.
    """
    get = shared_encoder(documents.sparkSession, path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = get()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                c = b.slice(at, 512)
                flat: list[int] = []
                ends = [0]
                for t in c.column(1).to_pylist():
                    if t:
                        for p in encoder.split(t):
                            flat += encoder[p]
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([c.column(0), ids], ["doc_id", "ids"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(rows).mapInArrow(encode, "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of every document; 0 for null and empty texts."""
    get = shared_encoder(documents.sparkSession, path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = get()
        for b in batches:
            n = [sum(len(encoder[p]) for p in encoder.split(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "tokens"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(rows).mapInArrow(count, "doc_id long, tokens long")
