"""Tries, Levenshtein automata that walk them, and the join of words within a bounded distance that both give."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import cut

#: A trie holds so many words at most; larger ones are split at their upper levels. A task asks for so many words of one trie.
WORDS_PER_TRIE = 20_000
ASKED_PER_TASK = 12_000
#: Tries are split by prefixes up to this length.
DEEPEST = 16


class Automata:
    """Levenshtein automata (adjacent swaps count once) of one bound; their states and steps are shared by all words.

    A state is a set of (characters of the word read, edits, swap begun), relative to the least number of characters read. A
    step depends on where the next character stands in the next 2 * bound + 4 characters of the word, on where it may stand for two of
    them, and on how many are left of the word and of its first half, where there may be bound // 2 edits at most if it counts.
    """

    def __init__(self, bound: int):
        self.bound, self.window = bound, 2 * bound + 4
        self.states: list[tuple] = [((0, 0, 0),)]
        self.ids = {self.states[0]: 0}
        self.steps: dict[int, tuple[int, int]] = {}

    def walk(self, root: dict, word: str, half: int = 0, fold: dict[str, str] | None = None, pairs: dict[str, str] | None = None, reach: bool = False) -> list[tuple[str, int]]:
        """(word of the trie, distance) of all within the bound, with at most bound // 2 edits in the first half.

        fold: the characters that one of the word may stand for at no cost; pairs: those that two of it may stand for. With
        reach, what the trie holds are beginnings, and all that may go on to a word within the bound are given.
        """
        n, window, bound, steps = len(word), self.window, self.bound, self.steps
        where: dict[str, int] = {}
        twice: dict[str, int] = {}
        for i, c in enumerate(word):
            where[c] = where.get(c, 0) | 1 << i
            if fold:
                for x in fold.get(c, ""):
                    where[x] = where.get(x, 0) | 1 << i
        if pairs:
            for i in range(n - 1):
                for x in pairs.get(word[i : i + 2], ""):
                    twice[x] = twice.get(x, 0) | 1 << i
        mask = (1 << window) - 1
        out, todo = [], [(root, 0, 0)]
        while todo:
            node, at, state = todo.pop()
            left = n - at if n - at < window else window
            first = half - at
            first = 0 if first < 0 else first if first < window else window
            base = ((state * 16 + left) * 16 + first) << 2 * window
            for c, child in node.items():
                if c == "":
                    d = 0 if reach else min((e + n - at - i for i, e, t in self.states[state] if not t), default=bound + 1)
                    if d <= bound:
                        out.append((child, d))
                    continue
                key = base | (where.get(c, 0) >> at & mask) << window | (twice[c] >> at & mask if c in twice else 0)
                step = steps.get(key)
                if step is None:
                    step = steps[key] = self._step(state, key >> window & mask, key & mask, left, first)
                if step[1] >= 0:
                    todo.append((child, at + step[0], step[1]))
        return out

    def _step(self, state: int, seen: int, two: int, left: int, first: int) -> tuple[int, int]:
        """(characters that the state moves on, next state); -1 if none."""
        out: dict[tuple[int, int], int] = {}

        def add(i: int, e: int, t: int = 0) -> None:
            if e <= self.bound and i <= left and e < out.get((i, t), self.bound + 1) and (i >= first or e <= self.bound // 2):
                out[i, t] = e

        for i, e, t in self.states[state]:
            if t:
                if seen >> i & 1:
                    add(i + 2, e)
                continue
            if i < left and seen >> i & 1:
                add(i + 1, e)
            if i + 1 < left and two >> i & 1:
                add(i + 2, e)
            add(i, e + 1)
            if i < left:
                add(i + 1, e + 1)
            for d in range(1, self.bound - e + 1):
                if i + d < left and seen >> (i + d) & 1:
                    add(i + d + 1, e + d)
                if i + d + 1 < left and two >> (i + d) & 1:
                    add(i + d + 2, e + d)
            if i + 1 < left and seen >> (i + 1) & 1:
                add(i, e + 1, 1)
        # a position that another one reaches as cheaply is left out, but not across the middle
        kept = [(i, e, t) for (i, t), e in out.items() if t or not any(f + abs(i - j) <= e and (j, f) != (i, e) and (j >= first or i < first) for (j, u), f in out.items() if not u)]
        if not kept:
            return 0, -1
        base = min(i for i, _, _ in kept)
        new = tuple(sorted((i - base, e, t) for i, e, t in kept))
        if new not in self.ids:
            self.ids[new] = len(self.states)
            self.states.append(new)
        return base, self.ids[new]


_AUTOMATA: dict[int, Automata] = {}


def automata(bound: int) -> Automata:
    return _AUTOMATA.setdefault(bound, Automata(bound))


def trie_of(words: Iterator[str]) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = w
    return root


class Trie:
    """Words forwards and backwards: of two edits at most one is in the first half of a word, or in the second."""

    def __init__(self, words: list[str], fold: dict[str, str] | None = None, pairs: dict[str, str] | None = None):
        self.fold, self.pairs = fold, pairs
        self.back_pairs = {k[::-1]: v for k, v in (pairs or {}).items()}
        self.root = trie_of(words)
        self.back: dict = {}
        for w in words:
            node = self.back
            for c in reversed(w):
                node = node.setdefault(c, {})
            node[""] = w

    def near(self, word: str, bound: int) -> list[tuple[str, int]]:
        """(word, distance) of all words within the bound."""
        walk = automata(bound).walk
        if bound < 2:
            return walk(self.root, word, 0, self.fold, self.pairs)
        half = len(word) // 2
        found = dict(walk(self.root, word, half, self.fold, self.pairs))
        for w, d in walk(self.back, word[::-1], len(word) - half, self.fold, self.back_pairs):
            found[w] = min(d, found.get(w, d))
        return list(found.items())


def _shard(root: dict, word: str) -> str:
    """The beginning in a trie of beginnings under which a word is kept."""
    node, found = root, root.get("", "")
    for c in word:
        node = node.get(c)
        if node is None:
            return found
        found = node.get("", found)
    return found


def trie_join(words: DataFrame, asked: DataFrame, fold: dict[str, str] | None = None, pairs: dict[str, str] | None = None, words_per_trie: int = WORDS_PER_TRIE, asked_per_task: int = ASKED_PER_TASK) -> DataFrame:
    """(key, form, word, distance): of every asked form (key, form, bound) the words (key, word) within its bound of edits.

    fold, pairs: see Automata.walk. Words of one key form a trie, which is split at its upper levels where it is large; a
    form's automaton walks these first and the form goes only to the parts that it can reach, in tasks of a bounded number of
    forms. So neither a large vocabulary nor a large number of forms meets in one task, nor does each part meet each form.
    """
    sizes = words.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > words_per_trie).select("key")  # at most words / words_per_trie keys
    beginnings = words.join(F.broadcast(large), "key").select("key", F.explode(F.transform(F.sequence(F.lit(0), F.least(F.length("word"), F.lit(DEEPEST))), lambda k: F.substring("word", 1, k))).alias("start"))
    beginnings = beginnings.groupBy("key", "start").agg(F.count(F.lit(1)).alias("n"))
    crowded = beginnings.where(F.col("n") > words_per_trie).select("key", F.col("start").alias("parent"))
    # the children of crowded beginnings, whose number is bounded by words / words_per_trie times the depth
    split = beginnings.withColumn("parent", F.when(F.length("start") > 0, F.expr("left(start, length(start) - 1)"))).join(F.broadcast(crowded), ["key", "parent"], "left_semi")
    starts: dict[str, list[str]] = {}
    for r in split.select("key", "start").collect():
        starts.setdefault(r["key"], [""]).append(r["start"])
    upper = words.sparkSession.sparkContext.broadcast({k: trie_of(v) for k, v in starts.items()})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tries = upper.value
        for pdf in batches:
            yield pdf.assign(shard=[_shard(tries[k], w) if k in tries else "" for k, w in zip(pdf["key"], pdf["word"])])

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tries = upper.value
        for pdf in batches:
            out = []
            for k, f, b in zip(pdf["key"], pdf["form"], pdf["bound"]):
                shards = {s for s, _ in automata(b).walk(tries[k], f, 0, fold, pairs, True)} if k in tries else ("",)
                out += [(k, f, b, s) for s in shards]
            yield pd.DataFrame(out, columns=["key", "form", "bound", "shard"])

    kept, sent = words.select("key", "word"), asked.select("key", "form", F.col("bound").cast("int").alias("bound"))
    if starts:
        kept, sent = kept.mapInPandas(place, "key string, word string, shard string"), sent.mapInPandas(route, "key string, form string, bound int, shard string")
    else:
        kept, sent = kept.withColumn("shard", F.lit("")), sent.withColumn("shard", F.lit(""))
    sent = cut(sent)
    tasks = sent.groupBy("key", "shard").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / asked_per_task)).cast("int").alias("tasks"))
    tasks = cut(tasks)
    kept = kept.join(tasks, ["key", "shard"]).withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    sent = sent.join(tasks, ["key", "shard"]).withColumn("task", F.pmod(F.xxhash64("form"), F.col("tasks")).cast("int"))

    def near(w: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(w) and len(a):
            trie, k = Trie(w["word"].tolist(), fold, pairs), a["key"].iloc[0]
            for f, b in zip(a["form"], a["bound"]):
                out += [(k, f, x, d) for x, d in trie.near(f, b)]
        return pd.DataFrame(out, columns=["key", "form", "word", "distance"])

    keys = ("key", "shard", "task")
    # a number of partitions that isn't merged by size: the work is in the walks, not in the bytes
    parts = max(2 * words.sparkSession.sparkContext.defaultParallelism, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kept, sent = kept.select(*keys, "word").repartition(parts, *keys), sent.select(*keys, "form", "bound").repartition(parts, *keys)
    return kept.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(near, "key string, form string, word string, distance int")
