"""Abusive, hateful or sexual content, by non-negative positive-unlabelled learning.

One linear classifier of hashed word features for each category is fitted in numpy: telling sentences of confirmed documents
are positive, and the sentences of a sample of all documents are unlabelled, whatever their review says. The class prior is
estimated from how often features of the positive sentences occur in the unlabelled ones, not from the number of labels, since
reviewed documents hold more of such content than others do; the risk of the unlabelled is corrected by the prior and kept
from going below zero. A document's score is that of its worst sentence.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import spread

CATEGORIES = ("abusive", "hateful", "sexual")
#: At most so many reviewed documents are used for fitting, those of the smallest hash of doc_id.
MOST_REVIEWED = 8_000
#: The unlabelled sentences are those of at most so many documents, of the smallest seeded hash of doc_id among all documents with a text.
MOST_UNLABELLED = 4_000
BITS = 18
#: The threshold where too few documents are confirmed to choose one.
DEFAULT = 0.2

_INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_](?:[ .\-_*·]{1,2})){2,}[^\W\d_](?![^\W_])")
_WORD = re.compile(r"[^\W_](?:[\w@$!*'’]*[^\W_])?[$@]?|[$@][\w@$!*]+")
_SENTENCE = re.compile(r"\n+|(?<=[.!?])[\"”')]*\s+")
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_RUN = re.compile(r"(.)\1+")


#: Words and pairs that were met, with their features; emptied when full.
_MOST_KEPT = 500_000
_MASK = (1 << BITS) - 1
_plain: dict[str, str] = {}
_own: dict[str, tuple[int, ...]] = {}
_pair: dict[tuple[str, str], int] = {}


def _kept(cache: dict, key, value):
    if len(cache) >= _MOST_KEPT:
        cache.clear()
    cache[key] = value
    return value


def _word(w: str) -> str:
    """A word in lower case without disguise; empty if nothing is left."""
    if "*" in w:
        if w.count("*") >= 2:
            return f"~{w[0]}{len(w)}{w[-1]}"
        w = w.replace("*", "")
    if any(c.isdigit() or c in "@$!" for c in w):
        if not any(c.isalpha() for c in w):
            return "#"
        w = w.translate(_LEET)
    return _RUN.sub(r"\1", w.replace("'", "").replace("’", ""))


def plain_words(sentence: str) -> list[str]:
    """Words in lower case without disguise: invisible characters, spaced letters, digits for letters, repeated letters.

    A masked word (b*****d) becomes ~ with its first letter, length and last letter.
    """
    s = sentence if sentence.isascii() else _INVISIBLE.sub("", sentence).replace("\xa0", " ")
    s = _SPACED.sub(lambda m: re.sub(r"[ .\-_*·]", "", m[0]), s).lower()
    return [_plain.get(w) or _kept(_plain, w, _word(w)) for w in _WORD.findall(s)]


def sentences(text: str | None) -> list[str]:
    return [s for s in _SENTENCE.split(text or "") if s and not s.isspace()]


def _own_features(w: str) -> tuple[int, ...]:
    if w[:1] == "~":
        return zlib.crc32(b"masked") & _MASK, zlib.crc32(("s" + w).encode()) & _MASK
    if len(w) > 3:
        return zlib.crc32(w.encode()) & _MASK, zlib.crc32(("s~" + w[0] + str(len(w)) + w[-1]).encode()) & _MASK
    return (zlib.crc32(w.encode()) & _MASK,)


def features(words: list[str]) -> list[int]:
    """Hashed words, pairs of neighbours, and word shapes that a masked word shares with the word itself."""
    out: list[int] = []
    before = "^"
    for w in words:
        out += _own.get(w) or _kept(_own, w, _own_features(w))
        p = _pair.get((before, w))
        out.append(_kept(_pair, (before, w), zlib.crc32(f"{before} {w}".encode()) & _MASK) if p is None else p)
        before = w
    out.append(zlib.crc32(f"{before} $".encode()) & _MASK)
    return list(set(out))


class Rows:
    """Sparse rows of 0 and 1, scaled to length 1."""

    def __init__(self, rows: list[list[int]], least: int = 2):
        n = np.array([len(r) for r in rows], np.int64)
        flat = np.fromiter((i for r in rows for i in r), np.int64, int(n.sum()))
        self.row = np.repeat(np.arange(len(rows)), n)
        self.names, at = np.unique(flat, return_inverse=True)
        common = np.bincount(at, minlength=len(self.names)) >= least  # a feature that only one row has tells nothing
        keep = common[at]
        self.names, self.flat, self.row = self.names[common], (np.cumsum(common) - 1)[at[keep]], self.row[keep]
        self.value = 1 / np.sqrt(np.maximum(n, 1))[self.row]
        self.n = len(rows)
        self.starts = np.searchsorted(self.row, np.arange(self.n + 1))

    def part(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features, values, rows counted from 0) of some rows."""
        n = self.starts[rows + 1] - self.starts[rows]
        at = np.repeat(self.starts[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return self.flat[at], self.value[at], np.repeat(np.arange(len(rows)), n)

    def scores(self, w: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """(rows, categories)."""
        return np.stack([np.bincount(self.row, weights=w[self.flat, k] * self.value, minlength=self.n) for k in range(w.shape[1])], 1) + bias


def fit_nnpu(x: Rows, positive: np.ndarray, unlabelled: np.ndarray, prior: np.ndarray, epochs: int = 25, batches: int = 8, rate: float = 0.08, decay: float = 1e-6, clamp: bool = True, seed: int = 5) -> tuple[np.ndarray, np.ndarray, int]:
    """(weights, biases, times that the clamp acted) by Adam for the risk prior * R_p+ + max(0, R_u- - prior * R_p-), logistic loss.

    positive (rows, categories), unlabelled (rows): weights of the rows in either sample (0: not in it). Every step takes
    all positive rows and a part of the unlabelled; where their corrected risk is below zero, the step goes back along its gradient. The
    categories are fitted together.
    """
    cats = positive.shape[1]
    w, bias = np.zeros((len(x.names), cats)), np.full(cats, -2.0)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros(cats), np.zeros(cats)
    p = positive / np.maximum(positive.sum(0), 1e-12)
    pos, free = np.flatnonzero((positive > 0).any(1)), np.flatnonzero(unlabelled > 0)
    rng = np.random.default_rng(seed)
    t = acted = 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(free), max(1, min(batches, len(free)))):
            t += 1
            rows = np.concatenate([pos, part])
            u = np.concatenate([np.zeros(len(pos)), unlabelled[part] / max(unlabelled[part].sum(), 1e-12)])[:, None]
            pp = np.concatenate([p[pos], np.zeros((len(part), cats))])
            f, val, at = x.part(rows)
            s = np.stack([np.bincount(at, weights=w[f, k] * val, minlength=len(rows)) for k in range(cats)], 1) + bias
            q = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
            loss = np.logaddexp(0, s)
            gn = u * q - prior * pp * q
            below = ((u * loss).sum(0) < prior * (pp * loss).sum(0)) & (positive.sum(0) > 0) if clamp else np.zeros(cats, bool)
            acted += int(below.sum())
            g = np.where(below, -gn, prior * pp * (q - 1) + gn)
            d = np.stack([np.bincount(f, weights=g[at, k] * val, minlength=len(x.names)) for k in range(cats)], 1) + decay * w
            db = g.sum(0)
            m, v = 0.9 * m + 0.1 * d, 0.999 * v + 0.001 * d * d
            mb, vb = 0.9 * mb + 0.1 * db, 0.999 * vb + 0.001 * db * db
            a, b = 1 - 0.9**t, 1 - 0.999**t
            w -= rate * (m / a) / (np.sqrt(v / b) + 1e-8)
            bias -= rate * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    return w, bias, acted


def class_prior(x: Rows, positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The estimated share of positives among the unlabelled rows, 0.5 at most.

    A share p of the positives has a feature, so at least prior * p of the unlabelled have it: the prior is at most the ratio of
    both shares, and the least ratio is taken. Features of few positives are held down by a standard error of their count.
    """
    n, m = positive.sum(), max(unlabelled.sum(), 1.0)
    with_p = np.bincount(x.flat, weights=positive[x.row], minlength=len(x.names))
    with_u = np.bincount(x.flat, weights=unlabelled[x.row], minlength=len(x.names))
    sure = with_p - np.sqrt(with_p)
    told = sure > 0
    return float(min(0.5, ((with_u[told] + 1) / m / (sure[told] / n)).min(initial=0.5)))


@lru_cache(maxsize=MOST_REVIEWED + MOST_UNLABELLED)
def _read(text: str) -> tuple[list[int], list[set[str]]]:
    """(features, words) of each sentence of a text."""
    found = [plain_words(s) for s in sentences(text)]
    return [features(w) for w in found], [{"~" if x[:1] == "~" else x for x in w} for w in found]


class Model:
    """A linear classifier for each category; scores are chances from 0 to 1."""

    def __init__(self, weights: np.ndarray, biases: np.ndarray):
        self.weights, self.biases = weights.astype(np.float32), biases

    @classmethod
    def fit(cls, texts: list[str], labels: list[str], unlabelled: list[str], rounds: int = 2, telling: float = 0.3) -> Model:
        """Of a confirmed document the sentences that the last round scores highest are the positive examples.

        An example has a telling word: of the documents with that word, a share of `telling` at least are confirmed. A document without
        one has a wrong label and gives no example. Sentences of reviewed documents without such content help to choose the
        examples; the classifiers are fitted on the examples and the sentences of the unlabelled texts only.
        """
        rows, doc, plain = [], [], []
        for i, t in enumerate(texts):
            found, words = _read(t)
            rows += found
            plain += words
            doc += [i] * len(found)
        documents_with: dict[str, Counter] = {c: Counter() for c in (*CATEGORIES, "none")}
        for i in range(len(texts)):
            documents_with[labels[i]].update(set().union(*plain[bisect_left(doc, i) : bisect_right(doc, i)]))
        doc_of = np.array(doc, np.int64)
        label_of = np.array(labels, object)[doc_of] if len(doc) else np.array([], object)
        # a sentence that reviewed documents without such content share is no witness
        clean = Counter(f for r, none in zip(rows, label_of == "none") if none for f in r)
        novelty = np.array([sum(1 / (1 + clean[f]) for f in r) / max(len(r), 1) if none else 0.0 for r, none in zip(rows, label_of != "none")])
        keep = np.flatnonzero(label_of != "none")
        confirmed, doc_of, label_of, novelty = [rows[i] for i in keep], doc_of[keep], label_of[keep], novelty[keep]
        plain = [plain[i] for i in keep]
        every = np.zeros((len(CATEGORIES), 1 << BITS))
        biases = np.full(len(CATEGORIES), -5.0)
        if not confirmed:
            return cls(every, biases)
        others_rows = [r for t in unlabelled for r in _read(t)[0]]
        x, n = Rows(confirmed + others_rows), len(confirmed)
        free = np.concatenate([np.zeros(n), np.ones(len(others_rows))])
        of = np.zeros((n, len(CATEGORIES)), bool)
        for k, c in enumerate(CATEGORIES):
            mine, others = documents_with[c], documents_with["none"]
            of[:, k] = [o and any(mine[w] >= telling * (mine[w] + others[w]) for w in p) for o, p in zip(label_of == c, plain)]
        score = np.repeat(novelty[:, None], len(CATEGORIES), 1)
        for r in range(rounds):
            weight = np.zeros((x.n, len(CATEGORIES)))
            for k in range(len(CATEGORIES)):
                mine = of[:, k]
                best = np.full(len(texts), -np.inf)
                np.maximum.at(best, doc_of[mine], score[mine, k])
                witness = mine & (score[:, k] >= best[doc_of] - 1e-9)
                if r and (witness & (score[:, k] > -2.5)).any():
                    witness &= score[:, k] > -2.5  # a wrong label has no sentence like those of other confirmed documents
                weight[:n, k] = witness / np.maximum(np.bincount(doc_of[witness], minlength=len(texts)), 1)[doc_of]
            prior = np.array([class_prior(x, weight[:, k], free) if weight[:, k].any() else 0.0 for k in range(len(CATEGORIES))])
            w, fitted, _ = fit_nnpu(x, weight, free, prior)
            score = x.scores(w, fitted)[:n]
        told = of.any(0)
        every[:, x.names] = np.where(told, w, 0.0).T
        return cls(every, np.where(told, fitted, biases))

    @classmethod
    def calibrated(cls, texts: list[str], labels: list[str], unlabelled: list[str], default: float, least: int = 50) -> tuple[Model, float]:
        """(model, threshold): chances of a rare class are small, and how small depends on the prior and the examples.

        A model of three quarters of the reviewed documents scores the others; the threshold is in the middle of the gap, in log odds,
        above which the F measure of its findings against the labels (precision counts double) is best. With fewer than `least` confirmed ones there it is the default.
        """
        held = [zlib.crc32(t.encode()) % 4 == 0 for t in texts]
        confirmed = [x != "none" for h, x in zip(held, labels) if h]
        threshold = default
        if sum(confirmed) >= least:
            part = cls.fit([t for h, t in zip(held, texts) if not h], [x for h, x in zip(held, labels) if not h], unlabelled)
            score = part.score([t for h, t in zip(held, texts) if h]).max(axis=1)
            order = np.argsort(-score, kind="stable")
            hits = np.cumsum(np.array(confirmed)[order])
            f = 1.25 * hits / (np.arange(1, len(hits) + 1) + 0.25 * sum(confirmed))
            z = np.log(np.clip(score[order], 1e-9, 1 - 1e-9) / np.clip(1 - score[order], 1e-9, 1))
            f[:-1][z[:-1] == z[1:]] = 0  # equal scores stay together
            best = int(f.argmax())
            middle = (z[best] + (z[best + 1] if best + 1 < len(z) else z[best])) / 2
            threshold = float(1 / (1 + np.exp(-middle)))
        return cls.fit(texts, labels, unlabelled), threshold

    def score(self, texts: list[str | None]) -> np.ndarray:
        """(texts, categories): of each text the highest chance of a sentence; 0 for null and blank texts."""
        out = np.zeros((len(texts), len(CATEGORIES)))
        flat: list[int] = []
        sizes, doc = [], []
        for i, t in enumerate(texts):
            for s in sentences(t):
                f = features(plain_words(s))
                flat += f
                sizes.append(len(f))
                doc.append(i)
            if len(flat) > 2_000_000 or (i == len(texts) - 1 and sizes):
                n = np.array(sizes)
                z = np.add.reduceat(self.weights[:, flat], np.cumsum(n) - n, axis=1) / np.sqrt(n) + self.biases[:, None]
                np.maximum.at(out, np.array(doc), 1 / (1 + np.exp(-np.clip(z.T, -30, 30))))
                flat, sizes, doc = [], [], []
        return out


def review_scores(documents: DataFrame, labels: DataFrame, threshold: float | None = None, most_reviewed: int = MOST_REVIEWED, most_unlabelled: int = MOST_UNLABELLED) -> DataFrame:
    """(doc_id, source, abusive, hateful, sexual, category) of every document: a score from 0 to 1 for each category, and
    the category of the highest score if that reaches the threshold, else null. A threshold of None is chosen by held-out labels, DEFAULT
    where there are too few.

    labels: (doc_id, label) of reviewed documents; "none" and unknown labels are no examples. The classifiers are fitted on the
    driver on the confirmed of at most most_reviewed of these, and on at most most_unlabelled of all documents, taken
    whatever their label; every document is scored over its whole text. Null and blank
    texts score 0; without a confirmed example nothing is found; repeated rows each give a row; an empty table gives none.
    """
    reviewed = labels.select("doc_id", F.lower(F.trim("label")).alias("label")).dropna().dropDuplicates(["doc_id"])
    texts = documents.select("doc_id", "text").where("text IS NOT NULL")
    sample = texts.join(reviewed, "doc_id").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_reviewed).collect()
    known = [r["label"] if r["label"] in CATEGORIES else "none" for r in sample]
    other = [r["text"] for r in texts.orderBy(F.xxhash64("doc_id", F.lit("unlabelled")), "doc_id").limit(most_unlabelled).collect()]
    fitted, chosen = Model.calibrated([r["text"] for r in sample], known, other, DEFAULT)
    threshold = chosen if threshold is None else threshold
    model = documents.sparkSession.sparkContext.broadcast(fitted)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for pdf in batches:
            found = m.score(pdf["text"].tolist())
            best = found.argmax(axis=1)
            out = pdf[["doc_id", "source"]].assign(**{c: found[:, i] for i, c in enumerate(CATEGORIES)})
            out["category"] = [CATEGORIES[b] if found[i, b] >= threshold else None for i, b in enumerate(best)]
            yield out

    rows = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")))
    return rows.mapInPandas(score, "doc_id long, source string, abusive double, hateful double, sexual double, category string")


def source_rates(scores: DataFrame) -> DataFrame:
    """(source, documents, found, rate) of every source, of null as well."""
    return scores.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count("category").alias("found")).withColumn("rate", F.round(F.col("found") / F.col("documents"), 6))
