"""Canonical facts and the graph that they make."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import NULL_LIKE, blank, clean_entity, name_key, normalize_ws
from factloom.session import cut


#: Fixed words that a keyword search passes over.
KEYWORD_STOP = ("what", "which", "show", "give", "about", "from", "with", "this", "that", "the")
#: So many links between near names are settled on the driver.
MOST_LOCAL = 100_000


def token_hits(nodes: DataFrame, q: DataFrame) -> DataFrame:
    """(nodes' columns, low, qid, q, overlap): nodes (id, ...) that share a token with a question (qid, q, toks) or one of which holds the other.

    overlap: how many tokens, repeated ones too, stand in the node, inside a longer word as well. The stated set of questions is
    broadcast and every node is compared with it in one pass.
    """
    # a number of partitions that isn't merged by size: the work is in the comparisons, not in the bytes
    low = nodes.repartition(2 * nodes.sparkSession.sparkContext.defaultParallelism, "id").withColumn("low", F.lower("id"))
    has = F.exists("toks", lambda t: F.col("low").contains(t)) | F.col("q").contains(F.col("low")) | F.col("low").contains(F.col("q"))
    found = low.join(F.broadcast(q.select("qid", "q", "toks")), has)
    return found.withColumn("overlap", F.size(F.filter("toks", lambda t: F.col("low").contains(t))).cast("long")).drop("toks")


def aliases_exact(facts: DataFrame) -> DataFrame:
    """(key, rep): of each entity key the spelling that comes first, by seq, the subject before the object. Names without a key keep their own."""
    both = facts.select(F.explode(F.array(*(F.struct(clean_entity(F.col(c)).alias("name"), F.col("seq"), F.lit(i).alias("place")) for i, c in enumerate(("subject", "object"))))).alias("e"))
    both = both.select("e.*").where("name != ''").withColumn("key", name_key(F.col("name")))
    return both.where("key != ''").groupBy("key").agg(F.min_by("name", F.struct("seq", "place")).alias("rep"))


def indel_ratio(a: str, b: str) -> float:
    """200 * longest common subsequence / both lengths."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    s = (1 << len(a)) - 1
    mask = s
    for c in b:  # bit-parallel: a zero for each character of a common subsequence
        u = s & where.get(c, 0)
        s = (s + u | s - u) & mask
    return 200 * (len(a) - s.bit_count()) / max(1, len(a) + len(b))


class _Texts:
    """Texts of one length, for comparisons in numpy: characters, counts of hashed bigrams, and where each character stands, in bits."""

    def __init__(self, texts: list[str]):
        self.n = len(texts[0])
        self.codes = np.array([[ord(c) for c in s] for s in texts], np.int64).reshape(len(texts), self.n)

    def grams(self, size: int) -> np.ndarray:
        """Each bigram (edges included) with the number of its occurrence is counted in one of `size` columns."""
        g = np.pad(self.codes + 1, ((0, 0), (1, 1)))
        g = np.sort(g[:, :-1] * 0x110001 + g[:, 1:], axis=1)
        at = np.arange(g.shape[1])
        nth = at - np.maximum.accumulate(np.where(np.diff(g, axis=1, prepend=-1) != 0, at, 0), axis=1)
        columns = (((g + nth * 0x9E3779B1) * 2654435761 & 0xFFFFFFFFFFFF) >> 15) % size
        return np.bincount((np.arange(len(g))[:, None] * size + columns).ravel(), minlength=len(g) * size).reshape(len(g), size).astype(np.float32)

    def places(self, alphabet: np.ndarray) -> np.ndarray:
        """(words of 64 bits, text, character of the alphabet): a bit for each place of the text at which it stands."""
        bits = np.zeros(((self.n + 63) // 64, len(self.codes), len(alphabet) + 1), np.uint64)
        index, rows = np.searchsorted(alphabet, self.codes), np.arange(len(self.codes))
        for p in range(self.n):
            bits[p // 64, rows, index[:, p]] |= np.uint64(1 << p % 64)
        return bits


def _common(places: np.ndarray, a: np.ndarray, codes: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The longest common subsequence of each pair of texts a[i], b[i], by bits as in indel_ratio, for all pairs at a time."""
    state = [np.full(len(a), ~np.uint64(0)) for _ in places]
    for j in range(codes.shape[1]):
        c, carry = codes[b, j], None
        for w, bits in enumerate(places):
            s = state[w]
            u = s & bits[a, c]
            t = s + u
            over = t < s
            if carry is not None:
                t2 = t + carry
                over |= t2 < t
                t = t2
            state[w], carry = t | (s - u), over.astype(np.uint64)
    return sum(np.bitwise_count(~s).astype(np.int64) for s in state)


def similar_texts(a: list[str], b: list[str], threshold: int, at_once: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, indel ratio) of the pairs a[i], b[j] with a ratio >= threshold. The texts of a have one length and those of b have one.

    Of texts within d edits with l characters in common at least l + 1 - d bigrams agree; a product of matrices counts these for all
    pairs, a bit more where hashes meet, and the pairs that it leaves are compared character by character.
    """
    x, y = _Texts(a), _Texts(b)
    both = x.n + y.n
    d = int((100 - threshold) / 100 * both + 1e-9)
    d -= (both - d) % 2
    if d < abs(x.n - y.n):
        return
    least = (both - d) // 2 + 1 - d
    size = 128 if both < 62 else 256 if both < 120 else 512
    alphabet = np.unique(x.codes)
    places, codes = x.places(alphabet), np.searchsorted(alphabet, y.codes)
    codes[alphabet[np.minimum(codes, len(alphabet) - 1)] != y.codes] = len(alphabet)  # characters that no text of a has
    left, right, step = x.grams(size), y.grams(size).T.copy(), max(1, at_once // len(b))
    for start in range(0, len(a), step):
        near = np.flatnonzero(left[start : start + step] @ right >= least)
        for k in range(0, len(near), 200_000):
            i, j = np.divmod(near[k : k + 200_000], len(b))
            i += start
            score = 200 * _common(places, i, codes, j) / both
            kept = np.floor(score) >= threshold
            yield i[kept], j[kept], score[kept]


def similar_keys(keys: DataFrame, threshold: int = 92, most_in_block: int = 4000, chars_in_block: int = 400_000) -> DataFrame:
    """(id, other, score) of all pairs of keys with token_sort_ratio >= threshold, once each, the other one earlier. keys: (key, id, at), normalised.

    Exact. Short keys, whose ratio allows for one edit at most, meet in an equi-join on what is left without one of their characters.
    Longer ones are put into blocks of one length and bounded size, and blocks whose lengths allow for the ratio are compared with
    each other, so no common part of many keys brings all of them together and no task holds more than two blocks.
    """
    loss = (100 - threshold) / 100
    edits = lambda both: F.floor(F.lit(loss) * both + 1e-9)
    n = F.col("n")
    rows = keys.select("key", "id", "at", F.array_join(F.array_sort(F.split("key", " ")), " ").alias("s")).withColumn("n", F.length("s"))
    rows = cut(rows.where("n > 0").select("id", "at", "s", "n"))

    cuts = F.when(edits(2 * n - 1) == 1, F.expr("array_distinct(transform(sequence(1, n), i -> concat(left(s, i - 1), substr(s, i + 1))))"))
    whole = rows.where(edits(2 * n) < 2).select(F.col("s").alias("text"), F.col("id").alias("i"), F.col("at").alias("i_at"), F.col("n").alias("i_n"))
    less = rows.where(edits(2 * n - 1) < 2).select(F.explode(F.concat(F.when(edits(2 * n) < 2, F.array("s")).otherwise(F.array().cast("array<string>")), F.coalesce(cuts, F.array().cast("array<string>")))).alias("text"), F.col("id").alias("j"), F.col("at").alias("j_at"), F.col("n").alias("j_n"))
    short = whole.join(less, "text").where("(i_n < j_n OR i < j) AND i_at != j_at")
    later = F.col("i_at") > F.col("j_at")
    score = 200 * F.col("i_n") / (F.col("i_n") + F.col("j_n"))
    short = short.where(F.floor(score) >= threshold).select(F.when(later, F.col("i")).otherwise(F.col("j")).alias("id"), F.when(later, F.col("j")).otherwise(F.col("i")).alias("other"), score.alias("score"))

    room = F.greatest(F.lit(1), F.least(F.lit(most_in_block), F.floor(F.lit(chars_in_block) / n)))
    blocks = rows.groupBy("n").agg(F.count(F.lit(1)).alias("size")).select("n", F.ceil(F.col("size") / room).cast("int").alias("parts"))
    rows = rows.join(blocks, "n").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    blocks = cut(blocks.select("n", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))
    other = blocks.select(F.col("n").alias("m"), F.col("part").alias("q"))
    most = edits(F.col("n") + F.col("m"))
    met = cut(blocks.join(other, (F.col("m") >= n) & (most >= F.col("m") - n) & (most >= 2) & ((F.col("m") > n) | (F.col("q") >= F.col("part")))))
    group = ("n", "part", "m", "q")
    # a number of partitions that isn't merged by size: the work is in the comparisons, not in the bytes
    count = max(4 * keys.sparkSession.sparkContext.defaultParallelism, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    a = rows.join(met, ["n", "part"]).select(*group, "id", "at", "s").repartition(count, *group)
    mine = rows.select(F.col("n").alias("m"), F.col("part").alias("q"), F.col("id").alias("other"), F.col("at").alias("other_at"), F.col("s").alias("other_s"))
    b = mine.join(met, ["m", "q"]).select(*(F.col(c).alias(f"b_{c}") for c in group), "other", "other_at", "other_s").repartition(count, *(f"b_{c}" for c in group))

    def near(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and len(y):
            same = x["n"].iloc[0] == x["m"].iloc[0] and x["part"].iloc[0] == x["q"].iloc[0]
            ids, at, other_ids, other_at = (v.to_numpy() for v in (x["id"], x["at"], y["other"], y["other_at"]))
            for i, j, score in similar_texts(x["s"].tolist(), y["other_s"].tolist(), threshold):
                kept = (ids[i] < other_ids[j]) & (at[i] != other_at[j]) if same else at[i] != other_at[j]
                i, j, score = i[kept], j[kept], score[kept]
                later = at[i] > other_at[j]
                out.append(pd.DataFrame({"id": np.where(later, ids[i], other_ids[j]), "other": np.where(later, other_ids[j], ids[i]), "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "other": [], "score": []})

    pairs = a.groupBy(*group).cogroup(b.groupBy(*(f"b_{c}" for c in group))).applyInPandas(near, "id long, other long, score double")
    return short.unionByName(pairs)


def representatives(links: DataFrame, most_local: int = MOST_LOCAL) -> DataFrame:
    """(other): the ids in links (id, other) to earlier ids that are representatives, as an id is that has no link to one.

    A fold, computed in rounds: an earlier id without open links is one; an id with a link to one is none, and its links are closed. Every round
    settles at least the first open id of each cluster, so the rounds end; at most most_local links are settled on the driver.
    """
    others = links.select("other").distinct()
    links = cut(links.select("id", "other"))
    beaten = links.select("id").limit(0)
    while links.count() > most_local:
        new = cut(links.select("other").distinct().join(links.select(F.col("id").alias("other")).distinct(), "other", "left_anti"))
        none = cut(links.join(new, "other", "left_semi").select("id").distinct())
        links = cut(links.join(new, "other", "left_anti").join(none, "id", "left_anti").join(none.select(F.col("id").alias("other")), "other", "left_anti"))
        beaten = cut(beaten.union(none))
    rest = {(r["id"], r["other"]) for r in links.collect()}
    lost: set[int] = set()
    while rest:
        new = {y for _, y in rest} - {x for x, _ in rest}
        none = {x for x, y in rest if y in new}
        rest = {(x, y) for x, y in rest if y not in new and x not in none and y not in none}
        lost |= none
    beaten = beaten.union(links.sparkSession.createDataFrame([(x,) for x in lost], "id long"))
    return others.join(beaten.select(F.col("id").alias("other")), "other", "left_anti")


def aliases_fuzzy(facts: DataFrame, threshold: int = 92) -> DataFrame:
    """(key, rep): keys in order of arrival join the most similar earlier representative of ratio >= threshold, else are one themselves."""
    first = facts.select(F.explode(F.array(*(F.struct(clean_entity(F.col(c)).alias("name"), (F.col("seq") * 2 + i).alias("at")) for i, c in enumerate(("subject", "object"))))).alias("e"))
    first = first.select("e.*").where("name != ''").withColumn("key", name_key(F.col("name"))).where("key != ''").groupBy("key").agg(F.min_by("name", "at").alias("rep"), F.min("at").alias("at"))
    first = cut(first.withColumn("id", F.monotonically_increasing_id()))
    links = cut(similar_keys(first, threshold))
    reps = representatives(links).join(first.select(F.col("id").alias("other"), F.col("rep").alias("other_rep"), F.col("at").alias("other_at")), "other")
    best = links.join(reps, "other").groupBy("id").agg(F.max_by("other_rep", F.struct("score", -F.col("other_at"))).alias("other_rep"))
    return first.join(best, "id", "left").select("key", F.coalesce("other_rep", "rep").alias("rep"))


def canonical_facts(facts: DataFrame, aliases: DataFrame | None = None, most_refs: int = 8) -> DataFrame:
    """Facts with canonical names, one for each key: the first row's texts, up to most_refs distinct references, mean confidence.

    A missing or NaN confidence counts as 0. References are reduced to distinct ones before they are gathered, so
    a key with any number of copies gives one bounded row.
    """
    aliases = aliases_exact(facts) if aliases is None else aliases
    texts = ("subject", "predicate", "object", "value", "unit", "timeframe", "source_ref")
    f = facts.select(
        "seq", clean_entity(F.col("subject")).alias("s0"), normalize_ws(F.col("predicate")).alias("predicate"), clean_entity(F.col("object")).alias("o0"),
        *(normalize_ws(F.col(c)).alias(c) for c in ("value", "unit", "timeframe", "source_ref")), F.coalesce(F.nanvl("confidence", F.lit(0.0)), F.lit(0.0)).alias("confidence"),
    )
    f = cut(f.withColumn("k1", name_key(F.col("s0"))).withColumn("k2", name_key(F.col("o0")))).where("s0 != '' AND predicate != '' AND o0 != ''")  # filtered after the cut, so that names are cleaned once
    f = f.where(~F.lower("s0").isin(*NULL_LIKE) & ~F.lower("o0").isin(*NULL_LIKE)).withColumn("predicate", F.btrim("predicate", F.lit(" ,;:")))  # "unknown;" is null too
    a = aliases.select(F.col("key").alias("k1"), F.col("rep").alias("subject"))
    b = aliases.select(F.col("key").alias("k2"), F.col("rep").alias("object"))
    f = f.join(a, "k1", "left").join(b, "k2", "left").withColumn("subject", F.coalesce("subject", "s0")).withColumn("object", F.coalesce("object", "o0"))
    key = [name_key(F.col("subject")), F.lower("predicate"), name_key(F.col("object")), F.lower("timeframe"), F.lower("value"), F.lower("unit")]
    f = f.select("seq", *texts, "confidence", F.lower("source_ref").alias("r"), F.xxhash64(*key).alias("h1"), F.xxhash64(F.lit("second"), *reversed(key)).alias("h2"))  # 128 bits stand for the key
    by_ref = f.groupBy("h1", "h2", "r").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("total"), F.min(F.struct("seq", *texts)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("h1", "h2").orderBy((F.col("r") == "").cast("int"), "first.seq"))
    by_ref = by_ref.withColumn("nth", nth)
    refs = F.collect_list(F.when((F.col("nth") <= most_refs) & (F.col("r") != ""), F.struct("nth", F.col("first.source_ref").alias("ref"))))
    out = by_ref.groupBy("h1", "h2").agg(F.min("first").alias("first"), refs.alias("refs"), (F.sum("total") / F.sum("n")).alias("confidence"))
    joined = F.array_join(F.transform(F.array_sort("refs"), lambda x: x["ref"]), ", ")
    return out.select("first.seq", *(F.col(f"first.{c}").alias(c) for c in texts[:-1]), joined.alias("source_ref"), "confidence")


def edges(facts: DataFrame) -> DataFrame:
    """Edges (seq, src, dst, label, value, unit, timeframe, source_ref, confidence); parallel edges stay."""
    src, dst, label = clean_entity(F.col("subject")), clean_entity(F.col("object")), normalize_ws(F.col("predicate"))
    return facts.select("seq", src.alias("src"), dst.alias("dst"), label.alias("label"), "value", "unit", "timeframe", "source_ref", "confidence").where("src != '' AND dst != '' AND label != ''")


def entity_frequencies(facts: DataFrame) -> DataFrame:
    """(entity, frequency) over subjects and objects; an edge from a node to itself counts twice."""
    names = facts.select(F.explode(F.array(clean_entity(F.col("subject")), clean_entity(F.col("object")))).alias("entity"))
    return names.where("entity != ''").groupBy("entity").agg(F.count(F.lit(1)).alias("frequency"))


def node_degrees(e: DataFrame) -> DataFrame:
    """(id, degree, size, shade): degree with the size and shade that a drawing gives the node."""
    ends = e.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    most = ends.agg(F.greatest(F.lit(1), F.max("degree")).alias("most"))
    size = (F.lit(14) + F.floor(26 * F.col("degree") / F.col("most"))).cast("long")
    return ends.crossJoin(F.broadcast(most)).select("id", "degree", size.alias("size"), F.when(F.col("degree") >= 10, "hub").when(F.col("degree") >= 4, "mid").otherwise("leaf").alias("shade"))


def neighbours(e: DataFrame, seeds: DataFrame, most: int = 120) -> DataFrame:
    """(qid, rank, line): edges out of and into the seeds (qid, id, rank), distinct, in order of seed, out before in, seq.

    seeds is a stated set of at most 12 nodes for each question; hubs are cut to `most` edges while they are ranked.
    """
    s = F.broadcast(seeds.where(F.col("rank") <= 12).select("qid", "id", F.col("rank").alias("seed_rank")))
    out = e.join(s, F.col("src") == F.col("id")).withColumn("side", F.lit(0))
    inn = e.join(s, F.col("dst") == F.col("id")).withColumn("side", F.lit(1))
    hits = out.unionByName(inn).groupBy("qid", "src", "label", "dst").agg(F.min(F.struct("seed_rank", "side", "seq", F.coalesce("source_ref", F.lit("")).alias("ref"))).alias("at"))
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("at", "src", "label", "dst"))).where(F.col("rank") <= most)
    return hits.select("qid", "rank", F.trim(F.concat("src", F.lit(" -["), "label", F.lit("]-> "), "dst", F.lit(" "), normalize_ws(F.col("at.ref")))).alias("line"))


def keyword_nodes(degrees: DataFrame, asked: DataFrame, most: int = 18) -> DataFrame:
    """(qid, id, score, rank): 4 if the node holds the question, 0.9 for each token in it to 3, 0.03 for each edge to 1.2. Repeated tokens count again."""
    q = asked.select("qid", F.lower(F.trim(blank(F.col("question")))).alias("q")).where("q != ''")
    q = q.withColumn("toks", F.filter(F.regexp_extract_all("q", F.lit("[a-z0-9]{2,}"), 0), lambda t: ~t.isin(*KEYWORD_STOP)))
    pairs = token_hits(degrees.select("id", "degree"), q)
    score = F.when(F.col("low").contains(F.col("q")), 4.0).otherwise(0.0) + F.least(F.lit(3.0), F.col("overlap") * F.lit(0.9))
    pairs = pairs.where(score > 0).withColumn("score", F.round(score + F.least(F.lit(1.2), F.col("degree") * F.lit(0.03)), 6))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return pairs.select("qid", "id", "score").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
