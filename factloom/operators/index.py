"""Retrieval index: postings with BM25, tags, and dense vectors."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.text import METRIC_HINTS, blank, index_tokens

K1, B, EPSILON = 1.5, 0.75, 0.25


def postings(chunks: DataFrame) -> DataFrame:
    """(term, pos, tf, dl) of chunks (pos, text). Terms are counted within each row first, so a chunk's words aren't shuffled one by one."""
    rows = chunks.select("pos", index_tokens(F.col("text")).alias("toks")).withColumn("dl", F.size("toks"))
    return rows.select("pos", "dl", F.explode("toks").alias("term")).groupBy("term", "pos").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def bm25_stats(chunks: DataFrame, post: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((n, avgdl) in one row, (term, df, idf)): idf = ln(n - df + .5) - ln(df + .5); a negative one becomes 0.25 times the mean."""
    size = chunks.select(F.size(index_tokens(F.col("text"))).alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.crossJoin(F.broadcast(size)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + F.lit(0.5)))
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, F.lit(EPSILON) * F.col("mean")).otherwise(F.col("raw"))
    return size, raw.crossJoin(F.broadcast(mean)).select("term", "df", idf.alias("idf"))


def bm25_of_postings(asked: DataFrame, post: DataFrame, idf: DataFrame, size: DataFrame) -> DataFrame:
    """(qid, pos, score) of the chunks that share a term with a question (qid, question); repeated words count again.

    Only postings of the questions' terms take part: the stated set of questions is broadcast and filters them first.
    """
    terms = asked.select("qid", F.explode(index_tokens(F.col("question"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))
    terms = F.broadcast(terms.join(F.broadcast(idf.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")), "term"))
    hits = post.join(terms, "term").crossJoin(F.broadcast(size))  # size is one row
    tf = F.col("tf").cast("double")
    part = F.col("times") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("qid", "pos").agg(F.sum(part).alias("score"))


def bm25_scores(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """bm25_of_postings of chunks that aren't indexed."""
    post = postings(chunks)
    size, idf = bm25_stats(chunks, post)
    return bm25_of_postings(asked, post, idf, size)


def metric_tags(chunks: DataFrame) -> DataFrame:
    """(key, pos): metric words of each chunk, once."""
    words = F.array_distinct(F.filter(index_tokens(F.col("text")), lambda t: t.isin(*METRIC_HINTS)))
    return chunks.select(F.explode(words).alias("key"), "pos")


def entity_tags(chunks: DataFrame) -> DataFrame:
    """(key, pos, times): capitalised words of each chunk, in lower case, with how often they occur."""
    words = F.regexp_extract_all(blank(F.col("text")), F.lit(r"\b[A-Z][A-Za-z0-9&\.\-]{2,}\b"), 0)
    return chunks.select(F.explode(words).alias("word"), "pos").groupBy(F.lower("word").alias("key"), "pos").agg(F.count(F.lit(1)).alias("times"))


def cosine(a: Column, b: Column) -> Column:
    """dot / (|a| * (|b| + 1e-8) + 1e-8) in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * (F.sqrt(dot(b, b)) + 1e-8) + 1e-8)


def dense_scores(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(qid, pos, score): a stated set of query vectors (qid, query) against all (pos, embedding) of the same length, broadcast."""
    rows = vectors.join(F.broadcast(queries), F.size("embedding") == F.size("query"))
    return rows.select("qid", "pos", cosine(F.col("embedding"), F.col("query")).alias("score"))


def dense_top(queries: DataFrame, vectors: DataFrame, n: int, digits: int | None = None, most: int = 2048) -> DataFrame:
    """(qid, pos, score) that hold the n best of every query, for any number of queries (qid, query): all are compared with all
    (pos, embedding) of the same length, each pair of blocks of about `most` rows by a matrix product that keeps the n best.

    Equal scores, after rounding to so many digits, go to the smaller position. Vectors hold no nulls.
    """
    a, b = queries.where("query IS NOT NULL"), vectors.where("embedding IS NOT NULL")
    na, nb = (max(1, -(-df.count() // most)) for df in (a, b))
    block = lambda k, of: F.pmod(F.xxhash64(k), F.lit(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    a = a.select("qid", "query", F.size("query").alias("dim"), block("qid", na).alias("qb"), each(nb).alias("vb"))
    b = b.select("pos", "embedding", F.size("embedding").alias("dim"), block("pos", nb).alias("vb"), each(na).alias("qb"))

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"qid": [], "pos": [], "score": []})
        p, q = np.stack(y["embedding"].to_numpy()).astype(float), np.stack(x["query"].to_numpy()).astype(float)
        score = (p @ q.T / (np.linalg.norm(p, axis=1)[:, None] * (np.linalg.norm(q, axis=1) + 1e-8) + 1e-8)).T
        key = score if digits is None else np.floor(score * 10**digits + 0.5)
        pos = y["pos"].to_numpy()
        best = np.stack([np.lexsort((pos, -k))[:n] for k in key])
        return pd.DataFrame({"qid": np.repeat(x["qid"].to_numpy(), best.shape[1]), "pos": pos[best].ravel(), "score": np.take_along_axis(score, best, 1).ravel()})

    keys = ["dim", "qb", "vb"]
    kind = queries.schema["qid"].dataType.simpleString()
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(compare, f"qid {kind}, pos long, score double")


def top(scores: DataFrame, n: int, by: tuple[str, ...] = ("pos",)) -> DataFrame:
    """The n best rows of each question with their rank; of equal scores the smaller position comes first."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), *by)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def hashed_vectors(texts: DataFrame, text: str, dim: int = 64) -> DataFrame:
    """Adds embedding: counts of hashed words with a hashed sign. Stands in where no encoder is handed in, at the same place."""

    def encode(toks: pd.Series) -> pd.Series:
        out = np.zeros((len(toks), dim), np.float32)
        for row, words in zip(out, toks):
            for w in words if words is not None else ():
                h = zlib.crc32(w.encode())
                row[h % dim] += 1.0 if h >> 16 & 1 else -1.0
        return pd.Series(list(out))

    return texts.withColumn("embedding", F.pandas_udf(encode, "array<float>")(index_tokens(F.col(text))))


@dataclass
class Index:
    """A built index: chunks (pos, chunk_id, source_id, text), postings, terms (term, df, idf), size (n, avgdl), tags (kind, key, pos), vectors."""

    chunks: DataFrame
    postings: DataFrame
    terms: DataFrame
    size: DataFrame
    tags: DataFrame
    vectors: DataFrame

    PARTS = ("chunks", "postings", "terms", "size", "tags", "vectors")
    BUCKETS = 16

    @classmethod
    def build(cls, chunks: DataFrame, path: str, encode: Callable[[DataFrame], DataFrame] | None = None) -> Index:
        """Writes the tables of an index of chunks (pos, chunk_id, source_id, text) to a shared folder and reads them back.

        Postings are sorted by term within buckets of its hash, so a question reads a few row groups of them. encode adds
        the column embedding; the hashed words stand in for it.
        """
        spark = chunks.sparkSession
        chunks.write.mode("overwrite").parquet(f"{path}/chunks")
        kept = spark.read.parquet(f"{path}/chunks")
        bucket = F.pmod(F.xxhash64("term"), F.lit(cls.BUCKETS)).cast("int")
        postings(kept).withColumn("bucket", bucket).repartition(cls.BUCKETS, "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").parquet(f"{path}/postings")
        post = spark.read.parquet(f"{path}/postings")
        # the length of every chunk stands in its postings; a chunk without terms has none
        lengths = kept.select("pos").join(post.groupBy("pos").agg(F.first("dl").alias("dl")), "pos", "left")
        lengths.agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("dl", F.lit(0))).alias("avgdl")).write.mode("overwrite").parquet(f"{path}/size")
        size = spark.read.parquet(f"{path}/size")
        df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(size))
        df.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + F.lit(0.5))).select("term", "df", "raw").write.mode("overwrite").parquet(f"{path}/terms")
        tags = metric_tags(kept).select(F.lit("metric").alias("kind"), "key", "pos").unionByName(entity_tags(kept).select(F.lit("entity").alias("kind"), "key", "pos"))
        tags.repartition(cls.BUCKETS, "key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{path}/tags")
        vectors = encode(kept) if encode else hashed_vectors(kept, "text")
        vectors.select("pos", "embedding").write.mode("overwrite").parquet(f"{path}/vectors")
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        parts = {p: spark.read.parquet(f"{path}/{p}") for p in cls.PARTS}
        mean = parts["terms"].agg(F.avg("raw").alias("mean"))
        idf = F.when(F.col("raw") < 0, F.lit(EPSILON) * F.col("mean")).otherwise(F.col("raw"))
        parts["terms"] = parts["terms"].crossJoin(F.broadcast(mean)).select("term", "df", idf.alias("idf"))
        return cls(**parts)

    def bm25(self, asked: DataFrame) -> DataFrame:
        return bm25_of_postings(asked, self.postings, self.terms, self.size)
