"""Queries do the whole job: their results hold what a smaller limit would drop."""

import numpy as np

from factloom import queries as core
from factloom.operators import index


def test_think_split_keeps_whole_texts(spark, tmp_path):
    long = "first line\n\n" + "word " * 30 + "\n  last <b>line</b>"
    rows = [(0, long), (1, long), (2, "said " * 20 + "<THINK>deep\nthought</think> end"), (3, None), (4, "\n" + long + "\n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["thinking"], r["answer"]) for r in core.queries()["think_split"](spark, str(tmp_path)).collect()}
    assert got == {0: (long, "Answer 0"), 1: (long, "Answer 1"), 2: ("deep\nthought", "said " * 20 + " end"), 3: ("", "Answer 3"), 4: (long, "Answer 4")}


def test_contexts_keep_what_the_limits_of_the_reference_allow(spark, tmp_path):
    text = "\n".join(f"line {i} " + "x" * 60 for i in range(18))
    words = "word " * 1000  # 1,330 tokens a line
    spark.createDataFrame([("retrieval", "s", "a", text), ("retrieval", "t", "b", words), ("retrieval", "t", "c", words), ("retrieval", "t", "d", words), ("retrieval", "t", "e", words)], "track string, source_id string, chunk_id string, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([(i, c) for i, c in enumerate("abcde")], "pos long, chunk_id string").write.parquet(f"{tmp_path}/index_vectors.parquet")
    spark.createDataFrame([("s", "T"), ("t", None)], "source_id string, title string").write.parquet(f"{tmp_path}/source_list.parquet")
    spark.createDataFrame([], "seq long, subject string, predicate string, object string, value string, unit string, timeframe string, source_ref string, confidence double, source_id string").write.parquet(f"{tmp_path}/facts.parquet")
    slim = {r["chunk_id"]: r["slim"] for r in core.queries()["slim_contexts"](spark, str(tmp_path)).collect()}
    assert slim["a"] == text and slim["b"] == words[:1800]
    packed = core.queries()["packed_contexts"](spark, str(tmp_path)).where("qid = 't'").collect()
    assert sorted(r["used"] for r in packed) == [7, 1337, 2667, 3997, 4003]  # two headers; the fourth line would be 5,327


def test_every_twentieth_vector_is_a_query(spark, tmp_path):
    v = np.random.default_rng(1).normal(size=(61, 8)).astype("float32")
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    e.write.parquet(f"{tmp_path}/embeddings.parquet")
    w = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    want = {q: np.argsort(-(w @ w[q]))[:16].tolist() for q in (0, 20, 40, 60)}
    got = {}
    for r in core.queries()["dense_top"](spark, str(tmp_path)).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["pos"])
    assert got == want
    assert {r["qid"] for r in core.queries()["diverse_choice"](spark, str(tmp_path)).collect()} == set(want)
    e = e.withColumnRenamed("vec_id", "pos")
    q = e.where("pos % 20 = 0").selectExpr("pos AS qid", "embedding AS query")
    blocks = index.top(index.dense_top(q, e, 16, most=7), 16).orderBy("qid", "rank").collect()
    assert [r["pos"] for r in blocks] == sum(want.values(), [])
