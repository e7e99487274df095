"""The queries of the core library. Each reads its tables whole; the SQL beside them is in oracle.py."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom import oracle
from factloom.functions import text as T
from factloom.functions.jsonish import artifacts_udf, facts_udf, is_chartable
from factloom.operators import chunking, evals, graph, grounding, index, models, retrieval
from factloom.operators import facts as rules
from factloom.operators.units import convert_quantities, thousandths
from factloom.plans import questions as plans
from factloom.session import cut, shared_dir, table
from factloom.sources import web, workspace
from factloom.streaming import build

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, sql in oracle.SQL.items() if k in _QUERIES}


def _n(x: Column) -> Column:
    return x.cast("long")


def _r(x) -> Column:
    return F.round(x, 6)


def _text(xs: Column) -> Column:
    return F.array_join(xs, "|")


# --- inputs


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select(F.coalesce("source", F.lit("")).alias("source_id"), F.col("doc_id").alias("page"), "text")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks once each, though some are delivered twice."""
    c = table(spark, d, "chunks").where("text IS NOT NULL")
    return c.groupBy("chunk_id").agg(F.min("track").alias("track"), F.min("source_id").alias("source_id"), F.min("text").alias("text"))


def retrieval_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).join(table(spark, d, "index_vectors").select("pos", "chunk_id"), "chunk_id").select("pos", "chunk_id", "source_id", "text")


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Sample questions and some about the facts of each source, cut from the scan: they are a stated set of bounded size."""
    return cut(plans.questions(table(spark, d, "facts")))


_INDEXES: dict[tuple[str, str], index.Index] = {}


def built_index(spark: SparkSession, d: str) -> index.Index:
    """The index of the retrieval chunks, built once in an application in the shared folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        _INDEXES[key] = index.Index.build(retrieval_chunks(spark, d), path)
    return _INDEXES[key]


def edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(table(spark, d, "facts"))


def degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.node_degrees(edges(spark, d))


def seeds(spark: SparkSession, d: str) -> DataFrame:
    return plans.entity_hits(questions(spark, d), _nodes(spark, d))


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers made of facts: what a fact says with its reference, and every seventh with a wrong one or none."""
    f = table(spark, d, "facts")
    ref = F.when(F.col("seq") % 7 == 0, "[Chunk zz-1]").when(F.col("seq") % 11 == 0, "").when(F.col("seq") % 13 == 0, "[Graph]").otherwise(T.blank(F.col("source_ref")))
    return f.select("seq", F.concat(T.blank(F.col("object")), F.lit(" "), ref).alias("answer"), F.array("chunk_id").alias("valid"))


# --- scans


@query
def scan_counts(spark: SparkSession, d: str) -> DataFrame:
    names = ("documents", "chunks", "facts", "extract_cache", "index_vectors", "source_list", "events", "orders")
    parts = [table(spark, d, n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows")) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def scan_page_profiles(spark: SparkSession, d: str) -> DataFrame:
    return web.page_profiles(pages(spark, d))


@query
def json_lines_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    folder = f"{shared_dir(spark).removeprefix('file://')}/lines-{uuid.uuid4().hex}"
    workspace.write_json_lines(table(spark, d, "facts").select("seq", "subject", "predicate", "object", "value", "unit", "timeframe", "source_ref", "source_id", "chunk_id"), folder)
    return workspace.read_json_lines(spark, folder, workspace.FACT).select("seq", "subject", "predicate", "object", "source_id")


@query
def graph_json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    back = workspace.read_graph_json(workspace.graph_json(edges(spark, d)))
    return back.groupBy("src", "label", "dst").agg(F.count(F.lit(1)).alias("edges"))


@query
def urls_normalized(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "source_list")
    raw = F.concat(F.when(F.col("kind") == "web", "https://www.").otherwise(""), "kind", F.lit(".example.com/"), F.replace(F.lower(T.blank(F.col("title"))), F.lit(" "), F.lit("-")), F.lit("#top"))
    return s.select("source_id", T.normalize_url(raw).alias("url"), T.url_graph_name(raw).alias("name"))


@query
def url_lists(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "source_list")
    text = F.concat(F.col("kind"), F.lit(".example.com/a\n\nHTTPS://"), F.col("kind"), F.lit(".example.com/A#x\nhttps://"), F.col("kind"), F.lit(".example.com/a"))
    return web.url_list(s.select(F.col("source_id").alias("id"), text.alias("text"))).select("id", _n(F.col("n")).alias("n"), "url")


def _html(spark: SparkSession, d: str) -> DataFrame:
    t = F.replace(F.replace(T.blank(F.col("text")), F.lit("<"), F.lit(" ")), F.lit("\n"), F.lit("</p><p>"))
    html = F.concat(F.lit("<html><head><title>"), T.blank(F.col("title")), F.lit("</title><style>p {margin: 0}</style></head><body><nav>menu</nav><h1>"), T.blank(F.col("title")), F.lit("</h1><p>"), t, F.lit("</p><img src='/chart.png' alt='chart' width='640' height='480'><img src='logo.svg'></body></html>"))
    return documents(spark, d).select(F.col("doc_id").cast("string").alias("url"), html.alias("html"))


@query
def html_plain_text(spark: SparkSession, d: str) -> DataFrame:
    return _html(spark, d).select("url", web.plain_text(F.col("html")).alias("plain"))


@query
def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    return web.html_blocks(_html(spark, d))


@query
def html_segments(spark: SparkSession, d: str) -> DataFrame:
    return web.text_segments(web.html_blocks(_html(spark, d)))


@query
def html_images(spark: SparkSession, d: str) -> DataFrame:
    return web.image_candidates(_html(spark, d))


@query
def image_scores(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "source_list").withColumn("src", F.concat(F.col("kind"), F.when(F.col("trust") == 1, "/logo.svg").when(F.col("trust") == 2, "/chart.png").otherwise("/photo.jpg")))
    return s.select("source_id", T.image_score(F.col("src"), F.col("title"), (F.col("trust") * 90).cast("string"), F.lit("200")).alias("score"))


# --- text


@query
def text_normalized(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", T.normalize_ws(F.col("text")).alias("plain"), _n(T.approx_tokens(F.col("text"))).alias("tokens"))


@query
def text_tokens(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", _text(T.index_tokens(F.col("text"))).alias("index_tokens"), _text(T.query_tokens(F.col("text"))).alias("query_tokens"))


@query
def heading_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return rows.where(T.looks_like_heading(F.col("line"))).select("doc_id", _n(F.col("n")).alias("n"), T.normalize_ws(F.col("line")).alias("title"))


@query
def graph_names(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    return table(spark, d, "source_list").select("source_id", T.graph_name(t).alias("name"), T.slug(t).alias("slug"), T.ellipsize(t, 20).alias("short"))


@query
def disk_sizes(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", T.disk_size(F.coalesce("n_chars", F.lit(0)) * 997).alias("size"))


@query
def think_split(spark: SparkSession, d: str) -> DataFrame:
    t = T.blank(F.col("text"))
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<think>"), t, F.lit("</think>Answer "), F.col("doc_id"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Answer "), F.col("doc_id"), F.lit(" <think>"), t)).otherwise(t)
    return documents(spark, d).select("doc_id", T.think_part(raw).alias("thinking"), T.answer_part(raw).alias("answer"))


@query
def answers_to_continue(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "extract_cache")
    reason = F.when(F.col("entry_id") % 17 == 0, "length").otherwise("stop")
    return c.select("entry_id", T.should_continue(F.col("value"), reason).alias("goes_on"), T.is_model_error(F.col("value")).alias("failed"))


@query
def citations_found(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "facts")
    return f.select("seq", _text(T.citations(F.col("source_ref"))).alias("ids"), T.cites_graph(F.col("source_ref")).alias("graph"))


@query
def numbers_found(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "facts")
    return f.select("seq", T.has_numeric(F.col("value")).alias("numeric"), T.to_float(F.col("value")).alias("number"))


@query
def temporal_signals(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("chunk_id", _r(T.temporal_score(F.col("text"))).alias("score"))


@query
def main_answers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "extract_cache")
    return c.select("entry_id", T.main_answer(F.col("value")).alias("main"), _text(T.insight_bullets(F.col("value"))).alias("bullets"))


@query
def slim_contexts(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("chunk_id", T.slim_context(F.col("text")).alias("slim"))


# --- chunks


@query
def sections_of_pages(spark: SparkSession, d: str) -> DataFrame:
    return chunking.sections(documents(spark, d), ["doc_id"]).select("doc_id", _n(F.col("section")).alias("section"), "title", "body", _n(F.col("start")).alias("start"), _n(F.col("end")).alias("end"))


@query
def word_windows(spark: SparkSession, d: str) -> DataFrame:
    return chunking.word_windows(documents(spark, d), ["doc_id"], 220, 30).select("doc_id", _n(F.col("idx")).alias("idx"), "part")


@query
def chunks_built(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.build_chunks(pages(spark, d), now="2024-01-01T00:00:00+00:00")
    return c.select("track", "source_id", "page", "chunk_id", "section_title", _n(F.col("char_start")).alias("char_start"), _n(F.col("char_end")).alias("char_end"), "is_vision", "created_at", _n(F.col("idx")).alias("idx"), "text")


@query
def char_windows(spark: SparkSession, d: str) -> DataFrame:
    return chunking.char_windows(documents(spark, d), ["doc_id"], "doc_id").select("doc_id", _n(F.col("part")).alias("part"), "text")


@query
def page_batches(spark: SparkSession, d: str) -> DataFrame:
    return chunking.page_batches(pages(spark, d))


@query
def vision_pages(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("track = 'retrieval'").groupBy("source_id", F.col("page_or_doc_idx").alias("page"))
    p = c.agg(F.max("is_vision").alias("has_image"), F.max(F.length(T.blank(F.col("text")))).alias("text_len"))
    return chunking.vision_pages(p, 400, 5).select("source_id", _n(F.col("page")).alias("page"), "has_image", _n(F.col("text_len")).alias("text_len"), _n(F.col("rank")).alias("rank"))


# --- facts


def _extraction(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).where("track = 'extraction'")


@query
def numeric_facts(spark: SparkSession, d: str) -> DataFrame:
    return rules.numeric_facts(_extraction(spark, d), F.col("source_id")).select("chunk_id", _n(F.col("n")).alias("n"), "subject", "predicate", "object", "value", "unit", "timeframe", "confidence", "source_ref", "source_id")


@query
def timeline_facts(spark: SparkSession, d: str) -> DataFrame:
    return rules.timeline_facts(_extraction(spark, d), F.col("source_id")).select("chunk_id", _n(F.col("n")).alias("n"), "subject", "predicate", "object", "value", "unit", "confidence", "source_ref", "source_id")


@query
def order_facts(spark: SparkSession, d: str) -> DataFrame:
    """Both rules over a sentence about each order."""
    o = table(spark, d, "orders")
    s = F.concat(F.lit("Order revenue was "), F.floor("o_totalprice").cast("string"), F.lit(" USD in "), F.year("o_orderdate").cast("string"), F.lit(". It is set "), (F.col("o_orderkey") % 90 + 1).cast("string"), F.lit(" years before Customer "), F.col("o_custkey").cast("string"), F.lit(" in the plan."))
    t = o.select(F.col("o_orderkey").cast("string").alias("chunk_id"), F.lit("orders").alias("source_id"), s.alias("text"))
    cols = ["chunk_id", "predicate", "object", "value", "unit", "timeframe"]
    return rules.numeric_facts(t, F.lit("o")).select(*cols).unionByName(rules.timeline_facts(t, F.lit("o")).select(*cols))


@query
def json_facts(spark: SparkSession, d: str) -> DataFrame:
    return rules.facts_of_json(table(spark, d, "extract_cache")).select("entry_id", _n(F.col("n")).alias("n"), "subject", "predicate", "object", "value", "unit", "timeframe", "confidence")


@query
def jsonish_facts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "extract_cache")
    return c.select("entry_id", F.posexplode(facts_udf("value")).alias("n", "f")).select("entry_id", "n", "f.*")


@query
def facts_once_in_chunk(spark: SparkSession, d: str) -> DataFrame:
    return rules.distinct_in_chunk(table(spark, d, "facts")).select("chunk_id", "seq", "subject", "predicate", "object", "value", "unit", "timeframe", "confidence", "source_ref", "source_id")


def scripted_answers(prompt: str, options: dict) -> str:
    """A model for the registered queries: one fact about the first two capitalised words of the text, and an error for every text without."""
    words = re.findall(r"\b[A-Z][a-z]{3,}\b", prompt.rsplit("Text:\n", 1)[-1], re.ASCII)
    if len(words) < 2:
        return "[ERROR] nothing to say"
    return json.dumps({"facts": [{"subject": words[0], "predicate": "named_with", "object": words[1]}], "entities": words[:2]})


@query
def extracted_facts(spark: SparkSession, d: str) -> DataFrame:
    """Extraction in two passes with a scripted model, rules and citations; errors give no facts."""
    c = _extraction(spark, d).withColumn("section_title", F.lit(""))
    none = spark.createDataFrame([], "cache_key string, value string, updated_at string")
    facts, _ = models.extract_facts(c, none, scripted_answers)
    return facts.select("chunk_id", "subject", "predicate", "object", "value", "unit", "timeframe", "confidence", "source_ref", "source_id")


@query
def extraction_cache(spark: SparkSession, d: str) -> DataFrame:
    """The calls of a second run whose cache holds the answers of the first: none are left but those that failed."""
    c = _extraction(spark, d).withColumn("section_title", F.lit(""))
    none = spark.createDataFrame([], "cache_key string, value string, updated_at string")
    first, new = models.extract_facts(c, none, scripted_answers)
    cache = cut(new.withColumn("updated_at", F.lit("2024-01-01T00:00:00Z")))
    again, more = models.extract_facts(c, cache, lambda p, o: "[ERROR] called again")
    kept = again.where("predicate = 'named_with'").agg(F.count(F.lit(1)).alias("facts"))
    return kept.crossJoin(more.agg(F.count(F.lit(1)).alias("stored_again")))


@query
def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    cache = table(spark, d, "extract_cache")
    tasks = cache.select("cache_key", "entry_id").where("entry_id % 2 = 0").unionByName(table(spark, d, "facts").select(F.md5(T.blank(F.col("chunk_id"))).alias("cache_key"), F.col("seq").alias("entry_id")))
    return rules.cache_misses(tasks, cache)


@query
def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    cache = table(spark, d, "extract_cache").select("entry_id", "cache_key", "value", "updated_at")
    new = cache.where("entry_id % 10 = 0").select((F.col("entry_id") + 1_000_000_000).alias("entry_id"), "cache_key", F.lit("{}").alias("value"), F.lit("2099-01-01T00:00:00Z").alias("updated_at"))
    return rules.upsert_cache(cache, new)


# --- graph


@query
def canonical_exact(spark: SparkSession, d: str) -> DataFrame:
    return graph.canonical_facts(table(spark, d, "facts")).withColumn("confidence", _r("confidence"))


@query
def canonical_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "facts")
    return graph.canonical_facts(f, graph.aliases_fuzzy(f)).withColumn("confidence", _r("confidence"))


@query
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).groupBy("src", "label", "dst").agg(F.count(F.lit(1)).alias("edges"))


@query
def entity_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return graph.entity_frequencies(table(spark, d, "facts"))


@query
def node_degrees(spark: SparkSession, d: str) -> DataFrame:
    return degrees(spark, d)


@query
def question_entities(spark: SparkSession, d: str) -> DataFrame:
    return seeds(spark, d).select(_n(F.col("qid")).alias("qid"), "id", _n(F.col("score")).alias("score"), _n(F.col("rank")).alias("rank"))


@query
def graph_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(edges(spark, d), seeds(spark, d)).select(_n(F.col("qid")).alias("qid"), _n(F.col("rank")).alias("rank"), "line")


@query
def keyword_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.keyword_nodes(degrees(spark, d), questions(spark, d)).select(_n(F.col("qid")).alias("qid"), "id", "score", _n(F.col("rank")).alias("rank"))


# --- index and retrieval


@query
def metric_map(spark: SparkSession, d: str) -> DataFrame:
    return index.metric_tags(retrieval_chunks(spark, d))


@query
def entity_map(spark: SparkSession, d: str) -> DataFrame:
    return index.entity_tags(retrieval_chunks(spark, d))


@query
def bm25_statistics(spark: SparkSession, d: str) -> DataFrame:
    return built_index(spark, d).terms.select("term", "df", _r("idf").alias("idf"))


@query
def index_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """What a built index holds after it was written and read: rows of its parts, and the sums of its postings."""
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    index.Index.build(retrieval_chunks(spark, d), path)
    i = index.Index.load(spark, path)
    parts = {"chunks": i.chunks, "postings": i.postings, "terms": i.terms, "tags": i.tags.where("kind = 'metric'"), "vectors": i.vectors}
    out = i.postings.agg(F.lit("words").alias("part"), F.sum("tf").alias("rows"))
    for name, df in parts.items():
        out = out.unionByName(df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("rows")))
    return out


@query
def appended_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of a second batch of chunks behind those of the first, positions going on; those of another length are left out."""
    v = table(spark, d, "index_vectors").where("embedding IS NOT NULL").select("pos", "embedding")
    first = v.where("size(embedding) = 64")
    return workspace.append_vectors(first, v).select("pos", _n(F.size("embedding")).alias("dim"))


@query
def bm25_top(spark: SparkSession, d: str) -> DataFrame:
    s = built_index(spark, d).bm25(questions(spark, d))
    return index.top(s.withColumn("score", _r("score")), 16).select(_n(F.col("qid")).alias("qid"), "pos", "score", _n(F.col("rank")).alias("rank"))


@query
def dense_top(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), "embedding")
    q = e.where("pos % 20 = 0").select(F.col("pos").alias("qid"), F.col("embedding").alias("query"))
    return index.top(index.dense_top(q, e, 16, 6).withColumn("score", _r("score")), 16).select("qid", "pos", "score", _n(F.col("rank")).alias("rank"))


@query
def lexical_top(spark: SparkSession, d: str) -> DataFrame:
    s = retrieval.lexical_scores(questions(spark, d), retrieval_chunks(spark, d))
    return index.top(s.withColumn("score", _r("score")), 8).select(_n(F.col("qid")).alias("qid"), "pos", "score", _n(F.col("rank")).alias("rank"))


@query
def rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Dense scores of the hashed encoder and lexical scores, fused by rank."""
    q, i = questions(spark, d), built_index(spark, d)
    dense = retrieval.query_scores(q, i.vectors).withColumn("score", _r("score"))
    fused = retrieval.rank_fusion(dense, retrieval.lexical_scores(q, i.chunks).withColumn("score", _r("score")))
    return fused.select(_n(F.col("qid")).alias("qid"), "pos", _r("score").alias("score"), _n(F.col("rank")).alias("rank"))


@query
def anchor_candidates(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.anchor_candidates(questions(spark, d), retrieval_chunks(spark, d)).select(_n(F.col("qid")).alias("qid"), "anchor", "pos", "score", _n(F.col("rank")).alias("rank"))


@query
def blended_scores(spark: SparkSession, d: str) -> DataFrame:
    q, i = questions(spark, d), built_index(spark, d)
    scored, _ = retrieval.ranked_candidates(q, i, cut(plans.query_plans(q, _nodes(spark, d))))
    return scored.select(_n(F.col("qid")).alias("qid"), "pos", _r("score").alias("score"), _text(F.array_sort("covers")).alias("covers"))


@query
def diverse_choice(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), "embedding")
    q = e.where("pos % 20 = 0").select(F.col("pos").cast("int").alias("qid"), F.col("embedding").alias("query"))
    scored = index.top(index.dense_top(q, e, 24), 24).select("qid", "pos", "score")
    # the farthest candidate is the only one that covers an anchor, so it has to be kept
    best = index.top(scored, 24).withColumn("covers", F.when(F.col("rank") == 24, F.array(F.lit("far"))).otherwise(F.array().cast("array<string>")))
    far = best.where("rank = 24").select("qid", F.lit("far").alias("anchor"), "pos", F.lit(1).alias("rank"))
    return retrieval.select_diverse(best.drop("rank"), e, far).select("qid", "pos", _r("score").alias("score"), "rank")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d).select("seq", "src", "label", "dst", "source_ref")
    return cut(retrieval.evidence(questions(spark, d), built_index(spark, d), e, _nodes(spark, d)))


@query
def evidence_bundles(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d)


# --- plans


@query
def question_intents(spark: SparkSession, d: str) -> DataFrame:
    i = plans.with_intent(questions(spark, d))
    return i.select(_n(F.col("qid")).alias("qid"), "normalized_question", _text(F.col("intent_labels")).alias("intents"), _text(F.col("comparison_anchors")).alias("anchors"), "requires_derivation", "derivation_type", "timeframe", "should_visualize", "canonical_retrieval_query")


@query
def question_timeframes(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("question")
    return questions(spark, d).select(_n(F.col("qid")).alias("qid"), plans.intent_timeframe(q).alias("intent"), plans.enrichment_timeframe(q).alias("enrichment"), plans.plan_timeframe(q).alias("plan"))


@query
def query_plans(spark: SparkSession, d: str) -> DataFrame:
    p = plans.query_plans(questions(spark, d), _nodes(spark, d))
    return p.select("qid", _text(F.col("intents")).alias("intents"), "timeframe", _text(F.col("entities")).alias("entities"), _text(F.col("metrics")).alias("metrics"), _text(F.col("comparison_anchors")).alias("anchors"), "requires_derivation", "derivation_type")


def _enriched(spark: SparkSession, d: str, with_hint: bool) -> DataFrame:
    q = questions(spark, d)
    e = plans.enrichment(q, seeds(spark, d), with_hint)
    return e.select(_n(F.col("qid")).alias("qid"), "enriched_question", _text(F.col("key_entities")).alias("entities"), _text(F.col("insight_intents")).alias("intents"), "timeframe", "should_visualize", "viz", "use", "summary")


@query
def enriched_questions(spark: SparkSession, d: str) -> DataFrame:
    return _enriched(spark, d, True)


@query
def inferred_questions(spark: SparkSession, d: str) -> DataFrame:
    """The same without an intent: labels, timeframe and entities are inferred by keywords."""
    return _enriched(spark, d, False)


# --- answers


@query
def grounding_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d).select("seq", grounding.grounding_verdict(F.col("answer"), F.col("valid"), F.lit(True)).alias("v")).select("seq", "v.verdict", "v.reason")


@query
def supported_citations(spark: SparkSession, d: str) -> DataFrame:
    context = F.concat(F.lit("[Chunk "), F.get("valid", F.lit(0)), F.lit("] text"))
    return answers(spark, d).select("seq", grounding.citations_supported(F.col("answer"), context).alias("supported"), _n(F.size(grounding.invalid_citations(F.col("answer"), F.col("valid")))).alias("invalid"))


@query
def judge_contexts(spark: SparkSession, d: str) -> DataFrame:
    """What a judge sees of answers that cite their second chunk, every third also the graph, every fifth nothing."""
    e = _evidence(spark, d)
    lines = e.select("qid", F.posexplode("chunk_lines").alias("rank", "line"))
    g = e.select("qid", F.posexplode("graph_lines").alias("rank", "line")).withColumn("rank", F.col("rank") + 1)
    cites = F.concat(F.lit("[Chunk "), F.coalesce(F.get("chunk_ids", F.lit(1)), F.lit("none")), F.lit("]"))
    answer = F.when(F.col("qid") % 5 == 0, "nothing").when(F.col("qid") % 3 == 0, F.concat(cites, F.lit(" and [Graph]"))).otherwise(cites)
    return grounding.judge_context(e.select("qid", answer.alias("answer"), F.array_join("chunk_lines", "\n").alias("fallback")), lines, g)


@query
def packed_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval chunks of each source as lines, packed up to a budget, then its edges; the title's first word is the anchor."""
    c = retrieval_chunks(spark, d).select(F.col("source_id").alias("qid"), F.col("pos").alias("rank"), T.normalize_ws(F.col("text")).alias("line"))
    s = table(spark, d, "source_list").select(F.col("source_id").alias("qid"), F.array(F.get(F.split(T.blank(F.col("title")), " "), F.lit(0))).alias("anchors"))
    e = graph.edges(table(spark, d, "facts").where("predicate = 'has_profile'"))
    e = e.join(table(spark, d, "facts").select("seq", F.col("source_id").alias("qid")), "seq").where("qid IS NOT NULL")
    g = e.select("qid", F.col("seq").alias("rank"), F.concat("src", F.lit(" -["), "label", F.lit("]-> "), "dst").alias("line"))
    return grounding.pack_context(c, g.select("qid", _n(F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).alias("rank"), "line"), s).select("qid", "part", _n(F.col("place")).alias("place"), "used", F.md5("line").alias("line"))


@query
def refused_questions(spark: SparkSession, d: str) -> DataFrame:
    e = _evidence(spark, d)
    return e.select("qid", grounding.low_confidence(F.col("confidence"), F.size("chunk_ids"), F.size("graph_lines"), F.col("requires_derivation"), F.col("anchor_coverage")).alias("refused"))


@query
def judge_verdicts(spark: SparkSession, d: str) -> DataFrame:
    said = {0: '{"verdict": "retry", "issues": "no source"}', 1: "verdict not_found here", 2: 'So: {"verdict": "Maybe"} indeed', 3: "It was not found.", 4: "[ERROR] timeout", 5: "I would retry", 6: "all fine"}
    raw = F.translate("value", "{", "(")  # an answer of the extraction isn't a judge's
    for k, v in said.items():
        raw = F.when(F.col("entry_id") % 8 == k, F.lit(v)).otherwise(raw)
    return table(spark, d, "extract_cache").select("entry_id", grounding.judged(raw).alias("j")).select("entry_id", "j.verdict", "j.issues")


@query
def answer_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Answers with a chart and figures made from facts, taken apart again."""
    f = table(spark, d, "facts").where("value IS NOT NULL")
    item = F.struct(T.blank(F.col("subject")).alias("label"), F.col("value").alias("value"))
    viz = F.to_json(F.struct(F.lit("bar").alias("type"), T.blank(F.col("predicate")).alias("title"), F.array(item, item).alias("data")))
    text = F.concat(T.blank(F.col("object")), F.lit("\n<visualization>"), viz, F.lit("</visualization>\nHero figures: "), F.to_json(F.array(item)))
    out = f.select("seq", artifacts_udf(text).alias("a"))
    return out.select("seq", F.col("a.content").alias("content"), F.col("a.viz_title").alias("title"), _n(F.size("a.viz")).alias("points"), _n(F.size("a.figures")).alias("figures"), is_chartable(F.col("a.viz")).alias("chartable"))


# --- evals and stores


@query
def build_evaluation(spark: SparkSession, d: str) -> DataFrame:
    i, n = built_index(spark, d), documents(spark, d).count()
    rates = {"anchor_coverage_rate": 1.0, "derivation_success_rate": 0.5, "citation_context_validity_rate": 0.9}
    e = evals.build_evals(table(spark, d, "facts"), edges(spark, d), i.chunks, i.tags, n, {"build_total_sec": 10.0, "extract_sec": 5.0}, rates)
    return e.withColumn("failed", F.array_join(F.map_keys(F.map_filter("checks", lambda _, ok: ~ok)), "|")).drop("checks")


@query
def retrieval_evaluation(spark: SparkSession, d: str) -> DataFrame:
    return evals.compositional_evals(_evidence(spark, d))


@query
def workspace_catalog(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select(F.col("source_id").alias("rag_id"), F.length(T.blank(F.col("text"))).cast("long").alias("length"))
    return workspace.catalog(c)


@query
def chat_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    m = e.select(F.col("user_id").alias("id"), F.col("event_id").alias("turn"), F.when(F.col("event_type") == "click", "user").otherwise("assistant").alias("role"), F.concat(F.col("event_type"), F.lit(" "), F.col("event_id").cast("string")).alias("content"), F.col("event_id").alias("at"))
    return workspace.sessions(m)


@query
def merged_sources(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "source_list")
    old = s.where("trust >= 3").select(F.xxhash64("source_id").alias("n"), F.col("publisher").alias("name")).select(F.lit(0).cast("long").alias("n"), "name")
    new = s.select(F.lit(1).cast("long").alias("n"), F.upper("publisher").alias("name"))
    return workspace.merge_sources(old, new).select(F.lower("name").alias("name"), _n(F.col("part")).alias("part"))


@query
def workspace_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    w = workspace.Workspace(spark, f"{shared_dir(spark).removeprefix('file://')}/workspaces-{uuid.uuid4().hex}")
    f = table(spark, d, "facts")
    w.save("all", {"facts": f, "edges": graph.edges(f)}, "All facts", now="2024-01-01T00:00:00Z")
    return w.load("all")["edges"].groupBy("label").agg(F.count(F.lit(1)).alias("edges"))


# --- streams


@query
def stream_build_ticks(spark: SparkSession, d: str) -> DataFrame:
    """The rules for numbers over the chunks as a stream of files, in micro-batches."""
    root = f"{shared_dir(spark).removeprefix('file://')}/build-{uuid.uuid4().hex}"
    c = _extraction(spark, d)
    c.repartition(8, "chunk_id").write.parquet(f"{root}/in")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in c.schema.fields)
    build.stream_build(spark, f"{root}/in", schema, f"{root}/out", f"{root}/checkpoint", lambda df: rules.numeric_facts(df, F.col("source_id"))).awaitTermination()
    return build.built(spark, f"{root}/out").select("chunk_id", _n(F.col("n")).alias("n"), "predicate", "value", "unit")


@query
def stream_answers(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of one answer for each user: its events in order, the last one done."""
    e = table(spark, d, "events").select(F.col("user_id").alias("request"), F.col("event_id").alias("n"), F.concat(F.col("event_type"), F.lit(" ")).alias("response"))
    last = e.groupBy("request").agg(F.max("n").alias("last"))
    t = e.join(last, "request").select("request", "n", "response", (F.col("n") == F.col("last")).alias("done"), F.lit("stop").alias("done_reason"))
    root = f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}"
    t.write.parquet(f"{root}/in")
    build.stream_answers(spark, f"{root}/in", "request long, n long, response string, done boolean, done_reason string", f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return build.built(spark, f"{root}/out").drop("batch")


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return thousandths(convert_quantities(table(spark, d, "facts"), table(spark, d, "unit_catalog")))


@query
def p5_flagged(spark: SparkSession, d: str) -> DataFrame:
    """Quantities whose columns allow several readings, or disagree."""
    return convert_quantities(table(spark, d, "facts"), table(spark, d, "unit_catalog")).where("NOT is_unique OR residual > 0.02")
