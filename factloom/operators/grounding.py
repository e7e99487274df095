"""Checks of answers against their evidence, the context that is packed for them, and the order of the answering steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import approx_tokens, blank, citations, cites_graph, has_numeric, is_model_error, slim_context


def _low(xs: Column) -> Column:
    return F.transform(xs, lambda x: F.lower(x))


def invalid_citations(answer: Column, valid: Column) -> Column:
    """Ids that an answer cites and that aren't valid, in any case of letters."""
    return F.array_except(_low(citations(answer)), _low(valid))


def grounding_verdict(answer: Column, valid: Column, has_graph: Column) -> Column:
    """The first rule that holds: empty, says that nothing was found, lacks citations, cites what isn't there; else pass."""
    text = F.lower(F.trim(blank(answer)))
    cited = citations(answer)
    graph = cites_graph(answer) & has_graph
    say = lambda verdict, reason: F.struct(F.lit(verdict).alias("verdict"), F.lit(reason).alias("reason"))
    return (
        F.when(text == "", say("retry", "empty_answer"))
        .when(text.contains("couldn't find") | text.contains("not found"), say("not_found", "model_not_found"))
        .when((F.size(cited) == 0) & ~graph, say("retry", "missing_citations"))
        .when(F.size(invalid_citations(answer, valid)) > 0, say("retry", "invalid_chunk_citations"))
        .when(has_numeric(answer) & (F.size(cited) == 0) & ~graph, say("retry", "numbers_without_citation"))  # not reached: rule three comes first
        .otherwise(say("pass", "rule_pass"))
    )


def citations_supported(answer: Column, context: Column) -> Column:
    """Whether an answer cites something and the context holds all that it cites."""
    cited = _low(citations(answer))
    return (F.size(cited) > 0) & (F.size(F.array_except(cited, _low(citations(context)))) == 0)


GRAPH_HEADER = "Graph edges (cite as [Graph]):"
CHUNK_HEADER = "Relevant chunks (cite as [Chunk <id>]):"


def judge_context(answers: DataFrame, chunk_lines: DataFrame, graph_lines: DataFrame, most_chunks: int = 24, most_edges: int = 28) -> DataFrame:
    """(qid, context): the graph lines if an answer cites [Graph], and the chunk lines that it cites, under their headers.

    answers (qid, answer, fallback), chunk_lines (qid, rank, line), graph_lines (qid, rank, line). 3,200 characters and 40 lines at
    most; if nothing is cited that is there, 30 lines of the fallback.
    """
    cited = answers.select("qid", F.explode(_low(citations(F.col("answer")))).alias("cid")).distinct()
    of_line = chunk_lines.select("qid", "rank", "line", F.explode(_low(citations(F.col("line")))).alias("cid"))
    picked = of_line.join(cited, ["qid", "cid"], "left_semi").select("qid", "rank", "line").distinct()
    picked = picked.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where(F.col("n") <= most_chunks)
    listed = lambda df, name: df.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias(name))
    graph = listed(graph_lines.where(F.col("rank") <= most_edges), "g").join(answers.where(cites_graph(F.col("answer"))).select("qid"), "qid", "left_semi")
    rows = answers.join(listed(picked, "c"), "qid", "left").join(graph, "qid", "left")
    block = F.concat_ws("\n\n", F.when(F.col("g").isNotNull(), F.concat_ws("\n", F.lit(GRAPH_HEADER), "g")), F.when(F.col("c").isNotNull(), F.concat_ws("\n", F.lit(CHUNK_HEADER), "c")))
    return rows.select("qid", F.when(block == "", slim_context(F.col("fallback"), 3200, 30)).otherwise(slim_context(block, 3200, 40)).alias("context"))


def pack_context(chunk_lines: DataFrame, graph_lines: DataFrame, anchors: DataFrame, budget: int = 5200) -> DataFrame:
    """(qid, part, place, line, used) of the lines that fit into a budget of tokens: chunk lines under their header, then edges under theirs.

    chunk_lines, graph_lines (qid, rank, line), anchors (qid, anchors). Chunk lines come by score: 2.0 for each anchor in the line and
    1.5 for a statement of time, then by rank; the first that doesn't fit ends its part. The graph header and lines come
    where they fit. Lines of a question aren't gathered: each part is cut by the running sum of its tokens.
    """
    has = lambda a: F.lower("line").contains(F.lower(a))
    score = F.aggregate(F.coalesce("anchors", F.array().cast("array<string>")), F.lit(0.0), lambda s, a: s + F.when((F.trim(a) != "") & has(F.trim(a)), 2.0).otherwise(0.0))
    timed = F.col("line").rlike(r"(?i)\b\d+\s+years?\s+(?:before|after)\b|\btakes place\b|\bset\b")
    lines = chunk_lines.join(anchors.select("qid", "anchors"), "qid", "left").select("qid", "rank", "line", (score + F.when(timed, 1.5).otherwise(0.0)).alias("score"))
    running = lambda *order: F.sum("t").over(Window.partitionBy("qid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    tokens = approx_tokens(F.col("line"))
    head, graph_head = approx_tokens(F.lit(CHUNK_HEADER)), approx_tokens(F.lit(GRAPH_HEADER))
    chunks = lines.withColumn("t", tokens).withColumn("used", running(F.desc("score"), "rank") + head)
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "rank"))
    chunks = chunks.withColumn("place", place).where(F.col("used") <= budget)
    taken = chunks.groupBy("qid").agg(F.max("used").alias("taken"))
    every = chunk_lines.select("qid").union(graph_lines.select("qid")).distinct()
    start = every.join(taken, "qid", "left").withColumn("taken", F.coalesce("taken", head))
    start = start.withColumn("fits", F.col("taken") + graph_head <= budget).withColumn("taken", F.col("taken") + F.when(F.col("fits"), graph_head).otherwise(0))
    edges = graph_lines.withColumn("t", tokens).withColumn("sum", running("rank")).join(start, "qid").withColumn("used", F.col("sum") + F.col("taken")).where(F.col("used") <= budget)
    headers = every.select("qid", F.lit(0).alias("part"), F.lit(0).alias("place"), F.lit(CHUNK_HEADER).alias("line"), head.cast("long").alias("used"))
    graph_headers = start.where("fits").select("qid", F.lit(1).alias("part"), F.lit(0).alias("place"), F.lit(GRAPH_HEADER).alias("line"), F.col("taken").cast("long").alias("used"))
    body = chunks.select("qid", F.lit(0).alias("part"), "place", "line", F.col("used").cast("long").alias("used"))
    return headers.unionByName(body).unionByName(graph_headers).unionByName(edges.select("qid", F.lit(1).alias("part"), F.col("rank").cast("int").alias("place"), "line", F.col("used").cast("long").alias("used")))


def low_confidence(confidence: Column, chunk_ids: Column, graph_lines: Column, derive: Column, anchor_coverage: Column) -> Column:
    """Whether a question is refused before it is answered: little confidence, no chunk and no edge, and no anchor of a derivation."""
    return (confidence < 0.15) & (chunk_ids == 0) & (graph_lines == 0) & ~(derive & (anchor_coverage > 0))


def judged(raw: Column) -> Column:
    """(verdict, issues) of a judge's text: those of its JSON, an unknown verdict being pass; without JSON the first of
    not_found, retry and pass that it names, else pass. An error means retry."""
    text = F.lower(blank(raw))
    found = F.regexp_extract(blank(raw), r"(?s)(\{.*\})", 1)
    parsed = F.try_parse_json(found).isNotNull() & (found != "")
    field = lambda k: F.trim(F.coalesce(F.get_json_object(found, f"$.{k}"), F.lit("")))
    said = F.lower(F.trim(F.coalesce(F.get_json_object(found, "$.verdict"), F.lit("pass"))))
    issues = F.when(F.get_json_object(found, "$.issues").isNotNull(), field("issues")).otherwise(field("issue"))
    say = lambda verdict, why: F.struct(F.lit(verdict).alias("verdict"), F.lit(why).alias("issues"))
    return (
        F.when(is_model_error(raw), say("retry", "judge_timeout"))
        .when(parsed, F.struct(F.when(said.isin("pass", "retry", "not_found"), said).otherwise("pass").alias("verdict"), issues.alias("issues")))
        .when(text.contains("not_found") | text.contains("not found"), say("not_found", "judge_text_parse")).when(text.contains("retry"), say("retry", "judge_text_parse"))
        .when(text.contains("pass"), say("pass", "judge_text_parse")).otherwise(say("pass", "judge_parse_fallback"))
    )


def final_state(df: DataFrame) -> DataFrame:
    """Adds state to rows (refused, rule, judge, supported, contradicts, retried): what becomes of an answer.

    Refused ones are not_found. A rule verdict other than pass decides; else the judge's, but a not_found of the judge is passed over if
    the citations are supported and nothing contradicts. One retry; a second one is not_found.
    """
    judge = F.when((F.col("judge") == "not_found") & F.col("supported") & ~F.col("contradicts"), "pass").otherwise(F.col("judge"))
    verdict = F.when(F.col("rule") != "pass", F.col("rule")).otherwise(judge)
    return df.withColumn("state", F.when(F.col("refused"), "not_found").when((verdict == "retry") & F.col("retried"), "not_found").otherwise(verdict))
