"""Questions read into intents and plans. Column functions, so one job reads any number of questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import PLAN_METRICS, normalize_ws, ordered_distinct, query_tokens
from factloom.operators.graph import token_hits

#: Sample questions, for the registered queries and the benchmark.
QUESTIONS = (
    "What was the revenue of Norvane Group in 2014 and how did the margin change?",
    "What is the time difference in years between the Ketterby harbour, and the Sundmoor terminal?",
    "Compare the container volume of Tarnvik vs Lormoor from 2012 to 2019",
    "Why did profit decrease in Q3 2022?",
    "Give a summary of the dredging fleet",
    "How many years after the adventures of Vostra was the lighthouse at Haldrup automated?",
    "Show guidance and capex outlook for FY 21",
    "ferry service Arnsby Norrhaven",
)

# Fixed keyword lists of the intents.
_SUMMARY = ("summary", "summarize", "overview", "about this", "high level")
_METRICS = ("ebit", "ebitda", "revenue", "profit", "margin", "volume", "container", "how much")
_COMPARE = ("compare", "vs", "versus", "difference", "higher", "lower", "increase", "decrease")
_TREND = ("trend", "over time", "from", "to", "quarter", "q1", "q2", "q3", "q4")
_DRIVER = ("why", "driver", "reason", "cause")


#: What may be asked about a fact: a predicate of plain words with a number, or years before or after something.
_MEASURED = "reported_|annual_|energy_|route_|tank_|cargo_|contract_"


def questions(facts: DataFrame) -> DataFrame:
    """(qid, question): the sample questions, and of each source one about its first measured fact and one about its first distance in years.

    As many as there are sources, twice, however many facts there are.
    """
    spark = facts.sparkSession
    sample = spark.createDataFrame([(i + 1, q) for i, q in enumerate(QUESTIONS)], "qid int, question string")
    f = facts.where("source_id IS NOT NULL AND trim(coalesce(subject, '')) != '' AND trim(coalesce(object, '')) != ''")
    first = lambda cond, *cols: F.min(F.when(cond, F.struct("seq", *cols)))
    timed = F.col("predicate").rlike(f"^(?:{_MEASURED})[a-z_]+$") & F.coalesce(F.col("timeframe"), F.lit("")).rlike(r"\d")
    years = F.col("predicate").rlike("^occurs_years_(?:before|after)$")
    per = f.groupBy("source_id").agg(first(timed, "subject", "predicate", "timeframe").alias("m"), first(years, "subject", "object").alias("y"))
    per = per.withColumn("n", F.row_number().over(Window.orderBy("source_id")))  # one row for each source
    what = F.concat(F.lit("What was the "), F.regexp_replace(F.regexp_replace("m.predicate", "^reported_", ""), "_", " "), F.lit(" of "), "m.subject", F.lit(" in "), "m.timeframe", F.lit("?"))
    between = F.concat(F.lit("How many years are between "), "y.subject", F.lit(" and "), "y.object", F.lit("?"))
    asked = per.select(F.explode(F.array(F.struct((2 * F.col("n") + len(QUESTIONS) - 1).alias("qid"), what.alias("question")), F.struct((2 * F.col("n") + len(QUESTIONS)).alias("qid"), between.alias("question")))).alias("q"))
    return sample.unionByName(asked.select(F.col("q.qid").cast("int").alias("qid"), "q.question").where("question IS NOT NULL"))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def _anchor(x: Column) -> Column:
    marks = F.lit(" ,.;:")
    x = F.regexp_replace(F.btrim(x, marks), r"(?i)^(?:the\s+)?(?:adventures?\s+of\s+|timeline\s+of\s+|events?\s+of\s+|story\s+of\s+)", "")
    return F.btrim(normalize_ws(F.regexp_replace(x, r"(?i)^(?:the|a)\s+", "")), marks)


def anchors(question: Column) -> Column:
    """The two things that "between X and Y" compares, at most."""
    rx = r"(?i)\bbetween\s+(.+?)\s*,?\s+and\s+(.+?)(?:\?|$)"
    q = normalize_ws(question)
    return F.slice(ordered_distinct(F.array(_anchor(F.regexp_extract(q, rx, 1)), _anchor(F.regexp_extract(q, rx, 2)))), 1, 2)


def _found(text: Column, rx: str) -> Column:
    return F.regexp_extract_all(text, F.lit(rx), 0)


def intent_timeframe(question: Column) -> Column:
    """First and last year, one year, the first quarter, or "unspecified"."""
    years = F.array_sort(F.array_distinct(_found(question, r"\b(?:19|20)\d{2}\b")))
    quarters = _found(F.upper(question), r"\bQ[1-4]\b")
    return F.when(F.size(years) > 1, F.concat_ws("-", F.get(years, F.lit(0)), F.element_at(years, -1))).when(F.size(years) == 1, F.get(years, F.lit(0))).when(F.size(quarters) > 0, F.get(quarters, F.lit(0))).otherwise("unspecified")


def plan_timeframe(question: Column) -> Column:
    """All years, else fiscal years, else quarters, joined by commas."""
    low = F.lower(question)
    years, fiscal, quarters = _found(question, r"(?:19|20)\d{2}"), _found(low, r"fy\s*\d{2}"), _found(low, "q[1-4]")
    join = lambda xs: F.array_join(F.array_distinct(xs), ",")
    return F.when(F.size(years) > 0, join(years)).when(F.size(fiscal) > 0, join(F.transform(fiscal, lambda x: F.replace(x, F.lit(" "), F.lit(""))))).when(F.size(quarters) > 0, F.upper(join(quarters))).otherwise("unspecified")


def enrichment_timeframe(question: Column) -> Column:
    """First and last of several years, a year with the first quarter, a year, the first quarter or half, or "unspecified"."""
    years = F.array_sort(F.array_distinct(_found(question, r"\b(?:19|20)\d{2}\b")))
    quarters, halves = _found(F.upper(question), r"\bQ[1-4]\b"), _found(F.upper(question), r"\bH[12]\b")
    first = lambda xs: F.get(xs, F.lit(0))
    return (
        F.when(F.size(years) > 1, F.concat_ws("-", first(years), F.element_at(years, -1))).when((F.size(years) == 1) & (F.size(quarters) > 0), F.concat_ws(" ", first(quarters), first(years)))
        .when(F.size(years) == 1, first(years)).when(F.size(quarters) > 0, first(quarters)).when(F.size(halves) > 0, first(halves)).otherwise("unspecified")
    )


def with_intent(df: DataFrame) -> DataFrame:
    """Adds the columns of an intent to rows with a question; null counts as an empty question."""
    q = normalize_ws(F.col("question"))
    low = F.lower(q)
    temporal = low.rlike(r"\b(?:time\s+difference|difference|timeline|years?\s+apart|far\s+apart|before|after|apart)\b") | low.contains("year")
    df = df.withColumn("normalized_question", q).withColumn("comparison_anchors", anchors(F.col("question")))
    between = low.contains("between") & low.contains(" and ")
    derive = temporal & between & (F.size("comparison_anchors") >= 2)
    df = df.withColumn("requires_derivation", derive).withColumn("derivation_type", F.when(F.col("requires_derivation"), "year_difference").otherwise(""))
    label = lambda cond, name: F.when(cond, F.lit(name))
    labels = F.array_compact(
        F.array(
            label(_any(low, _SUMMARY), "summarize_document"), label(_any(low, _METRICS), "extract_key_metrics"),
            label(F.col("requires_derivation") | _any(low, _COMPARE), "compare_values"), label(temporal | _any(low, _TREND), "trend_check"), label(_any(low, _DRIVER), "driver_analysis"),
        )
    )
    df = df.withColumn("intent_labels", F.when(F.size(labels) > 0, F.slice(labels, 1, 3)).otherwise(F.array(F.lit("direct_lookup"))))
    a = F.col("comparison_anchors")
    canonical = F.concat(F.lit("timeline year difference between "), F.get(a, F.lit(0)), F.lit(" and "), F.get(a, F.lit(1)), F.lit(" before after years"))
    return (
        df.withColumn("timeframe", intent_timeframe(q))
        .withColumn("should_visualize", F.arrays_overlap("intent_labels", F.array(F.lit("trend_check"), F.lit("compare_values"))))
        .withColumn("canonical_retrieval_query", F.when(F.col("requires_derivation"), canonical).otherwise(q))
    )


def entity_hits(asked: DataFrame, nodes: DataFrame, most: int = 8) -> DataFrame:
    """(qid, id, score, rank): graph nodes that a question names: 5 if one holds the other, 1 for each token in the node.

    Repeated tokens count again. Of equal scores the smaller id comes first.
    """
    q = asked.select("qid", F.lower(normalize_ws(F.col("question"))).alias("q")).withColumn("toks", query_tokens(F.col("q"))).where("q != ''")
    pairs = token_hits(nodes.select("id").where("id != ''"), q)
    scored = pairs.select("qid", "id", (F.col("overlap") + F.when(F.col("q").contains(F.col("low")) | F.col("low").contains(F.col("q")), 5).otherwise(0)).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scored.where("score > 1").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("qid", "id", "score", "rank")


def query_plans(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Questions with intents, metrics, timeframe and entities: the nodes hit, and then the anchors that aren't among them."""
    df = with_intent(asked)
    low = F.lower("normalized_question")
    metrics = F.filter(F.array(*(F.lit(m) for m in PLAN_METRICS)), lambda m: low.contains(m))
    hits = entity_hits(asked, nodes).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("hits"))
    df = df.join(hits, "qid", "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<string>")))
    return df.select(
        "qid", F.col("intent_labels").alias("intents"), plan_timeframe(F.col("normalized_question")).alias("timeframe"),
        F.slice(F.concat("hits", F.filter("comparison_anchors", lambda a: ~F.array_contains(F.transform("hits", lambda h: F.lower(h)), F.lower(a)))), 1, 8).alias("entities"), metrics.alias("metrics"),
        "comparison_anchors", "requires_derivation", "derivation_type", "canonical_retrieval_query",
    )


# Fixed keyword lists of the enrichment, where a question has no intent yet.
_ENRICH_METRICS = ("ebit", "ebitda", "revenue", "profit", "margin", "volume", "carry", "container", "number", "how much")
_ENRICH_TREND = ("trend", "over time", "from", "to", "year", "quarter", "q1", "q2", "q3", "q4")
_NO_ENTITY = ("what", "which", "how", "full", "year")


def inferred_intents(question: Column) -> Column:
    """Up to three labels by keywords alone."""
    low = F.lower(question)
    pairs = ((_SUMMARY, "summarize_document"), (_ENRICH_METRICS, "extract_key_metrics"), (_COMPARE, "compare_values"), (_ENRICH_TREND, "trend_check"), (_DRIVER, "driver_analysis"))
    labels = F.array_compact(F.array(*(F.when(_any(low, words), F.lit(name)) for words, name in pairs)))
    return F.when(F.size(labels) > 0, F.slice(labels, 1, 3)).otherwise(F.array(F.lit("direct_lookup")))


def inferred_entities(question: Column, hits: Column) -> Column:
    """The first three of the first six graph hits, then of the capitalised words of the question, each once in any case."""
    first = F.slice(ordered_distinct(F.slice(hits, 1, 6)), 1, 3)
    words = F.filter(_found(question, r"\b[A-Z][A-Za-z0-9&\.\-]{2,}\b"), lambda w: ~F.lower(w).isin(*_NO_ENTITY))
    return F.slice(ordered_distinct(F.concat(first, words)), 1, 3)


def enrichment(asked: DataFrame, hits: DataFrame, with_hint: bool = True) -> DataFrame:
    """What is added to a question before it is answered, for questions (qid, question) and graph hits (qid, id, rank).

    With the intent as a hint its labels, timeframe and anchors count; without, they are inferred by keywords. use says whether
    there is anything to add, summary says it in a line.
    """
    listed = hits.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("hits"))
    df = with_intent(asked.select("qid", "question")).join(listed, "qid", "left")
    q, none = F.coalesce(F.col("question"), F.lit("")), F.array().cast("array<string>")
    intents = F.col("intent_labels") if with_hint else inferred_intents(q)
    anchors = F.col("comparison_anchors") if with_hint else none
    entities = F.slice(ordered_distinct(F.concat(inferred_entities(q, F.coalesce("hits", none)), anchors)), 1, 4)
    df = df.select(
        "qid", (F.col("normalized_question") if with_hint else q).alias("enriched_question"), entities.alias("key_entities"), intents.alias("insight_intents"), (F.col("timeframe") if with_hint else enrichment_timeframe(q)).alias("timeframe"), anchors.alias("anchors"),
        F.arrays_overlap(intents, F.array(F.lit("trend_check"), F.lit("compare_values"))).alias("should_visualize"),
    )
    hint = F.when(F.array_contains("insight_intents", "trend_check"), "line").when(F.col("should_visualize"), "bar").otherwise("none")
    part = lambda name, x: F.when(x != "", F.concat(F.lit(f"{name}: "), x))
    known = F.when(F.lower("timeframe") != "unspecified", F.col("timeframe")).otherwise("")
    said = F.concat_ws(" | ", part("Intent", F.array_join(F.slice("insight_intents", 1, 2), ", ")), part("Focus", F.array_join(F.slice("key_entities", 1, 2), ", ")), part("Timeframe", known), part("Viz", F.when(F.col("viz") != "none", F.col("viz")).otherwise("")))
    told = F.array(*(F.lit(x) for x in ("compare_values", "trend_check", "driver_analysis", "extract_key_metrics", "summarize_document")))
    use = F.arrays_overlap("insight_intents", told) | (F.size("key_entities") > 0) | (known != "") | (F.col("viz") != "none")
    return df.withColumn("viz", hint).withColumn("use", use).withColumn("summary", said)
