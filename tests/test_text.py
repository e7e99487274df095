import pytest
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.functions.jsonish import artifacts, balanced_block, entity_list, fact_rows, parse_any


def values(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r[1] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_plain_functions(spark):
    assert values(spark, T.normalize_ws, " a \n b c ", None, "") == ["a b c", "", ""]
    assert values(spark, T.approx_tokens, "one two three four", None, "") == [5, 1, 1]
    assert values(spark, T.index_tokens, "The Cat, a 42!", None) == [["cat", "42"], []]
    assert values(spark, T.clean_entity, " N/A ", "Acme, ", "-", None) == ["", "Acme", "", ""]
    assert values(spark, T.entity_key, "Acme & Söns, Ltd.", "A  B") == ["acme sns ltd.", "a b"]
    assert values(spark, T.citations, "[Chunk a] [ chunk  b ] [CHUNK A]", None) == [["a", "b"], []]
    assert values(spark, T.to_float, "x -1,234.5 y", "none", None) == [-1234.5, None, None]
    assert values(spark, T.looks_like_heading, "1.2 Scope", "RESULTS SUMMARY", "Outlook:", "It was a long day, and it rained.", "") == [True, True, True, False, False]
    assert values(spark, T.normalize_url, "example.com/a#x", "HTTP://A.b/c", "", "https://", None) == ["https://example.com/a", "HTTP://A.b/c", "", "", ""]
    assert values(spark, T.url_graph_name, "www.site.com/my_page-one") == ["site.com my page one"]
    assert values(spark, T.think_part, "<think>a</think>b", "<think>a", "b</think>c") == ["a", "a", ""]
    assert values(spark, T.answer_part, "<think>a</think>b", "<think>a", "b</think>c") == ["b", "", "bc"]
    assert values(spark, lambda x: T.should_continue(x, F.lit("stop")), "Done and dusted today.", "we went to", "-", "") == [False, True, True, False]
    assert values(spark, T.temporal_score, "12 years before X", "no") == [0.34, 0.0]


@pytest.mark.parametrize(
    ("text", "value"),
    [('{"a": 1}', {"a": 1}), ("x {'a': None} y", {"a": None}), ("```json\n[1, 2,]\n```", [1, 2]), ("{“a”: “b}”}", {"a": "b}"}), ('{"r": [Chunk 9]}', {"r": "[Chunk 9]"}), ("[ERROR] timeout", None), ("", None), (None, None)],
)
def test_parse_any(text, value):
    assert parse_any(text) == value


def test_json_helpers():
    assert balanced_block('a {"x": "}"} b')[0] == '{"x": "}"}'
    assert balanced_block("{ open")[0] == ""
    one = '{"subject": "a", "predicate": "b", "object": "c", "confidence": 7}'
    assert [f["confidence"] for f in fact_rows(one)] == [1.0]
    assert len(fact_rows(one + "\n" + one)) == 2
    assert fact_rows('{"facts": [{"subject": "a"}]}') == []
    assert entity_list('{"entities": ["A", "a", "B"]}') == ["A", "B"]


def test_artifacts():
    a = artifacts('Text.\n<visualization>{"type": "line", "title": "t", "data": [{"label": "x", "value": 1}, {"label": "y", "value": 2}]}</visualization>\nHero figures: [{"label": "h", "value": "3"}]')
    assert (a["content"], a["viz_type"], len(a["viz"]), a["figures"][0]["label"]) == ("Text.", "line", 2, "h")
    assert artifacts(None)["content"] == ""
    assert artifacts('Left {"data": {"x": 1}} over')["viz"] == [{"label": "x", "value": "1"}]


def test_answers_that_go_on(spark):
    rows = [("", "length", True), ("", "stop", False), ("Done.", "stop", False), ("It is about", "", True), ("It is about.", "", False), ("one two three four of the", "", False), ("three short words", "", True), ("a list:", "", True), ("x, y,", "", True),
            ("- Revenue", "", True), ("- Revenue grew a lot in the year", "", False), ("long enough line that ends due 5", "", True), ("quoted `code`", "", True), ("hero figures:", "", True), ("many words stand here with", "", True)]
    df = spark.createDataFrame([r[:2] for r in rows], "a string, r string")
    assert [x[0] for x in df.select(T.should_continue(F.col("a"), F.col("r"))).collect()] == [r[2] for r in rows]


def test_image_scores(spark):
    rows = [("x/chart.png", "", "640", "480", 5.4), ("logo.svg", None, "50", "50", -8.7), ("a.jpg", "EBITDA trend", "10", "300", 5.4), ("plot.png", "", "379", "249", 0.0), ("icon.svg?x", "", "0", "50", -5.0), ("b.png", "", "80", "95", 0.0)]
    df = spark.createDataFrame([r[:4] for r in rows], "u string, a string, w string, h string")
    assert [x[0] for x in df.select(T.image_score(F.col("u"), F.col("a"), F.col("w"), F.col("h"))).collect()] == pytest.approx([r[4] for r in rows])


def test_bullets_sizes_and_sources(spark):
    df = spark.createDataFrame([("Main.\nKey insights:\n- one\n•two\n * three\n-four\n- -*five", 512), (None, 1536)], "t string, n long")
    got = df.select(T.insight_bullets(F.col("t")), T.disk_size(F.col("n")), T.main_answer(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(["one", "two", "three", "five"], "512.00 B", "Main."), ([], "1.50 KB", "")]
    m = spark.createDataFrame([("[Chunk a] x [graph] [CHUNK A]", ["[Graph]", " ", "Report"])], "t string, f array<string>")
    assert m.select(T.message_sources(F.col("t"), F.col("f"))).first()[0] == ["[Chunk a]", "[graph]", "Report"]
