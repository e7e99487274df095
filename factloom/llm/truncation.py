"""Text cut off by field limits, found from word trigrams inside texts and at their ends, in SQL.

Texts become words: numbers keep their number of digits only, rare capitalised words (names) become one word. Every
trigram is counted by what follows it: more of the sentence, or an end. A text is a candidate if its last trigram goes
on nearly always, or if its last word is the beginning of the words that usually stand there. An exact check
of brackets then drops answers whose last bracket closes everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import cut

#: Names of tokens: a whole citation, one that is cut, a rare capitalised word.
_CITED, _CITING, _NAME = "cidfull", "cid", "Xx"
_TOKEN = r"9\.$|[\p{L}\p{M}]+(?:[''’-][\p{L}\p{M}]+)*|\d+(?:[.,]\d+)*|[^\s\p{L}\p{M}\p{N}]"


def frequent_names(texts: DataFrame, share: float) -> list[str]:
    """Capitalised words that make up at least a share of all of them; at most 1 / share words."""
    words = cut(texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{M}])\p{Lu}[\p{L}\p{M}]*"), 0)).alias("w")).groupBy("w").count())
    total = words.agg(F.sum("count")).first()[0] or 0
    return sorted(r["w"] for r in words.where(F.col("count") >= max(3, share * total)).select("w").collect())


def normal_words(texts: DataFrame, names: list[str]) -> DataFrame:
    """Adds words (the tokens of a text) and last (its last token as it is written)."""
    # most patterns concern few texts: those with a line break, a citation or such an end
    t = F.when(F.col("text").contains("\n"), F.regexp_replace("text", r"\n(?=\s*[-*•]|\n)", " ¶ ")).otherwise(F.col("text"))
    t = F.when(F.col("text").endswith("0.") | F.col("text").endswith("0,"), F.regexp_replace(t, r"(?<![\d.])0[.,]$", "9.")).otherwise(t)
    cited = F.regexp_replace(F.regexp_replace(t, r"(?i)\[\s*chunk\s+[^\]]*\]", f"[ Chunk {_CITED} ]"), r"(?i)\[\s*chunk\s+[^\]]*$", f"[ Chunk {_CITING}")
    t = F.when(F.lower("text").contains("chunk"), cited).otherwise(t)
    t = F.regexp_replace(F.regexp_replace(t, r"\d+(?:[.,]\d+)+|\d{5,}", "9.9"), r"(?<![\d.])\d(?![.]9)", "9")
    known = [*names, _NAME, "Chunk"]  # looked up in a hash set
    named = F.transform(F.regexp_extract_all(t, F.lit(_TOKEN), 0), lambda w: F.when(w.rlike(r"^\p{Lu}") & ~w.isin(*known), _NAME).otherwise(w))
    words = F.get(F.transform(F.array(named), lambda ws: F.filter(ws, lambda w, i: (w != _NAME) | (i == 0) | (F.get(ws, i - 1) != _NAME))), F.lit(0))
    end = F.substring_index(F.translate("text", "\t\n\r\x0b\f", "     "), " ", -1)  # what stands after the last space
    return texts.select("*", F.regexp_extract(end, r"([\p{L}\p{M}]+|\d+(?:[.,]\d+)*|\S)$", 1).alias("last"), words.alias("words"))


_COUNTS = r"""
WITH words AS (SELECT concat(array('^', '^'), words) AS w FROM {texts}),
     placed AS (SELECT w, explode(sequence(2, size(w) - 1)) AS i FROM words WHERE size(w) > 2),
     trigrams AS (SELECT w[i - 2] AS a, w[i - 1] AS b, w[i] AS c,
                         CASE WHEN i = size(w) - 1 OR w[i + 1] = '¶' THEN 1
                              WHEN w[i] IN ('.', '!', '?', '…') THEN CASE WHEN w[i + 1] RLIKE r'^[\p{{Lu}}\[(«“"]' THEN 1 ELSE 0 END
                              WHEN w[i + 1] IN ('.', '!', '?', '…') AND coalesce(get(w, i + 2), '¶') RLIKE r'^[\p{{Lu}}\[(«“"¶]' THEN 1 ELSE 0 END AS ends,
                         CASE WHEN i = size(w) - 1 THEN 1 ELSE 0 END AS closes
                  FROM placed)
SELECT a, b, c, count(*) AS n, sum(ends) AS ends, sum(closes) AS closes FROM trigrams GROUP BY a, b, c
"""

_FINALS = r"""
WITH finals AS (SELECT concat(array('^', '^'), words) AS w, last FROM {texts} WHERE size(words) > 0)
SELECT w[size(w) - 3] AS a, w[size(w) - 2] AS b, w[size(w) - 1] AS c, last FROM finals
"""

#: Of each distinct final trigram: how often it occurs elsewhere, goes on, and how often longer words stand in its place. Longer
#: words are found by equal beginnings: of a word only those of a length that some last word has, so each word meets each beginning once.
_JUDGED = r"""
WITH distinct_finals AS (SELECT * FROM {finals}),
     needles AS (SELECT DISTINCT a, b, c, last, explode(array_distinct(array(last, c))) AS part FROM distinct_finals),
     pairs AS (SELECT b, c, sum(n) AS n, sum(ends) AS ends FROM {counts} GROUP BY b, c),
     singles AS (SELECT c, sum(n) AS n FROM pairs GROUP BY c),
     own3 AS (SELECT f.*, coalesce(t.n, 1) - 1 AS n3, coalesce(t.ends, 1) - 1 AS ends3 FROM distinct_finals f LEFT JOIN {counts} t USING (a, b, c)),
     own2 AS (SELECT f.*, coalesce(p.n, 1) - 1 AS n2, coalesce(p.ends, 1) - 1 AS ends2 FROM own3 f LEFT JOIN pairs p USING (b, c)),
     parts3 AS (SELECT a, b, c AS longer, n - closes AS n, explode(transform(filter({lengths}, k -> k < length(c)), k -> left(c, k))) AS part
                FROM {counts} t LEFT SEMI JOIN needles USING (a, b) WHERE n > closes),
     longer3 AS (SELECT a, b, c, last, max(m) AS m3 FROM (SELECT f.a, f.b, f.c, f.last, f.part, sum(t.n) AS m FROM needles f JOIN parts3 t ON f.a = t.a AND f.b = t.b AND f.part = t.part
                 WHERE t.longer != f.c GROUP BY f.a, f.b, f.c, f.last, f.part) GROUP BY a, b, c, last),
     needles2 AS (SELECT DISTINCT b, c, last, part FROM needles),
     parts2 AS (SELECT b, c AS longer, n, explode(transform(filter({lengths}, k -> k < length(c)), k -> left(c, k))) AS part FROM pairs p LEFT SEMI JOIN needles2 USING (b)),
     longer2 AS (SELECT b, c, last, max(m) AS m2 FROM (SELECT f.b, f.c, f.last, f.part, sum(t.n) AS m FROM needles2 f JOIN parts2 t ON f.b = t.b AND f.part = t.part
                 WHERE t.longer != f.c GROUP BY f.b, f.c, f.last, f.part) GROUP BY b, c, last),
     parts1 AS (SELECT c AS longer, n, explode(transform(filter({lengths}, k -> k < length(c)), k -> left(c, k))) AS part FROM singles),
     longer1 AS (SELECT f.c, f.last, sum(t.n) AS m1 FROM (SELECT DISTINCT c, last FROM distinct_finals) f JOIN parts1 t ON t.part = f.last WHERE t.longer != f.c GROUP BY f.c, f.last)
SELECT a, b, c, last, n3, ends3, n2, ends2, coalesce(m3, 0) AS m3, coalesce(m2, 0) AS m2, coalesce(s.n, 1) - 1 AS n1, coalesce(m1, 0) AS m1
FROM own2 LEFT JOIN longer3 USING (a, b, c, last) LEFT JOIN longer2 USING (b, c, last)
     LEFT JOIN longer1 USING (c, last) LEFT JOIN singles s USING (c)
"""

#: Trigrams decide; where they are too rare, the same counts summed over the first word, or over the first two, do.
_CUT = """
CASE WHEN n3 >= {least} THEN ends3 < {terminal} * n3 OR (m3 >= {least} AND n3 < {rare} * m3)
     WHEN m3 >= {least} THEN true
     WHEN n2 >= {least} THEN ends2 < {terminal} * n2 OR (m2 >= {least} AND n2 < {rare} * m2)
     WHEN m2 >= {least} THEN true
     ELSE m1 >= {least} AND n1 < {rare} * m1 END
"""
_RULE = "CASE WHEN n3 >= {least} OR m3 >= {least} THEN 'trigram' WHEN n2 >= {least} OR m2 >= {least} THEN 'bigram' ELSE 'word' END"


def _balanced(text: F.Column) -> F.Column:
    """True where a text ends in a bracket or fence and no bracket outside of strings is left open."""
    bare = F.regexp_replace(text, r"\"(?:[^\"\\]|\\.)*+\"|(?<=[{\[,:]\s?)'[^'\n]*+'", "")
    n = lambda c: F.length(bare) - F.length(F.translate(bare, c, ""))
    fences = F.regexp_count(text, F.lit("```"))
    return text.rlike(r"[\]})`]$") & (n("{") == n("}")) & (n("[") == n("]")) & (fences % 2 == 0)


def cut_texts(cache: DataFrame, terminal: float = 0.5, rare: float = 0.05, least: int = 3, name_share: float = 0.001) -> DataFrame:
    """(entry_id, source_id, is_cut, rule) of every entry with a text.

    terminal: a last trigram is suspicious if less than this share of its other occurrences is at an end of a sentence or
    text. rare: so much rarer than the longer words in its place is a beginning of a word. least: occurrences that count;
    where a trigram has fewer, its last two words decide, then the last: rule says which. Half a character at the end (U+FFFD) is left out. Null, blank and error texts ("[ERROR] ...") are not cut. Repeated
    rows each give a row; an empty table gives none; further columns play no role.
    """
    rows = cache.select("entry_id", "source_id", F.regexp_replace("value", r"[\s\p{Z}�]+$", "").alias("text"))
    texts = rows.where(F.coalesce(F.length("text") > 0, F.lit(False)) & ~F.col("text").startswith("[ERROR]"))
    words = cut(normal_words(texts, frequent_names(texts, name_share)).select("entry_id", "source_id", "words", "last", _balanced(F.col("text")).alias("closed")))
    spark = cache.sparkSession
    counts = spark.sql(_COUNTS, texts=words)
    finals = cut(spark.sql(_FINALS, texts=words).distinct())
    lengths = sorted({n for r in finals.select(F.length("last").alias("a"), F.length("c").alias("b")).distinct().collect() for n in r})  # the lengths of words
    judged = spark.sql(_JUDGED.replace("{lengths}", f"array({', '.join(map(str, lengths)) or 0})"), finals=finals, counts=cut(counts)).withColumn("cut", F.expr(_CUT.format(terminal=terminal, rare=rare, least=least))).withColumn("rule", F.expr(_RULE.format(least=least)))
    ends = spark.sql("SELECT *, concat(array('^', '^'), words) AS w FROM {words} WHERE size(words) > 0", words=words)
    ends = ends.select("entry_id", "source_id", "last", "closed", F.expr("w[size(w) - 3]").alias("a"), F.expr("w[size(w) - 2]").alias("b"), F.expr("w[size(w) - 1]").alias("c"))
    return ends.join(judged, ["a", "b", "c", "last"]).select("entry_id", "source_id", (F.col("cut") & ~F.col("closed")).alias("is_cut"), "rule")


def cut_shares(cache: DataFrame) -> DataFrame:
    """(source_id, entries, cut_entries, share) of every source: the share of its entries, empty ones included, that are cut."""
    found = cut_texts(cache).groupBy("source_id").agg(F.count_if("is_cut").alias("cut_entries"))
    entries = cache.groupBy("source_id").agg(F.count(F.lit(1)).alias("entries"))
    found = entries.join(found, entries["source_id"].eqNullSafe(found["source_id"]), "left").select(entries["source_id"], "entries", F.coalesce("cut_entries", F.lit(0).cast("long")).alias("cut_entries"))
    return found.withColumn("share", F.round(F.col("cut_entries") / F.col("entries"), 6))
