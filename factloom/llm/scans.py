"""Noise in text from scanned pages: page furniture, words broken at line ends, misread words and years; and its repair.

Every form of a word is counted over all pages. Rare forms, and forms with odd characters, are looked up in a trie of all
words by Levenshtein automata, in which the confusions of scanners are free and other edits are bounded by the length of the
form. What is found is ranked by the neighbouring words, the weight of the edits and the frequency. Texts are read line by line in
Arrow batches and never shuffled; what is shuffled are counts, and the rare forms with their places.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.tries import trie_join
from factloom.session import cut, spread

#: What a character, or two, that a scanner gives may stand for: the usual confusions of print, as cheap edits.
FOLD = {
    "1": "li", "l": "i1", "i": "l1", "|": "li", "!": "li", "0": "o", "o": "0", "@": "a", "6": "bh", "h": "b", "b": "h", "8": "b", "5": "s", "$": "s",
    "ı": "rit", "e": "c", "c": "e", "f": "t", "t": "f", "q": "g", "9": "g", "g": "q",
}
PAIRS = {"rn": "m", "ri": "n", "rl": "n", "r1": "n", "cl": "d", "c1": "d", "ii": "u", "il": "u", "li": "u", "ll": "u", "vv": "w", "ıi": "n", "ın": "m"}
#: The two characters that one may stand for.
SPLIT = {"d": ("cl",), "m": ("rn",), "w": ("vv",)}
_EDGE = " \t\r.,;:()[]{}\"'“”‘’«»|–—-¬­!?*…"
_LETTER = r"[^\W\d_ıﬀ-ﬆ]"
_PLAIN = re.compile(rf"{_LETTER}+(?:[-'’/]{_LETTER}+)*")
_NUMBER_LIKE = re.compile(r"[\dlIOo|,.%/$€£-]*\d[\dlIOo|,.%/$€£-]*")
_YEAR = re.compile(r"[1lI|][9g][\dlIOoSB]{2}|2[0oO][\dlIOoSB]{2}")
_YEAR_DIGITS = str.maketrans({"l": "1", "I": "1", "|": "1", "O": "0", "o": "0", "S": "5", "B": "8", "g": "9"})
_MAY_END_BROKEN = re.compile(r"[-­¬][ \t\r]*$")
_ENDS_BROKEN = re.compile(r"(\S*[\w@])([-­¬])[ \t\r]*$")
_BEGINS = re.compile(r"[ \t]*([\w@]\S*)")
_FLAT = re.compile(r"(\S*[\w@])([-­¬]) ([a-zß-ÿ@0-9ıﬀ-ﬆ]\S*)")
_MAY_BE_FLAT = re.compile(r"[-­¬] ")
_PAGE_NUMBER = re.compile(r"\s*(?:[-–—\[(]\s*)?(?:p(?:age|aqe|agc|\.)?\s*)?(?=[\dlIOo|]*[\dlIO])[\dlIOo|]{1,4}(?:\s*(?:of|ot|/)\s*[\dlIOo|]{1,4})?(?:\s*[-–—\])])?\s*", re.I)
_TABLE = re.compile(r"\D*\d[\d.,]*\s+\d[\d.,]*\s*")
_HEADING = re.compile(r"\s*\d+(?:\.\d+)+\s")
_NO_KEY = re.compile(r"(?i)[\dlIOo|.\[\]()-]{1,6}|p(?:age|\.)")
_SAME = str.maketrans("fciıthqo", "eelrebga")
#: Tables up to this size are broadcast.
MOST_BROADCAST = 200_000


def is_plain(form: str) -> bool:
    return bool(_PLAIN.fullmatch(form))


def line_key(line: str) -> str:
    """A line without page number, spaces and confusions, to compare running heads; empty for headings, table rows and short lines."""
    if _HEADING.match(line) or _TABLE.fullmatch(line):
        return ""
    kept = [t for t in re.split(r"[\s|–—]+", line) if t and not _NO_KEY.fullmatch(t)]
    letters = "".join(c for c in "".join(kept).lower() if c.isalpha())
    return letters.translate(_SAME) if len(letters) >= 5 else ""


def broken(line: str, follow: str) -> tuple[str, str, str] | None:
    """(first half, its hyphen, second half) of a word that is broken at the end of a line."""
    if _MAY_END_BROKEN.search(line) and (m := _ENDS_BROKEN.search(line)) and (n := _BEGINS.match(follow)):
        return m[1], m[2], n[1]
    return None


def whole_lines(text: str) -> Iterator[tuple[int, str, tuple[str, str, str] | None, list[tuple[str, str, str]]]]:
    """(number, line without the words that are broken in it, the word broken at its end, those broken before a space)."""
    lines = text.split("\n")
    begun = None
    for n, line in enumerate(lines, 1):
        ends = broken(line, lines[n]) if n < len(lines) else None
        if ends:
            line = _ENDS_BROKEN.sub("", line)
        if begun:
            line = _BEGINS.sub("", line, count=1)
        flat = []
        if _MAY_BE_FLAT.search(line):
            flat = [m.groups() for m in _FLAT.finditer(line)]
            line = _FLAT.sub(" ", line)
        yield n, line, ends, flat
        begun = ends


def _small(df: DataFrame) -> DataFrame:
    """A checkpointed table, for a broadcast join if it is small, else as it is."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def edit_weight(form: str, right: str) -> float:
    """The weighted edits that make a form of a word: 0.25 for a confusion, 1 for any other."""
    n, m = len(form), len(right)
    rows = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if not (i or j):
                continue
            best = float(i + j)
            if i:
                best = min(best, rows[i - 1][j] + 1)
            if j:
                best = min(best, rows[i][j - 1] + 1)
            if i and j:
                a, b = form[i - 1], right[j - 1]
                best = min(best, rows[i - 1][j - 1] + (0.0 if a == b else 0.25 if b in FOLD.get(a, "") else 1.0))
                if i > 1 and b in PAIRS.get(form[i - 2 : i], ""):
                    best = min(best, rows[i - 2][j - 1] + 0.25)
                if j > 1 and right[j - 2 : j] in SPLIT.get(a, ()):
                    best = min(best, rows[i - 1][j - 2] + 0.25)
                if i > 1 and j > 1 and a == right[j - 2] and form[i - 2] == b:
                    best = min(best, rows[i - 2][j - 2] + 1)
            rows[i][j] = best
    return rows[n][m]


def readings(form: str) -> list[str]:
    """A form with ligatures taken apart, and the forms in which one of its characters is read as two."""
    form = unicodedata.normalize("NFKC", form)
    return [form, *(form[:i] + two + form[i + 1 :] for i, c in enumerate(form) for two in SPLIT.get(c, ()))]


def furniture(rows: DataFrame, running_share: float, top: int, bottom: int) -> DataFrame:
    """(chunk_id, line) of running heads, running feet and page numbers; lines count from 1.

    They stand among the first `top` and last `bottom` lines of a page that aren't blank. A running line is one that
    at least running_share of the source's pages in short lines (two at least, of different texts) have there, but for numbers and confused
    characters. No text is shuffled: only the keys of these lines are.
    """

    def edges_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for *ids, t in pdf.itertuples(index=False):
                lines = t.split("\n")
                full = [i for i, x in enumerate(lines) if x and not x.isspace()]
                if len(lines) < 2:
                    continue
                for at, places, outer in (("top", full[:top], full[:1]), ("bottom", full[-bottom:], full[-2:])):
                    for i in places:
                        key, number = line_key(lines[i]), i in outer and bool(_PAGE_NUMBER.fullmatch(lines[i]))
                        if key or number:
                            out.append((*ids, i + 1, at, xxhash.xxh64_intdigest(key) - 2**63 if key else None, len(lines[i]) <= 80, number))
            yield pd.DataFrame(out, columns=[*pdf.columns[:-1], "line", "at", "key", "short", "number"]).astype({"key": "Int64", "char_start": "Int32", "char_end": "Int32", "page": "Int64"})

    edges = rows.select("chunk_id", "source_id", F.col("page").cast("long").alias("page"), "char_start", "char_end", "text")
    edges = cut(edges.mapInPandas(edges_of, "chunk_id string, source_id string, page long, char_start int, char_end int, line int, at string, key long, short boolean, number boolean"))
    # a text begins its page if nothing stands before it, and ends it if no text of the page reaches further
    extent = rows.groupBy("source_id", F.col("page").cast("long").alias("page")).agg(F.max("char_end").alias("page_end"), F.min(F.xxhash64("text")).alias("content"))
    edges = edges.join(extent, ["source_id", "page"], "left")
    at_top, at_bottom = F.coalesce("char_start", F.lit(0)) == 0, F.coalesce(F.col("char_end") >= F.col("page_end"), F.lit(True))
    edges = cut(edges.where(F.when(F.col("at") == "top", at_top).otherwise(at_bottom)).select("chunk_id", "source_id", F.coalesce("content", "page").alias("content"), "line", "key", "short", "number"))
    # pages of the same text, such as copies under other numbers, count once: what stands on one page doesn't run through them
    keyed = edges.where("key IS NOT NULL").select("source_id", "content", "key").distinct()
    times = keyed.groupBy("source_id", "key").agg(F.count(F.lit(1)).alias("n"))
    all_pages = edges.where("key IS NOT NULL AND short").select("source_id", "content").distinct().groupBy("source_id").agg(F.count(F.lit(1)).alias("pages"))
    running = times.join(all_pages, "source_id").where((F.col("n") >= 2) & (F.col("n") >= running_share * F.col("pages"))).select("source_id", "key")
    found = edges.join(_small(running), ["source_id", "key"], "left_semi").select("chunk_id", "line")
    return found.unionByName(edges.where("number").select("chunk_id", "line")).distinct()


def counted(rows: DataFrame) -> DataFrame:
    """(kind, a, n): on how many texts each form of a word stands (form), and how often two words stand side by side (pair: "a b").

    Words that are broken in two are left out.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forms: Counter[str] = Counter()
        pairs: Counter[tuple[str, str]] = Counter()

        def give() -> pd.DataFrame:
            out = pd.DataFrame([("form", f, n) for f, n in forms.items() if f and not _NUMBER_LIKE.fullmatch(f)] + [("pair", f"{x} {y}", n) for (x, y), n in pairs.items()], columns=["kind", "a", "n"])
            forms.clear(), pairs.clear()
            return out

        for pdf in batches:
            for t in pdf["text"]:
                seen: set[str] = set()
                for _, line, _, _ in whole_lines(t.lower()):
                    words = [w for x in line.split() if (w := x.strip(_EDGE))]
                    seen.update(words)
                    pairs.update(zip(words, words[1:]))
                forms.update(seen)
            if len(forms) + len(pairs) > 400_000:
                yield give()
        yield give()

    return rows.select("text").mapInPandas(count, "kind string, a string, n long").groupBy("kind", "a").agg(F.sum("n").alias("n"))


def suspects(rows: DataFrame, usual: list[str]) -> DataFrame:
    """(chunk_id, line, kind, form, alt, before, after) of what may be noise within a text.

    kind: form (a word that isn't usual), year (a misread one), or how a word is broken: soft, hard (at a line's end) and flat
    (before a space); alt is a broken word with its hyphen.
    """
    known = rows.sparkSession.sparkContext.broadcast(frozenset(usual))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        right = known.value
        for pdf in batches:
            out = []
            for c, t in zip(pdf["chunk_id"], pdf["text"]):
                mine = set()
                for n, line, ends, flat in whole_lines(t):
                    for how, (left, mark, follow) in ([("hard", ends)] if ends else []) + [("flat", m) for m in flat]:
                        left, follow = left.lstrip(_EDGE).lower(), follow.rstrip(_EDGE).lower()
                        if any(x.isalpha() for x in left) and any(x.isalpha() for x in follow):
                            mine.add((c, n, how if mark == "-" else "soft", left + follow, f"{left}-{follow}", "", ""))
                    raw = [w for x in line.split() if (w := x.strip(_EDGE))]
                    low = [w.lower() for w in raw]
                    for i, f in enumerate(low):
                        if f in right or f.isdigit():
                            continue
                        if len(f) == 4 and _YEAR.fullmatch(raw[i]):
                            mine.add((c, n, "year", raw[i], "", "", ""))
                        elif not _NUMBER_LIKE.fullmatch(raw[i]):
                            mine.add((c, n, "form", f, "", low[i - 1] if i else "", low[i + 1] if i + 1 < len(low) else ""))
                out += mine
            yield pd.DataFrame(out, columns=["chunk_id", "line", "kind", "form", "alt", "before", "after"])

    return rows.select("chunk_id", "text").mapInPandas(find, "chunk_id string, line int, kind string, form string, alt string, before string, after string")


def candidates(forms: DataFrame, asked: DataFrame, short_ratio: float, long_ratio: float) -> DataFrame:
    """(form, right, pages, distance, weight, sure) of the words that an asked form may be a misreading of.

    forms (form, n, plain), asked (form, n, plain). Words are kept in tries by powers of four of their frequency, so a form is
    looked up only among words that are frequent enough: short_ratio or long_ratio times (8 letters and more), or any for forms with odd
    characters. Bounded edits beside confusions: 0 up to 3 letters, 1 up to 9, then 2. Sure: confusions only, or one
    more edit in a longer form with odd characters; other candidates need neighbours that speak for them, 50 times the frequency,
    and a form that isn't the beginning or end of the word, as pieces of words are.
    """
    tier = lambda n: F.floor(F.log(4.0, n.cast("double")) + 1e-9).cast("int")
    known = forms.where("plain AND n > 0").select("form", "n", tier(F.col("n")).alias("tier"))
    most = known.agg(F.max("tier")).first()[0]
    most = 0 if most is None else most
    ratio = F.when(~F.col("plain"), 0.0).when(F.length("form") > 7, long_ratio).otherwise(short_ratio)
    asked = cut(asked.withColumn("need", F.greatest(F.lit(1.0), ratio * F.col("n"))).withColumn("reads", F.pandas_udf(lambda s: s.map(readings), "array<string>")("form")))
    asked = asked.withColumn("read", F.get("reads", F.lit(0)))
    bound = F.when((F.length("as") < 4) | (F.col("i") > 0), 0).when(F.length("as") < 10, 1).otherwise(2)
    tiers = F.sequence(F.least(tier(F.col("need")), F.lit(most)), F.lit(most)).cast("array<string>")
    sent = asked.select("form", tiers.alias("tiers"), F.posexplode("reads").alias("i", "as")).select("form", F.col("as"), bound.alias("bound"), F.explode("tiers").alias("key"))
    near = trie_join(known.select(F.col("tier").cast("string").alias("key"), F.col("form").alias("word")), sent.groupBy("key", F.col("as").alias("form")).agg(F.max("bound").alias("bound")), FOLD, PAIRS)
    near = near.groupBy(F.col("form").alias("as"), F.col("word").alias("right")).agg(F.min("distance").alias("distance"))
    near = sent.select("form", "as").distinct().join(near, "as").groupBy("form", "right").agg(F.min("distance").alias("distance"))
    found = asked.join(near, "form").join(known.select(F.col("form").alias("right"), F.col("n").alias("pages")), "right").where("right != form AND pages >= need")
    piece = F.col("right").startswith(F.col("read")) | F.col("right").endswith(F.col("read"))
    sure = (F.col("distance") == 0) | (~F.col("plain") & (F.col("distance") == 1) & (F.length("read") >= 6))
    found = found.withColumn("sure", sure).where(F.col("sure") | (~piece & (F.length("read") >= 5) & (F.col("pages") >= 50 * F.col("n"))))
    weigh = F.pandas_udf(lambda a, b: pd.Series([edit_weight(x, y) for x, y in zip(a, b)]), "double")
    found = cut(found.select("form", "right", "pages", "distance", "sure", weigh("read", "right").alias("weight")))
    best = found.groupBy("form").agg(F.max("sure").alias("any_sure"), F.min(F.when(F.col("sure"), F.col("distance"))).alias("nearest"), F.min("distance").alias("least"))
    best = best.join(found.where("sure").groupBy("form", "distance").agg(F.max("pages").alias("most")).withColumnRenamed("distance", "nearest"), ["form", "nearest"], "left")
    # the right word is among the nearest; far rarer ones are left out
    found = found.join(best, "form").where(F.when(F.col("any_sure"), F.col("sure") & (F.col("distance") == F.col("nearest")) & (F.col("pages") * 50 >= F.col("most"))).otherwise(F.col("distance") == F.col("least")))
    return found.select("form", "right", "pages", "weight", "sure")


def noise_rows(chunks: DataFrame, frequent_share: float = 0.005, running_share: float = 0.12, top: int = 2, bottom: int = 3) -> DataFrame:
    """(chunk_id, line, kind, form, item) of the noise of all chunks, without repetition.

    kind: line (furniture, item is its number), year, form (a misread word), soft, hard or flat (a broken word). frequent_share:
    words on a larger share of the texts are right.
    """
    rows = chunks.where("text IS NOT NULL AND chunk_id IS NOT NULL").select("track", "chunk_id", "source_id", F.col("page_or_doc_idx").alias("page"), "char_start", "char_end", "text")
    rows = spread(rows)
    gone = cut(furniture(rows, running_share, top, bottom))
    # words are counted once a page: in the text that holds it whole, or in its pieces where there is none
    of_page = rows.select("track", "source_id", "page").distinct()
    pieces = _small(of_page.where("track != 'retrieval' OR track IS NULL").select("source_id", "page").exceptAll(of_page.where("track = 'retrieval'").select("source_id", "page")))
    alone = rows.where("track != 'retrieval' OR track IS NULL").join(pieces, rows["source_id"].eqNullSafe(pieces["source_id"]) & rows["page"].eqNullSafe(pieces["page"]), "left_semi")
    whole = rows.where("track = 'retrieval'").unionByName(alone)
    counts = cut(counted(whole))
    plain = F.pandas_udf(lambda f: f.map(is_plain), "boolean")
    forms = cut(counts.where("kind = 'form'").select(F.col("a").alias("form"), "n", plain("a").alias("plain")))
    limit = max(3.0, frequent_share * whole.count())
    # at most the mean number of distinct words of a text / frequent_share
    usual = [r["form"] for r in forms.where(F.col("plain") & (F.col("n") > limit)).select("form").collect()]
    found = suspects(rows, usual).join(gone, ["chunk_id", "line"], "left_anti")
    # a word isn't broken where the next line is furniture
    cut_off = gone.select("chunk_id", (F.col("line") - 1).alias("line"), F.explode(F.array(F.lit("soft"), F.lit("hard"))).alias("kind"))
    found = cut(found.join(cut_off, ["chunk_id", "line", "kind"], "left_anti"))

    asked = found.where("kind != 'year'").select("form").distinct().join(forms, "form", "left")
    asked = asked.select("form", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("plain", plain("form")).alias("plain"))
    options = cut(candidates(forms, asked, 20.0, 3.0))
    misread = found.where("kind = 'form'").join(options, "form")
    pairs = counts.where("kind = 'pair'")
    times = lambda name: pairs.select(F.col("a").alias(f"p{name}"), F.col("n").alias(name))
    scored = misread.withColumn("pl", F.concat_ws(" ", "before", "right")).withColumn("pr", F.concat_ws(" ", "right", "after")).join(times("l"), "pl", "left").join(times("r"), "pr", "left")
    l, r = F.coalesce("l", F.lit(0)), F.coalesce("r", F.lit(0))
    score = 2 * F.log1p(l) + 2 * F.log1p(r) + F.log("pages") - 3 * F.col("weight")
    scored = scored.where(F.col("sure") | (l + r >= 2)).groupBy("chunk_id", "line", "form", "before", "after").agg(F.max(F.struct(score.alias("score"), "right")).alias("best"))
    repaired = scored.select("chunk_id", "line", F.lit("form").alias("kind"), "form", F.col("best.right").alias("item"))

    of_form = lambda name, n: forms.select(F.col("form").alias(name), F.col("n").alias(n))
    broken = found.where("kind IN ('soft', 'hard', 'flat')").join(of_form("form", "joined_n"), "form", "left").join(of_form("alt", "alt_n"), "alt", "left")
    best = options.where("sure").groupBy("form").agg(F.max(F.struct(F.log("pages") - 3 * F.col("weight"), "pages", "right")).alias("o"))
    broken = broken.join(best.select("form", F.col("o.right").alias("right"), F.col("o.pages").alias("right_n")), "form", "left")
    j, a = F.greatest(F.coalesce("joined_n", F.lit(0)), F.coalesce("right_n", F.lit(0))), F.coalesce("alt_n", F.lit(0))
    is_case = (F.col("kind") == "soft") | ((F.col("kind") == "hard") & (a <= j)) | ((F.col("kind") == "flat") & (j > a))
    whole = broken.where(is_case).select("chunk_id", "line", "kind", "form", F.coalesce("right", "form").alias("item"))
    lines = gone.select("chunk_id", "line", F.lit("line").alias("kind"), F.lit("").alias("form"), F.col("line").cast("string").alias("item"))
    years = found.where("kind = 'year'").select("chunk_id", "line", "kind", "form", F.translate("form", "lI|OoSBg", "11100589").alias("item"))
    return lines.unionByName(years).unionByName(repaired).unionByName(whole).distinct()


def page_noise(chunks: DataFrame) -> DataFrame:
    """(chunk_id, kind, item), without repetition: see TESTDATA.md, p2_found.

    Chunks with null text or id give nothing; chunks delivered twice count once in the result; an empty table gives no rows; further
    columns play no role. A word whose place in a broken word or line can't be told stays as it is.
    """
    noise = noise_rows(chunks)
    return noise.select("chunk_id", F.when(F.col("kind") == "line", "line").otherwise("word").alias("kind"), "item").distinct()


_WORDS = re.compile(r"\S+")


def _cased(old: str, new: str) -> str:
    """A repaired word in the case of the one it replaces."""
    letters = [c for c in old if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return new.upper()
    return new[:1].upper() + new[1:] if old[:1].isupper() else new


def reflow(text: str, noise: list[tuple[int, str, str, str]]) -> str:
    """A text without its noise (line, kind, form, item), as paragraphs: lines are joined up to a blank line, a heading or a table row."""
    gone = {n for n, kind, _, _ in noise if kind == "line"}
    right = {(n, form.lower()): item for n, kind, form, item in noise if kind in ("form", "year")}
    joined = {n: item for n, kind, _, item in noise if kind in ("soft", "hard")}
    flat = {(n, form): item for n, kind, form, item in noise if kind in ("flat", "soft")}
    paragraphs: list[list[str]] = [[]]
    lines = text.split("\n")
    taken = ""  # the second half of a broken word, which stands on the line before
    for n, line in enumerate(lines, 1):
        if n in gone:
            continue
        if taken:
            line = line.lstrip(" \t").removeprefix(taken)
            taken = ""
        if not line.strip():
            if paragraphs[-1] and n - 1 not in joined:
                paragraphs.append([])
            continue
        tail = ""
        m = _ENDS_BROKEN.search(line)
        follow = _BEGINS.match(lines[n]) if n < len(lines) else None
        if n in joined and m and follow:
            taken = follow[1]
            core = m[1].lstrip(_EDGE)
            end = taken[len(taken.rstrip(_EDGE)) :]
            tail = m[1][: len(m[1]) - len(core)] + _cased(core, joined[n]) + end
            line = line[: m.start()]

        def one(m: re.Match, n: int = n) -> str:
            core = m[0].strip(_EDGE)
            new = right.get((n, core.lower()))
            return m[0] if new is None or not core else m[0].replace(core, _cased(core, new), 1)

        def join(m: re.Match, n: int = n) -> str:
            core = m[1].lstrip(_EDGE)
            new = flat.get((n, (core + m[3].rstrip(_EDGE)).lower()))
            return m[0] if new is None else m[1][: len(m[1]) - len(core)] + _cased(core, new) + m[3][len(m[3].rstrip(_EDGE)) :]

        line = _FLAT.sub(join, line)
        line = " ".join(_WORDS.sub(one, line).split())
        line = f"{line} {tail}".strip()
        if _HEADING.match(line) or _TABLE.fullmatch(line):
            paragraphs += [[line], []] if paragraphs[-1] else [[]]
            if len(paragraphs) > 1 and not paragraphs[-2]:
                paragraphs[-2].append(line)
        else:
            paragraphs[-1].append(line)
    return "\n\n".join(" ".join(p) for p in paragraphs if p)


def repaired_texts(chunks: DataFrame) -> DataFrame:
    """(chunk_id, text): every chunk with its text as continuous paragraphs: furniture out, broken words whole, misread ones right.

    Lines are joined up to a blank line; numbered headings and table rows stay alone. A null text stays null and a blank one becomes
    empty; chunks delivered twice give two rows; a null chunk_id keeps its text but for the joining of lines.
    """
    noise = noise_rows(chunks).groupBy("chunk_id").agg(F.collect_list(F.struct("line", "kind", "form", "item")).alias("noise"))  # within one text

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [None if t is None else reflow(t, [] if x is None else [(r["line"], r["kind"], r["form"], r["item"]) for r in x]) for t, x in zip(pdf["text"], pdf["noise"])]
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "text": out})

    rows = spread(chunks.select("chunk_id", "text")).join(noise, "chunk_id", "left")
    return rows.mapInPandas(repair, "chunk_id string, text string")
