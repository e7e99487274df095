"""Column functions over text: normal forms, tokens, citations, signals. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\t\n\x0b\f\r \x{85}\p{Z}]"
NOT_WS = r"[^\t\n\x0b\f\r \x{85}\p{Z}]"
# Fixed values of the data model: words that stand for nothing, stop words, metric words.
NULL_LIKE = ("", "none", "null", "n/a", "na", "unknown", "-", "--")
INDEX_STOP = ("the", "and", "for", "with", "this", "that")
LEXICAL_STOP = ("what", "which", "show", "give", "about", "from", "with", "this", "that", "the", "and")
QUERY_STOP = ("what", "which", "show", "give", "about", "from", "with", "this", "that", "the", "and", "for", "how", "much")
METRIC_HINTS = ("ebit", "ebitda", "revenue", "margin", "cash", "fcf", "capex", "volume", "guidance", "profit", "cost", "growth")
PLAN_METRICS = ("ebit", "ebitda", "revenue", "margin", "cash", "fcf", "capex", "volume", "guidance", "profit")
CITATION = r"(?i)\[\s*chunk\s*([^\]]+?)\s*\]"
TEMPORAL = (r"(?i)\b\d+\s+years?\s+(?:before|after)\b", r"(?i)\btakes place\b.{0,80}\b\d+\s+years?\b", r"(?i)\bset\b.{0,80}\b\d+\s+years?\b")


def blank(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def normalize_ws(x: Column) -> Column:
    """White space squeezed to single spaces and trimmed; null gives an empty text."""
    return F.trim(F.regexp_replace(blank(x), WS + "+", " "))


def word_count(x: Column) -> Column:
    return F.regexp_count(blank(x), F.lit(NOT_WS + "+"))


def approx_tokens(x: Column) -> Column:
    """Words times 1.33, rounded down, at least 1."""
    return F.greatest(F.lit(1), F.floor(word_count(x) * F.lit(1.33)).cast("int"))


def looks_like_heading(line: Column) -> Column:
    raw = F.regexp_replace(line, f"^{WS}+|{WS}+$", "")
    words = word_count(raw)
    numbered = raw.rlike(r"(?i)^(\d+(?:\.\d+)*|Q[1-4]|FY\d{2})\b")
    colon = raw.endswith(":") & (words <= 12)
    capitals = (F.upper(raw) == raw) & (F.lower(raw) != raw) & words.between(2, 12)
    title = raw.rlike(r"^[A-Z][A-Za-z0-9 &/\-]{2,60}$") & (words <= 10)
    return (raw != "") & (F.length(raw) <= 110) & (numbered | colon | capitals | title)


def _tokens(x: Column, stop: tuple[str, ...]) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(blank(x)), F.lit("[a-z0-9]{2,}"), 0), lambda t: ~t.isin(*stop))


def index_tokens(x: Column) -> Column:
    return _tokens(x, INDEX_STOP)


def lexical_tokens(x: Column) -> Column:
    return _tokens(x, LEXICAL_STOP)


def query_tokens(x: Column) -> Column:
    return _tokens(x, QUERY_STOP)


def chunk_id(track: Column, page: Column, idx: Column, source: Column, text: Column) -> Column:
    """track-page-number-digest, counted from 1; the digest names source, place and the first 140 characters."""
    digest = F.left(F.md5(F.concat_ws("|", source, idx.cast("string"), page.cast("string"), track, F.left(text, F.lit(140)))), F.lit(10))
    return F.concat_ws("-", track, (page + 1).cast("string"), (idx + 1).cast("string"), digest)


def is_null_like(x: Column) -> Column:
    return F.lower(normalize_ws(x)).isin(*NULL_LIKE)


def clean_entity(x: Column) -> Column:
    """Squeezed; empty if it stands for nothing; without outer space, comma, semicolon and colon."""
    return F.when(is_null_like(x), "").otherwise(F.btrim(normalize_ws(x), F.lit(" ,;:")))


def name_key(clean: Column) -> Column:
    """The key of a name that is clean already."""
    return normalize_ws(F.regexp_replace(F.lower(clean), r"[^a-z0-9%$€£\-\.\s]", ""))


def entity_key(x: Column) -> Column:
    return name_key(clean_entity(x))


def ordered_distinct(xs: Column) -> Column:
    """The strings of an array without blanks and without repetition in any case; the first of each stays."""
    kept = F.filter(F.transform(xs, normalize_ws), lambda x: x != "")
    low = F.transform(kept, lambda x: F.lower(x))
    return F.filter(kept, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def citations(x: Column) -> Column:
    """Ids in [Chunk id] marks, in order, without repetition."""
    return ordered_distinct(F.regexp_extract_all(blank(x), F.lit(CITATION), 1))


def cites_graph(x: Column) -> Column:
    return blank(x).rlike(r"(?i)\[\s*graph\s*\]")


def has_numeric(x: Column) -> Column:
    return blank(x).rlike(r"-?\d[\d,]*(\.\d+)?")


def to_float(x: Column) -> Column:
    """The first number of a text, commas dropped; null if there is none."""
    return F.regexp_extract(F.regexp_replace(blank(x), ",", ""), r"-?[0-9]+(?:\.[0-9]+)?", 0).try_cast("double")


def lenient_int(x: Column) -> Column:
    return F.coalesce(blank(x).try_cast("double").cast("int"), F.lit(0))


def temporal_score(x: Column) -> Column:
    """0.34 for each of three statements of years before or after, 1 at most."""
    hits = sum((blank(x).rlike(p).cast("int") for p in TEMPORAL), F.lit(0))
    return F.least(F.lit(1.0), hits * F.lit(0.34))


def anchor_score(anchor: Column, text: Column) -> Column:
    """1.5 if the text holds the anchor, and the share of the anchor's tokens that it holds."""
    a, t = F.lower(normalize_ws(anchor)), F.lower(blank(text))
    toks = query_tokens(a)
    share = F.when(F.size(toks) > 0, F.least(F.lit(1.0), F.size(F.filter(toks, lambda k: t.contains(k))) / F.size(toks))).otherwise(0.0)
    return F.when((a == "") | (t == ""), 0.0).otherwise(F.when(t.contains(a), 1.5).otherwise(0.0) + share)


def normalize_url(x: Column) -> Column:
    """https:// added where there is no scheme, without fragment; empty without a host."""
    raw = F.trim(blank(x))
    full = F.when(raw.rlike(r"(?i)^https?://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    full = F.regexp_replace(full, "#.*$", "")
    return F.when((raw == "") | (F.regexp_extract(full, r"(?i)^https?://([^/?#]+)", 1) == ""), "").otherwise(full)


def url_graph_name(x: Column) -> Column:
    """Host without www. and the last part of the path, its dashes as spaces."""
    url = normalize_url(x)
    host = F.replace(F.lower(F.regexp_extract(url, r"(?i)^https?://([^/?#]+)", 1)), F.lit("www."), F.lit(""))
    path = F.regexp_replace(F.regexp_extract(url, r"(?i)^https?://[^/?#]+([^?#]*)", 1), "/+$", "")
    last = F.trim(F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), "[-_]+", " "))
    return F.when(last == "", host).otherwise(F.concat_ws(" ", host, last))


def graph_name(x: Column, fallback: str = "Untitled Graph") -> Column:
    name = F.left(normalize_ws(x), F.lit(120))
    return F.when(name == "", fallback).otherwise(name)


def slug(x: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(graph_name(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "graph").otherwise(F.left(s, F.lit(72)))


def ellipsize(x: Column, most: int = 44) -> Column:
    t = normalize_ws(x)
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.left(t, F.lit(most - 3))), F.lit("..."))).otherwise(t)


def disk_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB with two decimals."""
    by = lambda p: F.format_string("%.2f", F.rint(n / F.lit(float(1024**p)) * 100) / 100)
    return (
        F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(".00 B")))
        .when(n < 1024**2, F.concat(by(1), F.lit(" KB")))
        .when(n < 1024**3, F.concat(by(2), F.lit(" MB")))
        .otherwise(F.concat(by(3), F.lit(" GB")))
    )


def think_part(x: Column) -> Column:
    """What stands in <think> marks; an open mark reaches to the end."""
    return F.regexp_replace(F.array_join(F.regexp_extract_all(blank(x), F.lit(r"(?is)<think>(.*?)(?:</think>|\z)"), 1), "\n"), rf"\A{WS}+|{WS}+\z", "")


def answer_part(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(blank(x), r"(?is)<think>.*?(?:</think>|\z)", ""), "(?i)</think>", ""), rf"\A{WS}+|{WS}+\z", "")


def is_model_error(x: Column) -> Column:
    return blank(x).startswith("[ERROR]")


# Fixed words of the rules.
DANGLING = ("approximately", "around", "about", "due", "with", "to", "from", "and", "or")
IMAGE_GOOD = "chart|graph|table|figure|trend|ebit|ebitda|revenue|profit|margin|volume|financial"
IMAGE_BAD = "logo|icon|avatar|sprite|favicon|social|emoji"


def should_continue(answer: Column, done_reason: Column) -> Column:
    """Whether an answer stopped short: by its reason, its last mark, a dangling last word, a one-word bullet or a short last line."""
    t = F.regexp_replace(blank(answer), rf"\A{WS}+|{WS}+\z", "")
    last = F.regexp_replace(F.regexp_extract(t, r"([^\n]*)\z", 1), rf"\A{WS}+|{WS}+\z", "")
    closed = last.rlike(r"[.!?\"'\])}]$")
    dangling = ~closed & F.regexp_extract(F.lower(last), r"([a-z]+)[^a-z]*$", 1).isin(*DANGLING)
    bullet = last.rlike(r"^[-*]\s+[A-Za-z0-9$%]{1,24}$")
    short = (word_count(last) <= 3) & ~closed
    return (F.lower(F.trim(blank(done_reason))) == "length") | ((t != "") & (t.rlike("[:\\-•,]\\z") | dangling | bullet | short))


def image_score(url: Column, alt: Column, width: Column, height: Column) -> Column:
    """Charts and figures score high, large images higher; logos, icons and tiny images low. Null texts are empty."""
    text = F.lower(F.concat_ws(" ", blank(url), blank(alt)))
    w, h = lenient_int(width), lenient_int(height)
    return (
        F.when(text.rlike(IMAGE_GOOD), 4.0).otherwise(0.0)
        - F.when(text.rlike(IMAGE_BAD), 5.0).otherwise(0.0)
        + F.when((w >= 380) | (h >= 250), 1.4).otherwise(0.0)
        - F.when((w != 0) & (h != 0) & (w < 90) & (h < 90), 2.2).otherwise(0.0)
        - F.when(F.lower(blank(url)).endswith(".svg"), 1.5).otherwise(0.0)
    )


def cache_key(model: Column, version: str, prompt: Column) -> Column:
    return F.md5(F.concat(model, F.lit(f"|{version}|"), prompt))


def timeline_object(x: Column) -> Column:
    """The part before in, from, for, where or which, without outer marks."""
    return F.btrim(F.split(normalize_ws(x), r"(?i)\s+(?:in|from|for|where|which)\s+", 2)[0], F.lit(" ,.;:"))


def insight_bullets(x: Column) -> Column:
    """The first eight lines that begin with "- ", "* " or a round bullet, without the mark."""
    lines = F.transform(F.split(blank(x), "\n"), lambda s: F.regexp_replace(s, rf"\A{WS}+|{WS}+\z", ""))
    kept = F.filter(lines, lambda s: s.startswith("- ") | s.startswith("* ") | s.startswith("•"))
    return F.slice(F.transform(kept, lambda s: F.regexp_replace(F.regexp_replace(s, r"\A[-*• ]+", ""), rf"\A{WS}+|{WS}+\z", "")), 1, 8)


def main_answer(x: Column) -> Column:
    strip = lambda s: F.regexp_replace(s, rf"\A{WS}+|{WS}+\z", "")
    return strip(F.split(strip(blank(x)), r"(?i)\n\s*(?:key insights?|insights?)\s*:\s*", 2)[0])


def message_sources(content: Column, figures: Column) -> Column:
    """The marks [Chunk id] and [Graph] of a message and the sources of its figures, in order, each once in any case."""
    marks = F.regexp_extract_all(blank(content), F.lit(r"(?i)\[(?:Chunk\s*[^\]]+|Graph)\]"), 0)
    every = F.concat(marks, F.filter(F.transform(figures, lambda x: F.trim(blank(x))), lambda x: x != ""))
    low = F.transform(every, lambda x: F.lower(F.trim(x)))
    return F.transform(F.filter(every, lambda x, i: F.array_position(low, F.lower(F.trim(x))) == i + 1), lambda x: F.trim(x))


def slim_context(x: Column, most_chars: int = 1800, most_lines: int = 18) -> Column:
    lines = F.filter(F.transform(F.split(blank(x), "\n"), lambda s: F.trim(s)), lambda s: s != "")
    return F.left(F.array_join(F.slice(lines, 1, most_lines), "\n"), F.lit(most_chars))
