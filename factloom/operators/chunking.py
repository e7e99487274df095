"""Pages cut into sections, word windows and character windows."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import NOT_WS, WS, normalize_ws
from factloom.session import spread

#: Words of a window and of its overlap with the next, by profile and track. Fixed values.
PROFILES = {
    "fast": {"ex": (190, 24), "re": (330, 46)},
    "balanced": {"ex": (220, 30), "re": (400, 56)},
    "quality": {"ex": (250, 36), "re": (470, 68)},
}


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{WS}+|{WS}+$", "")


_HEAD = re.compile(r"(\d+(?:\.\d+)*|Q[1-4]|FY\d{2})\b", re.I)
_TITLE = re.compile(r"[A-Z][A-Za-z0-9 &/\-]{2,60}")
_WORD = re.compile(r"\S+")
_SPACE = re.compile(r"\s+")


def is_heading(line: str) -> bool:
    """looks_like_heading() for code that goes through lines."""
    raw = line.strip()
    if not raw or len(raw) > 110:
        return False
    if _HEAD.match(raw):
        return True
    words = len(raw.split())
    return (raw.endswith(":") and words <= 12) or (raw.isupper() and 2 <= words <= 12) or (bool(_TITLE.fullmatch(raw)) and words <= 10)


def split_sections(text: str) -> list[tuple[str, str, int, int]]:
    """(title, body, start, end) of the lines between headings, under the last heading; empty ones are left out.

    start is the place of the heading, end that of the next one. Without a section the whole text is one, titled "Section".
    """
    if not text.strip():
        return []
    out, title, start, first, at = [], "Section", 0, 0, 0
    for line in text.split("\n"):
        if is_heading(line):
            if body := text[first:at].strip():
                out.append((title, body, start, at))
            title, start, first = _SPACE.sub(" ", line).strip(), at, at + len(line) + 1
        at += len(line) + 1
    if body := text[first:].strip():
        out.append((title, body, start, len(text)))
    return out or [("Section", text, 0, len(text))]


def word_spans(text: str, target: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of windows of target words, the next one starting target - overlap words on; the last holds the last word."""
    words = [m.span() for m in _WORD.finditer(text)]
    stride = max(1, target - overlap)
    last = max(0, -(-(len(words) - target) // stride)) if words else -1
    return [(words[i * stride][0], words[min(i * stride + target, len(words)) - 1][1]) for i in range(last + 1)]


def sections(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, section, title, body, start, end) of pages, see split_sections. Null and blank texts give none. No page is shuffled."""
    rows = spread(pages.select(*keys, "text").where("text IS NOT NULL"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(*ids, i, *s) for *ids, t in pdf.itertuples(index=False) for i, s in enumerate(split_sections(t))]
            yield pd.DataFrame(out, columns=[*keys, "section", "title", "body", "start", "end"])

    kinds = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInPandas(split, f"{kinds}, section int, title string, body string, start int, end int")


def word_windows(df: DataFrame, keys: list[str], target: int, overlap: int, text: str = "text") -> DataFrame:
    """(keys, idx, part): windows of target words, the next one starting target - overlap words on.

    The words are found once; each window is the text from its first to its last word, by their places.
    """
    stride = max(1, target - overlap)
    # words with the white space before them, so that windows are cut from the text unchanged
    words = df.withColumn("w", F.regexp_extract_all(text, F.lit(f"{WS}*{NOT_WS}+"), 0)).where(F.size("w") > 0)
    last = lambda w: F.greatest(F.lit(0), F.ceil((F.size(w) - target) / F.lit(float(stride))).cast("int"))
    parts = F.get(F.transform(F.array("w"), lambda w: F.transform(F.sequence(F.lit(0), last(w)), lambda i: strip(F.array_join(F.slice(w, i * stride + 1, F.lit(target)), "")))), F.lit(0))
    return words.select(*keys, F.posexplode(parts).alias("idx", "part"))


def build_chunks(pages: DataFrame, profile: str = "balanced", least: int = 40, now: str | None = None) -> DataFrame:
    """The chunk records of pages (source_id, page, text, and is_vision if there is such a column), both tracks in one pass.

    (track, source_id, page, chunk_id, section_title, char_start, char_end, is_vision, created_at, idx, text). Pages shorter than `least`
    characters and null ones are left out. Chunks are counted over the sections of a page; the id names the source, the page, the
    number and the beginning of the text; places count from the start of the section's heading. No page is shuffled.
    """
    at = now or datetime.now(timezone.utc).isoformat()
    profiles = PROFILES[profile]
    vision = F.col("is_vision") if "is_vision" in pages.columns else F.lit(False)
    rows = spread(pages.select("source_id", F.col("page").cast("long").alias("page"), vision.alias("is_vision"), "text").where("text IS NOT NULL"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for source, page, seen, text in pdf.itertuples(index=False):
                text = text.strip()
                if len(text) < least:
                    continue
                cut = split_sections(text)
                for track, (target, overlap) in profiles.items():
                    n = 0
                    for title, body, start, _ in cut:
                        for a, b in word_spans(body, target, overlap):
                            part = body[a:b]
                            digest = hashlib.md5(f"{source}|{n}|{page}|{track}|{part[:140]}".encode()).hexdigest()[:10]
                            out.append((track, source, page, f"{track}-{page + 1}-{n + 1}-{digest}", title, start + a, start + b, seen, at, n, part))
                            n += 1
            yield pd.DataFrame(out, columns=["track", "source_id", "page", "chunk_id", "section_title", "char_start", "char_end", "is_vision", "created_at", "idx", "text"])

    return rows.mapInPandas(build, "track string, source_id string, page long, chunk_id string, section_title string, char_start int, char_end int, is_vision boolean, created_at string, idx int, text string")


def char_windows(pages: DataFrame, keys: list[str], page: str, size: int = 900, overlap: int = 160, least: int = 80, most_parts: int = 14) -> DataFrame:
    """(keys, part, text): windows of characters of squeezed pages of some length, the first most_parts of each, short ones left out.

    Each begins with its label, [Page i | Part j], pages counted from 0 in the column page.
    """
    step = size - overlap
    rows = pages.withColumn("t", normalize_ws(F.col("text"))).where(F.length("t") >= least)
    last = lambda t: F.least(F.greatest(F.lit(0), F.ceil((F.length(t) - size) / F.lit(float(step))).cast("int")), F.lit(most_parts - 1))
    parts = F.get(F.transform(F.array("t"), lambda t: F.transform(F.sequence(F.lit(0), last(t)), lambda i: F.trim(F.substr(t, i * step + 1, F.lit(size))))), F.lit(0))
    rows = rows.select(*keys, F.col(page).alias("_page"), F.posexplode(parts).alias("part", "text")).where(F.length("text") >= least)
    label = F.concat(F.lit("[Page "), (F.col("_page") + 1).cast("string"), F.lit(" | Part "), (F.col("part") + 1).cast("string"), F.lit("] "))
    return rows.select(*keys, "part", F.concat(label, "text").alias("text"))


def page_batches(pages: DataFrame, most_chars: int = 2800, most_pages: int = 3, least: int = 80) -> DataFrame:
    """(source_id, batch, label, first_page, last_page, pages, text): neighbouring pages joined while they fit, each under its mark [Page n].

    Pages are counted from 0 and shown from 1; shorter ones are passed over. A fold in page order: pages are sorted within partitions and
    streamed, and only the open batch is held.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, total, texts, places, number = None, 0, [], [], 0

        def give() -> list[tuple]:
            if not texts:
                return []
            label = f"text batch pages {places[0] + 1}-{places[-1] + 1}/{total}"
            return [(source, number, label, places[0], places[-1], len(places), "\n\n".join(f"[Page {p + 1}]\n{t}" for p, t in zip(places, texts)))]

        columns = ["source_id", "batch", "label", "first_page", "last_page", "pages", "text"]
        for pdf in batches:
            out = []
            for s, p, t, n in zip(pdf["source_id"], pdf["page"], pdf["text"], pdf["total"]):
                full = texts and (len(texts) >= most_pages or sum(map(len, texts)) + len(t) > most_chars)
                if s != source or full:
                    out += give()
                    number = 0 if s != source else number + 1
                    source, total, texts, places = s, n, [], []
                texts.append(t), places.append(p)
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(give(), columns=columns)

    rows = pages.select("source_id", F.col("page").cast("long").alias("page"), strip(F.coalesce("text", F.lit(""))).alias("text")).where(F.col("source_id").isNotNull())
    totals = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("total"))
    rows = rows.where(F.length("text") >= least).join(totals, "source_id")
    kinds = "source_id string, batch int, label string, first_page long, last_page long, pages int, text string"
    return rows.repartition("source_id").sortWithinPartitions("source_id", "page").select("source_id", "page", "text", "total").mapInPandas(fold, kinds)


def vision_pages(pages: DataFrame, text_limit: int, most_pages: int) -> DataFrame:
    """Pages with an image or little text, (source_id, page, has_image, text_len, rank): images first, then the shortest."""
    w = Window.partitionBy("source_id").orderBy(F.desc("has_image"), "text_len", "page")
    return pages.where(F.col("has_image") | (F.col("text_len") <= text_limit)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most_pages)
