"""Web pages and URL lists as tables. Pages arrive as rows (url, html); nothing is fetched here."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import WS, blank, image_score, lenient_int, normalize_url
from factloom.session import spread

_DROP = {"script", "style", "noscript", "header", "footer", "nav", "aside", "form"}
_BLOCKS = {"h1", "h2", "h3", "p", "li", "td", "th"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Page(HTMLParser):
    """Collects blocks in document order. Tags that are never closed nest, so an outer block holds the text of inner ones."""

    def __init__(self, most: int):
        super().__init__(convert_charrefs=True)
        self.most, self.open, self.skip = most, [], 0
        self.title = self.summary = ""
        self.in_title = False
        self.blocks: list[tuple[bool, list[str]]] = []
        self.active: list[list[str]] = []
        self.images: list[dict] = []
        self.mains = 0

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and a.get("name", "").lower() == "description":
            self.summary = a.get("content", "")
        if tag == "img" and len(self.images) < 600:
            self.images.append(a)
        if tag in _VOID:
            return
        self.open.append(tag)
        self.skip += tag in _DROP
        self.mains += tag == "main"
        self.in_title |= tag == "title"
        if tag in _BLOCKS and not self.skip and len(self.blocks) < self.most:
            self.blocks.append(("main" in self.open, []))
            self.active.append(self.blocks[-1][1])

    def handle_endtag(self, tag):
        if tag not in self.open:
            return
        while self.open:
            t = self.open.pop()
            self.skip -= t in _DROP
            if t == "title":
                self.in_title = False
            if t in _BLOCKS and not self.skip and self.active:
                self.active.pop()
            if t == tag:
                break

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            for block in self.active:
                block.append(data)


def _read(html: str | None, most: int) -> _Page:
    page = _Page(most)
    page.feed(html or "")
    page.close()
    return page


def html_blocks(pages: DataFrame, most: int = 3500) -> DataFrame:
    """(url, n, block): "Title: ...", "Summary: ..." and then the text of headings, paragraphs, items and cells, of <main> if there is one."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for url, html in zip(pdf["url"], pdf["html"]):
                p = _read(html, most)
                texts = [" ".join(" ".join(parts).split()) for main, parts in p.blocks if main or not p.mains]  # parts of a block stand apart
                head = [f"{k}: {' '.join(v.split())}" for k, v in (("Title", p.title), ("Summary", p.summary)) if v.strip()]
                out += [(url, n, t) for n, t in enumerate([*head, *(t for t in texts if t)])]
            yield pd.DataFrame(out, columns=["url", "n", "block"])

    return spread(pages.select("url", "html")).mapInPandas(parse, "url string, n int, block string")


def plain_text(html: F.Column) -> F.Column:
    """The fallback without a parser: script and style dropped, tags as spaces, squeezed."""
    x = F.regexp_replace(blank(html), r"(?is)<script.*?</script>|<style.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]+>", " "), WS + "+", " "))


def text_segments(blocks: DataFrame, most_chars: int = 2500, least: int = 70, least_whole: int = 10) -> DataFrame:
    """(url, segment, text): neighbouring blocks packed into segments; short ones only if they are a title or summary; no block twice.

    A page of short blocks only is one segment of all of them, if that has least_whole characters.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        url, held, size, number = None, [], 0, 0
        for pdf in batches:
            out = []
            for u, t in zip(pdf["url"], pdf["block"]):
                if u != url or (held and size + len(t) + 1 > most_chars):
                    if held:
                        out.append((url, number, "\n".join(held)))
                    size = 0 if u != url else -1  # the first block after a full segment counts without its line break
                    number = 0 if u != url else number + 1
                    url, held = u, []
                held.append(t)
                size += len(t) + 1
            yield pd.DataFrame(out, columns=["url", "segment", "text"])
        yield pd.DataFrame([(url, number, "\n".join(held))] if held else [], columns=["url", "segment", "text"])

    low = F.lower("block")
    kept = blocks.where((F.length("block") >= least) | low.startswith("title:") | low.startswith("summary:"))
    # squeezed, as one block
    short = blocks.join(kept.select("url").distinct(), "url", "left_anti").groupBy("url").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]), " ").alias("block"))
    kept = kept.select("url", "n", "block").unionByName(short.where(F.length("block") >= least_whole).select("url", F.lit(0).alias("n"), "block"))
    first = kept.groupBy("url", low.alias("low")).agg(F.min_by("block", "n").alias("block"), F.min("n").alias("n"))
    return first.repartition("url").sortWithinPartitions("url", "n").select("url", "block").mapInPandas(fold, "url string, segment int, text string")


def image_candidates(pages: DataFrame, most: int = 20) -> DataFrame:
    """(url, src, alt, width, height, score, rank): absolute, distinct images of a page by score.

    Those over 0 up to three times `most`, or else the best of the page up to twice `most`, as a shortlist to fetch from.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for url, html in zip(pdf["url"], pdf["html"]):
                for n, a in enumerate(_read(html, 3500).images):
                    src = (a.get("src") or a.get("data-src") or a.get("data-original") or "").strip()
                    if src and not src.startswith("data:"):
                        out.append((url, n, urljoin(url or "", src), " ".join(a.get("alt", "").split()), a.get("width", ""), a.get("height", "")))
            yield pd.DataFrame(out, columns=["url", "n", "src", "alt", "width", "height"])

    rows = spread(pages.select("url", "html")).mapInPandas(parse, "url string, n int, src string, alt string, width string, height string")
    rows = rows.groupBy("url", "src").agg(F.min("n").alias("n"), *(F.min_by(c, "n").alias(c) for c in ("alt", "width", "height")))
    return shortlist(rows.withColumn("score", image_score(F.col("src"), F.col("alt"), F.col("width"), F.col("height"))), most)


def shortlist(rows: DataFrame, most: int = 20) -> DataFrame:
    """Images by score: those over 0, three times `most` at most; a page without any gives its best, twice `most` at most."""
    w = Window.partitionBy("url").orderBy(F.desc("score"), "n")
    rows = rows.withColumn("rank", F.row_number().over(w)).withColumn("best", F.max("score").over(Window.partitionBy("url")))
    keep = F.when(F.col("best") > 0, (F.col("score") > 0) & (F.col("rank") <= 3 * most)).otherwise(F.col("rank") <= 2 * most)
    return rows.where(keep).select("url", "src", "alt", lenient_int(F.col("width")).alias("width"), lenient_int(F.col("height")).alias("height"), "score", "rank")


def url_list(rows: DataFrame) -> DataFrame:
    """(id, n, url): normalised distinct URLs of rows (id, text), one a line; the first of each in any case stays."""
    each = rows.select("id", F.posexplode(F.split(blank(F.col("text")), "\n")).alias("n", "raw")).withColumn("url", normalize_url(F.col("raw"))).where("url != ''")
    first = each.groupBy("id", F.lower("url").alias("low")).agg(F.min(F.struct("n", "url")).alias("f"))
    return first.select("id", F.col("f.n").alias("n"), F.col("f.url").alias("url"))


def page_profiles(pages: DataFrame) -> DataFrame:
    """(source_id, pages, total_chars, short_pages) of page texts; images of pages come from a reader that is plugged in."""
    n = F.length(F.trim(blank(F.col("text"))))
    return pages.groupBy("source_id").agg(F.count(F.lit(1)).alias("pages"), F.sum(n).cast("long").alias("total_chars"), F.count_if(n < 40).alias("short_pages"))
