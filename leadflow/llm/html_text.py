"""HTML extraction by template deduction from equivalence classes of tokens.

Pages of one host share a template.  A token is a structural tag in its place (the tags above
it with their class and id names) or a block of text in its place.  Its occurrence vector is how
often it stands in each page of the host; tokens with equal vectors form an equivalence class.
Vectors are compared by an additive hash over pages, so a host of any size needs one small row
per token and its pages are never brought together.

A class is valid if it is frequent (in at least half of the host's pages, and in two) and holds a
tag.  Its blocks of text are the template's (three pages at least): they are removed, what is
left stands in the template's slots.  Two exceptions keep text: if template blocks make up more
than ``COPIES`` of a host's text its pages are copies of each other, and a page that holds
nothing else keeps them.

The main slot is the deepest valid token, once per page, outside which all text is the
template's or boilerplate (by element or by ``MARKS``); it is never below an article or main
element.  A page with other text outside takes its own deepest place that holds all of it, so no
page loses text to its host's slot.  A block that stands directly in an article or main element is
the article's, also where all pages share it.  A marked element inside an article or main element, or
inside a main slot other than the body, counts as text unless its class makes it the template's; but
reader comments, forms to sign up, adverts and the like (``NEVER``) go wherever they stand, unless
they hold more text than the rest of the page (then the name belongs to the page's frame).

Cases: null or empty html, or no running text, gives an empty text.  A null url or one without
a host shares the empty host.  Broken markup: unclosed tags end with their parent, stray end
tags are ignored, a cut tag at the end is dropped.  Repeated rows are extracted each; null ids
are carried.  An empty table gives no rows.  Only the id, url and html columns are read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import broadcast_if_small, materialise
from .url_filter import url_host

MAX_BROADCAST_HOSTS = 200_000
MAX_BROADCAST_TOKENS = 4_000_000       # 8 bytes each, over all hosts
COPIES = 0.8               # share of a host's text from which on what its pages share is no template
TEMPLATE_PAGES = 3         # that a block of text is in at least to be the template's; two in a marked element
FREQUENT = 0.5             # share of a host's pages that a valid class is in at least

#: Tags by role.
RAW = frozenset("script style noscript template textarea title iframe svg math".split())
BOILERPLATE = frozenset("nav aside footer form button select dialog head".split())
STRUCTURE = frozenset("html head body main article section div header footer nav aside form table ul ol dl "
                      "figure details dialog select button fieldset center".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby "
                   "s samp small span strike strong sub sup time tt u var wbr nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class and id names that mark menus, notices, adverts, reader comments and the like.
MARKS = frozenset("ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner sidebar menu "
                  "nav navbar navigation breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice "
                  "notices alert popup modal overlay newsletter subscribe signup login share sharing social related "
                  "recommended comment comments commentlist disqus replies respond pagination pager widget".split())
#: Those of them that are no article text inside an article either.
NEVER = frozenset("ad ads advert advertisement adverts advertising sponsor sponsored promo promotion cookie cookies consent gdpr "
                  "newsletter subscribe signup login comment comments commentlist disqus replies respond".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
                    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>"""
                    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)([^>]*)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_BELOW_MAIN = r">(?:article|main)(?:\.[^>]*)?>"
_IS_MAIN = r">(?:article|main)(?:\.[^>]*)?$"


def text_token(place: str, block: str) -> int:
    """A block of text in its place, as a signed long."""
    h = xxhash.xxh64_intdigest(f"{place}\0{block}".encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


class Page:
    """One parse of a page: for every structural place how often it stands there and how much
    running text is below it; the blocks of text with the places above them and the outermost
    marked place among these, if any (marked blocks do not count as running text)."""

    def __init__(self, source: str):
        self.places: dict[str, list[int]] = {"": [1, 0]}
        self.blocks: list[tuple[tuple[str, ...], str, str | None]] = []
        self.stack: list[tuple[str, str, bool, str | None]] = []        # tag, place, boilerplate and mark above it
        self.above: tuple[str, ...] = ("",)
        self.skip, self.mark, self.open = False, None, []
        at, n = 0, len(source)
        while at < n:
            m = _TOKEN.search(source, at)
            if not m:
                self.text(source[at:])
                break
            self.text(source[at:m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                self.close(tag)
            elif tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else n
                self.flush() if tag not in INLINE else None
            else:
                attributes = m[3] or m[6] or ""
                self.start(tag, attributes, attributes.endswith("/"))
        self.flush()

    def text(self, raw: str) -> None:
        if raw and not self.skip:
            self.open.append(raw)

    def flush(self) -> None:
        if self.open:
            block = " ".join(entities.unescape("".join(self.open)).split())
            self.open = []
            if block:
                self.blocks.append((self.above, block, self.mark))
                for place in set(self.above) if self.mark is None else ():
                    self.places[place][1] += len(block)

    def start(self, tag: str, attributes: str, empty: bool) -> None:
        if tag not in INLINE:
            self.flush()
        if tag not in STRUCTURE or empty or tag in VOID:
            return
        names = " ".join(" ".join(g for g in m.groups()[1:] if g) for m in _NAMES.finditer(attributes)) if attributes else ""
        words = {w.lower() for w in _WORD.findall(names)}
        parent = self.stack[-1][1] if self.stack else ""
        place = f"{parent}>{tag}" + "".join("." + w for w in sorted(words))
        skip = self.skip or tag in BOILERPLATE or (
            tag == "header" and not any(t in ("article", "main") for t, *_ in self.stack))
        self.stack.append((tag, place, self.skip, self.mark))
        self.skip = skip
        if self.mark is None and tag not in ("html", "body", "main", "article") and not words.isdisjoint(MARKS):
            self.mark = place
        self.places.setdefault(place, [0, 0])[0] += 1
        self.above += (place,)

    def close(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        if tag in STRUCTURE and any(t == tag for t, *_ in self.stack):
            while self.stack:
                t, _, self.skip, self.mark = self.stack.pop()
                self.above = self.above[:-1]
                if t == tag:
                    break

    def texts(self) -> dict[int, list]:
        """Text token -> [place, times, running characters]."""
        out: dict[int, list] = {}
        for above, block, mark in self.blocks:
            t = out.setdefault(text_token(above[-1], block), [above[-1], 0, 0])
            t[1] += 1
            t[2] += len(block) if mark is None else 0
        return out

    def main(self, blocks: list[tuple[str, ...]]) -> str:
        """The deepest place, once in the page and not below an article or main element, above all ``blocks``."""
        shared = set(blocks[0]).intersection(*blocks[1:]) if blocks else {""}
        return max((p for p in shared if self.places[p][0] == 1 and not re.search(_BELOW_MAIN, p)),
                   key=lambda p: p.count(">"), default="")

    def extract(self, main: str | None, template: frozenset[int] = frozenset()) -> str:
        """All running text but the template's, and marked elements inside the main slot that are not the template's."""
        gone = [bool(template) and text_token(above[-1], block) in template and not re.search(_IS_MAIN, above[-1])
                for above, block, _ in self.blocks]
        never = [mark is not None and not NEVER.isdisjoint(mark.rsplit(">", 1)[-1].split(".")[1:]) for _, _, mark in self.blocks]
        if sum(len(block) for (_, block, _), x in zip(self.blocks, never) if x) <= self.places[""][1]:
            gone = [g or x for g, x in zip(gone, never)]
        running = [above for (above, _, mark), g in zip(self.blocks, gone) if mark is None and not g]
        if not running:                                     # a page of nothing but shared text
            gone = [g and mark is not None for (_, _, mark), g in zip(self.blocks, gone)]
            running = [above for above, _, mark in self.blocks if mark is None]
        if main is None or self.places.get(main, (0, 0))[0] != 1 or not all(main in above for above in running):
            main = self.main(running)
        inside = running and main.rsplit(">", 1)[-1].split(".")[0] not in ("", "html", "body")
        return "\n".join(block for (above, block, mark), g in zip(self.blocks, gone) if not g and (
            mark is None or re.search(_BELOW_MAIN, mark) or (inside and mark.startswith(main + ">"))))


def token_rows(pages: DataFrame) -> DataFrame:
    """(host, place, text, page, times, chars, whole) for every structural place (``text`` is null)
    and every block of text of every page; ``whole`` is the page's running text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for host, page, source in zip(*(b.column(i).to_pylist() for i in range(3))):
                parsed = Page(source)
                whole = parsed.places[""][1]
                out += [(host, p, None, page, times, chars, whole) for p, (times, chars) in parsed.places.items()]
                out += [(host, p, t, page, times, chars, whole) for t, (p, times, chars) in parsed.texts().items()]
            cols = zip(*out) if out else ((),) * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if i < 2 else pa.int64()) for i, c in enumerate(cols)],
                ["host", "place", "text", "page", "times", "chars", "whole"])

    return pages.mapInArrow(run, "host string, place string, text long, page long, times long, chars long, whole long")


def host_templates(tokens: DataFrame) -> DataFrame:
    """(host, main, template): the main slot of each host with two pages or more, and the text
    tokens of its template."""
    h = F.xxhash64("page", "times")
    vectors = materialise(tokens.groupBy("host", "place", "text").agg(
        F.sum(F.shiftright(h, 32)).alias("v1"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("v2"),
        F.count(F.lit(1)).alias("pages"), F.max("times").alias("most"), F.sum("chars").alias("chars"),
        F.sum("whole").alias("whole")).where("text is null or pages >= 2"), "vectors")
    root = vectors.where("place = '' and text is null").select(
        "host", F.col("pages").alias("host_pages"), F.col("whole").alias("host_whole"))
    frequent = vectors.join(root, "host").where((F.col("pages") >= 2) & (F.col("pages") >= FREQUENT * F.col("host_pages")))
    tags, texts = frequent.where("text is null"), frequent.where("text is not null")
    valid = texts.where(~F.regexp_like("place", F.lit(_IS_MAIN))).join(
        tags.select("host", "v1", "v2").distinct(), ["host", "v1", "v2"]).where(
        (F.col("chars") == 0) | (F.col("pages") >= TEMPLATE_PAGES))
    found = valid.groupBy("host").agg(F.sum("chars").alias("shared"), F.max("host_whole").alias("of"),
                                      F.collect_list(F.struct("text", "place", "chars")).alias("t"))
    found = found.select("host", F.when(F.col("shared") > COPIES * F.col("of"), F.filter("t", lambda x: x["chars"] == 0))
                         .otherwise(F.col("t")).alias("t"))
    at = tags.where((F.col("most") == 1) & ~F.regexp_like("place", F.lit(_BELOW_MAIN))).join(found, "host", "left")
    outside = F.aggregate(F.coalesce("t", F.expr("cast(array() as array<struct<text:bigint,place:string,chars:bigint>>)")),
                          F.lit(0).cast("long"), lambda a, x: a + F.when(
        (x["place"] == F.col("place")) | F.startswith(x["place"], F.concat("place", F.lit(">"))), F.lit(0)).otherwise(x["chars"]))
    holds = at.where(F.col("whole") - F.col("chars") <= outside)
    depth = F.size(F.split("place", ">"))
    return holds.groupBy("host").agg(F.max_by("place", F.struct(depth, "place")).alias("main"),
                                     F.first(F.col("t.text")).alias("template"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [Page(source).extract(main, frozenset(template or ()))
                     for source, main, template in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("html"), url_host(F.col(url_col)).alias("host"))
    tokens = token_rows(rows.select("host", F.xxhash64("page_id", "url").alias("page"), "html"))
    templates = materialise(host_templates(tokens), "templates")
    held = templates.agg(F.sum(F.coalesce(F.size("template"), F.lit(0)))).first()[0] or 0
    templates = broadcast_if_small(templates, MAX_BROADCAST_HOSTS if held <= MAX_BROADCAST_TOKENS else -1)
    return (rows.join(templates, "host", "left").select("page_id", "url", "html", "main", "template")
            .mapInArrow(run, "page_id long, url string, text string, n_chars long"))
