"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged: an element is known by its path of tags and classes (without numbers),
and over the pages that have it the tree counts what its children look like and what its
branch says.  The entropy of both counts is the importance of the branch: what looks and
reads alike on every page is furniture.  Elements whose tag, class or role says what they
are (a menu, a form, an advert) need no statistics; an article that is marked bounds the text,
and branches of low importance are cut inside it as on pages that mark none.

The first pass emits two hashes per element and page, summed by (host, path, hash) before
any shuffle; so a host with a third of all pages is spread over its paths and contents.
The second pass cuts each page where it lies: the low branches are sent to the tasks while
they are few, else pages meet them by host.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plan_bytes, query, read, written

#: A branch on at least so many pages of its host with an importance below this is cut.
PAGES, IMPORTANCE = 3, 0.3
#: Weight of the content's entropy beside that of the presentation.
CONTENT = 0.9
#: Low branches (bytes as written) that are sent to every task.
BRANCH_BOUND = 8 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
NOISE_TAGS = frozenset("aside button dialog footer form head header iframe menu nav noscript object script select style svg template textarea title".split())
#: Elements that show nothing themselves: the words around them are one text.
HIDDEN = frozenset("noscript script style svg template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOISE_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer header menu nav navbar navigation newsletter notice notices pager pagination popup promo related respond share sharing sidebar social sponsor sponsored subscribe widget".split()
)
MAIN_WORDS = frozenset("article content entry main post story".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS = frozenset("ul ol dl table select".split())


class Page(HTMLParser):
    """One pass over a page: blocks of text with their role, and the elements' paths."""

    def __init__(self, low: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.low = low
        # of each open element: tag, path, noise, rank of main (2 by tag, 1 by class), low, and whether its own text is passed over
        self.open: list[tuple[str, int, bool, int, bool, bool]] = [("", 0, False, 0, False, False)]
        self.text: list[str] = []
        self.blocks: list[tuple[int, bool, bool, str]] = []
        self.shapes: dict[int, list[str]] = {}
        self.says: dict[int, list[str]] = {}

    def flush(self) -> None:
        if self.text:
            words = " ".join("".join(self.text).split())
            self.text.clear()
            _, _, noise, main, low, _ = next(e for e in reversed(self.open) if not e[5])
            if words:
                for _, path, *_ in self.open[1:]:
                    self.says.setdefault(path, []).append(words)
                self.blocks.append((main, low, noise, words))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        _, path, noise, main, low, passed = self.open[-1]
        inside = passed and any(e[0] in HIDDEN for e in self.open)
        if tag in VOID:
            if tag not in INLINE and not inside:
                self.flush()
            return
        if inside or tag in HIDDEN:
            self.open.append((tag, path, noise, main, low, True))
            return
        if tag in INLINE:
            # inline elements stay out of the tree, but may be noise themselves
            self.open.append((tag, path, noise, main, low, passed or (not noise and bool(names_of(attrs) & NOISE_WORDS))))
            return
        self.flush()
        self.close_implied(tag)
        _, path, noise, main, low, passed = self.open[-1]
        noise = noise or passed
        words = names_of(attrs)
        if tag in ("article", "main"):
            noise, main = noise or bool(words & {"comment", "comments"}), 2
        elif tag not in ("html", "body"):
            noise = noise or tag in NOISE_TAGS or bool(words & NOISE_WORDS)
            main = max(main, 1) if words & MAIN_WORDS else main
        # ids and numbers tell a page's elements from those of other pages
        step = ".".join([tag, *sorted(w for w in names_of(attrs, ("class",)) if not any(map(str.isdigit, w)))])
        self.shapes.setdefault(path, []).append(step)
        path = digest(f"{path}/{step}")
        self.shapes.setdefault(path, [])
        # a heading that many pages share still heads its own article
        self.open.append((tag, path, noise, main, low or (path in self.low and not (main == 2 and tag in HEADINGS)), False))

    def close_implied(self, tag: str) -> None:
        """A new block ends an open paragraph, a new item the one before it."""
        ends = CLOSES.get(tag, ())
        for i in range(len(self.open) - 1, 0, -1):
            name = self.open[i][0]
            if name == "p" or name in ends:
                del self.open[i:]
                return
            if name not in INLINE and (not ends or name in HOLDS):
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # in HTML a slash does not close an element

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                if tag not in INLINE and not self.open[i][5]:
                    self.flush()
                del self.open[i:]
                return
            if tag in INLINE and self.open[i][0] not in INLINE:
                return
        if tag not in INLINE and not self.open[-1][5]:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.open[-1][5]:
            self.text.append(data)

    def read(self, html: str) -> Page:
        self.feed(html)
        self.close()
        self.flush()
        return self


def digest(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def names_of(attrs: list[tuple[str, str | None]], keys: tuple[str, ...] = ("class", "id", "role")) -> set[str]:
    return {w for k, v in attrs if k in keys and v for w in re.split(r"[^a-z0-9]+", v.lower()) if w}


def main_text(html: str, low: frozenset[int] = frozenset()) -> tuple[str, int, int, int]:
    """The text, its blocks, the blocks cut for low importance, and those the lists alone cut.

    The tree judges first: a low branch goes, whatever its elements are called.  Of what it
    leaves, elements that the lists name go.  Blocks inside article or main elements count if these hold at least half of the page's
    words, else those inside elements named like one if these do, else all; low
    branches are not counted, and are cut.  Where nothing else is inside, they count and stay.
    """
    every = Page(low).read(html).blocks
    by_tree = sum(cut and noise for _, cut, noise, _ in every)
    by_lists = sum(noise and not cut for _, cut, noise, _ in every)
    plain = [(main, cut, text) for main, cut, noise, text in every if not noise]
    words = [len(text.split()) for *_, text in plain]
    for mark in (2, 1, 0):
        blocks = [(cut, text) for main, cut, text in plain if main >= mark]
        inside = [(n, cut) for n, (main, cut, _) in zip(words, plain, strict=True) if main >= mark]
        inside = sum(n for n, cut in inside if not cut) or sum(n for n, _ in inside)
        outside = sum(n for n, (main, cut, _) in zip(words, plain, strict=True) if main < mark and not cut)
        if blocks and inside >= outside:
            break
    kept = [b for b in blocks if not b[0]] or blocks
    return " ".join(t for _, t in kept), len(kept), by_tree + len(blocks) - len(kept), by_lists


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[^:]*://([^/?#]*)", 1)), F.lit(""))


def style_tree(pages: DataFrame) -> DataFrame:
    """``host, path, pages, importance`` of every element of the merged trees of ``host, html``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, paths, kinds, values = [], [], [], []
            for host, html in zip(b.column(0), b.column(1), strict=True):
                page = Page().read(html.as_py() or "")
                for path, steps in page.shapes.items():
                    for kind, parts in enumerate((steps, page.says.get(path, []))):
                        hosts.append(host.as_py())
                        paths.append(path)
                        kinds.append(kind)
                        values.append(digest("\n".join(parts)))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.int64()), pa.array(kinds, pa.int32()), pa.array(values, pa.int64())], ["host", "path", "kind", "value"])

    seen = pages.select("host", "html").mapInArrow(run, "host string, path long, kind int, value long")
    counts = seen.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("c"))
    sums = counts.groupBy("host", "path", "kind").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("cl"))
    entropy = F.when(F.col("m") > 1, F.lit(1.0) - F.col("cl") / (F.col("m") * F.log("m"))).otherwise(F.lit(1.0))
    weight = F.when(F.col("kind") == 1, F.lit(CONTENT)).otherwise(F.lit(1 - CONTENT))
    return sums.groupBy("host", "path").agg(F.max("m").alias("pages"), F.sum(weight * entropy).alias("importance"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, n_blocks, n_cut, n_listed`` of every row of ``pages``.

    ``n_cut`` blocks went because the site style tree finds them alike on the host's pages,
    ``n_listed`` more because a tag or class names them; ``n_blocks`` are left.

    Character references are decoded, white space inside a block becomes one space, blocks
    are joined in page order by one space.  A null or empty page gives an empty text, a null
    url belongs to the empty host, repeated pages stay, an empty table gives no rows; other
    columns are not read.
    """
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    low = written(style_tree(rows).where((F.col("pages") >= PAGES) & (F.col("importance") < IMPORTANCE) & (F.col("path") != 0)).groupBy("host").agg(F.collect_list("path").alias("low")))
    if plan_bytes(low) <= BRANCH_BOUND:
        sent = pages.sparkSession.sparkContext.broadcast({r.host: frozenset(r.low) for r in low.collect()})
        met = rows.select("page_id", "url", "html", "host")
    else:
        sent = None
        met = rows.join(low, "host", "left").select("page_id", "url", "html", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value if sent is not None else None
        none: frozenset[int] = frozenset()
        for b in batches:
            out = []
            for html, key in zip(b.column(2), b.column(3), strict=True):
                key = key.as_py()
                cut = known.get(key, none) if known is not None else frozenset(key or ())
                out.append(main_text(html.as_py() or "", cut))
            cols = [pa.array([x[0] for x in out], pa.string()), *[pa.array(v, pa.int64()) for v in ([len(x[0]) for x in out], *[[x[i] for x in out] for i in (1, 2, 3)])]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["page_id", "url", "text", "n_chars", "n_blocks", "n_cut", "n_listed"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return met.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, n_blocks long, n_cut long, n_listed long")


@query("op5_html_extract")
def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
