"""Main text of web pages by differencing against the nearest URL, with structure.

A page is parsed once, into lines, one per block, and each line gets a mark from
the elements around it: furniture (menus, headers, footers, sidebars, adverts,
forms, reader comments), inside an article or main element, open (neither), or
doubtful, where only a class name such as ``share`` or ``side-story`` hints at
furniture. Pages of one host are put in order of their URL path, each page is
paired with the neighbour whose path shares the longer beginning, and all lines
of the two, furniture and article lines too, are aligned by longest common
subsequence. Shared lines are deleted, but for lines inside an article that no
name puts in doubt: nearest pages are often copies of one article, which would
delete each other, and sentences that two articles share belong to both. Of the
lines that are not shared, furniture goes by its mark, and open lines go where
the page has an article element. So differencing alone decides on pages without
such an element and on doubtful lines; ``n_shared`` counts what it deletes.

Neighbours are found by rank in one global order of (host, path), so a host
with a third of all pages is spread like any other; only hashes of lines travel.
Pages with one path are one page for pairing; pages without a host have no
neighbour. Alignment takes memory in proportion to the lines of a page, however
many there are. Null html is an empty page; an empty table gives no rows; a very
long page is parsed whole by one task. Repeated rows get equal texts. Extra
columns are ignored.

A name tells of furniture by any of its parts, unless another part says that the
page is with, without or free of such a block. An article element ends the mark of
a form around it, a main element that of anything.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices

BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
FURNITURE = set("nav header footer aside form menu dialog".split())
NO_TEXT = set("script style noscript template title head button select option textarea iframe svg object".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
ARTICLE = {"article", "main"}
CLOSES = {"p": set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": {"li"}, "option": {"option"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "head": {"body"}}
SURE = re.compile(r"(?:^|[_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|sidebar|breadcrumbs?|cookies?|consent|popup|modal|newsletter|comments?|replies|disqus|pagination)(?=$|[_-])", re.I)
"""Names of blocks that are never text, though no other page may share them."""
COMMENT = re.compile(r"(?:^|[_-])comments?(?=$|[_-])", re.I)
DOUBTFUL = re.compile(r"(?:^|[_-])(?:banner|side|menu|nav\w*|footer|header|masthead|notices?|alert|subscribe|signup|share|social|related|widget|pager|skip)(?=$|[_-])", re.I)
"""Names of blocks that are furniture only if the nearest page has the same lines."""
NOT_SO = set("no not non without with has had hide hides hidden show shows is free open closed none off on enabled disabled".split())
"""Parts of a name that tell that it describes a page with or without such a block, and is not one."""
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu"}
OPEN, INSIDE, DOUBT, DOUBT_INSIDE, GONE, NONE = range(6)


def _named(pattern: re.Pattern, names: list[str]) -> bool:
    """Whether one of the names of an element is that of such a block: ``sidebar`` and ``ad-slot``, but not ``with-sidebar`` or ``ad-free``."""
    return any(pattern.search(n) and NOT_SO.isdisjoint(re.split(r"[_-]", n.lower())) for n in names)


class _Lines(HTMLParser):
    """Lines of a page with their marks; tolerant of unclosed elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = []
        self.lines: list[tuple[int, str]] = []
        self.run: list[str] = []
        self.mark = OPEN

    def flush(self):
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.lines.append((self.mark, text))

    def _pop(self, depth):
        del self.stack[depth:]
        self.mark = self.stack[-1][1] if self.stack else OPEN

    def _marked(self, tag, attrs):
        """The mark inside an element; inline elements keep that of the block, so no sentence loses a word."""
        mark, a = self.mark, dict(attrs)
        if mark == NONE or tag in NO_TEXT or "hidden" in a:
            return NONE
        names = f"{a.get('class') or ''} {a.get('id') or ''}".split()
        comment = _named(COMMENT, names)
        if mark == GONE and (tag == "main" or tag == "article" and self._around() == "form") and not comment:
            return INSIDE
        if mark == GONE or tag not in BLOCK or tag in ("html", "body"):
            return mark
        inside = mark in (INSIDE, DOUBT_INSIDE)
        if tag in FURNITURE and not (inside and tag == "header") or a.get("role") in ROLES or comment or tag not in ARTICLE and _named(SURE, names):
            return GONE
        if tag in ARTICLE:
            return INSIDE
        if _named(DOUBTFUL, names):
            return DOUBT_INSIDE if inside else DOUBT
        return mark

    def _around(self) -> str:
        """The element that made this place furniture."""
        return next((tag for tag, mark in self.stack if mark == GONE), "")

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK or tag in NO_TEXT:
            self.flush()
        elif tag == "br":
            self.run.append(" ")
        while self.stack and tag in CLOSES.get(self.stack[-1][0], ()):
            self._pop(len(self.stack) - 1)
        if tag in VOID:
            return
        self.mark = self._marked(tag, attrs)
        self.stack.append((tag, self.mark))

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
        elif tag == "br":
            self.run.append(" ")

    def handle_endtag(self, tag):
        if tag in BLOCK or tag in NO_TEXT:
            self.flush()
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] == tag:
                self._pop(depth)
                return
            # an inline end tag never closes a section around it
            if self.stack[depth][0] in ARTICLE | FURNITURE | NO_TEXT and tag not in ARTICLE | FURNITURE | NO_TEXT | {"div", "body", "html"}:
                return

    def handle_data(self, data):
        if self.mark != NONE:
            self.run.append(data)


def lines(html: str | None) -> list[tuple[int, str]]:
    """All text lines of a page, as (mark, text)."""
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.lines


def own_lines(marks: list[int]) -> list[bool]:
    """Which lines are text as far as structure can tell."""
    keep = (INSIDE, DOUBT_INSIDE) if INSIDE in marks or DOUBT_INSIDE in marks else (OPEN, DOUBT)
    return [m in keep for m in marks]


def place(url: str | None) -> tuple[str, str]:
    """Host and path of a URL; what cannot be parsed has the empty host."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or ""), parts.path + ("?" + parts.query if parts.query else "")
    except ValueError:
        return "", url or ""


def _table(a: list[int], b: list[int]) -> list[int]:
    """As ``shared``, by a table whose rows are bit sets."""
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, [full]
    for x in a:
        m = row & masks.get(x, 0)
        row = ((row + m) | (row - m)) & full
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        # a zero bit j - 1 that this line brought about is a match taken here
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            out.append(i - 1)
            i, j = i - 1, j - 1
    return out[::-1]


SMALL = 1 << 20
"""Cells up to which an alignment keeps its whole table."""


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of a longest common subsequence of ``a`` with every beginning of ``b``."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum(row[1:], row[:-1] + (b == x))
        np.maximum.accumulate(row, out=row)
    return row


def _aligned(a: np.ndarray, b: np.ndarray) -> list[int]:
    """As ``shared``; halves ``a`` until the table is small, so memory follows the lines and not their product."""
    if not len(a) or not len(b):
        return []
    if len(a) * len(b) <= SMALL:
        return _table(a.tolist(), b.tolist())
    if len(a) == 1:
        return [0] if (b == a[0]).any() else []
    half = len(a) // 2
    cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
    return _aligned(a[:half], b[:cut]) + [half + k for k in _aligned(a[half:], b[cut:])]


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places in ``a`` of a longest common subsequence with ``b``."""
    a, b = np.asarray(a), np.asarray(b)
    here = np.flatnonzero(np.isin(a, b))
    both = a[here], b[np.isin(b, a)]
    n = min(len(both[0]), len(both[1]))
    differ = np.flatnonzero(both[0][:n] != both[1][:n])
    head = int(differ[0]) if len(differ) else n
    return here[np.r_[np.arange(head), np.array([head + k for k in _aligned(both[0][head:], both[1][head:])], np.int64)].astype(np.int64)]


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


PARSED = "host string, path string, marks binary, hashes binary, texts array<string>"


def parsed(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """``key`` and ``url`` with host and path, and marks, hashes and texts of all lines; a text is null if structure alone drops it."""

    def run(batches):
        for batch in batches:
            for part, _, _ in slices(batch, html):
                where = [place(u) for u in part.column(url).to_pylist()]
                marks, hashes, texts = [], [], []
                for h in part.column(html).to_pylist():
                    found = lines(h)
                    own = [m for m, _ in found]
                    marks.append(bytes(own))
                    hashes.append(np.array([xxhash.xxh64_intdigest(t) for _, t in found], np.uint64).tobytes())
                    texts.append([t if keep else None for keep, (_, t) in zip(own_lines(own), found, strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), part.column(url), pa.array([h for h, _ in where], pa.string()), pa.array([p for _, p in where], pa.string()), pa.array(marks, pa.binary()), pa.array(hashes, pa.binary()), pa.array(texts, pa.list_(pa.string()))],
                    [key, url, *(x.split()[0] for x in PARSED.split(", "))],
                )

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}
    return pages.select(key, url, html).mapInArrow(run, f"{key} {kinds[key]}, {url} {kinds[url]}, {PARSED}")


def template(each_page: DataFrame) -> DataFrame:
    """(host, path, drop, n_shared): of each page of ``parsed``, hashes of the shared lines that structure did not drop
    and may go, and the number of all shared lines that go; only where there are any."""
    spark = each_page.sparkSession
    line = F.min(F.struct("hashes", "marks")).alias("lines")
    each = each_page.filter("host <> '' and octet_length(marks) > 0").groupBy("host", "path").agg(line)
    ordered = materialise(each.repartitionByRange("host", "path").sortWithinPartitions("host", "path").withColumn("n", F.monotonically_increasing_id()), "outlines")
    part = F.shiftright("n", 33)
    sizes = sorted((r["p"], r["c"]) for r in ordered.groupBy(part.alias("p")).agg(F.count("*").alias("c")).collect())  # one row per partition
    start, offsets = 0, []
    for p, c in sizes:
        offsets.append((p, start))
        start += c
    base = F.broadcast(spark.createDataFrame(offsets, "p long, base long"))
    ranked = ordered.join(base, part == F.col("p")).select("host", "path", "lines", (F.col("base") + F.col("n").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"))
    before = ranked.select((F.col("rank") + 1).alias("rank"), F.struct("host", "path", "lines.hashes").alias("before"))
    after = ranked.select((F.col("rank") - 1).alias("rank"), F.struct("host", "path", "lines.hashes").alias("after"))
    trio = ranked.join(before, "rank", "left").join(after, "rank", "left")

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                near = [x for x in (r["before"], r["after"]) if x and x["host"] == r["host"]]
                if near:
                    best = max(near, key=lambda x: _common(x["path"], r["path"]))
                    own, mark = np.frombuffer(r["lines"]["hashes"], np.uint64), np.frombuffer(r["lines"]["marks"], np.uint8)
                    both = shared(own, np.frombuffer(best["hashes"], np.uint64))
                    both = both[mark[both] != INSIDE]
                    if len(both):
                        out.append((r["host"], r["path"], own[both[mark[both] != GONE]].tobytes(), len(both)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.binary(), pa.int64()))], ["host", "path", "drop", "n_shared"])

    return trio.mapInArrow(run, "host string, path string, drop binary, n_shared long")


def extract(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """``key``, ``url``, the main text of every page and the number of lines that it lost to its nearest page."""
    found = materialise(parsed(pages, html, url, key), "lines")
    drops = materialise(template(found), "template")

    def join(batches):
        for batch in batches:
            texts = []
            for marks, hashes, rows, drop in zip(*(batch.column(k).to_pylist() for k in ("marks", "hashes", "texts", "drop")), strict=True):
                kept = [k for k, t in enumerate(rows) if t is not None]
                if drop:
                    gone: dict[int, int] = {}
                    for x in np.frombuffer(drop, np.uint64).tolist():
                        gone[x] = gone.get(x, 0) + 1
                    named = np.frombuffer(hashes, np.uint64).tolist()
                    stay = []
                    for k in kept:
                        if marks[k] != INSIDE and gone.get(named[k]):
                            gone[named[k]] -= 1
                        else:
                            stay.append(k)
                    kept = stay
                texts.append("\n".join(rows[k] for k in kept))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(url), pa.array(texts, pa.string()), batch.column("n_shared")], [key, url, "text", "n_shared"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}
    # pages without a host have no neighbour, and all those without a URL would be one key
    placed, lost = found.filter("host <> ''").join(drops, ["host", "path"], "left"), found.filter("host = ''").withColumns({"drop": F.lit(None).cast("binary"), "n_shared": F.lit(None).cast("long")})
    joined = placed.unionByName(lost).select(key, url, "marks", "hashes", "texts", "drop", F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"))
    return joined.mapInArrow(join, f"{key} {kinds[key]}, {url} {kinds[url]}, text string, n_shared long")


def report(pages: DataFrame) -> DataFrame:
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_shared")
