"""HTML extraction (operator 13): nearest-URL page differencing.

A page becomes text lines (one per block of markup).  Within each host the pages are put in
order of their URL path, and every page is aligned with its neighbours in that order by a longest
common subsequence of lines.  Lines shared with a neighbour are the host's template and go.
What the markup itself names as the article (``article``, ``main``) is kept although a neighbour
shares it: two pages may tell the same story.  What the markup names as page furniture (``nav``,
``footer``, ``aside``, forms, classes such as ``ad`` or ``cookie``) goes although no neighbour
shares it.  If a page names an article, its text is the article; otherwise all lines that remain.

Scale: pages are paired and aligned as line hashes, never as texts, and only pages that lose lines are listed; with
few of them (Spark measures it) the list is broadcast and no text moves, otherwise texts move once.  Pages of one host with the same lines are one
page in the order, so copies are neither neighbours of each other nor aligned twice.  The order is
range-partitioned, so a host with a third of all pages is spread over tasks; only the first page of
each part looks up its neighbour in the part before.  The alignment is bit-parallel and divides its
work (Hirschberg), so its memory follows the lines of two pages.

Defined results: null html is empty and gives the empty text; a null or odd URL belongs to the host
''; repeated rows each give their row; markup cut off inside a tag or comment ends the text there.
Columns other than the three named ones are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.windows import previous_row
from .common import col, slices, stored

OTHER, MAIN, CHROME = 0, 1, 2

#: Elements whose content is not markup; it never shows as text of the page.
RAW = frozenset("script style title textarea iframe noscript noembed noframes template svg math object canvas xmp".split())
#: Elements that name page furniture wherever they stand.
FURNITURE = frozenset("nav footer aside form button select menu dialog head".split())
ARTICLE = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a line of text; all others end the line.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr img".split())
#: An open one of these ends at the next block.
SHORT = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 td th tr option".split())
#: Words that name page furniture only outside an article, whose own heading is part of it.
HEADINGS = frozenset(("header", "masthead", "banner"))
#: Words in class, id or role that name page furniture.
HINTS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent notice notices "
                  "menu navbar nav navigation breadcrumb breadcrumbs sidebar footer masthead header comment comments reply replies "
                  "share sharing social newsletter subscribe signup popup modal login search pagination contentinfo complementary".split())

TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""",
                   re.S)
HINT = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")


def _kind(tag: str, attributes: str, inside_main: bool) -> int | None:
    """What an opening tag says about its content (None: nothing)."""
    hinted = False
    if attributes and "=" in attributes and tag not in ("html", "body"):
        for found in HINT.findall(attributes):
            words = HINTS.intersection(WORD.findall((found[0] or found[1] or found[2]).lower()))
            if words - HEADINGS if inside_main else words:
                hinted = True
    if tag in ARTICLE:  # classes of an article tell about its layout, unless they call it a comment or an advert
        words = WORD.findall(attributes.lower()) if hinted else ()
        return CHROME if not {"comment", "comments", "reply", "ad", "advert", "sponsored", "promo"}.isdisjoint(words) else MAIN
    if hinted or tag in FURNITURE:
        return CHROME
    if tag == "header":
        return None if inside_main else CHROME  # an article's own header holds its title
    return None


def page_lines(markup: str) -> tuple[list[str], list[int]]:
    """(lines, kinds) of a page in order: white space in a line is one space, empty lines are left out."""
    lines: list[str] = []
    kinds: list[int] = []
    piece: list[str] = []
    regions: list[list] = []  # [tag, opened, kind] of open elements that say something
    depth = {OTHER: 0, MAIN: 0, CHROME: 0}
    at, end = 0, len(markup)

    def flush() -> None:
        if piece:
            line = " ".join(entities.unescape("".join(piece)).split())
            piece.clear()
            if line:
                lines.append(line)
                kinds.append(CHROME if depth[CHROME] else MAIN if depth[MAIN] else OTHER)

    def close(i: int) -> None:
        while len(regions) > i:
            depth[regions.pop()[2]] -= 1

    while at < end:
        m = TOKEN.search(markup, at)
        if m is None:
            piece.append(markup[at:])
            break
        if m.start() > at:
            piece.append(markup[at:m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag not in INLINE:
            flush()
            if regions and regions[-1][0] in SHORT:
                close(len(regions) - 1)
        if closing:
            for i in range(len(regions) - 1, -1, -1):
                if regions[i][0] == tag:
                    regions[i][1] -= 1
                    if not regions[i][1]:
                        flush()
                        close(i)
                    break
            continue
        if tag in RAW:
            flush()
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(markup, at)
            at = stop.end() if not attributes.endswith("/") or tag not in ("svg", "math") else at
            continue
        if tag in VOID or (attributes.endswith("/") and tag not in ARTICLE and tag not in FURNITURE):
            continue
        kind = _kind(tag, attributes, depth[MAIN] > 0)
        if kind is not None:
            flush()
            regions.append([tag, 1, kind])
            depth[kind] += 1
        else:
            for r in reversed(regions):
                if r[0] == tag:
                    r[1] += 1
                    break
    flush()
    return lines, kinds


def url_parts(url: str | None) -> tuple[str, str]:
    """(host in lower case, path without query and fragment) of a URL."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)", url or "")
    return (m[1].rsplit("@", 1)[-1].lower(), m[2]) if m else ("", (url or ""))


def _line_marks(lines: list[str]) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for s in lines]


# ---------------------------------------------------------------- alignment

def _rows(a: list, b: list) -> list[int]:
    """Bit-parallel LCS of ``a`` against every prefix of ``b``: row j has a 0 bit at each place of ``a``
    where the length grows."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v, out = full, [full]
    for y in b:
        u = v & places.get(y, 0)
        v = ((v + u) | (v - u)) & full
        out.append(v)
    return out


def _lengths(a: list, b: list) -> np.ndarray:
    """LCS length of every prefix of ``a`` with the whole of ``b``."""
    v = (1 << len(a)) - 1
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    full = v
    for y in b:
        u = v & places.get(y, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes((len(a) + 7) // 8 or 1, "little"), np.uint8), bitorder="little")[:len(a)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(a: list, b: list, cells: int = 1 << 26) -> list[tuple[int, int]]:
    """Index pairs of one longest common subsequence of ``a`` and ``b``.

    Up to ``cells`` bits of table are walked back; longer pairs are halved first (Hirschberg)."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, left, right = todo.pop()
        while lo < hi and left < right and a[lo] == b[left]:
            out.append((lo, left))
            lo, left = lo + 1, left + 1
        while lo < hi and left < right and a[hi - 1] == b[right - 1]:
            hi, right = hi - 1, right - 1
            out.append((hi, right))
        if lo == hi or left == right:
            continue
        x, y = a[lo:hi], b[left:right]
        if len(y) > 1 and len(x) * len(y) > cells:
            mid = len(y) // 2
            head, tail = _lengths(x, y[:mid]), _lengths(x[::-1], y[mid:][::-1])
            cut = int(np.argmax(head + tail[::-1]))
            todo += [(lo, lo + cut, left, left + mid), (lo + cut, hi, left + mid, right)]
            continue
        rows = _rows(x, y)
        i, j = len(x) - 1, len(y)
        while i >= 0 and j > 0:
            if rows[j] >> i & 1:            # x[i] adds nothing here
                i -= 1
            elif not rows[j - 1] >> i & 1:  # it was there without y[j - 1]
                j -= 1
            else:
                out.append((lo + i, left + j - 1))
                i, j = i - 1, j - 1
    return sorted(out)


# ---------------------------------------------------------------- Spark jobs

PAGE = "host string, path string, page_key string, marks array<bigint>, loose array<int>"


def _read_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(url, html) -> host, path, key of the page's lines within the host, line hashes, numbers of the lines that a
    neighbour may take away."""
    for batch in slices(batches, 1):
        out = []
        for url, markup in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            host, path = url_parts(url)
            lines, kinds = page_lines(markup or "")
            loose = [] if MAIN in kinds else [i for i, k in enumerate(kinds) if k == OTHER]
            out.append((host, path, _page_key(host, lines, kinds), _line_marks(lines), loose))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())))],
            names=["host", "path", "page_key", "marks", "loose"])


def _page_key(host: str, lines: list[str], kinds: list[int]) -> str:
    h = hashlib.blake2b(repr((host, len(lines))).encode("utf-8", "surrogatepass"), digest_size=16)
    for line, kind in zip(lines, kinds):
        raw = line.encode("utf-8", "surrogatepass")
        h.update(b"%d %d " % (kind, len(raw)))
        h.update(raw)
    return h.hexdigest()


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their neighbour -> the line numbers each of the two loses, where it loses any."""
    for batch in batches:
        keys, places = [], []
        for key, marks, loose, other, theirs, their_loose in zip(*(batch.column(i).to_pylist() for i in range(6))):
            pairs = common_lines(marks, theirs)
            for page, may, shared in ((key, loose, {i for i, _ in pairs}), (other, their_loose, {j for _, j in pairs})):
                gone = [i for i in may if i in shared]
                if gone:
                    keys.append(page)
                    places.append(gone)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(places, pa.list_(pa.int32()))], names=["page_key", "shared"])


def shared_lines(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_key, shared): per distinct page of a host the numbers of the lines it loses because a neighbour in URL
    order shares them; pages that lose none are not listed."""
    read = pages.select(col(url_col).cast("string").alias("url"), col(html_col).cast("string").alias("html")).mapInArrow(_read_pages, PAGE)
    distinct = read.groupBy("host", "page_key").agg(F.min("path").alias("path"), F.first("marks").alias("marks"), F.first("loose").alias("loose"))
    # a written part of the order is one bucket: its number is fixed, whatever is computed again later
    order = stored(distinct.repartitionByRange("host", "path", "page_key").withColumn("part", F.spark_partition_id()), "url-order")
    near = previous_row(order, ["host"], ["path", "page_key"], ["page_key", "marks", "loose"], F.col("part"))
    aligned = (near.where(F.col("prev_page_key").isNotNull()).select("page_key", "marks", "loose", "prev_page_key", "prev_marks", "prev_loose")
               .mapInArrow(_align, "page_key string, shared array<int>"))
    # at most two rows a page: the neighbour before it and the one after it
    return aligned.groupBy("page_key").agg(F.array_distinct(F.flatten(F.collect_list("shared"))).alias("shared"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_lines, n_shared) per row: the main text of every page, its code
    points, the lines of the page and how many of them went because a neighbour shares them."""
    template = stored(shared_lines(pages, url_col, html_col), "shared-lines")
    id_type = pages.schema[id_col].dataType.simpleString()

    def lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            keys, texts, marked = [], [], []
            for url, markup in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines, kinds = page_lines(markup or "")
                keys.append(_page_key(url_parts(url)[0], lines, kinds))
                texts.append([None if k == CHROME else line for line, k in zip(lines, kinds)])
                marked.append([k == MAIN for k in kinds])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.string()), pa.array(texts, pa.list_(pa.string())),
                 pa.array(marked, pa.list_(pa.bool_()))], names=["page_id", "url", "page_key", "lines", "article"])

    read = pages.select(col(id_col).alias("page_id"), col(url_col).cast("string").alias("url"), col(html_col).cast("string").alias("html"))
    read = read.mapInArrow(lines_of, f"page_id {id_type}, url string, page_key string, lines array<string>, article array<boolean>")
    d = read.join(template, "page_key", "left").withColumn("shared", F.coalesce("shared", F.array().cast("array<int>")))
    keep = F.filter("lines", lambda line, i: line.isNotNull() & F.when(F.exists("article", lambda a: a), F.get("article", i))
                    .otherwise(~F.array_contains("shared", i)))
    d = d.select("page_id", "url", F.array_join(keep, " ").alias("text"), F.size("lines").alias("n_lines"), F.size("shared").alias("n_shared"))
    return d.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"),
                    "n_lines", "n_shared")
