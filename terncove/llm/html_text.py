"""Main text of web pages by nearest-URL page differencing, and by what pages say about their own parts.

A page becomes lines, one per block element, in page order. Pages of a host are ordered by URL path. Neighbours that share
nearly all of their text are copies and form a run; a page is paired with the page before or the page after its run, whichever path has the
longer beginning in common with its own. The lines of both are aligned by their longest common subsequence, and lines they share
are deleted: menus, notices and footers repeat, articles do not.

Every page is differenced; a check by what pages say about their own parts follows, because differencing alone gives wrong texts
(figures are in the README): furniture that differs from page to page is not shared, and passages that articles have in common are.
Lines inside elements that say what they are (``nav``, ``footer``, a class ``ad`` or ``comments``) go, shared or not; a class or id says so
if all parts of one of its tokens do (``sidebar-menu``, not ``has-sidebar``), never on ``html``, ``body``, ``main``, ``article`` or what
contains the last two. Where a page has an ``article`` or ``main`` element, what is outside it goes, and its running text stays, shared or
not. Differencing decides about all other lines: those of pages that have no such element, and inside of it those parts that the page
marks off (an ``article`` among others; a ``div``, ``section``, list, table or figure with a class or id), such as an author's box or teasers.
Such a part goes if all of its own lines are shared, unless more of the article would go than stay.

Scale: a page is parsed once, and lines that go in any case are stored as hashes only. Pairing needs only line hashes.
These are range-partitioned by (host, path), so a hot host spreads over many tasks; each partition gets the last page before it,
runs are numbered across partitions, and a page meets the ends of the runs beside its own in a join by run. Shared lines are joined by
key to the pages that have some; the others, found by a filter of fixed size (``store.sift``), are not shuffled.

Defined results: null and empty pages give an empty text of 0 characters; unclosed elements end with their parents; a
null URL is a host of its own; a page whose host has no other article loses nothing by differencing; rows that repeat are treated
alike; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import append, small_batches, trimmed
from .store import drop_since, free_shuffles, materialize, sieve, sift, slots, unused, written

#: Pages are copies if the lines they share hold at least this part of the characters of the one that has more.
COPY = 0.8

# Elements and words by which pages name what is not their article.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td "
    "textarea tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "canvas", "xmp")
MAY_BE_EMPTY = frozenset("svg math object canvas iframe".split())  # a start tag that ends in "/>" has no content
FURNITURE = frozenset("nav footer aside form menu dialog button select option search head".split())
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu sidebar "
    "footer masthead breadcrumb breadcrumbs cookie cookies consent gdpr notice notices comment comments disqus discussion reply "
    "replies share sharing social related recommended recommendations newsletter subscribe subscription signup popup modal "
    "overlay widget toolbar pagination pager skip".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
INSIDE = frozenset("article main".split())
UNNAMED = frozenset("html body main article".split())  # their classes and ids tell of the page's state, not of themselves
PARTS = frozenset("div section ul ol dl table figure details".split())  # with a class or id they mark off a part of an article
# words that are also subjects: as the id of a section of an article they name what it is about
SUBJECTS = frozenset(
    "advertising banner consent cookies discussion gdpr menu navigation notice notices promotion recommendations related replies reply "
    "sharing social sponsor subscription".split()
)
# an opened p, li, option, table cell or row ends when the next one opens
ENDS = {"p": {"p"}, "li": {"li"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_SPACE = re.compile(r"[\s ]+")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}


@dataclass(slots=True)
class Line:
    text: str
    inside: bool  # of an article or main element
    furniture: bool
    part: int  # number of the innermost part of the page's article that is marked off, 0 for none


def _names_furniture(tag: str, attributes: str, inside: bool) -> bool:
    if tag in UNNAMED:
        return False
    for name, value in _NAMES.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role":
            if value in ROLES:
                return True
            continue
        for token in value.split():
            parts = [p for p in re.split(r"[^a-z]+", token) if p]
            if parts and NAMED.issuperset(parts) and not (name == "id" and tag == "section" and inside and SUBJECTS.issuperset(parts)):
                return True
    return False


def page_lines(source: str | None) -> list[Line]:
    """The blocks of a page with references decoded and white space collapsed."""
    lines: list[Line] = []
    stack: list[tuple[str, bool, bool, bool, int]] = []  # tag, inside, furniture by its element, by its name, part
    inside = furniture = named = False
    part = parts = 0
    buffer: list[str] = []

    def flush() -> None:
        if buffer:
            text = _SPACE.sub(" ", html.unescape("".join(buffer))).strip()
            if text:
                lines.append(Line(text, inside, furniture or named, part))
            buffer.clear()

    source, at = source or "", 0
    while (m := _TOKEN.search(source, at)) is not None:
        if m.start() > at:
            buffer.append(source[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCKS:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if any(t in BLOCKS for t, *_ in stack[k:]):
                        flush()
                    del stack[k:]
                    inside, furniture, named, part = stack[-1][1:] if stack else (False, False, False, 0)
                    break
            continue
        if tag in MAY_BE_EMPTY and m[3].endswith("/"):
            continue
        if tag in _RAW_END:
            end = _RAW_END[tag].search(source, at)
            at = end.end() if end else len(source)
            continue
        if tag in BLOCKS:
            flush()
        if tag in ENDS:
            while stack and stack[-1][0] not in BLOCKS:  # inline elements end with their block
                if not any(t in ENDS[tag] for t, *_ in stack):
                    break
                stack.pop()
            if stack and stack[-1][0] in ENDS[tag]:
                stack.pop()
            inside, furniture, named, part = stack[-1][1:] if stack else (False, False, False, 0)
        if tag in VOID:
            continue
        if tag == "body":
            inside = furniture = named = False
            part = 0
            stack.clear()
        is_header = tag == "header" and not inside
        if tag in INSIDE and not inside:
            inside, named = True, False  # what contains the article is no menu, whatever its name
        furniture = furniture or is_header or tag in FURNITURE
        named = named or bool(m[3].strip() and _names_furniture(tag, m[3], inside))
        if tag == "article" or (inside and tag in PARTS and any(name.lower() != "role" for name, _ in _NAMES.findall(m[3]))):
            parts += 1
            part = parts
        stack.append((tag, inside, furniture, named, part))
    buffer.append(source[at:])
    flush()
    return lines


def line_hash(text: str) -> int:
    """44 bits of a hash and, in the low 20 bits, the number of characters (1,048,575 at most)."""
    digest = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
    return digest >> 20 << 20 | min(len(text), 0xFFFFF)


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Indices of ``a`` in a longest common subsequence of both (by increasing matches, Hunt and Szymanski)."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(a) - lo and hi < len(b) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    where: dict[int, list[int]] = {}
    for j in range(len(b) - hi - 1, lo - 1, -1):
        where.setdefault(b[j], []).append(j)
    tails: list[int] = []
    nodes: list[tuple[int, tuple | None]] = []
    for i in range(lo, len(a) - hi):
        for j in where.get(a[i], ()):
            k = bisect_left(tails, j)
            node = (i, nodes[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                nodes.append(node)
            else:
                tails[k], nodes[k] = j, node
    middle, node = [], nodes[-1] if nodes else None
    while node:
        middle.append(node[0])
        node = node[1]
    return [*range(lo), *middle[::-1], *range(len(a) - hi, len(a))]


def _prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def are_copies(a: list[int], b: list[int]) -> bool:
    """By characters: a short menu in common makes no copies, nor does a long menu beside a longer article."""
    size = lambda lines: sum(h & 0xFFFFF for h in lines)
    return size([a[i] for i in common_lines(a, b)]) >= COPY * max(size(a), size(b))


def page_blocks(found: list[Line]) -> tuple[list[str], list[int]]:
    """The text of each line, empty if it goes in any case, and its block: lines of one block go if differencing deletes them all.

    0 stays, shared or not; on pages without an article each line is a block, with a number below 0.
    """
    framed = any(x.inside and not x.furniture for x in found)
    texts = ["" if x.furniture or (framed and not x.inside) else x.text for x in found]
    return texts, [x.part if framed else -1 - i for i, x in enumerate(found)]


def checked_text(texts: list[str], blocks: list[int], shared: list[int]) -> str:
    """The text of a page without the blocks that it shares as a whole; of an article no more may go than stays."""
    own = set(shared)
    kept = {0} | {b for i, (x, b) in enumerate(zip(texts, blocks, strict=True)) if x and i not in own}
    every, left = [x for x in texts if x], [x for x, b in zip(texts, blocks, strict=True) if x and b in kept]
    framed = bool(blocks) and blocks[0] >= 0
    return "\n".join(every if framed and 2 * sum(map(len, left)) < sum(map(len, every)) else left)


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of (part, host, path, key) to their run, counted from 0 in each part; ``borrowed`` rows stand before a part's own."""
    part, before, run = None, None, 0
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            if row.part != part:
                part, before, run = row.part, None, 0
            if before is not None and not (before.host == row.host and are_copies(list(before.hashes), list(row.hashes))):
                run += 1
            before = row
            if not row.borrowed:
                out.append((row.key, row.part, run, row.host, row.path, row.hashes))
        yield pd.DataFrame(out, columns=["key", "part", "run", "host", "path", "hashes"])


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lines that each page shares with the nearer of the pages beside its run."""
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            near = [(path, lines) for path, lines in ((row.path_before, row.hashes_before), (row.path_after, row.hashes_after)) if lines is not None]
            if near:
                nearest = max(near, key=lambda n: _prefix(n[0], row.path))
                if shared := common_lines(list(row.hashes), list(nearest[1])):
                    out.append((row.key, np.array(shared, np.int32)))
        yield pd.DataFrame(out, columns=["key", "shared"])


def shared_lines(lines: DataFrame) -> DataFrame:
    """``lines``: key, host, path, hashes of the lines; keys distinct. key, shared (line numbers) of the pages that share some."""
    spark = lines.sparkSession
    small_batches(spark)
    n, mark = slots(spark), written(spark)
    columns = ["host", "path", "key", "hashes"]
    ordered = materialize(lines.repartitionByRange(n, "host", "path", "key").withColumn("part", F.spark_partition_id()), "page-lines")
    ends = ordered.groupBy("part").agg(F.max(F.struct(*columns)).alias("last"))
    by_part = Window.orderBy("part")  # one row for each partition
    ends = ends.select("part", F.lag("last").over(by_part).alias("r")).where("r is not null")
    borrowed = ends.select(*[F.col(f"r.{c}").alias(c) for c in columns], "part", F.lit(True).alias("borrowed"))
    every = ordered.select(*columns, "part", F.lit(False).alias("borrowed")).unionByName(borrowed)
    every = every.repartition(n, "part").sortWithinPartitions("part", "host", "path", "key")
    counted = every.mapInPandas(trimmed(_runs), "key long, part int, run long, host string, path string, hashes array<long>")
    counted = materialize(counted, "page-runs")
    # run 0 of a part is that of its borrowed row, so the last run of a part and run 0 of the next have one number
    tops = counted.groupBy("part").agg(F.max("run").alias("top"))
    offset = F.coalesce(F.sum("top").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = counted.join(tops.select("part", offset.alias("offset")), "part").withColumn("run", F.col("run") + F.col("offset"))
    end = F.struct("path", "key", "hashes")
    runs = materialize(rows.groupBy("run").agg(F.first("host").alias("of"), F.min(end).alias("first"), F.max(end).alias("last")), "page-ends")
    before = runs.select((F.col("run") + 1).alias("run"), F.col("of").alias("host_before"), F.col("last.path").alias("path_before"), F.col("last.hashes").alias("hashes_before"))
    after = runs.select((F.col("run") - 1).alias("run"), F.col("of").alias("host_after"), F.col("first.path").alias("path_after"), F.col("first.hashes").alias("hashes_after"))
    asked = rows.join(before, "run", "left").join(after, "run", "left")
    own = lambda side: [F.when(F.col(f"host_{side}") == F.col("host"), F.col(f"{c}_{side}")).alias(f"{c}_{side}") for c in ("path", "hashes")]
    shared = materialize(asked.select("key", "path", "hashes", *own("before"), *own("after")).mapInPandas(trimmed(_shared), "key long, shared array<int>"), "shared-lines")
    drop_since(spark, mark)
    return shared


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", out_col: str = "text") -> DataFrame:
    """All input columns but the HTML, ``out_col`` and n_chars."""
    key, host, path, lines, blocks, hashes, shared = unused(pages, "_key", "_host", "_path", "_lines", "_blocks", "_hashes", "_shared")
    url = F.coalesce(F.col(url_col), F.lit(""))
    named = pages.withColumns({
        key: F.xxhash64(F.col(id_col), F.col(url_col), F.col(html_col)),
        host: F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)),
        path: F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1),
    })

    def read(sources: list[str | None]) -> dict[str, list]:
        found = [page_lines(source) for source in sources]
        texts, numbers = zip(*map(page_blocks, found), strict=True)
        return {lines: list(texts), blocks: list(numbers), hashes: [[line_hash(x.text) for x in of_page] for of_page in found]}

    def cut(*columns: list[list | None]) -> dict[str, list]:
        texts = [checked_text(of_page, numbers, deleted or []) for of_page, numbers, deleted in zip(*columns, strict=True)]
        return {out_col: texts, "n_chars": [len(t) for t in texts]}

    strings, longs, ints = (T.ArrayType(t()) for t in (T.StringType, T.LongType, T.IntegerType))
    arrays = [(lines, strings, pa.list_(pa.string())), (blocks, ints, pa.list_(pa.int32())), (hashes, longs, pa.list_(pa.int64()))]
    parsed = materialize(append(named, read, [html_col], arrays, drop=(html_col,)), "pages")
    narrow = parsed.select(F.col(key).alias("key"), F.col(host).alias("host"), F.col(path).alias("path"), F.col(hashes).alias("hashes"))
    found = shared_lines(narrow.dropDuplicates(["key"]))
    marked = sieve(found, F.col("key"))
    free_shuffles(pages.sparkSession)
    parsed = parsed.drop(host, path, hashes)
    met = sift(parsed, marked, F.col(key)).join(found.select(F.col("key").alias(key), F.col("shared").alias(shared)), key, "left")
    alone = sift(parsed, marked, F.col(key), passing=False).withColumn(shared, F.lit(None).cast(ints))
    result = [(out_col, T.StringType(), pa.string()), ("n_chars", T.LongType(), pa.int64())]
    return append(alone.unionByName(met), cut, [lines, blocks, shared], result, drop=(key, lines, blocks, shared))


def op9_html(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
