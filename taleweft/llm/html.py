"""Main text of web pages by nearest-URL page differencing, checked against the page's markup.

1. A page becomes lines: the text of each block, in page order, with what the markup says of
   it (:class:`Line`). Scripts, styles and tags leave no line.
2. A page's partner is the page of its host whose URL path is nearest: the neighbour, in the
   order of paths, with the longer common prefix. Pages of one path or with the same lines
   are one page here, so neither a second address nor a copy is a partner. The neighbours
   don't depend on partitions: each range of the order gets the edge of the next one.
3. The lines of a page and its partner are aligned by longest common subsequence, and shared
   lines are deleted: they're the site's template. Only hashes of lines (128 bits) meet.
4. An exact check by markup follows, for what two pages can't tell: lines that elements, roles
   or class names mark as menu, advert, notice or comment go even if their words differ from
   page to page, and where a page marks its article, that is the text: shared lines of it
   come back and others go. Pages without an article keep what differencing leaves.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import re
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slices, stored, texts_of, without

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>"']++|"[^"]*"|'[^']*')*+>|</?[a-zA-Z][^>]*(?:>|\Z)""",
    re.DOTALL,
)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.IGNORECASE)
WORD_END = re.compile(r"[-_:]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])")  # class names are split at signs, capitals and numbers
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
DROPPED = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "object", "svg", "canvas", "audio", "video", "map", "dialog", "menu", "datalist", "template", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "status", "form"}
#: Words of a class name that mark an element, if all its other words are of these or neutral.
MARKS = set(
    "ad ads adv advert adverts advertorial advertorials advertisement advertisements advertising sponsor sponsored promo promos promotion banner cookie cookies consent gdpr notice notices alert nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar comment comments commentlist respond replies disqus footer masthead share sharing social related recommended newsletter subscribe signup login popup "
    "modal overlay pagination pager toolbar widget widgets skip".split()
)
NEUTRAL = set(
    "area bar block bottom box btn button buttons container content fixed form global header icons inner item items js left link links list local main mobile outer page panel post posts primary "
    "reader readers right row secondary section site slot sticky sub thread top unit user users wrap wrapper zone".split()
)
#: Of those, words that mark reader comments where an id of them names any element that holds others.
COMMENTS = {"comment", "comments", "commentlist", "respond", "replies", "disqus"}
ANCHORS = INLINE | {"h1", "h2", "h3", "h4", "h5", "h6", "p", "pre", "blockquote", "hr", "dt", "dd", "td", "th", "tr", "legend", "caption"}
WHOLE = {"html", "body", "main"}


class Line(NamedTuple):
    """``part``: -1 marked as boilerplate, 0 body, 1 ``main``, from 2 on the outermost article of that number."""

    part: int
    text: str


def _is_mark(names: str, inside: bool) -> bool:
    for word in names.split():
        parts = [x.lower() for x in WORD_END.split(word) if x and not x.isdigit()]
        if not parts or parts[0] in ("has", "no", "with", "without"):
            continue
        if all(x in MARKS or x in NEUTRAL for x in parts) and (MARKS.intersection(parts) or "header" in parts and not inside):
            return True
    return False


def _marked(name: str, tag: str, inside: bool) -> tuple[bool, bool]:
    """Whether the attributes call an element boilerplate, and whether they call it the article.

    Ids are names of anchors and say nothing of an element, but for those of ``div``, and for
    those of other elements that hold blocks where they name reader comments.
    """
    drop = article = False
    for m in ATTR.finditer(tag, len(name) + 1):
        key, given = m[1].lower(), m[2] or m[3] or m[4] or ""
        value = given.lower()
        if key == "class" or key == "id" and name == "div":
            drop |= _is_mark(given, inside)
        elif key == "id":
            drop |= name not in ANCHORS and not COMMENTS.isdisjoint(x.lower() for x in WORD_END.split(given)) and _is_mark(given, inside)
        elif key == "role":
            drop |= value in ROLES
            article |= value in ("article", "main")
        elif key == "itemprop":
            article |= value == "articlebody"
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            drop = True
    return drop and name not in WHOLE, article


def lines(page: str) -> list[Line]:
    """The page's lines; linear in its length, however its tags nest."""
    found: list[Line] = []
    text: list[str] = []
    other: list[str] = []  # of boilerplate
    stack: list[tuple[str, bool, int, bool]] = []  # name, boilerplate, part outside, has an end
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of each name
    solid: list[int] = []  # places of those that aren't inline
    drops: list[int] = []  # places of boilerplate
    part, articles, pos = 0, 0, 0
    ends: dict[str, int] = {}

    def flush() -> None:
        for pieces, of in ((text, part), (other, -1)):
            if pieces:
                joined = " ".join("".join(pieces).split())
                if joined:
                    found.append(Line(of, joined))
                pieces.clear()

    def pop(to: int) -> None:
        nonlocal part
        while len(stack) > to:
            name, drop, was, _ = stack.pop()
            places[name].pop()
            if name not in INLINE:
                solid.pop()
            if drop:
                drops.pop()
            part = was

    def add(piece: str) -> None:
        if piece:
            (other if drops else text).append(htmllib.unescape(piece) if "&" in piece else piece)

    while m := TAG.search(page, pos):
        add(page[pos : m.start()])
        pos, tag = m.end(), m[0]
        if tag.startswith("<![CDATA["):
            add(page[m.start() + 9 : pos].removesuffix("]]>"))
            continue
        if not (n := NAME.match(tag)):
            continue
        name = n[1].lower()
        if tag[1] == "/":
            at = places[name][-1] if places[name] else None
            if name not in INLINE:
                flush()
            if at is not None and (name not in INLINE or not solid or solid[-1] < at):
                pop(at)
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.IGNORECASE).search(page, pos)
            pos = end.end() if end else len(page)
            continue
        if name not in INLINE:
            flush()
        if name in VOID or tag.endswith("/>") and name in INLINE:
            continue
        if name in ("p", "li") and stack and stack[-1][0] == name:
            pop(len(stack) - 1)
        drop, article = _marked(name, tag, part >= 2) if len(tag) > len(name) + 2 else (False, False)
        drop = drop or name in DROPPED or name == "header" and part < 2
        article = article or name == "article"
        if (article or name == "main") and drops and not stack[drops[0]][3]:  # a menu that was never closed ends where the article starts
            pop(drops[0])
        closed = True
        if drop:
            if name not in ends:
                ends[name] = max((x.start() for x in re.finditer(rf"</{name}\b", page, re.IGNORECASE)), default=-1)
            closed = ends[name] > pos
        places[name].append(len(stack))
        if name not in INLINE:
            solid.append(len(stack))
        if drop:
            drops.append(len(stack))
        stack.append((name, drop, part, closed))
        if article and part < 2 and not drops:
            articles += 1
            part = articles + 1
        elif name == "main" and part < 2:
            part = 1
    add(page[pos:])
    flush()
    return found


def shared(a: Sequence, b: Sequence) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < min(len(a), len(b)) - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    places: dict = defaultdict(list)
    for j in range(len(b) - stop - 1, start - 1, -1):
        places[b[j]].append(j)
    tails: list[int] = []
    links: list[tuple] = []
    for i in range(start, len(a) - stop):
        for j in places.get(a[i], ()):
            k = bisect_left(tails, j)
            link = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(link)
            else:
                tails[k], links[k] = j, link
    out, link = {*range(start), *range(len(a) - stop, len(a))}, links[-1] if links else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def article_parts(page: list[Line]) -> set[int]:
    """Parts of a page that its markup calls the article; none if it marks none.

    Articles are, unless ``main`` holds more text of its own than the longest of them: then
    they are teasers beside the story.
    """
    size: dict[int, int] = defaultdict(int)
    for x in page:
        size[x.part] += len(x.text)
    told = {p for p in size if p >= 2}
    if told and size.get(1, 0) > max(size[p] for p in told):
        return {1}
    return told


def checked(page: list[Line], deleted: set[int]) -> list[str]:
    """What stays of a page after differencing and the check by markup."""
    told = article_parts(page)
    if told:
        return [x.text for x in page if x.part in told]
    top = 1 if any(x.part == 1 and i not in deleted for i, x in enumerate(page)) else 0
    return [x.text for i, x in enumerate(page) if x.part == top and i not in deleted]


def hashes(page: list[Line]) -> list[bytes]:
    return [hashlib.blake2b(x.text.encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in page]


def _packed(page: list[Line]) -> bytes:
    return zlib.compress("\n".join(f"{x.part} {x.text}" for x in page).encode("utf-8", "surrogatepass"), 3)


def _unpacked(body: bytes) -> list[Line]:
    rows = zlib.decompress(body).decode("utf-8", "surrogatepass")
    return [Line(int(p), t) for p, _, t in (x.partition(" ") for x in rows.split("\n"))] if rows else []


def _parsed(column: str, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            pages = [lines(x) for x in texts_of(batch, column)]
            own = [hashes(x) for x in pages]
            keys = [hashlib.blake2b(b"".join(h), digest_size=16).digest() for h in own]
            held = [_packed(x) for x in pages] if wide else [b"".join(h) for h in own]
            arrays = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != column]
            names = [n for n in batch.schema.names if n != column]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(keys, pa.binary()), pa.array(held, pa.binary())], names=[*names, "__key", "__held"])

    return run


def _same_start(a: Column, b: Column) -> Column:
    """Length of the common prefix of two strings; null for a null one."""
    apart = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False))
    return F.when(apart > 0, apart - 1).otherwise(F.least(F.length(a), F.length(b)))


def partners(known: DataFrame) -> DataFrame:
    """(host, key, partner key) for the pages (host, path, key): null where a host has no other page.

    Pages are first reduced to one per lines and one per path. Their order is cut into ranges,
    so a host of any size spreads; a range is told the last page before and the first behind it.
    """
    texts = known.groupBy("__host", "__key").agg(F.min("__path").alias("__path"))
    nodes = texts.groupBy("__host", "__path").agg(F.min("__key").alias("__node"))
    ranged = stored(nodes.repartitionByRange("__host", "__path").withColumn("__part", F.spark_partition_id()))
    page = F.struct("__host", "__path", "__node")
    edges = ranged.groupBy("__part").agg(F.min(page).alias("first"), F.max(page).alias("last"))
    of_parts = Window.orderBy("__part")  # a row per range
    edges = edges.select("__part", F.lag("last").over(of_parts).alias("__before"), F.lead("first").over(of_parts).alias("__behind"))
    inside = Window.partitionBy("__part").orderBy("__host", "__path")
    near = ranged.join(F.broadcast(edges), "__part").withColumns({"__before": F.coalesce(F.lag(page).over(inside), "__before"), "__behind": F.coalesce(F.lead(page).over(inside), "__behind")})
    reach = lambda x: F.when(F.col(f"{x}.__host") == F.col("__host"), _same_start(F.col("__path"), F.col(f"{x}.__path")))
    best = F.when(F.coalesce(reach("__behind"), F.lit(-1)) > F.coalesce(reach("__before"), F.lit(-1)), F.col("__behind.__node")).when(reach("__before").isNotNull(), F.col("__before.__node"))
    placed = near.select("__host", "__path", best.alias("__partner"))
    return texts.join(placed, ["__host", "__path"]).select("__host", "__key", "__partner")


def _deleted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of the lines that each page shares with its partner."""
    cut = lambda x: [x[i : i + 16] for i in range(0, len(x), 16)]
    for batch in batches:
        own, other = batch.column("__held").to_pylist(), batch.column("__other").to_pylist()
        gone = [sorted(shared(cut(a), cut(b))) for a, b in zip(own, other, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("__host"), batch.column("__key"), pa.array(gone, pa.list_(pa.int32()))], names=["__host", "__key", "__gone"])


def _written(out: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, gone = [], [], []
            for held, cut in zip(batch.column("__held").to_pylist(), batch.column("__gone").to_pylist(), strict=True):
                page = _unpacked(held)
                texts.append(" ".join(checked(page, set(cut or ()))))
                n.append(len(page))
                gone.append(len(cut or ()))
            row = batch.column("__row")
            arrays = [row.field(k) for k in range(row.type.num_fields)] + [pa.array(texts, pa.string()), pa.array(n, pa.int32()), pa.array(gone, pa.int32())]
            yield pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip(arrays, schema.types, strict=True)], schema=schema)

    return run


def extract(pages: DataFrame, column: str = "html", url: str = "url", out: str = "text") -> DataFrame:
    """All rows of ``pages`` without the page source, with their main text in ``out``, and
    ``n_lines`` and ``n_shared``: the page's lines, and how many of them its partner shares.

    Null sources count as empty and give an empty text; pages without a host have no partner;
    repeated rows are all kept; input columns of the result's names are replaced; an empty
    table gives an empty result. The result doesn't depend on partitions or order of rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = without(pages, *(x for x in (out, "n_lines", "n_shared") if x != column))
    address = F.coalesce(F.col(url), F.lit(""))
    host = F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)).alias("__host")
    path = F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("__path")
    source = F.col(column).alias("__html")
    known = stored(kept.select(host, path, source).filter("__host <> ''").mapInArrow(_parsed("__html", False), "__host string, __path string, __key binary, __held binary"))
    pairs = stored(partners(known.select("__host", "__path", "__key")).filter("__partner IS NOT NULL"))
    texts = known.groupBy("__host", "__key").agg(F.first("__held").alias("__held"))  # a key stands for its hashes
    theirs = texts.select("__host", F.col("__key").alias("__partner"), F.col("__held").alias("__other"))
    both = pairs.join(theirs, ["__host", "__partner"]).join(texts, ["__host", "__key"]).select("__host", "__key", "__held", "__other")
    gone = stored(both.mapInArrow(_deleted, "__host string, __key binary, __gone array<int>").filter("size(__gone) > 0"))
    rest = [c for c in kept.columns if c.lower() != column.lower()]
    row = F.struct(*[f"`{c}`" for c in rest]).alias("__row") if rest else F.struct(F.lit(0).alias("__none")).alias("__row")
    base = kept.select(row, host, source)
    packed = base.mapInArrow(_parsed("__html", True), base.drop("__html").withColumns({"__key": F.lit(b""), "__held": F.lit(b"")}).schema)
    joined = packed.join(gone, ["__host", "__key"], "left").select("__row", "__held", "__gone")
    schema = joined.select("__row.*").withColumns({out: F.lit(""), "n_lines": F.lit(0), "n_shared": F.lit(0)}).schema
    done = joined.mapInArrow(_written(out, to_arrow_schema(schema)), schema)
    return done if rest else done.drop("__none")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; null sources and addresses, copies and repeated rows as in extract()."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = extract(pages)
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_lines", "n_shared")
