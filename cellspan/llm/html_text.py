"""HTML main text by nearest-URL page differencing.

Pages of a host share their template.  Each page is paired with the page whose URL path is nearest within its host: pages are
sorted by path, and of the two neighbours the one with the longer common beginning is taken.  Both pages are lines of
text (blocks); the longest common subsequence of the two aligns them, and lines that both have are deleted.

Every page with a neighbour goes through that first.  Differencing alone errs in two ways: neighbours may hold the same passages or the same article, and a notice
or a menu may be on one page only.  So structure then does two things, and no more (:func:`decide`):

* It vetoes deletions.  A deleted line comes back if it is in the element that holds the page's text: the ``article`` or ``main`` element with the most text, or the
  element that directly holds more than half of the characters that differencing has left.
* It adds removals.  Lines inside menus, headers, footers, sidebars, notices, adverts, forms and reader comments go (by tag, role, or whole names of classes
  and ids), and on a page with an ``article`` or ``main`` element what lies outside all of them, unless the outside lines that only this page has are longer (a teaser, beside a body in
  plain elements).

A page of which differencing would leave nothing is a copy of its nearest page and is treated as one without neighbours: its text stays, with the template's lines.

Pages are dealt by ranges of the sorted order, one shuffle of parsed blocks; a range's first and last page visit the neighbouring
ranges as guests, so that a page's pair doesn't depend on the ranges, and a host that has a third of all pages is spread over many.  A range
holds about ``RANGE_BYTES`` of html, until there are ``MAX_RANGES``; a task streams through its ranges and holds three pages, whatever their size.
The alignment keeps every few rows of the table and computes the others again, so its memory grows with the power 1.5 of a page's lines.

Defined results: null html is empty, null URL is a host of its own without neighbours; an empty text gives "" and 0
characters; repeated rows are pages of their own (and neighbours); an empty table gives an empty result; other columns are ignored.
A quote that is never closed ends with its tag; elements that are never closed end with the element around them, but for scripts and the like, which take the rest of the page as in browsers.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of html in a range of the sorted order, and ranges at most (the driver holds two keys of each).
RANGE_BYTES, MAX_RANGES = 4 << 20, 50_000

# HTML element names by the part they play.
RAW = ("script", "style", "noscript", "textarea", "title", "iframe", "noembed", "noframes")
UNSEEN = frozenset("template svg object select datalist canvas audio video button".split())
FOREIGN = frozenset(("svg", "math"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split()
)
HOLDERS = frozenset("article main section div center".split())
SPACED = frozenset("br td th option wbr img".split())
CLOSES_ITSELF = frozenset("p li dt dd tr".split())
NOT_MAIN = frozenset("nav footer aside form menu dialog".split()) | UNSEEN
MAIN_ROLES = frozenset(("main", "article"))
NOT_MAIN_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
# Words of classes and ids.  The first name parts apart wherever they stand, the second where only they and the third make up the name.
APART_NAMES = frozenset(
    "advert adverts advertisement advertising cookies gdpr sidebar navbar breadcrumb breadcrumbs comments commentlist disqus newsletter sponsored paywall".split()
)
APART_WORDS = frozenset(
    "ad ads banner cookie consent menu nav navigation comment replies respond footer header masthead notice notification alert subscribe subscription promo"
    " promotion sponsor social share sharing popup modal overlay login signup search widget toolbar pagination pager skip".split()
)
NEUTRAL_WORDS = frozenset(
    "top bottom left right upper lower main site page global primary secondary inner outer box bar block list item items area wrapper wrap container unit slot section"
    " form link links button buttons icons content text body first last mobile desktop".split()
)

_ATTRS = r"""(?:=\s*+(?:"[^"]*+"|'[^']*+'|[^\s<>"'][^\s<>]*+|(?=>))|[^=<>]++)*+"""
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])" + _ATTRS + r">.*?(?:</(?P=raw)(?=[\s/>])[^<>]*+>?|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>" + _ATTRS + r")>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^<>]*)>"  # a quote that nothing closes
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^<>]*\Z",
    re.S | re.I,
)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")

#: What a block is: nothing special, inside an article or main element, or inside what can't be main text.
PLAIN, MAIN, APART = 0, 1, 2


class Block(NamedTuple):
    """A line of text, what it is, and the numbers of its innermost holding element and of its article or main element (0: none)."""

    text: str
    role: int
    holder: int
    region: int


def _apart_name(names: str) -> bool:
    """Whether a class or id says that the element can't be main text."""
    for name in names.split():
        words = [w for w in re.split(r"[-_]+", name) if w]
        if any(w in APART_NAMES for w in words):
            return True
        if any(w in APART_WORDS for w in words) and all(w in APART_WORDS or w in NEUTRAL_WORDS or w.isdigit() for w in words):
            return True
    return False


def _role(name: str, attrs: str, inside_main: bool) -> int:
    """MAIN, APART or PLAIN for an element by its tag, role, class and id; an article's own ``header`` holds its title."""
    if name in NOT_MAIN or name == "header" and not inside_main:
        return APART
    if attrs and not attrs.isspace():
        found = {key.lower(): value.strip("\"'").lower() for key, value in _ATTR.findall(attrs)}
        if found.get("role") in NOT_MAIN_ROLES or "hidden" in found or found.get("aria-hidden") == "true":
            return APART
        if name not in ("html", "body") and any(_apart_name(found[k]) for k in ("class", "id") if found.get(k)):
            return APART
        if found.get("role") in MAIN_ROLES or found.get("itemprop") == "articlebody":
            return MAIN
    return MAIN if name in MAIN_ROLES else PLAIN


class _Open(NamedTuple):
    """An open element: its own part, and what holds inside it."""

    name: str
    own: int
    role: int
    holder: int
    region: int
    muted: bool


def blocks(page: str) -> list[Block]:
    """The blocks of text in page order; character references decoded, white space one space, trimmed."""
    out: list[Block] = []
    outside = _Open("", PLAIN, PLAIN, 0, 0, False)
    stack: list[_Open] = []
    held: list[str] = []
    last_end: dict[str, int] = {}
    lowered: list[str] = []
    now, number = outside, 0

    def flush() -> None:
        if held:
            text = "".join(held)
            held.clear()
            text = " ".join((_html.unescape(text) if "&" in text else text).split())
            if text:
                out.append(Block(text, now.role, now.holder, now.region))

    def heard() -> _Open:
        """What holds the text that is held: the innermost element that isn't muted."""
        return next((x for x in reversed(stack) if not x.muted), outside)

    def closed_later(name: str, at: int) -> bool:
        if name not in last_end:
            if not lowered:
                lowered.append(page.lower() if len(page.lower()) == len(page) else page)
            last_end[name] = max(lowered[0].rfind(f"</{name}{c}") for c in "> \n")
        return last_end[name] >= at

    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() > at and not now.muted:
            held.append(page[at : token.start()])
        at = token.end()
        name = token["name"] or token["name2"]
        if not name:
            held.append(" ")
            continue
        name, attrs = name.lower(), token["attrs"] or token["attrs2"] or ""
        if now.muted and not (token["end"] or token["end2"]) and name not in UNSEEN:
            continue  # only what closes the element that isn't seen matters
        if name in BLOCKS and not now.muted:
            flush()
        elif name in SPACED:
            held.append(" ")
        if name in VOID:
            continue
        if token["end"] or token["end2"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name:
                    if now.muted:
                        held.append(" ")
                        now = heard()
                    below = stack[i - 1] if i else outside
                    if (below.role, below.holder, below.region) != (now.role, now.holder, now.region) and not stack[i].muted:
                        flush()
                    del stack[i:]
                    break
                if name not in BLOCKS and stack[i].name in BLOCKS:  # an inline end tag closes nothing beyond its block
                    break
        else:
            if name in FOREIGN and attrs.endswith("/"):
                held.append(" ")
                continue
            if name in CLOSES_ITSELF and stack and stack[-1].name == name:
                stack.pop()
                now = stack[-1] if stack else outside
            own = _role(name, attrs, now.region > 0)
            if own == APART and not closed_later(name, at):
                own = PLAIN
            muted = own == APART and name not in BLOCKS
            if muted:
                held.append(" ")
            elif own or name in HOLDERS:
                flush()
            if own or name in BLOCKS:
                number += 1
                role = APART if APART in (now.role, own) else max(now.role, own)
                # The outermost article, or where there is none the outermost main element.
                region = now.region
                if own == MAIN and (not region or name == "article" and not any(x.name == "article" for x in stack)):
                    region = number
                stack.append(_Open(name, own, role, number if name in HOLDERS else now.holder, region, muted or now.muted))
        now = stack[-1] if stack else outside
    if not now.muted:
        held.append(page[at:])
    now = heard()
    flush()
    return out


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` that a longest common subsequence of ``a`` and ``b`` uses.

    Equal beginnings and ends and lines that only one side has are set aside; the rest takes bit-parallel rows (one big integer for each
    line of ``a``).  Of k rows about the square root of k is kept, and the way back computes those between two of them again.
    """
    n, m, start = len(a), len(b), 0
    while start < n and start < m and a[start] == b[start]:
        start += 1
    end = 0
    while end < n - start and end < m - start and a[n - 1 - end] == b[m - 1 - end]:
        end += 1
    found = set(range(start)) | set(range(n - end, n))
    in_b, in_a = set(b[start : m - end]), set(a[start : n - end])
    at_a = [i for i in range(start, n - end) if a[i] in in_b]
    rest = [x for x in b[start : m - end] if x in in_a]
    if not at_a:
        return found
    places: dict[str, list[int]] = defaultdict(list)
    for j, x in enumerate(rest):
        places[x].append(j)
    # Only of lines that stand in many places are the columns kept as bits, so that they take no more than the rows do.
    where = {x: _bits(js, len(rest)) for x, js in places.items() if len(js) > 64}
    ones = (1 << len(rest)) - 1

    def next_row(row: int, i: int) -> int:
        at = where.get(a[i])
        if at is None:
            js = places[a[i]]
            at = 1 << js[0] if len(js) == 1 else _bits(js, js[-1] + 1)
        hit = row & at
        return ((row + hit) | (row - hit)) & ones

    step = max(1, isqrt(len(at_a)))
    row, kept = ones, []
    for k, i in enumerate(at_a):
        if k % step == 0:
            kept.append(row)
        row = next_row(row, i)
    # A zero bit j of row k says that the length of k lines grows at column j; walk back from the last row and column.
    j, length = len(rest) - 1, (~row & ones).bit_count()
    for c in range(len(kept) - 1, -1, -1):
        rows = [kept[c]]
        for i in at_a[c * step : (c + 1) * step]:
            rows.append(next_row(rows[-1], i))
        for k in range(len(rows) - 1, 0, -1):
            if not length:
                return found
            # The last column that this row's length needs; without the line it is either as long, or shorter by this line.
            j = (~rows[k] & ((1 << (j + 1)) - 1)).bit_length() - 1
            if (~rows[k - 1] & ((1 << (j + 1)) - 1)).bit_count() < length:
                found.add(at_a[c * step + k - 1])
                j, length = j - 1, length - 1
    return found


def _bits(places: list[int], size: int) -> int:
    flags = np.zeros(size, np.uint8)
    flags[places] = 1
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def decide(own: list[Block], other: list[Block] | None) -> tuple[list[int], set[int], set[int]]:
    """Positions of the lines that are a page's text, of those that differencing deleted, and of those that the veto brought back."""
    shared = common_lines([b.text for b in own], [b.text for b in other]) if other else set()
    seen = [i for i, b in enumerate(own) if b.role != APART]
    if all(i in shared for i in seen):
        shared = set()  # a copy, which can't tell template from text
    left, in_region = defaultdict(int), defaultdict(int)
    for i in seen:
        in_region[own[i].region] += len(own[i].text)
        if i not in shared:
            left[own[i].holder] += len(own[i].text)
    outside = sum(len(own[i].text) for i in seen if not own[i].region and i not in shared)
    of_region = {r: n for r, n in in_region.items() if r}
    by_region = bool(of_region) and (not other or outside <= sum(of_region.values()))
    region = max(of_region, key=of_region.get) if by_region else 0
    holder = max(left, key=left.get, default=0)
    if 2 * left[holder] <= sum(left.values()):
        holder = 0
    kept, back = [], set()
    for i in seen:
        b = own[i]
        if by_region and not b.region:
            continue
        if i not in shared:
            kept.append(i)
        elif region and b.region == region or holder and b.holder == holder:
            kept.append(i)
            back.add(i)
    return kept, shared, back


def main_text(own: list[Block], other: list[Block] | None) -> str:
    """Text of a page's blocks, given those of its nearest page."""
    return "\n\n".join(own[i].text for i in decide(own, other)[0])


def _packed(page: list[Block]) -> tuple[bytes, str]:
    """What a page's blocks are, in three numbers each, and their texts, one a line (a block holds no line end)."""
    return np.array([b[1:] for b in page], np.int32).tobytes(), "\n".join(b.text for b in page)


def _unpacked(shape: bytes, texts: str) -> list[Block]:
    if not shape:
        return []
    return [Block(t, *s) for t, s in zip(texts.split("\n"), np.frombuffer(shape, np.int32).reshape(-1, 3).tolist(), strict=True)]


def address(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL: lower-case host, path without query, fragment, trailing slash and file suffix."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), r"(\.[a-zA-Z]{2,5}|/+)$", "")
    return host, path


def _nearer(key: str, before: tuple | None, after: tuple | None) -> list | None:
    """Blocks of the neighbour of the same host that has the longer common beginning; the one before in a tie."""
    host = key.split("\0", 1)[0]
    best, longest = None, -1
    for other in (before, after):
        if other is None or not host or other[0].split("\0", 1)[0] != host:
            continue
        a, b = key.split("\0")[1], other[0].split("\0")[1]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        if n > longest:
            best, longest = other, n
    return best[1] if best else None


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text, n_chars)`` of every page."""
    spark = df.sparkSession
    host, path = address(F.col(url_col))
    # The id, and a hash for equal ids, make keys differ, so that no range has to hold all pages of one URL.
    order = F.concat_ws("\0", host, path, F.lpad(F.coalesce(F.col(id_col).cast("string"), F.lit("")), 20, "0"), F.hex(F.xxhash64(html_col)))
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), order.alias("order"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    size = rows.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    ranges = min(MAX_RANGES, size // RANGE_BYTES + 1)
    dealt = rows.select("order").repartitionByRange(ranges, "order").groupBy(F.spark_partition_id().alias("range"))
    ends = dealt.agg(F.min("order").alias("first"), F.max("order").alias("last")).orderBy("first").collect()  # a row for each range
    shared = spark.sparkContext.broadcast(([r.first for r in ends], {r.last: i for i, r in enumerate(ends)}))
    kind = dict(rows.dtypes)["id"]
    packed = f"range int, order string, guest boolean, id {kind}, url string, shape binary, texts string"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts = shared.value
        starts = {x: i for i, x in enumerate(firsts)}
        for batch in batches:
            order = batch.column("order").to_pylist()
            for begin in range(0, len(order), 256):
                part = slice(begin, begin + 256)
                size = len(order[part])
                found = [_packed(blocks(h.as_py())) for h in batch.column("html").slice(begin, size)]
                at, to, guest = [], [], []
                for i, key in enumerate(order[part]):
                    own = bisect_right(firsts, key) - 1
                    for k, visits in ((own, False), (own + 1, key in lasts), (own - 1, key in starts)):
                        if not visits and k != own or not 0 <= k < len(firsts):
                            continue
                        at.append(i), to.append(k), guest.append(k != own)
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(to, pa.int32()),
                        batch.column("order").slice(begin, size).take(take),
                        pa.array(guest, pa.bool_()),
                        batch.column("id").slice(begin, size).take(take),
                        batch.column("url").slice(begin, size).take(take),
                        pa.array([found[i][0] for i in at], pa.binary()),
                        pa.array([found[i][1] for i in at], pa.string()),
                    ],
                    names=["range", "order", "guest", "id", "url", "shape", "texts"],
                )

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, current, out = None, None, []
        for batch in batches:
            for i in range(batch.num_rows):
                page = [batch.column(k)[i].as_py() for k in range(7)]
                page = (page[1], _unpacked(page[5], page[6]), page[2], page[3], page[4], page[0])
                if current is not None:
                    together = page[5] == current[5]
                    out += finished(before, current, page if together else None)
                    before = current if together else None
                current = page
                if len(out) >= 256:
                    yield made(out)
                    out = []
        if current is not None:
            out += finished(before, current, None)
        if out:
            yield made(out)

    def finished(before, current, after) -> list[tuple]:
        if current[2]:
            return []
        text = main_text(current[1], _nearer(current[0], before, after))
        return [(current[3], current[4], text, len(text))]

    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    schema = pa.schema([("id", id_type), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    met = rows.mapInArrow(parse, packed).repartition(ranges, "range").sortWithinPartitions("range", "order", "guest")
    return met.mapInArrow(pair, f"id {kind}, url string, text string, n_chars long").select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
