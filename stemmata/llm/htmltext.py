"""HTML extraction: structural blocks, then differencing against the page with the nearest URL.

A page is cut into text lines, one for each block, scripts and styles left out. Lines in menus, headers, footers,
sidebars, notices, adverts, forms and reader comments are chrome by their elements, those in the article (article or main)
are safe, all others are open. Pages are sorted by URL path within their host, each is aligned with the nearer of the pages
before and after it by longest common subsequence, and its shared lines that are not safe are deleted. One article at two
addresses is told by the lines that the page doesn't share with its other neighbour: if the nearer has over `copy_share` of
them, the other neighbour is taken; see deleted(). What chrome is left, a page's own menu or footer, goes by its elements.

Every page is differenced, in one of two series. Pages with open lines are neighbours of each other by their open and safe
lines: there the alignment alone decides. Pages without are neighbours of each other by all their lines, chrome included:
an article that says where it stands tells one that doesn't nothing about its template. Safe lines are needed because two
articles may quote the same passage.

Neighbours are found on line hashes alone: distinct pages (host, path, key, hashes of lines) are dealt out in ranges of that
order, so a large host or one path with many pages spreads over tasks, and every range gets the last page of the range
before and the first of the range after, so no page loses a neighbour. The table's size decides nothing. Pages are cut a
second time, rather than kept on disk meanwhile, to meet their deleted lines by an equality join.

Defined results: a null or empty page has empty text; a null url pairs among null urls; ties in nearness go to the page
before; repeated rows (key, url, text) count once as neighbours and each give a row; very long pages are read in linear
time; a page cut off inside a tag ends there; an element that is never closed doesn't swallow the article after it; a class
never makes an article chrome, unless it says reader comments; if no article stands outside such elements, the one inside
an element that is such only by its class, or a form, is the page's, and if there is no other text at all, the one inside
any but reader comments; <br> ends a line: it is a break of the page's own, not white space; an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import saved
from .urlfilter import parts

OPENING = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: The rest of a tag; a quote counts only behind an equals sign. Possessive, so that a failure is found in one pass.
REST = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>""")
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?![\w-])(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
NAME = re.compile(r"[a-z]+")

#: Elements by their meaning, and words of class, id and role that mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg textarea iframe title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CHROME = frozenset("nav footer aside form button select menu dialog head object fieldset datalist".split())
MARKS = frozenset("ad ads adv advert advertisement advertising adslot sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs pagination pager share sharing social related recommended comment comments disqus reply replies footer newsletter subscribe subscription signup login search searchbox widget responses complementary contentinfo masthead toolbar".split())
READERS = frozenset("comment comments disqus reply replies responses".split())
ARTICLE, FRAMES = frozenset("article main".split()), frozenset("body html".split())
LAYOUT = frozenset("form object fieldset".split())  # chrome that may stand around a whole page
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


RAW_END = {name: re.compile(f"</{name}", re.I) for name in RAW}


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", name, attributes) and ("close", name, "") in order; comments and raw elements left out.

    Every step moves on, and an end that is looked for in vain ends the page or the mode, so the time is linear.
    """
    at, quotes = 0, True
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            start = len(page)
        if start > at:
            yield "text", page[at:start], ""
        if page.startswith(("<!", "<?"), start):
            mark = "-->" if page.startswith("<!--", start) else ">"
            end = page.find(mark, start + 2)
            at = end + len(mark) if end >= 0 else len(page)
            continue
        m = OPENING.match(page, start)
        if not m:
            if start < len(page):
                yield "text", "<", ""
            at = start + 1
            continue
        rest = REST.match(page, m.end()) if quotes else None
        quotes = rest is not None  # if not, no tag from here on ends outside a quote
        at = rest.end() if rest else page.find(">", m.end()) + 1
        if not at:
            return
        name = m[2].lower()
        if m[1]:
            yield "close", name, ""
        elif name in RAW:
            end = RAW_END[name].search(page, at)
            at = page.find(">", end.end()) + 1 if end else 0
            if not at:
                return
        else:
            yield "open", name, page[m.end() : at - 1]


def _marks(attributes: str) -> tuple[bool, bool]:
    """(whether class, id or role name something that is not the article, or the element is hidden; whether reader comments)."""
    bad = readers = False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            bad = True
        if name in ("class", "id", "role"):
            words = NAME.findall(value)
            bad |= not MARKS.isdisjoint(words)
            readers |= not READERS.isdisjoint(words)
    return bad, readers


def _hidden(attributes: str) -> bool:
    return any(name.lower() == "hidden" or name.lower() == "aria-hidden" and value.strip("\"'").lower() == "true" for name, value in ATTRIBUTE.findall(attributes))


def _whole(attributes: str) -> bool:
    """Whether a class, id or role is such a word as a whole, not one of its parts: sidebar, not has-sidebar."""
    return any(not MARKS.isdisjoint(value.strip("\"'").lower().split()) for name, value in ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id", "role"))


def _closed(given: list[tuple[str, str, str]]) -> dict[int, bool]:
    """Which opening tags have an end tag, the latest open one of a name takes it, and whether an article of no reader starts between."""
    waiting: dict[str, list[tuple[int, int]]] = {}
    out, articles = {}, 0
    for i, (kind, name, attributes) in enumerate(given):
        if kind == "open":
            waiting.setdefault(name, []).append((i, articles))
            articles += (name in ARTICLE or 'role="main"' in attributes) and not _marks(attributes)[1]
        elif kind == "close" and waiting.get(name):
            start, before = waiting[name].pop()
            out[start] = articles > before + (given[start][1] in ARTICLE)
    return out


@dataclass(slots=True)
class Element:
    name: str
    chrome: bool
    article: bool
    readers: bool
    closed: bool
    soft: bool = False  # chrome by the words of its class alone
    resume: tuple[int, int] | None = None  # what was open around an article that stands in soft chrome


class Outline:
    """The text lines of a page, each with whether it is safe: in an article. `every` has those of chrome as well, marked None.

    Open elements are a stack. `names` counts them by name since the innermost article, so a stray end tag costs one look;
    `blocks` holds the places of those that are not inline, so an implied end costs one look as well; `frames` counts body and html.
    """

    def __init__(self, given: list[tuple[str, str, str]], closed: dict[int, bool], release: int = 0):
        self.stack: list[Element] = []
        self.names, self.articles, self.blocks, self.frames = [Counter()], [], [], Counter()
        self.chrome = self.walled = self.readers = self.hard = 0  # open elements of a kind; walled: chrome that has an end tag; hard: chrome that isn't soft
        self.swallowed = False  # an article stood in chrome other than reader comments
        self.lines: list[tuple[str, bool]] = []
        self.every: list[tuple[str, bool | None]] = []
        self.buffer: list[str] = []
        self.aside: list[str] = []  # text of chrome; inline chrome doesn't cut the line that it stands in
        for i, (kind, value, attributes) in enumerate(given):
            if kind == "text":
                (self.aside if self.chrome else self.buffer).append(entities.unescape(value) if "&" in value else value)
                continue
            if value not in INLINE:
                if not self.chrome:
                    self._flush()
                self._flush_aside()
            if kind == "close":
                self._end(value)
            elif value not in VOID:
                self._start(value, attributes, i in closed, release, bool(release and closed.get(i)))
        self._flush()
        self._flush_aside()

    def _flush(self) -> None:
        if self.buffer:
            line = " ".join("".join(self.buffer).split())
            if line:
                self.lines.append((line, bool(self.articles)))
                self.every.append(self.lines[-1])
            self.buffer.clear()

    def _flush_aside(self) -> None:
        if self.aside:
            line = " ".join("".join(self.aside).split())
            if line:
                self.every.append((line, None))
            self.aside.clear()

    def _pop(self, index: int) -> None:
        while len(self.stack) > index:
            e = self.stack.pop()
            if e.article:
                self.names.pop()
                self.articles.pop()
            self.names[-1][e.name] -= 1
            self.frames[e.name] -= e.name in FRAMES
            self.chrome -= e.chrome
            self.walled -= e.chrome and e.closed
            self.readers -= e.readers
            self.hard -= e.chrome and not e.soft
            if e.resume:
                self.chrome, self.walled = e.resume
        while self.blocks and self.blocks[-1] >= index:
            self.blocks.pop()

    def _end(self, name: str) -> None:
        """A stray end tag closes nothing; none but that of body or html closes anything around the innermost article."""
        own = self.names[-1][name] > 0 or bool(self.articles) and self.stack[self.articles[-1]].name == name
        if own or self.frames[name] > 0:
            i = len(self.stack) - 1
            while self.stack[i].name != name:
                i -= 1
            self._pop(i)

    def _start(self, name: str, attributes: str, closed: bool, release: int, layout: bool) -> None:
        """layout: the element stands around an article, so its class says where the article is, not that it is none."""
        if name in CLOSES and self.blocks and self.stack[self.blocks[-1]].name in CLOSES[name]:
            self._pop(self.blocks[-1])
        marked, readers = _marks(attributes) if attributes and name not in FRAMES else (False, False)
        hidden = marked and _hidden(attributes)
        if not readers and (name in ARTICLE or layout and not _whole(attributes)):
            marked = hidden  # a class is no reason to lose an article
        chrome = (name in CHROME and not (layout and name in LAYOUT)) or name == "header" and not self.articles or marked
        resume = None
        soft = chrome and release > 0 and name not in CHROME and name != "header" and not readers and not hidden
        article = not chrome and (name in ARTICLE or "role" in attributes and 'role="main"' in attributes)
        if article and self.chrome and not self.articles:
            if not self.walled or release > 1 and not self.readers:
                self._pop(0)  # an element that is never closed doesn't swallow the article
            elif release and not self.hard:
                resume, self.chrome, self.walled = (self.chrome, self.walled), 0, 0
            else:
                self.swallowed |= not self.readers
                article = False
        if attributes.rstrip().endswith("/") and name not in ARTICLE:
            return
        e = Element(name, chrome, article and not self.chrome, readers, closed, soft, resume)
        self.names[-1][name] += 1
        self.frames[name] += name in FRAMES
        if name not in INLINE:
            self.blocks.append(len(self.stack))
        if e.article:
            self.articles.append(len(self.stack))
            self.names.append(Counter())
        self.stack.append(e)
        self.chrome += chrome
        self.walled += chrome and closed
        self.readers += readers
        self.hard += chrome and not soft


def outline(page: str | None) -> Outline:
    given = list(tokens(page or ""))
    closed = _closed(given)
    out = Outline(given, closed)
    if out.swallowed and not any(safe for _, safe in out.lines):  # the page's article, if it has one, stands in such an element
        inner = Outline(given, closed, release=1)
        out = inner if any(safe for _, safe in inner.lines) else out
    return out if out.lines or not out.swallowed else Outline(given, closed, release=2)


def lines_of(page: str | None) -> list[tuple[str, bool]]:
    """The lines of a page that are not chrome, each with whether it stands in an article."""
    return outline(page).lines


def compared(page: str | None) -> tuple[list[tuple[str, bool | None]], bool]:
    """The lines that a page is differenced by, each with whether it is safe, None for chrome; and whether the page has open lines."""
    out = outline(page)
    shown = not all(safe for _, safe in out.lines)
    return out.lines if shown else out.every, shown


def _rows(a: list, b: list) -> Iterator[int]:
    """For each line of a, a bit for each line of b: zeros count the subsequence of the lines so far. Bit-parallel."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _aligned(a: list, b: list, room: int) -> list[int]:
    if len(a) > 1 and len(a) * len(b) > room:  # halve a where the subsequences of both halves are longest together
        half, lengths = len(a) // 2, []
        for x, y in ((a[:half], b), (a[half:][::-1], b[::-1])):
            *_, v = _rows(x, y)
            bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
            lengths.append(np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64)))))
        at = int((lengths[0] + lengths[1][::-1]).argmax())
        return _aligned(a[:half], b[:at], room) + [half + i for i in _aligned(a[half:], b[at:], room)]
    rows, out, j = list(_rows(a, b)), [], len(b)
    zeros = lambda r: j - (r & ((1 << j) - 1)).bit_count()
    for i in range(len(a) - 1, -1, -1):
        # a zero bit below j in this row but not in the one above: the subsequence gained a line here
        gone = zeros(rows[i - 1]) if i else 0
        if zeros(rows[i]) > gone:
            out.append(i)
            while zeros(rows[i]) > gone:
                j -= 1
    return out[::-1]


def common(a: list, b: list, room: int = 1 << 28) -> list[int]:
    """Indices in a of one longest common subsequence. room: bits of memory at most, beyond which a is halved."""
    least, start, end = min(len(a), len(b)), 0, 0
    while start < least and a[start] == b[start]:
        start += 1
    while end < least - start and a[-1 - end] == b[-1 - end]:
        end += 1
    x, y = a[start : len(a) - end], b[start : len(b) - end]
    both = set(x) & set(y)
    own = [i for i, line in enumerate(x) if line in both]
    middle = _aligned([x[i] for i in own], [line for line in y if line in both], room) if both else []
    return [*range(start), *(start + own[i] for i in middle), *range(len(a) - end, len(a))]


def nearness(a: str, b: str) -> int:
    """Leading characters that two paths share."""
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def deleted(own: list, safe: list[bool], near: list | None, far: list | None = None, copy_share: float = 0.8) -> list[int]:
    """The indices in own of the unsafe lines that the alignment with near has; with far, if near is a copy.

    Lines not shared with far are own's proper lines: near is a copy if it has over copy_share of them. Without far, near
    is a copy if one of the two has no line that the other lacks. Nothing goes if nothing tells them apart, or if nothing
    were left.
    """
    if near is None:
        return []
    gone = set(common(own, near))
    if far is not None:
        other = set(common(own, far))
        proper = set(range(len(own))) - other
        if proper and len(gone & proper) > copy_share * len(proper):
            gone = other
    elif len(gone) == len(near):
        return []
    gone = sorted(i for i in gone if not safe[i])
    return gone if len(gone) < len(own) else []


def _hashes(lines: list[str]) -> list[int]:
    return [xxhash.xxh64_intdigest(x) - (1 << 63) for x in lines]


def alignments(pages: DataFrame, copy_share: float = 0.8) -> DataFrame:
    """_key, _sign, gone: the deleted line indices of the distinct pages (_shown, _host, _path, _key, _sign, _hash, _safe) that lose any. _shown: the series of a page."""
    names = ["_shown", "_host", "_path", "_key", "_sign", "_hash", "_safe"]
    order = ["_shown", "_host", "_path", "_key", "_sign"]
    place, row = F.struct(*order), F.struct(*names)
    ranges = saved(pages.select(*names).distinct().repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    ends = ranges.groupBy("_part").agg(F.min_by(row, place).alias("first"), F.max_by(row, place).alias("last"))  # two pages a range
    w = Window.orderBy("_part")
    ends = ends.select("first", "last", F.lag("_part").over(w).alias("before"), F.lead("_part").over(w).alias("after"))
    guests = ends.select(F.explode(F.array(F.struct(F.col("before").alias("_part"), F.col("first").alias("x")), F.struct(F.col("after").alias("_part"), F.col("last").alias("x")))).alias("g"))
    guests = guests.where("g._part IS NOT NULL").select("g.x.*", "g._part").withColumn("_guest", F.lit(True))
    dealt = ranges.withColumn("_guest", F.lit(False)).unionByName(guests).repartition("_part").sortWithinPartitions("_part", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = page = kinds = None

        def row(prev, own, after):
            near = [x for x in (prev, after) if x is not None and x[:3] == own[:3]]
            near = [x[6] for x in sorted(near, key=lambda x: -nearness(x[3] or "", own[3] or ""))] + [None, None]
            gone = deleted(own[6], own[7], near[0], near[1], copy_share)
            return [(own[4], own[5], gone)] if gone else []

        def table(rows) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((kinds, pa.int64(), pa.list_(pa.int32())))], ["_key", "_sign", "gone"])

        for b in batches:
            kinds, rows = b.schema.field("_key").type, []
            for at in zip(*(c.to_pylist() for c in b.columns)):
                if page is not None and not page[8]:
                    rows += row(before, page, at)
                before, page = page, at
            yield table(rows)
        if page is not None and not page[8]:
            yield table(row(before, page, None))

    kind = pages.schema["_key"].dataType.simpleString()
    return dealt.select("_part", *names, "_guest").mapInArrow(run, f"_key {kind}, _sign long, gone array<int>")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", copy_share: float = 0.8) -> DataFrame:
    """key, url, text, n_chars: a row for each row of pages."""
    kind = pages.schema[key].dataType.simpleString()
    asked = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(html).alias("_html"))

    def signed(b: pa.RecordBatch) -> Iterator[tuple[list[tuple[str, bool | None]], bool, int]]:
        for at, page in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            lines, shown = compared(page)
            yield lines, shown, xxhash.xxh64_intdigest("\n".join(["" if at is None else f"<{at}>", *(x for x, _ in lines)])) - (1 << 63)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines, shown, sign = zip(*signed(b)) if len(b) else ((), (), ())
            hashes, safe = [_hashes([x for x, _ in page]) for page in lines], [[bool(s) for _, s in page] for page in lines]
            arrays = pa.array(shown, pa.bool_()), pa.array(sign, pa.int64()), pa.array(hashes, pa.list_(pa.int64())), pa.array(safe, pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *arrays], ["_key", "_url", "_shown", "_sign", "_hash", "_safe"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines, _, sign = zip(*signed(b)) if len(b) else ((), (), ())
            own = [[None if s is None else x for x, s in page] for page in lines]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(sign, pa.int64()), pa.array(own, pa.list_(pa.string()))], ["_key", "_url", "_sign", "_lines"])

    host, path = parts(F.col("_url"))
    seen = asked.mapInArrow(hashed, f"_key {kind}, _url string, _shown boolean, _sign long, _hash array<long>, _safe array<boolean>").where("size(_hash) > 0")
    # a closing slash and a file ending say nothing about nearness
    seen = seen.withColumns({"_host": host, "_path": F.regexp_replace(path, r"/+$|\.[A-Za-z0-9]{1,5}$", "")})
    g = alignments(seen, copy_share).toDF("_k", "_s", "gone")
    a = asked.mapInArrow(cut, f"_key {kind}, _url string, _sign long, _lines array<string>")  # a line of chrome is null: it goes, shared or not
    met = a.join(g, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_sign") == F.col("_s")), "left")
    left = F.when(F.col("gone").isNull(), F.col("_lines")).otherwise(F.filter("_lines", lambda _, i: ~F.array_contains("gone", i)))
    text = met.select("_key", "_url", F.array_join(left, "\n").alias("text"))
    return text.select(F.col("_key").alias(key), F.col("_url").alias("url"), "text", F.char_length("text").cast("long").alias("n_chars"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
