"""Main text of web pages by nearest-URL page differencing.

1. Every page is cut into lines, one a block, in page order. A line is *article*
   if it stands in an article element, *main* if only in a main element, *marked*
   if an element says that it is a menu, header, footer, sidebar, notice, advert,
   form or reader comment, and *plain* otherwise. Elements around the page's
   article, html and body mark nothing. Scripts, styles and comments give no line.
2. All pages are ordered by URL path within each host. Ordering is a distributed
   range sort; only the first and last page of each partition reach the driver
   to be linked up, so the order does not depend on the partitioning and no host
   meets in one task.
3. On either side the partner is the next page that is not a copy. A copy holds
   all of the page's unmarked text, or over half of it and 200 characters at
   least. Pages next to copies go on from where those copies have come, so
   a run of copies of any length takes rounds by the logarithm of its length.
   Of the two partners the one with the longer common path prefix is taken.
4. All lines of both pages are aligned by their longest common subsequence, and shared
   ones are deleted: they are the site's, not the page's. Lines of the page's article are
   kept all the same: two pages may carry the same article. Lines are told apart
   by 64-bit hashes.
5. Lines that are left and marked (comments, adverts and menus of this page alone) go,
   too, as do articles under half as long as another one beside them. A page that has no
   partner gives its article and main lines or, where it has none, its plain lines.

Defined results: a null or empty html gives an empty text; a null url, or one
without a host, pairs with nothing; unclosed elements end with their parent;
a tag that is never closed is text if no tag is closed after it; of equally near partners
the page before wins, of equally long articles the first; repeated rows repeat their
result; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anvaya.llm.common import discard, stage

LCS_CELLS = 200_000_000
#: A page that shares over this share of a page's text, and this many characters, is a copy of it.
COPY_SHARE, COPY_LEAST = 0.5, 200
#: Element names by what they do to text.
SILENT = {"script", "style", "template", "noscript", "svg", "iframe", "object", "head", "math",
          "canvas", "audio", "video", "textarea", "select", "button", "datalist"}
MARKED = {"nav", "footer", "aside", "form", "dialog", "menu", "fieldset"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details",
    "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2",
    "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol",
    "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
        "track", "wbr"}
CORE = {"article", "main"}
#: Words of class, id and role that mark an element as not the main text.
MARK_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "adsense", "banner", "breadcrumb",
    "breadcrumbs", "comment", "comments", "commentlist", "complementary", "consent", "contentinfo",
    "cookie", "cookies", "dialog", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal",
    "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "pager", "popup",
    "promo", "promoted", "promotion", "recommended", "related", "replies", "respond", "search", "share", "sharing",
    "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription",
    "toolbar", "widget",
}
TAG = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*+))")
#: The rest of a tag; nothing is tried twice.
REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
RAW_END = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in
           ("script", "style", "textarea", "noscript", "iframe", "title")}
WORDS = re.compile(r"[a-z]+")

Line = tuple[str, int]  # text, 0 article, 1 plain, 2 marked, 3 main without an article


def _mark(name: str, attributes: str) -> int:
    """1 if the element says that it is not the main text, 2 if it is hidden, else 0."""
    own = int(name in MARKED)
    low = attributes.lower()
    if not any(key in low for key in ("class", "id", "role", "hidden", "style")):
        return own
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return 2
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return 2
        elif key in ("class", "id", "role") and name not in ("html", "body") and not MARK_WORDS.isdisjoint(
            w for token in value.split() for w in _names(token)
        ):
            own = 1
    return own


def _names(token: str) -> list[str]:
    """Words of one class token; one that tells of a state, or of results found, marks nothing."""
    words = WORDS.findall(token)
    if len(words) > 1 and (
        words[0] in ("has", "no", "with", "without") or words[-1] in ("free", "less", "result", "results")
    ):
        return []
    return words


class _Outline:
    """Marked and core elements of a page as trees: each knows the one around it, -1 for none."""

    def __init__(self) -> None:
        self.mark_above: list[int] = []
        self.mark_depth: list[int] = []
        # Of core elements: name, core element around, marks around, own mark or -1.
        self.cores: list[tuple[str, int, int, int]] = []
        self.lines: list[tuple[str, int, int, bool]] = []  # text, marks, core, hidden

    def mark(self, above: int) -> int:
        self.mark_above.append(above)
        self.mark_depth.append(self.mark_depth[above] + 1 if above >= 0 else 1)
        return len(self.mark_above) - 1

    def clean(self, void: set[int]) -> list[bool]:
        """Of each mark, whether it and all around it are void; the last entry is for none."""
        out: list[bool] = []
        for k, above in enumerate(self.mark_above):
            out.append(k in void and (above < 0 or out[above]))
        return [*out, True]

    def within(self, of: "list[bool]") -> list[bool]:
        """Of each core element, whether it or one around it is one ``of`` these; the last is for none."""
        out: list[bool] = []
        for k, (_, above, _, _) in enumerate(self.cores):
            out.append(of[k] or (above >= 0 and out[above]))
        return [*out, False]

    def kinds(self) -> list[Line]:
        """Lines with what they are, once it is known which element holds the page's article."""
        cores = self.cores
        size = [0] * len(cores)
        for text, _, core, hidden in self.lines:
            if core >= 0 and not hidden:
                size[core] += len(text)
        for k in range(len(cores) - 1, -1, -1):
            if cores[k][1] >= 0:
                size[cores[k][1]] += size[k]
        void: set[int] = set()
        teaser = [False] * len(cores)
        if any(size):
            # The least marked, then longest: what is around it marks nothing, nor does its own mark,
            # unless a clean article is as good.
            depth = lambda k: self.mark_depth[cores[k][2]] if cores[k][2] >= 0 else 0
            best = min((k for k in range(len(cores)) if size[k]), key=lambda k: (depth(k), -size[k]))
            above = cores[best][2]
            while above >= 0:
                void.add(above)
                above = self.mark_above[above]
            clean = self.clean(void)
            rivals = [k for k, c in enumerate(cores) if k != best and c[0] == "article" and clean[c[2]]]
            if not any(cores[k][3] < 0 and 2 * size[k] >= size[best] for k in rivals):
                void.add(cores[best][3])
            inside = self.within([k == best for k in range(len(cores))])
            for k in rivals:  # an article that holds most of it
                if inside[k] and 2 * size[k] > size[best]:
                    void.add(cores[k][3])
            # An article beside a much longer one announces another page.
            clean = self.clean(void)
            articles = [k for k, c in enumerate(cores) if c[0] == "article" and clean[c[2]] and (c[3] < 0 or c[3] in void)]
            if articles:
                star = max(articles, key=lambda k: (size[k], -k))
                inside = self.within([k == star for k in range(len(cores))])
                around, above = set(), star
                while above >= 0:
                    around.add(above)
                    above = cores[above][1]
                for k in articles:
                    teaser[k] = not inside[k] and k not in around and 2 * size[k] < size[star]
        clean, dropped = self.clean(void), self.within(teaser)
        article = self.within([c[0] == "article" for c in cores])
        lines = [
            (
                text, 2 if hidden or not clean[marks] or dropped[core]
                else 0 if article[core] else 3 if core >= 0 else 1,
            )
            for text, marks, core, hidden in self.lines
        ]
        if all(kind == 2 for _, kind in lines):  # nothing else is left
            lines = [(text, 0 if core >= 0 and not hidden else 2) for text, _, core, hidden in self.lines]
        return lines


def lines_of(page: str | None) -> list[Line]:
    """The lines of a page, in order, with what they are; in time linear in the page."""
    page = page or ""
    outline = _Outline()
    words: list[str] = []
    # Open elements: name, core, marks (numbers), hidden, silent (each with all that is above).
    stack: list[tuple[str, int, int, bool, bool]] = [("", -1, -1, False, False)]
    opened: Counter[str] = Counter()
    quotes = True  # until a tag does not close: from then on quotes protect nothing

    def flush() -> None:
        if words:
            text = " ".join(html.unescape("".join(words)).split())
            if text:
                _, core, marks, hidden, _ = stack[-1]
                outline.lines.append((text, marks, core, hidden))
            words.clear()

    def push(entry: tuple[str, int, int, bool, bool]) -> None:
        stack.append(entry)
        opened[entry[0]] += 1

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    at = 0
    while at < len(page):
        tag = TAG.search(page, at)
        end = -1
        if tag is not None:
            if tag[0] == "<!--":
                end = page.find("-->", tag.end()) + 2
                end = end if end > 1 else len(page)
            else:
                if tag[2] is not None and quotes:
                    end = REST.match(page, tag.end()).end()
                    quotes = end < len(page) and page[end] == ">"
                if end < 0 or not quotes:
                    end = page.find(">", tag.end())
        if tag is None or end < 0:  # no tag is closed from here on
            if not stack[-1][4]:
                words.append(page[at:])
            break
        if tag.start() > at and not stack[-1][4]:
            words.append(page[at : tag.start()])
        at = end + 1
        if tag[2] is None:
            continue
        name, rest = tag[2].lower(), page[tag.end() : end]
        if tag[1]:
            if name in BLOCKS:
                flush()
            if opened[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name == "br":
            words.append(" ")
            continue
        if name in BLOCKS:
            flush()
        if name in VOID or rest.endswith("/"):
            continue
        if name in RAW_END:
            close = RAW_END[name].search(page, at)
            at = close.end() if close else len(page)
            continue
        if name in ("p", "tr", "td", "th", "dt", "dd", "option") and stack[-1][0] == name:
            pop()  # these end an open one of their kind
        _, core, marks, hidden, silent = stack[-1]
        own = _mark(name, rest) if rest or name in MARKED else 0
        if name == "header" and core < 0:
            own = own or 1
        if name not in BLOCKS and name not in SILENT and not own:
            if name not in ("span", "b", "i", "em", "strong", "a", "font", "u", "small"):
                push((name, core, marks, hidden, silent))
            continue
        if own:
            flush()
        above, mark = marks, -1
        if own == 1:
            mark = marks = outline.mark(above)
        if name in CORE:
            outline.cores.append((name, core, above, mark))
            core = len(outline.cores) - 1
        push((name, core, marks, hidden or own == 2, silent or name in SILENT))
    flush()
    return outline.kinds()


def host_and_path(url: str | None) -> tuple[str, str]:
    """Lower-case host and path; empty host where there is none."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").lower()
    except ValueError:
        return "", ""
    return host, parts.path or "/"


def lcs(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, by bit-parallel rows."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    head = [(k, k) for k in range(start)]
    tail = [(len(a) - k, len(b) - k) for k in range(end, 0, -1)]
    x, y = a[start : len(a) - end], b[start : len(b) - end]
    if not x or not y:
        return head + tail
    if len(x) * len(y) > LCS_CELLS and len(x) > 1:  # halve x, split y where the halves fit best
        half = len(x) // 2
        left = _prefix_lengths(x[:half], y)
        right = _prefix_lengths(x[half:][::-1], y[::-1])
        cut = max(range(len(y) + 1), key=lambda k: left[k] + right[len(y) - k])
        middle = lcs(x[:half], y[:cut]) + [
            (i + half, j + cut) for i, j in lcs(x[half:], y[cut:])
        ]
    else:
        rows = list(_rows(x, y))
        middle, i, j = [], len(x) - 1, len(y) - 1
        while i >= 0 and j >= 0:
            if x[i] == y[j]:
                middle.append((i, j))
                i, j = i - 1, j - 1
            elif i > 0 and _length(rows[i - 1], j + 1) == _length(rows[i], j + 1):
                i -= 1
            else:
                j -= 1
        middle.reverse()
    return head + [(i + start, j + start) for i, j in middle] + tail


def _rows(x: list, y: list) -> Iterator[int]:
    places: dict = {}
    for j, value in enumerate(y):
        places[value] = places.get(value, 0) | 1 << j
    full = (1 << len(y)) - 1
    row = full
    for value in x:
        match = places.get(value, 0)
        row = ((row + (row & match)) | (row & ~match)) & full
        yield row


def _length(row: int, j: int) -> int:
    """Common length with the first j entries, from a row's zero bits."""
    return j - (row & ((1 << j) - 1)).bit_count()


def _prefix_lengths(x: list, y: list) -> list[int]:
    row = (1 << len(y)) - 1
    for row in _rows(x, y):  # noqa: B007  the last row is the one that counts
        pass
    lengths, n = [0], 0
    for j in range(len(y)):
        n += not row >> j & 1
        lengths.append(n)
    return lengths


def common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class _Page(NamedTuple):
    """What pairing needs of a page; ``kinds``, ``hashes`` and ``sizes`` are those of its lines."""

    uid: int
    k1: int
    k2: int
    host: str
    path: str
    kinds: list[int]
    hashes: list[int]
    sizes: list[int]

    def holds(self, other: "_Page") -> bool:
        """Whether ``other`` is a copy: it has all of the page's unmarked text, or over half of it and enough."""
        own = [(h, n) for h, n, kind in zip(self.hashes, self.sizes, self.kinds) if kind != 2]
        theirs = {h for h, kind in zip(other.hashes, other.kinds) if kind != 2}
        total, shared = sum(n for _, n in own), sum(n for h, n in own if h in theirs)
        return shared == total or (shared > COPY_SHARE * total and shared >= COPY_LEAST)


#: A link of a page on one side (0 before, 1 after): the page it leads to, and whether that is
#: still to be looked at, a copy, or the partner, then with the lines it shares and the common path.
UNTESTED, COPY, PARTNER = 0, 1, 2
LINK = "uid long, k1 long, k2 long, side int, at long, state int, n int, shared array<int>"
_LINK_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
_LINK_NAMES = ["uid", "k1", "k2", "side", "at", "state", "n", "shared"]


def _link(page: _Page, side: int, other: _Page) -> tuple:
    """The link of a page that has looked at another one."""
    if page.holds(other):
        return (*page[:3], side, other.uid, COPY, 0, None)
    shared = shared_lines(page.kinds, page.hashes, other.hashes)
    return (*page[:3], side, other.uid, PARTNER, common(page.path, other.path), shared)


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def neighbours(pages: DataFrame, partitions: int) -> DataFrame:
    """Links to the pages of the same host that are next to each by URL path.

    Neighbours within a partition have looked at each other already.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before: _Page | None = None
        rows: list[tuple] = []
        for batch in batches:
            for page in map(_Page._make, zip(*(c.to_pylist() for c in batch.columns))):
                if before is None:  # the first: a link to be joined to the partition before
                    rows.append((*page[:3], 0, None, UNTESTED, 0, None, part, page.host, page.path))
                elif before.host == page.host:
                    rows += [(*_link(before, 1, page), part, None, None), (*_link(page, 0, before), part, None, None)]
                before = page
            if len(rows) > 10_000:
                yield _batch(rows, names, kinds)
                rows = []
        if before is not None:
            rows.append((*before[:3], 1, None, UNTESTED, 0, None, part, before.host, before.path))
        if rows:
            yield _batch(rows, names, kinds)

    names = [*_LINK_NAMES, "part", "host", "path"]
    kinds = [*_LINK_TYPES, pa.int32(), pa.string(), pa.string()]
    linked = stage(
        pages.select(*_Page._fields)
        .repartitionByRange(partitions, "host", "path", "uid")
        .sortWithinPartitions("host", "path", "uid")
        .mapInArrow(run, f"{LINK}, part int, host string, path string"),
        "pagetext-order",
    )
    # Two rows a partition: the ends, which meet those of the next partition here.
    ends = linked.where("host is not null").select("side", "host", "path", "uid", "k1", "k2").collect()
    firsts = sorted((tuple(r)[1:] for r in ends if r["side"] == 0))
    lasts = sorted((tuple(r)[1:] for r in ends if r["side"] == 1))
    joins = []
    for last, first in zip(lasts, firsts[1:]):
        if last[0] == first[0]:
            joins.append((*last[2:], 1, first[2], UNTESTED, 0, None))
            joins.append((*first[2:], 0, last[2], UNTESTED, 0, None))
    found = linked.where("host is null").select(*_LINK_NAMES)
    return found.unionByName(pages.sparkSession.createDataFrame(joins, LINK)) if joins else found


def partners(pages: DataFrame, partitions: int) -> DataFrame:
    """The links of all pages to their partners: of the same host, nearest by URL path, no copies.

    While a link leads to a copy, it takes over the link of the copy, so that open links
    double their reach in every round. Only open links meet the lines of pages again.
    """
    fields = ["uid", "k1", "k2", "path", "kinds", "hashes", "sizes"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for side, *both in zip(*(c.to_pylist() for c in batch.columns)):
                sides = (both[: len(fields)], both[len(fields) :])
                page, other = (_Page(*x[:3], "", *x[3:]) for x in sides)
                rows.append(_link(page, side, other))
            yield _batch(rows, _LINK_NAMES, _LINK_TYPES)

    theirs = pages.select(*[F.col(c).alias(f"at_{c}") for c in fields]).withColumnRenamed("at_uid", "at")
    links = stage(neighbours(pages, partitions), "pagetext-links")
    while not links.where(F.col("state") != PARTNER).isEmpty():
        onward = links.select(F.col("uid").alias("at"), "side", F.col("at").alias("next"))
        moved = links.where(F.col("state") == COPY).join(onward, ["at", "side"]).select(
            "uid", "k1", "k2", "side", F.col("next").alias("at")
        ).unionByName(links.where(F.col("state") == UNTESTED).select("uid", "k1", "k2", "side", "at"))
        looked = (
            moved.select("uid", "side", "at").join(pages.select(*fields), "uid").join(theirs, "at")
            .select("side", *fields, *["at" if c == "uid" else f"at_{c}" for c in fields])
            .mapInArrow(look, LINK)
        )
        before, links = links, stage(links.where(F.col("state") == PARTNER).unionByName(looked), "pagetext-links")
        discard(before)
    return links


def line_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def shared_lines(kinds: list[int], own: list[int], other: list[int]) -> list[int]:
    """Places of the lines, given by their hashes, that the partner has, too; not of an article's."""
    return [i for i, _ in lcs(own, other) if kinds[i]]


def left_over(kinds: list[int], shared: list[int] | None) -> list[int]:
    """Places of the lines that make the text; ``shared`` is None where no partner tells."""
    if shared is not None:
        gone = set(shared)
        left = [k for k, kind in enumerate(kinds) if kind != 2 and k not in gone]
        if left:
            return left
    core = [k for k, kind in enumerate(kinds) if kind in (0, 3)]
    return core or [k for k, kind in enumerate(kinds) if kind == 1]


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_lines, n_shared, n_marked) for every row of ``pages``.

    n_shared counts the lines that differencing deletes, n_marked those that only an
    element tells to be no text of the page.
    """
    def parsed(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield make(part, [lines_of(h.as_py()) for h in part.column(4)])

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(part: pa.RecordBatch, found: list[list[Line]]) -> pa.RecordBatch:
            places = [host_and_path(u) for u in part.column(3).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(1),
                    pa.array([h for h, _ in places], pa.string()), pa.array([p for _, p in places], pa.string()),
                    pa.array([[k for _, k in lines] for lines in found], pa.list_(pa.int8())),
                    pa.array([[line_hash(t) for t, _ in lines] for lines in found], pa.list_(pa.int64())),
                    pa.array([[len(t) for t, _ in lines] for lines in found], pa.list_(pa.int32())),
                ],
                names=["k1", "k2", "host", "path", "kinds", "hashes", "sizes"],
            )

        return parsed(batches, make)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(part: pa.RecordBatch, found: list[list[Line]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    *part.columns[:4], pa.array([[k for _, k in lines] for lines in found], pa.list_(pa.int8())),
                    # Texts of marked lines are not needed again.
                    pa.array([["" if k == 2 else t for t, k in lines] for lines in found], pa.list_(pa.string())),
                ],
                names=["k1", "k2", "page_id", "url", "kinds", "texts"],
            )

        return parsed(batches, make)

    # Rows of one key are the same page.
    read = pages.select(
        F.xxhash64("page_id", "url").alias("k1"), F.xxhash64("html").alias("k2"), F.col("page_id").cast("long"), "url", "html"
    )
    rows = stage(
        read.mapInArrow(
            outline, "k1 long, k2 long, host string, path string, kinds array<byte>, hashes array<long>, sizes array<int>"
        ).where("host <> ''").withColumn("uid", F.monotonically_increasing_id()),
        "pagetext-lines",
    )
    partitions = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The longer common path; of equal ones the page before.
    best = F.max_by("shared", F.struct("n", -F.col("side")))
    decisions = stage(
        partners(rows, partitions).groupBy("k1", "k2").agg(best.alias("shared")), "pagetext-shared"
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts = [], []
            for kinds, lines, shared in zip(*(batch.column(k).to_pylist() for k in range(2, 5))):
                left = left_over(kinds, shared)
                gone = set(shared or ()).difference(left)
                found.append("\n".join(lines[k] for k in left))
                counts.append((len(found[-1]), len(kinds), len(gone), sum(x == 2 and k not in gone for k, x in enumerate(kinds))))
            numbers = [pa.array(c, pa.int64()) for c in (zip(*counts) if counts else [()] * 4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), *numbers],
                names=["page_id", "url", "text", "n_chars", "n_lines", "n_shared", "n_marked"],
            )

    # The pages are read again instead of being kept: only lines that may be text are shuffled.
    met = read.mapInArrow(
        texts, "k1 long, k2 long, page_id long, url string, kinds array<byte>, texts array<string>"
    ).join(decisions.hint("merge"), ["k1", "k2"], "left")  # alike at every size
    return met.select("page_id", "url", "kinds", "texts", "shared").mapInArrow(
        finish, "page_id long, url string, text string, n_chars long, n_lines long, n_shared long, n_marked long"
    )
