"""Main text of web pages by template deduction from equivalence classes of tokens.

A page is cut into tokens: the tags of its blocks, told apart by the path of
elements they stand in, and the texts of its blocks.  For each host, a token's
occurrence vector says how often it occurs in each distinct page; copies of one
page count once.  Tokens with equal vectors form an equivalence class; classes of
at least two tokens that occur in a good share of the host's pages are its
template.  On a page a class is valid if its tokens come in the class's order, and
nests if it lies whole between two neighbouring tokens of another.  What stands
between the tokens of valid, nested classes is the page's slots.

The template decides on a page it fits:

* The main slot is the article or main element that a class has once on nearly
  every page (``most``) of the host.  Others, such as teasers or an article on a
  few pages, are not.  Without such an element all slots are read.
* Text of a class is template and goes.  Inside the main slot it must be on nearly
  every page, of at least ``sure_pages``, and it stays where it makes up more than
  ``most_shared`` of the page's main slot: then the pages are near copies of one
  another, and what they share is their article.
* A box (div, section, list or table) that a class has once on nearly every page
  and whose text is nearly all links is a menu and goes.

Where no template fits (hosts of fewer than ``min_pages`` distinct pages, odd
pages) every article and main element is read, or the whole page if it has none.
Everywhere, what the elements of HTML themselves say is not the article goes:
navigation, headers (but those of an article), footers, asides, forms, scripts,
styles; and, as HTML has no element for them, boxes whose class or id is exactly
one of the names in ``NAMED`` or ``COMMENTS``: adverts, menus, sidebars, reader comments.

Defined results: a null page is the empty page, with empty text; a null url is a
host of its own; markup that is cut off at the end is markup; rows that repeat a
page are extracted alike; very deep pages take memory in proportion to their
length; other columns are ignored; an empty table gives an empty table.

Scale: pages are dealt by a hash of their payload, so that copies meet, and hosts
are never gathered: vectors are compared by sums of hashes, one for each page,
pre-aggregated in each batch and again before the shuffle.  A template's size is
bounded by the tokens of a page over ``min_share``.  Templates are broadcast while
they are under ``broadcast_tokens`` tokens in all; beyond, pages are joined with
them by host, where Spark splits large hosts.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialise, small_batches

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][\w:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)"""
    r"|</?[a-zA-Z][^>]*(?:>|\Z)"
    r"|</?\Z"
    r"|[^<]+|<",
    re.DOTALL,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_RAW = {"script", "style", "template", "noscript", "textarea", "iframe", "svg", "title", "math", "object", "canvas", "select", "noframes"}
_DROPPED = _RAW | {"head", "nav", "footer", "aside", "button", "menu", "dialog", "input", "label", "option"}
_MAIN = {"article", "main"}
_BOXES = {"div", "section", "ul", "ol", "dl", "table"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i",
    "img", "ins", "kbd", "mark", "q", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
    "tt", "u", "var", "wbr",
}
#: Whole class names or ids of boxes that hold what is left out and HTML has no element for; an article inside stays,
#: but for one among reader comments.
NAMED = {"ad", "ads", "advert", "advertisement", "menu", "sidebar", "sidebar-left", "sidebar-right"}
COMMENTS = {"comments", "disqus_thread"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOP = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

#: How an element drops its text: not; always; but for an article below (forms, names); outside articles (headers).
KEEP, FIRM, SOFT, HEADER = 0, 1, 2, 3
#: What a template's token is for: nothing more; opening the main slot; opening a menu; text.
PLAIN, MAIN, MENU, TEXT = 0, 1, 2, 3

_MASK = (1 << 63) - 1


def _hash(said: str) -> int:
    return xxhash.xxh64_intdigest(said.encode("utf-8", "surrogatepass")) >> 1


class Page:
    """A page's units, (role, element, text or None for a tag), and its elements; element 0 is the page."""

    def __init__(self, source: str | None):
        self.units: list[tuple[int, int, str | None]] = []
        self.parent, self.drops, self.main, self.box, self.opened = [-1], [KEEP], [False], [False], [-1]
        self.chars, self.linked = [0], [0]  # of all text in an element, once it is closed
        self._paths = [0]
        self._open = [0]
        self._names = [""]
        self._at: dict[str, list[int]] = {}  # of each name, where in the stack it is open
        self._block: list[str] = []
        self._links = 0  # characters of the block that are links
        self._in_link = False
        self._known: dict[str, int] = {}
        self._cut(source or "")
        while len(self._open) > 1:
            self._pop()
        self._flush()

    def _word(self, said: str) -> int:
        got = self._known.get(said)
        if got is None:
            got = self._known[said] = _hash(said)
        return got

    def _cut(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            m = _TOKEN.match(source, at)
            at = m.end()
            name = m[2]
            if name is None:
                piece = m[0]
                if piece[0] != "<" or piece == "<":
                    piece = html_lib.unescape(piece) if "&" in piece else piece
                    self._block.append(piece)
                    self._links += len(piece) * self._in_link
                continue
            name = name.lower()
            if m[1]:
                self._close(name)
            else:
                self._start(name, m[3] or "")
                if name in _RAW and not m[0].endswith("/>"):
                    close = re.compile(f"</{re.escape(name)}(?=[\\s/>]|\\Z)", re.IGNORECASE).search(source, at)
                    at = close.start() if close else end

    def _flush(self) -> None:
        """Ends a block of text."""
        if not self._block:
            return
        said = " ".join("".join(self._block).split())
        if said:
            e = self._open[-1]
            self.units.append(((self._paths[-1] ^ _hash(said)) & _MASK, e, said))
            self.chars[e] += len(said)
            self.linked[e] += min(len(said), self._links)
        self._block, self._links = [], 0

    def _start(self, name: str, attributes: str) -> None:
        if name in _INLINE:
            if name == "br":
                self._block.append(" ")
            elif name == "a":
                self._in_link = True
            return
        self._end_implied(name)
        self._flush()
        if name in _VOID:
            return
        names = [x.lower() for g in _NAMES.findall(attributes) for x in g if x] if attributes else []
        drops = FIRM if name in _DROPPED else SOFT if name == "form" else HEADER if name == "header" else KEEP
        if names and name in _BOXES:
            whole = {n for x in names for n in x.split()}
            drops = FIRM if whole & COMMENTS else SOFT if whole & NAMED else drops
        path = ((self._paths[-1] + self._word(f"{name} {' '.join(names)}")) * 0x9E3779B97F4A7C15) & _MASK
        e = len(self.parent)
        self.units.append((path, e, None))
        self.parent.append(self._open[-1])
        self.drops.append(drops)
        self.main.append(name in _MAIN)
        self.box.append(name in _BOXES)
        self.opened.append(len(self.units) - 1)
        self.chars.append(0)
        self.linked.append(0)
        self._at.setdefault(name, []).append(len(self._open))
        self._open.append(e)
        self._names.append(name)
        self._paths.append(path)

    def _last(self, names) -> int:
        return max((self._at[n][-1] for n in names if self._at.get(n)), default=0)

    def _end_implied(self, name: str) -> None:
        """Ends what a start tag ends without saying so: a paragraph, or the item before."""
        if self._names[-1] == "p":
            self._pop()
        if name in _CLOSES:
            to = self._last(_CLOSES[name])
            if to > self._last(_STOP[name]):
                while len(self._open) > to:
                    self._pop()

    def _pop(self) -> None:
        self._flush()
        e, path = self._open.pop(), self._paths.pop()
        self._at[self._names.pop()].pop()
        self.units.append((path ^ 1, e, None))
        up = self.parent[e]
        self.chars[up] += self.chars[e]
        self.linked[up] += self.linked[e]
        self._in_link = False

    def _close(self, name: str) -> None:
        if name in _INLINE:
            self._in_link = self._in_link and name != "a"
            return
        if self._at.get(name):
            to = self._at[name][-1]
            while len(self._open) > to:
                self._pop()
        else:
            self._flush()


def host_of(url: str | None) -> str | None:
    try:
        return None if url is None else urlsplit(url.strip()).netloc.lower()
    except ValueError:
        return ""


def host_key(url: str | None) -> int:
    """A host as a number; urls without one, and no url, have their own."""
    host = host_of(url)
    return -1 if host is None else _hash(host)


class Template:
    """A host's classes, each with its roles in order of their mean place, and what roles are for."""

    def __init__(self, rows=()):
        self.classes: dict[int, list[int]] = {}
        self.uses: dict[int, int] = {}
        self.sure: set[int] = set()
        for r in rows:
            self.classes.setdefault(r["class"], []).append(r["role"])
            self.uses[r["role"]] = r["use"]
            if r["sure"]:
                self.sure.add(r["role"])


def valid_classes(classes: dict[int, list[int]], roles: list[int]) -> dict[int, list[list[int]]]:
    """The classes that come in order on a page, with the positions of each of their rounds.

    ``classes`` lists the roles of each class in order.  A class that neither
    contains nor avoids another, rounds and gaps compared, is left out, the
    smaller one first.
    """
    owner = {role: (c, i) for c, members in classes.items() for i, role in enumerate(members)}
    rounds: dict[int, list[list[int]]] = {}
    broken = set()
    for at, role in enumerate(roles):
        if role not in owner:
            continue
        c, i = owner[role]
        mine = rounds.setdefault(c, [])
        if i == 0:
            if mine and len(mine[-1]) < len(classes[c]):
                broken.add(c)
            mine.append([at])
        elif mine and len(mine[-1]) == i:
            mine[-1].append(at)
        else:
            broken.add(c)
    whole = {c: r for c, r in rounds.items() if c not in broken and len(r[-1]) == len(classes[c])}
    kept: dict[int, tuple[list[list[int]], list[int]]] = {}
    for c in sorted(whole, key=lambda c: (-len(classes[c]), c)):
        marks = [x for r in whole[c] for x in r]
        if all(_nested(whole[c], theirs) or _nested(other, marks) for other, theirs in kept.values()):
            kept[c] = whole[c], marks
    return {c: r for c, (r, _) in kept.items()}


def _nested(inner: list[list[int]], marks: list[int]) -> bool:
    """Whether each round of ``inner`` lies in one gap between ``marks``."""
    return all(bisect_left(marks, r[0]) == bisect_left(marks, r[-1]) for r in inner)


def main_text(page: Page, template: Template | None = None, most_shared: float = 0.3) -> str:
    """The blocks of the main slot, or of all slots if there is none, less template and what elements leave out."""
    marks: set[int] = set()
    if template is not None and template.classes:
        found = valid_classes(template.classes, [role for role, _, _ in page.units])
        marks = {at for rounds in found.values() for r in rounds for at in r}
    uses = template.uses if marks else {}
    use_of = [uses.get(page.units[at][0], PLAIN) if at in marks else PLAIN for at in page.opened]
    n = len(page.parent)

    def states(is_main) -> tuple[list[bool], list[int], bool]:
        inside, gone, any_main = [False] * n, [KEEP] * n, False
        for e in range(1, n):
            up = page.parent[e]
            inside[e], gone[e] = inside[up], gone[up]
            if not inside[e] and gone[e] != FIRM and is_main(e):
                inside[e], gone[e], any_main = True, KEEP, True
            own = page.drops[e]
            if own == HEADER and inside[e]:
                own = KEEP
            if use_of[e] == MENU:
                own = FIRM
            if own == FIRM or (own != KEEP and gone[e] == KEEP):
                gone[e] = own
        return inside, gone, any_main

    inside, gone, any_main = states(lambda e: use_of[e] == MAIN)
    if not any_main:
        inside, gone, any_main = states(lambda e: page.main[e])
    blocks: list[tuple[str, bool]] = []
    for at, (role, e, said) in enumerate(page.units):
        if said is None or gone[e] != KEEP or (any_main and not inside[e]):
            continue
        shared = at in marks and uses.get(role) == TEXT and (not inside[e] or role in template.sure)
        blocks.append((said, shared))
    if any_main and sum(len(b) for b, s in blocks if s) > most_shared * sum(len(b) for b, _ in blocks):
        blocks = [(b, False) for b, _ in blocks]
    return "\n".join(b for b, shared in blocks if not shared)


_SUMS = ("pages", "total", "one", "two", "place", "chars", "linked")
_STATS = f"host bigint, role bigint, what int, {', '.join(f'{c} bigint' for c in _SUMS)}"


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token sums of each host's distinct pages; pages of equal payload come in one task."""
    seen: set[tuple[int, bytes]] = set()
    for batch in batches:
        sums: dict[tuple[int, int, int], list[int]] = {}
        columns = [batch.column(c).to_pylist() for c in ("payload", "url", "html")]
        for payload, url, source in zip(*columns, strict=True):
            host = host_key(url)
            if (host, payload) in seen:
                continue
            seen.add((host, payload))
            page = Page(source)
            counts: dict[tuple[int, int], list[int]] = {}
            for place, (role, e, said) in enumerate(page.units):
                opens = said is None and page.opened[e] == place
                what = TEXT if said is not None else MAIN if opens and page.main[e] else MENU if opens and page.box[e] else PLAIN
                mine = counts.get((role, what))
                if mine is None:
                    mine = counts[role, what] = [0, place, 0, 0]
                mine[0] += 1
                if opens:
                    mine[2] += page.chars[e]
                    mine[3] += page.linked[e]
            key = int.from_bytes(payload[:8], "big")
            known = sums.setdefault((host, 0, PLAIN), [0] * len(_SUMS))
            known[0] += 1
            for (role, what), (n, place, chars, linked) in counts.items():
                h = (((key ^ n) * 0xFF51AFD7ED558CCD) >> 7) & _MASK
                s = sums.get((host, role, what))
                if s is None:
                    s = sums[host, role, what] = [0] * len(_SUMS)
                for i, x in enumerate((1, n, h & 0x7FFFFFFF, h >> 32, place, chars, linked)):
                    s[i] += x
        hosts, roles, whats = zip(*sums, strict=True) if sums else ((), (), ())
        numbers = list(zip(*sums.values(), strict=True)) if sums else [()] * len(_SUMS)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(hosts, pa.int64()),
                pa.array(roles, pa.int64()),
                pa.array(whats, pa.int32()),
                *(pa.array(x, pa.int64()) for x in numbers),
            ],
            ["host", "role", "what", *_SUMS],
        )


def deduce(
    pages: DataFrame,
    *,
    url_col: str = "url",
    html_col: str = "html",
    min_pages: int = 3,
    min_share: float = 0.5,
    min_size: int = 2,
    most: float = 0.9,
    sure_pages: int = 5,
    menu_share: float = 0.8,
) -> DataFrame:
    """Per host (as a number), its template: an array of (class, place, role, use, sure), classes told apart by a hash."""
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col(html_col), F.lit(""))
    payload = F.unhex(F.sha1(html.cast("binary")))
    rows = pages.select(payload.alias("payload"), F.col(url_col).alias("url"), html.alias("html")).repartition("payload")
    sums = (
        rows.mapInArrow(_statistics, _STATS)
        .groupBy("host", "role", "what")
        .agg(*[F.sum(c).alias(c) for c in _SUMS])
        .where(F.col("pages") >= min_pages)
    )
    sums = materialise(sums, "tokens")
    hosts = sums.where("role = 0").select(F.col("host").alias("of"), F.col("pages").alias("all_pages"))
    usual = F.col("pages") >= most * F.col("all_pages")
    once = usual & (F.col("total") == F.col("pages"))
    menu = once & (F.col("pages") >= sure_pages) & (F.col("linked") >= menu_share * F.col("chars")) & (F.col("chars") > 0)
    use = (
        F.when(F.col("what") == TEXT, TEXT)
        .when((F.col("what") == MAIN) & once, MAIN)
        .when((F.col("what") == MENU) & menu, MENU)
        .otherwise(PLAIN)
    )
    frequent = (
        sums.where("role <> 0")
        .join(hosts, F.col("host") == F.col("of"))
        .where(F.col("pages") >= min_share * F.col("all_pages"))
        .select(
            "host",
            "role",
            F.xxhash64("pages", "total", "one", "two").alias("class"),
            (F.col("place") / F.col("pages")).alias("place"),
            use.alias("use"),
            (usual & (F.col("pages") >= sure_pages)).alias("sure"),
        )
    )
    sizes = frequent.groupBy(F.col("host").alias("of"), F.col("class").alias("known")).agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") >= min_size)
    members = frequent.join(large, (F.col("host") == F.col("of")) & (F.col("class") == F.col("known")), "left_semi")
    fields = F.struct("class", "place", "role", "use", "sure")
    return members.groupBy("host").agg(F.sort_array(F.collect_list(fields)).alias("template"))


def extract(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    broadcast_tokens: int = 200_000,
    most_shared: float = 0.3,
    **settings,
) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points).  ``settings`` are those of ``deduce``."""
    spark = pages.sparkSession
    templates = materialise(deduce(pages, url_col=url_col, html_col=html_col, **settings), "templates")
    n = templates.agg(F.sum(F.size("template"))).first()[0] or 0
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def results(batch: pa.RecordBatch, template_of) -> pa.RecordBatch:
        urls, sources = batch.column("url").to_pylist(), batch.column("html").to_pylist()
        texts = [main_text(Page(s), template_of(i, u), most_shared) for i, (u, s) in enumerate(zip(urls, sources, strict=True))]
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )

    shape = f"page_id {kind}, url string, text string, n_chars bigint"
    if n <= broadcast_tokens:
        known = spark.sparkContext.broadcast({r["host"]: Template(r["template"]) for r in templates.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield results(batch, lambda _, url: known.value.get(host_key(url)))

        return rows.mapInArrow(run, shape)

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("template").to_pylist()
            yield results(batch, lambda i, _, held=held: Template(held[i] or ()))

    def add_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = pa.array([host_key(u) for u in batch.column("url").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, hosts], ["page_id", "url", "html", "of"])

    hosted = rows.mapInArrow(add_host, f"page_id {kind}, url string, html string, of bigint")
    joined = hosted.join(templates, F.col("of") == F.col("host"), "left")
    return joined.select("page_id", "url", "html", "template").mapInArrow(run_joined, shape)
