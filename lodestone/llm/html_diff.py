"""HTML extraction: page structure first, then nearest-URL page differencing.

A page's blocks are sorted by the markup into boilerplate (menus, footers, adverts, forms, comments, ..., and what lies
outside the declared region), article (inside an article element) and undecided (the rest of a main element, of a role
of main or of an element named as content, which often wrap menus as well; all of a page that declares no region).
All pages are then sorted by host and URL path, each is paired with the neighbour of the same host whose path shares
the longest prefix, their lines are aligned by longest common subsequence, and shared lines that are undecided are
deleted. Shared lines of an article element stay: a passage that two articles share is still text of both.

Copies are passed over to the nearest page with a different text. Pages of a host with the same lines count as one. A
neighbour that shares COPY percent of both pages' characters is used only if none of the REACH neighbours on either side
shares less, and the path differs in more than its query: then it is a long template, and the one that shares least is
taken. A neighbour is never used where nothing would be left of one of the two.

Outside an article, one word of an element's class or id marks it as boilerplate; inside, all words of the name must be
such words or neutral ones (comments, ad-box, but neither related-work nor social-history).

Defined results: null html is an empty page (text '', n_chars 0); a null url pairs with no page; repeated ids and
repeated pages are extracted row by row; broken or unclosed markup is closed as browsers do; a very long page takes time
in proportion to its length, whatever its markup; of two neighbours that are equally near the earlier one counts, and
equal paths are in order of a digest of their lines; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from os.path import commonprefix
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import ROWS, batch, map_rows, stored, table

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""", re.S)
#: The same without regard to quotes, for what follows a quote that never ends.
UNQUOTED = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""", re.S)
ATTR = re.compile(r"""(?<![a-zA-Z_:-])([a-zA-Z_:-]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
RAW = frozenset("script style noscript template textarea iframe xmp noembed noframes title".split())
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROP = frozenset("head nav footer aside form dialog menu select button svg math object audio video canvas datalist fieldset label".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody thead tfoot tr td th caption ul option legend".split()
)
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element of the first kind ends when one of the second starts (unless a boundary lies between).
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
IMPLIES = {new: ["p", *(old for old, by in IMPLIED.items() if new in by)] for new in BLOCK}
BOUNDARY = frozenset("ul ol dl table select div section article main body blockquote nav aside footer header form".split())
NOISE = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adslot adbox banner promo promotion promoted sponsor sponsored sponsors sidebar sidenav menu navmenu nav navbar navigation topnav
    breadcrumb breadcrumbs masthead footer header topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup signin login register
    comment comments commentlist disqus respond reply replies discussion related recommended recommendations share sharing social widget toolbar pagination pager copyright disclaimer skip tags taboola outbrain alert paywall""".split()
)
#: Words that may stand beside a boilerplate word in a name inside an article.
NEUTRAL = frozenset("area bar block body bottom box button buttons container content count div form group heading holder icons inline inner item items label left link links list module outer panel post posts right section slot stories text thread title top unit wrap wrapper".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MAIN_NAMES = frozenset("content article post entry story maincontent articlebody articlecontent postcontent entrycontent postbody".split())
WORDS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z0-9]+")
BOILER, UNDECIDED, ARTICLE = 0, 1, 2
#: Neighbours on each side that a page may be paired with; percent of both pages' characters that copies share; pages that one step compares.
REACH, COPY, STRETCH = 16, 90, 256


class _Open:
    __slots__ = ("tag", "skip", "main", "header")

    def __init__(self, tag: str, skip: bool, main: int, header: bool):
        self.tag, self.skip, self.main, self.header = tag, skip, main, header


def _attrs(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTR.finditer(raw):
        out.setdefault(m[1].lower(), m[2] if m[2] is not None else m[3] if m[3] is not None else m[4])
    return out


def _noisy(tag: str, raw: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is boilerplate by its own attributes (it may lie inside an article), and whether they name it as main content."""
    if not raw or raw.isspace():
        return False, False
    a, low = _attrs(raw), raw.lower()
    if a.get("role", "").lower() in NOISE_ROLES or a.get("aria-hidden", "").lower() == "true" or re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", re.sub(r"=\s*(\"[^\"]*\"|'[^']*'|\S+)", "=", low)) or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "").lower()):
        return True, False
    names = f"{a.get('class', '')} {a.get('id', '')}"
    main = a.get("role", "").lower() == "main" or any(re.sub("[-_]", "", n.lower()) in MAIN_NAMES for n in names.split())
    words = [[w.lower() for w in WORDS.findall(n)] for n in names.split()]
    noisy = any(any(w in NOISE for w in ws) and (not inside or all(w in NOISE or w in NEUTRAL for w in ws)) for ws in words)
    return noisy and not main and tag not in ("html", "body", "main"), main


#: What a block lies in, as bits of its region.
NAMED, MAIN, IN_ARTICLE = 1, 2, 4


class _Stack:
    """The open elements, with the places of each tag and of the elements that end a search."""

    def __init__(self) -> None:
        self.all: list[_Open] = []
        self.at: dict[str, list[int]] = {}
        self.boundaries: list[int] = []
        self.blocks: list[int] = []

    def last(self, tag: str) -> int:
        places = self.at.get(tag)
        return places[-1] if places else -1

    def push(self, o: _Open) -> None:
        i = len(self.all)
        self.all.append(o)
        self.at.setdefault(o.tag, []).append(i)
        if o.tag in BOUNDARY:
            self.boundaries.append(i)
        if o.tag in BLOCK:
            self.blocks.append(i)

    def pop(self) -> _Open:
        o, i = self.all.pop(), len(self.all)
        self.at[o.tag].pop()
        for places in (self.boundaries, self.blocks):
            if places and places[-1] == i:
                places.pop()
        return o


def blocks(page: str) -> list[tuple[str, int, int]]:
    """(text, kind, region) of each non-empty block in page order."""
    out: list[tuple[str, int, int]] = []
    stack = _Stack()
    text: list[str] = []
    outside = now = _Open("", False, 0, False)

    def flush() -> None:
        if text:
            s = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if s:
                out.append((s, BOILER if now.skip else UNDECIDED, now.main))

    def close(to: int) -> None:
        nonlocal now
        below = stack.all[to - 1] if to else outside
        if any(o.tag in BLOCK or o.skip != below.skip for o in stack.all[to:]):
            flush()
        while len(stack.all) > to:
            stack.pop()
        now = below

    at, end, token = 0, page.rfind(">"), TOKEN
    while at < len(page):
        m = token.search(page, at) if at <= end or page.find("<!--", at) >= 0 else None
        if not m:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        if token is TOKEN and m[5]:
            token = UNQUOTED
            ending, tag, raw = m[4], m[5], m[6]
        else:
            ending, tag, raw = m[1], m[2], m[3]
        if not tag:
            continue
        tag = tag.lower()
        if ending:
            i = stack.last(tag)
            if i >= 0 and not (tag in ("b", "i", "em", "strong", "a", "span", "font") and stack.blocks and stack.blocks[-1] > i):
                close(i)
            elif tag == "p":
                flush()
            continue
        if tag in RAW and not raw.rstrip().endswith("/"):
            e = RAW_END[tag].search(page, at) if at <= end else None
            at = e.end() if e else len(page)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "wbr"):
                text.append("\n" if tag == "br" else "")
            continue
        if tag in BLOCK:
            i = max(map(stack.last, IMPLIES[tag]))
            if i >= 0 and i >= (stack.boundaries[-1] if stack.boundaries else 0):
                close(i)
            flush()
        if tag == "body" and stack.last("head") >= 0:  # a head left open ends here
            close(stack.at["head"][0])
        if raw.rstrip().endswith("/") and tag not in BLOCK:
            continue
        noisy, named = _noisy(tag, raw, bool(now.main & IN_ARTICLE))
        skip = now.skip or noisy or tag in DROP
        header = now.header or tag == "header"
        if tag == "header" and not now.main:
            skip = True
        if now.header and now.main and not now.skip and tag in BLOCK and tag not in HEADS and tag not in ("hgroup", "div", "header"):
            skip = True  # what an article's own header holds besides headings
        if skip != now.skip:
            flush()
        region = now.main | (0 if skip else IN_ARTICLE if tag == "article" else MAIN if tag == "main" else NAMED if named else 0)
        stack.push(_Open(tag, skip, region, header))
        now = stack.all[-1]
    flush()
    return out


def decided(found: list[tuple[str, int, int]]) -> tuple[list[str], list[int]]:
    """Lines with their kinds. The declared region is the main element with all articles, or the articles alone, or what is named as content, or the whole page."""
    seen = 0
    for _, k, r in found:
        if k != BOILER:
            seen |= r
    region = MAIN | IN_ARTICLE if seen & MAIN else IN_ARTICLE if seen & IN_ARTICLE else NAMED if seen & NAMED else 0
    return [t for t, _, _ in found], [BOILER if k == BOILER or region and not r & region else ARTICLE if r & IN_ARTICLE else UNDECIDED for _, k, r in found]


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in a of one longest common subsequence of a and b (bit-parallel rows)."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    out = {*range(lo), *range(len(a) - hi, len(a))}
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not x or not y:
        return out
    full, where = (1 << len(y)) - 1, {}
    for j, s in enumerate(y):
        where[s] = where.get(s, 0) | 1 << j
    v, rows = full, [full]
    for s in x:
        u = v & where.get(s, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    i, j = len(x), len(y)
    length = lambda i, j: j - (rows[i] & ((1 << j) - 1)).bit_count()
    while i and j:
        if x[i - 1] == y[j - 1]:
            out.add(lo + i - 1)
            i, j = i - 1, j - 1
        elif length(i - 1, j) >= length(i, j - 1):
            i -= 1
        else:
            j -= 1
    return out


def near(page: dict, other: dict) -> int:
    """Length of the common path prefix of two pages, -1 for different hosts."""
    return -1 if page["host"] != other["host"] else len(commonprefix([page["path"], other["path"]]))


def nearest(pages: list[dict], i: int) -> Iterator[dict]:
    """The up to 2 * REACH neighbours of pages[i] in a list ordered by host and path, nearest path first."""
    a, b = i - 1, i + 1
    while True:
        left = near(pages[i], pages[a]) if a >= max(0, i - REACH) else -1
        right = near(pages[i], pages[b]) if b < min(len(pages), i + REACH + 1) else -1
        if left < 0 and right < 0:
            return
        if left >= right:
            yield pages[a]
            a -= 1
        else:
            yield pages[b]
            b += 1


def deleted(page: dict, others: Iterator[dict]) -> list[int]:
    """Places of the page's lines that it shares with the nearest other page that is no copy of it."""
    best, least, own = set(), 0, sum(page["sizes"])
    for o in others:
        shared = common_lines(page["marks"], o["marks"])
        if len(shared) in (len(page["marks"]), len(o["marks"])):
            continue  # nothing would be left of one of them
        size = sum(page["sizes"][i] for i in shared)
        if 100 * size < COPY * max(own, sum(o["sizes"])):
            return sorted(shared)
        if page["path"].split("?")[0] != o["path"].split("?")[0] and (not best or size < least):
            best, least = shared, size
    return sorted(best)


def split_url(url: str | None) -> tuple[str | None, str]:
    """(host, path with query) of a URL; a host of None pairs with nothing."""
    try:
        u = urlsplit(url or "")
        return u.hostname, u.path + ("?" + u.query if u.query else "")
    except ValueError:
        return None, ""


_PARSED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("lines", pa.list_(pa.string())), ("host", pa.string()), ("path", pa.string()), ("marks", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("print", pa.binary()), ("open", pa.list_(pa.int32()))])
PARSED = "page_id long, url string, lines array<string>, host string, path string, marks array<long>, sizes array<int>, print binary, open array<int>"
_GONE = pa.schema([("host", pa.string()), ("print", pa.binary()), ("gone", pa.list_(pa.int32()))])
GONE = "host string, print binary, gone array<int>"


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The lines of every page that its markup leaves; of a page with a host also host, path, hashes and lengths of its lines, a digest of them all, and the places of undecided lines."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for i, u, h in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            left = [(t, k) for t, k in zip(*decided(blocks(h or "")), strict=True) if k != BOILER]
            lines = [t for t, _ in left]
            host, path = split_url(u)
            if not lines or host is None:
                rows.append((i, u, lines, *[None] * 6))
            else:
                marks = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest() for t in lines]
                undecided = [n for n, (_, k) in enumerate(left) if k == UNDECIDED]
                rows.append((i, u, lines, host, path, [int.from_bytes(m, "little", signed=True) for m in marks], [len(t) for t in lines], hashlib.blake2b(b"".join(marks), digest_size=16).digest(), undecided))
        return batch(_PARSED, *(list(zip(*rows, strict=True)) or [[]] * 9))

    return map_rows(pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")), run, PARSED)


def _deletions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deletions of the pages of every stretch, of pages that come in order of stretch and place; one stretch is held at a time."""

    def done(held: list[dict]) -> Iterator[pa.RecordBatch]:
        rows = [(p["host"], p["print"], deleted(p, nearest(held, i))) for i, p in enumerate(held) if p["mine"]]
        rows = [r for r in rows if r[2]]
        if rows:
            yield batch(_GONE, *zip(*rows, strict=True))

    now, held = None, []
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            for p in b.slice(i, ROWS).to_pylist():
                if p["stretch"] != now:
                    yield from done(held)
                    now, held = p["stretch"], []
                held.append(p)
    yield from done(held)


def _placed(pages: DataFrame) -> DataFrame:
    """pages with their place (at) in order of host and path, counted over all partitions."""
    found = stored(pages.repartitionByRange("host", "path", "print").sortWithinPartitions("host", "path", "print").withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33)
    before, starts = 0, []
    for p, n in sorted(map(tuple, found.groupBy(part.alias("p")).count().collect())):  # one row a partition
        starts.append((p, before))
        before += n
    start = found.sparkSession.createDataFrame(starts, "_p long, _start long")
    return found.join(F.broadcast(start), part == start["_p"]).withColumn("at", F.expr("(_at & 8589934591) + _start")).drop("_at", "_p", "_start")


def deletions(found: DataFrame) -> DataFrame:
    """(host, print, gone): places of the lines to delete, for each different text of a host (copies count as one page)."""
    texts = found.where("print is not null").groupBy("host", "print").agg(F.min("path").alias("path"), F.first("marks").alias("marks"), F.first("sizes").alias("sizes"))
    # a page also goes to the stretches that have it within reach
    dealt = _placed(texts).withColumn("stretch", F.explode(F.expr(f"sequence((at - {REACH}) div {STRETCH}, (at + {REACH}) div {STRETCH})")))
    dealt = dealt.withColumn("mine", F.expr(f"at div {STRETCH} = stretch"))
    return dealt.repartition("stretch").sortWithinPartitions("stretch", "at").mapInArrow(_deletions, GONE)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    found = stored(parsed(pages, id_col, url_col, html_col), "parsed")
    out = [F.concat_ws("\n", "lines").alias("text"), F.char_length(F.concat_ws("\n", "lines")).cast("long").alias("n_chars")]
    # a page without undecided lines is a neighbour to others, but nothing of it can go: its lines move nowhere
    undecided = "print is not null and size(open) > 0"
    rest = found.where(undecided).select("page_id", "url", "lines", "host", "print", "open").join(deletions(found).hint("merge"), ["host", "print"], "left")
    rest = rest.select("page_id", "url", F.expr("if(gone is null, lines, filter(lines, (x, i) -> not (array_contains(gone, i) and array_contains(open, i))))").alias("lines"))
    return found.where(f"not ({undecided})").select("page_id", "url", *out).unionByName(rest.select("page_id", "url", *out))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
