"""Main text of web pages: markup, then the difference to the page with the nearest URL.

A page is cut into lines, one for each block of text. Markup settles what it names: menus, page
headers, footers, sidebars, notices, adverts, forms and comments go by their element, role,
class or id, and if the page has an ``article`` or ``main``, so does what stands outside of it.
Paragraphs, headings, list items, cells and the like inside an article are its text and
stay. The other lines are open: all unmarked ones of a page without an article, and text that
stands in an article outside of such elements.

Open lines are settled by page differencing. Pages of a host are put in order of their URL
path; a page's partner is the nearest of the two before and the two behind it (longest common
path, then the one before) whose content differs. The lines of both are aligned by a longest
common subsequence, and open lines that they share are template and go. A partner that
would leave less than a tenth of the open text of either page is a copy and not a page of
the same template: the next nearest one is asked, and without any the open lines stay.

Differencing alone gives wrong text where pages of a host share paragraphs, or have menus and
adverts of their own; so it decides only what markup leaves open.

Plan: pages are parsed once into a table of lines (Arrow); per host and content one slim row of
line hashes is dealt out by ranges of (host, path), so a host of any size is many tasks, and rows
at the ends of a range meet those of the next. Texts are joined with deleted lines only
for pages that have open ones.

Edge cases: null or empty pages give an empty text; a null URL, or one without a host, has no
partner; broken and unclosed markup ends with its parent, an unclosed script, style or
comment with the page; character references are decoded once; line breaks are white space;
repeated rows are rows of their own with equal texts; an empty table gives an empty result;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, lean, parts_for, stored

GONE, OPEN, TEXT = 0, 1, 2
#: A tag, comment or declaration; quotes count behind an equals sign only.
TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</[^a-zA-Z>][^>]*>?|</>
    |<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*(?:"[^"]*"|'[^']*')?|["'])*)>?""", re.S | re.X)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Text of these elements in an article is the author's.
OWN = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption summary address".split())
BOILERPLATE = frozenset("head nav footer aside form menu dialog button select input label option optgroup fieldset audio video canvas".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of class names and ids.
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox sponsor sponsored sponsors promo promotion promotions banner banners "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts popup popups modal overlay newsletter subscribe subscription signup login signin "
    "sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar masthead footer footers copyright "
    "comment comments disqus respond reply replies discussion related recommended recommendations share sharing social skip search".split()
)
NAMED_HEADER, OF_ARTICLE = frozenset(("header", "headers", "topbar")), frozenset("article post entry story content section page title".split())
NEGATED = frozenset("with has no is without not non".split())
#: Start tags of the first close an open one of the second, up to an element of the third.
CLOSES = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))), "dd": (frozenset(("dd", "dt")), frozenset(("dl",))), "dt": (frozenset(("dd", "dt")), frozenset(("dl",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))), "th": (frozenset(("td", "th")), frozenset(("tr", "table"))), "tr": (frozenset(("tr",)), frozenset(("table",))),
    "option": (frozenset(("option",)), frozenset(("select",))),
}
P, P_SCOPE = frozenset(("p",)), frozenset(("td", "th", "caption", "table", "button", "html"))
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def named(value: str) -> bool:
    """Does a class or id name something other than the article?"""
    for token in value.split():
        words = [w.lower() for w in WORDS.findall(token)]
        if not words or words[0] in NEGATED:
            continue
        if NAMED.intersection(words) or (NAMED_HEADER.intersection(words) and not OF_ARTICLE.intersection(words)):
            return True
    return False


class Page:
    """Lines of a page with what markup says of them."""

    def __init__(self, source: str):
        self.lines: list[str] = []
        self.kinds: list[int] = []
        self.inside: list[bool] = []  # an article or main
        self.stack: list[tuple[str, bool, bool, bool]] = []  # element, goes, in an article, in an element of text
        self.parts: list[str] = []
        self.read(source)
        if any(i and k != GONE for i, k in zip(self.inside, self.kinds)):
            self.kinds = [k if i else GONE for i, k in zip(self.inside, self.kinds)]

    def read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            m = TOKEN.search(source, at)
            if not m:
                break
            if m.start() > at:
                self.parts.append(source[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self.end(tag)
            elif tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
                at = close.end() if close else size
            else:
                self.start(tag, m[3])
        self.parts.append(source[at:])
        self.flush()

    def flush(self) -> None:
        """Ends a line."""
        if self.parts:
            line = " ".join(html.unescape("".join(self.parts)).split())
            self.parts.clear()
            if line:
                _, goes, inside, own = self.stack[-1] if self.stack else ("", False, False, False)
                self.lines.append(line)
                self.kinds.append(GONE if goes else TEXT if inside and own else OPEN)
                self.inside.append(inside)

    def close(self, tags: frozenset, scope: frozenset) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in tags:
                self.flush()
                del self.stack[i:]
                return
            if self.stack[i][0] in scope:
                return

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        if tag in BLOCK:
            self.flush()
            self.close(P, P_SCOPE)
        if tag in CLOSES:
            self.close(*CLOSES[tag])
        _, goes, inside, own = self.stack[-1] if self.stack else ("", False, False, False)
        marked = tag in BOILERPLATE or (tag == "header" and not inside)
        article = tag in ("article", "main")
        if attributes and tag not in ("html", "body"):
            for name, *values in ATTRIBUTE.findall(attributes):
                value = html.unescape("".join(values))
                if name.lower() == "role":
                    marked = marked or value.strip().lower() in ROLES
                    article = article or value.strip().lower() in ("main", "article")
                elif name.lower() == "itemprop":
                    article = article or value.strip() == "articleBody"
                elif tag != "main":
                    marked = marked or named(value)
        if tag not in BLOCK and marked and not goes:
            self.flush()  # a marked element inside a line is a line of its own
        if tag == "main" and goes and not any(t[0] in BOILERPLATE or t[0] == "header" for t in self.stack):
            goes = False  # a wrapper that is named by its layout
        self.stack.append((tag, goes or marked, inside or (article and not goes and not marked), tag in OWN or (own and tag not in ("div", "section", "article", "main"))))

    def end(self, tag: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if tag in BLOCK or (self.stack[i][1] and not (i and self.stack[i - 1][1])) or any(t[0] in BLOCK for t in self.stack[i:]):
                    self.flush()
                del self.stack[i:]
                return
            if self.stack[i][0] in ("td", "th", "table") and tag in ("p", "div", "span", "a", "b", "i"):
                break
        if tag in BLOCK:
            self.flush()


def place(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL: without scheme, user, port, ``www.``, query, fragment, closing slash and file ending."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)[^/?#]*([^?#]*)", (url or "").strip(), re.I)
    if not m:
        return "", ""
    return m[1].lower().removeprefix("www."), re.sub(r"\.[a-z]{1,5}$", "", m[2].rstrip("/"), flags=re.I)


def aligned(a: list, b: list, cells: int = 1 << 28) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence of two lists; memory of about ``cells`` bits, by halving the first list beyond that."""
    import numpy as np

    out, front, back = [], 0, 0
    while front < min(len(a), len(b)) and a[front] == b[front]:
        out.append((front, front))
        front += 1
    while back < min(len(a), len(b)) - front and a[-1 - back] == b[-1 - back]:
        out.append((len(a) - 1 - back, len(b) - 1 - back))
        back += 1
    both = set(a[front : len(a) - back]) & set(b[front : len(b) - back])
    i = [x for x in range(front, len(a) - back) if a[x] in both]
    j = [x for x in range(front, len(b) - back) if b[x] in both]

    def rows(x: list, y: list) -> Iterator[int]:
        """For each element of x: bits of y where the length of the common subsequence doesn't grow."""
        seen: dict = {}
        for k, e in enumerate(y):
            seen[e] = seen.get(e, 0) | 1 << k
        whole = (1 << len(y)) - 1
        v = whole
        for e in x:
            m = v & seen.get(e, 0)
            v = (v + m | v - m) & whole
            yield v

    def lengths(x: list, y: list):
        v = 0
        for v in rows(x, y):
            pass
        flat = np.unpackbits(np.frombuffer(v.to_bytes(len(y) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(y)]
        return np.append(0, np.cumsum(flat == 0))

    work = [(i, j)]
    while work:
        i, j = work.pop()
        if not i or not j:
            continue
        if len(i) > 1 and len(i) * len(j) > cells:
            half = len(i) // 2
            up = lengths([a[x] for x in i[:half]], [b[x] for x in j])
            down = lengths([a[x] for x in i[half:][::-1]], [b[x] for x in j[::-1]])[::-1]
            cut = int(np.argmax(up + down))
            work += [(i[:half], j[:cut]), (i[half:], j[cut:])]
            continue
        v = list(rows([a[x] for x in i], [b[x] for x in j]))
        r, c = len(i), len(j)
        while r and c:
            if v[r - 1] >> c - 1 & 1:
                c -= 1
                continue
            r -= 1
            if not r or v[r - 1] >> c - 1 & 1:
                c -= 1
                out.append((i[r], j[c]))
    return sorted(out)


PARSED = "page_id {id}, url string, host string, path string, sig string, lines array<string>, kinds array<int>, sizes array<int>, hashes array<long>"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    import xxhash

    ints = pa.list_(pa.int32())
    names = ["page_id", "url", "host", "path", "sig", "lines", "kinds", "sizes", "hashes"]
    for b in batches:
        cols: list[list] = [[] for _ in names[2:]]
        for url, source in zip(b.column(1).to_pylist(), b.column(2)):
            page = Page(source.as_py() or "")
            hashes = [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x in page.lines]
            sig = hashlib.md5(repr((hashes, page.kinds)).encode()).hexdigest()
            lines = [x if k else "" for x, k in zip(page.lines, page.kinds)]
            for c, x in zip(cols, (*place(url), sig, lines, page.kinds, [len(x) for x in page.lines], hashes)):
                c.append(x)
        kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), ints, ints, pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names)


def near(a: str, b: str) -> tuple[int, int]:
    """Common segments and common characters of two paths."""
    x, y = a.split("/"), b.split("/")
    segments = next((i for i, (s, t) in enumerate(zip(x, y)) if s != t), min(len(x), len(y)))
    return segments, next((i for i, (s, t) in enumerate(zip(a, b)) if s != t), min(len(a), len(b)))


def shared_lines(own: dict, partners: list[dict]) -> list[int]:
    """Open lines of ``own`` (path, hashes, kinds, sizes) that the nearest partner that is no copy has, too. Partners come with those before first."""
    for other in sorted(partners, key=lambda p: near(own["path"], p["path"]), reverse=True):  # stable: of equally near ones the first
        pairs = aligned(own["hashes"], other["hashes"])
        copy = False
        for page, mine in ((own, {i for i, _ in pairs}), (other, {j for _, j in pairs})):
            text = sum(n for n, k in zip(page["sizes"], page["kinds"]) if k != GONE)
            rest = sum(n for i, (n, k) in enumerate(zip(page["sizes"], page["kinds"])) if k != GONE and i not in mine)
            copy |= rest * 10 < text
        if not copy:
            return sorted(i for i, _ in pairs if own["kinds"][i] == OPEN)
    return []


def _differenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = b.to_pylist()
        gone = [shared_lines(r, [p for p in r["partners"] if p and p["host"] == r["host"]]) for r in rows]
        yield pa.RecordBatch.from_arrays([b.column("host"), b.column("sig"), pa.array(gone, pa.list_(pa.int32()))], ["host", "sig", "gone"])


def neighbours(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """``pages`` (host, path, sig, hashes, kinds, sizes; each once) with ``partners``: one and two before, one and two behind, in order of host, path and sig."""
    order = ["host", "path", "sig"]
    ranged = stored(spark, pages.repartitionByRange(parts_for(spark), *order).withColumn("r", F.spark_partition_id()), "pages")
    page = F.struct(*order, "hashes", "kinds", "sizes")
    steps = ((F.lag, 1), (F.lead, 1), (F.lag, 2), (F.lead, 2))

    def beside(rows: DataFrame, at) -> DataFrame:
        return rows.withColumns({f"p{i}": move(page, n).over(at) for i, (move, n) in enumerate(steps)})

    at = Window.partitionBy("r").orderBy(*order)
    numbered = ranged.withColumn("i", F.row_number().over(at)).withColumn("behind", F.count("*").over(Window.partitionBy("r")) - F.col("i"))
    inner = beside(numbered, at)
    # four rows a range: what lies beyond its ends
    ends = beside(numbered.where("i <= 2 OR behind < 2"), Window.orderBy("r", "i"))
    ends = ends.select(F.col("r").alias("__r"), F.col("i").alias("__i"), *[F.col(f"p{i}").alias(f"q{i}") for i in range(len(steps))])
    joined = inner.join(ends, F.expr("r = __r AND i = __i"), "left")
    partners = F.array(*[F.coalesce(f"p{i}", f"q{i}") for i in range(len(steps))])
    return joined.select(*order, "hashes", "kinds", "sizes", partners.alias("partners"))


def extracted(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    bounded_batches(spark)
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = slim.schema["page_id"].dataType.simpleString()
    parsed = stored(spark, slim.mapInArrow(lean(_parsed), PARSED.format(id=kind)), "pages")
    undecided = F.array_contains("kinds", OPEN)
    none = F.expr("CAST(array() AS array<int>)")
    settled = parsed.where(~undecided).withColumn("gone", none)
    open_pages = parsed.where(undecided)
    if not open_pages.isEmpty():
        each = parsed.where("host <> ''").groupBy("host", "sig").agg(F.min("path").alias("path"), *[F.first(c).alias(c) for c in ("hashes", "kinds", "sizes")])
        found = neighbours(spark, each).where(undecided).mapInArrow(lean(_differenced), "host string, sig string, gone array<int>")
        found = found.where("size(gone) > 0").select(F.col("host").alias("__host"), F.col("sig").alias("__sig"), "gone")
        joined = open_pages.join(found, F.expr("host = __host AND sig = __sig"), "left").withColumn("gone", F.coalesce("gone", none))
        settled = settled.unionByName(joined.select(settled.columns))
    text = F.expr(f"array_join(filter(lines, (x, i) -> kinds[i] = {TEXT} OR (kinds[i] = {OPEN} AND NOT array_contains(gone, i))), '\\n')")
    return settled.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op11_mainpage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
