"""Main text of pages: markup case by case, differencing against a plain version over sorted pages."""

import random

import pytest
from pyspark.sql import functions as F

from touchline.llm import mainpage


def text(source):
    page = mainpage.Page(source)
    return [x for x, k in zip(page.lines, page.kinds) if k]


@pytest.mark.parametrize(
    "source,lines",
    [
        ("", []), ("plain text only", ["plain text only"]), ("<p>a<p>b<br>c</p> d ", ["a", "b c", "d"]),
        ("<p>x &amp;amp; y&nbsp;z &lt;b&gt; &#8364; &bogus; &copy</p>", ["x &amp; y z <b> € &bogus; ©"]),
        ("<div>one<b>two</b> <i>three</i><!-- no -->four</div>", ["onetwo threefour"]),
        ("<nav><p>m</nav><header>h</header><main><h1>T</h1><p>body</p></main><aside>s</aside><footer>f</footer>", ["T", "body"]),
        ("<article><header><h1>T</h1></header><p>b</p><footer>by</footer><aside>see</aside></article>after", ["T", "b"]),
        ("<div class='ad'>buy</div><div id=cookieNotice>ok?</div><div class=\"Ad-Slot x\">buy</div><p class=with-sidebar>stay", ["stay"]),
        ("<p class=adult>stay</p><p class=header-of-page>stay too</p><div class=site-header>go</div><div class='entry-header'>title</div>", ["stay", "stay too", "title"]),
        ("<article><p>t</p><section id=comments><article><p>me too</p></article></section><ul class=related-posts><li>r</ul></article>", ["t"]),
        ("<form><p>name</p><input value=x><select><option>o</select></form><p>t</p><button>go</button><label>l</label>", ["t"]),
        ("<script>if (a < b) x('<p>no</p>');</script><style>p{}</style><title>no</title><p>t</p><script>open <p>never", ["t"]),
        ("<p title='a > b' data-x=it's>t</p><a href=x>u</a", ["t", "u"][:1] + ["u"]),
        ("a < b and <3 </ no> c<!doctype html><?php x ?>d", ["a < b and <3 cd"]),
        ("<ul><li>1<li>2<ul><li>2a</ul><li>3</ul><table><tr><td>c1<td>c2<tr><th>h</table>", ["1", "2", "2a", "3", "c1", "c2", "h"]),
        ("<div class=menu><p>m</div><p>t</div></span></nobody>u", ["t", "u"]),
        ("<div class='layout sidebar-right'><main><p>t</p></main><p>x</p></div>", ["t"]),
        ("<article><p>a</p></article><p>outside</p><article>b</article>", ["a", "b"]),
        ("<article><p>unclosed <span class=advert>buy</span> rest", ["unclosed", "rest"]),
        ("<div role=navigation>n</div><div role=main>t</div>x", ["t"]),
        ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>end", ["deep", "end"]),
    ],
)
def test_markup(source, lines):
    assert text(source) == lines


def test_places():
    assert mainpage.place("HTTP://me@WWW.Site.org:81/a/b.html?x=1#y") == ("site.org", "/a/b")
    assert mainpage.place("//h/") == ("h", "") and mainpage.place("no url") == ("", "") and mainpage.place(None) == ("", "")


def test_alignment_is_longest():
    for seed in range(400):
        draw = random.Random(seed)
        a, b = ([draw.randint(0, 5) for _ in range(draw.randint(0, 25))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        for cells in (1 << 28, 9):
            pairs = mainpage.aligned(a, b, cells)
            assert len(pairs) == best[-1][-1] and all(a[i] == b[j] for i, j in pairs)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(mainpage.aligned(list(range(20000)) + [7] * 3000, [7] * 3000 + list(range(20000)), 1 << 22)) == 20000


def site(seed, n=150):
    """Pages without an article: a host's menu and notices, own paragraphs, now and then a copy or a shared paragraph."""
    draw, rows = random.Random(seed), []
    word = lambda: draw.choice(["alpha", "beta", "gamma", "delta", "omega", "zeta", "eta"])
    for i in range(n):
        host = draw.choice(["big.org", "big.org", "www.big.org", "b.com", "c.net", f"only{i}.org"])
        menu = [f"<div>{host.removeprefix('www.')} item {k}</div>" for k in range(draw.randint(3, 5))]
        own = [f"<p>{' '.join(word() for _ in range(draw.randint(3, 30)))}</p>" for _ in range(draw.randint(0, 4))]
        own += ["<p>a sentence that two pages quote</p>"] * draw.randint(0, 1)
        draw.shuffle(own)
        rows.append((i, f"https://{host}/{draw.choice('ab')}/{draw.randint(1, 40)}{draw.choice(['', '.html', '/', '?p=1'])}", "".join(menu[:2] + own + menu[2:] + ["<div>all rights</div>"])))
    rows += [(n + k, f"https://b.com/a/{k}", rows[3][2]) for k in range(5)] + [(None, None, "<p>lone"), (7, "nowhere", "<p>lone</p>"), (n, "https://b.com/a/0", None), (n, "https://b.com/a/0", rows[3][2])]
    return rows


def plain(rows):
    """The text of every row: the neighbours of each page among the sorted different contents of its host."""
    pages, hosts, out = [], {}, []
    for i, url, source in rows:
        page, (host, path) = mainpage.Page(source or ""), mainpage.place(url)
        pages.append((i, host, page))
        if host:
            one = hosts.setdefault(host, {}).setdefault((tuple(page.lines), tuple(page.kinds)), [path, page])
            one[0] = min(one[0], path)
    import hashlib

    import xxhash

    def sig(page):
        return hashlib.md5(repr(([xxhash.xxh64_intdigest(x) - (1 << 63) for x in page.lines], page.kinds)).encode()).hexdigest()

    for i, host, page in pages:
        gone = []
        if host and mainpage.OPEN in page.kinds:
            near = sorted((path, sig(p), p) for path, p in hosts[host].values())
            at = next(k for k, x in enumerate(near) if x[1] == sig(page))
            view = lambda x: {"path": x[0], "hashes": x[2].lines, "kinds": x[2].kinds, "sizes": [len(y) for y in x[2].lines]}
            gone = mainpage.shared_lines(view(near[at]), [view(near[k]) for k in (at - 1, at + 1, at - 2, at + 2) if 0 <= k < len(near)])
        out.append((str(i), "\n".join(x for k, (x, kind) in enumerate(zip(page.lines, page.kinds)) if kind and k not in gone)))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_differencing_over_ranges(spark, parts, monkeypatch):
    rows = site(parts)
    monkeypatch.setattr(mainpage, "parts_for", lambda s: parts)  # also ranges of one page, and empty ones
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lines", F.lit(1)).withColumn("text", F.lit("x"))
    got = mainpage.extracted(spark, df).collect()
    assert sorted((str(r.page_id), r.text) for r in got) == plain(rows)
    assert all(r.n_chars == len(r.text) for r in got)


def test_template_goes_and_articles_stay(spark):
    template = "<div>Home</div><div>{}</div><div>Imprint of the site</div>"
    rows = [(i, f"http://h.org/news/{i}", template.format(f"story {i} has words of its own, enough to be no copy")) for i in range(6)]
    rows += [(10, "http://g.org/a", "<article><p>the same law text</p>Share this</article>"), (11, "http://g.org/b", "<article><p>the same law text</p><p>and a story</p>Share this</article>")]
    rows += [(20, "http://m.org/x", "<div>mirror of a page</div>"), (21, "http://m.org/y", "<div>mirror of a page</div>")]
    got = {r.page_id: r.text for r in mainpage.extracted(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"story {i} has words of its own, enough to be no copy" for i in range(6))
    # shared paragraphs of an article stay, and so do copies
    assert got[11].startswith("the same law text\nand a story") and got[20] == got[21] == "mirror of a page"


def test_empty_table_and_long_page(spark):
    empty = spark.createDataFrame([], "page_id int, url string, html string")
    assert mainpage.extracted(spark, empty).count() == 0
    long = "<article>" + "".join(f"<p>paragraph {i} &amp; more</p>" for i in range(60000)) + "</article>"
    df = spark.createDataFrame([(1, "http://a.org/x", long), (2, "http://a.org/y", "<div>" + "word " * 300000 + "</div>")], "page_id int, url string, html string")
    got = {r.page_id: r for r in mainpage.extracted(spark, df).collect()}
    assert got[1].text == "\n".join(f"paragraph {i} & more" for i in range(60000)) and got[2].text == " ".join(["word"] * 300000)


def test_query_on_the_pages(spark, sf):
    """The given pages have one article each: its blocks in order, and nothing else."""
    import html
    import re

    for r in mainpage.op11_mainpage(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = r.html.partition("<article>")[2].partition("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("</?b>|<br>", "", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b)
