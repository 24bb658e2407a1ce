import math
import random
import re
from collections import defaultdict
from html import unescape

import pytest
from pyspark.sql import types as T

from loanmart.llm import html_text
from loanmart.llm.html_text import branches, importance, main_texts, rendered
from loanmart.llm.page_dom import parse

KIND = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
    T.StructField("host", T.StringType()), T.StructField("text", T.StringType()), T.StructField("node", T.StringType()),
])


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], KIND)


def text_of(html):
    return rendered(parse(html, {}), set())


def plain(rows):
    """Texts by a tree of the site in dictionaries."""
    sites = defaultdict(dict)
    for _, url, html in rows:
        host = re.match(r"[^/?#]*", url.partition("://")[2]).group().lower() if url else ""
        sites[host][html or ""] = parse(html or "", {})
    low = {}
    for host, pages in sites.items():
        styles, texts, paths, n = defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set)), {}, defaultdict(set)
        for key, page in pages.items():
            for node, (_, style, path, own) in branches(page).items():
                styles[node][style].add(key)
                n[node].add(key)
                paths[node] = path
                for t in own:
                    texts[node][t].add(key)
        low[host] = set()
        for node in paths:
            m, under = len(n[node]), [len(k) for leaf, path in paths.items() if node in path for k in texts[leaf].values()]
            if m < html_text.LEAST_PAGES or not under:
                continue
            shares = [len(s) / m for s in styles[node].values()]
            presentation = -sum(p * math.log(p) for p in shares) / math.log(m)
            content = 1 - sum(math.log(k) / math.log(m) for k in under) / len(under)
            weight = html_text.ATTENUATION ** len(shares)
            if (1 - weight) * presentation + weight * content < html_text.LEAST_IMPORTANCE:
                low[host].add(node)
    out = []
    for i, url, html in rows:
        host = re.match(r"[^/?#]*", url.partition("://")[2]).group().lower() if url else ""
        out.append((i, url, rendered(parse(html or "", {}), low[host])))
    return out


def found(df):
    got = [(r["page_id"], r["url"], r["text"]) for r in df.collect()]
    return sorted(got, key=str)


def site(host, n, seed, copies=0):
    """Pages without any telling names: only what repeats over them shows what is a template."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    rows, wanted = [], []
    for i in range(n):
        text = [say(rng.randint(5, 30)) for _ in range(rng.randint(1, 6))]
        box = rng.choice(["Get our letter every week", "All shoes at half price"])
        html = f"<html><body><div class='k1'><div>Home</div><div>About us</div></div><div class='k2'>{''.join(f'<p>{t}</p>' for t in text)}</div><div class='k3'><p>{box}</p></div><div class='k4'>All rights reserved</div></body></html>"
        for _ in range(1 + (copies if i == 0 else 0)):
            rows.append((len(rows), f"http://{host}/{len(rows)}", html))
            wanted.append("\n\n".join(text))
    return rows, wanted


def test_templates_go_by_what_repeats(spark):
    rows, wanted = site("a.example", 40, 1)
    got = found(main_texts(frame(spark, rows)))
    assert [t for *_, t in sorted(got)] == wanted
    # alone, a page shows nothing of its template
    assert [t for *_, t in found(main_texts(frame(spark, rows[:1])))][0].startswith("Home")


@pytest.mark.parametrize("copies", [0, 60])
def test_equals_a_plain_tree(spark, copies):
    rows, wanted = site("a.example", 25, 2, copies)
    rows += [(1000 + i, u.replace("a.ex", "B.ex"), h) for i, u, h in site("a.example", 7, 3)[0]]
    rows += [(2000, None, "<p>no url</p>"), (2001, "no scheme", rows[3][2]), (2002, "http://a.example/", None), (None, "http://a.example/", ""),
             (3, "http://a.example/3", rows[3][2]), (2003, "http://c.example", "<article><p>x</p><div class=q>y</div></article>")]
    got = found(main_texts(frame(spark, rows).repartition(6)))
    assert got == sorted(plain(rows), key=str)
    by = {i: t for i, _, t in got if i is not None}
    assert [by[i] for i in range(len(wanted))] == wanted


def test_repeated_boxes_inside_a_marked_article(spark):
    rng = random.Random(3)
    rows = []
    for i in range(12):
        own = " ".join(rng.choice("abcdefgh") * 3 for _ in range(12))
        rows.append((i, f"http://s.example/{i}", f"<body><p>outside</p><article><h1>Title {i}</h1><p>{own}</p><div class='q7'>Read our letter</div><p>Shared passage of all pages</p></article>"))
    got = [t for *_, t in found(main_texts(frame(spark, rows)))]
    assert all("letter" not in t and "outside" not in t and t.startswith("Title") and t.endswith("Shared passage of all pages") for t in got)


def test_importance_of_equal_and_different_texts(spark):
    rows, _ = site("a.example", 30, 5)
    keyed = html_text._keyed(frame(spark, rows), "page_id", "url", "html").select("host", "page", "html")
    table = importance(keyed.mapInArrow(html_text._trees, html_text._BRANCHES))
    by = {r["node"]: r["importance"] for r in table.collect()}
    page = parse(rows[0][2], {})
    of = {c: by[page.node[i]] for i, c in enumerate(page.tag) for c in [page.tag[i] + str(i)] if page.node[i] in by}
    low, high = [v for v in of.values() if v < 0.4], [v for v in of.values() if v >= 0.4]
    assert low and high and min(of.values()) < 0.05 and max(of.values()) > 0.85


@pytest.mark.parametrize("html,text", [
    ("<p>a<p>b<br>c</p>d", "a\n\nb c\n\nd"),
    ("<p><b>one<br><p>two</p>", "one\n\ntwo"),
    ("<div>x &amp; y&nbsp;&lt;z&#33; \n\t q</div>", "x & y <z! q"),
    ("a < b and c<d", "a < b and c"),
    ("<script>var t='</p>';</script><style>p{}</style><p>t</p><!-- <p>c</p> -->", "t"),
    ("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>", "a\n\nb\n\n1 2\n\n3"),
    ("<nav>n</nav><header>h</header><p>t</p><aside>s</aside><footer>f</footer><form>q</form>", "t"),
    ("<div class='cookie-notice'>n</div><div id=comments><article class=comment>c</article></div><div class='post-body'>t</div>", "t"),
    ("<article><header><h1>T</h1></header><p>t <span class=ad>buy</span> u</p><footer>by x</footer></article>", "T\n\nt\n\nu"),
    ("<body class='has-sidebar'><form id=all><article><p>t</p></article></form><div class=sidebar>s</div>", "t"),
    ("<main><p>long text of the page</p><article class=teaser><p>x</p></article></main>", "x"),
    ("<p>cut off <a href='x", "cut off"),
    ("<p>cut <!-- off", "cut"),
    ("<p>in<b>li</b>ne</p>", "inline"),
    ("", ""), ("   ", ""), ("<p></p>", ""), ("<head><title>t</title></head>", ""), ("<title>t</title><p>x", "x"),
    ("<p title='a>b'>x</p><p title=\"y>x</p>", "x\n\nx"),
])
def test_blocks(html, text):
    assert text_of(html) == text


def test_odd_pages(spark):
    deep = "<div>" * 30_000 + "bottom" + "</div>" * 30_000
    long = "<article>" + "<p>many words here</p>" * 50_000 + "</article>"
    open_tags = "<a <b " * 20_000
    rows = [(1, "http://x/", deep), (2, "http://x/", long), (3, "http://x/", open_tags), (4, "http://x/", "\x00<p>&#0;&bogus;</p>")]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in main_texts(frame(spark, rows)).collect()}
    assert got[1][0] == "bottom" and got[2][1] == 50_000 * 15 + 49_999 * 2 and got[4][1] == len(got[4][0])
    assert main_texts(frame(spark, [])).count() == 0


def test_articles_of_the_pages_table(spark, data):
    """The pages of the tables mark their article: its blocks, by a plain split at tags, are the text."""
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r["page_id"]: r for r in main_texts(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S).group(1)
        blocks = [" ".join(unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?p>|</?h1>", inner)]
        want = "\n\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)
