import random
import re

import pytest

from cellspan.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>hidden</p> --><div class="ad banner">Buy</div>
<div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p>One <b>bold</b><br>two&nbsp;three.<p>Second &lt;p&gt;
paragraph<ul><li>a<li>b</ul><table><tr><td>x</td><td>y</td></tr></table>
<form><p>Your mail</p></form><div class="comments"><p>First!</p></div><aside>See also</aside><p>Last é&#8364;</p></article>
<footer>&copy; me</footer></body></html>"""


def test_article_blocks():
    text = html_text.main_text(html_text.blocks(PAGE), None)
    assert text.split("\n\n") == ["Title & more", "One bold two three.", "Second <p> paragraph", "a", "b", "x y", "Last é€"]


def test_differencing_decides_without_an_article():
    def page(body):
        return f"<body><div>Menu of the site</div>{body}<div>All rights reserved</div></body>"

    a = html_text.blocks(page("<p>own text</p><p>shared line</p><p>more</p>"))
    b = html_text.blocks(page("<p>other text</p><p>shared line</p>"))
    assert html_text.main_text(a, b) == "own text\n\nmore"
    assert html_text.main_text(a, None).startswith("Menu of the site")


@pytest.mark.parametrize("html, want", [("", ""), ("plain", "plain"), ("<p", ""), ("a<b", "a"), ("<p>a</p><script>x", "a"), ("<article>x", "x"), ("<p>1 < 2</p>", "1 < 2")])
def test_broken_markup(html, want):
    assert html_text.main_text(html_text.blocks(html), None) == want


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_lines_is_a_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(1500):
        a = [rng.choice("abcde") for _ in range(rng.randint(0, 9))]
        b = [rng.choice("abcdf") for _ in range(rng.randint(0, 9))]
        found = [a[i] for i in sorted(html_text.common_lines(a, b))]
        rest = iter(b)
        assert len(found) == longest(a, b) and all(x in rest for x in found)


def test_pages_match_a_plain_parse(spark, sf_dir):
    import html

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = {r.page_id: r for r in pages.collect()}
    found = html_text.extract(pages).collect()
    assert sorted(r.page_id for r in found) == sorted(rows)
    for r in found:
        article = re.search(r"<article>(.*?)</article>", rows[r.page_id].html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:h1|p)>", article)]
        assert r.text == "\n\n".join(x for x in parts if x) and r.n_chars == len(r.text) and r.url == rows[r.page_id].url


def test_pairs_do_not_depend_on_the_ranges(spark):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        host = rng.choice(["a.example", "a.example", "b.example", f"c{i}.example"])
        body = "".join(f"<p>{w} {host}</p>" if rng.random() < 0.5 else f"<p>own {i} {w}</p>" for w in ("menu", "about", "terms"))
        rows.append((i, f"http://{host}/x/{rng.randint(0, 40)}", body))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = None
    for n in (1, 3, 16):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = sorted((r.page_id, r.text) for r in html_text.extract(df.repartition(n)).collect())
        want = want or got
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    keys = sorted((*u, i) for i, u in ((r[0], (re.sub("http://", "", r[1]).split("/")[0], "/" + r[1].split("/", 3)[3])) for r in rows))
    by = {r[0]: r[2] for r in rows}
    for k, (host, path, i) in enumerate(keys):
        near = [keys[j] for j in (k - 1, k + 1) if 0 <= j < len(keys) and keys[j][0] == host]
        best = max(near, key=lambda x: len(re.match("(.*).*\0\\1", f"{path}\0{x[1]}", re.S)[1]) if False else _prefix(path, x[1]), default=None)
        text = html_text.main_text(html_text.blocks(by[i]), html_text.blocks(by[best[2]]) if best else None)
        assert dict(want)[i] == text


def _prefix(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def test_edges(spark):
    rows = [(1, None, None, 1), (None, "http://a/b", "<p>x</p>", 1), (2, "http://a/b", "", 1), (2, "http://a/b", "", 1), (3, "", "<p>y</p>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = html_text.extract(df).collect()
    assert len(found) == 5 and sorted(r.text for r in found) == ["", "", "", "x", "y"]
    assert html_text.extract(df.limit(0)).count() == 0


def test_an_article_that_is_a_teaser_does_not_replace_the_body():
    def page(body):
        return html_text.blocks(f"<body><div>Menu of the site</div>{body}<article><p>Read this too</p></article></body>")

    a, b = page("<div><p>The long body of page one</p><p>in plain elements</p></div>"), page("<div><p>Another body</p></div>")
    assert html_text.main_text(a, b) == "The long body of page one\n\nin plain elements"


def test_copies_without_an_article_keep_their_text(spark):
    page = "<body><nav>Home</nav><div><p>The body of a page</p><p>that was fetched twice</p></div></body>"
    df = spark.createDataFrame([(1, "http://a/x", page), (2, "http://a/x", page)], "page_id long, url string, html string")
    assert [r.text for r in html_text.extract(df).collect()] == ["The body of a page\n\nthat was fetched twice"] * 2


@pytest.mark.parametrize(
    "html, want",
    [
        ('<article><p>a</p><svg width="1"/><p>b</p></article>', "a|b"),
        ("<article><p>a</p><video-player></video-player><p>b</p></article>", "a|b"),
        ("<p>a</p><select-box>x</select-box><p>b", "a|x|b"),
        ("<article><p>a</p><object data=x><p>b</p></article>", "a|b"),
        ("<p>x <object>fallback</object> y</p>", "x y"),
        ("<p class=it's>hello</p>", "hello"),
        ('<a href="x>link</a> b', "link b"),
        ('<article><div class="related-work"><p>r</p></div><p>E = <math><mi>m</mi></math> c</p></article>', "r|E = m c"),
        ("<article><header><h1>T</h1></header><p>a</p></article><header>H</header>", "T|a"),
        ("<p>one <svg><text>t</text></svg> two <button>Go</button> three</p>", "one two three"),
        ("<div class=comment-list>n</div><div class=comment-on-war>k</div>", "k"),
        ("<script>x</script ><p>a<!--><p>b<!-- c --!><p>d", "a|b|d"),
        ("<p>a</p><title>t</title><iframe src=x></iframe>b<textarea><p>x</textarea>c", "a|b c"),
    ],
)
def test_no_text_is_lost_and_no_markup_leaks(html, want):
    assert html_text.main_text(html_text.blocks(html), None) == want.replace("|", "\n\n")


def test_broken_markup_takes_time_in_proportion():
    import time

    began = time.perf_counter()
    for x in ("<a ", '<a b="', "<a b='x>", "<!--", "</script ", "<svg>", "<object>", "<div class=ad>"):
        html_text.blocks(x * 50_000)
    assert time.perf_counter() - began < 20


def test_memory_of_a_very_long_page():
    import tracemalloc

    rng = random.Random(1)
    a = [str(i) for i in range(100_000)]
    b = a[:]
    rng.shuffle(b)
    tracemalloc.start()
    found = [a[i] for i in sorted(html_text.common_lines(a, b))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    place = {x: i for i, x in enumerate(b)}
    assert peak < 250e6 and len(found) > 500 and all(place[x] < place[y] for x, y in zip(found, found[1:]))


def _without_structure(page):
    """The page with neutral elements in place of those that say what a part is."""
    return re.sub(r"<(/?)(?:article|nav|footer|header)\b[^>]*>", r"<\1div>", page).replace(' class="ad"', "")


def test_differencing_takes_part_on_the_given_pages(spark):
    """Alignment deletes lines of the driver's pages; the veto brings back passages that neighbours share, and nothing else."""
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()
    pages = sorted(rows, key=lambda r: re.sub(r"^\w+://", "", r.url))
    deleted = back = stay = removed_without_structure = 0
    for before, page in zip(pages, pages[1:]):
        if re.sub(r"^\w+://", "", before.url).split("/")[0] != re.sub(r"^\w+://", "", page.url).split("/")[0]:
            continue
        own, other = html_text.blocks(page.html), html_text.blocks(before.html)
        kept, shared, returned = html_text.decide(own, other)
        deleted += len(shared)
        back += len(returned)
        stay += len(shared - set(kept))
        assert returned <= shared and all(own[i].region for i in returned)
        own, other = html_text.blocks(_without_structure(page.html)), html_text.blocks(_without_structure(before.html))
        kept, shared, _ = html_text.decide(own, other)
        removed_without_structure += len(own) - len(kept)
    print(deleted, back, stay, removed_without_structure)
    assert deleted > 300 and back > 100 and stay > 300 and removed_without_structure > 300


def test_a_near_copy_keeps_its_body():
    def page(last):
        return html_text.blocks(f"<body><div>Menu of the site</div><div><p>One long paragraph that both share</p><p>Another one</p><p>{last}</p></div><div>Terms</div></body>")

    assert html_text.main_text(page("A new end of it"), page("The old end")) == "One long paragraph that both share\n\nAnother one\n\nA new end of it"
