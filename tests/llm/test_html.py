import pytest

from taleweft.llm import html


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain &amp; text", "plain & text"), ("<p>a<b>b</b> c</p><p> d\n e</p>", "ab c d e"),
        ("<head><title>t</title></head><nav>menu</nav><article><h1>T</h1><p>x &lt; y<br>z<script>'<p>no</p>'</script></article><footer>f</footer>", "T x < y z"),
        ("<header>site</header><main><p>one</p><aside>side</aside><form><input value='x'>f</form></main>", "one"),
        ('<article><p>body</p><section class="reader-comments"><p>first!</p></section><div id="cookie-notice">we use</div></article>', "body"),
        ("<body><nav>never closed <article>text</article>", "text"), ("<article>cut off <p>he", "cut off he"), ("<article class='has-sidebar'>kept</article>", "kept"),
        ("<article>a<!-- <p>gone</p> -->b&nbsp;&#233;</article>", "ab é"), ('<article><a href="x>y">link</a></article>', "link"), ("<ARTICLE>Up</ARTICLE><FOOTER>no</FOOTER>", "Up"),
        ('<article><h2 id="ad-hoc-queries">one</h2><p id="sharing-economy">two</p><h3 id="social-security">three</h3><div class="menu-planning">four</div></article>', "one two three four"),
        ("<main><h1>Story</h1><p>Real body text.</p><section><article><h3>Teaser</h3></article></section></main>", "Story Real body text."),
        ("<main><h1>News</h1><article>first long story</article><article>second</article></main>", "first long story second"),
        ('<article>body<section id="comments"><h2>Comments</h2><p>first!</p></section><ol id="commentList-2"><li>no</li></ol><table id="reader_comments"><tr><td>x</td></tr></table></article>', "body"),
        ('<article><h2 id="comments">On comments</h2><section id="comment-sections-of-law">kept</section><section id="advertising">kept too</section></article>', "On comments kept kept too"),
        ('<article>one<div class="AdSlot-1">buy</div><p class="advertorial">paid</p><div class="adSlot2">more</div><p class="adSense iPad">two</p></article>', "one two"),
        ('<article>a<span class="ad">buy</span>b <b class="share-buttons">x</b></article><div class="site-footer">f</div>', "ab"),
    ],
)
def test_main_text(page, text):
    assert " ".join(html.checked(html.lines(page or ""), set())) == text


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def test_alignment_is_a_longest_common_subsequence():
    import random

    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        got = html.shared(a, b)
        it = iter(b)
        assert len(got) == lcs(a, b) and all(a[i] in it for i in sorted(got))


def brute(pages):
    """(address, source) of pages without an article: what the nearest page of the host doesn't share, by all pairs."""
    import re
    from os.path import commonprefix

    split = lambda url: re.match(r"(?i)[a-z]+://([^/?#]*)([^?#]*)", url or "")
    own = [[x.text for x in html.lines(src or "")] for _, src in pages]
    place = [(m[1].lower(), m[2]) if (m := split(url)) else ("", "") for url, _ in pages]
    by_text: dict = {}
    for (host, path), text in zip(place, own, strict=True):
        if host:
            key = (host, b"".join(html.hashes([html.Line(0, x) for x in text])))
            by_text[key] = min(path, by_text.get(key, path))
    nodes: dict = {}
    for (host, joined), path in by_text.items():
        key = html.hashlib.blake2b(joined, digest_size=16).digest()
        nodes[host, path] = min((key, joined), nodes.get((host, path), (key, joined)))
    order = sorted(nodes)
    out = []
    for (host, path), text in zip(place, own, strict=True):
        gone = set()
        if host:
            hashed = html.hashes([html.Line(0, x) for x in text])
            at = order.index((host, by_text[host, b"".join(hashed)]))
            near = [order[j] for j in (at - 1, at + 1) if 0 <= j < len(order) and order[j][0] == host]
            if near:
                best = max(near, key=lambda x: len(commonprefix([x[1], order[at][1]])))
                other = nodes[best][1]
                gone = html.shared(hashed, [other[i : i + 16] for i in range(0, len(other), 16)])
        out.append(" ".join(x for i, x in enumerate(text) if i not in gone))
    return out


def frame(spark, pages):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")


def texts(spark, pages, parts=3):
    return {r["page_id"]: r["text"] for r in html.extract(frame(spark, pages).repartition(parts)).collect()}


def site(rng, n):
    pages = []
    for _ in range(n):
        host = rng.choice(["a.example", "A.example", "b.example", "c.example"])
        path = "/".join(["", *(rng.choice("xyz") for _ in range(rng.randint(0, 4)))])
        body = ["menu", f"notice {rng.randint(0, 1)}", *(f"line {rng.randint(0, 30)}" for _ in range(rng.randint(0, 6))), "end"]
        pages.append((rng.choice([f"http://{host}{path}", f"https://{host}{path}?q=1", None]), "".join(f"<p>{x}</p>" for x in body)))
    return pages + [("http://a.example/x", None), ("no address", "<p>menu</p>"), ("http://a.example/x", "")]


def test_pages_equal_all_pairs_in_any_layout(spark):
    import random

    pages = site(random.Random(4), 200)
    want = dict(enumerate(brute(pages)))
    set_ = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 4, 64):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.enabled", parts != 64)
            assert texts(spark, pages, parts) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", set_)
        spark.conf.set("spark.sql.adaptive.enabled", True)


def test_neighbours_share_the_template(spark):
    page = lambda own: f"<body><div>Site name</div><div>Read more</div><p>{own}</p><p>{own} again</p><div>All rights</div></body>"
    got = texts(spark, [("http://h/a/1", page("one")), ("http://h/a/2", page("two")), ("http://other/a/1", page("three")), (None, page("four")), ("http://h/a/9#x", None)])
    assert got == {0: "one one again", 1: "two two again", 2: "Site name Read more three three again All rights", 3: "Site name Read more four four again All rights", 4: ""}


def test_copies_and_second_addresses_are_no_partner(spark):
    pages = [("http://h/a?1", "<p>same</p><p>page</p>"), ("http://h/a?2", "<p>same</p><p>page</p>"), ("http://h/a/print", "<p>same</p><p>page</p>")]
    assert set(texts(spark, pages).values()) == {"same page"}
    assert texts(spark, [*pages, ("http://h/b", "<p>same</p><p>other</p>")]) == {0: "page", 1: "page", 2: "page", 3: "other"}


def test_markup_checks_what_differencing_leaves(spark):
    page = lambda i: f"<nav>menu {i}</nav><article><h1>Shared title</h1><p>own {i}</p></article><div>site</div>"
    rows = {r["page_id"]: r for r in html.extract(frame(spark, [("http://h/1", page(1)), ("http://h/2", page(2))])).collect()}
    assert rows[0]["text"] == "Shared title own 1" and (rows[0]["n_lines"], rows[0]["n_shared"]) == (4, 2)


def test_a_long_malformed_page_takes_linear_time():
    import time

    pages = ["<div>" * 80_000 + "</span></p></b>" * 45_000, "<div class='ad'>" * 30_000 + "<article>x" * 40_000, '<a "' * 250_000, "<!-- " * 200_000, "<b>" * 150_000 + "</i>" * 150_000 + "</b>" * 50_000]
    for page in pages:
        began = time.perf_counter()
        html.lines(page)
        assert time.perf_counter() - began < 5


def test_query_and_odd_rows(spark, data):
    rows = html.op8_html(spark, data).collect()
    assert len(rows) == 50 and all(r["n_chars"] == len(r["text"]) for r in rows) and any(r["n_shared"] for r in rows)
    df = spark.createDataFrame([(1, None, "<p>x</p>", "t", 5)] * 2, "page_id long, url string, html string, text string, n_lines int")
    out = html.extract(df)
    assert [r["text"] for r in out.collect()] == ["x", "x"] and out.columns == ["page_id", "url", "text", "n_lines", "n_shared"]
    assert html.extract(df.filter("false")).count() == 0
    assert [r["html"] for r in html.extract(df.select("url", "html"), out="html").collect()] == ["x", "x"]


def test_query_keeps_every_article(spark, data):
    """The given pages mark one article each; by a parser of its own, their text is what the query gives."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.blocks = False, [""]

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            if tag not in html.INLINE:
                self.blocks.append("")

        def handle_endtag(self, tag):
            self.inside &= tag != "article"
            if tag not in html.INLINE:
                self.blocks.append("")

        def handle_data(self, text):
            if self.inside:
                self.blocks[-1] += text

    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in html.op8_html(spark, data).collect():
        p = Article()
        p.feed(source[r["page_id"]])
        assert r["text"] == " ".join(" ".join(x.split()) for x in p.blocks if x.split())
