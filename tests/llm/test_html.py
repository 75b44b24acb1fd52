import re
from collections import Counter

import pytest

from scholia.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="nav-open">
<header>Site</header><nav><ul><li><a href="/a">A<li>B</ul></nav><!-- ad --><div class="ad">Buy</div>
<div class="content">{body}</div><div id="userComments"><p>first!</p></div><footer>&copy; 2024</footer></body>"""


def test_main_text():
    assert H.main_text(PAGE.format(body="<article><header><h1>Title</h1></header><p><b>One &eacute;&#233;<br><p>Two\n\t <i>it</i>alic&nbsp;x <p>Three<script>no</script></article>")) == "Title\nOne éé\nTwo italic x\nThree"
    assert H.main_text(PAGE.format(body="<p>Only <a href='x>y'>link</a></p>loose")) == "Only link\nloose"
    assert H.main_text("<main><p>a<div class='share'>s</div><table><tr><td>1<td>2</table></main><p>out") == "a\n1\n2"
    assert H.main_text(None) == H.main_text("") == H.main_text("<nav>x</nav>") == ""
    assert H.main_text("a < b &lt;c&gt;") == "a < b <c>"
    assert H.main_text("<div>" * 20_000 + "deep") == "deep"
    assert H.main_text("<article><p>" + "long " * 50_000) == ("long " * 50_000).strip()
    assert H.main_text("<article><p>a</p><article class='comment'>c</article><form>f</form></article><article>b</article>") == "a\nb"


@pytest.mark.parametrize("most", [H.BROADCAST_HASHES, -1])
def test_templates(spark, monkeypatch, most):
    monkeypatch.setattr(H, "BROADCAST_HASHES", most)
    rows = []
    for i in range(30):
        rows.append((i, f"https://A.example/{i}", f"<body><p>Welcome to this site</p><p>story {i} of many</p><div><p>All <i>rights</i> kept</p></div></body>", "x"))
        rows.append((100 + i, f"http://b.example/{i}", "<article><h1>Same</h1><p>the same article on each page</p></article>", "x"))
        rows.append((200 + i, f"http://c.example/{i}", f"<article><p>read this {i} with a lot of other words to keep</p><p>Sign up now</p></article>", "x"))
    rows += [(1000, None, None, "x"), (1001, "no host", "<p>Welcome to this site", "x"), (1001, "no host", "<p>again", "x"), (None, "http://d.example", "<p>null id", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _host string")
    got = H.extract(pages).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    text = {r["page_id"]: r["text"] for r in got}
    assert all(text[i] == f"story {i} of many" for i in range(30))
    assert all(text[100 + i] == "Same\nthe same article on each page" for i in range(30))
    assert all(text[200 + i] == f"read this {i} with a lot of other words to keep" for i in range(30))
    assert text[1000] == "" and text[None] == "null id"
    assert sorted(r["text"] for r in got if r["page_id"] == 1001) == ["Welcome to this site", "again"]
    assert H.extract(pages.limit(0)).count() == 0


def test_articles_keep_what_others_share(spark):
    last = "<p>A paragraph that <b>five</b> articles have.</p>"
    rows = [(i, f"http://e.example/{i}", f"<article><p>story {i} with <em>many</em> words of its own</p>{last if i < 5 else ''}</article>") for i in range(24)]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(24):
        assert got[i] == f"story {i} with many words of its own" + "\nA paragraph that five articles have." * (i < 5)


def test_class_of_a_frame():
    page = "<body><div class='{}'><article><p>the story of the page, told at length</p></article></div><p>{}</p></body>"
    assert H.main_text(page.format("sidebar-layout", "end")) == "the story of the page, told at length"
    assert H.main_text(page.format("related", "long text of a page without an article " * 3)).startswith("long text")


def test_words_and_quotes_that_are_no_markup():
    got = H.main_text("<article><h2 id='social-history'>A</h2><section id=related-work><p class='side-effects'>B</p></section><p data-x=it's>C one</p><p>C isn't D</p></article>")
    assert got == "A\nB\nC one\nC isn't D"
    assert H.main_text("<main><p>a</p><div class='related-posts'>r</div><div id=userComments>c</div><a title='x > y' href=/?a=b>link</a></main>") == "a\nlink"


def test_whole_table_against_plain_python(spark):
    """Hosts' templates counted in one Python loop, on all pages of a table."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.collect()
    host = lambda u: re.match(r"(?:[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+))?", u or "")[1] or ""
    seen = [H.subtree_hashes(r["html"]) for r in rows]
    sizes = Counter(host(r["url"]).lower() for r in rows)
    counts = Counter((host(r["url"]).lower(), x) for r, hashes in zip(rows, seen, strict=True) for x in hashes)
    want, plain = {}, 0
    for r, hashes in zip(rows, seen, strict=True):
        h = host(r["url"]).lower()
        template = {x for x in hashes if counts[h, x] >= max(H.LEAST_PAGES, H.LEAST_SHARE * sizes[h])}
        always = {x for x in template if counts[h, x] == sizes[h]}
        want[r["page_id"]] = H.main_text(r["html"], template, always)
        plain += want[r["page_id"]] != H.main_text(r["html"])
    assert {r["page_id"]: r["text"] for r in H.extract(pages).collect()} == want
    print(f"template removal changed {plain} of {len(rows)} pages")


def test_words_with_classes_and_boxes_of_readers():
    page = "<article><p>See <a class='share'>link</a> and <span class='ad'>this</span> here</p><section class='user-feedback'><p>First!</p></section><div class='cc-window'>We use cookies</div><div class='share-buttons'><a>Tweet</a></div><p>end</p></article>"
    assert H.main_text(page) == "See link and this here\nend"
