"""HTML extraction: host templates, page fallback, broken markup."""

import html
import re

from leadflow.llm.html_text import Page, extract_text, host_templates, token_rows
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, html string, text string, host string, main string, place string"

DIVS = """<html><head><title>T</title><style>p{{}}</style></head><body>
<div id="top-menu"><a href="/">Home</a> <a href="/b">Blog</a></div>
<div class="cookie-notice">We use cookies. Accept them all now please and go on reading here.</div>
<div class="layout"><div class="content post-{i}"><h2>Title {i}</h2>{body}
<div class="ad">Buy now!</div><form><label>Mail</label><input name=q><button>Go</button></form></div>
<div class="sidebar"><ul><li>One</li><li>Two</li></ul></div></div>
<section id="comments"><p>First! What a long comment this reader has left on the page, really.</p></section>
<div class="footer">&copy; site</div><script>var x = "<p>no</p>";</script></body></html>"""


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def got(spark, rows):
    return {r.page_id: r.text for r in extract_text(rows_of(spark, rows)).collect()}


def test_template_of_a_host_without_article_tags(spark):
    bodies = ["<p>Some &lt;b&gt; text\n  here&nbsp;now</p><p>And <em>more</em>tail.</p>", "<p>x</p>", "", "<ul><li>a<li>b</ul>plain<br>end",
              "<blockquote>q " + "long text " * 4000 + "</blockquote>"]
    rows = [(i, f"http://a.example.org/{i}", DIVS.format(i=i, body=b)) for i, b in enumerate(bodies)]
    out = got(spark, rows)
    assert out[0] == "Title 0\nSome <b> text here now\nAnd moretail."
    assert out[1] == "Title 1\nx" and out[2] == "Title 2"
    assert out[3] == "Title 3\na\nb\nplain\nend"
    assert out[4] == "Title 4\nq " + ("long text " * 4000).strip()


def test_main_slot_is_the_shared_one(spark):
    rows = [(i, "http://h/", DIVS.format(i=i, body="<p>words of the page</p>")) for i in range(4)]
    df = rows_of(spark, rows).select(F.lit("h").alias("host"), F.col("page_id").alias("page"), "html")
    (r,) = host_templates(token_rows(df)).collect()
    assert r.main.endswith(">div.layout>div.content.post")


def test_pages_unlike_their_host_and_single_pages(spark):
    rows = [(i, "http://h.example/", DIVS.format(i=i, body="<p>same words</p>")) for i in range(3)]
    rows += [(9, "http://h.example/other", "<main><h1>Odd</h1><p>page</p></main><nav>menu</nav>"),
             (10, "http://alone.example", "<body><nav>n</nav><p>Only text</p></body>"),
             (11, None, "<article>a<p>b</article><footer>f</footer>"), (12, "no host", "just text &amp; more")]
    out = got(spark, rows)
    assert out[9] == "Odd\npage" and out[10] == "Only text" and out[11] == "a\nb" and out[12] == "just text & more"


def test_text_that_all_pages_share_is_text(spark):
    page = "<body><nav>m</nav><article><h1>H</h1><p>The same words</p></article><footer>f</footer></body>"
    out = got(spark, [(i, "http://copies.example/", page) for i in range(5)])
    assert set(out.values()) == {"H\nThe same words"}


def test_broken_markup_and_empties(spark):
    rows = [(1, "http://b/", None), (2, "http://b/", ""), (3, "http://c/", "<article><p><b>One.<br><p>Two</article><footer>&copy; x"),
            (4, "http://d/", "</div></p>text<div"), (5, "http://e/", "<!-- all <p>hidden</p>"), (6, "http://f/", "<script>only"),
            (7, "http://g/", '<article data-x="a>b">in</article>'), (8, "http://i/", "a < b and c > d <3"),
            (None, "http://j/", "<p>x</p>"), (None, "http://j/", "<p>x</p>")]
    out = got(spark, rows)
    assert out[1] == out[2] == out[5] == out[6] == "" and out[3] == "One.\nTwo" and out[4] == "text"
    assert out[7] == "in" and out[8] == "a < b and c > d <3" and out[None] == "x"
    assert extract_text(rows_of(spark, rows)).count() == len(rows)
    assert extract_text(rows_of(spark, [])).collect() == []


def test_very_deep_page_ends_quickly():
    assert Page("<div>" * 3000 + "deep" + "</div>" * 3000).extract(None) == "deep"
    assert Page("<" * 100_000).extract(None).startswith("<")
    assert Page('<a "' * 5000).extract(None) == ""


def test_pages_equal_a_direct_reading(spark):
    """The test pages hold one article element each; its blocks read by plain patterns."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    out = {r.page_id: r for r in extract_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)\b[^>]*>", inner))
        want = "\n".join(b for b in blocks if b)
        assert (out[r.page_id].text, out[r.page_id].n_chars, out[r.page_id].url) == (want, len(want), r.url)


def test_lead_and_body_and_mixed_layouts_keep_their_text(spark):
    lead = [(i, "http://lead.example/", f"<body><article><div class=lead>Lead {i}</div><div class=body>{f'body {i} ' * 60}</div></article>")
            for i in range(4)]
    mixed = [(10 + i, "http://mixed.example/", f"<body><div class=a>{f'words {i} ' * 90}</div><div class=b></div>") for i in range(9)]
    mixed.append((19, "http://mixed.example/", "<body><div class=a>x</div><div class=b>the article stands here</div>"))
    out = got(spark, lead + mixed)
    assert all(out[i] == f"Lead {i}\n" + f"body {i} " * 59 + f"body {i}" for i in range(4))
    assert out[19] == "x\nthe article stands here" and out[10].startswith("words 0 words 0")


def test_marked_elements_in_the_article_go_with_evidence_only(spark):
    page = ("<body><div class='ad'>ad {i}</div><article><p>Text {i}</p><section id=related-work>Others {i} did this.</section>"
            "<div class=share>Tell your friends</div></article>")
    out = got(spark, [(i, "http://marks.example/", page.format(i=i)) for i in range(4)])
    assert all(out[i] == f"Text {i}\nOthers {i} did this." for i in range(4))


def test_classes_remove_the_template_text(spark):
    page = "<body><main><div class=box>{box}</div><p>Text {i} of the page</p><p>once {i}</p></main>"
    out = got(spark, [(i, "http://boxes.example/", page.format(i=i, box="Read our letter")) for i in range(4)]
              + [(10 + i, "http://two.example/", page.format(i=i, box="Said on two pages")) for i in range(2)]
              + [(20 + i, "http://some.example/", page.format(i=i, box="Said by most" if i else "not here")) for i in range(5)])
    assert all(out[i] == f"Text {i} of the page\nonce {i}" for i in range(4))
    assert all(out[10 + i].startswith("Said on two pages\n") for i in range(2))       # too few pages
    assert all(out[20 + i].startswith("Said by most\n") for i in range(1, 5))         # not where its element is


def test_a_shared_closing_line_of_an_article_is_text(spark):
    page = ("<body><div class=top>The house paper</div><article><p>Text {i} of this page</p><p>Signed, the editors.</p>"
            "<div class=box>Read our letter</div></article><div class=end>Legal line</div>")
    out = got(spark, [(i, "http://closing.example/", page.format(i=i)) for i in range(5)])
    assert all(out[i] == f"Text {i} of this page\nSigned, the editors." for i in range(5))


def test_comments_and_sign_up_forms_in_an_article_go_though_they_differ(spark):
    page = ("<body><article><p>Text {i} of the page goes on for a while here</p><div class='comment'>cm {i}</div>"
            "<div class='newsletter-signup'>Sign up {i} now</div><section class='comments'><div>Reader {i} says so</div></section>"
            "<div id='sponsored'>Buy {i}</div><section id=related-work>Others {i} did this.</section></article>")
    rows = [(i, "http://comments.example/", page.format(i=i)) for i in range(4)] + [(9, "http://one.example/", page.format(i=9))]
    out = got(spark, rows)
    assert all(out[i] == f"Text {i} of the page goes on for a while here\nOthers {i} did this." for i in (0, 1, 2, 3, 9))


def test_a_frame_named_like_a_comment_keeps_its_article(spark):
    page = "<body><article><div class='post comments'><p>{t} number {i}</p></div><p>end {i}</p></article>"
    out = got(spark, [(i, "http://frame.example/", page.format(i=i, t="long text " * 20)) for i in range(3)])
    assert all("long text" in out[i] and out[i].endswith(f"end {i}") for i in range(3))


def test_many_templates_are_joined_by_shuffle(spark, monkeypatch):
    from leadflow.llm import html_text as H
    monkeypatch.setattr(H, "MAX_BROADCAST_TOKENS", 0)
    page = "<body><div class=top>The house paper</div><article><p>Text {i}</p></article>"
    out = got(spark, [(i, f"http://h{i % 2}.example/", page.format(i=i)) for i in range(8)])
    assert out == {i: f"Text {i}" for i in range(8)}
