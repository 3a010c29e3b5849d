import re

from ledgerloom.llm import html_extract, registry
from ledgerloom.llm.html_extract import main_text, parse

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var a="</p><p>no";</script></head>
<body><div id="cookie-banner"><p>We use cookies, please accept all of them now.</p></div><header><h1>Site name</h1></header>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><aside class="sidebar"><p>Side text that is rather long, to be sure of it.</p></aside>
<div class="content post-12"><article><header><h1>The&nbsp;title</h1><p>by me</p></header><p>First   &amp; <b>bold
 text</b> &eacute;&#233;&#xe9; &amp here.<p>Second<br>line <a href="x">link</a>.</p><div class="ad">Buy!</div>
<form><p>Your mail</p><input></form><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><!-- <p>gone</p> -->
<div class="share-buttons">Share</div><section id="comments"><p>Nice article, thanks a lot for it!</p></section></article></div>
<div class="notice">A notice.</div><footer>&copy; me</footer></body></html>"""
TEXT = "The title\nFirst & bold text ééé & here.\nSecond\nline link.\none\ntwo\nc1\nc2"


def test_blocks_noise_and_references():
    assert main_text(parse(PAGE), []) == TEXT
    assert main_text(parse(PAGE[: PAGE.index("</article>")]), []) == TEXT


def test_odd_sources():
    for source, text in [("", ""), ("plain  text", "plain text"), ("a < b & c", "a < b & c"), ("<p>x", "x"), ("<p class='q>x<p>y</p>", "x\ny"), ("<<p>>z", "<\n>z"), ("<script>never ends", ""), ("<p>a</b></p>b", "a\nb")]:
        assert main_text(parse(source), []) == text, source
    deep = "<div>" * 3000 + "<p>deep</p>" + "</div>" * 3000
    assert main_text(parse(deep), []) == "deep"
    long = "<p>" + "word " * 200000 + "</p>"
    assert len(main_text(parse(long), [])) == 999999


def test_class_words_do_not_silence_the_main_part():
    body = "<p>The body of the text goes on for a while and has an end.</p>"
    for source in (
        f"<div id=page class=has-sidebar><article><h1>Title</h1>{body}</article><div class=sidebar>Side</div></div>",
        f"<div class=no-sidebar><h1>Title</h1>{body}</div><div class=sidebar-left>Side</div>",
        f"<div class='post comments-open'><h2>Title</h2>{body}<div class=comments-area>Nice</div></div>",
        f"<div class=social-page><p>Title</p>{body}</div><div class=social>Follow us</div>",
        f"<article><div class=entry-header><h1>Title</h1></div>{body}<div class=related-posts>More</div></article>",
    ):
        assert main_text(parse(source), []) == "Title\nThe body of the text goes on for a while and has an end.", source


def test_formulas_objects_and_controls_in_an_article_stay():
    source = "<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p><object><p>A picture.</p></object><p>Press <button>Start</button> now.</p><form><button>Send</button></form></article>"
    assert main_text(parse(source), []) == "So x=1 holds.\nA picture.\nPress Start now."


def test_host_votes_win_over_a_page_of_its_own_kind(spark):
    usual = "<body><div class=story><p>The story of page {0} goes on for a while and has an end.</p></div><div class=extra><p>x</p></div></body>"
    odd = "<body><div class=story><p>Short.</p></div><div class=extra><p>A very long extra text that by itself would win over the short story, by far.</p></div></body>"
    rows = [(i, f"http://A.org/{i}", usual.format(i)) for i in range(5)] + [(9, "http://a.org/9", odd), (10, None, None), (11, "x", ""), (9, "http://a.org/9", odd)]
    got = sorted((r.page_id, r.text) for r in html_extract.extract(spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")).collect())
    assert got == sorted([(i, f"The story of page {i} goes on for a while and has an end.") for i in range(5)] + [(9, "Short."), (9, "Short."), (10, ""), (11, "")])
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_given_pages(spark, sf_dir):
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    import html as h

    for r in registry.op2(spark, sf_dir).collect():
        article = re.search(r"<article>(.*)</article>", html[r.page_id], re.S)[1]
        blocks = [" ".join(h.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", article)]
        assert r.text == "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)
