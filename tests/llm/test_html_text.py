import html
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnbridge.llm import html_text as H

PAGE = """<html><head><title>t</title><style>p{}</style></head><body class="sidebar-left"><header><div>Site</div><ul class=menu><li><a href=/>Home</a></ul></header>
<div id="cookie-notice">We use cookies, please accept all of them.</div><div class="wrap"><div class="content"><h1>Title &lt;here&gt;</h1>
<p>First with <a href="#">a link</a> and<br>more text, long enough.</p><div class=advert>buy</div><p>Second&nbsp; &copy; goes on and on for some time.
<p>Third <b>bold<p>Fourth.</div><aside>Side</aside></div><section class="comments"><p>Great article, thanks so much for writing it!</p></section>
<form><label>Mail</label><input></form><script>var a = "<p>no</p>";</script><footer>&copy; 2020</footer></body></html>"""


def test_page_without_article_element():
    assert H.extract(PAGE) == "Title <here>\n\nFirst with a link and more text, long enough.\n\nSecond © goes on and on for some time.\n\nThird bold\n\nFourth."


@pytest.mark.parametrize("source, text", [
    (None, ""), ("", ""), ("<div></div>", ""), ("plain text <b>only", "plain text only"), ("a<hr>b &amp c", "a\n\nb & c"), ("<p>a<br>b</p>", "a b"), ("x<!-- n -->y", "xy"), ("<p>&#233;&eacute;&bogus;</p>", "éé&bogus;"),
    ("<article><h1>T</h1><p>one</p></article><nav>menu</nav>", "T\n\none"), ("<article><p>a</p><article class=comment><p>c</p></article></article>", "a"), ("<main><p>a</p><footer>f</footer></main>", "a"),
    ("<script>x", ""), ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"), ("<div role=navigation>n</div><p>t</p>", "t"),
])
def test_small_pages(source, text):
    assert H.extract(source) == text


def test_link_lists_in_an_article_stay_or_go_by_density():
    links = "<ul>" + "".join(f'<li><a href="/{i}">link number {i}</a></li>' for i in range(30)) + "</ul>"
    body = "".join(f"<p>{'Some words of the text of this article. ' * 8}</p>" for _ in range(4))
    text = H.extract(f"<body><div><h1>Title</h1>{body}{links}</div></body>")
    assert "link number" not in text and text.count("Some words") == 32


@pytest.mark.parametrize("sections, paragraphs", [(2, 5), (4, 10), (3, 1), (10, 2)])
@pytest.mark.parametrize("tag", ["section", "div"])
def test_article_split_over_sections(sections, paragraphs, tag):
    words = ("Some words of this article that goes on. " * 13)[:500]
    lines = [[f"Part {i}", *(f"{i} {k} {words}".strip() for k in range(paragraphs))] for i in range(sections)]
    parts = "".join(f"<{tag}><h2>{x[0]}</h2>" + "".join(f"<p>{p}</p>" for p in x[1:]) + f"</{tag}>" for x in lines)
    menu = "<ul>" + "".join(f'<li><a href="/{i}">Other page {i}</a></li>' for i in range(20)) + "</ul>"
    page = f'<body><div class="links">{menu}</div><div class="content"><h1>Title</h1><p>A short intro.</p>{parts}<p>The end.</p></div><div>{menu}</div></body>'
    assert H.extract(page) == "\n\n".join(["Title", "A short intro.", *sum(lines, []), "The end."])


def test_sections_of_unlike_length():
    long, short = "Words of a long paragraph of the text. " * 30, "Words of a shorter one here. " * 12
    page = f"<body><section><p>{long}</p><p>{long}</p></section><section><p>{short}</p><p>{short}</p></section><section><p>{long}</p></section></body>"
    assert H.extract(page) == "\n\n".join(x.strip() for x in (long, long, short, short, long))


def test_all_articles_of_a_page():
    words = [f"{i} {'Words of the text of this article. ' * 12}".strip() for i in range(10)]
    one, two = ("<article>" + "".join(f"<p>{w}</p>" for w in part) + "</article>" for part in (words[:5], words[5:]))
    assert H.extract(f"<body><p>Hello</p>{one}{two}<p>Bye</p></body>") == "\n\n".join(words)


def test_many_open_inline_elements():
    assert H.extract("<p>a " + "<font>b <i class=x>" * 20_000).split() == ["a"] + ["b"] * 20_000


TEXT = "<h1>Title</h1><p>" + "Words of the text of this page. " * 5 + "</p>"
WANTED = "Title\n\n" + ("Words of the text of this page. " * 5).strip()


@pytest.mark.parametrize("page", [
    '<div class="content-sidebar-wrap"><main>{}</main><aside>Side</aside></div>', '<div class="page has-sidebar"><div>{}</div></div>', '<article class="post comments-open">{}</article>',
    '<form id="aspnetForm"><main>{}</main></form>', '<div class="sidebar-wrapper"><article>{}</article></div><div class="sidebar-left">Side</div>', '<div class="widget"><div>{}</div></div><footer>f</footer>',
    '<div id="modal" aria-hidden="true"><main>{}</main></div>', '<article>{}</article><div class="comments"><p>' + "A long comment. " * 60 + "</p></div>",
    '<div class="content with-sidebar">{}</div>', '<article class="post no-comments">{}</article>', '<div id="ad-3">Buy this</div><div>{}</div>',
    '<article>{}</article><aside><article class=teaser>Other</article></aside>', '<nav><div>Menu</div></nav><div class="sidebar-left">' + "Side " * 9 + "</div><div>{}</div>",
])
def test_text_in_elements_of_listed_names(page):
    assert H.extract(f"<body>{page.format(TEXT)}</body>") == WANTED


@pytest.mark.parametrize("attributes", [
    'href="/hidden/path"', 'title="the hidden valley"', 'data-hidden="false"', 'href="/x?id=comment"', 'data-id="ad-3"', 'data-role="banner"', "data-class=sidebar", 'title="a class=comments b"',
    'class="share-price"', 'id="ad-1066"', 'class="related-work"', 'data-id="menu"', 'href="/p?id=menu"', 'alt=\'style="display:none"\'', 'aria-hidden="false"', 'class="has-sidebar unshared"', "x-style='display:none'",
])
def test_attributes_by_whole_name(attributes):
    assert H.extract(f"<body><div><p>One two three.</p><p {attributes}>Four five.</p><p>Six <a {attributes}>seven</a>.</p></div></body>") == "One two three.\n\nFour five.\n\nSix seven."


@pytest.mark.parametrize("attributes", ["hidden", 'x="1"hidden', "HIDDEN=''", 'aria-hidden="true"', "role=banner", "id=comments", 'class="x cookie-notice"', "class='ad-3'", "style='color:red;Display: none'"])
def test_listed_attributes_still_count(attributes):
    assert H.extract(f"<body><div><p>One two three.</p><p {attributes}>Four.</p></div></body>") == "One two three."


@pytest.mark.parametrize("source, text", [
    ("<p data-a=it's>Hello it's me</p><p>second para here</p>", "Hello it's me\n\nsecond para here"), ("<p a='x>y' b=\"p>q\">One</p>", "One"), ("<p a=>One</p>", "One"), ("<p =x>One</p>", "One"), ("<p a = 'b>'c>One</p>", "One"),
    ("<a href=/x/>One</a>", "One"), ("<p a=\"x>One</p>", "One"), ("<p a=\"b\"class=advert>One</p><p>Two</p>", "Two"), ("<p title=\"it's\">One <b class='x'y>two</b></p>", "One two"), ("x<a <b", "x<a <b"), ("x<!-- y", "x"),
])
def test_attributes_by_the_states_of_a_tag(source, text):
    assert H.extract("<article>" + source) == text


PROSE = "This block has a whole paragraph of prose, which a reader of the article would miss. " * 2


@pytest.mark.parametrize("block", ['<section class="share"><p>{}</p></section>', '<div class="related work"><p>{}</p></div>', '<p id="comments">{}</p>'])
def test_prose_in_an_article_stays(block):
    assert H.extract(f"<article><h1>Title</h1><p>One two three.</p>{block.format(PROSE)}<p>End.</p></article>") == f"Title\n\nOne two three.\n\n{PROSE.strip()}\n\nEnd."


@pytest.mark.parametrize("block", [
    '<div class="share">Share this</div>', '<div class="related"><a href=/a>' + PROSE + "</a></div>", '<section class="comments"><p>' + PROSE + "</p></section>", '<div class="advert">' + PROSE + "</div>", '<div class="share newsletter">' + PROSE + "</div>",
])
def test_boilerplate_in_an_article_goes(block):
    assert H.extract(f"<article><h1>Title</h1><p>One two three.</p>{block}<p>End.</p></article>") == "Title\n\nOne two three.\n\nEnd."


@pytest.mark.parametrize("page", [
    lambda n: "<div>" * n + "</q>" * n + "text", lambda n: "<title>" * n + "text", lambda n: "<p><table>" + "<font>" * n + "<div>x" * n, lambda n: "<a " * n, lambda n: "<ul><li>" * n + "<li>x" * n, lambda n: '<a b="' * n + ">x", lambda n: "<!-" * n,
])
def test_time_grows_with_the_length(page):
    """Eight times the page takes far less than the square of that."""
    import time

    spent = []
    for n in (2000, 16_000):
        begin = time.process_time()
        H.extract(page(n))
        spent.append(time.process_time() - begin)
    assert spent[1] < 24 * spent[0] + 0.2


def test_deep_and_long_pages():
    deep = "<div>" * 5000 + "deep text here" + "</div>" * 5000
    assert H.extract(deep) == "deep text here"
    words = "word " * 200_000
    assert H.extract(f"<article><p>{words}</p></article>") == words.strip()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/ap=\"'& ;!-x", max_size=60))
def test_any_text_is_taken(source):
    assert isinstance(H.extract(source), str)


def test_pages_of_the_table(spark, data):
    """Every page against its article element, cut out plainly."""
    from tarnbridge.llm.queries import QUERIES

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    rows = QUERIES["op10_html_extraction"](spark, data).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_odd_rows(spark):
    rows = spark.createDataFrame([(None, None, None, "x"), (1, "u", "", "x"), (1, "u", "<p>a", "x"), (1, "u", "<p>a", "x")], "page_id bigint, url string, html string, text string")
    assert sorted((str(r["page_id"]), r["text"]) for r in H.extract_pages(rows).collect()) == [("1", ""), ("1", "a"), ("1", "a"), ("None", "")]
    assert H.extract_pages(rows.limit(0)).count() == 0
