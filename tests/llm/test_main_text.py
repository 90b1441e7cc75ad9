import time

import pytest

from synthframe.llm.main_text import Page, main_text, marked_names

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header>Site name</header><nav><ul><li><a href=/>Home</a></ul></nav><div id="cookie-banner">We use cookies</div><!-- <p>no</p> -->
<div class="wrap v12"><div class="sidebar"><p>Side text that is long enough to matter</div><main>
<article class="post post-44"><header><h1>Title &amp; more</h1></header><p>First   para&nbsp;with <a href=x>a link</a> in
it.<p>Second<br>line &lt;b&gt; &#233;<div class="ad">Buy</div><ul><li>item one<li>item two</ul><form>Mail <input></form>
<pre>a
b</pre><table><tr><td>c1<td>c2</table></article>
<section class="comments"><h2>Comments</h2><p>A reader comment that is quite a bit longer than everything else on this page, really, it goes on and on and on.</section>
</main></div><footer>&copy; me</footer></body></html>"""
WANT = "Title & more\n\nFirst para with a link in it.\n\nSecond line <b> é\n\nitem one\n\nitem two\n\na b\n\nc1\n\nc2"


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", "c") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, text string, path string").repartition(2)


def test_page_without_menus_notices_and_comments():
    page = Page(PAGE)
    assert page.text([page.best()]) == WANT
    assert page.best().path() == "html>body>div.v#.wrap>main>article.post.post-#"


def test_a_host_votes_on_the_path(spark):
    post = "<body><div class='box n{}'><h1>Head {}</h1><p>{}</p></div><div class='more'><p>{}</p></div></body>"
    rows = [("http://h.example/1", post.format(i, i, "story text " * 30, "x " * 5)) for i in range(5)]
    rows.append(("http://H.example/2", post.format(9, 9, "short", "noise that is longer than the story of this page " * 3)))
    rows += [("http://other.example", "<p>lonely"), (None, None), ("not a url", ""), ("http://h.example/3", "<div><p>no such path here, falls back")]
    got = {r.page_id: r for r in main_text(table(spark, rows)).collect()}
    assert got[5].text == "Head 9\n\nshort"
    assert got[5].path == "html>body>div.box.n#"
    assert (got[6].text, got[7].text, got[7].n_chars, got[8].text) == ("lonely", "", 0, "")
    assert got[9].text == "no such path here, falls back"


def test_broken_deep_and_empty_pages(spark):
    deep = "<div>" * 20000 + "<p>bottom" + "</div>" * 20000
    rows = [("http://a", "<p>" * 3 + "</b></i></p>text &amp &bogus; <"), ("http://b", deep), ("http://c", "<script>never closed <p>x"), ("http://d", "plain text only"), ("http://d", "plain text only")]
    got = {r.page_id: r.text for r in main_text(table(spark, rows)).collect()}
    assert got[0].startswith("text & &bogus;") and got[1] == "bottom" and got[2] == "" and got[3] == got[4] == "plain text only"
    assert main_text(table(spark, rows).filter("false")).count() == 0


def own_text(source):
    page = Page(source)
    best = page.best()
    return page.text([best]) if best else ""


LONG = "A sentence of the story that is long enough to count. " * 3


@pytest.mark.parametrize("names,marked", [
    ("content has-sidebar", False), ("post no-comments", False), ("hide-menu content", False), ("entry-content", False), ("main content-sidebar", False), ("v12 post-44", False), ("with-nav", False),
    ("sidebar", True), ("cookie-banner", True), ("site-footer", True), ("main-nav", True), ("content sidebar", True), ("comments", True), ("post-comments comments", True), ("article-comments", True), ("ad", True), ("ad-300", True),
    ("", False), ("download", False), ("header-image", False)])
def test_class_names_are_judged_whole(names, marked):
    assert marked_names(names.split()) is marked


def test_an_article_under_a_telling_class_name_is_kept():
    for names in ("content has-sidebar", "post no-comments"):
        assert own_text(f'<body><nav>Menu</nav><div class="{names}"><p>{LONG}</p><p>More.</p></div></body>') == f"{LONG.strip()}\n\nMore."


def test_links_in_lists():
    cited = '<h2>References</h2><ul><li><a href=a>A cited paper</a></li><li><a href=b>Another one</a></li></ul>'
    assert own_text(f"<body><article><p>{LONG}</p>{cited}</article></body>").endswith("References\n\nA cited paper\n\nAnother one")
    mixed = "<ul><li><a href=a>A paper</a></li><li>and a remark</li></ul>"
    assert own_text(f"<body><div><p>{LONG}</p>{mixed}</div></body>").endswith("A paper\n\nand a remark")
    one = "<ul><li><a href=a>The paper</a></li></ul>"
    assert own_text(f"<body><div><p>{LONG}</p>{one}</div></body>").endswith("The paper")
    menu = "<ul><li><a href=/>Home</a></li><li><a href=/x>Shop</a></li></ul>"
    assert own_text(f"<body><div><p>{LONG}</p>{menu}</div></body>") == LONG.strip()


def test_an_article_in_parts_is_joined_and_boxes_are_not():
    parts = f'<div class="wrap"><div class="intro"><h1>Title</h1><p>The intro.</p></div><div class="rest"><p>{LONG}</p></div></div>'
    want = f"Title\n\nThe intro.\n\n{LONG.strip()}"
    assert own_text(f"<body>{parts}</body>") == want
    assert own_text(f"<body><div><div>{parts}</div></div></body>") == want
    box = f'<div class="wrap"><div class="rest"><p>{LONG}</p></div><div class="box"><a href=x>Buy this</a> <a href=y>or that</a></div></div>'
    assert own_text(f"<body>{box}</body>") == LONG.strip()
    assert own_text(f"<body><div class=one><p>{LONG}</p></div><div class=two><p>Other.</p></div></body>") == LONG.strip()


def test_nesting_does_not_matter():
    for depth in (0, 1, 5, 100):
        deep = "<span>" * depth
        assert own_text(f"<body><div><p>{LONG}</p><ul><li><a href=a>{deep}Home</a></li><li><a href=b>{deep}Shop</a></li></ul></div></body>") == LONG.strip()
        assert own_text(f"<body><div><p>{LONG}{deep}<div>x</div>tail</div></body>") == f"{LONG.strip()}\n\nx\n\ntail"


def test_work_grows_with_the_page_not_with_its_square():
    took = []
    for n in (4000, 32_000):
        source = "<div>" * n + f"<p>{LONG}</p></i>" + "</section></div>" * n
        page = Page(source)
        start = time.perf_counter()
        page = Page(source)
        assert len(page.at_path(page.best().path())) == 1
        took.append(time.perf_counter() - start)
    assert took[1] < 24 * took[0] + 0.5
