"""op1 against a reading of the test pages by their one template, and the style tree on made pages."""

import html
import math
import re

from trafficlens.llm import html_extract as he
from trafficlens.llm.queries import op1
from tests.conftest import SF


def by_template(page):
    """The test pages: one article, blocks opened by <h1> or <p>."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)
    blocks = re.split(r"</?(?:p|h1)>", inside[1]) if inside else []
    out = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in blocks]
    return "\n\n".join(b for b in out if b)


def test_query_on_whole_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op1(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == by_template(pages[r.page_id].html or ""), r.page_id
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_markup():
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body class="menu-open"><header>Top</header>
    <nav><ul><li>Menu<li>More</ul></nav><div class="cookie-notice"><p>We use cookies</div><main><p>Outside</p>
    <article class="post"><h1>Title&nbsp;&#233;</h1><p>One <b>bold</b>ly<br>two
    <!-- hidden <p>no</p> --><span class="ad">Buy!</span> three<p>Next &lt;p&gt;<script>var t="</p><p>x";</script>
    <ul><li>a<li>b</ul><form><input value=">">Mail</form><aside>Side</aside><section class="comments"><article class="comment">Nice</article></section>
    <blockquote title="a > b">Quote</blockquote></article></main><footer>&copy; x</footer></body></html>"""
    assert he.main_text(page).split("\n\n") == ["Title é", "One boldly two three", "Next <p>", "a", "b", "Quote"]
    assert he.main_text("<p>a</div></p>b<table><tr><td>c<td>d<tr><td>e</table><script>open") == "a\n\nb\n\nc\n\nd\n\ne"
    assert he.main_text(None) == he.main_text("") == he.main_text("<nav>x</nav>") == ""
    assert he.main_text("plain &lt;") == "plain <"
    assert he.main_text("<div>" * 3000 + "x" + "</div>" * 3000) == "x"


def test_skipped_elements_end():
    for skipped in ('<svg-icon name="x"></svg-icon>', "<svg viewBox='0 0 1 1'/>", "<math />", "<button-group></button-group>", "<select-box/>", "<button>", "<select>",
                    "<noscript>", "<object data=x>", "<template>", "<iframe src=x>", "<svg>", "<SVG><svg>t</svg>t</SVG>", "<button>t</button>", "<script>'<svg>'</script>"):
        assert he.main_text(f"<p>a {skipped} b</p><p>rest</p>") == "a b\n\nrest", skipped
        assert he.main_text(f"<p>a {skipped} b</p><p>rest</p><svg>t</svg><button type=a>t</button>") == "a b\n\nrest", skipped
    assert he.main_text("<p>a<script>b</p><p>c") == he.main_text("<p>a<title>b</p><p>c") == "a"
    assert he.main_text("<button>" * 50000 + "<svg>" * 50000 + "x") == "x"


def test_main_part_by_important_text(spark):
    def story(i):
        return [f"Story {i} " + "goes on and on " * 10 + "here", f"End {i} " + "of the long story " * 10 + "now"]

    def page(i, kind):
        cards = "".join(f"<article class='card'><p>Teaser {i} {j} of another story on this site, read it now, it is a good one</p></article>" for j in range(8))
        paragraphs = "".join(f"<p>{p}</p>" for p in story(i))
        middle = {"main": f"<main>{paragraphs}</main>{cards}", "div": f"<div class='story'>{paragraphs}</div>{cards}",
                  "article": f"<main><p>Read {i} times</p><article>{paragraphs}</article></main>{cards}",
                  "short": f"<main><p>Skip {i}</p></main><div class='story'>{paragraphs}</div>"}[kind]
        return f"<body><div class='legal'><p>{'All rights are reserved and so on. ' * 30}</p></div>{middle}</body>"
    kinds = ("main", "div", "article", "short")
    rows = [(i, f"https://{kind}.example.org/{i}", page(i, kind)) for kind in kinds for i in range(20)]
    for r in he.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        kind, i = r.url[8:].split(".")[0], r.page_id
        got, want = r.text.split("\n\n"), story(i)
        if kind in ("main", "article"):
            # The cards are as much text as the story, each is less.
            assert got == want if kind == "main" else got[:2] == want, kind
        else:
            assert [g for g in got if g in want] == want, kind
        assert not any("rights" in g for g in got), kind


def test_style_tree_cuts_what_repeats(spark):
    rows = []
    for i in range(40):
        body = f"<div class='t'>Site name</div><div class='x'><p>Story {i} of the day</p><p>More {i * 7}</p></div><div class='u'><p>All rights</p></div>"
        rows.append((i, f"https://News.example.org/{i}", f"<html><body>{body}</body></html>"))
    rows += [(100 + i, f"http://few.example.org/{i}", "<html><body><div class='t'>Same</div></body></html>") for i in range(5)]
    rows += [(200, "http://h.org/", None), (201, None, ""), (202, None, "<p>x"), (202, None, "<p>x"), (None, "odd", "<p>y " * 20000)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = {}
    for r in he.extract(pages).collect():
        got.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    assert all(got[i] == [f"Story {i} of the day\n\nMore {i * 7}"] for i in range(40))
    assert all(got[100 + i] == ["Same"] for i in range(5))
    assert got[200] == [""] and got[201] == [""] and got[202] == ["x", "x"] and len(got[None][0]) == 20000 + 2 * 19999
    tree = {(r.host, r.path): r.importance for r in he.style_tree(pages.selectExpr("'h' as host", "html").where("page_id < 40")).collect()}
    assert abs(tree["h", "/html/body/div.t"]) < 1e-9 and abs(tree["h", "/html/body/div.x/p"] - 1) < 1e-9
    assert he.extract(pages.limit(0)).count() == 0
    assert math.isclose(tree["h", "/html"], 1)
