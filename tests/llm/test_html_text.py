"""Main-text extraction: what the window sums decide, odd markup, and an independent reading of pages."""

import time
from html.parser import HTMLParser

import pytest

from talewarp.llm import html_text

LONG = "A sentence of the article that goes on for quite a while. " * 4


def test_regions():
    assert html_text.regions([0, 5, 0, 0, 0, 7, 3, 0, 0, 0]) == [(1, 2, 5), (5, 7, 10)]
    assert html_text.regions([4, 0, 0, 5, 0, 0, 0, 1]) == [(0, 4, 5), (7, 8, 1)]
    assert html_text.regions([4, 0, 5]) == [(0, 3, 9)]
    assert html_text.regions([]) == html_text.regions([0, 0]) == []


def test_window_sums_decide():
    """No tag, role or class tells the menu, the link list and the stray line from the article."""
    menu = "".join(f'<div><a href="/{x}">{x}</a></div>' for x in ("Home", "News", "Sport", "Weather"))
    page = f'<body>{menu}<h1>Title</h1><p>{LONG}</p><p><a href="x">one link alone</a></p><p>{LONG}</p>{menu}<section>12 users online</section></body>'
    want = "\n".join(["Title", LONG.strip(), "one link alone", LONG.strip()])
    assert html_text.main_text(page) == want
    assert html_text.main_text(page, surge=0) == want + "\n12 users online"
    wide = html_text.main_text(page, window=50, surge=0)  # without blocks of lines, all that lies between is kept
    assert "Weather" in wide and wide.endswith("12 users online")


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<p>{LONG}</p><nav><a>menu</a></nav><p>A short end.</p><footer>f</footer>", f"{LONG.strip()}\nA short end."),
        (f"<p>{LONG}</p><aside>n</aside><p><a href=x>a link</a></p>", f"{LONG.strip()}\na link"),
        (f'<article><p>{LONG}</p></article><ol class="comment-list"><li><article class="comment-body"><p>reader</p></article></li></ol>', LONG.strip()),
        (f"<article><p>{LONG}</p></article><aside><article><p>teaser</p></article></aside>", LONG.strip()),
        (f'<main><p>{LONG}</p><article class="comment"><p>reader</p></article></main>', LONG.strip()),
        (f"<nav><a>menu</a><article><p>{LONG}</p></article>", LONG.strip()),
        (f"<head><title>t</title><body><p>{LONG}</p>", LONG.strip()),
        (f'<article class="post comments-open"><p title="a hidden gem">{LONG}</p></article>', LONG.strip()),
        ("<ul><li class=ad>x<li>first<li>second</ul>", "first\nsecond"),
        ('<p>a <b title="x > y">b</b> c', "a b c"),
        ("<p>1 < 2 &lt;i&gt; <3 <p>cut <a href='x", "1 < 2 <i> <3\ncut"),
        ("<!-- no <p>x</p> --><p>y<!-- open", "y"),
        ("<p a='x>one</p><p>two</p>", "one\ntwo"),
        ("<DIV>Up<BR>down&nbsp; x</DIV>", "Up\ndown x"),
    ],
)
def test_pages(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        *((f'<div {names}><article><p>{LONG}</p></article></div>', LONG.strip()) for names in ('class="layout has-sidebar"', 'class="post comments-open"', 'id="widget-area-main"', 'class="sidebar"', 'class="no-menu with-footer"')),
        (f'<div class="menu-wrapper"><p>{LONG}</p><p>{LONG}</p></div>', f"{LONG.strip()}\n{LONG.strip()}"),
        (f'<article><p>{LONG}</p><p class="share-price">Up 3</p><p class="notice">Note</p><div class="ad-free-reading">Read on</div></article>', f"{LONG.strip()}\nUp 3\nNote\nRead on"),
        (f'<article><p>{LONG}</p><p class="ad">Buy</p><section class="comments"><p>reader</p></section><div class="ad-slot">Buy</div></article>', LONG.strip()),
        (f'<div class="comments"><p>{LONG * 3}</p></div><article><p>{LONG}</p></article>', LONG.strip()),
        (f'<article><p>{LONG}</p></article><div class="comment-list"><article><p>reader {LONG * 3}</p></article></div>', LONG.strip()),
        (f'<body><div><a href="a">Home</a> <a href="b">News</a></div><div>{LONG}</div><div>Copyright 2024 by us</div></body>', LONG.strip()),
        (f"<table><tr><td><a href='a'>Home</a></td></tr><tr><td>{LONG}</td></tr><tr><td>Imprint, contact</td></tr></table>", LONG.strip()),
        (f'<div class="main-sidebar"><p>{LONG}</p></div><div id="siteFooter">x</div><div><p>{LONG * 2}</p></div>', (LONG * 2).strip()),
        ('<article><ul><li><a href="a">One</a><li><a href="b">Two</a></ul></article>', "One\nTwo"),
        (f'<article><h2><a href="x">A linked title</a></h2><p>{LONG}</p></article>', f"A linked title\n{LONG.strip()}"),
    ],
)
def test_names_of_wrappers_and_unmarked_blocks(page, want):
    assert html_text.main_text(page) == want


def test_window_sums_decide_in_a_marked_article():
    links = "".join(f'<li><a href="/{x}">{x} and more</a></li>' for x in ("Home", "News", "Sport", "Weather"))
    page = f'<article><h1>Title</h1><p>{LONG}</p><p><a href="x">one link alone</a></p><p>{LONG}</p><ul>{links}</ul></article>'
    want = "\n".join(["Title", LONG.strip(), "one link alone", LONG.strip()])
    assert html_text.main_text(page) == want
    between = page.replace("</article>", f"<p>{LONG}</p></article>")
    assert html_text.main_text(between) == f"{want}\n{LONG.strip()}"
    assert "Weather and more" in html_text.main_text(between, window=9)  # a wide window spans the links


@pytest.mark.parametrize("piece", ["<a '", '<a b="', "<a b='x>\"", "<div>", "</p>", "<p><b>", "<!--", "<b><p>x", "<nav>", "<a>x", "<", "&amp", "<x y=' ", '<a b="x">', "<article><nav>", "<li>a<script>", "= '\"<i ", '<div class="sidebar">x'])
def test_malformed_markup_takes_linear_time(piece):
    page = piece * ((1 << 20) // len(piece))
    start = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - start < 5
    html_text.main_text(f"<p>{page}")


class Reader(HTMLParser):
    """Blocks of the article of a page in the tables' own form, read by the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.inside = [[]], False

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "br"):
            self.blocks.append([])
        self.inside |= tag == "article"

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.blocks.append([])
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1].append(data)


def test_pages_as_an_independent_reader_has_them(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    exact = bare = 0
    for r in rows:
        reader = Reader()
        reader.feed(r["html"])
        want = "\n".join(x for x in (" ".join("".join(b).split()) for b in reader.blocks) if x)
        exact += html_text.main_text(r["html"]) == want
        # the same page without any tag that tells its parts
        plain = r["html"].replace("<article", "<div").replace("</article", "</div").replace("<nav", "<div").replace("</nav", "</div")
        found = html_text.main_text(plain)
        bare += found == want
    assert exact == len(rows)
    assert bare >= 0.95 * len(rows)


def test_rows(spark):
    rows = [(1, "u", f"<p>{LONG}", "x"), (1, "u", f"<p>{LONG}", "x"), (None, None, None, None), (2, "v", "", "y")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(frame)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    text = LONG.strip()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, "u", text, len(text))] * 2 + [(None, None, "", 0), (2, "v", "", 0)]))
    assert html_text.extract(frame.limit(0)).count() == 0
