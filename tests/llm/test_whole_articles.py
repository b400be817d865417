"""Parts of an article that look like surroundings stay; surroundings with much text go."""

import pytest

from hourgrid.llm.html_main import extract_main_text, main_text, parse

PROSE = "A sentence that says something about the subject at hand, and says it at some length. "
LONG = PROSE * 8


def text(page):
    return main_text(parse(page)).split("\n")


@pytest.mark.parametrize("part", ['<section class="related-work">', '<div class="alert">', '<section id="search-algorithms">', '<section class="social-history">', '<div class="box header">', '<section class="notices">'])
def test_parts_of_an_article_with_prose_stay(part):
    close = f"</{part[1:].split()[0]}>"
    page = f"<body><article><p>{LONG}</p>{part}<p>{LONG}</p>{close}</article></body>"
    assert text(page) == [LONG.strip()] * 2
    links = f"<body><article><p>{LONG}</p>{part}<ul>" + f"<li><a href=/x>{PROSE}</a>" * 8 + f"</ul>{close}</article></body>"
    assert text(links) == [LONG.strip()]


@pytest.mark.parametrize("name", ["comments", "comment-list", "ad", "sponsored-box", "cookie_notice", "newsletter", "side-menu"])
def test_surroundings_with_prose_go(name):
    page = f"<body><article><p>{LONG}</p><div class={name}><p>{LONG}</p></div></article></body>"
    assert text(page) == [LONG.strip()]


def test_bare_words_outside_an_article_go_and_topics_stay():
    page = f"<body><div class=story><p>{LONG}</p><div class=social-history><p>{LONG}</p></div><div class=related><p>{LONG}</p></div></div></body>"
    assert text(page) == [LONG.strip()] * 2


def test_headers_of_articles_stay_and_of_pages_go():
    page = f"<body><header><h1>Site</h1><p>{LONG}</p></header><article><header><h1>Title</h1><p>lead</p><nav>n</nav></header><p>{LONG}</p><footer>f</footer></article></body>"
    assert text(page) == ["Title", "lead", LONG.strip()]


def test_a_short_lead_or_heading_stays_with_its_body():
    lead = "Forty characters of a lead, more or less."
    for head, want in ((f"<div class=lead><p>{lead}</p></div>", lead), ("<div class=head><h1>Ten signs.</h1></div>", "Ten signs.")):
        page = f"<body><div id=menu><a href=/>m</a></div><div id=content>{head}<div class=body><p>{LONG * 2}</p></div></div><div>tail</div></body>"
        assert text(page) == [want, (LONG * 2).strip()]
    # What a wrapper adds in links isn't the article's.
    page = f"<body><div id=all><div class=top><a href=/>{PROSE}</a> a few words</div><div class=body><p>{LONG * 9}</p></div></div></body>"
    assert text(page) == [(LONG * 9).strip()]


def test_a_hosts_path_that_lacks_text_of_a_page_is_not_used(spark):
    """Most pages of the host have one section; a page of two halves keeps both."""
    usual = f"<body><div class=wrap><section class=s><p>{LONG}</p></section></div></body>"
    halves = f"<body><div class=wrap><section class=s><p>{LONG}</p></section><section class=t><p>{LONG[:-20]}</p></section></div></body>"
    pages = [(i, "https://h.example/x", halves if i == 7 else usual) for i in range(20)]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[0] == LONG.strip() and got[7] == f"{LONG.strip()}\n{LONG[:-20].strip()}"


def test_identical_repeated_rows(spark):
    rows = [(1, "https://h.example/x", f"<article><p>{LONG}</p></article>")] * 3
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 3 and {r.text for r in got} == {LONG.strip()}
