"""Pages of any form: linear time, div-only layouts, two layouts on a host, votes recomputed."""

import time
from collections import Counter, defaultdict

import pytest

from hourgrid.llm import html_main
from hourgrid.llm.html_main import best_of, containers, extract_main_text, main_text, parse, path_key

ODD = {
    "unclosed tags": "<a " * 300_000, "nested": '<div class="a">' * 70_000, "stray ends": "<b><u>" * 1000 + "</i>" * 250_000, "paragraph in a table": "<p><table><td>" + "<div>" * 150_000,
    "lists": "<ul>" + "<li>x" * 150_000, "signs": "<" * 1_000_000, "open quotes": '<a "' * 250_000, "mixed quotes": "<a '\"" * 200_000, "comments": "<!-" * 300_000 + "<!--" * 10, "terms": "<dl>" + "<i>" * 100 + "<dd>x" * 100_000,
}


@pytest.mark.parametrize("name", ODD)
def test_a_megabyte_takes_seconds(name):
    began = time.process_time()
    root = parse(ODD[name])
    main_text(root, "html>body")
    best_of(containers(root))
    assert time.process_time() - began < 30


def test_tags_and_text():
    assert main_text(parse("<body><p>1 < 2 and <3 <b>bold</b <i>it</i> <p>two<br/>lines")) == "1 < 2 and <3 boldit\ntwo lines"
    assert main_text(parse("<body><a href=/x/>link</a> text <span/>open<p/>para")) == "link text open\npara"
    assert main_text(parse("<ul><li>one<ul><li>in</ul><li>two</ul><table><tr><td><p>a<td>b<tr><td>c</table>")).split("\n") == ["one", "in", "two", "a", "b", "c"]


def test_paths_have_keys():
    root = parse("<html><body><div class='x y3'><p>some text</p></div></body></html>")
    node = containers(root)[-1].node
    assert node.path == "html>body>div.x.y#" and path_key(node.path) == node.key and path_key("") == root.key


LEAD, BODY = "A lead that says in a hundred characters what the article is about, and why it matters to its readers. ", "A long body of running text. " * 40


def page(layout, extra=""):
    inner = f"<div class=lead><p>{LEAD}</p></div><div class=body><p>{BODY}</p></div>" if layout else f"<section class=story><p>{LEAD}</p><p>{BODY}</p></section>"
    return f"<html><body><div class=menu><a href=/>home</a></div><div id=main-{layout}>{inner}</div><div class=tail>short tail</div>{extra}</body></html>"


def test_unlike_parts_of_an_article_stay_together(spark):
    want = f"{LEAD.strip()}\n{BODY.strip()}"
    pages = [(i, "https://one.example/a", page(i % 3 != 0)) for i in range(30)]
    got = extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == 30 and {r.text for r in got} == {want}


def test_votes_match_a_plain_count(spark):
    htmls = [page(0), page(1), page(1), "<body><article class=p1><p>" + BODY + "</article>", "<body><article class=p22><p>" + BODY + "<p>x</article>", ""]
    pages = [(i, f"https://h{i % 4 % 3}.example/{i}", htmls[i % 6]) for i in range(48)]
    votes = defaultdict(Counter)
    for _, url, html in pages:
        host = url.split("/")[2]
        all_ = containers(parse(html))
        good = sorted((c for c in all_ if c.score > 0), key=lambda c: -c.score)[:3]
        own = {c.node.path: round(1000 * c.score / good[0].score) for c in good}
        if good:
            own[best_of(all_).node.path] = 1000
        votes[host].update(own)
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for r in extract_main_text(df).collect():
        winner = min(votes[r.url.split("/")[2]].items(), key=lambda v: (-v[1], v[0]))[0]
        assert r.path == winner and r.text == main_text(parse(r.html), winner)


def test_side_parts_are_left_out_of_the_widened_container():
    extra = "<div class=comments><p>" + "A reader says a lot of things here. " * 50 + "</p></div><footer><p>" + "legal text " * 90 + "</p></footer>"
    assert main_text(parse(page(1, extra))) == f"{LEAD.strip()}\n{BODY.strip()}"
    assert html_main.main_text(parse("")) == ""
