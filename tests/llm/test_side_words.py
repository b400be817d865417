"""Which words in class and id mark the surroundings of an article."""

from hourgrid.llm.html_main import main_text, parse


def test_words_that_only_begin_like_side_words_stay():
    page = "<body><article><h2 id=related-work>Related</h2><p id=search>search text</p><div class=footnotes>notes</div><section class=football-report>report</section><div id=navy-history>ships</div><div class=promontory>cliff</div></article></body>"
    assert main_text(parse(page)).split("\n") == ["Related", "search text", "notes", "report", "ships", "cliff"]


def test_surroundings_still_go():
    page = "<body><article><p>kept</p><div class=site-footer>f</div><div id=navbar>n</div><div class=promo-box>p</div><div class='sponsored'>s</div><div class=menu>m</div><p class=advertisement>a</p></article></body>"
    assert main_text(parse(page)) == "kept"
