import html
import re

import pytest
from conftest_data import MEDIUM
from kickpool.llm import boosting, extraction
from kickpool.llm.common import table
from kickpool.llm.html_training import Composer, parts_of
from kickpool.llm.html_tree import features, joined, read
from kickpool.llm.queries import QUERIES

PAGE = """<!doctype html><html><head><title>t</title><script>var a = "<p>no</p>";</script></head><body>
<div id="cookie-banner"><p>We use cookies to improve your experience on our site.</p><button>Accept</button></div>
<header><a href="/">Site</a><p>Tag line of the site</p></header>
<div class="menu"><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></div>
<div class="layout"><div class="sidebar"><h3>Related</h3><ul><li><a href="/1">Something else to read</a></li></ul></div>
<div class="post-body"><h1>Title of it</h1><p>First paragraph, with   some words
and a <a href="/x">li</a>nk. It goes on for a while, as paragraphs do.</p>
<div class="advert">Buy now! Great offers for you.</div>
<p>Second paragraph &amp; more text. It goes on too, as they do.<ul><li>one item of text</li><li>two items</li></ul>
</div></div>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I like this very much, thank you for it.</p></div></section>
<form action="/s"><input name=q><label>Search here</label></form><footer>&copy; 2024 Site. All rights reserved.</footer>
</body></html>"""
MAIN = (
    "Title of it First paragraph, with some words and a link. It goes on for a while, as paragraphs do. "
    "Second paragraph & more text. It goes on too, as they do. one item of text two items"
)


def article_of(page):
    """The given pages mark their article; its text by plain expressions."""
    inner = page[page.index("<article>") + 9 :]
    inner = inner[: inner.index("</article>")] if "</article>" in inner else inner[: inner.index("<footer>")]
    inner = re.sub(r"</?(b|i|a|em)\b[^>]*>", "", inner)
    return " ".join(html.unescape(re.sub(r"<[^>]+>", " ", inner)).split())


def test_given_pages(spark):
    rows = QUERIES["op8_extraction"](spark, MEDIUM).join(table(spark, MEDIUM, "pages").select("page_id", "html"), "page_id").collect()
    assert len(rows) == table(spark, MEDIUM, "pages").count()
    right = sum(r.text == article_of(r.html) for r in rows)
    assert right >= 0.98 * len(rows)
    assert all(r.n_chars == len(r.text) for r in rows)


def test_other_layouts(spark):
    pages = [r.html for r in table(spark, MEDIUM, "pages").orderBy("page_id").collect()]
    model = extraction.train_on(pages[:80])
    assert model.extract([PAGE]) == [MAIN]
    told = [p for p in map(parts_of, pages[100:160]) if p]
    composer = Composer(77, told)
    made = [composer.page(good) for good, _ in told for _ in range(3)]
    exact = 0
    for page, text in zip(made, model.extract(made)):
        blocks, pieces = read(page, truths=True)
        exact += text == joined(pieces, [b.truth == 1 for b in blocks])
    assert exact >= 0.8 * len(made)


def test_decoding_is_the_best_whole_choice():
    import itertools
    import random

    import numpy as np

    chance = random.Random(3)
    for _ in range(60):
        blocks, _ = read("<div><p>aa aa</p><div>b<p>cc</p><p>dd dd dd</p></div></div><section>e</section>")
        logits = np.array([chance.uniform(-4, 4) for _ in blocks])
        weight = np.array([0.2 + min(b.chars, 2500) ** 0.5 / 10 for b in blocks])
        best, value = None, -1e9
        for choice in itertools.product((True, False), repeat=len(blocks) - 1):
            kept = [True, *choice]
            if all(kept[b.parent] or not k for b, k in zip(blocks[1:], choice)):
                total = sum((1 if k else -1) * x * w for k, x, w in zip(choice, logits[1:], weight[1:]))
                if total > value:
                    best, value = kept, total
        got = extraction.decode(blocks, logits)
        assert got[1:] == best[1:]


def test_boosting_learns_an_interaction():
    import numpy as np

    chance = np.random.default_rng(0)
    rows = chance.random((2000, 4))
    labels = ((rows[:, 0] > 0.5) ^ (rows[:, 1] > 0.3)).astype(float)
    trees = boosting.fit(rows, labels, np.ones(2000), trees=30, depth=3)
    new = chance.random((500, 4))
    want = (new[:, 0] > 0.5) ^ (new[:, 1] > 0.3)
    assert ((trees.logit(new) > 0) == want).mean() > 0.95


def test_odd_pages(spark):
    pages = [
        (1, None, None), (2, "u", ""), (3, "u", "<script>only</script>"), (None, None, PAGE), (4, "u", PAGE), (4, "u", PAGE),
        (5, "u", "plain text, no tags"), (6, "u", "<p>" * 3000 + "deep"), (7, "u", "<div " + "x='" * 500), (8, "u", "<article><p>" + "long text. " * 100_000),
    ]
    rows = [(*p, "t", 1) for p in pages]
    table_ = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars bigint")
    model = extraction.train_on([PAGE] * 3)
    got = extraction.main_texts(spark, table_, model).collect()
    assert len(got) == len(pages) and all(r.text is not None for r in got)
    texts = {r.page_id: r.text for r in got}
    assert texts[1] == texts[2] == texts[3] == ""
    assert texts[5] == "plain text, no tags"
    assert extraction.main_texts(spark, table_.limit(0), extraction.train(table_.limit(0))).count() == 0


def read_text(page):
    blocks, pieces = read(page)
    return joined(pieces, [True] * len(blocks))


def test_missing_end_tags_of_unread_elements():
    head = "<html><head><meta charset=utf-8><title>t</title><script>if (a<b) x = '<p>no</p>';</script><style>p{}</style>"
    for rest in ("<body><p>one</p>", "<p>one", "one", "</head>one", "<!-- c --> <body>one", "<div>one</div></body></html>"):
        assert read_text(head + rest) == "one", rest
    assert read_text("<head><title>no<body><p>one") == "one"
    assert read_text("<head><title>no") == ""
    assert read_text("<p>one<canvas>two<svg><p>three") == "onetwo three"
    assert read_text("<p>one<svg><p>no</p></svg>two") == "onetwo"
    assert read_text("<p>one<script><!-- x </script>two<script>no") == "onetwo"
    assert len(read("<head><meta a><link b></head><p>x")[0]) == 2 and read("<head><meta a></head><p>x")[0][0].tags == 0


def test_pages_without_head_end(spark):
    given = [r.html for r in table(spark, MEDIUM, "pages").orderBy("page_id").limit(60).collect()]
    cut = [p.replace("</head>", "") for p in given]
    assert cut != given and [read_text(p) for p in cut] == [read_text(p) for p in given]


def test_no_markup_in_texts():
    for page, text in {
        '<p>One <a href="x"">two</a> three': "One two three",
        "<p>a<!-->b<!--->c<!-- x --!>d<!-- <p> -->e": "abcde",
        '<p title=">" data-a=\'"\'>c<p x="1" y=">>">d': "c d",
        "<p>1 < 2 and <b>x</b> </ >y</p>": "1 < 2 and x y",
        '<p>it\'s "quoted" <i class=a\'b>text</i> \'here\'': "it's \"quoted\" text 'here'",
        "<p>end <a href='x": "end",
    }.items():
        assert read_text(page) == text, page


@pytest.mark.parametrize("unit", ["<h2>x", "<a x='1>t ", "<div>x</zz>", "<p>x", "<ul><li>x", "<li>x", "<", "<a ====>", "<svg>", "<td>x</p>"])
def test_reading_takes_linear_time(unit):
    import time

    def seconds(n):
        page, begin = unit * (n // len(unit)), time.perf_counter()
        blocks, _ = read(page)
        features(blocks)
        return time.perf_counter() - begin

    seconds(10_000)
    assert seconds(400_000) < 8 * max(seconds(100_000), 0.02)


def test_places_and_counts_of_many_siblings():
    rows = features(read("<ul>" + "<li>x" * 200 + "</ul><p>y")[0])
    items = rows[2:202]
    assert [r[12] for r in items] == [i / 200 for i in range(200)] and {r[13] for r in items} == {200} and {r[11] for r in items} == {200}


def test_only_long_pages_still_train(spark):
    given = [r.html for r in table(spark, MEDIUM, "pages").orderBy("page_id").limit(20).collect()]
    filler = "<p>" + "more of the text, and more. " * 1_500
    longer = [p.replace("</article>", filler + "</article>") if "</article>" in p else p + "<!--" + "x" * 40_000 for p in given]
    assert min(map(len, longer)) > extraction.SAMPLE_CHARS
    pages = spark.createDataFrame([(i, "u", p) for i, p in enumerate(longer)], "page_id bigint, url string, html string")
    model = extraction.train(pages)
    assert model.trees is not None and model.extract([PAGE])[0] != read_text(PAGE)


def test_comments_under_neutral_names(spark):
    pages = [r.html for r in table(spark, MEDIUM, "pages").orderBy("page_id").limit(120).collect()]
    told = [p for p in map(parts_of, pages) if p]
    paragraphs = [t for good, _ in told for t in good][:6]
    items = "".join(f"<li>{' '.join(good[0].split()[:15])}</li>" for good, _ in told[:40])
    page = "<body><article><h1>Title</h1>" + "".join(f"<p>{t}</p>" for t in paragraphs) + f"</article><ol class='c'>{items}</ol></body>"
    text = extraction.train_on(pages).extract([page])[0]
    assert text == " ".join(["Title", *(" ".join(html.unescape(t).split()) for t in paragraphs)])
