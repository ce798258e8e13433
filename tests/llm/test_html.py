import random

from cohortspark.llm import html_text as H
from cohortspark.llm.op03_html import op3_html
from tests.conftest import SMALL

WEIGHTS = H.weights_of(sum((H.counts_of(p) for p in H.SEED_PAGES), H.Counter()))
LONG = "Here is a paragraph of the article that has quite a few words in it, as paragraphs do."

PAGES = {
    None: "",
    "": "",
    "just text": "just text",
    "<p>a &amp; b &lt;i&gt; &#233;&nbsp;x</p>": "a & b <i> é x",
    "<script>var t='</p>';</script><p>x < y</p><!-- <p>no</p> -->": "x < y",
    f"<body><nav><ul><li><a href='/'>Home</a></ul></nav><article><h1>T</h1><p>{LONG}<p>End.</article><footer>c</footer>": f"T\n\n{LONG}\n\nEnd.",
    f"<header><h1>Site</h1></header><main><p>{LONG}</p><aside>side</aside><p>Of.</p></main>": f"{LONG}\n\nOf.",
    f"<div id=content><p>{LONG}</p><div class='ad-box'>Buy</div><p>{LONG}</p></div><div class=sidebar><p>{LONG}</p></div>": f"{LONG}\n\n{LONG}",
    f"<p>{LONG}<form><input name=q><p>Search</p></form><div class='comments'><article><p>{LONG}</p></article></div>": LONG,
    f"<div class='cookie-notice'>We use cookies</div><p>one<br>two <b>th</b>ree\n\n four</p><p>{LONG}</p>": f"one two three four\n\n{LONG}",
    "<p hidden>x</p><p style='display: none'>y</p><div aria-hidden=true>z</div><p>seen</p>": "seen",
    f"<div class='layout has-sidebar'><div class=article-header><h2>T</h2></div><p>{LONG}</p></div><div class=left-sidebar>x</div>": f"T\n\n{LONG}",
    "<nav><a>x</a></nav><div class=ad>Buy now</div><div id=comments><p>First!</p></div>": "",
    "<p title='a > b'>quoted</p><p>un<closed": "quoted\n\nun<closed",
}


def test_known_pages():
    for page, text in PAGES.items():
        assert H.main_text(page, WEIGHTS) == text, page


def test_containers_only_add_to_the_region():
    """Titles and leads before a nested article, and uneven articles side by side, stay whole."""
    nested = f"<main><h1>Title</h1><p>Lead.</p><article>{f'<p>{LONG}</p>' * 3}</article></main>"
    assert H.main_text(nested, WEIGHTS) == "\n\n".join(["Title", "Lead.", LONG, LONG, LONG])
    assert {b.container for b in H.blocks_of(nested)} == {0}
    for a, b in ((7, 3), (3, 7), (5, 5)):
        parts = f"<article>{f'<p>{LONG}</p>' * a}</article><article>{f'<p>{LONG}</p>' * b}<p>End.</p></article>"
        assert H.main_text(parts, WEIGHTS) == "\n\n".join([LONG] * (a + b) + ["End."])
    before = f"<p>{LONG}</p><article>{f'<p>{LONG}</p>' * 4}</article>"
    assert H.main_text(before, WEIGHTS) == "\n\n".join([LONG] * 5)


def test_region_has_the_highest_sum_of_all():
    rng = random.Random(4)
    for _ in range(200):
        blocks = [
            H.Block(tag=rng.choice(["p", "div", "li"]), words=(n := rng.randint(1, 9)), linked=rng.randint(0, n), text="x",
                    tags=[rng.choice(["p", "ul", "nav", "footer"]) for _ in range(rng.randint(0, 6))])
            for _ in range(rng.randint(0, 9))
        ]
        value = lambda a, b: sum(WEIGHTS.of(x) for x in blocks[a:b]) + sum(WEIGHTS.before(x) for x in blocks[a + 1 : b])  # noqa: B023,E731
        best = max((value(a, b) for a in range(len(blocks)) for b in range(a + 1, len(blocks) + 1)), default=0)
        a, b = H.best_region(blocks, WEIGHTS)
        got = value(a, b) if a < b else 0
        assert abs(got - best) < 1e-9


def test_signs_of_the_weights():
    assert all(w > 0 for w in WEIGHTS.word.values()) and WEIGHTS.link > 0
    assert all(w < 0 for w in WEIGHTS.tag.values())


def test_query_keeps_every_article(spark):
    """In these pages the article is the only ``article`` element; its paragraphs are plain text."""
    import html
    import re

    rows = {r["page_id"]: r for r in op3_html(spark, SMALL).collect()}
    for page in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", page["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert rows[page["page_id"]]["text"] == "\n\n".join(p for p in parts if p)
        assert rows[page["page_id"]]["n_chars"] == len(rows[page["page_id"]]["text"])


def test_empty_table_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (1, "u", "<p>a", "x")], "page_id long, url string, html string, text string")
    weights = H.fit(pages)
    assert sorted(r["text"] for r in H.extract(pages, weights).collect()) == ["", "a"]
    assert H.extract(pages.limit(0), H.fit(pages.limit(0))).count() == 0
