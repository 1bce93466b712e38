import itertools
import random

from tagweave.llm.html_main import blocks_of, extract, main_text, minimum_cut

PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style><script>var t="</p>";</script></head><body>
<div class="site-header">My site</div><nav><ul><li><a href="/">Home</a></li></ul></nav>
<article><h1>A   title</h1><p><b>First &amp; bold.<br>Second line<p>Third&nbsp;one &eacute;.</p><!-- gone -->
<form><label>Your mail</label><button>Send it</button></form></article>
<aside><p>Other stories that you may want to read today.</p></aside>
<section id="comments"><p>I liked this very much, thank you for writing it all down.</p></section>
<div class="cookie-notice"><p>We use cookies to make this page better for you.</p></div><footer>&copy; me</footer>"""


def test_main_text():
    assert main_text(PAGE) == "A title\nFirst & bold. Second line\nThird one é."
    assert main_text(None) == main_text("") == main_text("<p></p>") == ""
    assert main_text("<p>An open paragraph with several words, and no end") == "An open paragraph with several words, and no end"


PROSE = "<h1>A title</h1>" + "<p>This is a sentence of the article, and it goes on for a while.</p>" * 6
CLEAN = "\n".join(["A title", *["This is a sentence of the article, and it goes on for a while."] * 6])


def test_names_of_wrappers_do_not_empty_the_article():
    for page in (
        f"<body><div class='content has-sidebar'><article>{PROSE}</article></div></body>",
        f"<body><div id='page' class='with-header'><article>{PROSE}</article></div></body>",
        f"<body><article class='post tags-news social'>{PROSE}</article></body>",
    ):
        assert main_text(page) == CLEAN, page
    comments = "<div class='comments'><article class='comment'><p>I liked this very much, thank you for it all.</p></article></div>"
    assert main_text(f"<body><article>{PROSE}</article>{comments}</body>") == CLEAN


def test_open_elements_end_at_the_next_block():
    for tag in ("svg", "select", "object", "canvas"):
        assert main_text(f"<body><article><{tag}><g>drawn{PROSE}</article></body>") == CLEAN, tag
    assert main_text("<article><p>We know that <math><mi>x</mi></math> is larger than that, in any case.</p></article>") == (
        "We know that x is larger than that, in any case."
    )


def test_long_and_broken_pages():
    long = "<article>" + "<p>A sentence of the article, which is long.</p>" * 3000 + "</article>"
    assert main_text(long).count("\n") == 2999
    deep = "<div>" * 3000 + "<p>Deep inside there is some text to read.</p>"
    assert "Deep inside" in main_text(deep)
    assert blocks_of("</p></div><p>x</b></i>y</p>&bogus; <")[0].text == "xy"


def test_cut_is_minimal():
    random.seed(3)
    for _ in range(60):
        n = random.randint(1, 8)
        score = [round(random.uniform(-3, 3), 2) for _ in range(n)]
        edges = [(a, b, round(random.uniform(0, 2), 2)) for a, b in itertools.combinations(range(n), 2) if random.random() < 0.5]

        def cost(kept):
            own = sum(max(0, s) if not k else max(0, -s) for s, k in zip(score, kept))
            return own + sum(c for a, b, c in edges if kept[a] != kept[b])

        best = min(cost(k) for k in itertools.product((False, True), repeat=n))
        assert abs(cost(minimum_cut(score, edges)) - best) < 1e-9


def test_extract(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (1, "u", PAGE)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id BIGINT, url STRING, html STRING, text STRING")
    got = extract(pages).orderBy("page_id").collect()
    assert [(r["page_id"], r["n_chars"]) for r in got] == [(1, len(got[0]["text"]))] * 2 + [(2, 0), (3, 0)]
    assert extract(pages.limit(0)).collect() == []
