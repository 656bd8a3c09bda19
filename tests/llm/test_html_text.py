import html
import re

import numpy as np

from scholium.llm import html_samples, html_text

TREE = html_text.trained()


def plain(page):
    """The article of the test pages, by its known layout."""
    m = re.search(r"<article>(.*?)</article>", page, re.S)
    parts = re.split(r"</?(?:p|h1)>", m[1])
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts)
    return "\n\n".join(t for t in texts if t)


def test_query_extracts_the_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = html_text.op5_html_extraction(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == plain(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_held_out_samples():
    """Leave one labelled page out: most of its words are told rightly."""
    right = total = 0
    rows = [html_text.blocks(p) for p in html_samples.PAGES]
    for i, held in enumerate(rows):
        rest = [r for j, r in enumerate(rows) if j != i]
        tree = html_text.grow(np.concatenate([html_text.features(r) for r in rest]), np.array([b.label == 1 for r in rest for b in r], float))
        for b, x in zip(held, html_text.features(held).tolist()):
            total += b.words
            right += b.words * ((html_text.decide(tree, x) >= 0.5) == (b.label == 1))
    assert right / total > 0.9


def test_marked_surroundings_go():
    text = "Water levels rose again in the night and the old mill had to close its doors. " * 3
    side = "".join(f'<div class="{c}"><p>{text}</p></div>' for c in ("sidebar", "cookie-notice", "comments", "advert"))
    page = f"<body><header><p>{text}</p></header><form><p>{text}</p></form>{side}<article><h1>Mill</h1><p>{text}</p><p>Shut.</p></article><aside>{text}</aside><footer>{text}</footer><script>var a='<p>{text}</p>'</script></body>"
    assert html_text.main_text(page, TREE) == f"Mill\n\n{text.strip()}\n\nShut."


def test_markup_and_edges(spark):
    cases = {"": "", "<": "", "<script>x": "", "<article><p>&nbsp;Hi&#33; a\n b &lt;i&gt;</p><p>x": "Hi! a b <i>\n\nx", "<article><p title='a>b'>One <b>two</b><br>three</p><!-- <p>no</p> --></article": "One two three"}
    for page, text in cases.items():
        assert html_text.main_text(page, TREE) == text
    rows = [(1, "u", None, 5), (None, None, "<article><p>A b.</p></article>", 6), (1, "u", "", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.extract(pages).collect()) == [(0, "A b.", 4), (1, "", 0), (1, "", 0)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_long_page():
    assert html_text.main_text("<article>" + "<p>word " * 50_000, TREE).count("word") == 50_000
    assert html_text.main_text("<div>" * 20_000 + "<article><p>deep inside</p>", TREE) == "deep inside"


TEXT = "Water levels rose again in the night and the old mill had to close its doors. " * 3
ARTICLE = f"<article><h1>Mill</h1><p>{TEXT}</p><p>Shut.</p></article>"
WANTED = f"Mill\n\n{TEXT.strip()}\n\nShut."


def test_layout_classes_name_nothing():
    """Classes of the whole page or of a state leave the article; comments within it and related pages go."""
    for start in ("<body class='single has-sidebar'>", "<body class='sidebar'>", "<body><div class='header-fixed'>", "<body><div id='page' class='search-enabled'>", "<body><div class='search'>", "<body><form>"):
        assert html_text.main_text(start + ARTICLE + f"<aside>{TEXT}</aside>", TREE) == WANTED, start
    assert html_text.main_text("<body>" + ARTICLE.replace("<article", "<article class='post comments-open'"), TREE) == WANTED
    assert html_text.main_text(f"<body class='has-sidebar'><div class='menu'><main><p>{TEXT}</p></main></div>", TREE) == TEXT.strip()
    for held in ("<div class='comments'>", "<div class='related'>", "<aside>", "<div hidden>"):
        assert html_text.main_text(f"<body>{ARTICLE}{held}<article><p>{TEXT}</p></article>", TREE) == WANTED, held


def test_left_out_ends():
    """An unclosed head, select, button or object does not drop the rest."""
    for start in ("<html><head><title>T</title><body>", "<html><head><meta charset=x><title>T</title>", "<head><style>p{}</style><link rel=x>"):
        assert html_text.main_text(start + ARTICLE, TREE) == WANTED, start
    assert html_text.main_text(f"<head><title>T</title>{TEXT}<p>{TEXT}</p>", TREE).count("mill") == 6
    for name in ("select", "button", "object", "canvas", "video"):
        page = f"<body><div><{name}>{ARTICLE}</div><p><{name}>x</{name}></p>"
        assert WANTED in html_text.main_text(page, TREE), name
        assert html_text.main_text(f"<body><div><{name}>x<p>{TEXT}</p></{name}>{ARTICLE}</div>", TREE) == WANTED, name
    assert html_text.main_text("<body>" + ARTICLE.replace("Shut.", "So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> it is."), TREE).endswith("\n\nSo x=2 it is.")
    assert html_text.main_text("<body>" + "<button>" * 20_000 + ARTICLE, TREE) == WANTED


def used(tree):
    return set() if isinstance(tree, float) else {html_text.FEATURES[tree[0]]} | used(tree[2]) | used(tree[3])


def unnamed(rng):
    """A held-out page of unnamed blocks, longer and shorter than the samples': (page, main text)."""
    say = lambda least, most: " ".join(["".join(rng.choice(list("abcdefghi"), 5)) for _ in range(rng.integers(least, most))]).capitalize() + "."
    menu = lambda: [(f'<a href="/x">{say(1, 4)}</a>', 0) for _ in range(rng.integers(3, 7))]
    body = [(say(25, 90), 1)]
    for _ in range(rng.integers(2, 6)):
        body += [(say(2, 6), 1)] * int(rng.integers(0, 2)) + [(say(25, 90), 1)]
    tag = "div" if rng.integers(2) else "p"
    blocks = [*menu(), *body, *menu(), (say(1, 4), 0)]
    return "<body>" + "".join(f'<{tag} data-main="{y}">{t}</{tag}>' for t, y in blocks) + "</body>"


def test_neighbours_tell_unnamed_blocks():
    """The tree splits on neighbours, and without them it tells fewer blocks of unnamed pages rightly."""
    neighbours = {"before_words", "before_links", "after_words", "after_links"}
    assert used(TREE) & neighbours
    rows = [html_text.blocks(p) for p in html_samples.PAGES]
    x, y = np.concatenate([html_text.features(r) for r in rows]), np.array([b.label == 1 for r in rows for b in r], float)
    blind = [i for i, f in enumerate(html_text.FEATURES) if f in neighbours]
    without = html_text.grow(np.where(np.isin(np.arange(x.shape[1]), blind), 0.0, x), y)
    right, alone, total = 0, 0, 0
    rng = np.random.default_rng(5)
    for _ in range(60):
        found = html_text.blocks(unnamed(rng))
        for b, row in zip(found, html_text.features(found).tolist()):
            total += 1
            right += (html_text.decide(TREE, row) >= 0.5) == (b.label == 1)
            alone += (html_text.decide(without, row) >= 0.5) == (b.label == 1)
    assert right / total > 0.97 and right > alone


def test_article_headers_and_sections():
    page = ARTICLE.replace("<h1>Mill</h1>", "<div class='article-header'><h1>Mill</h1></div>")
    assert html_text.main_text(f"<body>{page}<div class='site-header'><p>{TEXT}</p></div>", TREE) == WANTED
    cut = ARTICLE.replace("Shut.", "Shut <![CDATA[x < 1 & <b>]]> now.")
    assert html_text.main_text(cut, TREE).endswith("Shut x < 1 & <b> now.")
    assert html_text.main_text(ARTICLE.replace("Shut.", "Shut <![CDATA[never> closed."), TREE).endswith("Shut closed.")
    assert "secret" not in html_text.main_text(f"<body><select><![CDATA[secret]]></select>{ARTICLE}", TREE)
    assert html_text.main_text("<body>" + "<![CDATA[" * 50_000 + ">" + ARTICLE, TREE) == WANTED


PARAGRAPHS = [" ".join(f"word{i}{j}" for j in range(30)) + "." for i in range(6)]


def page_in(opening, closing, inner=""):
    menu = "<nav><a href=a>Home</a> <a href=b>About</a></nav>"
    return f"<html><body>{opening}{menu}<h1>A heading of some words</h1>{inner}{''.join(f'<p>{p}</p>' for p in PARAGRAPHS)}<div class=footer><p>Copyright by all of us</p></div>{closing}</body></html>"


def test_pages_within_forms_and_named_wrappers_stay():
    tree = html_text.trained()
    for opening, closing in (("<form id='aspnetForm' method=post>", "</form>"), ("<form id=form1><div class=content>", "</div></form>"), ("<div class='login-page'>", "</div>"), ("<div id='form-container'>", "</div>")):
        text = html_text.main_text(page_in(opening, closing), tree)
        assert all(p in text for p in PARAGRAPHS) and "Home" not in text and "Copyright" not in text, opening
    reply = " ".join(["thanks for this fine and long text"] * 60)
    talk = html_text.main_text(page_in("", "", f"<div class=comments><p>{reply}</p></div>"), tree)
    assert all(p in talk for p in PARAGRAPHS) and "thanks" not in talk


def test_only_the_attribute_hides():
    tree = html_text.trained()
    for tag in ("<article title='the hidden valley'>", "<article aria-label='our hidden harbour'>", "<article data-hidden=x data-note='display: none'>", "<article title=\"a > hidden\">"):
        assert all(p in html_text.main_text(page_in(tag, "</article>"), tree) for p in PARAGRAPHS), tag
    for tag in ("<div hidden>", "<div HIDDEN=''>", "<div style='color:red; display : none'>", "<div class=content hidden>"):
        assert PARAGRAPHS[0] not in html_text.main_text(page_in(tag, "</div>"), tree), tag


def test_deep_nesting_and_stray_ends_cost_in_proportion():
    import time

    tree = html_text.trained()
    took = []
    for n in (20_000, 100_000):
        began = time.process_time()
        assert html_text.main_text("<div>" * n + "<p>x</p></section>" * n + "<annotation>" * n, tree) is not None
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 1
