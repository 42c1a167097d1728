"""Wrapper induction: alignment against brute force, what wrappers decide, what words may not, and odd pages."""

import random
import time

import pytest

from regimelake.llm import html_extraction as H

PAGES = "page_id long, url string, html string"


def _texts(spark, rows, schema=PAGES, **more):
    return {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, schema), **more).collect()}


def _tree(rng, depth=0, repeat=False):
    """A random tree of named nodes; names of siblings come in one order, each once or up to three times."""
    names = [n for n in "abcd" if rng.random() < 0.6 for _ in range(rng.randint(1, 3) if repeat else 1)] if depth < 3 else []
    if not repeat:
        return [(n, _tree(rng, depth + 1)) for n in names]
    # Records of one name have the same parts, as rows of a list do.
    parts = {n: _tree(rng, depth + 1, True) for n in set(names)}
    return [(n, parts[n]) for n in names]


def _matching(a, b):
    """Simple tree matching: the most node pairs that keep parents and the order of siblings (dynamic programming over siblings)."""
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, (x, xs) in enumerate(a, 1):
        for j, (y, ys) in enumerate(b, 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + (1 + _matching(xs, ys) if x == y else 0))
    return m[-1][-1]


def _html(tree):
    return "".join(f"<div class={n}>t{_html(sub)}</div>" for n, sub in tree)


@pytest.mark.parametrize("repeat", [False, True])
def test_slots_align_as_simple_tree_matching(repeat):
    rng = random.Random(8)
    seen = 0
    for _ in range(60):
        a, b = _tree(rng, 0, repeat), _tree(rng, 0, repeat)
        slots = [[x.slot for x in H.blocks(H.parse(_html(t)))] for t in (a, b)]
        assert all(len(s) == len(set(s)) for s in slots)
        assert len(set(slots[0]) & set(slots[1])) == _matching(a, b)
        seen += max(map(len, slots))
    assert seen > 600


def _word(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))


def test_wrapper_finds_content_without_any_word(spark):
    """No name says what is what: menus and notices rotate, the content's root is where texts differ, and what all pages share goes."""
    rng = random.Random(1)
    pool = [_word(rng, 6) for _ in range(4)]
    rows, want = [], {}
    for i in range(120):
        body = [_word(rng, 30) for _ in range(rng.randint(2, 5))]
        shared = "<div>Printed on our own press</div>"
        rows.append((i, f"http://h{i % 2}/x", f"<body><div><div>{pool[i % 4]}</div><div>{pool[(i + 1) % 4]}</div></div><div><h1>{_word(rng, 3)}{i}</h1>{shared}{''.join(f'<p>{t}</p>' for t in body)}</div><div>(c) h{i % 2}: {pool[i % 3]}</div>"))
        title = rows[-1][2].split("<h1>")[1].split("</h1>")[0]
        want[i] = "\n".join([title, *body])
    assert _texts(spark, rows) == want == _texts(spark, rows, marks=False)
    # Without a wrapper the same page keeps its menus and its press.
    assert H.extract(rows[0][2]) != want[0] and "own press" in H.extract(rows[0][2])


def test_recurring_content_stays(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for i in range(40):
        text = _word(rng, 25)
        cells = ["Safe:", ["Yes", "No"][i % 2], "Size:", ["small", "medium", "large"][i % 3]]
        rows.append((i, "http://h/x", f"<nav>Menu</nav><article><p>{text}</p><table><tr>{''.join(f'<td>{c}</td>' for c in cells)}</table><p>Amen.</p></article>"))
        want[i] = "\n".join([text, *cells, "Amen."])
    assert _texts(spark, rows) == want


def test_copies_and_near_copies_stay_whole(spark):
    rng = random.Random(6)
    body = [_word(rng, 40) for _ in range(6)]
    rows = [(i, "http://h/x", "<div><p>Menu</p></div><div>" + "".join(f"<p>{t}</p>" for t in (body if i < 3 else [*body[:5], f"end {i}"])) + "</div>") for i in range(5)]
    got = _texts(spark, rows)
    assert all(body[0] in t and body[4] in t for t in got.values())


PAGE = "<nav>Menu</nav><article><h1>Title</h1><p>Body text of this page.</p></article><footer>Foot</footer>"


@pytest.mark.parametrize("page", [
    f'<body class="single-post has-sidebar">{PAGE}', f'<body class="comments-open">{PAGE}', f"<body><form action=/x>{PAGE}</form>",
    '<body><nav>Menu</nav><div class="post share-enabled"><h1>Title</h1><p>Body text of this page.</p></div><footer>Foot</footer>',
    '<body><div class="sidebar-left">' + PAGE + "</div>", '<div class="menu"><main><h1>Title</h1><p>Body text of this page.</p></main></div>',
    '<body><p>Junk above</p><div role="main"><h1>Title</h1><p>Body text of this page.</p></div><p>Junk below</p>',
    f'<body>{PAGE}<article class="comment"><p>First!</p></article><div id="comments"><p>Nice</p><div class="reply">Yes</div></div>',
    '<body><article><h1>Title</h1><p>Body text of this page.</p><ol class="comment-list"><li id="comment-12" class="comment">No</ol></article>',
])
@pytest.mark.parametrize("pages", [1, 6])
def test_words_of_the_whole_page_rule_nothing_out(spark, page, pages):
    rows = [(i, "http://h/x", page.replace("Body", f"Body {i * 7919}").replace("Title", f"Title {i * 31}")) for i in range(pages)]
    assert _texts(spark, rows) == {i: f"Title {i * 31}\nBody {i * 7919} text of this page." for i in range(pages)}


def test_parts_whose_names_only_sound_like_menus_stay():
    page = '<article><h1>T</h1><section id="related-work"><h2 id="menu">Menus of 1920</h2><p>They were long.</p></section><section class="comments-policy">Rules</section></article>'
    assert H.extract(page) == "T\nMenus of 1920\nThey were long.\nRules"


def test_doubtful_parts_are_content_where_they_vary(spark):
    rows = [(i, "http://h/x", f"<body><div class=alert>All must read this</div><article><header><h1>Title {i * 7919}</h1></header><div class=notice>Note {i * 31} of it</div><div class=banner>Read on</div><p>Text {i * 104729}</p></article>") for i in range(30)]
    assert _texts(spark, rows) == {i: f"Title {i * 7919}\nNote {i * 31} of it\nText {i * 104729}" for i in range(30)}
    # One page tells nothing: the words decide.
    assert _texts(spark, rows[:1]) == {0: "Title 0\nText 0"}


def test_hot_host_by_shuffle_equals_broadcast(spark):
    rng = random.Random(9)
    rows = [(i, f"http://{'hot' if i % 5 else f'h{i % 7}'}/x", f"<div>menu</div><div><h1>{i}</h1><p>{_word(rng, 12)}</p></div>") for i in range(200)]
    assert _texts(spark, rows) == _texts(spark, rows, broadcast_bytes=0)
    w = {r.host: r for r in H.wrappers(spark.createDataFrame(rows, PAGES)).collect()}
    again = {r.host: r for r in H.wrappers(spark.createDataFrame(rows[::-1], PAGES).repartition(5)).collect()}
    assert w == again and w["hot"].n == 160 and len(w["hot"].constant) == 1


def test_odd_pages(spark):
    deep = "<div>" * 1500 + "deep" + "</div>" * 1500
    wide = "".join(f"<p>{i}</p>" for i in range(5000))
    rows = [(1, "http://h/1", deep), (2, "http://h/2", deep), (3, "http://g/1", wide), (4, "http://g/2", wide), (5, "http://q/1", 'a <a title="x>link b</a> c'), (6, None, None), (7, "x", ""), (8, "http://e/1", "<p>end<a href="), (9, "http://l/1", "<p>" + "word " * 200_000), (10, "http://c/1", "a < b <3 &lt;c&gt; <!-- gone <p> --> d <!doctype x> e <![CDATA[f]]> g")]
    got = _texts(spark, [(*r, "extra") for r in rows], PAGES + ", text string")
    assert got[3] == got[4] == "\n".join(map(str, range(5000)))
    assert (got[1], got[5], got[6], got[7], got[8], got[10]) == ("deep", "a link b c", "", "", "end", "a < b <3 <c> d e g") and len(got[9]) == 999_999


@pytest.mark.parametrize("source", ["<a " * 350_000, "<div>" * 100_000 + "</span>" * 100_000, "<div>a" * 100_000, "<b>" * 60_000 + "<p>x</p>" * 60_000, '<a title="x' * 90_000, "<script>" * 120_000, "<!--" * 250_000, "< " * 500_000, "<ul><li>a" * 60_000, "<a b='" * 150_001])
def test_a_megabyte_of_tag_soup_in_seconds(source):
    began = time.time()
    H.extract(source)
    assert time.time() - began < 15


def test_repeated_rows_and_empty_table(spark):
    assert H.main_text(spark.createDataFrame([(1, "http://h/1", "<p>x")] * 3, PAGES)).collect() == [(1, "http://h/1", "x")] * 3
    assert H.main_text(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("url", ["http://a/x", None])
def test_scripts_forms_and_comments_never_stay(spark, url):
    page = "<article><p>One<script>no()</script></p><form><input>no<button>no</button></form><style>no</style><div id=comments><p>no</p></div><p>Two</article><footer>no</footer>"
    assert _texts(spark, [(1, url, page)]) == {1: "One\nTwo"}


def test_query_over_all_pages_equals_the_articles(spark):
    """The tables' pages each have one article; its blocks, read by a plain reader, are the text."""
    import html
    import re

    d = "/root/testdata/sf0.01"
    got = {r.page_id: r.text for r in H.op10_html_extraction(spark, d).collect()}
    for r in spark.read.parquet(f"{d}/pages.parquet").collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        parts = re.split("</?(?:p|h1)>", re.sub("</?b>", "", inner).replace("<br>", " "))
        assert got[r.page_id] == "\n".join(filter(None, (" ".join(html.unescape(x).split()) for x in parts)))
