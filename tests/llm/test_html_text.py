import random
import time

import pytest

from fieldloom.llm import html_text as H
from fieldloom.llm.html_text import main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">Home</a></li></ul></nav><div class="ad">Buy now, cheap.</div>
<article><h1>Title &amp; more</h1><p><b>First,   one.<br><p>Second
line &lt;here&gt;.</p></article>
<div id="comments"><p>Nice article, really, thank you, friend, so long and so good.</p></div>
<footer>&copy; 2024</footer></body></html>"""


def test_article():
    assert main_text(PAGE) == "Title & more\nFirst, one.\nSecond line <here>."


def test_short_article_beats_long_surroundings():
    page = "<body><nav>" + "<a href=x>menu, item, text</a> " * 30 + "</nav><article><h1>A</h1><p>B.</p></article><footer>" + "long, text " * 40 + "</footer></body>"
    assert main_text(page) == "A\nB."


def test_without_article_element():
    page = '<body><div class="menu"><a href=a>a</a></div><div id=wrap><h1>Head</h1><div class=post><p>' + "Some words, and more, " * 9 + "</p><p>End, of it all.</p></div><aside>Beside</aside></div><form>Name <input></form></body>"
    assert main_text(page).split("\n")[0] == "Head" and main_text(page).endswith("\nEnd, of it all.")
    assert "Beside" not in main_text(page) and "Name" not in main_text(page)


def test_siblings():
    part = lambda k: f"<div><p>{'word, ' * 30}{k}</p><p>{'again, ' * 30}{k}</p></div>"
    assert [x[-1] for x in main_text(f"<body><div>{part(1)}{part(2)}<div class=share>x</div></div></body>").split("\n")] == ["1", "1", "2", "2"]


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<p></p>") == ""
    assert main_text("<article><p>cut off &amp") == "cut off &"
    assert main_text("<article><p>a<script>1</p></article>") == "a"
    assert main_text('<article><p title="a>b">x</p><p title="open>y</p></article>').startswith("x")
    start = time.time()
    main_text("<p>" * 50000)
    main_text("<div class='" * 20000)
    main_text("<article>" + "<b>" * 20000 + "text")
    assert time.time() - start < 10


def test_table(spark):
    from fieldloom.llm import html_text

    df = spark.createDataFrame([(1, "u", PAGE, "z"), (2, None, None, "z"), (None, "u", "", "z")], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.url, r.n_chars) for r in html_text.extract(df).collect()}
    assert got == {1: ("u", 44), 2: (None, 0), None: ("u", 0)}
    assert html_text.extract(df.limit(0)).count() == 0


WORDS = "<p>" + "Some words, and more words here to read, with commas, and so on. " * 3 + "</p>"


@pytest.mark.parametrize("name", ["content has-sidebar", "layout no-sidebar", "post with-comments", "page-header-image post", "cookie-recipes article", "social-science post", "menu-planning post"])
def test_names_about_something_else_cut_nothing(name):
    page = f'<body><nav><a href=x>menu</a></nav><div class="{name}"><h1>T</h1>{WORDS}{WORDS}</div><div class="sidebar">Beside, it</div></body>'
    assert main_text(page) == main_text(f"<h1>T</h1>{WORDS}{WORDS}") and len(main_text(page)) > 350


def test_suspects_around_the_article_are_cleared_and_others_are_not():
    want = main_text(f"<h1>T</h1>{WORDS}")
    inner = f"<h1>T</h1>{WORDS}"
    for page in (
        f'<div class="wrap sidebar"><article>{inner}</article></div>', f"<form id=whole><div>{inner}</div></form>", f'<div class="site sidebar-right"><div>{inner}</div></div><div><p>Short, one.</p></div>',
        f'<article>{inner}<div class="share">Share, this</div></article><div class="comments">{WORDS * 4}</div>', f'<div class="post">{inner}</div><section id="comment-list"><article class="comment">{WORDS * 4}</article></section>',
        f'<div class="post">{inner}</div><aside>{WORDS * 3}</aside><div class="cookie-notice">{WORDS * 3}</div><div class="Sidebar_root__x7">{WORDS * 3}</div>',
        f'<nav><ul><li>never closed<main>{inner}</main>', f'<div class="ad">never closed<article>{inner}</article>',
    ):
        assert main_text(page) == want, page


def test_time_is_linear_in_depth():
    start = time.time()
    main_text("<article>" + "<b>" * 300_000 + "text")
    main_text("<b>" * 100_000 + "</i>" * 100_000 + "x")
    main_text("<div>" * 100_000 + "a, b, c")
    main_text("<p><button><b>" + "<h2>" * 100_000 + "x")
    assert time.time() - start < 20


def naive(root):
    """Characters, linked characters and points of every node, each worked out by itself from its whole subtree."""

    def below(node):
        yield node
        for k in node.kids:
            if isinstance(k, H.Node) and k.state != H.CUT:
                yield from below(k)

    def same_block(node, top=True):
        for k in node.kids:
            if isinstance(k, str):
                yield node, k
            elif k.state == H.PART and k.tag not in H.BLOCK:
                yield from same_block(k, False)

    def own_chars(node):
        return len(" ".join("".join(k for k in node.kids if isinstance(k, str)).split()))

    def chars(node):
        return own_chars(node) + sum(chars(k) for k in node.kids if isinstance(k, H.Node) and k.state == H.PART)

    def linked(node):
        return chars(node) if node.tag == "a" else sum(linked(k) for k in node.kids if isinstance(k, H.Node) and k.state == H.PART)

    points = {id(n): 0.0 for n in below(root)}
    for node in below(root):
        if (node.tag in H.BLOCK or node.state or node.up is None) and node.tag not in H.HEADINGS:
            first = [k for k in node.kids if isinstance(k, str)]
            rest = "".join(first) + "".join(t for n, t in same_block(node) if n is not node)
            text = " ".join(rest.split())
            if not text:
                continue
            value = (1 + sum(text.count(c) for c in ",،、，") + min(len(text) / H.LENGTH_POINT, H.LENGTH_MOST)) * min(1, len(text) / H.FULL_LENGTH)
            value *= 1 - linked(node) / max(chars(node), 1)
            at = node.up if node.tag in ("p", "pre", "li", "td", "th", "dd", "dt", "blockquote") and not node.state and node.up.tag != "#root" else node
            for level in range(H.LEVELS):
                if at.tag == "#root":
                    break
                points[id(at)] += value * (1 if level == 0 else 1 / 2 if level == 1 else 1 / (3 * level))
                if at.state:
                    break
                at = at.up
    return {id(n): (chars(n), linked(n), points[id(n)]) for n in below(root)}


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 4)):
        tag = rng.choice("div div section p p span b a ul li article h2 blockquote aside td".split())
        name = rng.choice(["", "", "", " class=sidebar", " class='post'", " id=comments", " hidden"])
        inner = random_page(rng, depth + 1) if depth < 4 and rng.random() < 0.6 else rng.choice(["word", "a, b, c, and  more", "longer text, with commas, " * rng.randint(1, 6), ""])
        out.append(f"<{tag}{name}>{inner}</{tag}>" if rng.random() < 0.9 else f"<{tag}{name}>{inner}")
    return "".join(out)


def test_scores_equal_a_naive_scorer():
    rng = random.Random(4)
    for k in range(300):
        root = H.tree(PAGE if k == 0 else random_page(rng))
        order = H.measure(root)
        want = naive(root)
        for node in order:
            got = (node.chars, node.linked, node.score)
            # white space between a block's parts may be counted apart: characters are sums over elements in both
            assert got == pytest.approx(want[id(node)], rel=1e-9, abs=1e-9), (k, node.tag)


def test_rows_that_repeat_an_id(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (1, None, "<p>x")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.n_chars) for r in H.extract(df).collect()) == [(1, 1), (1, 44), (1, 44)]


def test_articles_side_by_side_are_one_text():
    page = f"<main><article><h1>A</h1>{WORDS}</article><article><h1>B</h1>{WORDS}</article><article class=teaser><h3><a href=x>Other story</a></h3><p>Short.</p></article><article class=comment>{WORDS}</article></main>"
    text = main_text(WORDS)
    assert main_text(page) == f"A\n{text}\nB\n{text}"


PROSE = "<p>" + "Break the chocolate, mix it well with butter and sugar, then bake. " * 3 + "</p>"


@pytest.mark.parametrize(("name", "stays"), [("chocolate-cookies", True), ("recipe-banner-cookies", True), ("reader-comments", False), ("comment-list", False), ("cookie-notice", False), ("newsletter", False)])
def test_names_that_may_mean_their_subject_cut_only_what_is_short_or_of_links_inside_an_article(name, stays):
    page = lambda inner: f'<article><h1>T</h1>{WORDS}<section class="{name}">{inner}</section>{WORDS}</article>'
    assert ("Break the chocolate" in main_text(page(PROSE))) == stays
    for inner in ("<p>Short.</p>", "<p>" + "<a href=x>a link with text, and more</a> " * 8 + "</p>"):
        assert main_text(page(inner)).count("\n") == 2
    assert "Break" not in main_text(f'<div class="{name}">{PROSE}</div><article>{WORDS}{WORDS}</article>')


LINKS = "<ul><li><a href=a>First report of it</a></li><li><a href=b>Second</a></li></ul>"


def test_lists_of_links_are_menus_unless_the_text_leads_to_them():
    for page, stays in (
        (f"<article>{WORDS}<h2>Sources</h2>{LINKS}</article>", True), (f"<article>{WORDS}<p>See, among others:</p>{LINKS}</article>", True),
        (f"<article>{WORDS}{LINKS}</article>", False), (f"<article>{WORDS}{LINKS.replace('Second', 'The second report, with a long title')}</article>", True),
        (f"<article>{LINKS}{WORDS}</article>", False), (f"<article>{WORDS}<h3>Related</h3>{LINKS}</article>", False),
        (f"<article>{WORDS}<div><a href=x>all</a></div>{LINKS}</article>", False),
    ):
        assert ("First report of it" in main_text(page)) == stays, page


def test_short_parts_beside_the_best_stay_where_nothing_is_of_links():
    inner = f"<div>{'Long text, with many words. ' * 20}</div><div><p>Short tail of the article.</p></div><table><tr><td>row</td></tr></table>"
    assert main_text(f"<body><nav><a href=x>menu</a></nav><div id=c>{inner}</div></body>").split("\n")[1:] == ["Short tail of the article.", "row"]
    assert "links" not in main_text(f"<div id=c>{inner}<div>{'<a href=x>links</a> ' * 9}</div></div>")
