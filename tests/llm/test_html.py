import html as html_lib
import math
import random

import pytest
from pyspark.sql import functions as F

from evenkeel.llm import queries
from evenkeel.llm.html_text import Page, article_text, main_text, read_page

SF = "/root/testdata/sf0.001"
TEXT = "A sentence of the article that is long enough to matter, with words and more words. "


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><script>var x='</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "around",
    [
        "<nav><ul><li><a href=/a>Menu</a></li></ul></nav>{}<footer>&copy; foot</footer>",
        "<header><h2>Site</h2></header><main>{}</main><aside>side</aside>",
        '<div class="cookie-notice">We use cookies. {t}</div>{}<div id="sidebar"><p>{t}</p></div>',
        '<div class="ad">{t}</div>{}<form><label>Mail</label><input><button>Go</button></form>',
        '{}<section id="comments"><article class="comment"><p>{t}{t}{t}</p></article></section>',
        '<div class="has-sidebar wrapper">{}</div><style>p{{}}</style><noscript>no</noscript><!-- {t} -->',
        '<div role="navigation">{t}</div>{}<div hidden>{t}</div><div style="display: none">{t}</div>',
    ],
)
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_only_the_article_is_left(around, tag):
    if tag == "main" and "<main>" in around:
        return
    inner = f"<{tag}><h1>Head &amp; line</h1><p>{TEXT * 3}</p><ul><li>One</li><li>Two\n  three</li></ul><p>End.</p></{tag}>"
    expected = "\n\n".join(["Head & line", (TEXT * 3).strip(), "One", "Two three", "End."])
    assert main_text(page(around.replace("{t}", TEXT).replace("{{}}", "{}x").replace("{}x", "").replace("{}", inner))) == expected


@pytest.mark.parametrize(
    "markup, text",
    [
        ("", ""),
        ("<p></p>", ""),
        ("just text", "just text"),
        ("<p>one<p>two<br>three &lt;b&gt; &#233;&eacute &nope;", "one\n\ntwo three <b> éé &nope;"),
        ("</div></p><article><p><b>bold<p>next</i></article>tail", "bold\n\nnext"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table>x</article>", "a b\n\nc\n\nx"),
        ("<article>a<p>b</p>c<div>d</div>e</article>", "a\n\nb\n\nc\n\nd\n\ne"),
        ("<nav>only a menu</nav>", ""),
        ("<![if x]><p>kept<![endif]>", "kept"),
        ("<p" * 3, ""),
    ],
)
def test_odd_markup(markup, text):
    assert main_text(markup) == text


def test_deep_and_long_pages():
    assert main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert len(main_text(f"<article>{'<p>word</p>' * 50_000}</article>")) == 50_000 * 6 - 2


def test_null_empty_and_repeated_rows(spark, frame):
    df = frame([(1, None), (2, ""), (3, "<p>x"), (3, "<p>x")])
    assert [r[0] for r in df.select(article_text(F.col("text"))).collect()] == ["", "", "x", "x"]
    assert df.limit(0).select(article_text(F.col("text"))).collect() == []


def test_query_returns_the_article_of_every_page(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.QUERIES["op5_html"].run(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = pages[r.page_id].html.split("<article>")[1].split("</article>")[0]
        for mark in ("<h1>", "</h1>", "<p>", "</p>"):
            article = article.replace(mark, "\0")
        article = article.replace("<b>", "").replace("</b>", "").replace("<br>", " ")
        blocks = [" ".join(html_lib.unescape(b).split()) for b in article.split("\0")]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
        assert r.url == pages[r.page_id].url


def test_a_page_of_open_tags_takes_no_time():
    import time

    started = time.perf_counter()
    for page in ("<a" * 500_000 + ">", "<a" * 500_000, "x < y " * 100_000):
        main_text(page)
    assert time.perf_counter() - started < 20
    assert main_text("<p>one two three</p><p>four <b").strip() == main_text("<p>one two three</p><p>four ").strip()


SIXTY = " ".join(f"word{k}" for k in range(60))


def paragraphs(mark, k):
    return [f"{mark}{j} {SIXTY}." for j in range(k)]


def markup(blocks):
    return "".join(f"<p>{b}</p>" for b in blocks)


@pytest.mark.parametrize("sizes", [(6, 2, 2), (8, 5, 5), (3, 12, 3), (2, 2, 2), (1, 30, 1)])
@pytest.mark.parametrize("around", ["<main>{}</main>", "{}", "<div><div>{}</div></div>"])
def test_text_in_several_articles_is_kept(sizes, around):
    parts = [paragraphs(f"a{k}p", n) for k, n in enumerate(sizes)]
    html = around.format("".join(f"<article>{markup(p)}</article>" for p in parts))
    assert main_text(page(f"<nav>menu</nav>{html}<footer>foot</footer>")) == "\n\n".join(b for p in parts for b in p)


def test_teasers_beside_the_article_are_left_out():
    teaser = "<article><h3><a href=/x>Another story of the day</a></h3><p><a href=/x>Read</a> it</p></article>"
    html = f"<main><article><h1>Head</h1>{markup(paragraphs('p', 5))}</article>{teaser * 6}</main>"
    assert main_text(page(html)) == "\n\n".join(["Head", *paragraphs("p", 5)])


@pytest.mark.parametrize("shape", ["<div>{}</div>", "<div><ul>{}</ul></div>"])
def test_lists_of_links_in_an_article_are_left_out(shape):
    item = "<a href=/l>some link text</a> " if "ul" not in shape else "<li><a href=/l>some link text</a></li>"
    html = f"<article>{markup(paragraphs('p', 3))}{shape.format(item * 60)}{markup(paragraphs('q', 3))}</article>"
    assert main_text(page(html)) == "\n\n".join([*paragraphs("p", 3), *paragraphs("q", 3)])


def test_links_in_the_sentences_of_an_article_stay():
    linked = f"<p>{SIXTY} <a href=/a>one</a> and <a href=/b>two</a> and <a href=/c>three</a> {SIXTY}</p>"
    text = f"{SIXTY} one and two and three {SIXTY}"
    assert main_text(page(f"<article>{linked * 4}<p><a href=/s>Source</a></p></article>")) == "\n\n".join([text] * 4 + ["Source"])


@pytest.mark.parametrize("name", ['class="social-history"', 'id="discussion"', 'class="notice-period"', 'id="relatedWork"'])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_a_name_alone_does_not_part_text_from_its_article(name, tag):
    parts = [paragraphs("a", 4), paragraphs("b", 3), paragraphs("c", 2)]
    html = f"<{tag}>{markup(parts[0])}<div {name}>{markup(parts[1])}</div>{markup(parts[2])}</{tag}>"
    assert main_text(page(html)) == "\n\n".join(b for p in parts for b in p)


@pytest.mark.parametrize(
    "name", ["notice", "cookie-notice", "share-buttons", "comments", "relatedPosts", "ad", "ad-slot-3", "sidebar left", "cookie-law-info"]
)
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_short_named_blocks_are_left_out(name, tag):
    html = f"<{tag}>{markup(paragraphs('a', 4))}<div class='{name}'><p>{TEXT}</p></div>{markup(paragraphs('b', 2))}</{tag}>"
    assert main_text(page(html)) == "\n\n".join([*paragraphs("a", 4), *paragraphs("b", 2)])


def test_a_page_of_nothing_but_unsure_names_has_a_text():
    assert main_text(page(f"<div id=discussion>{markup(paragraphs('p', 3))}</div>")) == "\n\n".join(paragraphs("p", 3))
    assert main_text(page(f"<div class=comments>{markup(paragraphs('p', 3))}</div>")) == ""


def plain(node, body_c, body_lc, linked=False):
    """(C, T, LC, LT, densities below and here) of a (tag, children) tree, from the formula."""
    tag, children = node
    linked |= tag == "a"
    c = t = lc = lt = 0
    found, total = [], 0.0
    for child in children:
        if isinstance(child, str):
            c, lc = c + len(child), lc + (len(child) if linked else 0)
            continue
        (c1, t1, lc1, lt1, d1), below = plain(child, body_c, body_lc, linked)
        c, t, lc, lt, total = c + c1, t + t1 + 1, lc + lc1, lt + lt1 + (child[0] == "a"), total + d1
        found += below
    d = 0.0
    if c:
        one = lambda x: max(x, 1)
        ratio = c / one(lc) * (one(t) / one(lt))
        d = max(0.0, c / one(t) * math.log(ratio, c / one(c - lc) * lc + body_lc / one(body_c) * c + math.e**2))
    return (c, t, lc, lt, d), [(d, total), *found]


@pytest.mark.parametrize("seed", range(40))
def test_densities_are_those_of_the_formula(seed):
    rng = random.Random(seed)

    def grow(depth, linked):
        children = []
        for _ in range(rng.randint(1, 4)):
            if depth == 0 or rng.random() < 0.3:
                children.append("x" * rng.randint(1, 200))
            else:
                tag = rng.choice(["div", "div", "section", "span", "span" if linked else "a"])
                children.append((tag, grow(depth - 1, linked or tag == "a")))
        return children

    def written(node):
        return node if isinstance(node, str) else f"<{node[0]}>{''.join(map(written, node[1]))}</{node[0]}>"

    # links hold no blocks, so that the parser leaves the tree as it is
    tree = ("body", grow(4, False))
    got = Page(read_page(written(tree)))
    (c, _, lc, _, _), _ = plain(tree, 1, 0)
    _, nodes = plain(tree, c, lc)
    # breadth of both: page order
    assert got.d[1:] == pytest.approx([d for d, _ in nodes])
    assert got.sums[1:] == pytest.approx([total for _, total in nodes])
    fit = [k for k in range(len(nodes)) if got.c[k + 1]]
    assert got.heart - 1 == max(fit, key=lambda k: (got.sums[k + 1], -k))
