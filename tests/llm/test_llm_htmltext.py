import html
import re

import pytest

from creditspark.llm import htmltext as H


@pytest.fixture(scope="module")
def tree(spark):
    return H.fit(spark)


def test_tree_fits_its_table(tree):
    assert all(tree.judge(r[:-1]) == bool(r[-1]) for r in H.table())


def article_text(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body))
    return "\n\n".join(p for p in parts if p)


def test_every_page_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: article_text(r.html) for r in pages.collect()}
    out = H.extract(pages).collect()
    assert {r.page_id: r.text for r in out} == want and all(r.n_chars == len(r.text) for r in out)


@pytest.mark.parametrize("page,text", [
    ("", ""), (None, ""), ("<p", ""), ("<!-- open", ""), ("<article><p>Short.", "Short."),
    ("<article>1 &lt; 2 &amp; 3 < 4 &am x</article>", "1 < 2 & 3 < 4 &am x"),
    ("<main><h1>A&nbsp; b</h1><p>one <b>t</b>wo<br>three</p><aside>no</aside><form>no</form></main><footer>no</footer>", "A b\n\none two three"),
    ("<nav><a href='>'>m</a></nav><div id=cookie-notice>We use cookies</div><article><script>if(a<b){'</p>'}</script><p>x</p><style>p{}</style></article>", "x"),
    ("<article><p>Text</p><section class='comments'><p>First!</p></section><div class=\"share bar\">tweet</div><p>End</p></article>", "Text\n\nEnd"),
    ("<div>some words outside of it all, more than ten of them here</div><article>In</article>", "In"),
    ("<article>" + "<p>w</p>" * 20_000 + "</article>", "\n\n".join(["w"] * 20_000)),
    ("<article><p>a > b \"quoted\" it's</p><img alt='x > y' src=z><p>c</p></article>", "a > b \"quoted\" it's\n\nc"),
])
def test_chosen_pages(tree, page, text):
    assert H.main_text(page, tree) == text


def test_rows_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None, None, "t"), (1, None, None, "t"), (None, "u", "<article>x", "t")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in H.extract(df).collect()) == [(0, "x", 1), (1, "", 0), (1, "", 0)]
    assert H.extract(df.limit(0)).collect() == []


@pytest.mark.parametrize("page,text", [
    ("<html><head><title>x</title><body><article><p>Text</p></article>", "Text"),
    ("<head><meta charset=utf-8><style>p{}</style><article><p>Text</p></article>", "Text"),
    ("<article><p>One</p><button><p>Two</p><select><p>Three</p><iframe src=x><p>Four</p></article>", "One\n\nTwo\n\nThree\n\nFour"),
    ("<article><p>One</p><script>if (a < b) { f()", "One"), ("<script src=x><article><p>Text</p></article>", "Text"),
    ("<article><p>One</p><button>No</button><p>Two</p><button>" + "<option>" * 20_000, "One\n\nTwo"),
    ("<div class='content with-sidebar'><article><p>Text</p></article></div>", "Text"),
    ("<div class='layout sidebar-left'><main><div id=has-header><p>Text</p></div></main><p>no</p></div>", "Text"),
    ("<article><p>Text</p><div class='comment-list'><article><p>First!</p></article></div><div class=share-bar>tweet</div></article>", "Text"),
    ("<main><p>Text</p><div class=comment-list><article><p>First!</p></article></div></main>", "Text"),
    ("<main><h1>Head</h1><div class=blog-sidebar-left><article class='post tag-social'><p>Text</p></article></div></main>", "Head\n\nText"),
    ("<article><p>Text</p><p class=ad>Buy<p>more<ul><li class='ad'>Buy<li>point<li class=promo><b>Buy</b></ul>End</article>", "Text\n\nmore\n\npoint\n\nEnd"),
    ("<article><table><tr><td class=ad>Buy<td>cell<tr><td class=share>tweet</td></tr></table><p>End</p></article>", "cell\n\nEnd"),
])
def test_open_elements_and_class_names(tree, page, text):
    assert H.main_text(page, tree) == text


LONG = "A paragraph of the page that has quite a few words in it, so that nobody would take it for a label or a menu."


@pytest.mark.parametrize("page,text", [
    ("<div><h1>Head line</h1><p>tiny</p></div>", "Head line\n\ntiny"), ("<p>One short line.</p>", "One short line."),
    (f"<p><a>Home</a></p><p><a>News</a></p><h1>Head line</h1><p>{LONG}</p><p>Yes.</p><p>{LONG}</p><p><a>More</a></p>", f"Head line\n\n{LONG}\n\nYes.\n\n{LONG}"),
    (f"<p>{LONG}</p><p><a>Imprint and contact</a></p><p>All rights reserved</p>", LONG),
    (f"<ul><li><a>One</a><li><a>Two</a></ul><div>{LONG}</div>", LONG),
])
def test_pages_without_article(tree, page, text):
    assert H.main_text(page, tree) == text


def test_neighbours_decide(tree):
    """The same short block is text before a paragraph and none after the last link."""
    used, nodes = set(), [tree.root]
    while nodes:
        node = nodes.pop()
        if isinstance(node, tuple):
            used.add(H.FEATURES[node[0]])
            nodes += node[2:]
    assert used & {"links_before", "links_after"} and used & {"words_before", "words_after"}
    assert tree.judge((3.0, 0.0, 2.0, 1.0, 60.0, 0.0, 0.0, 0.0)) and not tree.judge((3.0, 0.0, 2.0, 1.0, 0.0, 0.0, 0.0, 0.0))
