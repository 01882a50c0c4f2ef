"""Text, HTML, URL and query expressions on cases worked out by hand."""

import os

import pytest
from pyspark.sql import functions as F

from lexivane.functions import html as H
from lexivane.functions import markup as M
from lexivane.functions import text as X
from lexivane.functions import urls as U
from lexivane.functions.terms import query_terms, tokens
from lexivane.operators.pages import page_quality
from lexivane.sources import files as FS


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "base, href, want",
    [
        ("http://a/b/c/d?q", "g", "http://a/b/c/g"),
        ("http://a/b/c/d?q", "./g", "http://a/b/c/g"),
        ("http://a/b/c/d?q", "g/", "http://a/b/c/g/"),
        ("http://a/b/c/d?q", "/g", "http://a/g"),
        ("http://a/b/c/d?q", "//g", "http://g"),
        ("http://a/b/c/d?q", "?y", "http://a/b/c/d?y"),
        ("http://a/b/c/d?q", "#s", "http://a/b/c/d?q#s"),
        ("http://a/b/c/d?q", "g?y#s", "http://a/b/c/g?y#s"),
        ("http://a/b/c/d?q", "..", "http://a/b/"),
        ("http://a/b/c/d?q", "../g", "http://a/b/g"),
        ("http://a/b/c/d?q", "../../g", "http://a/g"),
        ("http://a/b/c/d?q", "../../../g", "http://a/g"),
        ("http://a", "g", "http://a/g"),
        ("http://a/b", "mailto:x@y", "mailto:x@y"),
        ("http://a/b", "", "http://a/b"),
    ],
)
def test_url_join(spark, base, href, want):
    assert one(spark, U.url_join(F.col("b"), F.col("h")), b=base, h=href) == want


def test_query_terms(spark):
    def terms(q):
        return [
            " ".join(t["parts"]) + ("*" if t["is_prefix"] else "")
            for t in one(spark, query_terms(F.col("q")), q=q)
        ]

    assert terms("How to use PyTorch DataLoader?") == ["how*", "to", "use*", "pytorch*", "dataloader*"]
    assert terms("C++") == ["c"]
    assert terms("???") == []
    assert terms("élan vital") == ["lan*", "vital*"]
    assert terms("model_registry") == ["model registry*"]
    assert terms("pre-trained") == ["pre trained*"]


def test_tokens_fold_marks(spark):
    assert one(spark, tokens(F.col("t")), t="Café Ñu-3x") == ["cafe", "nu", "3x"]


def test_invalid_bytes_are_dropped(spark):
    raw = bytearray(b"ok \xff bad")
    assert one(spark, X.valid_utf8(F.col("b")), b=raw) == "ok  bad"
    mixed = bytearray("a�".encode() + b"\xc3" + "é".encode() + b"\xe2\x82")
    assert one(spark, X.valid_utf8(F.col("b")), b=mixed) == bytes(mixed).decode("utf-8", "ignore")


def test_html(spark):
    page = "<h1>A</h1><pre><code>x\ny</code></pre><ul><li>one</li></ul><p>T &amp; <b>u</b></p>"
    assert one(spark, H.html_to_markdown(F.col("h")), h=page) == "# A```\nx\ny\n```- oneT &amp; u"
    assert one(spark, H.decode_entities(F.col("h")), h="&lt;&#65;&#x42;&amp;lt;") == "<AB&lt;"
    assert one(spark, H.decode_entities(F.col("h")), h="&mdash;&copy;&rsquo;&hellip;&Eacute;&nosuch;&") == "—©’…É&nosuch;&"
    assert one(spark, X.stem_to_title(F.col("h")), h="tensorqs_tutorial.html-v2beta") == "Tensorqs Tutorial.Html V2Beta"
    drop = "<nav>n</nav>a<!-- <p>c</p> --><script>var t='</p>'</script>b<headerx>c</headerx>"
    assert one(spark, H.strip_boilerplate(F.col("h"), ("script", "nav", "header")), h=drop) == "ab<headerx>c</headerx>"
    body = "<div>x</div><main><p>one</p> <p>two</p></main>"
    assert one(spark, H.visible_text_lines(F.col("h")), h=body) == "one\ntwo"
    assert one(spark, H.visible_text_flat(F.col("h")), h="<p> a  b </p>\n\n<p>c</p>") == "a b c"


def test_nested_elements_go_and_stay_whole(spark):
    drop = lambda h, *tags, classes=(): one(spark, H.strip_boilerplate(F.col("h"), tags, classes), h=h)
    assert drop("a<nav>x<nav>y</nav>z</nav>b", "nav") == "ab"
    assert drop("<div>k<div class='side sidebar-left'>x<div>y</div>z</div>l</div>", classes=("sidebar",)) == "<div>kl</div>"
    assert drop("<div class='nav'><div><p>x</div></div>k", classes=("nav",)) == "k"
    # never closed: up to the end of its parent; an end tag alone changes nothing
    assert drop("<div><header>x<p>y</div>k</header>l", "header") == "<div></div>k</header>l"
    assert drop("k<footer>x<br>y", "footer") == "k"
    assert drop("a<img src=x>b<nav/>c<NAV>d</Nav>", "nav") == "a<img src=x>b<nav/>c"
    assert drop("", "nav") == "" and drop("no tags < here", "nav") == "no tags < here"
    lines = lambda h: one(spark, H.visible_text_lines(F.col("h"), ("content",)), h=h)
    assert lines("<p>x</p><div class='content'><div>one<div>two</div></div>three</div>y") == "one\ntwo\nthree"
    assert lines("<main>one<main>two</main>three</main>four") == "one\ntwo\nthree"
    assert lines("<article></article><div class=my-content>one</div>") == "one"
    assert drop("<div>" * 3000 + "<nav>x</nav>" * 300 + "</div>" * 3000, "nav") == "<div>" * 3000 + "</div>" * 3000


ARTICLE = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href="/x">menu</a></nav>
<article class="doc"><div><h1>Guide &amp; more</h1>intro
text<p>See <a href="../b/c.html#s">the <b>c</b> page</a>, <a href='https://o.org/'>other</a> and <a>none</a>.</p>
<h5>Deep</h5><p>one<br/>two <em>three</em> <b>never closed</p>
<ul><li>a<ol><li>x</li><li>y <code>z()</code></li></ol></li><li>b</li></ul>
<pre><code>if a &lt; b:
    go()</code></pre>
<img alt="Fig" src="i.png"><table><tr><th>h</th><td>1</td></tr></table><script>var t = "</p>";</script><hr>end</div></article>
<footer>f</footer></body></html>"""


def test_article_blocks(spark):
    got = one(spark, H.main_article_markdown(F.col("h"), F.col("u")), h=ARTICLE, u="http://h.org/a/d/p.html?q=1")
    assert got == "\n".join(
        ["# Guide & more", "", "intro text", "", "See [the **c** page](http://h.org/a/b/c.html#s), [other](https://o.org/) and none.", "",
         "##### Deep", "", "one", "two *three* never closed", "", "- a", "1. x", "2. y `z()`", "- b", "", "```", "if a < b:", "go()", "```", "",
         "![Fig](http://h.org/a/d/i.png)", "", "| h | 1 |", "", "---", "", "end"]
    )
    assert one(spark, H.main_article_markdown(F.col("h")), h="<main><a href='x'>y</a></main>") == "[y](x)"
    nested = one(spark, M.block_markdown(F.col("h")), h="<ul><li>a<ul><li>b<ol><li>c</ol></ul><li>d</ul>")
    assert [x for x in nested.split("\n") if x.strip()] == ["- a", "  - b", "    1. c", "- d"]
    assert one(spark, H.main_article_markdown(F.col("h")), h="<p>" + "w<br>" * 3000) == "\n".join(["w"] * 3000)


@pytest.mark.parametrize(
    "html, ladder, want",
    [
        ("<title> T </title><h1>H</h1>", "title", "T"),
        ("<h1>H</h1>", "title", "my-page_x"),
        ("<h1>H</h1>", "h1", "H"),
        ("<title>T</title><h1>H</h1>", "focused", "H"),
        ("<h1> </h1><p class='big page-title'>P</p>", "focused", "P"),
        ("<p>x</p>", "focused", "My Page X"),
    ],
)
def test_titles(spark, html, ladder, want):
    got = one(spark, H.extract_title(F.col("h"), F.col("u"), ladder), h=html, u="http://a/b/my-page_x")
    assert got == want


def test_title_fallbacks(spark):
    for ladder, want in (("title", "host:1"), ("h1", "Untitled"), ("focused", "Documentation")):
        assert one(spark, H.extract_title(F.col("h"), F.col("u"), ladder), h="", u="http://host:1/") == want


def test_markdown_titles(spark):
    title = X.extract_title_md(F.col("c"), F.col("p"))
    assert one(spark, title, c="\n```\n# T\n", p="a/x.md") == "T"
    assert one(spark, title, c="## U\n# T", p="a/x.md") == "U"
    assert one(spark, title, c="```", p="a/my_first-doc.md") == "My First Doc"


def test_markdown_cleaning(spark):
    assert one(spark, X.normalize_markdown(F.col("t")), t="\n\n a \n\n\n\n b\n") == "a\n\nb"
    mdx = "import A from 'a';\n<Tabs x>\nhid</Tabs>\ntext {v} <Img/>"
    assert one(spark, X.mdx_to_markdown(F.col("t")), t=mdx) == "text"
    rst = ".. note:: x\nBIG TITLE\nSmall title\nRun::\n\n  a\n  b\nThe end."
    got = one(spark, X.rst_to_markdown(F.col("t")), t=rst)
    assert got == "# BIG TITLE\n## Small title\nRun```\n  a\n  b\n```\nThe end."


def test_file_filters(spark):
    rows = [
        ("/r/a.md", 10),
        ("/r/a.md", 10),
        ("/r/tests/a.md", 10),
        ("/r/b.md", 1048576),
        ("/r/c.md", 1048577),
        ("/r/conf.py", 1),
    ]
    df = spark.createDataFrame(rows, "path string, length bigint")
    kept = sorted(r["path"] for r in FS.filter_corpus_files(df).collect())
    assert kept == ["/r/a.md", "/r/b.md"]
    rows = [("pytorch-docs/nn.rst", 1), ("pytorch-docs/cpp/nn.rst", 1), ("pytorch-docs/a.mdx", 1), ("x/nn.rst", 1)]
    df = spark.createDataFrame(rows, "path string, length bigint")
    assert [r["path"] for r in FS.filter_api_files(df).collect()] == ["pytorch-docs/nn.rst"]


def test_tree_to_documents(spark, folder):
    files = {
        "a.md": "# Title A\ntext",
        "deep/er/b.mdx": "import X from 'y';\n# B\n{x}",
        "c.rst": "SOME TITLE\nbody",
        "d.txt": "no",
        "tests/e.md": "# no",
        "empty.md": "",
    }
    for name, text in files.items():
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(text)
    docs = {r["source"]: r for r in FS.load_docs(spark, folder).collect()}
    assert sorted(docs) == ["a.md", "c.rst", "deep/er/b.mdx"]
    assert docs["a.md"]["url"] == "file://a.md" and docs["a.md"]["title"] == "Title A"
    assert docs["deep/er/b.mdx"]["content"] == "# B"
    assert docs["c.rst"]["content"] == "# SOME TITLE\nbody"


def test_page_quality_counts_the_entities_it_is_asked_to_decode(spark):
    page = "<p>api guide model " + "x" * 470 + "&copy;&middot;&amp;&nbsp;&#65;</p>"  # 496 or 491 + 5 characters
    pages = spark.createDataFrame([(1, page)], "page_id bigint, html string")
    judged = lambda *how: page_quality(pages, *how).first()["is_doc"]
    assert not judged("broad") and judged("broad", H.BASIC_ENTITIES)
    pages = pages.withColumn("html", F.concat("html", F.lit("<h2></h2>")))
    assert not judged("focused") and judged("focused", H.BASIC_ENTITIES)
    assert one(spark, H.page_text(F.col("h"), H.BASIC_ENTITIES), h="&copy;&lt;b&gt;&amp;lt;&apos;&quot;&nbsp;&#65;") == "&copy;<b>&lt;'\"\xa0&#65;"
