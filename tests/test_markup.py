"""Pages to Markdown, by hand-written cases."""

import pytest
from pyspark.sql import functions as F

from belegwerk.functions.markup import page_markdown, page_text

CASES = {
    "": "",
    "plain &amp; simple": "plain & simple",
    "<h1>A <b>b</b></h1><p>one<br>two  three</p><h3> C\n</h3>": "# A **b**\n\none\ntwo three\n\n### C",
    "<head><title>T</title><script>x<p></script></head><body><p>text": "text",
    "<head><title>T<body>seen": "seen",
    "<style>p{}</style>a<!-- <p>no -->b<template>c</template>": "ab",
    "<ul><li>a<li>b<ul><li>c</li><li>d</ul></li><li><p>e</p><p>f</p></ul><p>g": "- a\n- b\n  - c\n  - d\n- e\n  f\n\ng",
    "<ol><li>x</li><li>y<ol><li>z</ol></ol>": "1. x\n2. y\n  1. z",
    "<p>See <a href='/a b(c)'>the <i>page</i></a>, <a>none</a> <a href='x'></a>!": "See [the *page*](/a%20b%28c%29), none !",
    "<img alt='A  cat' src='c.png'><img src='x.png'>": "![A cat](c.png)",
    "<pre>x = 1\n  y &lt; 2\n</pre><p>use <code>a  b</code>": "```\nx = 1\n  y < 2\n```\n\nuse `a b`",
    "<blockquote>q<p>r</p></blockquote>s": "> q\n\n> r\n\ns",
    "<table><tr><th>a<th>b|c</tr><tr><td><p>1</p><p>2</p><td><b>x</b></table>t": "| a | b\\|c |\n| --- | --- |\n| 1 2 | **x** |\n\nt",
    "<table><tr><td>o<table><tr><td>i1<td>i2</table></td><td>p</td></tr><tr></tr></table>": "| o i1 i2 | p |\n| --- | --- |",
    "<table></table>x<hr>y": "x\n\n---\n\ny",
    "<p><b>open<p>next": "**open**\n\nnext",
    "<b><b>twice</b></b> <em> spaced </em>end</i></p>": "**twice** *spaced* end",
    "a&nbsp;b &#228; &unknown; <unknown>c</unknown> 1 < 2": "a b ä &unknown; c 1 < 2",
    "</ul></li></table></pre><li>alone": "alone",
}


@pytest.mark.parametrize("html", CASES)
def test_page(html):
    assert page_text(html) == CASES[html]


def test_column(spark):
    rows = [(k, h) for k, h in enumerate([*CASES, None])]
    df = spark.createDataFrame(rows, "id int, html string").select("id", page_markdown(F.col("html")).alias("text"))
    assert [r.text for r in df.orderBy("id").collect()] == [*CASES.values(), None]
