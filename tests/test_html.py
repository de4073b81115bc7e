"""HTML to Markdown, by cases and as a converter."""

import pytest

from quarry.sources import html, readers

CASES = [
    ("<h1>T &amp; U</h1><p>one<br>two</p>", "# T & U\n\none\ntwo"),
    ("<p>a <b>bold</b> and <i>thin</i> <code>x &lt; y</code></p>", "a **bold** and *thin* `x < y`"),
    ("<ul><li>a<li>b<ul><li>c</li><li>d<ol><li>e</li><li>f</li></ol></li></ul></li><li>g</li></ul><p>end", "- a\n- b\n  - c\n  - d\n    1. e\n    2. f\n- g\n\nend"),
    ("<ol><li><p>first</p><p>more</p></li><li>second</li></ol>", "1. first\n\n   more\n\n2. second"),
    ("<table><tr><th>A<th>B</tr><tr><td>1|2<td>x <a href='/y z'>link</a></tr><tr><td>only</table>", "| A | B |\n| --- | --- |\n| 1\\|2 | x [link](/y%20z) |\n| only |  |"),
    ("<table><tr><td>a<table><tr><td>in</td><td>ner</td></tr></table></td><td>b</td></tr></table>", "| a in ner | b |\n| --- | --- |"),
    ("x <a href='http://e.org/(a)'>y\n z</a> <a name=q>plain</a> <a href='javascript:f()'>run</a>", "x [y z](http://e.org/(a%29) plain run"),
    ("<script>var a='<p>no</p>';</script><style>p{}</style><p>yes</p><!-- no --><noscript><p>no</p></noscript>", "yes"),
    ("<pre>  a\n    b &lt;\n</pre>", "```\n  a\n    b <\n```"),
    ("<div>a<div>b</div>c</div><hr><img alt='a picture' src=x>", "a\n\nb\n\nc\n\n---\n\na picture"),
    ("<head><title>Name</title></head><body>text</body>", "Name\n\ntext"),
    ("", ""),
    ("no tags < at all & here", "no tags < at all & here"),
    ("<p>unclosed <b>tags <table><tr><td>cell", "unclosed **tags\n\n| cell |\n| --- |"),
    ("</ul></table></td></a></pre>stray ends", "stray ends"),
]


@pytest.mark.parametrize(("page", "want"), CASES)
def test_cases(page, want):
    assert html.markdown(page) == want


def test_encodings():
    assert html.decoded("é".encode()) == "é" and html.decoded("﻿é".encode("utf-16")) .strip("﻿") == "é"
    assert html.decoded(b"<meta charset='latin-1'>\xe9").endswith("é") and html.decoded(b"<meta charset=nonsense>a\xff").endswith("a�")


def test_deep_nesting_ends(spark):
    deep = "<div>" * 30_000 + "x" + "<ul><li>" * 3000 + "y"
    assert html.markdown(deep).startswith("x\n\n")
    files = spark.createDataFrame([("a.html", b"<h2>a</h2>"), ("b.html", None), ("c.html", b"\xff<p>")], "file_name string, content binary")
    got = {r["file_name"]: (r["text"], r["error"]) for r in readers.converted(files, html.HtmlConverter()).collect()}
    assert got["a.html"] == ("## a", None) and got["b.html"][0] is None and got["b.html"][1] and got["c.html"] == ("�", None)
