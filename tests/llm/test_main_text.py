"""Main text of pages of several templates, broken markup and odd rows."""

import time

import pytest

from seqthin.llm.main_text import extract, main_text

LONG = "A sentence that is long enough to look like the text of an article, and goes on a little. " * 3
P = LONG.strip()

PAGES = {
    "article": (
        f"<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav>"
        f"<article><h1>Title</h1><p><b>{P}<br><p>Short.</p><p>a &amp;amp; b&nbsp;&lt;c&gt;</p></article><footer>(c)</footer></body></html>",
        f"Title\n{P}\nShort.\na &amp; b <c>",
    ),
    "tiny article": ("<body><div class='ad'>Buy our fine goods today. And more of them tomorrow.</div><article><p>Be.</article>", "Be."),
    "comments and forms": (
        f"<body><header><h1>Site</h1></header><main><article><header><h1>Title</h1><p>by me</p></header><p>{P}</p><aside>see also</aside>"
        f"<p>Second</p><form><input><label>Mail</label><button>Go</button></form></article><section id='comments'>"
        f"<article class='comment'><p>{P} {P}</p></article></section></main><div class='cookie-notice'>{P}</div>",
        f"Title\n{P}\nSecond",
    ),
    "no article element": (
        f"<body><div class=topnav><a href=a>a</a></div><div id=page><div class=content><h2>Head</h2><div>{P}</div><div>Brief</div>"
        f"<div>{P}</div></div><div class='sidebar-left'><p>{P}</p></div></div><div id=footer>end</div>",
        f"Head\n{P}\nBrief\n{P}",
    ),
    "unnamed menu in a table": (
        f"<table><tr><td><a href=1>One</a><td><a href=2>Two</a><tr><td colspan=2><h1>T</h1><p>{P}<p>{P} x</table>", f"T\n{P}\n{P} x",
    ),
    "wrapper named for its sidebar": (
        f"<body class=has-sidebar><form id=main><div class='content with-sidebar'><article><p>{P}</p></article></div></form>", P,
    ),
    "inline chrome": (f"<article><p>One <span class='ad'>buy <span>now</span> or</span> two<button>x</button></p><p>{P}</p></article>", f"One two\n{P}"),
    "hidden": (f"<article><p hidden>no</p><p style='display: none'>no</p><p aria-hidden=true>no</p><p>{P}</p></article>", P),
    "code keeps its comments": (f"<article><pre>x <span class='comment'># why</span>\n  y</pre><p>{P}</p></article>", f"x # why y\n{P}"),
    "plain text": ("just  words \n and more", "just words and more"),
    "open comment": (f"<article><p>{P}</p></article><!-- <p>{P}{P}", P),
    "cut tag": (f"<article><p>{P}</p><p>{P}</p><p class='x", f"{P}\n{P}"),
    "odd script end": (f"<article><script>1</script x><style>p</style\n><p>{P}</p><script>if (a<b) {{}}", P),
    "odd declarations": (f"<![if IE]><![x[ y ]]><?php x ?><!foo><article><p>{P}</p></article>", P),
    "unclosed list items": (f"<article><ul><li class='menu'>m<li>first<li>second</ul><p>{P}</p></article>", f"first\nsecond\n{P}"),
    "stray ends": (f"</div></p><article></nav><p>{P}</b></p></div><p>end</article></article>", f"{P}\nend"),
    "empty": ("", ""),
    "no text": ("<html><body><nav>menu</nav><script>x</script></body></html>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    page, text = PAGES[name]
    assert main_text(page) == text


def test_nested_and_long_pages_take_linear_time():
    start = time.time()
    assert main_text("<div><b>" * 30_000 + "x" + "</i></div>" * 30_000) == "x"
    assert main_text("<p>word</p>" * 30_000).count("\n") == 29_999
    assert main_text("<!-- " * 50_000) == ""
    assert main_text("<a " * 50_000) == ""
    assert len(main_text("<article><p>" + "word " * 400_000)) == 5 * 400_000 - 1
    assert time.time() - start < 20


def test_rows(spark):
    rows = [(1, "u", PAGES["article"][0], "x"), (1, "u", PAGES["article"][0], "y"), (None, None, None, None), (3, "v", "", "z")]
    got = extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in got] == [
        (1, "u", PAGES["article"][1], len(PAGES["article"][1])), (1, "u", PAGES["article"][1], len(PAGES["article"][1])),
        (None, None, "", 0), (3, "v", "", 0),
    ]
    assert extract(spark.createDataFrame([], "page_id int, url string, html string, n_chars int")).collect() == []
