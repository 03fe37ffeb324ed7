import html
import re
import time

import pytest

from frondlake.llm import html_text

LONG = "The people of the town said that it was the best of all the days in the year and they went to the river with the dog."


@pytest.mark.parametrize("page, want", [
    ("", ""), ("   ", ""), ("plain text only", "plain text only"),
    (f"<p>{LONG}<p>Short one.<p>{LONG}", f"{LONG}\nShort one.\n{LONG}"),
    (f"<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{LONG}</p><p>Bye.</p></article><footer>&copy; us</footer>",
     f"Title\n{LONG}\nBye."),
    (f"<article><p>Only short.</article><div class='ad'>{LONG}</div>", "Only short."),
    (f"<article><p>{LONG}</p><div class=comments><p>{LONG}</p></div><section id='respond'><form>x</form></section></article>", LONG),
    (f"<main><p>{LONG}</p><article class='comment'><p>{LONG}</p></article></main>", LONG),
    (f"<article><header><h1>T</h1></header><p>{LONG}</p><aside>x</aside></article>", f"T\n{LONG}"),
    (f"<header><h1>Site</h1><p>{LONG}</p></header><article><p>{LONG}</p></article>", LONG),
    (f"<article><p>A &lt;b&gt; &amp; &#233;&nbsp; x<br>y\n\t z</p><script>var t='</p>'</script><style>p{{}}</style>{LONG}",
     f"A <b> & é x y z\n{LONG}"),
    (f"<article><p class=ad>{LONG}<p>{LONG} 2</article>", f"{LONG} 2"),
    (f"<div><p>{LONG}</p></div><div><a href=1>one</a> <a href=2>two</a></div>", LONG),
    (f"<div><h2>Head</h2><p>{LONG}</p></div><div><a href=1>{LONG}</a><h2>More</h2><a href=2>{LONG}</a></div>", f"Head\n{LONG}"),
    (f"<article><p>{LONG}</p><!-- <p>hidden</p> --><p hidden>gone</p><p style='display: none'>gone</p></article>", LONG),
    (f"<article><ul><li>One<li>Two</ul><p>{LONG}</p></article>", f"One\nTwo\n{LONG}"),
    (f"<div class=cookie-notice>{LONG}</div><p>{LONG} end</p><div id=mainSidebar>{LONG}</div>", f"{LONG} end"),
    (f"<article><p>{LONG}</p><!-- open", LONG), (f"<p>{LONG}</p><script>never closed", LONG),
    (f"<p>1 < 2 and {LONG}</p>", f"1 < 2 and {LONG}"),
    (f"<div class='legal'><p>{LONG}</p><p>{LONG} 2</p></div>", f"{LONG}\n{LONG} 2"),
    (f"<nav>x</nav><div id=social-history><p>{LONG}</p></div><footer>(c) us</footer>", LONG),
    (f"<div class=legal><p>{LONG}</p></div><div><p>{LONG} end</p></div>", f"{LONG} end"),
    (f"<div class=menu><nav><p>{LONG}</p></nav></div><div>ok</div>", "ok"),
    (f"<div class=menu hidden><p>{LONG}</p></div><div>ok</div>", "ok"),
])
def test_pages(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("piece", ["<", "<p>", "<div>", "</div>", "<a '", "<!--", "&amp", "<li>", "<b>", "<td>", " ", "x", "<a href=\"", "<script>", "<b><li>", "<td><div>", "<div>x"])
def test_linear_on_runs(piece):
    started = time.time()
    html_text.main_text(piece * 20_000)
    assert time.time() - started < 10


POLISH = "Wczoraj rano pociąg stanął przed stacją, ponieważ burza zerwała przewody trakcyjne w całej okolicy."
RUSSIAN = "Вчера утром поезд остановился перед станцией, потому что буря оборвала провода по всей округе города."
CHINESE = "昨天早上火车在车站前停了下来因为暴风雨破坏了整个地区的电线" * 3


@pytest.mark.parametrize("line", [POLISH, RUSSIAN, CHINESE])
def test_other_languages_keep_their_paragraphs(line):
    menu = "<div class='menu'><a href='/'>x</a> " + line + "</div>"
    links = "<div><a href='/'>" + line + "</a></div>"
    page = f"<body>{menu}<div><div>{line}</div><div>ok</div><div>{line}</div></div>{links}</body>"
    assert html_text.main_text(page) == f"{line}\nok\n{line}"


def test_frames(spark):
    rows = [(1, None, "u"), (2, "", None), (3, f"<p>{LONG}", "u"), (3, f"<p>{LONG}", "u"), (4, f"<article>{'<p>' + LONG * 5000}", "u")]
    frame = spark.createDataFrame(rows, "page_id long, html string, text string")
    out = html_text.extract(frame)
    assert out.columns == ["page_id", "html", "text"]
    got = sorted((r.page_id, r.text) for r in out.collect())
    assert got == [(1, ""), (2, ""), (3, LONG), (3, LONG), (4, LONG * 5000)]
    assert html_text.extract(frame.limit(0)).count() == 0


def test_query_against_a_plain_rule(spark):
    """The pages of the test table hold their text in one article of flat paragraphs."""
    from frondlake.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in QUERIES["op9_html_text"](spark, folder).collect()}
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert len(got) == len(pages)
    for page in pages:
        article = re.search(r"<article>(.*?)(</article>|$)", page.html, re.DOTALL).group(1)
        parts = re.split(r"</?(?:p|h1)>", article)
        lines = [" ".join(html.unescape(re.sub(r"<br>", " ", p).replace("<b>", "")).split()) for p in parts]
        want = "\n".join(line for line in lines if line)
        assert got[page.page_id].text == want, page.page_id
        assert got[page.page_id].n_chars == len(want) and got[page.page_id].url == page.url
