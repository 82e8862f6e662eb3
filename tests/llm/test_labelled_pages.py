"""Main text of pages written by hand, in layouts that the labeller's own generator doesn't make."""

import pytest

from flowtally.llm import html_text, queries

#: (page, main text)
PAGES = [
    (
        """<!doctype html><html lang=en><head><meta charset=utf-8><title>Low tide</title><style>body{margin:0}</style></head><body>
<div id="page"><div id="masthead"><a href="/">The Harbour Post</a><div class="tagline">Since 1911</div></div>
<div id="primary-menu"><a href="/news">News</a> <a href="/tides">Tides</a> <a href="/boats">Boats</a></div>
<div class="entry"><h1>Low tide shows a lost jetty</h1><p>Walkers on the north shore found the remains of a wooden jetty on Sunday, after the lowest tide of the year.</p>
<p>&ldquo;We counted forty posts,&rdquo; said one of them. The council has asked people not to climb on the timber.</p>
<h2>What happens next</h2><p>A survey is planned for May, when the sands are dry enough to carry the equipment.</p></div>
<div class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Ferry times change</a></li><li><a href="/2">New mayor</a></li></ul></div>
<div id="footer">&copy; The Harbour Post. <a href="/terms">Terms</a></div></div></body></html>""",
        ["Low tide shows a lost jetty", "Walkers on the north shore found the remains of a wooden jetty on Sunday, after the lowest tide of the year.", "“We counted forty posts,” said one of them. The council has asked people not to climb on the timber.", "What happens next", "A survey is planned for May, when the sands are dry enough to carry the equipment."],
    ),
    (
        """<html><body><nav class="navbar"><ul><li><a href=/a>Start</a><li><a href=/b>Rezepte</a></ul></nav>
<main><article class="post"><header><h1>Brot ohne Kneten</h1></header><p>Mehl, Wasser, Salz und Hefe werden am Abend verr&uuml;hrt.<p>Am Morgen kommt der Teig in einen hei&szlig;en Topf.
<ul><li>500 g Mehl</li><li>350 g Wasser</li><li>1 TL Salz</li></ul><blockquote>Ein gutes Brot braucht vor allem Zeit.</blockquote></article>
<section id="comments" class="comments"><h2>Kommentare</h2><div class="comment"><p>Sehr lecker, danke!</p></div><div class="comment"><p>Bei mir wurde es zu fest.</p></div></section></main>
<aside class="related"><p>Mehr Rezepte</p><a href=/c>Pizza</a></aside><footer><p>Impressum und Datenschutz</p></footer></body></html>""",
        ["Brot ohne Kneten", "Mehl, Wasser, Salz und Hefe werden am Abend verrührt.", "Am Morgen kommt der Teig in einen heißen Topf.", "500 g Mehl", "350 g Wasser", "1 TL Salz", "Ein gutes Brot braucht vor allem Zeit."],
    ),
    (
        """<HTML><BODY><DIV CLASS="cookie-consent">This site uses cookies. <BUTTON>Accept</BUTTON></DIV><DIV CLASS="header"><IMG SRC=logo.png><FORM ACTION=/s><INPUT NAME=q><BUTTON>Search</BUTTON></FORM></DIV>
<DIV CLASS="content"><H1>Repairing a bicycle tube</H1><P>Take the wheel off &amp; let out the air.</P><DIV CLASS="ad">Tyres from 9.99! Order today.</DIV><P>Roughen the rubber around the hole, put on the glue and wait five minutes.</P>
<TABLE><TR><TD>Small patch</TD><TD>up to 3 mm</TD></TR><TR><TD>Large patch</TD><TD>up to 8 mm</TD></TR></TABLE><P>Press the patch on firmly.</P></DIV>
<DIV CLASS="newsletter"><FORM><LABEL>Your email</LABEL><INPUT NAME=e><BUTTON>Subscribe</BUTTON></FORM></DIV><DIV CLASS="footer">All rights reserved</DIV></BODY></HTML>""",
        ["Repairing a bicycle tube", "Take the wheel off & let out the air.", "Roughen the rubber around the hole, put on the glue and wait five minutes.", "Small patch", "up to 3 mm", "Large patch", "up to 8 mm", "Press the patch on firmly."],
    ),
    (
        """<!DOCTYPE html><html><body class="archive"><ol class="breadcrumbs"><li><a href=/>Home</a></li><li><a href=/essays>Essays</a></li></ol>
<article><h1>On walking slowly</h1><p>There is a path behind the mill that nobody uses before noon. I have taken it for nine years, and only last winter did I notice the second bridge.</p>
<figure><img src=b.jpg alt=""><figcaption>The second bridge, in January.</figcaption></figure><p>It carries no road. It was built for sheep, I am told, and the sheep were sold in the year that I was born.</p></article>
<div class="share">Share this: <a href=#>Mail</a> <a href=#>Print</a></div><div class="pagination"><a href=/1>Older</a> <a href=/3>Newer</a></div><script>track("<p>no text</p>")</script></body></html>""",
        ["On walking slowly", "There is a path behind the mill that nobody uses before noon. I have taken it for nine years, and only last winter did I notice the second bridge.", "The second bridge, in January.", "It carries no road. It was built for sheep, I am told, and the sheep were sold in the year that I was born."],
    ),
]


def test_blocks_of_pages_by_hand():
    """At least 95 of 100 blocks are labelled right, and each main text is found nearly whole."""
    right = total = 0
    found = [html_text.blocks(p) for p, _ in PAGES]
    for (_, want), blocks, chosen in zip(PAGES, found, html_text.fitted().label(html_text.vectors(found)), strict=True):
        texts = [b.text for b in blocks]
        assert [t for t in texts if t in want] == want
        right += sum((t in want) == y for t, y in zip(texts, chosen.tolist(), strict=True))
        total += len(texts)
    assert right / total >= 0.95, (right, total)


def test_op4_query(spark, tmp_path):
    """The query over these pages, repeated pages, null, empty and broken markup and a page of a million characters."""
    long = "<html><body><nav><a href=/>Home</a></nav><article><h1>Long</h1>" + "".join(f"<p>This is sentence number {i} of a very long article, which goes on.</p>" for i in range(15_000)) + "</article><footer>&copy; all</footer></body></html>"
    pages = [p for p, _ in PAGES] + [PAGES[0][0], None, "", "<p", "&lt;p&gt; 1 &lt; 2", long]
    spark.createDataFrame([(i, f"u{i}", p, "mine") for i, p in enumerate(pages)], "page_id long, url string, html string, text string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in queries.QUERIES["op4_html_text"](spark, str(tmp_path)).collect()}
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) and r.url == f"u{i}" for i, r in got.items())
    assert got[4].text == got[0].text and got[5].text == got[6].text == got[7].text == ""
    lines = [set(got[i].text.split("\n")) & set(want) for i, (_, want) in enumerate(PAGES)]
    assert sum(map(len, lines)) >= 0.95 * sum(len(w) for _, w in PAGES)
    assert got[9].text.count("\n") >= 0.999 * 15_000 and "sentence number 14999" in got[9].text


@pytest.mark.parametrize("page, text", [("<p>a&nbsp; b\n\tc</p><p>&#x41;&amp;lt;</p>", ["a b c", "A&lt;"]), ("<div>x<br>y</div><!-- <p>z</p> -->", ["x y"]), ("<ul><li>a<li>b</ul>", ["a", "b"]), ("<script>if (a<b) '</p>'</script><style>p</style>t", ["t"]), ("<p title='a>b'>c</p>", ["c"])])
def test_blocks_of_markup(page, text):
    assert [b.text for b in html_text.blocks(page)] == text
