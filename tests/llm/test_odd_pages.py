"""Pages of a megabyte of odd markup: read in time and memory in proportion to their length."""

import time
import tracemalloc

import numpy as np
import pytest

from flowtally.llm import html_text

ODD = {
    "open tags": "<a ", "open blocks": "<div>x", "declarations": "<!", "comments": "<!--", "quoted ends": '<a ">" ', "quotes of both kinds": """<a '">""", "paragraphs": "<p>x", "lists": "<ul><li>x", "brackets": "<",
    "scripts": "<script>", "open attributes": "<p class='", "tables": "<table><tr><td>x", "headings in links": "<a href=x><h1>y", "ends": "</div>", "buttons": "<button><p>x",
}


@pytest.mark.parametrize("kind", ODD)
def test_a_megabyte(kind):
    took = []
    for size in (250_000, 1_000_000):
        page = ODD[kind] * (size // len(ODD[kind]))
        began = time.process_time()
        found = html_text.blocks(page)
        x = html_text.vectors([found])[0]
        took.append(time.process_time() - began)
        assert len(x) == len(found) and np.isfinite(x).all()
    assert took[1] < 12 * max(took[0], 0.2), took  # four times the length


def test_paths_share_levels():
    """Memory grows with the page, not with its depth times its blocks."""
    tracemalloc.start()
    html_text.blocks("<div>x" * 20_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20, peak


def plain_vector(labels):
    """The vector of a path, level by level."""
    import zlib

    v = np.zeros(html_text.PATH_DIMS)
    for d, level in enumerate(reversed(labels)):
        tag, *names = level.split(" ")
        for t in (f"<{tag}>", *names, *([f"leaf <{tag}>"] if not d else [])):
            h = zlib.crc32(t.encode())
            v[h % html_text.PATH_DIMS] += (1 if h >> 16 & 1 else -1) * max(0.35, 0.85**d)
    return np.clip(v, -2, 2)


def test_vectors_of_deep_paths():
    pages = [[("html", "body", *["div row"] * k, "p lead x") for k in (0, 3, 9, 9, 30, 2)], [(), ("div",), ("div", *["ul", "li a"] * 12), ("p",)]]
    got = html_text.vectors([[html_text.Block("t", p, 0) for p in page] for page in pages])
    for x, page in zip(got, pages, strict=True):
        for row, labels in zip(x, page, strict=True):
            assert np.allclose(row[: html_text.PATH_DIMS], plain_vector(labels), atol=1e-5)
    # Levels that blocks share give the same as paths of their own.
    found = html_text.blocks("<div class=a><ul>" + "<li><div>" * 9 + "x<p>y</p>z" + "</div></li>" * 9 + "w</ul><p>v")
    alone = []
    for b in found:
        labels, at = [], b.path
        while at:
            labels.insert(0, at.label)
            at = at.up
        alone.append(html_text.Block(b.text, tuple(labels), b.linked))
    assert np.array_equal(html_text.vectors([found])[0], html_text.vectors([alone])[0]) and len(found) == 5


def test_tags_of_broken_markup():
    """Ends of tags as the plain rule finds them: the first > outside of quotes, else the first one."""
    import random

    r = random.Random(4)
    for _ in range(3000):
        page = "".join(r.choice(["<a ", "<b", ">", '"', "'", "x", " ", "</c", "<!--", "-->", "<!d"]) for _ in range(r.randint(1, 25)))
        tags, at = html_text.Tags(page), 0
        while got := tags.after(at):
            start, end, name, _, attributes = got
            if name:
                k = start + 1 + len(name) + page.startswith("</", start)
                quote, stop = "", -1
                for i in range(k, len(page)):
                    c = page[i]
                    if quote:
                        quote = "" if c == quote else quote
                    elif c in "\"'":
                        quote = c
                    elif c == ">":
                        stop = i
                        break
                stop = page.find(">", k) if stop < 0 else stop
                assert (end, attributes) == (stop + 1, page[k:stop]), page
            assert end > start >= at
            at = end
