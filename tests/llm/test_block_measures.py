"""Measures of a block of a page come from the whole of its text."""

import math

from flowtally.llm import html_text


def test_share_of_digits():
    texts = ["2024", "a1", "x" * 200 + "7" * 600, "٣" * 5 + "b" * 15]
    x = html_text.vectors([[html_text.Block(t, ("html", "p"), 0) for t in texts]])[0]
    for row, t in zip(x, texts, strict=True):
        assert math.isclose(row[-2], sum(c.isdigit() for c in t) / len(t), abs_tol=1e-6)
