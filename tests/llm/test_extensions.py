"""The n-gram join for texts and the same texts with words found nowhere else after them, against brute force."""

import random

import pytest

from flowtally.llm import ngram_join


@pytest.mark.parametrize("n, percent, size, more", [(3, 90, 94, 8), (3, 90, 94, 10), (5, 80, 64, 12)])
def test_extended_text_is_linked(spark, n, percent, size, more):
    r = random.Random(11)
    texts = []
    for g in range(12):
        text = " ".join(f"w{g}x{r.randrange(1 << 30)}" for _ in range(size))
        texts += [text] * 20 + [" ".join([text, *(f"z{g}x{k}" for k in range(more))])]
    sets = [frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) for w in map(str.split, texts)]
    want = {}
    for i, s in enumerate(sets):
        alike = [j for j, t in enumerate(sets) if 100 * len(s & t) >= percent * len(s | t)]
        assert alike[0] % 21 == 0
        want[i] = (len(s), alike[0])
    assert (want[20][1] == 0) == (100 * len(sets[0]) >= percent * len(sets[20]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = ngram_join.grouped(docs, n=n, percent=percent).collect()
    assert {x.id: (x.n, x.component) for x in got} == want


def test_hot_documents_and_shingles(spark, monkeypatch):
    """One text that most others nearly equal, over many partitions and with splitting from the third row of a key on."""
    from flowtally.llm import common

    monkeypatch.setattr(common, "FEW_ROWS", 2)
    r = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join(base)]
    for _ in range(70):
        w = list(base)
        w[r.randrange(80)] = f"x{r.randrange(1 << 30)}"
        texts.append(" ".join(w))
    texts += [" ".join(f"u{i}x{k}" for k in range(30)) for i in range(10)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    sets = [frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) for w in ((t or "").split() for t in texts)]
    up = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]) > 0:
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    got = {x.id: x.component for x in ngram_join.grouped(docs, n=3, percent=90).collect()}
    assert got == dict(enumerate(up)) and sum(c == 0 for c in got.values()) == 71
