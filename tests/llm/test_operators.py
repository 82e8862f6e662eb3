"""Operators for training text against brute force, over tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowtally.llm import common, decontamination, html_text, mixing, ngram_join, pii, quality, queries, spotsigs, substring_dedup, textnum, token_counts, url_filter
from flowtally.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, component string, spans string, id string, rate int"


def make(seed=1, n=60):
    r = random.Random(seed)
    known = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 5))) for _ in range(60)]
    texts = [" ".join(r.choice(known) for _ in range(r.randint(1, 90))) for _ in range(n)]
    shared = " ".join(r.choice(known) for _ in range(30))
    for i in range(0, n, 4):  # near copies, copies and shared passages
        w = texts[i].split()
        w[r.randrange(len(w))] = "x"
        texts.append(" ".join(w))
        texts.append(texts[i].upper() if i % 8 else texts[i])
        texts.append(r.choice(known) + " " + shared + "\n" + r.choice(known))
    texts += [None, "", "  \t\n", "one", "One two", "a " * 3000, " ".join(known) * 40, "aa bb\x1ccc dd\x0bee", "über ÜBER Ü"]
    rows = [(i, t, "en", r.choice(["a", "b", "B", None]), len(t or ""), 7, "c", "s", "i", 3) for i, t in enumerate(texts)]
    return rows + [(None, texts[0], None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return make()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows + rows[3:4], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t, fold=False):
    t = t or ""
    return re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER) if fold else t)


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (2, 50)])
def test_ngram_join(docs, none, rows, n, percent):
    sets = {}
    for i, t, *_ in rows:
        w = words(t, True)
        if i is not None:
            sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            k = len(sets[i] & sets[j])
            if i < j and k and 100 * k >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    got = ngram_join.grouped(docs, n=n, percent=percent).collect()
    assert len(got) == len(rows) + 1
    assert {(r.id, r.n, r.component) for r in got if r.id is not None} == {(i, len(s), root(i)) for i, s in sets.items()}
    assert [r.component for r in got if r.id is None] == [None]
    kept = ngram_join.deduplicated(docs, n=n, percent=percent)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(i for i in sets if not sets[i] or root(i) == i)
    assert ngram_join.grouped(none).count() == 0


def test_adaptive_prefix_shares_enough():
    import numpy as np

    r = np.random.default_rng(3)
    counts = r.integers(1, 500, 1 << ngram_join.SKETCH_LOG2)
    for _ in range(200):
        a = np.unique(r.integers(0, 1 << 63, r.integers(2, 120), dtype=np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) > 0.06], r.integers(0, 1 << 63, r.integers(0, 4), dtype=np.uint64)]))
        if len(b) and 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b)):
            (la, pa), (lb, pb) = (ngram_join.adaptive_prefix(x, counts, 1, 90) for x in (a, b))
            assert len(np.intersect1d(pa, pb)) >= (la if len(a) >= len(b) else lb)


def test_substring_dedup(docs, none, rows):
    first, want = {}, {}
    for i, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w, gone = words(t), set()
        for a in range(len(w) - 12):
            if first.setdefault(tuple(w[a : a + 13]), i) < i:
                gone |= set(range(a, a + 13))
        want[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    got = substring_dedup.kept(docs).collect()
    assert len(got) == len(rows) + 1 and sum(r.n_removed for r in got) > 300
    assert {r.id: (r.n_words, r.n_removed, r.kept) for r in got if r.id is not None} == want
    assert [(r.n_removed, r.kept) for r in got if r.id is None] == [(0, " ".join(words(rows[0][1])))]
    assert substring_dedup.kept(none).count() == 0


def test_fm_index():
    """Matching statistics and intervals of every word of every segment, against all other places."""
    r = np.random.default_rng(5)
    words_ = r.integers(0, 4, 400).astype(np.uint32)
    lengths = np.array([150, 3, 247])
    fm = substring_dedup.FMIndex(words_, lengths, 16)
    text = fm.text.tolist()
    ends = np.array([s + k for s, n in zip(fm.segment_starts, lengths) for k in range(n)])
    most = np.array([min(k + 1, 16) for n in lengths for k in range(n)])
    reach, lo, hi = fm.statistics(ends, most, 5)
    for e, m, got, a, z in zip(ends.tolist(), most.tolist(), reach.tolist(), lo.tolist(), hi.tolist()):
        places = lambda k: {p for p in range(len(text) - k + 1) if text[p : p + k] == text[e - k + 1 : e + 1]}
        assert got == max([k for k in range(1, m + 1) if len(places(k)) > 1], default=0)
        assert set(fm.order[a:z].tolist()) == places(5) if got >= 5 else a == z == -1


def test_token_counts(spark, docs, none, rows, tmp_path):
    import numpy as np

    enc = token_counts.encoder(f"{token_counts.TOKENIZERS}/{token_counts.VOCABULARY}")
    want = sorted(((r[0] if r[0] is not None else -1), len(enc.encode_ordinary(r[1] or ""))) for r in [*rows, rows[3]])
    packed = token_counts.pack(docs, block=64)
    assert packed.agg(F.max(F.length("payload"))).first()[0] == 64
    got = token_counts.document_tokens(docs, block=64)
    assert sorted(((r.doc_id if r.doc_id is not None else -1), r.n_tokens) for r in got.collect()) == want
    assert token_counts.document_tokens(none).count() == 0
    flat = np.array([5, 6, token_counts.END, token_counts.END, 7, 8, 9], "<u2")
    (tmp_path / "a.bin").write_bytes(flat.tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    for block in (2, 4, 1 << 20):
        r = token_counts.scan(token_counts.flat_files(spark, str(tmp_path), block)).orderBy("place").collect()
        assert [x.n_tokens for x in r] == [2, 0, 3]


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header class="site-header"><a href=/>Home</a></header>
    <nav><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></nav><div class="ad">Buy now.</div><article><h1>The  title &amp; more</h1><p><b>First words of the text.<br><p>Second
    paragraph, with <i>inline</i> parts&nbsp;here.</p><script>x()</script></article><footer>&copy; me</footer>"""
    want = "The title & more\nFirst words of the text.\nSecond paragraph, with inline parts here."
    d = spark.createDataFrame([(1, "u", page, 5), (2, None, None, None), (3, "v", "", 1), (None, "w", "<p", 1)], "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r for r in html_text.extract(d).collect()}
    assert got[1].text == want and got[1].n_chars == len(want)
    assert (got[2].text, got[2].n_chars, got[3].text) == ("", 0, "") and len(got) == 4
    assert html_text.extract(d.limit(0)).count() == 0


def test_html_held_out():
    import numpy as np

    r = random.Random(77)
    pages = [html_text.blocks(html_text.synthetic_page(r)) for _ in range(120)]
    truth = [np.array(["\ue000" in b.text for b in p]) for p in pages]
    for p in pages:
        for b in p:
            b.text = b.text.replace("\ue000", "").replace("\ue001", "") or "."
    got = html_text.fitted().label(html_text.vectors(pages))
    assert np.mean(np.concatenate(got) == np.concatenate(truth)) > 0.98


def test_mixing(docs, none, rows):
    got = mixing.mix_plan(docs).collect()
    assert len(got) == len(rows) + 1
    size, weight = defaultdict(int), {}
    for r in [*rows, rows[3]]:
        size[r[3]] += len(words(r[1]))
    for k, s in enumerate(sorted(size, key=lambda s: (s is None, s or ""))):
        weight[s] = (3, 1, 2)[k % 3]
    target, goal, open_ = {}, 1.5 * sum(size.values()), set(size)
    while True:
        level = (goal - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not full:
            break
        target |= {s: 2.0 * size[s] for s in full}
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    for r in got:
        assert r.size == len(words(r.text)) and r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert r.copies in (int(r.rate), int(r.rate) + 1) and r.copies <= 2
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_plan(docs).collect()))
    assert mixing.mixed(docs).count() == sum(r.copies for r in got) and mixing.mix_plan(none).count() == 0


def test_mixing_comes_near(spark, tmp_path):
    """Sources of few documents, some of them long: the words taken come near the target, and the SQL agrees."""
    import duckdb

    r = random.Random(12)
    rows_ = [(i, f"s{i % 25:02d}" if i % 26 else None, "w " * int(r.paretovariate(1.4) * 20)) for i in range(1200)]
    rows_ += [(None, "s01", "a b"), (7, "s01", None), (7, "s01", "x y z")]
    spark.createDataFrame(rows_, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op5_mix_sources"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.ORACLE_SQL["op5_mix_sources"]).fetchall()
    assert sorted((str(x.doc_id), x["size"], x.source_size, round(x.target, 6), x.taken) for x in got) == sorted((str(a), b, c, round(d, 6), e) for a, b, c, d, e in want)
    taken = defaultdict(int)
    for x in got:
        assert x.taken <= 2 * x["size"]
        taken[x.source_size, x.target] += x.taken
    off = sorted(abs(v - goal) / goal for (_, goal), v in taken.items())
    # Independent draws have a median of 0.05 here; a source that one long document makes up may miss by more.
    assert off[len(off) // 2] < 0.02 and off[int(0.8 * len(off))] < 0.08, off


def test_mixing_draws_with_the_fraction(spark):
    """Over many offsets every document, long or short, alone in its size or not, has one more copy as often as the fraction says."""
    sizes = [500, 40, 40, 40, 7, 3, 1, 0]
    rows_ = [(1000 * s + i, f"s{s:04d}", "w " * z) for s in range(3000) for i, z in enumerate(sizes)]
    d = mixing.mix_plan(spark.createDataFrame(rows_, "doc_id long, source string, text string"), weights=(1,), percent=130)
    got = d.groupBy(F.expr("doc_id % 1000").alias("i")).agg(F.avg("copies").alias("mean"), F.min("copies").alias("low"), F.max("copies").alias("high"), F.avg("rate").alias("rate")).collect()
    assert len(got) == len(sizes)
    for r in got:
        assert abs(r.rate - 1.3) < 1e-9 and (r.low, r.high) == (1, 2)
        assert abs(r["mean"] - 1.3) < 4 * (0.3 * 0.7 / 3000) ** 0.5, r


def test_mixing_hot_size(spark, monkeypatch):
    """A size that a third of the documents have is split where the sizes are too many to be broadcast: same rows."""
    monkeypatch.setattr(common, "FEW_ROWS", 10)
    rows_ = [(i, f"s{i % 3}" if i % 4 else None, "w " * (9 if i % 3 == 0 else i)) for i in range(600)]
    t = spark.createDataFrame(rows_, "doc_id long, source string, text string").withColumn("share", F.lit(1)).withColumn("m", F.lit("m"))
    one = sorted(map(str, mixing.mix_plan(t).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(map(str, mixing.mix_plan(t).collect())) == one and len(one) == 600


def test_url_filter(spark):
    import datetime as dt

    day = lambda n: dt.datetime(2024, 1, n)
    e = spark.createDataFrame([("a.com", day(2), True), ("a.com", day(5), False), ("a.com", day(8), True), ("a.com", day(8), True), ("x.b.org", day(1), True), (None, day(1), True), ("c.net", None, True), ("d.io", day(3), True), ("d.io", day(3), False)], "key string, listed_at timestamp_ntz, listed boolean")
    urls = [("http://U@www.A.com:80/p?q", 1, False), ("https://a.com", 2, True), ("https://a.com/", 4, True), ("https://a.com/", 5, False), ("https://a.com./", 9, True), ("http://b.org", 9, False), ("http://y.x.b.org#f", 9, True), ("http://d.io", 4, False), ("nothing", 3, False), (None, 3, False), ("http://aa.com", 9, False)]
    c = spark.createDataFrame([(i, u, day(n), 1) for i, (u, n, _) in enumerate(urls)] + [(99, "http://a.com", None, 1)], "page_id long, url string, fetched_at timestamp_ntz, host int")
    got = {r.page_id: r for r in url_filter.as_of(c, e).collect()}
    assert {i: r.blocked for i, r in got.items()} == {**{i: b for i, (_, _, b) in enumerate(urls)}, 99: False}
    assert got[6].entry == "x.b.org" and got[1].n_active == 1
    assert url_filter.blocked_out(c, e).count() == len(urls) + 1 - 4
    again = c.union(c).union(spark.createDataFrame([(500, "http://a.com/" + "p" * 1_000_000, day(4), 1)], c.schema)).withColumn("gathered", F.lit(3))
    more = url_filter.as_of(again, e)
    assert more.count() == 2 * c.count() + 1 and more.where("page_id = 500 AND blocked AND gathered = 3").count() == 1
    assert url_filter.as_of(c.limit(0), e).count() == 0 and url_filter.as_of(c, e.limit(0)).where("blocked").count() == 0


def test_url_filter_hot_host(spark, monkeypatch):
    """A host with nearly all captures is split where the list is too large to be broadcast: same rows."""
    import datetime as dt

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    start = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([("hot.com", start + dt.timedelta(days=10), True), ("hot.com", start + dt.timedelta(days=20), False)], "key string, listed_at timestamp_ntz, listed boolean")
    c = spark.createDataFrame([(i, "http://hot.com/" + str(i) if i % 50 else f"http://h{i}.org", start + dt.timedelta(hours=i)) for i in range(800)], "page_id long, url string, fetched_at timestamp_ntz")
    got = {r.page_id: r.blocked for r in url_filter.as_of(c, e).collect()}
    assert got == {i: bool(i % 50) and 240 <= i < 480 for i in range(800)}


def test_spotsigs(docs, none, rows, spark):
    real = sorted([*rows, rows[3]], key=lambda r: (r[0] is None, -(r[0] or 0)))
    got = spotsigs.compared(docs).collect()
    want = []
    for k, r in enumerate(real):
        t, nxt = r[1] or "", real[(k + 1) % len(real)][1] or ""
        q = len(t) // 3
        want.append((r[0], t[: len(t) - q] + nxt[:q]))
    assert sorted(((r.id, r.edited) for r in got), key=str) == sorted(want, key=str)
    assert spotsigs.compared(none).count() == 0
    one = spotsigs.compared(spark.createDataFrame([(4, "abc")], "doc_id long, text string")).first()
    assert one.edited == "aba"
    s = spark.createDataFrame([("the cat of dogs",), ("The cat, of dogs!",), ("the cat of mice",), (None,)], "t string").select(spotsigs.signatures(F.col("t")).alias("s")).collect()
    assert s[0] == s[1] and len(s[0].s) == 2 and len(set(s[0].s) & set(s[2].s)) == 0 and s[3].s == []
    pairs, members = spotsigs.similar(docs, 0.6)
    sigs = {r.id: set(r.s) for r in docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), spotsigs.signatures(F.col("text")).alias("s")).collect()}
    rep = {r.id: r.rep for r in members.collect()}
    near = {(a, b) for a in sigs for b in sigs if a < b and rep[a] == a and rep[b] == b and sigs[a] and sigs[b] and len(sigs[a] & sigs[b]) / len(sigs[a] | sigs[b]) >= 0.6}
    assert {(r.x, r.y) for r in pairs.collect()} == near and near


def chains_of(t):
    """The signatures of a text as chains of words, by a loop over its words."""
    words_ = [w for w in re.split("[ \t\n\r\x0b\x0c]", (t or "").lower()) for w in [w.translate({ord(m): None for m in spotsigs.MARKS})] if w]
    out, last = set(), "^"
    for i, w in enumerate(words_):
        if w in spotsigs.ANCHORS:
            last = w
        elif last is not None:
            out.add((last, w, next((x for x in words_[i + 1 :] if x not in spotsigs.ANCHORS), None)))
            last = None
    return out


@pytest.mark.parametrize("tasks", [1, 7])
def test_op7_query(spark, tmp_path, monkeypatch, tasks):
    """All seven columns, with signatures by brute force; ids with gaps, far apart and negative, over many ranges."""
    monkeypatch.setattr(spotsigs, "TASK_BYTES", 4000 if tasks > 1 else 1 << 30)
    r = random.Random(6)
    say = lambda n: "".join(r.choice("the The of a und el |".split() + ["cat", "dog, ", "Mouse!", "x-ray", "é"]) + r.choice(" \n") for _ in range(n))
    texts = [say(r.randint(0, 60)) for _ in range(150)] + ["", None, "the of", "|", "cat " * 5000]
    ids = r.sample(range(-500, 1 << 40), len(texts) - 1) + [-(1 << 63)]
    spark.createDataFrame(list(zip(ids, texts, ["k"] * 999)), "doc_id long, text string, next string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    order = sorted(zip(ids, [t or "" for t in texts]), reverse=True)
    known: dict = {}
    alike = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    got = {x.doc_id: x for x in queries.QUERIES["op7_spotsigs"](spark, str(tmp_path)).collect()}
    assert len(got) == len(ids)
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        q = len(t) // 3
        edited = t[: len(t) - q] + nxt[:q]
        x, mine = got[i], chains_of(t)
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert x.near_edited == pytest.approx(alike(mine, chains_of(edited))) and x.near_next == pytest.approx(alike(mine, chains_of(nxt)))
        assert known.setdefault(x.fingerprint, mine) == mine and known.setdefault(x.edited_fingerprint, chains_of(edited)) == chains_of(edited)
    assert len(known) == len({frozenset(v) for v in known.values()})


def luhn(s):
    d = [int(c) * (2 if k % 2 else 1) for k, c in enumerate(reversed(s))]
    return sum(x - 9 if x > 9 else x for x in d) % 10 == 0


def spans_of(t):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for o, (k, p) in enumerate(kinds.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if k == "email" or k == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or k == "card" and 14 <= len(d) <= 19 and luhn(d) or k == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), o, k, m.end()))
    return ",".join(f"{k}:{a}:{z}" for a, _, k, z in sorted(out))


def test_pii_spans(spark):
    r = random.Random(4)
    bits = ["a@b.cd", "a@b.cd_x@e.f", "@", "x@y", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "000255.1.1.01", "4111 1111 1111 1111", "4111-1111-1111-1112", "41111111111111110", "+1 (017) 555-7713", "+123", "+1 2 3 4 5 6 7 8 9 0", "é", " ", "\x01", "-", "9", "12  34", "w" * 50, "\n", "ß.x@y-z.q."]
    texts = ["".join(r.choice(bits) + r.choice(["", " ", "-", "."]) for _ in range(r.randint(1, 12))) for _ in range(400)] + [None, "", "a" * 200_000, "1" * 100_000, "4111111111111111 " * 500]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.s for x in pii.with_spans(d, support=10**9).select("doc_id", pii.listed(F.col("base")).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == ("" if t and len(t) >= 100_000 else spans_of(t)), t[:200]  # the long ones have no spans


def terms_of(texts, disclosure=0.8, support=3):
    """Term spans by brute force: {row: {(start, end)}}."""
    marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    plain = lambda w: w.lower().translate({ord(m): None for m in marks})
    parts, of = [], []  # contexts: (row, start, end)
    for i, t in enumerate(texts):
        parts += [(i, m.start(), m.end()) for m in re.finditer(r"(?s).{1,400}[^\x20\x09-\x0D]*", t or "")]
    held, term = [], []
    for i, a, z in parts:
        term.append({w for w in map(plain, re.split(r"[\x20\x09-\x0D]", texts[i][a:z])) if len(w) >= 3})
        held.append(set())
    base = {i: [(int(x.split(":")[1]), int(x.split(":")[2]), x.split(":")[0]) for x in spans_of(t).split(",") if x] for i, t in enumerate(texts)}
    for k, (i, a, z) in enumerate(parts):
        for s, e, kind in base[i]:
            if s < z and a < e:
                v = texts[i][s:e]
                held[k].add((kind, re.sub("[^0-9]", "", v) if kind in ("card", "phone") else v.lower()))
    n, out = len(parts), defaultdict(set)
    for e in {e for h in held for e in h}:
        mine = [k for k in range(n) if e in held[k]]
        for t in {t for k in mine for t in term[k]}:
            both = [k for k in mine if t in term[k]]
            if len({texts[parts[k][0]] for k in both}) < support or len(mine) == n:
                continue
            n_t = sum(t in x for x in term)
            if n_t <= len(both) * (n / len(mine)) ** (1 - disclosure) * (1 + 1e-12):
                for i in {parts[k][0] for k in both}:
                    for m in re.finditer(r"[^\x20\x09-\x0D]+", texts[i]):
                        core = m[0].strip(marks)
                        at = m.start() + len(m[0]) - len(m[0].lstrip(marks))
                        if core and plain(core) == t and not any(s < at + len(core) and at < z for s, z, _ in base[i]):
                            out[i].add((at, at + len(core)))
    return out


def pii_texts():
    r = random.Random(8)
    word = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(word) for _ in range(n))
    texts = []
    for i in range(60):
        person = i % 6
        t = say(r.randint(5, 150))
        if i % 2:  # a name, an employer that others share, and the address; sometimes far apart
            t += f" Zorblat{person}, of Acme{person % 2}! wrote ann{person}@mail.com about +1 (555) 000-000{person} " + say(r.randint(0, 90)) + f" (zorblat{person})"
        texts.append(t)
    texts += [texts[1], texts[1], "un" + "x" * 395 + "believable ann1@mail.com", None, "", "ann1@mail.com", "4111 1111 1111 1111 zorblat1"]
    return texts


@pytest.mark.parametrize("prune", [True, False])
def test_pii_terms(spark, prune):
    texts = pii_texts()
    want = terms_of(texts)
    d = spark.createDataFrame([(i, t, "b", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, base string, uid int, th int").repartition(3)
    got = {r.doc_id: r for r in pii.with_spans(d, prune=prune).collect()}
    assert len(got) == len(texts) and got[0].uid == 1 and got[0].th == 2
    assert {i: {(s.start, s.end) for s in r.spans if s.kind == "term"} for i, r in got.items()} == {i: want.get(i, set()) for i in got}
    assert len(want) >= 10 and "zorblat1" in {texts[i][s:e].lower() for i in want for s, e in want[i]}
    for i, r in got.items():
        assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.base) == spans_of(texts[i])


def test_pii_sanitised(spark):
    texts = pii_texts()
    d = spark.createDataFrame([(i, t, "kept", 7) for i, t in enumerate(texts)], "doc_id long, text string, spans string, n int").repartition(3)
    found = {r.doc_id: r.spans for r in pii.with_spans(d.drop("spans")).collect()}
    clean = pii.sanitised(d)
    assert clean.columns == d.columns
    for r in clean.collect():
        assert (r.spans, r.n) == ("kept", 7)
        if texts[r.doc_id] is None:
            assert r.text is None
            continue
        out, at = "", 0
        for s in found[r.doc_id]:
            if s.start >= at:
                out += texts[r.doc_id][at : s.start] + (f"[{s.kind.upper()}]" if s.kind != "term" else "[NUMBER]" if re.search("[0-9]", s.value) else "[TERM]")
            at = max(at, s.end)
        assert r.text == out + texts[r.doc_id][at:]
    assert pii.sanitised(d.limit(0)).count() == 0
    gone = pii.sanitised(d, remove_terms=True).where("text LIKE '%[TERM]%' OR text LIKE '%[NUMBER]%'")
    assert gone.isEmpty()


def test_pii_many_spans(spark):
    """100,000 spans in one text."""
    text = " ".join(f"u{i}@mail.com, +1 555 000 {i:05d}; 10.0.{i % 250}.{i % 199}" for i in range(33_334))
    d = spark.createDataFrame([(1, text), (2, "none")], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in pii.sanitised(d).collect()}
    assert got[2].text == "none" and got[1].text == " ".join(["[EMAIL], [PHONE]; [IP]"] * 33_334)
    assert time.time() - began < 90


def test_op8_query(spark, tmp_path):
    texts = pii_texts()
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = terms_of(texts)
    got = {r.doc_id: r for r in queries.QUERIES["op8_pii"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, r in got.items():
        base = spans_of(texts[i])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        every = [(int(x.split(":")[1]), pii.KINDS.index(x.split(":")[0]), x) for x in base.split(",") if x] + [(s, 4, f"term:{s}:{e}") for s, e in want.get(i, ())]
        assert r.spans == ",".join(x for *_, x in sorted(every))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [base.count(k + ":") for k in pii.KINDS]


def test_quality(spark):
    r = random.Random(2)
    common_ = "the of and to in is it that for was".split()
    rows_, truth = [], {}
    for i in range(1500):
        w = [r.choice(common_) if r.random() < 0.4 else "".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(3, 8))) for _ in range(r.randint(30, 120))]
        bad = i % 8 == 0
        if bad:
            w = [[x + "###" for x in w], [x.upper() + "!!" for x in w], [x for x in w for _ in range(2)][:3] * 30, [x + " |" for x in w]][i // 8 % 4]
        rows_.append((i, " ".join(w) + ".", 1.0))
        truth[i] = not bad
        rows_[-1] = (i, re.sub(r"(\w+ \w+ \w+ \w+ \w+ \w+)( )", r"\1. ", rows_[-1][1]) if not bad else rows_[-1][1], 1.0)
    d = spark.createDataFrame(rows_ + [(5000, None, 0.0), (5001, "", 0.0)], "doc_id long, text string, quality_score double")
    model = quality.fit(d.where("doc_id % 3 <> 1"))
    held = {x.doc_id: x.quality_keep for x in quality.scored(d, model).collect()}
    assert len(held) == 1502 and not held[5000] and not held[5001]
    test = [i for i in truth if i % 3 == 1]
    assert sum(held[i] == truth[i] for i in test) / len(test) > 0.97
    empty = d.limit(0)
    assert quality.scored(empty, quality.fit(empty)).count() == 0


def contaminated(rows_, items):
    wd = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    wins = defaultdict(set)
    for i, t in items:
        w = wd(t)
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            wins[tuple(w[a : a + k])].add("" if i is None else str(i))
    out = []
    for i, t in rows_:
        w, hit, ids = wd(t), set(), set()
        for n in {len(x) for x in wins}:
            for a in range(len(w) - n + 1):
                s = wins.get(tuple(w[a : a + n]))
                if s:
                    ids |= s
                    hit |= set(range(a, a + n))
        out.append((i, len(w), len(hit), sorted(ids)))
    return sorted(out, key=str)


def test_decontamination(spark, docs, none, rows):
    long = next(r[1] for r in rows if r[1] and len(r[1].split()) > 60)
    items = [(1, " ".join(long.split()[5:25]).translate({v: k for k, v in LOWER.items()})), (2, "one"), (10, "a a a a a a a a a a a"), (3, None), (4, "?!"), (5, "nowhere to be found"), (None, "One, Two"), (2, "One two three")]
    b = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, n_words int")
    got = decontamination.contamination(docs, b).collect()
    assert sorted(((r.id, r.n_words, r.n_hit, r.items) for r in got), key=str) == contaminated([(r[0], r[1]) for r in [*rows, rows[3]]], items)
    assert sum(r.n_hit > 0 for r in got) >= 3
    clean = decontamination.clean(docs, b)
    assert clean.columns == docs.columns and clean.count() == sum(r.n_hit == 0 for r in got)
    assert decontamination.contamination(none, b).count() == 0
    assert decontamination.contamination(docs, b.limit(0)).where("n_hit > 0").count() == 0


def test_proximity(spark):
    d = spark.createDataFrame([(1, "x b y a z c"), (2, "a b c"), (3, "a x x x x b c"), (4, None)], "doc_id long, text string")
    q = decontamination.item_windows(spark.createDataFrame([(1, "a b c")], "item_id long, text string"))
    r, m = decontamination.proximity_matches(d, q, 5)
    got = {x.id: (x.start, x.end) for x in r.join(m, "seq").collect()}
    assert got == {1: (1, 6), 2: (0, 3)}


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "x long, y long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_words_across_pieces(monkeypatch):
    import pyarrow as pa

    texts = ["aa bb " * 40, None, "", "c" * 300 + " d", "ee", " f ", "ggé hh" * 9]
    whole = [h.tolist() for _, _, _, h in textnum.PLAIN.blocks(pa.array(texts))]
    monkeypatch.setattr(textnum, "PIECE", 16)
    small = [h.tolist() for _, _, _, h in textnum.PLAIN.blocks(pa.array(texts), most=10)]
    assert sum(small, []) == sum(whole, [])
    _, _, counts, _ = next(textnum.PLAIN.blocks(pa.array(texts)))
    assert counts.tolist() == [len(words(t)) for t in texts]


def test_bitmap(spark):
    import numpy as np

    d = spark.createDataFrame([(i * 7919,) for i in range(500)] + [(None,), (-5,)], "k long")
    b = common.bitmap(d, "k", 16)
    assert common.in_bitmap(b, np.array([i * 7919 for i in range(500)] + [-5])).all()
    assert common.in_bitmap(b, np.arange(10**6, 10**6 + 5000)).mean() < 0.05


def test_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_pipeline(spark, tmp_path):
    """The stages over a small corpus: each stage's decisions against what its operator's own brute force says."""
    import corpus_pipeline

    r = random.Random(9)
    known = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(300)] + "the of and to in is it".split() * 20
    text = lambda n: ". ".join(" ".join(r.choice(known) for _ in range(8)) for _ in range(n)) + "."
    item = " ".join(r.choice(known) for _ in range(14))
    data = [(i, text(12)) for i in range(60)]
    near = data[3][1].split()
    near[50] = "changed"
    data += [(60, " ".join(near)), (61, data[5][1]), (62, text(4) + " " + item + " " + text(3)), (63, text(5) + " mail bob@site.org now. " + text(2)), (64, " | ".join(text(12).split()) + " |"), (65, "")]
    d = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got, docs_ = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        docs_, _ = common.write_table(stage(spark, docs_, str(tmp_path)), "test")
        got[name] = {x.doc_id: x for x in docs_.collect()}
        if name != "mixing sources":
            assert docs_.columns == d.columns
    gone = [set(a) - set(b) for a, b in zip([dict(data), *got.values()], got.values())]
    assert gone == [{64, 65}, {60, 61}, {62}, set(), set(dict(data)) - {60, 61, 62, 64, 65} - set(got["mixing sources"])]
    assert "[EMAIL]" in got["PII"][63].text and got["PII"][63].n_chars == len(got["PII"][63].text)
    assert {(x.doc_id, x["copy"]) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {(x.doc_id, x["copy"]) for x in docs_.collect()}
    assert all(x["copy"] <= x.copies <= 2 for x in docs_.collect())


def em_by_loops(codes, counts, rounds, start, share):
    """The label model by plain loops over vote patterns, from the same start."""
    prior, tables = start
    first = [[list(t) for t in k] for k in tables]
    total = sum(counts)
    for _ in range(rounds):
        sums = [[[share[c] * total * x for c_, x in [(c, y) for y in first[k][c]]] for c in range(2)] for k in range(len(tables))]
        good = 0.0
        for code, n in zip(codes, counts):
            like = [1 - prior, prior]
            for k in range(len(tables)):
                for c in range(2):
                    like[c] *= tables[k][c][code // 3**k % 3]
            p = like[1] / (like[0] + like[1])
            good += n * p
            for k in range(len(tables)):
                sums[k][0][code // 3**k % 3] += n * (1 - p)
                sums[k][1][code // 3**k % 3] += n * p
        tables = [[[x / sum(t) for x in t] for t in k] for k in sums]
        prior = min(0.95, max(0.05, good / total))
        first = first
    return prior, tables


def test_label_model_estimates_accuracies():
    """Posteriors and tables equal those of plain loops, and known accuracies of simulated labellers come out."""
    r = np.random.default_rng(4)
    truth = r.random(30_000) < 0.75
    accuracy = [(0.8, 0.02), (0.6, 0.05), (0.7, 0.01), (0.5, 0.03)]
    v = [np.where(r.random(len(truth)) < np.where(truth, g, b), 1, 0) for b, g in accuracy]
    codes, counts = np.unique(sum(x * 3**k for k, x in enumerate(v)), return_counts=True)
    model = quality.fit_labels(codes, counts, len(v), share=(0.001, 0.001))  # of the start hardly anything stays
    for k, (bad, good) in enumerate(accuracy):
        assert abs(model.tables[k, 0, 1] - bad) < 0.06 and abs(model.tables[k, 1, 1] - good) < 0.03, model.tables[k]
    assert abs(model.prior - 0.75) < 0.03
    few = quality.fit_labels(codes, counts, len(v), rounds=3)
    start = quality.start_tables(codes, counts, len(v))
    prior, tables = em_by_loops(codes.tolist(), counts.tolist(), 3, (quality.PRIOR, start.tolist()), quality.PRIOR_SHARE)
    assert np.allclose(few.tables, tables) and few.prior == pytest.approx(prior)


def test_quality_without_ids_and_with_copies(spark):
    """Null ids, repeated rows and more rows than are fitted: junk is rejected whatever part of the texts is sampled."""
    r = random.Random(3)
    say = lambda: ". ".join(" ".join(r.choice("the of and to in is it that cat dog house river stone green".split()) for _ in range(8)) for _ in range(6)) + "."
    good, junk = [say() for _ in range(200)], ["### $$$ %%% &&& " * 20 + str(i) for i in range(40)]
    rows_ = [(None, t, 1, 0.5) for t in good + junk] + [(None, junk[0], 1, 0.5)] * 300
    d = spark.createDataFrame(rows_, "doc_id long, text string, h int, quality_score double")
    for fit_rows in (60, 10_000):
        got = quality.scored(d, quality.fit(d, fit_rows=fit_rows)).collect()
        assert len(got) == len(rows_)
        assert not any(x.quality_keep for x in got if x.text.startswith("#")) and sum(x.quality_keep for x in got) == len(good), fit_rows


def test_op9_query(spark, tmp_path):
    """The query's votes against the labellers by words, and its posteriors against the label model by loops."""
    r = random.Random(5)
    say = lambda: " ".join(r.choice("the of and to cat dog river A B 12 x| ##".split()) + r.choice(["", "", "."]) for _ in range(r.randint(0, 80)))
    texts = [say() for _ in range(300)] + [None, "", "Z" * 50_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x for x in queries.QUERIES["op9_quality"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    want = {}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
        n, k, letters = max(1, len(t.encode())), max(1, len(w)), max(1, len(re.findall("[A-Za-z]", t)))
        long, empty = len(w) >= 20, not w
        share = sum(x in quality.COMMON for x in w) / k
        ends = t.count(".") / k
        bad = [empty or len(re.findall(r"[#$%&*=<>{}\[\]\\^~_@|!]", t)) / n > 0.06, long and len(re.findall("[A-Z]", t)) / letters > 0.4, long and 1 - len(set(w)) / k > 0.8, t.count("|") / k > 0.2, empty or long and share < 0.04, empty or sum(len(x.encode()) for x in w) / k > 20, long and ends < 0.004, long and len(re.findall("[0-9]", t)) / n > 0.2]
        fine = {4: long and share > 0.15, 6: long and 0.02 < ends < 0.6}
        want[i] = sum((1 if b else 2 if fine.get(j) else 0) * 3**j for j, b in enumerate(bad))
    assert {i: x.quality_votes for i, x in got.items()} == want
    codes, counts = np.unique(list(want.values()), return_counts=True)
    model = quality.fit_labels(codes, counts)
    prior, tables = em_by_loops(codes.tolist(), counts.tolist(), 60, (quality.PRIOR, quality.start_tables(codes, counts).tolist()), quality.PRIOR_SHARE)
    assert np.allclose(model.tables, tables, atol=1e-2)
    for i, x in got.items():
        assert x.quality_posterior == pytest.approx(float(model.posterior(np.array([want[i]]))[0])) and x.quality_keep == (x.quality_score >= 0.5)


def test_features_of_whole_texts_summed():
    texts = pa.array(["one two two one two", "", None, "word " * 5000 + "tail", "one"])
    for _, _, f, n, h in quality.features(texts):
        index, value, per = quality.hashed(f, n, h)
        less = quality.summed(index, value, per)
        w = np.random.default_rng(1).normal(size=1 << quality.WEIGHT_BITS)
        assert less[2].sum() < per.sum() and len(less[2]) == len(per)
        assert np.allclose(quality.linear(index, value, per, w, 0.1), quality.linear(*less, w, 0.1))


def test_substring_hot_anchor(spark, monkeypatch):
    """One anchor with more different segments than a shard's share: taken apart, with the result of one index."""
    r = random.Random(2)
    monkeypatch.setattr(common, "FEW_ROWS", 5)
    rows_ = [(i, " ".join([f"l{r.randrange(2)}" for _ in range(9)] + "hot words that are all over".split() + [f"r{r.randrange(2)}" for _ in range(9)])) for i in range(200)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string").repartition(3)
    first, want = {}, {}
    for i, t in rows_:
        w, gone = t.split(), set()
        for a in range(len(w) - 12):
            if first.setdefault(tuple(w[a : a + 13]), i) < i:
                gone |= set(range(a, a + 13))
        want[i] = (len(w), len(gone))
    assert {x.id: (x.n_words, x.n_removed) for x in substring_dedup.kept(docs).collect()} == want
    assert 20 < sum(n > 0 for _, n in want.values()) < 200


def test_substring_hot_passage(spark):
    """A passage that stands in most documents is split over many parts: the result is that of one shard."""
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"a{i} b{i} {passage} c{i} " + " ".join(f"d{i % 7}x{j}" for j in range(20))) for i in range(300)] + [(300, None), (None, passage), (5, "a5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), {}
    try:
        for shards in ("1", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", shards)
            got[shards] = sorted(map(str, substring_dedup.kept(docs).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got["1"] == got["40"] and len(got["1"]) == len(rows)
    removed = {r.id: (r.n_words, r.n_removed) for r in substring_dedup.kept(docs.where("doc_id <> 5")).collect()}
    assert removed[0] == (63, 0) and removed[1] == (63, 40) and removed[299] == (63, 60) and removed[300] == (0, 0)
