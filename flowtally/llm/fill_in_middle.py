"""Fill-in-the-middle: each text is cut at two seeded places and its parts are put in another order between sentinels."""

from __future__ import annotations

import hashlib
from array import array
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from . import common

#: Begin of the prefix, of the suffix and of the middle.
SENTINELS = ("<P>", "<S>", "<M>")
CODE_POINT = r"(?s:.)"
SEED, PLAIN_FROM, SPM_BELOW = 1, 90, 20
#: Units that one match takes at most.
RUN = 1024

FIM = "n long, form string, prefix_chars long, middle_chars long, output string"
DIGESTS = "output_sha256 string, restored_sha256 string"


@lru_cache(16)
def _run(unit: str) -> regex.Pattern:
    """Up to RUN units that follow one another; each repetition's end is kept."""
    return regex.compile(f"(?:(?P<one>{unit})){{1,{RUN}}}+")


def unit_ends(text: str, unit: str = CODE_POINT) -> array:
    """The offsets (4 bytes each) at which the units of a text end, left to right; a match covers RUN of them.

    What lies between units belongs to the unit after it, what follows the last one to the rest. A unit may not be empty
    nor hold numbered references.
    """
    ends = array("I")
    for m in _run(unit).finditer(text):
        ends.extend(m.ends("one"))
    return ends


def seeds(key: str, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits: the first groups of eight hexadecimal digits of the SHA-256 of `seed:key`."""
    d = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(d[k : k + 4], "big") for k in (0, 4, 8, 12))


def rearranged(key: str, text: str, unit: str, seed: int, plain_from: int, spm_below: int, sentinels: tuple[str, str, str]) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    ends = unit_ends(text, unit)
    n = len(ends)
    h1, h2, h3, h4 = seeds(key, seed)
    if not text or h3 % 100 >= plain_from or any(s in text for s in sentinels):
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, last))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = sentinels
    if h4 % 100 < spm_below:
        return n, "spm", a, b - a, s + suffix + p + prefix + m + middle
    return n, "psm", a, b - a, p + prefix + s + suffix + m + middle


def restored_text(output: str, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """The text that rearranged() was given: parts hold no sentinel, so the first one found is the one that was put there."""
    if form == "plain":
        return output
    p, s, m = sentinels
    one, two = (s, p) if form == "spm" else (p, s)
    x, _, rest = output[len(one) :].partition(two)
    y, _, middle = rest.partition(m)
    return y + middle + x if form == "spm" else x + middle + y


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """An error unless a sentinel that follows any text without sentinels is the first to be found there."""
    for i, x in enumerate(sentinels):
        if not x or any(x.startswith(x[k:]) for k in range(1, len(x))) or any(x in y for j, y in enumerate(sentinels) if j != i):
            raise ValueError(f"sentinels must differ, not be empty, not be part of one another and not end as they begin: {x!r}")


def rearrange(key: Column, text: Column, unit: str = CODE_POINT, seed: int = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """A struct (n, form, prefix_chars, middle_chars, output) of a key and a text, both strings that aren't null."""
    check_sentinels(sentinels)

    @pandas_udf(FIM)
    def f(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([rearranged(k, t, unit, seed, plain_from, spm_below, sentinels) for k, t in zip(keys, texts, strict=True)], columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return f(key, text)


def digests(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """A struct of the SHA-256 of an output and of the text rebuilt from it and its form alone."""

    @pandas_udf(DIGESTS)
    def f(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        return pd.DataFrame([(sha(o), sha(restored_text(o, k, sentinels))) for o, k in zip(outputs, forms, strict=True)], columns=["output_sha256", "restored_sha256"])

    return f(output, form)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output.

    The cuts and the form hang on the seed and the id alone, so rows that repeat an id are cut alike (places differ with
    the texts' numbers of units); a null id counts as empty. A null or empty text gives an empty output of form plain, as
    does every text that holds a sentinel its own. Columns of docs with the names of the new ones are replaced; an empty
    table gives no rows. Each row is worked on alone: nothing is shuffled, and a batch of texts holds at most
    spark.sql.execution.arrow.maxBytesPerBatch and one text.
    """
    new = ["n", "form", "prefix_chars", "middle_chars", "output"]
    held = [c for c in docs.columns if c.lower() not in new]
    fim = common.free_names(docs.columns, "fim")[0]
    got = docs.withColumn(fim, rearrange(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit("")), **how))
    return got.select(*held, *[F.col(f"{fim}.{c}") for c in new])


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents: its units, form and cuts, and the digests of the output and of what it is rebuilt to.

    Null and empty texts are plain with empty outputs; rows that repeat an id are cut alike; no documents give none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    d = fill_in_middle(docs).withColumn("digests", digests(F.col("output"), F.col("form")))
    return d.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "digests.output_sha256", "digests.restored_sha256")


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS k1, ('0x' || h[9:16])::BIGINT % (n + 1) AS k2, ('0x' || h[17:24])::BIGINT % 100 AS k3, ('0x' || h[25:32])::BIGINT % 100 AS k4 FROM t),
v AS (SELECT *, least(k1, k2) AS a, greatest(k1, k2) AS b, CASE WHEN n = 0 OR k3 >= 90 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN k4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
w AS (SELECT *, array_slice(text, 1, a) AS p, array_slice(text, a + 1, b) AS m, array_slice(text, b + 1, n) AS s FROM v)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM w
"""
