"""Information-theoretic sanitisation of personal data, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Base kinds in their order, with patterns that find the leftmost matches without running back over a text.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # A whole run of digits with single separators that has 14 to 19 digits: other runs fail in any case.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)|0+)"
NEED = {"email": "@", "ip": ".", "phone": "+"}
#: Characters of a context at least, but for a text's last one: contexts end with a word.
CONTEXT = 400
#: A term reveals an entity if their pointwise mutual information is this share of the entity's information content ...
DISCLOSURE = 0.8
#: ... and it met the entity in so many different texts.
SUPPORT = 3
#: Characters of the pieces in which texts are looked at while they are rebuilt.
PIECE = 2048
SPAN = "array<struct<start:int,ord:int,kind:string,end:int,value:string>>"
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


_DIGITS = "regexp_replace(value, '[^0-9]', '')"
#: Which matches are personal data.
VALID = {
    "email": "true",
    "ip": f"value RLIKE {common.text_sql(rf'^{_PART}(?:[.]{_PART}){{3}}$')}",
    "card": f"length({_DIGITS}) BETWEEN 14 AND 19 AND luhn_check({_DIGITS})",
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
}


def kind_spans(text: str, kind: str) -> str:
    """SQL for the spans of one base kind in the text that is SQL itself: matches are marked, the text is cut at the marks,
    and lengths give the places."""
    mark = "\x01"
    pieces = f"split(regexp_replace(translate({text}, '{mark}', '\x02'), {common.text_sql(PATTERNS[kind])}, '{mark}$0{mark}'), '{mark}')"
    lengths = "transform(sequence(0, CAST((size(p) - 3) / 2 AS INT)), k -> length(p[2 * k]) + length(p[2 * k + 1]))"
    span = common.let_sql("p[2 * k + 1]", "value", f"named_struct('start', before + length(p[2 * k]), 'ord', {KINDS.index(kind)}, 'kind', '{kind}', 'end', before + length(p[2 * k]) + length(value), 'value', value)")
    found = f"filter(transform({common.running_sql(lengths)}, (before, k) -> {span}), m -> {common.let_sql('m.value', 'value', VALID[kind])})"
    may = f"contains({text}, '{NEED[kind]}')" if kind in NEED else f"{text} RLIKE '[0-9](?:[ -]?[0-9]){{13}}'"
    return f"CASE WHEN {may} THEN {common.let_sql(pieces, 'p', f'CASE WHEN size(p) > 1 THEN {found} ELSE CAST(array() AS {SPAN}) END')} ELSE CAST(array() AS {SPAN}) END"


def base_spans(text: str) -> Column:
    """All base spans of the text in this column by start, then kind; places are code points, end exclusive. Null: none."""
    return F.expr(common.let_sql(f"coalesce(CAST(`{text}` AS STRING), '')", "t", "array_sort(concat(" + ", ".join(kind_spans("t", k) for k in KINDS) + "))"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def contexts(text: Column) -> Column:
    """A text's contexts, from its start: CONTEXT characters and on to the end of the word, the last as long as is left."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CONTEXT}}}[^\x20\x09-\x0D]*+"), F.lit(0))


#: Where the contexts in column c begin.
_OFFSETS = common.running_sql("transform(c, y -> length(y))")


def _plain(word: Column) -> Column:
    return F.translate(F.lower(word), _MARKS, "")


def _terms(context: Column) -> Column:
    """Distinct words, lower-cased and without ASCII punctuation, of three letters or more."""
    return F.array_distinct(F.filter(F.split(_plain(F.translate(context, "\t\n\r\x0b\x0c", "     ")), " "), lambda x: F.length(x) >= 3))


def _entity(s: Column) -> Column:
    """Entities are equal if their kind and their value are, numbers by their digits."""
    return F.xxhash64(s["kind"], F.when(s["kind"].isin("card", "phone"), F.regexp_replace(s["value"], "[^0-9]", "")).otherwise(F.lower(s["value"])))


def _cells(start, end) -> Column:
    """The stretches of CONTEXT characters, by number, that [start, end) touches."""
    at = lambda x: F.floor(x / CONTEXT).cast("int")
    return F.sequence(at(F.col(start)), at(F.greatest(F.col(start), F.col(end) - 1)))


def revealing(rows: DataFrame, corpus: DataFrame, found: DataFrame, total: int, disclosure: float, support: int, prune: bool = True) -> tuple[DataFrame, DataFrame] | None:
    """Which terms reveal which entities: (met, pairs), or None if no entity is in `support` different texts.

    rows: (uid, t) of the texts with entities; corpus: (t) of all; found: (uid, th, e, start, end), a row for every entity's
    place, th a hash of its text; total: all contexts of the corpus. met has (uid, k, e, th, t) for every context k of a
    text that an entity of `support` texts touches, pairs (e, term) those that with_spans() calls revealing.

    A term's contexts among those of entities are a part of all its contexts, so a pair whose term has too many there
    already can't reveal and goes before the corpus is counted (`prune` turns that off; results are the same).
    """
    often = found.groupBy("e").agg(F.count_distinct("th").alias("k")).where(F.col("k") >= support).select("e")
    often, _ = common.write_table(often, "entities")
    if often.isEmpty():
        return None
    place = common.split_join(found, often, ["e"], "left_semi")
    place, _ = common.write_table(place, "places")
    mine, _ = common.write_table(place.select("uid").distinct(), "texts")
    texts = common.split_join(rows, mine, ["uid"], "left_semi").select("uid", contexts(F.col("t")).alias("c"))
    each = texts.select("uid", F.posexplode(F.arrays_zip(F.col("c").alias("t"), F.expr(_OFFSETS).alias("off"))).alias("k", "z"))
    each, _ = common.write_table(each.select("uid", "k", "z.t", "z.off"), "contexts")
    near = each.select("uid", "k", "t", "off", (F.col("off") + F.length("t")).alias("upto")).withColumn("cell", F.explode(_cells("off", "upto")))
    at = place.select("uid", "th", "e", "start", "end", F.explode(_cells("start", "end")).alias("cell"))
    met = near.join(at, ["uid", "cell"]).where("start < upto AND off < end").groupBy("uid", "k", "e", "th").agg(F.first("t").alias("t"))
    met, _ = common.write_table(met, "met")
    terms = F.explode(_terms(F.col("t"))).alias("term")
    n_e = met.groupBy("e").agg(F.count("*").alias("n_e"))
    pairs = met.select("e", "th", terms).groupBy("e", "term", "th").agg(F.count("*").alias("c")).groupBy("e", "term").agg(F.sum("c").alias("n_et"), F.count("*").alias("texts")).where(F.col("texts") >= support)
    # PMI >= disclosure * IC in terms of the term's contexts.
    most = F.col("n_et") * F.pow(F.lit(float(total)) / F.col("n_e"), 1 - disclosure) * (1 + 1e-12)
    n_e, _ = common.write_table(n_e, "entities")
    pairs, _ = common.write_table(pairs, "pairs")
    pairs = common.split_join(pairs, n_e, ["e"]).where(F.col("n_e") < total).select("e", "term", most.alias("most"))
    if prune:
        own = met.groupBy("uid", "k").agg(F.first("t").alias("t")).select(terms).groupBy("term").agg(F.count("*").alias("n"))
        pairs, _ = common.write_table(pairs, "pairs")
        own, _ = common.write_table(own.join(pairs.select("term").distinct(), "term", "left_semi"), "terms")
        pairs = common.split_join(pairs, own, ["term"]).where("n <= most").drop("n")
    pairs, _ = common.write_table(pairs, "pairs")
    wanted, _ = common.write_table(pairs.select("term").distinct(), "terms")
    every = corpus.select(F.explode(contexts(F.col("t"))).alias("t")).select(terms)
    if wanted.count() <= common.BROADCAST_ROWS:
        n_t = every.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
    else:  # summed in each task before they are dealt
        n_t = every.groupBy("term").agg(F.count("*").alias("n_t")).join(wanted, "term", "left_semi")
    n_t, _ = common.write_table(n_t, "terms")
    sure, _ = common.write_table(common.split_join(pairs, n_t, ["term"]).where("n_t <= most").select("e", "term"), "revealing")
    return met, sure


def term_spans(met: DataFrame, sure: DataFrame, rows: DataFrame, found: DataFrame) -> DataFrame:
    """(uid, spans) of kind "term" for the pairs of revealing(): where a term that met its entity in a text stands in that text."""
    pairs = met.select("uid", "e", F.explode(_terms(F.col("t"))).alias("term")).distinct()
    pairs, _ = common.write_table(pairs, "met")
    wanted, _ = common.write_table(common.split_join(pairs.select("uid", "e", "term"), sure, ["e", "term"], "left_semi").select("uid", "term").distinct(), "wanted")
    mine, _ = common.write_table(wanted.select("uid").distinct(), "texts")
    texts = common.split_join(rows, mine, ["uid"], "left_semi").select("uid", contexts(F.col("t")).alias("c"))
    each = texts.select("uid", F.explode(F.arrays_zip(F.col("c").alias("t"), F.expr(_OFFSETS).alias("off"))).alias("z")).select("uid", "z.off", F.split("z.t", r"[\x20\x09-\x0D]").alias("w"))
    each = each.select("uid", F.explode(F.arrays_zip(F.col("w").alias("w"), F.expr(f"transform({common.running_sql('transform(w, y -> length(y) + 1)')}, n -> off + n)").alias("at"))).alias("z"))
    core = F.trim(F.col("z.w"), F.lit(_MARKS))
    word = each.select("uid", core.alias("core"), (F.col("z.at") + F.length("z.w") - F.length(F.ltrim(F.col("z.w"), F.lit(_MARKS)))).cast("int").alias("start")).where("core <> ''")
    word = word.withColumn("term", _plain(F.col("core"))).join(wanted, ["uid", "term"]).select("uid", "start", (F.col("start") + F.length("core")).alias("end"), "core")
    word, _ = common.write_table(word, "words")
    a = word.select("uid", "start", "end", F.explode(_cells("start", "end")).alias("cell"))
    b = common.split_join(found.select("uid", "start", "end"), mine, ["uid"], "left_semi").select("uid", F.col("start").alias("s"), F.col("end").alias("z"), F.explode(_cells("start", "end")).alias("cell"))
    inside = a.join(b, ["uid", "cell"]).where("s < end AND start < z").select("uid", "start").distinct()
    span = F.struct("start", F.lit(len(KINDS)).alias("ord"), F.lit(TERM).alias("kind"), "end", F.col("core").alias("value"))
    return word.join(inside, ["uid", "start"], "left_anti").groupBy("uid").agg(F.collect_list(span).cast(SPAN).alias("spans"))


def with_spans(docs: DataFrame, text: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT, texts: bool = True, prune: bool = True, names: tuple[str, str] = ("base", "spans")) -> DataFrame:
    """docs with two arrays of (start, ord, kind, end, value), `base` and `spans` (see names); columns of those names are
    replaced. Without `texts`, the text is null where there are no spans, and less is written.

    base holds emails, addresses, cards and phone numbers of the whole text. For every entity the corpus says which terms
    reveal it. Each text is cut into contexts (see contexts()) that hold whole words, and everything is counted in
    contexts: of all N, n_e touch the entity, n_t have the term, and n_et both. With information content
    IC = log(N / n_e) and pointwise mutual information PMI = log(n_et * N / (n_e * n_t)), a term with
    PMI >= disclosure * IC that meets the entity in `support` different texts is revealing. Where it meets the entity in a
    text, every place in that text where it stands as a word becomes a span of kind "term"; places inside base spans don't.

    All counts cover all rows. An entity that is in fewer than `support` different texts has no revealing terms. A null or
    empty text has no spans. Rows with equal ids or texts are rows of their own, but equal texts count once for `support`.
    Very long texts take time in proportion to their length and the root of their number of spans. No rows give no rows.
    """
    base, spans = names
    mine = [c for c in docs.columns if c not in names]
    uid, added, n, th = common.free_names([*mine, *names], "uid", "added", "n", "th")
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    d = docs.select(*mine).withColumn(uid, F.monotonically_increasing_id()).withColumn(base, base_spans(text)).withColumn(n, F.size(contexts(whole))).withColumn(th, F.xxhash64(text))
    if not texts:
        d = d.withColumn(text, F.when(F.size(base) > 0, F.col(text)))
    rows, at_rows = common.write_table(d, "spans")
    total = rows.agg(F.sum(n)).first()[0] or 0
    real = rows.where(F.size(base) > 0).select(F.col(uid).alias("uid"), F.col(text).cast("string").alias("t"), F.col(base).alias("b"), F.col(th).alias("th"))
    found = real.select("uid", "th", F.explode("b").alias("s")).select("uid", "th", _entity(F.col("s")).alias("e"), "s.start", "s.end")
    with common.dropping(at_rows) as kept:
        found, _ = common.write_table(found, "entities")
        got = revealing(real.select("uid", "t"), (rows if texts else docs).select(F.col(text).cast("string").alias("t")), found, total, disclosure, support, prune)
        if got is None:
            return rows.withColumn(spans, F.col(base)).drop(uid, n, th)
        more, at = common.write_table(term_spans(*got, real.select("uid", "t"), found).select(F.col("uid").alias(uid), F.col("spans").alias(added)), "added")
        kept.append(at)
    return rows.join(more, uid, "left").withColumn(spans, F.when(F.col(added).isNull(), F.col(base)).otherwise(F.array_sort(F.concat(base, added)))).drop(uid, added, n, th)


def sanitised(docs: DataFrame, text: str = "text", remove_terms: bool = False, **how) -> DataFrame:
    """docs with personal data out of the text: each span is generalised to its kind, as in [EMAIL], and revealing terms to
    [TERM] ([NUMBER] if they hold digits) or, with remove_terms, taken out. Of overlapping spans the first names the kind;
    the stretch they cover goes as a whole. Texts without spans, null and empty ones too, stay as they are, as do all other
    columns, whatever their names, and the number of rows; with_spans() says what is found."""
    names = tuple(common.free_names(docs.columns, "base", "spans"))
    d = with_spans(docs, text, names=names, **how)
    spans = names[1]
    label = f"CASE WHEN m.kind <> '{TERM}' THEN concat('[', upper(m.kind), ']') WHEN {str(remove_terms).lower()} THEN '' WHEN m.value RLIKE '[0-9]' THEN '[NUMBER]' ELSE '[TERM]' END"

    def cut(a: str, z: str) -> str:
        """The characters [a, z) of the text, whose pieces of PIECE characters are p: only those that they touch are looked at."""
        first = f"CAST(floor({a} / {PIECE}) AS INT)"
        part = f"substring(y, greatest(0, {a} - ({first} + i) * {PIECE}) + 1, least({PIECE}, {z} - ({first} + i) * {PIECE}) - greatest(0, {a} - ({first} + i) * {PIECE}))"
        return f"CASE WHEN {z} > {a} THEN array_join(transform(slice(p, {first} + 1, CAST(floor(({z} - 1) / {PIECE}) AS INT) - {first} + 1), (y, i) -> {part}), '') ELSE '' END"

    span, t = f"`{spans}`", f"CAST(`{text}` AS STRING)"
    before = common.running_sql(f"transform({span}, m -> m.end)", "greatest(s, x)")  # to where earlier spans reach
    keep = common.let_sql(before, "upto", f"array_join(transform({span}, (m, j) -> CASE WHEN m.start >= upto[j] THEN concat({cut('upto[j]', 'm.start')}, {label}) ELSE '' END), '')")
    last = common.let_sql(f"array_max(transform({span}, m -> m.end))", "e", cut("e", f"length({t})"))
    pieces = f"regexp_extract_all({t}, '(?s).{{1,{PIECE}}}', 0)"
    new = F.expr(f"CASE WHEN size({span}) > 0 THEN {common.let_sql(pieces, 'p', f'concat({keep}, {last})')} ELSE `{text}` END")
    return d.withColumn(text, new).select(*docs.columns)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents: counts of the base kinds, a digest of the base spans, and all spans as kind:start:end.

    Base spans are those of the four patterns; the method adds terms. A null text has zero counts and no spans."""
    d = with_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), texts=False)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return d.select("doc_id", *[count(k) for k in KINDS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
