"""Detector registry: which channels stand for which side of a junction; street matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

ORDER = ("south", "west", "north", "east")


def box_counts(boxes: DataFrame) -> DataFrame:
    """Diagram boxes (site, x, y) as counts per side."""
    b = boxes.withColumn("side", S.approach(F.col("x"), F.col("y")))
    return b.groupBy("site").agg(F.count("*").alias("detector_boxes"), *[F.count_if(F.col("side") == s).alias(f"{s}_boxes") for s in ORDER])


def diagram_counts(diagrams: DataFrame) -> DataFrame:
    """Diagrams (site, boxes: an array of (x, y)) as counts per side; a diagram without boxes has zeros."""
    side = lambda s: F.size(F.filter("boxes", lambda b: S.approach(b["x"], b["y"]) == s)).cast("long")
    return diagrams.select("site", F.size("boxes").cast("long").alias("detector_boxes"), *[side(s).alias(f"{s}_boxes") for s in ORDER])


def registry(profile: DataFrame, counts: DataFrame, operational: int = 100, overrides: DataFrame | None = None) -> DataFrame:
    """(site, channel, approach, configured, operational, verification, source_note) of each site's k best channels, k its boxes.

    Best are those with most positive, then finite readings, then the lowest number. In channel order they take the
    sides south, west, north, east by the diagram's counts; without as many channels as boxes all are unknown. Sites
    without a diagram have their operational channels. overrides (site, channel, approach, verification and, if there is one,
    source_note) win.
    """
    best = Window.partitionBy("site").orderBy(F.desc("positive"), F.desc("finite"), "channel")
    p = profile.join(counts, "site", "left").withColumn("r", F.row_number().over(best))
    p = p.where(F.when(F.col("detector_boxes").isNotNull(), F.col("r") <= F.col("detector_boxes")).otherwise(F.col("positive") >= operational))
    sides = F.flatten(F.array(*[F.array_repeat(F.lit(s), F.coalesce(F.col(f"{s}_boxes"), F.lit(0)).cast("int")) for s in ORDER]))
    p = p.withColumn("k", F.count("*").over(Window.partitionBy("site"))).withColumn("i", F.row_number().over(Window.partitionBy("site").orderBy("channel")))
    fits = F.col("k") == F.col("detector_boxes")
    p = p.withColumns({"approach": F.coalesce(F.when(fits, F.get(sides, F.col("i") - 1)), F.lit("unknown")), "configured": F.lit(True), "operational": F.col("positive") >= operational, "verification": F.when(fits, "diagram").when(F.col("detector_boxes").isNull(), "data").otherwise("mismatch")})
    note = F.when(F.col("verification") == "diagram", "counts of the diagram's boxes").when(F.col("verification") == "data", "readings alone").otherwise("boxes and channels differ in number")
    p = p.select("site", "channel", "approach", "configured", "operational", "verification", note.alias("source_note"))
    if overrides is None:
        return p
    own = ("approach", "verification", "source_note")
    o = overrides.select("site", "channel", *[(F.col(c) if c in overrides.columns else F.lit(None).cast("string")).alias(f"own_{c}") for c in own])
    return p.join(o, ["site", "channel"], "left").withColumns({c: F.coalesce(f"own_{c}", c) for c in own}).drop(*[f"own_{c}" for c in own])


def inventory(observed: DataFrame, registered: DataFrame, drawn: DataFrame) -> DataFrame:
    """(site, has_raw_data, has_registry_name, has_diagram) over all three lists."""
    has = lambda d, n: d.select("site").distinct().withColumn(n, F.lit(True))
    j = has(observed, "has_raw_data").join(has(registered, "has_registry_name"), "site", "full_outer").join(has(drawn, "has_diagram"), "site", "full_outer")
    return j.na.fill(False, ["has_raw_data", "has_registry_name", "has_diagram"])


def street_pairs(wanted: DataFrame, candidates: DataFrame, limit: float = 1500.0) -> DataFrame:
    """Per junction (site, a, b) the closest two of its streets' candidates (query, rank, lat, lon): midpoint, distance, tier.

    The first of equally close pairs wins, by rank; pairs beyond the limit are no match. Candidates meet where they lie in
    the same or in neighbouring cells of a grid, so that far ones make no pair.
    """
    def of(k: str) -> DataFrame:
        return wanted.select("site", k).join(candidates.select(F.col("query").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("rank", "lat", "lon")]), k).drop(k)

    a = of("a").withColumn("cell", F.explode(S.cells_around(F.col("a_lat"), F.col("a_lon"), limit)))
    b = of("b").withColumn("cell", S.cell(F.col("b_lat"), F.col("b_lon"), limit))
    j = a.join(b, ["site", "cell"]).withColumn("d", S.haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))).where(F.col("d") <= limit)
    mid = F.struct(((F.col("a_lat") + F.col("b_lat")) / 2).alias("lat"), ((F.col("a_lon") + F.col("b_lon")) / 2).alias("lon"))
    g = j.groupBy("site").agg(F.min("d").alias("distance_m"), F.min_by(mid, F.struct("d", "a_rank", "b_rank")).alias("m"))
    return g.select("site", "distance_m", F.col("m.lat").alias("lat"), F.col("m.lon").alias("lon"), S.confidence(F.col("distance_m")).alias("confidence"))


def located(sites: DataFrame, direct: DataFrame, pairs: DataFrame) -> DataFrame:
    """sites with the direct match, else the street pair, else none; `method` says which."""
    s = lambda d, n: d.select("site", F.struct("lat", "lon").alias(n))
    j = sites.join(s(direct, "__d"), "site", "left").join(s(pairs, "__p"), "site", "left")
    at: Column = F.coalesce("__d", "__p")
    return j.withColumn("lat", at["lat"]).withColumn("lon", at["lon"]).withColumn("method", F.when(F.col("__d").isNotNull(), "direct_name").when(F.col("__p").isNotNull(), "street_pair").otherwise("unmatched")).drop("__d", "__p")


def geocoded(sites: DataFrame, candidates: DataFrame, place: str, prefixes: list[str], box: tuple[float, float, float, float], streets: int = 3, limit: float = 1500.0) -> DataFrame:
    """sites (site, name, ...) with latitude, longitude and how they were found: a candidate for the name itself, else the
    midpoint of the closest two candidates of two of its first `streets` streets, else nothing ("unmatched"). Sites without
    a name have nulls.

    candidates: (query, rank, lat, lon, osm_type, osm_id, display_name), query being a name and `place`; those outside the
    box are left out, and of a name's own only ranks up to 5 count, of a street's up to 15. Ties go to the first pair of streets, then by rank.
    """
    full = lambda c: F.concat(c, F.lit(f", {place}"))
    keep = ("lat", "lon", "osm_type", "osm_id", "display_name")
    c = candidates.where(S.inside(F.col("lat"), F.col("lon"), box) & (F.col("rank") <= 15)).select("query", "rank", F.struct(*keep).alias("c"))
    named = sites.select("site", S.persian(F.col("name")).alias("n")).where("n <> ''")
    own = named.select("site", full(F.col("n")).alias("query")).join(c.where("rank <= 5"), "query").groupBy("site", "query").agg(F.min_by("c", "rank").alias("c"))
    own = own.select("site", F.struct(*[F.col(f"c.{k}").cast("double").alias(k) for k in keep[:2]], F.lit("direct_name").alias("method"), F.lit("medium").alias("confidence"), "query", F.lit(0.0).alias("d"), *[F.coalesce(F.col(f"c.{k}").cast("string"), F.lit("")).alias(k) for k in keep[2:]]).alias("own"))
    parts = named.select("site", F.posexplode(F.slice(S.street_tokens(F.col("n"), prefixes), 1, streets)).alias("i", "token"))
    each = parts.select("site", "i", full(F.col("token")).alias("query")).join(c, "query")
    a, b = (each.select("site", *[F.col(x).alias(f"{x}_{k}") for x in ("i", "query", "rank", "c")]) for k in "ab")
    j = a.join(b, "site").where("i_a < i_b").withColumn("d", S.haversine(F.col("c_a.lat"), F.col("c_a.lon"), F.col("c_b.lat"), F.col("c_b.lon"))).where(F.col("d") <= limit)
    best = j.groupBy("site").agg(F.min_by(F.struct("c_a", "c_b", "query_a", "query_b", "d"), F.struct("d", "i_a", "i_b", "rank_a", "rank_b")).alias("x")).select("site", "x.*")
    mid = lambda k: ((F.col(f"c_a.{k}") + F.col(f"c_b.{k}")) / 2).alias(k)
    both = lambda k, sep: F.concat(F.coalesce(F.col(f"c_a.{k}").cast("string"), F.lit("")), F.lit(sep), F.coalesce(F.col(f"c_b.{k}").cast("string"), F.lit(""))).alias(k)
    pair = best.select("site", F.struct(mid("lat"), mid("lon"), F.lit("street_pair").alias("method"), S.confidence(F.col("d")).alias("confidence"), F.concat_ws(" | ", "query_a", "query_b").alias("query"), "d", F.lit("pair").alias("osm_type"), both("osm_id", "|"), both("display_name", " | ")).alias("pair"))
    out = sites.join(named, "site", "left").join(own, "site", "left").join(pair, "site", "left").withColumn("m", F.coalesce("own", "pair"))
    none = F.col("n").isNotNull()
    return out.select(
        *[F.col(x) for x in sites.columns], F.col("m.lat").alias("latitude"), F.col("m.lon").alias("longitude"), F.coalesce("m.method", F.when(none, F.lit("unmatched"))).alias("geocode_method"), F.coalesce("m.confidence", F.when(none, F.lit("none"))).alias("geocode_confidence"),
        F.coalesce("m.query", F.col("n")).alias("geocode_query"), F.col("m.d").alias("match_distance_m"), *[F.col(f"m.{k}").alias(k) for k in keep[2:]],
    )
