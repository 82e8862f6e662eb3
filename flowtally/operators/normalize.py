"""Coverage normalization of channel maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDES = ("south", "west", "north", "east")


def channel_map(detectors: DataFrame) -> DataFrame:
    """(site_id, cfg): a site's operational channels as an array of (channel_id, approach), by channel."""
    ok = F.lower(F.col("operational").cast("string")).isin("true", "1")
    return detectors.where(ok).groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("channel_id", "approach"))).alias("cfg"))


def coverage(records: DataFrame, config: DataFrame, minimum: float = 0.5) -> DataFrame:
    """records with observed and normalized volumes, detector counts, coverage, and volume and coverage of each side.

    Expected are all configured channels, in the record or not; a site without any is taken with the channels of the
    record, side unknown. A volume is scaled by 1 / coverage from `minimum` on, and null below; nothing is imputed. Sites
    of the configuration are few, so it is joined as Spark sees fit (broadcast while small).
    """
    every = F.transform(F.array_sort(F.map_keys("channels")), lambda k: F.struct(k.alias("channel_id"), F.lit("unknown").alias("approach")))
    r = records.join(config, "site_id", "left").withColumn("cfg", F.coalesce("cfg", every))

    def part(side: str | None):
        chosen = F.filter("cfg", lambda c: c["approach"] == side) if side else F.col("cfg")
        values = F.filter(F.transform(chosen, lambda c: F.try_element_at(F.col("channels"), c["channel_id"])), lambda v: v.isNotNull())
        n, k = F.size(chosen), F.size(values)
        total = F.when(k > 0, F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v))
        cover = F.when(n > 0, k / n)
        return n, k, total, cover, F.when(cover >= minimum, total / cover)

    n, k, total, cover, scaled = part(None)
    out = r.withColumns({"detectors_expected": n, "detectors_valid": k, "volume_observed": total, "detector_coverage": F.bround(cover, 6), "volume_normalized": F.bround(scaled, 6)})
    for side in SIDES:
        _, _, _, c, v = part(side)
        out = out.withColumns({f"{side}_volume": v, f"{side}_coverage": c})
    return out.drop("cfg")
