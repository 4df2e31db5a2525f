"""Demand: normalised and combined OD tables, disaggregation by factors and gravity, trucks, centroids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cost import haversine_miles
from ..functions.keys import commodity_group, fips, mode_is, rename_aliases, require, year_column, zone
from .report import first_per_key

PAIR = ["origin", "destination"]


def normalise(od: DataFrame, flow: str = "flow") -> DataFrame:
    """One positive row a pair."""
    return od.groupBy(*[F.col(c).cast("string").alias(c) for c in PAIR]).agg(F.sum(flow).alias(flow)).where(F.col(flow) > 0)


def combine(freight: DataFrame, passenger: DataFrame) -> DataFrame:
    """Full outer on the pair: freight, passenger and their total, 0 where one lacks."""
    f, p = normalise(freight).withColumnRenamed("flow", "freight"), normalise(passenger).withColumnRenamed("flow", "passenger")
    out = f.join(p, PAIR, "outer").fillna(0.0, ["freight", "passenger"])
    return out.withColumn("flow", F.col("freight") + F.col("passenger"))


def restrict(od: DataFrame, pairs: DataFrame) -> DataFrame:
    return od.join(pairs.select(*PAIR), PAIR, "left_semi")


def first_candidate(candidates: DataFrame, flows: DataFrame) -> DataFrame:
    """One candidate a pair, that of the smallest od_id, with the pair's flow."""
    w = Window.partitionBy(*PAIR).orderBy("od_id")
    one = candidates.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "flow")
    return one.join(flows.groupBy(*PAIR).agg(F.sum("flow").alias("flow")), PAIR)


def surrogate_ids(od: DataFrame, base: int = 0, buckets: int | None = None) -> DataFrame:
    """od_id = base + rank by (origin, destination) - 1, without one task for all rows.

    Pairs are dealt to ranges by origin, counted a range, and numbered within; rows of one origin are one range, split by destination.
    """
    keyed = od.withColumn("k", F.struct(*PAIR))
    buckets = buckets or int(od.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = keyed.repartitionByRange(buckets, *PAIR).withColumn("part", F.spark_partition_id())
    from ..session import checkpointed

    parted = checkpointed(parted)
    counts = parted.groupBy("part").count()
    # A row a range, so one task adds them up.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    w = Window.partitionBy("part").orderBy("k")
    return parted.join(F.broadcast(before), "part").withColumn("od_id", (F.lit(base) + F.col("before") + F.row_number().over(w) - 1).cast("long")).drop("k", "part", "before")


def factor_sums(factors: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """The factors' sums a key and whether they are 1."""
    out = factors.groupBy(*keys).agg(F.sum("factor").alias("total"))
    return out.withColumn("ok", F.abs(F.col("total") - 1) <= tolerance)


def disaggregate(flows: DataFrame, origin: DataFrame, destination: DataFrame, measures: list[str], keep_missing: bool = False) -> DataFrame:
    """Zone flows times the factors of both ends, summed a pair of counties: (zone, county, factor) each, by group if both have it.

    A flow whose zone has no factor is dropped; with ``keep_missing`` it stays with a null county and null measures.
    """
    how = "left" if keep_missing else "inner"
    by = [c for c in ("group",) if c in flows.columns and c in origin.columns]
    o = origin.select(F.col("zone").alias("origin_zone"), F.col("county").alias("origin"), F.col("factor").alias("fo"), *by)
    d = destination.select(F.col("zone").alias("destination_zone"), F.col("county").alias("destination"), F.col("factor").alias("fd"), *by)
    out = flows.join(o, ["origin_zone", *by], how).join(d, ["destination_zone", *by], how)
    keep = [c for c in flows.columns if c not in ("origin_zone", "destination_zone", *measures)]
    return out.groupBy(*PAIR, *keep).agg(*[F.sum(F.col(m) * F.col("fo") * F.col("fd")).alias(m) for m in measures])


def missing_factors(flows: DataFrame, factors: DataFrame) -> DataFrame:
    """Zones of flows that have no factor, with what is lost."""
    lost = flows.join(factors.select(F.col("zone").alias("origin_zone")).distinct(), "origin_zone", "left_anti")
    return lost.groupBy("origin_zone").agg(F.count("*").alias("n"), F.sum("tons").alias("tons"))


def shares(df: DataFrame, keys: list[str], weight: str, out: str = "share") -> DataFrame:
    """A weight's share of its key's total; equal shares where that is 0."""
    w = Window.partitionBy(*keys)
    total, n = F.sum(weight).over(w), F.count("*").over(w)
    return df.withColumn(out, F.when(total > 0, F.col(weight) / total).otherwise(1 / n))


def gravity(flows: DataFrame, weights: DataFrame, distance: DataFrame, power: float = 1.0, least: float = 1.0) -> DataFrame:
    """Zone flows dealt to pairs of subareas by production * attraction / max(distance, least)**power; tons a flow are kept.

    weights: zone, subarea, production, attraction; distance: a, b, miles (missing: ``least``). Subareas meet only
    within the zones of a flow.
    """
    o = weights.select(F.col("zone").alias("origin_zone"), F.col("subarea").alias("origin"), "production")
    d = weights.select(F.col("zone").alias("destination_zone"), F.col("subarea").alias("destination"), "attraction")
    rows = flows.withColumn("flow_id", F.struct("origin_zone", "destination_zone")).join(o, "origin_zone").join(d, "destination_zone")
    rows = rows.join(distance.select(F.col("a").alias("origin"), F.col("b").alias("destination"), "miles"), PAIR, "left")
    rows = rows.withColumn("w", F.col("production") * F.col("attraction") / F.pow(F.greatest(F.coalesce("miles", F.lit(least)), F.lit(least)), F.lit(power)))
    dealt = shares(rows, ["flow_id"], "w")
    return dealt.groupBy(*PAIR).agg(F.sum(F.col("tons") * F.col("share")).alias("tons"))


def near_zones(flows: DataFrame, zones: list[str]) -> DataFrame:
    """Flows that start or end in one of the zones; codes are compared without leading zeros."""
    want = [z.strip().lstrip("0") or "0" if z.strip().isdigit() else z.strip() for z in zones]
    return flows.where(zone(F.col("origin_zone")).isin(want) | zone(F.col("destination_zone")).isin(want))


def in_tons(flows: DataFrame, unit: str = "thousand_tons") -> DataFrame:
    """Tons as tons, positive rows only; other units raise ValueError."""
    if unit not in ("tons", "thousand_tons"):
        raise ValueError("the unit is tons or thousand_tons")
    return flows.withColumn("tons", F.col("tons") * (1000.0 if unit == "thousand_tons" else 1.0)).where("tons > 0")


def regional_flows(rows: DataFrame, year: int | None = None, mode: str | None = "truck", unit: str = "thousand_tons", zones: list[str] | None = None) -> DataFrame:
    """origin_zone, destination_zone, sctg, group, mode, year, tons, value of a table of regional flows, whatever aliases its columns go by.

    One plan reads, filters and normalises; there are no chunks, as the scan is parted already.
    """
    df = rename_aliases(rows, {"origin_zone": ["dms_orig", "origin_faf"], "destination_zone": ["dms_dest", "destination_faf"], "sctg": ["sctg2", "commodity"], "group": ["sctgG5"], "mode": ["dms_mode"]})
    tons, value = year_column(df, "tons", year), next((c for c in (f"value_{year}", "value") if c in df.columns), None)
    require(df, ["origin_zone", "destination_zone", "mode"])
    if tons is None or not {"sctg", "group"} & set(df.columns):
        raise ValueError("regional flows need tons and a commodity")
    if mode is not None:
        df = df.where(mode_is(F.col("mode"), mode))
    sctg = F.trim(F.col("sctg").cast("string")) if "sctg" in df.columns else F.lit(None).cast("string")
    group = F.coalesce(F.col("group"), commodity_group(sctg)) if "group" in df.columns else commodity_group(sctg)
    out = df.select(
        zone(F.col("origin_zone")).alias("origin_zone"), zone(F.col("destination_zone")).alias("destination_zone"), sctg.alias("sctg"), group.alias("group"), F.trim(F.col("mode").cast("string")).alias("mode"),
        F.lit(year).cast("int").alias("year"), F.col(tons).try_cast("double").alias("tons"), (F.col(value).try_cast("double") if value else F.lit(None).cast("double")).alias("value"),
    )
    return in_tons(near_zones(out, zones) if zones else out, unit)


FLOW_KEYS = ["origin_zone", "destination_zone", "group", "mode", "year"]


def county_flows(flows: DataFrame, origin: DataFrame, destination: DataFrame, keep_missing: bool = False) -> DataFrame:
    """Tons and value by both zones, both counties, group, mode and year; null is a key like any other."""
    o = origin.select(F.col("zone").alias("origin_zone"), F.col("county").alias("origin"), F.col("factor").alias("fo"), "group")
    d = destination.select(F.col("zone").alias("destination_zone"), F.col("county").alias("destination"), F.col("factor").alias("fd"), "group")
    how = "left" if keep_missing else "inner"
    rows = flows.join(o, ["origin_zone", "group"], how).join(d, ["destination_zone", "group"], how)
    return rows.groupBy(*FLOW_KEYS, *PAIR).agg(*[F.sum(F.col(m) * F.col("fo") * F.col("fd")).alias(m) for m in ("tons", "value")])


def disaggregation_quality(flows: DataFrame, counties: DataFrame, origin: DataFrame, destination: DataFrame) -> DataFrame:
    """One row: tons before and after, the difference in percent, records, records without a factor at either end, and keys that were dropped."""
    lost = lambda factors, end: flows.join(factors.select(F.col("zone").alias(end), "group").distinct(), [end, "group"], "left_anti").agg(F.count("*").alias("n"))
    a = flows.agg(F.coalesce(F.sum("tons"), F.lit(0.0)).alias("tons_before"), F.count("*").alias("records"))
    b = counties.agg(F.coalesce(F.sum("tons"), F.lit(0.0)).alias("tons_after"), F.count("*").alias("county_records"))
    keys_of = lambda df: df.select(*FLOW_KEYS).distinct()
    gone = keys_of(flows).exceptAll(keys_of(counties)).agg(F.count("*").alias("dropped"))
    one = a.crossJoin(b).crossJoin(lost(origin, "origin_zone").withColumnRenamed("n", "missing_origin")).crossJoin(lost(destination, "destination_zone").withColumnRenamed("n", "missing_destination")).crossJoin(gone)  # one row each
    return one.withColumn("difference_percent", F.coalesce(F.try_divide((F.col("tons_after") - F.col("tons_before")) * 100, "tons_before"), F.lit(0.0)))


def zone_weights(weights: DataFrame, wanted: DataFrame, fallback: str = "all") -> DataFrame:
    """zone, commodity, subarea, share: a zone's weights for each commodity that is wanted of it, else those of ``fallback``, renormalised.

    A zone and commodity with neither has a row with null subarea, so that its flow is seen to have no place.
    """
    w = weights.select("zone", F.col("commodity").alias("__own"), "subarea", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    known = wanted.select("zone", "commodity").distinct()
    exact = known.join(w, ["zone"]).where("commodity = __own")
    rest = known.join(exact.select("zone", "commodity").distinct(), ["zone", "commodity"], "left_anti").join(w.where(F.col("__own") == fallback), "zone", "left")
    return shares(exact.unionByName(rest).drop("__own"), ["zone", "commodity"], "weight").withColumn("share", F.when(F.col("subarea").isNotNull(), F.col("share"))).drop("weight")


def whole_trucks(tons: Column, payload: float = 20.0, days: float = 365.0) -> Column:
    """Trucks a day as a whole number, 1 at least; halves go to the even number."""
    return F.greatest(F.lit(1), half_even(tons / payload / days))


def trucks(od: DataFrame, payload: DataFrame, days: float = 365.0, fallback: str | None = "all") -> DataFrame:
    """Daily trucks: tons over the commodity's payload, or that of ``fallback``, over ``days``; without a fallback a missing payload raises an error."""
    if fallback is None:
        exact = od.join(F.broadcast(payload.select("commodity", "payload")), "commodity", "left")
        missing = F.raise_error(F.concat(F.lit("no payload for "), F.coalesce(F.col("commodity").cast("string"), F.lit("null")))).cast("double")
        return exact.withColumn("trucks", F.when(F.col("payload").isNull(), missing).otherwise(F.col("tons") / F.col("payload") / days)).drop("payload")
    own = payload.where(F.col("commodity") != fallback).select("commodity", F.col("payload").alias("own"))
    rest = payload.where(F.col("commodity") == fallback).agg(F.max("payload").alias("rest"))
    return od.join(F.broadcast(own), "commodity", "left").crossJoin(F.broadcast(rest)).withColumn("trucks", F.col("tons") / F.coalesce("own", "rest") / days).drop("own", "rest")


def nearest(left: DataFrame, right: DataFrame, cells: float = 1.0) -> DataFrame:
    """id, near_id, miles: the nearest right point by great circle, ties to the smaller id.

    Points (id, lon, lat) meet in grid cells of ``cells`` degrees and their neighbours first; a left point is settled by
    them if it found one nearer than the ring it looked at; the rest widen their ring, doubling it, until all are settled.
    """
    spark = left.sparkSession
    from ..session import checkpointed

    found = None
    todo, ring = left.select("id", "lon", "lat").distinct(), cells
    points = right.select(F.col("id").alias("near_id"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    schema = left.select("id").schema
    while True:
        cell = lambda c, r=ring: F.floor(F.col(c) / r)
        # Columns run around the globe, of which the last may be narrower, so one more is looked at; few columns are all looked at.
        columns = int(-(-360 // ring))
        column = lambda c, r=ring: F.floor(F.pmod(F.col(c), F.lit(360.0)) / r)  # noqa: E731, B023
        reach_x = F.explode(F.sequence(F.lit(-2), F.lit(2)) if columns > 5 else F.sequence(F.lit(0), F.lit(columns - 1)))
        around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
        probes = todo.select("*", reach_x.alias("dx")).select("*", around.alias("dy")).select("id", "lon", "lat", F.pmod(column("lon") + F.col("dx"), F.lit(columns)).alias("cx"), (cell("lat") + F.col("dy")).alias("cy")).distinct()
        met = probes.join(points.select("*", column("lon2").alias("cx"), cell("lat2").alias("cy")), ["cx", "cy"])
        miles = haversine_miles(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))
        best = met.withColumn("miles", miles).groupBy("id", "lat").agg(F.min(F.struct("miles", "near_id")).alias("b")).select("id", "lat", "b.near_id", "b.miles")
        # A ring of r degrees is r * 69 miles of latitude, less of longitude towards the poles.
        reach = F.lit(ring * 69.0) * F.greatest(F.cos(F.radians(F.least(F.abs("lat") + ring, F.lit(89.0)))), F.lit(0.0))
        settled = checkpointed((best if ring >= 360 else best.where(F.col("miles") <= reach)).select("id", "near_id", "miles"))
        found = settled if found is None else found.union(settled)
        todo = checkpointed(todo.join(settled.select("id"), "id", "left_anti"))
        if ring >= 360 or todo.isEmpty():
            return found if found is not None else spark.createDataFrame([], schema)
        ring *= 2


def inverse_distance_od(points: DataFrame, total: float, power: float = 2.0, least: float = 1.0) -> DataFrame:
    """A synthetic OD over all ordered pairs of a bounded set of zones (id, lon, lat, weight): weights over distance, scaled to ``total``."""
    a = points.select(F.col("id").alias("origin"), F.col("lon").alias("x1"), F.col("lat").alias("y1"), F.col("weight").alias("w1"))
    b = points.select(F.col("id").alias("destination"), F.col("lon").alias("x2"), F.col("lat").alias("y2"), F.col("weight").alias("w2"))
    miles = haversine_miles(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    rows = a.join(b, F.col("origin") != F.col("destination")).withColumn("w", F.col("w1") * F.col("w2") / F.pow(F.greatest(miles, F.lit(least)), F.lit(power)))
    whole = rows.agg(F.sum("w").alias("whole"))
    return rows.crossJoin(F.broadcast(whole)).select(*PAIR, (F.lit(total) * F.col("w") / F.col("whole")).alias("flow"))


def half_even(c: Column) -> Column:
    """Whole numbers, halves to even."""
    return F.rint(c).cast("long")


def commuter_counties(parts: list[DataFrame], lookup: DataFrame, year: int, job: str = "JT00") -> DataFrame:
    """origin, destination, year, job_type, jobs: the main and auxiliary parts of all states in one plan, positive rows only."""
    both = parts[0]
    for more in parts[1:]:
        both = both.unionByName(more)
    return commuter_od(both, lookup).select(*PAIR, F.lit(year).alias("year"), F.lit(job).alias("job_type"), "jobs")


def commuter_trips(counties: DataFrame, days: float = 365.0) -> DataFrame:
    """Commuters as assignment demand: a daily trip a job, and so many a year."""
    return counties.select(*PAIR, F.col("jobs").cast("double").alias("daily_trips"), (F.col("jobs") * days).alias("annual_trips"))


def crosswalk(zones: DataFrame, centroids: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """zone, centroid, node, method, miles, warning: zones by equal ids first, the rest by the nearest centroid.

    zones: zone; centroids: centroid, node, lon, lat; places: zone, lon, lat. Ids are compared as ``keys.fips``. A zone
    without place is unmapped; over 25 and 50 miles are warned of.
    """
    c = first_per_key(centroids.withColumn("zone", fips(F.col("centroid").cast("string"))), ["zone"], ["centroid", "node"])
    z = zones.select(fips(F.col("zone").cast("string")).alias("zone")).where("zone IS NOT NULL").distinct()
    exact = z.join(c.select("zone", "centroid", "node"), "zone").withColumns({"method": F.lit("exact_match"), "miles": F.lit(0.0)})
    rest = z.join(exact.select("zone"), "zone", "left_anti")
    columns = ["zone", "centroid", "node", "method", "miles"]
    if places is None:
        far = rest.select("zone", *[F.lit(None).cast(c.schema[n].dataType).alias(n) for n in ("centroid", "node")], F.lit(None).cast("string").alias("method"), F.lit(None).cast("double").alias("miles"))
    else:
        at = places.select(fips(F.col("zone").cast("string")).alias("zone"), "lon", "lat").where("lon IS NOT NULL AND lat IS NOT NULL").groupBy("zone").agg(F.min(F.struct("lon", "lat")).alias("p"))
        near = nearest(rest.join(at, "zone").select(F.col("zone").alias("id"), "p.lon", "p.lat"), c.where("lon IS NOT NULL AND lat IS NOT NULL").select(F.col("zone").alias("id"), "lon", "lat"))
        near = near.select(F.col("id").alias("zone"), F.col("near_id").alias("__z"), "miles")
        named = near.join(c.select(F.col("zone").alias("__z"), "centroid", "node"), "__z").withColumn("method", F.lit("nearest_loading_node"))
        far = rest.join(named, "zone", "left")
    out = exact.select(*columns).unionByName(far.select(*columns))
    warning = F.when(F.col("centroid").isNull(), "unmapped").when(F.col("miles") > 50, "distance_gt_50_miles").when(F.col("miles") > 25, "distance_gt_25_miles").otherwise("")
    return out.withColumn("warning", warning)


def scaled_split(od: DataFrame, scale: float = 1.0, freight_share: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Freight and passenger demand: the flow times ``scale``, parted by the share; positive rows only."""
    part = lambda share: normalise(od.withColumn("flow", F.col("flow") * (scale * share)))
    return part(freight_share), part(1 - freight_share)


def weighted_mean(df: DataFrame, keys_: list[str], value: str, weight: str) -> DataFrame:
    """Each key's weight and the mean of its values by weight; null where all weights are 0."""
    sums = df.groupBy(*keys_).agg(F.sum(weight).alias(weight), F.sum(F.col(value) * F.col(weight)).alias("__s"))
    return sums.withColumn(value, F.try_divide("__s", weight)).drop("__s")


def commuter_od(blocks: DataFrame, lookup: DataFrame, by: list[str] | None = None) -> DataFrame:
    """origin, destination (counties), jobs: home and work blocks looked up, summed (for each value of the columns ``by``), positive rows only.

    A block that the lookup lists twice would count its jobs twice, so that raises an error.
    """
    repeated = lookup.groupBy("block").count().where("count > 1").limit(1)
    if not repeated.isEmpty():
        raise ValueError("the lookup lists a block twice")
    home = lookup.select(F.col("block").alias("home"), F.col("county").alias("origin"))
    work = lookup.select(F.col("block").alias("work"), F.col("county").alias("destination"))
    return blocks.join(home, "home").join(work, "work").groupBy(*PAIR, *(by or [])).agg(F.sum("jobs").alias("jobs")).where("jobs > 0")


def to_nodes(od: DataFrame, mapping: DataFrame, measures: list[str]) -> DataFrame:
    """Zones of both ends replaced by their nodes (zone, node) and summed; pairs with an end without node are left out."""
    m = mapping.select("zone", "node").where("node IS NOT NULL")
    o, d = m.select(F.col("zone").alias("origin"), F.col("node").alias("o")), m.select(F.col("zone").alias("destination"), F.col("node").alias("d"))
    return od.join(o, "origin").join(d, "destination").groupBy(F.col("o").alias("origin"), F.col("d").alias("destination")).agg(*[F.sum(x).alias(x) for x in measures])


def preserved(before: DataFrame, after: DataFrame, key: str, measure: str, tolerance: float = 1e-6) -> DataFrame:
    """key, before, after, ok: totals on both sides of a step, 0 where one lacks."""
    a, b = (df.groupBy(key).agg(F.sum(measure).alias(n)) for df, n in ((before, "before"), (after, "after")))
    out = a.join(b, key, "outer").fillna(0.0, ["before", "after"])
    return out.withColumn("ok", F.abs(F.col("before") - F.col("after")) <= tolerance * F.greatest(F.abs("before"), F.lit(1.0)))


def balance(df: DataFrame, keys: list[str], measure: str, targets: DataFrame) -> DataFrame:
    """The measure scaled so that each key's sum is its target (keys, target); keys without one, or with a sum of 0, stay."""
    sums = df.groupBy(*keys).agg(F.sum(measure).alias("__sum")).join(targets.select(*keys, "target"), keys, "left")
    ratio = F.when((F.col("__sum") > 0) & F.col("target").isNotNull(), F.col("target") / F.col("__sum")).otherwise(F.lit(1.0))
    return df.join(sums, keys).withColumn(measure, F.col(measure) * ratio).drop("__sum", "target")


def fill_trips(df: DataFrame, daily: str, annual: str, days: float = 365.0) -> DataFrame:
    """Daily and annual trips from each other where one is not positive."""
    d, a = F.col(daily), F.col(annual)
    return df.withColumns({daily: F.when(F.coalesce(d, F.lit(0.0)) > 0, d).otherwise(a / days), annual: F.when(F.coalesce(a, F.lit(0.0)) > 0, a).otherwise(d * days)})


def sample(df: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """n rows by a seeded hash of their keys: a sampling operator."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)
