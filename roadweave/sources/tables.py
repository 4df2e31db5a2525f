"""Readers: tables by suffix, string-keyed CSV, network text files, and the driver's tables as a transport domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry
from ..session import whole


def read_table(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Parquet (a file, folder or glob), CSV, text of JSON rows or geometries, by suffix; other suffixes raise ValueError."""
    low = path.lower().rstrip("/")
    if low.endswith((".geoparquet", ".gpq")):
        return with_geometry(spark.read.options(**options).parquet(path))
    if low.endswith((".geojson", ".geojsonl")):
        return read_geojson(spark, path)
    if low.endswith((".parquet", ".pq")) or "." not in low.rsplit("/", 1)[-1]:
        return spark.read.options(**options).parquet(path)
    if low.endswith((".csv", ".csv.gz")):
        return read_csv_strings(spark, path, **options)
    if low.endswith((".json", ".jsonl")):
        return spark.read.options(**options).json(path)
    if low.endswith(".orc"):
        return spark.read.options(**options).orc(path)
    raise ValueError(f"no reader for {path}")


def with_geometry(df: DataFrame, column: str = "geometry") -> DataFrame:
    """A column of well-known binary as ``geometry.GEOMETRY``; a table without such a column of bytes stays as it is."""
    if column in df.columns and df.schema[column].dataType.typeName() == "binary":
        return geometry.from_wkb(df, column)
    return df


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """properties (map of texts), geometry (``geometry.GEOMETRY``): a row a feature.

    A .geojsonl file has a feature a line and is split among tasks; a .geojson file is one collection, read by one task.
    Features without geometry have a null one.
    """
    shape = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])
    feature = T.StructType([T.StructField("properties", T.MapType(T.StringType(), T.StringType())), T.StructField("geometry", shape)])
    if path.lower().rstrip("/").endswith(".geojsonl"):
        rows = spark.read.schema(feature).json(path)
    else:
        whole = spark.read.schema(T.StructType([T.StructField("features", T.ArrayType(feature))])).json(path, multiLine=True)
        rows = whole.select(F.explode("features").alias("f")).select("f.*")
    return rows.select("properties", geometry.from_geojson(F.col("geometry.type"), F.col("geometry.coordinates")).alias("geometry"))


def read_csv_strings(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """All columns as text, so codes keep their zeros; header names trimmed."""
    df = spark.read.options(header="true", inferSchema="false", **options).csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


def read_tntp_links(spark: SparkSession, path: str) -> DataFrame:
    """init, term, capacity, length, t0, b, power, speed, toll, link_type of a network text file: <TAG> lines and ~ comments are left out."""
    names = ("init", "term", "capacity", "length", "t0", "b", "power", "speed", "toll", "link_type")
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(~|<|$)"))
    parts = F.split(F.trim(F.regexp_replace("value", ";", " ")), r"\s+")
    return rows.select(*[parts[i].cast("string" if n in ("init", "term") else "double").alias(n) for i, n in enumerate(names)])


def read_tntp_trips(spark: SparkSession, path: str) -> DataFrame:
    """origin, destination, flow, a row a pair: "Origin n" heads the lines of "d : flow;" up to the next.

    Pairs of one node and flows of 0 are left out, pairs that stand twice are summed. A file is one text value, so lines keep their order.
    """
    text = spark.read.text(path, wholetext=True)
    blocks = text.select(F.explode(F.split("value", r"(?m)^\s*Origin\s+")).alias("block")).where(F.col("block").rlike(r"^\S+\s"))
    pairs = F.explode(F.regexp_extract_all("block", F.lit(r"(\S+)\s*:\s*([-+0-9.eE]+)\s*;"), F.lit(0))).alias("p")
    cut = blocks.where(~F.col("block").startswith("<")).select(F.regexp_extract("block", r"^(\S+)", 1).alias("origin"), pairs)
    rows = cut.select("origin", F.trim(F.split("p", ":")[0]).alias("destination"), F.trim(F.regexp_replace(F.split("p", ":")[1], ";", "")).try_cast("double").alias("flow"))
    return rows.where("flow > 0 AND origin <> destination").groupBy("origin", "destination").agg(F.sum("flow").alias("flow"))


def read_tntp_nodes(spark: SparkSession, path: str) -> DataFrame:
    """node, x, y of a network's node file, whose first line is a header."""
    rows = spark.read.text(path).where(~F.lower("value").rlike(r"^\s*(~|<|node|$)"))
    parts = F.split(F.trim(F.regexp_replace("value", ";", " ")), r"\s+")
    return rows.select(parts[0].alias("node"), parts[1].try_cast("double").alias("x"), parts[2].try_cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")


def read_tntp_metadata(spark: SparkSession, path: str) -> dict[str, str]:
    """The <TAG> value lines of a network text file, by tag in capitals."""
    rows = spark.read.text(path).select(F.regexp_extract("value", r"^\s*<([^>]+)>\s*(.*?)\s*$", 1).alias("k"), F.regexp_extract("value", r"^\s*<([^>]+)>\s*(.*?)\s*$", 2).alias("v"))
    return {r["k"].strip().upper(): r["v"] for r in rows.where("k <> '' AND upper(k) <> 'END OF METADATA'").collect()}  # a few header lines


def tntp_network(nodes: DataFrame, links: DataFrame, prefix: str = "", urban: int = 1) -> DataFrame:
    """Assignment links of a text network: ids, class and lanes by capacity, capacity a lane, speed (45 mph at most), toll, and the line between the nodes."""
    n = lambda c: F.concat(F.lit(prefix), c)
    at = lambda k, x: nodes.select(F.col("node").alias(k), F.struct("x", "y").alias(x))
    cap, hours = F.col("capacity"), F.col("t0") / 60
    # Lanes and classes by hourly capacity.
    lanes = F.when(cap >= 20_000, 3).when(cap >= 10_000, 2).otherwise(1)
    road = F.when(cap >= 20_000, "freeway").when(cap >= 15_000, "arterial").when(cap >= 8_000, "collector").otherwise("local")
    speed = F.least(F.when(F.col("t0") > 0, F.col("length") / hours).otherwise(35.0), F.lit(45.0))
    both = links.join(at("init", "__a"), "init").join(at("term", "__b"), "term")
    return both.select(
        F.concat_ws("_", n(F.col("init")), n(F.col("term"))).alias("e_id"), n(F.col("init")).alias("from_id"), n(F.col("term")).alias("to_id"), road.alias("road_class"), lanes.alias("lanes"), cap.alias("tntp_capacity"),
        F.col("t0").alias("tntp_t0"), F.col("b").alias("tntp_b"), F.col("power").alias("tntp_power"), (cap / lanes).alias("flow_cap_plph"), F.lit(urban).alias("urban"), F.col("toll"),
        speed.alias("free_flow_speed"), F.lit("tntp").alias("network_source"), F.array("__a", "__b").alias("vertices"),
    )


def read_commuters(spark: SparkSession, folder: str, state: str, year: int, part: str = "main", job: str = "JT00", years: dict[str, int] | None = None) -> DataFrame:
    """home, work, jobs of a state's file of commuters; ``years`` holds the states whose last year is another."""
    use = (years or {}).get(state.lower(), year)
    rows = read_csv_strings(spark, f"{folder}/{state.lower()}_od_{part}_{job}_{use}.csv*")
    return rows.select(F.trim("h_geocode").alias("home"), F.trim("w_geocode").alias("work"), F.col("S000").try_cast("long").alias("jobs"))


def read_commuter_lookup(spark: SparkSession, folder: str, state: str) -> DataFrame:
    """block, county of a state's crosswalk: the first row of a block by county."""
    rows = read_csv_strings(spark, f"{folder}/{state.lower()}_xwalk.csv*")
    return rows.groupBy(F.trim("tabblk2020").alias("block")).agg(F.lpad(F.min(F.trim("cty")), 5, "0").alias("county"))


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def od_paths(spark: SparkSession, d: str) -> DataFrame:
    """od_id, origin, destination, flow, path: an order is a trip, its lines' suppliers are its links in order.

    Lines are shuffled once and as they are, before they become lists; where the links are few enough for every executor, the
    paths stay parted by od_id.
    """
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").repartition("l_orderkey")
    lists = lines.groupBy(F.col("l_orderkey").alias("od_id")).agg(F.array_sort(F.collect_list(line)).alias("x"))
    paths = lists.select("od_id", F.transform("x", lambda s: F.concat(F.lit("e"), s["l_suppkey"])).alias("path"), F.element_at("x", -1)["l_suppkey"].alias("last"))
    orders = _t(spark, d, "orders").select(F.col("o_orderkey").alias("od_id"), F.concat(F.lit("n"), "o_custkey").alias("origin"), (F.col("o_totalprice") / 1000).alias("flow"))
    ends = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("last"), F.concat(F.lit("z"), "s_nationkey").alias("destination"))
    return orders.join(paths, "od_id").join(whole(ends), "last").select("od_id", "origin", "destination", "flow", "path")


def links(spark: SparkSession, d: str) -> DataFrame:
    """e_id, suppkey, nation, capacity, metres, road_class, lanes, urban, toll: a supplier is a link."""
    k = F.col("s_suppkey")
    classes = F.array(*map(F.lit, ("motorway", "trunk", "primary", "secondary", "tertiary", "local", "service", " Unclassified", "unknown")))
    return _t(spark, d, "supplier").select(
        F.concat(F.lit("e"), k).alias("e_id"), k.alias("suppkey"), F.col("s_nationkey").alias("nation"), (50 * (1 + F.abs("s_acctbal"))).alias("capacity"),
        (500.0 + k % 97 * 100).alias("metres"), F.element_at(classes, (k % 9 + 1).cast("int")).alias("road_class"), (1 + k % 4).cast("int").alias("lanes"),
        (k % 2).cast("int").alias("urban"), (k % 5 / 10.0).alias("toll"),
    )


def nation_od(spark: SparkSession, d: str) -> DataFrame:
    """origin, destination (nations), kind (freight: returned lines), flow: daily quantity."""
    c = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    s = _t(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    rows = _t(spark, d, "lineitem").join(c, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    kind = F.when(F.col("l_returnflag") == "R", "freight").otherwise("passenger").alias("kind")
    return rows.select(F.concat(F.lit("n"), "c_nationkey").alias("origin"), F.concat(F.lit("n"), "s_nationkey").alias("destination"), kind, F.col("l_quantity").alias("q")).groupBy("origin", "destination", "kind").agg((F.sum("q") / 365).alias("flow"))


def zone_flows(spark: SparkSession, d: str) -> DataFrame:
    """origin_zone, destination_zone (regions), sctg, mode, year, tons, value: lines by supplier's and customer's region."""
    n = _t(spark, d, "nation").select("n_nationkey", "n_regionkey")
    c = _t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("destination_zone"))
    o = _t(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "destination_zone", F.year("o_orderdate").alias("year"))
    s = _t(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("origin_zone"))
    p = _t(spark, d, "part").select("p_partkey", (F.col("p_size") % 43 + 1).alias("sctg"))
    rows = _t(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    keys = ["origin_zone", "destination_zone", "sctg", "mode", "year"]
    return rows.withColumn("mode", F.col("l_linenumber") % 7 + 1).groupBy(*keys).agg(F.sum("l_quantity").alias("tons"), F.sum("l_extendedprice").alias("value"))


def nation_factors(spark: SparkSession, d: str, side: str) -> DataFrame:
    """zone (region), county (nation), factor: a nation's share of its region's suppliers or customers."""
    key = {"supplier": "s_nationkey", "customer": "c_nationkey"}[side]
    n = _t(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("zone"))
    counts = _t(spark, d, side).join(n, F.col(key) == F.col("n_nationkey")).groupBy("zone", F.col(key).alias("county")).count()
    return counts.select("zone", "county", (F.col("count") / F.sum("count").over(Window.partitionBy("zone"))).alias("factor"))


def segments(spark: SparkSession, d: str) -> DataFrame:
    """segment_id, e_id, i, j, hazard, intensity, damage, road_label: an event is an exposed piece of a link."""
    n = _t(spark, d, "supplier").agg(F.count("*").alias("n"))
    hazard = F.when(F.col("event_type").isin("click", "view"), "surface").otherwise("river")
    return _t(spark, d, "events").crossJoin(F.broadcast(n)).select(
        F.col("event_id").alias("segment_id"), F.concat(F.lit("e"), F.col("user_id") % F.col("n")).alias("e_id"), (F.col("event_id") % 50).cast("int").alias("i"), (F.col("event_id") % 37).cast("int").alias("j"),
        hazard.alias("hazard"), (F.col("value") / 20).alias("intensity"), (F.col("value") * 3).alias("damage"), F.col("event_type").alias("road_label"),
    )


def points(spark: SparkSession, d: str, name: str) -> DataFrame:
    """id, lon, lat, weight made from keys: nations, or customers as zones."""
    key, table = {"nation": ("n_nationkey", "nation"), "customer": ("c_custkey", "customer")}[name]
    k = F.col(key).cast("long")
    lon, lat = (-120.0 + k * 7919 % 5003 / 100.0, 25.0 + k * 104729 % 2503 / 100.0) if name == "customer" else (-120.0 + k * 37 % 51, 25.0 + k * 17 % 25)
    return _t(spark, d, table).select(k.alias("id"), lon.cast("double").alias("lon"), lat.cast("double").alias("lat"), (1.0 + k % 5).alias("weight"))


def nation_net(spark: SparkSession, d: str) -> DataFrame:
    """e_id, from_id, to_id, weight: three links a nation."""
    k = F.col("n_nationkey").cast("long")
    ends = F.posexplode(F.array((k + 1) % 25, (k + 5) % 25, (3 * k + 7) % 25)).alias("p", "t")
    rows = _t(spark, d, "nation").select(k.alias("f"), ends).where("f <> t")
    return rows.select(F.concat_ws("_", F.lit("l"), "f", "p").alias("e_id"), F.col("f").cast("string").alias("from_id"), F.col("t").cast("string").alias("to_id"), (1.0 + (F.col("f") * 7 + F.col("p") * 3) % 11).alias("weight"))
