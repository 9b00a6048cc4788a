"""Queries of cameras, boxes, depth and floors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import rounded
from ..operators import cameras, stats
from ..sources import readers
from .register import query, table

_ROUND = lambda x, n=6: f"(floor(({x}) * {float(10**n)} + 0.5) / {float(10**n)})"
_NUM = lambda *xs: [F.col(x).cast("double") for x in xs]


@query(f"""WITH c AS (SELECT p_partkey, 512.0::DOUBLE + p_size AS w, 540.0::DOUBLE AS h, 35.0::DOUBLE + p_size AS lens, CASE p_partkey % 3 WHEN 0 THEN 'AUTO' WHEN 1 THEN 'VERTICAL' ELSE 'HORIZONTAL' END AS fit, p_size / 1000.0::DOUBLE AS sx, p_size <> 7 AS persp FROM part),
           f AS (SELECT *, CASE WHEN fit = 'AUTO' THEN CASE WHEN w >= h THEN 'HORIZONTAL' ELSE 'VERTICAL' END ELSE fit END AS sf FROM c)
           SELECT p_partkey, CASE WHEN persp THEN {_ROUND("lens * CASE WHEN sf = 'VERTICAL' THEN w / 36.0::DOUBLE / 1.25::DOUBLE ELSE w / 36.0::DOUBLE END")} END AS fx, CASE WHEN persp THEN {_ROUND("lens * CASE WHEN sf = 'VERTICAL' THEN h / 24.0::DOUBLE ELSE h * 1.25::DOUBLE / 24.0::DOUBLE END")} END AS fy,
           CASE WHEN persp THEN {_ROUND("w / 2.0::DOUBLE - sx * w")} ELSE w / 2.0::DOUBLE END AS cx, CASE WHEN persp THEN {_ROUND("h / 2.0::DOUBLE + 0.01::DOUBLE * h")} ELSE h / 2.0::DOUBLE END AS cy FROM f""")
def camera_intrinsics(spark: SparkSession, sf_dir: str) -> DataFrame:
    (size,) = _NUM("p_size")
    k = F.col("p_partkey") % 3
    fit = F.when(k == 0, "AUTO").when(k == 1, "VERTICAL").otherwise("HORIZONTAL")
    cols = cameras.intrinsics(size + 512.0, F.lit(540.0), size + 35.0, F.lit(36.0), F.lit(24.0), fit, size / 1000.0, F.lit(0.01), F.lit(1.25), F.col("p_size") != 7)
    return table(spark, sf_dir, "part").select("p_partkey", *[v.alias(n) for n, v in cols.items()])


@query(f"""WITH c AS (SELECT l_orderkey, l_linenumber, unnest([l_discount - 0.05, l_discount + 0.9]) AS x, l_tax AS y, l_quantity AS q FROM lineitem), d AS (SELECT l_orderkey, x, unnest([y - 0.02, y + 0.8]) AS y, q FROM c), e AS (SELECT l_orderkey, x, y, unnest([q - 30.0, q + 1.0]) AS z FROM d),
           s AS (SELECT l_orderkey, x * 640.0::DOUBLE AS px, (1.0::DOUBLE - y) * 480.0::DOUBLE AS py FROM e WHERE z > 0)
           SELECT l_orderkey, {_ROUND("greatest(0.0::DOUBLE, min(px))")} AS x0, {_ROUND("greatest(0.0::DOUBLE, min(py))")} AS y0, {_ROUND("least(640.0::DOUBLE, max(px))")} AS x1, {_ROUND("least(480.0::DOUBLE, max(py))")} AS y1 FROM s GROUP BY 1""")
def box_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, t, q = _NUM("l_discount", "l_tax", "l_quantity")
    corners = table(spark, sf_dir, "lineitem").select("l_orderkey", F.inline(cameras.box_corners([d - 0.05, t - 0.02, q - 30.0], [d + 0.9, t + 0.8, q + 1.0])))
    return cameras.box_on_image(corners, "l_orderkey", F.col("x"), F.col("y"), F.col("z"), 640.0, 480.0)


_BOX = ", ".join(f"min({c}) AS {a}_min, max({c}) AS {a}_max, (min({c}) + max({c})) / 2 AS {a}_center, max({c}) - min({c}) AS {a}_size" for a, c in (("x", "l_quantity"), ("y", "l_extendedprice"), ("z", "l_discount")))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("z"))


@query(f"SELECT l_orderkey, {_BOX} FROM lineitem GROUP BY 1")
def exact_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cameras.exact_bbox(_points(spark, sf_dir), "l_orderkey")


@query(f"""WITH b AS (SELECT l_orderkey, {_BOX} FROM lineitem GROUP BY 1), s AS (SELECT *, CASE WHEN greatest(x_size, y_size, z_size) > 1e-8 THEN 2.0 / greatest(x_size, y_size, z_size) ELSE 1.0 END AS k FROM b)
           SELECT l_orderkey, l_linenumber, (l_quantity - x_center) * k AS x, (l_extendedprice - y_center) * k AS y, (l_discount - z_center) * k AS z FROM lineitem JOIN s USING (l_orderkey)""")
def unit_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cameras.unit_box(_points(spark, sf_dir), "l_orderkey")


@query("""SELECT p_partkey, CASE WHEN p_size <= 1e-6 OR p_size BETWEEN 10.0 AND 20.0 THEN 1.0 ELSE 15.0 / p_size END AS fit, (p_size + p_retailprice + 3.0) / 3.0 * 0.1 / p_size AS scene FROM part""")
def size_fitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, price = _NUM("p_size", "p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", cameras.fit_factor(size, 10.0, 20.0).alias("fit"), cameras.scene_factor([size, price, F.lit(3.0)], size).alias("scene"))


_EPS = "greatest(0.0005, least(0.0025, greatest(0.0014::DOUBLE * 0.55::DOUBLE, greatest(h, 1e-3) * 0.0018)))"


@query(f"""WITH p AS (SELECT p_partkey, p_size / 40.0::DOUBLE AS h, p_retailprice / 1e5 - 0.011::DOUBLE AS z FROM part), e AS (SELECT *, {_EPS} AS eps, 0.0::DOUBLE - least(0.0008, greatest(h, 1e-3) * 0.0015) AS lo FROM p),
           m AS (SELECT *, 0.0::DOUBLE + greatest(eps * 1.15, least(0.0028, greatest(h, 1e-3) * 0.0028)) AS hi FROM e), c AS (SELECT *, CASE WHEN z < lo THEN lo - z WHEN z > hi THEN hi - z ELSE 0.0 END AS move FROM m)
           SELECT p_partkey, eps AS tolerance, CASE WHEN abs(move) > 1e-6 THEN {_ROUND("move")} ELSE 0.0 END AS correction FROM c""")
def ground_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, price = _NUM("p_size", "p_retailprice")
    h = size / 40.0
    tolerance = cameras.contact_tolerance(h)
    return table(spark, sf_dir, "part").select("p_partkey", tolerance.alias("tolerance"), cameras.contact_correction(price / 1e5 - 0.011, h, F.lit(0.0), tolerance).alias("correction"))


@query("""WITH s AS (SELECT p_partkey, p_size / 20.0::DOUBLE AS x, p_retailprice / 1000.0::DOUBLE AS y, (p_partkey % 10) / 5.0::DOUBLE AS z FROM part)
          SELECT p_partkey, least(greatest(greatest(sqrt(x * x + y * y + z * z), 1e-3) * 2.2, greatest(x, y, z, 1e-3) * 2.8, 2.0), 8.0) AS distance, 0.5 + z * 0.45 AS target_z FROM s""")
def camera_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, price = _NUM("p_size", "p_retailprice")
    distance, z = cameras.camera_distance(size / 20.0, price / 1000.0, (F.col("p_partkey") % 10).cast("double") / 5.0, F.lit(0.5))
    return table(spark, sf_dir, "part").select("p_partkey", distance.alias("distance"), z.alias("target_z"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_tax AS ox, l_discount AS oy, l_quantity / 10.0 AS oz, l_tax + 1.0 AS px, l_discount + 0.5 AS py, l_quantity / 10.0 + (l_linenumber - 3) AS pz FROM lineitem),
               d AS (SELECT *, px - ox AS dx, py - oy AS dy, pz - oz AS dz FROM r), n AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS nn FROM d), t AS (SELECT *, CASE WHEN abs(dz / nn) >= 1e-6 THEN (0.0 - oz) / (dz / nn) END AS t FROM n)
          SELECT l_orderkey, l_linenumber, CASE WHEN t > 0 THEN ox + dx / nn * t END AS x, CASE WHEN t > 0 THEN oy + dy / nn * t END AS y FROM t""")
def ground_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    tax, d, q = _NUM("l_tax", "l_discount", "l_quantity")
    z = q / 10.0
    step = F.col("l_linenumber") - 3
    away = F.when(step == 0, F.lit(None).cast("double")).otherwise(step)  # a level ray meets nothing
    x, y, _ = cameras.ground_anchor([tax, d, z], [tax + 1.0, d + 0.5, z + away], F.lit(0.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"), y.alias("y"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 5 THEN 1e10 ELSE l_quantity END AS d FROM lineitem), s AS (SELECT l_orderkey, min(d) FILTER (d < 1e9) AS lo, max(d) FILTER (d < 1e9) AS hi FROM p GROUP BY 1)
          SELECT l_orderkey, l_linenumber, CASE WHEN d >= 1e9 THEN 0 WHEN hi > lo THEN CAST(floor((1.0 - (d - lo) / (hi - lo)) * 65535) AS INTEGER) ELSE 32768 END AS level FROM p JOIN s USING (l_orderkey)""")
def depth_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 5, 1e10).otherwise(F.col("l_quantity")).alias("d"))
    return cameras.depth_levels(p, "l_orderkey", "d").drop("d")


@query("""SELECT event_id, greatest(0.5, least(2.0, 1.0 + (120.0 / greatest(value, 1e-6) - 1.0) * 0.6)) AS gain,
          CASE WHEN event_id % 11 = 0 THEN 'explicit' WHEN abs(value / 100.0 - 1.0) > 0.12 THEN 'value_scale' WHEN abs((event_id % 5) / 50.0 - 0.0) > 0.02 THEN 'hue_offset' ELSE 'keep' END AS material FROM events""")
def light_and_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    (v,) = _NUM("value")
    hue = (F.col("event_id") % 5).cast("double") / 50.0
    return table(spark, sf_dir, "events").select("event_id", cameras.brightness_gain(F.lit(120.0), v, 0.6, 0.5, 2.0).alias("gain"), cameras.force_reference(F.col("event_id") % 11 == 0, {"value_scale": v / 100.0, "hue_offset": hue}).alias("material"))


@query(f"SELECT vec_id, {_ROUND('CAST(embedding[1] AS DOUBLE)')} AS first, {_ROUND('CAST(embedding[len(embedding)] AS DOUBLE)')} AS last, len(embedding) AS n FROM embeddings")
def rounded_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = cameras.rounded_vector(F.col("embedding").cast("array<double>"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.element_at(v, 1).alias("first"), F.element_at(v, -1).alias("last"), F.size(v).cast("long").alias("n"))


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
          SELECT user_id, event_id FROM r WHERE n <= 10 OR i IN (SELECT k * (n - 1) // 9 FROM range(10) t(k))""")
def evenly_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cameras.evenly_spaced(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", ["event_id"], 10)


@query("""WITH s AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, l_quantity FROM lineitem) SELECT l_orderkey, l_quantity AS height FROM s WHERE i = greatest(1, CAST(ceil(n * 0.75) AS BIGINT))""")
def ray_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("hits"))  # the few rays of one object
    return hits.select("l_orderkey", cameras.ray_height(F.col("hits")).alias("height"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice AS area FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) = 1")
def support_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("area"), F.struct("l_linenumber", "l_partkey").alias("z"))
    return cameras.choose_support(planes, "l_orderkey").drop("z")


@query("""WITH o AS (SELECT s_nationkey, s_name, s_acctbal AS min_z, s_suppkey % 7 AS sx, s_suppkey % 5 AS sy, s_suppkey % 4 AS sz FROM supplier),
               r AS (SELECT *, CASE WHEN contains(lower(s_name), '9') THEN 0 WHEN sz <= 0.5 * greatest(sx, sy) THEN 1 ELSE 2 END AS rank FROM o)
          SELECT s_nationkey, s_name AS name, rank FROM r QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY rank, min_z, s_name) = 1""")
def ground_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    o = table(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_name").alias("name"), F.col("s_acctbal").alias("min_z"), (k % 7).alias("size_x"), (k % 5).alias("size_y"), (k % 4).alias("size_z"))
    return cameras.ground_object(o, "s_nationkey", F.lit("9")).select("s_nationkey", "name", "rank")


_FLOOR = {"area": 0.02, "footprint": 0.1, "thickness": 0.5, "overhang": 0.2, "inliers": 0.3}


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_discount * 5 AS a, l_tax * 12 AS f, l_quantity / 50.0 AS o, l_quantity / 60.0 + 0.2 AS i, l_tax * 7 AS t FROM lineitem)
          SELECT l_orderkey, l_linenumber, CASE WHEN a >= 0.02 AND f >= 0.1 AND t <= 0.5 AND o >= 0.2 AND i >= 0.3 THEN 0.30 * least(a / 0.40, 1.0) + 0.20 * least(f / 0.90, 1.0) + 0.15 * least((o - 0.2) / 0.60, 1.0) + 0.20 * least((i - 0.3) / (1.0::DOUBLE - 0.3::DOUBLE), 1.0) + 0.15 * least((0.5 - t) / 0.5, 1.0) END AS confidence FROM m""")
def floor_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, t, q = _NUM("l_discount", "l_tax", "l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cameras.floor_confidence(d * 5, t * 12, q / 50.0, q / 60.0 + 0.2, t * 7, _FLOOR).alias("confidence"))


@query("""WITH b AS (SELECT l_orderkey, max_by(struct_pack(a := l_discount, t := l_tax, f := l_quantity / 50.0), (l_discount, -l_linenumber, l_tax, l_quantity)) AS b, min(l_tax) AS thinnest, bool_or(l_quantity > 45) AS any_passes, max(l_tax) AS gap, bool_or(l_returnflag = 'R') AS det FROM lineitem GROUP BY 1)
          SELECT l_orderkey, b.a AS max_area, thinnest, any_passes, CAST(b.a > 0.05 AS INTEGER) + CAST(b.t < 0.10 AS INTEGER) + CAST(b.f > 0.30 AS INTEGER) + CAST(gap > 0.05 AS INTEGER) + CAST(det AS INTEGER) AS signal FROM b""")
def floor_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("pos"), F.col("l_discount").alias("area"), F.col("l_tax").alias("thickness"), (F.col("l_quantity") / 50.0).alias("footprint"), (F.col("l_quantity") > 45).alias("passes"), "l_returnflag")
    return cameras.floor_signal(s, "l_orderkey", F.col("thickness"), F.col("l_returnflag") == "R")


@query("""WITH s AS (SELECT p_brand, p_size, unnest([0.02, 0.05, 0.1, 0.2]) AS band FROM part), g AS (SELECT p_brand, p_size, band, unnest([0.7, 0.85, 0.95]) AS dot FROM s)
          SELECT p_brand, band, dot, count(*) FILTER (p_size <= band * 50 AND p_size >= (1 - dot) * 50) AS seeds FROM g GROUP BY 1, 2, 3""")
def parameter_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = cameras.swept(table(spark, sf_dir, "part").select("p_brand", "p_size"), {"band": (0.02, 0.05, 0.1, 0.2), "dot": (0.7, 0.85, 0.95)})
    return g.groupBy("p_brand", "band", "dot").agg(F.count_if((F.col("p_size") <= F.col("band") * 50) & (F.col("p_size") >= (1 - F.col("dot")) * 50)).alias("seeds"))


@query("""WITH f AS (SELECT l_suppkey, l_quantity AS z, l_quantity <= 2 AS gone FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, l_quantity FROM lineitem)),
               m AS (SELECT l_suppkey, count(*) FILTER (NOT gone) AS kept, max(z) - min(z) AS whole, max(z) FILTER (NOT gone) - min(z) FILTER (NOT gone) AS rest FROM f GROUP BY 1), l AS (SELECT *, CASE WHEN whole > 0 THEN (whole - coalesce(rest, 0.0)) / whole ELSE 0.0 END AS height_loss FROM m)
          SELECT l_suppkey, kept, height_loss, kept >= 200 AND height_loss <= 0.08 AS done FROM l""")
def floor_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "lineitem").select("l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_quantity").alias("face"), F.col("l_quantity").alias("z")).distinct()
    return cameras.without_faces(f, f.where("z <= 2"), "l_suppkey", "face")


_MARKS = "min(v) AS min, quantile_cont(v, 0.05) AS p05, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.95) AS p95, max(v) AS max, avg(v) AS mean, stddev_pop(v) AS std"
_TOLD = ("min", "p05", "median", "p95", "max", "mean", "std", "coefficient_of_variation", "relative_range")


def _statistics(source: str) -> str:
    """SQL of the statistics of ``v`` by ``l_suppkey``, rounded."""
    rest = "std / greatest(abs(mean), 1e-9) AS coefficient_of_variation, (max - min) / greatest(abs(mean), 1e-9) AS relative_range"
    return f"q AS (SELECT l_suppkey, count(*) AS n, {_MARKS} FROM {source} GROUP BY 1), t AS (SELECT *, {rest} FROM q) SELECT l_suppkey, n, {', '.join(f'{_ROUND(c)} AS {c}' for c in _TOLD)} FROM t"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c), 6) for c in _TOLD})


#: Points of a cloud that are looked at.
SAMPLED = 20_000


@query(f"""WITH c AS (SELECT l_suppkey, sqrt(l_quantity * l_quantity + l_discount * l_discount * 10000 + l_tax * l_tax * 10000) AS v, row_number() OVER () - 1 AS i FROM lineitem), k AS (SELECT count(*) AS n FROM lineitem),
           s AS (SELECT c.* FROM c, k WHERE n <= {SAMPLED} OR i = n - 1 OR i IN (SELECT CAST(floor(j * ((n - 1)::DOUBLE / {SAMPLED - 1})) AS BIGINT) FROM range({SAMPLED - 1}) r(j), k)), {_statistics("s")}""")
def radial_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cloud's evenly spaced points in the order of the file, by part."""
    cloud = readers.placed(table(spark, sf_dir, "lineitem")).select("l_suppkey", "l_quantity", (F.col("l_discount") * 100).alias("d"), (F.col("l_tax") * 100).alias("t"), "_file", "_block")
    every = readers.numbered(cloud, "i")
    return _rounded(stats.radial_statistics(stats.evenly_sampled(every, "i", every.count(), SAMPLED), "l_suppkey", ["l_quantity", "d", "t"]))


@query(f"WITH s AS (SELECT l_suppkey, l_quantity - 5 AS v FROM lineitem WHERE l_quantity > 5), {_statistics('s')}")
def depth_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.depth_statistics(table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_quantity") - 5).alias("depth")), "l_suppkey", "depth"))


@query(f"""WITH p AS (SELECT l_suppkey AS image, CASE l_suppkey % 3 WHEN 2 THEN 0.95::DOUBLE ELSE l_quantity / 50.0::DOUBLE END AS r, CASE l_suppkey % 3 WHEN 2 THEN 0.97::DOUBLE ELSE l_discount * 9 END AS g, CASE l_suppkey % 3 WHEN 2 THEN 1.0::DOUBLE - l_tax / 10 ELSE l_tax * 12 END AS b,
                  CASE l_suppkey % 3 WHEN 0 THEN l_discount * 10 ELSE 0.1::DOUBLE END AS a FROM lineitem),
           m AS (SELECT *, count(*) FILTER (a > 0.2) OVER w AS n0, count(*) FILTER (NOT least(r, g, b) > 0.94) OVER w AS n1 FROM p WINDOW w AS (PARTITION BY image)),
           c AS (SELECT * FROM m WHERE CASE WHEN n0 >= 32 THEN a > 0.2 WHEN n1 >= 32 THEN NOT least(r, g, b) > 0.94 ELSE true END),
           q AS (SELECT image, count(*) AS pixel_count, {", ".join(f"floor((avg({x}) * 0.4 + quantile_cont({x}, 0.35) * 0.6) * 10000.0 + 0.5) / 10000.0 AS {x}" for x in "rgb")} FROM c GROUP BY 1)
           SELECT image, r, g, b, pixel_count, CASE WHEN greatest(r, g, b) <= 1e-6 THEN 0.0 ELSE {_ROUND("(greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b)")} END AS colorfulness FROM q""")
def reference_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's lines as an image's points: see-through in part, wholly, or wholly and white."""
    k = F.col("l_suppkey") % 3
    white = lambda x, y: F.when(k == 2, x).otherwise(y)
    d, t, q = _NUM("l_discount", "l_tax", "l_quantity")
    p = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("image"), white(F.lit(0.95), q / 50.0).alias("r"), white(F.lit(0.97), d * 9).alias("g"), white(1.0 - t / 10, t * 12).alias("b"), F.when(k == 0, d * 10).otherwise(0.1).alias("a")
    )
    return stats.reference_color(p, "image", ["r", "g", "b"], "a")


@query(f"""WITH b AS (SELECT event_id, user_id, value, CASE WHEN count(value) OVER w >= 10 THEN floor((quantile_cont(value, 0.1) OVER w) * 10000.0 + 0.5) / 10000.0 ELSE 40.0 END AS lo, CASE WHEN count(value) OVER w >= 10 THEN floor((quantile_cont(value, 0.9) OVER w) * 10000.0 + 0.5) / 10000.0 ELSE 180.0 END AS hi
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW))
           SELECT event_id, user_id, {_ROUND("CASE WHEN value IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0, (ln(1 + value) - ln(1 + lo)) / (ln(1 + hi) - ln(1 + lo) + 1e-6))) END")} AS sharpness FROM b""")
def sharpness_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's value as a variance, scored against its user's last 500."""
    b = stats.rolling_band(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    return b.select("event_id", "user_id", rounded(stats.sharpness(F.col("value"), F.col("band_lo"), F.col("band_hi")), 6).alias("sharpness"))
