"""Statistical profiles: spreads, rolling calibration, weighted bins, gaps, boxes, foregrounds."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import rounded
from ..graph import dealt
from ..session import kept


#: Bins by which quantiles are narrowed down.
QUANTILE_BINS = 4096
#: Rows of a key that a task should have.
SLICE_ROWS = 1_000_000


def sliced(rows: DataFrame, key: str, by: list[str]) -> tuple[DataFrame, DataFrame | None, int]:
    """``rows`` with _slice and dealt out by (key, _slice), the keys of many rows with their _slices (None if there are none), and the number of rows.

    A key has one slice for each ``SLICE_ROWS`` of its rows, told by a hash of ``by``.
    """
    n = rows.count()
    large = kept(rows.groupBy(key).count().where(F.col("count") > SLICE_ROWS).select(key, F.ceil(F.col("count") / SLICE_ROWS).cast("int").alias("_slices"))) if n > SLICE_ROWS else None
    if large is None or large.isEmpty():
        # no literal: that would be taken out of the joins, and rows would move again
        return dealt(rows.withColumn("_slice", F.pmod(F.xxhash64(*by), F.lit(1)).cast("int")), n, key, "_slice"), None, n
    cut = F.pmod(F.xxhash64(*by), F.coalesce("_slices", F.lit(1))).cast("int")
    return dealt(rows.join(F.broadcast(large), key, "left").withColumn("_slice", cut).drop("_slices"), n, key, "_slice"), large, n


def _for_slices(per_key: DataFrame, key: str, large: DataFrame | None) -> DataFrame:
    """``per_key``, unique by key, once for each slice of its key."""
    if large is None:
        return per_key.withColumn("_slice", F.explode(F.array(F.lit(0))))
    last = F.coalesce("_slices", F.lit(1)) - 1
    return per_key.join(F.broadcast(large), key, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), last))).drop("_slices")


def quantiles(rows: DataFrame, key: str, values: list[str], shares: list[float]) -> DataFrame:
    """(key, name, share, q): exact quantiles, between two values in proportion; a key may hold any number of rows."""
    return quantiles_of(*sliced(rows.select(key, *values), key, values), key, values, shares)


def quantiles_of(rows: DataFrame, large: DataFrame | None, n: int, key: str, values: list[str], shares: list[float]) -> DataFrame:
    """The quantiles of rows that ``sliced`` has dealt out.

    Bins of equal width between a key's ends are counted, and only the rows of those bins are ordered
    in which a wanted rank falls; equal values there count as one row. Rows stay where they are; what
    a slice has counted goes on.
    """
    at = range(len(values))
    sound = [F.when(~F.isnan(v), v) for v in (F.col(x).cast("double") for x in values)]
    rows = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), "_slice", *[c.alias(f"v{i}") for i, c in enumerate(sound)])
    large = None if large is None else large.withColumnRenamed(key, "key")
    ends = rows.groupBy("key").agg(*[f(f"v{i}").alias(f"{x}{i}") for i in at for x, f in (("lo", F.min), ("hi", F.max))])

    def placed(marks: DataFrame, more: Callable[[int], Column]) -> DataFrame:
        lo, hi, v = ([F.col(f"{x}{i}") for i in at] for x in ("lo", "hi", "v"))
        bins = [F.when(h > low, F.least(F.lit(QUANTILE_BINS - 1), F.floor((x - low) / (h - low) * QUANTILE_BINS))).otherwise(0).cast("int") for low, h, x in zip(lo, hi, v, strict=True)]
        each = [F.struct(F.lit(i).alias("i"), v[i].alias("v"), bins[i].alias("bin"), more(i).alias("wanted")) for i in at]
        return rows.join(_for_slices(marks, "key", large), ["key", "_slice"]).select("key", "_slice", F.inline(F.array(*each))).where("v is not null")

    part = placed(ends, lambda i: F.lit(0)).groupBy("key", "_slice", "i", "bin").agg(F.count("*").alias("c"))
    counts = dealt(part, len(values) * n, "key").groupBy("key", "i", "bin").agg(F.sum("c").alias("c"))
    of = Window.partitionBy("key", "i")
    counts = counts.withColumns({"before": F.sum("c").over(of.orderBy("bin")) - F.col("c"), "n": F.sum("c").over(of)})
    ranks = [(f(F.lit(s) * (F.col("n") - 1))) for s in shares for f in (F.floor, F.ceil)]
    held = counts.where(reduce(or_, [(r >= F.col("before")) & (r < F.col("before") + F.col("c")) for r in ranks])).select("key", "i", "bin", "before", "n")
    # the bins that are wanted of a key, at most two for each share, go along with its ends
    bins_of = held.groupBy("key").agg(*[F.array_sort(F.collect_set(F.when(F.col("i") == i, F.col("bin")))).alias(f"b{i}") for i in at])
    most = 2 * len(shares)
    marks = ends.join(bins_of, "key").select("key", *[f"{x}{i}" for i in at for x in ("lo", "hi")], *[F.get(f"b{i}", F.lit(k)).alias(f"b{i}_{k}") for i in at for k in range(most)])
    few = placed(marks, lambda i: F.array(*[F.col(f"b{i}_{k}") for k in range(most)])).where("array_contains(wanted, bin)")
    few = few.groupBy("key", "_slice", "i", "bin", "v").agg(F.count("*").alias("c"))
    few = few.groupBy("key", "i", "bin", "v").agg(F.sum("c").alias("c")).join(held, ["key", "i", "bin"])
    steps = few.withColumn("top", F.sum("c").over(Window.partitionBy("key", "i", "bin").orderBy("v")) + F.col("before")).withColumn("first", F.col("top") - F.col("c"))
    step = lambda r: F.max(F.when((r >= F.col("first")) & (r < F.col("top")), F.col("v")))
    found = steps.groupBy("key", "i", "n").agg(*[step(r).alias(f"r{k}") for k, r in enumerate(ranks)])
    names = F.element_at(F.array(*map(F.lit, values)), F.col("i") + 1)
    place = [F.lit(s) * (F.col("n") - 1) for s in shares]
    q = [F.col(f"r{2 * k}") + (F.col(f"r{2 * k + 1}") - F.col(f"r{2 * k}")) * (p - F.floor(p)) for k, p in enumerate(place)]
    return found.select(F.col("key").alias(key), names.alias("name"), F.inline(F.array(*[F.struct(F.lit(s).alias("share"), x.alias("q")) for s, x in zip(shares, q, strict=True)])))


def spread(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Exact percentiles and moments of finite values, with the coefficient of variation."""
    v = F.col(value)
    sound = rows.where(v.isNotNull() & ~F.isnan(v))
    moments = sound.groupBy(key).agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), rounded(F.avg(v)).alias("mean"), rounded(F.stddev_pop(v)).alias("sigma"), rounded(F.stddev_pop(v) / F.avg(v)).alias("variation"))
    at = lambda p: rounded(F.max(F.when(F.col("share") == p, F.col("q"))))
    marks = quantiles(sound, key, [value], [0.05, 0.5, 0.95]).groupBy(key).agg(at(0.05).alias("p05"), at(0.5).alias("p50"), at(0.95).alias("p95"))
    return moments.join(marks, key).select(key, "n", "lo", "p05", "p50", "p95", "hi", "mean", "sigma", "variation")


def rolling_band(rows: DataFrame, key: str, order: list[str], value: str, size: int = 500, lo: float = 0.1, hi: float = 0.9, least: int = 10, default: tuple[float, float] = (40.0, 180.0)) -> DataFrame:
    """``rows`` with the percentiles of the last ``size`` values, defaults until there are ``least``."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - size, 0)
    n = F.count(value).over(w)
    band = lambda p, d: F.when(n >= least, rounded(F.percentile(value, F.lit(p)).over(w))).otherwise(d)
    return rows.withColumn("band_lo", band(lo, default[0])).withColumn("band_hi", band(hi, default[1]))


def sharpness(value: Column, lo: Column, hi: Column) -> Column:
    """A variance's place between the ends of its band on a logarithmic scale, 0 to 1; a null variance is in the middle."""
    score = (F.log1p(value) - F.log1p(lo)) / (F.log1p(hi) - F.log1p(lo) + 1e-6)
    return F.when(score.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def weighted_bins(rows: DataFrame, key: str, value: str, weight: str, step: float) -> DataFrame:
    """Total weight and weighted mean of each bin, with the bins' order by weight."""
    bin_of = F.bround(F.col(value) / step, 0).cast("long")
    bins = rows.groupBy(key, bin_of.alias("bin")).agg(F.sum(weight).alias("weight"), (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("centre"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("weight", 2)), "bin"))
    return bins.withColumn("place", place)


def widest_gap(rows: DataFrame, key: str, value: str, bins: int = 50) -> DataFrame:
    """(key, filled, gap): bins with values, and the longest run of empty ones between them."""
    ends = rows.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    met = rows.join(ends, key).where("hi > lo")
    k = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).alias("k")
    cells = met.select(key, k).distinct()
    gap = F.col("k") - F.lag("k").over(Window.partitionBy(key).orderBy("k")) - 1
    return cells.withColumn("g", F.coalesce(gap, F.lit(0))).groupBy(key).agg(F.count("*").alias("filled"), F.max("g").alias("gap"))


def percentile_box(rows: DataFrame, key: str, axes: list[str], lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Per axis the percentiles, for each key."""
    at = lambda a, p: rounded(F.max(F.when((F.col("name") == a) & (F.col("share") == p), F.col("q"))))
    return quantiles(rows, key, axes, [lo, hi]).groupBy(key).agg(*[at(a, p).alias(f"{a}_{n}") for a in axes for n, p in (("lo", lo), ("hi", hi))])


def foreground(rows: DataFrame, key: str, channels: list[str], border: Column, distance: float) -> DataFrame:
    """(key, n, fraction): the share of points farther than ``distance`` from the border's mean."""
    back = rows.where(border).groupBy(key).agg(*[F.avg(c).alias(f"_{c}") for c in channels])
    far = sum(((F.col(c) - F.col(f"_{c}")) ** 2 for c in channels), F.lit(0.0)) > distance**2
    return rows.join(back, key).groupBy(key).agg(F.count("*").alias("n"), F.count_if(far).alias("far"))


def exposure(clipped: Column, median: Column) -> Column:
    return 1 - 0.6 * F.least(F.lit(1.0), 2 * clipped) - 0.4 * F.least(F.lit(1.0), 1.5 * F.abs(median - 0.45))


def saturation(r: Column, g: Column, b: Column) -> Column:
    """HSV saturation, 0 for black."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(top <= 1e-6, 0.0).otherwise((top - low) / top)


def evenly_sampled(rows: DataFrame, index: str, n: int, most: int) -> DataFrame:
    """``most`` of ``n`` numbered rows at even steps from the first to the last, all if there are no more; no sort."""
    if n <= most:
        return rows
    i, step = F.col(index), (n - 1) / (most - 1)
    near = F.floor(i / F.lit(step))
    hit = lambda k: (k >= 0) & (k < most - 1) & (F.floor(k * F.lit(step)) == i)
    return rows.where((i == n - 1) | hit(near - 1) | hit(near) | hit(near + 1))


def distance_statistics(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """Per key of the finite values: n, min, p05, median, p95, max, mean, std, coefficient_of_variation, relative_range."""
    sound = rows.select(F.col(key).alias("_k"), value.cast("double").alias("_v")).where("_v is not null and not isnan(_v) and abs(_v) < double('infinity')")
    m = sound.groupBy("_k").agg(F.count("*").alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"))
    size = F.greatest(F.abs("mean"), F.lit(1e-9))
    m = m.select("_k", "n", "min", "max", "mean", "std", (F.col("std") / size).alias("coefficient_of_variation"), ((F.col("max") - F.col("min")) / size).alias("relative_range"))
    at = lambda p: F.max(F.when(F.col("share") == p, F.col("q")))
    marks = quantiles(sound, "_k", ["_v"], [0.05, 0.5, 0.95]).groupBy("_k").agg(at(0.05).alias("p05"), at(0.5).alias("median"), at(0.95).alias("p95"))
    return m.join(marks, "_k").withColumnRenamed("_k", key)


def radial_statistics(points: DataFrame, key: str, axes: list[str]) -> DataFrame:
    """The same of the points' distances from the origin."""
    return distance_statistics(points, key, F.sqrt(sum((F.col(a) * F.col(a) for a in axes), F.lit(0.0))))


def depth_statistics(depths: DataFrame, key: str, value: str) -> DataFrame:
    """The same of the positive depths; a key without any has no row."""
    return distance_statistics(depths.where(F.col(value) > 0), key, F.col(value))


#: A mask of fewer points is not used.
LEAST_MASKED = 32


def reference_color(pixels: DataFrame, image: str, channels: list[str], alpha: str) -> DataFrame:
    """Per image: the colour of what it shows (r, g, b), pixel_count, colorfulness.

    The points that count are those that are not see-through; if these are too few, those that are not
    nearly white; if these are too few, all. All masks are counted in one pass. The colour is a blend of
    the mean with the quantile 0.35 of each channel.
    """
    solid = F.coalesce(F.col(alpha) > 0.2, F.lit(False))
    colored = ~F.coalesce(F.least(*channels) > 0.94, F.lit(False))
    marked = pixels.select(F.col(image).alias("_k"), *channels, solid.alias("_m0"), colored.alias("_m1"))
    marked, large, n = sliced(marked, "_k", channels)
    counts = marked.groupBy("_k").agg(F.count_if("_m0").alias("_n0"), F.count_if("_m1").alias("_n1"))
    chosen = marked.join(_for_slices(counts, "_k", large), ["_k", "_slice"]).where(F.when(F.col("_n0") >= LEAST_MASKED, F.col("_m0")).when(F.col("_n1") >= LEAST_MASKED, F.col("_m1")).otherwise(True))
    means = chosen.groupBy("_k").agg(F.count("*").alias("pixel_count"), *[F.avg(c).alias(f"_{c}") for c in channels])
    low = quantiles_of(chosen, large, n, "_k", channels, [0.35]).groupBy("_k").agg(*[F.max(F.when(F.col("name") == c, F.col("q"))).alias(f"_low_{c}") for c in channels])
    t = means.join(low, "_k").withColumns({n: rounded(F.col(f"_{c}") * 0.4 + F.col(f"_low_{c}") * 0.6, 4) for n, c in zip("rgb", channels, strict=True)})
    return t.select(F.col("_k").alias(image), "r", "g", "b", "pixel_count", rounded(saturation(F.col("r"), F.col("g"), F.col("b")), 6).alias("colorfulness"))
