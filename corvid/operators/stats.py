"""Benchmark statistics: percentiles, confidence intervals, variability, outliers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.plans.scratch import few_rows, running_sum

#: Two-sided 95 % quantiles of Student's t for 1 to 30 degrees of freedom (fixed values); beyond, of the normal distribution.
T95 = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042)
Z95 = 1.96


def t_quantile(n: Column) -> Column:
    """For n observations; null below two."""
    table = F.array(*(F.lit(x) for x in T95))
    return F.when(n < 2, None).when(n <= len(T95) + 1, F.get(table, (n - 2).cast("int"))).otherwise(Z95)


def _equal(by: list[str], left: str, right: str) -> Column:
    out = F.lit(True)
    for c in by:
        out &= F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def values_at(rows: DataFrame, by: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Per group n, the number of its values, and by name the values at 0-based places, given n, in ascending order.

    Equal values are counted first. In larger tables the counts are added up over range partitions, so that no task holds
    all values of a group; what is left then is a smallest value for each place. Null values don't count.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    if few_rows(rows):
        w = Window.partitionBy(*by)
        placed = counts.withColumn("upto", F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    else:
        placed = running_sum(counts, by, [F.col(value)], "c", "upto", "n")
    at = lambda place: F.min(F.when(F.col("upto") > place(F.col("n")), F.col(value)))
    return placed.groupBy(*by).agg(F.max("n").alias("n"), *(at(place).alias(name) for name, place in places.items()))


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per group n and exact percentiles, interpolated between the two values around the place share * (n - 1)."""
    if few_rows(rows):
        pct = F.percentile(F.col(value), F.array(*map(F.lit, shares.values())))
        return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(value).alias("n"), pct.alias("p")).select(*by, "n", *(F.get("p", F.lit(k)).alias(name) for k, name in enumerate(shares)))
    around = {f"__{side}_{name}": (lambda n, s=s, f=f: f((n - 1) * s)) for name, s in shares.items() for side, f in (("low", F.floor), ("high", F.ceil))}
    place = lambda s: (F.col("n") - 1) * s
    between = [(F.col(f"__low_{m}") + (F.col(f"__high_{m}") - F.col(f"__low_{m}")) * (place(s) - F.floor(place(s)))).alias(m) for m, s in shares.items()]
    return values_at(rows, by, value, around).select(*by, "n", *between)


def summary(rows: DataFrame, by: list[str], value: str, prefix: str = "") -> DataFrame:
    """Per group: n, mean, std (of a sample, null for one), min, max, p50, p95, p99 (interpolated), ci_lower, ci_upper, cv in %."""
    v = F.col(value)
    figures = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")]
    if few_rows(rows):
        pct = F.percentile(v, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
        out = rows.groupBy(*by).agg(*figures, pct.alias("pct")).select(*by, *("n mean std min max".split()), *(F.get("pct", F.lit(k)).alias(name) for k, name in enumerate(("p50", "p95", "p99"))))
    else:
        shares = percentiles(rows, by, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}).alias("p")
        out = rows.groupBy(*by).agg(*figures).alias("s").join(shares, _equal(by, "s", "p"), "left").select("s.*", "p50", "p95", "p99")
    half = t_quantile(F.col("n")) * F.col("std") / F.sqrt("n")
    r = lambda c, name: F.round(c, 6).alias(prefix + name)
    return out.select(
        *by, F.col("n").alias(prefix + "n"), *(r(F.col(c), c) for c in ("mean", "std", "min", "max", "p50", "p95", "p99")),
        r(F.col("mean") - half, "ci_lower"), r(F.col("mean") + half, "ci_upper"), r(F.when(F.col("mean") != 0, F.col("std") / F.col("mean") * 100), "cv"),
    )


def nearest_rank(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per group the values at 0-based place floor(n * share) in ascending order."""
    return values_at(rows, by, value, {name: (lambda n, s=s: F.floor(n * s)) for name, s in shares.items()})


def tail_outliers(rows: DataFrame, by: list[str], value: str, times: float = 2.0) -> DataFrame:
    """Per group the values above `times` the 95th percentile (0-based place floor(.95 n)): limit, count, share, median, largest."""
    limit = nearest_rank(rows, by, value, {"p95": 0.95}).select(*by, "n", (F.col("p95") * times).alias("limit"))
    out = rows.alias("r").join(limit.alias("l"), _equal(by, "r", "l")).where(F.col(f"r.{value}") > F.col("l.limit")).select(*(F.col(f"r.{c}").alias(c) for c in by), F.col(f"r.{value}").alias(value))
    median = percentiles(out, by, value, {"median": 0.5}).drop("n").alias("m")
    found = out.groupBy(*by).agg(F.count("*").alias("k"), F.max(value).alias("largest")).alias("f")
    found = found.join(median, _equal(by, "f", "m")).select("f.*", "median").alias("f")
    r = lambda c, name: F.round(c, 6).alias(name)
    out = limit.alias("l").join(found, _equal(by, "l", "f"), "left").select("l.*", "k", "median", "largest")
    return out.select(*by, r(F.col("limit"), "limit"), F.coalesce("k", F.lit(0)).cast("long").alias("n_outliers"), r(F.coalesce("k", F.lit(0)) / F.col("n"), "share"), r(F.col("median"), "median"), r(F.col("largest"), "largest"))


def flaky(summaries: DataFrame, by: list[str], metrics: list[str], limit: float = 20.0) -> DataFrame:
    """(by, metric, mean, std, cv) of each metric with {metric}_mean, _std, _cv columns whose cv exceeds the limit."""
    items = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"{m}_mean").alias("mean"), F.col(f"{m}_std").alias("std"), F.col(f"{m}_cv").alias("cv")) for m in metrics))
    return summaries.select(*by, F.explode(items).alias("x")).where(F.col("x.cv") > limit).select(*by, "x.*")


def variance_report(summaries: DataFrame, by: str, metrics: list[str], limit: float = 20.0) -> DataFrame:
    """Per value of `by`: configurations, flaky ones, their share, mean and largest cv over all metrics."""
    cvs = F.filter(F.array(*(F.col(f"{m}_cv") for m in metrics)), lambda x: x.isNotNull())
    rows = summaries.select(by, F.exists(cvs, lambda x: x > limit).alias("flaky"), cvs.alias("cvs"))
    flat = rows.select(by, "flaky", F.aggregate("cvs", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("cvs").alias("k"), F.array_max("cvs").alias("most"))
    n = F.sum(F.when(F.col("flaky"), 1).otherwise(0))
    return flat.groupBy(by).agg(F.count("*").alias("n_configs"), n.alias("n_flaky"), F.round(n / F.count("*") * 100, 6).alias("percent"), F.round(F.sum("total") / F.sum("k"), 6).alias("mean_cv"), F.round(F.max("most"), 6).alias("max_cv"))
