"""Statistics of benchmark timings: confidence intervals, speedups, scaling, throughput.

Timings are rows (architecture, phase, workers, workload, run_idx, seconds); the grouping columns are named by
the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the two-sided 95 % quantile of Student's t with 4 degrees of freedom, for five measured runs.
T_CRITICAL = 2.776
WARMUP_RUNS = 2


def measured(runs: DataFrame, warmup: int = WARMUP_RUNS) -> DataFrame:
    """Runs after the warm-up ones."""
    return runs.filter(F.col("run_idx") >= warmup)


def margin(value: str) -> Column:
    """Half the confidence interval; 0 for a single run."""
    n = F.count(value)
    return F.when(n > 1, F.lit(T_CRITICAL) * F.stddev_samp(value) / F.sqrt(n)).otherwise(0.0)


def mean_ci(runs: DataFrame, *by: str, value: str = "seconds") -> DataFrame:
    """n, mean and margin of each group, to six places."""
    return runs.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(margin(value), 6).alias("margin"))


def full_stats(runs: DataFrame, *by: str, value: str = "seconds") -> DataFrame:
    """mean_ci with median, interval and the runs themselves."""
    mean, half = F.avg(value), margin(value)
    return runs.groupBy(*by).agg(
        F.count(value).alias("n"), F.round(mean, 6).alias("mean"), F.round(F.median(value), 6).alias("median"), F.round(half, 6).alias("margin"),
        F.round(mean - half, 6).alias("ci_lower"), F.round(mean + half, 6).alias("ci_upper"), F.sort_array(F.collect_list(F.round(value, 6))).alias("raw_runs"),
    )


def ci_band(stats: DataFrame) -> DataFrame:
    return stats.withColumn("low", F.col("mean") - F.col("margin")).withColumn("high", F.col("mean") + F.col("margin"))


def total_time(insert: Column, query: Column) -> Column:
    """Insert and query seconds together; a missing phase counts 0."""
    return F.coalesce(insert, F.lit(0.0)) + F.coalesce(query, F.lit(0.0))


def speedup_vs_baseline(totals: DataFrame, baseline: str) -> DataFrame:
    """totals: (architecture, total). Baseline total over each total; 0 where a total is 0."""
    base = totals.filter(F.col("architecture") == baseline).agg(F.max("total").alias("__base"))
    return totals.join(F.broadcast(base)).select("architecture", "total", F.when(F.col("total") > 0, F.col("__base") / F.col("total")).otherwise(0.0).alias("speedup"))


def speedup_vs_one_worker(means: DataFrame) -> DataFrame:
    """means: (architecture, workers, mean). Time with the fewest workers over the time with each number."""
    first = F.first_value("mean").over(Window.partitionBy("architecture").orderBy("workers"))
    return means.withColumn("speedup", F.when(F.col("mean") > 0, first / F.col("mean")).otherwise(0.0))


def weak_baseline(means: DataFrame) -> DataFrame:
    """The ideal of weak scaling: the first architecture's mean with the fewest workers, for every row."""
    first = means.orderBy("architecture", "workers").limit(1).select(F.col("mean").alias("baseline"))
    return means.join(F.broadcast(first))


def optimal_chunk(means: DataFrame) -> DataFrame:
    """means: (chunk_size, mean). The chunk size of least mean, the smaller at a tie."""
    return means.agg(F.min_by("chunk_size", F.struct("mean", "chunk_size")).alias("chunk_size"), F.min("mean").alias("mean"))


def throughput(runs: DataFrame, items: str, seconds: str) -> DataFrame:
    return runs.withColumn("items_per_second", F.when(F.col(seconds) > 0, F.col(items) / F.col(seconds)).otherwise(0.0))


def async_speedup(sequential: Column, asynchronous: Column) -> Column:
    """How much faster the asynchronous run was; null where it was not."""
    return F.when((asynchronous < sequential) & (asynchronous > 0), sequential / asynchronous)


def report(stats: DataFrame, *columns: str) -> list[str]:
    """A fixed-width table of a summary: one line for each row of a bounded result."""
    rows = stats.select(*columns).orderBy(*columns[:1]).limit(1000).collect()
    cells = [list(columns), *([f"{v:.6f}" if isinstance(v, float) else str(v) for v in r] for r in rows)]
    widths = [max(len(r[k]) for r in cells) for k in range(len(columns))]
    return ["  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in cells]
