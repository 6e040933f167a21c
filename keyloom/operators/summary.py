"""Summaries of measurements: exact percentiles by rank and statistics over runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def _rank(n, p: float):
    return F.floor((n - 1) * F.lit(p) + F.lit(0.5)).cast("bigint")


#: Ranges of values that the ranks of a group are counted in first.
RANGES = 64


def _at_ranks(rows: DataFrame, by: Sequence[str], value: str, ranks: dict) -> DataFrame:
    """The values at 0-based ranks of each group, exactly: ``by``, kl_n and a column per rank.

    Values are cut into ranges by approximate quantiles; counts per range tell
    which range holds a rank, and only within it are distinct values counted up.
    So no task sees a whole group, and a group is never collected.
    """
    names = [f"kl_b{i}" for i in range(len(by))]
    rows = rows.where(F.col(value).isNotNull()).select(*[F.col(c).alias(n) for c, n in zip(by, names)], F.col(value).alias("kl_v"))
    if not by:
        names, rows = ["kl_b0"], rows.withColumn("kl_b0", F.lit(1))
    cuts = rows.groupBy(*names).agg(F.percentile_approx("kl_v", [i / RANGES for i in range(1, RANGES)], 1000).alias("kl_cuts"))
    keys = [F.col(n).alias(f"{n}_c") for n in names]
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}_c"))
    placed = rows.join(cuts.select(*keys, "kl_cuts"), same).withColumn("kl_r", F.size(F.filter("kl_cuts", lambda c: c < F.col("kl_v"))))
    counts = placed.groupBy(*names, "kl_r", "kl_v").agg(F.count(F.lit(1)).alias("kl_c"))
    ranges = counts.groupBy(*names, "kl_r").agg(F.sum("kl_c").alias("kl_c"))
    w = Window.partitionBy(*names)
    before = F.coalesce(F.sum("kl_c").over(w.orderBy("kl_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(*names, "kl_r", before.alias("kl_before"), F.sum("kl_c").over(w).alias("kl_n"), "kl_c")
    wanted = F.array(*[r(F.col("kl_n")) for r in ranks.values()])
    ranges = ranges.where(F.exists(wanted, lambda x: (x >= F.col("kl_before")) & (x < F.col("kl_before") + F.col("kl_c"))))
    near = F.col("kl_r") == F.col("kl_r_c")
    held = counts.join(ranges.select(*keys, F.col("kl_r").alias("kl_r_c"), "kl_before", "kl_n"), same & near)
    up_to = F.sum("kl_c").over(Window.partitionBy(*names, "kl_r").orderBy("kl_v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("kl_before")
    ranked = held.withColumn("kl_upto", up_to)
    picks = [F.min(F.when(F.col("kl_upto") > r(F.col("kl_n")), F.col("kl_v"))).alias(name) for name, r in ranks.items()]
    out = ranked.groupBy(*names).agg(F.max("kl_n").alias("kl_n"), *picks)
    return out.select(*[F.col(n).alias(c) for c, n in zip(by, names)], "kl_n", *ranks)


def percentiles(rows: DataFrame, by: Sequence[str], value: str, ps: dict[str, float]) -> DataFrame:
    """Percentiles as the value at rank round((n-1)*p), not interpolated; nulls don't count, and groups without a value are left out."""
    out = _at_ranks(rows, by, value, {name: (lambda n, p=p: _rank(n, p)) for name, p in ps.items()})
    return out.select(*by, F.col("kl_n").alias("n"), *ps)


def run_summary(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Min, median (the element at n/2), p95, max, population deviation and its percentage of the mean."""
    stats = rows.groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("stddev"))
    middle = _at_ranks(rows, by, value, {"median": lambda n: F.floor(n / 2), "p95": lambda n: _rank(n, 0.95)}).select(*[F.col(c).alias(f"kl_m{i}") for i, c in enumerate(by)], "median", "p95")
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"kl_m{i}"))
    out = stats.join(middle, same).drop(*[f"kl_m{i}" for i in range(len(by))])
    return out.withColumn("cv", F.try_divide(F.col("stddev") * 100, F.col("mean")))
