"""Exact percentiles, histograms and distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from iotrail.operators.ordered import BUCKET, running
from iotrail.session import stage

LATENCY_BOUNDS = [1000 << i for i in range(32)]  # fixed values: 1 us doubled 31 times
PERCENTILES = (0, 25, 50, 75, 90, 95, 99, 100)  # fixed values: percentiles of a summary export


def on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches null keys; right key columns are dropped."""
    keys = list(keys)
    if not keys:
        return left.join(right, F.lit(True), how)
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    joined = left.join(renamed, cond, how)
    return joined.drop(*[f"__r_{k}" for k in keys])


def magnitude(value: Column) -> Column:
    """Order-preserving bucket of a long with about 12 significant bits (sign kept)."""
    size = F.abs(value)
    exponent = F.length(F.bin(size)) - 1
    mantissa = F.call_function("shiftright", size, F.greatest(exponent - 12, F.lit(0)))
    key = mantissa + exponent.cast("long") * 8192
    return F.when(value < 0, -key).otherwise(key)


def magnitude_double(value: Column) -> Column:
    """Order-preserving bucket of a double, relative width about 2**-12."""
    key = (F.floor(F.log2(F.abs(value)) * 4096) + 4_500_000).cast("long")
    return F.when(value == 0, F.lit(0)).when(value < 0, -key).otherwise(key)


def nearest_rank(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    percentiles: Sequence[int] = (50, 95, 99),
    prefix: str = "p",
    rank: Column | None = None,
) -> DataFrame:
    """Exact nearest-rank percentiles: rank = max(1, ceil(p * n / 100)).

    Two passes instead of one sort: count values per coarse bucket, find the
    bucket that holds each rank, then rank only the values of those buckets.
    The shuffles carry counts, so one huge group costs no more than many small
    ones.  Groups without a value are absent from the result.
    """
    groups = list(groups)
    dtype = dict(df.dtypes)[value]
    bucket = magnitude_double if dtype in ("double", "float") else magnitude
    base = df.filter(F.col(value).isNotNull())
    if dtype in ("double", "float"):
        base = base.filter(~F.isnan(value))
    base = base.select(*groups, F.col(value).alias("__v")).withColumn("__b", bucket(F.col("__v")))
    coarse = base.groupBy(*groups, "__b").agg(F.count(F.lit(1)).alias("__n"))
    up = Window.partitionBy(*groups).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*groups)
    ranks = F.array(*[F.lit(int(p)) for p in percentiles])
    default_rank = F.greatest(F.lit(1).cast("long"), F.expr("(__p * __total + 99) div 100"))
    targets = (
        coarse.select(
            *groups,
            "__b",
            F.sum("__n").over(up).alias("__upto"),
            "__n",
            F.sum("__n").over(whole).alias("__total"),
        )
        .select("*", F.explode(ranks).alias("__p"))
        .withColumn("__rank", rank if rank is not None else default_rank)
        .filter((F.col("__upto") >= F.col("__rank")) & (F.col("__upto") - F.col("__n") < F.col("__rank")))
        .select(*groups, "__b", "__p", (F.col("__rank") - F.col("__upto") + F.col("__n")).alias("__r"))
    )
    wanted = on_keys(base, targets.select(*groups, "__b").distinct(), [*groups, "__b"], "left_semi")
    fine = wanted.groupBy(*groups, "__b", "__v").agg(F.count(F.lit(1)).alias("__n"))
    inside = Window.partitionBy(*groups, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    fine = fine.withColumn("__upto", F.sum("__n").over(inside))
    picked = on_keys(fine, targets, [*groups, "__b"]).filter(
        (F.col("__upto") >= F.col("__r")) & (F.col("__upto") - F.col("__n") < F.col("__r"))
    )
    return picked.groupBy(*groups).agg(
        *[F.max(F.when(F.col("__p") == p, F.col("__v"))).alias(f"{prefix}{p}") for p in percentiles]
    )


def log2_bucket(value: str) -> Column:
    """63 - clz(max(value, 1)), computed exactly on integers."""
    return F.length(F.bin(F.greatest(F.col(value), F.lit(1)))) - 1


def bounded_index(value: Column, bounds: Sequence[int]) -> Column:
    """Index of the first inclusive upper bound >= value; ``len(bounds)`` is the overflow."""
    if any(b <= a for a, b in zip(bounds, bounds[1:])):
        raise ValueError("histogram boundaries must increase")
    expr: Column = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        expr = F.when(value <= F.lit(bounds[i]), i).otherwise(expr)
    return F.when(value.isNotNull(), expr)


def fixed_histogram(df: DataFrame, groups: Sequence[str], value: str, bounds: Sequence[int]) -> DataFrame:
    """Counts per inclusive upper bound plus overflow (null upper)."""
    index = bounded_index(F.col(value), bounds)
    uppers = F.array(*[F.lit(int(b)) for b in bounds])
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*groups, index.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upper", F.when(F.col("bucket") < len(bounds), F.get(uppers, F.col("bucket"))).cast("long"))
    )


def histogram_percentile(
    histogram: DataFrame, groups: Sequence[str], percentiles: Sequence[int], bounds: Sequence[int]
) -> DataFrame:
    """(lower, upper) range holding each percentile of a fixed histogram; upper null in the overflow."""
    w = Window.partitionBy(*groups).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*groups)
    lowers = F.array(F.lit(0), *[F.lit(int(b) + 1) for b in bounds])
    return (
        histogram.withColumn("upto", F.sum("n").over(w))
        .withColumn("total", F.sum("n").over(whole))
        .select("*", F.explode(F.array(*[F.lit(int(p)) for p in percentiles])).alias("percentile"))
        .withColumn("rank", F.expr("(total * percentile + 99) div 100"))
        .filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        .select(*groups, "percentile", F.get(lowers, F.col("bucket")).cast("long").alias("lower"), "upper")
    )


def equal_width_edges(df: DataFrame, groups: Sequence[str], value: str, bins: int) -> DataFrame:
    """Per group: lo, hi, number of bins and width of the equal-width histogram."""
    v = F.col(value).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    stats = df.groupBy(*groups).agg(
        F.min(F.when(finite, v)).alias("lo"),
        F.max(F.when(finite, v)).alias("hi"),
        F.count_if(finite).alias("__n"),
        F.count_if(~finite).alias("missing"),
    )
    count = F.least(F.lit(max(1, bins)).cast("long"), F.col("__n"))
    count = F.when(F.col("lo") == F.col("hi"), F.lit(1).cast("long")).otherwise(count)
    return (
        stats.filter(F.col("__n") > 0)
        .withColumn("bins", count)
        .withColumn("width", (F.col("hi") - F.col("lo")) / F.col("bins"))
        .drop("__n")
    )


def edge_lower(index: Column) -> Column:
    return F.col("lo") + index.cast("double") * F.col("width")


def edge_upper(index: Column) -> Column:
    return F.when(index + 1 == F.col("bins"), F.col("hi")).otherwise(F.col("lo") + (index + 1).cast("double") * F.col("width"))


def bin_index(value: Column) -> Column:
    """Bin of a value against the very boundaries that are displayed."""
    v = value.cast("double")
    last = F.col("bins") - 1
    guess = F.when(F.col("width") > 0, F.floor((v - F.col("lo")) / F.col("width"))).otherwise(F.lit(0)).cast("long")
    guess = F.greatest(F.lit(0).cast("long"), F.least(guess, last))
    up = F.when((guess < last) & (v >= edge_lower(guess + 1)), guess + 1).otherwise(guess)
    return F.when((up > 0) & (v < edge_lower(up)), up - 1).otherwise(up)


def equal_width_histogram(df: DataFrame, groups: Sequence[str], value: str, bins: int) -> DataFrame:
    """Histogram with ``bins`` equal bins; [lo, hi), last bin closed, empty bins kept.

    The edges are written first, so that their join is planned by their size: rows of a group
    need not meet in one task, and are counted where they are read.
    """
    groups = list(groups)
    edges = stage(equal_width_edges(df, groups, value, bins), "histogram-edges")
    v = F.col(value).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    counted = (
        on_keys(df.filter(finite).select(*groups, v.alias("__v")), edges, groups)
        .groupBy(*groups, bin_index(F.col("__v")).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    frame = edges.select(
        *groups, "missing", "lo", "hi", "width", "bins", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin")
    ).select(
        *groups, "missing", "bin", edge_lower(F.col("bin")).alias("lower"), edge_upper(F.col("bin")).alias("upper")
    )
    return on_keys(frame, counted, [*groups, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def value_counts(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    v = F.col(value)
    return df.filter(v.isNotNull()).groupBy(*groups, v.alias("v")).agg(F.count(F.lit(1)).alias("n"))


def ecdf(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Empirical distribution at every distinct value, ties included."""
    groups = list(groups)
    dtype = dict(df.dtypes)[value]
    bucket = magnitude_double if dtype in ("double", "float") else magnitude
    counts = value_counts(df, groups, value)
    upto = running(counts, groups, ["v"], sums={"upto": F.col("n")}, bucket=bucket(F.col("v"))).drop(BUCKET)
    totals = counts.groupBy(*groups).agg(F.sum("n").alias("total"))
    return on_keys(upto, totals, groups).select(
        *groups, F.col("v").alias("value"), (F.col("upto") * 100.0 / F.col("total")).alias("percent")
    )


def by_direction(df: DataFrame, operation: str = "operation") -> DataFrame:
    """Repeat rows as ``total`` plus one of read/write/other (a two-level grouping set)."""
    own = F.when(F.col(operation).isin("read", "write"), F.col(operation)).otherwise("other")
    return df.withColumn("direction", F.explode(F.array(F.lit("total"), own)))


def shares(counts: DataFrame, groups: Sequence[str], label: str, weight: str, top: int = 4) -> DataFrame:
    """Largest ``top`` labels per group plus a remainder row; ties broken by label."""
    groups = list(groups)
    w = Window.partitionBy(*groups).orderBy(F.desc(weight), F.asc(label))
    ranked = counts.withColumn("__r", F.row_number().over(w))
    relabel = F.when(F.col("__r") <= top, F.col(label)).otherwise("remainder")
    merged = ranked.groupBy(*groups, relabel.alias(label), (F.col("__r") > top).alias("is_remainder")).agg(
        F.sum(weight).alias(weight)
    )
    whole = Window.partitionBy(*groups)
    total = F.sum(weight).over(whole)
    return merged.withColumn("percent", F.when(total == 0, F.lit(0.0)).otherwise(F.col(weight) * 100.0 / total))
