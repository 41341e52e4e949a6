"""Sampling, paging, top-k and level-of-detail operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from iotrail.operators.ordered import BUCKET, carry_last, row_numbers
from iotrail.operators.stats import magnitude_double, nearest_rank, on_keys
from iotrail.session import stage


def indexed(df: DataFrame, groups: Sequence[str], order: Sequence[str], bucket: Column) -> DataFrame:
    """0-based index ``idx`` and group size ``n`` per group, without gathering a group in one task."""
    groups = list(groups)
    numbered = row_numbers(df, groups, order, "__rn", bucket).drop(BUCKET)
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    return on_keys(numbered, sizes, groups).withColumn("idx", F.col("__rn") - 1).drop("__rn")


def even_with_ends(limit: Column | int) -> Column:
    """Is ``idx`` one of i * (n - 1) div (limit - 1), i < limit?  Keeps both ends."""
    lim = limit.cast("long") if isinstance(limit, Column) else F.lit(int(limit)).cast("long")
    i = F.call_function("div", F.col("idx") * (lim - 1) + F.col("n") - 2, F.col("n") - 1)
    hit = F.call_function("div", i * (F.col("n") - 1), lim - 1) == F.col("idx")
    return F.when(F.col("n") <= lim, True).when(lim <= 1, F.col("idx") < lim).otherwise(hit)


def even_without_ends(limit: int) -> Column:
    """Is ``idx`` one of i * n div limit, i < limit?"""
    lim = F.lit(int(limit)).cast("long")
    i = F.call_function("div", F.col("idx") * lim + F.col("n") - 1, F.col("n"))
    hit = (F.call_function("div", i * F.col("n"), lim) == F.col("idx")) & (i < lim)
    return F.when(F.col("n") <= lim, True).otherwise(hit)


def operation_quota(df: DataFrame, order: Sequence[str], bucket: Column, limit: int) -> DataFrame:
    """Proportional even sample per operation, at least one row of each.

    The quotas come from the (at most five) operation counts.
    """
    counts = {r["operation"]: r["n"] for r in df.groupBy("operation").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if total <= limit:
        return df
    if limit < len(counts):
        ready = indexed(df, [], order, bucket)
        return ready.filter(even_with_ends(limit)).drop("idx", "n")
    quota = {op: max(1, limit * n // total) for op, n in counts.items()}
    while sum(quota.values()) > limit:
        largest = max(quota, key=lambda op: (quota[op], op))
        quota[largest] -= 1
    share: Column = F.lit(0)
    for op, q in quota.items():
        share = F.when(F.col("operation") == op, q).otherwise(share)
    ready = indexed(df, ["operation"], order, bucket)
    return ready.filter(even_with_ends(share)).drop("idx", "n")


def proportional_quota(df: DataFrame, groups: Sequence[str], limit: int) -> DataFrame:
    """Rows each group may keep: its share of ``limit``, at least one."""
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"))
    total = sizes.agg(F.sum("__n").alias("__all"))
    return sizes.join(total, F.lit(True)).select(
        *groups, F.greatest(F.lit(1).cast("long"), F.expr(f"{limit} * __n div __all")).alias("quota")
    )


def shape_sample(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], bucket: Column, x: str, y: str, limit: int
) -> DataFrame:
    """Shape-preserving sample of about ``limit`` rows, shared proportionally by group.

    Per group and chronological slice the first, last and both-axis extremes stay;
    both sides of every sparse gap on either axis stay; the rest is filled evenly.
    Needed features are never dropped to meet the limit.
    """
    groups = list(groups)
    ready = on_keys(indexed(df, groups, order, bucket), proportional_quota(df, groups, limit), groups)
    ready = stage(ready.select(*groups, *[c for c in df.columns if c not in groups], "idx", "n", "quota"), "sample-input")
    large = ready.filter(F.col("n") > F.col("quota"))
    pos = F.col("idx")
    slices = F.least(F.greatest(F.expr("quota div 6"), F.lit(1).cast("long")), F.col("n"))
    sliced = large.withColumn("slice", F.call_function("div", (pos + 1) * slices - 1, F.col("n")))
    extremes = [F.min(pos), F.max(pos)]
    for axis in (x, y):
        extremes += [F.min_by(pos, F.struct(F.col(axis), pos)), F.max_by(pos, F.struct(F.col(axis), pos))]
    kept = sliced.groupBy(*groups, "slice").agg(F.array(*extremes).alias("keep")).select(
        *groups, F.explode("keep").alias("idx")
    )
    for axis in (x, y):
        kept = kept.unionByName(_sparse_sides(large, groups, axis))
    kept = stage(kept.distinct(), "sample-kept")
    marked = on_keys(large, kept.withColumn("__keep", F.lit(True)), [*groups, "idx"], "left")
    counts = kept.groupBy(*groups).agg(F.count(F.lit(1)).alias("__kept"))
    marked = on_keys(marked, counts, groups)
    rest = marked.filter(F.col("__keep").isNull()).drop("idx")
    refill = indexed(rest.drop("n").withColumn("room", F.col("quota") - F.col("__kept")), groups, order, bucket)
    filled = refill.filter((F.col("room") > 0) & even_with_ends(F.col("room")))
    columns = df.columns
    return (
        ready.filter(F.col("n") <= F.col("quota"))
        .select(*columns)
        .unionByName(marked.filter("__keep").select(*columns))
        .unionByName(filled.select(*columns))
    )


def _sparse_sides(rows: DataFrame, groups: list[str], axis: str) -> DataFrame:
    """Both rows around each step above max(8 x median step, 2 x span / quota)."""
    at = rows.select(*groups, "idx", "quota", F.col(axis).alias("v"))
    steps = carry_last(
        at, groups, ["v", "idx"], {"prev": F.struct("v", "idx")}, bucket=magnitude_double(F.col("v"))
    ).drop(BUCKET)
    steps = steps.withColumn("step", F.col("v") - F.col("prev.v"))
    median = nearest_rank(steps.filter("step > 0"), groups, "step", [50], rank=F.expr("__total div 2 + 1"))
    span = at.groupBy(*groups).agg((F.max("v") - F.min("v")).alias("span"))
    wide = on_keys(on_keys(steps, median, groups), span, groups).filter(
        (F.col("step") > F.col("p50") * 8) & (F.col("step") > F.col("span") * 2 / F.col("quota"))
    )
    return wide.select(*groups, F.explode(F.array(F.col("prev.idx"), F.col("idx"))).alias("idx"))


def level_of_detail(points: DataFrame, x: str, y: str, factor: int = 16, target: int = 256) -> DataFrame:
    """Coarser levels of an indexed series until one has at most ``target`` points.

    Per ``factor`` neighbours the first, last, lowest and highest stay.  Each level
    is staged, so level k reads a quarter of what level k - 1 read.
    """
    level = stage(points.select(F.col("idx"), F.col(x).alias("x"), F.col(y).alias("y")), "lod")
    out = level.withColumn("level", F.lit(0))
    n, depth = level.count(), 0
    while n > target:
        depth += 1
        pos = F.col("idx")
        chunked = level.withColumn("chunk", F.expr(f"idx div {factor}"))
        ends = Window.partitionBy("chunk")
        keep = F.array(
            F.min(pos).over(ends),
            F.max(pos).over(ends),
            F.min_by(pos, F.struct("y", "idx")).over(ends),
            F.max_by(pos, F.struct("y", "idx")).over(ends),
        )
        kept = chunked.withColumn("keep", keep).filter(F.array_contains("keep", pos)).drop("keep", "chunk")
        numbered = row_numbers(kept, [], ["idx"], "rn", bucket=F.expr(f"idx div {1 << 20}"))
        level = stage(numbered.select((F.col("rn") - 1).alias("idx"), "x", "y"), "lod")
        n = level.count()
        out = out.unionByName(level.withColumn("level", F.lit(depth)))
    return out


def visible(levels: DataFrame, low: float, high: float, columns: int) -> DataFrame:
    """Finest level whose slice of [low, high], one neighbour each side, fits 4 points per column."""
    budget = max(1, columns) * 4
    sizes = levels.groupBy("level").agg(
        F.count_if(F.col("x") < low).alias("lt"), F.count_if(F.col("x") <= high).alias("le"), F.count(F.lit(1)).alias("n")
    )
    end = F.least(F.col("le") + 1, F.col("n"))
    start = F.least(F.greatest(F.col("lt") - 1, F.lit(0)), end)
    top = F.max("level").over(Window.partitionBy(F.lit(1)))
    fits = sizes.select("level", start.alias("from_idx"), end.alias("to_idx"), top.alias("top")).filter(
        (F.col("to_idx") - F.col("from_idx") <= budget) | (F.col("level") == F.col("top"))
    )
    chosen = fits.orderBy("level").limit(1).select("level", "from_idx", "to_idx")
    return (
        levels.join(chosen, "level")
        .filter((F.col("idx") >= F.col("from_idx")) & (F.col("idx") < F.col("to_idx")))
        .select("level", "idx", "x", "y")
    )


def cap_groups(df: DataFrame, group: str, limit: int = 32, other: str = "Other groups") -> DataFrame:
    """Keep the largest ``limit - 1`` groups by size (ties by name) and fold the rest together."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    named = sizes.agg(F.count(F.lit(1)).alias("__groups"))
    top = sizes.orderBy(F.desc("__n"), F.asc(group)).limit(limit - 1).select(group, F.lit(True).alias("__top"))
    small = named.select((F.col("__groups") <= limit).alias("__all"))
    labelled = on_keys(df, top, [group], "left").join(small, F.lit(True))
    label = F.when(F.col("__all") | F.coalesce("__top", F.lit(False)), F.col(group)).otherwise(other)
    return labelled.withColumn(group, label).drop("__top", "__all")


def page(df: DataFrame, order: Sequence[tuple[str, bool]], size: int, number: int, few: int = 1 << 16, fanout: int = 1024) -> DataFrame:
    """Rows of one page (0-based), in order; ``order`` names whole-number columns without nulls and whether they descend.

    A directory of counts per value bucket finds the range of the first column that
    holds the page; ranges shrink by ``fanout`` a round, then the next column tells
    equal values apart.  Only the last, few rows are sorted, however deep the page lies.
    Rows equal in all columns keep no particular order.
    """
    ends = [F.desc(c) if down else F.asc(c) for c, down in order]
    return _ranks(df, list(order), ends, size * number, size * (number + 1), few, fanout).orderBy(*ends)


def _ranks(rows: DataFrame, order: list[tuple[str, bool]], ends: list[Column], start: int, stop: int, few: int, fanout: int) -> DataFrame:
    """Rows ``start`` to ``stop`` of the ordered ``rows``."""
    if not order:
        return rows.orderBy(*ends).offset(start).limit(stop - start)
    name, down = order[0]
    value = -F.col(name) if down else F.col(name)
    low, high, n = rows.agg(F.min(value), F.max(value), F.count(F.lit(1))).first()
    if start >= n:
        return rows.limit(0)
    if n <= few:
        return rows.orderBy(*ends).offset(start).limit(stop - start)
    if low == high:
        return _ranks(rows, order[1:], ends, start, stop, few, fanout)
    width = (high - low) // fanout + 1
    place = F.call_function("div", value - F.lit(low), F.lit(width))
    parts, before = [], 0
    for at, held in sorted((r["at"], r["count"]) for r in rows.groupBy(place.alias("at")).count().collect()):  # at most fanout + 1 buckets
        if before < stop and before + held > start:
            parts.append((at, before, held))
        before += held
    first, last = low + parts[0][0] * width, low + (parts[-1][0] + 1) * width - 1
    if sum(held for _, _, held in parts) <= few:
        return _between(rows, name, down, first, last).orderBy(*ends).offset(start - parts[0][1]).limit(stop - start)
    out = None
    for at, skipped, held in parts:
        inside = _between(rows, name, down, low + at * width, low + (at + 1) * width - 1)
        part = _ranks(inside, order, ends, max(start - skipped, 0), min(stop - skipped, held), few, fanout)
        out = part if out is None else out.unionByName(part)
    return out


def _between(rows: DataFrame, name: str, down: bool, first: int, last: int) -> DataFrame:
    """Rows of a range of the column's place in the order, as a plain predicate that scans can use."""
    low, high = (-last, -first) if down else (first, last)
    return rows.filter(F.col(name).between(low, high))


def retain_newest(df: DataFrame, order: Sequence[Column], rows: int) -> DataFrame:
    """Opt-in bounded retention: the newest ``rows`` rows."""
    return df.orderBy(*order).limit(rows)
