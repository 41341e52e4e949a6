"""Interval unions, gaps, bursts, clipping and interval look-ups on nanosecond clocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from iotrail.operators.ordered import BUCKET, SHIFT, carry_last, in_blocks
from iotrail.operators.stats import on_keys
from iotrail.session import stage


def _local_islands(df: DataFrame, keys: list[str], gap_ns: int) -> DataFrame:
    """Merge inside each (key, bucket) first, like a partial aggregate."""
    before = Window.partitionBy(*keys, BUCKET).orderBy("start_ns", "end_ns").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys, BUCKET).orderBy("start_ns", "end_ns").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce((F.col("start_ns") - F.max("end_ns").over(before) > gap_ns).cast("int"), F.lit(1))
    return (
        df.withColumn("__opens", opens)
        .withColumn("__island", F.sum("__opens").over(upto))
        .groupBy(*keys, BUCKET, "__island")
        .agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"))
        .drop("__island")
    )


def merge_intervals(
    df: DataFrame,
    keys: Sequence[str],
    start: str = "start_ns",
    end: str = "end_ns",
    gap_ns: int = 0,
    keep_empty: bool = False,
    shift: int = SHIFT,
) -> DataFrame:
    """Union of intervals per key; neighbours at most ``gap_ns`` apart join.

    Reversed intervals are dropped, empty ones too unless ``keep_empty``.  Rows are
    merged in blocks of equal depth and the reach of a block is carried into the next.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(start).alias("start_ns"), F.col(end).alias("end_ns"))
    rows = rows.filter(F.col("end_ns") >= F.col("start_ns") if keep_empty else F.col("end_ns") > F.col("start_ns"))
    local = stage(_local_islands(in_blocks(rows, keys, ["start_ns", "end_ns"], shift), keys, gap_ns), "islands")
    # Islands of a bucket are disjoint, so only the reach of earlier buckets can absorb
    # them, and whatever it absorbs belongs to the last island opened before the bucket.
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        local.groupBy(*keys, BUCKET)
        .agg(F.max("start_ns").alias("__last_start"), F.max("end_ns").alias("__last_end"))
        .withColumn("__reach", F.max("__last_end").over(before))
        .withColumn(
            "__opened",
            F.when(F.col("__reach").isNull() | (F.col("__last_start") - F.col("__reach") > gap_ns), F.col("__last_start")),
        )
        .select(*keys, BUCKET, "__reach", F.last("__opened", ignorenulls=True).over(before).alias("__open_start"))
    )
    placed = local.join(carry, [*keys, BUCKET])
    opens = F.col("__reach").isNull() | (F.col("start_ns") - F.col("__reach") > gap_ns)
    island = F.when(opens, F.col("start_ns")).otherwise(F.col("__open_start"))
    return placed.groupBy(*keys, island.alias("start_ns")).agg(F.max("end_ns").alias("end_ns"))


def merge_small(
    df: DataFrame, keys: Sequence[str], start: str = "start_ns", end: str = "end_ns", keep_empty: bool = True
) -> DataFrame:
    """Interval union for keys whose groups are bounded (one request, one node)."""
    keys = list(keys)
    rows = df.select(*keys, F.col(start).alias("start_ns"), F.col(end).alias("end_ns"))
    rows = rows.filter(F.col("end_ns") >= F.col("start_ns") if keep_empty else F.col("end_ns") > F.col("start_ns"))
    return _local_islands(rows.withColumn(BUCKET, F.lit(0)), keys, 0).drop(BUCKET)


def union_duration(df: DataFrame, keys: Sequence[str], name: str = "busy_ns", **kw) -> DataFrame:
    """Covered time per key."""
    return (
        merge_intervals(df, keys, **kw).groupBy(*keys).agg(F.sum(F.col("end_ns") - F.col("start_ns")).alias(name))
    )


def clip(df: DataFrame, lower: Column | int, upper: Column | int) -> DataFrame:
    """Intervals cut to a range; nothing outside it remains."""
    lo = lower if isinstance(lower, Column) else F.lit(lower)
    hi = upper if isinstance(upper, Column) else F.lit(upper)
    return (
        df.withColumn("start_ns", F.greatest("start_ns", lo))
        .withColumn("end_ns", F.least("end_ns", hi))
        .filter(F.col("end_ns") > F.col("start_ns"))
    )


def gaps(merged: DataFrame, keys: Sequence[str], lower: int, upper: int, shift: int = SHIFT) -> DataFrame:
    """Uncovered parts of [lower, upper] given merged intervals inside it."""
    keys = list(keys)
    closed = merged.select(*keys, "start_ns", "end_ns").unionByName(
        merged.select(*keys).distinct().select(*keys, F.lit(upper).alias("start_ns"), F.lit(upper).alias("end_ns"))
        if keys
        else merged.sparkSession.range(1).select(F.lit(upper).alias("start_ns"), F.lit(upper).alias("end_ns"))
    )
    blocks = stage(in_blocks(closed, keys, ["start_ns", "end_ns"], shift), "gap-blocks")
    seen = carry_last(blocks, keys, ["start_ns", "end_ns"], {"prev_end": F.col("end_ns")})
    return seen.select(
        *keys, F.coalesce("prev_end", F.lit(lower)).alias("start_ns"), F.col("start_ns").alias("end_ns")
    ).filter(F.col("end_ns") > F.col("start_ns"))


def locate(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], ts: str, shift: int = SHIFT
) -> DataFrame:
    """Attach to each point the interval with start < ts <= end (disjoint intervals).

    An as-of look-up: intervals and points share one ordered pass, so a long
    interval is never repeated and a hot key is never gathered in one task.
    """
    keys = list(keys)
    cols = [c for c in points.columns if c not in keys]
    packed = points.select(*keys, F.col(ts).alias("__at"), F.lit(0).alias("__kind"), F.struct(*cols).alias("__row"))
    marks = intervals.select(
        *keys,
        F.col("start_ns").alias("__at"),
        F.lit(1).alias("__kind"),
        F.struct("start_ns", "end_ns").alias("__span"),
    )
    both = packed.unionByName(marks, allowMissingColumns=True)
    blocks = stage(in_blocks(both, keys, ["__at", "__kind"], shift), "locate-blocks")
    seen = carry_last(blocks, keys, ["__at", "__kind"], {"interval": F.col("__span")})
    hit = F.when(F.col("__at") <= F.col("interval.end_ns"), F.col("interval"))
    return seen.filter(F.col("__kind") == 0).select(
        *keys, "__row.*", hit["start_ns"].alias("interval_start_ns"), hit["end_ns"].alias("interval_end_ns")
    )


def busy_by_window(merged: DataFrame, keys: Sequence[str], lower: int, upper: int, width: int) -> DataFrame:
    """Covered time per fixed window of [lower, upper]; windows without cover are absent."""
    inside = clip(merged, lower, upper)
    last = max(0, -(-(upper - lower) // width) - 1)
    first_w = F.expr(f"(start_ns - {lower}) div {width}")
    last_w = F.least(F.expr(f"(end_ns - 1 - {lower}) div {width}"), F.lit(last))
    spread = inside.withColumn("window", F.explode(F.sequence(first_w, last_w)))
    w_start = F.lit(lower) + F.col("window") * width
    part = F.least("end_ns", F.least(w_start + width, F.lit(upper))) - F.greatest("start_ns", w_start)
    return spread.groupBy(*keys, "window").agg(F.sum(part).alias("busy_ns"))


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_range: tuple[str, str],
    right_range: tuple[str, str],
    width_ns: int,
    long_buckets: int = 120,
    levels: int = 3,
    left_bounded: bool = False,
    right_bounded: bool = False,
) -> DataFrame:
    """Pairs of overlapping closed intervals with equal keys.

    Both sides are cut into buckets and equi-joined; a pair is kept only in the
    first bucket both share, so no distinct is needed.  An interval longer than
    ``long_buckets`` buckets lives on a level of 128 times wider buckets instead of
    exploding, and the other side looks it up there.  Long rows are few, so those
    look-ups join a small table that is broadcast when its measured size allows.
    A side known to hold no long interval (``*_bounded``) skips its look-up.
    Column names of the two sides must differ, except the keys.
    """
    keys = list(keys)
    ls, le = left_range
    rs, re = right_range
    widths = [width_ns * 128**lv for lv in range(levels)]

    def cell_of(lv: int):
        return lambda b: F.struct(F.lit(lv).alias("lv"), b.alias("b"))

    def levelled(df: DataFrame, s: str, e: str) -> DataFrame:
        span = F.expr(f"(`{e}` - `{s}`) div {width_ns * long_buckets}")
        exponent = F.when(span <= 0, 0).otherwise(F.ceil(F.length(F.bin(span)) / 7))
        return df.filter(F.col(e) >= F.col(s)).withColumn("__own", F.least(exponent, F.lit(levels - 1)).cast("int"))

    def cells(df: DataFrame, s: str, e: str, wanted) -> DataFrame:
        """Repeat rows for the buckets of every level that ``wanted(level)`` admits."""
        listed = [
            F.when(
                wanted(lv), F.transform(F.sequence(F.expr(f"`{s}` div {w}"), F.expr(f"`{e}` div {w}")), cell_of(lv))
            ).otherwise(F.array().cast("array<struct<lv:int,b:bigint>>"))
            for lv, w in enumerate(widths)
        ]
        return (
            df.withColumn("__cell", F.explode(F.concat(*listed)))
            .select("*", F.col("__cell.lv").alias("__lv"), F.col("__cell.b").alias("__b"))
            .drop("__cell", "__own")
        )

    def meet(lx: DataFrame, rx: DataFrame) -> DataFrame:
        later = F.greatest(ls, rs)
        first_common = F.lit(None).cast("long")
        for lv, w in enumerate(widths):
            first_common = F.when(F.col("__lv") == lv, F.call_function("div", later, F.lit(w))).otherwise(first_common)
        overlap = (F.col(ls) <= F.col(re)) & (F.col(le) >= F.col(rs)) & (F.col("__b") == first_common)
        return lx.join(rx, [*keys, "__lv", "__b"]).filter(overlap).drop("__lv", "__b")

    own = F.col("__own")
    lx, rx = levelled(left, ls, le), levelled(right, rs, re)
    short = lambda lv: F.lit(lv == 0)
    native = lambda lv: own == lv
    pairs = meet(cells(lx.filter(own == 0), ls, le, short), cells(rx.filter(own == 0), rs, re, short))
    if not left_bounded:
        reach = lambda lv: F.lit(lv > 0) & (own <= lv)
        pairs = pairs.unionByName(meet(cells(lx.filter(own > 0), ls, le, native), cells(rx, rs, re, reach)))
    if not right_bounded:
        below = lambda lv: F.lit(lv > 0) & (own < lv)
        pairs = pairs.unionByName(meet(cells(lx, ls, le, below), cells(rx.filter(own > 0), rs, re, native)))
    return pairs


def expand_range(df: DataFrame, lower: str, upper: str, width: int, name: str) -> DataFrame:
    """Repeat each row for every bucket its closed range touches."""
    return df.withColumn(name, F.explode(F.sequence(F.expr(f"`{lower}` div {width}"), F.expr(f"`{upper}` div {width}"))))


__all__ = [
    "busy_by_window",
    "clip",
    "expand_range",
    "gaps",
    "interval_join",
    "locate",
    "merge_intervals",
    "merge_small",
    "on_keys",
    "union_duration",
]
