"""Ordered (analytic) operators that never put a whole key into one task.

A trace may hold a single device or a single reused request id, so a window
partitioned by that key alone would run in one task.  Every operator here cuts
the order axis into buckets, runs the window inside ``(key, bucket)`` and then
carries one small summary row per ``(key, bucket)`` across bucket borders.  The
carry table has about ``rows / 2**shift`` rows, and joins back on the same
partitioning the window already has.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from iotrail.session import shuffle_width

BUCKET = "__bucket"
SHIFT = 17


def with_sequence(df: DataFrame, order: Sequence[str], name: str = "seq", partitions: int | None = None) -> DataFrame:
    """Number rows in a total order with one range shuffle.

    Numbers increase with the order but have gaps between partitions.  Stage the
    result before using it in more than one branch of a plan.
    """
    n = partitions or shuffle_width(df.sparkSession)
    ordered = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return ordered.withColumn(name, F.monotonically_increasing_id())


def seq_bucket(seq: str = "seq", shift: int = SHIFT) -> Column:
    """Bucket of a unique sequence number: at most ``2**shift`` rows each."""
    return F.shiftright(F.col(seq), shift)


def time_bucket(ts: str, width_ns: int) -> Column:
    """Bucket of a time or address value by fixed width."""
    return F.expr(f"`{ts}` div {int(width_ns)}")


def in_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], shift: int = SHIFT) -> DataFrame:
    """Add blocks of at most ``2**shift`` rows along the order of each key.

    The borders come from the rows, not from the clock: rows that crowd into one
    minute, or share one value, are spread like any others.  Blocks ascend with the
    order inside a key.  The numbers differ from run to run, so write the result, or
    what is made of it, before using it twice.
    """
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    numbered = with_sequence(tied, [*keys, *order, "__tie"], name="__place")
    return numbered.withColumn(BUCKET, seq_bucket("__place", shift)).drop("__tie", "__place")


def _position(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])


def _bucketed(df: DataFrame, bucket: Column | None) -> DataFrame:
    if bucket is None:
        return df if BUCKET in df.columns else df.withColumn(BUCKET, seq_bucket())
    return df.withColumn(BUCKET, bucket)


def long_keys(df: DataFrame, keys: Sequence[str], shift: int = SHIFT) -> DataFrame:
    """Keys of more than ``2**shift`` rows: few, and the only ones that need blocks."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1 << shift).select(*keys)


def long_key_bucket(df: DataFrame, keys: Sequence[str], long: DataFrame, shift: int = SHIFT) -> DataFrame:
    """Add the bucket of each row: blocks of ``seq`` for :func:`long_keys`, one bucket for any other key.

    Keys with a null are cut too, as nothing bounds their rows.
    """
    marked = df.join(long.withColumn("__long", F.lit(True)), list(keys), "left")
    cut = F.col("__long").isNotNull()
    for k in keys:
        cut |= F.col(k).isNull()
    return marked.withColumn(BUCKET, F.when(cut, seq_bucket(shift=shift)).otherwise(F.lit(-1))).drop("__long")


def split_keys(df: DataFrame, keys: Sequence[str], bucket: Column) -> DataFrame:
    """Keys whose rows lie in more than one bucket, for :func:`carry_last`."""
    at = df.groupBy(*keys).agg(F.min(bucket).alias("__lo"), F.max(bucket).alias("__hi"))
    return at.filter(F.col("__lo") < F.col("__hi")).select(*keys)


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, Column],
    bucket: Column | None = None,
    split: DataFrame | None = None,
    whole: bool = False,
) -> DataFrame:
    """Add, per name, the latest non-null value among *earlier* rows of the key.

    The bucket column is kept so that a following call with the same keys needs
    no further shuffle.  ``split`` (:func:`split_keys`) names the keys found in more
    than one bucket; only their rows are summarised then, which spares a table of
    short-lived keys two shuffles of a summary about as long as itself.  ``whole`` says
    that no key reaches into a second bucket, so nothing is carried.
    """
    keys = list(keys)
    base = _bucketed(df, bucket)
    local = Window.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if whole:
        return base.select("*", *[F.last(v, ignorenulls=True).over(local).alias(n) for n, v in values.items()])
    out = base.select("*", *[F.last(v, ignorenulls=True).over(local).alias(f"__in_{n}") for n, v in values.items()])
    crossing = base if split is None else base.join(split, keys, "left_semi")
    summary = crossing.groupBy(*keys, BUCKET).agg(
        *[F.max_by(v, F.when(v.isNotNull(), _position(order))).alias(f"__end_{n}") for n, v in values.items()]
    )
    across = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *keys,
        BUCKET,
        *[F.last(f"__end_{n}", ignorenulls=True).over(across).alias(f"__from_{n}") for n in values],
    )
    joined = out.join(carry, [*keys, BUCKET], "left")
    return joined.select(
        *[F.col(c) for c in base.columns],
        *[F.coalesce(f"__in_{n}", f"__from_{n}").alias(n) for n in values],
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    bucket: Column | None = None,
) -> DataFrame:
    """Add inclusive running sums and maxima per key.

    Rows equal in ``order`` must not occur; end ``order`` with a unique column.
    """
    keys = list(keys)
    sums, maxima = dict(sums or {}), dict(maxima or {})
    base = _bucketed(df, bucket)
    local = Window.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = base.select(
        "*",
        *[F.sum(v).over(local).alias(f"__in_{n}") for n, v in sums.items()],
        *[F.max(v).over(local).alias(f"__in_{n}") for n, v in maxima.items()],
    )
    summary = base.groupBy(*keys, BUCKET).agg(
        *[F.sum(v).alias(f"__all_{n}") for n, v in sums.items()],
        *[F.max(v).alias(f"__all_{n}") for n, v in maxima.items()],
    )
    across = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *keys,
        BUCKET,
        *[F.sum(f"__all_{n}").over(across).alias(f"__from_{n}") for n in sums],
        *[F.max(f"__all_{n}").over(across).alias(f"__from_{n}") for n in maxima],
    )
    joined = out.join(carry, [*keys, BUCKET], "left")
    return joined.select(
        *[F.col(c) for c in base.columns],
        *[(F.coalesce(f"__in_{n}", F.lit(0)) + F.coalesce(f"__from_{n}", F.lit(0))).alias(n) for n in sums],
        *[F.greatest(f"__in_{n}", f"__from_{n}").alias(n) for n in maxima],
    )


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn", bucket: Column | None = None
) -> DataFrame:
    """Dense 1-based row number per key."""
    return running(df, keys, order, sums={name: F.lit(1)}, bucket=bucket)


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows: int,
    build,
    bucket: Column | None = None,
    block: int = 1 << SHIFT,
) -> DataFrame:
    """Count-based sliding window of ``rows`` rows per key.

    Rows get a dense number per key, blocks of ``block`` numbers form the tasks and
    the last ``rows - 1`` of each block are copied into the next one, so every
    window is complete inside its own block.  ``build(window)`` returns the named
    columns to add.
    """
    if block < rows:
        raise ValueError("a block must hold at least one full window")
    keys = list(keys)
    numbered = row_numbers(df, keys, order, "__rn", bucket).drop(BUCKET)
    own = F.expr(f"(__rn - 1) div {block}")
    spill = F.expr(f"(__rn - 1) % {block}") >= block - (rows - 1)
    copies = numbered.withColumn(
        "__copy",
        F.explode(
            F.when(
                spill,
                F.array(
                    F.struct(own.alias("block"), F.lit(False).alias("halo")),
                    F.struct((own + 1).alias("block"), F.lit(True).alias("halo")),
                ),
            ).otherwise(F.array(F.struct(own.alias("block"), F.lit(False).alias("halo"))))
        ),
    ).select("*", F.col("__copy.block").alias("__block"), F.col("__copy.halo").alias("__halo"))
    window = Window.partitionBy(*keys, "__block").orderBy("__rn").rowsBetween(-(rows - 1), 0)
    added = build(window)
    return (
        copies.select("*", *[c.alias(n) for n, c in added.items()])
        .filter(~F.col("__halo"))
        .drop("__rn", "__copy", "__block", "__halo")
    )
