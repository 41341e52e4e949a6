"""Storage-address locality: repeat counts, payload by address and reuse gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iotrail.operators.ordered import BUCKET, SHIFT, carry_last, in_blocks, running
from iotrail.operators.stats import bin_index, edge_lower, edge_upper, equal_width_edges, on_keys
from iotrail.session import stage

DEVICE = ["major", "minor"]
SECTOR_BLOCK = 1 << 20


def address_counts(requests: DataFrame, block: int = SECTOR_BLOCK) -> DataFrame:
    """How often each sector range was read and written, by an edge sweep per device.

    Neighbouring ranges with equal counts join; ranges of unknown length are left out.
    """
    rw = requests.filter(F.col("operation").isin("read", "write") & (F.col("sectors") > 0))
    read = (F.col("operation") == "read").cast("long")
    edges = (
        rw.select(
            *DEVICE,
            F.explode(
                F.array(
                    F.struct(F.col("sector").alias("at"), read.alias("r"), (1 - read).alias("w")),
                    F.struct((F.col("sector") + F.col("sectors")).alias("at"), (-read).alias("r"), (read - 1).alias("w")),
                )
            ).alias("e"),
        )
        .groupBy(*DEVICE, F.col("e.at").alias("at"))
        .agg(F.sum("e.r").alias("r"), F.sum("e.w").alias("w"))
    )
    where = F.expr(f"at div {block}")
    swept = running(edges, DEVICE, ["at"], sums={"reads": F.col("r"), "writes": F.col("w")}, bucket=where)
    segments = carry_last(swept, DEVICE, ["at"], {"open": F.struct("at", "reads", "writes")})
    covered = stage(
        segments.filter((F.col("open.reads") > 0) | (F.col("open.writes") > 0)).select(
            *DEVICE,
            F.col("open.at").alias("start_sector"),
            F.col("at").alias("end_sector"),
            F.col("open.reads").alias("reads"),
            F.col("open.writes").alias("writes"),
        ),
        "address-segments",
    )
    where = F.expr(f"start_sector div {block}")
    last = carry_last(
        covered, DEVICE, ["start_sector"], {"before": F.struct("end_sector", "reads", "writes")}, bucket=where
    )
    same = (
        (F.col("before.end_sector") == F.col("start_sector"))
        & (F.col("before.reads") == F.col("reads"))
        & (F.col("before.writes") == F.col("writes"))
    )
    opened = last.withColumn("opens", ~F.coalesce(same, F.lit(False)))
    grouped = carry_last(
        opened, DEVICE, ["start_sector"], {"open_at": F.when(F.col("opens"), F.col("start_sector"))}
    )
    island = F.when(F.col("opens"), F.col("start_sector")).otherwise(F.col("open_at"))
    return grouped.groupBy(*DEVICE, island.alias("start_sector")).agg(
        F.max("end_sector").alias("end_sector"),
        F.max("reads").alias("reads"),
        F.max("writes").alias("writes"),
        (F.max("reads") + F.max("writes") > 1).alias("repeated"),
    )


def unknown_length(requests: DataFrame) -> DataFrame:
    rw = requests.filter(F.col("operation").isin("read", "write"))
    return rw.agg(F.count_if(F.col("sectors") <= 0).alias("unknown_or_empty"))


def spatial_payload(requests: DataFrame, bins: int = 16) -> DataFrame:
    """Read and written bytes per equal-width sector bin of each device."""
    rw = requests.filter(F.col("operation").isin("read", "write"))
    edges = equal_width_edges(rw, DEVICE, "sector", bins)
    spread = edges.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin")).select(
        *DEVICE, "bin", edge_lower(F.col("bin")).alias("lower"), edge_upper(F.col("bin")).alias("upper")
    )
    counted = (
        on_keys(rw.select(*DEVICE, "sector", "operation", "bytes"), edges, DEVICE)
        .groupBy(*DEVICE, bin_index(F.col("sector")).alias("bin"))
        .agg(
            F.sum(F.when(F.col("operation") == "read", F.col("bytes")).otherwise(0)).alias("read_bytes"),
            F.sum(F.when(F.col("operation") == "write", F.col("bytes")).otherwise(0)).alias("write_bytes"),
        )
    )
    return spread.join(counted, [*DEVICE, "bin"], "left").fillna(0, ["read_bytes", "write_bytes"])


def reuse_gaps(requests: DataFrame, order: str = "seq", shift: int = SHIFT) -> DataFrame:
    """Time since the same sector was last accessed in the same direction; unplaced issues excluded."""
    rw = requests.filter(F.col("operation").isin("read", "write") & F.col("issue_ts").isNotNull())
    keys = [*DEVICE, "sector", "operation"]
    blocks = stage(in_blocks(rw.select(*keys, "request_id", "issue_ts", order), keys, ["issue_ts", order], shift), "reuse-blocks")
    seen = carry_last(blocks, keys, ["issue_ts", order], {"prev_ts": F.col("issue_ts")}).drop(BUCKET)
    return seen.withColumn("gap_ms", (F.col("issue_ts") - F.col("prev_ts")).cast("double") / 1e6).drop("prev_ts", order)
