"""Named graph queries: every point of the cohort, with optional display sampling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotrail.functions.axes import explore, label_positions, time_ms
from iotrail.functions.scalars import at_least_zero, device_label, process_label
from iotrail.operators.graph import KEY
from iotrail.operators.ordered import BUCKET, in_blocks, row_numbers
from iotrail.operators.sampling import cap_groups, operation_quota, shape_sample
from iotrail.operators.stats import on_keys
from iotrail.session import stage

MAX_POINTS = 12_000  # fixed value: points of a plain scatter
MAX_GRAPH_POINTS = 2_000  # fixed value: points when request graphs are needed


@dataclass(frozen=True)
class Preset:
    x: str
    y: str
    group: str
    needs_graph: bool = False


SCATTER: dict[str, Preset] = {
    "latency_timeline": Preset("time_ms", "total_latency_ms", "direction"),
    "latency_by_file": Preset("time_ms", "total_latency_ms", "file", True),
    "queue_pressure": Preset("queue_depth_at_issue", "total_latency_ms", "direction"),
    "layer_contribution": Preset("filesystem_ms", "ufs_ms", "file", True),
    "lba_distribution": Preset("time_ms", "address_mb", "direction"),
    "chunk_timeline": Preset("time_ms", "chunk_kib", "direction"),
    "queue_timeline": Preset("time_ms", "issue_queue_depth", "direction"),
    "issue_gap_timeline": Preset("time_ms", "issue_gap_ms", "direction"),
    "completion_gap_timeline": Preset("time_ms", "completion_gap_ms", "direction"),
    "normalized_latency_timeline": Preset("time_ms", "latency_per_kib", "direction"),
    "cpu_timeline": Preset("time_ms", "issue_cpu", "process"),
    "rolling_c2c_bandwidth": Preset("time_ms", "rolling_c2c_mib_s", "direction"),
    "rolling_d2d_bandwidth": Preset("time_ms", "rolling_d2d_mib_s", "direction"),
}


def scatter(name: str, requests: DataFrame, origin_ns: int | Column) -> DataFrame:
    """All points of a preset.  File and layer presets expect the labels and graph axes to be attached."""
    p = SCATTER[name]
    return explore(requests, p.x, p.y, p.group, origin_ns)


def display_points(requests: DataFrame, name: str, origin_ns: int | Column, limit: int | None = None) -> DataFrame:
    """Preset points thinned for display: shape-preserving per group and operation, at most 32 groups."""
    p = SCATTER[name]
    points = explore(requests, p.x, p.y, p.group, origin_ns, keep=("operation", "seq")).filter("x is not null and y is not null")
    bound = limit or (MAX_GRAPH_POINTS if p.needs_graph else MAX_POINTS)
    kept = shape_sample(points, ["grp", "operation"], ["seq"], F.shiftright("seq", 20), "x", "y", bound)
    return cap_groups(kept, "grp").select("request_id", "x", "y", "grp")


def overall(requests: DataFrame, origin_ns: int | Column, limit: int | None = None) -> DataFrame:
    """Address, depth and chunk over time of every request, or of an operation-quota sample when a limit is given."""
    kept = requests if limit is None else operation_quota(requests, ["seq"], F.shiftright("seq", 20), limit)
    return kept.select(
        "request_id",
        time_ms(origin_ns).alias("time_ms"),
        F.col("sector").cast("double").alias("sector"),
        F.col("issue_depth").cast("double").alias("depth"),
        (F.col("bytes").cast("double") / 1024.0).alias("chunk_kib"),
    )


def connected_footprint(requests: DataFrame, origin_ns: int | Column) -> DataFrame:
    """One address segment per request from issue to completion."""

    def ms(c: str) -> Column:
        return at_least_zero(F.col(c) - origin_ns).cast("double") / 1e6

    return requests.filter("issue_ts is not null and complete_ts is not null").select(
        "request_id", ms("issue_ts").alias("from_ms"), ms("complete_ts").alias("to_ms"), F.col("sector").cast("double").alias("sector"), "operation"
    )


def footprint_lanes(requests: DataFrame, lane: str, origins: DataFrame | None = None) -> DataFrame:
    """Requests per lane; a request appears in every candidate lane but is counted once globally."""
    rows = requests
    if lane in ("file", "file_process"):
        shown = origins.select(*KEY, F.coalesce("path", "inode_label").alias("file")).distinct()
        rows = rows.join(shown, KEY, "left").withColumn("file", F.coalesce("file", F.lit("<path unresolved>")))
    label = {
        "combined": F.lit("All requests"),
        "process": process_label(),
        "file": F.col("file") if lane.startswith("file") else None,
        "file_process": F.concat_ws(" | ", "file", process_label()) if lane.startswith("file") else None,
    }[lane]
    return rows.select(*KEY, "request_id", label.alias("lane"), "complete_ts", "sector", "bytes")


def lane_counts(lanes: DataFrame, requests: DataFrame) -> DataFrame:
    per_lane = lanes.groupBy("lane").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    return per_lane.join(requests.agg(F.count(F.lit(1)).alias("distinct_requests")), F.lit(True))


def _lanes(points: DataFrame) -> DataFrame:
    return on_keys(points, label_positions(points.select("label"), first=1), ["label"]).withColumnRenamed("position", "lane")


def command_timeline(requests: DataFrame, origin_ns: int | Column) -> DataFrame:
    """Completion time on one lane per device and command, lanes in label order from 1."""
    points = requests.select(
        "request_id", time_ms(origin_ns).alias("x"), F.concat(device_label(), F.lit(" / "), F.col("operation")).alias("label")
    )
    return _lanes(points)


def cpu_events(requests: DataFrame, origin_ns: int | Column) -> DataFrame:
    """Issue and completion marks on one lane per device and CPU."""

    def ms(c: Column) -> Column:
        return at_least_zero(c - origin_ns).cast("double") / 1e6

    marks = F.array(
        F.struct(F.lit("issue").alias("phase"), F.col("issue_ts").alias("ts"), F.col("cpu").alias("c")),
        F.struct(F.lit("completion").alias("phase"), F.col("complete_ts").alias("ts"), F.col("complete_cpu").alias("c")),
    )
    points = (
        requests.withColumn("m", F.explode(marks))
        .filter("m.ts is not null and m.c is not null")
        .select(
            "request_id",
            F.col("m.phase").alias("phase"),
            ms(F.col("m.ts")).alias("x"),
            F.concat(device_label(), F.lit(" / CPU "), F.lpad(F.col("m.c").cast("string"), 4, "0")).alias("label"),
        )
    )
    return _lanes(points)


def request_gantt(requests: DataFrame, origin_ns: int | Column) -> DataFrame:
    """Row number per request ordered by issue (else completion), completion and request."""
    rows = requests.withColumn("begin", F.coalesce("issue_ts", "complete_ts"))
    order = ["begin", "complete_ts", "request_id"]
    blocks = stage(in_blocks(rows.select(*order, "issue_ts"), [], order), "gantt-blocks")
    numbered = row_numbers(blocks, [], order, "row").drop(BUCKET)
    return numbered.select("request_id", "row", time_ms(origin_ns).alias("x"))
