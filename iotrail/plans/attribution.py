"""File origins, path confidence, coverage and explanations per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotrail.functions.confidence import from_rank
from iotrail.functions.scalars import device_label, inode_label
from iotrail.operators.graph import KEY, NODE_KINDS, critical_path, exclusive_time, kind_durations, strongest_up
from iotrail.operators.stats import nearest_rank
from iotrail.plans.summary import moved
from iotrail.session import stage_dealt

IDENTITY = ["fs_major", "fs_minor", "inode", "generation", "mount"]


def file_origins(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Files each request can be traced back to.

    A path is as strong as its weakest edge and a file takes its strongest path;
    a path looked up rather than recorded is at most probable.  Ties keep the
    earliest node.
    """
    roots = nodes.filter(F.col("kind") == "block_request").filter(F.col("ord") == 0).select(*KEY, "node_id")
    walked = stage_dealt(strongest_up(edges, roots), "walked", KEY, placed=True)
    looked_up = edges.filter("inferred_path").select(*KEY, F.col("from_id").alias("node_id")).distinct().withColumn("guessed", F.lit(True))
    named = (
        nodes.filter(F.col("inode").isNotNull())
        .join(walked, [*KEY, "node_id"])
        .join(looked_up, [*KEY, "node_id"], "left")
        .withColumn("strength", F.when(F.col("guessed"), F.least("strength", F.lit(2))).otherwise(F.col("strength")))
    )
    best = F.struct((-F.col("strength")).alias("weak"), "start_ns", "node_id", "path")
    files = named.groupBy(*KEY, *IDENTITY).agg(F.min(best).alias("b"))
    partial = (
        edges.filter("incomplete")
        .join(walked.select(*KEY, F.col("node_id").alias("to_id")), [*KEY, "to_id"], "left_semi")
        .select(*KEY)
        .distinct()
        .withColumn("incomplete", F.lit(True))
    )
    return (
        files.join(partial, KEY, "left")
        .select(
            *KEY,
            *IDENTITY,
            F.col("b.path").alias("path"),
            from_rank(-F.col("b.weak")).alias("confidence"),
            F.coalesce("incomplete", F.lit(False)).alias("incomplete"),
        )
        .withColumn("inode_label", inode_label("fs_major", "fs_minor", "inode"))
    )


def _has_path() -> Column:
    return F.col("path").isNotNull() & (F.col("path") != "")


def path_classes(requests: DataFrame, origins: DataFrame) -> DataFrame:
    """exact / probable / unresolved per request, with the disjoint reason when unresolved."""
    agg = origins.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("origin_count"),
        F.bool_and(_has_path()).alias("all_paths"),
        F.bool_or(F.col("confidence") == "context_only").alias("context_only"),
        F.bool_or("incomplete").alias("incomplete"),
        F.bool_and(F.col("confidence") == "exact").alias("all_exact"),
    )
    joined = requests.join(agg, KEY, "left").withColumn("origin_count", F.coalesce("origin_count", F.lit(0)))
    resolved = (F.col("origin_count") > 0) & F.col("all_paths") & ~F.col("context_only") & ~F.col("incomplete")
    label = F.when(F.coalesce(resolved, F.lit(False)), F.when(F.col("all_exact"), "exact").otherwise("probable")).otherwise("unresolved")
    reason = F.when(
        F.col("path_confidence") == "unresolved",
        F.when(F.col("origin_count") == 0, "no_origin")
        .when(F.col("incomplete"), "incomplete_origin_set")
        .when(~F.col("all_paths"), "missing_path")
        .otherwise("context_only"),
    )
    return joined.withColumn("path_confidence", label).withColumn("reason", reason).drop(
        "all_paths", "context_only", "incomplete", "all_exact"
    )


def path_coverage(classes: DataFrame, counters: DataFrame) -> DataFrame:
    """One row: count and bytes per class, reasons, overlap, and events that never paired."""
    names = ("exact", "probable", "unresolved")
    reasons = ("no_origin", "missing_path", "context_only", "incomplete_origin_set")
    agg = classes.agg(
        *[F.count_if(F.col("path_confidence") == n).alias(f"{n}_count") for n in names],
        *[F.coalesce(F.sum(F.when(F.col("path_confidence") == n, F.col("bytes"))), F.lit(0)).alias(f"{n}_bytes") for n in names],
        *[F.count_if(F.col("reason") == r).alias(r) for r in reasons],
        F.count_if(F.col("origin_count") > 1).alias("multi_origin_count"),
        F.coalesce(F.sum(F.when(F.col("origin_count") > 1, F.col("bytes"))), F.lit(0)).alias("multi_origin_bytes"),
    )
    return (
        agg.join(counters.agg(*[F.sum(c).alias(c) for c in ("issued", "completed", "uncorrelated")]), F.lit(True))
        .withColumn("unresolved_count", F.col("unresolved_count") + F.col("uncorrelated"))
        .withColumn("unmatched_completions", F.col("uncorrelated"))
        .withColumn("issues_without_completion", F.greatest(F.col("issued") - F.col("completed"), F.lit(0).cast("long")))
        .drop("issued", "completed", "uncorrelated")
    )


def attribution_summary(requests: DataFrame, origins: DataFrame) -> DataFrame:
    """Requests by their best origin confidence; context-only counts as unattributed."""
    order = F.when(F.col("confidence") == "exact", 3).when(F.col("confidence") == "probable", 2).when(
        F.col("confidence") == "probable_async", 1
    ).otherwise(0)
    best = origins.groupBy(*KEY).agg(F.max(order).alias("best"), F.count(F.lit(1)).alias("n"))
    label = F.when(F.coalesce("best", F.lit(0)) == 0, "unattributed").otherwise(from_rank("best"))
    return (
        requests.select(*KEY)
        .join(best, KEY, "left")
        .groupBy(label.alias("attribution"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n") > 1).alias("multi_origin"))
    )


def file_labels(requests: DataFrame, classes: DataFrame, origins: DataFrame) -> DataFrame:
    """Attach file group label, candidate label and path confidence to each request.

    Candidates of one request are joined in label order; bytes stay on one row.
    """
    shown = F.coalesce(F.when(_has_path(), F.col("path")), F.col("inode_label"))
    labels = origins.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("__n"),
        F.min(shown).alias("__one"),
        F.array_join(
            F.array_sort(F.collect_set(F.concat(shown, F.lit(" ["), F.col("confidence"), F.lit("]")))), " | "
        ).alias("file_candidates"),
    )
    group = F.when(F.col("__n") == 1, F.col("__one")).otherwise(
        F.concat(F.lit("Multiple files ("), F.col("__n").cast("string"), F.lit(")"))
    )
    found = labels.select(*KEY, group.alias("file_group"), "file_candidates")
    return requests.join(classes.select(*KEY, "path_confidence", "origin_count"), KEY, "left").join(found, KEY, "left")


def file_targets(requests: DataFrame, origins: DataFrame) -> DataFrame:
    """Per file candidate: requests, bytes, longest latency and number of issuers.

    A request without any candidate counts under its device's placeholder.
    Candidate bytes overlap and must not be added up.
    """
    cand = origins.select(
        *KEY,
        F.when(_has_path(), F.col("path")).otherwise("<path unresolved>").alias("file"),
        F.col("inode_label").alias("identity"),
        F.when(_has_path(), F.col("confidence")).otherwise("unresolved").alias("file_confidence"),
    ).distinct()
    joined = (
        requests.join(cand, KEY, "left")
        .withColumn("identity", F.coalesce("identity", F.concat(F.lit("block device "), device_label(), F.lit(" · inode unavailable"))))
        .withColumn("file", F.coalesce("file", F.lit("<path unresolved>")))
        .withColumn("file_confidence", F.coalesce("file_confidence", F.lit("unresolved")))
    )
    keys = ["file", "identity", "file_confidence"]
    # Two steps: per issuer first, so that the issuer count needs no distinct over requests.
    per_issuer = joined.groupBy(*keys, "pid", "tid", "comm").agg(
        F.count(F.lit(1)).alias("n"), F.sum(moved("read")).alias("r"), F.sum(moved("write")).alias("w"), F.max("total_ns").alias("m")
    )
    return per_issuer.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum("r").alias("read_bytes"),
        F.sum("w").alias("write_bytes"),
        F.max("m").alias("max_latency_ns"),
        F.count(F.lit(1)).alias("issuers"),
    )


def file_membership(requests: DataFrame, origins: DataFrame) -> DataFrame:
    """Overlapping shares of file candidates: count and moved bytes."""
    t = file_targets(requests, origins)
    return t.select(
        F.concat("file", F.lit(" / "), "identity", F.lit(" ["), "file_confidence", F.lit("]")).alias("label"),
        "n",
        (F.col("read_bytes") + F.col("write_bytes")).alias("payload"),
    )


def layer_membership(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Overlapping shares of observed layers."""
    seen = nodes.select(*KEY, "kind").distinct()
    return (
        requests.join(seen, KEY)
        .groupBy(F.col("kind").alias("label"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(moved()).alias("payload"))
    )


def with_graph_axes(requests: DataFrame, nodes: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Filesystem and UFS time (null when any such node lacks an end) and the critical path."""

    def kind_time(kind: str, name: str) -> DataFrame:
        rows = nodes.filter(F.col("kind") == kind)
        whole = F.count(F.lit(1)) == F.count("end_ns")
        return rows.groupBy(*KEY).agg(F.when(whole, F.sum(F.col("end_ns") - F.col("start_ns"))).alias(name))

    out = requests.join(kind_time("filesystem", "filesystem_ns"), KEY, "left").join(kind_time("ufs_command", "ufs_ns"), KEY, "left")
    if paths is not None:
        out = out.join(paths.select(*KEY, "critical_path_ns"), KEY, "left")
    return out


def critical_paths(nodes: DataFrame, ranked: DataFrame) -> DataFrame:
    return critical_path(ranked, exclusive_time(nodes, ranked))


def why_slow(requests: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """For every request the stage that took most above its cohort's median.

    Cohort: same operation, access and size class, at least three requests, all of
    them.  A stage a cohort member does not have counts as zero there.
    """
    cohort = ["operation", "access_pattern", "size_class"]
    spent = kind_durations(nodes)
    sizes = requests.groupBy(*cohort).agg(F.count(F.lit(1)).alias("cohort_samples")).filter("cohort_samples >= 3")
    values = requests.select(*KEY, *cohort).join(spent, KEY).join(sizes, cohort)
    # The rank among the present values; absent members are the zeros below them.
    at = F.expr("(50 * cohort_samples + 99) div 100 - (cohort_samples - __total)")
    medians = nearest_rank(values, [*cohort, "cohort_samples", "kind"], "duration_ns", [50], rank=at)
    medians = medians.drop("cohort_samples").withColumnRenamed("p50", "m")
    order: Column = F.lit(None).cast("int")
    for i, kind in enumerate(NODE_KINDS):
        order = F.when(F.col("kind") == kind, i).otherwise(order)
    compared = (
        requests.select(*KEY, *cohort)
        .join(spent, KEY)
        .join(sizes, cohort)
        .join(medians, [*cohort, "kind"], "left")
        .withColumn("cohort_median_ns", F.coalesce("m", F.lit(0)))
        .withColumn("delta_ns", F.col("duration_ns") - F.col("cohort_median_ns"))
        .filter("delta_ns > 0")
    )
    best = compared.groupBy(*KEY).agg(
        F.max(F.struct("delta_ns", (-order).alias("o"), "kind", "duration_ns", "cohort_median_ns", "cohort_samples")).alias("b")
    )
    ends = edges.select(*KEY, "confidence", F.explode(F.array("from_id", "to_id")).alias("node_id"))
    rank_of = F.when(F.col("confidence") == "exact", 3).when(F.col("confidence") == "probable", 2).when(
        F.col("confidence") == "probable_async", 1
    ).otherwise(0)
    touching = ends.join(nodes.select(*KEY, "node_id", "kind"), [*KEY, "node_id"]).groupBy(*KEY, "kind")
    touching = stage_dealt(touching.agg(F.min(rank_of).alias("r")), "touching", KEY, placed=True)
    return (
        best.select(*KEY, "b.*")
        .drop("o")
        .join(touching, [*KEY, "kind"], "left")
        .select(
            *KEY,
            F.col("kind").alias("stage"),
            F.col("duration_ns").alias("selected_ns"),
            "cohort_median_ns",
            "delta_ns",
            F.coalesce(from_rank("r"), F.lit("exact")).alias("confidence"),
            "cohort_samples",
        )
    )


def kinds_of(nodes: DataFrame) -> DataFrame:
    return nodes.select(*KEY, "kind").distinct()


