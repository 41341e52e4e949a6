"""Pairing of storage-stack begin and end records into spans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotrail.operators.ordered import BUCKET, SHIFT, carry_last, running, seq_bucket
from iotrail.operators.stats import on_keys

TTL_NS = 30_000_000_000
_FIELDS = ["operation", "sector", "bytes", "opcode", "status", "pid", "tid", "confidence", "correlation_id", "stage_key"]
PAIR = ["session_id", "layer", "pair_id", "name"]


def pair_stages(observations: DataFrame, ttl_ns: int = TTL_NS, shift: int = SHIFT, fold_ambiguity: bool = True) -> DataFrame:
    """Spans from begin/end records of one command; everything else passes through.

    A second begin makes the command ambiguous and the next end is swallowed.
    Begins of a command more than the limit apart start over, so only runs of
    three or more close begins need a fold, and those are streamed in order.
    """
    keyed = observations.withColumn("pair_id", F.coalesce("correlation_id", "stage_key"))
    boundary = F.col("phase").isin("begin", "end") & F.col("pair_id").isNotNull()
    plain = keyed.filter(~boundary).drop("pair_id")
    seen = running(
        keyed,
        ["session_id"],
        ["seq"],
        maxima={"newest": F.greatest("ts_ns", F.coalesce("end_ns", "ts_ns"))},
        bucket=seq_bucket(shift=shift),
    )
    seen = carry_last(seen, ["session_id"], ["seq"], {"clock": F.col("newest")}).drop(BUCKET, "newest")
    rows = seen.filter(boundary)
    begin, end = F.col("phase") == "begin", F.col("phase") == "end"
    first = carry_last(
        rows,
        PAIR,
        ["seq"],
        {"last_end": F.when(end, F.col("seq")), "last_begin": F.when(begin, F.struct("seq", "ts_ns"))},
        bucket=seq_bucket(shift=shift),
    )
    same_life = F.col("last_begin.seq") > F.coalesce("last_end", F.lit(-1))
    near = F.coalesce(same_life & (F.col("clock") - F.col("last_begin.ts_ns") <= ttl_ns), F.lit(False))
    marked = first.withColumn("opens", begin & ~near).withColumn("near", near)
    runs = carry_last(marked, PAIR, ["seq"], {"run_before": F.when(F.col("opens"), F.col("seq"))})
    run = F.when(F.col("opens"), F.col("seq")).otherwise(F.col("run_before"))
    runs = runs.withColumn("run", run).drop(BUCKET)
    payload = F.struct("seq", "ts_ns", *_FIELDS)
    sizes = (
        runs.filter(begin)
        .groupBy(*PAIR, "run")
        .agg(F.count(F.lit(1)).alias("begins"), F.min_by(payload, "seq").alias("opened"))
    )
    if fold_ambiguity:
        long_runs = sizes.filter("begins >= 3").select(*PAIR, "run")
        folded = _fold_runs(runs.filter(begin).join(long_runs, [*PAIR, "run"], "left_semi"), ttl_ns)
        settled = folded.join(
            runs.filter(begin).select(*PAIR, "run", F.col("seq").alias("open_seq"), payload.alias("reopened")),
            [*PAIR, "run", "open_seq"],
            "left",
        ).drop("open_seq")
        sizes = sizes.join(settled, [*PAIR, "run"], "left")
    else:
        sizes = sizes.withColumn("reopened", F.lit(None).cast(sizes.schema["opened"].dataType))
    ends = runs.filter(end).withColumn("usable", F.col("near"))
    joined = ends.join(sizes, [*PAIR, "run"], "left")
    start: Column = F.when(F.col("begins") == 1, F.col("opened")).when(F.col("begins") >= 3, F.col("reopened"))
    paired = joined.withColumn("b", F.when(F.col("usable"), start)).filter(
        F.col("b").isNotNull() & (F.col("ts_ns") >= F.col("b.ts_ns")) & (F.col("clock") - F.col("b.ts_ns") <= ttl_ns)
    )
    prefer_begin = {c: F.coalesce(F.col(f"b.{c}"), F.col(c)) for c in ("operation", "sector", "bytes", "opcode")}
    spans = paired.select(
        "session_id",
        F.col("b.seq").alias("seq"),
        F.col("b.ts_ns").alias("start_ts"),
        F.col("ts_ns").alias("end_ns"),
        F.lit("span").alias("phase"),
        "layer",
        "name",
        *[e.alias(c) for c, e in prefer_begin.items()],
        F.coalesce("status", "b.status").alias("status"),
        *[F.col(f"b.{c}").alias(c) for c in ("pid", "tid", "confidence", "correlation_id", "stage_key")],
    ).withColumnRenamed("start_ts", "ts_ns")
    return plain.unionByName(spans, allowMissingColumns=True)


def _fold_runs(begins: DataFrame, ttl_ns: int) -> DataFrame:
    """Which begin, if any, is still open at the end of each run of close begins."""
    columns = [*PAIR, "run"]
    ordered = (
        begins.select(*columns, "seq", "ts_ns", "clock").repartition(*columns).sortWithinPartitions(*columns, "seq")
    )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, open_seq, open_ts, clash_ts = None, None, None, None
        for batch in batches:
            done = []
            for row in batch.itertuples(index=False):
                key = tuple(row[: len(columns)])
                if key != current:
                    if current is not None:
                        done.append((*current, open_seq))
                    current, open_seq, open_ts, clash_ts = key, None, None, None
                clock = row.clock if row.clock == row.clock else row.ts_ns
                if open_ts is not None and clock - open_ts > ttl_ns:
                    open_seq = open_ts = None
                if clash_ts is not None and clock - clash_ts > ttl_ns:
                    clash_ts = None
                if open_ts is not None:
                    open_seq = open_ts = None
                    clash_ts = row.ts_ns
                elif clash_ts is None:
                    open_seq, open_ts = int(row.seq), row.ts_ns
            yield pd.DataFrame(done, columns=[*columns, "open_seq"])
        if current is not None:
            yield pd.DataFrame([(*current, open_seq)], columns=[*columns, "open_seq"])

    schema = "session_id string, layer string, pair_id long, name string, run long, open_seq long"
    return ordered.mapInPandas(fold, schema)


def stage_health(observations: DataFrame, spans: DataFrame) -> DataFrame:
    """Per layer: begins, ends, paired ends and the rest."""
    counts = observations.filter(F.col("phase").isin("begin", "end")).groupBy("layer").agg(
        F.count_if(F.col("phase") == "begin").alias("begins"), F.count_if(F.col("phase") == "end").alias("ends")
    )
    paired = spans.filter(F.col("phase") == "span").groupBy("layer").agg(F.count(F.lit(1)).alias("paired"))
    return on_keys(counts, paired, ["layer"], "left").select(
        "layer",
        "begins",
        "ends",
        F.coalesce("paired", F.lit(0)).alias("paired"),
        (F.col("ends") - F.coalesce("paired", F.lit(0))).alias("unpaired_ends"),
    )
