"""Live counterparts: correlation, stage pairing, counters, aggregates, flight recorder, triggers.

Stateful operators keep one small state per key with a time limit; whatever a
limit drops is emitted as such, never lost silently.  Results that later evidence
may still change (file attribution, coverage) are recomputed in batch when the
session closes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from iotrail.operators.correlate import KEY, TTL_NS
from iotrail.operators.intervals import interval_join
from iotrail.operators.ordered import BUCKET, running
from iotrail.operators.stats import LATENCY_BOUNDS, bounded_index, histogram_percentile
from iotrail.plans.summary import moved
from iotrail.sources.recording import classify_lines

_OPEN = ["operation", "bytes", "pid"]


def event_time(ts_ns: str = "ts_ns"):
    """Microsecond clock used only for watermarks; all results keep nanoseconds."""
    return F.timestamp_micros(F.expr(f"{ts_ns} div 1000"))


def stream_lines(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """Guarded line stream: oversize, broken and unknown lines are marked, never joined to the next."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return classify_lines(
        raw.select("value", F.col("_metadata.file_path").alias("session_id"), F.lit(None).cast("long").alias("line_no"))
    )


# -- request correlation ----------------------------------------------------------

_RESULT = (
    "session_id string, request_id long, major long, minor long, outcome string, insert_ts long, issue_ts long, complete_ts long, "
    "operation string, bytes long, pid long"
)
_STATE = (
    "insert_ts long, issue_ts long, open_insert_ts long, operation string, bytes long, pid long, ambiguous_ts long"
)


def live_correlation(events: DataFrame, ttl_ns: int = TTL_NS, watermark: str = "10 seconds") -> DataFrame:
    """Correlate a stream of block events; rows are matched, uncorrelated, replaced or expired.

    Events of a key are applied in sequence order inside each micro-batch.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = [f.split(" ")[0] for f in _STATE.split(", ")]
        s = dict(zip(names, state.get)) if state.exists else dict.fromkeys(names)
        out: list[tuple] = []

        def emit(outcome: str, done=None, issue=None):
            i = issue or {}
            out.append((*key, outcome, i.get("open_insert_ts"), i.get("issue_ts"), done, i.get("operation"), i.get("bytes"), i.get("pid")))

        def lapse(now: int):
            if s["insert_ts"] is not None and now - s["insert_ts"] > ttl_ns:
                s["insert_ts"] = None
                emit("expired")
            if s["issue_ts"] is not None and now - s["issue_ts"] > ttl_ns:
                emit("expired", None, dict(s))
                s["issue_ts"] = None
            if s["ambiguous_ts"] is not None and now - s["ambiguous_ts"] > ttl_ns:
                s["ambiguous_ts"] = None
                emit("expired")

        if state.hasTimedOut:
            lapse(max(v for k, v in s.items() if k.endswith("_ts") and v is not None) + ttl_ns + 1)
        else:
            rows = pd.concat(list(batches)).sort_values("seq")
            for r in rows.itertuples(index=False):
                ts = int(r.ts_ns)
                lapse(ts)
                if r.kind == "insert":
                    if s["insert_ts"] is not None:
                        s["ambiguous_ts"] = ts
                        emit("replaced")
                    s["insert_ts"] = ts
                elif r.kind == "issue":
                    collided = s["issue_ts"] is not None or s["ambiguous_ts"] is not None
                    waiting, s["insert_ts"] = s["insert_ts"], None
                    if collided:
                        s["issue_ts"], s["ambiguous_ts"] = None, ts
                        emit("replaced")
                    else:
                        s.update(issue_ts=ts, open_insert_ts=waiting, operation=r.operation, bytes=int(r.bytes), pid=int(r.pid))
                elif s["ambiguous_ts"] is not None:
                    s["ambiguous_ts"] = None
                    emit("uncorrelated", ts)
                elif s["issue_ts"] is None or ts < s["issue_ts"]:
                    s["issue_ts"] = None
                    emit("uncorrelated", ts)
                else:
                    emit("matched", ts, dict(s))
                    s["issue_ts"] = None
        times = [s[n] for n in ("insert_ts", "issue_ts", "ambiguous_ts") if s[n] is not None]
        if times:
            state.update(tuple(s[n] for n in names))
            limit_ms = (min(times) + ttl_ns) // 1_000_000 + 1
            state.setTimeoutTimestamp(max(limit_ms, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        columns = [f.split(" ")[0] for f in _RESULT.split(", ")]
        frame = pd.DataFrame(out, columns=columns)
        longs = ["insert_ts", "issue_ts", "complete_ts", "bytes", "pid"]
        yield frame.astype(dict.fromkeys(longs, "Int64"))

    timed = events.select(*KEY, "seq", "kind", "ts_ns", *_OPEN, event_time().alias("event_time")).withWatermark("event_time", watermark)
    return timed.groupBy(*KEY).applyInPandasWithState(step, _RESULT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


# -- stage pairing ------------------------------------------------------------------


def live_stage_pairing(observations: DataFrame, ttl_ns: int = TTL_NS, watermark: str = "10 seconds") -> DataFrame:
    """Pair begin and end records of one command while they arrive."""
    result = "session_id string, layer string, pair_id long, name string, start_ns long, end_ns long"
    state_schema = "open_ts long, clash_ts long"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ts, clash_ts = state.get if state.exists else (None, None)
        out = []
        if state.hasTimedOut:
            open_ts = clash_ts = None
        else:
            for r in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
                now = int(r.clock) if r.clock == r.clock else int(r.ts_ns)
                if open_ts is not None and now - open_ts > ttl_ns:
                    open_ts = None
                if clash_ts is not None and now - clash_ts > ttl_ns:
                    clash_ts = None
                if r.phase == "begin":
                    if open_ts is not None:
                        open_ts, clash_ts = None, int(r.ts_ns)
                    elif clash_ts is None:
                        open_ts = int(r.ts_ns)
                elif clash_ts is not None:
                    open_ts = clash_ts = None
                elif open_ts is not None:
                    if int(r.ts_ns) >= open_ts:
                        out.append((*key, open_ts, int(r.ts_ns)))
                    open_ts = None
        kept = [t for t in (open_ts, clash_ts) if t is not None]
        if kept:
            state.update((open_ts, clash_ts))
            state.setTimeoutTimestamp(max((min(kept) + ttl_ns) // 1_000_000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["session_id", "layer", "pair_id", "name", "start_ns", "end_ns"])

    rows = observations.filter(F.col("phase").isin("begin", "end")).withColumn("pair_id", F.coalesce("correlation_id", "stage_key"))
    clock = F.col("clock") if "clock" in observations.columns else F.lit(None).cast("long")
    timed = rows.filter("pair_id is not null").select(
        "session_id", "layer", "pair_id", "name", "seq", "phase", "ts_ns", clock.alias("clock"), event_time().alias("event_time")
    )
    return (
        timed.withWatermark("event_time", watermark)
        .groupBy("session_id", "layer", "pair_id", "name")
        .applyInPandasWithState(step, result, state_schema, "append", GroupStateTimeout.EventTimeTimeout)
    )


# -- aggregates -----------------------------------------------------------------------


def second_aggregates(completions: DataFrame, watermark: str = "10 seconds") -> DataFrame:
    """One-second tumbling counts and volume by completion time."""
    timed = completions.withColumn("event_time", event_time("complete_ts")).withWatermark("event_time", watermark)
    grouped = timed.groupBy(F.window("event_time", "1 second"))
    return grouped.agg(F.count(F.lit(1)).alias("completed"), F.sum("bytes").alias("bytes"), F.avg("total_ns").alias("average_latency_ns")).select(
        F.expr("unix_micros(window.start) * 1000 div 1000000000").alias("second"), "completed", "bytes", "average_latency_ns"
    )


def latency_counts(completions: DataFrame) -> DataFrame:
    """Running histogram of latencies: its size is the number of buckets, however long the stream."""
    index = bounded_index(F.col("total_ns"), LATENCY_BOUNDS)
    return completions.filter("total_ns is not null").groupBy("operation", index.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def percentiles_of(counts: DataFrame) -> DataFrame:
    """Percentile ranges read from a histogram snapshot."""
    uppers = F.array(*[F.lit(int(b)) for b in LATENCY_BOUNDS])
    upper = F.when(F.col("bucket") < len(LATENCY_BOUNDS), F.get(uppers, F.col("bucket")))
    return histogram_percentile(counts.withColumn("upper", upper.cast("long")), ["operation"], [50, 95, 99], LATENCY_BOUNDS)


def heavy_hitter_counts(completions: DataFrame) -> DataFrame:
    """Exact running totals per issuer; the top list is taken on read."""
    return completions.groupBy("comm", "pid").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_ns").alias("cumulative_ns"), F.sum(moved()).alias("moved_bytes")
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain the available input into batch-numbered folders; a reader can pin any batch.

    A retried batch overwrites its own folder, so results appear exactly once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()
    schema = stream.schema.add("batch", "long")
    return stream.sparkSession.read.schema(schema).parquet(path)


def as_of_batch(table: DataFrame, batch: int) -> DataFrame:
    """Rows a reader saw at one batch, unaffected by later ones."""
    return table.filter(F.col("batch") <= batch)


def latest_snapshot(table: DataFrame) -> DataFrame:
    """Last complete snapshot of a table written in complete mode."""
    newest = table.agg(F.max("batch").alias("batch"))
    return table.join(newest, "batch", "left_semi").drop("batch")


# -- disk counters -----------------------------------------------------------------------


def live_disk_deltas(rows: DataFrame) -> DataFrame:
    """Counter growth per disk while polls arrive; a reboot or reset yields no growth."""
    result = "session_id string, disk string, poll long, reads long, read_sectors long, writes long, write_sectors long, reset boolean"
    state_schema = "elapsed_ms long, boot_id string, reads long, read_sectors long, writes long, write_sectors long, poll long"
    names = ["reads", "read_sectors", "writes", "write_sectors"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        prev = state.get if state.exists else None
        out = []
        for r in pd.concat(list(batches)).sort_values("poll").itertuples(index=False):
            now = (int(r.elapsed_ms), r.boot_id, *[int(getattr(r, n)) for n in names], int(r.poll))
            if prev is not None:
                usable = prev[1] == now[1] and now[0] > prev[0]
                delta = [b - a for a, b in zip(prev[2:6], now[2:6])]
                good = usable and min(delta) >= 0
                out.append((*key, now[6], *(delta if good else [None] * 4), bool(usable and not good)))
            prev = now
        state.update(prev)
        frame = pd.DataFrame(out, columns=["session_id", "disk", "poll", *names, "reset"])
        yield frame.astype(dict.fromkeys(names, "Int64"))

    return rows.groupBy("session_id", "disk").applyInPandasWithState(step, result, state_schema, "append", GroupStateTimeout.NoTimeout)


# -- adaptive trigger ----------------------------------------------------------------------


@dataclass(frozen=True)
class TriggerPolicy:
    """Threshold, windows in a row and time limits of the capture state machine."""

    rule: str
    threshold: int
    consecutive_windows: int
    deep_ns: int
    cooldown_ns: int
    arming_timeout_ns: int

    def __post_init__(self) -> None:
        if not self.rule.strip():
            raise ValueError("a policy needs a rule")
        if self.consecutive_windows <= 0:
            raise ValueError("at least one window is needed")
        if min(self.deep_ns, self.cooldown_ns, self.arming_timeout_ns) <= 0:
            raise ValueError("durations must be positive")


_TRANSITION = "session_id string, ts_ns long, from_state string, to_state string, observed long, consecutive long, reason string"


def _advance(policy: TriggerPolicy, state: tuple, ts: int, observed: int) -> tuple[tuple, tuple | None]:
    """One observation: new (state, entered, consecutive) and the transition, if any."""
    name, entered, streak = state
    above = observed > policy.threshold
    elapsed = ts - entered
    to = reason = None
    if name == "basic" and above:
        streak, to, reason = 1, "armed", "threshold_observed"
    elif name == "armed" and not above:
        streak, to, reason = 0, "basic", "signal_recovered"
    elif name == "armed":
        streak += 1
        if streak >= policy.consecutive_windows:
            to, reason = "deep", "consecutive_threshold_exceeded"
    elif name == "deep" and elapsed >= policy.deep_ns:
        to, reason = "cooldown", "deep_budget_elapsed"
    elif name == "cooldown" and elapsed >= policy.cooldown_ns:
        to, reason = "basic", "cooldown_elapsed"
    if to is None:
        return (name, entered, streak), None
    return (to, ts, streak), (ts, name, to, observed, streak, reason)


def trigger_transitions(windows: DataFrame, policy: TriggerPolicy) -> DataFrame:
    """Transitions of the state machine over metric windows (session_id, ts_ns, observed).

    One state per session streams through the time-sorted windows.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, state = None, ("basic", 0, 0)
        for batch in batches:
            out = []
            for sid, ts, observed in batch.itertuples(index=False, name=None):
                if sid != session:
                    session, state = sid, ("basic", 0, 0)
                state, moved_to = _advance(policy, state, int(ts), int(observed))
                if moved_to:
                    out.append((sid, *moved_to))
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in _TRANSITION.split(", ")])

    ordered = windows.select("session_id", "ts_ns", "observed").repartition("session_id").sortWithinPartitions("session_id", "ts_ns")
    return ordered.mapInPandas(fold, _TRANSITION)


def live_trigger(windows: DataFrame, policy: TriggerPolicy) -> DataFrame:
    """The same machine on a stream of windows.

    Armed, deep and cooldown end at their time limit when windows stop; such a row carries the last observed value.
    """
    ends = {
        "armed": ("basic", policy.arming_timeout_ns, "arming_timeout"),
        "deep": ("cooldown", policy.deep_ns, "deep_budget_elapsed"),
        "cooldown": ("basic", policy.cooldown_ns, "cooldown_elapsed"),
    }

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *current, observed = state.get if state.exists else ("basic", 0, 0, 0)
        out = []
        if state.hasTimedOut:
            name, entered, streak = current
            to, limit, reason = ends[name]
            streak = 0 if name == "armed" else streak
            out.append((*key, entered + limit, name, to, observed, streak, reason))
            current = (to, entered + limit, streak)
        else:
            for r in pd.concat(list(batches)).sort_values("ts_ns").itertuples(index=False):
                observed = int(r.observed)
                current, moved_to = _advance(policy, tuple(current), int(r.ts_ns), observed)
                if moved_to:
                    out.append((*key, *moved_to))
        state.update((*current, observed))
        if current[0] in ends:
            limit = (current[1] + ends[current[0]][1]) // 1_000_000 + 1
            state.setTimeoutTimestamp(max(limit, state.getCurrentWatermarkMs() + 1))
        frame = pd.DataFrame(out, columns=[c.split(" ")[0] for c in _TRANSITION.split(", ")])
        yield frame.astype({"observed": "Int64"})

    timed = windows.withColumn("event_time", event_time()).withWatermark("event_time", "1 minute")
    return timed.groupBy("session_id").applyInPandasWithState(
        step, _TRANSITION, "name string, entered long, streak long, observed long", "append", GroupStateTimeout.EventTimeTimeout
    )


# -- flight recorder ---------------------------------------------------------------------


def retained_before(events: DataFrame, triggers: DataFrame, keep_ns: int = 5_000_000_000, keep_bytes: int = 32 << 20) -> DataFrame:
    """Events a rolling recorder still holds at each trigger: the newest ones within both limits.

    ``events`` has session_id, seq, ts_ns and size; ``triggers`` session_id, trigger_id and ts_ns.
    """
    spans = triggers.select(
        "session_id", "trigger_id", (F.col("ts_ns") - keep_ns).alias("from_ns"), F.col("ts_ns").alias("trigger_ns")
    )
    near = interval_join(
        events.withColumn("at_end", F.col("ts_ns")), spans, ["session_id"], ("ts_ns", "at_end"), ("from_ns", "trigger_ns"), 1_000_000_000, left_bounded=True, right_bounded=True
    )
    newest_first = near.withColumn("age", F.col("trigger_ns") - F.col("ts_ns")).withColumn("back", -F.col("seq"))
    sized = running(
        newest_first,
        ["session_id", "trigger_id"],
        ["age", "back"],
        sums={"kept_bytes": F.col("size")},
        bucket=F.expr("age div 100000000"),
    ).drop(BUCKET)
    return sized.withColumn("retained", F.col("kept_bytes") <= keep_bytes).drop("age", "back", "at_end", "from_ns")


def segments(held: DataFrame) -> DataFrame:
    """Per trigger: first retained time, retained events and bytes, evicted events."""
    keep = F.col("retained")
    return held.groupBy("session_id", "trigger_id", "trigger_ns").agg(
        F.min(F.when(keep, F.col("ts_ns"))).alias("retained_from_ns"),
        F.count_if(keep).alias("retained_events"),
        F.coalesce(F.sum(F.when(keep, F.col("size"))), F.lit(0)).alias("retained_bytes"),
        F.count_if(~keep).alias("evicted_events"),
    )


def segment_events(events: DataFrame, transitions: DataFrame, before_ns: int = 3_000_000_000) -> DataFrame:
    """Events between 3 s before each deep transition and the transition that ends the deep phase.

    A deep phase that nothing has ended yet reaches to the last event of its session.
    """
    following = F.lead("ts_ns").over(Window.partitionBy("session_id").orderBy("ts_ns"))
    last = events.groupBy("session_id").agg(F.max("ts_ns").alias("last_ns"))
    deep = (
        transitions.withColumn("next_ns", following)
        .filter("to_state = 'deep'")
        .join(last, "session_id")
        .select(
            "session_id",
            F.col("ts_ns").alias("trigger_ns"),
            (F.col("ts_ns") - before_ns).alias("from_ns"),
            F.greatest(F.col("ts_ns"), F.coalesce("next_ns", "last_ns")).alias("to_ns"),
        )
    )
    return interval_join(
        events.withColumn("at_end", F.col("ts_ns")), deep, ["session_id"], ("ts_ns", "at_end"), ("from_ns", "to_ns"), 1_000_000_000, left_bounded=True
    ).drop("at_end")


def closed_sessions(lines: DataFrame) -> DataFrame:
    """Sessions whose footer has arrived; the rest are still partial."""
    footer = (F.col("status") == "ok") & (F.col("record") == "footer")
    return lines.groupBy("session_id").agg(F.bool_or(footer).alias("closed"))

