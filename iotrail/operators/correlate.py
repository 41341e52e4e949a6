"""Request correlation: insert? -> issue -> complete, with reuse protection and a time limit.

Rules, per ``(session, request_id, device)`` in stream order:

* an issue while another is open, or while the key is ambiguous, makes the key
  ambiguous and leaves nothing open;
* a second insert with no issue in between makes the key ambiguous too;
* a completion on an ambiguous key clears the ambiguity and matches nothing;
* open, queued and ambiguous entries lapse when the stream clock passes their
  time by more than the limit.

All of it reduces to "latest earlier row of some kind" look-ups, so the whole
correlator is a few carried windows and no key is ever folded in one task.
Timestamps of one key must not run backwards between its inserts and issues
(completions may; they then match nothing).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotrail.operators.ordered import BUCKET, SHIFT, carry_last, long_key_bucket, long_keys, running, seq_bucket, time_bucket, trailing
from iotrail.session import stage

TTL_NS = 30_000_000_000
KEY = ["session_id", "request_id", "major", "minor"]
DEVICE = ["session_id", "major", "minor"]

_PAYLOAD = ["operation", "sector", "sectors", "bytes", "pid", "tid", "cpu", "comm"]


def stream_clock(events: DataFrame, shift: int = SHIFT) -> DataFrame:
    """Largest timestamp seen so far in the session, for streams that are not time sorted."""
    return running(events, ["session_id"], ["seq"], maxima={"clock": F.col("ts_ns")}, bucket=seq_bucket(shift=shift)).drop(
        BUCKET
    )


def annotate_lifetimes(
    events: DataFrame, ttl_ns: int = TTL_NS, time_sorted: bool = False, shift: int = SHIFT
) -> DataFrame:
    """Mark every block event with what it opens, closes, collides with or swallows.

    Added columns: ``duplicate_insert``, ``swallowed`` (completion eaten by an
    insert collision), ``accepted`` (issue left open), ``source`` (struct of the
    open issue this row consumes), ``matched`` and the lapse counters.
    """
    clocked = events.withColumn("clock", F.col("ts_ns")) if time_sorted else stream_clock(events, shift)
    kind, clock = F.col("kind"), F.col("clock")
    is_insert, is_issue, is_complete = kind == "insert", kind == "issue", kind == "complete"

    def alive(ts: Column) -> Column:
        return clock - ts <= ttl_ns

    # A key of few rows is one window; only long keys are cut into blocks.  Every look-up
    # below has the same partitions, so the rows are shuffled once.
    long = stage(long_keys(clocked, KEY, shift), "long-keys")
    whole = long.isEmpty()
    blocks = long_key_bucket(clocked, KEY, long, shift)

    # 1. Latest earlier insert-or-issue and latest earlier completion of the key.
    first = carry_last(
        blocks,
        KEY,
        ["seq"],
        {
            "prev_queue": F.when(~is_complete, F.struct("kind", "ts_ns", "seq")),
            "prev_complete_seq": F.when(is_complete, F.col("seq")),
        },
        split=long,
        whole=whole,
    )
    waiting = F.col("prev_queue.kind") == "insert"
    first = first.withColumn(
        "duplicate_insert", F.coalesce(is_insert & waiting & alive(F.col("prev_queue.ts_ns")), F.lit(False))
    ).withColumn("insert_lapsed", F.coalesce(~is_complete & waiting & ~alive(F.col("prev_queue.ts_ns")), F.lit(False)))

    # 2. Latest earlier row that could have touched the key's state.
    second = carry_last(
        first,
        KEY,
        ["seq"],
        {"prev_touch": F.when(is_issue | F.col("duplicate_insert"), F.struct("seq", "ts_ns", is_issue.alias("issue")))},
        split=long,
        whole=whole,
    )
    same_life = F.col("prev_touch.seq") > F.coalesce("prev_complete_seq", F.lit(-1))
    touch_alive = same_life & alive(F.col("prev_touch.ts_ns"))
    second = (
        second.withColumn("rejected", F.coalesce(is_issue & touch_alive, F.lit(False)))
        .withColumn("swallowed", F.coalesce(is_complete & touch_alive & ~F.col("prev_touch.issue"), F.lit(False)))
        .withColumn("touch_lapsed", F.coalesce(same_life & ~alive(F.col("prev_touch.ts_ns")), F.lit(False)))
        .withColumn(
            "own_insert_ts",
            F.when(is_issue & waiting & alive(F.col("prev_queue.ts_ns")), F.col("prev_queue.ts_ns")),
        )
        .drop("prev_queue")
    )
    if not whole:
        second = stage(second, "block-touches")

    # 3. The issue each row could consume: latest issue with only swallowed completions since.
    third = carry_last(
        second,
        KEY,
        ["seq"],
        {
            "prev_issue": F.when(
                is_issue,
                F.struct("seq", "ts_ns", "rejected", F.col("own_insert_ts").alias("insert_ts"), *_PAYLOAD),
            ),
            "prev_close_seq": F.when(is_complete & ~F.col("swallowed"), F.col("seq")),
        },
        split=long,
        whole=whole,
    )
    third = stage(third.drop(BUCKET), "block-lifetimes")
    still_open = F.col("prev_issue.seq") > F.coalesce("prev_close_seq", F.lit(-1))
    third = third.withColumn("open_alive", F.coalesce(still_open & alive(F.col("prev_issue.ts_ns")), F.lit(False)))
    third = third.withColumn("open_lapsed", F.coalesce(still_open & ~F.col("open_alive"), F.lit(False)))
    third = third.withColumn("linked", is_issue & ~F.col("rejected") & F.col("open_alive"))

    # 4. An issue that survived a swallowed completion rejects the next one, which then
    #    lets the one after through: acceptance alternates along such a chain.
    #    Most traces have none, and then nothing is joined.
    affected = stage(third.filter("swallowed").select(*KEY).distinct(), "swallowing-keys")
    none = affected.isEmpty()
    if none:
        flipped = third.withColumns({"own_flip": F.lit(None).cast("boolean"), "source_flip": F.lit(None).cast("boolean")})
    else:
        flips = stage(_chain_parity(third, affected, shift), "chain-parity")
        flipped = (
            third.join(flips.select(*KEY, F.col("flip_seq").alias("seq"), F.col("flip").alias("own_flip")), [*KEY, "seq"], "left")
            .withColumn("__issue_seq", F.col("prev_issue.seq"))
            .join(
                flips.select(*KEY, F.col("flip_seq").alias("__issue_seq"), F.col("flip").alias("source_flip")),
                [*KEY, "__issue_seq"],
                "left",
            )
        )
    out = (
        flipped
        .withColumn("accepted", is_issue & F.coalesce("own_flip", ~F.col("rejected")))
        .withColumn("source_accepted", F.coalesce(F.coalesce("source_flip", ~F.col("prev_issue.rejected")), F.lit(False)))
    )
    closes = is_issue | (is_complete & ~F.col("swallowed"))
    out = (
        out.withColumn("consumes", closes & F.col("open_alive") & F.col("source_accepted"))
        .withColumn("matched", is_complete & F.col("consumes") & (F.col("ts_ns") >= F.col("prev_issue.ts_ns")))
        .withColumn(
            "pending_payload_bytes",
            F.when(
                is_complete & F.col("open_alive") & F.col("source_accepted") & (F.col("prev_issue.ts_ns") <= F.col("ts_ns")),
                F.when(F.col("prev_issue.operation").isin("read", "write"), F.col("prev_issue.bytes")).otherwise(F.lit(0)),
            ),
        )
        .withColumn("open_expired", closes & F.col("open_lapsed") & F.col("source_accepted"))
        .withColumn(
            "ambiguity_expired",
            (is_complete | is_issue | F.col("duplicate_insert"))
            & F.col("touch_lapsed")
            & (~F.col("prev_touch.issue") | ~F.col("source_accepted")),
        )
    )
    out = out.withColumnRenamed("prev_issue", "source").drop(
        "own_flip", "source_flip", "__issue_seq", "prev_close_seq", "linked"
    )
    return out if none else stage(out, "block-outcomes")


def _chain_parity(third: DataFrame, affected: DataFrame, shift: int) -> DataFrame:
    """Acceptance of issues in chains that cross swallowed completions (empty in most traces)."""
    issues = third.filter(F.col("kind") == "issue").select(*KEY, "seq", "rejected", "linked").join(affected, KEY, "left_semi")
    based = carry_last(
        issues,
        KEY,
        ["seq"],
        {"base": F.when(~F.col("linked"), F.struct("seq", "rejected"))},
        bucket=seq_bucket(shift=shift),
    ).filter("linked")
    chain = running(
        based.withColumn("base_seq", F.col("base.seq")).drop(BUCKET),
        [*KEY, "base_seq"],
        ["seq"],
        sums={"hops": F.lit(1)},
        bucket=seq_bucket(shift=shift),
    )
    odd = F.col("hops") % 2 == 1
    return chain.select(*KEY, F.col("seq").alias("flip_seq"), (F.col("base.rejected") == odd).alias("flip"))


def correlation_counters(annotated: DataFrame, ttl_ns: int = TTL_NS) -> DataFrame:
    """Per session: issued, completed, uncorrelated, replaced and expired entries."""
    tail = F.struct("seq", "ts_ns", F.col("kind").alias("kind"))
    touch = (F.col("kind") == "issue") | F.col("duplicate_insert")
    per_key = annotated.groupBy(*KEY).agg(
        F.count_if(F.col("kind") == "issue").alias("issued"),
        F.count_if(F.col("kind") == "complete").alias("completions"),
        F.count_if("matched").alias("matched"),
        F.count_if(F.col("duplicate_insert") | ((F.col("kind") == "issue") & ~F.col("accepted"))).alias("replaced"),
        (F.count_if("insert_lapsed") + F.count_if("open_expired") + F.count_if("ambiguity_expired")).alias("expired"),
        F.max("clock").alias("clock"),
        F.max(F.when(F.col("kind") != "complete", tail)).alias("last_queue"),
        F.max(F.when(F.col("kind") == "issue", F.struct("seq", "ts_ns", "accepted"))).alias("last_issue"),
        F.max(F.when(touch, F.struct("seq", "ts_ns", "kind", "accepted"))).alias("last_touch"),
        F.max(F.when(F.col("kind") == "complete", F.col("seq"))).alias("last_complete"),
        F.max(F.when((F.col("kind") == "complete") & ~F.col("swallowed"), F.col("seq"))).alias("last_close"),
    )
    ends = annotated.groupBy("session_id").agg(F.max("clock").alias("end_clock"))
    late = per_key.join(ends, "session_id")

    def lapsed(ts: str) -> Column:
        return F.col("end_clock") - F.col(ts) > ttl_ns

    left_insert = (F.col("last_queue.kind") == "insert") & lapsed("last_queue.ts_ns")
    left_open = (
        F.col("last_issue.accepted")
        & (F.col("last_issue.seq") > F.coalesce("last_close", F.lit(-1)))
        & lapsed("last_issue.ts_ns")
    )
    left_ambiguous = (
        (F.col("last_touch.seq") > F.coalesce("last_complete", F.lit(-1)))
        & ((F.col("last_touch.kind") == "insert") | ~F.col("last_touch.accepted"))
        & lapsed("last_touch.ts_ns")
    )
    flags = sum((F.coalesce(c, F.lit(False)).cast("long") for c in (left_insert, left_open, left_ambiguous)), F.lit(0))
    return (
        late.withColumn("tail_expired", flags)
        .groupBy("session_id")
        .agg(
            F.sum("issued").alias("issued"),
            F.sum("matched").alias("completed"),
            (F.sum("completions") - F.sum("matched")).alias("uncorrelated"),
            F.sum("replaced").alias("replaced"),
            (F.sum("expired") + F.sum("tail_expired")).alias("expired"),
        )
    )


# ---------------------------------------------------------------------------
# Columns derived from the whole stream, before any filter.


def payload_bytes(operation: str = "operation", size: str = "bytes") -> Column:
    """Storage payload: only reads and writes move data."""
    return F.when(F.col(operation).isin("read", "write"), F.col(size)).otherwise(F.lit(0))


def _ordered_gap(current: Column, previous: Column) -> Column:
    return F.when(current >= previous, current - previous)


def rolling_rate(
    events: DataFrame, gap: str, payload: str, prefix: str, observations: int = 64, shift: int = SHIFT
) -> DataFrame:
    """Payload over the last ``observations`` gaps of a device; null until the window is full and clean."""

    def build(w):
        full = (F.count(F.lit(1)).over(w) == observations) & (F.count(gap).over(w) == observations) & (
            F.count(payload).over(w) == observations
        )
        duration = F.sum(gap).over(w)
        clean = full & (duration > 0)
        return {
            f"{prefix}_payload": F.when(clean, F.sum(payload).over(w)),
            f"{prefix}_duration": F.when(clean, duration),
        }

    return trailing(
        events, DEVICE, ["seq"], observations, build, bucket=seq_bucket(shift=shift), block=max(1 << shift, observations)
    )


def mib_per_second(payload: str, duration: str) -> Column:
    """bytes * 1e9 / ns / 2^20."""
    return F.col(payload).cast("double") * 1e9 / F.col(duration).cast("double") / 1048576.0


def issue_columns(annotated: DataFrame, shift: int = SHIFT) -> DataFrame:
    """Per issue: access pattern, device issue gap and rolling issue bandwidth."""
    issues = annotated.filter(F.col("kind") == "issue").select(
        *KEY, "seq", "ts_ns", "operation", "sector", "sectors", "bytes", "accepted"
    )
    gaps = carry_last(issues, DEVICE, ["seq"], {"prev_ts": F.col("ts_ns")}, bucket=seq_bucket(shift=shift)).drop(BUCKET)
    gaps = gaps.withColumn("issue_gap_ns", _ordered_gap(F.col("ts_ns"), F.col("prev_ts"))).withColumn(
        "payload", payload_bytes()
    )
    rated = rolling_rate(gaps, "issue_gap_ns", "payload", "issue_rate", shift=shift)
    seen = carry_last(
        rated,
        [*DEVICE, "operation"],
        ["seq"],
        {"prev_end": F.col("sector") + F.col("sectors")},
        bucket=seq_bucket(shift=shift),
    )
    access = (
        F.when(F.col("prev_end").isNull(), "unknown")
        .when(F.col("prev_end") == F.col("sector"), "sequential")
        .otherwise("random")
    )
    return seen.withColumn("access_pattern", access).drop(BUCKET, "prev_ts", "prev_end", "payload")


def completion_columns(annotated: DataFrame, shift: int = SHIFT) -> DataFrame:
    """Per completion event, matched or not: device completion gap and rolling bandwidth."""
    done = annotated.filter(F.col("kind") == "complete").select(
        *KEY, "seq", "ts_ns", "status", "matched", "source", "pending_payload_bytes", F.col("cpu").alias("complete_cpu")
    )
    gaps = carry_last(done, DEVICE, ["seq"], {"prev_ts": F.col("ts_ns")}, bucket=seq_bucket(shift=shift)).drop(BUCKET)
    gaps = gaps.withColumn("completion_gap_ns", _ordered_gap(F.col("ts_ns"), F.col("prev_ts")))
    return rolling_rate(gaps, "completion_gap_ns", "pending_payload_bytes", "completion_rate", shift=shift).drop("prev_ts")


def queue_depths(annotated: DataFrame, ttl_ns: int = TTL_NS, shift: int = SHIFT) -> DataFrame:
    """In-flight requests after each block event, per device and over all devices.

    An accepted issue counts until it is consumed, or until the stream clock
    passes its limit; that lapse is placed before the first event at a later clock.
    """
    consumed = annotated.filter("consumes").select(*KEY, F.col("source.seq").alias("seq"))
    ends = annotated.groupBy("session_id").agg(F.max("clock").alias("end_clock"))
    lapses = (
        annotated.filter("accepted")
        .select(*KEY, "seq", "ts_ns")
        .join(consumed, [*KEY, "seq"], "left_anti")
        .join(ends, "session_id")
        .filter(F.col("end_clock") - F.col("ts_ns") > ttl_ns)
        .select(*DEVICE, (F.col("ts_ns") + (ttl_ns + 1)).alias("clock"), F.col("seq").alias("lapse_seq"))
    )
    borders = annotated.groupBy("session_id", seq_bucket(shift=shift).alias("home")).agg(F.min("clock").alias("clock"))
    placed = carry_last(
        borders.select("session_id", "clock", F.lit(None).cast("long").alias("lapse_seq"), "home", F.lit(None).cast("long").alias("major"), F.lit(None).cast("long").alias("minor")).unionByName(
            lapses.select("session_id", "clock", "lapse_seq", F.lit(None).cast("long").alias("home"), "major", "minor")
        ).withColumn("late", F.col("lapse_seq").isNull()).withColumn("tie", F.coalesce("lapse_seq", F.col("home"))),
        ["session_id"],
        ["clock", "late", "tie"],
        {"home_before": F.col("home")},
        bucket=time_bucket("clock", 10_000_000_000),
    ).filter(F.col("lapse_seq").isNotNull())
    steps = annotated.select(
        *DEVICE,
        "clock",
        "seq",
        F.lit(-1).cast("long").alias("lapse_seq"),
        (F.col("accepted").cast("long") - F.col("consumes").cast("long")).alias("delta"),
        seq_bucket(shift=shift).alias(BUCKET),
    ).unionByName(
        placed.select(
            *DEVICE,
            "clock",
            F.lit(-1).cast("long").alias("seq"),
            "lapse_seq",
            F.lit(-1).cast("long").alias("delta"),
            F.col("home_before").alias(BUCKET),
        )
    )
    order = ["clock", "seq", "lapse_seq"]
    per_device = running(steps, DEVICE, order, sums={"device_depth": F.col("delta")})
    overall = running(per_device, ["session_id"], order, sums={"total_depth": F.col("delta")})
    return overall.filter(F.col("seq") >= 0).select("session_id", "seq", "device_depth", "total_depth")


def completed_io(annotated: DataFrame, ttl_ns: int = TTL_NS, shift: int = SHIFT) -> DataFrame:
    """One row per correlated request with every whole-stream column attached."""
    issues = issue_columns(annotated, shift).select(
        "session_id",
        F.col("seq").alias("issue_seq"),
        "issue_gap_ns",
        "issue_rate_payload",
        "issue_rate_duration",
        "access_pattern",
    )
    depth = queue_depths(annotated, ttl_ns, shift)
    at_issue = depth.select(
        "session_id",
        F.col("seq").alias("issue_seq"),
        F.col("device_depth").alias("issue_depth"),
        F.col("total_depth").alias("queue_depth_at_issue"),
    )
    after = depth.select("session_id", "seq", F.col("total_depth").alias("queue_depth_after"))
    done = completion_columns(annotated, shift).filter("matched").withColumn("issue_seq", F.col("source.seq"))
    joined = done.join(issues, ["session_id", "issue_seq"]).join(at_issue, ["session_id", "issue_seq"]).join(
        after, ["session_id", "seq"]
    )
    insert_ts, issue_ts, end_ts = F.col("source.insert_ts"), F.col("source.ts_ns"), F.col("ts_ns")
    return joined.select(
        "session_id",
        "seq",
        "issue_seq",
        "request_id",
        "major",
        "minor",
        insert_ts.alias("insert_ts"),
        issue_ts.alias("issue_ts"),
        end_ts.alias("complete_ts"),
        *[F.col(f"source.{c}").alias(c) for c in _PAYLOAD],
        "status",
        "complete_cpu",
        _ordered_gap(issue_ts, insert_ts).alias("queue_ns"),
        (end_ts - issue_ts).alias("device_ns"),
        F.coalesce(_ordered_gap(end_ts, insert_ts), end_ts - issue_ts).alias("total_ns"),
        F.when(F.col("source.bytes") >= 32768, "large").otherwise("small").alias("size_class"),
        "access_pattern",
        "issue_gap_ns",
        "completion_gap_ns",
        "issue_depth",
        "queue_depth_at_issue",
        "queue_depth_after",
        "issue_rate_payload",
        "issue_rate_duration",
        "completion_rate_payload",
        "completion_rate_duration",
    )
