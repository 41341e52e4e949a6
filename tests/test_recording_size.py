"""Compressed recordings: the same lines and numbers as plain ones, in files of bounded length."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from iotrail.sources import recording
from iotrail.streaming import live
from verification import recordings


def test_compressed_lines_read_like_plain_ones(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(recording, "FILE_LINES", 40)
    text = F.when(F.col("id") % 10 == 0, "").when(F.col("id") % 7 == 0, "not json é").otherwise(F.concat(F.lit('{"record":"event","n":'), "id", F.lit("}")))
    lines = spark.range(0, 300, 1, 3).select(text.alias("value"))
    plain, packed = str(tmp_path / "plain"), str(tmp_path / "packed")
    recording.write_lines(lines, plain)
    recording.write_lines(lines, packed, compress=True)

    read = recording.read_lines(spark, packed)
    assert sorted(r.value for r in read.collect()) == sorted(r.value for r in lines.collect())
    numbers = {}
    for r in read.collect():
        numbers.setdefault(r.session_id, []).append(r.line_no)
    assert len(numbers) >= 8 and all(sorted(n) == list(range(1, len(n) + 1)) and len(n) <= 40 for n in numbers.values())

    def statuses(path, name):
        out = live.run_to_table(live.stream_lines(spark, path).select("status"), str(tmp_path / name), str(tmp_path / f"{name}-checkpoint"))
        return sorted(tuple(r) for r in out.groupBy("status").count().collect())

    assert statuses(plain, "a") == statuses(packed, "b")


def test_derived_recording_is_a_fraction_of_its_text(spark, tmp_path):
    n = F.col("id")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("view", "click", "purchase", "error")]), (n % 4 + 1).cast("int"))
    events = spark.range(2000).select(
        n.alias("event_id"),
        F.timestamp_micros(n * 900_000 + 1_700_000_000_000_000).cast("timestamp_ntz").alias("ts"),
        (n * 7 % 300).alias("user_id"),
        kind.alias("event_type"),
        (n % 90).cast("double").alias("value"),
        F.format_string('{"k": %d}', n % 100).alias("props"),
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    spark.range(40).select(n.alias("doc_id"), F.repeat(F.lit("some words "), 20).alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(5).select(n.cast("int").alias("n_nationkey")).write.parquet(str(tmp_path / "nation.parquet"))
    path = recordings.recording_path(spark, str(tmp_path))
    written = sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path))
    lines, text = spark.read.text(path).agg(F.count(F.lit(1)), F.sum(F.octet_length("value") + 1)).first()
    assert lines > 8000
    assert 2 * written < text
