"""Timing and identity rules of one completed request.

A request observed without a kernel request id carries an ``evidence`` struct
``(record_id, source, clock, issue_ts, pid, tid, cpu, status, timing_confidence)``.
A clock other than 0 cannot be placed on the session's time line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EVIDENCE = "evidence"


def completion_time() -> Column:
    return F.when(F.col(EVIDENCE).isNull() | (F.col(f"{EVIDENCE}.clock") == 0), F.col("complete_ts"))


def _observed(field: str, plain: str) -> Column:
    return F.when(F.col(EVIDENCE).isNull(), F.col(plain)).otherwise(F.col(f"{EVIDENCE}.{field}"))


def issue_time() -> Column:
    return F.when(completion_time().isNotNull(), _observed("issue_ts", "issue_ts"))


def start_time() -> Column:
    return F.when(completion_time().isNotNull(), F.coalesce(F.col("insert_ts"), issue_time(), completion_time()))


def issuer_pid() -> Column:
    return _observed("pid", "pid")


def issuer_tid() -> Column:
    return _observed("tid", "tid")


def issuer_cpu() -> Column:
    return _observed("cpu", "cpu")


def completion_status() -> Column:
    return _observed("status", "status")


def timing_confidence() -> Column:
    return F.coalesce(F.col(f"{EVIDENCE}.timing_confidence"), F.lit("exact"))
