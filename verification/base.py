"""SQL twins of the derived tables, written only with plain windows and joins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

EV = """
ev AS (
  SELECT event_id, cast(json_extract_string(props, '$.k') AS bigint) AS k, epoch_us(ts) AS us, user_id AS u,
         event_type, cast(round(value * 100) AS bigint) AS cents
  FROM events
),
req AS (
  SELECT event_id, event_id AS request_id, k, us - cents * 100000 - k * 1000000 AS insert_ts,
         us - cents * 100000 AS issue_ts, us AS complete_ts, 8 AS major, u % 4 AS minor,
         CASE WHEN event_type IN ('view', 'click') THEN 'read'
              WHEN event_type IN ('purchase', 'signup') THEN 'write' ELSE 'discard' END AS operation,
         k * 8 AS sector, 8 * (1 + u % 3) AS sectors, (k + 1) * 4096 AS bytes,
         u AS pid, u * 10 + k % 3 AS tid, u % 8 AS cpu, 'user-' || (u % 10) AS comm,
         CASE WHEN event_type = 'error' THEN -5 ELSE 0 END AS status
  FROM ev
)"""

IO = (
    EV
    + """,
swept AS (
  SELECT event_id, phase, minor,
         sum(d) OVER (ORDER BY t, phase, event_id ROWS UNBOUNDED PRECEDING) AS total_depth,
         sum(d) OVER (PARTITION BY minor ORDER BY t, phase, event_id ROWS UNBOUNDED PRECEDING) AS device_depth
  FROM (SELECT event_id, minor, 1 AS phase, issue_ts AS t, 1 AS d FROM req
        UNION ALL SELECT event_id, minor, 2, complete_ts, -1 FROM req)
),
gaps AS (
  SELECT *,
    issue_ts - lag(issue_ts) OVER (PARTITION BY minor ORDER BY issue_ts, event_id) AS issue_gap_ns,
    complete_ts - lag(complete_ts) OVER (PARTITION BY minor ORDER BY complete_ts, event_id) AS completion_gap_ns,
    CASE WHEN operation IN ('read', 'write') THEN bytes ELSE 0 END AS payload,
    lag(sector + sectors) OVER (PARTITION BY minor, operation ORDER BY issue_ts, event_id) AS prev_end
  FROM req
),
rates AS (
  SELECT *,
    CASE WHEN count(*) OVER i = 64 AND count(issue_gap_ns) OVER i = 64 AND sum(issue_gap_ns) OVER i > 0
         THEN sum(payload) OVER i END AS issue_rate_payload,
    CASE WHEN count(*) OVER i = 64 AND count(issue_gap_ns) OVER i = 64 AND sum(issue_gap_ns) OVER i > 0
         THEN sum(issue_gap_ns) OVER i END AS issue_rate_duration,
    CASE WHEN count(*) OVER c = 64 AND count(completion_gap_ns) OVER c = 64 AND sum(completion_gap_ns) OVER c > 0
         THEN sum(payload) OVER c END AS completion_rate_payload,
    CASE WHEN count(*) OVER c = 64 AND count(completion_gap_ns) OVER c = 64 AND sum(completion_gap_ns) OVER c > 0
         THEN sum(completion_gap_ns) OVER c END AS completion_rate_duration
  FROM gaps
  WINDOW i AS (PARTITION BY minor ORDER BY issue_ts, event_id ROWS 63 PRECEDING),
         c AS (PARTITION BY minor ORDER BY complete_ts, event_id ROWS 63 PRECEDING)
),
io AS (
  SELECT r.event_id, r.request_id, r.major, r.minor, r.insert_ts, r.issue_ts, r.complete_ts, r.operation, r.sector, r.sectors,
         r.bytes, r.pid, r.tid, r.cpu, r.comm, r.status, r.k, r.cpu AS complete_cpu,
         r.issue_ts - r.insert_ts AS queue_ns, r.complete_ts - r.issue_ts AS device_ns,
         r.complete_ts - r.insert_ts AS total_ns,
         CASE WHEN r.bytes >= 32768 THEN 'large' ELSE 'small' END AS size_class,
         CASE WHEN r.prev_end IS NULL THEN 'unknown' WHEN r.prev_end = r.sector THEN 'sequential'
              ELSE 'random' END AS access_pattern,
         r.issue_gap_ns, r.completion_gap_ns, a.device_depth AS issue_depth, a.total_depth AS queue_depth_at_issue,
         b.total_depth AS queue_depth_after, r.issue_rate_payload, r.issue_rate_duration,
         r.completion_rate_payload, r.completion_rate_duration
  FROM rates r JOIN swept a ON a.event_id = r.event_id AND a.phase = 1
               JOIN swept b ON b.event_id = r.event_id AND b.phase = 2
)"""
)


def pct(p: int, n: str = "n") -> str:
    return f"greatest(1, ({p} * {n} + 99) // 100)"


@dataclass
class Suite:
    """Queries of one topic; ``add`` registers a function with its SQL (None = rows only)."""

    queries: dict[str, Callable] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None, base: str | None = None):
        def wrap(fn):
            if name in self.queries:
                raise ValueError(f"duplicate query {name}")
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = f"WITH {base}\n{sql}" if base else sql
            return fn

        return wrap
