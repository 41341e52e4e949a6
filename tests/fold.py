"""Literal one-event-at-a-time twins of the distributed operators, for tests only."""


def correlate(events, ttl):
    """events: (kind, ts, key, device) in stream order -> matched pairs, counters and depths."""
    inserted, pending, ambiguous = {}, {}, {}
    matched, depth_at_issue, depth_after, device_depth = [], {}, {}, {}
    uncorrelated = replaced = expired = 0
    for i, (kind, ts, key, device) in enumerate(events):
        for table, stamp in ((inserted, lambda v: v[0]), (pending, lambda v: v[0]), (ambiguous, lambda v: v)):
            for k in [k for k, v in table.items() if ts - stamp(v) > ttl]:
                del table[k]
                expired += 1
        k = (key, device)
        if kind == "insert":
            if k in inserted:
                replaced += 1
                ambiguous[k] = ts
            inserted[k] = (ts, i)
        elif kind == "issue":
            ins = inserted.pop(k, None)
            removed = pending.pop(k, None) is not None
            if removed or k in ambiguous:
                replaced += 1
                ambiguous[k] = ts
            else:
                pending[k] = (ts, i, ins)
                depth_at_issue[i] = len(pending)
                device_depth[i] = sum(1 for p in pending if p[1] == device)
        else:
            if k in ambiguous:
                del ambiguous[k]
                uncorrelated += 1
                continue
            p = pending.pop(k, None)
            if p is None or ts < p[0]:
                uncorrelated += 1
                continue
            matched.append((i, p[1], p[2][0] if p[2] else None))
            depth_after[i] = len(pending)
    return {
        "matched": matched,
        "uncorrelated": uncorrelated,
        "replaced": replaced,
        "expired": expired,
        "depth_at_issue": depth_at_issue,
        "device_depth": device_depth,
        "depth_after": depth_after,
    }
