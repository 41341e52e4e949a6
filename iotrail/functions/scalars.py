"""Scalar helpers shared by the analyses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def checked_sub(a, b) -> Column:
    """a - b, null when it would be negative."""
    return F.when(_c(a) >= _c(b), _c(a) - _c(b))


def at_least_zero(value) -> Column:
    """max(value, 0) that keeps an unmeasured value unmeasured (``greatest`` alone skips nulls)."""
    v = _c(value)
    return F.when(v.isNotNull(), F.greatest(v, F.lit(0).cast("long")))


def saturating_sub(a, b) -> Column:
    return at_least_zero(_c(a) - _c(b))


def inode_label(major, minor, inode) -> Column:
    return F.format_string("<inode %d:%d:%d>", _c(major), _c(minor), _c(inode))


def identity_number(value) -> Column:
    return F.coalesce(_c(value).cast("string"), F.lit("unavailable"))


def issuer_label(pid, tid, comm) -> Column:
    return F.concat(_c(comm), F.lit(" · PID "), identity_number(pid), F.lit(" / TID "), identity_number(tid))


def device_label(major="major", minor="minor") -> Column:
    return F.concat(_c(major).cast("string"), F.lit(":"), _c(minor).cast("string"))


def process_label() -> Column:
    return F.concat(device_label(), F.lit(" / "), F.col("comm"), F.lit(" · PID "), identity_number("pid"))


def contains_ignore_case(text, needle: str) -> Column:
    return F.contains(F.lower(_c(text)), F.lit(needle.lower()))


def path_deleted(path) -> Column:
    return F.endswith(_c(path), F.lit(" (deleted)"))


def trace_device(encoded) -> tuple[Column, Column]:
    """Major and minor of a userspace-encoded device number in a decoded trace."""
    e = _c(encoded)
    major = F.shiftright(e, 8).bitwiseAND(0xFFF).bitwiseOR(F.shiftright(e, 32).bitwiseAND(0xFFFFF000))
    minor = e.bitwiseAND(0xFF).bitwiseOR(F.shiftright(e, 12).bitwiseAND(0xFFFFFF00))
    return major, minor


def kernel_device(encoded) -> tuple[Column, Column]:
    """Major and minor of a kernel-internal device number (20-bit minor)."""
    e = _c(encoded)
    return F.shiftright(e, 20), e.bitwiseAND(0xFFFFF)


def operation_of_rwbs(rwbs) -> Column:
    """Operation of a block-trace flag string by its first letter."""
    first = F.substring(_c(rwbs), 1, 1)
    return (
        F.when(first == "R", "read").when(first == "W", "write").when(first == "F", "flush").when(first == "D", "discard").otherwise("other")
    )


def ranges_overlap(a_sector, a_sectors, b_sector, b_sectors) -> Column:
    """Half-open sector overlap; a range of unknown length overlaps only its own first sector."""
    s1, n1, s2, n2 = map(_c, (a_sector, a_sectors, b_sector, b_sectors))
    return F.when((n1 == 0) | (n2 == 0), s1 == s2).otherwise((s1 < s2 + n2) & (s2 < s1 + n1))


def file_mode(flags) -> Column:
    """direct / sync / buffered from open(2) flags."""
    f = _c(flags)
    # O_DIRECT and O_SYNC|O_DSYNC on this platform.
    direct, sync = 0o200000, 0o4010000
    return F.when(f.bitwiseAND(direct) != 0, "direct").when(f.bitwiseAND(sync) != 0, "sync").otherwise("buffered")


def ratio_percent(part, total) -> Column:
    return F.when(_c(total) == 0, F.lit(0.0)).otherwise(_c(part) * 100.0 / _c(total))


def relative_delta_percent(baseline, current) -> Column:
    return F.when(_c(baseline) != 0, (_c(current) - _c(baseline)) * 100.0 / _c(baseline))


def coverage_label(count, total) -> Column:
    """Percent with one decimal that never rounds a partial share to 0 or 100."""
    n, t = _c(count), _c(total)
    pct = n * 100.0 / t
    shown = F.format_string("%.1f%%", pct)
    return (
        F.when(t == 0, "N/A")
        .when(n == 0, "0%")
        .when(n == t, "100%")
        .when(pct < 0.1, "<0.1%")
        .when(pct > 99.9, ">99.9%")
        .otherwise(shown)
    )


def opaque_key(salt: str, value) -> Column:
    """Stable salted pseudonym of a kernel identifier."""
    return F.xxhash64(F.lit(salt), _c(value))


def signed_id(value) -> Column:
    """Unsigned 64-bit id held as decimal(20,0) -> signed long with the same bits."""
    v = _c(value).cast("decimal(20,0)")
    wrap = F.lit("18446744073709551616").cast("decimal(20,0)")
    limit = F.lit("9223372036854775808").cast("decimal(20,0)")
    return F.when(v >= limit, (v - wrap)).otherwise(v).cast("long")


def unsigned_id(value) -> Column:
    """Signed long -> unsigned decimal, for export."""
    v = _c(value).cast("decimal(20,0)")
    wrap = F.lit("18446744073709551616").cast("decimal(20,0)")
    return F.when(v < 0, v + wrap).otherwise(v).cast("decimal(20,0)")


# Fixed value: constant mixed into every derived identifier.
_ID_MIX = -7046029254386353131


def rotate_left(value: Column, bits: int) -> Column:
    return F.shiftleft(value, bits).bitwiseOR(F.shiftrightunsigned(value, 64 - bits))


def synthetic_id(tag: int | Column, key) -> Column:
    """Identifier of a derived node or edge, shared with producers whose edges point at it.

    Producers use tags of one byte; a wider tag keeps its upper part apart, so no two tags of a request meet.
    """
    tag_col = F.lit(tag).cast("long") if isinstance(tag, int) else tag.cast("long")
    wide = F.shiftleft(F.shiftright(tag_col, 8), 24)
    return rotate_left(_c(key), 17).bitwiseXOR(F.shiftleft(tag_col, 56)).bitwiseXOR(wide).bitwiseXOR(F.lit(_ID_MIX))


# Tags of derived identifiers.
NODE_FILE, NODE_QUEUE, NODE_REQUEST, NODE_ORIGIN = 1, 8, 9, 10
EDGE_QUEUE, EDGE_FILE, EDGE_ORIGIN = 18, 19, 20
NODE_SPAN_BASE, EDGE_SPAN_BASE, EDGE_UPPER, EDGE_LOWER = 32, 64, 90, 91


def span_tag(base: int, index: Column, last: int) -> Column:
    """Tag of the span at a position: one byte up to ``last``, beyond it a wide tag that no other derived id has."""
    return F.when(index + base <= last, index + base).otherwise(index + 256)


def origin_node_id(request_id, origin_id) -> Column:
    return synthetic_id(NODE_ORIGIN, _c(request_id).bitwiseXOR(rotate_left(_c(origin_id), 7)))


def origin_edge_id(request_id, origin_id) -> Column:
    return synthetic_id(EDGE_ORIGIN, _c(request_id).bitwiseXOR(rotate_left(_c(origin_id), 13)))


def redact_paths(text) -> Column:
    """Replace words that look like file paths, over the whole text; whitespace is collapsed."""
    words = F.filter(F.split(_c(text), r"\s+"), lambda w: w != "")

    def path_like(w: Column) -> Column:
        drive = (F.substring(w, 2, 1) == ":") & (F.contains(w, F.lit("\\")) | F.contains(w, F.lit("/")))
        return F.contains(w, F.lit("/data/")) | F.contains(w, F.lit("/storage/")) | F.startswith(w, F.lit("/")) | drive

    # Fixed value: the replacement marker.
    return F.array_join(F.transform(words, lambda w: F.when(path_like(w), F.lit("<redacted-path>")).otherwise(w)), " ")
