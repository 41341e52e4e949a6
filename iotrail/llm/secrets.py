"""Secret scan: base patterns by regular expression, encoded material only when its structure holds.

Base kinds are ``assign``, ``access`` and ``hex``. Structural kinds are reported only when the decoded
bytes parse: ``der`` (base64 or hex of a DER SEQUENCE whose nested lengths add up and whose content is a
key: version integer, algorithm identifier or key integers), ``ssh`` (length-prefixed public key
blob or the OpenSSH private key container) and ``jwt`` (a signed token: header and claims are JSON objects, the
header names an algorithm, and the signature decodes). A random run of letters fails these tests.
Candidates begin wherever an encoding can begin, inside a longer run too, and go over line breaks, written as such or
as ``\\n``; a candidate that fails takes nothing away from the positions behind its first.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iotrail.llm.common import pick, slices, table, texts

#: Base patterns and shortest lengths (fixed values).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
BASE = ("assign", "access", "hex")

#: Runs that may be encoded keys; a key of any kind in use takes more than 40 characters.
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
WRAPPED_RUN = re.compile(r"-----BEGIN [A-Z0-9 ]{1,40}-----(?:\s|\\+[nrt])*((?:[A-Za-z0-9+/=\s]|\\+[nrt])+?)(?:\s|\\+[nrt])*-----END ")
HEX_RUN = re.compile(r"[0-9A-Fa-f]{64,}")
DOTTED_RUN = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+){2,}")
#: Bytes of the longest key that is sought within a longer run or over line breaks; a run that is a key as a whole has no limit.
KEY_BYTES = 1 << 16

#: Where an encoding can begin: a DER SEQUENCE, a public key blob (length and first two letters of its type), the OpenSSH
#: container, JSON. Look-ahead, so every position is tried.
BASE64_START = re.compile(r"(?=M[A-P][A-Za-z0-9+/_-]{6}|AAAA[A-P](?:[HXn3]N[zr]|[GWm2]Vj)|b3BlbnNzaC1rZXktdjEA)")
HEX_START = re.compile(r"(?=30[0-9A-Fa-f]{14}|000000[0-9A-Fa-f]{2}(?:7373682[dD]|65636473|736[bB]2[dD])|6[fF]70656[eE]7373682[dD]6[bB]65792[dD]763100)")
JSON_START = re.compile(r"(?=e[wy])")
BASE64_LINE, HEX_LINE = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"[0-9A-Fa-f]+")
BREAK = re.compile(r"[\x20\t]*(?:(?:\r?\n|\\+[nr])[\x20\t]*)+")
#: Fields of a public key blob by type; blobs of other types must fill their run.
SSH_FIELDS = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2, b"ssh-ed448": 2, b"ecdsa-sha2-nistp256": 3, b"ecdsa-sha2-nistp384": 3, b"ecdsa-sha2-nistp521": 3, b"sk-ssh-ed25519@openssh.com": 3, b"sk-ecdsa-sha2-nistp256@openssh.com": 4}


def _length(data: bytes, at: int) -> tuple[int, int] | None:
    """``(content start, content end)`` of the DER element at ``at``, or None if its length is not canonical or overruns."""
    if at + 2 > len(data):
        return None
    first = data[at + 1]
    if first < 0x80:
        start, size = at + 2, first
    else:
        count = first & 0x7F
        if not 1 <= count <= 4 or at + 2 + count > len(data):
            return None
        size = int.from_bytes(data[at + 2 : at + 2 + count], "big")
        if size < 0x80 or size >> (8 * (count - 1)) == 0:
            return None
        start = at + 2 + count
    return (start, start + size) if start + size <= len(data) else None


def der_elements(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """``(tag, start, end)`` of the elements that fill ``start..end`` exactly."""
    found, at = [], start
    while at < end:
        span = _length(data[:end], at)
        if span is None:
            return None
        found.append((data[at], *span))
        at = span[1]
    return found


def nested(data: bytes, start: int, end: int, depth: int = 0) -> bool:
    """Whether every constructed element below is filled exactly by its own elements."""
    parts = der_elements(data, start, end)
    if parts is None or depth > 16:
        return False
    return all(nested(data, a, b, depth + 1) for tag, a, b in parts if tag & 0x20)


def is_der_key(data: bytes) -> bool:
    """A SEQUENCE over the whole of ``data`` that has the shape of a private or public key."""
    if len(data) < 24 or data[0] != 0x30:
        return False
    span = _length(data, 0)
    if span is None or span[1] != len(data) or not nested(data, *span):
        return False
    tags = [tag for tag, _, _ in der_elements(data, *span)]
    private = tags[:1] == [0x02] and (tags[1:3] == [0x30, 0x04] or tags[1:2] == [0x04] or (len(tags) >= 6 and set(tags) == {0x02}))
    encrypted_or_public = tags in ([0x30, 0x04], [0x30, 0x03])
    if encrypted_or_public or tags[1:3] == [0x30, 0x04]:
        algorithm = next(x for x in der_elements(data, *span) if x[0] == 0x30)
        inner = der_elements(data, algorithm[1], algorithm[2])
        return bool(inner) and inner[0][0] == 0x06
    return private


def is_ssh_key(data: bytes) -> bool:
    """The OpenSSH private key container, or length-prefixed fields that fill ``data`` and begin with a key type."""
    if data.startswith(b"openssh-key-v1\0"):
        return len(data) > 40
    at, fields = 0, []
    while at + 4 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        if at + 4 + size > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return at == len(data) and len(fields) >= 2 and fields[0].startswith((b"ssh-", b"ecdsa-sha2-", b"sk-"))


def unpadded(run: str) -> bytes | None:
    """Bytes of a base64 run in either alphabet, None if it is not one."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None


def der_size(head: bytes) -> int | None:
    """Bytes of the SEQUENCE that begins with ``head``; None if its length is not canonical or no integer or sequence follows."""
    if len(head) < 6 or head[0] != 0x30:
        return None
    count = head[1] & 0x7F if head[1] >= 0x80 else 0
    size = int.from_bytes(head[2 : 2 + count], "big") if count else head[1]
    if count > 4 or head[1] == 0x80 or (count and (size < 0x80 or size >> (8 * (count - 1)) == 0)):
        return None
    return 2 + count + size if 2 + count >= len(head) or head[2 + count] in (0x02, 0x30) else None


def ssh_size(data: bytes) -> tuple[int | None, int | None]:
    """``(bytes, None)`` of the key container or public key blob that ``data`` begins with.

    ``(None, bytes)`` asks for so many bytes to go on, ``(None, None)`` says that the type is not listed.
    """
    at, left, nested_keys = (15, 3, True) if data.startswith(b"openssh-key-v1\0") else (0, 1, False)
    first = None
    while left:
        if at + 4 > len(data):
            return None, at + 4
        (size,) = struct.unpack_from(">I", data, at)
        if at + 4 + size > len(data):
            return None, at + 4 + size
        first = data[at + 4 : at + 4 + size] if first is None else first
        at, left = at + 4 + size, left - 1
        if not left and nested_keys:  # as many public keys, and the private part
            if at + 4 > len(data):
                return None, at + 4
            left, nested_keys = struct.unpack_from(">I", data, at)[0] + 1, False
            at += 4
        elif not left and at == 4 + len(first) and not data.startswith(b"openssh"):
            left = SSH_FIELDS.get(first, 0) - 1
            if left < 0:
                return None, None
    return at, None


def sized_key(text: str, at: int, line: re.Pattern, per_byte: tuple[int, int], decode) -> tuple[int, str, int] | None:
    """``(bytes, encoding, end)`` of the key at ``at``, read only as far as its length fields say."""
    chars, size_of = per_byte
    want = 66
    while True:
        run, end = _walk(text, at, line, -(-want * chars // size_of))
        data = decode(run[: len(run) // chars * chars]) or b""
        size, more = ssh_size(data)
        if size is not None:
            return size, *_walk(text, at, line, -(-size * chars // size_of))
        if more is None or more <= want and len(data) < want or more > KEY_BYTES or more * chars > (len(text) - at) * size_of:
            return None
        want = max(2 * want, more)


def fills_run(text: str, at: int, end: int, per_byte: tuple[int, int], decode, known: dict) -> bool:
    """Whether length-prefixed fields from ``at`` end with the run. ``known`` holds places of the run already followed."""
    chars, size_of = per_byte
    total, b, seen = (end - at) * size_of // chars, 0, []
    if size_of == 3 and (end - at) % 4 == 1:
        return False
    while True:
        key = (at % chars, at // chars * size_of + b)
        if b == total or key in known:
            result = b == total or known[key]
            break
        c = at + b // size_of * chars
        piece = decode(text[c : min(end, c + 4 * chars)]) or b""
        size = int.from_bytes(piece[b % size_of : b % size_of + 4], "big")
        seen.append(key)
        if b + 4 > total or b + 4 + size > total:
            result = False
            break
        b += 4 + size
    known.update(dict.fromkeys(seen, result))
    return result


def _walk(text: str, at: int, line: re.Pattern, most: int) -> tuple[str, int]:
    """At most ``most`` characters of the encoding from ``at``, over line breaks, and where they end."""
    parts, end = [], at
    while most:
        m = line.match(text, at, min(len(text), at + most))
        if m is None:
            break
        parts.append(m[0])
        end, most = m.end(), most - len(m[0])
        gap = BREAK.match(text, end)
        if gap is None:
            break
        at = gap.end()
    return "".join(parts), end


def encoded_keys(text: str, start: re.Pattern, line: re.Pattern, per_byte: tuple[int, int], decode) -> list[tuple[int, int, str]]:
    """Keys that begin at a match of ``start``; ``per_byte`` characters to bytes. The next candidate is sought behind a found key."""
    chars, size_of = per_byte
    found, behind = [], 0
    run_end, known = 0, {}
    for m in start.finditer(text):
        at = m.start()
        if at < behind:
            continue
        head = text[at : at + 16]
        if head[0] in "M3":
            size = der_size(decode(head[: 8 * chars // 4 if size_of == 3 else 16]) or b"")
            need = None if size is None else -(-size * chars // size_of)
            if need is None or size > KEY_BYTES or at + need > len(text):
                continue
            run, end = _walk(text, at, line, need)
            if len(run) < need or not (data := decode(run)) or not is_der_key(data):
                continue
            kind = "der"
        else:
            front = decode(text[at : at + 10 * chars // size_of // chars * chars]) or b""
            if not front.startswith(b"openssh-") and not front[4:].startswith((b"ssh-", b"ecds", b"sk-")):
                continue
            key = sized_key(text, at, line, per_byte, decode)
            if key is None:  # unlisted types end with their run, which is one line
                if at >= run_end:
                    run_end, known = line.match(text, at).end(), {}
                container = front.startswith(b"openssh-")
                if not container and not fills_run(text, at, run_end, per_byte, decode, known):
                    continue
                run, end = text[at:run_end], run_end
                data = decode(run)
                if not data or not is_ssh_key(data):
                    continue
            else:
                size, run, end = key
                need = -(-size * chars // size_of)
                data = decode(run)
                if len(run) < need or not data or not is_ssh_key(data[:size]):
                    continue
            kind = "ssh"
        if size_of == 3:
            pad = -len(run) % 4
            end += len(text[end : end + pad]) - len(text[end : end + pad].lstrip("="))
        found.append((at, end, kind))
        behind = end
    return found


def signed_tokens(text: str) -> list[tuple[int, int, str]]:
    """Tokens of three neighbouring parts of a dotted run; a header may begin inside its part."""
    found = []
    for m in DOTTED_RUN.finditer(text):
        at, parts = m.start(), m[0].split(".")
        starts = [at]
        for p in parts:
            starts.append(starts[-1] + len(p) + 1)
        k = 0
        while k + 2 < len(parts):
            header, claims, signature = parts[k : k + 3]
            signature = signature[:-1] if len(signature) % 4 == 1 else signature
            step = 1
            if len(header) >= 8 and len(claims) >= 2 and len(signature) >= 16 and _is_json(claims):
                own = token_header(header)
                if own is not None and unpadded(signature) is not None:
                    found.append((starts[k] + own, starts[k + 2] + len(signature), "jwt"))
                    step = 3
            k += step
    return found


def token_header(part: str) -> int | None:
    """First place from which ``part`` is the JSON object of a token header. The four alignments are decoded once each."""
    decoder, decoded = json.JSONDecoder(), {}
    for own in [0, *(x.start() for x in JSON_START.finditer(part) if x.start())]:
        turn = own % 4
        if turn not in decoded:
            raw = unpadded(part[turn:])
            decoded[turn] = None if raw is None else raw.decode("utf-8", "surrogateescape") if raw.isascii() else raw
        whole = decoded[turn]
        if whole is None:
            continue
        at = (own - turn) // 4 * 3
        try:
            if isinstance(whole, str):
                head, end = decoder.raw_decode(whole, at)
                whole_used = not whole[end:].strip()
            else:
                head, whole_used = json.loads(whole[at:]), True
        except (ValueError, UnicodeDecodeError, RecursionError):
            continue
        if whole_used and isinstance(head, dict) and isinstance(head.get("alg"), str):
            return own
    return None


def is_signed_token(run: str) -> bool:
    """Header and claims are JSON objects, the header names an algorithm, the signature decodes."""
    header, claims, signature = run.split(".")
    return token_header(header) == 0 and _is_json(claims) and unpadded(signature) is not None


def _is_json(part: str) -> bool:
    try:
        return isinstance(json.loads(unpadded(part) or b""), dict)
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False


def _hex(run: str) -> bytes | None:
    try:
        return bytes.fromhex(run[: len(run) // 2 * 2])
    except ValueError:
        return None


def overlaps(span: tuple[int, int, str], spans: list[tuple[int, int, str]]) -> bool:
    return any(a < span[1] and span[0] < b for a, b, _ in spans)


def scan(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of every secret, by start, then kind as listed, base kinds first."""
    found: list[tuple[int, int, str]] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    wrapped = "-----BEGIN " in text
    if text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text)] if "AKIA" in text else []
        found += [(*m.span(), "hex") for m in HEX.finditer(text)]
        keys, whole = encoded_keys(text, BASE64_START, BASE64_LINE, (4, 3), unpadded), []
        keys += [x for x in encoded_keys(text, HEX_START, HEX_LINE, (2, 1), _hex) if not overlaps(x, keys)]
        for m in BASE64_RUN.finditer(text):
            if kind := _key_kind(unpadded(m[0])):
                whole.append((*m.span(), kind))
        for m in HEX_RUN.finditer(text):
            if len(m[0]) % 2 == 0 and (kind := _key_kind(bytes.fromhex(m[0]))):
                whole.append((*m.span(), kind))
        if wrapped:
            for m in WRAPPED_RUN.finditer(text):
                kind = _key_kind(unpadded(re.sub(r"\s|\\+[nrt]", "", m[1])))
                if kind:
                    whole.append((*m.span(1), kind))
        for x in whole:  # whole runs whose structure has no listed begin
            if not overlaps(x, keys):
                keys.append(x)
        found += keys
        found += signed_tokens(text) if "." in text else []
    order = {k: i for i, k in enumerate((*BASE, "der", "ssh", "jwt"))}
    return sorted(found, key=lambda x: (x[0], order[x[2]], x[1]))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans)``: spans of each whole text as an array of (kind, start, end), one row per row of ``df``.

    Null and empty texts have an empty array, repeated rows repeat, an empty table gives no rows. Other
    columns are not read.
    """
    rows = pick(df, doc_id=id_col, text=text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = [[{"kind": k, "start": a, "end": b} for a, b, k in scan(text)] for text in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each span replaced by ``[kind]``; overlapping spans become one, named by the first."""
    out, last = [], 0
    for start, end, kind in spans:
        if start >= last:
            out.append(text[last:start] + f"[{kind}]")
        last = max(last, end)
    return "".join(out) + text[last:]


def redact_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with secrets replaced; a null text stays null, other columns pass through."""
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            clean = [None if x is None else redact(x, scan(x)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(clean, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns)], names)

    return docs.mapInArrow(run, docs.schema)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = joined(F.filter("spans", lambda x: x["kind"].isin(*BASE)))
    return rows.select("doc_id", *[count(k) for k in BASE], F.sha2(base, 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
