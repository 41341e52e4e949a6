"""Byte-level BPE encoding and decoding by rank files.

A piece of text is merged over a segment tree: each leaf is a byte position and holds
``rank of the pair that starts there * width + position``, so the root is the leftmost pair of
the lowest rank. A merge changes at most three leaves (the merged position, its right neighbour,
which dies, and its live left neighbour), each a logarithmic point update; a piece of n bytes
costs O(n log n) whatever its length. Pieces of like length run side by side: their trees are
the columns of one numpy array and take their next merge together. Long pieces get a tree of
their own.

Text reaches the trees through two memos of fixed size per worker, by blank-separated unit and by
piece, so a frequent piece is merged once. Memos hold results only; forgetting them costs time.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iotrail.llm.common import per_process, pick, slices, texts, tokenizer_file

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

#: Unicode White_Space, as ``\s`` of the split pattern reads it (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"

#: Characters that some libraries count as white; no unit ends after one (fixed values).
MAYBE_WHITE = "\x1c\x1d\x1e\x1f\u180e\u200b\u2060\ufeff"

NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merge_piece(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Token ids of one piece; a piece that is a token itself stays whole."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1
    while size < n:
        size *= 2
    tree = [NONE] * (2 * size)
    rank_of = ranks.get
    for i in range(n - 1):
        rank = rank_of(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank * n + i
    for k in range(size - 1, 0, -1):
        left, right = tree[2 * k], tree[2 * k + 1]
        tree[k] = left if left < right else right
    end = list(range(1, n + 1))  # where the part that starts here ends
    before = list(range(-1, n))  # where the live part to the left starts
    while tree[1] < NONE:
        i = tree[1] % n
        gone = end[i]
        stop = end[i] = end[gone]
        changes = [(gone, NONE)]
        if stop < n:
            before[stop] = i
            last = end[stop]
            rank = rank_of(piece[i:last]) if last - i <= longest else None
            changes.append((i, NONE if rank is None else rank * n + i))
        else:
            changes.append((i, NONE))
        left = before[i]
        if left >= 0:
            rank = rank_of(piece[left:stop]) if stop - left <= longest else None
            changes.append((left, NONE if rank is None else rank * n + left))
        for at, value in changes:
            k = size + at
            if tree[k] == value:
                continue
            tree[k] = value
            while k > 1:
                other = tree[k ^ 1]
                if other < value:
                    value = other
                k >>= 1
                if tree[k] == value:
                    break
                tree[k] = value
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Trees:
    """Merges many pieces at once, one column each."""

    WIDTHS = (4, 8, 16, 32, 64)

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.longest = ranks, max(map(len, ranks))
        pairs = {(ranks[t[:k]] << 32) | ranks[t[k:]]: rank for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as int32 bytes."""
        out: list[bytes] = [b""] * len(pieces)
        open_at: dict[int, list[int]] = {w: [] for w in self.WIDTHS}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = np.int32(whole).tobytes()
            elif len(piece) > self.WIDTHS[-1]:
                out[i] = np.array(merge_piece(piece, self.ranks, self.longest), np.int32).tobytes()
            else:
                open_at[next(w for w in self.WIDTHS if w >= len(piece))].append(i)
        for width, rows in open_at.items():
            for start in range(0, len(rows), 8192):
                part = rows[start : start + 8192]
                for i, ids in zip(part, self._columns([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _columns(self, pieces: list[bytes], width: int) -> list[bytes]:
        n = len(pieces)
        lengths = np.array([len(p) for p in pieces])
        ids = self.of_byte[np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8)].reshape(n, width).T.copy()
        place = np.arange(width)[:, None]
        after, before = np.repeat(place + 1, n, 1), np.repeat(place - 1, n, 1)
        tree = np.full((2 * width, n), NONE)
        rank = self.rank(ids[:-1], ids[1:])
        tree[width:-1] = np.where((place[1:] < lengths) & (rank < NONE), rank * width + place[:-1], NONE)
        for k in range(width - 1, 0, -1):
            np.minimum(tree[2 * k], tree[2 * k + 1], out=tree[k])

        def put(at: np.ndarray, column: np.ndarray, value) -> None:
            k = at + width
            tree[k, column] = value
            while k[0] > 1:
                k = k >> 1
                tree[k, column] = np.minimum(tree[2 * k, column], tree[2 * k + 1, column])

        while len(live := np.flatnonzero(tree[1] < NONE)):
            i, merged = tree[1, live] % width, tree[1, live] // width
            gone = after[i, live]
            stop = after[gone, live]
            ids[i, live], ids[gone, live], after[i, live] = merged, -1, stop
            inner = stop < lengths[live]
            right = np.full(len(live), NONE)
            before[stop[inner], live[inner]] = i[inner]
            rank = self.rank(merged[inner], ids[stop[inner], live[inner]])
            right[inner] = np.where(rank < NONE, rank * width + i[inner], NONE)
            put(gone, live, NONE)
            put(i, live, right)
            left = before[i, live]
            if (has := left >= 0).any():
                left, column = left[has], live[has]
                rank = self.rank(ids[left, column], merged[has])
                put(left, column, np.where(rank < NONE, rank * width + left, NONE))
        kept = ((ids >= 0) & (place < lengths)).T
        flat = ids.T[kept].astype(np.int32).tobytes()
        ends = 4 * np.cumsum(kept.sum(1))
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class Memo:
    """Values by key in two generations of bounded bytes: a full young one becomes the old one, and
    what is asked for again moves back, so frequent keys stay. Long keys are gone with the next question."""

    LONG, ENTRY = 1000, 200  # characters of a long key; bytes of an entry beside its key and value

    def __init__(self, make, size: int):
        self.make, self.size, self.held = make, size, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.long: list[str] = []

    def get(self, keys: set[str]) -> dict[str, bytes]:
        """A mapping that holds every key of the set, until the next call."""
        for k in self.long:
            del self.young[k]
        self.long = []
        new = keys - self.young.keys()
        if not new:
            return self.young
        again = new & self.old.keys()
        ask = list(new - again)
        found = dict(zip(ask, self.make(ask), strict=True))
        found.update((k, self.old[k]) for k in again)
        self.long = [k for k in ask if len(k) > self.LONG]
        grown = self._bytes(found) - (self._bytes({k: found[k] for k in self.long}) if self.long else 0)
        if self.held + grown > self.size:
            self.old, self.young = self.young, {k: v for k in keys if (v := self.young.get(k)) is not None}
            self.held = self._bytes(self.young)
        self.young.update(found)
        self.held += grown
        if self.held <= self.size:
            return self.young
        whole, self.young, self.held, self.long = self.young, {}, 0, []
        return whole

    def _bytes(self, entries: dict[str, bytes]) -> int:
        return self.ENTRY * len(entries) + sum(map(len, entries)) + sum(map(len, entries.values()))


class Encoder:
    """Encodes texts unit by unit; ``merge`` gives the ids of a list of pieces, which are what ``pattern`` splits
    units into, or the units themselves where it splits on its own (no pattern)."""

    def __init__(self, merge, pattern: str | None = None, units: int = 40 << 20, pieces: int = 40 << 20):
        if pattern is None:
            self.units = UnitTexts(merge, units)
            return
        self.split = regex.compile(pattern.replace(r"\s", "<W>").replace("[^<W>", f"[^{WHITE}").replace("<W>", f"[{WHITE}]").replace(r"(?!\S)", f"(?![^{WHITE}])"))
        self.pieces = Memo(merge, pieces)
        self.units = UnitTexts(self._units, units)

    @classmethod
    def of_ranks(cls, ranks: dict[bytes, int], pattern: str, **sizes: int) -> Encoder:
        """Merges over segment trees, without special tokens."""
        trees = Trees(ranks)
        return cls(lambda pieces: trees.merge([p.encode() for p in pieces]), pattern, **sizes)

    def _units(self, units: list[str]) -> list[bytes]:
        split = [self.split.findall(unit) for unit in units]
        ids = self.pieces.get({p for x in split for p in x})
        return [b"".join([ids[p] for p in x]) for x in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as int32 bytes."""
        collecting = gc.isenabled()
        gc.disable()  # nothing here makes cycles; scanning the memos for them takes a third of the time
        try:
            return self.units.encode(texts)
        finally:
            if collecting:
                gc.enable()


class UnitTexts:
    """Encodes texts by units that end before a blank after a visible character: no match of a
    byte-level split pattern spans such a place. ``make`` encodes a list of units."""

    def __init__(self, make, size: int, block: int = 1 << 21):
        self.spaced = Memo(lambda keys: make([" " + k for k in keys]), size)
        self.plain = Memo(make, size)
        white = WHITE + MAYBE_WHITE
        self.cut = regex.compile(f"(?<=[^{white}])(?= )")
        self.other_white, self.block = white.replace(" ", ""), block

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        start = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= self.block or i + 1 == len(texts):
                out += self._block(texts[start : i + 1])
                start, size = i + 1, 0
        return out

    def _block(self, texts: list[str]) -> list[bytes]:
        split, plain, spaced = [], set(), set()
        for text in texts:
            units = text.split(" ")
            doubled = "" in units[1:-1] or (len(units) > 1 and not units[0])
            if doubled or any(w in text and any(x[:1] == " " for x in text.split(w)[1:]) for w in self.other_white):
                at = [0, *(m.start() for m in self.cut.finditer(text)), len(text)]
                units = [text[a:b] for a, b in zip(at, at[1:])]
                plain.update(units)
                split.append((units, None))
            else:
                plain.add(units[0])
                rest = units[1:]
                spaced.update(rest)
                split.append((units[:1], rest))
        plain_ids, spaced_ids = self.plain.get(plain).__getitem__, self.spaced.get(spaced).__getitem__
        return [b"".join(map(plain_ids, first)) + b"".join(map(spaced_ids, rest or ())) for first, rest in split]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(doc_id, ids)``: token ids of each whole text, one row per row of ``df``.

    A null or empty text has an empty list, repeated rows repeat, a null id stays null, and an empty
    table gives an empty one. Other columns are not read, so their names cannot clash.
    """
    import public_tokenizers

    path, pattern = vocabulary or tokenizer_file(VOCABULARY), pattern or public_tokenizers.PATTERN
    rows = pick(df, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_process(("encoder", path, pattern), lambda: Encoder.of_ranks(load_ranks(path), pattern))
        for batch in slices(batches):
            parts = encoder.encode(texts(batch.column(1)))
            offsets = np.zeros(len(parts) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in parts], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, ids, decoded)``: the bytes that the ids stand for. A null list decodes to no bytes."""
    path = vocabulary or tokenizer_file(VOCABULARY)
    rows = pick(df, doc_id=id_col, ids=ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: list[bytes] = []
        for batch in slices(batches):
            if not tokens:
                ranks = load_ranks(path)
                tokens = [b""] * (1 + max(ranks.values()))
                for token, rank in ranks.items():
                    tokens[rank] = token
            at = tokens.__getitem__
            decoded = [b"" if x is None else b"".join(map(at, x)) for x in (None if v is None else v.values.to_numpy().tolist() for v in batch.column(1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    """Round trip of every document: encode, then decode the ids, with digests of both."""
    from iotrail.llm.common import table

    rows = decode(encode(table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
