"""Token ids in seekable files: independent zstandard frames, a trailing seek table, checksums.

File layout (all integers little-endian): zstandard frames, each with the ids (unsigned 32-bit) of
whole consecutive documents; a skippable frame with the document index (zstandard over: count,
id-present bytes, ids as signed 64-bit, token counts and frame numbers as unsigned 32-bit); a
skippable frame with the seek table of the public zstandard seekable format: per frame its stored
size, its raw size and the low 32 bits of the raw bytes' XXH64. A reader takes the two tables from
the end of the file and then only the frames it needs; each frame is checked when it is opened.

``write`` deals documents by ranges of the id, one file a task. A task writes under a name of its
own attempt and renames at the end, so a repeated task replaces its file by an equal one. The
table of documents (file, frame, id) is written as Parquet beside the files.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from iotrail.llm.bpe import Encoder
from iotrail.llm.common import fresh_folder, per_process, slices, table, texts, tokenizer_file

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
FRAME_IDS = 65_536

#: Numbers of the zstandard frame formats (fixed values).
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80

INDEX_SCHEMA = "shard int, file string, frame int, place long, doc_id long, n_tokens long"


def open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


class FrameWriter:
    """Writes documents to one file; ``close`` adds the tables."""

    def __init__(self, out, frame_ids: int = FRAME_IDS):
        self.out, self.frame_ids = out, frame_ids
        self.frames: list[tuple[int, int, int]] = []
        self.pending: list[bytes] = []
        self.size = 0
        self.docs: list[tuple[int | None, int, int]] = []
        self.pack = zstandard.ZstdCompressor(level=3)

    def add(self, doc_id: int | None, ids: bytes) -> int:
        """Number of the frame that the document goes to."""
        frame = len(self.frames)
        self.docs.append((doc_id, len(ids) // 4, frame))
        self.pending.append(ids)
        self.size += len(ids)
        if self.size >= 4 * self.frame_ids:
            self.flush()
        return frame

    def flush(self) -> None:
        if self.pending:
            raw = b"".join(self.pending)
            stored = self.pack.compress(raw)
            self.out.write(stored)
            self.frames.append((len(stored), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.pending, self.size = [], 0

    def close(self) -> None:
        self.flush()
        ids = np.array([x or 0 for x, _, _ in self.docs], "<i8")
        parts = [struct.pack("<Q", len(self.docs)), bytes(x is not None for x, _, _ in self.docs), ids.tobytes()]
        parts += [np.array([x[k] for x in self.docs], "<u4").tobytes() for k in (1, 2)]
        index = self.pack.compress(b"".join(parts))
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        seek = b"".join(struct.pack("<III", *x) for x in [*self.frames, (len(index) + 8, 0, xxhash.xxh64_intdigest(index) & 0xFFFFFFFF)])
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(seek) + 9) + seek + struct.pack("<IBI", len(self.frames) + 1, CHECKSUMS, SEEK_MAGIC))


class FrameReader:
    """Reads one file: the tables first, then single frames on request."""

    def __init__(self, source):
        self.source = source
        source.seek(source.size() - 9)
        count, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC or flags != CHECKSUMS:
            raise ValueError("not a token file")
        source.seek(source.size() - 9 - 12 * count)
        entries = np.frombuffer(source.read(12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        self.frames, (stored, _, check) = entries[:-1], entries[-1]
        self.starts = np.concatenate([[0], np.cumsum(entries[:, 0])])
        source.seek(int(self.starts[-2]) + 8)
        index = source.read(int(stored) - 8)
        if xxhash.xxh64_intdigest(index) & 0xFFFFFFFF != check:
            raise ValueError("the document index is damaged")
        raw = zstandard.ZstdDecompressor().decompress(index)
        (n,) = struct.unpack_from("<Q", raw)
        self.present = np.frombuffer(raw, np.uint8, n, 8)
        self.ids = np.frombuffer(raw, "<i8", n, 8 + n)
        self.counts = np.frombuffer(raw, "<u4", n, 8 + 9 * n)
        self.frame_of = np.frombuffer(raw, "<u4", n, 8 + 13 * n)

    def frame(self, k: int) -> bytes:
        """Raw ids of frame ``k``, checked."""
        stored, size, check = (int(x) for x in self.frames[k])
        self.source.seek(int(self.starts[k]))
        raw = zstandard.ZstdDecompressor().decompress(self.source.read(stored))
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int, bytes]]:
        """``(place in the file, ids)`` of all documents or of the wanted places; opens only their frames."""
        places = np.arange(len(self.ids)) if wanted is None else np.array(sorted(wanted), np.int64)
        sizes = 4 * self.counts.astype(np.int64)
        frame, raw = -1, b""
        ends = np.cumsum(sizes)
        first = np.concatenate([[0], np.cumsum(self.frames[:, 1])])
        for place in places.tolist():
            if self.frame_of[place] != frame:
                frame = int(self.frame_of[place])
                raw = self.frame(frame)
            stop = int(ends[place] - first[frame])
            yield place, raw[stop - int(sizes[place]) : stop]



#: Units that the library encodes in one text, with a special string between any two.
JOINED = 100


def encoder(path: str, **sizes: int) -> Encoder:
    """Whole-text encoder of a tokenizer file; the library splits and encodes each new unit.

    Special strings in a text become their ids, as in the library's plain call. They also part the units of one call:
    nothing merges over them, and their id shows where a unit ends. They must hold no white space.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = tokenizer.get_added_tokens_decoder()
    special = [x.content for x in added.values()]
    if any(x.split() != [x] for x in special):
        raise ValueError("special strings with white space are not supported")
    border, end = next(((x.content, i) for i, x in added.items() if x.special and not (x.lstrip or x.rstrip or x.single_word or x.normalized)), ("", -1))
    holds_special = regex.compile("|".join(map(regex.escape, special)) or "(?!)")

    def plain(units: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (x.ids for x in tokenizer.encode_batch_fast(units, add_special_tokens=False))]

    def joined(units: list[str]) -> list[bytes]:
        ids = np.array(tokenizer.encode_batch_fast([border.join(units)], add_special_tokens=False)[0].ids, "<u4")
        at, raw = (4 * np.flatnonzero(ids == end)).tolist(), ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *(x + 4 for x in at)], [*at, len(raw)], strict=True)]

    def make(units: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for start in range(0, len(units), JOINED):
            part = units[start : start + JOINED]
            out += plain(part) if not border or holds_special.search("".join(part)) else joined(part)
        return out

    return Encoder(make, **{"units": 140 << 20, **sizes})


def write(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode every whole text into token files under ``folder`` in ascending id; returns the table of documents.

    A null or empty text is a document of the end id alone. Null ids come first. Repeated ids stay
    repeated; of one id, texts are dealt by their hash, so a hot id is spread. An empty table
    writes no documents. Other columns are not read.
    """
    path, end = vocabulary or tokenizer_file(VOCABULARY), np.array([end_id], "<u4").tobytes()
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        fs, base = open_folder(folder)
        name = f"part-{shard:06d}.tokens.zst"
        partial = f"{base}/.{name}.{uuid.uuid4().hex}"
        units, writer, place, out = None, None, 0, None
        for batch in slices(batches):
            if writer is None:
                units = per_process(("units", path), lambda: encoder(path))
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(partial)
                writer = FrameWriter(out)
            doc_ids = batch.column(0).to_pylist()
            frames, counts = [], []
            for doc_id, ids in zip(doc_ids, units.encode(texts(batch.column(1))), strict=True):
                frames.append(writer.add(doc_id, ids + end))
                counts.append(len(ids) // 4 + 1)
            n = len(doc_ids)
            columns = [pa.array([shard] * n, pa.int32()), pa.array([name] * n), pa.array(frames, pa.int32()), pa.array(range(place, place + n), pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(counts, pa.int64())]
            place += n
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in INDEX_SCHEMA.split(", ")])
        if writer:
            writer.close()
            out.close()
            fs.move(partial, f"{base}/{name}")

    rows.mapInArrow(run, INDEX_SCHEMA).write.parquet(f"{folder}/index")
    return df.sparkSession.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")


def _read(files: DataFrame, folder: str) -> DataFrame:
    """Documents of the files listed as (file, base, places); places null: all."""
    schema = "doc_id long, start long, n_tokens long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_folder(folder)
        for batch in batches:
            for name, offset, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(f"{base}/{name}") as source:
                    reader = FrameReader(source)
                    starts = offset + np.cumsum(reader.counts, dtype=np.int64) - reader.counts
                    rows, held = [], 0
                    for place, ids in reader.documents(None if places is None else set(places)):
                        rows.append((int(reader.ids[place]) if reader.present[place] else None, int(starts[place]), len(ids) // 4, ids))
                        held += len(ids)
                        if held >= 1 << 25:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "start", "n_tokens", "ids"])
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "start", "n_tokens", "ids"])

    files = files.select("file", "base", "places")
    return files.repartition(max(1, files.count())).mapInArrow(run, schema)  # a task a file: few rows, much data


def _with_base(index: DataFrame) -> DataFrame:
    """One row a file with the number of ids in all files before it."""
    files = index.groupBy("shard", "file").agg(F.sum("n_tokens").alias("n"))
    return files.select("file", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))


def read(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` from the files; ``start`` counts the ids of all documents before.

    With ``wanted`` (a table of doc_id) only the frames of those documents are opened; the places asked
    of a file are bounded by the documents of that file.
    """
    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")
    files = _with_base(index)
    if wanted is None:
        return _read(files.withColumn("places", F.lit(None).cast("array<bigint>")), folder)
    places = index.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("file").agg(F.collect_list("place").alias("places"))
    return _read(places.join(files, "file"), folder)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as token files, read them back and report each document's place and checksum."""
    folder = fresh_folder(spark, "token-files")
    write(table(spark, sf_dir, "documents"), folder)
    rows = read(spark, folder)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
