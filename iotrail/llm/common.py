"""Helpers shared by the operators of this subpackage: input tables, staged tables, file paths."""

from __future__ import annotations

import os
import sys
import types
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iotrail.session import workspace

#: The white space of the contracts: space and U+0009 to U+000D.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed names; other columns cannot clash with results."""
    return df.select(*[df[old].alias(new) for new, old in columns.items()])


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{workspace(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and go on from the written table."""
    path, schema = fresh_folder(df.sparkSession, name), df.schema
    df.write.parquet(path)
    staged = df.sparkSession.read.schema(schema).parquet(path)
    staged._staged_path = path
    return staged


def drop_staged(df: DataFrame) -> None:
    """Remove a staged table whose successor has been written."""
    path = getattr(df, "_staged_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text, null as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """Each text, null as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def per_process(key: tuple, make):
    """``make()`` once in each Python worker process: what tasks of one worker share, such as memos of bounded size.

    Functions arrive by value with globals of their own, so the value is kept in a module of the process.
    """
    held = sys.modules.setdefault("_iotrail_worker_state", types.ModuleType("_iotrail_worker_state")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def slices(batches, rows: int = 1000):
    """The same rows in smaller batches, to bound what a task holds in Python at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def crc32_of_id(column) -> F.Column:
    """Unsigned crc32 of an id written in decimal, the key of the hold-out folds."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def keep_rows(docs: DataFrame, kept: DataFrame, keys: dict[str, F.Column], longest: F.Column) -> DataFrame:
    """One row of ``docs`` for each row of ``kept`` (the key columns and ``n_copies``, rows of ``docs`` with that key).

    ``keys`` gives each key as an expression over ``docs``; nulls match nulls. Where rows repeat a key the one of the
    greatest ``longest`` stays.
    """
    names = docs.columns
    held = docs.withColumns({f"__{k}": x for k, x in keys.items()})
    wanted = kept.select(*[F.col(k).alias(f"__kept_{k}") for k in keys], "n_copies")
    on = None
    for k in keys:
        same = F.col(f"__{k}").eqNullSafe(F.col(f"__kept_{k}"))
        on = same if on is None else on & same
    once = held.join(wanted.filter("n_copies = 1"), on, "left_semi").select(*names)
    repeated = stage(wanted.filter("n_copies > 1"), "repeated-keys")
    if repeated.isEmpty():
        return once
    row = F.struct(*[F.col(f"`{n}`") for n in names])
    best = held.join(repeated, on, "left_semi").groupBy(*[f"__{k}" for k in keys]).agg(F.max_by(row, longest).alias("row"))
    return once.unionByName(best.select("row.*"))
