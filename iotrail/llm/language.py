"""Language identification by error-correcting output codes over byte n-grams.

Each language has a codeword; each bit has a binary classifier, the log odds of hashed byte bigrams and
trigrams between the languages whose bit is 1 and those whose bit is 0, averaged over the whole text. The
counts behind the odds come from all labelled training rows and every value of ``lang``, added up by Spark per language
and n-gram and then per bit and n-gram, so the driver holds 131,072 numbers a bit; bits grow with the logarithm of
the number of languages. Decoding is loss-weighted: each bit's logistic loss counts by how
often that bit is right for that language on a bounded sample of training rows, and the codeword of the least loss wins. If
the runner-up is nearly as close, the row is flagged ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from iotrail.llm.common import crc32_of_id, slices, stage, table, texts

CELLS = 1 << 16
#: Training rows per language that weigh the bits, and cells of one row while Spark adds up shares.
CALIBRATION_ROWS, SLICE = 2000, 64
#: Codewords compared with each other and scores held at once; more are taken in blocks.
COMPARED, HELD = 1024, 1 << 22
SHARPNESS, AMBIGUOUS = 6.0, 0.02
LETTER = regex.compile(r"\p{L}")
_MIX = np.uint32(2654435761)


def grams(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of the bigrams and of the trigrams at each byte of the lower-cased texts, and where each text starts."""
    coded = [x.lower().encode("utf-8", "surrogatepass") for x in batch]
    data = np.frombuffer(b"\0\0".join(coded) + b"\0\0\0", np.uint8).astype(np.uint32)
    two = data[:-2] | (data[1:-1] << np.uint32(8))
    three = ((two | (data[2:] << np.uint32(16))) * _MIX) >> np.uint32(16)
    starts = np.cumsum([0, *(len(x) + 2 for x in coded)])[:-1]
    return two.astype(np.int64), three.astype(np.int64) + CELLS, starts


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """One row of +1 and -1 per language: every split for up to 5 languages, else random bits, all rows different.

    Up to 256 languages have 31 bits, more have 31 for each 8 doublings. Of 200 draws the one of the largest distance is
    taken, above ``COMPARED`` languages the first whose rows differ.
    """
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        split = np.arange(1, 1 << (n - 1))
        return np.array([[1.0] * len(split), *[[1.0 if not s >> k & 1 else -1.0 for s in split] for k in range(n - 1)]])
    bits = max(31, int(np.ceil(31 * np.log2(n) / 8)))
    rng, best, most, tries = np.random.default_rng(seed), None, 0, 0
    while best is None or (tries < 200 and n <= COMPARED):
        tries += 1
        code = rng.choice([-1.0, 1.0], (n, bits))
        if (np.abs(code.sum(0)) == n).any():
            continue
        distance = int(((bits - code @ code.T) / 2 + bits * np.eye(n)).min()) if n <= COMPARED else int(len(np.unique(code > 0, axis=0)) == n)
        if distance > most:
            best, most = code, distance
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # language x bit
    odds: np.ndarray  # cell x bit
    weight: np.ndarray  # language x bit, how far each bit is trusted; rows sum to 1

    def parts(self) -> tuple:
        """Plain values to broadcast."""
        return self.languages, self.code, self.odds, self.weight

    def margins(self, batch: list[str]) -> np.ndarray:
        """Mean log odds of each bit over each whole text."""
        out = np.zeros((len(batch), self.code.shape[1]))
        start = size = 0
        for i, text in enumerate(batch):
            size += len(text)
            if size >= 1 << 17 or i + 1 == len(batch):
                two, three, starts = grams(batch[start : i + 1])
                votes = self.odds[two] + self.odds[three]
                lengths = np.diff([*starts, len(two) + 1]) - 1
                out[start : i + 1] = np.add.reduceat(votes, starts) / np.maximum(lengths, 1)[:, None]
                start, size = i + 1, 0
        return out

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its share of the evidence and whether the runner-up is too close."""
        step = max(1, HELD // len(self.languages))
        if len(margins) > step:
            parts = [self.decode(margins[i : i + step]) for i in range(0, len(margins), step)]
            return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        loss = np.logaddexp(0, -SHARPNESS * margins) @ (self.weight * (self.code > 0)).T + np.logaddexp(0, SHARPNESS * margins) @ (self.weight * (self.code < 0)).T
        near = -self.code.shape[1] * loss
        share = np.exp(near - near.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        top = share.max(1)
        second = np.partition(share, -2, 1)[:, -2] if share.shape[1] > 1 else np.zeros(len(share))
        return best, top, top - second < AMBIGUOUS


def gram_counts(labelled: DataFrame) -> DataFrame:
    """``(lang, cell, n)`` over all rows of ``(text, lang)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in slices(batches, 200):
            of: dict[str, list[str]] = {}
            for text, lang in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                of.setdefault(lang, []).append(text)
            for lang, own in of.items():
                have = totals.setdefault(lang, np.zeros(2 * CELLS, np.int64))
                for start in range(0, len(own), 20):
                    for cells in grams(own[start : start + 20])[:2]:
                        have += np.bincount(cells, minlength=2 * CELLS)
                if len(totals) > 32:
                    yield from emit(totals)
                    totals = {}
        yield from emit(totals)

    def emit(totals: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, have in totals.items():
            cell = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cell)), pa.array(cell.astype(np.int32)), pa.array(have[cell])], ["lang", "cell", "n"])

    return labelled.mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def mean_shares(counts: DataFrame, names: list[str], sizes: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell x bit: mean smoothed share of each cell over the languages whose bit is +1, and over those whose bit is -1.

    ``sizes`` are the sums of ``counts`` by language. Each language counts alike, however many rows it has.
    """
    bits = code.shape[1]
    per = 1 / (sizes + CELLS)  # a count of 0.5 is added to each of 2 * CELLS cells
    shared = counts.sparkSession.sparkContext.broadcast((names, per, code > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, per, ones = shared.value
        at = {name: i for i, name in enumerate(names)}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            lang = batch.column(0).dictionary_encode()
            own = np.array([at[x] for x in lang.dictionary.to_pylist()], int)[lang.indices.to_numpy()]
            cell, value = batch.column(1).to_numpy(), batch.column(2).to_numpy() * per[own]
            order = np.argsort(cell // SLICE, kind="stable")
            found, starts = np.unique(cell[order] // SLICE, return_index=True)
            for s, rows in zip(found.tolist(), np.split(order, starts[1:]), strict=True):
                have = sums.setdefault(s, np.zeros((SLICE, bits, 2)))
                one, each = ones[own[rows]], value[rows, None]
                np.add.at(have, cell[rows] % SLICE, np.stack([each * one, each * ~one], 2))
        for s, have in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([have.tobytes()], pa.binary())], ["slice", "sums"])

    dealt = counts.select("lang", "cell", "n").repartition(F.floor(F.col("cell") / SLICE))
    out = np.zeros((2 * CELLS, bits, 2))
    for r in stage(dealt.mapInArrow(run, "slice int, sums binary"), "language-shares").toLocalIterator():
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["sums"]).reshape(SLICE, bits, 2)
    for k, have in enumerate((code > 0, code < 0)):
        out[:, :, k] = (out[:, :, k] + 0.5 * (per @ have)) / np.maximum(have.sum(0), 1)
    return out[:, :, 0], out[:, :, 1]


def fit(labelled: DataFrame, calibration_rows: int = CALIBRATION_ROWS) -> Model | None:
    """Learn every language of ``(doc_id, text, lang)`` rows with non-null ``lang``; None if there are none."""
    n_of = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    names = sorted(n_of)
    if not names:
        return None
    at = {name: i for i, name in enumerate(names)}
    counts = stage(gram_counts(labelled.select("text", "lang")), "gram-counts")
    sizes = np.zeros(len(names))
    for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect():
        sizes[at[r["lang"]]] = r["n"]
    code = codewords(len(names))
    ones, others = mean_shares(counts, names, sizes, code)
    odds = np.where((code < 0).any(0), np.log(ones) - np.log(np.where((code < 0).any(0), others, 1)), 0).astype(np.float32)
    model = Model(names, code, odds, np.full(code.shape, 1 / code.shape[1]))
    right = np.ones(code.shape)
    seen = np.full((len(names), 1), 2.0)
    limit = {name: min(1.0, calibration_rows / n) * (1 << 20) for name, n in n_of.items()}
    drawn = labelled.select("text", "lang", F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 20)).alias("draw"))
    for lang, agreed, total in _agreement(drawn, model, limit):
        right[at[lang]] += agreed
        seen[at[lang]] += total
    trust = right / seen
    model.weight = trust / trust.sum(1, keepdims=True)
    return model


def _agreement(drawn: DataFrame, model: Model, limit: dict[str, float]) -> list[tuple[str, np.ndarray, int]]:
    """Per language: rows on which each bit is right, and rows, of the ``(text, lang, draw)`` whose draw is below the language's limit."""
    shared = drawn.sparkSession.sparkContext.broadcast((model.parts(), limit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, limit = shared.value
        model = Model(*parts)
        at = {name: i for i, name in enumerate(model.languages)}
        right, seen = np.zeros(model.code.shape), np.zeros(len(at))
        for batch in slices(batches):
            lang = batch.column(1).to_pylist()
            batch = batch.filter(pa.array([d < limit[x] for d, x in zip(batch.column(2).to_pylist(), lang, strict=True)], pa.bool_()))
            if batch.num_rows == 0:
                continue
            which = np.array([at[x] for x in batch.column(1).to_pylist()], int)
            agree = model.margins(texts(batch.column(0))) * model.code[which] > 0
            np.add.at(right, which, agree)
            np.add.at(seen, which, 1)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([model.languages[i] for i in some], pa.string()), pa.array(list(right[some]), pa.list_(pa.float64())), pa.array(seen[some].astype(np.int64))], ["lang", "agreed", "total"])

    found = drawn.mapInArrow(run, "lang string, agreed array<double>, total long")
    bits = model.code.shape[1]
    summed = found.groupBy("lang").agg(F.sum("total").alias("total"), *[F.sum(F.col("agreed")[k]).alias(f"b{k}") for k in range(bits)])
    return [(r["lang"], np.array([r[f"b{k}"] for k in range(bits)]), r["total"]) for r in summed.collect()]


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", own: tuple[str, str, str] = ("lang_pred", "lang_score", "lang_ambiguous")) -> DataFrame:
    """All columns of ``docs`` with prediction, score and ambiguity added under the names ``own`` (columns of those names are replaced).

    A text that is null or has no letter is ``und`` with score 0 and not ambiguous; without a model all texts are
    ``und``. Only the text decides. One row per row; an empty table gives none.
    """
    docs = docs.drop(*own)
    at, shared = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(model.parts() if model else None)
    names = [*docs.columns, *own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value) if shared.value else None
        for batch in slices(batches):
            rows = batch.column(at).to_pylist()
            lang, score, close = ["und"] * len(rows), [0.0] * len(rows), [False] * len(rows)
            some = [i for i, x in enumerate(rows) if model and x and LETTER.search(x)]
            if some:
                best, top, near = model.decode(model.margins([rows[i] for i in some]))
                for i, b, s, n in zip(some, best.tolist(), top.tolist(), near.tolist(), strict=True):
                    lang[i], score[i], close[i] = model.languages[b], s, n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang), pa.array(score, pa.float64()), pa.array(close)], names)

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(own, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True))])
    return docs.mapInArrow(run, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """Labelled rows outside the hold-out fold."""
    return docs.filter((F.pmod(crc32_of_id(F.col("doc_id")), F.lit(3)) != 1) & F.col("lang").isNotNull()).select("doc_id", "text", "lang")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), fit(training_rows(docs)))
    held_out = F.pmod(crc32_of_id(F.col("doc_id")), F.lit(3)) == 1
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_ambiguous")
