"""Language identification by string kernels with Nyström landmarks and one-versus-rest kernel ridge regression.

Kernel: the blended-spectrum presence kernel over lower-cased letters (all else is one space): the number of distinct n-grams of
1 to ``longest`` characters that two texts share, divided by the geometric mean of their own numbers. n-grams are hashed to
``2**bits`` places; a place counts as one n-gram.

Landmarks and training rows are bounded, documented samples in the order of a hash of id and text, equally many per language
(``landmarks``, ``training``); with very many languages each has fewer, but none is left out. Nyström features are the kernel rows
to the landmarks times the inverse root of the landmarks' own kernel; a ridge regression per language is solved on them. Texts are
scored in batches: the sparse presence rows of a batch times landmark matrix times weights, one product. Whole texts are read,
whatever their length.

Defined results. Null text, or text without a letter: ``und``, score 0. Without any usable training row all rows are ``und``. A
single language in training is predicted for all texts with letters. Null languages never train. Rows that agree in id, text and
language train once. Of equal values the language that is first in order wins. Empty tables give empty results. Extra columns are
ignored by ``report`` and passed on by ``predict``, which refuses a table that has columns of its results' names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import fold_bucket, free_name, in_batches, key_sample, require, written

UNKNOWN = "und"
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class Grams:
    """Distinct hashed n-grams of a text; keeps a scratch table, so it works in time linear in the text."""

    def __init__(self, longest: int = 4, bits: int = 20) -> None:
        self.longest, self.bits = longest, bits
        self.scratch = np.zeros(1 << bits, np.int32)
        self.letter = np.zeros(0x110000, bool)
        self.letter[[c for c in range(0x3100) if chr(c).isalpha()]] = True
        self.known = 0x3100

    def letters(self, points: np.ndarray) -> np.ndarray:
        if len(points) and int(points.max()) >= self.known:
            self.letter[[c for c in range(self.known, 0x110000) if chr(c).isalpha()]] = True
            self.known = 0x110000
        return self.letter[points]

    def of(self, text: str | None) -> np.ndarray:
        """The places (int64, each once, in no order); empty if there is no letter."""
        if not text:
            return np.empty(0, np.int64)
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        letter = self.letters(points)
        if not letter.any():
            return np.empty(0, np.int64)
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        x = np.where(letter, points, 32)[keep].astype(np.uint64)
        x = np.concatenate([[np.uint64(32)], x, [np.uint64(32)]]) if x[-1] != 32 else np.concatenate([[np.uint64(32)], x])
        found, h = [], np.zeros(len(x), np.uint64)
        for n in range(self.longest):
            if len(x) <= n:
                break
            h = h[: len(x) - n] * _MULTIPLIERS[0] + (x[n:] + np.uint64(1)) * _MULTIPLIERS[1]
            found.append(((h ^ (h >> np.uint64(29))) * _MULTIPLIERS[2] >> np.uint64(64 - self.bits)).astype(np.int64))
        places = np.concatenate(found)
        order = np.arange(len(places), dtype=np.int32)
        self.scratch[places] = order
        return places[self.scratch[places] == order]


class Landmarks:
    """The landmark matrix (n-gram x landmark: presence over the root of the landmark's size), sparse."""

    def __init__(self, marks: list[np.ndarray], bits: int) -> None:
        sizes = np.array([len(m) for m in marks])
        vocabulary, row = np.unique(np.concatenate(marks), return_inverse=True)
        order = np.argsort(row, kind="stable")
        self.row_of = np.full(1 << bits, -1, np.int32)  # place -> row, or -1
        self.row_of[vocabulary] = np.arange(len(vocabulary))
        self.owner, self.start = np.repeat(np.arange(len(marks), dtype=np.int32), sizes)[order], np.searchsorted(row[order], np.arange(len(vocabulary) + 1))
        self.scale = 1 / np.sqrt(sizes)

    def kernel(self, places: np.ndarray) -> np.ndarray:
        """The kernel of a text with each landmark."""
        at = self.row_of[places]
        at = at[at >= 0]
        n = self.start[at + 1] - self.start[at]
        own = np.repeat(self.start[at] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return np.bincount(self.owner[own], minlength=len(self.scale)) * self.scale / np.sqrt(max(1, len(places)))

    def times(self, weights: np.ndarray) -> np.ndarray:
        """Landmark matrix times weights; the last row, which -1 reaches, stands for n-grams that no landmark has."""
        out = np.zeros((len(self.start), weights.shape[1]), np.float32)
        rows = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        for k, w in enumerate(weights):
            out[rows[self.owner == k]] += (w * self.scale[k]).astype(np.float32)
        return out


@dataclass
class Model:
    """Landmark places and weights: everything a worker needs."""

    languages: list[str]
    longest: int
    bits: int
    row_of: np.ndarray  # place -> row of ``table``, or -1
    table: np.ndarray  # n-gram x language: landmark matrix times weights
    bias: np.ndarray

    def values(self, rows: list[np.ndarray], most: int = 1 << 22) -> np.ndarray:
        """The regressions' values of a batch of presence rows (places; none is empty).

        One sparse-times-dense product: the presence rows of all texts, end to end, times the landmark matrix times the weights (the
        last two are multiplied once, as they are the same for all texts). Long batches go in stretches of bounded size."""
        sizes = np.array([len(r) for r in rows])
        places, ends = np.concatenate(rows), np.cumsum(sizes)
        starts, out = ends - sizes, np.zeros((len(rows), len(self.languages)), np.float32)
        step = max(1, most // max(1, len(self.languages)))
        for a in range(0, len(places), step):
            part = self.table[self.row_of[places[a : a + step]]]
            first, last = np.searchsorted(ends, a, "right"), np.searchsorted(starts, a + len(part), "left")
            out[first:last] += np.add.reduceat(part, np.maximum(starts[first:last] - a, 0), axis=0)
        return out / np.sqrt(sizes)[:, None] + self.bias

    def scores(self, texts: list[str | None], grams: Grams) -> tuple[np.ndarray, np.ndarray]:
        """(language numbers, scores); -1 where there is no letter."""
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        held, rows, size = [], [], 0

        def solve() -> None:
            values = self.values(rows)
            shifted = np.exp(6 * (values - values.max(axis=1, keepdims=True)))
            best[held], score[held] = values.argmax(axis=1), shifted.max(axis=1) / shifted.sum(axis=1)

        for i, t in enumerate(texts):
            if len(places := grams.of(t)):
                held.append(i)
                rows.append(places)
                size += len(places)
                if size >= 1 << 20:
                    solve()
                    held, rows, size = [], [], 0
        if held:
            solve()
        return best, score


def fit(labelled: DataFrame, *, text: str = "text", lang: str = "lang", id_col: str = "doc_id", landmarks: int = 24, training: int = 400, most_landmarks: int = 1000, most_training: int = 16_000, longest: int = 4, bits: int = 20, ridge: float = 0.3) -> Model | None:
    """Fits on at most ``training`` rows per language, of which the first ``landmarks`` are landmarks. With so many languages that
    this passes ``most_landmarks`` or ``most_training`` in all, each has fewer rows; no language is left out."""
    require(labelled, **{text: T.StringType, lang: T.StringType})
    spark = labelled.sparkSession
    usable = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.xxhash64(F.lit(17), id_col, text).alias("_ln_key"), F.col(lang).alias("_ln_lang"), F.col(text).alias("_ln_text"))
    many = usable.select("_ln_lang").distinct().count()
    if not many:
        return None
    training, landmarks = max(1, min(training, most_training // many)), max(1, min(landmarks, most_landmarks // many))
    # keys first: the sample is drawn without its texts, and only the drawn rows' texts are kept
    drawn = written(key_sample(usable.select("_ln_lang", "_ln_key"), key="_ln_key", by="_ln_lang", most=training), "language-keys")  # at most most_training rows or one per language

    def presence(batches):
        grams = Grams(longest, bits)
        for table in in_batches(batches, 8 << 20):
            blobs = [grams.of(t).astype("<i4").tobytes() for t in table.column(2).to_pylist()]
            yield pa.record_batch({"key": table.column(0).combine_chunks(), "grams": pa.array(blobs, pa.binary()), "lang": table.column(1).combine_chunks()})

    texts = usable.join(F.broadcast(drawn), ["_ln_lang", "_ln_key"]).select("_ln_key", "_ln_lang", "_ln_text")
    kind = T.StructType([T.StructField("key", T.LongType()), T.StructField("grams", T.BinaryType()), T.StructField("lang", T.StringType())])
    # rows that are alike collapse before they are read; written, as it is read twice, and a task has one Python worker
    sampled = written(texts.dropDuplicates(["_ln_key", "_ln_lang"]).mapInArrow(presence, kind), "language-sample")
    languages = sorted(r.lang for r in sampled.select("lang").distinct().collect())
    first = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    marks = [np.frombuffer(bytes(r.grams), "<i4") for r in sampled.withColumn("_r", first).filter(F.col("_r") <= landmarks).orderBy("lang", "key").collect()]
    marks = [m for m in marks if len(m)]
    if not marks:
        return None
    held = Landmarks(marks, bits)
    shared = spark.sparkContext.broadcast(held)

    def kernel_rows(batches):
        m = shared.value
        for b in batches:
            grams = [np.frombuffer(blob, "<i4") for blob in b.column(1).to_pylist()]
            yield pa.record_batch({"k": pa.array([m.kernel(g).astype("<f4").tobytes() if len(g) else None for g in grams], pa.binary()), "lang": b.column(2)})

    rows = [r for r in sampled.mapInArrow(kernel_rows, "k binary, lang string").collect() if r.k is not None]  # a vector per sampled row
    kernel = np.stack([np.frombuffer(bytes(r.k), "<f4") for r in rows]).astype(np.float64)
    target = np.array([[1.0 if r.lang == x else -1.0 for x in languages] for r in rows])
    own = np.stack([held.kernel(m) for m in marks])
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = kernel @ root
    mean, level = features.mean(axis=0), target.mean(axis=0)
    centred = features - mean
    solved = np.linalg.solve(centred.T @ centred + ridge * np.eye(features.shape[1]), centred.T @ (target - level))
    return Model(languages, longest, bits, held.row_of, held.times(root @ solved), (level - mean @ solved).astype(np.float32))


def predict(docs: DataFrame, model: Model | None, *, text: str = "text", prefix: str = "_ln_") -> DataFrame:
    """``docs`` with the predicted language and its score (0 to 1)."""
    require(docs, **{text: T.StringType})
    free_name(docs, f"{prefix}lang", f"{prefix}score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        m = shared.value
        grams = Grams(m.longest, m.bits) if m else None
        for table in in_batches(batches, 16 << 20):
            texts = table.column(at).to_pylist()
            best, score = m.scores(texts, grams) if m else (np.full(len(texts), -1), np.zeros(len(texts)))
            names = [UNKNOWN if k < 0 else m.languages[k] for k in best.tolist()]
            yield from table.append_column(f"{prefix}lang", pa.array(names, pa.string())).append_column(f"{prefix}score", pa.array(score, pa.float64())).combine_chunks().to_batches()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(f"{prefix}lang", T.StringType()), T.StructField(f"{prefix}score", T.DoubleType())]))


def fit_on_folds(docs: DataFrame) -> Model | None:
    """The model of the documents outside the held-out fold (crc32 of the id as text, modulo 3, is 1)."""
    return fit(docs.select("doc_id", "text", "lang").filter(fold_bucket("doc_id", 3) != 1))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: whether it is held out, the predicted language and its score."""
    found = predict(docs.select("doc_id", "text"), fit_on_folds(docs))
    return found.select("doc_id", (fold_bucket("doc_id", 3) == 1).alias("held_out"), F.col("_ln_lang").alias("lang_pred"), F.col("_ln_score").alias("score"))
