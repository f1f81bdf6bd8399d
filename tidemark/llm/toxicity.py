"""Toxicity by FTRL-proximal logistic regression over hashed n-grams.

Words, neighbouring pairs, pairs with one or two words between, and word beginnings (an inflected word
shares its beginning with forms that the sample lacks) hash into 2^22 binary features.
The model learns from a bounded sample of labelled documents in one task. Features that fewer than
INCLUDE of them have are left out; every other coordinate has its own learning rate, and the L1 penalty
leaves a few hundred weights that are not zero, so the model that is sent to the tasks is small whatever
the corpus. Word beginnings, INCLUDE and L1 were chosen by threefold cross-validation inside the folds
that aren't held out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_batch, fold, id_text, saved

BITS = 22
#: Labelled documents that the model learns from, about (chosen by a hash of the id), and passes over them.
SAMPLE, EPOCHS = 8000, 10
#: Bytes of the sample's texts, about, and of one text at most: what a model's single task holds is bounded.
SAMPLE_BYTES, TEXT_BYTES = 32 << 20, 1 << 20
INCLUDE = 3
#: Bytes of a word's beginning.
PREFIXES = (4, 6)
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 1.0
FOLDS, HELD = 4, 2
THRESHOLD = 0.3
#: Everything but ASCII letters, digits and bytes of other scripts ends a word.
_TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def features(raw: bytes) -> np.ndarray:
    """The features of a text in UTF-8, repeats included."""
    words = raw.lower().translate(_TABLE).split()
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + np.uint64(1)
    mixed = [h * _MIX[0]]
    for gap in (1, 2, 3):
        if len(h) > gap:
            mixed.append((h[:-gap] * _MIX[gap]) ^ (h[gap:] * _MIX[4] + np.uint64(gap)))
    for n in PREFIXES:
        start = np.fromiter((zlib.crc32(w[:n]) for w in words), np.uint64, len(words)) + np.uint64(n)
        mixed.append(start * _MIX[2] + np.uint64(n))
    every = np.concatenate(mixed) * _MIX[1]
    return (every >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """The last coordinate is the bias, which every document has."""

    def __init__(self, size: int = (1 << BITS) + 1):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


class Scorer:
    """Sparse weights, and scores from them."""

    def __init__(self, at: list[int], weights: list[float]):
        self.known = np.zeros((1 << BITS) + 1)
        self.known[at] = weights
        self.used = self.known != 0
        self.bias = self.known[-1]
        self.empty = not len(at)

    def __call__(self, raw: bytes) -> float:
        if self.empty:
            return 0.0
        found = features(raw)
        found = np.unique(found[self.used[found]])
        return float(1 / (1 + np.exp(-np.clip(self.known[found].sum() + self.bias, -30, 30))))


def labelled(docs: DataFrame, labels: DataFrame, column: str, folds: int, held: int, sample: int) -> DataFrame:
    """doc_id, text (binary), label and u, in [0, 1): about ``sample`` labelled documents outside the held-out fold.

    Texts of over TEXT_BYTES are never in the sample, and if its texts have over SAMPLE_BYTES, a share of it
    stays that has about so many. The sample follows from the ids alone.
    """
    known = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & (fold(folds) != held))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("label"))
    u = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    share = min(1.0, sample / max(known.count(), 1))
    chosen = known.withColumn("u", u).filter(F.col("u") < share).withColumnRenamed("doc_id", "id_")
    texts = id_text(docs).withColumn("text", F.col("text").cast("binary")).filter(F.octet_length("text") <= TEXT_BYTES)
    rows = saved(texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("id_")).drop("id_"), "sample")  # about ``sample`` rows
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return rows.filter(F.col("u") < share * SAMPLE_BYTES / size) if size > SAMPLE_BYTES else rows


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[int], list[float]]:
    """The weights that aren't zero, as (feature, weight) lists; none without toxic and clean examples."""
    rows = labelled(docs, labels, "toxic", FOLDS, HELD, sample)
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("u", pa.float64()), ("at", pa.binary())])

    def extract(batch: pa.RecordBatch) -> dict:
        at = [np.unique(features(t)).astype("<i4").tobytes() for t in batch["text"].to_pylist()]
        return {"doc_id": batch["doc_id"], "label": batch["label"], "u": batch["u"], "at": at}

    def learn(batches):
        model, times, held = Ftrl(), np.zeros(1 << BITS, np.int32), []
        for batch in batches:
            for label, raw in zip(batch["label"].to_pylist(), batch["at"].to_pylist(), strict=True):
                at = np.frombuffer(raw, "<i4")
                times[at] += 1
                held.append((at, label))
        held = [(at[times[at] >= INCLUDE], label) for at, label in held]
        if len({label for _, label in held}) > 1:
            for _ in range(EPOCHS):
                for at, label in held:
                    model.learn(at, label)
        w = model.weights()
        yield pa.RecordBatch.from_pydict({"at": np.flatnonzero(w), "w": w[w != 0]})

    found = rows.mapInArrow(by_batch(extract, schema), "doc_id long, label int, u double, at binary")
    model = found.repartition(1).sortWithinPartitions("u", "doc_id", "at").mapInArrow(learn, "at long, w double").collect()  # the weights that aren't zero
    return [r.at for r in model], [r.w for r in model]


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of ``docs``.

    A null text counts as empty and gets the score of the bias alone. Without both kinds of examples
    every score is 0. A null id is not held out. An id labelled twice counts as toxic if it is once.
    """
    at, weights = train(docs, labels, sample)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def score(batches):
        model = Scorer(at, weights)
        yield from by_batch(lambda b: {"doc_id": b["doc_id"], "score": [model(t) for t in b["text"].to_pylist()]}, schema)(batches)

    scored = id_text(docs).withColumn("text", F.col("text").cast("binary")).mapInArrow(score, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(fold(FOLDS) == HELD, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
