"""Document quality from a linear-chain conditional random field over lines.

Every line that isn't blank is good (1) or bad (0). Its score is linear in its own features and those
of the lines before and after it; four transition weights tie neighbouring labels. Forward-backward
gives each line's probability of being good; weighted by line length these give the document's
quality, which a logistic curve maps to a score.

Only documents have labels. Training starts from lines that inherit their document's label, then lets
the lines of bad documents choose between good and bad by their marginals, and fits again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_batch, fold, id_text
from .toxicity import labelled

#: Labelled documents that the model learns from, about (chosen by a hash of the id; their bytes are bounded by ``toxicity.labelled``).
SAMPLE = 6000
FOLDS, HELD = 5, 0
THRESHOLD = 0.3
ROUNDS, STEPS, RATE, PENALTY = 3, 80, 0.1, 1e-3
OWN = 10
WIDTH = 3 * OWN + 3
_SYMBOLS, _CAPITALS, _LETTERS, _DIGITS = b"#*$%&|<>", bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)]), b"0123456789"


def line_features(line: bytes, again: bool) -> list[float]:
    """OWN numbers, about 0 to 1 each."""
    n = len(line)
    words = line.split()
    count = lambda which: n - len(line.translate(None, which))
    pairs = max(len(words) - 1, 1)
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [
        min(1.0, 5 * count(_SYMBOLS) / n),
        count(_CAPITALS) / max(count(_LETTERS), 1),
        min(1.0, 10 * line.count(b"!") / n),
        same / pairs,
        1 - len(set(zip(words, words[1:]))) / pairs if len(words) > 1 else 0.0,
        float(again),
        min(1.0, np.log1p(n) / 10),
        count(_DIGITS) / n,
        min(1.0, n / max(len(words), 1) / 20),
        (n - len(line.translate(None, bytes(range(128, 256))))) / n,
    ]


def document_features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lines x WIDTH features, line lengths); a text without lines has one empty line."""
    lines, seen, own = [x for x in raw.split(b"\n") if x and not x.isspace()], set(), []
    for line in lines:
        own.append(line_features(line, line in seen))
        seen.add(line)
    if not lines:
        lines, own = [b""], [[0.0] * OWN]
    f = np.array(own)
    x = np.zeros((len(lines), WIDTH))
    x[:, :OWN] = f
    x[1:, OWN : 2 * OWN] = f[:-1]
    x[:-1, 2 * OWN : 3 * OWN] = f[1:]
    x[0, -3] = x[-1, -2] = x[:, -1] = 1
    return x, np.array([max(len(line), 1) for line in lines])


class Chains:
    """Many documents' lines at once. At step t all documents with more than t lines move together."""

    def __init__(self, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes, self.first = sizes, np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        longest = int(sizes.max()) if len(sizes) else 0
        left = np.searchsorted(-sizes[self.order], -np.arange(longest), side="left")
        starts = self.first[self.order]
        self.steps = [starts[: left[t]] + t for t in range(longest)]

    def odds(self, s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward log odds of good against bad for line scores ``s`` and transitions ``t``."""
        forward, back = s.copy(), np.zeros_like(s)
        for k, now in enumerate(self.steps[1:], 1):
            before = forward[self.steps[k - 1][: len(now)]]
            forward[now] += np.logaddexp(t[3] + before, t[1]) - np.logaddexp(t[2] + before, t[0])
        for k in range(len(self.steps) - 2, -1, -1):
            after = self.steps[k + 1]
            x = s[after] + back[after]
            back[self.steps[k][: len(after)]] = np.logaddexp(t[3] + x, t[2]) - np.logaddexp(t[1] + x, t[0])
        return forward, back

    def good(self, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        forward, back = self.odds(s, t)
        return 1 / (1 + np.exp(-np.clip(forward + back, -40, 40)))

    def pairs(self) -> np.ndarray:
        """Lines that have a line after them in their document."""
        last = self.first + self.sizes - 1
        keep = np.ones(int(self.sizes.sum()), bool)
        keep[last] = False
        return np.flatnonzero(keep)


def quality(p: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Length-weighted marginals of each document."""
    return np.add.reduceat(p * length, first) / np.add.reduceat(length.astype(float), first)


def gradient(x: np.ndarray, chains: Chains, weight: np.ndarray, y: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Of the log likelihood of line labels ``y`` (between 0 and 1), each document's times its lines' ``weight``: by WIDTH weights and 4 transitions."""
    s, t, pairs = x @ theta[:-4], theta[-4:], chains.pairs()
    forward, back = chains.odds(s, t)
    p = 1 / (1 + np.exp(-np.clip(forward + back, -40, 40)))
    a, b = forward[pairs], s[pairs + 1] + back[pairs + 1]
    joint = np.stack([np.full_like(a, t[0]), t[1] + b, t[2] + a, t[3] + a + b])
    joint = np.exp(joint - joint.max(axis=0))
    joint /= joint.sum(axis=0)
    i, j, w = y[pairs], y[pairs + 1], weight[pairs]
    moved = [(1 - i) * (1 - j), (1 - i) * j, i * (1 - j), i * j]
    return np.concatenate([x.T @ ((y - p) * weight), [((m - q) * w).sum() for m, q in zip(moved, joint, strict=True)]])


def bad_lines(labels: np.ndarray, p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """New line labels: good documents' lines are good, bad ones' keep their marginals, and the worst of each is bad."""
    y = np.where(labels == 1, 1.0, p)
    worst = np.minimum.reduceat(p, first)[np.cumsum(np.isin(np.arange(len(p)), first)) - 1]
    y[(labels == 0) & (p <= worst)] = 0
    return y


def fit(x: np.ndarray, length: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> dict[str, list[float]]:
    """Weights (WIDTH), transitions (bad-bad, bad-good, good-bad, good-good) and curve (slope, offset)."""
    chains = Chains(sizes)
    of = np.repeat(np.arange(len(sizes)), sizes)
    weight = (1 / np.sqrt(sizes))[of]  # long documents don't drown short ones
    y = labels[of].astype(float)
    theta, m, v, step = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), 0
    for k in range(ROUNDS):
        if k:
            y = bad_lines(labels[of], chains.good(x @ theta[:WIDTH], theta[WIDTH:]), chains.first)
        for _ in range(STEPS):
            g = gradient(x, chains, weight, y, theta) / len(sizes) - PENALTY * theta
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    q = quality(chains.good(x @ theta[:WIDTH], theta[WIDTH:]), length, chains.first)
    return {"weights": theta[:WIDTH].tolist(), "transitions": theta[WIDTH:].tolist(), "curve": curve(q, labels)}


def curve(q: np.ndarray, labels: np.ndarray) -> list[float]:
    """Slope and offset of a logistic curve, by damped Newton steps."""
    x, c = np.stack([q, np.ones_like(q)]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(c @ x, -30, 30)))
        h = (x * (p * (1 - p))) @ x.T + 1e-3 * len(q) * np.diag([1e-2, 1e-4])
        c = c + np.linalg.solve(h, x @ (labels - p) - 1e-3 * len(q) * np.array([1e-2, 1e-4]) * c)
    return c.tolist()


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, list[float]] | None:
    """The model, fitted in one task from the features of about ``sample`` documents; None without both labels."""
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("u", pa.float64()), ("x", pa.binary()), ("length", pa.binary())])

    def extract(batch: pa.RecordBatch) -> dict:
        found = [document_features(t) for t in batch["text"].to_pylist()]
        return {c: batch[c] for c in ("doc_id", "label", "u")} | {"x": [x.astype("<f4").tobytes() for x, _ in found], "length": [n.astype("<i8").tobytes() for _, n in found]}

    def learn(batches):
        x, length, label = [], [], []
        for batch in batches:
            x += [np.frombuffer(b, "<f4").reshape(-1, WIDTH) for b in batch["x"].to_pylist()]
            length += [np.frombuffer(b, "<i8") for b in batch["length"].to_pylist()]
            label += batch["label"].to_pylist()
        if len(set(label)) > 1:
            model = fit(np.concatenate(x).astype(float), np.concatenate(length), np.array(list(map(len, length))), np.array(label))
            yield pa.RecordBatch.from_pydict({k: [v] for k, v in model.items()})

    found = labelled(docs, labels, "quality", FOLDS, HELD, sample).mapInArrow(by_batch(extract, schema), "doc_id long, label int, u double, x binary, length binary")
    rows = found.repartition(1).sortWithinPartitions("u", "doc_id", "x").mapInArrow(learn, "weights array<double>, transitions array<double>, curve array<double>").collect()
    return rows[0].asDict() if rows else None


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted and quality: one row for each row of ``docs``.

    Null and empty texts count as one empty line. Without labels of both kinds every score is 1. A
    null id is not held out. An id labelled twice counts as good if it is once.
    """
    model = train(docs, labels, sample)
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.float64()), ("score", pa.float64())])

    def score(batch: pa.RecordBatch) -> dict:
        if model is None:
            return {"doc_id": batch["doc_id"], "quality": [1.0] * batch.num_rows, "score": [1.0] * batch.num_rows}
        found = [document_features(t) for t in batch["text"].to_pylist()]
        sizes = np.array([len(n) for _, n in found])
        chains = Chains(sizes)
        s = np.concatenate([x @ np.array(model["weights"]) for x, _ in found])
        q = quality(chains.good(s, np.array(model["transitions"])), np.concatenate([n for _, n in found]), chains.first)
        slope, offset = model["curve"]
        return {"doc_id": batch["doc_id"], "quality": q, "score": 1 / (1 + np.exp(-np.clip(slope * q + offset, -30, 30)))}

    scored = id_text(docs).withColumn("text", F.col("text").cast("binary")).mapInArrow(by_batch(score, schema), "doc_id long, quality double, score double")
    return scored.select(
        "doc_id",
        F.coalesce(fold(FOLDS) == HELD, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "quality",
    )
