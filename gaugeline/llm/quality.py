"""Text quality by ordinal regression: one weight per hashed feature, ordered thresholds between the grades."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import one_in, pieces_of, sample, spaced_words

BLOCK = 4 << 20
#: Steps of the fit at least, however small the sample.
STEPS = 120
_RUNS = re.compile(r"(.)\1+")


def _shape(word: str) -> str:
    """The word with letters as a, digits as 9, runs shortened: what kind of token it is."""
    return _RUNS.sub(r"\1", "".join("a" if c.isalpha() else "9" if c.isdigit() else c for c in word))


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of all texts, how many each text has, and the weight of one occurrence there (1 / sqrt(words)).

    Features are words, word shapes, and a word that repeats the one before it.
    """
    flat, counts = spaced_words(texts)
    coded = flat.dictionary_encode()
    at, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    mask = (1 << bits) - 1
    word = np.array([xxhash.xxh3_64_intdigest(w) & mask for w in words], np.int64)
    shape = np.array([xxhash.xxh3_64_intdigest("\x00" + _shape(w)) & mask for w in words], np.int64)
    again = xxhash.xxh3_64_intdigest("\x00repeated") & mask
    other = xxhash.xxh3_64_intdigest("\x00fresh") & mask
    if not len(at):
        return np.zeros(0, np.int64), counts * 3, np.ones(len(counts))
    first = np.zeros(len(at), bool)
    first[(counts.cumsum() - counts)[counts > 0]] = True
    repeated = np.concatenate([[False], at[1:] == at[:-1]]) & ~first
    every = np.column_stack([word[at], shape[at], np.where(repeated, again, other)]).ravel()
    return every, counts * 3, 1 / np.sqrt(np.maximum(counts, 1))


def probabilities(weights: np.ndarray, cuts: np.ndarray, texts: pa.Array, bits: int) -> np.ndarray:
    """P(grade > k) for each text and each threshold k; falls with k because the thresholds rise."""
    at, counts, unit = features(texts, bits)
    z = np.bincount(np.repeat(np.arange(len(counts)), counts), weights[at], len(counts)) * unit
    return 1 / (1 + np.exp(np.clip(cuts[None, :] - z[:, None], -40, 40)))


def fit(texts: list[str], grades: np.ndarray, levels: int, bits: int, epochs: int, rate: float = 0.02, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Cumulative-link regression: P(grade > k) = sigmoid(w.x - cut_k), cut_k = cut_0 + sum of exp(gap), so that the cuts are
    ordered. Maximises the likelihood of the grades with Adam over batches in a fixed order."""
    at, counts, unit = features(pa.array(texts, pa.string()), bits)
    start = np.concatenate([[0], counts.cumsum()])
    size = 1 << bits
    w, base, gaps = np.zeros(size), 0.0, np.zeros(levels - 2)
    m, v, step = np.zeros(size + levels - 1), np.zeros(size + levels - 1), 0
    order = np.argsort([xxhash.xxh3_64_intdigest(t) for t in texts], kind="stable")
    batches = max(1, len(order) // 500)
    for _ in range(max(epochs, STEPS // batches)):
        for batch in np.array_split(order, batches):
            own = np.concatenate([at[start[d] : start[d + 1]] for d in batch])
            n, scale = counts[batch], unit[batch]
            z = np.bincount(np.repeat(np.arange(len(batch)), n), w[own], len(batch)) * scale
            cuts = base + np.concatenate([[0], np.exp(gaps).cumsum()])
            above = np.column_stack([np.ones(len(batch)), 1 / (1 + np.exp(np.clip(cuts - z[:, None], -40, 40))), np.zeros(len(batch))])
            g, rows = grades[batch], np.arange(len(batch))
            p = np.maximum(above[rows, g] - above[rows, g + 1], 1e-9)
            slope = above * (1 - above)
            dz = -(slope[rows, g] - slope[rows, g + 1]) / p / len(batch)
            dcuts = np.zeros((len(batch), levels + 1))
            dcuts[rows, g] += slope[rows, g] / p / len(batch)
            dcuts[rows, g + 1] -= slope[rows, g + 1] / p / len(batch)
            dcuts = dcuts[:, 1:-1].sum(0)
            dgaps = np.exp(gaps) * dcuts[::-1].cumsum()[::-1][1:]
            gradient = np.concatenate([np.bincount(own, np.repeat(dz * scale, n), size) + decay * w, [dcuts.sum()], dgaps])
            step += 1
            m = 0.9 * m + 0.1 * gradient
            v = 0.999 * v + 0.001 * gradient**2
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w -= move[:size]
            base -= move[size]
            gaps -= move[size + 1 :]
    return w.astype(np.float32), base + np.concatenate([[0], np.exp(gaps).cumsum()])


def train(docs: DataFrame, grades: DataFrame, levels: int, most: int = 12_000, text_bytes: int = 40 << 20, bits: int = 18, epochs: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Fits on rated documents (``grades``: doc_id, grade from 0 to levels - 1), at most ``most`` of them and ``text_bytes`` of
    text, the first in the order of a hash of the id: a documented bound on the learning sample (``sample``)."""
    wanted = grades.where("grade is not null and doc_id is not null").where(~one_in(F.col("doc_id"), 5))
    wanted = wanted.groupBy("doc_id").agg(F.min("grade").cast("int").alias("y")).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(most)
    rows = sample(docs, wanted, text_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, y, texts = [], [], []
        for batch in batches:
            for column, name in ((h, "h"), (y, "y"), (texts, "text")):
                column.extend(batch.column(name).to_pylist())
        order = sorted(range(len(h)), key=lambda k: (h[k], texts[k]))
        if order:
            w, cuts = fit([texts[k] for k in order], np.array([y[k] for k in order]), levels, bits, epochs)
            yield pa.record_batch([pa.array([w.tobytes()], pa.binary()), pa.array([cuts], pa.list_(pa.float64()))], ["w", "cuts"])

    found = rows.repartition(1).mapInArrow(run, "w binary, cuts array<double>").first()
    if not found:
        return np.zeros(1 << bits, np.float32), np.arange(levels - 1, dtype=float)
    return np.frombuffer(bytes(found["w"]), np.float32), np.array(found["cuts"])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], least: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: expected_grade, tail_probability (of grade ``least`` or better) and kept (tail_probability >= 0.5).

    Cases: null and blank texts have no features, so only the thresholds speak, and they are not kept; every row is scored by its
    whole text alone; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the number of hashed features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, cuts = shared.value
        for batch in pieces_of(batches, "text", BLOCK):
            above = probabilities(w, cuts, batch.column("text"), len(w).bit_length() - 1)
            yield pa.record_batch([batch.column("id"), pa.array(above.sum(1)), pa.array(above[:, least - 1].copy()), batch.column("blank")], ["id", "expected", "tail", "blank"])

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.coalesce(F.trim(F.col(text)) == "", F.lit(True)).alias("blank"))
    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"id {kind}, expected double, tail double, blank boolean")
    return scored.select(F.col("id").alias(key), F.col("expected").alias("expected_grade"), F.col("tail").alias("tail_probability"), ((F.col("tail") >= 0.5) & ~F.col("blank")).alias("kept"))
