"""Toxicity by multiple-instance learning: a document is toxic when one of its sentences is (noisy-or)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import handing_back, one_in, pieces_of, sample, spaced_words

BLOCK = 2 << 20
#: Learned texts that are cut into words at a time.
LEARNED = 500
#: Lengths of the beginnings of words that are features beside the words.
BEGINNINGS = (3, 4, 5, 6, 7)
#: A sentence with fewer blanks is no instance of its own.
SHORT = 4
#: Steps of the fit at least, however small the sample.
STEPS = 240
#: Letters and digits are kept (A-Z lower-cased), sentence ends and line ends become a line end, all else a blank.
_SIGNS = bytes(10 if b in b".!?\n" else ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))


def _joined(parts: list[bytes]) -> list[bytes]:
    """The sentences with a word; one of fewer than ``SHORT`` words goes with what follows."""
    out, open_ = [], False
    for part in parts:
        n = part.count(b" ")
        if n or part:
            if open_:
                out[-1] += b" " + part
            elif part.strip():
                out.append(part)
            else:
                continue
            open_ = (n if not open_ else out[-1].count(b" ")) < SHORT
    return out


def sentences(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts as places in their vocabulary, the words of each sentence, the sentences of each text (without
    empty ones), and per word of the vocabulary its hashed features: the word and its beginnings, which inflected forms
    share. A beginning as long as the word is no feature; its place is the one past the end."""
    parts = [_joined((t or "").encode().translate(_SIGNS).split(b"\n")) for t in texts]
    counts = np.array([len(p) for p in parts], np.int64)
    flat, words = spaced_words(pa.array([s for p in parts for s in p], pa.string()))
    coded, mask, none = flat.dictionary_encode(), (1 << bits) - 1, 1 << bits
    digest = xxhash.xxh3_64_intdigest
    found = [[digest(w) & mask, *(digest(w[:k], k) & mask if len(w) > k else none for k in BEGINNINGS)] for w in coded.dictionary.to_pylist()]
    return coded.indices.to_numpy(), words, counts, np.array(found, np.int64).reshape(-1, 1 + len(BEGINNINGS))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], values.cumsum(dtype=np.float64)])
    ends = counts.cumsum()
    return total[ends] - total[ends - counts]


def _logits(weights: np.ndarray, bias: float, words: np.ndarray, counts: np.ndarray, features: np.ndarray) -> np.ndarray:
    each = np.append(weights, 0.0)[features].sum(1)
    return bias + np.bincount(np.repeat(np.arange(len(counts)), counts), each[words], len(counts))


def _instances(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``sentences`` of many texts, block by block so that little more than their result is held, and the texts each word of the
    vocabulary is in. Every block has a vocabulary of its own."""
    out, base = [], 0
    for lo in range(0, max(len(texts), 1), LEARNED):
        words, counts, per_doc, features = sentences(texts[lo : lo + LEARNED], bits)
        pairs = np.unique(np.repeat(np.repeat(np.arange(len(per_doc)), per_doc), counts) << 32 | words)
        out.append(((words + base).astype(np.int32), counts, per_doc, features, np.bincount(pairs & (1 << 32) - 1, minlength=len(features))))
        base += len(features)
    return tuple(np.concatenate(c) for c in zip(*out))


def fit(texts: list[str], labels: np.ndarray, bits: int, epochs: int, rate: float = 0.05, decay: float = 1.5e-4, least: int = 5) -> tuple[np.ndarray, float]:
    """Word weights and bias of the sentence model, learned from document labels only. Words in fewer than ``least``
    documents of the sample get no weight: they could only be learned by heart. Weights are not negative: a word adds to the
    suspicion of its sentence or says nothing, so a long sentence does not hide one. ``decay`` pulls all weights to 0.

    P(document) = 1 - prod(1 - p(sentence)); with S = sum of softplus(logit), the gradient of the log loss with respect
    to a logit is sigmoid(logit) * ((1 - y) - y * exp(-S) / (1 - exp(-S))). Adam over batches in a fixed order, the rate falling to 0.
    """
    order = sorted(range(len(texts)), key=lambda k: xxhash.xxh3_64_intdigest(texts[k]))  # stable
    labels = labels[order]
    words, counts, per_doc, features, within = _instances([texts[k] for k in order], bits)
    first_word = np.concatenate([[0], counts.cumsum()])
    first_sentence = np.concatenate([[0], per_doc.cumsum()])
    slots = np.flatnonzero(np.bincount(features.ravel(), np.repeat(within, features.shape[1]), 1 << bits)[: 1 << bits] >= least)
    size, place = len(slots), np.full((1 << bits) + 1, len(slots))
    place[slots] = np.arange(size)
    features = place[features]
    w, bias, m, v, step = np.zeros(size), -8.0, np.zeros(size + 1), np.zeros(size + 1), 0
    batches = max(1, len(order) // 500)
    epochs = max(epochs, STEPS // batches)
    total = epochs * batches + 1
    for _ in range(epochs):
        for batch in np.array_split(np.arange(len(order)), batches):
            y = labels[batch].astype(float)
            chosen = np.concatenate([np.arange(first_sentence[d], first_sentence[d + 1]) for d in batch])
            n = per_doc[batch]
            own = counts[chosen]
            at = np.concatenate([words[first_word[s] : first_word[s + 1]] for s in chosen]) if len(chosen) else words[:0]
            used, at = np.unique(at, return_inverse=True)
            z = _logits(w, bias, at, own, features[used])
            doc = np.repeat(np.arange(len(batch)), n)
            s = np.maximum(np.bincount(doc, np.logaddexp(0, z), len(batch)), 1e-9)
            pull = np.where(y == 1, -1 / np.expm1(np.minimum(s, 60)), 1.0)
            g = pull[doc] / (1 + np.exp(-np.maximum(z, -60))) / len(batch)
            each = np.bincount(at, np.repeat(g, own), len(used))
            each = np.bincount(features[used].ravel(), np.repeat(each, features.shape[1]), size + 1)[:size]
            gradient = np.append(each + decay, g.sum())
            step += 1
            m = 0.9 * m + 0.1 * gradient
            v = 0.999 * v + 0.001 * gradient**2
            move = rate * (1 - step / total) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w = np.maximum(w - move[:-1], 0)
            bias -= move[-1]
    out = np.zeros(1 << bits, np.float32)
    out[slots] = w
    return out, float(bias)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 16_000, text_bytes: int = 64 << 20, bits: int = 21, epochs: int = 8) -> tuple[np.ndarray, float]:
    """Fits on at most ``most`` labelled documents and ``text_bytes`` of their text, the first in the order of a hash of the
    id: a documented bound on the learning sample (``sample``). Ids held out (crc32 modulo 5 is 0) and null labels are left out."""
    wanted = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~one_in(F.col("doc_id"), 5))
    wanted = wanted.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(most)
    rows = sample(docs, wanted, text_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, y, texts = [], [], []
        for batch in batches:
            for column, name in ((h, "h"), (y, "y"), (texts, "text")):
                column.extend(batch.column(name).to_pylist())
        order = sorted(range(len(h)), key=lambda k: (h[k], texts[k]))
        w, bias = fit([texts[k] for k in order], np.array([y[k] for k in order]), bits, epochs) if order else (np.zeros(1 << bits, np.float32), -20.0)
        yield pa.record_batch([pa.array([w.tobytes()], pa.binary()), pa.array([bias])], ["w", "bias"])

    found = rows.repartition(1).mapInArrow(handing_back(run), "w binary, bias double").first()
    return (np.frombuffer(bytes(found["w"]), np.float32), found["bias"]) if found else (np.zeros(1 << bits, np.float32), -20.0)


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text") -> DataFrame:
    """``docs`` with score (noisy-or over the sentences), predicted (1 from 0.5), worst_sentence and offending: the sentences
    (numbered from 0 among those with a word) whose own score is 0.5 or more.

    Cases: null and blank texts have no sentence and score 0; every row, repeated or not, is scored by its text alone; an empty
    table gives no rows; columns of the four names are replaced, all others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the number of hashed words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = shared.value
        bits = len(w).bit_length() - 1
        for batch in pieces_of(batches, text, BLOCK):
            words, counts, per_doc, features = sentences(batch.column(text).to_pylist(), bits)
            z = _logits(w, bias, words, counts, features)
            scores = -np.expm1(-_sums(np.logaddexp(0, z), per_doc))
            scores = np.where(per_doc > 0, np.clip(scores, 0, 1), 0.0)
            own = np.split(z, per_doc.cumsum()[:-1])
            worst = pa.array([int(x.argmax()) if len(x) else None for x in own], pa.int32())
            bad = pa.array([np.flatnonzero(x >= 0).astype(np.int32) for x in own], pa.list_(pa.int32()))
            columns = [pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), worst, bad]
            yield pa.record_batch([*batch.columns, *columns], [*batch.schema.names, "score", "predicted", "worst_sentence", "offending"])

    docs = docs.drop("score", "predicted", "worst_sentence", "offending")
    schema = docs.schema.simpleString()[7:-1]
    return docs.mapInArrow(run, f"{schema},score:double,predicted:int,worst_sentence:int,offending:array<int>")
