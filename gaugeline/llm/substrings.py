"""Repeated passages: every run of several consecutive sentences is hashed; all but the first occurrence go."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import mark_place, marked, marks, pieces_of, scratch, spread_join

BLOCK = 1 << 20
#: A sentence or line; white space at the end of a text stands alone. All of them make up the text.
SENTENCE = re.compile(r"(?:\s*+\S++)+?(?:(?<=[.!?])|(?=\s*\n)|(?=\s*\Z))|\s+")
#: Signs of scripts written without blanks (each is a word, with the marks that follow it), and those marks.
_BARE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_MARKS = "\u0e31\u0e34-\u0e3a\u0e47-\u0e4e\u0eb1\u0eb4-\u0ebc\u0ec8-\u0ece\u102b-\u103e\u1056-\u1059\u17b4-\u17d3\u17dd"
WORD = re.compile(rf"\s*+(?:[{_BARE}][{_MARKS}]*+|[^\s{_BARE}]++)")
#: Words between two cuts of a sentence at least; one of twice as many words or more is cut, and no part has as many.
APART = 5
#: Sentences up to so many words are cut by their lowest ranks one after the other, longer ones by all ranks in order.
SHORT = 256
_A, _B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class _Ranks(dict):
    """A number for each word, whatever its case and the white space before it."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = rank = xxhash.xxh3_64_intdigest(word.strip().lower())
        return rank


_RANKS = _Ranks()


def _parts(sentence: str) -> list[str]:
    """The sentence cut before words of low rank, the lowest first, where no cut is nearer than ``APART`` words.

    Where a cut falls depends on the words around it, not on how many come before: copies inside different sentences are cut alike a few
    words from their ends."""
    words = WORD.findall(sentence) if len(sentence) >= 2 * APART else ()
    if len(words) < 2 * APART:
        return [sentence]
    ranks = list(map(_RANKS.__getitem__, words))
    if len(words) < 3 * APART:  # all places for a cut are near each other
        at = ranks.index(min(ranks[APART : len(words) - APART + 1]), APART)
        return ["".join(words[:at]), "".join(words[at:])]
    cuts = sorted([0, *(_lowest(ranks) if len(words) <= SHORT else _lowest_of_many(ranks)), len(words)])
    return ["".join(words[a:b]) for a, b in zip(cuts, cuts[1:])]


def _lowest(ranks: list[int]) -> list[int]:
    """The cuts of a sentence: the lowest rank, then the same on either side of it where no cut is near."""
    cuts, sides = [], [(APART, len(ranks) - APART + 1)]
    while sides:
        lo, hi = sides.pop()
        if lo < hi:
            at = ranks.index(min(ranks[lo:hi]), lo)
            cuts.append(at)
            sides += (lo, at - APART + 1), (at + APART, hi)
    return cuts


def _lowest_of_many(ranks: list[int]) -> list[int]:
    """The same cuts in time that does not grow with the square of the length."""
    near, cuts = bytearray(len(ranks) + APART), []
    for k in sorted(range(APART, len(ranks) - APART + 1), key=ranks.__getitem__):
        if not near[k]:
            cuts.append(k)
            near[k - APART + 1 : k + APART] = b"\1" * (2 * APART - 1)
    return cuts


def units(text: str | None) -> list[str]:
    """Sentences and lines, long ones in parts of ``APART`` to ``2 * APART - 1`` words; together they are the text."""
    return [part for sentence in SENTENCE.findall(text or "") for part in _parts(sentence)]


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))


def run_hashes(parts: list[str], run: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the run that starts at each unit, the unit, and the units of the run: ``run`` of them, and as many more
    as it takes to have ``words`` words.

    Case and white space do not matter."""
    none = np.zeros(0, np.uint64)
    if len(parts) < run:
        return none, none, np.zeros(0, np.int64), np.zeros(0, np.int64)
    tokens = [p.lower().split() for p in parts]
    h = np.array([xxhash.xxh3_64_intdigest(" ".join(t)) for t in tokens], np.uint64)
    n = np.concatenate([[0], np.cumsum([len(t) if p.isascii() else len(WORD.findall(p)) for p, t in zip(parts, tokens)])])
    at = np.arange(len(parts))
    end = np.maximum(at + run, np.searchsorted(n, n[:-1] + words))
    at = at[end <= len(parts)]
    end = end[at]
    out = []
    for base in (_A, _B):
        power, inverse = _powers(base, len(h))
        total = np.concatenate([np.zeros(1, np.uint64), (h * power[:-1]).cumsum(dtype=np.uint64)])
        out.append((total[end] - total[at]) * inverse[at])
    return *out, at, end - at


def repeated_units(docs: DataFrame, kept: Callable[[DataFrame], DataFrame], run: int = 3, words: int = 10, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (doc_id, h, units): the units of each document, known by its id and a hash of its text, covered by a run (``run_hashes``) that also starts earlier, that is in a
    document with a smaller id or further up in the same one.

    Texts are cut and hashed once, into a table of runs that ``kept`` writes. The first occurrence of each run is an aggregate, so a run
    that a third of all documents share shrinks in the tasks that read it, and such runs meet their first occurrence without a shuffle.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", BLOCK):
            found = [run_hashes(units(t), run, words) for t in batch.column("text").to_pylist()]
            each = [len(a) for a, *_ in found]
            doc, own = (np.repeat(batch.column(c).to_numpy(), each) for c in ("doc_id", "h"))
            a, b, at, n = (np.concatenate(c) for c in zip(*found))
            columns = [pa.array(doc), pa.array(own), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))]
            yield pa.record_batch(columns, ["doc_id", "h", "a", "b", "at", "n"])

    # Texts of one id in the order of half their hash, which leaves room for the unit.
    place = F.struct("doc_id", F.shiftleft(F.shiftright("h", 32), 32).bitwiseOR(F.col("at").cast("long")).alias("at"))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    runs = kept(rows.withColumn("h", F.xxhash64("text")).mapInArrow(hashed, "doc_id long, h long, a long, b long, at int, n int"))
    first = kept(runs.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1"))
    later = spread_join(runs, first, ["a", "b"], "times", runs.count()).where(place > F.col("first"))
    covered = later.groupBy("doc_id", "h").agg(F.collect_set(F.struct("at", "n")).alias("runs"))
    spread = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["at"], r["at"] + r["n"] - 1))))
    return covered.select("doc_id", "h", spread.alias("units"))


def dedupe(docs: DataFrame, run: int = 3, words: int = 10, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, n_units (sentences, long ones in parts), n_removed, and the text without the units of
    repeated runs.

    The first occurrence (smallest id, then place) of every run stays. Units that no repeated run covers stay as they are, so documents
    that share nothing are unchanged. Only rows whose id may have something to remove are joined with it.
    Cases: null and empty texts have no units and stay; a null id is never compared and keeps its text; rows that
    repeat an id with the same text keep and lose the same units, with another text they are documents of their own; an empty table gives no rows; other columns are ignored.
    """
    from gaugeline.session import checkpointed

    with scratch(docs.sparkSession) as kept:
        found = checkpointed(repeated_units(docs, kept, run, words, text, key))
    known = docs.sparkSession.sparkContext.broadcast(marks(found, "doc_id"))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("b", mark_place("doc_id"))

    def chosen(wanted: bool):
        def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = np.asarray(marked(known.value, batch.column("b")).to_numpy(zero_copy_only=False))
                yield batch.filter(pa.array(hit if wanted else ~hit)).select(["doc_id", "text"])

        return rows.mapInArrow(run_, "doc_id long, text string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", BLOCK):
            texts, counts, removed = [], [], []
            for t, gone in zip(batch.column("text").to_pylist(), batch.column("units").to_pylist()):
                parts, gone = units(t), set(gone or ())
                counts.append(len(parts))
                removed.append(len(gone))
                texts.append("".join(p for k, p in enumerate(parts) if k not in gone) if gone else t)
            yield pa.record_batch([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_units", "n_removed", "text"])

    apart = chosen(False).withColumn("units", F.lit(None).cast("array<int>"))
    joined = chosen(True).withColumn("h", F.xxhash64("text")).join(found, ["doc_id", "h"], "left").select("doc_id", "text", "units")
    out = apart.unionByName(joined).mapInArrow(cut, "doc_id long, n_units long, n_removed long, text string")
    return out.withColumnsRenamed({"doc_id": key, "text": text})
