"""Benchmark passages in training texts: an FM-index over the words of each training shard, searched backward."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import pieces_of, spaced_words

#: Words are runs of ASCII letters and digits (A-Z lower-cased) and of any sign beyond ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_KEEP = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))
#: Text bytes of one index and test bytes of one search: bounds on memory, not on the result.
SHARD_BYTES, TEST_BYTES = 4 << 20, 2 << 20
SAMPLE = 16


def words_of(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in one array, and how many each text has."""
    return spaced_words(pa.array([(t or "").encode().translate(_KEEP) for t in texts], pa.string()))


class Bits:
    """A bit vector with constant-time rank: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        self.words = np.packbits(np.concatenate([bits, np.zeros(64 - len(bits) % 64, bool)]), bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.bitwise_count(self.words).cumsum(dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class Wavelet:
    """Ranks of symbols in a sequence, one bit vector per binary digit, the highest first."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels, self.zeros, current = [], [], sequence
        self.digits = range(max(1, (symbols - 1).bit_length()) - 1, -1, -1)
        for digit in self.digits:
            ones = (current >> digit & 1).astype(bool)
            self.levels.append(Bits(ones))
            self.zeros.append(len(ones) - int(ones.sum()))
            current = np.concatenate([current[~ones], current[ones]])
        self.start = self.down(np.arange(symbols), np.zeros(symbols, np.int64))

    def down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for digit, level, zeros in zip(self.digits, self.levels, self.zeros):
            ones = level.rank(i)
            i = np.where(symbol >> digit & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self.down(symbol, i) - self.start[symbol]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its rank there."""
        symbol = np.zeros(len(i), np.int64)
        for level, zeros in zip(self.levels, self.zeros):
            bit, ones = level.get(i), level.rank(i)
            symbol = symbol << 1 | bit
            i = np.where(bit, zeros + ones, i - ones)
        return symbol, i - self.start[symbol]


def suffixes(sequence: np.ndarray) -> np.ndarray:
    """The suffix array of a sequence whose zeros each end a document and compare by their place: prefix doubling, in
    which only the suffixes that are still tied are sorted again."""
    n, ends = len(sequence), sequence == 0
    rank = np.where(ends, ends.cumsum() - 1, sequence + ends.sum()).astype(np.int64)
    top, depth = int(rank.max()) + 1, 1
    key = rank
    if top < 1 << 21:  # three ranks fit into one key
        second, third = (np.concatenate([rank[k:], np.zeros(k, np.int64)]) for k in (1, 2))
        key, depth = (rank * top + second[:n]) * top + third[:n], 3
    order = np.argsort(key)
    key, at = key[order], np.arange(n)
    active, tied = at, order.copy()
    rank = np.empty(n, np.int64)
    while True:
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[tied] = np.maximum.accumulate(np.where(fresh, active, 0))
        order[active] = tied
        open_ = ~(fresh & np.concatenate([fresh[1:], [True]]))
        active = active[open_]
        if not len(active):
            return order
        tied = order[active]
        key = rank[tied] * n + rank[tied + depth]
        by = np.argsort(key)
        tied, key = tied[by], key[by]
        depth *= 2


class Index:
    """An FM-index over the words of the documents of one shard."""

    def __init__(self, texts: list[str | None]):
        flat, self.lengths = words_of(texts)
        coded = flat.dictionary_encode()
        self.words = coded.dictionary
        self.first = np.concatenate([[0], (self.lengths + 1).cumsum()])  # of each document; one end sign follows each
        self.sequence = np.zeros(self.first[-1], np.int64)
        inner = np.ones(len(self.sequence), bool)
        inner[self.first[1:] - 1] = False
        self.sequence[inner] = coded.indices.to_numpy() + 1
        symbols, order = len(self.words) + 1, suffixes(self.sequence)
        self.before = np.concatenate([[0], np.bincount(self.sequence, minlength=symbols).cumsum()[:-1]])
        self.wavelet = Wavelet(self.sequence[order - 1], symbols)
        starts = np.zeros(len(self.sequence), bool)
        starts[self.first[:-1]] = True
        sampled = (order % SAMPLE == 0) | starts[order]
        self.sampled, self.positions = Bits(sampled), order[sampled]

    def search(self, vocabulary: pa.Array, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases at once: the first and the end row of each; equal where there is none.

        ``phrases`` holds places in ``vocabulary``, right-aligned."""
        code = pc.fill_null(pc.index_in(vocabulary, value_set=self.words), -1).to_numpy() + 1
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.sequence), np.int64)
        for step in range(phrases.shape[1]):
            live = np.flatnonzero((lengths > step) & (hi > lo))
            symbol = code[phrases[live, -1 - step]]
            lo[live[symbol == 0]] = hi[live[symbol == 0]] = 0
            live, symbol = live[symbol > 0], symbol[symbol > 0]
            lo[live] = self.before[symbol] + self.wavelet.rank(symbol, lo[live])
            hi[live] = self.before[symbol] + self.wavelet.rank(symbol, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position of each row: steps back through the text until a sampled suffix."""
        out, at, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(rows):
            known = self.sampled.get(rows)
            out[at[known]] = self.positions[self.sampled.rank(rows[known])] + steps
            at, rows = at[~known], rows[~known]
            symbol, rank = self.wavelet.access(rows)
            rows, steps = self.before[symbol] + rank, steps + 1
        return out


class Phrases(NamedTuple):
    """The distinct windows of a block of test items, and the items of each. Tasks get it as a plain tuple of arrays and lists."""

    vocabulary: pa.Array
    matrix: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]


def phrases_of(items: list[tuple[str | None, str | None]], window: int) -> Phrases:
    """The windows of ``items`` (id, text); those without an id have windows that belong to no item."""
    flat, counts = words_of([t for _, t in items])
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy()
    found: dict[tuple, set[str]] = {}
    for (item, _), first, n in zip(items, counts.cumsum() - counts, counts):
        for k in range(first, first + max(n - window, 0) + 1) if n else ():
            found.setdefault(tuple(codes[k : k + min(n, window)].tolist()), set()).update(() if item is None else (item,))
    lengths = np.array([len(p) for p in found], np.int64)
    matrix = np.array([(0,) * (window - len(p)) + p for p in found], np.int64).reshape(-1, window)
    return Phrases(coded.dictionary, matrix, lengths, [sorted(i) for i in found.values()])


def _marked(texts: list[str | None], phrases: Phrases, spans: list, items: list) -> tuple[list, list, np.ndarray]:
    """Adds the occurrences in one shard to the spans and items found so far."""
    index = Index(texts)
    lo, hi = index.search(phrases.vocabulary, phrases.matrix, phrases.lengths)
    count = hi - lo
    phrase = np.repeat(np.arange(len(count)), count)
    rows = np.arange(len(phrase)) - np.repeat(count.cumsum() - count, count) + np.repeat(lo, count)
    place = index.locate(rows)
    doc = np.searchsorted(index.first, place, side="right") - 1
    change = np.zeros(len(index.sequence) + 1, np.int64)
    np.add.at(change, place, 1)
    np.add.at(change, place + phrases.lengths[phrase], -1)
    touched = np.unique(doc)
    for d in touched:
        for s in spans[d]:
            change[index.first[d] + s["start"]] += 1
            change[index.first[d] + s["end"]] -= 1
    hit = change.cumsum() > 0
    for d in touched:
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[index.first[d] : index.first[d + 1]], [0]])))
        spans[d] = [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]
    order = np.argsort(doc, kind="stable")
    for d, own in zip(touched, np.split(phrase[order], np.searchsorted(doc[order], touched[1:]))):
        items[d] = sorted(set(items[d]).union(*(phrases.items[p] for p in np.unique(own))))
    return spans, items, index.lengths


def mark(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with n_words, hit_spans (merged ranges of words inside any occurrence of a window) and hit_items.

    A window is ``window`` consecutive words of an item, or the whole item when it is shorter. Each shard is indexed in
    its task, so nothing is shuffled. The test items are searched in blocks of about ``TEST_BYTES``; every block is one more
    pass over the rows, which carry what was found, so a test set of any size is searched whole.
    Cases: null and empty texts have no words; items without words have no window; equal items and windows are each
    reported; words of items without an id are hit, but no item is named for them; repeated documents are marked each; an empty table on either side finds nothing; extra columns stay, save
    n_words, hit_spans and hit_items, which are replaced.
    """
    tests = benchmark.select(F.col(item).cast("string").alias("i"), F.col(item_text).alias("t"))
    size = tests.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-size // TEST_BYTES) or 1
    out = docs.drop("n_words", "hit_spans", "hit_items").withColumns(
        {"n_words": F.lit(0).cast("long"), "hit_spans": F.expr("cast(array() as array<struct<start:int,end:int>>)"), "hit_items": F.expr("cast(array() as array<string>)")}
    )
    for block in range(blocks):
        own = tests.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).collect()
        # A broadcast is pickled by reference to its classes, which executors need not have: only arrays and lists go.
        phrases = out.sparkSession.sparkContext.broadcast(tuple(phrases_of([tuple(r) for r in own], window)))

        def run(batches: Iterator[pa.RecordBatch], phrases=phrases) -> Iterator[pa.RecordBatch]:
            for batch in pieces_of(batches, text, SHARD_BYTES):
                names = batch.schema.names
                spans, items = (batch.column(c).to_pylist() for c in ("hit_spans", "hit_items"))
                spans, items, lengths = _marked(batch.column(text).to_pylist(), Phrases(*phrases.value), spans, items)
                for name, values in (("n_words", lengths), ("hit_spans", spans), ("hit_items", items)):
                    kind = batch.schema.field(name).type
                    batch = batch.set_column(names.index(name), name, pa.array(values, kind))
                yield batch

        out = out.mapInArrow(run, out.schema)
    return out


def digest(marked: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 (of the sorted ids, comma-joined), contaminated."""
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return marked.select(
        key,
        "n_words",
        hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def cut(marked: DataFrame, text: str = "text") -> DataFrame:
    """The marked documents with the words of their hit spans, and what stands between those, removed from the text.

    A document that loses words is dropped when no word is left; other documents stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for k, spans in enumerate(batch.column("hit_spans").to_pylist()):
                if spans:
                    at = [m.span() for m in WORD.finditer(texts[k])]
                    for s in reversed(spans):
                        texts[k] = texts[k][: at[s["start"]][0]] + texts[k][at[s["end"] - 1][1] :]
            yield batch.set_column(batch.schema.names.index(text), text, pa.array(texts, batch.schema.field(text).type))

    left = F.col("n_words") > F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return marked.where((F.size("hit_spans") == 0) | left).mapInArrow(run, marked.schema).drop("n_words", "hit_spans", "hit_items")
