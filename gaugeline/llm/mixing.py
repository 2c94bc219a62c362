"""Text probabilities by logistic mixing of bit predictors by context, refined adaptively.

Every word is a byte string with a closing sign, every byte a path of binary decisions. The contexts of bytes stay within the word,
so what its letters tell of a word in a class of texts (their language, say) is worked out once per distinct word. Every text
is then read in the order of its words: the word before, of which all that followed it in learned texts is counted, and the letters each tell
the next one, and how far the word before is trusted follows the words read so far, as does the mixture over the classes.
What is counted and learned grows with the distinct words and pairs of neighbours; every text is read twice, whole: to count
its words and to be told word by word.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm.common import hand_back, one_in, pieces_of, scratch, spaced_words
from gaugeline.session import checkpointed

#: Text bytes counted at a time, word bytes mixed at a time (a block).
BLOCK, WORDS = 12 << 20, 1 << 19
#: Rows of the count table whose decisions are looked up at a time.
ROWS = 1 << 16
#: The predictors (the last two bytes, three, four, the word so far): which context, and whether the class is part of it.
PREDICTORS = (("two", True), ("three", True), ("four", False), ("word", True))
#: Words that every task knows, all others are joined; classes besides the rest.
HEAD, CLASSES = 1 << 18, 7
GATES, CELLS = 16, 25
#: Gates of the word before, by how often it is known; words a gate's share counts as where a text refines it.
BEFORE, TRUST = 12, 8
#: Added to both counts of a decision before their ratio is taken.
PRIOR = 0.05
_PAD = b"\x00\x00\x00\x00"
_U = np.uint64
_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)


def code_paths(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A binary tree over the 256 bytes, frequent bytes near its root: length, nodes and bits of each byte's path."""
    heap = [(int(c) + 1, s, s) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    children, fresh = {}, 256
    while len(heap) > 1:
        (a, _, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        children[fresh] = (left, right)
        heapq.heappush(heap, (a + b, fresh, fresh))
        fresh += 1
    paths: dict[int, list[tuple[int, int]]] = {}
    todo: list[tuple[int, list]] = [(heap[0][2], [])]
    while todo:
        node, path = todo.pop()
        if node < 256:
            paths[node] = path
        else:
            todo += [(child, [*path, (node - 256, bit)]) for bit, child in enumerate(children[node])]
    depth = max(map(len, paths.values()))
    length, nodes, bits = np.zeros(256, np.int64), np.zeros((256, depth), np.int64), np.zeros((256, depth), bool)
    for symbol, path in paths.items():
        length[symbol] = len(path)
        nodes[symbol, : len(path)], bits[symbol, : len(path)] = zip(*path)
    return length, nodes, bits


class Decisions:
    """The binary decisions of some words: bits, how many each word has, and per predictor the contexts they stand in.

    A context and the byte after it are a pair; the decisions on the path of that byte are its nodes. ``contexts[k]`` are the distinct
    contexts of the k-th predictor (64 bits: the bytes themselves, or a hash of the word so far), ``pairs[k]`` place of context * 256 + byte,
    ``nodes[k]`` the distinct place of context * 256 + node."""

    def __init__(self, words: list[bytes], code: tuple):
        self.code = code
        x = np.frombuffer(b"".join(_PAD + w for w in words), np.uint8)
        self.sizes = sizes = np.array([len(w) for w in words])
        begin = (sizes + len(_PAD)).cumsum() - sizes
        coded = np.ones(len(x), bool)
        for k in range(1, len(_PAD) + 1):
            coded[begin - k] = False
        at, wide = np.flatnonzero(coded), x.astype(_U)
        back = [wide[at - k] for k in range(1, 5)]
        # The hash of the word so far: a difference of running sums, brought to the same power wherever it stands.
        power, inverse = (np.concatenate([np.ones(1, _U), np.full(len(x) - 1, p, _U)]).cumprod(dtype=_U) for p in (_P, _INVERSE))
        total = np.concatenate([np.zeros(1, _U), ((wide + _U(1)) * power).cumsum(dtype=_U)[:-1]])
        start = np.repeat(begin, sizes)
        four = _U(1 << 32) | back[0] << _U(24) | back[1] << _U(16) | back[2] << _U(8) | back[3]
        word = ((total[at] - total[start]) * inverse[start]).view(np.int64)
        symbol = x[at].astype(np.int64)
        self.begin = sizes.cumsum() - sizes
        made = {}
        # Four bytes hold three, and three two: only the pairs found are sorted again.
        pairs, place = np.unique(four.view(np.int64) << 8 | symbol, return_inverse=True)
        for cut, name in ((0, "four"), (8, "three"), (16, "two")):
            contexts, own = np.unique(pairs >> 8, return_inverse=True)
            # The sign above them tells the contexts of one length from those of another.
            made[name] = contexts - (1 << 32 - cut) + (1 << 56 - cut), own << 8 | pairs & 255, place
            if name != "two":
                pairs, again = np.unique(contexts[own] >> 8 << 8 | pairs & 255, return_inverse=True)
                place = again[place]
        contexts, own = np.unique(word, return_inverse=True)
        pairs, place = np.unique(own << 8 | symbol, return_inverse=True)
        made["word"] = contexts, pairs, place
        self.contexts, self.pairs, self.places = (list(c) for c in zip(*(made[name] for name, _ in PREDICTORS)))
        self.nodes = []

    def expand(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per pair and decision on its path: which pair, place of context * 256 + node, and bit; and the first row of each pair."""
        length, nodes, bits = self.code
        count = length[pairs & 255]
        first = count.cumsum() - count
        which = np.repeat(np.arange(len(pairs)), count)
        step = np.arange(len(which)) - first[which]
        symbol = (pairs & 255)[which]
        return which, (pairs >> 8)[which] << 8 | nodes[symbol, step], bits[symbol, step], first

    def locate(self) -> None:
        """Fills ``nodes``, and for the decisions of each distinct word so far and byte after it, of which all predictors say the same,
        ``bits``, the place in ``nodes`` of each predictor (``steps``), the pair (``which``) and the first one of a pair (``first``)."""
        self.slots, self.firsts = [], []
        for pairs in self.pairs:
            which, keys, bits, first = self.expand(pairs)
            nodes, slot = np.unique(keys, return_inverse=True)
            self.nodes.append(nodes)
            self.slots.append(slot.astype(np.int32))
            self.firsts.append(first)
        self.which, self.bits, self.first = which.astype(np.int32), bits, first
        one = np.empty(len(self.pairs[-1]), np.int64)
        one[self.places[-1]] = np.arange(len(self.places[-1]))
        step = np.arange(len(which)) - first[which]
        self.steps = [slot[first[place[one]][which] + step] for slot, first, place in zip(self.slots, self.firsts, self.places)]

    @property
    def at(self) -> list[np.ndarray]:
        """Per predictor the place in ``nodes`` of every decision of the words, one after the other."""
        count = self.code[0][self.pairs[-1] & 255][self.places[-1]]
        return [slot[_slices(first[place], count)] for slot, first, place in zip(self.slots, self.firsts, self.places)]

    def weight(self, counts: np.ndarray) -> np.ndarray:
        """How often each of the located decisions occurs when the words occur ``counts`` times."""
        return np.bincount(self.places[-1], np.repeat(counts, self.sizes), len(self.first))[self.which]

    def per_word(self, values: np.ndarray) -> np.ndarray:
        """Sums over the decisions of each word."""
        return np.add.reduceat(np.add.reduceat(values, self.first)[self.places[-1]], self.begin)

    def found(self, k: int, places: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows (place of context, byte) of the count table the decisions at ``nodes[k]``: which row, and place of the node * 2 + bit."""
        rows, slots = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for lo in range(0, len(places), ROWS):
            which, keys, bits, _ = self.expand(places[lo : lo + ROWS] << 8 | symbols[lo : lo + ROWS])
            slot = np.minimum(np.searchsorted(self.nodes[k], keys), len(self.nodes[k]) - 1)
            inside = self.nodes[k][slot] == keys
            rows.append((which[inside] + lo).astype(np.int32))
            slots.append(slot[inside] * 2 + bits[inside])
        return np.concatenate(rows), np.concatenate(slots)

    def sums(self, k: int, which: np.ndarray, slot: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Zeros and ones (2, node) at ``nodes[k]`` from what ``found`` gives and the counts of its rows."""
        # Weights of bincount are doubles: exact up to 2**53 sights of a context.
        return np.bincount(slot, counts[which], 2 * len(self.nodes[k])).reshape(-1, 2).T.astype(np.int64)

    def counted(self, k: int, contexts: np.ndarray, symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Zeros and ones (2, class, node) at ``nodes[k]`` from rows of the count table that hold all bytes seen after ``contexts``."""
        counts = counts if PREDICTORS[k][1] else counts.sum(1, keepdims=True)
        which, slot = self.found(k, np.searchsorted(self.contexts[k], contexts), symbols)
        return np.stack([self.sums(k, which, slot, counts[:, g]) for g in range(counts.shape[1])], 1)


def _words_of(table: pa.Table | pa.RecordBatch, classes: int) -> tuple[list[bytes], np.ndarray]:
    """Words with their closing sign, and their counts per class. The null word is the end of a text."""
    words = [b"\n" if w is None else w.encode() + b" " for w in table.column("word").to_pylist()]
    return words, np.column_stack([table.column(f"c{g}").to_numpy() for g in range(classes)])


def _byte_counts(classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in pieces_of(batches, "word", WORDS):
            words, counts = _words_of(batch, classes)
            sizes = [len(w) for w in words]
            total += np.bincount(np.frombuffer(b"".join(words), np.uint8), np.repeat(counts.sum(1), sizes), 256).astype(np.int64)
        yield pa.record_batch([pa.array(np.arange(256)), pa.array(total)], ["byte", "n"])

    return run


def _grams(code: tuple, classes: int):
    """Of a block of words the distinct pairs of each predictor and how often each occurs per class; ``lead`` marks one pair per context."""

    def run(group: pa.Table) -> pa.Table:
        words, counts = _words_of(group, classes)
        d, block = Decisions(words, code), group.column("block")[0].as_py()
        parts = []
        for k, (contexts, pairs, place) in enumerate(zip(d.contexts, d.pairs, d.places)):
            own = pairs >> 8
            lead = np.concatenate([[True], own[1:] != own[:-1]])
            sums = [np.bincount(place, np.repeat(counts[:, g], d.sizes), len(pairs)).astype(np.int64) for g in range(classes)]
            columns = [np.full(len(pairs), block, np.int32), np.full(len(pairs), k, np.int8), contexts[own], (pairs & 255).astype(np.int16), lead, *sums]
            parts.append(pa.table([pa.array(c) for c in columns], ["block", "k", "context", "symbol", "lead", *(f"c{g}" for g in range(classes))]))
        return pa.concat_tables(parts)

    return run


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers, their lowest bytes first, then the next ones as far as they are needed: mostly runs of 0, which are compressed."""
    plain = np.ascontiguousarray(values, "<i8").ravel().view("<u8")
    width = max(1, -(-int(plain.max()).bit_length() // 8)) if len(plain) else 1
    planes = b"".join((plain >> _U(8 * k)).astype(np.uint8).tobytes() for k in range(width))
    return bytes([width]) + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(data: bytes, count: int) -> np.ndarray:
    out = np.zeros(count, np.int64)
    if count:
        planes = np.frombuffer(pa.decompress(data[1:], data[0] * count, "zstd", asbytes=True), np.uint8).reshape(-1, count)
        for k, plane in enumerate(planes):
            out |= plane.astype(np.int64) << 8 * k
    return out


def _slices(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each slice, one after the other."""
    return np.arange(counts.sum()) + np.repeat(first - (counts.cumsum() - counts), counts)


def _dealt(contexts: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of a block's contexts in the order of the parts they are dealt to, and where each part begins."""
    h = contexts.view(_U) * _U(_P)
    part = ((h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93) >> _U(32)) % _U(parts)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1, dtype=_U))


_PIECE = "block int, kind int, part int, n int, contexts binary, per binary, symbols binary, counts binary"
_ANSWER = "block int, kind int, part int, per binary, symbols binary, counts binary"


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    names, kinds = zip(*(column.split() for column in schema.split(", ")))
    return pa.table([pa.array(c, pa.int32() if kind == "int" else pa.binary()) for c, kind in zip(zip(*rows), kinds)], list(names))


def _values(table: pa.Table, names: tuple[str, ...]) -> Iterator[tuple]:
    return zip(*(table.column(c).to_pylist() for c in names))


def _pieces(code: tuple, classes: int, parts: int):
    """The rows of ``_grams``, one per predictor and part of its contexts: how many contexts, the contexts, how many bytes follow each,
    these bytes, and how often each does per class (in all where the class is no part of the context)."""

    def run(group: pa.Table) -> pa.Table:
        rows, block, out = _grams(code, classes)(group), group.column("block")[0].as_py(), []
        ends = np.searchsorted(rows.column("k").to_numpy(), np.arange(len(PREDICTORS) + 1))
        for k, (_, by_class) in enumerate(PREDICTORS):
            own = rows.slice(ends[k], ends[k + 1] - ends[k])
            contexts, symbols = (own.column(c).to_numpy() for c in ("context", "symbol"))
            sums = np.stack([own.column(f"c{g}").to_numpy() for g in range(classes)])
            sums = sums if by_class else sums.sum(0, keepdims=True)
            lead = np.flatnonzero(own.column("lead").to_numpy())
            order, begin = _dealt(contexts[lead], parts)
            per = np.diff(lead, append=own.num_rows)
            lead, per = lead[order], per[order]
            for part in np.flatnonzero(np.diff(begin)).tolist():
                mine = slice(begin[part], begin[part + 1])
                at = _slices(lead[mine], per[mine])
                out.append((block, k, part, len(per[mine]), *map(_packed, (contexts[lead[mine]], per[mine], symbols[at], sums[:, at]))))
        hand_back()
        return _rows(_PIECE, out)

    return run


def _followers(classes: int):
    """Of a part of a predictor's contexts, from the pieces of all blocks: for each piece the bytes that follow its contexts in the
    learned words of any block, in the order of the piece, with their counts."""

    def run(group: pa.Table) -> pa.Table:
        kind, part = group.column("kind")[0].as_py(), group.column("part")[0].as_py()
        width, n = classes if PREDICTORS[kind][1] else 1, group.column("n").to_pylist()
        contexts, per = (np.concatenate([_unpacked(x, m) for (x,), m in zip(_values(group, (c,)), n)]) for c in ("contexts", "per"))
        ends = np.cumsum([0, *n])
        sizes = [int(per[lo:hi].sum()) for lo, hi in zip(ends[:-1], ends[1:])]
        symbols = np.concatenate([_unpacked(x, m) for (x,), m in zip(_values(group, ("symbols",)), sizes)])
        contexts, place = np.unique(contexts, return_inverse=True)
        pairs, slot = np.unique(np.repeat(place, per) << 8 | symbols, return_inverse=True)
        sums, lo = np.zeros((width, len(pairs)), np.int64), 0
        for (x,), m in zip(_values(group, ("counts",)), sizes):
            sums[:, slot[lo : lo + m]] += _unpacked(x, width * m).reshape(width, m)  # the pairs of a piece are distinct
            lo += m
        seen = sums.any(0)
        pairs, sums = pairs[seen], sums[:, seen]
        per, out = np.bincount(pairs >> 8, minlength=len(contexts)), []
        first = per.cumsum() - per
        for (block,), lo, hi in zip(_values(group, ("block",)), ends[:-1], ends[1:]):
            at = place[lo:hi]
            rows = _slices(first[at], per[at])
            out.append((block, kind, part, *map(_packed, (per[at], pairs[rows] & 255, sums[:, rows]))))
        hand_back()
        return _rows(_ANSWER, out)

    return run


#: ``np.log(n + PRIOR)`` of small counts.
_LOGS = np.log(np.arange(1 << 12) + PRIOR)


def _log(counts: np.ndarray) -> np.ndarray:
    small = counts < len(_LOGS)
    out = _LOGS[np.where(small, counts, 0)]
    out[~small] = np.log(counts[~small] + PRIOR)
    return out


def _inputs(tables: list[np.ndarray], d: Decisions, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The stretched probabilities and the gate of each located decision in a class, from its zeros and ones (2, node) of each
    predictor; with ``rows`` of these decisions only, and one sight of each is left out."""
    bits = d.bits if rows is None else d.bits[rows]
    x, gate = np.empty((len(bits), len(PREDICTORS)), np.float32), np.zeros(len(bits), np.int8)
    for k, (name, _) in enumerate(PREDICTORS):
        zeros, ones = tables[k]
        if rows is not None:
            at = d.steps[k][rows]
            zeros, ones = zeros[at], ones[at]
            ones = ones - (bits & (ones > 0))
            zeros = zeros - (~bits & (zeros > 0))
            x[:, k] = _log(ones) - _log(zeros)
        else:  # per node first: a node has many decisions
            x[:, k] = (_log(ones) - _log(zeros))[d.steps[k]]
        if name in ("three", "word"):
            n = zeros + ones
            level = (n > 0).astype(np.int8) + (n > 3) + (n > 31)
            gate = gate * np.int8(4) + (level if rows is not None else level[d.steps[k]])
    return x, gate


def _fitted(w: np.ndarray, x: np.ndarray, bits: np.ndarray, weight: np.ndarray, pull: float) -> np.ndarray:
    """The weights of least log loss on some decisions, drawn to the weights so far: Newton steps, halved until they help."""
    x, sign = x.astype(float), np.where(bits, -1.0, 1.0)

    def loss(new: np.ndarray) -> tuple[np.ndarray, float]:
        dot = x @ new
        cost = np.maximum(sign * dot, 0) + np.log(1 + np.exp(-np.abs(dot)))
        return dot, float(weight @ cost) + 0.5 * pull * float((new - w) @ (new - w))

    now, (dot, least) = w, loss(w)
    for _ in range(3):
        p = 1 / (1 + np.exp(-np.clip(dot, -30, 30)))
        slope = x.T @ (weight * (p - bits)) + pull * (now - w)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), slope)
        for _ in range(10):
            dot, cost = loss(now - step)
            if cost < least:
                break
            step = step / 2
        else:
            break
        now, before, least = now - step, least, cost
        if before - least < 1e-4 * before:
            break
    return now


def _learned(code: tuple, classes: int, parts: int):
    """Of a block of words and what follows its contexts anywhere (rows of ``_followers``): the words with the counts at their nodes, the weights
    that suit the block (null at a gate without decisions), and the adaptive map: ones and chances per gate and cell.

    Every decision counts as often as its word occurs in the class, each time without its own sight in the tables."""

    def run(group: pa.Table, seen: pa.Table) -> pa.Table:
        words, counts = _words_of(group, classes)
        d = Decisions(words, code)
        d.locate()
        rows = []
        for k, (_, by_class) in enumerate(PREDICTORS):
            (order, begin), width, found = _dealt(d.contexts[k], parts), classes if by_class else 1, []
            for part, per, *data in _values(seen.filter(pc.equal(seen.column("kind"), k)), ("part", "per", "symbols", "counts")):
                own = order[begin[part] : begin[part + 1]]
                per = _unpacked(per, len(own))
                n = int(per.sum())
                found.append((np.repeat(own, per), _unpacked(data[0], n), _unpacked(data[1], width * n).reshape(width, n)))
            places, symbols, sums = zip(*found)
            rows.append((*d.found(k, np.concatenate(places), np.concatenate(symbols)), np.concatenate(sums, 1)))
            del found, places, symbols, sums
        # One class after the other: a node is known in few of them, and tables of all would hold mostly zeros.
        shared = {k: d.sums(k, which, slot, sums[0]) for k, (which, slot, sums) in enumerate(rows) if not PREDICTORS[k][1]}
        packed, parts_of = {(k, 0): _packed(t) for k, t in shared.items()}, []
        for g in range(classes):
            tables = [shared[k] if k in shared else d.sums(k, which, slot, sums[g]) for k, (which, slot, sums) in enumerate(rows)]
            packed |= {(k, g): _packed(t) for k, t in enumerate(tables) if k not in shared}
            weight = d.weight(counts[:, g])
            used = np.flatnonzero(weight)
            parts_of.append((*_inputs(tables, d, used), weight[used], d.bits[used]))
            del tables, weight, used
        del shared, rows
        x, gate, weight, bits = (np.concatenate(c) for c in zip(*parts_of))
        del parts_of
        start = np.full(len(PREDICTORS), 1 / len(PREDICTORS))
        w, empty = np.tile(start, (GATES, 1)), np.ones(GATES, bool)
        ones, times = np.zeros((2, GATES, CELLS))
        for own in range(GATES):
            at = np.flatnonzero(gate == own)
            if len(at):
                inside, chance, hit = x[at], weight[at], bits[at]
                w[own], empty[own] = _fitted(start, inside, hit, chance, 5.0), False
                cell = _cell(np.einsum("ij,j->i", inside, w[own]))
                ones[own], times[own] = (np.bincount(cell, n, CELLS) for n in (chance * hit, chance))
        del x, gate, weight, bits
        ones, times = ones.ravel(), times.ravel()
        state = pa.array(np.concatenate([w.ravel(), ones, times]), mask=np.concatenate([np.repeat(empty, len(PREDICTORS)), np.zeros(2 * GATES * CELLS, bool)]))
        del d
        hand_back()
        return pa.table(
            [
                pa.ListArray.from_arrays(pa.array([0, len(state)], pa.int32()), state),
                *(pa.array([group.column(c).to_pylist()], pa.list_(kind)) for c, kind in (("word", pa.string()), ("times", pa.int64()))),
                pa.array([counts.ravel()], pa.list_(pa.int64())),
                pa.array([[packed[k] for k in sorted(packed)]], pa.list_(pa.binary())),
            ],
            ["state", "words", "times", "counts", "tables"],
        )

    return run


def _cell(dot: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(dot * 1.5, -12, 12)).astype(np.int64) + 12


def _word_logs(shared: Broadcast, classes: int, below: float):
    """Per word its base term and its log10 probability in each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, w, refined = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                words, times, counts, packed = (batch.column(c)[k] for c in ("words", "times", "counts", "tables"))
                counts = counts.values.to_numpy().reshape(-1, classes)
                d = Decisions([b"\n" if x is None else x.encode() + b" " for x in words.as_py()], code)
                d.locate()
                places = [(j, g) for j, (_, by_class) in enumerate(PREDICTORS) for g in range(classes if by_class else 1)]
                packed = dict(zip(places, packed.as_py()))
                logs = [np.log10(counts.sum(1) + 0.1) - below]
                for g in range(classes):
                    own = [packed[j, g if by_class else 0] for j, (_, by_class) in enumerate(PREDICTORS)]
                    x, gate = _inputs([_unpacked(t, 2 * len(nodes)).reshape(2, -1) for t, nodes in zip(own, d.nodes)], d)
                    dot = np.einsum("ij,ij->i", x, w[gate])
                    p = 0.75 / (1 + np.exp(-np.clip(dot, -30, 30))) + 0.25 * refined[gate * np.int64(CELLS) + _cell(dot)]
                    p = np.clip(p, 1e-7, 1 - 1e-7)
                    logs.append(d.per_word(np.log10(np.where(d.bits, p, 1 - p))))
                logs = pa.FixedSizeListArray.from_arrays(pa.array(np.column_stack(logs).ravel()), classes + 1).cast(pa.list_(pa.float64()))
                yield pa.record_batch([words.values, pa.array(counts.sum(1)), times.values, logs], ["word", "c", "times", "logs"])

    return run


def _counted(classes: int):
    """Rows (word, c0, c1, ..., times): how often each word, and the end (null), occurs in the learned texts of each class and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", BLOCK):
            words, counts = spaced_words(batch.column("text"))
            coded = words.dictionary_encode()
            own = batch.column("class").to_numpy()  # the class past the last holds the held-out texts
            size = len(coded.dictionary)
            each = np.bincount(coded.indices.to_numpy() * (classes + 1) + np.repeat(own, counts), minlength=size * (classes + 1)).reshape(size, -1)
            each = np.vstack([each, np.bincount(own, minlength=classes + 1)])
            names = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.nulls(1, pa.string())])
            columns = [names, *(pa.array(each[:, g]) for g in range(classes)), pa.array(each.sum(1))]
            yield pa.record_batch(columns, ["word", *(f"c{g}" for g in range(classes)), "times"])

    return run


_TEXTS = "block long, ids array<{id}>, learned array<boolean>, counts array<long>, bytes array<long>, words array<string>, codes binary"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of texts in their order: of each text its id, whether it is learned, its words and bytes; the distinct words, and the words of all
    texts, one after the other, as places among these."""
    block = TaskContext.get().partitionId() << 32
    for batch in pieces_of(batches, "text", BLOCK // 3):
        words, counts = spaced_words(batch.column("text"))
        coded = words.dictionary_encode()
        at, own = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(counts)), counts)
        size = np.bincount(own, pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False)[at] + 1, len(counts)) + 1
        each = [batch.column("id"), batch.column("learned"), pa.array(counts.astype(np.int64)), pa.array(size.astype(np.int64)), coded.dictionary.cast(pa.string())]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in each]
        yield pa.record_batch([pa.array([block]), *lists, pa.array([_packed(at)], pa.binary())], ["block", "ids", "learned", "counts", "bytes", "words", "codes"])
        block += 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(_P)
    return h ^ (h >> _U(32))


def _hashes(words: pa.Array) -> np.ndarray:
    """64 bits of each word, and of the end and the beginning of a text."""
    joined = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "")[0].as_buffer(), np.uint8)
    length = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    edges = np.concatenate([[0], length.cumsum()])
    power, inverse = (np.concatenate([np.ones(1, _U), np.full(len(joined), p, _U)]).cumprod(dtype=_U) for p in (_P, _INVERSE))
    total = np.concatenate([np.zeros(1, _U), ((joined.astype(_U) + _U(1)) * power[:-1]).cumsum(dtype=_U)])
    each = (total[edges[1:]] - total[edges[:-1]]) * inverse[edges[:-1]]
    return np.concatenate([_mixed(each + length.view(_U)), np.array([1, 2], _U)])


def _ordered(words: pa.Array, counts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a block, for every word and end in the order of the texts: its text, its place among the words (the end comes after these), the
    place of the one before it (the beginning comes after the end), and its place in the sorted distinct pairs; and these."""
    n = len(counts)
    text = np.repeat(np.arange(n), counts + 1)
    last = (counts + 1).cumsum() - 1
    now, inside = np.full(len(text), len(words)), np.ones(len(text), bool)
    inside[last] = False
    now[inside] = codes
    before = np.concatenate([[0], now[:-1]])
    before[last - counts] = len(words) + 1
    h = _hashes(words)
    pairs, place = np.unique(_mixed(h[before] * _U(_P) + h[now]), return_inverse=True)
    return text, now, before, place, pairs


def _known(words: pa.Array, head: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The place of each word in the head (-1: outside), and the gate of what comes after it; the last two gates are of an end and a beginning."""
    names, seen, _ = head
    place = pc.fill_null(pc.index_in(words, value_set=names.cast(pa.string())), -1).to_numpy(zero_copy_only=False)
    level = np.zeros(len(words), np.int8)
    level[place >= 0] = 1 + np.minimum(np.log2(1 + seen[place[place >= 0]]) / 2, BEFORE - 3)
    return place, np.concatenate([level, np.array([0, BEFORE - 1], np.int8)])


def _block_of(group: pa.Table | pa.RecordBatch, k: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words, words of each text, all words as places, and which texts are learned."""
    counts = group.column("counts")[k].values.to_numpy()
    codes = _unpacked(group.column("codes")[k].as_py(), int(counts.sum()))
    return group.column("words")[k].values, counts, codes, group.column("learned")[k].values.to_numpy(zero_copy_only=False)


def _edges(pairs: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The least pair of each part, and where in sorted pairs each part begins and the last one ends."""
    least = np.array([(k << 64) // parts for k in range(parts)], _U)
    return least, np.append(np.searchsorted(pairs, least), len(pairs))


_PAIRS = "block long, part int, n int, pairs binary, counts binary, gates binary"
_SEEN = "block long, part int, word string, c long, counts binary, logs array<double>"


def _pairs(shared: Broadcast, parts: int):
    """Of each block of texts the distinct pairs of a word and the one before it, in parts: how often they occur in learned texts, and their gates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words, counts, codes, learned = _block_of(batch, k)
                text, _, before, place, pairs = _ordered(words, counts, codes)
                n, gates = np.bincount(place[learned[text]], minlength=len(pairs)), np.zeros(len(pairs), np.int8)
                gates[place] = _known(words, shared.value)[1][before]
                least, edges = _edges(pairs, parts)
                block, used = batch.column("block")[k].as_py(), np.flatnonzero(np.diff(edges)).tolist()
                cut = [slice(edges[part], edges[part + 1]) for part in used]
                steps = [np.diff(pairs[own], prepend=least[part]).view(np.int64) for part, own in zip(used, cut)]
                data = [steps, [n[own] for own in cut], [gates[own] for own in cut]]
                columns = [pa.array([block] * len(used)), *(pa.array(c, pa.int32()) for c in (used, map(len, steps))), *(pa.array(list(map(_packed, c)), pa.binary()) for c in data)]
                yield pa.record_batch(columns, ["block", "part", "n", "pairs", "counts", "gates"])
        hand_back()

    return run


def _pair_counts(parts: int):
    """For each piece how often its pairs occur in the learned texts of any block; and with block -1 per gate how many words come there, and
    how many of them still follow the word before them somewhere when their own sight is left out."""

    def run(group: pa.Table) -> pa.Table:
        part, edges = group.column("part")[0].as_py(), np.cumsum([0, *group.column("n").to_pylist()])
        least = _U((part << 64) // parts)
        asked = [least + _unpacked(x, n).view(_U).cumsum(dtype=_U) for x, n in _values(group, ("pairs", "n"))]
        pairs, place = np.unique(np.concatenate(asked), return_inverse=True)
        del asked
        n, gates = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int8)
        for (x, g), lo, hi in zip(_values(group, ("counts", "gates")), edges[:-1], edges[1:]):
            n[place[lo:hi]] += _unpacked(x, hi - lo)  # the pairs of a piece are distinct
            gates[place[lo:hi]] = _unpacked(g, hi - lo)
        totals = np.concatenate([np.bincount(gates, n, BEFORE), np.bincount(gates, n * (n > 1), BEFORE)])
        blocks = [*(b for (b,) in _values(group, ("block",))), -1]
        out = [_packed(n[place[lo:hi]]) for lo, hi in zip(edges[:-1], edges[1:])]
        none = [None] * len(blocks)
        columns = (blocks, [part] * len(blocks), none, none, [*out, None], [*none[:-1], totals.tolist()])
        hand_back()
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.float64()))
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["block", "part", "word", "c", "counts", "logs"])

    return run


def _outside(shared: Broadcast):
    """The words of each block that the head does not hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words = batch.column("words")[k].values
                words = words.filter(pa.array(_known(words, shared.value)[0] < 0))
                yield pa.record_batch([pa.array(np.full(len(words), batch.column("block")[k].as_py())), words], ["block", "word"])
        hand_back()

    return run


def _chances(text: np.ndarray, gate: np.ndarray, told: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The chance that a word is told by the one before it: the share of its gate, refined by the words of that gate so far in its text."""
    key = text * np.int64(BEFORE) + gate
    order = np.argsort(key, kind="stable")
    key, hit = key[order], told[order].cumsum() - told[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    run = np.repeat(first, np.diff(first, append=len(key)))
    out = np.empty(len(key))
    out[order] = (TRUST * share[gate[order]] + hit - hit[run]) / (TRUST + np.arange(len(key)) - run)
    return out


def _told(shared: Broadcast, share: np.ndarray, ends: list[float], texts: int, parts: int):
    """Of a block of texts with what its words and pairs are worth (rows of ``_SEEN``), read word by word in their order: per text the sum
    of the base terms, and in each class of the logarithms of the mixtures of what the word before tells and what the letters tell."""

    def run(group: pa.Table, seen: pa.Table) -> pa.Table:
        words, counts, codes, learned = _block_of(group, 0)
        names, known, table = shared.value
        width, (place, gates) = table.shape[1], _known(words, shared.value)
        logs, c = np.zeros((len(words) + 1, width)), np.zeros(len(words) + 2, np.int64)
        logs[:-1][place >= 0], c[:-2][place >= 0], logs[-1], c[-1] = table[place[place >= 0]], known[place[place >= 0]], ends, texts
        outer = seen.filter(pc.is_valid(seen.column("word")))
        if outer.num_rows:
            at = pc.index_in(outer.column("word").combine_chunks(), value_set=words).to_numpy()
            logs[at], c[at] = outer.column("logs").combine_chunks().flatten().to_numpy().reshape(-1, width), outer.column("c").to_numpy()
        text, now, before, place, pairs = _ordered(words, counts, codes)
        (_, edges), n = _edges(pairs, parts), np.zeros(len(pairs), np.int64)
        for part, x in _values(seen.filter(pc.is_valid(seen.column("part"))), ("part", "counts")):
            n[edges[part] : edges[part + 1]] = _unpacked(x, edges[part + 1] - edges[part])
        own = learned[text].astype(np.int64)  # a learned word is told without its own sight
        pair, of = n[place] - own, c[before] - own
        told = pair > 0
        chance = np.where(of > 0, _chances(text, gates[before], told, share), 0.0)
        rest = np.log10(1 - chance)
        at, plain = now[told], np.power(10.0, logs)
        follows, other = chance[told] * pair[told] / of[told], 1 - chance[told]
        sums = [np.bincount(text, logs[now, 0], len(counts))]
        for k in range(1, width):
            value = logs[now, k] + rest
            value[told] = np.log10(follows + other * plain[at, k])
            sums.append(np.bincount(text, value, len(counts)))
        known = np.bincount(text, (np.append(c[:-2], texts) > 0)[now], len(counts))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(np.column_stack(sums).ravel()), width).cast(pa.list_(pa.float64()))
        columns = [group.column("ids")[0].values, pa.array(counts + 1), pa.array(known.astype(np.int64)), group.column("bytes")[0].values, lists]
        hand_back()
        return pa.table(columns, ["id", "n", "known", "bytes", "sums"])

    return run


def _head(logs: DataFrame) -> DataFrame:
    """The most frequent words, ``HEAD`` at most: those above a frequency that a count per sixteenth of a power of two tells, so that no
    task sorts the words of all others."""
    level, room, least = F.floor(F.log2("times") * 16), HEAD, None
    named = logs.where("word is not null")
    for r in named.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect():
        room -= r["n"]
        if room < 0:
            break
        least = r["level"]
    return named.where(F.lit(False) if least is None else level >= least)


def score(docs: DataFrame, held_out: Callable[[Column], Column] = lambda doc_id: one_in(doc_id, 10), text: str = "text", key: str = "doc_id", group: str | None = "lang") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability) and bits_per_byte.

    Texts are taken as their lower-cased words in order and an end. All rows that are not held out are learned from: words
    are counted per class (``group``, of which the commonest values and the rest make classes; none: one class), the
    bytes after each context, which every block of distinct words counts for itself; the counts of all blocks meet per part of the contexts and
    go back to the blocks that have the context; and the mixing weights, which are averaged over the blocks. Pairs of a word and the one
    before it are counted the same way per block of texts, over the ends of blocks and files. A text is scored in its order: each word by what its letters tell,
    mixed with what followed the word before in learned texts (without the word's own sight, where it is learned itself); the chance of the latter is
    learned by how often the word before is known and refined with every word of the text. The group of a
    text is not used when it is scored: its classes are weighted by how well they have told its words so far, which comes to the
    logarithm of the weighted sum of the classes' probabilities.
    Cases: null and blank texts are the end alone; every row is scored, repeated or not; a null id counts as '', a null
    group as the rest; an empty table gives no rows; without learned rows all predictors are even; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    by = F.col(group).cast("string") if group and group in docs.columns else F.lit("")
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), by.alias("g"))
    learned = ~held_out(F.col("id"))
    sizes = rows.where(learned).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    common = [r["g"] for r in sizes.orderBy(F.desc("n"), "g").limit(CLASSES + 1).collect()]
    common = common if len(common) <= CLASSES and None not in common and common else [g for g in common if g is not None][: CLASSES - 1] + [None]
    classes = len(common)  # the last one also takes what is in no other
    place = F.lit(classes - 1)
    for k, value in enumerate(common[:-1]):
        place = F.when(F.col("g") == value, k).otherwise(place)
    place = F.when(learned, place).otherwise(classes).cast("int")
    names = [f"c{g}" for g in range(classes)]

    with scratch(spark) as kept:
        counted = rows.select("text", place.alias("class")).mapInArrow(_counted(classes), ", ".join(["word string", *(f"{c} long" for c in names), "times long"]))
        words = kept(counted.groupBy("word").agg(*(F.sum(c).alias(c) for c in [*names, "times"])))
        seen = sum((F.col(c) for c in names), F.lit(0))
        totals = words.agg(F.sum(seen).alias("n"), F.sum((seen > 0).cast("long")).alias("v"), F.sum(F.octet_length("word") + 1).alias("bytes"), *(F.sum(F.when(F.col("word").isNull(), F.col(c))).alias(c) for c in names)).first()
        n, v = totals["n"] or 0, totals["v"] or 0
        below = math.log10(n + 0.1 * (v + 1))
        texts = np.array([totals[c] or 0 for c in names], float)
        prior = np.log10((texts + 0.5) / (texts.sum() + 0.5 * classes))

        histogram = np.zeros(256, np.int64)
        for r in words.mapInArrow(_byte_counts(classes), "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
            histogram[r["byte"]] = r["n"]
        code = code_paths(histogram)
        blocks = -(-int(totals["bytes"] or 0) // WORDS) or 1
        words = kept(words.withColumn("block", F.pmod(F.xxhash64("word"), F.lit(blocks)).cast("int")), words)
        grams = words.groupBy("block").applyInArrow(_pieces(code, classes, blocks), _PIECE)
        found = grams.groupBy("kind", "part").applyInArrow(_followers(classes), _ANSWER)
        schema = "state array<double>, words array<string>, times array<long>, counts array<long>, tables array<binary>"
        mixed = kept(words.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_learned(code, classes, blocks), schema), words)
        state = mixed.select(F.posexplode("state").alias("k", "s"))
        cut = GATES * len(PREDICTORS)
        state = {r["k"]: r["mean"] if r["k"] < cut else r["sum"] for r in state.groupBy("k").agg(F.avg("s").alias("mean"), F.sum("s").alias("sum")).collect()}
        state = np.array([1 / len(PREDICTORS) if k < cut and state.get(k) is None else state.get(k) or 0.0 for k in range(cut + 2 * GATES * CELLS)])
        even = 1 / (1 + np.exp(-(np.arange(CELLS) - 12) / 1.5))
        ones, times = state[cut : cut + GATES * CELLS], state[cut + GATES * CELLS :]
        refined = (ones + 10 * np.tile(even, GATES)) / (times + 10)
        model = spark.sparkContext.broadcast((code, state[:cut].reshape(GATES, -1), refined))
        logs = kept(mixed.drop("state").mapInArrow(_word_logs(model, classes, below), "word string, c long, times long, logs array<double>"), mixed)

        top = _head(logs).select("word", "c", "logs").toArrow().combine_chunks()
        words_of_head, seen_of_head, logs_of_head = (top.column(c).combine_chunks() for c in ("word", "c", "logs"))
        table = logs_of_head.flatten().to_numpy().reshape(-1, classes + 1)
        head = spark.sparkContext.broadcast((words_of_head, seen_of_head.to_numpy(), table))
        end = logs.where("word is null").first()
        ends, ended = (list(end["logs"]), end["c"]) if end else ([0.0] * (classes + 1), 0)
        kind = rows.schema["id"].dataType
        texts = kept(rows.select("id", "text", learned.alias("learned")).mapInArrow(_texts, _TEXTS.format(id=kind.simpleString())))
        parts = -(-texts.count() // 4) or 1
        pieces = texts.mapInArrow(_pairs(head, parts), _PAIRS)
        found = kept(pieces.groupBy("part").applyInArrow(_pair_counts(parts), _SEEN))
        gates = found.where("block = -1").select(F.posexplode("logs").alias("k", "s")).groupBy("k").agg(F.sum("s").alias("s"))
        gates = {r["k"]: r["s"] for r in gates.collect()}
        share = np.array([(gates.get(k + BEFORE, 0.0) + 0.5) / (gates.get(k, 0.0) + 1) for k in range(BEFORE)])
        tail = texts.mapInArrow(_outside(head), "block long, word string").join(logs.select("word", "c", "logs"), "word")
        tail = kept(tail.select("block", F.lit(None).cast("int").alias("part"), "word", "c", F.lit(None).cast("binary").alias("counts"), "logs"), logs)
        schema = f"id {kind.simpleString()}, n long, known long, bytes long, sums array<double>"
        out = texts.groupBy("block").cogroup(found.where("block >= 0").union(tail).groupBy("block")).applyInArrow(_told(head, share, ends, ended, parts), schema)
        sums = [F.col("sums")[k] for k in range(classes + 1)]
        mine = [s + F.lit(float(prior[k])) for k, s in enumerate(sums[1:])]
        best = F.greatest(*mine) if classes > 1 else mine[0]
        total = best + F.log10(sum((F.pow(F.lit(10.0), m - best) for m in mine), F.lit(0.0)))
        out = out.select(
            F.col("id").alias(key),
            held_out(F.col("id")).alias("held_out"),
            F.col("n").alias("n_tokens"),
            F.col("known").alias("n_known"),
            F.lit(n).cast("long").alias("train_tokens"),
            sums[0].alias("base_score"),
            total.alias("score"),
            (-total / math.log10(2) / F.col("bytes")).alias("bits_per_byte"),
        )
        return checkpointed(out)
