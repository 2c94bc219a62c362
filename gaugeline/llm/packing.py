"""Token sequences of bounded length from whole documents: linear grouping, few-size configurations, best fit."""

from __future__ import annotations

import json
import re
import sys
import types
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import numbered, pieces_of
from gaugeline.session import checkpointed

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: The pre-tokens of byte-level vocabularies, a fixed value.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A long text with such a stretch without or of white space goes to the tokenizer itself, whose time does not grow with the square of it.
LONG, STRETCH = 1 << 16, re.compile(r"\S{40000}|\s{40000}")


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: printable ones themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(rest)}}


def ranked_vocabulary(spec: dict) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """Bytes to id, and special strings to id, of a plain byte-level vocabulary whose ids grow in the order of its merges.

    Then the pair with the smallest merged id is the pair of the first merge, so merging by ids gives the tokenizer's
    ids. None for any other kind.
    """
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not spec.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True)
    if not plain or before.get("add_prefix_space") or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
        return None
    added = spec.get("added_tokens", [])
    if any(not t["special"] or t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        return None
    special, signs = {t["content"]: t["id"] for t in added}, byte_signs()
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    words = {w: i for w, i in model["vocab"].items() if w not in special}
    if merged != sorted(merged) or not all(c in signs for w in words for c in w) or len(merged) != len(words) - 256:
        return None
    return {bytes(signs[c] for c in w): i for w, i in words.items()}, special


def encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Texts to their ids as little-endian unsigned 32-bit bytes, equal to the tokenizer's own.

    Vocabularies of the kind of ``ranked_vocabulary`` are merged by id, which takes a quarter of the tokenizer's time; any other goes
    through the tokenizer. Nothing is kept but the vocabulary.
    """
    from tokenizers import Tokenizer

    store = sys.modules.setdefault("_gaugeline_bpe", types.ModuleType("_gaugeline_bpe")).__dict__
    if path not in store:  # lives as long as the worker
        import tiktoken

        tokenizer = Tokenizer.from_file(path)
        found = ranked_vocabulary(json.loads(tokenizer.to_str()))
        store[path] = tokenizer, found and tiktoken.Encoding("byte_level", pat_str=PRE_TOKENS, mergeable_ranks=found[0], special_tokens=found[1])
    tokenizer, merger = store[path]

    def encode(texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if merger is None or (len(text) >= LONG and STRETCH.search(text)):
                out.append(np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
            else:
                out.append(merger.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes())
        return out

    return encode


def cut_tokens(docs: DataFrame, tokenizer: str, end: int, capacity: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) of all documents: the ids of the text and then ``end``.

    A document longer than ``capacity`` is cut into pieces of that length, of which only the first may be shorter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, closing = encoder(tokenizer), np.array([end], "<u4").tobytes()
        for batch in pieces_of(batches, "text", 1 << 20):
            out: list[list] = [[], [], [], [], []]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode([t or "" for t in batch.column("text").to_pylist()])):
                ids += closing
                n, start, piece = len(ids) // 4, 0, 0
                while start < n:
                    stop = start + ((n - start) % capacity or capacity)
                    for column, value in zip(out, (doc, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]))):
                        column.append(value)
                    start, piece = stop, piece + 1
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


def grouped(counts: dict[int, int], groups: int) -> dict[int, list[tuple[int, int]]]:
    """Linear grouping: the lengths, longest first, dealt into groups of about equal cardinality; each group is known by its
    longest length, to which its members are rounded up. Gives that length -> [(length, count)], longest first."""
    each, out, size, room = max(1, -(-sum(counts.values()) // groups)), {}, 0, 0
    for length in sorted(counts, reverse=True):
        if room <= 0:
            size, room = length, each
            out[size] = []
        out[size].append((length, counts[length]))
        room -= counts[length]
    return out


def fullest(sizes: list[int], left: dict[int, int], capacity: int) -> dict[int, int]:
    """The configuration that holds the largest size left and fills the sequence best, larger sizes first; an exact
    subset-sum over the bounded set of sizes, with the set of reachable sums as the bits of a number."""
    first, mask = sizes[0], (1 << (capacity + 1)) - 1
    reach, steps = 1 << first, []
    for size in sizes:
        for _ in range(min(left[size] - (size == first), capacity // size)):
            grown = reach | (reach << size) & mask
            if grown == reach:
                break
            steps.append((size, reach))
            reach = grown
        if reach >> capacity & 1:
            break
    total, chosen = reach.bit_length() - 1, defaultdict(int, {first: 1})
    for size, before in reversed(steps):
        if not before >> total & 1:
            chosen[size] += 1
            total -= size
    return dict(chosen)


def plan(counts: dict[int, int], capacity: int, groups: int = 512, large: float = 0.125) -> list[tuple[int, int, int, int, int]]:
    """Where the pieces of each length go: rows (length, first rank, count, first sequence, offset).

    ``counts`` is the histogram of lengths, at most ``capacity`` numbers however many documents there are. The lengths above
    ``large * capacity`` are grouped and rounded up; configurations of the few sizes are chosen and repeated as long as
    their sizes last; the actual lengths, longest first, then take the places of their group; at last the small lengths
    go, longest first, where the least room is left (best fit), and into new sequences when there is no room.
    A run of equal sequences stays one row, so the work depends on the number of lengths, not of documents.
    """
    rows, runs, sequences = [], defaultdict(list), 0  # runs: room left -> [(first sequence, count)]
    taken: dict[int, int] = defaultdict(int)

    def put(length: int, count: int, first: int, offset: int) -> None:
        rows.append((length, taken[length], count, first, offset))
        taken[length] += count

    groups_of = grouped({k: v for k, v in counts.items() if k > large * capacity}, groups)
    left = {size: sum(n for _, n in members) for size, members in groups_of.items()}
    while left:
        sizes = sorted(left, reverse=True)
        chosen = fullest(sizes, left, capacity)
        times = min(left[size] // k for size, k in chosen.items())
        open_runs = [(sequences, times, 0)]  # (first sequence, count, used)
        sequences += times
        for size, k in sorted(chosen.items(), reverse=True):
            for _ in range(k):
                parts = []
                for first, count, used in open_runs:
                    while count:  # the actual lengths of the group take the places
                        length, n = groups_of[size][0]
                        m = min(n, count)
                        put(length, m, first, used)
                        parts.append((first, m, used + length))
                        first, count = first + m, count - m
                        if m == n:
                            groups_of[size].pop(0)
                        else:
                            groups_of[size][0] = (length, n - m)
                open_runs = parts
            left[size] -= k * times
            if not left[size]:
                del left[size]
        for first, count, used in open_runs:
            runs[capacity - used].append((first, count))
    for length in sorted((k for k in counts if k <= large * capacity), reverse=True):
        n = counts[length]
        while n:
            room = min((r for r, open_ in runs.items() if r >= length and open_), default=0)
            if room:
                first, count = runs[room].pop()
            else:
                room, first, count = capacity, sequences, -(-n // (capacity // length))
                sequences += count
            m = min(n, count)
            put(length, m, first, capacity - room)
            runs[room - length].append((first, m))
            if m < count:
                runs[room].append((first + m, count - m))
            n -= m
    return rows


def pack(docs: DataFrame, tokenizer: str, end: int = 2, capacity: int = 1024, groups: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All documents in sequences of at most ``capacity`` tokens: PIECES columns plus sequence_id and offset.

    Only the histogram of lengths (at most ``capacity`` rows) reaches the driver, where the packing is planned by linear
    grouping; the pieces of a length are numbered without gaps and each number finds its place in the plan.
    Cases: null and empty texts are one piece of length 1; copies and repeated rows are packed each; an empty
    table gives no rows; other columns are ignored.
    """
    pieces = numbered(cut_tokens(docs, tokenizer, end, capacity, text, key), ["length"], "_rank")
    pieces = checkpointed(pieces)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = np.array(sorted(plan(counts, capacity, groups)), dtype=np.int64).reshape(-1, 5)
    schema = pieces.drop("_rank").schema.simpleString()[7:-1] + ",sequence_id:bigint,offset:bigint"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = places[:, 0] << 48 | places[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            at = np.searchsorted(starts, length << 48 | rank, side="right") - 1
            columns = [batch.column(c) for c in batch.schema.names if c != "_rank"]
            columns += [pa.array(places[at, 3] + rank - places[at, 1]), pa.array(places[at, 4])]
            yield pa.record_batch(columns, [c for c in batch.schema.names if c != "_rank"] + ["sequence_id", "offset"])

    return pieces.mapInArrow(place, schema)
