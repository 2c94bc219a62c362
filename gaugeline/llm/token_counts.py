"""Tokens per document; huge documents in overlapping chunks whose encodings are spliced where they provably agree."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import pieces_of, scratch
from gaugeline.session import checkpointed

#: Characters of a chunk, a text of more is huge; characters by which a chunk first reaches into the next one.
CHUNK, OVERLAP = 1 << 14, 1 << 7
#: The chunks of a text of more of them are dealt over tasks; of fewer, they are encoded where the text is.
DEALT = 64
_SPACE, _LONG = "▁", 3  # the sign that stands for a blank inside the model, and its bytes


class Pieces:
    """The model of a file, and how many bytes of the escaped text (blanks as the sign above) each id covers."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = model = SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        self.sizes = np.array([1 if model.is_byte(i) else 0 if model.is_control(i) else len(model.id_to_piece(i).encode()) for i in ids], np.int64)
        #: Places of tokens follow from their ids where the text is only escaped and unknown signs become bytes.
        self.placed = any(map(model.is_byte, ids)) and model.normalize(" a  Åﬁ\t ") == _SPACE + " a  Åﬁ\t ".replace(" ", _SPACE)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]

    def tokens(self, text: str, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a chunk and the byte each begins at, counted from the first byte of the chunk's own escaped text.

        The model puts a blank before what it reads. The chunk's own first blank takes that place; without one the
        token over the added blank begins before 0 and can agree with no other.
        """
        own = not first and text.startswith(" ")
        ids = np.array(self.model.encode(text[1:] if own else text), np.int64)
        at = self.sizes[ids].cumsum()
        return ids, at - self.sizes[ids] - (0 if own else _LONG)


def escaped_size(text: str) -> int:
    return len(text.encode()) + (_LONG - 1) * text.count(" ")


def _cut(chunk: int, overlap: int):
    """Rows (row, seam, first, text, own): the chunks of each text, each with ``overlap`` characters of what follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", 1):
            row, text = batch.column("row")[0].as_py(), batch.column("text")[0].as_py()
            for lo in range(0, len(text), 64 * chunk):
                starts = range(lo, min(len(text), lo + 64 * chunk), chunk)
                texts = [text[s : s + chunk + overlap] for s in starts]
                own = [escaped_size(t[:chunk]) if s + chunk < len(text) else -1 for s, t in zip(starts, texts)]
                columns = [pa.array([row] * len(starts), pa.int64()), pa.array([s // chunk for s in starts], pa.int64()), pa.array(texts, pa.string()), pa.array(own, pa.int64())]
                yield pa.record_batch(columns, ["row", "chunk", "text", "own"])

    return run


def _encoded(path: str, chunk: int, overlap: int):
    """Per chunk (row, seam, n, left, right): n tokens in all, at its seam with the next chunk those that begin beyond it
    (``left``), and at its seam with the one before those that begin within the overlap (``right``); a token is known by its place
    and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in pieces_of(batches, "text", 1 << 20):
            out: list[list] = [[], [], [], [], []]
            for row, k, text, own in zip(*(batch.column(c).to_pylist() for c in ("row", "chunk", "text", "own"))):
                ids, at = pieces.tokens(text, k == 0)
                n = len(ids) - int((at < 0).sum() if k else 0)  # what covers the added blank is no token of the text
                if own >= 0:
                    # The added blank of a first chunk is part of the document's own escaped text.
                    beyond = at >= own
                    for column, value in zip(out, (row, k, n, ((at[beyond] - own) << 32 | ids[beyond]).tolist(), None)):
                        column.append(value)
                    n = 0
                if k:
                    inside = (at >= 0) & (at < escaped_size(text[:overlap]))
                    for column, value in zip(out, (row, k - 1, n, None, (at[inside] << 32 | ids[inside]).tolist())):
                        column.append(value)
                elif n:
                    for column, value in zip(out, (row, -1, n, None, None)):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds)], ["row", "seam", "n", "left", "right"])

    return run


def spliced(chunks: DataFrame) -> DataFrame:
    """Rows (row, n_tokens, open): the tokens of each text, and at how many of its seams the two encodings share no token.

    A byte-pair encoding is the right one if and only if each two tokens in a row are the encoding of their own text:
    merges of the whole text happen in the order in which they happen in a pair, until one crosses a boundary, and that one would
    cross it in the pair as well. A token both encodings have at the same place therefore joins them: every two neighbours
    of what results stand in a row in one of the two. Up to that token the left encoding counts, after it the right one.
    """
    seams = chunks.groupBy("row", "seam").agg(F.sum("n").alias("n"), F.max("left").alias("left"), F.max("right").alias("right"))
    shared = F.array_min(F.array_intersect("left", "right"))
    seams = seams.withColumn("token", F.when(F.col("seam") >= 0, shared))
    twice = F.size("left") - F.array_position("left", F.col("token")) + F.array_position("right", F.col("token"))
    missing = F.col("token").isNull() & (F.col("seam") >= 0)
    return seams.groupBy("row").agg(F.sum(F.col("n") - F.coalesce(twice, F.lit(0))).alias("n_tokens"), F.sum(missing.cast("long")).alias("open"))


def count(docs: DataFrame, model: str, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row (doc_id, n_bytes, n_tokens, over_limit) per document: the tokens that the model of the file gives the whole text.

    Texts of more than ``chunk`` characters are cut into overlapping chunks, which are encoded where the text is, or dealt
    over tasks if they are many, and spliced (``spliced``). Where two neighbours share no token, as in a long run of one sign, the text goes through again with chunks and overlaps four times as
    large, until it is one chunk. The models must be byte-pair models that give unknown signs as bytes and leave the text as it is
    but for a blank put before it; with any other, texts are encoded whole.
    Cases: null and empty texts have no bytes and no tokens; rows that repeat an id or a text are counted each; null ids
    stay null; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    huge = F.char_length("text") > chunk if Pieces(model).placed else F.lit(False)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in pieces_of(batches, "text", 1 << 20):
            counts = pieces.counts(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    sized = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    done = sized.where(~huge).mapInArrow(whole, f"id {kind}, n_bytes long, n_tokens long")
    with scratch(spark) as kept:
        # Written once: the numbers of the rows hold in every task and every attempt.
        large = kept(sized.where(huge).withColumn("row", F.monotonically_increasing_id()))
        found, todo = [], large.select("row", "text")
        while True:
            cut, encoded = _cut(chunk, overlap), _encoded(model, chunk, overlap)
            far, pieces = F.char_length("text") > DEALT * chunk, "row long, chunk long, text string, own long"
            near = todo.where(~far).mapInArrow(cut, pieces)
            dealt = todo.where(far).mapInArrow(cut, pieces).repartition("row", "chunk")
            schema = "row long, seam long, n long, left array<long>, right array<long>"
            told = kept(spliced(near.mapInArrow(encoded, schema).unionByName(dealt.mapInArrow(encoded, schema))))
            found.append(told.where("open = 0").select("row", "n_tokens"))
            again = kept(told.where("open > 0").select("row"))  # few: its size is known, and texts are not moved to meet it
            if again.isEmpty():
                break
            chunk, overlap = 4 * chunk, 4 * overlap
            todo = large.join(again, "row", "left_semi").select("row", "text")
        counts = functools.reduce(DataFrame.unionByName, found)
        joined = checkpointed(large.select("row", "id", "n_bytes").join(counts, "row").select("id", "n_bytes", "n_tokens"))
    out = done.unionByName(joined)
    return out.select(F.col("id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
