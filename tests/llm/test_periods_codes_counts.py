"""Periodic runs, vector codes and token counts beside brute force, on small tables with every odd case."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from gaugeline.llm import periods, token_counts, vector_codes
from gaugeline.llm.queries import code_sql, public_tokenizer

DOCS = "doc_id long, text string, id string, name string, row long, n_bytes int, period string"
VECTORS = "vec_id long, embedding array<float>, label int, id string, vector string, code string, n long"
INF = float("inf")


def brute_runs(words):
    """Every stretch of every period, the smallest period of equal stretches."""
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e, q) for (s, e), q in out.items())


def numbers(words):
    """The ids and gaps that ``periods.runs`` takes."""
    spelled = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids, gaps, last = np.array([spelled[w] for w in words], np.int64), np.full(len(words), 1 << 60), {}
    for k, w in enumerate(words):
        if w in last:
            gaps[last[w]] = k - last[w]
        last[w] = k
    return ids, gaps


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_transform_undone():
    x = np.random.default_rng(1).integers(0, periods.PRIME, (3, 128), dtype=np.uint64)
    assert (periods.inverse_ntt(periods.ntt(x)) == x).all()


@pytest.mark.parametrize("block,reach", [(1, 1), (3, 9), (4, 19), (32, 95)])
def test_squared_differences(block, reach):
    rng = np.random.default_rng(block)
    blocks, windows = rng.integers(0, 60_000, (5, block)), rng.integers(0, 60_000, (5, reach))
    windows[2, reach - block :] = blocks[2]
    got = periods.squared_differences(blocks.astype(np.uint64), windows.astype(np.uint64))
    for shift in range(reach - block + 1):
        want = ((blocks - windows[:, shift : shift + block]) ** 2).sum(1) % periods.PRIME
        assert (got[:, shift] == want).all()
    assert got[2, -1] == 0


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_words(seed):
    rng = random.Random(seed)
    for _ in range(60):
        n, kinds = rng.randint(1, 260), rng.choice([1, 2, 3, 5, 30])
        words = [rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randint(0, 4)):
            a, q = rng.randrange(n), rng.randint(1, max(1, n // 3))
            for i in range(a, min(n, a + rng.randint(1, 4 * q))):
                words[i] = words[a + (i - a) % q]
        assert list(zip(*(c.tolist() for c in periods.runs(*numbers(words), n)))) == sorted(brute_runs(words), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("words", [[0] * 11, [0] * 12, [0] * 3000, fibonacci(600), [bin(i).count("1") % 2 for i in range(500)], list(range(900)) * 2 + [5], ([0] * 40 + [1]) * 9 + [0] * 40])
def test_runs_of_known_sequences(words):
    assert list(zip(*(c.tolist() for c in periods.runs(*numbers(words), len(words))))) == sorted(brute_runs(words), key=lambda r: (r[0], r[2]))


def digest(doc, text, plant):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(str("" if doc is None else doc).encode())
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, e, q in found for i in range(s + q, e)}
    best = min(((s - e, s, q) for s, e, q in found), default=None)
    told = [best[1], -best[0], best[2], -1000 * best[0] // best[2]] if best else [None] * 4
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return doc, len(found), *told, *(hashlib.sha256(t.encode()).hexdigest() for t in (lines, kept))


def odd_texts():
    rng = random.Random(3)
    out = [None, "", " \t\n\x0b\x0c\r ", "one", "la " * 50, "a\x0bb\x0cc \x1cd\x1d " * 9, "naïve ÉTÉ 日本語 " * 7, "no break  space " * 12]
    for _ in range(60):
        words = [rng.choice(["ka", "lo", "Mi", "mi", "tu"]) + rng.choice(["", "ra", "."]) for _ in range(rng.randint(5, 400))]
        out.append("  ".join(words * rng.choice([1, 1, 2, 5])) + rng.choice(["", "\n"]))
    return [*out, out[12], out[12], "w " + " ".join(str(rng.randrange(9000)) for _ in range(30_000))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "i", "n", -1, 0, "p") for k, t in enumerate(odd_texts())]
    rows += [rows[12], (None, "again and again " * 8, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(4)


@pytest.mark.parametrize("plant,block", [(False, 1 << 20), (True, 1 << 20), (True, 2000)])
def test_periods_of_documents(docs, monkeypatch, plant, block):
    monkeypatch.setattr(periods, "BLOCK", block)
    got = periods.find(docs, plant=plant)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    texts = [(r["doc_id"], r["text"]) for r in docs.collect() if r["text"] is None or len(r["text"]) < 50_000]
    want = [digest(d, t, plant) for d, t in texts]
    kept = {w[0] for w in want}
    key = lambda r: tuple(str(v) for v in r)
    assert sorted((tuple(r) for r in got.collect() if r["doc_id"] in kept), key=key) == sorted(want, key=key)
    assert got.count() == docs.count()


def test_nearest_entries_by_cell():
    rng = np.random.default_rng(4)
    for spread, side in ((3, 4), (200, 32), (3000, 64), (1 << 27, 1 << 20)):
        entries, x = rng.integers(-spread, spread + 1, (50, 4)), rng.integers(-spread, spread + 1, (700, 4))
        entries[7] = entries[3]
        x[:50] = entries
        cells = vector_codes.Cells(entries, side)
        for part in (x, x[::-1], x[:1]):
            code, error = cells.nearest(np.ascontiguousarray(part))
            apart = ((part[:, None] - entries[None]) ** 2).sum(2)
            assert (code == apart.argmin(1)).all() and (error == apart.min(1)).all()
        kept = cells.candidates(np.unique(x // side, axis=0))
        assert side > spread or np.mean([len(k) for k in kept]) < len(entries)


def test_cells_are_forgotten(monkeypatch):
    monkeypatch.setattr(vector_codes, "HELD", 500)
    monkeypatch.setattr(vector_codes, "PAIRS", 40)
    rng = np.random.default_rng(5)
    entries, x = rng.integers(-90, 90, (30, 3)), rng.integers(-99, 99, (400, 3))
    cells = vector_codes.Cells(entries, 16)
    for part in np.array_split(x, 9):
        assert (cells.nearest(part)[0] == ((part[:, None] - entries[None]) ** 2).sum(2).argmin(1)).all()
    assert cells.held <= 500


def brute_codes(rows, parts=4, entries=256, rounds=4):
    rows = [(v, [min(max(int(np.floor(1024 * x)), -(1 << 27)), 1 << 27) for x in e], g) for v, e, g in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    if not rows:
        return []
    width = -(-max(len(e) for _, e, _ in rows) // parts)
    x = np.array([e + [0] * (parts * width - len(e)) for _, e, _ in rows], np.int64).reshape(-1, parts, width)
    first = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, x[k].ravel().tolist()))[:entries]
    books = [x[first, p].copy() for p in range(parts)]
    near = lambda p: ((x[:, p][:, None] - books[p][None]) ** 2).sum(2)
    for _ in range(rounds):
        for p in range(parts):
            code = near(p).argmin(1)
            for e in range(len(first)):
                if (code == e).any():
                    books[p][e] = x[code == e, p].sum(0) // (code == e).sum()
    told = [near(p) for p in range(parts)]
    error = sum(t.min(1) for t in told)
    of = {}
    for (_, _, g), e in zip(rows, error):
        of[g] = of.get(g, 0) + int(e)
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    return [(v, "".join(f"{t[k].argmin():02x}" for t in told), int(error[k]), of[g], sha) for k, (v, _, g) in enumerate(rows)]


def vectors(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.2, (12, dim))
    return [(int(k), (centres[k % 12] + rng.normal(0, 0.02, dim)).astype(np.float32).tolist(), int(k % 5) if k % 7 else None) for k in rng.permutation(n)]


@pytest.mark.parametrize("case", ["many", "few", "odd", "none"])
def test_codes(spark, case):
    rows = {"many": vectors(900, 16), "few": vectors(40, 8), "none": []}.get(case)
    if rows is None:  # lengths that differ, huge and tiny numbers, repeats, null ids and labels, vectors that do not count
        rows = vectors(30, 7) + [(3, [0.5] * 7, 1), (None, [0.25] * 7, None), (None, [0.25] * 7, None), (90, [], 2), (91, [1e30, -1e30], 2), (92, [-1e-30] * 9, 2)]
        rows += [(93, None, 2), (94, [1.0, None], 2), (95, [float("nan")] * 7, 2), (96, [INF] * 7, 2), (97, [0.0] * 7, 2), (3, [0.5] * 7, 1)]
    frame = spark.createDataFrame([(v, e, g, "i", "v", "c", 1) for v, e, g in rows], VECTORS).repartition(3)
    got = vector_codes.encode(frame)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want = brute_codes([(v, [None if x is None else float(np.float32(x)) for x in e] if e is not None else None, g) for v, e, g in rows])
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_codes_beside_sql(spark, tmp_path):
    rows = vectors(400, 16, 2) + [(900, None, 1), (901, [float("nan")] * 16, 1)]
    frame = spark.createDataFrame([(v, e, g, "i", "v", "c", 1) for v, e, g in rows], VECTORS)
    frame.select("vec_id", "embedding", "label").write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    want = con.execute(code_sql()).fetchall()
    assert sorted(map(tuple, vector_codes.encode(frame).collect())) == sorted(want)


@pytest.fixture(scope="module")
def model():
    return public_tokenizer("piece_bpe_32k.model")


def token_texts():
    rng = random.Random(8)
    prose = " ".join(rng.choice(["house", "River", "überall", "the", "of", "naïveté", "x9"]) + rng.choice(["", ",", ".\n", "\t"]) for _ in range(3000))
    out = [None, "", " ", "  two  blanks  ", "</s><s><unk>", "a\x00b", "▁x ▁", prose, prose.replace(" ", ""), "a" * 9000, " " * 7000, "日本語テキスト漢字龘" * 700]
    out += ["".join(rng.choice("ab ") for _ in range(6000)), "\n" * 5000 + prose, "😀é" * 2500, "<0x41>" * 900, "-=" * 4000]
    return out + [prose, prose]


@pytest.mark.parametrize("chunk,overlap", [(1 << 14, 1 << 7), (700, 40), (64, 16), (50, 2)])
def test_token_counts(spark, model, chunk, overlap):
    from sentencepiece import SentencePieceProcessor

    whole = SentencePieceProcessor(model_file=model)
    texts = list(enumerate(token_texts())) + [(None, "no id " * 500)]
    frame = spark.createDataFrame([(k, t, "i", "n", 1, 2, "p") for k, t in texts], DOCS).repartition(3)
    got = token_counts.count(frame, model, 2000, chunk, overlap)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(k, len((t or "").encode()), n := len(whole.encode(t or "")), n > 2000) for k, t in texts]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_chunks_are_dealt_only_of_texts_with_many(spark, model, monkeypatch):
    """Else the texts of all documents above one chunk go through a shuffle, and with a second pass through another one."""
    from sentencepiece import SentencePieceProcessor

    texts = list(enumerate(["some words " * 200, "other words " * 1000, "few"]))  # 22 and 120 chunks of 100 characters
    frame, dealt = spark.createDataFrame([(k, t, "i", "n", 1, 2, "p") for k, t in texts], DOCS), []
    kind = type(frame)
    real = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda df, *by: dealt.append(df.count()) or real(df, *by))
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count(frame, model, chunk=100, overlap=30).collect()}
    whole = SentencePieceProcessor(model_file=model)
    assert got == {k: len(whole.encode(t)) for k, t in texts}
    assert dealt == [120]


def test_only_proven_seams_are_spliced(spark):
    rows = [(1, 0, 10, [5 << 32 | 7, 9 << 32 | 8, 12 << 32 | 3], None), (1, 0, 6, None, [4 << 32 | 2, 9 << 32 | 8, 12 << 32 | 1])]
    rows += [(2, 0, 4, [1 << 32 | 1], None), (2, 0, 5, None, [1 << 32 | 2]), (3, -1, 11, None, None)]
    frame = spark.createDataFrame(rows, "row long, seam long, n long, left array<long>, right array<long>")
    told = {r["row"]: (r["n_tokens"], r["open"]) for r in token_counts.spliced(frame).collect()}
    assert told[1] == (16 - 1 - 2, 0) and told[2][1] == 1 and told[3] == (11, 0)


def test_empty_tables(spark, model):
    none = spark.createDataFrame([], DOCS)
    assert periods.find(none).count() == 0 and token_counts.count(none, model).count() == 0


def test_ids_equal_the_tokenizers(monkeypatch):
    from tokenizers import Tokenizer

    from gaugeline.llm import packing

    path = public_tokenizer()
    own, encode = Tokenizer.from_file(path), packing.encoder(path)
    rng = random.Random(11)
    signs = [chr(c) for c in rng.sample([c for c in range(0x30000) if not 0xD800 <= c < 0xE000], 300)] + list(" \t\n abcABC123.,'s're 　") * 12
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += [t for t in token_texts() if t] + ["a<|endoftext|>b <|endoftext|> <|endof", "x" * 9000, "y " * 3000 + "\n" * 5000]
    assert [np.frombuffer(b, "<u4").tolist() for b in encode(texts)] == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]
    assert packing.ranked_vocabulary({"model": {"type": "WordPiece"}}) is None
    monkeypatch.setattr(packing, "ranked_vocabulary", lambda spec: None)
    import sys

    monkeypatch.delitem(sys.modules, "_gaugeline_bpe")
    assert packing.encoder(path)(texts[:300]) == encode(texts[:300])


def test_items_without_an_id_are_hit(spark, monkeypatch):
    import pickle

    from pyspark import SparkContext

    from gaugeline.llm import decontam

    sent, plain = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: (sent.append(value), plain(self, value))[1])
    passage = " ".join(f"word{k}" for k in range(97, 112))
    letters = "".join(c for c in passage if not c.isdigit())
    tests = spark.createDataFrame([(None, passage), ("b", "short item"), ("c", None), (None, None)], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"before {passage} after"), (2, "a short item here"), (3, letters)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in decontam.digest(decontam.mark(docs, tests)).collect()}
    assert got == {1: (15, 0, True), 2: (2, 1, True), 3: (0, 0, False)}
    # What is broadcast is loaded where the package is not installed.
    assert sent and not any(b"gaugeline" in pickle.dumps(v) for v in sent)


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    from gaugeline.llm import substrings

    rng = random.Random(7)
    text = lambda k: " ".join(" ".join(rng.choice("ka lo mi tu ra en so".split()) + str(rng.randrange(900)) for _ in range(9)) + "." for _ in range(k))
    a, b = text(5), text(5)
    rows = spark.createDataFrame([(0, b), (1, a), (1, b), (1, b)], "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["text"]) for r in substrings.dedupe(rows).collect())
    assert got == sorted([(0, b), (1, a), (1, ""), (1, "")])


def test_a_link_to_a_row_without_an_id_keeps_the_class(spark):
    from gaugeline.llm import ngram_join

    words = [f"w{k}" for k in range(60)]
    near = " ".join([*words, "more"])
    rows = spark.createDataFrame([(7, " ".join(words)), (9, near), (None, " ".join(words)), (None, " ".join(words)), (3, "something else that links with none of them")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in ngram_join.join(rows).collect()), key=str)
    assert got == sorted([(7, 7), (9, 7), (None, 7), (None, 7), (3, 3)], key=str)
