"""The training-data operators beside brute force, on small tables with every odd case."""

import collections
import hashlib
import itertools
import math
import random
import re
import tracemalloc
import types
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
import xxhash
from pyspark.sql import functions as F

from gaugeline.llm import decontam, metric_join, mixing, ngram_join, packing, quality, sharding, substrings, surrogates, toxicity
from gaugeline.llm.common import components, sample, scratch, spread_join
from gaugeline.llm.queries import EMBEDDING_SQL, public_tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words string, b string, label int, part string"
WORDS = "ka lo mi tu ra en so pi da ve nu or el ti ba".split()


def small_texts(seed=1, n=60):
    rng = random.Random(seed)
    out = [None, "", " \t\n", "one", "ONE", "four words are here", "a  b   c", "tab\tand\nline \n end ", "x" * 500, "naïve ÉTÉ straße"]
    long = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(4000)]
    out.append(" ".join(long))
    for _ in range(n):
        words = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(rng.randint(5, 60))]
        out.append(" ".join(words))
        if rng.random() < 0.5:  # a near copy
            k = rng.randrange(len(words))
            out.append(" ".join(words[:k] + ["changed"] * rng.randint(0, 1) + words[k + rng.randint(0, 1) :]).upper())
    return out + [out[20], out[20], out[5]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en" if k % 3 else "de", "s", None, 0.5, "w", "b", 1, "p") for k, t in enumerate(small_texts())]
    rows += [rows[12], (None, "an id is missing here today", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def linked(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_against_union_find(spark):
    rng = random.Random(3)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 230)]
    nodes = {n for pair in links for n in pair if pair[0] != pair[1]}
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == linked(nodes, links)


def test_components_write_every_round_with_kept(spark):
    links, widths = [(k, k + 1) for k in range(40)] + [(100, 99), (7, 7)], []
    with scratch(spark) as kept:

        def packed(df):
            out = kept(df.repartition(50))
            widths.append(out.rdd.getNumPartitions())  # of 50 small files fewer tasks read several each
            return out

        found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), packed).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 99: 99, 100: 99}
    assert widths and max(widths) < 50


def test_sharding(docs, none):
    rows = sharding.shard(docs).collect()
    assert len(rows) == docs.count()
    texts = collections.defaultdict(list)
    for d, t in rows_of(docs):
        texts[d].append(t or "")
    for r in rows:
        key = int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:15], 16)
        assert (r["shard"], r["grown_shard"]) == (jump(key, 16), jump(key, 17))
        assert r["grown_shard"] in (r["shard"], 16)
        assert (r["size"] - 1, r["text_crc32"]) in [(len(t.encode()), zlib.crc32(t.encode())) for t in texts[r["doc_id"]]]
    for shard in range(16):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shard(none).count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    odd = [(900, "two  blanks and \n a line "), (901, " starts blank"), (902, "a<|endoftext|> b <|endoftext|>c"), (903, "tab\t x  y　z, q. r.\ns"), (904, "x ,y. Z.. 12, é. "), (905, "word " * 3000)]
    every = docs.select("doc_id", "text").where("doc_id is not null").distinct().union(docs.sparkSession.createDataFrame(odd, "doc_id long, text string"))
    pieces = packing.pack(every, path).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc, text in rows_of(every):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        own = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 1024 for r in own[1:]) and (len(ids) <= 1024) == (len(own) == 1)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert packing.pack(none, path).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_whole_and_tight(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 1025, 20_000) if seed % 2 else np.minimum(1024, rng.geometric(0.004, 20_000))
    counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
    room, taken = collections.defaultdict(int), collections.defaultdict(int)
    for length, first, count, sequence, offset in packing.plan(counts, 1024):
        assert first == taken[length]
        taken[length] += count
        for s in range(sequence, sequence + count):
            assert offset == room[s]  # rows of a sequence come in the order of their offsets
            room[s] += length
    assert taken == counts and max(room.values()) <= 1024
    assert len(room) <= 1.01 * math.ceil(lengths.sum() / 1024) + 2


def test_suffixes_ranks_and_search():
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["a", "b", "c", "dd"], rng.integers(0, 40))) for _ in range(30)] + ["a a a a a a a a"] * 5 + ["", None]
    index = decontam.Index(texts)
    order = decontam.suffixes(index.sequence)
    key = [[(0, i + k) if s == 0 else (1, int(s)) for k, s in enumerate(index.sequence[i : i + 60])] for i in range(len(index.sequence))]
    key = [k[: next((j + 1 for j, x in enumerate(k) if x[0] == 0), len(k))] for k in key]
    assert order.tolist() == sorted(range(len(key)), key=lambda i: key[i])
    phrases = decontam.phrases_of([("1", "a b"), ("2", "dd a c"), ("3", "a a a"), ("4", "zz")], 3)
    lo, hi = index.search(phrases.vocabulary, phrases.matrix, phrases.lengths)
    words = np.array(["\n", *index.words.to_pylist()])[index.sequence].tolist()
    for p, (a, b) in enumerate(zip(lo, hi)):
        phrase = [phrases.vocabulary[int(c)].as_py() for c in phrases.matrix[p, 3 - phrases.lengths[p] :]]
        expected = [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == expected


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_decontamination(spark, docs, none, block, monkeypatch):
    monkeypatch.setattr(decontam, "TEST_BYTES", block)
    monkeypatch.setattr(decontam, "SHARD_BYTES", 3000)
    texts = [t for _, t in rows_of(docs) if t and len(t.split()) > 30]
    items = [(1, " ".join(texts[0].split()[3:18])), (2, texts[1].upper()), (3, "ONE"), (4, None), (5, "..."), (10, " ".join(texts[0].split()[3:18])), (11, "never seen anywhere"), (3, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for item, text in items:
        w = word.findall(low(text))
        for k in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[k : k + 10])].add(str(item))
    expected = collections.Counter()
    for doc, text in rows_of(docs):
        w, hit, found = word.findall(low(text)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        expected[doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    marked = decontam.mark(docs, bench)
    assert collections.Counter(map(tuple, decontam.digest(marked).collect())) == expected
    left = decontam.cut(marked)
    assert left.columns == [c for c in docs.columns if c != "n_words"]  # the clashing column is replaced, then goes
    again = decontam.digest(decontam.mark(left, bench)).collect()
    assert sum(r["contaminated"] for r in again) <= sum(k[-1] for k in expected.elements()) // 4  # a cut may join words anew
    assert decontam.digest(decontam.mark(none, bench)).count() == 0
    assert not any(r["contaminated"] for r in decontam.digest(decontam.mark(docs, none.select(F.col("doc_id").alias("item_id"), "text"))).collect())


@pytest.mark.parametrize("settings", [{}, {"LONG": 2, "RECORDS": 3, "BLOCK": 2000, "TILE": 3}])
def test_shingle_join(docs, none, settings, monkeypatch):
    for name, value in settings.items():
        monkeypatch.setattr(ngram_join, name, value)
    sets = collections.defaultdict(set)
    for doc, text in rows_of(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
        sets[doc] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = [(a, b) for a, b in itertools.combinations([d for d in sets if d is not None], 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    classes = linked([d for d in sets if d is not None], links) | {None: None}
    assert len(links) > 10
    found = ngram_join.join(docs).collect()
    assert len(found) == docs.count()
    for r in found:
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), classes[r["doc_id"]])
    assert ngram_join.join(none).count() == 0


def test_divide_skip_against_counts():
    rng = np.random.default_rng(5)
    for _ in range(30):
        query = np.unique(rng.integers(0, 200, 60).astype(np.uint64))
        records = [np.unique(np.concatenate([query[rng.random(len(query)) < rng.random()], rng.integers(0, 300, 20).astype(np.uint64)])) for _ in range(20)]
        need = [int(rng.integers(1, 50)) for _ in records]
        expected = [k for k, r in enumerate(records) if len(np.intersect1d(query, r)) >= need[k]]
        assert sorted(ngram_join.divide_skip(query, records, need)) == expected
        for r in records:
            may = ngram_join._may_link(len(query), np.frombuffer(ngram_join.outline(query), np.uint8), len(r), np.frombuffer(ngram_join.outline(r), np.uint8), 80)
            if 100 * len(np.intersect1d(query, r)) >= 80 * len(np.union1d(query, r)):
                assert may


@pytest.mark.parametrize("settings", [{}, {"CELL": 8, "CHUNK": 5, "SLICE": 30}])
def test_metric_join(spark, settings, monkeypatch):
    for name, value in settings.items():
        monkeypatch.setattr(metric_join, name, value)
    rng = np.random.default_rng(4)
    rows = []
    for k in range(120):
        v = rng.normal(size=6)
        for _ in range(int(rng.integers(1, 4))):
            rows.append((len(rows), [float(np.float32(x)) for x in v + rng.normal(size=6) * 0.2 * rng.integers(0, 3)], k % 2))
    hot = rng.normal(size=6)
    rows += [(1000 + k, [float(np.float32(x)) for x in hot + rng.normal(size=6) * 0.15], 0) for k in range(60)]
    rows += [(1000 + k, rows[k][1], rows[k][2]) for k in range(60, 70)]
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 6, 0), (2003, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (2004, [float("nan")] * 6, 0), (2005, [float("inf")] * 6, 0), (2006, rows[0][1], None), (2007, [1.0, 2.0], 0)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, node string, links int").repartition(4)
    fine = [r for r in rows if r[1] and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    links = []
    for a, b in itertools.combinations(fine, 2):
        if a[2] == b[2] and len(a[1]) == len(b[1]):
            x, y = np.array(a[1]), np.array(b[1])
            if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links.append((a[0], b[0]))
    count, classes = collections.Counter(itertools.chain(*links)), linked([r[0] for r in rows], links)
    found = metric_join.join(table).collect()
    assert {tuple(r) for r in found} == {(r[0], count[r[0]], classes[r[0]], classes[r[0]] == r[0]) for r in rows} and len(found) == len(rows)
    assert metric_join.join(table.where("false")).count() == 0
    assert "list_cosine_similarity" in EMBEDDING_SQL


def test_mixing_counts_and_beats_the_base(spark, docs, none):
    rng = random.Random(8)
    more = [(k, " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60))), "en") for k in range(1000, 1400)]
    every = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(more, "doc_id long, text string, lang string"))
    counts, end, tokens = collections.Counter(), object(), []
    for doc, text in rows_of(every):
        w = (text or "").encode().lower().split() + [end]
        held = zlib.crc32(("" if doc is None else str(doc)).encode()) % 10 == 0
        tokens.append((doc, held, w))
        if not held:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    expected = collections.Counter((d, h, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for d, h, w in tokens)
    found = mixing.score(every).collect()
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == expected
    held = [r for r in found if r["held_out"]]
    assert all(r["score"] < 0 for r in found) and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    again = {(r["doc_id"], round(r["score"], 9)) for r in mixing.score(every.repartition(1)).collect()}
    assert len(again) == len({r["doc_id"] for r in found})
    assert mixing.score(none).count() == 0


def test_mixing_counts_every_context_exactly():
    rng = random.Random(11)
    words = [None, *sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))) for _ in range(300)})]
    counts = np.array([[rng.randint(0, 3) * 10 ** rng.randint(0, 9), rng.randint(0, 2)] for _ in words], np.int64)
    code = mixing.code_paths(np.arange(256))
    length, nodes, bits = code
    coded = [b"\n" if w is None else w.encode() + b" " for w in words]
    context = {"two": lambda w, i: (b"\0" * 4 + w)[i + 2 : i + 4], "three": lambda w, i: (b"\0" * 4 + w)[i + 1 : i + 4], "four": lambda w, i: (b"\0" * 4 + w)[i : i + 4], "word": lambda w, i: w[:i]}
    expected, asked = collections.Counter(), []
    for w, n in zip(coded, counts):
        for i, b in enumerate(w):
            for step in range(length[b]):
                for name, cut in context.items():
                    for g in range(2):
                        expected[name, cut(w, i), nodes[b, step], g, int(bits[b, step])] += int(n[g])
    columns = {"word": words, "c0": counts[:, 0], "c1": counts[:, 1]}
    halves = [pa.table({"block": [k] * len(words[k::2]), **{c: pa.array(v[k::2]) for c, v in columns.items()}}) for k in range(2)]
    grams = pa.concat_tables([mixing._grams(code, 2)(h) for h in halves]).group_by(["k", "context", "symbol"]).aggregate([("c0", "sum"), ("c1", "sum")])
    half = coded[0::2]
    d = mixing.Decisions(half, code)
    d.locate()
    row = [(w, i, b, step) for w in half for i, b in enumerate(w) for step in range(length[b])]
    assert [n for n, _ in mixing.PREDICTORS] == list(context)
    for k, (name, by_class) in enumerate(mixing.PREDICTORS):
        own = grams.filter(pa.compute.and_(pa.compute.equal(grams["k"], k), pa.compute.is_in(grams["context"], pa.array(d.contexts[k]))))
        table = d.counted(k, own["context"].to_numpy(), own["symbol"].to_numpy().astype(np.int64), np.column_stack([own["c0_sum"].to_numpy(), own["c1_sum"].to_numpy()]))
        for (w, i, b, step), at in zip(row, d.at[k]):
            for bit in range(2):
                each = [expected[name, context[name](w, i), nodes[b, step], g, bit] for g in range(2)]
                assert table[bit, :, at].tolist() == (each if by_class else [sum(each)])

def _mixed_block(words, counts):
    """What the learning stage makes of a block that is the whole table, and the most bytes it held meanwhile."""
    classes, code = counts.shape[1], mixing.code_paths(np.arange(256))
    block = pa.table({"block": pa.array([0] * len(words), pa.int32()), "word": words, **{f"c{g}": counts[:, g] for g in range(classes)}, "times": counts.sum(1)})
    pieces = mixing._pieces(code, classes, 1)(block)
    seen = pa.concat_tables([mixing._followers(classes)(pieces.slice(k, 1)) for k in range(pieces.num_rows)])
    tracemalloc.start()
    try:
        out = mixing._learned(code, classes, 1)(block, seen)
        return code, out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_mixing_holds_tables_of_one_class_at_a_time():
    rng = random.Random(13)
    words = sorted({"".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(4000)})
    few, many = (np.eye(n, dtype=np.int64)[np.arange(len(words)) % n] * 3 for n in (2, 8))
    assert _mixed_block(words, many)[2] < 1.3 * _mixed_block(words, few)[2]


def test_mixing_logs_of_words_follow_their_decisions():
    rng = random.Random(14)
    words = [None, *sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(150)})]
    counts = np.array([[rng.choice([0, 1, 2, 5000]), rng.randint(0, 2), 0] for _ in words], np.int64)
    code, out, _ = _mixed_block(words, counts)
    length, nodes, bits = code
    rows = np.random.default_rng(1)
    w, refined = rows.normal(size=(mixing.GATES, len(mixing.PREDICTORS))), rows.uniform(0.1, 0.9, mixing.GATES * mixing.CELLS)
    (found,) = mixing._word_logs(types.SimpleNamespace(value=(code, w, refined)), 3, 2.0)(iter(out.drop_columns("state").combine_chunks().to_batches()))
    coded = [b"\n" if x is None else x.encode() + b" " for x in words]
    cut = {"two": lambda x, i: (b"\0" * 4 + x)[i + 2 : i + 4], "three": lambda x, i: (b"\0" * 4 + x)[i + 1 : i + 4], "four": lambda x, i: (b"\0" * 4 + x)[i : i + 4], "word": lambda x, i: x[:i]}
    seen = collections.Counter()
    for x, n in zip(coded, counts):
        for i, b in enumerate(x):
            for step in range(length[b]):
                for name, by_class in mixing.PREDICTORS:
                    for g in range(3):
                        seen[name, cut[name](x, i), nodes[b, step], int(bits[b, step]), g if by_class else 0] += int(n[g])
    assert found.column("word").to_pylist() == words
    for x, n, logs in zip(coded, counts, found.column("logs").to_pylist()):
        expected = [math.log10(n.sum() + 0.1) - 2.0]
        for g in range(3):
            total = 0.0
            for i, b in enumerate(x):
                for step in range(length[b]):
                    dot, gate = [], 0
                    for name, by_class in mixing.PREDICTORS:
                        zeros, ones = (seen[name, cut[name](x, i), nodes[b, step], bit, g if by_class else 0] for bit in (0, 1))
                        dot.append(math.log(ones + mixing.PRIOR) - math.log(zeros + mixing.PRIOR))
                        if name in ("three", "word"):
                            gate = gate * 4 + sum(zeros + ones > m for m in (0, 3, 31))
                    dot = float(np.dot(dot, w[gate]))
                    p = 0.75 / (1 + math.exp(-min(30, max(-30, dot)))) + 0.25 * refined[gate * mixing.CELLS + round(min(12, max(-12, dot * 1.5))) + 12]
                    total += math.log10(p if bits[b, step] else 1 - p)
            expected.append(total)
        assert logs == pytest.approx(expected, rel=1e-5, abs=1e-5)

def test_mixing_locates_shared_beginnings_once():
    code = mixing.code_paths(np.arange(256))
    stem, n = "abcdefghijklmnop", 40
    coded = [f"{stem}{k} ".encode() for k in range(n)] + [b"q "]
    d = mixing.Decisions(coded, code)
    d.locate()
    length = code[0]
    every = [int(sum(length[b] for b in w)) for w in coded]
    assert len(d.bits) == len(d.steps[0]) < sum(every) / 3 and len(d.at[0]) == sum(every)
    counts = np.arange(1, n + 2)
    assert d.weight(counts).sum() == counts @ every and d.weight(counts).max() == counts[:n].sum()
    assert d.per_word(np.ones(len(d.bits))).tolist() == every


def test_mixing_head_is_cut_by_frequency_without_a_sort(spark, monkeypatch):
    rows = [(None, 99), *((f"w{k}", k) for k in range(1, 40)), *((f"x{k}", 7) for k in range(9))]
    logs = spark.createDataFrame(rows, "word string, times long").repartition(4)
    for most, expected in ((100, 1), (42, 7), (41, 8), (32, 8), (10, 30), (7, 34), (0, 100)):
        monkeypatch.setattr(mixing, "HEAD", most)
        found = mixing._head(logs)
        # Of levels that hold several frequencies all or none are taken.
        assert len(found.collect()) <= most and {r["word"] for r in found.collect()} == {w for w, n in rows if w and n >= expected}
        assert "TakeOrdered" not in (plan := found._jdf.queryExecution().toString()) and "Limit" not in plan


def test_mixing_counts_meet_by_part_in_little_room():
    rng, classes, parts = random.Random(5), 3, 4
    words = [None, *sorted({"".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(2000)})]
    counts = np.array([[rng.choice((0, 0, 1, 2, 10**12)) for _ in range(classes)] for _ in words], np.int64)
    code = mixing.code_paths(np.arange(256))
    blocks = [pa.table({"block": [b] * len(words[b::3]), "word": words[b::3], **{f"c{g}": counts[b::3, g] for g in range(classes)}}) for b in range(3)]
    rows = pa.concat_tables([mixing._grams(code, classes)(b) for b in blocks])
    total = collections.defaultdict(lambda: np.zeros(classes, np.int64))
    for k, context, symbol, *n in zip(*(rows[c].to_pylist() for c in ("k", "context", "symbol", "c0", "c1", "c2"))):
        total[k, context, symbol] += np.array(n) if mixing.PREDICTORS[k][1] else np.array([sum(n)] * classes)
    pieces = pa.concat_tables([mixing._pieces(code, classes, parts)(b) for b in blocks])
    assert pieces.nbytes * 4 < rows.nbytes
    pieces = pieces.group_by(["kind", "part"]).aggregate([(c, "list") for c in ("block", "n", "contexts", "per", "symbols", "counts")])
    for p in pieces.to_pylist():
        asked = {c: p[f"{c}_list"] for c in ("block", "n", "contexts", "per", "symbols", "counts")}
        answers = mixing._followers(classes)(pa.table({"kind": [p["kind"]] * len(asked["n"]), "part": [p["part"]] * len(asked["n"]), **asked})).to_pylist()
        assert [r["block"] for r in answers] == asked["block"]
        for n, contexts, r in zip(asked["n"], asked["contexts"], answers):
            contexts, per = mixing._unpacked(contexts, n), mixing._unpacked(r["per"], n)
            symbols, owner = mixing._unpacked(r["symbols"], int(per.sum())).tolist(), np.repeat(contexts, per).tolist()
            width = classes if mixing.PREDICTORS[p["kind"]][1] else 1
            seen = mixing._unpacked(r["counts"], width * len(symbols)).reshape(width, -1).T.tolist()
            mine = {(p["kind"], c) for c in contexts.tolist()}
            expected = {key[1:]: n.tolist()[:width] for key, n in total.items() if key[:2] in mine and n.any()}
            assert dict(zip(zip(owner, symbols), seen)) == expected


def test_mixing_reads_texts_in_their_order(spark, monkeypatch):
    rng = random.Random(21)
    names = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30)]
    after = {w: rng.sample(names, 2) for w in names}

    def text(n):
        out = [rng.choice(names)]
        while len(out) < n:
            out.append(rng.choice(after[out[-1]]))
        return out

    held = [k for k in range(1000, 2000) if zlib.crc32(str(k).encode()) % 10 == 0][:8]
    learned = [(k, " ".join(text(40)), "en") for k in range(200) if zlib.crc32(str(k).encode()) % 10]
    ordered = [text(40) for _ in held[:4]]
    mixed = [rng.sample(w, len(w)) for w in ordered]
    rows = learned + [(k, " ".join(w), "en") for k, w in zip(held, ordered + mixed)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in mixing.score(docs).collect()}
    for a, b in zip(held[:4], held[4:]):
        assert found[a]["base_score"] == pytest.approx(found[b]["base_score"])
        assert found[a]["score"] > 0.5 * found[b]["score"]  # the same words: of one probability as long as their order tells nothing
    # Wherever rows lie, and with few words that every task knows.
    monkeypatch.setattr(mixing, "BLOCK", 3000)
    again = {r["doc_id"]: r["score"] for r in mixing.score(docs.repartition(3)).collect()}
    assert again == {k: pytest.approx(r["score"], rel=1e-9) for k, r in found.items()}
    monkeypatch.setattr(mixing, "HEAD", 5)
    few = {r["doc_id"]: r for r in mixing.score(docs).collect()}
    assert {k: (r["n_known"], pytest.approx(r["base_score"])) for k, r in found.items()} == {k: (r["n_known"], r["base_score"]) for k, r in few.items()}
    assert all(few[a]["score"] > 0.5 * few[b]["score"] for a, b in zip(held[:4], held[4:]))


def test_mixing_tells_words_by_the_word_before(monkeypatch):
    monkeypatch.setattr(mixing, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 3)))
    monkeypatch.setattr(mixing, "BLOCK", 300)
    rng = random.Random(22)
    names = [*("".join(rng.choice("abé") for _ in range(rng.randint(1, 4))) for _ in range(25)), "ab", "a", "b"]
    texts = [[rng.choice(names) for _ in range(rng.choice((0, 1, 5, 30)))] for _ in range(60)]
    learned = [rng.random() < 0.8 for _ in texts]
    count, pairs, end, begin = collections.Counter(), collections.Counter(), "\n", "^"
    for w, known in zip(texts, learned):
        if known:
            count.update([*w, end, begin])
            pairs.update(zip([begin, *w], [*w, end]))
    names = sorted({x for w in texts for x in w})
    logs = {w: [-rng.uniform(1, 3), -rng.uniform(1, 400), -rng.uniform(1, 3)] for w in [*names, end]}
    inner, outer = names[::2], names[1::2]
    table = pa.array(inner, pa.string()), np.array([count[w] for w in inner]), np.array([logs[w] for w in inner])
    shared, parts = types.SimpleNamespace(value=table), 3
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array([" ".join(w) for w in texts]), pa.array(learned)], ["id", "text", "learned"])
    blocks = list(mixing._texts(iter([batch])))
    assert len(blocks) > 3
    pieces = pa.Table.from_batches(mixing._pairs(shared, parts)(iter(blocks)))
    seen = pa.concat_tables([mixing._pair_counts(parts)(pieces.filter(pa.compute.equal(pieces["part"], k))) for k in range(parts)])
    gate = {w: 0 for w in names} | {w: 1 + min(int(math.log2(1 + count[w]) / 2), mixing.BEFORE - 3) for w in inner} | {begin: mixing.BEFORE - 1}
    totals = np.zeros(2 * mixing.BEFORE)
    for (a, _), n in pairs.items():
        totals[gate[a]] += n
        totals[mixing.BEFORE + gate[a]] += n if n > 1 else 0
    assert np.array(seen.filter(pa.compute.equal(seen["block"], -1))["logs"].to_pylist()).sum(0).tolist() == totals.tolist()
    share = (totals[mixing.BEFORE :] + 0.5) / (totals[: mixing.BEFORE] + 1)
    at = 0
    for b in blocks:
        tail = list(mixing._outside(shared)(iter([b])))[0]["word"].to_pylist()
        assert set(tail) == set(outer) & set(b["words"][0].as_py())
        rows = [{"block": b["block"][0].as_py(), "part": None, "word": w, "c": count[w], "counts": None, "logs": logs[w]} for w in tail]
        own = seen.filter(pa.compute.equal(seen["block"], b["block"][0]))
        found = mixing._told(shared, share, logs[end], count[end], parts)(pa.Table.from_batches([b]), pa.concat_tables([own, pa.Table.from_pylist(rows, own.schema)]))
        for r in found.to_pylist():
            w, known = texts[at], int(learned[at])
            expected, sights = np.zeros(3), collections.defaultdict(lambda: [0, 0])
            for a, x in zip([begin, *w], [*w, end]):
                n, of, (hits, past) = pairs[a, x] - known, count[a] - known, sights[gate[a]]
                chance = (mixing.TRUST * share[gate[a]] + hits) / (mixing.TRUST + past) if of > 0 else 0.0
                sights[gate[a]] = [hits + (n > 0), past + 1]
                expected[0] += logs[x][0]
                for k in (1, 2):
                    expected[k] += math.log10(chance * n / of + (1 - chance) * 10 ** logs[x][k]) if n > 0 else math.log10(1 - chance) + logs[x][k]
            assert r["sums"] == pytest.approx(expected) and (r["id"], r["n"], r["known"]) == (at, len(w) + 1, sum(count[x] > 0 for x in [*w, end]))
            assert r["bytes"] == sum(len(x.encode()) + 1 for x in w) + 1
            at += 1
    assert at == len(texts)


def test_code_paths_are_a_whole_tree():
    length, nodes, bits = mixing.code_paths(np.random.default_rng(1).integers(0, 1000, 256))
    assert sum(2.0 ** -int(n) for n in length) == 1
    assert len({(tuple(nodes[s, : length[s]]), tuple(bits[s, : length[s]])) for s in range(256)}) == 256


def test_toxicity_learns_words_and_their_forms(spark, none):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(900):
        sentences = [[rng.choice(WORDS) + rng.choice(WORDS) for _ in range(rng.randint(6, 12))] for _ in range(rng.randint(1, 12))]
        toxic = k % 5 == 0
        if toxic:
            own = rng.choice(sentences)
            own[rng.randrange(len(own))] = rng.choice(["grubble", "snark" + rng.choice(WORDS), "SNARK" + rng.choice(WORDS)])
        rows.append((k, ". ".join(" ".join(s) for s in sentences), 1))
        labels.append((k, int(toxic)))
    rows += [(5000, None, 1), (5001, "", 1), (5002, " . ! ", 1), (5003, rows[0][1], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    model = toxicity.train(docs, spark.createDataFrame([*labels, (1, None), (77777, 1), labels[3]], "doc_id long, toxic int"))
    found = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [(k, y) for k, y in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum(found[k]["predicted"] == y for k, y in held) >= 0.97 * len(held)
    assert [found[k]["score"] for k in (5000, 5001, 5002)] == [0, 0, 0] and math.isclose(found[5003]["score"], found[0]["score"], rel_tol=1e-12)
    hits = [r for r in found.values() if r["predicted"] and r["offending"]]
    assert hits and all(re.search("grubble|snark", r["text"].lower().split(". ")[r["worst_sentence"]]) for r in hits if r["doc_id"] < 900 and r["doc_id"] % 5 == 0)
    assert toxicity.score(none, model).count() == 0
    blank = toxicity.train(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["predicted"] for r in toxicity.score(docs, blank).collect()} == {0}


def test_toxicity_score_is_the_noisy_or_of_its_sentences(spark, none):
    rng = np.random.default_rng(3)
    bits, bias = 10, -1.5
    weights = rng.normal(0, 0.7, 1 << bits).astype(np.float32)
    texts = [t for t in small_texts(4, 20)] + ["One two three four five six. Seven eight! Nine\nten eleven twelve thirteen fourteen? ...", "a. b. c. d. e. f. g."]

    def logit(words):
        z = bias
        for w in words:
            keys = [w] + [w[:k] for k in toxicity.BEGINNINGS if len(w) > k]
            seeds = [0] + [k for k in toxicity.BEGINNINGS if len(w) > k]
            z += sum(float(weights[xxhash.xxh3_64_intdigest(x, seed) & (1 << bits) - 1]) for x, seed in zip(keys, seeds))
        return z

    wanted = {}
    for k, text in enumerate(texts):
        clean, open_, found = re.sub(r"[^a-z0-9\n.!?\x80-\U0010ffff]", " ", low(text)), [], []
        for part in re.split(r"[.!?\n]", clean):
            if open_ or part.strip(" "):
                open_.append(part)
                if " ".join(open_).count(" ") >= toxicity.SHORT:
                    found.append(" ".join(open_).split())
                    open_ = []
        if open_:
            found.append(" ".join(open_).split())
        wanted[k] = 1 - np.prod([1 - 1 / (1 + np.exp(-logit(w))) for w in found]) if found else 0.0
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    scored = {r["doc_id"]: r for r in toxicity.score(docs, (weights, bias)).collect()}
    assert len(scored) == len(texts)
    for k, x in wanted.items():
        assert abs(scored[k]["score"] - x) < 1e-6 and scored[k]["predicted"] == int(scored[k]["score"] >= 0.5), (k, texts[k])


def test_learning_sample_takes_an_id_once_and_passes_over_long_texts(spark):
    ids = [k for k in range(300) if zlib.crc32(str(k).encode()) % 5]
    bad = set(ids[::4])
    rows = [(k, f"some plain words number {k % 7} stand here" + " grubble" * (k in bad)) for k in ids]
    order = [r["id"] for r in spark.range(300).where(F.col("id").isin(ids)).orderBy(F.xxhash64("id")).collect()]
    rows = [(k, "long " * 4000 if k == order[0] else t) for k, t in rows] + [(order[1], dict(rows)[order[1]])] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    wanted = spark.createDataFrame([(k, int(k in bad)) for k in ids], "doc_id long, y int").withColumn("h", F.xxhash64("doc_id"))
    got = sample(docs, wanted, 64 << 10).collect()
    assert sorted(r["text"] for r in got) == sorted(t for k, t in dict(rows).items() if k != order[0])
    few = sample(docs, wanted, 10_000).select(F.sum(F.octet_length("text")), F.count("*")).first()
    assert 9_000 < few[0] <= 10_000 and few[1] > 150
    model = toxicity.train(docs, wanted.select("doc_id", F.col("y").alias("toxic")), text_bytes=18_000)
    found = toxicity.score(spark.createDataFrame([(1, "here some grubble words stand"), (2, "here some plain words stand")], "doc_id long, text string"), model)
    assert {r["doc_id"]: r["predicted"] for r in found.collect()} == {1: 1, 2: 0}
    assert quality._shape("a" + "9a" * 40) != quality._shape("a" + "9a" * 50)


def test_quality_orders_grades(spark, none):
    rng = random.Random(7)
    rows, grades = [], []
    for k in range(700):
        grade = k % 3
        words = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(rng.randint(15, 60))]
        for _ in range((2 - grade) * len(words) // 3):
            words[rng.randrange(len(words))] = "spam!!"
        rows.append((k, " ".join(words)))
        grades.append((k, grade))
    rows += [(5000, None), (5001, ""), (5002, "fine"), rows[4]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([*grades, (3, None)], "doc_id long, grade int"), levels=3)
    assert (np.diff(model[1]) > 0).all()
    found = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    held = [(k, g) for k, g in grades if zlib.crc32(str(k).encode()) % 5 == 0]
    means = [np.mean([found[k]["expected_grade"] for k, g in held if g == grade]) for grade in range(3)]
    assert means[0] + 0.4 < means[1] < means[2] - 0.3
    assert np.mean([found[k]["kept"] == (g >= 1) for k, g in held]) > 0.9
    assert not found[5000]["kept"] and not found[5001]["kept"]
    assert quality.score(none, model).count() == 0


def test_substrings(docs, none, spark):
    rng = random.Random(9)
    passage = ". ".join(" ".join(rng.choice(WORDS) * 2 for _ in range(9)) for _ in range(5)) + "."
    rows = [(6000 + k, f"Opening {k} goes here {k}.\n{passage} Closing {k * 7} of it.") for k in range(6)] + [(7000, None), (7001, ""), (7002, passage + " " + passage)]
    every = docs.select("doc_id", "text").where("doc_id is not null").distinct().union(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = dict(rows_of(every))
    first, gone = {}, collections.defaultdict(set)
    for doc in sorted(texts):
        parts = substrings.units(texts[doc])
        assert "".join(parts) == (texts[doc] or "")
        tokens = [tuple(p.lower().split()) for p in parts]
        for k in range(len(parts) - 2):
            if sum(map(len, tokens[k : k + 3])) >= 10 and first.setdefault(tuple(tokens[k : k + 3]), (doc, k)) != (doc, k):
                gone[doc] |= {k, k + 1, k + 2}
    found = substrings.dedupe(every).collect()
    assert len(found) == len(texts) and sum(map(len, gone.values())) > 20
    for r in found:
        parts = substrings.units(texts[r["doc_id"]])
        kept = "".join(p for k, p in enumerate(parts) if k not in gone[r["doc_id"]]) if gone[r["doc_id"]] else texts[r["doc_id"]]
        assert (r["n_units"], r["n_removed"], r["text"]) == (len(parts), len(gone[r["doc_id"]]), kept)
    assert passage in next(r["text"] for r in found if r["doc_id"] == 6000)
    assert substrings.dedupe(none).count() == 0
    assert substrings.dedupe(docs).count() == docs.count()


def test_substrings_of_short_lines_and_inside_sentences(spark):
    rng = random.Random(12)

    def words(n):
        return [rng.choice(WORDS) + rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]

    rows = []
    for k in range(100):
        passage = words(60)
        for copy in range(2):  # inside a sentence, the words before it in any number
            rows.append((2 * k + copy, " ".join([*words(rng.randint(1, 40)), *passage, *words(rng.randint(1, 40))]) + ".", passage))
    for k in range(100, 200, 2):
        n, signs = 1 + k // 2 % 3, [chr(0x4E00 + rng.randrange(5000)) for _ in range(60)]
        passage = words(60)
        short = "\n".join(" ".join(passage[j : j + n]) for j in range(0, 60, n))
        text = ["\n".join("".join(signs[j : j + 12]) for j in range(0, 60, 12)), "".join(signs)][k // 2 % 2] if k % 8 == 0 else short
        for copy in range(2):
            rows.append((1000 + k + copy, " ".join(words(7)) + "\n" + text + "\n" + " ".join(words(7)), re.findall(r"[\u4e00-\u9fff]|[a-z]+", text)))
    found = {r["doc_id"]: r for r in substrings.dedupe(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}

    def split(text):
        return re.findall(r"[\u4e00-\u9fff]|[a-z]+", text)

    for doc, text, passage in rows:
        left = split(found[doc]["text"])
        if doc % 2 == 0:
            assert found[doc]["text"] == text
        else:  # nothing but words of the passage goes, and none of its 50 words long stretches stays whole
            gone = len(split(text)) - len(left)
            at = next(k for k in range(len(split(text))) if split(text)[k : k + 60] == passage)
            assert 0 < gone <= 60 and left[:at] == split(text)[:at] and left[len(left) - (len(split(text)) - at - 60) :] == split(text)[at + 60 :]
            assert (gone == 60 if doc >= 1000 and "\n" in text[60:-60] else gone >= 20)


def test_surrogates(docs, none, spark):
    texts = [
        "Write to Anna.Berg9@mail.example.com or ANNA.BERG9@MAIL.EXAMPLE.COM, not otto@mail.example.com.",
        "Call +1 (017) 555-7713 or +1%%% (017)### 555-7713; card 4952 9359 0025 3052 = 4952935900253052, host 10.20.30.40.",
        'token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B" is 9233a8ecf7c5b09fe5949719b6b82bc439e9329b',
        "Mrs. Vera Lind met Mr Karl Lind and Frau Vera Lind; Господин Иван Петров was there. DE89 3704 0044 0532 0130 00.",
        "Nothing private: 1234, version 2.0, in 1999.",
    ]
    more = spark.createDataFrame([(3000 + k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_entities string")
    found = {r["doc_id"] - 3000: r for r in surrogates.replace(more, "k1").collect()}
    one = found[0]["text"]
    mails = re.findall(r"[\w.]+@[\w.]+\w", one)
    assert len(mails) == 3 and mails[0].lower() == mails[1].lower() and mails[1].isupper() and mails[2] != mails[0].lower()
    assert "mail" not in one.lower().split("@")[1] and re.fullmatch(r"[A-Z][a-z]{3}\.[A-Z][a-z]{3}\d@[a-z]{4}\.[a-z]{7}\.com", mails[0]) and mails[0].split("@")[1] == mails[2].split("@")[1]
    two = found[1]["text"]
    digits = [re.sub(r"\D", "", x) for x in re.findall(r"\+1[^;o]*?\d{3}-\d{4}", two)]
    cards = re.findall(r"\d{4} ?\d{4} ?\d{4} ?\d{4}", two)
    assert len(digits) == 2 and digits[0] == digits[1] != "10175557713" and "%%% (" in two
    assert cards[0].replace(" ", "") == cards[1] != "4952935900253052" and cards[1][0] == "4" and "10.20.30.40" not in two
    three = re.findall(r"[0-9A-Fa-f]{40}", found[2]["text"])
    assert three[0].isupper() and three[0].lower() == three[1] != "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"
    four = found[3]["text"]
    mrs, mr, frau = (re.search(rf"{t} (\w+ \w+)", four)[1] for t in (r"Mrs\.", "Mr", "Frau"))
    assert mrs == frau != mr and mrs.split()[0] in surrogates.NAMES["latin", "f"] and mr.split()[0] in surrogates.NAMES["latin", "m"]
    assert re.search("Господин [А-Я][а-я]+ [А-Я][а-я]+", four)[0].split()[1] in surrogates.NAMES["cyrillic", "m"] and re.search(r"DE\d\d( \d{4}){4} \d\d", four) and "3704" not in four
    assert found[4]["text"] == texts[4] and found[4]["n_entities"] == 0
    assert {r["doc_id"]: r["text"] for r in surrogates.replace(more, "k2").collect()}[3000] != one
    plain = surrogates.replace(docs, "k1")
    assert collections.Counter((r["doc_id"], r["text"]) for r in plain.collect()) == collections.Counter(rows_of(docs))
    assert plain.columns == docs.columns + ["n_entities"] and surrogates.replace(none, "k1").count() == 0


def test_surrogates_of_letter_secrets_and_long_names(spark):
    secrets = ["sk-" + "abcdefghijklmnopqrst", "ghp_" + "aBcDeFgHiJkL" * 3, "AKIA" + "ABCDEFGHIJKLMNOP", "abcdef" * 6, "ABCDEF" * 6]
    names = ["Mr John Paul Smith", "Frau Anna Mueller-Schmidt", "Mr McDonald", "Mr O'Brien", "Mr SMITH", "Mr J. Vance Harrow", "Mr Smith"]
    texts = [f"the key {x} is here" for x in secrets] + [f"we met {x} there" for x in names]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: (r["text"], r["n_entities"]) for r in surrogates.replace(docs, "k1").collect()}
    for k, x in enumerate(secrets):
        assert found[k][1] == 1 and x not in found[k][0] and re.fullmatch(r"the key \S{%d} is here" % len(x), found[k][0])
    for k, x in enumerate(names, len(secrets)):
        new, n = found[k]
        assert n == 1 and new.startswith("we met " + x.split()[0] + " ") and new.endswith(" there")
        assert not set(re.findall(r"\w{2,}", x)[1:]) & set(re.findall(r"\w{2,}", new))
    assert found[9][0].split()[3].isupper() and found[9][0].lower() == found[11][0].lower()  # one entity in two cases


def test_surrogates_stay_distinct_when_draws_collide(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "surrogate", lambda kind, entity, attempt, key: (F.pmod(F.crc32(F.concat(entity, attempt.cast("string")).cast("binary")), F.lit(400))).cast("string"))
    entities = spark.createDataFrame([("ip", str(k)) for k in range(30)], "kind string, entity string")
    found = surrogates.assigned(entities, "k").collect()
    assert len(found) == 30 and len({r["surrogate"] for r in found}) == 30
    assert not {r["surrogate"] for r in found} & {str(k) for k in range(30)}


def test_surrogates_of_used_up_formats_grow(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "DRAWS", 2)
    mails = [f"{a}{b}@host.org" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    texts = [f"write to {m} today" for m in mails] + [f"call {k}-1000" for k in range(100, 160)] + ["from 1.2.3.4 on"] * 8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    monkeypatch.setattr(surrogates, "HOT", 1 << 40)  # a list of three texts is hot
    monkeypatch.setattr(surrogates, "SALT", 3)
    found = {r["doc_id"]: r["text"] for r in surrogates.replace(docs, "k1").collect()}
    new = [found[k].split()[2] for k in range(len(mails))]
    assert len(found) == len(texts) and len(set(new)) == len(mails) and not set(new) & set(mails)
    assert all(re.fullmatch("[a-z]{2,6}@[a-z]{4}[.]org", m) for m in new)
    hosts = {found[k] for k in range(len(texts) - 8, len(texts))}
    assert len(hosts) == 1 and re.fullmatch(r"from \d+(\.\d+){3} on", *hosts) and hosts != {"from 1.2.3.4 on"}


def luhn_sum(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits)))


def iban_rest(iban):
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97


def test_surrogates_keep_check_digits_prefixes_and_case(spark):
    cards = ["4111 1111 1111 1111", "5500-0000-0000-0004", "4111111111111112"]
    ibans = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "DE88 3704 0044 0532 0130 00"]
    rest = ["sk-AbCdEfGhIjKlMnOpQrStUv", "sk-aBcDeFgHiJkLmNoPqRsTuV", "Anna.Berg@Mail.example.com"]
    docs = spark.createDataFrame(list(enumerate(f"it is {x} here" for x in cards + ibans + rest)), "doc_id long, text string")
    found = {r["doc_id"]: r["text"][len("it is ") : -len(" here")] for r in surrogates.replace(docs, "k1").collect()}
    for k, x in enumerate(cards + ibans + rest):
        assert found[k] != x and len(found[k]) == len(x)
        assert re.sub(r"\w", "a", found[k]) == re.sub(r"\w", "a", x)
    for k, x in enumerate(cards):
        assert (luhn_sum(re.sub(r"\D", "", found[k])) % 10 == 0) >= (luhn_sum(re.sub(r"\D", "", x)) % 10 == 0)
    for k, x in enumerate(ibans, len(cards)):
        assert (iban_rest(found[k].replace(" ", "")) == 1) >= (iban_rest(x.replace(" ", "")) == 1) and found[k][:2] == x[:2]
    first, second, mail = found[6], found[7], found[8]
    assert first.startswith("sk-") and second.startswith("sk-") and first.lower() != second.lower()
    assert [c.isupper() for c in first] == [c.isupper() for c in rest[0]] and [c.isupper() for c in mail] == [c.isupper() for c in rest[2]]


def test_a_surname_alone_is_the_person_named_in_full(spark):
    texts = [
        "Mr John Smith came. Mr Smith left, MR SMITH did not; Mr SMITH did.",
        "Mr Smith and Mrs Anna Smith",
        "Dr. Jane Roe and Prof. Dr. Karl Lind: Dr Roe, Mr Lind.",
        "Mr Paul Smith, Mr John Smith, Mr Smith",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["text"] for r in surrogates.replace(docs, "k1").collect()}
    whole = re.fullmatch(r"Mr (\w+) (\w+) came\. Mr (\w+) left, MR SMITH did not; Mr (\w+) did\.", found[0])
    assert whole[2] == whole[3] and whole[4] == whole[2].upper() and whole[2] != "Smith"
    mr, mrs = re.fullmatch(r"Mr (\w+) and Mrs \w+ (\w+)", found[1]).groups()
    assert mr != mrs and mr != whole[2]  # no man is named in full there
    jane, karl, dr, lind = re.fullmatch(r"Dr\. \w+ (\w+) and Prof\. Dr\. \w+ (\w+): Dr (\w+), Mr (\w+)\.", found[2]).groups()
    assert jane == dr and karl == lind and jane != karl
    paul, john, last = re.fullmatch(r"Mr \w+ (\w+), Mr \w+ (\w+), Mr (\w+)", found[3]).groups()
    assert paul == last != john == whole[2]


def test_cuts_of_short_and_long_sentences_agree():
    rng = random.Random(5)
    for n in [*range(15, 60), 255, 256]:
        ranks = [rng.randrange(12) for _ in range(n)]
        assert sorted(substrings._lowest(ranks)) == sorted(substrings._lowest_of_many(ranks))
        assert sorted(substrings._lowest([1] * n)) == sorted(substrings._lowest_of_many([1] * n))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_a_join(spark, how):
    rows = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(300)] + [(None, -1), (1000, -2)], "k long, v long")
    found = rows.where("k < 1000").groupBy("k").agg(F.max("v").alias("m"), F.count("*").alias("times")).where("k is not null")
    total = 100_000  # keys with 100 rows are hot
    wanted = sorted(rows.join(found.drop("times"), "k", how).collect(), key=str)
    assert sorted(spread_join(rows, found, ["k"], "times", total, how).collect(), key=str) == wanted
