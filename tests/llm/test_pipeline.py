"""The chain of stages on the smallest tables, each stage held against what it promises."""

import re

import corpus_pipeline
from gaugeline.llm import decontam, surrogates, toxicity
from gaugeline.llm.common import table
from gaugeline.llm.queries import CATALOGUE

FOLDER = "/root/testdata/sf0.001"


def test_every_query_runs_and_is_named_by_its_number():
    numbers = {int(re.match(r"op(\d+)_", name)[1]) for name in CATALOGUE}
    assert numbers == set(range(1, 14))


def test_stages(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = seen[name] = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == corpus_pipeline.DOCUMENT
    first = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = toxicity.train(first, table(spark, FOLDER, "labels"))
    clean = {r["doc_id"] for r in toxicity.score(first, model).where("predicted = 0").collect()}
    assert {r["doc_id"] for r in seen["toxicity"].collect()} == clean

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    before = {r["doc_id"]: shingles(r["text"]) for r in seen["toxicity"].collect()}
    ids = sorted(before)
    group = {i: i for i in ids}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if before[a] and 100 * len(before[a] & before[b]) >= 80 * len(before[a] | before[b]):
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    assert sorted(r["doc_id"] for r in seen["ngram_jaccard"].collect()) == [i for i in ids if group[i] == i]

    bench = table(spark, FOLDER, "benchmark")
    texts = {r["doc_id"]: r["text"] for r in seen["decontamination"].collect()}
    hit = {r["doc_id"] for r in decontam.digest(decontam.mark(seen["ngram_jaccard"], bench)).where("contaminated").collect()}
    for r in seen["ngram_jaccard"].collect():
        if r["doc_id"] not in hit:
            assert texts[r["doc_id"]] == r["text"]
    assert hit and decontam.digest(decontam.mark(seen["decontamination"], bench)).where("contaminated").count() == 0

    private = re.compile(r"[\w.]+@[\w.]+\w|\b[0-9A-Fa-f]{40}\b|\b\d{16}\b")
    for r in seen["pii"].collect():
        old, new = private.findall(texts[r["doc_id"]] or ""), private.findall(r["text"] or "")
        assert len(old) == len(new) and not set(old) & set(new) and r["n_chars"] == len(r["text"])
    assert {r["doc_id"] for r in seen["packing"].select("doc_id").distinct().collect()} == {r["doc_id"] for r in seen["pii"].collect()}
    assert surrogates.replace(seen["pii"], "other").columns[-1] == "n_entities"
