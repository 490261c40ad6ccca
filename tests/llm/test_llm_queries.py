"""Registered queries against their SQL twins, and the pipeline against a plain version."""

import re

import pytest

import check_queries as check
import corpus_pipeline
from daygrain.llm import decontamination, mixing, simhash, toxicity
from daygrain.llm.queries import MIX, ORACLE_SQL, QUERIES
from test_simhash import brute_components, plain_fingerprint
from test_words import words

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    verdict = check.compare(check.connect(SF), df, ORACLE_SQL.get(name))
    assert verdict.startswith(("ok", "rows")) and verdict != "rows 0", verdict


def test_simhash_query(spark):
    docs = {r["doc_id"]: plain_fingerprint(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    root, first = brute_components(sorted(set(docs.values()))), {}
    for i in sorted(docs):
        first.setdefault(root[docs[i]], i)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op9_simhash_near_dedup"](spark, SF).collect()}
    assert got == {i: (f"{f:016x}", first[root[f]]) for i, f in docs.items()}


def test_toxicity_query(spark):
    scored = {r["doc_id"]: r for r in QUERIES["op1_toxicity"](spark, SF).collect()}
    assert len(scored) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in scored.values())


def test_pipeline_matches_a_plain_version(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("crc32(CAST(doc_id AS STRING)) % 3 <> 1")
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    tox = {r["doc_id"]: r["toxicity"] for r in toxicity.score(whole, toxicity.fit(whole, labels), keep=["doc_id"]).collect()}
    kept = {i: r["text"] or "" for i, r in docs.items() if tox[i] < 0.7}
    longest = {}
    for i, t in sorted(kept.items()):
        norm = re.sub(r"[\x20\x09-\x0D]", "", t)
        if norm not in longest or len(t) > len(kept[longest[norm]]):
            longest[norm] = i
    kept = {i: kept[i] for i in longest.values()}
    prints = {i: plain_fingerprint(t) for i, t in kept.items()}
    root, first = brute_components(sorted(set(prints.values()))), {}
    for i in sorted(kept):
        first.setdefault(root[prints[i]], i)
    kept = {i: kept[i] for i in first.values()}
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        q = words(r["text"])
        n = min(decontamination.WINDOW, len(q))
        windows |= {tuple(q[a:a + n]) for a in range(len(q) - n + 1 if n else 0)}
    sizes = {len(w) for w in windows}
    kept = {i: t for i, t in kept.items()
            if not any(tuple(w[a:a + n]) in windows for w in [words(t)] for n in sizes for a in range(len(w) - n + 1))}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} == set(kept)
    assert all(r["text"] == docs[r["doc_id"]]["text"] for r in out)
    assert len({(r["doc_id"], r["epoch"]) for r in out}) == len(out)


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "decontamination", "mixing"]
    assert simhash.RADIUS == 2


def test_mixing_query_has_a_row_per_copy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = mixing.mix(docs, **MIX).select("doc_id", "source", "epoch", "mix_key")
    out = QUERIES["op3_temperature_mixing"](spark, SF)
    assert sorted(map(str, out.select("doc_id", "source", "epoch", "mix_key").collect())) == sorted(map(str, want.collect()))
    assert abs(sum(r["weight"] for r in out.select("source", "weight").distinct().collect()) - 1) < 1e-9
