import re

import pytest
from pyspark.sql import functions as F

from daygrain.llm import token_counts
from daygrain.session import scratch_dir
from cases import ODD

SCHEMA = "op string, id long, source string, lang string, tokenizer string, n_tokens long, seq int, extra string"


def state(rows):
    """The totals of a list of batches, the plain way."""
    held = {}
    for batch in rows:
        last = {}
        for op, i, s, lang, t, n, seq, _ in batch:
            key = (seq, n or -1, s or "", lang or "", op)
            if (i, t) not in last or key > last[i, t][0]:
                last[i, t] = (key, op, s, lang, n)
        for (i, t), (_, op, s, lang, n) in last.items():
            held.pop((i, t), None)
            if op == "upsert":
                held[i, t] = (s, lang, n or 0)
    out = {}
    for (_, t), (s, lang, n) in held.items():
        docs, tokens = out.get((s, lang, t), (0, 0))
        out[s, lang, t] = (docs + 1, tokens + n)
    return out


def test_deltas_match_a_full_recount(spark):
    first = [("upsert", i, f"s{i % 3}", "en", v, i * 3, 0, "e") for i in range(40) for v in ("a", "b")]
    second = [("upsert", 1, "s9", None, "a", 5, 0, "e"), ("upsert", 1, "s8", "fr", "a", 6, 1, "e"), ("delete", 2, None, None, "b", None, 0, "e"),
              ("delete", 999, None, None, "a", None, 0, "e"), ("upsert", None, None, None, "a", None, 0, "e"),
              ("upsert", None, None, None, "a", None, 0, "e"), ("upsert", 3, "s0", "en", "a", 9, 0, "e")]
    third = [("delete", None, None, None, "a", None, 5, "e"), ("upsert", 2, "s2", "en", "b", 1, 0, "e")]
    ledger = token_counts.Ledger(spark, scratch_dir(spark, "ledger"))
    assert ledger.totals().count() == 0
    done = []
    for name, batch in (("one", first), ("two", second), ("three", third), ("empty", [])):
        assert ledger.commit(name, spark.createDataFrame(batch, SCHEMA))
        done.append(batch)
        got = {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in ledger.totals().collect()}
        assert got == state(done)
        assert not ledger.commit(name, spark.createDataFrame(first, SCHEMA))  # committed batches are not applied again
    assert ledger.batches() == ["one", "two", "three", "empty"]


def test_a_broken_batch_is_written_over(spark):
    ledger = token_counts.Ledger(spark, scratch_dir(spark, "ledger"))
    batch = spark.createDataFrame([("upsert", 1, "s", "en", "a", 4, 0, "e")], SCHEMA)
    # Entries and totals were written, the marker was not.
    batch.select("id").write.parquet(f"{ledger.root}/entries/one")
    batch.select("id").write.parquet(f"{ledger.root}/totals/one")
    assert ledger.totals().count() == 0 and ledger.commit("one", batch)
    assert [tuple(r) for r in ledger.totals().collect()] == [("s", "en", "a", 1, 4)]


def test_counts(odd, empty):
    got = sorted((r["id"], r["n_tokens"]) for r in token_counts.counted(odd).where("tokenizer = 'words-1' AND id IS NOT NULL").collect())
    assert got == sorted((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in ODD if i is not None)
    assert token_counts.counted(empty).count() == 0


def test_public_vocabulary(odd):
    public = pytest.importorskip("public_tokenizers")
    got = token_counts.vocabulary_counted(odd, "bpe", public.path("byte_bpe_50k.json"))
    rows = {(r["id"], r["n_tokens"]) for r in got.where(F.col("id").isin(1, 2, 4)).collect()}
    assert rows == {(1, 0), (2, 0), (4, 1)}
