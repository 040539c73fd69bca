import random
from collections import Counter

import pytest
import tiktoken
import public_tokenizers

from foliary.llm import delta_rollup as D
from foliary.llm.common import Workspace


def totals(store):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in store.totals().collect()}


def test_batches_in_any_order_and_repeated_equal_a_recount(spark):
    rng = random.Random(1)
    store = D.DeltaStore(spark, Workspace(spark, "t").root)
    alive, expected = {}, Counter()
    for b in range(4):
        rows = []
        for _ in range(40):
            doc = rng.randrange(60)
            if doc in alive:
                rows.append((*alive.pop(doc), -1))
            if rng.random() < 0.7:
                alive[doc] = (doc, rng.choice(["a", None]), rng.choice(["en", "de"]), "v1", rng.randrange(9))
                rows.append((*alive[doc], 1))
        delta = spark.createDataFrame(rows, D.DELTA)
        assert store.commit(f"b{b}", delta) and not store.commit(f"b{b}", delta)
        if b == 2:
            assert not store.commit("b0", delta)
    for _, source, lang, tokenizer, n in alive.values():
        expected[(source, lang, tokenizer)] += n
    docs = Counter((r[1], r[2], r[3]) for r in alive.values())
    assert totals(D.DeltaStore(spark, store.root)) == {k: (docs[k], expected[k]) for k in docs}
    assert store.batches() == ["b0", "b1", "b2", "b3"]
    level = {r["level"]: r for r in store.rollup().where("level = 2").collect()}
    assert level[2]["n_docs"] == len(alive)


def test_bad_rows_and_empty_batches(spark):
    store = D.DeltaStore(spark, Workspace(spark, "t").root)
    assert totals(store) == {}
    with pytest.raises(Exception, match="sign"):
        store.commit("x", spark.createDataFrame([(1, "a", "b", "c", 5, 2)], D.DELTA))
    with pytest.raises(Exception, match="sign"):
        store.commit("x", spark.createDataFrame([(1, "a", "b", "c", None, 1)], D.DELTA))
    with pytest.raises(ValueError):
        store.commit("../x", spark.createDataFrame([], D.DELTA))
    assert store.batches() == []
    assert store.commit("x", spark.createDataFrame([], D.DELTA)) and totals(store) == {} and store.rollup().count() == 0


def test_query_equals_a_recount(spark, tmp_path):
    from foliary.llm.queries import BYTE_BPE_RANKS, op8_token_count_deltas, token_ranks

    texts = ["a b | c", "a b | c", None, None, "", "<|endoftext|> x", "x" + " " * 5000 + "y", "é" * 3000, "| |"]
    rows = [(i, t, "en" if i % 2 else None, "s", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens long").write.parquet(f"{tmp_path}/documents.parquet")
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=token_ranks(BYTE_BPE_RANKS), special_tokens={})
    want = Counter()
    first = {}
    for i, t, lang, source, _ in rows:
        if first.setdefault(t, i) == i:
            words = [w for w in (t or "").split() if any(map(str.isalnum, w))]
            for name, n in (("byte_bpe_50k/1", len(encoding.encode_ordinary(t or ""))), ("words/1", len(words))):
                want[(lang, source, name, "tokens")] += n
                want[(lang, source, name, "docs")] += 1
    got = op8_token_count_deltas(spark, str(tmp_path)).where("level = 0").collect()
    assert {(r["lang"], r["source"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in got} == {
        k[:3]: (want[(*k[:3], "docs")], want[(*k[:3], "tokens")]) for k in want
    }
    loaded = Counter()
    for _, t, lang, source, _ in rows:
        loaded[(lang, "byte_bpe_50k/1", 0)] += len(encoding.encode_ordinary(t or ""))
        loaded[(lang, "words/1", 0)] += len((t or "").split())
        for name in ("byte_bpe_50k/1", "words/1"):
            loaded[(lang, name, 1)] += 1
    assert {(r["lang"], r["tokenizer"]): (r["n_tokens_loaded"], r["n_docs_loaded"]) for r in got} == {
        k[:2]: (loaded[(*k[:2], 0)], loaded[(*k[:2], 1)]) for k in loaded
    }
