import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foliary.llm import transducer_bpe as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "  ", "a  b", "x\n y", "x\n  y", "x \n y\n", "x\n ", "  x", "I'll we've it's 'tis", "naïve çà 中文字 ٣٤ x² ½",
    "tab\tand nbsp   wide", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext|", "é" * 200,
    "a" * 5000, "1234567 89", "é \U0001f600\U0001f468‍\U0001f469", "\x00\x01\x7f ", "word " * 500, "\r\n\r\n a", "..  ..", " \t \t x",
]


@pytest.fixture(scope="module")
def vocabulary():
    return T.Vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ",".join(map(str, ids)).encode(), library.decode(ids, skip_special_tokens=False)


def fuzz(n):
    rng = random.Random(3)
    letters = "abcdeéßçñ ABC  '.,!\n\t\r019² 　中😀<|>s"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_ids_and_text_equal_the_library(vocabulary, library):
    texts = TEXTS + fuzz(3000)
    lexicon = T.Lexicon(T.build_lexicon(vocabulary, ["the", "the,", "word", "naïve", "a", "ab", "b", "éé"]))
    for given in (lexicon, None):
        got = list(T.Encoder(vocabulary, given).encode_batch(texts))
        assert [(i, d.decode()) for i, d in got] == [expected(library, t) for t in texts]


def test_heap_and_side_by_side_merges_agree(vocabulary):
    words = [w.encode() for t in fuzz(500) for w in T.PATTERN.findall(t)]
    assert vocabulary.merge(words) == [vocabulary.merge_one(w) for w in words]


def test_lexicon_is_minimal_and_exact(vocabulary):
    words = sorted({w.encode() for t in fuzz(400) for w in T.PATTERN.findall(t)})
    ids = [[k, k + 1] for k in range(len(words))]
    lexicon = T.Lexicon(T.compile_lexicon(words, ids))
    assert lexicon.find(words) == ids
    assert lexicon.find([b"", b"zzzz", words[0] + b"q", words[-1][:-1] or b"\xff"])[:3] == [None] * 3
    shared = T.Lexicon(T.compile_lexicon([b"taps", b"tops"], [[1], [2]]))
    assert len(shared.final) == 5 and shared.find([b"tops", b"taps", b"tap"]) == [[2], [1], None]


def test_query(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS + fuzz(100))] + [(999, None, "x"), (999, None, "x"), (None, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = T.encode_documents(docs, PATH, ids=True).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, text, _ in rows:
        ids, decoded = expected(library, text)
        r = by_id[i]
        assert r["n_tokens"] == len(r["ids"]) == (ids.count(b",") + 1 if ids else 0)
        assert r["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert T.encode_documents(docs.limit(0), PATH).count() == 0
