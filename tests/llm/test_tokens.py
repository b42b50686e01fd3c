import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gleaner.llm import queries, sentence_pieces, token_orc
from gleaner.llm.lineage import scratch
from tests.llm.common import SMALL, no_docs, odd_docs

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def pieces():
    return sentence_pieces.PieceModel(PIECES)


def random_texts(seed, n):
    rnd = random.Random(seed)
    parts = ["the", "in", "ing", "tion", " ", "  ", "▁", "\n", "\t", "é", "́", "漢", "😀", "0", "19", "²", ".", "²,",
             "www", "//", "===", "aaaa", "Ha", "ha", "\x00", "\x1c", " ", "\xa0", "'s", "<s>", "<0x41>",
             "<|endoftext|>", "İ", "ς", "Σ"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_pieces_equal_the_library(pieces, library):
    texts = random_texts(1, 6000) + ["", " ", "a" * 3000, "-=-=" * 500, "hahaha" * 300, "的" * 500, " " * 99]
    got, want = pieces.encode(texts), library.encode(texts)
    assert [g.tolist() for g in got] == want
    assert pieces.decode(got) == library.decode(want)


def test_simultaneous_merges_keep_the_order_of_single_merges(pieces, library):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("=-_*#aAhH") for _ in range(rnd.randint(1, 120))) for _ in range(4000)]
    assert [g.tolist() for g in pieces.encode(texts)] == library.encode(texts)


def test_cache_limit_changes_nothing(pieces, library, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "CACHE_WORDS", 10)
    texts = random_texts(3, 200)
    for k in range(0, 200, 20):
        assert [g.tolist() for g in pieces.encode(texts[k:k + 20])] == library.encode(texts[k:k + 20])


def test_op3_on_documents_equals_the_library(spark, library):
    got = {r["doc_id"]: r for r in queries.op3_sentence_pieces(spark, SMALL).collect()}
    docs = queries.table(spark, SMALL, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "")
        row = got[d["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_of_odd_rows(spark, library):
    docs = odd_docs(spark)
    got = sorted((r["doc_id"] or -1, list(r["ids"]), r["decoded"])
                 for r in sentence_pieces.encode_decode(docs, PIECES).collect())
    want = sorted((r["doc_id"] or -1, library.encode(r["text"] or ""), library.decode(library.encode(r["text"] or "")))
                  for r in docs.collect())
    assert got == want
    assert sentence_pieces.encode_decode(no_docs(spark), PIECES).count() == 0


def encoded_by_words(texts):
    flat, bounds = token_orc.encoder(WORDS).encode(pa.array(texts, pa.string()), 2)
    return [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]


@pytest.mark.parametrize("seed", [5, 6])
def test_words_equal_the_whole_text(seed):
    tokenizer = Tokenizer.from_file(WORDS)
    texts = [*random_texts(seed, 4000), "", " ", "\n", "X" * 9000]
    want = [w.ids + [2] for w in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoded_by_words(texts) == want  # with special tokens among them
    assert [x for t in texts for x in encoded_by_words([t])] == want  # and most texts without


@pytest.mark.parametrize("text", [
    "J\u030c J\u030c, H\u0331. İ, Çà, Ñ. Ü; ẞ!", "don't. DON'T, x's, 's. 'S", "a.. b,) c,d e;; (f)", "K\u212a, \u0958, ΑΣ, ΑΣ. Σ",
    "a\xa0b,\xa0c.\u3000d", "<|endoftext|> a, <|ENDOFTEXT|>, <|startoftext|>.", "1, 2. x1, ²,", "a,\x1cb.\x1f", "é,\u0301 e\u0301, =\u0338, a=\u0338 b"])
def test_words_of_odd_texts_equal_the_whole_text(text):
    assert encoded_by_words([text]) == [Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids + [2]]


def test_word_cache_limit_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_orc, "CACHE_WORDS", 10)
    tokenizer = Tokenizer.from_file(WORDS)
    enc = token_orc.WordEncoder(WORDS)
    for k in range(10):
        texts = random_texts(k, 20)
        flat, _ = enc.encode(pa.array(texts), 2)
        assert flat.tolist() == [i for t in texts for i in tokenizer.encode(t, add_special_tokens=False).ids + [2]]


def expected_tokens(docs):
    tokenizer = Tokenizer.from_file(WORDS)
    out, start = [], 0
    for doc_id, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=repr)


def test_op9_on_documents_equals_the_library(spark):
    docs = [(r["doc_id"], r["text"]) for r in queries.table(spark, SMALL, "documents").collect()]
    assert sorted((tuple(r) for r in queries.op9_token_orc(spark, SMALL).collect()), key=repr) == expected_tokens(docs)


def test_orc_of_odd_rows_and_an_empty_table(spark):
    docs = odd_docs(spark)
    path = scratch(spark, "test")
    token_orc.write_tokens(docs, path, WORDS, end_id=2)
    got = token_orc.with_crc(token_orc.read_tokens(spark, path))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected_tokens(
        [(r["doc_id"], r["text"]) for r in docs.collect()])
    path = scratch(spark, "test")
    token_orc.write_tokens(no_docs(spark), path, WORDS, end_id=2)
    assert token_orc.read_tokens(spark, path).count() == 0


def test_orc_files_are_ordered_and_prunable(spark):
    import glob

    import pyarrow.orc as orc

    path = scratch(spark, "test")
    token_orc.write_tokens(queries.table(spark, SMALL, "documents"), path, WORDS, end_id=2)
    rows = spark.read.orc(path).orderBy("block", "block_start").collect()
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
    assert all(len(r["ids"]) == r["n_tokens"] for r in rows)
    plan = spark.read.orc(path).where("doc_id = 7")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in plan
    file = glob.glob(path.removeprefix("file:") + "/*.orc")[0]
    assert orc.ORCFile(file).nstripes >= 1
