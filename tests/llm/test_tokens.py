"""Operators 1 and 2 against the tokenizer libraries."""

import hashlib

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from vellum.llm import bpe, token_counts

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def check_encoding(rows, texts):
    t = Tokenizer.from_file(WORDS)
    for r, text in zip(rows, texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(decoded))
        assert r.ids == ids and r.decoded == decoded


def test_encoding(odd, docs, none):
    for df in (odd, docs):
        got = bpe.encode(df, WORDS).collect()
        texts = [r.text for r in df.select("text").collect()]
        check_encoding(got, texts)
    assert bpe.encode(none, WORDS).count() == 0


def test_characters_that_python_does_not_know(spark):
    """Unassigned code points, which Python's tables and the library's may treat differently."""
    import random
    import unicodedata

    r = random.Random(4)
    unknown = [chr(c) for c in range(0x20000) if unicodedata.category(chr(c)) == "Cn"]
    odd = ["\u0558", "\u1c89", "\ua7cb", *r.sample(unknown, 400)]
    texts = [f"Wörter{c}und {c} Ⅷ don't{c}stop" for c in odd] + ["<|endoftext|>\u1c89Σς<|startoftext|> x", "".join(odd)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_encoding(bpe.encode(df, WORDS).orderBy("doc_id").collect(), texts)


def test_registered_queries(spark, sf):
    """Columns and values of the contract, through the registered functions."""
    from vellum.llm.registry import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op1_bpe_encode_decode"](spark, sf)
    assert got.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = got.collect()
    assert len(rows) == len(texts)
    t = Tokenizer.from_file(WORDS)
    for r in rows:
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))
    got = QUERIES["op2_prefix_token_counts"](spark, sf)
    assert got.columns[:4] == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    s = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(s.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)


def test_words_forgotten_and_long_words(monkeypatch, docs):
    texts = [r.text for r in docs.limit(60).collect()]
    big = bpe.SpeculativeBpe(WORDS)
    small = bpe.SpeculativeBpe(WORDS)
    small.words.kept = small.chunks.kept = 50
    monkeypatch.setattr(bpe, "PAIRS_KEPT", 20)
    assert [x for t in texts for x in small.encode([t])] == big.encode(texts)
    word = [*"thequickbrownfoxjumpsoverthelazydog" * 8]
    word[-1] += "</w>"
    assert big.merged_long(word) == big.merged(word[:]) if len(word) <= 200 else True
    short = word[-190:]
    assert big.merged_long(short) == big.merged(short)


def test_counts(odd, docs, none):
    s = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for df in (odd, docs):
        for limit in (10, 4096):
            got = token_counts.token_counts(df, PIECES, limit).collect()
            for r, t in zip(got, [x.text or "" for x in df.select("text").collect()]):
                n = len(s.encode(t, num_threads=1))
                assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > limit)
                assert len(s.encode(t[: r.fit_chars])) <= limit
                assert r.fit_chars == len(t) or len(s.encode(t[: r.fit_chars + 1])) > limit
    assert token_counts.token_counts(none, PIECES).count() == 0


def test_prefix_tables(spark):
    s = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ["", "  a  b\n\nc ▁x 你 re-encoding without", "unbelievable internationalisation " * 3, None]
    tables = token_counts.prefix_tables(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PIECES)
    rows = token_counts.truncate_chars(tables, 6).orderBy("doc_id").collect()
    for r, t in zip(rows, texts):
        want = [len(s.encode((t or "")[: k + 1])) for k in range(len(t or ""))]
        assert list(r.prefix_tokens) == want
        assert r.fit_chars == max([k + 1 for k, c in enumerate(want) if c <= 6], default=0)
