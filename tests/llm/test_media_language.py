"""Operators 5 and 8."""

import hashlib
import zlib

import numpy as np

from vellum.llm import language_id, media


def test_media_round_trip(odd, none):
    rows = media.media_columns(odd).collect()
    for r, t in zip(rows, [x.text for x in odd.select("text").collect()]):
        data = (t or "").encode()
        payload = data + bytes((-len(data)) % 64 if data else 64)
        assert media.from_wav(bytes(r.media)) == payload
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_bytes) == (len(data), len(payload), zlib.crc32(payload[-64:]), len(r.media))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert r.feature.split(":")[2] == str(len(r.fingerprint))
    by_text = {}
    for r, t in zip(rows, [x.text for x in odd.select("text").collect()]):
        assert by_text.setdefault(t or "", r.feature) == r.feature
    assert media.media_columns(none).count() == 0


def test_peaks_of_a_tone_and_blocks(monkeypatch):
    tone = (128 + 100 * np.sin(2 * np.pi * 32 * np.arange(4096) / 256)).astype(np.uint8).tobytes()
    _, _, bins = media.peaks(tone)
    assert 32 in bins
    noise = np.random.default_rng(0).integers(0, 256, 60000, dtype=np.uint8).tobytes()
    whole = media.fingerprint(noise)
    monkeypatch.setattr(media, "BLOCK", 7)
    parts = media.fingerprint(noise)
    assert whole[:2] == parts[:2] and (whole[2] == parts[2]).all()


def brute_vector(text, d):
    low = f" {text.lower()} "
    codes = [int(language_id.letter_codes()[ord(c)]) for c in low]
    codes = [c for i, c in enumerate(codes) if c or not i or codes[i - 1]]
    out = np.zeros(d)
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        if b:
            v = [language_id.letter_vector(x, d).astype(float) for x in (a, b, c)]
            out += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
    return out


def test_vectors_match_a_plain_sum():
    texts = ["Hello, world!", "", "42", "Ünï 你好 ab", "x" * 40, "a b. c"]
    got = language_id.text_vectors(texts, 64)
    for t, v in zip(texts, got):
        assert np.allclose(v, brute_vector(t, 64))


def test_long_texts_are_whole(monkeypatch):
    text = "the quick brown fox " * 200
    whole = language_id.unit(language_id.text_vectors([text]))
    monkeypatch.setattr(language_id, "BLOCK", 500)
    parts = language_id.unit(language_id.text_vectors([text]))
    assert float((whole * parts).sum()) > 0.99


def test_held_out_accuracy(docs):
    langs, protos = language_id.fit(docs)
    rows = language_id.predict(docs.where(language_id.held_out()), langs, protos, keep=["lang"]).collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_texts(odd, none):
    langs, protos = language_id.fit(odd)
    rows = language_id.predict(odd, langs, protos).collect()
    texts = [x.text for x in odd.select("text").collect()]
    for r, t in zip(rows, texts):
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
    assert language_id.fit(none)[0] == []
    empty = language_id.predict(odd, *language_id.fit(none)).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in empty] == ["und"]


def test_fold(spark):
    df = spark.range(100).withColumnRenamed("id", "doc_id")
    for r in df.select("doc_id", language_id.held_out().alias("x")).collect():
        assert r.x == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
