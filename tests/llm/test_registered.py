"""The registered queries, with production parameters, against plain versions of their contracts."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_licenses_scores import word_matches
from test_media_language import brute_vector

from vellum.llm import language_id, licenses, mixing
from vellum.llm.registry import QUERIES


@pytest.fixture(scope="module")
def rows(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_op4(spark, sf, rows):
    got = QUERIES["op4_pfair_mix"](spark, sf).collect()
    assert {r.doc_id: r.source for r in got} == {i: r.source for i, r in rows.items()} and len(got) == len(rows)
    blocks = {r.slot: r.source for r in got}
    assert sorted(blocks) == list(range(len(blocks)))
    first = [blocks[s] for s in sorted({r.slot for r in got if r.phase == 0})]
    weights = {s: mixing.WEIGHTS.get(s, mixing.REST) for s in set(blocks.values())}
    taken, total = Counter(), sum(weights.values())
    for t, s in enumerate(first):
        taken[s] += 1
        assert all(abs(taken[k] - (t + 1) * w / total) < 1 for k, w in weights.items())
    assert max(Counter((r.source, r.block) for r in got).values()) <= mixing.BLOCK_ROWS


def test_op5(spark, sf, rows):
    got = QUERIES["op5_media_columns"](spark, sf)
    assert got.columns[:8] == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    feature = {}
    for r in got.collect():
        data = (rows[r.doc_id].text or "").encode()
        padded = data + bytes(max(1, math.ceil(len(data) / 64)) * 64 - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert feature.setdefault(data, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_op8(spark, sf, rows):
    """Vectors, prototypes and cosines by plain sums, letter by letter."""
    plain = {i: brute_vector(r.text, language_id.DIMENSIONS) for i, r in rows.items() if r.text and len(r.text) < 1500}
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    size = lambda v: v / (np.linalg.norm(v) or 1)
    sums = defaultdict(lambda: np.zeros(language_id.DIMENSIONS))
    for i, v in plain.items():
        if rows[i].lang and not fold(i):
            sums[rows[i].lang] += size(v)
    names = sorted(sums)
    protos = np.stack([size(sums[n]) for n in names])
    short = spark.createDataFrame([rows[i] for i in plain])
    found = language_id.predict(short, *language_id.fit(short)).collect()
    assert len(found) == len(plain) > 50
    for r in found:
        cosine = np.round(protos @ size(plain[r.doc_id]), 9)
        want = (names[int(cosine.argmax())], (1 + cosine.max()) / 2) if plain[r.doc_id].any() else ("und", 0.0)
        assert r.lang_pred == want[0] and abs(r.score - want[1]) < 1e-6
    got = QUERIES["op8_language_id"](spark, sf)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    all_ = got.collect()
    assert {r.doc_id: r.held_out for r in all_} == {i: fold(i) for i in rows} and len(all_) == len(rows)
    assert np.mean([r.lang_pred == rows[r.doc_id].lang for r in all_ if r.held_out and r.lang_pred != "und"]) > 0.95


def test_op9(spark, sf, rows):
    exact = {(r.doc_id, r.license, r.start, r.stop) for r in QUERIES["op9_license_scan"](spark, sf).collect() if (r.missing_words, r.extra_words) == (0, 0)}
    assert exact == {(i, *f) for i, r in rows.items() for f in word_matches(r.text or "", licenses.TEMPLATES)} and exact


def test_op10(spark, tmp_path):
    """Documents that occur twice score above those that occur once, and clean text above shuffled words of no corpus."""
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(30_000)]
    text = lambda: " ".join(r.choice(words[: 10 ** r.randint(1, 4)]) if r.random() < 0.8 else r.choice(words) for _ in range(150))
    twice = [text() for _ in range(20)]
    docs = [(i, text()) for i in range(300)] + [(1000 + i, t) for i, t in enumerate(twice)] + [(2000 + i, t) for i, t in enumerate(twice)] + [(3000, " ".join("zq" + "".join(r.choice("wxyz") for _ in range(9)) for _ in range(150)))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op10_lm_scoring"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_words", "log_prob", "mean_log_prob"]
    mean = {x.doc_id: x.mean_log_prob for x in got.collect()}
    assert len(mean) == len(docs)
    once, repeated = [m for i, m in mean.items() if i < 300], [m for i, m in mean.items() if 1000 <= i < 3000]
    assert np.mean(repeated) > np.mean(once) and mean[3000] < min(once)
