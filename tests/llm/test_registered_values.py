"""Registered queries 5 and 10, value by value, against plain sums."""

import cmath
import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_licenses_scores import brute_score, coded

from vellum.llm import lm_scoring, media
from vellum.llm.registry import QUERIES


def plain_feature(payload):
    """Spectrum by the sum itself, peaks and pairs by loops."""
    size, hop = 256, 128
    frames = max(1, -(-(len(payload) - size) // hop) + 1)
    samples = [s - 128.0 for s in payload] + [0.0] * ((frames - 1) * hop + size - len(payload))
    window = [0.5 - 0.5 * math.cos(2 * math.pi * i / size) for i in range(size)]
    turn = [cmath.exp(-2j * math.pi * i / size) for i in range(size)]
    m = np.array([[abs(sum(samples[t * hop + i] * window[i] * turn[i * f % size] for i in range(size))) for f in range(size // 2 + 1)] for t in range(frames)])
    value = lambda t, f: m[t, f] if 0 <= t < frames and 0 <= f <= size // 2 else -1.0
    peaks = []
    for t in range(frames):
        for f in range(size // 2 + 1):
            v = m[t, f]
            if v > 2 * m[t].mean() + 1e-6 and v > value(t, f - 1) and v >= value(t, f + 1) and v > value(t - 1, f) and v >= value(t + 1, f):
                peaks.append((t, f))
    pairs = [t << 32 | f << 16 | g << 8 | u - t for i, (t, f) in enumerate(peaks) for u, g in peaks[i + 1 : i + 4] if u - t <= 16]
    return f"{frames}:{len(peaks)}:{len(pairs)}:{hashlib.sha256(np.array(sorted(pairs), '<i8').tobytes()).hexdigest()}"


def test_op5_features(spark, sf):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.feature for r in QUERIES["op5_media_columns"](spark, sf).collect()}
    short = [i for i, t in rows.items() if len(t.encode()) < 700][:25]
    assert len(short) > 10
    for i in short:
        assert got[i] == plain_feature(media.padded(rows[i].encode()))


def test_op10_scores(spark, sf):
    """The network's log-probabilities of classes, one word at a time, and those of words in their classes from plain counts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op10_lm_scoring"](spark, sf).collect()}
    own, words, frequent, totals, different = coded(docs)
    net, counts, classes = lm_scoring.fit(own, totals), {r.word: r.n for r in words.collect()}, lm_scoring.Classes(frequent)
    by_class = defaultdict(list)
    for w in counts:
        by_class[int(classes(w)[0])].append(w)
    sums = {c: sum(counts[v] for v in of) for c, of in by_class.items()}
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    assert set(got) == set(rows)
    checked = 0
    for i, text in rows.items():
        these = text.lower().split()
        assert got[i].n_words == len(these)
        if 0 < len(these) < 400:
            rare = [(w, int(classes(w)[0])) for w in these if w not in frequent]
            mine, mine_in = Counter(w for w, _ in rare), Counter(c for _, c in rare)
            inside = sum(math.log((counts[w] - mine[w] + lm_scoring.SMOOTH) / (sums[c] - mine_in[c] + lm_scoring.SMOOTH * (len(by_class[c]) + 1))) for w, c in rare)
            want = brute_score(text, frequent, net) + inside
            assert got[i].log_prob == pytest.approx(want, abs=2e-3 * len(these)) and got[i].mean_log_prob == pytest.approx(want / len(these), abs=2e-3)
            checked += 1
    assert checked > 30
