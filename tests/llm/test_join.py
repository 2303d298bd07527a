"""Operator 7 against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from vellum.llm import components, ngram_join, shingles


def sets_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [sets_of(t) for _, t in rows]
    lists = defaultdict(list)
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, s in enumerate(sets):
        for g in s:
            lists[g].append(k)
    for k, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in lists[g] if j > k).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(rows[k][0]), find(rows[j][0])
                parent[max(a, b)] = min(a, b)
    return {(i, len(s), find(i)) for (i, _), s in zip(rows, sets)}


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {tuple(r) for r in ngram_join.op7_ngram_jaccard(spark, sf).collect()} == brute(rows)


def test_documents_against_sql(spark, sf):
    import duckdb

    from vellum.llm.registry import ORACLES

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(ORACLES["op7_ngram_jaccard"]).fetchall()
    assert {tuple(r) for r in ngram_join.op7_ngram_jaccard(spark, sf).collect()} == set(want)


def test_odd_documents(odd, none):
    got = ngram_join.jaccard_components(odd).collect()
    assert len(got) == odd.count()
    rows = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None]
    assert {tuple(r) for r in got if r.doc_id is not None} == brute(rows)
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(296, None)]
    assert ngram_join.jaccard_components(none).count() == 0


def chains(seed):
    """Families of edited copies, chains of small steps, a passage most documents share, and unrelated texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdef") for _ in range(4))
    passage = [word() for _ in range(30)]
    out = []
    for _ in range(12):
        text = [word() for _ in range(r.choice((6, 20, 60, 120)))]
        for _ in range(r.choice((1, 8, 25))):
            for _ in range(r.choice((0, 1, 2, 4))):
                text = list(text)
                text[r.randrange(len(text))] = word()
            out.append(" ".join(text + (passage if r.random() < 0.6 else [])))
    out += [" ".join(passage + [word() for _ in range(r.randint(3, 14))]) for _ in range(60)]
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_borderline_families(spark, seed, monkeypatch):
    rows = chains(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {tuple(r) for r in ngram_join.jaccard_components(df).collect()} == brute(rows)


@pytest.mark.parametrize("often", [2, 5, 40])
def test_frequent_shingles_and_small_ranges(spark, often):
    rows = chains(4)
    df = spark.createDataFrame(rows + [(None, rows[0][1]), (1000, None), (1001, rows[0][1])], "doc_id long, text string").repartition(3)
    got = {tuple(r) for r in ngram_join.jaccard_components(df, often=often, range_bytes=400).collect() if r.doc_id is not None}
    assert got == brute([*rows, (1000, None), (1001, rows[0][1])])


def test_ranges_follow_the_texts(spark):
    df = spark.createDataFrame([(i, "é" * 512) for i in range(1024)], "doc_id long, text string")
    assert [ngram_join.range_count(df, "text", b) for b in (1 << 23, 1 << 12, 1 << 10)] == [64, 512, 2048]
    assert ngram_join.range_count(df.where("false"), "text", 1 << 10) == 64


def test_small_blocks(spark, monkeypatch):
    rows = chains(9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lists = spark.createDataFrame([(h, 10 + h % 3, (h * i) % 4, i, i % 5) for h in range(20) for i in range(12)], "h long, n long, pos long, id long, c long")
    want = set()
    for h in range(20):
        e = [(10 + h % 3, (h * i) % 4, i, i % 5) for i in range(12)]
        want |= {(a[2], b[2]) for a in e for b in e if a[2] < b[2] and a[3] != b[3] and 175 * min(a[0] - a[1], b[0] - b[1]) >= 75 * (a[0] + b[0])}
    for list_rows in (100, 12, 5, 1):  # whole lists, then lists split into parts that meet two by two
        got = [tuple(r) for r in ngram_join.cross_pairs(lists, 75, list_rows).collect()]
        assert set(got) == want and len(got) == len(want)
    e = [t.encode() for _, t in rows]
    whole = shingles.shingle_sets(e)
    monkeypatch.setattr(shingles, "BLOCK", 300)
    parts = shingles.shingle_sets(e)
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_packing():
    v = np.sort(np.random.default_rng(1).integers(0, 1 << 62, 1000).astype(np.uint64))
    assert (ngram_join.unpack(ngram_join.pack(v)) == v).all()
    assert (ngram_join.from_six(ngram_join.six(v >> np.uint64(20))) == v >> np.uint64(20)).all()
    assert len(ngram_join.unpack(ngram_join.pack(v[:0]))) == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 13), (13, 14), (5, 5), (9, 3)] + [(100, i) for i in range(101, 400)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in (1, 2, 3, 9)} == {1} and {got[i] for i in range(10, 15)} == {10} and {got[i] for i in range(100, 400)} == {100} and 5 not in got
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
