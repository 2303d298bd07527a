"""Operators 11 to 13 against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import line_dedup, spelling, whitening
from vellum.llm.registry import QUERIES

# whitening


def brute_whitening(rows, components=16):
    """Everything by numpy from whole tables; {row number: (deviation, [whitened])} and what is one for all."""
    x = {i: [int(np.floor(64 * float(c))) + 1_000_000 for c in v] for i, v in enumerate(rows) if v is not None and all(c is not None and np.isfinite(c) for c in v)}
    fit = sorted(set(map(tuple, x.values())))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[n * c - s for c, s in zip(v, sums)] for v in fit], dtype=float) / n
    cov = centred.T @ centred / n
    e, vec = np.linalg.eigh(cov)
    e, vec = e[::-1][:components], vec[:, ::-1][:, :components]
    out = {i: (sum((n * c - s) ** 2 for c, s in zip(v, sums)), (np.array([n * c - s for c, s in zip(v, sums)], dtype=float) / n) @ vec / np.sqrt(e)) for i, v in x.items()}
    return n, e / np.trace(cov), out


def same_whitening(got, ids, rows):
    n, explained, want = brute_whitening(rows)
    by = defaultdict(dict)
    for r in got:
        by[r.vec_id][r.component] = r
    assert set(by) == {ids[i] for i in want}
    signs = None
    for i, (deviation, w) in want.items():
        have = by[ids[i]]
        assert sorted(have) == list(range(1, len(explained) + 1)) and {r.n for r in have.values()} == {n} and {r.deviation for r in have.values()} == {deviation}
        mine = np.array([have[k].whitened for k in sorted(have)])
        signs = np.sign(mine * w) if signs is None else signs
        assert np.allclose(mine, signs * w, atol=1e-7)
        assert np.allclose([have[k].explained for k in sorted(have)], explained, rtol=1e-9) and max(r.identity_error for r in have.values()) < 1e-8


def test_op11(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    got = QUERIES["op11_embedding_whitening"](spark, sf)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    same_whitening(got.collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_whitening_of_odd_vectors(spark):
    r = random.Random(1)
    rows = [[r.gauss(0, s + 1) for s in range(5)] for _ in range(60)]
    rows[3], rows[4], rows[5], rows[6] = None, [1.0, None, 0.0, 0.0, 0.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0]
    rows[10:40] = [rows[9]] * 30
    df = spark.createDataFrame([(i, v, "x", "y", 1.0) for i, v in enumerate(rows)] + [(900, [1.0, 2.0], "", "", 0.0), (901, [], "", "", 0.0)], "vec_id long, embedding array<double>, id string, x string, n double")
    same_whitening(whitening.whiten(df).collect(), list(range(60)), rows)
    twice = whitening.whiten(df.where("vec_id = 9 or vec_id > 45").unionByName(df.where("vec_id = 9")).withColumn("vec_id", F.when(F.col("vec_id") != 50, F.col("vec_id"))))
    assert twice.where("vec_id = 9").count() == 10 and twice.where("vec_id is null").count() == 5
    big = [[v * 1e9 for v in row] if row else row for row in (x if i > 6 else None for i, x in enumerate(rows))]
    huge = whitening.whiten(spark.createDataFrame(list(enumerate(big)), "vec_id long, embedding array<double>"))
    n, _, want = brute_whitening(big)
    assert {(q.vec_id, int(q.deviation)) for q in huge.collect()} == {(i, d) for i, (d, _) in want.items()} and max(d for d, _ in want.values()) > 1 << 63


def test_whitening_without_spread(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        got = whitening.whiten(spark.createDataFrame(rows, schema))
        assert got.count() == 0 and got.columns[0] == "vec_id"
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0, float(i)]) for i in range(9)], schema)).collect()
    assert {q.component for q in flat} == {1} and abs(flat[0].explained - 1) < 1e-9


# lines


def brute_lines(rows, least=10):
    """{number: (lines, dropped, kept)} of rows (id, text), ids None last."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    rows = [(float("inf") if i is None else i, t or "") for i, t in rows]
    owner = {}
    for i, t in rows:
        for line in t.split("\n"):
            owner[key(line)] = min(owner.get(key(line), i), i)
    out = []
    for i, t in rows:
        lines = t.split("\n")
        kept = [line for line in lines if len(key(line)) < least or owner[key(line)] == i]
        out.append((None if i == float("inf") else i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def answer(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.collect()), key=str)


def test_op12(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op12_line_dedup"](spark, sf)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    want = {(i, n, d, hashlib.sha256(k.encode()).hexdigest()) for i, n, d, k in brute_lines(rows)}
    assert {tuple(r) for r in got.collect()} == want and sum(w[2] for w in want) > 0


@pytest.mark.parametrize("batches, fanout", [(1, 3), (4, 3), (7, 2)])
def test_lines_in_batches(spark, batches, fanout):
    r = random.Random(batches)
    lines = [f"line number {i} of many" for i in range(40)] + ["", "short", " \t", "ÀÉ über 10 lang", "x" * 3000]
    spaced = lambda s: r.choice(["", " ", "\t\x0b"]) + (s.upper() if s.isascii() and r.random() < 0.3 else s) + r.choice(["", "  ", "\r"])
    rows = [(i, "\n".join(spaced(r.choice(lines)) for _ in range(r.randint(0, 12)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "\n\n\n"), (5, "line number 1 of many\nanother row of document five"), (None, "line number 2 of many\nonly in rows without id"), (None, "only in rows without id"), rows[7], rows[7]]
    rows += [(300 + i, "common line everywhere\n" * 50 + f"own line of {i} here") for i in range(40)]
    df = spark.createDataFrame([(i, t, "h", "o") for i, t in rows], "doc_id long, text string, h1 string, owner string")
    assert answer(line_dedup.dedup(df, batches, fanout)) == brute_lines(rows)


def test_lines_of_odd_documents(spark, odd, none):
    assert answer(line_dedup.dedup(odd)) == brute_lines([(r.doc_id, r.text) for r in odd.collect()])
    assert answer(line_dedup.dedup(none)) == []


def test_an_index_takes_batches_as_they_come(spark):
    """The first batch owns a line, whatever the ids; a repeated batch changes nothing; closing leaves no files."""
    import os

    index = line_dedup.LineIndex(spark, fanout=2)
    batch = lambda *rows: spark.createDataFrame(rows, "id long, text string")
    gone = lambda *rows: {r.id: r.gone for r in index.add(batch(*rows)).collect()}
    assert gone((9, "a line of text\nother line here"), (12, "a line of text")) == {12: [0]}
    assert gone((3, "new line of text\nA LINE OF TEXT")) == {3: [1]}
    assert [len(level) for level in index.levels] == [0, 1]
    assert gone((3, "new line of text\nA LINE OF TEXT")) == {3: [1]} and gone((4, "new line of text")) == {4: [0]}
    assert [len(level) for level in index.levels] == [0, 0, 1]
    assert os.path.isdir(index.folder)
    index.close()
    assert not os.path.exists(index.folder)


def test_runs_are_not_shuffled(spark):
    """A batch's lines meet the runs in the buckets they were written in."""
    index = line_dedup.LineIndex(spark)
    docs = spark.createDataFrame([(i, f"a line that is number {i % 7}") for i in range(50)], "id long, text string")
    index.add(docs).collect()
    keys = line_dedup.lines_of(docs).groupBy(*line_dedup.HASHES).count()
    plan = keys.join(spark.table(index.runs()[0]).hint("merge"), line_dedup.HASHES, "left")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


# spelling


def brute_words(rows):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def brute_variants(n):
    cut = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            cut[i, w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for (_, less), ws in cut.items():
        for w in ws:
            near[w] |= ws - {w}
            if less in n:
                near[w].add(less)
                near[less].add(w)
    best = {w: min(near[w], key=lambda v: (-n[v], v)) if near[w] else None for w in n}
    form = {w: b if b and n[b] >= 10 * n[w] else None for w, b in best.items()}
    root = {}
    for w in n:
        r = w
        while form[r]:
            r = form[r]
        root[w] = r
    return {(w, form[w], root[w], n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def test_op13(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op13_spelling_variants"](spark, sf)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute_variants(brute_words(rows))
    assert {tuple(r) for r in got.collect()} == want and any(w[1] for w in want) and any(w[4] > 1 for w in want)


@pytest.mark.parametrize("most, free", [(1024, 64), (5, 64), (1024, 3), (2, 1)])
def test_tries_of_few_letters(spark, most, free):
    """Many near words, repeated letters and groups halved to the last place."""
    r = random.Random(most + free)
    words = {"".join(r.choice("abÀ") for _ in range(r.randint(7, 9))) for _ in range(400)} | {"a" * k for k in range(7, 14)} | {"b" * 200, "b" * 201, "b" * 100 + "a" + "b" * 100}
    n = {w: int(10 ** r.uniform(0.4, 4)) for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    got = {(p.word, p.near) for p in spelling.pairs(spelling.groups(df, most, free)).collect()}
    rows = spelling.pairs(spelling.groups(df, most, free)).count()
    want = {(a, b) for a in words for b in words if a != b and abs(len(a) - len(b)) < 2 and near_by_rows(a, b)}
    assert got == want and rows == len(want) and len(want) > 200


def near_by_rows(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_chains_of_forms(spark):
    words = [("abcdefg", 2), ("abcdefgh", 25), ("abcdefghi", 300), ("abcdefghij", 3100), ("bbcdefg", 20), ("other words", 1)]
    docs = [(i, " ".join([w] * 500)) for w, n in words for i in range(n // 500)] + [(7, " ".join([w] * (n % 500))) for w, n in words]
    df = spark.createDataFrame([(None, t, "x", "y") for _, t in docs], "doc_id long, text string, word string, n string")
    rows = [(None, t) for _, t in docs]
    assert {tuple(r) for r in spelling.variants(df).collect()} == brute_variants(brute_words(rows))


def test_variants_of_odd_documents(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert {tuple(r) for r in spelling.variants(odd).collect()} == brute_variants(brute_words(rows))
    assert spelling.variants(none).count() == 0
