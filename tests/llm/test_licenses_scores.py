"""Operators 9 and 10."""

import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa

from vellum.llm import licenses, lm_scoring
from vellum.llm.licenses import TEMPLATES


def test_every_template_is_found_where_it_stands():
    scanner = licenses.Scanner(TEMPLATES)
    for name, wording in TEMPLATES.items():
        text = "lorem ipsum " * 400 + wording + " dolor sit" * 300
        found = scanner.scan(text)
        assert [f[0] for f in found] == [name] and found[0][4:] == (0, 0)
        assert text[found[0][1] : found[0][2]].rstrip(".") == wording.rstrip(".")


def test_differences_are_exact():
    scanner = licenses.Scanner(TEMPLATES)
    changed = TEMPLATES["mit"].replace("software", "programme", 1).replace("free of charge", "wholly free of charge")
    (name, *_, missing, extra), = scanner.scan(changed)
    assert (name, missing, extra) == ("mit", 1, 2)
    assert scanner.scan("All rights are not reserved here, under no license at all.") == []


def test_notices_in_long_prose():
    """Common words of the templates ("all", "under", "general") all through the text hide no notice."""
    r = random.Random(5)
    prose = lambda n: " ".join(r.choice("all of the rights under general rule and version wall small fall call river stone house north light water garden winter".split()) + r.choice(["", "", ",", "."]) for _ in range(n))
    scanner = licenses.Scanner(TEMPLATES)
    for size in (500, 3000, 30000):
        for name, wording in TEMPLATES.items():
            text = prose(size) + " | " + wording + " | " + prose(size)
            assert [(f[0], f[4:]) for f in scanner.scan(text)] == [(name, (0, 0))], (size, name)


def word_matches(text, templates):
    """Exact wordings by plain comparison of words; the longest takes its words first."""
    found = [(m.span(), m.group().lower()) for m in licenses.WORD.finditer(text)]
    words, free, out = [w for _, w in found], [True] * len(found), []
    for name, wording in sorted(templates.items(), key=lambda t: -len(licenses.WORD.findall(t[1]))):
        wanted = [w.lower() for w in licenses.WORD.findall(wording)]
        for i in range(len(words) - len(wanted) + 1):
            if words[i : i + len(wanted)] == wanted and all(free[i : i + len(wanted)]):
                free[i : i + len(wanted)] = [False] * len(wanted)
                out.append((name, found[i][0][0], found[i + len(wanted) - 1][0][1]))
    return sorted(out, key=lambda f: f[1])


def test_notices_among_their_own_words():
    """Filler dense with the words of notices, from 1 KB to 1 MB, hides no template; what is found exactly is what a word matcher finds."""
    r = random.Random(8)
    filler = lambda n: " ".join(r.choice(["license", "software", "reserved", "licensed"]) if r.random() < 0.05 else "".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n // 7))
    scanner = licenses.Scanner(TEMPLATES)
    for size in (1_000, 6_000, 13_500, 17_000, 20_000, 40_000, 80_000, 132_000, 1_000_000):
        for name in TEMPLATES if size < 100_000 else ("mit-notice", "apache-2.0"):
            text = filler(size // 2) + " " + TEMPLATES[name] + " " + filler(size // 2)
            assert [f[:3] for f in scanner.scan(text) if f[4:] == (0, 0)] == word_matches(text, TEMPLATES), (size, name)
    names = list(TEMPLATES)
    text = " ".join(filler(200) + (" " + TEMPLATES[r.choice(names)]) * r.randint(1, 2) for _ in range(60))
    got = [f[:3] for f in scanner.scan(text) if f[4:] == (0, 0)]
    assert got == word_matches(text, TEMPLATES) and len(got) >= 60


def test_savings_rank():
    """A license that holds a shorter notice wins, since it saves more."""
    scanner = licenses.Scanner(TEMPLATES)
    (name, *_, saved, missing, extra), = scanner.scan("x " + TEMPLATES["apache-2.0"] + " y")
    assert name == "apache-2.0" and saved > 150
    assert scanner.scan(TEMPLATES["apache-2.0-notice"])[0][3] > 0
    assert scanner.scan("permission " * 200_000) == []


def test_lines_of_documents(docs):
    lines = {"Licensed under the Apache License, Version 2.0.": "apache-2.0-notice", "Released under the MIT License.": "mit-notice", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0-notice", "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0-notice", "All rights reserved.": "all-rights-reserved"}
    got = {(r.doc_id, r.license) for r in licenses.scan_licenses(docs).collect()}
    assert got == {(r.doc_id, n) for r in docs.collect() for w, n in lines.items() if w in r.text} and got


def test_odd_documents(odd, none):
    rows = licenses.scan_licenses(odd).collect()
    assert [(r.doc_id, r.license) for r in rows] == [(14, "all-rights-reserved")]
    assert licenses.scan_licenses(none).count() == 0


def brute_score(text, known, net):
    codes = [0, 0, *lm_scoring.Classes(known)(text).tolist(), 0, 0]
    ending = [(k - lm_scoring.CLASSES) // lm_scoring.MEMBERS for k in codes]
    c = [k if k < lm_scoring.CLASSES else 1 + lm_scoring.FREQUENT + e for k, e in zip(codes, ending)]
    total = 0.0
    for i in range(2, len(c) - 2):
        h = sum(net["embed"][j * lm_scoring.CLASSES + c[i + d]].astype(float) for j, d in enumerate((-2, -1, 1, 2)))
        h = np.append(np.tanh(h), 1.0)
        group, place = divmod(c[i], lm_scoring.WIDE)
        levels = [(net["top"], group), (net["inner"][group], place)]
        if codes[i] >= lm_scoring.CLASSES:
            levels.append((net["last"][ending[i]], (codes[i] - lm_scoring.CLASSES) % lm_scoring.MEMBERS))
        for weights, at in levels:
            z = h @ weights.astype(float)
            total += z[at] - math.log(np.exp(z).sum())
    return total


def coded(df, words=None):
    """Encoded documents with the vocabulary of ``words`` (default: their own)."""
    words = (lm_scoring.count_words(df, "text") if words is None else words).cache()
    frequent, counts, different = lm_scoring.vocabulary(words)
    return lm_scoring.encoded(df, frequent, "doc_id", "text").cache(), words, frequent, counts, different


def test_scores_match_a_plain_sum_and_training_helps(docs, odd):
    own, words, frequent, counts, _ = coded(docs)
    trained, untrained = lm_scoring.fit(own, counts), lm_scoring.start(counts)
    order = lambda rows: sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id, len((r.text or "").lower().split()) if "text" in r else r.n_words))
    for df in (docs, odd):
        rows = lm_scoring.score(coded(df, words)[0], trained)
        assert rows.columns == ["doc_id", "n_words", "log_prob", "mean_log_prob"]
        for r, d in list(zip(order(rows.collect()), order(df.collect()), strict=True))[:40]:
            t = d.text or ""
            assert (r.doc_id, r.n_words) == (d.doc_id, len(t.lower().split()))
            if r.n_words < 3000:
                assert abs(r.log_prob - brute_score(t, frequent, trained)) < 1e-3 * max(1, r.n_words)
            assert (r.mean_log_prob is None) == (r.n_words == 0)
    mean = lambda net: lm_scoring.score(own, net).selectExpr("sum(log_prob) / sum(n_words) as m").first().m
    assert mean(trained) > mean(untrained) + 0.3  # the untrained one knows the frequencies only


def test_gradient():
    """The gradient of every level against finite differences."""
    r = np.random.default_rng(3)
    net = {k: v.astype(np.float64) for k, v in lm_scoring.start(r.integers(1, 100, lm_scoring.CODES)).items()}
    codes = r.choice(np.r_[1 : 1 + lm_scoring.FREQUENT, lm_scoring.CLASSES : lm_scoring.CODES], 50).astype(np.int32)
    codes[:25] = r.integers(1, 1 + lm_scoring.FREQUENT, 25)
    around = lm_scoring.windows(codes)
    given = lm_scoring.gradient(net, around, codes)
    loss = lambda: -lm_scoring.log_probabilities(net, around, codes).mean()
    group = codes[7] // lm_scoring.WIDE
    ending, member = divmod(codes[30] - lm_scoring.CLASSES, lm_scoring.MEMBERS)
    for name, at in (("last", (ending, 4, member)), ("last", (ending, lm_scoring.HIDDEN, member)), ("embed", (around[7, 2], 5)), ("top", (3, 2)), ("top", (lm_scoring.HIDDEN, group)), ("inner", (group, 4, codes[7] % lm_scoring.WIDE))):
        step = np.zeros_like(net[name])
        step[at] = 1e-2
        net[name] += step
        up = loss()
        net[name] -= 2 * step
        down = loss()
        net[name] += step
        assert abs((up - down) / 2e-2 - given[name][at]) < 2e-4 + 0.02 * abs(given[name][at]), (name, at)


def test_training_against_a_plain_loop(docs):
    """Blocks, rounds and averages, redone on the driver."""
    own, _, _, counts, _ = coded(docs.where("length(text) < 3000"))
    got = lm_scoring.fit(own, counts, block_words=3000)
    blocks = 2 * max(1, math.ceil(counts.sum() / 6000))
    rows = own.where("kind = 1").selectExpr("*", f"pmod(xxhash64(key, part), {blocks}L) as block").collect()
    net = lm_scoring.start(counts)
    for turn in range(2):
        total, seen = 0, 0
        for b in sorted({r.block for r in rows if r.block % 2 == turn}):
            copy = lm_scoring.Copy(lm_scoring.flat(net), b)
            for r in sorted((r for r in rows if r.block == b), key=lambda r: (r.key, r.part)):
                copy.add(bytes(r.codes))
            copy.step()
            total, seen = total + lm_scoring.flat(copy.net) * copy.seen, seen + copy.seen
        net = lm_scoring.from_flat(total / seen)
    assert blocks > 6
    assert np.allclose(lm_scoring.flat(net), lm_scoring.flat(got), atol=1e-5)


def test_same_scores_for_any_partitioning(docs):
    one, other = ({r.doc_id: (r.n_words, r.log_prob) for r in lm_scoring.score_corpus(df).collect()} for df in (docs, docs.repartition(7)))
    assert one.keys() == other.keys()
    for i, (n, log_prob) in one.items():
        assert other[i][0] == n and abs(other[i][1] - log_prob) <= 1e-4 * max(1, n)


def test_words_count_within_their_class(spark, docs, odd):
    """Words of a shared class count by how often the other documents use them."""
    _, words, frequent, totals, different = coded(docs)
    counts, net = {r.word: r.n for r in words.collect()}, lm_scoring.start(totals)
    classes = lm_scoring.Classes(frequent)
    by_class = {}
    for w in counts:
        by_class.setdefault(int(classes(w)[0]), []).append(w)

    def inside(text):
        rare = [(w, int(classes(w)[0])) for w in text.lower().split() if w not in frequent]
        own, own_class, total = Counter(w for w, _ in rare), Counter(c for _, c in rare), 0.0
        for w, c in rare:
            of = by_class.get(c, [])
            rest = max(0, sum(counts[v] for v in of) - own_class[c]) + lm_scoring.SMOOTH * (len(of) + 1)
            total += math.log((max(0, counts.get(w, 0) - own[w]) + lm_scoring.SMOOTH) / rest)
        return total

    scored = lambda df, *more: lm_scoring.score(coded(df, words)[0], net, "doc_id", *more).collect()
    code = lambda w: int(classes(w)[0])
    single = {code(w): w for w, n in counts.items() if n == 1 and w not in frequent}
    common = max((n, w) for w, n in counts.items() if w not in frequent and n > 1 and code(w) in single)[1]
    texts = [(1, f"{next(iter(frequent))} {common}"), (2, f"{next(iter(frequent))} {single[code(common)]}")]
    got = {r.doc_id: r.log_prob for r in scored(spark.createDataFrame(texts, "doc_id long, text string"), words, totals, different)}
    assert got[1] > got[2]
    for df in (docs.limit(60), odd):
        plain, full = scored(df), scored(df, words, totals, different)
        order = lambda rows: sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id, r.n_words))
        texts = {(r.doc_id, len((r.text or "").split())): r.text or "" for r in df.collect()}
        for a, b in zip(order(plain), order(full), strict=True):
            assert (a.doc_id, a.n_words) == (b.doc_id, b.n_words)
            assert abs(b.log_prob - a.log_prob - inside(texts[a.doc_id, a.n_words])) < 1e-6 * max(1, a.n_words)
            assert (b.mean_log_prob is None) == (b.n_words == 0)


def test_every_word_is_trained_on(spark):
    """All places of a document are learned."""
    rows = [(i, " ".join(f"x{j}" for j in range(17))) for i in range(2000)]
    own, _, frequent, counts, _ = coded(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    codes = lm_scoring.Classes(frequent)(rows[0][1])
    logs = [lm_scoring.log_probabilities(n, lm_scoring.windows(codes), codes) for n in (lm_scoring.fit(own, counts), lm_scoring.start(counts))]
    assert (logs[0] > logs[1]).all()
    assert own.where("kind = 1").selectExpr(f"sum(length(codes) / 2 - {2 * lm_scoring.SIDE}) as n").first().n == 2000 * 17


def test_many_batches(docs, monkeypatch):
    """Results don't depend on how many documents are looked up together."""
    one = {r.doc_id: r.log_prob for r in lm_scoring.score_corpus(docs, rounds=0).collect()}
    monkeypatch.setattr(lm_scoring, "PIECE", 100)
    other = {r.doc_id: r.log_prob for r in lm_scoring.score_corpus(docs.repartition(9), rounds=0).collect()}
    assert one.keys() == other.keys() and all(abs(one[i] - other[i]) < 1e-4 * (1 + abs(one[i])) for i in one)


def test_large_weights_do_not_overflow():
    net = lm_scoring.start(np.ones(lm_scoring.CODES))
    net["top"], net["inner"], net["last"] = net["top"] * 2000, net["inner"] * 2000, net["last"] * 2000
    around, target = np.ones((5, 4), int), np.array([0, 1, 2, lm_scoring.CLASSES, lm_scoring.CODES - 1])
    assert np.isfinite(lm_scoring.log_probabilities(net, around, target)).all()


def test_empty_table(none, odd):
    assert lm_scoring.score_corpus(none).count() == 0
    assert lm_scoring.score_corpus(odd).count() == odd.count()


def test_dense_texts(monkeypatch):
    """Permuted notices in which real ones stand: the bound skips places without changing a finding, and time stays linear."""
    import random
    import time

    r = random.Random(7)
    words = {n: licenses.WORD.findall(t) for n, t in licenses.TEMPLATES.items()}

    def permuted(name, n):
        return " ".join(" ".join(r.sample(words[name], len(words[name]))) for _ in range(n))

    text = f"{permuted('gpl-3.0', 4)}\n{licenses.TEMPLATES['gpl-3.0']}\n{permuted('mit', 2)} {licenses.TEMPLATES['mit'].replace('merge, ', '')} {permuted('isc', 2)}"
    scanner = licenses.Scanner(licenses.TEMPLATES)
    found = scanner.scan(text)
    assert {(f[0], f[4]) for f in found} >= {("gpl-3.0", 0), ("mit", 1)}
    monkeypatch.setattr(licenses.Scanner, "hopeless", lambda *_: False)
    assert scanner.scan(text) == found
    monkeypatch.undo()
    began = time.time()
    assert scanner.scan(permuted("gpl-3.0", 2200)) == [] and time.time() - began < 60  # 1 MB


def test_windows_of_joined_pieces():
    """Words of pieces that are looked at together have the neighbours that they have alone."""
    r = np.random.default_rng(5)
    pieces = [r.integers(0, lm_scoring.CODES, n + 2 * lm_scoring.SIDE).astype(np.int16) for n in (1, 7, 1, 1, 300, 2)]
    around, target, sizes = lm_scoring.joined([p.tobytes() for p in pieces])
    assert sizes.tolist() == [1, 7, 1, 1, 300, 2]
    assert (around == np.concatenate([lm_scoring.around_each(p) for p in pieces])).all()
    assert (target == np.concatenate([p[lm_scoring.SIDE : -lm_scoring.SIDE] for p in pieces])).all()


def test_members_of_a_shared_class_depend_on_both_sides(spark):
    """Words of one ending, some between left words and some between right ones: which member of the class it is follows from the neighbours."""
    r = random.Random(7)
    filler = [f"f{i}" for i in range(lm_scoring.FREQUENT)]
    words = {side: [f"{side}{i}xx" for i in range(20)] for side in ("l", "r")}
    texts = [" ".join(r.sample(filler, len(filler))) for _ in range(120)]
    for _ in range(100):
        for side, own in words.items():
            texts += [f"f{2 if side == 'l' else 3} f0 {w} f1 f{4 if side == 'l' else 5}" for w in own]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own, _, known, counts, _ = coded(df)
    classes, net = lm_scoring.Classes(known), lm_scoring.fit(own, counts)
    codes = {side: classes(" ".join(of)) for side, of in words.items()}
    ending = {int(k - lm_scoring.CLASSES) // lm_scoring.MEMBERS for of in codes.values() for k in of}
    assert len(ending) == 1 and sum(w in known for of in words.values() for w in of) == lm_scoring.OWN

    def members(text):
        z = lm_scoring.hidden(net, lm_scoring.windows(classes(text)))[2] @ net["last"][min(ending)]
        return z - math.log(np.exp(z).sum())

    left, right = members("f2 f0 l0xx f1 f4"), members("f3 f0 l0xx f1 f5")
    alone = {side: [int(k - lm_scoring.CLASSES) % lm_scoring.MEMBERS for k, w in zip(codes[side], of) if w in known] for side, of in words.items()}
    assert alone["l"] and alone["r"]
    assert (left - right)[alone["l"]].mean() > 0.5 and (right - left)[alone["r"]].mean() > 0.5


def numbered(texts, seen):
    """The words of each text as ``Vocabulary`` numbers them."""
    while len(texts):
        texts = texts.slice(seen.add(texts))
    words, numbers = seen.numbered()
    words, edges = words.to_pylist(), np.cumsum([0, *seen.sizes])
    assert len(set(words)) == len(words)
    return [[words[k] for k in numbers[a:z]] for a, z in zip(edges, edges[1:])]


def test_words_are_those_of_split(monkeypatch):
    """All white space that there is, letters of all lengths, and ends of texts without white space."""
    r = random.Random(3)
    spaces = [c for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))) if c.isspace()]
    letters = [*"aBz.", *"\u00c9\u00e9\u03a3\u03c3\u0130\u1e9e\u212a\u00ad\u00b4\u200b\u2019\u2014\u1681\u3001\u0084\0", "\U0001f600", ""]
    texts = ["".join(r.choice(letters if r.random() < 0.7 else spaces) for _ in range(r.randrange(30))) for _ in range(3000)] + [None, "", " ", "a", None]
    split = [t.lower().split() if t else [] for t in texts]
    for size in (1, 1000, 1 << 20):
        monkeypatch.setattr(lm_scoring, "TOKENIZED", size)
        for kind in (pa.string(), pa.large_string()):
            assert numbered(pa.array(texts, kind), lm_scoring.Vocabulary()) == split
            assert numbered(pa.array(texts, kind).slice(7, 50), lm_scoring.Vocabulary()) == split[7:57]
    assert numbered(pa.array([], pa.string()), lm_scoring.Vocabulary()) == []


def test_words_are_numbered_faster_than_by_a_dictionary():
    """Least times of some runs, over words of which many are different."""
    r = random.Random(5)
    texts = [" ".join(f"Wort{r.randrange(300_000) if r.random() < 0.2 else r.randrange(3000)}" for _ in range(400)) for _ in range(2000)]

    def plain():
        number = {}
        return [np.array([number.setdefault(w, len(number)) for w in t.lower().split()], np.int32) for t in texts]

    def arrow():
        seen, rest = lm_scoring.Vocabulary(), column
        while len(rest):
            rest = rest.slice(seen.add(rest))
        return seen.numbered()

    column, took = pa.array(texts), {plain: [], arrow: []}
    for _ in range(4):
        for way, times in took.items():
            began = time.process_time()
            way()
            times.append(time.process_time() - began)
    assert min(took[arrow]) < min(took[plain])
