"""Operators 4 and 6."""

import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from vellum.llm import mixing, sharding


def brute_edf(blocks, weights, period):
    """One slot at a time: of the released blocks, the one of earliest deadline."""
    left, done, order = dict(blocks), {}, []
    while any(left.values()):
        live = {s: weights[s] for s in left if left[s]}
        share = mixing.shares(live, max(period, len(live)))
        total, done, t = sum(share.values()), dict.fromkeys(live, 0), 0
        while all(left[s] for s in live):
            ready = [(-(-(done[s] + 1) * total // share[s]), str(s), s) for s in live if done[s] * total // share[s] <= t]
            s = min(ready)[2]
            order.append(s)
            done[s] += 1
            left[s] -= 1
            t += 1
    return order


@pytest.mark.parametrize("blocks, weights", [({"a": 30, "b": 11, "c": 5}, {"a": 1, "b": 2, "c": 3}), ({"a": 1}, {"a": 5}), ({"a": 200, "b": 1, "c": 40, "d": 7}, {"a": 0.1, "b": 3, "c": 1, "d": 1})])
def test_phases_match_a_slot_by_slot_schedule(blocks, weights):
    place = {}
    for r in mixing.phases(blocks, weights, 20):
        for b in range(r["start"], r["stop"]):
            k = b - r["start"]
            place[r["base"] + k // r["share"] * r["period"] + r["slots"][k % r["share"]]] = r["source"]
    assert [place[i] for i in range(sum(blocks.values()))] == brute_edf(blocks, weights, 20)


def test_less_than_a_block_off():
    share = mixing.shares({f"s{i}": w for i, w in enumerate((1, 2, 5, 7.5, 0.3))}, 1000)
    slots, total = mixing.pattern(share), sum(share.values())
    assert total == 1000
    for s, own in slots.items():
        taken = set(own)
        n = 0
        for t in range(total):
            n += t in taken
            assert abs(n - (t + 1) * share[s] / total) < 1


@pytest.mark.parametrize("weights, n", [({f"src{i}": 4.0 if i == 0 else 1.0 for i in range(20)}, 60_000), ({f"src{i}": 4.0 if i == 0 else 1.0 for i in range(1500)}, 9000), ({"a": 0.3333333, "b": 1, "c": 2.5}, 9000)])
def test_never_a_block_off_the_weights(weights, n):
    """Against the weights themselves, over many periods, with many sources and with periods longer than the mix."""
    place, total = {}, sum(weights.values())
    for r in mixing.phases(dict.fromkeys(weights, n // len(weights)), weights):
        if r["phase"] == 0:
            for k in range(r["stop"] - r["start"]):
                place[k // r["share"] * r["period"] + r["slots"][k % r["share"]]] = r["source"]
    assert sorted(place) == list(range(len(place))) and len(place) > n // len(weights)
    taken = Counter()
    for t in range(len(place)):
        s = place[t]
        assert (t + 1) * weights[s] / total - taken[s] > -1  # just before its block: not ahead
        assert t * weights[s] / total - taken[s] < 1  # nor behind
        taken[s] += 1
        assert abs((t + 1) * weights[s] / total - taken[s]) < 1


def test_mix_keeps_every_row(odd, none):
    rows = mixing.mix(odd, {"hot": 3.0}, block_rows=2).collect()
    assert len(rows) == odd.count() == len({r.position for r in rows})
    assert sorted({r.slot for r in rows}) == list(range(max(r.slot for r in rows) + 1))
    assert Counter(r.source for r in rows) == Counter(r.source for r in odd.collect())
    assert mixing.mix(none).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(odd, {"hot": 0.0})


def test_shards_are_even_and_whole(odd, docs, none):
    rows = sharding.kd_shards(docs, shards=8).collect()
    size = defaultdict(int)
    for r in rows:
        size[r.shard] += r["size"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(size) == set(range(8)) and max(size.values()) - min(size.values()) < 2 * max(map(len, texts.values()))
    for r in rows:
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode()), "bytes", None)
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    got = sharding.kd_shards(odd, shards=8).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd.collect()) and all(0 <= r.shard < 8 for r in got)
    assert sharding.kd_shards(none, shards=8).count() == 0
    assert {r.shard for r in sharding.kd_shards(docs, target_bytes=1 << 40).collect()} == {0}


def brute_split(groups, leaves, lo=0):
    """Sort by the full key and cut where the bytes below come nearest to the goal."""
    if leaves == 1:
        return {lo: sum(p["w"] for p in groups)}
    dim = max(sharding.DIMENSIONS, key=lambda d: max(p[d] for p in groups) - min(p[d] for p in groups))
    groups = sorted(groups, key=lambda p: (p[dim], p["tie"]))
    goal, below, best = sum(p["w"] for p in groups) * (leaves // 2) / leaves, 0, (1e18, 0)
    for i, p in enumerate(groups):
        if abs(goal - below) < best[0]:
            best = (abs(goal - below), i)
        below += p["w"]
    return brute_split(groups[: best[1]], leaves // 2, lo) | brute_split(groups[best[1] :], leaves - leaves // 2, lo + leaves // 2)


@pytest.mark.parametrize("few", [4096, 1])  # bins put in order at once, or refined to the end
def test_splits_match_a_sorted_cut(docs, monkeypatch, few):
    monkeypatch.setattr(sharding, "BIN_POINTS", few)
    rows = sharding.points(docs, 6, None, "doc_id", "text")[0]
    want = brute_split([r.asDict() for r in rows.groupBy(*sharding.DIMENSIONS, "tie").agg({"size": "sum"}).withColumnRenamed("sum(size)", "w").collect()], 6)
    got = defaultdict(int)
    for r in sharding.kd_shards(docs, shards=6, tolerance=0).collect():
        got[r.shard] += r["size"]
    assert dict(got) == want


def test_equal_texts_share_a_shard(spark):
    """At the default tolerance only the group that is too heavy alone is cut, and the shards stay near equal."""
    rows = [(i, f"text number {i % 400} " + "y" * (i % 400)) for i in range(1200)] + [(5000 + i, "hot copy") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.kd_shards(docs, shards=8).collect()
    texts = dict(rows)
    by_text, size = defaultdict(set), Counter()
    for r in got:
        by_text[texts[r.doc_id]].add(r.shard)
        size[r.shard] += r["size"]
    assert len(got) == len(rows) and [t for t, s in by_text.items() if len(s) > 1] in ([], ["hot copy"])
    assert max(size.values()) < 1.1 * min(size.values())


def test_many_shards(docs):
    """A node count far beyond that of the query plans and runs; equal texts share shards there too."""
    rows = sharding.kd_shards(docs, shards=150).collect()
    by_text = defaultdict(set)
    for r in rows:
        by_text[r["size"], r.text_crc32].add(r.shard)
    assert len({r.shard for r in rows}) > 75 and all(0 <= r.shard < 150 for r in rows) and len(rows) == docs.count()
    heavy = {k for k, n in Counter((r["size"], r.text_crc32) for r in rows).items() if n > 1 and n * k[0] > max(r["size"] for r in rows)}
    assert {k for k, s in by_text.items() if len(s) > 1} <= heavy


def test_query_op6(spark, sf):
    from vellum.llm.registry import QUERIES

    got = QUERIES["op6_kd_sharding"](spark, sf)
    assert got.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    rows = got.collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    by_text = defaultdict(set)
    for r in rows:
        by_text[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())


@pytest.mark.parametrize("weights", [{"a": 0.3333333, "b": 1, "c": 2.5}, {"a": 0.412345678, "b": 0.287654322, "c": 0.3}, {"a": 1 / 3, "b": 1 / 7, "c": 1 - 1 / 3 - 1 / 7}, {"a": 1000, "b": 0.0001}])
def test_periods_longer_than_any_mix(weights):
    """A million slots, exactly: in whole numbers, |taken - share| < 1 after every block of every source, and memory only for what is used."""
    n = 1_000_000
    total = sum(Fraction(str(w)) for w in weights.values())
    first = [r for r in mixing.phases(dict.fromkeys(weights, n), weights) if r["phase"] == 0]
    assert sum(len(r["slots"]) for r in first) <= max(n * len(weights), 1)
    used = 0
    for r in first:
        w = Fraction(str(weights[r["source"]])) / total
        for k, t in enumerate(r["slots"]):
            # before its slot a source has k blocks and after it k + 1; between, the share rises to that of the next slot
            assert -1 < k - t * w and k + 1 - (t + 1) * w < 1
            assert k - t * w < 1
        used += len(r["slots"])
        assert abs(len(r["slots"]) - w * sum(len(x["slots"]) for x in first)) < 1
    assert sorted(t for r in first for t in r["slots"]) == list(range(used))


def test_plan_sends_a_pattern_once():
    rows = mixing.phases({"a": 300_000, "b": 700_000}, {"a": 3, "b": 7})
    pieces = list(mixing.plan(rows))
    assert sum(len(p[-1]) for p in pieces) == 11  # the last block is a phase of its own
    places = sorted(p[4] + t * p[6] + at for p in pieces for t in range(p[8], p[9]) for i, at in enumerate(p[-1]) if p[2] + t * p[5] + p[7] + i < p[3])
    assert places == list(range(1_000_000))
