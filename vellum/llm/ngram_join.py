"""Exact n-gram Jaccard join by prefix lists, position skipping and derived answers.

1. Each batch of documents gives its shingle hashes, dealt by hash ranges as compressed arrays;
   equal sets of a batch are sent once. Of a hash that many documents of the batch share, only
   the count is dealt; its entries wait at the batch.
2. Each hash range counts its lists. Hashes of one document alone can't link anything and
   go no further; the others return to their batch with their document frequency.
3. Each document orders its hashes rarest first. Two sets of the wanted similarity share
   a hash in their prefixes, so documents whose prefix holds nothing but lone hashes are done.
4. Equal sets become one class. In every list, entries whose remaining positions or sizes
   rule out the overlap are skipped, blocks of entries at a time.
5. Every list first checks its entries with its least document only. A set's further answers
   are derived from those of that highly similar set: entries that already reach each
   other need no check, and the overlap of a new pair starts from the leader's overlap and
   only looks at the hashes in which the set differs from its leader.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import cut, give_back, map_rows, small_batches, table
from vellum.llm.components import connected_components
from vellum.llm.shingles import HASH_BITS, shingle_sets, signatures

PERCENT = 75
#: Documents and bytes of a batch; entries of a list compared at a time. Memory bounds, without effect on results.
BATCH_ROWS, BATCH_BYTES, BLOCK = 4096, 1 << 23, 1024
#: Entries of a list that one task takes by itself; longer lists are split, none is cut.
LIST_ROWS = 65_536
#: Bytes of text for each hash range, and documents of a batch that make a hash a frequent one. Without effect on results.
RANGE_BYTES, OFTEN = 1 << 23, 64
LOW = np.uint64((1 << HASH_BITS) - 1)


def pack(values: np.ndarray) -> bytes:
    """Sorted uint64 values as compressed byte planes of their differences."""
    steps = np.diff(values, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def six(values: np.ndarray) -> bytes:
    """Hashes of 48 bits in 6 bytes each."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def least_overlap(n, percent: int):
    """ceil(percent n / 100): what a set of n must share with any set it links to."""
    return -(-n * percent // 100)


def gathered(batches):
    """Ids and UTF-8 texts of up to BATCH_ROWS documents and BATCH_BYTES bytes at a time."""
    ids: list[int] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = (t or "").encode("utf-8", "surrogatepass")
            if texts and (len(texts) == BATCH_ROWS or size + len(data) > BATCH_BYTES):
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(data)
            size += len(data)
    if texts:
        yield ids, texts


def range_count(docs: DataFrame, text_col: str, range_bytes: int) -> int:
    """How many hash ranges, a power of two that follows the bytes of all texts, so that a range's size doesn't."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return 1 << max(6, (size // range_bytes).bit_length())


def deal(docs: DataFrame, ranges: int, id_col: str, text_col: str, often: int = OFTEN) -> DataFrame:
    """Rows (bucket, batch, kind, payload), packed.

    Kind 0 holds hash << 16 | document number, kind 1 ids, sizes and signatures. Of the hashes that
    ``often`` documents of a batch or more share, kind 2 holds the entries, which stay with the
    batch, and kind 3 hash << 16 | count, so a very common shingle sends one number a batch.
    """
    shift = np.uint64(HASH_BITS - (ranges.bit_length() - 1))

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        for ids, texts in gathered(batches):
            keys, sizes = shingle_sets(texts)
            marks = signatures(keys, sizes)
            first: dict[tuple, int] = {}
            sent = np.array([first.setdefault((n, *m), i) == i and n > 0 for i, (n, m) in enumerate(zip(sizes.tolist(), marks.tolist()))], bool)
            info = np.concatenate([np.array(ids, np.int64), sizes.astype(np.int64), marks[:, 0], marks[:, 1], sent.astype(np.int64)])
            home = ranges + zlib.crc32(number.to_bytes(8, "little")) % ranges
            rows = [(home, number, 1, zstandard.compress(info.tobytes(), 1))]
            keys = keys[sent[(keys >> np.uint64(HASH_BITS)).astype(np.int64)]]
            lists = np.sort((keys & LOW) << np.uint64(16) | keys >> np.uint64(HASH_BITS))
            h = lists >> np.uint64(16)
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            length = np.diff(start, append=len(h))
            frequent = np.repeat(length >= often, length)
            common = h[start[length >= often]] << np.uint64(16) | length[length >= often].astype(np.uint64)
            if len(common):
                rows.append((home, number, 2, pack(lists[frequent])))
            for kind, values in ((0, lists[~frequent]), (3, common)):
                found, first_of = np.unique(values >> np.uint64(16) >> shift, return_index=True)
                rows += [(b, number, kind, pack(part)) for b, part in zip(found.tolist(), np.split(values, first_of[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names=["bucket", "batch", "kind", "payload"])
            number += 1
        ids = texts = keys = sizes = marks = first = sent = info = rows = lists = h = frequent = common = values = None
        give_back()

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "bucket int, batch long, kind int, payload binary")


def then_give_back(found: pa.Table) -> pa.Table:
    give_back()
    return found


def repeated(t: pa.Table) -> pa.Table:
    """Of one hash range: the entries (and frequent hashes) of lists of two or more, by batch, with the lists' lengths."""
    batch, kind, payload = (t.column(c).to_pylist() for c in ("batch", "kind", "payload"))
    rows = [(b, k, p, None) for b, k, p in zip(batch, kind, payload) if k in (1, 2)]
    mine = sorted((b, k, p) for b, k, p in zip(batch, kind, payload) if k in (0, 3))
    if mine:
        parts = [unpack(p) for *_, p in mine]
        keys = np.concatenate(parts)
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        counted = np.array([k == 3 for _, k, _ in mine], bool)[owner]
        documents = np.where(counted, keys & np.uint64(0xFFFF), np.uint64(1))
        order = np.argsort(keys >> np.uint64(16), kind="stable")
        h = keys[order] >> np.uint64(16)
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        length = np.diff(first, append=len(h))
        count = np.empty(len(keys), np.uint64)
        count[order] = np.repeat(np.add.reduceat(documents[order], first), length)
        keep = count > 1
        keys, owner, count = keys[keep], owner[keep], count[keep]
        edges = np.searchsorted(owner, np.arange(len(parts) + 1))
        rows += [(b, k, pack(keys[x:y]), zstandard.compress(count[x:y].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)) for (b, k, _), x, y in zip(mine, edges, edges[1:]) if y > x]
    return pa.Table.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*rows) if rows else ([],) * 4, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["batch", "kind", "payload", "counts"])


def ordered(t: pa.Table, percent: int) -> pa.Table:
    """Of one batch: each document's size, signature, lone hashes, and other hashes rarest first if its prefix has any."""
    kind, payload, counts = (t.column(c).to_pylist() for c in ("kind", "payload", "counts"))
    info = np.frombuffer(zstandard.decompress(next(p for k, p in zip(kind, payload) if k == 1)), np.int64).reshape(5, -1)
    ids, n, a, b, sent = info

    def with_counts(which: int) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(unpack(p), np.frombuffer(zstandard.decompress(c), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()) for k, p, c in zip(kind, payload, counts) if k == which]

    parts = with_counts(0)
    if waiting := [unpack(p) for k, p in zip(kind, payload) if k == 2]:
        common = with_counts(3)
        key, of_key = np.concatenate([p for p, _ in common]) >> np.uint64(16), np.concatenate([c for _, c in common])
        by_hash = np.argsort(key)
        parts += [(own, of_key[by_hash[np.searchsorted(key, own >> np.uint64(16), sorter=by_hash)]]) for own in waiting]
    lone, hashes = [None] * len(ids), [None] * len(ids)
    keys = np.concatenate([p for p, _ in parts]) if parts else np.zeros(0, np.uint64)
    df = np.concatenate([c for _, c in parts]) if parts else np.zeros(0, np.uint32)
    owner = (keys & np.uint64(0xFFFF)).astype(np.int64)
    h = keys >> np.uint64(16)
    single = n - np.bincount(owner, minlength=len(ids))
    prefix = n - least_overlap(n, percent) + 1
    open_ = (sent > 0) & (single < prefix)
    keep = open_[owner]
    owner, h, df = owner[keep], h[keep], df[keep]
    order = np.lexsort((h, df, owner))
    owner, h = owner[order], h[order]
    edges = np.searchsorted(owner, np.arange(len(ids) + 1))
    for i in np.flatnonzero(open_).tolist():
        lone[i], hashes[i] = int(single[i]), six(h[edges[i] : edges[i + 1]])
    return pa.table({"id": pa.array(ids), "n": pa.array(n), "s1": pa.array(a), "s2": pa.array(b), "lone": pa.array(lone, pa.int64()), "hashes": pa.array(hashes, pa.binary())})


def postings(sets: DataFrame, percent: int) -> DataFrame:
    """Rows (h, id, n, pos): the prefix of every set, without lone hashes."""

    def work(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, 512):
            ids, n, lone, hashes = (batch.column(i).slice(at, 512).to_pylist() for i in range(4))
            found = [from_six(x)[: max(0, k - least_overlap(k, percent) + 1 - s)] for k, s, x in zip(n, lone, hashes)]
            size = [len(f) for f in found]
            yield {
                "h": np.concatenate(found).astype(np.int64),
                "id": np.repeat(np.array(ids, np.int64), size),
                "n": np.repeat(np.array(n, np.int64), size),
                "pos": np.concatenate([np.arange(s, s + k) for s, k in zip(lone, size)]).astype(np.int64),
            }

    return map_rows(sets, ["id", "n", "lone", "hashes"], work, "h long, id long, n long, pos long")


def fits(na, pa_, nb, pb, percent: int):
    """Whether sizes and positions leave room for the overlap (columns or arrays)."""
    least = np.minimum if isinstance(na, np.ndarray) else F.least
    room = least(na - pa_, nb - pb)
    return ((100 + percent) * room >= percent * (na + nb)) & (100 * na >= percent * nb) & (100 * nb >= percent * na)


def leader_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of each list's least document with its other entries that fit."""
    lead = lists.groupBy("h").agg(F.min(F.struct("id", "n", "pos")).alias("l"), F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("h").alias("lh"), F.col("l.id").alias("la"), F.col("l.n").alias("ln"), F.col("l.pos").alias("lp"))
    both = lists.join(lead, (F.col("h") == F.col("lh")) & (F.col("id") != F.col("la")))
    return both.where(fits(F.col("ln"), F.col("lp"), F.col("n"), F.col("pos"), percent)).select(F.col("la").alias("a"), F.col("id").alias("b")).distinct()


def cross_pairs(lists: DataFrame, percent: int, list_rows: int = LIST_ROWS) -> DataFrame:
    """Distinct pairs of entries of one list that fit and don't yet reach each other (column c differs).

    A list longer than ``list_rows`` is split into m parts by id hash, and each two parts (and each
    part by itself) meet in a task of their own, so that no task holds more than about two parts.
    """
    open_ = lists.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.ceil(F.count(F.lit(1)) / list_rows).alias("m")).where("lo <> hi").select(F.col("h").alias("oh"), "m")
    own = F.when(F.col("m") > 1, F.pmod(F.xxhash64("id"), "m")).otherwise(F.lit(0))
    met = lists.join(open_, F.col("h") == F.col("oh")).withColumn("own", own.cast("long"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    mixed = met.select("h", F.least("own", "other").alias("u"), F.greatest("own", "other").alias("v"), "n", "pos", "id", "c", "own")

    def pairs_of(rows: np.ndarray):
        """rows: u, v, n, pos, id, c, own of two parts of a list. Sorted by size, blocks of partners are skipped as a whole."""
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2]))]
        u, v, n, pos, ids, c, own = rows.T
        two = u[0] != v[0]  # pairs inside one part are that part's own task
        starts = range(0, len(rows), BLOCK)
        for x in starts:
            a = slice(x, x + BLOCK)
            for y in range(x, len(rows), BLOCK):
                b = slice(y, y + BLOCK)
                if 100 * n[a].max() < percent * n[b].min():
                    break  # partners only get larger
                if (c[a].min() == c[a].max() == c[b].min() == c[b].max()) or not (100 + percent) * min((n[a] - pos[a]).max(), (n[b] - pos[b]).max()) >= percent * (n[a].min() + n[b].min()):
                    continue
                ok = fits(n[a][:, None], pos[a][:, None], n[b][None], pos[b][None], percent) & (c[a][:, None] != c[b][None])
                if two:
                    ok &= own[a][:, None] != own[b][None]
                i, j = np.nonzero(ok)
                keep = (i + x) < (j + y)
                left, right = ids[a][i[keep]], ids[b][j[keep]]
                yield np.minimum(left, right), np.maximum(left, right)

    def run(batches):
        held: list[np.ndarray] = []  # the last, unfinished group, as pieces of batches
        seen: list[np.ndarray] = []

        def flush():
            both = np.unique(np.concatenate(seen), axis=0)
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

        def done():
            for left, right in pairs_of(np.concatenate(held)[:, 1:]):
                if len(left):
                    seen.append(np.stack([left, right], axis=1))
                if sum(map(len, seen)) > 200_000:
                    yield flush()
            held.clear()

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy() for i in range(8)], axis=1)
            edges = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            for piece in np.split(rows, edges):
                if held and len(piece) and (held[-1][-1, :3] != piece[0, :3]).any():
                    yield from done()
                if len(piece):
                    held.append(piece)
        if held:
            yield from done()
        if seen:
            yield flush()
        give_back()

    return mixed.repartition("h", "u", "v").sortWithinPartitions("h", "u", "v").mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets reach the similarity: (a, b) and how b differs from a, its leader."""
    right = pairs.join(sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("hashes").alias("h_b")), "b")
    both = right.join(sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("hashes").alias("h_a")), "a")

    def work(batch: pa.RecordBatch):
        last, hashes, out = None, None, []
        for a, b, n_a, n_b, x, y in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if x is not last:
                last, hashes = x, np.sort(from_six(x))
            other = from_six(y)
            common = in_sorted(hashes, other)
            shared = int(common.sum())
            if 100 * shared >= percent * (n_a + n_b - shared):
                added = other[~common]
                removed = hashes[~in_sorted(np.sort(other[common]), hashes)]
                out.append((a, b, shared, six(added), six(removed)))
        if out:
            yield dict(zip(("a", "b", "shared", "added", "removed"), zip(*out)))

    return map_rows(both, ["a", "b", "n_a", "n_b", "h_a", "h_b"], work, "a long, b long, shared long, added binary, removed binary")


def derived(pairs: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Further pairs (a, b) that reach the similarity, from the answers of a's leader.

    a shares with b what its leader shares with b, less the removed and plus the added hashes
    that b holds; a set without a leader leads itself.
    """
    leads = links.groupBy("b").agg(F.min(F.struct("a", "added", "removed")).alias("l"))
    led = pairs.join(leads, "b", "left").select("a", "b", F.coalesce("l.a", "b").alias("z"), F.coalesce("l.added", F.lit(b"")).alias("added"), F.coalesce("l.removed", F.lit(b"")).alias("removed"))
    sized = led.join(sets.select(F.col("id").alias("b"), F.col("n").alias("n_b")), "b")
    other = sized.join(sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("hashes").alias("h_a")), "a")
    whole = other.join(sets.select(F.col("id").alias("z"), F.col("hashes").alias("h_z")), "z").sortWithinPartitions("z", "a")

    def work(batch: pa.RecordBatch):
        last, hashes, shared_z, out = None, None, 0, []
        for z, a, b, n_a, n_b, h_a, h_z, added, removed in zip(*(batch.column(i).to_pylist() for i in range(9))):
            if (z, a) != last:
                last, hashes = (z, a), np.sort(from_six(h_a))
                shared_z = int(in_sorted(hashes, from_six(h_z)).sum())
            shared = shared_z + int(in_sorted(hashes, from_six(added)).sum()) - int(in_sorted(hashes, from_six(removed)).sum())
            if 100 * shared >= percent * (n_a + n_b - shared):
                out.append((a, b))
        if out:
            yield dict(zip(("a", "b"), zip(*out)))

    return map_rows(whole, ["z", "a", "b", "n_a", "n_b", "h_a", "h_z", "added", "removed"], work, "a long, b long")


def in_sorted(values: np.ndarray, probes: np.ndarray) -> np.ndarray:
    at = np.searchsorted(values, probes)
    at[at == len(values)] = 0
    return values[at] == probes if len(values) else np.zeros(len(probes), bool)


def jaccard_components(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES, often: int = OFTEN) -> DataFrame:
    """Link documents whose sets of 5-word shingles have a Jaccard similarity of percent/100 or more.

    Returns id, n_shingles and component_id, the least id reachable by links (itself included).
    Texts that are null or without words have an empty set and link with nothing. A text of
    fewer than five words is one shingle. Rows that share an id count as one document with
    several texts. Rows with a null id link with nothing and have a null component. Repeated
    rows give repeated rows; an empty table gives an empty one; other columns are never read.

    A document is known by its place in its input partition until its hashes are back, so
    ``docs`` must give the same rows in the same order when a lost partition is read again, as
    tables read from files do; cut the lineage of anything shuffled first.
    """
    kind = dict(docs.select(id_col).dtypes)[id_col]
    known = docs.where(F.col(id_col).isNotNull())
    dealt = deal(known, range_count(known, text_col, range_bytes), id_col, text_col, often)
    lists = dealt.groupBy("bucket").applyInArrow(lambda t: then_give_back(repeated(t)), "batch long, kind int, payload binary, counts binary")
    rows = cut(lists.groupBy("batch").applyInArrow(lambda t: then_give_back(ordered(t, percent)), "id long, n long, s1 long, s2 long, lone long, hashes binary"))

    # equal sets are one class, named by its least document; one of its members carries the set
    info = rows.select("id", "n", "s1", "s2", F.col("hashes").isNotNull().alias("holds"))
    classes = info.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("class"), F.min(F.when(F.col("holds"), F.col("id"))).alias("carrier"))
    carried = classes.where("carrier is not null").select(F.col("carrier").alias("cid"), F.col("class"), F.col("s1").alias("c1"), F.col("s2").alias("c2"))
    held = rows.where("hashes is not null").join(carried, (F.col("id") == F.col("cid")) & (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")))
    sets = held.select(F.col("class").alias("id"), "n", "lone", "hashes")

    entries = postings(sets, percent)
    links = cut(verified(leader_pairs(entries, percent), sets, percent))
    reach = connected_components(links)
    placed = entries.join(reach, F.col("id") == F.col("node"), "left").select("h", "id", "n", "pos", F.coalesce("component", "id").alias("c"))
    more = derived(cross_pairs(placed, percent), sets, links, percent)
    final = connected_components(links.select("a", "b").unionByName(more)).select(F.col("node").alias("cn"), "component")

    named = classes.select(F.col("n").alias("kn"), F.col("s1").alias("k1"), F.col("s2").alias("k2"), "class").join(final, F.col("class") == F.col("cn"), "left")
    named = named.select("kn", "k1", "k2", F.coalesce("component", "class").alias("component"))
    out = info.join(named, (F.col("n") == F.col("kn")) & (F.col("s1") == F.col("k1")) & (F.col("s2") == F.col("k2")), "left")
    out = out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").cast(kind).alias("component_id"))

    def sizes_only(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, BATCH_ROWS):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(0).slice(at, BATCH_ROWS).to_pylist()]
            yield {"n_shingles": shingle_sets(texts)[1]}

    unnamed = map_rows(docs.where(F.col(id_col).isNull()), [text_col], sizes_only, "n_shingles long")
    return out.unionByName(unnamed.select(F.lit(None).cast(kind).alias(id_col), "n_shingles", F.lit(None).cast(kind).alias("component_id")))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, n_shingles, component_id of every document."""
    return jaccard_components(table(spark, sf_dir, "documents"))
