"""Masked pseudo-likelihood scores from a bidirectional window network.

Every word is predicted from the words around it on both sides, itself masked, through a softmax
of three levels: a group of classes, a class of the group, and a member of the class. The most
frequent words have a class each, the others share classes by their ending. A shared class has
members: one for each of its most frequent words, and others that its remaining words share by a
hash. The embeddings of the neighbours' classes, by place, add up to a hidden layer, and a softmax
follows at each level, so every level depends on both sides. Words that share a member have their
counts in all other documents as a last level; a document never vouches for its own words.
A document's score is the sum of the log-probabilities of its words.

Every word of every document is a training target once. Pieces of documents are dealt to blocks
by a hash of their content, so how the table is partitioned changes nothing. The blocks are dealt
to the rounds; in a round each block trains its own copy of the network, in an order that the
hash gives, and the copies are averaged by the words they saw.
"""

from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.common import cut, map_rows, small_batches, table, written

#: Classes of frequent words, classes of other words by ending, words seen on each side, hidden units.
FREQUENT, ENDINGS, SIDE, HIDDEN = 511, 128, 2, 24
CLASSES = 1 + FREQUENT + ENDINGS
#: Groups of consecutive classes, and classes of a group.
GROUPS = 20
WIDE = -(-CLASSES // GROUPS)
#: Members of a shared class: the first are words of their own, the others are shared by a hash.
MEMBERS, OWN = 32, 24
#: Codes of words. Below CLASSES a code is a class of one word; from there on MEMBERS codes follow for each ending.
CODES = CLASSES + ENDINGS * MEMBERS
CLASS_OF = np.concatenate([np.arange(CLASSES), np.repeat(1 + FREQUENT + np.arange(ENDINGS), MEMBERS)]).astype(np.int32)
SHARED = (np.arange(CODES) >= CLASSES) & ((np.arange(CODES) - CLASSES) % MEMBERS >= OWN)
#: Rounds of averaging; step size; windows in a step; words of a block, which one copy trains on.
ROUNDS, RATE, WINDOWS, BLOCK_WORDS = 2, 0.1, 4096, 1 << 20
#: Words of a piece of a document; windows mixed before they are dealt to steps.
PIECE, MIXED = 4096, 1 << 16
#: Windows scored at once; documents, whose numbers have 16 bits, and words that are looked up together: memory bounds, without effect on results.
BLOCK, TOGETHER, WORDS_TOGETHER = 1 << 14, 8192, 1 << 22
#: Bytes of text that are cut into words at once, and looked up together: also without effect on results.
TOKENIZED, BYTES_TOGETHER = 1 << 20, 1 << 28
EDGE, SEED = 0, 11
#: Logits whose exponentials, and sums of them, single precision holds. The bias of a class that isn't there is -30.
SAFE = 60
#: Added to the count of every word of a class, and of one unseen word.
SMOOTH = 0.5
#: Values of the network in a row on their way to the average.
SLICE = 4096


class Vocabulary:
    """Numbers for the words of some documents, in order of first use."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.sizes: list[int] = []
        self.words: list[pa.Array] = []
        self.parts: list[np.ndarray] = []
        self.total = self.bytes = 0

    def add(self, texts: pa.Array) -> int:
        """Take the first of the texts, about TOKENIZED bytes of them but one at least, and return how many."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
        n = min(len(texts), TOGETHER - len(self.sizes), max(1, int(np.searchsorted(ends, TOKENIZED, "right"))))
        words, sizes = words_of(texts.slice(0, n))
        some, numbers = different_words(pa.chunked_array([words]))  # words recur nearby: few are left for all documents
        self.words.append(some)
        self.parts.append(numbers)
        self.sizes += sizes.tolist()
        self.total += len(words)
        self.bytes += int(ends[n - 1])
        return n

    def full(self) -> bool:
        return len(self.sizes) >= TOGETHER or self.total >= WORDS_TOGETHER or self.bytes >= BYTES_TOGETHER

    def numbered(self) -> tuple[pa.Array, np.ndarray]:
        """The different words, and the number of each word of the documents."""
        words, numbers = different_words(pa.chunked_array(self.words, pa.binary()))
        words = words.cast(pa.string())
        wide = pc.not_equal(pc.binary_length(words), pc.utf8_length(words))
        lower = pa.array([w.lower() for w in words.filter(wide).to_numpy(zero_copy_only=False)], pa.string())
        words, merged = different_words(pa.chunked_array([pc.replace_with_mask(words, wide, lower)]))
        numbers = merged[numbers]
        firsts = np.cumsum([0, *map(len, self.words)]).tolist()
        return words, np.concatenate([np.zeros(0, np.int32), *(numbers[a:z].take(p) for a, z, p in zip(firsts, firsts[1:], self.parts))])


def different_words(words: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The different values in order of first use, and the number of each value."""
    if not len(words):
        return pa.array([], words.type), np.zeros(0, np.int32)
    found = words.dictionary_encode()  # all chunks share one dictionary
    return found.chunk(0).dictionary, np.concatenate([c.indices.to_numpy() for c in found.chunks])


#: White space as ``str.split`` has it, in UTF-8: single bytes, and longer ones by their length.
SPACES = bytes(c for c in range(128) if chr(c).isspace())
LONG_SPACES = {n: np.array([int.from_bytes(b) for b in (chr(c).encode() for c in range(128, 0x3001) if chr(c).isspace()) if len(b) == n]) for n in (2, 3)}
#: 1 for bytes of words; 2 and 3 for bytes that may begin a longer white space.
INSIDE = bytes(int(c not in SPACES) for c in range(256))
LEADS = {n: np.unique(v >> 8 * (n - 1)) for n, v in LONG_SPACES.items()}
LEAD = bytes(next((n for n, v in LEADS.items() if c in v), 0) for c in range(256))
LOWER = bytes(range(256)).lower()


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (null: none) as ``str.split`` finds them, A-Z in lower case, and how many each text has."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    edges = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())])
    raw = bytes(packed(texts))
    leads = np.frombuffer(raw.translate(LEAD), np.uint8)
    if len(at := np.flatnonzero(leads)):
        data = np.frombuffer(raw, np.uint8).copy()
        for n, spaces in LONG_SPACES.items():
            first = at[leads[at] == n]
            places = first[:, None] + np.arange(n)
            data[places[np.isin(data[places].astype(int) @ (256 ** np.arange(n)[::-1]), spaces)]] = SPACES[0]
        raw = data.tobytes()
    inside = np.frombuffer(b"\0" + raw.translate(INSIDE) + b"\0", bool)
    within = inside[1:] & inside[:-1]  # at each place, and at the end: a word goes on
    within[edges] = False
    starts = np.flatnonzero(inside[1:] & ~within)
    stops = np.flatnonzero(inside[:-1] & ~within)
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw.translate(LOWER, SPACES))])
    return words, np.diff(np.searchsorted(starts, edges))


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all documents; counts are added up over many documents before the shuffle."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        seen = Vocabulary()

        def counted():
            words, numbers = seen.numbered()
            return pa.RecordBatch.from_arrays([words, pa.array(np.bincount(numbers, minlength=len(words)))], schema=schema)

        for batch in batches:
            texts = batch.column(0)
            while len(texts):
                texts = texts.slice(seen.add(texts))
                if seen.full():
                    yield counted()
                    seen.clear()
        if seen.sizes:
            yield counted()

    small_batches(docs.sparkSession)
    return docs.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def checksums(words: pa.Array) -> np.ndarray:
    """crc32 of each word in UTF-8."""
    return np.fromiter(map(zlib.crc32, words.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.int64, len(words))


class Classes:
    """The code of each word, given those of the words that have one of their own; code 0 stands for what lies beyond a document's ends."""

    def __init__(self, known: dict[str, int]):
        self.words, self.codes = pa.array(list(known), pa.string()), np.array([*known.values(), 0])

    def __call__(self, text: str) -> np.ndarray:
        return self.of(pa.array(text.lower().split(), pa.string()))

    def of(self, words: pa.Array) -> np.ndarray:
        endings, ending = different_words(pa.chunked_array([pc.utf8_slice_codeunits(words, -2)]))
        shared = (CLASSES + checksums(endings) % ENDINGS * MEMBERS + OWN)[ending] + checksums(words) % (MEMBERS - OWN)
        at = pc.index_in(words, self.words).fill_null(-1).to_numpy()
        return np.where(at < 0, shared, self.codes[at]).astype(np.int32)


def start(counts: np.ndarray) -> dict[str, np.ndarray]:
    """The untrained network: small random weights, and the corpus' frequencies of each level as biases.

    counts: occurrences of each code. ``top`` has a column for each group, ``inner`` for each group
    one for each of its classes, ``last`` for each ending one for each member; the last row of each
    is the bias.
    """
    r = np.random.default_rng(SEED)
    full = np.zeros(GROUPS * WIDE)
    full[:CLASSES] = np.bincount(CLASS_OF, counts, CLASSES) + 1.0
    each = full.reshape(GROUPS, WIDE)
    top = np.concatenate([r.normal(0, 0.1, (HIDDEN, GROUPS)), np.log(each.sum(axis=1) / full.sum())[None]])
    bias = np.log(np.maximum(each / each.sum(axis=1, keepdims=True), 1e-13))
    inner = np.concatenate([r.normal(0, 0.1, (GROUPS, HIDDEN, WIDE)), bias[:, None]], axis=1)
    embed = r.normal(0, 0.3, (2 * SIDE * CLASSES, HIDDEN))
    members = counts[CLASSES:].reshape(ENDINGS, MEMBERS) + 1.0
    bias = np.log(members / members.sum(axis=1, keepdims=True))
    last = np.concatenate([r.normal(0, 0.1, (ENDINGS, HIDDEN, MEMBERS)), bias[:, None]], axis=1)
    return {k: v.astype(np.float32) for k, v in (("embed", embed), ("top", top), ("inner", inner), ("last", last))}


SHAPES = {"embed": (2 * SIDE * CLASSES, HIDDEN), "top": (HIDDEN + 1, GROUPS), "inner": (GROUPS, HIDDEN + 1, WIDE), "last": (ENDINGS, HIDDEN + 1, MEMBERS)}


def flat(net: dict) -> np.ndarray:
    return np.concatenate([net[k].ravel() for k in SHAPES]).astype(np.float64)


def from_flat(values: np.ndarray) -> dict[str, np.ndarray]:
    edges = np.cumsum([0, *[math.prod(s) for s in SHAPES.values()]])
    return {k: values[a:z].reshape(s).astype(np.float32) for (k, s), a, z in zip(SHAPES.items(), edges, edges[1:])}


def around_each(wide: np.ndarray) -> np.ndarray:
    """The rows of ``embed`` for the neighbours of each word of a piece that has SIDE codes more at both ends."""
    wide, n = CLASS_OF[wide], len(wide) - 2 * SIDE
    return np.stack([wide[j : j + n] for j in range(2 * SIDE + 1) if j != SIDE], axis=1) + np.arange(2 * SIDE, dtype=np.int32) * CLASSES


def joined(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours and codes of the words of all pieces, packed with SIDE codes more at both ends, and how many words each has."""
    sizes = np.array([len(p) // 2 for p in pieces])
    codes = np.frombuffer(b"".join(pieces), np.int16).astype(np.int32)
    inside = np.ones(len(codes) - 2 * SIDE, bool)
    inside[(np.cumsum(sizes)[:-1, None] + np.arange(-2 * SIDE, 0)).ravel()] = False  # windows over the edge of two pieces
    return around_each(codes)[inside], codes[SIDE : len(codes) - SIDE][inside], sizes - 2 * SIDE


def windows(codes: np.ndarray) -> np.ndarray:
    """The neighbours of each word of a whole document."""
    return around_each(np.pad(codes, SIDE, constant_values=EDGE))


def hidden(net: dict, around: np.ndarray) -> np.ndarray:
    """The hidden layer, with a last column of ones."""
    out = np.ones((len(around), HIDDEN + 1), net["embed"].dtype)
    total = net["embed"].take(around[:, 0], axis=0)
    for j in range(1, 2 * SIDE):
        total += net["embed"].take(around[:, j], axis=0)
    total *= -2  # tanh by the exponential, which numpy has faster
    with np.errstate(over="ignore"):
        np.exp(total, out=total)
    total += 1
    np.divide(2, total, out=total)
    np.subtract(total, 1, out=out[:, :HIDDEN])
    return out


class Levels:
    """Rows in order of their codes, with the stretches that meet the same weights at each level."""

    def __init__(self, target: np.ndarray):
        self.order = np.argsort(target.astype(np.int16), kind="stable")  # numpy sorts short integers by radix
        codes = target[self.order]
        classes = CLASS_OF[codes]
        self.group, self.place = classes // WIDE, classes % WIDE
        self.groups = self.runs(self.group, np.arange(GROUPS + 1))
        self.rest = int(np.searchsorted(codes, CLASSES))  # words of shared classes come last
        self.member = (codes[self.rest :] - CLASSES) % MEMBERS
        self.endings = self.runs(codes[self.rest :], CLASSES + MEMBERS * np.arange(ENDINGS + 1))

    @staticmethod
    def runs(values: np.ndarray, edges: np.ndarray) -> list[tuple[int, int, int]]:
        """(k, start, stop) of the values from the k-th edge on, where there are any."""
        at = np.searchsorted(values, edges).tolist()
        return [(k, i, j) for k, (i, j) in enumerate(zip(at, at[1:])) if j > i]


def logits(h: np.ndarray, weights: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Each row times the weights of its run."""
    out = np.empty((len(h), weights.shape[2]), h.dtype)
    for k, i, j in runs:
        np.dot(h[i:j], weights[k], out=out[i:j])
    return out


def exponentials(z: np.ndarray) -> np.ndarray:
    """exp(z) in place and the sums of its rows; rows are shifted by their largest entry first where any could overflow or vanish."""
    if z.size and max(-z.min(), z.max()) > SAFE:
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    return z @ np.ones(z.shape[1], z.dtype)


def log_softmax_at(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log softmax(z)[row, at[row]]; z is used up."""
    if z.size and max(-z.min(), z.max()) > SAFE:
        z -= z.max(axis=1, keepdims=True)
    picked = z[np.arange(len(z)), at].astype(np.float64)
    return picked - np.log(exponentials(z).astype(np.float64))


def log_probabilities(net: dict, around: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p(code | neighbours) for each row: that of its group, of the class in the group, and of the member in a shared class."""
    by = Levels(target)
    h = hidden(net, around[by.order])
    logs = log_softmax_at(h @ net["top"], by.group)
    logs += log_softmax_at(logits(h, net["inner"], by.groups), by.place)
    logs[by.rest :] += log_softmax_at(logits(h[by.rest :], net["last"], by.endings), by.member)
    out = np.empty(len(target))
    out[by.order] = logs
    return out


def softmax_error(z: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Gradient by the logits of the mean negative log-likelihood over n rows."""
    sums = exponentials(z)
    z *= (1 / (sums * n))[:, None]
    z[np.arange(len(z)), at] -= 1 / n
    return z


def gradient(net: dict, around: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
    """The gradient of the mean negative log-likelihood."""
    n, by = len(target), Levels(target)
    x = around[by.order]
    h = hidden(net, x)
    error = softmax_error(h @ net["top"], by.group, n)
    out = {"top": h.T @ error, "inner": np.zeros_like(net["inner"]), "last": np.zeros_like(net["last"])}
    back = error @ net["top"][:HIDDEN].T
    for level, first, runs, at in (("inner", 0, by.groups, by.place), ("last", by.rest, by.endings, by.member)):
        mine, weights, change = h[first:], net[level], out[level]
        error, below = softmax_error(logits(mine, weights, runs), at, n), np.empty_like(back[first:])
        for k, i, j in runs:
            np.dot(error[i:j], weights[k, :HIDDEN].T, out=below[i:j])
            np.dot(mine[i:j].T, error[i:j], out=change[k])
        back[first:] += below
    back *= 1 - h[:, :HIDDEN] ** 2
    # two hidden units are added up as one complex number, by place and row
    pairs, embed = np.ascontiguousarray(back.view(np.result_type(back, 1j)).T), np.zeros((HIDDEN // 2, len(net["embed"])), np.result_type(back, 1j))
    for rows in x.T.astype(np.intp):
        for own, change in zip(pairs, embed):
            np.add.at(change, rows, own)
    embed = np.ascontiguousarray(embed.T).view(back.dtype)
    return {"embed": embed, **out}


def train(net: dict, squares: dict, around: np.ndarray, target: np.ndarray) -> None:
    """One pass of gradient steps in place; each weight's step is RATE over the root of its squared gradients so far."""
    for a in range(0, len(target), WINDOWS):
        for k, d in gradient(net, around[a : a + WINDOWS], target[a : a + WINDOWS]).items():
            squares[k] += d * d
            net[k] -= RATE * d / np.sqrt(squares[k])


class Copy:
    """The copy of the network that one block trains."""

    def __init__(self, given: np.ndarray, block: int):
        self.net, self.mix = from_flat(given), np.random.default_rng([SEED, block])
        self.squares = {k: np.full(s, 1e-6, np.float32) for k, s in SHAPES.items()}
        self.pieces, self.waiting, self.seen = [], 0, 0

    def add(self, piece: bytes) -> None:
        self.pieces.append(piece)
        self.waiting += len(piece) // 2 - 2 * SIDE
        if self.waiting >= MIXED:
            self.step()

    def step(self) -> None:
        if self.waiting:
            order = self.mix.permutation(self.waiting)  # neighbouring words of a document go to different steps
            around, target, _ = joined(self.pieces)
            train(self.net, self.squares, around[order], target[order])
            self.pieces, self.waiting, self.seen = [], 0, self.seen + self.waiting


#: Rows of ``encoded``: kind 0 a document, 1 a piece of its codes, 2 a word that shares its code.
ENCODED = "kind int, batch long, doc int, id {}, n_words long, key long, part int, codes binary, word string, code int, docs binary"


def encoded(docs: DataFrame, known: dict[str, int], id_col: str, text_col: str) -> DataFrame:
    """Documents as numbers. A batch is some thousands of documents of one task, numbered within it.

    kind 0: batch, doc, id, n_words of a document. kind 1: key (content hash), part, codes: the
    document's codes in pieces, with SIDE codes more at both ends. kind 2: each
    different word of a batch that shares its code, with the code and its occurrences as
    packed document numbers, ascending.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = dict(docs.select(id_col).dtypes)[id_col]
    types = to_arrow_schema(StructType.fromDDL(ENCODED.format(kind)))

    def run(batches):
        classes, seen, numbers = Classes(known), Vocabulary(), itertools.count()
        ids: list = []
        keys: list = []

        def rows(n, **columns):
            made = (columns.get(f.name) for f in types)
            return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if c is None else c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(made, types)], schema=types)

        def done():
            batch = TaskContext.get().partitionId() << 32 | next(numbers)
            words, codes = seen.numbered()
            sizes, n = np.array(seen.sizes), len(ids)
            of = classes.of(words)
            yield rows(n, kind=[0] * n, batch=[batch] * n, doc=np.arange(n, dtype=np.int32), id=ids, n_words=sizes)
            edges = np.cumsum([0, *sizes])
            coded = np.full(len(codes) + 2 * SIDE * n, EDGE, np.int16)  # every document with its ends
            coded[np.arange(len(codes)) + np.repeat(SIDE + 2 * SIDE * np.arange(n), sizes)] = of.astype(np.int16)[codes]
            starts = (edges + 2 * SIDE * np.arange(n + 1)).tolist()
            some = []
            for i, (a, z) in enumerate(zip(starts, starts[1:])):
                some += [(i, keys[i], x // PIECE, coded[a + x : min(a + x + PIECE + 2 * SIDE, z)].tobytes()) for x in range(0, z - a - 2 * SIDE, PIECE)]
                if some and (len(some) >= 1024 or i + 1 == n):
                    yield rows(len(some), kind=[1] * len(some), batch=[batch] * len(some), **dict(zip(("doc", "key", "part", "codes"), zip(*some))))
                    some = []
            shared = np.flatnonzero(SHARED[of])
            rare = np.flatnonzero(SHARED[of][codes])
            order = rare[np.argsort((codes[rare] & 0xFFFF).astype(np.uint16), kind="stable")]  # numpy sorts short integers by radix
            order = order[np.argsort((codes[order] >> 16).astype(np.uint16), kind="stable")]
            raw = np.repeat(np.arange(n, dtype=np.uint16), sizes)[order]
            stops = 2 * np.cumsum(np.bincount(codes[rare], minlength=len(words))[shared])
            offsets = np.concatenate([[0], stops]).astype(np.int32)
            where = pa.Array.from_buffers(pa.binary(), len(shared), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
            each, code = words.take(pa.array(shared)), pa.array(of[shared])
            for x in range(0, len(shared), 50_000):
                m = min(50_000, len(shared) - x)
                yield rows(m, kind=[2] * m, batch=[batch] * m, word=each.slice(x, m), code=code.slice(x, m), docs=where.slice(x, m))

        for batch in batches:
            while batch.num_rows:
                n = seen.add(batch.column(2))
                ids += batch.column(0).slice(0, n).to_pylist()
                keys += batch.column(1).slice(0, n).to_pylist()
                batch = batch.slice(n)
                if seen.full():
                    yield from done()
                    seen.clear()
                    ids, keys = [], []
        if ids:
            yield from done()

    small_batches(docs.sparkSession)
    return docs.select(id_col, F.xxhash64(id_col, text_col), text_col).mapInArrow(run, ENCODED.format(kind))


def train_round(dealt: DataFrame, net: dict) -> dict:
    """Train a copy of the network for each block of (block, key, part, codes), and average the copies."""
    given = flat(net)

    def run(batches):
        total, seen, block, copy = np.zeros(len(given)), 0, None, None

        def done():
            copy.step()
            return flat(copy.net) * copy.seen, copy.seen

        for batch in batches:
            for b, codes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if b != block:
                    if copy:
                        values, n = done()
                        total, seen = total + values, seen + n
                    block, copy = b, Copy(given, b)
                copy.add(codes)
        if copy:
            values, n = done()
            total, seen = total + values, seen + n
            cuts = range(0, len(total), SLICE)
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(list(cuts), pa.int32()), pa.array([part] * len(cuts), pa.int32()), pa.array([seen] * len(cuts), pa.int64()), pa.array([total[c : c + SLICE].tobytes() for c in cuts], pa.binary())], names=["at", "part", "seen", "values"])

    def add(t: pa.Table) -> pa.Table:
        values = np.sum([np.frombuffer(v) for v in t["values"].to_pylist()], axis=0)
        return pa.table({"at": t["at"][:1], "part": t["part"][:1], "seen": pa.array([pc.sum(t["seen"]).as_py()], pa.int64()), "values": [values.tobytes()]})

    schema = "at int, part int, seen long, values binary"
    ordered = dealt.repartition("block").sortWithinPartitions("block", "key", "part", "codes").select("block", "codes")
    parts = ordered.mapInArrow(run, schema)
    teams = max(1, math.isqrt(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    some = parts.groupBy("at", F.pmod("part", F.lit(teams)).alias("team")).applyInArrow(add, schema)
    rows = some.groupBy("at").applyInArrow(add, schema).orderBy("at").collect()  # one network
    return from_flat(np.concatenate([np.frombuffer(bytes(r["values"])) for r in rows]) / rows[0]["seen"]) if rows else net


def class_totals(words: DataFrame, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences and different words of each code, from (word, n)."""

    def code_of(batch: pa.RecordBatch):
        codes = Classes(known).of(batch.column(0).cast(pa.string()))
        ends, kinds = np.bincount(codes, batch.column(1).to_numpy(), CODES), np.bincount(codes, minlength=CODES)
        yield {"code": np.flatnonzero(kinds), "n": ends[kinds > 0].astype(np.int64), "kinds": kinds[kinds > 0]}

    counts, different = np.zeros(CODES), np.zeros(CODES)
    for r in map_rows(words, ["word", "n"], code_of, "code int, n long, kinds long").groupBy("code").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).collect():
        counts[r["code"]], different[r["code"]] = r["n"], r["kinds"]
    return counts, different


def vocabulary(words: DataFrame) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Codes of the words that have one of their own, and occurrences and different words of each code.

    These are the FREQUENT most frequent words, and of the others the OWN most frequent of each
    ending; tasks keep no more than OWN words an ending, so the driver holds FREQUENT + ENDINGS * OWN words.
    """
    known = {r["word"]: 1 + i for i, r in enumerate(words.orderBy(F.desc("n"), "word").limit(FREQUENT).collect())}
    place = F.row_number().over(Window.partitionBy("ending").orderBy(F.desc("n"), "word"))
    others = words.where(~F.col("word").isin(list(known))).withColumn("ending", F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(ENDINGS)))
    for r in others.withColumn("place", place).where(F.col("place") <= OWN).orderBy("ending", "place").collect():
        known[r["word"]] = CLASSES + r["ending"] * MEMBERS + r["place"] - 1
    return known, *class_totals(words, known)


def fit(coded: DataFrame, counts: np.ndarray, rounds: int = ROUNDS, block_words: int = BLOCK_WORDS) -> dict:
    """The network, trained on all pieces of ``encoded``. The driver holds one network.

    The result is the same for every partitioning of the documents, but for the rounding of sums.
    """
    net = start(counts)
    blocks = max(1, rounds) * max(1, math.ceil(counts.sum() / (max(1, rounds) * block_words)))
    dealt = coded.where("kind = 1").select(F.pmod(F.xxhash64("key", "part"), F.lit(blocks)).alias("block"), "key", "part", "codes")
    for turn in range(rounds):
        net = train_round(dealt.where(F.col("block") % rounds == turn), net)
    return net


def score(coded: DataFrame, net: dict, id_col: str = "doc_id", words: DataFrame | None = None, counts: np.ndarray | None = None, different: np.ndarray | None = None) -> DataFrame:
    """Score every whole text of ``encoded``.

    Returns id, n_words, log_prob and mean_log_prob (null for texts that are null or without
    words, whose sum is 0). With ``words``, the counts (word, n) of the corpus, and the totals by code,
    log_prob sums log p(word's code | both sides) + log p(word | code) over the words, the latter from the
    counts less those of the document itself, and 0 for a word with a code of its own; without, the former only. Repeated rows give repeated
    rows; an empty table gives an empty one.
    """
    given = flat(net)

    def work(batch: pa.RecordBatch, own: dict):
        at = 0
        codes = batch.column(2)
        sizes = pc.binary_length(codes).to_numpy() // 2 - 2 * SIDE
        while at < batch.num_rows:
            stop = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), BLOCK, "right")))
            around, target, _ = joined(codes.slice(at, stop - at).to_pylist())
            logs = log_probabilities(own, around, target)
            yield {"batch": batch.column(0).slice(at, stop - at), "doc": batch.column(1).slice(at, stop - at), "log_prob": np.add.reduceat(logs, np.cumsum([0, *sizes[at : stop - 1]]))}
            at = stop

    kind = dict(coded.dtypes)["id"]
    by_code = map_rows(coded.where("kind = 1"), ["batch", "doc", "codes"], work, "batch long, doc int, log_prob double", lambda: from_flat(given))
    rows = coded.where("kind = 0").select("batch", "doc", "id", "n_words").unionByName(by_code, allowMissingColumns=True)
    with_words = words is not None
    if with_words:
        # a word of one document alone counts 0 elsewhere, as an unknown one does, so its count isn't sent
        # words meet by a hash of 64 bits, which is shorter and sorts faster
        known = words.where("n > 1").select(F.xxhash64("word").alias("_known"), "n")
        found = coded.where("kind = 2").select("batch", F.xxhash64("word").alias("_word"), "code", "docs").join(known, F.col("_word") == F.col("_known"), "left").drop("_word", "_known")
        rows = rows.unionByName(found, allowMissingColumns=True)

    def add_up(t: pa.Table) -> pa.Table:
        base, pieces = t.filter(pc.is_valid(t["n_words"])), t.filter(pc.is_valid(t["log_prob"]))
        sums = np.bincount(pieces["doc"].to_numpy(), pieces["log_prob"].to_numpy(), TOGETHER)
        if with_words:
            found = t.filter(pc.is_valid(t["docs"]))
            sums = sums + within(found["n"].fill_null(0).to_numpy(), found["code"].to_numpy(), found["docs"], counts, different)
        own, sizes = sums[base["doc"].to_numpy()], base["n_words"].to_numpy()
        means = pa.array([x / n if n else None for x, n in zip(own.tolist(), sizes.tolist())], pa.float64())
        return pa.table({id_col: base["id"], "n_words": base["n_words"], "log_prob": own, "mean_log_prob": means})

    return rows.groupBy("batch").applyInArrow(add_up, f"{id_col} {kind}, n_words long, log_prob double, mean_log_prob double")


def packed(values: pa.Array) -> memoryview:
    """All values of an array of bytes or texts, one after another."""
    if not len(values):
        return memoryview(b"")
    wide = pa.types.is_large_binary(values.type) or pa.types.is_large_string(values.type)
    ends = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1]
    return memoryview(values.buffers()[2])[ends[0] : ends[-1]]


def within(n: np.ndarray, code: np.ndarray, docs: pa.ChunkedArray, counts: np.ndarray, different: np.ndarray) -> np.ndarray:
    """For each of TOGETHER documents, the sum of log p(word | code) over its words that share a code.

    n, code, docs: corpus count, code and occurrences (packed document numbers, ascending) of
    each different word. Counts leave out the document itself.
    """
    each = pc.binary_length(docs).to_numpy() // 2
    doc = np.frombuffer(b"".join(map(packed, docs.chunks)), np.uint16).astype(np.int64)
    word = np.repeat(np.arange(len(docs)), each)
    first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])])) if len(doc) else np.zeros(0, np.int64)
    own = np.diff(first, append=len(doc))
    word, doc = word[first], doc[first]
    cell = doc * SHARED.sum() + (np.cumsum(SHARED) - 1)[code[word]]
    in_code = np.bincount(cell, own)[cell]
    rest = np.maximum(n[word] - own, 0) + SMOOTH
    total = np.maximum(counts[code[word]] - in_code, 0) + SMOOTH * (different[code[word]] + 1)
    return np.bincount(doc, own * (np.log(rest) - np.log(total)), TOGETHER)


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Train on all documents and score each of them: id, n_words, log_prob, mean_log_prob (see ``score``).

    Other columns are never read. Documents are encoded once, into a table in the shared folder.
    """
    words = cut(count_words(docs, text_col))
    known, counts, different = vocabulary(words)
    coded = written(encoded(docs, known, id_col, text_col), "encoded")
    return score(coded, fit(coded, counts, rounds, block_words), id_col, words, counts, different)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-likelihood of every document under a network trained on all of them."""
    return score_corpus(table(spark, sf_dir, "documents"))
