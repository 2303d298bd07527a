"""Spelling variants: a self-join of the vocabulary trie with active-node sets.

Two words at distance one, the longer of L code points, agree in all but one place a. The vocabulary
is therefore dealt by (L, range of a, the letters before the range, the letters after it): first the two
halves of the word, so a word is sent to four groups, by its prefix or by its suffix. Groups that are too
large or whose free parts are too long are halved again, as often as needed; a range of one place leaves at most
one word for each letter. Every pair meets in exactly one group.

In a group the free parts form a trie. Its nodes are walked level by level, for all groups of a batch
at once, as flat arrays. The active set of a node is itself and the nodes at distance one:

* children, by one inserted letter; its parent, by one deleted; its siblings, by one replaced;
* and those reached by the same letter from an active node of its parent.

Where both nodes end words, a pair is emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import cut, give_back, small_batches, table

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST, OCCURRENCES, DIVISOR, RATIO = 7, 2, 31, 10
#: A group of more words, or with longer free parts, is halved.
GROUP_WORDS, FREE_PART = 1024, 64
#: Groups with more than this share of all rows are met by a broadcast: at most 1 / HOT of them.
HOT = 1 / 1024
#: Words whose tries a task holds at once, besides those of one group.
WORDS_AT_ONCE = 50_000
KEY = ["len", "lo", "hi", "pre", "suf"]


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR) -> DataFrame:
    """Rows (word): every run of letters, A-Z lower-cased, less one letter where the hash of id and run says so.

    A null id counts as the empty text; a null text has no runs.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"))
    # a run of the least length less one letter is too short to be a word
    w = runs.select("id", F.translate("run", UPPER, LOWER).alias("w")).where(F.char_length("w") >= LEAST)
    h = w.select("w", F.crc32(F.concat_ws(":", "id", "w").cast("binary")).alias("h"))
    at = F.pmod(F.col("h"), F.char_length("w")).cast("int")
    less = F.concat(F.substring(F.col("w"), F.lit(1), at), F.substring(F.col("w"), at + 2, F.char_length("w")))
    return h.select(F.when(F.col("h") % divisor == 0, less).otherwise(F.col("w")).alias("word"))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (word, n): distinct words long and frequent enough."""
    words = occurrences(docs, id_col, text_col).where(F.char_length("word") >= LEAST)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OCCURRENCES)


def _keyed(rows: DataFrame, ranges: Column) -> DataFrame:
    """Rows of (word, n, len) in each of the ranges (lo, hi) of the edit's place, with what is fixed before and after."""
    out = rows.select("word", "n", "len", F.explode(ranges).alias("r")).select("word", "n", "len", "r.lo", "r.hi")
    size = F.char_length("word")
    return out.withColumns({"pre": F.substring(F.col("word"), F.lit(1), F.col("lo")), "suf": F.substring(F.col("word"), size - (F.col("len") - F.col("hi")) + 1, F.col("len") - F.col("hi"))})


def _halves(lo: Column, hi: Column) -> Column:
    mid = F.floor((lo + hi) / 2).cast("int")
    return F.array(F.struct(lo.alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), hi.alias("hi")))


def groups(words: DataFrame, most: int = GROUP_WORDS, free: int = FREE_PART) -> DataFrame:
    """Rows (len, lo, hi, word, n lists): groups of at least two words, of bounded size.

    Each round halves the ranges of the groups still too large; rounds end with the largest group.
    """
    size = F.char_length("word")
    lengths = words.withColumn("len", F.explode(F.array(size, size + 1)))
    rows, out = _keyed(lengths, _halves(F.lit(0), F.col("len"))), []
    while True:
        sizes = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("k")).where("k > 1")
        wide = (F.col("hi") - F.col("lo") > 1) & ((F.col("k") > most) | (F.col("hi") - F.col("lo") > free))
        marks = cut(sizes.select(*KEY, "k", wide.alias("wide")))
        hot_size = (marks.agg(F.sum("k")).first()[0] or 0) * HOT
        known = rows.join(F.broadcast(marks.where(F.col("k") > hot_size).drop("k")), KEY, "left")
        rest = known.where("wide is null").drop("wide").join(marks.where(F.col("k") <= hot_size).drop("k"), KEY)
        met = known.where("wide is not null").unionByName(rest)
        out.append(met.where("not wide").groupBy(*KEY).agg(F.collect_list(F.struct("word", "n")).alias("words")))
        if marks.where("wide").isEmpty():
            break
        rows = cut(_keyed(met.where("wide").select("word", "n", "len", F.col("lo").alias("_lo"), F.col("hi").alias("_hi")), _halves(F.col("_lo"), F.col("_hi"))))
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every.select("len", "lo", "hi", "words")


def _children(parent: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (parent, letter) in order, and for each entry the one it belongs to."""
    code = parent.astype(np.int64) << 21 | letter
    found, back = np.unique(code, return_inverse=True)
    return found, back


def _spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All indices starts[i] .. starts[i] + counts[i] - 1, each with its i."""
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return starts[owner] + np.arange(len(owner)) - first[owner], owner


class Level:
    """The trie's nodes of one depth: sorted codes (parent, letter), the range of each node's children, the word that ends there or -1."""

    def __init__(self, codes: np.ndarray, nodes: int, word: np.ndarray):
        self.codes, self.word = codes, word
        parents = codes >> 21
        self.first = np.searchsorted(parents, np.arange(nodes))  # children of the level above
        self.count = np.searchsorted(parents, np.arange(nodes), side="right") - self.first

    def child(self, parent: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The node that a letter leads to, or -1."""
        code = parent.astype(np.int64) << 21 | letter
        at = np.minimum(np.searchsorted(self.codes, code), max(0, len(self.codes) - 1))
        return np.where(self.codes[at] == code, at, -1) if len(self.codes) else np.full(len(code), -1)


def build(group: np.ndarray, letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray, n_groups: int) -> list[Level]:
    """Tries of all groups, level by level; level 0 holds the roots. Words are spans of ``letters``; those of a group differ."""
    word = np.full(n_groups, -1)
    word[group[sizes == 0]] = np.flatnonzero(sizes == 0)
    levels, node, live, depth = [Level(np.arange(n_groups, dtype=np.int64) << 21, 0, word)], group, np.flatnonzero(sizes > 0), 0
    while len(live):
        codes, back = _children(node[live], letters[starts[live] + depth])
        word = np.full(len(codes), -1)
        ends = sizes[live] == depth + 1
        word[back[ends]] = live[ends]
        levels.append(Level(codes, len(levels[-1].codes), word))
        node = node.copy()
        node[live] = back
        live, depth = live[~ends], depth + 1
    return levels


def near(levels: list[Level]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) of word numbers at distance one, in both directions, by active-node sets.

    The set of a level's nodes is kept as pairs of a node and a node one level up, on the same level, or one down.
    """
    none = np.empty(0, np.int64)
    last = Level(none, 0, none)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    up, same = (none, none), (none, none)  # of the roots: only children, by insertion
    roots = len(levels[0].codes)
    at, owner = _spread(levels[1].first, levels[1].count) if len(levels) > 1 else (none, none)
    down = (owner, at)
    for depth, level in enumerate(levels):
        below = levels[depth + 1] if depth + 1 < len(levels) else last
        for (u, v), other in ((up, levels[depth - 1] if depth else last), (same, level), (down, below)):
            if len(u):
                both = (level.word[u] >= 0) & (other.word[v] >= 0)
                found.append((level.word[u[both]], other.word[v[both]]))
        if not len(below.codes):
            break
        lower = levels[depth + 2] if depth + 2 < len(levels) else Level(none, len(below.codes), none)
        letter, parent = below.codes & ((1 << 21) - 1), below.codes >> 21
        node = np.arange(len(below.codes))

        def step(pairs: tuple, target: Level, below=below, letter=letter) -> tuple:
            """(child of u, child of v) by the same letter."""
            u, v = pairs
            child, k = _spread(below.first[u], below.count[u])
            to = target.child(v[k], letter[child])
            return child[to >= 0], to[to >= 0]

        sibling, k = _spread(below.first[parent], below.count[parent])
        replaced = (k[sibling != k], sibling[sibling != k])
        grand, k = _spread(lower.first, lower.count)
        moved = [step(up, level), step(same, below), step(down, lower)]
        fresh = [(node, parent), replaced, (k, grand)]
        up, same, down = (_distinct(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])) for a, b in zip(moved, fresh))
    if not found:
        return none, none
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _distinct(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code = np.unique(u.astype(np.int64) << 31 | v)
    return code >> 31, code & ((1 << 31) - 1)


def _common_prefix(a: str, b: str) -> int:
    k = 0
    for x, y in zip(a, b):
        if x != y:
            break
        k += 1
    return k


def _portions(batch: pa.RecordBatch) -> Iterator[list[dict]]:
    """The groups of a batch, in portions of bounded size."""
    held, n = [], 0
    for row in range(batch.num_rows):
        one = batch.slice(row, 1).to_pylist()[0]
        if held and n + len(one["words"]) > WORDS_AT_ONCE:
            yield held
            held, n = [], 0
        held.append(one)
        n += len(one["words"])
    if held:
        yield held


def pairs(grouped: DataFrame) -> DataFrame:
    """Rows (word, near, near_n) for each word and each word at distance one, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (part for batch in batches for part in _portions(batch)):
            words = [w["word"] for r in rows for w in r["words"]]
            ns = [w["n"] for r in rows for w in r["words"]]
            group = np.repeat(np.arange(len(rows)), [len(r["words"]) for r in rows])
            parts = [w["word"][r["lo"] : len(w["word"]) - (r["len"] - r["hi"])] for r in rows for w in r["words"]]
            sizes = np.array([len(p) for p in parts], dtype=np.int64)
            letters = np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
            i, j = near(build(group, letters, np.cumsum(sizes) - sizes, sizes, len(rows)))
            out: tuple[list, list, list] = ([], [], [])
            for a, b in zip(i.tolist(), j.tolist()):
                r = rows[group[a]]
                # the group is that of the pair if its longer word has the group's length and the edit's place is in its range
                if max(len(words[a]), len(words[b])) == r["len"] and r["lo"] <= _common_prefix(words[a], words[b]) < r["hi"]:
                    out[0].append(words[a]), out[1].append(words[b]), out[2].append(ns[b])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["word", "near", "near_n"])
        give_back()

    small_batches(grouped.sparkSession)
    return grouped.mapInArrow(run, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root): from each word that has a form along forms to the last, by doubling the steps.

    Counts grow tenfold a step, so a chain of k steps asks for 10^k occurrences and rounds are few.
    """
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        far = at.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        step = cut(at.join(far, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        at = step.drop("moved")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO, group_words: int = GROUP_WORDS, free_part: int = FREE_PART) -> DataFrame:
    """Words of all texts with the form each is most likely a misspelling of.

    Returns word, form, root, n, n_near, form_n. Near words differ by exactly one code point
    inserted, deleted or replaced. A word's form is its most frequent near word (ties: the smallest), if
    that is at least ``ratio`` times as frequent; root follows the forms to the last. Words without
    near words have n_near 0 and no form. Null texts, texts without letters and empty tables add nothing; repeated
    rows count each time; a null id counts as the empty text in the hash; other columns are never read.
    """
    words = cut(vocabulary(docs, id_col, text_col))
    best = pairs(groups(words, group_words, free_part)).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("b"))
    joined = cut(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("b.m") >= ratio * F.col("n"), F.col("b.w")).alias("form"), (-F.col("b.m")).alias("m")))
    found = joined.join(roots(joined.where("form is not null")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", F.when(F.col("form").isNotNull(), F.col("m")).alias("form_n"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the vocabulary of all documents with forms and roots."""
    return variants(table(spark, sf_dir, "documents"))
