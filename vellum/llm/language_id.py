"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram is the product of its
letters' vectors, rotated by their place; a text is the sum of its trigrams' vectors;
a language is the sum of its texts' unit vectors. A text goes to the language whose
prototype has the largest cosine with it.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import map_rows, table

#: Dimensions, seed, and how many labelled documents the prototypes are fitted on at most.
DIMENSIONS, SEED, FIT_DOCUMENTS = 512, 20_011, 16_384
#: Characters handled at once; bounds memory, without effect on results.
BLOCK = 1 << 18
UNKNOWN = "und"


@functools.cache
def letter_codes() -> np.ndarray:
    """For each code point: 0 if it isn't a letter, else a code below 2**16."""
    points = np.arange(0x110000, dtype=np.uint32)
    letters = np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)
    return np.where(letters, points % 65521 + 1, 0).astype(np.uint16)


@functools.lru_cache(maxsize=100_000)
def letter_vector(code: int, dimensions: int) -> np.ndarray:
    """The random vector of a letter; code 0, what stands between words, has one too."""
    return np.random.default_rng([SEED, code]).choice(np.array([-1, 1], np.int8), dimensions)


def gram_vectors(grams: np.ndarray, dimensions: int) -> np.ndarray:
    """The bound vectors of trigrams coded in three times 16 bits."""
    out = np.ones((len(grams), dimensions), np.int8)
    for place in range(3):
        letters, where = np.unique(grams >> np.uint64(16 * place) & np.uint64(0xFFFF), return_inverse=True)
        table = np.stack([np.roll(letter_vector(c, dimensions), place) for c in letters.tolist()])
        out *= table[where]
    return out


def text_vectors(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """The bundled vector of each text (zero if it has no letter)."""
    out = np.zeros((len(texts), dimensions))
    pieces = [(i, t[a : a + BLOCK + 2]) for i, t in enumerate(texts) for a in range(0, max(1, len(t) - 2), BLOCK)]
    at = 0
    while at < len(pieces):
        upto, chars = at, 0
        while upto < len(pieces) and (upto == at or chars + len(pieces[upto][1]) <= BLOCK) and upto - at < 0xFFFF:
            chars += len(pieces[upto][1]) + 1
            upto += 1
        add_block(pieces[at:upto], out, dimensions)
        at = upto
    return out


def add_block(pieces: list[tuple[int, str]], out: np.ndarray, dimensions: int) -> None:
    text = "".join([f" {p.lower()} " for _, p in pieces])
    sizes = np.array([len(p.lower()) + 2 for _, p in pieces])
    codes = letter_codes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
    owner = np.repeat(np.arange(len(pieces), dtype=np.uint64), sizes)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (owner[1:] != owner[:-1])  # one gap between words
    codes, owner = codes[keep], owner[keep]
    grams = codes[:-2] << np.uint64(32) | codes[1:-1] << np.uint64(16) | codes[2:]
    whole = (owner[:-2] == owner[2:]) & (codes[1:-1] != 0)
    keys, counts = np.unique(owner[:-2][whole] << np.uint64(48) | grams[whole], return_counts=True)
    if not len(keys):
        return
    grams, where = np.unique(keys & np.uint64((1 << 48) - 1), return_inverse=True)
    vectors = gram_vectors(grams, dimensions)
    owner = (keys >> np.uint64(48)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    for a, b in zip(first, [*first[1:], len(owner)]):
        out[pieces[owner[a]][0]] += counts[a:b].astype(np.float32) @ vectors[where[a:b]].astype(np.float32)


def unit(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)


def held_out(id_col: str = "doc_id"):
    """Documents whose crc32 of the id, as text, is divisible by 5 are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", documents: int = FIT_DOCUMENTS, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes, from at most ``documents`` labelled documents outside the held-out fold.

    The documents are those of smallest id hash, so which ones doesn't depend on partitioning.
    Only one vector per language and partition reaches the driver's sum.
    """
    rank = F.xxhash64(F.col(id_col), F.lit(SEED))
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    last = labelled.select(rank.alias("_h")).orderBy("_h").limit(documents).agg(F.max("_h")).first()[0]
    if last is None:
        return [], np.zeros((0, dimensions))

    def work(batch: pa.RecordBatch):
        langs = np.array(batch.column(1).to_pylist(), object)
        vectors = unit(text_vectors(batch.column(0).to_pylist(), dimensions))
        names = sorted(set(langs))
        yield {"lang": names, "vector": [vectors[langs == n].sum(axis=0) for n in names]}

    parts = map_rows(labelled.where(rank <= last), [text_col, lang_col], work, "lang string, vector array<double>")
    sums = parts.select("lang", F.posexplode("vector").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"))
    rows = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("vector")).orderBy("lang").collect()
    return [r["lang"] for r in rows], unit(np.array([r["vector"] for r in rows]).reshape(-1, dimensions))


def predict(docs: DataFrame, languages: list[str], prototypes: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The language of every whole text: id, the columns ``keep``, lang_pred and score.

    score is (1 + cosine) / 2 with the winning prototype; ties go to the language that sorts
    first. Texts that are null or without a letter, and all texts if nothing was learned,
    get ``und`` and 0. Repeated rows give repeated rows; an empty table gives an empty one.
    """
    columns = [id_col, *(keep or [])]

    def work(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            vectors = text_vectors([t or "" for t in part.column(len(columns)).to_pylist()], prototypes.shape[1])
            lettered = np.abs(vectors).any(axis=1)
            if len(languages):
                cosine = np.round(unit(vectors) @ prototypes.T, 9)
                best = cosine.argmax(axis=1)
                score = np.clip((1 + cosine.max(axis=1)) / 2, 0, 1)
            else:
                best, score, lettered = np.zeros(len(vectors), int), np.zeros(len(vectors)), np.zeros(len(vectors), bool)
            yield {c: part.column(i) for i, c in enumerate(columns)} | {
                "lang_pred": [languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist())],
                "score": [s if ok else 0.0 for s, ok in zip(score.tolist(), lettered.tolist())],
            }

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", lang_pred string, score double"
    return map_rows(docs, [*columns, text_col], work, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, held_out, lang_pred, score of every document."""
    docs = table(spark, sf_dir, "documents")
    languages, prototypes = fit(docs)
    found = predict(docs, languages, prototypes)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
