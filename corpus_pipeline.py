"""The corpus pipeline: language ID, near-duplicate removal, source mixing, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's documents. All but the last return the columns of
documents; columns beyond those the stage reads pass through untouched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import bpe, language_id, mixing, ngram_join
from vellum.llm.common import cut, shared_folder, table

#: Words a Python worker remembers in the last stage, which runs beside what earlier stages left in the executor's memory.
WORDS_KEPT = 40_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents with a language.

    Rejected are texts that are null or without any letter, and texts whose vector has no
    positive cosine with any language's prototype (score 0.5 or less). If no language can be
    learned, only the former go. Null ids, repeated rows and ties pass like others.
    """
    languages, prototypes = language_id.fit(docs)
    # lang_pred is decided from the whole row's text, so rows travel with their columns and need no join back
    kept = [c for c in docs.columns if c != "text"]
    names = {c: f"_c{i}" for i, c in enumerate(kept)}
    plain = docs.select(F.col("text").alias("_text"), *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    if languages:
        found = language_id.predict(plain, languages, prototypes, names["doc_id"], "_text", keep=["_text", *[n for c, n in names.items() if c != "doc_id"]])
        good = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") > 0.5))
    else:
        good = plain.where(F.col("_text").rlike(r"\p{L}"))
    return good.select(*[F.col("_text").alias(c) if c == "text" else F.col(names[c]).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of least id, of each group linked by 5-word shingle similarity of 0.75.

    Documents without words, or with a null id, are in no group and stay. Rows of one id are one
    document: its texts stay or go together, and of equal texts one row stays.
    """
    found = ngram_join.jaccard_components(docs)
    groups = cut(found.where("doc_id is not null and component_id <> doc_id").select(F.col("doc_id").alias("__vellum_gone")).distinct())
    rest = docs.join(groups, docs["doc_id"] == F.col("__vellum_gone"), "left_anti")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    if repeated.isEmpty():
        return rest
    return rest.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(rest.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the documents in the order of the mix: files in name order hold it from first to last.

    Every document stays; the decision is the order. Places are found for (doc_id, source) and
    joined back; repeated rows of one id, and all rows with a null id, take the first of their places.
    """
    places = mixing.mix(docs, mixing.WEIGHTS).groupBy("doc_id").agg(F.min("position").alias("__vellum_place")).withColumnRenamed("doc_id", "__vellum_id")
    named = docs.join(places, docs["doc_id"] == F.col("__vellum_id")).select(*[docs[c] for c in docs.columns], "__vellum_place")
    if first := places.where("__vellum_id is null").first():  # one row; without a join, null ids aren't one hot key
        named = named.unionByName(docs.where(docs["doc_id"].isNull()).withColumn("__vellum_place", F.lit(first["__vellum_place"])))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["__vellum_place", F.xxhash64("doc_id", "text")]  # rows of one place may fill several files
    return named.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count, token ids, and hashes of ids and of the decoded text, of every document left."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), decoded=False, words_kept=WORDS_KEPT)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode_tokens),
]
#: Stage 1 learns a classifier, which SQL can't express; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each one's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}_{name}")
        docs = spark.read.parquet(f"{folder}/{i}_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
