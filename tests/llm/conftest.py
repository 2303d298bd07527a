"""Odd documents that every operator must take."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, _n string, bucket string, h string, id string"


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n))


def odd_documents():
    base = words(1, 300)
    texts = [
        (1, base), (2, base), (3, base + " one more"), (4, None), (5, ""), (6, " \n\t "), (7, "###"), (8, "a b"), (9, "A B"), (10, "Ünïcödé 你好 😀 Ⅷ İΣΣ"),
        (11, words(2, 30000)), (12, "x" * 50000), (13, base.replace(" ", "\n")), (14, "<|endoftext|> All rights reserved. <s>"), (15, words(3, 200)), (None, base),
    ]
    rows = [(i, t, None if i == 15 else "en" if (i or 0) % 2 else "fr", None if i == 3 else "hot" if (i or 0) < 12 else "s", None, "x", "y", "z", "w", "v") for i, t in texts]
    return rows + [rows[0]]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
