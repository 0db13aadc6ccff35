"""Small tables with every odd case, and brute-force helpers."""

import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"wort{i % 613}x{i}" for i in range(20_000))
BASE = " ".join(f"alpha{i} beta{i % 7}" for i in range(60))

ODD = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \n\t ", None, "a", 4),
    (4, "one two", "en", None, 7),
    (5, BASE, "en", "a", len(BASE)),
    (6, BASE, "de", "b", len(BASE)),
    (7, BASE + " gamma", "en", "a", len(BASE) + 6),
    (8, BASE.replace("alpha30", "omega"), "en", "a", len(BASE)),
    (9, "Ünïcödé ß straße 日本語 " * 30, None, None, 1),
    (10, "same line\n" * 40, "en", "a", 400),
    (11, LONG, "en", "a", len(LONG)),
    (12, "a" * 3000, "en", "a", 3000),
    (12, "a" * 3000, "en", "a", 3000),
    (13, "x" * 450 + "q" + BASE, "en", "a", 1),
    (14, "tail " + "x" * 450, "en", "a", 1),
    (None, "no id here but five words", "en", "a", 25),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHING = ("score", "kept", "hash", "size", "label", "node", "digest", "start", "length", "values", "ids", "bucket", "rows",
            "id", "rate", "weight", "rule_lang", "rule_max_symbol_ratio", "_id", "_dg", "own", "of_id", "of_digest", "marked", "spans", "predicted", "bits")


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
