import os
import random

import pytest

SMALL = "/root/testdata/sf0.001"
CLASHING = "key string, v long, term string, pos int, shard int, slot long, epoch int, rank int, label long, size int"


@pytest.fixture(scope="session")
def small_dir():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    return SMALL


@pytest.fixture(scope="session")
def small_docs(spark, small_dir):
    return spark.read.parquet(f"{small_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd_rows():
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "delta", "épée", "naïve", "zwölf", "x1", "you", "idiot", "###", "a.b"]
    long_text = " ".join(rng.choice(words) for _ in range(30_000))
    same = " ".join(rng.choice(words) for _ in range(150))
    return [(1, None, "en", "src1", 0), (2, "", "de", "src2", 0), (3, " \t\n ", None, None, None),
            (4, "one", "en", "src0", 3), (5, long_text, "en", "src0", len(long_text)),
            (6, same, "en", "src0", 1), (7, same, "fr", None, 1), (7, same, "fr", None, 1), (7, "another text", "fr", "src3", 1),
            (None, same, "en", "src0", None), (None, None, None, None, None), (8, same + " more", "en", "src9", 2),
            (9, "tail\n" * 60, "es", "src1", 2), (10, "#$% &&& ||| ### *** <<>>", "es", "src1", 2),
            (11, "ÀÉÎ Straße 数据 😀 end\x00nul\x0bvt", "fr", "src2", 9)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """Nulls, empty and long texts, ties, repeated rows, and columns named like the operators' own."""
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
    return spark.createDataFrame([(*r, "k", 1, "t", 0, 0, 0, 0, 0, 0, 0) for r in odd_rows], schema)


@pytest.fixture(scope="session")
def empty_docs(odd_docs):
    return odd_docs.where("false")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def plain_rows():
    return texts_of
