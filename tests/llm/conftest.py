import pytest

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum " * 20_000
ODD = [
    (1, None, "en", None, None),
    (2, "", "en", "src0", 0),
    (3, None, None, "src0", 4),
    (4, "same text of eight words that repeats here", "en", "src0", 1),
    (5, "same text of eight words that repeats here", "en", "src1", 1),
    (5, "same text of eight words that repeats here", "en", "src1", 1),
    (6, LONG, "en", "src1", 2),
    (7, "é漢字😀\t\x0b x y z \n\n a", "zh", "src2", 3),
    (8, "a" * 5000, "en", "src2", 3),
    (9, " \n\t ", "en", "src2", 3),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    return [(r[0], r[1] or "") for r in ODD]


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, odd):
    """The same rows with columns whose names operators use inside."""
    from pyspark.sql import functions as F

    names = ["id", "digest", "n", "f0", "tile", "key", "rh", "a", "th", "spans", "keep_id", "kept", "host", "length", "piece", "component", "rep", "side", "component_id", "sequence_id"]
    return odd.select("*", *(F.lit("clash").alias(n) for n in names))


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def doc_rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
