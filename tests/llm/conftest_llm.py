import pytest

WORDS = ("the quick brown fox jumps over a lazy dog while seven bright stars shine above quiet northern hills and children sing old songs "
         "beside warm fires until morning brings fresh bread from little bakeries along narrow streets of stone").split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x // 65536 % len(WORDS)] + str(x // 4096 % 9))
    return " ".join(out)


PASSAGE = prose(99, 80) + "."
LONG_LINE = "  This very line is found in many of the documents of the table.\t"

ROWS = [
    (1, prose(1, 60), "en", "a", 1),
    (2, prose(1, 60), "en", "a", 1),
    (3, prose(1, 58) + " two words", "en", "b", 1),
    (4, None, None, None, None),
    (5, "", "en", "a", 0),
    (6, " \n\t ", "en", "a", 4),
    (7, "ok", "en", None, 2),
    (8, prose(8, 30) + ". " + PASSAGE + " " + prose(9, 20), "en", "a", 9),
    (9, prose(10, 25) + ". " + PASSAGE + " " + prose(11, 30), None, "c", 9),
    (10, "Ünïcödé   漢字 " + prose(12, 15) + "\n" + LONG_LINE, "de", "a", 3),
    (11, LONG_LINE.upper() + "\nrest eleven", "de", "a", 3),
    (12, LONG_LINE + "\nrest twelve\n" + LONG_LINE.strip(), "de", "a", 3),
    (13, "rest\n" + LONG_LINE, "de", "a", 3),
    (14, LONG_LINE, "de", "a", 3),
    (14, LONG_LINE, "de", "a", 3),
    (15, "x" * 5000 + " " + "ab " * 9000, "fr", "a", 5),
    (16, prose(16, 6000), "fr", "a", 5),
    (None, prose(17, 30), "fr", "a", 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = "row id keys n key batch body shard score held_out length piece rank slice digest rep component_id kept text_a a b line_dedup n_lines bucket".split()
    return docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder(spark, docs, tmp_path_factory):
    """A folder of tables as the queries read them."""
    top = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1, 0), (2, 1), (8, None), (None, 1), (9, 0), (9, 0)], "doc_id long, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, "the quick"), (5, prose(55, 40))], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
