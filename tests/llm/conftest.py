import pytest

LONG = "Lorem ipsum-dolor été 7 " * 15_000
COPIED = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
# Columns whose names the operators use for their own ones.
EXTRA = ("row", "term", "pos", "keys", "size", "taken", "text_key", "score", "words", "bucket", "matches")
ODD_ROWS = [
    (1, "Some text with a few words in it.\nA line that is long enough to count.", "a"),
    (2, None, "a"),
    (3, "", None),
    (4, " \t\n ", "b"),
    (None, "Some text with a few words in it.", "b"),
    (6, LONG, "b"),
    (7, f"before it {COPIED} and after", "c"),
    (7, f"before it {COPIED} and after", "c"),
    (8, "A line that is long enough to count.\n a LINE that is long enough to count. \nshort", "c"),
    (9, "\r\na line that is long enough to count.\n\n", "c"),
    (10, "<|im_end|> \\e \\c <|endoftext|> ünïcödé 𝔘 end", "c"),
]


def with_extra(spark, rows):
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in EXTRA)
    return spark.createDataFrame(
        [(doc_id, text, "en", source, None, *EXTRA) for doc_id, text, source in rows], columns
    )


@pytest.fixture(scope="session")
def odd(spark):
    return with_extra(spark, ODD_ROWS)


@pytest.fixture(scope="session")
def none(spark):
    return with_extra(spark, [])


@pytest.fixture(scope="session")
def texts(spark, sf_dir):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
