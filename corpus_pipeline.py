"""A training corpus from raw documents, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns all that it keeps; every stage but the
last returns the columns of ``docs``.

1. toxicity: documents scored at or above the threshold go.
2. line dedup: repeated lines leave the texts (``n_chars`` stays as it was given).
3. SimHash near-dedup: one document of each group stays.
4. benchmark decontamination: contaminated documents go.
5. mixing: a row for each pass of the mix over a document, sorted by training position, with
   ``size``, ``source_size``, ``target``, ``taken``, ``pass``, ``words`` and ``position``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens.llm import decontamination, line_dedup, mixing, simhash, toxicity
from foliolens.llm.common import stored
from foliolens.llm.queries import held_out
from foliolens.sources.tables import scan_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = scan_table(spark, sf_dir, "labels")
    return toxicity.accepted(docs, labels.filter(~held_out(F.col("doc_id"))))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, scan_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.training_order(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
]

# A fitted model and 64-bit shingle hashes have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored before the next stage reads it."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    docs = scan_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
