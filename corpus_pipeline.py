"""A corpus from documents to packed token sequences, in five stages.

1. language_id: documents whose language is `und` (no text, or no letter) go, and those that fit no learned language: their
   shortest code is SLACK bits longer than their plain bytes, or more.
2. line_dedup: later copies of runs of three lines or more go; a document of which nothing is left goes too.
3. simhash: of each group of near-duplicates, documents linked by a Jaccard of 0.8 or more of their five-word shingles, the
   document with the least doc_id stays. SimHash links come first; an inverted list finds the pairs beyond its reach.
4. suffix_dedup: strings of PASSAGE bytes that occur more than once go, wherever they stand; a document of which nothing
   is left goes too. Bytes of a character cut in two go with it.
5. packing: token sequences.

Stages take and return the columns of documents (the last one returns pieces of sequences); n_chars follows the text.
Rows that repeat (same doc_id, same text) count as one document from stage 3 on; null doc_ids stay null. A stage on
an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm import line_dedup, near_copies as jaccard, packing, ppm, suffix_dedup
from cliploom.llm.common import keyed, n_stored, stored, sweep
from cliploom.llm.queries import WORD_FILE

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
OTHERS = ("lang", "source")
#: Bytes of a repeated passage; some forty words.
PASSAGE, WINDOW = 200, 80
#: Bits by which the shortest code of a text may be longer than its bytes.
SLACK = 64


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = ppm.language_id(docs, carry=("text", "lang", "source", "n_chars")).where(F.col("lang_pred") != ppm.UNKNOWN)
    return found.where((F.col("rate") - 8) * F.octet_length("text") < SLACK).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(docs, carry=OTHERS).where("kept != '' or n_removed = 0")
    return _documents(kept.withColumnRenamed("kept", "text"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = keyed(docs.select(*COLUMNS))
    first = jaccard.jaccard_groups(docs.select(F.col("key").alias("doc_id"), "text")).select("component_id").distinct()
    kept = docs.join(first, F.col("key") == F.col("component_id"), "left_semi")
    return kept.dropDuplicates(["key"]).select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.suffix_dedup(docs, PASSAGE, WINDOW, carry=OTHERS).where("kept_text != '' or n_removed = 0")
    return _documents(kept.withColumnRenamed("kept_text", "text"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(WORD_FILE))


STAGES = [("language_id", languages), ("line_dedup", lines), ("simhash", near_copies), ("suffix_dedup", passages), ("packing", sequences)]

#: Languages, fingerprints and token ids are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, first = spark.read.parquet(f"{sf_dir}/documents.parquet"), n_stored()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        sweep(spark, first, (docs,))  # what the stage stored on its way, and the stage before
    return STAGES[-1][1](spark, docs, sf_dir)
