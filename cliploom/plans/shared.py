"""The search indexes that queries share: written at the first search, and again once the table behind them has changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search
from ..sources import standins as S
from ..sources.files import media_files
from ..storage import delete, fresh_folder

#: (application, name, folder of tables) to the state of the table's files when the index was written, and where it is.
_indexes: dict[tuple[str, str, str], tuple[tuple, str]] = {}


def state_of(spark: SparkSession, path: str) -> tuple:
    """Number, bytes and a sum over names, sizes and times of the files under path; files are listed, not read."""
    mark = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    return tuple(media_files(spark, path).agg(F.count("*"), F.sum("length"), F.sum(mark)).first())


def _index(spark: SparkSession, sf_dir: str, name: str, table: str, docs: DataFrame, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    key, now = (spark.sparkContext.applicationId, name, sf_dir), state_of(spark, f"{sf_dir}/{table}.parquet")
    before = _indexes.get(key)
    if before is None or before[0] != now:
        path = fresh_folder(spark, "index")
        search.write_index(docs, path, by)
        _indexes[key] = (now, path)
        if before is not None:
            delete(spark, before[1])
    return search.read_index(spark, _indexes[key][1])


def library_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Postings and lengths of all documents."""
    return _index(spark, sf_dir, "library", "documents", S.docs(spark, sf_dir))


def sentence_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Postings and lengths of all sentences, by speaker; doc_id is (video_id, sent_idx)."""
    docs = S.sentences(spark, sf_dir).select(F.struct("video_id", "sent_idx").alias("doc_id"), "speaker", "text")
    return _index(spark, sf_dir, "sentences", "conversations", docs, ("speaker",))
