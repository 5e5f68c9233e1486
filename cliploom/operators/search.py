"""Full-text search over a stored index.

The index is two Parquet tables: postings (token, doc_id, tf, positions), ordered by token and document over its files, and
lengths (doc_id, len). The statistics of the files lead a search to the row groups that hold its words, so texts are
tokenized once, when the index is written, and never again. Columns named in `by` (a speaker, say) stand in the postings
beside doc_id and order them before it, so that a search within one value reads its row groups only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as texts
from ..functions.text import tokens
from ..session import ensure_importable
from ..storage import discard, stored

#: Tokens counted at once.
TOKENS = 1 << 20
#: Fixed values of the ranking formula.
K1, B = 1.2, 0.75


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tokens, *columns) of documents to (token, *columns, tf, positions), a row for each token of a document; TOKENS tokens or one document at once."""
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto, done = np.cumsum(sizes), 0
        while done < len(sizes):
            stop = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + TOKENS, "right")))
            part, n = batch.slice(done, stop - done), sizes[done:stop]
            words = part.column(0).flatten().dictionary_encode()
            code, doc = words.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n)
            pos = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            order = np.lexsort((pos, code, doc))
            code, doc, pos = code[order], doc[order], pos[order].astype(np.int32)
            first = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])))) if len(doc) else np.zeros(0, np.int64)
            bounds = np.append(first, len(doc)).astype(np.int32)
            columns = [words.dictionary.take(pa.array(code[first])), *(c.take(pa.array(doc[first])) for c in part.columns[1:])]
            out = [*columns, pa.array(np.diff(bounds).astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(pos))]
            yield pa.RecordBatch.from_arrays(out, ["token", *part.schema.names[1:], "tf", "positions"])
            done = stop


def postings(docs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(token, *by, doc_id, tf, positions) of docs (doc_id, text, *by); positions from 0, ascending.

    A document's tokens are counted where it is read, without a shuffle. Rows that share an id (and `by`) are one document:
    such ids are looked for first, and only their tokens are grouped over tasks.
    """
    keys = (*by, "doc_id")
    ensure_importable(docs.sparkSession)
    kinds = "".join(f", `{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    count = lambda rows: rows.select(tokens(F.col("text")).alias("tokens"), *keys).mapInArrow(_counted, f"token string{kinds}, tf long, positions array<int>")
    twice = stored(docs.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*(F.col(k).alias(f"_{k}") for k in keys)), "repeated-ids")
    if twice.isEmpty():
        discard(twice)
        return count(docs)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    rows = docs.join(twice, same, "left_semi").select(*keys, F.posexplode(tokens(F.col("text"))).alias("pos", "token"))
    merged = rows.groupBy("token", *keys).agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
    return count(docs.join(twice, same, "left_anti")).union(merged)


def lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, len): tokens of each document."""
    return docs.select("doc_id", F.size(tokens(F.col("text"))).alias("len"))


def write_index(docs: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """The postings are stored before they are dealt by ranges, which looks at its input twice: texts are tokenized once."""
    own, order = stored(postings(docs, by), "postings"), ("token", *by, "doc_id")
    own.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/postings")
    discard(own)
    lengths(docs).write.mode("overwrite").parquet(f"{path}/lengths")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")


def match_any(index: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, hits): documents with any of the words."""
    return index.where(F.col("token").isin(words)).groupBy("doc_id").agg(F.sum("tf").alias("hits"))


def match_all(index: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, hits): documents with all of the words."""
    found = index.where(F.col("token").isin(words)).groupBy("doc_id").agg(F.sum("tf").alias("hits"), F.count("*").alias("n"))
    return found.where(F.col("n") == len(set(words))).drop("n")


def phrase(index: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, start): places where the words follow each other.

    Each posting of the k-th word votes for the place k before it; a place with all votes begins the phrase. No self-join.
    """
    votes = F.array(*(F.when(F.col("token") == w, F.lit(k)) for k, w in enumerate(words)))
    hits = index.where(F.col("token").isin(words)).select("doc_id", "positions", F.explode(F.filter(votes, lambda x: x.isNotNull())).alias("k"))
    places = hits.select("doc_id", "k", F.explode("positions").alias("pos"))
    starts = places.groupBy("doc_id", (F.col("pos") - F.col("k")).alias("start")).agg(F.count("*").alias("n"))
    return starts.where(F.col("n") == len(words)).select("doc_id", F.col("start").cast("long").alias("start"))


def ranked(index: DataFrame, sizes: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, score): BM25 of documents with any of the words, rounded to 6 places. Only postings of the words are read."""
    hits = index.where(F.col("token").isin(words))
    tfs = hits.groupBy("doc_id").agg(*(F.coalesce(F.sum(F.when(F.col("token") == w, F.col("tf"))), F.lit(0)).alias(f"tf{k}") for k, w in enumerate(words)))
    rows = tfs.join(sizes, "doc_id")
    dfs = hits.agg(*(F.count_if(F.col("token") == w).alias(f"df{k}") for k, w in enumerate(words)))
    stats = sizes.agg(F.count("*").alias("n"), F.avg("len").alias("mean")).crossJoin(dfs)
    rows = rows.crossJoin(F.broadcast(stats))  # stats is one row
    score = F.lit(0.0)
    for k in range(len(words)):
        tf, df = F.col(f"tf{k}").cast("double"), F.col(f"df{k}").cast("double")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return rows.select("doc_id", F.round(score, 6).alias("score"))


def frequencies(index: DataFrame) -> DataFrame:
    """(token, cf, df): how often a token occurs, and in how many documents."""
    return index.groupBy("token").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


def importance(index: DataFrame, sizes: DataFrame) -> DataFrame:
    """(token, cf, df, importance): occurrences weighed by rarity, cf * ln((n + 1) / (df + 1)), rounded to 6 places."""
    n = sizes.agg(F.count("*").alias("n"))  # one row
    rows = frequencies(index).crossJoin(F.broadcast(n))
    return rows.select("token", "cf", "df", F.round(F.col("cf") * F.log((F.col("n") + 1) / (F.col("df") + 1)), 6).alias("importance"))


def windows(index: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, start, width): for each document with all of the words the shortest run of positions that holds them, of equal ones the first.

    Positions of the words are merged in order; at each the latest place of every word so far is known, and the run from
    the earliest of these to here is the shortest that ends here.
    """
    words = list(dict.fromkeys(words))
    hits = index.where(F.col("token").isin(words)).select("doc_id", "token", F.explode("positions").alias("pos"))
    so_far = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    places = [F.last(F.when(F.col("token") == w, F.col("pos")), ignorenulls=True).over(so_far) for w in words]
    met = hits.select("doc_id", "pos", *(c.alias(f"p{k}") for k, c in enumerate(places))).dropna()
    start = F.least(*(f"p{k}" for k in range(len(words)))) if len(words) > 1 else F.col("p0")
    runs = met.select("doc_id", start.alias("start"), (F.col("pos") - start + 1).alias("width"))
    best = runs.groupBy("doc_id").agg(F.min(F.struct("width", "start")).alias("b"))
    return best.select("doc_id", F.col("b.start").cast("long").alias("start"), F.col("b.width").cast("long").alias("width"))


def passages(index: DataFrame, sizes: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, start, width, score): shortest runs with a score: the words' rarity, times the share of the run that they fill; 6 places."""
    words = list(dict.fromkeys(words))
    dfs = index.where(F.col("token").isin(words)).groupBy("token").agg(F.count("*").alias("df"))
    n = sizes.agg(F.count("*").alias("n"))  # one row
    rarity = dfs.crossJoin(F.broadcast(n)).agg(F.sum(F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("rarity"))  # one row for each word, then one
    rows = windows(index, words).crossJoin(F.broadcast(rarity))
    return rows.select("doc_id", "start", "width", F.round(F.col("rarity") * len(words) / F.col("width"), 6).alias("score"))


def snippets(docs: DataFrame, found: DataFrame, words: list[str], around: int = 5, marks: tuple[str, str] = ("<b>", "</b>")) -> DataFrame:
    """found (doc_id, start, width, ...) with snippet: the run with `around` tokens on either side as the text has them, words marked.

    Only documents found are read again; spelling, signs and diacritics of the text stay. An ellipsis stands where text is left out.
    """
    words = list(dict.fromkeys(words))
    rows = found.join(docs.select("doc_id", "text"), "doc_id")
    rows = rows.withColumns({"_pieces": texts.pieces(F.col("text")), "_tokens": tokens(F.col("text"))}).drop("text")
    begin, n = F.greatest(F.col("start") - around, F.lit(0)), F.size("_pieces")
    end = F.least(F.col("start") + F.col("width") + around, n)
    mark = lambda piece: F.regexp_replace(piece, texts.LAST_TOKEN, f"{marks[0]}$1{marks[1]}")
    shown = F.zip_with(F.slice("_pieces", begin + 1, end - begin), F.slice("_tokens", begin + 1, end - begin), lambda piece, token: F.when(token.isin(words), mark(piece)).otherwise(piece))
    body = F.trim(F.array_join(shown, ""))
    snippet = F.concat(F.when(begin > 0, "… ").otherwise(""), body, F.when(end < n, " …").otherwise(""))
    return rows.withColumn("snippet", snippet).drop("_pieces", "_tokens")
