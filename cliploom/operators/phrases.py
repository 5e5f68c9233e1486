"""Listed phrases of any number of words, found in texts in one pass.

A list of up to LISTED words becomes a trie of tokens whose nodes carry failure links (Aho and Corasick, 1975): one table for
every task, one step for each token of a text, whatever the number of phrases. Longer lists are never sent: a phrase meets
texts by the token of it that fewest documents hold, and the rest of it is compared at that place.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import ensure_importable

#: Most words of a list that is sent to every task.
LISTED = 100_000


class Trie:
    """Tokens to phrases: `steps` of each node by token, its failure link, and the phrases that end at it or at a shorter end."""

    def __init__(self, phrases: list[list[str]]) -> None:
        self.steps: list[dict[str, int]] = [{}]
        self.fail, self.ends = [0], [[]]
        for k, words in enumerate(phrases):
            at = 0
            for word in words:
                if word not in self.steps[at]:
                    self.steps[at][word] = len(self.steps)
                    self.steps.append({})
                    self.fail.append(0)
                    self.ends.append([])
                at = self.steps[at][word]
            if words:
                self.ends[at].append(k)
        waiting = deque(self.steps[0].values())
        while waiting:
            at = waiting.popleft()
            for word, child in self.steps[at].items():
                self.fail[child] = self.follow(self.fail[at], word)
                self.ends[child] = self.ends[child] + self.ends[self.fail[child]]
                waiting.append(child)

    def follow(self, at: int, word: str) -> int:
        """The node of the longest beginning of a phrase that the tokens so far end with."""
        while word not in self.steps[at]:
            if not at:
                return 0
            at = self.fail[at]
        return self.steps[at][word]

    def count(self, words: list[str]) -> dict[int, int]:
        """Phrases in a text, with how often each occurs; occurrences may overlap."""
        found: dict[int, int] = {}
        at = 0
        for word in words:
            at = self.follow(at, word)
            for k in self.ends[at]:
                found[k] = found.get(k, 0) + 1
        return found


def _counted(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = sent.value
        trie, names = Trie([p.split(" ") for p in phrases]), phrases
        for batch in batches:
            rows, words, hits = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for phrase, n in trie.count(text or []).items():
                    rows.append(k)
                    words.append(names[phrase])
                    hits.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(words, pa.string()), pa.array(hits, pa.int64())], ["doc_id", "word", "hits"])

    return run


def normal(phrases: DataFrame) -> DataFrame:
    """(word): the distinct phrases of column `word` as tokens with a space between; those without a token are left out."""
    return phrases.select(F.array_join(tokens(F.col("word")), " ").alias("word")).where("word != ''").distinct()


def by_trie(texts: DataFrame, listed: DataFrame) -> DataFrame:
    """(doc_id, word, hits) with one trie in every task; `listed` holds normal phrases of LISTED words in all, at most."""
    spark = texts.sparkSession
    ensure_importable(spark)
    sent = spark.sparkContext.broadcast(sorted(r.word for r in listed.select("word").collect()))
    rows = texts.select("doc_id", tokens(F.col("text")).alias("tokens"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_counted(sent), f"doc_id {kind}, word string, hits long")


def by_rarest_token(texts: DataFrame, listed: DataFrame) -> DataFrame:
    """(doc_id, word, hits) for lists of any length: phrases meet texts by their rarest token.

    Documents are counted for each token of the list only. A token in no document ends its phrases; equal counts go by the
    first place. Texts that a phrase meets are read once more to compare the rest.
    """
    placed = listed.select("word", F.posexplode(F.split("word", " ")).alias("at", "token"))
    held = texts.select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "token"))
    df = held.select("doc_id", "token").distinct().join(placed.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    rarest = placed.join(df, "token").groupBy("word").agg(F.min(F.struct("df", "at", "token")).alias("r"), F.count("*").alias("found"))
    rarest = rarest.where(F.col("found") == F.size(F.split("word", " "))).select("word", F.col("r.at").alias("at"), F.col("r.token").alias("token"))
    met = held.join(rarest, "token").where("pos >= at").select("doc_id", "word", (F.col("pos") - F.col("at")).alias("start"))
    single = met.where(~F.contains("word", F.lit(" ")))
    longer = met.where(F.contains("word", F.lit(" "))).join(texts.select("doc_id", tokens(F.col("text")).alias("tokens")), "doc_id")
    longer = longer.where(F.array_join(F.slice("tokens", F.col("start") + 1, F.size(F.split("word", " "))), " ") == F.col("word"))
    return single.select("doc_id", "word").union(longer.select("doc_id", "word")).groupBy("doc_id", "word").agg(F.count("*").alias("hits"))


def find(texts: DataFrame, phrases: DataFrame, most: int = LISTED) -> DataFrame:
    """(doc_id, word, hits): phrases (word) that occur in texts (doc_id, text) as whole tokens that follow each other.

    Case and diacritics don't matter; occurrences that overlap all count. Lists of up to `most` words go by a trie, longer
    ones by joins; the result is the same.
    """
    listed = normal(phrases)
    words = listed.agg(F.sum(F.size(F.split("word", " ")))).first()[0] or 0
    return by_trie(texts, listed) if words <= most else by_rarest_token(texts, listed)
