"""Sentences that stand out from their own video by what they say, not by listed words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

#: Standard deviations above its video's mean from which a sentence is surprising.
LIMIT = 1.5


def information(sentences: DataFrame) -> DataFrame:
    """(video_id, sent_idx, information): mean of ln(all tokens / those like it) over a sentence's tokens, counted over the whole library; 0 without tokens.

    Tokens are counted within their sentence before they meet the library's counts, so a frequent word is shuffled once a sentence.
    """
    rows = sentences.select("video_id", "sent_idx", F.explode(tokens(F.col("text"))).alias("token")).groupBy("video_id", "sent_idx", "token").agg(F.count("*").alias("n"))
    library = rows.groupBy("token").agg(F.sum("n").alias("cf"))
    total = library.agg(F.sum("cf")).first()[0] or 0
    met = rows.join(library, "token").groupBy("video_id", "sent_idx").agg((F.sum(F.col("n") * F.log(F.lit(float(total)) / F.col("cf"))) / F.sum("n")).alias("information"))
    return sentences.select("video_id", "sent_idx").join(met, ["video_id", "sent_idx"], "left").na.fill(0.0, ["information"])


def surprising(sentences: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(video_id, sent_idx, surprise): sentences whose information is `limit` standard deviations or more above the mean of their video, rounded to 6 places.

    A video whose sentences all say as much has none.
    """
    rows = information(sentences)
    usual = rows.groupBy("video_id").agg(F.avg("information").alias("mean"), F.stddev_pop("information").alias("spread"))
    found = rows.join(usual, "video_id").where("spread > 1e-9").withColumn("surprise", F.round((F.col("information") - F.col("mean")) / F.col("spread"), 6))
    return found.where(F.col("surprise") >= limit).select("video_id", "sent_idx", "surprise")
