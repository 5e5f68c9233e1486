"""Export plans, variants, safety flags, licence gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from . import phrases


#: Most platform profiles.
PROFILES = 1000


def platform_plan(clips: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each clip for each platform, and whether it fits the platform's longest duration.

    Profiles are a handful of rows and go with each clip as an array; more than PROFILES are refused.
    """
    rows = profiles.limit(PROFILES + 1).collect()
    if len(rows) > PROFILES:
        raise ValueError(f"more than {PROFILES} platform profiles")
    own = [F.struct(*(F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in profiles.schema.fields)) for r in rows]
    kind = f"array<{profiles.schema.simpleString()}>"
    out = clips.withColumn("_p", F.explode(F.array(*own).cast(kind))).select(*clips.columns, "_p.*")
    return out.withColumn("fits", F.col("duration_ms") <= F.col("max_duration_ms"))


def variants(clips: DataFrame, templates: list[str], hooks: list[str]) -> DataFrame:
    """(clip_id, template_id, hook_id, variant_id): every template with every hook, numbered from 1."""
    all_ = [F.struct(F.lit(t).alias("template_id"), F.lit(h).alias("hook_id"), F.lit(k * len(hooks) + j + 1).cast("long").alias("variant_id")) for k, t in enumerate(templates) for j, h in enumerate(hooks)]
    return clips.select("clip_id", F.explode(F.array(*all_)).alias("v")).select("clip_id", "v.*")


def export_manifest(clips: DataFrame, formats: tuple[str, ...] = ("mp4", "srt", "vtt", "ass")) -> DataFrame:
    """(clip_id, format, path): one row for each file of a clip."""
    return clips.select("clip_id", F.explode(F.array(*map(F.lit, formats))).alias("format")).withColumn("path", F.concat(F.lit("clips/"), F.col("clip_id").cast("string"), F.lit("."), "format"))


#: Most words of a list that is sent to every task.
LISTED = phrases.LISTED


def flags(texts: DataFrame, banned: DataFrame) -> DataFrame:
    """(doc_id, word, hits): banned words and phrases found as whole tokens that follow each other, not as parts of others.

    Entries of one word in a list of up to LISTED entries are broadcast and met without leaving the JVM; phrases go by a
    trie or, in long lists, by their rarest token (operators.phrases).
    """
    listed = phrases.normal(banned)
    single, longer = listed.where(~F.contains("word", F.lit(" "))), listed.where(F.contains("word", F.lit(" ")))
    found = texts.select("doc_id", F.explode(tokens(F.col("text"))).alias("word"))
    if single.limit(LISTED + 1).count() <= LISTED:
        hits = found.join(F.broadcast(single), "word").groupBy("doc_id", "word").agg(F.count("*").alias("hits"))
    else:
        hits = found.groupBy("doc_id", "word").agg(F.count("*").alias("hits")).join(single, "word").select("doc_id", "word", "hits")
    return hits if longer.isEmpty() else hits.unionByName(phrases.find(texts, longer, LISTED))


def licensed(videos: DataFrame) -> DataFrame:
    """Only videos whose licence is recorded."""
    return videos.where(F.col("license_source").isNotNull() & (F.trim("license_source") != ""))


def all_flags(from_list: DataFrame, from_model: DataFrame) -> DataFrame:
    """(doc_id, reason): flags of the word list and of the model's review together, each once."""
    return from_list.select("doc_id", "reason").unionByName(from_model.select("doc_id", "reason")).distinct()


def sentiment(moments: DataFrame, scores: DataFrame) -> DataFrame:
    """(video_id, moment_type, n, mean): mean score of the sentences of each type of moment; sentences without one don't count."""
    rows = moments.join(scores.select("video_id", F.col("sent_idx").alias("moment_id"), F.col("score").alias("feeling")), ["video_id", "moment_id"], "left")
    return rows.groupBy("video_id", "moment_type").agg(F.count("feeling").alias("n"), F.round(F.avg("feeling"), 6).alias("mean"))
