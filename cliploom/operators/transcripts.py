"""Words, sentences and whole transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_words(transcripts: DataFrame) -> DataFrame:
    """WORDS of nested TRANSCRIPTS."""
    s = transcripts.select("video_id", F.explode("sentences").alias("s"))
    w = s.select("video_id", F.col("s.sent_idx").alias("sent_idx"), F.posexplode("s.words").alias("word_idx", "w"))
    return w.select("video_id", "sent_idx", "word_idx", "w.start_ms", "w.end_ms", "w.word")


def assemble(words: DataFrame) -> DataFrame:
    """Sentences of words: ordered text, first start, last end."""
    listed = words.groupBy("video_id", "sent_idx", "speaker").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.array_sort(F.collect_list(F.struct("word_idx", "word"))).alias("w"))
    return listed.select("video_id", "sent_idx", "speaker", "start_ms", "end_ms", F.array_join(F.col("w.word"), " ").alias("text"))


def nest(words: DataFrame) -> DataFrame:
    """(video_id, sentences): the nested form, words within sentences, both in order."""
    w = F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "word", "start_ms", "end_ms"))), lambda x: F.struct(x["word"].alias("word"), x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms")))
    s = words.groupBy("video_id", "sent_idx").agg(w.alias("words"))
    s = s.withColumn("s", F.struct(F.col("sent_idx").cast("int").alias("sent_idx"), F.array_min("words.start_ms").alias("start_ms"), F.array_max("words.end_ms").alias("end_ms"), F.array_join("words.word", " ").alias("text"), "words"))
    s = s.groupBy("video_id").agg(F.array_sort(F.collect_list("s"), lambda a, b: a["sent_idx"] - b["sent_idx"]).alias("sentences"))
    return s.select("video_id", F.array_join("sentences.text", " ").alias("full_text"), "sentences")


def full_text(sentences: DataFrame) -> DataFrame:
    """(video_id, full_text, n_sentences)."""
    listed = sentences.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("sent_idx", "text"))).alias("s"), F.count("*").alias("n_sentences"))
    return listed.select("video_id", F.array_join(F.col("s.text"), " ").alias("full_text"), "n_sentences")


def bilingual(sentences: DataFrame, translations: DataFrame, lang: str) -> DataFrame:
    """Sentences with their translation, times kept; null where there is none."""
    t = translations.where(F.col("lang") == lang).select("video_id", "sent_idx", F.col("text").alias("translated"))
    return sentences.join(t, ["video_id", "sent_idx"], "left")


def speaking_time(sentences: DataFrame) -> DataFrame:
    """(video_id, speaker, spoken_ms, n_sentences)."""
    return sentences.groupBy("video_id", "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("spoken_ms"), F.count("*").alias("n_sentences"))
