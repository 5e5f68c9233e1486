"""Transcripts, captions, time operators and search over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import captions, intervals, ordering, planning, ranking, scheduling, search, silence
from ..operators import transcripts as T
from ..sources import standins as S
from .shared import library_index, sentence_index

WORDS, SENT = f"WITH {S.WORDS}", f"WITH {S.WORDS}, {S.SENTENCES}"
HOOK_MS, PART_MS, MOMENTS, AROUND_MS = 15_000, 60_000, 3, 20_000


def explode_words(spark: SparkSession, d: str) -> DataFrame:
    """Words nested into transcripts and taken out again."""
    return T.explode_words(T.nest(S.words(spark, d))).select("video_id", F.col("sent_idx").cast("long"), F.col("word_idx").cast("long"), "start_ms", "end_ms", "word")


def sentence_assemble(spark: SparkSession, d: str) -> DataFrame:
    return S.sentences(spark, d)


def transcript_fulltext(spark: SparkSession, d: str) -> DataFrame:
    return T.full_text(S.sentences(spark, d))


def transcript_view(spark: SparkSession, d: str) -> DataFrame:
    return S.sentences(spark, d).select("video_id", "start_ms", "speaker", "text").orderBy("video_id", "start_ms")


def bilingual_captions(spark: SparkSession, d: str) -> DataFrame:
    """Marked text stands in for a translation; system messages have none."""
    s = S.sentences(spark, d)
    t = s.where("speaker != 'system'").select("video_id", "sent_idx", F.lit("ar").alias("lang"), F.concat(F.lit("[ar] "), "text").alias("text"))
    return T.bilingual(s.select("video_id", "sent_idx", "start_ms", "end_ms", "text"), t, "ar")


def speaker_time(spark: SparkSession, d: str) -> DataFrame:
    return T.speaking_time(S.sentences(spark, d))


def speaker_number(spark: SparkSession, d: str) -> DataFrame:
    return ordering.numbered_speakers(S.sentences(spark, d))


def clip_cut(spark: SparkSession, d: str) -> DataFrame:
    return silence.cut(S.words(spark, d), 5_000, 35_000).select("video_id", "sent_idx", "word_idx", "start_ms", "end_ms", "word")


def hook_text_window(spark: SparkSession, d: str) -> DataFrame:
    first = S.words(spark, d).where(F.col("start_ms") < HOOK_MS)
    return captions.joined(first, F.col("word"), " ", ("sent_idx", "word_idx")).withColumnRenamed("body", "hook")


def clip_words(spark: SparkSession, d: str) -> DataFrame:
    """A clip for every question, with a second before and after it."""
    clips = S.moments(spark, d).where("moment_type = 'question'").select("video_id", (F.col("video_id") * 1000 + F.col("moment_id")).alias("clip_id"), (F.col("start_ms") - 1000).alias("start_ms"), (F.col("end_ms") + 1000).alias("end_ms"))
    return silence.clip_words(S.words(spark, d), clips, 60_000)


def silence_gaps(spark: SparkSession, d: str) -> DataFrame:
    return silence.gaps(S.words(spark, d))


def speech_runs(spark: SparkSession, d: str) -> DataFrame:
    return silence.runs(S.words(spark, d))


def silence_retime(spark: SparkSession, d: str) -> DataFrame:
    return silence.retime(S.words(spark, d)).select("video_id", "sent_idx", "word_idx", "new_start", "new_end")


def idea_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = ordering.parts(S.sentences(spark, d), ["video_id"], ["start_ms", "sent_idx"], F.col("end_ms") - F.col("start_ms"), PART_MS)
    return rows.select("video_id", "sent_idx", "part", "n_parts", F.concat(F.lit("Part "), F.col("part").cast("string"), F.lit("/"), F.col("n_parts").cast("string")).alias("label"))


def top_moments(spark: SparkSession, d: str) -> DataFrame:
    return ordering.top(S.moments(spark, d), ["video_id"], [F.col("score").desc(), F.col("start_ms"), F.col("moment_id")], MOMENTS)


def _wide_moments(spark: SparkSession, d: str) -> DataFrame:
    """Moments with AROUND_MS on either side, so that they overlap."""
    return S.moments(spark, d).withColumns({"start_ms": F.col("start_ms") - AROUND_MS, "end_ms": F.col("end_ms") + AROUND_MS})


def best_moments(spark: SparkSession, d: str) -> DataFrame:
    return scheduling.best_apart(_wide_moments(spark, d), MOMENTS)


def moment_ranks(spark: SparkSession, d: str) -> DataFrame:
    """All moments of the library by score, in ten classes."""
    return ranking.ranks(S.moments(spark, d).select("video_id", "moment_id", "score"), "score", ["video_id", "moment_id"], 10, descending=True)


def ideas_per_video(spark: SparkSession, d: str) -> DataFrame:
    n = S.moments(spark, d).groupBy("video_id").agg(F.count("*").alias("n_ideas"), F.count_distinct("moment_type").alias("n_types"))
    return n.withColumn("too_few", F.col("n_ideas") < 5)


def srt_export(spark: SparkSession, d: str) -> DataFrame:
    return captions.srt(S.sentences(spark, d))


def vtt_export(spark: SparkSession, d: str) -> DataFrame:
    return captions.vtt(S.sentences(spark, d))


def ass_karaoke(spark: SparkSession, d: str) -> DataFrame:
    return captions.ass_events(captions.karaoke_lines(S.words(spark, d))).select("video_id", "sent_idx", "event")


def assign_speaker(spark: SparkSession, d: str) -> DataFrame:
    return intervals.assign_largest(S.spans(spark, d, "click", 2), S.spans(spark, d, "view", 6), "video_id", "event_id", "speaker")


def active_speaker(spark: SparkSession, d: str) -> DataFrame:
    return intervals.covering(S.frames(spark, d), S.spans(spark, d, "view", 6), "video_id", "event_id", "speaker")


def asof_latest(spark: SparkSession, d: str) -> DataFrame:
    return intervals.asof(S.frames(spark, d), S.spans(spark, d, "view", 6), "video_id", "event_id", "speaker")


def face_smooth(spark: SparkSession, d: str) -> DataFrame:
    f = S.frames(spark, d)
    return f.select("event_id", "video_id", F.round(ordering.smooth(f, "video_id", ["ts_ms", "event_id"], "cx", 2), 6).alias("cx_smooth"))


def best_frame(spark: SparkSession, d: str) -> DataFrame:
    best = F.max_by("event_id", F.struct("cx", -F.col("event_id")))
    return S.frames(spark, d).groupBy("video_id").agg(best.alias("event_id"), F.max("cx").alias("cx"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return S.read(spark, d, "part").select(F.col("p_partkey").alias("video_id"), (F.col("p_size") * 64 + 320).cast("long").alias("width"), (F.col("p_partkey") % 30 * 48 + 240).alias("height"))


def crop_box(spark: SparkSession, d: str) -> DataFrame:
    v = _sizes(spark, d)
    return v.select("video_id", "width", "height", geometry.crop_box(F.col("width"), F.col("height")).alias("b")).select("video_id", "width", "height", "b.*")


def crop_follow(spark: SparkSession, d: str) -> DataFrame:
    v = _sizes(spark, d).withColumn("cx", (F.col("video_id") * 37 % F.col("width"))).withColumn("cy", (F.col("video_id") * 53 % F.col("height")))
    return v.select("video_id", "cx", "cy", geometry.crop_follow(F.col("cx"), F.col("cy"), F.col("width"), F.col("height")).alias("b")).select("video_id", "cx", "cy", "b.*")


def url_valid(spark: SparkSession, d: str) -> DataFrame:
    return S.read(spark, d, "pages").select("page_id", text.is_url(F.col("url")).alias("valid"))


def detect_questions(spark: SparkSession, d: str) -> DataFrame:
    """No text has a question mark; every fourth turn gets an Arabic one."""
    t = S.read(spark, d, "conversations").withColumn("text", F.when(F.col("turn") % 4 == 1, F.concat("text", F.lit("؟"))).otherwise(F.col("text")))
    return t.where(text.is_question(F.col("text"))).select("conv_id", "turn", "text")


def surprising_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth turn gets an Arabic word of surprise."""
    t = S.read(spark, d, "conversations").withColumn("text", F.when(F.col("turn") % 5 == 1, F.concat("text", F.lit(" فجأة"))).otherwise(F.col("text")))
    return t.where(text.is_surprising(F.col("text"))).select("conv_id", "turn")


def arabic_fold(spark: SparkSession, d: str) -> DataFrame:
    """Texts marked with diacritics after every e, then folded."""
    marked = F.replace(F.col("text"), F.lit("e"), F.lit("مَـّ"))
    return S.read(spark, d, "conversations").select("conv_id", "turn", text.arabic_fold(marked).alias("folded"))


def hashtags(spark: SparkSession, d: str) -> DataFrame:
    """The first five of each turn, as a post shows a handful: a limit of this query, text.hashtags has none."""
    return S.read(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.slice(text.hashtags(text.tokens(F.col("text"))), 1, 5), " ").alias("hashtags"))


def json_stage(spark: SparkSession, d: str) -> DataFrame:
    return S.read(spark, d, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


def docs_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return S.docs(spark, d).groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("letters"))


def word_freq(spark: SparkSession, d: str) -> DataFrame:
    words = S.docs(spark, d).select(F.explode(text.tokens(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n"))


def safety_flags(spark: SparkSession, d: str) -> DataFrame:
    banned = spark.createDataFrame([("idiot",), ("scum",), ("trash",), ("loser",)], "word string")
    return planning.flags(S.docs(spark, d), banned)


def phrase_flags(spark: SparkSession, d: str) -> DataFrame:
    """Passages of the benchmark and short phrases as a list of what must not be said."""
    short = spark.createDataFrame([("Of The",), ("idiot",), ("of the of",), ("the",)], "word string")
    return planning.flags(S.docs(spark, d), S.read(spark, d, "benchmark").select(F.col("text").alias("word")).union(short))


def all_flags(spark: SparkSession, d: str) -> DataFrame:
    """Listed words, and the toxic label in place of a model's review."""
    listed = safety_flags(spark, d).select("doc_id", F.concat(F.lit("word "), "word").alias("reason"))
    review = S.read(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit("review").alias("reason"))
    return planning.all_flags(listed, review)


def moment_sentiment(spark: SparkSession, d: str) -> DataFrame:
    """The share of letters e stands in for a model's score; only what users say has one."""
    s = S.sentences(spark, d).where("speaker = 'user'")
    scores = s.select("video_id", "sent_idx", (F.length(F.regexp_replace("text", "[^e]", "")) / F.length("text")).alias("score"))
    return planning.sentiment(S.moments(spark, d), scores)


def fts_build(spark: SparkSession, d: str) -> DataFrame:
    return search.frequencies(library_index(spark, d)[0])


def word_importance(spark: SparkSession, d: str) -> DataFrame:
    return search.importance(*library_index(spark, d))


def fts_match(spark: SparkSession, d: str) -> DataFrame:
    return search.match_any(library_index(spark, d)[0], ["idiot", "license", "nicht"])


def fts_match_all(spark: SparkSession, d: str) -> DataFrame:
    return search.match_all(library_index(spark, d)[0], ["the", "license", "of"])


def fts_phrase(spark: SparkSession, d: str) -> DataFrame:
    return search.phrase(library_index(spark, d)[0], ["of", "the"])


def fts_ranked(spark: SparkSession, d: str) -> DataFrame:
    return search.ranked(*library_index(spark, d), ["license", "the"])


def fts_by_speaker(spark: SparkSession, d: str) -> DataFrame:
    index = sentence_index(spark, d)[0].where("speaker = 'user'")
    return search.match_any(index, ["the"]).select("doc_id.video_id", "doc_id.sent_idx", "hits")


def snippets(spark: SparkSession, d: str) -> DataFrame:
    words = ["license", "the", "of"]
    return search.snippets(S.docs(spark, d), search.passages(*library_index(spark, d), words), words)


def scan_parquet(spark: SparkSession, d: str) -> DataFrame:
    return S.read(spark, d, "lineitem").where("l_quantity < 3").select("l_orderkey", "l_linenumber", "l_quantity")


QUERIES = [explode_words, sentence_assemble, transcript_fulltext, transcript_view, bilingual_captions, speaker_time, speaker_number, clip_cut, hook_text_window, clip_words, silence_gaps, speech_runs, silence_retime, idea_parts, top_moments, best_moments, moment_ranks, ideas_per_video, srt_export, vtt_export, ass_karaoke, assign_speaker, active_speaker, asof_latest, face_smooth, best_frame, crop_box, crop_follow, url_valid, detect_questions, surprising_sentences, arabic_fold, hashtags, json_stage, docs_by_lang, word_freq, safety_flags, phrase_flags, all_flags, moment_sentiment, fts_build, word_importance, fts_match, fts_match_all, fts_phrase, fts_ranked, fts_by_speaker, snippets, scan_parquet]

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
SPELT = text.SPELT.replace(r"(?!\x{0640})", "")  # no text here has the sign
POSTINGS = f"p AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT doc_id, {TOKENS} AS t FROM documents))"
CLOCK = "lpad(CAST({ms} // 3600000 AS VARCHAR), CAST(greatest(2, length(CAST({ms} // 3600000 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST({ms} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({ms} // 1000 % 60 AS VARCHAR), 2, '0')"
MS = "lpad(CAST({ms} % 1000 AS VARCHAR), 3, '0')"
ASS = "CAST({ms} // 3600000 AS VARCHAR) || ':' || lpad(CAST({ms} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({ms} // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST({ms} // 10 % 100 AS VARCHAR), 2, '0')"
SPANS = f"WITH {S.spans_sql('a', 'click', 2)}, {S.spans_sql('b', 'view', 6)}, {S.FRAMES}"
UNTIL = "max(end_ms) OVER (PARTITION BY video_id ORDER BY start_ms, end_ms, word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
SIZES = "v AS (SELECT p_partkey AS video_id, CAST(p_size * 64 + 320 AS BIGINT) AS width, p_partkey % 30 * 48 + 240 AS height FROM part), s AS (SELECT *, w0 - w0 % 2 AS w, h0 - h0 % 2 AS h FROM (SELECT *, least(width, height * 9 // 16) AS w0, least(height, width * 16 // 9) AS h0 FROM v))"


def clock(ms: str, sep: str) -> str:
    return f"{CLOCK.format(ms=ms)} || '{sep}' || {MS.format(ms=ms)}"


SQL = {
    "explode_words": f"{WORDS} SELECT video_id, sent_idx, word_idx, start_ms, end_ms, word FROM words",
    "sentence_assemble": f"{SENT} SELECT * FROM sentences",
    "transcript_fulltext": f"{SENT} SELECT video_id, string_agg(text, ' ' ORDER BY sent_idx) AS full_text, count(*) AS n_sentences FROM sentences GROUP BY video_id",
    "transcript_view": f"{SENT} SELECT video_id, start_ms, speaker, text FROM sentences ORDER BY video_id, start_ms",
    "bilingual_captions": f"{SENT} SELECT video_id, sent_idx, start_ms, end_ms, text, CASE WHEN speaker <> 'system' THEN '[ar] ' || text END AS translated FROM sentences",
    "speaker_time": f"{SENT} SELECT video_id, speaker, CAST(sum(end_ms - start_ms) AS BIGINT) AS spoken_ms, count(*) AS n_sentences FROM sentences GROUP BY video_id, speaker",
    "speaker_number": f"""{SENT}, f AS (SELECT video_id, speaker, min(sent_idx) AS first FROM sentences GROUP BY video_id, speaker)
SELECT video_id, speaker, 'Speaker ' || dense_rank() OVER (PARTITION BY video_id ORDER BY first, speaker) AS label FROM f""",
    "clip_cut": f"{WORDS} SELECT video_id, sent_idx, word_idx, greatest(start_ms, 5000) - 5000 AS start_ms, least(end_ms, 35000) - 5000 AS end_ms, word FROM words WHERE start_ms < 35000 AND end_ms > 5000",
    "hook_text_window": f"{WORDS} SELECT video_id, string_agg(word, ' ' ORDER BY sent_idx, word_idx) AS hook FROM words WHERE start_ms < {HOOK_MS} GROUP BY video_id",
    "silence_gaps": f"{WORDS} SELECT video_id, gap_start, start_ms AS gap_end FROM (SELECT *, {UNTIL} AS gap_start FROM words) WHERE start_ms - gap_start > {silence.LONG}",
    "speech_runs": f"""{WORDS}, g AS (SELECT *, CASE WHEN start_ms - {UNTIL} > {silence.LONG} THEN 1 ELSE 0 END AS new FROM words),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY video_id ORDER BY start_ms, end_ms, word_idx) AS BIGINT) AS run FROM g)
SELECT video_id, run, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_words FROM r GROUP BY video_id, run""",
    "silence_retime": f"""{WORDS}, g AS (SELECT *, start_ms - {UNTIL} AS gap FROM words),
r AS (SELECT *, CAST(sum(CASE WHEN gap > {silence.LONG} THEN gap ELSE 0 END) OVER (PARTITION BY video_id ORDER BY start_ms, end_ms, word_idx) AS BIGINT) AS gone FROM g)
SELECT video_id, sent_idx, word_idx, start_ms - gone AS new_start, end_ms - gone AS new_end FROM r""",
    "idea_parts": f"""{SENT}, b AS (SELECT *, CAST(coalesce(sum(end_ms - start_ms) OVER (PARTITION BY video_id ORDER BY start_ms, sent_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // {PART_MS} AS p FROM sentences),
q AS (SELECT *, dense_rank() OVER (PARTITION BY video_id ORDER BY p) AS part FROM b), r AS (SELECT *, max(part) OVER (PARTITION BY video_id) AS n_parts FROM q)
SELECT video_id, sent_idx, part, n_parts, 'Part ' || part || '/' || n_parts AS label FROM r""",
    "top_moments": f"""{SENT}, {S.MOMENTS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, start_ms, moment_id) AS rank FROM moments) WHERE rank <= {MOMENTS}""",
    "ideas_per_video": f"{SENT}, {S.MOMENTS} SELECT video_id, count(*) AS n_ideas, count(DISTINCT moment_type) AS n_types, count(*) < 5 AS too_few FROM moments GROUP BY video_id",
    "srt_export": f"""{SENT}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, end_ms, sent_idx) AS n FROM sentences)
SELECT video_id, string_agg(n || chr(10) || {clock('start_ms', ',')} || ' --> ' || {clock('end_ms', ',')} || chr(10) || text || chr(10), chr(10) ORDER BY n) AS body FROM n GROUP BY video_id""",
    "vtt_export": f"""{SENT} SELECT video_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({clock('start_ms', '.')} || ' --> ' || {clock('end_ms', '.')} || chr(10) || text || chr(10), chr(10) ORDER BY start_ms, end_ms, sent_idx) AS body FROM sentences GROUP BY video_id""",
    "ass_karaoke": f"""{WORDS}, t AS (SELECT *, coalesce(lead(start_ms) OVER (PARTITION BY video_id, sent_idx ORDER BY start_ms, word_idx), end_ms) AS until FROM words),
k AS (SELECT video_id, sent_idx, min(start_ms) AS s, max(end_ms) AS e, string_agg('{{\\k' || (until // 10 - start_ms // 10) || '}}' || word, ' ' ORDER BY start_ms, word_idx) AS line FROM t GROUP BY video_id, sent_idx)
SELECT video_id, sent_idx, 'Dialogue: 0,' || {ASS.format(ms='s')} || ',' || {ASS.format(ms='e')} || ',Default,' || line AS event FROM k""",
    "assign_speaker": f"""{SPANS}, o AS (SELECT a.event_id, b.speaker, row_number() OVER (PARTITION BY a.event_id ORDER BY least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) DESC, b.start_ms, b.speaker) AS n
  FROM a JOIN b ON a.video_id = b.video_id AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms)
SELECT a.event_id, o.speaker FROM a LEFT JOIN o ON a.event_id = o.event_id AND n = 1""",
    "active_speaker": f"""{SPANS}, o AS (SELECT f.event_id, b.speaker, row_number() OVER (PARTITION BY f.event_id ORDER BY b.start_ms DESC, b.speaker DESC) AS n
  FROM frames f JOIN b ON f.video_id = b.video_id AND f.ts_ms >= b.start_ms AND f.ts_ms < b.end_ms)
SELECT f.event_id, o.speaker FROM frames f LEFT JOIN o ON f.event_id = o.event_id AND n = 1""",
    "asof_latest": f"""{SPANS}, o AS (SELECT f.event_id, b.speaker, b.start_ms, row_number() OVER (PARTITION BY f.event_id ORDER BY b.start_ms DESC, b.speaker DESC) AS n
  FROM frames f JOIN b ON f.video_id = b.video_id AND f.ts_ms >= b.start_ms)
SELECT f.event_id, o.speaker, o.start_ms AS since_ms FROM frames f LEFT JOIN o ON f.event_id = o.event_id AND n = 1""",
    "face_smooth": f"WITH {S.FRAMES} SELECT event_id, video_id, round(avg(cx) OVER (PARTITION BY video_id ORDER BY ts_ms, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS cx_smooth FROM frames",
    "best_frame": f"WITH {S.FRAMES} SELECT video_id, event_id, cx FROM frames QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY cx DESC, event_id) = 1",
    "crop_box": f"WITH {SIZES} SELECT video_id, width, height, (width - w) // 2 AS x, (height - h) // 2 AS y, w, h FROM s",
    "crop_follow": f"""WITH {SIZES}, f AS (SELECT *, video_id * 37 % width AS cx, video_id * 53 % height AS cy FROM s)
SELECT video_id, cx, cy, greatest(0, least(width - w, cx - w // 2)) AS x, greatest(0, least(height - h, cy - h // 2)) AS y, w, h FROM f""",
    "url_valid": r"SELECT page_id, regexp_matches(url, '^https?://[^/\s]+') AS valid FROM pages",
    "detect_questions": "SELECT conv_id, turn, text || '؟' AS text FROM conversations WHERE turn % 4 = 1",
    "arabic_fold": "SELECT conv_id, turn, replace(text, 'e', chr(1605)) AS folded FROM conversations",
    "hashtags": f"""WITH t AS (SELECT conv_id, turn, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (SELECT conv_id, turn, {TOKENS} AS t FROM conversations)),
f AS (SELECT conv_id, turn, w, min(i) AS i FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS n FROM f)
SELECT c.conv_id, c.turn, coalesce(h, '') AS hashtags FROM conversations c LEFT JOIN (SELECT conv_id, turn, string_agg('#' || w, ' ' ORDER BY i) AS h FROM r WHERE n <= 5 GROUP BY conv_id, turn) USING (conv_id, turn)""",
    "json_stage": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "docs_by_lang": "SELECT lang, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS letters FROM documents GROUP BY lang",
    "word_freq": f"SELECT token, count(*) AS n FROM (SELECT unnest({TOKENS}) AS token FROM documents) GROUP BY token",
    "safety_flags": f"SELECT doc_id, word, count(*) AS hits FROM (SELECT doc_id, unnest({TOKENS}) AS word FROM documents) WHERE word IN ('idiot', 'scum', 'trash', 'loser') GROUP BY doc_id, word",
    "all_flags": f"""SELECT doc_id, 'word ' || word AS reason FROM (SELECT doc_id, unnest({TOKENS}) AS word FROM documents) WHERE word IN ('idiot', 'scum', 'trash', 'loser')
UNION SELECT doc_id, 'review' FROM labels WHERE toxic = 1""",
    "moment_sentiment": f"""{SENT}, {S.MOMENTS}, f AS (SELECT video_id, sent_idx, CAST(length(regexp_replace(text, '[^e]', '', 'g')) AS DOUBLE) / length(text) AS feeling FROM sentences WHERE speaker = 'user')
SELECT m.video_id, moment_type, count(feeling) AS n, round(avg(feeling), 6) AS mean FROM moments m LEFT JOIN f ON m.video_id = f.video_id AND m.moment_id = f.sent_idx GROUP BY m.video_id, moment_type""",
    "fts_build": f"WITH {POSTINGS} SELECT token, count(*) AS cf, count(DISTINCT doc_id) AS df FROM p GROUP BY token",
    "fts_match": f"WITH {POSTINGS} SELECT doc_id, count(*) AS hits FROM p WHERE token IN ('idiot', 'license', 'nicht') GROUP BY doc_id",
    "fts_match_all": f"WITH {POSTINGS} SELECT doc_id, count(*) AS hits FROM p WHERE token IN ('the', 'license', 'of') GROUP BY doc_id HAVING count(DISTINCT token) = 3",
    "fts_phrase": f"WITH {POSTINGS} SELECT doc_id, CAST(pos AS BIGINT) AS start FROM (SELECT *, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM p) WHERE token = 'of' AND next = 'the'",
    "word_importance": f"""WITH {POSTINGS}, f AS (SELECT token, count(*) AS cf, count(DISTINCT doc_id) AS df FROM p GROUP BY token)
SELECT token, cf, df, round(cf * ln((n + 1)::DOUBLE / (df + 1)), 6) AS importance FROM f, (SELECT count(*) AS n FROM documents)""",
    "clip_words": f"""{SENT}, {S.MOMENTS}, c AS (SELECT video_id, video_id * 1000 + moment_id AS clip_id, start_ms - 1000 AS a, end_ms + 1000 AS b FROM moments WHERE moment_type = 'question')
SELECT clip_id, sent_idx, word_idx, greatest(start_ms, a) - a AS start_ms, least(end_ms, b) - a AS end_ms, word FROM words JOIN c ON words.video_id = c.video_id AND start_ms < b AND end_ms > a""",
    "surprising_sentences": f"SELECT conv_id, turn FROM conversations WHERE regexp_matches(CASE WHEN turn % 5 = 1 THEN text || ' فجأة' ELSE text END, '{text.surprise_pattern()}')",
    "fts_ranked": f"""WITH t AS (SELECT doc_id, {TOKENS} AS t FROM documents),
c AS (SELECT doc_id, len(t) AS l, len(list_filter(t, lambda x: x = 'license')) AS a, len(list_filter(t, lambda x: x = 'the')) AS b FROM t),
s AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c)
SELECT doc_id, round(ln(1 + (n - da + 0.5::DOUBLE) / (da + 0.5::DOUBLE)) * a * 2.2::DOUBLE / (a + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / m))
  + ln(1 + (n - db + 0.5::DOUBLE) / (db + 0.5::DOUBLE)) * b * 2.2::DOUBLE / (b + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / m)), 6) AS score FROM c, s WHERE a > 0 OR b > 0""",
    "fts_by_speaker": f"""{SENT}, p AS (SELECT video_id, sent_idx, speaker, unnest({TOKENS}) AS token FROM sentences)
SELECT video_id, sent_idx, count(*) AS hits FROM p WHERE speaker = 'user' AND token = 'the' GROUP BY video_id, sent_idx""",
    "best_moments": f"""{SENT}, {S.MOMENTS}, m AS (SELECT video_id, moment_id, start_ms - {AROUND_MS} AS start_ms, end_ms + {AROUND_MS} AS end_ms, moment_type, score FROM moments),
c AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, end_ms, moment_id) AS p FROM m WHERE score > 0),
two AS (SELECT a.video_id, [a.p, b.p] AS places, a.score + b.score AS total, b.p AS p, b.end_ms AS until FROM c a JOIN c b ON a.video_id = b.video_id AND a.p < b.p AND b.start_ms >= a.end_ms),
chosen AS (
  SELECT video_id, [p] AS places, score AS total FROM c UNION ALL SELECT video_id, places, total FROM two
  UNION ALL SELECT two.video_id, list_append(places, c.p), total + score FROM two JOIN c ON two.video_id = c.video_id AND two.p < c.p AND c.start_ms >= until
),
best AS (SELECT video_id, unnest(places) AS p FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY total DESC, len(places), places) AS nth FROM chosen) WHERE nth = 1)
SELECT video_id, moment_id, start_ms, end_ms, moment_type, score FROM c JOIN best USING (video_id, p)""",
    "moment_ranks": f"""{SENT}, {S.MOMENTS} SELECT video_id, moment_id, score, row_number() OVER (ORDER BY score DESC NULLS LAST, video_id, moment_id) AS number, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, percent_rank() OVER w AS percent_rank, cume_dist() OVER w AS cume_dist, ntile(10) OVER (ORDER BY score DESC NULLS LAST, video_id, moment_id) AS ntile
FROM moments WINDOW w AS (ORDER BY score DESC NULLS LAST)""",
    "phrase_flags": f"""WITH t AS (SELECT doc_id, {TOKENS} AS t FROM documents),
b AS (SELECT DISTINCT {TOKENS} AS words FROM (SELECT text FROM benchmark UNION ALL SELECT * FROM (VALUES ('Of The'), ('idiot'), ('of the of'), ('the')) AS v(text))),
p AS (SELECT doc_id, t, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM t)
SELECT doc_id, array_to_string(words, ' ') AS word, count(*) AS hits FROM p JOIN b ON token = words[1] AND t[pos:pos + len(words) - 1] = words GROUP BY doc_id, words""",
    "snippets": f"""WITH t AS (SELECT doc_id, {TOKENS} AS t, regexp_extract_all(text, '[^\\p{{L}}\\p{{N}}]*{SPELT}') AS pieces FROM documents),
p AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM t),
h AS (SELECT doc_id, pos, max(pos) FILTER (token = 'license') OVER w AS a, max(pos) FILTER (token = 'the') OVER w AS b, max(pos) FILTER (token = 'of') OVER w AS c FROM p WHERE token IN ('license', 'the', 'of') WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, least(a, b, c) AS start, pos - least(a, b, c) + 1 AS width FROM h WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL),
best AS (SELECT doc_id, arg_min(start, (width, start)) AS start, min(width) AS width FROM r GROUP BY doc_id),
df AS (SELECT token, count(DISTINCT doc_id) AS df FROM p WHERE token IN ('license', 'the', 'of') GROUP BY token),
rare AS (SELECT sum(ln((n + 1) / (df + 1)) + 1) AS rarity FROM df, (SELECT count(*) AS n FROM documents)),
s AS (SELECT best.*, t, pieces, greatest(start - 5, 0) AS i, least(start + width + 5, len(t)) AS j FROM best JOIN t USING (doc_id))
SELECT doc_id, start, width, round(rarity * 3 / width, 6) AS score, CASE WHEN i > 0 THEN '… ' ELSE '' END
  || trim(array_to_string(list_transform(range(i, j), lambda k: CASE WHEN t[k + 1] IN ('license', 'the', 'of') THEN regexp_replace(pieces[k + 1], '({SPELT})$', '<b>\\1</b>') ELSE pieces[k + 1] END), '')) || CASE WHEN j < len(t) THEN ' …' ELSE '' END AS snippet
FROM s, rare""",
    "scan_parquet": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 3",
}
