"""Hand-made cases and properties that the synthetic tables cannot show."""

import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cliploom import schemas
from cliploom.functions import geometry, text, times
from cliploom.operators import campaigns, captions, intervals, ordering, planning, search, silence, transcripts
from cliploom.plans import stages
from cliploom.sources import files
from cliploom.streaming import queue

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
WORDS = "video_id long, sent_idx long, speaker string, word_idx long, start_ms long, end_ms long, word string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


def words_of(spark, spans, video=1):
    return spark.createDataFrame([(video, 0, "a", k, s, e, f"w{k}") for k, (s, e) in enumerate(spans)], WORDS)


@pytest.mark.parametrize(("ms", "srt", "ass"), [(0, "00:00:00,000", "0:00:00.00"), (59_999, "00:00:59,999", "0:00:59.99"), (3_661_001, "01:01:01,001", "1:01:01.00"), (360_000_000, "100:00:00,000", "100:00:00.00")])
def test_caption_times(spark, ms, srt, ass):
    assert one(spark, times.srt_time(F.col("ms")), ms=ms) == srt
    assert one(spark, times.vtt_time(F.col("ms")), ms=ms) == srt.replace(",", ".")
    assert one(spark, times.ass_time(F.col("ms")), ms=ms) == ass


def test_arabic(spark):
    assert one(spark, text.arabic_fold(F.col("x")), x="مَرْحَبًـا") == "مرحبا"
    assert one(spark, text.tokens(F.col("x")), x="مَرْحَبًا بك") == ["مرحبا", "بك"]
    assert one(spark, text.is_question(F.col("x")), x="كيف؟") and not one(spark, text.is_question(F.col("x")), x="no.")
    assert one(spark, text.is_question(F.col("x").cast("string")), x=None) is False


def test_crop_stays_inside(spark):
    v = spark.createDataFrame([(1920, 1080, 0, 0), (1920, 1080, 1919, 1079), (400, 1000, 200, 990), (2, 2, 1, 1)], "w long, h long, cx long, cy long")
    for w, h, b in v.select("w", "h", geometry.crop_follow(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"))).collect():
        assert 0 <= b.x <= w - b.w and 0 <= b.y <= h - b.h and b.w % 2 == b.h % 2 == 0
    assert tuple(one(spark, geometry.crop_box(F.col("w"), F.col("h")), w=1920, h=1080)) == (657, 0, 606, 1080)


def test_ranges_touching_nested_empty(spark):
    left = spark.createDataFrame([(1, 10, 0, 10), (1, 11, 10, 20), (1, 12, 5, 5), (2, 13, 0, 10), (1, 14, 100, 110)], "video_id long, id long, start_ms long, end_ms long")
    right = spark.createDataFrame([(1, "a", 0, 10), (1, "b", 2, 8), (1, "c", 10, 10), (1, "d", 9, 12)], "video_id long, speaker string, start_ms long, end_ms long")
    pairs = intervals.overlap_join(left, right, "video_id", 3)
    assert rows(pairs.select("id", "r_speaker")) == [(10, "a"), (10, "b"), (10, "d"), (11, "d")]
    assert rows(intervals.assign_largest(left, right, "video_id", "id", "speaker", 4)) == [(10, "a"), (11, "d"), (12, None), (13, None), (14, None)]


@SLOW
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(0, 30), st.integers(0, 12)), max_size=8), st.lists(st.tuples(st.integers(1, 2), st.integers(0, 30), st.integers(0, 12)), max_size=8), st.integers(1, 9))
def test_bucketed_overlap_is_plain_overlap(spark, a, b, width):
    kind = "video_id long, id long, start_ms long, end_ms long"
    left = spark.createDataFrame([(v, k, s, s + n) for k, (v, s, n) in enumerate(a)], kind)
    right = spark.createDataFrame([(v, k, s, s + n) for k, (v, s, n) in enumerate(b)], kind)
    want = sorted((i, j) for i, (v, s, n) in enumerate(a) for j, (w, t, m) in enumerate(b) if v == w and s < t + m and t < s + n and n and m)
    assert rows(intervals.overlap_join(left, right, "video_id", width).select("id", "r_id")) == want


def test_points(spark):
    points = spark.createDataFrame([(1, 1, 5), (1, 2, 50), (1, 3, -1), (2, 4, 5)], "video_id long, id long, ts_ms long")
    turns = spark.createDataFrame([(1, "a", 0, 10), (1, "b", 3, 6)], "video_id long, speaker string, start_ms long, end_ms long")
    assert rows(intervals.covering(points, turns, "video_id", "id", "speaker")) == [(1, "b"), (2, None), (3, None), (4, None)]
    assert rows(intervals.asof(points, turns, "video_id", "id", "speaker")) == [(1, "b", 3), (2, "b", 3), (3, None, None), (4, None, None)]


@SLOW
@given(st.lists(st.tuples(st.integers(0, 900), st.integers(1, 300)), min_size=1, max_size=12))
def test_retiming_keeps_words_and_order(spark, steps):
    spans, t = [], 0
    for gap, length in steps:
        spans.append((t + gap, t + gap + length))
        t += gap + length
    out = silence.retime(words_of(spark, spans)).orderBy("word_idx").collect()
    assert [r.new_end - r.new_start for r in out] == [e - s for s, e in spans]
    assert all(a.new_end <= b.new_start for a, b in zip(out, out[1:], strict=False))
    gone = sum(r.gap_end - r.gap_start for r in silence.gaps(words_of(spark, spans)).collect())
    assert out[-1].new_end == spans[-1][1] - gone
    assert silence.runs(words_of(spark, spans)).count() == silence.gaps(words_of(spark, spans)).count() + 1


def test_nested_word_opens_no_gap(spark):
    assert silence.gaps(words_of(spark, [(0, 5000), (100, 200), (5100, 5200)])).count() == 0


def test_cut_mid_word(spark):
    assert rows(silence.cut(words_of(spark, [(0, 100), (100, 200), (200, 300)]), 50, 250).select("word_idx", "start_ms", "end_ms")) == [(0, 0, 50), (1, 50, 150), (2, 150, 200)]


def test_parts_at_the_edge(spark):
    s = spark.createDataFrame([(1, 0, 60), (1, 1, 59), (1, 2, 1), (1, 3, 500), (1, 4, 1)], "video_id long, i long, n long")
    assert [r.part for r in ordering.parts(s, ["video_id"], ["i"], F.col("n"), 60).orderBy("i").collect()] == [1, 2, 2, 3, 4]


def test_top_with_ties(spark):
    s = spark.createDataFrame([(1, k, 5.0) for k in range(12)] + [(2, 1, 1.0)], "v long, id long, score double")
    out = ordering.top(s, ["v"], [F.col("score").desc(), F.col("id")], 10)
    assert rows(out.where("v = 1").select("id")) == [(k,) for k in range(10)] and out.where("v = 2").count() == 1


def money_tables(spark):
    c = spark.createDataFrame([(1, Decimal("10.0000"), Decimal("2.0000")), (2, None, None), (3, Decimal("5.0000"), Decimal("1.0000"))], "id long, budget decimal(18,4), rate_per_1000_views decimal(18,4)")
    k = spark.createDataFrame([(10, 1), (11, 1), (20, 2)], "id long, campaign_id long")
    p = spark.createDataFrame([(100, 10, "YT", "accepted", 1500), (101, 10, "YT", "pending", 500), (102, 10, None, "rejected", 0), (103, 20, "X", "accepted", 900)], "id long, clip_id long, platform string, status string, views_count long")
    return c, k, p


def test_report_with_empty_campaign_and_null_rate(spark):
    out = {(r.level, r.campaign_id or r.clip_id or r.platform): r for r in campaigns.report(*money_tables(spark)).collect()}
    assert out["total", None].expected == 4.0 and out["campaign", 1].accepted == 3.0
    assert out["campaign", 3].n_posts == 0 and out["campaign", 2].expected == 0.0 and out["clip", 11].views == 0
    assert sum(r.expected for (level, _), r in out.items() if level == "campaign") == 4.0
    assert {r.campaign_id: r.left for r in campaigns.budget_use(*money_tables(spark)).collect()} == {1: 6.0, 2: None, 3: 5.0}


def test_audit_keeps_currencies_apart(spark):
    c, k, p = money_tables(spark)
    e = spark.createDataFrame([(1, 100, Decimal("3.0000"), "USD"), (2, 100, Decimal("2.0000"), "EUR")], "id long, post_id long, calculated_earning decimal(18,4), currency string")
    out = rows(campaigns.audit(p, e, k, c))
    assert (100, "USD", 3.0, 3.0, False) in out and (100, "EUR", 2.0, 3.0, True) in out and (103, None, None, 0.0, True) in out


def test_latest_snapshot(spark):
    s = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "id long, t long, status string")
    assert rows(ordering.latest(s, ["id"], [F.col("t").desc(), "status"]).select("id", "status")) == [(1, "b"), (2, "c")]


def test_flags_are_whole_tokens(spark):
    docs = spark.createDataFrame([(1, "class Ass, ass"), (2, None), (3, "")], "doc_id long, text string")
    assert rows(planning.flags(docs, spark.createDataFrame([("ASS",), ("ass",)], "word string"))) == [(1, "ass", 2)]


def test_phrase_repeats(spark):
    index = search.postings(spark.createDataFrame([(1, "to be to be to"), (2, "be to")], "doc_id long, text string"))
    assert rows(search.phrase(index, ["to", "be", "to"])) == [(1, 0), (1, 2)]
    assert rows(search.match_all(index, ["to", "be"])) == [(1, 5), (2, 2)]


def test_transcripts_round_trip(spark, tmp_path):
    w = words_of(spark, [(0, 10), (20, 30)]).withColumn("sent_idx", F.col("word_idx"))
    files.write_transcripts(transcripts.nest(w), str(tmp_path / "t"))
    back = files.read_transcripts(spark, str(tmp_path / "t"))
    assert rows(transcripts.explode_words(back).select("video_id", "sent_idx", "start_ms", "end_ms", "word")) == [(1, 0, 0, 10, "w0"), (1, 1, 20, 30, "w1")]
    assert back.first().full_text == "w0 w1"


def test_caption_files(spark, tmp_path):
    s = transcripts.assemble(words_of(spark, [(0, 100), (100, 200)]))
    assert captions.srt(s).first().body == "1\n00:00:00,000 --> 00:00:00,200\nw0 w1\n"
    assert captions.vtt(s).first().body.startswith("WEBVTT\n\n00:00:00.000 --> ")
    body = captions.ass(captions.karaoke_lines(words_of(spark, [(0, 100), (150, 200)]))).first().body
    assert body.endswith("Dialogue: 0,0:00:00.00,0:00:00.20,Default,{\\k15}w0 {\\k5}w1\n") and "[Events]" in body
    files.write_captions(captions.srt(s), str(tmp_path / "c"), "srt")
    assert list((tmp_path / "c/format=srt/video_id=1").glob("*.txt"))


def test_files(spark, tmp_path):
    (tmp_path / "words.txt").write_text("Bad\n\n# note\nbad\n")
    assert rows(files.read_words(spark, str(tmp_path / "words.txt"))) == [("bad",)]
    (tmp_path / "t.json").write_text('{"name": "plain", "font": {"size": 30}}')
    t = files.read_templates(spark, str(tmp_path / "t.json")).first()
    assert (t.font.name, t.font.size, t.logo_position) == ("Arial", 30, "top-right")
    (tmp_path / "s.json").write_text('{"model": "small"}')
    assert files.read_settings(str(tmp_path / "s.json")) == {"model": "small"}
    assert files.media_files(spark, str(tmp_path), "*.txt").first().length == 16
    files.append_rows(spark, [(1, 2, "x")], schemas.COMMENTS, str(tmp_path / "comments"))
    assert spark.read.parquet(str(tmp_path / "comments")).count() == 1


def test_stages_check_columns_and_switch_off(spark):
    r = stages.Registry()
    r.add("shout", stages.per_row_model(lambda x: x.str.upper(), "text", "loud"), "text string", "loud string")
    r.add("split", stages.one_to_many_model(lambda f: f.loc[f.index.repeat(2)][["text"]], "text string"), "text string", "text string")
    df = spark.createDataFrame([("a",)], "text string")
    assert rows(r.run(["split", "shout"], df)) == [("a", "A"), ("a", "A")]
    r.enable("split", False)
    assert r.run(["split", "shout"], df).count() == 1
    with pytest.raises(ValueError, match="shout takes"):
        r.apply("shout", spark.range(1))


def test_pieces_fit(spark):
    s = spark.createDataFrame([(1, k, "x" * 40) for k in range(5)], "video_id long, sent_idx long, text string")
    assert stages.pieces(s, 100).select("piece").distinct().count() == 2


def test_queue_runs_each_job_once_in_order(spark, tmp_path):
    (tmp_path / "jobs").mkdir()
    day = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(2, "b", day), (1, "a", day), (3, "c", day - dt.timedelta(1))], schemas.JOBS).write.mode("append").json(str(tmp_path / "jobs"))
    ran = []
    assert queue.drain(spark, str(tmp_path / "jobs"), str(tmp_path / "check"), lambda j: ran.append(j.job_id)) == 3
    assert ran == [3, 1, 2]
    assert queue.drain(spark, str(tmp_path / "jobs"), str(tmp_path / "check"), lambda j: ran.append(j.job_id)) == 0


def test_interval_joins_are_keyed(spark, sf_dir):
    """No nested-loop join where a key is given; filters reach the scan."""
    from cliploom.plans import registry

    for name in ("assign_speaker", "active_speaker"):
        plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    plan = registry.queries()["scan_parquet"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(l_quantity,3.0)" in plan


def test_clip_words_of_several_clips(spark):
    w = words_of(spark, [(0, 100), (150, 250), (300, 400)])
    clips = spark.createDataFrame([(1, 10, 50, 200), (1, 11, 160, 170), (2, 12, 0, 999), (1, 13, 100, 150)], "video_id long, clip_id long, start_ms long, end_ms long")
    assert rows(silence.clip_words(w, clips, 60).select("clip_id", "start_ms", "end_ms", "word")) == [(10, 0, 50, "w0"), (10, 100, 150, "w1"), (11, 0, 10, "w1")]


def test_surprise(spark):
    texts = ["What!", "Suddenly it fell", "insuddenly", "calm", None, "ثم فجأة وقع"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    assert rows(df.select("k", text.is_surprising(F.col("t")))) == [(0, True), (1, True), (2, False), (3, False), (4, False), (5, True)]


def test_money_beyond_doubles(spark):
    big = Decimal("99999999999999999")
    df = spark.createDataFrame([(big,)], "v decimal(30,4)")
    from cliploom.functions.money import earning

    assert df.select(earning(F.col("v"))).first()[0] == 99999999999999.999


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "to be or not to be"), (2, "be"), (3, None), (4, "")], "doc_id long, text string")
    search.write_index(docs, str(tmp_path / "i"))
    index, sizes = search.read_index(spark, str(tmp_path / "i"))
    assert rows(index.where("token = 'be'").select("doc_id", "tf", F.concat_ws(",", "positions"))) == [(1, 2, "1,5"), (2, 1, "0")]
    assert rows(search.phrase(index, ["to", "be"])) == [(1, 0), (1, 4)] and sizes.count() == 4
    plan = search.match_any(index, ["be"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(token,be)" in plan or "In(token" in plan


def test_flags_beyond_a_short_list(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "bad bad good"), (2, "worse")], "doc_id long, text string")
    banned = spark.createDataFrame([("bad",), ("worse",)], "word string")
    monkeypatch.setattr(planning, "LISTED", 1)
    assert rows(planning.flags(docs, banned)) == [(1, "bad", 2), (2, "worse", 1)]


def test_moments_and_platforms_as_files(spark, tmp_path):
    m = spark.createDataFrame([(1, 2, 3, 4, "story", 0.5)], schemas.MOMENTS)
    files.write_moments(m, str(tmp_path / "m"))
    assert rows(files.read_moments(spark, str(tmp_path / "m"))) == rows(m)
    files.write_by_platform(spark.createDataFrame([(1, "YT", True), (1, "X", False)], "clip_id long, platform string, fits boolean"), str(tmp_path / "p"))
    assert sorted(x.name for x in (tmp_path / "p").glob("platform=*")) == ["platform=X", "platform=YT"]
