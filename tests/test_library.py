"""Sketches by day, dominated rows, surprise and captions read back, against plain Python."""

import datetime as dt
import math
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cliploom import storage
from cliploom.operators import captions as C
from cliploom.operators import dominance, planning, silence, sketches, surprise
from cliploom.plans import registry
from cliploom.sources import captions, files
from cliploom.storage import fresh_folder


def rows(df):
    return sorted(tuple(r) for r in df.collect())


VIEWS = "day date, group string, viewer long, value double"


def day(k):
    return dt.date(2024, 1, 1) + dt.timedelta(days=k)


def test_periods_are_merged_within_the_error_bounds(spark):
    views = spark.range(300_000).selectExpr("date_add(date'2024-01-01', cast(id % 20 AS int)) AS day", "'a' AS group", "xxhash64(id) % 40000 AS viewer", "cast(id % 7919 AS double) AS value")
    path = fresh_folder(spark, "sketches")
    assert sketches.refresh(views, path) == 20
    got = sketches.over(sketches.held(spark, path), F.lit("all"), (0.1, 0.5, 0.99)).first()
    exact = views.agg(F.count_distinct("viewer").alias("v")).first().v
    assert got.n == 300_000 and abs(got.viewers - exact) < 4 * 1.04 / math.sqrt(1 << sketches.LG) * exact
    for share, q in ((0.1, got.q10), (0.5, got.q50), (0.99, got.q99)):
        assert abs(q / 7919 - share) < 0.01


def test_only_changed_days_are_written(spark):
    views = [(day(k), g, v, float(v)) for k in range(5) for g in "ab" for v in range(20 + k)] + [(None, "a", 1, 1.0), (day(0), None, 1, 1.0), (day(0), "a", None, None)]
    path = fresh_folder(spark, "sketches")
    df = spark.createDataFrame(views, VIEWS)
    assert sketches.refresh(df, path) == 5 and sketches.refresh(df, path) == 0
    more = spark.createDataFrame([*views, (day(3), "a", 999, 5.0), (day(9), "b", 1, 1.0)], VIEWS)
    before = {r.day: r for r in sketches.held(spark, path).where("group = 'a'").collect()}
    assert sketches.refresh(more, path) == 2
    after = {r.day: r for r in sketches.held(spark, path).where("group = 'a'").collect()}
    assert [d for d in before if before[d] != after[d]] == [day(3)]
    got = {(r.period, r.group): (r.n, r.viewers, r.q50) for r in sketches.over(sketches.held(spark, path), F.col("day") >= F.lit(day(3))).collect()}
    assert got[True, "a"][:2] == (23 + 24 + 1, 25) and got[True, "b"][:2] == (23 + 24 + 1, 24)
    swapped = spark.createDataFrame([(d, g, (v + 1 if v == 3 and d == day(1) else v), x) for d, g, v, x in views], VIEWS)  # as many rows, others
    assert {r.day for r in sketches.stale_days(swapped, path).collect()} >= {day(1)}


def test_nothing_to_sketch(spark):
    path = fresh_folder(spark, "sketches")
    assert sketches.refresh(spark.createDataFrame([], VIEWS), path) == 0
    assert sketches.over(sketches.held(spark, path), F.lit(1)).collect() == []
    sketches.refresh(spark.createDataFrame([(day(0), "a", None, None)], VIEWS), path)
    assert rows(sketches.over(sketches.held(spark, path), F.lit(1))) == [(1, "a", 1, 0, None)]


@pytest.mark.parametrize(("block", "values"), [(1 << 16, 50), (16, 50), (7, 2), (16, 10**6)])
def test_dominated_rows_by_brute_force(spark, monkeypatch, block, values):
    rng = random.Random(block + values)
    monkeypatch.setattr(dominance, "CHUNK", 5)
    data = [(k, rng.randrange(values), rng.randrange(values)) for k in range(150)] + [(900, None, 1), (901, 1, None)]
    got = {r.id: r.n_above for r in dominance.exceeded(spark.createDataFrame(data, "id long, views long, earned long").repartition(3), "views", "earned", "id", block).collect()}
    assert got == {k: sum(v < x[1] and e > x[2] for x in data[:150]) for k, v, e in data[:150]}


def test_dominance_of_nothing(spark):
    assert dominance.exceeded(spark.createDataFrame([], "id long, views long, earned long"), "views", "earned", "id").collect() == []


def test_surprise_is_what_a_video_seldom_says(spark):
    rng = random.Random(3)
    words = ["the", "clip", "goes", "on"]
    said = [(v, s, " ".join(rng.choice(words) for _ in range(8))) for v in range(3) for s in range(12)]
    said += [(0, 12, "zebra quagga the okapi"), (1, 12, ""), (2, 12, None), (7, 0, "alone"), (8, 0, "same"), (8, 1, "same")]
    tokens = Counter(t for _, _, x in said for t in (x or "").split())
    info = {(v, s): (sum(math.log(tokens.total() / tokens[t]) for t in x.split()) / len(x.split()) if x else 0.0) for v, s, x in said}
    want = []
    for v in {v for v, _ in info}:
        own = [i for (w, _), i in info.items() if w == v]
        mean = sum(own) / len(own)
        spread = math.sqrt(sum((i - mean) ** 2 for i in own) / len(own))
        want += [(w, s, round((i - mean) / spread, 6)) for (w, s), i in info.items() if w == v and spread > 1e-9 and (i - mean) / spread >= 1.5]
    got = rows(surprise.surprising(spark.createDataFrame(said, "video_id long, sent_idx long, text string")))
    assert [(a, b) for a, b, _ in got] == sorted((a, b) for a, b, _ in want) and (0, 12) in {(a, b) for a, b, _ in got}
    assert all(abs(x[2] - y[2]) < 2e-6 for x, y in zip(got, sorted(want), strict=True))


SRT = "﻿1\r\n00:00:01,000 --> 00:00:02,500\r\nHello\r\nthere\r\n\r\nbroken block\r\n\r\n3\r\n100:00:00,001 --> 100:00:01,000\r\n\r\n4\n00:01:00.5 --> x\n\n5\n00:00:09,000 --> 00:00:10,000\nlast, one"
VTT = "WEBVTT Kind: captions\n\nNOTE 00:00 is no time\n\nSTYLE\n::cue { color: red }\n\nintro\n01:02.003 --> 01:03.000 align:start\nshort\n\n00:00:05.000 --> 00:00:06.000\n<b>two</b>\nlines\n"
ASS = "[Script Info]\nTitle: x\n\n[V4+ Styles]\nFormat: Name, Fontname\nStyle: D,Arial\n\n[Events]\nFormat: Layer, Start, End, Style, Name, Text\nComment: 0,0:00:00.00,0:00:01.00,D,,no\nDialogue: 0,0:00:01.05,0:00:02.50,D,,Well, {\\k20}yes\\Nno\nDialogue: 0,bad,0:00:02.50,D,,x\nDialogue: 0,1:00:00.00,1:00:00.10,D,,\n"


@pytest.mark.parametrize(("form", "body", "want"), [
    ("srt", SRT, [(1000, 2500, "Hello\nthere"), (360000001, 360001000, ""), (9000, 10000, "last, one")]),
    ("vtt", VTT, [(62003, 63000, "short"), (5000, 6000, "<b>two</b>\nlines")]),
    ("ass", ASS, [(1050, 2500, "Well, yes\nno"), (3600000, 3600100, "")]),
    ("srt", "", []), ("vtt", "WEBVTT", []), ("ass", "nothing", []),
])
def test_captions_as_others_write_them(spark, tmp_path, form, body, want):
    (tmp_path / f"a.{form}").write_bytes(body.encode())
    got = captions.read(spark, str(tmp_path), form).orderBy("cue").collect()
    assert [(r.start_ms, r.end_ms, r.text) for r in got] == want and [r.cue for r in got] == list(range(len(want)))
    assert all(r.file.endswith(f"a.{form}") for r in got)


def test_captions_of_other_forms_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="form"):
        captions.read(spark, str(tmp_path), "sub")


def test_captions_as_a_stream(spark, tmp_path):
    seen = []
    for k in range(2):
        folder = tmp_path / "in" / f"video_id={k}"
        folder.mkdir(parents=True)
        (folder / "x.srt").write_text(f"1\n00:00:0{k},000 --> 00:00:09,000\nv{k}\n")
        stream = captions.read(spark, str(tmp_path / "in"), "srt", stream=True, schema="video_id long")
        stream.writeStream.foreachBatch(lambda df, _: seen.extend((r.video_id, r.start_ms, r.text) for r in df.collect())).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [(0, 0, "v0"), (1, 1000, "v1")]


def test_edited_captions_come_back(spark, tmp_path):
    sentences = spark.createDataFrame([(1, 0, "a", 0, 1000, "helo"), (1, 5, "b", 2000, 3000, "world"), (2, 0, "a", 0, 10, "x")], "video_id long, sent_idx long, speaker string, start_ms long, end_ms long, text string")
    body = C.srt(sentences).where("video_id = 1").first().body.replace("helo", "hello").replace("00:00:03,000", "00:00:03,500")
    (tmp_path / "video_id=1").mkdir()
    (tmp_path / "video_id=1" / "x.srt").write_text(body)
    read = captions.read(spark, str(tmp_path), "srt").withColumn("video_id", F.col("video_id").cast("long"))
    assert rows(captions.edited(sentences, read)) == [(1, 0, "a", 0, 1000, "hello"), (1, 5, "b", 2000, 3500, "world"), (2, 0, "a", 0, 10, "x")]


def test_words_of_no_length_stay_in_clips(spark):
    words = spark.createDataFrame([(1, 0, k, s, e, w) for k, (s, e, w) in enumerate([(0, 10, "a"), (15, 15, "b"), (20, 30, "c"), (5, 5, "edge"), (40, 40, "end")])], "video_id long, sent_idx long, word_idx long, start_ms long, end_ms long, word string")
    clips = spark.createDataFrame([(1, 7, 5, 40)], "video_id long, clip_id long, start_ms long, end_ms long")
    one = silence.cut(words, 5, 40).select("sent_idx", "word_idx", "start_ms", "end_ms", "word")
    assert rows(one) == rows(silence.clip_words(words, clips).drop("clip_id"))
    assert [r.word for r in one.orderBy("word_idx").collect()] == ["a", "b", "c"]


def test_platform_profiles_are_few(spark, monkeypatch):
    clips = spark.createDataFrame([(1, 50), (2, 90)], "clip_id long, duration_ms long")
    profiles = spark.createDataFrame([("A", 60), ("B", None)], "platform string, max_duration_ms long")
    assert rows(planning.platform_plan(clips, profiles).select("clip_id", "platform", "fits")) == [(1, "A", True), (1, "B", None), (2, "A", False), (2, "B", None)]
    monkeypatch.setattr(planning, "PROFILES", 1)
    with pytest.raises(ValueError, match="profiles"):
        planning.platform_plan(clips, profiles)


@pytest.mark.parametrize("width", [1, 7, 50, 10**6, None])
def test_asof_carries_over_cuts(spark, width):
    from cliploom.operators.intervals import asof

    rng = random.Random(width or 0)
    ranges = [(rng.randrange(3), rng.choice("abc"), rng.randrange(0, 200)) for _ in range(30)] + [(1, None, 50), (None, "z", 1), (2, "x", None)]
    points = [(k, rng.randrange(4), rng.randrange(-5, 210)) for k in range(80)] + [(900, None, 5), (901, 1, None)]
    got = {r.pid: (r.label, r.since_ms) for r in asof(spark.createDataFrame(points, "pid long, v long, ts_ms long"), spark.createDataFrame(ranges, "v long, label string, start_ms long"), "v", "pid", "label", width).collect()}
    want = {}
    for k, v, t in points:
        begun = [(s, x is not None, x or "") for w, x, s in ranges if w == v and v is not None and s is not None and t is not None and s <= t]
        want[k] = ((max(begun)[2] or None), max(begun)[0]) if begun else (None, None)
    assert got == want


@pytest.mark.parametrize("name, least", [("captions_read", 3), ("settings_files", 1), ("library_layout", 1), ("caption_files", 1), ("media_listing", 1)])
def test_files_do_not_grow_with_keys(spark, tmp_path, name, least):
    """As many files as tasks and shelves, not one for each video or supplier."""
    spark.range(400).selectExpr("id AS conv_id", "1L AS turn", "'user' AS role", "'a b' AS text").repartition(1).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.range(400).selectExpr("id AS s_suppkey", "'s' AS s_name", "1 AS s_nationkey", "0D AS s_acctbal").repartition(1).write.parquet(f"{tmp_path}/supplier.parquet")
    before = set(storage.folders())
    assert registry.queries()[name](spark, str(tmp_path)).count() >= 400
    made = [f for p in set(storage.folders()) - before for f in Path(p.removeprefix("file://")).rglob("part-*")]
    assert least <= len(made) <= files.SHELVES
