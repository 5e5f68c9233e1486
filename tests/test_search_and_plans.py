"""Fresh indexes, snippets, phrases and clips that don't overlap."""

import itertools
import os
import random
import re
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cliploom.functions import text
from cliploom.operators import phrases, planning, scheduling, search
from cliploom.plans import shared, transcripts


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_search_sees_a_changed_table(spark, sf_dir, tmp_path):
    """The index is written again once the table's files differ, and read as it is until then."""
    for name in ("documents", "conversations"):
        source = Path(sf_dir, f"{name}.parquet")
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / source.name)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = transcripts.fts_match(spark, str(tmp_path)).count()
    said = transcripts.fts_by_speaker(spark, str(tmp_path)).count()
    held = shared._indexes[spark.sparkContext.applicationId, "library", str(tmp_path)]
    assert transcripts.fts_match(spark, str(tmp_path)).count() == before and shared._indexes[spark.sparkContext.applicationId, "library", str(tmp_path)] == held
    few = docs.where("doc_id < 5").toPandas()
    few.to_parquet(tmp_path / "documents.parquet")
    want = {i for i, t in zip(few.doc_id, few.text, strict=True) if {"idiot", "license", "nicht"} & set(re.findall(r"\w+", t.lower()))}
    assert {r.doc_id for r in transcripts.fts_match(spark, str(tmp_path)).collect()} == want
    assert len(want) < before and said == transcripts.fts_by_speaker(spark, str(tmp_path)).count()
    assert not os.path.exists(held[1].removeprefix("file://"))


DOCS = [(1, "the cat, and The Dog"), (2, "dog x x cat x dog cat"), (3, "only a dog"), (4, None), (5, ""), (6, "قِطَّة و كَلب!")]


def index(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return df, search.postings(df), search.lengths(df)


def test_postings_are_counted_where_documents_are_read(spark, monkeypatch):
    """No shuffle; rows of equal id, null among them, are one document."""
    monkeypatch.setattr(search, "TOKENS", 4)
    docs = [*DOCS, (7, "x y x"), (None, "n m n")]
    got = search.postings(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got.where("doc_id = 2").select("token", "tf", "positions")) == [("cat", 2, [3, 6]), ("dog", 2, [0, 5]), ("x", 3, [1, 2, 4])]
    twice = search.postings(spark.createDataFrame([*docs, (7, "y z"), (None, "m")], "doc_id long, text string"))
    assert rows(twice.where("doc_id = 7").select("token", "tf", "positions")) == [("x", 2, [0, 2]), ("y", 2, [0, 1]), ("z", 1, [1])]
    assert rows(twice.where("doc_id is null").select("token", "tf", "positions")) == [("m", 2, [0, 1]), ("n", 2, [0, 2])]
    assert twice.where("doc_id < 7").count() == got.where("doc_id < 7").count()


def test_shortest_windows(spark):
    df, posted, sizes = index(spark, DOCS)
    assert rows(search.windows(posted, ["cat", "dog"])) == [(1, 1, 4), (2, 5, 2)]
    assert rows(search.windows(posted, ["dog", "dog"])) == [(1, 4, 1), (2, 0, 1), (3, 2, 1)]
    assert rows(search.windows(posted, ["dog", "zebra"])) == []


def test_windows_by_brute_force(spark):
    rng = random.Random(4)
    docs = [(k, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(60)))) for k in range(80)]
    words = ["a", "b", "c", "d"]
    want = []
    for k, t in docs:
        w = t.split()
        runs = [(j - i, i) for i in range(len(w)) for j in range(i + 1, len(w) + 1) if set(words) <= set(w[i:j])]
        if runs:
            want.append((k, min(runs)[1], min(runs)[0]))
    assert rows(search.windows(index(spark, docs)[1], words)) == want


def test_snippets_show_the_text_as_it_is(spark):
    df, posted, sizes = index(spark, DOCS)
    found = search.passages(posted, sizes, ["cat", "dog"])
    got = {r.doc_id: r.snippet for r in search.snippets(df, found, ["cat", "dog"], around=0).collect()}
    assert got == {1: "… <b>cat</b>, and The <b>Dog</b>", 2: "… <b>dog</b> <b>cat</b>"}
    arabic = search.snippets(df, search.passages(posted, sizes, ["كلب"]), ["كلب"], around=1, marks=("[", "]"))
    assert [r.snippet for r in arabic.collect()] == ["… و [كَلب]"]


def test_pieces_match_tokens(spark):
    odd = ["", "x", "--", "a-b", "İstanbul İİ", "َ a ـ ب َج", "q٣٤ źx", "é", "日本 語", "abـcd"]
    df = spark.createDataFrame([(t,) for t in odd], "text string").select("text", text.pieces(F.col("text")).alias("p"), text.tokens(F.col("text")).alias("t"))
    for r in df.collect():
        assert len(r.p) == len(r.t), r
        assert all(t in "".join(c for c in p.lower() if c not in "ًٌٍَُِّْـ") for p, t in zip(r.p, r.t, strict=True)), r


def counted(docs, listed):
    out = {}
    for k, t in docs:
        w = (t or "").split()
        for p in {" ".join(x.lower().split()) for x in listed if x.split()}:
            q = p.split()
            n = sum(w[i : i + len(q)] == q for i in range(len(w)))
            if n:
                out[k, p] = n
    return sorted((*k, n) for k, n in out.items())


@pytest.mark.parametrize("most", [1000, 0])
def test_phrases_by_brute_force(spark, most):
    rng = random.Random(8)
    docs = [(k, " ".join(rng.choice("abc") for _ in range(rng.randrange(40)))) for k in range(60)] + [(90, None), (91, "z y z y z")]
    listed = ["a", "a b", "b a b", "a b a b", "c c c", "c c", "A  B", "z y z", "q a", "", "abc abc"]
    got = phrases.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(x,) for x in listed], "word string"), most)
    assert rows(got) == counted(docs, listed)


def test_a_listed_phrase_is_flagged(spark):
    docs = spark.createDataFrame([(1, "Shut UP now, shut-up!"), (2, "shutup"), (3, "shut the up")], "doc_id long, text string")
    assert rows(planning.flags(docs, spark.createDataFrame([("shut up",), ("now",)], "word string"))) == [(1, "now", 1), (1, "shut up", 2)]


def test_failure_links_find_phrases_within_others():
    trie = phrases.Trie([["a", "b", "c"], ["b"], ["b", "c"], ["c", "a"]])
    assert trie.count("a b c a b d b c".split()) == {0: 1, 1: 3, 2: 2, 3: 1}


def chosen(clips, k):
    own = sorted((c for c in clips if c[3] > 0), key=lambda c: (c[1], c[2], c[0]))
    best = None
    for n in range(k + 1):
        for s in itertools.combinations(range(len(own)), n):
            if all(own[b][1] >= own[a][2] for a, b in itertools.pairwise(s)):
                key = (-sum(own[i][3] for i in s), n, s)
                best = key if best is None or key < best else best
    return {own[i][0] for i in best[2]}


@pytest.mark.parametrize("fan", [2, 64])
def test_clips_that_do_not_overlap_by_brute_force(spark, fan):
    rng = random.Random(9)
    clips = []
    for video in range(12):
        for k in range(rng.randrange(1, 11)):
            start = rng.randrange(60)
            clips.append((video, k, start, start + rng.randrange(0, 12), "story", float(rng.randrange(-1, 6))))
    df = spark.createDataFrame([*clips, (99, 1, None, 5, "story", 1.0), (None, 1, 2, 5, "story", 1.0)], "video_id long, moment_id long, start_ms long, end_ms long, moment_type string, score double")
    got = scheduling.best_apart(df, 3, fan)
    for video in range(12):
        assert {r.moment_id for r in got.where(f"video_id = {video}").collect()} == chosen([c[1:4] + (c[5],) for c in clips if c[0] == video], 3), video
    assert got.where("video_id = 99 or video_id is null").isEmpty()
    assert got.columns == df.columns


def test_many_islands_are_joined(spark):
    df = spark.range(500).selectExpr("1L AS video_id", "id AS moment_id", "id * 10 AS start_ms", "id * 10 + 15 AS end_ms", "cast(id % 97 AS double) AS score").where("moment_id % 3 != 0")
    got = [r.moment_id for r in scheduling.best_apart(df, 5, fan=4).orderBy("moment_id").collect()]
    own = sorted((r.moment_id, r.score) for r in df.collect())
    assert sum(s for m, s in own if m in got) == 96 * 3 + 95 * 2 and len(got) == 5
