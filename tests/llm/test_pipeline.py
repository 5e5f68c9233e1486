"""The pipeline against a version in plain Python, stage by stage."""

import random
import zlib

import corpus_pipeline as C
from cliploom.llm import packing, simhash
from cliploom.llm import queries as Q

from test_dedup import cut, groups, plain_fingerprint, runs

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


#: Not learned from: its crc32 leaves 0 modulo 5.
FOREIGN = next(k for k in range(60, 99) if zlib.crc32(str(k).encode()) % 5 == 0)


def documents(spark):
    rng = random.Random(11)
    word = lambda: rng.choice(["the", "house", "of", "many", "rooms", "stands", "under", "trees", "and", "rain"]) + str(rng.randrange(50))
    line = lambda: " ".join(word() for _ in range(20))
    texts = {k: "\n".join(line() for _ in range(6)) for k in range(40)}
    passage = " ".join(word() for _ in range(60))
    for k in (3, 9, 14):
        texts[k] += "\n" + passage
    texts[20] = texts[19]
    texts[21] = texts[18].replace("the", "thy", 1)
    texts[22] = "\n".join(texts[17].split("\n")[:4]) + "\n" + line()
    texts |= {50: "", 51: "123 456", 52: "A.", FOREIGN: "\u8fd9\u4efd\u6587\u4ef6\u7528\u53e6\u4e00\u79cd\u8bed\u8a00\u5199\u6210" * 4}
    return texts, spark.createDataFrame([(k, t, "en", "src", len(t)) for k, t in texts.items()] + [(53, None, None, None, None)], DOCS)


def test_stages(spark):
    texts, df = documents(spark)
    one = C.languages(spark, df, "")
    kept = {r.doc_id: r.text for r in one.collect()}
    assert kept == {k: t for k, t in texts.items() if k not in (50, 51, FOREIGN)}
    two = C.lines(spark, one, "")
    want = {k: t for k, t in runs(kept, 3).items() if t}
    assert {r.doc_id: r.text for r in two.collect()} == want
    three = C.near_copies(spark, two, "")
    ids = sorted(want)
    first = groups(ids, [plain_fingerprint(want[k]) for k in ids], simhash.DISTANCE)
    want = {k: want[k] for k in ids if first[k] == k}
    assert {r.doc_id: r.text for r in three.collect()} == want
    four = C.passages(spark, three, "")
    sizes = dict(zip(want, cut(want.values(), C.PASSAGE), strict=True))
    got = {r.doc_id: r for r in four.collect()}
    assert {k: len(r.text.encode()) for k, r in got.items()} == {k: n - gone for k, (n, gone, *_) in sizes.items() if n > gone}
    assert any(gone for _, gone, *_ in sizes.values())
    assert four.columns == df.columns and all(r.n_chars == len(r.text) and r.source == "src" for r in got.values())
    words = packing.Words(__import__("public_tokenizers").path(Q.WORD_FILE))
    pieces = C.sequences(spark, four, "").collect()
    for k, r in got.items():
        own = sorted((p for p in pieces if p.doc_id == k), key=lambda p: p.start)
        assert b"".join(bytes(p.ids) for p in own) == words.encode(r.text) + packing.END.to_bytes(4, "little")


def test_repeated_rows_null_ids_and_nothing(spark):
    text = "one fine day of rain and some more words to fill the line"
    df = spark.createDataFrame([(1, text, "en", "s", 1), (1, text, "en", "s", 1), (None, text, "en", "s", 1), (None, "quite another text about nothing in particular", "en", "s", 1)], DOCS)
    assert sorted(repr(r.doc_id) for r in C.near_copies(spark, df, "").collect()) in (["1", "None"], ["None", "None"])
    empty = spark.createDataFrame([], DOCS)
    for _, stage in C.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_run(spark, sf_dir):
    rows = C.run(spark, sf_dir)
    assert rows.count() > 0 and {"doc_id", "sequence_id", "ids"} <= set(rows.columns)
