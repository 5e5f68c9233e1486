"""The pipeline's near copies against brute-force Jaccard."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline as C
from cliploom.llm import near_copies


def sets(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def groups(texts, alike=0.8):
    own, parent = {k: sets(t) for k, t in texts.items()}, {k: k for k in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in texts:
        for j in texts:
            if j < i and len(own[i] & own[j]) >= alike * len(own[i] | own[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in texts}


def corpus():
    rng = random.Random(21)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(400))
    texts = []
    for n in (12, 60, 120, 300):
        for _ in range(6):
            base = [word() for _ in range(n)]
            texts.append(base)
            for share in (0.01, 0.015, 0.02, 0.025, 0.03, 0.05):  # Jaccard from about 0.9 to 0.6
                copy = list(base)
                for at in rng.sample(range(n), max(1, round(share * n))):
                    copy[at] = word()
                texts.append(copy)
    chain = [word() for _ in range(200)]
    texts += [chain[15 * k : 15 * k + 120] + [word() for _ in range(2)] for k in range(6)]
    passage = [word() for _ in range(40)]
    texts += [[word() for _ in range(30)] + passage for _ in range(40)]
    texts += [passage + [word() for _ in range(rng.randrange(1, 6))] for _ in range(40)]  # a large group
    rng.shuffle(texts)
    return {k: " ".join(t) for k, t in enumerate(texts)} | {900: "One", 901: "one", 902: "two words"}


def test_near_copies_by_brute_force(spark, monkeypatch):
    texts = corpus()
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    want = groups(texts)
    assert {r.doc_id for r in C.near_copies(spark, df, "").collect()} == {k for k, v in want.items() if k == v}
    monkeypatch.setattr(near_copies, "COMMON", 1 << 30)  # another order, lists in tiles, with and without leaders
    monkeypatch.setattr(near_copies, "LONG", 8)
    for rounds in (0, 1):
        assert {r.doc_id: r.component_id for r in near_copies.jaccard_groups(df, tile=8, rounds=rounds).collect()} == want


def test_sketches_drop_no_pair_that_is_alike():
    rng = np.random.default_rng(1)
    for n in (1, 5, 300, 5000):
        base = rng.integers(0, 2**64, n, dtype=np.uint64)
        other = np.concatenate((base[: n - n // 10], rng.integers(0, 2**64, n // 10, dtype=np.uint64)))
        far = rng.integers(0, 2**64, n, dtype=np.uint64)
        rows = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([4, 5, 6]), *(pa.array([near_copies.sketch(np.unique(x)) for x in side], pa.binary()) for side in ((base, base, base), (base, other, far)))], ["a", "b", "x", "y"])
        kept = next(near_copies._maybe(0.8)([rows]))["a"].to_pylist()
        assert kept[:2] == [1, 2] and (n != 300 or 3 not in kept)
    assert near_copies.sketch(np.arange(70000, dtype=np.uint64)) == b""


def test_shared_counts_by_brute_force(monkeypatch):
    rng = np.random.default_rng(5)
    for light, chunk in ((48, 1 << 20), (3, 64), (0, 16)):
        monkeypatch.setattr(near_copies, "LIGHT", light)
        monkeypatch.setattr(near_copies, "CHUNK", chunk)
        own = [np.unique(rng.integers(0, 30, rng.integers(0, 20))) for _ in range(40)]
        row, name = np.repeat(np.arange(40), [len(x) for x in own]), np.concatenate(own)
        for left, right in ((np.arange(40), np.arange(40)), (np.arange(0, 25), np.arange(25, 40)), (np.array([3, 30]), np.array([7]))):
            got = near_copies.shared(row, name, left, right)
            assert all(got[i, j] == len(np.intersect1d(own[a], own[b])) for i, a in enumerate(left) for j, b in enumerate(right) if a != b)
    assert near_copies.shared(np.zeros(0, np.int32), np.zeros(0, np.int64), np.arange(2), np.arange(2)).tolist() == [[0, 0], [0, 0]]


def test_a_tile_of_long_texts_takes_little_memory():
    """2048 texts of 20,000 words in one list, each in 4000 long lists of 24 others: the tiles that ENTRIES allows."""
    tile = near_copies.ENTRIES // 4000
    rng = np.random.default_rng(6)
    lists = [np.concatenate(([-1], np.unique(rng.integers(0, tile * 4000 // 24, 4000)))) for _ in range(2 * tile)]
    side = np.repeat([1, 2], tile)
    columns = {"key": np.full(2 * tile, -1), "i": np.zeros(2 * tile, int), "j": np.ones(2 * tile, int), "side": side, "node": np.arange(2 * tile), "n": np.full(2 * tile, 20000), "pos": np.zeros(2 * tile, int), "root": np.arange(2 * tile), "short": np.zeros(2 * tile, int)}
    batch = pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns.values()), pa.array(lists, pa.list_(pa.int64())), pa.array([b""] * 2 * tile, pa.binary())], [*columns, "lists", "sketch"])
    tracemalloc.start()
    found = sum(x.num_rows for x in near_copies._met(0.8)([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 0 and peak < 400e6
