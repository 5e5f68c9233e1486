"""Suffix, line, SimHash and embedding deduplication against brute force."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from cliploom.llm import components, line_dedup, pivots, simhash, suffix_dedup
from cliploom.llm import queries as Q
from oracle import differences

DOCS = "doc_id long, text string, lang string, h long, marks string"


def frame(spark, texts):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(k, t, "en", 1, "x") for k, t in texts], DOCS)


def prose(rng, n, letters="abcdefgh "):
    return "".join(rng.choice(letters) for _ in range(n))


def cut(texts, length):
    """(n_bytes, n_removed, n_spans, hash of what stays) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out.append((len(b), len(b) - len(kept), int((gone[:-1] & ~np.concatenate(([False], gone[:-1]))[:-1]).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "window"), [(40, 16), (60, 25)])
def test_suffix_dedup_is_exact(spark, length, window):
    rng = random.Random(5)
    shared = [prose(rng, n) for n in (length - 1, length, length + 1, 90, 200)]
    texts = ["", None, "short", "é" * 70, "ab" * 80, "z" * 300]
    texts += [prose(rng, 30) + rng.choice(shared) + prose(rng, 50) + rng.choice(shared) for _ in range(25)]
    near = prose(rng, 400)
    texts += [near[: 37 * k] + "#" + near[37 * k + 1 :] for k in range(9)] + [near, near]
    got = suffix_dedup.suffix_dedup(frame(spark, enumerate(texts)), length, window).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == cut(texts, length)
    assert all(r.kept_text == bytes(r.kept).decode("utf-8", "ignore") for r in got)


@pytest.mark.parametrize("size", [37, 150, 1000])
def test_anchors_of_long_texts_in_slices(size):
    """Every start belongs to one row, and the anchors are those of the whole text."""
    rng = random.Random(size)
    shared = [prose(rng, n) for n in (39, 40, 41, 90, 333)]
    texts = ["", None, "ab" * 300, "z" * 500, "é" * 200]
    texts += ["".join(prose(rng, rng.randrange(5, 90)) + rng.choice(shared) for _ in range(30)) for _ in range(4)] + [shared[4] + prose(rng, 20), prose(rng, 2500)]
    texts += [texts[5][:700] + "#" + texts[5][701:]]
    data = [(t or "").encode() for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(data))), pa.array([t.decode() for t in data])], ["key", "text"])
    whole = {(r["key"], r["at"] // 16**2): r for r in anchors_of(batch, 40, 16, 1 << 20)}
    cut_ = anchors_of(batch, 40, 16, size)
    starts = lambda rows: sorted((r["key"], r["at"] // 16**2 + k) for r in rows for k in range(r["at"] // 16 % 16 + 1))
    assert starts(whole.values()) == starts(cut_) == sorted((k, i) for k, b in enumerate(data) for i in range(len(b) - 39))
    assert {(r["key"], r["at"] // 16**2 + r["at"] % 16, r["core"]) for r in cut_} == {(r["key"], r["at"] // 16**2 + r["at"] % 16, r["core"]) for r in whole.values()}


def test_suffix_dedup_of_a_text_in_slices(spark):
    rng = random.Random(12)
    part = [prose(rng, n) for n in (700, 401)]
    # digits, so that no repeat goes on by chance
    long = "1".join((prose(rng, suffix_dedup.SLICE - 300), part[0] + "2" + prose(rng, 900) + "3" + part[1] + "4" + prose(rng, 500) + "5" + part[0] + "6" + prose(rng, suffix_dedup.SLICE - 900) + "7" + part[1]))
    wide = "\u00e9" * (suffix_dedup.SLICE // 2 + 50)  # more bytes than a slice has, fewer characters
    texts = [long, "8" + part[0][100:] + "x" + part[1], prose(rng, 30), "9" + wide, wide + "0"]
    got = suffix_dedup.suffix_dedup(frame(spark, enumerate(texts))).orderBy("doc_id").collect()
    covered = np.zeros(len(long), bool)
    for p in part:
        at = long.find(p)
        while at >= 0:
            covered[at : at + len(p)] = True
            at = long.find(p, at + 1)
    assert got[0].kept_text == "".join(c for c, gone in zip(long, covered, strict=True) if not gone)
    assert (got[1].kept_text, got[1].n_spans, got[2].n_removed) == ("8x", 2, 0)
    assert (got[3].kept_text, got[4].kept_text) == ("9", "0")


def anchors_of(batch, length, window, size):
    before, suffix_dedup.SLICE = suffix_dedup.SLICE, size
    try:
        return [r for b in suffix_dedup._anchors(length, window)(iter([batch])) for r in b.to_pylist()]
    finally:
        suffix_dedup.SLICE = before


def test_suffix_dedup_takes_little_memory_for_a_long_text():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 123, 6_000_000, dtype=np.uint8).tobytes().decode()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["key", "text"])
    tracemalloc.start()
    n = sum(b.num_rows for b in suffix_dedup._anchors(400, 128)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 50_000 and peak < 250e6


def test_spans_by_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(200):
        size = int(rng.integers(1, 60))
        begins = rng.integers(0, size, rng.integers(1, 9))
        marks = np.stack((begins, begins + rng.integers(1, 20, len(begins))), 1)
        covered = np.zeros(size + 2, int)
        for i, j in marks:
            covered[i + 1 : min(j, size) + 1] = 1
        edges = np.diff(covered)
        got = suffix_dedup.spans_of(marks, size)
        assert (got[0].tolist(), got[1].tolist()) == (np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist())


def test_suffix_dedup_production_length(spark):
    rng = random.Random(6)
    part = prose(rng, 500)
    texts = [prose(rng, 900) + part + prose(rng, 700), part, prose(rng, 100) + part[:399], part[3:403] + prose(rng, 10), "q" * 3000]
    got = suffix_dedup.suffix_dedup(frame(spark, enumerate(texts))).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == cut(texts, 400)


def test_suffix_dedup_repeated_rows_and_null_ids(spark):
    rng = random.Random(7)
    a, b = prose(rng, 100), prose(rng, 100)
    got = suffix_dedup.suffix_dedup(frame(spark, [(1, a), (1, a), (None, b), (None, prose(rng, 100)), (2, "x")]), 40, 16).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in got) == [(False, 0), (False, 100), (False, 100), (True, 0), (True, 0)]
    assert suffix_dedup.suffix_dedup(frame(spark, [])).count() == 0


def test_line_dedup_equals_sql(spark, sf_dir):
    assert differences(Q.op5_line_dedup(spark, sf_dir), Q.oracle_sql()["op5_line_dedup"], sf_dir) == ""


def runs(texts, least):
    first, out = {}, {}
    for d, t in sorted(texts.items()):
        lines = t.split("\n")
        gone = set()
        for i in range(len(lines) - least + 1):
            key = tuple(lines[i : i + least])
            if first.setdefault(key, (d, i)) != (d, i):
                gone.update(range(i, i + least))
        out[d] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


@pytest.mark.parametrize("least", [2, 3, 5])
def test_line_dedup_is_exact(spark, least):
    rng = random.Random(8)
    texts = {k: "\n".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for k in range(30)}
    texts |= {90: "", 91: "\n" * 9, 92: "r\n" * 400}
    got = line_dedup.line_dedup(frame(spark, texts.items()), least, carry=("lang", "marks")).collect()
    assert {r.doc_id: r.kept for r in got} == runs(texts, least)
    assert {(r.lang, r.marks) for r in got} == {("en", "x")}


def test_line_dedup_edge_rows(spark):
    got = line_dedup.line_dedup(frame(spark, [(None, "a\nb\nc"), (1, "a\nb\nc"), (1, "a\nb\nc"), (2, None)])).collect()
    assert sorted((repr(r.doc_id), r.n_removed, r.n_lines) for r in got) == [("1", 3, 3), ("1", 3, 3), ("2", 0, 1), ("None", 0, 3)]
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0


def plain_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(s))


def groups(ids, prints, distance):
    parent = {i: i for i in range(len(ids))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


def test_simhash_is_exact(spark):
    rng = random.Random(9)
    base = ["".join(prose(rng, 600)) for _ in range(6)]
    texts = ["", None, "  \t", "One", "one", "É é", "a b", "A B c", "x\x0by\x0cz w"] + base
    for t in base:
        for _ in range(8):
            w = t.split(" ")
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    prints = [plain_fingerprint(t) for t in texts]
    got = simhash.simhash_groups(frame(spark, enumerate(texts)), tile=8).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {k: f"{p:016x}" for k, p in enumerate(prints)}
    assert {r.doc_id: r.component_id for r in got} == groups(list(range(len(texts))), prints, 3)


def test_every_pair_within_three_bits_links(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 60, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, k % 5, replace=False)) for k in range(60)]
    b = a ^ np.array(flips, np.uint64)
    both = sorted({int(x) for x in np.concatenate((a, b)).view(np.int64)})
    df = simhash.links(spark.createDataFrame([(x,) for x in both], "fp long"), tile=16)
    roots = {r.node: r.root for r in components.connected(df, "a", "b").collect()}
    want = groups(both, [x & (2**64 - 1) for x in both], 3)
    assert all(roots.get(x, x) == want[x] for x in both)


def test_simhash_edge_rows(spark):
    got = simhash.simhash_groups(frame(spark, [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "other words stand here")])).collect()
    assert sorted((repr(r.doc_id), repr(r.component_id)) for r in got) == [("5", "5"), ("5", "5"), ("None", "5"), ("None", "None")]
    assert simhash.simhash_groups(frame(spark, [])).count() == 0


def test_components_of_long_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 150)] + [(7, 7), (3, 2), (200, None)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 150)}


VECTORS = "vec_id long, embedding array<float>, label int, n int"


def plain_links(rows, threshold=0.93):
    n, ids = Counter(), [r[0] for r in rows]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def unit(v):
        v = None if v is None or not len(v) or any(x is None for x in v) else np.array(v, float)
        return None if v is None or not np.isfinite(v).all() or not v.any() else v / np.linalg.norm(v)

    u = [unit(r[1]) for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            if u[i] is not None and u[j] is not None and len(u[i]) == len(u[j]) and rows[i][2] == rows[j][2] is not None and u[i] @ u[j] >= threshold:
                n[ids[i]] += 1
                n[ids[j]] += 1
                a, b = find(ids[i]), find(ids[j])
                parent[max(a, b)] = min(a, b)
    return {i: (n[i], find(i)) for i in ids}


def test_embeddings_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 64))
    rows = []
    for k in range(400):
        c = centres[k % 40]
        v = c + rng.normal(size=64) * rng.uniform(0.05, 0.4)
        rows.append((k, [float(x) for x in v.astype(np.float32)], k % 40 % 3, 1))
    rows += [(400 + k, rows[k][1], rows[k][2], 1) for k in range(50)]
    want = plain_links(rows)
    got = {r.vec_id: r for r in pivots.embedding_groups(spark.createDataFrame(rows, VECTORS), tile=32).collect()}
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    assert sum(got[i].n_links for i in want) >= 0.9 * sum(n for n, _ in want.values()) > 0
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


@pytest.mark.parametrize("share", [1 / 3, 0.8])
def test_embeddings_recall_with_one_large_group(spark, share):
    rng = np.random.default_rng(6)
    n, centre = 900, rng.normal(size=64)
    v = rng.normal(size=(n, 64))
    v[: int(n * share)] = centre + v[: int(n * share)] * 0.23  # cosines about 0.95
    rows = [(int(k), [float(x) for x in v[k].astype(np.float32)], 1, 1) for k in rng.permutation(n)]
    want = plain_links(rows)
    got = {r.vec_id: r for r in pivots.embedding_groups(spark.createDataFrame(rows, VECTORS), tile=256).collect()}
    assert all(got[i].n_links <= m for i, (m, _) in want.items())
    assert sum(got[i].n_links for i in want) >= 0.9 * sum(m for m, _ in want.values()) > 0


@pytest.mark.parametrize(("share", "noise"), [(0.3, 0.1), (0.6, 0.2)])
def test_embeddings_recall_with_a_crowded_label(spark, share, noise):
    rng = np.random.default_rng(8)
    n, centre = 3000, rng.normal(size=64)
    v = rng.normal(size=(n, 64))
    v[: int(n * share)] = centre + v[: int(n * share)] * noise  # cosines about 0.99 and 0.96
    v = v.astype(np.float32).astype(float)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = (u @ u.T >= 0.93).sum(axis=1) - 1
    rows = [(k, v[k].tolist(), 1, 1) for k in range(n)]
    got = np.array([r.n_links for r in pivots.embedding_groups(spark.createDataFrame(rows, VECTORS)).orderBy("vec_id").collect()])
    assert (got <= want).all()
    assert got.sum() >= 0.9 * want.sum() > 0


def test_few_candidates_among_spread_vectors():
    """A vector of an evenly spread label meets about as many candidates at every size."""
    rng = np.random.default_rng(9)
    met = []
    for n in (1000, 4000):
        x = rng.normal(size=(n, 64))
        m = 1 << int(np.ceil(np.log2(pivots.GROWTH * np.sqrt(n))))
        near = np.argpartition(-(x @ pivots.filled(np.zeros((0, 64)), m).T), pivots.NEAR - 1, axis=1)[:, : pivots.NEAR]
        has = np.zeros((n, m), np.float32)
        np.put_along_axis(has, near, 1, axis=1)
        met.append(((has @ has.T) >= pivots.SHARED).sum() / n)
    assert met[1] < 1.5 * met[0]


def test_embeddings_with_equally_near_pivots(spark):
    rows = [(k, [float(k % 4 == i) for i in range(4)], 1, 1) for k in range(12)] + [(20 + k, [1.0, 1.0, 1.0, 1.0], 1, 1) for k in range(3)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivots.embedding_groups(spark.createDataFrame(rows, VECTORS), pivots=8, tile=2).collect()}
    assert got == plain_links(rows)


def test_embeddings_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1, 1), (1, [2.0, 0.0], 1, 1), (2, [1.0, 0.0], 2, 1), (3, [1.0, 0.0], None, 1), (4, None, 1, 1), (5, [0.0, 0.0], 1, 1), (6, [nan, 1.0], 1, 1), (7, [inf, 1.0], 1, 1), (8, [], 1, 1), (9, [1.0, None], 1, 1), (10, [1.0], 1, 1), (11, [-1.0, 0.0], 1, 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivots.embedding_groups(spark.createDataFrame(rows, VECTORS)).collect()}
    assert got == plain_links(rows)
    assert pivots.embedding_groups(spark.createDataFrame([], VECTORS)).count() == 0


def test_names_of_strings_that_double_by_a_rule():
    """Thue-Morse strings of 1024 letters and more agree modulo 2**64 under any base; a prime tells them apart."""
    from cliploom.llm.common import Ranges

    for size in (128, 1024, 2048):
        a = np.array([97 + bin(k).count("1") % 2 for k in range(size)], np.uint8)
        data = np.concatenate((a, 195 - a, a))
        name = Ranges(data, 2, prime=True).name(np.array([0, size, 2 * size]), np.array([size, 2 * size, 3 * size]))
        assert name[0] == name[2] != name[1]


def test_suffix_dedup_of_long_and_repetitive_texts(spark):
    rng = random.Random(12)
    long = prose(rng, 60_000)
    texts = [(1, long), (2, "z" * 20_000), (3, "z" * 410), (4, "ab" * 3000), (5, prose(rng, 500) + long[100:1700] + prose(rng, 500)), (6, "z" * 399)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(frame(spark, texts)).collect()}
    assert [got[k] for k, _ in texts] == cut([t for _, t in texts], 400)


def test_repeated_runs_are_maximal(spark):
    rng = random.Random(13)
    texts = {k: "\n".join(rng.choice("abcd") for _ in range(rng.randrange(1, 20))) for k in range(25)} | {40: "x\n" * 30, 41: "\n".join(map(str, range(5000)))}
    texts[42] = "new\n" + texts[41] + "\nend"
    docs = spark.createDataFrame([(k, 0, t) for k, t in texts.items()], "doc_id long, h long, text string")
    lines, first, want = {k: t.split("\n") for k, t in texts.items()}, {}, set()
    for d in sorted(texts):
        x, before = lines[d], None
        for i in range(len(x) - 1):
            at = first.setdefault(tuple(x[i : i + 3]), (d, i)) if i + 3 <= len(x) else None
            at = None if at == (d, i) else at
            if at and not (before and at == (before[0], before[1] + 1)):
                n = 3
                while i + n < len(x) and first.setdefault(tuple(x[i + n - 2 : i + n + 1]), (d, i + n - 2)) == (at[0], at[1] + n - 2):
                    n += 1
                want.add((d, i, n, at[0], at[1]))
            before = at
    got = {(r.doc_id, r.start, r.n, r.of_doc, r.of_start) for r in line_dedup.repeated_runs(docs).collect()}
    assert got == want and (42, 1, 5000, 41, 0) in got
