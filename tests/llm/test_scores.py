"""Language identification, toxicity, licences and audio against held-out rows, brute force and SQL."""

import io
import random
import wave
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cliploom.llm import chroma, licenses, ppm, toxicity
from cliploom.llm import queries as Q
from oracle import differences

DOCS = "doc_id long, text string, lang string, score double"


def test_language_held_out(spark, sf_dir):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = Q.op9_ppm(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held) > 0
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    rows = [(k, "the cat and the dog sat here " * 3, "en", 0.0) for k in range(20)] + [(20 + k, "le chien et la souris sont ici " * 3, "fr", 0.0) for k in range(20)]
    rows += [(100, None, "en", 0.0), (101, "", "en", 0.0), (102, "123 %%", "fr", 0.0), (None, "le chien et la souris", None, 0.0), (103, "x", None, 0.0), (104, "the dog " * 60000, None, 0.0), (0, rows[0][1], "en", 0.0)]
    got = ppm.language_id(spark.createDataFrame(rows, DOCS), carry=("text", "score")).collect()
    pred = {r[0]: r.lang_pred for r in got}
    assert pred[100] == pred[101] == pred[102] == "und" and pred[None] == "fr" and pred[104] == "en" and len(got) == len(rows)
    assert ppm.language_id(spark.createDataFrame([], DOCS)).count() == 0
    assert {r.lang_pred for r in ppm.language_id(spark.createDataFrame([(1, "abc", None, 0.0)], DOCS)).collect()} == {"und"}


def test_code_lengths_by_the_definition():
    """Trees.bits against a plain search for the longest context; b has all 256 bytes and many contexts."""
    rng = random.Random(1)
    texts = {"a": "".join(rng.choice("abca") for _ in range(300)).encode(), "b": bytes(rng.choice((97, rng.randrange(256), rng.randrange(256), rng.randrange(256))) for _ in range(60000))}
    counts = {}
    for lang, t in texts.items():
        x = b"\n\n\n" + ppm._lower(np.frombuffer(t, np.uint8)).tobytes()
        for i in range(3, len(x)):
            counts[lang, int.from_bytes(x[i - 3 : i + 1], "big")] = counts.get((lang, int.from_bytes(x[i - 3 : i + 1], "big")), 0) + 1
    keys = list(counts)
    assert len({k[1] >> 8 for k in keys}) > 24_000
    trees = ppm.Trees(["a", "b"], np.array(["ab".index(k[0]) for k in keys]), np.array([k[1] for k in keys]), np.array([counts[k] for k in keys]))
    probes = [b"abcadab z", b"", "ab\u0436\u4e2d".encode(), texts["b"][:200].lower(), bytes(range(128, 256))]
    got = trees.bits(np.cumsum([0, *map(len, probes)]), np.frombuffer(b"".join(probes), np.uint8))
    for k, lang in enumerate("ab"):
        own = {}
        for (name, g), n in counts.items():
            if name == lang:
                b = g.to_bytes(4, "big")
                for order in range(4):
                    own.setdefault(b[3 - order : 3], {}).setdefault(b[3], 0)
                    own[b[3 - order : 3]][b[3]] += n
        for which, probe in enumerate(probes):
            x, bits = b"\n\n\n" + probe, 0.0
            for i in range(3, len(x)):
                for order in range(3, -1, -1):
                    seen = own.get(x[i - order : i], {})
                    n, kinds = sum(seen.values()), len(seen)
                    if x[i] in seen:
                        bits -= np.log2(seen[x[i]] / (n + kinds))
                        break
                    if n:
                        bits -= np.log2(kinds / (n + kinds))
                else:
                    bits += 8
            assert abs(bits - got[which, k]) < 1e-5 * max(100, bits)


def test_languages_of_many_scripts(spark):
    """Scripts far apart and languages that share one."""
    letters = {"el": "\u03b1\u03b2\u03b3\u03b4\u03b5\u03bf\u03c2", "ru": "\u0430\u0431\u0432\u0433\u043e\u0435\u0442", "uk": "\u0456\u0457\u0454\u0433\u043e\u0435\u0442", "hi": "\u0905\u0906\u0915\u0916\u0917\u0924", "zh": "\u7684\u4e00\u662f\u4e0d\u4e86\u4eba", "ja": "\u306e\u306b\u306f\u3092\u305f\u4eba", "en": "ethoans", "fr": "\u00e9esaitn"}
    rng = random.Random(2)
    text = lambda a: " ".join("".join(rng.choice(a) for _ in range(5)) for _ in range(12))
    rows = [(k * 40 + i, text(a), lang, 0.0) for k, (lang, a) in enumerate(letters.items()) for i in range(40)]
    got = ppm.language_id(spark.createDataFrame(rows, DOCS)).collect()
    lang = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held) > 30


def labelled(spark, n=900):
    rng = random.Random(3)
    plain = [a + b for a in ("ka", "mo", "ri", "ne", "tu", "sol") for b in ("ta", "lin", "per", "gos", "ven")]
    texts, labels = [], []
    for k in range(n):
        words = [rng.choice(plain) for _ in range(25)]
        bad = k % 6 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(25)] = rng.choice(["blackguard", "scoundrel"])
        texts.append((k, " ".join(words), "en", 0.0))
        labels.append((k, 1, int(bad)))
    return texts, labels


def test_toxicity_decodes_what_is_hidden(spark):
    texts, labels = labelled(spark)
    hidden = ["kata molin sc0undr3l rita", "you b.l.a.c.k.g.u.a.r.d mota", "neper s c o u n d r e l tuven", "scooooundrel solta", "BL4CKGU4RD", "5coundrel!!"]
    clean = ["kata molin riper", "ka.ta mo-lin 2024", "", None, "k4ta m0lin", "of%%% kata&&& molin***"]
    extra = [(5000 + k, t, "en", 0.0) for k, t in enumerate(hidden + clean)]
    got = {r.doc_id: r for r in toxicity.toxicity(spark.createDataFrame(texts + extra, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert [got[5000 + k].predicted for k in range(len(extra))] == [1] * len(hidden) + [0] * len(clean)
    held = [k for k, _, _ in labels if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(got[k].held_out for k in held) and all(got[k].predicted == labels[k][2] for k in held)


def test_toxicity_decodes_long_matches(spark):
    texts, labels = labelled(spark)
    filler = [w for k in (1, 2, 3) for w in texts[k][1].split()]
    sentence = [*filler[:30], "scoundrel", *filler[30:60]]
    assert len("".join(sentence)) >= 300
    dotted = [*filler[:6], "blackguard", *filler[6:10]]
    hidden = [" ".join("".join(sentence)), "  ".join(" ".join(w) for w in sentence), ".".join("".join(dotted)), ".".join("".join(sentence)), "..".join(".".join(w) for w in sentence)]
    clean = [" ".join("".join(filler)), ".".join("".join(filler)), "x1" * 5000]
    extra = [(5000 + k, t, "en", 0.0) for k, t in enumerate(hidden + clean)]
    got = {r.doc_id: r for r in toxicity.toxicity(spark.createDataFrame(texts + extra, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert [got[5000 + k].predicted for k in range(len(extra))] == [1] * len(hidden) + [0] * len(clean)


def test_toxicity_decodes_joined_words_of_every_length(spark):
    texts, labels = labelled(spark)
    filler = [w for k in (1, 2, 3) for w in texts[k][1].split()]
    sentences = [[*filler[:k], "scoundrel", *filler[k : 2 * k]] for k in range(1, 13)]
    hidden = [x for s in sentences for x in (".".join(s), "-".join(s), ".".join("".join(s)), " ".join("".join(s)))]
    clean = [x for k in range(2, 20, 3) for x in (".".join(filler[:k]), ".".join("".join(filler[:k])), " ".join("".join(filler[:k])))]
    assert min(map(len, hidden)) < 24 and max(map(len, hidden)) > 200
    extra = [(5000 + k, t, "en", 0.0) for k, t in enumerate(hidden + clean)]
    got = {r.doc_id: r for r in toxicity.toxicity(spark.createDataFrame(texts + extra, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    found = [got[5000 + k].predicted for k in range(len(extra))]
    assert found == [1] * len(hidden) + [0] * len(clean), [x for x, n in zip(hidden, found, strict=False) if not n]


def test_look_alikes_of_other_scripts():
    rng = np.random.default_rng(0)
    words = ["scoundrel", "blackguard", "villain", "house", "garden", "window", "\u0434\u043e\u043c", "\u0441\u0430\u0434", "\u0441\u043e\u0440"]
    text = " ".join(rng.choice(words, 4000))
    rows = next(toxicity._trigrams(iter([pa.RecordBatch.from_arrays([pa.array([text])], ["text"])])))
    count = np.zeros(toxicity.CLASSES**3)
    count[rows["gram"].to_numpy()] = rows["n"].to_numpy()
    model = -np.log((count.reshape((toxicity.CLASSES,) * 3) + 0.01) / (count.reshape((toxicity.CLASSES,) * 3).sum(axis=2, keepdims=True) + 0.64)).astype(np.float32)
    restorer = toxicity.Restorer(model)
    for hidden in ("sc\u043eundr\u0435l", "\u0455\u0441oundrel", "s\u0336c\u0336oundrel", toxicity.plain("\uff33\uff43ound\uff52el"), "s.c.\u043e.u.n.d.r.\u0435.l"):
        assert "scoundrel" in restorer.words(hidden), hidden
    assert "\u0441\u043e\u0440" in restorer.words("\u0441\u043e\u0440")
    assert toxicity.plain("\u24b6\uff41 \u00c9") == "aa \u00e9" and toxicity.plain(None) == ""


def test_toxicity_ties_and_repeats(spark):
    texts, labels = labelled(spark)
    extra = [(9000, texts[0][1], "en", 0.0), (9000, texts[0][1], "en", 0.0), (9001, texts[0][1] + " " + "word " * 60000, "en", 0.0)]
    got = toxicity.toxicity(spark.createDataFrame(texts + extra, DOCS), spark.createDataFrame(labels + labels, "doc_id long, quality int, toxic int")).where("doc_id >= 9000").collect()
    assert len(got) == 3 and len({(r.score, tuple(r.rules)) for r in got if r.doc_id == 9000}) == 1 and set(got[0].rules) <= set(next(r.rules for r in got if r.doc_id == 9001))


def test_toxicity_edges(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.toxicity(spark.createDataFrame([(1, "a", None, 0.0), (None, None, None, 0.0)], DOCS), none).collect()] == [0.0, 0.0]
    assert toxicity.toxicity(spark.createDataFrame([], DOCS), none).count() == 0


def test_copies_are_no_evidence():
    copied = ["rare", "uncommon", *map(str, range(40))]
    rows = [(1, [*copied, f"x{k}"]) for k in range(30)] + [(1, ["villain", f"y{k}"]) for k in range(30)] + [(0, [f"z{k}", "plain"]) for k in range(200)]
    rules, _ = toxicity.learn(rows, (1.0, 1.0))
    assert any("villain".startswith(r.strip()) for r in rules) and not any("uncommon".startswith(r.strip()) for r in rules)


def test_licenses_equal_sql(spark, sf_dir):
    assert differences(Q.op10_licenses(spark, sf_dir), Q.oracle_sql()["op10_licenses"], sf_dir) == ""


def test_license_inheritance(spark):
    mit, gpl = licenses.TEMPLATES["MIT"][0], licenses.TEMPLATES["GPL-3.0"][0]
    prose = "some words of no matter at all stand in this long line here"
    rows = [(1, "r/LICENSE", mit), (2, "r/a/x.c", prose), (3, "r/a/b/LICENSE", gpl), (4, "r/a/b/c/y.c", prose), (5, "r/a/z.c", f"{prose}\n{gpl}\n{prose} {prose}"), (6, "other/q.c", prose), (7, None, mit), (8, "r/e.c", ""), (9, "r/n.c", None), (None, "r/a/k.c", prose), (2, "r/a/x.c", prose)]
    got = {(r.doc_id, r.path): (r.license, r.basis) for r in licenses.license_scan(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, path string, text string, line int")).collect()}
    assert got == {(1, "r/LICENSE"): ("MIT", "file"), (2, "r/a/x.c"): ("MIT", "inherited"), (3, "r/a/b/LICENSE"): ("GPL-3.0", "file"), (4, "r/a/b/c/y.c"): ("GPL-3.0", "inherited"), (5, "r/a/z.c"): ("GPL-3.0", "header"), (6, "other/q.c"): (None, "none"), (7, None): ("MIT", "file"), (8, "r/e.c"): ("MIT", "inherited"), (9, "r/n.c"): ("MIT", "inherited"), (None, "r/a/k.c"): ("MIT", "inherited")}
    assert licenses.license_scan(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0


def test_real_licence_files(spark):
    """Full short licences, shortened ones, and long ones by their opening; a notice in code licenses that file only."""
    full = {name: max(texts, key=len) for name, texts in licenses.TEMPLATES.items()}
    rng = random.Random(3)
    wrapped = lambda t: "\n".join(" ".join(t.split()[k : k + 6]) for k in range(0, len(t.split()), 6))
    clauses = "\n".join(" ".join(rng.choice(["such", "work", "grant", "patent", "derivative", "hereby", "party", "section", "the", "of", "any"]) for _ in range(6)) for _ in range(600))
    files = {
        "mit/LICENSE": ("MIT", "MIT License\n\nCopyright (c) 2020 Jane Roe\n\n" + wrapped(full["MIT"][12:])),
        "short/LICENSE.txt": ("MIT", "Copyright 2019 J. Roe and others\n" + wrapped(full["MIT"][12:720])),
        "bsd/LICENSE": ("BSD-3-Clause", "Copyright (c) 2011, R. Roe. All rights reserved.\n" + wrapped(full["BSD-3-Clause"])),
        "bsd2/COPYING": ("BSD-2-Clause", "Copyright (c) 2011, R. Roe. All rights reserved.\n" + wrapped(full["BSD-2-Clause"])),
        "apache/LICENSE": ("Apache-2.0", wrapped(licenses.TEMPLATES["Apache-2.0"][1]) + "\n" + clauses),
        "gpl/COPYING": ("GPL-3.0", wrapped(licenses.TEMPLATES["GPL-3.0"][1]) + "\n" + clauses),
        "gpl2/COPYING": ("GPL-2.0", wrapped(full["GPL-2.0"]) + "\n" + clauses),
        "lgpl/COPYING.LESSER": ("LGPL-3.0", wrapped(full["LGPL-3.0"]) + "\n" + clauses),
        "mpl/LICENSE": ("MPL-2.0", wrapped(licenses.TEMPLATES["MPL-2.0"][1]) + "\n" + clauses),
    }
    prose = [" ".join(rng.choice(["rain", "falls", "on", "the", "old", "house", "and", "of", "is", "to", "use", "any"]) for _ in range(80)) for _ in range(60)]
    rows = [(k, path, text) for k, (path, (_, text)) in enumerate(files.items())]
    rows += [(100 + k, f"{path.split('/')[0]}/src/a.c", prose[k]) for k, path in enumerate(files)]
    rows += [(200 + k, f"plain/{k}.txt", t) for k, t in enumerate(prose)]
    rows += [(300, "code/x.c", licenses.TEMPLATES["Apache-2.0"][0] + "\n" + "\n".join(prose[:20])), (301, "code/y.c", prose[3]), (302, "long/LICENSE", "word " * 200_000 + "\n" + full["MIT"])]
    got = {r.path: (r.license, r.basis) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    for path, (name, _) in files.items():
        assert got[path] == (name, "file") and got[path.split("/")[0] + "/src/a.c"] == (name, "inherited")
    assert all(got[f"plain/{k}.txt"] == (None, "none") for k in range(60))
    assert got["code/x.c"] == ("Apache-2.0", "header") and got["code/y.c"] == (None, "none")


def test_licences_are_granted_by_licence_files_only(spark):
    full = {name: max(texts, key=len) for name, texts in licenses.TEMPLATES.items()}
    prose = [" ".join(random.Random(k).choice(["rain", "falls", "on", "old", "houses", "of", "is", "to", "use", "any"]) for _ in range(60)) for k in range(40)]
    rows = [
        (1, "p/a.py", "# Released under the MIT License.\nimport os  # any"), (2, "p/b.py", prose[0]),
        (3, "q/LICENSE", full["Apache-2.0"]), (4, "q/x.c", "// SPDX-License-Identifier: MIT\nint x;"), (5, "q/y.c", "/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */\n" + full["MIT"]), (6, "q/z.c", "// SPDX-License-Identifier: \nint z;"),
        (7, "agpl/COPYING", full["AGPL-3.0"]), (8, "boost/LICENSE_1_0.txt", full["BSL-1.0"]), (9, "epl/LICENSE.md", full["EPL-2.0"]), (10, "art/LICENSE", full["Artistic-2.0"]),
        (11, "spdx/LICENSE", "SPDX-License-Identifier: EUPL-1.2"), (12, "spdx/a/m.rs", prose[1]), (13, None, "SPDX-License-Identifier: 0BSD"),
        (14, "code/mit.txt", full["MIT"]), (15, "code/m.c", prose[2]), (16, "both/LICENSE", full["MIT"] + " " + full["MIT"] + "\n" + full["MIT"]),
    ]
    rows += [(100 + k, f"plain/{k}.txt", t) for k, t in enumerate(prose)]
    got = {r.doc_id: (r.license, r.basis) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got[1] == ("MIT", "header") and got[2] == (None, "none")
    assert got[4] == ("MIT", "header") and got[5] == ("GPL-2.0-only WITH Linux-syscall-note", "header") and got[6] == ("Apache-2.0", "inherited")
    assert [got[k] for k in (7, 8, 9, 10)] == [(x, "file") for x in ("AGPL-3.0", "BSL-1.0", "EPL-2.0", "Artistic-2.0")]
    assert got[11] == ("EUPL-1.2", "file") and got[12] == ("EUPL-1.2", "inherited") and got[13] == ("0BSD", "file")
    assert got[14] == ("MIT", "header") and got[15] == (None, "none") and got[16] == ("MIT", "file")


def test_a_licence_needs_a_margin(spark):
    """Two templates that say the same are none; with one word more, one is."""
    same = {"A-1": ("one may copy this text and sell it at will",), "B-1": ("one may copy this text and sell it at will",)}
    rows = [(1, "x/LICENSE", same["A-1"][0]), (2, "y/z.c", "nothing of note stands here"), (3, "y/w.c", "rain and rain")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    assert {r.license for r in licenses.license_scan(df, same).collect()} == {None}
    apart = same | {"B-1": ("one may copy this text and never sell nor lend it",)}
    assert {r.doc_id: r.license for r in licenses.license_scan(df, apart).collect()} == {1: "A-1", 2: None, 3: None}


SONG = " ".join(random.Random(4).choice(["do", "re", "mi", "fa", "sol", "la", "ti", "ut", "si", "so"]) + str(k % 7) for k in range(150))


def prints(text):
    return chroma.fingerprint(chroma.chroma(*chroma.samples(chroma.render(text))))


def test_alignment_finds_the_offset():
    offset, overlap, error = chroma.align(prints(SONG), prints("before the song " * 5 + SONG))
    assert offset == -15 and error < 0.02 and overlap == len(prints(SONG))
    other = " ".join(str(random.Random(9).random()) for _ in range(150))
    assert chroma.align(prints(SONG), prints(other))[2] > chroma.ERROR or chroma.align(prints(SONG), prints(other))[1] < chroma.OVERLAP


def test_alignment_votes_by_correlation_too():
    a, b = np.zeros(1500, np.uint32), np.zeros(1100, np.uint32)
    a[700:800] = np.arange(1, 101)
    b[300:400] = np.arange(1, 101)
    votes = {o: sum(a[max(0, o) : min(1500, 1100 + o)] == b[max(0, -o) : min(1100, 1500 - o)]) for o in range(-1050, 1500, 50)}
    offset, overlap, _ = chroma.align(a, b)
    assert offset == 400 and overlap == 1100 and votes[400] == max(votes.values())


def test_recordings(spark):
    rows = [(1, chroma.render(SONG)), (2, chroma.render("intro words are heard " * 4 + SONG)), (3, b"no sound"), (4, None), (5, chroma.render("")), (None, chroma.render(SONG)), (1, chroma.render(SONG))]
    got = chroma.align_recordings(spark.createDataFrame([(*r, 1) for r in rows], "rec_id long, media binary, overlap int")).collect()
    by = {}
    for r in got:
        by.setdefault(r.rec_id, []).append(r)
    assert len(got) == len(rows) and by[2][0].ref_id == 1 and by[2][0].offset == -16 and by[1][0].ref_id is None
    assert [by[k][0].n_frames for k in (3, 4, 5)] == [0, 0, 0] and by[None][0].ref_id is None
    assert chroma.align_recordings(spark.createDataFrame([], "rec_id long, media binary")).count() == 0


def test_stereo_and_widths():
    mono, rate = chroma.samples(chroma.render(SONG))
    for width, kind, scale in ((2, "<i2", 2**15), (3, "<i4", 2**31), (4, "<i4", 2**31)):
        out = io.BytesIO()
        with wave.open(out, "wb") as f:
            f.setnchannels(2)
            f.setsampwidth(width)
            f.setframerate(rate)
            data = np.repeat((mono * scale).astype(kind), 2)
            f.writeframes(data.view(np.uint8).reshape(-1, 4)[:, 1:].tobytes() if width == 3 else data.tobytes())
        x, r = chroma.samples(out.getvalue())
        assert r == rate and np.abs(x - mono).max() < 1e-3


def plain_offset(a, b):
    """The offset with most equal integers, then the least distance, then the least; frames in common; share of differing bits."""
    best = None
    for o in range(1 - len(b), len(a)):
        x, y = a[max(0, o) : len(b) + o], b[max(0, -o) : len(a) - o]
        same = int((x == y).sum())
        if same and (best is None or (-same, abs(o), o) < best[0]):
            best = (-same, abs(o), o), (o, len(x), float(np.unpackbits((x ^ y).view(np.uint8)).mean()))
    return best and best[1]


def noisy(media, rng, level):
    x, rate = chroma.samples(media)
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(x + rng.normal(size=len(x)) * level, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def recordings(rng):
    """Long recordings, excerpts of them, noisy copies, exact copies, and some that share an opening only."""
    word = lambda: rng.choice("bcdfglmnprst") + rng.choice("aeiou") + rng.choice("lmnrst") + str(rng.randrange(60))
    opening = [word() for _ in range(40)]
    long = [[word() for _ in range(rng.randrange(200, 300))] for _ in range(14)] + [opening + [word() for _ in range(100)] for _ in range(12)]
    media = [chroma.render(" ".join(x)) for x in long]
    for k in range(30):
        x, n = long[k % 14], rng.choice((48, 60, 90, 120))
        at = rng.randrange(len(x) - n)
        media.append(chroma.render(" ".join(x[at : at + n])))
    noise = np.random.default_rng(5)
    media += [noisy(media[k], noise, level) for k, level in enumerate((0.02, 0.05, 0.1, 0.15, 0.2, 0.05, 0.1))]
    return media + [media[0], media[0], media[30], chroma.render("a b c")]


@pytest.mark.parametrize("most", [64, 4])
def test_references_by_brute_force(spark, most):
    """References against the alignment of all pairs, offset by offset; with short lists runs and leaders are used too."""
    media = recordings(random.Random(17))
    random.Random(18).shuffle(media)
    own = [chroma.fingerprint(chroma.chroma(*chroma.samples(m))) for m in media]
    want = {}
    for b in range(len(own)):
        found = [(e, -n, a) for a in range(b) if (r := plain_offset(own[a], own[b])) and (e := r[2]) <= chroma.ERROR and (n := r[1]) >= chroma.OVERLAP]
        want[b] = min(found, default=(None, None, None))
    got = {r.rec_id: r for r in chroma.align_recordings(spark.createDataFrame(list(enumerate(media)), "rec_id long, media binary"), most=most).collect()}
    have = [k for k in want if want[k][2] is not None]
    assert len(have) >= 30 and all(got[k].ref_id is None for k in want.keys() - set(have))
    for k in have:  # what is found is a true alignment
        if got[k].ref_id is not None:
            o, n, e = plain_offset(own[got[k].ref_id], own[k])
            assert (got[k].overlap, round(got[k].bit_error, 9)) == (n, round(e, 9)) and (abs(got[k].offset) == abs(o))
    assert sum(got[k].ref_id is not None for k in have) >= 0.97 * len(have)
    assert sum(got[k].ref_id == want[k][2] for k in have) >= 0.9 * len(have)


@pytest.mark.parametrize("block", [1024, 7])
def test_edited_copies_get_their_best_reference(spark, monkeypatch, block):
    """Every list of the group is long: each recording gets the best of all references, in one tile and in tiles of two blocks."""
    monkeypatch.setattr(chroma, "LIST", 4)
    monkeypatch.setattr(chroma.best_of_long, "__defaults__", (4, chroma.ERROR, chroma.OVERLAP, block))
    rng = random.Random(23)
    words = [f"w{rng.randrange(500)}" for _ in range(160)]
    media = []
    for k in range(30):
        own = list(words[: 60 + 100 * (k % 3 > 0)])
        for _ in range(k % 4):
            own[rng.randrange(20, len(own))] = f"x{rng.randrange(500)}"
        media.append(chroma.render(" ".join(["intro"] * (k % 2 * 5) + own)))
    own = [chroma.fingerprint(chroma.chroma(*chroma.samples(m))) for m in media]
    got = {r.rec_id: r for r in chroma.align_recordings(spark.createDataFrame(list(enumerate(media)), "rec_id long, media binary"), most=4).collect()}
    for b in range(30):
        found = [(round(e, 9), -n, a) for a in range(b) if (r := plain_offset(own[a], own[b])) and (e := r[2]) <= chroma.ERROR and (n := r[1]) >= chroma.OVERLAP]
        want = min(found, default=None)
        assert (want and want[2]) == got[b].ref_id, b
        assert want is None or (round(got[b].bit_error, 9), -got[b].overlap) == want[:2]


def test_integers_by_the_hundred_thousand_are_counted_alike():
    a, b = np.random.default_rng(2).integers(0, 5, (2, 300)).astype(np.uint32)
    votes = chroma._votes_by_integer(a, b)
    offset, n, error = chroma.align(a, b)
    assert votes[offset + 300] == votes.max() == (a[max(0, offset) : 300 + min(0, offset)] == b[max(0, -offset) : 300 - max(0, offset)]).sum()


def test_pairs_of_a_common_opening_grow_with_its_recordings(spark):
    def pairs(n):
        rng = np.random.default_rng(3)
        opening = rng.integers(0, 2**32, 40, dtype=np.uint32)
        rows = [(k, np.concatenate((opening, rng.integers(0, 2**32, 30, dtype=np.uint32))).astype("<u4").tobytes()) for k in range(n)]
        return chroma.candidates(spark.createDataFrame(rows, "own long, prints binary"), most=8).count()

    assert pairs(200) <= 2.2 * pairs(100) <= 2.2 * 2 * 100


@pytest.mark.parametrize("name", ["op2_toxicity", "op9_ppm"])
def test_scores_are_chances(spark, sf_dir, name):
    assert all(0 <= r.score <= 1 for r in Q.queries()[name](spark, sf_dir).collect())
