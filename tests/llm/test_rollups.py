"""URL cascades, divergence and conversation tries against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cliploom.llm import conversation_trie as T
from cliploom.llm import divergence as D
from cliploom.llm import queries as Q
from cliploom.llm import url_filter as U
from oracle import differences

PAGES = "page_id long, url string, html string, host string, rule string, keys string"


def pages(spark, urls):
    """Pages with columns whose names the operator uses inside."""
    return spark.createDataFrame([(k, u, "x", "h", "r", "k") for k, u in enumerate(urls)], PAGES)


def lists(spark, rows):
    return spark.createDataFrame(rows, "key string, list string")


def judged(url, rules):
    """host, path, rule, verdict."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = []
    for key, kind in rules:
        own, _, p = key.partition("/")
        p = "/" + p if "/" in key else ""
        if own and (host == own or host.endswith("." + own)) and path.startswith(p):
            fit.append((len(key), len(own), key, kind))
    by_rule = [x for x in fit if x[3] != "listed"]
    if by_rule:
        best = max(by_rule, key=lambda x: x[:2])
        return host, path, best[2], "block" if (best[2], "block") in rules else "allow"
    return host, path, None, "block" if fit else "allow"


URLS = [None, "", "no url", "ftp:/x", "HTTP://A.Example.NET/en/1", "http://example.net", "http://example.net?x=/en/", "https://x.net/", "https://xnet/en/", "http://a.b.example.com/de/5#t", "http://example.com/dee/", "x://org/fr/a", "x://q.org/fr/a?b=://c", "x://spam-farm.example.org", "x://w.spam-farm.example.org/fr/", "x://spam-farm.example.org/de/", "x://notspam-farm.example.org/", "http://.net/a", "http://net./a", "http://h:80/p", "http://" + "a." * 50 + "net/" + "p/" * 3000, "x://é.net/ü/", "a\nb://L.org/fr/\nx", "x://y.net/", "x://y.net/"]


@pytest.mark.parametrize("block", [U.BLOCK, 3])
def test_rules_of_the_query(spark, block):
    rules = [*Q.RULES, *((f"{n}.{z}", "listed") for n in Q.LISTED for z in Q.ZONES)]
    got = U.url_filter(pages(spark, URLS), Q.url_lists(spark), block).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in got] == [judged(u, rules) for u in URLS]


def test_cascade_is_exact_over_many_keys(spark):
    rng = random.Random(2)
    name = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 6)))
    urls = [f"http://{name()}.{name()}/{name()}/{name()}" for _ in range(1500)]
    rules = sorted({(f"{name()}.{name()}" + rng.choice(["", "/", f"/{name()}", f"/{name()}/"]), rng.choice(["block", "allow", "listed"])) for _ in range(900)})
    for block in (U.BLOCK, 200):
        got = U.url_filter(pages(spark, urls), lists(spark, rules), block).orderBy("page_id").collect()
        assert [tuple(r)[1:] for r in got] == [judged(u, rules) for u in urls]


def test_cascade_levels_close(spark):
    keys = spark.range(4000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 40 == 0).alias("in"))
    levels = U.cascade(keys, F.col("in"))
    assert len(levels) > 1
    assert keys.where(U.contains(levels, F.col("key")) != F.col("in")).isEmpty()
    assert U.cascade(keys, F.lit(False)) == []


def test_url_edges(spark):
    none = spark.createDataFrame([], PAGES)
    assert U.url_filter(none, Q.url_lists(spark)).collect() == []
    one = pages(spark, ["http://a.net/x"]).withColumn("page_id", F.lit(None).cast("long"))
    assert tuple(U.url_filter(one, lists(spark, [])).first()) == (None, "a.net", "/x", None, "allow")
    odd = [(None, "block"), ("", "block"), ("/x", "block"), ("a.NET/X", None), ("A.net/x", "allow"), ("A.net/x", "block"), ("a.net/x", "other")]
    assert tuple(U.url_filter(one, lists(spark, odd)).first()) == (None, "a.net", "/x", "a.net/x", "block")


def test_urls_equal_sql(spark, sf_dir):
    assert differences(Q.op11_url_cascade(spark, sf_dir), Q.URLS, sf_dir) == ""


def priced(rows, least, ranks):
    """The contract, cell by cell."""
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), lang or "", s or "") for t, lang, s in rows]
    out = []
    for lang in {x[1] for x in docs}:
        own = [x for x in docs if x[1] == lang]
        df = Counter(t for x in own for t in set(x[0]))
        kept = [t for t, n in df.items() if n >= least]
        n = {s: Counter(t for x in own if x[2] == s for t in x[0] if df[t] >= least) for s in {x[2] for x in own}}
        n[None] = sum(n.values(), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (c.total() + len(kept)) for t in kept} for s, c in n.items()}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in n.keys() - {None}:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in n.keys() - {None, s}]
            terms = [(f(p[s][t], p[None][t]), t) for t in kept if n[s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most])]
    return sorted(out)


def corpus(rng, n):
    words = ["the", "The", "of", "é", "ÉT", "ß", "a1b", "x_y", "Zoo", "日本", "\U0001f600"] + [f"w{chr(97 + k)}" for k in range(20)]
    text = lambda: rng.choice([" ", "\n", "-", "\x00"]).join(rng.choice(words) for _ in range(rng.randrange(0, 30)))
    rows = [(text(), rng.choice(["en", "de", None, ""]), rng.choice(["s0", "s0", "s1", "s2", None, "é"])) for _ in range(n)]
    return rows + [(None, "en", "s9"), ("", "xx", "s0"), ("one two", "xx", "s1"), ("lone", "yy", "s0"), ("the " * 30000, "en", "s1"), rows[0], rows[0]]


@pytest.mark.parametrize(("n", "ranks"), [(120, 5), (3, 200)])
def test_divergence_is_the_contract(spark, monkeypatch, n, ranks):
    rows = corpus(random.Random(n), n)
    df = spark.createDataFrame([(k, *r, 1, "x") for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n long, term string").repartition(4)
    got = sorted(tuple(r) for r in D.divergence(df, D.LEAST, ranks).collect())
    assert got == priced(rows, D.LEAST, ranks)
    monkeypatch.setattr(D, "BROADCAST", 0)
    assert sorted(tuple(r) for r in D.divergence(df, D.LEAST, ranks).collect()) == got


def test_weights_are_exact(spark):
    cases = [(0, 1), (5, 17), (10**12, 3 * 10**12), (9 * 10**13 - 2, 9 * 10**13), (0, 9 * 10**14)]
    rows = spark.createDataFrame(cases, "n long, total long").select(D.weight(F.col("n"), F.col("total"))).collect()
    assert [r[0] for r in rows] == [1 + 10**9 * (n + 1) // total for n, total in cases]


def test_divergence_of_nothing(spark):
    assert D.divergence(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


def test_divergence_equals_sql(spark, sf_dir):
    assert differences(Q.op12_divergence(spark, sf_dir), Q.DIVERGENCE, sf_dir) == ""


def trie(rows, graft=True):
    """The contract by plain loops: sorted rows of the result."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    if graft:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
        own = {c: own.get(c - c % 20, [])[: h[c]] + t[h[c] :] for c, t in own.items()}
    members = defaultdict(list)
    for c, t in own.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = Counter(x[:-1] for x in members if x)
    leaves, saved = Counter(), Counter()
    for x, m in members.items():
        for d in range(len(x) + 1):
            leaves[x[:d]] += not kids[x]
            saved[x[:d]] += (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) if x else 0
    ends = lambda x, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(own[c]) == len(x)).encode()).hexdigest()
    return sorted((min(m), len(x), min(members[x[:-1]]) if x else -1, len(m), kids[x], leaves[x], saved[x], ends(x, m)) for x, m in members.items())


def built(spark, rows, block=T.BLOCK, graft=True):
    df = spark.createDataFrame([(*r, 1, "n", "p") for r in rows], "conv_id long, turn long, role string, text string, depth long, name string, pos string").repartition(3)
    turns = T.numbered_turns(df)
    out = T.prefix_trie(*(T.grafted(turns) if graft else (turns,)), block=block)
    return sorted(tuple(-1 if x is None else x for x in r) for r in out.drop("name", "parent").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_is_the_contract(spark, seed):
    rng = random.Random(seed)
    say = lambda: (rng.choice(["user", "assistant", None]), rng.choice([None, "", "a b", "a  b\tc", "\u00a0x", "hello there"]))
    rows = [(c, rng.choice([None, k, k, 3]), *say()) for c in range(90) if c not in (20, 60) for k in range(rng.randrange(1, 7))]
    rows += [(7, 1, "user", "x"), (7, 1, "user", "x"), (None, 1, "user", "lost"), (10**12, 0, "user", "far")]
    assert built(spark, rows) == trie(rows)


def test_long_and_common_conversations(spark):
    """Whole blocks named by doubling; thousands that end in one node; one conversation with most turns."""
    long = [(c, k, "user", f"w{k} z") for c, n in ((0, 700), (1, 650), (2, 64), (3, 65), (4, 63), (5, 128)) for k in range(n)]
    long += [(6, k, "user", "other" if k == 300 else f"w{k} z") for k in range(400)]
    common = [(c, 0, "user", "same") for c in range(1000, 1300)]
    rows = long + common
    want = trie(rows, graft=False)
    for block in (4, 64):
        assert built(spark, rows, block, graft=False) == want


def test_ends_are_joined_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 7)
    ends = spark.range(1000).select(F.lit(b"x").alias("name"), (F.col("id") * 3).alias("conv_id")).repartition(5)
    got = T.ends_digest(ends.union(spark.sql("SELECT X'00' AS name, 5L AS conv_id"))).collect()
    assert {bytes(r.name): r.ends_sha256 for r in got} == {b"x": hashlib.sha256(",".join(str(3 * k) for k in range(1000)).encode()).hexdigest(), b"\x00": hashlib.sha256(b"5").hexdigest()}


def test_no_conversations(spark):
    assert built(spark, []) == []
    assert built(spark, [(None, 1, "user", "x")]) == []


def test_turnless_conversations(spark):
    """31 takes h = 1 turn of 20, which is not there, and has no other turn of its own."""
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 >= 1)
    assert built(spark, [(c, 0, "user", "gone")]) == [(c, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_trie_equals_sql(spark, sf_dir):
    assert differences(Q.op13_prefix_trie(spark, sf_dir), Q.TRIE, sf_dir) == ""
