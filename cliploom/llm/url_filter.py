"""URL filters: exact membership in lists of hosts and paths by cascades of Bloom filters. DataFrame functions only.

A key is a host with what its path begins with (`example.net/en/`), or a host alone. The keys that a url can match are each
suffix of its host at a dot with each beginning of its path whose length some listed key has. The distinct keys of all urls,
and the listed ones, are the universe. Level 1 of a list's cascade is a Bloom filter of the listed keys; level 2 one of the
other keys of the universe that level 1 lets pass; level 3 one of the listed keys that level 2 lets pass; and so on until
nothing passes wrongly. A key of the universe is listed if the first level that it misses is even, so membership is exact
for every url of the corpus, and urls meet no list in a join: filters go into the plan as constants.

Lists of more than BLOCK keys are cut by hash into blocks, each with its own cascade; urls go through one block after the
other, and a key asks the filter of its own block only. So no task, nor the driver, holds more than one block's filters:
level 1 takes about 1.5 * log2(universe / listed) bits a key.

Nulls and texts that are no urls have an empty host and path and match nothing. Repeated rows give repeated results; null
ids stay null. Listed keys that are null or have no host are ignored; a key in both `block` and `allow` is blocked. Empty
tables give no rows, empty lists no match. Other columns of pages are ignored. Keys are compared whole, of any length.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: Listed keys in one cascade.
BLOCK = 1 << 18
#: Share of wrong keys that levels after the first let pass.
LATER = 1 / 16
#: Bits of a hash that give a place, and a step.
HALF = 30
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?` or `#`, A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to `?` or `#`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys that a url can match: suffixes of its host at dots, with beginnings of its path of these lengths."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    begins = F.transform(F.filter(F.array(*(F.lit(n) for n in lengths)), lambda n: n <= F.length(path)), lambda n: path.substr(F.lit(1), n))
    return F.flatten(F.transform(F.filter(suffixes, lambda s: s != ""), lambda s: F.transform(begins, lambda b: F.concat(s, b))))


def normal(key: Column) -> Column:
    """A listed key with its host in lower case."""
    host = F.regexp_extract(key, r"(?s)^([^/]*)", 1)
    return F.concat(F.translate(host, UPPER, LOWER), key.substr(F.length(host) + 1, F.length(key)))


class Level:
    """One Bloom filter: 64-bit words, `k` places for each key."""

    def __init__(self, keys: DataFrame, n: int, rate: float, seed: int) -> None:
        self.k = max(1, round(-math.log2(rate)))
        self.n_bits = 1 << max(6, math.ceil(math.log2(max(1, n) * -math.log(rate) / math.log(2) ** 2)))
        self.seed = seed
        self.words = self._filled(keys)

    def _places(self, key: Column) -> Column:
        """Places of a key: double hashing with halves of one 64-bit hash."""
        h = F.xxhash64(key, F.lit(self.seed))
        first, step = h.bitwiseAND(F.lit((1 << HALF) - 1)), F.shiftrightunsigned(h, HALF).bitwiseAND(F.lit((1 << HALF) - 1)).bitwiseOR(F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.lit(self.k - 1)), lambda i: (first + step * i).bitwiseAND(F.lit(self.n_bits - 1)))

    def _filled(self, keys: DataFrame) -> Column:
        """The words as one constant: combined by word on all tasks, and as many as the level has, none of them by key."""
        bits = keys.select(F.explode(self._places(F.col("key"))).alias("place"))
        bits = bits.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
        words = [0] * (self.n_bits >> 6)
        for r in bits.collect():  # n_bits / 64 rows at most
            words[r.word] = r.bits
        return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")

    def passes(self, key: Column) -> Column:
        word = lambda p: F.get(self.words, F.shiftright(p, 6).cast("int"))
        bit = lambda p: F.call_function("shiftright", word(p), p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1))
        return F.forall(self._places(key), lambda p: bit(p) == 1)


def cascade(keys: DataFrame, listed: Column) -> list[Level]:
    """Levels for the keys (key, ...) where `listed`; keys is the whole universe, each key once."""
    n, u = keys.agg(F.count_if(listed), F.count_if(~listed)).first()
    levels: list[Level] = []
    rate = min(0.5, max(n / max(u, 1), 2.0**-HALF))
    inside, others, kept = keys.where(listed), keys.where(~listed), []
    while n:
        level = Level(inside, n, rate, len(levels) + 1)
        wrong = stored(others.where(level.passes(F.col("key"))), "url-passing")
        levels.append(level)
        kept.append(wrong)
        inside, others, n, rate = wrong, inside, wrong.count(), LATER
    discard(*kept)
    return levels


def contains(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed: the parity of the first level that it misses."""
    out = F.lit(False)
    for level in reversed(levels):
        out = level.passes(key) & ~out
    return out


def _listed(levels: list[Level], block: Callable[[Column], Column], b: int) -> Column:
    """Those of `keys` that are in block b and listed."""
    return F.filter("keys", lambda k: (block(k) == b) & contains(levels, k))


def url_filter(pages: DataFrame, lists: DataFrame, block: int = BLOCK) -> DataFrame:
    """page_id, host, path, rule, verdict of pages (page_id, url) by lists (key, list).

    `list` is `block` or `allow` for rules, of which the longest that fits decides (of equal ones that of the longer host),
    or `listed` for hosts or paths that are blocked where no rule fits; what is nowhere is allowed. A key fits its host and
    all subdomains, where the path begins with the key's.
    """
    tag = F.when(F.col("list") == "block", 1).when(F.col("list") == "allow", 2).when(F.col("list") == "listed", 4)
    lists = lists.select(normal(F.col("key")).alias("key"), tag.alias("tag")).where("tag is not null and key is not null and key not like '/%' and key != ''")
    lengths = sorted(r.n for r in lists.select((F.length("key") - F.length(F.regexp_extract("key", r"(?s)^([^/]*)", 1))).alias("n")).distinct().collect())  # no more than the longest path has letters
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not lengths:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    rows = rows.withColumn("keys", candidates(F.col("host"), F.col("path"), lengths))
    met = rows.select(F.explode("keys").alias("key"), F.lit(0).alias("tag"))
    keys = stored(met.union(lists).groupBy("key").agg(F.bit_or("tag").alias("tag")), "url-keys")
    n = keys.where("tag > 0").count()
    n_blocks = max(1, math.ceil(n / block))
    own = lambda key: F.pmod(F.xxhash64(key, F.lit(0)), F.lit(n_blocks))
    kinds = (1, 2, 4)
    names = [f"in{tag}" for tag in kinds]
    rows = rows.select("*", *(F.array().cast("array<string>").alias(c) for c in names))
    before = None
    for b in range(n_blocks):
        part = keys.where(own(F.col("key")) == b) if n_blocks > 1 else keys
        for tag, name in zip(kinds, names, strict=True):
            levels = cascade(part, F.col("tag").bitwiseAND(F.lit(tag)) > 0)
            if levels:
                rows = rows.withColumn(name, F.concat(name, _listed(levels, own, b)))
        if n_blocks > 1:
            rows = stored(rows, "url-found")
            if before is not None:
                discard(before)
            before = rows
    discard(keys)
    longest = F.array_max(F.transform(F.concat("in1", "in2"), lambda k: F.struct(F.length(k).alias("n"), F.length(F.regexp_extract(k, r"(?s)^([^/]*)", 1)).alias("host"), k.alias("key"))))
    out = rows.withColumn("rule", longest["key"])
    by_rule = F.when(F.array_contains("in1", F.col("rule")), "block").otherwise("allow")
    by_list = F.when(F.size("in4") > 0, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNull(), by_list).otherwise(by_rule).alias("verdict"))
