"""Toxicity of whole texts after noisy-channel deobfuscation.

A writer who hides a word sends it through a channel: letters become look-alike digits, signs or letters of other scripts,
letters repeat, and separators or combining marks come between letters. For each suspicious token a lattice holds what every character may stand for, with the
channel's cost; a Viterbi search finds the restored word that a character trigram model likes best. The model is counted
over all documents. Restored tokens are scored by rules, words or stems that are far more frequent in toxic texts,
learned from labelled rows; near copies among these count once, so what a copied text holds besides is no evidence. A
text's score is one minus the chance that each of its rules is wrong.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_importable, mix, stored

#: Labelled rows that the rules are learned from, about, by class.
TOXIC_ROWS, CLEAN_ROWS = 2000, 4000
#: Score from which a text is called toxic.
CUT = 0.7
#: Toxic texts that hold a rule, its least precision, and texts of the usual mixture that its precision is drawn to.
SUPPORT, PRECISION, DOUBT = 7, 0.6, 5.0
#: Lengths of stems, in letters.
STEMS = range(3, 9)
#: A stem gives way to a longer one that holds for this share of its texts: the more exact the better.
SAME = 0.95
REMEMBERED = 400_000

#: Letters that look-alikes stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "¥": "y"}
#: Latin letters that letters of other scripts look like.
SCRIPTS = {"а": "a", "в": "b", "е": "e", "ё": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "uy", "х": "x", "ԁ": "d", "ո": "n", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o"}
SEPARATORS = ".-_*~·,'’`^=:;/\\ ​‌‍­"
#: Costs in nats of the channel: a look-alike, a letter hidden by a star, a letter repeated in a run of three or more or
#: of two, a separator, any other sign, and a space that ends a word of spaced letters.
SUBSTITUTED, STARRED, REPEATED, DOUBLED, SEPARATED, DROPPED, ENDED = 1.0, 2.5, 0.5, 5.0, 0.3, 14.0, 2.0

CLASSES = 64
EDGE, OTHER = 0, 63


def letter_class(c: str) -> int:
    """0 for what is no letter, 1 to 26 for a to z, one class for each Latin-1 letter, one for all others."""
    k = ord(c)
    if 97 <= k <= 122:
        return k - 96
    if 223 <= k <= 255 and k != 247:
        return 27 + k - 223
    return OTHER if c.isalpha() else EDGE


TABLE = np.array([letter_class(chr(k)) for k in range(0x250)] + [OTHER], np.int64)


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES**3, np.int64)

    def count(parts: list[str]) -> None:
        """Trigrams within each part, all parts in one pass."""
        x = TABLE[np.minimum(np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32), 0x250)]
        grams = (x[:-2] * CLASSES + x[1:-1]) * CLASSES + x[2:]
        ends = np.cumsum([len(p) for p in parts])[:-1]  # the two that begin before an end go beyond it
        np.add(total, np.bincount(np.delete(grams, np.concatenate((ends - 2, ends - 1))), minlength=CLASSES**3), out=total)

    for batch in batches:
        parts, size = [], 0
        for text in batch.column(0):
            text = text.as_py() or ""
            for at in range(0, len(text), 1 << 20):  # chunks overlap by two characters
                parts.append((f"\n\n{text[:1 << 20]}\n" if not at else text[at - 2 : at + (1 << 20)] + "\n").lower())
                size += len(parts[-1])
                if size >= 1 << 20:
                    count(parts)
                    parts, size = [], 0
        if parts:
            count(parts)
    k = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["gram", "n"])


def letter_model(docs: DataFrame) -> np.ndarray:
    """Cost in nats of each class after each two, [a, b, c], from the trigrams of all documents."""
    ensure_importable(docs.sparkSession)
    rows = docs.select("text").mapInArrow(_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # CLASSES ** 3 rows at most
    count = np.zeros(CLASSES**3)
    count[rows["gram"].to_numpy()] = rows["n"].to_numpy()
    count = count.reshape(CLASSES, CLASSES, CLASSES)
    one = count.sum(axis=(0, 1)) + 1
    two = count.sum(axis=0)
    p = np.broadcast_to(one / one.sum(), two.shape)
    p = (two + 20 * p) / (two.sum(axis=1, keepdims=True) + 20)
    p = (count + 20 * p[None]) / (count.sum(axis=2, keepdims=True) + 20)
    return -np.log(p).astype(np.float32)


def plain(text: str | None) -> str:
    """Lowered; full-width, circled and other variants of ASCII characters as those."""
    low = (text or "").lower()
    return low.translate(VARIANTS) if not low.isascii() and VARIANT.search(low) else low


#: By rule: what NFKC makes a single ASCII letter, digit or sign of, but for spaces.
VARIANTS = {k: x for k in [*range(0x2100, 0x2140), *range(0x2460, 0x2500), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)] if len(x := unicodedata.normalize("NFKC", chr(k)).lower()) == 1 and x.isascii() and x != " "}
VARIANT = re.compile("[\u2100-\u213f\u2460-\u24ff\uff01-\uff5e\U0001d400-\U0001d7ff]")


def lattice(token: str, breaks: bool = False) -> list[list[tuple[str, float]]]:
    """What each character may stand for, with its cost; the empty string drops it, a space ends a word.

    With `breaks` every separator may end a word, not only a space.
    """
    out = []
    for k, c in enumerate(token):
        again = k and token[k - 1] == c
        long = again and (token[k - 2 : k - 1] == c and k > 1 or token[k + 1 : k + 2] == c)
        if c.isalpha():
            options = [(c, 0.0)]
            if c > "z":
                options += [(x, SUBSTITUTED) for x in SCRIPTS.get(c, "")]
        elif c == " ":
            options = [("", SEPARATED), (" ", ENDED)]
        elif c == "*":
            options = [("", SEPARATED), *((x, STARRED) for x in "aeiou")]
        elif c in LOOKALIKES:
            options = [(x, SUBSTITUTED) for x in LOOKALIKES[c]] + [("", DROPPED)]
        else:
            options = [("", SEPARATED if c in SEPARATORS or unicodedata.combining(c) else DROPPED)]
        if breaks and c in SEPARATORS and c != " ":
            options.append((" ", ENDED))
        if again and options[0][0]:
            options.append(("", REPEATED if long else DOUBLED))
        out.append(options)
    return out


#: Letters of which none stands twice in a row have one path through their lattice.
ONE_PATH = re.compile(r"(?:([a-z])(?!\1))*")


def decode(token: str, model: list[list[list[float]]], breaks: bool = False) -> str:
    """The restored word of least cost: Viterbi over the last two letters, with back pointers, so linear in the length."""
    if ONE_PATH.fullmatch(token):
        return token
    steps = [[(c, letter_class(c) if c else 0, own) for c, own in options] for options in lattice(token, breaks)]
    if max(map(len, steps), default=0) < 2:  # a single path
        return "".join(options[0][0] for options in steps)
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}
    for options in steps:
        now: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, back) in best.items():
            row = model[a][b]
            for c, k, own in options:
                if c:
                    state, new, to = (b, k), cost + own + row[k], (back, c)
                else:
                    state, new, to = (a, b), cost + own, back
                old = now.get(state)
                if old is None or new < old[0]:  # of equal paths the one found first
                    now[state] = (new, to)
        best = now
    ends = [(cost + model[a][b][EDGE], spelled(back)) for (a, b), (cost, back) in best.items()]
    return min(ends)[1]


def spelled(back: tuple | None) -> str:
    out = []
    while back is not None:
        back, c = back
        out.append(c)
    return "".join(reversed(out))


JUNK = re.compile(r"^[\W_]+|[\W_]+$")
INNER = re.compile(r"[^\W\d_][^\sa-zà-ÿ]|[^\sa-zà-ÿ][^\W\d_]|([^\W\d_])\1\1")
JOINED = re.compile(f"[{re.escape(SEPARATORS)}]")
SPACED = re.compile(r"(?<!\S)[^\s.,](?:[ .\-_*]{1,2}[^\s.,]){3,}(?!\S)")


class Restorer:
    """Lowered token to the words that it may be: itself without signs around it and, if suspicious, its decoding."""

    def __init__(self, model: np.ndarray) -> None:
        self.model = model.tolist()  # lists are read faster, number by number

    def words(self, token: str) -> tuple[str, ...]:
        bare = JUNK.sub("", token)
        if not INNER.search(token):
            return (bare,)
        ends = token.strip(SEPARATORS + ",;:?\"()[]{}%&#")
        out = {bare, *(decode(x, self.model) for x in {token, ends, bare})}
        if JOINED.search(ends):  # may be words joined by signs
            out.update(decode(ends, self.model, True).split())
        return tuple(out)

    def spaced(self, text: str) -> list[str]:
        return [w for m in SPACED.finditer(text) for breaks in (False, True) for w in decode(m[0], self.model, breaks).split()]


def features(words: tuple[str, ...]) -> set[str]:
    """Words, marked by a final space, and their stems."""
    out = set()
    for w in words:
        if w:
            out.add(w + " ")
            out.update(w[:k] for k in STEMS if len(w) >= k)
    return out


def _restored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.value)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                low = plain(text)
                words = set()
                for token in set(low.split()):
                    words.update(restorer.words(token))
                words.update(restorer.spaced(low))
                out.append(sorted(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["toxic", "words"])

    return run


class Rows:
    """(label, words) of each row of a table, as often as asked; the table stays in Arrow."""

    def __init__(self, table: pa.Table) -> None:
        self.table = table

    def __iter__(self) -> Iterator[tuple[int, list[str]]]:
        for batch in self.table.to_batches(256):
            yield from zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1)), strict=True)


def hashed(words: Iterable[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint64)


def without_copies(rows: Iterable[tuple[int, list[str]]], bands: int = 8, each: int = 3, alike: float = 0.5) -> list[bool]:
    """Which rows to keep: the first of each group of texts that share half their words, found by MinHash bands."""
    seeds = np.random.default_rng(3).integers(0, 2**63, bands * each, dtype=np.uint64)
    own = [(y, np.unique(hashed(words)).astype(np.uint32)) for y, words in rows]
    least = [[int(mix(h.astype(np.uint64) * np.uint64(2) + s).min()) if len(h) else 0 for s in seeds] for _, h in own]
    keep, seen = [False] * len(own), {}
    for k in sorted(range(len(own)), key=lambda k: (own[k][0], least[k], own[k][1].tobytes())):  # whatever order rows come in
        h = own[k][1]
        keys = [(b, *least[k][b * each : (b + 1) * each]) for b in range(bands)]
        near = {j for key in keys for j in seen.get(key, ())}
        if any((both := len(np.intersect1d(h, own[j][1], assume_unique=True))) >= alike * (len(h) + len(own[j][1]) - both) for j in near):
            continue
        keep[k] = True
        for key in keys:
            seen.setdefault(key, []).append(k)
    return keep


def learn(rows: Iterable[tuple[int, list[str]]], weights: tuple[float, float]) -> tuple[dict[str, float], float]:
    """Rules (feature: chance that a text with it is toxic) and the chance of a text without any. rows is read several times."""
    keep = without_copies(rows)
    kept = lambda label: (set(features(tuple(w))) for k, (y, w) in zip(keep, rows, strict=True) if k and y == label)
    size = 1 << 22  # counts by hash first: they are never too low, so only features worth an exact count get one
    rough = np.zeros(size, np.int32)
    for f in kept(1):
        rough[np.unique(hashed(f) % np.uint64(size))] += 1
    counted = Counter()
    for f in kept(1):
        listed = list(f)
        counted.update(x for x, n in zip(listed, rough[hashed(listed) % np.uint64(size)].tolist(), strict=True) if n >= SUPPORT)
    ones = {x: n for x, n in counted.items() if n >= SUPPORT}
    zeros = Counter(x for f in kept(0) for x in f & ones.keys())
    n = Counter(y for k, (y, _) in zip(keep, rows, strict=True) if k)
    all_ones, all_zeros = weights[1] * n[1], weights[0] * n[0]
    usual = all_ones / max(1e-9, all_ones + all_zeros)
    chance = {x: (weights[1] * c + DOUBT * usual) / (weights[1] * c + weights[0] * zeros[x] + DOUBT) for x, c in ones.items()}
    rules: dict[str, float] = {}
    longest: dict[str, list[str]] = {}  # what a stem may be the beginning of, by one more letter or the word's end
    for x in ones:
        longest.setdefault(x[:-1], []).append(x)
    for x in sorted(x for x in ones if chance[x] >= PRECISION):  # a stem comes before what begins with it
        longer = [v for v in longest.get(x, ()) if ones[v] >= SAME * ones[x]]
        if not longer and not any(x[:k] in rules for k in STEMS if k < len(x)):
            rules[x] = min(chance[x], 0.99)
    rest = weights[1] * sum(rules.keys().isdisjoint(f) for f in kept(1))
    clean = weights[0] * sum(rules.keys().isdisjoint(f) for f in kept(0))
    return rules, min(0.5, rest / (rest + clean + 1))


class Found(dict):
    """Token to the rules that its words meet, found when first asked for."""

    def __init__(self, restorer: Restorer, rules: dict[str, float]) -> None:
        self.restorer, self.rules = restorer, rules

    def met(self, words: tuple[str, ...]) -> tuple[str, ...]:
        out = []
        for w in words:
            if w + " " in self.rules:
                out.append(w + " ")
            out += [w[:k] for k in STEMS if w[:k] in self.rules and len(w) >= k]
        return tuple(out)

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[token] = self.met(self.restorer.words(token))
        return out


def _scored(model, rules: dict[str, float], base: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found(Restorer(model.value), rules)
        for batch in batches:
            scores, why = [], []
            for text in batch.column(2).to_pylist():
                low = plain(text)
                met = set()
                for x in map(found.__getitem__, set(low.split())):
                    met.update(x)
                for word in found.restorer.spaced(low):
                    met.update(found.met((word,)))
                wrong = 1.0 - base
                for x in met:
                    wrong *= 1 - rules[x]
                scores.append(1 - wrong)
                why.append(sorted(x.strip() for x in met))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(x >= CUT) for x in scores], pa.int32()), pa.array(why, pa.list_(pa.string()))], ["doc_id", "held_out", "score", "predicted", "rules"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted and rules (the words and stems met).

    Learns from labels (doc_id, toxic) of rows where crc32(doc_id as text) mod 3 is not 1; held_out says that it is. Null
    labels and null doc_ids are not learned from; a document with both labels counts once under each. A null text is empty;
    a text without rules has the share of toxic ones among such. Without labels every score is 0. Rows stay one for one, other
    columns are ignored, and an empty table gives no rows. Texts, tokens and spaced words of any length are read whole. A
    text that stands twice scores the same twice; of decodings of equal cost the one
    found first wins; the order depends on the token alone. Signs may end words in tokens and spaced words of every length.
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    model = spark.sparkContext.broadcast(letter_model(docs))  # CLASSES ** 3 numbers
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).where(~held).distinct()
    have = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {0: min(1.0, clean_rows / have.get(0, 1)), 1: min(1.0, toxic_rows / have.get(1, 1))}
    picked = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]) * (1 << 30)
    sample = known.where(picked).limit(2 * (toxic_rows + clean_rows))  # a bound, far above what is expected
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("toxic", "text")
    rows = stored(texts.mapInArrow(_restored(model), "toxic int, words array<string>"), "labelled").toArrow()
    n = Counter(rows["toxic"].to_pylist())
    rules, base = learn(Rows(rows), (have.get(0, 0) / max(1, n[0]), have.get(1, 0) / max(1, n[1])))
    ready = docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text")
    return ready.mapInArrow(_scored(model, rules, base), "doc_id long, held_out boolean, score double, predicted int, rules array<string>")
