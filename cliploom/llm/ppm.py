"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of up to three bytes is counted on a bounded sample of labelled rows and then
frozen. A byte is coded by the longest context that has seen it; each longer context that has not costs an escape
(method C: a context with n counts of k different bytes escapes with k / (n + k)), down to all 256 bytes alike. The language
with the shortest code for the whole text wins. Every context of the sample counts. The trees are sorted arrays of what they
have seen, some ten bytes for each node; a slice of text is coded once for each different string of four bytes in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_importable, resident, slices

#: Labelled rows of each language that the trees are counted on, about; all of them where there are fewer.
TRAIN_ROWS = 2000
UNKNOWN = "und"


def _lower(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def _strings(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Each byte with the three before it as one number: lowered, three newlines before each text."""
    sizes = np.diff(offsets)
    place = np.arange(len(data)) + np.repeat(3 * np.arange(1, len(sizes) + 1), sizes)
    x = np.full(len(data) + 3 * len(sizes), 10, np.uint32)
    x[place] = _lower(data)
    return x[place - 3] << np.uint32(24) | x[place - 2] << np.uint32(16) | x[place - 1] << np.uint32(8) | x[place]


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, gram of four bytes, n)."""
    for batch in batches:
        for part, offsets, data in slices(batch):
            gram = _strings(offsets, data)
            lang = np.array(part.column(0).to_pylist(), object)
            names, code = np.unique(lang.astype(str), return_inverse=True)
            key, n = np.unique(np.repeat(code, np.diff(offsets)).astype(np.uint64) << np.uint64(32) | gram.astype(np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names[(key >> np.uint64(32)).astype(int)].tolist(), pa.string()), pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def _seen(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted keys hold what is asked, and whether they do."""
    at = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
    return at, keys[at] == asked if len(keys) else np.zeros(len(asked), bool)


class Tree:
    """Code lengths in bits of one language, from the counts n of strings of four bytes."""

    def __init__(self, gram: np.ndarray, n: np.ndarray) -> None:
        one = np.bincount(gram & 255, weights=n, minlength=256)
        two = np.bincount(gram & 0xFFFF, weights=n, minlength=1 << 16).reshape(256, 256)
        self.two = self._coded(two, self._coded(one, np.full(256, 8.0))[None, :]).ravel().astype(np.float32)
        self.three, self.three_bits, context, leave = self._deep(gram & 0xFFFFFF, n)
        self.leave_two = np.zeros(1 << 16, np.float32)
        self.leave_two[context] = leave
        self.four, self.four_bits, self.context, self.leave_three = self._deep(gram, n)

    @staticmethod
    def _coded(count: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Bits of each byte in each context (last axis: bytes); a context never seen costs nothing to leave."""
        n, kinds = count.sum(axis=-1, keepdims=True), (count > 0).sum(axis=-1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(n > 0, -np.log2(kinds / (n + kinds)), 0)
            return np.where(count > 0, -np.log2(count / (n + kinds)), escape + lower)

    @staticmethod
    def _deep(string: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Strings seen and the bits of their last byte, contexts seen and the bits of leaving them."""
        strings, at = np.unique(string, return_inverse=True)
        count = np.bincount(at, weights=n)
        contexts, of, kinds = np.unique(strings >> 8, return_inverse=True, return_counts=True)
        total = np.bincount(of, weights=count) + kinds
        return strings.astype(np.uint32), -np.log2(count / total[of]).astype(np.float32), contexts.astype(np.uint32), -np.log2(kinds / total).astype(np.float32)

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each string of four bytes."""
        out = self.leave_two[gram >> np.uint32(8) & np.uint32(0xFFFF)] + self.two[gram & np.uint32(0xFFFF)]
        at, have = _seen(self.three, gram & np.uint32(0xFFFFFF))
        out[have] = self.three_bits[at[have]]
        at, have = _seen(self.context, gram >> np.uint32(8))
        out[have] += self.leave_three[at[have]]
        at, have = _seen(self.four, gram)
        out[have] = self.four_bits[at[have]]
        return out


class Trees:
    """The trees of all languages."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> None:
        self.langs = langs
        self.trees = [Tree(gram[lang == k], n[lang == k].astype(np.float64)) for k in range(len(langs))]

    def bits(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Code length of each text in each language."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            gram, at = np.unique(_strings(offsets, data), return_inverse=True)
            for k, tree in enumerate(self.trees):
                out[full, k] = np.add.reduceat(tree.bits(gram)[at], offsets[:-1][full], dtype=np.float64)
        return out


def _scored(model, key: int, keep: list[int], names_kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = resident(f"ppm {key}", lambda: model.value)
        for batch in batches:
            for part, offsets, data in slices(batch):
                bits = trees.bits(offsets, data)
                best = bits.argmin(axis=1)
                score = 1 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)).sum(axis=1)
                rate = bits.min(axis=1) / np.maximum(1, np.diff(offsets))
                known = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                names = np.array(trees.langs, object)[best]
                names[~known] = UNKNOWN
                arrays = [part.column(0), part.column(1), pa.array(names.tolist(), pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(np.where(known, rate, 0.0))]
                yield pa.RecordBatch.from_arrays([*arrays, *(part.column(k) for k in keep)], ["doc_id", "held_out", "lang_pred", "score", "rate", *names_kept])

    return run


def held_out(folds: int, fold: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Trees of about `rows` rows of each language, outside the held-out fold."""
    ensure_importable(docs.sparkSession)
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(5, 0))
    have = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not have:
        return Trees([], *np.zeros((3, 0), np.int64))
    share = F.create_map(*(F.lit(x) for lang, n in have.items() for x in (lang, min(1.0, rows / n))))[F.col("lang")]
    sample = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    counts = sample.where(F.col("text").isNotNull()).select("lang", "text").mapInArrow(_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts["lang"].to_pylist()))
    at = {x: k for k, x in enumerate(langs)}
    lang = np.array([at[x] for x in counts["lang"].to_pylist()], np.int64)
    return Trees(langs, lang, counts["gram"].to_numpy(), counts["n"].to_numpy())


def language_id(docs: DataFrame, rows: int = TRAIN_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rate and the columns in `carry`.

    Learns from text and lang where crc32(doc_id as text) mod 5 is not 0 (held_out: it is 0). score is the probability of
    lang_pred among the learned languages, each as likely before; rate is its code length in bits a byte. A text that is null
    or has no letter is `und` with score 0; so is every text where nothing was learned. Rows with a null doc_id are predicted
    but not learned from. Ties go to the first name. Texts of any length are coded whole, a long one in a pass of its own.
    Rows stay one for one, repeated ones too; other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    model = train(docs, rows)
    kinds = "".join(f", `carry_{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    ready = docs.select(F.col("doc_id").cast("long"), held_out(5, 0).alias("held_out"), letter.alias("known"), "text", *(F.col(c).alias(f"carry_{c}") for c in carry if c != "text"))
    if not model.langs:
        return ready.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("rate"), *(F.col("text" if c == "text" else f"carry_{c}").alias(c) for c in carry))
    names = [f"carry_{c}" for c in carry]
    keep = [ready.columns.index("text" if c == "text" else f"carry_{c}") for c in carry]
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample
    out = ready.mapInArrow(_scored(shared, shared._jbroadcast.id(), keep, names), "doc_id long, held_out boolean, lang_pred string, score double, rate double" + kinds)
    return out.withColumnsRenamed({f"carry_{c}": c for c in carry})
