"""Byte-level BPE encoding and decoding with the ranks of a tiktoken file.

Each piece that the pattern matches is encoded by itself. A segment tree over its byte positions holds, at each leaf, the
rank of the pair that begins there (leftmost first among equals); the root gives the next merge, and a merge updates the
leaves of the live neighbours only, in logarithmic time, so one piece of n bytes takes n log n however long it is.
Pieces repeat: each worker keeps a bounded table of those it has encoded.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_importable, resident

#: Pieces that a worker remembers.
REMEMBERED = 400_000
#: White space of the pattern's \s as Unicode defines it (fixed values).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def compiled(pattern: str) -> regex.Pattern:
    return regex.compile(compiled_text(pattern))


def compiled_text(pattern: str) -> str:
    r"""The pattern with \s and \S spelled out: Python's \s also takes the separators 1C to 1F."""
    out, in_class, k = [], False, 0
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two == r"\s":
            out.append(SPACE if in_class else f"[{SPACE}]")
            k += 2
        elif two == r"\S" and not in_class:
            out.append(f"[^{SPACE}]")
            k += 2
        elif two[0] == "\\":
            out.append(two)
            k += 2
        else:
            in_class = two[0] == "[" or in_class and two[0] != "]"
            out.append(two[0])
            k += 1
    return "".join(out)


#: Widths of the matrices of trees; longer pieces have a tree of their own.
WIDTHS = (8, 16, 32, 64)
NONE = 1 << 62
#: Letters and numbers below U+0250 (fixed values of Unicode's classes L and N), for texts without characters beyond.
LETTERS, NUMBERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
WIDE = re.compile("[^\x00-\u024f]")


def narrow(pattern: str) -> re.Pattern:
    """The pattern for texts below U+0250, with its classes spelled out: several times as fast."""
    out = compiled_text(pattern)
    for name, inside in ((r"\p{L}", LETTERS), (r"\p{N}", NUMBERS)):
        bare = ""
        for part in re.split(r"(\[(?:[^\]\\]|\\.)*\])", out):
            bare += part.replace(name, inside) if part[:1] == "[" else part.replace(name, f"[{inside}]")
        out = bare
    return re.compile(out)


def load_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: lowest rank first, leftmost among equals."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    size = 1 << max(1, n - 1).bit_length()
    none = 1 << 62
    shift = n.bit_length()
    end = list(range(1, n + 1))  # of the token that begins at a position
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [none] * (2 * size)
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << shift | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
            k >>= 1

    def rank(i: int) -> int:
        j = after[i]
        if j >= n:
            return none
        r = ranks.get(piece[i : end[j]])
        return none if r is None else r << shift | i

    while (best := tree[1]) != none:
        i = best & (1 << shift) - 1
        j = after[i]
        end[i], after[i] = end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        put(j, none)
        put(i, rank(i))
        if before[i] >= 0:
            put(before[i], rank(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


class Merger:
    """Segment trees over many short pieces at once: one row of a matrix for each, all updated by the same steps."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.span = ranks, max(ranks.values()) + 1
        pairs = {}
        for token, r in ranks.items():
            for k in range(1, len(token)):
                x, y = ranks.get(token[:k]), ranks.get(token[k:])
                if x is not None and y is not None:
                    pairs[x * self.span + y] = r
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()] + [0], np.int64)
        self.byte = np.array([ranks.get(bytes([k]), 0) for k in range(256)], np.int64)

    def rank(self, x: np.ndarray, y: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """Rank of the pair (x, y), then its position; NONE where the two don't merge."""
        key = x * self.span + y
        k = np.searchsorted(self.keys, key)
        k[k == len(self.keys)] = 0
        return np.where(self.keys[k] == key, self.values[k] * width + at, NONE)

    def encode(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of 2 to width bytes, as little-endian unsigned 32-bit integers."""
        m = len(pieces)
        n = np.fromiter(map(len, pieces), np.int64, m)
        here, at = np.arange(width)[None, :] < n[:, None], np.arange(width)
        ids = np.zeros((m, width + 1), np.int64)
        ids[:, :width][here] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before = np.tile(np.arange(1, width + 2), (m, 1)), np.tile(np.arange(-1, width), (m, 1))
        tree = np.full((m, 2 * width), NONE)
        r, c = np.nonzero(at[None, :] < n[:, None] - 1)
        tree[r, width + c] = self.rank(ids[r, c], ids[r, c + 1], c, width)
        for k in range(width - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])

        def put(rows: np.ndarray, k: np.ndarray, value: np.ndarray | int) -> None:
            k = k + width
            tree[rows, k] = value
            while k[0] > 1:
                k = k >> 1
                tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])

        rows = np.arange(m)
        while True:
            rows = rows[tree[rows, 1] != NONE]
            if not len(rows):
                break
            best = tree[rows, 1]
            i = best % width
            j = after[rows, i]
            ids[rows, i] = best // width
            k = after[rows, i] = after[rows, j]
            before[rows, k] = i
            here[rows, j] = False
            put(rows, j, NONE)
            put(rows, i, np.where(k < n[rows], self.rank(ids[rows, i], ids[rows, np.minimum(k, width)], i, width), NONE))
            p = before[rows, i]
            some = p >= 0
            if some.any():
                on, p = rows[some], p[some]
                put(on, p, self.rank(ids[on, p], ids[on, i[some]], p, width))
        flat = ids[:, :width][here].astype("<u4").tobytes()
        ends = np.concatenate(([0], np.cumsum(here.sum(axis=1)) * 4)).tolist()
        return [flat[i:j] for i, j in zip(ends, ends[1:], strict=False)]


class Codec:
    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = load_ranks(path)
        self.pattern, self.narrow = compiled(pattern), narrow(pattern)
        self.merger = Merger(self.ranks)
        self.pieces: dict[str, bytes] = {}
        self.tokens = {v: k for k, v in self.ranks.items()}

    def learn(self, new: set[str]) -> None:
        by: dict[int, list[tuple[str, bytes]]] = {}
        for text in new:
            piece = text.encode()
            r = self.ranks.get(piece)
            if r is not None:
                self.pieces[text] = r.to_bytes(4, "little")
            elif len(piece) > WIDTHS[-1]:
                self.pieces[text] = array("I", merge(piece, self.ranks)).tobytes()
            else:
                by.setdefault(next(w for w in WIDTHS if len(piece) <= w), []).append((text, piece))
        for width, have in by.items():
            for at in range(0, len(have), 4096):
                part = have[at : at + 4096]
                for (text, _), ids in zip(part, self.merger.encode([x for _, x in part], width), strict=True):
                    self.pieces[text] = ids

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        found = [(self.narrow if WIDE.search(x) is None else self.pattern).findall(x) for x in texts]
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        self.learn(set().union(*found).difference(self.pieces))
        for pieces in found:
            yield b"".join(map(self.pieces.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


def codec(name: str, pattern: str) -> Codec:
    return resident(f"bpe {name} {pattern}", lambda: Codec(SparkFiles.get(name), pattern))


def _codes(name: str, pattern: str, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(name, pattern)
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for ids in own.encode_all([x or "" for x in batch.column(1).to_pylist()]):
                back = own.decode(ids)
                for to, v in zip(out, (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest(), ids, back), strict=True):
                    to.append(v)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary())
            n = 5 if whole else 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out[:n], kinds, strict=False))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: n + 1])

    return run


def bpe(docs: DataFrame, vocabulary: str, pattern: str, whole: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if `whole`, ids (binary, 32-bit little-endian) and decoded (binary).

    The vocabulary file goes to the executors with addFile. A null text counts as empty and has no ids; rows stay one for
    one, repeated or with null doc_id; other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    spark.sparkContext.addFile(vocabulary)
    more = ", ids binary, decoded binary" if whole else ""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_codes(Path(vocabulary).name, pattern, whole), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + more)
