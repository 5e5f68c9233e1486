"""Token packing with bounded space: few open windows in each partition, best fit, spare room filled by cutting.

Each partition reads its documents once, in order, and holds `open_windows` windows at most. A document first fills
whole windows; its rest goes to the open window that it fits best. If none fits it and no window may be opened, the
fullest one is filled up by cutting the rest and emitted. At the end the leftovers of the partition are merged, window by
window, into full sequences; the last few ids form sequences whose lengths are powers of two, which need no padding. So
no sequence is padded, the state of a task is open_windows * size ids, and no ids leave their partition.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, filterfalse
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import ensure_importable, resident

SIZE = 2048
OPEN = 32
END = 1
#: Pieces whose ids a worker keeps, some 250 bytes each; then it starts anew.
REMEMBERED = 1_200_000
#: Characters of text whose pieces are held at once (a longer text is held whole).
GROUP = 1 << 16
#: Pieces that the tokenizer meets at once, and the fixed mark of a token that ends a word.
LINE, WORD_END = 64, "</w>"
#: Sequence ids of one partition.
PER_PARTITION = 1 << 40


#: Letters and numbers of Unicode below U+0180, and the pieces that the tokenizer's pre-tokenizer keeps.
LETTERS, NUMBERS, SPACES = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
#: Characters with rules of their own (beyond U+017F, where lower case may be anywhere, or of two characters), and what may begin a special token.
ODD = re.compile("[^\x00-\u017f]|\u0130|<\\|")


class Words:
    """Ids (little-endian unsigned 32-bit) of texts, piece by piece, from the tokenizer when a piece is first seen.

    Its normalizer lowers case and composes characters; its pre-tokenizer keeps the pieces above. Texts with characters
    that need more than that are cut at ASCII white space only, across which neither looks, and the tokenizer does the rest.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.chunks = re.compile(r"[^ \t\n\r]+")
        self.ids: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True

    def _learn(self, pieces: list[str]) -> None:
        """Ids of new pieces, LINE of them to a line: a space parts pieces, and the last token of each, and no other, ends a word."""
        lines = [pieces[k : k + LINE] for k in range(0, len(pieces), LINE)]
        for line, e in zip(lines, self.tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = (np.flatnonzero(self.ends[ids]) * 4 + 4).tolist()
            raw = ids.tobytes()
            self.ids.update(zip(line, map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=True))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text; GROUP characters of them at once, so that their pieces stay in the processor's cache."""
        at, held = 0, 0
        for k, x in enumerate(texts):
            held += len(x)
            if held >= GROUP:
                yield from self._encode(texts[at : k + 1])
                at, held = k + 1, 0
        yield from self._encode(texts[at:])

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        odd = ["<|" in x if x.isascii() else ODD.search(x) is not None for x in texts]
        found = [self.chunks.findall(x) if o else PIECES.findall(x.lower()) for x, o in zip(texts, odd, strict=True)]
        if len(self.ids) > REMEMBERED:
            self.ids.clear()
        for kind in (False, True):
            new = set(filterfalse(self.ids.__contains__, chain.from_iterable(x for x, o in zip(found, odd, strict=True) if o is kind)))
            if kind:
                new = list(new)
                for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
                    self.ids[w] = array("I", e.ids).tobytes()
            else:
                self._learn(list(new))
        for pieces in found:
            yield b"".join(map(self.ids.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))


def words(name: str) -> Words:
    return resident(f"words {name}", lambda: Words(SparkFiles.get(name)))


class Packer:
    """Pieces (key, start, ids) into sequences; emit(list of (sequence, offset, key, start, ids))."""

    def __init__(self, size: int, open_windows: int, first: int) -> None:
        self.size, self.most, self.next = size, open_windows, first
        self.open: list[tuple[int, list]] = []  # (room, pieces)

    def _emit(self, pieces: list) -> list:
        out, at = [], 0
        for key, start, ids in pieces:
            out.append((self.next, at, key, start, ids))
            at += len(ids) // 4
        self.next += 1
        return out

    def add(self, key: object, ids: bytes) -> list:
        out, start, n = [], 0, len(ids) // 4
        while n - start >= self.size:
            out += self._emit([(key, start, ids[4 * start : 4 * (start + self.size)])])
            start += self.size
        while start < n:
            rest = n - start
            fits = [(room, k) for k, (room, _) in enumerate(self.open) if room >= rest]
            if fits:
                k = min(fits)[1]
            elif len(self.open) < self.most:
                k = len(self.open)
                self.open.append((self.size, []))
            else:
                k = min((room, k) for k, (room, _) in enumerate(self.open))[1]
            room, pieces = self.open[k]
            take = min(room, rest)
            pieces.append((key, start, ids[4 * start : 4 * (start + take)]))
            start += take
            self.open[k] = (room - take, pieces)
            if room == take:
                out += self._emit(pieces)
                del self.open[k]
        return out

    def finish(self) -> list:
        """Merge what is left: full sequences, then lengths that are powers of two."""
        out, pieces = [], [p for _, window in sorted(self.open, key=lambda w: w[0]) for p in window]
        self.open = []
        total = sum(len(p[2]) for p in pieces) // 4
        lengths = [self.size] * (total // self.size) + [1 << b for b in range(self.size.bit_length(), -1, -1) if total % self.size >> b & 1]
        pieces.reverse()
        for length in lengths:
            now = []
            while length:
                key, start, ids = pieces.pop()
                take = min(length, len(ids) // 4)
                now.append((key, start, ids[: 4 * take]))
                if 4 * take < len(ids):
                    pieces.append((key, start + take, ids[4 * take :]))
                length -= take
            out += self._emit(now)
        return out


def _pieces(name: str, size: int, open_windows: int, end: int | None, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = words(name)
        packer = Packer(size, open_windows, TaskContext.get().partitionId() * PER_PARTITION)
        tail = b"" if end is None else end.to_bytes(4, "little")

        def rows(found: list) -> pa.RecordBatch:
            cols = [[k[0] for _, _, k, _, _ in found], [s for _, _, _, s, _ in found], [len(i) // 4 for *_, i in found], [zlib.crc32(i) for *_, i in found], [k[1] for _, _, k, _, _ in found], [q for q, *_ in found], [o for _, o, *_ in found]]
            arrays = [pa.array(c, pa.int64()) for c in cols] + [pa.array([i for *_, i in found], pa.binary())] * whole
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(arrays)])

        for batch in batches:
            found: list = []
            texts = own.encode_all([x or "" for x in batch.column(1).to_pylist()])
            for doc_id, ids in zip(batch.column(0).to_pylist(), texts, strict=True):
                ids += tail
                found += packer.add((doc_id, len(ids) // 4), ids)
            yield rows(found)
        yield rows(packer.finish())

    return run


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, open_windows: int = OPEN, end: int | None = END, whole: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if `whole`, ids (binary).

    Each document's ids end with `end`; a null text has only that one. Documents keep the partitions they come in. Rows
    stand for themselves, repeated or with null doc_id. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    spark.sparkContext.addFile(vocabulary)
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * whole
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(Path(vocabulary).name, size, open_windows, end, whole), kinds)
