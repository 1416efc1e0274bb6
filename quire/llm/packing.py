"""Harmonic packing of token sequences (operator 3)."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from quire.llm.batches import sliced
from quire.llm.bytebpe import encoder

#: Class k holds tails of length in (capacity / (k + 1), capacity / k]; the last class holds all shorter ones.
CLASSES = 12


class HarmonicPacker:
    """Packs one worker's documents; the state is one open bin per class, up to WAITING closed ones and less than three sequences of stock.

    A document is cut into full sequences and a tail. The tail's length gives its reciprocal-capacity class k; a bin of
    class k closes at its k-th tail (in the last class, when the next tail no longer fits). What a closed bin lacks is cut
    from the stock: full sequences of long documents where they come, else the emptiest closed bins, one of which gives its
    documents to the gaps of the others whenever too many wait. All other bins keep the tails that they closed with. At the
    end of the input the bins that are left go the same way, open ones first, and the last stock is cut at powers of two,
    so that no sequence needs padding. origin counts sequences: "full" (one cut of a long document), "bin", "cut".
    """

    WAITING = 32

    def __init__(self, capacity: int = 2048, classes: int = CLASSES, first_sequence: int = 0):
        self.capacity, self.classes = capacity, classes
        self.bins: list[list] = [[] for _ in range(classes + 1)]
        self.stock: deque = deque()
        self.held = 0
        self.waiting: list[list] = []
        self.sequence = first_sequence
        self.origin = {"full": 0, "bin": 0, "cut": 0}

    def add(self, document: int, ids: bytes) -> Iterator[tuple]:
        """Yields (document, start, ids of the piece, tokens of the document, sequence, offset)."""
        n, c = len(ids) // 4, self.capacity
        full = n - n % c
        for start in range(0, full, c):
            piece = (document, start, ids[4 * start : 4 * (start + c)], n)
            if self.held < c:
                self.store([piece])
                yield from self.settle()
            else:
                yield from self.close([piece], "full")
        if n > full:
            tail = (document, full, ids[4 * full :], n)
            k = min(c // (n - full), self.classes)
            own = self.bins[k]
            if k == self.classes and sum(map(size, own)) + n - full > c:
                self.bins[k] = []
                yield from self.fill(own)
            self.bins[k].append(tail)
            if k < self.classes and len(self.bins[k]) == k:
                own, self.bins[k] = self.bins[k], []
                yield from self.fill(own)

    def store(self, pieces: list) -> None:
        self.stock.extend(pieces)
        self.held += sum(map(size, pieces))

    def fill(self, own: list) -> Iterator[tuple]:
        """Top a closed bin up from the stock, or let it wait."""
        self.waiting.append(own)
        if self.capacity - sum(map(size, own)) <= self.held:
            yield from self.settle()
        while len(self.waiting) > self.WAITING:
            self.store(self.waiting.pop(min(range(len(self.waiting)), key=lambda i: sum(map(size, self.waiting[i])))))
            yield from self.settle()

    def settle(self) -> Iterator[tuple]:
        """Close waiting bins, those with the smallest gaps first, as far as the stock goes."""
        self.waiting.sort(key=lambda own: -sum(map(size, own)))
        done = 0
        for own in self.waiting:
            gap = self.capacity - sum(map(size, own))
            if gap > self.held:
                break
            yield from self.close(own + self.take(gap), "bin")
            done += 1
        del self.waiting[:done]

    def take(self, want: int) -> list:
        out = []
        self.held -= want
        while want:
            piece = self.stock.popleft()
            if size(piece) > want:
                piece, rest = split(piece, want)
                self.stock.appendleft(rest)
            out.append(piece)
            want -= size(piece)
        return out

    def finish(self) -> Iterator[tuple]:
        """Everything that is left: bins that never closed give their tails away first."""
        for own in self.bins:
            self.store(own)
        self.bins = [[] for _ in range(self.classes + 1)]
        yield from self.settle()
        while self.waiting:
            self.store(self.waiting.pop())
            yield from self.settle()
        while self.held:
            yield from self.close(self.take(min(self.capacity, 1 << (self.held.bit_length() - 1))), "cut")

    def close(self, pieces: list, origin: str) -> Iterator[tuple]:
        offset = 0
        self.origin[origin] += 1
        for document, start, ids, n in pieces:
            yield document, start, ids, n, self.sequence, offset
            offset += len(ids) // 4
        self.sequence += 1


def size(piece: tuple) -> int:
    return len(piece[2]) // 4


def split(piece: tuple, n: int) -> tuple[tuple, tuple]:
    document, start, ids, total = piece
    return (document, start, ids[: 4 * n], total), (document, start + n, ids[4 * n :], total)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if they are wanted.

    Null texts are empty and still get their end id; each row of a repeated key is packed. A sequence holds `capacity` ids
    or a power of two of them. Workers pack independently: there is no shuffle, and sequence ids carry the partition in
    their upper 31 bits, so a task that is run again gives the same rows. Empty tables give no rows.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        own = encoder(tokenizer)
        tail = np.asarray([end_id], "<u4").tobytes()
        packer = HarmonicPacker(capacity, first_sequence=TaskContext.get().partitionId() << 32)
        held: list[tuple] = []

        def block(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([r[0] for r in rows], key_type), pa.array([r[1] for r in rows], pa.int64()), pa.array([len(r[2]) // 4 for r in rows], pa.int64()), pa.array([zlib.crc32(r[2]) for r in rows], pa.int64())]
            columns += [pa.array([r[i] for r in rows], pa.int64()) for i in (3, 4, 5)]
            names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(r[2], "<i4") for r in rows], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names=names)

        key_type = None
        for part, texts in sliced(batches, "t"):
            key_type = part.column("k").type
            for document, raw in zip(part.column("k").to_pylist(), own.encode(texts), strict=True):
                held.extend(packer.add(document, raw + tail))
            if held:
                yield block(held)
                held = []
        if key_type is not None and (held := list(packer.finish())):
            yield block(held)

    schema = f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.selectExpr(f"`{key}` AS k", f"`{text}` AS t").mapInArrow(run, schema)


def op3_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
