"""SentencePiece encoding and decoding with original byte spans (operator 8).

The model file is read here field by field; the library is not used. Texts are normalised by longest-prefix matches in the
compiled character map, and each normalised byte keeps the original byte that it stems from. Merging works on units that no
piece can cross; equal units are merged once and kept in a bounded cache.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quire.llm.batches import sliced
from quire.llm.merging import PairTable

META = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: piece types of the model format


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol-buffer message: (number, integer or bytes)."""
    i = 0

    def integer() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(data):
        tag = integer()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, integer()
        else:
            n = integer() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, data[i : i + n]
            i += n


class CharacterMap:
    """The compiled normalisation map: a double-array trie of source strings, and the strings that replace them."""

    def __init__(self, blob: bytes):
        n = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + n], "<u4").tolist()
        self.targets = blob[4 + n :]

    def longest(self, data: bytes, i: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest source string that starts at i."""
        if not self.units:
            return None
        found = None
        unit = self.units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for j in range(i, len(data)):
            node ^= data[j]
            unit = self.units[node] if node < len(self.units) else 0
            if unit & 0x800000FF != data[j]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                at = self.units[node] & 0x7FFFFFFF
                found = j + 1 - i, self.targets[at : self.targets.index(b"\0", at)]
        return found


class Pieces:
    def __init__(self, path: str, limit: int = 500_000):
        with open(path, "rb") as f:
            model = list(fields(f.read()))
        normaliser = dict(fields(next((v for k, v in model if k == 3), b"")))
        trainer = dict(fields(next((v for k, v in model if k == 2), b"")))
        if trainer.get(3, 1) != 2:
            raise ValueError("not a BPE model")
        self.map = CharacterMap(normaliser.get(2, b""))
        self.dummy, self.squeeze, self.escape = (bool(normaliser.get(k, 1)) for k in (3, 4, 5))
        self.pieces: list[str] = []
        self.score: list[float] = []
        self.kind: list[int] = []
        for number, value in model:
            if number == 1:
                own = dict(fields(value))
                self.pieces.append(own.get(1, b"").decode())
                self.score.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kind.append(own.get(3, NORMAL))
        if USER in self.kind or UNUSED in self.kind:
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.unknown = self.kind.index(UNKNOWN)
        self.end = self.pieces.index("</s>")
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kind[i] == BYTE}
        self.id = {p: i for i, p in enumerate(self.pieces) if self.kind[i] == NORMAL}
        order = {s: r for r, s in enumerate(sorted({self.score[i] for i in self.id.values()}, reverse=True))}
        extra = sorted({c for p in self.id for c in p} - self.id.keys())  # characters that only longer pieces hold
        self.symbol = self.id | {c: len(self.pieces) + k for k, c in enumerate(extra)}
        pairs = [(self.symbol[p[:k]], self.symbol[p[k:]], order[self.score[i]], i) for p, i in self.id.items() for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol]
        self.table = PairTable(*map(list, zip(*pairs, strict=True)), every=False)
        inside = {c for p in self.id if len(p) > 1 for c in p}
        if any(META in p.lstrip(META) for p in self.id):
            self.unit = re.compile(r"(?s).+")  # a piece may cross words
        else:
            alone = "".join(c for c in "\n\t\r" if c not in inside)
            self.unit = re.compile(f"[{alone}]|{META}+[^{META}{alone}]*|[^{META}{alone}]+" if alone else f"{META}+[^{META}]*|[^{META}]+")
        self.cache: dict[str, tuple[str, str, bytes, int]] = {}
        self.limit = limit

    # normalisation

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its UTF-8 bytes plus one the original byte that it starts at."""
        data = text.encode()
        if not self.map.units and not self.squeeze:
            plain = np.frombuffer(data, np.uint8)
            width = np.where((plain == 32) & self.escape, 3, 1)
            at = np.repeat(np.arange(len(data)), width)
            body = text.replace(" ", META) if self.escape else text
        else:
            out, source = [], []
            i = 0
            while i < len(data):
                found = self.map.longest(data, i)
                n = found[0] if found else 1 + (data[i] >= 192) + (data[i] >= 224) + (data[i] >= 240)
                for byte in found[1] if found else data[i : i + n]:
                    out.append(byte)
                    source.append(i)
                i += n
            text, source = bytes(out).decode(), np.asarray(source, np.int64)
            if self.squeeze:
                flat = np.frombuffer(bytes(out), np.uint8)
                blank = flat == 32
                keep = ~(blank & np.concatenate([[True], blank[:-1]])) if len(flat) else np.ones(0, bool)
                n = len(flat)
                while n and not (keep[n - 1] and flat[n - 1] != 32):
                    keep[n - 1] = False
                    n -= 1
                text, source = flat[keep].tobytes().decode(), source[keep]
            plain = np.frombuffer(text.encode(), np.uint8)
            at = np.repeat(source, np.where((plain == 32) & self.escape, 3, 1))
            body = text.replace(" ", META) if self.escape else text
        if self.dummy and body:
            body = (META if self.escape else " ") + body
            first = at[0] if len(at) else 0
            at = np.concatenate([np.full(3 if self.escape else 1, first), at])
        return body, np.append(at, len(data))

    # merging

    def learn(self, units: list[str]) -> None:
        """Merge distinct units together; keep ids, their decimal text, decoded text and the pieces' normalised byte counts."""
        get = self.symbol.get
        flat = [get(c, -1) for u in units for c in u]
        symbols = np.asarray(flat, np.int64)
        strange = symbols < 0
        chars = "".join(units)
        symbols[strange] = len(self.pieces) + 100_000 + np.arange(int(strange.sum()))
        merged, counts = self.table.merge(symbols, np.fromiter(map(len, units), np.int64, len(units)))
        at = place = 0
        odd = np.flatnonzero(strange)
        for unit, n in zip(units, counts.tolist(), strict=True):
            ids: list[int] = []
            widths: list[int] = []
            for s in merged[at : at + n].tolist():
                if s < len(self.pieces):
                    ids.append(s)
                    widths.append(len(self.pieces[s].encode()))
                    continue
                char = chars[odd[s - len(self.pieces) - 100_000]] if s >= len(self.pieces) + 100_000 else next(c for c, k in self.symbol.items() if k == s)
                raw = char.encode()
                if self.bytes:
                    ids += [self.bytes[b] for b in raw]
                    widths += [1] * len(raw)
                else:
                    ids.append(self.unknown)
                    widths.append(len(raw))
            at += n
            place += len(unit)
            self.cache[unit] = " ".join(map(str, ids)), self.surface(ids), np.asarray(widths, "<u4").tobytes(), len(ids)

    def units(self, bodies: list[str]) -> Iterator[list[tuple[str, str, bytes, int]]]:
        """The cached results of the units of each normalised text; what is new in any of them is merged in one go."""
        names = list(map(self.unit.findall, bodies))
        missing = {u for own in names for u in own if u not in self.cache}
        if missing:
            if len(self.cache) + len(missing) > self.limit:
                self.cache.clear()
                missing = {u for own in names for u in own}
            self.learn(list(missing))
        return (list(map(self.cache.__getitem__, own)) for own in names)

    # decoding

    def surface(self, ids: list[int]) -> str:
        """Text of ids before the space marks and the dummy prefix are undone; runs of byte pieces become characters."""
        out: list[str] = []
        held = bytearray()
        for i in ids:
            if self.kind[i] == BYTE:
                held.append(int(self.pieces[i][3:5], 16))
                continue
            if held:
                out.append(unbyte(held))
                held = bytearray()
            if self.kind[i] == UNKNOWN:
                out.append(" ⁇ ")
            elif self.kind[i] != CONTROL:
                out.append(self.pieces[i])
        if held:
            out.append(unbyte(held))
        return "".join(out)

    def plain(self, surface: str) -> str:
        """Space marks back to spaces, without the dummy prefix."""
        if self.dummy and surface[:1] == META:
            surface = surface[1:]
        return surface.replace(META, " ")

    def decode(self, ids: list[int]) -> str:
        return self.plain(self.surface(ids))

    # whole texts

    def encode(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids without an end id, and for each piece the original byte where it begins and the one before which it ends."""
        body, at = self.normalise(text)
        found = next(self.units([body]))
        begins, ends = spans(at, [f[2] for f in found])
        return [int(i) for f in found for i in f[0].split(" ")], begins, ends

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str, int]]:
        """Number of ids with the end id, sha256 of their decimals and of the decoded text, and original bytes in spans."""
        normal = list(map(self.normalise, texts))
        for (_, at), found in zip(normal, self.units([body for body, _ in normal]), strict=True):
            decimals, surfaces, widths, counts = zip(*found, strict=True) if found else ((), (), (), ())
            begins, ends = spans(at, widths)
            ids = hashlib.sha256(" ".join([*decimals, str(self.end)]).encode()).hexdigest()
            decoded = hashlib.sha256(self.plain("".join(surfaces)).encode()).hexdigest()
            yield sum(counts) + 1, ids, decoded, int((ends - begins).sum())


def spans(at: np.ndarray, widths: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Original byte spans of pieces with the given normalised widths."""
    width = np.frombuffer(b"".join(widths), "<u4").astype(np.int64)
    ends = np.cumsum(width)
    return at[ends - width], at[ends]


def unbyte(data: bytearray) -> str:
    """Bytes to text; a byte that is no valid UTF-8 gives one replacement character."""
    out, i, raw = [], 0, bytes(data)
    while i < len(raw):
        n = 1 if raw[i] < 128 else 2 if raw[i] >> 5 == 6 else 3 if raw[i] >> 4 == 14 else 4 if raw[i] >> 3 == 30 else 1
        try:
            out.append(raw[i : i + n].decode())
            i += n
        except UnicodeDecodeError:
            out.append("�")
            i += 1
    return "".join(out)


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode_pieces(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: key, ids (with the end id), begins and ends (original UTF-8 byte span of each piece but the end id).

    Null texts are empty: their only id is the end id. Repeated and null keys stay; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        own = pieces(model)
        for part, texts in sliced(batches, "t"):
            rows = [own.encode(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column("k"), pa.array([[*r[0], own.end] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.int64()))],
                names=[key, "ids", "begins", "ends"],
            )

    return docs.selectExpr(f"`{key}` AS k", f"`{text}` AS t").mapInArrow(run, f"`{key}` {kind}, ids array<int>, begins array<long>, ends array<long>")


def piece_digests(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: key, n_tokens, ids_sha256, decoded_sha256, and covered_bytes, the original bytes in piece spans."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        own = pieces(model)
        for part, texts in sliced(batches, "t"):
            rows = list(own.digests(texts))
            yield pa.RecordBatch.from_arrays(
                [part.column("k"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int64())],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"],
            )

    return docs.selectExpr(f"`{key}` AS k", f"`{text}` AS t").mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
