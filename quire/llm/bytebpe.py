"""Byte-level BPE: units, token counts by rank-synchronous merging, and ids from the tokenizers library behind a unit cache."""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import regex

from quire.llm.merging import PairTable
from quire.llm.words import span_hashes

# The published splitting pattern of this vocabulary family and its special token.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANK = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: A unit is a run without white space, with the one space before it; the splitting pattern never joins across two units.
UNIT = re.compile(f" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
PRE = regex.compile(PRE_TOKEN.replace(r"[^\s\p{L}\p{N}]", rf"[^{BLANK}\p{{L}}\p{{N}}]").replace(r"\s", f"[{BLANK}]").replace(r"\S", f"[^{BLANK}]"))


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file: itself where it is printable in Latin-1,
    else the next code point from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    shown = {chr(b): b for b in printable}
    return shown | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}


class UnitCache:
    """What is known of units, for one Python worker.

    A text that is cut at its single spaces falls into pieces that stand for units with a space before them, as long as no
    piece is empty or has white space at an end; the value of any other piece is None, and such a text is cut by UNIT.
    The first `core` entries stay; the later ones go when `limit` is reached. Frequent units come early.
    """

    def __init__(self, core: int, limit: int):
        self.core, self.limit = core, limit
        self.after: dict[str, object] = {}  # piece -> value of the unit " " + piece
        self.plain: dict[str, object] = {}  # unit -> value
        self.kept: dict[str, object] | None = None

    def value(self, units: list[str]) -> list:
        raise NotImplementedError

    def spaced(self, pieces: list[str]) -> list:
        """The values of the units " " + piece."""
        return self.value([" " + p for p in pieces])

    def get(self, texts: list[str]) -> list[list]:
        """The values of the units of each text."""
        found = []
        known = self.after.get
        missing: set[str] = set()
        for text in texts:
            head, *pieces = text.split(" ")
            values = list(map(known, pieces))
            holes = [i for i, v in enumerate(values) if v is None] if None in values else ()
            missing.update(pieces[i] for i in holes)
            found.append((head, pieces if holes else None, values, holes))
        if missing:
            self.learn(missing)
        out, heads, odd = [], [], []
        known = self.after.get
        for k, (head, pieces, values, holes) in enumerate(found):
            bad = bool(head) and head[-1] in BLANK
            for i in holes:
                v = values[i] = known(pieces[i])
                bad = bad or v is None
            if bad or (not head and values and not texts[k][1:2].strip(BLANK)):
                odd.append(k)
            elif head:
                heads.append(k)
            out.append(values)
        for k, values in zip(heads, self.lookup([UNIT.findall(found[k][0]) for k in heads]), strict=True):
            out[k] = values + out[k]
        for k, values in zip(odd, self.lookup([UNIT.findall(texts[k]) for k in odd]), strict=True):
            out[k] = values
        if len(self.after) > self.limit:
            if self.kept is None:
                self.kept = dict(list(self.after.items())[: self.core])
            self.after = dict(self.kept)
        return out

    def learn(self, pieces: set[str]) -> None:
        good = [p for p in pieces if p and p[0] not in BLANK and p[-1] not in BLANK]
        self.after.update(zip(good, self.spaced(good), strict=True))

    def lookup(self, split: list[list[str]]) -> list[list]:
        missing = list({u for units in split for u in units if u not in self.plain})
        if missing:
            if len(self.plain) > self.limit // 8:
                self.plain.clear()
                missing = list({u for units in split for u in units})
            self.plain.update(zip(missing, self.value(missing), strict=True))
        return [[self.plain[u] for u in units] for units in split]


class RankCounter(UnitCache):
    """Counts tokens without the library: pre-tokens that the cache lacks go through PairTable.merge together."""

    def __init__(self, path: str, core: int = 400_000, limit: int = 900_000):
        super().__init__(core, limit)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.start = np.zeros(256, np.int64)
        for shown, byte in byte_alphabet().items():
            self.start[byte] = vocab[shown]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        merged = [vocab[a + b] for a, b in merges]
        self.table = PairTable([vocab[a] for a, _ in merges], [vocab[b] for _, b in merges], range(len(merges)), merged, every=len(set(merged)) == len(merged))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; special strings count as one token each, as the library does by default."""
        parts = [self.cut.split(t) if self.cut and any(s in t for s in self.special) else [t] for t in texts]
        counts = iter(self.get([p for own in parts for p in own]))
        return [len(own) - 1 + sum(sum(next(counts)) for _ in own) for own in parts]

    def value(self, units: list[str]) -> list[int]:
        """Token counts of distinct units: their pre-tokens as ragged byte arrays, merged rank by rank."""
        pre = [PRE.findall(u) for u in units]
        flat = [p.encode() for ps in pre for p in ps]
        lengths = np.fromiter(map(len, flat), np.int64, len(flat))
        _, survivors = self.table.merge(self.start[np.frombuffer(b"".join(flat), np.uint8)], lengths)
        per = np.fromiter(map(len, pre), np.int64, len(pre))
        total = np.concatenate([[0], np.cumsum(survivors)])
        end = np.cumsum(per)
        return (total[end] - total[end - per]).tolist()


class UnitTable:
    """A hash table of units in numpy arrays: open addressing over 64-bit hashes, each verified by a second one.

    Looking up a whole slice is a few gathers. Rows are numbered in the order in which units were added; when the table is
    full only the first `core` rows stay.
    """

    def __init__(self, bits: int, core: int):
        self.mask, self.core, self.limit = np.uint64((1 << bits) - 1), core, 1 << (bits - 1)
        self.slot = np.full(1 << bits, -1, np.int32)
        self.key, self.check = (np.zeros(self.limit, np.uint64) for _ in range(2))
        self.rows = 0

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Row of each unit, -1 if it is new."""
        out = np.full(len(key), -1, np.int64)
        todo, at = np.arange(len(key)), (key & self.mask).astype(np.int64)
        while len(todo):
            row = self.slot[at]
            held = row >= 0
            hit = held & (self.key[row] == key[todo]) & (self.check[row] == check[todo])
            out[todo[hit]] = row[hit]
            on = held & ~hit
            todo, at = todo[on], (at[on] + 1) & int(self.mask)
        return out

    def add(self, key: np.ndarray, check: np.ndarray) -> None:
        """Append distinct new units as the next rows."""
        rows = np.arange(self.rows, self.rows + len(key))
        self.key[rows], self.check[rows] = key, check
        self.rows += len(key)
        at = (key & self.mask).astype(np.int64)
        while len(rows):
            free = self.slot[at] < 0
            where, first = np.unique(at[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            self.slot[where] = rows[placed]
            left = np.ones(len(rows), bool)
            left[placed] = False
            rows, at = rows[left], (at[left] + 1) & int(self.mask)

    def shrink(self) -> None:
        keep = min(self.core, self.rows)
        key, check = self.key[:keep].copy(), self.check[:keep].copy()
        self.slot[:] = -1
        self.rows = 0
        self.add(key, check)


HEAD = np.uint64(0x5851F42D4C957F2D)  # keeps units without a space before them apart


class IdEncoder:
    """Ids from the tokenizers library as little-endian uint32 bytes.

    Texts are cut at spaces and each piece is looked up by hash in a UnitTable whose rows lead to ids in one pool. The
    library encodes only new units; they are joined, encoded as one text and cut again before each token that starts with a
    space, because the splitting pattern starts afresh there and nowhere else in them. A text with a piece that is empty or
    has white space at an end (two spaces, a space beside a line break), or with a special string, goes to the library whole.
    """

    def __init__(self, path: str, bits: int = 21, core: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        blank = next(c for c, b in byte_alphabet().items() if b == 32)
        vocab = spec["model"]["vocab"]
        self.opens = np.zeros(max(vocab.values()) + 2, bool)
        self.opens[[i for piece, i in vocab.items() if piece[0] == blank]] = True
        self.table = UnitTable(bits, core)
        self.at, self.size = np.zeros(self.table.limit, np.int64), np.zeros(self.table.limit, np.int64)
        self.pool, self.used = np.zeros(1 << 20, "<u4"), 0

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = {k for k, t in enumerate(texts) if any(s in t for s in self.special)}
        own = ["" if k in whole else t for k, t in enumerate(texts)] if whole else texts
        data = np.frombuffer(" ".join(own).encode(), np.uint8)
        size = np.fromiter((len(t) if t.isascii() else len(t.encode()) for t in own), np.int64, len(own))
        bound = np.concatenate([[0], np.cumsum(size + 1)])
        space = np.flatnonzero(data == 32)
        begin, end = np.concatenate([[0], space + 1]), np.append(space, len(data))
        first = np.searchsorted(begin, bound)  # pieces of text k: first[k] to first[k + 1] - 1, its head in front
        key, check = span_hashes(data, begin, end), span_hashes(data, begin, end, 1)
        key[first[:-1]] ^= HEAD
        row = self.table.find(key, check)
        while len(new := np.flatnonzero(row < 0)):
            _, pick = np.unique(key[new], return_index=True)
            pick = new[pick]
            if self.table.rows + len(pick) > self.table.limit:
                self.table.shrink()
                self.used = int((self.at[: self.table.rows] + np.maximum(self.size[: self.table.rows], 0)).max(initial=0))
                row = self.table.find(key, check)
                new = np.flatnonzero(row < 0)
                _, pick = np.unique(key[new], return_index=True)
                pick = new[pick]
            self.learn([data[a:b].tobytes().decode() for a, b in zip(begin[pick].tolist(), end[pick].tolist(), strict=True)], np.isin(pick, first[:-1]), key[pick], check[pick])
            row[new] = self.table.find(key[new], check[new])
        n = self.size[row]
        odd = np.zeros(len(own), bool)
        odd[np.searchsorted(first, np.flatnonzero(n < 0), side="right") - 1] = True
        n = np.maximum(n, 0)
        ends = np.cumsum(n)
        ids = self.pool[np.repeat(self.at[row] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        raw, cut = ids.tobytes(), np.concatenate([[0], ends])[first].tolist()
        return [self.bare(texts[k]) if odd[k] or k in whole else raw[4 * cut[k] : 4 * cut[k + 1]] for k in range(len(texts))]

    def bare(self, text: str) -> bytes:
        return np.asarray(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def learn(self, pieces: list[str], head: np.ndarray, key: np.ndarray, check: np.ndarray) -> None:
        """Rows for new pieces; a size of -1 marks those that can't stand for a unit."""
        good = np.array([bool(p) and p[0] not in BLANK and p[-1] not in BLANK for p in pieces], bool)
        spaced = np.flatnonzero(good & ~head)
        parts, sizes = [], np.full(len(pieces), -1, np.int64)
        order = []
        for i in range(0, len(spaced), 4000):
            own = spaced[i : i + 4000]
            ids = np.frombuffer(self.bare(" " + " ".join([pieces[k] for k in own])), "<u4")
            cut = np.append(np.flatnonzero(self.opens[ids]), len(ids))
            if len(cut) != len(own) + 1:
                raise ValueError("a unit does not start with exactly one token that starts with a space")
            parts.append(ids)
            sizes[own] = np.diff(cut)
            order.append(own)
        for k in np.flatnonzero(head):
            if pieces[k] and pieces[k][-1] in BLANK:
                continue
            ids = np.frombuffer(self.bare(pieces[k]), "<u4")
            parts.append(ids)
            sizes[k] = len(ids)
            order.append(np.array([k]))
        rows = np.arange(self.table.rows, self.table.rows + len(pieces))
        self.table.add(key, check)
        self.size[rows], self.at[rows] = sizes, 0
        if not parts:
            return
        order, flat = np.concatenate(order), np.concatenate(parts)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        ends = np.cumsum(sizes[order])
        self.at[rows[order]] = self.used + ends - sizes[order]
        self.used += len(flat)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> RankCounter:
    """One per Python worker; its cache lives on over the worker's tasks."""
    return RankCounter(path)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> IdEncoder:
    return IdEncoder(path)
