import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quire.llm.bytebpe import IdEncoder, RankCounter
from quire.llm.merging import PairTable
from quire.llm.packing import HarmonicPacker, pack
from quire.llm.pieces import CharacterMap, Pieces, encode_pieces, piece_digests
from quire.llm.token_counts import token_counts
from quire.llm.token_files import id_digests, read_range, read_tokens, with_starts, write_tokens
from quire.session import scratch_path

BPE = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
POOL = " \n\t\r'sdtlmrevab\x0b\x0c\x1c\x1f\x85\xa0 　​éß中文ñ123٣²½,.!?'’-_😀👍🏽ำ<|endoftext|>▁</s><0x41>"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


def fuzz(seed: int, n: int = 4000) -> list[str]:
    rng = random.Random(seed)
    texts = ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return [*texts, "", " ", "  ", " a", "a ", "\n a", "a \n b", "a" * 700, "!?" * 300, "th" * 200, "<|endoftext|>" * 3, " x<|endoftext|> y"]


def test_counts_and_ids_equal_the_library(library):
    texts = fuzz(1)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert RankCounter(BPE).count(texts) == list(map(len, want))
    assert [np.frombuffer(x, "<u4").tolist() for x in IdEncoder(BPE).encode(texts)] == want


def test_small_caches_change_nothing(library):
    texts = fuzz(2, 500)
    counter, encoder = RankCounter(BPE, core=3, limit=10), IdEncoder(BPE, bits=8, core=20)
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert counter.count([t]) == [len(want)]
        assert np.frombuffer(encoder.encode([t])[0], "<u4").tolist() == want


def test_merging_equals_one_at_a_time():
    rng = random.Random(4)
    pairs = sorted({(rng.randrange(6), rng.randrange(6)) for _ in range(14)})
    table = PairTable([a for a, _ in pairs], [b for _, b in pairs], [rng.randrange(9) for _ in pairs], [6 + k for k in range(len(pairs))], every=False)
    sequences = [[rng.randrange(6) for _ in range(rng.choice([0, 1, 2, 5, 40, 150]))] for _ in range(60)]
    got, counts = table.merge(np.array([x for s in sequences for x in s]), np.array(list(map(len, sequences))))
    lookup = {(k >> 20, k & (1 << 20) - 1): (r, m) for k, r, m in zip(table.keys.tolist(), table.rank.tolist(), table.merged.tolist())}
    want = []
    for s in sequences:
        s = list(s)
        while ranked := [(lookup[p][0], i) for i, p in enumerate(zip(s, s[1:])) if p in lookup]:
            i = min(ranked)[1]
            s[i : i + 2] = [lookup[s[i], s[i + 1]][1]]
        want.append(s)
    assert counts.tolist() == list(map(len, want)) and got.tolist() == [x for s in want for x in s]


def test_token_counts(docs, rows, none, library):
    got = sorted(map(tuple, token_counts(docs, BPE).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert got == sorted(want, key=str)
    assert token_counts(none, BPE).count() == 0


def test_token_files_round_trip(spark, docs, rows, none, library):
    path = scratch_path(spark, "t")
    write_tokens(docs, path, BPE, 2)
    got = with_starts(id_digests(read_tokens(spark, path, ["doc_id", "n_tokens", "ids"])), path).orderBy("start").collect()
    want = [(i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for i, t, *_ in rows]
    want.sort(key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in got] == [i for i, _ in want]
    assert [r.start for r in got] == np.cumsum([0, *(len(x) for _, x in want)])[:-1].tolist()
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((i or -1, len(x), zlib.crc32(x.tobytes())) for i, x in want)
    assert set(read_tokens(spark, path, ["n_tokens"]).columns) == {"part", "local_start", "n_tokens"}
    empty = scratch_path(spark, "t")
    write_tokens(none, empty, BPE, 2)
    assert with_starts(id_digests(read_tokens(spark, empty, ["doc_id", "n_tokens", "ids"])), empty).count() == 0


def test_pieces_equal_the_library():
    own, library = Pieces(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for t in fuzz(5):
        ids, begins, ends = own.encode(t)
        assert ids == library.encode(t), ascii(t)
        assert own.decode(ids) == library.decode(ids), ascii(t)
        raw = t.encode()
        assert b"".join(raw[a:b] for a, b in zip(begins.tolist(), ends.tolist())) == raw


def test_decode_of_any_ids_equals_the_library():
    own, library, rng = Pieces(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(6)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(3, 262), rng.randrange(262, 32000)]) for _ in range(rng.randint(0, 12))]
        assert own.decode(ids) == library.decode(ids)


def test_character_map_takes_the_longest_prefix():
    # a double array for the sources "a" and "ab": nodes are placed by label xor offset
    units = [0] * 1024
    value = 1 << 31
    units[0] = 256 << 10 >> 0 & ~0
    a = 256 ^ ord("a")
    units[a] = ord("a") | 1 << 8 | 512 << 10
    node = a ^ 512
    units[node] = value | 0
    ab = node ^ ord("b")
    units[ab] = ord("b") | 1 << 8 | 128 << 10
    units[ab ^ 128] = value | 3
    blob = np.array(units, "<u4").tobytes()
    chars = CharacterMap(np.uint32(len(blob)).tobytes() + blob + b"xy\0z\0")
    assert chars.longest(b"abc", 0) == (2, b"z") and chars.longest(b"ac", 0) == (1, b"xy") and chars.longest(b"c", 0) is None
    own = Pieces(MODEL)
    own.map = chars
    body, at = own.normalise("c abac")
    assert body == "▁c▁zxyc" and at.tolist() == [0, 0, 0, 0, 1, 1, 1, 2, 4, 4, 5, 6]


def test_piece_queries(docs, rows, none):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids) + 1, hashlib.sha256(" ".join(map(str, [*ids, 2])).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), len((t or "").encode())))
    assert sorted(map(tuple, piece_digests(docs, MODEL).collect()), key=str) == sorted(want, key=str)
    assert encode_pieces(docs, MODEL).count() == len(rows) and piece_digests(none, MODEL).count() == 0


def test_packing(docs, rows, none, library):
    got = pack(docs, BPE, capacity=64, with_ids=True).collect()
    by_sequence, by_doc = {}, {}
    for r in got:
        assert r.length == len(r.ids) > 0 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for pieces in by_sequence.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 64 and end & (end - 1) == 0
    want = {}
    for i, t, *_ in rows:
        want.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 1])
    assert by_doc.keys() == want.keys()
    for i, texts in want.items():
        assert sum(r.length for r in by_doc[i]) == sum(map(len, texts))
        if len(texts) == 1:
            pieces = sorted(by_doc[i], key=lambda r: r.start)
            assert [x for r in pieces for x in r.ids] == texts[0] and {r.doc_tokens for r in pieces} == {len(texts[0])}
    assert pack(none, BPE).count() == 0


def test_packer_fills_all_but_the_last_sequences():
    rng, packer, out = random.Random(8), HarmonicPacker(256), []
    sizes = [rng.choice([1, 30, 100, 200, 256, 700, 2000]) for _ in range(500)]
    for k, n in enumerate(sizes):
        out += packer.add(k, b"\0\0\0\0" * n)
    out += packer.finish()
    filled = {}
    for _, _, ids, _, sequence, _ in out:
        filled[sequence] = filled.get(sequence, 0) + len(ids) // 4
    assert sum(filled.values()) == sum(sizes) and sum(n != 256 for n in filled.values()) <= 8
    assert len(out) < 3 * len(sizes) + sum(sizes) // 256


@pytest.mark.parametrize("n", [3, 5, 9, 10, 11])
def test_regular_pieces_get_their_own_ids(library, n):
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    texts = [f"q {a}", f"q {b}", a, b, f"{a} {b} {a}"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in IdEncoder(BPE).encode(texts)] == want


def test_bins_keep_their_count_without_long_documents():
    """Documents shorter than a sequence only: nearly all sequences come from bins of a fixed count, none is padded."""
    rng = random.Random(7)
    packer, out, lengths = HarmonicPacker(), [], [rng.randint(1, rng.choice([300, 1000, 2047])) for _ in range(6000)]
    for k, n in enumerate(lengths):
        out += packer.add(k, np.full(n, k, "<u4").tobytes())
    out += packer.finish()
    sizes = {}
    for document, start, ids, n, sequence, offset in out:
        assert set(np.frombuffer(ids, "<u4").tolist()) == {document} and n == lengths[document] and offset == sizes.get(sequence, 0)
        sizes[sequence] = offset + len(ids) // 4
    assert sum(sizes.values()) == sum(lengths) and all(n == 2048 or n & (n - 1) == 0 for n in sizes.values())
    assert packer.origin["full"] == 0 and packer.origin["cut"] <= 12 and packer.origin["bin"] > 0.97 * len(sizes)
    assert len(out) < 1.4 * len(lengths)  # most documents stay whole


def test_files_have_their_encodings_and_ranges_read_less(spark):
    import glob

    import pyarrow.parquet as pq

    docs = spark.range(0, 6000).selectExpr("id AS doc_id", "concat('word ', id, ' of some text ', id * 7) AS text")
    path = scratch_path(spark, "t")
    write_tokens(docs.coalesce(1), path, BPE, 2)
    files = glob.glob(f"{path.removeprefix('file:')}/*.parquet")
    assert files
    for f in files:
        group = pq.ParquetFile(f).metadata.row_group(0)
        columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings) and columns["ids.list.element"].dictionary_page_offset
        for name in ("doc_id", "n_tokens", "local_start"):
            assert "DELTA_BINARY_PACKED" in columns[name].encodings and columns[name].has_offset_index and columns[name].has_column_index
    some = read_range(spark, path, 100, 180, ["n_tokens"])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,100)" in plan and "ids" not in plan.split("ReadSchema")[1]
    assert sorted(r.doc_id for r in some.collect()) == list(range(100, 181))
    ids = {r.doc_id: r.ids for r in read_range(spark, path, 5, 6, ["ids"]).collect()}
    assert sorted(ids) == [5, 6] and ids[5][-1] == 2
