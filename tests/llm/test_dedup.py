import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm.components import components
from quire.llm.jaccard import InvertedLists, Signatures, jaccard_classes
from quire.llm.lines import drop_later_lines, line_report, repeated_runs
from quire.llm.substrings import FingerprintIndex, SubstringIndex, remove_repeats, removals, selected
from quire.llm.words import shingle_sets, windows_of, words_of
from quire.session import listed, scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_sets(text: str | None, k: int) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute_classes(rows, k: int, num: int, den: int) -> dict:
    """Sets of a repeated id stand beside each other, as the operator counts them."""
    sets = [(i, brute_sets(t, k)) for i, t, *_ in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in parent}


def test_words_are_those_of_the_pattern():
    texts = ["a b", "", "x", " lead\ttrail \x0b\x0c\r\n", "é\xa0ß  ö", "A\x1cB"]
    words = words_of(texts)
    got = [bytes(words.data[a:b]).decode() for a, b in zip(words.begin, words.end)]
    assert got == [w for t in texts for w in WORD.findall(t)]
    assert words.counts().tolist() == [len(WORD.findall(t)) for t in texts]
    same = words_of(["q a b q", "a b"])
    assert same.hash[1:3].tolist() == same.hash[4:6].tolist()


def test_shingle_sets_have_the_sizes_of_the_sets(rows):
    texts = [t or "" for _, t, *_ in rows]
    for k in (3, 5):
        assert [len(s) for s in shingle_sets(texts, k)] == [len(brute_sets(t, k)) for t in texts]


@pytest.mark.parametrize("num", [80, 90])
def test_linked_sets_share_a_key(num):
    rng, scheme = np.random.default_rng(num), Signatures(num, 100)
    for _ in range(1500):
        n = int(rng.choice([1, 2, 5, 9, 12, 17, 18, 26, 27, 60, 140, 400]) * rng.uniform(1, 1.3))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        drop = int(rng.integers(0, max(1, n // 4) + 1))
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[drop:]], rng.integers(0, 2**63, int(rng.integers(0, drop + 1)), dtype=np.uint64) * np.uint64(2)]))
        shared = len(np.intersect1d(a, b))
        if shared and 100 * shared >= num * (len(a) + len(b) - shared):
            assert set(scheme.keys(a).tolist()) & set(scheme.keys(b).tolist()), (len(a), len(b), shared)


def test_t_occurrence_search_equals_counting():
    rng = np.random.default_rng(1)
    for _ in range(60):
        records = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(12)]
        query = np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64)
        need = rng.integers(1, 20, len(records))
        want = [(r, len(np.intersect1d(x, query))) for r, x in enumerate(records) if len(np.intersect1d(x, query)) >= need[r]]
        for mu in (0.0085, 0.5):
            assert sorted(InvertedLists(records).search(query, need, mu)) == want


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 3), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 1, 9: 1, 4: 4, 5: 4} | dict.fromkeys(range(20, 26), 20)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_jaccard_classes(docs, rows, none, k, num):
    want = brute_classes(rows, k, num, 100)
    got = jaccard_classes(docs, k, num, 100).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == sorted((i, len(brute_sets(t, k)), want[i]) for i, t, *_ in rows if i is not None)
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard_classes(none).count() == 0


def test_chains_of_near_copies_stay_together(spark):
    """Neighbours link, ends do not: components need links between texts that are not a block's first."""
    words = [f"w{i}" for i in range(120)]
    rows = [(100 - k, " ".join(words[:k] + [f"v{i}" for i in range(k)] + words[2 * k :])) for k in range(0, 40)]
    want = brute_classes(rows, 3, 90, 100)
    a, b = (brute_sets(rows[k][1], 3) for k in (0, 39))
    assert len(set(want.values())) == 1 and 2 * len(a & b) < len(a | b)
    got = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def brute_removals(rows, window: int) -> list:
    first = {}
    for i, t, *_ in rows:
        words = WORD.findall(t or "")
        for k in range(len(words) - window + 1):
            if i is not None:
                key = tuple(words[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t, *_ in rows:
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if i is not None and first[tuple(words[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [50, 7])
def test_removals(docs, rows, none, window):
    assert sorted(map(tuple, removals(docs, window).collect()), key=str) == brute_removals(rows, window)
    assert removals(none, window).count() == 0


def test_selected_positions_follow_from_the_window():
    rng = np.random.default_rng(2)
    grams = rng.integers(0, 50, 400).astype(np.uint64)
    at = set(selected(grams, 31).tolist())
    assert all(i + int(grams[i : i + 31].argmin()) in at for i in range(len(grams) - 30))
    assert not len(selected(grams[:30], 31))


def test_index_compacts_its_runs(spark):
    path = scratch_path(spark, "t")
    index = FingerprintIndex(spark, path, 2)
    hits = []
    for k in range(7):
        batch = spark.createDataFrame([(h, k * 10 + d, 0) for h in (k, k + 1, 99) for d in (0, 1)], "h long, doc long, pos int").where(F.expr("h = 99 OR doc % 10 = 0"))
        hits.append({r.h for hit in index.add(batch) for r in hit.collect()})
        index.save()
    assert hits == [{99}] + [{k, 99} for k in range(1, 7)]
    assert index.entries().count() == 7 * 4 and max(map(len, index.levels)) <= 2 and len(index.levels) > 1
    assert len([f for f in listed(spark, path) if f.startswith("quire_run")]) == sum(map(len, index.levels))
    index.close()
    assert not index.tables
    again = FingerprintIndex(spark, path, 5)
    assert again.buckets == 2 and again.entries().count() == 7 * 4
    again.close()


def test_increments_equal_one_run(spark, rows):
    """Batches of ascending ids, the index opened anew between them, give what one run over all gives."""
    own = sorted((r[:2] for r in rows if r[0] is not None), key=lambda r: r[0])
    cut = own[len(own) // 2][0]
    parts = [[r for r in own if r[0] < cut], [r for r in own if cut <= r[0] < 9000], [r for r in own if r[0] >= 9000]]
    path, got = scratch_path(spark, "t"), []
    for part in parts:
        index = SubstringIndex(spark, path, 50, 3)
        got += [tuple(r) for r in index.add(spark.createDataFrame(part, "doc_id long, text string")).collect()]
        index.close()
    assert sorted(got, key=str) == brute_removals(own, 50)
    index = SubstringIndex(spark, path)
    with pytest.raises(ValueError, match="above 9000"):
        index.add(spark.createDataFrame(parts[0], "doc_id long, text string"))
    index.close()


def test_a_failed_batch_leaves_the_index_as_it_was(spark, monkeypatch):
    import quire.llm.substrings as module

    text = " ".join(f"w{k}" for k in range(80))
    path = scratch_path(spark, "t")
    index = SubstringIndex(spark, path, 50, 2)
    index.add(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    with monkeypatch.context() as m:
        m.setattr(module, "cuts_of", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.add(spark.createDataFrame([(2, text)], "doc_id long, text string"))
    index.close()
    index = SubstringIndex(spark, path)
    got = index.add(spark.createDataFrame([(2, "x " + text), (3, "y")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(2, 81, 80), (3, 1, 0)]
    index.close()


def test_remove_repeats_keeps_the_rest(docs, rows, none):
    got = remove_repeats(docs, 50)
    assert got.columns == docs.columns and got.count() == len(rows) and remove_repeats(none).count() == 0
    want = {(i, h) for i, _, _, h in brute_removals(rows, 50)}
    for r in got.collect():
        assert (r.doc_id, hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest()) in want
    untouched = {r[0]: r.text for r in got.collect()}
    assert untouched[0] is None and untouched[6] == "  \n\t "


def brute_lines(rows, min_words=10, min_places=20):
    """Lines that maximal runs cover, from the places of every run of 1, 2, 4, ... lines."""
    texts = {}
    for i, t in sorted({(i, t) for i, t, *_ in rows if i is not None and t is not None}):
        texts[i, t] = [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
    places, k = {}, 0
    while any(len(x) >= 1 << k for x in texts.values()):
        for own, lines in texts.items():
            for p in range(len(lines) - (1 << k) + 1):
                places.setdefault((k, *lines[p : p + (1 << k)]), []).append((own, p))
        k += 1
    out = {}
    for own, lines in texts.items():
        gone, longest = set(), 0
        for level in range(k):
            chains, last = [], None
            for p in range(len(lines) - (1 << level) + 1):
                found = places[level, *lines[p : p + (1 << level)]]
                first = found[0]
                if first == (own, p):
                    last = None
                    continue
                if last is None or last != (first[0], first[1] - 1):
                    chains.append([p, p])
                chains[-1][1] = p
                last = first
                if level == 0 and len(found) >= min_places:
                    gone.add(p)
            for i, j in chains:
                cover = range(i, j + (1 << level))
                longest = max(longest, len(cover))
                if sum(len(WORD.findall(lines[x])) for x in cover) >= min_words:
                    gone |= set(cover)
        out[own] = len(lines), gone, longest
    return out


def test_line_report(docs, rows, none):
    want = brute_lines(rows)
    got = line_report(docs).collect()
    assert len(got) == len(rows) and line_report(none).count() == 0
    expected = []
    for i, t, *_ in rows:
        n, gone, longest = want.get((i, t), (len([x for x in (t or "").split("\n") if x.strip()]), set(), 0))
        at, kept = 0, []
        for x in (t or "").split("\n"):
            if not x.strip(" \t\n\v\f\r"):
                kept.append(x)
                continue
            if at not in gone:
                kept.append(x)
            at += 1
        expected.append((i, n, len(gone), hashlib.sha256("\n".join(kept).encode()).hexdigest(), longest))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_longest_copies(spark):
    lines = [f"line {k} of some text" for k in range(40)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["new", *lines[3:20], "end"])), (3, "a\na\na\na\na"), (4, "alone")]
    got = {r.doc_id: r for r in line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: (r.longest_copy, r.n_removed) for d, r in got.items()} == {1: (0, 0), 2: (17, 17), 3: (4, 0), 4: (0, 0)}


def test_long_runs_of_short_lines_need_deep_levels(spark):
    """Four lines of three words whose single lines and pairs stand earlier in other places: only the run of four counts."""
    a, b, c, d = (f"{x} {x} {x}" for x in "abcd")
    rows = [(1, "\n".join([a, "1", b, "2", c, "3", d])), (2, "\n".join([a, b, "4", c, d, "5", b, c])), (3, "\n".join([a, b, c, d])), (4, "\n".join(["x", a, b, c, d]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: len(gone) for (i, _), (_, gone, _) in brute_lines(rows).items()}
    assert want == {1: 0, 2: 0, 3: 0, 4: 4}
    assert {r.doc_id: r.n_removed for r in line_report(df).collect()} == want
    assert {k: len(level.collect()) > 0 for k, level in enumerate(repeated_runs(df))} == {0: True, 1: True, 2: True}


def test_frequent_short_lines_go(spark):
    rows = [(k, f"document {k}\nHome\nabout {k % 7}") for k in range(40)]
    got = {r.doc_id: r.n_removed for r in line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: int(k > 0) for k in range(40)}


def test_lines_on_random_texts(spark):
    rng = np.random.default_rng(8)
    rows = [(k, "\n".join(rng.choice(["a b", "c", "d e f", "g h i j", "k", ""], rng.integers(1, 30)).tolist())) for k in range(40)]
    want = {i: (n, len(gone), longest) for (i, _), (n, gone, longest) in brute_lines(rows).items()}
    got = {r.doc_id: (r.n_lines, r.n_removed, r.longest_copy) for r in line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_drop_later_lines(docs, none):
    got = drop_later_lines(docs)
    assert got.columns == docs.columns and drop_later_lines(none).count() == 0
    report = {(r.doc_id, r.kept_sha256) for r in line_report(docs).collect()}
    for r in got.collect():
        assert r.text is None or (r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) in report


def regular(n: int) -> tuple[str, str]:
    """Two complementary strings of 2**n letters that polynomial hashes modulo powers of two can't tell apart."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [4, 6, 8, 10, 11])
def test_regular_texts_are_told_apart(spark, n):
    a, b = regular(n)
    words = words_of([f"{a} {b}"])
    assert words.hash[0] != words.hash[1]
    x, y = (words_of([" ".join(s)]).hash for s in (a, b))
    assert all(windows_of(x, k)[0] != windows_of(y, k)[0] for k in (1, 2, 3, 5, 20, 50, 1 << n) if k <= len(x) and (k > 1 or a[0] != b[0]))
    head = [f"w{k}" for k in range(30)]
    rows = [(1, " ".join([*head, a, *head])), (2, " ".join([*head, b, *head])), (3, f"line with {a} and nothing else in it so far\nend"), (4, f"line with {b} and nothing else in it so far\nfin"), (5, " ".join(a)), (6, " ".join(b)), (7, a), (8, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_classes(df, 3, 90).collect()} == brute_classes(rows, 3, 90, 100)
    if n in (6, 10):
        assert sorted(map(tuple, removals(df).collect()), key=str) == brute_removals(rows, 50)
        assert {r.doc_id: r.n_removed for r in line_report(df).collect()} == dict.fromkeys(range(1, 9), 0)
