"""Texts far beyond a slice of a batch: near copies of 150,000 words, through every stage that reads whole texts."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quire.llm.batches import SLICE_CHARS
from quire.llm.jaccard import jaccard_classes
from quire.llm.lines import line_report
from quire.llm.packing import pack
from quire.llm.substrings import removals

BPE = public_tokenizers.path("byte_bpe_50k.json")
WORDS = 150_000


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 10))) for _ in range(WORDS)]
    lines = [" ".join(words[i : i + 12]) for i in range(0, WORDS, 12)]
    own = "\n".join(lines)
    near = "\n".join([*lines[:6000], "one line that only the second text has, with more than ten words in it", *lines[6001:]])
    assert len(own) > SLICE_CHARS
    return {1: own, 2: near, 3: "a short text of its own with a few more words than ten in it", 4: None, 5: ""}


@pytest.fixture(scope="module")
def long_docs(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2).cache()


def test_near_copies_of_long_texts(long_docs, texts):
    got = {r.doc_id: r for r in jaccard_classes(long_docs, 5, 80).collect()}
    assert {d: r.component_id for d, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    assert got[1].n_shingles == WORDS - 4 and got[4].n_shingles == 0


def test_lines_and_passages_of_long_texts(long_docs, texts):
    lines = {r.doc_id: (r.n_lines, r.n_removed, r.longest_copy) for r in line_report(long_docs).collect()}
    assert lines == {1: (12500, 0, 0), 2: (12500, 12499, 6499), 3: (1, 0, 0), 4: (0, 0, 0), 5: (0, 0, 0)}
    gone = {r.doc_id: (r.n_words, r.n_removed) for r in removals(long_docs).collect()}
    own = len("one line that only the second text has, with more than ten words in it".split())
    assert gone == {1: (WORDS, 0), 2: (WORDS - 12 + own, WORDS - 12), 3: (15, 0), 4: (0, 0), 5: (0, 0)}


def test_packing_of_long_texts(long_docs, texts):
    rows = pack(long_docs, BPE).collect()
    library = Tokenizer.from_file(BPE)
    want = {d: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in texts.items()}
    for d, n in want.items():
        own = sorted((r.start, r.length) for r in rows if r.doc_id == d)
        assert own[0][0] == 0 and all(a + n_ == b for (a, n_), (b, _) in zip(own, own[1:])) and sum(n_ for _, n_ in own) == n


def test_stages_take_long_texts(spark, long_docs):
    docs = long_docs.where("doc_id <= 3")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = corpus_pipeline.materialise(stage(spark, docs, ""), name)
    assert {r.doc_id: len(r.text.split()) for r in docs.collect()} == {1: WORDS, 2: 15, 3: 15}
