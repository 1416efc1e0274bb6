"""Quality rules: base statistics, and a linear-chain conditional random field over lines (operator 10).

Only texts are labelled, lines are not: training starts from marks that lines bear by themselves (repeated, of symbols or
capitals, very short without an end of a sentence) and takes turns with decoding, as long as the share of content in a text's
lines agrees with its label. So the field sees both labels beside each other within texts.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.batches import sliced

SYMBOLS = b"#*$%&|<>"
WHITE = " \t\n\v\f\r"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
DIGITS = b"0123456789"
ENDS = b".!?:;\""
FEATURES = 12
CONTENT, BOILERPLATE = 0, 1


def line_features(line: bytes, words: list[bytes], again: bool) -> tuple[float, ...]:
    """Features of one line, each from 0 to 1; `again` says that an earlier line of the text is equal."""
    n, size = len(words), len(line)
    symbols = size - len(line.translate(None, SYMBOLS))
    letters = size - len(line.translate(None, LETTERS))
    upper = size - len(line.translate(None, UPPER))
    digits = size - len(line.translate(None, DIGITS))
    repeats = 1 - len(set(words)) / n
    return (
        1.0,
        min(1.0, symbols / n),
        min(1.0, 5 * symbols / size),
        min(1.0, 2 * line.count(b"!") / n),
        upper / letters if letters else 0.0,
        1.0 if letters and upper > 0.6 * letters else 0.0,
        repeats,
        1.0 if n >= 8 and repeats > 0.6 else 0.0,
        min(1.0, 3 * digits / size),
        1.0 if again else 0.0,
        min(1.0, n / 50),
        1.0 if n < 4 and line.rstrip()[-1] not in ENDS else 0.0,
    )


@dataclass
class LineField:
    """A linear-chain conditional random field with two labels; emission (FEATURES, 2), transition (2, 2) from row to column."""

    emission: np.ndarray
    transition: np.ndarray

    def decode(self, scores: np.ndarray) -> list[int]:
        """The best label sequence for the lines' emission scores (n, 2), by Viterbi; ties go to content."""
        (cc, cb), (bc, bb) = self.transition.tolist()
        back: list[tuple[int, int]] = []
        rows = scores.tolist()
        c, b = rows[0]
        for ec, eb in rows[1:]:
            from_c, from_b = c + cc, b + bc
            to_c, to_b = c + cb, b + bb
            back.append((0 if from_c >= from_b else 1, 0 if to_c >= to_b else 1))
            c, b = max(from_c, from_b) + ec, max(to_c, to_b) + eb
        labels = [0 if c >= b else 1]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def marked(x: np.ndarray) -> np.ndarray:
    """Which lines (n, FEATURES) bear a mark of boilerplate by themselves."""
    return (x[:, 1] > 0.3) | (x[:, 5] > 0) | (x[:, 6] > 0.6) | (x[:, 9] > 0) | (x[:, 11] > 0)


def fit_lines(sequences: list[np.ndarray], kept: list[bool], sizes: list[np.ndarray], content_share: float = 0.5, turns: int = 4) -> LineField:
    """A field from texts that bear one label each: lines of sizes[i] words, features sequences[i], kept[i] or not.

    First labels: boilerplate for marked lines and content for the others, as far as the text's share of content then agrees
    with its label, else the text's label for all its lines. After each fit the texts are decoded; those that agree with
    their label take the decoded labels, the others go back to their first ones.
    """

    def agreed(own: np.ndarray, k: bool, n: np.ndarray, other: np.ndarray) -> np.ndarray:
        return own if (n[own == CONTENT].sum() >= content_share * n.sum()) == k else other

    alike = [np.full(len(x), CONTENT if k else BOILERPLATE) for x, k in zip(sequences, kept, strict=True)]
    first = [agreed(np.where(marked(x), BOILERPLATE, CONTENT), k, n, own) for x, k, n, own in zip(sequences, kept, sizes, alike, strict=True)]
    labels, field = first, None
    for _ in range(turns):
        field = fit_field(sequences, labels, [CONTENT if k else BOILERPLATE for k in kept], field, 50 if field else 150)
        labels = [agreed(np.array(field.decode(x @ field.emission)), k, n, own) for x, k, n, own in zip(sequences, kept, sizes, first, strict=True)]
    return field


def fit_field(sequences: list[np.ndarray], labels: list, groups: list[int] | None = None, start: LineField | None = None, rounds: int = 150, rate: float = 0.3, decay: float = 1e-3) -> LineField:
    """Maximum likelihood by gradient ascent (Adam) with forward-backward over all sequences at once.

    labels holds an array per sequence, or one label for all its lines; groups (0 or 1, by default the first labels) weigh
    the same in total. Sequences stand from the longest to the shortest and lines by their place, so the lines of one place
    are neighbours, and those that go on come first.
    """
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    size = np.array([len(sequences[i]) for i in order])
    live = np.array([(size > k).sum() for k in range(size[0])])  # sequences with a line at place k
    begin = np.concatenate([[0], np.cumsum(live)])
    owner = np.concatenate([np.arange(m) for m in live])
    row = lambda k, j: begin[k] + j
    x, gold = np.empty((begin[-1], FEATURES)), np.zeros((begin[-1], 2))
    for j, i in enumerate(order):
        at = row(np.arange(size[j]), j)
        x[at] = sequences[i]
        gold[at, labels[i]] = 1
    y = np.array([groups[i] if groups is not None else int(np.ravel(labels[i])[0]) for i in order])
    weight = (1 / np.maximum(1, np.bincount(y[owner], minlength=2)) / 2)[y]
    after = np.concatenate([row(k, np.arange(live[k])) for k in range(1, len(live))]) if len(live) > 1 else np.empty(0, np.int64)
    before = np.concatenate([row(k - 1, np.arange(live[k])) for k in range(1, len(live))]) if len(live) > 1 else np.empty(0, np.int64)
    ends = row(size - 1, np.arange(len(size)))
    gold_e, gold_t = x.T @ (gold * weight[owner][:, None]), gold[before].T @ (gold[after] * weight[owner[after]][:, None])
    p = [start.emission, start.transition] if start else [np.zeros((FEATURES, 2)), np.zeros((2, 2))]
    first, second = ([np.zeros_like(v) for v in p] for _ in range(2))
    for step in range(1, rounds + 1):
        e, t = x @ p[0], p[1]
        forward, backward = e.copy(), np.zeros_like(e)
        for k in range(1, len(live)):
            own, prior = slice(begin[k], begin[k + 1]), slice(begin[k - 1], begin[k - 1] + live[k])
            forward[own] += np.logaddexp(forward[prior, :1] + t[0], forward[prior, 1:] + t[1])
        for k in range(len(live) - 1, 0, -1):
            own, prior = slice(begin[k], begin[k + 1]), slice(begin[k - 1], begin[k - 1] + live[k])
            reach = e[own] + backward[own]
            backward[prior] = np.logaddexp(reach[:, :1] + t[:, 0], reach[:, 1:] + t[:, 1])
        z = np.logaddexp(forward[ends, 0], forward[ends, 1])
        expect_e = x.T @ (np.exp(forward + backward - z[owner][:, None]) * weight[owner][:, None])
        expect_t = np.zeros((2, 2))
        if len(after):
            ahead = e[after] + backward[after] - z[owner[after]][:, None]
            for a in (0, 1):
                expect_t[a] = weight[owner[after]] @ np.exp(forward[before, a : a + 1] + t[a] + ahead)
        for k, g in enumerate((gold_e - expect_e - decay * p[0], gold_t - expect_t - decay * p[1])):
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            p[k] = p[k] + rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return LineField(*p)


def base(text: str, raw: bytes, lines: list[list[bytes]], keys: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = [w for line in lines for w in line]
    n = len(words)
    chars = len(text) - sum(map(text.count, WHITE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    full = [k for k, line in zip(keys, lines, strict=True) if line]
    repeat = 0
    if n >= 5 and len(set(grams := list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False)))) < len(grams):
        count = Counter(grams)
        reach = 0
        for i, g in enumerate(grams):
            if count[g] > 1:
                repeat += i + 5 - max(i, reach)
                reach = i + 5
    return n, chars, symbols, len(full) - len(set(full)), repeat


def judge(field: LineField | None, texts: list[str], content_share: float) -> list[tuple]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, share of words in content lines, kept."""
    out, features, held = [], [], []
    for text in texts:
        raw = text.encode()
        keys = raw.split(b"\n")
        lines = [k.split() for k in keys]
        figures = base(text, raw, lines, keys)
        failed = figures[0] < 10 or 100 * figures[4] > 20 * figures[0]
        if field and not failed:
            seen: set[bytes] = set()
            for k, words in zip(keys, lines, strict=True):
                if words:
                    features.append(line_features(k, words, k in seen))
                    seen.add(k)
            held.append((len(out), [len(words) for words in lines if words]))
        out.append([*figures, failed, 0.0 if failed else 1.0, not failed])
    if held:
        scores = np.asarray(features) @ field.emission
        at = 0
        for i, sizes in held:
            labels = field.decode(scores[at : at + len(sizes)])
            at += len(sizes)
            share = sum(n for n, k in zip(sizes, labels, strict=True) if k == CONTENT) / out[i][0]
            out[i][6], out[i][7] = share, share >= content_share
    return out


def train(docs: DataFrame, labels: DataFrame, per_class: int = 800, max_lines: int = 60, text: str = "text", key: str = "doc_id", label: str = "quality") -> LineField | None:
    """A field from at most per_class labelled texts of either class (chosen by a hash of the key) and their first max_lines
    lines with a word: a bounded sample, the only data that reach the driver. None if a class has no text."""
    each = labels.selectExpr(f"`{key}` AS k", f"`{label}` AS y").where("k IS NOT NULL AND y IN (0, 1)").groupBy("k").agg(F.min("y").alias("y"))
    picked = [each.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(per_class) for y in (0, 1)]
    chosen = picked[0].unionAll(picked[1])

    def lines(batches):
        for part, texts in sliced(batches, "t"):
            for y, t in zip(part.column("y").to_pylist(), texts, strict=True):
                seen: set[bytes] = set()
                rows, sizes = [], []
                for k in t.encode().split(b"\n"):
                    if (words := k.split()) and len(rows) < max_lines:
                        rows.append(line_features(k, words, k in seen))
                        sizes.append(len(words))
                        seen.add(k)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([y], pa.int32()), pa.array([np.asarray(rows, "<f8").tobytes()], pa.binary()), pa.array([sizes], pa.list_(pa.int32()))], names=["y", "x", "n"])

    rows = docs.selectExpr(f"`{key}` AS k", f"`{text}` AS t").where("t IS NOT NULL AND t <> ''").join(F.broadcast(chosen), "k").select(F.col("y").cast("int"), "t").mapInArrow(lines, "y int, x binary, n array<int>").toArrow()
    found = sorted(zip(rows["y"].to_pylist(), rows["x"].to_pylist(), rows["n"].to_pylist(), strict=True))
    if len({y for y, *_ in found}) < 2:
        return None
    return fit_lines([np.frombuffer(x, "<f8").reshape(-1, FEATURES) for _, x, _ in found], [y == 1 for y, *_ in found], [np.array(n) for *_, n in found])


def assess(docs: DataFrame, field: LineField | None, content_share: float = 0.5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: key, the base statistics, base_failed, content_share, kept.

    Null and empty texts have no words and fail. Without a field (no labels) the base rules alone decide. Texts are read
    whole; repeated and null keys stay; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"]
    types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]

    def run(batches):
        for part, texts in sliced(batches, "t"):
            columns = zip(*judge(field, texts, content_share), strict=True)
            yield pa.RecordBatch.from_arrays([part.column("k"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[key, *names])

    return docs.selectExpr(f"`{key}` AS k", f"`{text}` AS t").mapInArrow(run, f"`{key}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean")


def keep_good(docs: DataFrame, field: LineField | None, content_share: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text the rules keep."""

    def run(batches):
        for part, texts in sliced(batches, text):
            yield part.filter(pa.array([v[-1] for v in judge(field, texts, content_share)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return assess(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
