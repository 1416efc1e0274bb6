"""Language identification by a byte convolutional network (operator 1)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.batches import sliced

WIDTHS = (2, 3, 4)
WINDOW = 128
LANGUAGES = 5000


@dataclass
class ByteNet:
    """Filters of several widths over one-hot bytes, the largest response of each over a window, then softmax.

    kernel[b] holds what byte b adds to every filter at every place inside it: (256, sum of widths, filters).
    """

    languages: list[str]
    kernel: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Windows (n, WINDOW) of bytes to (n, widths * filters) responses after max pooling and the rectifier."""
        filters = self.kernel.shape[2]
        flat = self.kernel.reshape(256, -1)
        best = np.full((len(x), len(WIDTHS) * filters), -np.inf, np.float32)
        deep = max(WIDTHS)
        seen: list[np.ndarray] = []
        response = np.empty((len(x), filters), np.float32)
        for p in range(x.shape[1]):
            seen = [flat[x[:, p]], *seen[: deep - 1]]  # seen[d]: contributions of the byte d places back
            at = 0
            for k, width in enumerate(WIDTHS):
                if len(seen) >= width:
                    cut = [slice((at + j) * filters, (at + j + 1) * filters) for j in range(width)]
                    np.add(seen[width - 1][:, cut[0]], seen[width - 2][:, cut[1]], out=response)
                    for j in range(2, width):
                        response += seen[width - 1 - j][:, cut[j]]
                    own = best[:, k * filters : (k + 1) * filters]
                    np.maximum(own, response, out=own)
                at += width
        best += self.bias
        return np.maximum(best, 0, out=best)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.pooled(x) @ self.dense + self.offset
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], filters: int = 16, steps: int = 500, batch: int = 192, seed: int = 7) -> ByteNet:
    """Train by Adam on windows x (n, WINDOW) with labels y; languages are weighted inversely to their frequency."""
    rng = np.random.default_rng(seed)
    total, classes = sum(WIDTHS), len(languages)
    shapes = {"kernel": (256, total, filters), "bias": (len(WIDTHS) * filters,), "dense": (len(WIDTHS) * filters, classes), "offset": (classes,)}
    p = {k: (rng.normal(0, 0.15, s) if k in ("kernel", "dense") else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    weight = (len(y) / (classes * np.maximum(1, np.bincount(y, minlength=classes))))[y].astype(np.float32)
    base = np.cumsum((0, *WIDTHS))
    for step in range(1, steps + 1):
        at = rng.integers(0, len(x), min(batch, len(x)))
        xb, yb, wb = x[at], y[at], weight[at]
        pools, where = [], []
        for k, width in enumerate(WIDTHS):
            n = WINDOW - width + 1
            response = sum(p["kernel"][xb[:, j : j + n], base[k] + j] for j in range(width))
            top = response.argmax(1)
            where.append(top)
            pools.append(np.take_along_axis(response, top[:, None], 1)[:, 0])
        raw = np.concatenate(pools, 1) + p["bias"]
        hidden = np.maximum(raw, 0)
        z = hidden @ p["dense"] + p["offset"]
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        z[np.arange(len(yb)), yb] -= 1
        z *= wb[:, None] / len(yb)
        back = (z @ p["dense"].T) * (raw > 0)
        grad = {"dense": hidden.T @ z, "offset": z.sum(0), "bias": back.sum(0), "kernel": np.zeros(shapes["kernel"], np.float32)}
        rows = np.arange(len(xb))[:, None]
        columns = np.broadcast_to(np.arange(filters), (len(xb), filters))
        for k, width in enumerate(WIDTHS):
            own = back[:, k * filters : (k + 1) * filters]
            for j in range(width):
                np.add.at(grad["kernel"], (xb[rows, where[k] + j], base[k] + j, columns), own)
        rate = 0.01 * (1 - 0.9 * step / steps)
        for k in p:
            first[k] += 0.1 * (grad[k] - first[k])
            second[k] += 0.001 * (grad[k] ** 2 - second[k])
            p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return ByteNet(languages, **p)


def windows(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed-length windows over whole byte ranges: (windows, bytes of text in each, windows of each range)."""
    sizes = ends - begins
    count = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(begins)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = begins[owner] + place * WINDOW
    filled = np.minimum(WINDOW, ends[owner] - start)
    at = start[:, None] + np.arange(WINDOW)
    x = data[np.minimum(at, max(len(data) - 1, 0))]
    short = filled < WINDOW
    x[short] = np.where(np.arange(WINDOW) < filled[short, None], x[short], 32)
    return x, filled, count


def predict(net: ByteNet, texts: list[str]) -> tuple[list[str], list[float]]:
    """Language and score of whole texts: window log-probabilities averaged by bytes; `und` and 0 without any letter."""
    raw = [t.encode() for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(sizes)
    x, filled, count = windows(np.frombuffer(b"".join(raw), np.uint8), ends - sizes, ends)
    mean = np.zeros((len(texts), len(net.languages)))
    if len(x):
        logs = np.concatenate([net.log_probabilities(x[i : i + 4096]) for i in range(0, len(x), 4096)]) * filled[:, None]
        some = count > 0
        mean[some] = np.add.reduceat(logs, (np.cumsum(count) - count)[some]) / sizes[some, None]
    share = np.exp(mean - mean.max(1, keepdims=True))
    share /= share.sum(1, keepdims=True)
    best = share.argmax(1)
    letters = [any(map(str.isalpha, t)) for t in texts]
    return [net.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], [float(s) if ok else 0.0 for s, ok in zip(share.max(1), letters, strict=True)]


def training_rows(docs: DataFrame, per_language: int, per_document: int, text: str, label: str, key: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows and labels from at most per_language documents of each language, those whose keys have the least hashes, and
    at most per_document windows spread over each. Only these and a count per language reach the driver.

    A frequent language is thinned by its hashes to about eight times what is wanted before its rows meet in one task, so
    no task gets more of them as the table grows. More than LANGUAGES labels are refused: a network has an output for each.
    """
    labelled = docs.selectExpr(f"`{key}` AS k", f"`{label}` AS y").where("k IS NOT NULL AND y IS NOT NULL")
    counts = labelled.groupBy("y").count().limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} labels")
    if not counts:
        return np.empty((0, WINDOW), np.uint8), np.empty(0, int), []
    share = F.create_map(*[F.lit(x) for y, n in counts for x in (y, 8.0 * per_language / n)])[F.col("y")]
    spread = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < share * (1 << 30)
    place = Window.partitionBy("y").orderBy(F.pmod(F.xxhash64("k"), F.lit(1 << 30)), "k")
    chosen = labelled.where(spread).distinct().withColumn("r", F.row_number().over(place)).where(F.col("r") <= per_language).select("k", "y")

    def cut(batches):
        for batch in batches:
            for y, t in zip(batch.column("y").to_pylist(), batch.column("t").to_pylist(), strict=True):
                raw = np.frombuffer(t.encode(), np.uint8)
                x, filled, _ = windows(raw, np.array([0]), np.array([len(raw)]))
                x = x[filled > WINDOW // 4] if len(x) > 1 else x
                x = x[np.unique(np.linspace(0, len(x) - 1, per_document).astype(int))] if len(x) else x
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array([y] * len(x)), pa.array([w.tobytes() for w in x], pa.binary())], names=["y", "x"])

    rows = docs.selectExpr(f"`{key}` AS k", f"`{text}` AS t").where("t IS NOT NULL AND t <> ''").join(F.broadcast(chosen), "k").select("y", "t").mapInArrow(cut, "y string, x binary").toArrow()
    if not rows.num_rows:
        return np.empty((0, WINDOW), np.uint8), np.empty(0, int), []
    labels, found = np.unique(np.array(rows["y"].to_pylist(), object).astype(str), return_inverse=True)
    order = np.lexsort((found, np.array(rows["x"].to_pylist(), object)))  # the same rows in the same order, however tasks end
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.uint8).reshape(-1, WINDOW)
    return x[order], found[order], labels.tolist()


def identify(docs: DataFrame, training: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_language: int = 500, per_document: int = 4) -> DataFrame:
    """One row per row of docs: key, lang_pred, score (0 to 1).

    `training` gives the labelled rows; at most per_language documents of each language are used (a bounded sample). Texts
    without a letter, null and empty ones get `und` and 0. If no labelled row exists, all texts get `und`. Repeated and null
    keys stay; only text and key of docs are read.
    """
    kind = docs.schema[key].dataType.simpleString()
    x, y, languages = training_rows(training, per_language, per_document, text, label, key)
    net = fit(x, y, languages) if languages else None

    def run(batches):
        for part, texts in sliced(batches, "t"):
            names, scores = predict(net, texts) if net else (["und"] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[key, "lang_pred", "score"])

    return docs.selectExpr(f"`{key}` AS k", f"`{text}` AS t").mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = identify(docs.select("doc_id", "text"), docs.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
