"""Quality classifier: a linear model on n-gram indicators scaled by naive Bayes log-count ratios.

Indicators of hashed character 1- to 3-grams (and of coarse length and variety bands) are scaled by the class
log-count ratio; hinge loss is then minimised by dual coordinate descent. A sigmoid fitted on margins of the other
half of the sample turns margins into scores from 0 to 1.

Texts that are null count as empty; an empty text has only its length band and gets a score as any other. Without
labelled rows of both classes each score is the share of label 1 (0.5 without labels). Rows repeat as given; of those
that share a doc_id the smallest text is learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

DIMS = 1 << 17
#: Most labelled rows that the classifier is fitted on, the first by a hash of doc_id.
SAMPLE = 10_000
#: Features beyond as many bytes stay packed in the driver: DIMS / 8 for each sampled row at most, 164 MB in all.
MOST_BYTES = 100_000_000
THRESHOLD = 0.3


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def indicators(text: str | None, flags: np.ndarray) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text; flags is a scratch array of DIMS booleans, all false."""
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    mix = np.uint32(2654435761)
    top = np.uint32(15)
    one = codes * mix
    flags[one >> top] = True
    if len(codes) > 1:
        two = (one[:-1] ^ (codes[1:] + np.uint32(0x9E37))) * mix
        flags[two >> top] = True
        if len(codes) > 2:
            flags[((two[:-1] ^ (codes[2:] + np.uint32(0x79B9))) * mix) >> top] = True
    words = text.split()
    flags[int(np.log2(len(words) + 1) * 2)] = True
    flags[100 + int(20 * len(set(words)) / max(1, len(words))) + 25 * min(3, len(words) // 100)] = True
    found = np.flatnonzero(flags)
    flags[found] = False
    return found


def packed(found: np.ndarray) -> bytes:
    """Feature numbers as bytes, or as a bit each where that is shorter."""
    if 32 * len(found) < DIMS:
        return found.astype("<i4").tobytes()
    bits = np.zeros(DIMS, dtype=bool)
    bits[found] = True
    return np.packbits(bits).tobytes()


def unpacked(got: bytes) -> np.ndarray:
    return np.frombuffer(got, dtype="<i4") if len(got) < DIMS // 8 else np.flatnonzero(np.unpackbits(np.frombuffer(got, dtype=np.uint8)))


def _featured(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    flags = np.zeros(DIMS, dtype=bool)
    for pdf in rows:
        yield pd.DataFrame({"doc_id": pdf.doc_id, "quality": pdf.quality, "found": [packed(indicators(t, flags)) for t in pdf.text]})


def _ratios(found: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    p, q = np.ones(DIMS), np.ones(DIMS)
    for ids, label in zip(found, y, strict=True):
        (p if label > 0 else q)[ids] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def _descend(found: list[np.ndarray], y: np.ndarray, cost: float, epochs: int, seed: int) -> np.ndarray:
    """Weights w of all indicators (last: bias) such that margin = sum(w[ids]) / norm + bias."""
    r = _ratios(found, y)
    r2 = r * r
    norm = np.array([np.sqrt(max(r2[ids].sum(), 1e-12)) for ids in found])
    v, bias, alpha, order = np.zeros(DIMS), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(y)):
            ids = found[i]
            x = r[ids] / norm[i]
            slope = y[i] * (v[ids] @ x + bias) - 1
            new = min(max(alpha[i] - slope / 2.0, 0.0), cost)  # |x|^2 + 1 for the bias
            if step := (new - alpha[i]) * y[i]:
                v[ids] += step * x
                bias += step
                moved = max(moved, abs(step))
            alpha[i] = new
        if moved < 1e-3:
            break
    return np.concatenate([v, [bias], r])


def _margin(model: np.ndarray, ids: np.ndarray) -> float:
    v, bias, r = model[:DIMS], model[DIMS], model[DIMS + 1 :]
    x = r[ids]
    return float(v[ids] @ x / np.sqrt(max(x @ x, 1e-12)) + bias)


def _sigmoid(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))) by Newton steps on smoothed labels."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        g, h = p - t, np.maximum(p * (1 - p), 1e-9)
        H = np.array([[(h * margins**2).sum() + 1e-6, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(H, [(g * margins).sum(), g.sum()])
        step *= min(1.0, 5 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


class Unpacked:
    """Feature numbers that are only unpacked while they are in use."""

    def __init__(self, held: list[bytes]):
        self.held = held

    def __getitem__(self, i: int) -> np.ndarray:
        return unpacked(self.held[i])

    def __iter__(self) -> Iterator[np.ndarray]:
        return map(unpacked, self.held)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cost: float = 4.0, epochs: int = 8, seed: int = 7) -> dict:
    """The model from at most `sample` labelled rows outside the held-out fifth."""
    marked = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality")).filter(~held_out(F.col("doc_id")))
    chosen = marked.orderBy(F.xxhash64(F.col("doc_id"), F.lit(seed)), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `sample` rows of two numbers at most
    texts = texts.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("text").alias("text"))
    got = texts.mapInPandas(_featured, "doc_id long, quality int, found binary").toArrow()  # DIMS / 8 bytes a row at most
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    y = np.where(got["quality"].to_numpy()[order] > 0, 1.0, -1.0)
    if not len(y) or len(set(y)) < 2:
        return {"constant": float((y > 0).mean()) if len(y) else 0.5}
    held = got["found"].to_pylist()
    found = [unpacked(held[i]).astype(np.int32) for i in order] if sum(map(len, held)) < MOST_BYTES else Unpacked([held[i] for i in order])
    half = np.arange(len(y)) % 2
    if all(len(set(y[half == k])) == 2 for k in (0, 1)):
        margins = np.zeros(len(y))
        for k in (0, 1):
            others = Unpacked([found.held[i] for i in np.flatnonzero(half != k)]) if isinstance(found, Unpacked) else [found[i] for i in np.flatnonzero(half != k)]
            model = _descend(others, y[half != k], cost, epochs, seed)
            for i in np.flatnonzero(half == k):
                margins[i] = _margin(model, found[i])
        model = _descend(found, y, cost, epochs, seed)
    else:
        model = _descend(found, y, cost, epochs, seed)
        margins = np.array([_margin(model, f) for f in found])
    a, b = _sigmoid(margins, y)
    return {"model": model, "a": a, "b": b}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs with score and predicted; other columns stay (a column of one of these names is replaced)."""
    if "constant" in model:
        scored = docs.withColumn("score", F.lit(model["constant"]))
    else:
        sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 * DIMS numbers

        @F.pandas_udf("double")
        def scorer(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            m, flags = sent.value, np.zeros(DIMS, dtype=bool)
            for part in texts:
                z = np.array([_margin(m["model"], indicators(t, flags)) for t in part])
                yield pd.Series(1 / (1 + np.exp(-np.clip(m["a"] * z + m["b"], -35, 35))))

        scored = docs.withColumn("score", scorer(F.col("text")))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
