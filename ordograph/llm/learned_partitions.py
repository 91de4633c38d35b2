"""Approximate nearest neighbours by learned partitions.

A bounded sample of distinct vectors gets a neighbour graph, which recursive spectral bisection at the median cuts
into partitions of equal size, refined by swaps. A small network learns, from the partitions of each sample vector's
neighbours, which partitions hold a vector's neighbours; its outputs are shifted until the rows it puts into each
partition are as many. Every row is put into its most probable partition. A partition of more than LEAF_ROWS rows gets
partitions and a network of its own, from a bounded sample of its rows, up to LEVELS levels; so partitions grow in
number with the table, not in size. A query visits its most probable ones, by the product of the levels' probabilities,
and is compared there with all vectors, in double precision. How many it visits is measured on sample vectors.

Vectors that are null, zero, hold a null or non-finite component, or haven't the most frequent length (the smaller of
two) take no part. Equal vectors are kept once with their K + 1 smallest ids, which is all that a query can return of
them. Repeated rows count once. A table with few vectors has one partition and exact results; a query goes on to
further partitions until they hold more than K vectors. Extra columns play no part.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ordograph.llm.common import discard, written

K = 10
#: Most sample vectors; fewest of them for each partition; most partitions of a network; neighbours a target counts.
SAMPLE, EACH, FAN, COUNTED = 4096, 96, 32, 30
#: Rows beyond which a partition is cut again, and levels: up to FAN ** LEVELS partitions, whose networks are broadcast.
LEAF_ROWS, LEVELS = 100_000, 3
#: Share of sample vectors held back; share of their neighbours that the partitions a query visits must hold.
HELD_BACK, RECALL = 8, 0.95
ROW_BLOCK, QUERY_BLOCK = 8192, 1024


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, x): rows whose vector takes part, as doubles."""
    x = F.col("x")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    plain = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x")).filter(F.col("vec_id").isNotNull() & x.isNotNull()).filter(good)
    most = plain.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return plain.filter(F.size("x") == (most["n"] if most else 0))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    out, norms = [], (x * x).sum(axis=1)
    for at in range(0, len(x), 512):
        d = norms[None, :] - 2 * x[at : at + 512] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        part = np.argpartition(d, k - 1, axis=1)[:, :k]
        out.append(np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, axis=1), axis=1), axis=1))
    return np.concatenate(out)


def balanced_partition(near: np.ndarray, parts: int, seed: int = 3) -> np.ndarray:
    """A partition number for each vertex of the neighbour graph; sizes differ by at most one a bisection."""
    n = len(near)
    link = np.zeros((n, n), dtype=np.float32)
    link[np.repeat(np.arange(n), near.shape[1]), near.ravel()] = 1
    link = np.maximum(link, link.T)
    rng, out = np.random.default_rng(seed), np.zeros(n, dtype=np.int64)

    def cut(own: np.ndarray, parts: int, first: int) -> None:
        if parts == 1 or len(own) < 2:
            out[own] = first
            return
        a = link[np.ix_(own, own)]
        root = np.sqrt(np.maximum(a.sum(axis=1), 1e-3))
        v = rng.standard_normal(len(own)).astype(np.float32)
        for _ in range(60):  # power iteration beside the trivial vector
            v -= root * (root @ v) / (root @ root)
            v = v + (a @ (v / root)) / root
            v /= np.linalg.norm(v) + 1e-12
        half = len(own) * (parts // 2) // parts
        side = np.zeros(len(own), dtype=bool)
        side[np.argsort(v / root, kind="stable")[half:]] = True
        for _ in range(8):  # swap the vertices that gain most on either side
            pull = a @ side.astype(np.float32) - a @ (~side).astype(np.float32)
            p, q = np.flatnonzero(~side), np.flatnonzero(side)
            p, q = p[np.argsort(-pull[p], kind="stable")], q[np.argsort(pull[q], kind="stable")]
            m = min(len(p), len(q))
            gain = pull[p[:m]] - pull[q[:m]] - 2 * a[p[:m], q[:m]]
            m = min(int((gain > 0).cumprod().sum()), max(1, len(own) // 20))
            if not m:
                break
            side[p[:m]], side[q[:m]] = True, False
        cut(own[~side], parts // 2, first)
        cut(own[side], parts - parts // 2, first + parts // 2)

    cut(np.arange(n), parts, 0)
    return out


def train(x: np.ndarray, target: np.ndarray, hidden: int = 64, epochs: int = 15, seed: int = 5) -> dict:
    """A network with one hidden layer, by Adam on cross entropy with soft targets."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std() + 1e-12
    z = (x - mean) / scale
    p = [rng.standard_normal((x.shape[1], hidden)) * np.sqrt(2 / x.shape[1]), np.zeros(hidden), rng.standard_normal((hidden, target.shape[1])) * np.sqrt(1 / hidden), np.zeros(target.shape[1])]
    m, v, t = [0 * w for w in p], [0 * w for w in p], 0
    for epoch in range(epochs):
        order = rng.permutation(len(z))
        for at in range(0, len(z), 256):
            i = order[at : at + 256]
            h = np.maximum(z[i] @ p[0] + p[1], 0)
            o = h @ p[2] + p[3]
            o = np.exp(o - o.max(axis=1, keepdims=True))
            g = (o / o.sum(axis=1, keepdims=True) - target[i]) / len(i)
            gh = (g @ p[2].T) * (h > 0)
            t += 1
            for k, d in enumerate((z[i].T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0))):
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                p[k] -= 0.004 * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return {"mean": mean, "scale": scale, "p": p}


def logits(net: dict, x: np.ndarray) -> np.ndarray:
    return np.maximum((x - net["mean"]) / net["scale"] @ net["p"][0] + net["p"][1], 0) @ net["p"][2] + net["p"][3]


def fit(sample: np.ndarray) -> dict | None:
    """A network, or None for a sample of less than two partitions."""
    parts = int(min(FAN, len(sample) // EACH))
    if parts < 2:
        return None
    back = np.arange(len(sample)) % HELD_BACK == 0
    own = sample[~back]
    near = neighbour_graph(own, min(COUNTED, len(own) - 1))
    part = balanced_partition(near[:, :K], parts)
    target = np.zeros((len(own), parts))
    np.add.at(target, (np.repeat(np.arange(len(own)), near.shape[1] + 1), part[np.column_stack([np.arange(len(own)), near])].ravel()), 1)
    net = {"parts": parts, "shift": np.zeros(parts)} | train(own, target / target.sum(axis=1, keepdims=True))
    z = logits(net, sample)
    for step in range(60):  # until partitions hold as many rows each
        got = np.bincount((z + net["shift"]).argmax(axis=1), minlength=parts)
        net["shift"] -= 0.3 / (1 + step / 10) * np.log((got + 1) / (len(sample) / parts + 1))
    return net


def scores(nets: dict[int, dict], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the last partitions, log probability of each row in each). A code's digits, base FAN + 1, are its way."""
    codes, out = [], []

    def walk(code: int, upto: np.ndarray) -> None:
        net = nets.get(code)
        if net is None:
            codes.append(code)
            out.append(upto)
            return
        z = logits(net, x) + net["shift"]
        top = z.max(axis=1, keepdims=True)
        z = z - top - np.log(np.exp(z - top).sum(axis=1, keepdims=True))
        for k in range(net["parts"]):
            walk(code * (FAN + 1) + k + 1, upto + z[:, k])

    walk(0, np.zeros(len(x)))
    return np.array(codes), np.column_stack(out)


def placed_codes(nets: dict[int, dict], x: np.ndarray) -> np.ndarray:
    """Each row's partition: level by level the most probable."""
    code, level = np.zeros(len(x), dtype=np.int64), set(nets)
    while level:
        level = {int(c) for c in np.unique(code)} & set(nets)
        for c in level:
            at = np.flatnonzero(code == c)
            code[at] = c * (FAN + 1) + 1 + (logits(nets[c], x[at]) + nets[c]["shift"]).argmax(axis=1)
    return code


def needed_visits(nets: dict[int, dict], sample: np.ndarray) -> int:
    """As few partitions as hold RECALL of the neighbours of the sample vectors held back."""
    if not nets or len(sample) < 2 * HELD_BACK:
        return 1
    back = np.arange(len(sample)) % HELD_BACK == 0
    own, held = sample[~back], sample[back]
    k = min(K, len(own))
    d = (own * own).sum(axis=1)[None, :] - 2 * held @ own.T
    true = np.argpartition(d, k - 1, axis=1)[:, :k]
    codes, p = scores(nets, held)
    turn = np.argsort(np.argsort(-p, axis=1, kind="stable"), axis=1)
    column = {c: i for i, c in enumerate(codes.tolist())}
    place = np.array([column[c] for c in placed_codes(nets, own).tolist()])
    turns = np.bincount(np.take_along_axis(turn, place[true], axis=1).ravel(), minlength=len(codes))
    return int(np.searchsorted(np.cumsum(turns) / turns.sum(), RECALL)) + 1


def visited(nets: dict[int, dict], x: np.ndarray, held: dict[int, int], visits: int, k: int) -> list[np.ndarray]:
    """The partitions of each query: `visits` of them, and further ones while those before hold no more than k vectors."""
    codes, p = scores(nets, x)
    rows = np.array([held.get(c, 0) for c in codes.tolist()])
    order = np.argsort(-p, axis=1, kind="stable")
    before = np.cumsum(rows[order], axis=1) - rows[order]
    keep = (np.arange(len(codes))[None, :] < visits) | (before <= k)
    return [codes[o[m]] for o, m in zip(order, keep, strict=True)]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _compare(k: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(rows) and len(queries):
            x, q, ids = np.stack(rows.x), np.stack(queries.x), rows.ids.to_list()
            norms = (x * x).sum(axis=1)
            for at in range(0, len(q), 256):
                part = q[at : at + 256]
                d = norms[None, :] - 2 * part @ x.T + (part * part).sum(axis=1)[:, None]
                m = min(k + 1, len(x))
                limit = np.partition(d, m - 1, axis=1)[:, m - 1]
                slack = 1e-9 * (norms.max() + (part * part).sum(axis=1))
                for r in range(len(part)):
                    own = int(queries.query_id.iloc[at + r])
                    close = np.flatnonzero(d[r] <= limit[r] + slack[r])
                    exact = np.sqrt(((x[close] - part[r]) ** 2).sum(axis=1))
                    best = sorted((s, i) for s, c in zip(exact.tolist(), close.tolist(), strict=True) for i in ids[c] if i != own)[:k]
                    out["query_id"] += [own] * len(best)
                    out["vec_id"] += [i for _, i in best]
                    out["score"] += [s for s, _ in best]
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def nearest(rows: DataFrame, queries: DataFrame | None = None, every: int = 100, k: int = K, visits: int | None = None, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries (by default rows whose id is divisible by `every`)
    the k nearest other rows found, by Euclidean distance, ties to smaller ids."""
    plain = usable(rows, vec_id, vector)
    asked = plain.filter(F.col("vec_id") % every == 0) if queries is None else usable(queries, vec_id, vector)
    asked = asked.withColumnRenamed("vec_id", "query_id").distinct()
    nth = F.dense_rank().over(W.partitionBy("x").orderBy("vec_id"))
    kinds = written(plain.withColumn("_nth", nth).filter(F.col("_nth") <= k + 1).groupBy("x").agg(F.collect_set("vec_id").alias("ids")), "vectors")
    sample = kinds.select(F.array_min("ids").alias("id"), "x").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    sample = _matrix(sample["x"].combine_chunks()) if sample.num_rows else np.zeros((0, 1))
    spark, root = rows.sparkSession, fit(sample)
    nets = {0: root} if root else {}

    def put(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(placed_codes(sent.value, _matrix(b.column("x"))))], [*b.schema.names, "part"])

        return run

    placed, fits = None, bool(nets)
    for level in range(1, LEVELS + 1):
        sent = spark.sparkContext.broadcast(nets)  # at most FAN ** (LEVELS - 1) networks, each fitted on SAMPLE rows
        was, placed = placed, written(kinds.mapInArrow(put(sent), "x array<double>, ids array<long>, part long"), "placed")
        if was is not None:
            discard(was)
        held = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a partition
        large = {p: n for p, n in held.items() if n > LEAF_ROWS}
        if level == LEVELS or not large or not fits:
            break
        share = spark.createDataFrame([(p, SAMPLE / n) for p, n in large.items()], "part long, share double")
        drawn = F.pmod(F.xxhash64(F.lit(level), F.array_min("ids")), F.lit(1 << 40)) < F.col("share") * float(1 << 40)
        some = placed.join(F.broadcast(share), "part").filter(drawn).select("part", "x")  # a row a partition
        found = some.groupBy("part").applyInPandas(lambda pdf: pd.DataFrame({"part": pdf.part[:1], "net": [pickle.dumps(fit(np.stack(pdf.x)))]}), "part long, net binary")
        more = {r["part"]: pickle.loads(r["net"]) for r in found.collect()}
        nets = nets | {p: net for p, net in more.items() if net}
    visits = visits or needed_visits(nets, sample)
    told = spark.sparkContext.broadcast((nets, held))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ways = visited(*told.value[:1], _matrix(b.column("x")), told.value[1], visits, k) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ways, pa.list_(pa.int64()))], [*b.schema.names, "parts"])

    routed = asked.mapInArrow(ask, "query_id long, x array<double>, parts array<long>")
    routed = written(routed.select("query_id", "x", F.explode("parts").alias("part")), "routed")
    asks = {r["part"]: r["n"] for r in routed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a partition
    blocks = spark.createDataFrame([(p, -(-n // ROW_BLOCK), -(-asks[p] // QUERY_BLOCK)) for p, n in held.items() if p in asks] or [(0, 1, 1)], "part long, rb int, qb int")
    pairs = placed.join(F.broadcast(blocks), "part").withColumn("r", F.pmod(F.xxhash64(F.array_min("ids")), F.col("rb"))).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qb").cast("long") - 1)))
    askers = routed.join(F.broadcast(blocks), "part").withColumn("q", F.pmod(F.xxhash64("query_id"), F.col("qb"))).withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rb").cast("long") - 1)))
    found = pairs.select("part", "r", "q", "x", "ids").groupBy("part", "r", "q").cogroup(askers.select("part", "r", "q", "query_id", "x").groupBy("part", "r", "q")).applyInPandas(_compare(k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
