"""N-gram Jaccard join with Bayesian candidate pruning.

Texts (copies count once) are sets of five-word shingles with MinHash values; bands of these deal texts into buckets, of
which those with the same members count once. In a bucket, all pairs have a byte of each MinHash value compared step by
step, and a pair is dropped once the posterior probability (uniform prior) that its similarity reaches the threshold falls
below `TOLERANCE`. Pairs left link texts into clusters; a bucket returns a spanning forest of them, and a large one is
compared in pairs of blocks. No text has moved so far. A cluster is then verified: in pairs of blocks of at most BLOCK
texts and about BLOCK_BYTES, all pairs go through the same test on other hashes, and those left are compared exactly on
the shingles themselves. A task returns counts of links and a spanning forest, never its pairs.

A text of one to four words has one shingle, all its words; texts without a word are linked with nothing, but equal
texts are one class as ever. A null text counts as empty. Rows that share a doc_id count as one document, whose links
add up; rows with a null doc_id are a class of their own text and have no links unless another copy has an id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ordograph.llm.common import components, written

N, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
#: A pair at the threshold shares no band with a probability of (1 - 0.8 ** 7) ** 36 = 2e-4.
BANDS, ROWS = 36, 7
#: Texts and bytes in a block; MinHash values in a step, and steps: all values of all bands.
BLOCK, BLOCK_BYTES, STEP, STEPS = 512, 32_000_000, 36, 7
#: Values of the byte that is kept of a MinHash value.
CHANCE = 256


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def factors(k: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _shingle_hashes(words: np.ndarray) -> np.ndarray:
    n = min(N, len(words))
    h = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        h = mixed(h + np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k])
    return h


def _digits(low: np.ndarray) -> np.ndarray:
    """A byte for each MinHash value; those of different values are equal with a probability of 1 / CHANCE."""
    return (mixed(low) >> np.uint64(56)).astype(np.uint8)


def _band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Band keys, and a byte of each MinHash value (`low`)."""
    by = factors(BANDS * ROWS, 11)
    weights = factors(ROWS, 12)
    which = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
    for b in batches:
        lists = b.column("words")
        flat, ends = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
        keys, lows = [], []
        for s, e in zip(ends[:-1], ends[1:], strict=True):
            if s == e:
                keys.append(None)
                lows.append(None)
                continue
            x = _shingle_hashes(flat[s:e])
            low = np.full(len(by), np.iinfo(np.uint64).max)
            for at in range(0, len(x), 256):  # stays in cache
                np.minimum(low, (x[at : at + 256, None] * by).min(axis=0), out=low)
            band = (low.reshape(BANDS, ROWS) >> np.uint64(7)) * weights
            keys.append(mixed(np.bitwise_xor.reduce(mixed(band), axis=1) + which).view(np.int64))
            lows.append(_digits(low).tobytes())
        columns = [b.column("doc_id"), b.column("sha"), b.column("size"), pa.array(keys, pa.list_(pa.int64())), pa.array(lows, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "sha", "size", "bands", "low"])


def word_hashes(text) -> F.Column:
    """64-bit hashes of the words (parts between ASCII white space) of a text."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def text_name(text) -> F.Column:
    """128 bits of a text's SHA-256, which stand for it."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def fewest_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For each step, the fewest equal bytes of MinHash values with which a pair stays: P(J >= threshold | matches) >=
    tolerance, where two bytes are equal with probability J + (1 - J) / CHANCE."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    equal = grid + (1 - grid) / CHANCE
    out = []
    for k in range(1, STEPS + 1):
        n = k * STEP
        for m in range(n + 1):
            logp = m * np.log(equal) + (n - m) * np.log1p(-equal)
            p = np.exp(logp - logp.max())
            if p[grid >= threshold].sum() / p.sum() >= tolerance:
                out.append(m)
                break
    return out


def _named(texts: list[str]) -> list[np.ndarray]:
    """Each text's sorted distinct shingles; equal shingles, and only they, get equal numbers over all texts."""
    names: dict[str, int] = {}
    words = [np.fromiter((names.setdefault(w, len(names)) for w in t.split()), dtype=np.int64) for t in texts]
    long = [i for i, w in enumerate(words) if len(w) >= N]
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(texts)
    if long:
        lengths = np.array([len(words[i]) for i in long])
        flat = np.concatenate([words[i] for i in long])
        two = np.unique(flat[:-1] << 32 | flat[1:], return_inverse=True)[1]
        four = np.unique(two[:-2] << 32 | two[2:], return_inverse=True)[1]
        five = np.unique(four[:-1] << 32 | flat[4:], return_inverse=True)[1] if len(flat) > 4 else four[:0]
        for i, s, n in zip(long, np.cumsum(lengths) - lengths, lengths, strict=True):
            out[i] = np.unique(five[s : s + n - N + 1])
    brief: dict[tuple, int] = {}
    for i, w in enumerate(words):
        if 0 < len(w) < N:
            out[i] = np.array([-1 - brief.setdefault(tuple(w), len(brief))])
    return out


def _compared(left: list[np.ndarray], right: list[np.ndarray], same: bool, threshold: float, needs: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of left, j of right; i < j if both are the same block) with similarity of at least threshold."""
    by = factors(STEP * STEPS, 13)

    def signed(sets: list[np.ndarray]) -> np.ndarray:
        low = np.full((len(sets), len(by)), np.iinfo(np.uint64).max)
        for r, x in zip(low, sets, strict=True):
            h = mixed(x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
            for at in range(0, len(h), 256):
                np.minimum(r, (h[at : at + 256, None] * by).min(axis=0), out=r)
        return _digits(low)

    a = signed(left)
    b = a if same else signed(right)
    na, nb = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    i, j = _likely(a, b, same, needs)
    sized = (np.minimum(na[i], nb[j]) >= threshold * np.maximum(na[i], nb[j]) - 1e-9) & (na[i] > 0) & (nb[j] > 0)
    i, j = i[sized], j[sized]
    found = np.zeros(len(i), dtype=bool)
    starts = np.flatnonzero(np.diff(i, prepend=-1))
    for lo, hi in zip(starts, np.append(starts[1:], len(i)) if len(i) else starts, strict=True):
        mine = left[i[lo]]
        for at in range(lo, hi, 256):
            others = [right[x] for x in j[at : min(at + 256, hi)]]
            flat, sizes = np.concatenate(others), np.array([len(x) for x in others])
            where = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
            both = np.add.reduceat(mine[where] == flat, np.cumsum(sizes) - sizes, dtype=np.int64)
            found[at : at + len(others)] = both >= threshold * (len(mine) + sizes - both) - 1e-9
    return i[found], j[found]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one that pairs (i, j) connect it with."""
    root = np.arange(n)

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return np.array([top(x) for x in range(n)], dtype=np.int64)


def _likely(a: np.ndarray, b: np.ndarray, same: bool, needs: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of a, j of b; i < j if both are the same) of MinHash rows that pass every step."""
    equal = np.zeros((len(a), len(b)), dtype=np.uint16)
    for k in range(STEP):
        equal += a[:, k][:, None] == b[:, k][None, :]
    stays = equal >= needs[0]
    if same:
        stays &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
    i, j = np.nonzero(stays)
    score = equal[i, j]
    for step in range(1, STEPS):
        cols = slice(step * STEP, (step + 1) * STEP)
        score = score + np.concatenate([(a[i[p : p + 65536], cols] == b[j[p : p + 65536], cols]).sum(axis=1) for p in range(0, len(i), 65536)] or [score])
        keep = score >= needs[step]
        i, j, score = i[keep], j[keep], score[keep]
    return i, j


def _linked(needs: list[int]):
    """Spanning forests of the likely pairs of each (key, one, two), whose rows come one after the other."""

    def groups(table: pa.Table) -> pa.RecordBatch:
        cols = [table.column(c).to_numpy() for c in ("key", "one", "two", "part", "doc_id")]
        key, one, two, part, ids = cols
        low = np.frombuffer(b"".join(table.column("low").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
        heads = np.flatnonzero(np.append(True, (np.diff(key) != 0) | (np.diff(one) != 0) | (np.diff(two) != 0)))
        sizes = np.diff(np.append(heads, len(ids)))
        a, b = [], []
        pairs = heads[(sizes == 2) & (one[heads] == two[heads])]
        if len(pairs):
            matches = (low[pairs] == low[pairs + 1]).reshape(len(pairs), STEPS, STEP).sum(axis=2).cumsum(axis=1)
            good = pairs[(matches >= np.array(needs)).all(axis=1)]
            a.append(ids[good])
            b.append(ids[good + 1])
        for s, n in zip(heads, sizes, strict=True):
            if n < 2 or (n == 2 and one[s] == two[s]):
                continue
            side = part[s : s + n]
            p, q = s + np.flatnonzero(side == one[s]), s + np.flatnonzero(side == two[s])
            i, j = _likely(low[p], low[q], one[s] == two[s], needs)
            root = _forest(n, p[i] - s, q[j] - s)
            own = np.flatnonzero(root != np.arange(n))
            a.append(ids[s + own])
            b.append(ids[s + root[own]])
        empty = np.zeros(0, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([empty, *x])) for x in (a, b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if waiting is None else pa.concat_tables([waiting, pa.Table.from_batches([batch])])
            if not table.num_rows:
                continue
            names = [table.column(c).to_numpy() for c in ("key", "one", "two")]
            last = np.flatnonzero(np.any([x != x[-1] for x in names], axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on
            if cut:
                yield groups(table.slice(0, cut))
            waiting = table.slice(cut)
        if waiting is not None and waiting.num_rows:
            yield groups(waiting)

    return run


def _block_pair(threshold: float, needs: list[int]):
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        ids, side = pdf.doc_id.to_numpy(), pdf.block.to_numpy()
        sets = _named(list(pdf.text))
        lo, hi = pdf.one.iloc[0], pdf.two.iloc[0]
        p, q = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
        i, j = _compared([sets[x] for x in p], [sets[x] for x in q], lo == hi, threshold, needs)
        i, j = p[i], q[j]
        apart = ids[i] != ids[j]
        i, j = i[apart], j[apart]
        root = _forest(len(ids), i, j)
        links = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
        own = np.flatnonzero(links)
        return pd.DataFrame({"doc_id": ids[own], "links": links[own], "peer": ids[root[own]]})

    return compare


def likely_clusters(firsts: DataFrame, needs: list[int], lows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, root): texts (doc_id, bands) connected by pairs that the posterior test leaves; lows gives the MinHash
    values (doc_id, low) of a table of doc_ids."""
    keys = written(firsts.select("doc_id", F.explode("bands").alias("key")), "keys")
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("z"), F.min("doc_id").alias("a")).filter("n > 1")
    shared = written(shared.groupBy("n", "z", "a").agg(F.min("key").alias("key")).select("key", "n"), "buckets")
    placed = written(keys.join(shared, "key").select("key", "n", "doc_id"), "members")
    members = placed.join(written(lows(placed.select("doc_id").distinct()), "lows"), "doc_id")
    members = members.withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    spread = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread = spread.select("key", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "part", "doc_id", "low")
    sorted_rows = spread.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two")
    edges = written(sorted_rows.mapInArrow(_linked(needs), "a long, b long"), "likely")
    # a text keeps its link with its smallest root, and its other roots get theirs with that one
    stars = edges.groupBy("a").agg(F.min("b").alias("least"), F.collect_set("b").alias("all"))  # at most a root a band and block
    stars = written(stars, "stars")
    linked = stars.select("a", "least").union(stars.select(F.explode("all").alias("a"), "least").filter("a <> least").distinct()).toDF("a", "b")
    return components(linked, "clusters").withColumnRenamed("node", "doc_id")


def _classes(plain: DataFrame, threshold: float, tolerance: float, by_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sha) of each row and (sha, text_id, class_id, n_links) of each text; by_text: doc_id stands for the
    text, so rows that share it are compared once."""
    needs = fewest_matches(threshold, tolerance)
    keyed = plain.select("doc_id", text_name(F.col("text")).alias("sha"), F.octet_length("text").cast("long").alias("size"), word_hashes(F.col("text")).alias("words"))
    keyed = written(keyed.mapInArrow(_band_keys, "doc_id long, sha binary, size long, bands array<long>, low binary"), "bands")
    classes = written(keyed.groupBy("sha").agg(F.min("doc_id").alias("text_id")), "texts")
    firsts = keyed.filter("bands is not null").select("doc_id", "sha", "bands")
    firsts = firsts.dropDuplicates(["doc_id"]) if by_text else firsts.join(classes, (F.col("doc_id") == F.col("text_id")) & (firsts.sha == classes.sha), "left_semi")
    names = classes.select(F.col("text_id").alias("doc_id"), "sha")

    def lows(ids: DataFrame) -> DataFrame:
        wanted = written(ids.join(names, "doc_id"), "wanted")  # of known size, to be broadcast while small
        return keyed.select("doc_id", "sha", "low").join(wanted, ["doc_id", "sha"], "left_semi").groupBy("doc_id").agg(F.first("low").alias("low"))

    clusters = written(likely_clusters(firsts, needs, lows), "cluster")
    measured = clusters.join(keyed.groupBy("doc_id").agg(F.max("size").alias("size")), "doc_id")
    sizes = written(measured, "measured").groupBy("root").agg(F.count("*").alias("m"), F.sum("size").alias("bytes"))
    dealt = (
        clusters.join(sizes, "root")
        .withColumn("blocks", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    )
    dealt = written(dealt, "dealt")  # of known size, so that a join broadcasts it while it is small, rather than shuffle all texts
    text_of = plain.join(dealt, "doc_id")
    text_of = text_of.dropDuplicates(["doc_id"]) if by_text else text_of
    spread = text_of.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})
    links = spread.select("root", "one", "two", "block", "doc_id", "text").groupBy("root", "one", "two").applyInPandas(_block_pair(threshold, needs), "doc_id long, links long, peer long")
    links = written(links, "links")
    near = components(links.select(F.col("doc_id").alias("a"), F.col("peer").alias("b")), "near")
    counts = links.groupBy("doc_id").agg(F.sum("links").alias("n_links"))
    found = classes.join(counts, classes.text_id == counts.doc_id, "left").drop("doc_id").join(near, F.col("text_id") == near.node, "left")
    found = found.select("sha", "text_id", F.coalesce("root", "text_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return keyed.select("doc_id", "sha"), found


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, text_id, class_id, n_links) for each row of docs (doc_id, text).

    text_id: smallest doc_id with the same text. n_links: number of different texts with a similarity of at least
    threshold. class_id: smallest doc_id connected by such links and equal texts.
    """
    rows, found = _classes(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), threshold, tolerance)
    return rows.join(found, "sha").select("doc_id", "text_id", "class_id", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay when each class of texts keeps one row: of the smallest doc_id (nulls last), then text
    hash. Classes are by text alone, so texts that share a doc_id, or have none, aren't linked by it."""
    text = F.coalesce("text", F.lit(""))
    _, found = _classes(docs.select(F.xxhash64(text).alias("doc_id"), text.alias("text")), THRESHOLD, TOLERANCE, by_text=True)
    sha = text_name(text)
    firsts = docs.select("doc_id", sha.alias("sha")).groupBy("sha").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first"))
    # a text without links is a class of its own, even if another's 64-bit hash is the same
    alone = F.when(F.col("n_links") == 0, F.col("sha"))
    stay = firsts.join(found, "sha").groupBy("class_id", alone.alias("alone")).agg(F.min(F.struct("first", "sha")).alias("one"))
    key = {"__sha": F.col("one.sha"), "__none": F.col("one.first.none"), "__id": F.coalesce("one.first.doc_id", F.lit(0)).cast("long")}
    stay = stay.select(*(c.alias(k) for k, c in key.items()))
    keyed = docs.withColumns({"__sha": sha, "__none": F.col("doc_id").isNull(), "__id": F.coalesce("doc_id", F.lit(0)).cast("long")})
    nth = F.row_number().over(W.partitionBy(*key).orderBy(F.lit(0)))
    return keyed.join(stay, list(key), "left_semi").withColumn("__nth", nth).filter("__nth = 1").select(*docs.columns)
