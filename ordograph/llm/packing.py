"""Mixture-controlled packing: deficit round-robin over source queues.

Texts are tokenised, each followed by id 0. Each source has a target share: of all tokens, raised to an exponent or
given. The sequences run through the mix from its start: a document with t tokens before it in its source, whose order
is drawn, has time t / p for a share of p, so that at any time the sources that aren't used up yet are in target
proportion. Time is cut into packs of about PACK_TOKENS tokens, one task each.

In a pack each source has a queue. For every window the sources still waiting are credited their target shares; sources
are served in turn once their credit reaches QUANTUM, and what is left of the window goes to the largest credit. Credit
is carried from window to window, and from pack to pack: what the source was due until the pack's start, less the
tokens in earlier packs. The last part of a pack is cut into powers of two, so that no sequence is padded.

Copies of a document in one pack are as far apart in its queue as its other documents allow: all first copies come
before all second ones. Sources beyond the MOST_QUEUES largest share one queue, in proportion to their tokens.

A null text is empty (one token, id 0); a null source is a source of its own; repeated rows are packed as often as
they occur, in different packs by chance. An empty table gives no rows. Extra columns play no part.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ordograph.llm.common import running_totals, written

LENGTH, QUANTUM, PACK_TOKENS = 1024, 128, 2_000_000
#: Queues, whose table is broadcast; points at which the time of the mix is measured.
MOST_QUEUES, POINTS = 50_000, 64


class Encoder:
    """Ids of a byte-level BPE file of the `tokenizers` library, as little-endian 16-bit numbers.

    The same merges run through `tiktoken`, which takes a fifth of the time; a text with a special token's string goes
    to `tokenizers` itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        special = {x["content"] for x in told.get("added_tokens", [])}
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(shown[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("read", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = re.compile("|".join(map(re.escape, special)) or r"\Zx")

    def __call__(self, text: str) -> bytes:
        if self.special.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()
        return np.array(self.fast.encode_ordinary(text), dtype="<u2").tobytes()


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    if path not in _encoders:
        import public_tokenizers

        _encoders[path] = Encoder(path or public_tokenizers.path("byte_bpe_50k.json"))
    return _encoders[path]


def tokenised(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, n, row, ids): n 16-bit ids with the closing 0; row: a number of its own."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, row = encoder(path), TaskContext.get().partitionId() << 40
        for b in batches:
            ids = [run(t or "") + b"\0\0" for t in b.column("text").to_pylist()]
            columns = [b.column("doc_id"), b.column("source"), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(range(row, row + len(ids)), pa.int64()), pa.array(ids, pa.binary())]
            row += len(ids)
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "n", "row", "ids"])

    plain = docs.select(F.col("doc_id").cast("long"), F.coalesce("source", F.lit("(none)")).alias("source"), "text")
    return plain.mapInArrow(encode, "doc_id long, source string, n long, row long, ids binary")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def window_sizes(total: int, length: int) -> list[int]:
    rest = total % length
    return [length] * (total // length) + [1 << k for k in reversed(range(length.bit_length())) if rest >> k & 1]


def served(waiting: list[int], share: np.ndarray, credit: np.ndarray, length: int, quantum: int) -> list[tuple[int, int, int, int]]:
    """(queue, tokens, window, offset) of each service, until all queues are empty."""
    left, credit, out, turn, k = np.array(waiting), credit.astype(float).copy(), [], 0, len(waiting)
    for w, size in enumerate(window_sizes(sum(waiting), length)):
        alive = np.where(left > 0, share, 0.0)
        credit += size * (alive / alive.sum() if alive.sum() > 0 else (left > 0) / max(1, (left > 0).sum()))
        room = size
        for i in range(k):
            s = (turn + i) % k
            if room and left[s] and credit[s] >= quantum:
                n = int(min(credit[s], left[s], room))
                out.append((s, n, w, size - room))
                left[s] -= n
                credit[s] -= n
                room -= n
        turn = (turn + 1) % k
        while room:
            s = int(np.where(left > 0, credit, -np.inf).argmax())
            n = int(min(room, left[s]))
            out.append((s, n, w, size - room))
            left[s] -= n
            credit[s] -= n
            room -= n
    return out


def spread(queue: pd.DataFrame) -> pd.DataFrame:
    """The rows of a queue by place, copies of a document as far apart as may be: round by round, and in each round
    those with the most copies first."""
    ordered = queue.sort_values(["place", "row"], kind="stable")
    same = ordered.groupby("doc_id", dropna=False, sort=False)
    ordered = ordered.assign(nth=same.cumcount(), copies=-same["row"].transform("size"))
    return ordered.sort_values(["nth", "copies", "place", "row"], kind="stable")


def _packer(length: int, quantum: int):
    def pack(docs: pd.DataFrame, carried: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame({c.split()[0]: [] for c in PIECES.split(", ")})
        queues = [spread(q) for _, q in docs.groupby("queue", sort=True)]
        names = [q.queue.iloc[0] for q in queues]
        told = carried.set_index("queue")
        turns = served([int(q.n.sum()) for q in queues], told.share.reindex(names).fillna(0).to_numpy(), told.credit.reindex(names).fillna(0).to_numpy(), length, quantum)
        pack_id, parts = int(docs.pack.iloc[0]), []
        turns = np.array(turns)
        for s, q in enumerate(queues):
            n, took = q.n.to_numpy(), turns[turns[:, 0] == s, 1:]
            ids = np.frombuffer(b"".join(q.ids), dtype="<u2").astype("<u4")
            ends, cuts = np.cumsum(n), np.cumsum(took[:, 0])
            stops = np.union1d(ends, cuts)
            starts = np.concatenate([[0], stops[:-1]])
            d, t = np.searchsorted(ends, starts, side="right"), np.searchsorted(cuts, starts, side="right")
            parts.append(pd.DataFrame({
                "doc_id": q.doc_id.to_numpy()[d], "start": starts - (ends - n)[d], "length": stops - starts,
                "ids_crc32": [zlib.crc32(ids[a:b]) for a, b in zip(starts, stops, strict=True)], "doc_tokens": n[d],
                "sequence_id": (pack_id << 32) + took[t, 1], "offset": took[t, 2] + starts - (cuts - took[:, 0])[t], "source": q.source.to_numpy()[d],
            }))
        return pd.concat(parts)

    return pack


def _between(x, xs: list[float], ys: list[float]) -> F.Column:
    """y of the line through the points (xs ascending, ys), evenly between two of them."""
    a, b = F.array(*map(F.lit, xs)), F.array(*map(F.lit, ys))
    k = F.least(F.greatest(F.size(F.filter(a, lambda p: p <= x)), F.lit(1)), F.lit(len(xs) - 1))
    x0, x1, y0, y1 = F.get(a, k - 1), F.get(a, k), F.get(b, k - 1), F.get(b, k)
    return y0 + F.when(x1 > x0, (x - x0) / (x1 - x0)).otherwise(F.lit(0.0)) * (y1 - y0)


def targets(ids: DataFrame, shares: dict[str, float] | None, exponent: float) -> DataFrame:
    """(source, queue, total, share): the queues' tokens and target shares, by source."""
    totals = written(ids.groupBy("source").agg(F.sum("n").alias("total")), "source-tokens")
    most = totals.orderBy(F.desc("total"), "source").limit(MOST_QUEUES)
    rest = totals.agg(F.sum("total")).first()[0] or 0
    most = most.withColumn("queue", F.col("source"))
    others = rest - (most.agg(F.sum("total")).first()[0] or 0)
    if others:
        most = most.union(ids.sparkSession.createDataFrame([(None, others, "(others)")], "source string, total long, queue string"))
    if shares:
        given = ids.sparkSession.createDataFrame([(k, float(v)) for k, v in shares.items()], "queue string, weight double")
        most = most.join(given, "queue", "left").withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(1e-9)))
    else:
        most = most.withColumn("weight", F.pow(F.col("total") / F.lit(float(max(1, rest))), F.lit(exponent)))
    whole = most.agg(F.sum("weight")).first()[0] or 1.0
    return written(most.select("source", "queue", "total", (F.col("weight") / whole).alias("share")), "queues")


def packed(docs: DataFrame, shares: dict[str, float] | None = None, exponent: float = 1.0, length: int = LENGTH, quantum: int = QUANTUM, path: str | None = None, pack_tokens: int = PACK_TOKENS) -> DataFrame:
    """PIECES: a row for each piece of a document (doc_id, text, source) in a sequence of at most `length` ids.

    shares: target weights of sources, others last; by default the sources' shares of all tokens to the power of
    `exponent`. Once a source is used up, the others fill in proportion.
    """
    ids = written(tokenised(docs, path), "ids", compression="zstd")
    queues = targets(ids, shares, exponent)
    ends = F.col("total") / F.col("share")
    last = queues.agg(F.max(ends), F.percentile_approx(ends, [i / POINTS for i in range(POINTS + 1)])).first()
    times = sorted({0.0, *(last[1] or []), last[0] or 1.0})
    # tokens used at each of the times
    used = list(queues.agg(*[F.sum(F.least(F.col("total").cast("double"), F.col("share") * t)) for t in times]).first()) if last[0] else [0.0] * len(times)
    packs = max(1, -(-int(used[-1]) // pack_tokens))
    named = F.broadcast(queues.filter("source is not null").select("source", "queue"))  # MOST_QUEUES
    narrow = ids.select("row", "source", "n").join(named, "source", "left").withColumn("queue", F.coalesce("queue", F.lit("(others)")))
    places = running_totals(narrow.select("row", "queue", "n").withColumn("h", F.xxhash64(F.lit(5), "row")), ["queue", "h", "row"], "n", "before")
    places = written(places, "places")
    first = F.broadcast(places.groupBy("queue").agg(F.min("before").alias("base")))  # MOST_QUEUES
    told = F.broadcast(queues.select("queue", "total", "share"))  # MOST_QUEUES
    places = places.join(first, "queue").join(told, "queue").withColumn("place", F.col("before") - F.col("base"))
    at = _between(F.col("place") / F.col("share"), times, used)
    places = places.withColumn("pack", F.least(F.lit(packs - 1), F.floor(at / pack_tokens)).cast("int"))
    # what a queue has before its first row in a pack is what earlier packs hold of it
    carried = written(places.groupBy("pack", "queue", "total", "share").agg(F.min("place").alias("gone")), "pack-queues")
    due = F.least(F.col("total").cast("double"), F.col("share") * _between(F.col("pack") * float(pack_tokens), used, times))
    carried = carried.select(F.col("pack").alias("pack"), F.col("queue").alias("queue"), F.col("share").alias("share"), (due - F.col("gone")).alias("credit"))
    # three numbers a row, broadcast while Spark's limit allows; beyond, the ids are shuffled once more
    slim = written(places.select("row", "place", "pack"), "packs")
    rows = ids.select("doc_id", "source", "n", "row", "ids").join(slim, "row").join(named, "source", "left").withColumn("queue", F.coalesce("queue", F.lit("(others)")))
    return rows.groupBy("pack").cogroup(carried.groupBy("pack")).applyInPandas(_packer(length, quantum), PIECES)
