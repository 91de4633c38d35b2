"""Substring dedup by recompression.

A text's words become symbols, which rounds compress by global names: runs of one word first, then, round by round,
pairs whose left symbol is in the round's left half of all symbols and whose right one isn't. A name is a hash of what
it stands for and the halves are bits of names, so equal word sequences get equal symbols inside, in any document and
on any executor. For each boundary between symbols, the words on which its survival depends are recorded; a window
that holds them all has that boundary wherever the window occurs. So each window names one anchor: of the boundaries
of the last round that hang on at most REACH words of it, the one with the smallest name, a hash of those words (a
window without any, inside a long run, is its own anchor).

Neighbouring windows with one anchor form a region. Regions are joined by (anchor, region content): all but the
smallest document's are repeats as a whole. Anchors with several different regions have those, once each, compared
window by window. Contents are compared by 128 bits of independent hashes.

A null text has no words. Rows that share a doc_id count as one document, whose texts don't repeat each other; a null
doc_id is in no comparison. Extra columns stay out. Texts shorter than a window lose nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ordograph.llm.common import written
from ordograph.llm.ngram_join import mixed, word_hashes

WINDOW, ROUNDS, REACH = 50, 4, 17
#: Words that a task works on at once; a longer text is worked on alone.
SLICE = 1 << 18
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_FAR = 1 << 40
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD1342543DE82EF95)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[:1] = 1
    done = 1
    while done < n:  # doubling, since wrapping products are exact
        step = np.uint64(pow(int(base), done, 1 << 64))
        out[done : 2 * done] = out[: min(done, n - done)] * step
        done *= 2
    return out


class Content:
    """Hashes of any stretches of a word sequence, independent of where they stand and of what else is there."""

    def __init__(self, words: np.ndarray):
        self.sums, self.back = [], []
        for base, x in ((_B1, words), (_B2, mixed(words + np.uint64(7)))):
            total = np.zeros(len(words) + 1, dtype=np.uint64)
            np.cumsum(x * _powers(base, len(words) + 1)[:-1], out=total[1:])
            self.sums.append(total)
            self.back.append(_powers(np.uint64(pow(int(base), -1, 1 << 64)), len(words) + 1))

    def of(self, k: int, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mixed((self.sums[k][e] - self.sums[k][s]) * self.back[k][s])


def boundaries(words: np.ndarray, ends: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level from the lowest: positions of boundaries inside documents, and the words [lo, hi) they depend on.

    words: those of several documents one after the other; ends: where each ends.
    """
    at = np.arange(len(words))
    sym, lo, hi = words, at.copy(), at.copy()
    edge = np.zeros(len(words) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    edge[ends] = True
    levels = []

    def outer(a: np.ndarray, fill: int) -> np.ndarray:
        return np.append(a, fill)

    lo[edge[at]], hi[edge[at]] = -_FAR, _FAR  # a document's own ends are no content
    for r in range(rounds + 1):
        inner = ~edge[at]
        nxt_lo, nxt_hi = outer(lo[1:], -_FAR), outer(hi[1:], _FAR)
        before_lo, before_hi = np.append(-_FAR, lo[:-1]), np.append(_FAR, hi[:-1])
        prev = np.append(np.uint64(0), sym[:-1])
        if r == 0:  # runs of one word
            gone = inner & (prev == sym)
            new_lo, new_hi = np.minimum(before_lo, np.minimum(lo, nxt_lo)), np.maximum(before_hi, np.maximum(hi, nxt_hi))
            # at this level a symbol is one word, next to the boundary on either side
            new_lo, new_hi = np.where(inner, at - 1, new_lo), np.where(inner, at + 1, new_hi)
            stay = ~gone
            first = np.flatnonzero(stay)
            size = np.diff(np.append(first, len(sym)))
            name = np.where(size > 1, mixed(sym[first] + mixed(size.astype(np.uint64))), sym[first])
        else:
            half = mixed(sym ^ mixed(np.full(1, r, dtype=np.uint64))) & np.uint64(1)
            left_open = np.append(np.uint64(1), half[:-1]) == 0
            gone = inner & left_open & (half == 1)
            one_lo, one_hi = np.minimum(before_lo, lo), np.maximum(before_hi, hi)
            both_lo, both_hi = np.minimum(one_lo, nxt_lo), np.maximum(one_hi, nxt_hi)
            new_lo, new_hi = np.where(left_open, both_lo, one_lo), np.where(left_open, both_hi, one_hi)
            stay = ~gone
            first = np.flatnonzero(stay)
            double = np.append(first[1:], len(sym)) - first == 2
            follow = np.minimum(first + 1, len(sym) - 1)
            name = np.where(double, mixed(sym[first] * np.uint64(0x9E3779B97F4A7C15) + mixed(sym[follow] + np.uint64(r))), sym[first])
        keep_edge = edge[at]
        new_lo[keep_edge], new_hi[keep_edge] = -_FAR, _FAR
        at, sym, lo, hi = at[first], name, new_lo[first], new_hi[first]
        known = hi < _FAR
        levels.append((at[known], lo[known], hi[known]))
    return levels


def regions(words: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(key, region, s, n): runs of windows s to s + n - 1 that name the same anchor; key and region are hashes."""
    content = Content(words)
    starts = np.append(0, ends[:-1]) if len(ends) else ends
    doc = np.repeat(np.arange(len(ends)), ends - starts)
    valid = np.flatnonzero(np.arange(len(words)) + window <= ends[doc])
    if not len(valid):
        z = np.zeros(0, dtype=np.int64)
        return z.view(np.uint64), z.view(np.uint64), z, z
    _, lo, hi = boundaries(words, ends)[-1]
    short = hi - lo <= REACH
    lo, hi = lo[short], hi[short]
    name = content.of(0, lo, hi)
    # the smallest name, then the first place, of the boundaries with lo in a window's first words; hi is inside too
    order = np.lexsort((hi, name, lo))
    lo, hi, name = lo[order], hi[order], name[order]
    lead = np.flatnonzero(np.diff(lo, prepend=-1))
    lo, hi, name = lo[lead], hi[lead], name[lead]
    ranked = np.lexsort((lo, name))
    none = len(ranked)
    least = np.full(len(words) + window, none)
    least[lo[ranked]] = np.arange(none)
    width, have = window - REACH + 1, 1
    while have < width:
        step = min(have, width - have)
        least[:-step] = np.minimum(least[:-step], least[step:])
        have += step
    chosen = least[valid]
    lone = chosen == none
    alone = valid[lone]  # neighbours with equal words, inside a run, stay together
    fresh = np.append(True, (np.diff(content.of(0, alone, alone + window)) != 0) | (np.diff(alone) != 1))[: len(alone)]
    at = np.append(lo[ranked], 0)[chosen]
    at[lone] = -np.cumsum(fresh)
    first = np.flatnonzero(np.append(True, (np.diff(at) != 0) | (np.diff(valid) != 1)))
    n, s, at = np.diff(np.append(first, len(valid))), valid[first], at[first]
    low = np.where(at < 0, s, at)
    high = s + window
    high[at >= 0] = hi[np.searchsorted(lo, at[at >= 0])]
    key = content.of(0, low, high) + mixed((at < 0).astype(np.uint64))
    region = content.of(1, s, s + n + window - 1) + mixed(n.astype(np.uint64) + mixed((low - s).astype(np.uint64)))
    return key, region, s, n


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = batch.column("words")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64)
    return words, offsets[:-1] - offsets[0], offsets[1:] - offsets[0]


def slices(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches (from, to) of texts that have at most `most` words together, or are one text; ends: where each ends."""
    at, done = 0, 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield at, to
        at, done = to, int(ends[to - 1])


def _regions_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Regions; of equal ones in a slice only the smallest document's are left to compare with others (not done)."""
    for whole in batches:
        for at, to in slices(_flat(whole)[2], SLICE):
            b = whole.slice(at, to - at)
            words, begin, ends = _flat(b)
            key, region, s, n = regions(words, ends)
            doc = np.searchsorted(ends, s, side="right")
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)[doc]
            order = np.lexsort((ids, region, key))
            head = np.append(True, (np.diff(key[order]) != 0) | (np.diff(region[order]) != 0))[: len(order)]
            done = np.zeros(len(order), dtype=bool)
            done[order] = ids[order] > ids[order][np.flatnonzero(head)][np.cumsum(head) - 1] if len(order) else False
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (key.view(np.int64), region.view(np.int64), ids, (s - begin[doc]).astype(np.int32), n.astype(np.int32), done)],
                ["key", "region", "doc_id", "s", "n", "done"],
            )


def _windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the windows in the spans {s, n} of each text."""
    for b in batches:
        words, begin, ends = _flat(b)
        content, spans = Content(words), b.column("spans")
        s, n = (spans.values.field(k).to_numpy().astype(np.int64) for k in ("s", "n"))
        rows = np.diff(spans.offsets.to_numpy())
        first = spans.offsets.to_numpy()[0]
        s, n = s[first : first + rows.sum()], n[first : first + rows.sum()]
        doc = np.repeat(np.arange(b.num_rows), rows)
        which = np.repeat(np.arange(len(s)), n)
        w = s[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        fits = begin[doc[which]] + w + WINDOW <= ends[doc[which]]
        which, w = which[fits], w[fits]
        a = begin[doc[which]] + w
        ids = b.column("doc_id").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (content.of(0, a, a + WINDOW).view(np.int64), content.of(1, a, a + WINDOW).view(np.int64), ids[doc[which]], w.astype(np.int32))], ["h1", "h2", "doc_id", "s"])


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, s, n): windows s to s + n - 1 of a document that also start in a document with a smaller doc_id."""
    plain = docs.filter("doc_id is not null").select("doc_id", "text")
    hashed = plain.select(F.col("doc_id").cast("long"), word_hashes(F.col("text")).alias("words"))
    places = written(hashed.mapInArrow(_regions_of, "key long, region long, doc_id long, s int, n int, done boolean"), "regions")
    places, done = places.filter("not done").drop("done"), places.filter("done").select("doc_id", "s", "n")
    kinds = written(places.groupBy("key", "region").agg(F.min(F.struct("doc_id", "s", "n")).alias("first"), F.count("*").alias("uses")), "kinds")
    again = kinds.filter("uses > 1").select("key", "region", F.col("first.doc_id").alias("least"))
    whole = places.join(again, ["key", "region"]).filter("doc_id > least").select("doc_id", "s", "n")
    several = kinds.groupBy("key").agg(F.min("region").alias("a"), F.max("region").alias("z")).filter("a <> z").select("key")
    partly = kinds.join(several, "key", "left_semi").groupBy("first.doc_id").agg(F.collect_set(F.struct("first.s", "first.n")).alias("spans"))
    some = plain.join(partly, "doc_id").select(F.col("doc_id").cast("long"), word_hashes(F.col("text")).alias("words"), "spans")
    windows = written(some.mapInArrow(_windows_of, "h1 long, h2 long, doc_id long, s int"), "windows")
    earliest = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).filter("least < last").select("h1", "h2", "least")
    single = windows.join(earliest, ["h1", "h2"]).filter("doc_id > least").select("doc_id", "s", F.lit(1).alias("n"))
    return done.unionByName(whole).unionByName(single)


def cut(text: str | None, spans, window: int = WINDOW) -> tuple[int, int, str]:
    """Words of a text, how many of them its repeated windows cover, and the words left, joined by spaces."""
    words = _WORD.findall(text or "")
    if spans is None or not len(spans):
        return len(words), 0, " ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for x in spans:
        if x["s"] + window <= len(words):
            change[x["s"]] += 1
            change[min(len(words), x["s"] + x["n"] + window - 1)] -= 1
    covered = np.cumsum(change[:-1]) > 0
    return len(words), int(covered.sum()), " ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c])


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of docs (doc_id, text)."""
    spans = repeats(docs).groupBy("doc_id").agg(F.collect_set(F.struct("s", "n")).alias("spans"))

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            got = [cut(t, x) for t, x in zip(pdf.text, pdf.spans, strict=True)]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "n_words": [g[0] for g in got], "n_removed": [g[1] for g in got], "kept": [g[2] for g in got]})

    joined = docs.select(F.col("doc_id").cast("long"), "text").join(spans, "doc_id", "left")
    return joined.mapInPandas(run, "doc_id long, n_words long, n_removed long, kept string")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


ORACLE = f"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws from documents),
p as (select doc_id, unnest(range(1, len(ws) - {WINDOW} + 2)) s, ws from w where len(ws) >= {WINDOW}),
h as (select doc_id, s, md5(array_to_string(ws[s:s + {WINDOW} - 1], ' ')) h from p),
m as (select h, min(doc_id) least from h group by h having min(doc_id) < max(doc_id)),
r as (select h.doc_id, s from h join m on h.h = m.h where doc_id > least),
c as (select distinct doc_id, unnest(range(s, s + {WINDOW})) i from r),
k as (select doc_id, list(i) gone from c group by doc_id)
select w.doc_id, cast(len(ws) as bigint) n_words, cast(coalesce(len(gone), 0) as bigint) n_removed,
       sha256(array_to_string(case when gone is null then ws else
              list_transform(list_filter(range(1, len(ws) + 1), lambda i: not list_contains(gone, i)), lambda i: ws[i]) end, ' ')) kept_sha256
from w left join k on w.doc_id = k.doc_id
"""
