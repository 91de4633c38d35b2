"""Exponents against plain bisection, block permutations, target shares in every window, copies apart."""

import math
import random

import pandas as pd

from ordograph.llm import mixing, packing


def frame(spark, sources, words=50):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(words)), s, "u", 3) for i, s in enumerate(sources)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, own string, use int")


def test_exponent_against_bisection(spark):
    rng = random.Random(4)
    for entropy, repeats in ((0.9, 100.0), (1.0, 3.0), (0.8, 2.0), (0.99, 1.5)):
        t = [rng.randint(1, 10_000) ** 2 for _ in range(12)]
        share = [x / sum(t) for x in t]

        def state(x):
            w = [s**x for s in share]
            p = [v / sum(w) for v in w]
            return -sum(v * math.log(v) for v in p), max(v / s for v, s in zip(p, share))

        lo, hi = 0.0, 1.0
        meets = lambda x: state(x)[0] <= entropy * math.log(12) + 1e-12 and state(x)[1] <= repeats + 1e-9
        if not meets(0.0):
            for _ in range(60):
                mid = (lo + hi) / 2
                lo, hi = (lo, mid) if meets(mid) else (mid, hi)
        else:
            hi = 0.0
        df = spark.createDataFrame([(str(i), float(s)) for i, s in enumerate(share)], "source string, share double")
        assert abs(mixing.exponent(df, entropy, repeats, False)["x"] - hi) < 2e-6


def test_block_permutations(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 500)
    docs = frame(spark, ["big"] * 100 + ["small"] * 30)
    rows = [r.asDict() for r in mixing.mixed_order(docs, entropy_share=1.0, most_repeats=4.0).collect()]
    order = pd.DataFrame(rows).sort_values(["source", "place"])
    assert order.duplicated(["doc_id", "epoch"]).sum() == 0 and {"big", "small"} == set(order.source)
    turns = {}
    for (source, epoch), part in order.groupby(["source", "epoch"]):
        assert (part.place.diff().dropna() == 50).all()  # no gap, no overlap
        blocks = [b for b, last in zip(part.block, [None, *part.block]) if b != last]
        assert len(blocks) == len(set(blocks)), "a block is run through once an epoch"
        turns.setdefault(source, []).append(tuple(blocks))
    assert len(turns["small"]) > 1 and len(set(turns["small"])) > 1, "another permutation each epoch"
    small = order[order.source == "small"]
    assert abs(small.n_tokens.sum() - small.weight.iloc[0] * 6500) < 51
    mix = order.sort_values("position")
    for upto in (0.25, 0.5, 0.75):
        part = mix[mix.position < upto]
        got = part[part.source == "small"].n_tokens.sum() / part.n_tokens.sum()
        assert abs(got - small.weight.iloc[0]) < 0.03
    again = mixing.mixed(docs, entropy_share=1.0, most_repeats=4.0)
    assert again.count() == len(order) and again.columns == docs.columns


def shares(rows):
    part = pd.DataFrame([r.asDict() for r in rows])
    return part.groupby(["sequence_id", "source"]).length.sum().unstack(fill_value=0).sort_index()


def test_windows_of_the_query_hold_target_shares(spark):
    """Until a source is used up, each window's running total is within two windows of the target, across packs."""
    docs = frame(spark, ["a"] * 1200 + ["b"] * 400 + ["c"] * 100, words=60)
    for exponent in (1.0, 0.7):
        table = shares(packing.packed(docs, exponent=exponent, pack_tokens=12_000).collect())
        total = table.sum()
        target = (total / total.sum()) ** exponent
        target /= target.sum()
        assert len(table) > 80 and len({s >> 32 for s in table.index}) > 5
        upto, whole = table.cumsum(), table.sum(axis=1).cumsum()
        early = whole < 0.95 * (total / target).min()
        off = (upto - pd.DataFrame({c: target[c] * whole for c in table.columns})).abs()
        assert early.sum() > 20 and off[early].to_numpy().max() < 512, (exponent, off[early].max())
        full = table[(table.sum(axis=1) == 1024) & early]
        assert (full.div(1024) - target).abs().mean().max() < 0.12, exponent


def test_copies_are_apart_and_a_hot_document_spreads(spark):
    docs = frame(spark, ["a"] * 40, words=300)
    rows = packing.packed(docs.union(docs).union(docs)).collect()
    seen = {}
    for r in rows:
        seen.setdefault((r["doc_id"], r["start"]), []).append(r["sequence_id"])
    twice = sum(len(v) != len(set(v)) for k, v in seen.items())
    assert twice == 0
    hot = frame(spark, ["a"] * 10).limit(1)
    many = hot.crossJoin(spark.range(3000).select()).union(docs)
    rows = packing.packed(many, pack_tokens=20_000).select("sequence_id").distinct().collect()
    assert len({r[0] >> 32 for r in rows}) > 5
    q = pd.DataFrame({"doc_id": [1, 1, 1, 2, 3, 4], "place": [10, 20, 30, 40, 50, 60], "row": range(6)})
    assert packing.spread(q).doc_id.tolist() == [1, 2, 3, 4, 1, 1]
