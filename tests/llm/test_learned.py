"""Partitions that grow with the table, their balance, visits; classifier margins; added private spans."""

import random
import re

import numpy as np

from ordograph.llm import learned_partitions as lp, pii, quality


def test_levels_balance_and_visits(spark, monkeypatch):
    monkeypatch.setattr(lp, "LEAF_ROWS", 400)
    monkeypatch.setattr(lp, "FAN", 8)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 16)) * 4
    x = centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 16))
    sizes, asked = {}, {}
    kept = lp.visited

    def seen(nets, q, held, visits, k):
        return kept(nets, q, held, visits, k)

    monkeypatch.setattr(lp, "visited", seen)
    made = lp.needed_visits

    def measure(nets, sample):
        n = made(nets, sample)
        codes, _ = lp.scores(nets, x[:1])
        sizes.update(zip(*np.unique(lp.placed_codes(nets, x), return_counts=True)))
        asked.update(parts=len(codes), visits=n, nets=len(nets))
        return n

    monkeypatch.setattr(lp, "needed_visits", measure)
    got = lp.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    hits = 0
    for q in range(0, 6000, 100):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & {r["vec_id"] for r in got if r["query_id"] == q})
    share = asked["visits"] / asked["parts"]
    assert asked["nets"] > 1 and asked["parts"] >= 20 and hits / 600 >= 0.9 and share <= 0.25, (asked, hits / 600)
    assert max(sizes.values()) < 4 * 6000 / asked["parts"], sorted(sizes.values())


def test_descent_against_a_dense_solver():
    """Dual coordinate descent reaches the same margins as plain subgradient steps on the same hinge loss."""
    rng = np.random.default_rng(1)
    found = [np.unique(rng.integers(0, 40, 12)) + (0 if i % 2 else 8) for i in range(60)]
    y = np.where(np.arange(60) % 2, 1.0, -1.0)
    model = quality._descend(found, y, 1.0, 400, 0)
    r = quality._ratios(found, y)
    x = np.zeros((60, 61))
    for i, ids in enumerate(found):
        x[i, ids] = r[ids] / np.sqrt((r[ids] ** 2).sum())
    x[:, 60] = 1.0
    w, best, best_w = np.zeros(61), np.inf, None
    for t in range(1, 60_001):
        m = y * (x @ w)
        loss = 0.5 * w @ w + np.maximum(0, 1 - m).sum()
        if loss < best:
            best, best_w = loss, w.copy()
        w = w - (w - (x * y[:, None])[m < 1].sum(axis=0)) / (t + 10)
    mine = np.append(model[:60], model[quality.DIMS])
    loss = 0.5 * mine @ mine + np.maximum(0, 1 - y * (x @ mine)).sum()
    assert loss <= best * 1.002 and np.abs(x @ mine - x @ best_w).max() < 0.06


def test_features_pack():
    for n in (0, 1, 5000, 100_000):
        ids = np.sort(np.random.default_rng(n).choice(quality.DIMS, n, replace=False))
        assert (quality.unpacked(quality.packed(ids)) == ids).all() and len(quality.packed(ids)) <= quality.DIMS // 8


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").filter(quality.held_out(docs.doc_id)).select("score", "quality", "predicted").toPandas()
    good, bad = scored[scored.quality == 1].score.to_numpy(), scored[scored.quality == 0].score.to_numpy()
    auc = (good[:, None] > bad[None, :]).mean()
    assert len(good) > 20 and len(bad) > 5 and auc > 0.97 and (scored.predicted == scored.quality).mean() > 0.93, auc


def test_precision_and_recall_of_added_spans(spark):
    """Planted secrets among prose, numbers, links, dates and versions; in a small and in a larger table."""
    rng = random.Random(7)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    planted = [
        lambda: f'token = "{hexa(40)}"', lambda: f"password: {hexa(6)}{rng.randint(10, 99)}qq{hexa(6)}", lambda: f"api_key={hexa(24)}",
        lambda: "key AKIA" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(16)), lambda: "ssn 123-45-" + str(rng.randint(1000, 9999)), lambda: f"iban DE89370400440532{rng.randint(100000, 999999)}",
    ]
    innocent = [
        lambda: f"https://site.org/page/{rng.randint(1, 10**6)}/view", lambda: f"version-{rng.randint(1, 9)}.{rng.randint(10, 99)}-release", lambda: f"2024-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T10:00",
        lambda: f"the chapter{rng.randint(1, 99)}introduction here", lambda: f"in {rng.randint(1800, 2024)} about {rng.randint(1, 9)}00 people",
    ]
    for size in (40, 1500):
        texts, want = [], []
        for i in range(size):
            text, spans = "Some plain words of prose ", set()
            for _ in range(3):
                if rng.random() < 0.4:
                    p = rng.choice(planted)()
                    secret = re.search(r'[^\s"]+"?$', p).group().strip('"')
                    at = len(text) + p.rindex(secret)
                    spans.add((at, at + len(secret)))
                    text += p + " and more words "
                else:
                    text += rng.choice(innocent)() + " and more words "
            texts.append(text)
            want.append(spans)
        got = pii.private_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
        found = {r["doc_id"]: {(x["s"], x["e"]) for x in r["spans"] if x["kind"] not in pii.KINDS[:4]} for r in got}
        right = sum(len(found[i] & w) for i, w in enumerate(want))
        assert right / sum(map(len, want)) > 0.95 and right / max(1, sum(map(len, found.values()))) > 0.95, (size, right, sum(map(len, want)), sum(map(len, found.values())))
