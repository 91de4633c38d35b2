"""Large buckets, blocks by bytes, chains of near copies, repeated memberships."""

import random

from ordograph.llm import ngram_join


def shingles(t):
    w = t.split()
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(texts):
    sets, of = [shingles(t) for t in texts], {}
    for d, x in enumerate(sets):
        for s in x:
            of.setdefault(s, []).append(d)
    links, root = [0] * len(texts), list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, x in enumerate(sets):
        both = {}
        for s in x:
            for o in of[s]:
                if o < d:
                    both[o] = both.get(o, 0) + 1
        for o, n in both.items():
            if n >= 0.8 * (len(x) + len(sets[o]) - n):
                links[d] += 1
                links[o] += 1
                a, b = top(d), top(o)
                root[max(a, b)] = min(a, b)
    return {d: (links[d], top(d)) for d in range(len(texts))}


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts, w = [], [word() for _ in range(60)]
    for _ in range(1500):  # a chain, in which each text is near some dozen others
        w = w[1:] + [word()]
        texts.append(" ".join(w))
    base = [word() for _ in range(100)]
    for i in range(150):  # one group, all alike
        v = base[:]
        v[rng.randrange(100)] = word()
        texts.append(" ".join(v))
    notice = [word() for _ in range(40)]
    for i in range(200):  # half of each text is the same notice: alike, not enough
        texts.append(" ".join(notice + [word() for _ in range(40)]))
    return list(dict.fromkeys(texts))


def test_chain_group_and_notice(spark, monkeypatch):
    texts = corpus()
    want = brute(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for block, size in ((512, 32_000_000), (64, 20_000)):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        monkeypatch.setattr(ngram_join, "BLOCK_BYTES", size)
        got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in ngram_join.near_duplicates(docs).collect()}
        assert got == want, block
    assert sum(c == 0 for _, c in want.values()) > 1400


def test_clusters_are_of_likely_pairs(spark):
    """Texts that share a notice meet in buckets, but make no cluster."""
    from pyspark.sql import functions as F

    texts = [t for t in corpus() if len(t.split()) == 80]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    keyed = docs.select("doc_id", F.lit(b"").alias("sha"), F.lit(1).cast("long").alias("size"), ngram_join.word_hashes(F.col("text")).alias("words"))
    keyed = keyed.mapInArrow(ngram_join._band_keys, "doc_id long, sha binary, size long, bands array<long>, low binary").cache()
    shared = keyed.select(F.explode("bands").alias("k")).groupBy("k").count().filter("count > 1").count()
    assert shared > 0 and ngram_join.likely_clusters(keyed, ngram_join.fewest_matches(), lambda ids: keyed.select("doc_id", "low").join(ids, "doc_id")).count() == 0
