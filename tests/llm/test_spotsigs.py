"""The SpotSigs join against brute force, with blocks split, chains of likeness, copies and null ids."""

import hashlib
import random

from ordograph.llm import spotsigs


def prose(rng, n):
    return [rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n)]


def signatures(text):
    w = [x for x in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split(" ") if x]
    out = set()
    for i, x in enumerate(w):
        rest = [y for y in w[i + 1 : i + 1 + spotsigs.LOOK] if y not in spotsigs.STOPS][: spotsigs.CHAIN]
        if x in spotsigs.STOPS and len(rest) == spotsigs.CHAIN:
            out.add(hashlib.md5(" ".join([x, *rest]).encode()).hexdigest()[:8])
    return frozenset(out or {hashlib.md5(text.encode()).hexdigest()[:8]})


def corpus():
    rng = random.Random(6)
    texts = [" ".join(prose(rng, rng.randint(1, 120))) for _ in range(60)]
    base = prose(rng, 150)
    for _ in range(120):  # a large group of near copies
        w = base[:]
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = "".join(rng.choice("abcdefgh") for _ in range(5))
        texts.append(" ".join(w))
    w = prose(rng, 200)
    for _ in range(40):  # a chain: each like the one before, its ends unlike
        w = w[6:] + prose(rng, 6)
        texts.append(" ".join(w))
    return texts + ["", "", None, "one", "the", texts[3], texts[3], texts[70]]


def test_classes_against_brute_force(spark):
    texts = corpus()
    ids = [None if i % 17 == 5 else i for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in zip(ids, texts)], "doc_id long, text string, s string, kind string")
    sets = [signatures(t or "") for t in texts]
    kinds = list(dict.fromkeys(sets))
    near = {a: [b for b in kinds if b != a and len(a & b) >= 0.8 * len(a | b) - 1e-9] for a in kinds}
    root = {}
    for k in kinds:
        if k not in root:
            stack, root[k] = [k], k
            while stack:
                for b in near[stack.pop()]:
                    if b not in root:
                        root[b] = k
                        stack.append(b)
    least = {}
    for i, s in zip(ids, sets):
        if i is not None:
            least[root[s]] = min(i, least.get(root[s], i))
    want = sorted((-1 if i is None else i, "".join(sorted(s)), least.get(root[s]), len(near[s])) for i, s in zip(ids, sets))
    for block in (7, spotsigs.BLOCK):
        got = spotsigs.fingerprints(docs, spotsigs.near_classes(docs, block=block)).collect()
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["fingerprint"], r["class_id"], r["n_links"]) for r in got) == want, block
    assert max(len(v) for v in near.values()) >= 100


def test_ranges_of_next(spark):
    """The next document over many ranges, with ties, gaps and nulls."""
    ids = [None, *range(0, 3000, 3), *range(10**9, 10**9 + 500), 7, 7, 7]
    docs = spark.createDataFrame([(i, f"text {i} {k}") for k, i in enumerate(ids)], "doc_id long, text string")
    made = lambda df: df.withColumn("m", df.text)
    got = {r["m"]: r["next"]["m"] for r in spotsigs.with_next(docs, ["m"], made, rows_each=3).collect()}
    order = [t for _, t in sorted(((-1 if i is None else i), f"text {i} {k}") for k, i in enumerate(ids))]
    assert got == dict(zip(order, order[1:] + order[:1]))
