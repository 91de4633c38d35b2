"""Notices wrapped, commented and embedded are found; near misses and prose aren't."""

import random
import textwrap

from ordograph.llm import licences
from ordograph.llm.licence_texts import TEMPLATES


def found(spark, texts, **how):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, licence string, s int")
    out = {}
    for r in licences.scan(docs, **how).collect():
        out.setdefault(r["doc_id"], {})[r["licence"]] = (r["dice"], r["n_places"])
    return out


def test_whole_texts_anywhere(spark):
    code = "\n".join(f"def f{i}(a, b):\n    return a * {i} + b" for i in range(200))
    names, texts = [], []
    for name, bodies in TEMPLATES.items():
        longest = " ".join(max(bodies, key=len).split())
        wrapped = textwrap.fill(longest, 70)
        half = wrapped.count("\n") // 2
        paragraphs = "\n\n".join(["\n".join(wrapped.split("\n")[: half + 1]), "\n".join(wrapped.split("\n")[half + 1 :])])
        comment = "/*\n" + "\n".join(" * " + x for x in wrapped.split("\n")) + "\n */"
        hashes = "\n".join("# " + x for x in wrapped.split("\n"))
        for t in (paragraphs + "\n\n" + code, comment + "\n" + code, code + "\n" + hashes, "Copyright (c) 2020 someone. " + longest.upper() + " Thanks to all"):
            names.append(name)
            texts.append(t)
    got = found(spark, texts)
    for i, name in enumerate(names):
        assert got[i][name][0] > 0.99, (i, name, got.get(i))
        assert len(got[i]) == 1, (i, name, got[i])


def test_near_misses_and_changes(spark):
    mit = max(TEMPLATES["MIT"], key=len).split()
    rng = random.Random(3)
    other = [f"word{i}" for i in range(400)]
    few = mit[:]
    for i in rng.sample(range(len(few)), 8):
        few[i] = "changed"
    inserted = [*mit[:80], "including", "the", "next", "paragraph", *mit[80:]]
    texts = [
        " ".join(few), " ".join(inserted), " ".join(mit[: len(mit) // 2]), " ".join(mit[:60] + other[:60] + mit[60:]), " ".join(sorted(mit)),
        "This work is licensed under the GNU General Public License, version 2.", "All rights are reserved to nobody.", "", None, "all", " ".join(other),
        "All rights reserved. " * 3 + "Released under the MIT License. " * 200, "Licensed under CC BY-SA 4.0. Licensed under CC BY 4.0.",
    ]
    got = found(spark, texts)
    assert set(got) == {0, 1, 5, 11, 12}
    assert set(got[0]) == set(got[1]) == {"MIT"} and got[0]["MIT"][0] < 1 and got[5] == {"GPL-2.0": (1.0, 1)}
    assert got[11] == {"Proprietary": (1.0, 3), "MIT": (1.0, 200)} and set(got[12]) == {"CC-BY-SA-4.0", "CC-BY-4.0"}


def test_dice_against_every_aligned_window(spark):
    """Brute force over the same windows, in plain Python, on texts of few words."""
    templates = {"A": ["a b c d e"], "B": ["a b c d f", "b c"], "C": ["c d c d c"]}
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 25))) for _ in range(60)]
    got = found(spark, texts, templates=templates)
    grams = lambda w: {(x, y) for x, y in zip(w, w[1:])}
    told = [(i, n, t.split()) for i, (n, t) in enumerate((n, t) for n, ts in sorted(templates.items()) for t in ts)]
    for d, text in enumerate(texts):
        w, hits = text.split(), set()
        for i, n, t in told:
            b = grams(t)
            rare = sorted(b)[: int(len(b) - len(b) * 2 / 3 + 1e-9) + 1]
            for off, g in enumerate(zip(t, t[1:])):
                for at, h in enumerate(zip(w, w[1:])):
                    if g in rare and g == h:
                        s, e = max(0, at - off), min(len(w), at - off + len(t))
                        a = grams(w[s:e])
                        dice = 2 * len(a & b) / (len(a) + len(b))
                        if dice >= 0.8:
                            hits.add((-dice, -len(a), n, i, s, e))
        stay = [x for x in hits if not any(y < x and 2 * (min(x[5], y[5]) - max(x[4], y[4])) > min(x[5] - x[4], y[5] - y[4]) for y in hits)]
        want = {}
        for x in stay:
            best, n = want.get(x[2], (0, 0))
            want[x[2]] = (max(best, round(-x[0], 9)), n + 1)
        assert got.get(d, {}) == want, text
