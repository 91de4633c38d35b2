"""Line chunks against a plain version of the same rule; planted blocks; runs of lines; hot chunks."""

import hashlib
import random

from pyspark.sql import functions as F

from ordograph.llm import line_chunks


def solid(line):
    return line.strip(" \t\r") != ""


def plain_chunks(text):
    lines = text.split("\n")
    at = [i for i, x in enumerate(lines) if solid(x)]
    h = [int(hashlib.md5(lines[i].encode()).hexdigest()[:8], 16) for i in at]
    flags = ""
    for k, z in enumerate(h):
        y, x = h[k - 1] if k else 0, h[k - 2] if k > 1 else 0
        flags += "1" if k and z != y and (z + 31 * y + 961 * x) % 2147483647 % 2 == 0 else "0"
    flags = flags.replace("11", "10")
    ends = [i for k, i in enumerate(at[:-2]) if flags[k] == "1"] + [len(lines) - 1]
    out, s = [], 0
    for e in ends:
        out.append((s, e, "\n".join(lines[s : e + 1]), sum(map(solid, lines[s : e + 1]))))
        s = e + 1
    return out


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts)], "doc_id long, text string, own string, ranges string, n_lines int")


def test_against_plain(spark):
    rng = random.Random(2)
    pool = [f"line {i} of the pool" for i in range(30)] + ["", "  ", "\t", "same", "same", "other"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(80)]
    for _ in range(20):
        a = rng.choice(texts).split("\n")
        texts.append("\n".join([rng.choice(pool), *a, rng.choice(pool)]))
    texts += ["", "\n\n\n", "a", "same\n" * 300, "same\nother\n" * 200, texts[3], texts[3]]
    got = {r["doc_id"]: r for r in line_chunks.without_repeats(frame(spark, texts)).collect()}
    seen = set()
    for d, t in enumerate(texts):
        kept, gone = [], 0
        for s, e, body, n in plain_chunks(t):
            if n >= 2 and body in seen:
                gone += e - s + 1
            else:
                kept.append(body)
            if n >= 2:
                seen.add(body)
        assert (got[d]["text"], got[d]["n_removed"], got[d]["n_lines"], got[d]["own"]) == ("\n".join(kept), gone, t.count("\n") + 1, "x"), d


def test_planted_blocks_and_lengths(spark):
    """Mean length of a chunk, and how much of a block of 4 to 40 lines that two documents share is found."""
    new = iter(f"unique line {i}" for i in range(100_000))
    texts, sizes = [], (4, 10, 20, 40)
    for n in sizes:
        for _ in range(100):
            block = [next(new) for _ in range(n)]
            for k in range(2):
                texts.append("\n".join([*(next(new) for _ in range(5 + k)), *block, *(next(new) for _ in range(7))]))
    docs = frame(spark, texts)
    rows = line_chunks.without_repeats(docs).select("doc_id", "n_removed").collect()
    found = [sum(r["n_removed"] for r in rows if r["doc_id"] // 200 == k) / (100 * n) for k, n in enumerate(sizes)]
    assert found[0] > 0.1 and found[1] > 0.45 and found[2] > 0.7 and found[3] > 0.83, found
    mean = line_chunks.chunks(docs).agg(F.avg(F.col("e") - F.col("s") + 1)).first()[0]
    assert 2.5 < mean < 3.6, mean


def test_one_chunk_in_a_third_of_rows(spark):
    block = "\n".join(f"notice {i}" for i in range(6))
    texts = [f"head {i}\n" + block + f"\ntail {i}" if i % 3 else block for i in range(3000)]
    got = line_chunks.without_repeats(frame(spark, texts)).filter("doc_id > 0 and doc_id % 3 = 0").agg(F.max(F.length("text")), F.count("*")).first()
    assert tuple(got) == (0, 999)
