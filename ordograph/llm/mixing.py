"""Mixing sources to target weights by temperature.

Weights are source token shares raised to an exponent. The exponent is bisected (32 sections at once) on the table of
shares until the mix has the target entropy, and raised where a source would repeat more often than the limit. Each
source's budget is then filled from permutations of its blocks, epoch after epoch, up to the budget's last document.

Tokens are words between ASCII white space. A null source is the source "(none)", a null text is empty; documents
without a word stay once. With one source, or no words at all, weights are the shares themselves. Repeated rows are
separate documents with the same place in the order. Extra columns play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ordograph.llm.common import fresh, running_totals, written

SECTIONS = 32
BLOCK_TOKENS = 100_000


def token_counts(docs: DataFrame) -> DataFrame:
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    return docs.select("doc_id", F.coalesce("source", F.lit("(none)")).alias("source"), words.cast("long").alias("n_tokens"))


def _at(shares: DataFrame, exponents: list[float]) -> list[dict]:
    """For each exponent: entropy of the mix, and the largest and smallest of weight over share."""
    grid = shares.select(F.log("share").alias("l"), F.explode(F.array(*[F.lit(float(x)) for x in exponents])).alias("x"))
    g = grid.withColumn("p", F.exp(F.col("x") * F.col("l")))
    agg = g.groupBy("x").agg(F.sum("p").alias("z"), F.sum(F.col("p") * F.col("x") * F.col("l")).alias("pl"), F.max(F.col("p") / F.exp("l")).alias("most"), F.min(F.col("p") / F.exp("l")).alias("least"))
    return sorted(({"x": r["x"], "z": r["z"], "entropy": math.log(r["z"]) - r["pl"] / r["z"], "most": r["most"] / r["z"], "least": r["least"] / r["z"]} for r in agg.collect()), key=lambda r: r["x"])


def exponent(shares: DataFrame, entropy_share: float, most_repeats: float, keep_all: bool) -> dict:
    """The row of _at() for the smallest exponent from 0 to 1 whose mix has at most the target entropy, a share of
    the largest possible, and at most most_repeats epochs of any source (1 where no smaller one will do)."""
    k = shares.count()
    target = entropy_share * math.log(k) if k > 1 else 0.0

    def meets(r: dict) -> bool:
        epochs = r["most"] / r["least"] if keep_all else r["most"]
        return r["x"] >= 1 or (r["entropy"] <= target + 1e-12 and epochs <= most_repeats + 1e-9)

    lo, hi, best = 0.0, 1.0, None
    for _ in range(4):
        rows = _at(shares, [lo + (hi - lo) * i / SECTIONS for i in range(SECTIONS + 1)])
        best = next(r for r in rows if meets(r) or r["x"] >= hi)
        at = rows.index(best)
        if at == 0:
            break
        lo, hi = rows[at - 1]["x"], best["x"]
    return best


def mixed_order(docs: DataFrame, budget: int | None = None, entropy_share: float = 0.95, most_repeats: float = 4.0, keep_all: bool = False, seed: int = 17) -> DataFrame:
    """(doc_id, source, n_tokens, weight, epoch, block, place, position, window): a row for each time a document is used.

    budget: tokens of the mix; by default as many as docs have, or with keep_all as many as use each document at
    least once. place: tokens of its source before it, in the order of the source's block permutations; position: the
    same as a part of the source's budget, by which the whole mix is ordered. Each source so runs through its budget
    evenly, and each window, a part of the mix of BLOCK_TOKENS tokens, has the target weights. A source's total differs
    from weight * budget by less than its last document.
    """
    counted = written(token_counts(docs), "tokens")
    by_source = written(counted.groupBy("source").agg(F.sum("n_tokens").alias("total")).filter("total > 0"), "sources")
    total = by_source.agg(F.sum("total")).first()[0] or 0
    zero = F.lit(0).cast("long")
    empty = counted.filter("n_tokens = 0").select("doc_id", "source", "n_tokens", F.lit(0.0).alias("weight"), F.lit(0).alias("epoch"), zero.alias("block"), zero.alias("place"), F.lit(0.0).alias("position"), zero.alias("window"))
    if not total:
        return empty
    shares = by_source.withColumn("share", F.col("total") / F.lit(float(total)))
    best = exponent(shares, entropy_share, most_repeats, keep_all)
    budget = budget or (math.ceil(total / best["least"] - 1e-9) if keep_all else total)
    plan = shares.withColumn("weight", F.exp(F.log("share") * best["x"]) / best["z"]).withColumn("tokens", F.col("weight") * budget)
    plan = plan.withColumn("blocks", F.ceil(F.col("total") / BLOCK_TOKENS)).withColumn("epochs", F.ceil(F.col("tokens") / F.col("total") - 1e-9).cast("int"))
    used = counted.filter("n_tokens > 0").join(plan.select("source", "total", "weight", "tokens", "blocks", "epochs"), "source")
    used = used.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    used = used.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("blocks")))
    used = used.withColumn("turn", F.xxhash64(F.lit(seed + 1), "epoch", "source", "block")).withColumn("place", F.xxhash64(F.lit(seed + 2), "epoch", "doc_id"))
    placed = written(running_totals(used, ["source", "epoch", "turn", "block", "place", "doc_id"], "n_tokens", "before"), "placed")
    starts = placed.groupBy("source").agg(F.min("before").alias("base"))
    placed = placed.join(starts, "source").withColumn("at", F.col("before") - F.col("base"))
    windows = max(1, math.ceil(budget / BLOCK_TOKENS))
    # every document's first epoch stays with keep_all, whatever the last digit of its source's budget
    stays = placed.filter((F.col("at") < F.col("tokens") - 1e-6) | (F.lit(keep_all) & (F.col("epoch") == 0)))
    window = F.least(F.lit(windows - 1), F.floor(F.col("at") / F.col("tokens") * windows)).cast("long")
    position = F.least(F.lit(1.0), F.col("at") / F.col("tokens"))
    return stays.select("doc_id", "source", "n_tokens", "weight", "epoch", F.col("block").cast("long").alias("block"), F.col("at").cast("long").alias("place"), position.alias("position"), window.alias("window")).unionByName(empty)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """docs with each row as often as mixed_order uses it; columns stay."""
    own, uses, use = fresh(docs, "own", "uses", "use")
    often = mixed_order(docs, **how).groupBy(F.col("doc_id").alias(own)).agg(F.count_distinct("epoch").cast("int").alias(uses))
    again = docs.join(often, docs.doc_id.eqNullSafe(often[own]))
    return again.withColumn(use, F.explode(F.sequence(F.lit(1), F.col(uses)))).select(*docs.columns)
