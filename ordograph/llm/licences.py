"""Licence scans with DataFrame functions only: Dice coefficient over word bigrams against templates.

A text is one sequence of words, lower-cased, with anything but a-z and 0-9 as a separator, so line breaks, paragraphs
and comment signs play no part. A template of n words and b different bigrams is compared with windows of n words. A
window that reaches the threshold t shares at least b t / (2 - t) of the template's bigrams, so it has one of any
b - b t / (2 - t) + 1 of them: those are the template's anchors, the longest bigrams as the rarest. Where an anchor
occurs in a text, the window that puts it at its place in the template is a candidate (clipped at the text's ends).

Size bounds prune candidates: a window's count a of different bigrams must have b t / (2 - t) <= a <= b (2 - t) / t. Of
windows that overlap by more than half of the shorter one only the best stays: by the coefficient, then more bigrams,
then the smaller licence name, template, start, end.

Null and empty texts match nothing. Rows that share a doc_id count as one document, equal texts in it once. Extra
columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ordograph.llm.common import written
from ordograph.llm.licence_texts import TEMPLATES

THRESHOLD = 0.8
#: Most bigrams of all templates together, which are broadcast; most text of a window's bucket of starts.
MOST_BIGRAMS, BUCKET = 1_000_000, 64


def _words(text):
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def _bigrams(words):
    return F.zip_with(F.slice(words, F.lit(1), F.greatest(F.lit(0), F.size(words) - 1)), F.slice(words, F.lit(2), F.greatest(F.lit(0), F.size(words) - 1)), lambda a, b: F.concat(a, F.lit(" "), b))


def known_templates(spark: SparkSession, templates: dict[str, list[str]], threshold: float) -> DataFrame:
    """(template, licence, words, b, grams, anchors {gram, offset}) of templates of at least two words."""
    rows = [(i, name, text) for i, (name, text) in enumerate((n, t) for n, ts in sorted(templates.items()) for t in ts)]
    known = spark.createDataFrame(rows, "template int, licence string, body string").withColumn("_w", _words(F.col("body")))
    known = known.withColumn("_g", _bigrams("_w")).withColumn("grams", F.array_distinct("_g")).withColumn("b", F.size("grams")).filter("b > 0")
    most = F.floor(F.col("b") - F.col("b") * (threshold / (2 - threshold)) + 1e-9) + 1
    by_length = F.array_sort(F.transform("grams", lambda g: F.struct((-F.length(g)).alias("l"), g.alias("g"))))
    chosen = F.transform(F.slice(by_length, F.lit(1), most.cast("int")), lambda x: x["g"])
    placed = F.transform("_g", lambda g, i: F.struct(g.alias("gram"), i.alias("offset")))
    anchors = F.filter(placed, lambda x: F.array_contains(F.col("_chosen"), x["gram"]))
    return known.withColumn("_chosen", chosen).select("template", "licence", F.size("_w").alias("words"), "b", "grams", anchors.alias("anchors"))


def windows(docs: DataFrame, templates: dict[str, list[str]], threshold: float) -> DataFrame:
    """(doc_id, body, template, licence, s, e, a, dice): candidate windows, words s to e - 1, that reach the threshold."""
    spark = docs.sparkSession
    told = known_templates(spark, templates, threshold).collect()  # a row a template
    if sum(r["b"] for r in told) > MOST_BIGRAMS:
        raise ValueError(f"more than {MOST_BIGRAMS} template bigrams")
    at = {}
    for r in told:
        for x in r["anchors"]:
            at.setdefault(x["gram"], []).append((r["template"], x["offset"], r["words"], r["b"]))
    anchors = spark.createDataFrame(list(at.items()) or [("", [])], "gram string, uses array<struct<template: int, offset: int, words: int, b: int>>")
    known = spark.createDataFrame([(r["template"], r["licence"], r["grams"]) for r in told], "template int, licence string, known array<string>")
    grams = F.transform(_bigrams("_w"), lambda g, i: F.when(g.isin(list(at)), F.struct(i.alias("i"), g.alias("gram"))))
    found = (
        docs.select("doc_id", "text").withColumn("_w", _words(F.coalesce("text", F.lit(""))))
        .withColumn("_hits", F.filter(grams, lambda x: x.isNotNull())).filter(F.size("_hits") > 0)
        .select("doc_id", F.md5(F.col("text").cast("binary")).alias("body"), "_w", F.inline("_hits"))
        .join(F.broadcast(anchors), "gram")  # MOST_BIGRAMS
        .select("doc_id", "body", "_w", "i", F.inline("uses"))
        .withColumn("s", F.greatest(F.lit(0), F.col("i") - F.col("offset")))
        .withColumn("e", F.least(F.size("_w"), F.col("i") - F.col("offset") + F.col("words")))
        .withColumn("_part", F.slice("_w", F.col("s") + 1, F.col("e") - F.col("s")))
        .select("doc_id", "body", "template", "s", "e", "b", F.array_distinct(_bigrams("_part")).alias("grams"))
        .withColumn("a", F.size("grams"))
    )
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    sized = found.filter(F.col("a").between(F.col("b") * low - 1e-9, F.col("b") * high + 1e-9)).join(F.broadcast(known), "template")  # MOST_BIGRAMS
    dice = 2.0 * F.size(F.array_intersect("grams", "known")) / (F.col("a") + F.col("b"))
    return sized.withColumn("dice", dice).filter(F.col("dice") >= threshold).select("doc_id", "body", "template", "licence", "s", "e", "a", "dice").distinct()


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, licence, dice, n_places): for each document and licence that has windows left, the best coefficient and
    the number of windows."""
    hits = written(windows(docs, templates or TEMPLATES, threshold), "licence-windows")
    # windows that overlap share a bucket of words
    parts = hits.withColumn("part", F.explode(F.sequence(F.floor(F.col("s") / BUCKET), F.floor((F.col("e") - 1) / BUCKET))))
    rank = F.struct(-F.col("dice"), -F.col("a"), "licence", "template", "s", "e")
    x = parts.select("doc_id", "body", "part", "template", "s", "e", rank.alias("x")).alias("x")
    y = parts.select("doc_id", "body", "part", F.col("s").alias("ys"), F.col("e").alias("ye"), rank.alias("y")).alias("y")
    shared = F.least("e", "ye") - F.greatest("s", "ys")
    same = F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.body") == F.col("y.body")) & (F.col("x.part") == F.col("y.part"))
    beaten = x.join(y, same & (2 * shared > F.least(F.col("e") - F.col("s"), F.col("ye") - F.col("ys"))) & (F.col("y") < F.col("x")), "left_semi")
    beaten = beaten.select("doc_id", "body", "template", "s", "e").distinct().alias("b")
    same = F.col("h.doc_id").eqNullSafe(F.col("b.doc_id"))
    for c in ("body", "template", "s", "e"):
        same = same & (F.col(f"h.{c}") == F.col(f"b.{c}"))
    left = hits.alias("h").join(beaten, same, "left_anti")
    return left.groupBy("doc_id", "licence").agg(F.round(F.max("dice"), 9).alias("dice"), F.count("*").alias("n_places"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle(templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> str:
    values = ", ".join(f"({i}, {_quoted(n)}, {_quoted(t)})" for i, (n, t) in enumerate((n, t) for n, ts in sorted((templates or TEMPLATES).items()) for t in ts))
    words = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"
    grams = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    return f"""
with t as (select template, licence, {words.format('body')} w from (values {values}) v(template, licence, body)),
tg as (select template, licence, len(w) n, {grams.format('w')} g, list_distinct({grams.format('w')}) d from t where len(w) > 1),
tr as (select template, gram, len(d) b, row_number() over (partition by template order by length(gram) desc, gram) r from (select template, d, unnest(d) gram from tg)),
ch as (select template, gram from tr where r <= floor(b - b * {low} + 1e-9) + 1),
pl as (select template, unnest(g) gram, unnest(range(len(g))) off from tg),
an as (select pl.template, pl.gram, off from pl join ch on pl.template = ch.template and pl.gram = ch.gram),
dw as (select doc_id, text body, {words.format("coalesce(text, '')")} w from (select distinct doc_id, text from documents)),
dp as (select doc_id, body, w, unnest({grams.format('w')}) gram, unnest(range(len(w) - 1)) i from dw where len(w) > 1),
c as (select distinct doc_id, body, an.template, licence, n, tg.d, w, i - off p from dp join an on dp.gram = an.gram join tg on tg.template = an.template),
u as (select doc_id, body, template, licence, d, greatest(0, p) s, least(len(w), p + n) e, w[greatest(0, p) + 1 : least(len(w), p + n)] part from c),
g as (select doc_id, body, template, licence, s, e, d, list_distinct({grams.format('part')}) q from u),
h as (select distinct doc_id, body, template, licence, s, e, len(q) a, 2.0 * len(list_intersect(q, d)) / (len(q) + len(d)) dice from g
      where len(q) between len(d) * {low} - 1e-9 and len(d) * {high} + 1e-9),
k as (select * from h where dice >= {threshold}),
l as (select * from k x where not exists (select 1 from k y where x.doc_id = y.doc_id and x.body = y.body
      and 2 * (least(x.e, y.e) - greatest(x.s, y.s)) > least(x.e - x.s, y.e - y.s)
      and (-y.dice, -y.a, y.licence, y.template, y.s, y.e) < (-x.dice, -x.a, x.licence, x.template, x.s, x.e)))
select doc_id, licence, round(max(dice), 9) dice, count(*) n_places from l group by doc_id, licence
"""
