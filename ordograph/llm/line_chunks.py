"""Line dedup by content-defined chunks, with DataFrame functions only.

A text's lines (split at line feeds) are hashed, those with any character but blanks, tabs and carriage returns
("solid" lines) only. A rolling hash over the hashes x, y, z of three solid lines in a row, (z + A y + A^2 x) modulo the
prime P, ends a chunk after z where it is 0 modulo `spread`; so insertions move no boundary but those next to them. No
chunk ends between equal lines, of ends that follow each other line by line every second one counts, and a text's first
and last two solid lines stay together: each chunk has two solid lines at least, if the text has, and three in the mean
where lines differ. Before a text's first line, x and y are 0.

Of a chunk of at least two solid lines that occurs more than once, the place with the smallest (doc_id, line) stays; the
others go. Hashes only find candidates: places are grouped by the chunk's own bytes.

A null text counts as empty (one empty line). Rows that share a doc_id count as one document, so a chunk's first
place stays in each of them; a null doc_id is never first and its chunks are never removed. Extra columns stay, but for
n_lines and n_removed, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ordograph.llm.common import fresh

SPREAD, A, P = 2, 31, 2_147_483_647
#: Tasks among which the places of one frequent chunk are dealt.
SALTS = 8
_SOLID = "[^ \\t\\r]"


def _shifted(array: str, first):
    return F.slice(F.concat(F.array(first), F.col(array)), F.lit(1), F.size(array))


def chunks(docs: DataFrame, spread: int = SPREAD) -> DataFrame:
    """(doc_id, s, e, body): the chunks of each text, lines s to e counted from 0."""
    zero = F.lit(0).cast("long")
    inner = F.greatest(F.lit(0), F.size("_at") - 2)  # the last two solid lines are in the last chunk
    at = F.filter(F.transform("_lines", lambda x, i: F.when(x.rlike(_SOLID), i)), lambda i: i.isNotNull())
    hashed = F.transform("_at", lambda i: F.conv(F.substring(F.md5(F.get("_lines", i).cast("binary")), 1, 8), 16, 10).cast("long"))
    # the first line counts as equal to the one before it, so that no chunk ends there
    flags = F.zip_with(F.zip_with("_h", "_y", lambda z, y: F.struct(z.alias("z"), y.alias("y"))), "_x", lambda zy, x: F.when((zy["z"] != zy["y"]) & ((zy["z"] + A * zy["y"] + A * A * x) % P % spread == 0), "1").otherwise("0"))
    ends = F.zip_with(F.slice("_at", F.lit(1), inner), F.slice("_flags", F.lit(1), inner), lambda i, f: F.when(f == "1", i))
    return (
        docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("_lines"))
        .withColumn("_at", at)
        .withColumn("_h", hashed)
        .withColumn("_y", _shifted("_h", F.get("_h", F.lit(0))))
        .withColumn("_x", F.slice(F.concat(F.array(zero, zero), F.col("_h")), F.lit(1), F.size("_h")))
        .withColumn("_flags", F.split(F.replace(F.array_join(flags, ""), F.lit("11"), F.lit("10")), ""))
        .withColumn("_ends", F.concat(F.filter(ends, lambda i: i.isNotNull()), F.array(F.size("_lines") - 1)))
        .withColumn("_starts", F.slice(F.concat(F.array(F.lit(0)), F.transform("_ends", lambda x: x + 1)), F.lit(1), F.size("_ends")))
        .select("doc_id", "_lines", F.explode(F.arrays_zip(F.col("_starts").alias("s"), F.col("_ends").alias("e"))).alias("at"))
        .select("doc_id", F.col("at.s").alias("s"), F.col("at.e").alias("e"), F.slice("_lines", F.col("at.s") + 1, F.col("at.e") - F.col("at.s") + 1).alias("_part"))
        .filter(F.size(F.filter("_part", lambda x: x.rlike(_SOLID))) >= 2)
        .select("doc_id", "s", "e", F.array_join("_part", "\n").alias("body"))
    )


def repeated(docs: DataFrame, spread: int = SPREAD) -> DataFrame:
    """(doc_id, gone): for each document with later copies of a chunk, its line ranges {s, e} to remove."""
    body = F.coalesce("body", F.lit(""))  # never null, so that no filter tells the two uses of `places` apart
    salt = F.pmod(F.xxhash64("doc_id", "s"), F.lit(SALTS)).cast("int")
    places = chunks(docs, spread).filter("doc_id is not null").select("doc_id", "s", "e", body.alias("body"), F.xxhash64(body).alias("h"), salt.alias("salt"))
    # Both uses of `places` read the same columns, hence one shuffle by (h, salt), which splits frequent chunks.
    parts = places.groupBy("h", "salt").agg(F.count("*").alias("n"))
    often = parts.groupBy("h").agg(F.sum("n").alias("n"), F.collect_set("salt").alias("salts")).filter("n > 1").select("h", F.explode("salts").alias("salt"))
    again = places.join(often, ["h", "salt"], "left_semi").select("doc_id", "s", "e", "body")
    first = again.groupBy("body").agg(F.min(F.struct("doc_id", "s", "e")).alias("first"))
    later = again.join(first, "body").filter("not (doc_id = first.doc_id and s = first.s)")
    return later.groupBy("doc_id").agg(F.collect_set(F.struct("s", "e")).alias("gone"))


def without_repeats(docs: DataFrame, spread: int = SPREAD) -> DataFrame:
    """docs with `text` less its repeated chunks, plus n_lines and n_removed."""
    own, ranges = fresh(docs, "own", "ranges")
    gone = repeated(docs, spread).select(F.col("doc_id").alias(own), F.col("gone").alias(ranges))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    kept = F.filter(lines, lambda x, i: ~F.exists(ranges, lambda r: (i >= r["s"]) & (i <= r["e"])))
    removed = F.coalesce(F.aggregate(ranges, F.lit(0), lambda a, r: a + r["e"] - r["s"] + 1), F.lit(0))
    return (
        docs.join(gone, docs.doc_id == gone[own], "left").drop(own)
        .withColumn("n_lines", F.size(lines).cast("long")).withColumn("n_removed", removed.cast("long"))
        .withColumn("text", F.when(F.col(ranges).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
        .drop(ranges)
    )


ORACLE = f"""
with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
x as (select doc_id, unnest(ls) line, unnest(range(len(ls))) i from l),
y as (select doc_id, i, row_number() over w k, count(*) over (partition by doc_id) n, ('0x' || substr(md5(line), 1, 8))::bigint h,
        lag(h) over w h1, lag(h, 2) over w h2
      from x where regexp_matches(line, '[^ \\t\\r]') window w as (partition by doc_id order by i)),
z as (select doc_id, i, k, n, case when h <> coalesce(h1, h) and (h + {A} * coalesce(h1, 0) + {A * A} * coalesce(h2, 0)) % {P} % {SPREAD} = 0 then '1' else '0' end f from y),
a as (select doc_id, replace(string_agg(f, '' order by k), '11', '10') fs from z group by doc_id),
b as (select z.doc_id, i, case when k <= n - 2 and substr(fs, k, 1) = '1' then 1 else 0 end e from z join a on z.doc_id = a.doc_id),
c as (select x.doc_id, x.i, line, b.i solid, coalesce(sum(coalesce(e, 0))
        over (partition by x.doc_id order by x.i rows between unbounded preceding and 1 preceding), 0) k from x left join b on x.doc_id = b.doc_id and x.i = b.i),
g as (select doc_id, k, min(i) s, count(*) lines, string_agg(line, chr(10) order by i) body, count(solid) solid from c group by doc_id, k),
f as (select *, case when solid >= 2 then row_number() over (partition by body, solid >= 2 order by doc_id, s) else 1 end nth from g)
select doc_id, cast(sum(lines) as bigint) n_lines, cast(coalesce(sum(lines) filter (where nth > 1), 0) as bigint) n_removed,
       md5(coalesce(string_agg(body, chr(10) order by s) filter (where nth = 1), '')) kept_md5
from f group by doc_id
"""
