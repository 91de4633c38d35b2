"""SpotSigs fingerprints and their join, with DataFrame functions only.

A signature is an anchor, a word from a list of common ones, and the chain of the next CHAIN content words (words not
in the list) within LOOK words. A fingerprint is the set of a text's signatures, 32 bits each, written in ascending
order as hexadecimal digits; a text without one has the hash of the whole text as its only signature, so equal texts
always have equal fingerprints. Likeness is the Jaccard coefficient of the sets. The 32 bits are the first of an MD5
hash, so that any engine can check them.

near_classes() joins a corpus by likeness. Sets of two sizes can only reach the threshold if they are in one length
class or in neighbouring ones, and share one of their first n - ceil(t n) + 1 signatures in any common order: ascending,
by their frequency in a sample, then ascending. So sets are dealt by (signature, length class), a set as a guest in
the next class too; dealings with the same members count once. A frequent one is cut into blocks, compared pair by pair,
each pair of sets only in its first dealing, by size first and then exactly. A pair of blocks returns counts and a
spanning forest, never its pairs.

A null text is empty. Rows that share a doc_id follow each other by their text; with one row, a document's next is
itself. A null doc_id comes first in the order, and is in a class but never its name unless the class has no other.
Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ordograph.llm.common import components, written
from ordograph.plans.storage import numbered

CHAIN, LOOK, THRESHOLD = 2, 10, 0.8
#: Sets of which frequent signatures are learned; places of the sketch of their counts (a byte each); sets in a block.
SAMPLE, SKETCH, BLOCK = 100_000, 1 << 20, 96
#: Rows in a range of with_next(), and marks by which ranges are cut.
RANGE_ROWS, MARKS = 2000, 256

# Common words of English, French, German and Spanish.
ANCHORS = """
the of and to in a is was be that for on with as by it at this are or an from
le la les de des du et un une que en est pour dans qui sur au par
der die das und ist mit von für sich den dem ein eine zu im auf nicht auch
el los las del y por con se al lo no su una para
""".split()
STOPS = sorted(set(ANCHORS))

_SEPARATOR = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def _bits(text) -> Column:
    """The first 32 bits of a string's MD5 hash, less 2 ** 31, as an int; in the order of the hexadecimal digits."""
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") - F.lit(1 << 31)).cast("int")


def _words(text) -> Column:
    return F.array_remove(F.split(F.lower(text), _SEPARATOR), "")


def _chains(words: str) -> Column:
    """(i, sig) of each anchor with a whole chain, by its place among the words."""

    def chain(i):
        content = F.slice(F.filter(F.slice(words, i + 2, F.lit(LOOK)), lambda w: ~w.isin(STOPS)), F.lit(1), F.lit(CHAIN))
        return F.when(F.size(content) == CHAIN, F.struct(i.alias("i"), _bits(F.concat_ws(" ", F.get(words, i), content)).alias("sig")))

    anchors = F.filter(F.transform(words, lambda w, i: F.when(w.isin(STOPS), i)), lambda i: i.isNotNull())
    return F.filter(F.transform(anchors, chain), lambda x: x.isNotNull())


def _signatures(sigs, text) -> Column:
    """The sorted set of signatures, never empty."""
    return F.sort_array(F.when(F.size(sigs) > 0, F.array_distinct(sigs)).otherwise(F.array(_bits(text))))


def signed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `s`, the set of signatures of a text column that isn't null."""
    return docs.withColumn("_w", _words(F.col(text))).withColumn("_c", _chains("_w")).withColumn("s", _signatures(F.col("_c.sig"), F.col(text))).drop("_w", "_c")


def _prepared(docs: DataFrame) -> DataFrame:
    """docs with what the edited text's signatures need of this one: `sigs` in the order of their places; how many of
    them (`early`) have their chain before the last quarter; the words (`context`) that a later chain can begin with."""
    kept = F.col("n_chars") - F.floor(F.col("n_chars") / 4).cast("int")
    whole = F.greatest(F.lit(0), F.size("_p") - 1)  # words that the cut leaves whole
    parted = F.when(F.substring("_start", -1, 1).rlike(_SEPARATOR), F.lit(" ")).otherwise(F.lit(""))
    return (
        docs.withColumn("n_chars", F.length("text")).withColumn("_w", _words(F.col("text"))).withColumn("_c", _chains("_w"))
        .withColumn("_start", F.substring("text", F.lit(1), kept)).withColumn("_p", _words(F.col("_start")))
        .withColumn("_m", F.greatest(F.lit(0), whole - LOOK))
        .withColumn("sigs", F.col("_c.sig")).withColumn("early", F.size(F.filter("_c", lambda x: x["i"] < F.col("_m"))))
        .withColumn("context", F.concat(F.concat_ws(" ", F.slice("_p", F.col("_m") + 1, F.size("_p") - F.col("_m"))), parted))
        .drop("_w", "_c", "_start", "_p", "_m")
    )


def written_out(signatures: str) -> Column:
    return F.array_join(F.transform(signatures, lambda x: F.lower(F.lpad(F.hex(x.cast("long") + F.lit(1 << 31)), 8, "0"))), "")


def likeness(a: str, b: str) -> Column:
    """Jaccard coefficient of two sets."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def length_class(size, least: float = THRESHOLD) -> Column:
    """Partition of a set by its size: sets as alike as `least` are in one class or in neighbouring ones."""
    return F.floor(F.log(size.cast("double")) / F.log(F.lit(1 / least)) + 1e-9).cast("int")


def with_next(docs: DataFrame, carried: list[str], made: Callable[[DataFrame], DataFrame], rows_each: int = RANGE_ROWS) -> DataFrame:
    """made(docs) with a struct `next` of the carried columns of the following row by doc_id (of the last one: the first).

    Rows are dealt into ranges of doc_id: between MARKS quantiles, each cut evenly into as many as rows_each asks for,
    so that their number grows with the table. A window serves inside a range; the first row of each range is joined
    to the last one before it.
    """
    n = docs.select("doc_id").count()
    parts = max(1, n // rows_each)
    marks = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [i / MARKS for i in range(MARKS + 1)], 20 * MARKS)).first()[0] if parts > 1 else []
    marks = sorted(set(marks or []))
    dealt = docs.withColumn("_bin", _range(marks, -(-parts // max(1, len(marks) - 1)), F.col("doc_id").cast("long")))
    order = W.partitionBy("_bin").orderBy("doc_id", "text")
    led = made(dealt).withColumn("next", F.lead(F.struct(*carried)).over(order))
    first = written(dealt.groupBy("_bin").agg(F.min(F.struct("doc_id", "text")).alias("first")).select("_bin", "first.*"), "firsts")
    places = written(numbered(first.select("_bin"), ["_bin"], "k"), "ranges")
    turn = places.agg(F.max("k")).first()[0] or 0
    before = places.select(F.col("_bin").alias("_before"), (F.col("k") % F.lit(max(1, turn)) + 1).alias("k"))
    linked = made(first).select("_bin", F.struct(*carried).alias("first")).join(places, "_bin").join(before, "k")
    return led.join(linked.select(F.col("_before").alias("_bin"), "first"), "_bin").withColumn("next", F.coalesce("next", "first")).drop("first", "_bin")


def _range(marks: list[int], each: int, x) -> Column:
    """Number of a range, ascending with x: by bisection of the marks, then evenly between two of them."""
    if len(marks) < 2:
        return F.lit(0).cast("long")

    def found(lo: int, hi: int):  # marks[lo] < x <= marks[hi]
        if hi - lo == 1:
            width = max(1, -(-(marks[hi] - marks[lo]) // each))
            return F.lit(lo * each).cast("long") + F.least(F.lit(each - 1).cast("long"), F.floor((x - F.lit(marks[lo] + 1)) / width).cast("long"))
        m = (lo + hi) // 2
        return F.when(x > F.lit(marks[m]), found(m, hi)).otherwise(found(lo, m))

    inner = F.when(x > F.lit(marks[-1]), F.lit((len(marks) - 1) * each).cast("long")).otherwise(found(0, len(marks) - 1))
    return F.when(x.isNull() | (x <= F.lit(marks[0])), F.lit(-1).cast("long")).otherwise(inner)


def _kind(signatures: str) -> Column:
    """A name for a set."""
    return F.md5(F.array_join(F.transform(signatures, lambda x: x.cast("string")), ",").cast("binary"))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(kind, class_id, n_links) of each set of signatures: the smallest doc_id of the sets connected by a likeness of at
    least threshold, and the number of other sets that it reaches the threshold with."""
    own = signed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    kinds = own.select("doc_id", "s", _kind("s").alias("kind")).groupBy("kind").agg(F.min("doc_id").alias("doc_id"), F.first("s").alias("s"))
    kinds = written(kinds.select(F.monotonically_increasing_id().alias("id"), "kind", "doc_id", F.size("s").alias("size"), "s"), "kinds")
    sample = kinds.orderBy(F.xxhash64("kind"), "kind").limit(SAMPLE).select(F.explode("s").alias("sig")).groupBy("sig").agg(F.count("*").alias("n")).filter("n > 1")
    sample = sample.groupBy(F.pmod("sig", F.lit(SKETCH)).alias("place")).agg(F.least(F.max("n"), F.lit(255)).alias("n"))
    sketch = bytearray(SKETCH)
    for r in sample.toLocalIterator():  # SKETCH rows at most
        sketch[r["place"]] = r["n"]
    level = lambda x: F.substring(F.lit(sketch), F.pmod(x, F.lit(SKETCH)) + 1, F.lit(1))
    ordered = F.transform(F.sort_array(F.transform("s", lambda x: F.struct(level(x).alias("n"), x.alias("sig")))), lambda x: x["sig"])
    share = F.ceil(F.col("size") * threshold - 1e-9).cast("int")
    first = kinds.select("id", "size", F.explode(F.slice(ordered, F.lit(1), F.col("size") - share + 1)).alias("sig"))
    first = written(first, "first-signatures")
    shared = first.groupBy("sig").agg(F.count("*").alias("n")).filter("n > 1").select("sig")
    home = length_class(F.col("size"), threshold)
    dealt = first.join(shared, "sig", "left_semi").select("id", F.explode(F.array(*[F.col("sig").cast("long") * 1024 + home + k for k in (0, 1)])).alias("deal"))
    dealt = written(dealt, "dealings")
    members = dealt.groupBy("deal").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("z"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"), F.min("id").alias("a")).filter("n > 1")
    members = members.groupBy("n", "z", "y", "a").agg(F.min("deal").alias("deal")).select("deal", "n")
    placed = written(dealt.join(members, "deal").select("deal", "n", "id"), "placed")
    deals = placed.groupBy("id").agg(F.sort_array(F.collect_list("deal")).alias("deals"))
    full = placed.join(kinds.select("id", "size", "s").join(deals, "id"), "id")
    full = full.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    blocks = written(full.groupBy("deal", "part").agg(F.collect_list(F.struct("id", "size", "s", "deals")).alias("x")), "blocks")
    other = blocks.select(F.col("deal").alias("_deal"), F.col("part").alias("two"), F.col("x").alias("y"))
    pairs = blocks.join(other, (F.col("deal") == F.col("_deal")) & (F.col("part") <= F.col("two")))

    def alike(a, b):
        both = F.size(F.array_intersect(a["s"], b["s"]))
        sized = F.least(a["size"], b["size"]) >= threshold * F.greatest(a["size"], b["size"]) - 1e-9
        fresh = ((F.col("part") < F.col("two")) | (a["id"] < b["id"])) & (F.array_min(F.array_intersect(a["deals"], b["deals"])) == F.col("deal"))
        return sized & fresh & (both >= threshold * (a["size"] + b["size"] - both) - 1e-9)

    near = F.transform("x", lambda a: F.struct(a["id"].alias("id"), F.transform(F.filter("y", lambda b: alike(a, b)), lambda b: b["id"]).alias("near")))
    met = pairs.select(F.filter(near, lambda a: F.size(a["near"]) > 0).alias("found")).filter(F.size("found") > 0)
    ends = F.array_distinct(F.concat(F.col("found.id"), F.flatten("found.near")))

    def joined(labels, a):
        touched = F.transform(F.filter(labels, lambda x: (x["id"] == a["id"]) | F.array_contains(a["near"], x["id"])), lambda x: x["root"])
        least = F.array_min(touched)
        return F.transform(labels, lambda x: F.struct(x["id"].alias("id"), F.when(F.array_contains(touched, x["root"]), least).otherwise(x["root"]).alias("root")))

    met = met.withColumn("ends", ends)
    met = met.select(
        F.transform("ends", lambda i: F.struct(i.alias("id"), (
            F.coalesce(F.size(F.flatten(F.transform(F.filter("found", lambda a: a["id"] == i), lambda a: a["near"]))), F.lit(0)) + F.size(F.filter("found", lambda a: F.array_contains(a["near"], i)))
        ).alias("n"))).alias("counts"),
        F.aggregate("found", F.transform("ends", lambda i: F.struct(i.alias("id"), i.alias("root"))), joined).alias("forest"),
    )
    met = written(met, "met")
    counts = met.select(F.inline("counts")).groupBy("id").agg(F.sum("n").alias("n_links"))
    roots = components(met.select(F.inline("forest")).select(F.col("id").alias("a"), F.col("root").alias("b")), "spot-classes")
    named = kinds.select("id", "kind", "doc_id").join(roots, F.col("id") == F.col("node")).join(counts, "id")
    least = named.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    linked = named.join(least, "root").select("kind", "class_id", "n_links")
    alone = kinds.join(roots, F.col("id") == F.col("node"), "left_anti").select("kind", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone)


def fingerprints(docs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """For each row: its fingerprint, that of its text with the last quarter replaced by the start of the next
    document's, and the likeness of its own with that and with the next document's; with classes, also class_id and
    n_links."""
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    led = with_next(plain, ["text", "sigs"], _prepared)
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    start = F.substring(F.col("next.text"), F.lit(1), quarter)
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - quarter), start)
    both = led.select(
        "doc_id", "n_chars", "sigs", "early", F.col("next.sigs").alias("nsigs"), F.col("next.text").alias("ntext"), "text", edited.alias("edited"),
        _words(F.concat("context", start)).alias("_w"),
    ).withColumn("_c", _chains("_w"))
    both = both.withColumns({
        "s": _signatures(F.col("sigs"), F.col("text")), "ns": _signatures(F.col("nsigs"), F.col("ntext")),
        "es": _signatures(F.concat(F.slice("sigs", F.lit(1), F.col("early")), F.col("_c.sig")), F.col("edited")),
    })
    out = both.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), written_out("s").alias("fingerprint"),
        written_out("es").alias("edited_fingerprint"), likeness("s", "es").alias("near_edited"), likeness("s", "ns").alias("near_next"),
        length_class(F.size("s")).alias("length_class"), _kind("s").alias("kind"),
    )
    if classes is None:
        return out.drop("kind")
    named = classes.select(F.col("kind").alias("_kind"), "class_id", "n_links")
    return out.join(named, F.col("kind") == F.col("_kind"), "left").drop("kind", "_kind")


def document_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links, length_class) for each row of docs."""
    classes = written(near_classes(docs), "spot-named")
    own = signed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).select("doc_id", length_class(F.size("s")).alias("length_class"), _kind("s").alias("kind"))
    return own.join(classes, "kind").select("doc_id", "class_id", "n_links", "length_class")


_STOP_LIST = ", ".join(f"'{w}'" for w in STOPS)


def _sql_signatures(text: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({text}), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""(select coalesce(list(distinct m order by m), [substr(md5({text}), 1, 8)]) from (
      select substr(md5(w[i] || ' ' || c[1] || ' ' || c[2]), 1, 8) m from (
        select w, i, list_filter(w[i + 1 : i + {LOOK}], lambda x: not list_contains(stops, x))[1:{CHAIN}] c from (
          select w, unnest(range(1, len(w) + 1)) i from (select {words} w))
        where list_contains(stops, w[i])) where len(c) = {CHAIN}))"""


def _sql_likeness(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"cast({both} as double) / (len({a}) + len({b}) - {both})"


_TEXTS = f"""
with recursive stop as (select [{_STOP_LIST}] stops),
t as (select doc_id, coalesce(text, '') text from documents),
"""

ORACLE = f"""{_TEXTS}
n as (select doc_id, text, row_number() over (order by doc_id, text) k,
        coalesce(lead(text) over (order by doc_id, text), first_value(text) over (order by doc_id, text)) following from t),
d as (select *, substr(text, 1, length(text) - length(text) // 4) || substr(following, 1, length(text) // 4) edited from n),
x as (select d.*, {_sql_signatures('text')} s, {_sql_signatures('edited')} es, {_sql_signatures('following')} ns from d, stop)
select doc_id, length(text) n_chars, sha256(edited) edited_sha256, array_to_string(s, '') fingerprint, array_to_string(es, '') edited_fingerprint,
       {_sql_likeness('s', 'es')} near_edited, {_sql_likeness('s', 'ns')} near_next, cast(floor(ln(len(s)) / ln(1.25) + 1e-9) as integer) length_class
from x
"""

CLASSES_ORACLE = f"""{_TEXTS}
x as materialized (select t.*, {_sql_signatures('text')} s from t, stop),
kind as materialized (select s, min(doc_id) id from x group by s),
sig as (select id, len(s) n, unnest(s) g from kind),
link as materialized (select a.id, b.id near from sig a join sig b on a.g = b.g and a.id <> b.id group by a.id, a.n, b.id, b.n
         having count(*) >= {THRESHOLD} * (a.n + b.n - count(*)) - 1e-9),
reach as (select id, id root from kind union select link.near, root from reach join link on reach.id = link.id),
class as (select id, min(root) class_id from reach group by id),
links as (select id, count(*) n_links from link group by id)
select doc_id, class_id, coalesce(n_links, 0) n_links, cast(floor(ln(len(x.s)) / ln(1.25) + 1e-9) as integer) length_class
from x join kind on x.s = kind.s join class on kind.id = class.id left join links on links.id = kind.id
"""
