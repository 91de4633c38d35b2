"""Named queries over the driver's tables and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ordograph.functions import scalars as S
from ordograph.operators import analytics as A, bandwidth as B, centrality as C, construct as K, graph as G, learn as L, ordering as O, profile as P, traverse as T
from ordograph.plans.storage import numbered, shared_folder, table, written
from ordograph.sources import matrix_market as M

TREE = """select cast(r_regionkey+1 as int) u, cast(n_nationkey+6 as int) v from nation join region on n_regionkey=r_regionkey
union all select cast(c_nationkey+6 as int), cast(30+row_number() over(order by c_custkey) as int) from customer"""
SP = """select distinct cast(dense_rank() over(order by l_suppkey) as int) u,
 cast((select count(distinct l_suppkey) from lineitem)+dense_rank() over(order by l_partkey) as int) v from lineitem"""
USER = """select distinct cast(dense_rank() over(order by user_id) as int) u,
 cast((select count(distinct user_id) from events)+dense_rank() over(order by event_type) as int) v from events"""
SEQ = """select least(a,b)+1 u, greatest(a,b)+1 v from (select cast(user_id as int) a,
 cast(lead(user_id) over(order by ts,event_id) as int) b from events) t where b is not null and a<>b"""
RUNS = """select event_id run_id, concat('inst_', cast(user_id % 40 as varchar)) instance, cast(event_id % 30 as int) episode,
 cast(event_id % 15 as int) attempt, list_extract(['Degree','Closeness','Betweenness','Eigenvector','Katz Centrality','PageRank',
 'Harmonic Centrality'], cast(event_id % 7 as int)+1) centrality, cast(floor(value) as int) bandwidth,
 2*cast(user_id % 40 as int)+401 initial_bandwidth from events"""
COO = """select 'coo' instance, dense_rank() over(order by l_suppkey) i, dense_rank() over(order by l_partkey) j, l_quantity val,
 row_number() over(order by l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity) ord from lineitem"""


def _graph(edges: str, more: str = "") -> str:
    """Common table expressions: edges, adj, verts, n, labels (identity) and rnd (md5 labels)."""
    return f"""with recursive edges as ({edges}), simple as (select distinct u, v from edges),
adj as (select u src, v dst from edges union all select v, u from edges), sadj as (select distinct src, dst from adj),
verts as (select distinct src v from adj), n as (select count(*) n from verts),
rnd as (select v, row_number() over(order by md5('7:' || v), v) l from verts),
st as (select src, dst, a.l fs, b.l fd, abs(a.l - b.l) d from adj join rnd a on a.v = src join rnd b on b.v = dst) {more} """


BFS = """, bfs(v, l) as (select 1, 0 union select dst, l + 1 from bfs join sadj on src = v where l < 12),
lev as (select v, min(l) level from bfs group by v)"""
APSP = """, walk(s, v, l) as (select v, v, 0 from verts union select s, dst, l + 1 from walk join sadj on src = walk.v where l < 6),
dist as (select s src, v dst, min(l) d from walk group by s, v)"""
DEG = ", deg as (select src v, count(*) degree from sadj group by src)"

_made: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _made[name] = (f, sql)
        return f

    return add


def _tree(s, d):
    return G.tree_graph(s, d)


def _user(s, d):
    return G.user_graph(s, d)


def _kept(edges):
    return written(edges, "edges")


def _rnd(edges):
    return B.random_labels(edges, 7)


def _runs(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    names = F.array(*map(F.lit, A.ORDER))
    group = F.col("user_id") % 40
    return e.select(F.col("event_id").alias("run_id"), F.concat(F.lit("inst_"), group.cast("string")).alias("instance"), (F.col("event_id") % 30).cast("int").alias("episode"), (F.col("event_id") % 15).cast("int").alias("attempt"), F.get(names, (F.col("event_id") % 7).cast("int")).alias("centrality"), F.floor("value").cast("int").alias("bandwidth"), (2 * group.cast("int") + 401).alias("initial_bandwidth"))


def _coo(s: SparkSession, d: str) -> DataFrame:
    from ordograph.plans.storage import dense_ids, numbered

    line = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.col("l_quantity").alias("val"))
    rows = numbered(line, ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "val"], "ord")
    return rows.join(dense_ids(line, "l_suppkey", "i"), "l_suppkey").join(dense_ids(line, "l_partkey", "j"), "l_partkey").select(F.lit("coo").alias("instance"), "ord", "i", "j", "val")


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Bandwidth, full bandwidth, nodes, edges and density of each derived graph with its natural labels."""
    edges = G.tree_graph(s, d).unionByName(G.supplier_part_graph(s, d)).unionByName(G.user_graph(s, d))
    return B.full_bandwidth(edges, B.identity_labels(edges)).join(B.bandwidth(edges, B.identity_labels(edges)), ["instance", "solution"]).join(T.density(edges), "instance").drop("solution")


def _bw(name: str, make, sql: str) -> None:
    @query(name, f"with e as ({sql}) select coalesce(max(abs(u - v)), 0) bandwidth from e")
    def run(s, d):
        e = make(s, d)
        return B.bandwidth(e, B.identity_labels(e)).select("bandwidth")


for _n, _m, _s in (("bw_tree", G.tree_graph, TREE), ("bw_sp", G.supplier_part_graph, SP), ("bw_user", G.user_graph, USER), ("bw_seq", G.sequence_graph, SEQ)):
    _bw(_n, _m, _s)


@query("full_bandwidth", f"with e as ({SP}) select 2 * max(abs(u - v)) + 1 full_bandwidth from e")
def _(s, d):
    e = G.supplier_part_graph(s, d)
    return B.full_bandwidth(e, B.identity_labels(e)).select("full_bandwidth")


@query("node_bandwidth", _graph(SP) + "select src v, max(d) bandwidth from st group by src")
def _(s, d):
    e = G.supplier_part_graph(s, d)
    return B.node_bandwidth(e, _rnd(e)).select("v", "bandwidth")


@query("critical_edges", _graph(SP) + "select count(*) critical from st where d = (select max(d) from st)")
def _(s, d):
    e = G.supplier_part_graph(s, d)
    return B.critical(e, _rnd(e)).select("critical")


@query("critical_by_node", _graph(SP) + "select src v, cast(count(*) filter (where d = (select max(d) from st)) as bigint) critical from st group by src")
def _(s, d):
    e = G.supplier_part_graph(s, d)
    return B.critical(e, _rnd(e), by_node=True).select("v", "critical")


@query("critical_of_pair", _graph(USER) + "select count(*) critical from st where d = (select max(d) from st) and src in (1, (select max(v) from verts)) and not (src = (select max(v) from verts) and dst = 1)")
def _(s, d):
    e = _user(s, d)
    top = G.vertices(e).agg(F.max("v")).first()[0]
    none = s.createDataFrame([("user", "random", 0)], "instance string, solution string, critical long")
    return B.critical_of_pair(e, _rnd(e), 1, top).unionByName(none).agg(F.sum("critical").alias("critical"))


@query("hamming_rho", _graph(SP) + "select count(*) rho from rnd where v <> l")
def _(s, d):
    e = G.supplier_part_graph(s, d)
    return B.rho(B.identity_labels(e), _rnd(e)).select("rho")


@query("move_accept", _graph(USER) + ", one as (select abs(u - v) d from simple), b as (select max(d) b1, (select max(d) from st) b2 from one) select b2 < b1 or (b2 = b1 and (select count(*) from st where d = b2) < (select 2 * count(*) from one where d = b1)) or (b2 = b1 and (select count(*) from rnd where v <> l) > 10) accept from b")
def _(s, d):
    e = _user(s, d)
    return B.move(e, B.identity_labels(e), _rnd(e), 10).select("accept")


_EXT = _graph(SP) + "select src v, arg_max(dst, fd) max_vertex, max(fd) max_label, arg_min(dst, fd) min_vertex, min(fd) min_label, cast(floor((max(fd) + min(fd)) / 2.0) as int) mid from st group by src"


@query("neighbor_extremes", _EXT)
def _(s, d):
    e = G.supplier_part_graph(s, d)
    return B.neighbour_extremes(e, _rnd(e)).drop("instance", "solution")


@query("mid_value", "select v, mid from (" + _EXT + ") t")
def _(s, d):
    e = G.supplier_part_graph(s, d)
    return B.neighbour_extremes(e, _rnd(e)).select("v", "mid")


@query("mid_neighborhood", _graph(USER) + ", m as (select src, cast(floor((max(fd) + min(fd)) / 2.0) as int) mid from st group by src) select st.src v, dst near from st join m on m.src = st.src where abs(mid - fd) < abs(mid - fs)")
def _(s, d):
    e = _user(s, d)
    return B.mid_neighbours(e, _rnd(e)).select("v", "near")


@query("swap_labels", _graph(USER) + "select v, case when v = 1 then 2 when v = 2 then 1 else v end label from verts")
def _(s, d):
    return B.swapped(B.identity_labels(_user(s, d)), 1, 2).select("v", "label")


@query("relabel_edges", _graph(SEQ) + "select least(a.l, b.l) u, greatest(a.l, b.l) v from edges join rnd a on a.v = u join rnd b on b.v = edges.v")
def _(s, d):
    e = G.sequence_graph(s, d)
    return B.relabelled(e, _rnd(e)).select("u", "v")


@query("random_labels_md5", _graph(SP) + "select v, l label from rnd")
def _(s, d):
    return _rnd(G.supplier_part_graph(s, d)).select("v", "label")


@query("reversed_labels", _graph(USER) + "select v, n + 1 - v label from verts, n")
def _(s, d):
    return B.reversed_labels(B.identity_labels(_user(s, d))).select("v", "label")


@query("spy", _graph(USER) + "select distinct a.l row, b.l col from adj join rnd a on a.v = src join rnd b on b.v = dst")
def _(s, d):
    e = _user(s, d)
    return B.spy(e, _rnd(e)).select("row", "col")


def _orders(s, d):
    return table(s, d, "part").select("p_partkey", (F.col("p_size") + 2).cast("long").alias("n")).withColumn("m", F.pmod(F.col("p_partkey"), F.col("n") * (F.col("n") - 1) / 2).cast("long"))


_ORD = "with o as (select p_partkey, p_size + 2 n, p_partkey % ((p_size + 2) * (p_size + 1) // 2) m from part)"
_LB = "case when m > 0 then cast(ceil(n - (1 + sqrt(power(2 * n - 1, 2) - 8 * m)) / 2) as bigint) else 0 end"
_REF = "greatest(" + ", ".join(f"case when power(2 * n {s} 1, 2) - 8 * m >= 0 then n {t} (1 + sqrt(power(2 * n {s} 1, 2) - 8 * m)) / 2 end" for s in "-+" for t in "-+") + ")"


@query("bw_lower_bound", f"{_ORD} select p_partkey, {_LB} bound from o")
def _(s, d):
    return _orders(s, d).select("p_partkey", S.bw_lower_bound(F.col("n"), F.col("m")).alias("bound"))


@query("bw_bound_ref", f"{_ORD} select p_partkey, round({_REF}, 6) bound from o")
def _(s, d):
    return _orders(s, d).select("p_partkey", F.round(S.bw_bound_ref(F.col("n"), F.col("m")), 6).alias("bound"))


@query("reward", f"{_ORD} select p_partkey, round(-greatest(0.0, p_partkey % 50 - {_LB}) / greatest(1, n), 9) + 0.0 reward from o")
def _(s, d):
    o = _orders(s, d)
    return o.select("p_partkey", (F.round(S.bandwidth_reward((F.col("p_partkey") % 50).cast("double"), F.col("n"), S.bw_lower_bound(F.col("n"), F.col("m"))), 9) + 0.0).alias("reward"))


@query("degree", _graph(SP, DEG) + "select v, degree from deg")
def _(s, d):
    return G.degrees(G.supplier_part_graph(s, d)).select("v", "degree")


@query("degree_rank", _graph(SP, DEG) + "select v, degree, row_number() over(order by degree, v) rank from deg")
def _(s, d):
    from ordograph.plans.storage import numbered

    return numbered(G.degrees(G.supplier_part_graph(s, d)), ["degree", "v"], "rank").select("v", "degree", "rank")


@query("min_degree_vertices", _graph(SP, DEG) + "select v, degree from deg where degree = (select min(degree) from deg)")
def _(s, d):
    return T.min_degree(G.supplier_part_graph(s, d)).select("v", "degree")


@query("density", _graph(SP) + "select (select n from n) nodes, count(*) edges, 2.0 * count(*) / ((select n from n) * ((select n from n) - 1)) density from simple")
def _(s, d):
    return T.density(G.supplier_part_graph(s, d)).drop("instance")


@query("edge_node_ratio", _graph(SP) + "select cast(count(*) as double) / (select n from n) ratio from simple")
def _(s, d):
    return T.density(G.supplier_part_graph(s, d)).select((F.col("edges") / F.col("nodes")).alias("ratio"))


@query("adjacency_list", _graph(USER) + "select src v, array_to_string(list_sort(list(dst)), ',') near from sadj group by src")
def _(s, d):
    return G.neighbours(_user(s, d)).select("v", F.array_join(F.transform("near", lambda x: x.cast("string")), ",").alias("near"))


@query("closed_neighborhood", _graph(USER) + "select v, array_to_string(list_sort(list_append(list(dst), v)), ',') near from verts join sadj on src = v group by v")
def _(s, d):
    return G.neighbours(_user(s, d), closed=True).select("v", F.array_join(F.transform("near", lambda x: x.cast("string")), ",").alias("near"))


@query("simple_edges", _graph(SEQ) + "select u, v from simple")
def _(s, d):
    return G.simple(G.sequence_graph(s, d)).select("u", "v")


@query("remove_edges", _graph(USER) + "select u, v from edges where u % 2 = 1")
def _(s, d):
    e = _user(s, d)
    return G.remove_edges(e, e.filter("u % 2 = 0")).select("u", "v")


@query("induced_subgraph", _graph(SEQ) + "select u, v from edges where u % 3 = 0 and v % 3 = 0")
def _(s, d):
    e = G.sequence_graph(s, d)
    return G.induced(e, G.vertices(e).filter("v % 3 = 0")).select("u", "v")


@query("adjacent", _graph(USER) + "select v a, (v % 5) + 1 b, exists(select 1 from sadj where src = verts.v and dst = (verts.v % 5) + 1) adjacent from verts")
def _(s, d):
    e = _user(s, d)
    return G.adjacent(e, G.vertices(e).select("instance", F.col("v").alias("a"), (F.col("v") % 5 + 1).alias("b"))).drop("instance")


@query("self_loops", f"with c as ({COO}) select count(*) loops from c where i = j")
def _(s, d):
    return _coo(s, d).filter("i = j").agg(F.count("*").alias("loops"))


@query("coo_counts", f"with c as ({COO}) select count(*) entries, count(*) filter (where i = j) diagonal, count(*) filter (where i > j) below, count(*) filter (where i < j) above from c")
def _(s, d):
    return P.counts(_coo(s, d)).drop("instance")


@query("nnz_per_row", f"with c as ({COO}) select i line, count(*) nonzeros from c where val <> 0 group by i")
def _(s, d):
    return P.per_line(_coo(s, d), "i").drop("instance")


@query("nnz_per_col", f"with c as ({COO}) select j line, count(*) nonzeros from c where val <> 0 group by j")
def _(s, d):
    return P.per_line(_coo(s, d), "j").drop("instance")


@query("profile_summary", f"with c as ({COO}), l as (select i line, count(*) nonzeros from c where val <> 0 group by i) select min(nonzeros) least, arg_min(line, nonzeros * 1000000 + line) least_at, max(nonzeros) most, arg_min(line, line - nonzeros * 1000000) most_at, round(avg(nonzeros), 6) mean, round(stddev_pop(nonzeros), 6) deviation from l")
def _(s, d):
    return P.line_summary(P.per_line(_coo(s, d), "i")).drop("instance").withColumns({c: F.round(c, 6) for c in ("mean", "deviation")})


@query("profile_lower_upper", f"with c as ({COO}) select i, i - min(j) lower, max(j) - i upper from c group by i")
def _(s, d):
    return P.row_reach(_coo(s, d)).drop("instance")


@query("profile_reach_summary", f"with c as ({COO}), r as (select i - min(j) lower, max(j) - i upper from c group by i) select " + ", ".join(f"{f.format(c)} {n}_{c}" for c in ("lower", "upper") for n, f in (("min", "min({})"), ("max", "max({})"), ("avg", "round(avg({}), 6)"), ("dev", "round(stddev_pop({}), 6)"))) + " from r")
def _(s, d):
    return P.reach_summary(P.row_reach(_coo(s, d))).drop("instance").withColumns({f"{n}_{c}": F.round(f"{n}_{c}", 6) for n in ("avg", "dev") for c in ("lower", "upper")})


@query("last_values", f"with c as ({COO}) select i, j, arg_max(val, ord) val from c group by i, j")
def _(s, d):
    return P.last_values(_coo(s, d)).drop("instance")


@query("frobenius_asym", f"with c as ({COO}), a as (select i, j, arg_max(val, ord) val from c group by i, j) select round(sqrt(sum(power(coalesce(a.val, 0) - coalesce(b.val, 0), 2))), 6) asymmetry from a full join a b on a.i = b.j and a.j = b.i")
def _(s, d):
    return P.asymmetry(P.last_values(_coo(s, d))).select(F.round("asymmetry", 6).alias("asymmetry"))


@query("transpose", f"with c as ({COO}) select ord, j i, i j, val from c")
def _(s, d):
    return P.transpose(_coo(s, d)).drop("instance")


def _levels(s, d):
    e = _user(s, d)
    return e, T.bfs(e, s.createDataFrame([("user", 1)], "instance string, root int"))


@query("bfs_levels", _graph(USER, BFS) + "select v, level from lev")
def _(s, d):
    return _levels(s, d)[1].select("v", "level")


@query("level_width", _graph(USER, BFS) + "select level, count(*) width from lev group by level")
def _(s, d):
    return _levels(s, d)[1].groupBy("level").agg(F.count("*").alias("width"))


@query("eccentricity", _graph(USER, BFS) + "select max(level) eccentricity from lev")
def _(s, d):
    return _levels(s, d)[1].agg(F.max("level").alias("eccentricity"))


_COMP = ", reach(s, v) as (select v, v from verts where v <= 5 union select s, dst from reach join sadj on src = reach.v), comp as (select v, min(s) component from reach group by v)"


@query("components", _graph(TREE, _COMP) + "select v, component from comp")
def _(s, d):
    return T.components(_tree(s, d)).select("v", "component")


@query("largest_component", _graph(TREE, _COMP) + ", z as (select component, count(*) size from comp group by component) select (select count(*) from z) components, component, size from z order by size desc, component limit 1")
def _(s, d):
    return T.largest_component(_tree(s, d)).drop("instance")


@query("diameter", _graph(USER, APSP) + "select max(d) diameter from dist")
def _(s, d):
    return T.distance_counts(_kept(_user(s, d))).agg(F.max("d").alias("diameter"))


@query("aspl", _graph(USER, APSP) + "select round(sum(d) / ((select n from n) * ((select n from n) - 1.0)), 9) aspl from dist")
def _(s, d):
    return T.mean_distance(_kept(_user(s, d))).select(F.round("aspl", 9).alias("aspl"))


@query("apsp_hist", _graph(USER, APSP) + "select d, count(*) pairs from dist group by d")
def _(s, d):
    return T.distance_counts(_kept(_user(s, d))).groupBy("d").agg(F.sum(F.col("size") * F.col("n")).alias("pairs"))


@query("degree_centrality", _graph(SP, DEG) + "select v, round(degree / ((select n from n) - 1.0), 9) value from deg")
def _(s, d):
    return C.degree(G.supplier_part_graph(s, d)).select("v", F.round("value", 9).alias("value"))


@query("closeness", _graph(USER, APSP) + "select src v, round((count(*) - 1.0) / sum(d) * (count(*) - 1.0) / ((select n from n) - 1.0), 9) value from dist group by src")
def _(s, d):
    return C.closeness(_user(s, d)).select("v", F.round("value", 9).alias("value"))


@query("closeness_sampled", _graph(USER, APSP) + ", pick as (select v from verts order by md5('42:' || v), v limit 20) select verts.v, round(coalesce((select (count(*) - 1.0) / sum(d) * (count(*) - 1.0) / ((select n from n) - 1.0) from dist where src = verts.v and verts.v in (select v from pick)), 0), 9) value from verts")
def _(s, d):
    return C.closeness(_user(s, d), k=20).select("v", F.round("value", 9).alias("value"))


@query("harmonic", _graph(USER, APSP) + "select src v, round(coalesce(sum(case when d > 0 then 1.0 / d end), 0), 9) value from dist group by src")
def _(s, d):
    return C.harmonic(_user(s, d)).select("v", F.round("value", 9).alias("value"))


def _brandes(sources: str = "verts", scale: str = "1.0") -> str:
    """Pair dependencies by numbers of shortest paths, level by level."""
    ctes = ["s0 as (select v s, v, 1.0::double k from verts)"]
    for i in range(1, 7):
        ctes.append(f"s{i} as (select p.s, sadj.dst v, sum(k) k from s{i - 1} p join sadj on sadj.src = p.v join dist on dist.src = p.s and dist.dst = sadj.dst and dist.d = {i} group by p.s, sadj.dst)")
    return (
        APSP + ", " + ", ".join(ctes) + ", sig as (" + " union all ".join(f"select s, v, {i} d, k from s{i}" for i in range(7)) + f"), from_s as (select s, v, d, k from sig where s in (select v from {sources})), "
        f"dep as (select b.v, sum(b.k * e.k / t.k) x from from_s t join from_s b on b.s = t.s and b.v <> t.s and b.v <> t.v and b.d < t.d join sig e on e.s = b.v and e.v = t.v and b.d + e.d = t.d where t.v <> t.s group by b.v) "
        f"select verts.v, round(coalesce(x, 0) * {scale} / ((n - 1.0) * (n - 2.0)), 9) value from verts cross join n left join dep on dep.v = verts.v"
    )


@query("betweenness", _graph(USER).rstrip() + _brandes())
def _(s, d):
    return C.betweenness(_user(s, d)).select("v", F.round("value", 9).alias("value"))


@query("betweenness_sampled")
def _(s, d):
    return C.betweenness(_user(s, d), k=20).select("v", F.round("value", 9).alias("value"))


def _power(start: str, step: str, rounds: int = 8) -> str:
    ctes = [f"x0 as (select v, {start} x from verts)"]
    for i in range(rounds):
        ctes.append(f"y{i} as (select deg.v, (select n from n) n, sum(p.x) plain, sum(p.x / dp.degree) shared, min(o.x) old from deg join sadj on dst = deg.v join x{i} p on p.v = src join deg dp on dp.v = src join x{i} o on o.v = deg.v group by deg.v)")
        ctes.append(f"x{i + 1} as (select v, {step} x from y{i})" if "norm" not in step else f"z{i} as (select v, plain + old x from y{i}), x{i + 1} as (select v, x / (select sqrt(sum(x * x)) from z{i}) x from z{i})")
    return DEG + ", " + ", ".join(ctes)


@query("pagerank8", _graph(USER, _power("1.0 / (select n from n)", "0.85 * shared + 0.15 / n")) + "select v, round(x, 8) value from x8")
def _(s, d):
    return C.pagerank(_user(s, d), rounds=8, tol=None).select("v", F.round("value", 8).alias("value"))


@query("katz8", _graph(USER, _power("0.0::double", "0.005::double * plain + 1.0")) + "select v, round(x / (select sqrt(sum(x * x)) from x8), 8) value from x8")
def _(s, d):
    return C.katz(_user(s, d), rounds=8, tol=None).select("v", F.round("value", 8).alias("value"))


@query("eigenvector8", _graph(USER, _power("1 / sqrt((select n from n))", "norm")) + "select v, round(x, 8) value from x8")
def _(s, d):
    return C.eigenvector(_user(s, d), rounds=8, tol=None).select("v", F.round("value", 8).alias("value"))


@query("start_vertex", _graph(SP, DEG) + "select (select v from deg order by degree desc, v limit 1) biggest, (select v from deg order by degree, v limit 1) smallest")
def _(s, d):
    v = C.degree(G.supplier_part_graph(s, d))
    return C.extreme_vertex(v).withColumnRenamed("v", "biggest").join(C.extreme_vertex(v, False).withColumnRenamed("v", "smallest"), "instance").drop("instance")


_LEV = BFS + DEG + ", t as (select lev.v, level, degree / ((select n from n) - 1.0) value from lev join deg on deg.v = lev.v)"


def _level_table(s, d):
    e, lev = _levels(s, d)
    return lev.select("instance", F.lit(0).alias("attempt"), "v", "level").join(C.degree(e), ["instance", "v"])


@query("lcr_split", _graph(USER, _LEV) + "select v, row_number() over(partition by level order by value desc, v) <= floor(count(*) over(partition by level) * 0.3) in_list from t")
def _(s, d):
    return K.split_list(_level_table(s, d), 0.3).select("v", "in_list")


@query("lcr_threshold", _graph(USER, _LEV) + "select v from (select v, value, max(value) over(partition by level) hi, min(value) over(partition by level) lo from t) x where value <= hi + 0.4 * (lo - hi)")
def _(s, d):
    return K.threshold_list(_level_table(s, d), 0.4).select("v")


@query("lcr_topk", _graph(USER, _LEV) + "select v from (select v, row_number() over(partition by level order by value desc, v) k, count(*) over(partition by level) c from t) x where k <= greatest(1, floor(c * 0.3))")
def _(s, d):
    return K.top_list(_level_table(s, d), 0.3).select("v")


_U = "(('0x' || substr(md5({}), 1, 13))::bigint / 4503599627370496.0)"


@query("lcr_score", _graph(USER, _LEV) + f"select v, round(0.7 * value + 0.3 * {_U.format(chr(39) + '5:0:' + chr(39) + ' || v')}, 9) score from t")
def _(s, d):
    return K.scored_list(_level_table(s, d), 0.3, 5).select("v", F.round("score", 9).alias("score"))


@query("level_labeling", _graph(USER, _LEV) + "select v, row_number() over(order by level, value desc, v) label from t")
def _(s, d):
    return K.level_labels(_level_table(s, d)).select("v", "label")


@query("level_rotation", _graph(USER, _LEV) + f", r as (select v, level, row_number() over(partition by level order by v) - 1 pos, count(*) over(partition by level) w from t) select v, row_number() over(order by level, ((pos - cast(floor({_U.format(chr(39) + '3:0:' + chr(39) + ' || level')} * w) as bigint)) % w + w) % w, v) label from r")
def _(s, d):
    return K.rotated_labels(_level_table(s, d), 3).select("v", "label")


@query("lcr_labeling", _graph(USER, _LEV) + ", f as (select v, level, row_number() over(partition by level order by value desc, v) <= floor(count(*) over(partition by level) * 0.3) i from t) select v, row_number() over(order by level, i desc, md5('1:0:' || v), v) label from f")
def _(s, d):
    return K.list_labels(_level_table(s, d), 0.3, 1).select("v", "label")


@query("roulette_root", _graph(USER, DEG) + f", c as (select v, sum(degree) over(order by v) cum from deg), a as (select unnest(range(4)) attempt), p as (select attempt, {_U.format(chr(39) + '9:' + chr(39) + ' || attempt')} * (select sum(degree) from deg) due from a) select attempt, min(v) root from c join p on cum > due group by attempt")
def _(s, d):
    v = G.degrees(_user(s, d)).select("instance", "v", F.col("degree").cast("double").alias("value"))
    return K.roulette_roots(v, 4, 9).select("attempt", "root")


@query("best_attempts")
def _(s, d):
    e = _user(s, d)
    return K.best_attempts(e, C.degree(e))[1].select("solution", "bandwidth")


@query("random_level_search")
def _(s, d):
    e = _user(s, d)
    return B.bandwidth(e, K.random_level_search(e)).select("bandwidth")


def _ordered(name: str, make) -> None:
    @query(name)
    def run(s, d):
        return make(_user(s, d))


for _n, _m in (("cuthill_mckee", O.cuthill_mckee), ("reverse_cuthill_mckee", lambda e: O.cuthill_mckee(e, reverse=True)), ("george_liu", O.george_liu), ("gps_pair", O.gps_pair), ("hill_climb", O.hill_climb), ("vns", O.vns), ("connectivity", T.connectivity), ("percolation", C.percolation), ("current_flow_betweenness", C.current_flow_betweenness), ("q_learning", L.attempt_log)):
    _ordered(_n, _m)


@query("state_bins_fixed", "select p_partkey, case when p_size % 25 = 0 then 0 when p_size % 25 <= 2 then 1 when p_size % 25 <= 5 then 2 when p_size % 25 <= 10 then 3 when p_size % 25 <= 20 then 4 else 5 end level, case when p_size / 50.0 <= 0.1 then 0 when p_size / 50.0 <= 0.25 then 1 when p_size / 50.0 <= 0.5 then 2 when p_size / 50.0 <= 0.75 then 3 else 4 end share from part")
def _(s, d):
    a, b = S.state_bins_fixed(F.col("p_size") % 25, F.col("p_size") / 50.0)
    return table(s, d, "part").select("p_partkey", a.alias("level"), b.alias("share"))


@query("state_bins_equiwidth", "select p_partkey, case when p_size = 0 then 0 else least(5, cast(ceil(p_size * 5 / 50.0) as int)) end level, greatest(0, least(4, cast(ceil((p_size % 10) / 10.0 * 5) as int) - 1)) share from part")
def _(s, d):
    a, b = S.state_bins_equal(F.col("p_size"), F.lit(50), F.col("p_size") % 10 / 10.0)
    return table(s, d, "part").select("p_partkey", a.alias("level"), b.alias("share"))


@query("reward_step", "select p_partkey, case when p_size <= 10 and p_size <= p_partkey % 50 then 10 when p_size <= p_partkey % 50 then 5 else -2 end reward from part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", S.step_reward(F.col("p_size"), F.lit(10), F.col("p_partkey") % 50).alias("reward"))


@query("eps_decay", "select unnest(range(30)) episode, round(greatest(0.01, power(0.995, unnest(range(30)))), 9) eps")
def _(s, d):
    return s.range(30).select(F.col("id").alias("episode"), F.round(F.greatest(F.lit(0.01), F.pow(F.lit(0.995), F.col("id"))), 9).alias("eps"))


_GRID = "select * from (values (10), (20), (30)) a(episodes), (values (0.1), (0.5)) b(lr), (values (0.9), (0.99)) c(gamma), (values (0.5), (1.0)) e(eps), (values (0.9), (0.99)) f(eps_decay)"


@query("param_grid", "select episodes, cast(lr as double) lr, cast(gamma as double) gamma, cast(eps as double) eps, cast(eps_decay as double) eps_decay from (" + _GRID + ") g")
def _(s, d):
    return L.parameter_grid(s).drop("param_id")


@query("top3_params")
def _(s, d):
    return L.grid_search(_user(s, d), L.parameter_grid(s, L.REFERENCE_GRID)).orderBy("bandwidth", "param_id").limit(3)


def _r(sql: str) -> str:
    return f"with r as ({RUNS}), best as (select instance, min(bandwidth) b from r group by instance), top as (select r.* from r join best on best.instance = r.instance and b = bandwidth), f as (select instance, min(run_id) run_id from top group by instance) {sql}"


@query("runs_project", _r("select run_id, instance, centrality, bandwidth from r where instance = 'inst_3'"))
def _(s, d):
    return _runs(s, d).filter("instance = 'inst_3'").select("run_id", "instance", "centrality", "bandwidth")


@query("runs_distinct", _r("select distinct instance, centrality from r"))
def _(s, d):
    return _runs(s, d).select("instance", "centrality").distinct()


@query("runs_abbreviated", _r("select run_id, list_extract(['DC','CC','BC','EC','KC','PR','HC'], cast(run_id % 7 as int) + 1) short, cast(run_id % 7 as int) ordinal from r"))
def _(s, d):
    return A.abbreviated(_runs(s, d)).select("run_id", "short", "ordinal")


@query("runs_best_ties", _r("select * from top"))
def _(s, d):
    return A.best_with_ties(_runs(s, d)).select("run_id", "instance", "episode", "attempt", "centrality", "bandwidth", "initial_bandwidth")


@query("runs_keep_first", _r("select instance, run_id from f"))
def _(s, d):
    return A.keep_first(_runs(s, d)).select("instance", "run_id")


@query("runs_repeated", _r("select instance, count(*) n from top group by instance having count(*) > 1"))
def _(s, d):
    return A.repeated(_runs(s, d))


@query("runs_freq", _r("select instance, centrality, count(*) n from top group by all"))
def _(s, d):
    return A.frequency(_runs(s, d))


@query("runs_freq_zero_fill", _r("select i.instance, c.centrality, count(top.run_id) n from (select distinct instance from r) i cross join (select distinct centrality from r) c left join top on top.instance = i.instance and top.centrality = c.centrality group by all"))
def _(s, d):
    return A.frequency(_runs(s, d), zero_fill=True)


@query("runs_decay", _r("select r.instance, initial_bandwidth, bandwidth final, round_even(100.0 * (initial_bandwidth - bandwidth) / initial_bandwidth, 2) decay_pct_ref, round_even(100.0 * ((initial_bandwidth - 1) / 2.0 - bandwidth) / ((initial_bandwidth - 1) / 2.0), 2) decay_pct from r join f on f.run_id = r.run_id"))
def _(s, d):
    return A.decay(_runs(s, d))


@query("decay_pct", "select p_partkey, round_even(100.0 * (p_retailprice - p_size) / p_retailprice, 2) decay from part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", S.decay_pct(F.col("p_retailprice"), F.col("p_size")).alias("decay"))


_Q = "q as (select list_distinct(list_transform(quantile_cont(bandwidth, [0, 0.2, 0.4, 0.6, 0.8, 1]), lambda x: round(x, 9))) e from r), es as (select list_sort(e) e from q), bins as (select run_id, greatest(1, len(list_filter(e, lambda x: x < bandwidth))) bin, e from r, es)"


@query("runs_quintiles", _r(", " + _Q + " select run_id, bin, list_extract(e, bin) lo, list_extract(e, bin + 1) hi from bins").replace(")  ,", "), "))
def _(s, d):
    return A.binned(_runs(s, d), "bandwidth").select("run_id", "bin", "lo", "hi")


@query("runs_bin_counts", _r(", " + _Q + ", every as (select unnest(range(1, len(e))) bin from es) select every.bin, count(run_id) n from every left join bins on bins.bin = every.bin group by every.bin"))
def _(s, d):
    return A.bin_counts(_runs(s, d), "bandwidth")


@query("runs_violin", _r("select instance, centrality, cast(min(bandwidth) as double) lowest, quantile_cont(bandwidth, 0.25) q1, quantile_cont(bandwidth, 0.5) median, quantile_cont(bandwidth, 0.75) q3, cast(max(bandwidth) as double) highest, round(avg(bandwidth), 6) mean, round(stddev_samp(bandwidth), 6) sd, count(*) n from r group by instance, centrality"))
def _(s, d):
    return A.violin(_runs(s, d)).withColumns({c: F.round(c, 6) for c in ("mean", "sd")})


@query("runs_metric_mean", _r("select round(avg(bandwidth), 6) mean from r"))
def _(s, d):
    return _runs(s, d).agg(F.round(F.avg("bandwidth"), 6).alias("mean"))


@query("runs_corr", _r("select round(corr(bandwidth, initial_bandwidth), 6) corr from r"))
def _(s, d):
    return _runs(s, d).agg(F.round(F.corr("bandwidth", "initial_bandwidth"), 6).alias("corr"))


@query("runs_recommend", "select p_partkey, case when p_size % 3 > 1 then 'Harmonic Centrality' when p_size / 100.0 >= 0.1 then 'Katz Centrality' when p_size > 30 or p_size / 4.0 > 11 then 'Degree' when p_size / 100.0 < 0.01 then 'PageRank' else 'Closeness' end advice from part")
def _(s, d):
    size = F.col("p_size")
    return table(s, d, "part").select("p_partkey", S.recommended_centrality(size / 100.0, size, size / 4.0, size % 3).alias("advice"))


@query("runs_first_values", _r("select instance, arg_min(initial_bandwidth, run_id) initial_bandwidth, arg_min(episode, run_id) episode from r group by instance"))
def _(s, d):
    return A.first_values(_runs(s, d), ["initial_bandwidth", "episode"])


@query("pivot_loops", _r("select instance, " + ", ".join(f"min(bandwidth) filter (where attempt = {i}) band{i}" for i in range(3)) + " from r where attempt < 3 group by instance"))
def _(s, d):
    return A.pivoted(_runs(s, d))


@query("cumulative_score", _r("select run_id, sum(bandwidth) over(partition by instance order by run_id) score from r"))
def _(s, d):
    r = _runs(s, d).select("run_id", "instance", F.col("run_id").alias("episode"), F.col("bandwidth").alias("reward"))
    return A.cumulative_score(r).select("run_id", "score")


@query("random_connected", "with c as (select cast(unnest(range(1, 50)) as int) u), m as (select cast(unnest(range(25)) as int) k), e as (select cast(floor((('0x' || substr(md5('1:a:' || k), 1, 13))::bigint / 4503599627370496.0) * 50) + 1 as int) a, cast(floor((('0x' || substr(md5('1:b:' || k), 1, 13))::bigint / 4503599627370496.0) * 50) + 1 as int) b from m) select u, u + 1 v from c union all select least(a, b), greatest(a, b) from e where a <> b")
def _(s, d):
    return G.random_connected(s, 50).select("u", "v")


@query("topology", None)
def _(s, d):
    return T.topology(_user(s, d), with_connectivity=True)


def _folder(s: SparkSession, name: str) -> str:
    return f"{shared_folder(s)}/ordograph/{name}-{uuid.uuid4().hex}"


def _as_file(s: SparkSession, d: str) -> str:
    path = _folder(s, "matrix")
    coo = numbered(_user(s, d), ["u", "v"], "ord").select("ord", F.col("u").alias("i"), F.col("v").alias("j"))
    n = G.vertices(_user(s, d)).count()
    M.write_matrix_market(coo, path, n, n, "pattern", "symmetric")
    return path


@query("mtx_scan", f"select 'pattern' field, 'symmetric' symmetry, (select count(distinct v) from (select u v from ({USER}) union all select v from ({USER}))) nrows, u i, v j, row_number() over(order by u, v) ord from ({USER}) e")
def _(s, d):
    path = _as_file(s, d)
    head = M.headers(M.lines(s, path, "*.txt")).filter("valid").select("path", "field", "symmetry", F.col("nrows").cast("long").alias("nrows"))
    return M.read_coo(s, path, "*.txt").join(head, "path").select("field", "symmetry", "nrows", "i", "j", "ord")


@query("mtx_initial_bandwidth", f"with e as (select u, v, row_number() over(order by u, v) o from ({USER})), a as (select u x, 2 * o k from e union all select v, 2 * o + 1 from e), p as (select x, row_number() over(order by min(k)) pos from a group by x) select cast(max(abs(a.pos - b.pos)) * 2 + 1 as int) full_bandwidth from e join p a on a.x = u join p b on b.x = v")
def _(s, d):
    e = written(G.edges_of(M.read_coo(s, _as_file(s, d), "*.txt")), "scanned")
    labels = G.insertion_order(e).select(F.col("path").alias("instance"), F.lit("file").alias("solution"), "v", (F.col("pos") + 1).alias("label"))
    own = e.select(F.col("path").alias("instance"), "u", "v")
    return B.full_bandwidth(own, labels).select(F.col("full_bandwidth").cast("int").alias("full_bandwidth"))


@query("edge_list_file", f"with e as ({USER}), x as (select 'v' || u a, 'v' || v b from e), i as (select a, row_number() over(order by a) id from (select a from x union select b from x)) select least(p.id, q.id) u, greatest(p.id, q.id) v from x join i p on p.a = x.a join i q on q.a = x.b")
def _(s, d):
    path = _folder(s, "edge-list")
    _user(s, d).select(F.concat(F.lit("v"), "u", F.lit(" v"), "v")).write.text(path)
    return M.with_ids(M.read_edge_list(s, path))


@query("adjacency_list_file", f"with e as ({USER}) select cast(u as varchar) a, cast(v as varchar) b from e union all select cast(v as varchar), cast(u as varchar) from e")
def _(s, d):
    path = _folder(s, "adjacency-list")
    G.neighbours(_user(s, d)).select(F.concat_ws(" ", F.col("v").cast("string"), F.col("near").cast("array<string>"))).write.text(path)
    return M.read_adjacency_list(s, path)


def _log_file(form: str) -> None:
    @query(f"run_log_{form}", _r("select run_id, instance, episode, attempt, centrality, bandwidth, initial_bandwidth from r"))
    def run(s, d):
        path = _folder(s, "runs")
        r = _runs(s, d).withColumns({"local_time": F.lit(0.0), "global_time": F.lit(0.0)})
        M.write_runs(r.select(*[c.split()[0] for c in M.RUNS.split(", ")]), path, form)
        return M.read_runs(s, path, format=form).select("run_id", "instance", "episode", "attempt", "centrality", "bandwidth", "initial_bandwidth")


for _form in ("json", "csv", "parquet"):
    _log_file(_form)


@query("runs_pending", _r("select 'inst_' || k instance from (select unnest(range(50)) k) where 'inst_' || k not in (select instance from r)"))
def _(s, d):
    every = s.range(50).select(F.concat(F.lit("inst_"), F.col("id").cast("string")).alias("instance"))
    return A.pending(every, _runs(s, d))


_OWN = "own as (select distinct 'inst_' || cast(user_id % 40 as varchar) instance, cast(user_id + 1 as int) u, 100000 + length(event_type) v from events), topo as (select instance, (count(distinct u) + count(distinct v)) nodes, count(*) edges from own group by instance)"


@query("runs_enriched", _r(", " + _OWN + " select run_id, r.instance, bandwidth, nodes, edges, round(2.0 * edges / (nodes * (nodes - 1)), 9) density from r left join topo on topo.instance = r.instance").replace(") , own", "), own"))
def _(s, d):
    own = table(s, d, "events").select(F.concat(F.lit("inst_"), (F.col("user_id") % 40).cast("string")).alias("instance"), (F.col("user_id") + 1).cast("int").alias("u"), (F.length("event_type") + 100000).alias("v"))
    topology = T.density(G.simple(own)).withColumn("density", F.round("density", 9))
    return A.enriched(A.ordered_columns(_runs(s, d).select("bandwidth", "run_id", "instance"), ["run_id", "instance"]), topology)


@query("runs_compared", _r(", w as (select instance, string_agg(c, ', ' order by c) wins from (select instance, centrality || ':' || count(*) c from top group by instance, centrality) group by instance) select r.instance, arg_min(initial_bandwidth, run_id) initial_bandwidth, min(bandwidth) best, max(bandwidth) worst, round(avg(bandwidth), 6) mean, any_value(wins) wins from r join w on w.instance = r.instance group by r.instance").replace(") , w", "), w"))
def _(s, d):
    return A.compared(_runs(s, d))


@query("transitivity", _graph(SEQ, DEG) + ", t as (select count(*) triangles from simple a join simple b on a.v = b.u join simple c on c.u = a.u and c.v = b.v), k as (select cast(sum(degree * (degree - 1) / 2) as bigint) triads from deg) select triangles, triads, round(3.0 * triangles / triads, 9) transitivity from t, k")
def _(s, d):
    return G.transitivity(G.sequence_graph(s, d)).select("triangles", "triads", F.round("transitivity", 9).alias("transitivity"))


@query("degree_order", _graph(TREE, _COMP + DEG) + "select component, comp.v, row_number() over(partition by component order by degree, comp.v) place from comp join deg on deg.v = comp.v")
def _(s, d):
    return T.degree_order(_tree(s, d)).select("component", "v", "place")


def queries() -> dict:
    return {name: f for name, (f, _) in _made.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _made.items() if sql}
