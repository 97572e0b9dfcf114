"""Driver queries: every operator over whole tables, mapped to a graph where it needs one, and the SQL each must equal.

Nodes are region:k, nation:k, customer:k, supplier:k and part:k; edges are
contains (region, nation, customer and supplier), calls (customer to part, by
what was ordered) and imports (supplier to part).  Operators on source code run
over the small programs in SOURCES, with their expected rows as VALUES.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import resolve_units
from .cluster import spread
from .functions import text as tx
from .operators import diff, graph, mro, resolve, rules, search, temporal
from .plans.query import run, with_joins
from .sources import frameworks, python_source
from .streaming import incremental

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- the graph ---------------------------------------------------------------------------------------------------------
def nodes(spark: SparkSession, d: str) -> DataFrame:
    def of(name, key, label):
        return table(spark, d, name).select(F.concat(F.lit(f"{name}:"), F.col(key)).alias("id"), F.lit(name).alias("kind"), F.col(label).alias("name"))

    return reduce(lambda a, b: a.unionByName(b), [of("region", "r_regionkey", "r_name"), of("nation", "n_nationkey", "n_name"), of("customer", "c_custkey", "c_name"), of("supplier", "s_suppkey", "s_name"), of("part", "p_partkey", "p_name")])


def contains_edges(spark: SparkSession, d: str) -> DataFrame:
    n, c, s = (table(spark, d, t) for t in ("nation", "customer", "supplier"))
    pair = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), F.col(x)).alias("src"), F.concat(F.lit(b), F.col(y)).alias("dst"), F.lit("contains").alias("kind"))
    return pair(n, "region:", "n_regionkey", "nation:", "n_nationkey").unionByName(pair(c, "nation:", "c_nationkey", "customer:", "c_custkey")).unionByName(pair(s, "nation:", "s_nationkey", "supplier:", "s_suppkey"))


# Pairs are spread by their part alone: a part is then counted in one task, not once in each.
def call_edges(spark: SparkSession, d: str) -> DataFrame:
    o, li = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    rows = li.count()
    ordered = spread(o, rows, "o_orderkey").join(spread(li, rows, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    pairs = spread(ordered.select("o_custkey", "l_partkey"), rows, "l_partkey").distinct()
    return pairs.select(F.concat(F.lit("customer:"), "o_custkey").alias("src"), F.concat(F.lit("part:"), "l_partkey").alias("dst"), F.lit("calls").alias("kind"))


def import_edges(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    pairs = spread(li, li.count(), "l_partkey").distinct()
    return pairs.select(F.concat(F.lit("supplier:"), "l_suppkey").alias("src"), F.concat(F.lit("part:"), "l_partkey").alias("dst"), F.lit("imports").alias("kind"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return contains_edges(spark, d).unionByName(call_edges(spark, d)).unionByName(import_edges(spark, d))


def parts(spark: SparkSession, d: str):
    """The functions view: parts, and the number of customers that call them where a query reads it."""
    p = table(spark, d, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_retailprice").alias("price"))

    def callers():
        ordered = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
        return ordered.groupBy(F.concat(F.lit("part:"), "l_partkey").alias("id")).agg(F.count_distinct("o_custkey").alias("caller_count"))

    return lambda names: with_joins(p, names, [(["id"], ("caller_count",), callers, 0)])


_CONTAINS = """c as (select 'region:' || n_regionkey as src, 'nation:' || n_nationkey as dst, 'contains' as kind from nation union all
  select 'nation:' || c_nationkey, 'customer:' || c_custkey, 'contains' from customer union all select 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'contains' from supplier)"""
_EDGES = f"""{_CONTAINS}, k as (select distinct 'customer:' || o_custkey as src, 'part:' || l_partkey as dst, 'calls' as kind from orders join lineitem on o_orderkey = l_orderkey),
i as (select distinct 'supplier:' || l_suppkey as src, 'part:' || l_partkey as dst, 'imports' as kind from lineitem), e as (select * from c union all select * from k union all select * from i)"""
_PARTS = """f as (select 'part:' || p_partkey as id, p_name as name, p_size as size, p_brand as brand, p_type as type, p_retailprice as price, coalesce(n, 0) as caller_count
  from part left join (select l_partkey, count(distinct o_custkey) as n from orders join lineitem on o_orderkey = l_orderkey group by 1) on l_partkey = p_partkey)"""

FLAGSHIP = "functions select id, name, caller_count where caller_count > 3 and name contains 'ring' order by caller_count desc limit 10"


@query("ql_flagship", f"with {_PARTS} select id, name, caller_count from f where caller_count > 3 and contains(name, 'ring') order by caller_count desc, id limit 10")
def ql_flagship(spark, d):
    return run(FLAGSHIP, {"functions": parts(spark, d)})


# -- query language ----------------------------------------------------------------------------------------------------
@query("ql_filter_project", f"with {_PARTS} select id, name, size from f where size > 20 and contains(name, 'ring')")
def ql_filter_project(spark, d):
    return run("functions select id, name, size where size > 20 and name contains 'ring'", {"functions": parts(spark, d)})


@query("ql_select_all", "select 'part:' || p_partkey as id, p_name as name, p_size as size from part where p_retailprice >= 950.5 and p_retailprice != 951")
def ql_select_all(spark, d):
    view = table(spark, d, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    return run("functions where price >= 950.5 and price != 951 -- a comment", {"functions": view}).drop("price")


@query("ql_not_or_null", "select d.doc_id, lang from documents d left join labels l on d.doc_id = l.doc_id where not coalesce(quality = 1, false) or coalesce(lang = 'de', false)")
def ql_not_or_null(spark, d):
    view = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return run("modules select doc_id, lang where not quality == 1 or lang == 'de'", {"modules": view}, "doc_id")


@query("ql_null_literal", "select d.doc_id, quality is null as open from documents d left join labels l on d.doc_id = l.doc_id where (quality is null or toxic = 1) and lang <> 'en'")
def ql_null_literal(spark, d):
    view = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left").withColumn("open", F.col("quality").isNull())
    return run("modules select doc_id, open where (quality == null or toxic == 1) and lang != 'en' and not missing_column == 3", {"modules": view}, "doc_id")


@query("ql_in_list", "select 'part:' || p_partkey as id, p_size as size from part where p_size in (1, 7, 49) and p_brand not in ('Brand#1', 'Brand#2')")
def ql_in_list(spark, d):
    return run("functions select id, size where size in [1, 7, 49] and not brand in ['Brand#1', 'Brand#2']", {"functions": parts(spark, d)})


@query("ql_matches", "select 'part:' || p_partkey as id, p_name as name from part where regexp_matches(p_name, '^(red|blue) [a-m].*')")
def ql_matches(spark, d):
    return run("functions select id, name where name matches '^(red|blue) [a-m].*'", {"functions": parts(spark, d)})


@query("ql_order_limit", "select 'customer:' || c_custkey as id, c_acctbal as acctbal from customer order by c_acctbal desc, 'customer:' || c_custkey limit 25")
def ql_order_limit(spark, d):
    view = table(spark, d, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("id"), F.col("c_acctbal").alias("acctbal"))
    return run("classes select id, acctbal order by acctbal desc limit 25", {"classes": view})


def _orders_view(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))


@query("ql_group_agg", "select o_orderpriority as priority, count(*) as n, round(sum(o_totalprice), 2) as total, round(avg(o_totalprice), 4) as mean from orders where o_orderstatus = 'F' group by 1")
def ql_group_agg(spark, d):
    out = run("calls select priority, count(*) as n, sum(price) as total, avg(price) as mean where status == 'F' group by priority order by n desc", {"calls": _orders_view(spark, d)})
    return out.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4)})


@query("ql_global_agg", "select count(*) as n, min(o_totalprice) as low, max(o_totalprice) as high from orders")
def ql_global_agg(spark, d):
    return run("calls select count(*) as n, min(price) as low, max(price) as high", {"calls": _orders_view(spark, d)})


@query("ql_loose_path", "select min(o_orderstatus) as status, count(*) as n from orders group by o_orderpriority")
def ql_loose_path(spark, d):
    return run("calls select status, count(*) as n group by priority", {"calls": _orders_view(spark, d)})


@query("ql_list_predicates", """with p as (select o_custkey, list(distinct o_orderpriority) as priorities from orders group by 1), m as (select c_custkey, c_name, r_name, priorities from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey join p on o_custkey = c_custkey)
select c_custkey as id, c_name as name from m where (list_contains(priorities, '1-URGENT') or len(list_filter(priorities, lambda x: contains(x, 'LOW'))) > 0) and r_name = 'ASIA'""")
def ql_list_predicates(spark, d):
    own = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("o_orderpriority").alias("method_names"))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    view = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.array("n_name", "r_name").alias("mro_names")).join(own, "id")
    return run('classes select id, name where (has_method("1-URGENT") or method_names contains "LOW") and inherits_from("ASIA") == true', {"classes": view})


# -- joins hidden in resolution ----------------------------------------------------------------------------------------
@query("degree_counts", f"with {_EDGES}, u as (select distinct src, dst from k), a as (select dst as id, count(*) as n from u group by 1), b as (select src as id, count(*) as n from u group by 1) select coalesce(a.id, b.id) as id, coalesce(a.n, 0) as caller_count, coalesce(b.n, 0) as callee_count from a full join b on a.id = b.id")
def degree_counts(spark, d):
    return graph.degrees(call_edges(spark, d)).select("id", "caller_count", "callee_count")


@query("group_join_methods", "select n_name as name, count(*) as n, string_agg(c_name, ',' order by c_name) as members from nation join customer on c_nationkey = n_nationkey group by 1")
def group_join_methods(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("c_name")), ",").alias("members"))
    return table(spark, d, "nation").join(c, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"), "n", "members")


@query("tier_cascade", """with s as (select s_suppkey, s_nationkey, n_regionkey from supplier join nation on s_nationkey = n_nationkey where s_acctbal > 8000), a as (select s_nationkey, min(s_suppkey) as k from s group by 1), b as (select n_regionkey, min(s_suppkey) as k from s group by 1)
select c_custkey, coalesce(a.k, b.k, (select min(s_suppkey) from s)) as suppkey, case when a.k is not null then 1 when b.k is not null then 2 else 3 end as tier
from customer join nation n on c_nationkey = n_nationkey left join a on a.s_nationkey = c_nationkey left join b on b.n_regionkey = n.n_regionkey""")
def tier_cascade(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    s = table(spark, d, "supplier").where("s_acctbal > 8000").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    near, far, any_ = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("a")), s.groupBy(F.col("n_regionkey").alias("r")).agg(F.min("s_suppkey").alias("b")), s.agg(F.min("s_suppkey").alias("c"))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    out = c.join(near, F.col("c_nationkey") == F.col("s_nationkey"), "left").join(far, F.col("n_regionkey") == F.col("r"), "left").crossJoin(any_)
    return out.select("c_custkey", F.coalesce("a", "b", "c").alias("suppkey"), F.when(F.col("a").isNotNull(), 1).when(F.col("b").isNotNull(), 2).otherwise(3).alias("tier"))


@query("first_in_order", "select o_custkey, o_orderpriority, arg_min(o_orderkey, (o_orderdate, o_orderkey)) as first_order from orders group by 1, 2")
def first_in_order(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))


_SUFFIXES = ("small.ring", "ring", "hot.gizmo", "none.gizmo", "no.such.name")


@query("suffix_match")
def suffix_match(spark, d):
    # one module a name: the part with the lowest key
    m = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id")).select("id", F.concat(F.translate("p_name", " ", "/"), F.lit(".py")).alias("path"))
    w = spark.createDataFrame([(s, s) for s in _SUFFIXES], "key string, dotted string")
    return resolve.longest_suffix(w, m)


SQL["suffix_match"] = f"""with w(key) as (values {", ".join(f"('{s}')" for s in _SUFFIXES)}), t as (select key, i as cut, array_to_string(list_slice(string_split(key, '.'), i, 9), '/') as tail from (select key, unnest(range(1, len(string_split(key, '.')) + 1)) as i from w)),
m as (select min(p_partkey) as id, replace(p_name, ' ', '/') as bare from part group by p_name), r as (select key, id, row_number() over (partition by key order by cut, length(bare), bare) as n from t join m on bare = tail or suffix(bare, '/' || tail))
select key, id as module_id from r where n = 1"""

_WANTED = (("a", "red bolt", 3, "Brand#1/SMALL/x.py"), ("b", "hot gizmo", 1, "Brand#2/ECONOMY/y.py"), ("c", "nothing", 1, "z.py"), ("d", "small ring", 0, "z/q.py"))


@query("score_match", f"""with w(key, name, arity, path) as (values {", ".join(map(str, _WANTED))}), p as (select p_partkey, p_name, p_size % 6 as np, p_brand, p_type, count(*) over (partition by p_name) as n from part),
s as (select key, p_partkey, 0.4 + 0.3 * case when arity = np then 1.0 else greatest(0.0, 1.0 - abs(arity - np) / greatest(arity, np, 1)::double) end + 0.3 * case
  when string_split(path, '/')[1] = p_brand and string_split(path, '/')[2] = p_type and len(string_split(path, '/')) = 3 then 1.0 when string_split(path, '/')[1] = p_brand and len(string_split(path, '/')) > 1 then 0.3 + 0.3 * 1 / 2 else 0.1 end as score
  from w join p on p_name = name where n <= 500), r as (select *, row_number() over (partition by key order by round(score, 9) desc, 'part:' || p_partkey) as place from s where score >= 0.5)
select key, 'part:' || p_partkey as target, round(score, 6) as score from r where place = 1""")
def score_match(spark, d):
    f = table(spark, d, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.expr("array_repeat(1, p_size % 6)").alias("parameters"), F.concat_ws("/", "p_brand", "p_type", F.lit("f.py")).alias("path"))
    w = spark.createDataFrame(list(_WANTED), "key string, name string, arity int, path string")
    return resolve.signature_matches(w, f).select("key", "target", F.round("score", 6).alias("score"))


@query("semi_coverage", f"with {_EDGES.replace(' as (', ' as materialized (')}, s as materialized (select distinct src as known from e) select src, dst, kind from e semi join s on dst = known")
def semi_coverage(spark, d):
    return resolve.covered(edges(spark, d))


# -- graph -------------------------------------------------------------------------------------------------------------
def _walk_sql(start: str, depth: int, rel: str, step: str) -> str:
    return f"with recursive {_EDGES}, s as ({step}), r(id, depth) as (select '{start}', 0 union select s.dst, r.depth + 1 from r join s on s.src = r.id where r.depth < {depth}) {rel}"


_DOWN = "select src, dst from e where kind in ('calls', 'contains')"
_REACHED = "select id, min(depth) as depth from r group by id"


@query("bfs_down", _walk_sql("region:0", 3, _REACHED, _DOWN))
def bfs_down(spark, d):
    return graph.traverse(edges(spark, d), "region:0", 3, ["contains", "calls"], "downstream", nodes(spark, d)).select("id", "depth")


@query("bfs_up", _walk_sql("part:1", 3, _REACHED, "select dst as src, src as dst from e where kind in ('calls', 'contains', 'imports')"))
def bfs_up(spark, d):
    return graph.traverse(edges(spark, d), "part:1", 3, ["contains", "calls", "imports"], "upstream").select("id", "depth")


@query("bfs_both", _walk_sql("nation:3", 3, _REACHED, "select src, dst from c union all select dst, src from c"))
def bfs_both(spark, d):
    return graph.traverse(contains_edges(spark, d), "nation:3", 3, ["contains"], "both").select("id", "depth")


@query("bfs_edge_kind", _walk_sql("nation:3", 2, ", m as (select id, min(depth) as depth from r group by id) select m.id, m.depth, coalesce((select min(e.kind) from e join m p on p.id = e.src and p.depth = m.depth - 1 where e.dst = m.id and e.kind in ('calls', 'contains', 'imports') and e.src = (select min(q.src) from e q join m p2 on p2.id = q.src and p2.depth = m.depth - 1 where q.dst = m.id)), '') as edge_type from m", "select src, dst from e").replace("where r.depth < 2) ,", "where r.depth < 2),"))
def bfs_edge_kind(spark, d):
    return graph.traverse(edges(spark, d), "nation:3", 2, ["contains", "calls", "imports"])


@query("depth_histogram", _walk_sql("region:1", 3, "select depth, count(*) as n from (select id, min(depth) as depth from r group by id) group by depth", _DOWN))
def depth_histogram(spark, d):
    return graph.traverse(edges(spark, d), "region:1", 3, ["contains", "calls"]).groupBy("depth").agg(F.count("*").alias("n"))


@query("closure_all_regions", f"with recursive {_CONTAINS}, r(root, id, depth) as (select 'region:' || r_regionkey, 'region:' || r_regionkey, 0 from region union select r.root, c.dst, r.depth + 1 from r join c on c.src = r.id where r.depth < 5) select root, id, min(depth) as depth from r group by 1, 2")
def closure_all_regions(spark, d):
    roots = table(spark, d, "region").select(F.concat(F.lit("region:"), "r_regionkey").alias("id"))
    return graph.closure(contains_edges(spark, d), roots, 5, ["contains"])


@query("impact", f"with {_EDGES} select 1 as depth, count(*) as n, string_agg(src, ',' order by src) as ids from k where dst = 'part:1'")
def impact(spark, d):
    return graph.impact(edges(spark, d), "part:1", 5).select("depth", "n", F.array_join("ids", ",").alias("ids"))


@query("shortest_path", f"""with recursive {_EDGES}, r(id, path) as (select 'region:0', ['region:0'] union all select e.dst, list_append(r.path, e.dst) from r join e on e.src = r.id and e.kind in ('calls', 'contains') where len(r.path) < 4),
b as (select min(path) as path from r where id = 'part:1' and len(path) = (select min(len(path)) from r where id = 'part:1')) select unnest(range(len(path))) as pos, unnest(path) as id from b where path is not null""")
def shortest_path(spark, d):
    return graph.shortest_path(edges(spark, d), "region:0", "part:1", 6, ["contains", "calls"])


@query("unresolved_count", _walk_sql("nation:3", 2, "select count(*) as n from orders where o_orderpriority = '1-URGENT' and 'customer:' || o_custkey in (select id from r)", _DOWN))
def unresolved_count(spark, d):
    open_ = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("customer:"), "o_custkey").alias("src"))
    return graph.unresolved_count(edges(spark, d), open_, "nation:3", 2, ["contains", "calls"])


@query("graph_stats", f"with {_EDGES} select kind, count(*) as n, count(distinct src) as sources, count(distinct dst) as targets from e group by kind")
def graph_stats(spark, d):
    return graph.stats(edges(spark, d))


def _trade(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    total = li.where("c_nationkey <> s_nationkey").groupBy("c_nationkey", "s_nationkey").agg(F.sum("l_quantity").alias("q"))
    return graph.first_by(total, ["c_nationkey"], F.desc("q"), "s_nationkey").select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"))


@query("strong_components", """with recursive q as (select c_nationkey as src, s_nationkey as dst, sum(l_quantity) as q from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where c_nationkey <> s_nationkey group by 1, 2),
a as (select src, dst from (select *, row_number() over (partition by src order by q desc, dst) as n from q) where n = 1), r(x, y) as (select src, src from a union select dst, dst from a union select r.x, a.dst from r join a on a.src = r.y)
select p.x as id, min(p.y) as component from r p join r s on p.x = s.y and p.y = s.x group by 1""")
def strong_components(spark, d):
    return graph.strong_components(_trade(spark, d))


# -- search ------------------------------------------------------------------------------------------------------------
@query("name_search", """with n as (select 'region:' || r_regionkey as id, r_name as name from region union all select 'nation:' || n_nationkey, n_name from nation union all select 'customer:' || c_custkey, c_name from customer union all select 'supplier:' || s_suppkey, s_name from supplier union all select 'part:' || p_partkey, p_name from part)
select id, name, case when lower(name) = 'nation_2' then 100 when starts_with(lower(name), 'nation_2') then 50 when contains(lower(name), 'nation_2') then 25 end as score from n where contains(lower(name), 'nation_2') order by score desc, id limit 20""")
def name_search(spark, d):
    return search.search_names(nodes(spark, d), "Nation_2", 20).select("id", "name", "score")


@query("cosine_topk", """with q as (select vec_id as query, embedding::double[] as e from embeddings where vec_id % 100 = 0), s as (select query, vec_id, round(list_cosine_similarity(embedding::double[], e), 9) as similarity from q cross join embeddings),
r as (select *, row_number() over (partition by query order by similarity desc, vec_id) as n from s) select query, vec_id, round(similarity, 6) as similarity from r where n <= 10""")
def cosine_topk(spark, d):
    """Every row of an id that is divisible by 100 is a query, against all rows."""
    v = table(spark, d, "embeddings")
    return search.nearest(v.where("vec_id % 100 = 0"), v, 10, "vec_id").withColumn("similarity", F.round("similarity", 6))


_ASKED = ("what breaks if I drop this table", "path from login to session", "find something similar to parse", "show dependencies of core", "signature of open_file", "Who calls close?", "explore the parser", "an unlikely case")
_KIND = "case " + " ".join(f"when regexp_matches(lower(question), '{'|'.join(p)}') then '{n}'" for n, p in search.INTENTS) + f" else '{search.DEFAULT_INTENT}' end"


@query("intent_classify", f"with q(question) as (values {', '.join(f'($${a}$$)' for a in _ASKED)}) select question, {_KIND} as intent from q")
def intent_classify(spark, d):
    return search.plan(spark.createDataFrame([(a,) for a in _ASKED], "question string")).select("question", "intent")


@query("tokenise", "select item_id, len(list_filter(regexp_split_to_array(text, '[,;\\s]+'), lambda x: length(x) > 1)) as n, array_to_string(list_filter(regexp_split_to_array(text, '[,;\\s]+'), lambda x: length(x) > 1), ' ') as words from benchmark")
def tokenise(spark, d):
    w = tx.words("text")
    return table(spark, d, "benchmark").select("item_id", F.size(w).alias("n"), F.array_join(w, " ").alias("words"))


@query("budget_prefix", "select doc_id, source, total from (select doc_id, source, sum(greatest(1, length(text) // 4)) over (partition by source order by doc_id rows unbounded preceding) as total from documents) where total <= 5000")
def budget_prefix(spark, d):
    return search.within_budget(table(spark, d, "documents").select("doc_id", "source", "text"), 5000, "doc_id", "text", "source").select("doc_id", "source", "total")


@query("name_resolve", f"""with {_PARTS}, q(query) as (values ('part:7'), ('red bolt'), ('gizmo')), x as (select query, id, 1000 as score from q join f on id = query),
s as (select query, id, case when lower(name) = query then 100 when starts_with(lower(name), query) then 50 else 25 end as score from q join f on contains(lower(name), query) where query not in (select query from x))
select * from x union all select query, id, score from (select *, row_number() over (partition by query order by score desc, id) as n from s) where n <= 3""")
def name_resolve(spark, d):
    q = spark.createDataFrame([("part:7",), ("red bolt",), ("gizmo",)], "query string")
    return search.resolve_names(q, nodes(spark, d).where("kind = 'part'"))


# -- rules -------------------------------------------------------------------------------------------------------------
_METRICS = """m as (select c_custkey as id, c_name as name, count(*) * 6.0 as LOC, count(distinct o_orderpriority) * 1.0 as param_count, count(distinct year(o_orderdate)) * 2.0 as cyclomatic, count(distinct o_orderstatus) * 2.0 as nesting_depth, count(distinct month(o_orderdate)) * 1.0 as return_count
  from customer join orders on o_custkey = c_custkey group by 1, 2)"""


@query("rule_findings", f"""with {_METRICS}
select 'long-method' as rule_id, id as entity_id, case when LOC >= 100 or cyclomatic >= 20 then 'High' else 'Medium' end as severity, LOC::double as first_signal from m where LOC >= 50 or cyclomatic >= 10 union all
select 'long-parameter-list', id, case when param_count >= 7 then 'High' when param_count >= 6 then 'Medium' else 'Info' end, param_count from m where param_count > 4 union all
select 'deep-nesting', id, case when nesting_depth >= 6 then 'High' else 'Medium' end, nesting_depth from m where nesting_depth >= 4 union all
select 'high-cyclomatic-complexity', id, case when cyclomatic >= 20 then 'Critical' else 'High' end, cyclomatic from m where cyclomatic >= 10 union all
select 'excessive-returns', id, case when return_count >= 8 then 'High' else 'Medium' end, return_count from m where return_count > 5""")
def rule_findings(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    m = j.groupBy(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).agg(
        (F.count("*") * 6.0).alias("LOC"), (F.count_distinct("o_orderpriority") * 1.0).alias("param_count"), (F.count_distinct(F.year("o_orderdate")) * 2.0).alias("cyclomatic"),
        (F.count_distinct("o_orderstatus") * 2.0).alias("nesting_depth"), (F.count_distinct(F.month("o_orderdate")) * 1.0).alias("return_count"),
    )
    return rules.findings(m, "function").select("rule_id", "entity_id", "severity", F.map_values("signals")[0].alias("first_signal"))


@query("class_findings", """with m as (select s_nationkey as id, count(*) * 5.0 as WMC, max(s_acctbal) / 300 as top, (select count(distinct c_mktsegment) from customer where c_nationkey = s_nationkey) * 2.0 as CBO, count(distinct s_acctbal > 5000) * 6.0 as field_count from supplier group by 1)
select 'god-class' as rule_id, id as entity_id, case when WMC >= 100 then 'Critical' when WMC >= 70 then 'High' else 'Medium' end as severity from m where WMC >= 47 and CBO >= 5 union all
select 'brain-method', id, case when top >= 30 then 'Critical' else 'High' end from m where top >= 15 and WMC >= 20 union all
select 'data-class', id, case when field_count >= 10 and WMC <= 5 then 'High' else 'Medium' end from m where field_count >= 5 and WMC <= 10 union all
select 'too-many-fields', id, case when field_count >= 20 then 'High' else 'Medium' end from m where field_count >= 10""")
def class_findings(spark, d):
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("id")).agg((F.count("*") * 5.0).alias("WMC"), (F.max("s_acctbal") / 300).alias("max_method_cyclomatic"), (F.count_distinct(F.col("s_acctbal") > 5000) * 6.0).alias("field_count"))
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("id")).agg((F.count_distinct("c_mktsegment") * 2.0).alias("CBO"))
    m = s.join(c, "id", "left").withColumn("CBO", F.coalesce("CBO", F.lit(0.0))).withColumn("name", F.col("id").cast("string"))
    return rules.findings(m, "class").select("rule_id", "entity_id", "severity")


@query("coupling", """with m as (select distinct c_nationkey as id, s_nationkey as other from orders join lineitem on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey),
u as (select id, other from m union select n_nationkey, 100 + n_regionkey from nation) select id, count(distinct other)::double as CBO from u where id <> other group by 1""")
def coupling(spark, d):
    return _coupling(spark, d, table(spark, d, "lineitem"))


@query("coupling_all", """with o as (select c_custkey as c, c_nationkey || '/' || c_mktsegment as id from customer), m as (select distinct id, cast(s_suppkey as varchar) as other from orders join lineitem on o_orderkey = l_orderkey join o on c = o_custkey join supplier on s_suppkey = l_suppkey)
select id, count(distinct other)::double as CBO from m group by 1""")
def coupling_all(spark, d):
    """Over every row of lineitem; the classes are each nation's segments, and suppliers."""
    own = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat("c_nationkey", F.lit("/"), "c_mktsegment").alias("parent_class"))
    theirs = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_suppkey").cast("string").alias("parent_class"))
    classes = own.select(F.col("parent_class").alias("id"), F.array().cast("array<string>").alias("resolved_bases")).distinct()
    return rules.coupling(classes, own.unionByName(theirs), _supply_calls(spark, d, table(spark, d, "lineitem")))


def _supply_calls(spark, d, items):
    pairs = table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_suppkey").distinct()
    return pairs.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("target"), F.lit("function").alias("tag"))


def _coupling(spark, d, items):
    classes = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.array(F.col("n_regionkey") + 100).alias("resolved_bases"))
    own = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_nationkey").alias("parent_class"))
    theirs = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_nationkey").alias("parent_class"))
    return rules.coupling(classes, own.unionByName(theirs), _supply_calls(spark, d, items))


# -- dedup by content --------------------------------------------------------------------------------------------------
@query("doc_dedup", "select substr(sha256(text), 1, 16) as content_hash, count(*) as n, min(doc_id) as first_doc from documents where text is not null group by 1")
def doc_dedup(spark, d):
    return table(spark, d, "documents").where("text is not null").groupBy(tx.content_digest("text").alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("hash_skip", "with h as (select doc_id as id, substr(sha256(text), 1, 16) as content_hash from documents where text is not null) select content_hash, min(id) as id from h where id not in (select doc_id from labels) group by 1")
def hash_skip(spark, d):
    h = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), tx.content_digest("text").alias("content_hash"))
    done = h.join(table(spark, d, "labels").select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi")
    return search.to_embed(h, done).select("content_hash", "id")


# -- time --------------------------------------------------------------------------------------------------------------
def _ledger(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", F.col("ts").alias("valid_from"), F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id")).alias("tx_time"), (F.col("event_type") == "error").alias("retired"))


_LEDGER = "l as (select user_id, event_id, ts as valid_from, make_timestamp(epoch_us(ts) + event_id) as tx_time, event_type = 'error' as retired from events)"
_LAST = "select user_id, event_id from (select *, row_number() over (partition by user_id order by {0} desc, {1} desc) as n from l where {0} <= timestamp '2024-01-15 00:00:00') where n = 1 and not retired"


@query("as_of_state", f"with {_LEDGER} {_LAST.format('valid_from', 'tx_time')}")
def as_of_state(spark, d):
    return temporal.as_of(_ledger(spark, d), ["user_id"], "2024-01-15 00:00:00").select("user_id", "event_id")


@query("reconstruct", f"with {_LEDGER} {_LAST.format('tx_time', 'valid_from')}")
def reconstruct(spark, d):
    return temporal.reconstruct(_ledger(spark, d), ["user_id"], "2024-01-15 00:00:00").select("user_id", "event_id")


@query("timeline", f"with {_LEDGER} select user_id, event_id, epoch_us(lead(valid_from) over (partition by user_id order by valid_from)) as until_us from l")
def timeline(spark, d):
    t = temporal.timeline(_ledger(spark, d), ["user_id"])
    open_ = F.col("valid_to") >= F.lit("9999-12-31").cast("timestamp")
    return t.select("user_id", "event_id", F.when(~open_, F.unix_micros("valid_to")).alias("until_us"))


@query("asof_join", "with s as (select user_id, ts, max(event_id) as last_signup from events where event_type = 'signup' group by 1, 2) select e.event_id, s.last_signup from events e asof left join s on e.user_id = s.user_id and e.ts >= s.ts")
def asof_join(spark, d):
    e = table(spark, d, "events")
    return temporal.as_of_join(e.select("event_id", "user_id", "ts"), e.where("event_type = 'signup'"), ["user_id"], "ts", "ts", "event_id", "last_signup").select("event_id", "last_signup")


@query("traverse_at", f"""with recursive {_CONTAINS.replace("customer union", "customer where c_acctbal < 5000 union")}, r(id, depth) as (select 'region:2', 0 union select c.dst, r.depth + 1 from r join c on c.src = r.id where r.depth < 3) select id, min(depth) as depth from r group by id""")
def traverse_at(spark, d):
    # customers of 5000 and more are recorded later than the moment asked for
    rich = table(spark, d, "customer").where("c_acctbal >= 5000").select(F.concat(F.lit("customer:"), "c_custkey").alias("dst"), F.lit("2024-02-01").cast("timestamp").alias("late"))
    e = contains_edges(spark, d).join(rich, "dst", "left").withColumn("valid_from", F.coalesce("late", F.lit("2024-01-01").cast("timestamp")))
    ledger = e.select("src", "dst", "kind", "valid_from", F.col("valid_from").alias("tx_time"), F.lit(False).alias("retired"))
    return temporal.traverse_at(ledger, "region:2", "2024-01-15", 3, ["contains"]).select("id", "depth")


@query("snapshot_diff", """with a as (select o_custkey, max(o_totalprice) as v from orders where o_orderstatus = 'F' group by 1), b as (select o_custkey, max(o_totalprice) as v from orders where o_orderdate < timestamp '1999-01-01' group by 1)
select coalesce(a.o_custkey, b.o_custkey) as o_custkey, case when a.o_custkey is null then 'insert' when b.o_custkey is null then 'remove' else 'modify' end as op from a full join b on a.o_custkey = b.o_custkey where a.v is distinct from b.v""")
def snapshot_diff(spark, d):
    o = table(spark, d, "orders")
    top = lambda df: df.groupBy("o_custkey").agg(F.max("o_totalprice").alias("v"))
    return diff.snapshot_diff(top(o.where("o_orderstatus = 'F'")), top(o.where("o_orderdate < timestamp '1999-01-01'")), ["o_custkey"], "v")


@query("window_counts", "select epoch(time_bucket(interval 1 day, ts))::bigint as window_start, event_type, count(*) as n from events group by 1, 2")
def window_counts(spark, d):
    return incremental.windowed_counts(table(spark, d, "events")).withColumn("window_start", F.unix_timestamp("window_start"))


@query("session_counts", """with g as (select user_id, ts, case when lag(ts) over w + interval 6 hour > ts then 0 else 1 end as opens from events window w as (partition by user_id order by ts)),
s as (select *, sum(opens) over (partition by user_id order by ts) as k from g) select user_id, epoch_us(min(ts)) as session_start, count(*) as n from s group by user_id, k""")
def session_counts(spark, d):
    return incremental.sessions(table(spark, d, "events")).withColumn("session_start", F.unix_micros(F.col("session_start").cast("timestamp")))


# -- text --------------------------------------------------------------------------------------------------------------
@query("html_links", """with h as (select unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as href from pages) select href, count(*) as n from h group by 1""")
def html_links(spark, d):
    links = table(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.groupBy("href").agg(F.count("*").alias("n"))


_COMMENTS = (("/** Opens a file. */", "Opens a file."), ("/// One.\n/// Two.", "One.\nTwo."), ("# plain", "plain"), ("-- sql note", "sql note"), ("<!-- page -->", "page"), ("/*\n * a\n * b\n */", "a\nb"))


@query("comment_clean", "with c(raw, cleaned) as (values " + ", ".join("(" + ", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in p) + ")" for p in _COMMENTS) + ") select raw, cleaned from c")
def comment_clean(spark, d):
    c = spark.createDataFrame([(a,) for a, _ in _COMMENTS], "raw string")
    return c.select("raw", F.regexp_replace(tx.clean_comment("raw"), r"^\n+|\n+$", "").alias("cleaned"))


@query("path_functions", """with p as (select p_partkey, './' || p_brand || '\\' || p_type || '\\' || replace(p_name, ' ', '.') || '.py' as path from part), n as (select p_partkey, regexp_replace(replace(path, '\\', '/'), '^\\./', '') as path from p)
select p_partkey, path, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') as stem, greatest(1, length(path) // 4)::integer as tokens from n""")
def path_functions(spark, d):
    raw = F.concat(F.lit("./"), "p_brand", F.lit("\\"), "p_type", F.lit("\\"), F.translate("p_name", " ", "."), F.lit(".py"))
    return table(spark, d, "part").select("p_partkey", tx.normal_path(raw).alias("path"), tx.stem(raw).alias("stem"), tx.token_estimate(tx.normal_path(raw)).alias("tokens"))


# -- source code -------------------------------------------------------------------------------------------------------
SOURCES = {
    "shop/base.py": '''class Item:\n    """A thing on a shelf."""\n    price: float = 0.0\n\n    def cost(self):\n        return self.price\n\n    def label(self):\n        return self.cost()\n\n\nclass Boxed:\n    def cost(self):\n        return 1\n\n\ndef total(items, tax=0, *rest, **more):\n    out = 0\n    for i in items:\n        if i is None:\n            continue\n        elif tax:\n            out += i.cost()\n        else:\n            out += 1\n    return out\n\n\n__all__ = ["Item", "total"]\n__all__ += ["Boxed"]\n''',
    "shop/book.py": '''from shop.base import Item, total\nfrom shop import base\nimport os.path\n\n\nclass Book(Item, base.Boxed):\n    def cost(self):\n        return total([self]) + len("x")\n\n    @property\n    def shelf(self):\n        return self.label()\n\n\nasync def sell(book):\n    print(book)\n    Book()\n    return total(book, tax=1)\n''',
    "web/app.py": '''from flask import Flask\nfrom shop.base import *\n\napp = Flask(__name__)\n\n\n@app.route("/items", methods=["GET", "POST"])\ndef items():\n    return total([])\n\n\n@app.delete("/items/<i>")\ndef drop(i):\n    return missing(i)\n''',
}


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(SOURCES.items()), "path string, text string")


def _values(rows: list[tuple], names: str) -> str:
    show = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) v({names})"


@query("python_functions", _values([
    ("shop/base.py::Item.cost", "Method", False, 1, 1, 0, 1, ""), ("shop/base.py::Item.label", "Method", False, 1, 1, 0, 1, "self.cost"), ("shop/base.py::Boxed.cost", "Method", False, 1, 1, 0, 1, ""),
    ("shop/base.py::total", "Free", False, 4, 4, 3, 1, "i.cost"), ("shop/book.py::Book.cost", "Method", False, 1, 1, 0, 1, "total,len"), ("shop/book.py::Book.shelf", "Property", False, 1, 1, 0, 1, "self.label"),
    ("shop/book.py::sell", "Free", True, 1, 1, 0, 1, "print,Book,total"), ("web/app.py::items", "Free", False, 0, 1, 0, 1, "total"), ("web/app.py::drop", "Free", False, 1, 1, 0, 1, "missing"),
], "id, function_kind, is_async, parameters, cyclomatic, nesting_depth, return_count, calls"))
def python_functions(spark, d):
    u = python_source.extract(sources(spark)).where("kind = 'function'")
    names = F.transform("calls", lambda c: F.concat_ws(".", F.when(F.size(c["path"]) > 0, c["path"][0]), c["name"]))
    return u.select("id", "function_kind", "is_async", F.size("parameters").alias("parameters"), "cyclomatic", "nesting_depth", "return_count", F.array_join(names, ",").alias("calls"))


@query("python_units", _values([("class", 3), ("function", 9), ("import", 5), ("module", 3)], "kind, n"))
def python_units(spark, d):
    return python_source.extract(sources(spark)).groupBy("kind").agg(F.count("*").alias("n"))


@query("star_exports", _values([("shop/base.py", "Item,total,Boxed")], "path, names"))
def star_exports(spark, d):
    return python_source.extract(sources(spark)).where("kind = 'module' and star_exports is not null").select("path", F.array_join("star_exports", ",").alias("names"))


@query("import_resolution", _values([("shop.base", "shop/base.py::module", "module"), ("shop", None, "external"), ("os.path", None, "external"), ("flask", None, "external"), ("shop.base", "shop/base.py::module", "module")], "module, resolved_module, target_kind"))
def import_resolution(spark, d):
    return resolve_units(python_source.extract(sources(spark)))["imports"].select("module", "resolved_module", "target_kind")


@query("call_resolution", _values([
    ("shop/base.py::Item.label", "cost", "shop/base.py::Item.cost", "function"), ("shop/base.py::total", "cost", None, "unresolved"), ("shop/book.py::Book.cost", "total", "shop/base.py::total", "function"), ("shop/book.py::Book.cost", "len", "external::len", "builtin"),
    ("shop/book.py::Book.shelf", "label", "shop/base.py::Item.label", "function"), ("shop/book.py::sell", "print", "external::print", "builtin"), ("shop/book.py::sell", "Book", "shop/book.py::Book", "constructor"), ("shop/book.py::sell", "total", "shop/base.py::total", "function"),
    ("web/app.py::items", "total", "shop/base.py::total", "function"), ("web/app.py::drop", "missing", "external::missing", "external"),
], "src, name, target, tag"))
def call_resolution(spark, d):
    return resolve_units(python_source.extract(sources(spark)))["calls"].select("src", "name", "target", "tag")


@query("mro_orders", _values([("shop/base.py::Boxed", "Boxed", False), ("shop/base.py::Item", "Item", False), ("shop/book.py::Book", "Book,Item,Boxed", False)], "class_id, names, mro_error"))
def mro_orders(spark, d):
    return resolve_units(python_source.extract(sources(spark)))["bases"].select("class_id", F.array_join("mro_names", ",").alias("names"), "mro_error")


@query("override_edges", _values([("shop/book.py::Book.cost", "shop/base.py::Item.cost")], "src, dst"))
def override_edges(spark, d):
    return resolve_units(python_source.extract(sources(spark)))["edges"].where("kind = 'overrides'").select("src", "dst")


@query("mro_diamond", _values([("A", "A", False), ("B", "B,A", False), ("C", "C,A", False), ("D", "D,B,C,A", False), ("X", "X,Y", True), ("Y", "Y,X", True)], "class_id, names, mro_error"))
def mro_diamond(spark, d):
    b = spark.createDataFrame([("A", []), ("B", ["A"]), ("C", ["A"]), ("D", ["B", "C"]), ("X", ["Y"]), ("Y", ["X"])], "class_id string, bases array<string>")
    return mro.orders(b).select("class_id", F.array_join("mro", ",").alias("names"), "mro_error")


@query("framework_routes", _values([("flask", "GET", "/items", "items"), ("flask", "POST", "/items", "items"), ("flask", "DELETE", "/items/<i>", "drop")], "framework, method, route, target"))
def framework_routes(spark, d):
    return frameworks.routes(sources(spark)).select("framework", "method", "route", "target")


@query("unit_diff", _values([("shop/base.py", "Boxed", "modify", "body"), ("shop/base.py", "Boxed.cost", "modify", "body"), ("shop/base.py", "total", "modify", "signature"), ("shop/base.py", "extra", "insert", None), ("shop/base.py", "Item.label", "remove", None), ("shop/base.py", "Item", "modify", "body")], "path, qualified_name, op, change"))
def unit_diff(spark, d):
    old = sources(spark).where("path = 'shop/base.py'")
    text = SOURCES["shop/base.py"].replace("return 1\n", "return 2\n").replace("tax=0", "tax=0.5").replace("    def label(self):\n        return self.cost()\n\n", "") + "\n\ndef extra():\n    return 0\n"
    new = spark.createDataFrame([("shop/base.py", text)], "path string, text string")
    return diff.unit_diff(python_source.extract(old), python_source.extract(new)).where("kind <> 'module'").select("path", "qualified_name", "op", "change")
