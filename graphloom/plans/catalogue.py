"""Registered queries of the engine and, beside each, the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import spaces, vectors
from graphloom.operators import algorithms, coarsen, metrics, pairs, step, trace
from graphloom.operators.graph import Graph
from graphloom.operators.run import Embedder, LayeredEmbedder, LossMonitor, Options, Schedule
from graphloom.plans import fixtures
from graphloom.session import discard_at_exit, prepare, shared_dir, table
from graphloom.sources import files, generators, sinks

_QUERIES: dict = {}
_SQL: dict[str, str] = {}

#: The succession graph with its layout, in SQL.
G = """with recursive s as (select user_id, lag(user_id) over (order by ts, event_id) as p from events where event_type = 'purchase'),
pair as (select distinct least(user_id, p)::int as a, greatest(user_id, p)::int as b from s where p is not null and p <> user_id),
e as (select a as src, b as dst from pair union all select b, a from pair),
n as (select unnest(range(0, (select max(dst) + 1 from e)))::int as id),
deg as (select n.id, count(e.dst) as deg from n left join e on e.src = n.id group by n.id),
w as (select id, greatest(deg, 1)::double * (select count(*) from n) / (select sum(greatest(deg, 1)) from deg) as w from deg),
p as (select n.id, v.embedding[1]::double * 40 as p0, v.embedding[2]::double * 40 as p1, w.w from n join embeddings v on v.vec_id = n.id join w on w.id = n.id),
gap as (
  select a.id as a, b.id as b, a.p0 - b.p0 as dx, a.p1 - b.p1 as dy, sqrt((a.p0 - b.p0) * (a.p0 - b.p0) + (a.p1 - b.p1) * (a.p1 - b.p1)) as d,
    pow(a.w, -0.5) * pow(b.w, -0.5) as s, a.w as wa, b.w as wb, e.src is not null as edge
  from p a join p b on a.id <> b.id left join e on e.src = a.id and e.dst = b.id),
att as (select a as id, -s * dx / d as f0, -s * dy / d as f1, d - 1 / s as loss from gap where edge and d * s > 1),
rep as (select a as id, s * dx / d as f0, s * dy / d as f1, 1 / s - d as loss from gap where not edge and d * s <= 1),
act as (select * from att union all select * from rep),
f as (select p.id, p.p0, p.p1, coalesce(sum(act.f0), 0) as f0, coalesce(sum(act.f1), 0) as f1 from p left join act on act.id = p.id group by p.id, p.p0, p.p1)
"""
#: The co-purchase graph in SQL.
C = """with recursive items as (select distinct l_orderkey as o, l_partkey::int as p from lineitem),
pair as (select distinct a.p as a, b.p as b from items a join items b on a.o = b.o and a.p < b.p),
e as (select a as src, b as dst from pair union all select b, a from pair),
n as (select unnest(range(0, (select max(p_partkey) + 1 from part)))::int as id),
deg as (select n.id, count(e.dst) as deg from n left join e on e.src = n.id group by n.id)
"""
#: Components of the co-purchase graph: the smallest id travels along the edges; a key holds one row.
COMP = C + """, cc(id, least) using key (id) as (
  select id, id from n union (select e.dst, min(cc.least) from cc join e on e.src = cc.id join recurring.cc r on r.id = e.dst where cc.least < r.least group by e.dst)),
comp as (select id, (dense_rank() over (order by least) - 1)::int as comp from cc)
"""
#: Neighbouring embeddings with labels as weights.
V = """with v as (select vec_id, embedding::double[] as x, label + 1.0::double as w from embeddings),
q as (select a.vec_id as id, a.x as a, b.x as b, a.w as wa, b.w as wb from v a join v b on b.vec_id = a.vec_id + 1)
"""


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return f(spark, sf_dir)

        _QUERIES[key] = run
        if sql:
            _SQL[key] = sql
        return f

    return register


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes])


def _start(spark: SparkSession, sf: str) -> tuple[Graph, DataFrame]:
    g = fixtures.succession(spark, sf)
    return g, fixtures.layout(spark, sf, g)


# --- graphs


@query(C + "select * from deg")
def degree(spark, sf):
    return fixtures.copurchase(spark, sf).degrees()


@query(G + "select id, greatest(deg, 1)::double as w from deg")
def degree_weights(spark, sf):
    return step.degree_weights(fixtures.succession(spark, sf))


@query(G + "select id, 1.0::double as w from n")
def unit_weights(spark, sf):
    return step.unit_weights(fixtures.succession(spark, sf))


@query(G + ", r as (select id, pow(greatest(deg, 1), 0.5) as r from deg) select id, round(r / (select avg(r) from r), 6) as w from r")
def rescaled_weights(spark, sf):
    return _rounded(step.rescaled(step.degree_weights(fixtures.succession(spark, sf)), 2, 4))


@query(C + "select src, dst from e where src < dst")
def canonical_edges(spark, sf):
    return fixtures.copurchase(spark, sf).canonical()


@query(C + "select src, dst from e")
def symmetric_edges(spark, sf):
    return fixtures.copurchase(spark, sf).edges


@query(G + "select (row_number() over (order by src, dst) - 1)::bigint as eid, src, dst from e")
def edge_ids(spark, sf):
    g = fixtures.succession(spark, sf)
    return g.edge_ids().select(F.col("eid").cast("long").alias("eid"), "src", "dst")


@query(G + ", i as (select (row_number() over (order by src, dst) - 1)::bigint as eid, src, dst from e) select n.id, coalesce(string_agg(i.eid::varchar, ' ' order by i.eid), '') as eids, coalesce(max(i.eid), -1)::bigint as last, coalesce(arg_max(i.dst, i.eid), -1)::int as target from n left join i on i.src = n.id group by n.id")
def edge_contents(spark, sf):
    g = fixtures.succession(spark, sf)
    own = g.edge_contents().select("id", F.array_join(F.transform("eids", lambda x: x.cast("string")), " ").alias("eids"), F.coalesce(F.try_element_at("eids", F.lit(-1)), F.lit(-1).cast("long")).alias("last"))
    ends = g.edge_targets(own.select(F.col("last").alias("eid"))).select(F.col("eid").alias("last"), F.col("dst").alias("target"))
    return own.join(ends, "last", "left").select("id", "eids", "last", F.coalesce("target", F.lit(-1)).alias("target"))


@query(V + "select id, round(sqrt({}), 6) as euclidean, round({}, 6) as inf, wa as weight, 1.0::double as unit from q")
def node_helpers(spark, sf):
    a, b = spaces.spread(F.col("a"), _DIMS), spaces.spread(F.col("b"), _DIMS)
    return _rounded(_neighbours_in_space(spark, sf).select("id", spaces.node_distance("weighted", a, b).alias("euclidean"), spaces.node_distance("weighted_inf", a, b).alias("inf"), spaces.node_weight("additive", F.col("wa")).alias("weight"), spaces.node_weight("poincare", F.col("wa")).alias("unit")))


@query(G + "select n.id, coalesce(string_agg(e.dst::varchar, ' ' order by e.dst), '') as nbrs from n left join e on e.src = n.id group by n.id")
def neighbours(spark, sf):
    return fixtures.succession(spark, sf).neighbours().select("id", F.array_join(F.transform("nbrs", lambda x: x.cast("string")), " ").alias("nbrs"))


@query(G + "select n.id, n.id || ':' || ' ' || coalesce(string_agg(e.dst::varchar, ' ' order by e.dst), '') as line from n left join e on e.src = n.id group by n.id")
def adjacency_dump(spark, sf):
    return fixtures.succession(spark, sf).dump()


@query("with n as (select unnest(range(0, (select max(p_partkey) + 1 from part)))::int as id), e as (select distinct l_partkey::int as src, l_suppkey::int as dst from lineitem where l_partkey <> l_suppkey), b as (select src, dst from e union select dst, src from e) select n.id, count(b.dst) as deg from n left join b on b.src = n.id group by n.id")
def gap_filled_degree(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").cast("int").alias("id")).agg(F.collect_set(F.col("l_suppkey").cast("int")).alias("nbrs"))
    vertices = table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("id"))
    return Graph.from_adjacency(vertices.join(rows, "id", "left").select("id", F.coalesce("nbrs", F.array().cast("array<int>")).alias("nbrs"))).degrees()


@query(C + "select (select count(*) from n) as num_nodes, (select count(*) from pair) as num_edges")
def graph_info(spark, sf):
    return fixtures.copurchase(spark, sf).info()


@query(G + "select count(*) = 0 or max(id) - min(id) + 1 = count(distinct id) as no_gaps, (select count(*) from deg where deg = 0) as isolated from n")
def gap_check(spark, sf):
    g = fixtures.succession(spark, sf)
    return g.degrees().agg(F.lit(g.no_gaps()).alias("no_gaps"), F.sum((F.col("deg") == 0).cast("long")).alias("isolated"))


@query(G + "select a.id as src, b.id as dst from n a join n b on b.id = a.id + 1 join e on e.src = a.id and e.dst = b.id")
def adjacency_test(spark, sf):
    g = fixtures.succession(spark, sf)
    return g.adjacent(g.nodes.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))


@query(G + "select src, dst from e where src % 3 = dst % 3")
def same_color_edges(spark, sf):
    g = fixtures.succession(spark, sf)
    g = g.with_colors(g.nodes.select("id", (F.col("id") % 3).alias("color")))
    return g.same_color(g.edges)


@query(G + "select a || ' ' || b as value from pair")
def edge_list_text(spark, sf):
    return sinks.edge_lines(fixtures.succession(spark, sf))


@query("with c as (select distinct o_custkey::int as c, l_suppkey::int as s from orders join lineitem on o_orderkey = l_orderkey), a as (select max(c_custkey)::int + 1 as a from customer) select c.c as src, (a.a + c.s)::int as dst, 0 as c1, 1 as c2 from c, a")
def bipartite(spark, sf):
    a, b = (table(spark, sf, t).agg(F.max(c)).first()[0] + 1 for t, c in (("customer", "c_custkey"), ("supplier", "s_suppkey")))
    rows = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    text = rows.select(F.concat_ws(" ", F.col("o_custkey").cast("string"), (F.col("l_suppkey") + a).cast("string")).alias("value"))
    g = files.read_bipartite(spark, _text(spark.createDataFrame([(f"#psizes {a} {b}",)], "value string").union(text)))
    c = g.nodes
    return g.canonical().join(c.toDF("src", "c1"), "src").join(c.toDF("dst", "c2"), "dst").select("src", "dst", "c1", "c2")


# --- text sources


def _folder(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/text-{uuid.uuid4().hex}"
    discard_at_exit(spark, path)
    return path


def _text(lines: DataFrame) -> str:
    """Lines (value) as a text file in the shared folder."""
    path = _folder(lines.sparkSession)
    lines.write.text(path)
    return path


@query(G + "select src, dst from e where src < dst")
def edge_list_file(spark, sf):
    path = _folder(spark)
    sinks.write_edge_list(fixtures.succession(spark, sf), path)
    return files.read_edge_list(spark, path).canonical()


@query("select vec_id::int as id, round(embedding[1]::double, 6) as x, round(embedding[64]::double, 6) as y, label + 1.0::double as w, 64::int as dims from embeddings")
def coordinate_file(spark, sf):
    path = _folder(spark)
    rows = table(spark, sf, "embeddings")
    sinks.write_coordinates(rows.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("pos"), (F.col("label") + 1).cast("double").alias("w")), path)
    got = files.split_last(files.read_coordinates(spark, path))
    return _rounded(got.select("id", F.get("pos", 0).alias("x"), F.element_at("pos", -1).alias("y"), "w", F.size("pos").alias("dims")))


@query("select vec_id::int as id, round(embedding[2]::double, 6) as c0, round(embedding[3]::double, 6) as s0, round(embedding[2]::double, 6) as radius, round(embedding[3]::double, 6) as cr, round(embedding[64]::double, 6) as w, 63::int as dims, 62::int as sphere from embeddings")
def embedding_types(spark, sf):
    raw = table(spark, sf, "embeddings").select(F.col("vec_id").cast("int").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("pos"))
    kinds = {k: files.parse_embedding(k, raw) for k in files.TYPES}
    circle = files.parse_embedding("mercator", raw.select("id", F.slice("pos", 1, 3).alias("pos"))).select("id", F.get("pos", 0).alias("c0"), F.col("radius").alias("cr"))
    sphere = kinds["mercator"].select("id", F.get("pos", 0).alias("s0"), "radius", F.size("pos").alias("sphere"))
    weighted = kinds["weighted"].select("id", "w", F.size("pos").alias("dims"))
    return _rounded(circle.join(sphere, "id").join(weighted, "id"))


@query("select event_type as name, count(*)::varchar as value from events group by event_type")
def config_csv(spark, sf):
    path = _folder(spark)
    sinks.write_rows(table(spark, sf, "events").groupBy().pivot("event_type").count(), path)
    return files.read_config(spark, path, "csv")


@query("select 'embedding_time' as name, count(*)::varchar as value from events")
def time_file(spark, sf):
    return files.read_time(spark, _text(table(spark, sf, "events").agg(F.count(F.lit(1)).cast("string").alias("value"))))


@query("select label, 'n: ' || count(*) || ', top: ' || max(vec_id) as text, round(max(vec_id) / (select max(vec_id) from embeddings)::double, 6) as share, round(coalesce(avg(case when label % 2 = 0 then vec_id end), -1), 6) as mean_even from embeddings group by label")
def map_text(spark, sf):
    top = table(spark, sf, "embeddings").agg(F.max("vec_id")).first()[0]
    by = table(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("vec_id").alias("top"), vectors.average(F.when(F.col("label") % 2 == 0, F.col("vec_id"))).alias("mean_even"))
    text = vectors.map_text(F.create_map(F.lit("top"), F.col("top"), F.lit("n"), F.col("n")))
    return _rounded(by.select("label", text.alias("text"), vectors.scaled_to_max(F.col("top"), top).alias("share"), "mean_even"))


@query("with l as (select unnest(string_split(text, chr(10))) as value from documents) select value from l where not starts_with(value, 'T')")
def comment_filter(spark, sf):
    lines = table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return lines.where(~vectors.starts_with(F.col("value"), "T"))


@query(G + "select distinct src, dst from e")
def edge_list_parse(spark, sf):
    text = sinks.edge_lines(fixtures.succession(spark, sf)).select(F.concat("value", F.lit(" 7 extra")).alias("value"))
    return Graph.from_edges(files.parse_edges(text.union(spark.createDataFrame([("# comment",)], "value string")))).edges


@query("select vec_id::int as id, round(embedding[1]::double, 6) as x, round(embedding[2]::double, 6) as y, round(embedding[64]::double, 6) as w, 63::int as dims from embeddings")
def split_last_column(spark, sf):
    text = sinks.coordinate_lines(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("pos")))
    got = files.split_last(files.parse_coordinates(text))
    return _rounded(got.select("id", F.get("pos", 0).alias("x"), F.get("pos", 1).alias("y"), "w", F.size("pos").alias("dims")))


@query("select vec_id::int as id, round(embedding[2]::double, 6) as x, round(embedding[1]::double, 6) as w from embeddings")
def split_first_column(spark, sf):
    pos = table(spark, sf, "embeddings").select(F.col("vec_id").cast("int").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("pos"))
    return _rounded(files.split_first(pos).select("id", F.get("pos", 0).alias("x"), "w"))


@query("select vec_id::int as id, round(embedding[1]::double, 6) as x, round(embedding[2]::double, 6) as y from embeddings")
def plane_projection(spark, sf):
    pos = table(spark, sf, "embeddings").select(F.col("vec_id").cast("int").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("pos"))
    return _rounded(files.plane(pos))


@query("select event_type as name, count(*)::varchar as value from events group by event_type")
def log_parse(spark, sf):
    rows = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("c"))
    text = rows.select(F.concat(F.lit("> "), "event_type", F.lit("(default)="), F.col("c").cast("string")).alias("value"))
    return files.parse_log(text.union(text.select(F.concat(F.lit("no "), "value"))))


@query("select n_nationkey as id, trim(n_name) as name, trim(n_name) || ' ' || chr(10) as l, chr(9) || '  ' || trim(n_name) as r, len(string_split(n_name || ',,x', ','))::int as parts from nation")
def text_functions(spark, sf):
    name = F.concat(F.lit("\t  "), "n_name", F.lit(" \n"))
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), vectors.trim(name).alias("name"), vectors.ltrim(name).alias("l"), vectors.rtrim(name).alias("r"), F.size(vectors.tokens(F.concat("n_name", F.lit(",,x")), ",")).alias("parts"))


HSV = """with c as (select n_nationkey as id, n_nationkey * 360.0::double / (select max(n_nationkey) from nation) as h from nation),
t as (select id, floor(h / 60) as k, h / 60 - floor(h / 60) as f from c),
rgb as (select id, case k::int % 6 when 0 then 1 when 1 then 1 - f when 2 then 0 when 3 then 0 when 4 then f else 1 end as r,
  case k::int % 6 when 0 then f when 1 then 1 when 2 then 1 when 3 then 1 - f else 0 end as g,
  case k::int % 6 when 0 then 0 when 1 then 0 when 2 then f when 3 then 1 when 4 then 1 else 1 - f end as b from t)
select id, floor(round(255 * r, 6))::int as r, floor(round(255 * g, 6))::int as g, floor(round(255 * b, 6))::int as b, (id % 3)::double as grey from rgb"""


@query(HSV)
def hsv_colour(spark, sf):
    top = table(spark, sf, "nation").agg(F.max("n_nationkey")).first()[0]
    rgb = vectors.hsv_to_rgb(F.col("n_nationkey") * F.lit(360.0) / top, F.lit(1.0), F.lit(1.0))
    grey = vectors.hsv_to_rgb(F.col("n_nationkey") * 5.0, F.lit(0.0), (F.col("n_nationkey") % 3).cast("double"))
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), *[F.floor(F.round(c, 6)).cast("int").alias(k) for c, k in zip(rgb, "rgb", strict=True)], grey[1].alias("grey"))


# --- spaces

_DIMS = 64
_D2 = " + ".join(f"(a[{k}] - b[{k}]) * (a[{k}] - b[{k}])" for k in range(1, _DIMS + 1))
_DOT = lambda x, y, n=_DIMS: "(" + " + ".join(f"{x}[{k}] * {y}[{k}]" for k in range(1, n + 1)) + ")"
_INF = "greatest(" + ", ".join(f"abs(a[{k}] - b[{k}])" for k in range(1, _DIMS + 1)) + ")"
_IN = lambda x: f"greatest(0.0, least(0.99999, {_DOT(x, x)}))"
_SPACE_SQL = {
    "euclidean": f"sqrt({_D2})",
    "infnorm": _INF,
    "dot": f"-{_DOT('a', 'b')}",
    "cosine": f"-{_DOT('a', 'b')} / (sqrt({_DOT('a', 'a')}) * sqrt({_DOT('b', 'b')}))",
    "weighted": f"sqrt({_D2}) / pow(wa * wb, 1 / 64.0::double)",
    "weighted_inf": f"{_INF} / pow(wa * wb, 1 / 64.0::double)",
    "weighted_nodim": f"sqrt({_D2}) / (wa * wb)",
    "additive": f"sqrt({_D2}) / (pow(wa, 1 / 64.0::double) + pow(wb, 1 / 64.0::double))",
    "poincare": f"ln(2 * ({_D2}) / ((1 - {_IN('a')}) * (1 - {_IN('b')})) + 1 + sqrt((2 * ({_D2}) / ((1 - {_IN('a')}) * (1 - {_IN('b')})) + 1) ^ 2 - 1))",
}


def _neighbours_in_space(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") + 1).cast("double").alias("w"))
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"), F.col("w").alias("wb"))
    return v.select("vec_id", F.col("embedding").alias("a"), F.col("w").alias("wa")).join(b, "vec_id").withColumnRenamed("vec_id", "id")


for _name, _sql in _SPACE_SQL.items():

    def _space(spark, sf, _name=_name):
        a, b = spaces.spread(F.col("a"), _DIMS), spaces.spread(F.col("b"), _DIMS)
        value = spaces.similarity(_name, a, b, F.col("wa"), F.col("wb"))
        return _rounded(_neighbours_in_space(spark, sf).select("id", value.alias("similarity")))

    query(V + f"select id, round({_sql}, 6) as similarity from q", f"sim_{_name}")(_space)

_NORM = "greatest(" + ", ".join(f"abs(a[{k}])" for k in range(1, _DIMS + 1)) + ")"
_LAW = "0.5 * ((1 - cos(t)) * cosh(ra + rb) + (1 + cos(t)) * cosh(ra - rb))"


@query(V + f", m as (select id, pi() - abs(pi() - abs(abs(a[1]) * 6 - abs(b[1]) * 6)) as t, 1 + a[2] as ra, 1 + b[2] as rb from q) select id, round(acosh(greatest(1.0, {_LAW})), 6) as similarity from m")
def sim_mercator_s1(spark, sf):
    a, b = spaces.spread(F.col("a"), 2), spaces.spread(F.col("b"), 2)
    return _rounded(_neighbours_in_space(spark, sf).select("id", spaces.mercator_s1(F.abs(a[0]) * 6, F.abs(b[0]) * 6, 1 + a[1], 1 + b[1]).alias("similarity")))


@query(V + f", m as (select id, acos(greatest(-1.0, least(1.0, {_DOT('a', 'b', 3)} / (sqrt({_DOT('a', 'a', 3)}) * sqrt({_DOT('b', 'b', 3)}))))) as t, 1 + a[4] as ra, 1 + b[4] as rb from q) select id, round(acosh(greatest(1.0, {_LAW})), 6) as similarity from m")
def sim_mercator_sd(spark, sf):
    a, b = spaces.spread(F.col("a"), 4), spaces.spread(F.col("b"), 4)
    return _rounded(_neighbours_in_space(spark, sf).select("id", spaces.mercator_sd(a[:-1], b[:-1], 1 + a[-1], 1 + b[-1]).alias("similarity")))


@query(V + f"select id, round(sqrt({_DOT('a', 'a')}), 6) as norm, round({_NORM}, 6) as inf_norm, case when abs(a[1]) = {_NORM} then sign(a[1])::double else 0 end as i0, (list_position(list_transform(a, lambda x: abs(x)), {_NORM}) - 1)::int as top, round(a[1] / sqrt({_DOT('a', 'a')}), 6) as n0, round(greatest(-0.1, least(0.1, a[1])), 6) as c0, round((a[1] - b[1]) / sqrt({_D2}), 6) as g0, round(a[1] + 3 * b[1], 6) as s0 from q")
def vector_functions(spark, sf):
    a, b = spaces.spread(F.col("a"), _DIMS), spaces.spread(F.col("b"), _DIMS)
    return _rounded(
        _neighbours_in_space(spark, sf).select(
            "id",
            vectors.norm(a).alias("norm"),
            vectors.inf_norm(a).alias("inf_norm"),
            vectors.inf_normed(a)[0].alias("i0"),
            vectors.max_index(a).cast("int").alias("top"),
            vectors.normed(a)[0].alias("n0"),
            vectors.clamp(a, -0.1, 0.1)[0].alias("c0"),
            vectors.norm_gradient(a, b)[0].alias("g0"),
            vectors.plus(a, vectors.scaled(b, 3))[0].alias("s0"),
        )
    )


# --- pair joins

_W64 = "with v as (select vec_id::int as id, " + ", ".join(f"embedding[{k + 1}]::double as p{k}" for k in range(_DIMS)) + ", label + 1.0::double as w from embeddings) "


def _points64(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.vectors(spark, sf, _DIMS).join(table(spark, sf, "embeddings").select(F.col("vec_id").cast("int").alias("id"), (F.col("label") + 1).cast("double").alias("w")), "id")


def _circles(v: DataFrame) -> DataFrame:
    return v.select(F.col("id").alias("qid"), *[f"p{k}" for k in range(_DIMS)], F.lit(1.2).alias("radius"))


_G64 = "sqrt(" + " + ".join(f"(a.p{k} - b.p{k}) * (a.p{k} - b.p{k})" for k in range(_DIMS)) + ")"
_B64 = "greatest(" + ", ".join(f"abs(a.p{k} - b.p{k})" for k in range(_DIMS)) + ")"
_REACH = "pow(a.w * b.w, 1 / 64.0::double)"


@query(_W64 + f"select a.id as qid, b.id from v a join v b on {_G64} <= 1.2")
def radius_join(spark, sf):
    v = _points64(spark, sf)
    return pairs.within(v, _circles(v))


@query(_W64 + f"select a.id as qid, b.id from v a join v b on {_G64} <= 1.2")
def radius_join_banded(spark, sf):
    v = _points64(spark, sf)
    return pairs.within(v, _circles(v), theta=0)


@query(_W64 + f"select a.id as a_id, b.id as b_id from v a join v b on a.id <> b.id and {_G64} <= 1.1 * {_REACH}")
def weighted_radius_join(spark, sf):
    return pairs.weighted_within(_points64(spark, sf), 1.1).select("a_id", "b_id")


@query(_W64 + f"select a.id as a_id, b.id as b_id from v a join v b on a.id <> b.id and {_G64} <= 1.1 * {_REACH}")
def weighted_radius_join_grid(spark, sf):
    return pairs.weighted_within(_points64(spark, sf), 1.1, theta=0).select("a_id", "b_id")


@query(_W64 + f"select a.id as a_id, b.id as b_id from v a join v b on a.id <> b.id and {_B64} <= 0.35 * {_REACH}")
def box_join(spark, sf):
    return pairs.within_box(_points64(spark, sf), 0.35)


@query(_W64 + f", r as (select a.id as a_id, b.id as b_id, {_G64} as dist, row_number() over (partition by a.id order by {_G64}, b.id)::int as rank from v a join v b on a.id <> b.id and a.id % 20 = 0) select a_id, b_id, round(dist, 6) as dist, rank from r where rank <= 5")
def knn_join(spark, sf):
    v = _points64(spark, sf)
    return _rounded(pairs.nearest(v, v.where("id % 20 = 0"), 5)).select("a_id", "b_id", "dist", "rank")


@query(G + "select a.id as a_id, b.id as b_id from n a join n b on a.id < b.id left join e on e.src = a.id and e.dst = b.id where e.src is null")
def non_edges(spark, sf):
    g, p = _start(spark, sf)
    return pairs.non_edges(g, p).select("a_id", "b_id")


@query(G + ", b as (select min(w) as lo, max(w) as hi from w) select k::int as k, round(lo * pow(2, k), 6) as bucket from b, (select unnest(range(1, 40)) as k) where lo * pow(2, k) < hi")
def weight_buckets(spark, sf):
    _, p = _start(spark, sf)
    return spark.createDataFrame([(k + 1, round(x, 6)) for k, x in enumerate(pairs.weight_buckets(p))], "k int, bucket double")


@query(G + ", b as (select min(w) as lo, max(w) as hi from w) select k::int as k, round(least(lo * pow(2, k), hi), 6) as top from b, (select unnest(range(1, 40)) as k) where lo * pow(2, k - 1) < hi")
def class_maxima(spark, sf):
    _, p = _start(spark, sf)
    return spark.createDataFrame([(k + 1, round(x, 6)) for k, x in enumerate(pairs.class_maxima(p, pairs.weight_buckets(p)))], "k int, top double")


@query(_W64 + "select a.id as src, b.id as dst from v a join v b on a.id < b.id and sqrt((a.p0 - b.p0) ^ 2 + (a.p1 - b.p1) ^ 2) < 0.02")
def disc_edges(spark, sf):
    return generators.disc_edges(fixtures.vectors(spark, sf, 2), 0.02)


@query(_W64 + "select id, round(p0, 6) as x, round(p63, 6) as y, 64::int as dims from v")
def nested_positions(spark, sf):
    return _rounded(pairs.nest(_points64(spark, sf)).select("id", F.get("pos", 0).alias("x"), F.element_at("pos", -1).alias("y"), F.size("pos").alias("dims")))


@query(G + ", b as (select min(w) as lo, max(w) as hi from w), bk as (select k, lo * pow(2, k) as bucket from b, (select unnest(range(1, 40)) as k) where lo * pow(2, k) < hi), c as (select w.id, count(bk.k)::int as cls from w left join bk on w.w >= bk.bucket group by w.id) select cls, count(*) as n from c group by cls")
def bucket_counts(spark, sf):
    _, p = _start(spark, sf)
    return p.groupBy(pairs.weight_class(F.col("w"), pairs.weight_buckets(p)).cast("int").alias("cls")).agg(F.count(F.lit(1)).alias("n"))


# --- steps


@query(G + "select round((select sum(loss) from att), 6) as attractive, round(coalesce((select sum(loss) from rep), 0), 6) as repulsive, (select count(*) from rep) as repelling_pairs")
def step_loss(spark, sf):
    return _rounded(step.losses(*_start(spark, sf)))


_SUMS = "select id, round(sum(f0), 6) as f0, round(sum(f1), 6) as f1, round(sum(loss), 6) as loss from {} group by id"


@query(G + _SUMS.format("att"))
def attraction_force(spark, sf):
    return _rounded(step.deterministic_sum(step.attraction(*_start(spark, sf)), ["id"], "other", ["f0", "f1", "loss"]))


@query(G + _SUMS.format("rep"))
def repulsion_force(spark, sf):
    return _rounded(step.deterministic_sum(step.repulsion(*_start(spark, sf)), ["id"], "other", ["f0", "f1", "loss"]))


@query(G + "select id, round(f0, 6) as f0, round(f1, 6) as f1 from f")
def total_force(spark, sf):
    return _rounded(step.forces(*_start(spark, sf))).select("id", "f0", "f1")


@query(G + "select id, round(-0.1 * p0, 6) as f0, round(-0.1 * p1, 6) as f1 from p")
def centre_force(spark, sf):
    return _rounded(step.centre(_start(spark, sf)[1], step.Forces(centre=0.1))).select("id", "f0", "f1")


@query(G + "select round(avg(p0), 6) as c0, round(avg(p1), 6) as c1 from p")
def centroid(spark, sf):
    return _rounded(step.centroid(_start(spark, sf)[1]))


@query("select o_orderstatus, round(sum(o_totalprice::double), 2) as total, round(sum(o_totalprice::double / 7), 2) as seventh from orders group by o_orderstatus")
def deterministic_sum(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderstatus", "o_orderkey", F.col("o_totalprice").cast("double").alias("total"), (F.col("o_totalprice").cast("double") / 7).alias("seventh"))
    return _rounded(step.deterministic_sum(orders, ["o_orderstatus"], "o_orderkey", ["total", "seventh"]), 2)


_LR = 10 * 0.995 / 20
_ADAM = G + f""", q as (select id, p0 as o0, p1 as o1, p0 + {_LR} * f0 / (abs(f0) + 1e-8) as p0, p1 + {_LR} * f1 / (abs(f1) + 1e-8) as p1 from f),
r as (select id, o0, o1, p0 - (select avg(p0) from q) as p0, p1 - (select avg(p1) from q) as p1 from q)
"""


def _one_step(spark: SparkSession, sf: str, simple: bool = False) -> tuple[DataFrame, DataFrame]:
    g, p = _start(spark, sf)
    state = p.withColumns({f"{c}{k}": F.lit(0.0) for c in "mv" for k in range(2)}).join(step.forces(g, p).drop("attract", "repel"), "id")
    moved = step.simple(state, 2, _LR, 1.0) if simple else step.adam(state, 2, _LR, 1)
    return p, step.recentred(moved.select("id", "p0", "p1", "w"))


@query(_ADAM + "select id, round(p0, 5) as p0, round(p1, 5) as p1 from r")
def adam_step(spark, sf):
    return _rounded(_one_step(spark, sf)[1].select("id", "p0", "p1"), 5)


@query(G + f", q as (select id, p0 + {_LR} * greatest(-1.0, least(1.0, f0)) as p0, p1 + {_LR} * greatest(-1.0, least(1.0, f1)) as p1 from f) select id, round(p0 - (select avg(p0) from q), 5) as p0, round(p1 - (select avg(p1) from q), 5) as p1 from q")
def simple_step(spark, sf):
    return _rounded(_one_step(spark, sf, simple=True)[1].select("id", "p0", "p1"), 5)


@query(_ADAM + "select round(avg(sqrt((p0 - o0) ^ 2 + (p1 - o1) ^ 2)), 5) as displacement, round(sqrt(avg(p0 * p0 + p1 * p1)), 5) as radius from r")
def displacement(spark, sf):
    return _rounded(step.displacement(*_one_step(spark, sf)).select("displacement", "radius"), 5)


@query(G + ", q as (select f.*, p.w, p.p0 * 0.01 as m0, p.p0 * p.p0 as v0 from f join p on p.id = f.id) select id, round(0.9 * m0 + 0.1 * f0, 6) as m0, round(0.999 * v0 + 0.001 * f0 * f0, 6) as v0, round(p0 + 0.5 * ((0.9 * m0 + 0.1 * f0) / (1 - pow(0.9::double, 3))) / (sqrt((0.999 * v0 + 0.001 * f0 * f0) / (1 - pow(0.999::double, 3))) + 1e-8), 5) as p0 from q")
def adam_third_step(spark, sf):
    g, p = _start(spark, sf)
    state = p.withColumns({"m0": F.col("p0") * 0.01, "v0": F.col("p0") * F.col("p0"), "m1": F.lit(0.0), "v1": F.lit(0.0)}).join(step.forces(g, p).drop("attract", "repel"), "id")
    moved = step.adam(state, 2, 0.5, 3)
    return moved.select("id", F.round("m0", 6).alias("m0"), F.round("v0", 6).alias("v0"), F.round("p0", 5).alias("p0"))


@query(G + ", gone as (select a.id from n a join e on e.src = a.id where a.id % 2 = 0 and e.dst = a.id + 1 union select a.id + 1 from n a join e on e.src = a.id where a.id % 2 = 0 and e.dst = a.id + 1) select id, 1.0::double as push from gone")
def coincident_vertices(spark, sf):
    # neighbours 2k and 2k + 1 at one place push each other along unit vectors; others are far away
    g = fixtures.succession(spark, sf)
    p = g.nodes.select("id", (F.floor(F.col("id") / 2) * 1000.0).alias("p0"), F.lit(0.0).alias("p1"), F.lit(1.0).alias("w"))
    one = step.attraction(g, p).where("loss = 0")
    return one.select("id", F.round(F.sqrt(F.col("f0") * F.col("f0") + F.col("f1") * F.col("f1")), 6).alias("push"))


# --- metrics

_RANK = G + """, r as (select a as v, b as x, round(d, 9) as similarity, edge::int as is_nb, row_number() over w as rk, sum(edge::int) over w as hits from gap where a in (select src from e)
  window w as (partition by a order by round(d, 9), b rows unbounded preceding)),
k as (select r.*, deg.deg, hits / rk::double as precision, hits / deg.deg::double as recall from r join deg on deg.id = r.v)
"""


def _ranked(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return metrics.ranked(*_start(spark, sf), digits=9, columns=columns, places=6)


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.vertex_scores(*_start(spark, sf), digits=9)


@query(_RANK + "select v, x, rk::int as rk, round(precision, 6) as precision from k")
def precision_at_k(spark, sf):
    return _ranked(spark, sf, "v", "x", "rk", "precision")


@query(_RANK + "select v, x, rk::int as rk, round(recall, 6) as recall from k")
def recall_at_k(spark, sf):
    return _ranked(spark, sf, "v", "x", "rk", "recall")


_NODE = _RANK + ", sc as (select v, max(deg) as deg, max(case when rk = deg then precision end) as deg_precision, coalesce(avg(case when is_nb = 1 then precision end), -1) as average_precision from k group by v) "


@query(_NODE + "select v, deg, round(deg_precision, 6) as deg_precision, round(average_precision, 6) as average_precision from sc")
def average_precision(spark, sf):
    return _rounded(_scores(spark, sf))


@query(_NODE + "select round(avg(deg_precision), 6) as construct_deg, round(avg(average_precision), 6) as map from sc")
def reconstruction(spark, sf):
    return _rounded(metrics.reconstruction(_scores(spark, sf)))


@query("""with v as (select vec_id, embedding::double[] as x, label from embeddings),
g as (select a.vec_id as v, b.vec_id as x, (a.label = b.label)::int as nb, round(sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 9) as d from v a join v b on a.vec_id <> b.vec_id),
r as (select v, nb, sum(nb) over w as hits, row_number() over w as rk from g window w as (partition by v order by d, x rows unbounded preceding)),
dg as (select v, sum(nb) as deg from g group by v),
s as (select r.v, max(case when rk = deg then hits / rk::double end) as pd, avg(case when nb = 1 then hits / rk::double end) as ap from r join dg on dg.v = r.v where deg > 0 group by r.v)
select round(avg(pd), 5) as construct_deg, round(avg(ap), 5) as map from s""")
def label_reconstruction(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").cast("int").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("pos"))
    lab = v.select("id", "label")
    e = lab.toDF("src", "label").join(lab.toDF("dst", "label"), "label").where("src <> dst").select("src", "dst")
    g = Graph(lab.select("id", F.col("id").alias("color")), e)
    return _rounded(metrics.reconstruction(metrics.vertex_scores(g, pairs.flatten(v, 64), digits=9)), 5)


@query(G + """, q as (select round(d, 9) as sim, a as v, b as w, edge::int as edge from gap where a < b),
c as (select *, sum(edge) over k as e, sum(1 - edge) over k as f from q window k as (order by sim, edge, v, w rows unbounded preceding)),
m as (select (select count(*) from pair)::double as m, (select count(*) from n)::double as n),
z as (select c.sim, c.edge, c.v, c.w, e::double as tp, f::double as fp, m.m from c, m),
x as (select *, case when tp > 0 then tp / (tp + fp) else 0 end as precision, tp / m as recall from z),
y as (select *, case when tp > 0 then 2 / (1 / precision + 1 / recall) else 0 end as f1 from x)
select round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from y order by round(f1, 10) desc, sim, edge, v, w limit 1""")
def edge_detection_f1(spark, sf):
    return _rounded(metrics.edge_f1(*_start(spark, sf), digits=9))


# --- graph algorithms


@query(COMP + "select id, comp from comp")
def components(spark, sf):
    return fixtures.copurchase(spark, sf).components()


@query(COMP + "select comp, count(*) as size from comp group by comp")
def component_sizes(spark, sf):
    return fixtures.copurchase(spark, sf).components().groupBy("comp").agg(F.count(F.lit(1)).alias("size"))


@query(COMP + "select count(distinct comp) as components, count(distinct comp) = 1 as connected from comp")
def component_count(spark, sf):
    g = fixtures.copurchase(spark, sf)
    return g.components().agg(F.count_distinct("comp").alias("components")).withColumn("connected", F.lit(g.is_connected()))


@query(COMP + ", b as (select comp from comp group by comp order by count(*) desc, comp limit 1), i as (select id as old, (row_number() over (order by id) - 1)::int as new from comp where comp in (select comp from b)) select x.new as src, y.new as dst from e join i x on x.old = e.src join i y on y.old = e.dst")
def largest_component(spark, sf):
    return fixtures.copurchase(spark, sf).largest_component()[0].edges


#: Breadth-first search from all vertices that ``{}`` chooses; a pair is entered once, at its first level.
_BFS = G + """, b(o, id, d) using key (o, id) as (
  select id, id, 0 from n where {} union (select b.o, e.dst, min(b.d) + 1 from b join e on e.src = b.id where not exists (select 1 from recurring.b r where r.o = b.o and r.id = e.dst) group by b.o, e.dst))
"""


@query(_BFS.format("id = 0") + "select n.id, coalesce(b.d, -1)::int as dist from n left join b on b.id = n.id")
def bfs_distances(spark, sf):
    return algorithms.shortest_paths(fixtures.succession(spark, sf), 0)


@query(_BFS.format("true") + "select o.id as origin, n.id, coalesce(b.d, -1)::int as dist from n join n o on true left join b on b.id = n.id and b.o = o.id")
def all_pairs_bfs(spark, sf):
    return algorithms.all_pairs(fixtures.succession(spark, sf))


def _clusters(g: Graph) -> DataFrame:
    return coarsen.compact(g.nodes.select("id", (F.col("id") * 7 % 10).alias("cluster")))


_CL = ", cl as (select id, (dense_rank() over (order by f) - 1)::int as cluster from (select id, min(id) over (partition by id * 7 % 10) as f from n)), ce as (select x.cluster as csrc, y.cluster as cdst, e.src, e.dst from e join cl x on x.id = e.src join cl y on y.id = e.dst) "


@query(G + _CL + "select id, cluster from cl")
def compact_clusters(spark, sf):
    return _clusters(fixtures.succession(spark, sf))


@query(G + _CL + "select distinct csrc as src, cdst as dst from ce where csrc <> cdst")
def coarsen_edges(spark, sf):
    g = fixtures.succession(spark, sf)
    return coarsen.coarsen(g, _clusters(g))[0].edges


@query(G + _CL + ", ei as (select row_number() over (order by src, dst) - 1 as eid, src, dst, csrc, cdst from ce), co as (select csrc, cdst, row_number() over (order by csrc, cdst) - 1 as ceid from (select distinct csrc, cdst from ce where csrc <> cdst)) select eid, coalesce(ceid, -1) as coarse_eid from ei left join co on co.csrc = ei.csrc and co.cdst = ei.cdst")
def coarse_edge_map(spark, sf):
    g = fixtures.succession(spark, sf)
    return coarsen.coarsen(g, _clusters(g))[1].select(F.col("eid").cast("long").alias("eid"), F.col("coarse_eid").cast("long").alias("coarse_eid"))


@query(G + _CL + "select csrc as src, cdst as dst, count(*)::double as w from ce where csrc <> cdst group by csrc, cdst")
def coarse_edge_weights(spark, sf):
    g = fixtures.succession(spark, sf)
    return coarsen.coarse_weights(g.edges.withColumn("w", F.lit(1.0)), _clusters(g))


@query(G + ", kid as (select (id - case when id % 3 = 2 then 1 else 0 end)::int as c, count(*) as kids from n group by 1), h as (select n.id, coalesce(kids, 0) as kids, (select min(dst) from e where e.src = n.id) as t from n left join kid on kid.c = n.id), r as (select id, case when kids > 1 then id else coalesce(t, id) end as c from h) select id, (dense_rank() over (order by f) - 1)::int as cluster from (select id, min(id) over (partition by c) as f from r)")
def aggressive_merge(spark, sf):
    g = fixtures.succession(spark, sf)
    parents = g.nodes.select("id", (F.col("id") - F.when(F.col("id") % 3 == 2, 1).otherwise(0)).alias("cluster"))
    return coarsen.aggressive_merge(g, g.edges.withColumn("w", F.lit(1.0)), parents)


@query(G + ", k as (select sqrt((select count(*) from n) / 10.0::double) as k) select n.id, round(k.k * p.p0, 6) as p0, round(k.k * p.p1, 6) as p1 from n join p on p.id = n.id % 10, k")
def expand_layer(spark, sf):
    g, p = _start(spark, sf)
    parents = g.nodes.select("id", (F.col("id") % 10).alias("cluster"))
    return _rounded(coarsen.expand(parents, p.where("id < 10").select("id", "p0", "p1"), g.n, 10))


@query(G + "select (id % 10)::int as parent, string_agg(id::varchar, ' ' order by id) as children, count(*) as n from n group by 1")
def hierarchy_children(spark, sf):
    g = fixtures.succession(spark, sf)
    weights = g.edges.withColumn("w", F.lit(1.0))
    parents = g.nodes.select("id", (F.col("id") % 10).alias("cluster"))
    coarse = coarsen.coarsen(g, parents)[0]
    top = coarsen.Layer(coarse, coarsen.coarse_weights(weights, parents), coarse.nodes.select("id", F.lit(-1).alias("cluster")))
    kids = coarsen.layer_tables([coarsen.Layer(g, weights, parents), top])[1]
    return kids.select(F.col("id").alias("parent"), F.array_join(F.transform("children", lambda x: x.cast("string")), " ").alias("children"), F.size("children").cast("long").alias("n"))


# --- monitors and schedules

_T = "with recursive t as (select (event_id % 40)::int as t, avg(value) as loss from events group by 1), s as (select t, loss, loss as smoothed from t where t = 0 union all select t.t, t.loss, 0.3 * t.loss + 0.7 * s.smoothed from s join t on t.t = s.t + 1), r as (select t, smoothed, lag(smoothed, 3) over (order by t) as old from s), q as (select t, case when old is null then 1e9 else (old - smoothed) / greatest(abs(old), 1e-12) end as rate from r) "


def _series(spark: SparkSession, sf: str) -> DataFrame:
    return trace.smoothed(table(spark, sf, "events").groupBy((F.col("event_id") % 40).cast("int").alias("t")).agg(F.avg("value").alias("loss")))


@query(_T + "select t, round(smoothed, 6) as smoothed from s")
def ema_loss(spark, sf):
    return _rounded(_series(spark, sf).select("t", "smoothed"))


@query(_T + "select t, round(rate, 6) as rate from q")
def loss_rate(spark, sf):
    r = trace.rates(_series(spark, sf), 3)
    return _rounded(r.select("t", F.least("rate", F.lit(1e9)).alias("rate")))


@query(_T + ", i as (select t, rate, rate < 0.01 as below, sum((rate >= 0.01)::int) over (order by t) as island from q) select t, (sum(below::int) over (partition by island order by t))::bigint as patience from i")
def patience_islands(spark, sf):
    return trace.patience(trace.rates(_series(spark, sf), 3), 0.01).select("t", "patience")


@query("select t::int as t, round(10 * pow(0.995, t) * case when t < 20 then t / 20.0::double else 1 end, 6) as lr from (select unnest(range(1, 101)) as t)")
def exponential_lr(spark, sf):
    schedule = Schedule(Options(), LossMonitor(0, 1, 0.3, 30))
    return spark.createDataFrame([(t, round(schedule.at(t), 6)) for t in range(1, 101)], "t int, lr double")


_ADAPT = _T + """, a(t, lr, up, down) as (
  select 0, 8.0::double, 0, 0 union all
  select t, case when d2 >= 2 then lr1 * 0.5 else lr1 end, u3, case when d2 >= 2 then 0 else d2 end from (
    select t, case when u2 >= 2 then lr * 1.5 else lr end as lr1, case when u2 >= 2 then 0 else u2 end as u3, d2 from (
      select a.t + 1 as t, a.lr, case when q.rate > 0.1 then a.up + 1 else 0 end as u2, case when q.rate < 0.01 then a.down + 1 else 0 end as d2
      from a join q on q.t = a.t)))
"""


@query(_ADAPT + "select t::int as t, round(lr * case when t < 3 then t / 3.0::double else 1 end, 6) as lr from a where t > 0")
def adaptive_lr(spark, sf):
    o = Options(lr_schedule="adaptive", learning_rate=8.0, lr_adapt_patience=2, lr_growth_factor=1.5, warmup_steps=3)
    monitor = LossMonitor(o.stop_loss_tol, o.stop_loss_patience, o.loss_smoothing, 3)
    schedule, rows = Schedule(o, monitor), []
    for r in _series(spark, sf).orderBy("t").collect():  # one row for each iteration, as in a run
        monitor.observe(r.loss)
        rows.append((r.t + 1, round(schedule.at(r.t + 1), 6)))
    return spark.createDataFrame(rows, "t int, lr double")


@query(_T + "select min(t)::int as t from (select t, sum((rate >= 0.05)::int) over (order by t) as island, rate from q) where rate < 0.05")
def first_stall(spark, sf):
    monitor = LossMonitor(0.05, 1, 0.3, 3)
    for r in _series(spark, sf).orderBy("t").collect():
        monitor.observe(r.loss)
        if monitor.converged:
            return spark.createDataFrame([(r.t,)], "t int")
    return spark.createDataFrame([(None,)], "t int")


# --- not expressible in SQL: sequential, random or iterated


@query()
def label_propagation(spark, sf):
    g = fixtures.succession(spark, sf)
    return coarsen.label_propagation(g, g.edges.withColumn("w", F.lit(1.0)))


@query()
def label_propagation_sequential(spark, sf):
    g = fixtures.succession(spark, sf)
    return coarsen.sequential_labels(g, g.edges.withColumn("w", F.lit(1.0)))


@query()
def hierarchy(spark, sf):
    return coarsen.layer_tables(coarsen.hierarchy(fixtures.succession(spark, sf)))[0]


@query()
def random_graph(spark, sf):
    return generators.random_disc_graph(spark, 400, seed=3)[0].edges


@query()
def girg_graph(spark, sf):
    return generators.girg(spark, 300, seed=3)[0].edges


@query()
def embedding_run(spark, sf):
    g, p = _start(spark, sf)
    e = Embedder(g, Options(dimension=2, max_iterations=3), positions=p.select("id", "p0", "p1"))
    e.run()
    return e.trace_table().drop("elapsed_ms")


@query()
def layered_run(spark, sf):
    return LayeredEmbedder(fixtures.succession(spark, sf), Options(dimension=2, max_iterations=1)).run()


@query()
def drawing(spark, sf):
    g, p = _start(spark, sf)
    points = p.select("id", F.col("p0").alias("x"), F.col("p1").alias("y"))
    shades = sinks.colors(p.select("id", F.col("w").alias("value")))
    return reduce(DataFrame.union, [sinks.svg(spark, g, points, shades), sinks.ipe(spark, g, points, shades)])


@query()
def evaluation(spark, sf):
    return metrics.evaluate(*_start(spark, sf))


_SQL["node_helpers"] = _SQL["node_helpers"].format(_D2, _INF)


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
