"""Registered queries of the topic operators over the star schema and the text tables, with SQL for the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checkpoints import cut, stored
from ..functions.text import SPACE, canonical, label_order
from ..operators import diagnostics, extract, graph, parse, planning, resolve, topics
from ..sources.vocabulary import DEFAULT, Vocabulary, read_table
from . import bench_adapter as data
from .analysis import from_mentions
from .options import Options

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Topics of the graph queries: the brands that a customer buys, so that the graph of all orders has many components.
BRANDS = {"topic": "p_brand", "each_customer": True}

#: A vocabulary for the text tables: frequent words of their languages.
WORDS = Vocabulary(
    read_table(
        """
        And | 1 | and
        From | 1 | from that, from
        Und | 2 | und
        Die | 2 | in die, die
        Dans | 3 | dans, pour
        Por | 4 | por la, por
        """
    ),
    frozenset({"And"}),
)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _canonical_sql(c: str) -> str:
    low = f"regexp_replace(lower({c}), '[’'']s([^A-Za-z0-9_]|$)', '\\1', 'g')"
    kept = f"regexp_replace(regexp_replace({low}, '[-_/]', ' ', 'g'), '[^a-z0-9+#\\s]', '', 'g')"
    stop = ", ".join(f"'{w}'" for w in ("the", "of", "using", "algorithm", "algo", "method", "problem", "technique", "approach"))
    words = f"list_filter(regexp_split_to_array({kept}, '\\s+'), lambda w: w <> '' and w not in ({stop}))"
    return f"array_to_string(list_transform({words}, lambda w: case when length(w) > 3 and w like '%s' and w not like '%ss' then w[:-2] else w end), ' ')"


def _mentions_sql(raw: str = "p_name", key: str = "p_name", recursive: str = "") -> str:
    """Common tables raws and mentions."""
    return f"""
    with {recursive} raws as (
      select year(o_orderdate) as paper, cast(year(o_orderdate) as varchar) as label, cast(o_orderdate as date) as day, o_orderkey as q, cast(substr(o_orderpriority, 1, 1) as int) as unit,
        o_totalprice as marks, l_linenumber as pos, {raw} as raw, {key} as key
      from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey),
    firsts as (select paper, label, day, q, unit, marks, key, min({{'pos': pos, 'raw': raw}}) as f from raws group by all),
    mentions as (select paper, label, day, q, unit, marks, key, f.pos as pos, f.raw as raw from firsts)"""


_M = _mentions_sql()
_RECURSIVE = _mentions_sql(recursive="recursive")
_BRANDS = _mentions_sql("o_custkey || ' ' || p_brand", "o_custkey || ' ' || lower(p_brand)", "recursive")
_TOPICS = """, shares as (select *, marks / count(*) over (partition by q) as share from mentions),
    topics as (select key, count(*) as frequency, round(sum(share), 2) as marks, count(distinct label) as papers from shares group by key)"""
_EDGES = """, edges as (select a.key as u, b.key as v, count(*) as count from mentions a join mentions b on a.q = b.q and a.key < b.key group by all)"""


# text functions

@query(f"select p_name, p_type, {_canonical_sql("p_name || '''s ' || p_type || '-Methods'")} as form from (select distinct p_name, p_type from part)")
def canonical_forms(spark, sf_dir):
    rows = data.table(spark, sf_dir, "part").select("p_name", "p_type").distinct()
    return rows.withColumn("form", canonical(F.concat("p_name", F.lit("'s "), "p_type", F.lit("-Methods"))))


@query("select cast(row_number() over (order by n) as int) as place, 'Mid ' || n as label from (select distinct l_linenumber * 3 as n from lineitem)")
def label_sort(spark, sf_dir):
    labels = data.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("Mid "), F.col("l_linenumber") * 3).alias("label")).distinct()
    return labels.agg(F.array_sort(F.collect_list(F.struct(label_order(F.col("label")).alias("o"), "label"))).alias("r")).select(F.posexplode("r").alias("i", "x")).select((F.col("i") + 1).alias("place"), "x.label")


# topic store

@query(_M + " select key, count(*) as frequency from mentions group by key")
def topic_frequency(spark, sf_dir):
    return data.mentions(spark, sf_dir).groupBy("key").agg(F.count("*").alias("frequency"))


@query(_M + _TOPICS + " select key, frequency, marks, papers from topics")
def topic_marks(spark, sf_dir):
    shared = topics.marks_share(data.mentions(spark, sf_dir))
    return shared.groupBy("key").agg(F.count("*").alias("frequency"), F.round(F.sum("share"), 2).alias("marks"), F.count_distinct("label").alias("papers"))


_STORE = (
    _M
    + """, units as (select key, unit, count(*) as n from mentions group by all),
    spelled as (select key, raw, count(*) as n from mentions group by all),
    hours as (select p_name as key, max(p_size) / 10.0 as hours from part where p_name not like '%z%' group by 1)
    select m.key, count(*) as frequency, string_agg(distinct label, ',' order by label) as years,
      (select arg_min(unit, {'n': -n, 'u': unit}) from units u where u.key = m.key) as unit,
      (select arg_min(raw, {'n': -n, 'r': raw}) from spelled s where s.key = m.key) as display,
      (select string_agg(unit || ':' || n, ',' order by unit) from units u where u.key = m.key) as unit_counts,
      coalesce((select hours from hours h where h.key = m.key), 2.0) as study_hours, exists (select 1 from hours h where h.key = m.key) as hours_set
    from mentions m group by m.key"""
)


@query(_STORE)
def topic_store(spark, sf_dir):
    table = topics.topics(data.mentions(spark, sf_dir), data.hours(spark, sf_dir))
    counts = F.array_join(F.transform(F.map_entries("unit_counts"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")
    return table.select("key", "frequency", F.array_join("years", ",").alias("years"), "unit", "display", counts.alias("unit_counts"), "study_hours", "hours_set")


@query(_M + " select key, min({'p': paper, 'q': q, 'i': pos}).q as first_question from mentions group by key")
def topic_insertion_order(spark, sf_dir):
    table = data.mentions(spark, sf_dir).groupBy("key").agg(F.min(F.struct("doc", "paper", "q", "pos")).alias("first"))
    return topics.insertion_order(table).select("key", F.col("first.q").alias("first_question"))


def _frequencies(spark, sf_dir) -> DataFrame:
    return topic_frequency(spark, sf_dir)


# ranking

@query(_M + " select key, count(*) as frequency from mentions group by key order by 2 desc, 1 limit 10")
def topic_topn(spark, sf_dir):
    return topics.top_n(_frequencies(spark, sf_dir), 10)


@query(_M + " select key, count(*) as frequency, cast(row_number() over (order by count(*) desc, key) as int) as rank from mentions group by key")
def topic_ranked(spark, sf_dir):
    return topics.ranked(_frequencies(spark, sf_dir))


@query(_M + " select key, count(*) as frequency from mentions group by key order by 1")
def topic_in_order(spark, sf_dir):
    return topics.in_order(_frequencies(spark, sf_dir))


@query(_M + " select key, count(*) as frequency from mentions where key = 'red widget' group by key")
def topic_lookup(spark, sf_dir):
    return topics.search(_frequencies(spark, sf_dir), "red widget")


@query(_M + " select key, count(*) as frequency from mentions where key like '%ring%' group by key")
def topic_search(spark, sf_dir):
    table = topics.topics(data.mentions(spark, sf_dir))
    return topics.page(table, query="RING").select("key", "frequency")


@query(_M + ", t as (select key, count(*) as frequency, (select arg_min(unit, {'n': -n, 'u': unit}) from (select unit, count(*) as n from mentions x where x.key = m.key group by 1)) as unit from mentions m group by key) select key, unit, frequency from t order by unit, frequency desc, key limit 10")
def topic_page(spark, sf_dir):
    return topics.page(topics.topics(data.mentions(spark, sf_dir)), "unit").select("key", "unit", "frequency")


# reports

@query(_M + " select key, label, count(*) as n from mentions group by all")
def breakdown(spark, sf_dir):
    return topics.breakdown_rows(data.mentions(spark, sf_dir))


@query(_M + " select key, " + ", ".join(f"count(*) filter (where label = '{y}') as y{y}" for y in range(1995, 2002)) + " from mentions group by key")
def breakdown_wide(spark, sf_dir):
    years = data.years(spark, sf_dir)
    return topics.breakdown(data.mentions(spark, sf_dir), years).withColumnsRenamed({y: f"y{y}" for y in years})


@query(_M + " select label, unit, count(distinct q) as n from mentions group by all")
def unit_split(spark, sf_dir):
    return topics.unit_split(data.mentions(spark, sf_dir))


@query(_M + ", c as (select unit, count(distinct q) as n from mentions group by unit) select unit, n, cast(floor(100.0 * n / sum(n) over () + 0.5) as int) as percent from c")
def unit_totals(spark, sf_dir):
    return topics.unit_totals(data.mentions(spark, sf_dir))


@query(_M + _TOPICS + """, asked as (select distinct q, marks from mentions)
    select (select cast(count(distinct label) as int) from mentions) as papers, (select count(*) from asked) as questions, (select round(sum(marks), 2) from asked) as marks, count(*) as topics,
      count(*) filter (where papers = (select count(distinct label) from mentions)) as in_every_paper, arg_min(key, {'f': -frequency, 'k': key}) as lead, max(frequency) as lead_frequency from topics""")
def kpis(spark, sf_dir):
    m = data.mentions(spark, sf_dir)
    return topics.kpis(m, topics.topics(m), data.paper_count(spark, sf_dir)).withColumn("marks", F.round("marks", 2)).drop("lead_papers")


@query(_M + ", t as (select key, count(*) as frequency, cast(count(distinct label) as int) as in_papers from mentions group by key order by 2 desc, 1 limit 12) select t.key, t.key as display, frequency, in_papers, (select cast(count(distinct label) as int) from mentions) as total, label, count(*) as n from t join mentions m on m.key = t.key group by all")
def heatmap(spark, sf_dir):
    m = data.mentions(spark, sf_dir)
    return topics.heatmap(m, topics.topics(m), n_papers=data.paper_count(spark, sf_dir))


@query(_M + _TOPICS + " select key, key as display, frequency, cast(papers as int) as papers, papers / (select count(distinct label) from mentions) as share, 0 as n_others from topics")
def topic_table(spark, sf_dir):
    m = data.mentions(spark, sf_dir)
    return topics.topic_table(topics.topics(m), data.paper_count(spark, sf_dir)).select("key", "display", "frequency", "papers", "share", F.size("others").alias("n_others"))


@query(_STORE.replace("select m.key, count(*) as frequency", "select key, least(20.0, greatest(0.5, study_hours + 0.5)) as study_hours from (select m.key, count(*) as frequency") + ")")
def hours_step(spark, sf_dir):
    table = topics.topics(data.mentions(spark, sf_dir), data.hours(spark, sf_dir))
    return table.select("key", topics.stepped(F.col("study_hours"), 0.5).alias("study_hours"))


# graph

@query(_M + _EDGES + " select u, v, count, 1.0::double / count as weight from edges")
def edges_question(spark, sf_dir):
    return graph.edges(data.mentions(spark, sf_dir))


@query(_M + ", g as (select distinct label, unit, key from mentions) select a.key as u, b.key as v, count(*) as count, 1.0::double / count(*) as weight from g a join g b on a.label = b.label and a.unit = b.unit and a.key < b.key group by all")
def edges_unit(spark, sf_dir):
    return graph.edges(data.mentions(spark, sf_dir), "unit")


@query(_M + _EDGES + """, t as (select key, arg_min(unit, {'n': -n, 'u': unit}) as unit from (select key, unit, count(*) as n from mentions group by all) group by key),
    b as (select x.unit as a, y.unit as b, count from edges join t x on x.key = u join t y on y.key = v),
    f as (select a, b, count from b union all select b, a, count from b where a <> b)
    select cast(i as int) as unit_a, cast(j as int) as unit_b, cast(coalesce((select sum(count) from f where a = i and b = j), 0) as bigint) as n from range(1, 6) r(i), range(1, 6) s(j)""")
def unit_matrix(spark, sf_dir):
    m = data.mentions(spark, sf_dir)
    return graph.unit_matrix(graph.edges(m), topics.topics(m))


def _graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(table, edges) of all orders."""
    m = data.mentions(spark, sf_dir, **BRANDS)
    return cut(m.groupBy("key").agg(F.count("*").alias("frequency"))), cut(graph.edges(m))


def _sets(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(table, sets) of all orders, for what needs no edges."""
    keys = stored(graph.sets(data.mentions(spark, sf_dir, **BRANDS)))
    return graph.frequencies(keys), keys


_REACH = ", adj as (select u, v from edges union all select v, u from edges), reach as (select key as a, key as b from (select distinct key from mentions) union select reach.a, adj.v from reach join adj on reach.b = adj.u)"


@query(_BRANDS + _EDGES + _REACH + " select a as key, min(b) as component from reach group by a")
def graph_components(spark, sf_dir):
    return graph.components(*_sets(spark, sf_dir))


@query(_BRANDS + _EDGES + _REACH + """, c as (select a as key, min(b) as component from reach group by a),
    f as (select key, count(*) as frequency from mentions group by key),
    g as (select component, string_agg(key, ',' order by frequency desc, key) as keys, cast(sum(frequency) as bigint) as frequency, min({'f': -frequency, 'k': key}) as best from c join f using (key) group by component)
    select cast(row_number() over (order by best) as int) as cluster, keys, frequency from g""")
def graph_clusters(spark, sf_dir):
    return graph.clusters(*_sets(spark, sf_dir)).withColumn("keys", F.array_join("keys", ","))


@query(_BRANDS + _EDGES + _REACH + " select a as key from reach group by a having count(*) = 1")
def graph_solo(spark, sf_dir):
    return graph.solo(graph.clusters(*_sets(spark, sf_dir))).select("key")


@query(_BRANDS + _EDGES + """, ranked as (select *, row_number() over (order by count desc, u || v, u) as r from edges),
    adj as (select u, v, r from ranked union all select v, u, r from ranked),
    reach as (select r as e, u as x from ranked union select e, adj.v from reach join adj on adj.u = reach.x and adj.r < reach.e)
    select u, v, count, cast(row_number() over (order by r) as int) as ord from ranked where not exists (select 1 from reach where e = r and x = v)""")
def graph_spanning_forest(spark, sf_dir):
    return graph.spanning_forest(_graph(spark, sf_dir)[1]).select("u", "v", "count", "ord")


def _start(table: DataFrame, edge: DataFrame) -> str:
    return graph.default_source(table, edge).first()["key"]


_ADJ = """, adj as (select u, v, count from edges union all select v, u, count from edges),
    start as (select key from mentions where exists (select 1 from adj where u = key) group by key order by count(*) desc, key limit 1)"""
_WALK = _ADJ + """, walk(key, level) using key (key) as (
      select key, 0 as level from start union select adj.v, min(level) + 1 from walk join adj on adj.u = walk.key where adj.v not in (select key from recurring.walk) group by adj.v)"""
# paths by (count, key) of their steps: the order in which a queue gives vertices is that of the least path
_QUEUE = _WALK + """, ways as (
      select key, 0 as level, [{'c': cast(0 as bigint), 'k': key}] as path from start
      union all select adj.v, ways.level + 1, list_append(path, {'c': -adj.count, 'k': adj.v}) from ways join adj on adj.u = ways.key join walk on walk.key = adj.v and walk.level = ways.level + 1),
    least as (select key, min(level) as level, min(path) as path from ways group by key)
    select cast(row_number() over (order by level, path) as int) as ord, key, level, case when level > 0 then path[-2].k end as parent from least"""
_DISTANCES = _ADJ + """, best(key, dist, path) using key (key) as (
      select key, cast(0 as double) as dist, [key] as path from start
      union select n.key, n.w.d, n.w.p from (
        select adj.v as key, min({'d': best.dist + 1.0::double / adj.count, 'p': list_append(best.path, adj.v)}) as w from best join adj on adj.u = best.key where not list_contains(best.path, adj.v) group by adj.v) n
      left join recurring.best r on r.key = n.key where r.key is null or n.w.d < r.dist or (n.w.d = r.dist and n.w.p < r.path))"""


@query(_BRANDS + _EDGES + _WALK + " select key, level from walk")
def graph_bfs_levels(spark, sf_dir):
    table, edge = _graph(spark, sf_dir)
    return graph.breadth_first(table, edge, _start(table, edge)).select("key", "level")


@query(_BRANDS + _EDGES + _QUEUE)
def graph_bfs(spark, sf_dir):
    table, edge = _graph(spark, sf_dir)
    return graph.breadth_first(table, edge, _start(table, edge))


@query(_BRANDS + _EDGES + _ADJ + """, near as (select u, list(v order by v) as vs from (select distinct u, v from adj) group by u),
    walk as (
      select 1 as step, [key] as seen, [key] as stack from start
      union all select step + 1, case when next is null then seen else list_append(seen, next) end, case when next is null then stack[:-2] else list_append(stack, next) end
      from (select walk.*, list_filter(vs, lambda x: not list_contains(seen, x))[1] as next from walk join near on u = stack[-1])),
    last as (select seen from walk order by step desc limit 1)
    select cast(unnest(range(1, len(seen) + 1)) as int) as ord, unnest(seen) as key from last""")
def graph_dfs(spark, sf_dir):
    table, keys = _sets(spark, sf_dir)
    return graph.depth_first(table, keys, _start(table, keys))


_PRIM = _REACH + """, c as (select a as key, min(b) as component from reach group by a),
    f as (select key, count(*) as frequency from mentions group by key),
    starts as (select component, min({'f': -frequency, 'k': key}) as best from c join f using (key) group by component),
    ranked as (select component, best.k as start, cast(row_number() over (order by best) as int) as cluster from starts),
    lines as (select cluster, x.u, x.v, count from (select u, v, count from edges union all select v, u, count from edges) x join c on c.key = x.u join ranked using (component)),
    walk as (
      select cluster, 1 as ord, start as key, cast(null as varchar) as via, cast(null as bigint) as count, cast(0 as double) as total, [start] as seen from ranked
      union all select cluster, ord + 1, e.v, seen[e.p], -e.c, total + 1.0::double / -e.c, list_append(seen, e.v) from (
        select walk.cluster, ord, total, seen, min({'c': -lines.count, 'v': lines.v, 'p': list_position(seen, lines.u)}) as e
        from walk join lines on lines.cluster = walk.cluster and list_contains(seen, lines.u) and not list_contains(seen, lines.v) group by all))"""


@query(_BRANDS + _EDGES + _PRIM + " select cluster, ord, key, via, count, round(total, 9) as total from walk")
def graph_prim(spark, sf_dir):
    table, keys = _sets(spark, sf_dir)
    return graph.prim(graph.clusters(table, keys), keys).withColumn("total", F.round("total", 9))


@query(_BRANDS + _EDGES + _DISTANCES + " select key, round(dist, 9) as dist, array_to_string(path, ' > ') as path from best")
def graph_distances(spark, sf_dir):
    table, edge = _graph(spark, sf_dir)
    return graph.distances(table, edge, _start(table, edge)).select("key", F.round("dist", 9).alias("dist"), F.array_join("path", " > ").alias("path"))


@query(_BRANDS + _EDGES + _DISTANCES + " select key, round(dist, 9) as dist, array_to_string(path, ' > ') as path from best where len(path) > 1 order by best.dist desc, key limit 1")
def graph_bridge(spark, sf_dir):
    """Path from the default source to the topic farthest from it."""
    table, edge = _graph(spark, sf_dir)
    start = _start(table, edge)
    found = graph.distances(table, edge, start)
    return found.join(graph.farthest(found, start).select("key"), "key").select("key", F.round("dist", 9).alias("dist"), F.array_join("path", " > ").alias("path"))


# planning

_ITEMS = _STORE.replace(_M, _RECURSIVE).replace("from mentions m group by m.key", "from mentions m group by m.key)").replace("select m.key, count(*) as frequency", ", store as (select m.key, count(*) as frequency", 1) + """,
    items as (select row_number() over (order by key) as i, key, study_hours as h, cast(frequency as double) as v, cast(greatest(1, ceil(study_hours * 2 - 1e-9)) as int) as w,
      (select floor(sum(share) * 10 + 0.5) / 10 from (select key as k, marks / count(*) over (partition by q) as share from mentions) where k = key) as m from store)"""


_CHOICE = """, dp as (
      select cast(0 as bigint) as i, list_transform(range(25), lambda x: {{'v': cast(0 as double), 'h': cast(0 as double), 'k': cast([] as varchar[])}}) as best
      union all select dp.i + 1, list_transform(range(25), lambda c: case when c >= t.w and dp.best[greatest(c - t.w, 0) + 1].v + t.{value} > dp.best[c + 1].v
        then {{'v': dp.best[c - t.w + 1].v + t.{value}, 'h': dp.best[c - t.w + 1].h + t.h, 'k': list_append(dp.best[c - t.w + 1].k, t.key)}} else dp.best[c + 1] end)
      from dp join items t on t.i = dp.i + 1),
    chosen as (select best[25] as plan from dp order by i desc limit 1)"""


@query(_ITEMS + _CHOICE.format(value="v") + " select plan.v as value, cast(24 as int) as slots, round(plan.h, 6) as hours, array_to_string(plan.k, ',') as chosen from chosen")
def plan_knapsack(spark, sf_dir):
    return planning.knapsack(_items(spark, sf_dir), 12).select("value", "slots", F.round("hours", 6).alias("hours"), F.array_join("chosen", ",").alias("chosen"))


def _items(spark, sf_dir) -> DataFrame:
    return planning.items(topics.topics(data.mentions(spark, sf_dir), data.hours(spark, sf_dir)))


@query(_ITEMS + """, ordered as (select row_number() over (order by v desc, h, key) as j, h, v from items),
    walk as (select cast(0 as bigint) as j, cast(12.0 as double) as room, cast(0 as double) as value
      union all select walk.j + 1, case when h <= room + 1e-9 then room - h else room end, case when h <= room + 1e-9 then value + v else value end from walk join ordered o on o.j = walk.j + 1)
    select cast(value as double) as value, round(12.0 - room, 6) as hours from walk order by j desc limit 1""")
def plan_greedy(spark, sf_dir):
    return planning.greedy(_items(spark, sf_dir), 12).select("value", F.round("hours", 6).alias("hours"))


@query(_ITEMS + _CHOICE.format(value="v") + ", list as (select unnest(plan.k) as key, plan.h as used from chosen) select key, display, frequency, study_hours, round(least(1.0, used / 12), 6) as used from list join store using (key)")
def plan_list(spark, sf_dir):
    table = cut(topics.topics(data.mentions(spark, sf_dir), data.hours(spark, sf_dir)))
    return planning.plan_list(planning.knapsack(planning.items(table), 12), table, 12).withColumn("used", F.round("used", 6))


@query(_ITEMS + _CHOICE.format(value="m") + " select round(plan.v, 1) as value, round((select sum(m) from items), 1) as total, round(plan.v / (select sum(m) from items), 9) as share from chosen")
def plan_by_marks(spark, sf_dir):
    item = cut(planning.items(topics.topics(data.mentions(spark, sf_dir), data.hours(spark, sf_dir)), "marks"))
    found = planning.coverage(item, planning.knapsack(item, 12))
    return found.select(F.round("value", 1).alias("value"), F.round("total", 1).alias("total"), F.round("share", 9).alias("share"))


@query()
def paper_overlap(spark, sf_dir):
    """LCS of the topic sequences of all years."""
    papers = data.raw_mentions(spark, sf_dir).select("doc", "paper", "label").distinct()  # those of the mentions, without grouping them
    return planning.paper_similarity(papers, data.mentions(spark, sf_dir))


# resolution

#: Tables letters and scored (a, b, score) of pairs (a, b): the subsequence's length by a bit for each letter of a that is still free.
_SCORED = """, letters as (select a, substr(a, cast(i as int), 1) as letter, sum(cast(1 as hugeint) << cast(i - 1 as int)) as bits from (select a, unnest(range(1, length(a) + 1)) as i from (select distinct a from pairs)) group by all),
    steps as (
      select a, b, 0 as i, (cast(1 as hugeint) << length(a)) - 1 as free from pairs
      union all select a, b, i + 1, ((free + hit) | (free - hit)) & ((cast(1 as hugeint) << length(a)) - 1) from (
        select s.a, s.b, s.i, s.free, s.free & coalesce(l.bits, 0) as hit from steps s left join letters l on l.a = s.a and l.letter = substr(s.b, s.i + 1, 1) where s.i < length(s.b))),
    scored as (select a, b, (length(a) - bit_count(free)) / greatest(length(a), length(b)) as score from steps where i = length(b))"""
_DROPPED = "case when q % 3 = 0 then substr(raw, 1, 2) || substr(raw, 4, 100) else raw end"


@query(_RECURSIVE + f""", spelled as (select {_DROPPED} as raw, min({{'p': paper, 'q': q, 'i': pos}}) as at_line from raws group by 1),
    named as (select {_canonical_sql("raw")} as form, min(at_line) as at_line from spelled group by 1),
    forms as (select form, cast(row_number() over (order by at_line, form) as int) as ord from named where form <> ''),
    pairs as (select x.form as a, y.form as b from forms x join forms y on x.ord < y.ord)""" + _SCORED + """,
    near as (select f.form, f.ord, list(s.a order by s.score desc, g.ord) filter (where s.score >= 0.8) as before, list(s.score order by s.score desc, g.ord) filter (where s.score >= 0.8) as scores
      from forms f left join scored s on s.b = f.form left join forms g on g.form = s.a group by all),
    walk as (
      select 0 as ord, cast([] as varchar[]) as leaders, cast(null as varchar) as form, cast(null as varchar) as key, cast(null as double) as score
      union all select ord, case when one is null then list_append(leaders, form) else leaders end, form, coalesce(before[one], form), scores[one] from (
        select n.ord, leaders, n.form, before, scores, list_filter(range(1, len(before) + 1), lambda i: list_contains(leaders, before[i]))[1] as one from walk w join near n on n.ord = w.ord + 1))
    select form, ord, key, score from walk where ord > 0""")
def resolved_names(spark, sf_dir):
    """Names of parts with a letter dropped here and there, resolved to their first spellings."""
    dropped = F.when(F.col("q") % 3 == 0, F.concat(F.substring("raw", 1, 2), F.substring("raw", 4, 100))).otherwise(F.col("raw"))
    raws = data.raw_mentions(spark, sf_dir).withColumn("raw", dropped)
    found = resolve.resolve(raws, threshold=0.8)
    return found.forms.select("form", "ord", "key", "score")


@query(f"with recursive forms as (select distinct {_canonical_sql("p_name || ' ' || p_type")} as form from part), pairs as (select x.form as a, y.form as b from forms x join forms y on x.form < y.form)" + _SCORED + " select a, b, score from scored where score >= 0.75")
def similar_names(spark, sf_dir):
    forms = data.table(spark, sf_dir, "part").select(canonical(F.concat_ws(" ", "p_name", "p_type")).alias("form"))
    return resolve.similar_pairs(forms, 0.75)


# free text and the structured format

@query(f"""with forms as (select doc_id, ' ' || {_canonical_sql("coalesce(text, '')")} || ' ' as t from documents),
    hits as (select doc_id, [x for x in [
      case when contains(t, ' and ') then 'And' end, case when contains(t, ' from ') then 'From' end, case when contains(t, ' und ') then 'Und' end,
      case when contains(t, ' die ') then 'Die' end, case when contains(t, ' dan ') or contains(t, ' pour ') then 'Dans' end, case when contains(t, ' por ') then 'Por' end] if x is not null] as h from forms)
    select doc_id, array_to_string(list_sort(case when len(h) > 1 then list_filter(h, lambda x: x <> 'And') else h end), ',') as topics from hits""")
def document_topics(spark, sf_dir):
    docs = data.table(spark, sf_dir, "documents")
    found = extract.specific(extract.find_topics(F.coalesce("text", F.lit("")), WORDS), WORDS)
    return docs.select("doc_id", F.array_join(F.array_sort(found), ",").alias("topics"))


def _phrases() -> list[tuple[int, str]]:
    """All phrases of the default vocabulary, numbered."""
    return list(enumerate(p for t in DEFAULT.topics for p in t.phrases))


_HELD = ", ".join(f"({k}, '{form}', '{topic}', {topic in DEFAULT.generic})" for k, (form, topic) in enumerate(extract.phrase_table(DEFAULT)))
_ASKED_PHRASES = ", ".join(f"({k}, '{extract.canonical_text(p)}')" for k, p in _phrases())


@query(f"""with asked as (select * from (values {_ASKED_PHRASES}) t(k, form)), held as (select * from (values {_HELD}) t(r, form, topic, generic)),
    -- the longest phrase that a phrase holds covers the others; a topic stands at the first place of the longest of its phrases
    named as (select a.k, h.r, h.topic, h.generic from asked a join held h on h.form = a.form qualify row_number() over (partition by a.k order by h.r) = 1),
    hits as (select l_orderkey as q, r, {{'n': l_linenumber, 'p': l_partkey}} as at_line, topic, generic from lineitem join named on k = l_partkey % {len(_phrases())}),
    picked as (select q, topic, generic, min({{'r': r, 'p': at_line}}).p as place from hits group by q, topic, generic),
    told as (select *, bool_and(generic) over (partition by q) as only_generic from picked)
    select q, string_agg(topic, ',' order by place) as topics from told where only_generic or not generic group by q""")
def order_topics(spark, sf_dir):
    """Topics of the default vocabulary, in order of appearance, in a sentence for each order that names a phrase a line."""
    names = _phrases()
    phrase = F.get(F.array(*[F.lit(p) for _, p in names]), (F.col("l_partkey") % len(names)).cast("int"))
    lines = data.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", phrase.alias("phrase"))
    texts = lines.groupBy(F.col("l_orderkey").alias("q")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "phrase"))), lambda x: x["phrase"]), ", and after that one should turn to ").alias("text"))
    found = extract.specific(extract.find_topics(F.col("text"), DEFAULT), DEFAULT)
    return texts.select("q", F.array_join(found, ",").alias("topics"))


def _questions_sql() -> str:
    """Blocks of lines, and in each the words' phrases: longest first, and blanked (twice, as neighbours share a space) before the next is looked for."""
    phrases = extract.phrase_table(WORDS)
    texts = [f"(select *, ' ' || {_canonical_sql('text')} || ' ' as t0 from blocks)"]
    for k, (form, _) in enumerate(phrases):
        blank = "replace({}, ' " + form + " ', ' |" + " " * (len(form) - 1) + "| ')"
        texts.append(f"(select *, instr(t{k}, ' {form} ') as p{k}, {blank.format(blank.format(f't{k}'))} as t{k + 1} from {texts[-1]})")
    places = ", ".join("{'p': coalesce(" + ", ".join(f"nullif(p{k}, 0)" for k, (_, name) in enumerate(phrases) if name == t.name) + f"), 't': '{t.name}', 'u': {t.unit}}}" for t in WORDS.topics)
    blank, word = "[" + re.sub(r"\\u(\w{4})", r"\\x{\1}", SPACE) + "]", "([^A-Za-z0-9_]|$)"
    unit = rf"(?i)^unit ?[-–:.]? ?(\d|i{{1,3}}|iv|v){word}"
    start = r"(?i)^(?:q(?:ues(?:tion)?)? ?\.? ?(\d{1,2}) ?[.):-]?|(\d{1,2}) ?[.)]|\( ?([a-j]|[ivx]{1,4}) ?\)|([a-j]) ?[.)]) "
    marks = rf"(?i)[(\[]? ?(\d{{1,2}}) ?marks?{word}|\[ ?(\d{{1,2}}) ?\] ?$"
    return rf"""
    with split as (select doc_id as doc, regexp_split_to_array(coalesce(text, ''), '\r?\n') as l from documents),
    cut as (select doc, unnest(range(1, len(l) + 1)) as line_no, trim(regexp_replace(unnest(l), '{blank}+', ' ', 'g')) as line from split),
    marked as (select *, regexp_matches(line, '{unit}') as is_unit, lower(regexp_extract(line, '{unit}', 1)) as named, regexp_matches(line, '{start}') as starts,
      nullif(regexp_extract(line, '{start}', 1) || regexp_extract(line, '{start}', 2), '') as number, lower(regexp_extract(line, '{start}', 3) || regexp_extract(line, '{start}', 4)) as part from cut where line <> ''),
    state as (select *, sum(starts::int) over upto as block, last_value(case when is_unit then coalesce(nullif(list_position(['i', 'ii', 'iii', 'iv', 'v'], named), 0), try_cast(named as int), 0) end ignore nulls) over upto as unit_here,
      last_value(number ignore nulls) over upto as last_number, sum(starts::int) over (partition by doc) as n, row_number() over (partition by doc order by line_no) as line_at
      from marked window upto as (partition by doc order by line_no rows unbounded preceding)),
    blocks as (
      select doc, cast(block as bigint) as block, arg_min('Q' || coalesce(last_number, cast(block as varchar)) || part, line_no) as id, arg_min(coalesce(unit_here, 0), line_no) as unit,
        string_agg(case when starts then regexp_replace(line, '{start}', '') else line end, ' ' order by line_no) as text
      from state where n > 0 and block > 0 and (starts or not is_unit) group by doc, block
      union all select doc, line_at, 'Q' || line_at, 0, line from state where n = 0),
    found as (select *, list_sort(list_filter([{places}], lambda x: x.p is not null)) as hits from {texts[-1]}),
    named as (select *, case when len(list_filter(hits, lambda x: x.t <> 'And')) > 0 then list_filter(hits, lambda x: x.t <> 'And') else hits end as told from found)
    select doc, block, id, cast(coalesce(nullif(unit, 0), told[1].u, 0) as int) as unit, try_cast(nullif(regexp_extract(text, '{marks}', 1) || regexp_extract(text, '{marks}', 3), '') as double) as marks,
      array_to_string(list_transform(told, lambda x: x.t), ',') as topics from named"""


@query(_questions_sql())
def document_questions(spark, sf_dir):
    docs = data.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    return extract.extract_questions(docs, WORDS).withColumn("topics", F.array_join("topics", ","))


@query(r"select doc_id, try_cast(nullif(regexp_extract(substr(coalesce(text, ''), 1, 3000), '\b((?:19|20)\d{2})\b', 1), '') as int) as year, coalesce(regexp_matches(text, '(?m)^\s*(?:={2,}.+={2,}|@paper\b)'), false) as structured from documents")
def document_years(spark, sf_dir):
    docs = data.table(spark, sf_dir, "documents")
    return docs.select("doc_id", extract.detect_year(F.coalesce("text", F.lit("")), F.lit("")).alias("year"), extract.is_structured(F.col("text")).alias("structured"))


def _structured(spark, sf_dir) -> DataFrame:
    """(doc, label, text): all orders written in the structured format, a text a day."""
    m = data.mentions(spark, sf_dir, daily=True)
    rows = F.array_sort(F.collect_list(F.struct("pos", "raw")))
    asked = m.groupBy("doc", "q", "id", "unit", "marks").agg(F.transform(rows, lambda x: x["raw"]).alias("topics"))
    blocks = asked.select("doc", F.col("q").alias("block"), "id", "unit", F.round("marks").alias("marks"), "topics")
    papers = m.select("doc", "label").distinct()
    return extract.to_structured(blocks, papers)


_ASKED = ", asked as (select label, day, 'Q' || q as id, q, unit, round(marks) as marks, count(*) as n_topics, string_agg(raw, ',' order by pos, raw) as topics, string_agg(raw, ', ' order by pos, raw) as list from mentions group by all)"


@query(_M + _ASKED + " select label, id, unit, marks, n_topics, topics from asked")
def structured_round_trip(spark, sf_dir):
    return _round_trip(_structured(spark, sf_dir))


def _round_trip(texts: DataFrame) -> DataFrame:
    parsed = parse.parse(texts.select("doc", "text"))
    return parsed.questions.select("label", "id", "unit", "marks", F.size("topics").cast("long").alias("n_topics"), F.array_join("topics", ",").alias("topics"))


@query(_M + _ASKED + """, units as (select day, label, unit, '[Unit ' || unit || ']' || chr(10) || string_agg(id || ' (' || cast(marks as bigint) || '): ' || list, chr(10) order by q) as lines from asked group by day, label, unit)
    select cast(day - date '1970-01-01' as int) as doc, label, '=== ' || label || ' ===' || chr(10) || string_agg(lines, chr(10) order by unit) || chr(10) as text from units group by day, label""")
def structured_texts(spark, sf_dir):
    return _structured(spark, sf_dir)


# diagnostics and the whole analysis

@query()
def tree_heights(spark, sf_dir):
    return diagnostics.heights(diagnostics.lookups(data.mentions(spark, sf_dir)))


@query()
def tree_shape(spark, sf_dir):
    return diagnostics.tree_shape(diagnostics.lookups(data.mentions(spark, sf_dir)))


@query(_BRANDS + _EDGES + _PRIM + """, spelled as (select key, arg_min(raw, {'n': -n, 'r': raw}) as display from (select key, raw, count(*) as n from mentions group by all) group by key),
    large as (select cluster from walk group by cluster having count(*) > 1)
    select cluster, ord, key, x.display, y.display as via_display, count from walk join large using (cluster) join spelled x using (key) left join spelled y on y.key = via""")
def analysis(spark, sf_dir):
    """Resolution, store, clusters and Prim's route of all orders in one result."""
    raws = data.raw_mentions(spark, sf_dir, **BRANDS)
    result = from_mentions(raws.select("doc", "paper", "label").distinct(), raws, Options(threshold=1.0))
    return result.groups().select("cluster", "ord", "key", "display", "via_display", "count")
