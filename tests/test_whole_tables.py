"""Queries without SQL run over all orders: against plain Python on the smallest tables."""

import importlib
from collections import Counter, defaultdict
from itertools import combinations

import pyarrow.parquet as pq
import pytest

from topicwright.functions.sequences import common_length, longest_common
from topicwright.operators import diagnostics, extract, graph, planning
from topicwright.plans import bench_adapter

QUERIES = importlib.import_module("__spark_entry__").queries()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def orders():
    """The customer's brands in each order."""
    customer = {x["o_orderkey"]: x["o_custkey"] for x in pq.read_table(f"{SF}/orders.parquet", columns=["o_orderkey", "o_custkey"]).to_pylist()}
    brand = {x["p_partkey"]: x["p_brand"].lower() for x in pq.read_table(f"{SF}/part.parquet", columns=["p_partkey", "p_brand"]).to_pylist()}
    found = defaultdict(set)
    for x in pq.read_table(f"{SF}/lineitem.parquet", columns=["l_orderkey", "l_partkey"]).to_pylist():
        if x["l_orderkey"] in customer and x["l_partkey"] in brand:
            found[x["l_orderkey"]].add(f"{customer[x['l_orderkey']]} {brand[x['l_partkey']]}")
    return found


@pytest.fixture(scope="module")
def forest(orders):
    """(edges of Kruskal's walk, component of each part) by a union of sets."""
    count = Counter(p for parts in orders.values() for p in combinations(sorted(parts), 2))
    root = {k: k for parts in orders.values() for k in parts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    taken = []
    for (u, v), n in sorted(count.items(), key=lambda e: (1 / e[1], e[0][0] + e[0][1], e[0][0])):
        a, b = sorted((find(u), find(v)))
        if a != b:
            root[b] = a
            taken.append((u, v, n))
    return taken, {k: find(k) for k in root}


def test_graph(spark, orders, forest):
    taken, component = forest
    assert {r.key: r.component for r in QUERIES["graph_components"](spark, SF).collect()} == component
    assert [tuple(r) for r in QUERIES["graph_spanning_forest"](spark, SF).orderBy("ord").select("u", "v", "count").collect()] == taken
    order = [r.key for r in QUERIES["graph_dfs"](spark, SF).orderBy("ord").collect()]
    near = defaultdict(set)
    for parts in orders.values():
        for u, v in combinations(parts, 2):
            near[u].add(v)
            near[v].add(u)
    assert order == walk(near, order[0]) and set(order) == {k for k in component if component[k] == component[order[0]]}


def walk(near, at, seen=None):
    seen = {} if seen is None else seen
    seen[at] = None
    for v in sorted(near[at]):
        if v not in seen:
            walk(near, v, seen)
    return list(seen)


def test_prim(spark, orders):
    """Each cluster by the definition: the lightest edge to a new vertex, of equals to the least key, then from the earliest."""
    count = Counter(p for parts in orders.values() for p in combinations(sorted(parts), 2))
    near = defaultdict(dict)
    for (u, v), n in count.items():
        near[u][v] = near[v][u] = n
    clusters = defaultdict(list)
    for r in QUERIES["graph_prim"](spark, SF).orderBy("cluster", "ord").collect():
        clusters[r.cluster].append((r.key, r.via, r["count"]))
    assert sum(map(len, clusters.values())) == len({k for parts in orders.values() for k in parts})
    for rows in list(clusters.values())[:40]:
        place = {rows[0][0]: 0}
        for key, via, n in rows[1:]:
            best = min((1 / m, v, place[u], u, m) for u in place for v, m in near[u].items() if v not in place)
            assert (key, via, n) == (best[1], best[3], best[4])
            place[key] = len(place)


def test_trees(spark):
    rows = pq.read_table(f"{SF}/lineitem.parquet", columns=["l_orderkey", "l_partkey", "l_linenumber"]).to_pylist()
    year = {x["o_orderkey"]: x["o_orderdate"].year for x in pq.read_table(f"{SF}/orders.parquet", columns=["o_orderkey", "o_orderdate"]).to_pylist()}
    name = {x["p_partkey"]: x["p_name"] for x in pq.read_table(f"{SF}/part.parquet", columns=["p_partkey", "p_name"]).to_pylist()}
    first = {}
    for x in rows:
        if x["l_orderkey"] in year and x["l_partkey"] in name:
            at = (year[x["l_orderkey"]], x["l_orderkey"], name[x["l_partkey"]])
            first[at] = min(first.get(at, 99), x["l_linenumber"])
    tree, plain = diagnostics.Balanced(), diagnostics.Plain()
    for (y, q, key), pos in sorted(first.items(), key=lambda e: (e[0][0], e[0][1], e[1], e[0][2])):
        tree.add(key)
        plain.add(key)
    shape = QUERIES["tree_shape"](spark, SF).first()
    assert (shape["size"], shape["comparisons"], shape["height"], list(shape["pre"])) == (tree.size, tree.comparisons, diagnostics.height(tree.root), tree.walk("pre"))
    assert QUERIES["tree_heights"](spark, SF).first()["plain"] == plain.height


def test_paper_overlap(spark):
    m = QUERIES["paper_overlap"](spark, SF).collect()
    mentions = bench_adapter.mentions(spark, SF).orderBy("paper", "q", "pos", "key").collect()
    keys = defaultdict(list)
    for r in mentions:
        keys[r.label].append(r.key)
    assert len(m) == len(keys) ** 2
    for r in m:
        if r.a_ord <= 2:
            n, _ = longest_common(keys[r.a_label], keys[r.b_label])
            assert abs(r.similarity - n / max(len(keys[r.a_label]), len(keys[r.b_label]))) < 1e-12


def test_papers_without_grouping(spark, monkeypatch):
    """The list of papers is the mentions' own, without grouping all lines by order and key again."""
    given = []
    monkeypatch.setattr(planning, "paper_similarity", lambda *tables: given.append(tables) or tables[0])
    QUERIES["paper_overlap"](spark, SF)
    papers, mentions = given[0]
    assert sorted(papers.collect()) == sorted(mentions.select("doc", "paper", "label").distinct().collect())
    assert papers._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_resolved_names(spark):
    """All lines, one by one: a form joins the most similar leader before it."""
    rows = bench_adapter.raw_mentions(spark, SF).orderBy("paper", "q", "pos").collect()
    forms = {}
    for r in sorted(rows, key=lambda r: (r.paper, r.q, r.pos)):
        raw = r.raw[:2] + r.raw[3:] if r.q % 3 == 0 else r.raw
        forms.setdefault(extract.canonical_text(raw), (r.paper, r.q, r.pos))
    key = {}
    for form in sorted(forms, key=lambda f: (forms[f], f)):
        near = [(common_length(form, k) / max(len(form), len(k)), -i, k) for i, k in enumerate(k for k in key if key[k] == k)]
        best = max((x for x in near if x[0] >= 0.8), default=None)
        key[form] = best[2] if best else form
    assert {r.form: r.key for r in QUERIES["resolved_names"](spark, SF).collect()} == key


@pytest.mark.parametrize("name", ["graph_components", "graph_clusters", "graph_solo", "graph_dfs", "graph_prim"])
def test_without_edges(spark, monkeypatch, name):
    """These need no table of all edges, which is far larger than the orders."""

    def made(*_):
        raise AssertionError("edges of all orders")

    monkeypatch.setattr(graph, "edges", made)
    assert QUERIES[name](spark, SF).count()
