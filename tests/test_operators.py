import itertools
import math

import pytest
from pyspark.sql import functions as F

from topicwright.functions.sequences import common_size, lcs, lcs_length, lcs_size, longest_common, similarity, string_similarity
from topicwright.functions.text import canonical, label_order
from topicwright.operators import diagnostics, extract, graph, parse, planning, resolve, topics
from topicwright.operators.planning import knapsack_of
from topicwright.plans.analysis import analyse
from topicwright.plans.options import Options


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def strings(spark, values, name="s"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")


CANONICAL = {
    "A.V.L. Trees": "avl tree",
    "Dijkstra's Algorithm": "dijkstra",
    "N-Queens Problem": "n queen",
    "Sorting Algorithms": "sorting algorithm",
    "0/1 Knapsack": "0 1 knapsack",
    "B+ Trees": "b+ tree",
    "The of": "",
    "Floyd Warshall’s  class": "floyd warshall class",
}


def test_canonical(spark):
    rows = strings(spark, CANONICAL).select("s", canonical(F.col("s")).alias("c")).collect()
    assert {r.s: r.c for r in rows} == CANONICAL
    assert all(extract.canonical_text(k) == v for k, v in CANONICAL.items())


def test_labels_sort_by_number(spark):
    rows = strings(spark, ["Mid 10", "mid 2", "2021", "Mid 9"]).orderBy(label_order(F.col("s"))).collect()
    assert [r.s for r in rows] == ["2021", "mid 2", "Mid 9", "Mid 10"]


PAIRS = [("ABCBDAB", "BDCABA", 4), ("abc", "ac", 2), ("", "", 0), ("", "x", 0), ("heap sort", "heapsort", 8), ("aaaa", "aa", 2)]


def test_lcs(spark):
    rows = spark.createDataFrame([(list(a), list(b), a, b) for a, b, _ in PAIRS], "a array<string>, b array<string>, x string, y string")
    got = rows.select(lcs_length(F.col("a"), F.col("b")).alias("n"), lcs_size("a", "b").alias("m"), lcs("a", "b").alias("l"), similarity(F.col("x"), F.col("y")).alias("s"), string_similarity("x", "y").alias("z")).collect()
    assert [r.n for r in got] == [r.m for r in got] == [r.l.length for r in got] == [n for _, _, n in PAIRS]
    assert got[1].l.sequence == ["a", "c"]
    assert [r.s for r in got] == [r.z for r in got]
    assert got[2].s == 1.0 and abs(got[4].s - 8 / 9) < 1e-12
    assert longest_common(list("abcbdab"), list("bdcaba"))[0] == 4


def test_similar_pairs_are_all_found(spark):
    import random

    r = random.Random(7)
    forms = sorted({"".join(r.choice("abc ") for _ in range(r.randrange(1, 9))).strip() or "a" for _ in range(90)} | {"graph colouring", "graph coloring", "heap sort", "heapsort"})
    df = spark.createDataFrame([(f,) for f in forms], "form string")
    for threshold in (0.6, 0.75, 0.88, 1.0):
        got = {(x.a, x.b) for x in resolve.similar_pairs(df, threshold).collect()}
        want = {(a, b) for a, b in itertools.combinations(forms, 2) if longest_common(list(a), list(b))[0] / max(len(a), len(b)) >= threshold}
        assert got == want


def mention_rows(spark, raws):
    return spark.createDataFrame([(0, 1, "p", k + 1, "Q", 1, 5.0, 0, x) for k, x in enumerate(raws)], "doc int, paper int, label string, q int, id string, unit int, marks double, pos int, raw string")


def by_hand(forms, threshold):
    """The sequential rule, form by form."""
    leaders, key = [], {}
    for f in forms:
        if f in key:
            continue
        best, score = None, 0.0
        for k in leaders:
            s = longest_common(list(f), list(k))[0] / max(len(f), len(k))
            if s > score:
                best, score = k, s
        if best is not None and score >= threshold:
            key[f] = best
        else:
            leaders.append(f)
            key[f] = f
    return key


def test_resolution_is_the_sequential_one(spark):
    import random

    r = random.Random(3)
    raws = ["".join(r.choice("ab") for _ in range(r.randrange(3, 9))) for _ in range(60)]
    raws = [x for x in raws if extract.canonical_text(x)]
    for threshold in (0.7, 0.8):
        got = resolve.resolve(mention_rows(spark, raws), threshold=threshold).mentions.select("raw", "key").distinct().collect()
        want = by_hand([extract.canonical_text(x) for x in raws], threshold)
        assert {x.raw: x.key for x in got} == {x: want[extract.canonical_text(x)] for x in raws}


def test_must_and_must_not_merge(spark):
    raws = ["Binary Search Tree", "BST", "Heap Sort", "Heapsort", "Graph Colouring", "Graph Coloring", "B Tree", "B+ Tree", "Max Heap", "Min Heap", "BFS", "DFS", "AVL Tree"]
    aliases = spark.createDataFrame([("BST", "Binary Search Tree", (0, 1))], "alias string, target string, place struct<doc int, line int>")
    found = resolve.resolve(mention_rows(spark, raws), aliases)
    key = {r.raw: r.key for r in found.mentions.collect()}
    assert key["BST"] == key["Binary Search Tree"] and key["Heapsort"] == key["Heap Sort"] and key["Graph Coloring"] == key["Graph Colouring"]
    assert len({key[x] for x in raws}) == 10
    assert {(m.raw, m.via) for m in found.merges.collect()} == {("Heapsort", "lcs"), ("Graph Coloring", "lcs")}
    assert one(found.comparisons).comparisons > 0


TEXT = """// two terms
@alias BST = Binary Search Tree
@hours AVL Tree = 3
@hours Sorting = 1.2.3h
@bogus thing
lonely topic
=== 2021 ===
[Unit 1]
Q1 (10): AVL Tree, BST
Q2a (2.5 marks) - Heap Sort; ,
# nothing
@unit 2
AVL Trees
Q9: ;
=== Mid 2 ===
Q1: Heapsort, A.V.L. Tree, Heap Sort
"""


def test_parse(spark):
    p = parse.parse(spark.createDataFrame([(0, TEXT)], "doc int, text string"))
    rows = [(r.label, r.q, r.id, r.unit, r.marks, r.topics, r.line) for r in p.questions.orderBy("line").collect()]
    assert rows == [
        ("Untitled", 1, "Q1", 0, None, ["lonely topic"], 6),
        ("2021", 1, "Q1", 1, 10.0, ["AVL Tree", "BST"], 9),
        ("2021", 2, "Q2A", 1, 2.5, ["Heap Sort"], 10),
        ("2021", 3, "Q3", 2, None, ["AVL Trees"], 13),
        ("Mid 2", 1, "Q1", 0, None, ["Heapsort", "A.V.L. Tree", "Heap Sort"], 16),
    ]
    assert {(r.label, r.year) for r in p.papers.collect()} == {("Untitled", None), ("2021", 2021), ("Mid 2", None)}
    assert {r.topic: r.hours for r in p.hours.collect()} == {"AVL Tree": 3.0, "Sorting": 1.2}
    assert [(r.alias, r.target) for r in p.aliases.collect()] == [("BST", "Binary Search Tree")]
    assert sorted(r.message.split(":")[0] for r in p.warnings.collect()) == ["Line 14", "Line 5", "Line 6"]


def test_parser_quirks(spark):
    p = parse.parse(spark.createDataFrame([(0, "== x ==\nQueue - Array\nQuick-sort\nQ1. BFS")], "doc int, text string"))
    assert [(r.id, r.topics) for r in p.questions.orderBy("line").collect()] == [("QUEUE", ["Array"]), ("QUICK", ["sort"]), ("Q3", ["Q1. BFS"])]


def test_analysis(spark):
    r = analyse(spark.createDataFrame([(0, TEXT)], "doc int, text string"), Options(budget_hours=4))
    table = {x.key: x for x in r.table.collect()}
    assert {k: x.frequency for k, x in table.items()} == {"lonely topic": 1, "avl tree": 3, "binary search tree": 1, "heap sort": 2}
    avl = table["avl tree"]
    assert (avl.marks, avl.years, avl.unit, avl.display, avl.study_hours, avl.hours_set) == (5.0, ["2021", "Mid 2"], 0, "A.V.L. Tree", 3.0, True)
    assert table["binary search tree"].display == "BST" and table["heap sort"].display == "Heap Sort"
    assert table["heap sort"].study_hours == 2.0 and not table["heap sort"].hours_set
    assert [x.key for x in r.ranked.collect()] == ["avl tree", "heap sort", "binary search tree", "lonely topic"]
    assert [x.key for x in topics.top_n(r.table, 2).collect()] == ["avl tree", "heap sort"]
    assert {(x.u, x.v, x["count"]) for x in r.edges.collect()} == {("avl tree", "binary search tree", 1), ("avl tree", "heap sort", 1)}
    assert [x["keys"] for x in r.clusters.orderBy("cluster").collect()] == [["avl tree", "heap sort", "binary search tree"], ["lonely topic"]]
    assert [x.key for x in r.prim.filter("cluster = 1").orderBy("ord").collect()] == ["avl tree", "binary search tree", "heap sort"]
    plan = one(r.allocation)
    assert (plan.value, sorted(plan.chosen), plan.slots) == (3.0, ["avl tree"], 8) or plan.value == 3.0
    k = one(r.kpis())
    assert (k.papers, k.questions, k.topics, k.lead) == (3, 5, 4, "A.V.L. Tree")
    assert one(r.notices()).total == 3
    sim = {(x.a_label, x.b_label): x.similarity for x in r.paper_similarity.collect()}
    assert sim["2021", "2021"] == 1.0 and sim["2021", "Mid 2"] == sim["Mid 2", "2021"] == 0.5
    assert sum(x.n for x in topics.unit_split(r.mentions).collect()) == 5
    assert [x.key for x in topics.matching(r.table, "HEAPS").collect()] == ["heap sort"]
    assert {x.label: x.n for x in topics.breakdown_rows(r.mentions).filter("key = 'avl tree'").collect()} == {"2021": 2, "Mid 2": 1}
    assert one(topics.breakdown(r.mentions, ["2021", "Mid 2"]).filter("key = 'avl tree'"))["2021"] == 2
    assert one(r.default_source()).key == "avl tree"
    assert r.overlap().count() == 9 and r.groups().count() == 3 and r.merges().count() >= 1 and r.timings(spark).count() >= 2
    assert one(r.tree()).size == 4


def toy(spark):
    pairs = ["ab", "ab", "bc", "ac", "cd", "xy"]
    mentions = spark.createDataFrame([(0, 1, "p", k, 1, 0, j, c) for k, p in enumerate(pairs) for j, c in enumerate(p)], "doc int, paper int, label string, q int, unit int, marks int, pos int, key string")
    table = spark.createDataFrame([(k, 1, 1) for k in ["a", "b", "c", "d", "solo", "x", "y"]], "key string, frequency int, unit int")
    return table, graph.edges(mentions), mentions


def test_graph(spark):
    table, edge, mentions = toy(spark)
    found = graph.components(table, edge).groupBy("component").agg(F.array_join(F.array_sort(F.collect_list("key")), "").alias("k")).collect()
    assert {r.k for r in found} == {"abcd", "solo", "xy"}
    assert [(r.key, r.level, r.parent) for r in graph.breadth_first(table, edge, "a").orderBy("ord").collect()] == [("a", 0, None), ("b", 1, "a"), ("c", 1, "a"), ("d", 2, "c")]
    assert graph.breadth_first(table, edge, "nobody").count() == 0
    assert [r.key for r in graph.depth_first(table, edge, "a").orderBy("ord").collect()] == ["a", "b", "c", "d"]
    forest = [(r.u, r.v) for r in graph.spanning_forest(edge).orderBy("ord").collect()]
    assert forest == [("a", "b"), ("a", "c"), ("c", "d"), ("x", "y")]
    assert one(graph.shortest_path(table, edge, "a", "d")).path == ["a", "c", "d"]
    assert graph.shortest_path(table, edge, "a", "x").count() == 0
    assert one(graph.shortest_path(table, edge, "a", "a")).cost == 0
    assert one(graph.farthest(graph.distances(table, edge, "a"), "a")).key == "d"
    assert one(graph.count_of(edge, "b", "a"))["count"] == 2 and one(graph.count_of(edge, "a", "x")).weight == math.inf
    assert one(graph.size(table, edge)).edges == 5
    assert {(r.unit_a, r.unit_b): r.n for r in graph.unit_matrix(edge, table).collect()}[1, 1] == 6
    levels = graph.level_report(graph.breadth_first(table, edge, "a"), edge, "a").orderBy("level").collect()
    assert [(x.level, x["keys"], x.counts) for x in levels] == [(1, ["b", "c"], [2, 1]), (2, ["d"], None)]
    clusters = graph.clusters(table, edge)
    assert one(graph.solo(clusters)).key == "solo"
    drawn = graph.highlighted(edge, graph.shortest_path(table, edge, "a", "d"), graph.spanning_forest(edge))
    assert {(r.u, r.v) for r in drawn.filter("on_path").collect()} == {("a", "c"), ("c", "d")}
    assert graph.edges(mentions.withColumn("unit", F.lit(1)), "unit").count() == 15


def test_components_of_ranges(spark):
    """Links dealt over several tasks, which disagree on the roots of keys; sets and their edges give the same."""
    import random

    r = random.Random(7)
    groups = [sorted({f"k{r.randrange(300):03}" for _ in range(r.randrange(1, 5))}) for _ in range(140)]
    root = {k: k for g in groups for k in g}
    for g in groups:
        low = min(root[k] for k in g)
        old = {root[k] for k in g}
        root = {k: low if x in old else x for k, x in root.items()}
    sets = spark.createDataFrame([(g,) for g in groups], "keys array<string>")
    edge = spark.createDataFrame([p for g in groups for p in itertools.combinations(g, 2)], "u string, v string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for rows in (sets, edge):
            assert {x.key: x.component for x in graph.components(graph.frequencies(sets), rows).collect()} == root
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_common_size_in_stripes():
    import numpy as np

    r = np.random.default_rng(3)
    for n, m, k in ((0, 5, 3), (40, 70, 3), (130, 90, 400), (200, 200, 8)):
        x, y = r.integers(0, k, n), r.integers(0, k, m)
        for width in (1, 7, 64, 1000):
            assert common_size(x, y, width) == longest_common(x.tolist(), y.tolist())[0]


def test_common_size_takes_one_addition(monkeypatch):
    """Faster than the plain formula, which has two additions and a subtraction for a number of y."""
    import time

    import numpy as np

    from topicwright.functions import sequences

    def slow(x, y):
        places, n = {}, len(x)
        for k, v in enumerate(x.tolist()):
            places[v] = places.get(v, 0) | 1 << k
        full = state = (1 << n) - 1
        carry = bytearray(len(y))
        begin = time.process_time()
        for j, v in enumerate(y.tolist()):
            hit = state & places.get(v, 0)
            if hit or carry[j]:
                total = state + hit + carry[j]
                carry[j] = total >> n
                state = (total | state - hit) & full
        return n - state.bit_count(), time.process_time() - begin

    def fast(x, y):
        begin = time.process_time()
        return common_size(x, y), time.process_time() - begin

    r = np.random.default_rng(4)
    x, y = r.integers(0, 64, 1 << 16), r.integers(0, 64, 20_000)
    runs = [(slow(x, y), fast(x, y)) for _ in range(3)]
    assert len({n for run in runs for n, _ in run}) == 1
    assert min(run[1][1] for run in runs) < 0.75 * min(run[0][1] for run in runs)
    x, y = r.permutation(300), r.permutation(200)
    for most in (1, 100, 5000):  # stripes as narrow as the vectors must be
        monkeypatch.setattr(sequences, "VECTORS", most)
        assert common_size(x, y) == longest_common(x.tolist(), y.tolist())[0]


def test_pairs_of_papers_have_a_task_each(spark):
    labels = spark.range(8).selectExpr("concat('p', id) label", "if(id < 7, cast(id as int) + 1, null) some")
    pairs = labels.selectExpr("label a", "some some_a").join(labels.selectExpr("label b", "some some_b"), F.col("a") <= F.col("b"))
    pieces = spark.range(14).selectExpr("concat('p', id % 7) label", "0 part", "cast(id as int) piece", "array('k') names", "cast('' as binary) codes")
    rows = planning.full_pairs(pairs, pieces).select("a", "b", "piece", F.spark_partition_id().alias("at")).collect()
    assert len(rows) == 21 * 4 and len({(x.a, x.b) for x in rows}) == len({x.at for x in rows}) == len({(x.a, x.b, x.at) for x in rows}) == 21


def test_sequences_are_numbers(spark):
    """No task gets a row with all keys of a label."""
    rows = spark.range(400_000).selectExpr("0 doc", "cast(id % 2 as int) paper", "cast(id % 2 as string) label", "id q", "1 pos", "concat('k', id % 5) key")
    pieces = planning.paper_sequences(rows).selectExpr("label", "length(codes) / 4 as n").collect()
    assert len(pieces) >= 4 and sum(x.n for x in pieces) == 400_000 and max(x.n for x in pieces) < 80_000


def test_resolving_by_equal_forms(spark):
    """At a threshold of 1 the same keys as by the rounds, without a table of all forms."""
    rows = [(0, 1, q, p, raw) for q in range(4) for p, raw in enumerate(["AVL-Trees", "avl tree", "the", "Heap %d" % (q % 2)])]
    mentions = spark.createDataFrame(rows, "doc int, paper int, q int, pos int, raw string")
    found, slow = resolve.resolve(mentions, threshold=1.0), resolve.resolve(mentions, hours=spark.createDataFrame([], "topic string, hours double, place struct<doc:int,line:int>"), threshold=1.0)
    for name in ("mentions", "forms", "merges", "comparisons"):
        a, b = getattr(found, name), getattr(slow, name)
        assert sorted(a.select(*b.columns).collect(), key=str) == sorted(b.collect(), key=str), name
    assert "_forms" in vars(found) and callable(found._forms)


def test_forest_is_kruskals(spark):
    import random

    r = random.Random(5)
    for _ in range(2):
        names = [f"k{i}" for i in range(12)]
        rows = [(u, v, n := r.randrange(1, 4), 1.0 / n) for u, v in itertools.combinations(names, 2) if r.random() < 0.3]
        parent = {n: n for n in names}

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        want = []
        for u, v, _, _ in sorted(rows, key=lambda e: (e[3], e[0] + e[1], e[0])):
            if root(u) != root(v):
                parent[root(u)] = root(v)
                want.append((u, v))
        edge = spark.createDataFrame(rows, "u string, v string, count long, weight double")
        got = graph.spanning_forest(edge).orderBy("ord").collect()
        assert [(x.u, x.v) for x in got] == want


ITEMS = [("avl", 3.0, 7.0), ("bst", 2.0, 6.0), ("dijkstra", 2.0, 3.0), ("graph", 3.0, 4.0), ("heap", 2.0, 5.0), ("mcm", 4.0, 2.0)]


def test_knapsack(spark):
    hours, values = [h for _, h, _ in ITEMS], [v for *_, v in ITEMS]
    for budget in range(17):
        best = max(sum(values[k] for k in s) for n in range(7) for s in itertools.combinations(range(6), n) if sum(hours[k] for k in s) <= budget)
        value, chosen, slots = knapsack_of(hours, values, budget)
        assert value == best == sum(values[k] for k in chosen) and slots == 2 * budget
    assert knapsack_of([math.nan, 1.0], [9.0, 1.0], 2)[:2] == (1.0, [1])
    df = spark.createDataFrame(ITEMS, "key string, hours double, value double")
    assert one(planning.knapsack(df, 7)).value == 18 and one(planning.knapsack(df, 6)).value == 14
    assert one(planning.greedy(df, 6)).value == 13
    assert one(planning.coverage(df, planning.greedy(df, 6))).total == 27


def test_find_topics(spark):
    said = {
        "Build a max heap, then run heap sort": ["Max Heap", "Heap Sort"],
        "Compare a B-Tree and a B+ tree": ["B Tree", "B+ Tree"],
        "Construct an optimal binary search tree": ["Optimal BST"],
        "Explain the primary key": [],
    }
    rows = strings(spark, said).select("s", extract.find_topics(F.col("s")).alias("t")).collect()
    assert {r.s: r.t for r in rows} == said


FREE = """B.Tech 2023
UNIT - II
Q3. Explain MST. Compare Kruskal's and Prim's ways [10]
using an example
(a) Solve the knapsack
instance
b) What is dynamic programming? (5 marks)
Unit III
4) Name the colours
"""


def test_extract(spark):
    texts = spark.createDataFrame([(0, FREE), (1, "Heaps\n\nNothing here\nuse DFS and backtracking")], "doc int, text string")
    blocks = extract.extract_questions(texts)
    rows = [(r.doc, r.id, r.unit, r.marks, r.topics) for r in extract.matched(blocks).orderBy("doc", "block").collect()]
    assert rows == [
        (0, "Q3", 2, None, ["Minimum Spanning Tree", "Kruskal", "Prim"]),
        (0, "Q3a", 2, None, ["0/1 Knapsack"]),
        (0, "Q3b", 2, 5.0, ["Dynamic Programming"]),
        (1, "Q1", 1, None, ["Heap"]),
        (1, "Q3", 2, None, ["DFS"]),
    ]
    assert {r.doc: (r.blocks, r.unmatched) for r in extract.unmatched(blocks).collect()} == {0: (4, 1), 1: (3, 1)}
    papers = spark.createDataFrame([(0, "x", 2023), (1, "y", 2023)], "doc int, name string, year int")
    labelled = extract.unique_labels(papers)
    assert {r.doc: r.label for r in labelled.collect()} == {0: "2023", 1: "2023 (2)"}
    out = extract.to_structured(extract.matched(blocks), labelled)
    text = {r.doc: r.text for r in out.collect()}
    assert text[1] == "=== 2023 (2) ===\n[Unit 1]\nQ1: Heap\n[Unit 2]\nQ3: DFS\n"
    back = parse.parse(out.select("doc", "text")).questions
    assert {(r.doc, r.id, r.unit, r.marks, tuple(r.topics)) for r in back.collect()} == {(d, i.upper(), u, m, tuple(t)) for d, i, u, m, t in rows}


def test_detect_year_and_structure(spark):
    rows = spark.createDataFrame([("Exam 2019", "dsa-2023.pdf"), ("Session 2021-22", "x"), ("none 12019", "y")], "t string, n string")
    assert [r.y for r in rows.select(extract.detect_year(F.col("t"), F.col("n")).alias("y")).collect()] == [2023, 2021, None]
    marks = strings(spark, ["a\n == 2020 ==", "@paper x", "= a =", "@papers"]).select(extract.is_structured(F.col("s")).alias("f")).collect()
    assert [r.f for r in marks] == [True, True, False, False]


def test_trees(spark):
    tree, plain = diagnostics.Balanced(), diagnostics.Plain()
    keys = [f"topic {i:03d}" for i in range(200)]
    for k in keys:
        tree.add(k)
        plain.add(k)
    assert plain.height == 200 and diagnostics.height(tree.root) <= 12 and tree.walk("in") == keys
    lr = diagnostics.Balanced()
    for k in "cab":
        lr.add(k)
    assert lr.rotations["LR"] == 1 and not lr.add("a")
    copy = diagnostics.Balanced.deserialize(lr.serialize())
    assert copy.walk("pre") == lr.walk("pre") == ["b", "a", "c"] and copy.destroy() == ["a", "c", "b"] and copy.root is None
    import random

    r = random.Random(2)
    some = r.sample(range(100), 40)
    plain = diagnostics.Plain()
    for k in some:
        plain.add(f"{k:02d}")
    df = spark.createDataFrame([(i, f"{k:02d}") for i, k in enumerate(some)], "ord int, key string")
    row = one(diagnostics.heights(df))
    assert row.plain == plain.height and row.balanced < row.plain and row.best == 6


@pytest.mark.parametrize("mode,first", [("count", "b"), ("az", "a"), ("unit", "a")])
def test_sort_modes(spark, mode, first):
    table = spark.createDataFrame([("a", 1, 1), ("b", 5, 0), ("c", 2, 2)], "key string, frequency int, unit int")
    assert topics.sorted_by(table, mode).first().key == first
