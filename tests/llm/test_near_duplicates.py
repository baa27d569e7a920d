import random

import numpy as np
import pyarrow as pa

from topicwright.llm import parity_join as join
from topicwright.llm.components import components
from topicwright.llm.shingles import shingle_sets, word_hashes


def shingles(text):
    words = bytes(text or "", "utf-8").lower().split()  # bytes: A-Z only, ASCII white space
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows, percent=75):
    """{row: (shingles, component)} by all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    out = []
    for k, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(k) and rows[j][0] is not None]
        out.append((doc, len(sets[k]), min(ids, default=None) if sets[k] else doc))
    return sorted(out, key=repr)


def corpus(seed, n=260):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(4000)]
    passage = r.choices(words, k=60)
    base = r.choices(words, k=150)
    texts = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.4:  # a large group around one text, many of them too far from all others
            t = [r.choice(words) if r.random() < r.choice((0.005, 0.02, 0.06)) else w for w in base]
        elif kind < 0.6:
            t = r.choices(words, k=r.randrange(0, 80)) + passage
        elif kind < 0.8 and texts:
            t = r.choice(texts).split()
            for _ in range(r.randrange(4)):
                if t:
                    t[r.randrange(len(t))] = r.choice(words)
        else:
            t = r.choices(words, k=r.randrange(0, 400))
        texts.append(" ".join(t))
    return texts


def rows_of(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def test_against_all_pairs(spark, monkeypatch):
    for seed, percent in ((1, 75), (2, 75), (3, 60)):
        rows = [(1000 - k, t) for k, t in enumerate(corpus(seed))]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert rows_of(join.near_duplicates(df, percent)) == brute(rows, percent)


def test_odd_rows(spark):
    long = " ".join(f"z{k}" for k in range(30000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  b"), (6, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, "a b"), (None, "only here now"), (8, "É x"), (9, "é x"), (10, long), (11, long + " more"), (12, "y" * 300 + " q"), (13, "a b")]
    df = spark.createDataFrame([(*r, b"c", 1, "x") for r in rows], "doc_id long, text string, class binary, gid int, id string")
    assert rows_of(join.near_duplicates(df)) == brute(rows)
    assert join.near_duplicates(df.limit(0)).count() == 0
    kept = join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((repr(r.doc_id) for r in kept.collect())) == sorted(map(repr, [1, 2, 3, 4, 6, None, 8, 9, 10, 12, 13]))


def test_null_ids_and_repeated_ids(spark):
    base = [f"z{k}" for k in range(40)]
    near = " ".join([*base[:-1], "other"])
    rows = [(None, "a b c"), (None, "a b c"), (None, " ".join(base)), (None, near), (5, near + " x y"), (5, near + " x"), (None, "alone"), (6, " ".join(base[:30]) + " but quite another one"), (6, ""), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in join.keep_one(df).collect()]
    assert kept.count((None, "a b c")) == 1 and kept.count((None, "alone")) == 1 and kept.count((6, "")) == 2
    assert sum(t.startswith("z0") for _, t in kept) == len({c for d, n, c in brute(rows) if d is not None and n})
    assert all(d is not None for d, t in kept if t.startswith("z0"))


def test_many_short_texts_in_a_batch(spark):
    """Pairs at the threshold itself, in batches of more texts than 16 bits can number."""
    rows = []
    for k in range(20_000):
        words = [f"w{k}x{j}" for j in range(11)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:10], "end"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    sizes = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(sizes)
    spark.conf.set(name, "100000")
    spark.conf.set(sizes, "64m")
    try:
        found = join.near_duplicates(df)
        assert found.select("component_id").distinct().count() == 20_000 and found.filter("component_id = 2 * floor(doc_id / 2)").count() == 40_000
    finally:
        spark.conf.unset(name)
        spark.conf.set(sizes, before)


def test_hot_keys(spark):
    many = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 7, id) as k")
    one = many.groupBy("k").agg(join.F.count("*").alias("n")).withColumn("x", join.F.col("k") * 2)
    got = join.join_hot(many, one, "k", "n")
    assert got.count() == 5000 and got.filter("x = 2 * k").count() == 5000 and got.columns == ["k", "id", "x"]


def test_shingle_sets():
    texts = ["", " ", None, "a", "a b c d", "a b c d e a b c d e", "A b", "a b", "x" * 200 + " y z w q r", "é\tÉ b\x0bc d\x0ce f"]
    h, n = shingle_sets(pa.array(["pad one", *texts]).slice(1))
    assert n.tolist() == [len(shingles(t)) for t in texts]
    assert len(np.unique(h)) == len(frozenset().union(*map(shingles, texts)))
    assert all((np.diff(part.astype(object)) > 0).all() for part in np.split(h, np.cumsum(n)[:-1]))
    assert word_hashes(pa.array([], pa.string()))[0].size == 0


def test_sketches_bound_the_difference():
    r = np.random.default_rng(1)
    for _ in range(200):
        both, a, b = (np.unique(r.integers(0, 1 << 63, k, dtype=np.uint64)) for k in r.integers(1, 300, 3))
        x, y = np.union1d(both, a), np.union1d(both, b)
        apart = len(np.setxor1d(x, y))
        assert join.bits_differ(join.bit_sketch(x, len(x)), join.bit_sketch(y, len(y))) <= apart
        assert sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(join.fixed_sketch(x), join.fixed_sketch(y), strict=True)) <= apart


def test_bands_have_a_block_to_spare():
    for percent in (60, 75, 90):
        bands = join.Bands(percent, 100_000)
        n = np.arange(1, 100_000)
        assert (bands.blocks[bands.of(n)] > bands.differ(n, bands.bounds[bands.of(n) + 1] - 1) - 1).all()
        assert (bands.of(bands.largest_partner(n)) - bands.of(n) <= 1).all() if percent >= 75 else True


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 480)]
    got = {x.v: x.c for x in components(spark.createDataFrame([*pairs, (None, 1)], "u long, v long")).collect()}
    label = {x: x for p in pairs for x in p}
    for _ in range(500):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label
