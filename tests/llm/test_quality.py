import glob
import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from topicwright.llm import common
from topicwright.llm import kneser_ney as kn


def reference(train, corpus, order=kn.ORDER):
    """An interpolated modified Kneser-Ney model of characters, from the definition; gives the probability of an n-gram's last character."""
    pad = chr(kn.START) * (order - 1)
    counts = {order: Counter((pad + t)[k : k + order] for t in train for k in range(len(t)))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    models, kinds = {}, len(set().union(*corpus))
    for k, c in counts.items():
        many = [sum(v == j for v in c.values()) for j in range(5)]
        y = many[1] / (many[1] + 2 * many[2]) if many[1] else None
        cut = [0.0] + [max(0.05, min(j - 0.05, j - (j + 1) * y * many[j + 1] / many[j])) if j < 4 and many[j] and many[j + 1] and y is not None else j / 2 for j in (1, 2, 3)]
        total, freed = Counter(), defaultdict(float)
        for g, v in c.items():
            total[g[:-1]] += v
            freed[g[:-1]] += cut[min(v, 3)]
        models[k] = (c, cut, total, freed)

    def p(gram):
        low = 1 / kinds
        for k in range(1, order + 1):
            c, cut, total, freed = models[k]
            g = gram[order - k :]
            if total[g[:-1]]:
                n = c[g]
                low = ((n - cut[min(n, 3)] if n else 0) + freed[g[:-1]] * low) / total[g[:-1]]
        return low

    return p


def units(text):
    """A character for each UTF-16 unit."""
    raw = text.encode("utf-16-le")
    return "".join(chr(int.from_bytes(raw[k : k + 2], "little")) for k in range(0, len(raw), 2))


def perplexity(p, text, order=kn.ORDER):
    padded = chr(kn.START) * (order - 1) + text
    return math.exp(-sum(math.log(p(padded[k : k + order])) for k in range(len(text))) / len(text))


def sample(r, words, n):
    return " ".join(r.choices(words, k=n))


def test_against_the_definition(spark):
    r = random.Random(1)
    good = {"en": ["the", "and", "house", "water", "runs", "old"], "xx": ["zu", "ä", "öl", "über", "😀"]}
    docs, labels = [], []
    for k in range(60):
        lang = "en" if k % 3 else "xx"
        docs.append((k, sample(r, good[lang], r.randrange(1, 40)), lang))
        if k % 2:
            labels.append((k, 1, None if k % 5 else 0))
    docs += [(100, "#$% &&& qqq zzz ###" * 5, "en"), (101, "", "en"), (102, None, "en"), (103, "the house", None), (104, "no model", "yy"), (None, "old water", "en"), (70, "the and", "en"), (70, "the and", "en")]
    labels += [(100, 0, 0), (1000, 1, 0), (2, 1, 1), (None, 1, 0)]
    df = spark.createDataFrame([(*d, "x", 1.0) for d in docs], "doc_id long, text string, lang string, split string, perplexity double")
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = kn.train(df, labelled)
    rows = {(r.doc_id, r.lang): r for r in model.verdicts().collect()}
    trusted = {d for d, q, t in labels if q == 1 and not t and d is not None}
    trained = set(kn.sample_ids(kn.trusted(labelled), 200_000).tolist())
    assert trained < trusted
    for lang in good:
        p = reference([units(t) for d, t, x in docs if x == lang and d in trained and t], [units(t) for _, t, x in docs if x == lang and t])
        assert abs(sum(p("\x02\x02\x02" + c) for c in set().union(*(units(t) for _, t, x in docs if x == lang and t))) - 1) < 1e-9
        held = [math.ceil(math.log(perplexity(p, units(t))) * kn.BINS) for d, t, x in docs if x == lang and t and d in trusted - trained]
        assert abs(model.thresholds[lang] / (math.exp(np.quantile(held, 0.99) / kn.BINS) * 1.08) - 1) < 1e-9
        for d, t, x in docs:
            if x == lang and t:
                assert abs(rows[d, lang].perplexity / perplexity(p, units(t)) - 1) < 1e-9
    assert rows[100, "en"].perplexity > rows[100, "en"].threshold and not rows[100, "en"].accepted
    for key in ((101, "en"), (102, "en"), (103, None), (104, "yy")):
        assert rows[key].perplexity is None and rows[key].accepted
    assert model.verdicts().count() == len(docs)
    kept = model.accepted()
    assert kept.columns == df.columns and kept.count() == len(docs) - sum(not r.accepted for r in model.verdicts().collect())
    assert {r.split for r in kept.collect()} == {"x"}


def test_nothing_to_train_on(spark):
    df = spark.createDataFrame([(1, "text", "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert kn.train(df, none).accepted().count() == 1
    assert kn.train(df.limit(0), none).verdicts().count() == 0 and kn.train(df.limit(0), none).accepted().count() == 0


SF = "/root/testdata/sf0.01"


def verdicts(df, labels):
    model = kn.train(df, labels)
    found = sorted((r.doc_id, None if r.perplexity is None else round(r.perplexity, 6), r.accepted) for r in model.verdicts().collect())
    assert sorted(r.doc_id for r in model.accepted().collect()) == [d for d, _, fine in found if fine]
    return found


def test_splits_make_no_difference(spark, monkeypatch):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    whole = verdicts(docs, labels)
    assert sum(not fine for _, _, fine in whole) > 50
    model = kn.train(docs, labels)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400000")
    try:  # the same model, read in other splits
        assert sorted((r.doc_id, None if r.perplexity is None else round(r.perplexity, 6), r.accepted) for r in model.verdicts().collect()) == whole
        assert model.accepted().count() == sum(fine for _, _, fine in whole)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    monkeypatch.setattr(common, "GROUP_ROWS", 100)
    monkeypatch.setattr(common, "SHORT", 2000)
    monkeypatch.setattr(kn, "KEPT", 1000)
    assert verdicts(docs, labels) == whole
    assert verdicts(docs.repartition(8), labels) == whole
    assert verdicts(spark.createDataFrame(docs.collect(), docs.schema).withColumnRenamed("source", "__split").withColumnRenamed("n_chars", "group").withColumn("ROW", kn.F.lit(1)), labels) == whole
    assert len({r[0] for r in common.located(docs.repartition(8), "text")[0].select("group").distinct().collect()}) >= 8


def test_a_missing_score_file_is_an_error(spark, monkeypatch):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    write = kn.write_scores

    def lose(*tables):
        folder = write(*tables)
        for path in glob.glob(f"{kn.SharedFiles(folder).local}/*.npz"):
            os.remove(path)
        return folder

    monkeypatch.setattr(kn, "write_scores", lose)
    with pytest.raises(Exception, match="No such file"):
        kn.train(docs, labels)


def test_held_out_accuracy(spark):
    """On the test table: labels that the model doesn't train on."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    half = labels.filter("doc_id % 2 = 0")
    found = kn.train(docs, half).verdicts().join(labels.filter("doc_id % 2 = 1"), "doc_id")
    bad = found.filter("quality = 0")
    clean = found.filter("quality = 1 and toxic = 0")
    assert bad.filter("not accepted").count() >= 0.8 * bad.count()
    assert clean.filter("accepted").count() >= 0.95 * clean.count()
