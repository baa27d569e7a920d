"""The pipeline against a plainer version of each stage, and the registered queries against SQL."""

import duckdb
import pytest
from test_near_duplicates import brute

import corpus_pipeline
from topicwright.llm import decontaminate, queries

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()} if k else None
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == columns and docs.count() == len(kept[name])
        if name == "near_duplicates":
            assert kept[name] == {d for d, n, c in brute(sorted(before.items())) if d == c or not n}
        if name == "decontamination":
            items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            quoting = {d for d, t in before.items() if any(i in decontaminate.normal(t) for i in items if len(i) >= 32)}
            assert quoting and kept[name] == set(before) - quoting
        if name == "packing":
            assert kept["packing"] == kept["decontamination"]
    verdict = queries.op2_quality_classifier(spark, SF)
    assert kept["quality"] == {r.doc_id for r in verdict.filter("accepted").collect()}
    assert [tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").orderBy("doc_id", "piece").collect()] == [tuple(r) for r in docs.select("doc_id", "piece", "length", "ids_crc32").orderBy("doc_id", "piece").collect()]


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    """Null, empty, repeated, very long and clashing rows, and an empty table."""
    columns = "doc_id long, text string, lang string, source string, n_chars long, group string, ROW int, `__id` long, text_key string, length long"
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    base = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(3).collect()]
    words = " ".join(f"w{k}" for k in range(60_000))
    odd = [(1, None), (2, ""), (3, " \n"), (None, None), (None, base[0]), (10, base[0]), (10, base[0]), (11, base[0] + " more"), (12, words), (13, bench), (14, None), (14, ""), (None, "only one"), (None, "only one"), (15, base[1])]
    rows = [(k, t, None if n % 2 else "en", "s", None, "g", n, n, "k", 1) for n, (k, t) in enumerate(odd)]
    docs = spark.createDataFrame(rows, columns)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "near_duplicates":
            assert sorted((repr(r.doc_id), r.text) for r in docs.collect() if r.text and r.text.split()) == sorted([("10", base[0]), ("12", words), ("13", bench), ("None", "only one"), ("15", base[1])])
        if name != "packing":
            assert docs.schema.simpleString() == spark.createDataFrame([], columns).schema.simpleString()
    assert {r.doc_id for r in docs.collect()} == {1, 2, 3, None, 10, 12, 14, 15}
    assert [r.length for r in docs.filter("doc_id = 12").orderBy("piece").collect()][:-1] == [4096] * (docs.filter("doc_id = 12").count() - 1)
    empty = spark.createDataFrame([], columns)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0
    assert corpus_pipeline.packing(spark, empty, SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    mine = queries.QUERIES[name](spark, SF)
    columns = sorted(mine.columns)
    rows = con.sql(queries.ORACLES[name]).select(", ".join(columns)).fetchall()
    assert sorted(map(repr, (tuple(r) for r in mine.select(columns).collect()))) == sorted(map(repr, rows))
