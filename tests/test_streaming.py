from topicwright.plans.analysis import analyse
from topicwright.sources.sinks import write_result, write_texts
from topicwright.streaming import papers


def test_counts_of_files_as_they_come(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("=== 2020 ===\nQ1 (4): Heap, AVL Tree\nQ2: Heaps, heap\n")

    def run():
        papers.start(papers.texts(spark, str(folder), 1), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
        return {r.key: (r.n, r.labels, r.marks) for r in papers.totals(spark, str(tmp_path / "t")).collect()}

    assert run() == {"heap": (2, 1, 4.0), "avl tree": (1, 1, 4.0)}
    (folder / "b.txt").write_text("=== 2021 ===\nQ1: Heap\n")
    assert run() == {"heap": (3, 2, 4.0), "avl tree": (1, 1, 4.0)}
    assert run()["heap"] == (3, 2, 4.0)


def test_sinks(spark, tmp_path):
    result = analyse(spark.createDataFrame([(0, "== 2020 ==\nQ1: Heap, AVL Tree")], "doc int, text string"))
    write_result(result, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r" / "topics")).count() == 2
    write_texts(spark.createDataFrame([(1, "a\nb")], "doc int, text string"), str(tmp_path / "x"))
    assert [r.value for r in spark.read.text(str(tmp_path / "x")).collect()] == ["a", "b"]
