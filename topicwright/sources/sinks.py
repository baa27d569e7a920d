"""Results to files."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.analysis import Result


def write_texts(texts: DataFrame, path: str) -> None:
    """Structured texts (doc, text), a line a row, papers one after another."""
    texts.orderBy("doc").select("text").write.text(path)


def write_result(result: Result, path: str) -> None:
    """The tables of an analysis as Parquet, a folder each."""
    tables = {"topics": result.table, "mentions": result.mentions, "edges": result.edges, "clusters": result.clusters, "forest": result.forest, "route": result.prim, "allocation": result.allocation, "overlap": result.paper_similarity, "merges": result.resolved.merges}
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
