"""Entity resolution: spellings of a topic to one key, first seen first.

Forms are canonical spellings after aliases, in the order of their first place.
A form joins the earlier leader that is most similar to it (of equals the
earliest), if that reaches the threshold, and else is a leader itself. So the
leaders are the lexicographically first independent set of the graph of similar
pairs; it is found in rounds, each deciding all forms whose earlier neighbours
are decided.

Similar pairs come from an exact join, not from all pairs: strings whose longest
common subsequence reaches the threshold differ in a bounded number of inserted
and dropped characters, so of the shorter one's segments, one more than that
number, one stands unchanged in the longer one, at most as far from its place.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import cut, numbered
from ..functions.sequences import string_similarity
from ..functions.text import canonical


def _most_edits(a: int, threshold: float) -> int:
    """Most inserted and dropped characters between a string of length a and one no shorter that is similar to it."""
    last = math.floor(a / threshold + 1e-9)
    return max((a + b - 2 * math.ceil(threshold * b - 1e-9) for b in range(a, last + 1)), default=0)


def _segments(a: int, count: int) -> list[tuple[int, int]]:
    """`count` consecutive pieces of a string of length a, as (start, length)."""
    cuts = [k * a // count for k in range(count + 1)]
    return [(cuts[k], cuts[k + 1] - cuts[k]) for k in range(count)]


def similar_pairs(forms: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score) of distinct forms with similarity >= threshold, each pair once with a < b."""

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for s in pdf["form"]:
                edits = _most_edits(len(s), threshold)
                if edits >= len(s):
                    rows.append((len(s), -1, "", s))
                else:
                    rows += [(len(s), at, s[at : at + n], s) for at, n in _segments(len(s), edits + 1)]
            yield pd.DataFrame(rows, columns=["size", "at", "piece", "a"])

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = set()
            for s in pdf["form"]:
                for size in range(max(1, math.ceil(len(s) * threshold - 1e-9)), len(s) + 1):
                    edits = _most_edits(size, threshold)
                    if edits >= size:
                        rows.add((size, -1, "", s))
                        continue
                    for at, n in _segments(size, edits + 1):
                        for start in range(max(0, at - edits), min(len(s) - n, at + edits) + 1):
                            rows.add((size, at, s[start : start + n], s))
            yield pd.DataFrame(list(rows), columns=["size", "at", "piece", "b"])

    forms = forms.select("form").distinct()
    short = forms.mapInPandas(index, "size int, at int, piece string, a string")
    long = forms.mapInPandas(probe, "size int, at int, piece string, b string")
    pairs = short.join(long, ["size", "at", "piece"]).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.withColumn("score", string_similarity("a", "b")).filter(F.col("score") >= threshold)


class Resolved:
    """mentions: the input with key, one row for each key of a question, null forms gone; forms: form, ord, key, score; hours: key, hours; merges: raw, form, key, score, via; comparisons: one row. A function is called when its table is asked for."""

    def __init__(self, mentions: DataFrame, forms: DataFrame | Callable, hours: DataFrame, merges: DataFrame, comparisons: DataFrame | Callable):
        self.mentions, self._forms, self.hours, self.merges, self._comparisons = mentions, forms, hours, merges, comparisons

    @cached_property
    def forms(self) -> DataFrame:
        return self._forms() if callable(self._forms) else self._forms

    @cached_property
    def comparisons(self) -> DataFrame:
        return self._comparisons() if callable(self._comparisons) else self._comparisons


def resolve(mentions: DataFrame, aliases: DataFrame | None = None, hours: DataFrame | None = None, threshold: float = 0.88) -> Resolved:
    """Keys of mentions (doc, paper, q, pos, raw and more); hours' topics are resolved after them all."""
    if threshold >= 1 and aliases is None and hours is None:
        return _alike(mentions)
    spark = mentions.sparkSession
    place = F.struct(F.lit(0).alias("phase"), *[F.col(c) for c in ("doc", "paper", "q", "pos")])
    # canonical forms are made of distinct spellings, each with its first place
    seen = mentions.groupBy("raw").agg(F.min(place).alias("at")).withColumn("spelled", canonical(F.col("raw"))).filter("spelled <> ''")
    if aliases is not None:
        last = aliases.select(canonical(F.col("alias")).alias("spelled"), canonical(F.col("target")).alias("to"), "place")
        last = last.groupBy("spelled").agg(F.max_by("to", "place").alias("to"))
        seen = seen.join(last, "spelled", "left").withColumn("form", F.coalesce("to", "spelled")).withColumn("aliased", F.col("to").isNotNull()).drop("to")
    else:
        last = None
        seen = seen.withColumn("form", F.col("spelled")).withColumn("aliased", F.lit(False))
    seen = cut(seen)
    firsts = seen.groupBy("form").agg(F.min("at").alias("first"), F.min_by("raw", F.struct("at", "raw")).alias("raw"), F.min_by("aliased", F.struct("at", "raw")).alias("aliased")).withColumnRenamed("first", "at")
    firsts = firsts.select("form", F.lit(0).alias("phase"), F.col("at.doc").alias("doc"), F.col("at.paper").alias("paper"), F.col("at.q").alias("q"), F.col("at.pos").cast("long").alias("pos"), "raw", "aliased")
    if hours is not None:
        timed = hours.withColumn("spelled", canonical(F.col("topic"))).filter("spelled <> ''")
        timed = timed.join(last, "spelled", "left") if last is not None else timed.withColumn("to", F.lit(None).cast("string"))
        timed = timed.withColumn("form", F.coalesce("to", "spelled"))
        added = timed.groupBy("form").agg(F.min("place").alias("place"), F.min_by("topic", "place").alias("raw"), F.min_by(F.col("to").isNotNull(), "place").alias("aliased"))
        added = added.join(firsts, "form", "left_anti")
        blank = lambda c: F.lit(None).cast(firsts.schema[c].dataType).alias(c)
        firsts = firsts.unionByName(added.select("form", F.lit(1).alias("phase"), F.col("place.doc").cast(firsts.schema["doc"].dataType).alias("doc"), blank("paper"), blank("q"), F.col("place.line").cast("long").alias("pos"), "raw", "aliased"))
    # a row a distinct form: a sort of names, not of mentions
    order = Window.orderBy("phase", "doc", "paper", "q", "pos", "form")
    forms = cut(firsts.select("form", "raw", "aliased", F.row_number().over(order).alias("ord")))
    keyed = cut(leaders(forms, threshold))

    known = keyed.select("form", "key")
    spellings = seen.join(known, "form").select("raw", "key")  # a row a distinct spelling
    resolved = _once(mentions.join(spellings, "raw"), mentions.columns)
    if hours is not None:
        by_key = timed.join(known, "form").groupBy("key").agg(F.max_by("hours", "place").alias("hours"))
    else:
        by_key = spark.createDataFrame([], "key string, hours double")
    merged = keyed.filter("form <> key or aliased").select("raw", "form", "key", F.when(F.col("form") == F.col("key"), F.lit(1.0)).otherwise(F.col("score")).alias("score"), F.when(F.col("aliased"), "alias").otherwise("lcs").alias("via"), "ord")
    tests = keyed.withColumn("n", F.coalesce(F.sum((F.col("form") == F.col("key")).cast("long")).over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return Resolved(resolved, keyed, by_key, merged, tests.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("comparisons")))


def _once(keyed: DataFrame, columns: list[str]) -> DataFrame:
    """The first mention of each key of a question, none of the empty key; a plain filter on the key would go below the window and make the key a second time."""
    again = F.row_number().over(Window.partitionBy("doc", "paper", "q", "key").orderBy("pos", "raw"))
    return keyed.withColumn("again", F.when(F.col("key") != "", again)).filter("again = 1").select(*columns, "key")


def _alike(mentions: DataFrame) -> Resolved:
    """Resolution by equal forms alone, as no two different ones reach a threshold of 1: each form is its own key, so no mention meets another, and forms are only listed when asked for."""
    spark = mentions.sparkSession
    place = F.struct(F.lit(0).alias("phase"), *[F.col(c) for c in ("doc", "paper", "q", "pos")])
    resolved = _once(mentions.withColumn("key", canonical(F.col("raw"))), mentions.columns)

    def forms() -> DataFrame:
        seen = mentions.groupBy("raw").agg(F.min(place).alias("at")).withColumn("form", canonical(F.col("raw"))).filter("form <> ''")
        firsts = seen.groupBy("form").agg(F.min("at").alias("at"), F.min_by("raw", F.struct("at", "raw")).alias("raw"))
        listed = numbered(firsts, "ord", F.struct("at", "form"))
        return listed.select("form", "raw", F.lit(False).alias("aliased"), F.col("ord").cast("int").alias("ord"), F.col("form").alias("key"), F.lit(None).cast("double").alias("score"))

    none = spark.createDataFrame([], "raw string, form string, key string, score double, via string, ord int")
    n = F.col("n")
    tests = lambda: mentions.select(canonical(F.col("raw")).alias("form")).filter("form <> ''").distinct().agg(F.count("*").alias("n")).select(F.floor(n * (n - 1) / 2).cast("long").alias("comparisons"))
    return Resolved(resolved, forms, spark.createDataFrame([], "key string, hours double"), none, tests)


def leaders(forms: DataFrame, threshold: float) -> DataFrame:
    """Adds key and score to forms (form, ord and more): a leader is its own key."""
    ord_of = forms.select("form", "ord")
    pairs = similar_pairs(forms, threshold)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    edges = cut(both.join(ord_of.withColumnsRenamed({"form": "a", "ord": "ord_a"}), "a").join(ord_of.withColumnsRenamed({"form": "b", "ord": "ord_b"}), "b").filter("ord_a < ord_b"))  # a before b
    status = ord_of.select("form").join(edges.select(F.col("b").alias("form")).distinct(), "form", "left_anti").withColumn("leads", F.lit(True))
    status = cut(status)
    waiting = cut(edges.select(F.col("b").alias("form")).distinct())
    while not waiting.isEmpty():
        near = edges.join(waiting, edges["b"] == waiting["form"], "left_semi").join(status.withColumnRenamed("form", "a"), "a", "left")
        told = near.groupBy(F.col("b").alias("form")).agg(F.bool_or(F.coalesce("leads", F.lit(False))).alias("follows"), F.bool_and(F.col("leads").isNotNull()).alias("sure"))
        decided = cut(told.filter("follows or sure").select("form", (~F.col("follows")).alias("leads")))
        status = cut(status.unionByName(decided))
        waiting = cut(waiting.join(decided, "form", "left_anti"))
    led = edges.join(status.filter("leads").select(F.col("form").alias("a")), "a", "left_semi")
    follow = led.groupBy(F.col("b").alias("form")).agg(F.max_by("a", F.struct("score", -F.col("ord_a"))).alias("to"), F.max("score").alias("best"))
    follow = follow.join(status.filter("not leads"), "form", "left_semi")
    return forms.join(follow, "form", "left").withColumn("key", F.coalesce("to", "form")).withColumn("score", F.col("best")).drop("to", "best")
