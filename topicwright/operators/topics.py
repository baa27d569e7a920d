"""Topic store, ranking and report tables over resolved mentions.

Mentions: doc, paper, label, q, unit, marks, pos, raw, key; a row for each key of
each question. A question is (doc, paper, q).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical, half_up, label_order

QUESTION = ("doc", "paper", "q")


def marks_share(mentions: DataFrame) -> DataFrame:
    """Adds share: a question's marks in equal parts for its keys, 0 without marks."""
    n = F.count("*").over(Window.partitionBy(*QUESTION))
    return mentions.withColumn("share", F.coalesce(F.col("marks"), F.lit(0.0)) / n)


def ordered_labels(labels: Column) -> Column:
    return F.transform(F.array_sort(F.transform(labels, lambda x: F.struct(label_order(x).alias("o"), x.alias("x")))), lambda s: s["x"])


def topics(mentions: DataFrame, hours: DataFrame | None = None, override: dict[str, float] | None = None, default_hours: float = 2.0) -> DataFrame:
    """(key, frequency, marks, years, unit_counts, variants, unit, display, study_hours, hours_set, first) of every key.

    unit: the most frequent, ties to the smaller; display: the most frequent
    spelling among those whose own canonical form is the key, or else among all,
    ties to the smaller; hours: override, else hours, else the default.
    """
    shared = marks_share(mentions)
    first = F.struct(*QUESTION, "pos")
    # by key, spelling and unit, then by key and spelling, then by key: mentions are read once, and each step combines before it shuffles
    fine = shared.groupBy("key", "raw", "unit").agg(F.count("*").alias("n"), F.sum("share").alias("share"), F.collect_set("label").alias("labels"), F.min(first).alias("first"))
    lists = lambda c: F.flatten(F.collect_list(c))
    spelled = fine.groupBy("key", "raw").agg(F.sum("n").alias("n"), F.sum("share").alias("share"), lists("labels").alias("labels"), F.min("first").alias("first"), F.collect_list(F.struct("unit", "n")).alias("units"))
    spelled = spelled.withColumn("other", canonical(F.col("raw")) != F.col("key"))
    table = spelled.groupBy("key").agg(
        F.sum("n").alias("frequency"),
        F.sum("share").alias("marks"),
        F.array_distinct(lists("labels")).alias("labels"),
        F.min("first").alias("first"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("raw", "n")))).alias("variants"),
        F.min_by("raw", F.struct("other", -F.col("n"), F.col("raw"))).alias("display"),
        lists("units").alias("parts"),
    )
    units = F.array_sort(F.array_distinct(F.transform("parts", lambda p: p["unit"])))
    counted = F.transform(units, lambda u: F.struct(u.alias("unit"), F.aggregate(F.filter("parts", lambda p: p["unit"] == u), F.lit(0).cast("long"), lambda a, p: a + p["n"]).alias("n")))
    table = table.withColumn("unit_counts", F.map_from_entries(counted)).drop("parts")
    commonest = F.array_min(F.transform(F.map_entries("unit_counts"), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("unit"))))
    table = table.withColumn("unit", commonest["unit"]).withColumn("years", ordered_labels(F.col("labels"))).drop("labels")
    own = F.lit(None).cast("double")
    if override:
        own = F.create_map(*[F.lit(x) for kv in override.items() for x in (kv[0], float(kv[1]))])[F.col("key")]
    table = table.join(hours, "key", "left") if hours is not None else table.withColumn("hours", F.lit(None).cast("double"))
    return table.withColumn("study_hours", F.coalesce(own, "hours", F.lit(float(default_hours)))).withColumn("hours_set", own.isNotNull() | F.col("hours").isNotNull()).drop("hours")


def search(table: DataFrame, key: str) -> DataFrame:
    return table.filter(F.col("key") == key)


def in_order(table: DataFrame) -> DataFrame:
    return table.orderBy("key")


def insertion_order(table: DataFrame) -> DataFrame:
    return table.select("key", "first").orderBy("first")


def ranked(table: DataFrame) -> DataFrame:
    """All topics, most frequent first, ties by key, with their rank."""
    return table.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("frequency"), F.asc("key")))).orderBy("rank")


def top_n(table: DataFrame, n: int) -> DataFrame:
    """The first n by frequency, then key: a heap in each task, not a sort."""
    return table.orderBy(F.desc("frequency"), F.asc("key")).limit(n)


def sorted_by(table: DataFrame, mode: str) -> DataFrame:
    """mode: count, az or unit (unknown units last, by rank inside a unit)."""
    by_count = (F.desc("frequency"), F.asc("key"))
    orders = {"count": by_count, "az": (F.asc("key"),), "unit": (F.coalesce(F.nullif(F.col("unit"), F.lit(0)), F.lit(99)).asc(), *by_count)}
    return table.orderBy(*orders[mode])


def matching(table: DataFrame, query: str) -> DataFrame:
    """Topics whose display name or any spelling holds the query, whatever its case."""
    q = query.lower()
    return table.filter(F.contains(F.lower("display"), F.lit(q)) | F.exists(F.map_keys("variants"), lambda v: F.contains(F.lower(v), F.lit(q))))


def page(table: DataFrame, mode: str = "count", query: str = "", show_all: bool = False, size: int = 10) -> DataFrame:
    """The topic list as shown: a page of `size`, or everything if asked for or searched."""
    rows = sorted_by(matching(table, query) if query else table, mode)
    return rows if show_all or query else rows.limit(size)


def by_count(keys: DataFrame, table: DataFrame) -> DataFrame:
    """keys (pos, key) by frequency, ties in their own order."""
    return keys.join(table.select("key", "frequency"), "key").orderBy(F.desc("frequency"), "pos")


def breakdown(mentions: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Topic by paper counts, a column a label, zeros filled; give labels to fix the columns and save a pass."""
    return mentions.groupBy("key").pivot("label", labels).agg(F.count(F.lit(1))).na.fill(0)


def breakdown_rows(mentions: DataFrame) -> DataFrame:
    """(key, label, n) where n > 0: the same without a column a label."""
    return mentions.groupBy("key", "label").agg(F.count("*").alias("n"))


def _unit(units: int = 5) -> Column:
    return F.when(F.col("unit").between(1, units), F.col("unit")).otherwise(0)


def questions(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy(*QUESTION).agg(F.first("label").alias("label"), F.first("unit").alias("unit"), F.first("marks").alias("marks"))


def unit_split(mentions: DataFrame) -> DataFrame:
    """(label, unit, n): questions of each paper by unit, units outside 1 to 5 as 0."""
    return questions(mentions).groupBy("label", _unit().alias("unit")).agg(F.count("*").alias("n"))


def unit_totals(mentions: DataFrame) -> DataFrame:
    """(unit, n, percent): share of all questions, halves up."""
    counted = questions(mentions).groupBy(_unit().alias("unit")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))  # one row
    return counted.crossJoin(F.broadcast(total)).select("unit", "n", half_up(100 * F.col("n") / F.col("total")).cast("int").alias("percent"))


def kpis(mentions: DataFrame, table: DataFrame, n_papers: int) -> DataFrame:
    """One row: papers, questions, marks, topics, in_every_paper, lead, lead_frequency, lead_papers."""
    asked = questions(mentions).agg(F.count("*").alias("questions"), F.coalesce(F.sum("marks"), F.lit(0.0)).alias("marks"))
    found = table.agg(
        F.count("*").alias("topics"),
        F.count_if(F.size("years") == n_papers).alias("in_every_paper"),
        F.min_by(F.struct("display", "frequency", F.size("years").alias("papers")), F.struct(-F.col("frequency"), F.col("key"))).alias("l"),
    )
    return asked.crossJoin(F.broadcast(found)).select(F.lit(n_papers).alias("papers"), "questions", "marks", "topics", "in_every_paper", F.col("l.display").alias("lead"), F.col("l.frequency").alias("lead_frequency"), F.col("l.papers").alias("lead_papers"))


def heatmap(mentions: DataFrame, table: DataFrame, n: int = 12, n_papers: int | None = None) -> DataFrame:
    """(key, display, frequency, label, n, in_papers): paper counts of the n most frequent topics, and in how many papers each is; with n_papers also of how many."""
    top = top_n(table, n).select("key", "display", "frequency", F.size("years").alias("in_papers"))
    total = [] if n_papers is None else [F.lit(n_papers).alias("total")]
    return breakdown_rows(mentions).join(F.broadcast(top), "key").select("key", "display", "frequency", "label", "n", "in_papers", *total)  # n rows


def topic_table(table: DataFrame, n_papers: int) -> DataFrame:
    """(key, display, unit, frequency, others, papers, share, marks) of each topic; others: its other spellings."""
    others = F.filter(F.map_keys("variants"), lambda v: v != F.col("display"))
    return table.select("key", "display", "unit", "frequency", others.alias("others"), F.size("years").alias("papers"), (F.size("years") / n_papers).alias("share"), "marks")


def notices(warnings: DataFrame, n: int = 3) -> DataFrame:
    """(total, shown): how many warnings there are, and the first n."""
    first = warnings.orderBy("doc", "line").limit(n).agg(F.transform(F.array_sort(F.collect_list(F.struct("doc", "line", "message"))), lambda x: x["message"]).alias("shown"))
    return warnings.agg(F.count("*").alias("total")).crossJoin(F.broadcast(first))


def stepped(hours: Column, step: float) -> Column:
    """Study hours after a step, from half an hour to twenty."""
    return F.least(F.lit(20.0), F.greatest(F.lit(0.5), hours + step))
