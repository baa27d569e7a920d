"""The structured format, line by line: papers, units, questions, aliases, hours and warnings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, trim

# The patterns of directives, headers and questions.
_S = f"[{SPACE}]"
PAPER = rf"(?i)^(?:={{2,}}{_S}*(.+?){_S}*={{2,}}|@paper{_S}+(.+?)){_S}*$"
UNIT = rf"(?i)^\[{_S}*unit{_S}*(\d+){_S}*\]$|^@unit{_S}+(\d+)$"
ALIAS = rf"(?i)^@alias{_S}+(.+?){_S}*={_S}*(.+)$"
HOURS = rf"(?i)^@hours{_S}+(.+?){_S}*={_S}*([\d.]+){_S}*h?$"
QUESTION = rf"(?i)^(Q[A-Za-z0-9_.]*){_S}*(?:\({_S}*(\d+(?:\.\d+)?){_S}*(?:marks?)?{_S}*\))?{_S}*[:\-–]{_S}*(.+)$"


@dataclass(frozen=True)
class Parsed:
    """Tables of a corpus; every row names its text (doc) and line (from 1)."""

    papers: DataFrame  # doc, paper, label, year
    questions: DataFrame  # doc, paper, label, q, id, unit, marks, topics, line
    aliases: DataFrame  # alias, target: the last line of an alias holds
    hours: DataFrame  # topic, hours, doc, line: the last value, the first place
    warnings: DataFrame  # doc, line, message


def _part(pattern: str, group: int) -> Column:
    return F.regexp_extract("text", pattern, group)


def parse(texts: DataFrame, doc: str = "doc", text: str = "text") -> Parsed:
    """Parses each row's text on its own: its papers begin with its headers, its lines before one are "Untitled"."""
    lines = texts.select(F.col(doc).alias("doc"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")).alias("line", "text"))
    lines = lines.select("doc", (F.col("line") + 1).alias("line"), trim(F.col("text")).alias("text")).filter(~F.col("text").rlike("^(?://|#|$)"))
    kind = F.lit("question")
    for name, test in (("unknown", F.col("text").startswith("@")), ("unit", F.col("text").rlike(UNIT)), ("paper", F.col("text").rlike(PAPER)), ("hours", F.col("text").rlike(HOURS)), ("alias", F.col("text").rlike(ALIAS))):
        kind = F.when(test, name).otherwise(kind)
    lines = lines.withColumn("kind", kind)

    upto = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    in_paper = Window.partitionBy("doc", "paper").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    label = F.when(F.col("kind") == "paper", trim(F.concat(_part(PAPER, 1), _part(PAPER, 2))))
    unit = F.when(F.col("kind") == "unit", F.concat(_part(UNIT, 1), _part(UNIT, 2)).cast("int"))
    placed = lines.withColumn("label_here", label).withColumn("unit_here", unit).withColumn("paper", F.count("label_here").over(upto))
    placed = placed.withColumn("unit", F.coalesce(F.last("unit_here", ignorenulls=True).over(in_paper), F.lit(0)))
    placed = placed.withColumn("label", F.coalesce(F.last("label_here", ignorenulls=True).over(in_paper), F.lit("Untitled")))

    is_question = F.col("text").rlike(QUESTION)
    body = F.when(is_question, _part(QUESTION, 3)).otherwise(F.col("text"))
    topics = F.filter(F.transform(F.split(body, "[,;]"), trim), lambda t: t != "")
    asked = placed.filter("kind = 'question'").withColumn("named", is_question).withColumn("own_id", F.upper(_part(QUESTION, 1)))
    asked = asked.withColumn("marks", F.nullif(_part(QUESTION, 2), F.lit("")).cast("double")).withColumn("topics", topics)
    kept = asked.filter("size(topics) > 0").withColumn("q", F.row_number().over(Window.partitionBy("doc", "paper").orderBy("line")))
    questions = kept.select("doc", "paper", "label", "q", F.when(F.col("named"), F.col("own_id")).otherwise(F.concat(F.lit("Q"), "q")).alias("id"), "unit", "marks", "topics", "line")

    papers = placed.filter("kind = 'paper' or (kind = 'question' and paper = 0)").select("doc", "paper", "label").distinct()
    papers = papers.withColumn("year", F.when(F.col("label").rlike(r"^\d{4}$"), F.col("label").cast("int")))
    place = F.struct("doc", "line")
    alias = placed.filter("kind = 'alias'").select("doc", "line", _part(ALIAS, 1).alias("alias"), _part(ALIAS, 2).alias("target"))
    aliases = alias.groupBy("alias").agg(F.max_by("target", place).alias("target"), F.min(place).alias("place"))
    number = F.regexp_extract(_part(HOURS, 2), r"^(\d*\.?\d*)", 1)
    hour = placed.filter("kind = 'hours'").select("doc", "line", _part(HOURS, 1).alias("topic"), F.coalesce(number.try_cast("double"), F.lit(float("nan"))).alias("hours"))
    hours = hour.groupBy("topic").agg(F.max_by("hours", place).alias("hours"), F.min(place).alias("place"))

    first_loose = F.row_number().over(Window.partitionBy("doc").orderBy("line")) == 1
    says = lambda rows, message: rows.select("doc", "line", F.concat(F.lit("Line "), "line", message).alias("message"))
    warnings = says(placed.filter("kind = 'unknown'"), F.concat(F.lit(': unknown directive "'), "text", F.lit('"')))
    loose = asked.filter("paper = 0").withColumn("first", first_loose).filter("first")
    warnings = warnings.unionByName(says(loose, F.lit(': question before any "=== YEAR ===" header, filed under "Untitled"')))
    warnings = warnings.unionByName(says(asked.filter("size(topics) = 0"), F.lit(": no topics found")))
    return Parsed(papers, questions, aliases, hours, warnings)


def mentions(questions: DataFrame) -> DataFrame:
    """(doc, paper, label, q, id, unit, marks, pos, raw): a row for each topic of each question, in order."""
    return questions.select("doc", "paper", "label", "q", "id", "unit", "marks", F.posexplode("topics").alias("pos", "raw"))
