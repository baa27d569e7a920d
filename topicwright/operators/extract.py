"""Free text of a paper to questions with topics, and questions back to structured text."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SPACE, STOP_WORDS, canonical, collapse
from ..sources.vocabulary import DEFAULT, Vocabulary

# The patterns of unit lines, question starts and marks (ASCII word borders spelled out).
_END = r"(?![A-Za-z0-9_])"
UNIT_LINE = rf"(?i)^unit ?[-–:.]? ?(\d|i{{1,3}}|iv|v){_END}"
QUESTION_START = r"(?i)^(?:q(?:ues(?:tion)?)? ?\.? ?(\d{1,2}) ?[.):-]?|(\d{1,2}) ?[.)]|\( ?([a-j]|[ivx]{1,4}) ?\)|([a-j]) ?[.)]) (?=\S)"
MARKS = rf"(?i)[(\[]? ?(\d{{1,2}}) ?marks?{_END}|\[ ?(\d{{1,2}}) ?\] ?$"
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5}


def canonical_text(text: str) -> str:
    """functions.text.canonical for one string, for phrases and inside UDFs."""
    low = re.sub(r"[’']s(?![A-Za-z0-9_])", "", text.lower())
    kept = re.sub(rf"[^a-z0-9+#{SPACE}]", "", re.sub(r"[-_/]", " ", low))
    words = (w for w in re.split(rf"[{SPACE}]+", kept) if w and w not in STOP_WORDS)
    return " ".join(w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w for w in words)


def phrase_table(vocabulary: Vocabulary) -> list[tuple[str, str]]:
    """(phrase in canonical form, topic), longest phrase first, ties in the vocabulary's order."""
    rows = [(form, t.name) for t in vocabulary.topics for p in t.phrases if (form := canonical_text(p))]
    return sorted(rows, key=lambda r: -len(r[0]))


def topics_in(form: str, phrases: Iterable[tuple[str, str]]) -> list[str]:
    """Topics of a canonical text by their first place.

    Longer phrases go first and all their places are blanked, so no shorter one
    matches inside; a blank is a character longer than what it covers, and places
    are those in the text as it is then.
    """
    rest, places = f" {form} ", {}
    for phrase, topic in phrases:
        needle = f" {phrase} "
        if (at := rest.find(needle)) < 0:
            continue
        places.setdefault(topic, at)
        rest = re.sub(f" {re.escape(phrase)}(?= )", " |" + " " * (len(phrase) - 1) + "|", rest)
    return sorted(places, key=places.__getitem__)


def find_topics(text: Column, vocabulary: Vocabulary = DEFAULT) -> Column:
    """Topics that a text names, in order of appearance (array<string>)."""
    phrases = phrase_table(vocabulary)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def find(forms: pd.Series) -> pd.Series:
        return forms.map(lambda f: topics_in(f or "", phrases))

    return find(canonical(text))


def specific(topics: Column, vocabulary: Vocabulary = DEFAULT) -> Column:
    """Without the vocabulary's generic topics, unless there are no others."""
    generic = list(vocabulary.generic) or [""]
    return F.when(F.exists(topics, lambda t: ~t.isin(*generic)), F.filter(topics, lambda t: ~t.isin(*generic))).otherwise(topics)


def detect_year(text: Column, name: Column) -> Column:
    """Year from the file name, else from the first 3,000 characters, else null (int)."""
    year = r"(?:19|20)\d{2}"
    word = rf"(?<![A-Za-z0-9_])({year}){_END}"
    return F.coalesce(F.nullif(F.regexp_extract(name, f"({year})", 1), F.lit("")), F.nullif(F.regexp_extract(F.substring(text, 1, 3000), word, 1), F.lit(""))).cast("int")


def is_structured(text: Column) -> Column:
    """Whether a text has a paper header, so that it is read as it is."""
    return F.coalesce(text.rlike(rf"(?m)^[{SPACE}]*(?:={{2,}}.+={{2,}}|@paper{_END})"), F.lit(False))


def stem(path: Column) -> Column:
    """File name without folders and extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]+$", "")


def unique_labels(papers: DataFrame, order: str = "doc") -> DataFrame:
    """Adds `label`: a paper's year or else its name; one that an earlier paper has gets (2), (3) and so on."""
    wanted = F.coalesce(F.col("year").cast("string"), F.col("name"))
    at = F.row_number().over(Window.partitionBy("__label").orderBy(order))
    numbered = papers.withColumn("__label", wanted).withColumn("__at", at)
    return numbered.withColumn("label", F.when(F.col("__at") > 1, F.concat("__label", F.lit(" ("), F.col("__at"), F.lit(")"))).otherwise(F.col("__label"))).drop("__label", "__at")


def question_blocks(texts: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, block, id, unit, text): the numbered questions of each text; where none is numbered, each line is one.

    A line that starts a question opens a block, others join the open one; unit
    lines set the unit of the blocks after them. Windows run inside a text.
    """
    lines = texts.select(F.col(doc).alias("doc"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")).alias("line_no", "line")).withColumn("line", collapse(F.col("line"))).filter("line <> ''")
    roman = F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv])
    unit_text = F.lower(F.regexp_extract("line", UNIT_LINE, 1))
    number = F.nullif(F.concat(F.regexp_extract("line", QUESTION_START, 1), F.regexp_extract("line", QUESTION_START, 2)), F.lit(""))
    part = F.lower(F.concat(F.regexp_extract("line", QUESTION_START, 3), F.regexp_extract("line", QUESTION_START, 4)))
    marked = lines.select(
        "doc",
        "line_no",
        "line",
        F.col("line").rlike(UNIT_LINE).alias("is_unit"),
        F.when(F.col("line").rlike(UNIT_LINE), F.coalesce(roman[unit_text], unit_text.try_cast("int"), F.lit(0))).alias("unit_here"),
        F.col("line").rlike(QUESTION_START).alias("starts"),
        number.alias("number"),
        part.alias("part"),
    )
    upto = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    state = (
        marked.withColumn("block", F.sum(F.col("starts").cast("int")).over(upto))
        .withColumn("unit", F.coalesce(F.last("unit_here", ignorenulls=True).over(upto), F.lit(0)))
        .withColumn("last_number", F.last("number", ignorenulls=True).over(upto))
        .withColumn("n_blocks", F.sum(F.col("starts").cast("int")).over(Window.partitionBy("doc")))
        .withColumn("line_at", F.row_number().over(Window.partitionBy("doc").orderBy("line_no")))
    )
    numbered = state.filter("n_blocks > 0 and block > 0 and (starts or not is_unit)")
    own_text = F.when(F.col("starts"), F.regexp_replace("line", QUESTION_START, "")).otherwise(F.col("line"))
    first = lambda c: F.min_by(c, "line_no")
    blocks = numbered.groupBy("doc", "block").agg(
        first(F.concat(F.lit("Q"), F.coalesce("last_number", F.col("block").cast("string")), "part")).alias("id"),
        first("unit").alias("unit"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", own_text.alias("t")))), lambda x: x["t"]), " ").alias("text"),
    )
    plain = state.filter("n_blocks = 0").select("doc", F.col("line_at").cast("long").alias("block"), F.concat(F.lit("Q"), "line_at").alias("id"), F.lit(0).alias("unit"), F.col("line").alias("text"))
    return blocks.unionByName(plain)


def extract_questions(texts: DataFrame, vocabulary: Vocabulary = DEFAULT, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, block, id, unit, marks, topics) of every block; blocks without a topic have an empty list (see matched, unmatched)."""
    units = F.create_map(*[F.lit(x) for t in vocabulary.topics for x in (t.name, t.unit)])
    found = question_blocks(texts, doc, text).withColumn("topics", specific(find_topics(F.col("text"), vocabulary), vocabulary))
    marks = F.nullif(F.concat(F.regexp_extract("text", MARKS, 1), F.regexp_extract("text", MARKS, 2)), F.lit("")).cast("double")
    unit = F.coalesce(F.nullif(F.col("unit"), F.lit(0)), F.when(F.size("topics") > 0, units[F.get("topics", F.lit(0))]), F.lit(0))
    return found.select("doc", "block", "id", unit.alias("unit"), marks.alias("marks"), "topics")


def matched(blocks: DataFrame) -> DataFrame:
    return blocks.filter("size(topics) > 0")


def unmatched(blocks: DataFrame) -> DataFrame:
    """(doc, blocks, unmatched) counts."""
    return blocks.groupBy("doc").agg(F.count("*").alias("blocks"), F.count_if(F.size("topics") == 0).alias("unmatched"))


def number_text(c: Column) -> Column:
    """A number without a needless fraction."""
    return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))


def to_structured(questions: DataFrame, papers: DataFrame) -> DataFrame:
    """(doc, label, text): each paper's matched questions in the structured format, by unit (0 first, without a header)."""
    marks = F.when(F.coalesce(F.col("marks"), F.lit(0.0)) != 0, F.concat(F.lit(" ("), number_text(F.col("marks")), F.lit(")"))).otherwise(F.lit(""))
    line = F.concat("id", marks, F.lit(": "), F.array_join("topics", ", "))
    units = questions.withColumn("line", line).groupBy("doc", "unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "line"))), lambda x: x["line"]).alias("lines"))
    head = F.when(F.col("unit") != 0, F.array(F.concat(F.lit("[Unit "), F.col("unit"), F.lit("]")))).otherwise(F.array().cast("array<string>"))
    bodies = units.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("unit", F.concat(head, "lines").alias("lines")))).alias("units"))
    lines = F.concat(F.array(F.concat(F.lit("=== "), "label", F.lit(" ==="))), F.flatten(F.transform("units", lambda u: u["lines"])), F.array(F.lit("")))
    return papers.select("doc", "label").join(bodies, "doc").select("doc", "label", F.array_join(lines, "\n").alias("text"))


def assemble(structured: DataFrame, extracted: DataFrame) -> DataFrame:
    """One corpus of texts (doc, text): structured files first, extracted papers after them; blank ones go."""
    both = structured.select(F.lit(0).alias("kind"), "doc", "text").unionByName(extracted.select(F.lit(1).alias("kind"), "doc", "text"))
    return both.filter(F.trim("text") != "").select(F.struct("kind", "doc").alias("doc"), "text")
