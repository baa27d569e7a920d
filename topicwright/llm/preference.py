"""Preference formatting: a prompt once, and a chosen and a rejected completion with their masks.

The longest common prefix of turns (same role and text, in order) of the chosen
and the rejected conversation is the prompt; what follows in each is its
completion. A turn renders as <|im_start|>ROLE, line feed, TEXT, <|im_end|>, line
feed; "<|im_" inside a role or text becomes "<| im_", so that no text can open
or close a turn. A mask lists the spans of the completion, in code points from
its start, that are trained on: text and end mark of its assistant turns, but
not their headers and not the other turns.

All of it is DataFrame functions. Rows are grouped by pair, that is, by
conversation; nothing else is gathered.

Defined results: null roles and texts are empty; rows that repeat in all four
columns are one turn; turns of one number are ordered by role, then text; rows
with a null pair id are left out; a pair with a side missing gives no row; if
both sides are equal, `identical` is true and both completions are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _safe(c: Column) -> Column:
    return F.replace(c, F.lit("<|im_"), F.lit("<| im_"))


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), _safe(turn["role"]), F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(_safe(turn["text"]), F.lit("<|im_end|>\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def _mask(turns: Column) -> Column:
    """start-end of the trained spans, joined by commas."""

    def step(state: Column, turn: Column) -> Column:
        start = state["at"] + F.length(_header(turn))
        end = start + F.length(_body(turn))
        span = F.concat(start.cast("string"), F.lit("-"), end.cast("string"))
        spans = F.when(turn["role"] == "assistant", F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.aggregate(turns, empty, step, lambda s: F.array_join(s["spans"], ","))


def _plain(rows: DataFrame, key: str) -> DataFrame:
    """(pair, turn, role, text) of rows with a key, nulls as empty texts."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    return rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("pair"), F.col("turn").cast("long").alias("turn"), *text)


def _turns(found: Column) -> Column:
    """Distinct turns in order, without their numbers."""
    return F.transform(F.array_sort(found), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def render_pairs(pairs: DataFrame, key: str) -> DataFrame:
    """The result of format_preferences from (pair, c, r): the turns (role, text) of both sides."""
    same = F.zip_with("c", "r", lambda a, b: F.coalesce(a == b, F.lit(False)))  # a turn without a partner is no common one
    first = F.array_position(same, False)
    counted = pairs.withColumn("n", F.when(first > 0, first - 1).otherwise(F.size("c")).cast("int"))
    cut = counted.select("pair", "n", F.slice("c", F.lit(1), F.col("n")).alias("prompt"), *[F.slice(x, F.col("n") + 1, F.size(x)).alias(x) for x in "cr"])
    return cut.select(
        F.col("pair").alias(key),
        F.col("n").cast("long").alias("n_common"),
        _render(F.col("prompt")).alias("prompt"),
        _render(F.col("c")).alias("chosen"),
        _mask(F.col("c")).alias("chosen_mask"),
        _render(F.col("r")).alias("rejected"),
        _mask(F.col("r")).alias("rejected_mask"),
        ((F.size("c") == 0) & (F.size("r") == 0)).alias("identical"),
    )


def format_preferences(chosen: DataFrame, rejected: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, n_common, prompt, chosen, chosen_mask, rejected, rejected_mask, identical) of each key on both sides; inputs: rows (key, turn, role, text)."""
    both = _plain(chosen, key).withColumn("side", F.lit(0)).unionAll(_plain(rejected, key).withColumn("side", F.lit(1)))
    side = lambda k: _turns(F.collect_set(F.when(F.col("side") == k, F.struct("turn", "role", "text"))))
    return render_pairs(both.groupBy("pair").agg(side(0).alias("c"), side(1).alias("r")).filter("size(c) > 0 and size(r) > 0"), key)


def conversation_pairs(rows: DataFrame) -> DataFrame:
    """(pair, c, r) for render_pairs from plain conversations (conv_id, turn, role, text).

    Chosen is a conversation up to its last assistant turn (of several with the
    same number, the one with the greatest text); rejected is the same with the
    last assistant turn of conversation conv_id + 1 in its place. Conversations
    without an assistant turn or without a next one have no pair; rows with a null
    id or turn are left out.
    """
    found = _plain(rows.withColumn("conv_id", F.col("conv_id").cast("long")), "conv_id").filter("turn is not null")
    turns = found.groupBy("pair").agg(F.collect_set(F.struct("turn", "role", "text")).alias("turns"))
    replies = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["turn"].alias("turn"), t["text"].alias("text")))
    own = turns.withColumn("last", F.array_max(replies)).filter("last is not null")
    other = own.select((F.col("pair") - 1).alias("pair"), F.col("last.text").alias("other"))
    before = _turns(F.filter("turns", lambda t: t["turn"] < F.col("last.turn")))
    reply = lambda text: F.array(F.struct(F.lit("assistant").alias("role"), text.alias("text")))
    return own.join(other, "pair").select("pair", F.concat(before, reply(F.col("last.text"))).alias("c"), F.concat(before, reply(F.col("other"))).alias("r"))


ORACLE = r"""
with rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null and turn is not null),
last as (select conv_id, max({'turn': turn, 'text': text}) as l from rows where role = 'assistant' group by conv_id),
paired as (select a.conv_id, a.l.turn as turn, a.l.text as own, b.l.text as other from last a join last b on b.conv_id = a.conv_id + 1),
before as (select r.conv_id, r.turn, r.role, r.text from rows r join paired p on r.conv_id = p.conv_id and r.turn < p.turn),
sides as (
  select distinct 0 as side, * from (select * from before union all select conv_id, turn, 'assistant', own from paired)
  union all select distinct 1, * from (select * from before union all select conv_id, turn, 'assistant', other from paired)),
numbered as (select side, conv_id, row_number() over (partition by side, conv_id order by turn, role, text) as i, role, text from sides),
differ as (
  select coalesce(c.conv_id, r.conv_id) as conv_id, min(coalesce(c.i, r.i)) as first from (select * from numbered where side = 0) c
  full join (select * from numbered where side = 1) r on c.conv_id = r.conv_id and c.i = r.i
  where c.i is null or r.i is null or c.role <> r.role or c.text <> r.text group by 1),
parts as (
  select n.side, n.conv_id, n.i, n.role, coalesce(d.first - 1, 1000000000) as n_common,
    '<|im_start|>' || replace(n.role, '<|im_', '<| im_') || chr(10) as head, replace(n.text, '<|im_', '<| im_') || '<|im_end|>' || chr(10) as body
  from numbered n left join differ d on n.conv_id = d.conv_id),
placed as (select *, sum(length(head) + length(body)) over (partition by side, conv_id, i > n_common order by i) as upto from parts),
texts as (
  select conv_id, side, count(*) filter (where i <= n_common) as n_common,
    coalesce(string_agg(head || body, '' order by i) filter (where i <= n_common), '') as prompt,
    coalesce(string_agg(head || body, '' order by i) filter (where i > n_common), '') as completion,
    coalesce(string_agg(cast(upto - length(body) as varchar) || '-' || cast(upto as varchar), ',' order by i) filter (where i > n_common and role = 'assistant'), '') as mask
  from placed group by conv_id, side)
select c.conv_id, c.n_common, c.prompt, c.completion as chosen, c.mask as chosen_mask, r.completion as rejected, r.mask as rejected_mask, c.completion = '' and r.completion = '' as identical
from texts c join texts r on c.conv_id = r.conv_id and c.side = 0 and r.side = 1
"""
