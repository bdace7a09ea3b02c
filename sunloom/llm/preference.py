"""Preference formatting: the turns two conversations share, once as prompt, and the rest as masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, maybe_broadcast, stage_bucketed

TRAINED = "assistant"
#: Turns of a bucket of staged conversations.
BUCKET_TURNS = 1_000_000


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and ``turns``, the array of (role, text) by turn; equal turn numbers go by role and text.

    Null roles count as "unknown", null texts as empty; a null turn number comes first. A turn without conv_id is a
    conversation of its own, once however often the row is repeated, so such rows are never gathered.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = turns.select("conv_id", turn.alias("said"))
    spoken = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    # array_sort puts a null turn number first, as structs compare field by field.
    named = said.filter("conv_id is not null").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("said")), spoken).alias("turns"))
    alone = said.filter("conv_id is null").distinct().select("conv_id", F.array(spoken(F.col("said"))).alias("turns"))
    return named.unionByName(alone)


def shared_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that agree in role and text."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y)
    first = F.array_position(same, False)
    return F.when(first > 0, first.cast("int") - 1).otherwise(n)


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """``chosen`` and ``rejected`` (arrays of role, text) of each row to prompt and masked completions.

    The longest common prefix of turns is rendered once as ``prompt``. Each completion is the rendered rest, with a mask
    of ``flag:length`` runs, one per turn in order: flag 1 for the assistant's turns, which count in the loss, else 0.
    Equal conversations have empty completions and masks; a conversation that is the other's prefix has an empty one.
    All other columns of ``pairs`` stay.
    """

    def completion(side: str) -> Column:
        return F.slice(F.col(side), F.col("n_prompt_turns") + 1, F.greatest(F.size(side) - F.col("n_prompt_turns"), F.lit(0)))

    def text(turns: Column) -> Column:
        return F.array_join(F.transform(turns, rendered), "")

    def mask(turns: Column) -> Column:
        flag = lambda t: F.when(t["role"] == TRAINED, F.lit("1:")).otherwise(F.lit("0:"))
        return F.array_join(F.transform(turns, lambda t: F.concat(flag(t), F.length(rendered(t)).cast("string"))), ",")

    kept = [c for c in pairs.columns if c not in ("chosen", "rejected")]
    counted = pairs.withColumn("n_prompt_turns", shared_prefix(F.col("chosen"), F.col("rejected")))
    return counted.select(
        *kept,
        "n_prompt_turns",
        text(F.slice("chosen", F.lit(1), F.col("n_prompt_turns"))).alias("prompt"),
        text(completion("chosen")).alias("chosen"),
        text(completion("rejected")).alias("rejected"),
        mask(completion("chosen")).alias("chosen_mask"),
        mask(completion("rejected")).alias("rejected_mask"),
    )


def join_pairs(pairs: DataFrame, turns: DataFrame) -> DataFrame:
    """Formatted pairs for ``pairs`` (chosen_id, rejected_id) over a table of turns; ids that have no turns drop out."""
    whole = conversations(turns)
    right = whole.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("rejected"))
    left = whole.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen"))
    return format_pairs(pairs.join(right, "rejected_id").join(left, "chosen_id"))


def parroted(turns: Column) -> Column:
    """A conversation's foil: its last assistant turn repeats the turn before it; without one, it stops a turn earlier."""
    n = F.size(turns)
    last = F.array_max(F.transform(turns, lambda t, i: F.when(t["role"] == TRAINED, i + 1).otherwise(F.lit(0))))
    said = F.when(last > 1, F.element_at(turns, F.greatest(last - 1, F.lit(1)))["text"]).otherwise(F.lit(""))
    echo = F.struct(F.lit(TRAINED).alias("role"), said.alias("text"))
    return F.when(last > 0, F.concat(F.slice(turns, F.lit(1), last - 1), F.array(echo))).otherwise(F.slice(turns, F.lit(1), F.greatest(n - 1, F.lit(0))))


def preferences(turns: DataFrame) -> DataFrame:
    """One preference pair per conversation of a plain table of turns (conv_id, turn, role, text).

    A conversation is preferred to the one with the smallest conv_id that opens with the same turn (``kind`` "sibling");
    that one, and every conversation that opens alone, is preferred to its own parroting foil (``kind`` "parrot").
    Siblings pair with one conversation, never with each other, so a common opening makes no more pairs than rows, and
    groups of equal openings are formed on digests, pre-aggregated. A conversation is one output row and is gathered as
    such; a turn without conv_id is one by itself and pairs with its own foil. An empty table gives no rows; further columns
    are not read.
    """
    buckets = bucket_count(turns.sparkSession, turns.count(), BUCKET_TURNS)
    whole = stage_bucketed(conversations(turns.select("conv_id", "turn", "role", "text")), "conversations", "conv_id", buckets)
    first = F.element_at("turns", 1)
    opening = whole.select("conv_id", F.sha2(F.concat_ws("\0", first["role"], first["text"]), 256).alias("opening"))
    groups = opening.groupBy("opening").agg(F.min("conv_id").alias("rejected_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    siblings = opening.join(maybe_broadcast(groups), "opening").filter(F.col("conv_id") != F.col("rejected_id")).select("conv_id", "rejected_id")
    hubs = maybe_broadcast(siblings.select("rejected_id").distinct())
    # The hub's turns meet the slim pairs by broadcast when they are few, else by a join that AQE can split.
    foils = siblings.join(hubs.join(whole.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("foil")), "rejected_id"), "rejected_id")
    tagged = whole.join(foils, "conv_id", "left")
    pairs = tagged.select(
        "conv_id",
        F.when(F.col("foil").isNull(), F.lit("parrot")).otherwise(F.lit("sibling")).alias("kind"),
        F.col("rejected_id"),
        F.col("turns").alias("chosen"),
        F.coalesce("foil", parroted(F.col("turns"))).alias("rejected"),
    )
    return format_pairs(pairs)


ORACLE = r"""
WITH c AS (SELECT conv_id, list({'role': coalesce(role, 'unknown'), 'text': coalesce(text, '')} ORDER BY turn, role, text) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
      UNION ALL SELECT NULL, [{'role': role, 'text': text}] FROM (SELECT DISTINCT turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NULL)),
g AS (SELECT t[1] AS opening, min(conv_id) AS hub FROM c GROUP BY 1),
j AS (SELECT c.conv_id, c.t AS a, CASE WHEN g.hub <> c.conv_id THEN g.hub END AS rejected_id FROM c JOIN g ON c.t[1] = g.opening),
m AS (SELECT j.*, h.t AS foil, coalesce(list_max([CASE WHEN x.role = 'assistant' THEN i ELSE 0 END FOR x, i IN a]), 0) AS last FROM j LEFT JOIN c h ON h.conv_id = j.rejected_id),
p AS (SELECT conv_id, rejected_id, a, CASE WHEN foil IS NOT NULL THEN foil WHEN last > 0
        THEN a[1:last - 1] || [{'role': 'assistant', 'text': CASE WHEN last > 1 THEN a[last - 1].text ELSE '' END}] ELSE a[1:len(a) - 1] END AS b FROM m),
q AS (SELECT *, coalesce(list_min([i FOR x, i IN a IF i > len(b) OR x.role <> b[i].role OR x.text <> b[i].text]) - 1, len(a)) AS n FROM p),
r AS (SELECT *, a[n + 1:] AS ca, b[n + 1:] AS cb FROM q)
SELECT conv_id, CASE WHEN rejected_id IS NULL THEN 'parrot' ELSE 'sibling' END AS kind, rejected_id, n::INT AS n_prompt_turns,
  list_aggregate(['<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10) FOR x IN a[1:n]] || [''], 'string_agg', '') AS prompt,
  list_aggregate(['<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10) FOR x IN ca] || [''], 'string_agg', '') AS chosen,
  list_aggregate(['<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10) FOR x IN cb] || [''], 'string_agg', '') AS rejected,
  coalesce(list_aggregate([CASE WHEN x.role = 'assistant' THEN '1:' ELSE '0:' END || (length(x.role) + length(x.text) + 13) FOR x IN ca], 'string_agg', ','), '') AS chosen_mask,
  coalesce(list_aggregate([CASE WHEN x.role = 'assistant' THEN '1:' ELSE '0:' END || (length(x.role) + length(x.text) + 13) FOR x IN cb], 'string_agg', ','), '') AS rejected_mask
FROM r
"""
