"""Preference formatting of chat conversations (built-in functions only).

A chosen and a rejected conversation meet by pair id in one grouping; their longest common
prefix of turns is rendered once as the prompt, what follows in each as its completion, with the
character spans that a loss may look at (assistant turns). A row is a pair, so a task holds one
pair's turns at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import name

TEMPLATE = ("<|", "|>\n", "<|end|>\n")  # before the role, between role and text, after the text


def turns(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(pair_id, turn, role, text): null role and text read as empty; rows of a null
    conversation belong to none and are left out."""
    return df.select(name(id_col).alias("pair_id"), name(turn_col).cast("long").alias("turn"),
                     F.coalesce(name(role_col), F.lit("")).alias("role"),
                     F.coalesce(name(text_col), F.lit("")).alias("text")).filter("pair_id is not null")


def rendered(t: Column, template: tuple[str, str, str] = TEMPLATE) -> Column:
    head, middle, end = template
    return F.concat(F.lit(head), t["role"], F.lit(middle), t["text"], F.lit(end))


def _mask(side: Column, template: tuple[str, str, str], learn_role: str) -> Column:
    """[begin, end) of text and end mark of every ``learn_role`` turn in the rendered side."""
    empty = F.array().cast("array<array<bigint>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        head = F.length(F.concat(F.lit(template[0]), t["role"], F.lit(template[1]))).cast("long")
        body = F.length(F.concat(t["text"], F.lit(template[2]))).cast("long")
        begin = acc["at"] + head
        span = F.array(F.array(begin, begin + body))
        return F.struct((begin + body).alias("at"),
                        F.concat(acc["spans"], F.when(t["role"] == learn_role, span).otherwise(empty)).alias("spans"))
    return F.aggregate(side, start, step, lambda acc: acc["spans"])


def preference_rows(chosen: DataFrame, rejected: DataFrame, template: tuple[str, str, str] = TEMPLATE,
                    learn_role: str = "assistant") -> DataFrame:
    """One row per pair id that has turns on both sides (``turns()`` tables).

    Columns: pair_id, common_turns, prompt (the common prefix, rendered once), chosen, rejected
    (the rest of each, rendered; empty if there is none), chosen_mask, rejected_mask (character
    spans [begin, end) inside the completion that belong to ``learn_role``, end mark included).

    Turns are equal when role and text are. They are taken in order of turn (null first), role
    and text; a repeated row counts once. A pair without one side is no pair and left out. Empty
    tables give no rows.
    """
    def side(df: DataFrame, which: int) -> DataFrame:
        return df.select("pair_id", F.lit(which).alias("which"), F.struct("turn", "role", "text").alias("t"))

    both = side(chosen, 0).unionByName(side(rejected, 1)).groupBy("pair_id").agg(
        *[F.array_sort(F.collect_set(F.when(F.col("which") == w, F.col("t")))).alias(n) for w, n in ((0, "a"), (1, "b"))])
    both = both.filter((F.size("a") > 0) & (F.size("b") > 0))
    # arrays_zip pads the shorter side with nulls, which differ from any turn.
    differ = F.transform(F.arrays_zip("a", "b"), lambda z: F.coalesce(
        (z["a"]["role"] != z["b"]["role"]) | (z["a"]["text"] != z["b"]["text"]), F.lit(True)))
    first = F.array_position(differ, True)
    both = both.withColumn("common_turns", F.when(first > 0, first - 1).otherwise(F.size("a")).cast("long"))

    def rest(side_: str) -> Column:
        return F.slice(F.col(side_), F.col("common_turns").cast("int") + 1, F.size(side_))

    def text(turns_: Column) -> Column:
        return F.array_join(F.transform(turns_, lambda t: rendered(t, template)), "")

    return both.withColumns({"ra": rest("a"), "rb": rest("b")}).select(
        "pair_id", "common_turns", text(F.slice("a", F.lit(1), F.col("common_turns").cast("int"))).alias("prompt"),
        text(F.col("ra")).alias("chosen"), text(F.col("rb")).alias("rejected"),
        _mask(F.col("ra"), template, learn_role).alias("chosen_mask"), _mask(F.col("rb"), template, learn_role).alias("rejected_mask"))


def reply_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns made from a table of conversations: chosen is a conversation up
    to its last assistant turn, rejected the same with that turn's text replaced by the last
    reply of its neighbour (conv_id with the lowest bit flipped), or without the turn if the
    neighbour has none. Null turns come first, so they belong to both sides; if all assistant
    turns are null, the last is the one with the largest text, only null turns are up to it, and
    on the rejected side the other null turns stay. Conversations without an assistant turn make
    no pair; one whose single turn is dropped on the rejected side has none there and is left out
    by ``preference_rows``."""
    t = conversations
    last = (t.filter("role = 'assistant'").groupBy("pair_id")
            .agg(F.max(F.struct("turn", "text")).alias("reply")))
    upto = t.join(last.select("pair_id", F.col("reply.turn").alias("last_turn"), F.col("reply.text").alias("last_text")), "pair_id").filter(
        "coalesce(turn <= last_turn, turn is null)")
    chosen = upto.select("pair_id", "turn", "role", "text")
    before = upto.filter("turn < last_turn or turn is null and (last_turn is not null or role <> 'assistant' or text <> last_text)").select(
        "pair_id", "turn", "role", "text")
    neighbour = last.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("reply.text").alias("text"))
    swapped = last.select("pair_id", F.col("reply.turn").alias("turn")).join(neighbour, "pair_id").select(
        "pair_id", "turn", F.lit("assistant").alias("role"), "text")
    return chosen, before.unionByName(swapped)
