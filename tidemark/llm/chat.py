"""Preference pairs of conversations: one rendered prompt and two masked completions.

Both conversations of a pair are ordered by turn. Their longest common prefix of turns
(same role, same text) is rendered once as the prompt; the rest of each is its completion.
The mask of a completion lists the spans [start, end) of code points that are learned
from: the text of assistant turns, with its end mark. A turn is rendered as
``<|role|>`` + newline + text + ``<|end|>`` + newline.

Defined results: a null role or text is rendered as an empty one, but equals only a null
one in the prefix; turns with equal numbers are ordered by role and text; a repeated turn
row counts as often as it occurs; if one conversation is a prefix of the other, its
completion is empty and its mask has no span; a pair that lacks one side keeps the other
and has a null completion there; rows with a null pair id are left out, since nothing
joins them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"


def conversations(turns: DataFrame, id_col: str, turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turns: array of (turn, role, text) in order)."""
    one = F.struct(F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    return turns.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"), F.coalesce(turn["text"], F.lit("")), F.lit(END))


def text_of(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def mask_of(turns: Column) -> Column:
    """Spans of the assistant turns' texts with their end marks, in the rendered completion."""
    kind = "struct<at:int,spans:array<struct<start:int,end:int>>>"

    def step(state: Column, turn: Column) -> Column:
        end = state["at"] + F.length(rendered(turn))
        start = state["at"] + F.length(F.coalesce(turn["role"], F.lit(""))) + 5
        span = F.array(F.struct(start.alias("start"), (end - 1).alias("end")))
        return F.struct(
            end.alias("at"), F.when(turn["role"] == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans")
        ).cast(kind)

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")).cast(kind)
    return F.aggregate(turns, zero, step, lambda s: s["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two turn arrays."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]) & x.isNotNull() & y.isNotNull(), F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask) of (id, turns) tables.

    One equi-join on the pair's id; every pair's turns stay in its own row.
    """
    both = chosen.select("id", F.col("turns").alias("c")).join(rejected.select("id", F.col("turns").alias("r")), "id", "full")
    c, r = F.col("c"), F.col("r")
    none = F.array().cast(both.schema["c"].dataType)
    cut = both.select("id", "c", "r", common_turns(F.coalesce(c, none), F.coalesce(r, none)).alias("n_common"))
    rest = lambda a: F.slice(a, F.col("n_common") + 1, F.greatest(F.size(a), F.lit(1)))
    parts = cut.select("id", "n_common", F.slice(F.coalesce("c", "r"), F.lit(1), F.col("n_common")).alias("p"), rest(c).alias("c"), rest(r).alias("r"))
    return parts.select(
        "id", "n_common", text_of(F.col("p")).alias("prompt"), text_of(c).alias("chosen"), text_of(r).alias("rejected"),
        mask_of(c).alias("chosen_mask"), mask_of(r).alias("rejected_mask"),
    )


def paired_by_answer(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides from one table of conversations (conv_id, turn, role, text).

    Conversations 2k and 2k + 1 are partners. Every conversation is a chosen side; its
    rejected side is the same up to its last assistant turn, whose text is that of the
    partner's last assistant turn; what follows it is left out. Without an assistant turn
    on either side, there is no rejected side.
    """
    own = conversations(turns, "conv_id")
    role = F.transform("turns", lambda t: F.coalesce(t["role"], F.lit("")) == "assistant")
    last = own.withColumn("at", F.size("turns") - F.array_position(F.reverse(role), True).cast("int") + 1).withColumn("answered", F.array_contains(role, True))
    last = last.where("answered")
    answer = last.select(F.col("id").bitwiseXOR(F.lit(1)).alias("id"), F.col("turns")[F.col("at") - 1]["text"].alias("answer"))
    swapped = F.concat(
        F.slice("turns", F.lit(1), F.col("at") - 1),
        F.array(F.col("turns")[F.col("at") - 1].withField("text", F.col("answer"))),
    )
    return own, last.join(answer, "id").select("id", swapped.alias("turns"))
