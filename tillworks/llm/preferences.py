"""Preference pairs: shared turns once as prompt, the rest as two masked completions.

A pair is two conversations, chosen and rejected, as rows of turns. Their longest
common prefix of turns (same role and text, place by place) is rendered once; what
follows is rendered for each side. The result has one row per rendered turn, so a
conversation of any length is never gathered into one row or task: places are
counted in blocks, and the prefix is the smallest place where the sides differ.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.llm.common import place_in_group, staged

BLOCK = 1024
TRAINED_ROLE = "assistant"


def header(role: str = "role"):
    return F.concat(F.lit("<|"), F.coalesce(F.col(role), F.lit("")), F.lit("|>\n"))


def rendered(role: str = "role", text: str = "text"):
    return F.concat(header(role), F.coalesce(F.col(text), F.lit("")), F.lit("<|end|>\n"))


def placed(turns: DataFrame) -> DataFrame:
    """Number the turns of each pair from 0, in the order of turn, role and text; null turns come first."""
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62)).cast("long"))
    order = ["turn", "role", "text"]
    return place_in_group(turns.select("pair_id", "turn", "role", "text"), ["pair_id"], order, block, "place")


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows ``pair_id, part, place, role, rendered, train, train_from`` from two tables ``pair_id, turn, role, text``.

    ``part`` is prompt, chosen or rejected; ``place`` counts the turns of the whole
    conversation from 0; ``train`` marks the turns to learn, the assistant's in the
    completions. Of these the characters from ``train_from`` on are learnt, the answer and its end
    mark but not the role; it is null elsewhere. Null roles and texts are rendered as empty and equal each
    other only; rows with a null pair are left out, as they belong to no pair, and
    so are pairs that only one table has. A side that is a prefix of the other
    has no completion rows. Repeated turns are turns of their own. Extra columns are
    not read; empty tables give no rows.
    """
    sides = {"chosen": placed(chosen.where("pair_id IS NOT NULL")), "rejected": placed(rejected.where("pair_id IS NOT NULL"))}
    rows = [side.withColumn("part", F.lit(name)) for name, side in sides.items()]
    turns = staged(rows[0].unionByName(rows[1]), "preference-turns")
    said = F.sha2(F.to_json(F.struct("role", "text"), {"ignoreNullFields": "true"}), 256)
    at = (
        turns.groupBy("pair_id", "place")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(said).alias("least"),
            F.max(said).alias("most"),
            F.max(F.col("part") == "chosen").alias("has_chosen"),
            F.max(F.col("part") == "rejected").alias("has_rejected"),
        )
        .withColumn("same", (F.col("n") == 2) & (F.col("least") == F.col("most")))
    )
    prefix = staged(
        at.groupBy("pair_id")
        .agg(
            F.min(F.when(~F.col("same"), F.col("place"))).alias("differs"),
            (F.max("place") + 1).alias("places"),
            F.max("has_chosen").alias("has_chosen"),
            F.max("has_rejected").alias("has_rejected"),
        )
        .where("has_chosen AND has_rejected")
        .select("pair_id", F.coalesce("differs", "places").alias("shared")),
        "preference-prefixes",
    )
    shared = F.col("place") < F.col("shared")
    train = F.coalesce(~shared & (F.col("role") == TRAINED_ROLE), F.lit(False))
    return (
        turns.join(prefix, "pair_id")
        .where(~shared | (F.col("part") == "chosen"))
        .select(
            "pair_id",
            F.when(shared, "prompt").otherwise(F.col("part")).alias("part"),
            "place",
            "role",
            rendered().alias("rendered"),
            train.alias("train"),
            F.when(train, F.length(header())).cast("long").alias("train_from"),
        )
    )


def echo_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides from plain conversations.

    Chosen is the conversation as it is. Rejected is the same conversation with its last
    assistant turn replaced by an echo of the first turn's text, and nothing after it.
    A conversation without an assistant turn is both sides alike, so all of it becomes prompt.
    Turns are taken in the order of ``placed``, null turns first: the first row's text is the echo,
    and an answer that has only a null turn has nothing before it. Rows with a null conversation
    belong to no pair and are left out.
    """
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    answer = F.coalesce(F.col("role") == TRAINED_ROLE, F.lit(False))
    ends = turns.groupBy("pair_id").agg(
        F.min(F.struct("turn", "role", "text"))["text"].alias("opening"),
        F.max(F.when(answer, F.col("turn"))).alias("reply"),
        F.bool_or(answer).alias("answered"),
    )
    ends = staged(ends, "conversation-ends")
    earlier = F.col("reply").isNotNull() & (F.col("turn").isNull() | (F.col("turn") < F.col("reply")))
    before = turns.join(ends.drop("opening"), "pair_id").where(~F.col("answered") | earlier).select("pair_id", "turn", "role", "text")
    echo = ends.where("answered").select("pair_id", F.col("reply").alias("turn"), F.lit(TRAINED_ROLE).alias("role"), F.col("opening").alias("text"))
    return turns, before.unionByName(echo)
