"""Chat formatting for preference pairs.

Conversations that open with the same turn are answers to one prompt. Within such a group they are sorted by
content, so that neighbours share long prefixes, and paired two by two. Of a pair, the conversation with the
higher score is chosen, the other rejected (ties: the smaller identifier is chosen). Their longest common
prefix of turns (equal role and text) is rendered once, as the prompt; what follows in each is its completion.
A completion's mask lists the character ranges that a model is trained on: the content of assistant turns and
the end mark after it, never a user's or a system's words.

Sorting is a distributed range sort on whole contents and identifier, so an opening that a third of all
conversations share is dealt over many tasks; ranks within an opening are differences of global ranks, and pairs are
gathered by the global rank of their first conversation.

Defined cases: null turn texts and roles render as empty; an opening that one conversation has, and the last of
an odd number, give a row without a rejected side (the whole conversation after its first turn is the chosen
completion); equal conversations have empty completions; repeated (conversation, turn) rows follow each other
by role and text; turns with a null conversation are one conversation; extra columns do not matter; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import materialise, ranked, sized_join

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def conversations(df: DataFrame) -> DataFrame:
    """(conv_id, turns array of (role, text), opening, content): one row a conversation."""
    clean = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    rows = rows.withColumn("turns", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))))
    content = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\x1f"), x["text"], F.lit("\x1e"))), "")
    first = F.col("turns")[0]
    return rows.select("conv_id", "turns", F.sha2(F.concat(first["role"], F.lit("\x1f"), first["text"]), 256).alias("opening"), content.alias("content"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(F.lit(OPEN), x["role"], F.lit(CLOSE), x["text"], F.lit(END))), "")


def mask(turns: Column) -> Column:
    """Character ranges "start-end", end excluded, of assistant content with its end mark."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(a, x):
        head = a["at"] + F.length(x["role"]) + len(OPEN) + len(CLOSE)
        end = head + F.length(x["text"]) + len(END)
        span = F.concat(head.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(x["role"] == "assistant", F.array_append(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, start, step)["spans"], ",")


def common_turns(a: Column, b: Column) -> Column:
    """Turns that both begin with."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(differ == 0, F.size(a)).otherwise(differ - 1).cast("int")


def assistant_chars(turns: Column) -> Column:
    return F.aggregate(turns, F.lit(0), lambda a, x: a + F.when(x["role"] == "assistant", F.length(x["text"])).otherwise(0))


def preference_pairs(df: DataFrame, score=assistant_chars) -> DataFrame:
    """(chosen_id, rejected_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask)."""
    order = [F.col("opening"), F.col("content"), F.col("conv_id")]
    sorted_ = ranked(conversations(df), order, "rank", "conversations")
    starts = materialise(sorted_.groupBy("opening").agg(F.min("rank").alias("start")), "openings")
    # the rank of a pair's first conversation numbers the pair over all openings, so pairs are dealt by it, not by opening
    paired = sized_join(sorted_, starts, "opening", "inner").withColumn("pair", F.col("rank") - (F.col("rank") - F.col("start")) % 2)
    side = F.struct(-score(F.col("turns")), F.col("conv_id").alias("conv_id"), F.col("turns").alias("turns"))
    pairs = paired.groupBy("pair").agg(F.sort_array(F.collect_list(side)).alias("s"))
    a, b = F.col("s")[0], F.get("s", F.lit(1))
    pairs = pairs.select(a["conv_id"].alias("chosen_id"), b["conv_id"].alias("rejected_id"), a["turns"].alias("a"), b["turns"].alias("b"), (F.size("s") == 2).alias("both"))
    pairs = pairs.withColumn("n", F.when(F.col("both"), common_turns(F.col("a"), F.col("b"))).otherwise(1))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.lit(0), F.size(c) - F.col("n")))
    pairs = pairs.withColumn("x", rest("a")).withColumn("y", F.when(F.col("both"), rest("b")))
    return pairs.select("chosen_id", "rejected_id", F.col("n").alias("n_prompt_turns"), render(F.slice("a", F.lit(1), F.col("n"))).alias("prompt"), render(F.col("x")).alias("chosen"), render(F.col("y")).alias("rejected"), mask(F.col("x")).alias("chosen_mask"), mask(F.col("y")).alias("rejected_mask"))
