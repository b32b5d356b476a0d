"""Chat formatting into token-budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens choose spans of whole turns. Every window repeats the system turn and
a limited stretch of the turns before it; the loss mask covers assistant texts where they are
new, so a repeated target is never trained on twice.

Template of a turn: `<turn>` role `<text>` text `<end>` and a line end. Inside role and text a
backslash is written `\\b` and a `<` is written `\\l`, so `<` only ever starts a mark and the
output reads back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm import common

BUDGET = 1024
HISTORY = 128
# Tokens that the marks of a turn stand for.
TURN_TOKENS = 4


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def word_tokens(text: Column) -> Column:
    """Tokens of a text where no vocabulary is at hand: runs of letters and digits, and single marks."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\t-\r \p{L}\p{N}]"))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=word_tokens,
            conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per window: conv, window, formatted, repeated, loss_starts, loss_lengths.

    `repeated` leading turns are context; loss spans are code points of `formatted`, in order. New
    turns of a window have at most `budget` tokens less system turn and history, but for a single
    turn that is longer. Turns are ordered by turn, role and text; null turns come first, null
    roles and texts are empty, rows without conv are one conversation. Whole rows that repeat are
    turns of their own. The system turn is a first turn of role `system`; a later one is any turn.
    A conversation's texts meet in one row only when it is read back for a digest of all of it.
    """
    rows = conversations.select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), common.text_of(text).alias("text"))
    rows = rows.withColumn("cid", F.coalesce(F.col("conv").cast("string"), F.lit("none")))
    order = W.partitionBy("cid").orderBy("turn", "role", "text")
    turns = (rows.withColumn("n", F.row_number().over(order))
             .withColumn("tokens", tokens(F.col("text")) + TURN_TOKENS)
             .withColumn("system", (F.col("n") == 1) & (F.col("role") == "system")))
    turns = common.written(turns.select("cid", "conv", "n", "role", "text", F.col("tokens").cast("long").alias("tokens"),
                                        "system"), "turns")
    in_order = W.partitionBy("cid").orderBy("n")
    before, until = in_order.rowsBetween(W.unboundedPreceding, -1), in_order.rowsBetween(W.unboundedPreceding, 0)
    body = F.when(F.col("system"), 0).otherwise(F.col("tokens"))
    spans = turns.select("cid", "n", "tokens", "system", F.coalesce(F.sum(body).over(before), F.lit(0)).alias("before"),
                         F.max(F.when(F.col("system"), F.col("tokens"))).over(until).alias("kept"))
    room = F.greatest(F.lit(budget - history) - F.coalesce("kept", F.lit(0)), F.lit(2))
    spans = spans.withColumn("half", F.floor(room / 2)).withColumn("long", (F.col("tokens") > F.col("half")) & ~F.col("system"))
    short = F.when(F.col("long") | F.col("system"), 0).otherwise(F.col("tokens"))
    spans = spans.withColumns({
        "longs": F.sum(F.col("long").cast("long")).over(until),
        "cell": F.floor(F.coalesce(F.sum(short).over(before), F.lit(0)) / F.col("half"))})
    whole = F.struct("longs", F.when(F.col("long"), -1).otherwise(F.col("cell")).alias("cell"))
    spans = spans.filter(~F.col("system")).withColumn("part", whole)
    changed = F.coalesce((F.lag("part").over(in_order) != F.col("part")).cast("long"), F.lit(0))
    back = W.partitionBy("cid").orderBy("before").rangeBetween(-history, 0)
    spans = spans.withColumns({"changed": changed, "from": F.min("n").over(back)})
    spans = spans.withColumn("window", F.sum("changed").over(until))
    made = spans.groupBy("cid", "window").agg(F.min(F.struct("n", "from")).alias("head"), F.max("n").alias("last"),
                                              F.max("kept").alias("kept"))
    only = turns.groupBy("cid").agg(F.max("n").alias("n"), F.bool_and("system").alias("system")).filter("system")
    made = made.select("cid", "window", F.col("head.n").alias("first"), F.col("head.from").alias("from"), "last",
                       F.col("kept").isNotNull().alias("with_system"))
    made = made.unionByName(only.select("cid", F.lit(0).cast("long").alias("window"), F.lit(1).alias("first"),
                                        F.lit(1).alias("from"), "n", F.lit(False).alias("with_system")).withColumnRenamed("n", "last"))
    here = F.sequence("from", "last")
    members = made.select("cid", "window", "first", F.explode(
        F.when(F.col("with_system"), F.concat(F.array(F.lit(1)), here)).otherwise(here)).alias("n"))
    new = (F.col("n") >= F.col("first")) | ((F.col("n") == 1) & (F.col("window") == 0))
    laid = members.join(turns, ["cid", "n"]).select(
        "cid", "conv", "window", "n", new.alias("new"), "role", F.concat(F.lit("<turn>"), escaped(F.col("role")), F.lit("<text>")).alias("head"),
        escaped(F.col("text")).alias("body"))
    size = F.char_length("head") + F.char_length("body") + F.lit(6)
    place = W.partitionBy("cid", "window").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    laid = laid.withColumn("start", F.coalesce(F.sum(size).over(place), F.lit(0)) + F.char_length("head"))
    target = F.when(F.col("new") & (F.col("role") == "assistant"), F.struct(
        "n", F.col("start"), F.char_length("body").cast("long").alias("length")))
    out = laid.groupBy("cid", "window").agg(
        F.first("conv").alias("conv"), F.sum((~F.col("new")).cast("long")).alias("repeated"),
        F.array_sort(F.collect_list(F.struct("n", F.concat("head", "body", F.lit("<end>\n")).alias("piece")))).alias("pieces"),
        F.array_sort(F.collect_list(target)).alias("spans"))
    return out.select(F.col("conv").alias(conv), "window", F.array_join(F.col("pieces.piece"), "").alias("formatted"),
                      "repeated", F.col("spans.start").alias("loss_starts"), F.col("spans.length").alias("loss_lengths"))


def read_back(made: DataFrame, conv: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """From windows alone: (turns: conv, window, pos, role, text) and (targets: conv, window, loss text)."""
    pieces = made.select(conv, "window", "repeated", F.posexplode(F.split("formatted", "<end>\n")).alias("pos", "piece"))
    parts = F.split(F.substring_index("piece", "<turn>", -1), "<text>")
    turns = pieces.filter((F.col("piece") != "") & (F.col("pos") >= F.col("repeated"))).select(
        conv, "window", "pos", unescaped(parts[0]).alias("role"), unescaped(parts[1]).alias("text"))
    loss = F.transform(F.arrays_zip("loss_starts", "loss_lengths"), lambda s: unescaped(
        F.substring(F.col("formatted"), (s["loss_starts"] + 1).cast("int"), s["loss_lengths"].cast("int"))))
    return turns, made.select(conv, "window", F.array_join(loss, "").alias("loss"))


def digests(made: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation: conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    turns, losses = read_back(made, conv)
    line = F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("line")
    told = turns.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct("window", "pos", line))).alias("lines")).select(
        F.col(conv).alias("_c"), F.size("lines").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.col("lines.line"), ""), 256).alias("turns_sha256"))
    learned = losses.groupBy(conv).agg(F.array_join(F.array_sort(F.collect_list(
        F.struct("window", "loss")))["loss"], "").alias("loss")).select(
        F.col(conv).alias("_d"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"))
    sizes = made.groupBy(conv).agg(F.sum(F.char_length("formatted")).alias("formatted_chars"))
    return (sizes.join(told, F.col(conv).eqNullSafe(F.col("_c"))).join(learned, F.col(conv).eqNullSafe(F.col("_d")))
            .select(conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"))
