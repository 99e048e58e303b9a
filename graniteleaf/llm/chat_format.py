"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and only its reply trainable. A
conversation that ends in another turn has one more example without trainable text, so that no turn is lost. Turns look like

    ### <role>
    <text></turn>

and the signs that build these marks are escaped inside roles and texts: backslash, # and < become \\b, \\h and \\l (in
roles a line end becomes \\e), which unescape() takes back exactly, whatever the text holds.
A row holds one conversation, then one example: memory follows the longest conversation, not the table. The examples of
a conversation of n turns hold about n**2 / 2 turns: that is what the method asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, END = "### ", "</turn>\n"


def _swap(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(c: Column) -> Column:
    return _swap(c, [("\\", "\\b"), ("#", "\\h"), ("<", "\\l")])


def unescape(c: Column) -> Column:
    return _swap(c, [("\\l", "<"), ("\\h", "#"), ("\\b", "\\")])


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\e"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\e"), F.lit("\n")))


def examples(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, example (0.. in its conversation), text, loss_start and loss_end (code points of `text`; null without a target), last.

    Rows go by turn (null first; ties by role and text, so repeated rows stand beside each other and all stay). Null
    text and null role count as empty. Null ids form one conversation. Extra columns are not read. An empty table
    gives no example.
    """
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    convs = convs.withColumns({"heads": F.transform("turns", lambda t: F.concat(F.lit(HEAD), escape_role(t["role"]), F.lit("\n"))), "bodies": F.transform("turns", lambda t: escape(t["text"]))})
    convs = convs.withColumn("parts", F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b, F.lit(END))))
    n = F.size("turns")
    of_assistant = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("turns", i)["role"] == "assistant")
    tail = F.when(F.element_at("turns", -1)["role"] != "assistant", F.array(-n)).otherwise(F.array().cast("array<int>"))
    each = convs.select("conv_id", "heads", "bodies", "parts", n.alias("n"), F.posexplode(F.concat(of_assistant, tail)).alias("example", "i"))
    upto = F.abs("i")
    text = F.array_join(F.slice("parts", F.lit(1), upto), "")
    each = each.select("conv_id", "example", "i", "n", text.alias("text"), F.length(F.element_at("bodies", upto)).alias("_body"))
    end = F.when(F.col("i") > 0, F.length("text") - len(END))
    return each.select("conv_id", "example", "text", (end - F.col("_body")).alias("loss_start"), end.alias("loss_end"), (F.abs("i") == F.col("n")).alias("last"))


def parse(text: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    parts = F.filter(F.split(text, END), lambda p: p != "")

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        return F.struct(unescape_role(F.substr(head, F.lit(len(HEAD) + 1))).alias("role"), unescape(F.substr(p, F.length(head) + 2)).alias("text"))

    return F.transform(parts, turn)


def digest(made: DataFrame) -> DataFrame:
    """One row a conversation, read back from its examples: turns by parsing, trained text by cutting at the loss mask."""
    turns = F.when(F.col("last"), parse(F.col("text")))
    each = made.select(
        "conv_id", "example", F.length("text").cast("long").alias("chars"), F.size(turns).alias("n"),
        F.when(F.col("last"), F.sha2(F.array_join(F.transform(parse(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)).alias("sha"),
        F.when(F.col("loss_end").isNotNull(), unescape(F.substr("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))).alias("loss"),
    )
    g = each.groupBy("conv_id").agg(F.max("n").cast("long").alias("n_turns"), F.max("sha").alias("turns_sha256"), F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))).alias("l"), F.sum("chars").alias("formatted_chars"))
    g = g.withColumn("loss", F.array_join(F.transform("l", lambda x: x["loss"]), ""))
    return g.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
