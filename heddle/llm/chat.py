"""Chat formatting by a grammar round trip, in DataFrame functions only.

    conversation := turn*
    turn         := "### " role ":" LF text LF "</turn>" LF

Inside roles and texts a backslash before one of \\ # < : stands for that character (in roles, before
n, for a line feed), so that the parser can never take content for a mark. A turn is first rendered as it is; the text is then
reparsed, and only if what comes back differs from the source is the conflicting content escaped: first
the strings that look like marks, then every special character. A result that doesn't reparse to the
source raises an error instead of being returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.native import let, running

END = "\n</turn>\n"


def _escape(content: Column, level: int) -> Column:
    if level == 0:
        return content
    if level == 1:  # only what looks like a mark or an escape
        return F.regexp_replace(content, r"(\\(?=[\\#<:n])|\\$|#(?=## )|<(?=/turn>))", r"\\$1")
    return F.regexp_replace(content, r"([\\#<:])", r"\\$1")


def _plain(content: Column) -> Column:
    """What the parser reads for escaped content: each backslash pair stands for its second character."""
    return F.when(F.instr(content, "\\") > 0, F.regexp_replace(content, r"\\([\\#<:])", "$1")).otherwise(content)


def body(content: Column) -> Column:
    """The least escaped form of a role or text that reads back as itself, free of marks."""

    def safe(form: Column) -> Column:
        return (_plain(form) == content) & ~form.rlike(r"(?<!\\)(?:\\\\)*(?:### |</turn>)")

    first, second, third = (_escape(content, n) for n in range(3))
    return F.when(safe(first), first).when(safe(second), second).otherwise(third)


def role_name(role: Column) -> Column:
    """A role is one line without a colon; others are escaped whole."""
    return F.when(role.rlike(r"^[^\\#<:\n]*\z"), role).otherwise(F.regexp_replace(F.regexp_replace(role, r"([\\#<:])", r"\\$1"), "\n", r"\\n"))


def plain_role(name: Column) -> Column:
    """Undo role_name: pairs are read from the left, n for a line feed."""
    pieces = F.regexp_extract_all(name, F.lit(r"(?s)\\.|[^\\]+|\\$"), F.lit(0))
    read = F.array_join(F.transform(pieces, lambda p: F.when(p == "\\n", "\n").when(p.startswith("\\") & (F.length(p) == 2), F.substring(p, 2, 1)).otherwise(p)), "")
    return F.when(F.instr(name, "\\") > 0, read).otherwise(name)


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("### "), role_name(t["role"]), F.lit(":\n"), body(t["text"]), F.lit(END))), "")


def parsed(formatted: Column) -> Column:
    """array<struct<role, text, start, end>>: the turns and where each text lies in the formatted string (code points)."""
    pieces = F.filter(F.split(formatted, r"(?<=\n</turn>\n)(?=### |\z)"), lambda p: p != "")

    def turn(p: Column, at: Column) -> Column:
        head = F.regexp_extract(p, r"(?s)^### ((?:\\.|[^\\:]+)*+):\n", 1)
        start = F.length(head) + 6
        text = F.substring(p, start + 1, F.length(p) - start - len(END))
        # the text is read once: where it holds no escape, it is what stands in the formatted string
        return F.struct(plain_role(head).alias("role"), _plain(text).alias("text"), (at + start).alias("start"), (at + F.length(p) - len(END)).alias("end"))

    return let(pieces, lambda ps: let(running(F.transform(ps, F.length)), lambda at: F.transform(ps, lambda p, i: turn(p, F.get(at, i)))))


def format_conversations(rows: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, turns (read back from it) and loss (spans and texts of the trained role) of each conversation.

    Rows (conv_id, turn, role, text) are put in order by turn; rows of one turn by role, then text;
    repeated rows are turns of their own. Null roles and texts are empty; a null conv_id is a
    conversation; rows with a null turn come first; an empty table gives no rows; other columns are
    ignored; texts and conversations of any length cost in proportion to it. A conversation is one string and so lies in one row; different conversations share nothing.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("rows"))
    source = gathered.select("conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("source"))
    out = source.withColumn("formatted", rendered(F.col("source"))).withColumn("read", parsed(F.col("formatted")))
    back = F.transform("read", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    same = F.when(back == F.col("source"), F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("a formatted conversation does not read back: "), F.col("conv_id").cast("string"))).cast("string"))
    return out.select(
        "conv_id", same.alias("formatted"), back.alias("turns"),
        F.transform(F.filter("read", lambda t: t["role"] == trained_role), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["text"].alias("text"))).alias("loss"),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars; read from the formatted strings."""
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under_loss = F.array_join(F.transform("loss", lambda s: s["text"]), "")
    return formatted.withColumn("loss_text", under_loss).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(all_turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_probe(conversations: DataFrame, spark: SparkSession) -> DataFrame:
    """The table and conversation -7, whose texts hold an escape and two marks."""
    said = "\\### Assistant: </turn> ok"
    turns = F.array(*(F.struct(F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role")) for k, role in enumerate(("user", "assistant"))))
    probe = spark.range(1).select(F.explode(turns).alias("t")).select(F.lit(-7).cast("long").alias("conv_id"), "t.turn", "t.role", F.lit(said).alias("text"))
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)
