r"""Chat formatting with a grammar round trip, in DataFrame functions alone.

A conversation is a run of turns, `### role: body</turn>` and a line feed each. The
grammar: in a body a backslash makes the next character plain; `</turn>` ends it;
`###` must not stand in it; in a role a colon must not either. Reading is
deterministic, so a turn is first rendered as it is and read back. If the reading
differs from the source, its control strings and backslashes are escaped and it is
read again; a turn that still differed would raise an error. Texts without conflicts
therefore stand in the output unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, END = "### ", "</turn>\n"
# Possessive, so the matcher neither backtracks nor recurses on long bodies.
ROLE = r"(?:[^\\:#]|\\.|#(?!##))*+"
BODY = r"(?:[^\\<#]|\\.|<(?!/turn>)|#(?!##))*+"
TURN = rf"(?s)### ({ROLE}): ({BODY})</turn>\n"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("###"), F.lit("\\#\\#\\#")), F.lit("</turn>"), F.lit("\\</turn>"))
    return F.replace(out, F.lit(":"), F.lit("\\:")) if role else out


def unescape(text: Column) -> Column:
    return F.when(F.instr(text, "\\") > 0, F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(": "), body, F.lit(END))


def parse(formatted: Column) -> Column:
    """array<struct<role, body>> of a whole rendered conversation, bodies as they stand in it."""
    roles, bodies = F.regexp_extract_all(formatted, F.lit(TURN), 1), F.regexp_extract_all(formatted, F.lit(TURN), 2)
    return F.arrays_zip(roles.alias("role"), bodies.alias("body"))


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted string, turns array<struct<role, body>> (read back from formatted), loss array<struct<start, end>> (spans of code points from 0 under the loss mask).

    Turns are ordered by turn, role and text, nulls first, so ties are settled and
    repeated rows stay. A null text or role counts as empty. A null conv_id is one
    conversation. An empty table gives an empty result; other columns are not read.
    A conversation is one value of the result, so its turns meet in one task; all
    work on texts, escaping and checking, is done turn by turn before that.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    turns = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    one = lambda r, b: parse(render(r, b))
    same = lambda read: (F.size(read) == 1) & (unescape(read[0]["role"]) == F.col("role")) & (unescape(read[0]["body"]) == F.col("text"))
    # A text without these characters reads back as itself; only others need the first reading.
    suspect = (F.instr("text", "\\") > 0) | (F.instr("text", "</turn>") > 0) | (F.instr("text", "###") > 0) | F.col("role").rlike(r"[\\:#]")
    plain = F.when(suspect, same(one(F.col("role"), F.col("text")))).otherwise(F.lit(True))
    # What is escaped differs from the source, so a turn read back as identical needs no escape and another does.
    turns = turns.withColumn("plain", plain)
    turns = turns.withColumns({"r": F.when(F.col("plain"), F.col("role")).otherwise(escape(F.col("role"), role=True)), "b": F.when(F.col("plain"), F.col("text")).otherwise(escape(F.col("text")))})
    fine = F.when(F.col("plain"), F.lit(True)).otherwise(same(one(F.col("r"), F.col("b"))))
    turns = turns.withColumn("out", F.when(fine, render(F.col("r"), F.col("b"))).otherwise(F.raise_error(F.lit("a turn does not survive the round trip"))))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = F.sum(F.length("out")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = turns.select("conv_id", "role", "text", "out", F.length("b").alias("n"), upto.alias("upto"))
    close = placed.upto - len(END)
    piece = F.struct("upto", "out", F.when(F.col("role") == loss_role, F.struct((close - F.col("n")).cast("long").alias("start"), close.cast("long").alias("end"))).alias("span"), F.struct("role", "text").alias("source"))
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    formatted = whole.select("conv_id", F.concat_ws("", "p.out").alias("formatted"), F.filter("p.span", lambda s: s.isNotNull()).alias("loss"), F.col("p.source").alias("source"))
    read = formatted.withColumn("turns", parse(F.col("formatted")))
    # The whole is read back once more and compared with what it was made of, turn by turn and span by span.
    own = F.transform("turns", lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["body"]).alias("text")))
    back = read.withColumn("turns", F.when(own == F.col("source"), F.col("turns")).otherwise(F.raise_error(F.lit("a conversation does not survive the round trip"))))
    return back.select("conv_id", "formatted", "turns", "loss")


def masked(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped: the spans cut from the formatted text, one after the other."""
    return F.concat_ws("", F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))))


def query(spark, sf_dir):
    from srcatlas.llm._store import table

    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = format_chats(rows)
    turn = lambda t: F.concat(unescape(t["role"]), F.lit("\n"), unescape(t["body"]), F.lit("\n"))
    under = masked(F.col("formatted"), F.col("loss"))
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.concat_ws("", F.transform("turns", turn)), 256).alias("turns_sha256"), F.length(under).cast("long").alias("loss_chars"), F.sha2(under, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


#: From the source rows, without the parser; only formatted_chars knows the template.
SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
x AS (
  SELECT *, contains(text, '\') OR contains(text, '###') OR contains(text, '</turn>') OR regexp_matches(role, '\\|:|###') AS esc FROM c),
e AS (
  SELECT *, CASE WHEN esc THEN replace(replace(replace(text, '\', '\\'), '###', '\#\#\#'), '</turn>', '\</turn>') ELSE text END AS b,
    CASE WHEN esc THEN replace(replace(replace(replace(role, '\', '\\'), '###', '\#\#\#'), '</turn>', '\</turn>'), ':', '\:') ELSE role END AS r FROM x)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(r) + length(b) + 14) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
