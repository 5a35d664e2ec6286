"""Chat formatting from a declarative template.

A conversation's rows, ordered by turn, become one text in which every turn is

    ### Role: escaped text</turn>\\n

with the label, the end marker and whether the turn is trained on taken from a template. Marks
that occur inside a text are escaped, and the escape is undone exactly when the output is read
back. A finite-state machine over the roles says whether the turns' order is a valid one; its
states and transitions are the template's, evaluated as one fold over the roles.

All of it is DataFrame expressions. The output of a conversation is its formatted text, its
segments (text, loss) that concatenate to it, and the validity.

Escapes: a backslash becomes two; "###" becomes backslash h; "</turn>" becomes backslash t; in
a role, ":" becomes backslash c besides. Read from the left, two backslashes are always a pair,
so splitting at pairs first undoes it.

Defined results: a null text is an empty one and a null role an empty one; a null turn comes
first, and rows of equal turn are ordered by role and text, so a repeated row is a repeated
turn; a null conversation id is a conversation of its own; roles that the template does not
name are formatted under their own name, without loss, and make the order invalid; an empty
table gives no conversations; other columns are not read. A conversation's text is one value of the
output, so one task holds its turns: its limit is Spark's two gigabytes for a value, and no
conversation shares a task's memory with another but its neighbours in the sort.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.llm._common import table

HEAD, END = "### ", "</turn>"


@dataclass(frozen=True)
class Template:
    """Labels and loss flags of the roles, and the machine that validates their order."""

    labels: Mapping[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    final: frozenset[str] = frozenset({"answered"})
    moves: Mapping[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "instructed",
            ("start", "user"): "asked",
            ("instructed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )


def escape(col: Column) -> Column:
    out = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("###"), F.lit("\\h"))
    return F.replace(out, F.lit(END), F.lit("\\t"))


def unescape(col: Column) -> Column:
    def one(x: Column) -> Column:
        x = F.replace(x, F.lit("\\h"), F.lit("###"))
        return F.replace(F.replace(x, F.lit("\\t"), F.lit(END)), F.lit("\\c"), F.lit(":"))

    return F.array_join(F.transform(F.split(col, r"\\\\", -1), one), "\\")


def _pick(role: Column, by: Mapping[str, str], other: Column) -> Column:
    out = other
    for name, value in by.items():
        out = F.when(role == name, F.lit(value)).otherwise(out)
    return out


def format_conversations(
    rows: DataFrame, template: Template | None = None, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(id, formatted, segments array<struct<text, loss>>, valid, first_bad) per conversation.

    first_bad: the number, from 0, of the turn that no move allows; null where there is none.
    """
    t = template or Template()
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    c = rows.groupBy(F.col(id_col).alias("__id")).agg(F.sort_array(F.collect_list(turn)).alias("__t"))

    def segments(x: Column) -> Column:
        own = F.replace(escape(x["role"]), F.lit(":"), F.lit("\\c"))
        # a role outside the template that reads like a label keeps apart by its leading mark
        label = _pick(x["role"], t.labels, F.concat(F.lit("\\c"), own))
        return F.array(
            F.struct(F.concat(F.lit(HEAD), label, F.lit(": ")).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(x["text"]).alias("text"), x["role"].isin(*t.loss).alias("loss")),
            F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss")),
        )

    def move(a: Column, x: Column) -> Column:
        state = F.lit("error")
        for (at, role), to in t.moves.items():
            state = F.when((a["state"] == at) & (x["role"] == role), F.lit(to)).otherwise(state)
        bad = F.when((state == "error") & (a["state"] != "error"), a["n"])
        return F.struct(state.alias("state"), (a["n"] + 1).alias("n"), F.coalesce(a["bad"], bad).alias("bad"))

    begin = F.struct(F.lit(t.start).alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))
    c = c.withColumn("__fsm", F.aggregate("__t", begin, move)).withColumn("__s", F.flatten(F.transform("__t", segments)))
    return c.select(
        F.col("__id").alias(id_col),
        F.array_join(F.transform("__s", lambda s: s["text"]), "").alias("formatted"),
        F.col("__s").alias("segments"),
        F.col("__fsm")["state"].isin(*t.final).alias("valid"),
        F.col("__fsm")["bad"].alias("first_bad"),
    )


def parse(formatted: Column, template: Template | None = None) -> Column:
    """The formatted text back as array<struct<role, text>>."""
    t = template or Template()
    roles = {label: role for role, label in t.labels.items()}
    parts = F.split(formatted, END + "\n", -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)  # nothing stands after the last end mark

    def one(x: Column) -> Column:
        label = F.substring_index(F.substr(x, F.lit(len(HEAD) + 1)), ": ", 1)
        own = F.substr(unescape(label), F.lit(2))
        text = F.substr(x, F.length(label) + len(HEAD) + 3)
        return F.struct(_pick(label, roles, own).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, one)


def _hex(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    odd = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = format_conversations(rows).select("*", parse(F.col("formatted")).alias("turns"))
    trained = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    read = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select("*", trained.alias("trained"), read.alias("read")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        _hex(F.col("read")).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        _hex(F.col("trained")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t') AS esc,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS last
  FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### ' || CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
                       ELSE '\c' || replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), ':', '\c') END
                       || ': ' || esc || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars,
       bool_and(CASE WHEN k = 1 THEN role IN ('system', 'user')
                     WHEN last = 'system' THEN k = 2 AND role = 'user'
                     WHEN last = 'user' THEN role = 'assistant'
                     ELSE role = 'user' END
                AND (k < n OR role = 'assistant')) AS valid
FROM e GROUP BY conv_id
"""
