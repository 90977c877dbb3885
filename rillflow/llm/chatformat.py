"""Chat formatting by a finite-state machine over roles and a declarative template (operator 13, built-in functions only)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

START = ""


@dataclass(frozen=True)
class Turn:
    """How a role's turn looks, and whether its text is learned."""

    role: str
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """A state is the role of the last turn (START before the first). ``moves`` lists the (state, role) pairs that are in
    order, ``final`` the states in which a conversation is complete. Roles without a turn of their own are written as
    ``other``: before the role, between role and text, after the text; they are never in order.
    """

    turns: tuple[Turn, ...]
    moves: tuple[tuple[str, str], ...]
    final: tuple[str, ...]
    other: tuple[str, str, str]
    escape: str = "\\"

    def __post_init__(self) -> None:
        """What makes the output readable again: marks that differ, don't overlap and don't hold the escape character."""
        marks = self.controls()
        if len(set(marks)) < len(marks) or any(len(m) < 2 or self.escape in m for m in marks) or len(self.escape) != 1:
            raise ValueError("marks must differ, have two characters and no escape character")
        for a in marks:
            for b in marks:
                if a != b and a in b or any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b)) + (a != b))):
                    raise ValueError(f"marks {a} and {b} overlap")

    def controls(self) -> list[str]:
        """The strings that only marks may hold."""
        return [m.strip() for t in self.turns for m in (t.before, t.after)] + [m.strip() for m in self.other]


TEMPLATE = Template(
    turns=(Turn("system", "[SYS] ", " [/SYS]"), Turn("user", "[INST] ", " [/INST]"), Turn("assistant", "<s>", "</s>", loss=True)),
    moves=((START, "system"), (START, "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")),
    final=("assistant",),
    other=("[ROLE] ", " [TEXT] ", " [/ROLE]"),
)


def escaped(text: Column, template: Template = TEMPLATE) -> Column:
    """Doubles the escape character, then puts one behind the first character of each control string."""
    inside = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in template.controls())
    return F.regexp_replace(F.replace(text, F.lit(template.escape), F.lit(template.escape * 2)), inside, re.escape(template.escape))


def unescaped(text: Column, template: Template = TEMPLATE) -> Column:
    return F.regexp_replace(text, f"(?s){re.escape(template.escape)}(.)", "$1")


def _by_role(role: Column, template: Template, pick: str, other: Column) -> Column:
    return reduce(lambda rest, t: F.when(role == t.role, F.lit(getattr(t, pick))).otherwise(rest), template.turns, other)


def format_chats(rows: DataFrame, template: Template = TEMPLATE, key: str = "conv_id") -> DataFrame:
    """(key, status, bad_turns, formatted, segments) for each conversation of ``rows`` (key, turn, role, text).

    Rows go by turn, equal turns by role, then text, nulls first; repeated rows are turns of their own. A null text or
    role is empty, rows with a null key are one conversation, an empty table gives no row, further columns aren't read.
    bad_turns lists the turns (from 1) that no move of the machine allows; after one the machine goes on from its role.
    status is ``invalid`` with such turns, else ``complete`` or ``open`` by the last state. All are formatted: segments
    are (text, loss) in order, marks and escaped texts apart; their texts joined are ``formatted``. A conversation is one
    value, so it must fit into a row (2 GB).
    """
    text = escaped(F.coalesce(F.col("text").cast("string"), F.lit("")), template)
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    row = F.struct(F.col("turn"), F.col("role").alias("given"), F.col("text").alias("said"), role.alias("role"), text.alias("text"))
    chats = rows.select(F.col(key).alias("k"), row.alias("row")).groupBy("k").agg(F.array_sort(F.collect_list("row")).alias("turns"))

    state = lambda i: F.when(i == 0, F.lit(START)).otherwise(F.col("turns")[i - 1]["role"])
    first, middle, last = template.other

    def move_is_bad(turn: Column, i: Column) -> Column:
        allowed = reduce(lambda a, b: a | b, [(state(i) == s) & (turn["role"] == r) & ((i == 0) == (s == START)) for s, r in template.moves])
        return F.when(allowed, F.lit(0).cast("long")).otherwise((i + 1).cast("long"))

    def emit(turn: Column) -> Column:
        mark = lambda c: F.struct(c.alias("text"), F.lit(False).alias("loss"))
        before = _by_role(turn["role"], template, "before", F.concat(F.lit(first), escaped(turn["role"], template), F.lit(middle)))
        loss = _by_role(turn["role"], template, "loss", F.lit(False))
        return F.array(mark(before), F.struct(turn["text"].alias("text"), loss.alias("loss")), mark(_by_role(turn["role"], template, "after", F.lit(last))))

    made = chats.select(
        "k", F.element_at("turns", -1)["role"].alias("state"), F.array_remove(F.transform("turns", move_is_bad), 0).alias("bad_turns"),
        F.flatten(F.transform("turns", emit)).alias("segments"),
    )
    status = F.when(F.size("bad_turns") > 0, "invalid").when(F.col("state").isin(*template.final), "complete").otherwise("open")
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return made.select(F.col("k").alias(key), status.alias("status"), "bad_turns", formatted.alias("formatted"), "segments")


def read_turns(formatted: Column, template: Template = TEMPLATE) -> Column:
    """The array of (role, text) that a formatted conversation holds: it is cut behind each mark that ends a turn."""
    first, middle, last = template.other
    ends = [t.after.lstrip() for t in template.turns] + [last.lstrip()]
    pieces = F.filter(F.split(formatted, "|".join(f"(?<={re.escape(e)})" for e in ends)), lambda p: p != "")

    def turn(piece: Column) -> Column:
        inner = lambda start, end: F.substring(piece, start, F.length(piece) - end - start + 1)
        at = F.locate(middle.strip(), piece) - (len(middle) - len(middle.lstrip()))
        role, text = F.substring(piece, len(first) + 1, at - len(first) - 1), inner(at + len(middle), len(last))
        for t in template.turns:
            own = piece.startswith(t.before)
            role = F.when(own, F.lit(t.role)).otherwise(role)
            text = F.when(own, inner(F.lit(len(t.before) + 1), len(t.after))).otherwise(text)
        return F.struct(unescaped(role, template).alias("role"), unescaped(text, template).alias("text"))

    return F.transform(pieces, turn)


def read_loss(segments: Column, template: Template = TEMPLATE) -> Column:
    """All text under the loss mask, as it was before escaping."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")


def digests(chats: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """The contract's columns, read back from ``formatted`` and ``segments``; status and bad_turns as they are."""
    read = chats.withColumns({"read": read_turns(F.col("formatted"), template), "learned": read_loss(F.col("segments"), template)})
    lines = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "status", F.array_join("bad_turns", ",").alias("bad_turns"),
    )


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of conversation -1, which is one of its own even where the table has that id; odd
    rows as ``format_chats`` says, an empty table gives only conversation -1."""
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    own = free_name(given)
    both = given.withColumn(own, F.lit(False)).unionByName(added.withColumn(own, F.lit(True)))
    chats = format_chats(both.withColumn("chat", F.struct("conv_id", own)), key="chat")
    return digests(chats.withColumn("conv_id", F.col("chat.conv_id")))


ORACLE_SQL = r"""
WITH given AS (
  SELECT conv_id, false AS own, turn, role AS r, text AS x FROM conversations
  UNION ALL SELECT -1, true, turn, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS added(turn, r)),
rows_ AS (
  SELECT conv_id, own, coalesce(r, '') AS role, coalesce(x, '') AS text,
    row_number() OVER (PARTITION BY conv_id, own ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST) AS n FROM given),
moves AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id, own ORDER BY n) AS state,
    length(regexp_replace(regexp_replace(replace(text, '\', '\\'), '\[(/?(?:SYS|INST|ROLE)\]|TEXT\])', '[\\\1', 'g'), '<(/?s>)', '<\\\1', 'g')) AS chars,
    CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 23 + length(
      regexp_replace(regexp_replace(replace(role, '\', '\\'), '\[(/?(?:SYS|INST|ROLE)\]|TEXT\])', '[\\\1', 'g'), '<(/?s>)', '<\\\1', 'g')) END AS marks
  FROM rows_),
judged AS (
  SELECT *, NOT ((n = 1 AND role IN ('system', 'user')) OR (n > 1 AND state || '>' || role IN ('system>user', 'user>assistant', 'assistant>user'))) AS bad FROM moves)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + marks) AS BIGINT) AS formatted_chars,
  CASE WHEN bool_or(bad) THEN 'invalid' WHEN arg_max(role, n) = 'assistant' THEN 'complete' ELSE 'open' END AS status,
  coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) FILTER (bad), '') AS bad_turns
FROM judged GROUP BY conv_id, own
"""
