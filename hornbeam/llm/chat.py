"""Chat formatting: a finite-state machine over roles, and a declarative template.

The template says how a turn begins and ends for each role, which roles are trained on, which
character sequences are control strings, and which role may follow which. The result is the text
segments of a conversation with a loss flag each. Control strings inside texts are escaped so that no
marker can appear there and every text can be read back.

Style: DataFrame functions only. One shuffle, by conversation; a turn is escaped before it, and a
conversation is one row after it, as its digest needs all its turns in order.

Defined cases: turns go by turn number (nulls first), ties by role and text; repeated rows are turns
of their own; a null text or role counts as empty; unknown roles are formatted under their own name and
make the order invalid; rows with a null conv_id form one conversation; other columns are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hornbeam.llm.common import table


@dataclass(frozen=True)
class Template:
    """begin + name + colon + text + end, for each turn."""

    begin: str = "### "
    colon: str = ": "
    end: str = "</turn>\n"
    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    trained: tuple[str, ...] = ("assistant",)
    #: The state machine: a state is the role of the last turn; "" is the start.
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)
    #: In texts every backslash becomes its code first, then each of these; codes contain none of them.
    codes: tuple[tuple[str, str], ...] = (("\\", "\\e"), ("###", "\\h\\h\\h"), ("</turn>", "\\t"))
    #: What reading back replaces, in this order.
    decodes: tuple[tuple[str, str], ...] = (("\\c", ":"), ("\\t", "</turn>"), ("\\h", "#"), ("\\e", "\\"))

    def escape(self, text: Column) -> Column:
        for a, b in self.codes:
            text = F.replace(text, F.lit(a), F.lit(b))
        return text

    def unescape(self, text: Column) -> Column:
        for a, b in self.decodes:
            text = F.replace(text, F.lit(a), F.lit(b))
        return text

    def head(self, role: Column) -> Column:
        """The marker that begins a turn; an unknown role is spelled out behind a sign."""
        name = F.concat(F.lit("="), F.replace(self.escape(role), F.lit(":"), F.lit("\\c")))
        for r, n in self.names.items():
            name = F.when(role == r, n).otherwise(name)
        return F.concat(F.lit(self.begin), name, F.lit(self.colon))


CHAT = Template()


def format_conversations(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """conv_id, segments (text and loss flag, in order), formatted, valid, complete, state.

    ``valid``: every move from turn to turn is one that the template allows; ``complete``: it also ends
    in a final state; ``state``: where the machine stopped, ``error`` after a move that is not allowed.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turn = F.struct(F.col("turn"), role.alias("role"), text.alias("plain"), template.head(role).alias("head"), template.escape(text).alias("body"))
    rows = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    moves = F.create_map(*[F.lit(x) for a, to in template.moves.items() for b in to for x in (f"{a}>{b}", b)])
    step = lambda s, t: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit(">"), t["role"])), F.lit("error"))
    rows = rows.select(
        "conv_id",
        F.flatten(F.transform("turns", lambda t: F.array(segment(t["head"], F.lit(False)), segment(t["body"], t["role"].isin(*template.trained)), segment(F.lit(template.end), F.lit(False))))).alias("segments"),
        F.aggregate("turns", F.lit(""), step).alias("state"),
    )
    return rows.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), (F.col("state") != "error").alias("valid"), F.col("state").isin(*template.final).alias("complete"), "state")


def read_back(formatted: Column, template: Column | Template = CHAT) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    roles = F.create_map(*[F.lit(x) for r, n in template.names.items() for x in (n, r)])
    pieces = F.split(formatted, r"\Q" + template.end + r"\E", -1)

    def turn(piece: Column) -> Column:
        name = F.substring_index(piece, template.colon, 1)
        short = F.substring(name, len(template.begin) + 1, 1 << 30)
        role = F.coalesce(F.try_element_at(roles, short), template.unescape(F.substring(short, 2, 1 << 30)))
        return F.struct(role.alias("role"), template.unescape(F.substr(piece, F.char_length(name) + len(template.colon) + 1)).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def loss_text(segments: Column, template: Template = CHAT) -> Column:
    """All text under the loss mask, as it was before escaping."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    done = format_conversations(rows.unionByName(more)).select("*", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(listed).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), "valid", "complete")


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), each AS (
  SELECT *, 4 + CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role)
                     ELSE 1 + length(replace(replace(replace(replace(role, '\', '\e'), '###', '\h\h\h'), '</turn>', '\t'), ':', '\c')) END + 2
            + length(replace(replace(replace(text, '\', '\e'), '###', '\h\h\h'), '</turn>', '\t')) + 8 AS chars,
         CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END AS code
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars,
       regexp_full_match(string_agg(code, '' ORDER BY turn NULLS FIRST, role, text), 's?(ua)*u?') AS valid,
       regexp_full_match(string_agg(code, '' ORDER BY turn NULLS FIRST, role, text), 's?(ua)+') AS complete
FROM each GROUP BY conv_id
"""
