"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are the
context, and only its text is trainable (`loss_start`, `loss_chars`: a span of
code points in `formatted`). Turns after the last reply, or a conversation
without one, give one more example with nothing trainable, so that no turn is
missing from the output; `closes` marks the example that holds the whole
conversation.

A turn is written as start mark, role, says mark, text, end mark. Inside roles
and texts every control string of the template is broken by a backslash after
its first character; where backslashes stand there already, one is added. Other
text stays as it is, `unescaped` takes exactly that backslash away, and an
escaped text holds no control string, so `read_turns` splits at marks alone.

An example is one row by its definition, and its conversation's prefix lies in
it: turns are formatted where they are read, meet once per conversation, and
the expansion and whatever is read back per conversation need no second
shuffle. Its output grows with the square of one conversation's turns; memory
holds one example at a time beside the conversation.

Defined cases: a null text or role counts as empty; rows without conversation
id form one conversation; rows without turn number come last; turns with one
number are ordered by role, then text; repeated rows are repeated turns; an
empty table gives an empty result; other columns, whatever their names, are not
read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around a turn's role and text, and further control strings that texts may not hold."""

    begin: str = "<|begin_of_text|>"
    start: str = "<|start_header_id|>"
    says: str = "<|end_header_id|>\n\n"
    end: str = "<|eot_id|>"
    trainable: str = "assistant"
    reserved: tuple[str, ...] = ("<|end_of_text|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]")

    def __post_init__(self):
        heads = {c[0] for c in self.controls}
        if any(len(c) < 2 or "\\" in c or heads & set(c[1:]) for c in self.controls):
            raise ValueError("a control string has two or more characters, no backslash and no first character of one inside")

    @property
    def controls(self) -> list[str]:
        return sorted({m.strip() for m in (self.begin, self.start, self.says, self.end, *self.reserved)})

    def patterns(self) -> list[tuple[str, str]]:
        """(first character, alternatives of what follows it) of the control strings, as regular expressions."""
        by_head: dict[str, list[str]] = {}
        for c in self.controls:
            by_head.setdefault(c[0], []).append(_quoted(c[1:]))
        return [(_quoted(head), "|".join(tails)) for head, tails in by_head.items()]


def _quoted(text: str) -> str:
    """`text` as a pattern that Java's and RE2's expressions read alike."""
    return re.sub(r"([\[\]().*+?{}|^$/-])", r"\\\1", text)


def escaped(text: Column, template: Template) -> Column:
    for head, tails in template.patterns():
        text = F.regexp_replace(text, rf"({head})(\\*)({tails})", r"$1\\$2$3")
    return text


def unescaped(text: Column, template: Template) -> Column:
    for head, tails in template.patterns():
        text = F.regexp_replace(text, rf"({head})\\(\\*)({tails})", "$1$2$3")
    return text


def examples(turns: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn",
             role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, example (from 0), n_turns, formatted, loss_start, loss_chars, closes: one row per example."""
    template = template or Template()
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    said = escaped(text, template)
    piece = F.concat(F.lit(template.start), escaped(role, template), F.lit(template.says), said, F.lit(template.end))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).isNull().alias("unknown"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("at"),
        piece.alias("piece"), F.when(role == template.trainable, F.length(said)).alias("loss"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "piece", "loss"))).alias("turns"))
    whole = whole.select("conv_id", F.col("turns.piece").alias("pieces"), F.col("turns.loss").alias("losses"))
    size = F.size("pieces")
    ends = F.filter(F.sequence(F.lit(1), size), lambda i: F.element_at("losses", i).isNotNull() | (i == size))
    each = whole.select("conv_id", "pieces", "losses", F.posexplode(ends).alias("example", "n_turns"))
    loss = F.element_at("losses", F.col("n_turns"))
    made = each.select("conv_id", "example", "n_turns", F.concat(
        F.lit(template.begin), F.array_join(F.slice("pieces", 1, F.col("n_turns")), "")).alias("formatted"),
        loss.alias("loss"), (F.col("n_turns") == size).alias("closes"))
    start = F.length("formatted") - len(template.end) - F.col("loss")
    return made.select("conv_id", "example", "n_turns", "formatted", F.coalesce(start, F.length("formatted")).alias("loss_start"),
                       F.coalesce("loss", F.lit(0)).alias("loss_chars"), "closes")


def loss_text(template: Template | None = None) -> Column:
    """An example's trainable text, unescaped."""
    return unescaped(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_chars")), template or Template())


def read_turns(formatted: str, template: Template | None = None) -> Column:
    """The turns of a formatted example: an array of (role, text), unescaped."""
    template = template or Template()
    body = F.substring(F.col(formatted), F.lit(len(template.begin) + len(template.start) + 1), F.length(formatted))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, template.says, 1)
        skip = F.length(role) + len(template.says)
        return F.struct(unescaped(role, template).alias("role"), unescaped(
            F.substring(piece, skip + 1, F.length(piece) - skip - len(template.end)), template).alias("text"))

    return F.transform(F.split(body, _quoted(template.start), -1), turn)


def digest(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation, read back from its examples: turns, trainable text and length of the output."""
    turns = F.transform(read_turns("formatted", template), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    whole = F.when(F.col("closes"), F.struct(F.size(turns).cast("long").alias("n"), F.sha2(F.array_join(turns, ""), 256).alias("sha")))
    read = formatted.select("conv_id", "example", F.length("formatted").alias("chars"), whole.alias("whole"), loss_text(template).alias("said"))
    per = read.groupBy("conv_id").agg(
        F.max("whole").alias("whole"), F.sum("chars").alias("formatted_chars"),
        F.array_join(F.array_sort(F.collect_list(F.struct("example", "said")))["said"], "").alias("said"))
    return per.select("conv_id", F.col("whole.n").alias("n_turns"), F.col("whole.sha").alias("turns_sha256"),
                      F.length("said").cast("long").alias("loss_chars"), F.sha2("said", 256).alias("loss_sha256"), "formatted_chars")


def oracle(template: Template | None = None) -> str:
    """`digest` of all conversations and conversation -7 in DuckDB's SQL."""
    template = template or Template()

    def esc(column: str) -> str:
        for head, tails in template.patterns():
            column = rf"regexp_replace({column}, '({head})(\\*)({tails})', '\1\\\2\3', 'g')"
        return column

    marks = sum(map(len, (template.start, template.says, template.end)))
    return rf"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o as (select *, row_number() over (partition by conv_id order by turn nulls last, role, text) as i,
             count(*) over (partition by conv_id) as n from t),
l as (select *, {len(template.begin)} + sum({marks} + length({esc("role")}) + length({esc("text")}))
                over (partition by conv_id order by i) as chars from o)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = '{template.trainable}'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by i) filter (role = '{template.trainable}'), '')) as loss_sha256,
       cast(sum(chars) filter (role = '{template.trainable}' or i = n) as bigint) as formatted_chars
from l group by conv_id"""
