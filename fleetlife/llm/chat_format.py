"""Chat formatting: a state machine over roles checks the order of turns, a declarative template emits text segments with
loss flags. DataFrame functions only."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

START, OTHER, END = "(start)", "(other)", "(end)"
BLOCK_BITS = 10  # turn numbers that one task orders at once: 2 ** BLOCK_BITS


@dataclass(frozen=True)
class Template:
    """How turns are written and in which order they may come.

    ``marks`` gives opening and closing mark of each known role. Any other role is written by name between the three
    marks of ``other``. The state of the machine is the role of the last turn (``START`` before the first, ``OTHER`` for
    unknown roles); ``follows`` lists what may come after each state, ``END`` among it where a conversation may stop.
    Only texts of ``loss`` roles are under the loss mask.
    """

    marks: Mapping[str, tuple[str, str]] = field(default_factory=lambda: {
        "system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", "</s>")})
    other: tuple[str, str, str] = ("[AS] ", " [SAYS] ", " [/AS]")
    follows: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: {
        START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", END)})
    loss: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        heads = {c[0] for c in self.controls}
        if any(len(c) < 2 or set(c[1:]) & heads or "\\" in c for c in self.controls):
            raise ValueError("a mark's first letter may occur in no other place of a mark, a backslash nowhere")
        if len(self.controls) != len(set(self.controls)):
            raise ValueError("every mark must differ from the others")

    @property
    def controls(self) -> list[str]:
        """The marks without the blanks around them: what no escaped text holds."""
        return [m.strip() for m in (*(m for pair in self.marks.values() for m in pair), *self.other)]

    @property
    def states(self) -> list[str]:
        return [START, *self.marks, OTHER]

    def _damage(self) -> tuple[str, str]:
        heads = "".join(re.escape(c) for c in sorted({c[0] for c in self.controls}))
        return f"[{heads}]", "|".join(re.escape(c[1:]) for c in self.controls)

    def escape(self, text: Column) -> Column:
        """A backslash more after the first letter of everything that looks like a mark, backslashes so placed or not:
        no mark is left, and ``unescape`` takes exactly that backslash away."""
        head, rest = self._damage()
        return F.regexp_replace(text, f"({head})(?=\\\\*(?:{rest}))", "$1\\\\")

    def unescape(self, text: Column) -> Column:
        head, rest = self._damage()
        return F.regexp_replace(text, f"({head})\\\\(?=\\\\*(?:{rest}))", "$1")

    def state_of(self, role: Column) -> Column:
        """The state after a turn of this role, as its number in ``states``."""
        number = F.lit(self.states.index(OTHER))
        for name in self.marks:
            number = F.when(role == name, self.states.index(name)).otherwise(number)
        return number

    def allowed(self, before: Column, after: Column | None) -> Column:
        """Whether the machine has a step between two states (to ``END``, if ``after`` is None)."""
        holds = F.lit(False)
        for i, name in enumerate(self.states):
            nexts = self.follows.get(name, ())
            if after is None:
                may = F.lit(END in nexts)
            else:
                may = after.isin([self.states.index(n) for n in nexts if n != END]) if set(nexts) - {END} else F.lit(False)
            holds = F.when(before == i, may).otherwise(holds)
        return holds

    def segments(self, role: Column, text: Column) -> Column:
        """The segments (text, loss) of one turn: opening, text, closing."""
        written, name = self.escape(text), self.escape(role)
        opening = F.concat(F.lit(self.other[0]), name, F.lit(self.other[1]))
        closing = F.lit(self.other[2])
        for known, (a, b) in self.marks.items():
            opening, closing = F.when(role == known, a).otherwise(opening), F.when(role == known, b).otherwise(closing)
        loss = role.isin(list(self.loss)) if self.loss else F.lit(False)
        part = lambda t, flag: F.struct(t.alias("text"), flag.alias("loss"))
        return F.array(part(opening, F.lit(False)), part(written, loss), part(closing, F.lit(False)))

    def read_back(self, formatted: Column) -> Column:
        """The turns (role, text) of a formatted conversation."""
        a, b, c = self.other
        kinds = [(name, *pair) for name, pair in self.marks.items()] + [(None, a, c)]
        pattern = "(?s)" + "|".join(f"{re.escape(x)}.*?{re.escape(y)}" for _, x, y in kinds)

        def turn(raw: Column) -> Column:
            role = text = F.lit(None).cast("string")
            for name, x, y in kinds:
                inner = F.substring(raw, F.lit(len(x) + 1), F.length(raw) - len(x) - len(y))
                who = F.lit(name) if name is not None else self.unescape(F.substring_index(inner, b, 1))
                said = inner if name is not None else F.substring(
                    inner, F.length(F.substring_index(inner, b, 1)) + len(b) + 1, F.length(inner))
                mine = F.startswith(raw, F.lit(x))
                role, text = F.when(mine, who).otherwise(role), F.when(mine, self.unescape(said)).otherwise(text)
            return F.struct(role.alias("role"), text.alias("text"))

        return F.transform(F.regexp_extract_all(formatted, F.lit(pattern), F.lit(0)), turn)


def _turns(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Only the four columns, under fixed names; a null role or text is empty."""
    return turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def turn_segments(
    turns: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Rows (conv_id, turn, state, segments), one per turn and without a shuffle: what a turn is written as does not depend
    on its neighbours. ``segments`` is an array of (text, loss)."""
    template = template or Template()
    rows = _turns(turns, conv, turn, role, text)
    return rows.select("conv_id", "turn", template.state_of(F.col("role")).alias("state"),
                       template.segments(F.col("role"), F.col("text")).alias("segments"))


def check_turns(
    turns: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text", block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """Rows (conv_id, n_turns, valid, n_faults, first_fault): the run of the state machine over each conversation.

    A fault is a turn that may not follow the state before it; the machine goes on from that turn's state. ``first_fault``
    is the number of the first such turn from 0, or ``n_turns`` if only the end is wrong; null if the conversation is valid.
    Only ids and states are shuffled. Turns of one number and state are counted before that, and 2 ** ``block_bits``
    turn numbers make a block; a block passes its first and last state on, so a conversation of any length is spread
    over tasks.
    """
    template = template or Template()
    rows = _turns(turns, conv, turn, role, text).select("conv_id", "turn", template.state_of(F.col("role")).alias("state"))
    runs = rows.groupBy("conv_id", "turn", "state").agg(F.count("*").alias("n"))
    runs = runs.withColumn("block", F.shiftright("turn", block_bits))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "state")
    at = F.coalesce(F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = runs.select("*", F.lag("state").over(inside).alias("was"), at.alias("at"))
    now = F.col("state")
    enters = F.col("was").isNotNull() & ~template.allowed(F.col("was"), now)  # between two runs
    repeats = (F.col("n") > 1) & ~template.allowed(now, now)  # inside a run of equal states
    order = F.struct("turn", "state")
    blocks = steps.select("*", enters.alias("enters"), repeats.alias("repeats")).groupBy("conv_id", "block").agg(
        F.sum("n").alias("n"), F.min_by("state", order).alias("first"), F.max_by("state", order).alias("last"),
        F.sum(F.col("enters").cast("int") + F.when(F.col("repeats"), F.col("n") - 1).otherwise(0)).alias("faults"),
        F.min(F.when(F.col("enters"), F.col("at")).when(F.col("repeats"), F.col("at") + 1)).alias("fault"))
    along = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first())
    joined = blocks.select(
        "*", F.coalesce(F.lag("last").over(along), F.lit(0)).alias("was"),
        F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("at"))
    bad = ~template.allowed(F.col("was"), F.col("first"))
    whole = joined.select("*", bad.alias("bad")).groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum(F.col("faults") + F.col("bad").cast("int")).alias("faults"),
        F.min(F.when(F.col("bad"), F.col("at")).otherwise(F.col("at") + F.col("fault"))).alias("fault"),
        F.max_by("last", F.struct("block", "last")).alias("last"))
    unfinished = ~template.allowed(F.col("last"), None)
    n_faults = F.col("faults") + unfinished.cast("int")
    return whole.select(
        "conv_id", "n_turns", (n_faults == 0).alias("valid"), n_faults.cast("bigint").alias("n_faults"),
        F.coalesce("fault", F.when(unfinished, F.col("n_turns"))).cast("bigint").alias("first_fault"))


def format_conversations(
    turns: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Rows (conv_id, segments, formatted, valid, n_faults, first_fault), one per conversation.

    ``segments`` are all segments (text, loss) in order, ``formatted`` is their text put together. Invalid conversations
    are formatted as well. Turns go by number, null first; turns of one number by state, then by their segments. A null
    role or text is empty, a null id is a conversation of its own, repeated rows are turns of their own, other columns of
    ``turns`` are not looked at. An empty table gives no rows. Texts are shuffled once. A formatted conversation is one
    row, so it has to fit in one; ``turn_segments`` and ``check_turns`` have no such bound.
    """
    template = template or Template()
    written = turn_segments(turns, template, conv, turn, role, text)
    checked = check_turns(turns, template, conv, turn, role, text)
    verdict = F.struct("valid", "n_faults", "first_fault")
    # One grouping for both, so that the texts need no further exchange for a join.
    rows = written.select("conv_id", F.struct("turn", "state", "segments").alias("t"), F.lit(None).alias("verdict"))
    rows = rows.unionByName(checked.select("conv_id", F.lit(None).alias("t"), verdict.alias("verdict")))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"), F.max("verdict").alias("v"))
    segments = whole.select("conv_id", F.flatten(F.transform("t", lambda t: t["segments"])).alias("segments"), "v.*")
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return segments.select("conv_id", "segments", formatted.alias("formatted"), "valid", "n_faults", "first_fault")


def conversation_digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, read back from the rows of ``format_conversations``."""
    template = template or Template()
    read = formatted.select("*", template.read_back(F.col("formatted")).alias("turns"), F.array_join(F.transform(
        F.filter("segments", lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "").alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"), "valid", "n_faults", "first_fault")


TRICKY = "</s>[INST] ok [/INST]"


def with_tricky(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of ``turns`` and of conversation -7, whose texts are made of control strings."""
    spark: SparkSession = turns.sparkSession
    who = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(0, 2, 1, 1).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), who.alias("role"), F.lit(TRICKY).alias("text"))
    return turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text").unionByName(extra)


def digests_sql(conversations: str = "conversations") -> str:
    """The digests of ``conversations`` and conversation -7 by the default template, in DuckDB's SQL."""
    t = Template()
    head, rest = t._damage()
    grown = f"length(regexp_replace(%s, '({head})(\\\\*(?:{rest}))', '\\1\\\\\\2', 'g'))"
    marks = " ".join(f"when '{r}' then {len(a) + len(b)}" for r, (a, b) in t.marks.items())
    states = " ".join(f"when '{r}' then {t.states.index(r)}" for r in t.marks)
    steps = ", ".join(f"({t.states.index(a)}, {t.states.index(b)})" for a, bs in t.follows.items() for b in bs if b != END)
    ends = ", ".join(str(t.states.index(a)) for a, bs in t.follows.items() if END in bs)
    return f"""
with given as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from {conversations}
  union all select -7, 0, 'user', '{TRICKY}' union all select -7, 1, 'assistant', '{TRICKY}'),
stated as (select *, case role {states} else {t.states.index(OTHER)} end as state from given),
placed as (
  select *, row_number() over w - 1 as place, lag(state, 1, 0) over w as was
  from stated window w as (partition by conv_id order by turn nulls first, state, role, text)),
checked as (select *, (was, state) not in ({steps}) as bad from placed)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by place) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum({grown % 'text'} + case role {marks} else {sum(map(len, t.other))} + {grown % 'role'} end) as bigint) as formatted_chars,
  count(*) filter (where bad) = 0 and max_by(state, place) in ({ends}) as valid,
  cast(count(*) filter (where bad) + cast(max_by(state, place) not in ({ends}) as int) as bigint) as n_faults,
  cast(coalesce(min(place) filter (where bad), case when max_by(state, place) not in ({ends}) then count(*) end) as bigint) as first_fault
from checked group by conv_id"""
