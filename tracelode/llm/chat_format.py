"""Conversations as training text: a finite-state machine over roles checks the order of turns and emits text segments with loss flags.

A template is data: for each (state, role) a rule says what stands before and after the turn's text, whether the text counts for
the loss, and the next state; a role without a rule in a state is out of order and takes the rule of its role alone, or the
one for unknown roles, which writes the role's name.  The template's control strings can't occur in what a text becomes: an
escape character goes after the first character of each, and is doubled where the text has it.  Undoing that gives every text back.

One turn of the output is one row: its number, its three segments (marks, escaped text, marks) with loss flags, and whether its order was right.
Concatenating the segments of a conversation by turn gives its formatted text.  ``read`` gets role and text back from the segments alone.

Turns are sorted by range, not by conversation: a conversation of any length is cut across partitions, and no task holds one.  The machine
runs through each partition once from every state that could precede it; the maps from first to last state of the partitions, a row each, are
composed in order on the driver, which tells each partition its true first state.  The sorted rows are written to the shared folder, so a
lost executor repeats its own partition only.  Marks are put around the texts by DataFrame functions.

Defined cases: a null text is an empty one; a null role is an unknown role without a name; rows with a null id are one conversation, which comes
first; rows of one turn number are ordered by role, then text, and null numbers come first; repeated rows are turns of their own; an empty table gives no
rows; of other columns than the four none is read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path, partitions

#: What stands for a role without a name where the machine looks rules up.
UNKNOWN = ""


@dataclass(frozen=True)
class Rule:
    """How a turn is written, and the machine's next state."""

    before: str
    after: str
    loss: bool
    goes: str


@dataclass(frozen=True)
class Template:
    """rules by (state, role); by_role where a role comes out of order; controls are the strings that texts must not hold.

    ``named`` is put around the name of a role that by_role doesn't know, before a text that ``named_after`` ends.
    """

    start: str
    rules: dict[tuple[str, str], Rule]
    by_role: dict[str, Rule]
    accepts: frozenset[str]
    controls: tuple[str, ...]
    named: tuple[str, str]
    named_after: str
    escape: str = "\\"
    states: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        reached = [self.start, *(r.goes for r in [*self.rules.values(), *self.by_role.values()]), UNKNOWN]
        object.__setattr__(self, "states", tuple(dict.fromkeys(reached)))
        if any(len(c) < 2 or self.escape in c for c in self.controls):
            raise ValueError("a control string has two characters at least and no escape character")
        marks = [m for r in [*self.rules.values(), *self.by_role.values()] for m in (r.before, r.after)] + [*self.named, self.named_after]
        bare = re.compile("|".join(re.escape(c) for c in sorted(self.controls, key=len, reverse=True)))
        if any(bare.sub("", m).strip() for m in marks):
            raise ValueError("marks consist of control strings and white space, else texts could imitate them")
        if any(m.endswith(c[:k]) or m.startswith(c[k:]) for m in marks if m for c in self.controls for k in range(1, len(c))):
            raise ValueError("no mark ends or begins within a control string, else texts beside it could complete that")
        begins = [(r.before, n) for (_, n), r in self.rules.items()] + [(r.before, n) for n, r in self.by_role.items()] + [(self.named[0], UNKNOWN)]
        if any(a.startswith(b) and m != n for a, m in begins for b, n in begins):
            raise ValueError("a turn's first mark tells its role")

    def step(self, state: str, role: str) -> tuple[str, bool]:
        """The next state, and whether the role is in order."""
        rule = self.rules.get((state, role))
        if rule:
            return rule.goes, True
        return (self.by_role[role].goes if role in self.by_role else UNKNOWN), False


#: Instruction template: fixed marks of a widely used public chat format, and one more pair for roles that it doesn't know.
_SYSTEM, _FIRST_SYSTEM = Rule("<<SYS>>\n", "\n<</SYS>>\n\n", False, "system"), Rule("<s><<SYS>>\n", "\n<</SYS>>\n\n", False, "system")
_USER, _FIRST_USER = Rule("[INST] ", " [/INST]", False, "user"), Rule("<s>[INST] ", " [/INST]", False, "user")
_ASSISTANT = Rule(" ", " </s>", True, "assistant")
INSTRUCT = Template(
    start="start",
    rules={
        ("start", "system"): _FIRST_SYSTEM,
        ("start", "user"): _FIRST_USER,
        ("system", "user"): _USER,
        ("user", "assistant"): _ASSISTANT,
        ("assistant", "user"): _FIRST_USER,
    },
    by_role={"system": _SYSTEM, "user": _USER, "assistant": _ASSISTANT},
    accepts=frozenset({"assistant"}),
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[TURN]", "[/TURN]", "[END]"),
    named=("[TURN]", "[/TURN]"),
    named_after="[END]",
)


def escaped(text: Column, template: Template = INSTRUCT) -> Column:
    """The text with its escape characters doubled and one after the first character of each control string, overlapping ones included."""
    e = template.escape
    doubled = F.replace(text, F.lit(e), F.lit(e + e))
    starts = "|".join(f"(?<={_java(c[0])})(?={_java(c[1:])})" for c in template.controls)
    return F.regexp_replace(doubled, starts, _java_text(e))


def unescaped(text: Column, template: Template = INSTRUCT) -> Column:
    """The text that ``escaped`` was given."""
    e = _java(template.escape)
    return F.regexp_replace(text, f"{e}({e}?)", "$1")


def _java(text: str) -> str:
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)


def _java_text(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def format_turns(rows: DataFrame, template: Template = INSTRUCT, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """key, place (a number that grows with a conversation's turns), state (after the turn), in_order, segments (text, loss: marks, escaped text, marks)."""
    spark, order = rows.sparkSession, ["k", "turn", "role", "text"]
    turns = rows.select(F.col(key).cast("long").alias("k"), F.col(turn).cast("long").alias("turn"), _filled(role).alias("role"), _filled(text).alias("text"))
    path = new_path(spark, "turns")
    turns.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(_machine(template), _TURNS).write.parquet(path)
    turns = spark.read.schema(_TURNS).parquet(path)
    came = spark.createDataFrame(list(_first_states(turns).items()), "part int, came int")
    # of the first conversation of a partition the machine tried every state before it; elsewhere there is one
    tried = F.when(F.size("before") > 1, F.col("came")).otherwise(0)
    turns = turns.join(F.broadcast(came), "part")  # a row a partition
    return _written(turns.withColumn("state", F.get("before", tried)), template).withColumnRenamed("k", key)


_TURNS = "k long, role string, text string, part int, place long, before array<int>, after array<int>"


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _first_states(turns: DataFrame) -> dict[int, int]:
    """The state that precedes each partition's first turn, from one row a partition."""
    first, last = F.min_by(F.struct("k"), "place"), F.max_by(F.struct("k", "after"), "place")
    came, before, state = {}, None, 0
    for r in turns.groupBy("part").agg(first.alias("first"), last.alias("last")).orderBy("part").collect():
        came[r["part"]] = state if before == (r["first"]["k"],) else 0
        after = r["last"]["after"]
        before, state = (r["last"]["k"],), after[came[r["part"]] if len(after) > 1 else 0]
    return came


def _machine(template: Template):
    """Runs over a partition's sorted turns: the states before and after each, from every state if its conversation may have begun in a partition before."""
    number = {s: k for k, s in enumerate(template.states)}

    def step(states: tuple[int, ...], role: str) -> tuple[int, ...]:
        return tuple(number[template.step(template.states[s], role)[0]] for s in states)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        known: dict[tuple, tuple] = {}
        last, states = None, tuple(number.values())
        for batch in batches:
            before, after = [], []
            for k, role in zip(batch.column("k").to_pylist(), batch.column("role").to_pylist(), strict=True):
                if place + len(before) and k != last:
                    states = (0,)
                last, at = k, (states, role if role in template.by_role else UNKNOWN)
                if at not in known:
                    known[at] = step(*at)
                before.append(states)
                states = known[at]
                after.append(states)
            n = len(before)
            places = pa.array(range((part << 33) + place, (part << 33) + place + n), pa.int64())
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (before, after)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k", "role", "text")), pa.array([part] * n, pa.int32()), places, *lists], ["k", "role", "text", "part", "place", "before", "after"])
            place += n

    return run


def _written(turns: DataFrame, template: Template) -> DataFrame:
    """The segments of turns with the state before each."""
    number = {s: k for k, s in enumerate(template.states)}
    cases = [((F.col("state") == number[s]) & (F.col("role") == r), rule, True) for (s, r), rule in template.rules.items()]
    cases += [(F.col("role") == r, rule, False) for r, rule in template.by_role.items()]
    name = F.concat(F.lit(template.named[0]), escaped(F.col("role"), template), F.lit(template.named[1]))

    def chosen(of, otherwise: Column) -> Column:
        out = F
        for when, rule, right in cases:
            out = out.when(when, F.lit(of(rule, right)))
        return out.otherwise(otherwise)

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    never, unknown = F.lit(False), F.lit(number[UNKNOWN])
    marks = segment(chosen(lambda r, _: r.before, name), never), segment(chosen(lambda r, _: r.after, F.lit(template.named_after)), never)
    body = segment(escaped(F.col("text"), template), chosen(lambda r, _: r.loss, never))
    state = F.element_at(F.array(*map(F.lit, template.states)), chosen(lambda r, _: number[r.goes], unknown) + 1)
    return turns.select("k", "place", state.alias("state"), chosen(lambda _, right: right, never).alias("in_order"), F.array(marks[0], body, marks[1]).alias("segments"))


def write(rows: DataFrame, template: Template = INSTRUCT, **columns: str) -> str:
    """The folder with the formatted turns as Parquet, a row a turn."""
    path = new_path(rows.sparkSession, "chat")
    format_turns(rows, template, **columns).write.parquet(path)
    return path


def read(output: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """The output's columns with role and text, found again in the joined segments, loss_text (unescaped) and n_chars of the joined segments."""
    joined = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    rows = output.withColumn("joined", joined)
    whole, (opens, closes) = F.col("joined"), template.named
    role, text = F, F
    marks = {(r.before, r.after): n for n, r in template.by_role.items()} | {(r.before, r.after): n for (_, n), r in template.rules.items()}
    for (before, after), name in marks.items():
        here = whole.startswith(before)
        role, text = role.when(here, F.lit(name)), text.when(here, F.substring(whole, F.lit(len(before) + 1), F.length(whole) - len(before) - len(after)))
    end = F.locate(closes, whole)
    begin = end + len(closes)
    role = role.otherwise(unescaped(F.substring(whole, F.lit(len(opens) + 1), end - 1 - len(opens)), template))
    text = text.otherwise(F.substring(whole, begin, F.length(whole) - begin + 1 - len(template.named_after)))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), "")
    return rows.select(*output.columns, role.alias("role"), unescaped(text, template).alias("text"), unescaped(loss, template).alias("loss_text"), F.length(whole).cast("long").alias("n_chars"))


def validity(output: DataFrame, template: Template = INSTRUCT, key: str = "conv_id") -> DataFrame:
    """key, valid: every turn in order and the last one's state accepted."""
    rows = output.groupBy(F.col(key)).agg(F.bool_and("in_order").alias("right"), F.max_by("state", "place").alias("last"))
    return rows.select(key, (F.col("right") & F.col("last").isin(*template.accepts)).alias("valid"))


def digests(turns: DataFrame, template: Template = INSTRUCT, key: str = "conv_id") -> DataFrame:
    """key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid for what ``read`` gives.

    A digest of joined texts has to be taken in order: the turns of one conversation pass through one task, sorted (which spills) and as a
    stream, of which a digest's state and one batch are held.
    """
    shape = "k long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    names = [f.split()[0] for f in shape.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, key_now, now = [], None, None

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * len(names)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        def close() -> None:
            if now:
                n, turns_hash, loss_n, loss_hash, chars, right, state = now
                done.append((key_now, n, turns_hash.hexdigest(), loss_n, loss_hash.hexdigest(), chars, right and state in template.accepts))

        for batch in batches:
            for k, role, text, loss, chars, right, state in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or k != key_now:
                    close()
                    key_now, now = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True, ""]
                now[0] += 1
                now[1].update(f"{role}\n{text}\n".encode())
                now[2] += len(loss)
                now[3].update(loss.encode())
                now[4] += chars
                now[5], now[6] = now[5] and right, state
            if len(done) > 1000:
                yield out()
        close()
        yield out()

    rows = turns.select(F.col(key).alias("k"), "place", "role", "text", "loss_text", "n_chars", "in_order", "state").repartition(partitions(turns.sparkSession), "k").sortWithinPartitions("k", "place")
    return rows.drop("place").mapInArrow(run, shape).withColumnRenamed("k", key)
