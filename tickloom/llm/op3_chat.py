"""Chat formatting by a finite-state machine and a declarative template.

``formatted`` turns the rows of conversations into segments in order: the
opening of a turn, its text, its close, each with its loss flag.  The machine
walks the roles; a turn that its state does not allow is marked, and formatted
all the same, so nothing is lost.  Control strings inside texts and roles are
escaped: the escape character is doubled up with "0", and an escape and "1"
are put behind the first character of a control string.  No control string
has its first character again inside a control string, which ``Template``
checks, so the escape breaks each of them and is undone exactly.

``read_back`` parses the segments of each conversation as one text and returns
what it says.  Rows come sorted within hash partitions by conversation, and
both steps stream: a worker holds one turn at a time, so a conversation of any
length is formatted in bounded memory.

Defined results: null texts and roles count as empty; a null conv_id is one
conversation; null turns come first, and rows of the same turn follow by role,
then text; repeated rows are turns of their own; an empty table gives the
given extra conversations only; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Template:
    """How turns are written, which roles may follow which, and whose text bears loss."""

    begin: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>"
    after_turn: str = "\n"
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "[INST]", "[/INST]", "<s>", "</s>")
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    accepting: tuple[str, ...] = ("assistant",)
    escape: str = "␛"

    def __post_init__(self) -> None:
        for c in self.controls:
            if any(c[0] in other[1:] for other in self.controls) or self.escape in c:
                raise ValueError(f"control string {c!r} can't be escaped reversibly")
        if not {self.begin, self.end} <= set(self.controls):
            raise ValueError("the marks of a turn must be control strings")

    def escaped(self, text: str) -> str:
        text = text.replace(self.escape, self.escape + "0")
        return re.sub("|".join(map(re.escape, self.controls)), lambda m: m[0][0] + self.escape + "1" + m[0][1:], text)

    def unescaped(self, text: str) -> str:
        return re.sub(self.escape + "([01])", lambda m: self.escape if m[1] == "0" else "", text)

    def role_escaped(self, role: str) -> str:
        return self.escaped(role).replace(self.after_role, self.escape + "2")

    def role_unescaped(self, role: str) -> str:
        return self.unescaped(role.replace(self.escape + "2", self.after_role))

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        return [(self.begin + self.role_escaped(role) + self.after_role, False), (self.escaped(text), role in self.loss_roles), (self.end + self.after_turn, False)]


def formatted(turns: DataFrame, template: Template) -> DataFrame:
    """(conv_id, segment, text, loss, fault) in the order of the conversation, within each partition.

    fault: on the opening of a turn, the move that the machine does not allow; on the
    last segment known of a conversation nothing is said, see ``read_back`` for acceptance.
    """
    spark = turns.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = run
        state, n = template.start, 0
        for batch in batches:
            out: list[tuple] = []
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if conv != now:
                    now, state, n = conv, template.start, 0
                fault = None if role in template.moves.get(state, ()) else f"{role} after {state}"
                state = role
                for k, (piece, loss) in enumerate(template.segments(role, text)):
                    out.append((conv, n, piece, loss, None if k else fault))
                    n += 1
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()), strict=True)], ["conv_id", "segment", "text", "loss", "fault"])

    return rows.mapInArrow(run, "conv_id long, segment long, text string, loss boolean, fault string")


class _Reader:
    """Parses the segments of one conversation as they come."""

    def __init__(self, conv: int | None, template: Template) -> None:
        self.conv, self.t = conv, template
        self.buffer: list[str] = []
        self.turns = self.loss_chars = self.chars = 0
        self.turns_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()
        self.role, self.valid = template.start, True

    def add(self, text: str, loss: bool, fault: str | None) -> None:
        self.chars += len(text)
        self.valid &= fault is None
        if loss:
            plain = self.t.unescaped(text)
            self.loss_chars += len(plain)
            self.loss_hash.update(plain.encode())
        self.buffer.append(text)
        if text.endswith(self.t.end + self.t.after_turn):
            self.take()

    def take(self) -> None:
        whole = "".join(self.buffer)
        self.buffer = []
        while whole:
            if not whole.startswith(self.t.begin):
                raise ValueError(f"conversation {self.conv}: no turn begins at {whole[:40]!r}")
            role, _, rest = whole[len(self.t.begin) :].partition(self.t.after_role)
            text, _, rest = rest.partition(self.t.end)
            whole = rest[len(self.t.after_turn) :]
            self.role = self.t.role_unescaped(role)
            self.turns += 1
            self.turns_hash.update(f"{self.role}\n{self.t.unescaped(text)}\n".encode())

    def row(self) -> tuple:
        if self.buffer:
            raise ValueError(f"conversation {self.conv}: a turn has no end")
        return self.conv, self.turns, self.turns_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.chars, self.valid and self.role in self.t.accepting


def read_back(segments: DataFrame, template: Template) -> DataFrame:
    """One row per conversation, from its segments in order."""
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

        for batch in batches:
            for conv, text, loss, fault in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if reader is None or reader.conv != conv:
                    if reader is not None:
                        done.append(reader.row())
                    reader = _Reader(conv, template)
                reader.add(text, loss, fault)
            if done:
                yield flush()
                done = []
        if reader is not None:
            done.append(reader.row())
            yield flush()

    return segments.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


#: The conversation that every run formats besides the table's.
EXTRA_ID, EXTRA_TEXT = -7, "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(EXTRA_ID, 0, "user", EXTRA_TEXT), (EXTRA_ID, 1, "assistant", EXTRA_TEXT)], "conv_id long, turn long, role string, text string")
    template = Template()
    return read_back(formatted(turns.unionByName(extra), template), template)


SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS prev,
    lead(conv_id) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS NULL AS last,
    length(replace(replace(replace(replace(replace(replace(replace(text, '␛', '␛0'), '<|im_start|>', '<␛1|im_start|>'), '<|im_end|>', '<␛1|im_end|>'), '[INST]', '[␛1INST]'), '[/INST]', '[␛1/INST]'), '<s>', '<␛1s>'), '</s>', '<␛1/s>')) AS text_chars
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(role) + text_chars) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN prev IS NULL THEN role IN ('system', 'user') WHEN prev IN ('system', 'assistant') THEN role = 'user' WHEN prev = 'user' THEN role = 'assistant' ELSE false END)
    AND bool_or(last AND role = 'assistant') AS valid
FROM e GROUP BY conv_id
"""
