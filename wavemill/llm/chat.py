"""Chat formatting by incremental rendering of a template that is a black box.

A template only renders a list of turns to text.  Successive prefixes of a
conversation are rendered whole and consecutive outputs compared: what the
longer one adds is the span of the new turn, and a longer output that does not
begin with the shorter one shows a template that rewrites history
(``rewrites``; the span then begins at the first difference).

No declaration of the template is believed, so every rewrite is found, at the
turn that makes it.  That takes time in proportion to the square of a
conversation's turns: 3000 turns of 200 characters render 0.9 GB of text, in
seconds; memory is that of the turns and of two outputs.  One conversation is
read in order by one task, as a prefix needs all that is before it.

The built-in template escapes control strings, so its output reads back to the
same turns.  Null text or role counts as empty; turns are ordered by number
(null first), role and text; repeated rows are turns of their own; rows with a
null conversation id form one conversation.  Conversations stream through
sorted partitions one turn at a time: a task holds the turns and the output of
one conversation.  Very long texts are whole; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, trimmed

Turn = tuple[str, str]


class BlockTemplate:
    """``### role: text</turn>`` and a newline for each turn; control strings inside are escaped by a backslash.

    Turns that were shown before are kept, up to ``KEPT`` characters, as prefixes show them again and again.
    """

    KEPT = 1 << 24

    _ESCAPE = re.compile(r"\\|</turn>|###|:")
    _TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)

    def escape(self, text: str) -> str:
        return self._ESCAPE.sub(lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def __init__(self):
        self._shown: dict[Turn, str] = {}
        self._size = 0

    def _turn(self, turn: Turn) -> str:
        shown = self._shown.get(turn)
        if shown is None:
            shown = f"### {self.escape(turn[0])}: {self.escape(turn[1])}</turn>\n"
            if self._size + len(shown) > self.KEPT:
                self._shown.clear()
                self._size = 0
            self._shown[turn] = shown
            self._size += len(shown)
        return shown

    def render(self, turns: list[Turn]) -> str:
        return "".join(map(self._turn, turns))

    def read(self, formatted: str) -> list[tuple[str, str, int, int]]:
        """Turns read back: role, text, and the place of the escaped text."""
        out, at = [], 0
        while at < len(formatted):
            m = self._TURN.match(formatted, at)
            if not m:
                raise ValueError(f"no turn at {at}")
            out.append((self.unescape(m[1]), self.unescape(m[2]), *m.span(2)))
            at = m.end()
        return out


def trace(template, turns: list[Turn]) -> tuple[str, list[tuple[int, int, bool]]]:
    """Whole prefixes, for any template: the output, and each turn's span in its own prefix's output and whether it rewrote history."""
    spans, before = [], template.render([])
    for i in range(len(turns)):
        now = template.render(turns[: i + 1])
        grown = now.startswith(before)
        start = len(before) if grown else _first_difference(before, now)
        spans.append((start, len(now), not grown))
        before = now
    return before, spans


class Tracer:
    """Turn by turn: the text that each turn adds."""

    def __init__(self, template):
        self.template, self.turns, self.before = template, [], template.render([])

    def add(self, turn: Turn) -> tuple[str, int, int, bool]:
        """The added text, its start and end in the whole output, and whether history was rewritten."""
        self.turns.append(turn)
        before, now = self.before, self.template.render(self.turns)
        grown = now.startswith(before)
        start = len(before) if grown else _first_difference(before, now)
        self.before = now
        return now[start:], start, len(now), not grown


def _first_difference(a: str, b: str) -> int:
    """How far two texts agree, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


_SPANS = "conv_id long, turn long, role string, formatted string, start long, stop long, rewrites boolean, loss_start long, loss_stop long"


def format_turns(rows: DataFrame, template=None, loss_role: str = "assistant") -> DataFrame:
    """One row per turn: its formatted text, span, and the span under the loss mask (null for other roles)."""
    template = template or BlockTemplate()
    tidy = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    ordered = tidy.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tracer, conv = None, None
        for b in batches:
            out: list[tuple] = []
            for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text"))):
                if tracer is None or r[0] != conv:
                    tracer, conv = Tracer(template), r[0]
                piece, start, stop, rewrites = tracer.add((r[2], r[3]))
                loss = (None, None)
                if r[2] == loss_role:
                    _, _, a, z = template.read(piece)[-1]
                    loss = (start + a, start + z)
                out.append((r[0], r[1], r[2], piece, start, stop, rewrites, *loss))
            columns = list(zip(*out)) if out else [()] * 9
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in _SPANS.split(", ")])

    return ordered.mapInArrow(trimmed(run), _SPANS)


def read_back(spans: DataFrame, template=None) -> DataFrame:
    """Digests of each conversation, read from ``format_turns`` output in its order."""
    template = template or BlockTemplate()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_rewrites"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> tuple:
            return conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, rewritten

        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        n, conv = -1, None
        for b in batches:
            out = []
            for c, piece, start, a, z, again in zip(*(b.column(x).to_pylist() for x in ("conv_id", "formatted", "start", "loss_start", "loss_stop", "rewrites"))):
                if n < 0 or c != conv:
                    if n >= 0:
                        out.append(done())
                    conv, n, loss_chars, chars, rewritten = c, 0, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                for role, text, _, _ in template.read(piece):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
                if a is not None:
                    said = template.unescape(piece[a - start : z - start])
                    loss_chars += len(said)
                    loss.update(said.encode())
                chars = start + len(piece)
                rewritten += again
            if out:
                yield rows(out)
        if n >= 0:
            yield rows([done()])

    return spans.mapInArrow(trimmed(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_rewrites long")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return read_back(format_turns(rows))
