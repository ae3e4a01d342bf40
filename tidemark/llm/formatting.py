"""Chat formatting: records of many layouts become turns, and turns become text with a loss mask.

**Layouts by fingerprint.** The fingerprint of a record is a hash of its nested
field paths, without values and without the types of plain values. Layouts are
declared as data (``Layout``: paths, and which turns they make); each declares
the fingerprints it covers. A record column is either a struct, whose schema has
one fingerprint for the whole table, or JSON text, where every record has its
own. The mapping is a native expression chosen by the fingerprint.

**Template.** A turn is written as ``<|im_start|>role<|im_sep|>text<|im_end|>``.
Inside roles and texts a backslash is doubled, and the first character of every
control string becomes an escape, so no control string is left and the escapes
can be undone. The text of assistant turns is under the loss mask, given as a
stretch of code points.

**Reading back.** ``read_back`` parses the written pieces and digests each
conversation. Rows are dealt by ranges of (conversation, turn), so a long
conversation is spread over tasks like any others. A conversation that lies
within one task and measures at most ``BLOCK`` is done there; of the others, the
tasks send blocks of at most ``BLOCK``, which are digested in order as they
arrive: SHA-256 needs one pass over a conversation, but never its whole in memory.

Defined results: a null text or role is empty; texts are never cut. Rows of one
turn stand in the order of role and text (their first 64 characters, then their
hashes), null turns last; repeated rows are turns of their own; rows with a null
``conv_id`` are one conversation. Records whose JSON cannot be read, or whose
layout nobody declared, have a null ``layout`` in ``canonical_turns`` and one row
without role and text; ``format_turns`` refuses them unless told to leave them
out. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 1 << 20
HEAD = 64


# --- layouts ------------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """One record layout.

    Either ``each`` names a list of messages and ``role`` and ``text`` are paths in
    a message; or, without ``each``, they are paths in the record, which is one
    turn; or ``turns`` lists (role, paths, needed): the texts at the paths, joined
    by a blank line, are one turn, left out if it is not needed and all are null.
    ``optional`` paths may or may not be there. ``roles`` renames roles.
    """

    name: str
    turns: tuple[tuple[str, tuple[str, ...], bool], ...] = ()
    each: str | None = None
    role: str = ""
    text: str = ""
    optional: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[str]:
        """The field paths of a full record."""
        if self.turns:
            return list(dict.fromkeys(p for _, paths, _ in self.turns for p in paths))
        inner = [self.role, self.text]
        return [f"{self.each}[].{p}" for p in inner] if self.each else inner

    def fingerprints(self) -> list[str]:
        """Those of all records this layout covers: with any of the optional paths, and with an empty list of messages."""
        must = [p for p in self.paths() if p not in self.optional]
        forms = []
        for n in range(len(self.optional) + 1):
            for extra in itertools.combinations(self.optional, n):
                forms.append([*must, *extra])
                if self.each:
                    forms.append([f"{self.each}[]", *(p for p in extra if not p.startswith(f"{self.each}[]"))])
        return sorted({fingerprint(paths) for paths in forms})


LAYOUTS = (
    Layout("turn", role="role", text="text"),
    Layout("messages", each="messages", role="role", text="content", optional=("id", "source", "messages[].name")),
    Layout(
        "conversations", each="conversations", role="from", text="value", optional=("id", "source"),
        roles=(("human", "user"), ("gpt", "assistant")),
    ),
    Layout("dialog", each="dialog.turns", role="speaker.role", text="utterance", optional=("id",)),
    Layout(
        "instruction", turns=(("system", ("system",), False), ("user", ("instruction", "input"), True), ("assistant", ("output",), True)),
        optional=("system", "input", "id"),
    ),
    Layout("prompt", turns=(("system", ("system",), False), ("user", ("prompt",), True), ("assistant", ("response",), True)), optional=("system", "id")),
    Layout("completion", turns=(("user", ("prompt",), True), ("assistant", ("completion",), True)), optional=("id",)),
    Layout("question", turns=(("user", ("context", "question"), True), ("assistant", ("answer",), True)), optional=("context", "id")),
)


def _name(name: str) -> str:
    return name if re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", name) else "`" + name.replace("`", "``") + "`"


def _tree(paths: list[str]) -> dict:
    """Nested names; a list is a step of its own, called "[]"."""
    root: dict = {}
    for path in paths:
        node = root
        for step in path.replace("[]", ".[]").split("."):
            node = node.setdefault(step, {})
    return root


def _form(node: dict) -> str:
    if not node:
        return ""
    if "[]" in node:
        return f"ARRAY<{_form(node['[]'])}>"
    return "OBJECT<" + ", ".join(_name(k) + (f": {_form(node[k])}" if node[k] else "") for k in sorted(node)) + ">"


def _hash(form: str) -> str:
    return hashlib.sha256(form.encode()).hexdigest()[:32]


def fingerprint(paths: list[str]) -> str:
    """The fingerprint of records that have just these paths (``a.b``, ``list[].c``)."""
    return _hash(_form(_tree(paths)))


def fingerprint_of_schema(kind: T.DataType) -> str:
    def walk(kind: T.DataType) -> dict:
        if isinstance(kind, T.StructType):
            return {f.name: walk(f.dataType) for f in kind.fields}
        return {"[]": walk(kind.elementType)} if isinstance(kind, T.ArrayType) else {}

    return _hash(_form(walk(kind)))


_SCALAR = r"(?:VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|STRING|BINARY|DATE|TIMESTAMP|TIMESTAMP_NTZ|UUID|VARIANT|DECIMAL\(\d+,\d+\))(?=[,>]|$)"


def fingerprint_of_variant(value: Column) -> Column:
    """The schema of a value without its plain types, hashed. Quoted names stand as they are."""
    form = F.regexp_replace(F.schema_of_variant(value), rf"(`(?:[^`]|``)*`)|: {_SCALAR}|(?<=<){_SCALAR}|^{_SCALAR}", "$1")
    return F.substring(F.sha2(form, 256), 1, 32)


def _json_path(path: str) -> str:
    return "$" + "".join(f"[{json.dumps(step, ensure_ascii=False)}]" for step in path.split("."))


class _Struct:
    """Access to a struct column."""

    @staticmethod
    def text(value: Column, path: str, kind: T.DataType) -> Column:
        for step in path.split("."):
            if not isinstance(kind, T.StructType) or step not in kind.names:
                return F.lit(None).cast("string")
            value, kind = value.getField(step), kind[step].dataType
        return value.cast("string")

    @staticmethod
    def each(value: Column, path: str, kind: T.DataType) -> tuple[Column, T.DataType]:
        for step in path.split("."):
            value, kind = value.getField(step), kind[step].dataType
        return value, kind.elementType


class _Variant:
    """Access to a variant column."""

    @staticmethod
    def text(value: Column, path: str, kind: T.DataType) -> Column:
        return F.try_variant_get(value, _json_path(path), "string")

    @staticmethod
    def each(value: Column, path: str, kind: T.DataType) -> tuple[Column, T.DataType]:
        return F.try_variant_get(value, _json_path(path), "array<variant>"), kind


def _turns(layout: Layout, record: Column, kind: T.DataType, access) -> Column:
    """Array of (role, text) of a record in this layout."""

    def turn(value: Column, kind: T.DataType) -> Column:
        role = F.coalesce(access.text(value, layout.role, kind), F.lit(""))
        for old, new in layout.roles:
            role = F.when(role == old, F.lit(new)).otherwise(role)
        return F.struct(role.alias("role"), F.coalesce(access.text(value, layout.text, kind), F.lit("")).alias("text"))

    if layout.each:
        items, inner = access.each(record, layout.each, kind)
        return F.coalesce(F.transform(items, lambda item: turn(item, inner)), F.array().cast("array<struct<role:string,text:string>>"))
    if not layout.turns:
        return F.array(turn(record, kind))
    made = []
    for role, paths, needed in layout.turns:
        texts = [access.text(record, p, kind) for p in paths]
        there = F.lit(needed)
        for t in texts:
            there = there | t.isNotNull()
        joined = F.concat_ws("\n\n", *texts)
        made.append(F.when(there, F.struct(F.lit(role).alias("role"), joined.alias("text"))))
    return F.array_compact(F.array(*made))


def canonical_turns(records: DataFrame, conv_id: str, seq: str, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, seq, item, role, text, layout, fingerprint): one row per turn, or per record nobody declared.

    ``record`` is a struct column or JSON text. ``item`` counts the turns of a record from 0.
    """
    kind = records.schema[record].dataType
    rows = records.select(F.col(conv_id).cast("bigint").alias("conv_id"), F.col(seq).cast("bigint").alias("seq"), F.col(record).alias("_record"))
    value = F.col("_record")
    if isinstance(kind, T.StructType):
        own = fingerprint_of_schema(kind)
        layouts = tuple(x for x in layouts if own in x.fingerprints())
        rows, access = rows.withColumn("fingerprint", F.lit(own)), _Struct
    else:
        rows = rows.withColumn("_record", F.try_parse_json(value))
        rows, access = rows.withColumn("fingerprint", fingerprint_of_variant(value)), _Variant
    name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for layout in layouts:
        fits = F.col("fingerprint").isin(layout.fingerprints())
        name = F.when(fits, F.lit(layout.name)).otherwise(name)
        turns = F.when(fits, _turns(layout, value, kind, access)).otherwise(turns)
    keep = ["conv_id", "seq", "fingerprint"]
    made = rows.select(*keep, name.alias("layout"), turns.alias("_turns"))
    # A record without messages is known and has no turn; one of unknown layout stays as a row.
    made = made.where(F.col("layout").isNull() | (F.size("_turns") > 0))
    made = made.select(*keep, "layout", F.posexplode_outer("_turns").alias("item", "_turn"))
    return made.select("conv_id", "seq", "item", F.col("_turn.role").alias("role"), F.col("_turn.text").alias("text"), "layout", "fingerprint")


# --- template -------------------------------------------------------------------


@dataclass(frozen=True)
class Template:
    opening: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    closing: str = "<|im_end|>"
    #: Also escaped inside texts, as models of other templates know them.
    others: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    learned: tuple[str, ...] = ("assistant",)

    def controls(self) -> tuple[str, ...]:
        return (self.opening, self.middle, self.closing, *self.others)

    def escapes(self) -> dict[str, str]:
        """Escape of each first character of a control string."""
        firsts = sorted({c[0] for c in self.controls()})
        return {first: "\\" + "lbcdefgh"[i] for i, first in enumerate(firsts)}

    def escaped(self, text: Column) -> Column:
        """No backslash follows from a control string, so one replacement cannot make or hide another."""
        out, escape = F.replace(text, F.lit("\\"), F.lit("\\\\")), self.escapes()
        for control in self.controls():
            out = F.replace(out, F.lit(control), F.lit(escape[control[0]] + control[1:]))
        return out

    def unescaped(self, text: str) -> str:
        back = {code[1]: first for first, code in self.escapes().items()} | {"\\": "\\"}
        return re.sub(r"\\(.)", lambda m: back[m[1]], text) if "\\" in text else text


def format_turns(turns: DataFrame, template: Template | None = None, leave_unknown: bool = False) -> DataFrame:
    """(conv_id, seq, item, role, head, tie, piece, loss_start, loss_length): one piece of formatted text per turn.

    The pieces of a conversation in the order of seq, item, role, head and tie are
    its formatted text. ``loss_start`` and ``loss_length`` are code points in the piece.
    """
    template = template or Template()
    known = turns.where(F.col("layout").isNotNull()) if leave_unknown else turns.withColumn(
        "role", F.when(F.col("layout").isNull(), F.raise_error(F.concat(F.lit("no layout for the record of conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))).otherwise(F.col("role"))
    )
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = ["conv_id", "seq", "item"]
    rows = known.select(*order, F.substring(role, 1, HEAD).alias("role"), F.substring(text, 1, HEAD).alias("head"), F.xxhash64(role, text).alias("tie"),
                        role.isin(*template.learned).alias("_learned"), template.escaped(role).alias("_role"), template.escaped(text).alias("_text"))
    before = len(template.opening) + len(template.middle)
    length = F.when(F.col("_learned"), F.char_length("_text")).otherwise(0)
    return rows.select(
        *order, "role", "head", "tie",
        F.concat(F.lit(template.opening), "_role", F.lit(template.middle), "_text", F.lit(template.closing)).alias("piece"),
        F.when(F.col("_learned"), F.char_length("_role") + before).otherwise(0).alias("loss_start"), length.alias("loss_length"),
    )


# --- reading back ------------------------------------------------------------------


def parse(piece: str, template: Template) -> list[tuple[str, str]]:
    """The (role, text) of every turn in formatted text."""
    turns = []
    while piece:
        head, _, piece = piece.partition(template.closing)
        role, middle, text = head.removeprefix(template.opening).partition(template.middle)
        if not head.startswith(template.opening) or not middle:
            raise ValueError(f"not a turn: {head[:80]!r}")
        turns.append((template.unescaped(role), template.unescaped(text)))
    return turns


_SLICES = "conv_id bigint, part int, block int, done boolean, n_turns bigint, loss_chars bigint, formatted_chars bigint, turns binary, loss binary"
_NAMES = [x.split()[0] for x in _SLICES.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]


class _Rows:
    """Output rows, given on whenever they hold a block's worth of bytes."""

    def __init__(self):
        self.rows, self.size = [], 0

    def add(self, *row) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += 200 + len(row[-1]) + len(row[-2])
        if self.size > 4 * BLOCK:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), _TYPES, strict=True)]
            self.rows, self.size = [], 0
            yield pa.RecordBatch.from_arrays(columns, _NAMES)


def _digest(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def read_back(pieces: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) per conversation, parsed from its pieces."""
    template = template or Template()

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out = TaskContext.get().partitionId(), _Rows()
        current, started, inside, block = None, False, False, 0
        counts, turns, loss = [0, 0, 0], bytearray(), bytearray()

        def close(whole: bool) -> Iterator[pa.RecordBatch]:
            if whole:
                yield from out.add(current, part, block, True, *counts, _digest(turns), _digest(loss))
            elif counts[0]:
                yield from out.add(current, part, block, False, *counts, bytes(turns), bytes(loss))

        for rows in batches:
            columns = (rows.column(c).to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_length"))
            for conv, piece, start, length in zip(*columns, strict=True):
                if not started or conv != current:
                    if started:
                        yield from close(inside)
                    # The first conversation of a task may have begun in the one before.
                    current, inside, started, block = conv, started, True, 0
                    counts, turns, loss = [0, 0, 0], bytearray(), bytearray()
                for role, text in parse(piece, template):
                    turns += f"{role}\n{text}\n".encode()
                    counts[0] += 1
                if length:
                    learned = template.unescaped(piece[start : start + length])
                    loss += learned.encode()
                    counts[1] += len(learned)
                counts[2] += len(piece)
                if len(turns) + len(loss) > BLOCK:
                    yield from out.add(current, part, block, False, *counts, bytes(turns), bytes(loss))
                    inside, block = False, block + 1
                    counts, turns, loss = [0, 0, 0], bytearray(), bytearray()
        if started:
            yield from close(False)
        yield from out.flush()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows()
        current, started = None, False
        counts, turns, loss = [0, 0, 0], hashlib.sha256(), hashlib.sha256()
        for rows in batches:
            columns = (rows.column(c) for c in ("conv_id", "done", "n_turns", "loss_chars", "formatted_chars", "turns", "loss"))
            for conv, done, *more, some_turns, some_loss in zip(*columns, strict=True):
                conv, more = conv.as_py(), [x.as_py() for x in more]
                if started and (done.as_py() or conv != current):
                    yield from out.add(current, 0, 0, True, *counts, turns.hexdigest().encode(), loss.hexdigest().encode())
                    started = False
                if done.as_py():
                    yield from out.add(conv, 0, 0, True, *more, some_turns.as_py(), some_loss.as_py())
                    continue
                if not started:
                    current, started = conv, True
                    counts, turns, loss = [0, 0, 0], hashlib.sha256(), hashlib.sha256()
                counts = [a + b for a, b in zip(counts, more, strict=True)]
                turns.update(some_turns.as_buffer())
                loss.update(some_loss.as_buffer())
        if started:
            yield from out.add(current, 0, 0, True, *counts, turns.hexdigest().encode(), loss.hexdigest().encode())
        yield from out.flush()

    last = F.asc_nulls_last
    order = [last("conv_id"), last("seq"), last("item"), F.asc("role"), F.asc("head"), F.asc("tie")]
    # Equal rows may stand in any order, so a number of their own can part them.
    numbered = pieces.withColumn("_number", F.monotonically_increasing_id())
    dealt = numbered.repartitionByRange(*order, F.asc("_number")).sortWithinPartitions(*order)
    parts = dealt.select("conv_id", "piece", "loss_start", "loss_length").mapInArrow(slices, _SLICES)
    placed = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    text = lambda c: F.col(c).cast("string").alias(f"{c}_sha256")
    return placed.mapInArrow(joined, _SLICES).select("conv_id", "n_turns", text("turns"), "loss_chars", text("loss"), "formatted_chars")
