"""Chat formatting: conversations as token ids with a loss mask.

Every role name and text is escaped and encoded on its own; reserved ids, which
no text can yield, are spliced between them. The loss mask is the prefix sum of
+1 where a learnt text begins and -1 where it ends.

Control strings inside texts are escaped reversibly: between the first and
the second character of every control string (with any number of backslashes
there) goes one more backslash. Template refuses control strings that could
overlap, so taking one backslash out of each undoes it exactly.

Rows are sorted by (conversation, turn) over range partitions, so a
conversation of any length is split like any other run of rows. A task streams
its rows and emits parts: a whole conversation, or about PART_BYTES of one.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import spread, text_slices

#: text of one part, text that is encoded at once
PART_BYTES, SLICE_BYTES = 1 << 20, 1 << 20


@dataclass(frozen=True)
class Template:
    """Control strings of a turn by role; other roles carry their name (a null role's is empty).

    learn: roles whose texts are under the loss mask."""

    roles: tuple[tuple[str, str, str], ...] = (("system", "<<SYS>>", "<</SYS>>"), ("user", "[INST]", "[/INST]"), ("assistant", "<s>", "</s>"))
    other: tuple[str, str, str] = ("<|role|>", "<|text|>", "<|end|>")
    learn: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        c = self.controls
        if len(set(c)) < len(c) or any(len(x) < 2 or "\\" in x for x in c):
            raise ValueError("control strings: distinct, of two characters or more, without backslashes")
        if any(x in y for x in c for y in c if x != y) or any(y.startswith(x[k:]) for x in c for y in c for k in range(1, len(x))):
            raise ValueError("control strings may not hold or overlap one another")

    @property
    def controls(self) -> list[str]:
        return [x for _, a, b in self.roles for x in (a, b)] + list(self.other)

    @functools.cached_property
    def _places(self) -> tuple[re.Pattern, re.Pattern]:
        rest: dict[str, list[str]] = {}
        for x in self.controls:
            rest.setdefault(x[0], []).append(re.escape(x[1:]))
        place = "|".join(rf"{re.escape(a)}{{}}(?=\\*(?:{'|'.join(b)}))" for a, b in rest.items())
        return re.compile(place.replace("{}", "")), re.compile(place.replace("{}", r"\\"))

    def escape(self, text: str) -> str:
        return self._places[0].sub(lambda m: m.group() + "\\", text)

    def unescape(self, text: str) -> str:
        return self._places[1].sub(lambda m: m.group()[0], text) if "\\" in text else text


class Codec:
    """A byte-level vocabulary and the reserved ids above it."""

    def __init__(self, path: str, pattern: str, first_reserved: int, template: Template):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(ranks.values()) >= first_reserved:
            raise ValueError("reserved ids must lie above the vocabulary")
        self.template, self.first = template, first_reserved
        self.encoding = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.control_id = {x: first_reserved + k for k, x in enumerate(template.controls)}
        pieces = [b""] * (first_reserved + len(self.control_id))
        for b, k in ranks.items():
            pieces[k] = b
        for x, k in self.control_id.items():
            pieces[k] = x.encode()
        self.length = np.array([len(x) for x in pieces], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        #: code points that begin in each id's bytes
        self.chars = np.array([sum(c & 0xC0 != 0x80 for c in x) for x in pieces], np.int64)
        self.marks = {r: (self.control_id[a], self.control_id[b]) for r, a, b in template.roles}
        self.role_of = {self.control_id[a]: r for r, a, _ in template.roles}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int32) for x in self.encoding.encode_ordinary_batch([self.template.escape(x) for x in texts], num_threads=1)]

    def assemble(self, roles: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, mask, first id of each turn and the end) of consecutive turns."""
        named = [k for k, r in enumerate(roles) if r not in self.marks]
        names = dict(zip(named, self.encode([roles[k] for k in named])))
        other, text, end = (np.array([self.control_id[x]], np.int32) for x in self.template.other)
        segments, learnt, turn = [], [], [0]
        for k, content in enumerate(self.encode(texts)):
            if k in names:
                head, tail = [other, names[k], text], end
            else:
                a, b = self.marks[roles[k]]
                head, tail = [np.array([a], np.int32)], np.array([b], np.int32)
            segments += [*head, content, tail]
            learnt += [False] * len(head) + [roles[k] in self.template.learn, False]
            turn.append(len(segments))
        edges = np.concatenate([[0], np.cumsum([len(x) for x in segments])]).astype(np.int64)
        ids = np.concatenate([np.zeros(0, np.int32), *segments])
        learnt = np.flatnonzero(np.array(learnt, bool))
        change = np.zeros(len(ids) + 1, np.int32)
        np.add.at(change, edges[learnt], 1)
        np.add.at(change, edges[learnt + 1], -1)
        return ids, np.cumsum(change[:-1]).astype(np.int8), edges[np.array(turn)]

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The formatted bytes, and where each id's begin (one more entry than ids)."""
        n = self.length[ids]
        return self.blob[spread(self.begin[ids], n)].tobytes(), np.concatenate([[0], np.cumsum(n)])

    def turns(self, ids: np.ndarray) -> Iterator[tuple[str, str]]:
        """(role, text) of every turn that the ids hold."""
        raw, at = self.decode(ids)
        marks = np.flatnonzero(ids >= self.first).tolist()
        piece = lambda a, b: self.template.unescape(raw[at[a + 1] : at[b]].decode())
        k = 0
        while k < len(marks):
            role = self.role_of.get(int(ids[marks[k]]))
            if role is None:
                role, k = piece(marks[k], marks[k + 1]), k + 1
            yield role, piece(marks[k], marks[k + 1])
            k += 2

    def learnt(self, ids: np.ndarray, mask: np.ndarray) -> list[str]:
        """The texts under the mask, in order."""
        raw, at = self.decode(ids)
        step = np.diff(np.concatenate([[0], mask, [0]]))
        return [self.template.unescape(raw[at[a] : at[b]].decode()) for a, b in zip(np.flatnonzero(step > 0), np.flatnonzero(step < 0))]


@functools.cache
def codec(path: str, pattern: str, first_reserved: int, template: Template) -> Codec:
    """One a worker process."""
    return Codec(path, pattern, first_reserved, template)


def format_conversations(df: DataFrame, path: str, pattern: str, first_reserved: int, template: Template = Template(), conv_id: str = "conv_id",
                         turn: str = "turn", role: str = "role", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Parts of conversations: conv_id, turn, tie, seq (the place of the part's
    first row), whole, n_turns, ids, loss_mask (1: learnt).

    A conversation is the concatenation of its parts in order of (turn, tie,
    seq). whole: the part is surely all of its conversation; others are parts
    of long ones, or lie at the border of two tasks. Rows go by turn, null
    first, rows of the same turn by a hash of role and text; repeated rows all
    stay. Null texts and roles count as empty. Rows without a conversation id
    make one conversation. path, pattern: a byte-level vocabulary in
    tiktoken's format and its splitting pattern."""
    rows = df.select(F.col(f"`{conv_id}`").alias("c"), F.col(f"`{turn}`").alias("k"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("r"),
                     F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t")).withColumn("h", F.xxhash64("r", "t"))
    kinds = {f.name: f.dataType for f in rows.schema}
    arrow = pa.schema([("conv_id", _arrow(kinds["c"])), ("turn", _arrow(kinds["k"])), ("tie", pa.int64()), ("seq", pa.int64()), ("whole", pa.bool_()),
                       ("n_turns", pa.int64()), ("ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.int8()))])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern, first_reserved, template)
        conv, place, held, n_turns, n_bytes, seq = None, None, [], 0, 0, 0
        first = cut = True  # cut: the part may have a neighbour of the same conversation

        def part(whole: bool) -> pa.RecordBatch:
            values = [conv, *place, seq, whole, n_turns, np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, arrow)], schema=arrow)

        for batch in batches:
            for piece in text_slices(batch, "t", SLICE_BYTES):
                names, places = piece.column("c").to_pylist(), list(zip(piece.column("k").to_pylist(), piece.column("h").to_pylist()))
                texts = piece.column("t").to_pylist()
                ids, mask, at = c.assemble(piece.column("r").to_pylist(), texts)
                sizes = [len(x.encode()) for x in texts]
                a = 0
                while a < len(names):
                    if held and (names[a] != conv or n_bytes >= part_bytes):
                        same = names[a] == conv
                        yield part(not (cut or same))
                        seq, cut, held, n_turns, n_bytes = seq + 1, same, [], 0, 0
                    if not held:
                        conv, place, cut, first = names[a], places[a], cut or first, False
                    b, n = a, n_bytes
                    while b < len(names) and names[b] == conv and (b == a or n < part_bytes):
                        n += sizes[b]
                        b += 1
                    held.append((ids[at[a] : at[b]], mask[at[a] : at[b]]))
                    n_turns, n_bytes, a = n_turns + b - a, n, b
        if held:
            yield part(False)

    spark_schema = f"conv_id {kinds['c'].simpleString()}, turn {kinds['k'].simpleString()}, tie long, seq long, whole boolean, n_turns long, ids array<int>, loss_mask array<byte>"
    return rows.repartitionByRange("c", "k", "h").sortWithinPartitions("c", "k", "h", "r", "t").mapInArrow(parts, spark_schema)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def digests(parts: DataFrame, path: str, pattern: str, first_reserved: int, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars of every conversation, read back from its ids and mask.

    Of a whole conversation only the digests travel; parts of others meet by
    conversation and are hashed as they stream by."""
    kinds = {f.name: f.dataType for f in parts.schema}
    place = [("conv_id", _arrow(kinds["conv_id"])), ("turn", _arrow(kinds["turn"])), ("tie", pa.int64()), ("seq", pa.int64())]
    told = [("n_turns", pa.int64()), ("loss_chars", pa.int64()), ("formatted_chars", pa.int64()), ("turns_sha256", pa.string()), ("loss_sha256", pa.string())]
    middle = pa.schema([*place, *told, ("turns", pa.binary()), ("loss", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern, first_reserved, template)
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                ids, mask = (batch.column(k)[row].values.to_numpy(zero_copy_only=False) for k in ("ids", "loss_mask"))
                turns = list(c.turns(ids))
                said = "".join(f"{r}\n{t}\n" for r, t in turns).encode()
                loss = "".join(c.learnt(ids, mask))
                numbers = (len(turns), len(loss), int(c.chars[ids].sum()))
                if batch.column("whole")[row].as_py():
                    out.append((*numbers, hashlib.sha256(said).hexdigest(), hashlib.sha256(loss.encode()).hexdigest(), None, None))
                else:
                    out.append((*numbers, None, None, said, loss.encode()))
            columns = [batch.column(k) for k, _ in place] + [pa.array([x[k] for x in out], f.type) for k, f in enumerate(list(middle)[len(place) :])]
            yield pa.RecordBatch.from_arrays(columns, schema=middle)

    final = pa.schema([place[0], *told])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, hashes = None, [0, 0, 0], None

        def row() -> tuple:
            return (now, *sums, *(x.hexdigest() for x in hashes))

        for batch in batches:
            out = []
            names = batch.column("conv_id").to_pylist()
            ended = batch.column("turns_sha256").to_pylist()
            rest = [batch.column(k).to_pylist() for k in ("n_turns", "loss_chars", "formatted_chars", "loss_sha256")]
            for k, name in enumerate(names):
                if hashes and (name != now or ended[k]):
                    out.append(row())
                    hashes = None
                if ended[k]:
                    out.append((name, *(x[k] for x in rest[:3]), ended[k], rest[3][k]))
                    continue
                if not hashes:
                    now, sums, hashes = name, [0, 0, 0], (hashlib.sha256(), hashlib.sha256())
                sums = [a + x[k] for a, x in zip(sums, rest)]
                for x, column in zip(hashes, ("turns", "loss")):
                    x.update(batch.column(column)[k].as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(final)], schema=final)
        if hashes:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row(), final)], schema=final)

    kind, turn = kinds["conv_id"].simpleString(), kinds["turn"].simpleString()
    facts = "n_turns long, loss_chars long, formatted_chars long, turns_sha256 string, loss_sha256 string"
    met = parts.mapInArrow(read, f"conv_id {kind}, turn {turn}, tie long, seq long, {facts}, turns binary, loss binary")
    return met.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "tie", "seq").mapInArrow(finish, f"conv_id {kind}, {facts}")
