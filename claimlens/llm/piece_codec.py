"""SentencePiece encoding with byte offsets, and decoding.

The text is normalised here, by longest prefix through the model's compiled
character map, and every normalised byte keeps the source offset it came
from. The normalised text falls into chunks, each a run of word marks and
what follows; no piece of the model reaches over a chunk's end, so chunks
are encoded on their own, each distinct chunk once per task, by the
sentencepiece library. The pieces tile the normalised bytes and are
projected back to byte spans of the source.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import spread, text_slices

MARK = "▁"  # stands for a space
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
SLICE_BYTES = 2 << 20


class CharMap:
    """A compiled character map: a double-array trie of source byte strings and their replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :]
        #: bytes with which an entry may begin
        self.begins = np.zeros(256, bool)
        if self.units:
            root = self._offset(self.units[0])
            self.begins[[b for b in range(256) if root ^ b < len(self.units) and self.units[root ^ b] & 0x800000FF == b]] = True

    def replaced(self, data: bytes, arr: np.ndarray) -> list[tuple[int, int, bytes]]:
        """(place, source bytes, replacement) of the entries found from left to right, the longest at each place."""
        out, end = [], 0
        for p in np.flatnonzero(self.begins[arr] & (arr & 0xC0 != 0x80)).tolist():
            if p >= end and (hit := self.longest(data, p)):
                out.append((p, *hit))
                end = p + hit[0]
        return out

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(source bytes, replacement) of the longest entry that begins at ``at``."""
        units, found = self.units, None
        if not units:
            return None
        node = 0
        node ^= self._offset(units[0])
        for p in range(at, len(data)):
            node ^= data[p]
            if node >= len(units) or units[node] & 0x800000FF != data[p]:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = p + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)


class Normaliser:
    """The model's normalisation, with the source offset of every byte."""

    def __init__(self, spec):
        self.map = CharMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    def _prefix(self, data: bytes, at: int) -> tuple[int, bytes]:
        hit = self.map.longest(data, at)
        if hit:
            return hit
        lead = data[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return n, data[at : at + n]

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """(normalised text, source byte offset of each of its bytes and of its end).

        A character's bytes all have the offset of its first one."""
        if not self.squeeze:
            return self._aligned(text)
        data, at = text.encode(), 0
        mark = MARK.encode() if self.escape else b" "
        out, align = bytearray(), []
        if self.squeeze:  # leading spaces go
            while at < len(data):
                n, rep = self._prefix(data, at)
                if rep != b" ":
                    break
                at += n
        if at < len(data) and self.dummy:
            out += mark
            align += [at] * len(mark)
        spaced = self.squeeze
        while at < len(data):
            n, rep = self._prefix(data, at)
            while spaced and rep.startswith(b" "):
                rep = rep[1:]
            if rep:
                new = rep.replace(b" ", mark)
                out += new
                align += [at] * len(new)
                spaced = self.squeeze and rep.endswith(b" ")
            at += n
        if self.squeeze:
            while out.endswith(mark):
                del out[-len(mark) :]
                at = align[len(out)]
                del align[len(out) :]
        return out.decode(), np.array([*align, at], np.int64)


    def _aligned(self, text: str) -> tuple[str, np.ndarray]:
        """The same where spaces are kept, as arrays: only where an entry of the map may begin is it walked."""
        data = text.encode()
        arr = np.frombuffer(data, np.uint8)
        source = np.arange(len(arr), dtype=np.int32)
        hits = self.map.replaced(data, arr) if self.map.units else []
        inside = arr & 0xC0 == 0x80
        if inside.any():
            source = np.maximum.accumulate(np.where(inside, 0, source))
        if hits:
            parts, where, at = [], [], 0
            for p, n, rep in hits:
                parts += [data[at:p], rep]
                where += [source[at:p], np.full(len(rep), p, np.int32)]
                at = p + n
            data, source = b"".join([*parts, data[at:]]), np.concatenate([*where, source[at:]])
        mark = MARK.encode() if self.escape else b" "
        new = np.frombuffer(data, np.uint8)
        if self.escape:
            source = np.repeat(source, np.where(new == 0x20, len(mark), 1))
            data = data.replace(b" ", mark)
        if self.dummy and len(text):
            data, source = mark + data, np.concatenate([np.zeros(len(mark), np.int32), source])
        return data.decode(), np.append(source, np.int32(len(arr)))


class Chunks(dict):
    """Slot of each chunk (without its first mark); new ones are encoded by ``settle``."""

    LIMIT = 150_000  # chunks, then it starts anew: memory (about 60 MB), not results, depends on it

    def __init__(self, model_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        super().__init__()
        self.lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as f:
            proto.ParseFromString(f.read())
        self.normaliser = Normaliser(proto.normalizer_spec)
        kinds = proto.SentencePiece
        if any(p.type == kinds.USER_DEFINED for p in proto.pieces) or any(MARK in p.piece.lstrip(MARK) for p in proto.pieces) or not self.normaliser.dummy or not self.normaliser.escape or not proto.trainer_spec.byte_fallback:
            raise ValueError("a model whose pieces may reach over words, or without byte fallback, is not supported")
        self.alone = self.lib.piece_to_id(MARK)
        #: normalised bytes of each piece
        self.bytes_of = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.start_anew()

    def start_anew(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.digits: list[str] = []  # ids in decimal, joined by commas
        self.decoded: list[str] = []
        self.ids, self.first = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64)

    def __missing__(self, chunk: str) -> int:
        self[chunk] = slot = len(self)
        self.new.append(chunk)
        return slot

    def settle(self) -> None:
        """Encode and decode the chunks that came since the last call."""
        if not self.new:
            return
        # the library's dummy prefix gives each chunk its first mark; input marks count as spaces. A lone mark has no text.
        ids = [x or [self.alone] for x in self._encode(self.new)]
        self.digits += [",".join(map(str, x)) for x in ids]
        self.decoded += self.lib.decode(ids)
        have, lens = len(self.digits) - len(ids), np.array([len(x) for x in ids], np.int64)
        while len(self.first) < have + len(ids) + 1:
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        self.first[have + 1 : have + len(ids) + 1] = self.first[have] + np.cumsum(lens)
        while len(self.ids) < self.first[have + len(ids)]:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.first[have] : self.first[have + len(ids)]] = np.fromiter((i for x in ids for i in x), np.int32, int(lens.sum()))
        self.new = []

    def _encode(self, chunks: list[str]) -> list[list[int]]:
        """Ids of normalised chunks. A map that would change normalised text is undone by encoding pieces by text."""
        if not self.normaliser.map.units and not self.normaliser.squeeze:
            return self.lib.encode(chunks, num_threads=1)
        plain = getattr(self, "plain_lib", None)
        if plain is None:
            import sentencepiece
            from sentencepiece import sentencepiece_model_pb2

            proto = sentencepiece_model_pb2.ModelProto()
            proto.ParseFromString(self.lib.serialized_model_proto())
            proto.normalizer_spec.precompiled_charsmap, proto.normalizer_spec.remove_extra_whitespaces = b"", False
            self.plain_lib = plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        return plain.encode(chunks, num_threads=1)

    def slots(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(slots of the text's chunks, source offset of each normalised byte and of the end) of each text."""
        if len(self) > self.LIMIT:
            self.start_anew()
        out = []
        for t in texts:
            if not t:
                out.append((np.zeros(0, np.int64), np.zeros(1, np.int32)))
                continue
            norm, align = self.normaliser(t)
            keys = norm.split(MARK)
            if keys[0] or "" in keys[1:]:  # several marks in a row, or none in front
                keys = [c[1:] for c in _CHUNK.findall(norm)]
            else:
                del keys[0]
            out.append((np.fromiter(map(self.__getitem__, keys), np.int64, len(keys)), align))
        self.settle()
        return out

    def tokens(self, slots: np.ndarray) -> np.ndarray:
        return self.ids[spread(self.first[slots], self.first[slots + 1] - self.first[slots])]

    def spans(self, ids: np.ndarray, align: np.ndarray) -> np.ndarray:
        """len(ids) + 1 source offsets: piece i covers source bytes [i], [i + 1]."""
        edge = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.bytes_of[ids], out=edge[1:])
        return align[edge]


def _texts(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    return df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("t"))


def encode(df: DataFrame, model_path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids array<int>, offsets array<int>, decoded: piece i of a row
    covers the source bytes from offsets[i] to offsets[i + 1].

    Null and empty texts have no pieces and decode to an empty text. Rows
    keep their order and number, repeated or null ids included."""
    docs = _texts(df, text, doc_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(model_path)
        for batch in batches:
            for part in text_slices(batch, "t", SLICE_BYTES):
                ids, offsets, decoded = [], [], []
                for slots, align in chunks.slots(part.column("t").to_pylist()):
                    ids.append(chunks.tokens(slots))
                    offsets.append(chunks.spans(ids[-1], align) if len(slots) else np.zeros(1, np.int64))
                    decoded.append(" ".join([chunks.decoded[s] for s in slots.tolist()]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([o.astype(np.int32) for o in offsets], pa.list_(pa.int32())), pa.array(decoded, pa.string())],
                                                 ["doc_id", "ids", "offsets", "decoded"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, offsets array<int>, decoded string")


def digests(df: DataFrame, model_path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """What ``encode`` gives, as digests made in the same tasks: doc_id,
    n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256,
    spans_sha256 (the offsets of all pieces as little-endian 32-bit numbers),
    covered_bytes (where the last piece's span ends: the text's length)."""
    docs = _texts(df, text, doc_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(model_path)
        for batch in batches:
            for part in text_slices(batch, "t", SLICE_BYTES):
                rows = []
                for slots, align in chunks.slots(part.column("t").to_pylist()):
                    at = slots.tolist()
                    ids = chunks.tokens(slots)
                    spans = chunks.spans(ids, align)
                    rows.append((len(ids), hashlib.sha256(",".join([chunks.digits[s] for s in at]).encode()).hexdigest(),
                                 hashlib.sha256(" ".join([chunks.decoded[s] for s in at]).encode()).hexdigest(),
                                 hashlib.sha256(spans.astype("<i4").tobytes()).hexdigest(), int(spans[-1])))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.int64())],
                                                 ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256", "covered_bytes"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string, covered_bytes long")
