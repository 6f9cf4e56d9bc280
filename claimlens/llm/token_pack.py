"""Token ids in binary files: fixed width, the fewest bits the vocabulary needs.

File layout (little-endian):
  magic "TOKPACK1", then uint64: bits, tokens per block, documents, tokens, blocks;
  the blocks, each of 64-token lanes of ``bits`` 8-byte words;
  int64 doc ids, uint64 document starts (tokens of the file before each, and their total);
  uint64 block offsets (and the end of the last); uint64 position of the doc ids.
A token's block and place follow from its number, so any range is read by
seeking to its blocks; a block unpacks with one numpy step per lane.

Documents are dealt to files by ranges of their id and written in ascending
order. A task names its file anew on each attempt; only files that the
written manifest lists count, so a lost attempt leaves no trace in results.
"""

from __future__ import annotations

import functools
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens.session import scratch_path

from .tables import id_and_text, parts, total_bytes, written
from .text import U64, spread, text_slices

MAGIC = b"TOKPACK1"
NO_ID = -(2**63)
BLOCK, FILE_BYTES, SLICE_BYTES = 1 << 16, 32 << 20, 4 << 20
#: beyond so many files they grow with the corpus
MOST_FILES = 100_000


def bits_for(vocabulary: int) -> int:
    """Bits that tell so many ids apart."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids in lanes of 64: lane row r holds ids 64 r to 64 r + 63 in ``bits`` words."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs over {bits} bits")
    rows = -(-len(ids) // 64)
    lanes = np.zeros(rows * 64, U64)
    lanes[: len(ids)] = ids
    lanes = lanes.reshape(rows, 64)
    out = np.zeros((rows, bits), U64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= lanes[:, j] << U64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= lanes[:, j] >> U64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack_bits(blob: bytes, n: int, bits: int) -> np.ndarray:
    words = np.frombuffer(blob, "<u8").reshape(-1, bits)
    out = np.empty((len(words), 64), np.uint32)
    mask = U64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        v = words[:, word] >> U64(shift)
        if shift + bits > 64:
            v = v | words[:, word + 1] << U64(64 - shift)
        out[:, j] = v & mask
    return out.reshape(-1)[:n]


class Writer:
    """Writes one file; ``add`` takes documents in ascending order of id."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.held: list[np.ndarray] = []
        self.n_held = self.n = self.at = 0
        self.ids: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.offsets: list[int] = []

    def add(self, doc_ids: np.ndarray, lengths: np.ndarray, tokens: np.ndarray) -> None:
        self.ids.append(doc_ids)
        self.lengths.append(lengths)
        self.held.append(tokens)
        self.n_held += len(tokens)
        while self.n_held >= self.block:
            every = np.concatenate(self.held)
            whole = len(every) // self.block * self.block
            for a in range(0, whole, self.block):
                self._put(every[a : a + self.block])
            self.held, self.n_held = [every[whole:]], len(every) - whole

    def _put(self, tokens: np.ndarray) -> None:
        blob = pack_bits(tokens, self.bits)
        self.offsets.append(self.at)
        self.out.write(blob)
        self.at += len(blob)
        self.n += len(tokens)

    def close(self) -> tuple[int, int]:
        """(documents, tokens)"""
        rest = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        if len(rest):
            self._put(rest)
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int64)
        lengths = np.concatenate(self.lengths) if self.lengths else np.zeros(0, np.int64)
        self.out.write(ids.astype("<i8").tobytes())
        self.out.write(np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes())
        self.out.write(np.array([*self.offsets, self.at], "<u8").tobytes())
        self.out.write(np.array([self.bits, self.block, len(ids), self.n, len(self.offsets), self.at], "<u8").tobytes() + MAGIC)
        return len(ids), self.n


class Reader:
    """Random access to one file by token number."""

    TAIL = 6 * 8 + len(MAGIC)

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - self.TAIL)
        tail = source.read(self.TAIL)
        if tail[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.block, docs, self.n, blocks, end = np.frombuffer(tail, "<u8", 6).astype(np.int64).tolist()
        source.seek(end)
        table = source.read(8 * (2 * docs + 1 + blocks + 1))
        self.ids = np.frombuffer(table, "<i8", docs)
        self.starts = np.frombuffer(table, "<u8", docs + 1, 8 * docs).astype(np.int64)
        self.offsets = np.frombuffer(table, "<u8", blocks + 1, 8 * (2 * docs + 1)).astype(np.int64)

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Tokens number start to end - 1; reads only their blocks."""
        if end <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, (end - 1) // self.block
        self.source.seek(int(self.offsets[a]))
        blob = self.source.read(int(self.offsets[b + 1] - self.offsets[a]))
        out = []
        for k in range(a, b + 1):
            lo = int(self.offsets[k] - self.offsets[a])
            out.append(unpack_bits(blob[lo : int(self.offsets[k + 1] - self.offsets[a])], min(self.block, self.n - k * self.block), self.bits))
        return np.concatenate(out)[start - a * self.block : end - a * self.block]


#: kinds of bytes in lower-cased Latin text: 0 white space, 1 letters, 2 digits, 3 other marks
_KINDS = np.full(256, 3, np.uint8)
_KINDS[[0x20, *range(9, 14)]], _KINDS[ord("a") : ord("z") + 1], _KINDS[128:], _KINDS[ord("0") : ord("9") + 1] = 0, 1, 1, 2
_SHORT_ONE, _SHORT_TWO = np.frombuffer(b"stmd", np.uint8), np.array([a << 8 | b for a, b in (b"re", b"ve", b"ll")])


class WordIds(dict):
    """Slot of each piece of text that is encoded on its own, each once: words
    as text, pieces of Latin texts as bytes.

    Where the file has the rules of FAST_RULES, white space parts tokens: texts
    of ASCII and Latin letters are cut by its split pattern, others at white
    space. A file with any other rules is encoded text by text by the library."""

    LIMIT = 1_000_000  # pieces, then it starts anew: memory, not results, depends on it
    #: fixed values: the rules of the tokenizer whose pieces are known here
    FAST_RULES = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
        "post_processor": None,
    }
    #: that split pattern, for ASCII and the Latin letters up to U+017E, lower-cased
    _PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\u017e]+|[0-9]|[^a-z\xdf-\xf6\xf8-\u017e0-9 \t-\r]+")
    _LATIN = re.compile(r"[!-~\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017e]+\Z")  # normalised as they are, but for case
    _LATIN_TEXT = re.compile(r"[\t-\r -~\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017e]*\Z")
    _ODD_SPACE = re.compile("[\x1c-\x1f]")  # str.split parts there, the tokenizer doesn't
    _WORD = re.compile("[^\\s\x1c-\x1f]+|[\x1c-\x1f]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.lib = Tokenizer.from_file(path)
        rules = json.loads(self.lib.to_str())
        self.fast = all(rules[k] == v for k, v in self.FAST_RULES.items()) and rules["model"]["type"] == "BPE" and not any(t["lstrip"] or t["rstrip"] for t in rules["added_tokens"])
        self.vocabulary = self.lib.get_vocab_size(with_added_tokens=True)
        self.model = self.lib.model
        # the byte-level alphabet: printed bytes as they are, the others from U+0100 on, in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letter = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}
        self.start_anew()

    def start_anew(self) -> None:
        self.clear()
        self.new: list[list[int]] = []
        self.ids, self.first, self.have = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), 0

    def __missing__(self, word: str) -> int:
        self[word] = slot = len(self)
        self.new.append(self.encode_word(word))
        return slot

    def encode_word(self, word: str) -> list[int]:
        if not self._LATIN.match(word) or "<|" in word:  # other scripts, control and special tokens: all the library's rules
            return self.lib.encode(word, add_special_tokens=False).ids
        return [t.id for piece in self._PIECE.findall(word.lower()) for t in self.model.tokenize(self.spelt(piece))]

    def spelt(self, piece: str) -> str:
        """A piece in the byte-level alphabet."""
        return piece if piece.isascii() else "".join([self.letter[b] for b in piece.encode()])

    def words(self, text: str) -> list[str]:
        if self._ODD_SPACE.search(text):
            return re.findall(r"[^ \t\n\r\x0b\x0c]+", text)
        return text.split()

    def latin_slots(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(slots of all pieces, number of pieces of each text) of texts that _LATIN_TEXT matches.

        Pieces are found as _PIECE does: runs of letters or of other marks,
        single digits, and a mark ' that begins a piece with the letters of a
        shortened word after it."""
        blobs = [t.lower().encode() for t in texts]
        data = b"\n".join(blobs) + b"\n  "
        arr = np.frombuffer(data, np.uint8)
        kind = _KINDS[arr]
        begins = kind != 0
        begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        at = np.flatnonzero((arr == 0x27) & begins)
        one, two = arr[at + 1], arr[at + 1].astype(np.int32) << 8 | arr[at + 2]
        short = np.where(np.isin(one, _SHORT_ONE), 2, np.where(np.isin(two, _SHORT_TWO), 3, 0))
        at, short = at[short > 0], short[short > 0]
        begins[at + 1] = False
        begins[at + short] = kind[at + short] != 0
        ends = np.flatnonzero((kind[:-1] != 0) & (begins[1:] | (kind[1:] == 0))) + 1
        starts = np.flatnonzero(begins)
        n = np.diff(np.searchsorted(starts, np.cumsum([0] + [len(b) + 1 for b in blobs])))
        if not len(starts):
            return np.zeros(0, np.int64), n
        edges = np.empty(2 * len(starts), np.int32)
        edges[0::2], edges[1::2] = starts, ends
        # pieces and what lies between them, in turn, over the same bytes
        coded = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        code = coded.indices.to_numpy()[0::2]
        used = np.zeros(len(coded.dictionary), bool)
        used[code] = True
        pieces = coded.dictionary.filter(pa.array(used)).to_pylist()
        found = list(map(self.get, pieces))
        for k in [k for k, x in enumerate(found) if x is None]:
            found[k] = self[pieces[k]] = len(self)
            self.new.append([t.id for t in self.model.tokenize(self.spelt(pieces[k].decode()))])
        slot = np.zeros(len(used), np.int64)
        slot[used] = found
        return slot[code], n

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids)"""
        if not self.fast:
            each = [x.ids for x in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
            lens = np.array([len(x) for x in each], np.int64)
            return lens, np.fromiter(chain.from_iterable(each), np.uint32, int(lens.sum()))
        if len(self) > self.LIMIT:
            self.start_anew()
        plain = [bool(self._LATIN_TEXT.match(t)) and "<|" not in t for t in texts]
        slots, n = self.latin_slots([t for t, x in zip(texts, plain) if x])
        if not all(plain):  # the other texts' slots go in between
            words = [None if x else self.words(t) for t, x in zip(texts, plain)]
            own = iter(np.split(slots, np.cumsum(n)[:-1]) if len(n) else [])
            each = [next(own) if w is None else np.fromiter(map(self.__getitem__, w), np.int64, len(w)) for w in words]
            slots, n = np.concatenate(each), np.array([len(x) for x in each], np.int64)
        if self.new:
            lens = np.array([len(x) for x in self.new], np.int64)
            have, self.have = self.have, self.have + len(self.new)
            while len(self.first) < self.have + 1:
                self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            self.first[have + 1 : self.have + 1] = self.first[have] + np.cumsum(lens)
            while len(self.ids) < self.first[self.have]:
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.first[have] : self.first[self.have]] = np.fromiter((i for x in self.new for i in x), np.uint32, int(lens.sum()))
            self.new = []
        lens = self.first[slots + 1] - self.first[slots]
        per_text = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(n)]).astype(np.int64)]
        return np.diff(per_text), self.ids[spread(self.first[slots], lens)]


@functools.lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)  # kept by the Python worker: later tasks find its words encoded


def _open(uri: str):
    return pyarrow.fs.FileSystem.from_uri(uri)


def write_tokens(df: DataFrame, tokenizer_path: str, folder: str, end_id: int | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encode and write; returns the manifest: part, path, docs, tokens, start
    (tokens of all files before), one row per file in ascending order of ids.

    end_id is appended to every document. Null texts count as empty. Null
    ids come first, in the files as NO_ID, and are read back as null; rows
    that repeat an id are written one after another, in the order of their
    texts' hashes."""
    docs = id_and_text(df, doc_id, text).withColumn("d", F.coalesce(F.col("d").cast("long"), F.lit(NO_ID)))
    size = total_bytes(docs)
    files = parts(size, max(FILE_BYTES, size // MOST_FILES))
    # ties go by their texts' hash, so rows without an id, or with one that many have, are dealt over files too
    ordered = docs.withColumn("x", F.xxhash64("t")).repartitionByRange(files, "d", "x").sortWithinPartitions("d", "x").select(F.spark_partition_id().alias("part"), "d", "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = None
        for batch in batches:
            for chunk in text_slices(batch, "t", SLICE_BYTES):
                encoder = word_ids(tokenizer_path)
                if made is None:
                    part = chunk.column("part")[0].as_py()
                    fs, base = _open(folder)
                    fs.create_dir(base, recursive=True)
                    name = f"tokens-{part:06d}-{uuid.uuid4().hex}.bin"
                    out = fs.open_output_stream(f"{base}/{name}")
                    made = Writer(out, bits_for(encoder.vocabulary))
                lengths, ids = encoder.encode(chunk.column("t").to_pylist())
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(lengths), end_id)
                    lengths = lengths + 1
                made.add(chunk.column("d").to_numpy(), lengths, ids)
        if made is not None:
            docs_in, n = made.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([docs_in], pa.int64()), pa.array([n], pa.int64())], ["part", "path", "docs", "tokens"])

    manifest = written(ordered.mapInArrow(write, "part int, path string, docs long, tokens long"), "manifest")
    # one row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files, read back from them."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                fs, name = _open(path)
                with fs.open_input_file(name) as source:
                    r = Reader(source)
                    for a in range(0, len(r.ids), 1024):
                        b = min(a + 1024, len(r.ids))
                        s = r.starts[a : b + 1]
                        raw = memoryview(r.tokens(int(s[0]), int(s[-1])).astype("<u4").tobytes())
                        at = ((s - s[0]) * 4).tolist()
                        yield pa.RecordBatch.from_arrays([pa.array(r.ids[a:b], mask=r.ids[a:b] == NO_ID), pa.array(s[:-1] + start), pa.array(np.diff(s)),
                                                          pa.array([zlib.crc32(raw[x:y]) for x, y in zip(at, at[1:])], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("part", "path", "start")
    return files.repartitionByRange(max(1, files.count()), "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(df: DataFrame) -> str:
    return scratch_path(df.sparkSession, f"tokens-{uuid.uuid4().hex}")
