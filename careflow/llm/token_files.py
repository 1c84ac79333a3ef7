"""Token ids in binary files: fixed-width bits, blocks with offsets, reads of any run of ids."""

from __future__ import annotations

import functools
import os
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from careflow.llm.bpe import byte_characters
from careflow.session import cut_lineage, scratch_path, spread

MAGIC = b"IDBITS01"
#: Ids are packed in groups of 64, which fill `bits` words of 64 bits exactly; a read starts at a group.
GROUP = 64
#: Ids a block holds.
BLOCK = 1 << 16
#: A file takes no further document once it holds so many ids.
FILE_IDS = 1 << 26
TRAILER = struct.Struct("<IIQQQ8s")
#: Words that an encoder remembers of each kind, and characters of the longest of them.
REMEMBERED = 500_000
LONGEST = 64
#: Characters of a text whose words are held at a time.
RUN = 1 << 21
BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")
TWO_BLANKS = re.compile(r"\s\s")
#: Non-blank characters up to the end of the Latin letters, and signs of general punctuation.
PLAIN = re.compile("[!-~\u00a1-\u024f\u2010-\u2027\u2030-\u205e]+")
LINES = re.compile(r"\S+(?:\n\S+)+")
#: The published pieces of byte-level BPE for words of such characters: fixed values.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[^\\W0-9_\u00b2\u00b3\u00b9\u00bc-\u00be]+| ?[0-9\u00b2\u00b3\u00b9\u00bc-\u00be]+| ?(?:[^\\s\\w]|_)+")


def width(vocabulary: int) -> int:
    """Bits that hold every id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids of `bits` bits each, lowest bit first; the last group is filled up with zeros."""
    groups = -(-len(ids) // GROUP)
    lanes = np.zeros((groups, GROUP), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    words = np.zeros((groups, bits), np.uint64)
    for lane in range(GROUP):
        word, shift = divmod(lane * bits, 64)
        words[:, word] |= lanes[:, lane] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= lanes[:, lane] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack_bits(data: bytes, bits: int) -> np.ndarray:
    """All ids of whole groups, those that only fill up the last one too."""
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    out = np.empty((len(words), GROUP), np.uint32)
    low = np.uint64((1 << bits) - 1)
    for lane in range(GROUP):
        word, shift = divmod(lane * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | words[:, word + 1] << np.uint64(64 - shift)
        out[:, lane] = value & low
    return out.reshape(-1)


class TokenFileWriter:
    """Writes one file: blocks as they fill, then the offsets of the blocks, the table of documents (id, start), and the trailer."""

    def __init__(self, out: pa.NativeFile, bits: int, id_type: pa.DataType):
        self.out, self.bits, self.id_type = out, bits, id_type
        self.offsets, self.ids, self.starts = [0], [], []
        self.n_ids, self.held, self.n_held = 0, [], 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.starts.append(self.n_ids)
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            whole = np.concatenate(self.held)
            full = len(whole) // BLOCK * BLOCK
            for at in range(0, full, BLOCK):
                self._block(whole[at : at + BLOCK])
            self.held, self.n_held = [whole[full:]], len(whole) - full

    def _block(self, ids: np.ndarray) -> None:
        data = pack_bits(ids, self.bits)
        self.out.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        table = pa.record_batch([pa.array(self.ids, self.id_type), pa.array(self.starts, pa.int64())], names=["id", "start"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_batch(table)
        documents = sink.getvalue()
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(documents)
        self.out.write(TRAILER.pack(self.bits, BLOCK, self.n_ids, len(self.offsets), documents.size, MAGIC))
        self.out.close()


class TokenFile:
    """One file, open for reading: `ids(start, stop)` reads only the groups that hold them."""

    def __init__(self, source: pa.NativeFile):
        self.source = source
        size = source.size()
        self.bits, self.block, self.n_ids, n_offsets, n_table, magic = TRAILER.unpack(self._at(size - TRAILER.size, TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        tail = size - TRAILER.size - n_table - 8 * n_offsets
        self.offsets = np.frombuffer(self._at(tail, 8 * n_offsets), "<u8").astype(np.int64)
        table = pa.ipc.open_stream(self._at(tail + 8 * n_offsets, n_table)).read_all()
        self.doc_ids = table.column("id").combine_chunks()
        self.bounds = np.append(table.column("start").to_numpy(), self.n_ids)

    def _at(self, start: int, n: int) -> bytes:
        self.source.seek(start)
        return self.source.read(n)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids number `start` to `stop` - 1 of the file."""
        start, stop = max(0, start), min(stop, self.n_ids)
        pieces = []
        for b in range(start // self.block, -(-stop // self.block) if stop > start else 0):
            first, last = max(start - b * self.block, 0), min(stop - b * self.block, self.block)
            skip, end = first // GROUP, -(-last // GROUP)
            data = self._at(int(self.offsets[b]) + skip * self.bits * 8, (end - skip) * self.bits * 8)
            pieces.append(unpack_bits(data, self.bits)[first - skip * GROUP : last - skip * GROUP])
        return np.concatenate(pieces) if pieces else np.zeros(0, np.uint32)

    def document(self, number: int) -> np.ndarray:
        """Ids of the document at place `number`, its end id included."""
        return self.ids(int(self.bounds[number]), int(self.bounds[number + 1]))


def _at_uri(path: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a folder of the cluster's shared storage."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return pa.fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def open_file(path: str) -> TokenFile:
    fs, at = _at_uri(path)
    return TokenFile(fs.open_input_file(at))


def ids_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Words(dict):
    """Ids, as bytes of 32-bit integers, of the words that stand after `before`; forgets all once it holds `REMEMBERED` words.

    Words of plain characters are cut into pieces here and the pieces given to the tokenizer's model, any other word is given to the
    tokenizer whole. The first piece of a word is remembered here too, the others by `bare`, which has words without a blank before them.
    """

    def __init__(self, tokenizer: Tokenizer, before: str, bare: Words | None = None):
        super().__init__()
        self.tokenizer, self.before, self.bare = tokenizer, before, self if bare is None else bare
        self.tokenize = tokenizer.model.tokenize
        shown = byte_characters()
        self.line_end = ids_bytes(tokenizer.encode("\n", add_special_tokens=False).ids)
        self.shown, self.head = dict(enumerate(shown)), before.replace(" ", shown[32])
        self.added = re.compile("|".join(re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()) or "(?!)")

    def _keep(self, word: str, ids: bytes) -> bytes:
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids

    def piece(self, piece: str) -> bytes:
        """Ids of a word that is a single piece."""
        ids = self.get(piece)
        if ids is None:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.shown)
            ids = self._keep(piece, ids_bytes([t.id for t in self.tokenize(self.head + shown)]))
        return ids

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self.piece(word)
        if "\n" in word and LINES.fullmatch(word):  # a line end between non-blanks is a piece of its own
            head, *lines = word.split("\n")
            return self[head] + b"".join([self.line_end + self.bare[x] for x in lines])
        text = self.before + word
        if not PLAIN.fullmatch(word) or self.added.search(word):
            return self._keep(word, ids_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids))
        first, *rest = PIECES.findall(text)
        ids = self.piece(first[len(self.before):])
        return self._keep(word, ids + b"".join(map(self.bare.piece, rest))) if rest else ids


class TextEncoder:
    """Ids of whole texts through the tokenizers library, each distinct word once while it is remembered.

    A single blank between two non-blanks always starts a piece of byte-level BPE, whatever stands around it, so the ids of a
    text are those of its words, each with the blank before it, one after the other. Runs of blanks stay inside a word.
    """

    def __init__(self, path: str):
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        kinds = type(tokenizer.pre_tokenizer).__name__, type(tokenizer.model).__name__
        if kinds != ("ByteLevel", "BPE") or tokenizer.pre_tokenizer.add_prefix_space or tokenizer.normalizer is not None:
            raise ValueError(f"{path}: only byte-level BPE files without normaliser and added blank are read")
        self.first = Words(tokenizer, "")
        self.later = Words(tokenizer, " ", self.first)

    def encode(self, text: str) -> bytes:
        """About `RUN` characters of words are held at a time."""
        out, at = [], 0
        while at <= len(text):
            stop = BETWEEN_WORDS.search(text, at + RUN) if len(text) - at > RUN else None
            run = text[at : stop.start()] if stop else text[at:]
            words = BETWEEN_WORDS.split(run) if TWO_BLANKS.search(run) else run.split(" ")
            if at == 0:
                out.append(self.first[words.pop(0)])
            out.append(b"".join(map(self.later.__getitem__, words)))
            at += len(run) + 1
        return b"".join(out)


@functools.lru_cache(maxsize=1)
def worker_encoder(path: str) -> TextEncoder:
    """The encoder of this Python worker; what it remembers, `REMEMBERED` short words of each kind at most, serves the worker's next tasks."""
    return TextEncoder(path)


def write_ids(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode texts and write their ids to files in ascending id order; returns the manifest `part`, `number`, `file`, `n_docs`, `n_ids`, `base`.

    `path` is a byte-level tokenizer file. `end_id` ends every document, and null and empty texts have it alone. Documents
    with null ids come first; of equal ids the order is that of a hash of their texts, and equal rows are written each. Other columns
    are ignored; an empty table gives an empty manifest. `folder` (a fresh one on the shared storage if not given) takes the files, and the whole
    order is that of `part` and `number`; `base` is the number of ids before a file.

    A range of ids is one task's work and is dealt by id, text hash and row, so many rows of one id are no single task. A task
    streams its texts and starts another file after `file_ids` ids. Each attempt of a task writes files of its own names, and only
    files named by the manifest, which holds the rows of tasks that Spark committed, count; so a lost executor or a second attempt leaves
    no gap and no repeat.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-ids")
    text = F.col(text_col).cast("string")
    ordered = (
        docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("mark"), F.monotonically_increasing_id().alias("row"))
        .repartitionByRange("id", "mark", "row").sortWithinPartitions("id", "mark", "row").select("id", "text")
    )
    bits = width(max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1))
    end = np.array([end_id], "<u4").tobytes()

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part_id = worker_encoder(path), TaskContext.get().partitionId()
        fs, at = _at_uri(folder)
        fs.create_dir(at, recursive=True)
        number, name, out = 0, None, None

        def finished() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part_id], pa.int32()), "number": pa.array([number], pa.int32()), "file": [f"{folder}/{name}"],
                "n_docs": pa.array([len(out.ids)], pa.int64()), "n_ids": pa.array([out.n_ids], pa.int64())})

        for part in parts:
            for doc_id, value in zip(part.column(0).to_pylist(), part.column(1)):
                if out is None:
                    name = f"{part_id:06d}-{number:04d}-{uuid.uuid4().hex}.ids"
                    out = TokenFileWriter(fs.open_output_stream(f"{at}/{name}"), bits, part.column(0).type)
                out.add(doc_id, np.frombuffer(encoder.encode(value.as_py() or "") + end, "<u4"))
                if out.n_ids >= file_ids:
                    yield finished()
                    number, out = number + 1, None
        if out is not None:
            yield finished()

    written = cut_lineage(ordered.mapInArrow(write, "part int, number int, file string, n_docs long, n_ids long"), "token-manifest")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return written.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_documents(manifest: DataFrame, kind: str = "bigint", with_ids: bool = False, at_once: int = 1 << 20) -> DataFrame:
    """One row per document of the files of a manifest: `id` (of Spark type `kind`), `start` (ids of all documents before it), `n_tokens`, `ids_crc32`, and `ids` if asked for.

    The checksum is the unsigned CRC-32 of the ids as little-endian 32-bit integers. A task reads runs of about `at_once` ids.
    """

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for name, base in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                with (file := open_file(name)).source:
                    first = 0
                    while first < len(file):
                        last = max(first + 1, int(np.searchsorted(file.bounds, file.bounds[first] + at_once, "right")) - 1)
                        bounds = file.bounds[first : last + 1]
                        ids = file.ids(int(bounds[0]), int(bounds[-1])).astype("<u4")
                        places = bounds - bounds[0]
                        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(places, places[1:])]
                        columns = [file.doc_ids.slice(first, last - first), pa.array(bounds[:-1] + base), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())]
                        if with_ids:
                            columns.append(pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(ids.astype(np.int32))))
                        yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
                        first = last

    schema = f"id {kind}, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return spread(manifest.select("file", "base")).mapInArrow(read, schema)
