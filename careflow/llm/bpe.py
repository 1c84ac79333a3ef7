"""Byte-pair encoding and decoding with a public vocabulary file."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEFT_BITS = 10
LEFT_MASK = (1 << LEFT_BITS) - 1
#: No merge; its low bits are no length of a left part.
NEVER = 1 << 60
#: Words of up to so many characters are scanned for the smallest rank; longer ones take their ranks from a heap.
SHORT = 96
#: Words, and half as many runs of non-blank characters, that an encoder remembers in each of two generations.
KEPT = 80_000
CONTROLS = re.compile("[\x1c-\x1f]")
CHUNKS = re.compile("[^\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def read_vocabulary(path: str) -> dict:
    """The parts of a tokenizer file that encoding and decoding need; raises for a file of another kind."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
    split, byte_level = spec["pre_tokenizer"]["pretokenizers"]
    if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or byte_level["type"] != "ByteLevel" or spec["decoder"] or model["unk_token"]:
        raise ValueError(f"{path}: only lower-casing word-end BPE files with byte characters are read")
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return {
        "ids": model["vocab"], "pairs": pairs, "end": model["end_of_word_suffix"] or "", "pattern": split["pattern"]["Regex"],
        "special": {t["content"]: t["id"] for t in spec["added_tokens"]},
    }


def byte_characters() -> list[str]:
    """The printable stand-in of each byte: itself where it is printable in Latin-1, else the next free character from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in plain else next(free)) for b in range(256)]


def rank_table(pairs: list[tuple[str, str]]) -> dict[str, int]:
    """Rank of each merge by the merged string, which only one pair makes; the low bits hold the length of the left part."""
    table = {left + right: (i << LEFT_BITS) + len(left) for i, (left, right) in enumerate(pairs)}
    if len(table) < len(pairs):
        raise ValueError("two merges make one string")
    return table


def merge_word(word: str, last: int, ranks: dict[str, int]) -> list[str]:
    """Parts of `word` after all merges; the end mark of length `last` belongs to the final character.

    `edge` holds the part boundaries and `rank` the rank of each part with its right neighbour, side by side. The smallest
    rank is found by a scan (the leftmost of equals), its boundary deleted and the two ranks beside it refreshed.
    """
    n = len(word) - last
    if n > SHORT:
        return merge_long_word(word, last, ranks)
    get = ranks.get
    edge = [*range(n), len(word)]
    rank = [get(word[i : i + 2], NEVER) for i in range(n - 2)]
    if n > 1:
        rank.append(get(word[n - 2 :], NEVER))
    while rank:
        low = min(rank)
        if low == NEVER:
            break
        i = rank.index(low)
        del edge[i + 1], rank[i]
        a, b = edge[i], edge[i + 1]
        if i < len(rank):
            r = get(word[a : edge[i + 2]], NEVER)
            rank[i] = r if r & LEFT_MASK == b - a else NEVER
        if i:
            c = edge[i - 1]
            r = get(word[c:b], NEVER)
            rank[i - 1] = r if r & LEFT_MASK == a - c else NEVER
    return [word[i:j] for i, j in zip(edge, edge[1:])]


def merge_long_word(word: str, last: int, ranks: dict[str, int]) -> list[str]:
    """The same result for a word of any length: ranks wait in a heap, and each part knows where it starts and ends."""
    n = len(word) - last
    stop = [*range(1, n), len(word)]
    before = [*range(-1, n - 1)]
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = stop[i]
        if j < n and stop[j] - i < 1 << LEFT_BITS and (rank := ranks.get(word[i : stop[j]], NEVER)) & LEFT_MASK == j - i:
            heapq.heappush(heap, (rank, i, j, stop[j]))

    for i in range(n):
        offer(i)
    alive = [True] * n
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if not alive[i] or stop[i] != j or not alive[j] or stop[j] != k:
            continue
        stop[i], alive[j] = k, False
        if k < n:
            before[k] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    parts, i = [], 0
    while i < n:
        parts.append(word[i : stop[i]])
        i = stop[i]
    return parts


class Remembered(dict):
    """What `make` gives for a key, remembered in two generations: when the newer is full it becomes the older, whose entries go unless they are asked for again."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.older = self.copy()
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class Encoder:
    """Token ids, as bytes, of texts."""

    def __init__(self, vocabulary: dict):
        self.ids, self.ranks, self.end = vocabulary["ids"], rank_table(vocabulary["pairs"]), vocabulary["end"]
        self.pattern = regex.compile(vocabulary["pattern"])
        self.special = {k: np.array([v], "<i4").tobytes() for k, v in vocabulary["special"].items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes = byte_characters()
        self.words, self.chunks = Remembered(self._word, KEPT), Remembered(self._chunk, KEPT // 2)

    def _word(self, word: str) -> bytes:
        shown = "".join([self.bytes[b] for b in word.encode()]) + self.end
        return np.array([self.ids[p] for p in merge_word(shown, len(self.end), self.ranks)], "<i4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        text = (chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ")).lower()
        if text.isalpha():  # letters only are one word
            return self.words[text]
        return b"".join(map(self.words.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> bytes:
        if self.split_special is not None and "<" in text:
            return b"".join(self.special[p] if p in self.special else self._plain(p) for p in self.split_special.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        chunks = CHUNKS.findall(text) if CONTROLS.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, chunks))


#: The encoder of this Python worker by file; what it remembers serves the worker's next tasks.
ENCODERS: dict[str, Encoder] = {}


def worker_encoder(shared: Broadcast, path: str) -> Encoder:
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(shared.value)
    return ENCODERS[path]


def share(spark: SparkSession, path: str) -> Broadcast:
    """Send the vocabulary, a file of fixed size, to the executors."""
    return spark.sparkContext.broadcast(read_vocabulary(path))


def _lists(pieces: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(p) // 4 for p in pieces]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(pieces), "<i4")))


def _slices(part: pa.RecordBatch, tokens_each: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its texts together reach `tokens_each` characters."""
    at = held = 0
    for i, n in enumerate(part.column(1).cast(pa.large_binary()).to_pylist()):
        held += len(n or b"")
        if held >= tokens_each:
            yield part.slice(at, i + 1 - at)
            at, held = i + 1, 0
    if at < part.num_rows:
        yield part.slice(at)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text: `id_col` and `ids`, an array of token ids, without added start and end tokens.

    Special tokens written out in a text are found as such. Null and empty texts have no tokens. Rows with null or repeated
    ids are encoded like any other; other columns are ignored; an empty table gives no rows. The encoder keeps a bounded
    memory of words, and words of any length are encoded in about linear time.
    """
    shared = share(docs.sparkSession, path)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared, path)
        for whole in parts:
            for part in _slices(whole):
                pieces = [encoder.encode(t) if t else b"" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(pieces)], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


class Decoder:
    """Texts of token ids: the tokens' own strings joined by one blank, special tokens included; ids outside the vocabulary are left out."""

    def __init__(self, vocabulary: dict):
        self.by_id = {i: t for t, i in {**vocabulary["ids"], **vocabulary["special"]}.items()}

    def text(self, ids: list[int]) -> str:
        try:
            return " ".join(map(self.by_id.__getitem__, ids))
        except KeyError:
            return " ".join([self.by_id[i] for i in ids if i in self.by_id])


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and decode its ids in the same worker: `id_col`, `ids` and `decoded`, as `encode` and `decode` give them."""
    shared = share(docs.sparkSession, path)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = worker_encoder(shared, path), Decoder(shared.value)
        for part in (p for whole in parts for p in _slices(whole)):
            ids = _lists([encoder.encode(t) if t else b"" for t in part.column(1).to_pylist()])
            flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
            texts = [decoder.text(flat[a:b].tolist()) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(texts, pa.string())], names=["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decode every array of token ids: `id_col`, `ids_col` and `decoded`.

    The file names no decoder, so the tokens' own strings are joined by one blank, special tokens included; ids outside the
    vocabulary are left out. A null array decodes to the empty text.
    """
    shared = share(encoded.sparkSession, path)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = Decoder(shared.value).text
        for part in parts:
            ids, ends = part.column(1), part.column(1).offsets.to_numpy()
            flat, known = ids.values.to_numpy(zero_copy_only=False), ids.is_valid().to_pylist()
            texts = [text(flat[ends[i] : ends[i + 1]].tolist()) if known[i] else "" for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(texts, pa.string())], names=["id", "ids", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    out = encoded.select(id_col, ids_col).mapInArrow(run, f"id {kind}, ids array<int>, decoded string")
    return out.select(F.col("id").alias(id_col), F.col("ids").alias(ids_col), "decoded")
