"""Token counts that follow edits: a tree of counts over each text, of which only what an edit touches is encoded again."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careflow.llm.bpe import Encoder, share, worker_encoder

LEAF = 512
BLANK = re.compile("[\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
COUNTED_SQL = "id long, n_tokens long, edited_tokens long, edited_chars long, encoded_chars long"


class CountedText:
    """A text in leaves that each end after a blank, with the leaves' lengths and token counts summed up in a segment tree.

    A word never reaches over a blank, so a leaf is encoded on its own. Node i of the tree has children 2i and 2i + 1; the
    leaves start at `width`.
    """

    def __init__(self, text: str, encoder: Encoder):
        self.encoder, self.encoded = encoder, 0
        self._plant(self._cut(text))

    def _cut(self, text: str) -> list[str]:
        out, at = [], 0
        while at < len(text):
            blank = BLANK.search(text, at + LEAF)
            end = blank.end() if blank else len(text)
            out.append(text[at:end])
            at = end
        return out

    def _count(self, text: str) -> int:
        self.encoded += len(text)
        return len(self.encoder.encode(text)) // 4

    def _plant(self, leaves: list[str], counts: list[int] | None = None) -> None:
        self.leaves = leaves or [""]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        counts = counts or [self._count(x) for x in self.leaves]
        rest = self.width - len(self.leaves)
        self.leaves += [""] * rest
        self.chars = [0] * self.width + [len(x) for x in self.leaves]
        self.tokens = [0] * self.width + counts + [0] * rest
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _find(self, place: int) -> tuple[int, int]:
        """Leaf that holds a place, and how far into it; the end of the text is in the last leaf that has characters."""
        i = 1
        while i < self.width:
            i *= 2
            if place >= self.chars[i] and self.chars[i + 1]:
                place -= self.chars[i]
                i += 1
        return i - self.width, place

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        i = leaf + self.width
        more, less = len(text) - self.chars[i], tokens - self.tokens[i]
        while i:
            self.chars[i] += more
            self.tokens[i] += less
            i //= 2

    def edit(self, start: int, end: int, new: str) -> None:
        """Put `new` in the place of the code points from `start` up to `end`; places outside the text mean its ends.

        The leaves from the first to the last touched are encoded again as one. If they no longer end after a blank, the next
        leaf comes in as well: a word may now reach into it.
        """
        n = self.chars[1]
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        first, before = self._find(start)
        last, after = self._find(end)
        text = self.leaves[first][:before] + new + self.leaves[last][after:]
        while text and not BLANK.match(text[-1]) and last + 1 < self.width:
            last += 1
            text += self.leaves[last]
        if len(text) > 16 * LEAF:
            counts = self.tokens[self.width :]
            fresh = self._cut(text)
            self._plant([*self.leaves[:first], *fresh, *self.leaves[last + 1 :]], [*counts[:first], *map(self._count, fresh), *counts[last + 1 :]])
            return
        for i in range(first + 1, last + 1):
            self._set(i, "", 0)
        self._set(first, text, self._count(text))

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]


def count_edits(
    docs: DataFrame, edits: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
    order_col: str = "edit", start_col: str = "start", end_col: str = "stop", new_col: str = "new",
) -> DataFrame:
    """Token counts of every text before and after its edits: `id_col`, `n_tokens`, `edited_tokens`, `edited_chars`, `encoded_chars`.

    `edits` has the document's id, an order, the code points from `start_col` up to `end_col` of the text as the edits before
    have left it, and the text that takes their place. `encoded_chars` is how many characters were encoded, the first count
    included. Documents and edits meet in one shuffle by id and are walked in order, so a task holds one text at a time
    however many edits it has.

    A null text is empty. A null start or end means the start or the end of the text, null new text is empty, places outside
    the text mean its ends. Documents without edits keep their count; edits of unknown or null ids change nothing; rows with
    a null id are counted and not edited. If rows share an id, the edits go to the last of them by text. Other columns are
    ignored; an empty table gives no rows.
    """
    shared = share(docs.sparkSession, path)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.lit(None).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.lit(0).alias("kind"), none.alias("nth"), none.alias("start"), none.alias("stop"), text.alias("text"))
    steps = edits.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.lit(1).alias("kind"), F.col(order_col).cast("long").alias("nth"), F.col(start_col).cast("long").alias("start"),
        F.col(end_col).cast("long").alias("stop"), F.coalesce(F.col(new_col).cast("string"), F.lit("")).alias("text"))
    # Null ids are spread by text; an id's edits follow its documents.
    dealt = rows.union(steps).repartition(F.coalesce("id", F.xxhash64("text"))).sortWithinPartitions("id", "kind", "nth", "start", "text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared, path)
        names = ["id", "n_tokens", "edited_tokens", "edited_chars", "encoded_chars"]
        now: tuple[int | None, CountedText, int] | None = None
        out: list[tuple] = []

        def close() -> None:
            if now is not None:
                out.append((now[0], now[2], now[1].n_tokens, now[1].n_chars, now[1].encoded))

        for part in parts:
            for i, kind, start, stop, new in zip(*[part.column(c).to_pylist() for c in (0, 1, 3, 4, 5)]):
                if kind == 0:
                    close()
                    tree = CountedText(new, encoder)
                    now = (i, tree, tree.n_tokens)
                elif now is not None and i == now[0]:
                    now[1].edit(0 if start is None else start, now[1].n_chars if stop is None else stop, new)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    return dealt.mapInArrow(run, COUNTED_SQL).withColumnRenamed("id", id_col)
