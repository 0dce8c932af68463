"""Bounded-space online packing of token sequences.

Every partition keeps a fixed number of open windows. A document goes to the open window it
fills best; when it fits none, the fullest window is topped up with its first tokens and
given out. What stays open at the end is merged, first inside the partition, then across
groups of partitions.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacktally import workspace as w
from stacktally.llm.common import whole

WINDOW_TOKENS = 4096
OPEN_WINDOWS = 32
# Gaps below this are padded, not filled with a cut piece.
LEAST_CUT = 16
END_ID = 2
# Partitions whose last open windows are merged together.
MERGED_PARTITIONS = 64

PIECE = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, is_open boolean"
)


# Words that every step but the merges leaves alone, apart from lower case: no white space, no
# combining character, no special token.
_PLAIN = re.compile("[\x21-;=-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
# Fixed value: the tokenizer's own split into parts, for plain words in lower case.
_PARTS = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u017f]+|[0-9]|[^a-z0-9\u00c0-\u017f]+"
)


def _byte_letters() -> list[str]:
    """The printable letter of each byte in a byte-level vocabulary (printable bytes stay)."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in set(kept) else chr(next(others)) for b in range(256)]


class _Parts(dict):
    """Ids of the parts of plain words, in lower case."""

    def __init__(self, model):
        super().__init__()
        self.tokenize = model.tokenize
        self.letters = _byte_letters()

    def __missing__(self, part: str) -> bytes:
        mapped = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
        found = self[part] = array("I", [t.id for t in self.tokenize(mapped)]).tobytes()
        return found


class Encoder(dict):
    """Ids of whole texts by a public tokenizer that never joins words over white space.

    Maps a word between ASCII spaces to its ids, as little-endian unsigned 32-bit numbers. A
    word is encoded when it is first seen and looked up from then on, which gives the ids of
    the whole text several times faster than encoding it at once. The tables are emptied when
    they have ``most_words`` words, and very long words are never kept: their size is bounded.
    """

    def __init__(self, path: str, most_words: int = 600_000, longest_word: int = 40):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.part = _Parts(self.tokenizer.model)
        self.most_words, self.longest_word = most_words, longest_word

    def __missing__(self, word: str) -> bytes:
        if len(word) > self.longest_word:
            return self._whole(word)
        if _PLAIN.fullmatch(word):
            found = b"".join([self.part[p] for p in _PARTS.findall(word.lower())])
        else:
            found = self._whole(word)
        self[word] = found
        return found

    def _whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if len(self) + len(self.part) > self.most_words:
            self.clear()
            self.part.clear()
        for space in "\n\t\r":
            text = text.replace(space, " ")
        return b"".join(map(self.__getitem__, text.split(" ")))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker, kept over its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Piece:
    """Tokens ``start .. start + len(ids)`` of one document."""

    __slots__ = ("doc_id", "doc_tokens", "ids", "start")

    def __init__(self, doc_id, doc_tokens: int, start: int, ids: np.ndarray):
        self.doc_id, self.doc_tokens, self.start, self.ids = doc_id, doc_tokens, start, ids

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc_id, self.doc_tokens, self.start, self.ids[:n]),
            Piece(self.doc_id, self.doc_tokens, self.start + n, self.ids[n:]),
        )


class Packer:
    """The open windows of one partition; ``rows`` collects what is given out."""

    def __init__(self, partition: int, size: int, open_windows: int, least_cut: int):
        self.partition, self.size = partition, size
        self.most_open, self.least_cut = open_windows, least_cut
        self.open: list[tuple[int, list[Piece]]] = []  # gap, pieces
        self.given_out = 0
        self.rows: list[tuple] = []

    def give_out(self, pieces: list[Piece], is_open: bool = False) -> None:
        sequence_id, offset = (self.partition << 32) + self.given_out, 0
        for p in pieces:
            n = len(p.ids)
            crc = zlib.crc32(p.ids.tobytes())
            self.rows.append((p.doc_id, p.start, n, crc, p.doc_tokens, sequence_id, offset, is_open))
            offset += n
        self.given_out += 1

    def add(self, piece: Piece) -> None:
        while len(piece.ids) >= self.size:
            head, piece = piece.cut(self.size)
            self.give_out([head])
        n = len(piece.ids)
        while n:
            fitting = [i for i, (gap, _) in enumerate(self.open) if gap >= n]
            if fitting:
                best = min(fitting, key=lambda i: self.open[i][0])
                gap, pieces = self.open[best]
                pieces.append(piece)
                if gap == n:
                    self.give_out(self.open.pop(best)[1])
                else:
                    self.open[best] = (gap - n, pieces)
                return
            if len(self.open) < self.most_open:
                self.open.append((self.size - n, [piece]))
                return
            fullest = min(range(len(self.open)), key=lambda i: self.open[i][0])
            gap, pieces = self.open.pop(fullest)
            if gap >= self.least_cut:
                head, piece = piece.cut(gap)
                pieces.append(head)
                n -= gap
            self.give_out(pieces)

    def close(self) -> None:
        """Fills the fullest windows from the emptiest; at most one window stays open."""
        self.open.sort(key=lambda window: window[0])
        spare = [p for _, pieces in self.open for p in pieces]
        self.open = []
        current, gap = [], self.size
        for piece in spare:
            while len(piece.ids) > gap:
                if gap >= self.least_cut:
                    head, piece = piece.cut(gap)
                    current.append(head)
                self.give_out(current)
                current, gap = [], self.size
            current.append(piece)
            gap -= len(piece.ids)
            if not gap:
                self.give_out(current)
                current, gap = [], self.size
        if current:
            self.give_out(current, is_open=True)


def _pack_partition(tokenizer_path: str, size: int, open_windows: int, least_cut: int, end_id: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer_path).encode
        end = np.array([end_id], dtype="<u4").tobytes()
        packer = Packer(TaskContext.get().partitionId(), size, open_windows, least_cut)
        columns = [c.split()[0] for c in PIECE.split(", ")]

        def flush() -> pd.DataFrame:
            rows, packer.rows = packer.rows, []
            return pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
                tokens = np.frombuffer(encode(text) + end, dtype="<u4")
                packer.add(Piece(doc_id, len(tokens), 0, tokens))
            yield flush()
        packer.close()
        yield flush()

    return pack


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    """First fit by falling size of the open windows of one group of partitions."""
    size = int(group["size"].iloc[0])
    group = group.sort_values(["tokens", "sequence_id"], ascending=[False, True])
    filled: list[int] = []
    out = []
    for old, tokens, number in zip(group["sequence_id"], group["tokens"], group["group_id"]):
        at = next((i for i, n in enumerate(filled) if n + tokens <= size), len(filled))
        if at == len(filled):
            filled.append(0)
        out.append((old, (1 << 62) + (int(number) << 32) + at, filled[at]))
        filled[at] += tokens
    return pd.DataFrame(out, columns=["sequence_id", "merged_id", "base"])


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    size: int = WINDOW_TOKENS,
    open_windows: int = OPEN_WINDOWS,
    least_cut: int = LEAST_CUT,
    end_id: int = END_ID,
    merged_partitions: int = MERGED_PARTITIONS,
) -> DataFrame:
    """One row per piece: which ids of a document lie where in which sequence.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. A null or empty text is
    the end id alone. A null doc_id stays null; repeated rows are packed each. A document
    longer than a window is cut; others only where that fills a window. An empty table gives
    no rows. Memory per task: the open windows and one batch of texts. Only the last open
    window of each partition is moved, without its tokens.
    """
    pieces = docs.select("doc_id", whole(F.col("text")).alias("text")).mapInPandas(
        _pack_partition(tokenizer_path, size, open_windows, least_cut, end_id), PIECE
    )
    pieces = w.publish(pieces, "pieces")
    left = pieces.filter("is_open")
    windows = left.groupBy("sequence_id").agg(F.sum("length").alias("tokens")).withColumns({
        "group_id": F.floor(F.shiftright("sequence_id", 32) / F.lit(merged_partitions)),
        "size": F.lit(size),
    })
    merged = windows.groupBy("group_id").applyInPandas(
        _merge, "sequence_id bigint, merged_id bigint, base bigint"
    )
    moved = left.join(merged, "sequence_id").withColumns({
        "sequence_id": F.col("merged_id"), "offset": F.col("offset") + F.col("base"),
    })
    columns = [c for c in pieces.columns if c != "is_open"]
    return pieces.filter("NOT is_open").select(columns).unionByName(moved.select(columns))
