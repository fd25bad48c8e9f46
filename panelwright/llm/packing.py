"""Sum-of-squares packing of tokenised documents into windows of a fixed length.

A document is cut into full windows and a rest. The rest goes to the fill level that makes the
sum over levels of (number of open windows at the level) squared smallest, a new window being one
of the choices. The state is one counter per level, so a placement costs one pass over a small
array however many windows are open.

Each task packs the rows of its own input split: there is no shuffle, and a lost task repeats
alone. When the open windows of a task hold ``open_tokens`` tokens, and at the end of the task,
what is open is cut into full windows; the last of them into powers of two, which need no padding.

Rows: a null text is an empty text (its only token is the end); a null or repeated ``doc_id``
packs like any other row; an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame

from panelwright.llm.common import column, giving_back, process_cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECES = ("doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
END = 1

#: Pieces of the byte-level pattern within Latin letters, where every library agrees on the classes.
_SPACES, _LETTERS, _DIGITS = "\\t-\\r \\x85\\xa0", "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
LATIN = re.compile(
    f"'(?:[sdmt]|ll|ve|re)| ?(?:[{_LETTERS}]+|[{_DIGITS}]+|[^{_SPACES}{_LETTERS}{_DIGITS}]+)|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
BEYOND = re.compile("[^\\x00-\\u024f]")


class ByteBpe:
    """Ids of a byte-level BPE file.

    Latin text is split here and each distinct piece is encoded once in a process; any other text
    goes to the tokenizer itself. ``special`` strings count as the tokenizer counts them.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None, known: int = 150_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.known, self.pieces, self.core = known, {}, None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.core = tiktoken.Encoding("pieces", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})

    def piece(self, text: str) -> bytes:
        ids = self.pieces.get(text)
        if ids is None:
            ids = array("I", self.core._encode_single_piece(text)).tobytes()
            if len(text) <= 64:
                if len(self.pieces) >= self.known:
                    self.pieces.clear()
                self.pieces[text] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if self.core is None or BEYOND.search(text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.frombuffer(b"".join(map(self.piece, LATIN.findall(text))), dtype="<u4")


def byte_bpe(tokenizer_path: str, ranks_path: str | None) -> ByteBpe:
    cache = process_cache("byte_bpe")
    key = (tokenizer_path, ranks_path)
    if key not in cache:
        cache[key] = ByteBpe(*key)
    return cache[key]


class Packer:
    """Open windows by fill level; finished pieces wait in ``done``."""

    def __init__(self, size: int, first_id: int, open_tokens: int):
        self.size, self.next_id, self.open_tokens = size, first_id, open_tokens
        self.level = np.zeros(size + 1, dtype=np.int64)  # number of open windows at each fill level
        self.windows: list[list[list]] = [[] for _ in range(size + 1)]
        self.held = 0
        self.done: list[tuple] = []

    def new_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def emit(self, sequence: int, offset: int, piece: tuple) -> None:
        doc, start, ids, total = piece
        self.done.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset))

    def choose(self, n: int) -> int:
        """The level whose use leaves the smallest sum of squares; the fullest of equals; 0: a new window."""
        size = self.size
        at = self.level[1 : size - n + 1]
        if not at.size:
            return 0
        to = 2 * self.level[1 + n : size + 1] + 1
        to[-1] = 0  # a full window is closed and no longer counted
        change = np.where(at > 0, to - 2 * at + 1, np.iinfo(np.int64).max)
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        return best + 1 if change[best] <= 2 * self.level[n] + 1 else 0

    def place(self, piece: tuple) -> None:
        n = len(piece[2])
        h = self.choose(n)
        pieces: list = []
        if h:
            pieces = self.windows[h].pop()
            self.level[h] -= 1
        pieces.append(piece)
        self.held += n
        if h + n == self.size:
            self.close(pieces)
            self.held -= self.size
        else:
            self.windows[h + n].append(pieces)
            self.level[h + n] += 1

    def close(self, pieces: list) -> None:
        sequence, offset = self.new_id(), 0
        for piece in pieces:
            self.emit(sequence, offset, piece)
            offset += len(piece[2])

    def add(self, doc, ids: np.ndarray) -> None:
        total, full = len(ids), len(ids) // self.size
        for k in range(full):
            self.emit(self.new_id(), 0, (doc, k * self.size, ids[k * self.size : (k + 1) * self.size], total))
        if total % self.size:
            rest = ids[full * self.size :]
            self.place((doc, full * self.size, rest.copy() if full else rest, total))  # a view would hold the whole document
        if self.held >= self.open_tokens:
            self.flush()

    def flush(self) -> None:
        """Cut what is open into full windows, and the rest into powers of two."""
        queue = [p for level in range(self.size, 0, -1) for pieces in self.windows[level] for p in pieces]
        left = sum(len(p[2]) for p in queue)
        queue.reverse()
        while left:
            room = self.size if left >= self.size else 1 << (left.bit_length() - 1)
            sequence, offset = self.new_id(), 0
            left -= room
            while room:
                doc, start, ids, total = queue.pop()
                take = min(room, len(ids))
                self.emit(sequence, offset, (doc, start, ids[:take], total))
                if take < len(ids):
                    queue.append((doc, start + take, ids[take:], total))
                offset, room = offset + take, room - take
        self.level[:] = 0
        self.windows = [[] for _ in range(self.size + 1)]
        self.held = 0


def pack(
    docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, size: int = 2048, open_tokens: int = 1 << 22, end: int = END,
) -> DataFrame:
    """One row for each piece of a document in a sequence of at most ``size`` tokens.

    ``sequence_id`` is the task's number times 2**36 plus a count; ``offset`` is gapless from 0 in a
    sequence. ``open_tokens`` bounds the memory of a task, not what it packs.
    """
    docs = docs.select("doc_id", "text")
    schema = PIECES.format(id=docs.schema["doc_id"].dataType.simpleString())
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = byte_bpe(tokenizer_path, ranks_path)
        packer = Packer(size, TaskContext.get().partitionId() << 36, open_tokens)
        ids_type = None

        def drain() -> Iterator[pa.RecordBatch]:
            if packer.done:
                rows, packer.done = packer.done, []
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], type=ids_type)] + [pa.array(c, type=pa.int64()) for c in columns[1:]], names=names)

        for batch in batches:
            ids_type = batch.schema.field("doc_id").type
            for doc, text in zip(column(batch, "doc_id"), batch.column(batch.schema.get_field_index("text"))):
                text = text.as_py()
                ids = tokens.encode(text) if text else np.zeros(0, dtype="<u4")
                packer.add(doc, np.append(ids, np.uint32(end)).astype("<u4", copy=False))
                if len(packer.done) >= 20_000:
                    yield from drain()
        packer.flush()
        yield from drain()

    return docs.mapInArrow(giving_back(run), schema)
