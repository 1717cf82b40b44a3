"""Sum-of-squares online packing of tokenized documents into training windows.

Each partition is packed by itself, in the order it is read, so there is no shuffle and a
lost task is packed again to the same windows. Within a partition a level array ``count[h]``
has the number of open windows filled to ``h`` tokens. A document of ``s`` tokens goes to the
level ``h`` (0: a new window) where the sum of the squared counts grows least. Documents longer
than a window give whole windows first; the rest is placed.

At the end of a partition, or once ``max_open`` windows are open, the windows still open are
closed: pieces of the emptiest windows are cut to fill the fullest ones, and the tokens left
at last form windows whose lengths are powers of two, which need no padding.

Null texts count as empty: one token, the separator. Repeated rows and ids are packed as often
as they occur. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonecrop.llm.common import parts, strings

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Windows a partition may hold open; 4096 windows of 1024 four-byte ids are 16 MB.
MAX_OPEN = 4096
#: Sequence ids of partition p are p * 2**36 and up.
PARTITION_SHIFT = 36


class Tokenizer:
    """Ids of the byte-level BPE in a tokenizer file.

    ``ranks``, the same vocabulary as ranks, encodes texts of ASCII and Latin letters, where every regex
    engine agrees on what letters, digits and white space are; it is several times as fast. Other texts,
    those that hold a string the file has an added token for, and all texts without ``ranks``, go to the
    library of the file, so the ids are always those of its plain call.
    """

    def __init__(self, path: str, ranks: str | None, pattern: str | None) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.fast = None
        if ranks:
            import base64

            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            self.fast = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        added = [re.escape(x.content) for x in self.library.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join(["[^\t\n\r\x20-\x7e\xa1-\u024f]", *added])).search

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or self.odd(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=())


class Packer:
    """Places documents into windows; ``out`` gets (doc, start, ids, tokens of the document, sequence, offset)."""

    def __init__(self, window: int, first_sequence: int, max_open: int = MAX_OPEN) -> None:
        self.window, self.next, self.max_open = window, first_sequence, max_open
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]
        self.n_open = 0
        self.out: list[tuple] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        w, n = self.window, len(ids)
        whole = n - n % w
        for a in range(0, whole, w):
            self.emit([(doc, a, ids[a : a + w], n)])
        if whole < n:
            self.place((doc, whole, ids[whole:], n))

    def place(self, piece: tuple) -> None:
        w, s, c = self.window, len(piece[2]), self.count
        # N(h) -> N(h) - 1 and N(h + s) -> N(h + s) + 1; a full window isn't counted, nor is an empty one
        gain = 2 * c[s : w + 1] + 1
        gain[w - s] = 0
        gain[1:] += 1 - 2 * c[1 : w - s + 1]
        gain[1:][c[1 : w - s + 1] == 0] = np.iinfo(np.int64).max
        # of equal levels the fullest: argmin of the reversed array
        h = w - s - int(np.argmin(gain[::-1]))
        pieces = [piece]
        if h:
            pieces = self.open[h].pop()
            pieces.append(piece)
            c[h] -= 1
            self.n_open -= 1
        if h + s == w:
            self.emit(pieces)
        else:
            self.open[h + s].append(pieces)
            c[h + s] += 1
            self.n_open += 1
            if self.n_open > self.max_open:
                self.close()

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, n in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), n, self.next, offset))
            offset += len(ids)
        self.next += 1

    def close(self) -> None:
        """Fill the fullest windows with pieces cut from the emptiest ones; the last tokens by powers of two."""
        left = [(level, pieces) for level in range(self.window) for pieces in self.open[level]]
        self.open, self.n_open = [[] for _ in range(self.window)], 0
        self.count[:] = 0
        spare: list[tuple] = []
        low, high = 0, len(left) - 1
        while low <= high:
            level, pieces = left[high]
            high -= 1
            need = self.window - level
            while need and (spare or low <= high):
                if not spare:
                    spare = left[low][1][::-1]
                    low += 1
                doc, start, ids, n = spare.pop()
                if len(ids) > need:
                    spare.append((doc, start + need, ids[need:], n))
                    ids = ids[:need]
                pieces.append((doc, start, ids, n))
                need -= len(ids)
            if need:
                spare = pieces[::-1]
                break
            self.emit(pieces)
        total = sum(len(x[2]) for x in spare)
        while total:
            if total >= self.window:
                size = self.window
            else:
                size = 1 << (total.bit_length() - 1)
            total -= size
            pieces = []
            while size:
                doc, start, ids, n = spare.pop()
                if len(ids) > size:
                    spare.append((doc, start + size, ids[size:], n))
                    ids = ids[:size]
                pieces.append((doc, start, ids, n))
                size -= len(ids)
            self.emit(pieces)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, tokenizer: str | None = None, ranks: str | None = None, pattern: str | None = None, separator: int = 0, max_open: int = MAX_OPEN) -> DataFrame:
    """One row per piece of a document, as in ``SCHEMA``.

    ``tokenizer`` is the path of a byte-level BPE file, ``ranks`` that of the same vocabulary as ranks and ``pattern`` its
    splitting pattern; by default the public 50k one. Each document ends with ``separator``.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        from pyspark import TaskContext

        task = TaskContext.get()
        packer = Packer(window, (task.partitionId() if task else 0) << PARTITION_SHIFT, max_open)
        encoder = Tokenizer(tokenizer, ranks, pattern) if tokenizer else Tokenizer(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
        end = np.array([separator], "<u4")
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def flush() -> Iterator[pa.RecordBatch]:
            if packer.out:
                columns, packer.out = zip(*packer.out, strict=True), []
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in parts(batches):
            for doc, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                packer.add(doc, np.concatenate([encoder.encode(text), end]))
            yield from flush()
        packer.close()
        yield from flush()

    return rows.mapInArrow(run, SCHEMA)
