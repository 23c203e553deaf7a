"""SentencePiece encoding and decoding with a distinct-chunk table.

The model marks a space as U+2581 and puts one mark before the text. No piece of
the model has a mark behind another character (checked when the model is loaded),
so no merge crosses the boundary before a run of marks: the marked text falls apart
into chunks, each a run of marks and the other characters behind it, that are
segmented on their own. Each distinct chunk goes to the library once; its ids are
joined back to every position where the chunk stands. Decoding works the same way
over the distinct chunk table.

The table is built where the text is: per task over batches, and started anew once it
holds ``TABLE_CHUNKS`` chunks, which bounds memory and changes no result. Joining a
table of the whole corpus back would shuffle every position of every text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
#: Chunks held by a task at most, and the characters of them.
TABLE_CHUNKS = 600_000
TABLE_CHARS = 12_000_000
#: Characters segmented at once; results are the same for any number.
BLOCK_CHARS = 1 << 20

_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
_BOUNDARY = re.compile(f"[^{MARK}]{MARK}")


def load_processor(model_path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path)


def can_split(processor) -> bool:
    """Whether chunks are independent: marks in pieces only lead, a space is kept as
    one mark, and the dummy mark is put before the text."""
    inner = re.compile(f"[^{MARK}]{MARK}")
    if any(inner.search(processor.id_to_piece(i)) for i in range(processor.get_piece_size())):
        return False
    probe = ["a", "a b", "a  b", " a", "a ", "A\tb", "ﬁ x", "é y", "a\n b"]
    return all(processor.decode(processor.encode(p)) == p for p in probe)


class ChunkTable:
    """Distinct chunks with their ids and decoded text."""

    def __init__(self, processor):
        self.processor = processor
        if not can_split(processor):
            raise ValueError("pieces of this model can cross white-space marks")
        self.bos, self.eos = processor.bos_id(), processor.eos_id()
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.empty(0, np.uint32)
        self.first = np.zeros(1, np.int64)
        self.text: list[str] = []
        self.chars = 0

    def _segment(self, new: list[str]) -> None:
        # the library puts one mark before what it encodes (not before an empty text),
        # so a chunk is given without its first mark
        found = self.processor.encode([c[1:].replace(MARK, " ") for c in new], num_threads=1)
        decoded = self.processor.decode(found)
        if MARK in new:
            at = new.index(MARK)
            found[at], decoded[at] = [self.processor.piece_to_id(MARK)], ""
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        self.chars += sum(map(len, new))
        self.ids = np.concatenate([self.ids, flat])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(lengths)])
        # decoding drops the first mark of a text; here each chunk keeps it
        self.text += [" " + t for t in decoded]

    def positions(self, chunks: list[str]) -> np.ndarray:
        """Table index of every chunk; new chunks are segmented first, each once."""
        if len(self.index) > TABLE_CHUNKS or self.chars > TABLE_CHARS:
            self._clear()
        at = list(map(self.index.get, chunks))
        if None in at:
            missing = [i for i, x in enumerate(at) if x is None]
            self._segment(list(dict.fromkeys(chunks[i] for i in missing)))
            for i in missing:
                at[i] = self.index[chunks[i]]
        return np.array(at, np.int64)

    def gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of the chunks at these table positions, in order."""
        start, length = self.first[at], self.first[at + 1] - self.first[at]
        if not len(at):
            return np.empty(0, np.uint32)
        ends = np.cumsum(length)
        return self.ids[np.arange(ends[-1]) + np.repeat(start - (ends - length), length)]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str]]:
        """Per text: all its ids with begin and end, and the text that decoding gives."""
        waiting: list[list[list[str]]] = []
        size = 0
        for text in texts:
            pieces = [_CHUNK.findall(p) for p in marked_pieces(text)]
            waiting.append(pieces)
            size += len(text)
            if size >= BLOCK_CHARS:
                yield from self._flush(waiting)
                waiting, size = [], 0
        yield from self._flush(waiting)

    def _flush(self, waiting: list[list[list[str]]]) -> Iterator[tuple[np.ndarray, str]]:
        if not waiting:
            return
        if all(len(p) <= 1 for p in waiting):  # short texts: one lookup for all of them
            at = self.positions([c for p in waiting for chunks in p for c in chunks])
            ends = np.cumsum([sum(map(len, p)) for p in waiting])
            parts = [[x] for x in np.split(at, ends[:-1])]
            yield from (self._joined([(self.gather(a), map(self.text.__getitem__, a.tolist())) for a in p]) for p in parts)
            return
        for pieces in waiting:
            found = []
            for chunks in pieces:
                at = self.positions(chunks)
                found.append((self.gather(at), list(map(self.text.__getitem__, at.tolist()))))
            yield self._joined(found)

    def _joined(self, found: list[tuple[np.ndarray, Iterable[str]]]) -> tuple[np.ndarray, str]:
        ids = [np.array([self.bos], np.uint32), *(f[0] for f in found), np.array([self.eos], np.uint32)]
        return np.concatenate(ids), "".join("".join(f[1]) for f in found)[1:]


def marked_pieces(text: str) -> Iterator[str]:
    """The marked text in pieces of about ``BLOCK_CHARS`` that end before a run of marks."""
    if not text:
        return
    marked = MARK + text.replace(" ", MARK)
    lo = 0
    while len(marked) - lo > BLOCK_CHARS:
        hi = _BOUNDARY.search(marked, lo + BLOCK_CHARS)
        if not hi:
            break
        yield marked[lo: hi.start() + 1]
        lo = hi.start() + 1
    yield marked[lo:]


def encode_documents(docs: DataFrame, model_path: str, with_ids: bool = True, with_text: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row of ``docs``
    (``doc_id, text``), by default its ``ids``, and on request the ``decoded`` text.

    ``model_path`` must exist on every executor, as the installed tokenizer package
    does. A null text counts as empty: begin and end id only, decoded ''. Rows that
    repeat give a row each. An empty table gives no rows. Any length of text is
    encoded whole."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>"
    if with_text:
        schema += ", decoded string"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(load_processor(model_path))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
                for ids, decoded in table.encode([t or "" for t in part.column(1).to_pylist()]):
                    out["n_tokens"].append(len(ids))
                    out["ids_sha256"].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_ids:
                        out["ids"].append(ids.astype(np.int32))
                    if with_text:
                        out["decoded"].append(decoded)
                columns = [part.column(0), pa.array(out["n_tokens"], pa.int64()), pa.array(out["ids_sha256"], pa.string()), pa.array(out["decoded_sha256"], pa.string())]
                if with_ids:
                    columns.append(pa.array(out["ids"], pa.list_(pa.int32())))
                if with_text:
                    columns.append(pa.array(out["decoded"], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(encode, schema)
