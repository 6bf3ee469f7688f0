"""Harmonic packing of token sequences.

A document (its ids, then the end id) is cut into pieces, and pieces of the reciprocal-capacity class ``k``, that is of a
length in ``(C / (k + 1), C / k]``, fill bins of exactly ``k`` pieces.  Cuts are chosen so that bins come out full: as many
pieces of ``C`` as there are, then halves, quarters and so on down to ``C / 16`` (each at most once), and the tail shorter
than that goes to its own class uncut, ``k >= 16``, where a bin lacks some ``1 / k`` of its room at most.

Every task packs what it reads, with one open bin per class and no shuffle: memory is bounded by the open bins.  What is
left in open bins at the end of a task shares bins by first fit, longest first.  A sequence id is the task's partition and
a count, so a task that runs again returns the same rows.

Defined results: a null text counts as empty and has the end id alone; a null id is returned as it is; repeated rows are
packed as documents of their own; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.shared import as_text, in_arrow

CAPACITY, END, HALVINGS = 2048, 1, 4
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


@cache
def encoder(vocabulary: str, pattern: str | None):
    """``encode(text) -> uint32 ids``.  A ``.json`` file is read by tokenizers; a ``.tiktoken`` file holds the same kind of
    vocabulary as ranks and is some four times as fast."""
    if vocabulary.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    return lambda text: own.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


def cuts(n: int, capacity: int = CAPACITY, halvings: int = HALVINGS) -> list[int]:
    """Lengths of a document's pieces: capacities, then falling halves of it, then a tail shorter than the smallest half."""
    out = [capacity] * (n // capacity)
    n %= capacity
    for i in range(1, halvings + 1):
        if n >= (half := capacity >> i):
            out.append(half)
            n -= half
    return out + [n] * (n > 0)


class Bins:
    """The open bins of one task, one per class."""

    def __init__(self, capacity: int, partition: int) -> None:
        self.capacity, self.next, self.open, self.rows = capacity, partition << 33, {}, []

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for piece in pieces:
            self.rows.append((*piece, self.next, offset))
            offset += piece[2]
        self.next += 1

    def add(self, piece: tuple) -> None:
        k = self.capacity // piece[2]
        pieces = self.open.setdefault(k, [])
        pieces.append(piece)
        if len(pieces) == k:
            self.close(self.open.pop(k))

    def finish(self) -> None:
        shared: list[list] = []  # [room, pieces]
        for piece in sorted((p for pieces in self.open.values() for p in pieces), key=lambda p: -p[2]):
            to = next((b for b in shared if b[0] >= piece[2]), None)
            if to is None:
                shared.append(to := [self.capacity, []])
            to[0] -= piece[2]
            to[1].append(piece)
        for _, pieces in shared:
            self.close(pieces)
        self.open = {}


def pack(docs: DataFrame, vocabulary: str, pattern: str | None = None, id: str = "doc_id", text: str = "text",
         capacity: int = CAPACITY, end: int = END, ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``, little-endian
    unsigned 32-bit integers, where ``ids`` is set).  A sequence's pieces have gapless offsets from 0."""
    schema = SCHEMA + (", ids binary" if ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.binary()] * ids

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * ids, "sequence_id", "offset"), zip(*rows)))
        return pa.RecordBatch.from_arrays([pa.array(cols[n], k) for n, k in zip(names, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins = encoder(vocabulary, pattern), Bins(capacity, TaskContext.get().partitionId())
        for b in batches:
            for key, doc in zip(b.column(0).to_pylist(), b.column(1)):
                tokens = np.append(encode(doc.as_py()), np.array([end], dtype="<u4"))
                data, at = tokens.tobytes(), 0
                for length in cuts(len(tokens), capacity):
                    part = data[4 * at:4 * (at + length)]
                    bins.add((key, at, length, zlib.crc32(part), len(tokens), *[part] * ids))
                    at += length
                if len(bins.rows) >= 8192:
                    yield batch(bins.rows)
                    bins.rows = []
        bins.finish()
        if bins.rows:
            yield batch(bins.rows)

    return in_arrow(docs.select(F.col(id).cast("bigint").alias("doc_id"), as_text(text).alias("text")), run, schema)
