"""Fill-in-middle transformation by piece tables.

A document is a list of descriptors ``(buffer, start, length)`` over two buffers that never change: its text and the
sentinels.  Cutting a text splits descriptors, an arrangement permutes them and puts sentinels between, the inverse
permutation restores the text, and digests run over the descriptors, so that no arrangement is ever joined to a new text
before it is written out.  Documents are independent of each other: one pass, nothing is shuffled, and a task holds one
Arrow batch and its output.

Defined results: a null or empty text is plain, and so is one that contains a sentinel, with ``n`` units all the same; a null
id draws as the empty string; repeated rows give the same result each; texts of any length are cut whole; extra columns are
ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.shared import as_text

PREFIX, MIDDLE, SUFFIX = 0, 1, 2
#: The sentinel in front of each part, and the order of the parts in each form.
SENTINELS = {PREFIX: b"<P>", SUFFIX: b"<S>", MIDDLE: b"<M>"}
FORMS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
SEED, FIM_PERCENT, SPM_PERCENT = 7, 100, 50
ARRANGED = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, output_sha256 string"
RESTORED = "doc_id bigint, restored string, restored_sha256 string"
FLUSH = 1 << 25

TEXT, SENTINEL = 0, 1
SENTINEL_BUFFER = memoryview(b"".join(SENTINELS.values()))
SENTINEL_AT = dict(zip(SENTINELS, np.cumsum([0, *map(len, SENTINELS.values())]).tolist()))


class Pieces:
    """A piece table: descriptors over an immutable text and the sentinels."""

    def __init__(self, text: memoryview, descriptors: list[tuple[int, int, int]] | None = None) -> None:
        self.buffers = (text, SENTINEL_BUFFER)
        self.descriptors = [(TEXT, 0, len(text))] if descriptors is None else descriptors

    def cut(self, *places: int) -> list[Pieces]:
        """The parts before, between and behind ascending places; a descriptor that spans a place is split there."""
        parts: list[list] = [[]]
        at, left = 0, list(places)
        for buffer, start, length in self.descriptors:
            while left and left[0] <= at + length:
                head = left.pop(0) - at
                parts[-1].append((buffer, start, head))
                parts.append([])
                start, length, at = start + head, length - head, at + head
            parts[-1].append((buffer, start, length))
            at += length
        parts += [[] for _ in left]
        return [Pieces(self.buffers[TEXT], [d for d in p if d[2]]) for p in parts]

    @staticmethod
    def joined(text: memoryview, parts: list[Pieces]) -> Pieces:
        return Pieces(text, [d for p in parts for d in p.descriptors])

    def stream(self) -> Iterator[memoryview]:
        for buffer, start, length in self.descriptors:
            yield self.buffers[buffer][start:start + length]

    def digest(self) -> str:
        h = hashlib.sha256()
        for piece in self.stream():
            h.update(piece)
        return h.hexdigest()

    def chars(self) -> int:
        """Code points: the bytes that do not continue one."""
        return sum(int(np.count_nonzero(np.frombuffer(p, np.uint8) & 0xC0 != 0x80)) for p in self.stream())


def sentinel(part: int) -> Pieces:
    return Pieces(memoryview(b""), [(SENTINEL, SENTINEL_AT[part], len(SENTINELS[part]))])


def arrange(text: memoryview, parts: list[Pieces], form: str) -> Pieces:
    """The parts in the form's order, each behind its sentinel."""
    return Pieces.joined(text, [x for part in FORMS[form] for x in (sentinel(part), parts[part])])


def restore(output: memoryview, form: str) -> Pieces:
    """The text as a table over the output: cut at its sentinels, drop these, undo the permutation.

    A text with a sentinel in it is never arranged, and no sentinel ends as another begins: the first match is the sentinel.
    """
    if form == "plain":
        return Pieces(output)
    order, data, places, at = FORMS[form], bytes(output), [], 0
    for part in order:
        begin = data.index(SENTINELS[part], at)
        at = begin + len(SENTINELS[part])
        places += [begin, at]
    parts = Pieces(output).cut(*places)[2::2]  # what stands behind each sentinel
    inverse = sorted(range(len(order)), key=lambda i: order[i])
    return Pieces.joined(output, [parts[i] for i in inverse])


def values(column: pa.Array) -> tuple[memoryview, list[int]]:
    """The column's bytes and the offsets of its rows in them."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    return memoryview(column.buffers()[2] or b""), offsets.tolist()


class Rows:
    """Finished rows; a string column is given as piece tables and written once, when the batch is full."""

    def __init__(self, schema: str) -> None:
        self.columns = [tuple(c.split()) for c in schema.split(", ")]
        self.rows, self.bytes = [], 0

    def add(self, *row) -> None:
        self.rows.append(row)
        self.bytes += 256 + sum(d[2] for x in row if isinstance(x, Pieces) for d in x.descriptors)

    def batch(self) -> pa.RecordBatch:
        arrays = []
        for (name, kind), column in zip(self.columns, zip(*self.rows)):
            if any(isinstance(x, Pieces) for x in column):
                texts = pa.array([b"".join(x.stream()) for x in column], pa.binary())
                arrays.append(texts.view(pa.string()))
            else:
                arrays.append(pa.array(column, pa.int64() if kind == "bigint" else pa.string()))
        self.rows, self.bytes = [], 0
        return pa.RecordBatch.from_arrays(arrays, names=[c[0] for c in self.columns])


def transform(docs: DataFrame, id: str = "doc_id", text: str = "text", seed: int = SEED, fim_percent: int = FIM_PERCENT,
              spm_percent: int = SPM_PERCENT) -> DataFrame:
    """One row per document: ``doc_id, n, form, prefix_chars, middle_chars, output, output_sha256``.

    ``n`` counts lines, each with its line feed.  Four draws from the digest of ``seed:id`` choose both cuts, whether the text
    is arranged (``fim_percent``) and its form (``spm_percent``; the rest is psm).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(ARRANGED)
        for b in batches:
            data, at = values(b.column(1))
            for i, key in enumerate(b.column(0).to_pylist()):
                own = data[at[i]:at[i + 1]]
                feeds = np.flatnonzero(np.frombuffer(own, np.uint8) == 10) + 1
                ends = [0, *feeds.tolist()] if not len(own) or (len(feeds) and feeds[-1] == len(own)) else [0, *feeds.tolist(), len(own)]
                n = len(ends) - 1
                h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
                h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
                whole = bytes(own)
                if not n or h3 % 100 >= fim_percent or any(s in whole for s in SENTINELS.values()):
                    table, form, chars = Pieces(own), "plain", (None, None)
                else:
                    form = "spm" if h4 % 100 < spm_percent else "psm"
                    parts = Pieces(own).cut(*(ends[k] for k in sorted((h1 % (n + 1), h2 % (n + 1)))))
                    table, chars = arrange(own, parts, form), (parts[PREFIX].chars(), parts[MIDDLE].chars())
                out.add(key, n, form, *chars, table, table.digest())
                if out.bytes >= FLUSH:
                    yield out.batch()
            if out.rows:
                yield out.batch()

    return docs.select(F.col(id).cast("bigint"), as_text(text).cast("binary")).toDF("id", "text").mapInArrow(run, ARRANGED)


def restored(arranged: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, restored, restored_sha256`` of each row, rebuilt from ``form`` and ``output`` alone, with the columns
    ``carry`` (numbers or strings)."""
    kinds = dict(arranged.dtypes)
    schema = ", ".join([RESTORED, *(f"{c} {kinds[c]}" for c in carry)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for b in batches:
            data, at = values(b.column(2))
            rest = [c.to_pylist() for c in b.columns[3:]]
            for i, (key, form) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                table = restore(data[at[i]:at[i + 1]], form)
                out.add(key, table, table.digest(), *(c[i] for c in rest))
                if out.bytes >= FLUSH:
                    yield out.batch()
            if out.rows:
                yield out.batch()

    return arranged.select("doc_id", "form", F.col("output").cast("binary"), *carry).mapInArrow(run, schema)
