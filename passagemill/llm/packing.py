"""Operator 4, cost-balanced packing of documents into sequences.

The cost of a piece of n tokens is estimated as LINEAR * n + QUADRATIC * n * n (dense
layers, attention within the piece). Documents are tokenized where they are read and
packed in windows of about ``window`` tokens, so nothing is shuffled and the memory of a
task is that of one window. In a window, full sequences are cut from long documents;
what remains is assigned in descending order to the sequence of lowest cost with room
for it. Only where no sequence has room, a piece is cut. The sequences of a window hold
exactly its tokens: the last tokens get sequences of 512, 256 ... 1, so no padding is left.

Edge cases: null and empty texts have one token (the end id); a null doc_id is packed and
kept null; documents of any length are cut; an empty table gives no piece. Repeated rows
are packed each for itself. Sequence ids are unique: partition * 2^33 + number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import tokens

LINEAR, QUADRATIC = 12.0, 1.0 / 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(n: float) -> float:
    return LINEAR * n + QUADRATIC * n * n


def pack(lengths: list[int], room: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; lengths are of whole documents."""
    pieces, rest, sequences = [], [], 0
    for doc, n in enumerate(lengths):
        for start in range(0, n - room + 1, room):
            pieces.append((doc, start, room, sequences, 0))
            sequences += 1
        if n % room:
            rest.append((n % room, doc, n - n % room))
    total = sum(n for n, _, _ in rest)
    sizes = [room] * (total // room)
    tail = total % room
    sizes += [1 << k for k in range(tail.bit_length() - 1, -1, -1) if tail >> k & 1]
    free, load = np.array(sizes, dtype=np.int64), np.zeros(len(sizes))
    filled = np.zeros(len(sizes), dtype=np.int64)
    for n, doc, start in sorted(rest, key=lambda x: (-x[0], x[1])):
        while n:
            fits = np.flatnonzero(free >= n)
            if len(fits):
                k = int(fits[np.argmin(load[fits])])
            else:  # cut: the roomiest sequence takes what it can
                k = int(np.argmax(free))
            part = min(n, int(free[k]))
            pieces.append((doc, start, part, sequences + k, int(filled[k])))
            filled[k] += part
            free[k] -= part
            load[k] += cost(part)
            n, start = n - part, start + part
    return pieces


def pack_documents(docs: DataFrame, tokenizer: str, room: int = 1024, end_id: int = 0, window: int = 1 << 18) -> DataFrame:
    """One row a piece. tokenizer: the path of a tokenizer file, found on every executor."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer).encode
        base, count = TaskContext.get().partitionId() << 33, 0
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal count, size
            pieces = pack([len(b) // 4 for _, b in held], room)
            cols = [
                [held[d][0] for d, *_ in pieces], [s for _, s, *_ in pieces], [n for _, _, n, *_ in pieces],
                [zlib.crc32(held[d][1][4 * s : 4 * (s + n)]) for d, s, n, *_ in pieces], [len(held[d][1]) // 4 for d, *_ in pieces],
                [base + count + q for *_, q, _ in pieces], [o for *_, o in pieces],
            ]
            count += max(q for *_, q, _ in pieces) + 1
            held.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                b = encode(texts[i].as_py()) + end
                held.append((ids[i].as_py(), b))
                size += len(b) // 4
                if size >= window:
                    yield flush()
        if held:
            yield flush()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
