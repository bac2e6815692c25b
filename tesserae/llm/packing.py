"""Packing of token streams by order-preserving dynamic programming.

Documents keep their order. A window (a sequence) is a run of the stream of at most LENGTH tokens. It may end
at a document's end for nothing, at a sentence's end for a small penalty, and elsewhere only where sentences are
long, for a larger one. A window costs its padded length, which is LENGTH, or its own if that is a power of two, and SEQUENCE_COST.
The cheapest way to reach a cut is the least cost within LENGTH tokens before it, kept in a monotone queue,
so a stream takes time in proportion to its cuts. Streams are dealt to tasks by ranges of doc_id and solved
in blocks of about BLOCK tokens, which bounds memory; a block's last window may be split into powers of two.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.llm import tokens

LENGTH = 4096
BLOCK = 1 << 20
# What a cut costs, in tokens of padding; and what a sequence costs besides its length, so short ones stay rare.
SENTENCE_COST, ANYWHERE_COST, SEQUENCE_COST = 16, 64, 1024
# Sentence ends nearer than this to the cut before are passed over; stretches without a cut get one this often.
NEAREST, STRIDE = 24, 128
SEQUENCE_BITS = 33

DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in DDL.split(", ")]


def sentence_ends(path: str) -> np.ndarray:
    """True for the ids whose token ends a word with a full stop, an exclamation or a question mark."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    marks = np.zeros(max(vocabulary.values()) + 1, bool)
    for token, number in vocabulary.items():
        if token.endswith("</w>") and token[:-4].rstrip("\"')")[-1:] in (".", "!", "?"):
            marks[number] = True
    return marks


def candidates(ids: np.ndarray, ends: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, and what each costs. ends: where documents end; the last is len(ids)."""
    sentences = np.flatnonzero(marks[np.minimum(ids, len(marks) - 1)]) + 1
    # Of sentence ends, the first in each stretch of NEAREST tokens.
    sentences = sentences[np.diff(sentences // NEAREST, prepend=-1) > 0]
    at = np.union1d(ends, sentences)
    gaps = np.diff(at, prepend=0)
    long = np.flatnonzero(gaps > STRIDE)
    if len(long):
        fill = [np.arange(at[i] - gaps[i] + STRIDE, at[i], STRIDE) for i in long.tolist()]
        at = np.union1d(at, np.concatenate(fill))
    cost = np.full(len(at), ANYWHERE_COST, np.int64)
    cost[np.isin(at, sentences, assume_unique=True)] = SENTENCE_COST
    cost[np.isin(at, ends, assume_unique=False)] = 0
    return at, cost


def cut(at: np.ndarray, cost: np.ndarray, length: int = LENGTH) -> list[int]:
    """Ends of the cheapest windows over the stream [0, at[-1]), which may end at the places at only."""
    n = len(at)
    places, costs = [0, *at.tolist()], [0, *cost.tolist()]
    all_at = np.concatenate([[0], at])
    # Places a power of two before each place: windows without padding.
    exact: dict[int, list[tuple[int, int]]] = {}
    power = 1
    while power <= length:
        j = np.searchsorted(all_at, all_at - power)
        hit = np.flatnonzero((all_at >= power) & (all_at[np.minimum(j, n)] == all_at - power))
        for i, k in zip(hit.tolist(), j[hit].tolist(), strict=True):
            exact.setdefault(i, []).append((k, power))
        power *= 2
    best, back = [0] * (n + 1), [0] * (n + 1)
    queue: deque[int] = deque([0])  # places within reach, their costs rising
    for i in range(1, n + 1):
        here = places[i]
        while places[queue[0]] < here - length:
            queue.popleft()
        j = queue[0]
        least = best[j] + length
        for k, padded in exact.get(i, ()):
            if best[k] + padded < least:
                least, j = best[k] + padded, k
        least += costs[i] + SEQUENCE_COST
        best[i], back[i] = least, j
        while queue and best[queue[-1]] >= least:
            queue.pop()
        queue.append(i)
    out = []
    i = n
    while i:
        out.append(places[i])
        i = back[i]
    return out[::-1]


def windows(ids: np.ndarray, ends: np.ndarray, marks: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Where windows end. The last may be split into powers of two, if that costs less than its padding."""
    found = cut(*candidates(ids, ends, marks), length)
    begin = found[-2] if len(found) > 1 else 0
    rest = found[-1] - begin
    if rest & (rest - 1) and rest + (rest.bit_count() - 1) * ANYWHERE_COST < length:
        parts = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        found = found[:-1] + (begin + np.cumsum(parts)).tolist()
    return np.array(found, np.int64)


class _Block:
    """Documents of a shard until they make a block; each (doc_id, ids) is whole."""

    def __init__(self) -> None:
        self.doc_ids: list = []
        self.ids: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.ids.append(ids)
        self.size += len(ids)


def packed(doc_ids: list, texts: list[np.ndarray], marks: np.ndarray, first: int, length: int = LENGTH) -> tuple[dict[str, list], int]:
    """Pieces of these documents (each with its end id, so none is empty), and how many windows they fill."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ids, ends = np.concatenate(texts), np.cumsum(sizes)
    stops = windows(ids, ends, marks, length)
    bounds = np.union1d(ends, stops)
    begins = np.concatenate([[0], bounds[:-1]])
    doc = np.searchsorted(ends, begins, "right")
    window = np.searchsorted(stops, begins, "right")
    window_start = np.concatenate([[0], stops[:-1]])[window]
    return {
        "doc_id": [doc_ids[d] for d in doc.tolist()],
        "start": begins - (ends - sizes)[doc],
        "length": bounds - begins,
        "ids_crc32": [tokens.crc32(ids[a:b]) for a, b in zip(begins.tolist(), bounds.tolist(), strict=True)],
        "doc_tokens": sizes[doc],
        "sequence_id": first + window,
        "offset": begins - window_start,
    }, len(stops)


def pack(docs: DataFrame, path: str, length: int = LENGTH, block: int = BLOCK, end_id: int = tokens.END_ID) -> DataFrame:
    """A row for each piece: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens (with the
    end id), sequence_id, offset (in its sequence, without gaps).

    Every text is packed whole, in ascending doc_id order within a task's range of ids; a null text is empty and
    gives its end id alone. Of sentence ends nearer than NEAREST tokens to each other the first is a place to cut at; the
    cuts are the cheapest over these places, and every id lies in one piece. Null and repeated ids are documents of their own. sequence_id is the task's number
    times 2 to the power SEQUENCE_BITS plus a count, so tasks need not wait for each other. Other columns are not
    read; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << SEQUENCE_BITS
        own, marks, held = tokens.encoder(path), sentence_ends(path), _Block()

        def solved() -> pa.RecordBatch:
            nonlocal first, held
            out, n = packed(held.doc_ids, held.ids, marks, first, length)
            first += n
            held = _Block()
            return pa.RecordBatch.from_arrays([pa.array(out[c], pa.int64()) for c in NAMES], NAMES)

        for whole in batches:
            for batch in tokens.pieces(whole, 1):
                ids, bounds = tokens.with_end(*own.encode(batch.column(1)), end_id)
                for i, doc_id in enumerate(batch.column(0).to_pylist()):
                    held.add(doc_id, ids[bounds[i] : bounds[i + 1]].copy())
                    if held.size >= block:
                        yield solved()
        if held.doc_ids:
            yield solved()

    return tokens.in_order(docs).mapInArrow(run, DDL)
