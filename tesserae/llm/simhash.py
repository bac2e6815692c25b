"""Near-duplicate documents by SimHash fingerprints and deletion-variant signatures.

A fingerprint is cut into three segments, so of two that differ in at most four bits one segment differs
in at most one. Each segment is indexed once for each of its bits with that bit wild; equal variants meet in
an equality shuffle, and whole fingerprints are compared there. Only distinct fingerprints are indexed, so
copies cost one row, and each group of variants yields a spanning forest of its links, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import bounded, components, release, skewed_join, written

WORDS, SEED, MAX_BITS = 4, 42, 4
SEGMENTS = ((0, 21), (21, 21), (42, 22))
# Variants of more rows than this are compared block by block in tasks of their own.
HOT_ROWS = 32_768
BROADCAST_KEYS = 1_000_000


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """Of one text; zero if it has no word."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    digest = xxhash.xxh64_intdigest
    if len(w) < words:
        hashes = [digest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, w), np.int64, len(w))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(w) - words + 1].tolist()
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    total = np.zeros(64, np.int64)
    octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(octets), 65_536):
        total += np.unpackbits(octets[at : at + 65_536], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        found = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long); one row for each row of docs."""
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def variants(distinct: DataFrame) -> DataFrame:
    """key, fp: for each fingerprint and bit, the bit's segment without it."""
    keys, number = [], 0
    for at, width in SEGMENTS:
        segment = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            keys.append(segment.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << bit))).bitwiseOR(F.lit(number << 22)))
            number += 1
    return distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _forest(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among rows with one key (key is sorted)."""
    n = len(key)
    label = np.arange(n)
    out_a, out_b = [], []
    at, step = np.arange(n), 1
    while True:
        at = at[at + step < n]
        at = at[key[at] == key[at + step]]
        if not len(at):
            break
        near = at[(label[at] != label[at + step]) & (np.bitwise_count(fp[at] ^ fp[at + step]) <= MAX_BITS)]
        for a in near.tolist():
            x, y = a, a + step
            while label[x] != x:
                x = label[x]
            while label[y] != y:
                y = label[y]
            if x != y:
                label[max(x, y)] = min(x, y)
                out_a.append(fp[a])
                out_b.append(fp[a + step])
        if len(near):
            while True:
                jump = label[label]
                if (jump == label).all():
                    break
                label = jump
        step += 1
    return np.array(out_a, np.uint64), np.array(out_b, np.uint64)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; the last key of a batch waits for the next batch."""
    key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy()])
        fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
        if not len(key):
            continue
        done = int(np.searchsorted(key, key[-1]))
        yield _pairs(*_forest(key[:done], fp[:done]))
        key, fp = key[done:], fp[done:]
    yield _pairs(*_forest(key, fp))


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64), pa.int64()), pa.array(b.view(np.int64), pa.int64())], ["a", "b"])


def _block_links(frame: pa.Table) -> pa.Table:
    """One pair of blocks of a hot variant. Rows of one block are compared where the block meets itself, and only there."""
    fp, block = frame.column("fp").to_numpy().view(np.uint64), frame.column("block").to_numpy()
    if frame.column("i")[0] == frame.column("j")[0]:
        return pa.Table.from_batches([_pairs(*_forest(np.zeros(len(fp), np.int64), fp))])
    return pa.Table.from_batches([_pairs(*_across(fp[block == block.min()], fp[block != block.min()]))])


def _across(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between rows of x and rows of y."""
    label = np.arange(len(x) + len(y))

    def top(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    out: list[tuple[int, int]] = []
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ y) <= MAX_BITS).tolist():
            a, b = top(i), top(len(x) + j)
            if a != b:
                label[max(a, b)] = min(a, b)
                out.append((i, j))
    at = np.array(out, np.int64).reshape(-1, 2)
    return x[at[:, 0]], y[at[:, 1]]


def links(distinct: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that connect all that lie within MAX_BITS of each other.

    A variant holds the rows of at most two segment values, so segment counts show whether any is hot. Hot
    variants are cut into blocks by a hash and each pair of blocks is one bounded task: exact, without a cap. Their
    list is broadcast if it is short, else joined.
    """
    rows = variants(distinct)
    per_segment = F.array(*(F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << w) - 1)).bitwiseOR(F.lit(i << 22)) for i, (at, w) in enumerate(SEGMENTS)))
    most = distinct.select(F.explode(per_segment).alias("s")).groupBy("s").count().agg(F.max("count")).first()[0] or 0
    usual, hot_links = rows, None
    if 2 * most > hot_rows:
        hot = written(rows.groupBy("key").count().where(F.col("count") > hot_rows), "hot-variants")
        hot = F.broadcast(hot) if hot.count() <= BROADCAST_KEYS else hot
        usual = rows.join(hot, "key", "left_anti")
        half = max(1, hot_rows // 2)
        blocks = F.ceil(F.col("count") / half).cast("int")
        own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
        spread = rows.join(hot, "key").select("key", "fp", own.alias("block"), F.explode(pairs).alias("p")).select("key", "fp", "block", "p.i", "p.j")
        hot_links = spread.groupBy("key", "i", "j").applyInArrow(_block_links, "a long, b long")
    found = usual.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long")
    return found if hot_links is None else found.unionByName(hot_links)


def near_duplicates(docs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links): one row for each of docs.

    Null and empty texts and texts without words have fingerprint zero and are linked like any other.
    Repeated rows appear as often as they come. A null doc_id takes part in links; a component of such rows
    alone has a null id. Other columns of docs are not read. No rows: no rows.
    """
    marks = written(fingerprints(docs), "fingerprints")
    distinct = written(marks.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "distinct-fingerprints")
    rows, n_distinct = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    roots = components(links(distinct.select("fp"), hot_rows))
    placed = written(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root")), "placed-fingerprints")
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("members"))
    classes = skewed_join(placed, lowest, "root", F.col("fp"), n_distinct, "members").select("fp", "component_id", "n")
    hex_digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return skewed_join(marks, classes, "fp", F.col("doc_id"), rows).select("doc_id", hex_digits.alias("fingerprint"), "component_id")
