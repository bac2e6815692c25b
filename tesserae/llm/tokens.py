"""Token ids by public tokenizers, and their Parquet form.

Most of a corpus is the same words again and again, and both tokenizers in use cut at a single space between
two other characters, so a batch's distinct words are encoded once and whole texts are put together from them
by array gathers. A text for which that cut is not certain is encoded as it is. The result is the tokenizer's
own for the whole text. Strings of special tokens in a text are ordinary text, as the vocabularies' description asks
(encode_special_tokens): a document can't end itself or another.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import bounded, held, written

END_ID = 2
# Words whose ids a worker remembers, the first that came twice in a batch; others are encoded again in each batch.
REMEMBERED = 200_000
WORDS_A_STRING = 64
# Letters and digits whose kind no version of Unicode has changed: no token holds one and the punctuation after it.
LETTERS = "A-Za-z0-9\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{24F}"
BATCH_BYTES = 8 << 20
# White space beside a space, at either end, or any but plain ASCII space and line breaks: no certain cut.
_UNCERTAIN = "\\x01|  |[\\t\\n\\x0b\\f\\r] | [\\t\\n\\x0b\\f\\r]|\\A[\\t\\n\\x0b\\f\\r ]|[\\t\\n\\x0b\\f\\r ]\\z|[\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


class Encoder:
    """Ids of whole texts. path: a file for the tokenizers library."""

    UNCERTAIN = _UNCERTAIN

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.known: dict[str, bytes] = {}
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        # What a line break between words becomes, if that is the same everywhere.
        found = ids("\n")
        self.line_break = None
        if ids("a\nb.") == ids("a") + found + ids("b") + ids(".") and ids("a\n b\n7") == ids("a") + found + ids(" b") + found + ids("7"):
            self.line_break = self.known["\n"] = np.array(found, "<i4").tobytes()
        # What may stand between words as one token of its own: the string, its mark and its id.
        self.between: tuple[str, str, int] | None = None
        for string, mark in (("\n", "\n"), ("\n~\n", "~")):
            found = ids(string)
            if self.between is None and len(found) == 1 and all(ids(x + string + y) == ids(x) + found + ids(y) for x, y in (("a", "b."), ("a.", " b"), ("7", " 7"), (",", "-"))):
                self.between = string, mark, found[0]

    def _whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 64):
            out += [np.array(e.ids, "<i4").tobytes() for e in self.tokenizer.encode_batch_fast(texts[at : at + 64], add_special_tokens=False)]
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Many words in one string, a token that none of them holds between any two."""
        if self.between is None:
            return self._by_offsets(words)
        string, mark, number = self.between
        out: list[bytes] = [b""] * len(words)
        plain = [i for i, w in enumerate(words) if mark not in w]
        rest = [i for i, w in enumerate(words) if mark in w] if len(plain) < len(words) else []
        for at in range(0, len(plain), WORDS_A_STRING * 32):
            groups = [plain[i : i + WORDS_A_STRING] for i in range(at, min(len(plain), at + WORDS_A_STRING * 32), WORDS_A_STRING)]
            found = self.tokenizer.encode_batch_fast([string.join([words[i] for i in g]) for g in groups], add_special_tokens=False)
            for group, e in zip(groups, found, strict=True):
                ids = np.array(e.ids, "<i4")
                breaks = np.flatnonzero(ids == number)
                if len(breaks) != len(group) - 1:
                    rest += group
                    continue
                data, begins, ends = ids.tobytes(), [0, *(4 * breaks + 4).tolist()], [*(4 * breaks).tolist(), 4 * len(ids)]
                for i, a, b in zip(group, begins, ends, strict=True):
                    out[i] = data[a:b]
        for i, ids in zip(rest, self._by_offsets([words[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _by_offsets(self, words: list[str]) -> list[bytes]:
        """The same by the places that tokens come from: a token belongs to the word that it starts in."""
        out: list[bytes] = []
        for at in range(0, len(words), WORDS_A_STRING * 32):
            groups = [words[i : i + WORDS_A_STRING] for i in range(at, min(len(words), at + WORDS_A_STRING * 32), WORDS_A_STRING)]
            found = self.tokenizer.encode_batch(["\n".join(g) for g in groups], add_special_tokens=False)
            for group, e in zip(groups, found, strict=True):
                ends = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)) + 1)  # one past the line break
                starts = np.array([x[0] for x in e.offsets], np.int64)
                ids = np.array(e.ids, "<i4")
                inside = starts != np.concatenate([ends, [-1]])[np.searchsorted(ends, starts, "right")] - 1
                owner = np.searchsorted(ends, starts[inside], "right")
                cuts = (4 * np.searchsorted(owner, np.arange(len(group) + 1))).tolist()
                data = ids[inside].tobytes()
                out += [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def _units(self, kinds: pa.Array) -> pa.Array:
        """Lists of what words are put together from: parts at line breaks inside, and punctuation after a letter or digit."""
        if self.line_break is not None:
            kinds = pc.replace_substring_regex(kinds, "([^\\s])\n([^\\s])", "\\1\x01\n\x01\\2")
            kinds = pc.replace_substring_regex(kinds, f"([{LETTERS}])([.,;:!?]+)(\x01|$)", "\\1\x01\\2\\3")
        return pc.split_pattern(kinds, "\x01")

    def _kinds(self, kinds: pa.Array, at_start: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words after a space, then of those at a text's start: all in a row, and how many each has.

        times: how often each occurs.
        """
        if not len(kinds):
            return np.zeros(0, "<i4"), np.zeros(0, np.int64)
        lists = self._units(kinds)
        first, counts = np.asarray(lists.offsets)[:-1], np.diff(np.asarray(lists.offsets))
        coded = lists.flatten().dictionary_encode()
        unit, names = np.array(coded.indices).astype(np.int64), coded.dictionary.to_pylist()
        spaced = np.zeros(len(unit), bool)
        spaced[first] = True
        # Places of words at a text's start come after the others; their first units have no space before them.
        more = np.arange(counts[at_start].sum()) + np.repeat(first[at_start] - np.cumsum(counts[at_start]) + counts[at_start], counts[at_start])
        unit, spaced = np.concatenate([unit, unit[more]]), np.concatenate([spaced, np.zeros(len(more), bool)])
        counts = np.concatenate([counts, counts[at_start]])
        with_space, without = np.unique(unit[spaced]), np.unique(unit[~spaced])
        key = np.where(spaced, np.searchsorted(with_space, unit), len(with_space) + np.searchsorted(without, unit))
        keys = [" " + names[i] for i in with_space.tolist()] + [names[i] for i in without.tolist()]
        get = self.known.get
        ids = [get(k) for k in keys]
        missing = [i for i, x in enumerate(ids) if x is None]
        again = (np.bincount(key, weights=np.repeat(times, counts), minlength=len(keys)) > 1).tolist()
        for i, x in zip(missing, self._words([keys[i] for i in missing]), strict=True):
            ids[i] = x
            if again[i] and len(self.known) < REMEMBERED:
                self.known[keys[i]] = x
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        values = np.frombuffer(b"".join(ids), "<i4")
        begins = np.cumsum(sizes) - sizes
        return _gathered(values, begins[key], sizes[key]), np.add.reduceat(sizes[key], np.cumsum(counts) - counts)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (int32), one text after the other, and where each text's ids begin (one more entry than texts)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        certain = np.asarray(pc.and_(pc.invert(pc.match_substring_regex(texts, self.UNCERTAIN)), pc.greater(pc.binary_length(texts), 0)))
        lists = pc.split_pattern(texts.filter(pa.array(certain)), " ")
        words = lists.flatten()
        offsets = np.asarray(lists.offsets)
        firsts = np.zeros(len(words), bool)
        firsts[offsets[:-1]] = True
        codes = words.dictionary_encode()
        index = np.array(codes.indices)
        # A text's first word has no space before it, so it is a kind of its own.
        at_start = np.unique(index[firsts])
        index[firsts] = len(codes.dictionary) + np.searchsorted(at_start, index[firsts])
        values, sizes = self._kinds(codes.dictionary, at_start, np.bincount(index, minlength=len(codes.dictionary) + len(at_start)))
        del codes, words, lists
        begins = np.cumsum(sizes) - sizes
        totals = np.concatenate([[0], np.cumsum(sizes[index])])
        flat = np.empty(totals[-1], "<i4")
        for at in range(0, len(index), 1 << 19):
            some = index[at : at + (1 << 19)]
            flat[totals[at] : totals[at + len(some)]] = _gathered(values, begins[some], sizes[some])
        lengths = np.zeros(n, np.int64)
        lengths[certain] = totals[offsets[1:]] - totals[offsets[:-1]]
        if certain.all():
            return flat, np.concatenate([[0], np.cumsum(lengths)])
        others = self._whole([x.as_py() for x in texts.filter(pa.array(~certain))])
        lengths[~certain] = [len(x) // 4 for x in others]
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        out = np.empty(bounds[-1], "<i4")
        out[np.repeat(certain, lengths)] = flat
        out[np.repeat(~certain, lengths)] = np.frombuffer(b"".join(others), "<i4")
        return out, bounds


def _gathered(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of values, one after the other."""
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - ends + sizes, sizes)]


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return held(("encoder", path), lambda: Encoder(path))


def pieces(batch: pa.RecordBatch, text: int, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about so many bytes of text; a row is never cut.

    A slice is copied: some string kernels (ascii_lower is one) misread arrays that begin inside their buffers.
    """
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
    group = np.cumsum(sizes) // size
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(sizes)]])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if a == 0 and b == len(batch):
            yield batch
        elif b > a:
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([c, c.slice(0, 0)]) for c in part.columns], schema=batch.schema)


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id after each text."""
    return np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))


def crc32(ids: np.ndarray) -> int:
    """Of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty), range-partitioned and sorted by doc_id; copies of an id by their text, which may part them too."""
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    return rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")


def _encoded(path: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, at = TaskContext.get().partitionId(), 0
        own = encoder(path)
        for whole in batches:
            for batch in pieces(whole, 1):
                ids, bounds = with_end(*own.encode(batch.column(1)), end_id)
                n = len(batch)
                tokens = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, shard), pa.int32()), pa.array(np.arange(at, at + n), pa.int64()), batch.column(0), pa.array(np.diff(bounds), pa.int64()), tokens],
                    ["shard", "row", "doc_id", "n_tokens", "tokens"],
                )
                at += n

    return encode


def write(docs: DataFrame, out: str, path: str, end_id: int = END_ID, row_group_mb: int = 16, page_kb: int = 256, delta: bool = False) -> None:
    """Token ids of every text, in ascending doc_id order, as Parquet under out.

    Columns: shard and row (the place: files hold one shard, in row order), doc_id, n_tokens, tokens (list of
    int, ended by end_id). Ids are dictionary-encoded, or with delta=True delta-packed by writer version 2. Row
    groups and pages are small and files have page indexes and column statistics, so a reader that asks for some
    doc_ids or for n_tokens alone reads little else.
    """
    table = in_order(docs).mapInArrow(_encoded(path, end_id), "shard int, row long, doc_id long, n_tokens long, tokens array<int>")
    options = {"parquet.block.size": row_group_mb << 20, "parquet.page.size": page_kb << 10, "parquet.page.row.count.limit": 2_000, "compression": "zstd", "parquet.compression.codec.zstd.level": 1, "parquet.writer.version": "v2" if delta else "v1"}
    options |= {"parquet.enable.dictionary#tokens.list.element": str(not delta).lower(), "parquet.enable.dictionary#doc_id": "false"}
    table.write.options(**options).parquet(out)


SCHEMA = "shard int, row long, doc_id long, n_tokens long, tokens array<int>"


def read(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(out)


def read_tokens(spark: SparkSession, out: str, doc_ids: list[int]) -> DataFrame:
    """Of some documents; the filter reaches row groups and pages."""
    return read(spark, out).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "tokens")


def read_lengths(spark: SparkSession, out: str) -> DataFrame:
    """Metadata alone; token pages are not touched."""
    return read(spark, out).select("shard", "row", "doc_id", "n_tokens")


def starts(lengths: DataFrame, n: str) -> DataFrame:
    """lengths (shard, row, ..., n) with start: the sum of n over all rows before.

    Totals of shards, a row for each task that wrote, are summed first; rows of a shard then add up by themselves.
    """
    from pyspark.sql import Window

    totals = lengths.groupBy("shard").agg(F.sum(n).alias("total"))
    before = totals.select("shard", F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.sum(n).over(Window.partitionBy("shard").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)) - F.col(n)
    return lengths.withColumn("own", own).join(before, "shard").withColumn("start", F.col("before") + F.col("own")).drop("own", "before")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(4)
        values, offsets = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.offsets) - np.asarray(lists.offsets)[0]
        sums = [crc32(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.diff(offsets), pa.int64()), pa.array(sums, pa.int64())], ["shard", "row", "doc_id", "n_tokens", "n_read", "ids_crc32"])


def digests(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, all from the files.

    Null texts are empty and give the end id alone; rows with a null doc_id come first; repeated ids are rows of
    their own, ordered by text. No rows: no rows.
    """
    sums = read(spark, out).mapInArrow(_sums, "shard int, row long, doc_id long, n_tokens long, n_read long, ids_crc32 long")
    return starts(written(sums.select("shard", "row", "doc_id", F.col("n_read").alias("n_tokens"), "ids_crc32"), "token-digests"), "n_tokens").select("doc_id", "start", "n_tokens", "ids_crc32")
