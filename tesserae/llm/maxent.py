"""Language-model scores by a hashed maximum-entropy model with class-factored softmax.

p(word | before) = p(class | features) p(slot | class, features) p(word | slot). Words in falling order of count are
dealt to classes and slots of like shares of the text, so a common word has a slot of its own, and the words of a slot
share it by their counts; rare words and unseen ones are one class. Features are the word before, the word before
that (a skip) and the two together, hashed from the words themselves, so any word is a context, however rare. Each
training round every task adds up the gradient of its documents (counts seen less counts expected), the sums meet in
two steps of bounded fan-in, and the driver takes one scaled step, held back by a ridge on the weights. The weights are a table of fixed size; words'
counts grow with the corpus, and they stay in a table: the commonest are broadcast, the others are joined to each
text's rare words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import bounded, skewed_join, written
from tesserae.llm.tokens import pieces

END = "\n"  # the token after a text's last word; no word holds a line break
# So many words at most, of so many bytes each, are broadcast; words seen less often than LEAST are rare, and stand
# for unseen ones. The end of a text is always among the common ones.
COMMON, LONGEST, LEAST = 131_072, 64, 3
CLASSES, SLOTS, FEATURES = 32, 16, 3
BUCKETS, SLOT_BUCKETS = 4_096, 512  # hashed contexts of classes and of slots
# Rounds after the first; counts added to what is expected; counts that a weight is held back by.
ROUNDS, SMOOTHING, RIDGE = 1, 4.0, 20.0
DISCOUNT, NEVER = 0.5, -30.0
TOKENS_AT_ONCE = 32_768
BLOCK = 16_384  # numbers in a row of summed gradients
PIECE = 3 << 20  # bytes of text at once
SHAPES = ((FEATURES, BUCKETS, CLASSES), (FEATURES, SLOT_BUCKETS, CLASSES, SLOTS))
# Fixed hashes of the places before a text, and of a text's end.
EDGE_HASH, END_HASH = 0x9AE16A3B2F90404F, 0xC949D7C7509E6557


@dataclass
class Vocabulary:
    """Common words by number, with counts, in falling order; END is one of them. Sums over all training tokens."""

    words: pa.Array
    counts: np.ndarray
    tokens: int
    kinds: int

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """Class and slot of each common word, then of rare ones (0, 0)."""
        before = np.cumsum(self.counts) - self.counts
        leaf = np.minimum(before * ((CLASSES - 1) * SLOTS) // max(1, int(self.counts.sum())), (CLASSES - 1) * SLOTS - 1)
        return np.append(1 + leaf // SLOTS, 0).astype(np.int64), np.append(leaf % SLOTS, 0).astype(np.int64)

    def word_given_slot(self) -> np.ndarray:
        """log10, of common words; rare ones count elsewhere."""
        own, slot = self.leaves()
        leaf = (own * SLOTS + slot)[:-1]
        sums = np.bincount(leaf, weights=self.counts, minlength=CLASSES * SLOTS)[leaf]
        return np.append(np.log10(np.maximum(self.counts, 1) / np.maximum(sums, 1)), 0.0)

    def rare(self) -> tuple[int, int]:
        """Training tokens that are rare words, and how many such words there are."""
        return self.tokens - int(self.counts.sum()), self.kinds - int((self.counts > 0).sum())


@dataclass
class Texts:
    """Words of a batch of texts, lower-cased A-Z, one text after the other, each with END after it."""

    owner: np.ndarray
    words: pa.Array  # distinct
    index: np.ndarray  # of each word, in words
    bounds: np.ndarray  # of each text, in index

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column.cast(pa.large_string()), "")))
        words, owner = lists.flatten(), np.asarray(pc.list_parent_indices(lists))
        real = pc.greater(pc.binary_length(words), 0)
        coded, owner = words.filter(real).dictionary_encode(), owner[np.asarray(real)]
        return cls(owner, coded.dictionary, np.asarray(coded.indices).astype(np.int64), np.searchsorted(owner, np.arange(len(column) + 1)))

    def numbers(self, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """Of each distinct word in the vocabulary (its size: rare), and of the whole sequence with ends."""
        kinds = np.asarray(pc.fill_null(pc.index_in(self.words, value_set=vocabulary.words), len(vocabulary.words))).astype(np.int64)
        end = pc.index_in(pa.scalar(END, pa.large_string()), value_set=vocabulary.words).as_py()
        return kinds, self._placed(kinds, end)

    def hashes(self) -> np.ndarray:
        """Of the whole sequence with ends; a word's hash depends on nothing but its letters."""
        own = pd.util.hash_array(self.words.cast(pa.large_binary()).to_numpy(zero_copy_only=False), categorize=False) if len(self.words) else np.zeros(0, np.uint64)
        return self._placed(own, END_HASH)

    def _placed(self, of_words: np.ndarray, of_end: int) -> np.ndarray:
        out = np.full(len(self.index) + len(self.bounds) - 1, of_end, of_words.dtype)
        out[np.arange(len(self.index)) + self.owner] = of_words[self.index]
        return out

    def starts(self) -> np.ndarray:
        return self.bounds + np.arange(len(self.bounds))


def contexts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """FEATURES x tokens: hashes of the one or two tokens before each, uint64; before a text are edges."""
    edge = np.uint64(EDGE_HASH)
    one, two = np.full(len(hashes), edge), np.full(len(hashes), edge)
    one[1:], two[2:] = hashes[:-1], hashes[:-2]
    first = starts[:-1]
    one[first], two[first] = edge, edge
    second = first + 1
    two[second[second < len(hashes)]] = edge
    times = np.uint64(0x9E3779B97F4A7C15)
    return np.stack([one, two + np.uint64(0x51ED27), one * np.uint64(1_000_003) ^ two]) * times


def _buckets(hashed: np.ndarray, n: int) -> np.ndarray:
    """The highest bits of hashes as numbers below n, a power of two."""
    return (hashed >> np.uint64(65 - n.bit_length())).astype(np.int64)


@dataclass
class Model:
    """bias: by class; slot_bias: by class and slot; weights: as SHAPES."""

    vocabulary: Vocabulary
    bias: np.ndarray
    slot_bias: np.ndarray
    weights: tuple[np.ndarray, np.ndarray]

    def classes(self, hashed: np.ndarray) -> np.ndarray:
        """Scores of classes before they are normalised, tokens x CLASSES. hashed: as of contexts()."""
        b = _buckets(hashed, BUCKETS)
        z = self.bias + self.weights[0][0][b[0]]
        for f in range(1, FEATURES):
            z += self.weights[0][f][b[f]]
        return z

    def slots(self, hashed: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Likewise of slots in each token's own class, tokens x SLOTS."""
        b = _buckets(hashed, SLOT_BUCKETS) * CLASSES + own
        z = self.slot_bias[own]
        for f in range(FEATURES):
            z += self.weights[1][f].reshape(-1, SLOTS)[b[f]]
        return z


def _probabilities(z: np.ndarray) -> np.ndarray:
    """Of scores, in their place."""
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def _log_of(z: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Natural logarithms of the chosen outcomes' probabilities; z is used up."""
    z -= z.max(1, keepdims=True)
    own = z[np.arange(len(z)), chosen].astype(np.float64)
    return own - np.log(np.exp(z, out=z).sum(1))


def _added(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of data by keys; a task holds a sum for each of its keys."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for *key, data in zip(*(c.to_pylist() for c in batch.columns[:-1]), batch.column(len(keys)), strict=True):
                x = np.frombuffer(data.as_buffer(), np.float32 if len(data.as_buffer()) == 4 * BLOCK else np.float64).astype(np.float64)
                held[tuple(key)] = held[tuple(key)] + x if tuple(key) in held else x
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in held], pa.int32()) for i in range(len(keys))), pa.array([x.tobytes() for x in held.values()], pa.binary())], [*keys, "data"])

    return rows.select(*keys, "data").repartition(*keys).mapInArrow(add, ", ".join(f"{k} int" for k in keys) + ", data binary")


def _summed(rows: DataFrame, tasks: int) -> list[np.ndarray]:
    """Adds up rows of (block, part, data) to arrays of SHAPES, whose size doesn't depend on the input.

    Each of the tasks that made the rows has sent one for each block. They are added by block and part, of which
    there are about the root of the tasks' number, then by block: no sum is over more than that many rows.
    """
    fan = max(1, isqrt(tasks))
    parts = _added(rows.withColumn("part", F.pmod(F.col("part"), F.lit(fan)).cast("int")), ["block", "part"])
    out = np.zeros(-(-sum(int(np.prod(x)) for x in SHAPES) // BLOCK) * BLOCK)
    for r in _added(parts, ["block"]).toArrow().to_pylist():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] += np.frombuffer(r["data"], np.float64)
    ends = np.cumsum([int(np.prod(x)) for x in SHAPES])
    return [out[e - int(np.prod(x)) : e].reshape(x) for e, x in zip(ends, SHAPES, strict=True)]


def _as_blocks(totals: list[np.ndarray], part: int) -> Iterator[pa.RecordBatch]:
    flat = np.concatenate([t.ravel() for t in totals]).astype(np.float32)
    data = np.pad(flat, (0, -len(flat) % BLOCK)).reshape(-1, BLOCK)
    some = np.flatnonzero(data.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(len(some), part), pa.int32()), pa.array([data[i].tobytes() for i in some], pa.binary())], ["block", "part", "data"])


def count(training: DataFrame) -> DataFrame:
    """token, c: of all whole texts of training, ends included. A row for each distinct token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 0, PIECE):
                t = Texts.of(batch.column(0))
                n = np.append(np.bincount(t.index, minlength=len(t.words)), len(batch))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([t.words.cast(pa.string()), pa.array([END])]), pa.array(n, pa.int64())], ["token", "c"])

    return training.select("text").mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, most: int = COMMON) -> Vocabulary:
    """END is always in it, with a count of zero if there is no training text."""
    tokens, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = counts.where(F.col("token") == END).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    common = counts.where((F.col("token") != END) & (F.octet_length("token") <= LONGEST) & (F.col("c") >= LEAST))
    top = common.orderBy(F.desc("c"), "token").limit(most).toArrow().combine_chunks()
    c = top.column("c").to_numpy().astype(np.int64)
    words = top.column("token").combine_chunks().cast(pa.large_string()) if len(c) else pa.array([], pa.large_string())
    at = int(np.searchsorted(-c, -ends))
    return Vocabulary(pa.concat_arrays([words.slice(0, at), pa.array([END], pa.large_string()), words.slice(at)]), np.insert(c, at, ends), tokens, kinds)


def _gradient_part(training: DataFrame, shared: Broadcast, expected: bool) -> list[np.ndarray]:
    """Counts of (feature, class) and (feature, class, slot): those seen, or those that the shared model expects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model: Model = shared.value
        classes, slots = model.vocabulary.leaves()
        totals = [np.zeros((x[0], int(np.prod(x[1:])))) for x in SHAPES]
        for whole in batches:
            for batch in pieces(whole, 0, PIECE):
                t = Texts.of(batch.column(0))
                _, numbers = t.numbers(model.vocabulary)
                hashed = contexts(t.hashes(), t.starts())
                for at in range(0, len(numbers), TOKENS_AT_ONCE):
                    part = hashed[:, at : at + TOKENS_AT_ONCE]
                    number = numbers[at : at + TOKENS_AT_ONCE]
                    own, slot = classes[number], slots[number]
                    by_class, by_slot = _buckets(part, BUCKETS) * CLASSES, (_buckets(part, SLOT_BUCKETS) * CLASSES + own) * SLOTS
                    if expected:
                        p, q = (_probabilities(z).ravel().astype(np.float64) for z in (model.classes(part), model.slots(part, own)))
                    for f in range(FEATURES):
                        for total, base, one, many, weights in ((totals[0][f], by_class[f], own, CLASSES, p if expected else None), (totals[1][f], by_slot[f], slot, SLOTS, q if expected else None)):
                            at_cell = base + one if weights is None else (base[:, None] + np.arange(many)).ravel()
                            total += np.bincount(at_cell, weights=weights, minlength=len(total))
        yield from _as_blocks(totals, TaskContext.get().partitionId())

    return _summed(training.select("text").mapInArrow(run, "block int, part int, data binary"), training.rdd.getNumPartitions())


def _shares(seen: np.ndarray, smallest: float = 1e-3) -> np.ndarray:
    """Of the last axis."""
    x = seen + smallest
    return x / x.sum(-1, keepdims=True)


def _stepped(weights: np.ndarray, seen: np.ndarray, expected: np.ndarray, share: np.ndarray) -> np.ndarray:
    gradient = seen - expected - RIDGE * share * weights
    step = np.log1p(np.maximum(gradient / (expected + (SMOOTHING + RIDGE) * share), -0.9)) / FEATURES
    return weights + step.astype(np.float32)


def train(training: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Model:
    """The first round starts from the shares of classes and slots, whose expected counts need no pass over the texts."""
    sc = training.sparkSession.sparkContext
    zero = tuple(np.zeros(x, np.float32) for x in SHAPES)
    used = np.zeros((CLASSES, SLOTS), bool)
    used[vocabulary.leaves()] = True
    model = Model(vocabulary, np.zeros(CLASSES, np.float32), np.zeros((CLASSES, SLOTS), np.float32), zero)
    shared = sc.broadcast(model)
    seen = _gradient_part(training, shared, False)
    shares = [_shares(seen[0][0].sum(0)), _shares(np.where(used, seen[1][0].sum(0), 0) + used * 1e-3, 1e-9)]
    # Slots without a word are never taken.
    slot_bias = np.where(used, np.log(shares[1]), NEVER)
    model = Model(vocabulary, np.log(shares[0]).astype(np.float32), slot_bias.astype(np.float32), zero)
    expected = [x.sum(-1, keepdims=True) * share for x, share in zip(seen, shares, strict=True)]
    for i in range(rounds + 1):
        if i:
            shared.unpersist()
            shared = sc.broadcast(model)
            expected = _gradient_part(training, shared, True)
        model = Model(vocabulary, model.bias, model.slot_bias, tuple(map(_stepped, model.weights, seen, expected, shares)))
    shared.unpersist()
    return model


LOCAL = "row long, doc_id long, held_out boolean, n_tokens long, n_common long, base double, score double, rare array<string>, times array<int>"


def _local(docs: DataFrame, model: Model) -> DataFrame:
    """All of a text's score but for its rare words, and those with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model: Model = shared.value
        v = model.vocabulary
        (classes, slots), within = v.leaves(), v.word_given_slot()
        base = np.append(np.log10((v.counts + 1) / (v.tokens + v.kinds + 1)), 0.0)
        known = np.append(v.counts > 0, False)
        row = TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in pieces(whole, 2, PIECE):
                t = Texts.of(batch.column(2))
                kinds, numbers = t.numbers(v)
                starts = t.starts()
                hashed = contexts(t.hashes(), starts)
                logs = np.empty(len(numbers))
                for at in range(0, len(numbers), TOKENS_AT_ONCE):
                    part, number = hashed[:, at : at + TOKENS_AT_ONCE], numbers[at : at + TOKENS_AT_ONCE]
                    own = classes[number]
                    logs[at : at + TOKENS_AT_ONCE] = _log_of(model.classes(part), own) + _log_of(model.slots(part, own), slots[number])
                sums = lambda x: np.add.reduceat(np.asarray(x, np.float64), starts[:-1])  # noqa: E731  (no text is without its end)
                rare = np.flatnonzero(kinds[t.index] == len(v.words))
                pair, times = np.unique(t.owner[rare] * (len(t.words) + 1) + t.index[rare], return_counts=True)
                of = np.searchsorted(pair // (len(t.words) + 1), np.arange(len(batch) + 1))
                words = t.words.take(pa.array(pair % (len(t.words) + 1))).cast(pa.string())
                n, at = len(batch), pa.array(of, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n)), batch.column(0), batch.column(1), pa.array(np.diff(starts)),
                        pa.array(sums(known[numbers]).round().astype(np.int64)), pa.array(sums(base[numbers])), pa.array(sums(logs / np.log(10) + within[numbers])),
                        pa.ListArray.from_arrays(at, words), pa.ListArray.from_arrays(at, pa.array(times, pa.int32())),
                    ],
                    [x.split()[0] for x in LOCAL.split(", ")],
                )
                row += n

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, LOCAL)


def split(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, text. A null doc_id counts as the empty text in the split."""
    as_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), (F.crc32(as_text.cast("binary")) % 7 == 2).alias("held_out"), F.col("text").cast("string").alias("text"))


def score(docs: DataFrame, rounds: int = ROUNDS, most: int = COMMON) -> DataFrame:
    """A row for each of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    base_score: log10 of the whole text under counts of single tokens with one added; score: under the model. In
    both an unseen word is one outcome, whatever its letters. The end is a token like any other, however few training
    texts there are. Null texts are empty: their end alone is scored. Repeated rows count and give a row each; without
    training tokens everything is unseen; no rows give no rows.
    """
    rows = split(docs)
    training = rows.where(~F.col("held_out"))
    counts = written(count(training), "token-counts")
    v = vocabulary(counts, most)
    local = written(_local(rows, train(training, v, rounds)), "scores")
    rare_tokens, rare_kinds = v.rare()
    unseen = float(np.log10(DISCOUNT * rare_kinds / rare_tokens)) if rare_tokens else 0.0
    rare = local.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("token"), F.col("x.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    base = F.log10((c + 1) / F.lit(float(v.tokens + v.kinds + 1)))
    own = F.when(c > 0, F.log10((c - DISCOUNT) / F.lit(float(max(1, rare_tokens))))).otherwise(F.lit(unseen))
    # A word that many texts hold is split.
    held = rare.groupBy("token").agg(F.count("*").alias("n")).join(counts, "token", "left")
    joined = skewed_join(rare, held, "token", F.col("row"), local.agg(F.coalesce(F.sum(F.size("rare")), F.lit(0))).first()[0])
    found = joined.groupBy("row").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known"), F.sum(F.col("times") * base).alias("more_base"), F.sum(F.col("times") * own).alias("more"))
    none = F.lit(0.0)
    return local.drop("rare", "times").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_common") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", none)).alias("base_score"), (F.col("score") + F.coalesce("more", none)).alias("score"),
    )
