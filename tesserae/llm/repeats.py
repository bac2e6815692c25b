"""Quality rules from repetition inside a text, found with a suffix array over its words.

Suffixes are sorted by prefix doubling for many texts at once; only suffixes that still tie are sorted again.
The ranks of each doubling give the longest common prefixes of neighbours. A suffix starts a repeated
substring as long as the deepest longest-common-prefix interval that holds it, which is the larger of its two
neighbours' common prefixes; the spans of all such substrings of at least min_words words are united.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import bounded, release
from tesserae.llm.tokens import pieces

# A text keeps if at most this part of its words lies in repeats of MIN_WORDS words or more ...
MIN_WORDS, MAX_COVERED = 8, 0.25
# ... and if no repeat of MIN_WORDS words or more has more words than this, or more than this part of the text's. The
# base rule stops at half the words, so limits must lie well under it; at these, 997 of 1000 clean labelled texts stay.
MAX_REPEAT, MAX_REPEAT_SHARE = 200, 0.12
MIN_N_WORDS, WINDOW = 50, 3
SYMBOLS = "[#*$%&|<>]"
WORDS_AT_ONCE = 262_144
PIECE = 3 << 20  # bytes of text whose words are held at once

SCHEMA = pa.schema(
    [("doc_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("covered_words", pa.int64()), ("longest_repeat", pa.int64())]
)
DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"


def longest_repeats(tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest substring from it that its text holds at another place too.

    tokens: ids of all texts' words, one text after the other. ends: for each position, where its text ends.
    Ranks of each doubling are kept: 4 bytes a word and doubling, of which there are as many as the longest repeat has
    binary digits. A text of 16 MB that is one repeat (some 3 million words, 22 doublings) takes 0.3 GB.
    """
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64)
    _, rank = np.unique(ends * (int(tokens.max()) + 1) + tokens, return_inverse=True)
    size = np.bincount(rank)
    rank = (np.cumsum(size) - size)[rank].astype(np.int32)  # how many suffixes are smaller
    levels, step = [rank], 1
    while True:
        tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(tied):
            break
        ahead = tied + step
        beyond = ahead >= ends[tied]
        key = rank[tied].astype(np.int64) * (n + 1) + np.where(beyond, 0, rank[np.where(beyond, 0, ahead)] + 1)
        order = np.argsort(key)
        tied, key = tied[order], key[order]
        group = rank[tied]
        place = np.arange(len(tied))
        first = lambda x: np.maximum.accumulate(np.where(np.r_[True, x[1:] != x[:-1]], place, 0))
        rank = rank.copy()
        rank[tied] = group + first(key) - first(group)
        levels.append(rank)
        step *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    a, b = suffixes[:-1], suffixes[1:]
    common = np.zeros(n - 1, np.int64)
    pairs = np.flatnonzero(ends[a] == ends[b])
    for level in range(len(levels) - 1, -1, -1):
        x, y = a[pairs] + common[pairs], b[pairs] + common[pairs]
        inside = (x < ends[a[pairs]]) & (y < ends[b[pairs]])
        at = pairs[inside]
        same = levels[level][x[inside]] == levels[level][y[inside]]
        common[at[same]] += 1 << level
    deepest = np.zeros(n, np.int64)
    deepest[a] = common
    deepest[b] = np.maximum(deepest[b], common)
    return deepest


def covered(lengths: np.ndarray, least: int) -> np.ndarray:
    """True where a position lies in the span of a substring of at least so many words; lengths as of longest_repeats()."""
    n = len(lengths)
    start = np.flatnonzero(lengths >= least)
    change = np.bincount(start, minlength=n + 1) - np.bincount(start + lengths[start], minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[bounds])


def measures(texts: pa.Array, min_words: int, window: int) -> dict[str, np.ndarray]:
    """Of each text; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    owner, words = np.asarray(pc.list_parent_indices(lists)), lists.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    owner, words = owner[np.asarray(real)], words.filter(real)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    codes = words.dictionary_encode()
    kinds = pc.utf8_length(codes.dictionary).to_numpy(zero_copy_only=False)
    tokens = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.zeros(len(tokens), np.int64)
    at = 0
    while at < len(texts):  # whole texts, about WORDS_AT_ONCE words each time
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + WORDS_AT_ONCE, "right")) - 1)
        lo, hi = bounds[at], bounds[to]
        lengths[lo:hi] = longest_repeats(tokens[lo:hi], np.repeat(bounds[at + 1 : to + 1] - lo, np.diff(bounds[at : to + 1])))
        at = to
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, owner, lengths)
    lines = pc.split_pattern(texts, "\n")
    line_owner, line = np.asarray(pc.list_parent_indices(lines)), lines.flatten()
    worded = np.asarray(pc.greater(pc.binary_length(pc.ascii_trim_whitespace(line)), 0))
    coded = line.dictionary_encode()
    pair = line_owner[worded].astype(np.int64) * (len(coded.dictionary) + 1) + np.asarray(coded.indices)[worded]
    distinct = np.unique(pair) // (len(coded.dictionary) + 1)
    count = lambda x: np.bincount(x, minlength=len(texts))
    return {
        "n_words": np.diff(bounds),
        "word_chars": _sums(kinds[tokens] if len(tokens) else tokens, bounds),
        "n_symbols": pc.count_substring_regex(texts, SYMBOLS).to_numpy(zero_copy_only=False).astype(np.int64),
        "n_dup_lines": count(line_owner[worded]) - count(distinct),
        "n_repeat_words": _sums(covered(lengths, window), bounds),
        "covered_words": _sums(covered(lengths, min_words), bounds),
        "longest_repeat": longest,
    }


def verdict(m: dict[str, np.ndarray], min_words: int, max_covered: float, max_repeat: int, max_share: float) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept of each text."""
    failed = (m["n_words"] < MIN_N_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    long = (m["longest_repeat"] > max_repeat) | (m["longest_repeat"] >= min_words) & (m["longest_repeat"] > max_share * m["n_words"])
    return failed, ~failed & (m["covered_words"] <= max_covered * m["n_words"]) & ~long


def repetition(docs: DataFrame, min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT, max_share: float = MAX_REPEAT_SHARE) -> DataFrame:
    """One row for each of docs: doc_id, the measures of its whole text, base_failed and kept.

    kept: not base_failed, at most max_covered of the words in repeats of min_words words or more, no
    repeat over max_repeat words, and none of min_words words or more over max_share of the words. Null and empty texts have zero measures and fail the base rule. Repeated
    rows and null ids give a row each; other columns are not read; no rows give no rows.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for batch in pieces(whole, 1, PIECE):
                m = measures(batch.column(1), min_words, WINDOW)
                m["doc_id"] = batch.column(0)
                m["base_failed"], m["kept"] = verdict(m, min_words, max_covered, max_repeat, max_share)
                yield pa.RecordBatch.from_arrays([pa.array(m[f.name], f.type) for f in SCHEMA], schema=SCHEMA)

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(measured, DDL)


def unrepetitive(docs: DataFrame, min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT, max_share: float = MAX_REPEAT_SHARE) -> DataFrame:
    """The rows of docs that keep, with all of their columns.

    The verdict travels with its row through a map over batches, so rows are neither joined nor shuffled.
    """
    at = docs.columns.index("text")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for batch in pieces(whole, at, PIECE):
                m = measures(batch.column(at), min_words, WINDOW)
                yield batch.filter(pa.array(verdict(m, min_words, max_covered, max_repeat, max_share)[1]))

    return bounded(docs).mapInArrow(chosen, docs.schema)
