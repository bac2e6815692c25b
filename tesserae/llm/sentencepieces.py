"""SentencePiece encoding and decoding in one pass over an Aho-Corasick automaton of all pieces.

The automaton reports, at each position, every piece that ends there (it follows output links); each may extend
the best segmentation that ends where the piece begins. What "best" means is the model's kind:

* unigram: the largest sum of scores (Viterbi).
* BPE: the segmentation that merging by rank gives. It is the only one in which merging the text of any two
  neighbouring pieces alone gives these two again, so a piece extends a segmentation if it may follow its last
  piece. A sum of ranks would give other ids than the model's own.

Pieces that cross from another character to a space do not exist, so texts are cut before spaces and each
distinct word is segmented once in a batch. Characters without a piece become their UTF-8 bytes' pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import tokens
from tesserae.llm.common import bounded, held

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
UNKNOWN_PENALTY = 10.0  # below the worst score, as in unigram models' own decoding
PAIRS_REMEMBERED = 400_000
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Pieces(tokens.Encoder):
    """A .model file with identity normalisation and byte fallback."""

    UNCERTAIN = f"\x01|  |^ | $|{SPACE}"
    line_break = None  # pieces may hold a letter and what follows it, so words are not cut

    def __init__(self, path: str, kind: int | None = None):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        form = model.normalizer_spec
        if form.precompiled_charsmap or form.remove_extra_whitespaces or not form.add_dummy_prefix:
            raise NotImplementedError("only models with identity normalisation and a dummy prefix")
        self.kind = kind or model.trainer_spec.model_type
        self.pieces = [p.piece for p in model.pieces]
        self.scores = [p.score for p in model.pieces]
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER_DEFINED)}
        if len(self.byte_ids) != 256 or any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise NotImplementedError("only models with byte fallback whose pieces hold a space at the front only")
        self.unknown_score = min(self.scores[i] for i in self.ids.values()) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" if p.type in (CONTROL, UNKNOWN) else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        self.known: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.own: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """Merging by rank: again and again the leftmost of the best pairs. For short texts."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, at = self.scores[found], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _may_follow(self, last: int, piece: int) -> bool:
        """last, piece: ids, or -1 for a character without a piece, which never merges."""
        if last < 0 or piece < 0:
            return True
        key = last * len(self.pieces) + piece
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS_REMEMBERED:
                self.pairs.clear()
            a, b = self.pieces[last], self.pieces[piece]
            found = self.pairs[key] = self.merged(a + b) == [a, b]
        return found

    def segment(self, text: str) -> list[int]:
        """Ids of a text whose spaces are SPACE; -1 for a character without a piece."""
        ending: list[list[tuple[int, int]]] = [[] for _ in text]
        for end, found in self.automaton.iter(text):
            ending[end].append(found)
        n = len(text)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        if self.kind == BPE:
            for end in range(n):
                for length, i in ending[end]:  # longest first, as output links shorten; one fits
                    begin = end + 1 - length
                    if self._reached(i) and (begin == 0 or self._may_follow(last[begin], i)):
                        last[end + 1], back[end + 1] = i, begin
                        break
                else:
                    last[end + 1], back[end + 1] = -1, end
        else:
            best = [0.0] + [-np.inf] * n
            for end in range(n):
                single = False
                for length, i in ending[end]:
                    single |= length == 1
                    score = best[end + 1 - length] + self.scores[i]
                    if score > best[end + 1]:
                        best[end + 1], last[end + 1], back[end + 1] = score, i, end + 1 - length
                if not single and best[end] + self.unknown_score > best[end + 1]:
                    best[end + 1], last[end + 1], back[end + 1] = best[end] + self.unknown_score, -1, end
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]

    def _reached(self, piece: int) -> bool:
        """Whether merging a piece's own text gives the piece."""
        found = self.own.get(piece)
        if found is None:
            found = self.own[piece] = self.merged(self.pieces[piece]) == [self.pieces[piece]]
        return found

    def _ids(self, text: str) -> list[int]:
        out, at = [], 0
        for i in self.segment(text):
            if i < 0:
                out += [self.byte_ids[b] for b in text[at].encode()]
                at += 1
            else:
                out.append(i)
                at += len(self.pieces[i])
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        return [np.array(self._ids(SPACE + w.removeprefix(" ")), "<i4").tobytes() for w in words]

    def _whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            chunks = _CHUNK.findall(SPACE + text.replace(" ", SPACE)) if text else []
            out.append(b"".join(np.array(self._ids(c), "<i4").tobytes() for c in chunks))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; of what is no UTF-8, replacement characters."""
        return b"".join(map(self.bytes.__getitem__, ids)).removeprefix(b" ").decode("utf-8", "replace")


def pieces(path: str) -> Pieces:
    """One for each worker process."""
    return held(("pieces", path), lambda: Pieces(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text, ids (array of int): a row for each of docs, its whole text encoded. Null texts are empty: no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for whole in batches:
            for batch in tokens.pieces(whole, 1):
                ids, bounds = own.encode(batch.column(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "text", "ids"])

    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string, ids array<int>")


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (as little-endian unsigned 32-bit integers), n_chars decoded, same: whether decoding
    gives the text again. A text that holds U+2581 itself gets a space in its place, which counts as the same.

    Null texts are empty and the same; null and repeated ids give rows of their own; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in batches:
            lists = batch.column(2)
            first = np.asarray(lists.offsets)
            values, bounds = lists.flatten().to_numpy(zero_copy_only=False), first - first[0]
            texts = batch.column(1).to_pylist()
            sums, chars, same = [], [], []
            for i, text in enumerate(texts):
                ids = values[bounds[i] : bounds[i + 1]]
                back = own.decode(ids.tolist())
                sums.append(tokens.crc32(ids))
                chars.append(len(back))
                same.append(back == (text or "").replace(SPACE, " "))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(sums, pa.int64()), pa.array(chars, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_crc32", "n_chars", "same"])

    return encode(docs, path).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, n_chars long, same boolean")
