"""Operators on documents against plain Python, with nulls, empty and long texts, ties, repeats and extra columns."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tesserae.llm import kneser_ney, maxent, packing, repeats, sentencepieces, simhash, tokens

tokenizers = pytest.importorskip("tokenizers")
vocabularies = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, fp string, row int, token string"


def words(text):
    out, held = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            out += [held] if held else []
            held = ""
        else:
            held += c
    return out + ([held] if held else [])


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(rng, n, vocabulary=400):
    return " ".join("".join(rng.choice("aeiounrst") for _ in range(1 + (i * 7 + rng.randrange(vocabulary)) % 8)) + rng.choice(["", "", "", ".", ","]) for i in range(n))


def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(20, 160)) for _ in range(25)]
    near = [b + " extra" for b in base[:8]] + [b.replace("a", "e", 1) for b in base[8:14]]
    odd = [None, None, "", "  \n\t ", "one", "Two  words", "a b c", "é\u0085x y 𝄞 İ ß", "x <|endoftext|> y", "tab\tnew\nline  two ", "▁ under", base[0].upper()]
    repeated = ["go " * 80, "\n".join(["the same line here"] * 30), base[1] + "\n" + base[1], "#$ " * 60 + base[2], prose(rng, 9000)]
    return base + near + odd + repeated + base[:5]


def documents(spark):
    rows = [(i if t is None or i % 11 else i - 1, t, "en" if i % 3 else None, "s", 0, 7, "x", 1, "t") for i, t in enumerate(texts())]
    rows.append((None, "a row without an id", "en", "s", 0, 7, "x", 1, "t"))
    rows.append(rows[3])
    return rows, spark.createDataFrame(rows, SCHEMA)


def fingerprint(text):
    w = words(lower(text))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 4 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    low = {}
    for i, x in enumerate(label):
        low[x] = min([v for v in (low.get(x), ids[i]) if v is not None], default=None)
    return [low[x] for x in label]


@pytest.mark.parametrize("hot_rows", [simhash.HOT_ROWS, 4])
def test_near_duplicates(spark, hot_rows):
    rows, df = documents(spark)
    fps = [fingerprint(r[1]) for r in rows]
    expected = Counter(zip((r[0] for r in rows), (f"{f:016x}" for f in fps), brute_components(fps, [r[0] for r in rows]), strict=True))
    got = simhash.near_duplicates(df, hot_rows)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert Counter(map(tuple, got.collect())) == expected


def test_one_fingerprint_on_most_rows(spark):
    """Nine tenths of the rows share a text, and near copies hang on it: no row is lost where hot keys are split."""
    rng = random.Random(15)
    base = prose(rng, 150)
    texts = [base] * 900 + [base + f" tail{i}" for i in range(60)] + [prose(rng, 80) for _ in range(40)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    fps = [fingerprint(t) for _, t in rows]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    expected = Counter(zip((i for i, _ in rows), (f"{f:016x}" for f in fps), plain_components(fps, [i for i, _ in rows]), strict=True))
    assert Counter(map(tuple, got.collect())) == expected


def plain_components(fps, ids):
    """As brute_components(), over distinct fingerprints."""
    kinds = sorted(set(fps))
    low = brute_components(kinds, [min(i for i, f in zip(ids, fps, strict=True) if f == k) for k in kinds])
    return [low[kinds.index(f)] for f in fps]


def test_skewed_join_is_a_join(spark):
    from tesserae.llm.common import skewed_join

    rows = spark.createDataFrame([(0 if i % 3 else i % 50, i) for i in range(5000)], "k long, x long")
    lookup = rows.groupBy("k").agg({"*": "count"}).withColumnRenamed("count(1)", "n").withColumn("y", rows.k * 10).where("k < 40")
    twice = lookup.unionByName(lookup.withColumn("y", lookup.y + 1))
    for table in (lookup, twice):
        got = skewed_join(rows, table, "k", rows.x, 5000)
        assert sorted(got.columns) == ["k", "x", "y"]
        assert Counter(map(tuple, got.select("k", "x", "y").collect())) == Counter(map(tuple, rows.join(table.drop("n"), "k").select("k", "x", "y").collect()))


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows, ties and clashing columns through all stages; then no rows at all."""
    import corpus_pipeline

    rows, df = documents(spark)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)] + [(None, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    held = df
    found = kneser_ney.train(df, spark.read.parquet(str(tmp_path / "labels.parquet")))
    verdicts = Counter((r.doc_id, r.kept) for r in kneser_ney.classify(df, found).collect())
    held = corpus_pipeline.quality_classifier(spark, held, str(tmp_path))
    assert held.columns == df.columns
    assert Counter(r.doc_id for r in held.collect()) == Counter({i: n for (i, kept), n in verdicts.items() if kept})
    before = held.collect()
    held = corpus_pipeline.quality_rules(spark, held, str(tmp_path))

    def repetitive(text):
        w = words(text)
        longest = brute_repeats(w) if len(w) < 400 else None
        if longest is None:
            return None
        covered = lambda least: len({p for at, n in enumerate(longest) if n >= least for p in range(at, at + n)})
        most = max(longest, default=0)
        failed = len(w) < 50 or 100 * covered(3) > 50 * len(w)
        return failed or covered(repeats.MIN_WORDS) > repeats.MAX_COVERED * len(w) or most > repeats.MAX_REPEAT or most >= repeats.MIN_WORDS and most > repeats.MAX_REPEAT_SHARE * len(w)

    after = Counter(map(str, held.collect()))
    for r in before:
        if repetitive(r.text) is not None:
            assert (str(r) in after) == (not repetitive(r.text))
    rest = held.collect()
    held = corpus_pipeline.near_dedup(spark, held, str(tmp_path))
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [words(lower(t))] for i in range(max(1, len(w) - 4))}
    alike = lambda a, b: len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b))
    label = list(range(len(rest)))
    for i in range(len(rest)):
        for j in range(i):
            if label[i] != label[j] and alike(rest[i].text, rest[j].text):
                label = [label[j] if x == label[i] else x for x in label]
    kept = held.collect()
    assert len(kept) == len(set(label))
    first = {x: min((rest[i].doc_id is None, rest[i].doc_id or 0) for i in range(len(rest)) if label[i] == x) for x in set(label)}
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted(first.values())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({str(r.doc_id) for r in got}) == sorted({str(r.doc_id) for r in kept})
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / "empty" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0


def test_variants_find_all_links(spark):
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(30)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for c in centres for _ in range(12)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()
    label = {s: s for s in signed}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 4
        label[root(a)] = root(b)
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                assert root(a) == root(b)


def brute_repeats(w):
    n = len(w)
    best = [0] * n
    for size in range(1, n):
        seen = {}
        for i in range(n - size + 1):
            seen.setdefault(tuple(w[i : i + size]), []).append(i)
        again = [p for ps in seen.values() if len(ps) > 1 for p in ps]
        if not again:
            break
        for p in again:
            best[p] = size
    return best


def test_repetition(spark):
    rows, df = documents(spark)
    rows = [r for r in rows if len(r[1] or "") < 20_000]
    got = {(r.doc_id, r.n_words, r.word_chars): r for r in repeats.repetition(df).collect()}
    for r in rows:
        w = words(r[1])
        m = brute_repeats(w)
        g = got[(r[0], len(w), sum(map(len, w)))]
        cover = lambda least: len({j for i, x in enumerate(m) if x >= least for j in range(i, i + x)})  # noqa: B023, E731
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        n_repeat = len({j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)})
        lines = Counter(x for x in (r[1] or "").split("\n") if words(x))
        failed = len(w) < 50 or 100 * n_repeat > 50 * len(w)
        assert (g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (sum((r[1] or "").count(c) for c in "#*$%&|<>"), sum(lines.values()) - len(lines), n_repeat)
        assert (g.covered_words, g.longest_repeat, g.base_failed) == (cover(repeats.MIN_WORDS), max(m, default=0), failed)
        assert g.kept == (not failed and g.covered_words <= repeats.MAX_COVERED * len(w) and g.longest_repeat <= repeats.MAX_REPEAT)
    kept = repeats.unrepetitive(df)
    assert kept.columns == df.columns
    assert kept.count() == sum(r.kept for r in repeats.repetition(df).collect())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    rng = random.Random(3)
    odd = ["".join(rng.choice("ab '.,\n é1 ΣS\t\u0085") for _ in range(30)) for _ in range(500)]
    all_texts = [t or "" for t in texts()] + odd
    own = tokens.Encoder(vocabularies.path(name))
    ids, bounds = own.encode(pa.array(all_texts))
    for i, t in enumerate(all_texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids, t


def ids_of(name, text):
    t = tokenizers.Tokenizer.from_file(vocabularies.path(name))
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))


@pytest.mark.parametrize("delta", [False, True])
def test_token_files(spark, tmp_path, delta):
    rows, df = documents(spark)
    out = str(tmp_path / "tokens")
    name = "byte_bpe_50k.json"
    tokens.write(df, out, vocabularies.path(name), delta=delta)
    got = tokens.digests(spark, out).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    expected = Counter((r[0], len(i), crc(i)) for r in rows for i in [ids_of(name, r[1])])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == expected
    some = tokens.read_tokens(spark, out, [1, 2]).collect()
    assert {r.doc_id: list(r.tokens) for r in some} == {r[0]: ids_of(name, r[1]) for r in rows if r[0] in (1, 2)}
    assert tokens.read_lengths(spark, out).count() == len(rows)


def test_packing(spark):
    rows, df = documents(spark)
    name = "word_bpe_49k.json"
    got = packing.pack(df, vocabularies.path(name), length=256, block=4000).collect()
    by_sequence, by_doc = {}, {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 256
    wanted = [(r[0], ids_of(name, r[1])) for r in rows]
    assert sum(r.length for r in got) == sum(len(i) for _, i in wanted)
    for doc_id, ids in wanted:
        mine = [p for p in by_doc[(doc_id, len(ids))]]
        if sum(p.length for p in mine) == len(ids):
            at = 0
            for p in sorted(mine, key=lambda p: p.start):
                assert p.start == at and p.ids_crc32 == crc(ids[at : at + p.length])
                at += p.length
    padded = sum(n if n & (n - 1) == 0 else 256 for n in (sum(p.length for p in ps) for ps in by_sequence.values()))
    assert padded < 1.2 * sum(r.length for r in got)


def test_cheapest_cuts():
    rng = random.Random(0)
    for _ in range(200):
        at, place = [], 0
        for _ in range(rng.randrange(1, 40)):
            place += rng.randrange(1, 9)
            at.append(place)
        cost = [rng.choice([0, 1, 4]) for _ in at]
        price = lambda n: (n if n & (n - 1) == 0 else 16) + packing.SEQUENCE_COST
        places, best = [0, *at], [0]
        for j in range(1, len(places)):
            best.append(min(best[i] + price(places[j] - places[i]) + cost[j - 1] for i in range(j) if places[j] - places[i] <= 16))
        stops = packing.cut(packing.np.array(at), packing.np.array(cost), 16)
        total, before = 0, 0
        for s in stops:
            total += price(s - before) + cost[at.index(s)]
            before = s
        assert total == best[-1]


def test_sentencepieces(spark):
    library = pytest.importorskip("sentencepiece")
    path = vocabularies.path("piece_bpe_32k.model")
    model = library.SentencePieceProcessor(model_file=path)
    rng = random.Random(9)
    odd = ["".join(rng.choice("aeth .,\n é1 S漢▁") for _ in range(40)) for _ in range(400)]
    all_texts = [t or "" for t in texts()] + odd
    own = sentencepieces.Pieces(path)
    ids, bounds = own.encode(pa.array(all_texts))
    for i, t in enumerate(all_texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == model.encode(t), t
    rows, df = documents(spark)
    got = sentencepieces.round_trips(df, path).collect()
    assert len(got) == len(rows) and all(r.same for r in got)
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == Counter((r[0], crc(model.encode(r[1] or ""))) for r in rows)


def test_unigram_pieces_are_the_best_sum():
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    pytest.importorskip("sentencepiece")
    own = sentencepieces.Pieces(path, kind=sentencepieces.UNIGRAM)
    own.scores = [-math.log(2.0 + i) for i in range(len(own.scores))]
    own.unknown_score = min(own.scores) - sentencepieces.UNKNOWN_PENALTY
    for text in ("▁thereafter", "▁x漢y", "▁aaaaaaa", "▁Unbelievable!"):
        best = [0.0] + [-math.inf] * len(text)
        for j in range(1, len(text) + 1):
            for i in range(j):
                piece = own.ids.get(text[i:j])
                score = own.scores[piece] if piece is not None else own.unknown_score if j - i == 1 else -math.inf
                best[j] = max(best[j], best[i] + score)
        found = own.segment(text)
        assert math.isclose(sum(own.unknown_score if i < 0 else own.scores[i] for i in found), best[-1])


def test_pieces_of_a_batch_hold_the_same_words():
    """Parts of a batch are arrays of their own, as string kernels misread arrays that begin inside their buffers."""
    rows = [t for t in texts() for _ in range(3)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows, pa.string())], ["doc_id", "text"])
    for size in (200, 5_000, 1 << 20):
        at = 0
        for part in tokens.pieces(batch, 1, size):
            assert part.column(0).to_pylist() == list(range(at, at + len(part)))
            found = maxent.Texts.of(part.column(1))
            got = [found.words[i].as_py() for i in found.index.tolist()]
            assert got == [w for t in rows[at : at + len(part)] for w in words(lower(t))]
            measured = repeats.measures(part.column(1), 8, 3)
            assert measured["n_words"].tolist() == [len(words(t)) for t in rows[at : at + len(part)]]
            at += len(part)
        assert at == len(rows)


def test_maxent_base(spark):
    rows, df = documents(spark)
    got = maxent.score(df, rounds=1, most=50).collect()
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    counts = Counter()
    for r in rows:
        if not held(r[0]):
            counts.update([*words(lower(r[1])), "\n"])
    n, v = sum(counts.values()), len(counts)
    expected = sorted((str(r[0]), held(r[0]), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 5)) for r in rows for w in [[*words(lower(r[1])), "\n"]])
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == expected
    assert all(r.score < 0 for r in got)


def test_maxent_learns(spark):
    rng = random.Random(2)
    follow = {w: rng.sample("abcdefghijklmnop", 2) for w in "abcdefghijklmnop"}
    rows = []
    for i in range(400):
        w = [rng.choice("abcdefghijklmnop")]
        for _ in range(60):
            w.append(rng.choice(follow[w[-1]]))
        rows.append((i, " ".join(w)))
    got = [r for r in maxent.score(spark.createDataFrame(rows, "doc_id long, text string"), rounds=3).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.75 * sum(r.base_score for r in got)


def is_held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


@pytest.mark.parametrize("n_training", [0, 1, 2, 3])
def test_maxent_base_with_few_training_texts(spark, n_training):
    """The end counts as known as soon as one text has it, however rare it is."""
    training, aside = [i for i in range(60) if not is_held(i)][:n_training], [i for i in range(60) if is_held(i)][:2]
    texts = ["a c", "a b a", None, "d " * 3, "a z"]
    rows = [(i, texts[at]) for at, i in enumerate([*training, *aside])]
    got = {r.doc_id: r for r in maxent.score(spark.createDataFrame(rows, "doc_id long, text string"), rounds=1).collect()}
    counts = Counter()
    for i, t in rows:
        if i in training:
            counts.update([*words(t), "end"])
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        w = [*words(t), "end"]
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), abs=1e-9)
        assert math.isfinite(got[i].score) and got[i].score <= 0


def plain_maxent(rows, rounds, most):
    """score by doc_id: the model with loops and whole numbers."""
    import pandas as pd

    mask, classes, slots = (1 << 64) - 1, maxent.CLASSES, maxent.SLOTS
    texts = {i: [*words(lower(t)), "\n"] for i, t in rows}
    counts = Counter(w for i in texts if not is_held(i) for w in texts[i])
    top = sorted((w for w in counts if w != "\n" and counts[w] >= maxent.LEAST and len(w.encode()) <= maxent.LONGEST), key=lambda w: (-counts[w], w))[:most]
    common = [w for w in top if counts[w] > counts["\n"]] + ["\n"] + [w for w in top if counts[w] <= counts["\n"]]
    total = sum(counts[w] for w in common)
    leaf, before = {}, 0
    for w in common:
        leaf[w] = min(before * (classes - 1) * slots // total, (classes - 1) * slots - 1)
        before += counts[w]
    place = lambda w: (1 + leaf[w] // slots, leaf[w] % slots) if w in leaf else (0, 0)
    used = {place(w) for w in [*common, None]}
    hashed = {w: int(pd.util.hash_array(np.array([w], object), categorize=False)[0]) for t in texts.values() for w in t} | {"\n": maxent.END_HASH}

    def features(t, at):
        one = hashed[t[at - 1]] if at else maxent.EDGE_HASH
        two = hashed[t[at - 2]] if at > 1 else maxent.EDGE_HASH
        return [x * 0x9E3779B97F4A7C15 & mask for x in (one, two + 0x51ED27 & mask, one * 1_000_003 & mask ^ two)]

    bucket = lambda x, n: x >> 64 - (n.bit_length() - 1)
    softmax = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    events = [(features(texts[i], at), *place(w)) for i in texts if not is_held(i) for at, w in enumerate(texts[i])]
    shares, slot_shares = np.full(classes, 1e-3), np.array([[1e-3 if (c, s) in used else 0 for s in range(slots)] for c in range(classes)]) + 1e-9
    for _, c, s in events:
        shares[c] += 1
        slot_shares[c, s] += 1
    shares, slot_shares = shares / shares.sum(), slot_shares / slot_shares.sum(1, keepdims=True)
    bias = np.array([[math.log(slot_shares[c, s]) if (c, s) in used else maxent.NEVER for s in range(slots)] for c in range(classes)])
    by_class, by_slot = {}, {}

    def probabilities(x, c):
        z, y = np.log(shares), bias[c]
        for f, h in enumerate(x):
            z = z + by_class.get((f, bucket(h, maxent.BUCKETS)), 0)
            y = y + by_slot.get((f, bucket(h, maxent.SLOT_BUCKETS), c), 0)
        return softmax(z), softmax(y)

    for done in range(rounds + 1):
        seen, wanted = {}, {}
        for x, c, s in events:
            p, q = probabilities(x, c) if done else (shares, slot_shares[c])
            for f, h in enumerate(x):
                for key, n, one, share in (((f, bucket(h, maxent.BUCKETS)), classes, c, p), ((f, bucket(h, maxent.SLOT_BUCKETS), c), slots, s, q)):
                    seen.setdefault(key, np.zeros(n))[one] += 1
                    wanted[key] = wanted.get(key, 0) + share
        for key in seen:
            table, prior = (by_class, shares) if len(key) == 2 else (by_slot, slot_shares[key[2]])
            own = table.get(key, 0)
            gradient = seen[key] - wanted[key] - maxent.RIDGE * prior * own
            table[key] = own + np.log1p(np.maximum(gradient / (wanted[key] + (maxent.SMOOTHING + maxent.RIDGE) * prior), -0.9)) / 3
    rare = {w: c for w, c in counts.items() if w not in leaf}
    in_leaf = Counter()
    for w in common:
        in_leaf[place(w)] += counts[w]

    def word(w):
        if w in leaf:
            return counts[w] / in_leaf[place(w)]
        if not rare:
            return 1.0
        return (rare[w] - maxent.DISCOUNT if w in rare else maxent.DISCOUNT * len(rare)) / sum(rare.values())

    out = {}
    for i, t in texts.items():
        out[i] = 0.0
        for at, w in enumerate(t):
            c, s = place(w)
            p, q = probabilities(features(t, at), c)
            out[i] += math.log10(p[c] * q[s] * word(w))
    return out


@pytest.mark.parametrize("most", [maxent.COMMON, 12])
def test_maxent_against_plain_model(spark, most):
    rng = random.Random(12)
    follow = {w: rng.sample("abcdefghijklmnop", 3) for w in "abcdefghijklmnop"}
    rows = []
    for i in range(60):
        w = [rng.choice("abcdefghijklmnop")]
        for _ in range(25):
            w.append(rng.choice(follow.get(w[-1], "ab")) if rng.random() < 0.9 else f"rare{rng.randrange(40)}")
        rows.append((i, " ".join(w)))
    rows += [(60, None), (61, ""), (62, "É " * 5 + "x" * 100), (63, "Rare1 RARE1\nrare1")]
    got = {r.doc_id: r.score for r in maxent.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), most=most).collect()}
    expected = plain_maxent(rows, maxent.ROUNDS, most)
    assert set(got) == set(expected)
    for i, x in expected.items():
        assert got[i] == pytest.approx(x, rel=2e-4, abs=2e-4), i


def test_a_rare_word_in_every_text(spark):
    """One unseen and one overlong word on all rows: the join on them is split and nothing is lost."""
    long = "y" * 70
    rows = [(i, f"a b {long} unseen{'' if is_held(i) else i}") for i in range(200)]
    got = maxent.score(spark.createDataFrame(rows, "doc_id long, text string"), rounds=1).collect()
    training = [i for i, _ in rows if not is_held(i)]
    n, v = 5 * len(training), 4 + len(training)
    for r in got:
        assert (r.n_tokens, r.n_known) == (5, 4 if r.held_out else 5)
        assert r.base_score == pytest.approx(4 * math.log10((len(training) + 1) / (n + v + 1)) + math.log10((1 if r.held_out else 2) / (n + v + 1)), abs=1e-9)


def test_kneser_ney(spark):
    rng = random.Random(4)
    good = [(i, prose(rng, 120), "en" if i % 2 else "fr") for i in range(160)]
    bad = [(1000 + i, " ".join(f"{w}%%#" for w in prose(rng, 60).upper().split()), "en") for i in range(10)]
    odd = [(2000, None, "en"), (2001, "", None), (2002, prose(rng, 80), "xx"), (None, prose(rng, 80), None)]
    docs = spark.createDataFrame([(*r, 1.0) for r in good + bad + odd], "doc_id long, text string, lang string, perplexity double")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(120)] + [(1000, 0, 0), (None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    found = kneser_ney.train(docs, labels)
    dense = 10.0 ** found.model.dense().reshape(-1, kneser_ney.SYMBOLS)
    assert abs(dense.sum(1) - 1).max() < 1e-5
    got = {r.doc_id: r for r in kneser_ney.classify(docs, found).collect()}
    assert sum(got[r[0]].kept for r in good) >= 157
    assert not any(got[r[0]].kept for r in bad) and not got[2000].kept and not got[2001].kept and got[2002].kept and got[None].kept
    kept = kneser_ney.kept(docs, found)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in kneser_ney.classify(docs, found).collect())
    fitted = docs.where(f"doc_id < 120 and pmod(xxhash64(text), {kneser_ney.MEASURED_IN}) <> 0").select("text")
    tables = kneser_ney.fit(fitted)
    joined = {r.doc_id: r.log_perplexity for r in kneser_ney.score_by_join(docs.where("doc_id < 20"), tables).collect()}
    assert all(math.isclose(10 ** joined[i], got[i].perplexity, rel_tol=1e-4) for i in range(20))
    naive = naive_kneser_ney([r.text for r in fitted.collect()], found.model)
    for i in [130, 3, 1000, 2002]:
        text = next(r[1] for r in good + bad + odd if r[0] == i)
        assert math.isclose(naive_perplexity(naive, text, found.model), got[i].perplexity, rel_tol=1e-4)


def naive_perplexity(naive, text, model):
    edge = kneser_ney.EDGE
    symbols = [edge, edge, edge, *(int(model.symbols()[ord(c)]) for c in text), edge]
    return 10 ** (-sum(math.log10(naive(tuple(symbols[i - 3 : i]), symbols[i])) for i in range(3, len(symbols))) / (len(text) + 1))


def test_kneser_ney_reads_any_script(spark):
    """Beside a language of 60 common characters, texts in other scripts keep a perplexity that tells good from bad."""
    rng = random.Random(14)
    greek, cyrillic = "αβγδεζηθ", "абвгдежз"
    latin = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(6)) for _ in range(40)) for _ in range(150)]
    other = [" ".join("".join(rng.choice(letters[:4]) for _ in range(5)) for _ in range(20)) for letters in (greek, cyrillic) for _ in range(80)]
    rows = [(i, t, "la" if i < 150 else "el" if i < 230 else "ru") for i, t in enumerate(latin + other)]
    bad = [(1000, "".join(rng.choice(greek) + rng.choice("{}[]#") for _ in range(100)), "el"), (1001, "".join(rng.choice(cyrillic) + rng.choice("{}[]#") for _ in range(100)), "ru")]
    docs = spark.createDataFrame(rows + bad, "doc_id long, text string, lang string")
    found = kneser_ney.train(docs, spark.createDataFrame([(i, 1, 0) for i in range(310)], "doc_id long, quality int, toxic int"))
    symbols = found.model.symbols()
    assert len({int(symbols[ord(c)]) for c in greek[:4]}) > 1 and 0 < min(symbols[:0x10FFFF]) and max(symbols) < kneser_ney.SYMBOLS
    got = {r.doc_id: r for r in kneser_ney.classify(docs, found).collect()}
    assert sum(got[i].kept for i in range(310)) >= 305 and not got[1000].kept and not got[1001].kept
    naive = naive_kneser_ney([r.text for r in docs.where(f"doc_id < 1000 and pmod(xxhash64(text), {kneser_ney.MEASURED_IN}) <> 0").collect()], found.model)
    assert math.isclose(naive_perplexity(naive, other[0], found.model), got[150].perplexity, rel_tol=1e-4)


def naive_kneser_ney(all_texts, model):
    """The textbook recursion, over plain dictionaries."""
    table = model.symbols()
    counts = [None, *(Counter() for _ in range(4))]
    for t in all_texts:
        s = [kneser_ney.EDGE] * 3 + [int(table[ord(c)]) for c in t] + [kneser_ney.EDGE]
        counts[4].update(tuple(s[i - 3 : i + 1]) for i in range(3, len(s)))
    for order in (3, 2, 1):
        counts[order].update(g[1:] for g in counts[order + 1])
    discounts = [None]
    for order in (1, 2, 3, 4):
        n = [0, *(sum(c == k for c in counts[order].values()) for k in (1, 2, 3, 4))]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        discounts.append([0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) if n[k] and n[k + 1] else 0.5 for k in (1, 2, 3))])

    def p(context, symbol):
        order = len(context) + 1
        lower_p = p(context[1:], symbol) if context else 1 / 64
        own = {g: c for g, c in counts[order].items() if g[:-1] == context}
        total = sum(own.values())
        if not total:
            return lower_p
        d = discounts[order]
        weight = sum(d[min(c, 3)] for c in own.values()) / total
        c = own.get((*context, symbol), 0)
        return (c - d[min(c, 3)] if c else 0) / total + weight * lower_p

    return p


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert simhash.near_duplicates(empty).count() == 0
    assert repeats.repetition(empty).count() == 0
    assert maxent.score(empty, rounds=1).count() == 0
    assert packing.pack(empty, vocabularies.path("word_bpe_49k.json")).count() == 0
    assert sentencepieces.round_trips(empty, vocabularies.path("piece_bpe_32k.model")).count() == 0
    assert kneser_ney.classify(empty, kneser_ney.train(empty, labels)).count() == 0


def test_empty_token_files(spark, tmp_path):
    out = str(tmp_path / "none")
    tokens.write(spark.createDataFrame([], SCHEMA), out, vocabularies.path("byte_bpe_50k.json"))
    assert tokens.digests(spark, out).count() == 0
