"""Cases where operators once did less than the whole job."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tesserae.llm import html, kneser_ney, repeats, resemblance, simhash


def prose(rng, n):
    return " ".join("".join(rng.choice("aeiounrst") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def edited(rng, text, changes):
    w = text.split()
    for i in rng.sample(range(len(w)), changes):
        w[i] = "changed"
    return " ".join(w)


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_near_dedup_links_by_five_words(spark):
    rng = random.Random(6)
    base = [prose(rng, 120) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, edited(rng, t, 2)) for i, t in enumerate(base)] + [(200 + i, edited(rng, t, 9)) for i, t in enumerate(base)]
    texts = dict(rows)
    fp = {i: simhash.fingerprint(t.encode()) for i, t in rows}
    assert any((fp[i] ^ fp[100 + i]).bit_count() > simhash.MAX_BITS for i in range(40) if jaccard(texts[i], texts[100 + i]) >= 0.8)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    alike = lambda i, j: jaccard(texts[i], texts[j]) >= resemblance.SIMILARITY
    assert kept == {i for i, _ in rows if not any(j < i and alike(i, j) for j in (i % 100, 100 + i % 100))}
    assert len(kept) < 110 and {200, 201} <= kept


@pytest.mark.parametrize("block", [resemblance.BLOCK, 4_000])
def test_a_band_of_many_texts(spark, block):
    """Families that are not alike meet in one band; each is connected and none is linked to another, in one block or in many."""
    rng = random.Random(7)
    families = [prose(rng, 200) for _ in range(3)]
    texts = {i: edited(rng, families[i % 3], rng.randrange(1, 6)) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    distinct = spark.createDataFrame([(resemblance.node(t), [1], len(resemblance.shingles(t))) for t in texts.values()], "node long, bands array<long>, size long")
    number = {resemblance.node(t): i for i, t in texts.items()}
    label = {i: i for i in texts}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in resemblance.links(docs, distinct, block=block).collect():
        a, b = number[r.a], number[r.b]
        assert jaccard(texts[a], texts[b]) >= resemblance.SIMILARITY
        label[root(a)] = root(b)
    for a in texts:
        for b in range(a):
            if jaccard(texts[a], texts[b]) >= resemblance.SIMILARITY:
                assert root(a) == root(b)


def test_similar_sets():
    rng = np.random.default_rng(13)
    base = rng.integers(0, 1 << 40, 100, np.uint64)
    sets = [np.unique(np.r_[base[rng.random(100) > rng.choice([0.02, 0.1, 0.3])], rng.integers(0, 1 << 40, rng.integers(1, 15), np.uint64)]) for _ in range(150)]
    alike = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y)) >= 0.8
    for side in (None, rng.integers(0, 2, 150)):
        label = list(range(150))
        for a, b in resemblance.similar(sets, 0.8, side):
            assert alike(sets[a], sets[b]) and label[a] != label[b]
            label = [label[b] if x == label[a] else x for x in label]
        for a in range(150):
            for b in range(a):
                if (side is None or side[a] != side[b]) and alike(sets[a], sets[b]):
                    assert label[a] == label[b]


def test_shingles_and_nodes():
    assert len(resemblance.shingles("a b c d e f")) == 2 and len(resemblance.shingles("A b")) == 1 and not len(resemblance.shingles(" \n"))
    assert np.array_equal(resemblance.shingles("a B c"), resemblance.shingles(" A\tb c")) and resemblance.node("a B") == resemblance.node("A  b ") != resemblance.node("ab")
    assert resemblance.bands(resemblance.shingles(None)) == []


def test_each_limit_of_repetition_rejects(spark):
    rng = random.Random(8)
    lines = [prose(rng, 12) for _ in range(4)]
    block = prose(rng, 220)
    texts = {
        "plain": prose(rng, 300),
        "covered": "\n".join([*lines, prose(rng, 200), *lines[::-1]]),
        "share": prose(rng, 150) + " " + "one two " * 20 + prose(rng, 100),
        "long": "\n".join([block, prose(rng, 3000), block]),
        "little": "\n".join([lines[0], prose(rng, 200), lines[0]]),
    }
    docs = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    got = dict(zip(texts, sorted(repeats.repetition(docs).collect()), strict=True))
    assert not any(r.base_failed for r in got.values())
    assert {name: r.kept for name, r in got.items()} == {"plain": True, "covered": False, "share": False, "long": False, "little": True}
    fails = {name: (r.covered_words > repeats.MAX_COVERED * r.n_words, r.longest_repeat > repeats.MAX_REPEAT_SHARE * r.n_words, r.longest_repeat > repeats.MAX_REPEAT) for name, r in got.items()}
    assert (fails["covered"], fails["share"], fails["long"]) == ((True, False, False), (False, True, False), (False, False, True))
    assert {r.doc_id for r in repeats.unrepetitive(docs).collect()} == {0, 4}


def test_bounds_are_of_all_trusted_documents(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 30), "en" if i % 2 else "fr") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(600)], "doc_id long, quality int, toxic int")
    found = kneser_ney.train(docs, labels, most=40)
    assert {"en", "fr"} < set(found.bounds)
    is_aside = {r.doc_id for r in docs.where(f"pmod(xxhash64(text), {kneser_ney.MEASURED_IN}) = 0").collect()}
    x = {r.doc_id: np.log10(r.perplexity) for r in kneser_ney.classify(docs, found).collect()}
    own = {}
    for odd, lang in enumerate(("fr", "en")):
        parts = [[x[i] for i in range(odd, 600, 2) if (i in is_aside) == side] for side in (False, True)]
        low = min(np.quantile(v, kneser_ney.LOW) for v in parts)
        high = max(np.quantile(v, kneser_ney.HIGH) for v in parts)
        more = max(kneser_ney.SLACK, kneser_ney.WIDER * (high - low))
        own[lang] = low - more, high + more, len(parts[1])
    widest = min(a for a, _, _ in own.values()), max(b for _, b, _ in own.values())
    assert np.allclose(found.bounds[None], widest, atol=2e-5)
    for lang, (a, b, n) in own.items():
        assert np.allclose(found.bounds[lang], [(n * x + kneser_ney.FEW * w) / (n + kneser_ney.FEW) for x, w in zip((a, b), widest, strict=True)], atol=2e-5)


LONG = f"data-state='{'x' * 500}' onclick='a.hidden = true; id = 1'"


@pytest.mark.parametrize("attribute", ["class='sidebar'", "role=navigation", "hidden", "style='color: red; display:none'", f"class='{'wide ' * 100}sidebar'", "aria-hidden='true'", "ID='comments'"])
def test_attributes_count_wherever_they_stand(attribute):
    text = "<p>Words of an article that go on for a while, as they do.</p>"
    other = "<p>Words of a reader that go on for a while, and have no link.</p>"
    plain = "Words of an article that go on for a while, as they do."
    assert html.main_text(f"<article>{text}<div {LONG}>{other}</div></article>").count("Words") == 2
    assert html.main_text(f"<article>{text}<div {LONG} {attribute}>{other}</div></article>") == plain


def test_near_dedup_keeps_one_row_of_each_component(spark):
    rng = random.Random(10)
    a, b, c, d = (prose(rng, 80) for _ in range(4))
    rows = [(1, a, 0), (1, a, 0), (1, a, 0), (None, a, 1), (2, b, 2), (3, b, 3), (3, c, 4), (None, d, 5), (None, d, 5), (None, d.upper(), 6), (4, " ", 7), (5, None, 8), (6, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert [(i, t) for i, t in got if i is not None] == [(1, a), (2, b), (3, c), (4, " ")]
    assert [t.lower() for i, t in got if i is None] == [d.lower()]


def many_trusted(spark):
    """21000 trusted documents; only those whose ids have the largest hashes hold z, and none else."""
    docs = spark.range(21_000).selectExpr("id AS doc_id", "'en' AS lang", "row_number() OVER (ORDER BY xxhash64(id), id) > 20000 AS late")
    docs = docs.selectExpr("doc_id", "concat(if(late, 'zzz ', 'abc '), doc_id) AS text", "lang").cache()
    return docs, docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")


def test_the_model_counts_all_trusted_documents(spark):
    docs, labels = many_trusted(spark)
    found = kneser_ney.train(docs, labels)
    assert ord("z") in found.model.alphabet
    tables = kneser_ney.fit(docs.where(f"pmod(xxhash64(text), {kneser_ney.MEASURED_IN}) <> 0").select("text"))
    assert np.allclose(found.model.dense(), tables.collected().dense())
    assert ord("z") not in kneser_ney.train(docs, labels, most=20_000).model.alphabet


def test_rows_of_given_ids(spark, monkeypatch):
    """A full map of hashes leaves all rows to the join, an empty one none; repeated and null ids."""
    rows = spark.createDataFrame([(i % 900 if i < 1000 else None, str(i)) for i in range(1010)], "doc_id long, text string")
    ids = spark.range(0, 2000, 3).withColumnRenamed("id", "doc_id")
    for bits in (64, kneser_ney.MAP_BITS):
        monkeypatch.setattr(kneser_ney, "MAP_BITS", bits)
        got = sorted(int(r.text) for r in kneser_ney.among(rows, ids).collect())
        assert got == [i for i in range(1000) if i % 900 % 3 == 0]
        assert kneser_ney.among(rows, ids.where("doc_id < 0")).count() == 0


def test_the_pipeline_fits_on_all_trusted_documents(spark, tmp_path, monkeypatch):
    docs, labels = many_trusted(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    used = []
    monkeypatch.setattr(kneser_ney, "kept", lambda rows, classifier: used.append(classifier) or rows)
    corpus_pipeline.quality_classifier(spark, docs, str(tmp_path))
    assert ord("z") in used[0].model.alphabet
