"""Chat, page text, neighbours and the pipeline against plain Python."""

import hashlib
import html as entities
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tesserae.llm import chat, html, neighbours
from tesserae.llm import queries as llm_queries

MARKS = llm_queries.MARKS


def conversations():
    texts = ["hello", None, "", MARKS, "a \\ b <| c", "<\\|im_end|>\\n", "line\nline\n", "é𝄞", "<|im_end|>\n<|im_start|>user\nx", "\\", "\\\\<|"]
    rng = random.Random(1)
    rows = []
    for conv in range(12):
        for turn in range(conv):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "assistant"]), rng.choice(texts), "k", 1))
    rows += [(50, 3, "user", "late", "k", 1), (50, 1, "assistant", "early", "k", 1), (50, 1, "assistant", "early", "k", 1), (50, None, None, "no turn", "k", 1), (None, 0, "assistant", "no id", "k", 1), (60, 0, "odd\nrole\\n<|", "x", "k", 1)]
    return rows


def test_chat(spark):
    rows = conversations()
    got = {r.conv_id: r for r in chat.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example string, spans int")).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort()
        g = got[conv]
        loss = "".join(t for _, _, role, t in turns if role == "assistant")
        assert g.n_turns == len(turns) and g.loss_chars == len(loss)
        assert g.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, _, role, t in turns).encode()).hexdigest()
        assert g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_examples_have_all_turns_before(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(7)]
    whole = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    texts, examples = whole.select("conv_id", "text"), whole.select("conv_id", F.posexplode("spans").alias("example", "s")).select("conv_id", "example", "s.*")
    got = chat.with_text(texts, examples).orderBy("example").collect()
    before = ""
    expected = []
    for _, _, role, t in rows:
        head = f"<|im_start|>{role}\n"
        if role == "assistant":
            expected.append((before + head, t))
        before += f"{head}{t}<|im_end|>\n"
    assert [(r.context, r.target) for r in got] == expected


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(empty).count() == 0


PAGES = {
    "<html><head><title>No</title><script>var a='<p>no</p>';</script></head><body><nav><a href='/'>Home</a></nav><article><h1>Head &amp; line</h1><p>First  part\n of it.<p>Second <b>bold</b> part.</p><p>One</p></article><footer>&copy; all</footer></body></html>": "Head & line\nFirst part of it.\nSecond bold part.\nOne",
    "<body><article><p>Text of some length stands in here.</p><!-- <p>hidden</p> --><div class='comments'><p>I say what a reader says, and at some length too.</p></div></article></body>": "Text of some length stands in here.",
    "<body><article><p>cut off in the middle of a &am": "cut off in the middle of a &am",
    "<article><p style='display:none'>hidden</p><p>&lt;b&gt; &#233;&nbsp;x</p></article>": "<b> é x",
    "": "",
    "<nav><a href='/x'>only a menu</a></nav>": "",
    "<p": "",
}


def test_page_text(spark):
    rows = [(i, f"u{i}", p, "t", 1) for i, p in enumerate(PAGES)] + [(None, None, None, "t", 1)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    found = {r.page_id: r for r in got}
    for i, expected in enumerate(PAGES.values()):
        assert (found[i].text, found[i].n_chars, found[i].url) == (expected, len(expected), f"u{i}")
    assert found[None].text == "" and len(got) == len(rows)


def test_tree_fits_its_labels():
    x, y = html.labelled()
    assert (html.decide(html.tree(), x) == y).mean() > 0.99
    assert 0.3 < y.mean() < 0.7
    assert html.tree()[0] < len(html.NUMBERS)  # numbers are asked first


def plain_article(page):
    """The article's blocks by splitting at tags: for the test pages' plain markup."""
    inside = page.split("<article>", 1)[1].split("</article>")[0].split("<footer>")[0] if "<article>" in page else ""
    parts = re.split(r"</?(?:p|h1|br|li|ul)\b[^>]*>", inside)
    found = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"</?[a-z][^>]*>|<!--.*?-->", "", p))).strip() for p in parts]
    return "\n".join(p for p in found if p)


def test_test_pages_hold_articles_only(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in pages.join(html.extract(pages).select("page_id", "text"), "page_id").collect():
        assert r.text == plain_article(r.html)


def made_page(rng):
    """A page of elements that say what they are, and its article's blocks."""
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(n))
    menu = "<nav><ul>" + "".join(f"<li><a href=x>{words(rng.randrange(1, 4))}</a></li>" for _ in range(rng.randrange(1, 8))) + "</ul></nav>"
    advert = f'<div class="{rng.choice(["ad", "advert-top", "sponsored", "cookie-notice"])}">{words(rng.randrange(1, 40))}</div>'
    tag, found, parts = rng.choice(["article", "main"]), [], [rng.choice(["", menu]), rng.choice(["", advert])]
    parts += [f"<{tag}>", rng.choice(["", "", menu])]
    for _ in range(rng.randrange(1, 8)):
        n = rng.choice([1, 2, 3, 5, 8, 13, 30, 100, 200])
        text, cut = words(n), rng.randrange(n + 1)
        found.append(text)
        linked = " ".join(text.split()[:cut]) + " <a href=y>" + " ".join(text.split()[cut:]) + "</a>"
        parts.append(rng.choice([f"<p>{text}</p>", f"<p>{text}", f"<h2>{text}</h2>", f"<blockquote>{text}</blockquote>", f"<p>{linked}</p>", f"<ul><li><a href=z>{text}</a></li></ul>"]))
        parts += [f"<aside>{words(20)}</aside>"] if rng.random() < 0.1 else []
    comments = f'<section class="comments"><p>{words(rng.randrange(3, 80))}</p><p>{words(5)}</p></section>'
    parts += [rng.choice(["", comments]), f"</{tag}>", rng.choice(["", f'<div class="sidebar"><p>{words(rng.randrange(3, 80))}</p></div>'])]
    parts.append(rng.choice(["", f"<footer>{words(rng.randrange(3, 30))} <a href=q>{words(2)}</a></footer>"]))
    return "".join(parts), "\n".join(found)


def test_made_pages():
    rng = random.Random(3)
    for _ in range(800):
        page, expected = made_page(rng)
        assert html.main_text(page) == expected, page


def test_numbers_stand_against_names():
    words = " ".join(["word"] * 90)
    assert html.main_text(f'<div class="discussion"><p>{words}</p></div>') == words
    assert html.main_text(f'<div class="content"><a href="/x">{words}</a></div>') == ""
    assert html.main_text(f"<div><a href='/'>Home</a> <a href='/m'>More</a></div><div><p>{words}</p><p>Short.</p><p>{words}</p></div>") == f"{words}\nShort.\n{words}"


def test_scripts_and_formulas():
    page = """<article><p>before</p><script>var a = "<p class='"; // <!-- </p></script><p>it's after</p><math><mi>x</mi></math><p>end</p></article>"""
    assert html.main_text(page) == "before\nit's after\nx\nend"


def test_features_against_plain_count():
    page = "<nav><a href=x>one two</a></nav><article><p>a b c <a>d</a></p><p>e</p></article>"
    rows = [(2, 1.0), (4, 0.25), (1, 0.0)]
    x = html.features(html.blocks(page))
    for i, (n, share) in enumerate(rows):
        around = [rows[j] if 0 <= j < 3 else (0, 0.0) for j in (i - 1, i + 1)]
        assert x[i, :6].tolist() == [n, share, *around[0], *around[1]]


def test_long_pages_repeats_and_memory(spark):
    html._remembered.cache_clear()
    long = "<article>" + "".join(f'<p id="p{i}" data-n="{"n" * (i % 700)}">word {i} of a long page</p>' for i in range(20_000)) + "</article>"
    deep = "<article>" + "<span>" * 30_000 + "deep words stand here, all of them" + "</b>" * 30_000 + "<br>" * 1_000
    rows = [(1, "u", long), (1, "u", long), (2, "u", deep), (3, "u", "x" * 2_000_000)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == 4 and texts[1].count("\n") == 19_999 and texts[2] == "deep words stand here, all of them" and texts[3] in ("", "x" * 2_000_000)
    assert html.main_text(long) == texts[1]
    assert html._remembered.cache_info().currsize <= html.REMEMBERED
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def vectors(n, d, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_neighbours_recall_and_ties(spark):
    x = vectors(1500, 32)
    x[100:160] = x[100]  # more copies than are asked for
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    bad = [(9000, None, 0), (9001, [], 0), (9002, [0.0] * 32, 0), (9003, [float("nan")] + [1.0] * 31, 0), (9004, [None] + [1.0] * 31, 0), (9005, [1.0] * 8, 0), (None, [1.0] * 32, 0), (9006, [float("inf")] + [1.0] * 31, 0)]
    df = spark.createDataFrame(rows + bad + [rows[7]], "vec_id long, embedding array<float>, score int")
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, k=20, block_rows=400, block_queries=40).collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(range(0, 1500, 20))
    exact = x.astype(np.float64)
    hits = 0
    for q, found in got.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21)) and q not in {r.vec_id for r in found}
        assert all(abs(r.score - float(exact[q] @ exact[r.vec_id])) < 1e-12 for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        products = exact @ exact[q]
        order = sorted((i for i in range(1500) if i != q), key=lambda i: (-round(products[i], 12), i))[:20]
        hits += len(set(order) & {r.vec_id for r in found})
    assert hits / (20 * len(got)) > 0.9
    assert [r.vec_id for r in got[100]] == list(range(101, 121))


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = neighbours.search(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 0.5), (2, -1.0)]
    assert neighbours.search(df.where("vec_id > 5"), F.col("vec_id") % 20 == 0).count() == 0


def test_anisotropic_codes_lose_less_along_the_vector():
    x = vectors(2000, 32, 3).astype(np.float64)
    q = neighbours.fit(x)
    flat = neighbours.Quantiser(q.centres, 1.0)

    def along(quantiser):
        packed, errors = neighbours.encode(quantiser, x)
        codes = np.stack([packed >> 4, packed & 15], 2).reshape(len(x), -1)
        back = q.centres[np.arange(q.pairs)[None, :], codes].reshape(len(x), -1)
        assert np.allclose(errors, np.linalg.norm(x - back, axis=1))
        return np.abs(((x - back) * x).sum(1)).mean()

    assert along(q) < along(flat)


def odd_norms(kind):
    x = vectors(8000, 64, 5).astype(np.float64)
    if kind == "lognormal":
        return x * np.exp(2 * np.random.default_rng(6).normal(size=(len(x), 1)))
    x[20] = {"huge": x[20] * 1e30, "tiny": x[20] * 1e-200, "largest": np.sign(x[20]) * np.finfo(float).max, "smallest": np.sign(x[20]) * 5e-324, "unit": x[20]}[kind]
    return x


@pytest.mark.parametrize("kind", ["unit", "lognormal", "huge", "tiny", "largest", "smallest"])
def test_recall_on_any_finite_vectors(kind):
    """At the size of a usual block, against brute force in double precision."""
    x, k = odd_norms(kind), 20
    q = neighbours.fit(x)
    units, norms = neighbours.directions(x)
    codes, errors = neighbours.encode(q, units)
    asked = np.r_[20, np.arange(0, 8000, 160)]
    for sure, least in ((neighbours.SURE, 0.95), (None, 1.0)):
        hits = 0
        for i, (some, _, _) in zip(asked, neighbours.finalists(q, codes, errors, norms, units[asked], k + 1, sure), strict=True):
            score = neighbours.products(x, np.repeat(x[i : i + 1], len(x), 0))
            score[i] = -np.inf
            hits += len(set(np.lexsort((np.arange(len(x)), -score))[:k].tolist()) & set(some.tolist()))
        assert hits >= least * k * len(asked), (kind, sure)


def test_cells_give_on_no_more_than_the_best(spark, monkeypatch):
    """Rows so close to each other that codes can't tell them apart are all finalists; tables between steps hold k + 1 of them a block."""
    x = (vectors(1, 32) + 1e-4 * vectors(2000, 32, 9)).astype(np.float64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    ids, write = [], neighbours.written

    def spied(table, name):
        out = write(table, name)
        if "ids" in out.columns:
            ids.append(out.agg(F.sum(F.size("ids"))).first()[0])
        return out

    monkeypatch.setattr(neighbours, "written", spied)
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, k=5, block_rows=500).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert ids and max(ids) <= 100 * 4 * 6
    for i, found in got.items():
        score = neighbours.products(x, x[i : i + 1])
        assert [found[r] for r in range(1, 6)] == [j for j in np.lexsort((np.arange(2000), -score)).tolist() if j != i][:5]


def test_products_scale_by_powers_of_two():
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(50, 8)), rng.normal(size=(50, 8))
    assert np.allclose(neighbours.products(x, y), (x * y).sum(1), rtol=1e-15, atol=1e-15)
    assert neighbours.products(np.array([[1e300, 1e300]]), np.array([[1e300, -1e300]]))[0] == 0
    assert neighbours.products(np.array([[1e300, 1e300]]), np.array([[1e300, 1e300]]))[0] == np.inf
    assert neighbours.products(np.array([[1e-200, 0.0]]), np.array([[1e150, 1e150]]))[0] == pytest.approx(1e-50)


def test_one_vector_on_most_rows(spark):
    """Copies of one vector, which is also the best answer to all: every query still finds its own best, exactly."""
    x = vectors(600, 16, 8).astype(np.float64)
    x[100:500] = 3 * np.abs(x[100])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, k=5, sure=None, block_rows=100, block_queries=10).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 600, 20))
    for i, found in got.items():
        score = neighbours.products(x, np.repeat(x[i : i + 1], 600, 0))
        order = [j for j in np.lexsort((np.arange(600), -score.round(12))).tolist() if j != i][:5]
        assert [found[r][0] for r in range(1, 6)] == order
        assert np.allclose([found[r][1] for r in range(1, 6)], score[order])


def test_pipeline(spark):
    pytest.importorskip("public_tokenizers")
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, held, sf_dir)
        assert after.columns == docs.columns, name
        assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in held.collect()}
        held = after
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in held.collect()}
    whole = Counter()
    for r in got:
        whole[r.doc_id] += r.length
    assert all(whole[r.doc_id] == r.doc_tokens for r in got)
