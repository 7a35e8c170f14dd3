import random
import zlib

import numpy as np
import pytest

from tests.llm.conftest import SMALL, needs_data
from varak.llm import langid as I
from varak.llm import toxicity as X

WORDS = {
    "en": "the house and water with light of spring when they walk through green fields".split(),
    "de": "das haus und wasser mit licht der frühling wenn sie durch grüne felder gehen".split(),
    "fr": "la maison et eau avec lumière du printemps quand ils marchent dans les champs verts".split(),
}


def corpus(n=300, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(12, 60))), lang, "s"))
    return rows


def test_languages_are_told_apart(docs):
    rows = corpus()
    edge = [(1000, None, "en", "s"), (1001, "", "en", "s"), (1002, "12 !?", "de", "s"), (None, rows[0][1], None, None), (1003, " ".join(WORDS["de"] * 40_000), None, None)]
    got = I.identify(docs(rows + edge)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + 5
    held = [(r[2], by[r[0]].lang_pred) for r in rows if by[r[0]].held_out]
    assert held and sum(a == b for a, b in held) / len(held) > 0.97
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(300))
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "de"]
    assert by[None].lang_pred == rows[0][2] and all(0 <= r.score <= 1 for r in got)


def test_held_out_labels_and_other_columns_do_not_matter(docs):
    rows = corpus(120)
    spoiled = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s + "?") for i, t, lang, s in rows]
    a, b = (sorted((r.doc_id, r.lang_pred, r.score) for r in I.identify(docs(x)).collect()) for x in (rows, spoiled))
    assert a == b


def test_langid_of_edge_tables(docs):
    assert I.identify(docs([])).count() == 0
    assert I.identify(docs([(1, "some text")])).first().lang_pred == "und"  # nothing to learn from
    one = I.identify(docs([(i, "some text", "en", "s") for i in range(9)]).withColumnRenamed("n_chars", "lang_pred"))
    assert {r.lang_pred for r in one.collect()} == {"en"}


@pytest.mark.parametrize("n", [2, 3, 5, 12, 40])
def test_codewords_differ_in_many_bits(n):
    book = I.codebook(n)
    apart = ((book.shape[1] - book @ book.T) / 2)[~np.eye(n, dtype=bool)].min()
    assert apart >= (1 if n == 2 else 2 if n == 3 else 4)
    assert (np.abs(book.sum(axis=0)) < n).all()


def test_all_of_many_languages_are_learned(docs, monkeypatch):
    rng, rows = random.Random(8), []
    for k in range(80):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(6)]
        rows += [(len(rows) + i, " ".join(rng.choices(words, k=20)), f"l{k:02}", "s") for i in range(8 if k < 79 else 60)]
    df = docs(rows)
    for budget in (8192, 320, 20):  # all rows, about 4 of each, and the least hash of some
        monkeypatch.setattr(I, "FIT_BUDGET", budget)
        model = I.fit(df)
        assert len(model.langs) == 80
        right = [model.langs[k] == r[2] for k, r in zip(model.predict([r[1] for r in rows])[0], rows)]
        assert np.mean(right) > (0.95 if budget > 20 else 0.5)


def test_repeated_ids_and_texts_are_drawn_by_text(docs, monkeypatch):
    rng, sizes, train = random.Random(12), [], I.train
    monkeypatch.setattr(I, "train", lambda x, y, *a, **k: sizes.append(np.bincount(y).tolist()) or train(x, y, *a, **k))
    text = lambda lang: " ".join(rng.choices(WORDS[lang], k=20))
    rows = [(0, text("en"), "en", "s") for _ in range(3000)] + [(i, text("de"), "de", "s") for i in range(300)]  # one id
    rows += [(1000 + i, "un seul texte pour tous", "fr", "s") for i in range(800)]  # one text
    model = I.fit(docs(rows))
    assert model.langs == ("de", "en", "fr") and 300 < sizes[0][1] < 500 and sizes[0][2] == 1
    assert [model.langs[k] for k in model.predict([text("en"), text("de"), "un seul texte pour tous"])[0]] == ["en", "de", "fr"]


def test_many_codewords_and_losses():
    book = I.codebook(6000)
    assert len(np.unique(book, axis=0)) == 6000
    rng = np.random.default_rng(1)
    book, f = I.codebook(12), rng.normal(size=(5, 4096))
    share = rng.random(book.shape)
    model = I.Model(tuple("abcdefghijkl"), book, share, rng.normal(size=(4096, book.shape[1])), rng.normal(size=book.shape[1]), 0.0)
    bits = f @ model.weights + model.bias
    want = [[sum(share[k] * np.logaddexp(0, -book[k] * b)) for k in range(12)] for b in bits]
    assert np.allclose(model.losses(f), want)


def test_ambiguity_is_flagged():
    rows = corpus(200)
    x = I.trigram_counts([r[1] for r in rows])
    langs = tuple(sorted(WORDS))
    model = I.train(x, np.array([langs.index(r[2]) for r in rows]), langs, margin=0.2)
    mixed = " ".join(a for pair in zip(WORDS["en"], WORDS["fr"]) for a in pair)
    pure, doubt = model.predict([" ".join(WORDS["en"]), mixed])[2]
    assert doubt or not pure
    assert not pure


def toxic_corpus(n=500, seed=6):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        parts = [" ".join(rng.choice(WORDS["en"]) for _ in range(8)) for _ in range(rng.randint(1, 12))]
        bad = rng.random() < 0.3
        if bad:
            parts[rng.randrange(len(parts))] += " you " + rng.choice(["vilewort", "grimlout", "foulbert"])
        rows.append((i, ". ".join(parts) + ".", "en", "s"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_finds_documents_and_sentences(spark, docs):
    rows, labels = toxic_corpus()
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    edge = [(1000, None), (1001, ""), (None, "you VILEWORT! nice day."), (1002, "fine day. " * 50_000), (1002, "grimlout. " * 3)]
    df = docs(rows + edge)
    model = X.fit(df, marks)
    got = X.score(df, model).collect()
    by = {r.doc_id: r for r in got if r.doc_id != 1002}
    truth = {i: t for i, _, t in labels}
    assert len(got) == len(rows) + 5
    held = [i for i in truth if by[i].held_out]
    assert held and sum(by[i].predicted == truth[i] for i in held) / len(held) > 0.97
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    assert by[1000].score == by[1001].score < 0.5 and by[1000].worst_start is None
    assert by[None].predicted == 1 and rows and "you VILEWORT!"[by[None].worst_start : by[None].worst_end] == "you VILEWORT"
    assert all(r.predicted == (r.score >= 0.5) for r in got)
    found = X.offending_sentences(df, model).where("doc_id is not null and doc_id < 1000").collect()
    assert found and all(any(b in r.sentence for b in ("vilewort", "grimlout", "foulbert")) for r in found)


def test_noisy_or_gradient_and_score():
    rng = np.random.default_rng(3)
    bags = [(int(rng.integers(2)), [sorted(set(rng.integers(0, 6, rng.integers(1, 4)).tolist())) for _ in range(rng.integers(0, 4))]) for _ in range(30)]
    fitted, z = X.NoisyOr(bags, 6), np.concatenate([rng.normal(size=6), [-1.0, -2.0]])
    sig = lambda x: 1 / (1 + np.exp(-x))
    direct = 0.0
    for y, parts in bags:
        safe = 1 - sig(z[7])
        for s in parts:
            safe *= 1 - sig(z[6] + sum(z[f] for f in s))
        direct -= np.log(1 - safe if y else safe) / len(bags)
    value, grad = fitted.loss(z)
    assert value == pytest.approx(direct + 5e-5 * (z[:6] ** 2).sum() + 5e-3 * (z[6] + 4) ** 2)
    for k in range(8):
        step = np.eye(8)[k] * 1e-5
        assert grad[k] == pytest.approx((fitted.loss(z + step)[0] - fitted.loss(z - step)[0]) / 2e-5, abs=1e-6)
    model = X.Model({b"bad": 2.0, b"baddes*": 1.5, b"worse": 3.0}, -2.5, 0.01)
    text = "All is fine. bad BAD, worse! É baddest\n\n nothing. worse? 😀"
    safe = 0.99 * (1 - sig(2.0 + 3.0 - 2.5)) * (1 - sig(1.5 - 2.5)) * (1 - sig(3.0 - 2.5))
    for _ in range(2):  # also with words already seen
        seen, marked = set(), {}
        score, found, n = model.score(text, seen, marked)
        assert score == pytest.approx(1 - safe) and len(found) == 3 and n == 6
        assert text.encode()[found[1][0] : found[1][1]].decode() == " É baddest"


def test_repeated_ids_give_one_text(spark, docs, monkeypatch):
    rows, labels = toxic_corpus(200)
    rows += [(3, f"hot vilewort number {k}.", "en", "s") for k in range(500)]
    sizes, made = [], X.NoisyOr.__init__
    monkeypatch.setattr(X.NoisyOr, "__init__", lambda self, bags, n: sizes.append(len(bags)) or made(self, bags, n))
    X.fit(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sizes == [sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _, _ in labels)]


@needs_data
def test_toxicity_of_held_out_documents(spark):
    folder = SMALL.replace("0.001", "0.1")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [r for r in X.query(spark, folder).where("held_out").select("doc_id", "predicted").collect() if r.doc_id in truth]
    caught, toxic = sum(r.predicted and truth[r.doc_id] for r in got), sum(truth[r.doc_id] for r in got)
    assert caught >= 0.88 * toxic and sum(r.predicted and not truth[r.doc_id] for r in got) <= 0.01 * len(got)


@needs_data
def test_languages_of_held_out_documents(spark):
    folder = SMALL.replace("0.001", "0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").where("lang is not null and text rlike '[A-Za-z]'").collect()}
    got = I.query(spark, folder).collect()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) >= len(truth) and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.99 * len(held) > 100
    assert sum(r.ambiguous for r in got) <= 0.01 * len(got)


def test_rare_toxicity_is_learned(spark, docs):
    rng, rows, labels = random.Random(9), [], []
    for i in range(6000):
        parts = [" ".join(rng.choice(WORDS["en"]) for _ in range(8)) for _ in range(4)]
        if i % 150 == 0:
            parts[rng.randrange(4)] += " you vilewort"
        rows.append((i, ". ".join(parts) + ".", "en", "s"))
        labels.append((i, 1, int(i % 150 == 0)))
    df = docs(rows)
    got = X.score(df, X.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), fit_rows=200)).collect()
    assert {r.doc_id for r in got if r.predicted} == {i for i, _, y in labels if y}
    assert np.mean([r.score for r in got if r.doc_id % 150]) < 0.01  # not the drawn share


def test_toxicity_ignores_held_out_labels(spark, docs):
    rows, labels = toxic_corpus(200)
    spoiled = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    out = []
    for marks in (labels, spoiled):
        df = docs(rows)
        out.append(sorted((r.doc_id, r.score) for r in X.score(df, X.fit(df, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))).collect()))
    assert out[0] == out[1]


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)], [(1, 1, 0)], [(1, 1, None), (None, 1, 1)]])
def test_toxicity_of_edge_tables(spark, docs, labels):
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for rows in ([], [(1, "a text."), (1, "a text."), (2, None)]):
        df = docs(rows).withColumnRenamed("n_chars", "score")
        got = X.score(df, X.fit(df, marks)).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)


@needs_data
def test_queries_have_the_columns(spark):
    assert I.query(spark, SMALL).columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    assert X.query(spark, SMALL).columns[:4] == ["doc_id", "held_out", "score", "predicted"]
