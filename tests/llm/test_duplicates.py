import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from tests.compare import same
from tests.llm.conftest import SMALL, needs_data
from varak.llm import decontamination as D
from varak.llm import recompression as R
from varak.llm import simhash as S


def slow_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


TEXTS = [None, "", " \n", "A", "a", "a b", "A B c", "a b c", "a b c d", "É Ä z\x1cy x", "w " * 5000, "a b c d"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert S.fingerprint(text or "") == slow_print(text)


def near_corpus(seed=9):
    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(40):
        words = [rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(rng.randint(40, 200))]
        for _ in range(rng.randint(1, 5)):
            copy = list(words)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = "edited"
            rows.append((n * 3 % 101 + (n // 101) * 101, " ".join(copy)))
            n += 1
    return rows


def links(rows):
    prints = [slow_print(t) for _, t in rows]
    near = [[j for j in range(len(rows)) if bin(prints[i] ^ prints[j]).count("1") <= 2] for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min(root[j] for j in near[i]) for i in range(len(rows))]
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        out.append((d, format(prints[i], "016x"), len(near[i]) - 1, min(ids, default=None)))
    return sorted(out, key=repr)


def test_near_duplicates_equal_brute_force(docs):
    rows = near_corpus() + list(enumerate(TEXTS, 900)) + [(None, "a b c"), (None, "alone here with no id at all"), (900, None)]
    df = docs(rows).withColumnRenamed("n_chars", "fp")
    assert sorted((tuple(r) for r in S.near_duplicates(df).collect()), key=repr) == links(rows)
    kept = S.representatives(df)
    assert kept.columns == df.columns
    classes = {(c, None if c is not None else f) for _, f, _, c in links(rows)}
    got = kept.collect()
    assert len(got) == len(classes) and sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(c for c, _ in classes if c is not None)


def test_empty_tables(docs):
    assert S.near_duplicates(docs([])).count() == S.representatives(docs([])).count() == R.remove_repeats(docs([])).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_no_pair_is_lost(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2)
    prints = set(base.tolist())
    for b in base.tolist():
        for _ in range(4):
            for k in rng.choice(64, rng.integers(1, radius + 3), replace=False).tolist():
                b ^= 1 << k
            prints.add(b)
    u = np.array(sorted(prints), dtype=np.uint64).view(np.int64)
    want = {(min(a, b), max(a, b)) for i, a in enumerate(u.tolist()) for b in u[i + 1 :].tolist() if bin((a ^ b) & (2**64 - 1)).count("1") <= radius}
    df = spark.createDataFrame([(int(x),) for x in u], "fp long")
    for hot in (64, 1):  # by pairs, and by enumeration
        got = [tuple(r) for r in S.near_pairs(df, radius, hot).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_components_and_representatives_of_hubs(spark, docs, monkeypatch):
    from varak.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 50)
    edges = [(0, i) for i in range(1, 4000)] + [(i, i + 10_000) for i in range(1, 4000)] + [(50_000, 50_001)]
    got = dict(map(tuple, S.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()))
    assert len(got) == 8001 - 2 + 2 and {got[i] for i in range(4000)} == {0} and got[13_999] == 0 and got[50_001] == 50_000
    rows = [(None, "a text that many rows have in common")] * 300 + [(i, f"text {i} of its own {i * i} words") for i in range(20)] + [(4, "text 4 of its own 16 words")] * 80
    df = docs(rows).repartition(5).withColumnRenamed("n_chars", "_sim1")
    kept = S.representatives(df)
    assert kept.columns == df.columns and sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted({c if c is not None else -1 for _, _, _, c in links(rows)})


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1000, 1002)]
    random.Random(1).shuffle(edges)
    got = dict(map(tuple, S.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000, 1002: 1000}


ITEM = "seven grey herons stood by the quiet river while the miller counted his sacks of flour and sang an old tune about the moon"


def test_contamination(spark, docs):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    filler = lambda n: [rng.choice(words) for _ in range(n)]
    item = ITEM.split()
    edited = [w if i % 5 else "changed" for i, w in enumerate(item)]
    rows = [
        (1, " ".join(filler(50) + item + filler(50))),
        (2, " ".join(filler(50) + edited + filler(30))),
        (3, " ".join(filler(40) + item[: len(item) // 2] + filler(40))),
        (4, " ".join(filler(200))),
        (5, " ".join(filler(30) + item[:5] + filler(30))),
        (6, ITEM.upper().replace(" ", ",\n")),
        (None, ITEM),
        (8, None),
        (9, ""),
        (10, " ".join(filler(100_000) + item)),
        (6, " ".join(filler(9))),
    ] + [(100 + i, " ".join(filler(60))) for i in range(60)]
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, "too short"), (4, ""), (5, " ".join(f"z{i}" for i in range(20)))], "item_id long, text string")
    df = docs(rows).withColumnRenamed("n_chars", "item_id")
    got = D.contaminated(df, bench).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 2, 3, 6, 10] and {r[1] for r in got} == {1}
    by = {r.doc_id: r for r in got}
    assert (by[1].score, by[1].first_word, by[1].end_word) == (1.0, 50, 50 + len(item)) and by[6].score == 1.0 and by[2].score < 1
    assert D.clean(df, bench).count() == len(rows) - 6
    assert D.contaminated(df, bench.limit(0)).count() == 0 and D.contaminated(df.limit(0), bench).count() == 0


def align_without_seeds(rows, bench):
    """The contaminated (document, item) pairs and scores by aligning every item with every whole text."""
    out = []
    for d, text in rows:
        for i, item in bench:
            block = D.Items([(i, item)])
            for own in block.words:
                score = D.align(own, block.numbers(text))[0]
                if score >= D.least_scores(len(own), D.THRESHOLD, D.LONG_SCORE):
                    out.append((d, i, score / (D.MATCH * len(own))))
    return sorted(out)


def test_frequent_passages_are_contaminated(spark, docs):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    items = [(1, " ".join(f"a{i}" for i in range(40))), (2, " ".join(f"b{i}" for i in range(15)))]
    rows = []
    for d in range(120):  # every second document has a part of an item; the rest of the item is nowhere
        item = items[d // 2 % 2][1].split()
        part = item[: 18 if len(item) == 40 else 7] if d % 2 else []
        rows.append((d, " ".join(rng.choices(words, k=20) + part + rng.choices(words, k=20))))
    item = items[0][1].split()[10:]  # stretched copies: words put between those of the first 26, the last 4 intact
    rows += [(200 + i, " ".join(w + " x" * (j < 26) + " y" * (26 - i <= j < 26) for j, w in enumerate(item))) for i in (0, 5, 9, 10, 11)]
    want = align_without_seeds(rows, items)
    got = D.contaminated(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(want) == 64 and sorted((r.doc_id, r.item_id, r.score) for r in got) == want


def test_edited_copies_equal_alignment_without_seeds(spark, docs):
    rng = random.Random(5)
    items = [(n, " ".join(f"w{rng.randrange(400)}" for _ in range(n))) for n in (4, 5, 9, 15, 25, 38, 59)]
    rows = [(n, " ".join(w if i % 4 < 3 else "new" for i, w in enumerate(t.split()))) for n, t in items if n >= 15]
    for n, t in items * 20:
        rate, copy = rng.choice([0.25, 0.35, 0.5]), []
        for w in t.split():
            edit = rng.random() < rate and rng.choice(["replace", "insert", "delete"])
            copy += {False: [w], "replace": ["new"], "insert": [w, "new"], "delete": []}[edit]
        rows.append((len(rows) + 100, " ".join(rng.choices([f"w{i}" for i in range(400)], k=30) + copy)))
    want = align_without_seeds(rows, items)
    assert {(n, n) for n in (15, 25, 38, 59)} <= {w[:2] for w in want}
    got = D.contaminated(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.score) for r in got) == want


def test_short_items_must_be_nearly_whole(spark, docs):
    items = [(1, "what is the capital of france"), (2, "to be or not to be that is it"), (3, "quick brown fox"), (4, "zyzzyva")]
    rows = [(1, "so what is the capital stock of that company"), (2, "tell me: What is the capital, of France?"), (3, "it is not to be that"), (4, "the quick red fox"), (5, "a quick brown fox ran"), (6, "Zyzzyva!"), (7, "what is the big capital of france")]
    got = D.contaminated(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(2, 1), (5, 3), (6, 4), (7, 1)]


@pytest.mark.parametrize("every, share", [(4, 0.95), (5, 1.0), (7, 1.0)])
def test_recall_of_edited_copies(every, share):
    rng, found = random.Random(every), 0
    for n in range(40):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randint(15, 60))]
        block = D.Items([(1, " ".join(words))])
        copy = [w if i % every else "new" for i, w in enumerate(words)]
        text = " ".join(rng.choices([f"w{i}" for i in range(500)], k=80) + copy + rng.choices([f"w{i}" for i in range(500)], k=80))
        found += bool(D.matches(block, text, D.THRESHOLD, D.LONG_SCORE))
    assert found >= share * 40


@needs_data
def test_decontamination_query_equals_alignment_without_seeds(spark):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()][:12]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 4000").collect()]
    got = {(r.doc_id, r.item_id, r.score) for r in D.query(spark, SMALL).collect()}
    assert {g for g in got if g[0] in dict(rows) and g[1] in dict(bench)} == set(align_without_seeds(rows, bench)) and got


@pytest.mark.parametrize("held", [1 << 22, 7])
@pytest.mark.parametrize("threshold, long_score", [(D.THRESHOLD, D.LONG_SCORE), (0.2, 8), (1.0, 10**6), (0.1, 2)])
def test_no_alignment_is_lost(monkeypatch, held, threshold, long_score):
    monkeypatch.setattr(D, "HELD_PAIRS", held)
    rng = random.Random(6)
    for _ in range(60):
        size = rng.choice([3, 10, 40])
        text = lambda n: " ".join(f"w{rng.randrange(size)}" for _ in range(n))  # noqa: B023, E731
        block = D.Items([(i, text(rng.randint(1, 30))) for i in range(6)])
        page = text(rng.randint(0, 80)) + " out of list"
        scores = {i: D.align(own, block.numbers(page))[0] for i, own in zip(block.ids, block.words)}
        want = {i: s / (2 * len(own)) for (i, s), own in zip(scores.items(), block.words) if s and s >= D.least_scores(len(own), threshold, long_score)}
        assert {m[0]: m[1] for m in D.matches(block, page, threshold, long_score)} == want


def test_items_in_several_blocks(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(f"{i}x{k}" for k in range(12))) for i in range(30)], "item_id long, text string")
    monkeypatch.setattr(D, "BLOCK_BYTES", 300)
    df = docs([(i, " ".join(f"{i}x{k}" for k in range(12))) for i in range(0, 40, 2)])
    assert sorted((r.doc_id, r.item_id) for r in D.contaminated(df, bench).collect()) == [(i, i) for i in range(0, 30, 2)]


def test_alignment_equals_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(1, 12))] for _ in range(2))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert D.align(np.array(a), np.array(b))[0] == h.max()


def slow_removal(rows, window=13):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    place = lambda d: 1 << 63 if d is None else d
    for (d, _), w in zip(rows, split):
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, 1 << 64), place(d))
    out = []
    for (d, _), w in zip(rows, split):
        gone = {i + k for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < place(d) for k in range(window)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def repeat_corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(rng.choice([2, 3, 30, 400]))]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    shared = [text(rng.choice([5, 13, 14, 30, 80])) for _ in range(6)]
    rows = []
    for i in range(40):
        own = text(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(own))
            own[at:at] = rng.choice(shared)
        rows.append((rng.randint(0, 60), rng.choice([" ", "\n", " \t "]).join(own)))
    rows += [(61, rows[0][1]), (2, rows[0][1]), (2, rows[0][1]), (None, rows[0][1]), (None, rows[1][1]), (62, None), (63, ""), (64, "run " * 200), (65, "run " * 90), (66, "a b " * 60), (67, "b a " * 70)]
    return rows


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("chunk", [1 << 22, 400])
def test_repeats_equal_brute_force(docs, monkeypatch, seed, chunk):
    monkeypatch.setattr(R, "CHUNK", chunk)
    rows = repeat_corpus(seed)
    df = docs(rows).withColumnRenamed("n_chars", "kept").repartition(3)
    assert sorted((tuple(r) for r in R.remove_repeats(df).collect()), key=repr) == slow_removal(rows)


@pytest.mark.parametrize("window", [5, 8, 13, 31, 50])
def test_every_window_holds_an_anchor_and_equal_windows_the_same(window):
    rng = random.Random(window)
    for size in (2, 5, 1000):
        text = " ".join(f"w{rng.randrange(size)}" for _ in range(600))
        chunk = R.Chunk([text.encode(), b"x " + text.encode(), b"", b"a b"])
        at, name = chunk.anchors(window)
        known = dict(zip(at.tolist(), name.tolist()))
        margin = 1 << (R.levels(window)[0] - 1)
        for d in (0, 1):
            begin, end = int(chunk.ends[d] - chunk.sizes[d]), int(chunk.ends[d])
            for s in range(begin, end - window + 1):
                assert any(p in known for p in range(s + margin, s + window - margin + 1))
        shift = 601
        inner = [p for p in known if margin + window <= p < 600 - window]
        assert all(known.get(p + shift) == known[p] for p in inner)


@pytest.mark.parametrize("window", [8, 13, 50])
def test_boundaries_are_named_by_symbols_and_as_their_words_are(window):
    rng, margin = random.Random(window), 1 << (R.levels(window)[0] - 1)
    for size in (2, 4):
        chunk = R.Chunk([" ".join(f"w{rng.randrange(size)}" for _ in range(4000)).encode()])
        at, symbols = chunk.parse(window)
        at = at[(at >= margin) & (at + margin <= 4000)]
        names = chunk.boundary_names(at, symbols, margin)
        words = [tuple(chunk.names[p - margin : p + margin].tolist()) for p in at.tolist()]
        assert len(set(zip(words, names.tolist()))) == len(set(words)) == len(set(names.tolist()))
        raw = R._names(chunk.names, at - margin, 2 * margin, R._B1)
        assert len(symbols) == R.levels(window)[0] - 1 and (margin < 4 or (names != raw).mean() > 0.5)


def test_repeats_in_a_very_long_text(docs):
    body = " ".join(f"w{i}" for i in range(120_000))
    got = {r.doc_id: r for r in R.remove_repeats(docs([(1, body), (2, "head " + body + " tail"), (3, body)])).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[3].n_removed) == (0, 120_000, 120_000) and got[2].kept == "head tail"


@needs_data
def test_query_equals_sql(spark):
    same(R.query(spark, SMALL), R.SQL, SMALL)
    got = R.query(spark, SMALL).where("n_words = 0").collect()
    assert all(r.kept_sha256 == hashlib.sha256(b"").hexdigest() for r in got)


@needs_data
def test_simhash_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in S.query(spark, SMALL).collect()), key=repr) == links(rows)
