"""Quality, toxicity, decontamination and the pipeline, on small corpora with known answers."""

import random
import zlib

import numpy as np
import pytest

from pairfield.llm import decontaminate, quality, toxicity, training

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rnd, n):
    syllables = ["ta", "lo", "mi", "ren", "sa", "du", "ke", "vor", "shi", "na"]
    return " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(9)
    rows = []
    for i in range(900):
        good, toxic = rnd.random() > 0.3, rnd.random() < 0.2
        t = prose(rnd, rnd.randrange(20, 200)).split()
        if toxic:
            for _ in range(rnd.randrange(2, 6)):
                t.insert(rnd.randrange(len(t)), rnd.choice(["vexgrub", "blagnash", "crudwarp"]))
        if not good:
            t = rnd.choice([[w.upper() + "!!" for w in t], [w + "$$$" for w in t], [w for w in t[:15] for _ in range(8)]])
        rows.append((i, " ".join(t), int(good), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def tables(spark, corpus):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _, _ in corpus] + [(5000, None, None, None, None), (5001, "", "en", "s", 0), (5001, "", "en", "s", 0), (5002, "word " * 40000, "en", "s", 1)], DOCS)
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in corpus] + [(None, 1, 1), (77777, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def accuracy(rows, truth, n, held):
    mine = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % n == held]
    assert len(mine) > 50
    return np.mean([a == b for a, b in mine])


def test_quality_held_out(corpus, tables):
    docs, labels = tables
    model = quality.fit(docs, labels)
    rows = quality.scores(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert accuracy(rows, {i: q for i, _, q, _ in corpus}, quality.FOLDS, quality.HELD_OUT) > 0.95
    assert len({r["score"] for r in rows if r["doc_id"] in (5000, 5001)}) == 1
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in rows)
    assert (quality.fit(docs.repartition(7), labels) == model).all()
    assert quality.scores(docs.limit(0), model).collect() == [] and quality.accepted(docs.limit(0), model).collect() == []


def test_scores_equal_a_plain_average(corpus):
    model = np.random.default_rng(1).normal(size=quality.BUCKETS + 2)
    for text in (b"", b"a b b c", b"same same same", corpus[3][1].encode()):
        rows, weight = quality.bag(text)
        assert quality.Scorer(model)([text])[0] == pytest.approx(1 / (1 + np.exp(-(weight.astype(float) @ model[rows]))), rel=1e-4)


def test_toxicity_held_out(corpus, tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    rows = toxicity.scores(docs, model).collect()
    assert len(rows) == docs.count() and accuracy(rows, {i: x for i, _, _, x in corpus}, toxicity.FOLDS, toxicity.HELD_OUT) > 0.93
    assert not any(r["predicted"] for r in rows if r["doc_id"] in (5000, 5001, 5002))
    again = toxicity.fit(docs.repartition(5), labels)
    assert again[1] == model[1] and (again[0] == model[0]).all()
    assert toxicity.scores(docs.limit(0), model).collect() == []


def test_models_without_labels(tables):
    docs, labels = tables
    none = labels.limit(0)
    assert {r["predicted"] for r in quality.scores(docs, quality.fit(docs, none)).collect()} == {1}
    assert {r["predicted"] for r in toxicity.scores(docs, toxicity.fit(docs, none)).collect()} == {0}


def test_training_rows_leave_the_fold_out(tables):
    docs, labels = tables
    kept = training.labels_outside(labels, "quality", 5, 0)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in kept.collect())
    assert 20 < training.thinned(kept, 50, "x").count() < 90


def brute_align(a, b):
    """Smith-Waterman, cell by cell."""
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            m = decontaminate.MATCH if a[i - 1] == b[j - 1] else decontaminate.MISMATCH
            h[i, j] = max(0, h[i - 1, j - 1] + m, h[i - 1, j] + decontaminate.GAP, h[i, j - 1] + decontaminate.GAP)
    return h.max()


def test_alignment_matches_brute_force():
    rnd = np.random.default_rng(4)
    for _ in range(200):
        a, b = (rnd.integers(1, 5, rnd.integers(1, 14)).astype(np.uint64) for _ in range(2))
        score, begin, end = decontaminate.align(a, b)
        assert score == brute_align(a, b) and 0 <= begin <= end <= len(b)
        assert brute_align(a, b[begin:end]) == score


@pytest.fixture(scope="module")
def leaked(spark):
    rnd = random.Random(6)
    items = [prose(rnd, rnd.randrange(20, 60)) for _ in range(25)]
    rows, truth = [], set()
    for i in range(150):
        t = prose(rnd, rnd.randrange(30, 300)).split()
        if i % 3 == 0:
            k = i % 25
            copy = items[k].split()
            if i % 2:
                for _ in range(len(copy) // 8):
                    copy[rnd.randrange(len(copy))] = rnd.choice(["edited", "words"])
                del copy[len(copy) // 2]
            at = rnd.randrange(len(t))
            t[at:at] = [w.upper() if i % 4 == 0 else w + "," for w in copy]
            truth.add((i, k))
        rows.append((i, " ".join(t), "en", "s", 1))
    rows += [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, items[0], "en", "s", 0), (902, items[0], "en", "s", 0), (903, "filler " * 40000 + items[1], "en", "s", 0)]
    truth |= {(902, 0), (903, 1)}
    bench = spark.createDataFrame([*enumerate(items), (99, None), (98, ""), (97, "too short"), (None, "x y z u v w")], "item_id long, text string")
    return spark.createDataFrame(rows, DOCS), bench, truth


def test_leaks_are_found_and_nothing_else(leaked):
    docs, bench, truth = leaked
    rows = decontaminate.contaminated(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == truth
    assert sum(r["doc_id"] == 902 for r in rows) == 2 and all(r["score"] >= decontaminate.THRESHOLD for r in rows)
    named = decontaminate.contaminated(docs.selectExpr("cast(doc_id AS string) AS doc_id", "text", "1 AS item_id", "2 AS score"), bench.selectExpr("concat('q', item_id) AS item_id", "text"))
    assert {(r["doc_id"], r["item_id"]) for r in named.collect()} == {(str(d), f"q{k}") for d, k in truth}
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - {d for d, _ in truth}


def test_edited_copies_match_brute_force(spark):
    rnd = random.Random(12)
    items = [prose(rnd, n) for n in (5, 6, 8, 15, 30, 59)]
    rows = []
    for item in items:
        for share in (0.1, 0.2, 0.25):
            for _ in range(3):
                copy = item.split()
                for at in rnd.sample(range(len(copy)), max(1, round(share * len(copy)))):
                    copy[at] = f"new{rnd.random()}"
                rows.append(" ".join([prose(rnd, 40), *copy, prose(rnd, 40)]))
        for every in (4, 5):
            rows.append(" ".join(f"new{i}" if i % every == every - 1 else w for i, w in enumerate(item.split())))
        rows += [" between ".join(item.split()), " ".join(w + " then" if i % 2 else w for i, w in enumerate(item.split())), item]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(rows)], DOCS)
    made = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(docs, spark.createDataFrame([*enumerate(items)], "item_id long, text string")).collect()}
    words, want = decontaminate.words_of([t.encode() for t in rows]), {}
    for k, item in enumerate(decontaminate.words_of([t.encode() for t in items])):
        for i, w in enumerate(words):
            share = decontaminate.align(item, w)[0] / (decontaminate.MATCH * len(item))
            if share >= decontaminate.THRESHOLD:
                want[i, k] = share
    assert made == want and len(want) > 60


def test_items_without_an_id_or_with_one_id(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    rnd = random.Random(8)
    items = [prose(rnd, 30) for _ in range(4)]
    docs = spark.createDataFrame([(i, f"{prose(rnd, 9)} {t}", "en", "s", 1) for i, t in enumerate(items)], DOCS)
    bench = spark.createDataFrame([(None, items[0]), (None, items[1]), (None, items[1]), (7, items[2]), (7, items[3]), (8, "the")], "item_id long, text string")
    made = sorted((r["doc_id"], r["item_id"], r["score"]) for r in decontaminate.contaminated(docs, bench.filter("text <> 'the'")).collect())
    assert made == [(0, None, 1.0), (1, None, 1.0), (2, 7, 1.0), (3, 7, 1.0)]
    assert decontaminate.clean(docs, bench.filter("text <> 'the'")).count() == 0


def test_parts_of_a_long_stretch_agree(monkeypatch):
    rnd = random.Random(10)
    item = prose(rnd, 40).split()
    text = []
    for i in range(60):  # copies all along a document, the last ones whole
        copy = item[:]
        for at in rnd.sample(range(40), 0 if i > 50 else 9):
            copy[at] = "edited"
        text += [*copy, *prose(rnd, rnd.randrange(30)).split()]
    words = decontaminate.words_of([" ".join(item).encode(), " ".join(text).encode()])
    whole = decontaminate.Matcher([(0, words[0])], 0.6)(words[1:])
    assert whole[0][0][:2] == (0, 1.0)
    monkeypatch.setattr(decontaminate, "STRETCH", 1)
    assert decontaminate.Matcher([(0, words[0])], 0.6)(words[1:]) == whole


def test_short_items_and_scripts_without_spaces(spark):
    items = ["Who wrote Faust?", "水的沸点是多少度？", "ประเทศไทยมีกี่จังหวัด", "東京", "...", "what"]
    rows = ["one: WHO wrote faust", "who wrote the faust", "前文水的沸點是多少度呢，后文", "ข้อความประเทศไทยมีกี่จังหวัดครับ", "私は東京に住む", "京東", "the what, what", "水的", None]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(rows)], DOCS)
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): tuple(r[2:]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert found.keys() == {(0, 0), (2, 1), (3, 2), (4, 3), (6, 5)}
    assert found[0, 0] == (1.0, 1, 4) and found[4, 3] == (1.0, 2, 4) and found[6, 5] == (1.0, 1, 2) and 0.6 < found[2, 1][0] < 1.0


def test_blocks_of_items_agree(leaked, monkeypatch):
    docs, bench, truth = leaked
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 7)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()} == truth


def test_empty_sides(leaked):
    docs, bench, _ = leaked
    assert decontaminate.contaminated(docs.limit(0), bench).collect() == [] and decontaminate.contaminated(docs, bench.limit(0)).collect() == []
    assert decontaminate.clean(docs, bench.limit(0)).count() == docs.count()


def test_pipeline_stages(spark, tables, leaked, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, labels = tables
    docs.unionByName(leaked[0].selectExpr("doc_id + 10000 AS doc_id", "text", "lang", "source", "n_chars")).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    leaked[1].write.parquet(str(tmp_path / "benchmark.parquet"))
    d, ids = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    columns = d.columns
    for i, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, d, str(tmp_path))
        assert i == len(pipeline.STAGES) - 1 or out.columns == columns
        out.write.parquet(str(tmp_path / f"out{i}"))
        d = spark.read.parquet(str(tmp_path / f"out{i}"))
        ids.append({r["doc_id"] for r in d.select("doc_id").collect()})
    assert ids[0] > ids[1] > ids[2] == ids[3] >= ids[4]
    assert not ids[2] & {i + 10000 for i, _ in leaked[2]}
    assert sorted(map(str, pipeline.run(spark, str(tmp_path)).drop("n_chars").collect())) == sorted(map(str, d.drop("n_chars").collect()))
