"""Classifiers on held-out rows, the neighbour index against brute force, licence notices, the pipeline and its absence."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.llm import ann, licenses, quality, toxicity


def auc(rows, label):
    pos = [r["score"] for r in rows if label[r["doc_id"]] == 1]
    neg = [r["score"] for r in rows if label[r["doc_id"]] == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(10, 150))]
        toxic, good = int(rng.random() < 0.15), int(rng.random() < 0.8)
        if toxic:
            for _ in range(max(1, len(words) // 30)):
                words[rng.randrange(len(words))] = rng.choice(["Badword!", "nastyone", "vile" + rng.choice("abcdef") + "x"])
        if not good:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, good, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def held(spark_rows):
    return [r for r in spark_rows if r["held_out"]]


def test_quality_on_held_out_rows(corpus):
    docs, labels, truth = corpus
    got = quality.scored(docs, quality.fit(docs, labels)).collect()
    y = {i: q for i, q, _ in truth}
    assert len(got) == 900 and auc(held(got), y) > 0.98
    assert all((r["predicted"] == 1) == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)


def test_toxicity_on_held_out_rows(corpus):
    docs, labels, truth = corpus
    got = toxicity.scored(docs, toxicity.fit(docs, labels)).collect()
    y = {i: t for i, _, t in truth}
    some = held(got)
    assert auc(some, y) > 0.95
    hit = [r["predicted"] == y[r["doc_id"]] for r in some]
    assert sum(hit) / len(hit) > 0.93


def test_labels_of_held_out_rows_are_not_used(corpus):
    docs, labels, _ = corpus
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    other = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    for a, b in ((toxicity.fit(docs, labels), toxicity.fit(docs, other)), (quality.fit(docs, labels), quality.fit(docs, other))):
        assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("model", [quality, toxicity])
def test_models_on_odd_input(model, odd_docs, no_docs, no_labels, corpus):
    fitted = model.fit(odd_docs, no_labels)
    got = model.scored(odd_docs, fitted).collect()
    assert len(got) == 8 and len({r["score"] for r in got}) == 1
    assert model.scored(no_docs, fitted).count() == 0
    real = model.scored(odd_docs, model.fit(corpus[0], corpus[1])).collect()
    assert len(real) == 8 and all(0 <= r["score"] <= 1 for r in real) and not any(r["held_out"] for r in real if r["doc_id"] is None)


def test_trees_split_what_they_should():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality.boost(x, y)
    fresh = rng.random((1000, 3))
    assert ((forest.scores(fresh) > 0.5) == ((fresh[:, 0] > 0.5) ^ (fresh[:, 1] > 0.5))).mean() > 0.97
    assert quality.boost(x, np.ones(2000)).scores(fresh).min() > 0.99


def test_trees_by_plain_loops():
    """Every tree walked node by node, every leaf added by itself."""
    rng = np.random.default_rng(23)
    x = rng.random((600, 4)).round(2)
    forest = quality.boost(x, (x[:, 0] + x[:, 2] > 1).astype(float), trees=12, depth=3)
    fresh = rng.random((200, 4)).round(2)
    for row, score in zip(fresh, forest.scores(fresh), strict=True):
        z = forest.base
        for feature, threshold, value in zip(forest.feature, forest.threshold, forest.value, strict=True):
            node = 0
            while node < 7:
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            z += value[node - 7]
        assert score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-12)


def test_statistics_by_plain_loops():
    import re

    import pyarrow as pa

    texts = ["One two two. THREE!! 4\n\nx y z x y z", "", None, "é ü é", "a b c d e f g h " * 3]
    got = quality.statistics(pa.array(texts))
    for text, row in zip(texts, got, strict=True):
        text = text or ""
        raw, w = text.encode(), re.findall(rb"[^\x20\x09-\x0d]+", text.encode())
        share = lambda members: sum(b in members for b in raw) / max(len(raw), 1)  # noqa: E731, B023
        runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)] or ([tuple(w)] if w else [])
        n = max(len(w), 1)
        want = {
            "words": np.log1p(len(w)), "bytes_per_word": sum(map(len, w)) / n, "distinct": len(set(w)) / n**0.9, "most_common": max(map(w.count, w), default=0) / n,
            "adjacent": sum(a == b for a, b in zip(w, w[1:], strict=False)) / n, "repeated": (len(runs) - len(set(runs))) / n,
        } | {name: share(members) for name, members in quality._CLASSES.items()}
        assert row.tolist() == pytest.approx([want[name] for name in quality.STATISTICS]), text


def test_risk_by_definition():
    """A step down the estimator's slope lowers the risk as the definition gives it, text by text."""
    rng = np.random.default_rng(4)
    size, prior = 12, 0.2

    def sample(n, toxic):
        rows = [sorted(set(rng.choice(6, 2).tolist() if rng.random() < toxic else []) | set((6 + rng.choice(6, 3)).tolist())) for _ in range(n)]
        return rows, (np.concatenate([np.array(r) for r in rows]), np.cumsum([0, *map(len, rows)]))

    (p_rows, p), (u_rows, u) = sample(60, 1.0), sample(300, 0.2)

    def risk(w, b):
        z = lambda row: sum(w[j] for j in row) + b
        loss = lambda t: np.log1p(np.exp(-t))
        toxic = prior * np.mean([loss(z(r)) for r in p_rows])
        clean = np.mean([loss(-z(r)) for r in u_rows]) - prior * np.mean([loss(-z(r)) for r in p_rows])
        return toxic + max(0.0, clean)

    begin = risk(np.zeros(size), np.log(prior / (1 - prior)))
    w, b = toxicity.non_negative_pu(p, u, size, prior, decay=0.0)
    assert risk(w, b) < 0.7 * begin and min(w[:6]) > max(w[6:])
    w1, b1 = toxicity.non_negative_pu(p, u, size, prior, steps=1, rate=1e-3, decay=0.0)
    assert risk(w1, b1) < begin


def test_toxicity_scores_by_plain_loops(corpus):
    import re

    import pyarrow as pa

    docs, labels, _ = corpus
    names, weights, intercept = toxicity.fit(docs, labels)
    weight = dict(zip(names.tolist(), weights.tolist(), strict=True))
    texts = {r["doc_id"]: r["text"] for r in docs.limit(150).collect()}
    hashed = lambda word: {int(h) & 0xFFFFFFFF for h in toxicity._hashes(pa.array([word]))[0]}
    seen = {}
    for r in toxicity.scored(docs, (names, weights, intercept)).collect():
        if r["doc_id"] in texts:
            features = set()
            for word in re.findall(r"[^\W_]+", texts[r["doc_id"]].lower()):
                if word not in seen:
                    seen[word] = hashed(word)
                features |= seen[word]
            z = intercept + sum(weight.get(f, 0.0) for f in features)
            assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_a_repeated_id_counts_once(spark, corpus):
    docs, labels, _ = corpus
    again = docs.unionByName(docs.where("doc_id = 1").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("copy"))
    for a, b in ((toxicity.fit(docs, labels), toxicity.fit(again, labels)), (quality.fit(docs, labels), quality.fit(again, labels))):
        assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))


def nearest_by_brute_force(rows, q, k=10):
    x = {i: np.asarray(v, float) for i, v in rows}
    far = sorted((float(np.sqrt(((x[i] - x[q]) ** 2).sum())), i) for i in x if i != q)
    return far[:k]


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[1000:1400] = x[7]
    rows = [(int(i), x[i].tolist()) for i in range(3000)]
    odd = [(9000, None), (9100, [0.0] * 16), (9200, [None] * 16), (9300, [float("nan")] * 16), (None, [1.0] * 16), (9400, [])]
    df = spark.createDataFrame(rows + odd + rows[:50], "vec_id long, embedding array<float>").withColumn("point", F.lit("clash"))
    got = {}
    for r in ann.nearest(df, shard=800).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert sorted(got) == list(range(0, 3000, 100))
    hits = 0
    for q, found in got.items():
        found.sort()
        want = nearest_by_brute_force(rows, q)
        assert [r for r, _, _ in found] == list(range(1, 11)) and [(s, v) for _, s, v in found] == sorted((s, v) for _, s, v in found)
        hits += len({v for _, _, v in found} & {v for _, v in want})
        if 1000 <= q < 1400:
            assert [v for _, _, v in found] == [v for _, v in want]
    assert hits >= 0.95 * 10 * len(got)


@pytest.mark.parametrize("how", ["shifted", "large", "tiny", "clusters", "outlier"])
def test_nearest_of_any_finite_vectors(spark, how):
    rng = np.random.default_rng(17)
    x = rng.normal(size=(1500, 24))
    if how == "shifted":
        x += 1e4
    elif how in ("large", "tiny"):
        x *= 1e25 if how == "large" else 1e-25
    elif how == "clusters":
        x = x * 1e-6 + 1e4 * rng.integers(0, 6, size=(1500, 1))
    else:
        x[37] *= 1e30
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard=500).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert sorted(got) == list(range(0, 1500, 100)) and all(len(v) == 10 for v in got.values())
    hits = 0
    for q, found in got.items():
        want = nearest_by_brute_force(rows, q)
        hits += len({v for _, _, v in found} & {v for _, v in want})
        for _, score, v in found:
            assert score == pytest.approx(float(np.sqrt(((x[v] - x[q]) ** 2).sum())), rel=1e-12)
    assert hits >= 0.9 * 10 * len(got), how


def test_an_id_with_several_vectors_has_the_least(spark):
    rows = [(0, [1.0, 5.0]), (0, [1.0, 2.0]), (1, [1.0, 3.0]), (2, [9.0, 9.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 1.0), (2, 2, 113**0.5)]


def test_a_graph_that_falls_apart_hides_nothing():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8))
    g = ann.Graph(x)
    g.levels = [np.full_like(level, -1) for level in g.levels]
    rows = [{"dims": 8, "asks": False, "points": list(range(300)), "vectors": x.tobytes(), "entry": g.entry, "height": g.height, "levels": [level.tobytes() for level in g.levels]}, {"dims": 8, "asks": True, "points": [3, 4], "vectors": x[3:5].tobytes(), "entry": None, "height": None, "levels": None}]
    (out,) = ann._searcher(11, 64)(iter([pa.RecordBatch.from_pylist(rows)]))
    got = out.to_pylist()
    for q in (3, 4):
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        assert [r["point"] for r in got if r["query"] == q] == np.argsort(far, kind="stable")[:11].tolist()


def test_nearest_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df).collect()] == [(1, 2, 0.0), (2, 1, 1.0)]
    assert ann.nearest(df.where("vec_id = 0")).count() == 0 and ann.nearest(df.where("false")).count() == 0


def test_licences(spark, odd_docs, no_docs):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    families = sorted(licenses.NOTICES)
    rows, want = [], {}
    for i in range(260):
        lines = [prose(rng.randint(5, 200)) for _ in range(3)]
        if i < 2 * len(families):
            lines.insert(rng.randrange(4), licenses.NOTICES[families[i % len(families)]][0])
            want[i] = families[i % len(families)]
        rows.append((i, "\n".join(lines)))
    rows[-1] = (259, "He renewed his driving license in the spring.\n" + prose(50))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = licenses.fit(docs, texts=200, paragraphs=800)
    got = licenses.scan(docs, model).collect()
    sure = {r["doc_id"]: r["family"] for r in got if r["confirmed"]}
    assert sure == want
    for r in got:
        if r["confirmed"]:
            assert rows[r["doc_id"]][1][r["start"] : r["end"]] == licenses.NOTICES[r["family"]][0]
    assert licenses.scan(odd_docs, model).where("confirmed").count() == 0 and licenses.scan(no_docs, model).count() == 0


def test_pipeline(spark, tmp_path, corpus):
    import corpus_pipeline

    docs, labels, _ = corpus
    full = docs.select("doc_id", F.when(F.col("doc_id") == 3, F.concat("text", F.lit(" mail me at jo@mail.example.com"))).otherwise(F.col("text")).alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string")).alias("source"), F.length("text").cast("long").alias("n_chars"))
    full.unionByName(full.limit(20).withColumn("doc_id", F.col("doc_id") + 5000)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), full.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, str(tmp_path))
        assert rows.columns == columns
        rows.write.parquet(f"{tmp_path}/{len(seen)}.parquet")
        rows = spark.read.parquet(f"{tmp_path}/{len(seen)}.parquet")
        seen[name] = {r["doc_id"]: r["text"] for r in rows.collect()}
    after_rules, after_dups, after_pii, after_mix = seen.values()
    assert 600 < len(after_rules) < 920 and not any(i >= 5000 for i in after_dups) and set(after_dups) <= set(after_rules)
    assert set(after_mix) == set(after_pii) == set(after_dups)
    assert not any("jo@mail" in t for t in after_pii.values())
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == set(after_mix)


def test_licence_probabilities_by_dictionary(spark):
    """Each finding's paragraph scored again: n-gram by n-gram, class by class, from a dictionary."""
    import re

    rng = random.Random(31)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    notices = [n for own in licenses.NOTICES.values() for n in own]
    rows = [(i, f"{prose(12)}\n{notices[i % len(notices)]}\n\n{prose(100)}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = licenses.fit(docs, texts=60, paragraphs=200)
    got = licenses.scan(docs, model).collect()
    assert len({r["doc_id"] for r in got}) >= 55
    from lodestat.llm import textvec

    import pyarrow as pa

    def probability(said, family):
        words = re.findall(r"[^\W_]+", said.lower())
        hashes = [textvec.words(*textvec.raw(pa.array([w])), letters=True)[0][0] for w in words]
        grams = [int(licenses._slots(np.array(hashes[i : i + n], np.uint64))[n - 1][0]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
        weight = {g: model.weights[g] for g in set(grams)}
        z = [(sum(float(weight[g][c]) for g in grams) / max(len(grams), 1) ** 0.5 + model.intercept[c]) / model.temperature for c in range(len(model.intercept))]
        e = [np.exp(x - max(z)) for x in z]
        return e[model.families.index(family)] / sum(e)

    for r in got:
        said = rows[r["doc_id"]][1][r["start"] : r["end"]]
        assert r["probability"] == pytest.approx(probability(said, r["family"]), abs=1e-4) and r["held"] == pytest.approx(max(licenses.held(said, n) for n in licenses.NOTICES[r["family"]]))


def test_wrapped_licences(spark):
    import textwrap

    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows, want = [(i, "\n".join(prose(rng.randint(5, 100)) for _ in range(3))) for i in range(100, 300)], {}
    at = 0
    for family, n in (("mit", 2), ("gpl-2.0", 1), ("gpl-3.0", 2), ("lgpl", 1), ("bsd", 2)):
        for mark in ("", "# ", " * "):
            lines = [mark + x for x in textwrap.wrap(licenses.NOTICES[family][n], 72 - len(mark))]
            before = [mark.rstrip(), prose(9), mark.rstrip()]
            rows.append((at, "\n".join([*before, *lines, mark.rstrip(), prose(30)])))
            want[at] = family
            at += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.scan(docs, licenses.fit(docs.where("doc_id >= 100"), texts=200, paragraphs=800)).where("confirmed").collect()
    assert sorted((r["doc_id"], r["family"]) for r in got) == sorted(want.items())


def test_a_faint_window_hides_no_finding():
    hits = [licenses._Hit(0.3, 0, 50, "mit", 0.9, "x" * 50), licenses._Hit(1.0, 25, 75, "mit", 0.8, "x" * 50), licenses._Hit(0.7, 200, 250, "mit", 0.8, "x" * 50)]
    assert [(h.start, h.share) for h in licenses.merged(hits)] == [(25, 1.0), (200, 0.7)]
