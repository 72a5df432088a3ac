import random
import re

import numpy as np
import pytest

from lodestat.llm import near_dups, textvec


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", (text or "").lower())


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def classes_by_brute_force(texts):
    """Least id of each id's class: equal lower-cased texts, and chains of similarity 0.8 or more."""
    ids, parent = sorted(texts), {}
    sets = {i: shingles(texts[i]) for i in ids}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if b < a:
                n = len(sets[a] & sets[b])
                if (texts[a] or "").lower() == (texts[b] or "").lower() or (n and n >= 0.8 * len(sets[a] | sets[b])):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def copies(spark):
    """A group of near copies that drift apart, exact copies, short and unrelated texts."""
    rng = random.Random(11)
    vocabulary = ["w%d" % i for i in range(500)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    texts, chain = {}, [base]
    for i in range(160):
        own = list(rng.choice(chain[-30:]))
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        chain.append(own)
        texts[i] = " ".join(own)
    for i in range(160, 260):
        texts[i] = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 90)))
    for i in range(260, 280):
        texts[i] = texts[200 + i % 3].upper()
    texts |= {280: "", 281: None, 282: "one two", 283: "One  two", 284: "one two"}
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string"), texts


def test_classes_by_brute_force(copies):
    df, texts = copies
    got = {r["doc_id"]: r["class_id"] for r in near_dups.classes(df).collect()}
    assert got == classes_by_brute_force(texts)


def test_large_buckets_lose_no_link(copies, monkeypatch):
    df, texts = copies
    monkeypatch.setattr(near_dups, "SMALL", 2)
    monkeypatch.setattr(near_dups, "BLOCK", 16)
    got = {r["doc_id"]: r["class_id"] for r in near_dups.classes(df).collect()}
    assert got == classes_by_brute_force(texts)


def test_one_of_each_class_stays(copies, odd_docs, no_docs):
    df, texts = copies
    kept = [r["doc_id"] for r in near_dups.deduplicated(df.unionByName(df.limit(40))).collect()]
    assert sorted(kept) == sorted(set(classes_by_brute_force(texts).values()))
    out = near_dups.deduplicated(odd_docs)
    assert out.columns == odd_docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect()) == [(False, 1), (False, 3), (False, 4), (False, 5), (False, 6), (True, 0)]
    assert near_dups.classes(no_docs).count() == 0 and near_dups.deduplicated(no_docs).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    names = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.uniform(0.2, 4.0, 300), rng.uniform(0.2, 4.0, 300)
    b[:200] = a[:200]
    k = 2_000
    sig = near_dups.dart_signatures(np.concatenate([names, names]), np.concatenate([a, b]), np.repeat([0, 1], 300), 2, k)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert (sig != np.uint64(2**64 - 1)).all() and abs((sig[0] == sig[1]).mean() - want) < 4 * (0.25 / k) ** 0.5
    alone = near_dups.dart_signatures(names, a, np.zeros(300, np.int64), 1, k)
    assert (alone[0] == sig[0]).all(), "a signature depends on its own set only"
    plain = near_dups.dart_signatures(names, None, np.zeros(300, np.int64), 1, 128)
    assert (plain == near_dups.dart_signatures(names, np.ones(300), np.zeros(300, np.int64), 1, 128)).all()


def test_words_of_bytes():
    import pyarrow as pa

    texts = ["a b", "", None, " x\ty\n", "é a", "a"]
    h, first, at = textvec.words(*textvec.raw(pa.array(texts)))
    assert np.diff(at).tolist() == [2, 0, 0, 2, 2, 1] and h[0] == h[5] == h[6] and len(set(h.tolist())) == 5
    assert [p.to_pylist() for _, p in textvec.pieces(pa.array(texts), 3)][0] == ["a b", "", None]
