import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestat.llm import mixing, packing
from lodestat.llm.queries import tokenizer_path


def test_schedule_stays_within_a_block():
    rng = random.Random(1)
    cases = [{f"s{i}": rng.random() ** 3 for i in range(n)} | ({None: 0.2} if n > 1 else {}) for n in (1, 2, 5, 30)]
    cases += [{"a": 1 / 3, "b": 1 / 7, "c": 0.0005, "d": 1 - 1 / 3 - 1 / 7 - 0.0005, "none": 0.0}, {"a": 0.999, "b": 0.001}, {"a": 2, "b": 3}]
    for weights in cases:
        exact = mixing.shares(weights)
        length = 100_000 if "none" in weights else 20_000
        found = mixing.slots(exact, {s: int(w * length) + 2 if w else 3 for s, w in exact.items()})
        for s, own in found.items():
            if not exact[s]:
                assert len(own) == 3 and own[0] > max(x[-1] for t, x in found.items() if exact[t]), "after the schedule"
                continue
            p, q = exact[s].numerator, exact[s].denominator
            assert all(j * q // p <= t < -(-(j + 1) * q // p) for j, t in enumerate(own))
            given = np.searchsorted(own, np.arange(length), side="right")
            assert max(abs(int(n) * q - p * t) for t, n in enumerate(given, 1)) < q, "less than a block, in whole numbers"
        filled = sorted(t for own in found.values() for t in own)
        assert filled[:length] == list(range(length)) and len(filled) == len(set(filled))


def test_mixing(spark, odd_docs, no_docs):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randint(1, 900), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.scheduled(docs, block_bytes=1000).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(600))
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    for own in by.values():
        own.sort(key=lambda r: r["place"])
        assert [r["place"] for r in own] == list(range(len(own)))
        before = 0
        for r in own:
            assert r["block"] == before // 1000
            before += r["bytes"]
        assert all(a["slot"] <= b["slot"] for a, b in zip(own, own[1:], strict=False))
    assert len({(r["source"], r["block"]) for r in got}) == len({r["slot"] for r in got})
    again = mixing.scheduled(docs.repartition(7), block_bytes=1000).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    laid = mixing.mixed(docs, block_bytes=1000)
    place = {r["doc_id"]: (r["slot"], r["place"]) for r in got}
    assert [r["doc_id"] for r in laid.collect()] == sorted(place, key=place.get)
    coarse = mixing.scheduled(docs, block_bytes=1000, most=20).collect()
    assert sorted(r["doc_id"] for r in coarse) == list(range(600)) and 10 <= len({(r["source"], r["block"]) for r in coarse}) <= 20 + 8
    out = mixing.mixed(odd_docs)
    assert out.columns == odd_docs.columns and sorted(map(str, out.collect())) == sorted(map(str, odd_docs.collect()))
    assert mixing.scheduled(odd_docs).count() == 8 and mixing.scheduled(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0


def test_target_weights(spark):
    docs = spark.createDataFrame([(i, "x" * 100, "a" if i < 300 else "b") for i in range(600)], "doc_id long, text string, source string")
    got = [r for r in mixing.scheduled(docs, {"a": 3.0, "b": 1.0}, block_bytes=100).collect() if r["on_target"]]
    many = Counter(r["source"] for r in got)
    assert many["a"] == 300 and abs(many["b"] - 100) <= 1


def test_repeated_rows_follow_the_schedule(spark):
    rows = [(7, "x" * 100, "a")] * 300 + [(8, "y" * 100, "b")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    laid = [r["source"] for r in mixing.mixed(docs, weights={"a": 1.0, "b": 2.0}, block_bytes=100).collect()]
    assert Counter(laid) == {"a": 300, "b": 300}
    assert all(abs(laid[:t].count("b") - 2 * t / 3) < 1 for t in range(1, 450))


def test_sources_without_weight_come_last(spark):
    docs = spark.createDataFrame([(i, "x" * 100, "abc"[i % 3]) for i in range(300)], "doc_id long, text string, source string")
    got = mixing.scheduled(docs, {"a": 1.0, "b": 0.0}, block_bytes=100).collect()
    last = max(r["slot"] for r in got if r["source"] == "a")
    assert len(got) == 300 and all((r["slot"] > last) == (r["source"] != "a") and r["on_target"] == (r["source"] == "a") for r in got)


@pytest.fixture(scope="module")
def ids():
    return packing._Ids(tokenizer_path())


def test_words_apart_give_the_same_ids(ids):
    rng = random.Random(7)
    for _ in range(3000):
        text = "".join(rng.choice("aAéÉßñ'sdtm1²½.,, . \n\t  <|>!-ªµ_ÿ×\xa0\x85\xadΣİ日") for _ in range(rng.randint(1, 16)))
        assert b"".join(map(ids.__getitem__, packing.parted(text))) == ids.encode(text), repr(text)
    for text in ("<|endoftext|> x", "a<|ENDOFTEXT|>. b", "don't. We'LL, x'S", "THE END."):
        assert b"".join(map(ids.__getitem__, packing.parted(text))) == ids.encode(text)


def test_packing(spark, odd_docs, no_docs, ids):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta,", "Gamma.", "été", "12"]) for _ in range(rng.choice([1, 5, 40, 300, 900])))) for i in range(250)] + [(900, "long " * 7000), (None, None), (5, "")]
    rows += [(901, "twice over"), (901, "twice over"), (902, "a\x1cb. c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.packed(df, tokenizer_path()).collect()
    want = Counter()
    for doc, text in rows:
        whole = ids.encode(text or "") + b"\0\0\0\0"
        for n, at in enumerate(range(0, len(whole), 8192)):
            part = whole[at : at + 8192]
            want[doc, n, at // 4, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        upto = 0
        for offset, length in sorted(own):
            assert offset == upto
            upto += length
        assert upto <= 2048
    lengths, many = np.unique([r["length"] for r in got], return_counts=True)
    assert len(by) <= sum(n for _, n in packing._best_fit_decreasing(lengths, many, 2048)) + 1
    assert len(packing.packed(odd_docs, tokenizer_path()).select("doc_id").distinct().collect()) == 7
    assert packing.packed(no_docs, tokenizer_path()).count() == 0


def test_configurations_use_every_piece_once():
    rng = random.Random(4)
    for top in (30, 2000, 50_000):
        hist = Counter(min(2048, int(rng.lognormvariate(5.5, 1.3)) + 1) for _ in range(top))
        found = packing.configurations(dict(hist))
        used = Counter()
        for one, n in found:
            assert n > 0 and sum(length * m for length, m in one.items()) <= 2048
            for length, m in one.items():
                used[length] += n * m
        assert used == hist
        assert sum(n for _, n in found) <= 1.03 * -(-sum(k * v for k, v in hist.items()) // 2048) + 1
    assert packing.configurations({}) == [] and packing.configurations({2048: 3}) == [({2048: 1}, 3)]


def test_the_program_places_nearly_all():
    rng = random.Random(4)
    hist = Counter(min(2048, int(rng.lognormvariate(5.5, 1.3)) + 1) for _ in range(60_000))
    found, said = packing.programmed(dict(hist))
    assert sum(n * m * size for one, n in found for size, m in one.items()) == sum(size * n for size, n in hist.items())
    assert said["placed"] >= 0.8 and said["left"] <= packing.LEFT * said["lengths"]
    assert sum(n for _, n in found) <= 1.001 * -(-sum(k * v for k, v in hist.items()) // 2048) + 1
    # a scarce length is never taken more often than it is there
    top, ways, _ = packing._priced(np.array([9.0, 1.0]), np.array([300, 100]), np.array([1, 50]), 2048, np.array([0, 1]), np.array([0, 1]))
    assert top == 26.0 and all((own == 0).sum() <= 1 for own in ways)


def test_prefixes_of_sequences_follow_the_schedule(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(200, 900))), "hot" if i % 3 else "cold") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source = {i: s for i, _, s in rows}
    mixing.mixed(docs, weights={"hot": 1.0, "cold": 3.0}).write.parquet(f"{tmp_path}/mixed.parquet")
    docs.write.parquet(f"{tmp_path}/plain.parquet")

    def shares(name):
        got = corpus_pipeline.best_fit_packing(spark, spark.read.parquet(f"{tmp_path}/{name}.parquet"), "").collect()
        assert Counter(r["doc_id"] for r in got) == Counter(source.keys())
        ids = sorted({r["sequence_id"] for r in got})
        assert ids == list(range(len(ids)))
        out = []
        for part in (0.125, 0.25):
            tokens = Counter()
            for r in got:
                if r["sequence_id"] < part * len(ids):
                    tokens[source[r["doc_id"]]] += r["length"]
            out.append(tokens["cold"] / sum(tokens.values()))
        return out

    assert all(abs(x - 0.75) < 0.06 for x in shares("mixed")) and all(x < 0.5 for x in shares("plain"))
