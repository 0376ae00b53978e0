"""SimHash groups, near vectors and repeated passages against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash

from siftwell.llm import embedding_dedup, simhash, substring_dedup
from siftwell.llm._shared import components, merge_labels

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(rng, n, size=4000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def _components(ids, links):
    label = merge_labels(np.arange(len(ids)), *links)
    return [min(ids[k] for k in range(len(ids)) if label[k] == label[j]) for j in range(len(ids))]


@pytest.mark.parametrize("n", [1, 2, 40, 300])
def test_components_of_chains_and_stars(spark, n):
    edges = [(k, k + 1) for k in range(n)] + [(1000, 1000 + k) for k in range(n)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {k: 0 for k in range(n + 1)} | {1000 + k: 1000 for k in range(n)} if n > 1 else {0: 0, 1: 0}


def _fingerprint(text):
    words = re.findall("[^ \t-\r]+", (text or "").translate(AZ))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_simhash_equals_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", "one", "One", "two words", "é É x\x0by", " \t ", "w " * 70_000]
    for _ in range(25):
        base = _words(rng, 120)
        texts.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            copy[rng.randrange(120)] = "edit"
            texts.append(" ".join(copy))
    ids = list(range(100, 100 + len(texts)))
    rows = list(zip(ids, texts, [7] * len(ids), strict=True))
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string, fp long")).collect()}
    fps = np.array([_fingerprint(t) for t in texts], dtype=np.uint64)
    want = _components(ids, np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4))
    assert got == {i: (int(f), c) for i, f, c in zip(ids, fps, want, strict=True)}
    assert simhash.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_simhash_filter_keeps_one_of_each(spark):
    rows = [(1, "a b c d e", "x"), (2, "a b c d e", "x"), (2, "a b c d e", "x"), (None, "a b c d e", "x"), (3, None, "x"), (4, "", "x")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, fp string"))
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 3]


@pytest.mark.parametrize("n", [2, 70, 900])
def test_index_equals_all_pairs(n):
    rng = np.random.default_rng(n)
    x = rng.integers(0, 2**64, size=max(2, n // 12), dtype=np.uint64)[rng.integers(0, max(2, n // 12), n)]
    for _ in range(4):
        x ^= (rng.random(n) < 0.6).astype(np.uint64) << rng.integers(0, 64, n).astype(np.uint64)
    for side in (np.full(n, -1, np.int8), (rng.random(n) < 0.5).astype(np.int8)):
        near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
        if (side >= 0).all():
            near &= side[:, None] != side[None, :]
        want = merge_labels(np.arange(n), *np.nonzero(near))
        got = simhash.link_classes(x, side)
        assert len({*zip(got.tolist(), want.tolist(), strict=True)}) == len(set(want.tolist())) == len(set(got.tolist()))


def test_index_of_many_buckets_equals_pairs_in_each():
    rng = np.random.default_rng(3)
    n = 700
    owner = np.sort(rng.integers(0, 90, n)) ** 2 // 30
    x = rng.integers(0, 2**64, 60, dtype=np.uint64)[rng.integers(0, 60, n)] ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    near = (np.bitwise_count(x[:, None] ^ x[None, :]) <= 4) & (owner[:, None] == owner[None, :])
    want = merge_labels(np.arange(n), *np.nonzero(near))
    assert np.array_equal(simhash.link_classes(x, np.full(n, -1, np.int8), owner), want)


def test_every_link_comes_from_the_index(monkeypatch):
    """Without the index nothing links, however small the buckets are."""
    frame = pd.DataFrame({"fp": [1, 3, 5, 1, 2**60, 2**60 + 1], "rep": [10, 11, 12, 13, 14, 15]})
    cuts, side = np.array([0, 2, 4, 6]), np.full(6, -1, np.int8)
    assert simhash._within(frame, cuts, side).to_numpy().tolist() == [[10, 11], [12, 13], [14, 15]]
    monkeypatch.setattr(simhash, "link_classes", lambda fp, *_: np.arange(len(fp)))
    assert not len(simhash._within(frame, cuts, side))


def test_hot_keys_are_salted_without_loss(spark, monkeypatch):
    from siftwell.llm import _shared

    monkeypatch.setattr(_shared, "COOL", 8)
    rows = spark.createDataFrame([(k, 0 if k < 900 else k % 50) for k in range(1200)], "id long, key long")
    sizes = rows.groupBy("key").count().where("key <> 7")
    for how in ("inner", "left"):
        got = _shared.join_hot(rows, sizes, ["key"], "count", "id", how)
        want = rows.join(sizes, ["key"], how)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.select(got.columns).collect()), key=str)


def test_hot_bucket_is_dealt_in_chunks_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 16)
    fps = [k for k in range(256)]  # one bucket, many links
    df = spark.createDataFrame([(f, 1000 + f) for f in fps], "fp long, rep long")
    found = components(simhash.fingerprint_links(df))
    assert {r["component"] for r in found.collect()} == {1000} and found.count() == 256


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 64))
    rows = [(base[k % 40] + 0.02 * (k // 40) * rng.standard_normal(64)).tolist() for k in range(320)]
    rows += [rows[0]] * 30 + [[2 * v for v in rows[0]]]
    bad = [None, [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] * 64, [None] + [1.0] * 63, [], [1.0, 0.0]]
    df = spark.createDataFrame([(k, v, k % 3, 9) for k, v in enumerate(rows + bad)], "vec_id long, embedding array<float>, label int, n_links int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(df).collect()}
    x = np.array(rows, dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    comp = _components(list(range(len(rows))), np.nonzero(near))
    assert got == {k: (int(near[k].sum()), comp[k], comp[k] == k) for k in range(len(rows))} | {len(rows) + k: (0, len(rows) + k, True) for k in range(len(bad))}


def test_vectors_of_an_empty_table(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


@pytest.mark.parametrize("cosine", [0.9, 0.95])
def test_recall_at_the_threshold(cosine):
    hashing = embedding_dedup.plan_hashing(64, 50_000)
    rng = np.random.default_rng(8)
    a, b = rng.standard_normal((2, 600, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    assert (hashing.keys(a)[:, :, :, None] == hashing.keys(b)[:, :, None, :]).any(axis=(1, 2, 3)).mean() >= 0.95


def _passage_docs(rng):
    passages = [" ".join(_words(rng, 55)) for _ in range(6)]
    docs, planted = [], {}
    for k in range(120):
        words = _words(rng, rng.randrange(30, 200))
        if k % 3 == 0:
            p = rng.randrange(6)
            at = rng.randrange(len(words))
            words[at:at] = [passages[p]]
            planted.setdefault(p, []).append(k)
        docs.append("".join(w + rng.choice([" ", " ", " ", " ", "\n"]) for w in words))
    return docs, {k for ks in planted.values() if len(ks) > 1 for k in ks}


def test_passages_are_found_wherever_they_stand(spark):
    docs, planted = _passage_docs(random.Random(4))
    docs += [None, "", "short text"]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(docs)], "doc_id long, text string, start string")
    found = substring_dedup.repeated_passages(df).collect()
    assert {r["doc_id"] for r in found} | {r["first_doc_id"] for r in found} == planted
    for r in found:
        assert len(docs[r["doc_id"]][r["start"] : r["end"]].split()) >= 18
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.cut_passages(df, substring_dedup.repeated_passages(df)).collect()}
    assert len(cut) == len(docs) and all(cut[k] == t for k, t in enumerate(docs) if k not in planted)
    assert all(len(cut[r["doc_id"]]) < len(docs[r["doc_id"]]) for r in found)


def test_whole_passages_are_covered(spark):
    rng = random.Random(14)
    passages = [" ".join(_words(rng, n)) for n in (50, 55, 55, 100, 100, 100)]
    docs, planted = [], {}
    for k in range(90):
        # words of its own, so that no passage goes on by chance, and enough that no two lines are near
        head, tail = (" ".join(f"{side}{k}_{j}" for j in range(rng.randrange(30, 60))) + " " for side in "ht")
        p = passages[k % 6]
        planted[k] = (len(head), len(head) + len(p))
        docs.append((k, head + p + " " + tail.strip()))
    # a part of one passage stands before its other copies
    part = slice(30, 75)
    docs.append((-1, "x y z " + " ".join(passages[3].split()[part]) + " u v w"))
    found = substring_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    text = docs[3][1]
    at = text.index(" ".join(passages[3].split()[part]))
    want = {k: v for k, v in planted.items() if k >= 6} | {3: (at, at + len(" ".join(passages[3].split()[part])))}
    assert sorted((r["doc_id"], r["start"], r["end"]) for r in found) == sorted((k, *v) for k, v in want.items())


def test_near_paragraphs_and_what_stays(spark):
    rng = random.Random(6)
    base = _words(rng, 80)
    near = [*base[:79], "edit"]
    far = _words(rng, 80)
    rows = [(5, " ".join(base)), (3, " ".join(near)), (9, " ".join(far)), (9, " ".join(far)), (7, "\n".join([" ".join(far[:40]) + " tail"] * 3))]
    found = {r["doc_id"]: r["first_doc_id"] for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # a line that two documents share also goes where the first of them repeats it
    assert found == {5: 3, 9: 7, 7: 7}
    assert substring_dedup.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_large_bucket_classes_equal_pairs():
    rng = random.Random(9)
    bases = [rng.sample(range(10_000), 50) for _ in range(6)]
    sets = []
    for k in range(90):
        s = set(bases[k % 6])
        for _ in range(k // 30):
            s.discard(rng.choice(sorted(s)))
            s.add(rng.randrange(10_000, 20_000))
        sets.append(np.array(sorted(s), dtype=np.int32))
    held = np.empty(90, dtype=object)
    held[:] = sets
    whole = np.array([hash(tuple(s.tolist())) & 0x7FFFFFFF for s in sets], dtype=np.int64)
    near = np.array([[len(set(a.tolist()) & set(b.tolist())) >= 0.8 * len(set(a.tolist()) | set(b.tolist())) for b in sets] for a in sets])
    want = merge_labels(np.arange(90), *np.nonzero(near))
    got = substring_dedup._large(held, whole, np.full(90, -1, np.int8))
    assert len({*zip(got.tolist(), want.tolist(), strict=True)}) == len(set(want.tolist())) == len(set(got.tolist()))
