"""Trained scores, decontamination, packing and the pipeline."""

from __future__ import annotations

import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from siftwell.llm import decontaminate, packing, quality, toxicity
from siftwell.llm._labelled import fold, labelled_sample, without_copies

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def _words(rng, n, size=3000):
    return [f"{'abcdefgh'[rng.randrange(8)]}{rng.randrange(size)}" for _ in range(n)]


# ------------------------------------------------------------ labelled sample


def test_sample_leaves_the_held_out_fold_alone(spark):
    docs = spark.createDataFrame([(k, f"text {k} " * 6) for k in range(60)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(60)] + [(None, 1, 1), (3, 1, 1)], "doc_id long, toxic int, quality int")
    got = labelled_sample(docs, labels, "toxic", folds=5, held_out=0, per_class=10)
    used = {int(t.split()[1]) for t, _ in got}
    assert used and all(zlib.crc32(str(k).encode()) % 5 for k in used) and len(got) <= 20
    assert labelled_sample(docs, labels, "quality", folds=5, held_out=0, per_class=10) == [("text 3 " * 6, 1)]
    long = docs.limit(30).unionByName(docs.where("doc_id is not null"))  # repeated ids, and texts over the bound
    assert labelled_sample(long, labels, "toxic", folds=5, held_out=0, per_class=10) == got
    assert labelled_sample(docs, labels, "toxic", folds=5, held_out=0, per_class=10, longest=5) == []
    assert docs.where(fold(docs["doc_id"], 5).isNull()).count() == 1
    assert without_copies([("a b c d e f", 1), ("a b c d e f", 1), ("a b c d e f", 0)]) == [("a b c d e f", 1), ("a b c d e f", 0)]


# ------------------------------------------------------------------- toxicity


def _brute_marginals(e, moves):
    n = len(e)
    weight = {s: np.exp(sum(e[k] * s[k] for k in range(n)) + sum(moves[s[k - 1]][s[k]] for k in range(1, n))) for s in itertools.product((0, 1), repeat=n)}
    return [sum(w for s, w in weight.items() if s[k]) / sum(weight.values()) for k in range(n)]


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    moves = rng.standard_normal((2, 2))
    sizes = np.array([7, 3, 1, 6, 2])
    e = rng.standard_normal(sizes.sum())
    got = toxicity.forward_backward(e, sizes, moves)[0]
    for own, out in zip(np.split(e, np.cumsum(sizes)[:-1]), np.split(got, np.cumsum(sizes)[:-1]), strict=True):
        np.testing.assert_allclose(out, _brute_marginals(own, moves), rtol=1e-9)


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(2)
    sizes = np.array([4, 1, 5, 2])
    gold, e, moves = rng.integers(0, 2, 12).astype(float), rng.standard_normal(12), rng.standard_normal((2, 2))
    value, by_e, by_moves = toxicity.log_likelihood(gold, e, sizes, moves)
    assert value < 0
    step = 1e-6
    for k in range(12):
        up = e.copy()
        up[k] += step
        assert abs((toxicity.log_likelihood(gold, up, sizes, moves)[0] - value) / step - by_e[k]) < 1e-4
    for k in itertools.product((0, 1), repeat=2):
        up = moves.copy()
        up[k] += step
        assert abs((toxicity.log_likelihood(gold, e, sizes, up)[0] - value) / step - by_moves[k]) < 1e-4


@pytest.fixture(scope="module")
def toxic_model():
    rng = random.Random(2)
    sample = []
    for k in range(400):
        words = _words(rng, rng.randrange(20, 120))
        if k % 3 == 0:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["scum", "moron", "trash"]))
        sample.append((" ".join(words), int(k % 3 == 0)))
    return toxicity.train(sample)


def test_toxic_spans_and_scores(spark, toxic_model):
    texts = ["a1 b2 Moron c3", "a1 b2 c3 " * 400, "clean a5", None, "", "!!", "x " * 50_000 + "scum"]
    df = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, score string")
    got = toxicity.score_documents(df, toxic_model).orderBy("doc_id").collect()
    flagged = [r["score"] >= 0.5 for r in got]
    assert flagged == [True, False, False, False, False, False, True]
    assert [(texts[0][s["start"] : s["end"]]) for s in got[0]["spans"]] == ["Moron"]
    assert [r["doc_id"] for r in toxicity.without_toxic(df, toxic_model).orderBy("doc_id").collect()] == [1, 2, 3, 4, 5]
    assert {r["score"] for r in toxicity.without_toxic(df, toxic_model).collect()} == {"s"}
    assert toxicity.score_documents(df.limit(0), toxic_model).collect() == []
    assert toxicity.train([]).head[0] < 0 and toxicity.train([("a", 1)]).head[0] > 0


# -------------------------------------------------------------------- quality


def _plain_grams(text):
    """Feature numbers, one n-gram at a time."""

    def number(value, kind):
        return int(quality._bucket(np.array([value % 2**64], dtype=np.uint64), kind)[0])

    tokens = [xxhash.xxh64_intdigest(t.lower().encode()) for t in re.findall(r"\w+|[^\w\s]+", text)]
    found = {number(t, 1) for t in set(tokens)} | {number(a * 0x9E3779B97F4A7C15 + b, 2) for a, b in {*zip(tokens, tokens[1:])}}  # noqa: B905
    for n in (1, 2, 3):
        for g in {text[k : k + n] for k in range(len(text) - n + 1)}:
            value = 0
            for c in g:
                value = value * 0x100000001B3 + ord(c)
            found.add(number(value, 2 + n))
    return found


def test_quality_model_separates_and_scores_alike(spark):
    rng = random.Random(3)
    make = lambda good: " ".join(_words(rng, 60)) if good else " | ".join(_words(rng, 60)).upper()
    model = quality.train([(make(k % 3 > 0), int(k % 3 > 0)) for k in range(300)])
    texts = [make(True), make(False), None, "", "x" * 100_000, "a1 " * 50_000]
    df = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, score string")
    got = [r["score"] for r in quality.score_documents(df, model).orderBy("doc_id").collect()]
    assert got[0] > 0.7 > got[1] and all(0 <= s <= 1 for s in got)
    plain = [sum(model.weights[k] for k in _plain_grams(t or "")) for t in texts]
    np.testing.assert_allclose(got, model.probability(np.array(plain)), rtol=1e-9)
    assert quality.score_documents(df.limit(0), model).collect() == []
    assert not len(quality.train([]).weights) and quality.train([("a", 1)]).shift > 0


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(4)
    rows = [np.array([*rng.choice(6, 3, replace=False), 6]) for _ in range(60)]
    y = np.where([r[0] < 3 for r in rows], 1.0, -1.0)
    x = np.ones(7)
    w = quality.dual_descent(rows, x, y, np.full(60, 0.5), passes=300)
    loss = lambda v: 0.5 * v @ v + 0.5 * sum(max(0, 1 - t * v[r].sum()) for r, t in zip(rows, y, strict=True))
    assert all(loss(w) <= loss(w + 0.05 * rng.standard_normal(7)) + 1e-6 for _ in range(200))


# ------------------------------------------------------------ decontamination


def _smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return int(h.max())


def test_alignment_equals_the_full_table():
    rng = np.random.default_rng(5)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(0, 14)), rng.integers(-1, 5, rng.integers(0, 20))
        assert decontaminate.align(a, b)[0] == _smith_waterman(a.tolist(), b.tolist())


def _edited(rng, words, how, rate):
    out = []
    for k, w in enumerate(words):
        hit = k % 3 == 2 if how == "third" else rng.random() < rate
        kind = rng.choice("sid") if how == "mixed" else {"third": "s", "swap": "s", "insert": "i", "drop": "d"}[how]
        out += [w] if not hit else {"s": [f"e{rng.randrange(99)}"], "i": [w, f"e{rng.randrange(99)}"], "d": []}[kind]
    return out


@pytest.mark.parametrize("size", [60, 4000])
def test_leaks_equal_brute_force_alignment(spark, size):
    """Every edited copy that the rule counts is found, and no other, whatever the edits and the item's length."""
    rng = random.Random(size)
    lengths = [1, 2, 3, 4, 5, 6, 7, 12, 30, 45]
    items = [(k, _words(rng, n, size)) for k, n in enumerate(lengths * 3)]
    docs = []
    for _, own in items:
        for how, rate in (("third", 0), ("swap", 0.1), ("swap", 0.33), ("mixed", 0.2), ("mixed", 0.33), ("insert", 0.9), ("drop", 0.4)):
            docs.append(_words(rng, 25, size) + _edited(rng, own, how, rate) + _words(rng, 25, size))
    want = set()
    for d, words in enumerate(docs):
        for i, own in items:
            number = {w: n for n, w in enumerate(sorted({*words, *own}))}
            a, b = (np.array([number[w] for w in x]) for x in (own, words))
            if len(own) < 3:
                copied = f" {' '.join(own)} " in f" {' '.join(words)} "
            else:
                copied = decontaminate.align(a, b)[0] >= len(own)
            if copied:
                want.add((d, i))
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    assert len(want) > 150 and {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, bench, block=200).collect()} == want


def test_leaks_are_found_and_clean_documents_kept(spark):
    rng = random.Random(7)
    items = [(k, " ".join(_words(rng, rng.randrange(20, 50)))) for k in range(30)] + [(90, "a b"), (91, None), (92, "")]
    docs, leaks = [], {}
    for k in range(200):
        words = _words(rng, rng.randrange(5, 150))
        if k % 4 == 0:
            item, text = items[rng.randrange(30)]
            copy = text.split()
            for _ in range(len(copy) // 7 if k % 8 else 0):  # edited copies
                copy[rng.randrange(len(copy))] = "zz"
            words[rng.randrange(len(words)) :] = ["The", *(w.upper() + "," for w in copy)]
            leaks[k] = item
        docs.append((k, " ".join(words), "x"))
    docs += [(500, None, "x"), (501, "", "x"), (502, "w " * 100_000, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_leaks(df, bench).collect()
    assert {r["doc_id"]: r["item_id"] for r in found} == leaks
    for r in found:
        assert docs[r["doc_id"]][1].lower().split()[r["first_word"]].strip(",") in items[r["item_id"]][1]
    blocks = decontaminate.find_leaks(df, bench, block=100).collect()
    assert {(r["doc_id"], r["item_id"]) for r in blocks} == {(r["doc_id"], r["item_id"]) for r in found}
    kept = decontaminate.without_leaks(df, bench, block=400)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {d[0] for d in docs} - leaks.keys()
    assert decontaminate.find_leaks(df, bench.limit(0)).collect() == [] == decontaminate.find_leaks(df.limit(0), bench).collect()


def test_an_item_that_leaked_everywhere_keeps_its_seeds(spark):
    rng = random.Random(8)
    text = " ".join(_words(rng, 30))
    df = spark.createDataFrame([(k, " ".join(_words(rng, 20)) + " " + text) for k in range(50)], "doc_id long, text string")
    assert decontaminate.find_leaks(df, spark.createDataFrame([(1, text)], "item_id long, text string")).count() == 50


def test_hot_groups_of_edited_and_of_truncated_copies_are_found(spark):
    rng = random.Random(18)
    edited, cut = _words(rng, 30), _words(rng, 30)
    copy = ["zz" if k % 10 == 5 else w for k, w in enumerate(edited)]
    docs = [(k, " ".join(_words(rng, 20) + (copy if k % 2 else cut[:18]) + _words(rng, 20))) for k in range(120)]
    docs += [(200, " ".join(edited + cut)), (201, " ".join(_words(rng, 60)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(edited)), (0, " ".join(cut))], "item_id long, text string")
    found = decontaminate.find_leaks(df, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(k, k % 2) for k in range(120)] + [(200, 0), (200, 1)]
    assert [r["doc_id"] for r in decontaminate.without_leaks(df, bench).collect()] == [201]


# -------------------------------------------------------------------- packing


def _tokens(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 0]


TEXTS = [None, "", " ", "Don't STOP.. a.b, x <|startoftext|>, y<|endoftext|>. É. café, ≠ a\x1cb ΑΣ, I'LL. it's, K İ. 9, 9. a b,　c. \x00 z\x00.", "a,. b., . Straße, ŒUVRE! ﬁ ǅ, ª º ñ~n é. x̸ 's' dog'll. ²³ µm ſs '' ẞ ŉ.", "A≠ b.̸ c,̀.", "w" * 5000, "word " * 7000]


def test_packing_is_valid_and_tight(spark):
    rng = random.Random(9)
    texts = TEXTS + [" ".join(_words(rng, rng.randrange(1, 700))) for _ in range(150)]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(3, texts[3], 1)], "doc_id long, text string, length int")
    rows = packing.pack(df.repartition(3), PATH, keep_ids=True).collect()
    ids = {k: _tokens(t) for k, t in enumerate(texts)}
    held: dict[int, list] = {}
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] <= 2048 and r["start"] == r["piece"] * 2048
        assert np.array(own, "<u4").tobytes() == bytes(r["ids"]) and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in held.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(len(v) for v in ids.values()) + len(ids[3])
    assert sum(r["length"] for r in rows) == total and len(held) <= -(-total // 2048) + 2
    assert packing.pack(df.limit(0), PATH).collect() == []


def test_memory_bound_changes_nothing(monkeypatch):
    words = packing._Words(PATH)
    monkeypatch.setattr(packing, "MEMORY", 5)
    for t in [*TEXTS, *TEXTS]:
        assert np.frombuffer(words.encode([t or ""])[0], "<u4").tolist() == _tokens(t)[:-1]


def test_remembered_words_that_end_in_a_symbol():
    bases = ["foo(", "foo", "x3", "-", "=", "/", "a-", "[", "{", "<", "|", "@", "said”", "said’", "a–", "é", "e\u0301", "İ", "x²", "ª", "中"]
    tails = [")", ".", "*", ",", "]", "'", ")."]
    words = packing._Words(PATH)
    for t in [*bases, *tails, *(b + t for b in bases for t in tails)]:
        assert np.frombuffer(words.encode([t])[0], "<u4").tolist() == _tokens(t)[:-1], t


def _odd_words(rng, n):
    """Words of letters, digits and signs of several scripts, many of which are parts of others."""
    marks = list(".,;:!?'()[]{}<>/-=|@*#$%&_+~^`\"") + list("“”‘’–—…€£«»·°±×¿¡") + ["\u0301", "\u200d", "\u00ad", "😀", "\u3000", "\t", "\u00a0"]
    stems = ["foo", "Hello", "word", "é", "ÉTÉ", "straße", "naïve", "Ⅷ", "x1", "42", "3.14", "我们", "кот", "ΑΒΓ", "İ", "ŉ", "ﬁ", "a", "I", "don", "e\u0301"]
    made = []
    for _ in range(n):
        parts = [rng.choice(stems if rng.random() < 0.5 else marks) for _ in range(rng.randrange(1, 6))]
        made.append("".join(parts))
        if rng.random() < 0.5:
            made.append("".join(parts[: rng.randrange(len(parts)) + 1]))
    rng.shuffle(made)
    return made


@pytest.mark.parametrize("seed", [1, 2])
def test_ids_never_depend_on_what_was_seen_before(seed):
    rng = random.Random(seed)
    words = _odd_words(rng, 6000)
    kept = packing._Words(PATH)
    for k in range(0, len(words), 7):
        text = " ".join(words[k : k + 7])
        assert kept.encode([text])[0] == np.asarray(kept.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_fullest_equals_enumeration():
    rng = random.Random(10)
    for _ in range(80):
        left = {rng.randrange(1, 12): rng.randrange(1, 4) for _ in range(4)}
        room = rng.randrange(1, 40)
        sums = {sum(k * n for k, n in zip(left, c, strict=True)) for c in itertools.product(*(range(v + 1) for v in left.values()))}
        used = packing.fullest(room, left, sorted(left, reverse=True))
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room) and all(n <= left[k] for k, n in used.items())


# ------------------------------------------------------------------- pipeline


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the test tables are not here")
def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {r["doc_id"] for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "pii", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        now = {r["doc_id"] for r in docs.collect()}
        assert docs.columns == columns and now <= seen and len(now) > 0.5 * len(seen)
        assert name != "pii" or now == seen
        seen = now
    out = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in out.collect()} == seen


def test_stages_bear_odd_rows_and_extra_columns(spark, tmp_path):
    import corpus_pipeline

    sf = str(tmp_path)
    docs = [(1, "plain words " * 30, "en", "s", 1, "x"), (1, "plain words " * 30, "en", "s", 1, "x"), (None, None, None, None, None, None), (2, "", "en", "s", 0, "y"), (3, "mail a@b.co", "en", "s", 3, "z")]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, score string"
    spark.createDataFrame(docs, ddl).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    for rows in (frame, frame.limit(0)):
        step = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            step = spark.createDataFrame(stage(spark, step, sf).collect(), rows.schema)
            assert step.columns == rows.columns
        ids = sorted((r["doc_id"] or -1) for r in step.collect())
        assert ids == ([-1, 1, 1, 2, 3] if rows is frame else [])
        assert {r["score"] for r in step.collect()} <= {"x", "y", "z", None}
        assert sum(r["length"] for r in corpus_pipeline.STAGES[-1][1](spark, step, sf).collect()) == sum(len(_tokens(r["text"])) for r in step.collect())
