"""Licence scan, personal data and chat formatting against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from siftwell.llm import chat_format, license_scan, pii

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, hits string, pii string, start long"


def _docs(spark, texts):
    return spark.createDataFrame([(k, t, "en", "own", "own", 1) for k, t in enumerate(texts)], DOCS)


# ------------------------------------------------------------------- licences

PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
LICENCE_TEXTS = [
    None, "", "...", "Released under the MIT License.", "under the MIT license under the mit-license under the mit", "Licensed under CC BY-NC 4.0. cc by nc cc by nc",
    "Apache License, Version 2.0 and\nunder   the\tMIT license", "ünder the mit license", "x\x00under the mit license", "underthe mit license", "All rights reserved.",
    "the the of mit license under the", "word " * 30_000 + "under the mit license", "Under The Mit License é under the mit license", "cc by nc" * 3,
    "This work is licensed under the GNU General Public License, version 3.",
]


def _expected(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))
    at = [(k, label) for label, p in PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    starts = sorted(k for k, _ in at)
    return len(words), len(at), starts[0] if at else None, starts[-1] if at else None, ",".join(sorted({x for _, x in at}))


def test_licence_places_equal_brute_force(spark):
    got = license_scan.scan_licences(_docs(spark, LICENCE_TEXTS).drop("hits")).orderBy("doc_id").collect()
    assert len(got) == len(LICENCE_TEXTS)
    for r, t in zip(got, LICENCE_TEXTS, strict=True):
        base = [h for h in r["hits"] if h["base"]]
        starts = sorted(h["start"] for h in base)
        assert (r["n_words"], len(base), starts[0] if base else None, starts[-1] if base else None, ",".join(sorted({h["label"] for h in base}))) == _expected(t)
        assert all(0 < h["score"] <= 1 for h in r["hits"])
    labels = [{h["label"] for h in r["hits"]} for r in got]
    assert labels[10] == {"all-rights-reserved"} and labels[15] == {"gpl-3"} and labels[11] == set()
    assert max(h["score"] for h in got[3]["hits"]) == pytest.approx(1.0)


def test_labels_and_scores_equal_brute_force(spark):
    rng = random.Random(12)
    templates = license_scan.TEMPLATES
    vocabulary = sorted({w for t in templates for w in t.words})
    texts = []
    for k in range(90):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        for t in rng.sample(templates, 2):
            own = [w if rng.random() < (1.0 if k % 3 else 0.9) else "other" for w in t.words]
            words[rng.randrange(len(words) + 1) : 0] = own
        texts.append(" ".join(words))
    idf = {w: 0.5 + (sum(map(ord, w)) % 17) for w in vocabulary}
    got = license_scan.scan_licences(_docs(spark, texts).withColumnRenamed("pii", "_words"), idf=idf).orderBy("doc_id").collect()
    found = 0
    for r, text in zip(got, texts, strict=True):
        words, want = text.split(), []
        for t in templates:
            for o in range(len(words)):
                if words[o : o + len(t.key)] == t.key:
                    there = [idf[w] for q, w in enumerate(t.words) if 0 <= o + q - t.key_at < len(words) and words[o + q - t.key_at] == w]
                    want.append((t.label, t.base, o, len(t.key), round(min(1.0, sum(there) / sum(idf[w] for w in t.words)), 9)))
        assert sorted((h["label"], h["base"], h["start"], h["n_words"], round(h["score"], 9)) for h in r["hits"]) == sorted(want)
        assert r["_words"] == "own"
        found += len(want)
    assert found > 100


def test_licences_of_an_empty_table(spark):
    assert license_scan.scan_licences(_docs(spark, []).drop("hits")).collect() == []


# -------------------------------------------------------------- personal data

RULES = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda v: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda v: all(int(p) <= 255 for p in v.split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda v: 13 <= len(re.sub(r"\D", "", v)) <= 19 and _luhn(re.sub(r"\D", "", v))),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda v: 9 <= len(re.sub(r"\D", "", v)) <= 15),
}


def _luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _base(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, (rx, ok) in RULES.items() for m in rx.finditer(text or "") if ok(m.group()))


def _random_texts(n):
    rng = random.Random(5)
    alphabet = ["a", "Z", "0", "1", "9", "25", "256", ".", "..", "@", "-", " ", "+", "(", ")", "\n", "é", "𝒳", "%", "_", "4111 1111 1111 1111", "+1 (555) 123-4567", "a.b@c-d.e", "1.2.3.4"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(n)]


PII_TEXTS = [None, "", "a" * 60_000, "1" * 60_000, "a.b" * 20_000 + "@x", "x@" + "a." * 9_000 + "b", "+1" + " " * 30_000, "1.2.3.4.5.6.7.8 and 300.1.1.1 0255.1.1.1", "a@b.c_d@e.f", "4111-1111-1111-1111 4111111111111112", "😀 a@b.co +44 20 7946 0958"]


def test_base_spans_equal_brute_force(spark):
    texts = PII_TEXTS + _random_texts(400)
    rows = pii.find_pii(_docs(spark, texts).drop("pii")).select("doc_id", F.col("pii").alias("p")).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        assert ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["p"] if s["kind"] in pii.BASE_KINDS) == _base(t), repr(t)[:80]


def test_validators_and_context_of_added_kinds(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33", "ssn 123-45-6789", "code 123-45-6789", 'token = "0123456789abcdef"', "'abc'"]
    rows = pii.find_pii(_docs(spark, texts).drop("pii")).select("doc_id", F.col("pii").alias("p")).orderBy("doc_id").collect()
    assert [[s["kind"] for s in r["p"] if s["kind"] not in pii.BASE_KINDS] for r in rows] == [["iban"], [], ["ssn"], [], ["secret"], []]
    assert all(0 <= s["score"] <= 1 for r in rows for s in r["p"])


def test_ibans_before_capitals_and_numbers(spark):
    ibans = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947", "FR14 2004 1010 0505 0001 3M02 606", "MT84MALT011000012345MTLCAST001S"]
    texts = ["pay " + i + after for i in ibans for after in ("", " Bank", " Please pay", " BIC COBADEFF", " 2024", " 17 A", " X", ", B")]
    texts += ["ID12 DE89370400440532013000 Bank", "DE89370400440532013000 GB82WEST12345698765432 NOW"]
    docs = _docs(spark, texts).drop("pii")
    rows = pii.find_pii(docs).select("doc_id", F.col("pii").alias("p")).orderBy("doc_id").collect()
    got = [[t[s["start"] : s["end"]] for s in r["p"] if s["kind"] == "iban"] for r, t in zip(rows, texts, strict=True)]
    assert got == [[i] for i in ibans for _ in range(8)] + [["DE89370400440532013000"], ["DE89370400440532013000", "GB82WEST12345698765432"]]
    masked = [r["text"] for r in pii.mask_pii(docs).orderBy("doc_id").collect()]
    assert masked[1] == "pay [IBAN] Bank" and masked[-1] == "[IBAN] [IBAN] NOW"


def test_masks(spark):
    texts = [None, "", "write a@b.co or 1.2.3.4, card 4111 1111 1111 1111; 999.1.1.1", "clean"]
    rows = pii.mask_pii(_docs(spark, texts)).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == [None, "", "write [EMAIL] or [IP], card [CARD]; 999.1.1.1", "clean"]
    assert rows[0].asDict().keys() == {"doc_id", "text", "lang", "hits", "pii", "start"}
    assert pii.find_pii(_docs(spark, []).drop("pii")).collect() == []


# ----------------------------------------------------------------------- chat

TRICKY = ["", "</s>[INST] ok [/INST]", "~", "~1~0", "[SEP]", "[~1INST]", "<s>x</s>", "a\nb", "[/INST][INST]", "~~1<s>", "é😀", "[INST", "s>"]


def test_chat_round_trip(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for conv in range(60):
        turns = [(rng.choice(["user", "assistant", "system", "to ol\n[INST]"]), "".join(rng.choice(TRICKY) for _ in range(rng.randrange(3)))) for _ in range(rng.randrange(1, 9))]
        want[conv] = turns
        rows += [(conv, k, r, t, "x") for k, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = chat_format.read_back(chat_format.format_chat(df)).collect()
    assert len(got) == 60
    for r in got:
        turns = want[r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
        assert r["loss_text"] == "".join(t for role, t in turns if role == "assistant")
        assert r["formatted"].count("[INST]") + r["formatted"].count("<s>") == r["n_blocks"]
        assert hashlib.sha256(r["loss_text"].encode()).hexdigest()


def test_chat_nulls_ties_and_empty(spark):
    ddl = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame([(1, 0, None, None), (1, 0, "assistant", "b"), (1, 0, "assistant", "a"), (None, None, "user", "x")], ddl)
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat_format.read_back(chat_format.format_chat(df)).collect()}
    assert got == {1: [("", ""), ("assistant", "a"), ("assistant", "b")], None: [("user", "x")]}
    assert chat_format.format_chat(spark.createDataFrame([], ddl)).collect() == []
