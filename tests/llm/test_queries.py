"""The registered queries themselves on the small tables: columns, one row each, digests against plain Python and SQL."""

from __future__ import annotations

import hashlib
import os
import zlib

import numpy as np
import pytest

from siftwell.llm import queries

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "embeddings", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def _rows(spark, name):
    return queries.QUERIES[name](spark, DATA).collect()


def _texts(con):
    return dict(con.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def test_chat_query_equals_its_sql(spark, con):
    got = queries.QUERIES["op6_chat_format"](spark, DATA)
    cur = con.execute(queries.ORACLE_SQL["op6_chat_format"])
    assert sorted(map(tuple, got.select(*(d[0] for d in cur.description)).collect())) == sorted(cur.fetchall())


@pytest.mark.parametrize(("name", "label", "folds", "fold", "least"), [("op4_toxicity", "toxic", 5, 0, 0.5), ("op9_quality_classifier", "quality", 4, 2, 0.7)])
def test_scores_of_every_document(spark, con, name, label, folds, fold, least):
    rows = {r["doc_id"]: r for r in _rows(spark, name)}
    assert rows.keys() == _texts(con).keys()
    truth = dict(con.execute(f"SELECT doc_id, {label} FROM labels WHERE {label} IS NOT NULL").fetchall())
    for k, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % folds == fold) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least)
    sides = [[r["score"] for k, r in rows.items() if truth.get(k) == y] for y in (0, 1)]
    assert not sides[0] or not sides[1] or np.mean(sides[1]) > np.mean(sides[0])


def test_licence_and_pii_digests(spark, con):
    texts = _texts(con)
    found = {r["doc_id"]: r for r in _rows(spark, "op3_pii")}
    assert found.keys() == texts.keys()
    for r in found.values():
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        base = [s for s in spans if s[0] in ("email", "ip", "card", "phone")]
        assert hashlib.sha256(",".join(map(":".join, base)).encode()).hexdigest() == r["base_sha256"]
        assert [sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")] == [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")]
        assert all(int(b) <= len(texts[r["doc_id"]]) for _, _, b in spans)
    licences = {r["doc_id"]: r for r in _rows(spark, "op1_license_scan")}
    assert licences.keys() == texts.keys()
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in licences.values())
    assert all((r["first_word"] is None) == (r["n_base"] == 0) for r in licences.values())


def test_groups_name_their_smallest_member(spark, con):
    rows = _rows(spark, "op5_simhash_near_dedup")
    assert sorted(r["doc_id"] for r in rows) == sorted(_texts(con))
    fp = {r["doc_id"]: int(r["fingerprint"], 16) for r in rows}
    group = {r["doc_id"]: r["component_id"] for r in rows}
    ids = sorted(fp)
    x = np.array([fp[k] for k in ids], dtype=np.uint64)
    for a, b in zip(*np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4), strict=True):
        assert group[ids[a]] == group[ids[b]]
    assert all(group[g] == g and g <= k for k, g in group.items())
    vectors = _rows(spark, "op7_embedding_near_dedup")
    assert {r["vec_id"] for r in vectors} == {k for (k,) in con.execute("SELECT vec_id FROM embeddings").fetchall()}
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in vectors)


def test_packed_pieces_rebuild_every_document(spark, con):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.tokenizer_path())
    rows, bins = _rows(spark, "op8_best_fit_packing"), {}
    ids = {k: [*model.encode(t, add_special_tokens=False).ids, 0] for k, t in _texts(con).items()}
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"] and r["start"] == 2048 * r["piece"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    for own in bins.values():
        assert [o for o, _ in sorted(own)] == np.cumsum([0, *(n for _, n in sorted(own))]).tolist()[:-1] and sum(n for _, n in own) <= 2048


def test_leaks_and_passages_name_documents(spark, con):
    texts = _texts(con)
    items = {k for (k,) in con.execute("SELECT item_id FROM benchmark").fetchall()}
    assert all(r["doc_id"] in texts and r["item_id"] in items and r["score"] >= 0.5 for r in _rows(spark, "op10_decontaminate"))
    for r in _rows(spark, "op2_substring_dedup"):
        assert 0 <= r["start"] < r["end"] <= len(texts[r["doc_id"]]) and r["end"] - r["start"] >= 120 and r["first_doc_id"] <= r["doc_id"]
