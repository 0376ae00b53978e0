"""Files in, files out, and the stream."""

from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from siftwell import schemas
from siftwell.operators.history import few_shots, labelled_examples, upsert
from siftwell.sinks import writers
from siftwell.sources import files
from siftwell.streaming import landing

AS_OF = "2024-01-31T00:00:00+00:00"


def test_company_list_keeps_order_and_drops_repeats(spark, tmp_path):
    (tmp_path / "c.txt").write_text('# header\n\nSarvam AI\nRazorpay\n# skip\nRazorpay\n"Groww",x\n')
    lines = files.read_lines(spark, str(tmp_path / "c.txt"))
    assert [r["name"] for r in files.company_list(lines).orderBy("seq").collect()] == ["Sarvam AI", "Razorpay", "Groww"]
    assert {r["name"] for r in files.allowlist(lines).collect()} == {"sarvam", "razorpay", "groww"}


def test_history_reads_tolerantly_and_labels_strictly(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text('{"post_url":"u","kept":true}\nnot json\n[1]\n{"post_url":"v","link_domains":["a"]}\n')
    assert sorted(r["post_url"] for r in files.read_history(spark, str(tmp_path / "h.jsonl")).collect()) == ["u", "v"]
    (tmp_path / "l.jsonl").write_text('{"post_url":"u","label":"good"}\nbroken\n')
    with pytest.raises(Exception):  # noqa: B017
        files.read_labels(spark, str(tmp_path / "l.jsonl")).collect()


def test_listings_are_unique_by_job_id(spark):
    rows = [("SDE", "A", "X", "/jobs/view/1/?a", 0), ("SDE", "A", "X", "/jobs/view/1/?b", 1), ("ML", "B", "Y", "", 2), ("ML", "B", "Y", "", 3), ("", "B", "Y", "", 4)]
    df = spark.createDataFrame(rows, "title string, company string, location string, link string, seq int")
    assert [r["seq"] for r in files.read_listings(df).collect()] == [0, 2]
    assert files.read_listings(df, 1).count() == 1


def test_uploads_become_text(spark, tmp_path):
    xml = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>'
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", xml)
    for name, data in {"a.txt": b"caf\xc3\xa9 \xff", "b.docx": held.getvalue(), "c.exe": b"x", "d.docx": b"broken"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[-1]: (r["text"], r["error"]) for r in files.extract_uploads(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert got["a.txt"] == ("café �", "") and got["b.docx"] == ("one\ntwo", "")
    assert got["c.exe"] == ("", "unsupported file type") and got["d.docx"][1].startswith("unreadable docx")
    prompt = spark.range(1).select(files.question_prompt(F.lit("x" * 40_000), F.lit("why?")).alias("p")).first()["p"]
    assert prompt.count("x") == 30_000 and prompt.endswith("Question: why?")


ROWS = [(0, "Acme", "SDE", "u1", "a|b"), (1, "", "ML", "", "x\ny"), (2, "Acme", "QA", "u3", "")]


def _results(spark):
    return spark.createDataFrame(ROWS, "seq int, company string, role string, post_url string, why_matched string")


def test_json_and_csv(spark, tmp_path):
    p = writers.write_results(_results(spark), tmp_path / "o" / "r.json", "json", ("company", "absent"), meta={"query": "q"}, as_of=AS_OF, order="seq")
    data = json.loads(p.read_text())
    assert list(data) == ["query", "scraped_at", "count", "results"] and data["results"][0] == {"company": "Acme", "absent": ""}
    p = writers.write_results(_results(spark), tmp_path / "r.csv", "csv", ("company", "role"), as_of=AS_OF, order="seq")
    assert p.read_text().splitlines() == ["company,role", "Acme,SDE", ",ML", "Acme,QA"]


def test_markdown_and_text_groups(spark, tmp_path):
    fields = ("role", "post_url", "why_matched")
    md = writers.write_results(_results(spark), tmp_path / "r.md", "md", fields, title="T", meta={"group_by": "company"}, as_of=AS_OF, order="seq").read_text()
    assert "## Acme (2)" in md and "| 1 | SDE | [open](u1) | a\\|b |" in md and "| 3 | ML |  | x y |" in md
    txt = writers.write_results(_results(spark), tmp_path / "r.txt", "txt", schemas.POST_FIELDS, title="T", meta={"group_by": "company", "query": "q"}, as_of=AS_OF, order="seq").read_text()
    assert "=== (unknown) (1 post) ===" in txt and "--- 3 ---\ncompany: \nrole: ML" in txt and "Query: q" in txt
    native = _results(spark).select(writers.markdown_row(fields, F.col("seq") + 1).alias("l")).first()["l"]
    assert native == "| 1 | SDE | [open](u1) | a\\|b |"


def test_formats():
    assert writers.infer_format("x.MD") == "md" and writers.infer_format("x") == "json" and writers.infer_format("x.csv", "TXT") == "txt"
    with pytest.raises(ValueError):
        writers.write_results(None, "x", "xml", as_of=AS_OF)


def test_upsert_and_examples(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 3, "b"), ("m", 2, "c")], "key string, seq int, v string")
    assert {(r["key"], r["v"], r["first_seq"]) for r in upsert(rows, "key", "seq").collect()} == {("k", "b", 1), ("m", "c", 2)}
    hist = schemas.conform(spark.createDataFrame([("Acme Inc", "good", f"2024-01-0{k}", f"u{k}") for k in range(1, 7)], "company string, user_label string, timestamp string, post_url string"), schemas.HISTORY)
    examples = labelled_examples(hist)
    assert sorted(r["post_url"] for r in examples.collect()) == ["u3", "u4", "u5", "u6"]
    assert few_shots(examples).first()["few_shots"].count("- GOOD") == 4


def test_stream_keeps_each_identity_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    post = {"poster": "A", "post_text": "We're hiring an AI intern. Apply now.", "post_url": "", "arrived": "2024-01-01T00:00:00Z"}
    for k, text in enumerate([post["post_text"], post["post_text"].replace(" ", "  "), "hello"]):
        (src / f"{k}.json").write_text(json.dumps(post | {"post_text": text}) + "\n")
    q = landing.start(landing.matched_once(landing.landing(spark, str(src))), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    held = {}
    sink = landing.upsert_into(lambda: held["t"], lambda df: held.update(t=spark.createDataFrame(df.collect(), df.schema)), "key", "seq")
    held["t"] = spark.createDataFrame([("k", 1)], "key string, seq int")
    for _ in range(2):
        sink(spark.createDataFrame([("k", 2), ("n", 3)], "key string, seq int"), 0)
    assert sorted((r["key"], r["seq"]) for r in held["t"].collect()) == [("k", 2), ("n", 3)]
