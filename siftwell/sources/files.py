"""File sources: name lists, JSON lines, uploaded documents, posts and listings at rest."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.entities import fold_company
from siftwell.functions.urls import job_id
from siftwell.operators.funnel import keep_first
from siftwell.schemas import HISTORY, POST, conform


def _entries(lines: DataFrame) -> DataFrame:
    """Lines without comments and blanks; of CSV lines the first field, without quotes."""
    own = F.trim("value")
    first = F.when(own.contains(","), F.regexp_replace(F.trim(F.substring_index(own, ",", 1)), '^"+|"+$', "")).otherwise(own)
    return lines.where((own != "") & ~own.startswith("#")).select(first.alias("name"), "seq").where("name <> ''")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, seq``: lines of text files in file order."""
    return spark.read.text(path).withColumn("seq", F.monotonically_increasing_id())


def company_list(lines: DataFrame) -> DataFrame:
    """``name, seq``: entities in order, unique by folded name; ``lines`` has ``value, seq``."""
    keyed = _entries(lines).withColumn("key", F.coalesce(F.nullif(fold_company(F.col("name")), F.lit("")), F.lower("name")))
    return keep_first(keyed, ["key"], ["seq"]).select("name", "seq")


def allowlist(lines: DataFrame) -> DataFrame:
    """``name``: the distinct folded names of a list."""
    return _entries(lines).select(fold_company(F.col("name")).alias("name")).where("name <> ''").distinct()


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with a fixed schema; lines that are no object are dropped."""
    raw = spark.read.text(path)
    return raw.select(F.from_json("value", HISTORY, {"mode": "PERMISSIVE"}).alias("r")).where(F.col("r").isNotNull() & F.to_json("r").isNotNull() & (F.to_json("r") != "{}")).select("r.*")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label lines, strictly: a bad line fails the read."""
    return spark.read.schema("post_url string, label string").option("mode", "FAILFAST").json(path)


def read_posts(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Stored posts in the record schema."""
    reader = spark.read.schema(POST) if fmt in ("json", "csv") else spark.read
    return conform(reader.format(fmt).load(path))


def read_listings(listings: DataFrame, most: int | None = None) -> DataFrame:
    """Listings (``title, company, location, link, seq``) once each by job id, in order, up to a limit."""
    known = listings.where((F.col("title") != "") | (F.col("link") != ""))
    key = F.coalesce(F.nullif(job_id(F.col("link")), F.lit("")), F.concat_ws("|", "title", "company", "location"))
    one = keep_first(known.withColumn("_key", key), ["_key"], ["seq"]).drop("_key").orderBy("seq")
    return one.limit(most) if most else one


def extract_uploads(uploads: DataFrame) -> DataFrame:
    """``path, text, error`` of ``binaryFile`` rows: ``.txt``, ``.docx`` (paragraphs by line), ``.pdf`` where a parser is installed.

    Parsing containers needs Python; rows stream through in batches.
    """

    def text_of(path: str, content: bytes) -> tuple[str, str]:
        kind = path.lower().rsplit(".", 1)[-1]
        try:
            if kind == "txt":
                return content.decode("utf-8", errors="replace"), ""
            if kind == "docx":
                return _docx(content), ""
            if kind == "pdf":
                return _pdf(content), ""
        except Exception as e:  # noqa: BLE001 - a broken upload is a result, not a failed job
            return "", f"unreadable {kind}: {type(e).__name__}"
        return "", "unsupported file type"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [text_of(p, bytes(c)) for p, c in zip(b["path"], b["content"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "text": [t for t, _ in made], "error": [e for _, e in made]})

    return uploads.select("path", "content").mapInPandas(run, "path string, text string, error string")


def _docx(content: bytes) -> str:
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    body = root.find(f"{ns}body")
    return "\n".join("".join(t.text or "" for t in p.iter(f"{ns}t")) for p in (body if body is not None else root).findall(f"{ns}p"))


def _pdf(content: bytes) -> str:
    from pypdf import PdfReader  # optional

    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)


def question_prompt(text: Column, question: Column, most: int = 30_000) -> Column:
    """The prompt for a question on one document: its first ``most`` characters."""
    return F.concat(F.lit("Document:\n"), F.substring(text, 1, most), F.lit("\n\nQuestion: "), question)
