"""Result files: JSON, CSV, Markdown and text; and a distributed writer for large results.

The formats are one file with a header that counts the rows, so they suit results of a
size a person reads: their rows are held by the driver.
:func:`write_parts` writes results of any size from the executors.
"""

from __future__ import annotations

import csv
import json
import os
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import escape_markdown, header_label, text_of
from siftwell.operators.ranks import numbered, summed_before
from siftwell.schemas import JOB_FIELDS, POST_FIELDS, RESULT_FIELDS, TXT_FIELDS

FORMATS = ("json", "csv", "md", "txt")
EXTENSIONS = {".json": "json", ".csv": "csv", ".md": "md", ".markdown": "md", ".txt": "txt"}
LINKS = ("link", "job_link", "post_url")


def infer_format(path: str | Path, explicit: str | None = None, default: str = "json") -> str:
    return explicit.lower() if explicit else EXTENSIONS.get(Path(path).suffix.lower(), default)


def project(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The fields as text; absent ones are empty."""
    return df.select(*((text_of(F.col(f)) if f in df.columns else F.lit("")).alias(f) for f in fields))


def group_index(df: DataFrame, group: str, seq: str) -> DataFrame:
    """Add ``group_name, group_first, group_size, out_index``: groups in first-seen order, one running number.

    Sizes and first places come from a partial aggregate; the running number is made in
    slices of the order, so no task holds all rows or a whole group.
    """
    named = df.withColumn("group_name", F.coalesce(F.nullif(text_of(group), F.lit("")), F.lit("(unknown)")))
    facts = named.groupBy("group_name").agg(F.min(seq).alias("group_first"), F.count(F.lit(1)).alias("group_size"))
    facts = summed_before(facts, ["group_first"], "_before", weight=F.col("group_size"))
    rows = numbered(named, [seq], "_number", ["group_name"]).join(facts, "group_name")
    return rows.withColumn("out_index", F.col("_before") + F.col("_number") + 1).drop("_before", "_number")


def markdown_row(fields: Sequence[str], index: Column) -> Column:
    """One table row: links as ``[open](url)``, other cells escaped."""
    cells = [F.when(text_of(f) != "", F.concat(F.lit("[open]("), text_of(f), F.lit(")"))).otherwise(F.lit("")) if f in LINKS else escape_markdown(F.col(f)) for f in fields]
    return F.concat(F.lit("| "), F.concat_ws(" | ", index.cast("string"), *cells), F.lit(" |"))


def text_block(fields: Sequence[str], index: Column, skip_blank: Sequence[str] = ()) -> Column:
    """``--- n ---`` and one ``field: value`` line each; fields of ``skip_blank`` only with a value."""
    lines = [F.when((text_of(f) != "") | F.lit(f not in skip_blank), F.concat(F.lit(f"{f}: "), text_of(f))) for f in fields]
    return F.concat_ws("\n", F.concat(F.lit("--- "), index.cast("string"), F.lit(" ---")), *lines)


def result_blocks(df: DataFrame, order: str = "seq") -> DataFrame:
    """``out_index, block`` for terminal output; a blank source type is left out."""
    return numbered(df, [order], "_number").withColumn("out_index", F.col("_number") + 1).select("out_index", text_block(RESULT_FIELDS, F.col("out_index"), skip_blank=("source_type",)).alias("block"))


def result_row(df: DataFrame) -> DataFrame:
    """Compact result fields: the company or poster, a role or a snippet, and the gate's reason once."""
    from siftwell.functions.text import snippet

    t = lambda c: F.trim(text_of(c)) if c in df.columns else F.lit("")
    why, gate = t("why_matched"), t("gate_reason")
    more = F.concat(F.lit("gate_reason:"), gate)
    return df.select(
        F.when(t("company") != "", t("company")).otherwise(t("poster")).alias("company"),
        F.when(t("role") != "", t("role")).otherwise(snippet(t("snippet"), 80)).alias("role"),
        F.when((gate != "") & ~F.contains(why, gate), F.when(why != "", F.concat(why, F.lit("; "), more)).otherwise(more)).otherwise(why).alias("why_matched"),
        t("post_url").alias("post_url"),
        t("source_type").alias("source_type"),
    )


def write_results(df: DataFrame, path: str | Path, fmt: str = "json", fields: Sequence[str] = JOB_FIELDS, title: str = "Results", meta: Mapping[str, object] | None = None, *, as_of: str, order: str | None = None) -> Path:
    """Write one file of ``df`` in the order of ``order`` and return its path; ``as_of`` is the time it states."""
    if (fmt or "json").lower() not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}; one of {', '.join(FORMATS)}")
    fmt, fields, meta = (fmt or "json").lower(), list(fields), dict(meta or {})
    if fmt == "txt" and fields == list(POST_FIELDS):
        fields = list(TXT_FIELDS)
    group = meta.get("group_by") if isinstance(meta.get("group_by"), str) and fmt in ("md", "txt") else None
    ordered = df.orderBy(order) if order else df
    keep = project(ordered, [*fields, *([group] if group and group not in fields else [])])
    rows = [r.asDict() for r in keep.toLocalIterator()]
    out = Path(path).expanduser()
    out.parent.mkdir(parents=True, exist_ok=True)
    shown = {k: v for k, v in meta.items() if k != "group_by"}
    if fmt == "csv":
        with out.open("w", newline="", encoding="utf-8") as f:
            w = csv.DictWriter(f, fieldnames=fields, extrasaction="ignore")
            w.writeheader()
            w.writerows(rows)
        return out.resolve()
    if fmt == "json":
        body = json.dumps({**meta, "scraped_at": as_of, "count": len(rows), "results": [{k: r[k] for k in fields} for r in rows]}, indent=2, ensure_ascii=False)
    else:
        body = (_markdown if fmt == "md" else _blocks)(rows, fields, title, shown, as_of, group)
    out.write_text(body.rstrip() + "\n", encoding="utf-8")
    return out.resolve()


def _sections(rows: list[dict], group: str | None) -> list[tuple[str | None, list[tuple[int, dict]]]]:
    """Rows by group in first-seen order, numbered through."""
    if group is None:
        return [(None, list(enumerate(rows, 1)))]
    held: dict[str, list[dict]] = {}
    for r in rows:
        held.setdefault(r[group] or "(unknown)", []).append(r)
    n, out = 0, []
    for name, own in held.items():
        out.append((name, list(enumerate(own, n + 1))))
        n += len(own)
    return out


def _blocks(rows: list[dict], fields: list[str], title: str, meta: Mapping[str, object], as_of: str, group: str | None) -> str:
    lines = [title, "", *(f"{header_label(k)}: {v}" for k, v in meta.items()), f"Scraped: {as_of}", f"Results: {len(rows)}", ""]
    for name, own in _sections(rows, group):
        if name is not None:
            lines += [f"=== {name} ({len(own)} post{'s' * (len(own) != 1)}) ===", ""]
        for n, r in own:
            lines += [f"--- {n} ---", *(f"{f}: {r[f]}" for f in fields), ""]
    return os.linesep.join(lines) if os.linesep == "\n" else "\n".join(lines)


def _markdown(rows: list[dict], fields: list[str], title: str, meta: Mapping[str, object], as_of: str, group: str | None) -> str:
    cell = lambda f, v: (f"[open]({v})" if v else "") if f in LINKS else v.replace("|", "\\|").replace("\n", " ").strip()
    head = ["| # | " + " | ".join(map(header_label, fields)) + " |", "| --- | " + " | ".join(["---"] * len(fields)) + " |"]
    lines = [f"# {title}", "", *(f"- {header_label(k)}: {v}" for k, v in meta.items()), f"- Scraped: {as_of}", f"- Results: {len(rows)}", ""]
    for name, own in _sections(rows, group):
        lines += ([f"## {name} ({len(own)})", ""] if name is not None else []) + head
        lines += ["| " + " | ".join([str(n), *(cell(f, r[f]) for f in fields)]) + " |" for n, r in own] + [""]
    return "\n".join(lines)


def write_parts(df: DataFrame, path: str, fmt: str = "parquet", fields: Sequence[str] | None = None, mode: str = "error") -> None:
    """Write a result of any size from the executors, as Parquet, JSON lines or CSV parts."""
    out = project(df, fields) if fields else df
    writer = out.write.mode(mode)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
