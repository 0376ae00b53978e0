"""Licence detection with a positional rare-token index (operator 1), in Spark SQL functions only.

The index holds the templates' words with their places.  Document frequencies of all
licence words are counted over the whole corpus; in each template's mandatory key
phrase the two words of the highest IDF are its anchors, and postings lead from an
anchor word to the templates and the places it has there.  A file's anchor words are
looked up in the postings, and each occurrence, less its place in the template, says
where a template would begin; the beginnings that both anchors give are intersected.
There the whole key phrase is verified, and the score is the IDF-weighted share of
the template's words that stand at their relative positions around it.

Everything after the frequency count is a row-wise expression: no shuffle.  The index
is a literal of the plan, whose shape doesn't depend on the number of templates.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm._shared import ascii_lower

#: What separates words once A-Z is lower-cased.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    notice: str
    phrase: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.notice.split()

    @property
    def key(self) -> list[str]:
        return self.phrase.split()

    @property
    def key_at(self) -> int:
        w, k = self.words, self.key
        return next(i for i in range(len(w)) if w[i : i + len(k)] == k)


TEMPLATES = (
    Template("mit", "released under the mit license", "under the mit license", True),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2", True),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc", True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", "terms of the gnu general public license"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("all-rights-reserved", "all rights reserved", "all rights reserved"),
    Template("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "distributed on an as is basis without warranties or conditions"),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included in all copies or substantial portions"),
    Template("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu affero general public license"),
    Template("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "may be used to endorse or promote products derived from this software"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software altered source versions must be plainly marked as such", "altered source versions must be plainly marked"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international license"),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "terms of the eclipse public license"),
    Template("boost-1", "distributed under the boost software license version 1 0", "boost software license version 1"),
    Template("artistic-2", "this package is licensed under the artistic license 2 0", "under the artistic license 2"),
    Template("wtfpl", "do what the fuck you want to public license", "what the fuck you want to public license"),
    Template("proprietary", "this file is proprietary and confidential unauthorized copying of this file via any medium is strictly prohibited", "proprietary and confidential"),
)


def normalised(text: Column) -> Column:
    """The words of a text, lower-cased (A-Z only), joined by single spaces."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), _GAP, " "))


def word_idf(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """IDF of every licence word over all documents; the result is as long as the templates' vocabulary."""
    vocabulary = sorted({w for t in templates for w in t.words})
    words = F.array_intersect(F.split(normalised(F.col(text)), " "), F.array(*map(F.lit, vocabulary)))
    # the empty word stands for the document itself, so the same pass counts the documents
    counts = docs.select(F.explode(F.concat(F.array(F.lit("")), words)).alias("w")).groupBy("w").count()
    seen = {r["w"]: r["count"] for r in counts.collect()}
    total = seen.get("", 0)
    return {w: math.log((total + 1) / (seen.get(w, 0) + 0.5)) for w in vocabulary}


def _anchors(t: Template, idf: dict[str, float]) -> tuple[int, int]:
    """Places in the key phrase of its two words of the highest IDF (the same place twice for a single word)."""
    key = t.key
    ranked = sorted(range(len(key)), key=lambda i: (-idf[key[i]], key[i], i))
    return ranked[0], next((i for i in ranked if key[i] != key[ranked[0]]), ranked[0])


def _array(values: list, kind: str) -> Column:
    return F.array(*map(F.lit, values)).cast(f"array<{kind}>") if values else F.expr(f"cast(array() as array<{kind}>)")


def _postings(places: list[tuple[str, int, int]]) -> tuple[list[str], Column]:
    """The anchor words, and for each of them its ``(template, place in the key phrase)``."""
    held = defaultdict(list)
    for word, template, at in places:
        held[word].append(F.struct(F.lit(template).alias("t"), F.lit(at).alias("q")))
    words = sorted(held)
    lists = F.array(*(F.array(*held[w]) for w in words)) if words else F.expr("cast(array() as array<array<struct<t:int,q:int>>>)")
    return words, lists


_HITS = "array<struct<label:string,base:boolean,start:bigint,n_words:bigint,score:double>>"


def _hits(words: Column, templates: tuple[Template, ...], idf: dict[str, float]) -> Column:
    """The verified places of all key phrases, by template, then by place."""
    anchors = [_anchors(t, idf) for t in templates]
    first = _postings([(t.key[a], n, a) for n, (t, (a, _)) in enumerate(zip(templates, anchors, strict=True))])
    second = _postings([(t.key[b], n, b) for n, (t, (_, b)) in enumerate(zip(templates, anchors, strict=True))])

    def begins(index: tuple[list[str], Column]) -> Column:
        """Where the file's anchor words say that templates begin."""
        known, lists = index
        at = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*known), F.struct(w.alias("w"), i.alias("i")))), lambda p: p.isNotNull())
        each = F.transform(at, lambda p: F.transform(F.element_at(lists, F.array_position(_array(known, "string"), p["w"]).cast("int")), lambda e: F.struct(e["t"].alias("t"), (p["i"] - e["q"]).alias("o"))))
        return F.flatten(each)

    keys = F.array(*(_array(t.key, "string") for t in templates))
    whole = F.array(*(F.array(*(F.struct(F.lit(w).alias("w"), F.lit(q - t.key_at).alias("d"), F.lit(x / sum(_weights(t, idf))).alias("x")) for q, (w, x) in enumerate(zip(t.words, _weights(t, idf), strict=True)))) for t in templates))
    label, base, size = _array([t.label for t in templates], "string"), _array([t.base for t in templates], "boolean"), _array([len(t.key) for t in templates], "bigint")

    def verified(p: Column) -> Column:
        key = F.get(keys, p["t"])
        return (p["o"] >= 0) & (F.slice(words, F.greatest(p["o"], F.lit(0)) + 1, F.size(key)) == key)

    def score(p: Column) -> Column:
        stands = lambda x: (p["o"] + x["d"] >= 0) & (F.get(words, F.greatest(p["o"] + x["d"], F.lit(0))) == x["w"])
        return F.least(F.lit(1.0), F.aggregate(F.get(whole, p["t"]), F.lit(0.0), lambda acc, x: acc + F.when(stands(x), x["x"]).otherwise(0.0)))

    def hit(p: Column) -> Column:
        return F.struct(F.get(label, p["t"]).alias("label"), F.get(base, p["t"]).alias("base"), p["o"].cast("long").alias("start"), F.get(size, p["t"]).alias("n_words"), score(p).alias("score"))

    # the file's rarest licence words are looked up first; most files have none
    looked_up = F.array_intersect(words, _array(first[0], "string"))
    places = F.array_sort(F.filter(F.array_intersect(begins(first), begins(second)), verified))
    return F.when(F.size(looked_up) > 0, F.transform(places, hit)).otherwise(F.expr(f"cast(array() as {_HITS})"))


def _weights(t: Template, idf: dict[str, float]) -> list[float]:
    return [max(idf[w], 1e-6) for w in t.words]


def scan_licences(docs: DataFrame, *, text: str = "text", templates: tuple[Template, ...] = TEMPLATES, idf: dict[str, float] | None = None) -> DataFrame:
    """Add ``n_words, hits array<struct<label,base,start,n_words,score>>`` to every row.

    ``hits`` has each verified place of a key phrase (start: word index from 0) with
    the score of its template.  Null and empty texts have no words and no hits; other
    columns pass through, whatever their names (own ones called ``n_words`` or ``hits`` are
    replaced); repeated rows repeat their results; an empty table stays empty, with the
    IDF of a corpus without documents.
    """
    idf = idf or word_idf(docs, text, templates)
    mine = next(n for n in (f"_words{'_' * k}" for k in range(len(docs.columns) + 1)) if n not in docs.columns)
    own = F.col(mine)
    frame = docs.withColumn(mine, normalised(F.col(text))).withColumn(mine, F.when(own == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(own, " ")))
    words = F.col(mine)
    return frame.withColumns({"n_words": F.size(words).cast("long"), "hits": _hits(words, templates, idf)}).drop(mine)
