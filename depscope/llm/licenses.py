"""License scans: sparse TF-IDF cosine to templates, and inheritance from the nearest directory.

A text is cut into paragraphs at lines without words, such as empty ones or a lone comment mark. A paragraph that has
a licence word is compared with the templates in three forms, without comment marks: all of it, its comment
lines only, and each line with a licence word; so headers may be wrapped, and stand beside code. The whole
text of a file whose name says that it is a licence is compared too, whatever its length. An SPDX line names its licence itself. Weights are log((1 + N) / (1 + df)) with the
document frequency df of each template term over all files; terms outside the templates weigh as
unseen ones, so that running text around a notice lowers its cosine. A file takes its best template
if the cosine reaches the threshold.

Directories take the licence of a licence file in them. A file without one of its own inherits
from the nearest directory above it that has one: each distinct directory is joined with its own
ancestors by path, and the deepest match counts.

Terms are words of a-z and 0-9 in lower-cased text. All of it is DataFrame functions. Broadcast is
only the table of template terms. Defined results: null text has no licence of its own but may
inherit; null paths lie in the top directory; ties between templates go to the first by name; rows
with equal path and text share their result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from depscope.scratch import materialize

# Wording by which the licences are known, one short template each or more.
TEMPLATES = {
    "AGPL-3.0": ("This program is licensed under the GNU Affero General Public License, version 3.",),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-NC-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "CC0-1.0": ("This work is dedicated to the public domain under the CC0 1.0 Universal license.",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.",),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
# Words of which a line must have one to be compared, and names of licence files.
ANCHORS = ("licen", "copyright", "permission", "redistribution", "public domain", "warrant")
LICENSE_NAME = r"^(licen[cs]e|copying|notice|unlicense)([.\-].*)?$"
NOT_TERM = "[^a-z0-9]+"
# Patterns of both engines: what parts paragraphs, lines of comments, and SPDX lines.
PARAGRAPH = r"\n[\s/*#;%!<>-]*\n"
COMMENT = r"^\s*(//|/\*|\*|#|--|;|%|<!--|dnl\b|rem\b|REM\b)"
OPENING = r"^\s*([^\n]*)"
SPDX = r"(?i)SPDX-License-Identifier:[ \t(]*([A-Za-z0-9.+-]+)"
THRESHOLD = 0.7


def _terms(text: str) -> list[str]:
    return [t for t in re.split(NOT_TERM, text.lower()) if t]


def template_counts() -> dict[tuple[str, int], dict[str, int]]:
    """Term counts of every template, keyed by licence and number."""
    out: dict[tuple[str, int], dict[str, int]] = {}
    for name, texts in TEMPLATES.items():
        for i, text in enumerate(texts):
            counts: dict[str, int] = {}
            for t in _terms(text):
                counts[t] = counts.get(t, 0) + 1
            out[name, i] = counts
    return out


def _text_terms(text: Column) -> Column:
    return F.split(F.lower(text), NOT_TERM)


def document_frequencies(files: DataFrame) -> tuple[int, DataFrame]:
    """(number of files, term and df of template terms) over all files (text)."""
    known = F.array(*[F.lit(t) for t in sorted({t for c in template_counts().values() for t in c})])
    found = files.select(F.explode(F.array_intersect(_text_terms(F.coalesce("text", F.lit(""))), known)).alias("term"))
    return files.count(), found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def weight_table(spark, total: int, frequencies: DataFrame) -> DataFrame:
    """(term, idf, one column per template: its term's share of the unit vector); a row per template term."""
    df = {r["term"]: r["df"] for r in frequencies.collect()}  # at most one row per template term
    counts = template_counts()
    terms = sorted({t for c in counts.values() for t in c})
    idf = {t: math.log((1 + total) / (1 + df.get(t, 0))) for t in terms}
    norm = {k: math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items())) for k, c in counts.items()}
    rows = [F.struct(F.lit(t).alias("term"), F.lit(idf[t]).alias("idf"), *[
        F.lit(c.get(t, 0) * idf[t] / norm[k] if norm[k] else 0.0).alias(f"w{i}") for i, (k, c) in enumerate(counts.items())]) for t in terms]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def units(files: DataFrame) -> DataFrame:
    """(file, unit, text): paragraphs with a licence word, their comment lines and their licence lines; whole texts of licence files."""
    text = F.coalesce("text", F.lit(""))
    anchored = lambda x: _any_of([F.contains(F.lower(x), F.lit(a)) for a in ANCHORS])
    listed = lambda found: F.transform(found, lambda x, i: F.struct(i.alias("at"), x.alias("text")))
    # The cheap test of the whole text spares most texts the split into paragraphs.
    parts = files.where(anchored(text)).select("file", F.filter(F.split(text, PARAGRAPH), anchored).alias("parts"))
    parts = parts.select("file", F.posexplode("parts").alias("part", "text"))
    lines = F.split("text", "\n")
    comments = F.filter(lines, lambda x: x.rlike(COMMENT))
    # Marks at line ends would part words from their line's; terms ignore the rest of them.
    forms = F.concat(
        F.array(F.col("text")),
        F.when((F.size(comments) > 0) & (F.size(comments) < F.size(lines)), F.array(F.array_join(comments, "\n"))).otherwise(F.array().cast("array<string>")),
        F.when(F.size(lines) > 1, F.filter(lines, anchored)).otherwise(F.array().cast("array<string>")))
    cut = parts.select("file", "part", F.explode(listed(forms)).alias("u")).where(anchored(F.col("u.text")))
    whole = files.where(is_license_name(F.col("path"))).select("file", F.struct(F.lit(-1).alias("part"), F.lit(0).alias("at")).alias("unit"), text.alias("text"))
    return cut.select("file", F.struct("part", F.col("u.at").alias("at")).alias("unit"), "u.text").union(whole)


def spdx_names(files: DataFrame) -> DataFrame:
    """(file, license) of files with an SPDX line that names a licence of the templates; the first such line counts."""
    # `-only`, `-or-later` and `+` say which versions; the templates do not tell them apart.
    told = F.regexp_replace(F.regexp_extract("text", SPDX, 1), r"(-only|-or-later|\+)$", "")
    known = F.create_map(*[F.lit(x) for name in TEMPLATES for x in (name.lower(), name)])
    return files.where(F.contains(F.lower("text"), F.lit("spdx-license"))).select("file", known[F.lower(told)].alias("license")).where("license IS NOT NULL")


def _any_of(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out |= c
    return out


def base_name(path: Column) -> Column:
    return F.substring_index(F.coalesce(path, F.lit("")), "/", -1)


def directory(path: Column) -> Column:
    return F.regexp_replace(F.coalesce(path, F.lit("")), r"(^|/)[^/]*$", "")


def is_license_name(path: Column) -> Column:
    return F.lower(base_name(path)).rlike(LICENSE_NAME)


def best_templates(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(file, license, score) of files (file, path, text) that reach the threshold."""
    total, frequencies = document_frequencies(files)
    weights = weight_table(files.sparkSession, total, frequencies)
    names = [k[0] for k in template_counts()]
    unseen = math.log(1 + total)
    terms = units(files).select("file", "unit", F.explode(_text_terms(F.col("text"))).alias("term")).where("term <> ''")
    counted = terms.groupBy("file", "unit", "term").agg(F.count(F.lit(1)).alias("n"))
    # One row per template term: bounded by the templates, so it may be broadcast.
    met = counted.join(F.broadcast(weights), "term", "left")
    tfidf = F.col("n") * F.coalesce("idf", F.lit(unseen))
    dots = [F.sum(F.coalesce(F.col(f"w{i}"), F.lit(0.0)) * tfidf).alias(f"d{i}") for i in range(len(names))]
    sums = met.groupBy("file", "unit").agg(F.sum(tfidf * tfidf).alias("norm2"), *dots)
    cosine = lambda i: F.round(F.when(F.col("norm2") > 0, F.col(f"d{i}") / F.sqrt("norm2")).otherwise(0.0), 6)
    scores = F.array(*[F.struct((-cosine(i)).alias("less"), F.lit(name).alias("license")) for i, name in enumerate(names)])
    named = spdx_names(files).select("file", F.struct(F.lit(-1.0).alias("less"), "license").alias("best"))
    best = sums.select("file", F.array_min(scores).alias("best")).union(named).groupBy("file").agg(F.min("best").alias("best"))
    return best.select("file", F.col("best.license").alias("license"), (-F.col("best.less")).alias("score")).where(F.col("score") >= threshold)


def inherit(scanned: DataFrame) -> DataFrame:
    """Add (effective, inherited_from) to files (path, license, score): the file's own licence, else that of the nearest directory."""
    placed = scanned.withColumn("dir", directory(F.col("path")))
    owned = placed.where(is_license_name(F.col("path")) & F.col("license").isNotNull())
    owned = owned.groupBy(F.col("dir").alias("above")).agg(F.min(F.struct((-F.col("score")).alias("less"), "license"))["license"].alias("found"))
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    ups = F.transform(F.sequence(F.lit(0), depth), lambda k: F.struct(k.alias("depth"), F.call_function("substring_index", F.col("dir"), F.lit("/"), k).alias("above")))
    above = placed.select("dir").distinct().select("dir", F.explode(ups).alias("up")).select("dir", "up.depth", "up.above")
    nearest = above.join(owned, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "found")).alias("near"))
    own = F.col("license").isNotNull()
    return placed.join(nearest, "dir", "left").select(
        *scanned.columns, F.coalesce("license", "near.found").alias("effective"), F.when(~own, F.col("near.above")).alias("inherited_from"))


def scan(files: DataFrame, threshold: float = THRESHOLD, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., path, license, score, effective, inherited_from) of files (path, text), one row each."""
    keyed = files.select(*keep, "path", "text", F.struct("path", F.xxhash64("text").alias("hash")).alias("file"))
    # Rows with equal path and text are one file.
    found = best_templates(keyed.select("path", "text", "file"), threshold).withColumnRenamed("file", "of")
    rows = keyed.select(*keep, "path", "file").join(found, F.col("file").eqNullSafe(F.col("of")), "left").select(*keep, "path", "license", "score")
    return inherit(materialize(rows, "licenses"))


def document_paths(docs: DataFrame) -> DataFrame:
    """(doc_id, path, text): documents as files of their source and language; texts that open with a licence line are licence files.

    Such a text is the LICENSE of its folder, or of its language if its number is even. A null number is `none`.
    """
    opening = F.regexp_extract(F.coalesce("text", F.lit("")), OPENING, 1)
    notice = F.contains(F.lower(opening), F.lit("licen"))
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    folder = F.concat(F.lit("part-"), F.coalesce(F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("none")))
    top = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")))
    at = F.when(notice & F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False)), top).otherwise(F.concat_ws("/", top, folder))
    name = F.when(notice, F.concat(F.lit("LICENSE-"), number)).otherwise(F.concat(number, F.lit(".txt")))
    return docs.select("doc_id", F.concat_ws("/", at, name).alias("path"), "text")


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """All documents with their own licence, and the one that holds for them."""
    return scan(document_paths(spark.read.parquet(f"{sf_dir}/documents.parquet")), keep=["doc_id"])


def _values(rows: list[tuple]) -> str:
    quote = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


_ANCHORED = " OR ".join(f"contains(lower({{0}}), '{a}')" for a in ANCHORS)
ORACLE = f"""
WITH templates(license, no, body) AS (VALUES {_values([(k, i, t) for k, v in TEMPLATES.items() for i, t in enumerate(v)])}),
template_terms AS (
  SELECT license, no, term, count(*) AS n
  FROM (SELECT license, no, unnest(regexp_split_to_array(lower(body), '[^a-z0-9]+')) AS term FROM templates) WHERE term <> '' GROUP BY ALL
), files AS (
  SELECT doc_id, coalesce(text, '') AS text, contains(lower(regexp_extract(coalesce(text, ''), '{OPENING}', 1)), 'licen') AS notice,
    coalesce(source, 'none') || '/' || coalesce(lang, 'none') AS top FROM documents
), placed AS (
  SELECT doc_id, text, notice, CASE WHEN notice AND doc_id % 2 = 0 THEN top ELSE top || '/part-' || CAST(floor(doc_id / 1000) AS BIGINT) END AS dir,
    CASE WHEN notice THEN 'LICENSE-' || doc_id ELSE doc_id || '.txt' END AS name FROM files
), total AS (SELECT count(*) AS n FROM documents),
df AS (
  SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS term FROM files)
  WHERE term IN (SELECT term FROM template_terms) GROUP BY term
), idf AS (
  SELECT term, ln((1 + (SELECT n FROM total)) / (1 + coalesce(df, 0))) AS idf FROM (SELECT DISTINCT term FROM template_terms) LEFT JOIN df USING (term)
), weights AS (
  SELECT license, no, term, n * idf AS w, sqrt(sum(n * idf * n * idf) OVER (PARTITION BY license, no)) AS norm FROM template_terms JOIN idf USING (term)
), parts AS (
  SELECT doc_id, unnest(regexp_split_to_array(text, '{PARAGRAPH}')) AS body, generate_subscripts(regexp_split_to_array(text, '{PARAGRAPH}'), 1) AS part FROM placed
), anchored AS (
  SELECT doc_id, part, body, string_split(body, chr(10)) AS lines, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '{COMMENT}')) AS comments
  FROM parts WHERE {_ANCHORED.format("body")}
), units AS (
  SELECT doc_id, concat(part, '-a') AS unit, body FROM anchored
  UNION ALL SELECT doc_id, concat(part, '-c'), array_to_string(comments, chr(10)) FROM anchored
    WHERE len(comments) BETWEEN 1 AND len(lines) - 1 AND ({_ANCHORED.format("array_to_string(comments, chr(10))")})
  UNION ALL SELECT doc_id, concat(part, '-', i), line FROM (
    SELECT doc_id, part, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM anchored WHERE len(lines) > 1) WHERE {_ANCHORED.format("line")}
  UNION ALL SELECT doc_id, 'whole', text FROM placed WHERE notice
), spdx AS (
  SELECT doc_id, license FROM (SELECT doc_id, lower(regexp_replace(regexp_extract(text, '{SPDX}', 1), '(-only|-or-later|\\+)$', '')) AS told FROM placed) s
  JOIN (SELECT DISTINCT license FROM templates) t ON lower(t.license) = told
), unit_terms AS (
  SELECT doc_id, unit, term, count(*) AS n
  FROM (SELECT doc_id, unit, unnest(regexp_split_to_array(lower(body), '[^a-z0-9]+')) AS term FROM units) WHERE term <> '' GROUP BY ALL
), weighed AS (
  SELECT doc_id, unit, term, n * coalesce(idf, ln(1 + (SELECT n FROM total))) AS w FROM unit_terms LEFT JOIN idf USING (term)
), norms AS (SELECT doc_id, unit, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY ALL),
cosines AS (
  SELECT doc_id, unit, license, no, round(sum(a.w * b.w / b.norm) / any_value(c.norm), 6) AS score
  FROM weighed a JOIN weights b USING (term) JOIN norms c USING (doc_id, unit) GROUP BY ALL
), own AS (
  SELECT doc_id, license, score FROM (SELECT doc_id, license, score FROM cosines UNION ALL SELECT doc_id, license, 1.0 FROM spdx) WHERE score >= {THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) = 1
), scanned AS (SELECT doc_id, dir, dir || '/' || name AS path, notice, license, score FROM placed LEFT JOIN own USING (doc_id)),
owned AS (
  SELECT dir AS above, license AS found FROM scanned WHERE notice AND license IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) = 1
), nearest AS (
  SELECT dir, above, found FROM (SELECT DISTINCT dir FROM scanned) JOIN owned ON above = '' OR dir = above OR starts_with(dir, above || '/')
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(above) DESC) = 1
)
SELECT doc_id, path, license, score, coalesce(license, found) AS effective, CASE WHEN license IS NULL THEN above END AS inherited_from
FROM scanned LEFT JOIN nearest USING (dir)
"""
