"""Licences of texts by sparse TF-IDF and path inheritance (operator 4): DataFrame functions only.

Pieces of a whole text that hold a licence cue are compared with licence notices: its lines, cut at
the ends of sentences, and its sentences as they run over wrapped lines, each distinct one once a
text. Terms weigh by their frequency and by a document frequency counted over all such pieces of the
corpus and the notices; the cosine to the nearest notice decides. A licence file lends its licence to its
directory, and a text without a licence of its own takes that of its nearest ancestor directory.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm.common import table, written

# Notices by which public licences are declared.
NOTICES = (
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("BSD", "Released under the BSD License"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC0-1.0", "Released into the public domain under CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
)
# A piece without any of these is no licence notice; each notice holds one.
CUES = ("licen", "public domain", "hereby granted", "redistribution and use", "redistribute")
SENTENCE = r"\n|[.!?;][ \t\r]+"
#: Wrapped sentences end at a line without letters and digits, or at a full stop.
WRAPPED = r"\n[^\n0-9A-Za-z]*\n|[.!?][ \t\r\n]+"
TERM = r"[^a-z0-9.]+"
THRESHOLD = 0.6
FILE_NAME = r"(?i)^(licen[sc]e|copying|unlicense)([._-].*)?$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def has_cue(text: Column) -> Column:
    """Whether a lower-cased text holds a cue."""
    found = F.lit(False)
    for cue in CUES:
        found = found | text.contains(cue)
    return found


def terms_of(notice: str) -> Counter:
    return Counter(t for x in re.split(TERM, notice.lower()) if (t := x.strip(".")))


VECTORS = [terms_of(n) for _, n in NOTICES]
VOCABULARY = sorted(set().union(*VECTORS))


def weights(found: dict[str, int], sentences: int) -> tuple[dict[str, float], dict[str, list[float]]]:
    """Inverse document frequency of each notice term, and its weight in each (unit) notice vector."""
    n = sentences + len(NOTICES)
    idf = {t: math.log((1 + n) / (1 + found.get(t, 0) + sum(t in v for v in VECTORS))) + 1 for t in VOCABULARY}
    norms = [math.sqrt(sum((c * idf[t]) ** 2 for t, c in v.items())) for v in VECTORS]
    return idf, {t: [v[t] * idf[t] / norm for v, norm in zip(VECTORS, norms, strict=True)] for t in VOCABULARY}


def nearest(terms: DataFrame, idf: dict[str, float], unit: dict[str, list[float]], threshold: float) -> DataFrame:
    """(row, best) of rows with a piece near enough to a notice; best = (cosine, -notice)."""
    mapped = lambda values, lit: F.create_map(*(x for t in VOCABULARY for x in (F.lit(t), lit(values[t]))))
    weigh = F.col("tf") * F.coalesce(F.try_element_at(mapped(idf, F.lit), F.col("term")), F.lit(1.0))
    vector = F.try_element_at(mapped(unit, lambda v: F.array(*map(F.lit, v))), F.col("term"))
    each = terms.select("row", "at", weigh.alias("x"), vector.alias("v"))
    dots = [F.coalesce(F.sum(F.col("x") * F.col("v")[i]), F.lit(0.0)).alias(f"dot{i}") for i in range(len(NOTICES))]
    sums = each.groupBy("row", "at").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), *dots)
    near = F.array_max(F.array(*(F.struct(F.round(F.col(f"dot{i}") / F.col("norm"), 6).alias("cosine"), F.lit(-i).alias("notice")) for i in range(len(NOTICES)))))
    return sums.select("row", near.alias("near")).groupBy("row").agg(F.max("near").alias("best")).filter(F.col("best.cosine") >= threshold)


def licenses(df: DataFrame, path: Column, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(key, path, license, cosine, how, from_dir) for each row of df.

    how is "file" for a licence file (FILE_NAME), "header" for another text with a notice of its
    own, "inherited" where the nearest ancestor directory with a licence file gives it (from_dir),
    else null. Of several notices in one text, or files in one directory, the nearest one counts,
    ties going to the first notice. Null and empty texts have no notice but can inherit; a null
    path inherits nothing. Long texts are read whole. Repeated rows and null keys give a row each; extra columns are ignored;
    an empty table gives an empty result.
    """
    text_col = F.coalesce(df[text], F.lit(""))
    sentences = F.array_union(*(F.filter(F.split(text_col, end), lambda s: has_cue(lowered(s))) for end in (SENTENCE, WRAPPED)))
    none = F.array().cast("array<string>")
    base = written(df.select(F.monotonically_increasing_id().alias("row"), df[key].alias("key"), path.alias("path"), F.when(has_cue(lowered(text_col)), sentences).otherwise(none).alias("sentences")), "notices")
    each = base.select("row", F.posexplode("sentences").alias("at", "s"))
    each = each.select("row", "at", F.explode(F.split(lowered(F.col("s")), TERM)).alias("t")).select("row", "at", F.btrim("t", F.lit(".")).alias("term")).filter("term <> ''")
    terms = written(each.groupBy("row", "at", "term").agg(F.count("*").alias("tf")), "terms")

    # at most one row for each term of the notices is gathered, and one number
    found = dict(terms.filter(F.col("term").isin(VOCABULARY)).groupBy("term").count().collect())
    total = base.agg(F.coalesce(F.sum(F.size("sentences")), F.lit(0))).first()[0]
    best = nearest(terms, *weights(found, total), threshold)

    names = F.array(*(F.lit(n) for n, _ in NOTICES))
    rows = base.drop("sentences").join(best, "row", "left").select(
        "row", "key", "path", F.get(names, F.abs("best.notice")).alias("own"), F.col("best.cosine").alias("cosine"), F.col("best.notice").alias("notice"), F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), F.regexp_extract("path", "[^/]*$", 0).rlike(FILE_NAME).alias("is_file")
    )
    rows = written(rows, "licensed")
    lent = rows.filter("is_file AND own IS NOT NULL").groupBy("dir").agg(F.max_by("own", F.struct("cosine", "notice")).alias("lent")).withColumnRenamed("dir", "from_dir")
    heirs = rows.filter("own IS NULL AND dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    above = heirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("from_dir"))
    given = above.join(lent, "from_dir").groupBy("dir").agg(F.max_by(F.struct("from_dir", "lent"), F.length("from_dir")).alias("given"))
    out = rows.join(given, "dir", "left")
    heir = F.col("own").isNull() & F.col("given").isNotNull()
    return out.select(
        F.col("key").alias(key),
        "path",
        F.coalesce("own", "given.lent").alias("license"),
        "cosine",
        F.when(F.col("own").isNotNull(), F.when(F.col("is_file"), "file").otherwise("header")).when(heir, "inherited").alias("how"),
        F.when(heir, F.col("given.from_dir")).alias("from_dir"),
    )


#: Documents of so many characters at most that hold a cue stand for licence files in op4.
FILE_CHARS = 300


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: licences of all documents.

    Documents have no path, so one is made of source and doc_id: source/d<id/1000>/d<id/100>/name,
    where a short text with a cue is named LICENSE.<id>, any other <id>.txt.
    """
    docs = table(spark, sf_dir, "documents")
    short = (F.char_length("text") <= FILE_CHARS) & has_cue(lowered(F.col("text")))
    name = F.when(short, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", "source", F.concat(F.lit("d"), F.expr("doc_id div 1000")), F.concat(F.lit("d"), F.expr("doc_id div 100")), name)
    return licenses(docs, path)


def oracle(threshold: float = THRESHOLD) -> str:
    """op4 in DuckDB SQL, vectors and all."""
    cue = " OR ".join(f"contains({{0}}, '{c}')" for c in CUES)
    low = f"translate({{0}}, '{_UPPER}', '{_LOWER}')"
    notices = ", ".join(f"({i}, '{name}', '{notice.lower()}')" for i, (name, notice) in enumerate(NOTICES))
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    concat_ws('/', source, 'd' || (doc_id // 1000), 'd' || (doc_id // 100),
      CASE WHEN length(text) <= {FILE_CHARS} AND ({cue.format(low.format("text"))}) THEN 'LICENSE.' || doc_id ELSE doc_id || '.txt' END) AS path
  FROM documents),
cut AS (SELECT r, list_distinct(list_concat(regexp_split_to_array(text, '{SENTENCE}'), regexp_split_to_array(text, '{WRAPPED}'))) AS ss FROM docs WHERE {cue.format(low.format("text"))}),
sent AS (SELECT r, i, {low.format("s")} AS s FROM (SELECT r, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM cut) WHERE {cue.format(low.format("s"))}),
word AS (SELECT r, i, trim(t, '.') AS term FROM (SELECT r, i, unnest(regexp_split_to_array(s, '[^a-z0-9.]+')) AS t FROM sent)),
tf AS (SELECT r, i, term, count(*) AS tf FROM word WHERE term <> '' GROUP BY ALL),
notice(k, name, body) AS (VALUES {notices}),
ntf AS (SELECT k, term, count(*) AS tf FROM (SELECT k, trim(t, '.') AS term FROM (SELECT k, unnest(regexp_split_to_array(body, '[^a-z0-9.]+')) AS t FROM notice)) WHERE term <> '' GROUP BY ALL),
total AS (SELECT (SELECT count(*) FROM sent) + (SELECT count(*) FROM notice) AS n),
idf AS (
  SELECT term, ln((1 + (SELECT n FROM total)) / (1 + coalesce(c.df, 0) + v.df)::DOUBLE) + 1 AS idf
  FROM (SELECT term, count(*) AS df FROM ntf GROUP BY 1) v LEFT JOIN (SELECT term, count(*) AS df FROM tf GROUP BY 1) c USING (term)),
nw AS (SELECT k, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY k)) AS w FROM ntf JOIN idf USING (term)),
x AS (SELECT r, i, tf.term, tf * coalesce(idf, 1.0) AS x FROM tf LEFT JOIN idf ON tf.term = idf.term),
norm AS (SELECT r, i, sqrt(sum(x * x)) AS norm FROM x GROUP BY ALL),
cosine AS (SELECT x.r, nw.k, round(sum(x * w) / any_value(norm), 6) AS c FROM x JOIN nw ON x.term = nw.term JOIN norm ON norm.r = x.r AND norm.i = x.i GROUP BY x.r, x.i, nw.k),
best AS (SELECT r, k, c FROM cosine WHERE c >= {threshold} QUALIFY row_number() OVER (PARTITION BY r ORDER BY c DESC, k) = 1),
own AS (
  SELECT docs.r, doc_id, path, name, c, best.k, regexp_replace(path, '/?[^/]*$', '') AS dir, regexp_extract(path, '[^/]*$') LIKE 'LICENSE.%' AS is_file
  FROM docs LEFT JOIN best ON best.r = docs.r LEFT JOIN notice ON notice.k = best.k),
lent AS (SELECT dir, name FROM own WHERE is_file AND name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY c DESC, k) = 1),
given AS (
  SELECT o.r, l.dir AS from_dir, l.name FROM own o JOIN lent l ON o.dir = l.dir OR l.dir = '' OR starts_with(o.dir, l.dir || '/')
  WHERE o.name IS NULL QUALIFY row_number() OVER (PARTITION BY o.r ORDER BY length(l.dir) DESC) = 1)
SELECT doc_id, path, coalesce(own.name, given.name) AS license, c AS cosine,
  CASE WHEN own.name IS NOT NULL THEN CASE WHEN is_file THEN 'file' ELSE 'header' END WHEN given.name IS NOT NULL THEN 'inherited' END AS how,
  CASE WHEN own.name IS NULL THEN from_dir END AS from_dir
FROM own LEFT JOIN given ON own.r = given.r"""
