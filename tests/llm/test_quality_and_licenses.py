"""Operators 2 and 4 against DuckDB and on odd rows; neither may run Python on the executors."""

import oracle
from cases import TEXTS, frame
from pyspark.sql import functions as F

from trackweave.llm import licenses, quality_rules


def con(sf_dir, rows):
    c = oracle.connect(sf_dir)
    c.execute("DROP VIEW documents")
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, t, "s") for i, t in rows])
    return c


def native(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(x in plan for x in ("Python", "Pandas", "Arrow"))


ROWS = [(i, t.replace("\x00", " ") if t else t) for i, t in TEXTS if t is None or len(t) < 100_000] + [
    (20, "a b c d e f g h a b c d e f g h x y z q w"), (21, "Same line\nSame line\nother\n \nSame line " + "word " * 30), (22, "| " * 40 + "the of"), (23, "# $ % & * < > | " * 9), (24, "go!! now!! the " * 20),
]


def test_quality_matches_sql(spark, sf_dir):
    df = quality_rules.query(spark, sf_dir)
    assert oracle.differences(df, oracle.connect(sf_dir), quality_rules.oracle()) == "" and native(df)
    rows = quality_rules.quality(frame(spark, ROWS))
    odd = rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert oracle.differences(odd, con(sf_dir, ROWS), quality_rules.oracle()) == ""
    assert quality_rules.quality(frame(spark, [])).collect() == []
    by = {r.doc_id: r for r in rows.collect()}
    assert by[20].n_repeat_words == 16 and by[21].n_dup_lines == 1 and by[2].base_failed and not by[24].kept


def test_licenses_match_sql(spark, sf_dir):
    df = licenses.query(spark, sf_dir)
    assert oracle.differences(df, oracle.connect(sf_dir), licenses.oracle()) == "" and native(df)
    how = {r.how for r in df.collect()}
    assert {"header", None} <= how


def test_inheritance(spark):
    rows = [
        (1, "Released under the MIT License.", "a/LICENSE"), (2, "code", "a/b/c/x.py"), (3, "code", "a/y.py"), (4, "code", "ab/z.py"), (5, "Licensed under CC BY-NC 4.0.\ncode", "a/b/n.py"),
        (6, "This work is licensed under the GNU General Public License, version 3.", "a/b/COPYING.txt"), (7, None, "a/b/c/d/w.py"), (8, "", None), (None, "code", "a/q.py"), (9, "The licence of the poets is to redistribute joy among trees and people of every kind", "a/p.py"), (3, "code", "a/y.py"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, path string, own string")
    got = licenses.licenses(df, F.col("path"))
    by = {r.doc_id: (r.license, r.how, r.from_dir) for r in got.collect()}
    assert got.count() == len(rows)
    assert by[1] == ("MIT", "file", None) and by[2] == ("GPL-3.0", "inherited", "a/b") and by[3] == ("MIT", "inherited", "a") and by[4] == (None, None, None)
    assert by[5] == ("CC-BY-NC-4.0", "header", None) and by[6][1] == "file" and by[7] == ("GPL-3.0", "inherited", "a/b") and by[8] == (None, None, None) and by[None] == ("MIT", "inherited", "a") and by[9] == ("MIT", "inherited", "a")
    root = spark.createDataFrame([(1, "Released under the MIT License.", "LICENSE"), (2, "x", "deep/er/f")], "doc_id bigint, text string, path string")
    assert {r.doc_id: r.license for r in licenses.licenses(root, F.col("path")).collect()} == {1: "MIT", 2: "MIT"}
    assert licenses.licenses(df.limit(0), F.col("path")).collect() == []
    assert licenses.licenses(frame(spark), F.col("key")).count() == len(TEXTS)


WRAPPED = {
    "GPL-2.0": "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version.\n#\nimport os\n",
    "GPL-3.0": "/* This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version. */\nint main() {}\n",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as\npublished by the Free Software Foundation, either version 3 of the\nLicense, or (at your option) any later version.\n",
    "LGPL-2.1": "// This library is free software; you can redistribute it and/or\n// modify it under the terms of the GNU Lesser General Public\n// License as published by the Free Software Foundation; either\n// version 2.1 of the License, or (at your option) any later version.\n",
    "MIT": 'MIT License\n\nCopyright (c) 2001 Somebody\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above notice shall be included.\n',
    "BSD": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Keep this.\n",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\n',
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n",
    "Zlib": "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n",
}


def test_wrapped_headers(spark, sf_dir):
    rows = [*enumerate(WRAPPED.values()), (50, "a tale of two cities\nand of a licence\nto walk in the woods at night\n"), *((100 + i, t) for i, (_, t) in enumerate(ROWS))]
    df = frame(spark, rows).select("doc_id", "text").withColumn("source", F.lit("s"))
    found = licenses.licenses(df, F.concat(F.lit("p/"), F.col("doc_id").cast("string")))
    by = {r.doc_id: r.license for r in found.collect()}
    assert [by[i] for i in range(len(WRAPPED))] == list(WRAPPED) and by[50] is None
    c = con(sf_dir, rows)
    sql = c.execute(licenses.oracle()).fetchall()
    assert sorted((r[0], r[2]) for r in sql if r[0] < len(WRAPPED)) == list(enumerate(WRAPPED))


def test_the_gate_hides_no_notice():
    assert all(any(cue in notice.lower() for cue in licenses.CUES) for _, notice in licenses.NOTICES)
