"""Licence scans on wordings that nothing was learned from."""

import random
import time

import pytest
from pyspark.sql import functions as F

from textloom.llm import license_scan

#: Family and a wording that is neither a frame with a name nor a clause of licences/.
HELD_OUT = (
    ("apache-2.0", "Files below this one are offered to you under the Apache License, Version 2.0 only."),
    ("apache-2.0", "Copyright 2019 The Authors.\nLicensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at"),
    ("apache-2.0", "All examples are licensed under the Apache License 2.0, as is the rest."),
    ("mit", "The code of this package is licensed under the MIT License as found in its root folder."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge"),
    ("mit", "Everything is released under the MIT license by its author."),
    ("isc", "Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"),
    ("bsd", "The parser is distributed under the BSD 3-Clause License of its first author."),
    ("gpl", "Our tool is licensed under the GNU General Public License, version 3, and nothing else."),
    ("gpl", "This is released under the GNU GPL v3 like the program it extends."),
    ("gpl", "Foo is licensed under the GNU General Public License, version 2 or later."),
    ("lgpl", "The library is released under the GNU Lesser General Public License, version 2.1, by its makers."),
    ("agpl", "The server is licensed under the GNU Affero General Public License, version 3, in all its parts."),
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at"),
    ("mpl", "Patches are licensed under the Mozilla Public License, version 2.0, too."),
    ("cc-by", "The photographs are licensed under a Creative Commons Attribution 4.0 International License by the town."),
    ("cc-by-sa", "Maps are licensed under a Creative Commons Attribution-ShareAlike 4.0 International License since May."),
    ("cc-by-nc", "The drawings are licensed under CC BY-NC 4.0 by the school."),
    ("cc0", "The tables were dedicated to the public domain under CC0 1.0 Universal by the office."),
    ("reserved", "Copyright 2011 Jane Doe. All rights reserved."),
    ("reserved", "© The Town Press 1998. All rights reserved. Printed in Spain."),
)
NO_FAMILY = (
    "This text is not licensed under the MIT License.",
    "Unlike our older works, this book is not licensed under CC BY 4.0.",
    "This folder is not covered by the Apache License, Version 2.0.",
    "Licensed under the Foo Bar licence of 1987.",
    "You may not reverse engineer the device or lease it to others except as the law of your state permits.",
    "This agreement shall be governed by the laws of the place where the tenant lives.",
)
NO_LICENCE = (
    "She got her driving license in May.",
    "Poetic licence is allowed in the third verse of the song.",
    "The MIT students showed a film under water.",
    "The general of the lesser army asked the public for bread.",
    "My sister reserved two rooms by the lake for all of June.",
)

#: Texts, the families that they grant and those that they only mention; none is a wording that was learned from.
STATEMENTS = (
    ("Dual-licensed under the MIT License or the Apache License 2.0", "apache-2.0,mit", ""),
    ("Nobody may use this under the MIT License any more.", "", "mit"),
    ("This document stopped being under the Apache License, Version 2.0 in 2019.", "", "apache-2.0"),
    ("We dropped the GPLv3 and all of our code is closed now.", "", "gpl"),
    ("We love the MIT License and wrote an essay about it.", "", "mit"),
    ("The lawyers compared the Mozilla Public License, version 2.0 with other texts for a whole year.", "", "mpl"),
    ("All rights reserved by the hotel guests were honoured.", "", "reserved"),
    ("The MIT License", "mit", ""),
    ("Do not panic. The code is released under the Apache License, Version 2.0.", "apache-2.0", ""),
)
BOOST = "Permission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying documentation covered by\nthis license (the \"Software\") to use, reproduce, display, distribute,\nexecute, and transmit the Software"


@pytest.fixture(scope="module")
def corpus(spark):
    """Ordinary texts of invented words, with notices in some; and a model that is learned from them."""
    rng = random.Random(3)
    words = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "the", "of", "in") for b in ("", "ra", "so", "ti", "ver")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, f"{prose(rng.randint(5, 150))}\n{'All rights reserved.' if i % 10 == 0 else prose(9)}\n\n{prose(20)}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return docs, license_scan.trained(spark, docs), prose


def found(spark, corpus, texts):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.doc_id: r.families for r in license_scan.licences(table, model=corpus[1]).collect()}
    return [rows[i] for i in range(len(texts))]


def test_held_out_wordings(spark, corpus):
    prose = corpus[2]
    texts = [f"{prose(30)}\n{text}\n{prose(50)}" if k % 2 else text for k, (_, text) in enumerate(HELD_OUT)]
    got = found(spark, corpus, [*texts, *NO_FAMILY, *NO_LICENCE])
    named = [(g, want) for g, want in zip(got, [f for f, _ in HELD_OUT], strict=False) if g not in ("", "unknown")]
    right = sum(g == want for g, want in named)
    assert right >= 0.8 * len(HELD_OUT), [(g, t) for g, (f, t) in zip(got, HELD_OUT, strict=False) if g != f]
    others = got[len(HELD_OUT) :]
    assert right >= 0.95 * (len(named) + sum(g not in ("", "unknown") for g in others))
    assert all(g in ("unknown", "") for g in others[: len(NO_FAMILY)]) and others[: len(NO_FAMILY)].count("unknown") >= 5
    plain = others[len(NO_FAMILY) :]
    assert set(plain) <= {"", "unknown"} and plain.count("") >= 0.8 * len(NO_LICENCE)


def test_grants_and_mentions(spark, corpus):
    """No text grants what it only mentions, and all families of a paragraph are found."""
    table = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(STATEMENTS)], "doc_id bigint, text string")
    rows = {r.doc_id: (r.families, r.mentions) for r in license_scan.licences(table, model=corpus[1]).collect()}
    for i, (text, families, mentions) in enumerate(STATEMENTS):
        got = {x for x in rows[i][0].split(",") if x not in ("", "unknown")}
        assert got == set(filter(None, families.split(","))), (text, rows[i])
        assert rows[i][1] in (mentions, ""), (text, rows[i])


def test_all_families_of_a_paragraph(spark, corpus):
    """Two licence texts in one paragraph, and a licence that only begins like another."""
    notice = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"
    mit = next(t for f, t in HELD_OUT if f == "mit" and "hereby granted" in t)
    got = found(spark, corpus, [f"{notice}\n{corpus[2](100)}\n{mit}", BOOST])
    assert set(got[0].split(",")) == {"gpl", "mit"} and got[1] in ("", "unknown")


def test_statements(spark):
    """Sentences by themselves: a grant, a mention, or no name."""
    from textloom.llm.licence_statements import granted

    names, rows = list(license_scan.NAMES["apache-2.0"]), (
        ("It is released under the Apache License, Version 2.0.", True), ("It is released under the Apache\nLicense Version 2.0", True), ("Not under the Apache License 2.0!", False),
        ("This is no toy, it is available under the Apache License 2.0.", True), ("Unlike A, which is under the Apache License 2.0, B is closed.", False), ("Apache 2.0 is a version of a server.", None),
        ("The Apache License 2.0 was discussed. All of it is licensed under the Apache License 2.0.", True), ("", None), (None, None),
        ("We never met.\nlicensed under the Apache License 2.0.\nnot a word of a licence follows", True), ("Licensed under the Apache License, Version\n2.0", True),
    )
    table = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    got = {r.i: r.g for r in table.select("i", granted(F.col("t"), names).alias("g")).collect()}
    assert [got[i] for i in range(len(rows))] == [want for _, want in rows]


def test_reserved_statements(spark):
    """A line of lower-case words behind the statement does not make it a mention."""
    from textloom.llm.licence_statements import granted

    rows = (("All rights reserved.\nbut many | small | words | stand | in the | table below", True), ("All rights reserved by the hotel guests were honoured.", False), ("The rights are reserved.", None))
    table = spark.createDataFrame(list(enumerate(t for t, _ in rows)), "i int, t string")
    got = {r.i: r.g for r in table.select("i", granted(F.col("t"), ["all rights reserved"], True).alias("g")).collect()}
    assert [got[i] for i in range(len(rows))] == [want for _, want in rows]


def test_corpus(corpus):
    docs, model, _ = corpus
    rows = {r.doc_id: (r.families, list(r.paragraphs)) for r in license_scan.licences(docs, model=model).collect()}
    assert rows == {i: ("reserved", [0]) if i % 10 == 0 else ("", []) for i in range(300)}


def test_pieces_are_scored_whole(spark, corpus):
    """A notice anywhere in a very long paragraph is found, across the ends of pieces and lines."""
    prose = corpus[2]
    notice = "This work is licensed under the GNU General Public License, version 3."
    texts = [f"{prose(n)} {notice.replace(' ', chr(10), n % 5)} {prose(100)}" for n in (0, 25, 31, 55, 60, 64, 90, 20_000)]
    assert found(spark, corpus, texts) == ["gpl"] * len(texts)


def test_scan_equals_the_model(spark, corpus):
    """The looked-up weights add up to what plain Python makes of them."""
    import math
    import re

    _, model, _ = corpus
    weights = {r.gram: r.w for r in model.weights.collect()}
    texts = [t for _, t in HELD_OUT]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    hashes = {r.word: r.hash for r in spark.createDataFrame([(w,) for t in texts for w in set(re.findall(r"\w+", t.lower()))], "word string").selectExpr("word", "xxhash64(word) AS hash").collect()}
    got = {(r.doc_id, r.piece): (r["class"], r.p) for r in license_scan.classified(license_scan.paragraphs(table), model).collect()}
    longer = {}
    for t in texts:
        h = [hashes[w] for w in re.findall(r"\w+", t.lower())]
        longer |= {tuple(h[i : i + n]): None for n in (2, 3) for i in range(len(h) - n + 1)}
    keyed = spark.createDataFrame([(list(k), k[0], k[1], k[2] if len(k) > 2 else None) for k in longer], "k array<bigint>, a bigint, b bigint, c bigint")
    longer = {tuple(r.k): r.h for r in keyed.selectExpr("k", "CASE WHEN c IS NULL THEN xxhash64(a, b) ELSE xxhash64(a, b, c) END AS h").collect()}
    for i, t in enumerate(texts):
        h = [hashes[w] for w in re.findall(r"\w+", t.lower())]
        grams = h + [longer[tuple(h[k : k + n])] for n in (2, 3) for k in range(len(h) - n + 1)]
        z = [b + sum(weights[g][c] for g in set(grams) if g in weights) for c, b in enumerate(model.intercepts)]
        best = max(range(len(z)), key=lambda c: z[c])
        p = 1 / sum(math.exp((x - z[best]) / model.temperature) for x in z)
        assert len(h) <= license_scan.PIECE and got[i, 0][0] == best and abs(got[i, 0][1] - p) < 1e-9


def test_odd_rows(spark, corpus):
    model = corpus[1]
    mit = "Released under the MIT License."
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n\n\t\n", "c"), (4, "\n\n".join([mit, "x y z", mit]), "d"), (4, "\n\n".join([mit, "x y z", mit]), "e"), (4, "plain", "f"), (None, mit, "g"), (5, "漢字 é 😀", "h"), (6, "word " * 200_000, "i")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, words string")
    got = sorted(((r.doc_id or -1), r.families, list(r.paragraphs)) for r in license_scan.licences(table, model=model).collect())
    assert got == [(-1, "mit", [0]), (1, "", []), (2, "", []), (3, "", []), (4, "", []), (4, "mit", [0, 2]), (4, "mit", [0, 2]), (5, "", []), (6, "", [])]
    assert license_scan.licences(table.limit(0), model=model).collect() == []


def test_only_texts_likely_to_hold_a_licence_move(spark, corpus, monkeypatch):
    plans, write = {}, license_scan.written

    def seen(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label)

    monkeypatch.setattr(license_scan, "written", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with many documents
    try:
        license_scan.scan(corpus[0], corpus[1])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plans["likely"] and "SortMergeJoin" not in plans["likely"]


def full_collections(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_the_driver_stays_small_while_the_model_is_fitted(spark, corpus, monkeypatch):
    """A step sends one gradient to the driver, and what past steps left there is collected."""
    fit, seen = license_scan.LogisticRegression.fit, []

    def watched(self, rows):
        before = full_collections(spark)
        model = fit(self, rows)
        seen.append((rows._jdf.rdd().getNumPartitions(), full_collections(spark) - before))
        return model

    monkeypatch.setattr(license_scan.LogisticRegression, "fit", watched)
    license_scan.trained(spark, corpus[0])
    assert [n for n, _ in seen] == [1] and seen[0][1] >= 2
    after = full_collections(spark)
    time.sleep(2 * license_scan.COLLECT_EVERY)
    assert full_collections(spark) == after


def test_trained_on_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert license_scan.licences(empty).collect() == []


def test_no_python_in_the_plan(spark, corpus):
    docs, model, _ = corpus
    plan = license_scan.classified(license_scan.paragraphs(docs), model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_threshold():
    bins = [{"bin": b, "n": n, "right": r} for b, n, r in ((30, 10, 2), (60, 10, 9), (90, 100, 100))]
    assert license_scan.threshold(bins) == 0.6
    assert license_scan.threshold([{"bin": 40, "n": 1, "right": 0}]) == 0.99
