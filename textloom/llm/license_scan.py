"""Licence scans: a trained paragraph classifier, confirmed by comparison with licence templates.

A multinomial logistic regression over sparse word n-grams (one to three words) names the licence family of each paragraph.
Beside the families it knows "unknown", legal prose and licence statements of no known family, and "none", anything else.

* Texts to learn from: the whole licence texts in licences/, by paragraphs; notices made by rule from FRAMES and NAMES;
  other legal prose (licences/other.txt) and notices that deny a licence as "unknown"; and as "none" a few sentences
  that use the words otherwise, and a bounded sample of the corpus without what a template comparison confirms.
* Calibration: one temperature is fitted on held-out wordings (frames and paragraphs that no fold-0 row uses), and the
  threshold is the probability from which on TARGET_PRECISION of the families predicted there, and confirmed by templates
  that are no held-out wordings, are right.
* Verdict: where the calibrated probability of all families together reaches the threshold, every family that is likelier
  than "none" and confirmed by its templates is found, so a paragraph can have several. A template confirms its family if
  CONFIRM percent of its word pairs are there beside those that templates with as large a share explain, of other families
  or of other legal texts (a name that stands there whole: if a pair is left). Text that two families have in common is
  "unknown", and nothing is learned from it.
* Grants and mentions: a name (a template of fewer than NAME pairs) is no licence text. A family that only names confirm is
  granted if a sentence says so (licence_statements) and no licence text of another family stands in the same piece; else
  it is a mention.
* A paragraph without a confirmed family is "unknown" if "none" is not the likeliest class of one of its pieces.

Paragraphs end at blank lines, so hard-wrapped notices stay whole. Long ones are scored in pieces that overlap, all of them;
a template is never longer than the overlap, so it lies whole in some piece. The vocabulary holds only n-grams of the
licence and legal texts that are rare in ordinary ones; a piece without any has the class "none" by the intercepts alone,
so only pieces with weighted n-grams leave the scan, and that loses nothing.

Cases: null and empty texts have no paragraphs and one row with no licence; blank paragraphs are left out; a paragraph of
any length is scored whole; repeated rows and ids are told apart by text_hash, equal rows share theirs; other columns are
ignored; an empty table gives an empty result. Scanning and training are DataFrame functions and Spark ML; no Python runs on
the executors.
"""

import itertools
import math
import re
import threading
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from importlib.resources import files

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .licence_statements import granted
from .storage import written

#: Names of the families in notices, and their identifiers; the texts of most are in licences/<family>.txt.
NAMES = {
    "apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 license", "Apache License v2.0", "the Apache Software License, version 2"),
    "mit": ("the MIT License", "the MIT licence", "an MIT-style license", "the MIT (Expat) license", "MIT license terms"),
    "isc": ("the ISC License", "the ISC licence", "ISC license terms"),
    "bsd": ("the BSD License", "the BSD 3-Clause License", "the 2-clause BSD license", "a BSD-style license", "the New BSD License", "the simplified BSD licence"),
    "gpl": ("the GNU General Public License, version 3", "the GNU General Public License, version 2 or later", "the GNU GPL v3", "the GPLv2", "the GPLv3", "the GNU General Public License", "the GPL version 2"),
    "lgpl": ("the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License", "the GNU LGPL v3", "the LGPLv2.1", "the LGPL version 3", "the GNU Library General Public License"),
    "agpl": ("the GNU Affero General Public License, version 3", "the GNU Affero General Public License", "the GNU AGPL v3", "the AGPLv3", "the Affero GPL"),
    "mpl": ("the Mozilla Public License, version 2.0", "the Mozilla Public License, v. 2.0", "the Mozilla Public License", "the MPL 2.0", "the MPLv2"),
    "cc-by": ("a Creative Commons Attribution 4.0 International License", "the Creative Commons Attribution licence", "CC BY 4.0", "CC-BY 3.0"),
    "cc-by-sa": ("a Creative Commons Attribution-ShareAlike 4.0 International License", "the Creative Commons Attribution-ShareAlike licence", "CC BY-SA 4.0", "CC-BY-SA 3.0"),
    "cc-by-nc": ("a Creative Commons Attribution-NonCommercial 4.0 International License", "the Creative Commons Attribution-NonCommercial licence", "CC BY-NC 4.0", "CC-BY-NC 3.0"),
    "cc0": ("CC0 1.0 Universal", "the Creative Commons CC0 dedication", "the CC0 public domain dedication", "CC0"),
    "reserved": (),
}
IDENTIFIERS = {
    "apache-2.0": ("Apache-2.0",), "mit": ("MIT",), "isc": ("ISC",), "bsd": ("BSD-3-Clause", "BSD-2-Clause"), "gpl": ("GPL-3.0-or-later", "GPL-2.0-only", "GPL-3.0-only", "GPL-2.0-or-later"),
    "lgpl": ("LGPL-2.1-only", "LGPL-3.0-or-later"), "agpl": ("AGPL-3.0-only", "AGPL-3.0-or-later"), "mpl": ("MPL-2.0",), "cc-by": ("CC-BY-4.0",), "cc-by-sa": ("CC-BY-SA-4.0",), "cc-by-nc": ("CC-BY-NC-4.0",), "cc0": ("CC0-1.0",),
}
NOTICES = {
    "reserved": ("All rights reserved.", "Copyright 2020 Example Corp. All rights reserved.", "Copyright (c) 1999-2004 by the authors, all rights reserved.", "© 2021 All rights reserved worldwide.", "All rights reserved. No part may be copied."),
    "gpl": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "cc0": ("Dedicated to the public domain under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
}
FRAMES = (
    "Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This project is licensed under the terms of {}.", "Distributed under {}, see the file LICENSE.",
    "This file is made available under {}.", "The source code is available under {}.", "You may use this software under {}.", "Published under the terms of {}.", "License: {}",
    "{}", "This program is free software under {}.", "Code in this folder is covered by {}.", "This library is subject to {}.", "Use of this data is governed by {}.", "Its licence is {}.",
)
DENIALS = (
    "This text is not licensed under {}.", "This work is not covered by {}.", "{} does not apply to this file.", "Unlike the library, which is under {}, this file is closed.", "It was never released under {}.",
    "We do not accept code under {}.", "This is not free software under {}.", "No part of it is available under {}.", "None of the files in this folder is licensed under {}.", "No file here is under {}.",
    "This file is no longer distributed under {}.", "It cannot be released under {}.", "This work isn't published under {}.", "The text is neither free nor under {}.", "Not licensed under {}.", "Never publish this under {}.",
)
HELD_OUT_DENIALS = ("Unlike works under {}, this one may not be copied.", "We have never licensed it under {}.", "It is not under {}, ask before you copy it.", "No file in this folder is licensed under {}.")
UNKNOWN_NOTICES = (
    "Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This software is subject to {}.", "See {} for terms.",
)
UNKNOWN_NAMES = (
    "the Foo Public Licence", "our own licence of 2003", "the Example Software License Agreement", "the licence in the file COPYING", "the terms of the vendor licence", "the Eclipse Public License, version 1.0",
    "a commercial licence", "the Open Font License", "the Common Development and Distribution License", "the licence that comes with it", "the evaluation license", "the Acme Community License",
)
#: Sentences of the class "none" that use words of licences otherwise.
ORDINARY = (
    "He has had a driving licence since he was eighteen.", "Her license to drive was taken away in March.", "The pub lost its licence to sell beer after midnight.", "Poets take some licence with the facts.",
    "A fishing licence costs ten euros a year.", "The doctor is licensed to practise in two states.", "They reserved a table for the whole party.", "All seats in the hall were reserved for members.",
    "The copyright in the song was sold at an auction.", "The museum opened its new wing to the general public.", "The lesser of the two evils was to wait.", "A public notice hung on the door of the library.",
    "The software on her phone was out of date.", "Everyone has the right to rest and leisure.", "The university of the town is older than its church.", "The Apache helicopter landed on the roof.",
    "He studied at MIT for four years and then went home.", "Students at MIT built a bridge of paper.", "The village common is open to the public.", "They granted him permission to leave early.",
)
CLASSES = ["none", "unknown", *NAMES]
#: Pieces of the class "none" that training takes from the corpus at most; the bound of the sample.
MAX_SAMPLE = 4_000
#: Documents from which they come, for each of them; copies give equal pieces, so there are more than one.
OVERSAMPLE = 2
#: N-grams at most, in how many texts to learn from they must be, and the share of ordinary pieces that may hold them.
VOCABULARY, LEAST_TEXTS, ORDINARY_SHARE = 1 << 14, 2, 0.01
CONFIRM = 60
#: Word pairs from which on a template is licence text and not only a name.
NAME = 8
TARGET_PRECISION = 0.95
#: How often notices count, and the clauses of families that have FEW of them at most.
REPEATS, FEW = 12, 20
#: Share in percent from which a held-out clause that another class has too is no measure of the model.
ALIKE = 80
#: Seconds between collections of the driver's heap while the model is fitted.
COLLECT_EVERY = 1.0
TEMPERATURES = [round(0.25 * 1.25**k, 3) for k in range(16)]
#: Words of one piece of a long paragraph, words that neighbouring pieces share, and words of a template at most.
PIECE, SHARED, TEMPLATE = 64, 32, 32
#: Documents that are likely to hold a licence are met by broadcast up to so many (two numbers each), by shuffle beyond.
MAX_IDS = 1_000_000
WORD = r"[\p{L}\p{N}]+"
PARAGRAPH_END = r"\n[ \t\r\f\x0B]*\n"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def paragraphs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, paragraph (its number) and words of all paragraphs with a word."""
    each = F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), PARAGRAPH_END)).alias("paragraph", "lines")
    rows = docs.select("doc_id", F.xxhash64(text_col).alias("text_hash"), each)
    return rows.select("doc_id", "text_hash", "paragraph", words_of(F.col("lines")).alias("words")).where(F.size("words") > 0)


def last_piece(words: Column) -> Column:
    """The number of the last piece; piece k begins at word k * (PIECE - SHARED)."""
    return F.greatest(F.lit(0), F.ceil((F.size(words) - PIECE) / (PIECE - SHARED)).cast("int"))


def pieces(rows: DataFrame) -> DataFrame:
    """rows(doc_id, text_hash, paragraph, words) by piece, with piece and its own words."""
    numbered = rows.select("doc_id", "text_hash", "paragraph", F.explode(F.sequence(F.lit(0), last_piece(F.col("words")))).alias("piece"), F.col("words").alias("all"))
    return numbered.select("doc_id", "text_hash", "paragraph", "piece", F.slice("all", F.col("piece") * (PIECE - SHARED) + 1, F.lit(PIECE)).alias("words"))


@cache
def licence_texts(name: str) -> list[str]:
    """The paragraphs of licences/<name>.txt."""
    held = files(__package__).joinpath("licences", f"{name}.txt").read_text(encoding="utf-8").split("\n\n")
    return [" ".join(p.split()) for p in held if p.split()]


def parts(paragraph: str) -> list[str]:
    """A paragraph in stretches of about TEMPLATE words at most, as even as may be."""
    words = paragraph.split()
    n = -(-len(words) // (TEMPLATE - 8))  # words of WORD can be more than those between blanks
    return [" ".join(words[len(words) * k // n : len(words) * (k + 1) // n]) for k in range(n)] if words else []


@cache
def wordings() -> list[tuple[str, int, str]]:
    """Class, fold (0 to train, 1 to calibrate) and text of everything that is learned from but the corpus sample."""
    rows = []
    for family, names in NAMES.items():
        for k, frame in enumerate(FRAMES):
            rows += [(family, int(k % 4 == 3), frame.format(name)) for name in names]
        rows += [("unknown", 0, frame.format(name)) for frame in DENIALS for name in names]
        rows += [("unknown", 1, frame.format(name)) for frame in HELD_OUT_DENIALS for name in names[:1]]
        rows += [(family, 0, frame.format(i)) for i in IDENTIFIERS.get(family, ()) for frame in ("SPDX-License-Identifier: {}", "License: {}")]
        rows += [(family, 0, text) for text in NOTICES.get(family, ()) for _ in range(REPEATS)]
    few = Counter(c for c, _, _ in clauses())
    rows += [x for x in telling_clauses() for _ in range(1 if x[1] or few[x[0]] > FEW else REPEATS)]
    for k, frame in enumerate(UNKNOWN_NOTICES):
        rows += [("unknown", int((k + n) % 4 == 3), frame.format(name)) for n, name in enumerate(UNKNOWN_NAMES)]
    rows += [("none", int(k % 4 == 3), text) for k, text in enumerate(ORDINARY) for _ in range(3)]
    return rows


def template_texts() -> list[tuple[str, int, str]]:
    """Family ("unknown": other legal text), fold (1 for held-out wordings) and text of every template."""
    texts = []
    for family, names in NAMES.items():
        texts += [(family, 0, name) for name in names] + [(family, 0, name.split(" ", 1)[1]) for name in names if name.startswith(("the ", "a ", "an "))]
        texts += [(family, 0, f"SPDX-License-Identifier: {i}") for i in IDENTIFIERS.get(family, ())] + [(family, 0, t) for t in NOTICES.get(family, ())]
    return texts + clauses()


@cache
def clauses() -> list[tuple[str, int, str]]:
    """Class, fold and text of the parts of all licence texts; each tenth paragraph of one is held out."""
    named = [(f, f) for f in NAMES if files(__package__).joinpath("licences", f"{f}.txt").is_file()]
    return [(c, int(k % 10 == 9), part) for c, name in [*named, ("unknown", "other")] for k, paragraph in enumerate(licence_texts(name)) for part in parts(paragraph)]


def telling_clauses() -> list[tuple[str, int, str]]:
    """The clauses that tell their class: none of another class holds all of their word pairs, or ALIKE percent if held out."""
    pairs = [{f"{a} {b}" for a, b in itertools.pairwise(re.findall(r"\w+", text.lower()))} for _, _, text in clauses()]
    others = lambda k: [q for q, x in zip(pairs, clauses(), strict=True) if x[0] != clauses()[k][0]]
    by_class = {c: others(k) for k, (c, _, _) in enumerate(clauses())}
    shared = [max((100 * len(p & q) / max(1, len(p)) for q in by_class[x[0]]), default=0) for p, x in zip(pairs, clauses(), strict=True)]
    return [x for x, most in zip(clauses(), shared, strict=True) if most < (ALIKE if x[1] else 100)]


def templates(spark: SparkSession, folds: tuple[int, ...] = (0, 1)) -> DataFrame:
    """template (its number), family, named (whether only a name), size (distinct word pairs) and pair (hash) of the templates; bounded by the texts above."""
    rows = spark.createDataFrame([(k, *x) for k, x in enumerate(template_texts()) if x[1] in folds], "template int, family string, fold int, text string")
    rows = rows.select("template", "family", "text", pairs_of(words_of(F.col("text"))).alias("pairs"))
    named = (F.size("pairs") < NAME) & ~F.col("text").startswith("SPDX")
    return rows.select("template", "family", named.alias("named"), F.size("pairs").alias("size"), F.explode("pairs").alias("pair"))


def pairs_of(words: Column) -> Column:
    """Hashes of the distinct pairs of neighbouring words; a single word is its own pair."""
    both = F.transform(words, lambda w, i: F.when(i + 1 < F.size(words), F.xxhash64(w, F.get(words, i + 1))))
    return F.when(F.size(words) == 1, F.transform(words, lambda w: F.xxhash64(w))).otherwise(F.array_compact(F.array_distinct(both)))


def compared(rows: DataFrame, key: list[str], folds: tuple[int, ...] = (0, 1)) -> DataFrame:
    """key, family, named, size and held (the pairs that words hold) of the templates of which words hold CONFIRM percent."""
    held = rows.select(*key, F.explode(pairs_of(F.col("words"))).alias("own_pair")).distinct()
    hits = held.join(F.broadcast(templates(rows.sparkSession, folds)), F.col("own_pair") == F.col("pair"))  # a few thousand templates' pairs
    each = hits.groupBy(*key, "template", "family", "named", "size").agg(F.collect_set("pair").alias("held"))  # at most size
    return each.where(100 * F.size("held") >= CONFIRM * F.col("size")).drop("template")


def confirming(rows: DataFrame, key: list[str], folds: tuple[int, ...] = (0, 1)) -> DataFrame:
    """key and confirmed: family and named of the templates that confirm their family."""
    one = F.struct("family", "named", "size", "held", (F.size("held") / F.col("size")).alias("share"))
    each = compared(rows, key, folds).groupBy(*key).agg(F.collect_list(one).alias("all"))  # templates at most

    def confirms(t: Column) -> Column:
        others = F.filter("all", lambda u: (u["family"] != t["family"]) & (u["share"] >= t["share"]))
        left = F.size(F.array_except(t["held"], F.flatten(F.transform(others, lambda u: u["held"]))))
        return (t["family"] != "unknown") & ((100 * left >= CONFIRM * t["size"]) | (t["named"] & (t["share"] == 1) & (left > 0)))

    return each.select(*key, F.transform(F.filter("all", confirms), lambda t: F.struct(t["family"].alias("family"), t["named"].alias("named"))).alias("confirmed"))


def class_name(number: Column) -> Column:
    return F.get(F.array(*map(F.lit, CLASSES)), number)


def grams(words: Column) -> Column:
    """All n-grams of one, two and three words, as strings."""
    at = lambda i: F.get(words, i)
    some = lambda n: F.transform(F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: i + n <= F.size(words)), lambda i: F.concat_ws(" ", *(at(i + k) for k in range(n))))
    return F.concat(words, some(2), some(3))


def gram_hash(hashes: list[Column]) -> Column:
    """The hash of an n-gram from those of its words."""
    return hashes[0] if len(hashes) == 1 else F.xxhash64(*hashes)


class Model:
    """weights (gram, the hash of an n-gram, and w, what it adds to each class), intercepts, temperature and threshold."""

    def __init__(self, weights: DataFrame, intercepts: list[float], temperature: float, threshold: float):
        self.weights, self.intercepts, self.temperature, self.threshold = weights, intercepts, temperature, threshold


@contextmanager
def collecting(spark: SparkSession) -> Iterator[None]:
    """Meanwhile, and at the end, the driver's heap is collected every COLLECT_EVERY seconds.

    The optimizer leaves some hundred vectors of VOCABULARY times CLASSES numbers a step. Arrays of that size (2 MB) are for G1
    a reason to collect at each few of them and to grow the heap, but those of past steps stay until all of it is collected.
    """
    done, system = threading.Event(), spark.sparkContext._jvm.System

    def collect() -> None:
        while not done.wait(COLLECT_EVERY):
            system.gc()

    beside = threading.Thread(target=collect, daemon=True)
    beside.start()
    try:
        yield
    finally:
        done.set()
        beside.join()
        system.gc()


def corpus_sample(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """words of at most MAX_SAMPLE distinct pieces, those of the smallest hashes, that no template confirms.

    They come from some OVERSAMPLE * MAX_SAMPLE documents chosen by the hashes of their texts (of all where there are no more).
    """
    share = OVERSAMPLE * MAX_SAMPLE / max(1, docs.count())
    chosen = docs.where(F.pmod(F.xxhash64(F.col(text_col)), F.lit(1 << 40)) < int(min(1.0, share) * (1 << 40)))
    distinct = pieces(paragraphs(chosen, text_col)).select("words").distinct().withColumn("of", F.xxhash64("words"))
    few = written(distinct.orderBy("of", F.concat_ws(" ", "words")).limit(MAX_SAMPLE), "sample")
    confirmed = compared(few, ["of"]).where("family != 'unknown'").select(F.col("of").alias("gone"))
    return few.join(confirmed, F.col("of") == F.col("gone"), "left_anti").select("words")


def trained(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> Model:
    """The model, from the texts above and the sample of docs."""
    given = [(CLASSES.index(c), fold, text) for c, fold, text in wordings()]
    texts = spark.createDataFrame(given, "label int, fold int, text string").select("label", "fold", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    thinned = texts.where("fold = 0").where(F.size("words") >= 18).select("label", "fold", F.filter("words", lambda w, i: F.pmod(F.xxhash64(w, i), F.lit(8)) > 0).alias("words"))
    none = corpus_sample(docs, text_col).select(F.lit(0).alias("label"), F.when(F.pmod(F.xxhash64("words"), F.lit(5)) == 4, 1).otherwise(0).alias("fold"), "words")
    rows = texts.union(thinned).union(none).select("label", "fold", "words", grams(F.col("words")).alias("grams"))
    rows = written(rows.coalesce(4), "wordings")

    learned = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=VOCABULARY, minDF=LEAST_TEXTS, binary=True).fit(rows.where("fold = 0 AND label > 0"))
    ordinary = rows.where("label = 0").select(F.explode(F.array_distinct("grams")).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    usual = {r.gram for r in ordinary.where(F.col("n") > ORDINARY_SHARE * max(100, rows.where("label = 0").count())).collect()}  # some 100 / ORDINARY_SHARE grams at most
    counts = CountVectorizerModel.from_vocabulary([g for g in learned.vocabulary if g not in usual], inputCol="grams", outputCol="features").setBinary(True)
    vectors = counts.transform(rows).select("label", "fold", "words", "features").coalesce(1).cache()  # bounded; each task of a step sends a gradient to the driver
    with collecting(spark):
        fitted = LogisticRegression(maxIter=50, regParam=1e-4, elasticNetParam=0.2, family="multinomial", standardization=False).fit(vectors.where("fold = 0"))
        temperature, threshold = calibrated(fitted, vectors.where("fold = 1"))
    vectors.unpersist()

    matrix, intercepts = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    intercepts = [float(x) for x in intercepts] + [-100.0] * (len(CLASSES) - len(intercepts))
    weighted = [(g, [float(x) for x in matrix[:, k]]) for k, g in enumerate(counts.vocabulary) if (matrix[:, k] != 0).any()]
    words = F.split("text", " ")
    by_size = [F.when(F.size(words) == n, gram_hash([F.xxhash64(F.get(words, F.lit(k))) for k in range(n)])) for n in (1, 2, 3)]
    weights = spark.createDataFrame(weighted, "text string, w array<double>").select(F.coalesce(*by_size).alias("gram"), "w")
    return Model(weights, intercepts, temperature, threshold)


def calibrated(fitted: LogisticRegressionModel, held_out: DataFrame) -> tuple[float, float]:
    """The temperature of the least loss, and the threshold at it."""
    rows = fitted.transform(held_out).select("label", "words", vector_to_array("rawPrediction").alias("z")).withColumn("best", F.array_max("z"))
    log_sum = lambda t: F.log(F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp((x - F.col("best")) / t)))
    losses = rows.agg(*(F.avg(log_sum(t) - (F.get("z", F.col("label")) - F.col("best")) / t).alias(f"t{k}") for k, t in enumerate(TEMPERATURES))).first()
    temperature = min(zip((x if x is not None else math.inf for x in losses), TEMPERATURES, strict=True))[1]
    p = lambda k: F.exp((F.get("z", F.lit(k)) - F.col("best")) / temperature - log_sum(temperature))
    families = sum((p(k) for k in range(2, fitted.numClasses)), F.lit(0.0))
    named = rows.select("label", F.xxhash64("words").alias("of"), "words", (F.array_position("z", F.col("best")) - 1).cast("int").alias("class"), families.alias("p"))
    known = named.join(confirming(named.dropDuplicates(["of"]), ["of"], (0,)).withColumnRenamed("of", "like"), F.col("of") == F.col("like"))
    known = known.where((F.col("class") > 1) & F.exists("confirmed", lambda x: x["family"] == class_name(F.col("class"))))
    bins = known.groupBy(F.floor(F.least(F.col("p"), F.lit(1.0)) * 100).alias("bin")).agg(F.count("*").alias("n"), F.sum((F.col("class") == F.col("label")).cast("int")).alias("right"))
    return temperature, threshold(bins.orderBy("bin").collect())  # 101 bins at most


def threshold(bins: list) -> float:
    """The least bin (hundredths of probability) from which on TARGET_PRECISION of the predictions are right."""
    for k, row in enumerate(bins):
        n, right = (sum(x[c] for x in bins[k:]) for c in ("n", "right"))
        if right >= TARGET_PRECISION * n:
            return max(0.5, row["bin"] / 100)
    return 0.99


def classified(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, text_hash, paragraph, piece, class, p and ps (of all classes) of every piece whose class is not "none".

    One span of generated code from words to hits: each n-gram is looked up in the vocabulary, and what a piece has of it is
    gathered before any shuffle. Pieces without a weighted n-gram have the class of the largest intercept.
    """
    if max(range(len(CLASSES)), key=lambda k: model.intercepts[k]) != 0:
        raise ValueError("the intercepts alone must give the class none")
    hashed = rows.select("doc_id", "text_hash", "paragraph", F.transform("words", lambda w: F.xxhash64(w)).alias("h"), last_piece(F.col("words")).alias("last"))
    places = hashed.select("*", F.posexplode("h").alias("at", "h1"))
    own = lambda n: F.when(F.col("at") + n <= F.size("h"), gram_hash([F.col("h1"), *(F.get("h", F.col("at") + k) for k in range(1, n))]))
    sought = places.select("doc_id", "text_hash", "paragraph", "last", "at", F.posexplode(F.array(F.col("h1"), own(2), own(3))).alias("longer", "own"))
    hits = sought.join(F.broadcast(model.weights.select("gram")), F.col("own") == F.col("gram"))  # VOCABULARY n-grams at most
    step = PIECE - SHARED
    first = F.greatest(F.lit(0), F.ceil((F.col("at") + F.col("longer") + 1 - PIECE) / step).cast("int"))
    upto = F.least(F.col("last"), F.floor(F.col("at") / step).cast("int"))
    key = ["doc_id", "text_hash", "paragraph", "piece"]
    by_piece = hits.select(*key[:3], F.explode(F.sequence(first, F.greatest(first, upto))).alias("piece"), "gram")
    held = by_piece.groupBy(*key).agg(F.collect_set("gram").alias("held"))  # some 3 * PIECE at most; an n-gram counts once
    held = held.select(*key, F.explode("held").alias("own")).join(F.broadcast(model.weights), F.col("own") == F.col("gram"))
    summed = held.groupBy(*key).agg(*(F.sum(F.get("w", F.lit(k))).alias(f"s{k}") for k in range(len(CLASSES))))
    z = F.array(*(F.lit(b) + F.col(f"s{k}") for k, b in enumerate(model.intercepts)))
    scored = summed.select("doc_id", "text_hash", "paragraph", "piece", z.alias("z")).withColumn("best", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp((x - F.col("best")) / model.temperature))
    ps = F.transform("z", lambda x: F.exp((x - F.col("best")) / model.temperature) / total)
    return scored.select("doc_id", "text_hash", "paragraph", "piece", (F.array_position("z", F.col("best")) - 1).cast("int").alias("class"), (1 / total).alias("p"), ps.alias("ps")).where("class > 0")


def scan(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, paragraph, family, granted and p: a row for each family of a paragraph, or one "unknown".

    granted is false where the family is only mentioned.
    """
    key = ["doc_id", "text_hash", "paragraph", "piece"]
    found = written(classified(paragraphs(docs, text_col), model), "classified")
    of_families = F.aggregate(F.slice("ps", 3, len(NAMES)), F.lit(0.0), lambda s, x: s + x)
    sure = found.where(of_families >= model.threshold).select(*(F.col(k).alias(f"of_{k}") for k in key), F.col("ps").alias("of_ps"))
    # The words of these pieces only: their texts are read again, met by id and hash, and kept, so no other text is shuffled.
    ids = sure.select("of_doc_id", "of_text_hash").distinct()
    ids = F.broadcast(ids) if ids.count() <= MAX_IDS else ids
    again = docs.select("doc_id", text_col).join(ids, F.col("doc_id").eqNullSafe(F.col("of_doc_id")) & (F.xxhash64(text_col) == F.col("of_text_hash")), "left_semi").distinct()
    again = written(again, "likely")
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in key]
    words = pieces(paragraphs(again, text_col)).join(sure, same[0] & same[1] & same[2] & same[3], "left_semi")
    best = confirming(words, key).select(*(F.col(k).alias(f"in_{k}") for k in key), "confirmed")
    met = lambda mark, n: F.col("doc_id").eqNullSafe(F.col(f"{mark}_doc_id")) & (F.col("text_hash") == F.col(f"{mark}_text_hash")) & (F.col("paragraph") == F.col(f"{mark}_paragraph")) & (F.col("piece") == F.col(f"{mark}_piece") if n else F.lit(True))
    joined = found.withColumn("likely", of_families >= model.threshold).join(best, met("in", 1), "left")

    p_of = lambda family: F.get("ps", (F.array_position(F.array(*map(F.lit, CLASSES)), family) - 1).cast("int"))
    kept = F.filter(F.coalesce("confirmed", F.expr("CAST(array() AS array<struct<family:string,named:boolean>>)")), lambda x: F.col("likely") & (p_of(x["family"]) > F.get("ps", F.lit(0))))
    by_text = lambda family: F.exists("kept", lambda y: (y["family"] == family) & ~y["named"])
    beside = lambda family: F.exists("kept", lambda y: (y["family"] != family) & ~y["named"])
    rows = joined.withColumn("kept", kept).withColumn("families", F.array_distinct(F.transform("kept", lambda x: x["family"])))
    facts = F.transform("families", lambda f: F.struct(f.alias("family"), by_text(f).alias("whole"), beside(f).alias("beside"), p_of(f).alias("p")))
    unknown = F.array(F.struct(F.lit("unknown").alias("family"), F.lit(True).alias("whole"), F.lit(False).alias("beside"), F.col("p").alias("p")))
    each = rows.select("doc_id", "text_hash", "paragraph", F.explode(F.when(F.size("families") > 0, facts).otherwise(unknown)).alias("x")).select("doc_id", "text_hash", "paragraph", "x.*")
    each = each.groupBy("doc_id", "text_hash", "paragraph", "family").agg(F.bool_or("whole").alias("whole"), F.bool_or(~F.col("beside")).alias("alone"), F.max("p").alias("p"))
    each = written(each, "families")

    # Sentences of the paragraphs in which a family is confirmed by its name alone.
    by_name = each.where(~F.col("whole")).select(F.col("doc_id").alias("at_doc_id"), F.col("text_hash").alias("at_text_hash"), F.col("paragraph").alias("at_paragraph"), "family")
    lines = again.select("doc_id", F.xxhash64(text_col).alias("text_hash"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), PARAGRAPH_END)).alias("paragraph", "lines"))
    stated = F.coalesce(*(F.when(F.col("family") == f, granted(F.col("lines"), list(names) or ["all rights reserved"], not names)) for f, names in NAMES.items()))
    says = lines.join(by_name, met("at", 0)).select(*(F.col(k).alias(f"in_{k}") for k in key[:3]), F.col("family").alias("in_family"), stated.alias("stated"))
    both = each.join(says, met("in", 0) & (F.col("family") == F.col("in_family")), "left")
    verdict = F.col("whole") | (F.col("alone") & F.coalesce("stated", F.lit(True)))
    named = both.select("doc_id", "text_hash", "paragraph", "family", verdict.alias("granted"), "p")
    any_family = named.where("family != 'unknown'").select(*(F.col(k).alias(f"by_{k}") for k in key[:3])).distinct()
    return named.where("family != 'unknown'").union(named.where("family = 'unknown'").join(any_family, met("by", 0), "left_anti"))


def licences(docs: DataFrame, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """doc_id, families (sorted, comma-separated, empty if none), paragraphs (their numbers) and mentions (families that are named
    but not granted anywhere in it, likewise) of every document."""
    model = model or trained(docs.sparkSession, docs, text_col)
    found = scan(docs, model, text_col).groupBy(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_hash"))
    own = lambda cond, c: F.array_sort(F.collect_set(F.when(cond, F.col(c))))
    found = found.agg(own(F.col("granted"), "family").alias("families"), own(F.col("granted"), "paragraph").alias("paragraphs"), own(~F.col("granted"), "family").alias("mentions"))
    rows = docs.select("doc_id", F.xxhash64(text_col).alias("text_hash"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_hash") == F.col("of_hash")), "left")
    listed = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    paragraphs_of = F.coalesce("paragraphs", F.expr("CAST(array() AS array<int>)")).alias("paragraphs")
    return joined.select("doc_id", listed(F.col("families")).alias("families"), paragraphs_of, listed(F.array_except("mentions", "families")).alias("mentions"))
