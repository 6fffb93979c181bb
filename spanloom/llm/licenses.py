"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Headers are looked for in windows: runs of as many terms as a template has, at every place, across line breaks; lines
and paragraphs count as well, for notices that are shorter than their template. A licence file is a file whose whole
text is near a whole licence text (licence_texts/, FULL_THRESHOLD), or one by its name, whose text is one unit with all
of its lines. A unit's terms weigh tf * idf, those of whole licence texts (1 + ln tf) * idf; the idf of the templates'
terms counts all files, and terms of no template weigh as these do on average. The best template at or above the
threshold is the unit's licence; SPDX lines need all of theirs.

What is left out can't reach the threshold, as a cosine is at most the norm of the template's part that the unit holds:
a unit without any of a template's anchors (the heaviest terms, as many as leave the others' share of the norm below
the threshold), a window or file whose terms cover less of a template, and a text with fewer rare terms of licence
texts than any of these needs.

A file takes, in this order: its own licence as a licence file; its own header's; else that of the licence file in the
nearest directory above, found by joining the file's ancestors with the licence files' directories. The ancestors of a
path are joined once for each distinct directory, so the join's rows follow the directories, not the files. DataFrame
functions only.

Defined results: a null text or path has no licence (paths are null); rows are told apart by a number of their own, so
repeated rows and null ids each get their result; of licence files of one directory the highest cosine counts, then
the smallest licence name; other columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import stage, table, text_of

THRESHOLD, SPDX_THRESHOLD, FULL_THRESHOLD = 0.6, 0.95, 0.8
#: Possessive, so that Java matches long dotted runs in a loop and not by recursion.
TERM = "[a-z0-9]++(?:[.-][a-z0-9]++)*+"
#: Names of licences, up to a slash, and phrases by which headers and licence files give them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-2.0": "This program is licensed under the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "Apache-2.0/header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT/header": "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file",
    "BSD-3-Clause/header": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "GPL-2.0/header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1/header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0/header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ISC/header": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "CC-BY-4.0/header": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0/header": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0/header": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
}
_SPDX = {x: [x] for x in ("Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "Unlicense")}
_SPDX |= {x: [x, f"{x}-only", f"{x}-or-later"] for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")}
TEMPLATES |= {f"{name}/spdx/{own}": f"SPDX-License-Identifier: {own}" for name, all_own in _SPDX.items() for own in all_own}
#: Whole licence texts by name, without their copyright lines; read by the driver.
FULL = {p.stem: p.read_text("utf-8") for p in sorted(Path(__file__).with_name("licence_texts").glob("*.txt"))}
#: Places of a text whose windows are cut in one row.
STEP = 1024
BLANK_LINE = "\\n[ \\t\\r]*\\n"


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def listed(terms: list[str]) -> Column:
    return F.split(F.lit(" ".join(terms)), " ")


def term_files(files: DataFrame, text: str, templates: dict[str, str] | None = None) -> tuple[dict[str, int], int]:
    """In how many of all files each of the templates' terms is, and the files; one row a term reaches the driver."""
    terms = sorted({t for own in (templates or TEMPLATES | {f"{n}/full": x for n, x in FULL.items()}).values() for t in re.findall(TERM, own.lower())})
    found = F.array_intersect(terms_of(text_of(files, text)), listed(terms))
    counts = files.select(F.explode(F.concat(found, F.array(F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()
    got = {r["term"]: r["n"] for r in counts}
    return {t: got.get(t, 0) for t in terms}, got.get("", 0)


class Templates:
    def __init__(self, files_with: dict[str, int], files: int, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, sublinear: bool = False):
        terms = {name: re.findall(TERM, text.lower()) for name, text in templates.items()}
        self.threshold, self.sublinear = threshold, sublinear
        self.sizes = {name: len(own) for name, own in terms.items()}
        self.idf = {t: math.log((2 + files) / (1 + files_with.get(t, 0))) for own in terms.values() for t in own}
        self.other = sum(self.idf.values()) / len(self.idf)
        self.weights = {name: {t: (1 + math.log(n) if sublinear else n) * self.idf[t] for t, n in Counter(own).items()} for name, own in terms.items()}
        self.norms = {name: math.sqrt(sum(w * w for w in own.values())) for name, own in self.weights.items()}
        self.own_anchors: dict[str, list[str]] = {}
        #: Terms of few files, and how many of them at least a text holds that covers enough of any template, even with all other terms.
        self.rare = sorted(t for t in self.idf if files_with.get(t, 0) <= files / 20)
        self.least, rare = len(self.idf), set(self.rare)
        for name, own in self.weights.items():
            rest, heaviest, chosen = sum(w * w for w in own.values()), sorted(own.items(), key=lambda x: (-x[1], x[0])), []
            for t, w in heaviest:
                if math.sqrt(max(rest, 0)) / self.norms[name] < threshold - 1e-9:
                    break
                chosen.append(t)
                rest -= w * w
            self.own_anchors[name] = chosen
            covered, n = sum(w * w for t, w in heaviest if t not in rare), 0
            for w in (w for t, w in heaviest if t in rare):
                if math.sqrt(covered) >= (threshold - 1e-9) * self.norms[name]:
                    break
                covered, n = covered + w * w, n + 1
            self.least = min(self.least, n)
        self.anchors = sorted({t for own in self.own_anchors.values() for t in own})
        self.pattern = rf"(?i)(?<![a-z0-9])({'|'.join(map(re.escape, self.anchors))})(?![a-z0-9])"

    def postings(self, spark: SparkSession) -> DataFrame:
        """term, idf, and the weights of the templates that have it; one row a term."""
        rows = [(t, idf, [(name, own[t] / self.norms[name]) for name, own in self.weights.items() if t in own]) for t, idf in sorted(self.idf.items())]
        return spark.createDataFrame(rows, "term string, idf double, templates array<struct<licence:string,weight:double>>").coalesce(1)

    def shapes(self, spark: SparkSession) -> DataFrame:
        """template, n (terms with repeats), its distinct terms, the shares that they have of its squared norm, and its anchors; one row a template."""
        rows = [(name, self.sizes[name], list(own), [(w / self.norms[name]) ** 2 for w in own.values()], self.own_anchors[name]) for name, own in self.weights.items()]
        return spark.createDataFrame(rows, "template string, n int, own array<string>, shares array<double>, anchors array<string>").coalesce(1)

    def has_rare(self, terms: Column) -> Column:
        """Whether these terms hold as many rare ones as any text that reaches the threshold."""
        return F.size(F.array_intersect(terms, listed(self.rare))) >= self.least if self.least else F.lit(True)

    def reached(self, terms: Column) -> Column:
        """Whether these terms cover enough of a row of shapes() to reach the threshold."""
        part = F.aggregate(F.zip_with("own", "shares", lambda t, s: F.when(F.array_contains(terms, t), s).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)
        return part >= self.threshold**2 - 1e-9


def best_of(found: DataFrame, keys: list[str]) -> DataFrame:
    """The highest cosine of each key and its licence, of equal ones the first by name."""
    return found.groupBy(*keys).agg(F.max("cosine").alias("cosine"), F.min_by("licence", F.struct(-F.col("cosine"), "licence")).alias("licence"))


def best_templates(units: DataFrame, keys: list[str], templates: Templates) -> DataFrame:
    """units: keys and terms, keys unique. keys, licence, cosine of the units that reach the threshold. Sparse: a unit's terms meet the templates' postings."""
    tf = units.select(*keys, F.explode("terms").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    n = F.log("tf") + 1 if templates.sublinear else F.col("tf")
    met = tf.join(F.broadcast(templates.postings(units.sparkSession)), "term", "left").withColumn("w", n * F.coalesce("idf", F.lit(templates.other)))
    norm = met.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = met.where("templates is not null").select(*keys, "w", F.explode("templates").alias("t")).groupBy(*keys, F.col("t.licence").alias("template")).agg(F.sum(F.col("w") * F.col("t.weight")).alias("dot"))
    cosine = F.round(F.col("dot") / F.col("norm"), 9)
    enough = F.when(F.col("template").contains("/spdx/"), F.lit(max(SPDX_THRESHOLD, templates.threshold))).otherwise(F.lit(templates.threshold))
    scored = dots.join(norm, keys).select(*keys, F.substring_index("template", "/", 1).alias("licence"), cosine.alias("cosine"), enough.alias("_enough"))
    return best_of(scored.where(F.col("cosine") >= F.col("_enough")), keys)


def windows(files: DataFrame, key: str, templates: Templates, step: int = STEP) -> DataFrame:
    """key, unit, terms: of each template the runs of as many terms that hold an anchor and enough of it; at the text's ends they are shorter.

    Texts are cut into stretches of `step` places, each with what a window from its last place reaches, so that a row
    holds one stretch's windows at most. Equal windows of a text are one unit.
    """
    reach = max(templates.sizes.values(), default=1) - 1
    stretches = lambda terms: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(terms) - 1, F.lit(0)) / step).cast("int")), lambda i: F.struct(i.alias("n"), F.slice(terms, i * step + 1, F.lit(step + reach)).alias("all")))
    rows = files.select(key, terms_of(F.col("_text")).alias("terms")).select(key, F.explode(stretches(F.col("terms"))).alias("s")).select(key, "s.n", "s.all")
    rows = rows.withColumnRenamed("n", "stretch").withColumn("known", F.array_intersect("all", listed(sorted(templates.idf))))
    met = rows.join(F.broadcast(templates.shapes(files.sparkSession)), templates.reached(F.col("known")))
    at = F.filter(F.transform("all", lambda t, i: F.when(F.array_contains("anchors", t), i)), lambda i: i.isNotNull())
    starts = F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(i - F.col("n") + 1, i))))
    # A start before the stretch is the stretch's before, but at the text's beginning; one behind it is the next one's.
    own = F.filter(starts, lambda i: (i < step) & ((i >= 0) | (F.col("stretch") == 0)))
    runs = F.transform(own, lambda i: F.slice("all", F.greatest(i, F.lit(0)) + 1, F.col("n") + F.least(i, F.lit(0))))
    cut = met.select(key, F.explode(F.filter(runs, templates.reached)).alias("terms"))
    return cut.withColumn("unit", F.md5(F.array_join("terms", " "))).dropDuplicates([key, "unit"]).select(key, "unit", "terms")


def header_licences(files: DataFrame, key: str, templates: Templates) -> DataFrame:
    """key, licence, cosine: of each file's windows, lines and paragraphs the best, of equal ones the first by name. key is unique."""
    may = files.where(F.col("_text").rlike(templates.pattern)).select(key, "_text")
    cut = lambda by: may.select(key, F.posexplode(F.split("_text", by)).alias("at", "piece")).where(F.col("piece").rlike(templates.pattern))
    piece = lambda kind: (key, F.concat_ws(":", F.lit(kind), "at").alias("unit"), terms_of(F.col("piece")).alias("terms"))
    units = windows(may, key, templates).unionByName(cut("\n").select(*piece("line"))).unionByName(cut(BLANK_LINE).where(F.col("piece").contains("\n")).select(*piece("paragraph")))
    return best_of(best_templates(units, [key, "unit"], templates), [key])


def ancestors(path: Column) -> Column:
    """The directories above a path, nearest first, with their distance; the root is the empty path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - i), "/").alias("dir"), i.alias("up")))


def scan(files: DataFrame, key: str, path: str, text: str, is_licence_file: Column, templates: Templates | None = None, full: Templates | None = None) -> DataFrame:
    """key, path, licence, via ('header', 'file', 'inherited' or null), cosine, from_dir of every row of files."""
    if templates is None or full is None:
        counts = term_files(files, text)
        templates, full = templates or Templates(*counts), full or Templates(*counts, FULL, FULL_THRESHOLD, sublinear=True)
    # What tells candidates are terms: a text without a template's anchors among them can't reach it.
    telling = F.array_intersect(terms_of(text_of(files, text)), listed(sorted({*templates.anchors, *full.rare})))
    rows = files.select(files[key].alias("_key"), files[path].cast("string").alias("_path"), F.coalesce(is_licence_file, F.lit(False)).alias("_whole"), text_of(files, text).alias("_text"), telling.alias("_telling"))
    may = F.col("_path").isNotNull() & (F.arrays_overlap("_telling", listed(templates.anchors)) | full.has_rare(F.col("_telling")))
    rows = rows.select("_key", "_path", "_whole", F.when(may, F.col("_text")).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    rows = stage(rows, "licence-rows")  # with the texts of candidates only
    unique = rows.where("_text is not null").select("_row", "_path", "_whole", "_text")
    terms = unique.select("_row", terms_of(F.col("_text")).alias("terms")).where(full.has_rare(F.col("terms"))).withColumn("known", F.array_intersect("terms", listed(sorted(full.idf))))
    near = terms.join(F.broadcast(full.shapes(files.sparkSession)), full.reached(F.col("known")), "left_semi")
    licences = stage(best_templates(near.select("_row", "terms"), ["_row"], full), "licence-texts")
    others = unique.join(licences.select("_row"), "_row", "left_anti")
    named = others.where("_whole").select("_row", terms_of(F.col("_text")).alias("terms"))
    headers = header_licences(others, "_row", templates).join(unique.select("_row", "_whole"), "_row")
    whole = best_of(best_templates(named, ["_row"], templates).unionByName(headers.where("_whole").drop("_whole")).unionByName(licences), ["_row"])
    own = stage(headers.where("not _whole").drop("_whole").withColumn("via", F.lit("header")).unionByName(whole.withColumn("via", F.lit("file"))), "licence-own")
    parent = F.expr("substring(_path, 1, greatest(0, length(_path) - length(substring_index(_path, '/', -1)) - 1))")
    given = own.where("via = 'file'").join(unique.select("_row", parent.alias("dir")), "_row").groupBy("dir").agg(F.max("cosine").alias("dir_cosine"), F.min_by("licence", F.struct(-F.col("cosine"), "licence")).alias("dir_licence"))
    dirs = rows.where("_path is not null").select(parent.alias("at")).distinct()
    above = dirs.select("at", F.explode(ancestors(F.concat("at", F.lit("/x")))).alias("a")).select("at", "a.dir", "a.up")
    inherited = above.join(given, "dir").groupBy("at").agg(F.min_by(F.struct("dir", "dir_licence", "dir_cosine"), "up").alias("got"))
    inherited = stage(inherited, "licence-dirs")
    out = rows.select("_row", "_key", "_path", parent.alias("_at")).join(own, "_row", "left").join(inherited, F.col("_at") == F.col("at"), "left")
    via = F.when(F.col("via").isNotNull(), F.col("via")).when(F.col("got").isNotNull(), F.lit("inherited"))
    return out.select(F.col("_key").alias(key), F.col("_path").alias("path"), F.coalesce("licence", "got.dir_licence").alias("licence"), via.alias("via"), F.coalesce("cosine", "got.dir_cosine").alias("cosine"), F.when(F.col("via").isNull(), F.col("got.dir")).alias("from_dir"))


def directory(name: Column) -> Column:
    """A directory of this name; null has one of its own, ~null, which no name can take."""
    name = name.cast("string")
    return F.coalesce(F.when(name.startswith("~"), F.concat(F.lit("~"), name)).otherwise(name), F.lit("~null"))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files source/lang/doc_id.txt. No name tells a licence file; whole texts do."""
    name = F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("~null")), F.lit(".txt"))
    return docs.select(docs["doc_id"], F.concat_ws("/", directory(docs["source"]), directory(docs["lang"]), name).alias("path"), docs["text"])


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents as files under source/lang/."""
    return scan(document_files(table(spark, sf_dir, "documents")), "doc_id", "path", "text", F.lit(False))
