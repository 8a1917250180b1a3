"""Licence detection by sparse TF-IDF cosine, and inheritance from the nearest directory.

Every line and every paragraph of a file, also of a whole licence file and of a
comment without its signs, is held against template texts. Each term weighs by how many files hold it, also one that
is in no template: it lengthens a passage. Passages without a telling term cannot
reach the threshold and go before any shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.session import materialize

LEAST_COSINE = 0.75
_NO_PATH = "\0"  # stands for a null path in joins
LICENCE_FILE = r"(?i)^(un)?licen[cs]e([-._].*)?$|^copying([-._].*)?$|^notice([-._].*)?$"
# The usual notices, by SPDX id; standard headers, titles and texts follow.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
_GNU = [("GPL", "GNU General Public License", {"2": "June 1991", "3": "29 June 2007"}),
        ("LGPL", "GNU Lesser General Public License", {"2.1": "February 1999", "3": "29 June 2007"}),
        ("AGPL", "GNU Affero General Public License", {"3": "19 November 2007"})]


def _gnu_wordings() -> list[tuple[str, str]]:
    """Titles, the standard header and the short notices of each version."""
    out = []
    for short, name, versions in _GNU:
        for version, date in versions.items():
            spdx = f"{short}-{version}" + ("" if "." in version else ".0")
            out += [(spdx, f"{name} Version {version}, {date}"), (spdx, f"{name} Version {version}"), (spdx, f"Licensed under the {name} v{version}.")]
            for thing in ("program", "library", "software", "work"):
                for end in (f"either version {version} of the License, or (at your option) any later version.",
                            f"version {version} of the License.", f"version {version}."):
                    out.append((spdx, f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the {name} "
                                      f"as published by the Free Software Foundation, {end}"))
                out += [(spdx, f"This {thing} is licensed under the {name}, version {version}."),
                        (spdx, f"This {thing} is licensed under the terms of the {name}, version {version} or later.")]
    return out


_BSD_HEAD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
             "conditions are met:")
_BSD_2 = ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. "
          "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
          "in the documentation and/or other materials provided with the distribution.")
_BSD_3 = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
          "from this software without specific prior written permission.")
_MIT_GRANT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
              "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
              "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
              "subject to the following conditions:")
_MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
TEMPLATES = NOTICES + _gnu_wordings() + [
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Apache License Version 2.0"),
    ("Apache-2.0", NOTICES[1][1] + " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "MIT License"),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _MIT_GRANT),
    ("MIT", f"{_MIT_GRANT} {_MIT_REST}"),
    ("BSD-2-Clause", f"{_BSD_HEAD} 1. {_BSD_2}"),
    ("BSD-3-Clause", f"{_BSD_HEAD} 1. {_BSD_2} 3. {_BSD_3}"),
    ("BSD-3-Clause", _BSD_3),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
                "this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("ISC", "ISC License"),
    ("ISC", NOTICES[12][1] + ", provided that the above copyright notice and this permission notice appear in all copies."),
]
CLASSES = 16  # of template terms by weight, in the bound that keeps hopeless passages from being compared
WHOLE_TERMS = 4  # a template of up to so many different terms counts only where a passage holds all of them
# The sign that opens a comment line, and comments in brackets.
_SIGNS = r"(?im)^[ \t]*(?:/?\*+/?|//+|#+|;+|--+|%+|'+|!+|<!--+|dnl\b|rem\b)[ \t]*([^\n]*)$"
_BLOCKS = r"(?s)/\*.*?\*/|<!--.*?-->|\"{3}.*?\"{3}|'{3}.*?'{3}"


def terms(text: Column) -> Column:
    """Runs of ASCII letters and digits in lower case, with inner dots between digits kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[0-9]+(?:\.[0-9]+)*|[a-z]+"), F.lit(0))


def _passages(files: DataFrame) -> DataFrame:
    """(path, text_hash, passage): the distinct lines and paragraphs of each file, and those of its comments.

    A comment line goes between the signs 1 and 2, and 3 joins those that follow one another; runs end where code begins.
    """
    text = F.coalesce("text", F.lit(""))
    marked = F.regexp_replace(F.regexp_replace(text, _SIGNS, "\x01$1\x02"), "\x02\n\x01", "\x03")
    runs = F.split(marked, "[\x01\x02]|\x03[ \t\r]*(?=\x03)|\n[ \t\r]*\n")
    blocks = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(_BLOCKS), F.lit(0)), lambda b: F.split(b, r"\n[ \t\r*#]*\n")))
    parts = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, r"\n[ \t\r]*\n"), runs, blocks))
    return files.select("path", "text_hash", F.explode(parts).alias("passage"))


def _weights(files: DataFrame) -> tuple[DataFrame, float]:
    """(term, idf) of every term that a file holds, and the idf of a term that no file holds."""
    total = files.count()
    held = files.select(F.explode(F.array_distinct(terms(F.coalesce("text", F.lit(""))))).alias("term"))
    idf = F.log((F.lit(total) + 1.0) / (F.col("n") + 1.0)) + 1.0
    return materialize(held.groupBy("term").agg(F.count("*").alias("n")).select("term", idf.alias("idf")), "weights"), \
        math.log(total + 1.0) + 1.0


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _may_reach(found: Column, vectors: list, least: float) -> Column:
    """Whether the terms ``found`` of a passage can reach the cosine ``least`` with a template: false only if they cannot.

    A passage without any of a template's heavy terms keeps at most the light ones'
    share of the template's length. And every term has an idf of 1 at least, so what
    is in no template adds at least its count to the squared length of the passage,
    while the templates' terms add to the product what their weights say. Terms of
    like weight form a class, which counts its largest product and least length.
    """
    telling, product, square = set(), {}, {}
    for row in vectors:
        light = 0.0
        for part in sorted(row.parts, key=lambda p: (p.w, p.term)):
            light += part.w * part.w
            if math.sqrt(light) >= least * row.norm * (1 - 1e-9):
                telling.add(part.term)
            product[part.term] = max(product.get(part.term, 0.0), part.idf * part.w / row.norm)
            square[part.term] = part.idf * part.idf
    order = sorted(product, key=lambda term: (product[term], term))
    if not order:
        return F.lit(False)
    size = -(-len(order) // CLASSES) or 1
    classes = [order[at:at + size] for at in range(0, len(order), size)]

    def total(known: Column, of: Callable[[list[str]], float]) -> Column:
        def value(x: Column) -> Column:
            out = F.lit(of(classes[-1]))
            for group in reversed(classes[:-1]):
                out = F.when(x.isin(group), of(group)).otherwise(out)
            return out
        return F.aggregate(known, F.lit(0.0), lambda s, x: s + value(x))

    def bound(known: Column) -> Column:
        length = total(known, lambda group: min(square[t] for t in group)) + (F.size(found) - F.size(known))
        return total(known, lambda group: max(product[t] for t in group)) >= F.sqrt(length) * (least * (1 - 1e-9))

    return F.exists(found, lambda x: x.isin(sorted(telling))) & _let(F.filter(found, lambda x: x.isin(order)), bound)


def detect(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST_COSINE) -> DataFrame:
    """(path, text_hash, license, score): the best template of each file in which one reaches ``least``."""
    spark = files.sparkSession
    known = spark.createDataFrame([(k, name, body) for k, (name, body) in enumerate(templates)],
                                  "template int, license string, body string")
    weights, most = _weights(files)
    counted = known.select("template", "license", F.explode(terms(F.col("body"))).alias("term")) \
        .groupBy("template", "license", "term").agg(F.count("*").alias("tf")).join(weights, "term", "left") \
        .withColumn("idf", F.coalesce("idf", F.lit(most))).select("template", "license", "term", "idf", (F.col("tf") * F.col("idf")).alias("w"))
    vectors = counted.groupBy("template", "license").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.struct("w", "term", "idf")).alias("parts")).collect()
    passage_id = F.struct(F.xxhash64("passage").alias("a"), F.xxhash64(F.lit(1), "passage").alias("b"))
    passages = materialize(_passages(files).filter(_let(terms(F.col("passage")), lambda t: _may_reach(t, vectors, least)))
                           .withColumn("passage_id", passage_id), "passages")
    # a notice that many files share is compared once
    found = passages.select("passage_id", "passage").distinct().select("passage_id", F.explode(terms(F.col("passage"))).alias("term")) \
        .groupBy("passage_id", "term").agg(F.count("*").alias("tf"))
    found = found.join(weights, "term").withColumn("v", F.col("tf") * F.col("idf"))
    lengths = found.groupBy("passage_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))
    norms = spark.createDataFrame([(r.template, r.license, r.norm, len(r.parts) if len(r.parts) <= WHOLE_TERMS else 0, p.term, p.w)
                                   for r in vectors for p in r.parts],
                                  "template int, license string, norm double, whole int, term string, w double")
    dots = found.join(norms, "term").groupBy("passage_id", "template", "license", "norm", "whole").agg(
        F.sum(F.col("v") * F.col("w")).alias("dot"), F.count("*").alias("held")).filter("held >= whole")
    scored = dots.join(lengths, "passage_id") \
        .withColumn("score", F.round(F.col("dot") / F.col("length") / F.col("norm"), 6)).filter(F.col("score") >= least)
    best = F.min(F.struct((-F.col("score")).alias("score"), "template", "license"))
    scored = materialize(scored.groupBy("passage_id").agg(best.alias("own")), "scored")
    return passages.select("path", "text_hash", "passage_id").join(scored, "passage_id") \
        .groupBy("path", "text_hash").agg(F.min("own").alias("best")).select(
            "path", "text_hash", F.col("best.license").alias("license"), (-F.col("best.score")).alias("score"))


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, "[^/]*$", "")


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST_COSINE,
         path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``files`` with ``license``, ``license_score``, ``license_origin`` and ``license_dir``.

    The origin is ``file`` for a licence file, ``header`` for another file with a
    notice of its own, ``inherited`` from the nearest directory above (the file's
    own one first) that has a licence file with a licence, or ``none``. Of several
    licence files in a directory the one with the best score counts, then the
    earlier template. Null and empty texts have no licence of their own and may
    inherit; a null path inherits nothing. Rows alike in path and text get equal
    results. Other columns stay; the four names replace columns alike in name.
    """
    known_path = F.coalesce(F.col(path_col), F.lit(_NO_PATH))
    own = files.select(known_path.alias("path"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    order = {name: k for k, (name, _) in reversed(list(enumerate(templates)))}
    found = materialize(detect(own, templates, least), "licences")
    name = F.regexp_extract("path", "[^/]*$", 0)
    rank = F.coalesce(*[F.when(F.col("license") == k, v) for k, v in order.items()])
    rooted = found.filter(name.rlike(LICENCE_FILE)).groupBy(_directory(F.col("path")).alias("dir")).agg(
        F.min(F.struct((-F.col("score")).alias("s"), rank.alias("r"), "license")).alias("best")) \
        .select("dir", F.col("best.license").alias("dir_license"))
    rooted = materialize(rooted, "licence_dirs")
    # Directories are few beside files: each looks its ancestors up once.
    dirs = own.filter(F.col("path") != _NO_PATH).select(_directory(F.col("path")).alias("of")).distinct()
    parts = F.split("of", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(
        F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))))
    nearest = dirs.select("of", F.explode(above).alias("dir")).join(rooted, "dir").groupBy("of").agg(
        F.max_by(F.struct("dir", "dir_license"), F.length("dir")).alias("near")) \
        .select("of", F.col("near.dir").alias("__dir"), F.col("near.dir_license").alias("__inherited"))
    nearest = materialize(nearest, "nearest")
    found = found.select(F.col("path").alias("__path"), F.col("text_hash").alias("__hash"),
                         F.col("license").alias("__own"), F.col("score").alias("__score"))
    # the keys are made before the joins, so a text that the caller does not ask for is not moved
    keyed = files.withColumns({"__known_path": known_path, "__text_hash": F.xxhash64(text_col), "__of": _directory(F.col(path_col))})
    joined = keyed.join(found, (F.col("__known_path") == F.col("__path")) & (F.col("__text_hash") == F.col("__hash")), "left") \
        .join(nearest, F.col("__of") == F.col("of"), "left")
    licence_file = F.regexp_extract(F.col(path_col), "[^/]*$", 0).rlike(LICENCE_FILE)
    has = F.col("__own").isNotNull()
    return joined.withColumns({
        "license": F.coalesce("__own", "__inherited"), "license_score": F.col("__score"),
        "license_origin": F.when(has & F.coalesce(licence_file, F.lit(False)), "file").when(has, "header")
        .when(F.col("__inherited").isNotNull(), "inherited").otherwise("none"),
        "license_dir": F.when(~has, F.col("__dir"))}).drop(
            "__path", "__hash", "__own", "__score", "of", "__dir", "__inherited", "__known_path", "__text_hash", "__of")
