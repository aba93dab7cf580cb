"""License scans (native: DataFrame functions only).

Templates are the short notices by which files state a license, the standard
headers, titles of license texts, and short texts as a whole.  Candidates of a file are its lines that
hold one of the templates' key words, its headers (consecutive
paragraphs that each hold one, and runs of comment lines, of any number of lines), and of a license file the whole text and its
first two paragraphs, where a title stands.  A line or header that says what it is *not* licensed under is none.  Candidates and templates are sparse TF-IDF vectors over word tokens; a
candidate has the license of the template with the greatest cosine, if that
reaches ``threshold``.  Where templates of two licenses are equally near (a paragraph that
several versions share), the candidate decides only if no other does.  Inverse document frequencies come from all distinct
candidates of the scanned table.

A file without a license of its own inherits from the nearest ancestor
directory that has a license file: directories, not files, are joined with
their ancestors' paths (equi-joins), and the deepest match wins.

Candidates are found inside the row in one scan, and only rows of ids, paths and
the few candidates are stored.  Equal lists of candidates are one row, and equal
candidates are scored once, so a line that a third of all files repeats costs
one row; tokens meet only the templates (a fixed number, broadcast).

Defined cases: a null text has no license of its own, and a null path inherits
nothing; a null file id is an id like others; of equal cosines the license of
the smaller name wins; a file with several licenses gets that of the best
candidate, but "all rights reserved" decides only where no other license is
found; repeated rows, also of one id, are judged each by its own text; texts
without a key word, however long, are not split; empty tables give no rows;
extra columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut

PROPRIETARY = "Proprietary"

#: License names (SPDX identifiers) and the notices, headers and texts by which files state them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.'),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    (PROPRIETARY, "Copyright. All rights reserved"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]

#: Names and versions in the headers of one family (SPDX identifier, name, version, the mark before the version).
GNU = [
    ("AGPL-3.0", "GNU Affero General Public License", "3"), ("GPL-1.0", "GNU General Public License", "1"), ("LGPL-2.0", "GNU Library General Public License", "2"),
    ("LGPL-2.1", "GNU Lesser General Public License", "2.1"), ("LGPL-3.0", "GNU Lesser General Public License", "3"),
]
GNU_HEADER = "This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details."
#: The titles under which license texts stand.
TITLES = [
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"), ("Artistic-1.0", "The Artistic License Preamble"), ("Artistic-2.0", "The Artistic License 2.0 Copyright The Perl Foundation"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"), ("EPL-2.0", "Eclipse Public License - v 2.0"), ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"), ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"), ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"), ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"), ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MPL-1.1", "MOZILLA PUBLIC LICENSE Version 1.1"), ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
#: A clause that stands below the titles of one family.
GNU_CLAUSE = " Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
TEMPLATES += [(i, GNU_HEADER.format(n, v)) for i, n, v in GNU] + TITLES + [(i, t + GNU_CLAUSE) for i, t in TITLES if t.startswith("GNU")]
TEMPLATES += [("MPL-1.1", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/')]
TEMPLATES += [(i, f"SPDX-License-Identifier: {i}") for i in sorted({i for i, _ in TEMPLATES} - {PROPRIETARY})]

#: What a candidate must hold; each template holds one of these.
KEYS = ("licen", "copyright", "permission", "public domain", "redistribut")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = r"[a-z]+[0-9]*|[0-9]+(?:\.[0-9]+)*"
LINE_END, BLOCK_END = r"\r?\n", r"\r?\n[ \t]*\r?\n"
#: Lines of a comment that follow each other.
COMMENT_RUN = r"(?:(?:^|\n)[ \t]*(?://|#|\*|/\*|--|;|%)[^\n]*)+"
#: Words by which a text says that a license does not hold.
NEGATED = r"(?i)(?:\bnot|\bnever|n't)\s+(?:[a-z]+\s+){0,2}(?:released|licensed|available|covered|governed)\b"
#: Stands for paragraphs without a key word while the others are strung together.
_GAP = "\ue000"
#: Cosines that differ by less are equal.
EQUAL = 0.001


def tokens(text: Column) -> Column:
    """Words (A-Z lower-cased) and numbers; a number keeps its inner dots."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TOKEN), F.lit(0))


def _key(text: Column) -> Column:
    low = F.translate(text, UPPER, LOWER)
    out = F.lit(False)
    for k in KEYS:
        out = out | F.contains(low, F.lit(k))
    return out


def candidates(files: DataFrame) -> DataFrame:
    """``file, directory, is_license_file, candidates, same`` (a digest of the candidates) of each row; stored, so texts are scanned once."""
    text, none = F.col("text"), F.array().cast("array<string>")
    usable = lambda x: _key(x) & ~x.rlike(NEGATED)
    several = lambda x: F.contains(F.trim(F.translate(x, "\r", " ")), F.lit("\n")) & usable(x)
    lines = F.filter(F.split(text, LINE_END), usable)
    paragraphs = F.split(text, BLOCK_END)
    runs = F.split(F.array_join(F.transform(paragraphs, lambda p: F.when(_key(p), p).otherwise(_GAP)), "\n"), _GAP)
    headers = F.filter(F.transform(F.concat(runs, F.regexp_extract_all(text, F.lit(COMMENT_RUN), F.lit(0))), lambda x: F.trim(F.regexp_replace(x, r"^\n+|\n+\z", ""))), several)
    title = F.array_join(F.slice(F.filter(paragraphs, lambda p: F.trim(p) != ""), 1, 2), "\n")
    whole = F.when(F.coalesce("is_license_file", F.lit(False)), F.array(text, title)).otherwise(none)
    found = F.transform(F.concat(lines, headers, whole), lambda x: F.trim(x))
    rows = files.select("file", "directory", "is_license_file", F.when(_key(text), F.array_sort(F.array_distinct(found))).otherwise(none).alias("candidates"))
    return cut(rows.withColumn("same", F.when(F.size("candidates") > 0, F.sha2(F.concat_ws("\n\n", "candidates"), 256))))


def score(texts: DataFrame, threshold: float = 0.75, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``id, license, cosine, equal`` (whether another license is as near) of the ``texts(id, text)`` whose best template reaches ``threshold``; equal texts have one id."""
    spark = texts.sparkSession
    rows = F.array(*[F.struct(F.lit(k).alias("template"), F.lit(a).alias("license"), F.lit(b).alias("notice")) for k, (a, b) in enumerate(templates)])
    known = spark.range(1).select(F.explode(rows).alias("t")).select("t.*")
    words = lambda df, text, *keep: df.select(*keep, F.explode(tokens(F.col(text))).alias("token")).groupBy(*keep, "token").agg(F.count("*").alias("tf"))
    # From here on an id stands for a text, however long.
    mine = cut(words(texts.groupBy("id").agg(F.first("text").alias("text")), "text", "id"))
    theirs = words(known, "notice", "template", "license")
    # Document frequencies of the templates' tokens only: a bounded number of rows.
    asked = theirs.select("token").distinct()
    df = mine.join(F.broadcast(asked), "token").groupBy("token").agg(F.count("*").alias("df"))
    n = float(mine.agg(F.count_distinct("id")).first()[0])
    idf = asked.join(df, "token", "left").select("token", F.log((n + 2.0) / (F.coalesce("df", F.lit(0)) + 1.0)).alias("idf"))
    vectors = theirs.join(idf, "token").select("template", "license", "token", "idf", (F.col("tf") * F.col("idf")).alias("w"))
    norms = vectors.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).where("norm > 0")
    unit = vectors.join(norms, "template").select("license", "template", "token", "idf", (F.col("w") / F.col("norm")).alias("u"))
    index = cut(unit.groupBy("token").agg(F.first("idf").alias("idf"), F.collect_list(F.struct("template", "license", "u")).alias("in_templates")))
    # A token that no template has counts towards the candidate's norm with a quarter of the greatest weight.
    weighed = mine.join(F.broadcast(index), "token", "left")
    weighed = weighed.withColumn("w", F.col("tf") * F.coalesce("idf", F.log(F.lit(n + 2.0)) / 4))
    pairs = weighed.select("id", "w", F.explode("in_templates").alias("t")).select("id", F.col("t.template").alias("template"), F.col("t.license").alias("license"), (F.col("w") * F.col("t.u")).alias("p"))
    dots = pairs.groupBy("id", "template", "license").agg(F.sum("p").alias("dot"))
    norm = weighed.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).where("norm > 0")
    scored = dots.join(norm, "id").select("id", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine")).where(F.col("cosine") >= threshold)
    near = scored.groupBy("id", "license").agg(F.max("cosine").alias("cosine"))  # a row a license
    best = near.groupBy("id").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b"), F.collect_list("cosine").alias("all"))
    equal = F.size(F.filter("all", lambda c: c > -F.col("b.c") - EQUAL)) > 1
    return best.select("id", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"), equal.alias("equal"))


def own_licenses(rows: DataFrame, threshold: float = 0.75) -> DataFrame:
    """``same, license, cosine`` of the lists of candidates (from ``candidates``) that state one."""
    lists = rows.where("same is not null").groupBy("same").agg(F.first("candidates").alias("candidates"))
    texts = lists.select("same", F.explode("candidates").alias("text")).withColumn("id", F.md5("text"))
    found = texts.select("same", "id").join(score(texts.select("id", "text"), threshold), "id")
    best = found.groupBy("same").agg(F.min(F.struct((F.col("license") == PROPRIETARY).alias("p"), "equal", (-F.col("cosine")).alias("c"), "license")).alias("b"))
    return best.select("same", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"))


def ancestors(directory: Column) -> Column:
    """``/a/b/c`` -> [``/``, ``/a``, ``/a/b``, ``/a/b/c``] as (path, depth)."""
    part = F.filter(F.split(directory, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(part)), lambda k: F.struct(F.concat(F.lit("/"), F.array_join(F.slice(part, 1, k), "/")).alias("path"), k.alias("depth")))


def scan(files: DataFrame, threshold: float = 0.75) -> DataFrame:
    """``file, directory, license, cosine, inherited_from`` for ``files(file, directory, is_license_file, text)``.

    ``inherited_from`` is the ancestor directory whose license file decides where the file states none.
    """
    rows = candidates(files)
    # Most rows have no candidate: they take no part in the join, where their null keys would meet in one task.
    bare = rows.drop("candidates").where("same is null").withColumns({"license": F.lit(None).cast("string"), "cosine": F.lit(None).cast("double")})
    own = rows.drop("candidates").where("same is not null").join(own_licenses(rows, threshold), "same", "left").unionByName(bare)
    given = own.where("is_license_file and license is not null and directory is not null").groupBy("directory").agg(F.min(F.struct((F.col("license") == PROPRIETARY).alias("p"), (-F.col("cosine")).alias("c"), "license")).alias("b"))
    # Spellings of one directory (/a/, //a) are one path.
    given = given.select(F.element_at(ancestors(F.col("directory")), -1)["path"].alias("path"), "b").groupBy("path").agg(F.min("b").alias("b")).select("path", F.col("b.license").alias("given"))
    dirs = rows.where("directory is not null").select("directory").distinct().select("directory", F.explode(ancestors(F.col("directory"))).alias("a"))
    near = dirs.join(given, F.col("a.path") == F.col("path")).groupBy("directory").agg(F.max(F.struct(F.col("a.depth").alias("depth"), "path", "given")).alias("n"))
    out = own.join(near, "directory", "left")
    return out.select("file", "directory", F.coalesce("license", F.col("n.given")).alias("license"), "cosine", F.when(F.col("license").isNull(), F.col("n.path")).alias("inherited_from"))


def files_of_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Documents as files of a source tree: ``/<source>/<lang>/<doc_id div 100>``; each tenth is a level higher, and the
    documents with an id divisible by 10 stand for license files where they state a license."""
    source, lang = F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none"))
    leaf = F.concat_ws("/", F.lit(""), source, lang, F.floor(F.col("doc_id") / 100).cast("string"))
    directory = F.when(F.col("doc_id") % 10 == 0, F.when(F.col("doc_id") % 20 == 0, F.concat_ws("/", F.lit(""), source, lang)).otherwise(leaf)).otherwise(leaf)
    return docs.select(F.col("doc_id").alias("file"), directory.alias("directory"), (F.col("doc_id") % 10 == 0).alias("is_license_file"), "text")
