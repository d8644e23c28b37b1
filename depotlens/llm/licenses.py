"""Licences of files: TF-IDF cosine to templates, then inheritance from the nearest directory.

Every passage of a whole text that names a licence (a paragraph, its wrapped lines joined, a sentence or a line, in
licence files also the whole text) is compared with the templates, short wordings and full headers, by the cosine of sparse TF-IDF vectors; the best match of a file is its own licence.
All terms that occur in passages or templates are weighted by how many of all documents hold them. Files without a licence inherit from the licence file of the nearest ancestor
directory: directories, not files, are expanded to their ancestors and joined by path. Built from DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlens.llm.workers import text_or_empty
from depotlens.plans.durable import materialize
from depotlens.plans.lookups import fits_broadcast

MINIMUM = 0.6

# Usual wordings of licence headers, several for some licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released to the public domain under CC0 1.0."),
)
_GNU = (
    "{this} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as "
    "published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
)
_GNU_OLD = (
    "{this} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as "
    "published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."
)
_PERMISSION = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions:"
)
# The full headers and texts as the licences give them.
FULL_TEMPLATES = (
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\n"
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ),
    (
        "MIT",
        _PERMISSION + "\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
        "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("GPL-2.0", _GNU_OLD.format(this="This program", kind="", version="2")),
    ("GPL-3.0", _GNU.format(this="This program", kind="", version="3")),
    ("LGPL-3.0", _GNU.format(this="This library", kind="Lesser ", version="3")),
    ("AGPL-3.0", _GNU.format(this="This program", kind="Affero ", version="3")),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR "
        "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL "
        "THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder "
        "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written "
        'permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO "
        "EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
        "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
        "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
)
#: Heads of licence texts and single paragraphs of the full ones.
HEADS = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MIT", _PERMISSION),
)
#: Paragraphs of the full texts that stand alone where a text is cut.
PARAGRAPHS = tuple((name, part) for name, text in FULL_TEMPLATES for part in text.split("\n\n")[1:] if len(part) > 200)
SPDX = tuple((name, f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(name for name, _ in TEMPLATES + FULL_TEMPLATES))
ALL_TEMPLATES = TEMPLATES + FULL_TEMPLATES + HEADS + PARAGRAPHS + SPDX
#: Marks of comments at the start of a line.
COMMENT = r"(?m)^[\x20\t]*(?:/\*+|\*+/|\*+|//+|#+|--+|;+|%+|<!--)?[\x20\t]*"
#: A passage without any of these is not about a licence.
ANCHORS = r"(?i)licen[cs]e|permission|redistribution|public domain|cc0|cc by|warrant|liable"


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits; version numbers keep their dots."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[0-9]+(?:\.[0-9]+)+|[a-z0-9]+"), F.lit(0))


def _templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(ALL_TEMPLATES)], "template int, licence string, text string")


def passages(text: Column, whole: Column) -> Column:
    """Lines, paragraphs and their sentences that name a licence, and the ``whole`` text of a licence file."""
    sentence = r"(?<=[.!?])\s+"
    plain = F.regexp_replace(text, COMMENT, "")
    blocks = F.transform(F.split(plain, r"\r?\n(?:[\x20\t]*\r?\n)+"), lambda b: F.trim(F.regexp_replace(b, r"\s+", " ")))
    named = F.filter(blocks, lambda b: b.rlike(ANCHORS))
    sentences = F.flatten(F.transform(named, lambda b: F.split(b, sentence)))
    lines = F.split(text, rf"\n|{sentence}")
    found = F.concat(lines, named, sentences, F.when(whole, F.array(text)).otherwise(F.array().cast("array<string>")))
    return F.when(text.rlike(ANCHORS), F.filter(found, lambda p: p.rlike(ANCHORS)))


def term_weights(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(term, weight) of every term of ``texts``: ln((1 + n) / (1 + df)) + 1 over all n documents."""
    wanted = materialize(texts.select(F.explode(terms(F.col("text"))).alias("term")).distinct(), "wanted-terms")
    # One scan: a marker row per document counts them, the rest counts its terms.
    held = F.concat(F.array_distinct(terms(text_or_empty())), F.array(F.lit(" ")))
    marked = wanted.union(docs.sparkSession.createDataFrame([(" ",)], "term string"))
    found = docs.select(F.explode(held).alias("term"))
    if fits_broadcast(wanted):
        found = found.join(F.broadcast(marked), "term", "left_semi")
        counts = found.groupBy("term").agg(F.count("*").alias("df"))
    else:
        counts = found.groupBy("term").agg(F.count("*").alias("df")).join(marked, "term", "left_semi")
    counts = materialize(counts, "term-counts")
    n = (counts.filter("term = ' '").agg(F.max("df")).first()[0]) or 0
    weight = F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.coalesce("df", F.lit(0)))) + 1.0
    return wanted.join(counts, "term", "left").select("term", weight.alias("weight"))


def own_licences(files: DataFrame, minimum: float = MINIMUM) -> DataFrame:
    """``path``, ``licence``, ``score`` of files whose text names a licence (``path``, ``text``; ``is_licence_file`` if known)."""
    spark = files.sparkSession
    whole = F.coalesce("is_licence_file", F.lit(False)) if "is_licence_file" in files.columns else F.lit(False)
    told = files.select("path", F.explode(F.array_distinct(passages(text_or_empty(), whole))).alias("passage"))
    told = told.select("path", F.md5("passage").alias("key"), "passage")
    # A wording that many files share is compared once.
    wordings = materialize(told.groupBy("key").agg(F.max("passage").alias("text")), "wordings")
    weights = materialize(term_weights(files, wordings.select("text").union(_templates(spark).select("text"))), "term-weights")
    weights = F.broadcast(weights) if fits_broadcast(weights) else weights

    def vectors(rows: DataFrame, key: str) -> DataFrame:
        counted = rows.select(key, F.explode(terms(F.col("text"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
        return counted.join(weights, "term").select(key, "term", ((F.lit(1.0) + F.log("tf")) * F.col("weight")).alias("value"))

    left, right = vectors(wordings, "key"), vectors(_templates(spark), "template")
    left_norm = left.groupBy("key").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    right_norm = right.groupBy("template").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("other_norm"))
    known = right.join(right_norm, "template").join(_templates(spark).select("template", "licence"), "template")
    # The templates are a fixed list.
    dots = (
        left.join(F.broadcast(known.select("template", "licence", "term", F.col("value").alias("other_value"), "other_norm")), "term")
        .groupBy("key", "template", "licence", "other_norm")
        .agg(F.sum(F.col("value") * F.col("other_value")).alias("dot"))
    )
    scored = dots.join(left_norm, "key").select(
        "key", "licence", "template", F.round(F.col("dot") / (F.col("norm") * F.col("other_norm")), 6).alias("score")
    )
    best = scored.groupBy("key").agg(F.max(F.struct("score", -F.col("template"), "licence")).alias("best"))
    best = best.select("key", "best.licence", "best.score").filter(F.col("score") >= minimum)
    first = told.select("path", "key").join(best, "key").groupBy("path").agg(F.max(F.struct("score", "licence")).alias("own"))
    return first.select("path", "own.licence", "own.score")


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """(depth, path) of a directory and of all above it, the root as ''."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above")),
    )


def licences(files: DataFrame, minimum: float = MINIMUM, keep: Sequence[str] = ()) -> DataFrame:
    """The licence of every file: ``path``, ``licence``, ``score``, ``origin``, ``inherited_from``, and the columns to ``keep``.

    ``files`` has ``path``, ``text`` and ``is_licence_file``; other columns are ignored unless kept. ``origin`` is
    ``own``, ``inherited`` (from a licence file of the nearest directory at or above that of the file)
    or ``none``, with NULL licence. Of several licence files in a directory the best score counts, then
    the last name of a licence. A NULL or empty text has no licence of its own; a NULL path is in no
    directory and inherits nothing. Repeated rows get equal rows; an empty table gives an empty result.
    """
    carried = F.struct(*keep) if keep else F.lit(None)
    rows = files.select(
        "path", directory(F.col("path")).alias("folder"), F.coalesce("is_licence_file", F.lit(False)).alias("file"), carried.alias("carried")
    )
    own = materialize(own_licences(files.select("path", "text", "is_licence_file"), minimum), "own-licences")
    found = rows.join(own.withColumnRenamed("path", "_path"), F.col("path") == F.col("_path"), "left").drop("_path")
    sources = found.filter("file AND licence IS NOT NULL").groupBy("folder").agg(F.max(F.struct("score", "licence")).alias("rule"))
    folders = rows.filter("folder IS NOT NULL").select("folder").distinct()
    climbed = folders.select("folder", F.explode(ancestors(F.col("folder"))).alias("step")).select("folder", "step.depth", "step.above")
    nearest = (
        climbed.join(sources.select(F.array_join(F.filter(F.split("folder", "/"), lambda p: p != ""), "/").alias("above"), "rule"), "above")
        .groupBy("folder")
        .agg(F.max(F.struct("depth", "rule", "above")).alias("near"))
        .select(F.col("folder").alias("_folder"), F.col("near.rule").alias("rule"), F.col("near.above").alias("above"))
    )
    met = found.join(nearest, F.col("folder") == F.col("_folder"), "left")
    has_own = F.col("licence").isNotNull()
    return met.select(
        "path",
        F.coalesce("licence", "rule.licence").alias("licence"),
        F.coalesce("score", "rule.score").alias("score"),
        F.when(has_own, "own").when(F.col("rule").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~has_own, F.col("above")).alias("inherited_from"),
        *[F.col(f"carried.{c}").alias(c) for c in keep],
    )
