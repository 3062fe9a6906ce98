"""Licence scan of files: TF-IDF cosine of notices and licence files to templates, and inheritance by directory.

Lines, sentences and blocks (runs of paragraphs or of comment lines) that hold a word of licences are notices; equal ones
are scored once. A licence file (by its name) is scored by its whole text too. A file without a licence of its own takes that of the nearest directory above it that
holds a licence file. Everything is DataFrame operations: a text's words are rows that stay where the text lies, cosines
are sums over a join with the words of the templates, which are few and broadcast, and directories are joined to the
ancestors of the distinct directories that need one.
"""

from __future__ import annotations

from importlib.resources import files as resources

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strataframe.plans.storage import materialise

# fixed values: usual notices by licence
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Use of this source code is governed by the BSD 2-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
)

_GNU = (
    "This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name}General Public License"
    " as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."
)
_CREATIVE = "This work is licensed under {a} Creative Commons {kind} 4.0 International License."
_VIEW = " To view a copy of this license, visit http://creativecommons.org/licenses/{code}/4.0/"
_LETTER = " or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."
_KINDS = (
    ("CC-BY-4.0", "a", "Attribution", "by"),
    ("CC-BY-NC-4.0", "a", "Attribution-NonCommercial", "by-nc"),
    ("CC-BY-SA-4.0", "a", "Attribution-ShareAlike", "by-sa"),
)
# fixed values: the standard notices for file headers, as the licences word them
HEADERS = (
    ("AGPL-3.0", _GNU.format(what="program", name="Affero ", version="3")),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
        " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to"
        ' in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,'
        " either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-2.0", _GNU.format(what="program", name="", version="2")),
    ("GPL-3.0", _GNU.format(what="program", name="", version="3")),
    ("LGPL-2.1", _GNU.format(what="library", name="Lesser ", version="2.1")),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
        " If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    *((n, _CREATIVE.format(a=a, kind=k)) for n, a, k, _ in _KINDS),
    *((n, _CREATIVE.format(a=a, kind=k) + _VIEW.format(code=c)) for n, a, k, c in _KINDS),
    *((n, _CREATIVE.format(a=a, kind=k) + _VIEW.format(code=c) + _LETTER) for n, a, k, c in _KINDS),
    *((n, f"Creative Commons {k} 4.0 International Public License") for n, _, k, _ in _KINDS),  # the title of the whole text
)
# whole texts, in licence_texts/NAME.txt, without copyright lines
TEXTS = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "MIT", "MPL-2.0")
RESERVED = "Proprietary"  # many licence texts begin by reserving all rights, so any licence comes before it

CUE = r"(?i)licen[sc]e|all rights reserved|public domain"
#: Every template holds one of these words (tested).
WORDING = r"(?i)licen[sc]|rights reserved|public domain|copyright|redistribut|permission|permitted|warrant|creative commons"
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"
WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
LINE, SENTENCE = r"\n", r"\n|(?<=[.!?])[ \t]+"
MARKED = r"[ \t]*(?:#|//|/?\*|;|--|%|<!--|\.\.|\"\"\")"
LEFT_COMMENT = rf"(?m)^({MARKED}[^\n]*)\n(?!{MARKED})"  # a comment line before one that is none
WORDLESS = r"\n(?:[^\p{L}\p{N}\n]*\n)+"
BLOCK = 8  # paragraphs: the longest header template (BSD) has five, copyright lines and a title come before it
MIN_COSINE = 0.8


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def all_templates() -> list[tuple[str, str]]:
    """Short notices, standard headers and whole texts; several of a licence."""
    folder = resources("strataframe.llm") / "licence_texts"
    return [*TEMPLATES, *HEADERS, *((n, (folder / f"{n}.txt").read_text(encoding="utf-8")) for n in TEXTS)]


def blocks(text: Column) -> Column:
    """Runs of up to ``BLOCK`` paragraphs, and the sentences of paragraphs over their line breaks, with words of licences.

    A run begins and ends with a paragraph that holds such a word, as every header does.
    """
    paragraphs = F.split(F.regexp_replace(text, LEFT_COMMENT, "$1\n\n"), WORDLESS)
    spoken = F.filter(F.transform(paragraphs, lambda p, i: F.when(p.rlike(WORDING), i + 1)), lambda i: i.isNotNull())
    runs = F.flatten(
        F.transform(
            spoken,
            lambda i: F.transform(F.filter(spoken, lambda k: k.between(i, i + BLOCK - 1)), lambda k: F.array_join(F.slice(paragraphs, i, k - i + 1), "\n")),
        )
    )
    sentences = F.flatten(F.transform(F.filter(paragraphs, lambda p: p.rlike(WORDING)), lambda p: F.split(p, r"(?<=[.!?])\s+")))
    return F.array_union(runs, F.filter(sentences, lambda x: x.rlike(WORDING)))


def template_vectors(spark: SparkSession, templates=None) -> DataFrame:
    templates = all_templates() if templates is None else templates
    return spark.createDataFrame(list(templates), "licence string, notice string")


def template_words(templates: DataFrame) -> DataFrame:
    """(word, idf, known): each word of the templates, and where it occurs as (template, licence, unit weight). Stored.

    A word's rarity counts templates alone, so that a file's licence does not depend on what other files are scanned;
    :func:`unknown_rarity` is that of any other word.
    """
    names = templates.select("licence", "notice", F.concat_ws(" ", F.sha2("notice", 256), "licence").alias("template")).distinct()
    counts = names.select("template", "licence", F.explode(_words(F.col("notice"))).alias("word")).groupBy("template", "licence", "word").agg(F.count("*").alias("tf"))
    total = names.agg(F.count("*").alias("n")).scalar()
    rarity = counts.groupBy("word").agg((F.log((total + 1) / (F.count("*") + 1)) + 1).alias("idf"))
    weighted = counts.join(rarity, "word").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighted.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    units = weighted.join(norms, "template").select("word", "idf", F.struct("template", "licence", (F.col("w") / F.col("norm")).alias("u")).alias("k"))
    return materialise(units.groupBy("word", "idf").agg(F.collect_list("k").alias("known")), "template_words")


def unknown_rarity(templates: DataFrame) -> Column:
    """The rarity of a word that no template holds."""
    return templates.distinct().agg((F.log(F.count("*") + 1) + 1).alias("idf")).scalar()


def cosines(texts: DataFrame, templates: DataFrame) -> DataFrame:
    """(text_id, licence, cosine) for the best template of each distinct text (text_id, content).

    A licence may have several templates. Ties go to the licence first by name. Where ``texts`` comes clustered by
    text_id, a text's words are counted, weighed and summed where the text lies: the templates' words, which depend on
    the templates alone, are broadcast, and no word is shuffled.
    """
    words = texts.select("text_id", F.explode(_words(F.col("content"))).alias("word")).groupBy("text_id", "word").agg(F.count("*").alias("tf"))
    met = words.join(F.broadcast(template_words(templates)), "word", "left")
    weight = F.col("tf") * F.coalesce("idf", unknown_rarity(templates))
    own = F.struct(F.lit(None).cast("string").alias("template"), F.lit(None).cast("string").alias("licence"), F.col("w").alias("u"))
    parts = met.withColumn("w", weight).select("text_id", "w", F.explode(F.concat(F.array(own), F.coalesce("known", F.array()))).alias("k"))
    dots = parts.groupBy("text_id", "k.template", "k.licence").agg(F.sum(F.col("w") * F.col("k.u")).alias("dot"))  # of no template: the squares
    per_text = dots.groupBy("text_id").agg(
        F.sqrt(F.max(F.when(F.col("template").isNull(), F.col("dot")))).alias("norm"),
        F.min(F.when(F.col("template").isNotNull(), F.struct((-F.round("dot", 12)).alias("d"), "licence", "dot"))).alias("b"),
    )
    cosine = F.round(F.col("b.dot") / F.col("norm"), 6)
    return per_text.filter("b is not null").select("text_id", cosine.alias("cosine"), F.col("b.licence").alias("licence"))


def licence_scan(files: DataFrame, templates: DataFrame | None = None, min_cosine: float = MIN_COSINE) -> DataFrame:
    """One row per file: doc_id, path, licence, cosine, origin.

    ``files``: doc_id, path (``/`` between directories), text. origin is ``own`` (a notice in the file, or the whole
    text of a licence file, has a cosine of ``min_cosine`` or more to a template; any licence before a mere reservation
    of all rights, then the highest cosine, then the licence first by name), ``inherited`` (from the nearest ancestor directory with a licence file; of several there, the
    licence first by name) or ``none``. A null or empty text has no notice; a null path lies in no directory and
    passes nothing on. Repeated rows get equal results; an empty table gives no rows.
    """
    spark = files.sparkSession
    templates = template_vectors(spark) if templates is None else templates
    text = F.coalesce("text", F.lit(""))
    named = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    lines = F.filter(F.array_union(F.split(text, LINE), F.split(text, SENTENCE)), lambda x: x.rlike(WORDING))
    pieces = F.array_union(lines, blocks(text))
    notices = F.array_distinct(F.when(named, F.array_append(pieces, text)).otherwise(pieces))
    rows = files.filter(named | text.rlike(WORDING)).select("doc_id", "path", F.explode(notices).alias("content"))
    rows = materialise(rows.withColumn("text_id", F.sha2("content", 256)), "notices")
    texts = rows.groupBy("text_id").agg(F.first("content").alias("content"))
    found = materialise(cosines(texts, templates).filter(F.col("cosine") >= min_cosine), "found")

    matched = rows.select("doc_id", "path", "text_id").join(found, "text_id")
    best = matched.groupBy("doc_id", "path").agg(F.min(F.struct((F.col("licence") == RESERVED).alias("r"), (-F.col("cosine")).alias("c"), "licence")).alias("b"))
    own = materialise(best.select("doc_id", "path", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine")), "own")

    directory = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    granting = own.filter(F.col("path").rlike(LICENCE_FILE)).groupBy(directory.alias("_dir")).agg(F.min("licence").alias("_granted"))
    places = files.filter("path is not null").select(directory.alias("_at")).distinct()
    parts = F.split("_at", "/")
    above = places.select(
        "_at", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    )
    nearest = above.join(granting, F.col("col") == F.col("_dir")).groupBy("_at").agg(F.max_by("_granted", "pos").alias("_granted"))
    nearest = materialise(nearest, "nearest")  # directories with a licence: their size, known now, decides on a broadcast

    own = own.select(F.col("doc_id").alias("_id"), F.col("path").alias("_path"), "licence", "cosine")
    out = files.select("doc_id", "path", directory.alias("_place")).join(
        own, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("path").eqNullSafe(F.col("_path")), "left"
    )
    out = out.join(nearest, F.col("_place") == F.col("_at"), "left")
    origin = F.when(F.col("licence").isNotNull(), "own").when(F.col("_granted").isNotNull(), "inherited").otherwise("none")
    return out.select("doc_id", "path", F.coalesce("licence", "_granted").alias("licence"), "cosine", origin.alias("origin"))
