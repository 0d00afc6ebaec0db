"""Licence scans: sparse TF-IDF cosine to licence texts and notices, then inheritance from the nearest ancestor directory.

Whole texts are scanned. What is compared are the units of a text: each line, sentence, paragraph and block of adjacent
comment lines, and the whole text, which is the licence file as a whole. A unit's vector holds its counts of template words times
idf, where idf counts the documents of the corpus; each of its other words adds 1, the least idf, to the squared norm. The
template of greatest cosine names the unit's licence if the cosine is LEAST or more; of a text's units the one with most
weight in its template's direction counts, and one that names no licence only where no other does. Units that can't reach LEAST aren't built: by Cauchy's inequality, a unit that does holds one of
the template's rarer words, if the frequent ones that are left out carry less than LEAST of its norm.

A document of which the best unit makes up FILE_SHARE of the words or more, or whose name says so, is a licence file: it
speaks for its directory. Documents without a licence of their own inherit from the nearest ancestor directory (their own
included): directories are joined once each to the licence of each of their ancestors, and the deepest wins.

All of this is DataFrame and SQL functions. The templates and their words are a fixed list of some hundred words. Rows per
document: the words of the units that may reach LEAST.

Edge cases: null and empty texts have no unit and may inherit; ties between templates go to the first of them, between
units of equal weight to the longest, between licence files of a directory to the least path; a null path is the root; rows of equal id
and text get equal results; other columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Notices and licence texts, or telling paragraphs of long ones, by SPDX name.
WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
APACHE_HEADER = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
APACHE_TERMS = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
GPL_HEADER = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", APACHE_HEADER),
    ("Apache-2.0", f"{APACHE_HEADER} {APACHE_TERMS}"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("Apache-2.0", "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", BSD_GRANT),
    ("BSD-2-Clause", f"{BSD_GRANT} {BSD_AS_IS}"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", f"{BSD_GRANT} {BSD_NAMES}"),
    ("BSD-3-Clause", f"{BSD_GRANT} {BSD_NAMES} {BSD_AS_IS}"),
    ("BSD-3-Clause", BSD_NAMES),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", GPL_HEADER.format("General", 2)),
    ("GPL-2.0", f"{GPL_HEADER.format('General', 2)} {WARRANTY}"),
    ("GPL-2.0", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", GPL_HEADER.format("General", 3)),
    ("GPL-3.0", f"{GPL_HEADER.format('General', 3)} {WARRANTY}"),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("ISC", "Released under the ISC License."),
    ("ISC", ISC_GRANT),
    ("ISC", f"{ISC_GRANT} {ISC_AS_IS}"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", GPL_HEADER.format("Lesser General", 3)),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", MIT_GRANT),
    ("MIT", f"{MIT_GRANT} {AS_IS}"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain under the Unlicense."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely."),
    ("Zlib", "SPDX-License-Identifier: Zlib"),
    ("Other", "SPDX-License-Identifier:"),
    ("Other", "Licensed under the License."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright (c) All rights reserved."),
]
#: What names no licence.
VAGUE = ("Other", "Proprietary")
LEAST, FILE_SHARE = 0.7, 0.1
NAMED = r"(?i)^(licen[sc]e|copying|notice|unlicense)(\..*)?$"

WORD = "[a-z0-9]+"
#: Lines without a word part paragraphs; sentences end there too. What begins a comment line.
BLANK = r"\n[^a-z0-9\n]*\n"
STOP = BLANK + r"|[.!?;][ \t\n]+"
COMMENT = r"^[ \t]*(#|//|/\*|\*|--|;|%)"


def template_terms() -> list[tuple[int, str, str, int]]:
    """(number, licence, word, count) of the templates."""
    out = []
    for n, (name, text) in enumerate(TEMPLATES):
        words = re.findall(WORD, text.lower())
        out += [(n, name, w, words.count(w)) for w in sorted(set(words))]
    return out


def vocabulary() -> list[str]:
    return sorted({w for _, _, w, _ in template_terms()})


def telling(weights: list[tuple[int, str, float, float]]) -> list[str]:
    """Words one of which a unit must hold to reach LEAST with any template. weights: (template, word, weight, idf).

    What a template may do without is taken from its most frequent words, so that few units hold one of the others.
    """
    of: dict[int, list[tuple[float, str, float]]] = defaultdict(list)
    for t, word, w, idf in weights:
        of[t].append((idf, word, w))
    out = set()
    for words in of.values():
        left = (LEAST - 1e-3) ** 2 * sum(w * w for _, _, w in words)
        for _, word, w in sorted(words):
            left -= w * w
            if left < 0:
                out.add(word)
    return sorted(out)


def units_of(text: Column) -> Column:
    """Lines, sentences, paragraphs, comment blocks and the whole of a text in lower case."""
    lines = F.split(text, "\n", -1)
    remarks = F.array_join(F.transform(lines, lambda x: F.when(x.rlike(COMMENT), x).otherwise("")), "\n")
    return F.concat(lines, F.split(text, STOP, -1), F.split(text, BLANK, -1), F.split(remarks, BLANK, -1), F.array(text))


def scan(files: DataFrame) -> DataFrame:
    """files (doc_id, path, text) with licence, score, origin and licence_dir for every row."""
    spark = files.sparkSession
    strings = lambda words: F.array(*[F.lit(w) for w in words])
    words = lambda c: F.regexp_extract_all(c, F.lit(WORD), F.lit(0))
    rows = files.select(files["doc_id"].cast("long").alias("doc_id"), F.coalesce(files["path"], F.lit("/")).alias("path"), F.xxhash64("text").alias("h"), F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("body"))
    # A word of each document and one mark for the document itself.
    counted = rows.select(F.explode(F.array_append(F.array_intersect(words(F.col("body")), strings(vocabulary())), F.lit(""))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    df = {r["word"]: r["df"] for r in counted.collect()}  # template words only
    terms = spark.createDataFrame(template_terms(), "t int, licence string, word string, tf int")
    idf = spark.createDataFrame([(w, df.get("", 0) + 1.0, df.get(w, 0) + 1.0) for w in vocabulary()], "word string, docs double, df double").select("word", (F.log(F.col("docs") / F.col("df")) + 1.0).alias("idf"))
    weights = materialize(terms.join(F.broadcast(idf), "word").select("t", "licence", "word", (F.col("tf") * F.col("idf")).alias("w"), "idf"), "licences-weights")
    norms = weights.groupBy("t").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm_t"))
    idfs = weights.select("word", "idf").distinct()
    keys = strings(telling([(r["t"], r["word"], r["w"], r["idf"]) for r in weights.collect()]))

    may = rows.withColumn("words", words(F.col("body"))).filter(F.arrays_overlap("words", keys)).select("doc_id", "h", F.size("words").alias("n_words"), F.posexplode(units_of(F.col("body"))).alias("c", "unit"))
    may = may.withColumn("words", words(F.col("unit"))).filter(F.arrays_overlap("words", keys))
    each = may.select("doc_id", "h", "n_words", "c", F.size("words").alias("length"), F.explode("words").alias("word")).join(F.broadcast(idfs), "word", "left")
    unit = ["doc_id", "h", "n_words", "c", "length"]
    # Words outside the templates are one row of a unit. Equal rows multiply all counts of their units alike.
    parts = each.withColumn("word", F.when(F.col("idf").isNotNull(), F.col("word"))).groupBy(*unit, "word", "idf").agg(F.count("*").alias("tf"))
    w_c = F.col("tf") * F.col("idf")
    others = F.sum(F.when(F.col("idf").isNull(), F.col("tf")).otherwise(0))
    norm = F.sqrt(F.sum(w_c * w_c) + others * F.sum("tf") / F.col("length"))
    # One row for each unit: what follows up to its best template needs no other exchange.
    vectors = parts.groupBy(*unit).agg(norm.alias("norm_c"), F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("word", w_c.alias("w_c")))).alias("v"))
    dots = vectors.select(*unit, "norm_c", F.explode("v").alias("v")).select(*unit, "norm_c", "v.*").join(F.broadcast(weights.drop("idf")), "word")
    dots = dots.groupBy(*unit, "norm_c", "t", "licence").agg(F.sum(F.col("w_c") * F.col("w")).alias("dot"))
    scored = dots.join(F.broadcast(norms), "t")
    scored = scored.withColumn("score", F.round(F.col("dot") / (F.col("norm_c") * F.col("norm_t")), 4)).filter(F.col("score") >= LEAST)
    scored = scored.withColumn("weight", F.round(F.col("dot") / F.col("norm_t"), 4))
    named = scored.groupBy(*unit).agg(F.max_by(F.struct("licence", "score", "weight", "t"), F.struct("score", -F.col("t"))).alias("u")).select(*unit, "u.*")
    rank = F.struct(~F.col("licence").isin(*VAGUE), "weight", -F.col("t"), "length")
    best = named.groupBy("doc_id", "h").agg(F.max_by(F.struct("licence", "score", "length", "n_words"), rank).alias("b"))
    best = best.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), F.col("b.licence").alias("own"), F.col("b.score").alias("score"), (F.col("b.length") / F.col("b.n_words")).alias("share"))

    found = rows.drop("body").join(best, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")), "left").drop("_d", "_h")
    found = found.withColumn("dir", F.regexp_replace("path", "/[^/]*$", "")).withColumn("name", F.regexp_extract("path", "[^/]*$", 0))
    found = materialize(found.withColumn("speaks", F.col("own").isNotNull() & ((F.col("share") >= FILE_SHARE) | F.col("name").rlike(NAMED))), "licences-found")
    spoken = found.filter("speaks").groupBy("dir").agg(F.min_by("own", "path").alias("dir_licence"))
    dirs = found.select("dir").distinct()
    up = dirs.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(F.split("dir", "/"))))).withColumn("above", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/"))
    near = up.join(spoken.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max_by(F.struct("dir_licence", "above"), F.col("depth")).alias("n"))
    out = found.join(near, "dir", "left")
    origin = F.when(F.col("speaks"), "file").when(F.col("own").isNotNull(), "header").when(F.col("n").isNotNull(), "inherited").otherwise("none")
    return out.select("doc_id", "path", F.coalesce("own", F.col("n.dir_licence")).alias("licence"), F.coalesce("score", F.lit(0.0)).alias("score"), origin.alias("origin"), F.when(F.col("own").isNull(), F.col("n.above")).alias("licence_dir"))


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: a directory for each source, language and 64 ids."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))
    return docs.select("doc_id", F.concat(F.lit("/"), F.coalesce("source", F.lit("_")), F.lit("/"), F.coalesce("lang", F.lit("_")), F.lit("/"), F.expr("coalesce(cast(doc_id as long), -1) div 64").cast("string"), F.lit("/"), doc.cast("string")).alias("path"), "text")


def oracle() -> str:
    """The same in DuckDB's SQL over documents; all units of all documents are compared."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({t}, {quote(n)}, {quote(w)}, {c})" for t, n, w, c in template_terms())
    known = "[" + ", ".join(quote(w) for w in vocabulary()) + "]"
    vague = ", ".join(map(quote, VAGUE))
    return f"""
WITH terms(t, licence, word, tf) AS (VALUES {values}),
docs AS (SELECT row_number() OVER () AS r, doc_id, '/' || coalesce(source, '_') || '/' || coalesce(lang, '_') || '/' || (coalesce(doc_id, -1) // 64) || '/' || coalesce(doc_id, -1) AS path, lower(coalesce(text, '')) AS body FROM documents),
worded AS (SELECT r, body, string_split(body, chr(10)) AS lines, regexp_extract_all(body, '{WORD}') AS words FROM docs),
counted AS (SELECT word, count(*) AS df FROM (SELECT unnest(list_intersect(list_distinct(words), {known})) AS word FROM worded) GROUP BY word),
idfs AS (SELECT v.word, ln(((SELECT count(*) FROM docs) + 1.0) / (coalesce(df, 0) + 1.0)) + 1.0 AS idf FROM (SELECT DISTINCT word FROM terms) v LEFT JOIN counted USING (word)),
weights AS (SELECT t, licence, word, tf * idf AS w FROM terms JOIN idfs USING (word)),
norms AS (SELECT t, sqrt(sum(w * w)) AS norm_t FROM weights GROUP BY t),
remarked AS (SELECT *, array_to_string(list_transform(lines, lambda x: CASE WHEN regexp_matches(x, '{COMMENT}') THEN x ELSE '' END), chr(10)) AS remarks FROM worded),
pieces AS (SELECT r, len(words) AS n_words, unnest(lines || string_split_regex(body, '{STOP}') || string_split_regex(body, '{BLANK}') || string_split_regex(remarks, '{BLANK}') || [body]) AS unit FROM remarked),
units AS (SELECT row_number() OVER () AS c, r, n_words, regexp_extract_all(unit, '{WORD}') AS words FROM pieces),
parts AS (SELECT c, word, idf, count(*) AS tf FROM (SELECT c, unnest(words) AS word FROM units) LEFT JOIN idfs USING (word) GROUP BY ALL),
sizes AS (SELECT c, sqrt(sum(CASE WHEN idf IS NULL THEN tf ELSE tf * idf * tf * idf END)) AS norm_c FROM parts GROUP BY c),
dots AS (SELECT c, t, licence, sum(tf * idf * w) AS dot FROM parts JOIN weights USING (word) GROUP BY ALL),
scored AS (SELECT c, r, n_words, len(words) AS length, t, licence, round(dot / (norm_c * norm_t), 4) AS score, round(dot / norm_t, 4) AS weight FROM dots JOIN sizes USING (c) JOIN norms USING (t) JOIN units USING (c)),
named AS (SELECT * FROM scored WHERE score >= {LEAST} QUALIFY row_number() OVER (PARTITION BY c ORDER BY score DESC, t) = 1),
best AS (SELECT r, licence AS own, score, length / n_words AS share FROM named QUALIFY row_number() OVER (PARTITION BY r ORDER BY licence IN ({vague}), weight DESC, t, length DESC) = 1),
found AS (
  SELECT d.r, doc_id, path, own, score, regexp_replace(path, '/[^/]*$', '') AS dir, own IS NOT NULL AND share >= {FILE_SHARE} AS speaks
  FROM docs d LEFT JOIN best b USING (r)),
spoken AS (SELECT dir, arg_min(own, path) AS dir_licence FROM found WHERE speaks GROUP BY dir),
up AS (SELECT dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS depth FROM (SELECT DISTINCT dir FROM found)),
near AS (
  SELECT u.dir, dir_licence, above FROM (SELECT dir, depth, array_to_string(string_split(dir, '/')[1:depth], '/') AS above FROM up) u
  JOIN spoken s ON s.dir = u.above QUALIFY row_number() OVER (PARTITION BY u.dir ORDER BY depth DESC) = 1)
SELECT doc_id, path, coalesce(own, dir_licence) AS licence, coalesce(score, 0.0) AS score,
  CASE WHEN speaks THEN 'file' WHEN own IS NOT NULL THEN 'header' WHEN dir_licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN own IS NULL THEN above END AS licence_dir
FROM found LEFT JOIN near USING (dir)
"""
