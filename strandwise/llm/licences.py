"""Licence scans: TF-IDF cosine of statements and licence files to templates, then inheritance by directory; DataFrame functions only."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Collection, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

#: Statements, headers and texts of common licences: the licence, the text, and terms without which a text isn't this one, if any. More may be given.
TEMPLATES = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "affero 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.', "apache 2.0"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 2-Clause License.", "bsd 2"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.", "bsd 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "neither"),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0, Creative Commons Attribution.", "cc by 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "attribution 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "by nc 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "noncommercial 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "sharealike 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal, Public Domain Dedication.", "cc0"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "general 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "general 3"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3.", "lesser 3"),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.", "lesser 3"),
    ("MIT", "Released under the MIT License.", "mit"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MPL-2.0", "This file is subject to the Mozilla Public License, version 2.0.", "mozilla 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "mozilla 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited."),
    ("Artistic-1.0", "The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of the package, while giving the users of the package the right to use and distribute the Package in a more-or-less customary fashion, plus the right to make reasonable modifications.", "artistic"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "redistributions"),
    ("CC0-1.0", 'The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s) (each and all, an "owner") of an original work of authorship and/or a database (each, a "Work").', "jurisdictions"),
    ("GFDL-1.2", 'Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.2 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts. A copy of the license is included in the section entitled "GNU Free Documentation License".', "documentation 1.2"),
    ("GFDL-1.3", 'Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts. A copy of the license is included in the section entitled "GNU Free Documentation License".', "documentation 1.3"),
    ("GPL-1.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version.", "general 1"),
    ("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "library 2"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "lesser 2.1"),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.", "lesser 3"),
    ("MPL-1.1", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/ Software distributed under the License is distributed on an "AS IS" basis, WITHOUT WARRANTY OF ANY KIND, either express or implied. See the License for the specific language governing rights and limitations under the License.', "mozilla 1.1"),
)
#: Names of licence files, and endings of files that can hold a licence for others.
LICENCE_NAME, PLAIN_NAME = r"(?i)(^|/)(un)?(licen[cs]e|copying|copyright|notice)[^/]*$", r"(?i)(^|/)[^/.]*(\.(txt|md|rst|html?))?$"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
#: A template of so many terms is a text that stands for itself; a shorter one decides only where none of these is found.
LONG = 25
#: "All rights reserved" that ends a copyright notice says nothing of the licence.
NOTICE = r"(?i)(copyright[^\r\n]*?(?:\r?\n[^A-Za-z0-9\r\n]*)?)\ball rights reserved\b\.?"
#: A tag that names a licence, and what may follow the name of a version.
SPDX, SPDX_TAIL = r"(?i)SPDX-License-Identifier:\s*\(?([A-Za-z0-9.+-]+)", r"(?i)(-only|-or-later|\+)$"


def terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def weights(idf: Mapping[str, float], texts: Sequence[str]) -> list[dict[str, float]]:
    """Each template as a unit vector of TF-IDF."""
    out = []
    for text in texts:
        v = {t: n * idf[t] for t, n in sorted(Counter(terms(text)).items())}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append({t: x / norm for t, x in v.items()})
    return out


def telling(vectors: Sequence[Mapping[str, float]], idf: Mapping[str, float], threshold: float, there: Collection[str]) -> list[str]:
    """Terms without one of which no text reaches the threshold; `there` are the terms that occur in any text.

    A text's cosine with a template is at most the norm of the template's vector over the terms they share. So the terms
    of each template are added, the heaviest first, until those that are left have a norm below the threshold.
    """
    out: set[str] = set()
    for v in vectors:
        rest = sorted((t for t in v if t in there), key=lambda t: (-idf[t], t))
        while rest and math.sqrt(sum(v[t] ** 2 for t in rest)) >= threshold * (1 - 1e-9):
            out.add(rest.pop(0))
    return sorted(out)


def _literal(values: Mapping[str, float | str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def scan(docs: DataFrame, path: Column, templates: Sequence[tuple[str, ...]] = TEMPLATES, threshold: float = 0.75, file_threshold: float = 0.6) -> DataFrame:
    """One row per document: doc_id, path, licence, score, basis, from_dir, statement, licence_file.

    Texts and templates are vectors of TF-IDF over all their words. Document frequencies of the templates' terms are counted over all
    whole texts; words outside the templates have the mean weight of the templates' terms. The units of a
    text are its lines, its paragraphs (headers may be wrapped; marks of comments are no words) and the whole text; "all rights reserved" after a
    copyright isn't part of any. A unit is compared with the templates whose needed terms (versions, names) it has. One whose cosine
    with a template is `threshold` or more is a statement. A document's best one gives its licence (basis
    `statement`): one of a template of LONG terms before any other, then by score of nine digits (ties: the first template by licence and place); before all
    of them comes an SPDX tag that names a template's licence, with score 1. A file that is named as one is a licence file if
    its best paragraph or the whole text reaches `file_threshold`; another one whose name has no ending, or that of a
    plain text, if its whole text reaches `threshold`. It declares the licence of its directory; of several, the best in the same order, then the first
    licence. A document without a statement takes
    the licence of the nearest of its directories, its own first, that has one (basis `inherited`). Directories, which are far fewer
    than documents, are resolved first; documents are then joined by their directory.

    Units without a telling term (see `telling`) can't reach a threshold and aren't scored.

    Edge cases: a null text has no statement; a null path has no directory, and inherits nothing; ids and rows may repeat; a text of several
    licences has the best one; an empty table gives no rows; templates must hold a term each; other columns are not read.
    """
    templates = sorted(templates, key=lambda t: t[0])
    vocabulary = sorted({t for _, text, *_ in templates for t in terms(text)})
    rows = docs.select("doc_id", path.alias("path"), F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), NOTICE, "$1").alias("text"))
    total = rows.count()
    present = rows.select(F.explode(F.array_intersect(_terms(F.col("text")), F.array(*map(F.lit, vocabulary)))).alias("term"))
    counted = {r.term: r["count"] for r in present.groupBy("term").count().collect()}  # a row a term of the templates
    idf = {t: math.log((1 + total) / (1 + counted.get(t, 0))) + 1 for t in vocabulary}
    other = sum(idf.values()) / len(idf)
    vectors = weights(idf, [text for _, text, *_ in templates])
    low = min(threshold, file_threshold)
    tell = {limit: telling(vectors, idf, limit, counted) for limit in (threshold, low)}

    def hint(x: Column, limit: float) -> Column:
        """Whether a line or paragraph has a telling term."""
        return x.rlike(r"(?i)(?<![a-z0-9.])(?:" + "|".join(map(re.escape, tell[limit])) + r")(?![a-z0-9])") if tell[limit] else F.lit(False)

    by_term = _literal(idf)

    def weighed(words: Column) -> Column:
        """The distinct terms and their weights."""
        return F.transform(F.array_sort(F.array_distinct(words)), lambda t: F.struct(t.alias("t"), (F.size(F.filter(words, lambda u: u == t)) * by_term[t]).alias("x")))

    def squares(words: Column) -> Column:
        """The sum of the squared frequencies of words, by runs of equal ones."""
        none = F.struct(F.lit("").alias("word"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

        def step(a: Column, word: Column) -> Column:
            run = F.when(word == a["word"], a["run"]).otherwise(0.0)
            return F.struct(word.alias("word"), (run + 1.0).alias("run"), (a["sum"] + 2.0 * run + 1.0).alias("sum"))

        return F.aggregate(F.array_sort(words), none, step)["sum"]

    def best(own: Column, outside: Column) -> Column:
        """The best cosine and its template, as a struct that sorts by cosine (ties: the first template)."""
        norm = F.sqrt(F.aggregate(own, outside * other * other, lambda a, e: a + e["x"] * e["x"]))

        def against(k: int) -> Column:
            v = _literal(vectors[k])
            dot = F.aggregate(own, F.lit(0.0), lambda a, e: a + e["x"] * F.coalesce(v[e["t"]], F.lit(0.0)))
            has = lambda t: F.exists(own, lambda e: e["t"] == t)
            needs = [has(t) for t in " ".join(templates[k][2:]).split()]
            score = F.when(reduce(Column.__and__, needs, F.lit(True)), dot / norm).otherwise(0.0)
            return F.struct(score.alias("score"), F.lit(-k).alias("place"), F.lit(templates[k][0]).alias("name"), F.lit(len(terms(templates[k][1])) >= LONG).alias("long"))

        return F.when(F.size(own) > 0, F.array_max(F.array(*(against(k) for k in range(len(templates))))))

    known = F.array(*map(F.lit, vocabulary))
    words = lambda terms_: F.filter(terms_, lambda t: F.array_contains(known, t))
    lines = F.filter(F.split("text", "[\r\n]+"), lambda x: hint(x, threshold))
    paragraphs = F.filter(F.split("text", r"\r?\n[^A-Za-z0-9\r\n]*\r?\n"), lambda x: hint(x, low) & (F.instr(x, "\n") > 0))
    # The whole text comes first, then paragraphs, then lines; each step reads what the one before it made.
    kind = lambda units, k: F.transform(units, lambda x: F.struct(x.alias("line"), F.lit(k).alias("kind")))
    units = F.concat(kind(F.array("text"), 0), kind(paragraphs, 1), kind(lines, 2))
    units = F.transform(units, lambda e: F.struct(e["line"].alias("line"), e["kind"].alias("kind"), _terms(e["line"]).alias("all")))
    units = F.transform(units, lambda e: F.struct(e["line"].alias("line"), e["kind"].alias("kind"), words(e["all"]).alias("w"), squares(F.filter(e["all"], lambda t: ~F.array_contains(known, t))).alias("outside")))
    units = F.transform(units, lambda e: F.struct(e["line"].alias("line"), e["kind"].alias("kind"), weighed(e["w"]).alias("own"), e["outside"].alias("outside")))
    units = F.transform(units, lambda e: F.struct(best(e["own"], e["outside"]).alias("b"), e["kind"].alias("kind"), F.when(e["kind"] > 0, e["line"]).alias("line")))
    tags = _literal({name.lower(): name for name, *_ in templates})
    tag = F.try_element_at(tags, F.lower(F.regexp_replace(F.regexp_extract("text", SPDX, 1), SPDX_TAIL, "")))
    marked = rows.select("doc_id", "path", tag.alias("tag"), F.when(F.arrays_overlap(_terms(F.col("text")), F.array(*map(F.lit, tell[low])).cast("array<string>")), units).alias("units"))
    named = F.col("path").rlike(LICENCE_NAME)
    of_file = F.filter("units", lambda e: F.when(named, e["kind"] < 2).otherwise((e["kind"] == 0) & F.col("path").rlike(PLAIN_NAME)))
    in_order = lambda b, limit: F.struct((b["long"] & (b["score"] >= limit)).alias("whole"), F.round(b["score"], 9).alias("score"), b["place"].alias("place"), b["name"].alias("name"))
    own = F.array_max(F.transform("units", lambda e: F.struct(in_order(e["b"], threshold).alias("b"), e["kind"].alias("kind"), e["line"].alias("line"))))
    whole = F.array_max(F.transform(of_file, lambda e: in_order(e["b"], F.when(named, file_threshold).otherwise(threshold))))
    marked = marked.select("doc_id", "path", "tag", own.alias("own"), whole.alias("whole"))
    directory = F.when(F.instr("path", "/") > 0, F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    marked = marked.select(
        "doc_id", "path", "tag", directory.alias("dir"), F.when(F.col("own.b.score") >= threshold, F.col("own")).alias("own"), F.when(F.col("whole.score") >= F.when(named, file_threshold).otherwise(threshold), F.col("whole")).alias("whole"),
    )
    marked = save(marked, "licence-rows")
    declared = marked.filter("whole is not null and dir is not null").groupBy("dir").agg(F.max("whole").alias("w"))
    declared = save(declared.select(F.col("dir").alias("above"), F.col("w.name").alias("declared"), F.col("w.score").alias("strength")), "licence-dirs")
    parts = F.split("dir", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    dirs = marked.filter("dir is not null").select("dir").distinct().select("dir", above.alias("above"))
    nearest = dirs.join(declared, "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("depth"), "above", "declared", "strength")).alias("d"))
    nearest = save(nearest, "licence-nearest")
    out = marked.join(nearest, "dir", "left")
    return out.select(
        "doc_id", "path", F.coalesce("tag", "own.b.name", "d.declared").alias("licence"), F.coalesce(F.when(F.col("tag").isNotNull(), 1.0), "own.b.score", "d.strength").alias("score"),
        F.when(F.col("tag").isNotNull() | F.col("own").isNotNull(), "statement").when(F.col("d").isNotNull(), "inherited").otherwise("none").alias("basis"),
        F.when(F.col("own").isNull() & F.col("tag").isNull(), F.col("d.above")).alias("from_dir"), F.col("own.line").alias("statement"), F.col("whole").isNotNull().alias("licence_file"),
    )
