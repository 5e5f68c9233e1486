"""Licence scans: sparse TF-IDF cosine of lines and whole files to licence templates, then inheritance by path joins.

Only DataFrame functions. Terms are runs of a-z and 0-9 of the lowered text; idf = ln((N + 1) / (df + 1)) + 1 over all N
documents; a licence has several templates. A term that no template has weighs as one that no document has, once for each time it occurs. A line at or
over `header` gives its document a licence, and so does a whole document at or over `file`, or the first OPENING lines of one
whose name says that it is a licence, where no other licence comes within MARGIN. A line with an SPDX identifier outweighs
all that. Only documents whose name says that they are licences license their folder: documents without a licence of their
own take that of their nearest folder upward that has one.

Lines without a rare template term are passed over unread: by Cauchy and Schwarz the cosine of such a line to a template is
at most the share of the template's length that its other terms have, and terms count as rare until that is below both
limits for every template.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, stored

HEADER, FILE, MARGIN = 0.6, 0.4, 0.01
#: A licence stated by its identifiers.
SPDX = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+()-]+(?:[ \t]+(?:AND|OR|WITH)[ \t]+[A-Za-z0-9.+()-]+)*)"

#: Licence notices, full short licences and the openings of long ones, by SPDX name.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software. The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, our General Public Licenses are intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License. "Legal Entity" shall mean the union of the acting entity and all other entities that control, are controlled by, or are under common control with that entity.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "Artistic-2.0": (
        "The Artistic License 2.0 Copyright (c) 2000-2006, The Perl Foundation. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed. The intent is that the Copyright Holder maintains some artistic control over the development of that Package while still keeping the Package available as open source and free software.",
    ),
    "BSD-2-Clause": (
        'BSD 2-Clause License. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License. Redistribution and use in source and binary forms, with or without modification, are permitted.",
        'BSD 3-Clause License. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    "BSL-1.0": (
        'Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "CC-BY-4.0": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
    ),
    "CC0-1.0": (
        'Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP. CREATIVE COMMONS PROVIDES THIS INFORMATION ON AN "AS-IS" BASIS. CREATIVE COMMONS MAKES NO WARRANTIES REGARDING THE USE OF THIS DOCUMENT OR THE INFORMATION OR WORKS PROVIDED HEREUNDER, AND DISCLAIMS LIABILITY FOR DAMAGES RESULTING FROM THE USE OF THIS DOCUMENT OR THE INFORMATION OR WORKS PROVIDED HEREUNDER.',
    ),
    "EPL-2.0": (
        'Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENTS ACCEPTANCE OF THIS AGREEMENT. 1. DEFINITIONS "Contribution" means: a) in the case of the initial Contributor, the initial content Distributed under this Agreement, and b) in the case of each subsequent Contributor: i) changes to the Program, and ii) additions to the Program; where such changes and/or additions to the Program originate from and are Distributed by that particular Contributor.',
    ),
    "GPL-2.0": (
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "ISC": (
        'ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    "LGPL-2.1": (
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. [This is the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1.] Preamble The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public Licenses are intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    ),
    "LGPL-3.0": (
        'GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below. 0. Additional Definitions. As used herein, "this License" refers to version 3 of the GNU Lesser General Public License, and the "GNU GPL" refers to version 3 of the GNU General Public License.',
    ),
    "MIT": (
        "Released under the MIT License.",
        'MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. 1.2. "Contributor Version" means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributors Contribution. 1.3. "Contribution" means Covered Software of a particular Contributor. 1.4. "Covered Software" means Source Code Form to which the initial Contributor has attached the notice in Exhibit A, the Executable Form of such Source Code Form, and Modifications of such Source Code Form.',
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    ),
    "Zlib": (
        'This software is provided "as-is", without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.',
    ),
}
#: Files that state a licence by their name, and the lines of them that are compared with templates on their own.
NAMED, OPENING = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$", 30


def terms(text: str) -> Counter:
    return Counter(re.findall("[a-z0-9]+", text.lower()))


def words(text: Column) -> Column:
    return F.split(F.lower(text), "[^a-z0-9]+")


def flat(templates: dict[str, tuple[str, ...]]) -> list[tuple[str, str]]:
    """(name, text) of each template."""
    return [(name, text) for name, texts in templates.items() for text in texts]


def weights(docs: DataFrame, templates: list[tuple[str, str]]) -> tuple[dict[str, float], float]:
    """idf of each template term, and that of a term no document has."""
    vocabulary = sorted(set().union(*(terms(x) for _, x in templates)))
    found = F.explode_outer(F.array_intersect(words(F.col("text")), F.array(*map(F.lit, vocabulary))))
    rows = {r["term"]: r["n"] for r in docs.select(found.alias("term")).groupBy("term").count().withColumnRenamed("count", "n").collect()}
    n = docs.count()
    return {t: math.log((n + 1) / (rows.get(t, 0) + 1)) + 1 for t in vocabulary}, math.log(n + 1) + 1


def rare_terms(idf: dict[str, float], templates: list[tuple[str, str]], limit: float) -> list[str]:
    """The rarest terms, as many as leave every template less than `limit` of its length without them."""
    vectors = [{t: c * idf[t] for t, c in terms(x).items()} for _, x in templates]
    rare: list[str] = []
    for t in sorted(idf, key=lambda t: (-idf[t], t)):
        if all(sum(w * w for x, w in v.items() if x not in rare) < limit * limit * sum(w * w for w in v.values()) for v in vectors):
            break
        rare.append(t)
    return rare


def license_scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, header: float = HEADER, file: float = FILE) -> DataFrame:
    """doc_id, path, license, score, basis (header, file, inherited, none) of docs (doc_id, path, text).

    The basis is file where the whole document reads as a licence or states one, and its name says so or is null; such a
    named file licenses its folder. score is the cosine, of the licence file where inherited, 1 for an SPDX identifier (the
    first in the document), 0 without licence; of equal cosines the first name wins, of equal licence files in a folder the
    first path. A null or empty text has no licence of its own; a null path inherits and grants nothing. Rows with equal
    doc_id, path and text count once in a folder and all get its result. Texts are read whole, however long. Other columns
    are ignored. An empty table gives no rows.
    """
    spark, templates = docs.sparkSession, flat(templates)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "path", F.coalesce("text", F.lit("")).alias("text"))
    idf, unseen = weights(docs, templates)
    rare = F.array(*map(F.lit, rare_terms(idf, templates, min(header, file))))
    folder = lambda path: F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    # paths are long and stand in every row of the counts below: their hash will do, with the folder of the few that grant
    docs = docs.withColumns({"h": F.xxhash64("text"), "p": F.xxhash64("path"), "up": F.when(F.col("path").rlike(NAMED), folder("path"))})
    key = ["doc_id", "p", "h", "up"]
    lines = docs.where(F.arrays_overlap(words(F.col("text")), rare)).select(*key, F.posexplode(F.split("text", "\n", -1)).alias("line", "words"))
    lines = stored(lines.select(*key, "line", words(F.col("words")).alias("words")).distinct(), "licence-lines")
    settle(spark)
    # one row for each line, one (line -1) for the whole file and one (line -2) for the opening of a file with a telling name
    together = lambda rows, line: rows.groupBy(*key).agg(F.flatten(F.collect_list("words")).alias("words")).select(*key, F.lit(line).alias("line"), "words")
    opening = lines.where((F.col("line") < OPENING) & F.col("up").isNotNull())
    units = lines.where(F.arrays_overlap("words", rare)).union(together(lines, -1)).union(together(opening, -2))
    exploded = units.select(*key, "line", F.explode("words").alias("term")).where("term != ''")
    listed = F.create_map(*(x for t in sorted(idf) for x in (F.lit(t), F.lit(t))))
    counted = exploded.groupBy(*key, "line", F.try_element_at(listed, F.col("term")).alias("term")).count()
    counts = [terms(x) for _, x in templates]
    table = [(t, idf[t], *(float(c[t]) * idf[t] for c in counts)) for t in sorted(idf)]
    names = [f"w{k}" for k in range(len(templates))]
    known = spark.createDataFrame(table, "term string, idf double, " + ", ".join(f"{x} double" for x in names))
    counted = counted.join(F.broadcast(known), "term", "left")  # as many rows as the templates have terms
    weight = F.when(F.col("term").isNull(), F.col("count") * F.lit(unseen * unseen)).otherwise(F.col("count") * F.col("count") * F.col("idf") * F.col("idf"))
    scored = counted.groupBy(*key, "line").agg(F.sqrt(F.sum(weight)).alias("norm"), *(F.sum(F.col("count") * F.col("idf") * F.col(x)).alias(x) for x in names))
    sizes = [math.sqrt(sum((c * idf[t]) ** 2 for t, c in counts[k].items())) for k in range(len(templates))]
    cosines = F.array(*(F.struct(F.round(F.coalesce(F.col(x), F.lit(0.0)) / F.col("norm") / F.lit(sizes[k]), 6).alias("score"), F.lit(-k).alias("first"), F.lit(templates[k][0]).alias("license")) for k, x in enumerate(names)))
    best = scored.select(*key, "line", cosines.alias("c")).withColumn("b", F.array_max("c"))
    second = F.array_max(F.filter("c", lambda c: c["license"] != F.col("b.license")))["score"]
    best = best.where(F.coalesce(F.col("b.score") - second >= MARGIN, F.lit(True))).select(*key, "line", "b")
    own = best.groupBy(*key).agg(F.max(F.when(F.col("line") >= 0, F.col("b"))).alias("header"), F.max(F.when(F.col("line") < 0, F.col("b"))).alias("whole"))
    stated = docs.where(F.contains("text", F.lit("SPDX-License-Identifier:"))).select(*key, F.nullif(F.regexp_extract("text", SPDX, 1), F.lit("")).alias("license")).where("license is not null").distinct()
    kind = own.schema["whole"].dataType.simpleString()
    stated = stated.select(*key, F.struct(F.lit(1.0).alias("score"), F.lit(1).alias("first"), "license").cast(kind).alias("stated"))
    own = own.where((F.col("header.score") >= header) | (F.col("whole.score") >= file))
    own = own.unionByName(stated, allowMissingColumns=True).groupBy(*key).agg(*(F.max(c).alias(c) for c in ("header", "whole", "stated")))
    # the licence that counts: stated, of the whole file, of a line
    reads = F.when(F.col("whole.score") >= file, F.col("whole"))
    own = own.select(*key, F.coalesce("stated", reads, "header").alias("own"), (F.col("stated").isNotNull() | reads.isNotNull()).alias("all"))
    own = stored(own, "licences")

    granted = own.where("all and up is not null").groupBy("up").agg(F.max_by(F.struct("own.license", "own.score"), F.struct("own.score", "own.first")).alias("l"))
    folders = docs.where("path is not null").select(folder("path").alias("folder")).distinct()
    parts = F.split("folder", "/")
    upward = folders.select("folder", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("depth", "up"))
    nearest = upward.join(granted, "up").groupBy("folder").agg(F.max_by("l", "depth").alias("l"))
    same = F.expr("d.doc_id <=> o.doc_id and d.p = o.p and d.h = o.h")
    rows = docs.select("doc_id", "p", "h", "path", F.col("up").isNotNull().alias("named"), folder("path").alias("folder")).alias("d").join(own.drop("up").alias("o"), same, "left").select("d.*", "own", "all").join(nearest, "folder", "left")
    is_file = F.col("all") & (F.col("named") | F.col("path").isNull())
    pick = lambda x, none: F.coalesce(F.col(f"own.{x}"), F.col(f"l.{x}"), F.lit(none))
    basis = F.when(is_file, "file").when(F.col("own").isNotNull(), "header").when(F.col("l").isNotNull(), "inherited").otherwise("none")
    return rows.select("doc_id", "path", pick("license", None).alias("license"), pick("score", 0.0).alias("score"), basis.alias("basis"))
