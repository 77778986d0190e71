"""Licence scan: Dice coefficient over word bigrams against licence templates (native).

A text's words are those of its lower-case letters and digits, whatever stands between
them. Wherever in it a licence may stand, the span of words that holds it has a number b
of bigrams for which a template of a bigrams can reach the coefficient t, that is
``a * t / (2 - t) <= b <= a * (2 - t) / t``. The best span begins and ends with bigrams of
the template, as others only lower the coefficient. So bigrams of a template are picked
out where the text lies (nearly none are, in most texts), templates of which a text has
fewer than the least size in all are pruned, and for the rest every span between two such
bigrams within the size bounds is held against the template, by a running count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varloom.llm.common import cut, with_line_of

THRESHOLD = 0.8

#: Licence texts, headers and notices, (licence, text).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
        "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE "
        "COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright "
        "holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE "
        "COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; "
        "you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source "
        "versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software "
        "and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, "
        "distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to "
        "permit third-parties to whom the Software is furnished to do so, all subject to the following: The "
        "copyright notices in the Software and this entire statement, including the above license grant, this "
        "restriction and the following disclaimer, must be included in all copies of the Software, in whole or in "
        "part, and all derivative works of the Software, unless such copies or derivative works are solely in the "
        "form of machine-executable object code generated by a source language processor.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version. This library is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version. This program is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    (
        "CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright to this work."),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "2.0 which is available at https://www.eclipse.org/legal/epl-2.0.",
    ),
]


#: Words of lower-case text: letters and digits, with dots inside.
TOKEN = r"[a-z0-9]+(?:\.[a-z0-9]+)*"


def normalised_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def bigrams(w: Column) -> Column:
    """64-bit digests of neighbouring words, and a null for the last word."""
    pair = lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b))
    return F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), pair)


def size_bounds(n: Column, t: float) -> tuple[Column, Column]:
    return F.ceil(n * (t / (2 - t)) - 1e-9), F.floor(n * ((2 - t) / t) + 1e-9)


def template_bigrams(spark, templates=TEMPLATES, t: float = THRESHOLD) -> DataFrame:
    """(template, license, size, lo, hi, bigram, times) of the fixed templates."""
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(templates)], "template int, license string, text string")
    rows = rows.withColumn("w", normalised_words(F.col("text")))
    rows = rows.select("template", "license", (F.size("w") - 1).alias("size"), F.explode(bigrams(F.col("w"))).alias("bigram"))
    lo, hi = size_bounds(F.col("size"), t)
    return (
        rows.where("bigram is not null")
        .groupBy("template", "license", "size", "bigram")
        .agg(F.count(F.lit(1)).cast("int").alias("times"))
        .select("template", "license", "size", lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), "bigram", "times")
    )


def spans(docs: DataFrame, templates=TEMPLATES, t: float = THRESHOLD) -> DataFrame:
    """(mark, template, license, size, first, last, dice): the best span of each template that reaches t in a text.

    ``mark`` is the digest of the text, as equal texts have equal spans; ``first`` and
    ``last`` number the span's bigrams. Of spans of equal coefficient the first counts, and
    of these the shortest.
    """
    known = cut(template_bigrams(docs.sparkSession, templates, t))
    listed = [r.bigram for r in known.select("bigram").distinct().collect()]  # of the fixed templates
    numbered = F.transform(bigrams(normalised_words(F.col("text"))), lambda h, i: F.struct(i.alias("at"), h.alias("bigram")))
    hits = docs.where("text is not null").select("text", F.filter(numbered, lambda x: x["bigram"].isin(listed)).alias("hits"))
    hits = hits.where(F.size("hits") > 0).select(F.md5("text").alias("mark"), F.explode("hits").alias("h"))
    # copies of a text fall together before anything is shuffled
    hits = cut(hits.select("mark", "h.*").distinct())
    k = F.broadcast(known.withColumnRenamed("bigram", "t_bigram"))
    met = hits.join(k, F.col("bigram") == F.col("t_bigram"))
    shared = met.groupBy("mark", "template", "lo", "bigram", "times").agg(F.count(F.lit(1)).alias("here"))
    shared = shared.groupBy("mark", "template", "lo").agg(F.sum(F.least("here", "times")).alias("all_shared"))
    # a few texts and templates are left; they and their hits are made once
    likely = shared.where("all_shared >= lo").select(F.col("mark").alias("l_mark"), F.col("template").alias("l_template"))
    met = met.join(likely, (F.col("mark") == F.col("l_mark")) & (F.col("template") == F.col("l_template")), "left_semi")
    group = ["mark", "template", "license", "size", "lo", "hi"]
    # a hit counts in a span that begins after the hit of its bigram `times` places back
    places = met.groupBy(*group, "bigram", "times").agg(F.sort_array(F.collect_list("at")).alias("ats"))
    back = F.transform("ats", lambda x, i: F.struct(x.alias("at"), F.coalesce(F.get(F.col("ats"), i - F.col("times")), F.lit(-1)).alias("back")))
    hit = cut(places.select(*group, F.explode(back).alias("h")).select(*group, "h.*"))
    # starts meet the hits at most hi - 1 places on, by bins of hi places
    cell = lambda c: F.floor(F.col(c) / F.col("hi"))
    start = hit.select("mark", "template", F.col("at").alias("first"), cell("at").alias("bin"), F.lit(0).alias("_"))
    start = start.select("mark", "template", "first", F.explode(F.array(F.col("bin"), F.col("bin") + 1)).alias("bin")).withColumnsRenamed({"mark": "s_mark", "template": "s_template", "bin": "s_bin"})
    on = (F.col("mark") == F.col("s_mark")) & (F.col("template") == F.col("s_template")) & (F.col("bin") == F.col("s_bin"))
    on = on & (F.col("at") >= F.col("first")) & (F.col("at") - F.col("first") < F.col("hi"))
    met = hit.withColumn("bin", cell("at")).join(start, on)
    upto = W.partitionBy("mark", "template", "first").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    met = met.withColumn("shared", F.sum(F.when(F.col("back") < F.col("first"), 1).otherwise(0)).over(upto))
    length = F.col("at") - F.col("first") + 1
    met = met.where(length >= F.col("lo")).withColumn("dice", F.col("shared") * 2 / (F.col("size") + length))
    best = F.max_by(F.struct("first", F.col("at").alias("last"), "dice"), F.struct("dice", -F.col("first"), -F.col("at")))
    found = met.where(F.col("dice") >= t).groupBy("mark", "template", "license", "size").agg(best.alias("b"))
    return found.select("mark", "template", "license", "size", "b.*")


def matches(docs: DataFrame, templates=TEMPLATES, t: float = THRESHOLD) -> DataFrame:
    """The spans that no better one (higher coefficient, then larger, then earlier template) of the same text overlaps."""
    found = cut(spans(docs, templates, t))
    better = found.select(F.col("mark").alias("b_mark"), F.col("first").alias("b_first"), F.col("last").alias("b_last"), F.struct("dice", "size", -F.col("template")).alias("b_rank"))
    on = (F.col("mark") == F.col("b_mark")) & (F.col("first") <= F.col("b_last")) & (F.col("b_first") <= F.col("last"))
    return found.join(better, on & (F.struct("dice", "size", -F.col("template")) < F.col("b_rank")), "left_anti")


def scan(docs: DataFrame, templates=TEMPLATES, t: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, license, dice, first_word, n_words, n_matches, licenses.

    ``license`` is that of the best span (highest coefficient, then the largest, then the
    first template), which has ``n_words`` words from number ``first_word`` (from 0) on;
    ``n_matches`` counts templates with a span of their own, ``licenses`` has their names,
    distinct, sorted and joined by commas. Null, empty and unmatched texts have nulls, 0
    matches and coefficient 0. Every row is judged by its own text alone, whatever ids
    repeat or are null; an empty table gives an empty result; other columns are ignored.
    """
    best = F.max_by(F.struct("license", "first", "last"), F.struct("dice", "size", -F.col("template")))
    found = matches(docs.select("text"), templates, t).groupBy(F.col("mark").alias("m_mark")).agg(
        best.alias("best"),
        F.max("dice").alias("dice"),
        F.count(F.lit(1)).alias("n_matches"),
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
    )
    rows = with_line_of(docs.select("doc_id", F.md5("text").alias("mark")), cut(found), [("mark", "m_mark")])
    return rows.select(
        "doc_id",
        F.col("best.license").alias("license"),
        F.round(F.coalesce("dice", F.lit(0.0)), 6).alias("dice"),
        F.col("best.first").cast("long").alias("first_word"),
        (F.col("best.last") - F.col("best.first") + 2).cast("long").alias("n_words"),
        F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"),
        F.coalesce("licenses", F.lit("")).alias("licenses"),
    )
