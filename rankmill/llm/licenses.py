"""Licence of every file: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Native. Lines, and windows of a template's length over all words of a file, whatever the line breaks, are compared with the
templates; so words beside a notice cost nothing and a notice may run over lines. Document frequencies of all words involved
come from all files (a word counts once a file, combined before the shuffle). A template is looked for only where the text
holds enough of its weight to reach the threshold, which loses nothing (Cauchy-Schwarz). The best unit of a
file is its statement. A file whose path says that it is a licence file is also compared as one vector with whole licence
texts (a table of the caller; ``TEXTS`` if none is given), and what it is as a whole goes before what its lines say. A licence file (one whose path says so, or whose first line with text is a statement as a whole) also
covers its directory; files without a statement of their own look up their ancestor directories by
path joins and take the deepest. The directory side has one row per directory, so a hot directory only
makes the other side large, which adaptive execution splits.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.llm.line_dedup import lines_of
from rankmill.session import cut_lineage

# fixed values: short public notices by which files state a licence
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("proprietary", "All rights reserved"),
)
# fixed values: short licences as a whole
AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEXTS = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + AS_IS),
    ("BSD-2-Clause", f"{BSD_START} {BSD_END}"),
    ("BSD-3-Clause", f"{BSD_START} {BSD_THIRD} {BSD_END}"),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
)
COSINE = 0.75
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"
WORD = r"[a-z0-9]+"


def _terms(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def _norm(text: str, idf: dict[str, float]) -> tuple[float, dict[str, float]]:
    terms = _terms(text)
    weights = {t: (1 + math.log(terms.count(t))) * idf[t] for t in sorted(set(terms))}
    return math.sqrt(sum(w * w for w in weights.values())), weights


def _anchors(weights: dict[str, float], threshold: float) -> list[str]:
    """The heaviest terms; text without any of them cannot reach the threshold, since the rest weighs too little."""
    rest, out = sum(w * w for w in weights.values()), []
    least = threshold * threshold * rest * (1 - 1e-9)
    for t, w in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
        if rest < least:
            break
        out.append(t)
        rest -= w * w
    return out


def statements(files: DataFrame, threshold: float = COSINE, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """``file, line, license, score, whole`` of the best unit of each file that states a licence; ``files``: (file, text).

    Of equal scores the first line counts, then the template's order. ``whole``: the first line that states one as a whole.
    """
    spark = files.sparkSession
    vocabulary = sorted({t for _, text in templates for t in _terms(text)})
    known = F.array(*map(F.lit, vocabulary))
    n = max(1, files.count())
    held = files.select(F.explode(F.array_intersect(_words(F.col("text")), known)).alias("term"))
    df = {r["term"]: r["n"] for r in held.groupBy("term").agg(F.count("*").alias("n")).collect()}  # a row per vocabulary word
    idf = {t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1 for t in vocabulary}
    shapes, reach = [], []
    for i, (_, text) in enumerate(templates):
        norm, weights = _norm(text, idf)
        shapes.append((i, len(_terms(text)), _anchors(weights, threshold), weights, norm))
        shared = sum((F.when(F.array_contains("_known", t), w * w).otherwise(0.0) for t, w in weights.items()), F.lit(0.0))
        reach.append(F.when(shared >= threshold * threshold * norm * norm * (1 - 1e-9), F.lit(i)))
    shape = spark.createDataFrame(shapes, "template int, size int, anchors array<string>, weights map<string,double>, norm double")
    idf_of = F.create_map(*(F.lit(x) for t in vocabulary for x in (t, idf[t])))

    # a template is looked for in the files that hold enough of its weight
    split = files.select("file", F.transform(lines_of(F.col("text")), _words).alias("_lines"))
    split = split.withColumn("_known", F.array_intersect(F.flatten("_lines"), known)).where(F.size("_known") > 0)
    near = split.select("file", "_lines", F.explode(F.array_compact(F.array(*reach))).alias("template")).join(F.broadcast(shape), "template")

    shape_columns = ["template", "size", "weights", "norm"]
    whole = F.transform("_lines", lambda x, i: F.struct(i.alias("line"), F.lit(True).alias("whole"), x.alias("words")))
    lines = near.select("file", *shape_columns, F.explode(F.filter(whole, lambda x: F.arrays_overlap(x["words"], F.col("anchors")))).alias("u"))
    lines = lines.select("file", *shape_columns, "u.*")
    flat = near.select(
        "file", *shape_columns, "anchors", F.flatten("_lines").alias("_words"),
        F.flatten(F.transform("_lines", lambda x, i: F.array_repeat(i, F.size(x)))).alias("_line"),
    )
    places = F.filter(F.transform("_words", lambda x, i: F.when(F.array_contains("anchors", x), i)), lambda i: i.isNotNull())
    flat = flat.withColumn("_at", places)

    # each place of an anchor spans the windows of which it is the first anchor
    def piece(p: Column, i: Column) -> Column:
        first = F.greatest(p - F.col("size") + 1, F.when(i > 0, F.get("_at", i - 1) + 1).otherwise(0), F.lit(0))
        count = p - first + F.col("size")
        return F.struct(
            (p - first + 1).alias("starts"), F.slice("_words", first + 1, count).alias("words"), F.slice("_line", first + 1, count).alias("line")
        )

    pieces = flat.select("file", *shape_columns, F.explode(F.transform("_at", piece)).alias("p"))

    def shared(words: Column) -> Column:
        return F.aggregate(
            F.array_intersect(words, F.map_keys("weights")), F.lit(0.0), lambda a, x: a + F.col("weights")[x] * F.col("weights")[x]
        )

    enough = threshold * threshold * (1 - 1e-9) * F.col("norm") * F.col("norm")
    pieces = pieces.where(shared(F.col("p.words")) >= enough)
    # windows of the template's length; at the end of the text shorter ones
    windows = pieces.select("file", *shape_columns, "p", F.explode(F.sequence(F.lit(1), F.col("p.starts"))).alias("s"))
    windows = windows.select(
        "file", *shape_columns, F.get("p.line", F.col("s") - 1).alias("line"), F.lit(False).alias("whole"),
        F.slice("p.words", F.col("s"), F.col("size")).alias("words"),
    )
    unit = lines.unionByName(windows).where(shared(F.col("words")) >= enough)
    # products and the known words' share of the norm; other words weigh at least 1
    mine = F.filter("words", lambda x: F.array_contains(known, x))
    unit = unit.withColumn("_mine", mine).withColumn(
        "_tf", F.transform(F.array_distinct("_mine"), lambda x: F.struct(x.alias("t"), ((1 + F.log(F.size(F.filter("_mine", lambda y: y == x)))) * idf_of[x]).alias("w")))
    )
    unit = unit.withColumn("own", F.aggregate("_tf", F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
    unit = unit.withColumn("dot", F.aggregate("_tf", F.lit(0.0), lambda a, x: a + x["w"] * F.coalesce(F.col("weights")[x["t"]], F.lit(0.0))))
    others = F.filter("words", lambda x: ~F.array_contains(known, x))
    unit = unit.withColumn("others", others)
    most = F.col("dot") / F.sqrt(F.col("own") + F.size(F.array_distinct("others"))) / F.col("norm")
    unit = unit.where(most >= threshold * (1 - 1e-9))
    unit = unit.select("file", "line", "whole", "template", "norm", "own", "dot", "others", F.monotonically_increasing_id().alias("unit"))
    unit = cut_lineage(unit, "units")

    # document frequencies of the other words over all files
    tf = unit.select("unit", F.explode("others").alias("term")).groupBy("unit", "term").agg((1 + F.log(F.count("*"))).alias("tf"))
    wanted = unit.select(F.explode("others").alias("term")).distinct()
    count = files.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    count = count.join(wanted, "term", "left_semi")
    w = F.col("tf") * (F.log((n + 1) / (F.col("n") + 1)) + 1)
    rest = tf.join(count, "term").groupBy("unit").agg(F.sum(w * w).alias("rest"))
    scored = unit.drop("others").join(rest, "unit", "left")
    score = F.round(F.col("dot") / (F.sqrt(F.col("own") + F.coalesce("rest", F.lit(0.0))) * F.col("norm")), 9)
    scored = scored.withColumn("score", score).where(F.col("score") >= threshold)
    best = scored.groupBy("file").agg(
        F.min(F.struct((-F.col("score")).alias("less"), "line", "template")).alias("b"), F.min(F.when(F.col("whole"), F.col("line"))).alias("whole")
    )
    names = F.array(*(F.lit(name) for name, _ in templates))
    return best.select(
        "file", F.col("b.line").alias("line"), names[F.col("b.template")].alias("license"), (-F.col("b.less")).alias("score"), "whole"
    )


def whole_texts(files: DataFrame, texts: DataFrame | None = None, threshold: float = COSINE) -> DataFrame:
    """``file, license, score`` of licence files that are, as a whole, like a licence text; ``files``: (file, text).

    ``texts``: (license, text), of any length. Equal texts are compared once. Of equal scores the smallest licence name counts;
    null and empty texts on either side are like nothing.
    """
    spark = files.sparkSession
    named = files.where(F.regexp_like("file", F.lit(LICENSE_FILE)) & F.col("text").isNotNull())
    named = cut_lineage(named.select("file", "text", F.sha2("text", 256).alias("unit")), "licence files")
    if named.isEmpty():
        return spark.createDataFrame([], "file string, license string, score double")
    texts = spark.createDataFrame(list(TEXTS), "license string, text string") if texts is None else texts
    texts = texts.select("license", "text", F.sha2("text", 256).alias("unit")).dropDuplicates(["license", "unit"])

    def counted(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.select(*keys, F.explode(_words(F.col("text"))).alias("term")).groupBy(*keys, "term").agg((1 + F.log(F.count("*"))).alias("tf"))

    ours = cut_lineage(counted(named.dropDuplicates(["unit"]), "unit"), "terms")
    theirs = counted(texts, "license", "unit").withColumnRenamed("unit", "shape")
    n = files.count()
    wanted = ours.select("term").unionByName(theirs.select("term")).distinct()
    held = files.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    idf = F.log((n + 1) / (F.coalesce("n", F.lit(0)) + 1)) + 1
    idf = cut_lineage(wanted.join(held, "term", "left").select("term", idf.alias("idf")), "idf")

    def weighed(rows: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
        rows = rows.join(idf, "term").select(*keys, "term", (F.col("tf") * F.col("idf")).alias("w"))
        return rows, rows.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))

    (a, a_norm), (b, b_norm) = weighed(ours, "unit"), weighed(theirs, "license", "shape")
    dots = a.join(b.withColumnRenamed("w", "v"), "term").groupBy("unit", "license", "shape").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    found = dots.join(a_norm, "unit").join(b_norm.withColumnRenamed("norm", "other"), ["license", "shape"])
    found = found.select("unit", "license", F.round(F.col("dot") / (F.col("norm") * F.col("other")), 9).alias("score"))
    best = named.join(found.where(F.col("score") >= threshold), "unit").groupBy("file").agg(F.min(F.struct((-F.col("score")).alias("less"), "license")).alias("b"))
    return best.select("file", F.col("b.license").alias("license"), (-F.col("b.less")).alias("score"))


def file_licenses(
    files: DataFrame, path_col: str = "path", text_col: str = "text", threshold: float = COSINE,
    templates: tuple[tuple[str, str], ...] = TEMPLATES, texts: DataFrame | None = None,
) -> DataFrame:
    """``path, license, score, stated, source`` for every distinct path.

    ``stated``: the file says it itself; else ``source`` is the licence file of the nearest ancestor directory that has
    one, and all are null where none has. Rows that repeat a path are looked at each, the best counts; rows without a path are left out; null and
    empty texts state nothing. Of several licence files in a directory the smallest path counts. ``texts`` (license, text) are
    the whole licences that licence files are compared with.
    """
    given = files.where(F.col(path_col).isNotNull()).select(F.col(path_col).cast("string").alias("file"), F.col(text_col).alias("text"))
    said = statements(given, threshold, templates)
    whole = whole_texts(given, texts, threshold).select("file", F.struct("license", "score").alias("_whole"))
    stated = said.join(whole, "file", "full").select(
        "file", "line", F.coalesce("_whole.license", "license").alias("license"), F.coalesce("_whole.score", "score").alias("score"), "whole"
    )
    stated = cut_lineage(stated, "statements")
    first = F.array_position(F.transform(lines_of(F.col("text")), lambda x: F.trim(x) != ""), True) - 1
    heads = given.join(stated, "file").where(F.regexp_like("file", F.lit(LICENSE_FILE)) | ((F.col("line") == first) & (F.col("whole") == first)))
    folder = F.regexp_extract("file", "^(.*)/[^/]*$", 1)
    covers = (
        heads.select(folder.alias("dir"), F.struct("file", "license", "score").alias("x")).groupBy("dir").agg(F.min("x").alias("x"))
    )
    paths = given.select("file").distinct()
    silent = paths.join(stated, "file", "left_anti")
    parts = F.split("file", "/")
    ups = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1))
    above = silent.select("file", F.explode(ups).alias("depth"), parts.alias("parts"))
    above = above.select("file", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("dir"))
    # the deepest directory that is covered
    near = above.join(covers, "dir").groupBy("file").agg(F.max(F.struct("depth", "x")).alias("y"))
    own = stated.select("file", "license", "score", F.lit(True).alias("stated"), F.col("file").alias("source"))
    inherited = near.select("file", "y.x.license", "y.x.score", F.lit(False).alias("stated"), F.col("y.x.file").alias("source"))
    return paths.join(own.unionByName(inherited), "file", "left").withColumnRenamed("file", "path")
