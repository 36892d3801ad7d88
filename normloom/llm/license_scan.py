"""License scans by diagonal voting: rolling word grams are joined to template positions and vote for offsets.

Every run of two and of four adjacent words of a text with a hit is hashed and joined to the positions of the same run in
the templates: pairs for short phrases, runs of four for the texts and notices of licenses. A hit votes for the diagonal
``word position - template position``; a template that stands somewhere gathers its votes on one diagonal, and one with words
inserted or left out on neighbouring ones, which are merged. A merged span is verified word by word: a template word
counts if the text has it at its place on one of the span's diagonals. No text is shuffled for that, and no vote: texts with a
hit are sent once, as numbers of the words that templates have, and all else happens where those numbers are.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normloom.llm.shared import SEPARATORS, column, let, words

# Base phrases and labels, then phrases that license notices share, then texts and notices of licenses.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license version 2 0": "apache",
    "gnu general public license version": "gpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistributions in binary form must reproduce": "bsd",
    "licensed under cc by nc": "cc-by-nc",
    "creative commons attribution": "cc",
}
_SHARE_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
    1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_PROGRAM = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
TEXTS = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
        AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause": _SHARE_BSD,
    "bsd-3-clause": _SHARE_BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
    "gpl": _PROGRAM.format("General Public License"),
    "lgpl": _PROGRAM.format("Lesser General Public License"),
    "agpl": _PROGRAM.format("Affero General Public License"),
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
        for any purpose, commercial or non-commercial, and by any means.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:""",
}
#: Words of a gram for phrases and for texts; diagonals this near each other belong to one span; share of template words that a span must have.
SHORT, LONG, NEAR, COVERED = 2, 4, 2, 0.8


def templates() -> list[tuple[str, bool, int, list[str]]]:
    """``label, base, gram, words`` of each template."""
    found = [*((p, n, True, SHORT) for p, n in BASE.items()), *((p, n, False, SHORT) for p, n in NOTICES.items()), *((t, n, False, LONG) for n, t in TEXTS.items())]
    return [(label, base, gram, [w for w in re.split(SEPARATORS, text.lower()) if w]) for text, label, base, gram in found]


def _positions(spark) -> DataFrame:
    """``template, width, at, gram``: a row for each gram of each template."""
    rows = [(k, width, at, parts[at : at + width]) for k, (_, _, width, parts) in enumerate(templates()) for at in range(len(parts) - width + 1)]
    made = spark.createDataFrame(rows, "template int, width int, at int, words array<string>")
    gram = lambda width: F.xxhash64(*[F.hash(F.get("words", F.lit(k))) for k in range(width)])
    return made.withColumn("gram", F.when(F.col("width") == SHORT, gram(SHORT)).otherwise(gram(LONG))).drop("words")


def _of_template(values: Sequence, template: Column) -> Column:
    """The one of ``values``, which has one for each template, that belongs to ``template``."""
    return F.get(F.array(*map(F.lit, values)), template)


def _is_hit(parts: Column) -> Column:
    """Whether a run of SHORT or of LONG words stands in a template that has such grams. Words hold no spaces, so a run is known by its words with spaces between."""
    runs = {width: {" ".join(ws[k : k + width]) for _, _, gram, ws in templates() if gram == width for k in range(len(ws) - width + 1)} for width in (SHORT, LONG)}
    heads = {" ".join(r.split(" ")[:SHORT]) for r in runs[LONG]}
    firsts = {r.split(" ")[0] for r in runs[SHORT] | heads}
    one_of = lambda value, known: value.isin(sorted(known))

    def at(w: Column, i: Column) -> Column:
        run = lambda width: F.concat_ws(" ", w, *[F.get(parts, i + k) for k in range(1, width)])
        return one_of(w, firsts) & (one_of(run(SHORT), runs[SHORT]) | (one_of(run(SHORT), heads) & one_of(run(LONG), runs[LONG])))

    return F.array_contains(F.transform(parts, at), True)


def _numbers(parts: Column) -> Column:
    """A number for each word that templates have (no two have the same), null for other words."""
    known = sorted({w for *_, ws in templates() for w in ws})
    return F.transform(parts, lambda w: F.when(w.isin(known), F.hash(w)))


def _numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``ident, numbers`` of each text with a hit; wholly repeated rows stand once."""
    texts = docs.select(_ident(key, text).alias("ident"), words(column(text)).alias("words"))
    # Exploding an array of one or none instead of a filter keeps the optimizer from splitting the text once for each use.
    return texts.select("ident", F.explode(F.when(_is_hit(F.col("words")), F.array(_numbers(F.col("words"))))).alias("numbers")).dropDuplicates(["ident"])


def _ident(key: str, text: str) -> Column:
    """Key and a hash of the text, so that rows of one key but different texts stay apart. A struct is never null, also of a null key."""
    return F.struct(column(key).alias("key"), F.xxhash64(column(text)).alias("mark"))


def _hits(numbers: Column) -> Column:
    """``at_word, gram`` of the runs of SHORT and of LONG words that templates have."""

    def at(n: Column, i: Column) -> Column:
        run = [n, *[F.get(numbers, i + k) for k in range(1, LONG)]]
        known = lambda width: reduce(lambda a, b: a & b, [x.isNotNull() for x in run[:width]])
        return F.array(*[F.when(known(width), F.struct(i.alias("at_word"), F.xxhash64(*run[:width]).alias("gram"))) for width in (SHORT, LONG)])

    return F.filter(F.flatten(F.transform(numbers, at)), lambda h: h.isNotNull())


def find_spans(numbered: DataFrame) -> DataFrame:
    """Merged spans, not yet verified: ``ident, template, label, base, length, first, last, diagonals, places``.

    ``places`` lists where the whole template stands without a gap (sorted word positions);
    ``first`` and ``last`` bound the voting words.
    """
    rolled = numbered.select("ident", F.explode(_hits(F.col("numbers"))).alias("hit")).select("ident", "hit.*")
    # The templates are a constant of this module, so their table may be broadcast.
    places = rolled.join(F.broadcast(_positions(numbered.sparkSession)), "gram")
    labels, bases, widths, lengths = zip(*[(label, base, width, len(ws)) for label, base, width, ws in templates()], strict=True)
    of = lambda values: _of_template(values, F.col("template"))
    votes = places.groupBy("ident", "template", (F.col("at_word") - F.col("at")).alias("diagonal")).agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count("at").alias("n"))
    span = "partition by ident, template order by diagonal"
    chained = votes.selectExpr("*", f"diagonal - lag(diagonal, 1, -1000000) over ({span}) > {NEAR} as opens").selectExpr("*", f"sum(int(opens)) over ({span}) as span")
    merged = chained.groupBy("ident", "template", "span").agg(
        F.min(F.col("diagonal") + F.col("low")).alias("first"),
        F.max(F.col("diagonal") + F.col("high")).alias("last"),
        F.array_sort(F.collect_list("diagonal")).alias("diagonals"),
        F.array_sort(F.collect_list(F.when(F.col("n") == of(lengths) - of(widths) + 1, F.col("diagonal")))).alias("places"),
    )
    return merged.withColumns({"last": F.col("last") + of(widths), "label": of(labels), "base": of(bases), "length": of(lengths)})


def _verified(spans: Column, numbers: Column) -> Column:
    """``label, coverage`` of each span: the share of template words that the text, given as ``_numbers``, has at their place on one of the span's diagonals."""
    known = F.array(*[F.array(*[F.hash(F.lit(w)) for w in ws]) for *_, ws in templates()])

    def one(s: Column) -> Column:
        there = lambda w, j: F.exists(s["diagonals"], lambda d: F.when(d + j >= 0, F.get(numbers, d + j)) == w)
        equal = let(F.get(known, s["template"]), lambda ws: F.size(F.filter(F.transform(ws, lambda w, j: there(w, j)), lambda x: x)))
        return F.struct(s["label"].alias("label"), (equal / s["length"]).alias("coverage"))

    return F.transform(spans, one)


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` plus ``n_words, n_base, first_word, last_word, base_labels, labels, score``.

    Base labels come from base phrases that stand somewhere word for word; ``n_base`` counts all
    their places, ``first_word`` and ``last_word`` are the smallest and largest start. ``labels``
    adds those of spans that have at least ``COVERED`` of a template's words. ``score`` is the best
    coverage of any span, 0 without one. Null and empty texts have no words; repeated rows get equal
    results, and an empty table an empty one. Added columns replace input columns of the same names.
    """
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    numbered = _numbered(docs, key, text)
    whole = F.col("base") & (F.size("places") > 0)
    found = find_spans(numbered).groupBy("ident").agg(
        F.sum(F.when(whole, F.size("places")).otherwise(0)).alias("n_base"),
        F.min(F.when(whole, F.array_min("places"))).cast("long").alias("first_word"),
        F.max(F.when(whole, F.array_max("places"))).cast("long").alias("last_word"),
        F.array_sort(F.collect_set(F.when(whole, F.col("label")))).alias("base_labels"),
        F.collect_list(F.struct("template", "label", "length", "diagonals")).alias("spans"),
    )
    # Both sides come from one shuffle of the numbers. Exploding an array of one keeps the optimizer from checking the spans once for each use.
    found = found.join(numbered, "ident").select("*", F.explode(F.array(_verified(F.col("spans"), F.col("numbers")))).alias("checked")).drop("numbers", "spans")
    # Plain columns and not one struct: what a caller drops afterwards is not shuffled then.
    kept = {f"in_{k}": c for k, c in enumerate(c for c in docs.columns if c.lower() not in added)}
    rows = docs.select(*[column(c).alias(n) for n, c in kept.items()], _ident(key, text).alias("ident"), F.size(words(column(text))).cast("long").alias("n_words"))
    base, checked = F.coalesce("base_labels", F.array().cast("array<string>")), F.coalesce("checked", F.array().cast("array<struct<label:string,coverage:double>>"))
    more = F.transform(F.filter(checked, lambda s: s["coverage"] >= COVERED), lambda s: s["label"])
    return rows.join(found, "ident", "left").select(
        *[F.col(n).alias(c) for n, c in kept.items()], "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"), F.coalesce(F.array_max(checked["coverage"]), F.lit(0.0)).alias("score"),
    )
