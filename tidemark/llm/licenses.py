"""License scans: normalised text against licence templates by Dice coefficient over word bigrams.

Units are a document's lines, the document itself, and windows of its words. Each is normalised (lower case, other characters
than letters and digits become spaces), its distinct word bigrams are compared with every template whose
size allows the least coefficient: of sets of a and b bigrams, Dice can reach d only if a and b are within
a factor of (2 - d) / d. The templates are a bounded list held in the expression, so nothing is joined.

Windows find notices that are wrapped over lines or share a line with prose, and texts within longer ones. A window starts
at a word pair of the template, has at most its words times that factor, and ends where the coefficient is
highest (the last such word pair of the template). Of windows that overlap, the one with the highest product of coefficient and shared bigrams stays. It is
no unit where its line or, by the same template, the whole text matches already. Only documents with words that every
match must have are looked at. Besides the templates, windows are compared with ``TEXTS``.

Defined results: null text is empty and has no units; texts of one word have no bigrams; of templates
with equal coefficients the first by name is reported; repeated lines count each; an empty table gives an empty
result; repeated rows are scanned each; other columns are not looked at. Whole texts are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .license_texts import TEXTS

LEAST_DICE = 0.8
#: Public licence notices, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def normal(text: str) -> list[str]:
    """The words of a template, as ``_words`` makes them."""
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def bigrams(words: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


#: Words that are too common to tell which documents may hold a template.
_COMMON = frozenset("a all an and any are as at be by can for from if in is it its may no not of on or other out such that the this to under use was with without you your 0 1 2 3 4".split())


def anchors(sets: list[set[str]], least: float) -> list[str]:
    """Words of which any window that reaches ``least`` with one of the sets has one or more: so many of a set's
    bigrams hold one that the rest are too few."""
    open_, found = [(b, math.ceil(least * len(b) / (2 - least) - 1e-9)) for b in sets if b], []
    while open_ := [(b, n) for b, n in open_ if len(b) >= n]:
        words = {w for b, _ in open_ for x in b for w in x.split()}
        gain = lambda w: sum(min(1.0, sum(w in x.split() for x in b) / (len(b) - n + 1)) for b, n in open_)  # noqa: E731, B023
        best = max(sorted(words - _COMMON or words), key=gain)
        found.append(best)
        open_ = [({x for x in b if best not in x.split()}, n) for b, n in open_]
    return found


def _windows(out: DataFrame, texts: dict[str, str], least: float, text: str) -> DataFrame:
    """Adds _windows: structs of first and last line, dice and name of the windows that match and don't overlap."""
    made = [(name, normal(t), bigrams(normal(t))) for name, t in sorted(texts.items()) if bigrams(normal(t))]
    t = F.coalesce(F.col(text), F.lit(""))
    may = F.lower(t).rlike(f"(?<![a-z0-9])(?:{'|'.join(anchors([b for _, _, b in made], least))})(?![a-z0-9])")
    placed = F.flatten(F.transform(F.split(t, "\n"), lambda x, i: F.transform(_words(x), lambda w: F.struct(i.cast("int").alias("line"), w.alias("w")))))
    out = out.withColumn("_w", F.when(may, placed).otherwise(F.array().cast("array<struct<line:int,w:string>>")))
    pair = F.zip_with("_w", F.slice("_w", 2, F.greatest(F.size("_w"), F.lit(1))), lambda a, b: F.concat_ws(" ", a["w"], b["w"]))
    out = out.withColumn("_b", F.slice(pair, 1, F.greatest(F.size("_w") - 1, F.lit(0))))
    listed = lambda b: F.split(F.lit("|".join(sorted(b))), r"\|")
    out = out.withColumn("_seen", F.when(F.size("_b") > 0, F.array_intersect("_b", listed({x for _, _, b in made for x in b}))).otherwise(F.array().cast("array<string>")))
    known = F.array(
        *[
            F.struct(F.lit(name).alias("name"), listed(b).alias("b"), F.lit(math.ceil(least * len(b) / (2 - least) - 1e-9)).alias("fewest"), F.lit(int((len(w) - 1) * (2 - least) / least)).alias("longest"))
            for name, w, b in made
        ]
    )
    out = out.withColumn("_known", F.when(F.size("_seen") > 0, F.filter(known, lambda k: F.size(F.array_intersect(F.col("_seen"), k["b"])) >= k["fewest"])).otherwise(F.filter(known, lambda k: F.lit(False))))
    # where the same bigram stood before, so that a window counts its distinct ones in one pass
    out = out.withColumn("_sorted", F.when(F.size("_known") > 0, F.sort_array(F.transform("_b", lambda b, i: F.struct(b.alias("b"), i.cast("int").alias("i"))))))
    before = lambda x, k: F.when(F.get(F.col("_sorted"), k - 1)["b"] == x["b"], F.get(F.col("_sorted"), k - 1)["i"]).otherwise(-1)
    out = out.withColumn("_before", F.sort_array(F.transform("_sorted", lambda x, k: F.struct(x["i"].alias("i"), before(x, k).alias("p"), x["b"].alias("b")))))

    def cells(k: Column) -> Column:
        hits = F.transform("_before", lambda x: F.struct(x["i"].alias("i"), x["p"].alias("p"), F.array_contains(k["b"], x["b"]).alias("hit")))
        return F.struct(k["name"].alias("name"), F.size(k["b"]).alias("m"), k["fewest"].alias("fewest"), k["longest"].alias("longest"), hits.alias("cells"))

    out = out.withColumn("_cells", F.transform("_known", cells))
    out = out.withColumn("_cells", F.transform("_cells", lambda k: k.withField("at", F.transform(F.filter(k["cells"], lambda x: x["hit"]), lambda x: x["i"]))))
    out = out.withColumn("_cells", F.transform("_cells", lambda k: k.withField("at", F.filter(k["at"], lambda s, j: F.get(k["at"], j + k["fewest"] - 1) - s < k["longest"]))))

    def grow(k: Column, s: Column) -> Column:
        def add(a: Column, x: Column) -> Column:
            n, c = a["n"] + (x["p"] < s).cast("int"), a["c"] + (x["hit"] & (x["p"] < s)).cast("int")
            better = (2 * c / (n + k["m"]) > a["dice"]) | x["hit"] & (2 * c / (n + k["m"]) == a["dice"])
            return F.struct(n.alias("n"), c.alias("c"), F.when(better, 2 * c / (n + k["m"])).otherwise(a["dice"]).alias("dice"), F.when(better, c).otherwise(a["common"]).alias("common"), F.when(better, x["i"]).otherwise(a["end"]).alias("end"))

        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("c"), F.lit(0.0).alias("dice"), F.lit(0).alias("common"), F.lit(-1).alias("end"))
        return F.aggregate(F.slice(k["cells"], s + 1, k["longest"]), start, add, lambda a: F.struct((-a["dice"] * a["common"]).alias("rank"), k["name"].alias("name"), s.alias("start"), a["end"].alias("end"), a["dice"].alias("dice")))

    out = out.withColumn("_all", F.flatten(F.transform("_cells", lambda k: F.transform(k["at"], lambda s: grow(k, s)))))
    out = out.withColumn("_all", F.sort_array(F.filter("_all", lambda x: x["dice"] >= least)))
    none = F.array().cast("array<struct<rank:double,name:string,start:int,end:int,dice:double>>")
    apart = lambda a, x: ~F.exists(a, lambda y: (y["start"] <= x["end"]) & (x["start"] <= y["end"]))
    out = out.withColumn("_all", F.aggregate("_all", none, lambda a, x: F.when(apart(a, x), F.concat(a, F.array(x))).otherwise(a)))
    line = lambda i: F.get(F.col("_w"), i)["line"]
    return out.withColumn("_windows", F.sort_array(F.transform("_all", lambda x: F.struct(line(x["start"]).alias("first"), line(x["end"] + 1).alias("last"), x["dice"].alias("dice"), x["name"].alias("name")))))


def _words(c: Column) -> Column:
    """Words of ASCII letters and digits, in lower case."""
    return F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: w != "")


def _bigrams(w: Column) -> Column:
    pair = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.slice(pair, 1, F.greatest(F.size(w) - 1, F.lit(0))))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_DICE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_units that match, the best coefficient, and the matches
    ("unit:licence", unit -1 for the whole text, else the line's number) joined by commas. Windows
    follow, with their line's number, or "first-last" where they run over several."""
    texts = TEMPLATES | TEXTS if templates is None else templates
    sets = sorted((name, sorted(bigrams(normal(t)))) for name, t in (TEMPLATES if templates is None else templates).items())
    bound = (2 - least) / least
    sizes = [len(b) for _, b in sets if b]
    low, high = (min(sizes) / bound, max(sizes) * bound) if sizes else (1.0, 0.0)
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    whole = F.when(F.size(lines) > 1, F.array(F.struct(F.lit(-1).alias("unit"), F.coalesce(F.col(text), F.lit("")).alias("t")))).otherwise(F.array().cast("array<struct<unit:int,t:string>>"))
    # a unit of b bigrams has more than b characters; sizes count distinct bigrams, as a long unit may repeat itself
    units = F.concat(whole, F.transform(lines, lambda t, i: F.struct(i.cast("int").alias("unit"), t.alias("t"))))
    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), F.filter(units, lambda u: F.char_length(u["t"]) >= int(low)).alias("units"))
    out = out.withColumn("units", F.transform("units", lambda u: F.struct(u["unit"].alias("unit"), _words(u["t"]).alias("w"))))
    out = out.withColumn("units", F.transform("units", lambda u: F.struct(u["unit"].alias("unit"), _bigrams(u["w"]).alias("b"))))
    out = out.withColumn("units", F.filter("units", lambda u: (F.size(u["b"]) >= low) & (F.size(u["b"]) <= high)))

    # what a unit shares with one template it shares with all of them together
    union = F.array(*map(F.lit, sorted({x for _, b in sets for x in b}))) if sizes else F.array().cast("array<string>")
    least_size = min(sizes) if sizes else 0
    out = out.withColumn("units", F.filter("units", lambda u: 2 * F.size(F.array_intersect(u["b"], union)) >= least * (F.size(u["b"]) + least_size)))

    def dice(u: Column, name: str, b: list[str]) -> Column:
        n, m = F.size(u["b"]), len(b)
        common = F.size(F.array_intersect(u["b"], F.array(*map(F.lit, b))))
        fits = (n >= m / bound) & (n <= m * bound)
        return F.struct(F.when(fits, 2 * common / (n + m)).otherwise(F.lit(0.0)).alias("dice"), F.lit(name).alias("name"))

    def best(u: Column) -> Column:
        found = F.array(*[dice(u, name, b) for name, b in sets if b])
        top = F.aggregate(found, F.struct(F.lit(0.0).alias("dice"), F.lit("").alias("name")), lambda a, x: F.when(x["dice"] > a["dice"], x).otherwise(a))
        return F.struct(u["unit"].alias("unit"), top.alias("top"))

    if sizes:
        out = out.withColumn("hits", F.transform("units", best)).withColumn("hits", F.filter("hits", lambda h: h["top"]["dice"] >= least))
    else:
        out = out.withColumn("hits", F.array().cast("array<struct<unit:int,top:struct<dice:double,name:string>>>"))
    if sizes:
        out = _windows(out, texts, least, "_text")
    else:
        out = out.withColumn("_windows", F.array().cast("array<struct<first:int,last:int,dice:double,name:string>>"))
    inside = lambda x: F.exists("hits", lambda h: (h["unit"] == x["first"]) & (x["first"] == x["last"]) | (h["unit"] == -1) & (h["top"]["name"] == x["name"]))
    out = out.withColumn("_windows", F.filter("_windows", lambda x: ~inside(x)))
    lines_of = lambda x: F.when(x["first"] == x["last"], x["first"].cast("string")).otherwise(F.concat_ws("-", x["first"].cast("string"), x["last"].cast("string")))
    shown = F.concat(F.transform("hits", lambda h: F.concat_ws(":", h["unit"].cast("string"), h["top"]["name"])), F.transform("_windows", lambda x: F.concat_ws(":", lines_of(x), x["name"])))
    found = F.concat(F.transform("hits", lambda h: h["top"]["dice"]), F.transform("_windows", lambda x: x["dice"]))
    return out.select("doc_id", F.size(found).cast("long").alias("n_units"), F.coalesce(F.array_max(found), F.lit(0.0)).alias("best_dice"), F.array_join(shown, ",").alias("matches"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    return found.select("doc_id", "n_units", F.round("best_dice", 6).alias("best_dice"), "matches")
