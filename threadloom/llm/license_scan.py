"""Licence scans with a positional rare-token index, all in Spark's own functions.

The index holds, for every template, its rarest words within the mandatory key phrase and where they
stand. A file's rare licence words are looked up; a template is a candidate at the start on which the
postings of its rare words agree by relative position; the key phrase is then verified word by word, and
the rest of the template is compared at that alignment for the score. Word weights (IDF) are counted over
the template collection, so the index is a constant and a scan needs no exchange.
"""

from __future__ import annotations

import math
import string
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: what stands between words, in a text whose A to Z are lower-cased.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A notice, its label, and the key phrase it must contain. base: its places are counted in n_base."""

    label: str
    key: str
    notice: str
    base: bool = False


#: Labels, key phrases and notices (the customary ones, in lower case and without marks).
TEMPLATES = (
    Template("gpl", "gnu general public license", "this work is licensed under the gnu general public license", True),
    Template("apache", "apache license", "licensed under the apache license", True),
    Template("cc-by", "cc by", "licensed under cc by", True),
    Template("mit", "mit license", "released under the mit license", True),
    Template("gpl-3.0", "gnu general public license version 3", "this work is licensed under the gnu general public license version 3"),
    Template(
        "gpl-notice", "under the terms of the gnu general public license as published by the free software foundation",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details "
        "you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses",
    ),
    Template("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0"),
    Template(
        "apache-notice", "you may not use this file except in compliance with the license",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    Template("cc-by-nc-4.0", "cc by nc 4 0", "licensed under cc by nc 4 0"),
    Template("cc-by-sa-4.0", "cc by sa 4 0", "licensed under cc by sa 4 0"),
    Template("lgpl", "gnu lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    Template("agpl", "gnu affero general public license", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    Template("mpl-2.0", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    Template(
        "bsd", "redistribution and use in source and binary forms",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    ),
    Template(
        "mit-text", "permission is hereby granted free of charge to any person",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ),
    Template(
        "isc", "permission to use copy modify and or distribute this software for any purpose",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    ),
    Template(
        "unlicense", "free and unencumbered software released into the public domain",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
)


def idf(templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """ln(1 + templates / templates with the word)."""
    notices = [set(t.notice.split()) for t in templates]
    return {w: round(math.log(1 + len(notices) / sum(w in n for n in notices)), 6) for w in sorted(set().union(*notices))}


def rare_words(t: Template, weight: dict[str, float], n: int = 2) -> list[tuple[str, int]]:
    """The n words of the key phrase with the highest IDF (ties: longer, then earlier), each with its place in the phrase."""
    key = t.key.split()
    first = {w: key.index(w) for w in key}
    return sorted(first.items(), key=lambda x: (-weight[x[0]], -len(x[0]), x[1]))[:n]


def words_of(parts: Column) -> Column:
    """A text split at its separators, several times faster than extracting words, has empty parts at its ends only."""
    first = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0)
    last = F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    return F.slice(parts, first + 1, F.greatest(F.size(parts) - first - last, F.lit(0)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row; an expression that a lambda names would be computed again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def index(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """One row: templates (array of struct, by number), postings (from a rare word to the templates and places in the key phrase)."""
    weight = idf(templates)
    spaced = lambda s: F.split(F.lit(s), " ")
    rows, postings = [], defaultdict(list)
    for t, x in enumerate(templates):
        notice = x.notice.split()
        weights = [weight[w] for w in notice]
        rare = rare_words(x, weight)
        for word, place in rare:
            postings[word].append(F.struct(F.lit(t).alias("t"), F.lit(place).alias("place")))
        given = F.transform(spaced(" ".join(map(repr, weights))), lambda w: w.cast("double"))
        rows.append(F.struct(F.lit(x.label).alias("label"), F.lit(x.base).alias("base"), spaced(x.key).alias("key"), F.lit(f" {x.notice} ".split(f" {x.key} ")[0].count(" ")).alias("at"), spaced(x.notice).alias("notice"), given.alias("weights"), F.lit(sum(weights)).alias("whole"), F.lit(len(rare)).alias("rare")))
    places = F.create_map(*[c for w, p in sorted(postings.items()) for c in (F.lit(w), F.array(*p))])
    return spark.range(1).select(F.array(*rows).alias("__templates"), places.alias("__postings"))


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row a row of ``docs``.

    score is the best share of a found template's IDF weight that stands at the aligned places, 0 without
    any. A null or empty text has no words: counts 0, places null, labels ''. Texts are read whole, however long. Repeated rows give repeated
    rows, an empty table an empty result. Only doc_id and text are read. Places that overlap all count.

    The index is one row, of the size of the collection, that a broadcast join puts beside every document; no template stands in an expression.
    """
    names = sorted({w for t in templates for w, _ in rare_words(t, idf(templates))})
    df = docs.select("doc_id", F.split(F.translate(F.coalesce(F.col("text"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase), SEPARATOR, -1).alias("__parts"))
    df = df.select("doc_id", words_of(F.col("__parts")).alias("__words"))
    rare = let(F.col("__words"), lambda words: F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(names), F.struct(i.alias("p"), w.alias("w"))))))
    df = df.withColumn("__hits", rare).select("doc_id", F.size("__words").cast("long").alias("n_words"), "__hits", F.when(F.size("__hits") > 0, F.col("__words")).alias("__words"))
    df = df.crossJoin(F.broadcast(index(docs.sparkSession, templates)))  # one row

    def template(t: Column) -> Column:
        return F.get("__templates", t)

    def agreeing(all_: Column) -> Column:
        """The starts on which a template's rare words all agree: of the sorted candidates, runs of as many as it has."""
        of = lambda x: F.struct(x["t"], x["s"])
        run = F.transform(all_, lambda x, i: F.when(of(F.get(all_, i + template(x["t"])["rare"] - 1)).eqNullSafe(of(x)), F.struct(x["t"].alias("t"), x["s"].alias("s"))))
        return F.array_distinct(F.array_compact(run))

    looked_up = F.flatten(F.transform("__hits", lambda h: F.transform(F.element_at("__postings", h["w"]), lambda x: F.struct(x["t"].alias("t"), (h["p"] - x["place"]).alias("s"), x["place"].alias("place")))))
    candidates = let(F.array_sort(looked_up), agreeing)
    verified = F.filter(candidates, lambda c: (c["s"] >= 0) & (F.slice("__words", F.greatest(c["s"], F.lit(0)) + 1, F.size(template(c["t"])["key"])) == template(c["t"])["key"]))

    def share(c: Column) -> Column:
        t, first = template(c["t"]), c["s"] - template(c["t"])["at"]
        own = lambda w, j: F.when((first + j >= 0) & F.get("__words", F.greatest(first + j, F.lit(0))).eqNullSafe(w), F.get(t["weights"], j)).otherwise(0.0)
        return F.round(F.aggregate(F.transform(t["notice"], own), F.lit(0.0), lambda a, x: a + x) / t["whole"], 6)

    found = F.transform(verified, lambda c: F.struct(c["s"].alias("s"), template(c["t"])["label"].alias("label"), template(c["t"])["base"].alias("base"), share(c).alias("share")))
    none = F.array().cast("array<struct<s:int,label:string,base:boolean,share:double>>")
    df = df.select("doc_id", "n_words", F.when(F.size("__hits") > 0, found).otherwise(none).alias("f"))

    def result(f: Column) -> Column:
        places = F.transform(F.filter(f, lambda x: x["base"]), lambda x: x["s"])
        label = lambda g: F.array_join(F.array_sort(F.array_distinct(F.transform(g, lambda x: x["label"]))), ",")
        best = F.coalesce(F.array_max(F.transform(f, lambda x: x["share"])), F.lit(0.0))
        return F.struct(F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"), label(F.filter(f, lambda x: x["base"])).alias("base_labels"), label(f).alias("labels"), best.alias("score"))

    return df.select("doc_id", "n_words", let(F.col("f"), result).alias("r")).select("doc_id", "n_words", "r.*")
