"""License scans by diagonal voting, in DataFrame terms only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm.quality_rules import split_words

K = 3
DRIFT = 3
COVERAGE = 0.75
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The phrases of the base labels.
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}

# Public licence texts, their openings and notices; phrases of each
# that tell it from others (any three words of one do), and phrases that tell
# others from it.
NOTICES = [
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
        notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        ["to deal in the"],
    ),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", ["to deal in the"]),
    ("mit", "released under the MIT License", ["the mit license"]),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
        notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES
        OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        ["any purpose with or"],
    ),
    (
        "bsd-2",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
        [],
        ["neither the name of"],
    ),
    (
        "bsd-3",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific
        prior written permission.""",
        ["neither the name of"],
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of
        this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely,
        subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.""",
        ["authors be held liable for"],
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
        either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
        ["and unencumbered software released into"],
    ),
    (
        "bsl-1",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
        (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software""",
        ["any person or organization obtaining"],
    ),
    ("apache-2", "Licensed under the Apache License, Version 2.0", ["license version 2 0"]),
    (
        "apache-2",
        """you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required
        by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        ["www apache org", "licenses license 2 0"],
    ),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ["www apache org", "licenses license 2 0"]),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", ["the mozilla public license"]),
    ("cc-by-nc", "licensed under CC BY-NC 4.0", ["by nc 4 0"]),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["attribution noncommercial 4 0"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["commons attribution 4 0"]),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["commons attribution sharealike 4"]),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", ["commons attribution noderivatives 4"]),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", ["attribution noncommercial sharealike 4"]),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ["related or neighboring rights to"]),
    ("gpl-3", "this work is licensed under the GNU General Public License version 3", ["the gnu general public", "license version 3"]),
    ("gpl-2", "this work is licensed under the GNU General Public License version 2", ["the gnu general public", "license version 2"]),
    *(
        (
            label,
            f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation,
            either version {version} of the License, or (at your option) any later version.""",
            [f"the gnu {name.lower().removesuffix(' license')}", f"either version {version} of the"],
        )
        for label, name, version in (("gpl-2", "General Public License", 2), ("gpl-3", "General Public License", 3), ("lgpl-3", "Lesser General Public License", 3), ("agpl-3", "Affero General Public License", 3))
    ),
    (
        "apache-2",
        """TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as
        defined by Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.""",
        ["sections 1 through 9 of this document"],
    ),
    (
        "gpl-2",
        """The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee
        your freedom to share and change free software--to make sure the software is free for all its users.""",
        ["most software are designed", "change it by contrast"],
    ),
    (
        "gpl-3",
        """The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed
        to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of
        a program--to make sure it remains free software for all its users.""",
        ["and other practical works", "contrast the gnu general public"],
    ),
    (
        "lgpl-3",
        """This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the
        additional permissions listed below.""",
        ["public license incorporates the"],
    ),
    (
        "agpl-3",
        """The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community
        in the case of network server software.""",
        ["specifically designed to ensure cooperation"],
    ),
    (
        "mpl-2",
        """1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. 1.2. "Contributor Version" means the
        combination of the Contributions of others (if any) used by a Contributor and that particular Contributor's Contribution.""",
        ["owns covered software"],
    ),
]


def template_words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATOR, text.lower()) if w]


def phrase_grams(phrases: list[str]) -> list[set[str]]:
    return [{" ".join(w[i : i + K]) for i in range(len(w) - K + 1)} for w in (p.split() for p in phrases)]


def template_rows() -> list[tuple]:
    """(template, label, base, n_grams, n_telling, tpos, phrase, words): the
    k-grams of the fixed templates; phrase is the number of a telling phrase it
    is in, and -1 for those of other licences' phrases, which are put where the
    like of them ends in the template."""
    rows = []
    for i, (label, text, base, telling, *against) in enumerate([*((x, t, True, []) for x, t in PHRASES.items()), *((x, t, False, *rest) for x, t, *rest in NOTICES)]):
        words = template_words(text)
        n, told = len(words) - K + 1, phrase_grams(telling)
        for p in range(n):
            gram = " ".join(words[p : p + K])
            rows.append((i, label, base, n, len(told), p, next((j for j, g in enumerate(told, 1) if gram in g), 0), words[p : p + K]))
        for gram in sorted(set().union(*phrase_grams([x for xs in against for x in xs]))):
            rows.append((i, label, base, n, len(told), n // 2, -1, gram.split()))
    return rows


def template_grams(spark: SparkSession) -> DataFrame:
    """The templates' rows, some two thousand, their words hashed, and one row
    (template -1) that every document's closing mark meets."""
    grams = spark.createDataFrame(template_rows(), "template int, label string, base boolean, n_grams int, n_telling int, tpos int, phrase int, words array<string>")
    grams = grams.select("template", "label", "base", "n_grams", "n_telling", "tpos", "phrase", *_hashed([F.get("words", F.lit(k)) for k in range(K)]))
    mark = spark.createDataFrame([(-1, None, False, 0, 0, 0, 0, 0, 0)], grams.schema)
    return grams.union(mark)


def _hashed(words: list[Column]) -> list[Column]:
    """96 bits of some words: the key of the join and its check."""
    return [F.xxhash64(*words).alias("hash"), F.hash(*words).alias("check")]


def words_of(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return split_words(F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), SEPARATOR)


def _bands(docs: DataFrame) -> DataFrame:
    """A row for each document, template and diagonal with a vote (and one of
    template -1 for every document): which of the template's places are found on
    it and on those above, as far as words may be put in or left out: a third of
    the template's length."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))

    def grams(w: Column) -> Column:
        at = F.transform(F.sequence(F.lit(0), F.size(w) - K), lambda i: F.struct(i.alias("pos"), *_hashed([F.get(w, i + k) for k in range(K)])))
        end = F.array(F.struct(F.size(w).alias("pos"), F.lit(0).cast("long").alias("hash"), F.lit(0).alias("check")))
        return F.when(F.size(w) >= K, F.concat(at, end)).otherwise(end)

    votes = rows.select("rid", "doc_id", F.inline(F.transform(F.array("words"), grams)[0]))
    met = votes.join(F.broadcast(template_grams(spark)), ["hash", "check"]).repartition("rid")
    marked = F.col("template") < 0
    keys = ["rid", "doc_id", "template", "label", "base", "n_grams", "n_telling"]
    own = F.col("phrase") >= 0
    lines = met.groupBy(*keys, F.when(marked, 0).otherwise(F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.max(F.when(marked, F.col("pos"))).alias("n_words"),
        F.collect_set(F.when(own, F.col("tpos"))).alias("places"),
        F.collect_set(F.when(F.col("phrase") != 0, F.col("phrase"))).alias("telling"),
    )
    reach = F.floor(F.col("n_grams") / DRIFT).cast("int")
    widest = max(row[3] for row in template_rows()) // DRIFT
    band = Window.partitionBy("rid", "template").orderBy("diagonal").rangeBetween(0, widest)
    lines = lines.withColumn("band", F.collect_list(F.struct("diagonal", "places", "telling")).over(band)).withColumn("band", F.filter("band", lambda x: x["diagonal"] <= F.col("diagonal") + reach))

    def distinct(name: str) -> Column:
        return F.array_distinct(F.flatten(F.col("band")[name]))

    told = distinct("telling")
    found = F.when(F.col("base"), F.size("places")).otherwise(F.size(distinct("places")))
    return lines.select(*keys, "diagonal", "n_words", reach.alias("reach"), "band", found.alias("found"), F.size(F.filter(told, lambda x: x > 0)).alias("told"), F.array_contains(told, -1).alias("against"))


def _in_order(band: Column) -> Column:
    """(places, start, end): how many places of a template stand in a band in the
    template's order, by the longest rising sequence of their places in the text
    (the smallest last place that a sequence of each length can have is kept),
    and from where to where such places stand."""
    votes = F.flatten(F.transform(band, lambda x: F.transform(x["places"], lambda t: F.struct(t.alias("t"), (-(x["diagonal"] + t)).alias("back")))))

    def onward(last: Column, vote: Column) -> Column:
        at = -vote["back"]
        n = F.size(F.filter(last, lambda x: x < at))
        return F.when(n == F.size(last), F.array_append(last, at)).otherwise(F.transform(last, lambda x, i: F.when(i == n, at).otherwise(x)))

    rising = F.aggregate(F.array_sort(votes), F.array().cast("array<int>"), onward)
    return F.struct(F.size(rising).alias("places"), (-F.array_max(F.transform(votes, lambda x: x["back"]))).alias("start"), (-F.array_min(F.transform(votes, lambda x: x["back"])) + K).alias("end"))


def _verdict(bands: DataFrame) -> DataFrame:
    """Of a notice's overlapping bands the one that finds most stays, of equal
    ones the first, and is verified by what it finds in order."""
    share = F.col("found") / F.col("n_grams")
    stands = F.col("base") & (F.col("found") == F.col("n_grams"))
    notice = ~F.col("base") & (F.col("n_grams") > 0)
    widest = max(row[3] for row in template_rows()) // DRIFT
    near = Window.partitionBy("rid", "template").orderBy("diagonal").rangeBetween(-widest, widest)
    marked = bands.withColumn("around", F.when(notice & (share >= COVERAGE), F.collect_list(F.struct("diagonal", "found")).over(near)))
    better = F.exists("around", lambda x: (F.abs(x["diagonal"] - F.col("diagonal")) <= F.col("reach")) & ((x["found"] > F.col("found")) | ((x["found"] == F.col("found")) & (x["diagonal"] < F.col("diagonal")))))
    asked = notice & (share >= COVERAGE) & ~better
    judged = marked.withColumn("order", F.when(asked, _in_order(F.col("band")))).drop("around", "band")
    held = F.coalesce(F.col("order.places"), F.col("found")) / F.col("n_grams")
    verified = F.col("order").isNotNull() & (held >= COVERAGE) & (F.col("told") == F.col("n_telling")) & ~F.col("against")
    return judged.withColumns({
        "stands": stands,
        "verified": stands | verified,
        "share": F.when(stands, 1.0).when(F.col("order").isNotNull(), held).when(notice & (share < COVERAGE), share).otherwise(0.0),
        "start_word": F.coalesce(F.col("order.start"), F.col("diagonal")),
        "end_word": F.coalesce(F.col("order.end"), F.col("diagonal") + F.col("n_grams") + K - 1),
    })


def license_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, label, start_word, end_word, share): where
    licence phrases and notices stand, in words from 0. Of overlapping spans of
    one template the best stays, of equal ones the first."""
    kept = _verdict(_bands(docs)).where("verified")
    return kept.select("doc_id", "label", F.col("start_word").cast("long").alias("start_word"), F.col("end_word").cast("long").alias("end_word"), "share")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score; one row for each row.

    All rolling 3-grams of words, hashed, meet the templates' by a join; votes
    are counted by document, template and diagonal (place in the text less
    place in the template). A base phrase stands where its diagonal has all its
    votes. A notice's neighbouring diagonals are merged from each one up, as far
    as a third of the notice's length: so many words may be put in or left out.
    Of overlapping bands the fullest is verified: 75 % of the notice's 3-grams
    have to stand in it in the notice's order, with a 3-gram at least of each
    phrase that tells the licence from others and none of those that tell others
    from it, so a line's end or number within a phrase breaks nothing. score is
    the best share found, in order where it reaches 75 %, verified or not, and 1
    for a base phrase.

    A null text has no words; repeated rows are scanned each; a null doc_id is
    kept; other columns are ignored; an empty table gives an empty table. A
    text full of licences votes within its own rows, so none meets another's;
    work and memory grow in proportion to its length.
    """
    judged = _verdict(_bands(docs))
    return judged.groupBy("rid", "doc_id").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.sum(F.col("stands").cast("long")).alias("n_base"),
        F.min(F.when(F.col("stands"), F.col("diagonal").cast("long"))).alias("first_word"),
        F.max(F.when(F.col("stands"), F.col("diagonal").cast("long"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("stands"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("verified"), F.col("label")))), ",").alias("labels"),
        F.max("share").alias("score"),
    ).drop("rid")
