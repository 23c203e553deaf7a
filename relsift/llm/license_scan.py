"""Licence scan by sentence rules. DataFrame functions only.

A text is cut into pieces (at line ends, and after ``. ! ? :`` before white space), each
normalised to lower-case letters and digits. Every run of a known sentence's words is a row
of a lookup table; a piece that equals such a run may be that part of the sentence. Where
neighbouring pieces, over blank lines and comment marks, lie at the places that one start
of the sentence gives them and add up to all its words, they are the sentence, wrapped at
any column. The table grows with the licence list alone and is met by an equality join, so
a text costs the same whatever the number of sentences. A document's identifiers in text
order are matched against rules: ordered identifier sequences, between whose members other
sentences may stand.
"""

from __future__ import annotations

import re
from itertools import pairwise

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

# Licence sentences by identifier, and the ordered rules.
SENTENCES = {
    "mit-1": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-2": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-name": "The MIT License",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-spdx": "SPDX-License-Identifier: MIT",
    "apache2-licensed": "Licensed under the Apache License, Version 2.0.",
    "apache2-header-1": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache2-header-2": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache2-spdx": "SPDX-License-Identifier: Apache-2.0",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-spdx": "SPDX-License-Identifier: GPL-3.0-only",
    "gpl-header-1": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-header-2": "See the GNU General Public License for more details.",
    "ccbync4-licensed": "Licensed under CC BY-NC 4.0.",
    "ccby4-licensed": "Licensed under CC BY 4.0.",
    "ccbysa4-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "bsd-1": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-2": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-3": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "all-rights": "All rights reserved.",
    "isc-1": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-1": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "mpl2-1": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2-2": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "gpl2-header-1": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "agpl3-header-1": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-header-2": "See the GNU Affero General Public License for more details.",
    "lgpl21-header-1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-header-1": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-header-2": "See the GNU Lesser General Public License for more details.",
    "zlib-1": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-2": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "unlicense-1": "This is free and unencumbered software released into the public domain.",
    "unlicense-2": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "bsl-1": "Distributed under the Boost Software License, Version 1.0.",
    "epl2-1": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc0-1": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "ccby4-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ccbync4-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "ccbyncsa4-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "ccbynd4-work": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
}
#: Licences known by their short identifier too, besides MIT, Apache-2.0 and GPL-3.0-only above.
SPDX = ("BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-or-later",
        "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later",
        "Zlib", "Unlicense", "BSL-1.0", "EPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")
SENTENCES |= {f"{name.lower()}-spdx": f"SPDX-License-Identifier: {name}" for name in SPDX}
RULES = (
    ("MIT", ("mit-1", "mit-2")),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-spdx",)),
    ("Apache-2.0", ("apache2-header-1", "apache2-header-2")),
    ("Apache-2.0", ("apache2-licensed",)),
    ("Apache-2.0", ("apache2-spdx",)),
    ("GPL-3.0", ("gpl-header-1", "gpl-header-2")),
    ("GPL-3.0", ("gpl3-work",)),
    ("GPL-3.0", ("gpl3-spdx",)),
    ("CC-BY-NC-4.0", ("ccbync4-licensed",)),
    ("CC-BY-4.0", ("ccby4-licensed",)),
    ("CC-BY-SA-4.0", ("ccbysa4-work",)),
    ("BSD-3-Clause", ("bsd-1", "bsd-2", "bsd-3")),
    ("BSD-2-Clause", ("bsd-1", "bsd-2")),
    ("ISC", ("isc-1",)),
    ("0BSD", ("0bsd-1",)),
    ("MPL-2.0", ("mpl2-1", "mpl2-2")),
    ("GPL-2.0-or-later", ("gpl2-header-1", "gpl-header-2")),
    ("AGPL-3.0-or-later", ("agpl3-header-1", "agpl3-header-2")),
    ("LGPL-2.1-or-later", ("lgpl21-header-1", "lgpl-header-2")),
    ("LGPL-3.0-or-later", ("lgpl3-header-1", "lgpl-header-2")),
    ("Zlib", ("zlib-1", "zlib-2")),
    ("Unlicense", ("unlicense-1", "unlicense-2")),
    ("BSL-1.0", ("bsl-1",)),
    ("EPL-2.0", ("epl2-1",)),
    ("CC0-1.0", ("cc0-1",)),
    ("CC-BY-4.0", ("ccby4-work",)),
    ("CC-BY-NC-4.0", ("ccbync4-work",)),
    ("CC-BY-NC-SA-4.0", ("ccbyncsa4-work",)),
    ("CC-BY-ND-4.0", ("ccbynd4-work",)),
    *((name, (f"{name.lower()}-spdx",)) for name in SPDX),
)

SENTENCE_END = r"(?:[\n\r]+|(?<=[.!?])[ \t]+)+"


def normalise_sentence(text: str) -> str:
    """Lower-case ASCII letters and digits, other runs as one space."""
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def known_sentences(sentences: dict[str, str] = SENTENCES) -> dict[str, str]:
    """Normalised sentence -> identifier. A known text that holds several sentences
    is cut like a document and counts by its first part."""
    out = {}
    for name, text in sentences.items():
        parts = [p for p in map(normalise_sentence, re.split(SENTENCE_END, text)) if p]
        out[parts[0]] = name
    return out


def sentence_runs(spark: SparkSession, sentences: dict[str, str] = SENTENCES) -> DataFrame:
    """``run, sentence_id, sentence, n, lo``: the hash of each run of a known sentence's
    words, the sentence's number of words and those before the run. A sentence of n words
    has n (n + 1) / 2 runs; the size follows from the licence list."""
    known = spark.createDataFrame(sorted(known_sentences(sentences).items()), "sentence string, sentence_id string")
    known = known.withColumn("w", F.split("sentence", " ")).withColumn("n", F.size("w"))
    runs = known.withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn(
        "hi", F.explode(F.sequence(F.col("lo") + 1, "n")))
    run = F.array_join(F.slice("w", F.col("lo") + 1, F.col("hi") - F.col("lo")), " ")
    return runs.select(F.xxhash64(run).alias("run"), "sentence_id", "sentence", "n", "lo")


def text_pieces(docs: DataFrame, sentences: dict[str, str] = SENTENCES) -> DataFrame:
    """``doc_id, _row, nth, pos, piece`` of the pieces that may be part of a known sentence:
    they are one, or their border with a neighbour is that of two words which follow one
    another in one. ``nth`` counts a row's pieces with words, ``pos`` the stretches between
    line ends and after ``. ! ?``, also those without a word."""
    text = F.regexp_replace(F.translate(F.lower("text"), "\t", " "), SENTENCE_END, "\n")
    text = F.regexp_replace(F.regexp_replace(text, ": +", "\t"), "[^a-z0-9\n\t]+", " ")
    cut = F.flatten(F.transform(F.split(text, "\n"), lambda part, pos: F.transform(
        F.split(part, "\t"), lambda piece: F.struct(pos.alias("pos"), F.trim(piece).alias("piece")))))
    known = sorted(known_sentences(sentences))
    pairs = sorted({f"{a} {b}" for s in known for a, b in pairwise(s.split())})
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), F.filter(cut, lambda x: x["piece"] != "").alias("_c"))

    def follows(x, i):
        """Whether the border of a piece with the one before is a known pair of words."""
        last = F.substring_index(F.get("_c", i - 1)["piece"], " ", -1)
        return F.coalesce(F.concat(last, F.lit(" "), F.substring_index(x["piece"], " ", 1)).isin(pairs), F.lit(False))

    def marked(x, i):
        near = F.get("_follows", i) | F.coalesce(F.get("_follows", i + 1), F.lit(False))
        return F.struct(i.alias("nth"), x["pos"].alias("pos"), x["piece"].alias("piece"), (near | x["piece"].isin(known)).alias("may"))

    rows = rows.withColumn("_follows", F.transform("_c", follows))
    some = F.filter(F.transform("_c", marked), lambda x: x["may"])
    return rows.select("doc_id", "_row", F.explode(some).alias("_p")).select("doc_id", "_row", "_p.nth", "_p.pos", "_p.piece")


def known_places(spark: SparkSession, docs: DataFrame, sentences: dict[str, str] = SENTENCES) -> DataFrame:
    """``doc_id, _row, pos, nth, sentence_id``: each known sentence of each row of ``docs``,
    at its first piece. Of sentences that share a piece the longest counts (all of them, if
    of one length)."""
    pieces = text_pieces(docs, sentences).withColumn("words", F.size(F.split("piece", " ")))
    runs = written(sentence_runs(spark, sentences), "license-runs")  # a table's size is known to the planner
    parts = pieces.withColumn("run", F.xxhash64("piece")).join(runs, "run")
    parts = written(parts, "license-parts")  # numbers of rows are drawn once, and texts are cut once
    # neighbouring pieces that are parts of something make a stretch; places are counted in it
    each = parts.groupBy("_row", "nth").agg(F.first("words").alias("words"))
    by_row = Window.partitionBy("_row").orderBy("nth")
    each = each.withColumn("stretch", F.col("nth") - F.row_number().over(by_row))
    each = each.withColumn("before", F.sum("words").over(by_row.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words"))
    placed = parts.join(each.drop("words"), ["_row", "nth"]).withColumn("start", F.col("before") - F.col("lo"))
    one = ["_row", "stretch", "sentence_id", "start"]
    whole = (placed.groupBy("doc_id", *one, "sentence", "n")
             .agg(F.sum("words").alias("covered"), F.array_sort(F.collect_list(F.struct("nth", "pos", "piece"))).alias("p"))
             .where((F.col("covered") == F.col("n")) & (F.array_join("p.piece", " ") == F.col("sentence"))))
    own = whole.select("doc_id", *one, "n", F.col("p")[0]["pos"].alias("pos"), F.col("p")[0]["nth"].alias("first"), F.explode("p.nth").alias("nth"))
    longest = own.withColumn("longest", F.max("n").over(Window.partitionBy("_row", "nth")))
    return (longest.groupBy("doc_id", *one, "n", "pos", "first").agg(F.max("longest").alias("longest")).where(F.col("longest") == F.col("n"))
            .select("doc_id", "_row", "pos", F.col("first").alias("nth"), "sentence_id"))


def scan_licenses(spark: SparkSession, docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """``doc_id, n_sentences, first_pos, last_pos, sentence_ids, licenses`` of each
    document with at least one known sentence.

    Positions number the pieces between line ends and after ``. ! ?``; a sentence has its
    first piece's. ``sentence_ids`` lists identifiers in text order and ``licenses`` the
    matched rules' names, distinct and sorted; both are comma-joined, ``licenses`` is ''
    when known sentences stand there but no rule is complete. A sentence that shares a
    piece with a longer one does not count. Null and empty texts give no row; equal
    sentences count each time; rows that share a doc_id are one document whose sentences
    are merged by position, and each row without an id is one of its own."""
    hits = known_places(spark, docs.select("doc_id", "text"), sentences)
    alone = F.when(F.col("doc_id").isNull(), F.col("_row"))
    seq = (hits.groupBy("doc_id", alone.alias("_alone"))
           .agg(F.array_sort(F.collect_list(F.struct("pos", "nth", "sentence_id"))).alias("h"))
           .select("doc_id", "h", F.array_join(F.col("h.sentence_id"), ",").alias("sentence_ids")))
    padded = F.concat(F.lit(","), F.col("sentence_ids"), F.lit(","))
    names = [F.when(padded.rlike(rule_pattern(ids)), F.lit(name)) for name, ids in rules]
    licenses = F.array_sort(F.array_distinct(F.filter(F.array(*names), lambda x: x.isNotNull())))
    return seq.select("doc_id", F.size("h").cast("long").alias("n_sentences"),
                      F.col("h")[0]["pos"].alias("first_pos"), F.element_at("h", -1)["pos"].alias("last_pos"),
                      "sentence_ids", F.array_join(licenses, ",").alias("licenses"))


def rule_pattern(ids) -> str:
    """Regular expression over ``,id,id,``: the rule's identifiers in order, others between."""
    return "," + ",(?:[^,]+,)*".join(re.escape(i).replace("\\-", "-") for i in ids) + ","
