"""Licence scans by the Dice coefficient of word bigrams, with column functions only.

Every line, paragraph and whole text of a document is normalised (lower case, runs of other characters than letters,
digits and full stops inside numbers become spaces) and compared with each licence template. With a Dice of at least
THRESHOLD the sizes of the two bigram sets differ by a bounded factor, so units and templates outside it are pruned
before any set is built. Notices inside longer lines and paragraphs are met by windows: from every place of the text that
has a bigram of a template, as many bigrams as the template has. SPDX ids must be met exactly, as those of other versions
differ in one word. The templates are a fixed literal, a few kilobytes: names in frames, ids, standard headers and the
grants of the short licences; the long bodies of the GNU, Mozilla, Apache and CC licences are not among them. Texts
without any of the anchors, words that every match must have some of, are passed over.

A document gets its best template (ties: the longest, then the first by name), or null and a Dice of 0. Null and empty texts and units of
one word match nothing. Rows are independent: repeated rows and other columns change nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.75
# Wording of licence notices.
NAMES = {
    "MIT": "MIT License", "Apache-2.0": "Apache License, Version 2.0", "GPL-2.0": "GNU General Public License, version 2",
    "GPL-3.0": "GNU General Public License, version 3", "LGPL-3.0": "GNU Lesser General Public License, version 3", "AGPL-3.0": "GNU Affero General Public License, version 3",
    "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "MPL-2.0": "Mozilla Public License, version 2.0", "ISC": "ISC License",
    "CC-BY-4.0": "CC BY 4.0", "CC-BY-SA-4.0": "CC BY-SA 4.0", "CC-BY-NC-4.0": "CC BY-NC 4.0", "CC-BY-ND-4.0": "CC BY-ND 4.0", "CC0-1.0": "CC0 1.0", "Unlicense": "Unlicense",
}
FRAMES = ("Licensed under {}", "Licensed under the {}", "Released under the {}", "This work is licensed under the {}", "This work is licensed under {}")
TEXTS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License", "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
SPDX = "SPDX-License-Identifier: {}"
#: Ids of the GNU licences end so.
ENDINGS = ("", "-only", "-or-later")


def _bigrams(text: str) -> list[str]:
    words = re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def templates(threshold: float = THRESHOLD) -> list[tuple[str, list[str], float]]:
    """Name, bigrams and least Dice of each template."""
    pairs = {(k, f.format(n), threshold) for k, n in NAMES.items() for f in FRAMES} | {(k, t, threshold) for k, t in TEXTS.items()}
    pairs |= {(k, SPDX.format(k + e), 1.0) for k in NAMES for e in (ENDINGS if "GPL" in k else ("",))}
    return [(k, b, least) for k, t, least in sorted(pairs) if (b := _bigrams(t))]


def anchors(threshold: float = THRESHOLD) -> list[str]:
    """Words without one of which no template can be met: a text with its least Dice d has a share of d / (2 - d) of a
    template's bigrams, and fewer of them than that are without an anchor. Long words go before short ones."""
    known, chosen = templates(threshold), ["licen"]
    bare = lambda b: [x for x in b if not any(w in x for w in chosen)]
    while open_ := [bare(b) for _, b, least in known if len(bare(b)) >= len(b) * least / (2 - least)]:
        words = Counter(w for b in open_ for x in b for w in set(x.split()) if len(w) > 5 or (len(w) > 2 and not w.isalpha()))
        words = words or Counter(w for b in open_ for x in b for w in x.split())
        chosen.append(min(words, key=lambda w: (-words[w], w)))
    return chosen


def scanned(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice."""
    known = templates(threshold)
    small, large = threshold / (2 - threshold), (2 - threshold) / threshold
    low, high = min(len(b) for _, b, _ in known) * small, max(len(b) for _, b, _ in known) * large
    literal = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*[F.lit(x) for x in b]).alias("b"), F.lit(least).alias("least")) for k, b, least in known])
    names = sorted({x for _, b, _ in known for x in b})
    vocabulary = F.array(*[F.lit(x) for x in names])
    # A text without an anchor meets no template: it is scanned as an empty one.
    # Generated columns, so that each is worked out once and not in every expression that reads it.
    docs = docs.select("doc_id", F.explode(F.array(F.lower(F.coalesce("text", F.lit(""))))).alias("low"))
    found = reduce(lambda a, b: a | b, [F.contains(F.col("low"), F.lit(w)) for w in anchors(threshold)])
    docs = docs.select("doc_id", F.explode(F.array(F.when(found, F.col("low")).otherwise(""))).alias("text"))
    text = F.col("text")
    units = F.array_distinct(F.concat(F.split(text, r"\n"), F.split(text, r"\n\s*\n"), F.array(text)))
    # A unit of n words has at most n - 1 bigrams, and a word takes two characters with its space.
    units = F.filter(units, lambda u: (F.length(u) >= 2 * int(low)) & (F.regexp_count(u, F.lit(r"[a-z0-9]+(?:\.[0-9]+)*")) - 1 >= F.lit(low)))

    def ordered(u: Column) -> Column:
        words = F.regexp_extract_all(u, F.lit(r"[a-z0-9]+(?:\.[0-9]+)*"), F.lit(0))
        pairs = F.greatest(F.size(words) - 1, F.lit(0))
        return F.zip_with(F.slice(words, F.lit(1), pairs), F.slice(words, F.lit(2), pairs), lambda a, b: F.concat(a, F.lit(" "), b))

    def bigrams(u: Column) -> Column:
        return F.array_distinct(ordered(u))

    sets = F.filter(F.transform(units, bigrams), lambda s: (F.size(s) >= F.lit(low)) & (F.size(s) <= F.lit(high)) & F.arrays_overlap(s, vocabulary))

    def dice(s: Column, t: Column) -> Column:
        return F.struct((-2.0 * F.size(F.array_intersect(s, t["b"])) / (F.size(s) + F.size(t["b"]))).alias("d"), (-F.size(t["b"])).alias("m"), t["k"].alias("k"), t["least"].alias("least"))

    def best(s: Column) -> Column:
        fit = F.filter(literal, lambda t: (F.size(t["b"]) >= F.size(s) * F.lit(small)) & (F.size(t["b"]) <= F.size(s) * F.lit(large)))
        return F.transform(fit, lambda t: dice(s, t))

    def windows(t: Column) -> Column:
        """From each place that has one of the template's bigrams, the set of as many bigrams as it has."""
        starts = F.filter("places", lambda x: F.array_contains(t["b"], x["w"]))
        enough = F.size(F.array_intersect(F.col("met"), t["b"])) >= F.size(t["b"]) * F.lit(small)
        return F.when(enough, F.transform(starts, lambda x: dice(F.array_distinct(F.slice("words", x["i"], F.size(t["b"]))), t))).otherwise(F.array().cast("array<struct<d:double,m:int,k:string,least:double>>"))

    rows = docs.select("doc_id", sets.alias("sets"), ordered(text).alias("words"))
    places = F.filter(F.transform("words", lambda w, i: F.when(w.isin(names), F.struct((i + 1).alias("i"), w.alias("w")))), lambda x: x.isNotNull())
    rows = rows.withColumn("places", places).withColumn("met", F.array_distinct(F.col("places.w")))
    both = F.concat(F.flatten(F.transform(F.col("sets"), best)), F.when(F.size("met") > 0, F.flatten(F.transform(literal, windows))).otherwise(F.array().cast("array<struct<d:double,m:int,k:string,least:double>>")))
    top = F.array_min(F.filter(both, lambda x: x["d"] <= -x["least"]))
    rows = rows.select("doc_id", top.alias("top"))
    return rows.select("doc_id", F.col("top.k").alias("license"), F.round(F.coalesce(-F.col("top.d"), F.lit(0.0)), 6).alias("dice"))
