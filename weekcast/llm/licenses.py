"""License scans with DataFrame functions only: MinHash bands of overlapping windows, exact containment.

Texts and templates are split into words (lower case, runs of letters and digits) and shingles of
``SHINGLE`` words. A template of n words is looked for in windows of W words, W the power of two
from 4n/3 on, that start every W/4 words, so that every passage of n words lies whole in some window
and fills more than a third of it. Windows without any template shingle can't match and are left out;
of the others ``BANDS`` MinHash values (bands of one row) are joined with those of the templates of that
window size. A window takes along its own shingles alone, so the work grows with a text's length. A passage that holds the least containment of a template has a Jaccard similarity of
at least ``0.8 / (8/3 + 0.2)``, 0.28, with it there: the chance that none of the bands is equal is below
``0.72**32``, 3 in 100,000. Candidates are verified by the exact share of the template's shingles in the window.

Templates are a small table that is collected and broadcast; more than ``MOST_SHINGLES`` distinct
shingles are refused. Documents aren't shuffled but for their matches.

Defined cases: null and empty texts and those shorter than a shingle match nothing, nor do such
templates; rows with a null id take no part; rows that repeat an id are one document; of notices in overlapping windows the weaker whose found shingles
all belong to the better is not reported, and all are if tied; a template that
comes twice under one name counts once; without templates or documents the result is empty; other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SHINGLE = 3
CONTAINMENT = 0.8
BANDS = 32
LEAST_WINDOW = 4
MOST_SHINGLES = 200_000
CELL = 64

#: Notices that are looked for (fixed values): name and text.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL", "You should have received a copy of the GNU Affero General Public License along with this program."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("all-rights-reserved", "All rights reserved."),
    # titles and the passages that follow the opening ones
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "MIT License Copyright (c)"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD", "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed."),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness."),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("LGPL", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("AGPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    # further families
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Zlib", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("Artistic-2.0", "This program is free software; you may redistribute it and/or modify it under the terms of the Artistic License 2.0."),
    ("Artistic-2.0", "The Artistic License 2.0 Copyright (c) 2000-2006, The Perl Foundation."),
    ("WTFPL", "Do What The Fuck You Want To Public License"),
    ("CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License"),
    ("EUPL-1.2", "Licensed under the European Union Public Licence v1.2"),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("PSF-2.0", "Python Software Foundation License Version 2"),
    ("PostgreSQL", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]

#: Identifiers of licenses by SPDX (fixed values); each is looked for as a line ``SPDX-License-Identifier: ...``.
SPDX = (
    "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 "
    "CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 CC0-1.0 CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only "
    "GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-2.0 MS-PL NCSA OFL-1.1 PostgreSQL "
    "PSF-2.0 Unlicense UPL-1.0 WTFPL Zlib"
).split()
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in SPDX]


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "name string, text string")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    """Hashes of the runs of SHINGLE words; ``words`` must be a column, not an expression, to be computed once."""
    run = F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(SHINGLE)]))
    return F.when(F.size(words) >= SHINGLE, run)


def _bands(shingles: Column) -> Column:
    def least(n: int) -> Column:
        return F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, F.lit(n))))

    return F.array(*[least(n) for n in range(BANDS)])


def window_of(n_words: int) -> int:
    return max(LEAST_WINDOW, 1 << math.ceil(math.log2(4 * n_words / 3)))


def scan(docs: DataFrame, notices: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_col: str = "name", notice_col: str = "text") -> DataFrame:
    """``id_col``, ``license`` (the notice's name), ``containment`` (the best), ``n_windows`` that hold it and
    ``first_word``: where the first of them starts."""
    spark = docs.sparkSession
    known = notices.select(F.col(name_col).alias("license"), _words(F.col(notice_col)).alias("words")).where("license IS NOT NULL").distinct()
    known = known.withColumn("own", _shingles(F.col("words"))).where("own IS NOT NULL").select("license", F.size("words").alias("n"), F.array_distinct("own").alias("own"))
    found = known.agg(F.collect_set("n").alias("sizes"), F.array_distinct(F.flatten(F.collect_list("own"))).alias("all")).first()
    anchors, windows = found["all"], sorted({window_of(n) for n in found["sizes"]})
    kind = docs.schema[id_col].dataType.simpleString()
    if not anchors:
        return spark.createDataFrame([], f"{id_col} {kind}, license string, containment double, n_windows long, first_word int")
    if len(anchors) > MOST_SHINGLES:
        raise ValueError(f"the notices have {len(anchors)} distinct shingles; at most {MOST_SHINGLES} are broadcast")
    size = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") * 4 / 3))).cast("int")
    known = known.withColumn("window", F.greatest(F.lit(LEAST_WINDOW), size))
    keys = known.select("license", "own", "window", F.posexplode(_bands(F.col("own"))).alias("band", "value"))

    rows = docs.select(F.col(id_col).alias("id"), _words(F.col(text_col)).alias("words")).where("id IS NOT NULL")
    rows = rows.select("id", _shingles(F.col("words")).alias("shingles"))
    places = F.filter(F.transform("shingles", lambda s, i: F.when(s.isin(anchors), i)), lambda i: i.isNotNull())
    # the row number tells rows of one id apart; being non-deterministic it also keeps the optimiser from
    # moving conditions on what follows below this point, where they would compute the shingles again
    rows = rows.select("id", "shingles", places.alias("places"), F.monotonically_increasing_id().alias("row"))

    # a window is one number, 64 times its start plus the logarithm of its size: numbers are made distinct
    # by hashing, structs by comparing all pairs
    def over(w: int, k: int) -> Column:
        """The windows over the places: they start at the multiples of a quarter window below each."""
        step = w // 4
        return F.transform("places", lambda i: (F.floor(i / step) - k) * step * 64 + (w.bit_length() - 1))

    starts = F.array_distinct(F.flatten(F.array(*[over(w, k) for w in windows for k in range(4)])))

    def cut(code: Column) -> Column:
        """A window with its own shingles, taken before the windows become rows: a row holds no whole document."""
        start, size = F.floor(code / 64).cast("int"), F.pow(F.lit(2), code % 64).cast("int")
        # element by element: slice() copies the whole array each time
        last = F.least(start + size - SHINGLE, F.size("shingles") - 1)
        own = F.array_distinct(F.transform(F.sequence(start, last), lambda i: F.get("shingles", i)))
        return F.struct(size.alias("window"), start.alias("start"), own.alias("own_window"))

    cuts = F.transform(F.filter(starts, lambda code: code >= 0), cut)
    seen = rows.select("id", "row", F.explode(cuts).alias("at")).select("id", "row", "at.*")
    bands = seen.select("id", "row", "window", "start", "own_window", F.posexplode(_bands(F.col("own_window"))).alias("band", "value"))
    shared = F.array_intersect("own", "own_window")
    pairs = bands.join(F.broadcast(keys), ["window", "band", "value"]).withColumn("shared", shared)
    pairs = pairs.withColumn("containment", F.size("shared") / F.size("own")).where(F.col("containment") >= CONTAINMENT)
    # a weaker match whose shingles all belong to a better one in an overlapping window is that one,
    # misread; overlapping windows meet in a cell of words
    cells = F.sequence(F.floor(F.col("start") / CELL), F.floor((F.col("start") + F.col("window") - 1) / CELL))
    match = F.struct("license", "containment", "own", "shared", "window", "start")
    held = pairs.withColumn("cell", F.explode(cells)).groupBy("id", "row", "cell").agg(F.collect_set(match).alias("held"))

    def judged(m: Column) -> Column:
        better = F.exists("held", lambda o: (
            (o["containment"] > m["containment"]) & (o["start"] < m["start"] + m["window"]) & (m["start"] < o["start"] + o["window"])
            & (F.size(F.array_except(m["shared"], o["own"])) == 0)
        ))
        return F.struct(m["license"].alias("license"), m["containment"].alias("containment"), F.xxhash64(m["own"]).alias("notice"), m["window"].alias("window"), m["start"].alias("start"), better.alias("beaten"))

    each = held.select("id", "row", F.explode(F.transform("held", judged)).alias("m")).select("id", "row", "m.*")
    best = each.groupBy("id", "row", "license", "notice", "window", "start").agg(F.max("containment").alias("containment"), F.max("beaten").alias("beaten"))
    return best.where("NOT beaten").groupBy(F.col("id").alias(id_col), "license").agg(
        F.max("containment").alias("containment"), F.countDistinct("row", "window", "start").alias("n_windows"), F.min("start").alias("first_word")
    )
