"""License scans by diagonal voting.

Every word 3-gram of every document is joined by Spark to the positions that it has in license
templates (a table of fixed size, so it is broadcast and nothing is shuffled for it). A match at
document word p and template word t votes for the diagonal p - t. Votes are summed by diagonal,
neighbouring diagonals of one template are merged (words inserted or left out shift a diagonal),
and spans are verified: each gram word by word, and a merged span by how much of the template it
covers within a length near the template's. Licenses of one family differ in single words, so a span
must hold every telling word of its template (TELLING, and the version in its label) and no other
telling word, and of spans that overlap, those of the label with most votes stay. Short phrases must
match whole, on one diagonal.

Cases: null or empty text has no words and no labels; documents of fewer than three words cannot
match; rows are answered one by one, also with equal or null ids; a notice in another order or with
words put in between still counts while 60 % of its grams stand; further columns are not used; an
empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .shared import lean_batches

K = 3
#: Diagonals at most so many words apart are one alignment.
SLACK = 6
#: Share of a template's grams that a merged span must hold.
COVER = 0.6
#: A span may be so many times as long as its template.
STRETCH = 1.5
U = np.uint64

# Phrases that are labels wherever their words stand, and public license notices.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-1.1", "Licensed under the Apache License, Version 1.1."),
    ("bsd-2", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS"),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2."),
    ("lgpl-3", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl-3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("agpl-3", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License."),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("epl-1", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("bsl-1", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
]
#: Words that tell licenses of a family apart.
TELLING = ["mit", "apache", "mozilla", "eclipse", "lesser", "affero", "attribution", "noncommercial", "sharealike", "noderivatives", "nc", "sa", "nd", "neither"]
#: Word trigrams of text, with a row (pos -1) for each document that has the places of its telling words.
GRAMS = "rid long, doc_id long, n_words long, pos int, gram long, words string, tells array<int>"
TABLE = "template int, phrase boolean, label string, grams int, place int, gram long, words string, mask long, full long, telling int"


def _words(column, words: tokens.Words, at: np.ndarray) -> list[str]:
    """The words of the 3-grams that begin at these places, as text."""
    data, _ = tokens.column_bytes(column)
    one = lambda i: data[words.start[i] : words.end[i]].tobytes().lower().decode()
    return [" ".join(one(int(p) + k) for k in range(K)) for p in at]


def templates() -> list[tuple]:
    """A row of TABLE for every template word that begins a gram."""
    texts = [(label, text, True) for label, text in PHRASES.items()] + [(label, text, False) for label, text in NOTICES]
    column = pa.array([t for _, t, _ in texts])
    words = tokens.tokenise(column, "alnum", spans=True)
    at, gram = tokens.windows(words, K)
    rows, text = words.rows()[at], _words(column, words, at)
    grams = np.bincount(rows, minlength=len(texts))
    data, _ = tokens.column_bytes(column)
    out = []
    for r, a, g, w in zip(rows, at, gram.view(np.int64), text, strict=True):
        label = texts[r][0]
        versions = label.split("-")[-1].split(".") if label[-1].isdigit() else []
        all_ = [data[s:e].tobytes().lower().decode() for s, e in zip(words.start[words.first[r] : words.first[r + 1]], words.end[words.first[r] : words.first[r + 1]], strict=True)]
        tells = [i for i, x in enumerate(all_) if x in TELLING]
        must = tells + [i for i, x in enumerate(all_) if versions and x == versions[0]][:1]
        place = int(a - words.first[r])
        mask = sum(1 << n for n, i in enumerate(must) if place <= i < place + K)
        out.append((int(r), texts[r][2], label, int(grams[r]), place, int(g), w, mask, (1 << len(must)) - 1, len(tells)))
    return out


def _emit(batches):
    known = np.unique(np.array([row[5] for row in templates()], dtype=np.int64))
    telling = np.sort(tokens.tokenise(pa.array([" ".join(TELLING)]), "alnum").hash)
    for batch in batches:
        n_rows = batch.num_rows
        step = max(1, min(n_rows, 256))
        for i in range(0, n_rows, step):
            part = batch.slice(i, step)
            text = part.column("text")
            words = tokens.tokenise(text, "alnum", spans=True)
            at, gram = tokens.windows(words, K)
            gram = gram.view(np.int64)
            row = words.rows()[at] if len(at) else np.zeros(0, np.int64)
            n = part.num_rows
            take = np.concatenate([np.arange(n), row])
            shown = np.flatnonzero(np.isin(gram, known))  # words are written out where a template may match
            spelled = np.full(n + len(at), None, dtype=object)
            spelled[n + shown] = _words(text, words, at[shown])
            tells = np.flatnonzero(np.isin(words.hash, telling))
            owner = words.rows()[tells]
            counts = np.concatenate([np.bincount(owner, minlength=n), np.zeros(len(at), np.int64)])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array((tells - words.first[owner]).astype(np.int32)))
            none = np.zeros(n, np.int64)
            columns = [part.column("rid").take(pa.array(take)), part.column("doc_id").take(pa.array(take)).cast(pa.int64()), pa.array(words.counts[take])]
            columns += [pa.array(np.concatenate([none - 1, at - words.first[:-1][row]]).astype(np.int32)), pa.array(np.concatenate([none, gram])), pa.array(spelled, pa.string()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "doc_id", "n_words", "pos", "gram", "words", "tells"])


def spans(docs: DataFrame) -> DataFrame:
    """A row for each document (template null) and for each verified span: rid, doc_id, n_words, template, phrase, label, first, last, cover."""
    spark = docs.sparkSession
    table = spark.createDataFrame(templates(), TABLE)
    grams = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text").mapInArrow(lean_batches(_emit), GRAMS)
    voted = grams.join(F.broadcast(table), ["gram", "words"], "left").where("pos < 0 OR template IS NOT NULL").withColumn("diagonal", F.col("pos") - F.col("place"))
    keys = ["rid", "doc_id", "n_words", "template", "phrase", "label", "grams", "full", "telling"]
    lines = voted.groupBy(*keys, "diagonal").agg(F.count("*").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.bit_or("mask").alias("mask"), F.first("tells").alias("tells"))
    order = Window.partitionBy("rid", "template").orderBy("diagonal", "first")
    apart = F.col("phrase") | (F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order), F.lit(SLACK + 1)) > SLACK)
    lines = lines.withColumn("apart", apart.cast("int")).withColumn("alignment", F.sum("apart").over(order))
    merged = lines.groupBy(*keys, "alignment").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), (F.max("last") + K - 1).alias("last"), F.bit_or("mask").alias("mask"), F.first("tells").alias("tells"))
    cover = F.when(F.col("grams").isNotNull(), F.least(F.lit(1.0), F.col("votes") / F.col("grams")))
    near = (F.col("last") - F.col("first") + 1) <= F.lit(STRETCH) * (F.col("grams") + K - 1)
    verified = F.when(F.col("phrase"), F.col("votes") == F.col("grams")).otherwise((cover >= COVER) & near & (F.col("mask") == F.col("full")))
    found = merged.where(F.col("template").isNull() | verified).withColumn("cover", cover)
    return _best(found).select("rid", "doc_id", "n_words", "template", "phrase", "label", "first", "last", "cover")


def _best(found: DataFrame) -> DataFrame:
    """Without spans that hold a telling word their template lacks, and without those that overlap spans of a label with more votes."""
    of_rid = Window.partitionBy("rid")
    tells = F.first("tells", ignorenulls=True).over(of_rid)
    notice = F.col("template").isNotNull() & ~F.col("phrase")
    strange = F.size(F.filter(F.col("all"), lambda p: (p >= F.col("first")) & (p <= F.col("last")))) != F.col("telling")
    kept = found.withColumn("all", tells).where(~notice | ~strange).drop("all")
    is_notice = F.col("template").isNotNull() & ~F.col("phrase")
    line = Window.partitionBy("rid", "is_notice").orderBy("first", "last", "template", "alignment")
    upto = F.max("last").over(line.rowsBetween(Window.unboundedPreceding, -1))
    kept = kept.withColumn("is_notice", is_notice).withColumn("begins", F.coalesce(F.col("first") > upto, F.lit(True)).cast("int"))
    kept = kept.withColumn("cluster", F.sum("begins").over(line))
    best = F.max(F.struct("votes", "cover", (-F.col("template")).alias("t"), "label")).over(Window.partitionBy("rid", "is_notice", "cluster"))
    return kept.withColumn("best", best).where(~F.col("is_notice") | (F.col("label") == F.col("best.label")))


def scan(docs: DataFrame) -> DataFrame:
    """One row for each document with the places of base phrases, all labels and the best cover as score."""
    found = spans(docs)
    whole = F.col("phrase")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        found.groupBy("rid", "doc_id", "n_words")
        .agg(
            F.count(F.when(whole, 1)).alias("n_base"),
            F.min(F.when(whole, F.col("first"))).cast("long").alias("first_word"),
            F.max(F.when(whole, F.col("first"))).cast("long").alias("last_word"),
            joined(F.when(whole, F.col("label"))).alias("base_labels"),
            joined(F.col("label")).alias("labels"),
            F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
        )
        .select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    )
