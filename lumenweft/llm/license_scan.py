"""License notices found by an exact set-similarity join, in DataFrame operations only.

Method. A block is a window of words, whatever the lines: for a template of L words (with repeats) let S be the
smallest power of two that is L at least; block k holds the 2 * S words from word k * S on, so any passage of up to S
words lies in one block, and words further apart than 2 * S never count together. Blocks and templates are sets of words;
template t matches block b if |t & b| >= need(t) = ceil(threshold * |t|). Only words of templates
matter, so texts are kept as their words among these. These are ordered by the number of texts that hold them, rarest first.
Length filter: a text with fewer than ``need`` different words of every template of a size has no block of that size, and a
shorter block is left out. Prefix filter: a match shares a word of t's prefix (its first |t| - need + 1
words) with b's prefix (first |b| - need + 1), so only blocks around such words are made. Positional filter: a
shared word at positions i and j leaves at most min(|b| - i, |t| - j) words. Survivors are verified by intersection. Templates
are a fixed list, so their side of the join and the order of their words have a fixed bound and are broadcast; text is read once and stays in place.

Base phrases are searched apart: every place where a phrase's words stand consecutively.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweft.llm._shared import Scratch

#: Base phrases and labels (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices by label (fixed values): common wordings of license statements, and texts of licenses and their file headers.
TEMPLATES = {
    "notice-all-rights": "all rights reserved",
    "notice-apache-2": "licensed under the apache license version 2 0",
    "notice-bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "notice-cc-by": "licensed under cc by 4 0",
    "notice-cc-by-nc": "licensed under cc by nc 4 0",
    "notice-cc-by-sa": "licensed under cc by sa 4 0",
    "notice-cc-named": "this work is licensed under a creative commons attribution 4 0 international license",
    "notice-gpl-3": "this work is licensed under the gnu general public license version 3",
    "notice-mit": "released under the mit license",
    "notice-mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "notice-mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "notice-public-domain": "this work has been released into the public domain",
    "text-apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"
    " you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing"
    " software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
    " see the license for the specific language governing permissions and limitations under the license",
    "text-bsd-3": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
    " redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
    " redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"
    " in the documentation and or other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors"
    " may be used to endorse or promote products derived from this software without specific prior written permission",
    "text-gpl-3": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
    " as published by the free software foundation either version 3 of the license or at your option any later version"
    " this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of"
    " merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "text-isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
    " provided that the above copyright notice and this permission notice appear in all copies",
    "text-mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software"
    " to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"
    " and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
    " the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
    " the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"
    " fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages"
    " or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software"
    " or the use or other dealings in the software",
    "text-unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute"
    " this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "text-zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"
    " arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications"
    " and to alter it and redistribute it freely subject to the following restrictions",
}
THRESHOLD = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: all ASCII but digits and letters.
BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def stride(template: str) -> int:
    """Words from one block to the next; a block has twice as many."""
    return 1 << (len(template.split()) - 1).bit_length()


def needed(template: str, threshold: float) -> int:
    """Different words of the template that a block must hold."""
    return math.ceil(threshold * len(set(template.split())) - 1e-9)


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _places(phrase: str) -> str:
    """Where the phrase starts: its words are hits that follow each other, in the text as well."""
    parts = phrase.split()
    hit = " and ".join(f"element_at(hits, x + {k + 1}).w = '{w}' and element_at(hits, x + {k + 1}).i = element_at(hits, x + 1).i + {k}" for k, w in enumerate(parts))
    found = f"transform(filter(sequence(0, size(hits) - {len(parts)}), x -> {hit}), x -> cast(element_at(hits, x + 1).i as bigint))"
    return f"if(size(hits) >= {len(parts)}, {found}, cast(array() as array<bigint>))"


def scan_licenses(docs: DataFrame, scratch: Scratch, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per document.

    ``score`` is the largest share of a matched template's words (0 without a match). Null and empty
    texts have no words and no labels; repeated rows are rows of their own. Labels must not hold commas. Other columns take no part.
    """
    sets = {label: sorted(set(t.split())) for label, t in templates.items()}
    need = {label: needed(t, threshold) for label, t in templates.items()}
    strides = {label: stride(t) for label, t in templates.items()}
    vocabulary = sorted({w for s in sets.values() for w in s} | {w for p in phrases for w in p.split()})
    words = F.split(F.translate(F.coalesce("text", F.lit("")), UPPER + BETWEEN, LOWER + " " * len(BETWEEN)), " ")
    low = docs.select("doc_id", words.alias("all")).withColumn("ws", F.expr("filter(all, w -> w != '')"))
    low = low.select("doc_id", F.size("ws").cast("long").alias("n_words"), F.expr(f"filter(transform(ws, (w, i) -> if(w in ({_quoted(vocabulary)}), named_struct('w', w, 'i', i), null)), h -> h is not null)").alias("hits"))
    low = low.withColumn("held", F.array_distinct("hits.w"))
    sizes = [F.when(F.size(F.array_intersect("held", F.array(*map(F.lit, sets[x])))) >= need[x], F.lit(strides[x])) for x in templates]
    low = low.withColumn("open", F.when(F.size("held") >= min(need.values(), default=1), F.array_distinct(F.array_compact(F.array(*sizes)))).otherwise(F.array().cast("array<int>")))
    low = low.withColumn("spots", F.array(*[F.expr(_places(p)) for p in phrases]))
    names = F.array(*[F.lit(x) for x in phrases.values()])
    low = low.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", "n_words", F.flatten("spots").alias("at"),
        F.array_sort(F.array_distinct(F.filter(F.zip_with(names, "spots", lambda n, s: F.when(F.size(s) > 0, n)), lambda x: x.isNotNull()))).alias("base"),
        "held", "open", F.when(F.size("open") > 0, F.col("hits")).alias("hits"),
    )
    rows = scratch.table(low, "rows")
    counts = {r.w: r.n for r in rows.select(F.explode("held").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # at most one row per template word
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    entries, least = [], {}
    for label, s in sets.items():
        ranks, size = sorted(order[w] for w in s), strides[label]
        least[size] = min(least.get(size, len(s)), need[label])
        entries += [(label, size, r, j, len(s), need[label], ranks) for j, r in enumerate(ranks[: len(s) - need[label] + 1])]
    spark = docs.sparkSession
    prefixes = F.broadcast(spark.createDataFrame(entries, "label string, stride int, rank int, j int, size int, need int, ranks array<int>"))
    listed = F.broadcast(spark.createDataFrame(list(order.items()), "w string, rank int"))
    placed = rows.filter(F.size("open") > 0).select("rid", "open", F.explode("hits").alias("h")).select("rid", "open", F.col("h.w").alias("w"), F.col("h.i").alias("i")).join(listed, "w")
    # Each word is in two blocks of a size.
    inside = placed.select("rid", "rank", "i", F.explode("open").alias("stride"))
    inside = inside.select("rid", "rank", "stride", F.explode(F.filter(F.array((F.col("i") / F.col("stride")).cast("int"), (F.col("i") / F.col("stride")).cast("int") - 1), lambda k: k >= 0)).alias("k"))
    near = inside.join(prefixes.select("stride", "rank").distinct(), ["stride", "rank"], "left_semi").select("rid", "stride", "k").distinct()
    blocks = inside.join(near, ["rid", "stride", "k"], "left_semi").groupBy("rid", "stride", "k").agg(F.array_sort(F.collect_set("rank")).alias("b"))
    fewest = F.element_at(F.create_map(*[F.lit(x) for kv in least.items() for x in kv]), F.col("stride")) if least else F.lit(1)
    opened = blocks.withColumn("least", fewest).filter(F.size("b") >= F.col("least"))
    opened = opened.select("rid", "stride", "b", F.posexplode(F.slice("b", F.lit(1), F.size("b") - F.col("least") + 1)).alias("at", "rank"))
    near = opened.join(prefixes, ["stride", "rank"]).filter((F.size("b") >= F.col("need")) & (F.least(F.size("b") - F.col("at"), F.col("size") - F.col("j")) >= F.col("need")))
    sure = near.withColumn("both", F.size(F.array_intersect("b", "ranks"))).filter("both >= need")
    hits = sure.groupBy("rid").agg(F.collect_set("label").alias("found"), F.max(F.col("both") / F.col("size")).alias("score"))
    out = rows.drop("held", "open", "hits").join(hits, "rid", "left")
    return out.select(
        "doc_id", "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").alias("first_word"), F.array_max("at").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
