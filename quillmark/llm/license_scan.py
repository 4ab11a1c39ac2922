"""Licence scans with a positional index over the rare words of licence templates.

Native: DataFrame functions only.  A first pass counts in how many documents each
template word occurs.  The index is built from that: a template's anchors are its
places of highest inverse document frequency, one more than may disagree, so that
an offset which is accepted has an anchor that agrees; the index has the postings
(template, place) of each anchor word.  The second pass goes row by row.  It

1. finds the document's anchor words; most documents have none and are done,
2. looks up the postings of each place where one stands, and intersects them by
   relative position: each names a template and an offset,
3. compares the template's words with the document's at each such offset,
4. accepts a template when enough words agree at one offset and its mandatory key
   phrase stands in the document word by word.

No posting and no place is left out, so a document may get any number of labels.

Base labels come from three exact phrases and always stay.

Defined results: a null text counts as empty: no words, no labels (empty strings),
score 0; repeated rows are scanned each; an empty table gives an empty result;
columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word character is an ASCII letter or digit, or anything outside ASCII.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Phrases whose places are counted, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: label, notice text, mandatory key phrase
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "mit license"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2", "you may not use this file except in compliance with the license", "except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights", "waived all copyright and related"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc-by", "licensed under cc by 4 0", "licensed under cc by 4"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included in all copies"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions in binary form must reproduce"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "distributed under the license is distributed on an as is basis"),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", "free software foundation either version 3"),
    ("gpl-2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", "free software foundation either version 2"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    ("bsl-1", "distributed under the boost software license version 1 0", "boost software license"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license 2 0"),
    ("cddl-1", "the contents of this file are subject to the terms of the common development and distribution license", "common development and distribution license"),
    ("ofl-1", "this font software is licensed under the sil open font license version 1 1", "sil open font license"),
    ("artistic-2", "this work is licensed under the artistic license 2 0", "artistic license 2 0"),
    ("eupl-1", "licensed under the european union public licence v 1 2", "european union public licence"),
    ("odbl-1", "this database is made available under the open database license", "open database license"),
]
#: Part of a template's words that must agree at one offset.
AGREE = 0.6
VOCABULARY = sorted({w for _, text, _ in TEMPLATES for w in text.split()})
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _any_phrase() -> str:
    each = "|".join(f"{GAP}+".join(p.split()) for p in PHRASES)
    return f"(?i)(?<!{WORD})(?:{each})(?!{WORD})"


def _strings(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _words(docs: DataFrame) -> DataFrame:
    """``text`` and its ``words``, with A-Z in lower case."""
    text = F.coalesce("text", F.lit(""))
    low = F.translate(text, UPPER, UPPER.lower())
    return docs.select("doc_id", text.alias("text"), F.array_remove(F.split(low, f"{GAP}+"), "").alias("words"))


def rarity(docs: DataFrame) -> dict[str, float]:
    """Inverse document frequency of each template word over all documents."""
    known = F.array_intersect("words", _strings(VOCABULARY))
    known = _words(docs).select(F.explode(F.concat(known, F.array(F.lit("")))).alias("word"))
    df = {r["word"]: r["n"] for r in known.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = df.get("", 0)
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in VOCABULARY}


def anchors(words: list[str], idf: dict[str, float]) -> list[int]:
    """The rarest places of a template: as many as disagree where it is just not accepted."""
    least = min(m for m in range(len(words) + 1) if m / len(words) >= AGREE)
    return sorted(range(len(words)), key=lambda j: (-idf[words[j]], j))[: len(words) - least + 1]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    idf = rarity(docs)
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, (_, text, _) in enumerate(TEMPLATES):
        for j in anchors(text.split(), idf):
            postings.setdefault(text.split()[j], []).append((t, j))
    index = F.create_map(*(x for w, ps in sorted(postings.items()) for x in (F.lit(w), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(j).alias("j")) for t, j in ps)))))
    templates = F.array(*(F.struct(F.lit(label).alias("label"), _strings(text.split()).alias("words"), F.lit(f" {key} ").alias("key")) for label, text, key in TEMPLATES))

    rows = _words(docs).withColumn("rare", F.array_intersect("words", _strings(sorted(postings))))
    some = F.size("rare") > 0
    rows = rows.withColumn("at", F.when(some, F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains("rare", x["w"]))))
    named = F.transform("at", lambda h: F.transform(F.element_at(index, h["w"]), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["j"]).alias("offset"))))
    rows = rows.withColumn("named", F.array_distinct(F.flatten(named)))

    def agreement(c: Column) -> Column:
        words = F.get(templates, c["t"])["words"]
        same = F.filter(words, lambda w, j: (c["offset"] + j >= 0) & (F.get("words", c["offset"] + j) == w))
        return F.size(same) / F.size(words)

    placed = F.transform("named", lambda c: F.struct(c["t"].alias("t"), agreement(c).alias("part")))
    rows = rows.withColumn("placed", F.filter(placed, lambda x: x["part"] >= AGREE))
    rows = rows.withColumn("line", F.when(F.size("placed") > 0, F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))))
    rows = rows.withColumn("found", F.when(F.size("placed") > 0, F.filter(F.transform("placed", lambda x: F.struct(F.get(templates, x["t"])["label"].alias("label"), F.get(templates, x["t"])["key"].alias("key"), x["part"].alias("part"))), lambda x: F.contains(F.col("line"), x["key"]))))

    pattern = _any_phrase()
    has = F.col("text").rlike(pattern)
    rows = rows.withColumn("hits", F.when(has, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
    rows = rows.withColumn("pieces", F.when(F.col("hits").isNotNull(), F.split("text", pattern)))
    plain = F.transform("hits", lambda h: F.lower(F.regexp_replace(h, f"{GAP}+", " ")))
    label_of = F.create_map(*(F.lit(x) for pair in PHRASES.items() for x in pair))
    rows = rows.withColumn("base", F.coalesce(F.array_sort(F.array_distinct(F.transform(plain, lambda h: label_of[h]))), F.array().cast("array<string>")))
    count = lambda c: F.regexp_count(c, F.lit(f"{WORD}+"))
    n_words = F.size("words").cast("long")
    own = F.coalesce(F.transform("found", lambda x: x["label"]), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform("found", lambda x: x["part"])), F.lit(0.0))
    return rows.select(
        "doc_id",
        n_words.alias("n_words"),
        F.coalesce(F.size("hits"), F.lit(0)).cast("long").alias("n_base"),
        F.when(F.col("hits").isNotNull(), count(F.element_at("pieces", 1))).cast("long").alias("first_word"),
        F.when(F.col("hits").isNotNull(), n_words - count(F.element_at("pieces", -1)) - count(F.element_at("hits", -1))).cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", own)), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
