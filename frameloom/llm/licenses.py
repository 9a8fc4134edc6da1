"""License scans: an exact set-similarity join of text blocks with notice templates, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import written

#: Fixed phrases with their base labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Names of licenses as phrases, with the labels that they add.
NAMES = {
    "affero general public license": "agpl", "apache license": "apache", "boost software license": "boost", "bsd license": "bsd", "cc by nc": "cc-by-nc", "cc by nc nd": "cc-by-nc-nd", "cc by nc sa": "cc-by-nc-sa",
    "cc by nd": "cc-by-nd", "cc by sa": "cc-by-sa", "cc0": "cc0", "eclipse public license": "epl", "isc license": "isc", "lesser general public license": "lgpl", "mit license": "mit", "mozilla public license": "mpl",
    "the unlicense": "unlicense", "zlib license": "zlib",
}
#: Notices whose words are looked for, with the labels that they add: (text, words that a block must hold to be this notice). Fixed values.
TEMPLATES = {
    "agpl": ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "redistribute modify gnu affero"),
    "apache": ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license compliance except"),
    "apache-warranty": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "applicable writing basis warranties conditions"),
    "boost": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce display distribute execute and transmit the software", "permission granted organization accompanying covered"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution source binary forms permitted"),
    "bsd-warranty": ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "provided holders contributors merchantability disclaimed"),
    "cc0": ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "extent waived copyright neighboring"),
    "epl": ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at", "accompanying materials eclipse license"),
    "gpl-program": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "redistribute modify gnu general foundation"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission purpose fee granted appear"),
    "lgpl": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", "redistribute modify gnu lesser"),
    "mit-permission": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense", "permission granted charge associated deal restriction"),
    "mpl": ("this source code form is subject to the terms of the mozilla public license v 2 0", "source form subject mozilla license"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "unencumbered software released domain"),
    "zlib": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "permission anyone commercial alter freely restrictions"),
}
#: Words that a block of a notice may not hold, as they make it another one.
BUT_NOT = {"gpl-program": "affero lesser library", "lgpl": "affero"}
#: A block matches if it holds this share of a template's different words.
CONTAINMENT = 0.8
#: What isn't part of a word, after lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Ends of blocks: blank lines, and sentence ends before white space. A single line end is a blank, as notices are wrapped.
BLOCK_END = r"\n[ \t]*\n|[.!?][ \n]"


def template_words(templates: dict[str, tuple[str, str]]) -> dict[str, list[str]]:
    return {label: sorted(set(text.split())) for label, (text, _) in templates.items()}


def _plain(text: Column) -> Column:
    """Words joined by single blanks, A-Z in lower case. lower() may also change letters beyond A-Z, which stay parts of words; the
    two of them that it would turn into ASCII letters are replaced before."""
    for letter in ("\u0130", "\u212a"):
        text = F.replace(text, F.lit(letter), F.lit("\ufffd"))
    return F.trim(F.regexp_replace(F.lower(text), SEPARATORS, " "))


def _blanks(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def scan(docs: DataFrame, templates: dict[str, tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A block holds a notice if it has the share `containment` of its words, all those that tell it from other notices, and none that
    make it another one. Names of licenses count as phrases, like the base ones, but not among the places.

    score: 1 with a base place or a name, else the largest containment of a matching block, else 0. Null and empty texts have no words,
    empty label strings and score 0. Repeated rows stay, null ids pass through, other columns aren't read.

    One pass over the texts leaves, per document, the base columns, the template words that it holds and its promising blocks
    as sets of template words, if it holds as many of these as any template needs. That small table is written to the shared folder. Word frequencies over all documents (a row
    per template word, so bounded) order every set; the join is on words of template prefixes.
    """
    sets = template_words(templates)
    need = {label: math.ceil(containment * len(words) - 1e-9) for label, words in sets.items()}
    must, not_ = {label: templates[label][1].split() for label in sets}, {label: BUT_NOT.get(label, "").split() for label in sets}
    every = sorted({w for words in (*sets.values(), *not_.values()) for w in words})
    vocabulary = F.array(*[F.lit(w) for w in every])
    plain, framed = F.col("plain"), F.concat(F.lit(" "), F.col("plain"), F.lit(" "))

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("plain", _plain(F.col("text")))
    n_words = F.when(plain == "", 0).otherwise(_blanks(plain) + 1).cast("long")
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        held = framed.contains(f" {phrase} ")
        counts.append(F.when(held, F.regexp_count(framed, F.lit(f" {phrase}(?= )"))).otherwise(0))
        firsts.append(F.when(held, _blanks(F.substring_index(framed, f" {phrase} ", 1))))
        lasts.append(F.when(held, n_words - _blanks(F.substring_index(framed, f" {phrase} ", -1)) - len(phrase.split())))
        labels.append(F.when(held, F.lit(label)))
    names = [F.when(framed.contains(f" {name} "), F.lit(label)) for name, label in NAMES.items()]
    seen = F.array_intersect(F.split("plain", " "), vocabulary)
    blocks = F.filter(
        F.transform(F.split("text", BLOCK_END), lambda b: F.array_intersect(F.split(_plain(b), " "), vocabulary)),
        lambda b: F.size(b) >= min(need.values()),
    )
    kept = written(
        base.withColumns({"seen": seen})
        .withColumn("blocks", F.when(F.size("seen") >= min(need.values()), blocks))
        .select(
            F.monotonically_increasing_id().alias("row"), "doc_id", n_words.alias("n_words"), sum(counts[1:], counts[0]).cast("long").alias("n_base"),
            F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"), F.array_compact(F.array(*labels)).alias("base"), F.array_compact(F.array(*names)).alias("names"), "seen", "blocks",
        ),
        "licenses",
    )

    frequency = {r[0]: r[1] for r in kept.select(F.explode("seen").alias("word")).groupBy("word").count().collect()}
    order = {w: i for i, w in enumerate(sorted(every, key=lambda w: (frequency.get(w, 0), w)))}
    ranks = F.create_map(*[F.lit(x) for item in order.items() for x in item])
    block = (
        kept.where(F.size("blocks") > 0)
        .select("row", F.posexplode("blocks").alias("block", "words"))
        .withColumn("tokens", F.sort_array(F.transform("words", lambda w: F.try_element_at(ranks, w))))
        .select("row", "block", "tokens", F.size("tokens").alias("n"))
    )
    rows = []
    for label, words in sets.items():
        tokens = sorted(order[w] for w in words)
        own = [sorted(order[w] for w in words) for words in (must[label], not_[label])]
        rows += [(label, tokens, len(tokens), need[label], *own, token, place) for place, token in enumerate(tokens[: len(tokens) - need[label] + 1])]
    index = docs.sparkSession.createDataFrame(rows, "label string, t_tokens array<int>, t_n int, need int, must array<int>, not_ array<int>, token int, t_place int")
    found = (
        block.select("*", F.posexplode("tokens").alias("place", "token"))
        .join(F.broadcast(index), "token")  # a row per prefix word of a template: bounded by the templates
        .where((F.col("n") >= F.col("need")) & (F.col("place") <= F.col("n") - F.col("need")))
        .where(1 + F.least(F.col("n") - F.col("place") - 1, F.col("t_n") - F.col("t_place") - 1) + F.least("place", "t_place") >= F.col("need"))
        .withColumn("share", F.size(F.array_intersect("tokens", "t_tokens")) / F.col("t_n"))
        .where(F.size(F.array_intersect("tokens", "t_tokens")) >= F.col("need"))
        .where((F.size(F.array_except("must", "tokens")) == 0) & ~F.arrays_overlap("not_", "tokens"))
        .groupBy("row")
        .agg(F.collect_set("label").alias("own"), F.max("share").alias("share"))  # as many labels as templates at most
    )
    return kept.join(found, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.concat_ws(",", F.sort_array("base")).alias("base_labels"),
        F.concat_ws(",", F.sort_array(F.array_union(F.array_union("base", "names"), F.coalesce("own", F.array().cast("array<string>"))))).alias("labels"),
        F.when((F.col("n_base") > 0) | (F.size("names") > 0), 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def oracle() -> str:
    """The same result in DuckDB SQL, with every block compared with every template."""
    listed = lambda words: f"[{', '.join(repr(w) for w in words)}]::VARCHAR[]"
    values = ", ".join(
        f"('{label}', {listed(words)}, {math.ceil(CONTAINMENT * len(words) - 1e-9)}, {listed(TEMPLATES[label][1].split())}, {listed(BUT_NOT.get(label, '').split())})"
        for label, words in template_words(TEMPLATES).items()
    )
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def words(text: str) -> str:
        return f"list_filter(regexp_split_to_array(translate({text}, '{upper}', '{lower}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

    def standing(phrases: dict[str, str]) -> str:
        return " UNION ALL ".join(
            f"SELECT r, i - 1 AS place, '{label}' AS label FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE " + " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(phrase.split()))
            for phrase, label in phrases.items()
        )

    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {words("coalesce(text, '')")} AS w FROM documents),
        t(label, words, need, must, but_not) AS (VALUES {values}),
        p AS ({standing(PHRASES)}),
        nm AS ({standing(NAMES)}),
        b AS (SELECT r, list_distinct({words("block")}) AS w FROM (SELECT r, unnest(regexp_split_to_array(text, '{BLOCK_END}')) AS block FROM d)),
        m AS (SELECT r, label, max(len(list_intersect(w, words))::DOUBLE / len(words)) AS share FROM b, t WHERE len(list_intersect(w, words)) >= need AND list_has_all(w, must) AND NOT list_has_any(w, but_not) GROUP BY r, label),
        pa AS (SELECT r, count(*) AS n, min(place) AS lo, max(place) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY r),
        la AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM p UNION SELECT r, label FROM nm UNION SELECT r, label FROM m) GROUP BY r),
        sh AS (SELECT r, max(share) AS share FROM m GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
          coalesce(pa.labels, '') AS base_labels, coalesce(la.labels, '') AS labels,
          CASE WHEN n > 0 OR r IN (SELECT r FROM nm) THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
        FROM d LEFT JOIN pa USING (r) LEFT JOIN la USING (r) LEFT JOIN sh USING (r)
    """
