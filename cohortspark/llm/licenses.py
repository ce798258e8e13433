"""License scan with a positional rare-token index, in DataFrame functions only.

Templates are license texts and notices with mandatory key phrases. The index holds, for each template, the word of its key
phrases with the highest inverse document frequency over the whole corpus, with its place in the template. A file's words
that are in the index are looked up; each posting proposes a start of the template in the file (place in the file less
place in the template). Wherever all key phrases stand that word stands, so every such start is proposed. Each is
verified: every key phrase must stand word by word where the start puts it. The score is the share of the template's
words that stand in their places.

Base phrases are found wherever their words stand consecutively.

The index is bounded by the templates, not by the corpus; frequencies come from one aggregate over all documents, and
documents are never shuffled or truncated. Postings are only proposed by words of the index, so frequent words cost
nothing.

Defined results: null and empty texts have no words and no labels (empty strings, no first and last word, score 0);
repeated rows get equal results; columns besides the named ones are never read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]  # each stands in the text

    def words(self) -> list[str]:
        return words_of(self.text)

    def key_places(self) -> list[tuple[int, list[str]]]:
        mine = self.words()
        out = []
        for key in self.keys:
            k = words_of(key)
            out.append((next(i for i in range(len(mine)) if mine[i : i + len(k)] == k), k))
        return out


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


# Wording of public license notices.
TEMPLATES = (
    Template(
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        ("Apache License, Version 2.0", "except in compliance with the License"),
    ),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0.", ("Apache License, Version 2.0",)),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        ("Permission is hereby granted, free of charge", "software and associated documentation files"),
    ),
    Template("mit", "Released under the MIT License.", ("MIT License",)),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        ("Redistribution and use in source and binary forms", "following conditions are met"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        ("Permission to use, copy, modify", "for any purpose with or without fee is hereby granted"),
    ),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", ("GNU General Public License, version 3",)),
    Template(
        "gpl",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        ("redistribute it and/or modify it under the terms of the GNU General Public License", "Free Software Foundation"),
    ),
    Template(
        "lgpl",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        ("GNU Lesser General Public License", "Free Software Foundation"),
    ),
    Template(
        "agpl",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        ("GNU Affero General Public License", "Free Software Foundation"),
    ),
    Template(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        ("subject to the terms of the Mozilla Public License",),
    ),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", ("CC BY-NC 4.0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0.", ("CC BY-SA 4.0",)),
    Template(
        "cc-by-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        ("Creative Commons Attribution 4.0 International License",),
    ),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain.",
        ("free and unencumbered software released into the public domain",),
    ),
)


def text_words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def frequencies(docs: DataFrame, text: str, templates: tuple[Template, ...]) -> dict[str, int]:
    """In how many documents each word of the templates stands."""
    vocabulary = sorted({w for t in templates for w in t.words()})
    present = docs.select(F.explode(F.array_intersect(text_words(F.col(text)), strings(vocabulary))).alias("w"))
    # At most one row per word of the templates reaches the driver.
    return {r["w"]: r["n"] for r in present.groupBy("w").agg(F.count("*").alias("n")).collect()}


def scan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    templates: tuple[Template, ...] = TEMPLATES,
    base: dict[str, str] = BASE,
) -> DataFrame:
    """``doc_id``, n_words, base (label and start of every base phrase), found (label, start and share of every template)."""
    frequency = frequencies(docs, text, templates)
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, template in enumerate(templates):
        key_words = [(frequency.get(w, 0), w, o + i) for o, k in template.key_places() for i, w in enumerate(k)]
        _, w, i = min(key_words)
        postings.setdefault(w, []).append((t, i))
    phrases = [(words_of(p), label) for p, label in base.items()]
    sought = sorted({*postings, *(p[0] for p, _ in phrases)})

    number = lambda x: F.lit(x).cast("int")
    posting_map = F.create_map(
        *[
            c
            for w, where in sorted(postings.items())
            for c in (F.lit(w), F.array(*[F.struct(number(t).alias("t"), number(o).alias("o")) for t, o in where]))
        ]
    )
    wording = F.array(*[strings(t.words()) for t in templates])
    keys = F.array(
        *[F.array(*[F.struct(number(o).alias("o"), strings(k).alias("k")) for o, k in t.key_places()]) for t in templates]
    )
    labels = strings([t.label for t in templates])
    base_phrases = F.array(*[F.struct(strings(p).alias("p"), F.lit(label).alias("label")) for p, label in phrases])

    words = F.col("_w")
    stands = lambda at, k: (at >= 0) & (F.slice(words, F.greatest(at, F.lit(0)) + 1, F.size(k)) == k)
    rows = docs.select(F.col(doc_id), text_words(F.col(text)).alias("_w"))
    rows = rows.withColumn("_any", F.arrays_overlap("_w", strings(sought)))
    hits = F.filter(F.transform("_w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(sought))
    rows = rows.withColumn("_hits", F.when(F.col("_any"), hits))
    based = F.flatten(
        F.transform(
            "_hits",
            lambda h: F.transform(
                F.filter(base_phrases, lambda p: stands(h["i"], p["p"])),
                lambda p: F.struct(p["label"].alias("label"), h["i"].cast("long").alias("start")),
            ),
        )
    )
    proposed = F.flatten(
        F.transform(
            F.filter("_hits", lambda h: h["w"].isin(sorted(postings))),
            lambda h: F.transform(posting_map[h["w"]], lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["o"]).alias("s"))),
        )
    )
    rows = rows.withColumn("_base", based).withColumn("_proposed", proposed)
    agreed = F.filter(
        F.array_distinct("_proposed"),
        lambda c: F.forall(F.get(keys, c["t"]), lambda k: stands(c["s"] + k["o"], k["k"])),
    )
    rows = rows.withColumn("_agreed", agreed)
    share = lambda c: F.size(
        F.filter(F.transform(F.get(wording, c["t"]), lambda w, j: F.get(words, c["s"] + j) == w), lambda same: same)
    ) / F.size(F.get(wording, c["t"]))
    found = F.transform(
        "_agreed",
        lambda c: F.struct(F.get(labels, c["t"]).alias("label"), c["s"].cast("long").alias("start"), share(c).alias("share")),
    )
    return rows.select(
        doc_id,
        F.size("_w").cast("long").alias("n_words"),
        F.coalesce("_base", F.array().cast("array<struct<label:string,start:bigint>>")).alias("base"),
        F.coalesce(found, F.array().cast("array<struct<label:string,start:bigint,share:double>>")).alias("found"),
    )
