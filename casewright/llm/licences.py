"""Licence scans: sentences become known identifiers, and ordered rules match sequences of identifiers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Sentences of well-known licences and notices, in normalised form (see normal()), each with its identifier.
SENTENCES = {
    "mit-title": ["mit license", "the mit license"],
    "mit-notice": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "license mit"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and/or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-keep": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as-is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "apache2-title": ["apache license version 2.0 january 2004", "apache license version 2.0"],
    "apache2-notice": ["licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license", "released under the apache license version 2.0"],
    "apache2-comply": ["you may not use this file except in compliance with the license"],
    "apache2-copy": ["you may obtain a copy of the license at"],
    "gpl2-notice": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"],
    "gpl3-notice": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"],
    "gpl-free": ["this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl-hope": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "lgpl3-notice": ["licensed under the gnu lesser general public license version 3", "this work is licensed under the gnu lesser general public license version 3"],
    "agpl3-notice": ["licensed under the gnu affero general public license version 3", "this work is licensed under the gnu affero general public license version 3"],
    "bsd-redistribute": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "mpl2-notice": ["this source code form is subject to the terms of the mozilla public license v. 2.0"],
    "ccby4-notice": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "ccbysa4-notice": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"],
    "ccbync4-notice": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"],
    "ccbynd4-notice": ["licensed under cc by-nd 4.0"],
    "cc0-notice": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "licensed under cc0 1.0"],
    "unlicense-notice": ["this is free and unencumbered software released into the public domain"],
    "isc-grant": ["permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "all-rights": ["all rights reserved"],
}
#: Rules in order: (licence, identifiers that follow one another). A document gets every rule that fits, except those that
#: a longer rule of the same family, standing above it, has already given.
RULES = (
    ("BSD-3-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "mit-keep", "as-is")),
    ("MIT", ("mit-title", "mit-grant")),
    ("MIT", ("mit-notice",)),
    ("Apache-2.0", ("apache2-title", "apache2-notice")),
    ("Apache-2.0", ("apache2-notice",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("GPL-2.0-only", ("gpl2-notice",)),
    ("LGPL-3.0-only", ("lgpl3-notice",)),
    ("AGPL-3.0-only", ("agpl3-notice",)),
    ("MPL-2.0", ("mpl2-notice",)),
    ("CC-BY-4.0", ("ccby4-notice",)),
    ("CC-BY-SA-4.0", ("ccbysa4-notice",)),
    ("CC-BY-NC-4.0", ("ccbync4-notice",)),
    ("CC-BY-ND-4.0", ("ccbynd4-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("Unlicense", ("unlicense-notice",)),
    ("ISC", ("isc-grant", "as-is")),
    ("ISC", ("isc-grant",)),
)
#: A rule gives way to those above it whose identifiers begin with its own.
YIELDS = {name: [other for other, ids in RULES[:k] if other != name and ids[: len(seq)] == seq] for k, (name, seq) in enumerate(RULES)}
#: Where the SQL's pieces end: at a line break, or at . ; : and white space.
END = r"[.;:]*[ \t\r]*\n\s*|[.;:]+\s+"
#: What a text must hold to hold a known sentence, however it is wrapped.
MARK = r"(?i)licens|permission|warranty|redistribut|apache|copyright|reserved|unencumbered"
#: From a text in lower case to its words. H is where every sentence ends (a blank line, a line of marks alone, a list mark), S
#: where one may end (a line break, or . ; : and white space); neither has . + / - beside it. All run in one pass each.
STEPS = (
    (r"(?m)^[^a-z0-9\n]{0,8}\(?(?:[0-9]{1,2}|[a-z])\)[ \t]", " H "),
    (r"(?<![^a-z0-9\n])[^a-z0-9\n]*+\n[^a-z0-9\n]*+\n[^a-z0-9]*+", " H "),
    (r"[.;:]\s|\n", " S "),
    (r"[^a-z0-9.+/HS-]+", " "),
)
ENDS = ((r"(?<![ .+/S-])[ .+/S-]*+H[ .+/HS-]*+", " H "), (r"(?<![ .+/-])[ .+/-]*+S[ .+/S-]*+", " S "))
#: The known sentences as they stand between ends, where a full stop before a blank is an end: {sentence: identifier}.
KNOWN = {s.replace(". ", " "): i for i, all_ in SENTENCES.items() for s in all_}


def pattern() -> str:
    """Any known sentence, from one end to another, over any number of S between its words; of several the longest."""
    one = ["(?: S)? ".join(re.escape(w) for w in s.split(" ")) for s in sorted(KNOWN, key=lambda s: (-len(s), s))]
    return f"(?<=[HS] )(?:{'|'.join(one)})(?= [HS])"


def ends(text) -> F.Column:
    """The words of a text and the ends between them (see STEPS), an H at either end."""
    out = F.lower(text)
    for find, put in STEPS:
        out = F.regexp_replace(out, find, put)
    out = F.concat(F.lit("H"), out, F.lit("H"))
    for find, put in ENDS:
        out = F.regexp_replace(out, find, put)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """Every document: doc_id, n_sentences (known ones), sentence_ids (in order), licences (in the rules' order).

    A sentence may be wrapped over lines and hold . ; or : inside; a blank line or a list mark ends it. Null and empty
    texts, and texts without known sentences, have 0 and empty strings. Rows are scanned each, whatever they repeat. Text
    is read whole, and nothing moves between tasks.
    """
    # the dictionary is the fixed table above: a few dozen entries, whatever the input
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    found = F.regexp_extract_all(ends(F.col("text")), F.lit(pattern()), F.lit(0))
    ids = F.transform(found, lambda m: F.element_at(known, F.regexp_replace(m, " S ", " ")))
    hits = docs.select("doc_id", F.coalesce(F.when(F.col("text").rlike(MARK), ids), F.array().cast("array<string>")).alias("ids"))
    hits = hits.withColumn("line", F.concat(F.lit(","), F.array_join("ids", ","), F.lit(",")))
    fits = {}
    for name, ids in RULES:
        fits[name] = fits.get(name, F.lit(False)) | F.col("line").contains("," + ",".join(ids) + ",")
    given = [F.when(fits[n] & ~_any(fits, YIELDS[n]), n) for n in fits]
    return hits.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), F.concat_ws(",", *given).alias("licences"))


def _any(fits: dict, names: list[str]) -> F.Column:
    out = F.lit(False)
    for n in names:
        out = out | fits[n]
    return out


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table, scanned."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """DuckDB SQL for op8_licences."""
    known = ", ".join(f"('{s}', '{i}')" for i, all_ in SENTENCES.items() for s in all_)
    names = list(dict.fromkeys(n for n, _ in RULES))
    fit = {n: "(" + " OR ".join(f"contains(line, ',{','.join(ids)},')" for m, ids in RULES if m == n) + ")" for n in names}
    given = ", ".join(f"CASE WHEN {fit[n]}{''.join(f' AND NOT {fit[y]}' for y in YIELDS[n])} THEN '{n}' END" for n in names)
    return rf"""
WITH known(sentence, id) AS (VALUES {known}),
s AS (SELECT rowid_, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM (SELECT row_number() OVER () AS rowid_, regexp_split_to_array(coalesce(text, ''), '{END}') AS parts FROM documents)),
h AS (SELECT rowid_, count(*) AS n, string_agg(id, ',' ORDER BY i) AS ids FROM (SELECT rowid_, i, regexp_replace(regexp_replace(lower(s), '[^a-z0-9.+/-]+', ' ', 'g'), '^[ .+/-]+|[ .+/-]+$', '', 'g') AS sentence FROM s) JOIN known USING (sentence) GROUP BY rowid_),
d AS (SELECT row_number() OVER () AS rowid_, doc_id FROM documents)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids, CASE WHEN ids IS NULL THEN '' ELSE (SELECT concat_ws(',', {given}) FROM (SELECT ',' || ids || ',' AS line)) END AS licences FROM d LEFT JOIN h USING (rowid_)
"""
