"""Licence recognition by sentence rules, in DataFrame functions only.

A text is cut into sentences, each sentence is normalised and mapped to the
number of a known licence sentence (0 if unknown), and the sequence of numbers
is matched against ordered rules: longer rules come before shorter ones, and a
rule that matches consumes its sentences, so that the three sentences of one
licence inside the four of another don't count twice. An unknown sentence stands
in the sequence and breaks it; titles, copyright lines and list numbers are
passed over. Texts are cut in two ways: by paragraphs, in which wrapped lines
are joined, and by lines (a notice on a line of its own). Rules are matched on
either sequence.

Everything is a projection: no shuffle, no join, nothing that grows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Well-known sentences of public licences, as normalised by `normalise`.
SENTENCES = (
    "released under the mit license",
    "licensed under the mit license",
    "this project is licensed under the mit license",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "licensed under the apache license version 2 0",
    "licensed under the apache license version 2 0 the license",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "you may not use this file except in compliance with the license",
    "you may obtain a copy of the license at",
    "http www apache org licenses license 2 0",
    "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache license version 2 0 january 2004 http www apache org licenses",
    "this work is licensed under the gnu general public license version 3",
    "this work is licensed under the gnu general public license version 2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "see the gnu general public license for more details",
    "gnu general public license version 3 29 june 2007",
    "gnu general public license version 2 june 1991",
    "licensed under cc by nc 4 0",
    "licensed under cc by 4 0",
    "licensed under cc by sa 4 0",
    "this work is licensed under a creative commons attribution 4 0 international license",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "spdx license identifier mit",
    "spdx license identifier apache 2 0",
    "spdx license identifier gpl 3 0 only",
    "spdx license identifier gpl 3 0 or later",
    "spdx license identifier gpl 2 0 only",
    "spdx license identifier gpl 2 0 or later",
    "spdx license identifier bsd 3 clause",
    "spdx license identifier bsd 2 clause",
    "spdx license identifier isc",
    "spdx license identifier cc by 4 0",
    "spdx license identifier cc by sa 4 0",
    "spdx license identifier cc by nc 4 0",
)
# Licences and the 1-based numbers of sentences that follow one another.
RULES = (
    ("MIT", (4, 5, 6, 7)), ("MIT", (4, 5, 6)), ("MIT", (4, 5)), ("MIT", (1,)), ("MIT", (2,)), ("MIT", (3,)), ("MIT", (33,)),
    ("Apache-2.0", (10, 12, 13)), ("Apache-2.0", (10, 14)), ("Apache-2.0", (9, 11, 14)), ("Apache-2.0", (9, 11)), ("Apache-2.0", (8,)), ("Apache-2.0", (9,)), ("Apache-2.0", (10,)), ("Apache-2.0", (15,)), ("Apache-2.0", (34,)),
    ("GPL-3.0", (18, 20, 21)), ("GPL-3.0", (18,)), ("GPL-3.0", (16,)), ("GPL-3.0", (22,)), ("GPL-3.0", (35,)), ("GPL-3.0", (36,)),
    ("GPL-2.0", (19, 20, 21)), ("GPL-2.0", (19,)), ("GPL-2.0", (17,)), ("GPL-2.0", (23,)), ("GPL-2.0", (37,)), ("GPL-2.0", (38,)),
    ("CC-BY-NC-4.0", (24,)), ("CC-BY-NC-4.0", (44,)), ("CC-BY-4.0", (25,)), ("CC-BY-4.0", (27,)), ("CC-BY-4.0", (42,)), ("CC-BY-SA-4.0", (26,)), ("CC-BY-SA-4.0", (43,)),
    ("BSD-3-Clause", (28, 29, 30, 31)), ("BSD-3-Clause", (39,)), ("BSD-2-Clause", (28, 29, 30)), ("BSD-2-Clause", (40,)),
    ("ISC", (32,)), ("ISC", (41,)),
)
# Normalised sentences that are passed over: list numbers, titles, copyright lines and what follows them.
NEUTRAL = r"^([0-9]{1,2}|[a-z]|copyright .*|c [0-9]{4}.*|all rights reserved|(the )?(mit|isc|apache|bsd [23] clause) license( mit)?)?$"
# Fixed value: the named holder of the third condition stands for any.
HOLDER, ANY_HOLDER = r"^neither the names? of .* nor the names of (its|their) contributors", "neither the name of the copyright holder nor the names of its contributors"
#: Every known sentence has one of these; other texts need no cutting.
TRIGGER = "(?i)licen|copyright|warrant|permi|redistribut"

#: Lines without a letter or digit part paragraphs; so does a list number that opens a line.
BLANK = r"\n[^\p{L}\p{N}]*\n"
ITEM = r"\n([^\p{L}\p{N}\n]*)([0-9]{1,2}|[a-zA-Z])[.)][ \t]"
#: A sentence ends with one of these before white space, a colon before a line end.
END, COLON = r"([.!?][\"')\]]*)[ \t\f\n]+", r":[ \t]*\n"
CUT = "\x01"


def normalise(s: Column) -> Column:
    """Lower case; runs of anything but a-z and 0-9 become one space."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")), HOLDER, ANY_HOLDER)


def numbers_of(pieces: Column, sentences=SENTENCES) -> Column:
    """Numbers of an array of sentences, 0 for unknown ones, neutral ones left out."""
    known = F.array(*map(F.lit, sentences))
    plain = F.filter(F.transform(pieces, normalise), lambda s: ~s.rlike(NEUTRAL))
    return F.transform(plain, lambda s: F.array_position(known, s).cast("int"))


def by_paragraph(text: Column) -> Column:
    """Sentences of paragraphs, line ends inside them being spaces."""
    text = F.regexp_replace(F.regexp_replace(text, BLANK, CUT), ITEM, CUT)
    return F.split(F.regexp_replace(F.regexp_replace(text, COLON, CUT), END, "$1" + CUT), CUT)


def by_line(text: Column) -> Column:
    """Sentences of lines."""
    return F.split(F.regexp_replace(F.regexp_replace(text, END, "$1" + CUT), "\n", CUT), CUT)


def ordered(rules) -> list[tuple[str, tuple]]:
    """Rules in the order in which they are tried: longer ones first, else as given."""
    return sorted(rules, key=lambda r: -len(r[1]))


def _text(seq) -> str:
    return "".join(f"<{i}>" for i in seq)


def matched(ids: Column, rules=RULES) -> Column:
    """Licences whose rules match a sequence of numbers, each rule consuming what it matches."""
    line = F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i.cast("string"), F.lit(">"))), "")
    tried = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(_text(q)).alias("seq")) for n, q in ordered(rules)])
    start = F.struct(line.alias("rest"), F.array().cast("array<string>").alias("found"))
    step = lambda s, r: F.struct(F.replace(s["rest"], r["seq"], F.lit("<>")).alias("rest"), F.when(F.contains(s["rest"], r["seq"]), F.array_append(s["found"], r["name"])).otherwise(s["found"]).alias("found"))
    return F.aggregate(tried, start, step)["found"]


def recognise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences=SENTENCES, rules=RULES) -> DataFrame:
    """Rows (id, sentence_ids, licences, n_sentences) for every row of docs.

    ``licences`` are the names of the rules that match, sorted; ``sentence_ids``
    the numbers of the known sentences in the cut that has more of them (by
    paragraph where both have as many). Both are comma-joined strings, empty
    where nothing is found: so for null, empty and very long texts without a
    notice. Of rules of one length that overlap, the one given first takes the
    sentences. Repeated rows give repeated results; null ids stay null; other
    columns of docs are ignored; an empty table gives none.
    """
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "\r\n?", "\n")
    none = F.array().cast("array<int>")
    hit = F.coalesce(F.col(text_col), F.lit("")).rlike(TRIGGER)
    df = docs.select(F.col(id_col).alias("_id"), F.when(hit, numbers_of(by_paragraph(text), sentences)).otherwise(none).alias("_a"), F.when(hit, numbers_of(by_line(text), sentences)).otherwise(none).alias("_b"))
    known = lambda c: F.filter(c, lambda i: i > 0)
    df = df.select("_id", "_a", "_b", known(F.col("_a")).alias("_ka"), known(F.col("_b")).alias("_kb"))
    best = F.when(F.size("_ka") >= F.size("_kb"), F.col("_ka")).otherwise(F.col("_kb"))
    found = F.when(F.size("_ka") + F.size("_kb") > 0, F.array_sort(F.array_distinct(F.concat(matched(F.col("_a"), rules), matched(F.col("_b"), rules))))).otherwise(F.array().cast("array<string>"))
    df = df.select("_id", best.alias("_ids"), found.alias("_l"))
    return df.select(F.col("_id").alias(id_col), F.array_join(F.col("_ids").cast("array<string>"), ",").alias("sentence_ids"), F.array_join("_l", ",").alias("licences"), F.size("_ids").cast("long").alias("n_sentences"))


def oracle() -> str:
    """The same recognition in DuckDB SQL over `documents`."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    cut = "chr(1)"
    known = "[" + ", ".join(map(q, SENTENCES)) + "]"
    norm = f"regexp_replace(trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')), {q(HOLDER)}, {q(ANY_HOLDER)})"
    ends = lambda t: f"regexp_replace({t}, {q(END)}, '\\1' || {cut}, 'g')"
    paragraphs = ends(f"regexp_replace(regexp_replace(regexp_replace(t, {q(BLANK)}, {cut}, 'g'), {q(ITEM)}, {cut}, 'g'), {q(COLON)}, {cut}, 'g')")
    lines = f"replace({ends('t')}, chr(10), {cut})"
    numbers = lambda t: f"list_transform(list_filter(list_transform(string_split({t}, {cut}), lambda s: {norm}), lambda s: NOT regexp_matches(s, {q(NEUTRAL)})), lambda s: coalesce(list_position({known}, s), 0))"
    rules = ordered(RULES)
    chain = lambda v: ", ".join([f"array_to_string(list_transform({v}, lambda i: '<' || i || '>'), '') {v}0"] + [f"contains({v}{k}, '{_text(s)}') f{v}{k}, replace({v}{k}, '{_text(s)}', '<>') {v}{k + 1}" for k, (_, s) in enumerate(rules)])
    found = ", ".join(f"CASE WHEN f{v}{k} THEN '{n}' END" for v in "ab" for k, (n, _) in enumerate(rules))
    return f"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') t FROM documents),
i AS (SELECT doc_id, {numbers(paragraphs)} a, {numbers(lines)} b FROM d),
j AS (SELECT doc_id, list_filter(a, lambda i: i > 0) ka, list_filter(b, lambda i: i > 0) kb, {chain("a")}, {chain("b")} FROM i),
k AS (SELECT doc_id, CASE WHEN len(ka) >= len(kb) THEN ka ELSE kb END ids, list_sort(list_distinct(list_filter([{found}], lambda x: x IS NOT NULL))) l FROM j)
SELECT doc_id, coalesce(array_to_string(ids, ','), '') sentence_ids, coalesce(array_to_string(l, ','), '') licences, CAST(len(ids) AS BIGINT) n_sentences FROM k"""
