"""Licence recognition from sentences, as DataFrame expressions only.

Texts that hold one of a few tell-tale words are cut into sentences. Each
normalised sentence is looked up among known licence sentences, and the
sequence of their identifiers is matched against ordered rules: a licence is
recognised where a rule's identifiers follow each other in order, with other
sentences between them or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Known licence sentences, normalised (lower case, runs of
# anything but a-z and 0-9 as one blank), by identifier.
SENTENCES = {
    "apache-name": "licensed under the apache license version 2 0",
    "apache-defined": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-name": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-use": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "gpl3-name": "this work is licensed under the gnu general public license version 3",
    "gpl2-name": "this work is licensed under the gnu general public license version 2",
    "gpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "mpl-terms": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "cc-by-nc-name": "licensed under cc by nc 4 0",
    "cc-by-name": "licensed under cc by 4 0",
    "cc-by-sa-name": "licensed under cc by sa 4 0",
    "cc-by-long": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-long": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-long": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
}

# Rules as (licence, form, identifiers in order).
RULES = (
    ("Apache-2.0", "notice", ("apache-defined", "apache-comply", "apache-copy", "apache-as-is", "apache-see")),
    ("Apache-2.0", "notice without name", ("apache-comply", "apache-copy", "apache-as-is", "apache-see")),
    ("Apache-2.0", "name", ("apache-name",)),
    ("Apache-2.0", "name", ("apache-defined",)),
    ("MIT", "text", ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("MIT", "name", ("mit-name",)),
    ("MIT", "name", ("mit-licensed",)),
    ("BSD-3-Clause", "text", ("bsd-use", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", "text", ("bsd-use", "bsd-source", "bsd-binary")),
    ("ISC", "text", ("isc-grant",)),
    ("GPL-3.0-or-later", "notice", ("gpl3-free", "gpl-hope", "gpl-see")),
    ("GPL-3.0-or-later", "short notice", ("gpl3-free",)),
    ("GPL-2.0-or-later", "notice", ("gpl2-free", "gpl-hope", "gpl-see")),
    ("GPL-2.0-or-later", "short notice", ("gpl2-free",)),
    ("GPL-3.0-only", "name", ("gpl3-name",)),
    ("GPL-2.0-only", "name", ("gpl2-name",)),
    ("MPL-2.0", "notice", ("mpl-terms",)),
    ("Unlicense", "text", ("unlicense-free",)),
    ("CC-BY-NC-4.0", "name", ("cc-by-nc-name",)),
    ("CC-BY-NC-4.0", "long name", ("cc-by-nc-long",)),
    ("CC-BY-4.0", "name", ("cc-by-name",)),
    ("CC-BY-4.0", "long name", ("cc-by-long",)),
    ("CC-BY-SA-4.0", "name", ("cc-by-sa-name",)),
    ("CC-BY-SA-4.0", "long name", ("cc-by-sa-long",)),
)

#: every known sentence holds one of these, so a text without any has none
TELL_TALES = ("licen", "permi", "redistribut", "copyright", "liab", "warrant", "unencumbered")

#: a sentence ends at a mark before white space, at a colon before a line end,
#: and at a line end: at any, or at an empty line only, for wrapped text
_ANY_LINE = r"(?<=[.;!?])\s+|:\s*\n|\n"
_EMPTY_LINE = r"(?<=[.;!?])\s+|:\s*\n|\n[^\p{L}\p{N}\n]*\n"


def normalised(sentence: Column) -> Column:
    """Lower case, with every run of other characters than a-z, 0-9 as a blank."""
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def sentence_ids(text: Column, ends: str) -> Column:
    """Numbers (from 1) of the known sentences of ``text``, in text order."""
    known = F.array(*map(F.lit, SENTENCES.values()))
    found = F.transform(F.split(text, ends), lambda s: F.array_position(known, normalised(s)))
    return F.filter(found, lambda n: n > 0)


def _rule_hits(ids: Column) -> list[Column]:
    """For each rule, whether its identifiers follow each other in ``ids``."""
    number = {name: n for n, name in enumerate(SENTENCES, 1)}
    line = F.concat(F.lit(" "), F.array_join(ids.cast("array<string>"), " "), F.lit(" "))
    return [line.rlike("".join(f" {number[s]}(?= )" + ("" if last else ".*?")
                               for last, s in ((i == len(rule) - 1, s) for i, s in enumerate(rule))))
            for _, _, rule in RULES]


def _covers(one: tuple[str, ...], other: tuple[str, ...]) -> bool:
    """Whether ``other`` is a shorter part, in order, of ``one``."""
    rest = iter(one)
    return len(one) > len(other) and all(s in rest for s in other)


def licences(ids: Column) -> Column:
    """Rules that match ``ids`` as an array of (licence, form), in rule order.

    A rule that is part of a longer matching rule is not reported.
    """
    hits = _rule_hits(ids)
    found = []
    for (name, form, rule), hit in zip(RULES, hits):
        longer = [h for (_, _, r), h in zip(RULES, hits) if _covers(r, rule)]
        for h in longer:
            hit = hit & ~h
        found.append(F.when(hit, F.struct(F.lit(name).alias("licence"), F.lit(form).alias("form"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def scan(docs: DataFrame) -> DataFrame:
    """Licence sentences and licences of every whole text of ``docs``.

    Needs doc_id and text; other columns are ignored. Returns one row per row:
    doc_id, sentences (identifiers in text order) and licences (array of licence
    and form). Sentences are looked for across line ends and line by line; the
    second reading adds the licences that the first has not found. Null and empty texts have empty arrays.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lower = F.lower(text)
    told = F.lit(False)
    for word in TELL_TALES:
        told = told | F.contains(lower, F.lit(word))
    names = F.array(*map(F.lit, SENTENCES))
    none = F.expr("cast(array() as array<bigint>)")
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(told, sentence_ids(text, _ANY_LINE)).otherwise(none).alias("by_line"),
        F.when(told, sentence_ids(text, _EMPTY_LINE)).otherwise(none).alias("wrapped"))
    # most rows have neither: no rule is tried for them
    empty = F.expr("cast(array() as array<struct<licence: string, form: string>>)")
    across, lines = licences(F.col("wrapped")), licences(F.col("by_line"))
    more = F.filter(lines, lambda x: ~F.exists(across, lambda y: y["licence"] == x["licence"]))
    rules = F.when(F.size("by_line") + F.size("wrapped") == 0, empty).otherwise(
        F.concat(across, more))
    longer = F.when(F.size("wrapped") > F.size("by_line"), F.col("wrapped")).otherwise(F.col("by_line"))
    return read.select(
        "doc_id",
        F.transform(longer, lambda n: F.element_at(names, n.cast("int"))).alias("sentences"),
        rules.alias("licences"))
