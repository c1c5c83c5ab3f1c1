"""Licence recognition by known sentences and ordered rules (native expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import let, named

# Sentences of public licences and common references to them, by identifier, normalised
# (lower case, runs of other characters than a-z and 0-9 as one space).
SENTENCES: dict[str, tuple[str, ...]] = {
    "mit-title": ("mit license", "the mit license", "the mit license mit"),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "mit-notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "mit-warranty": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "mit-reference": ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "distributed under the mit license", "this software is released under the mit license", "spdx license identifier mit"),
    "apache-title": ("apache license",),
    "apache-reference": ("licensed under the apache license version 2 0", "released under the apache license version 2 0", "this project is licensed under the apache license version 2 0", "spdx license identifier apache 2 0", "licensed under the apache license version 2 0 the license"),
    "apache-compliance": ("you may not use this file except in compliance with the license", "you may obtain a copy of the license at"),
    "apache-warranty": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",),
    "apache-terms": ("see the license for the specific language governing permissions and limitations under the license",),
    "bsd-grant": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd-source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd-binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd-names": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "bsd-warranty": ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",),
    "bsd-2-reference": ("licensed under the bsd 2 clause license", "spdx license identifier bsd 2 clause"),
    "bsd-3-reference": ("licensed under the bsd 3 clause license", "spdx license identifier bsd 3 clause"),
    "isc-grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "gpl-free": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "gpl-2-free": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",),
    "gpl-warranty": ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",),
    "gpl-reference": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "spdx license identifier gpl 3 0 only", "spdx license identifier gpl 3 0 or later"),
    "mpl-reference": ("this source code form is subject to the terms of the mozilla public license v 2 0", "spdx license identifier mpl 2 0"),
    "cc-by": ("licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    "cc-by-sa": ("licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    "cc-by-nc": ("licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "cc-0": ("licensed under cc0 1 0", "spdx license identifier cc0 1 0"),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
}
# Rules in order; each a licence and the sentences that state it, one after the other.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-reference", "apache-compliance", "apache-compliance", "apache-warranty", "apache-terms")),
    ("Apache-2.0", ("apache-reference", "apache-compliance")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-warranty")),
    ("GPL-2.0-or-later", ("gpl-2-free", "gpl-warranty")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl-2-free",)),
    ("ISC", ("isc-grant",)),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-reference",)),
    ("Apache-2.0", ("apache-reference",)),
    ("BSD-2-Clause", ("bsd-2-reference",)),
    ("BSD-3-Clause", ("bsd-3-reference",)),
    ("GPL-3.0", ("gpl-reference",)),
    ("MPL-2.0", ("mpl-reference",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC0-1.0", ("cc-0",)),
    ("Unlicense", ("unlicense",)),
)
#: Every known sentence holds one of these, so others need no look-up.
CUES = r"(?i)licen[cs]e|permission|copyright|redistribut|warrant|free software|public domain|cc by|cc0"
#: Sentences end at a stop before white space; the second form also at line breaks.
FLOWING, BY_LINE = r"(?<=[.!?;:])\s+", r"(?<=[.!?;:])\s+|\n"


def _identifiers(text: Column, ends: str) -> Column:
    """The identifiers of a text's known sentences in order, as '|a|b|'."""
    known = F.create_map(*[F.lit(v) for name, forms in SENTENCES.items() for form in forms for v in (form, name)])
    plain = lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))
    likely = F.filter(F.split(text, ends, -1), lambda s: s.rlike(CUES))
    found = F.filter(F.transform(likely, lambda s: F.try_element_at(known, plain(s))), lambda i: i.isNotNull())
    return F.when(text.rlike(CUES), F.concat(F.lit("|"), F.array_join(found, "|"), F.lit("|"))).otherwise(F.lit("||"))


def _rule(licence: str, pattern: str):
    """A step from (rest, found) to the same after the rule."""

    def step(s: Column) -> Column:
        hit = F.contains(s["rest"], F.lit(pattern))
        # twice, since neighbouring matches share a bar
        cut = F.replace(F.replace(s["rest"], F.lit(pattern), F.lit("|#|")), F.lit(pattern), F.lit("|#|"))
        return F.struct(
            F.when(hit, cut).otherwise(s["rest"]).alias("rest"),
            F.when(hit, F.concat(s["found"], F.array(F.lit(licence)))).otherwise(s["found"]).alias("found"),
        )

    return step


def _licences(identifiers: Column) -> Column:
    """Licences of the rules that match, in rule order; what a rule matches is taken out before the next."""
    state = F.struct(identifiers.alias("rest"), F.array().cast("array<string>").alias("found"))
    for licence, sequence in RULES:
        state = let(state, _rule(licence, "|" + "|".join(sequence) + "|"))
    return state["found"]


def scan_licences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, sentences (identifiers in order, joined by |) and licences (distinct, sorted, joined by a comma).

    Whole texts are read twice: with each line a sentence of its own, and with single line breaks as
    white space, for licences that are wrapped. A rule matches where its sentences stand one after the other
    among the known ones; rules apply in order, and what one has matched is not matched again.
    `sentences` is that of the reading by lines, or of the other if that finds none. Null and empty
    texts have neither; repeated rows give a row each; no rows give no rows; no shuffle.
    """
    base = docs.select(named(doc_id).alias("doc_id"), F.coalesce(named(text), F.lit("")).alias("text"))
    read = base.select("doc_id", _identifiers(F.col("text"), BY_LINE).alias("by_line"), _identifiers(F.regexp_replace(F.regexp_replace("text", r"\n\s*\n", ". "), r"\s+", " "), FLOWING).alias("flowing"))
    some = F.when(F.col("by_line") != "||", F.col("by_line")).otherwise(F.col("flowing"))
    quiet = (F.col("by_line") == "||") & (F.col("flowing") == "||")
    both = F.array_sort(F.array_union(_licences(F.col("by_line")), _licences(F.col("flowing"))))
    return read.select(
        "doc_id", F.trim(some, F.lit("|")).alias("sentences"),
        F.when(quiet, F.lit("")).otherwise(F.array_join(both, ",")).alias("licences"),
    )


def scan_sql(table: str = "documents") -> str:
    """The same in SQL, from the same tables of sentences and rules."""
    values = ", ".join(f"('{form}', '{name}')" for name, forms in SENTENCES.items() for form in forms)
    steps, last = [], "seqs"
    for n, (licence, sequence) in enumerate(RULES):
        pattern = "|" + "|".join(sequence) + "|"
        steps.append(
            f"r{n} AS (SELECT doc_id, way, CASE WHEN contains(rest, '{pattern}') THEN replace(replace(rest, '{pattern}', '|#|'), '{pattern}', '|#|') ELSE rest END AS rest, "
            f"CASE WHEN contains(rest, '{pattern}') THEN list_append(found, '{licence}') ELSE found END AS found FROM {last})")
        last = f"r{n}"
    return rf"""
WITH known(form, name) AS (VALUES {values}),
marked AS (
    SELECT doc_id, 1 AS way, regexp_replace(coalesce(text, ''), '([.!?;:])\s+|\n', '\1' || chr(1), 'g') AS t FROM {table}
    UNION ALL
    SELECT doc_id, 2, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\n\s*\n', '. ', 'g'), '\s+', ' ', 'g'), '([.!?;:])\s+', '\1' || chr(1), 'g') FROM {table}
), parts AS (
    SELECT doc_id, way, unnest(string_split(t, chr(1))) AS s, generate_subscripts(string_split(t, chr(1)), 1) AS i FROM marked
), named AS (
    SELECT doc_id, way, string_agg(name, '|' ORDER BY i) AS ids
    FROM parts JOIN known ON trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) = form GROUP BY doc_id, way
), seqs AS (
    SELECT m.doc_id, m.way, '|' || coalesce(ids, '') || '|' AS rest, []::VARCHAR[] AS found FROM marked m LEFT JOIN named n ON m.doc_id = n.doc_id AND m.way = n.way
), {', '.join(steps)}
SELECT doc_id, coalesce(max(ids) FILTER (WHERE way = 1), max(ids) FILTER (WHERE way = 2), '') AS sentences,
    coalesce(array_to_string(list_sort(list_distinct(flatten(list(found)))), ','), '') AS licences
FROM {last} LEFT JOIN named USING (doc_id, way) GROUP BY doc_id
"""
