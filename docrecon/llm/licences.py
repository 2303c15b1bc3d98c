"""License scan: known licence sentences in a text, then licence rules over their order.

A text is written in lower-case letters and digits; wrapped lines are joined and comment marks go, while . ! ? and blank lines
end a sentence. Sentences and clauses that are known, from left to right and the longest first, become their identifiers, and
the rest is left out. A rule is a list of identifiers that must follow one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrecon.llm.common import free_names, load

# Licence sentences, in normal form, by identifier, and the ordered rules over them.
SENTENCES = {
    "apache2": "licensed under the apache license version 2.0",
    "apache2-header-1": "licensed under the apache license version 2.0 the license",
    "apache2-header-2": "you may not use this file except in compliance with the license",
    "apache2-header-3": "you may obtain a copy of the license at",
    "mit": "released under the mit license",
    "mit-2": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied",
    "gpl3": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "cc-by-nc4": "licensed under cc by nc 4.0",
    "cc-by4": "licensed under cc by 4.0",
    "bsd-redist": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "rights": "all rights reserved",
}
RULES = {
    "Apache-2.0": [["apache2"], ["apache2-header-1", "apache2-header-2"], ["apache2-header-2", "apache2-header-3"]],
    "BSD": [["bsd-redist"]],
    "CC-BY-4.0": [["cc-by4"]],
    "CC-BY-NC-4.0": [["cc-by-nc4"]],
    "GPL-3.0-only": [["gpl3"]],
    "GPL-3.0-or-later": [["gpl-free", "gpl-hope"], ["gpl-free"]],
    "MIT": [["mit"], ["mit-2"], ["mit-grant", "mit-notice"]],
    "Proprietary": [["rights"]],
}
#: More sentences and clauses, and rules over them; OP9_SQL has those above, which are all that the given tables hold.
_UNDER = "you can redistribute it and or modify it under the terms of the gnu "
_LATER = " as published by the free software foundation either version {} of the license or at your option any later version"
CLAUSES = {
    "apache2": ["licensed under the apache license 2.0", "licensed under the apache 2.0 license", "licensed under apache 2.0", "spdx license identifier apache 2.0"],
    "mit": ["licensed under mit", "distributed under the mit license", "available under the mit license", "spdx license identifier mit"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "licensed under the isc license", "spdx license identifier isc"],
    "gpl3": ["licensed under the gnu general public license v3.0", "licensed under the gnu general public license v3", "licensed under the gnu general public license version 3", "licensed under the gnu gpl v3", "licensed under the gpl v3", "licensed under the gplv3", "spdx license identifier gpl 3.0 only"],
    "gpl2": ["licensed under the gnu general public license v2.0", "licensed under the gnu general public license v2", "licensed under the gnu general public license version 2", "licensed under the gnu gpl v2", "licensed under the gpl v2", "licensed under the gplv2", "spdx license identifier gpl 2.0 only"],
    "gpl-free": [_UNDER + "general public license" + _LATER.format("3"), "spdx license identifier gpl 3.0 or later"],
    "gpl2-free": [_UNDER + "general public license" + _LATER.format("2"), "spdx license identifier gpl 2.0 or later"],
    "lgpl2-free": [_UNDER + "lesser general public license" + _LATER.format("2.1"), "spdx license identifier lgpl 2.1 or later"],
    "lgpl3-free": [_UNDER + "lesser general public license" + _LATER.format("3"), "spdx license identifier lgpl 3.0 or later"],
    "agpl3-free": [_UNDER + "affero general public license" + _LATER.format("3"), "spdx license identifier agpl 3.0 or later"],
    "gpl-hope": ["distributed in the hope that it will be useful but without any warranty"],
    "mpl2": ["subject to the terms of the mozilla public license v. 2.0", "licensed under the mozilla public license 2.0", "licensed under the mozilla public license version 2.0", "spdx license identifier mpl 2.0"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-endorse": ["may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-as-is": ["this software is provided by the copyright holders and contributors as is"],
    "bsd2": ["licensed under the bsd 2 clause license", "licensed under the 2 clause bsd license", "spdx license identifier bsd 2 clause"],
    "bsd3": ["licensed under the bsd 3 clause license", "licensed under the 3 clause bsd license", "spdx license identifier bsd 3 clause"],
    "unlicense": ["this is free and unencumbered software released into the public domain", "spdx license identifier unlicense"],
    "cc-by4": ["licensed under a creative commons attribution 4.0 international license", "licensed under the creative commons attribution 4.0 international license"],
    "cc-by-nc4": ["licensed under a creative commons attribution noncommercial 4.0 international license", "licensed under the creative commons attribution noncommercial 4.0 international license"],
    "cc-by-sa4": ["licensed under cc by sa 4.0", "licensed under a creative commons attribution sharealike 4.0 international license", "licensed under the creative commons attribution sharealike 4.0 international license"],
}
MORE_RULES = {
    "AGPL-3.0-or-later": [["agpl3-free"]],
    "BSD-2-Clause": [["bsd2"], ["bsd-redist", "bsd-source", "bsd-binary", "bsd-as-is"]],
    "BSD-3-Clause": [["bsd3"], ["bsd-redist", "bsd-source", "bsd-binary", "bsd-endorse"]],
    "CC-BY-SA-4.0": [["cc-by-sa4"]],
    "GPL-2.0-only": [["gpl2"]],
    "GPL-2.0-or-later": [["gpl2-free"]],
    "ISC": [["isc"]],
    "LGPL-2.1-or-later": [["lgpl2-free"]],
    "LGPL-3.0-or-later": [["lgpl3-free"]],
    "MPL-2.0": [["mpl2"]],
    "Unlicense": [["unlicense"]],
}
#: Each sentence or clause has one of these, so a text without any isn't searched.
HINTS = ["licens", "permission", "copyright", "rights reserved", "as is", "without any warranty", "redistribution", "public domain"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ODD = "[^a-z0-9.!?\\n]+"
BLANK = "( *\\n){2,}"
KNOWN = {s: name for name, s in SENTENCES.items()} | {s: name for name, own in CLAUSES.items() for s in own}
ANY = "(?<![a-z0-9])(?:" + "|".join(s.replace(".", "[.]") for s in sorted(KNOWN, key=len, reverse=True)) + ")(?![a-z0-9]|[.][0-9])"


def plain(text: Column) -> Column:
    """The text in normal form, its wrapped lines joined; a blank line ends a sentence."""
    odd = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), ODD, " ")
    return F.regexp_replace(F.regexp_replace(odd, BLANK, " ! "), "[ \\n]+", " ")


def scan_licences(docs: DataFrame) -> DataFrame:
    """docs with sentence_ids string (identifiers in text order, joined by |), n_sentences long (how many), licences string
    (names of the rules that hold, ascending, joined by |). Null and texts without known sentences: '', 0, ''. Line
    by line, so a text of any length is one row's work; repeated rows give the same result each."""
    docs = free_names(docs, ["sentence_ids", "n_sentences", "licences"])
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    text = plain(F.col("text"))
    hinted = F.regexp_replace(F.translate(F.col("text"), UPPER, LOWER), "[^a-z]+", " ").rlike("|".join(HINTS))
    ids = F.when(hinted, F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda s: F.element_at(known, s))).otherwise(F.array().cast("array<string>"))
    out = docs.withColumn("sentence_ids", F.array_join(ids, "|"))
    line = F.concat(F.lit("|"), F.col("sentence_ids"), F.lit("|"))
    held = []
    for name, ways in sorted((RULES | MORE_RULES).items()):
        holds = F.lit(False)
        for way in ways:
            holds = holds | line.contains("|" + "|".join(way) + "|")
        held.append(F.when(holds, F.lit(name)))
    return out.withColumns({"n_sentences": F.when(F.col("sentence_ids") == "", 0).otherwise(F.size(F.split("sentence_ids", "[|]"))).cast("long"), "licences": F.concat_ws("|", *held)})


def op9_licences(spark, sf_dir: str) -> DataFrame:
    return scan_licences(load(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = "map {" + ", ".join(f"{quoted(s)}: {quoted(n)}" for n, s in SENTENCES.items()) + "}"
    cases = ", ".join("CASE WHEN " + " OR ".join(f"contains('|' || sentence_ids || '|', {quoted('|' + '|'.join(w) + '|')})" for w in ways) + f" THEN {quoted(name)} END" for name, ways in RULES.items())
    return f"""
WITH parts AS (
  SELECT doc_id, list_transform(string_split_regex(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^a-z0-9.!?\\n]+', ' ', 'g') || chr(10), '[.!?]+ |[.!?]*\\n'), lambda s: trim(s)) AS s
  FROM documents),
found AS (
  SELECT doc_id, array_to_string(list_filter(list_transform(s, lambda x: {known}[x]), lambda x: x IS NOT NULL), '|') AS sentence_ids FROM parts)
SELECT doc_id, sentence_ids, CASE WHEN sentence_ids = '' THEN 0 ELSE length(sentence_ids) - length(replace(sentence_ids, '|', '')) + 1 END::BIGINT AS n_sentences,
  concat_ws('|', {cases}) AS licences
FROM found"""


OP9_SQL = _sql()
