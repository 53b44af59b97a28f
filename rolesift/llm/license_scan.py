"""License scans: sentences become identifiers, identifier sequences are matched against ordered rules.

A text is read twice, as lines and as sentences that may run over lines.
Sentences are normalised (ASCII lower case, everything but letters and digits
is one blank) and looked up among the known ones. What both readings know is
merged by its place, counted in letters and digits, which line ends and full
stops do not change; of two that overlap the one that holds the other counts.
The identifiers of a text, in order, form a sequence; each rule in turn takes all places where its own
sequence stands and reports its licence. What no rule takes is left over.

Only Column functions; nothing is shuffled. Every known sentence holds one of
the KEYWORDS, so texts and sentences without any are passed over exactly.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.functions.text import let, sql_text
from rolesift.llm.base import aside, ascii_lower

# Sentences of public licences, as normalised, with our identifiers.
SENTENCES = {
    "apache2_named": "licensed under the apache license version 2 0",
    "apache2_full": "licensed under the apache license version 2 0 the license",
    "apache2_use": "you may not use this file except in compliance with the license",
    "apache2_copy": "you may obtain a copy of the license at",
    "apache2_as_is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed "
                     "on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2_see": "see the license for the specific language governing permissions and limitations under the license",
    "mit_named": "released under the mit license",
    "mit_licensed": "licensed under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                 "documentation files the software to deal in the software without restriction including without limitation the "
                 "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
                 "persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of "
                  "the software",
    "mit_warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the "
                    "warranties of merchantability fitness for a particular purpose and noninfringement",
    "bsd_redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that "
                          "the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following "
                  "disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
                  "disclaimer in the documentation and or other materials provided with the distribution",
    "gpl3_named": "this work is licensed under the gnu general public license version 3",
    "gpl_terms": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
                 "license as published by the free software foundation either version 3 of the license or at your option any later "
                 "version",
    "gpl_warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied "
                    "warranty of merchantability or fitness for a particular purpose",
    # The same notices as sentences: they are cut at colons and semicolons.
    "gpl3_terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
                  "software foundation either version 3 of the license or at your option any later version",
    "gpl_terms_any": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
                     "software foundation",
    "lgpl3_terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the "
                   "free software foundation either version 3 of the license or at your option any later version",
    "lgpl_terms_any": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by "
                      "the free software foundation",
    "version2": "either version 2 of the license or at your option any later version",
    "version2_1": "either version 2 1 of the license or at your option any later version",
    "gpl_no_warranty": "this program is distributed in the hope that it will be useful but without any warranty",
    "lgpl_no_warranty": "this library is distributed in the hope that it will be useful but without any warranty",
    "gpl_implied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl_see": "see the gnu lesser general public license for more details",
    "gpl_received": "you should have received a copy of the gnu general public license along with this program",
    "lgpl_received": "you should have received a copy of the gnu lesser general public license along with this library",
    "mpl2_terms": "this source code form is subject to the terms of the mozilla public license v",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
                 "provided that the above copyright notice and this permission notice appear in all copies",
    "isc_grant_and": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted "
                     "provided that the above copyright notice and this permission notice appear in all copies",
    "isc_warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all "
                    "implied warranties of merchantability and fitness",
    "bsd_neither": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                   "derived from this software without specific prior written permission",
    "gpl_see": "see the gnu general public license for more details",
    "ccbync4_named": "licensed under cc by nc 4 0",
    "ccby4_named": "licensed under cc by 4 0",
    "ccbysa4_named": "licensed under cc by sa 4 0",
    "agpl3_terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the "
                   "free software foundation either version 3 of the license or at your option any later version",
    "agpl_see": "see the gnu affero general public license for more details",
    "unlicense_domain": "this is free and unencumbered software released into the public domain",
    "zlib_warranty": "this software is provided as is without any express or implied warranty",
    "zlib_grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and "
                  "redistribute it freely subject to the following restrictions",
    "cc0_waived": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "all_rights": "copyright all rights reserved",
    "rights_reserved": "all rights reserved",
}
# Ordered: a rule comes before those whose sequences are parts of its own.
RULES = [
    ("MIT", ["mit_grant", "mit_notice", "mit_warranty"]),
    ("MIT", ["mit_named"]),
    ("MIT", ["mit_licensed"]),
    ("Apache-2.0", ["apache2_full", "apache2_use", "apache2_copy", "apache2_as_is", "apache2_see"]),
    ("Apache-2.0", ["apache2_full", "apache2_use"]),
    ("Apache-2.0", ["apache2_named"]),
    ("BSD-3-Clause", ["bsd_redistribution", "bsd_source", "bsd_binary", "bsd_neither"]),
    ("BSD-2-Clause", ["bsd_redistribution", "bsd_source", "bsd_binary"]),
    ("GPL-3.0-or-later", ["gpl_terms", "gpl_warranty", "gpl_see"]),
    ("GPL-3.0-or-later", ["gpl_terms"]),
    ("GPL-3.0-or-later", ["gpl3_terms", "gpl_no_warranty", "gpl_implied", "gpl_see", "gpl_received"]),
    ("GPL-3.0-or-later", ["gpl3_terms", "gpl_no_warranty", "gpl_implied", "gpl_see"]),
    ("GPL-3.0-or-later", ["gpl3_terms"]),
    ("GPL-2.0-or-later", ["gpl_terms_any", "version2", "gpl_no_warranty", "gpl_implied", "gpl_see", "gpl_received"]),
    ("GPL-2.0-or-later", ["gpl_terms_any", "version2", "gpl_no_warranty", "gpl_implied", "gpl_see"]),
    ("GPL-2.0-or-later", ["gpl_terms_any", "version2"]),
    ("LGPL-3.0-or-later", ["lgpl3_terms", "lgpl_no_warranty", "gpl_implied", "lgpl_see", "lgpl_received"]),
    ("LGPL-3.0-or-later", ["lgpl3_terms"]),
    ("LGPL-2.1-or-later", ["lgpl_terms_any", "version2_1", "lgpl_no_warranty", "gpl_implied", "lgpl_see", "lgpl_received"]),
    ("LGPL-2.1-or-later", ["lgpl_terms_any", "version2_1"]),
    ("AGPL-3.0-or-later", ["agpl3_terms", "gpl_no_warranty", "gpl_implied", "agpl_see"]),
    ("AGPL-3.0-or-later", ["agpl3_terms"]),
    ("Unlicense", ["unlicense_domain"]),
    ("Zlib", ["zlib_warranty", "zlib_grant"]),
    ("CC0-1.0", ["cc0_waived"]),
    ("MPL-2.0", ["mpl2_terms"]),
    ("ISC", ["isc_grant", "isc_warranty"]),
    ("ISC", ["isc_grant_and", "isc_warranty"]),
    ("ISC", ["isc_grant"]),
    ("ISC", ["isc_grant_and"]),
    ("GPL-3.0", ["gpl3_named"]),
    ("CC-BY-NC-4.0", ["ccbync4_named"]),
    ("CC-BY-SA-4.0", ["ccbysa4_named"]),
    ("CC-BY-4.0", ["ccby4_named"]),
    ("All rights reserved", ["all_rights"]),
    ("All rights reserved", ["rights_reserved"]),
]
# One line of a file's head names a licence by its identifier.
IDENTIFIERS = [
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "Unlicense", "BSL-1.0", "MPL-2.0", "EPL-2.0", "CC0-1.0", "CC-BY-4.0",
    "CC-BY-SA-4.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later",
]
for identifier in IDENTIFIERS:
    words = re.sub("[^a-z0-9]+", " ", identifier.lower())
    SENTENCES[f"spdx_{words.replace(' ', '_')}"] = f"spdx license identifier {words}"
    RULES.append((identifier, [f"spdx_{words.replace(' ', '_')}"]))
KEYWORDS = ["licen", "permission", "redistribut", "warrant", "copyright", "rights[^a-z0-9]+reserved", "unencumbered"]
#: Stands where a rule took its sentences, so those around it do not become neighbours.
TAKEN = "|"
KEYWORD = "|".join(KEYWORDS)
LINE_END = r"\n+"
SENTENCE_END = r"[.!?:;]+(?:\s+|$)|\n\s*\n"

assert all(re.search(KEYWORD, s) for s in SENTENCES.values())


def normalised(sentence: Column) -> Column:
    return F.btrim(F.regexp_replace(ascii_lower(sentence), "[^a-z0-9]+", " "))


def known_in(text: Column, end: str) -> Column:
    """at, back and id of the known sentences of a text, in order; back is the negative place of the end."""
    known = F.expr("map(" + ", ".join(f"{sql_text(s)}, {sql_text(f'<{i}>')}" for i, s in SENTENCES.items()) + ")")
    pieces = F.transform(F.split(text, end, -1), lambda s: F.struct(
        F.length(F.regexp_replace(s, "[^A-Za-z0-9]+", "")).alias("size"),
        F.when(ascii_lower(s).rlike(KEYWORD), known[normalised(s)]).alias("id")))
    start = F.expr("struct(0 AS at, CAST(array() AS array<struct<at: int, back: int, id: string>>) AS found)")

    def step(state: Column, piece: Column) -> Column:
        stop = state["at"] + piece["size"]
        entry = F.struct(state["at"].alias("at"), (-stop).alias("back"), piece["id"].alias("id"))
        return F.struct(stop.alias("at"), F.when(piece["id"].isNull(), state["found"]).otherwise(F.array_append(state["found"], entry)).alias("found"))

    return F.aggregate(pieces, start, step, lambda state: state["found"])


def sequence_of(text: Column) -> Column:
    """Identifiers of the known sentences of both readings of a text, in order, as one string."""
    every = F.sort_array(F.concat(known_in(text, LINE_END), known_in(text, SENTENCE_END)))

    def step(state: Column, entry: Column) -> Column:
        # In this order an entry that ends no later than one before it is held by that one.
        fresh = F.struct((-entry["back"]).alias("stop"), F.concat(state["ids"], entry["id"]).alias("ids"))
        return F.when(-entry["back"] > state["stop"], fresh).otherwise(state)

    return F.aggregate(every, F.expr("struct(0 AS stop, '' AS ids)"), step, lambda state: state["ids"])


def matched(sequence: Column) -> Column:
    """left (what no rule took) and found (licences in the order of the rules) of a sequence."""
    rules = F.expr("array(" + ", ".join(
        f"struct({sql_text(licence)} AS licence, {sql_text(''.join(f'<{i}>' for i in ids))} AS ids)" for licence, ids in RULES) + ")")
    start = F.struct(sequence.alias("left"), F.expr("CAST(array() AS array<string>)").alias("found"))

    def apply(state: Column, rule: Column) -> Column:
        taken = F.struct(
            F.replace(state["left"], rule["ids"], F.lit(TAKEN)).alias("left"), F.array_append(state["found"], rule["licence"]).alias("found"))
        return F.when(F.contains(state["left"], rule["ids"]), taken).otherwise(state)

    return F.when(sequence == "", start).otherwise(F.aggregate(rules, start, apply))


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, licences (comma-joined), n_sentences, n_left per row of ``docs``.

    NULL and empty texts have none. Rows are read alone: repeated rows and NULL
    ids give a row each, other columns are not read. ``n_sentences`` counts
    known sentences of both readings, each place once.
    """
    rows = aside(docs, {"doc_id": id_column, "text": text_column})
    text = F.when(ascii_lower(F.col("text")).rlike(KEYWORD), F.col("text")).otherwise("")
    read = rows.select(F.col("doc_id"), let(text, sequence_of).alias("s"))
    size = F.length("s") - F.length(F.replace(F.col("s"), F.lit("<"), F.lit("")))
    out = read.select("doc_id", size.cast("long").alias("n_sentences"), let(F.col("s"), matched).alias("m"))
    left = F.length("m.left") - F.length(F.replace(F.col("m.left"), F.lit("<"), F.lit("")))
    return out.select(
        "doc_id", F.array_join(F.array_distinct("m.found"), ",").alias("licences"), "n_sentences", left.cast("long").alias("n_left"))
