"""Licence scan by sentence rules, in DataFrame functions only.

A text is cut into sentences at ``. ; ! ?`` before a blank and at blank lines (lines without
letters a-z and digits, such as bare comment marks), each sentence normalised (A-Z lowered,
everything but letters a-z and digits a blank, which also drops comment marks). A sentence
may run over several lines: one that a licence is known by has an identifier where it starts with
a line and ends with that or a later line of the sentence, the longest first; all others have none. A line
"SPDX-License-Identifier:" with an expression (A OR B, A AND B, A WITH exception) counts as one sentence
for each of its terms. The identifiers of a text, in order, form its sequence; the rules are tried in their order, a
rule matches where its identifiers stand next to each other in the sequence, and what a
rule matched is taken out before later rules, so a full licence wins over its parts.

Every known sentence holds one of CUES (a test holds this), so texts without a cue
have an empty sequence; that check comes first and is exact. No shuffle, no Python.

Defined cases: a null or empty text has no sentences and no licence; repeated rows each
get a row; an empty table gives an empty result; a null doc_id stays null; other
columns are not looked at; long texts are scanned whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUES = ("licen", "copyright", "warrant", "permission", "redistribut", "liab", "public domain", "spdx", "released under", "distributed under")

# Sentences of licence texts and notices, as published.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "you may not use this file except in compliance with the License.",
    "You may obtain a copy of the License at",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "See the License for the specific language governing permissions and limitations under the License.",
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_UNLICENSE = "This is free and unencumbered software released into the public domain."
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "See the GNU General Public License for more details.",
)
_GPL2 = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
_LESSER2 = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
_LESSER3 = "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
_AFFERO = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty.",
    "In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
)
_BOOST = "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"
# Titles as the full texts have them, maybe over two lines.
TITLES = {
    "GPL-2.0": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "Apache-2.0": "Apache License Version 2.0, January 2004",
    "MPL-2.0": "Mozilla Public License Version 2.0",
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003",
    "EPL-2.0": "Eclipse Public License - v 2.0",
    "CC-BY-4.0": "Creative Commons Attribution 4.0 International Public License",
    "CC-BY-SA-4.0": "Creative Commons Attribution-ShareAlike 4.0 International Public License",
    "CC-BY-NC-4.0": "Creative Commons Attribution-NonCommercial 4.0 International Public License",
    "CC-BY-ND-4.0": "Creative Commons Attribution-NoDerivatives 4.0 International Public License",
}
# Short notices; {} stands for the names below.
NOTICES = ("Licensed under {}.", "Licensed under the {}.", "Released under {}.", "Released under the {}.", "Distributed under {}.",
           "Distributed under the {}.", "This work is licensed under {}.", "This work is licensed under the {}.",
           "This project is licensed under the {}.", "This software is released under the {}.")
NAMES = {
    "MIT": ("MIT License", "MIT licence"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("GNU Affero General Public License, version 3",),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "CC0-1.0": ("CC0 1.0",),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0",),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0",),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0",),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    "Zlib": ("zlib License",),
}
# Further identifiers that stand after "SPDX-License-Identifier:".
IDENTIFIERS = ("0BSD", "AFL-3.0", "Artistic-2.0", "BSD-4-Clause", "CDDL-1.0", "EPL-1.0", "EUPL-1.2", "GPL-1.0", "ISC", "LGPL-2.0", "MIT-0", "MPL-1.1",
               "MS-PL", "NCSA", "OFL-1.1", "PostgreSQL", "Unlicense", "UPL-1.0", "WTFPL")
SPDX = "spdx license identifier "


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in sentence)).strip()


def _parts(sentence: str) -> list[str]:
    """Normalised sentences of a known one, cut by the same rule as a text."""
    return [n for n in map(normal, re.split(r"\n+", re.sub(r"([.;!?])[^A-Za-z0-9\s]*\s+", r"\1\n", sentence))) if n]


def _tables() -> tuple[dict[str, int], list[tuple[str, tuple[int, ...]]]]:
    ids: dict[str, int] = {}

    def seq(*sentences: str) -> tuple[int, ...]:
        return tuple(ids.setdefault(p, len(ids) + 1) for s in sentences for p in _parts(s) if any(c in p for c in CUES))

    rules = [
        ("MIT", seq(*_MIT)), ("MIT", seq(*_MIT[:2])), ("BSD-3-Clause", seq(*_BSD)), ("BSD-2-Clause", seq(*_BSD[:3])),
        ("Apache-2.0", seq(*_APACHE)), ("Apache-2.0", seq(*_APACHE[:2])), ("GPL-3.0", seq(*_GPL)), ("GPL-3.0", seq(_GPL[0])),
        ("GPL-2.0", seq(_GPL2)), ("ISC", seq(_ISC)), ("MPL-2.0", seq(_MPL)), ("Unlicense", seq(_UNLICENSE)),
        ("LGPL-2.1", seq(_LESSER2)), ("AGPL-3.0", seq(_AFFERO)), ("Zlib", seq(*_ZLIB)), ("BSL-1.0", seq(_BOOST))]
    rules += [("LGPL-3.0", seq(f"This {what} is free software: you can redistribute it and/or modify {_LESSER3}")) for what in ("library", "program")]
    rules += [(name, seq(title)) for name, title in TITLES.items()]
    for name, spoken in NAMES.items():
        for notice in NOTICES:
            rules += [(name, seq(notice.format(x))) for x in spoken]
    for name in (*NAMES, *IDENTIFIERS):
        rules.append((name, seq(f"SPDX-License-Identifier: {name}")))
        if "GPL" in name:
            rules += [(name, seq(f"SPDX-License-Identifier: {name}-{x}")) for x in ("only", "orlater")]
    return ids, rules


SENTENCE_IDS, RULES = _tables()
# A lowered text has no capitals, so H can stand for the end of a sentence and L for a line
# break within one (LL: the end of a line and the start of the next).
CUTS = ((r"\r\n?", "\n"), (r"\n[^a-z0-9\n]+", "\n"), (r"[.;!?][^a-z0-9\t-\r ]*[\t-\r ]+", "H"), (r"\n\n+", "H"), (r"\n", "L"), ("[^a-z0-9HL]+", " "),
        ("[ L]*H[ HL]*", "H"), (" ?L ?", "LL"), ("^[ HL]+|[ HL]+$", ""))
OF_LINES = f"L({SPDX}[^L]+|" + "|".join(
    x.replace(" ", "(?: |LL)") for x in sorted(SENTENCE_IDS, key=lambda x: (-len(x), x)) if not x.startswith(SPDX)) + ")L"


def sentences(text: Column) -> Column:
    """Normalised sentences of a text, in order, with LL for line breaks."""
    cut = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for pattern, by in CUTS:
        cut = F.regexp_replace(cut, pattern, by)
    return F.split(cut, "H")


def candidates(text: Column) -> Column:
    """Sentences of one line, and known sentences that are lines of a longer one, in order."""
    lines = F.flatten(F.transform(sentences(text), lambda s: F.when(s.contains("L"), F.transform(
        F.regexp_extract_all(F.concat(F.lit("L"), s, F.lit("L")), F.lit(OF_LINES), F.lit(1)), lambda m: F.replace(m, F.lit("LL"), F.lit(" ")))).otherwise(F.array(s))))
    # an expression of identifiers is one such sentence for each of them
    return F.flatten(F.transform(lines, lambda s: F.when(s.startswith(SPDX), F.split(F.regexp_replace(
        F.replace(s, F.lit(" or later"), F.lit(" orlater")), " (or|and|with) ", f"H{SPDX}"), "H")).otherwise(F.array(s))))


def sequence(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCE_IDS.items() for x in pair])
    lower = F.lower(text)
    cued = lower.contains(CUES[0])
    for c in CUES[1:]:
        # a cue of two words may stand around any separator
        cued = cued | (lower.rlike(c.replace(" ", "[^a-z0-9]+")) if " " in c else lower.contains(c))
    found = F.filter(F.transform(F.filter(candidates(text), lambda s: F.array_contains(F.array(*[F.lit(x) for x in SENTENCE_IDS]), s)),
                                 lambda s: known[s]), lambda i: i.isNotNull())
    return F.when(cued, found).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_sentences (known ones), sentence_ids, licences (joined
    by commas in the order of the rules, each once), n_matches."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in ids)).alias("ids")) for name, ids in RULES])
    start = F.struct(F.concat_ws("", F.transform("sentence_ids", lambda i: F.concat(F.lit("<"), i.cast("string"), F.lit(">")))).alias("left"),
                     F.array().cast("array<string>").alias("names"), F.lit(0).cast("long").alias("n"))

    def step(state: Column, rule: Column) -> Column:
        rest = F.replace(state["left"], rule["ids"], F.lit("|"))
        times = ((F.length(state["left"]) - F.length(rest)) / (F.length(rule["ids"]) - 1)).cast("long")
        return F.when(state["left"].contains(rule["ids"]), F.struct(
            rest.alias("left"), F.array_union(state["names"], F.array(rule["name"])).alias("names"), (state["n"] + times).alias("n"))).otherwise(state)

    out = docs.select("doc_id", sequence(F.coalesce("text", F.lit(""))).alias("sentence_ids")).withColumn(
        "state", F.when(F.size("sentence_ids") > 0, F.aggregate(rules, start, step)))
    return out.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join(F.col("sentence_ids").cast("array<string>"), ",").alias("sentence_ids"),
                      F.coalesce(F.array_join("state.names", ","), F.lit("")).alias("licences"), F.coalesce("state.n", F.lit(0).cast("long")).alias("n_matches"))


def oracle() -> str:
    """The same result as DuckDB SQL: sentences unnested, joined with a table of known
    sentences, and the rules applied one after another by a recursive query."""
    cut = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    for pattern, by in CUTS:
        cut = f"regexp_replace({cut}, '{pattern}', {'chr(10)' if by == chr(10) else repr(by)}, 'g')"
    known = ", ".join(f"('{s}', {i})" for s, i in SENTENCE_IDS.items())
    rules = ", ".join(f"({k}, '{name}', '{''.join(f'<{i}>' for i in ids)}')" for k, (name, ids) in enumerate(RULES))
    return rf"""
WITH RECURSIVE known(sentence, id) AS (VALUES {known}),
rules(k, name, ids) AS (VALUES {rules}),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
parted AS (
  SELECT r, string_split({cut}, 'H') AS parts FROM docs
  WHERE regexp_matches(text, '(?i)licen|copyright|warrant|permission|redistribut|liab|public|spdx|released|distributed')),
cut AS (SELECT r, unnest(parts) AS s, generate_subscripts(parts, 1) AS part FROM parted),
matched AS (SELECT r, part, CASE WHEN contains(s, 'L') THEN regexp_extract_all('L' || s || 'L', '{OF_LINES}', 1) ELSE [s] END AS found FROM cut),
lines AS (SELECT r, part, replace(unnest(found), 'LL', ' ') AS s, generate_subscripts(found, 1) AS line FROM matched),
named AS (SELECT r, part, line, s, 0 AS term FROM lines WHERE NOT starts_with(s, '{SPDX}')
  UNION ALL
  SELECT r, part, line, '{SPDX}' || unnest(terms), generate_subscripts(terms, 1) FROM (
    SELECT r, part, line, regexp_split_to_array(replace(substr(s, {len(SPDX) + 1}), ' or later', ' orlater'), ' (?:or|and|with) ') AS terms
    FROM lines WHERE starts_with(s, '{SPDX}'))),
hit AS (SELECT r, part, line, term, known.id FROM named JOIN known ON s = known.sentence),
seqs AS (
  SELECT r, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY part, line, term) AS ids, string_agg('<' || id || '>', '' ORDER BY part, line, term) AS marks FROM hit GROUP BY r),
run AS (
  SELECT r, 0 AS k, marks AS rest, ''::VARCHAR AS names, 0::BIGINT AS n FROM seqs
  UNION ALL
  SELECT run.r, run.k + 1, replace(run.rest, rules.ids, '|'),
         CASE WHEN contains(run.rest, rules.ids) AND NOT contains(',' || run.names || ',', ',' || rules.name || ',')
              THEN CASE WHEN run.names = '' THEN rules.name ELSE run.names || ',' || rules.name END ELSE run.names END,
         run.n + (length(run.rest) - length(replace(run.rest, rules.ids, ''))) // length(rules.ids)
  FROM run JOIN rules ON rules.k = run.k)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_sentences, coalesce(s.ids, '') AS sentence_ids, coalesce(run.names, '') AS licences, coalesce(run.n, 0)::BIGINT AS n_matches
FROM docs d LEFT JOIN seqs s USING (r) LEFT JOIN run ON run.r = d.r AND run.k = {len(RULES)}
"""
