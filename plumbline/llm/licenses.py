"""Operator 5: licence scans by sentence rules, in DataFrame functions alone.

A text is cut into sentences and normalised (lower case, runs of anything but letters and digits become a space). The known
licence sentences in it give a sequence of identifiers. A licence is found where the identifiers of one of its rules occur
in that sequence in the rule's order, with or without others in between.

Notices are wrapped at any width, stand behind comment marks and have longer sentences than the known ones, so a known
sentence may go on over ends of lines and sentences. It must begin and end where the text's sentences do if it is shorter than
`FREE` words (it might be part of another sentence); longer ones count wherever they stand.

The known sentences are one regular expression, a tree of their words, and only texts with a word that each of them has (`HINTS`)
are read with it. Everything happens within a row: no shuffle, and the tables of sentences and rules are constants of the plan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common

#: Known licence sentences, normalised (fixed values). Identifiers are small numbers.
SENTENCES: dict[int, str] = {
    1: "licensed under the apache license version 2 0",
    2: "you may not use this file except in compliance with the license",
    3: "you may obtain a copy of the license at http www apache org licenses license 2 0",
    4: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    5: "licensed under the apache license version 2 0 the license",
    10: "released under the mit license",
    11: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    12: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    13: "the software is provided as is without warranty of any kind express or implied",
    14: "licensed under the mit license",
    20: "this work is licensed under the gnu general public license version 3",
    21: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    22: "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    23: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    30: "licensed under cc by nc 4 0",
    31: "licensed under cc by 4 0",
    32: "licensed under cc by sa 4 0",
    33: "this work is licensed under a creative commons attribution 4 0 international license",
    40: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    41: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    42: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    43: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    50: "this source code form is subject to the terms of the mozilla public license v 2 0",
    51: "the contents of this file are subject to the mozilla public license version 1 1",
    60: "this is free and unencumbered software released into the public domain",
    61: "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work",
    62: "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",
    63: "the author disclaims copyright to this source code",
    70: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    71: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    72: "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    73: "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    74: "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    75: "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted provided that the above copyright notice appears in all copies and that both the copyright notice and this permission notice appear in supporting documentation",
    80: "this software is provided as is without any express or implied warranty",
    81: "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    82: "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    83: "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
    84: "distributed under the boost software license version 1 0",
    90: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    91: "except as contained in this notice the name of the x consortium shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization from the x consortium",
    92: "except as contained in this notice the name of a copyright holder shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization of the copyright holder",
    93: "the software shall be used for good not evil",
    94: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction",
    95: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers",
    96: "may be used to endorse or promote products derived from this software without specific prior written permission",
    97: "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    98: "no express or implied licenses to any party s patent rights are granted by this license",
    100: "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution",
    101: "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at",
    102: "this program and the accompanying materials are made available under the terms of the common public license v1 0 which accompanies this distribution",
    103: "the contents of this file are subject to the terms of the common development and distribution license",
    104: "licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl",
    105: "licensed under the eupl version 1 1 or as soon they will be approved by the european commission subsequent versions of the eupl",
    106: "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed",
    107: "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control over the development of the package",
    108: "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    109: "this font software is licensed under the sil open font license version 1 1",
    110: "this license agreement is between the python software foundation psf and the individual or organization licensee accessing and otherwise using this software python in source or binary form and its associated documentation",
    111: "this product includes software developed by the openssl project for use in the openssl toolkit",
    112: "this product includes software developed by the apache software foundation",
    113: "this license governs use of the accompanying software if you use the software you accept this license",
    114: "microsoft public license ms pl",
    115: "microsoft reciprocal license ms rl",
    116: "you may make and give away verbatim copies of the source form of the software without restriction provided that you duplicate all of the original copyright notices and associated disclaimers",
    117: "redistributions of any form whatsoever must retain the following acknowledgment this product includes php software freely available from",
    118: "is made available under the open database license",
    119: "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3 or any later version published by the free software foundation",
    120: "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 2 or any later version published by the free software foundation",
    121: "the purpose of this license is to give everyone as much permission to work with this software as possible while protecting contributors from liability",
    122: "subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data collectively the software free of charge and under any and all copyright rights in the software",
    123: "you can use this software according to the terms and conditions of the mulan psl v2",
    124: "as long as you retain this notice you can do whatever you want with this stuff",
    125: "permission to copy and distribute verbatim copies of this license document is granted but changing it is not allowed",
}
#: Rules: a licence and the identifiers that must follow in this order (fixed values).
RULES: list[tuple[str, tuple[int, ...]]] = [
    ("0BSD", (70, 73)),
    ("Apache-1.1", (40, 41, 42, 112)),
    ("Apache-2.0", (1,)),
    ("Apache-2.0", (5, 2, 4)),
    ("Apache-2.0", (2, 3, 4)),
    ("Artistic-1.0", (107,)),
    ("Artistic-1.0", (116,)),
    ("Artistic-2.0", (106,)),
    ("BSD-2-Clause", (40, 41, 42)),
    ("BSD-3-Clause", (40, 41, 42, 43)),
    ("BSD-3-Clause", (40, 41, 42, 96)),
    ("BSD-3-Clause-Clear", (40, 41, 42, 43, 98)),
    ("BSD-3-Clause-Clear", (40, 41, 42, 96, 98)),
    ("BSD-4-Clause", (40, 41, 42, 97)),
    ("BSL-1.0", (83,)),
    ("BSL-1.0", (84,)),
    ("Beerware", (124,)),
    ("BlueOak-1.0.0", (121,)),
    ("CC-BY-4.0", (31,)),
    ("CC-BY-4.0", (33,)),
    ("CC-BY-NC-4.0", (30,)),
    ("CC-BY-SA-4.0", (32,)),
    ("CC0-1.0", (61,)),
    ("CC0-1.0", (62,)),
    ("CDDL-1.0", (103,)),
    ("CPL-1.0", (102,)),
    ("EPL-1.0", (100,)),
    ("EPL-2.0", (101,)),
    ("EUPL-1.1", (105,)),
    ("EUPL-1.2", (104,)),
    ("GFDL-1.2-or-later", (120,)),
    ("GFDL-1.3-or-later", (119,)),
    ("GPL-2.0-or-later", (23, 22)), ("GPL-2.0-or-later", (23,)),
    ("GPL-3.0-only", (20,)),
    ("GPL-3.0-or-later", (21, 22)), ("GPL-3.0-or-later", (21,)),
    ("ISC", (70,)),
    ("ISC", (71,)),
    ("ISC", (72,)),
    ("JSON", (90, 12, 93)),
    ("MIT", (10,)),
    ("MIT", (11, 12, 13)),
    ("MIT", (90, 12, 13)),
    ("MIT", (14,)),
    ("MIT-0", (90, 13)),
    ("MPL-1.1", (51,)),
    ("MPL-2.0", (50,)),
    ("MS-PL", (114, 113)),
    ("MS-RL", (115, 113)),
    ("MulanPSL-2.0", (123,)),
    ("NCSA", (94, 95)),
    ("NTP", (75,)),
    ("ODbL-1.0", (118,)),
    ("OFL-1.1", (109,)),
    ("OpenSSL", (40, 41, 42, 111)),
    ("PHP-3.01", (40, 41, 42, 117)),
    ("PSF-2.0", (110,)),
    ("PostgreSQL", (74,)),
    ("UPL-1.0", (122,)),
    ("Unlicense", (60,)),
    ("WTFPL", (108,)),
    ("X11", (90, 12, 13, 91)),
    ("Zlib", (80, 81, 82)),
    ("blessing", (63,)),
    ("curl", (72, 92)),
]
#: Pairs of a licence and one whose rule its text meets too: the second isn't reported beside the first (fixed values).
CONTAINS = [
    ("0BSD", "ISC"), ("Apache-1.1", "BSD-2-Clause"), ("Apache-1.1", "BSD-3-Clause"), ("BSD-3-Clause", "BSD-2-Clause"), ("BSD-3-Clause-Clear", "BSD-2-Clause"), ("BSD-3-Clause-Clear", "BSD-3-Clause"),
    ("BSD-4-Clause", "BSD-2-Clause"), ("BSD-4-Clause", "BSD-3-Clause"), ("JSON", "MIT"), ("JSON", "MIT-0"), ("MIT", "MIT-0"), ("OpenSSL", "BSD-2-Clause"), ("OpenSSL", "BSD-3-Clause"), ("PHP-3.01", "BSD-2-Clause"),
    ("PHP-3.01", "BSD-3-Clause"), ("X11", "MIT"), ("X11", "MIT-0"), ("curl", "ISC"),
]


def _families() -> None:
    """Sentences and rules that differ only in name and version: notices of GNU's and Creative Commons' licences, tags, read-me files."""
    number = 200
    names = {"GPL": "general public license", "LGPL": "lesser general public license", "AGPL": "affero general public license"}
    what = "free software you can redistribute it and or modify it under the terms of the gnu"
    for short, version in (("GPL", "1"), ("GPL", "2"), ("GPL", "3"), ("LGPL", "2.1"), ("LGPL", "3"), ("AGPL", "3")):
        spoken, full = version.replace(".", " "), version if "." in version else f"{version}.0"
        for subject in ("this program is", "this library is", "this file is"):
            for kind, text in (
                ("or-later", f"{names[short]} as published by the free software foundation either version {spoken} of the license or at your option any later version"),
                ("only", f"{names[short]} version {spoken} as published by the free software foundation"),
                ("only", f"{names[short]} as published by the free software foundation version {spoken} of the license"),
            ):
                sentence = f"{subject} {what} {text}"
                if sentence not in SENTENCES.values():
                    SENTENCES[number] = sentence
                    RULES.append((f"{short}-{full}-{kind}", (number,)))
                    number += 1
    for terms, short in (("attribution", "BY"), ("attribution sharealike", "BY-SA"), ("attribution noderivatives", "BY-ND"), ("attribution noncommercial", "BY-NC"), ("attribution noncommercial sharealike", "BY-NC-SA"), ("attribution noncommercial noderivatives", "BY-NC-ND")):
        for version, port in (("4 0", "international"), ("3 0", "unported")):
            sentence = f"this work is licensed under a creative commons {terms} {version} {port} license"
            if sentence not in SENTENCES.values():
                SENTENCES[number] = sentence
                RULES.append((f"CC-{short}-{version.replace(' ', '.')}", (number,)))
                number += 1
    # Tags of source files. The colon ends a sentence, over which a known one may go on.
    for name in sorted({n for n, _ in RULES}):
        SENTENCES[number] = f"spdx license identifier {' '.join(re.findall('[a-z0-9]+', name.lower()))}"
        RULES.append((name, (number,)))
        number += 1
    # What read-me files say.
    for spoken, name in (("mit", "MIT"), ("apache", "Apache-2.0"), ("apache 2 0", "Apache-2.0"), ("isc", "ISC"), ("bsd 3 clause", "BSD-3-Clause"), ("bsd 2 clause", "BSD-2-Clause"), ("mozilla public", "MPL-2.0")):
        for file in ("license", "license md", "license txt", "copying"):
            for ending in (f"see the {file} file for details", f"see the {file} file"):
                SENTENCES[number] = f"this project is licensed under the {spoken} license {ending}"
                RULES.append((name, (number,)))
                number += 1


_families()

#: Each known sentence has one of these in it; texts without them have no known sentence.
HINTS = ("licen", "permi", "softwar", "copyright", "copied", "redistribut", "warrant", "stuff", "public")
#: Known sentences of so many words count wherever they stand.
FREE = 10
#: Comment marks that are words: those of sign characters go with the other signs.
_WORD_COMMENT = r"(?im)^[ \t]*(?:rem|dnl)[ \t]+"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Catalogue:
    sentences: dict[int, str] = field(default_factory=lambda: SENTENCES)
    rules: list[tuple[str, tuple[int, ...]]] = field(default_factory=lambda: RULES)
    contains: list[tuple[str, str]] = field(default_factory=lambda: CONTAINS)
    hints: tuple[str, ...] = HINTS

    def all_hints(self) -> list[str]:
        """The hints, and the longest word of each sentence that has none of them: no known sentence is passed over."""
        more = {max(s.split(), key=lambda w: (len(w), w)) for s in self.sentences.values() if not any(h in s for h in self.hints)}
        return [*self.hints, *sorted(more)]


def marked(text: Column) -> Column:
    """The normalised text with " | " between sentences, at its start and at its end.

    Sentences are stretches between line ends, and after . ; : ! ? followed by white space.
    """
    plain = F.translate(F.regexp_replace(text, _WORD_COMMENT, ""), _CAPITALS + "|", _SMALL + ",")
    cut = F.regexp_replace(plain, r"[.;:!?][\x20\x09-\x0D]+|[\n\r]+", "|")
    spaced = F.regexp_replace(F.regexp_replace(cut, r"[^a-z0-9|]+", " "), r" ?\|[ |]*", " | ")
    return F.concat(F.lit("| "), F.trim(spaced), F.lit(" |"))


def _tree(sentences: list[str], ends: dict[str, str]) -> str:
    """A pattern for any of the sentences, the longest first. `ends` says what must follow each.

    Sentences with the same first words share them; an end of a text's sentence may stand between two words.
    """
    gap = r"(?: \|)? "

    def node(rest: list[tuple[list[str], str]]) -> str:
        words: dict[str, list[tuple[list[str], str]]] = {}
        stop = ""
        for left, end in rest:
            if left:
                words.setdefault(left[0], []).append((left[1:], end))
            else:
                stop = end
        branches = [w + (gap if any(left for left, _ in inner) and all(left for left, _ in inner) else "") + node(inner) for w, inner in sorted(words.items())]
        if stop and branches:
            return f"(?:{gap}(?:{'|'.join(branches)})|{stop})"
        return stop or (branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})")

    return node([(s.split(), ends[s]) for s in sentences])


def _pattern(catalogue: Catalogue) -> str:
    """Any known sentence in a marked text. Short ones count only between the ends of the text's sentences."""
    known = sorted(catalogue.sentences.values())
    free = [s for s in known if len(s.split()) >= FREE]
    ends = {s: "(?= )" if s in free else r"(?= \|)" for s in known}
    anywhere = f"|{_tree(free, ends)}" if free else ""
    return rf"(?<= )(?:(?<=\| ){_tree(known, ends)}{anywhere})"


def identifiers(text: Column, catalogue: Catalogue) -> Column:
    """Identifiers of the text's known sentences in their order."""
    known = F.create_map(*[x for i, s in catalogue.sentences.items() for x in (F.lit(s), F.lit(i))])
    found = F.regexp_extract_all(marked(text), F.lit(_pattern(catalogue)), F.lit(0))
    ids = F.transform(found, lambda s: F.try_element_at(known, F.regexp_replace(s, r" \|", "")))
    return F.when(text.rlike(f"(?i){'|'.join(map(re.escape, catalogue.all_hints()))}"), ids).otherwise(F.array().cast("array<int>"))


def licences(ids: Column, catalogue: Catalogue) -> Column:
    """Names of the licences whose rules the identifiers meet, in alphabetical order."""
    line = F.concat_ws("", F.transform(ids, lambda i: F.concat(F.lit(","), i.cast("string"), F.lit(","))))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("%" + "%".join(f",{i}," for i in rule) + "%").alias("rule")) for name, rule in catalogue.rules])
    met = F.array_sort(F.array_distinct(F.transform(F.filter(rules, lambda r: F.like(line, r["rule"])), lambda r: r["name"])))
    if not catalogue.contains:
        return met
    pairs = F.array(*[F.struct(F.lit(a).alias("outer"), F.lit(b).alias("inner")) for a, b in catalogue.contains])
    return F.filter(met, lambda n: ~F.exists(pairs, lambda p: (p["inner"] == n) & F.array_contains(met, p["outer"])))


def scanned(df: DataFrame, text_col: str = "text", catalogue: Catalogue = Catalogue(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, n_known (known sentences), sentence_ids and licences (joined by commas; empty if none).

    A null or empty text has no sentence. Rows keep a null doc_id; repeated rows each give a row; other columns are ignored.
    """
    ids = df.select(*keep, identifiers(F.coalesce(F.col(text_col), F.lit("")), catalogue).alias("_ids"))
    found = licences(F.col("_ids"), catalogue)
    return ids.select(*keep, F.size("_ids").cast("bigint").alias("n_known"), F.concat_ws(",", F.col("_ids").cast("array<string>")).alias("sentence_ids"), F.concat_ws(",", F.when(F.size("_ids") > 0, found)).alias("licences"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(common.table(spark, sf_dir, "documents"))


def _sql() -> str:
    known = ", ".join(f"({i}, '{s}')" for i, s in SENTENCES.items())
    names = sorted({n for n, _ in RULES})
    met = {n: " OR ".join(f"m LIKE '%{'%'.join(f',{i},' for i in rule)}%'" for name, rule in RULES if name == n) for n in names}
    inside = {n: "".join(f" AND NOT ({met[outer]})" for outer, inner in CONTAINS if inner == n) for n in names}
    found = ", ".join(f"CASE WHEN ({met[n]}){inside[n]} THEN '{n}' END" for n in names)
    return rf"""
WITH known(i, s) AS (VALUES {known}),
p AS (SELECT row_number() OVER () AS r, doc_id, string_split_regex(regexp_replace(coalesce(text, ''), '([.;:!?])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), '[\n\r]+') AS parts FROM documents),
u AS (SELECT r, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM p),
w AS (SELECT r, pos, trim(regexp_replace(translate(part, '{_CAPITALS}', '{_SMALL}'), '[^a-z0-9]+', ' ', 'g')) AS s FROM u),
f AS (SELECT r, count(*) AS n, string_agg(CAST(i AS VARCHAR), ',' ORDER BY pos) AS ids, string_agg(',' || i || ',', '' ORDER BY pos) AS m FROM w JOIN known USING (s) GROUP BY r)
SELECT p.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_known, coalesce(ids, '') AS sentence_ids, coalesce(concat_ws(',', {found}), '') AS licences
FROM p LEFT JOIN f USING (r)
"""


OP5_SQL = _sql()
