"""Licence scans: sentence-rule recognition.

Texts are cut into paragraphs at blank lines and into sentences at full stops, marks, colons and
semicolons. A sentence wrapped over several lines is looked up whole first; if it is not known, without
its first lines, which may be a heading; else each line for itself, as notices stand without a full
stop. Sentences are normalised (lower case, words and numbers only) and looked up among known licence
sentences. What is left of a text is the sequence of its sentence identifiers, with a gap wherever
other sentences stand between them. Ordered rules, longer and more specific ones first, are matched
against that sequence; a match uses its sentences up and leaves a gap, so that sentences on both its
sides don't become neighbours.

Rules come from three tables: whole licence texts and notices, of which all sentences in order are a
rule and each telling sentence one of its own; names of licences, put into the phrases that refer to a
licence by name; and SPDX identifiers.

Only DataFrame functions; one pass over the text, no shuffle. :func:`sql` says the same as relations.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

# Texts of public licences and notices. A sentence that alone tells the licence starts with "*".
TEXTS = {
    "MIT": """*Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT-0": """*Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "BSL-1.0": """*Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:""",
    "ISC": """*Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """*Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
*Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "BSD": """*Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty.
In no event will the authors be held liable for any damages arising from the use of this software.
*Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
The origin of this software must not be misrepresented;
you must not claim that you wrote the original software.""",
    "Apache-2.0": """*Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
*you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
See the GNU General Public License for more details.""",
    "GPL-2.0-or-later": """This program is free software;
*you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;""",
    "GPL": """*This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.""",
    "GPL-3.0": """*This work is licensed under the GNU General Public License version 3.""",
    "LGPL-2.1-or-later": """This library is free software;
*you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "AGPL-3.0-or-later": """*you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "MPL-2.0": """*This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
If a copy of the MPL was not distributed with this file, You can obtain one at""",
    "Unlicense": """*This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "WTFPL": """*You just DO WHAT THE FUCK YOU WANT TO.""",
    "EPL-2.0": """*This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at""",
    "CDDL-1.0": """*The contents of this file are subject to the terms of the Common Development and Distribution License (the "License").""",
    "PostgreSQL": """*Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.""",
    "CC-BY-4.0": """*This work is licensed under a Creative Commons Attribution 4.0 International License.""",
    "CC-BY-SA-4.0": """*This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.""",
    "CC-BY-NC-4.0": """*This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.""",
    "CC0-1.0": """*To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.""",
    "proprietary": """*All rights reserved.""",
}
# Names that texts call licences by.
NAMES = {
    "MIT": ("MIT License",), "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"), "ISC": ("ISC License",),
    "BSD": ("BSD License",), "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "GPL": ("GNU General Public License", "GPL"), "GPL-2.0": ("GNU General Public License version 2", "GPLv2"), "GPL-3.0": ("GNU General Public License version 3", "GPLv3"),
    "LGPL": ("GNU Lesser General Public License", "LGPL"), "LGPL-2.1": ("GNU Lesser General Public License version 2.1", "LGPLv2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License version 3", "LGPLv3"), "AGPL-3.0": ("GNU Affero General Public License version 3", "AGPLv3"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"), "EPL-1.0": ("Eclipse Public License 1.0",), "EPL-2.0": ("Eclipse Public License 2.0",),
    "BSL-1.0": ("Boost Software License 1.0", "Boost Software License, Version 1.0"), "Zlib": ("zlib License",), "Unlicense": ("Unlicense",),
    "Artistic-2.0": ("Artistic License 2.0",), "EUPL-1.2": ("European Union Public Licence 1.2", "EUPL 1.2"), "CDDL-1.0": ("Common Development and Distribution License",),
    "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"), "PSF-2.0": ("Python Software Foundation License",), "PostgreSQL": ("PostgreSQL License",),
    "WTFPL": ("WTFPL",), "MS-PL": ("Microsoft Public License",), "OSL-3.0": ("Open Software License 3.0",), "AFL-3.0": ("Academic Free License 3.0",), "NCSA": ("University of Illinois/NCSA Open Source License",),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0"), "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0"), "CC-BY-ND-4.0": ("CC BY-ND 4.0",), "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0",),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0",), "CC-BY-3.0": ("CC BY 3.0",), "CC-BY-SA-3.0": ("CC BY-SA 3.0",), "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    "ODbL-1.0": ("Open Database License 1.0", "ODbL 1.0"), "GFDL-1.3": ("GNU Free Documentation License 1.3",), "Ruby": ("Ruby License",), "OpenSSL": ("OpenSSL License",),
}
# Phrases around a name.
PHRASES = ("{}", "The {}", "Licensed under {}", "Licensed under the {}", "Released under the {}", "Distributed under the {}", "This work is licensed under the {}", "This work is licensed under {}", "This project is licensed under the {}", "Distributed under the terms of the {}")
# Identifiers of the SPDX list.
SPDX = (
    "MIT", "MIT-0", "Apache-2.0", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later",
    "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-1.0", "EPL-2.0",
    "BSL-1.0", "Zlib", "Unlicense", "Artistic-2.0", "EUPL-1.2", "CDDL-1.0", "OFL-1.1", "PSF-2.0", "PostgreSQL", "WTFPL", "MS-PL", "OSL-3.0", "AFL-3.0", "NCSA", "CC-BY-4.0", "CC-BY-SA-4.0",
    "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC0-1.0", "ODbL-1.0",
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line's end inside a paragraph and a sentence's end, as marks that texts hold none of any more.
_LINE, _STOP = "\x1e", "\x1f"
_PARAGRAPH, _END = r"\x0D?\x0A(?:[\x09\x0B-\x0D\x20]*\x0A)+", r"[.!?:]+(?=[\x09-\x0D\x20]|\z)|;"
#: Lines of a heading that may stand above a sentence without a blank line.
HEADING = 3
_GAP = "~"


def _plain(sentence: str) -> str:
    return " ".join(re.findall("[a-z0-9]+", sentence.translate(str.maketrans(_UPPER, _LOWER))))


def _cut(text: str) -> list[str]:
    """Sentences of a text of the tables, which has one or several a line."""
    return [s for line in text.split("\n") for s in map(_plain, re.split(r"[.!?:]+(?=\s|$)|;", line)) if s]


def _tables() -> tuple[dict[str, str], list[tuple[str, tuple[str, ...]]]]:
    """Known sentences with identifiers, and ordered rules (licence, identifiers in order)."""
    ids: dict[str, str] = {}
    whole, telling, named = [], [], []

    def name(sentence: str, base: str) -> str:
        # what says nothing by itself, an identifier or a number, is marked
        base = base if any(len(w) > 1 for w in sentence.split()) else f"={base}"
        return ids.setdefault(sentence, f"{base}.{sum(v.startswith(f'{base}.') for v in ids.values()) + 1}")

    for licence, text in TEXTS.items():
        rows = [(line.startswith("*"), [name(s, licence) for s in _cut(line.lstrip("*"))]) for line in text.split("\n")]
        whole.append((licence, tuple(i for _, line in rows for i in line)))
        telling += [(licence, tuple(line)) for tells, line in rows if tells]
    for licence, names in NAMES.items():
        # "." inside a name ends no sentence
        # a name alone is a notice if it says that it is one
        named += [(licence, (name(_plain(p.format(n)), licence),)) for n in names for p in PHRASES if len(p) > 6 or "icen" in n]
    for x in SPDX:
        # a colon ends a sentence, so the identifier stands behind one that is its own
        named.append((x, (name("spdx license identifier", "spdx"), name(_plain(x), f"={x}"))))
    whole = [w for w in whole if len(w[1]) > 1]
    rules = sorted(whole, key=lambda r: -len(r[1])) + sorted(telling, key=lambda r: -len(r[1])) + sorted(named, key=lambda r: -len(r[1]))
    return ids, list(dict.fromkeys(rules))


SENTENCES, RULES = _tables()


def _triggers() -> list[str]:
    """Words of which every known sentence holds one, but for bare identifiers and numbers, which stand
    behind one that does: the fewest found greedily among long words, which texts rarely hold by chance."""
    left, found = {s for s, i in SENTENCES.items() if not i.startswith("=")}, []
    while left:
        words = {w for s in left for w in s.split() if len(w) > 5} or {w for s in left for w in s.split() if len(w) > 1}
        best = "licen" if any("licen" in s for s in left) else max(sorted(words), key=lambda w: (sum(w in s for s in left), len(w)))
        found.append(best)
        left = {s for s in left if best not in s}
    return found


def _sequence(text: Column) -> Column:
    """``<id><id>~<id>``: identifiers of known sentences, gaps for runs of others."""
    known = F.create_map(*[F.lit(x) for s, i in SENTENCES.items() for x in (s, f"<{i}>")])
    clean = F.translate(text, _LINE + _STOP, "  ")
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(clean, _PARAGRAPH, _STOP), _END, _STOP), r"\x0A", _LINE)
    lower = F.regexp_replace(F.translate(marked, _UPPER, _LOWER), rf"[^a-z0-9{_LINE}{_STOP}]+", " ")
    sentences = F.split(lower, _STOP, -1)
    # numbers and letters of a list's items are no sentences
    item = "[0-9]+|[a-z]"
    look = lambda s: F.when(s.rlike(f"^(?:{item})?$"), F.lit("")).otherwise(F.coalesce(F.try_element_at(known, s), F.lit(_GAP)))

    def joined(lines: Column, start: int) -> Column:
        words = F.trim(F.regexp_replace(F.array_join(F.slice(lines, start + 1, F.greatest(F.size(lines) - start, F.lit(0))), " "), " +", " "))
        return F.try_element_at(known, F.regexp_replace(words, rf"^(?:{item}) ", ""))

    each = lambda lines: F.array_join(F.transform(lines, look), "")

    def sentence(s: Column) -> Column:
        lines = F.filter(F.transform(F.split(s, _LINE, -1), lambda x: F.trim(x)), lambda x: x != "")
        found = joined(lines, 0)
        for k in range(1, HEADING + 1):
            found = F.coalesce(found, F.concat(each(F.slice(lines, 1, k)), joined(lines, k)))
        return F.when(F.size(lines) == 0, F.lit("")).otherwise(F.coalesce(found, each(lines)))

    return F.regexp_replace(F.array_join(F.transform(sentences, sentence), ""), f"{_GAP}+", _GAP)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``sentence_ids`` (the sequence), ``licences`` (in order of the rules, joined by commas,
    each licence once) and ``n_rules`` (long, how many rules were found) to every row.

    Null and empty texts, and texts without a known sentence (an identifier or number by itself is
    none), get empty strings and 0. Repeated rows
    get equal results; the three added names replace columns of the same names, other columns pass
    through, whatever their names. No rows in, no rows out.
    """
    kept = [c for c in docs.columns if c not in ("sentence_ids", "licences", "n_rules")]
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    lower = F.translate(F.col("t"), _UPPER, _LOWER)
    maybe = F.lit(False)
    for w in _triggers():
        maybe = maybe | F.contains(lower, F.lit(w))
    found = found.select("row", F.when(maybe, _sequence(F.col("t"))).otherwise(F.lit("")).alias("seq"))
    found = found.select("row", F.when(F.col("seq").rlike("<[^=]"), F.col("seq")).otherwise(F.lit("")).alias("seq"))
    rules = F.array(*[F.struct(F.lit(n).alias("n"), F.lit("".join(f"<{i}>" for i in ids)).alias("p")) for n, ids in RULES])
    start = F.struct(F.col("seq").alias("s"), F.array().cast("array<string>").alias("f"))
    walk = F.aggregate(
        rules,
        start,
        lambda a, r: F.when(
            F.contains(a["s"], r["p"]), F.struct(F.replace(a["s"], r["p"], F.lit(_GAP)).alias("s"), F.concat(a["f"], F.array(r["n"])).alias("f"))
        ).otherwise(a),
    )["f"]
    found = found.select("row", "seq", F.when(F.col("seq") != "", walk).otherwise(F.array().cast("array<string>")).alias("hits"))
    return found.select(
        *[F.col(f"row.`{c}`") for c in kept],
        F.col("seq").alias("sentence_ids"),
        F.array_join(F.array_distinct("hits"), ",").alias("licences"),
        F.size("hits").cast("long").alias("n_rules"),
    )


def sql() -> str:
    """The query as DuckDB SQL over relations: sentences and lines are rows, looked up by joins, and the
    sequence is put together again; the rules are walked by a recursion over their number."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quote(s)}, {quote(f'<{i}>')})" for s, i in SENTENCES.items())
    rules = ", ".join(f"({n}, {quote(name)}, {quote(''.join(f'<{i}>' for i in ids))})" for n, (name, ids) in enumerate(RULES, 1))
    return rf"""WITH RECURSIVE known(s, id) AS (VALUES {known}), rules(n, licence, p) AS (VALUES {rules}),
para AS (SELECT doc_id, unnest(string_split(regexp_replace(translate(coalesce(text, ''), chr(30) || chr(31), '  '), '\r?\n([\t\x0B-\r ]*\n)+', chr(31), 'g'), chr(31))) AS p,
  generate_subscripts(string_split(regexp_replace(translate(coalesce(text, ''), chr(30) || chr(31), '  '), '\r?\n([\t\x0B-\r ]*\n)+', chr(31), 'g'), chr(31)), 1) AS pn FROM documents),
sent AS (SELECT doc_id, pn, generate_subscripts(x, 1) AS sn, unnest(x) AS s FROM (SELECT doc_id, pn, string_split(regexp_replace(regexp_replace(p, '[.!?:]+([\t-\r ])', chr(31) || '\1', 'g'), '[.!?:]+$|;', chr(31), 'g'), chr(31)) AS x FROM para)),
cut AS (SELECT doc_id, pn, sn, list_filter(list_transform(string_split(s, chr(10)), lambda l: trim(regexp_replace(lower(regexp_replace(l, '[^A-Za-z0-9]+', ' ', 'g')), ' +', ' ', 'g'))), lambda l: l <> '') AS lines FROM sent),
tried AS (SELECT doc_id, pn, sn, lines, k, regexp_replace(array_to_string(lines[k + 1:], ' '), '^([0-9]+|[a-z]) ', '') AS words FROM cut, range({HEADING + 1}) AS t(k) WHERE len(lines) > k),
hit AS (SELECT doc_id, pn, sn, min(k) AS k, arg_min(id, k) AS id FROM tried JOIN known ON known.s = tried.words GROUP BY ALL),
line AS (SELECT doc_id, pn, sn, unnest(lines) AS l, generate_subscripts(lines, 1) AS ln FROM cut),
part AS (SELECT doc_id, pn, sn, ln, CASE WHEN regexp_full_match(l, '[0-9]+|[a-z]') THEN '' ELSE coalesce(known.id, '{_GAP}') END AS id FROM line LEFT JOIN hit USING (doc_id, pn, sn) LEFT JOIN known ON known.s = l
  WHERE hit.k IS NULL OR ln <= hit.k UNION ALL SELECT doc_id, pn, sn, k + 1, id FROM hit),
seqs AS (SELECT doc_id, regexp_replace(string_agg(id, '' ORDER BY pn, sn, ln), '{_GAP}+', '{_GAP}', 'g') AS seq FROM part GROUP BY doc_id),
walk(doc_id, n, s, f) AS (SELECT doc_id, 0, seq, CAST([] AS VARCHAR[]) FROM seqs WHERE regexp_matches(seq, '<[^=]')
  UNION ALL SELECT doc_id, r.n, CASE WHEN contains(s, p) THEN replace(s, p, '{_GAP}') ELSE s END, CASE WHEN contains(s, p) THEN list_append(f, licence) ELSE f END
  FROM walk w JOIN rules r ON r.n = w.n + 1),
ends AS (SELECT doc_id, f FROM walk WHERE n = {len(RULES)})
SELECT doc_id, CASE WHEN regexp_matches(seq, '<[^=]') THEN seq ELSE '' END AS sentence_ids,
  coalesce(array_to_string(list_filter(f, lambda x, i: list_position(f, x) = i), ','), '') AS licences, CAST(coalesce(len(f), 0) AS BIGINT) AS n_rules
FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN seqs USING (doc_id) LEFT JOIN ends USING (doc_id)"""


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
