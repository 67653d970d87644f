"""Licence recognition by sentence rules, in DataFrame functions only.

A text is cut into atoms at line ends and after sentence punctuation, and each atom is normalised to lower-case words.
Known licence sentences, normalised alike, have identifiers; a sentence may span several atoms, so from each atom that
is the start of a known sentence, as many atoms are joined as the longest known sentence has words, and the longest known
sentence that begins them and ends where an atom ends is taken: lines may be wrapped at any width.

The identifiers in order of position are then matched against ordered rules. A rule is a licence and the sequence of
identifiers that it needs, one right after another, with any unknown text between. Rules of more identifiers come first,
and the identifiers of a match are consumed: from the left, each position takes the first rule that fits there. Everything
stays in the row: no shuffle, and nothing to skew.

Null and empty texts have no sentence and no licence; very long ones are matched whole. Repeated rows give equal rows; an
empty table gives an empty one. Columns other than those asked for pass through, except those named like the output,
which it replaces.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and notices.
SPDX = (
    "Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "EPL-2.0", "Zlib", "BSL-1.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later",
)
SENTENCES = {
    "apache2-short": "Licensed under the Apache License, Version 2.0.",
    "apache2-head": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache2-use": "you may not use this file except in compliance with the License.",
    "apache2-copy": "You may obtain a copy of the License at",
    "apache2-asis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache2-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-short": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-asis": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl2-head": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl2-copy": "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301, USA.",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "epl2-head": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "zlib-asis": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-head": "Distributed under the Boost Software License, Version 1.0.",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "apache2-under": "Licensed under the Apache License 2.0.",
    "bsd3-short": "Licensed under the 3-Clause BSD License.",
    "bsd2-short": "Licensed under the 2-Clause BSD License.",
    **{f"spdx-{k.lower()}": f"SPDX-License-Identifier: {k}" for k in SPDX},
}
RULES = [
    ("Apache-2.0", ["apache2-short"]), ("Apache-2.0", ["apache2-head", "apache2-use", "apache2-copy"]), ("Apache-2.0", ["apache2-head", "apache2-use", "apache2-copy", "apache2-asis", "apache2-see"]),
    ("MIT", ["mit-short"]), ("MIT", ["mit-licensed"]), ("MIT", ["mit-grant", "mit-notice"]), ("MIT", ["mit-grant", "mit-notice", "mit-asis"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]), ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("GPL-3.0", ["gpl3-short"]), ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-copy"]), ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("ISC", ["isc-grant"]), ("MPL-2.0", ["mpl2-head"]), ("CC-BY-NC-4.0", ["cc-by-nc-4"]), ("CC-BY-4.0", ["cc-by-4"]), ("CC-BY-SA-4.0", ["cc-by-sa-4"]), ("CC0-1.0", ["cc0"]), ("Unlicense", ["unlicense"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl2-copy"]), ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope"]), ("GPL-2.0-or-later", ["gpl2-free"]), ("GPL-2.0-only", ["gpl2-only"]),
    ("LGPL-2.1-or-later", ["lgpl21-free"]), ("LGPL-3.0-or-later", ["lgpl3-free"]), ("AGPL-3.0-or-later", ["agpl3-free", "gpl-hope"]), ("AGPL-3.0-or-later", ["agpl3-free"]),
    ("EPL-2.0", ["epl2-head"]), ("Zlib", ["zlib-asis", "zlib-grant"]), ("BSL-1.0", ["boost-head"]), ("MPL-2.0", ["mpl2-head", "mpl2-copy"]),
    ("Apache-2.0", ["apache2-under"]), ("BSD-3-Clause", ["bsd3-short"]), ("BSD-2-Clause", ["bsd2-short"]),
    *[(k, [f"spdx-{k.lower()}"]) for k in SPDX],
]


def ordered(rules: list[tuple[str, list[str]]]) -> list[tuple[str, list[str]]]:
    """The rules as they are tried: those of more identifiers first, else in their own order."""
    return sorted(rules, key=lambda r: -len(r[1]))


def _mark(ids: list[str]) -> str:
    return "".join(f"<{k}>" for k in ids)


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))).strip()


def _starts(sentences: dict[str, str]) -> str:
    """A pattern that each normalised sentence, or its first atom, begins with: the first word."""
    return "^(" + "|".join(sorted({normalised(s).split()[0] for s in sentences.values()})) + ")( |$)"


#: Every known sentence has one of these, so texts without any are not cut up.
_HINT = "licen[sc]e|copyright|permission|permitted|redistribut|public domain|warrant|cc by|written|mozilla"


def atoms(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    lines = F.split(F.regexp_replace(low, "([.!?;:])[ \\t\\r]", "$1\n"), "\n")
    clean = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "[^a-z0-9]+", " ")))
    return F.filter(clean, lambda x: x != "")


def recognise(docs: DataFrame, text: str = "text", sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) with ``sentences`` (array of identifiers) and ``licenses`` (sorted)."""
    sentences, rules = sentences or SENTENCES, rules or RULES
    keep = [c for c in (docs.columns if carry is None else carry) if c.lower() not in ("sentences", "licenses")]
    known = {normalised(s): k for k, s in sentences.items()}
    covered = all(re.search(_HINT, re.sub("[^a-z0-9]+", " ", s.lower())) for s in sentences.values())
    longest = max(len(s.split()) for s in known)
    # literals, longest first: the first that fits is the longest
    table = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(k).alias("id")) for s, k in sorted(known.items(), key=lambda x: -len(x[0]))])
    hint = F.translate(docs[text], string.ascii_uppercase, string.ascii_lowercase)
    wanted = F.regexp_replace(hint, "[^a-z0-9]+", " ").rlike(_HINT) if covered else F.lit(True)
    none = F.array().cast("array<string>")
    cut = docs.select(*[docs[c] for c in keep], F.when(wanted, atoms(docs[text])).otherwise(none).alias("sentences"))
    a = F.col("sentences")

    def at(i: Column) -> Column:
        """The identifier of the longest known sentence that starts at atom i."""
        begun = F.exists(table, lambda k: F.startswith(F.concat(k.s, F.lit(" ")), F.concat(F.get(a, i), F.lit(" "))))
        # an array of one, so that the joined atoms are made once
        joined = F.array(F.concat(F.array_join(F.slice(a, i + 1, longest), "\n"), F.lit("\n")))
        fits = lambda x, k: F.startswith(F.translate(x, "\n", " "), k.s) & (F.substr(x, F.length(k.s) + 1, F.lit(1)) == "\n")
        found = F.transform(joined, lambda x: F.get(F.filter(table, lambda k: fits(x, k)), F.lit(0)).id)
        return F.when(F.get(a, i).rlike(_starts(sentences)) & begun, F.get(found, F.lit(0)))

    indexes = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))
    found = cut.withColumn("sentences", F.filter(F.transform(indexes, at), lambda x: x.isNotNull()))
    line = F.array_join(F.transform("sentences", lambda k: F.concat(F.lit("<"), k, F.lit(">"))), "")
    tried = ordered(rules)
    if len({_mark(ids) for _, ids in tried}) < len(tried):
        raise ValueError("two rules need the same sentences")
    names = F.create_map(*[F.lit(x) for name, ids in tried for x in (_mark(ids), name)])
    hits = F.regexp_extract_all(line, F.lit("|".join(re.escape(_mark(ids)) for _, ids in tried)), F.lit(0))
    return found.withColumn("licenses", F.array_sort(F.array_distinct(F.transform(hits, lambda h: names[h]))))


def oracle_sql() -> str:
    """The same recognition in DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = sorted(((normalised(s), k) for k, s in SENTENCES.items()), key=lambda x: -len(x[0]))
    longest = max(len(s.split()) for s, _ in known)
    table = "[" + ", ".join(f"{{'s': {quote(s)}, 'id': {quote(k)}}}" for s, k in known) + "]"
    tried = ordered(RULES)
    names = "map {" + ", ".join(f"{quote(_mark(ids))}: {quote(name)}" for name, ids in tried) + "}"
    pattern = "|".join(re.escape(_mark(ids)) for _, ids in tried)
    return rf"""
with cut as (
  select doc_id, list_filter(list_transform(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '([.!?;:])[ \t\r]', '\1' || chr(10), 'g'), chr(10)),
    lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') as a
  from documents),
begun as (
  select doc_id, i, array_to_string(a[i : i + {longest - 1}], chr(10)) || chr(10) as joined
  from (select doc_id, a, unnest(range(1, len(a) + 1)) as i from cut) where regexp_matches(a[i], {quote(_starts(SENTENCES))})),
placed as (select doc_id, i, list_filter({table}, lambda k: starts_with(replace(joined, chr(10), ' '), k.s) and substr(joined, len(k.s) + 1, 1) = chr(10))[1].id as id from begun),
found as (select doc_id, list(id order by i) as ids from placed where id is not null group by doc_id),
joined as (select c.doc_id, coalesce(ids, []) as ids from cut c left join found using (doc_id))
select doc_id, len(ids) as n_sentences, array_to_string(ids, ',') as sentences,
  array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(array_to_string(list_transform(ids, lambda k: '<' || k || '>'), ''), {quote(pattern)}), lambda h: {names}[h]))), ',') as licenses
from joined
"""
