"""Licence scans by sentence rules.

DataFrame operations only. A text is cut into sentences; a normalised sentence
that is a known licence sentence becomes its identifier, any other disappears. Licences are ordered
rules over the sequence of identifiers: all sentences of a rule, in this order, with anything between them.
A full stop always ends a sentence. A line break, a colon and a semicolon may end one or stand inside one
("SPDX-License-Identifier: MIT", "free software: you can", wrapped lines); a known sentence is found both ways.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

# Known licence sentences, lower case, only letters and digits, by identifier.
SENTENCES = {
    "apache-short": "licensed under the apache license version 2 0",
    "apache-you": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-spdx": "spdx license identifier apache 2 0",
    "mit-short": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-title": "the mit license",
    "mit-title-bare": "mit license",
    "mit-spdx": "spdx license identifier mit",
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
        "permit persons to whom the software is furnished to do so subject to the following conditions"
    ),
    "mit-notice": (
        "the above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the software"
    ),
    "as-is": (
        "the software is provided as is without warranty of any kind express or implied including but not limited to "
        "the warranties of merchantability fitness for a particular purpose and noninfringement"
    ),
    "gpl3-short": "this work is licensed under the gnu general public license version 3",
    "gpl3-licensed": "licensed under the gnu general public license version 3",
    "gpl3-title": "gnu general public license version 3",
    "gpl3-spdx": "spdx license identifier gpl 3 0 only",
    "gpl3-later-spdx": "spdx license identifier gpl 3 0 or later",
    "gpl-free": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation either version 3 of the license or at your "
        "option any later version"
    ),
    "gpl-hope": (
        "this program is distributed in the hope that it will be useful but without any warranty without even the "
        "implied warranty of merchantability or fitness for a particular purpose"
    ),
    "gpl-details": "see the gnu general public license for more details",
    "gpl2-free": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation either version 2 of the license or at your "
        "option any later version"
    ),
    "gpl2-spdx": "spdx license identifier gpl 2 0 only",
    "gpl2-later-spdx": "spdx license identifier gpl 2 0 or later",
    "lgpl-free": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
        "public license as published by the free software foundation either version 2 1 of the license or at your "
        "option any later version"
    ),
    "lgpl-hope": (
        "this library is distributed in the hope that it will be useful but without any warranty without even the "
        "implied warranty of merchantability or fitness for a particular purpose"
    ),
    "lgpl-details": "see the gnu lesser general public license for more details",
    "lgpl-later-spdx": "spdx license identifier lgpl 2 1 or later",
    "cc0-extent": (
        "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights "
        "to this software to the public domain worldwide"
    ),
    "cc0-waived": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "cc0-spdx": "spdx license identifier cc0 1 0",
    "cc-by-nc-short": "licensed under cc by nc 4 0",
    "cc-by-nc-spdx": "spdx license identifier cc by nc 4 0",
    "cc-by-nc-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-short": "licensed under cc by 4 0",
    "cc-by-spdx": "spdx license identifier cc by 4 0",
    "cc-by-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-short": "licensed under cc by sa 4 0",
    "cc-by-sa-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "bsd-grant": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met"
    ),
    "bsd-source": (
        "redistributions of source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer"
    ),
    "bsd-binary": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
        "following disclaimer in the documentation and or other materials provided with the distribution"
    ),
    "bsd-names": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission"
    ),
    "mpl2-form": (
        "this source code form is subject to the terms of the mozilla public license v 2 0"
    ),
    "all-rights": "all rights reserved",
}

# Ordered rules: licence, class, sentences that must follow one another.
RULES = (
    ("Apache-2.0", "permissive", ("apache-short",)),
    ("Apache-2.0", "permissive", ("apache-you", "apache-comply")),
    ("Apache-2.0", "permissive", ("apache-comply", "apache-copy")),
    ("Apache-2.0", "permissive", ("apache-spdx",)),
    ("MIT", "permissive", ("mit-short",)),
    ("MIT", "permissive", ("mit-licensed",)),
    ("MIT", "permissive", ("mit-spdx",)),
    ("MIT", "permissive", ("mit-grant", "mit-notice", "as-is")),
    ("GPL-3.0", "copyleft", ("gpl3-short",)),
    ("GPL-3.0", "copyleft", ("gpl3-licensed",)),
    ("GPL-3.0", "copyleft", ("gpl3-spdx",)),
    ("GPL-3.0-or-later", "copyleft", ("gpl3-later-spdx",)),
    ("GPL-3.0-or-later", "copyleft", ("gpl-free", "gpl-hope", "gpl-details")),
    ("GPL-2.0", "copyleft", ("gpl2-spdx",)),
    ("GPL-2.0-or-later", "copyleft", ("gpl2-later-spdx",)),
    ("GPL-2.0-or-later", "copyleft", ("gpl2-free", "gpl-hope", "gpl-details")),
    ("LGPL-2.1-or-later", "copyleft", ("lgpl-later-spdx",)),
    ("LGPL-2.1-or-later", "copyleft", ("lgpl-free", "lgpl-hope", "lgpl-details")),
    ("CC0-1.0", "permissive", ("cc0-spdx",)),
    ("CC0-1.0", "permissive", ("cc0-extent",)),
    ("CC0-1.0", "permissive", ("cc0-waived",)),
    ("CC-BY-NC-4.0", "noncommercial", ("cc-by-nc-short",)),
    ("CC-BY-NC-4.0", "noncommercial", ("cc-by-nc-spdx",)),
    ("CC-BY-NC-4.0", "noncommercial", ("cc-by-nc-work",)),
    ("CC-BY-4.0", "permissive", ("cc-by-short",)),
    ("CC-BY-4.0", "permissive", ("cc-by-spdx",)),
    ("CC-BY-4.0", "permissive", ("cc-by-work",)),
    ("CC-BY-SA-4.0", "copyleft", ("cc-by-sa-short",)),
    ("CC-BY-SA-4.0", "copyleft", ("cc-by-sa-work",)),
    ("BSD-3-Clause", "permissive", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", "permissive", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MPL-2.0", "copyleft", ("mpl2-form",)),
    ("proprietary", "restricted", ("all-rights",)),
)
#: A rule of the first licence makes the second superfluous: its sentences contain the other's.
STRONGER = {"BSD-3-Clause": "BSD-2-Clause"}

#: Every known sentence holds one of these words, so a text without them has no licence.
TRIGGERS = "licen|permission|warrant|redistribut|rights[^a-z0-9]+reserved|merchantab|neither the name|copyright"
#: Known sentences in a marked text, between any two marks. Of sentences with the same start the shorter one is tried
#: first: it holds only if a mark follows it.
_KNOWN = "(?<=[|/])(?:" + "|".join(s.replace(" ", "[\\x20/]") for s in sorted(SENTENCES.values(), key=len)) + ")(?=[|/])"


def _marked(text: Column) -> Column:
    """Words of letters and digits with one mark between them: | ends a sentence, / may end one, a blank does not."""
    # the v. of a version ends nothing
    plain = F.regexp_replace(F.translate(F.lower(text), "|/", "__"), r"(?<![a-z0-9])v\.(?=[\x20\t\r\n][^a-z0-9.!?:;]*+[0-9])", "v")
    loose = F.regexp_replace(plain, r"(?<![.!?:;])[:;]++(?=[\x20\t\r\n]|$)|[\r\n]++", "/")
    ended = F.regexp_replace(loose, r"(?<![.!?:;])[.!?:;]++(?=[\x20\t/]|$)", "|")
    words = F.concat(F.lit("|"), F.regexp_replace(ended, "[^a-z0-9|/]++", " "), F.lit("|"))
    one_end = F.regexp_replace(words, r"(?<![\x20/|])[\x20/]*+\|[\x20/|]*+", "|")
    return F.regexp_replace(one_end, r"(?<![\x20/])\x20*+/[\x20/]*+", "/")


def _identifiers(text: Column) -> Column:
    """Identifiers of known sentences in order."""
    by_text = F.create_map(*[F.lit(x) for name, sentence in SENTENCES.items() for x in (sentence, name)])
    found = F.regexp_extract_all(_marked(text), F.lit(_KNOWN), F.lit(0))
    return F.transform(found, lambda s: F.try_element_at(by_text, F.translate(s, "/", " ")))


def _rule_pattern(sentences: tuple[str, ...]) -> str:
    """Matches a sequence written as >a>b>c> that holds the rule's sentences in order."""
    return ">" + ">(?:[^>]+>)*".join(sentences) + ">"


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``license_sentences`` and ``licenses`` (sorted, distinct) and ``license_class``.

    ``license_class`` is the strictest class found: restricted, noncommercial,
    copyleft, permissive, or none. A reservation of all rights makes a text restricted only if no other licence is found. NULL, empty and other texts without a known
    sentence have empty arrays. Whole texts are read; repeated sentences count
    as often as they stand. All columns and rows stay; an added column replaces
    one of the same name.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = F.when(body.rlike(f"(?i){TRIGGERS}"), _identifiers(body)).otherwise(F.array().cast("array<string>"))
    out = docs.withColumn("license_sentences", found)
    sequence = F.concat(F.lit(">"), F.array_join("license_sentences", ">"), F.lit(">"))
    names = {}
    for name, _, sentences in RULES:
        holds = sequence.rlike(_rule_pattern(sentences))
        names[name] = names[name] | holds if name in names else holds
    some = F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in names.items()]))
    for strong, weak in STRONGER.items():
        some = F.when(names[strong], F.array_remove(some, weak)).otherwise(some)
    # "all rights reserved" stands in the notices of open licences too: it says something only where it stands alone
    for name in dict.fromkeys(n for n, kind, _ in RULES if kind == "restricted"):
        some = F.when(F.size(some) > 1, F.array_remove(some, name)).otherwise(some)
    out = out.withColumn("licenses", F.when(F.size("license_sentences") > 0, F.array_sort(some)).otherwise(F.array().cast("array<string>")))
    held = {c: [n for n, k, _ in RULES if k == c] for c in ("restricted", "noncommercial", "copyleft", "permissive")}
    strictest = F.lit("none")
    for kind in ("permissive", "copyleft", "noncommercial", "restricted"):
        any_of = F.arrays_overlap("licenses", F.array(*[F.lit(n) for n in dict.fromkeys(held[kind])]))
        strictest = F.when(any_of, kind).otherwise(strictest)
    return out.withColumn("license_class", strictest)


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    """Licence sentences, licences and class of all of ``documents``."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("license_sentences").cast("long").alias("n_sentences"),
        F.array_join("license_sentences", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
        "license_class",
    )


def _op4_sql(source: str = "documents") -> str:
    """The same rules over lists: a hard end cuts a text into units, a soft one a unit into parts; a known sentence is a run of parts."""
    known = ", ".join(f"('{sentence}', '{name}')" for name, sentence in SENTENCES.items())
    rules = ", ".join(f"('{n}', '{c}', '{_rule_pattern(s)}')" for n, c, s in RULES)
    swap = lambda text, pattern, by: f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    # without look-arounds a match takes its neighbours along, so each replacement is made twice
    twice = lambda text, pattern, by: swap(swap(text, pattern, by), pattern, by)
    plain = twice("lower(translate(text, '|/', '__'))", r"(^|[^a-z0-9])v\.([\x20\t\r\n][^a-z0-9.!?:;]*[0-9])", r"\1v\2")
    soft = swap(twice(plain, r"(^|[^.!?:;])[:;]+([\x20\t\r\n]|$)", r"\1/\2"), r"[\r\n]+", "/")
    hard = twice(soft, r"(^|[^.!?:;])[.!?:;]+([\x20\t/]|$)", r"\1|\2")
    stronger = " OR ".join(
        f"(license = '{weak}' AND EXISTS (SELECT 1 FROM held o WHERE o.doc = h.doc AND o.license = '{strong}'))" for strong, weak in STRONGER.items()
    )
    return f"""
WITH RECURSIVE known(s, id) AS (VALUES {known}), rule(license, class, pattern) AS (VALUES {rules}),
doc_ AS (SELECT row_number() OVER () AS doc, doc_id, text FROM {source}),
unit AS (
  SELECT doc, u, list_filter(list_transform(string_split(units[u], '/'), lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS parts
  FROM (SELECT doc, units, unnest(range(1, len(units) + 1)) AS u FROM (SELECT doc, string_split({hard}, '|') AS units FROM doc_ WHERE text IS NOT NULL))
), start_ AS (SELECT doc, u, parts, unnest(range(1, len(parts) + 1)) AS i FROM unit),
run AS (
  SELECT doc, u, i, unnest(range(i, least(len(parts), i + {max(len(x.split()) for x in SENTENCES.values())}) + 1)) AS j, parts FROM start_
  WHERE EXISTS (SELECT 1 FROM known WHERE starts_with(s, parts[i]))
), hit AS (
  SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY u, i) AS n, u, i, j, id FROM (
    SELECT doc, u, i, j, id FROM run JOIN known ON s = array_to_string(parts[i:j], ' ')
    QUALIFY row_number() OVER (PARTITION BY doc, u, i ORDER BY j) = 1)
), taken AS (
  SELECT doc, n, u, j, id FROM hit WHERE n = 1
  UNION ALL SELECT hit.doc, hit.n, hit.u, hit.j, hit.id FROM taken JOIN hit ON hit.doc = taken.doc
    AND hit.n = (SELECT min(h.n) FROM hit h WHERE h.doc = taken.doc AND (h.u, h.i) > (taken.u, taken.j))
), found AS (SELECT doc, count(*) AS n, string_agg(id, ',' ORDER BY n) AS ids FROM taken GROUP BY doc),
held AS (
  SELECT DISTINCT doc, license, class FROM found, rule WHERE regexp_matches('>' || replace(ids, ',', '>') || '>', pattern)
), kept AS (
  SELECT * FROM held h WHERE NOT ({stronger})
    AND NOT (class = 'restricted' AND EXISTS (SELECT 1 FROM held o WHERE o.doc = h.doc AND o.class <> 'restricted'))
), per AS (
  SELECT doc, string_agg(license, ',' ORDER BY license) AS licenses,
    CASE WHEN bool_or(class = 'restricted') THEN 'restricted' WHEN bool_or(class = 'noncommercial') THEN 'noncommercial'
         WHEN bool_or(class = 'copyleft') THEN 'copyleft' ELSE 'permissive' END AS class
  FROM kept GROUP BY doc
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses,
       coalesce(class, 'none') AS license_class
FROM doc_ LEFT JOIN found USING (doc) LEFT JOIN per USING (doc)"""


OP4_SQL = _op4_sql()
