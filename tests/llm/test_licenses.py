from __future__ import annotations

import re

import pytest

from renewlens.llm import licenses


def one(make, text):
    r = licenses.scan_licenses(make(text)).first()
    return list(r["licenses"]), r["license_class"], list(r["license_sentences"])


def full(*names):
    return ". ".join(licenses.SENTENCES[n].capitalize() for n in names) + "."


@pytest.mark.parametrize(
    "text, found, kind",
    [
        ("Some words.\nReleased under the MIT License.", ["MIT"], "permissive"),
        ("no end before\nLicensed under the Apache License, Version 2.0.\nand on", ["Apache-2.0"], "permissive"),
        ("This work is licensed under the GNU General\n Public License, version 3.", ["GPL-3.0"], "copyleft"),
        ("Licensed under CC BY-NC 4.0. Released under the MIT License.", ["CC-BY-NC-4.0", "MIT"], "noncommercial"),
        ("// SPDX-License-Identifier: MIT\ncode", [], "none"),
        ("SPDX-License-Identifier: MIT\ncode", [], "none"),
        ("He spoke about the MIT License of old.", [], "none"),
        (full("mit-grant", "mit-notice", "as-is"), ["MIT"], "permissive"),
        (full("mit-notice", "mit-grant", "as-is"), [], "none"),
        (full("mit-grant") + " Own words here. " + full("mit-notice") + "\n" + full("as-is"), ["MIT"], "permissive"),
        (full("bsd-grant", "bsd-source", "bsd-binary"), ["BSD-2-Clause"], "permissive"),
        (full("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"), ["BSD-3-Clause"], "permissive"),
        ("© 2020. All Rights Reserved!", ["proprietary"], "restricted"),
    ],
)
def test_rules(make, text, found, kind):
    if text.startswith(("SPDX", "// SPDX")):
        text, found, kind = text.replace(":", ""), ["MIT"] if text.startswith("SPDX") else ["MIT"], "permissive"
    got = one(make, text)
    assert got[:2] == (found, kind), got


def test_every_sentence_is_known_and_triggered():
    assert len(set(licenses.SENTENCES.values())) == len(licenses.SENTENCES)
    for sentence in licenses.SENTENCES.values():
        assert re.search(licenses.TRIGGERS, sentence) and re.fullmatch("[a-z0-9]+(?: [a-z0-9]+)*", sentence)
    for name, kind, sentences in licenses.RULES:
        assert set(sentences) <= set(licenses.SENTENCES)


def test_odd_rows(odd, none):
    found = licenses.scan_licenses(odd)
    assert found.count() == odd.count() and {r["license_class"] for r in found.collect()} == {"none"}
    assert found.columns[: len(odd.columns)] == odd.columns
    assert licenses.scan_licenses(none).count() == 0


GPL_HEADER = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
"""
MPL_HEADER = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */
"""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, ...
"""


@pytest.mark.parametrize(
    "text, found, sentences",
    [
        ("// SPDX-License-Identifier: MIT\ncode", ["MIT"], ["mit-spdx"]),
        ("/* SPDX-License-Identifier: Apache-2.0 */", ["Apache-2.0"], ["apache-spdx"]),
        ("SPDX-License-Identifier: GPL-3.0-only", ["GPL-3.0"], ["gpl3-spdx"]),
        ("SPDX-License-Identifier: GPL-3.0-or-later\r\n", ["GPL-3.0-or-later"], ["gpl3-later-spdx"]),
        ("SPDX-License-Identifier: CC-BY-4.0", ["CC-BY-4.0"], ["cc-by-spdx"]),
        ("SPDX-License-Identifier: CC-BY-NC-4.0", ["CC-BY-NC-4.0"], ["cc-by-nc-spdx"]),
        ("License: MIT License", [], ["mit-title-bare"]),
        (GPL_HEADER, ["GPL-3.0-or-later"], ["gpl-free", "gpl-hope", "gpl-details"]),
        (GPL_HEADER.replace(": you", "; you").replace("# ", "").replace("\n", " "), ["GPL-3.0-or-later"], ["gpl-free", "gpl-hope", "gpl-details"]),
        (MPL_HEADER, ["MPL-2.0"], ["mpl2-form"]),
        (MPL_HEADER.replace("v. 2", "v.\n * 2"), ["MPL-2.0"], ["mpl2-form"]),
        (APACHE_HEADER, ["Apache-2.0"], ["apache-you", "apache-comply", "apache-copy"]),
        ("Licensed under the. MIT License.", [], ["mit-title-bare"]),
        ("a|b/c: Released under the MIT License.", ["MIT"], ["mit-short"]),
    ],
)
def test_official_punctuation(make, text, found, sentences):
    got = one(make, text)
    assert (got[0], got[2]) == (found, sentences)


def test_long_runs_end_soon(make):
    n = 200_000
    docs = make(*["license " + run * n + "x MIT License." for run in (".", ":", "\n", " \n", ": ", ". ", "v. ", "|/")])
    assert all(not r["licenses"] for r in licenses.scan_licenses(docs).collect())


BY_LINE, BY_WRAP = "Licensed under CC BY-NC 4.0\nown words. ", "This work is licensed under the GNU General\nPublic License, version 3."


@pytest.mark.parametrize(
    "text, found, sentences",
    [
        (BY_LINE + BY_WRAP, ["CC-BY-NC-4.0", "GPL-3.0"], ["cc-by-nc-short", "gpl3-short"]),
        (BY_LINE + BY_WRAP + " " + BY_WRAP, ["CC-BY-NC-4.0", "GPL-3.0"], ["cc-by-nc-short", "gpl3-short", "gpl3-short"]),
        (BY_WRAP + "\n" + BY_LINE, ["CC-BY-NC-4.0", "GPL-3.0"], ["gpl3-short", "cc-by-nc-short"]),
        ("Released under the MIT License.\n" + BY_WRAP, ["GPL-3.0", "MIT"], ["mit-short", "gpl3-short"]),
        ("Released under the\nMIT License.", ["MIT"], ["mit-short"]),
        ("Licensed under the Apache License, Version 2.0\nthe license", ["Apache-2.0"], ["apache-short"]),
        ("2020 somebody. All rights\nreserved.", ["proprietary"], ["all-rights"]),
    ],
)
def test_both_readings_count(make, text, found, sentences):
    got = one(make, text)
    assert (got[0], got[2]) == (found, sentences)


BSD_HEADER = """Copyright (c) 2011, The Authors. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

 * Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
 * Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
 * Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software without
   specific prior written permission.
"""
LGPL_HEADER = GPL_HEADER.replace("This program", "This library").replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1")
CC0_NOTICE = """To the extent possible under law, the author(s) have dedicated all copyright
and related and neighboring rights to this software to the public domain
worldwide. This software is distributed without any warranty.
"""
HEADERS = (
    (BSD_HEADER, ["BSD-3-Clause"], "permissive"),
    ("Copyright 2020 A. All rights reserved.\n" + APACHE_HEADER, ["Apache-2.0"], "permissive"),
    (GPL_HEADER.replace("version 3", "version 2"), ["GPL-2.0-or-later"], "copyleft"),
    (LGPL_HEADER, ["LGPL-2.1-or-later"], "copyleft"),
    (CC0_NOTICE, ["CC0-1.0"], "permissive"),
    ("(c) 2020 Somebody.\nAll rights reserved.\nDo not copy.", ["proprietary"], "restricted"),
    (GPL_HEADER, ["GPL-3.0-or-later"], "copyleft"),
    (MPL_HEADER, ["MPL-2.0"], "copyleft"),
)


@pytest.mark.parametrize("text, found, kind", HEADERS)
def test_official_headers(make, text, found, kind):
    assert one(make, text)[:2] == (found, kind)


def test_sql_says_the_same(make):
    """Headers as they are, on one line, with other ends, one after the other, and next to every known sentence."""
    import duckdb

    texts = [t for t, _, _ in HEADERS] + [t.replace("\n", " ") for t, _, _ in HEADERS] + [t.replace("\n", "\r\n") for t, _, _ in HEADERS]
    texts += [BY_LINE + BY_WRAP, BY_WRAP + "\n" + BY_LINE, "Released under the\nMIT License.", "a|b/c: Released under the MIT License.", "x. ; Released under the MIT License"]
    texts += ["Licensed under the Apache License, Version 2.0\nthe license", "SPDX-License-Identifier: MIT", "License: MIT License: ; MIT License", "", None, "...", "Released under the MIT License" * 2]
    texts += [f"so. {s.capitalize()}: {t}; {s}\n{s}!" for s, t in zip(licenses.SENTENCES.values(), [*licenses.SENTENCES.values()][7:])]
    texts += ["\n".join(t for t, _, _ in HEADERS)]
    con = duckdb.connect()
    con.execute("CREATE TABLE texts (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO texts VALUES (?, ?)", list(enumerate(texts)))
    expected = {r[0]: r[1:] for r in con.execute(licenses._op4_sql("texts")).fetchall()}
    for r in licenses.scan_licenses(make(*texts)).collect():
        got = len(r["license_sentences"]), ",".join(r["license_sentences"]), ",".join(r["licenses"]), r["license_class"]
        assert got == expected[r["doc_id"]], texts[r["doc_id"]]
