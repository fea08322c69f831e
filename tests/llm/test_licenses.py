import textwrap

import duckdb
import pandas as pd
import pytest

from ratiotree.llm import licenses

APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License. You may obtain a copy of the License at http://x"""
TEXTS = [
    (1, APACHE, "Apache-2.0"), (2, "Some words. Released under the MIT license.\nmore", "MIT"), (3, None, "None"), (4, "", "None"),
    (5, "all rights reserved!", "Unknown"), (6, APACHE + "\n\nReleased under the MIT License", "Apache-2.0 AND MIT"),
    (7, "This work is licensed under the GNU General Public License version 3. Bye", "GPL-3.0"), (8, "We licensed nothing under any license. " * 3000, "None"),
    (9, "Licensed under CC BY-NC 4.0", "CC-BY-NC"), (9, "Licensed under CC BY-NC 4.0", "CC-BY-NC"), (None, "licensed under the mit license", "MIT"),
    (11, "Licensed under the Apache License, Version 1.1", "Apache"), (12, "notlicensed under the mit license", "None"),
]


def test_known_texts(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in TEXTS], "doc_id long, text string, license string, rest int")
    got = licenses.scan_licenses(df).collect()
    assert sorted((r.doc_id or -1, r.license) for r in got) == sorted((i or -1, want) for i, _, want in TEXTS)
    assert next(r.unmatched for r in got if r.doc_id == 5) == 1


def test_equals_sql(spark):
    documents = pd.DataFrame({"doc_id": [i for i, _, _ in TEXTS if i], "text": [t for i, t, _ in TEXTS if i]})
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.execute(licenses.sql()).fetchall()
    got = licenses.scan_licenses(spark.createDataFrame([(i, t) for i, t, _ in TEXTS if i], "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_empty_table(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."
FREE = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public License as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version."
BSD = [
    "Copyright (c) 2015, Some Institute Inc. All rights reserved.",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
]
ENDORSE = "3. Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
#: (paragraphs of a standard notice, licence, identifiers)
STANDARD = [
    (["Copyright 2015 A. Body", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', "http://www.apache.org/licenses/LICENSE-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'], "Apache-2.0", "<ApacheLic 2.0><ApacheComply ><ApacheCopy ><ApacheWarranty >"),
    (["Licensed under the Apache License, Version 1.1."], "Apache", "<ApacheLic 1.1>"),
    (["Copyright (c) 2015 A. Body", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:', "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE.'], "MIT", "<MitGrant ><MitNotice ><AsIs >"),
    (["This project is licensed under the MIT License."], "MIT", "<MitRef >"),
    ([FREE.format("program", ":", "", ",", 3), WARRANTY], "GPL-3.0-or-later", "<GplLater 3><GplWarranty >"),
    ([FREE.format("program", ";", "", ";", 2), WARRANTY], "GPL-2.0-or-later", "<GplLater 2><GplWarranty >"),
    (["This program is free software; you can redistribute it and/or modify it under the terms of version 3 of the GNU General Public License as published by the Free Software Foundation.", WARRANTY], "GPL-3.0", "<GplOnly 3><GplWarranty >"),
    (["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", WARRANTY], "GPL-2.0", "<GplOnly 2><GplWarranty >"),
    (["This work is licensed under the GNU General Public License, version 3."], "GPL-3.0", "<GplRef 3>"),
    ([FREE.format("library", ";", "Lesser ", ";", "2.1")], "LGPL", "<LgplRef 2.1>"),
    ([FREE.format("program", ":", "Lesser ", ",", "3")], "LGPL", "<LgplRef 3>"),
    ([FREE.format("library", ";", "Library ", ";", "2")], "LGPL", "<LgplRef 2>"),
    ([*BSD, ENDORSE.format("the copyright holder")], "BSD-3-Clause", "<AllRights ><BsdGrant ><BsdSource ><BsdBinary ><BsdEndorse >"),
    ([*BSD, ENDORSE.format("Some Institute Inc.")], "BSD-3-Clause", "<AllRights ><BsdGrant ><BsdSource ><BsdBinary ><BsdEndorse >"),
    ([x.replace(". R", ") R") for x in BSD], "BSD-2-Clause", None),
    (BSD, "BSD-2-Clause", "<AllRights ><BsdGrant ><BsdSource ><BsdBinary >"),
    (["This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."], "CC-BY-NC", "<CcByNc 4.0>"),
    (["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."], "CC-BY-SA", "<CcBySa 4.0>"),
    (["This work is licensed under the Creative Commons Attribution 4.0 International License."], "CC-BY", "<CcBy 4.0>"),
    (["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."], "MPL", "<MplRef 2.0>"),
    ([FREE.format("program", ":", "Affero ", ",", 3), WARRANTY], "AGPL", "<AgplLater 3><GplWarranty >"),
    (["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.'], "ISC", "<IscGrant ><IscWarranty >"),
    (["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"], "EPL", "<EplRef 2.0>"),
    (["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://x"], "EPL", None),
    (["This is free and unencumbered software released into the public domain."], "Unlicense", "<Unlicense >"),
    *[([f"SPDX-License-Identifier: {x}"], want, None) for x, want in (
        ("MIT", "MIT"), ("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2.0"), ("GPL-3.0-only", "GPL-3.0"), ("GPL-2.0-or-later", "GPL-2.0-or-later"), ("GPL-3.0-or-later", "GPL-3.0-or-later"), ("LGPL-2.1", "LGPL"),
        ("LGPL-2.1-only", "LGPL"), ("LGPL-3.0-or-later", "LGPL"), ("AGPL-3.0-only", "AGPL"), ("AGPL-3.0-or-later", "AGPL"), ("BSD-3-Clause", "BSD-3-Clause"), ("BSD-2-Clause", "BSD-2-Clause"), ("ISC", "ISC"),
        ("MPL-2.0", "MPL"), ("EPL-2.0", "EPL"), ("CC-BY-4.0", "CC-BY"), ("CC-BY-SA-4.0", "CC-BY-SA"), ("CC-BY-NC-4.0", "CC-BY-NC"), ("CC0-1.0", "CC0"), ("Unlicense", "Unlicense"))],
]


@pytest.mark.parametrize("form", ["one line", "a line each", "plain", "# ", " * ", "// ", "! ", "\r"])
def test_standard_notices(spark, form):
    def laid(paragraphs):
        if form == "one line":
            return "Some words. " + " ".join(p + "." * p.endswith("Body") for p in paragraphs) + " More words follow."
        if form == "a line each":
            return "\n".join(paragraphs)
        mark = "" if form in ("plain", "\r") else form
        end = "\r\n" if form == "\r" else "\n"
        lines = [f"{mark}{line}" for p in paragraphs for line in [*textwrap.wrap(p, 64), ""]]
        return end.join(["int x;", *lines, "int y;"])

    # on one line only a number and a point mark lists
    rows = [(i, laid(p)) for i, (p, _, ids) in enumerate(STANDARD) if ids or form != "one line"]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(i, STANDARD[i][1]) for i, _ in rows]
    assert all(r.sentence_ids == STANDARD[r.doc_id][2] for r in got if STANDARD[r.doc_id][2])


def test_each_rule_and_identifier_is_reached_by_genuine_wording(spark):
    import re

    for width in (72, 80):
        rows = [(i, "\n\n".join(textwrap.fill(x, width) for x in p)) for i, (p, _, _) in enumerate(STANDARD)]
        ids = "".join(r.sentence_ids for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert all(re.search(pattern, ids) for _, pattern in licenses.RULES)
        assert {name for name in (licenses.SENTENCES | licenses.NOTICES).values()} == set(re.findall("<([A-Za-z0-9]+) ", ids))


def test_paragraphs_and_sentences_do_not_join(spark):
    rows = [(1, "Released under\n\nthe MIT License"), (2, "Released. Under the MIT License"), (3, "Released under\nthe MIT License"), (4, "~|Released under the~MIT|License|~"), (5, "Not released under\nthe MIT License")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(1, "None"), (2, "None"), (3, "MIT"), (4, "MIT"), (5, "None")]


def test_each_sentence_alone_equals_sql(spark):
    keys = [k.replace("#", "3") for k in licenses.SENTENCES]
    texts = [x for k in keys for x in (k, k.upper().replace(" ", "\t"), k.replace(" ", "-"), f"Words! {k.replace(' ', '  ')} . Words", f"\n\t{k}\r\n")]
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.execute(licenses.sql()).fetchall()
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and all(x[1] == 1 for x in want)
