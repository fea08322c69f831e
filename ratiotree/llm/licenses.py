"""Licences by known sentences (German, Manabe and Inoue, 2010).

A text is normalised and searched for the known licence sentences, from one sentence's end to another's; rules are sequences of
their identifiers, tried in order. Each row is judged by itself with built-in functions: no shuffle, no join.

``sql`` knows ``SENTENCES`` alone, and those only where no line or other ``END`` cuts them; the operator finds these and, besides, sentences
over several lines and ``NOTICES``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values, the wording of public licences: normalised sentence (lower case, runs of other signs than a-z, 0-9 as one space) -> identifier. ``#`` stands for a number.
SENTENCES = {
    "licensed under the apache license version # #": "ApacheLic",
    "licensed under the apache license version # # the license": "ApacheLic",
    "you may not use this file except in compliance with the license": "ApacheComply",
    "you may obtain a copy of the license at": "ApacheCopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "ApacheWarranty",
    "released under the mit license": "MitRef",
    "this project is licensed under the mit license": "MitRef",
    "licensed under the mit license": "MitRef",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "the software is provided as is without warranty of any kind": "AsIs",
    "this work is licensed under the gnu general public license version #": "GplRef",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version # of the license or at your option any later version": "GplLater",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version # as published by the free software foundation": "GplOnly",
    "this program is distributed in the hope that it will be useful but without any warranty": "GplWarranty",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license version #": "LgplRef",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "licensed under cc by nc # #": "CcByNc",
    "licensed under cc by sa # #": "CcBySa",
    "licensed under cc by # #": "CcBy",
    "this work is licensed under a creative commons attribution noncommercial # # international license": "CcByNc",
    "this work is licensed under a creative commons attribution sharealike # # international license": "CcBySa",
    "this work is licensed under a creative commons attribution # # international license": "CcBy",
    "this source code form is subject to the terms of the mozilla public license v # #": "MplRef",
    "all rights reserved": "AllRights",
}

#: The further wording of standard notices and SPDX lines, which ``sql`` does not have; fixed values too.
NOTICES = {
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheWarranty",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "AsIs",
    "this program is free software you can redistribute it and or modify it under the terms of version # of the gnu general public license as published by the free software foundation": "GplOnly",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GplWarranty",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version # of the license or at your option any later version": "LgplRef",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version # # of the license or at your option any later version": "LgplRef",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version # of the license or at your option any later version": "LgplRef",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation either version # of the license or at your option any later version": "LgplRef",
    "this work is licensed under the creative commons attribution noncommercial # # international license": "CcByNc",
    "this work is licensed under the creative commons attribution sharealike # # international license": "CcBySa",
    "this work is licensed under the creative commons attribution # # international license": "CcBy",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version # of the license or at your option any later version": "AgplLater",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "IscWarranty",
    "this program and the accompanying materials are made available under the terms of the eclipse public license # # which is available at https": "EplRef",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v # # which is available at http": "EplRef",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 # which accompanies this distribution and is available at http": "EplRef",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "spdx license identifier mit": "SpdxMit",
    "spdx license identifier apache # #": "SpdxApache",
    "spdx license identifier gpl # #": "SpdxGpl",
    "spdx license identifier gpl # # only": "SpdxGpl",
    "spdx license identifier gpl # # or later": "SpdxGplLater",
    "spdx license identifier lgpl # #": "SpdxLgpl",
    "spdx license identifier lgpl # # only": "SpdxLgpl",
    "spdx license identifier lgpl # # or later": "SpdxLgpl",
    "spdx license identifier agpl # # only": "SpdxAgpl",
    "spdx license identifier agpl # # or later": "SpdxAgpl",
    "spdx license identifier bsd # clause": "SpdxBsd",
    "spdx license identifier isc": "SpdxIsc",
    "spdx license identifier mpl # #": "SpdxMpl",
    "spdx license identifier epl # #": "SpdxEpl",
    "spdx license identifier cc by # #": "SpdxCcBy",
    "spdx license identifier cc by sa # #": "SpdxCcBySa",
    "spdx license identifier cc by nc # #": "SpdxCcByNc",
    "spdx license identifier cc0 # #": "SpdxCc0",
    "spdx license identifier unlicense": "Unlicense",
}

#: (licence, pattern over identifiers, each with its numbers: ``<ApacheLic 2.0>``), in order; the first that matches takes its identifiers away.
RULES = [
    ("Apache-2.0", r"<ApacheLic 2[.]0>(<ApacheComply >)?(<ApacheCopy >)?(<ApacheWarranty >)?"),
    ("Apache", r"<ApacheLic [0-9.]*>"),
    ("MIT", r"<MitGrant ><MitNotice >(<AsIs >)?"),
    ("MIT", r"<MitRef >"),
    ("GPL-3.0-or-later", r"<GplLater 3>(<GplWarranty >)?"),
    ("GPL-2.0-or-later", r"<GplLater 2>(<GplWarranty >)?"),
    ("GPL-3.0", r"<Gpl(Ref|Only) 3>(<GplWarranty >)?"),
    ("GPL-2.0", r"<Gpl(Ref|Only) 2>(<GplWarranty >)?"),
    ("LGPL", r"<LgplRef [0-9.]*>"),
    ("BSD-3-Clause", r"<BsdGrant ><BsdSource ><BsdBinary ><BsdEndorse >"),
    ("BSD-2-Clause", r"<BsdGrant ><BsdSource ><BsdBinary >"),
    ("CC-BY-NC", r"<CcByNc [0-9.]*>"),
    ("CC-BY-SA", r"<CcBySa [0-9.]*>"),
    ("CC-BY", r"<CcBy [0-9.]*>"),
    ("MPL", r"<MplRef [0-9.]*>"),
    ("AGPL", r"<AgplLater [0-9.]*>(<GplWarranty >)?"),
    ("ISC", r"<IscGrant >(<IscWarranty >)?"),
    ("EPL", r"<EplRef [0-9.]*>"),
    ("Unlicense", r"<Unlicense >"),
    ("MIT", r"<SpdxMit >"),
    ("Apache-2.0", r"<SpdxApache 2[.]0>"),
    ("GPL-3.0-or-later", r"<SpdxGplLater 3[.]0>"),
    ("GPL-2.0-or-later", r"<SpdxGplLater 2[.]0>"),
    ("GPL-3.0", r"<SpdxGpl 3[.]0>"),
    ("GPL-2.0", r"<SpdxGpl 2[.]0>"),
    ("LGPL", r"<SpdxLgpl [0-9.]*>"),
    ("AGPL", r"<SpdxAgpl [0-9.]*>"),
    ("BSD-3-Clause", r"<SpdxBsd 3>"),
    ("BSD-2-Clause", r"<SpdxBsd 2>"),
    ("ISC", r"<SpdxIsc >"),
    ("MPL", r"<SpdxMpl [0-9.]*>"),
    ("EPL", r"<SpdxEpl [0-9.]*>"),
    ("CC-BY-NC", r"<SpdxCcByNc [0-9.]*>"),
    ("CC-BY-SA", r"<SpdxCcBySa [0-9.]*>"),
    ("CC-BY", r"<SpdxCcBy [0-9.]*>"),
    ("CC0", r"<SpdxCc0 [0-9.]*>"),
]

#: Where sentences end, in ``sql``.
END = r"[\n;:]+|[.!?]+[ \t\r\f]"
NUMBER = " ([0-9]+) "

#: Of a lower-case text with a line's end before and after it and without ``|`` and ``~``: patterns and what they become, in turn, so that only a-z, 0-9 and
#: single marks are left. ``|`` ends a sentence, ``~`` may (a line's end, ``;``, ``:``), and a space does not. Each takes time in proportion to the text.
MARKS = [
    ("\n[^a-z0-9\n]+", "\n"),  # indents and comment marks, and lines without words
    ("\n(?:[0-9]{1,2}|[a-z])[)][ \t]", "\n"),  # marks of lists
    ("https?://www[.]apache[.]org/licenses/license-[0-9]+(?:[.][0-9]+)*", "|"),  # stands between two sentences of a notice without a point
    ("\n\n+|[.!?][ \t\r\f\n]", "|"),
    ("[\n;:]", "~"),
    ("[^a-z0-9~|]+", " "),
    (" ?~[ ~]*", "~"),
    ("[ ~]?[|][ ~|]*", "|"),
]
#: The holder's name in the BSD clause is any.
HOLDER = "neither the name of the copyright holder nor the names"
ANY_HOLDER = "^neither the name of .* nor the names"


def _search() -> str:
    """A pattern of all known sentences, the longest first, each with the mark before it; the ``v.`` of a version ends no sentence."""

    def one(sentence: str) -> str:
        out = sentence.replace(HOLDER, "neither the name of ANY nor the names").replace(" ", "[ ~]").replace("[ ~]v[ ~]", "[ ~]v[ ~|]")
        return out.replace("#", "[0-9]+").replace("ANY[ ~]", "(?:[a-z0-9]+[ ~|]){1,20}?")

    return "[~|](?:" + "|".join(map(one, sorted(SENTENCES | NOTICES, key=lambda x: (-len(x), x)))) + ")(?=[~|])"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, ...)``: doc_id, n_sentences, sentence_ids, license, unmatched.

    n_sentences counts the known sentences found, sentence_ids lists them in text order with their numbers (``<ApacheLic 2.0>``);
    license is ``None`` without known sentences, ``Unknown`` if no rule matches, else the licences that rules find, each once and in
    rule order, joined by `` AND ``; unmatched counts the sentences no rule used. Null and empty
    texts, and an empty table, have no sentences. Repeated rows each give a row. Texts of any length are searched whole, in time in proportion to them; further
    columns are not read, whatever their names.
    """
    known = F.create_map(*[F.lit(x) for pair in (SENTENCES | NOTICES).items() for x in pair])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def named(sentence: Column) -> Column:
        words = F.regexp_replace(F.trim(F.translate(sentence, "~|", "  ")), ANY_HOLDER, HOLDER)
        spaced = F.concat(F.lit(" "), F.regexp_replace(words, " ", "  "), F.lit(" "))
        key = F.trim(F.regexp_replace(F.regexp_replace(spaced, NUMBER, " # "), "  ", " "))
        return F.concat(F.lit("<"), F.element_at(known, key), F.lit(" "), F.array_join(F.regexp_extract_all(spaced, F.lit(NUMBER), F.lit(1)), "."), F.lit(">"))

    marked = F.concat(F.lit("\n"), F.translate(F.lower(text), "~|", "  "), F.lit("\n"))
    for pattern, mark in MARKS:
        marked = F.regexp_replace(marked, pattern, mark)
    sentences = F.regexp_extract_all(marked, F.lit(_search()), F.lit(0))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sentences.alias("s"))
    found = found.withColumn("ids", F.filter(F.transform("s", named), lambda x: x.isNotNull()))
    found = found.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", "").alias("sentence_ids")).withColumn("rest", F.col("sentence_ids"))
    for i, (name, pattern) in enumerate(RULES):
        found = found.withColumn(f"hit{i}", F.when(F.col("rest").rlike(pattern), F.lit(name))).withColumn("rest", F.regexp_replace("rest", pattern, "~"))
    licenses = F.array_join(F.array_distinct(F.array_compact(F.array(*[f"hit{i}" for i in range(len(RULES))]))), " AND ")
    verdict = F.when(F.col("n_sentences") == 0, F.lit("None")).when(licenses == "", F.lit("Unknown")).otherwise(licenses)
    unmatched = F.size(F.regexp_extract_all("rest", F.lit("<"), F.lit(0)))
    return found.select("doc_id", "n_sentences", "sentence_ids", verdict.alias("license"), unmatched.cast("long").alias("unmatched"))


def sql() -> str:
    """The same for DuckDB."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    known = "map([" + ", ".join(map(quote, SENTENCES)) + "], [" + ", ".join(map(quote, SENTENCES.values())) + "])"
    spaced = "' ' || replace(trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')), ' ', '  ') || ' '"
    key = f"trim(replace(regexp_replace({spaced}, '{NUMBER}', ' # ', 'g'), '  ', ' '))"
    steps, last = [], "named"
    for i, (name, pattern) in enumerate(RULES):
        steps.append(f"r{i} as (select *, case when regexp_matches(rest{i}, '{pattern}') then '{name}' end as hit{i}, regexp_replace(rest{i}, '{pattern}', '~', 'g') as rest{i + 1} from {last})")
        last = f"r{i}"
    hits = ", ".join(f"hit{i}" for i in range(len(RULES)))
    return f"""
with sentences as (
  select doc_id, string_split_regex(coalesce(text, ''), '{END}') as ss from documents
), ids as (
  select doc_id, list_filter(list_transform(ss, lambda s: '<' || {known}[{key}] || ' ' || array_to_string(regexp_extract_all({spaced}, '{NUMBER}', 1), '.') || '>'), lambda x: x is not null) as ids from sentences
), named as (
  select doc_id, cast(len(ids) as bigint) as n_sentences, array_to_string(ids, '') as sentence_ids, array_to_string(ids, '') as rest0 from ids
), {", ".join(steps)}, verdicts as (
  select *, list_filter([{hits}], lambda x: x is not null) as hits from {last}
)
select doc_id, n_sentences, sentence_ids,
       case when n_sentences = 0 then 'None' when len(hits) = 0 then 'Unknown' else array_to_string(list_filter(hits, lambda x, i: list_position(hits, x) = i), ' AND ') end as license,
       cast(len(regexp_extract_all(rest{len(RULES)}, '<')) as bigint) as unmatched
from verdicts
"""
