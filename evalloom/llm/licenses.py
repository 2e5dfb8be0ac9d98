"""Licence scans by sentence rules, in native expressions only.

A text is normalised (lower case, letters and digits, line ends and stops kept as marks), and known licence sentences are
found in it as parts of sentences, also wrapped over lines and behind comment prefixes, and mapped to identifiers. The document's sequence of identifiers is then matched against ordered rules; each rule that matches takes its
identifiers out, so a short notice inside a full text isn't reported twice.

Defined cases: null, empty and licence-free texts have no sentences and an empty list; repeated sentences are in the
sequence each time, licences are named once, in the rules' order; rows are independent of each other, so repeated rows come out
alike; texts are whole, whatever their length; an empty table gives no rows; input columns called `_lic_*` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm._shared import let, table

#: Known sentences, normalised, and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache.ref",
    "licensed under the apache license version 2 0 the license": "apache.grant",
    "you may not use this file except in compliance with the license": "apache.comply",
    "you may obtain a copy of the license at": "apache.copy",
    "spdx license identifier apache 2 0": "apache.spdx",
    "released under the mit license": "mit.ref",
    "licensed under the mit license": "mit.ref",
    "this project is licensed under the mit license": "mit.ref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit.grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit.notice",
    "the software is provided as is without warranty of any kind express or implied": "mit.warranty",
    "spdx license identifier mit": "mit.spdx",
    "this work is licensed under the gnu general public license version 3": "gpl3.ref",
    "licensed under the gnu general public license version 3": "gpl3.ref",
    "this program is free software": "gpl.free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl.redistribute",
    "either version 3 of the license or at your option any later version": "gpl3.later",
    "either version 2 of the license or at your option any later version": "gpl2.later",
    "spdx license identifier gpl 3 0 or later": "gpl3.spdx",
    "spdx license identifier gpl 3 0 only": "gpl3only.spdx",
    "spdx license identifier gpl 2 0 or later": "gpl2.spdx",
    "spdx license identifier gpl 2 0 only": "gpl2only.spdx",
    "spdx license identifier gpl 2 0": "gpl2only.spdx",
    "spdx license identifier lgpl 2 1 or later": "lgpl21.spdx",
    "spdx license identifier lgpl 3 0 or later": "lgpl3.spdx",
    "spdx license identifier agpl 3 0 or later": "agpl3.spdx",
    "spdx license identifier agpl 3 0 only": "agpl3only.spdx",
    "spdx license identifier bsd 3 clause": "bsd3.spdx",
    "spdx license identifier bsd 2 clause": "bsd2.spdx",
    "spdx license identifier isc": "isc.spdx",
    "spdx license identifier mpl 2 0": "mpl2.spdx",
    "spdx license identifier cc0 1 0": "cc0.spdx",
    "spdx license identifier unlicense": "unlicense.spdx",
    "spdx license identifier bsl 1 0": "bsl.spdx",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl.redistribute",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "agpl.redistribute",
    "either version 2 1 of the license or at your option any later version": "lgpl21.later",
    "this library is free software": "gpl.free",
    "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law": "cc0.waive",
    "creative commons legal code cc0 1 0 universal": "cc0.title",
    "cc0 1 0 universal public domain dedication": "cc0.title",
    "this is free and unencumbered software released into the public domain": "unlicense.free",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense.anyone",
    "boost software license version 1 0": "bsl.title",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software": "bsl.grant",
    "licensed under cc by nc 4 0": "ccbync4.ref",
    "licensed under cc by 4 0": "ccby4.ref",
    "licensed under cc by sa 4 0": "ccbysa4.ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby4.ref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd.grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd.source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd.binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd.endorse",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc.grant",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2.ref",
    "apache license version 2 0 january 2004": "apache.title",
    "licensed under apache 2 0": "apache.ref",
    "licensed under either of apache license version 2 0 or mit license": "either.ref",
    "mit license": "mit.title",
    "the mit license mit": "mit.name",
    "gnu general public license version 3 29 june 2007": "gpl3.title",
    "gnu general public license version 2 june 1991": "gpl2.title",
    "gnu lesser general public license version 3 29 june 2007": "lgpl3.title",
    "gnu lesser general public license version 2 1 february 1999": "lgpl21.title",
    "gnu affero general public license version 3 19 november 2007": "agpl3.title",
    "gnu general public license version 3 or later": "gpl3later.ref",
    "gnu general public license version 2 or later": "gpl2later.ref",
    "mozilla public license version 2 0": "mpl2.title",
    "eclipse public license v 2 0": "epl2.title",
    "eclipse public license 2 0": "epl2.title",
    "the origin of this software must not be misrepresented": "zlib.origin",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "zlib.altered",
    "creative commons attribution sharealike 4 0 international": "ccbysa4.title",
    "creative commons attribution noncommercial 4 0 international": "ccbync4.title",
    "creative commons attribution 4 0 international": "ccby4.title",
    "creative commons attribution 3 0 unported": "ccby3.title",
    "spdx license identifier gpl 3 0": "gpl3only.spdx",
    "spdx license identifier lgpl 2 1 only": "lgpl21only.spdx",
    "spdx license identifier lgpl 3 0 only": "lgpl3only.spdx",
    "spdx license identifier epl 2 0": "epl2.spdx",
    "spdx license identifier zlib": "zlib.spdx",
    "spdx license identifier cc by 4 0": "ccby4.spdx",
    "spdx license identifier cc by sa 4 0": "ccbysa4.spdx",
    "all rights reserved": "reserved",
    "copyright": "copyright",
}
#: Rules in order: licence, and the identifiers that must follow each other (others may stand between).
RULES = (
    ("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse")),
    ("BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary")),
    ("MIT", ("mit.grant", "mit.notice", "mit.warranty")),
    ("MIT", ("mit.ref",)),
    ("MIT", ("mit.spdx",)),
    ("Apache-2.0", ("apache.grant", "apache.comply", "apache.copy")),
    ("Apache-2.0", ("apache.ref",)),
    ("Apache-2.0", ("apache.spdx",)),
    ("GPL-3.0-or-later", ("gpl.free", "gpl.redistribute", "gpl3.later")),
    ("GPL-2.0-or-later", ("gpl.free", "gpl.redistribute", "gpl2.later")),
    ("LGPL-3.0-or-later", ("gpl.free", "lgpl.redistribute", "gpl3.later")),
    ("LGPL-2.1-or-later", ("gpl.free", "lgpl.redistribute", "lgpl21.later")),
    ("AGPL-3.0-or-later", ("gpl.free", "agpl.redistribute", "gpl3.later")),
    ("GPL-3.0-or-later", ("gpl3.spdx",)),
    ("GPL-3.0-only", ("gpl3only.spdx",)),
    ("GPL-2.0-or-later", ("gpl2.spdx",)),
    ("GPL-2.0-only", ("gpl2only.spdx",)),
    ("LGPL-2.1-or-later", ("lgpl21.spdx",)),
    ("LGPL-3.0-or-later", ("lgpl3.spdx",)),
    ("AGPL-3.0-or-later", ("agpl3.spdx",)),
    ("AGPL-3.0-only", ("agpl3only.spdx",)),
    ("BSD-3-Clause", ("bsd3.spdx",)),
    ("BSD-2-Clause", ("bsd2.spdx",)),
    ("ISC", ("isc.spdx",)),
    ("MPL-2.0", ("mpl2.spdx",)),
    ("CC0-1.0", ("cc0.spdx",)),
    ("CC0-1.0", ("cc0.waive",)),
    ("CC0-1.0", ("cc0.title",)),
    ("Unlicense", ("unlicense.spdx",)),
    ("Unlicense", ("unlicense.free", "unlicense.anyone")),
    ("BSL-1.0", ("bsl.spdx",)),
    ("BSL-1.0", ("bsl.grant",)),
    ("BSL-1.0", ("bsl.title",)),
    ("GPL-3.0", ("gpl3.ref",)),
    ("CC-BY-NC-4.0", ("ccbync4.ref",)),
    ("CC-BY-SA-4.0", ("ccbysa4.ref",)),
    ("CC-BY-4.0", ("ccby4.ref",)),
    ("ISC", ("isc.grant",)),
    ("MPL-2.0", ("mpl2.ref",)),
    ("Apache-2.0", ("apache.title",)),
    ("Apache-2.0", ("either.ref",)),
    ("MIT", ("either.ref",)),
    ("MIT", ("mit.title",)),
    ("MIT", ("mit.name",)),
    ("GPL-3.0-or-later", ("gpl3later.ref",)),
    ("GPL-2.0-or-later", ("gpl2later.ref",)),
    ("GPL-3.0", ("gpl3.title",)),
    ("GPL-2.0", ("gpl2.title",)),
    ("LGPL-3.0", ("lgpl3.title",)),
    ("LGPL-2.1", ("lgpl21.title",)),
    ("AGPL-3.0", ("agpl3.title",)),
    ("MPL-2.0", ("mpl2.title",)),
    ("EPL-2.0", ("epl2.title",)),
    ("EPL-2.0", ("epl2.spdx",)),
    ("Zlib", ("zlib.origin", "zlib.altered")),
    ("Zlib", ("zlib.spdx",)),
    ("CC-BY-SA-4.0", ("ccbysa4.title",)),
    ("CC-BY-SA-4.0", ("ccbysa4.spdx",)),
    ("CC-BY-NC-4.0", ("ccbync4.title",)),
    ("CC-BY-4.0", ("ccby4.title",)),
    ("CC-BY-4.0", ("ccby4.spdx",)),
    ("CC-BY-3.0", ("ccby3.title",)),
    ("LGPL-2.1-only", ("lgpl21only.spdx",)),
    ("LGPL-3.0-only", ("lgpl3only.spdx",)),
    ("all-rights-reserved", ("reserved",)),
)
#: Each known sentence holds one of these, so a line without them holds no known sentence.
HINTS = r"(?i)licen[cs]|copyright|reserved|redistribut|permission|warrant|software|version [23]|copy of|cc0|public domain|creative commons"


#: Between two words of a clause: a blank, a line's end, or a stop inside a line; never an empty line.
GAP = r"[ \n|]"
#: Known sentences that count only as a whole one; all others count as parts of a sentence.
WHOLE = ("all rights reserved", "copyright", "mit license")
#: "3.0+" stands for "3.0 or later".
PLUS = r"(licen[cs]e-identifier:\s*[a-z0-9.-]*[0-9])\+"
#: Sentences that are turned round by a word before, or by what follows.
NOT_BEFORE = {"ref": r"(?<!\bnot[ \n]|\bn t[ \n]|\bt[ \n]|\bnever[ \n])"}
NOT_AFTER = {"gpl3.ref": rf"(?!{GAP}or{GAP})", "spdx": rf"(?=$|[\n|]|{GAP}(?:or|and){GAP})"}
#: Parts that holders fill in or that later versions of a text add.
VARIANTS = {
    "the name of the copyright holder nor": f"the name of (?:[a-z0-9]+{GAP}){{1,12}}nor",
    "this permission notice shall": f"this permission notice (?:including the next paragraph{GAP})?shall",
}


def patterns() -> list[tuple[str, str]]:
    """(pattern over a prepared text, identifier), longer sentences first."""
    out = []
    for text, name in sorted(SENTENCES.items(), key=lambda x: -len(x[0])):
        if text in WHOLE:
            tail = r"(?:(?: c)? [0-9][^\n|]*)?" if text == "copyright" else ""
            out.append((rf"(?<![^\n|]){text}{tail}(?: https? [^\n|]*)?(?![^\n|])", name))
            continue
        kind = name.split(".")[1]
        for plain, varied in VARIANTS.items():
            text = text.replace(plain, varied)
        words = "".join(GAP if c == " " else c for c in text) if "(?:" not in text else spaced(text)
        out.append((rf"{NOT_BEFORE.get(kind, '')}(?<![a-z0-9]){words}(?![a-z0-9]){NOT_AFTER.get(name, NOT_AFTER.get(kind, ''))}", name))
    return out


def spaced(text: str) -> str:
    """A text with pattern parts (GAP among them) with its own blanks as GAP."""
    return GAP.join(x.replace(" ", GAP) for x in text.split(GAP))


def prepared(text: Column) -> Column:
    """Lower case; letters and digits, single blanks, a | for each stop inside a line, and line ends."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), PLUS, "$1 or later"), r"[^a-z0-9\n.!?;: \t]", "_")
    plain = F.regexp_replace(plain, r"(?<=[.!?;:])[ \t]+", "|")
    plain = F.regexp_replace(plain, r"[^a-z0-9\n|]+", " ")
    return F.trim(F.regexp_replace(plain, r" *([\n|]) *", "$1"))


def identify(sentence: Column) -> Column:
    """The identifier of a matched part; its gaps are blanks."""
    known = F.lit(None).cast("string")
    for pattern, name in reversed(patterns()):
        plain = pattern.split("(?<![a-z0-9])")[-1].split("(?![a-z0-9])")[0]
        known = F.when(sentence.rlike(f"^(?:{plain})$"), name).otherwise(known)
    return known


def found_in(text: Column) -> Column:
    """(line, id) of the known sentences, in their order; line is where one begins and counts from 1."""
    every = "|".join(f"(?:{p})" for p, _ in patterns())
    marked = F.regexp_replace(prepared(text), every, "<$0>")

    def places(x: Column) -> Column:
        lines = F.filter(F.transform(F.split(x, "\n"), lambda t, i: F.struct((i + 1).alias("line"), F.regexp_count(t, F.lit("<")).alias("n"))), lambda t: t["n"] > 0)
        at = F.flatten(F.transform(lines, lambda t: F.array_repeat(t["line"], t["n"])))
        return F.zip_with(at, F.regexp_extract_all(x, F.lit("<([^>]*)>"), F.lit(1)), lambda line, t: F.struct(line.alias("line"), identify(t).alias("id")))

    return let(marked, places)


def scan(docs: DataFrame) -> DataFrame:
    """docs, all columns, with `_lic_found` (array of line and id) and `_lic_names` (array of licences)."""
    text = F.col("text")
    none = F.array().cast("array<struct<line: int, id: string>>")
    plain = [c for c in docs.columns if not c.startswith("_lic_")]
    out = docs.select(*plain, F.when(text.rlike(HINTS), F.filter(found_in(text), lambda x: x["id"].isNotNull())).otherwise(none).alias("_lic_found"))
    out = out.withColumn("_lic_rest", F.concat(F.lit("|"), F.array_join(F.transform("_lic_found", lambda x: F.concat(x["id"], F.lit("|"))), "")))
    names = []
    for i, (name, ids) in enumerate(RULES):
        pattern = r"\|" + r"\|(?:[^|]*\|)*?".join(f"{x.replace('.', '[.]')}" for x in ids) + r"(?=\|)"
        out = out.withColumn(f"_lic_{i}", F.when(F.col("_lic_rest").rlike(pattern), name))
        if len(ids) > 1:
            out = out.withColumn("_lic_rest", F.regexp_replace("_lic_rest", pattern, ""))
        names.append(F.col(f"_lic_{i}"))
    names = F.array_distinct(F.array_compact(F.array(*names)))
    return out.select(*plain, "_lic_found", names.alias("_lic_names"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.size("_lic_found").cast("long").alias("n_sentences"), F.array_join(F.transform("_lic_found", lambda x: x["id"]), ",").alias("sentence_ids"),
        F.array_join(F.transform("_lic_found", lambda x: x["line"].cast("string")), ",").alias("lines"), F.array_join("_lic_names", ",").alias("licences"),
    )


def oracle() -> str:
    """DuckDB SQL of the query, for known sentences that are a whole one on one line; others it doesn't see. Rules of one identifier and of several are spelled out from RULES."""
    case = " ".join(f"WHEN '{t}' THEN '{i}'" for t, i in SENTENCES.items())
    rest, names = "'|' || coalesce(string_agg(id || '|', '' ORDER BY line, pos), '')", []
    steps = [f"r0 AS (SELECT doc_id, {rest} AS rest FROM ids GROUP BY doc_id)"]
    for i, (name, ids) in enumerate(RULES):
        pattern = r"\|" + r"\|(?:[^|]*\|)*?".join(x.replace(".", "[.]") for x in ids) + r"\|"
        cut = f"regexp_replace(rest, '{pattern}', '|')" if len(ids) > 1 else "rest"
        steps.append(f"r{i + 1} AS (SELECT * EXCLUDE (rest), CASE WHEN regexp_matches(rest, '{pattern}') THEN '{name}' END AS l{i}, {cut} AS rest FROM r{i})")
        names.append(f"l{i}")
    return rf"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
cut AS (SELECT doc_id, line, string_split(regexp_replace(t, '([.!?;:])[ \t]+', '\1' || chr(10), 'g'), chr(10)) AS s FROM lines WHERE regexp_matches(t, '{HINTS}')),
each AS (SELECT doc_id, line, unnest(s) AS s, generate_subscripts(s, 1) AS pos FROM cut),
plain AS (SELECT doc_id, line, pos, regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(s), '^(.*[0-9])\+$', '\1 or later'), '[^a-z0-9]+', ' ', 'g')), '^copyright( c)? [0-9].*$', 'copyright'), ' https? .*$', '') AS s FROM each),
ids AS (SELECT doc_id, line, pos, id FROM (SELECT *, CASE s {case} END AS id FROM plain) WHERE id IS NOT NULL),
{", ".join(steps)},
named AS (SELECT doc_id, array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(list_filter([{", ".join(names)}], lambda x: x IS NOT NULL), lambda x: [x])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END), ',') AS licences FROM r{len(RULES)}),
agg AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY line, pos) AS ids, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line, pos) AS ls FROM ids GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(ls, '') AS lines, coalesce(licences, '') AS licences
FROM documents d LEFT JOIN agg USING (doc_id) LEFT JOIN named USING (doc_id)
"""


ORACLE = oracle()
