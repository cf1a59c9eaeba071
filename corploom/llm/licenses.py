"""Operator 6, licence scans by sentence rules, with DataFrame functions only.

Texts that hold a licence word are cut into sentences. Comment marks and list marks at the beginning
of lines go; a line of ``WRAPPED`` characters or more that doesn't end a sentence goes on in the next
one, whatever its case. A sentence is normalised (lower case, letters and digits, one space between)
and becomes the identifier of the known sentence that it is, any other one a gap. The identifiers of
a text, in order, are held against licence rules, which are ordered: the first rules name the longest
sequences, with up to ``GAPS`` unknown sentences between two known ones, and what a rule has matched
is taken out before the next is tried. All of it is a projection, without a shuffle.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: A text without any of these (in either case) holds no licence sentence.
HINTS = ("licen", "reserved", "permission", "redistribut", "warrant", "copyright", "public domain")
#: Characters of a line from which on it may go on in the next one, and unknown sentences between two known ones.
WRAPPED, GAPS = 50, 3
#: Signs at a line's beginning that belong to comments, and marks of list items.
COMMENT = r"^[ \t]*(//+!?|/\*+!?|\*+/?|#+!?|--+|;+|%+|<!--|\.\.|dnl |rem |REM )?[ \t]*"
ITEM = r"^(\(?([0-9]{1,2}|[a-z])[.)]|[*-])[ \t]+"
#: Abbreviations whose full stop ends no sentence.
SHORT = r"(^|[ (])(v|ver|no|inc|co|ltd|corp|e\.g|i\.e|[A-Z])\. +"

#: Identifier, how the normalised sentence begins, what it holds as well. The first that fits counts.
SENTENCES = (
    ("UnicodeGrant", "permission is hereby granted free of charge to any person obtaining a copy of data files", ()),
    ("BoostGrant", "permission is hereby granted free of charge to any person or organization obtaining a copy", ()),
    ("MitGrant", "permission is hereby granted free of charge to any person obtaining a copy", ()),
    ("UplGrant", "subject to the condition set forth below permission is hereby granted to any person obtaining a copy", ()),
    ("MitNotice", "the above copyright notice and this permission notice shall be included in all", ()),
    ("MitAsIs", "the software is provided as is without warranty of any kind", ()),
    ("BsdHead", "redistribution and use in source and binary forms with or without modification are permitted", ()),
    ("BsdSource", "redistributions of source code must retain the above copyright notice", ()),
    ("BsdBinary", "redistributions in binary form must reproduce the above copyright notice", ()),
    ("BsdEndorse", "neither the name", ("may be used to endorse or promote products",)),
    ("BsdEndorse", "the name of", ("may not be used to endorse or promote products",)),
    ("BsdAdvert", "all advertising materials mentioning features or use of this software must display", ()),
    ("BsdClear", "no express or implied licenses to any party s patent rights are granted by this license", ()),
    ("BsdAsIs", "this software is provided by", ("as is and any express or implied warranties",)),
    ("IscGrant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", ()),
    ("ZeroBsdGrant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ()),
    ("CurlGrant", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", ()),
    ("HpndGrant", "permission to use copy modify and distribute this software and its documentation for any purpose", ()),
    ("IscAsIs", "the software is provided as is and the author disclaims all warranties", ()),
    ("NoAdvert", "except as contained in this notice the name", ("shall not be used in advertising",)),
    ("ZlibAsIs", "this software is provided as is without any express or implied warranty", ()),
    ("ZlibGrant", "permission is granted to anyone to use this software for any purpose including commercial applications", ()),
    ("ZlibOrigin", "the origin of this software must not be misrepresented", ()),
    ("ZlibAltered", "altered source versions must be plainly marked as such", ()),
    ("ApacheRef", "", ("licensed under the apache license version 2 0",)),
    ("ApacheRef", "", ("released under the apache license version 2 0",)),
    ("ApacheUse", "you may not use this file except in compliance with the license", ()),
    ("Agpl3Later", "", ("gnu affero general public license", "version 3", "any later version")),
    ("Agpl3Only", "", ("gnu affero general public license", "version 3")),
    ("Lgpl21Later", "", ("gnu lesser general public license", "version 2 1", "any later version")),
    ("Lgpl21Only", "", ("gnu lesser general public license", "version 2 1")),
    ("Lgpl3Later", "", ("gnu lesser general public license", "version 3", "any later version")),
    ("Lgpl3Only", "", ("gnu lesser general public license", "version 3")),
    ("Lgpl2Later", "", ("gnu library general public license", "version 2", "any later version")),
    ("Gpl2Later", "", ("gnu general public license", "version 2", "any later version")),
    ("Gpl2Only", "", ("gnu general public license", "version 2")),
    ("Gpl3Later", "", ("gnu general public license", "version 3", "any later version")),
    ("Gpl3Later", "", ("gnu general public license", "version 3", "or later")),
    ("Gpl3Only", "", ("gnu general public license", "version 3")),
    ("Mpl2Ref", "this source code form is subject to the terms of the mozilla public license v 2 0", ()),
    ("Epl2Ref", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ()),
    ("Epl2Ref", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0", ()),
    ("Cc0Ref", "to the extent possible under law", ("waived all copyright and related or neighboring rights",)),
    ("CcByNc", "", ("licensed under", "cc by nc")),
    ("CcByNc", "", ("licensed under", "creative commons attribution noncommercial")),
    ("CcBySa", "", ("licensed under", "cc by sa")),
    ("CcBySa", "", ("licensed under", "creative commons attribution sharealike")),
    ("CcBy", "", ("licensed under", "cc by")),
    ("CcBy", "", ("licensed under", "creative commons attribution")),
    ("MitRef", "", ("under the mit license",)),
    ("BslRef", "", ("distributed under the boost software license version 1 0",)),
    ("Unlicense", "this is free and unencumbered software released into the public domain", ()),
    ("WtfplRef", "", ("do what the fuck you want to public license",)),
    ("PsfRef", "python software foundation license version 2", ()),
    ("NcsaRef", "university of illinois ncsa open source license", ()),
    ("BlueOakRef", "blue oak model license", ()),
    ("Reserved", "all rights reserved", ()),
    ("Reserved", "copyright", ("all rights reserved",)),
    ("Copyright", "copyright", ()),
)
#: Grants that hold one of these (whole) words aren't the known ones but narrower: their identifier is ``Restricted``, which no rule has.
GRANTS = ("UnicodeGrant", "BoostGrant", "MitGrant", "BsdHead", "IscGrant", "ZeroBsdGrant", "CurlGrant", "HpndGrant", "ZlibGrant")
NARROWING = ("only", "non commercial", "noncommercial", "academic", "educational", "evaluation", "prohibited", "forbidden", "not permitted", "not be used", "unless", "except", "military")
#: Licences that a line "SPDX-License-Identifier: ..." may name; the sentence's identifier is Spdx: and the name.
SPDX = "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC0-1.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib".split()

#: Licence -> sequence of identifiers, in the order in which they are tried.
RULES = (
    ("BSD-4-Clause", ("BsdHead", "BsdSource", "BsdBinary", "BsdAdvert", "BsdEndorse", "BsdAsIs")),
    ("BSD-3-Clause-Clear", ("BsdHead", "BsdSource", "BsdBinary", "BsdEndorse", "BsdClear", "BsdAsIs")),
    ("BSD-3-Clause", ("BsdHead", "BsdSource", "BsdBinary", "BsdEndorse", "BsdAsIs")),
    ("BSD-2-Clause", ("BsdHead", "BsdSource", "BsdBinary", "BsdAsIs")),
    ("NCSA", ("MitGrant", "BsdSource", "BsdBinary", "BsdEndorse", "MitAsIs")),
    ("Zlib", ("ZlibAsIs", "ZlibGrant", "ZlibOrigin", "ZlibAltered")),
    ("BSD-1-Clause", ("BsdHead", "BsdSource", "BsdAsIs")),
    ("X11", ("MitGrant", "MitNotice", "MitAsIs", "NoAdvert")),
    ("MIT", ("MitGrant", "MitNotice", "MitAsIs")),
    ("Unicode-3.0", ("UnicodeGrant", "MitAsIs")),
    ("Unicode-3.0", ("UnicodeGrant",)),
    ("BSL-1.0", ("BoostGrant", "MitAsIs")),
    ("BSL-1.0", ("BoostGrant",)),
    ("BSL-1.0", ("BslRef",)),
    ("UPL-1.0", ("UplGrant",)),
    ("MIT", ("MitGrant", "MitNotice")),
    ("MIT-0", ("MitGrant", "MitAsIs")),
    ("ISC", ("IscGrant", "IscAsIs")),
    ("ISC", ("IscGrant",)),
    ("0BSD", ("ZeroBsdGrant", "IscAsIs")),
    ("0BSD", ("ZeroBsdGrant",)),
    ("curl", ("CurlGrant", "MitAsIs", "NoAdvert")),
    ("ISC", ("CurlGrant",)),
    ("HPND", ("HpndGrant",)),
    ("Zlib", ("ZlibAsIs", "ZlibGrant")),
    ("Apache-2.0", ("ApacheRef", "ApacheUse")),
    ("Apache-2.0", ("ApacheRef",)),
    ("AGPL-3.0-or-later", ("Agpl3Later",)),
    ("AGPL-3.0-only", ("Agpl3Only",)),
    ("LGPL-2.1-or-later", ("Lgpl21Later",)),
    ("LGPL-2.1-only", ("Lgpl21Only",)),
    ("LGPL-3.0-or-later", ("Lgpl3Later",)),
    ("LGPL-3.0-only", ("Lgpl3Only",)),
    ("LGPL-2.0-or-later", ("Lgpl2Later",)),
    ("GPL-2.0-or-later", ("Gpl2Later",)),
    ("GPL-2.0-only", ("Gpl2Only",)),
    ("GPL-3.0-or-later", ("Gpl3Later",)),
    ("GPL-3.0-only", ("Gpl3Only",)),
    ("MIT", ("MitRef",)),
    ("MPL-2.0", ("Mpl2Ref",)),
    ("EPL-2.0", ("Epl2Ref",)),
    ("CC0-1.0", ("Cc0Ref",)),
    ("CC-BY-NC-4.0", ("CcByNc",)),
    ("CC-BY-SA-4.0", ("CcBySa",)),
    ("CC-BY-4.0", ("CcBy",)),
    ("Unlicense", ("Unlicense",)),
    ("WTFPL", ("WtfplRef",)),
    ("Python-2.0", ("PsfRef",)),
    ("NCSA", ("NcsaRef",)),
    ("BlueOak-1.0.0", ("BlueOakRef",)),
    *((name, (f"Spdx:{name}",)) for name in SPDX),
    ("LicenseRef-AllRightsReserved", ("Reserved",)),
)


def _spdx_sentence(name: str) -> str:
    return "spdx license identifier " + "".join(c if c.isalnum() else " " for c in name.lower())


def sentences(text: Column) -> Column:
    """Sentences of a text, wrapped lines joined, comment and list marks taken off."""
    bare = F.transform(F.split(text, "\n"), lambda x: F.rtrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[\r]", ""), COMMENT, ""), ITEM, "")))
    goes_on = lambda x: (F.length(x) >= WRAPPED) & ~F.right(x, F.lit(1)).isin(*".!?:;")
    joined = F.array_join(F.transform(bare, lambda x: F.concat(x, F.when(goes_on(x), " ").otherwise("\n"))), "")
    return F.split(F.regexp_replace(F.regexp_replace(joined, SHORT, "$1$2 "), r"([.!?])[\"')]*[ \t]+", "$1\n"), "\n")


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def identifier(sentence: Column) -> Column:
    """The identifier of a normalised sentence, a gap (``-``) if it isn't a known one: a few fixed strings, no pattern."""
    known = F.when(F.lit(False), "-")
    words = F.concat(F.lit(" "), sentence, F.lit(" "))
    narrower = reduce(or_, [F.contains(words, F.lit(f" {w} ")) for w in NARROWING])
    for name, begin, held in SENTENCES:
        fits = F.startswith(sentence, F.lit(begin)) if begin else F.lit(True)
        for part in held:
            fits = fits & F.contains(sentence, F.lit(part))
        if name in GRANTS:
            known = known.when(fits & narrower, "Restricted")
        known = known.when(fits, name)
    named = F.create_map(*[F.lit(x) for name in SPDX for x in (_spdx_sentence(name), f"Spdx:{name}")])
    # nearly every other sentence is settled by one look
    return F.when(sentence.rlike(KNOWN), known.otherwise(F.coalesce(F.element_at(named, sentence), F.lit("-")))).otherwise("-")


#: What every known sentence holds.
KNOWN = "permission|licen[cs]e|redistribution|all rights reserved|copyright|provided|endorse|advertising|misrepresented|altered source|free and unencumbered|cc by|creative commons"


def _pattern(sequence: tuple[str, ...]) -> str:
    return ";" + f";(-;){{0,{GAPS}}}".join(sequence) + ";"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_known (long), sentence_ids, licenses, unmatched of every text.

    ``sentence_ids`` are the known sentences in order, joined by commas; ``licenses`` the licences
    that the rules found, each once, in the rules' order; ``unmatched`` known sentences that are in
    no rule's match. A null or empty text has none of them (empty strings). Every row gives one row,
    rows that repeat and those without an id too; an empty table gives none. Other columns aren't read.
    """
    d = text_of(docs, id_col, text_col).withColumn("low", F.lower("text"))
    ids = F.transform(F.filter(F.transform(sentences(F.col("text")), normalised), lambda s: s != ""), identifier)
    d = d.select("doc_id", F.when(reduce(or_, [F.contains("low", F.lit(h)) for h in HINTS]), ids).otherwise(F.array().cast("array<string>")).alias("ids"))
    d = d.select("doc_id", F.filter("ids", lambda i: i != "-").alias("known"), F.concat(F.lit(";"), F.array_join("ids", ";"), F.lit(";")).alias("rest"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(f";{sequence[0]};").alias("first"), F.lit(_pattern(sequence)).alias("pattern")) for name, sequence in RULES])

    def tried(state: Column, rule: Column) -> Column:
        # a pattern is looked at only where the rule's first sentence is left
        hit = F.contains(state["rest"], rule["first"]) & F.regexp_like(state["rest"], rule["pattern"])
        rest = F.when(hit, F.regexp_replace(state["rest"], rule["pattern"], F.lit(";-;"))).otherwise(state["rest"])
        return F.struct(rest.alias("rest"), F.when(hit, F.array_append(state["found"], rule["name"])).otherwise(state["found"]).alias("found"))

    start = F.struct("rest", F.array().cast("array<string>").alias("found"))
    d = d.select("doc_id", "known", F.when(F.size("known") > 0, F.aggregate(rules, start, tried)).otherwise(start).alias("state"))
    left = F.filter(F.split("state.rest", ";"), lambda i: ~i.isin("", "-"))
    return d.select(
        "doc_id",
        F.size("known").cast("long").alias("n_known"),
        F.array_join("known", ",").alias("sentence_ids"),
        F.array_join(F.array_distinct("state.found"), ",").alias("licenses"),
        F.array_join(left, ",").alias("unmatched"),
    )


def op6_license_scan(documents: DataFrame) -> DataFrame:
    """``license_scan`` of every row of ``documents``."""
    return license_scan(documents)


def _oracle() -> str:
    quoted = lambda x: x.replace("'", "''")
    cases = []
    narrower = " OR ".join(f"contains(' ' || s || ' ', ' {w} ')" for w in NARROWING)
    for name, begin, held in SENTENCES:
        tests = [f"starts_with(s, '{begin}')"] if begin else []
        if name in GRANTS:
            cases.append(f"WHEN starts_with(s, '{begin}') AND ({narrower}) THEN 'Restricted'")
        cases.append("WHEN " + " AND ".join([*tests, *(f"contains(s, '{part}')" for part in held)]) + f" THEN '{name}'")
    cases += [f"WHEN s = '{_spdx_sentence(name)}' THEN 'Spdx:{name}'" for name in SPDX]
    steps, last = [], "seq"
    for k, (_, sequence) in enumerate(RULES):
        pattern = _pattern(sequence)
        steps.append(f"r{k} AS (SELECT * EXCLUDE (rest), regexp_matches(rest, '{pattern}') AS hit_{k}, regexp_replace(rest, '{pattern}', ';-;', 'g') AS rest FROM {last})")
        last = f"r{k}"
    hits = ", ".join(f"CASE WHEN hit_{k} THEN '{n}' END" for k, (n, _) in enumerate(RULES))
    hints = " OR ".join(f"contains(lower(t), '{h}')" for h in HINTS)
    # a licence that two rules name stands at the first of them
    first = "list_filter(found, lambda x, i: list_position(found, x) = i)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents WHERE true),
bare AS (SELECT rid, doc_id, CASE WHEN {hints} THEN list_transform(string_split(t, chr(10)), lambda x:
          rtrim(regexp_replace(regexp_replace(replace(x, chr(13), ''), '{quoted(COMMENT)}', ''), '{quoted(ITEM)}', ''), ' ')) ELSE []::VARCHAR[] END AS ls FROM d),
joined AS (SELECT rid, doc_id, coalesce(array_to_string(list_transform(ls, lambda x: x || CASE WHEN length(x) >= {WRAPPED} AND right(x, 1) NOT IN ('.', '!', '?', ':', ';') THEN ' ' ELSE chr(10) END), ''), '') AS t FROM bare),
cut AS (SELECT rid, doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(t, '{quoted(SHORT)}', '\1\2 ', 'g'), '([.!?])["'')]*[ \t]+', '\1' || chr(10), 'g'), chr(10)),
          lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '') AS ss FROM joined),
ids AS (SELECT rid, doc_id, list_transform(ss, lambda s: CASE {" ".join(cases)} ELSE '-' END) AS ids FROM cut),
seq AS (SELECT rid, doc_id, list_filter(ids, lambda i: i <> '-') AS known, ';' || coalesce(array_to_string(ids, ';'), '') || ';' AS rest FROM ids),
{", ".join(steps)},
f AS (SELECT *, list_filter([{hits}], lambda x: x IS NOT NULL) AS found FROM {last})
SELECT doc_id, len(known)::BIGINT AS n_known, coalesce(array_to_string(known, ','), '') AS sentence_ids,
       coalesce(array_to_string({first}, ','), '') AS licenses,
       coalesce(array_to_string(list_filter(string_split(rest, ';'), lambda i: i NOT IN ('', '-')), ','), '') AS unmatched FROM f
"""


#: DuckDB SQL for op6_license_scan, from the same tables of sentences and rules; the tests hold both against licence texts.
OP6_SQL = _oracle()
