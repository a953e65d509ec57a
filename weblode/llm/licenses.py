"""Licence scans by sentence rules, in DataFrame functions only.

A text is normalised (lower case, everything but letters, digits, dots and pluses inside words as one blank, comment marks with it) and marked where a
sentence can begin or end.  Sentences end at ``.``, ``!``, ``?`` and blank lines.  Line breaks, ``:`` and ``;`` are weaker marks: a known sentence may
begin or end there, and may run across them, so wrapped texts, texts in comments and notices on a line of their own are all found.  The longest known
sentence at a mark is taken.  The identifiers found, in order, form the document's sequence; text between them is skipped.  Ordered rules then consume it:
a rule is a run of identifiers, longer and stricter rules come first, and what one has consumed no later one sees.

A row never leaves its task: no shuffle, no collected group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Known licence sentences, normalised: identifier -> texts.  Fixed values.
SENTENCES: dict[str, tuple[str, ...]] = {
    "mitTitle": ("mit license", "the mit license", "the mit license mit"),
    "mitRef": ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "spdx license identifier mit"),
    "mitGrant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions",
    ),
    "mitNotice": (
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software",
    ),
    "asIs": (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ),
    "mitLiable": (
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with "
        "the software or the use or other dealings in the software",
    ),
    "apacheTitle": ("apache license version 2.0 january 2004 http apache.org licenses", "apache license version 2.0 january 2004"),
    "apacheRef": ("licensed under the apache license version 2.0", "released under the apache license version 2.0", "spdx license identifier apache 2.0"),
    "apacheAsf": ("licensed to the apache software foundation asf under one or more contributor license agreements",),
    "apacheGrant": (
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
        "the asf licenses this file to you under the apache license version 2.0 the license you may not use this file except in compliance with the license",
        "licensed under the apache license version 2.0 the license",
    ),
    "apacheComply": ("you may not use this file except in compliance with the license",),
    "apacheCopy": ("you may obtain a copy of the license at http apache.org licenses license 2.0",),
    "apacheObtain": ("you may obtain a copy of the license at",),
    "apacheUrl": ("http apache.org licenses license 2.0",),
    "apacheBasis": (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    "apacheSee": ("see the license for the specific language governing permissions and limitations under the license",),
    "gpl3Title": ("gnu general public license version 3 29 june 2007",),
    "gpl3Ref": (
        "this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3",
        "spdx license identifier gpl 3.0 only", "spdx license identifier gpl 3.0 or later",
    ),
    "gpl2Title": ("gnu general public license version 2 june 1991",),
    "gpl2Ref": (
        "this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "spdx license identifier gpl 2.0 only",
        "spdx license identifier gpl 2.0",
    ),
    "gplFree": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or "
        "at your option any later version",
    ),
    "gpl2Free": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or "
        "at your option any later version",
    ),
    "gpl2Only": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2",
    ),
    "gplHope": (
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
        "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    ),
    "gplSee": ("see the gnu general public license for more details",),
    "gplCopy": (
        "you should have received a copy of the gnu general public license along with this program",
        "you should have received a copy of the gnu lesser general public license along with this program",
        "you should have received a copy of the gnu lesser general public license along with this library",
        "you should have received a copy of the gnu affero general public license along with this program",
    ),
    "gplUrl": ("if not see http gnu.org licenses",),
    "lgplTitle": ("gnu lesser general public license version 3 29 june 2007",),
    "lgpl21Title": ("gnu lesser general public license version 2.1 february 1999",),
    "lgplRef": ("licensed under the gnu lesser general public license version 3", "spdx license identifier lgpl 3.0 only", "spdx license identifier lgpl 3.0 or later"),
    "lgpl21Ref": ("licensed under the gnu lesser general public license version 2.1", "spdx license identifier lgpl 2.1 only", "spdx license identifier lgpl 2.1 or later"),
    "lgplFree": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the "
        "license or at your option any later version",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the "
        "license or at your option any later version",
    ),
    "lgpl21Free": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the "
        "license or at your option any later version",
    ),
    "lgplSee": ("see the gnu lesser general public license for more details",),
    "agplTitle": ("gnu affero general public license version 3 19 november 2007",),
    "agplRef": ("licensed under the gnu affero general public license version 3", "spdx license identifier agpl 3.0 only", "spdx license identifier agpl 3.0 or later"),
    "agplFree": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the "
        "license or at your option any later version",
    ),
    "agplSee": ("see the gnu affero general public license for more details",),
    "mplTitle": ("mozilla public license version 2.0",),
    "mplRef": ("licensed under the mozilla public license version 2.0", "spdx license identifier mpl 2.0"),
    # The dot of "v." ends a sentence; the version comes with the address.
    "mplForm": ("this source code form is subject to the terms of the mozilla public license v",),
    "mplCopy": ("if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0",),
    "eplTitle": ("eclipse public license v 2.0", "spdx license identifier epl 2.0"),
    "bsdGrant": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsdSource": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsdBinary": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    "bsdNames": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "bsdAsIs": (
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness "
        "for a particular purpose are disclaimed",
    ),
    "bsdLiable": (
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute "
        "goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
        "arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    "bsd2Ref": ("licensed under the bsd 2 clause license", "spdx license identifier bsd 2 clause"),
    "bsd3Ref": ("licensed under the bsd 3 clause license", "spdx license identifier bsd 3 clause"),
    "iscTitle": ("isc license", "the isc license"),
    "iscGrant": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "iscRef": ("licensed under the isc license", "spdx license identifier isc"),
    "zlibGrant": (
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    ),
    "boostGrant": ("distributed under the boost software license version 1.0", "boost software license version 1.0 august 17th 2003", "spdx license identifier bsl 1.0"),
    "ccByNc": ("licensed under cc by nc 4.0", "this work is licensed under cc by nc 4.0", "spdx license identifier cc by nc 4.0"),
    "ccBySa": (
        "licensed under cc by sa 4.0", "this work is licensed under cc by sa 4.0", "spdx license identifier cc by sa 4.0",
        "this work is licensed under a creative commons attribution sharealike 4.0 international license",
    ),
    "ccBy": (
        "licensed under cc by 4.0", "this work is licensed under cc by 4.0", "spdx license identifier cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license",
    ),
    "cc0": ("dedicated to the public domain under cc0 1.0", "spdx license identifier cc0 1.0", "creative commons legal code cc0 1.0 universal", "cc0 1.0 universal"),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "unlicenseFree": (
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    "allRights": ("all rights reserved",),
}

#: Ordered rules: licence, run of identifiers.  Earlier rules consume first.  Fixed values.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mitTitle", "mitGrant", "mitNotice", "asIs", "mitLiable")),
    ("MIT", ("mitTitle", "mitGrant", "mitNotice", "asIs")),
    ("MIT", ("mitGrant", "mitNotice", "asIs", "mitLiable")),
    ("MIT", ("mitGrant", "mitNotice", "asIs")),
    ("MIT", ("mitGrant", "mitNotice")),
    ("BSD-3-Clause", ("allRights", "bsdGrant", "bsdSource", "bsdBinary", "bsdNames", "bsdAsIs", "bsdLiable")),
    ("BSD-3-Clause", ("bsdGrant", "bsdSource", "bsdBinary", "bsdNames", "bsdAsIs", "bsdLiable")),
    ("BSD-3-Clause", ("allRights", "bsdGrant", "bsdSource", "bsdBinary", "bsdNames")),
    ("BSD-3-Clause", ("bsdGrant", "bsdSource", "bsdBinary", "bsdNames")),
    ("BSD-2-Clause", ("allRights", "bsdGrant", "bsdSource", "bsdBinary", "bsdAsIs", "bsdLiable")),
    ("BSD-2-Clause", ("bsdGrant", "bsdSource", "bsdBinary", "bsdAsIs", "bsdLiable")),
    ("BSD-2-Clause", ("allRights", "bsdGrant", "bsdSource", "bsdBinary")),
    ("BSD-2-Clause", ("bsdGrant", "bsdSource", "bsdBinary")),
    # A whole Apache or GPL text ends with the notice that it asks for.
    ("Apache-2.0", ("apacheTitle", "apacheGrant", "apacheObtain", "apacheUrl", "apacheBasis", "apacheSee")),
    ("Apache-2.0", ("apacheAsf", "apacheSee", "apacheGrant", "apacheObtain", "apacheUrl", "apacheBasis", "apacheSee")),
    ("Apache-2.0", ("apacheAsf", "apacheGrant", "apacheObtain", "apacheUrl", "apacheBasis", "apacheSee")),
    ("Apache-2.0", ("apacheAsf", "apacheGrant", "apacheCopy", "apacheBasis", "apacheSee")),
    ("Apache-2.0", ("apacheGrant", "apacheObtain", "apacheUrl", "apacheBasis", "apacheSee")),
    ("Apache-2.0", ("apacheGrant", "apacheCopy", "apacheBasis", "apacheSee")),
    ("Apache-2.0", ("apacheGrant", "apacheComply", "apacheCopy")),
    ("Apache-2.0", ("apacheGrant", "apacheObtain", "apacheUrl")),
    ("Apache-2.0", ("apacheGrant", "apacheCopy")),
    ("Apache-2.0", ("apacheComply", "apacheCopy")),
    ("Apache-2.0", ("apacheGrant",)),
    ("Apache-2.0", ("apacheTitle",)),
    ("Apache-2.0", ("apacheRef",)),
    ("GPL-3.0", ("gpl3Title", "gplFree", "gplHope", "gplSee", "gplCopy", "gplUrl")),
    ("GPL-3.0-or-later", ("gplFree", "gplHope", "gplSee", "gplCopy", "gplUrl")),
    ("GPL-3.0-or-later", ("gplFree", "gplHope", "gplSee", "gplCopy")),
    ("GPL-3.0-or-later", ("gplFree", "gplHope", "gplSee")),
    ("GPL-2.0", ("gpl2Title", "gpl2Free", "gplHope", "gplSee", "gplCopy")),
    ("GPL-2.0-or-later", ("gpl2Free", "gplHope", "gplSee", "gplCopy", "gplUrl")),
    ("GPL-2.0-or-later", ("gpl2Free", "gplHope", "gplSee", "gplCopy")),
    ("GPL-2.0-or-later", ("gpl2Free", "gplHope", "gplSee")),
    ("GPL-2.0", ("gpl2Only", "gplHope", "gplSee")),
    ("AGPL-3.0", ("agplTitle", "agplFree", "gplHope", "agplSee", "gplCopy", "gplUrl")),
    ("AGPL-3.0-or-later", ("agplFree", "gplHope", "agplSee", "gplCopy", "gplUrl")),
    ("AGPL-3.0-or-later", ("agplFree", "gplHope", "agplSee")),
    ("LGPL-3.0-or-later", ("lgplFree", "gplHope", "lgplSee", "gplCopy", "gplUrl")),
    ("LGPL-3.0-or-later", ("lgplFree", "gplHope", "lgplSee")),
    ("LGPL-2.1", ("lgpl21Title", "lgpl21Free", "gplHope", "lgplSee", "gplCopy")),
    ("LGPL-2.1-or-later", ("lgpl21Free", "gplHope", "lgplSee", "gplCopy", "gplUrl")),
    ("LGPL-2.1-or-later", ("lgpl21Free", "gplHope", "lgplSee", "gplCopy")),
    ("LGPL-2.1-or-later", ("lgpl21Free", "gplHope", "lgplSee")),
    ("GPL-3.0-or-later", ("gplFree",)),
    ("GPL-2.0-or-later", ("gpl2Free",)),
    ("GPL-2.0", ("gpl2Only",)),
    ("AGPL-3.0-or-later", ("agplFree",)),
    ("LGPL-3.0-or-later", ("lgplFree",)),
    ("LGPL-2.1-or-later", ("lgpl21Free",)),
    ("GPL-3.0", ("gpl3Title",)),
    ("GPL-3.0", ("gpl3Ref",)),
    ("GPL-2.0", ("gpl2Title",)),
    ("GPL-2.0", ("gpl2Ref",)),
    ("AGPL-3.0", ("agplTitle",)),
    ("AGPL-3.0", ("agplRef",)),
    ("LGPL-3.0", ("lgplTitle",)),
    ("LGPL-3.0", ("lgplRef",)),
    ("LGPL-2.1", ("lgpl21Title",)),
    ("LGPL-2.1", ("lgpl21Ref",)),
    ("MPL-2.0", ("mplTitle", "mplForm", "mplCopy")),
    ("MPL-2.0", ("mplForm", "mplCopy")),
    ("MPL-2.0", ("mplTitle",)),
    ("MPL-2.0", ("mplRef",)),
    ("EPL-2.0", ("eplTitle",)),
    ("ISC", ("iscTitle", "iscGrant")),
    ("ISC", ("iscGrant",)),
    ("ISC", ("iscTitle",)),
    ("ISC", ("iscRef",)),
    ("BSD-2-Clause", ("bsd2Ref",)),
    ("BSD-3-Clause", ("bsd3Ref",)),
    ("MIT", ("mitTitle",)),
    ("MIT", ("mitRef",)),
    ("Zlib", ("zlibGrant",)),
    ("BSL-1.0", ("boostGrant",)),
    ("CC-BY-NC-4.0", ("ccByNc",)),
    ("CC-BY-SA-4.0", ("ccBySa",)),
    ("CC-BY-4.0", ("ccBy",)),
    ("CC0-1.0", ("cc0",)),
    ("Unlicense", ("unlicense", "unlicenseFree")),
    ("Unlicense", ("unlicense",)),
    ("All-Rights-Reserved", ("allRights",)),
)

#: How a text is marked, step by step: pattern, replacement.  The text is lower case, so H (here a sentence ends) and S (here one may) are free.
#: No pattern goes over a run of blanks or marks more than once.
MARKS: tuple[tuple[str, str], ...] = (
    (r"https?://(www\.)?", "http "),
    (r"[.!?][ \t\r\n]+", "H"),
    (r"[;:]([ \t\r\n])", "S{1}"),
    (r"[^a-z0-9.+\nHS]+", " "),
    (r"\.+([ \n]|$)", "{1}"),
    (r"  +", " "),
    (r"\n[ \n]*\n", "H"),
    (r"\n", "S"),
    (r" ?S[ S]*", "S"),
    (r"S? ?H[ HS]*", "]\n["),
    (r"S", "]["),
)
#: Sentences that speak of licences though no rule knows them.
HINT = r"licen[cs]|copyright|warrant|public domain"


def known() -> dict[str, str]:
    return {text: name for name, texts in SENTENCES.items() for text in texts}


def pattern() -> str:
    """Any known sentence between two marks, the longest first; weak marks may stand inside."""
    texts = sorted(known(), key=lambda t: (-len(t), t))
    return r"\[(?:" + "|".join(t.replace(".", r"\.").replace("+", r"\+").replace(" ", r"(?: |\]\[)") for t in texts) + r")\]"


def marked(text: Column) -> Column:
    """The normalised text, every piece in brackets, a line break where a sentence ends."""
    out = F.lower(text)
    for what, into in MARKS:
        out = F.regexp_replace(out, what, into.replace("{1}", "$1"))
    return F.concat(F.lit("["), F.trim(out), F.lit("]"))


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_sentences, sentence_ids (identifiers in order, joined by commas), licenses (found licences in
    order of the rules, joined by commas), n_unmatched (identifiers that no rule consumed), n_hints (sentences that, beside known ones, speak of licences).

    Null and empty texts have no sentences and empty strings.  Null ids stay, repeated rows come out repeated, an empty table gives no rows, other
    columns are ignored.
    """
    names = F.create_map(*[F.lit(x) for pair in known().items() for x in pair])
    # Inside a one-element array the marked text is worked out once, however often it is used.
    one = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))
    plain = lambda x: F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit("]["), F.lit(" "))
    count = lambda x, what: F.size(F.filter(F.split(x, "\n"), lambda line: line.rlike(what))).cast("long")
    parts = one(
        marked(F.coalesce("text", F.lit(""))),
        lambda m: F.struct(
            count(m, "[a-z0-9+.]").alias("n_sentences"),
            F.transform(F.regexp_extract_all(m, F.lit(pattern()), F.lit(0)), lambda x: F.element_at(names, plain(x))).alias("ids"),
            count(F.regexp_replace(m, pattern(), ""), HINT).alias("n_hints"),
        ),
    )
    s = docs.select("doc_id", F.inline(F.array(parts)))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{x}>" for x in run)).alias("run")) for name, run in RULES])
    start = F.struct(F.concat(F.lit("<"), F.concat_ws("><", "ids"), F.lit(">")).alias("rest"), F.array().cast("array<string>").alias("hits"))

    def consume(state: Column, rule: Column) -> Column:
        hit = F.contains(state["rest"], rule["run"])
        hits = F.when(hit, F.array_append(state["hits"], rule["name"])).otherwise(state["hits"])
        return F.struct(F.replace(state["rest"], rule["run"], F.lit("")).alias("rest"), hits.alias("hits"))

    done = F.when(F.size("ids") > 0, F.aggregate(rules, start, consume))
    s = s.withColumn("done", done)
    rest = F.coalesce("done.rest", F.lit(""))
    return s.select(
        "doc_id", "n_sentences", F.concat_ws(",", "ids").alias("sentence_ids"), F.concat_ws(",", F.array_distinct("done.hits")).alias("licenses"),
        (F.length(rest) - F.length(F.replace(rest, F.lit("<"), F.lit("")))).cast("long").alias("n_unmatched"), "n_hints",
    )


def sql() -> str:
    """The same for DuckDB."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    names = ", ".join(f"({quote(t)}, {quote(n)})" for t, n in known().items())
    text = "lower(coalesce(text, ''))"
    for what, into in MARKS:
        text = f"regexp_replace({text}, {quote(what)}, {quote(into.replace('{1}', chr(92) + '1'))}, 'g')"
    steps, left = [], "l0"
    for i, (_, run) in enumerate(RULES):
        ids = quote("".join(f"<{x}>" for x in run))
        steps.append(f"r{i} as (select *, contains(l{i}, {ids}) as h{i}, replace(l{i}, {ids}, '') as l{i + 1} from {'base' if i == 0 else f'r{i - 1}'})")
        left = f"l{i + 1}"
    first = ", ".join(f"case when {' or '.join(f'h{j}' for j in range(i + 1) if RULES[j][0] == name)} then {quote(name)} end" for i, (name, _) in enumerate(RULES))
    return f"""
with names(sentence, name) as (values {names}),
m as (select map(list(sentence), list(name)) as known from names),
marked as (select doc_id, '[' || trim({text}) || ']' as t from documents),
cut as (
  select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[a-z0-9+.]')) as s,
    regexp_extract_all(t, {quote(pattern())}) as hits, string_split(regexp_replace(t, {quote(pattern())}, '', 'g'), chr(10)) as others
  from marked),
ids as (
  select doc_id, s, list_transform(hits, lambda x: list_extract(map_extract(known, replace(substr(x, 2, length(x) - 2), '][', ' ')), 1)) as found,
    len(list_filter(others, lambda x: regexp_matches(x, {quote(HINT)}))) as n_hints
  from cut, m),
base as (select *, '<' || array_to_string(found, '><') || '>' as l0 from ids),
{", ".join(steps)}
select doc_id, len(s) as n_sentences, array_to_string(found, ',') as sentence_ids,
  array_to_string(list_distinct_in_order, ',') as licenses,
  case when len(found) = 0 then 0 else length({left}) - length(replace({left}, '<', '')) end as n_unmatched, n_hints
from (select *, list_filter(all_, lambda x, i: x is not null and list_position(all_, x) = i) as list_distinct_in_order
  from (select *, [{first}] as all_ from r{len(RULES) - 1}))
"""
