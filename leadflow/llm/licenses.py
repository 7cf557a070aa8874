"""Licence scans by sentence rules.

A text is cut into pieces at line breaks and marks, which are normalised (lower case, comment
marks and punctuation dropped, white space single).  A known licence sentence may be one piece
or several that follow each other, so hard-wrapped texts, comment blocks and sentences with ';'
or ':' inside are found; blank lines are not crossed, the longest sentence wins.  A sentence may
have a slot for an organisation's name (``{org}``).  An expression that names several licences (OR,
AND, "dual licensed under") gives all of them; WITH an exception gives the licence it widens.  Every
other piece with a licence word is a sentence of its own.  The sequence of identifiers found is then matched against ordered rules: a rule
names a licence and the identifiers that make it, in order; its match is taken out before the
next rule is tried, so a long licence text is recognised before its single sentences could be.
Identifiers no rule uses are left over, and sentences with a licence word that no entry knows
count as unknown: the document speaks of a licence that should be read by a person.

All steps are functions of one row: no shuffle, no group; the knowledge is a constant.

Cases: a null or empty text has no sentences.  Repeated rows are scanned each; null ids are
carried.  An empty table gives no rows.  Only the id and text columns are read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

#: A sentence is scanned further only if it holds one of these.
LICENSE_WORDS = (r"(?i)licen[sc]|copyright|warrant(y|ies)|redistribut|permission (is hereby|to use)|public domain"
                 r"|all rights reserved|free software|spdx|neither the name")
#: Sentences end at a line break, or at one of these marks followed by white space.
SENTENCE_MARK = r"([.!?;:])[\x20\x09-\x0D]+"

#: Names under which licences are referred to, after normalising.
NAMES = {
    "MIT": ("mit license", "mit licence", "expat license", "mit"),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0"),
    "GPL-2.0": ("gnu general public license version 2", "gnu gpl version 2", "gpl v2", "gplv2", "gnu gpl v2"),
    "GPL-3.0": ("gnu general public license version 3", "gnu gpl version 3", "gpl v3", "gplv3", "gnu gpl v3"),
    "LGPL-2.1": ("gnu lesser general public license version 2 1", "lgpl v2 1", "lgplv2 1"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "lgpl v3", "lgplv3"),
    "AGPL-3.0": ("gnu affero general public license version 3", "agpl v3", "agplv3"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license v 2 0", "mpl 2 0"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"),
    "EPL-2.0": ("eclipse public license version 2 0", "eclipse public license v2 0", "epl 2 0"),
    "ISC": ("isc license",),
    "Unlicense": ("unlicense",),
    "CC0-1.0": ("cc0 1 0", "cc0", "creative commons zero v1 0 universal"),
    **{f"CC-{k}-{v}.0": (f"cc {k.lower().replace('-', ' ')} {v} 0", f"creative commons {long} {v} 0",
                         f"creative commons {long} {v} 0 international license")
       for k, long in (("BY", "attribution"), ("BY-SA", "attribution sharealike"), ("BY-NC", "attribution noncommercial"),
                       ("BY-ND", "attribution noderivatives"), ("BY-NC-SA", "attribution noncommercial sharealike"),
                       ("BY-NC-ND", "attribution noncommercial noderivatives")) for v in (3, 4)},
}
#: What may stand before a name in a sentence that grants the licence.
GRANTS = ("licensed under", "released under", "distributed under", "available under", "this work is licensed under",
          "this project is licensed under", "this software is licensed under", "this file is licensed under",
          "this code is licensed under", "license", "spdx license identifier", "published under", "made available under",
          "this document is licensed under", "content licensed under", "licensed under the terms of",
          "this work is released under", "this software is released under", "provided under")
#: Sentences of licence texts and notices.
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the "
    "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
    "persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the software": "MitNotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement": "MitAsIs",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following "
    "disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
    "disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of {org} nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission": "BsdNames",
    "the name of the author may not be used to endorse or promote products derived from this software without specific "
    "prior written permission": "BsdNames",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
    "provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at": "ApacheCopy",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation either version 2 of the license or at your option any later "
    "version": "Gpl2Later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation either version 3 of the license or at your option any later "
    "version": "Gpl3Later",
    **{f"this {what} is free software you can redistribute it and or modify it under the terms of the gnu {kind} general "
       f"public license as published by the free software foundation either version {version} of the license or at your "
       "option any later version": id for what in ("library", "program", "file", "software") for kind, version, id in (
           ("lesser", "2 1", "Lgpl21Later"), ("lesser", "3", "Lgpl3Later"), ("affero", "3", "Agpl3Later"))},
    "this source code form is subject to the terms of the mozilla public license v 2 0": "Ref:MPL-2.0",
    "this is free and unencumbered software released into the public domain": "PublicDomain",
    "this work is in the public domain": "PublicDomain",
    "released into the public domain": "PublicDomain",
    "all rights reserved": "AllRights",
}
#: First half of the Apache notice, up to '; you may not use this file ...', and SPDX names.
HEADERS = {
    **{f"{start} apache license version 2 0 the license": "Ref:Apache-2.0" for start in (
        "licensed under the", "this file is licensed under the", "the asf licenses this file to you under the",
        "this project is licensed under the", "this software is licensed under the", "this code is licensed under the")},
    **{f"spdx license identifier {name}": id for id, names in {
        "Ref:GPL-2.0": ("gpl 2 0", "gpl 2 0 only"), "Gpl2Later": ("gpl 2 0 or later",),
        "Ref:GPL-3.0": ("gpl 3 0", "gpl 3 0 only"), "Gpl3Later": ("gpl 3 0 or later",),
        "Lgpl21Later": ("lgpl 2 1 or later",), "Lgpl3Later": ("lgpl 3 0 or later",), "Agpl3Later": ("agpl 3 0 or later",),
        "Ref:LGPL-2.1": ("lgpl 2 1", "lgpl 2 1 only"), "Ref:LGPL-3.0": ("lgpl 3 0", "lgpl 3 0 only"),
        "Ref:AGPL-3.0": ("agpl 3 0", "agpl 3 0 only"), "Ref:BSD-2-Clause": ("bsd 2 clause",),
        "Ref:BSD-3-Clause": ("bsd 3 clause",), "Ref:ISC": ("isc",)}.items() for name in names},
    # titles of whole licence texts, with their dates
    "apache license version 2 0 january 2004": "Ref:Apache-2.0", "gnu general public license version 2 june 1991": "Ref:GPL-2.0",
    "gnu general public license version 3 29 june 2007": "Ref:GPL-3.0",
    "gnu lesser general public license version 2 1 february 1999": "Ref:LGPL-2.1",
    "gnu lesser general public license version 3 29 june 2007": "Ref:LGPL-3.0",
    "gnu affero general public license version 3 19 november 2007": "Ref:AGPL-3.0",
}
SPDX = "spdx license identifier "
#: What may stand before several names, and how these are parted (before "later" an "or" is part of a name).
SEVERAL = ("dual licensed under", "licensed under either of", "licensed under either", "available under either of", "spdx license identifier")
_PARTED = r" (?:and or|or(?! later)|and)(?: (?:the|an|a))? "
_EXCEPTION = r" with(?: [\p{L}\p{N}]+){1,4}? exception(?: [0-9]+)*"
#: (licence, identifiers in order), tried in this order; Ref:X is a sentence that grants X by name.
RULES = (
    ("MIT", ("MitGrant", "MitNotice", "MitAsIs")), ("MIT", ("MitGrant", "MitNotice")), ("MIT", ("MitGrant",)),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdNames")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    ("ISC", ("IscGrant",)),
    ("Apache-2.0", ("Ref:Apache-2.0", "ApacheUse", "ApacheCopy")), ("Apache-2.0", ("Ref:Apache-2.0", "ApacheUse")),
    ("GPL-2.0-or-later", ("Gpl2Later",)), ("GPL-3.0-or-later", ("Gpl3Later",)),
    ("LGPL-2.1-or-later", ("Lgpl21Later",)), ("LGPL-3.0-or-later", ("Lgpl3Later",)), ("AGPL-3.0-or-later", ("Agpl3Later",)),
    *((name, (f"Ref:{name}",)) for name in NAMES),
    ("LicenseRef-public-domain", ("PublicDomain",)), ("LicenseRef-all-rights-reserved", ("AllRights",)),
)


def known_sentences() -> dict[str, str]:
    """Normalised sentence -> identifier: the texts above and every grant with every name."""
    out = {f"{grant}{the} {name}": f"Ref:{licence}" for licence, names in NAMES.items() for name in names
           for grant in GRANTS for the in ("", " the", " a", " an")}
    return out | SENTENCES


#: Ends a piece that has a licence word.
FLAG = "\x01"
_GAP = rf"(?:{FLAG}?\n| )"
#: An organisation's name: up to twelve words.
_ORG = rf"[\p{{L}}\p{{N}}]+(?:{_GAP}[\p{{L}}\p{{N}}]+){{0,11}}?"


def one_of(sentences) -> str:
    """A pattern of ``sentences`` as a tree of words, the longest first; between words a space or a new piece."""
    tree: dict = {}
    for s in sentences:
        at = tree
        for word in s.split():
            at = at.setdefault(word, {})
        at[""] = {}

    def pattern(node):
        ways = [(_ORG if word == "{org}" else word) + (_GAP + rest if (rest := pattern(below)) and "" not in below else f"(?:{_GAP}{rest})?" if rest else "")
                for word, below in sorted(node.items(), reverse=True) if word]
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})" if ways else ""

    return pattern(tree)


def spdx_names() -> list[str]:
    """Normalised names that may stand in an expression."""
    return [n for names in NAMES.values() for n in names] + [k.removeprefix(SPDX) for k in HEADERS if k.startswith(SPDX)]


def known_pattern() -> str:
    """Whole pieces, after a list mark or none, that make up a known sentence (group 1)."""
    wide = lambda x: x.replace(" ", _GAP)
    names = one_of(name for names in NAMES.values() for name in names)
    grant = f"{one_of(GRANTS)}{_GAP}(?:(?:the|an|a){_GAP})?{names}"
    one = f"{one_of(spdx_names())}(?:{_GAP}licen[sc]es?)?"
    with_exception = f"(?:{wide(_EXCEPTION)})"
    several = (f"{one_of(SEVERAL)}{_GAP}(?:(?:the|an|a){_GAP})?{one}{with_exception}?(?:{wide(_PARTED)}{one}{with_exception}?)+"
               f"|{wide(SPDX)}{one}{with_exception}")
    return rf"(?m)^(?:(?:[0-9]{{1,2}}|[a-h]|[iv]{{1,3}}) )?((?:{several}|{one_of(SENTENCES | HEADERS)}|{grant}){FLAG}?)$"


def canonical(sentence: Column) -> Column:
    """A known sentence with its slots empty."""
    return F.regexp_replace(sentence, r"^neither the name of .* nor the names of its contributors may be used",
                            "neither the name of {org} nor the names of its contributors may be used")


def identifiers(sentence: Column, table: Column) -> Column:
    """The identifiers of a known sentence: one, or one for each licence of an expression."""
    body = F.regexp_replace(sentence, f"^(?:{'|'.join(SEVERAL)})(?: (?:the|an|a))? ", "")
    parts = F.split(F.regexp_replace(body, _EXCEPTION, ""), _PARTED)
    named = F.transform(parts, lambda p: F.coalesce(F.try_element_at(table, F.concat(F.lit(SPDX), p)), F.try_element_at(
        table, F.concat(F.lit(SPDX), F.regexp_replace(p, " licen[sc]es?$", "")))))
    alone = F.try_element_at(table, canonical(sentence))
    return F.when(alone.isNotNull(), F.array(alone)).otherwise(F.array_compact(named))


def normalise(sentence: Column) -> Column:
    """Lower case; anything but letters and digits is one space."""
    return F.btrim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "))


def sentences(text: Column) -> Column:
    return F.split(F.regexp_replace(text, SENTENCE_MARK, "$1\n"), "\n", -1)


def apply_rules(ids: Column) -> Column:
    """struct(left, found): identifiers no rule used, as text, and the licences recognised."""
    rules = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit("".join(f"<{i}>" for i in seq)).alias("seq"))
                      for name, seq in RULES])
    start = F.struct(F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "").alias("left"),
                     F.array().cast("array<string>").alias("found"))

    def step(a, r):
        hit = F.contains(a["left"], r["seq"])
        return F.struct(F.when(hit, F.replace(a["left"], r["seq"], F.lit(""))).otherwise(a["left"]).alias("left"),
                        F.when(hit, F.array_append(a["found"], r["licence"])).otherwise(a["found"]).alias("found"))

    return F.aggregate(rules, start, step)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_sentences (with a licence word), sentence_ids (in order, joined by a space),
    licences (in order of the rules, each once, joined by a space), n_left (identifiers no rule
    used) and n_unknown (sentences that no entry knows)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    table = F.from_json(F.lit(json.dumps(HEADERS | known_sentences())), "map<string,string>")
    has_word = lambda s: F.regexp_like(s, F.lit(LICENSE_WORDS))
    may_hold = F.regexp_like(text, F.lit(LICENSE_WORDS.replace(" ", r"[^\p{L}\p{N}]+")))       # words may be wrapped
    flagged = lambda s: F.concat(normalise(s), F.when(has_word(s), FLAG).otherwise(""))
    plain = lambda m: F.translate(m, "\n" + FLAG, " ")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(
        may_hold, F.array_join(F.transform(sentences(text), flagged), "\n")).alias("s"))
    rows = rows.withColumn("found", F.filter(
        F.regexp_extract_all("s", F.lit(known_pattern()), F.lit(1)),
        lambda m: F.contains(m, F.lit(FLAG)) | (F.contains(m, F.lit("\n")) & has_word(plain(m)))))
    rows = rows.withColumn("known", F.flatten(F.transform("found", lambda m: identifiers(plain(m), table))))
    rows = rows.withColumn("unknown", F.regexp_count(F.regexp_replace("s", known_pattern(), ""), F.lit(FLAG)))
    rows = rows.withColumn("m", F.when(F.size("known") > 0, apply_rules(F.col("known"))))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select(
        "doc_id", number(F.size("found") + F.col("unknown")).alias("n_sentences"),
        F.coalesce(F.array_join("known", " "), F.lit("")).alias("sentence_ids"),
        F.coalesce(F.array_join(F.array_distinct("m.found"), " "), F.lit("")).alias("licences"),
        number(F.regexp_count("m.left", F.lit("<"))).alias("n_left"),
        number(F.col("unknown")).alias("n_unknown"))
