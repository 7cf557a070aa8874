"""Licence scans: sentences, sequences and leftovers."""

import textwrap

from leadflow.llm.licenses import known_sentences, scan

SCHEMA = "doc_id long, text string, licences string, s string, ids string, known string, m string"

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
NAMES = """
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""


def test_scan(spark):
    rows = [(1, MIT), (2, BSD), (3, BSD + NAMES), (4, "Some words. Licensed under the Apache License, Version 2.0. More words."),
            (5, "# SPDX-License-Identifier: MIT\n// Licensed under CC BY-NC 4.0.\nReleased under the MIT License."),
            (6, "This licence is our own and nobody knows it."), (7, None), (8, ""), (9, "plain words " * 20_000),
            (10, "All rights reserved."), (10, "All rights reserved."), (None, "Released under the MIT License."),
            (11, "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
                 "disclaimer."),
            (12, "words " * 50_000 + "\nThis work is licensed under the GNU General Public License, version 3.")]
    df = spark.createDataFrame([(i, t, *"abcde") for i, t in rows], SCHEMA)
    out = {r.doc_id: r for r in scan(df).collect()}
    assert out[1].licences == "MIT" and out[1].sentence_ids == "MitGrant MitNotice MitAsIs" and out[1].n_left == 0
    assert out[2].licences == "BSD-2-Clause" and out[3].licences == "BSD-3-Clause"
    assert out[4].licences == "Apache-2.0" and out[4].n_sentences == 1
    assert out[5].licences == "MIT CC-BY-NC-4.0" and out[5].n_sentences == 3
    assert (out[6].licences, out[6].n_unknown) == ("", 1)
    assert [tuple(out[i])[1:] for i in (7, 8, 9)] == [(0, "", "", 0, 0)] * 3
    assert out[10].licences == "LicenseRef-all-rights-reserved" and out[None].licences == "MIT"
    assert (out[11].licences, out[11].n_left) == ("", 1) and out[12].licences == "GPL-3.0"
    assert scan(df).count() == len(rows)
    assert scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_known_sentences_are_normalised():
    assert all(s == " ".join(s.lower().split()) for s in known_sentences())


APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
GPL = """This program is free software{mark} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{mark2} either version {v} of the License, or (at your option) any later version."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""


def wrapped(text, width, mark="", item=""):
    return "\n".join(f"{mark}{line}".rstrip() for part in text.split("\n") for line in
                     (textwrap.wrap(part, width, initial_indent=item * part.startswith(("Redis", "Neither"))) or [""]))


def test_wrapped_canonical_texts(spark):
    gpl2, gpl3 = GPL.format(mark=";", mark2=";", v=2), GPL.format(mark=":", mark2=",", v=3)
    texts = [(MIT, "MIT"), (BSD, "BSD-2-Clause"), (BSD + NAMES, "BSD-3-Clause"), (APACHE, "Apache-2.0"),
             (gpl2, "GPL-2.0-or-later"), (gpl3, "GPL-3.0-or-later"), (ISC, "ISC")]
    rows, want = [], {}
    for text, licence in texts:
        for form in (text, wrapped(text, 75), wrapped(text, 30), wrapped(text, 72, "# ", "1. "), wrapped(text, 70, " * ", "* "),
                     wrapped(text, 60, "// ", "a) ").replace("\n", "\r\n"), "Copyright (c) 2020 A. Person\n\n" + wrapped(text, 75) + "\n\ncode"):
            want[len(rows)] = licence
            rows.append((len(rows), form, *"abcde"))
    for r in scan(spark.createDataFrame(rows, SCHEMA)).collect():
        assert (r.licences, r.n_left) == (want[r.doc_id], 0), rows[r.doc_id][1]


def test_sentences_with_marks_inside(spark):
    texts = {"SPDX-License-Identifier: MIT": "MIT", "License: MIT": "MIT", "/* SPDX-License-Identifier: GPL-2.0-or-later */": "GPL-2.0-or-later",
             "words here\nAll rights\n reserved.": "LicenseRef-all-rights-reserved", "Licensed under the\nMIT License.": "MIT",
             "This software is released under the\n\nMIT License.": "", "License: MIT or what you like": "",
             "prose without an end\nLicensed under CC BY-NC 4.0.\nmore": "CC-BY-NC-4.0"}
    df = spark.createDataFrame([(i, t, *"abcde") for i, t in enumerate(texts)], SCHEMA)
    out = {r.doc_id: r for r in scan(df).collect()}
    assert [out[i].licences for i in range(len(texts))] == list(texts.values())
    assert (out[0].n_sentences, out[0].n_unknown, out[6].n_unknown) == (1, 0, 1)


ORG = """Neither the name of {org} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
LESSER = """This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
TITLES = {"Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/": "Apache-2.0",
          "GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991": "GPL-2.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": "GPL-3.0",
          "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999": "LGPL-2.1", "GNU Affero General Public License\nVersion 3, 19 November 2007": "AGPL-3.0"}


def test_organisations_and_more_notices_when_wrapped(spark):
    texts = [(f"{BSD}\n{ORG.format(org=o)}", "BSD-3-Clause") for o in (
        "Example Inc.", "the University of California, Berkeley", "Google", "the <organization>", "the copyright holder", "Foo & Bar GmbH")]
    texts += [(LESSER.format(what="library", kind="Lesser", v="2.1"), "LGPL-2.1-or-later"),
              (LESSER.format(what="program", kind="Lesser", v="3"), "LGPL-3.0-or-later"),
              (LESSER.format(what="program", kind="Affero", v="3"), "AGPL-3.0-or-later"), (MPL, "MPL-2.0")]
    rows, want = [], {}
    for text, licence in texts:
        for form in (text, wrapped(text, 75), wrapped(text, 40), wrapped(text, 72, "# ", "1. "), wrapped(text, 70, " * ", "* ")):
            want[len(rows)] = licence
            rows.append((len(rows), form, *"abcde"))
    for title, licence in TITLES.items():
        want[len(rows)] = licence
        rows.append((len(rows), title, *"abcde"))
    for r in scan(spark.createDataFrame(rows, SCHEMA)).collect():
        assert (r.licences, r.n_left) == (want[r.doc_id], 0), rows[r.doc_id][1]


def test_expressions_name_all_their_licences(spark):
    texts = {"SPDX-License-Identifier: MIT OR Apache-2.0": "MIT Apache-2.0", "// SPDX-License-Identifier: (GPL-2.0-only OR BSD-3-Clause)": "GPL-2.0 BSD-3-Clause",
             "SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception": "Apache-2.0",
             "SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 AND MIT": "GPL-2.0-or-later MIT",
             "SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1-or-later",
             "Dual licensed under the MIT and GPL v3.": "GPL-3.0 MIT", "Dual licensed under the MIT License and the Apache License, Version 2.0.": "MIT Apache-2.0",
             "Licensed under either of Apache License, Version 2.0 or MIT license": "MIT Apache-2.0",
             "SPDX-License-Identifier: MIT OR something of ours": "", "Licensed under the terms of a licence with an exception": ""}
    df = spark.createDataFrame([(i, t, *"abcde") for i, t in enumerate(texts)], SCHEMA)
    out = {r.doc_id: r for r in scan(df).collect()}
    for i, (t, want) in enumerate(texts.items()):
        assert set(out[i].licences.split()) == set(want.split()), t
        assert (out[i].n_sentences, out[i].n_left) == (1, 0) and out[i].n_unknown == (not want), t
