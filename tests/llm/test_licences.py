import re
import textwrap

import pytest

from guardlake.llm import licences

FULL = {
    "MIT": ["MitRef", "MitGrant", "MitNotice", "MitAsIs", "MitLiability"],
    "BSD-3-Clause": ["BsdGrant", "BsdSource", "BsdBinary", "BsdNames"],
    "BSD-2-Clause": ["BsdGrant", "BsdSource", "BsdBinary"],
    "Apache-2.0": ["ApacheLicensed", "ApacheCompliance", "ApacheCopy", "ApacheAsIs", "ApacheLimits"],
    "GPL-3.0-or-later": ["GplFree3", "GplHope", "GplDetails"],
}


def scanned(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.id: r for r in licences.scan(frame).collect()}


@pytest.mark.parametrize("width", [10_000, 72])
def test_whole_texts_plain_and_wrapped_in_comments(spark, width):
    texts, want = [], []
    for licence, names in FULL.items():
        said = [licences.SENTENCES[n][0] for n in names]
        body = "".join(x + (" " if x[-1] in ".:;" else "\n\n") for x in said)
        lines = [line for part in body.split("\n\n") for line in [*textwrap.wrap(part, width), ""]]
        texts += [body, "/*\n" + "\n".join(f" * {x}" for x in lines) + "\n */", "Some prose.\n\n" + "\n".join(lines) + "\n\nMore prose."]
        want += [licence] * 3
    found = scanned(spark, texts)
    assert [found[i].licences for i in range(len(texts))] == [[w] for w in want]
    assert all(r.n_unmatched == 0 for r in found.values())


def test_references_rules_in_order_and_leftovers(spark):
    found = scanned(spark, [
        "Onha the ed.*** \nReleased under the MIT License.\nMore", "Thst. Licensed under the Apache License, Version 2.0. Nd er.",
        "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0.", licences.SENTENCES["MitNotice"][0], "The mit License is good.", None, "",
    ])
    assert [found[i].licences for i in range(7)] == [["MIT"], ["Apache-2.0"], ["CC-BY-4.0", "CC-BY-NC-4.0"], [], [], [], []]
    assert [found[i].n_unmatched for i in range(7)] == [0, 0, 0, 1, 0, 0, 0]


def read(text, steps, known, rules):
    for pattern, by in steps:
        text = re.sub(pattern, by.replace("$", "\\"), text)
    sequence = re.sub(r"(<\?>)+", "<?>", "".join(f"<{known.get(s, '?')}>" for s in text.lower().strip(" \n").split("\n")))
    rest, found = sequence, []
    for licence, pattern in rules:
        if pattern in rest:
            rest = rest.replace(pattern, "<=>")
            found.append(licence)
    return len(re.findall(r"<[^?]", sequence)), sequence, found, len(re.findall(r"<[^=?]", rest))


def plain(text, known, rules):
    a, b = (read(text or "", steps, known, rules) for steps in (licences.BY_LINE, licences.JOINED))
    first, second = (b, a) if b[0] > a[0] else (a, b)
    return first[1], list(dict.fromkeys(first[2] + second[2])), first[3]


def test_matches_plain_version(spark, awkward, nothing, data):
    known, rules = licences.known_sentences(), licences.spelled_rules()
    for docs in (awkward, spark.read.parquet(f"{data}/documents.parquet")):
        want = sorted(((r.doc_id, *plain(r.text, known, rules)) for r in docs.collect()), key=str)
        got = sorted(((r.id, r.sentence_ids, r.licences, r.n_unmatched) for r in licences.scan(docs).collect()), key=str)
        assert got == want
    assert licences.scan(nothing).count() == 0


def test_stays_native(awkward):
    plan = licences.scan(awkward)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Pandas", plan)


BSD = """Copyright (c) 2020, Example Inc.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

{0} Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
{1} Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ADS = """{} All advertising materials mentioning features or use of this software
   must display the following acknowledgement:
   This product includes software developed by the Example project.
"""
NAMES = """{} Neither the name of {} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS".
"""
APACHE = """
   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""


def test_usual_texts_with_numbers_names_and_addresses(spark):
    texts, want = [], []
    for marks in (("1.", "2.", "3.", "4."), ("(a)", "(b)", "(c)", "(d)"), ("i)", "ii)", "iii)", "iv)"), ("*", "*", "*", "*"), ("", "", "", "")):
        body = BSD.format(*marks)
        for holder in ("the copyright holder", "Example Inc.", "the University of Somewhere and of Elsewhere"):
            texts.append(body + NAMES.format(marks[2], holder) + END)
            want.append("BSD-3-Clause")
        texts += [body + END, body + ADS.format(marks[2]) + NAMES.format(marks[3], "the Example project") + END]
        want += ["BSD-2-Clause", "BSD-4-Clause"]
    texts.append(APACHE)
    want.append("Apache-2.0")
    texts += ["/*\n" + "\n".join(f" * {line}".rstrip() for line in t.split("\n")) + "\n */" for t in texts]
    want *= 2
    texts += [" ".join(t.split()) for t, w in zip(texts, want) if w.startswith("BSD") and not t.startswith("/*")]
    want += [w for t, w in zip(texts, want) if w.startswith("BSD") and not t.startswith("/*")]
    found = scanned(spark, texts)
    assert [found[i].licences for i in range(len(texts))] == [[w] for w in want]
    assert all(r.n_unmatched == 0 for r in found.values())


def test_a_wrapped_version_number_is_no_list_number(spark):
    found = scanned(spark, [
        "Licensed under the GNU General Public License, version\n2. See COPYING.", "Licensed under the GNU General Public License, version\n3.",
    ])
    assert [found[i].licences for i in range(2)] == [["GPL-2.0-only"], ["GPL-3.0-only"]]


#: Written by hand, one line at least per licence the table knows.
EXPECTED = [
    ("SPDX-License-Identifier: MIT", "MIT"), ("// SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"),
    ("# SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"), ("SPDX-License-Identifier: BSD-4-Clause", "BSD-4-Clause"),
    ("/* SPDX-License-Identifier: Apache-2.0 */", "Apache-2.0"), ("SPDX-License-Identifier: GPL-2.0", "GPL-2.0-only"),
    ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0-only"), ("SPDX-License-Identifier: GPL-2.0+", "GPL-2.0-or-later"),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later"), ("SPDX-License-Identifier: GPL-3.0-only", "GPL-3.0-only"),
    ("SPDX-License-Identifier: GPL-3.0+", "GPL-3.0-or-later"), ("SPDX-License-Identifier: LGPL-2.1", "LGPL-2.1-only"),
    ("SPDX-License-Identifier: LGPL-2.1+", "LGPL-2.1-or-later"), ("SPDX-License-Identifier: LGPL-3.0-only", "LGPL-3.0-only"),
    ("SPDX-License-Identifier: LGPL-3.0-or-later", "LGPL-3.0-or-later"), ("SPDX-License-Identifier: AGPL-3.0-only", "AGPL-3.0-only"),
    ("SPDX-License-Identifier: AGPL-3.0-or-later", "AGPL-3.0-or-later"), ("SPDX-License-Identifier: MPL-2.0", "MPL-2.0"),
    ("SPDX-License-Identifier: EPL-2.0", "EPL-2.0"), ("SPDX-License-Identifier: BSL-1.0", "BSL-1.0"), ("SPDX-License-Identifier: ISC", "ISC"),
    ("SPDX-License-Identifier: Zlib", "Zlib"), ("SPDX-License-Identifier: CC-BY-4.0", "CC-BY-4.0"),
    ("SPDX-License-Identifier: CC-BY-SA-4.0", "CC-BY-SA-4.0"), ("SPDX-License-Identifier: CC-BY-NC-4.0", "CC-BY-NC-4.0"),
    ("SPDX-License-Identifier: CC-BY-ND-4.0", "CC-BY-ND-4.0"), ("SPDX-License-Identifier: CC-BY-NC-SA-4.0", "CC-BY-NC-SA-4.0"),
    ("SPDX-License-Identifier: CC0-1.0", "CC0-1.0"), ("SPDX-License-Identifier: Unlicense", "Unlicense"),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", "MIT OR Apache-2.0"),
    ("SPDX-License-Identifier: Proprietary", ""), ("SPDX-License-Identifier:", ""), ("SPDX-License-Identifier: LicenseRef-Own", ""),
    ("This project is licensed under the MIT License - see the LICENSE file for details", "MIT"),
    ("This project is licensed under the MIT License \u2014 see the [LICENSE.md](LICENSE.md) file for more details.\n\nMore.", "MIT"),
    ("The tool is licensed under the Apache License, Version 2.0 (see LICENSE).", "Apache-2.0"),
    ("Our code is made available under the terms of the BSD 3-Clause License.", "BSD-3-Clause"),
    ("licensed under the Creative Commons Attribution 4.0 International License", "CC-BY-4.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0\nInternational License.", "CC-BY-SA-4.0"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Released under CC0 1.0.", "CC0-1.0"), ("Released under GPLv3+.", "GPL-3.0-or-later"),
    ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"), ("Available under the ISC License", "ISC"),
    ("This program is not licensed under the MIT License.", ""), ("It was released under the MIT License.", ""),
    ("Licensed under the Own License 1.0.", ""), ("The mit is mightier. Identifier: MIT", ""),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that"
     " the above\ncopyright notice and this permission notice appear in all copies.", "ISC"),
    ("This program is free software: we like it.", ""), ("This is free and unencumbered software released into the public domain.", "Unlicense"),
]


def test_every_licence_by_hand(spark):
    found = scanned(spark, [t for t, _ in EXPECTED])
    assert [",".join(found[i].licences) for i in range(len(EXPECTED))] == [w for _, w in EXPECTED]
    told = {licence for licence, _ in licences.RULES}
    assert told - {w for _, w in EXPECTED} <= {"LicenseRef-all-rights-reserved"}


def test_one_sentence_stands_for_one_licence():
    with pytest.raises(ValueError):
        licences.known_sentences({"A": ("Same words.",), "B": ("same  words",)})
    known = licences.known_sentences({"A": ("Lead in; first.",), "B": ("Lead in; second.",)})
    assert known == {"lead in": "Shared+A.0", "first": "A+1", "second": "B+1"}
