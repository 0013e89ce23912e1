"""Licence recognition by sentences and ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Sentences of well-known licences, and what each stands for.
SENTENCES: dict[str, tuple[str, ...]] = {
    "MitGrant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation"
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and"
        " to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "MitNotice": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of"
        " the Software.",
    ),
    "MitAsIs": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO"
        " THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    "MitLiability": (
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN"
        " AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR"
        " OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "MitRef": ("The MIT License (MIT)", "MIT License", "The MIT License"),
    "BsdGrant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met:",
    ),
    "BsdSource": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following"
        " disclaimer.",
    ),
    "BsdBinary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following"
        " disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "BsdNames": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
        " derived from this software without specific prior written permission.",
        "The name of the author may not be used to endorse or promote products derived from this software without specific"
        " prior written permission.",
    ),
    "BsdAds": (
        "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    ),
    "ApacheLicensed": (
        "Licensed under the Apache License, Version 2.0 (the \"License\");",
    ),
    "ApacheCompliance": ("you may not use this file except in compliance with the License.",),
    "ApacheCopy": (
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    ),
    "ApacheAsIs": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on"
        " an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "ApacheLimits": (
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GplFree2": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later"
        " version.",
    ),
    "GplFree3": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later"
        " version.",
    ),
    "GplHope": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"
        " without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    "GplDetails": ("See the GNU General Public License for more details.",),
    "MplRef": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "IscGrant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "IscRef": ("ISC License",),
    "UnlicenseFree": ("This is free and unencumbered software released into the public domain.",),
    "AllRights": ("All rights reserved.",),
}
#: Sentences that only refer to a licence, by the identifier of the sentence, the licence and the names it
#: goes by behind "licensed under" or, the first one, as an SPDX identifier.
REFERENCES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("MitRef", "MIT", ("MIT", "MIT License")),
    ("BsdRef2", "BSD-2-Clause", ("BSD-2-Clause", "BSD 2-Clause License", "Simplified BSD License")),
    ("BsdRef3", "BSD-3-Clause", ("BSD-3-Clause", "BSD 3-Clause License", "New BSD License")),
    ("BsdRef4", "BSD-4-Clause", ("BSD-4-Clause", "BSD 4-Clause License")),
    ("ApacheLicensed", "Apache-2.0", ("Apache-2.0", "Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache License v2.0")),
    ("Gpl2Ref", "GPL-2.0-only", ("GPL-2.0-only", "GPL-2.0", "GNU General Public License, version 2", "GNU GPL v2", "GPLv2")),
    ("Gpl2LaterRef", "GPL-2.0-or-later", ("GPL-2.0-or-later", "GNU General Public License, version 2 or later", "GPLv2+")),
    ("Gpl3Ref", "GPL-3.0-only", ("GPL-3.0-only", "GPL-3.0", "GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3")),
    ("Gpl3LaterRef", "GPL-3.0-or-later", ("GPL-3.0-or-later", "GNU General Public License, version 3 or later", "GPLv3+")),
    ("Lgpl21Ref", "LGPL-2.1-only", ("LGPL-2.1-only", "LGPL-2.1", "GNU Lesser General Public License, version 2.1", "LGPLv2.1")),
    ("Lgpl21LaterRef", "LGPL-2.1-or-later", ("LGPL-2.1-or-later",)),
    ("LgplRef", "LGPL-3.0-only", ("LGPL-3.0-only", "LGPL-3.0", "GNU Lesser General Public License, version 3", "LGPLv3")),
    ("LgplLaterRef", "LGPL-3.0-or-later", ("LGPL-3.0-or-later",)),
    ("AgplRef", "AGPL-3.0-only", ("AGPL-3.0-only", "AGPL-3.0", "GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3")),
    ("AgplLaterRef", "AGPL-3.0-or-later", ("AGPL-3.0-or-later",)),
    ("MplRef", "MPL-2.0", ("MPL-2.0", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0")),
    ("EplRef", "EPL-2.0", ("EPL-2.0", "Eclipse Public License 2.0", "Eclipse Public License, version 2.0")),
    ("BoostRef", "BSL-1.0", ("BSL-1.0", "Boost Software License 1.0", "Boost Software License, Version 1.0")),
    ("IscRef", "ISC", ("ISC", "ISC License")),
    ("ZlibRef", "Zlib", ("Zlib", "zlib License")),
    ("CcByRef", "CC-BY-4.0", ("CC-BY-4.0", "CC BY 4.0 License", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 International")),
    ("CcBySaRef", "CC-BY-SA-4.0", ("CC-BY-SA-4.0", "CC BY-SA 4.0 License", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0 International")),
    ("CcByNcRef", "CC-BY-NC-4.0", ("CC-BY-NC-4.0", "CC BY-NC 4.0 License", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0 International")),
    ("CcByNdRef", "CC-BY-ND-4.0", ("CC-BY-ND-4.0", "CC BY-ND 4.0 License", "Creative Commons Attribution-NoDerivatives 4.0 International License")),
    ("CcByNcSaRef", "CC-BY-NC-SA-4.0", ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0 License", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License")),
    ("Cc0Ref", "CC0-1.0", ("CC0-1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal")),
    ("UnlicenseFree", "Unlicense", ("Unlicense", "The Unlicense")),
    ("MitOrApacheRef", "MIT OR Apache-2.0", ("MIT OR Apache-2.0", "Apache-2.0 OR MIT")),
)
for _name, _, _called in REFERENCES:
    SENTENCES[_name] = SENTENCES.get(_name, ()) + tuple(f"{x} {c}" for x in ("SPDX-License-Identifier:", "Licensed under") for c in _called)
#: The rules in the order they are tried; what a rule has matched is not matched again.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("MitRef", "MitGrant", "MitNotice", "MitAsIs", "MitLiability")),
    ("MIT", ("MitGrant", "MitNotice", "MitAsIs", "MitLiability")),
    ("MIT", ("MitGrant", "MitNotice", "MitAsIs")),
    ("BSD-4-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdAds", "?", "BsdNames")),
    ("BSD-4-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdAds")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdNames")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    ("Apache-2.0", ("ApacheLicensed", "ApacheCompliance", "ApacheCopy", "ApacheAsIs", "ApacheLimits")),
    ("Apache-2.0", ("ApacheLicensed", "ApacheCompliance", "ApacheCopy")),
    ("GPL-2.0-or-later", ("GplFree2", "GplHope", "GplDetails")),
    ("GPL-3.0-or-later", ("GplFree3", "GplHope", "GplDetails")),
    ("GPL-2.0-or-later", ("GplFree2",)), ("GPL-3.0-or-later", ("GplFree3",)),
    ("ISC", ("IscRef", "IscGrant")), ("ISC", ("IscGrant",)),
    *((licence, (name,)) for name, licence, _ in REFERENCES),
    ("LicenseRef-all-rights-reserved", ("AllRights",)),
)
#: How a text is cut into normal sentences: patterns and what replaces them, applied in this order. Ends of sentences
#: become a control sign. One reading breaks at every line, the other joins wrapped lines up to a blank one.
_BARE = ("[ \\t\\r\\f]*\\n[ \\t\\r\\f#*/;%]*", "\n")
_ENDS = ("([.!?;:])[ \\t\\n]+", "$1\u0001")
_LETTERS = (("[^A-Za-z0-9\\n\u0001]+", " "), (" ?[\\n\u0001][ \\n\u0001]*", "\n"))
#: An address on a line of its own belongs to the words before it.
_ADDRESS = ("(?i:copy[ \\t\\n]+of[ \\t\\n]+the[ \\t\\n]+License[ \\t\\n]+at)[ \\t\\n]+<?((?i:https?)://)", "copy of the License at $1")


def _holder(blank: str, other: str) -> tuple[str, str]:
    """Whoever the name clause of a BSD text names becomes the copyright holder."""
    words = f"neither the names? of {other}{{1,200}}? nor the names? of {other}{{1,100}}? may be used to endorse"
    by = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse"
    return "(?i:" + words.replace(" ", blank) + ")", by


def _numbers(before: str, junk: str) -> tuple[str, str]:
    """Numbers and letters of list items, like ``1.``, ``(a)`` or ``iv)``. To be applied behind ``_ENDS``."""
    return f"({before}){junk}*(?:[0-9]{{1,2}}|[A-Za-z]|[ivxIVX]{{2,4}})[.):*\\]]+[ \\t\u0001]+", "$1"


def _references(blank: str) -> tuple[tuple[str, str], ...]:
    """SPDX lines become one sentence, as do the ways to say that something is licensed under a licence.

    What was or is not licensed so is told from what is, and where a README sends its reader for details is left out."""
    under = "(?:licensed|released|distributed|made_available|available)_under_"
    steps = (
        ("(?i:SPDX-License-Identifier~:~)", "\u0001SPDX-License-Identifier "),
        ("(?i:([AL]?GPL(?:-|v)[0-9.]+)\\+)", "$1-or-later"),
        ("(?i:(not|never|previously|formerly|longer|was|were|been)_(licensed|released|distributed|available)_under)", "$1 $2 beneath"),
        (f"(?i:(?:(?:this|the)_[a-z]{{2,12}}_is_(?:free_and_)?)?{under}(?:the_terms_of_)?(?:(?:the|an?)_)?)", "\u0001licensed under "),
        (
            "(?i:,?~(?:-|\u2013|\u2014)*~\\(?see_(?:the_)?(?:file_)?[\\[`]?(?:LICEN[SC]E|COPYING)[^ \\t\\n]*"
            "(?:_files?)?(?:_for_(?:more_|full_|further_)?(?:details|information))?\\)?)", "",
        ),
    )
    return tuple((pattern.replace("~", f"{blank}*").replace("_", f"{blank}+"), by) for pattern, by in steps)


BY_LINE: tuple[tuple[str, str], ...] = (
    _BARE, *_references("[ \t]"), _ADDRESS, _holder("[ \\t]+", "[^\\n]"), _ENDS, _numbers("^|[\\n\u0001]", "[^A-Za-z0-9\\n\u0001]"), *_LETTERS,
)
#: A number that begins a wrapped line may end its sentence ("version", "2."), so here it counts behind an end only.
JOINED: tuple[tuple[str, str], ...] = (
    _BARE, *_references("[ \t\n]"), _ADDRESS, ("\\n\\n+", "\u0001"), _holder("[ \\t\\n]+", "[^\u0001]"), _ENDS, _numbers("^|\u0001", "[^A-Za-z0-9\u0001]"),
    ("\\n", " "), *_LETTERS,
)
#: Pieces that a known sentence itself is cut into are put together again by this rule of the table.
GAP = "?"


def _plain(sentence: str) -> list[str]:
    """A known sentence as the pieces that ``sentences`` cuts it into."""
    import re

    for pattern, by in JOINED:
        sentence = re.sub(pattern, by.replace("$", "\\"), sentence)
    return [s for s in sentence.lower().strip(" \n").split("\n") if s]


def known_sentences(table: dict[str, tuple[str, ...]] | None = None) -> dict[str, str]:
    """Normal sentence to identifier.

    Pieces of a sentence that is cut in several get numbered identifiers of their own, and a piece that sentences of
    several identifiers share has one that none of them is known by: only whole sentences are an identifier.
    """
    found: dict[str, str] = {}
    for name, variants in (table or SENTENCES).items():
        for variant in variants:
            pieces = _plain(variant)
            for i, piece in enumerate(pieces):
                own = name if len(pieces) == 1 else f"{name}+{i}"
                held = found.setdefault(piece, own)
                if held.split("+")[0] != name:
                    if len(pieces) == 1 and "+" not in held:
                        raise ValueError(f"{variant!r} stands for {held} and {name}")
                    found[piece] = held if held.startswith("Shared+") else f"Shared+{held.replace('+', '.')}"
    return found


def spelled_rules(table: dict[str, tuple[str, ...]] | None = None, rules=None) -> list[tuple[str, str]]:
    """The rules as ``(licence, pattern)`` over sequences like ``<MitGrant><MitNotice>``; every spelling of a sentence counts.

    ``GAP`` among the names of a rule stands for unknown sentences."""
    known = known_sentences(table)
    spellings = {
        name: list(dict.fromkeys("".join(f"<{known[p]}>" for p in _plain(v)) for v in variants))
        for name, variants in (table or SENTENCES).items()
    }
    spellings[GAP] = [f"<{GAP}>"]
    out: list[tuple[str, str]] = []
    for licence, names in rules or RULES:
        patterns = [""]
        for name in names:
            patterns = [p + s for p in patterns for s in spellings[name]]
        out += [(licence, p) for p in sorted(set(patterns), key=lambda p: (-len(p), p))]
    return out


#: A text without any of these, in lower case, says nothing that the steps of references change for known sentences.
MENTIONS = "licen|spdx|released|distributed|available"


def sentences(text: Column, steps: tuple[tuple[str, str], ...], mentioned: Column | None = None) -> Column:
    """The sentences of a text in lower case, letters and digits only, one space between words.

    Where a text has no mention of a licence, the steps that spell references alike are left out: they are no-ops there.
    """
    references = len(_references(" "))
    text = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), *steps[0])
    told = text
    for pattern, by in steps[1 : 1 + references]:
        told = F.regexp_replace(told, pattern, by)
    text = told if mentioned is None else F.when(mentioned, told).otherwise(text)
    for pattern, by in steps[1 + references :]:
        text = F.regexp_replace(text, pattern, by)
    return F.split(F.trim(F.lower(text), F.lit(" \n")), "\n")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table=None, rules=None) -> DataFrame:
    """``(id, sentence_ids, licences, n_unmatched)`` per row, in one pass without a shuffle.

    A text is read twice, line by line and with wrapped lines joined. ``sentence_ids`` spells the known sentences of the
    reading that has more of them (equal: by line) in order, ``<?>`` for anything between; ``n_unmatched`` counts
    those that no rule took. ``licences`` are those of the matching rules, each once: that reading's in rule order, then
    what only the other one shows.
    Null and empty texts have no sentence. Repeated rows are reported each, an empty table gives no rows, and
    columns other than the two are not read.
    """
    known = known_sentences(table)
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    spelled = F.array(*[F.struct(F.lit(n).alias("licence"), F.lit(p).alias("pattern")) for n, p in spelled_rules(table, rules)])

    def sequence(steps) -> Column:
        ids = F.transform(
            sentences(F.col("text"), steps, F.col("mentioned")),
            lambda s: F.when(s.isin(*known), F.concat(F.lit("<"), F.element_at(names, s), F.lit(">"))).otherwise(f"<{GAP}>"),
        )
        return F.regexp_replace(F.array_join(ids, ""), "(<\\?>)+", f"<{GAP}>")

    def count(ids: Column) -> Column:
        return F.length(ids) - F.length(F.replace(ids, F.lit("<"), F.lit("")))

    def folded(ids: Column) -> Column:
        start = F.struct(ids.alias("rest"), F.array().cast("array<string>").alias("found"))
        step = lambda acc, rule: F.when(
            F.contains(acc.rest, rule.pattern),
            F.struct(F.replace(acc.rest, rule.pattern, F.lit("<=>")).alias("rest"), F.array_append(acc.found, rule.licence).alias("found")),
        ).otherwise(acc)
        return F.when(~ids.isin("", f"<{GAP}>"), F.aggregate(spelled, start, step))

    mentioned = F.coalesce(F.lower(F.col(text_col).cast("string")).rlike(MENTIONS), F.lit(False))
    told = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), mentioned.alias("mentioned"))
    read = told.select("id", sequence(BY_LINE).alias("a"), sequence(JOINED).alias("b"))
    known_in = lambda c: count(F.replace(F.col(c), F.lit(f"<{GAP}>"), F.lit("")))
    read = read.withColumn("swap", known_in("b") > known_in("a"))
    read = read.select("id", F.when(F.col("swap"), F.col("b")).otherwise(F.col("a")).alias("ids"),
                       F.when(F.col("swap"), F.col("a")).otherwise(F.col("b")).alias("other"))
    matched = read.withColumn("m", folded(F.col("ids"))).withColumn("o", folded(F.col("other")))
    none = F.array().cast("array<string>")
    return matched.select(
        "id", F.col("ids").alias("sentence_ids"),
        F.array_distinct(F.concat(F.coalesce("m.found", none), F.coalesce("o.found", none))).alias("licences"),
        F.coalesce(count(F.regexp_replace("m.rest", "<[=?]>", "")), F.lit(0)).alias("n_unmatched"),
    )
