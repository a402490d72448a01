"""License scans by sentence rules, in DataFrame functions only.

A text is cut into sentences (at line breaks, and at . ! ? followed by white
space), once as it stands and once with single line breaks taken as spaces, for
wrapped notices; there blank lines, lines of comment marks alone and numbered
points part sentences too. Sentences are normalised: A-Z lowered, everything
but a-z and 0-9 one space, so comment marks do not matter; where a sentence
names an organisation or a work, any name will do (GAPS). Known sentences become
identifiers. So do the names in SPDX expressions, one each, and in one-line
notices of the form "this .. is licensed under the ..", one or two. Others are
"?". Rules are ordered: each is a sequence of identifiers that must stand
together, and what a rule has matched is gone for the rules after it, so a full
licence text is not also reported as its parts; a clause that is not known
inside known ones is a licence of its own (BSD-custom), not the shorter one.

Only texts that hold one of the words which every known sentence or notice has
are cut up at all. A null, empty or licence-free text has empty results; repeated rows
each have their own. A very long text is cut up whole. Other columns pass
through; columns named like an output are replaced.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._text import free_names

# Sentences of public licence texts and notices, by identifier; several that mean the same are a tuple.
SENTENCES: dict[str, str | tuple[str, ...]] = {
    "apache2_short": "Licensed under the Apache License, Version 2.0.",
    "apache2_under": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache2_copy": ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    "apache2_at": "You may obtain a copy of the License at",
    "apache2_url": ("http://www.apache.org/licenses/LICENSE-2.0", "https://www.apache.org/licenses/LICENSE-2.0"),
    "apache2_unless": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache2_see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit_short": "Released under the MIT License.",
    "mit_licensed": "Licensed under the MIT License.",
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit_warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit_event": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc_grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "isc_warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "0bsd_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "gpl3_short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3_free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2_free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl_hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl_see": "See the GNU General Public License for more details.",
    "gpl2_only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "lgpl2_free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3_free": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "lgpl_hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl_see": "See the GNU Lesser General Public License for more details.",
    "agpl3_free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl_see": "See the GNU Affero General Public License for more details.",
    "lgpl_short": "Licensed under the GNU Lesser General Public License.",
    "mpl2_form": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "mpl2_copy": ("If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "epl2_form": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "bsl1_form": "Distributed under the Boost Software License, Version 1.0.",
    "unlicense_form": "This is free and unencumbered software released into the public domain.",
    "bsd_use": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd_names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd_warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "cc_by_4": "Licensed under CC BY 4.0.",
    "cc_by_sa_4": "Licensed under CC BY-SA 4.0.",
    "cc_by_nc_4": "Licensed under CC BY-NC 4.0.",
    "cc_by_nc_long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc_by_long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc_by_sa_long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "reserved": "All rights reserved.",
    "bsd_advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the copyright holder.",
    "bsd_liable": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "zlib_warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib_liable": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib_grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "postgres_grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "artistic2_terms": "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed.",
    "cc0_waiver": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    "eupl12_form": "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\");",
}

# Names that a line "SPDX-License-Identifier: name" may give.
SPDX = [
    "Apache-2.0", "MIT", "GPL-3.0-or-later", "GPL-3.0-only", "GPL-2.0-or-later", "GPL-2.0-only", "LGPL-2.1-or-later", "LGPL-2.1-only", "LGPL-3.0-or-later", "LGPL-3.0-only",
    "AGPL-3.0-or-later", "AGPL-3.0-only", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "ISC", "0BSD", "Unlicense", "EPL-2.0", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
    "Zlib", "Artistic-2.0", "PostgreSQL", "EUPL-1.2", "LGPL-2.0-or-later", "LGPL-2.0-only",
]
# Names without a suffix, which older lines give, and what they stand for.
SPDX_OLD = {f"{n}-{v}": f"{n}-{v}-only" for n, v in (("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0"))}
SENTENCES |= {f"spdx_{n}": (f"SPDX-License-Identifier: {n}", *(f"SPDX-License-Identifier: {old}" for old, now in SPDX_OLD.items() if now == n)) for n in SPDX}

# What one-line notices call a licence, normalised, and its name.
NOTICES = {
    "MIT": ["mit", "mit expat", "expat"],
    "Apache-2.0": ["apache 2 0", "apache 2", "apache v2", "apache v2 0", "apache license 2 0", "apache license v2 0", "apache license version 2 0", "apache version 2 0", "apache software license 2 0"],
    "BSD-3-Clause": ["bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "three clause bsd"],
    "BSD-2-Clause": ["bsd 2 clause", "2 clause bsd", "simplified bsd", "two clause bsd", "freebsd"],
    "ISC": ["isc"],
    "GPL-3.0-or-later": ["gnu general public license version 3 or later", "gnu general public license v3 or later", "gpl v3 or later", "gplv3 or later", "gplv3", "gpl version 3 or later"],
    "GPL-3.0-only": ["gnu general public license version 3", "gnu general public license v3", "gnu general public license v3 0", "gnu gpl v3", "gnu gplv3", "gpl v3", "gplv3", "gpl 3 0", "gpl version 3"],
    "GPL-2.0-or-later": ["gnu general public license version 2 or later", "gnu general public license v2 or later", "gpl v2 or later", "gplv2 or later", "gpl version 2 or later"],
    "GPL-2.0-only": ["gnu general public license version 2", "gnu general public license v2", "gnu general public license v2 0", "gnu gpl v2", "gnu gplv2", "gpl v2", "gplv2", "gpl 2 0", "gpl version 2"],
    "LGPL-2.1-only": ["lgpl 2 1", "lgpl v2 1", "gnu lesser general public license version 2 1", "gnu lesser general public license v2 1"],
    "LGPL-3.0-only": ["lgpl v3", "lgplv3", "lgpl 3 0", "gnu lesser general public license version 3", "gnu lesser general public license v3"],
    "AGPL-3.0-only": ["agpl v3", "agplv3", "agpl 3 0", "gnu affero general public license version 3", "gnu affero general public license v3"],
    "MPL-2.0": ["mpl 2 0", "mpl v2 0", "mozilla public license 2 0", "mozilla public license version 2 0", "mozilla public license v2 0"],
    "EPL-2.0": ["epl 2 0", "eclipse public license 2 0", "eclipse public license v2 0", "eclipse public license version 2 0"],
    "BSL-1.0": ["boost software license 1 0", "boost software license version 1 0"],
    "Unlicense": ["unlicense"],
    "Zlib": ["zlib", "zlib libpng"],
    "Artistic-2.0": ["artistic license 2 0", "artistic 2 0"],
    "PostgreSQL": ["postgresql"],
    "CC0-1.0": ["cc0", "cc0 1 0", "cc0 1 0 universal", "creative commons zero"],
    "EUPL-1.2": ["eupl", "eupl 1 2", "eupl version 1 2", "european union public licence 1 2"],
}
NOTICES["GPL-3.0-or-later"].remove("gplv3")
#: Any name in these places of a normalised sentence is read as the one of the known sentence.
GAPS = [
    (r"^neither the names? of .{1,120}? nor the names? of (?:its|their|the|any) (?:contributors|other contributors) may be used", "neither the name of the copyright holder nor the names of its contributors may be used"),
    (r"^this software is provided by .{1,120}? as is and any express", "this software is provided by the copyright holders and contributors as is and any express"),
    (r"^in no event shall .{1,120}? be liable for any direct indirect", "in no event shall the copyright holder or contributors be liable for any direct indirect"),
    (r"must display the following acknowledge?ment this product includes software developed by .{1,160}$", "must display the following acknowledgement this product includes software developed by the copyright holder"),
    (r"^to the extent possible under law .{1,120}? has waived all copyright and related or neighboring rights to .{1,120}$", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work"),
]
#: Full stops that end no sentence, and the plus sign of older names.
ABBREVIATED, PLUS = r"\b(inc|ltd|corp|co|llc|gmbh|dept)\.", r"(gpl-[0-9.]+)\+"
SPDX_HEAD = "spdx license identifier "

#: In order; of several that match at one place the first wins.
RULES = [
    ("Apache-2.0", ["apache2_under", "apache2_copy", "apache2_unless", "apache2_see"]),
    ("Apache-2.0", ["apache2_under", "apache2_at", "apache2_url", "apache2_unless", "apache2_see"]),
    ("Apache-2.0", ["apache2_under", "apache2_copy"]),
    ("Apache-2.0", ["apache2_under", "apache2_at", "apache2_url"]),
    ("Apache-2.0", ["apache2_under"]),
    ("Apache-2.0", ["apache2_short"]),
    ("MIT", ["mit_grant", "mit_notice", "mit_warranty", "mit_event"]),
    ("MIT", ["mit_grant", "mit_notice", "mit_warranty"]),
    ("MIT", ["mit_grant", "mit_notice"]),
    ("MIT", ["mit_grant"]),
    ("MIT", ["mit_short"]),
    ("MIT", ["mit_licensed"]),
    ("ISC", ["isc_grant", "isc_warranty"]),
    ("ISC", ["isc_grant"]),
    ("0BSD", ["0bsd_grant", "isc_warranty"]),
    ("0BSD", ["0bsd_grant"]),
    ("AGPL-3.0-or-later", ["agpl3_free", "gpl_hope", "agpl_see"]),
    ("AGPL-3.0-or-later", ["agpl3_free"]),
    ("LGPL-3.0-or-later", ["lgpl3_free", "gpl_hope", "lgpl_see"]),
    ("LGPL-3.0-or-later", ["lgpl3_free", "lgpl_hope", "lgpl_see"]),
    ("LGPL-3.0-or-later", ["lgpl3_free"]),
    ("LGPL-2.1-or-later", ["lgpl2_free", "lgpl_hope", "lgpl_see"]),
    ("LGPL-2.1-or-later", ["lgpl2_free"]),
    ("GPL-3.0-or-later", ["gpl3_free", "gpl_hope", "gpl_see"]),
    ("GPL-3.0-or-later", ["gpl3_free"]),
    ("GPL-2.0-or-later", ["gpl2_free", "gpl_hope", "gpl_see"]),
    ("GPL-2.0-or-later", ["gpl2_free"]),
    ("GPL-2.0-only", ["gpl2_only", "gpl_hope", "gpl_see"]),
    ("GPL-2.0-only", ["gpl2_only"]),
    ("GPL-3.0-only", ["gpl3_short"]),
    ("LGPL", ["lgpl_short"]),
    ("MPL-2.0", ["mpl2_form", "mpl2_copy"]),
    ("MPL-2.0", ["mpl2_form"]),
    ("EPL-2.0", ["epl2_form"]),
    ("BSL-1.0", ["bsl1_form"]),
    ("Unlicense", ["unlicense_form"]),
    ("BSD-4-Clause", ["bsd_use", "bsd_source", "bsd_binary", "bsd_advert", "bsd_names", "bsd_warranty"]),
    ("BSD-4-Clause", ["bsd_use", "bsd_source", "bsd_binary", "bsd_advert", "bsd_names"]),
    ("BSD-3-Clause", ["bsd_use", "bsd_source", "bsd_binary", "bsd_names", "bsd_warranty"]),
    ("BSD-3-Clause", ["bsd_use", "bsd_source", "bsd_binary", "bsd_names"]),
    ("BSD-custom", ["bsd_use", "bsd_source", "bsd_binary", "bsd_advert", "?", "bsd_warranty"]),
    ("BSD-custom", ["bsd_use", "bsd_source", "bsd_binary", "?", "bsd_names"]),
    ("BSD-custom", ["bsd_use", "bsd_source", "bsd_binary", "?", "?", "bsd_warranty"]),
    ("BSD-custom", ["bsd_use", "bsd_source", "bsd_binary", "?", "bsd_warranty"]),
    ("BSD-custom", ["bsd_use", "bsd_source", "?", "bsd_binary"]),
    ("BSD-custom", ["bsd_use", "?", "bsd_source", "bsd_binary"]),
    ("BSD-2-Clause", ["bsd_use", "bsd_source", "bsd_binary", "bsd_warranty"]),
    ("BSD-2-Clause", ["bsd_use", "bsd_source", "bsd_binary"]),
    ("CC-BY-4.0", ["cc_by_4"]),
    ("CC-BY-4.0", ["cc_by_long"]),
    ("CC-BY-SA-4.0", ["cc_by_sa_4"]),
    ("CC-BY-SA-4.0", ["cc_by_sa_long"]),
    ("CC-BY-NC-4.0", ["cc_by_nc_4"]),
    ("CC-BY-NC-4.0", ["cc_by_nc_long"]),
    ("Zlib", ["zlib_warranty", "zlib_liable", "zlib_grant"]),
    ("Zlib", ["zlib_grant"]),
    ("PostgreSQL", ["postgres_grant"]),
    ("Artistic-2.0", ["artistic2_terms"]),
    ("CC0-1.0", ["cc0_waiver"]),
    ("EUPL-1.2", ["eupl12_form"]),
    *((n, [f"spdx_{n}"]) for n in SPDX),
    *((n, [f"notice_{n}"]) for n in NOTICES),
    ("All-rights-reserved", ["reserved"]),
]

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Each known sentence and each notice has one of these, in lower case.
WORDS = ["licens", "licence", "rights reserved", "permission", "copyright", "warrant", "redistribut", "mozilla.org", "unencumbered", "liable", "acknowledg", "gpl", "cc0", "eupl", *(f"under {a}{b}" for a in ("", "the ") for b in ("mit", "apache", "bsd", "isc", "mpl", "epl", "zlib", "expat"))]
#: Ends of sentences. What has no letter (a list's number, say) is no sentence.
BREAK, BREAK_WRAPPED = r"[.!?]+(?:[ \t\r\f\v]|$)|\n", r"[.!?]+(?:[ \t\r\n\f\v]|$)|\n[ \t\r*#/;-]*\n|\n[ \t\r*#/;-]*[0-9]+[.)][ \t]"
JUNK = "[^a-z0-9]+"


def _plain(sentence: str) -> str:
    import re

    return re.sub(JUNK, " ", sentence.lower()).strip()


def known(sentences: dict[str, str | tuple[str, ...]] = SENTENCES) -> dict[str, str]:
    """Identifier of each normalised sentence."""
    return {_plain(s): k for k, said in sentences.items() for s in ((said,) if isinstance(said, str) else said)}


def called() -> dict[str, str]:
    """Identifier of each name that a notice may give, longer names first."""
    return {x: f"notice_{n}" for x, n in sorted(((x, n) for n, names in NOTICES.items() for x in names), key=lambda p: (-len(p[0]), p[0]))}


def _notice() -> str:
    """The pattern of one-line notices: groups 1 and 2 are the names."""
    name = "|".join(called())
    verb = "licensed|released|distributed|available|published|provided|covered|dual licensed"
    head = "(?:(?:this|the|all|our) [a-z0-9 ]{1,40}? (?:is|are) (?:free software )?(?:made )?)?"
    return rf"^(?:[a-z0-9]{{1,20}} (?:is|are) )?{head}(?:{verb}) under (?:the terms of )?(?:the |an? )?(?:either )?(?:the )?({name})(?: licen[cs]e)?(?: (?:or|and) (?:the |an? )?({name})(?: licen[cs]e)?)?(?: (?:see|at your|a copy|for|which|terms|as|in|with|license|full|you|please|copyright) ?.{{0,200}})?$"


def sentences_of(low: Column, breaks: str) -> Column:
    """Normalised sentences of a lower-case text in order; those without a letter are left out, an SPDX expression is one a name."""
    text = F.regexp_replace(F.regexp_replace(low, ABBREVIATED, "$1"), PLUS, "$1-or-later")
    normal = F.filter(F.transform(F.split(text, breaks), lambda s: F.trim(F.regexp_replace(s, JUNK, " "))), lambda s: s.rlike("[a-z]"))

    def parts(s: Column) -> Column:
        names = F.split(F.replace(F.substring(s, F.lit(len(SPDX_HEAD) + 1), F.char_length(s)), F.lit(" or later"), F.lit(" or-later")), " (?:or|and) ")
        name = lambda n: F.replace(F.trim(F.regexp_replace(n, " with .*$", "")), F.lit("or-later"), F.lit("or later"))
        return F.when(F.startswith(s, F.lit(SPDX_HEAD)), F.transform(names, lambda n: F.concat(F.lit(SPDX_HEAD), name(n)))).otherwise(F.array(s))

    return F.flatten(F.transform(normal, parts))


def identifiers(low: Column, breaks: str, table: dict[str, str]) -> Column:
    """Identifiers of the sentences of a lower-case text in order, "?" for others."""
    ids = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    names = F.create_map(*(F.lit(x) for pair in called().items() for x in pair))

    def of(s: Column) -> Column:
        gapped = s
        for pattern, said in GAPS:
            gapped = F.regexp_replace(gapped, pattern, said)
        noticed = F.filter(F.array(*(F.try_element_at(names, F.regexp_extract(s, _notice(), k)) for k in (1, 2))), lambda x: x.isNotNull())
        own = F.coalesce(F.try_element_at(ids, s), F.try_element_at(ids, gapped))
        return F.when(own.isNotNull(), F.array(own)).when(F.size(noticed) > 0, noticed).otherwise(F.array(F.lit("?")))

    return F.flatten(F.transform(sentences_of(low, breaks), of))


def matched(ids: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Names of the rules that match, in rule order."""
    listed = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{x}>" for x in want)).alias("want")) for name, want in rules))
    text = F.concat_ws("", F.transform(ids, lambda x: F.concat(F.lit("<"), x, F.lit(">"))))
    start = F.struct(text.alias("text"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["text"], rule["want"])
        return F.struct(
            F.when(hit, F.replace(acc["text"], rule["want"], F.lit("<#>"))).otherwise(acc["text"]).alias("text"),
            F.when(hit, F.array_append(acc["found"], rule["name"])).otherwise(acc["found"]).alias("found"),
        )

    return F.aggregate(listed, start, step, lambda acc: acc["found"])


def scan_licenses(docs: DataFrame, text: str = "text", sentences: dict[str, str | tuple[str, ...]] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """docs without text, with sentence_ids and licenses (arrays of strings, distinct, in order of the text and of the rules)."""
    table = known(sentences)
    text_low, lines, wrapped = free_names(docs, "text_low", "ids_by_line", "ids_wrapped")
    low = F.translate(F.coalesce(F.col(text), F.lit("")), CAPITALS, SMALL)
    likely = F.lit(False)
    for w in WORDS:
        likely = likely | F.contains(low, F.lit(w))
    none = F.array().cast("array<string>")
    keep = [c for c in docs.columns if c not in (text, "sentence_ids", "licenses")]
    out = docs.select(*keep, F.when(likely, low).alias(text_low))
    out = out.select(*keep, *(F.when(F.col(text_low).isNull(), none).otherwise(identifiers(F.col(text_low), b, table)).alias(n) for b, n in ((BREAK, lines), (BREAK_WRAPPED, wrapped))))
    seen = F.filter(F.array_distinct(F.concat(lines, wrapped)), lambda x: x != "?")
    found = F.array_distinct(F.concat(matched(F.col(lines), rules), matched(F.col(wrapped), rules)))
    return out.select(*keep, F.when(F.size(lines) == 0, none).otherwise(seen).alias("sentence_ids"), F.when(F.size(lines) == 0, none).otherwise(found).alias("licenses"))


def scan_sql() -> str:
    """DuckDB SQL for (doc_id, sentence_ids, licenses) over documents, lists joined by commas."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = known()
    listed = lambda d: f"MAP {{{', '.join(f'{quote(k)}: {quote(v)}' for k, v in d.items())}}}"
    ids, names = listed(table), listed(called())
    text = f"regexp_replace(regexp_replace(low, {quote(ABBREVIATED)}, '\\1', 'g'), {quote(PLUS)}, '\\1-or-later', 'g')"
    parts = f"CASE WHEN starts_with(s, '{SPDX_HEAD}') THEN list_transform(string_split_regex(replace(substr(s, {len(SPDX_HEAD) + 1}), ' or later', ' or-later'), ' (?:or|and) '), lambda n: '{SPDX_HEAD}' || replace(trim(regexp_replace(n, ' with .*$', '')), 'or-later', 'or later')) ELSE [s] END"
    gapped = "s"
    for pattern, said in GAPS:
        gapped = f"regexp_replace({gapped}, {quote(pattern)}, {quote(said)}, 'g')"
    noticed = ", ".join(f"names[regexp_extract(s, {quote(_notice())}, {k})]" for k in (1, 2))
    of = f"CASE WHEN coalesce(ids[s], ids[{gapped}]) IS NOT NULL THEN [coalesce(ids[s], ids[{gapped}])] WHEN len(list_filter([{noticed}], lambda x: x IS NOT NULL)) > 0 THEN list_filter([{noticed}], lambda x: x IS NOT NULL) ELSE ['?'] END"
    normal = lambda b: f"list_filter(list_transform(string_split_regex({text}, {quote(b)}), lambda s: trim(regexp_replace(s, '{JUNK}', ' ', 'g'))), lambda s: regexp_matches(s, '[a-z]'))"
    cut = lambda b: f"flatten(list_transform(flatten(list_transform({normal(b)}, lambda s: {parts})), lambda s: {of}))"
    likely = " OR ".join(f"contains(low, {quote(w)})" for w in WORDS)
    steps = [
        f"l AS (SELECT doc_id, row_number() OVER () AS r, translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}') AS low FROM documents)",
        f"c AS (SELECT doc_id, r, {cut(BREAK)} AS a, {cut(BREAK_WRAPPED)} AS b FROM l, (SELECT {ids} AS ids, {names} AS names) WHERE {likely})",
        "s0 AS (SELECT r, k, '<' || array_to_string(x, '><') || '>' AS t, []::VARCHAR[] AS f FROM (SELECT r, 0 AS k, a AS x FROM c UNION ALL SELECT r, 1, b FROM c))",
    ]
    for k, (name, want) in enumerate(RULES):
        pattern = quote("".join(f"<{x}>" for x in want))
        steps.append(f"s{k + 1} AS MATERIALIZED (SELECT r, k, replace(t, {pattern}, '<#>') AS t, CASE WHEN contains(t, {pattern}) THEN list_append(f, {quote(name)}) ELSE f END AS f FROM s{k})")
    last = f"s{len(RULES)}"
    # distinct in order of first place
    distinct = lambda x: f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"
    return f"""WITH {', '.join(steps)},
m AS (SELECT x.r, x.f || y.f AS f FROM {last} x JOIN {last} y ON x.r = y.r AND x.k = 0 AND y.k = 1),
n AS (SELECT r, list_filter(a || b, lambda v: v <> '?') AS v FROM c)
SELECT l.doc_id, coalesce(array_to_string({distinct('n.v')}, ','), '') AS sentence_ids, coalesce(array_to_string({distinct('m.f')}, ','), '') AS licenses
FROM l LEFT JOIN m USING (r) LEFT JOIN n USING (r)"""
