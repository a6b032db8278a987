"""Licence scans by sentence rules, on DataFrame functions alone.

A text is tidied (what comments put before lines, numbers of lists and web addresses are cut away), cut into
sentences, each normalised and mapped to the identifier of a known licence sentence. The sequence of
identifiers is then matched, at each place, against the ordered licence rules. All of it happens within a
row: nothing is shuffled, and a text's length is the only thing that bounds a task's row.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FREE = "this {thing} is free software you can redistribute it and or modify it under the terms of the gnu {kind}general public license {version}"
_LATER = "as published by the free software foundation either version {v} of the license or at your option any later version"
_ONLY = "version {v} as published by the free software foundation"
#: The licences whose notices only differ in names and numbers.
_GNU = [("GPL", "2.0", "", "2"), ("GPL", "3.0", "", "3"), ("LGPL", "2.1", "lesser ", "2 1"), ("LGPL", "3.0", "lesser ", "3"), ("AGPL", "3.0", "affero ", "3")]

#: The name of what begins as all BSD licences do, while nothing known says which of them it is.
UNSAID = "BSD"
_WHAT = ("", "this project is ", "this software is ", "this library is ", "this program is ", "the code is ")
_HOW = ("licensed", "released", "distributed", "available")

#: Known sentences in their normal form (lower case, everything but letters and digits one space, names as NAMES has them), with their wordings.
SENTENCES: dict[str, list[str]] = {
    "mit-released": [f"{what}{how} under the {terms}mit license" for what in _WHAT for how in _HOW for terms in ("", "terms of the ")],
    "mit-title": ["the mit license mit", "the mit license", "mit license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-0-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software"],
    "mit-as-is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "mit-liability": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "apache-2-licensed": ["licensed under the apache license version 2 0 the license", *(f"{what}{how} under the {terms}apache license {v}2 0" for what in _WHAT for how in _HOW for terms in ("", "terms of the ") for v in ("version ", ""))],
    "apache-2-header": ["licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"],
    "apache-2-comply": ["you may not use this file except in compliance with the license"],
    "apache-2-copy": ["you may obtain a copy of the license at"],
    "apache-2-basis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache-2-see": ["see the license for the specific language governing permissions and limitations under the license"],
    "apache-2-title": ["apache license version 2 0 january 2004"],
    "apache-2-terms": ["terms and conditions for use reproduction and distribution"],
    "apache-2-definitions": ["definitions"],
    "apache-2-mean": ["license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document"],
    "gpl-3-work": ["this work is licensed under the gnu general public license version 3"],
    "gpl-hope": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl-see": [f"see the gnu {kind}general public license for more details" for kind in ("", "lesser ", "affero ")],
    "gpl-copy": [f"you should have received a copy of the gnu {kind}general public license along with this {thing}" for kind in ("", "lesser ", "affero ") for thing in ("program", "library")],
    "gpl-1-title": ["gnu general public license version 1 february 1989"],
    "gpl-2-title": ["gnu general public license version 2 june 1991"],
    "gpl-3-title": ["gnu general public license version 3 29 june 2007"],
    "lgpl-2-1-title": ["gnu lesser general public license version 2 1 february 1999"],
    "lgpl-3-title": ["gnu lesser general public license version 3 29 june 2007"],
    "agpl-3-title": ["gnu affero general public license version 3 19 november 2007"],
    "cc-by-nc-4-licensed": ["licensed under cc by nc 4 0"],
    "cc-by-4-licensed": ["licensed under cc by 4 0"],
    "cc-by-sa-4-licensed": ["licensed under cc by sa 4 0"],
    "cc-by-4-work": ["this work is licensed under a creative commons attribution 4 0 international license", "this work is licensed under the creative commons attribution 4 0 international license"],
    "cc-by-sa-4-work": ["this work is licensed under a creative commons attribution sharealike 4 0 international license", "this work is licensed under the creative commons attribution sharealike 4 0 international license"],
    "cc-by-nc-4-work": ["this work is licensed under a creative commons attribution noncommercial 4 0 international license", "this work is licensed under the creative commons attribution noncommercial 4 0 international license"],
    "cc-by-4-title": ["creative commons attribution 4 0 international public license"],
    "cc-by-sa-4-title": ["creative commons attribution sharealike 4 0 international public license"],
    "cc0-work": ["this work is dedicated to the public domain under cc0 1 0"],
    "cc0-title": ["cc0 1 0 universal", "creative commons cc0 1 0 universal"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-endorse": ["neither the name of x nor the names of y may be used to endorse or promote products derived from this software without specific prior written permission", "the name of x may not be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-ads": ["all advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "bsd-product": ["this product includes software developed by x"],
    "bsd-as-is": ["this software is provided by x as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "bsd-liability": ["in no event shall x be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"],
    "0bsd-grant": [f"permission to use copy modify and {o}distribute this software for any purpose with or without fee is hereby granted" for o in ("or ", "")],
    "isc-grant": [f"permission to use copy modify and {o}distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies" for o in ("or ", "")],
    "isc-as-is": ["the software is provided as is and x disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "isc-liability": ["in no event shall x be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"],
    "mpl-2-form": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "mpl-2-copy": ["if a copy of the mpl was not distributed with this file you can obtain one at"],
    "mpl-2-title": ["mozilla public license version 2 0"],
    "epl-2-made": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at"],
    "epl-2-title": ["eclipse public license v 2 0"],
    "bsl-1-title": ["boost software license version 1 0 august 17th 2003"],
    "bsl-1-distributed": ["distributed under the boost software license version 1 0"],
    "bsl-1-grant": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"],
    "zlib-as-is": ["this software is provided as is without any express or implied warranty"],
    "zlib-liability": ["in no event will the authors be held liable for any damages arising from the use of this software"],
    "zlib-grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "zlib-origin": ["the origin of this software must not be misrepresented you must not claim that you wrote the original software"],
    "zlib-thanks": ["if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required"],
    "zlib-altered": ["altered source versions must be plainly marked as such and must not be misrepresented as being the original software"],
    "zlib-notice": ["this notice may not be removed or altered from any source distribution"],
    "unlicense-release": ["this is free and unencumbered software released into the public domain"],
    "unlicense-anyone": ["anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "cc-by-nd-4-licensed": ["licensed under cc by nd 4 0"],
    "cc-by-nd-4-work": ["this work is licensed under a creative commons attribution noderivatives 4 0 international license", "this work is licensed under the creative commons attribution noderivatives 4 0 international license"],
    "cddl-1-title": ["common development and distribution license cddl version 1 0"],
    "ofl-1-1-font": ["this font software is licensed under the sil open font license version 1 1"],
    "artistic-2-title": ["the artistic license 2 0"],
    "eupl-1-2-title": ["european union public licence v 1 2"],
    "psf-2-title": ["python software foundation license version 2"],
    "wtfpl-title": ["do what the fuck you want to public license version 2 december 2004"],
}
for _name, _number, _kind, _v in _GNU:
    SENTENCES[f"{_name.lower()}-{_number}-later"] = [_FREE.format(thing=t, kind=_kind, version=_LATER.format(v=_v)) for t in ("program", "library")]
    SENTENCES[f"{_name.lower()}-{_number}-only"] = [_FREE.format(thing=t, kind=_kind, version=_ONLY.format(v=_v)) for t in ("program", "library")]

#: Rules in the order in which they are tried at a place; longer ones of a licence come first.
RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["mit-title", "mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-grant"]),
    ("MIT-0", ["mit-0-grant", "mit-as-is", "mit-liability"]),
    ("MIT-0", ["mit-0-grant", "mit-as-is"]),
    ("MIT-0", ["mit-0-grant"]),
    ("MIT", ["mit-released"]),
    ("MIT", ["mit-title"]),
    ("Apache-2.0", ["apache-2-header", "apache-2-copy", "apache-2-basis", "apache-2-see"]),
    ("Apache-2.0", ["apache-2-header", "apache-2-copy", "apache-2-basis"]),
    ("Apache-2.0", ["apache-2-header"]),
    ("Apache-2.0", ["apache-2-licensed", "apache-2-comply"]),
    ("Apache-2.0", ["apache-2-licensed"]),
    ("Apache-2.0", ["apache-2-title", "apache-2-terms", "apache-2-definitions", "apache-2-mean"]),
    ("Apache-2.0", ["apache-2-title"]),
    *[(f"{name}-{number}-{'or-later' if end == 'later' else end}", [f"{name.lower()}-{number}-{end}", *more]) for name, number, _, _ in _GNU for end in ("later", "only") for more in (["gpl-hope", "gpl-see", "gpl-copy"], ["gpl-hope", "gpl-see"], ["gpl-hope"], [])],
    ("GPL-3.0-only", ["gpl-3-work"]),
    ("GPL-1.0", ["gpl-1-title"]),
    ("GPL-2.0", ["gpl-2-title"]),
    ("GPL-3.0", ["gpl-3-title"]),
    ("LGPL-2.1", ["lgpl-2-1-title"]),
    ("LGPL-3.0", ["lgpl-3-title"]),
    ("AGPL-3.0", ["agpl-3-title"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-ads", "bsd-product", "bsd-endorse", "bsd-as-is", "bsd-liability"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-ads", "bsd-product", "bsd-endorse"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is", "bsd-liability"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is"]),
    ("BSD-1-Clause", ["bsd-grant", "bsd-source", "bsd-as-is", "bsd-liability"]),
    (UNSAID, ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("0BSD", ["0bsd-grant", "isc-as-is", "isc-liability"]),
    ("0BSD", ["0bsd-grant"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-licensed"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-work"]),
    ("CC-BY-4.0", ["cc-by-4-licensed"]),
    ("CC-BY-4.0", ["cc-by-4-work"]),
    ("CC-BY-4.0", ["cc-by-4-title"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-licensed"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-work"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-title"]),
    ("CC0-1.0", ["cc0-work"]),
    ("CC0-1.0", ["cc0-title"]),
    ("ISC", ["isc-grant", "isc-as-is", "isc-liability"]),
    ("ISC", ["isc-grant"]),
    ("MPL-2.0", ["mpl-2-form", "mpl-2-copy"]),
    ("MPL-2.0", ["mpl-2-form"]),
    ("MPL-2.0", ["mpl-2-title"]),
    ("EPL-2.0", ["epl-2-made"]),
    ("EPL-2.0", ["epl-2-title"]),
    ("BSL-1.0", ["bsl-1-title", "bsl-1-grant"]),
    ("BSL-1.0", ["bsl-1-title"]),
    ("BSL-1.0", ["bsl-1-distributed"]),
    ("BSL-1.0", ["bsl-1-grant"]),
    ("Zlib", ["zlib-as-is", "zlib-liability", "zlib-grant", "zlib-origin", "zlib-thanks", "zlib-altered", "zlib-notice"]),
    ("Zlib", ["zlib-as-is", "zlib-liability", "zlib-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("Unlicense", ["unlicense-release", "unlicense-anyone"]),
    ("Unlicense", ["unlicense-release"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-4-licensed"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-4-work"]),
    ("CDDL-1.0", ["cddl-1-title"]),
    ("OFL-1.1", ["ofl-1-1-font"]),
    ("Artistic-2.0", ["artistic-2-title"]),
    ("EUPL-1.2", ["eupl-1-2-title"]),
    ("PSF-2.0", ["psf-2-title"]),
    ("WTFPL", ["wtfpl-title"]),
]
#: Every licence by its tag, too.
_TAGS = [name for name in dict.fromkeys(name for name, _ in RULES) if name != UNSAID]
for _licence in _TAGS:
    SENTENCES[f"spdx-{_licence.lower()}"] = ["spdx license identifier " + re.sub("[^a-z0-9]+", " ", _licence.lower())]
RULES += [(_licence, [f"spdx-{_licence.lower()}"]) for _licence in _TAGS]

_BLANK = r"[\x09-\x0D\x20]"
#: Patterns and what takes a match's place, in their order: what conditions follow on the same line, points within names, comments' marks before a line, list marks, tags, addresses, "v. 2".
TIDY = [
    (rf"(conditions|restrictions|acknowledge?ment|following):{_BLANK}+", "$1:\n\n"),
    (rf"([Nn]either{_BLANK}+the{_BLANK}+names?{_BLANK}+of{_BLANK}+[^.!?:]{{1,60}})[.]({_BLANK})", "$1$2"),
    (rf"([^A-Za-z](?:Inc|INC|Corp|CORP|Ltd|LTD|Co|CO))[.]({_BLANK}+(?:[a-z]|AND{_BLANK}|OR{_BLANK}|BE{_BLANK}|NOR{_BLANK}|.?AS{_BLANK}))", "$1$2"),
    (r"(^|\n)[ \t\r]*(//+|#+|;+|\*+|--+|%+|\"+|/\*+|\(\*|<!--|\|+|\.\.)[ \t]*", "$1"),
    (r"(^|\n)[ \t\r]*(\(?[0-9]{1,2}[.)]|\(?[a-z][.)]|\(?[ivx]{2,4}[.)]|[-o])[ \t]+", "$1\n\n"),
    (r"(SPDX-License-Identifier:[ \t]*[(]*[A-Za-z0-9.+-]+(?:[ \t)]+(?:OR|AND|WITH)[ \t(]+[A-Za-z0-9.+-]+)*)[)]*", "\n\n$1\n\n"),
    (r"([Hh][Tt][Tt][Pp][Ss]?://|[Ww]{3}\.)[^\x09-\x0D\x20<>\")]+", "\n\n"),
    (rf"(^|[^A-Za-z0-9])[Vv]\.{_BLANK}*([0-9])", "$1v $2"),
]
#: Where sentences end: a mark and white space, a colon at a line's end, or an empty line.
ENDS, GAPS, REST = rf"([.!?]){_BLANK}+|:[ \t\r]*\n", rf"\n{_BLANK}*\n", "[^a-z0-9]+"
#: A tag, what joins the licences of its expression, and what is left out of it (exceptions) or written out (a plus).
TAG, JOINS, EXCEPT, PLUS = "^SPDX-License-Identifier:[ \t(]*", "[ \t)]+(OR|AND)[ \t(]+", "[ \t)]+WITH[ \t(]+[A-Za-z0-9.+-]+", "[+]$"
#: Patterns on normal sentences and what takes a match's place: whose name stands there, and where the text of the licence lies.
NAMES = [
    ("^neither the names? of .{1,200}? nor the names of .{1,100}? may be used to endorse or promote products", "neither the name of x nor the names of y may be used to endorse or promote products"),
    ("^the names? of .{1,200}? may not be used to endorse or promote products", "the name of x may not be used to endorse or promote products"),
    ("^this software is provided by .{1,200}? as is and any express", "this software is provided by x as is and any express"),
    ("^the software is provided as is and .{1,200}? disclaims all warranties", "the software is provided as is and x disclaims all warranties"),
    ("^in no event shall .{1,200}? be liable for any (direct indirect|special direct)", "in no event shall x be liable for any $1"),
    ("^this product includes software developed by .{1,200}$", "this product includes software developed by x"),
    (" see (the |our )?(accompanying |included )?(file )?(licen[cs]e( md| txt| rst)?( file)? ?){1,2}(for (the )?(more |full )?(details|information|text|terms))?$", ""),
]
#: A sentence without this has none of NAMES.
NAMED = "^(neither the name|the name|this software is provided by|the software is provided as is and|in no event shall|this product includes)| see "
#: What is no sentence of a sequence: no letter at all, and lines that say whose the work is.
ALONE = "^([0-9 ]*|(portions )?copyright (c )?[0-9].*|all rights reserved)$"


def marker_words(known: dict[str, list[str]]) -> list[str]:
    """A few words of which every known sentence has one: a text without any has no known sentence."""
    left, out = [set(s.split()) for forms in known.values() for s in forms], []
    while left:
        counts: dict[str, int] = {}
        for words in left:
            for w in words:
                counts[w] = counts.get(w, 0) + (len(w) > 3)
        out.append(max(sorted(counts), key=lambda w: (counts[w], len(w))))
        left = [words for words in left if out[-1] not in words]
    return out


def sentences(text: Column) -> Column:
    """The raw sentences of a text. A tag's expression is a sentence for each licence it names."""
    for pattern, to in TIDY:
        text = F.regexp_replace(text, pattern, to)
    parts = F.split(F.regexp_replace(F.regexp_replace(text, ENDS, "$1\u0001"), GAPS, "\u0001"), "\u0001")

    def named(tag: Column) -> Column:
        each = F.split(F.regexp_replace(F.regexp_replace(tag, EXCEPT, ""), TAG, ""), JOINS)
        return F.transform(each, lambda x: F.concat(F.lit("SPDX-License-Identifier: "), F.regexp_replace(x, PLUS, "-or-later")))

    return F.flatten(F.transform(parts, lambda s: F.when(s.rlike(TAG), named(s)).otherwise(F.array(s))))


def normal(sentence: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(sentence), REST, " "))

    def unnamed(s: Column) -> Column:
        out = s
        for pattern, to in NAMES:
            out = F.regexp_replace(out, pattern, to)
        return F.when(s.rlike(NAMED), out).otherwise(s)

    return let(plain, unnamed)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", known: dict[str, list[str]] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """key, licence, first_sentence, last_sentence (from 0), sentence_ids of every match.

    A match begins at a known sentence; the first rule whose identifiers are those of the sentences from there
    on applies, of those that begin with it; what stops before the sentence that tells BSD licences apart is UNSAID, not the
    shortest of them. A tag (SPDX) gives a match for each licence of its expression, without exceptions. Sentences without a letter and copyright lines are numbered but no part of a sequence. Matches may overlap. Defined
    results: null and empty texts match nothing; a null key stays null; repeated rows each have their matches.
    """
    ids = F.create_map(*[F.lit(x) for i, forms in known.items() for s in forms for x in (s, i)])
    beginning = {first: [r for r in rules if r[1][0] == first] for first in dict.fromkeys(own[0] for _, own in rules)}
    entry = lambda name, own: F.struct(F.lit(name).alias("licence"), F.array(*map(F.lit, own)).alias("rule"))
    table = F.create_map(*[x for first, own in beginning.items() for x in (F.lit(first), F.array(*[entry(*r) for r in own]))])
    marked = F.lower(text).rlike("|".join(marker_words(known)))

    def found(norms: Column) -> Column:
        all_ = F.transform(norms, lambda s, i: F.struct(i.alias("at"), F.element_at(ids, s).alias("id"), s.rlike(ALONE).alias("alone")))
        return F.filter(all_, lambda m: m["id"].isNotNull() | ~m["alone"])

    def matches(marks: Column) -> Column:
        def hit(m: Column, i: Column) -> Column:
            applies = lambda r: F.transform(F.slice(marks, i + 1, F.size(r["rule"])), lambda x: x["id"]) == r["rule"]
            rule = F.get(F.filter(F.element_at(table, m["id"]), applies), F.lit(0))
            return let(rule, lambda r: F.struct(r["licence"].alias("licence"), m["at"].alias("first"), F.get(marks, i + F.size(r["rule"]) - 1)["at"].alias("last"), F.array_join(r["rule"], ",").alias("ids")))

        return F.filter(F.transform(marks, hit), lambda h: h["licence"].isNotNull())

    hits = let(let(F.transform(sentences(F.col(text)), normal), found), lambda marks: F.when(F.exists(marks, lambda m: m["id"].isNotNull()), matches(marks)))
    out = df.filter(marked).select(F.col(key).alias("scan_key"), F.explode(hits).alias("m"))
    return out.select(F.col("scan_key").alias(key), F.col("m.licence").alias("licence"), F.col("m.first").alias("first_sentence"), F.col("m.last").alias("last_sentence"), F.col("m.ids").alias("sentence_ids"))
