"""Licence scans: normalised text against licence templates by Dice coefficient over word bigrams.

Units of a text are its lines, its blank-line paragraphs, the whole, and, for notices that share those with other
words, windows as long as a template, laid so that one of the template's two longest words meets its like in the
text. A unit is reduced to lower-case ASCII words; a template matches when ``2 |A n B| / (|A| + |B|)`` over the
bigrams, counted with repeats, reaches the threshold t. That needs ``|B| t / (2 - t) <= |A| <= |B| (2 - t) / t``,
and ``|A|`` is the number of words less one, so each template is filed under the counts it admits and a unit
meets only the templates filed under its own, before any bigram is made. As |A n B| is |A| at most, a match also
needs |A n B| of ``|B| t / (2 - t)`` or more, so of words that stand in more of a template's bigrams than that leaves out
one must be in the text. Texts with no such word of any template match none and aren't normalised.

Everything happens inside a row, by functions over arrays: no join, no shuffle. The templates are a literal.

Defined cases: null or empty texts have no licence (null columns, ``n_matches`` 0); ties go to the smaller template
name; every row counts by itself, repeated rows, a shared or null ``doc_id`` included; very long texts are scanned
whole; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence notices as commonly written, by SPDX identifier.
TEMPLATES: list[tuple[str, str]] = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License v3.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    (
        "CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Whole licence texts, without their copyright lines, by SPDX identifier.
_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_TWO_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. "
)
_THIRD_CLAUSE = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
TEMPLATES += [
    ("BSD-2-Clause", _TWO_CLAUSES + _AS_IS),
    ("BSD-3-Clause", _TWO_CLAUSES + _THIRD_CLAUSE + _AS_IS),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
        "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
        "SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote "
        "the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
        "distribution.",
    ),
]
THRESHOLD = 0.8


def words_of(text: str) -> list[str]:
    return re.sub(r"[^A-Za-z0-9]+", " ", text).lower().split()


def bigrams_of(text: str) -> Counter[str]:
    w = words_of(text)
    return Counter(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))


def size_index(templates: list[tuple[str, str]], threshold: float) -> list[tuple[int, int, str, list[tuple[str, int]]]]:
    """(admitted bigram count, template number, licence, bigrams with counts): the pruning bounds as rows."""
    out = []
    for i, (name, text) in enumerate(templates):
        grams = bigrams_of(text)
        n = grams.total()
        out += [
            (k, i, name, sorted(grams.items()))
            for k in range(1, int(n * (2 - threshold) / threshold) + 2)  # rounding may cut the last; the next line decides
            if 2 * min(k, n) >= threshold * (k + n)
        ]
    return out


def anchors(templates: list[tuple[str, str]]) -> list[tuple[str, int, int]]:
    """Where windows are laid: (word, words before it, words in all), for the two longest words of each template."""
    out = set()
    for _, text in templates:
        words = words_of(text)
        for w in sorted(set(words), key=lambda w: (-len(w), words.index(w)))[:2]:
            out.add((w, words.index(w), len(words)))
    return sorted(out)


def telltales(templates: list[tuple[str, str]], threshold: float) -> list[tuple[str, ...]]:
    """Groups of words, all words of one of which are in any text, in lower case, that matches a template; an empty group is in all."""
    out = set()
    for _, text in templates:
        words = words_of(text)
        grams = list(zip(words, words[1:], strict=False))
        # Dice is largest for a unit that has nothing else.
        needed = next((c for c in range(len(grams) + 1) if 2.0 * c >= threshold * (c + len(grams))), None)
        if not grams or needed is None:
            continue  # nothing matches it

        def short(without: list[str], grams=grams, needed=needed) -> bool:
            return sum(a not in without and b not in without for a, b in grams) < needed

        chosen: list[str] = []
        for w in sorted(set(words), key=lambda w: (-len(w), w)):
            if short(chosen):
                break
            chosen.append(w)
        if not short(chosen):
            return [()]
        for w in chosen[::-1]:
            if short([x for x in chosen if x != w]):
                chosen.remove(w)
        # Where the others are missing, each word that makes the text short in place of the last one must be there.
        *others, last = chosen
        out |= {(w,) for w in others}
        out.add(tuple(sorted(w for w in set(words) if len(w) == len(last) and short([*others, w]))))

    def implied(group: tuple[str, ...], by: tuple[str, ...]) -> bool:
        return all(any(x in w for w in by) for x in group)

    return sorted(g for g in out if not any(x != g and implied(x, g) for x in out))


def normal_lines(text: Column) -> Column:
    """Lower-case ASCII words with single blanks between them; line ends stay. Single blanks cost nothing."""
    return F.lower(F.regexp_replace(text, r" *[^A-Za-z0-9\n ][^A-Za-z0-9\n]*| {2,}", " "))


def n_words(unit: Column) -> Column:
    """Words of a trimmed, normalised unit, counted without splitting it."""
    return F.when(unit == "", 0).otherwise(F.length(unit) - F.length(F.replace(unit, F.lit(" "), F.lit(""))) + 1)


def _numbered(grams: Column) -> Column:
    """Bigrams told apart by how often each came before, so that sets of them meet as multisets do."""
    plain = F.transform(grams, lambda g: F.concat(g, F.lit(" 1")))
    ranked = F.transform(
        F.array(F.array_sort(grams)),
        lambda s: F.transform(s, lambda g, i: F.concat_ws(" ", g, (i - F.array_position(s, g) + 2).cast("string"))),
    )
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), plain).otherwise(F.get(ranked, 0))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value bound to a name, so that it is made once."""
    return F.get(F.transform(F.array(value), use), 0)


def _windows(whole: Column, places: list[tuple[str, int, int]]) -> Column:
    """Windows of the text laid by the anchor words; none where no anchor word occurs."""
    none = F.array().cast("array<string>")
    if not places:
        return none
    words = sorted({w for w, _, _ in places})
    found = F.from_json(F.lit(json.dumps({w: [[p, n] for x, p, n in places if x == w] for w in words})), "map<string,array<array<int>>>")

    def laid(ws: Column) -> Column:
        at = F.filter(F.transform(ws, lambda w, i: F.struct((i + 1).alias("at"), w.alias("word"))), lambda x: x["word"].isin(words))

        def window(x: Column, place: Column) -> Column:
            start = x["at"] - F.get(place, 0)
            first = F.greatest(start, F.lit(1))
            return F.array_join(F.slice(ws, first, F.greatest(start + F.get(place, 1) - first, F.lit(0))), " ")

        return F.flatten(F.transform(at, lambda x: F.transform(F.try_element_at(found, x["word"]), lambda place: window(x, place))))

    some = F.lit(False)
    for w in words:
        some = some | F.contains(whole, F.lit(w))
    return F.when(some, _bound(F.split(whole, " "), laid)).otherwise(none)


MATCH = "array<struct<unit:string,license:string,dice:double,template:int>>"


def matched(text: Column, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> Column:
    """Every (unit, template) of a text at or over the threshold, as an array of (unit, license, dice, template)."""
    templates = TEMPLATES if templates is None else templates
    filed: dict[int, list[int]] = {}
    for n, i, _, _ in size_index(templates, threshold):
        filed.setdefault(n, []).append(i)
    if not filed:
        return F.array().cast(MATCH)
    rows = [[{"license": name, "grams": [f"{g} {k + 1}" for g, c in sorted(bigrams_of(t).items()) for k in range(c)]}] for name, t in templates]
    known = F.from_json(F.lit(json.dumps([r[0] for r in rows])), "array<struct<license:string,grams:array<string>>>")
    admitted = F.from_json(F.lit(json.dumps([filed.get(n, []) for n in range(max(filed) + 1)])), "array<array<int>>")

    def units(flat: Column) -> Column:
        one = lambda u: F.trim(F.regexp_replace(u, " *\n[ \n]*", " "))
        split = F.transform(F.concat(F.split(flat, "\n", -1), F.split(flat, "\n(?: ?\n)+", -1)), one)
        return _bound(one(flat), lambda whole: F.array_distinct(F.concat(split, F.array(whole), _windows(whole, anchors(templates)))))

    def bigrams(unit: Column) -> Column:
        return _bound(F.split(unit, " "), lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))

    def scored(u: Column, own: Column) -> Column:
        def one(i: Column) -> Column:
            grams = F.get(known, i)["grams"]
            dice = 2.0 * F.size(F.array_intersect(own, grams)) / (u["n"] + F.size(grams))
            return F.struct(u["unit"].alias("unit"), F.get(known, i)["license"].alias("license"), dice.alias("dice"), i.alias("template"))

        return F.filter(F.transform(F.get(admitted, u["n"]), one), lambda m: m["dice"] >= threshold)

    def matches(flat: Column) -> Column:
        sized = F.transform(units(flat), lambda u: F.struct(u.alias("unit"), (n_words(u) - 1).cast("int").alias("n")))
        # Size bounds first: only units that some template admits are split into bigrams.
        sized = F.filter(sized, lambda u: u["n"].between(min(filed), max(filed)) & (F.size(F.get(admitted, u["n"])) > 0))
        return F.flatten(F.transform(sized, lambda u: _bound(_numbered(bigrams(u["unit"])), lambda own: scored(u, own))))

    def may_match(low: Column) -> Column:
        found = F.lit(False)
        for group in telltales(templates, threshold):
            every = F.lit(True)
            for w in group:
                every = every & F.contains(low, F.lit(w))
            found = found | every
        return found

    some = F.exists(F.array(F.lower(text)), may_match)
    return F.when(some, _bound(normal_lines(text), matches).cast(MATCH)).otherwise(F.array().cast(MATCH))


def license_matches(
    docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """Every (row, unit, template) at or over the threshold: ``doc_id, unit, license, dice, template``."""
    return docs.select("doc_id", F.explode(matched(F.col("text"), templates, threshold)).alias("m")).select("doc_id", "m.*")


def license_scan(
    docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per document row: best licence, its Dice, all licences found, and matching (unit, template) pairs."""
    found = docs.select("doc_id", matched(F.col("text"), templates, threshold).alias("m"))
    best = F.array_min(F.transform("m", lambda m: F.struct((-m["dice"]).alias("d"), m["license"].alias("license"))))
    names = F.array_sort(F.array_distinct(F.transform("m", lambda m: m["license"])))
    return found.select(
        "doc_id",
        best["license"].alias("license"),
        (-best["d"]).alias("dice"),
        F.when(F.size("m") > 0, F.array_join(names, ",")).alias("licenses"),
        F.size("m").cast("long").alias("n_matches"),
    )
