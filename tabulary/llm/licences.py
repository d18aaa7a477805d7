"""Licence scans: blocks of text against licence templates, by Dice over word bigrams.

A block is a line, a sentence, a paragraph (lines up to one without letters and digits) or
a whole text. Sentences end at a full stop or semicolon before white space, or at a colon
that ends a line, also within a line, and run over line ends; so a notice within a paragraph is found, and a
licence without paragraphs is found by its sentences. Blocks and templates are normalised
alike: lower case, runs of a-z and 0-9 as words. A template of several paragraphs or
sentences is compared as a whole and by each of them.

The Dice coefficient of two bigram sets of sizes a and b cannot reach t unless
a lies between b * t / (2 - t) and b * (2 - t) / t, so each size has its list of
templates that can match, and all others are never compared. The same bound says how many
of a template's bigrams a match must share, and so gives words of which it must hold one
(``telling_words``): blocks without any are not taken apart.

Templates are a parameter; they are part of the plan, so their texts may have
``MAX_TEMPLATE_CHARS`` characters together. All of it is DataFrame work without a
shuffle: each row is judged where it lies.

Defined results: null and empty texts have no blocks and match nothing; blocks
of one word have no bigrams and match nothing; equal blocks of a text count
once; very long texts are read whole; repeated rows stay; input columns named like an
output column are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.8
MAX_TEMPLATE_CHARS = 1 << 20

_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_GPL_TAIL = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""

#: Licences and their identifiers in source files.
SPDX = (
    ("apache-2.0", ("Apache-2.0",)), ("mit", ("MIT",)), ("gpl-2.0", ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later")), ("gpl-3.0", ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later")),
    ("lgpl-2.1", ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later")), ("lgpl-3.0", ("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later")), ("bsd-2-clause", ("BSD-2-Clause",)),
    ("bsd-3-clause", ("BSD-3-Clause",)), ("mpl-2.0", ("MPL-2.0",)), ("isc", ("ISC",)), ("unlicense", ("Unlicense",)), ("cc-by-4.0", ("CC-BY-4.0",)), ("cc-by-sa-4.0", ("CC-BY-SA-4.0",)),
    ("cc-by-nc-4.0", ("CC-BY-NC-4.0",)), ("cc0-1.0", ("CC0-1.0",)),
)

#: Public licences, whole where they are short, else their notices and openings. Blank lines part paragraphs.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

""" + _WARRANTY),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

""" + _GPL_TAIL),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("bsd-2-clause", _BSD_HEAD + "\n\n" + _BSD_WARRANTY),
    ("bsd-3-clause", _BSD_HEAD + "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n" + _BSD_WARRANTY),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    # Openings of long licences: their paragraphs and sentences tell the whole text.
    ("apache-2.0", """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.

"Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.

"Legal Entity" shall mean the union of the acting entity and all other entities that control, are controlled by, or are under common control with that entity. For the purposes of this definition, "control" means (i) the power, direct or indirect, to cause the direction or management of such entity, whether by contract or otherwise, or (ii) ownership of fifty percent (50%) or more of the outstanding shares, or (iii) beneficial ownership of such entity."""),
    ("gpl-3.0", """GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007

The GNU General Public License is a free, copyleft license for software and other kinds of works.

The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users. We, the Free Software Foundation, use the GNU General Public License for most of our software; it applies also to any other work released this way by its authors."""),
    ("gpl-2.0", "This General Public License applies to most of the Free Software Foundation's software and to any other program whose authors commit to using it. (Some other Free Software Foundation software is covered by the GNU Lesser General Public License instead.)"),
    ("lgpl-2.1", "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it. You can use it too, but we suggest you first think carefully about whether this license or the ordinary General Public License is the better strategy to use in any particular case, based on the explanations below."),
    ("lgpl-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("lgpl-3.0", "The Library refers to a covered work governed by this License, other than an Application or a Combined Work as defined below."),
    ("mpl-2.0", """"Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."""),
    ("mpl-2.0", """"Contributor Version" means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor's Contribution."""),
    ("mit", "is licensed under the terms of the MIT license"),
    ("mit", "is licensed under the MIT License - see the LICENSE file for details"),
    ("apache-2.0", "is licensed under the terms of the Apache License, Version 2.0"),
    ("bsd-3-clause", "is licensed under the terms of the BSD 3-Clause License"),
    *((name, f"SPDX-License-Identifier: {mark}") for name, marks in SPDX for mark in marks),
)
_PARAGRAPH = r"\n[^A-Za-z0-9\n]*\n"
_SENTENCE_END = r"(?<=[.;])\s+|(?<=:)\s*\n\s*"
#: Least words of a template's sentence that is compared by itself: shorter ones are found in other texts too.
_LEAST_WORDS = 12


def template_parts(text: str) -> list[str]:
    """The whole template, its paragraphs and its longer sentences."""
    parts = [text, *text.split("\n\n"), *(p for p in re.split(_SENTENCE_END, text) if len(re.findall("[A-Za-z0-9]+", p)) >= _LEAST_WORDS)]
    return list(dict.fromkeys(p for p in parts if p == text or len(re.findall("[A-Za-z0-9]+", p)) >= _LEAST_WORDS))


def _known(templates: tuple[tuple[str, str], ...]) -> list[tuple[str, list[str]]]:
    """(licence, bigrams) of all parts, each once for a licence."""
    made = {(name, tuple(template_bigrams(part))): None for name, text in templates for part in template_parts(text)}
    return [(name, list(b)) for name, b in made if b]


def template_bigrams(text: str) -> list[str]:
    words = re.findall("[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def size_bounds(size: int, threshold: float) -> range:
    """Sizes of sets that can reach ``threshold`` with a set of ``size``."""
    return range(math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9) + 1)


_COMMON = frozenset("a all and any are as at be by for from general in is it may not of on or other out public that the this to under use version with without you your".split())


def telling_words(bigrams: list[str], threshold: float) -> set[str]:
    """Words of which a set that reaches ``threshold`` with these bigrams must hold one.

    Such a set has at least t / 2 * (a + b) of the b bigrams, a being its least admissible
    size; so if all bigrams but fewer than that touch these words, one of its own does.
    Words that are common in any text are taken last, longer ones first.
    """
    b = len(bigrams)
    needed = math.ceil(threshold * (b + size_bounds(b, threshold)[0]) / 2 - 1e-9)
    left, out = list(bigrams), set()
    for word in sorted({w for g in bigrams for w in g.split()}, key=lambda w: (w in _COMMON, -len(w), w)):
        if len(left) < needed:
            break
        out.add(word)
        left = [g for g in left if word not in g.split()]
    return out


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def _bigrams(words: Column) -> Column:
    made = F.transform(F.slice(words, 1, F.size(words) - 1), lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1)))
    return F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(made))


def scan(docs: DataFrame, text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with n_blocks (distinct blocks compared) and matches, an array of licence, dice and block.

    Input columns named like an output column are replaced.
    """
    if sum(len(t) for _, t in templates) > MAX_TEMPLATE_CHARS:
        raise ValueError(f"templates may have {MAX_TEMPLATE_CHARS} characters together")
    known = _known(templates)
    least = min((size_bounds(len(b), threshold)[0] for _, b in known), default=0)
    top = max((size_bounds(len(b), threshold)[-1] for _, b in known), default=0)
    lists = [[k for k, (_, b) in enumerate(known) if n in size_bounds(len(b), threshold)] for n in range(top + 1)]
    # Constants that the optimiser folds once, instead of thousands of literals in the plan.
    constant = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)
    names, grams = constant([n for n, _ in known], "array<string>"), constant([b for _, b in known], "array<array<string>>")
    able = constant(lists, "array<array<int>>")
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = F.concat(F.split(text, "\n"), F.split(text, _PARAGRAPH), F.split(text, _SENTENCE_END), F.array(text))
    blocks = F.array_distinct(F.filter(parts, lambda x: x.rlike("[A-Za-z0-9]")))

    def compared(block: Column) -> Column:
        def dice(b: Column, k: Column) -> Column:
            t = F.get(grams, k)
            return F.struct(F.get(names, k).alias("licence"), (2.0 * F.size(F.array_intersect(b, t)) / (F.size(b) + F.size(t))).alias("dice"), block.alias("block"))

        found = lambda b: F.transform(F.coalesce(F.get(able, F.size(b)), F.array().cast("array<int>")), lambda k: dice(b, k))
        none = F.array().cast("array<struct<licence:string,dice:double,block:string>>")
        return _let(_words(block), lambda w: F.when((F.size(w) < least) | ~F.arrays_overlap(w, telling), none).otherwise(_let(_bigrams(w), found)))

    # Texts and blocks without any telling word cannot match and are not taken apart.
    telling = constant(sorted(set().union(*(telling_words(b, threshold) for _, b in known))), "array<string>")
    raw = lambda x: F.split(F.lower(x), "[^a-z0-9]+")
    kind = "array<struct<licence:string,dice:double,block:string>>"
    if not known:
        hits = F.array().cast(kind)
    else:
        hits = F.filter(F.flatten(F.transform(blocks, compared)), lambda m: m["dice"] >= threshold)
        hits = F.when(F.arrays_overlap(raw(text), telling), hits).otherwise(F.array().cast(kind))
    return docs.withColumns({"n_blocks": F.size(blocks).cast("long"), "matches": hits.cast(kind)})


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_blocks", F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["licence"]))), ",").alias("licences"),
        F.round(F.coalesce(F.array_max(F.transform("matches", lambda m: m["dice"])), F.lit(0.0)), 9).alias("best_dice"),
    )


def oracle_sql() -> str:
    rows = ", ".join(f"({k}, '{n}', [{', '.join(repr(g) for g in b)}])" for k, (n, b) in enumerate(_known(TEMPLATES)))
    return rf"""
WITH templates(k, licence, grams) AS (VALUES {rows}),
blocks AS (
  SELECT doc_id, unnest(list_distinct(list_filter(
    list_concat(string_split(coalesce(text, ''), chr(10)), regexp_split_to_array(coalesce(text, ''), '\n[^A-Za-z0-9\n]*\n'),
      string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.;])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), ':[ \t\x0B\f\r]*\n[ \t\n\x0B\f\r]*', ':' || chr(1), 'g'), chr(1)), [coalesce(text, '')]),
    lambda x: regexp_matches(x, '[A-Za-z0-9]')))) AS block
  FROM documents
), words AS (
  SELECT doc_id, block, list_filter(regexp_split_to_array(lower(block), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM blocks
), grams AS (
  SELECT doc_id, block, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM words
), pairs AS (
  SELECT g.doc_id, t.licence, 2.0::DOUBLE * len(list_intersect(g.b, t.grams)) / (len(g.b) + len(t.grams)) AS dice
  FROM grams g JOIN templates t ON len(g.b) * {2 - THRESHOLD} >= len(t.grams) * {THRESHOLD} - 1e-9 AND len(g.b) * {THRESHOLD} <= len(t.grams) * {2 - THRESHOLD} + 1e-9
), hits AS (
  SELECT doc_id, count(*) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, max(dice) AS dice
  FROM pairs WHERE dice >= {THRESHOLD} GROUP BY doc_id
), counts AS (SELECT doc_id, count(*) AS n FROM blocks GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, 0) AS n_blocks, coalesce(h.n, 0) AS n_matches, coalesce(h.licences, '') AS licences, round(coalesce(h.dice, 0.0), 9) AS best_dice
FROM documents d LEFT JOIN counts c ON c.doc_id = d.doc_id LEFT JOIN hits h ON h.doc_id = d.doc_id
"""
