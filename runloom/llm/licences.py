"""Licence scan: lines, passages and texts against templates, by Dice coefficient over word bigrams.

A text of b distinct bigrams and a template of t can only reach the coefficient s if
``s / (2 - s) <= b / t <= (2 - s) / s``. The bounds over all templates drop nearly every line
before any bigram is made, each template's own bounds the rest. Notices on lines of their own
are found by column expressions; whole licences, headers and notices amid other sentences by an
Arrow pass over runs of sentences, for which a template must have ``s / (2 - s)`` of its
bigrams somewhere in the text. Either way a row is judged by itself: nothing is shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_DICE = 0.8
_ROUNDING = 1e-9
"""Slack of the size bounds, so that no coefficient of exactly ``least`` falls to rounding."""

# Short licence notices, by SPDX name.
TEMPLATES = {
    "0BSD": "Licensed under the BSD Zero Clause License",
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-2-Clause": "Released under the BSD 2-Clause Simplified License",
    "BSD-3-Clause": "Released under the BSD 3-Clause New or Revised License",
    "CC-BY-4.0": "Licensed under the Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal",
    "EPL-2.0": "Made available under the terms of the Eclipse Public License 2.0",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "ISC": "Released under the ISC License",
    "LGPL-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}

_GNU_TAIL = """
    is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by
    the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
    This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
    implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.
    You should have received a copy of the GNU {name} along with this program. If not, see
    https://www.gnu.org/licenses/."""
_BSD_HEAD = """
    Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: Redistributions of source code must retain the above copyright notice, this list
    of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
    notice, this list of conditions and the following disclaimer in the documentation and/or other materials
    provided with the distribution."""
_BSD_NAMES = """
    Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
    products derived from this software without specific prior written permission."""
_BSD_TAIL = """
    THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
    WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
    PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
    DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
    PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
    CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
    OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
    DAMAGE."""
_ISC_GRANT = """
    Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
    granted{notice}."""
_ISC_TAIL = """
    THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
    ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
    DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
    PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
    WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

# Licence texts and the headers that licences ask for, by SPDX name.
BODIES = {
    "0BSD text": _ISC_GRANT.format(notice="") + _ISC_TAIL,
    "AGPL-3.0 header": "This program" + _GNU_TAIL.format(name="Affero General Public License", version=3),
    "Apache-2.0 header": """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on
        an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause text": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause text": _BSD_HEAD + _BSD_NAMES + _BSD_TAIL,
    "BSL-1.0 header": """
        Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at
        https://www.boost.org/LICENSE_1_0.txt""",
    "GPL-2.0 header": "This program" + _GNU_TAIL.format(name="General Public License", version=2),
    "GPL-3.0 header": "This program" + _GNU_TAIL.format(name="General Public License", version=3),
    "ISC text": _ISC_GRANT.format(notice=", provided that the above copyright notice and this permission notice appear in all copies") + _ISC_TAIL,
    "LGPL-3.0 header": "This program" + _GNU_TAIL.format(name="Lesser General Public License", version=3),
    "MIT text": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
        OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    "MPL-2.0 header": """
        This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense text": """
        This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.""",
    "Zlib text": """
        This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
        to the following restrictions: The origin of this software must not be misrepresented; you must not claim that
        you wrote the original software. If you use this software in a product, an acknowledgment in the product
        documentation would be appreciated but is not required. Altered source versions must be plainly marked as such,
        and must not be misrepresented as being the original software. This notice may not be removed or altered from
        any source distribution.""",
}


def bigrams_of(text: str) -> list[str]:
    words = re.sub("[^A-Za-z0-9]+", " ", text).strip().lower().split(" ")
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _bigrams(words: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat(F.get(words, i - 1), F.lit(" "), F.get(words, i)))
    return F.array_distinct(pairs)


_WORD = re.compile("[A-Za-z0-9]+")
_STOP = re.compile("([.!?:;])[ \t]")
PASSAGE = "array<struct<licence string, dice double, first int, last int>>"
_PASSAGE = pa.list_(pa.struct([("licence", pa.string()), ("dice", pa.float64()), ("first", pa.int32()), ("last", pa.int32())]))


def _words(text: str) -> list[str]:
    return " ".join(_WORD.findall(text)).lower().split()


@dataclass(frozen=True)
class Template:
    """A template's distinct bigrams, and the words that a passage held against it may have."""

    name: str
    bigrams: frozenset[tuple[str, str]]
    most_words: int

    @staticmethod
    def of(name: str, text: str, least: float) -> Template:
        words = _words(text)
        if len(words) < 2:
            raise ValueError(f"template {name} has no two words")
        return Template(name, frozenset(zip(words, words[1:])), int(len(words) * (2 - least) / least + _ROUNDING))

    def may_lie_in(self, n_bigrams: int, least: float) -> bool:
        """Can a text with so many of the bigrams hold a passage that reaches ``least``?"""
        return n_bigrams * (2 - least) >= least * len(self.bigrams) - _ROUNDING


def _best_passage(t: Template, words: list[str], ends: list[int], least: float) -> tuple[float, int, int] | None:
    """(Dice, first sentence, last sentence); of equal ones the shortest, then the earliest."""
    pairs = list(zip(words, words[1:]))
    hits = [p in t.bigrams for p in pairs]
    best, start = None, 0
    for first, stop in enumerate(ends):
        if any(hits[start:stop]):  # without, the passage that begins a sentence later is as good and shorter
            seen, shared, at = set(), 0, start
            for last in range(first, len(ends)):
                if ends[last] - start > t.most_words:
                    break
                for p in pairs[at : ends[last] - 1]:
                    if p not in seen:
                        seen.add(p)
                        shared += p in t.bigrams
                at = ends[last] - 1
                rank = (-2.0 * shared / (len(seen) + len(t.bigrams)), ends[last] - start, first, last)
                if best is None or rank < best:
                    best = rank
        start = stop
    return (-best[0], best[2], best[3]) if best is not None and -best[0] >= least else None


def passages_of(text: str | None, known: list[Template], least: float) -> list[dict]:
    """The best passage of each template that the text holds, by name; a passage is a run of whole sentences.

    A sentence ends at a line's end or at ``. ! ? : ;`` before a space or tab; those without words
    have no number. A passage has at most ``(2 - least) / least`` times its template's words.
    """
    there = set(_words(text or ""))
    likely = [t for t in known if t.may_lie_in(sum(a in there and b in there for a, b in t.bigrams), least)]
    if not likely:
        return []
    words, ends = [], []
    for part in _STOP.sub("\\1\n", text).split("\n"):
        found = _words(part)
        if found:
            words += found
            ends.append(len(words))
    pairs = set(zip(words, words[1:]))
    likely = [t for t in likely if t.may_lie_in(len(t.bigrams & pairs), least)]
    best = [(t.name, _best_passage(t, words, ends, least)) for t in likely]
    return [{"licence": name, "dice": b[0], "first": b[1], "last": b[2]} for name, b in sorted(best) if b is not None]


def _passages(texts: pa.Array, known: list[Template], least: float) -> pa.Array:
    return pa.array([passages_of(t.as_py(), known, least) for t in texts], _PASSAGE)


def passages(text: Column, templates: dict[str, str] | None = None, least: float = LEAST_DICE) -> Column:
    """All licences that a text holds as a passage: licence, dice, first and last sentence (from 0), by name.

    Null and empty texts hold none. Notices, whole licences and headers are held against
    the text unless other templates are given.
    """
    known = [Template.of(name, body, least) for name, body in ({**TEMPLATES, **BODIES} if templates is None else templates).items()]

    def found(texts: pa.Array) -> pa.Array:
        return _passages(texts, known, least)

    return F.arrow_udf(found, PASSAGE)(text)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST_DICE, bodies: dict[str, str] = BODIES) -> DataFrame:
    """One row per input row: doc_id, licence, dice, n_matches, passages.

    Each line and the text as a whole is normalised (A-Z lower-cased, all but letters and digits of
    ASCII as one space) and held against every template whose size bounds it meets.
    ``licence``: the template of the highest coefficient from ``least`` up (then the
    smallest name), null if none; ``n_matches``: lines (or the whole, if it has several) that reach it with any. Null and empty texts match nothing.
    ``passages``: what ``passages`` finds of templates and bodies.
    """
    made = {name: bigrams_of(text) for name, text in templates.items()}
    sizes = [len(b) for b in made.values()]
    low, high = min(sizes) * least / (2 - least) - _ROUNDING, max(sizes) * (2 - least) / least + _ROUNDING
    known = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*[F.lit(b) for b in bs]).alias("bigrams")) for name, bs in made.items()])
    lines = F.split("text", "\n", -1)
    parts = F.when(F.size(lines) > 1, F.concat(lines, F.array("text"))).otherwise(lines)
    # w words have at most w - 1 distinct bigrams; a bound from above needs them counted
    words = F.transform(parts, lambda x: F.split(F.lower(F.trim(F.regexp_replace(x, "[^A-Za-z0-9]+", " "))), " "))
    long_enough = F.filter(words, lambda w: F.size(w) - 1 >= low)
    sets = F.filter(F.transform(long_enough, _bigrams), lambda b: F.size(b).between(low, high))

    def best(b: Column) -> Column:
        n = F.size(b)
        near = F.filter(known, lambda t: (F.size(t["bigrams"]) * least <= n * (2 - least) + _ROUNDING) & (n * least <= F.size(t["bigrams"]) * (2 - least) + _ROUNDING))
        scored = F.transform(
            near,
            lambda t: F.struct(
                (F.lit(-2.0) * F.size(F.array_intersect(t["bigrams"], b)) / (F.size(t["bigrams"]) + n)).alias("minus"), t["name"].alias("name")
            ),
        )
        return F.array_min(scored)

    hits = F.filter(F.transform(sets, best), lambda h: h["minus"] <= -least)
    found = docs.select("doc_id", hits.alias("hits"), passages(F.col("text"), {**templates, **bodies}, least).alias("passages"))
    first = F.array_min("hits")
    return found.select(
        "doc_id", first["name"].alias("licence"), (-first["minus"]).alias("dice"), F.coalesce(F.size(F.filter("hits", lambda h: h.isNotNull())), F.lit(0)).alias("n_matches"), "passages"
    ).withColumn("n_matches", F.greatest("n_matches", F.lit(0)))


def digest(found: DataFrame) -> DataFrame:
    """``scan``'s rows with the names of all licences found as passages and the place of the best."""
    best = F.array_min(
        F.transform("passages", lambda p: F.struct((-p["dice"]).alias("minus"), p["licence"].alias("name"), p["first"].alias("first"), p["last"].alias("last")))
    )
    names = F.array_join(F.transform("passages", lambda p: p["licence"]), ", ").alias("licences")
    placed = found.withColumn("_best", best)
    return placed.select(
        "doc_id", "licence", "dice", "n_matches", names, F.col("_best.name").alias("passage"), (-F.col("_best.minus")).alias("passage_dice"),
        F.col("_best.first").alias("passage_first"), F.col("_best.last").alias("passage_last"),
    )


def oracle_sql(templates: dict[str, str] = TEMPLATES, least: float = LEAST_DICE, bodies: dict[str, str] = BODIES) -> str:
    """The same scan in plain SQL: lines without the pruning, passages from all runs of sentences of likely texts."""

    def rows(given: dict[str, str]) -> str:
        return ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in given.items())

    words = "string_split(lower(trim(regexp_replace({0}, '[^A-Za-z0-9]+', ' ', 'g'))), ' ')"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
    WITH texts AS (SELECT doc_id, text, row_number() OVER () AS row FROM documents
    ), known AS (
        SELECT name, {grams} AS t FROM (SELECT name, {words.format("body")} AS w FROM (VALUES {rows(templates)}) v(name, body))
    ), parts AS (
        SELECT row, unnest(CASE WHEN len(string_split(text, chr(10))) > 1
            THEN list_concat(string_split(text, chr(10)), [text]) ELSE string_split(text, chr(10)) END) AS part FROM texts
    ), cut AS (
        SELECT row, row_number() OVER () AS part_id, {grams} AS b FROM (SELECT row, {words.format("part")} AS w FROM parts) WHERE len(w) > 1
    ), scored AS (
        SELECT row, part_id, name, 2.0 * len(list_intersect(t, b)) / (len(t) + len(b)) AS dice
        FROM cut JOIN known ON len(b) BETWEEN 1 AND 60
    ), hits AS (
        SELECT row, count(DISTINCT part_id) AS n, max(dice) AS dice FROM scored WHERE dice >= {least} GROUP BY row
    ), names AS (
        SELECT s.row, min(s.name) AS name FROM scored s JOIN hits h ON s.row = h.row AND s.dice = h.dice GROUP BY s.row
    ), wanted AS (
        SELECT name, len(t) AS m, t, CAST(floor(n * {(2 - least) / least} + 1e-9) AS BIGINT) AS most FROM (
            SELECT name, {grams} AS t, len(w) AS n FROM (SELECT name, {words.format("body")} AS w FROM (VALUES {rows({**templates, **bodies})}) v(name, body)))
    ), wanted_grams AS (SELECT name, unnest(t) AS gram FROM wanted
    ), split AS (
        SELECT row, unnest(s) AS part, generate_subscripts(s, 1) AS place
        FROM (SELECT row, string_split(regexp_replace(text, '([.!?:;])[ \\t]', '\\1' || chr(10), 'g'), chr(10)) AS s FROM texts)
    ), sentences AS (
        SELECT row, w, row_number() OVER o - 1 AS sentence, sum(len(w)) OVER o - len(w) AS start, sum(len(w)) OVER o AS stop
        FROM (SELECT row, place, {words.format("part")} AS w FROM split) WHERE w <> [''] WINDOW o AS (PARTITION BY row ORDER BY place)
    ), placed AS (
        SELECT row, place, word || ' ' || lead(word) OVER (PARTITION BY row ORDER BY place) AS gram
        FROM (SELECT row, unnest(w) AS word, start + generate_subscripts(w, 1) - 1 AS place FROM sentences)
    ), likely AS (
        SELECT p.row, g.name FROM placed p JOIN wanted_grams g ON p.gram = g.gram JOIN wanted k ON k.name = g.name
        GROUP BY p.row, g.name, k.m HAVING count(DISTINCT p.gram) * {2 - least} >= {least} * k.m - 1e-9
    ), runs AS (
        SELECT l.row, l.name, k.m, a.sentence AS first, b.sentence AS last, a.start, b.stop
        FROM likely l JOIN wanted k ON k.name = l.name JOIN sentences a ON a.row = l.row
        JOIN sentences b ON b.row = l.row AND b.sentence >= a.sentence AND b.stop - a.start <= k.most
    ), judged AS (
        SELECT r.row, r.name, r.first, r.last, r.stop - r.start AS n,
            2.0 * count(DISTINCT g.gram) / (r.m + count(DISTINCT p.gram)) AS dice
        FROM runs r JOIN placed p ON p.row = r.row AND p.place >= r.start AND p.place < r.stop - 1
        LEFT JOIN wanted_grams g ON g.name = r.name AND g.gram = p.gram
        GROUP BY r.row, r.name, r.m, r.first, r.last, r.start, r.stop
    ), best AS (
        SELECT * FROM judged WHERE dice >= {least} QUALIFY row_number() OVER (PARTITION BY row, name ORDER BY dice DESC, n, first, last) = 1
    ), passages AS (
        SELECT row, string_agg(name, ', ' ORDER BY name) AS licences, arg_min(struct_pack(n := name, d := dice, f := first, l := last), (-dice, name)) AS top
        FROM best GROUP BY row
    )
    SELECT d.doc_id, n.name AS licence, CAST(h.dice AS DOUBLE) AS dice, CAST(coalesce(h.n, 0) AS INTEGER) AS n_matches,
        coalesce(p.licences, '') AS licences, p.top.n AS passage, CAST(p.top.d AS DOUBLE) AS passage_dice,
        CAST(p.top.f AS INTEGER) AS passage_first, CAST(p.top.l AS INTEGER) AS passage_last
    FROM texts d LEFT JOIN hits h ON d.row = h.row LEFT JOIN names n ON d.row = n.row LEFT JOIN passages p ON d.row = p.row
    """
