"""Licence notices by the Dice coefficient over word bigrams.

A text's lines, its paragraphs of several lines and the text itself are units. A
unit is lower-cased (A-Z), everything but a-z and 0-9 becomes one space, and its
word bigrams, repeats included, are compared with each template's:
2 * shared / (unit's + template's). A unit of u bigrams can reach the threshold t
only with templates of between u * t / (2 - t) and u * (2 - t) / t bigrams, so a
table lists for each u the templates in bounds; units outside all bounds are
dropped by their word count before any bigram is made. Texts without a cue word
are dropped before that: cue words are chosen from the templates so that a unit
without any of them would lack too many bigrams of every template. The table follows from
the template list alone (a few hundred rows), which bounds its broadcast. A
unit's comparisons stay in its row: nothing is shuffled, and only DataFrame
functions run. Texts with a cue word are written once and read for each kind of unit.

Defined cases: null and empty texts have no unit in bounds; of templates with
equal coefficients the first in the list is reported; repeated rows are reported
once each; an empty table gives an empty result; columns other than the id and
the text are not read.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

THRESHOLD_PERCENT = 80
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Public licence notices, (licence, notice).
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE
IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software. 3. This notice may not be removed or altered from any source distribution."""),
]


# Words that many texts hold: poor cues, so others are preferred. The choice changes no result.
ORDINARY = set("a above all and any are as be but by do for from general if in is it not of on or other out same so source such that the "
               "this to under use used with without work you".split())


def bigram_bag(text: str) -> list[str]:
    """Bigrams of a template, each with the number of its occurrence: sets of these compare as bags."""
    words, seen, out = re.findall("[a-z0-9]+", text.lower()), {}, []
    for pair in zip(words, words[1:], strict=False):
        seen[pair] = seen.get(pair, 0) + 1
        out.append(f"{pair[0]} {pair[1]}#{seen[pair] - 1}")
    return out


def bounds(size: int, percent: int) -> tuple[int, int]:
    """Smallest and largest number of a unit's bigrams that can reach the threshold with a template of `size`."""
    return max(1, math.ceil(size * percent / (200 - percent))), size * (200 - percent) // percent


def template_rows(templates: list[tuple[str, str]], percent: int) -> list[dict]:
    """For each number of bigrams in bounds, the templates that a unit of that size may match."""
    by_size: dict[int, list[dict]] = {}
    for no, (name, text) in enumerate(templates):
        bag = bigram_bag(text)
        low, high = bounds(len(bag), percent)
        for n in range(low, high + 1) if bag else ():
            by_size.setdefault(n, []).append({"no": no, "licence": name, "size": len(bag), "bag": bag})
    return [{"n": n, "templates": t} for n, t in sorted(by_size.items())]


def cue_words(templates: list[tuple[str, str]], percent: int) -> list[str]:
    """Words of which every matching unit holds at least one.

    A unit that matches a template of t bigrams lacks at most t - low of them. A unit
    without a template's cue words lacks all bigrams with these words; words are added,
    the one that helps most templates first, until that is too many for each template.
    """
    left, holds = {}, {}
    for no, (_, text) in enumerate(templates):
        bag = bigram_bag(text)
        if bag:
            left[no] = len(bag) - bounds(len(bag), percent)[0] + 1
        for gram in bag:
            for word in set(gram.split("#")[0].split(" ")):
                holds.setdefault(word, {}).setdefault(no, set()).add(gram)
    used, out = {no: set() for no in left}, []
    while any(len(used[no]) < left[no] for no in left):
        gain = {w: sum(min(left[no] - len(used[no]), len(g - used[no])) for no, g in by.items() if len(used[no]) < left[no])
                * (w not in ORDINARY and not w.isdigit()) + 1e-3 * sum(len(g - used[no]) for no, g in by.items() if len(used[no]) < left[no]) for w, by in holds.items()}
        best = max(gain, key=lambda w: (gain[w], len(w), w))
        out.append(best)
        for no, g in holds.pop(best).items():
            used[no] |= g
    return out


def _units(rows: DataFrame) -> DataFrame:
    """(_id, kind, no, words): normalised lines, paragraphs of several lines, and the text if it has several lines.

    `rows` (_id, norm) is read once for each kind; no expression over a whole text
    is computed again inside a lambda.
    """
    one = lambda x: F.trim(F.regexp_replace(x, r"[ \n]+", " "))
    struct = lambda kind, no, words: F.struct(F.lit(kind).alias("kind"), no.cast("int").alias("no"), words.alias("words"))
    lines = rows.select("_id", F.posexplode(F.split("norm", "\n"))).select(
        "_id", F.lit("line").alias("kind"), F.col("pos").alias("no"), F.trim("col").alias("words"))
    rows = rows.where(F.contains("norm", F.lit("\n")))
    parts = rows.select("_id", F.split("norm", r"\n *(?:\n *)+").alias("parts")).where(F.size("parts") > 1)
    parts = parts.select("_id", F.posexplode("parts")).where(F.contains("col", F.lit("\n"))).select(
        "_id", F.lit("paragraph").alias("kind"), F.col("pos").alias("no"), one(F.col("col")).alias("words"))
    whole = rows.select("_id", F.lit("document").alias("kind"), F.lit(0).alias("no"), one(F.col("norm")).alias("words"))
    return lines.unionByName(parts).unionByName(whole)


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, percent: int = THRESHOLD_PERCENT,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Units that match a template: id, kind (line, paragraph, document), no, licence, template, shared, dice."""
    rows = template_rows(TEMPLATES if templates is None else templates, percent)
    sizes = [r["n"] for r in rows] or [0]
    schema = "n int, templates array<struct<no:int,licence:string,size:int,bag:array<string>>>"
    table = docs.sparkSession.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(
        F.from_json("j", schema).alias("r")).select("r.*")
    n = F.length("words") - F.length(F.replace(F.col("words"), F.lit(" ")))  # words less one
    text = F.col(text_col).cast("string")
    # The explode of one element keeps the lower-case text from being made once per cue word.
    texts = docs.select(F.col(id_col).alias("_id"), text.alias("text"), F.explode(F.array(F.lower(text))).alias("low"))
    cue = F.lit(False)
    for word in cue_words(TEMPLATES if templates is None else templates, percent):
        cue = cue | (F.contains(F.col("low"), F.lit(word)) if len(word) > 3 else F.col("low").rlike(f"(^|[^a-z0-9]){word}([^a-z0-9]|$)"))
    norm = F.regexp_replace(F.translate("text", UPPER, LOWER), r"[^a-z0-9\n]+", " ")
    texts = materialise(texts.where(cue).select("_id", norm.alias("norm")), "licence-texts")
    units = _units(texts).withColumn("n", n.cast("int")).where(F.col("n").between(min(sizes), max(sizes)))
    units = units.join(F.broadcast(table), "n")  # one row a size, set by the template list
    # Each step's array comes out of an explode of one element: a filter on it then stays above it, so that no
    # step is computed again inside a later one's lambda.
    words = F.split("words", " ")
    pairs = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat_ws(" ", F.element_at("split", i), F.element_at("split", i + 1)))
    units = units.select("_id", "kind", "no", "n", "templates", F.explode(F.array(words)).alias("split"))
    units = units.select("_id", "kind", "no", "n", "templates", F.explode(F.array(F.sort_array(pairs))).alias("pairs"))
    bag = F.transform("pairs", lambda p, i: F.concat(p, F.lit("#"), (i + 1 - F.array_position("pairs", p)).cast("string")))
    units = units.select("_id", "kind", "no", "n", "templates", F.explode(F.array(bag)).alias("bag"))
    shared = F.transform("templates", lambda t: F.struct(
        F.size(F.array_intersect("bag", t["bag"])).alias("shared"), t["no"].alias("no"), t["licence"].alias("licence"), t["size"].alias("size")))
    units = units.select("_id", "kind", "no", "n", F.explode(F.array(shared)).alias("all"))
    dice = F.transform("all", lambda t: F.struct(
        (F.lit(2.0) * t["shared"] / (F.col("n") + t["size"])).alias("dice"), (-t["no"]).alias("order"),
        t["shared"].alias("shared"), t["licence"].alias("licence"), t["size"].alias("size")))
    best = units.select("_id", "kind", "no", "n", F.explode(F.array(F.array_max(dice))).alias("b"))
    return (best.where(F.col("b.shared") * 200 >= percent * (F.col("n") + F.col("b.size")))
            .select(F.col("_id").alias(id_col), "kind", "no", F.col("b.licence").alias("licence"),
                    (-F.col("b.order")).alias("template"), F.col("b.shared").alias("shared"), F.col("b.dice").alias("dice")))


def oracle(templates: list[tuple[str, str]] | None = None, percent: int = THRESHOLD_PERCENT) -> str:
    """The same scan of table documents in DuckDB, by joins."""
    grams = [(no, name, len(bag), g) for no, (name, text) in enumerate(TEMPLATES if templates is None else templates)
             for bag in [bigram_bag(text)] for g in bag]
    values = ", ".join(f"({no}, '{name}', {size}, '{g}')" for no, name, size, g in grams)
    return rf"""
with t(template, licence, size, gram) as (values {values}),
d as (select row_number() over () as rid, doc_id,
        regexp_replace(translate(text, '{UPPER}', '{LOWER}'), '[^a-z0-9\n]+', ' ', 'g') as norm from documents),
p as (select *, string_split_regex(norm, '\n *(?:\n *)+') as parts, string_split(norm, chr(10)) as lines from d),
u as (
  select rid, doc_id, 'line' as kind, unnest(range(len(lines))) as no, trim(unnest(lines)) as words from p
  union all
  select rid, doc_id, 'paragraph', no, trim(regexp_replace(x, '[ \n]+', ' ', 'g')) from (
    select rid, doc_id, unnest(range(len(parts))) as no, unnest(parts) as x from p where len(parts) > 1) where contains(x, chr(10))
  union all
  select rid, doc_id, 'document', 0, trim(regexp_replace(norm, '[ \n]+', ' ', 'g')) from p where contains(norm, chr(10))),
w as (select rid, doc_id, kind, no, string_split(words, ' ') as words, len(string_split(words, ' ')) - 1 as n from u where words <> ''),
c as (select * from w where n >= 1 and n <= (select max(size) * {200 - percent} // {percent} from t)),
g as (select rid, doc_id, kind, no, n, unnest(list_transform(range(1, n + 1), lambda i: words[i] || ' ' || words[i + 1])) as pair from c),
b as (select *, pair || '#' || (row_number() over (partition by rid, kind, no, pair) - 1) as gram from g),
s as (select rid, doc_id, kind, no, n, template, licence, size, count(*) as shared from b join t using (gram) group by all),
m as (select *, 2.0::double * shared / (n + size) as dice from s where shared * 200 >= {percent} * (n + size)),
r as (select *, row_number() over (partition by rid, kind, no order by dice desc, template) as place from m)
select doc_id, kind, no::int as no, licence, template::int as template, shared::int as shared, dice from r where place = 1"""
