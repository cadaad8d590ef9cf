"""License scan: Dice coefficient over word bigrams of normalised text against licence templates.

Normalised words are lower-cased runs of letters and digits, so line breaks and comment signs don't count. Units are
all runs of words of a text, wherever they stand in it: a template of b bigrams can reach Dice d only with a run of a
bigrams where b*d/(2-d) <= a <= b*(2-d)/d, so only runs of those sizes are looked at, and only those that begin and
end with a bigram of the template, as others get better by leaving their ends out.

A run that reaches d holds a least number of the template's bigrams, so it must hold one of any few more than the
others: those of most letters are the template's anchors. Documents without an anchor of a template, nearly all, leave
after one join with the broadcast anchors. In the rest each hit knows the place since which it counts (a bigram counts
as often as the template has it), so that a run's common bigrams are a running sum over its hits.

The template table is a fixed, counted broadcast; nothing else is broadcast without a count of its rows.

Defined cases: null and empty texts and texts of one word match nothing; bigrams count as often as both sides have
them; rows with a null doc_id report under null; repeated rows report once; of several templates and runs of one
licence the best reports, of equals the first in the text, then the shortest; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, stored, text_key

DICE = 0.8
MOST_TEMPLATES, MOST_BIGRAMS = 2000, 1_000_000
BROADCAST_ROWS = 1_000_000

# Wordings of licences and licence notices.
WARRANTY = "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
BSD_1 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. " + WARRANTY
MIT_1 = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
MIT_2 = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
GNU_MORE = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details. You should have received a copy of the GNU {0}General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
TEMPLATES = [
    ("agpl-3.0", GNU.format("Affero ")),
    ("agpl-3.0", GNU.format("Affero ") + " " + GNU_MORE.format("Affero ")),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", APACHE),
    ("apache-2.0", APACHE + " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd-2-clause", BSD_1 + " " + BSD_AS_IS),
    ("bsd-3-clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd-3-clause", BSD_1 + " " + BSD_3 + " " + BSD_AS_IS),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", GNU.format("")),
    ("gpl-3.0", GNU.format("") + " " + GNU_MORE.format("")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("lgpl-3.0", GNU.format("Lesser ")),
    ("lgpl-3.0", GNU.format("Lesser ") + " " + GNU_MORE.format("Lesser ")),
    ("mit", "Released under the MIT License."),
    ("mit", MIT_1),
    ("mit", MIT_1 + " " + MIT_2),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]


def normal_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def word_pairs(text: Column) -> Column:
    """Neighbouring words of a text, as an array of (first, second)."""
    rest = lambda w: F.greatest(F.size(w) - 1, F.lit(0))
    return let(normal_words(text), lambda w: F.arrays_zip(F.slice(w, F.lit(1), rest(w)).alias("first"), F.slice(w, F.lit(2), rest(w)).alias("second")))


def bigram_rows(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, gram: the hash of each bigram of a text and its place."""
    return docs.select(*keys, F.posexplode(word_pairs(F.col("text"))).alias("pos", "p")).select(*keys, "pos", F.xxhash64("p.first", "p.second").alias("gram"))


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """template, license, wording."""
    if len(templates) > MOST_TEMPLATES or sum(len(t) for _, t in templates) > 2 * MOST_BIGRAMS:
        raise ValueError("the template table is broadcast and must stay small")
    return spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, wording string")


def template_bigrams(templates: DataFrame, dice: float) -> DataFrame:
    """template, license, b, longest, gram, times, anchor of each distinct bigram of a template.

    A run of a bigrams with m in common reaches dice only if m >= dice * (a + b) / 2 and a >= m, so m is at least
    dice * b / (2 - dice). Any b - m + 1 of the b bigrams, repeats included, then hold one of the run's.
    """
    rows = templates.select("template", "license", F.posexplode(word_pairs(F.col("wording"))).alias("pos", "p"))
    grams = rows.groupBy("template", "license", F.xxhash64("p.first", "p.second").alias("gram")).agg(F.count("*").alias("times"), F.max(F.char_length("p.first") + F.char_length("p.second")).alias("letters"))
    lists = grams.groupBy("template", "license").agg(F.sum("times").alias("b"), F.array_sort(F.collect_list(F.struct((-F.col("letters")).alias("order"), "gram", "times"))).alias("grams"))
    spare = F.col("b") - F.ceil(F.col("b") * dice / (2 - dice) - 1e-9)
    before = F.transform("grams", lambda g, i: F.aggregate(F.slice("grams", F.lit(1), i), F.lit(0).cast("long"), lambda n, x: n + x["times"]))
    out = lists.select("template", "license", "b", F.floor(F.col("b") * (2 - dice) / dice + 1e-9).alias("longest"), F.explode(F.arrays_zip("grams", before.alias("before"), F.array_repeat(spare, F.size("grams")).alias("spare"))).alias("g"))
    return out.select("template", "license", "b", "longest", "g.grams.gram", "g.grams.times", (F.col("g.before") <= F.col("g.spare")).alias("anchor"))


def candidates(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """doc_id, text_key, template: documents that hold an anchor of a template."""
    anchors = F.broadcast(grams.where("anchor").select("template", "gram"))  # MOST_BIGRAMS rows at most
    return bigram_rows(docs, ["doc_id", "text_key"]).join(anchors, "gram").select("doc_id", "text_key", "template").distinct()


def best_run(hits: Column, b: Column, longest: Column) -> Column:
    """(-dice, first, last) of the best run between two of the sorted hits (pos, since)."""
    def from_hit(x, i):
        def step(s, y):
            size = y["pos"] - x["pos"] + 1
            m = s["m"] + F.when(y["since"] < x["pos"], 1).otherwise(0)
            found = F.struct((-2.0 * m / (size + b)).alias("d"), x["pos"].alias("first"), y["pos"].alias("last"))
            return F.when(size <= longest, F.struct(m.alias("m"), F.least(s["best"], found).alias("best"))).otherwise(s)

        zero = F.struct(F.lit(0).alias("m"), F.struct(F.lit(0.0).alias("d"), x["pos"].alias("first"), x["pos"].alias("last")).alias("best"))
        return F.aggregate(F.slice(hits, i + 1, longest.cast("int")), zero, step, lambda s: s["best"])

    return F.array_min(F.transform(hits, from_hit))


def scan(docs: DataFrame, templates: DataFrame, dice: float = DICE) -> DataFrame:
    """doc_id, license, best_dice, first_word, n_words: the best run of words for every licence a document holds."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("text_key")).where("text is not null")
    grams = stored(template_bigrams(templates, dice), "licence-bigrams")
    near = candidates(docs, grams).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("template")).alias("wanted"))  # MOST_TEMPLATES values at most
    near = stored(near.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "wanted"), "licence-candidates")
    few = near.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    again = docs.join(F.broadcast(near) if few else near, (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).drop("_doc", "_key")
    key = ["doc_id", "text_key", "template"]
    met = bigram_rows(again, ["doc_id", "text_key", "wanted"]).join(F.broadcast(grams.drop("anchor")), "gram").where(F.array_contains("wanted", F.col("template")))
    met = met.select(*key, "license", "b", "longest", "gram", "times", "pos").repartition(*key)
    places = met.groupBy(*key, "license", "b", "longest", "gram", "times").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    since = F.transform("at", lambda p, k: F.struct(p.alias("pos"), F.coalesce(F.get("at", (k - F.col("times")).cast("int")), F.lit(-1)).alias("since")))
    hits = places.groupBy(*key, "license", "b", "longest").agg(F.array_sort(F.flatten(F.collect_list(since))).alias("hits"))
    enough = hits.where(F.size("hits") >= F.col("b") * dice / (2 - dice) - 1e-9)
    runs = enough.select("doc_id", "license", best_run(F.col("hits"), F.col("b"), F.col("longest")).alias("r")).where(F.col("r.d") <= -dice)
    best = runs.groupBy("doc_id", "license").agg(F.min("r").alias("r"))
    return best.select("doc_id", "license", (-F.col("r.d")).alias("best_dice"), F.col("r.first").alias("first_word"), (F.col("r.last") - F.col("r.first") + 2).cast("int").alias("n_words"))


def query(spark, sf_dir):
    from .common import table

    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"), template_table(spark))


def _sql() -> str:
    """All runs between two hits, their bigrams counted anew for each run."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quote(n)}, {quote(t)})" for i, (n, t) in enumerate(TEMPLATES))
    words = lambda c: f"regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+')"
    pairs = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    return f"""
WITH t1 AS (SELECT template, license, {words('wording')} AS w FROM (VALUES {rows}) v(template, license, wording)),
t AS (SELECT template, license, len(w) - 1 AS b, g, count(*) AS c FROM (SELECT template, license, w, unnest({pairs}) AS g FROM t1) GROUP BY ALL),
d AS (SELECT doc_id, {words('text')} AS w FROM documents),
h0 AS (SELECT doc_id, unnest(range(len(w) - 1)) AS pos, unnest({pairs}) AS g FROM d WHERE len(w) > 1),
h1 AS (SELECT doc_id, pos, template, license, b, g, c FROM h0 JOIN t USING (g)),
h AS (SELECT * FROM h1 QUALIFY count(*) OVER (PARTITION BY doc_id, template) >= b * {DICE} / {2 - DICE} - 1e-9),
r AS (SELECT x.doc_id, x.template, x.license, x.b, x.pos AS first, y.pos AS last FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.template = y.template AND y.pos BETWEEN x.pos AND x.pos + x.b * {2 - DICE} / {DICE} + 1e-9 - 1),
m AS (SELECT r.doc_id, r.template, r.license, r.b, first, last, z.g, least(count(*), any_value(z.c)) AS n FROM r JOIN h z ON z.doc_id = r.doc_id AND z.template = r.template AND z.pos BETWEEN first AND last GROUP BY ALL),
s AS (SELECT doc_id, license, first, last, 2.0::DOUBLE * sum(n) / (last - first + 1 + b) AS dice FROM m GROUP BY doc_id, template, license, b, first, last)
SELECT doc_id, license, dice AS best_dice, first::INT AS first_word, (last - first + 2)::INT AS n_words FROM s WHERE dice >= {DICE}
QUALIFY row_number() OVER (PARTITION BY doc_id, license ORDER BY dice DESC, first, last) = 1
"""


ORACLE_SQL = _sql()
