"""License scans with DataFrame functions: Dice coefficient of word windows and templates over word bigrams, with size bounds pruning templates."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, table

THRESHOLD = 0.8

MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
MIT_REST = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
BSD_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_REST = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
GPL_USE = "This program is free software{stop} you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version."
GPL_HOPE = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details."
GPL_COPY = "You should have received a copy of the GNU {kind} along with this program. If not, see https://www.gnu.org/licenses/."
CREATIVE = "This work is licensed under a Creative Commons {kind} 4.0 International License."
CREATIVE_LONG = "This work is licensed under the Creative Commons {kind} 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/{path}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."


def gnu(kind: str, n: str) -> list[str]:
    """A licence's statement, its notice with and without the other paragraphs."""
    use, rest = GPL_USE.format(kind=kind, n=n, stop=":"), " ".join((GPL_HOPE, GPL_COPY)).format(kind=kind)
    return [f"This work is licensed under the GNU {kind}, version {n}.", use, f"{use} {rest}"]


def creative(kind: str, short: str) -> list[str]:
    return [f"Licensed under CC {short} 4.0.", CREATIVE.format(kind=kind), CREATIVE_LONG.format(kind=kind, path=short.lower())]


#: Statements that pages carry, notices as their authors ask for them to be put into files, and whole short licences. A bounded list: it goes with the plan.
TEMPLATES = {
    "AGPL-3.0": gnu("Affero General Public License", "3"),
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-2-Clause": [f"{BSD_TWO} {BSD_REST}", BSD_TWO],
    "BSD-3-Clause": [f"{BSD_TWO} {BSD_THIRD} {BSD_REST}", f"{BSD_TWO} {BSD_THIRD}"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"],
    "CC-BY-4.0": creative("Attribution", "BY"),
    "CC-BY-NC-4.0": creative("Attribution-NonCommercial", "BY-NC"),
    "CC-BY-SA-4.0": creative("Attribution-ShareAlike", "BY-SA"),
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        GPL_USE.format(kind="General Public License", n="2", stop=";"),
        GPL_USE.format(kind="General Public License", n="2", stop=";") + " " + GPL_HOPE.format(kind="General Public License") + " You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ],
    "GPL-3.0": gnu("General Public License", "3"),
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "LGPL-3.0": gnu("Lesser General Public License", "3"),
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", MIT_GRANT, f"{MIT_GRANT} {MIT_REST}"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely."],
}


def normal_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def plain_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def bigram(words: Column, i: Column) -> Column:
    """Hash of the words at places i and i + 1."""
    return F.xxhash64(F.get(words, i), F.get(words, i + 1))


def template_rows(spark: SparkSession, templates: dict[str, list[str]]) -> list:
    """(license, variant, n, b): words and the distinct bigrams' hashes of each template of two words or more; bounded by the list."""
    rows = [(k, v, plain_words(t)) for k, ts in sorted(templates.items()) for v, t in enumerate(ts) if len(plain_words(t)) > 1]
    df = spark.createDataFrame(rows, "license string, variant int, w array<string>")
    hashes = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: bigram(F.col("w"), i)))
    return df.select("license", "variant", F.size("w").alias("n"), hashes.alias("b")).collect()


def needed(bigrams: int, threshold: float) -> int:
    """Common bigrams that a coefficient of the threshold takes, even of a window that has no others: sizes a and b give 2 min(a, b) / (a + b) at most."""
    return max(1, math.ceil(bigrams * threshold / (2 - threshold) - 1e-9))


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, start_word, n_words, license, variant, dice): each place of a text that states a licence, wherever lines break.

    Words are lower-cased runs of letters and digits. A window has as many words as its template (or what is
    left of the text) and begins with one of its bigrams; windows with too few of them are pruned by size.
    From left to right, of windows that overlap the one with the best coefficient is reported: among equals the
    first, then the first licence in alphabetical order, then the first variant. Null and empty texts match
    nothing; repeated rows are scanned alike; a null doc_id is carried; other columns are left aside; an empty
    table gives none. No shuffle; a text is held as one array of hashes.
    """
    known = template_rows(docs.sparkSession, TEMPLATES if templates is None else templates)
    if not known:
        return docs.select("doc_id", F.lit(0).alias("start_word"), F.lit(0).alias("n_words"), F.lit("").alias("license"), F.lit(0).alias("variant"), F.lit(0.0).alias("dice")).where("false")
    every = sorted({h for t in known for h in t["b"]})
    rows = docs.where(F.col(text_col).isNotNull()).select("doc_id", F.col(text_col).alias("__text"))
    rows = bind(rows, "w", normal_words(F.col("__text"))).where("size(w) > 1").select("doc_id", "w")
    rows = bind(rows, "hs", F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: bigram(F.col("w"), i))).select("doc_id", "hs")
    least = min(needed(len(t["b"]), threshold) for t in known)
    rows = bind(rows, "hits", F.filter(F.sequence(F.lit(0), F.size("hs") - 1), lambda i: F.get("hs", i).isin(every))).where(F.size("hits") >= least)

    def windows(t) -> Column:
        """Scored windows of one template."""
        b, n, need = F.array(*map(F.lit, t["b"])), t["n"], needed(len(t["b"]), threshold)
        ats = F.filter("hits", lambda i: F.get("hs", i).isin(list(t["b"])))
        opens = lambda ats: F.filter(F.transform(ats, lambda at, k: F.when(F.get(ats, k + (need - 1)) - at < n - 1, at)), lambda at: at.isNotNull())
        # bound through a lambda, so that it is computed once
        starts = F.flatten(F.transform(F.array(ats), opens))
        own = lambda at: F.slice("hs", at + 1, n - 1)
        dice = lambda at: 2.0 * F.size(F.array_intersect(own(at), b)) / (F.size(F.array_distinct(own(at))) + len(t["b"]))
        made = F.transform(starts, lambda at: F.struct(at.alias("start"), (-dice(at)).alias("less"), F.lit(t["license"]).alias("license"), F.lit(t["variant"]).alias("variant"), F.least(F.lit(n), F.size("hs") + 1 - at).alias("n")))
        return F.filter(made, lambda x: x["less"] <= -threshold)

    found = bind(rows, "found", F.array_sort(F.concat(*map(windows, known)))).where("size(found) > 0").select("doc_id", "found")
    last = lambda acc: F.element_at(acc, -1)
    others = lambda acc: F.slice(acc, 1, F.size(acc) - 1)
    step = lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).when(x["start"] >= last(acc)["start"] + last(acc)["n"], F.concat(acc, F.array(x))).when(x["less"] < last(acc)["less"], F.concat(others(acc), F.array(x))).otherwise(acc)
    kept = F.aggregate("found", F.slice("found", 1, 0), step)
    out = found.select("doc_id", F.explode(kept).alias("x"))
    return out.select("doc_id", F.col("x.start").alias("start_word"), F.col("x.n").alias("n_words"), "x.license", "x.variant", F.round(-F.col("x.less"), 6).alias("dice"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every statement of a licence in every document."""
    return scan_licenses(table(spark, sf_dir, "documents"))
