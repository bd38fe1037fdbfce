"""License scans by diagonal voting, in DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotplane.llm.secrets import let

#: ASCII characters between words; all others are parts of words, A-Z in lower case (fixed values of the contract).
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
#: Base phrases and their labels (fixed values of the contract).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Whole texts of licenses (fixed values).
MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
GPL_TEXT = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
APACHE_TEXT = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
#: Notices, whole texts and their labels.
TEMPLATES = [
    ("mit", MIT_TEXT),
    ("isc", ISC_TEXT),
    ("bsd", BSD_TEXT),
    ("gpl", GPL_TEXT),
    ("apache", APACHE_TEXT),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("lgpl", "of the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
#: Words of a gram, steps between diagonals that are merged, and the share of a template's grams that makes a match.
GRAM, GAP, COVER = 4, 3, 0.6


def words_of(text: Column) -> Column:
    """The words of a text: one pass maps A-Z to lower case and whatever stands between words to spaces."""
    return F.array_remove(F.split(F.translate(text, UPPER + BETWEEN, UPPER.lower() + " " * len(BETWEEN)), " ", -1), "")


def template_grams(gram: int = GRAM) -> list[tuple[str, int, int, int, str]]:
    """(label, template, place, number of grams, gram) of all templates."""
    out = []
    for k, (label, notice) in enumerate(TEMPLATES):
        w = re.findall("[a-z0-9]+", notice.lower())
        n = len(w) - gram + 1
        out += [(label, k, i, n, " ".join(w[i : i + gram])) for i in range(n)]
    return out


def n_words(piece: Column) -> Column:
    return F.size(F.array_remove(F.split(piece, " ", -1), ""))


def phrase_hits(joined: Column, phrase: str, label: str) -> Column:
    """Places of a phrase in words joined by two spaces, one at either end; null without any: how many, words before the
    first, words from the last on. Every word has its own spaces, so phrases next to each other are all found."""

    def body(pieces: Column) -> Column:
        return F.when(F.size(pieces) > 1, F.struct(F.lit(label).alias("label"), (F.size(pieces) - 1).alias("n"), n_words(F.element_at(pieces, 1)).alias("first"), (n_words(F.element_at(pieces, -1)) + len(phrase.split())).alias("last")))

    return let(F.split(joined, " " + "  ".join(phrase.split()) + " ", -1), body)


def scan_licenses(docs: DataFrame, gram: int = GRAM, cover: float = COVER) -> DataFrame:
    """Finds license phrases and notices in every whole text.

    Returns a row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.
    Null texts count as empty. Rows that repeat an id with another text are told apart by a hash of the text; equal rows
    get equal results. Null ids pass through, other columns are left out. The score is 1 with a base phrase, else the
    best match's share of its template's grams, else 0.

    All rolling word grams of all texts are joined by hash with the templates' places (a constant table of a few
    thousand rows, so it is broadcast; the grams themselves are compared, too). Votes are gathered by diagonal, the gram's
    place in the text less its place in the template, as a set of template places, no more than the template has, so a
    repeated row votes once. Diagonals a few steps apart are merged, and spans are verified: enough of the template, in about its length.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", words_of(text).alias("words"), F.xxhash64(text).alias("h"))

    places = spark.createDataFrame(template_grams(gram), "label string, template int, tpos int, n_grams int, tgram string").withColumn("thash", F.xxhash64("tgram"))
    grams = let(F.col("words"), lambda w: F.when(F.size(w) >= gram, F.transform(F.sequence(F.lit(0), F.size(w) - gram), lambda i: F.concat_ws(" ", *(F.get(w, i + j) for j in range(gram))))))
    rolled = d.select("doc_id", "h", F.posexplode(grams).alias("pos", "gram")).withColumn("hash", F.xxhash64("gram"))
    votes = rolled.join(F.broadcast(places), (F.col("hash") == F.col("thash")) & (F.col("gram") == F.col("tgram"))).select("doc_id", "h", "label", "template", "n_grams", "pos", "tpos", (F.col("pos") - F.col("tpos")).alias("diagonal"))
    by_diagonal = votes.groupBy("doc_id", "h", "label", "template", "n_grams", "diagonal").agg(F.collect_set("tpos").alias("hit"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    along = Window.partitionBy("doc_id", "h", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > GAP, F.lit(True)).cast("int")
    merged = by_diagonal.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(along)).groupBy("doc_id", "h", "template", "label", "n_grams", "run").agg(F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    share = F.size("hit") / F.col("n_grams")
    matches = merged.where((share >= cover) & (F.col("hi") - F.col("lo") + gram <= 1.5 * (F.col("n_grams") + gram - 1)))
    found = matches.groupBy("doc_id", "h").agg(F.collect_set("label").alias("more"), F.max(share).alias("best")).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "more", "best")

    none = F.array().cast("array<struct<label:string,n:int,first:int,last:int>>")
    joined = F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" "))
    hits = let(joined, lambda j: F.array_compact(F.array(*(phrase_hits(j, p, label) for p, label in PHRASES.items()))))
    rows = d.select("doc_id", "h", F.size("words").cast("long").alias("n_words"), F.when(F.array_contains("words", "license"), hits).otherwise(none).alias("hits"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    base = F.transform("hits", lambda x: x["label"])
    n_base = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    return rows.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.array_min(F.transform("hits", lambda x: x["first"].cast("long"))).alias("first_word"),
        (F.col("n_words") - F.array_min(F.transform("hits", lambda x: x["last"].cast("long")))).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("hits") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def oracle(gram: int = GRAM, cover: float = COVER) -> str:
    """The same scan in SQL: phrases by words side by side, votes by a join of all grams."""
    grams = ", ".join(f"('{label}', {k}, {i}, {n}, '{g}')" for label, k, i, n, g in template_grams(gram))
    starts = " union all ".join(f"select rid, i, '{label}' as label from x where " + " and ".join(f"w{j} = '{w}'" for j, w in enumerate(p.split())) for p, label in PHRASES.items())
    return f"""
with t(label, template, tpos, n, gram) as (values {grams}), d as (
  select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
), u as (
  select rid, w, unnest(range(0, len(w))) as i from d
), x as (
  select rid, i, w[i + 1] as w0, w[i + 2] as w1, w[i + 3] as w2, case when i + {gram} <= len(w) then array_to_string(w[i + 1:i + {gram}], ' ') end as gram from u
), s as ({starts}), b as (
  select rid, count(*) as n_base, min(i) as first_word, max(i) as last_word from s group by 1
), v as (
  select x.rid, t.label, t.template, t.n, x.i - t.tpos as diagonal, list(distinct t.tpos) as hit, min(x.i) as lo, max(x.i) as hi from x join t on x.gram = t.gram group by 1, 2, 3, 4, 5
), f as (
  select *, case when diagonal - lag(diagonal) over (partition by rid, template order by diagonal) <= {GAP} then 0 else 1 end as fresh from v
), r as (
  select *, sum(fresh) over (partition by rid, template order by diagonal rows unbounded preceding) as run from f
), m as (
  select rid, label, template, n, run, list_distinct(flatten(list(hit))) as hit, min(lo) as lo, max(hi) as hi from r group by 1, 2, 3, 4, 5
), k as (
  select rid, label, len(hit) / cast(n as double) as share from m where len(hit) / cast(n as double) >= {cover}e0 and hi - lo + {gram} <= 1.5e0 * (n + {gram - 1})
), l as (
  select rid, label from k union select rid, label from s
), j as (
  select rid, string_agg(label, ',' order by label) as labels from l group by 1
), jb as (
  select rid, string_agg(label, ',' order by label) as base_labels from (select distinct rid, label from s) group by 1
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(b.n_base, 0) as n_base, b.first_word, b.last_word, coalesce(jb.base_labels, '') as base_labels, coalesce(j.labels, '') as labels,
  case when b.n_base > 0 then 1 else coalesce((select max(share) from k where k.rid = d.rid), 0) end as score
from d left join b on d.rid = b.rid left join j on d.rid = j.rid left join jb on d.rid = jb.rid
"""
