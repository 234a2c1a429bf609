"""License scans by diagonal voting, with DataFrame operations only.

Every rolling word k-gram of a text meets the template positions with the same k-gram. A hit votes for the
diagonal text position - template position; votes are counted by diagonal, neighbouring diagonals (a few words
added or left out) are merged. A merged span is verified by the template positions that it holds, each counted once:
they must be enough of the template, and fill enough of the span's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import documents

#: Fixed phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Sentences and whole texts of public licenses and notices, by label.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the
     software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
     and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall
     be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but
     not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be
     liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the
     use or other dealings in the software"""),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1
     redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must
     reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the
     distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
     without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties
     including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright
     holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of
     substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict
     liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
     and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all
     implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages
     whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with
     the use or performance of this software"""),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of
     this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
     subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use
     this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly
     marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution"""),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software
     either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"""),
    ("apache", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at
     http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as
     is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations
     under the license"""),
    ("gpl", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software
     foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any
     warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should
     have received a copy of the gnu general public license along with this program"""),
    ("lgpl", """this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free
     software foundation either version 2 1 of the license or at your option any later version this library is distributed in the hope that it will be useful but
     without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more
     details"""),
    ("mpl", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one
     at http mozilla org mpl 2 0"""),
]
K = 4  # words a k-gram of the templates
P = 2  # words a k-gram of the phrases
NEIGHBOURS = 3  # diagonals that far apart are merged
LEAST = 0.5  # of a template's k-grams must be in a span
FILLED = 0.5  # of a span's words must be in k-grams of the template
KELVIN = "K"  # lower() makes it an ASCII k, which A-Z lower-casing does not


def words_of(text: Column) -> Column:
    """Words in order, A-Z lower-cased: runs of ASCII letters and digits and of all characters beyond ASCII. Null: none."""
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit("ĸ")))
    return F.regexp_extract_all(plain, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def grams(phrases: dict[str, str], templates: list[tuple[str, str]]) -> list[tuple]:
    """(k-gram, template, label, phrase, position, k-grams of the template, shortest text position offset)."""
    out = []
    for n, (words, label, phrase, k) in enumerate([(p.split(), v, True, P) for p, v in phrases.items()] + [(t.split(), v, False, K) for v, t in templates]):
        count = len(words) - k + 1
        if count < 1:
            raise ValueError(f"a template needs {k} words: {' '.join(words)}")
        out += [(" ".join(words[i : i + k]), n, label, phrase, i, count) for i in range(count)]
    return out


def hits(docs: DataFrame, id_col: str, text_col: str, phrases: dict[str, str], templates: list[tuple[str, str]]) -> DataFrame:
    """(id, h1, h2, n_words, template, label, phrase, at, i, grams, k) for each k-gram that a template has, and a row with null template for each text.

    h1 and h2 name the text, so that a row is known by what is in it, whatever order it is read in.
    """
    spark = docs.sparkSession
    table = spark.createDataFrame([(*g, len(g[0].split())) for g in grams(phrases, templates)], "gram string, template int, label string, phrase boolean, i int, grams int, k int")
    table = table.withColumn("hash", F.xxhash64("gram", "k")).unionByName(spark.range(1).select(F.lit("").alias("gram"), *[F.lit(None).cast(t).alias(c) for c, t in (("template", "int"), ("label", "string"), ("phrase", "boolean"), ("i", "int"), ("grams", "int"))], F.lit(0).alias("k"), F.xxhash64(F.lit(""), F.lit(0)).alias("hash")))
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.lit(1), text_col).alias("h1"), F.xxhash64(F.lit(2), text_col).alias("h2"), words_of(F.col(text_col)).alias("words"))
    base = base.withColumn("n_words", F.size("words"))
    places = base.select("id", "h1", "h2", "n_words", "words", F.explode(F.sequence(F.lit(0), F.col("n_words"))).alias("at"))
    run = lambda k: F.when(F.col("at") + k <= F.col("n_words"), F.concat_ws(" ", *[F.get("words", F.col("at") + j) for j in range(k)]))
    each = F.array(*[F.struct(run(k).alias("gram"), F.lit(k).alias("k")) for k in (P, K)], F.struct(F.when(F.col("at") == F.col("n_words"), F.lit("")).alias("gram"), F.lit(0).alias("k")))
    rolled = places.select("id", "h1", "h2", "n_words", "at", F.inline(each)).where("gram is not null")
    rolled = rolled.withColumn("hash", F.xxhash64("gram", "k"))
    # The templates are a parameter of a few pages: some two thousand rows.
    return rolled.withColumnsRenamed({"gram": "seen", "k": "seen_k"}).join(F.broadcast(table), "hash").where("seen = gram and seen_k = k").select("id", "h1", "h2", "n_words", "template", "label", "phrase", "at", "i", "grams", "k")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """Licenses of each text: (id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, spans), one row per input row.

    n_base: places where a phrase's words stand in a row, each counted; first_word and last_word are the smallest
    and largest of their starts, null without one. base_labels are the phrases' labels, labels those and the ones
    of verified template spans; distinct, sorted, joined by commas, else empty. score: 1 if a phrase is found, else
    the best share of a template's k-grams in one span, 0 without any. spans: verified spans as label:first-last words,
    in order of text, joined by commas. Null and empty texts have no words and score 0; rows that repeat an id or a
    text each keep their row; null ids stay null; an empty table gives no rows; other columns are not read.
    """
    found = hits(docs, id_col, text_col, PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)
    row = ["id", "h1", "h2", "n_words"]
    kind = ["template", "label", "phrase", "grams", "k"]
    # Rows of the same id and text vote together: all counts are of different positions, and copies says how many they are.
    votes = found.groupBy(*row, *kind, (F.col("at") - F.col("i")).alias("diagonal")).agg(F.collect_set("i").alias("held"), F.count("*").alias("copies"), F.min("at").alias("low"), F.max("at").alias("high"))
    order = W.partitionBy(*row, "template").orderBy("diagonal")
    apart = F.when(F.col("phrase") | (F.col("diagonal") - F.lag("diagonal").over(order) > NEIGHBOURS), 1).otherwise(0)
    spans = votes.withColumn("span", F.sum(apart).over(order.rowsBetween(W.unboundedPreceding, 0)))
    spans = spans.groupBy(*row, *kind, "span").agg(F.min("diagonal").alias("start"), F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("votes"), F.max("copies").alias("copies"), F.min("low").alias("low"), F.max("high").alias("high"))
    share = F.col("votes") / F.col("grams")
    whole = F.col("phrase") & (F.col("votes") == F.col("grams"))
    last = F.col("high") + F.col("k") - 1
    verified = ~F.col("phrase") & (share >= LEAST) & (F.col("votes") + F.col("k") - 1 >= FILLED * (last - F.col("low") + 1))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    where = F.struct("low", last.alias("last"), "label", "template")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(verified, where))), lambda x: F.concat(x["label"], F.lit(":"), x["low"], F.lit("-"), x["last"])), ",")
    out = spans.groupBy(*row).agg(
        F.count_if(whole).alias("n_base"),
        F.min(F.when(whole, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(whole, F.col("start"))).cast("long").alias("last_word"),
        listed(whole).alias("base_labels"),
        listed(whole | verified).alias("labels"),
        F.coalesce(F.max(F.when(whole, 1.0).when(~F.col("phrase"), F.round(F.least(share, F.lit(1.0)), 6))), F.lit(0.0)).alias("score"),
        text.alias("spans"),
        F.max(F.when(F.col("template").isNull(), F.col("copies"))).cast("int").alias("copies"),
    )
    out = out.withColumn("copies", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return out.select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places and license labels of every document."""
    return scan(documents(spark, sf_dir))


def oracle() -> str:
    """The scan as SQL: template k-grams as strings, no hashes."""
    rows = ", ".join(f"('{g}', {n}, '{label}', {str(phrase).lower()}, {i}, {count}, {len(g.split())})" for g, n, label, phrase, i, count in grams(PHRASES, TEMPLATES))
    return rf"""
WITH t(gram, template, label, phrase, i, grams, k) AS (VALUES {rows}),
w AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
p AS (SELECT rid, words, unnest(range(len(words))) AS "at" FROM w),
g AS (SELECT rid, "at", k, array_to_string(words["at" + 1 : "at" + k], ' ') AS gram FROM p, (VALUES ({P}), ({K})) x(k) WHERE "at" + k <= len(words)),
v AS (SELECT rid, template, label, phrase, grams, k, "at", i, "at" - i AS diagonal FROM g JOIN t USING (gram, k)),
s AS (SELECT *, sum(apart) OVER (PARTITION BY rid, template ORDER BY diagonal) AS span FROM (
  SELECT *, CASE WHEN phrase OR diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) > {NEIGHBOURS} THEN 1 ELSE 0 END AS apart FROM (SELECT DISTINCT rid, template, phrase, diagonal FROM v))),
m AS (SELECT rid, template, label, v.phrase, grams, k, span, min(diagonal) AS start, count(DISTINCT i) AS votes, min("at") AS low, max("at" + k) - 1 AS last FROM v JOIN s USING (rid, template, diagonal) GROUP BY ALL),
f AS (SELECT *, phrase AND votes = grams AS whole, NOT phrase AND votes / grams >= {LEAST} AND votes + k - 1 >= {FILLED} * (last - low + 1) AS verified FROM m),
a AS (SELECT rid, count(*) FILTER (whole) AS n_base, min(start) FILTER (whole) AS first_word, max(start) FILTER (whole) AS last_word,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (whole)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (whole OR verified)), ','), '') AS labels,
  coalesce(array_to_string(list(label || ':' || low || '-' || last ORDER BY low, last, label, template) FILTER (verified), ','), '') AS spans,
  coalesce(max(CASE WHEN whole THEN 1.0 WHEN NOT phrase THEN round(least(votes / grams, 1.0), 6) END), 0) AS score FROM f GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score, coalesce(spans, '') AS spans FROM w LEFT JOIN a USING (rid)
"""
