"""Licence scans: tf-idf cosine of lines to notices, then inheritance from the nearest directory. DataFrame functions only."""

from __future__ import annotations

import functools
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terracite.session import cut, pick, small

#: Sentences by which a file's header or a licence file names its licence, in the order of the licences.
SENTENCES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software),"
     " to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,"
     " and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT OR Apache-2.0", "Licensed under either of Apache License, Version 2.0 or MIT license at your option."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v."),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
)
#: Licences of the GNU project, with their titles, versions and dates.
GNU = (
    ("GPL-2.0", "GNU General Public License", "2", "June 1991"),
    ("GPL-3.0", "GNU General Public License", "3", "29 June 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License", "2.1", "February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License", "3", "29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License", "3", "19 November 2007"),
)
GNU_SAYS = (
    "{title} Version {version}, {date}",
    "{title} version {version}",
    "This work is licensed under the {title}, version {version}.",
    "This library is licensed under the {title}, version {version}.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the {title} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
)
#: Other licences by their titles.
TITLES = (
    ("AFL-2.0", "Academic Free License, Version 2.0"), ("AFL-2.1", "Academic Free License, Version 2.1"), ("AFL-3.0", "Academic Free License, Version 3.0"),
    ("Apache-1.1", "Apache License, Version 1.1"), ("Apache-2.0", "Apache License, Version 2.0"), ("Artistic-2.0", "Artistic License 2.0"), ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"), ("BSL-1.0", "Boost Software License, Version 1.0"), ("EPL-1.0", "Eclipse Public License, Version 1.0"), ("EPL-2.0", "Eclipse Public License, Version 2.0"),
    ("EUPL-1.1", "European Union Public Licence, Version 1.1"), ("EUPL-1.2", "European Union Public Licence, Version 1.2"), ("ISC", "ISC License"), ("MIT", "MIT License"),
    ("MPL-1.1", "Mozilla Public License, Version 1.1"), ("MPL-2.0", "Mozilla Public License, Version 2.0"), ("Zlib", "zlib License"),
)
TITLES_SAY = ("Licensed under the {title}.", "Released under the {title}.", "This software is distributed under the terms of the {title}.", "This project is governed by a {title}.", "Use of this source code is governed by a {title} that can be found in the LICENSE file.", "The {title}")
#: Parts of Creative Commons licences, in their order.
COMMONS = (("BY", "Attribution"), ("BY-NC", "Attribution-NonCommercial"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"))
COMMONS_SAY = ("Licensed under CC {code} 4.0.", "This work is licensed under a Creative Commons {title} 4.0 International License.", "Creative Commons {title} 4.0 International")
NOTICES = (
    *SENTENCES,
    *[(name, say.format(title=title, version=version, date=date)) for name, title, version, date in GNU for say in GNU_SAYS],
    *[(name, say.format(title=title)) for name, title in TITLES for say in TITLES_SAY],
    *[(f"CC-{code}-4.0", say.format(code=code, title=title)) for code, title in COMMONS for say in COMMONS_SAY],
)
#: Words that tell licences apart. A statement and a notice must have the same of them, whatever their cosine.
MARKS = tuple(
    "academic affero apache artistic boost bsd cc0 cddl cecill eclipse epl eupl european fdl gnu isc lesser mit mozilla nc nd noderivatives noncommercial ofl openssl perl"
    " php postgresql python ruby sa sharealike unlicense w3c wtfpl x11 zlib 0 1 2 3 4 5 6 7 8 9".split()
)
#: A licence that any other stands before.
WEAKEST = "Proprietary"
#: An identifier states a licence by itself. Of its form, ``-only``, ``-or-later`` and ``+`` are not part of the name.
TAG = r"(?i)SPDX-License-Identifier:[\x20\t]*\(?([A-Za-z0-9][A-Za-z0-9.+-]*(?:[\x20]+(?:OR|AND|WITH)[\x20]+[A-Za-z0-9][A-Za-z0-9.+-]*)*)"
TAG_EXTRA = r"(?i)(?:-only|-or-later|\+)(?=[\x20]|$)"
#: Least cosine of a statement to a notice.
LEAST = 0.7
#: Between two statements.
_CUT = "\x1e"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    """ASCII words and numbers of a text, in lower case (the first or last may be empty)."""
    return F.split(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+")


def _words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


@functools.cache
def weights() -> dict[str, float]:
    """Inverse document frequency of each term of the notices, over the notices: the same for whatever table is scanned. Any other term has ``OUTSIDE``."""
    held = [set(_words(notice)) for _, notice in NOTICES]
    return {t: math.log((1 + len(held)) / (1 + sum(t in h for h in held))) + 1 for t in sorted(set().union(*held))}


#: Weight of a term that is in no notice.
OUTSIDE = math.log(1 + len(NOTICES)) + 1


@functools.cache
def keys() -> tuple[str, ...]:
    """Terms of which every statement holds one whose cosine to a notice is ``LEAST`` or more.

    Of each notice they are its heaviest terms, so many that the others' share of its norm alone is under ``LEAST``: by Cauchy-Schwarz, a statement
    with none of them is under it.
    """
    found: set[str] = set()
    for _, notice in NOTICES:
        squares = sorted(((n * weights()[t]) ** 2, t) for t, n in Counter(_words(notice)).items())
        total, rest = sum(w for w, _ in squares), 0.0
        for k, (square, _) in enumerate(squares):
            rest += square
            if rest >= (LEAST - 1e-5) ** 2 * total:
                found |= {t for _, t in squares[k:]}
                break
    return tuple(sorted(found))


def marks_of(text: Column) -> Column:
    return F.array_sort(F.array_intersect(terms(text), F.array(*[F.lit(m) for m in MARKS])))


def notice_terms(spark: SparkSession) -> DataFrame:
    """notice, licence, marks, term, unit (the term's share of the notice's unit vector)."""
    rows = []
    for k, (name, text) in enumerate(NOTICES):
        counts = Counter(_words(text))
        norm = math.sqrt(sum((n * weights()[t]) ** 2 for t, n in counts.items()))
        marks = sorted(set(counts) & set(MARKS))
        rows += [(k, name, marks, t, n * weights()[t] / norm) for t, n in counts.items()]
    return spark.createDataFrame(rows, "notice int, licence string, marks array<string>, term string, unit double")


@functools.cache
def by_marks() -> dict[str, list[dict[str, float]]]:
    """The unit vectors of the notices, by their MARKS (sorted, joined by spaces)."""
    found: dict[str, list[dict[str, float]]] = {}
    for _, notice in NOTICES:
        values = {t: n * weights()[t] for t, n in Counter(_words(notice)).items()}
        norm = math.sqrt(sum(v * v for v in values.values()))
        found.setdefault(" ".join(sorted(set(values) & set(MARKS))), []).append({t: v / norm for t, v in values.items()})
    return found


def with_paths(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: a directory for every 1,000 and, below it, every 200 ids of a source; of each
    200 ids, the first 20 are LICENSE files of the upper directory and 20 more of the lower one."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    top = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce(F.expr("doc_id div 1000").cast("string"), F.lit("none")))
    low = F.concat_ws("/", top, F.coalesce(F.expr("doc_id div 200 % 5").cast("string"), F.lit("none")))
    path = (
        F.when(F.expr("doc_id div 20 % 10 = 0"), F.concat(top, F.lit("/LICENSE")))
        .when(F.expr("doc_id div 20 % 5 = 0"), F.concat(low, F.lit("/LICENSE")))
        .otherwise(F.concat(low, F.lit("/"), name, F.lit(".txt")))
    )
    return docs.select("doc_id", "text", path.alias("path"))


def statements(text: Column) -> Column:
    """What is compared: every line, and every sentence of each paragraph, so that a notice may be wrapped or follow others."""
    ended = F.regexp_replace(text, r"([.;!?])[\x20\x09-\x0D]+", f"$1{_CUT}")
    sentences = F.split(F.regexp_replace(ended, r"\n[\x20\x09-\x0D]*\n", _CUT), _CUT)
    return F.array_distinct(F.concat(F.split(text, "\n"), sentences))


def reachable(text: Column) -> Column:
    """The statements of a text with an identifier, or with one of ``keys``, without those whose cosine to any notice is certainly under ``LEAST``.

    A cosine is at most the share of the statement's norm that lies in terms of the notices (Cauchy-Schwarz). Each other
    term weighs OUTSIDE, and k of them in n places have a sum of squared counts of n * n / k or more. With that bound on the norm, the products
    with the notices of the statement's MARKS decide: a paragraph of words that notices share with any prose is near none of them, however
    many near copies of it there are.
    """
    known, most = list(weights()), OUTSIDE
    squares = F.create_map(*[F.lit(v) for t in known for v in (t, weights()[t] ** 2)])
    listed, needed = F.array(*[F.lit(t) for t in known]), F.array(*[F.lit(t) for t in keys()])
    split = F.transform(statements(text), lambda line: F.struct(line.alias("line"), terms(line).alias("words")))
    named = F.filter(split, lambda x: F.arrays_overlap(x["words"], needed) | F.array_contains(x["words"], "spdx"))
    met = F.transform(named, lambda x: F.struct(x["line"].alias("line"), x["words"].alias("words"), F.array_intersect(x["words"], listed).alias("known")))

    share = (LEAST - 1e-5) ** 2  # cosines are rounded
    often = lambda words, t: (F.size(words) - F.size(F.array_remove(words, t))).cast("double")

    def norms(x: Column) -> tuple[Column, Column]:
        words, known = x["words"], x["known"]
        inside = F.aggregate(known, F.lit(0.0), lambda s, t: s + F.element_at(squares, t) * often(words, t) * often(words, t))
        places = F.size(words) - F.aggregate(known, often(words, F.lit("")), lambda s, t: s + often(words, t))
        others = F.size(F.array_distinct(words)) - F.size(known) - F.array_contains(words, "").cast("int")
        return inside, places * places / F.greatest(others, F.lit(1)) * (most * most)

    def kept(x: Column) -> Column:
        inside, outside = norms(x)
        return ((F.size(x["known"]) > 0) & (inside * (1 - share) >= outside * share)) | (F.array_contains(x["words"], "spdx") & x["line"].rlike(TAG))

    def weighed(x: Column) -> Column:
        inside, outside = norms(x)
        values = F.transform(x["known"], lambda t: F.struct(t.alias("term"), (F.sqrt(F.element_at(squares, t)) * often(x["words"], t)).alias("value")))
        marks = F.array_join(F.array_sort(F.array_intersect(x["known"], F.array(*[F.lit(m) for m in MARKS]))), " ")
        tag = F.array_contains(x["words"], "spdx") & x["line"].rlike(TAG)
        return F.struct(x["line"].alias("line"), values.alias("values"), (inside + outside).alias("norm"), marks.alias("marks"), tag.alias("tag"))

    units = F.create_map(
        *[v for marks, group in by_marks().items() for v in (F.lit(marks), F.array(*[F.create_map(*[F.lit(v) for pair in unit.items() for v in pair]) for unit in group]))]
    )

    def near(x: Column) -> Column:
        dot = lambda unit: F.aggregate(x["values"], F.lit(0.0), lambda s, v: s + v["value"] * F.coalesce(F.try_element_at(unit, v["term"]), F.lit(0.0)))
        return x["tag"] | F.coalesce(F.exists(F.try_element_at(units, x["marks"]), lambda unit: dot(unit) >= F.sqrt(share * x["norm"])), F.lit(False))

    found = F.transform(F.filter(F.transform(F.filter(met, kept), weighed), near), lambda x: x["line"])
    every = terms(text)
    return F.when(F.arrays_overlap(every, needed) | F.array_contains(every, "spdx"), found)


def scan(files: DataFrame) -> DataFrame:
    """The licence of every file: by a notice in its own text, else that of the nearest directory above it.

    files: doc_id, text, path. Every line, and every sentence of a paragraph, of the whole text is weighed by tf-idf, with document frequencies over the notices
    (a term outside them counts as one that none has), so that what a file is found to be does not depend on other files. It is
    compared with each notice of the same MARKS that it shares another word with; the best cosine of ``LEAST`` or more names the licence. An identifier
    (TAG) stands before any notice, and names what it says, known or not; ``WEAKEST`` stands behind all others; ties go to the smaller
    name. However many files hold a notice, none of its statements is passed over: see ``reachable``. A directory has the licence that its LICENSE file states (of several, the best match). A file without a notice takes that of
    its own directory or the nearest above: only directories, not files, are spread over their ancestors and joined.

    Equal statements are scored once, so one that a third of all files hold costs one row. Null or empty text states no
    licence and inherits like others. Null path: no inheritance. Repeated rows stay. Empty table: no rows. Other
    columns are ignored.

    Returns doc_id, path, licence (null if none), basis (notice, inherited, none), directory (whose licence is inherited).
    """
    spark = files.sparkSession
    files = pick(files, "doc_id", "text", "path")
    idf = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for t, w in weights().items() for v in (t, w)]), F.col("term")), F.lit(OUTSIDE))
    slim = cut(files.select("doc_id", "path", F.coalesce(reachable(F.col("text")), F.array().cast("array<string>")).alias("lines"), F.monotonically_increasing_id().alias("row")))
    lines = slim.select(F.explode("lines").alias("line")).distinct()
    named = F.regexp_replace(F.rtrim(F.regexp_extract("line", TAG, 1), F.lit(".")), TAG_EXTRA, "")
    order = lambda rank, cosine, licence: F.struct(rank.alias("rank"), (-cosine).alias("less"), licence.alias("licence"))
    tagged = lines.where(F.col("line").rlike(TAG)).select("line", order(F.lit(0), F.lit(1.0), named).alias("best"))
    counted = lines.where(~F.col("line").rlike(TAG)).select("line", F.explode(terms(F.col("line"))).alias("term")).where("term <> ''").groupBy("line", "term").agg(F.count(F.lit(1)).alias("tf"))
    weighed = cut(counted.withColumn("weight", F.col("tf") * idf))
    norms = weighed.groupBy("line").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm")).withColumn("of_line", marks_of(F.col("line")))
    plain = F.sum((~F.col("term").isin(*MARKS)).cast("int")).alias("plain")
    dots = weighed.join(F.broadcast(notice_terms(spark)), "term").groupBy("line", "notice", "licence", "marks").agg(F.sum(F.col("weight") * F.col("unit")).alias("dot"), plain)  # the fixed notices
    cosine = F.round(F.col("dot") / F.col("norm"), 6)
    fits = (cosine >= LEAST) & (F.col("marks") == F.col("of_line")) & (F.col("plain") > 0)
    scored = dots.join(norms, "line").where(fits).groupBy("line").agg(F.min(order(F.when(F.col("licence") == WEAKEST, 2).otherwise(1), cosine, F.col("licence"))).alias("best"))
    best = cut(scored.unionByName(tagged))
    stated = cut(slim.select("row", F.explode("lines").alias("line")).join(small(best), "line").groupBy("row").agg(F.min("best").alias("best")))

    own = cut(
        slim.join(stated, "row", "left").select(
            "doc_id", "path", "best", F.expr("left(path, greatest(0, length(path) - length(substring_index(path, '/', -1)) - 1))").alias("folder")
        )
    )
    licensed = own.where("best is not null and path is not null and substring_index(path, '/', -1) = 'LICENSE'").groupBy("folder").agg(F.min("best").alias("given"))
    folders = own.where("folder is not null").select("folder").distinct()
    above = folders.select(
        "folder", F.explode(F.expr("transform(sequence(1, size(split(folder, '/'))), k -> array_join(slice(split(folder, '/'), 1, k), '/'))")).alias("ancestor")
    )
    nearest = (
        above.join(licensed.withColumnRenamed("folder", "ancestor"), "ancestor")
        .groupBy("folder")
        .agg(F.max_by(F.struct("ancestor", F.col("given.licence").alias("licence")), F.length("ancestor")).alias("from"))
    )
    licence = F.coalesce("best.licence", "from.licence")
    basis = F.when(F.col("best").isNotNull(), "notice").when(F.col("from").isNotNull(), "inherited").otherwise("none")
    directory = F.when(F.col("best").isNull(), F.col("from.ancestor"))
    return own.join(nearest, "folder", "left").select("doc_id", "path", licence.alias("licence"), basis.alias("basis"), directory.alias("directory"))


def scan_sql() -> str:
    """The rows of ``scan`` over ``with_paths`` of the view ``documents``, in DuckDB SQL."""
    notices = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(NOTICES))
    marks = ", ".join(f"'{k}'" for k in MARKS)
    tag, extra = TAG.replace("'", "''"), r"(?i)(-only|-or-later|\+)([\x20]|$)"
    lower = f"translate({{}}, '{_UPPER}', '{_LOWER}')"
    top = "coalesce(source, 'none') || '/' || coalesce(CAST(doc_id // 1000 AS VARCHAR), 'none')"
    low = f"{top} || '/' || coalesce(CAST(doc_id // 200 % 5 AS VARCHAR), 'none')"
    return f"""
WITH notices(notice, licence, body) AS (VALUES {notices}),
notice_terms AS (SELECT notice, licence, unnest(regexp_extract_all({lower.format("body")}, '[a-z0-9]+')) AS term FROM notices),
files AS (
  SELECT row_number() OVER () AS row, doc_id, text, CASE WHEN doc_id // 20 % 10 = 0 THEN {top} || '/LICENSE' WHEN doc_id // 20 % 5 = 0 THEN {low} || '/LICENSE'
         ELSE {low} || '/' || coalesce(CAST(doc_id AS VARCHAR), 'none') || '.txt' END AS path FROM documents),
total AS (SELECT count(*) AS n FROM notices),
idf AS (SELECT term, ln((1.0 :: DOUBLE + n) / (1.0 :: DOUBLE + count(DISTINCT notice))) + 1 AS idf FROM notice_terms, total GROUP BY term, n),
notice_marks AS (SELECT notice, list_sort(coalesce(list(DISTINCT term) FILTER (term IN ({marks})), [])) AS marks FROM notice_terms GROUP BY notice),
ended AS (SELECT row, text, regexp_replace(regexp_replace(text, '([.;!?])[\\x20\\x09-\\x0D]+', '\\1' || chr(30), 'g'), '\\n[\\x20\\x09-\\x0D]*\\n', chr(30), 'g') AS cut FROM files),
lines AS (SELECT DISTINCT row, unnest(list_concat(string_split(text, chr(10)), string_split(cut, chr(30)))) AS line FROM ended),
words AS (SELECT DISTINCT line FROM lines),
tf AS (SELECT line, term, count(*) AS tf FROM (SELECT line, unnest(regexp_extract_all({lower.format("line")}, '[a-z0-9]+')) AS term FROM words) GROUP BY line, term),
tagged AS (SELECT line, regexp_replace(rtrim(regexp_extract(line, '{tag}', 1), '.'), '{extra}', '\\2', 'g') AS licence FROM words WHERE regexp_matches(line, '{tag}')),
weighed AS (SELECT line, term, tf * coalesce(idf, ln(1.0 :: DOUBLE + n) + 1) AS weight FROM tf LEFT JOIN idf USING (term), total WHERE line NOT IN (SELECT line FROM tagged)),
line_marks AS (SELECT line, list_sort(coalesce(list(DISTINCT term) FILTER (term IN ({marks})), [])) AS of_line FROM tf GROUP BY line),
norms AS (SELECT line, sqrt(sum(weight * weight)) AS norm FROM weighed GROUP BY line),
unit AS (SELECT notice, licence, term, weight / sqrt(sum(weight * weight) OVER (PARTITION BY notice)) AS unit
         FROM (SELECT notice, licence, term, count(*) * any_value(idf) AS weight FROM notice_terms JOIN idf USING (term) GROUP BY ALL)),
scored AS (SELECT line, licence, CASE WHEN licence = '{WEAKEST}' THEN 2 ELSE 1 END AS rank, round(sum(weight * unit) / any_value(norm), 6) AS cosine FROM weighed JOIN unit USING (term) JOIN norms USING (line) JOIN notice_marks USING (notice) JOIN line_marks USING (line)
  WHERE marks = of_line GROUP BY line, notice, licence HAVING count(*) FILTER (term NOT IN ({marks})) > 0
  UNION ALL SELECT line, licence, 0, 1.0 FROM tagged),
stated AS (SELECT row, licence, cosine, rank FROM lines JOIN scored USING (line) WHERE cosine >= {LEAST} QUALIFY row_number() OVER (PARTITION BY row ORDER BY rank, cosine DESC, licence) = 1),
own AS (SELECT row, doc_id, path, licence, cosine, rank, regexp_replace(path, '/[^/]*$', '') AS folder FROM files LEFT JOIN stated USING (row)),
given AS (SELECT folder AS ancestor, licence AS inherited FROM own WHERE path LIKE '%/LICENSE' AND licence IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY folder ORDER BY rank, cosine DESC, licence) = 1),
nearest AS (SELECT folder, ancestor, inherited FROM (SELECT DISTINCT folder FROM own) JOIN given ON folder = ancestor OR starts_with(folder, ancestor || '/')
            QUALIFY row_number() OVER (PARTITION BY folder ORDER BY length(ancestor) DESC) = 1)
SELECT doc_id, path, coalesce(licence, inherited) AS licence,
       CASE WHEN licence IS NOT NULL THEN 'notice' WHEN inherited IS NOT NULL THEN 'inherited' ELSE 'none' END AS basis,
       CASE WHEN licence IS NULL THEN ancestor END AS directory
FROM own LEFT JOIN nearest USING (folder)
"""
