"""Licence scan by a positional rare-token index (operator 7). DataFrame operations only.

Templates are word sequences with one mandatory key phrase each. The index lists, for every template,
the two words of its key phrase with the highest IDF over the whole corpus, with their positions in
the template. A document's words are looked up in it; two postings that agree in relative position name
the only place where the template could stand, the key phrase is verified there, and the share of the
template's words found at their places is the template's score (``SHARE`` of them make a match).
Key phrases of the four base templates are the phrases themselves, so every base place is found.

Defined cases: a null text has no words; ids may be null or repeat (a row is scanned for itself);
an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_WORD, lower_az, table

#: The phrases and labels of the contract.
BASE = (
    ("gpl", "gnu general public license", "gnu general public license"),
    ("apache", "apache license", "apache license"),
    ("cc-by", "cc by", "cc by"),
    ("mit", "mit license", "mit license"),
)
#: Labels of our own: label, template (a notice or the opening of a licence's text), mandatory key phrase. Wordings of public licences.
MORE = (
    ("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "either version 3 of the license"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "either version 2 of the license"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "except in compliance with the license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted"),
    ("mit-text", "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "merge publish distribute sublicense"),
    ("bsd", "redistribution and use in source and binary forms with or without modification", "source and binary forms"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions of source code must retain"),
    ("mpl-2.0", "mozilla public license version 2 0", "mozilla public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "a copy of the mpl"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd", "cc by nd"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc0", "has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", "waiving all of his or her rights"),
    ("isc", "permission to use copy modify and or distribute this software", "copy modify and or distribute"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "to alter it and redistribute it freely"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "software and accompanying documentation covered"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "publish use compile sell or distribute"),
)
SHARE = 0.8
#: What stands between words, of a text in lower case.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAPS = "".join(chr(i) for i in range(128) if not (48 <= i < 58 or 97 <= i < 123))


def document_words(text: Column) -> Column:
    """Words by cutting at the gaps, which Java does far faster than collecting matches."""
    inner = F.btrim(lower_az(F.coalesce(text, F.lit(""))), F.lit(_GAPS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, _GAP))


def rarity(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """In how many documents each licence word stands (the vocabulary is the templates' own)."""
    vocabulary = sorted({w for _, _, key in BASE + MORE for w in key.split()})
    known = F.array(*[F.lit(w) for w in vocabulary])
    found = docs.select(F.explode(F.array_intersect(known, document_words(F.col(text)))).alias("w"))
    count = {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: count.get(w, 0) for w in vocabulary}


def _starts(template: str, key: str, in_docs: dict[str, int]) -> Column:
    """Where the template would begin (it may begin before the text), by the rarest words of its key."""
    t, k = template.split(), key.split()
    at = next(i for i in range(len(t)) if t[i : i + len(k)] == k)
    first, *second = sorted(range(len(k)), key=lambda i: (in_docs[k[i]], i))[:2]
    w = F.col("_w")

    def fits(p: Column) -> Column:
        ok = (w[p] == k[first]) & (p >= first) & (p - first + len(k) <= F.col("n_words"))
        for i in second:  # the second posting at the same relative position
            ok = ok & (F.get(w, p + (i - first)) == k[i])
        return ok & (F.slice(w, p - first + 1, len(k)) == F.array(*[F.lit(x) for x in k]))

    return F.transform(F.filter(F.col("_p"), fits), lambda p: p - (first + at))


def _shares(template: str, starts: Column) -> Column:
    """For each start, the share of the template's words that stand at their places."""
    t = template.split()
    words = F.array(*[F.lit(x) for x in t])

    def share(p: Column) -> Column:
        hits = F.filter(F.sequence(F.lit(0), F.lit(len(t) - 1)), lambda j: F.get(F.col("_w"), p + j) == F.get(words, j))
        return F.size(hits) / F.lit(float(len(t)))

    return F.transform(starts, share)


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of ``keep`` with the matches of each row's whole text."""
    in_docs = rarity(docs, text)
    rare = {min(key.split(), key=lambda x, k=key: (in_docs[x], k.split().index(x))) for _, _, key in BASE + MORE}
    keep = keep or ["doc_id"]
    d = docs.select(*keep, document_words(F.col(text)).alias("_w")).withColumn("n_words", F.size("_w").cast("long"))
    places = F.filter(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: F.col("_w")[i].isin(*sorted(rare)))
    d = d.withColumn("_p", F.when(F.col("n_words") > 0, places).otherwise(F.array().cast("array<int>")))
    d = d.withColumns({f"_b{i}": _starts(t, k, in_docs) for i, (_, t, k) in enumerate(BASE)})
    d = d.withColumns({f"_m{i}": _shares(t, _starts(t, k, in_docs)) for i, (_, t, k) in enumerate(MORE)})
    all_base = F.concat(*[F.col(f"_b{i}") for i in range(len(BASE))])
    base = F.filter(F.array(*[F.when(F.size(f"_b{i}") > 0, F.lit(BASE[i][0])) for i in range(len(BASE))]), lambda x: x.isNotNull())
    best = [F.coalesce(F.array_max(f"_m{i}"), F.lit(0.0)) for i in range(len(MORE))]
    more = F.filter(F.array(*[F.when(b >= SHARE, F.lit(MORE[i][0])) for i, b in enumerate(best)]), lambda x: x.isNotNull())
    return d.select(
        *keep,
        "n_words",
        F.size(all_base).cast("long").alias("n_base"),
        F.array_min(all_base).cast("long").alias("first_word"),
        F.array_max(all_base).cast("long").alias("last_word"),
        _joined(base).alias("base_labels"),
        _joined(F.concat(base, more)).alias("labels"),
        F.when(F.size(all_base) > 0, F.lit(1.0)).otherwise(F.greatest(*best)).alias("score"),
    )


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql_list(phrase: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in phrase.split()) + "]"


def _sql() -> str:
    """The same result in DuckDB, by looking at every place of every key phrase."""

    def starts(t: str, k: str) -> str:
        at, n = next(i for i in range(99) if t.split()[i : i + len(k.split())] == k.split()), len(k.split())
        return f"list_transform(list_filter(p, lambda i: w[i+1:i+{n}] = {_sql_list(k)}), lambda i: i - {at})"

    cols = [f"{starts(t, k)} AS b{i}" for i, (_, t, k) in enumerate(BASE)]
    for i, (_, t, k) in enumerate(MORE):
        n = len(t.split())
        hits = f"len(list_filter(range({n}), lambda j: q + j >= 0 AND w[q + j + 1] = ({_sql_list(t)})[j + 1]))"
        cols.append(f"coalesce(list_max(list_transform({starts(t, k)}, lambda q: {hits} / {float(n)}::DOUBLE)), 0.0) AS m{i}")
    every = "list_concat(list_concat(b0, b1), list_concat(b2, b3))"
    base = "list_filter([" + ", ".join(f"CASE WHEN len(b{i}) > 0 THEN '{x[0]}' END" for i, x in enumerate(BASE)) + "], lambda x: x IS NOT NULL)"
    more = "list_filter([" + ", ".join(f"CASE WHEN m{i} >= {SHARE} THEN '{x[0]}' END" for i, x in enumerate(MORE)) + "], lambda x: x IS NOT NULL)"
    best = "greatest(" + ", ".join(f"m{i}" for i in range(len(MORE))) + ")"
    pattern = ALNUM_WORD
    firsts = ", ".join(sorted({f"'{k.split()[0]}'" for _, _, k in BASE + MORE}))
    return f"""
WITH x AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '{pattern}') AS w FROM documents),
o AS (SELECT *, list_filter(range(len(w)), lambda i: w[i + 1] IN ({firsts})) AS p FROM x),
y AS (SELECT doc_id, len(w)::BIGINT AS n_words, {', '.join(cols)} FROM o),
z AS (SELECT *, {every} AS b, {base} AS bl, {more} AS ml FROM y)
SELECT doc_id, n_words, len(b)::BIGINT AS n_base, list_min(b)::BIGINT AS first_word, list_max(b)::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(bl)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(bl, ml))), ','), '') AS labels,
  CASE WHEN len(b) > 0 THEN 1.0::DOUBLE ELSE {best}::DOUBLE END AS score FROM z"""


ORACLE = {"op7_licence_scan": _sql()}
