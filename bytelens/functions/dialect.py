"""One SQL text for two engines.

Queries are written once, in the SQL both engines share; what differs (bytes of a text, hashes,
ranges, percentiles) is a macro; counts of bytes are SQL in DuckDB and Arrow kernels in Spark. ``spark_sql`` runs a query over the tables of a folder, ``duck_sql`` renders its oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from bytelens.operators import bytecounts

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_DIGITS = "'0123456789ABCDEF'"
_VALUE = f"CAST((instr({_DIGITS}, substr(h, 1, 1)) - 1) * 16 + instr({_DIGITS}, substr(h, 2, 1)) - 1 AS BIGINT)"
#: bb: every byte of every text with its place; g: with the three bytes before it, taken from the text's own array.
_BYTES = {
    "spark": f"""bb1 AS (SELECT doc_id, source, lang, octet_length(text) AS len, regexp_extract_all(hex(encode(text, 'UTF-8')), '..', 0) AS l
  FROM documents WHERE octet_length(text) > 0),
bb0 AS (SELECT doc_id, source, lang, CAST(len AS BIGINT) AS len, l, posexplode(l) AS (i0, h) FROM bb1),
bb AS (SELECT doc_id, source, lang, len, CAST(i0 AS BIGINT) AS i, h, {_VALUE} AS x FROM bb0)""",
    "duck": f"""bb0 AS (SELECT doc_id, source, lang, octet_length(encode(text)) AS len, regexp_extract_all(hex(encode(text)), '..') AS l FROM documents),
bb1 AS (SELECT doc_id, source, lang, len, unnest(l) AS h, generate_subscripts(l, 1) - 1 AS i FROM bb0 WHERE len > 0),
bb AS (SELECT doc_id, source, lang, CAST(len AS BIGINT) AS len, CAST(i AS BIGINT) AS i, h, {_VALUE} AS x FROM bb1)""",
}
_GRAMS = {
    "spark": f"""g AS (SELECT doc_id, source, lang, len, CAST(i0 AS BIGINT) AS i, h, {_VALUE} AS x, get(l, i0 - 1) AS p1, get(l, i0 - 2) AS p2, get(l, i0 - 3) AS p3 FROM bb0)""",
    "duck": """g AS (SELECT *, lag(h, 1) OVER w AS p1, lag(h, 2) OVER w AS p2, lag(h, 3) OVER w AS p3
  FROM bb WINDOW w AS (PARTITION BY doc_id ORDER BY i))""",
}
#: What @COUNTS{by|orders|part}, @ADAPTIVE and @LAGS stand for in DuckDB; Spark has Arrow kernels for them.
_PARTS = {
    "": "0",
    "third": "CASE WHEN i < len // 3 THEN 0 WHEN i < 2 * len // 3 THEN 1 ELSE 2 END",
    "half": "CASE WHEN i < len // 2 THEN 0 ELSE 1 END",
    "held": "CASE WHEN i < len // 2 THEN 0 WHEN i >= len // 2 + k THEN 1 ELSE -1 END",
    "plane": "i % 4",
    "chunk": "i // 2048",
}
_COUNTS = r"@COUNTS\{([^|}]*)\|([^|}]*)\|([^}]*)\}"


def _duck_counts(m: re.Match) -> str:
    by, orders, part = m[1], m[2], m[3]
    return f"""{_BYTES['duck']},
{_GRAMS['duck']},
jx AS (SELECT {by}, {_PARTS[part]} AS piece, k, CASE k WHEN 0 THEN '' WHEN 1 THEN p1 WHEN 2 THEN p2 || p1 ELSE p3 || p2 || p1 END AS ctx, x
  FROM g CROSS JOIN (SELECT unnest([{orders}]) AS k) ks WHERE i >= k),
j AS (SELECT {by}, piece, k, ctx, x, count(*) AS c FROM jx WHERE piece >= 0 GROUP BY ALL)"""


def _before(*cols: str) -> str:
    return f"count(*) OVER (PARTITION BY doc_id, {', '.join(cols)} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


_ADAPTIVE = f"""{_BYTES['duck']},
{_GRAMS['duck']},
aw AS (SELECT doc_id, source, len, i, {_before('h')} AS c0, i AS t0,
  CASE WHEN i >= 1 THEN {_before('p1', 'h')} ELSE 0 END AS c1, CASE WHEN i >= 1 THEN {_before('p1')} ELSE 0 END AS t1,
  CASE WHEN i >= 2 THEN {_before('p2', 'p1', 'h')} ELSE 0 END AS c2, CASE WHEN i >= 2 THEN {_before('p2', 'p1')} ELSE 0 END AS t2 FROM g),
ab AS (SELECT *, log2(256 + 32 * t0) - log2(1 + 32 * c0) AS o0, -log2((c0 + 0.5) / (i + 128.0)) AS o9 FROM aw),
ac AS (SELECT *, CASE WHEN t1 > 0 THEN log2(256 + 32 * t1) - log2(1 + 32 * c1) ELSE o0 END AS o1 FROM ab),
ad AS (SELECT *, CASE WHEN t2 > 0 THEN log2(256 + 32 * t2) - log2(1 + 32 * c2) ELSE o1 END AS o2, CASE WHEN i < len // 4 THEN 1 ELSE 0 END AS f FROM ac),
a AS (SELECT doc_id, source, len, sum(o0) AS b0, sum(o1) AS b1, sum(o2) AS b2, sum(f * o0) AS e0, sum(f * o1) AS e1, sum(f * o2) AS e2, sum(o9) AS kt FROM ad GROUP BY doc_id, source, len)"""
_LAGS = f"""{_BYTES['duck']},
lw AS (SELECT source, x, unnest([0, 1, 2, 4, 8, 16, 32, 64, 256]) AS lag, [x, lag(x, 1) OVER w, lag(x, 2) OVER w, lag(x, 4) OVER w, lag(x, 8) OVER w, lag(x, 16) OVER w,
  lag(x, 32) OVER w, lag(x, 64) OVER w, lag(x, 256) OVER w] AS ys FROM bb WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
ly AS (SELECT source, lag, x, ys[CASE lag WHEN 0 THEN 1 WHEN 256 THEN 9 ELSE CAST(log2(lag) AS INT) + 2 END] AS y FROM lw),
l AS (SELECT source, lag, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS sxy FROM ly WHERE y IS NOT NULL GROUP BY source, lag)"""
#: Poisson(1) by a uniform number u of 0 to 9999: how often a resample takes a row.
POISSON = "CASE WHEN u < 3679 THEN 0 WHEN u < 7358 THEN 1 WHEN u < 9197 THEN 2 WHEN u < 9810 THEN 3 WHEN u < 9963 THEN 4 WHEN u < 9994 THEN 5 ELSE 6 END"
_MACROS = {
    "spark": {
        "SHA": r"sha2(\1, 256)",
        "SEED": r"CAST(conv(substr(sha2(\1, 256), 1, 8), 16, 10) AS BIGINT)",
        "EACH": r"explode(sequence(CAST(\1 AS BIGINT), CAST(\2 AS BIGINT)))",
        "IDS": r"(SELECT id FROM range(\1))",
        "PCT": r"percentile(\1, \2)",
        "DIV": r"((\1) DIV (\2))",
        "POP": r"CAST(bit_count(\1) AS BIGINT)",
        "XOR": r"((\1) ^ (\2))",
        "SHR": r"shiftright(\1, \2)",
        "JSON": r"get_json_object(\1, '\2')",
        "HEAD": r"element_at(split(\1, '-'), 1)",
        "HEXBYTE": r"lpad(hex(\1), 2, '0')",
        "BYTEOF": r"\1",
        "UTF": r"encode(\1, 'UTF-8')",
        "BIN": r"substring(\1, CAST(\2 AS INT), CAST(\3 AS INT))",
        "SHABIN": r"sha2(\1, 256)",
        "WORDS": r"regexp_extract_all(lower(\1), '\\\\pL+', 0)",
        "SIGNS": r"array_join(transform(\1, x -> CASE WHEN x > 0 THEN '1' ELSE '0' END), '')",
        "LEN": r"CAST(size(\1) AS BIGINT)",
        "AT": r"element_at(\1, CAST(\2 AS INT))",
        "SORTED": r"array_join(array_sort(collect_set(\1)), ',')",
    },
    "duck": {
        "SHA": r"sha256(\1)",
        "SEED": r"CAST('0x' || substr(sha256(\1), 1, 8) AS BIGINT)",
        "EACH": r"unnest(range(CAST(\1 AS BIGINT), CAST(\2 AS BIGINT) + 1))",
        "IDS": r"(SELECT range AS id FROM range(\1))",
        "PCT": r"quantile_cont(\1, \2)",
        "DIV": r"((\1) // (\2))",
        "POP": r"CAST(bit_count(\1) AS BIGINT)",
        "XOR": r"xor(\1, \2)",
        "SHR": r"((\1) >> (\2))",
        "JSON": r"json_extract_string(\1, '\2')",
        "HEAD": r"split_part(\1, '-', 1)",
        "HEXBYTE": r"\1",
        "BYTEOF": r"CAST('0x' || \1 AS BIGINT)",
        "UTF": r"encode(\1)",
        "BIN": r"\1[CAST(\2 AS INT):CAST(\2 AS INT) + CAST(\3 AS INT) - 1]",
        "SHABIN": r"sha256(\1)",
        "WORDS": r"regexp_extract_all(lower(\1), '\\pL+')",
        "SIGNS": r"array_to_string(list_transform(\1, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')",
        "LEN": r"CAST(len(\1) AS BIGINT)",
        "AT": r"list_extract(\1, CAST(\2 AS INT))",
        "SORTED": r"array_to_string(list_sort(list_distinct(list(\1))), ',')",
    },
}


def render(query: str, engine: str) -> str:
    if engine == "duck":
        query = re.sub(_COUNTS, _duck_counts, query).replace("@ADAPTIVE", _ADAPTIVE).replace("@LAGS", _LAGS)
    else:
        query = re.sub(_COUNTS, r"j AS (SELECT \1, piece, k, ctx, x, sum(c) AS c FROM byte_counts GROUP BY \1, piece, k, ctx, x)", query)
        query = query.replace("@ADAPTIVE", "a AS (SELECT * FROM byte_costs)")
        query = query.replace("@LAGS", "l AS (SELECT source, lag, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxy) AS sxy FROM byte_lags GROUP BY source, lag)")
    query = query.replace("@BYTES", _BYTES[engine]).replace("@GRAMS", _BYTES[engine] + ",\n" + _GRAMS[engine])
    arg = r"((?:[^{}]|\{[^{}]*\})*?)"
    for _ in range(6):
        for name, text in _MACROS[engine].items():
            n = len(set(re.findall(r"\\(\d)", text)))
            query = re.sub(rf"@{name}\{{" + r"\|".join([r"([^{}|]*)" if n > 1 else r"([^{}]*)"] * n) + r"\}", text, query)
    if left := re.search(r"@[A-Z]+\{", query):
        raise ValueError(f"unknown macro {left[0]} in {query}")
    return query


def duck_sql(query: str) -> str:
    return render(query, "duck")


def spread(df: DataFrame) -> DataFrame:
    """A table read in fewer tasks than there are cores is dealt to all cores; a larger one is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def kernels(spark: SparkSession, sf_dir: str, query: str) -> dict[str, DataFrame]:
    """The relations of byte kernels that a query names."""
    found = {}
    if "@" in query:
        docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
        if m := re.search(_COUNTS, query):
            found["byte_counts"] = bytecounts.counts(docs, m[1], [int(k) for k in m[2].split(",")], m[3])
        if "@ADAPTIVE" in query:
            found["byte_costs"] = bytecounts.adaptive(docs, ["doc_id", "source"])
        if "@LAGS" in query:
            found["byte_lags"] = bytecounts.lagged(docs, "source")
    return found


def spark_sql(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    text = render(query, "spark")
    used = {t: spread(spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in TABLES if re.search(rf"\b{t}\b", text)}
    used.update(kernels(spark, sf_dir, query))
    for t in used:
        text = re.sub(rf"\b{t}\b(?!\s*\.)", "{" + t + "}", text)
    return spark.sql(text, **used) if used else spark.sql(text)
