"""Byte-stream analytics: blocks, histograms, entropy ladders, autocorrelation, code lengths.

Texts are streams of UTF-8 bytes; a source is a corpus. Positions are explicit, so no result depends on row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bytelens.functions.dialect import POISSON, render, spread
from bytelens.operators import bytecounts

_LADDER = """WITH @COUNTS{source|0,1,2,3|},
t AS (SELECT *, sum(c) OVER (PARTITION BY source, k, ctx) AS t FROM j)
SELECT source, CAST(k AS BIGINT) AS ord, round(sum(c * (log2(t) - log2(c))) / sum(c), 6) AS h,
  count(DISTINCT ctx) AS contexts, CAST(sum(c) AS BIGINT) AS positions FROM t GROUP BY source, k"""
_H0 = """WITH @COUNTS{{key}|0|},
t AS (SELECT *, sum(c) OVER (PARTITION BY {key}) AS n FROM j)
SELECT {key}, round(-sum(c / n * log2(c / n)), 6) AS h0, CAST(max(n) AS BIGINT) AS n, count(*) AS symbols FROM t GROUP BY {key}"""
_THIRDS = """WITH @COUNTS{source|0,1|third},
t AS (SELECT *, sum(c) OVER (PARTITION BY source, piece, k, ctx) AS t FROM j),
l AS (SELECT source, CAST(piece AS BIGINT) AS third, CAST(k AS BIGINT) AS ord, sum(c * (log2(t) - log2(c))) / sum(c) AS h FROM t GROUP BY source, piece, k)"""
_ACF = """WITH @LAGS,
m AS (SELECT source, CAST(sx AS DOUBLE) / n AS mu, CAST(sxy AS DOUBLE) / n - (CAST(sx AS DOUBLE) / n) * (CAST(sx AS DOUBLE) / n) AS v FROM l WHERE lag = 0),
a AS (SELECT l.source, l.lag AS lg, (CAST(sxy AS DOUBLE) / n - mu * (CAST(sx + sy AS DOUBLE) / n) + mu * mu) / v AS acf FROM l JOIN m ON l.source = m.source WHERE l.lag > 0)"""
_HOLD = """WITH @COUNTS{source|0,1,2|held},
c AS (SELECT source, k, ctx, x, c FROM j WHERE piece = 0), t AS (SELECT source, k, ctx, sum(c) AS t FROM c GROUP BY source, k, ctx),
s AS (SELECT source, k, ctx, x, c AS n FROM j WHERE piece = 1),
r AS (SELECT s.source, s.k, s.n, coalesce(c.c, 0) AS c, coalesce(t.t, 0) AS t FROM s
  LEFT JOIN c ON s.source = c.source AND s.k = c.k AND s.ctx = c.ctx AND s.x = c.x
  LEFT JOIN t ON s.source = t.source AND s.k = t.k AND s.ctx = t.ctx),
o AS (SELECT source, CAST(k AS BIGINT) AS ord, round(-sum(n * log2((c + 1) / (t + 256.0))) / sum(n), 6) AS ce,
  round(sum(CASE WHEN t > 0 THEN n ELSE 0 END) / sum(n), 6) AS coverage FROM r GROUP BY source, k)"""


def _cmi(key: str, source: str, cells: str = "") -> str:
    """I(high; low | context) in bits with the Miller-Madow correction, from ``cells`` (key, c, x, m): counts m of bytes x after contexts c."""
    cells = cells or f"SELECT {key}, c, x, count(*) AS m FROM p0 GROUP BY {key}, c, x"
    return f"""{source},
j0 AS ({cells}), y AS (SELECT *, x % 16 AS lo, @DIV{{x|16}} AS hi FROM j0),
z AS (SELECT {key}, grouping(hi) AS gh, grouping(lo) AS gl, sum(m) AS m FROM y GROUP BY GROUPING SETS (({key}, c, hi, lo), ({key}, c, hi), ({key}, c, lo), ({key}, c))),
w AS (SELECT *, CASE WHEN gh = gl THEN 1 ELSE -1 END AS s, CASE WHEN gh = 1 AND gl = 1 THEN m ELSE 0 END AS whole FROM z)
SELECT {key}, round(sum(s * m * log2(m)) / sum(whole) - sum(s) / (2.0 * sum(whole) * ln(2)), 6) AS cmi FROM w GROUP BY {key}"""


_BLK = """WITH d AS (SELECT doc_id, source, text, CAST(octet_length(@UTF{text}) AS BIGINT) AS n FROM documents),
k AS (SELECT *, @EACH{0|@DIV{n - 1|1024}} AS blk FROM d WHERE n > 0)"""

SQL = {
    "q01_byte_histogram": "WITH @COUNTS{lang|0|} SELECT x, CAST(sum(c) AS BIGINT) AS n FROM j GROUP BY x",
    "q02_h0_by_source": _H0.replace("{key}", "source"),
    "q03_h0_by_lang": _H0.replace("{key}", "lang"),
    "q04_cond_entropy_ladder": _LADDER,
    "q05_thirds_ladder": _THIRDS + " SELECT source, third, ord, round(h, 6) AS h FROM l",
    "q06_stationarity_verdict": _THIRDS + """, s AS (SELECT source, ord, (max(h) - min(h)) / avg(h) AS spread FROM l GROUP BY source, ord)
SELECT source, ord, round(spread, 6) AS rel_spread, CASE WHEN spread <= 0.05 THEN 'qualifies' WHEN spread <= 0.20 THEN 'marginal' ELSE 'fails' END AS verdict FROM s""",
    "q07_acf_lags": _ACF + " SELECT source, CAST(lg AS BIGINT) AS lag_bytes, round(acf, 6) AS acf FROM a",
    "q08_mixing_verdict": _ACF + """ SELECT source, round(max(abs(acf)), 6) AS acf_far_max,
CASE WHEN max(abs(acf)) <= 0.05 THEN 'qualifies' WHEN max(abs(acf)) <= 0.15 THEN 'marginal' ELSE 'fails' END AS verdict FROM a WHERE lg >= 64 GROUP BY source""",
    "q09_holdout_ce": _HOLD + " SELECT * FROM o",
    "q10_best_order": _HOLD + ", r2 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ce, ord) AS rk FROM o) SELECT source, ord, ce FROM r2 WHERE rk = 1",
    "q11_nibble_cmi": _cmi("source", "WITH @COUNTS{source|1|}", "SELECT source, ctx AS c, x, c AS m FROM j"),
    "q12_cmi_perm_null": _cmi("source", """WITH @GRAMS, r0 AS (SELECT source, p1 AS c, x % 16 AS lo, @DIV{x|16} AS hi,
  row_number() OVER (PARTITION BY source, p1, @DIV{doc_id|4096} ORDER BY doc_id, i) AS r1,
  row_number() OVER (PARTITION BY source, p1, @DIV{doc_id|4096} ORDER BY @SHA{concat('7:', CAST(doc_id AS VARCHAR(20)), ':', CAST(i AS VARCHAR(20)))}, doc_id, i) AS r2, @DIV{doc_id|4096} AS piece FROM g WHERE i >= 1),
p0 AS (SELECT a.source, a.c, a.hi * 16 + b.lo AS x FROM r0 a JOIN r0 b ON a.source = b.source AND a.c = b.c AND a.piece = b.piece AND a.r1 = b.r2)"""),
    "q14_split_half_drift": _cmi("source, half", "WITH @COUNTS{source|1|half}", "SELECT source, CAST(piece AS BIGINT) AS half, ctx AS c, x, c AS m FROM j"),
    "q15_plane_cmi": _cmi("lang, plane", "WITH @COUNTS{lang|1|plane}", "SELECT lang, piece AS plane, ctx AS c, x, c AS m FROM j"),
    "q23_adaptive_bits_order0": "WITH @ADAPTIVE SELECT doc_id, round(b0, 4) AS bits FROM a",
    "q24_adaptive_bits_backoff": "WITH @ADAPTIVE SELECT doc_id, round(b2, 4) AS bits FROM a",
    "q25_block_bpb": "WITH @ADAPTIVE SELECT doc_id, round(b2 / len, 6) AS bpb FROM a",
    "q26_ideal_vs_store": """WITH @ADAPTIVE, s AS (SELECT doc_id, len AS raw, CAST(ceil(round(b2, 4) / 8) AS BIGINT) AS coded FROM a)
SELECT doc_id, raw, coded, CASE WHEN coded >= raw THEN raw ELSE coded END AS stored, coded >= raw AS store_mode FROM s""",
    "q30_frozen_bits": """WITH @COUNTS{source|1|}, t AS (SELECT *, sum(c) OVER (PARTITION BY source, ctx) AS t FROM j)
SELECT source, round(sum(c * (log2(256 + 32 * t) - log2(1 + 32 * c))), 2) AS bits, count(*) AS entries FROM t GROUP BY source""",
    "q31_prune_contexts": """WITH @COUNTS{source|0,1|}, t AS (SELECT *, sum(c) OVER (PARTITION BY source, k, ctx) AS t FROM j),
a0 AS (SELECT * FROM t WHERE k = 0), a1 AS (SELECT * FROM t WHERE k = 1),
s AS (SELECT a1.source, a1.ctx, sum(a1.c * ((log2(256 + 32 * a0.t) - log2(1 + 32 * a0.c)) - (log2(256 + 32 * a1.t) - log2(1 + 32 * a1.c)))) AS gain,
  count(*) * 2 + sum(CASE WHEN a1.c < 128 THEN 1 WHEN a1.c < 16384 THEN 2 ELSE 3 END) + 2 AS cost_bytes FROM a1 JOIN a0 ON a1.source = a0.source AND a1.x = a0.x GROUP BY a1.source, a1.ctx)
SELECT source, count(*) AS contexts, CAST(sum(CASE WHEN gain > 8 * cost_bytes THEN 1 ELSE 0 END) AS BIGINT) AS kept FROM s GROUP BY source""",
    "q34_class_partition": """WITH @COUNTS{lang|1|}, s AS (SELECT ctx, x, sum(c) AS c FROM j GROUP BY ctx, x),
r AS (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY c DESC, x) AS rk FROM s)
SELECT @HEXBYTE{ctx} AS p1, CASE WHEN rk = 1 THEN 'C0' WHEN rk <= 16 THEN 'CAND' ELSE 'ESC' END AS class, CAST(sum(c) AS BIGINT) AS total FROM r
GROUP BY ctx, CASE WHEN rk = 1 THEN 'C0' WHEN rk <= 16 THEN 'CAND' ELSE 'ESC' END""",
    "q35_cumulative_freq": """WITH @COUNTS{source|0|}
SELECT source, x, CAST(sum(1 + 32 * c) OVER (PARTITION BY source ORDER BY x ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM j""",
    "q36_block_scan": _BLK + " SELECT doc_id, blk, @SHABIN{@BIN{@UTF{text}|blk * 1024 + 1|1024}} AS sha, least(1024, n - blk * 1024) AS bytes FROM k",
    "q37_num_blocks": "SELECT doc_id, @DIV{octet_length(@UTF{text}) + 1023|1024} AS blocks, @DIV{octet_length(@UTF{text})|1024} AS full_blocks FROM documents WHERE text IS NOT NULL",
    "q38_range_read": "SELECT doc_id, @SHABIN{@BIN{@UTF{text}|101|200}} AS sha, CAST(greatest(0, least(200, octet_length(@UTF{text}) - 100)) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL",
    "q39_tier_prefix": _BLK + ", t AS (SELECT id, (id + 1) * 2048 AS cap FROM @IDS{3}) SELECT doc_id, CAST(cap AS BIGINT) AS cap, count(*) AS blocks FROM k CROSS JOIN t WHERE blk * 1024 < cap GROUP BY doc_id, cap",
    "q40_sha256_manifest": "SELECT doc_id, @SHA{text} AS sha, CAST(octet_length(@UTF{text}) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL",
    "q41_prefix_sha": "SELECT doc_id, CAST(cut AS BIGINT) AS cut, @SHABIN{@BIN{@UTF{text}|1|cut}} AS sha FROM documents CROSS JOIN (SELECT (id + 1) * 256 AS cut FROM @IDS{3}) WHERE octet_length(@UTF{text}) >= cut",
    "q42_seek_index": _BLK + """ SELECT doc_id, blk, blk * 1024 AS byte_offset,
CAST(coalesce(sum(8 * least(1024, n - blk * 1024)) OVER (PARTITION BY doc_id ORDER BY blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bit_offset FROM k""",
    "q43_find_sync": _BLK + """, q AS (SELECT doc_id, n, @SEED{concat('sync:', CAST(doc_id AS VARCHAR(20)))} % n AS p FROM d WHERE n > 0),
j AS (SELECT q.doc_id, q.p, k.blk, row_number() OVER (PARTITION BY q.doc_id ORDER BY k.blk DESC) AS rk FROM q JOIN k ON q.doc_id = k.doc_id AND k.blk * 1024 <= q.p)
SELECT doc_id, p, blk * 1024 AS sync FROM j WHERE rk = 1""",
    "q44_covering_blocks": _BLK + """, q AS (SELECT doc_id, n, @SEED{concat('read:', CAST(doc_id AS VARCHAR(20)))} % n AS p FROM d WHERE n > 0)
SELECT q.doc_id, q.p, count(*) AS blocks, min(k.blk) AS first_block, max(k.blk) AS last_block FROM q JOIN k ON q.doc_id = k.doc_id
AND k.blk * 1024 < q.p + 3000 AND k.blk * 1024 + 1024 > q.p GROUP BY q.doc_id, q.p""",
    "q45_decode_window_bound": _BLK + """, q AS (SELECT doc_id, n, @SEED{concat('read:', CAST(doc_id AS VARCHAR(20)))} % n AS p FROM d WHERE n > 0)
SELECT doc_id, p % 1024 AS warm_up, least(n, p + 500) - (p - p % 1024) AS decoded, p % 1024 <= 1023 AND least(n, p + 500) - (p - p % 1024) <= 1524 AS within FROM q""",
    "q13_cmi_chunk_boot": f"""WITH @COUNTS{{doc_id|1|chunk}}, k AS (SELECT doc_id, piece AS chunk, ctx AS c, @DIV{{x|16}} AS a, x % 16 AS b, c AS n FROM j),
u AS (SELECT r.id AS r, k.doc_id, k.chunk, @SEED{{concat('cmi:', CAST(r.id AS VARCHAR(20)), ':', CAST(doc_id AS VARCHAR(20)), ':', CAST(chunk AS VARCHAR(20)))}} % 10000 AS u FROM (SELECT DISTINCT doc_id, chunk FROM k) k CROSS JOIN @IDS{{4}} r),
p AS (SELECT r, doc_id, chunk, {POISSON} AS p FROM u),
w AS (SELECT r, c, a, b, sum(n * p) AS n FROM k JOIN p ON k.doc_id = p.doc_id AND k.chunk = p.chunk WHERE p > 0 GROUP BY r, c, a, b),
t AS (SELECT *, sum(n) OVER (PARTITION BY r, c) AS nc, sum(n) OVER (PARTITION BY r, c, a) AS na, sum(n) OVER (PARTITION BY r, c, b) AS nb FROM w WHERE n > 0)
SELECT CAST(r AS BIGINT) AS resample, round(sum(n * (log2(n) + log2(nc) - log2(na) - log2(nb))) / sum(n), 6) AS cmi, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY r""",
    "q46_phrase_candidates": """WITH d AS (SELECT item_id, hex(@UTF{text}) AS hx, octet_length(@UTF{text}) AS n FROM benchmark),
e AS (SELECT item_id, hx, n, @EACH{0|n - 2} AS i FROM d WHERE n >= 2),
s AS (SELECT substr(hx, CAST(2 * i + 1 AS INT), CAST(2 * l AS INT)) AS phrase, l FROM e CROSS JOIN (SELECT id + 2 AS l FROM @IDS{6}) WHERE i + l <= n),
c AS (SELECT phrase, l, count(*) AS n FROM s GROUP BY phrase, l HAVING count(*) >= 4),
r AS (SELECT *, row_number() OVER (ORDER BY n * (l - 1) DESC, phrase) AS rk FROM c)
SELECT phrase, CAST(l AS BIGINT) AS len, n, CAST(rk AS BIGINT) AS rk FROM r WHERE rk <= 3000""",
    "q92_kt_log_loss": "WITH @ADAPTIVE SELECT doc_id, round(kt, 4) AS bits FROM a",
    "q95_edit_blocks": _BLK + """, q AS (SELECT doc_id, n, @SEED{concat('edit:', CAST(doc_id AS VARCHAR(20)))} % n AS p FROM d WHERE n > 0)
SELECT doc_id, @DIV{least(n - 1, p + 99)|1024} - @DIV{p|1024} + 1 AS replaced, @DIV{n - 1|1024} - @DIV{p|1024} + 1 AS shifted FROM q""",
    "q100_mask_class_entropy": """WITH @COUNTS{source|1|}, w AS (SELECT source, x, @BYTEOF{ctx} AS y, c FROM j),
c AS (SELECT source, CASE @POP{@XOR{x|y}} WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS class, sum(c) AS c FROM w GROUP BY 1, 2),
t AS (SELECT *, sum(c) OVER (PARTITION BY source) AS n FROM c)
SELECT source, round(-sum(c / n * log2(c / n)), 6) AS class_bits, round(sum(c / n * CASE class WHEN 0 THEN 0 WHEN 1 THEN 4 WHEN 2 THEN 7 ELSE 12 END), 6) AS payload_bits FROM t GROUP BY source""",
}


def q12_cmi_perm_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the SQL of this name says, with whole texts dealt to tasks instead of a row a byte."""
    met = bytecounts.permuted(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    cells = "SELECT source, c, x, sum(m) AS m FROM {met} GROUP BY source, c, x"
    return spark.sql(render(_cmi("source", "WITH one AS (SELECT 1)", "CELLS"), "spark").replace("CELLS", cells), met=met)


#: Queries that Spark runs by kernels of their own; their SQL is the oracle.
QUERIES = {"q12_cmi_perm_null": q12_cmi_perm_null}
