"""Records, corpora, codes, source models and studies of deviations, in the SQL both engines share."""

from __future__ import annotations

from bytelens.functions.dialect import POISSON

from .bytes import _cmi
from .records import _L

#: A nested record a run as JSON text: the braces are characters 123 and 125.
_RAW = """x AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p, CAST(round(o_totalprice) AS BIGINT) AS v, o_custkey AS c FROM orders),
raw AS (SELECT k, concat(chr(123), '"tier":"', CASE WHEN k % 2 = 0 THEN 'full' ELSE 'reduced' END, '","ctype":"', p, '","coder":"cm-', s, '","coder_version":"1.', CAST(k % 4 AS VARCHAR(20)),
  '","run_idx":', CAST(k AS VARCHAR(20)), ',"seed":', CAST(c % 1000 AS VARCHAR(20)), ',"status":"', CASE k % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'censored' ELSE 'done' END, '",',
  CASE WHEN k % 10 = 1 THEN '"censored":true,' ELSE '' END, CASE WHEN k % 5 <> 4 THEN concat('"corpus":"', p, '","corpus_sha256":"', substr(@SHA{p}, 1, 8), '",') ELSE '' END,
  '"timestamp":"1996-01-', lpad(CAST(k % 28 + 1 AS VARCHAR(20)), 2, '0'), '","config":', chr(123), CASE WHEN k % 3 = 0 THEN '"impl":"fast",' ELSE '' END, '"width":', CAST(k % 3 + 1 AS VARCHAR(20)),
  CASE WHEN k % 4 = 0 THEN ',"threads":4' ELSE '' END, chr(125), ',"measured":', chr(123), '"original_size":', CAST(v AS VARCHAR(20)), ',"compressed_size":', CAST(@DIV{v|3} AS VARCHAR(20)),
  CASE WHEN k % 10 = 1 THEN '' ELSE concat(',"enc_s":', CAST(k % 7 + 1 AS VARCHAR(20)), '.5,"dec_s":', CAST(k % 5 AS VARCHAR(20)), '.25') END, ',"enc_peak_rss":', CAST(1000000 + c * 100 AS VARCHAR(20)),
  ',"roundtrip_ok":', CASE WHEN k % 7 = 3 THEN 'false' ELSE 'true' END, chr(125), chr(125)) AS r FROM x)"""
#: A chain of two states that stays with probability 0.8, as runs of a hash: cost of a step and paths of 100 steps.
_PATHS = """u AS (SELECT @DIV{id|100} AS path, id % 100 AS i, CASE WHEN @SEED{concat('chain:', CAST(id AS VARCHAR(20)))} % 10000 < 8000 THEN 0 ELSE 1 END AS turn FROM @IDS{40000}),
l AS (SELECT path, CAST(sum(turn) AS BIGINT) AS turns, sum(turn) * -log2(0.2) + (100 - sum(turn)) * -log2(0.8) AS cost FROM u GROUP BY path),
m AS (SELECT 0.8 * -log2(0.8) + 0.2 * -log2(0.2) AS mean, sqrt(0.8 * 0.2) * (log2(0.8) - log2(0.2)) AS sd)"""


def _normal(z: str) -> str:
    """The normal distribution function by the rational approximation of the error function (1.5e-7)."""
    t = f"(1 / (1 + 0.3275911 * abs({z}) / sqrt(2)))"
    erf = f"(1 - ((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-({z}) * ({z}) / 2))"
    return f"(0.5 + 0.5 * sign({z}) * {erf})"


def _bit(x: str, k: int) -> str:
    return f"(@SHR{{{x}|{k}}} % 2)"


def _code_word() -> str:
    """Data bits at places 3, 5, 6, 7, 9 to 12 of twelve; even parity over places with a common binary digit at 1, 2, 4, 8."""
    places = [3, 5, 6, 7, 9, 10, 11, 12]
    word = " + ".join(f"{_bit('id', k)} * {1 << p - 1}" for k, p in enumerate(places))
    checks = " + ".join(f"(({' + '.join(_bit('id', k) for k, p in enumerate(places) if p & c)}) % 2) * {1 << c - 1}" for c in (1, 2, 4, 8))
    return f"SELECT id, {word} + {checks} AS word FROM @IDS{{256}}"


def _tree_weight(i: int, names: str = "abc") -> str:
    """Weight of state i of three in the stationary law: spanning trees that lead to it."""
    j, k = (x for x in range(3) if x != i)
    p = lambda a, b: f"p{names[a]}{names[b]}"
    return f"{p(j, i)} * {p(k, i)} + {p(j, k)} * {p(k, i)} + {p(k, j)} * {p(j, i)}"


_CHAIN = "SELECT 0.7 AS paa, 0.2 AS pab, 0.1 AS pac, 0.1 AS pba, 0.6 AS pbb, 0.3 AS pbc, 0.2 AS pca, 0.3 AS pcb, 0.5 AS pcc"
_ROW = {s: f"-(p{s}a * log2(p{s}a) + p{s}b * log2(p{s}b) + p{s}c * log2(p{s}c))" for s in "abc"}

SQL = {
    "q116_flatten_records": f"""WITH {_RAW}, f AS (SELECT @JSON{{r|$.tier}} AS tier, CAST(@JSON{{r|$.measured.original_size}} AS BIGINT) AS size_bytes, @JSON{{r|$.ctype}} AS content_type, @JSON{{r|$.coder}} AS coder,
  @JSON{{r|$.config.impl}} AS impl, @JSON{{r|$.coder_version}} AS coder_version, CAST(@JSON{{r|$.run_idx}} AS BIGINT) AS run_idx, CAST(@JSON{{r|$.measured.compressed_size}} AS BIGINT) AS compressed_bytes,
  CAST(@JSON{{r|$.measured.enc_s}} AS DOUBLE) AS enc_s, CAST(@JSON{{r|$.measured.dec_s}} AS DOUBLE) AS dec_s, CAST(@JSON{{r|$.measured.enc_peak_rss}} AS DOUBLE) AS enc_rss, CAST(@JSON{{r|$.measured.dec_peak_rss}} AS DOUBLE) AS dec_rss,
  @JSON{{r|$.measured.roundtrip_ok}} = 'true' AS roundtrip_ok, coalesce(@JSON{{r|$.censored}} = 'true', 1 = 0) AS censored, @JSON{{r|$.status}} AS status, CAST(coalesce(@JSON{{r|$.config.threads}}, '1') AS BIGINT) AS threads,
  @JSON{{r|$.corpus_sha256}} AS corpus_sha256, CAST(@JSON{{r|$.seed}} AS BIGINT) AS seed, @JSON{{r|$.timestamp}} AS timestamp FROM raw)
SELECT tier, size_bytes, round(CAST(size_bytes AS DOUBLE) / 1000000, 3) AS size_mb, content_type, coder, coalesce(impl, @HEAD{{coder}}) AS family, coder_version, run_idx, compressed_bytes,
  round(CAST(8 * compressed_bytes AS DOUBLE) / size_bytes, 6) AS bpb, round(CAST(size_bytes AS DOUBLE) / compressed_bytes, 6) AS ratio, enc_s, dec_s, CASE WHEN enc_s > 0 THEN round(CAST(size_bytes AS DOUBLE) / 1000000 / enc_s, 3) END AS enc_mb_s,
  CASE WHEN dec_s > 0 THEN round(CAST(size_bytes AS DOUBLE) / 1000000 / dec_s, 3) END AS dec_mb_s, round(enc_rss / 1000000, 1) AS enc_peak_rss_mb, round(dec_rss / 1000000, 1) AS dec_peak_rss_mb,
  roundtrip_ok, censored, status, threads, corpus_sha256, seed, timestamp FROM f WHERE status IN ('done', 'censored')""",
    "q117_records_with_corpus": f"WITH {_RAW} SELECT @JSON{{r|$.corpus}} AS corpus, count(*) AS n FROM raw WHERE @JSON{{r|$.corpus}} IS NOT NULL GROUP BY @JSON{{r|$.corpus}}",
    "q118_config_key": """WITH e AS (SELECT o_orderkey AS k, '"width": ' AS name, CAST(o_orderkey % 3 AS VARCHAR(20)) AS v FROM orders UNION ALL SELECT o_orderkey, '"block": ', CAST(1024 * (1 + o_orderkey % 2) AS VARCHAR(20)) FROM orders
UNION ALL SELECT o_orderkey, '"impl": ', '"fast"' FROM orders WHERE o_orderkey % 5 = 0),
c AS (SELECT k, concat(chr(123), @SORTED{concat(name, v)}, chr(125)) AS config FROM e GROUP BY k) SELECT config, count(*) AS runs, min(k) AS first_run FROM c GROUP BY config""",
    "q119_corpus_listing": """WITH m AS (SELECT source AS name, @SEED{concat('deferred:', source)} % 3 = 0 AS deferred FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) s),
p AS (SELECT source AS name, CAST(sum(octet_length(@UTF{text})) AS BIGINT) AS bytes FROM documents WHERE doc_id % 40 = 0 GROUP BY source)
SELECT m.name, m.deferred, coalesce(p.bytes, 0) AS bytes FROM m LEFT JOIN p ON m.name = p.name WHERE NOT (m.deferred AND p.name IS NULL)""",
    "q120_code_table": f"SELECT CAST(id AS BIGINT) AS byte, CAST(word AS BIGINT) AS word FROM ({_code_word()}) t",
    "q121_code_distances": f"WITH t AS ({_code_word()}) SELECT @POP{{@XOR{{a.word|b.word}}}} AS distance, count(*) AS pairs FROM t a JOIN t b ON a.id < b.id GROUP BY 1",
    "q122_band_verdict": f"""WITH b AS (SELECT lang, CAST(plane AS BIGINT) AS plane, cmi FROM ({_cmi("lang, plane", "WITH @COUNTS{lang|1|plane}", "SELECT lang, piece AS plane, ctx AS c, x, c AS m FROM j")}) z),
s AS (SELECT lang, max(cmi) AS peak FROM b GROUP BY lang), e AS (SELECT 'en' AS lang, 0.1 AS lo, 0.3 AS hi UNION ALL SELECT 'de', 0.4, 0.9 UNION ALL SELECT 'fr', 0.05, 0.2)
SELECT s.lang, round(peak, 6) AS peak, CASE WHEN e.lang IS NULL THEN 'no band' WHEN peak < 0.1 THEN 'adverse' WHEN peak BETWEEN lo AND hi THEN 'in band' WHEN peak > hi THEN 'above band' ELSE 'below band' END AS verdict
FROM s LEFT JOIN e ON s.lang = e.lang""",
    "q123_reproducibility": """WITH prior AS (SELECT o_orderkey AS run_idx, o_orderpriority AS ctype, o_orderstatus AS coder, @SHA{CAST(o_custkey AS VARCHAR(20))} AS sha FROM orders WHERE o_orderkey % 11 <> 0),
again AS (SELECT o_orderkey AS run_idx, o_orderpriority AS ctype, o_orderstatus AS coder, @SHA{CAST(o_custkey + CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS VARCHAR(20))} AS sha FROM orders WHERE o_orderkey % 13 <> 0)
SELECT coalesce(p.coder, a.coder) AS coder, CASE WHEN p.sha IS NULL THEN 'new' WHEN a.sha IS NULL THEN 'not repeated' WHEN p.sha = a.sha THEN 'same' ELSE 'changed' END AS outcome, count(*) AS n
FROM prior p FULL OUTER JOIN again a ON p.run_idx = a.run_idx AND p.ctype = a.ctype AND p.coder = a.coder GROUP BY 1, 2""",
    "q124_markov_stationary": f"""WITH c AS ({_CHAIN}), w AS (SELECT *, {_tree_weight(0)} AS wa, {_tree_weight(1)} AS wb, {_tree_weight(2)} AS wc FROM c)
SELECT round(CAST(wa / (wa + wb + wc) AS DOUBLE), 9) AS pa, round(CAST(wb / (wa + wb + wc) AS DOUBLE), 9) AS pb, round(CAST(wc / (wa + wb + wc) AS DOUBLE), 9) AS pc,
  round((wa * ({_ROW['a']}) + wb * ({_ROW['b']}) + wc * ({_ROW['c']})) / (wa + wb + wc), 9) AS rate FROM w""",
    "q125_chain_of_events": """WITH e AS (SELECT event_type AS b, lag(event_type, 1) OVER (PARTITION BY user_id ORDER BY event_id) AS a FROM events), c AS (SELECT a, b, count(*) AS n FROM e WHERE a IS NOT NULL GROUP BY a, b),
t AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER () AS total FROM c)
SELECT a AS state, CAST(max(na) AS BIGINT) AS visits, round(sum(n * (log2(na) - log2(n))) / max(na), 6) AS row_entropy, round(sum(n * (log2(na) - log2(n))) / max(total), 6) AS share_of_rate FROM t GROUP BY a""",
    "q126_markov_sample": f"WITH {_PATHS} SELECT CAST(path AS BIGINT) AS path, turns, round(cost, 6) AS cost FROM l",
    "q127_deviation_bounds": f"""WITH {_PATHS}, e AS (SELECT id, 5.0 * (id + 1) AS eps FROM @IDS{{10}})
SELECT CAST(id AS BIGINT) AS id, CAST(sum(CASE WHEN abs(cost - 100 * mean) >= eps THEN 1 ELSE 0 END) AS BIGINT) AS beyond,
  round(least(CAST(1 AS DOUBLE), 2 * exp(-eps * eps / (2 * (100 * max(sd * sd) + max(-log2(0.2)) * eps / 3)))), 9) AS bernstein,
  round(least(CAST(1 AS DOUBLE), 2 * exp(-eps * eps / (2 * 100 * max(log2(0.8) - log2(0.2)) * max(log2(0.8) - log2(0.2))))), 9) AS azuma FROM l CROSS JOIN m CROSS JOIN e GROUP BY id, eps""",
    "q128_distance_to_normal": f"""WITH {_PATHS}, z AS (SELECT (cost - 100 * mean) / (10 * sd) AS z, count(*) AS c FROM l CROSS JOIN m GROUP BY (cost - 100 * mean) / (10 * sd)),
g AS (SELECT z, c, sum(c) OVER (ORDER BY z ROWS UNBOUNDED PRECEDING) AS i, sum(c) OVER () AS n FROM z)
SELECT round(max(greatest(abs(CAST(i AS DOUBLE) / n - {_normal('z')}), abs(CAST(i - c AS DOUBLE) / n - {_normal('z')}))), 5) AS ks, round(max(0.4748 * (power(0.2, 2) + power(0.8, 2)) / (sqrt(0.16) * 10)), 5) AS berry_esseen FROM g""",
    "q129_functional_rate": """WITH v AS (SELECT id AS x FROM @IDS{6}), e AS (SELECT a.x AS x, b.x AS y FROM v a JOIN v b ON a.x < b.x AND a.x % 2 <> b.x % 2),
s AS (SELECT id AS m FROM @IDS{64} WHERE id > 0), h AS (SELECT s.m, v.x FROM s JOIN v ON @SHR{s.m|CAST(v.x AS INT)} % 2 = 1),
bad AS (SELECT DISTINCT p.m FROM h p JOIN e ON p.x = e.x JOIN h q ON q.m = p.m AND q.x = e.y),
f AS (SELECT x % 2 AS fx, count(*) AS c FROM v GROUP BY x % 2)
SELECT (SELECT count(*) FROM s LEFT JOIN bad ON s.m = bad.m WHERE bad.m IS NULL) AS independent_sets, (SELECT round(-sum(c / 6.0 * log2(c / 6.0)), 9) FROM f) AS functional_rate, round(log2(6), 9) AS source_rate""",
    "q131_timing_interval": """WITH r AS (SELECT o_orderstatus AS coder, o_totalprice AS t, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 2 AS i FROM orders),
x AS (SELECT coder, i, t FROM r WHERE i BETWEEN 0 AND 4), d AS (SELECT k.coder, b.id AS b, @SEED{concat('timing:', k.coder, ':', CAST(b.id AS VARCHAR(20)), ':', CAST(j.id AS VARCHAR(20)))} % 5 AS i
  FROM (SELECT DISTINCT coder FROM x) k CROSS JOIN @IDS{200} b CROSS JOIN @IDS{5} j),
s AS (SELECT d.coder, d.b, avg(x.t) AS t FROM d JOIN x ON d.coder = x.coder AND d.i = x.i GROUP BY d.coder, d.b)
SELECT s.coder, round(max(m.mean), 4) AS mean, round(@PCT{s.t|0.025}, 4) AS lo, round(@PCT{s.t|0.975}, 4) AS hi FROM s JOIN (SELECT coder, avg(t) AS mean FROM x GROUP BY coder) m ON s.coder = m.coder GROUP BY s.coder""",
    "q132_tc_boot": f"""WITH r AS ({_L}), c AS (SELECT @DIV{{l_orderkey|64}} AS chunk, f0, f1, count(*) AS n FROM r GROUP BY @DIV{{l_orderkey|64}}, f0, f1),
d AS (SELECT chunk, b.id AS b, @SEED{{concat('tc:', CAST(chunk AS VARCHAR(20)), ':', CAST(b.id AS VARCHAR(20)))}} % 10000 AS u FROM (SELECT DISTINCT chunk FROM c) k CROSS JOIN @IDS{{20}} b),
w AS (SELECT b, chunk, {POISSON} AS p FROM d), j AS (SELECT b, f0, f1, sum(n * p) AS n FROM c JOIN w ON c.chunk = w.chunk WHERE p > 0 GROUP BY b, f0, f1),
t AS (SELECT *, sum(n) OVER (PARTITION BY b) AS t, sum(n) OVER (PARTITION BY b, f0) AS n0, sum(n) OVER (PARTITION BY b, f1) AS n1 FROM j)
SELECT CAST(b AS BIGINT) AS resample, round(sum(n * (log2(n) + log2(t) - log2(n0) - log2(n1))) / max(t), 6) AS tc, CAST(max(t) AS BIGINT) AS n FROM t GROUP BY b""",
    "q134_write_buffer": """WITH @ADAPTIVE, d AS (SELECT source, doc_id, CAST(round(b2) AS BIGINT) - 5 * len AS net FROM a),
s AS (SELECT source, doc_id, sum(net) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS s FROM d),
h AS (SELECT source, s, s - least(0, min(s) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) AS up FROM s)
SELECT source, CAST(max(up) AS BIGINT) AS high_water, CAST(max(s) AS BIGINT) AS most_surplus, count(*) AS blocks FROM h GROUP BY source""",
    "q135_encoder_memory": """SELECT CAST(k.id AS BIGINT) AS k, CAST(w.id AS BIGINT) AS w, CAST(1024 * power(2, k.id) AS BIGINT) + 1000000 + 4 + @DIV{(64 * (w.id + 1)) * 512 * 2|8} AS bytes, CAST(1024 * power(2, k.id) AS BIGINT) AS latency
FROM @IDS{8} k CROSS JOIN @IDS{4} w""",
    "q136_axes": "SELECT 'ctype' AS axis, @SORTED{o_orderpriority} AS points FROM orders UNION ALL SELECT 'coder', @SORTED{o_orderstatus} FROM orders",
    "q137_candidates_plus_current": "WITH c AS (SELECT DISTINCT p_size AS w FROM part WHERE p_size % 7 = 0), n AS (SELECT w FROM c UNION SELECT 10) SELECT CAST(w AS BIGINT) AS width, w = 10 AS current_one FROM n",
    "q138_parts_of_suppliers_semi": "SELECT s_suppkey, s_nationkey FROM supplier WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal > 9900)",
}
