"""Record analytics, statistics, results store, selectors, access models and closed forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelens.functions.dialect import POISSON, spread

_L = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag AS f0, l_linestatus AS f1, CAST(l_linenumber AS VARCHAR(20)) AS f2, CAST(CAST(round(l_discount * 100) AS INT) AS VARCHAR(20)) AS f3 FROM lineitem"


def _h(cols: str, table: str = "r") -> str:
    return f"(SELECT -sum(c / n * log2(c / n)) FROM (SELECT c, sum(c) OVER () AS n FROM (SELECT count(*) AS c FROM {table} GROUP BY {cols}) a) b)"


def _boot(n: int, stat: str, tag: str) -> str:
    """``n`` resamples (twenty draws a hash) of whole orders, each taken as often as a Poisson(1) draw says; ``stat`` over w, v (cents), q and n."""
    return f"""WITH x AS (SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS v, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS q, count(*) AS n FROM lineitem GROUP BY l_orderkey),
h AS (SELECT g.id AS g, x.*, @SEED{{concat('{tag}:', CAST(g.id AS VARCHAR(20)), ':', CAST(l_orderkey AS VARCHAR(20)))}} AS h FROM x CROSS JOIN @IDS{{{-(-n // 20)}}} g),
u AS (SELECT g * 20 + j.id AS b, v, q, n, @DIV{{h * (40503 * (2 * j.id + 1) + 7919 * j.id * j.id)|1024}} % 10000 AS u FROM h CROSS JOIN @IDS{{20}} j),
w AS (SELECT b, v, q, n, {POISSON} AS w FROM u),
s AS (SELECT b, {stat} AS s FROM w GROUP BY b)"""


_MEAN = "CAST(sum(w * v) AS DOUBLE) / (100 * sum(w * n))"
_RUNS = """r AS (SELECT o_orderkey AS run_idx, o_orderpriority AS ctype, o_orderstatus AS coder, o_totalprice AS enc_s, o_custkey,
  CASE o_orderkey % 10 WHEN 0 THEN 'censored' WHEN 1 THEN 'failed' ELSE 'done' END AS status, o_orderkey % 7 <> 3 AS roundtrip_ok FROM orders)"""
#: Four modes of a document: store, and adaptive models of orders 0 to 2; bits of the whole text, u as its first quarter lets expect.
_COST = """@ADAPTIVE,
c0 AS (SELECT doc_id, source, len AS n, m.id AS mode, CASE m.id WHEN 0 THEN 8 * len WHEN 1 THEN CAST(round(b0) AS BIGINT) WHEN 2 THEN CAST(round(b1) AS BIGINT) ELSE CAST(round(b2) AS BIGINT) END AS bits,
  CASE m.id WHEN 0 THEN 8.0 * len WHEN 1 THEN e0 * len / greatest(1, @DIV{len|4}) WHEN 2 THEN e1 * len / greatest(1, @DIV{len|4}) ELSE e2 * len / greatest(1, @DIV{len|4}) END AS x FROM a CROSS JOIN @IDS{4} m),
c AS (SELECT doc_id, source, n, mode, bits, CASE WHEN n < 4 THEN bits ELSE CAST(round(x) AS BIGINT) END AS u FROM c0)"""
_SEL = f"""WITH {_COST}, o AS (SELECT doc_id, source, min(bits) AS best FROM c GROUP BY doc_id, source),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY bits, mode) AS rk FROM c)"""
_NODE = "SELECT id, (id + 0.5) / 1000.0 AS u FROM @IDS{1000}"

SQL = {
    "q16_entropy_mm": f"""WITH j AS (SELECT o_orderpriority AS v, count(*) AS c FROM orders GROUP BY o_orderpriority), t AS (SELECT *, sum(c) OVER () AS n FROM j)
SELECT round(-sum(c / n * log2(c / n)), 6) AS plug, round(-sum(c / n * log2(c / n)) + (count(*) - 1) / (2.0 * max(n) * ln(2)), 6) AS mm FROM t""",
    "q17_entropy_grassberger": """WITH j AS (SELECT event_type, user_id, count(*) AS c FROM events GROUP BY event_type, user_id),
g AS (SELECT id + 1 AS m, -0.5772156649015329 - ln(2) + sum(CASE WHEN (id + 1) % 2 = 0 THEN 2.0 / id ELSE 0.0 END) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS gm FROM @IDS{20000}),
s AS (SELECT sum(c) AS n FROM j),
k AS (SELECT c, coalesce(gm, ln(@DIV{c|2}) + ln(2) + 1.0 / (24.0 * @DIV{c|2} * @DIV{c|2})) AS gm FROM j LEFT JOIN g ON j.c = g.m)
SELECT round((ln(max(s.n)) - sum(c * gm) / max(s.n)) / ln(2), 6) AS h FROM k CROSS JOIN s""",
    "q18_total_correlation": f"WITH r AS ({_L}) SELECT round({_h('f0')} + {_h('f1')} + {_h('f2')} + {_h('f3')} - {_h('f0, f1, f2, f3')}, 6) AS tc_bits",
    "q19_chain_mi": f"""WITH r AS ({_L}), e AS (SELECT 1 AS f, 0 AS p, {_h('f0')} + {_h('f1')} - {_h('f0, f1')} AS mi UNION ALL SELECT 2, 1, {_h('f1')} + {_h('f2')} - {_h('f1, f2')}
UNION ALL SELECT 2, 0, {_h('f0')} + {_h('f2')} - {_h('f0, f2')} UNION ALL SELECT 3, 2, {_h('f2')} + {_h('f3')} - {_h('f2, f3')} UNION ALL SELECT 3, 1, {_h('f1')} + {_h('f3')} - {_h('f1, f3')}),
k AS (SELECT f, p, round(mi, 6) AS mi, row_number() OVER (PARTITION BY f ORDER BY round(mi, 9) DESC, p DESC) AS rk FROM e) SELECT CAST(f AS BIGINT) AS field, CAST(p AS BIGINT) AS parent, mi FROM k WHERE rk = 1""",
    "q20_tc_prefix": f"WITH r AS ({_L}) SELECT CAST(2 AS BIGINT) AS fields, round({_h('f0')} + {_h('f1')} - {_h('f0, f1')}, 6) AS tc UNION ALL SELECT 3, round({_h('f0')} + {_h('f1')} + {_h('f2')} - {_h('f0, f1, f2')}, 6) UNION ALL SELECT 4, round({_h('f0')} + {_h('f1')} + {_h('f2')} + {_h('f3')} - {_h('f0, f1, f2, f3')}, 6)",
    "q21_tc_permuted_control": f"""WITH b AS ({_L}), a AS (SELECT f0, @DIV{{l_orderkey|4096}} AS blk, row_number() OVER (PARTITION BY @DIV{{l_orderkey|4096}} ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k, f1, row_number() OVER (PARTITION BY @DIV{{l_orderkey|4096}} ORDER BY @SHA{{concat('1:', CAST(l_orderkey AS VARCHAR(20)), ':', CAST(l_linenumber AS VARCHAR(20)))}}, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k1 FROM b),
r AS (SELECT a.f0, z.f1 FROM a JOIN a z ON a.blk = z.blk AND a.k = z.k1) SELECT round({_h('f0')} + {_h('f1')} - {_h('f0, f1')}, 6) AS tc""",
    "q22_calib_dup_anchor": f"WITH r AS (SELECT id % 16 AS a, id % 16 AS d, @DIV{{id|16}} % 16 AS u, @DIV{{id|256}} % 16 AS v FROM @IDS{{65536}}) SELECT round(({_h('a')} + {_h('d')} + {_h('u')} + {_h('v')} - {_h('a, d, u, v')}) / 4, 6) AS tc_bpb",
    "q27_joint_vs_factorized_gap": f"""WITH b AS (SELECT *, @DIV{{l_orderkey|4096}} AS blk FROM ({_L}) l),
w AS (SELECT *, row_number() OVER (PARTITION BY blk ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i FROM b),
c AS (SELECT i, count(*) OVER (PARTITION BY blk, f0, f1 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS j, count(*) OVER (PARTITION BY blk, f0 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, count(*) OVER (PARTITION BY blk, f1 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM w)
SELECT round(sum(log2(i + 6) - log2(j + 1)), 3) AS joint_bits, round(sum(log2(i + 3) - log2(a + 1) + log2(i + 2) - log2(b + 1)), 3) AS factorized_bits FROM c""",
    "q28_addone_token_bits": """WITH w AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM events)
SELECT user_id, round(sum(log2(i + 8) - log2(c + 1)), 4) AS bits FROM w GROUP BY user_id""",
    "q29_index_neutrality": """WITH j AS (SELECT event_type, count(*) AS c FROM events GROUP BY event_type), r AS (SELECT *, row_number() OVER (ORDER BY event_type) - 1 AS k FROM j),
f AS (SELECT @DIV{k|2} AS family, sum(c) AS c FROM r GROUP BY @DIV{k|2}), n AS (SELECT sum(c) AS n FROM j)
SELECT (SELECT round(-sum(c / n.n * log2(c / n.n)), 6) FROM j CROSS JOIN n) AS flat, round((SELECT -sum(c / n.n * log2(c / n.n)) FROM f CROSS JOIN n) + (SELECT sum(-(r.c / n.n) * log2(r.c / f.c)) FROM r JOIN f ON @DIV{r.k|2} = f.family CROSS JOIN n), 6) AS two_level""",
    "q47_seed_table": "SELECT id, @SEED{concat('20260710:boot:x:', CAST(id AS VARCHAR(20)))} AS seed FROM @IDS{100}",
    "q48_boot_percentile_mean": _boot(200, _MEAN, "boot") + " SELECT round(@PCT{s|0.025}, 4) AS lo, round(@PCT{s|0.975}, 4) AS hi, round(avg(s), 4) AS mid FROM s",
    "q49_paired_diff_cohen_d": "WITH p AS (SELECT a.l_orderkey, a.l_extendedprice - b.l_extendedprice AS d FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2) SELECT count(*) AS n, round(avg(d), 4) AS diff, round(CASE WHEN stddev_samp(d) = 0 THEN 0 ELSE avg(d) / stddev_samp(d) END, 6) AS cohen_d FROM p",
    "q50_boot_p": _boot(200, _MEAN + " - 36000", "p") + " SELECT round(least(CAST(1 AS DOUBLE), 2 * least((sum(CASE WHEN s <= 0 THEN 1 ELSE 0 END) + 1) / CAST(201 AS DOUBLE), (sum(CASE WHEN s >= 0 THEN 1 ELSE 0 END) + 1) / CAST(201 AS DOUBLE))), 6) AS p FROM s",
    "q51_holm": """WITH p AS (SELECT p_partkey AS idx, p_brand AS family, @SEED{concat('holm:', CAST(p_partkey AS VARCHAR(20)))} % 10000 AS millionths FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY millionths, idx) AS rk, count(*) OVER (PARTITION BY family) AS m FROM p)
SELECT idx, family, CAST(millionths AS DOUBLE) / 1000000 AS p, min(CASE WHEN millionths * (m - rk + 1) <= 50000 THEN 1 ELSE 0 END) OVER (PARTITION BY family ORDER BY rk ROWS UNBOUNDED PRECEDING) = 1 AS rejected FROM r""",
    "q52_jackknife": "WITH x AS (SELECT o_orderkey, o_totalprice AS v FROM orders), t AS (SELECT sum(v) AS s, count(*) AS n FROM x) SELECT o_orderkey, round((s - v) / (n - 1), 2) AS loo_mean FROM x CROSS JOIN t",
    "q53_ratio_boot": _boot(200, "CAST(sum(w * v) AS DOUBLE) / (100 * sum(w * q))", "ratio") + " SELECT round(@PCT{s|0.025}, 4) AS lo, round(@PCT{s|0.975}, 4) AS hi FROM s",
    "q54_supersede_anti": "WITH s AS (SELECT o_orderkey - 1 AS k FROM orders WHERE o_orderstatus = 'P') SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.k = o_orderkey)",
    "q55_resume_anti": "WITH c AS (SELECT n_nationkey AS a, id AS b FROM nation CROSS JOIN @IDS{5}), d AS (SELECT DISTINCT c_nationkey AS a, c_custkey % 7 AS b FROM customer) SELECT CAST(c.a AS BIGINT) AS a, CAST(c.b AS BIGINT) AS b FROM c LEFT JOIN d ON c.a = d.a AND c.b = d.b WHERE d.a IS NULL",
    "q56_plan_cells_cross": "SELECT r_name, n_name, CAST(id AS BIGINT) AS run_idx FROM region CROSS JOIN nation CROSS JOIN @IDS{3}",
    "q57_group_summary": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_extendedprice), 4) AS mean_price, max(l_quantity) AS max_qty, CASE WHEN count(*) < 3 THEN '--' WHEN min(l_tax) = max(l_tax) THEN 'degenerate' ELSE 'ok' END AS ci_kind FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "q58_campaign_aggregate": f"WITH {_RUNS} SELECT ctype, coder, count(*) AS n_runs, round(avg(CASE WHEN status = 'done' THEN enc_s END), 3) AS enc_s, CAST(sum(CASE WHEN status = 'censored' THEN 1 ELSE 0 END) AS BIGINT) AS n_censored, CAST(sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS BIGINT) AS n_failed, min(CASE WHEN roundtrip_ok THEN 1 ELSE 0 END) = 1 AS all_ok FROM r GROUP BY ctype, coder",
    "q59_pareto_front": """WITH p AS (SELECT p_partkey AS k, p_size AS thr, round(p_retailprice, 0) AS bpb FROM part), g AS (SELECT thr, min(bpb) AS bpb FROM p GROUP BY thr),
f AS (SELECT thr, bpb FROM (SELECT *, min(bpb) OVER (ORDER BY thr DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM g) z WHERE b IS NULL OR bpb < b)
SELECT min(p.k) AS k, p.thr, p.bpb FROM p JOIN f ON p.thr = f.thr AND p.bpb = f.bpb GROUP BY p.thr, p.bpb""",
    "q60_median_p95": "WITH x AS (SELECT o_orderpriority AS g, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT g, round(@PCT{v|0.5}, 4) AS median, round(max(CASE WHEN k = least(n - 1, floor(0.95 * n)) THEN v END), 4) AS p95 FROM x GROUP BY g",
    "q61_determinism_witness": "SELECT l_suppkey, max(l_orderkey) AS max_run, count(DISTINCT l_returnflag) AS shas, count(DISTINCT l_returnflag) <= 1 AS deterministic FROM lineitem GROUP BY l_suppkey",
    "q62_leg_compare": "WITH a AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer), b AS (SELECT s_suppkey AS k, s_nationkey AS v FROM supplier) SELECT count(*) AS rows_seen, CAST(sum(CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS matched, CAST(sum(CASE WHEN a.v = b.v THEN 1 ELSE 0 END) AS BIGINT) AS equal FROM a FULL OUTER JOIN b ON a.k = b.k",
    "q63_verdict_engine": "WITH m AS (SELECT n_nationkey, n_name, avg(c_acctbal) / 10000 AS spread FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name) SELECT n_name, CASE WHEN spread <= 0.40 THEN 'fails' WHEN spread <= 0.45 THEN 'marginal' ELSE 'qualifies' END AS verdict, concat('spread ', CAST(CAST(round(spread * 1000) AS BIGINT) AS VARCHAR(20))) AS reason FROM m",
    "q64_manifest_patch_sets": "WITH q AS (SELECT c_nationkey AS k, c_mktsegment AS s, avg(c_acctbal) > 4500 AS ok FROM customer GROUP BY c_nationkey, c_mktsegment), p AS (SELECT DISTINCT s_nationkey AS k, 'BUILDING' AS s FROM supplier) SELECT q.k, @SORTED{CASE WHEN ok AND p.k IS NULL THEN q.s END} AS added, @SORTED{CASE WHEN NOT ok AND p.k IS NOT NULL THEN q.s END} AS removed FROM q LEFT JOIN p ON q.k = p.k AND q.s = p.s GROUP BY q.k",
    "q65_mode_costs": f"WITH {_COST} SELECT source, CAST(mode AS BIGINT) AS mode, CAST(sum(bits) AS BIGINT) AS bits FROM c GROUP BY source, mode",
    "q66_oracle_fixed_regret": _SEL + ", f AS (SELECT source, mode, sum(bits) AS bits FROM c GROUP BY source, mode), b AS (SELECT source, min(bits) AS fixed FROM f GROUP BY source), s AS (SELECT source, sum(best) AS best FROM o GROUP BY source) SELECT b.source, round(CAST(fixed - best AS DOUBLE) / best, 6) AS regret FROM b JOIN s ON b.source = s.source",
    "q67_prefix_selector": _SEL + ", u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY u, mode) AS r2 FROM c) SELECT u.source, round(CAST(sum(u.bits + 3 - o.best) AS DOUBLE) / sum(o.best), 6) AS regret FROM u JOIN o ON u.doc_id = o.doc_id WHERE u.r2 = 1 GROUP BY u.source",
    "q68_causal_selector": _SEL + ", l AS (SELECT *, CAST(lag(bits, 1) OVER w AS DOUBLE) / lag(n, 1) OVER w * n AS v FROM c WINDOW w AS (PARTITION BY source, mode ORDER BY doc_id)), s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(coalesce(v, 0), 6), mode) AS r2 FROM l) SELECT s.source, round(CAST(sum(s.bits - o.best) AS DOUBLE) / sum(o.best), 6) AS regret FROM s JOIN o ON s.doc_id = o.doc_id WHERE r2 = 1 GROUP BY s.source",
    "q69_2eps_bound": _SEL + ", u AS (SELECT * FROM c), e AS (SELECT doc_id, max(abs(u - bits)) AS eps FROM u GROUP BY doc_id), s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY u, mode) AS r2 FROM u) SELECT s.doc_id, s.bits <= o.best + 2 * e.eps AS holds FROM s JOIN o ON s.doc_id = o.doc_id JOIN e ON s.doc_id = e.doc_id WHERE r2 = 1",
    "q65b_winner_table": _SEL + " SELECT source, CAST(mode AS BIGINT) AS mode, count(*) AS wins FROM rk WHERE rk = 1 GROUP BY source, mode",
    "q78_iid_rate_function": "WITH t AS (SELECT id, id * 0.05 AS t FROM @IDS{1200}), l AS (SELECT t, log2(0.5 * power(0.5, -t) + 0.25 * power(0.25, -t) + 0.15 * power(0.15, -t) + 0.1 * power(0.1, -t)) AS lam FROM t), r AS (SELECT id, 1.9 + id * 0.1 AS rate FROM @IDS{10}) SELECT CAST(id AS BIGINT) AS id, round(max(t * rate - lam), 6) AS e FROM r CROSS JOIN l GROUP BY id",
    "q79_gumbel_norming": "SELECT CAST(id AS BIGINT) AS m, round(sqrt(2 * ln(id)), 6) AS a, round(sqrt(2 * ln(id)) - (ln(ln(id)) + ln(4 * pi())) / (2 * sqrt(2 * ln(id))), 6) AS b FROM @IDS{1025} WHERE id >= 3",
    "q81_small_n_block_law": "SELECT @POP{@XOR{id|@DIV{id|2}} % 2048} AS switches, count(*) AS vectors, round(sum(power(2, -1 + @POP{@XOR{id|@DIV{id|2}} % 2048} * log2(0.2) + (11 - @POP{@XOR{id|@DIV{id|2}} % 2048}) * log2(0.8))), 9) AS p FROM @IDS{4096} GROUP BY 1",
    "q82_affine_fit": "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem",
    "q83_ks_distance": """WITH g AS (SELECT l_quantity / 50.0 AS v, count(*) AS c FROM lineitem GROUP BY l_quantity), x AS (SELECT v, c, sum(c) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS i, sum(c) OVER () AS n FROM g)
SELECT round(max(greatest(abs(CAST(i AS DOUBLE) / n - v), abs(CAST(i - c AS DOUBLE) / n - v))), 6) AS ks FROM x""",
    "q84_weighted_quantile": "WITH x AS (SELECT p_size AS v, sum(p_retailprice) AS w FROM part GROUP BY p_size), c AS (SELECT v, sum(w) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS cw, sum(w) OVER () AS t FROM x) SELECT CAST(min(v) AS BIGINT) AS q90 FROM c WHERE cw >= 0.9 * t",
    "q85_mc_block_max": "WITH u AS (SELECT id, @DIV{id|50} AS blk, @SEED{concat('mc:', CAST(id AS VARCHAR(20)))} % 16 AS s FROM @IDS{20000}), b AS (SELECT blk, sum(s) AS s FROM u GROUP BY blk) SELECT CAST(@DIV{blk|20} AS BIGINT) AS path, CAST(max(s) AS BIGINT) AS most FROM b GROUP BY @DIV{blk|20}",
    "q86_draw_up": "WITH u AS (SELECT @DIV{id|1000} AS path, id, @SEED{concat('up:', CAST(id AS VARCHAR(20)))} % 17 - 8 AS d FROM @IDS{20000}), s AS (SELECT path, id, sum(d) OVER (PARTITION BY path ORDER BY id ROWS UNBOUNDED PRECEDING) AS s FROM u), m AS (SELECT path, s - least(0, min(s) OVER (PARTITION BY path ORDER BY id ROWS UNBOUNDED PRECEDING)) AS up FROM s) SELECT CAST(path AS BIGINT) AS path, CAST(max(up) AS BIGINT) AS draw_up FROM m GROUP BY path",
    "q93_rd_table": "WITH d AS (SELECT id, (id + 1) * 0.01 AS d FROM @IDS{45}) SELECT CAST(id AS BIGINT) AS id, round(1 + d * log2(d) + (1 - d) * log2(1 - d), 6) AS rate FROM d",
    "q94_adaptive_k": "WITH r AS (SELECT o_orderpriority AS grp, count(*) * 1.0 AS n, avg(o_totalprice) / 1000 AS g, max(o_totalprice) / min(o_totalprice) AS a FROM orders GROUP BY o_orderpriority) SELECT grp, round(sqrt(n * g / a), 4) AS best_k, round(2 * sqrt(g * n * a), 2) AS cost FROM r",
    "q96_makespan": "SELECT CAST(n.id AS BIGINT) AS n, CAST(p.id + 1 AS BIGINT) AS p, CAST(ceil(ceil((n.id + 1) * 1000 / 64.0) / least(p.id + 1, ceil((n.id + 1) * 1000 / 64.0))) * 64 AS BIGINT) AS span FROM @IDS{20} n CROSS JOIN @IDS{8} p",
    "q97_perfect_lfu_hit": "WITH a AS (SELECT l_partkey AS k, count(*) AS c FROM lineitem GROUP BY l_partkey), r AS (SELECT *, row_number() OVER (ORDER BY c DESC, k) AS rk FROM a) SELECT CAST(sum(CASE WHEN rk <= 200 THEN c ELSE 0 END) AS BIGINT) AS hits, CAST(sum(CASE WHEN rk > 200 THEN c * (10 + k % 5) ELSE 0 END) AS BIGINT) AS miss_latency FROM r",
    "q98_access_cost_model": "SELECT CAST(id AS BIGINT) AS p, CAST(id % 64 + 10 AS BIGINT) AS decoded, CAST(@DIV{id + 9|64} - @DIV{id|64} + 1 AS BIGINT) AS blocks FROM @IDS{1000}",
    "q99_kraft": "WITH l AS (SELECT event_type, ceil(-log2(count(*) * 1.0 / sum(count(*)) OVER ())) AS l FROM events GROUP BY event_type) SELECT round(sum(power(2, -l)), 9) AS kraft, sum(power(2, -l)) <= 1 AS ok FROM l",
    "q101_ising_small": "WITH s AS (SELECT id, 7 - 2 * @POP{@XOR{id|@DIV{id|2}} % 128} AS e FROM @IDS{256}), z AS (SELECT *, exp(0.4 * e) AS w FROM s), t AS (SELECT sum(w) AS z FROM z) SELECT round(-sum(w / t.z * log2(w / t.z)), 6) AS entropy, round(sum(w / t.z * e), 6) AS energy FROM z CROSS JOIN t",
    "q104_sync_overhead": "SELECT CAST(id AS BIGINT) AS id, round((3.9 - 2.1) / (power(2, id + 4) * 2.1), 8) AS overhead FROM @IDS{12}",
    "q105_store_mode_accounting": "SELECT l_orderkey, CAST(sum(1 + least(8 * l_quantity, 4 * l_quantity + l_linenumber * 30)) AS BIGINT) AS bits FROM lineitem GROUP BY l_orderkey",
    "q106_mac_overhead": "SELECT doc_id, 128 * @DIV{octet_length(@UTF{text}) + 1023|1024} AS mac_bits FROM documents WHERE text IS NOT NULL",
    "q107_model_tradeoff": "SELECT CAST(id AS BIGINT) AS id, round(power(CAST((id + 1) * 2100 AS DOUBLE), CAST(1 AS DOUBLE) / CAST(1.7 AS DOUBLE)), 4) AS best_l FROM @IDS{20}",
    "q108_latest_record": "WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rk FROM events) SELECT user_id, event_id, event_type FROM r WHERE rk = 1",
    "q109_fields_flat": "SELECT event_id, round(value, 3) AS enc_mb_s, coalesce(event_type, 'none') AS family FROM events WHERE event_type IN ('click', 'view', 'purchase') OR event_type IS NOT NULL",
    "q80_kt_codelength_types": "WITH s AS (SELECT k.id AS k, i.id AS i FROM @IDS{17} k CROSS JOIN @IDS{16} i) SELECT CAST(k AS BIGINT) AS k, round(sum(log2(i + 1.0) - CASE WHEN i < k THEN log2(i + 0.5) ELSE log2(i - k + 0.5) END), 6) AS bits FROM s GROUP BY k",
    "q102_cooccurrence_edges": """WITH l AS (SELECT item_id, @WORDS{text} AS l FROM benchmark), e AS (SELECT item_id, l, @EACH{1|@LEN{l}} AS i FROM l WHERE @LEN{l} > 0), t AS (SELECT item_id, i, @AT{l|i} AS w FROM e),
n AS (SELECT w, lead(w, 1) OVER v AS w1, lead(w, 2) OVER v AS w2 FROM t WINDOW v AS (PARTITION BY item_id ORDER BY i)),
p AS (SELECT least(w, w1) AS a, greatest(w, w1) AS b FROM n WHERE w1 <> w UNION ALL SELECT least(w, w2), greatest(w, w2) FROM n WHERE w2 <> w)
SELECT a, b, count(*) AS n FROM p GROUP BY a, b""",
    "q103_embedding_bit_tc": """WITH s AS (SELECT @SIGNS{embedding} AS s FROM embeddings WHERE embedding IS NOT NULL), n AS (SELECT count(*) AS n FROM s),
d AS (SELECT k.id AS k, sum(CASE WHEN substr(s, CAST(k.id + 1 AS INT), 1) = '1' THEN 1 ELSE 0 END) AS c FROM s CROSS JOIN @IDS{64} k GROUP BY k.id),
m AS (SELECT sum(CASE WHEN c = 0 OR c = n THEN 0 ELSE -(CAST(c AS DOUBLE) / n) * log2(CAST(c AS DOUBLE) / n) - (CAST(n - c AS DOUBLE) / n) * log2(CAST(n - c AS DOUBLE) / n) END) AS h, sum(CASE WHEN c = 0 OR c = n THEN 0 ELSE 1 END) AS free FROM d CROSS JOIN n),
j AS (SELECT s, count(*) AS c FROM s GROUP BY s), h AS (SELECT -sum(CAST(c AS DOUBLE) / n * log2(CAST(c AS DOUBLE) / n)) AS h, count(*) AS patterns FROM j CROSS JOIN n)
SELECT round(m.h - h.h, 6) AS tc, round(m.h - h.h + (free - (patterns - 1)) / (2.0 * n * ln(2)), 6) AS tc_mm, patterns FROM m CROSS JOIN h CROSS JOIN n""",
    "q110_zipf_weights": "WITH w AS (SELECT id + 1 AS k, 1.0 / (id + 1) AS w FROM @IDS{100}), c AS (SELECT k, sum(w) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) / sum(w) OVER () AS hit FROM w) SELECT CAST(k AS BIGINT) AS capacity, round(CAST(hit AS DOUBLE), 6) AS lfu_hit FROM c",
    "q115_sum_order_invariance": "WITH x AS (SELECT l_orderkey % 16 AS part_no, l_partkey * 1000003 + l_suppkey AS v FROM lineitem), p AS (SELECT part_no, sum(v) AS s FROM x GROUP BY part_no) SELECT CAST((SELECT sum(s) FROM p) AS BIGINT) AS by_parts, CAST((SELECT sum(v) FROM x) AS BIGINT) AS at_once",
}


def q115_sum_order_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the SQL of this name says, in exact decimals; sums beyond BIGINT, where the SQL is an error, stay DECIMAL(38, 0)."""
    wide = lambda c: F.col(c).cast("decimal(19, 0)")
    items = spread(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    x = items.select((F.col("l_orderkey") % 16).alias("part_no"), (wide("l_partkey") * 1000003 + wide("l_suppkey")).alias("v"))
    by_parts = x.groupBy("part_no").agg(F.sum("v").alias("s")).agg(F.sum("s").alias("by_parts"))
    sums = by_parts.crossJoin(x.agg(F.sum("v").alias("at_once"))).first()
    fits = all(s is None or -(1 << 63) <= s < 1 << 63 for s in sums)
    row = tuple(s if s is None or not fits else int(s) for s in sums)
    kind = "bigint" if fits else "decimal(38, 0)"
    return spark.createDataFrame([row], f"by_parts {kind}, at_once {kind}")


#: Queries that Spark runs by plans of their own; their SQL is the oracle.
QUERIES = {"q115_sum_order_invariance": q115_sum_order_invariance}
