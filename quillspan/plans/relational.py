"""Queries on reassembly, coverage, statistics, splits: step by step with their SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quillspan.functions import text
from quillspan.functions.text import count_band, group_hash, words
from quillspan.operators import audit, evaluation, reassembly, splitting, stats
from quillspan.sources import tabular
from quillspan.sources.adapters import read, segments

QUERIES, ORACLES = {}, {}
SEG = "seg AS (SELECT doc_id, unnest(ls) AS text, (generate_subscripts(ls, 1) - 1)::INT AS segment_index FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"
WORDS = r"len(list_filter(string_split_regex({}, '[\s\x0b\x1c-\x1f\x85\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+'), lambda x: x <> ''))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {SEG} SELECT doc_id, string_agg(text, chr(10) ORDER BY segment_index) AS full_text, count(*)::INT AS n_segments, (count(*) FILTER (trim(text, ' ' || chr(9) || chr(13) || chr(160)) <> ''))::INT AS n_nonempty_segments, true AS contiguous, length(string_agg(text, chr(10) ORDER BY segment_index))::INT AS n_chars, {WORDS.format('string_agg(text, chr(10) ORDER BY segment_index)')}::INT AS n_words FROM seg GROUP BY doc_id")
def reassemble_documents(spark, d):
    return reassembly.reassemble(segments(spark, d))


@query("SELECT conv_id AS doc_id, string_agg(text, chr(10) ORDER BY turn) AS full_text, count(*)::INT AS n_segments FROM conversations GROUP BY conv_id")
def conversation_reassembly(spark, d):
    rows = read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("segment_index"), "text")
    return reassembly.reassemble(rows).select("doc_id", "full_text", "n_segments")


@query("SELECT 'n_chars' AS field, count(*) AS documents, count(*) FILTER (length(text) <> n_chars) AS mismatches FROM documents")
def reassembly_checks(spark, d):
    return reassembly.metadata_mismatches(reassembly.reassemble(segments(spark, d)), read(spark, d, "documents"), ["n_chars"])


@query(f"WITH {SEG} SELECT count(*) AS segments, count(*) FILTER (text = '') AS empty_segments, count(*) FILTER (text <> '' AND trim(text, ' ' || chr(9) || chr(13)) = '') AS blank_segments, count(DISTINCT doc_id) FILTER (regexp_matches(text, '[^\\x00-\\x7F]')) AS non_ascii_documents, count(DISTINCT doc_id) FILTER (contains(text, chr(13))) AS cr_documents, count(DISTINCT doc_id) FILTER (contains(text, chr(10))) AS newline_documents FROM seg")
def segment_profile(spark, d):
    return reassembly.segment_profile(segments(spark, d))


@query("SELECT CASE WHEN b IS NULL THEN 'left_only' WHEN a IS NULL THEN 'right_only' ELSE 'both' END AS side, count(*) AS keys FROM (SELECT DISTINCT doc_id AS a FROM documents) FULL JOIN (SELECT DISTINCT doc_id AS b FROM labels) ON a = b GROUP BY 1")
def coverage_full_outer(spark, d):
    return audit.coverage(read(spark, d, "documents"), read(spark, d, "labels"), "doc_id")


@query("SELECT * FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def orphan_labels_anti(spark, d):
    owners = read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    o = read(spark, d, "orders")
    return audit.orphans(o, owners, "o_custkey").select(*o.columns)


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def left_default_counts(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return audit.with_counts(read(spark, d, "customer").select("c_custkey"), o, "c_custkey", "n_orders")


@query("(SELECT l_partkey AS k, 'left' AS side FROM lineitem WHERE l_returnflag = 'A' EXCEPT ALL SELECT l_partkey, 'left' FROM lineitem WHERE l_returnflag = 'R') UNION ALL (SELECT l_partkey, 'right' FROM lineitem WHERE l_returnflag = 'R' EXCEPT ALL SELECT l_partkey, 'right' FROM lineitem WHERE l_returnflag = 'A')")
def symmetric_difference(spark, d):
    keys = lambda f: read(spark, d, "lineitem").where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k"))
    return audit.symmetric_difference(keys("A"), keys("R"))


@query("WITH h AS (SELECT doc_id, lang, sha256(array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), ' ')) AS key FROM documents), p AS (SELECT key, list_sort(list(DISTINCT lang)) AS ls FROM h WHERE doc_id % 2 = 0 GROUP BY key) SELECT doc_id, array_to_string(coalesce(ls, []), ',') AS overlap FROM h LEFT JOIN p USING (key) WHERE doc_id % 2 = 1")
def weak_overlap_partitions(spark, d):
    h = read(spark, d, "documents").select("doc_id", "lang", group_hash(F.col("text")).alias("key"))
    out = audit.shared_partitions(h.where("doc_id % 2 = 1").select("doc_id", "key"), h.where("doc_id % 2 = 0"), "key", "lang")
    return out.select("doc_id", F.array_join("overlap_partitions", ",").alias("overlap"))


@query("SELECT sha256(array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), ' ')) AS key, count(*) AS members, min(doc_id) AS smallest, count(DISTINCT lang) > 1 AS conflict, count(*) - 1 AS excess FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, d):
    return audit.duplicates(read(spark, d, "documents"), group_hash(F.col("text")), "doc_id", "lang")


@query("SELECT conv_id, count(*) AS n, (min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*)) AS contiguous FROM conversations GROUP BY conv_id")
def contiguity(spark, d):
    return audit.contiguity(read(spark, d, "conversations"), "conv_id", "turn")


@query("""SELECT name, failures, denominator, CASE WHEN failures = 0 THEN 'pass' ELSE 'fail' END AS status, CASE WHEN name = 'short_text' THEN (SELECT string_agg(i, ',' ORDER BY i) FROM (SELECT DISTINCT doc_id::VARCHAR AS i FROM documents WHERE length(text) < 200 ORDER BY 1 LIMIT 8)) ELSE '' END AS examples FROM (
  SELECT 'short_text' AS name, count(*) FILTER (length(text) < 200) AS failures, count(*) AS denominator FROM documents UNION ALL SELECT 'n_chars' AS name, count(*) FILTER (length(text) <> n_chars) AS failures, count(*) AS denominator FROM documents
  UNION ALL SELECT 'unique_id', (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)), (SELECT count(DISTINCT doc_id) FROM documents)
  UNION ALL SELECT 'label_owner', count(*) FILTER (d.doc_id IS NULL), count(*) FROM labels l LEFT JOIN (SELECT DISTINCT doc_id FROM documents) d USING (doc_id))""")
def check_rows(spark, d):
    docs, lab = read(spark, d, "documents"), read(spark, d, "labels")
    a = audit.check("n_chars", docs, F.length("text") != F.col("n_chars"), "doc_id")
    b = audit.check("unique_id", docs.groupBy("doc_id").count(), F.col("count") > 1, "doc_id")
    owned = lab.join(docs.select("doc_id").distinct().withColumn("own", F.lit(1)), "doc_id", "left")
    c = audit.check("label_owner", owned, F.col("own").isNull(), "doc_id")
    few = audit.check("short_text", docs, F.length("text") < 200, "doc_id")
    return a.unionByName(b).unionByName(c).unionByName(few).withColumn("examples", F.array_join("examples", ","))


@query("SELECT lang AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 9) AS share FROM documents GROUP BY lang")
def category_shares(spark, d):
    return stats.shares(read(spark, d, "documents"), "lang").withColumn("share", F.round("share", 9))


QS = ", ".join(f"round(quantile_cont(x, {q}), 6) AS q{int(q * 100):03d}" for q in stats.QUANTILES)


@query(f"SELECT \"group\", field, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, {QS} FROM (SELECT l_returnflag AS \"group\", 'l_quantity' AS field, l_quantity AS x FROM lineitem UNION ALL SELECT l_returnflag, 'l_extendedprice', l_extendedprice FROM lineitem) GROUP BY ALL")
def quantile_profile(spark, d):
    out = stats.quantile_profile(read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], "l_returnflag")
    return out.select("group", "field", "n", *[F.round(c, 6).alias(c) for c in out.columns[3:]])


@query("SELECT list_sort(list(n_chars))[(floor(count(*) * 0.95) + 1)::INT] AS value FROM documents")
def index_quantile(spark, d):
    return stats.index_quantile(read(spark, d, "documents"), "n_chars", 0.95)


@query("""WITH x AS (SELECT l_linestatus = 'F' AS s, l_quantity AS q, l_extendedprice AS p, l_discount AS c FROM lineitem), u AS (SELECT s, 'l_quantity' AS field, q AS x FROM x UNION ALL SELECT s, 'l_extendedprice', p FROM x UNION ALL SELECT s, 'l_discount', c FROM x)
SELECT field, round(d, 6) AS difference, round(d / CASE WHEN v = 0 THEN 1 ELSE v END, 9) AS smd FROM (SELECT field, avg(x) FILTER (s) - avg(x) FILTER (NOT s) AS d, sqrt((var_pop(x) FILTER (s) + var_pop(x) FILTER (NOT s)) / 2) AS v FROM u GROUP BY field)""")
def numeric_drift_smd(spark, d):
    out = stats.mean_difference(read(spark, d, "lineitem"), F.col("l_linestatus") == "F", ["l_quantity", "l_extendedprice", "l_discount"])
    return out.select("field", F.round("difference", 6).alias("difference"), F.round("smd", 9).alias("smd"))


@query("""WITH c AS (SELECT value AS x, count(*) FILTER (event_type <> 'click') AS a, count(*) FILTER (event_type = 'click') AS b FROM events GROUP BY 1)
SELECT n_first, n_second, round(statistic, 9) AS statistic, round(CASE WHEN z < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, list_sum(list_transform(generate_series(1, 100), lambda j: (CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * j * j * z * z))))) END, 9) AS p_value
FROM (SELECT *, statistic * sqrt(n_first * n_second / (n_first + n_second)) AS z FROM (SELECT (SELECT sum(a) FROM c)::BIGINT AS n_first, (SELECT sum(b) FROM c)::BIGINT AS n_second, max(g) AS statistic FROM (SELECT abs(sum(a) OVER (ORDER BY x) / sum(a) OVER () - sum(b) OVER (ORDER BY x) / sum(b) OVER ()) AS g FROM c)))""")
def ks_statistic(spark, d):
    out = stats.ks_statistic(read(spark, d, "events"), F.col("event_type") == "click", "value")
    return out.select(F.col("n_first").cast("long").alias("n_first"), F.col("n_second").cast("long").alias("n_second"), F.round("statistic", 9).alias("statistic"), F.round("p_value", 9).alias("p_value"))


@query("""WITH p AS (SELECT lang AS v, count(*) / sum(count(*)) OVER () AS p FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), q AS (SELECT lang AS v, count(*) / sum(count(*)) OVER () AS q FROM documents WHERE doc_id % 2 = 1 GROUP BY 1)
SELECT round(0.5 * sum(abs(coalesce(p, 0) - coalesce(q, 0))), 9) AS tvd FROM p FULL JOIN q USING (v)""")
def category_tvd(spark, d):
    docs = read(spark, d, "documents")
    return stats.total_variation(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "lang").select(F.round("tvd", 9).alias("tvd"))


COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS r FROM lineitem" for a in COLS for b in COLS))
def pearson_matrix(spark, d):
    return stats.pearson(read(spark, d, "lineitem"), COLS).select("a", "b", F.round("r", 9).alias("r"))


@query("""WITH c AS (SELECT event_type AS r, strftime(ts, '%Y-%m-%d') AS c, count(*)::DOUBLE AS o FROM events GROUP BY 1, 2),
m AS (SELECT *, sum(o) OVER (PARTITION BY r) AS rn, sum(o) OVER (PARTITION BY c) AS cn FROM c),
t AS (SELECT sum(o) AS n, count(DISTINCT r) AS kr, count(DISTINCT c) AS kc, sum(o * o / (rn * cn)) - 1 AS phi FROM m)
SELECT n::BIGINT AS n, round(sqrt(greatest(0, phi - (kc - 1) * (kr - 1) / greatest(1, n - 1)) / greatest(1e-12, least(kc - (kc - 1) ** 2 / greatest(1, n - 1) - 1, kr - (kr - 1) ** 2 / greatest(1, n - 1) - 1))), 9) AS v FROM t""")
def cramers_v_corrected(spark, d):
    e = read(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return stats.cramers_v(e, "event_type", "day").select("n", F.round("v", 9).alias("v"))


@query("""WITH t AS (SELECT doc_id % 2 AS s, unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS w FROM documents), a AS (SELECT w, count(*) AS n FROM t WHERE s = 0 GROUP BY 1), b AS (SELECT w, count(*) AS n FROM t WHERE s = 1 GROUP BY 1)
SELECT count(a.w) AS vocab_a, count(b.w) AS vocab_b, count(*) FILTER (a.w IS NOT NULL AND b.w IS NOT NULL) AS shared, round(coalesce(sum(b.n) FILTER (a.w IS NULL), 0) / greatest(1, sum(b.n)), 9) AS oov_rate FROM a FULL JOIN b ON a.w = b.w""")
def vocab_oov(spark, d):
    t = read(spark, d, "documents").select("doc_id", F.explode(words(F.col("text"))).alias("w"))
    out = stats.vocabulary_overlap(t.where("doc_id % 2 = 0"), t.where("doc_id % 2 = 1"), "w")
    return out.withColumn("oov_rate", F.round("oov_rate", 9))


@query("SELECT l_partkey, l_returnflag, n FROM (SELECT l_partkey, l_returnflag, count(*) AS n, row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, l_returnflag) AS r FROM lineitem GROUP BY 1, 2) WHERE r = 1")
def mode_with_ties(spark, d):
    return stats.modes(read(spark, d, "lineitem"), "l_partkey", "l_returnflag")


@query("SELECT lang AS \"group\", round(avg(length(text) - length(replace(text, chr(10), ''))), 9) AS mean_newlines, round(avg(len(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '\\S')))), 9) AS mean_blank_lines, round(avg(regexp_matches(text, '\\d')::INT), 9) AS digit_rate, round(avg(regexp_matches(text, '[\\p{L}\\p{N}_.+-]+@[\\p{L}\\p{N}_.-]+')::INT), 9) AS email_rate FROM documents GROUP BY lang")
def format_profile(spark, d):
    out = stats.format_profile(read(spark, d, "documents"), group="lang")
    return out.select("group", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


@query("SELECT min(strftime(ts, '%Y-%m-%d')) AS low, max(strftime(ts, '%Y-%m-%d')) AS high, count(DISTINCT strftime(ts, '%Y-%m-%d')) AS dates FROM events")
def date_bucket_profile(spark, d):
    return stats.date_profile(read(spark, d, "events"), "ts")[0]


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def date_top_days(spark, d):
    return stats.date_profile(read(spark, d, "events"), "ts")[1]


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS \"distinct\" FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")))
def column_profile(spark, d):
    return stats.column_profile(read(spark, d, "orders"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS qty FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus), (l_returnflag, l_linestatus))")
def multi_granularity(spark, d):
    return stats.cube_counts(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], {"n": F.count("*"), "qty": F.round(F.sum("l_quantity"), 4)})


@query("SELECT bit, count(*) AS n FROM lineitem, (SELECT unnest([0, 1, 2, 3])::INT AS bit) WHERE (l_linenumber::BIGINT >> bit) & 1 = 1 GROUP BY bit")
def bit_flag_groups(spark, d):
    return stats.bit_groups(read(spark, d, "lineitem"), "l_linenumber", 4, {"n": F.count("*")})


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 9) AS avg_disc FROM lineitem GROUP BY 1, 2")
def group_pivot_counts(spark, d):
    l = read(spark, d, "lineitem")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 9).alias("avg_disc"))


@query("SELECT lang, string_agg(source || '=' || n, ',' ORDER BY source) AS counts FROM (SELECT lang, coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")
def nested_counts(spark, d):
    out = stats.nested_counts(read(spark, d, "documents"), "lang", "source")
    return out.select("lang", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer), m AS (SELECT a.k AS x, b.k AS y FROM a FULL JOIN b USING (k))
SELECT count(*) FILTER (y IS NULL) AS only_first, count(*) FILTER (x IS NULL) AS only_second, count(*) FILTER (x = y) AS both, count(*) FILTER (y IS NULL) = 0 AS subset, count(*) FILTER (y IS NULL OR x IS NULL) = 0 AS equal FROM m""")
def set_relation(spark, d):
    return audit.set_relation(read(spark, d, "orders").select(F.col("o_custkey").alias("k")), read(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k")


@query("SELECT doc_id, concat_ws('|', source, lang, CASE WHEN n <= 10 THEN '1-10' WHEN n <= 15 THEN '11-15' ELSE '16+' END) AS stratum FROM (SELECT *, len(string_split(text, chr(10))) AS n FROM documents)")
def stratum_keys(spark, d):
    lines = F.size(F.split("text", "\n", -1))
    return read(spark, d, "documents").select("doc_id", F.concat_ws("|", "source", "lang", count_band(lines)).alias("stratum"))


def records(spark, d):
    docs = read(spark, d, "documents")
    lines = F.size(F.split("text", "\n", -1))
    fixed = F.when(F.col("doc_id") % 50 == 0, "train").when(F.col("doc_id") % 41 == 0, "reviewed")
    base = docs.select(F.col("doc_id").alias("document_id"), group_hash(F.col("text")).alias("duplicate_group"), F.concat_ws("|", "lang", count_band(lines)).alias("stratum"), fixed.alias("fixed"))
    return base.withColumn("fixed", F.when(F.max(F.when(F.col("fixed") == "train", 1)).over(Window.partitionBy("duplicate_group")) == 1, "train").otherwise(F.col("fixed")))


@query("""WITH r AS (SELECT doc_id, sha256(array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), ' ')) AS g, lang || '|' || CASE WHEN len(string_split(text, chr(10))) <= 10 THEN '1-10' WHEN len(string_split(text, chr(10))) <= 15 THEN '11-15' ELSE '16+' END AS stratum, CASE WHEN doc_id % 50 = 0 THEN 'train' WHEN doc_id % 41 = 0 THEN 'reviewed' END AS fixed FROM documents),
g AS (SELECT g, count(*) AS size, arg_min(stratum, doc_id) AS stratum, CASE WHEN bool_or(fixed = 'train') THEN 'train' WHEN bool_or(fixed = 'reviewed') THEN 'dev' END AS role FROM r GROUP BY g),
t AS (SELECT *, sum(size) OVER (PARTITION BY stratum) AS total, coalesce(sum(size) FILTER (role = 'dev') OVER (PARTITION BY stratum), 0) AS devfix FROM g),
u AS (SELECT *, CASE WHEN total >= 10 THEN greatest(1, round_even(total * 0.1, 0)) ELSE 0 END AS target FROM t),
f AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY stratum ORDER BY sha256('2026:' || g) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u WHERE role IS NULL),
h AS (SELECT *, before < target AS hold, coalesce(sum(size) FILTER (before < target) OVER (PARTITION BY stratum), 0) AS held FROM f),
p AS (SELECT g, CASE WHEN hold THEN 'holdout' WHEN devfix + before - held < target THEN 'dev' ELSE 'train' END AS partition FROM h UNION ALL SELECT g, role FROM u WHERE role IS NOT NULL)
SELECT g AS duplicate_group, doc_id AS document_id, r.stratum, partition FROM r JOIN p USING (g)""")
def stratified_group_split(spark, d):
    return splitting.assign_splits(records(spark, d), 2026)


@query("SELECT doc_id FROM documents ORDER BY sha256('7:' || doc_id), doc_id LIMIT 100")
def hash_order_sample(spark, d):
    return splitting.hash_sample(read(spark, d, "documents").select("doc_id"), "doc_id", 100, 7)


GROUPS = "g AS (SELECT l_partkey AS group_id, count(*) AS size FROM lineitem GROUP BY 1), o AS (SELECT *, coalesce(sum(size) OVER (ORDER BY sha256('11:' || group_id), group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)"


def part_groups(spark, d):
    return read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("group_id")).agg(F.count("*").alias("size"))


@query(f"WITH {GROUPS}, c AS (SELECT * FROM o WHERE before < 1000), e0 AS (SELECT group_id, size FROM o WHERE before >= 1000), e AS (SELECT *, coalesce(sum(size) OVER (ORDER BY sha256('11:' || group_id), group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e0) SELECT group_id, size, 'CAL' AS role FROM c UNION ALL SELECT group_id, size, CASE WHEN before < 3000 THEN 'EVAL' ELSE 'FIT' END FROM e")
def family_role_assignment(spark, d):
    return splitting.quota_roles(part_groups(spark, d), [("CAL", 1000), ("EVAL", 3000)], "FIT", 11)


@query(f"WITH {GROUPS} SELECT group_id, size FROM o WHERE before < 5000")
def whole_family_sample(spark, d):
    return splitting.family_sample(part_groups(spark, d), 5000, 11)


@query("""WITH RECURSIVE g AS MATERIALIZED (SELECT group_id, size, row_number() OVER (ORDER BY size DESC, sha256('11:' || group_id), group_id) AS r FROM (SELECT l_partkey AS group_id, count(*) AS size FROM lineitem GROUP BY 1)),
s AS (SELECT 0::BIGINT AS r, [0, 0, 0]::BIGINT[] AS loads, 0 AS fold UNION ALL
  SELECT g.r, list_transform(s.loads, lambda x, i: x + CASE WHEN i = list_position(s.loads, list_min(s.loads)) THEN g.size ELSE 0 END), list_position(s.loads, list_min(s.loads)) - 1 FROM s JOIN g ON g.r = s.r + 1)
SELECT group_id, size, fold::INT AS fold FROM g JOIN s USING (r)""")
def greedy_folds(spark, d):
    return splitting.greedy_folds(part_groups(spark, d), 3, 11)


@query("SELECT l_orderkey, count(*) AS members FROM lineitem GROUP BY 1 HAVING bool_and(l_discount < 0.08)")
def whole_family_eligibility(spark, d):
    return splitting.whole_families(read(spark, d, "lineitem").withColumn("ok", F.col("l_discount") < 0.08), "l_orderkey", "ok")


@query("""WITH e AS (SELECT c_custkey AS k, 'rich' AS f FROM customer WHERE c_acctbal > 5000 UNION SELECT o_custkey, 'buyer' FROM orders WHERE o_totalprice > 100000)
SELECT c.c_custkey, array_to_string(coalesce(list_sort(list(f) FILTER (f IS NOT NULL)), []), ',') AS flags, count(f) > 0 AS exposed FROM customer c LEFT JOIN e ON k = c_custkey GROUP BY 1""")
def exposure_flags(spark, d):
    c = read(spark, d, "customer")
    ev = {"rich": c.where("c_acctbal > 5000").select("c_custkey"), "buyer": read(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))}
    return splitting.exposure_flags(c.select("c_custkey"), ev, "c_custkey").withColumn("flags", F.array_join("flags", ","))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS y, l_orderkey || '-' || l_linenumber AS i FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY sha256('3:' || i), i) AS r, count(*) OVER (PARTITION BY l_orderkey) AS c FROM x WHERE NOT y)
SELECT l_orderkey, l_linenumber, y, i, 1.0::DOUBLE AS weight FROM x WHERE y UNION ALL SELECT l_orderkey, l_linenumber, y, i, c / least(c, 2) FROM n WHERE r <= 2""")
def capped_negative_sampling(spark, d):
    x = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("y"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("i"))
    return splitting.capped_negatives(x, "l_orderkey", "y", "i", 2, 3)


@query("""WITH x AS (SELECT l_partkey AS k, l_extendedprice AS s, l_returnflag = 'R' AS y, l_orderkey * 10 + l_linenumber AS i FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, i) AS r FROM x WHERE NOT y)
SELECT x.k, x.i AS positive, x.s AS positive_score, n.i AS negative, n.s AS negative_score FROM x JOIN n ON x.k = n.k AND n.r <= 4 WHERE x.y""")
def hard_negative_pairs(spark, d):
    x = read(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_extendedprice").alias("s"), (F.col("l_returnflag") == "R").alias("y"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("i"))
    return splitting.hard_negatives(x, ["k"], "s", "y", "i")


@query("SELECT c_mktsegment, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 8")
def examples_per_category(spark, d):
    c = read(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    return splitting.top_per(c, ["c_mktsegment"], [F.desc("c_acctbal"), F.col("c_custkey")], 8)


@query("""SELECT row_id, regexp_extract(row_id, '^(.*)_[0-9]+$', 1) AS document, try_cast(nullif(regexp_extract(row_id, '_([0-9]+)$', 1), '') AS INT) AS slot, coalesce(regexp_matches(row_id, '^.+_[0-9]{2,}$') AND try_cast(nullif(regexp_extract(row_id, '_([0-9]+)$', 1), '') AS INT) >= 1 AND (length(regexp_extract(row_id, '_([0-9]+)$', 1)) = 2 OR NOT starts_with(regexp_extract(row_id, '_([0-9]+)$', 1), '0')), false) AS valid
FROM (SELECT CASE o_orderkey % 6 WHEN 0 THEN o_orderkey || '_' || (o_custkey % 30) WHEN 1 THEN o_orderkey || '_a' || o_custkey WHEN 2 THEN '_' || lpad((o_custkey % 130)::VARCHAR, 3, '0') ELSE o_orderkey || '_' || lpad((o_custkey % 130)::VARCHAR, greatest(2, length((o_custkey % 130)::VARCHAR))::INT, '0') END AS row_id FROM orders)""")
def slot_id_parse(spark, d):
    n, key = (F.col("o_custkey") % 130).cast("string"), F.concat(F.col("o_orderkey").cast("string"), F.lit("_"))
    kind = F.col("o_orderkey") % 6
    odd = F.when(kind == 0, F.concat(key, (F.col("o_custkey") % 30).cast("string"))).when(kind == 1, F.concat(key, F.lit("a"), F.col("o_custkey").cast("string"))).when(kind == 2, F.concat(F.lit("_"), F.lpad(n, 3, "0")))
    return evaluation.slot_ids(read(spark, d, "orders").select(odd.otherwise(F.concat(key, F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n))).alias("row_id")))


BANDED = "SELECT n_chars AS n, doc_id % 10 / 10.0 AS s, doc_id % 13 - 3.0 AS m, len(string_split(text, chr(10))) AS c FROM documents"


@query(f"""SELECT count_band, audit_band, length_band, margin_band, similarity_band, count(*) AS n FROM (SELECT CASE WHEN c <= 10 THEN '1-10' WHEN c <= 15 THEN '11-15' ELSE '16+' END AS count_band, CASE WHEN c <= 10 THEN '0-10' WHEN c <= 15 THEN '11-15' ELSE '16+' END AS audit_band,
  CASE WHEN n <= 128 THEN '<=128' WHEN n <= 256 THEN '129-256' ELSE '>256' END AS length_band, CASE WHEN m < 0 THEN '<0' WHEN m < 2 THEN '0-2' WHEN m < 5 THEN '2-5' ELSE '>=5' END AS margin_band, CASE WHEN s < 0.5 THEN '0-0.5' WHEN s < 0.8 THEN '0.5-0.8' WHEN s < 0.9 THEN '0.8-0.9' ELSE '0.9-1.0' END AS similarity_band FROM ({BANDED})) GROUP BY ALL""")
def band_counts(spark, d):
    lines, n = F.size(F.split("text", "\n", -1)), F.col("n_chars")
    bands = {"count_band": text.band(lines, *text.COUNT_BANDS), "audit_band": text.band(lines, *text.AUDIT_BANDS), "length_band": text.band(n, *text.LENGTH_BANDS), "margin_band": text.band_below(F.col("doc_id") % 13 - F.lit(3.0), *text.MARGIN_BANDS), "similarity_band": text.band_below(F.col("doc_id") % 10 / F.lit(10.0), *text.SIMILARITY_BANDS)}
    return read(spark, d, "documents").select(*[c.alias(k) for k, c in bands.items()]).groupBy(*bands).agg(F.count("*").alias("n"))


@query("SELECT doc_id, paragraph, count(*) AS lines FROM (SELECT doc_id, segment_index, sum(CASE WHEN nb AND prev < segment_index - 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY segment_index)::BIGINT AS paragraph FROM (SELECT *, max(CASE WHEN nb THEN segment_index END) OVER (PARTITION BY doc_id ORDER BY segment_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM (SELECT *, regexp_matches(text, '\\S') AS nb FROM (SELECT doc_id, unnest(ls) AS text, (generate_subscripts(ls, 1) - 1)::INT AS segment_index FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))))) GROUP BY 1, 2")
def paragraph_numbering(spark, d):
    from quillspan.operators.features import paragraphs

    return paragraphs(segments(spark, d)).groupBy("doc_id", "paragraph").agg(F.count("*").alias("lines"))


@query("SELECT doc_id, strlen(text)::BIGINT AS bytes, length(text)::BIGINT AS chars, trim(lower(left(text, 40))) AS head FROM documents")
def derived_text_columns(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", F.octet_length(t).cast("long").alias("bytes"), F.length(t).cast("long").alias("chars"), F.trim(F.lower(F.left(t, F.lit(40)))).alias("head"))


#: How a JSON text of the events is changed, as an expression of it, with the fault it has then and its number of objects.
JSON_VARIANTS = {
    "as written": ("props", "", 1), "array": ("'[' || props || ', ' || props || ']'", "", 2), "trailing data": ("props || ' {}'", "data after the value", 1),
    "repeated key": ("left(props, length(props) - 1) || ', \"k\": 0}'", "a key is repeated", 1), "cut": ("left(props, length(props) - 1)", "the text ends early", 1),
    "nested only": ("'{\"other\": ' || props || '}'", "a field is missing", 1), "skipped values": ("'{\"a\": [{\"k\": \"}\"}], \"k\"' || substr(props, instr(props, ':'))", "", 1),
    "no object": ("'[' || props || ', 1]'", "an item is not an object", 1), "unmatched": ("'[' || props || '}'", "a delimiter does not match", 1),
}


@query("SELECT variant, fault, (count(*) * items)::BIGINT AS n, CASE WHEN fault = '' THEN (sum(regexp_extract(props, '\"k\": *(\\d+)', 1)::BIGINT) * items)::BIGINT END AS total FROM events, (VALUES " + ", ".join(f"('{v}', '{fault}', {items})" for v, (_, fault, items) in JSON_VARIANTS.items()) + ") v(variant, fault, items) GROUP BY variant, fault, items")
def json_projection(spark, d):
    """One field of the events' JSON by the strict reader, as written and with each fault it must refuse."""
    each = F.explode(F.create_map(*[x for v, (sql, _, _) in JSON_VARIANTS.items() for x in (F.lit(v), F.expr(sql))])).alias("variant", "json")
    found = tabular.project_json(read(spark, d, "events").select(each), "json", ("k",), ("variant",))
    return found.groupBy("variant", F.coalesce("fault", F.lit("")).alias("fault")).agg(F.count("*").alias("n"), F.sum(F.col("k").cast("long")).alias("total"))
