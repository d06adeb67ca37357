"""The registered queries of this package, and SQL for those that SQL can express."""

import public_tokenizers
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, contamination, credentials, divergence, importance, langid, passages, ppm, ring, runs, simhash, winnow
from tidemark.llm.common import table


def op1_simhash_bktree(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_bounded_ring(spark, sf_dir):
    """The law is "rows": with load factor 1, counts are at most one apart."""
    found = ring.shard(table(spark, sf_dir, "documents"), n_shards=8, load_factor=1.0)
    return found.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def op3_shared_passages(spark, sf_dir):
    """One row for each passage, and for each of its repeated stretches that has one."""
    found = passages.shared_passages(table(spark, sf_dir, "documents"))
    span = F.explode_outer("repeated")
    return found.select("doc_id", "start", "end", "n_words", span.alias("cut")).select("doc_id", "start", "end", "n_words", F.col("cut.start").alias("cut_start"), F.col("cut.end").alias("cut_end"))


def op4_preference_pairs(spark, sf_dir):
    """Masks as text, "start-end" by commas, so that SQL can give the same."""
    found = chat.preference_pairs(*chat.paired_by_answer(table(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias(c)
    return found.select(F.col("id").alias("conv_id"), "n_common", "prompt", "chosen", "rejected", spans("chosen_mask"), spans("rejected_mask"))


OP4_SQL = """
WITH own AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT conv_id, max(k) AS k FROM own WHERE role = 'assistant' GROUP BY 1),
answer AS (SELECT o.conv_id, o.text FROM own o JOIN last l ON o.conv_id = l.conv_id AND o.k = l.k),
rejected AS (
  SELECT o.conv_id, o.k, o.role, CASE WHEN o.k = l.k THEN a.text ELSE o.text END AS text
  FROM own o JOIN last l ON o.conv_id = l.conv_id AND o.k <= l.k JOIN answer a ON a.conv_id = xor(o.conv_id, 1::BIGINT)),
differ AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, min(coalesce(c.k, r.k)) FILTER (WHERE c.k IS NULL OR r.k IS NULL OR c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text) AS k, max(coalesce(c.k, r.k)) AS n
  FROM own c FULL JOIN rejected r ON c.conv_id = r.conv_id AND c.k = r.k GROUP BY 1),
common AS (SELECT conv_id, coalesce(k - 1, n) AS n FROM differ),
lined AS (
  SELECT side, s.conv_id, s.k, s.k > c.n AS tail, s.role, '<|' || coalesce(s.role, '') || '|>' || chr(10) || coalesce(s.text, '') || '<|end|>' || chr(10) AS line
  FROM (SELECT 'c' AS side, conv_id, k, role, text FROM own UNION ALL SELECT 'r', conv_id, k, role, text FROM rejected) s JOIN common c ON s.conv_id = c.conv_id),
spanned AS (SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY side, conv_id, tail ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM lined),
done AS (
  SELECT side, conv_id, coalesce(string_agg(line, '' ORDER BY k) FILTER (WHERE NOT tail), '') AS prompt, coalesce(string_agg(line, '' ORDER BY k) FILTER (WHERE tail), '') AS rest,
    coalesce(string_agg(CAST(pos + length(role) + 5 AS BIGINT) || '-' || CAST(pos + length(line) - 1 AS BIGINT), ',' ORDER BY k) FILTER (WHERE tail AND role = 'assistant'), '') AS mask
  FROM spanned GROUP BY 1, 2)
SELECT c.conv_id, CAST(m.n AS INTEGER) AS n_common, c.prompt, c.rest AS chosen, r.rest AS rejected, c.mask AS chosen_mask, r.mask AS rejected_mask
FROM done c JOIN common m ON m.conv_id = c.conv_id LEFT JOIN done r ON r.side = 'r' AND r.conv_id = c.conv_id WHERE c.side = 'c'
"""

def op5_winnowing(spark, sf_dir):
    return winnow.edited(table(spark, sf_dir, "documents"))


def op6_bigru_language(spark, sf_dir):
    return langid.languages(table(spark, sf_dir, "documents"))


def op7_minhash_containment(spark, sf_dir):
    return contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP7_SQL = r"""
WITH w AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\v\f\r]+') AS w FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\v\f\r]+') FROM benchmark),
s AS (SELECT DISTINCT side, id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT side, id, w, unnest(range(1, len(w) - 3)) AS k FROM w)),
n AS (SELECT id, count(*) AS n FROM s WHERE side = 'i' GROUP BY 1),
m AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_found FROM s d JOIN s i ON d.s = i.s AND d.side = 'd' AND i.side = 'i' GROUP BY 1, 2)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS n_shingles, CAST(n_found AS INTEGER) AS n_found, n_found / n AS containment
FROM m JOIN n ON m.item_id = n.id WHERE n_found >= 0.8 * n
"""


def op8_importance_resampling(spark, sf_dir):
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_ppm_scores(spark, sf_dir):
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    return ppm.scored(table(spark, sf_dir, "documents"), held_out)


def op10_bpe_transducer(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep=True)


def repeating(docs):
    """docs, with the words from a on of every tenth text (by h) replaced by the p words from a on, again and again, as the query's contract has it."""
    h = F.crc32(F.col("doc_id").cast("string"))
    div = lambda x, y: F.call_function("div", x, y)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = docs.select("doc_id", "text", div(h, F.lit(10)).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    n, a, p = F.size("w"), F.pmod("g", F.size("w")).cast("int"), F.col("p").cast("int")
    rows = rows.withColumn("p", 1 + div(n - a, 3 + F.pmod("g", F.lit(8))))
    again = F.flatten(F.array_repeat(F.slice("w", a + 1, p), F.ceil((n - a) / p).cast("int")))
    edited = F.array_join(F.concat(F.slice("w", F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")
    return rows.select("doc_id", F.when(n > 0, edited).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir):
    found = runs.periodic_runs(repeating(table(spark, sf_dir, "documents")))
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    more = lambda x, r: F.when(x.isNull() | (r["length"] * x["period"] > x["length"] * r["period"]), r).otherwise(x)
    best = F.aggregate("runs", none, more).alias("best")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best, F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


def op12_source_divergence(spark, sf_dir):
    return divergence.audited(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
own AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY 1, 2, 3),
groups AS (SELECT DISTINCT lang, source FROM d),
every AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, k.n AS lang_n FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
size AS (SELECT lang, source, sum(n) + count(*) AS size, sum(lang_n) + count(*) AS lang_size FROM every GROUP BY 1, 2),
p AS (
  SELECT e.lang, e.source, e.term, e.n, 1 + CAST(CAST(1000000000 AS HUGEINT) * (e.n + 1) // CAST(s.size AS HUGEINT) AS BIGINT) AS p, 1 + CAST(CAST(1000000000 AS HUGEINT) * (e.lang_n + 1) // CAST(s.lang_size AS HUGEINT) AS BIGINT) AS q
  FROM every e JOIN size s ON s.lang = e.lang AND s.source = e.source),
far AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found) WHERE part = 'pair' OR rank <= 200
"""


def op13_secret_scan(spark, sf_dir):
    found = credentials.scanned(table(spark, sf_dir, "documents"))
    base = credentials.KINDS[:3]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(joined(of(*base)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {
    "op1_simhash_bktree": op1_simhash_bktree,
    "op2_bounded_ring": op2_bounded_ring,
    "op3_shared_passages": op3_shared_passages,
    "op4_preference_pairs": op4_preference_pairs,
    "op5_winnowing": op5_winnowing,
    "op6_bigru_language": op6_bigru_language,
    "op7_minhash_containment": op7_minhash_containment,
    "op8_importance_resampling": op8_importance_resampling,
    "op9_ppm_scores": op9_ppm_scores,
    "op10_bpe_transducer": op10_bpe_transducer,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_source_divergence": op12_source_divergence,
    "op13_secret_scan": op13_secret_scan,
}
SQL = {"op4_preference_pairs": OP4_SQL, "op7_minhash_containment": OP7_SQL, "op12_source_divergence": OP12_SQL}
