"""Registered queries of this folder, with the SQL each must match where SQL can say it.

A query takes (spark, sf_dir) and applies one operator to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm import divergence, langid, mixing, neardup, ngram_lm, packing, pivot_search, quality_model, quality_rules, records, spelling, urlfilter, warc
from alertloom.llm.wordbpe import default_path
from alertloom.session import ship_package

Run = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(parts: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts))


def op1_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_k(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS parts
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.parts, v.parts), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""


def op2_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = langid.train(docs.where(id_remainder(4) != 2))
    judged = langid.identify(docs.select("doc_id", "text"), filters)
    held_out = F.coalesce(id_remainder(4) == 2, F.lit(False))
    return judged.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


# Fixed rules of the query: verdict, host, path.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = f"""
WITH rules(verdict, host, path) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
p AS (SELECT page_id, url, row_number() OVER () AS row_no,
        CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*') ELSE '' END AS raw_host
      FROM pages),
h AS (SELECT page_id, row_no, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3 + length(raw_host)), '^[^?#]*') ELSE '' END AS path
      FROM p)
SELECT h.page_id, h.host, h.path,
  arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
  coalesce(arg_max(r.verdict, length(r.host || r.path)), 'allow') AS verdict
FROM h LEFT JOIN rules r
  ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path)
GROUP BY h.row_no, h.page_id, h.host, h.path
"""


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return uses.select("doc_id", "source", "epoch", "n_tokens", "stream_start", "block")


# The exponent is bisected as in the operator: by entropy, else by repetition.
OP4_SQL = """
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS n_tokens
  FROM documents
), sums AS (
  SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM sizes GROUP BY source HAVING sum(n_tokens) > 0
), total AS (SELECT CAST(sum(tokens) AS DOUBLE) AS t FROM sums),
shares AS (SELECT source, tokens, ln(tokens / t) AS x FROM sums, total),
goal AS (SELECT -sum(exp(x) * x) + 0.5 * greatest(0, ln(count(*)) + sum(exp(x) * x)) AS h FROM shares),
entropy(step, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN good THEN middle ELSE low END, CASE WHEN good THEN high ELSE middle END
  FROM (SELECT step, low, high, (low + high) / 2 AS middle,
          (SELECT ln(sum(exp((low + high) / 2 * x))) - (low + high) / 2 * sum(exp((low + high) / 2 * x) * x) / sum(exp((low + high) / 2 * x)) FROM shares) >= (SELECT h FROM goal) AS good
        FROM entropy WHERE step < 40)
), by_entropy AS (SELECT floor(low * 1000000) / 1000000 AS a FROM entropy WHERE step = 40),
repeats(step, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN good THEN low ELSE middle END, CASE WHEN good THEN middle ELSE high END
  FROM (SELECT step, low, high, (low + high) / 2 AS middle,
          (SELECT max(exp(((low + high) / 2 - 1) * x)) / sum(exp((low + high) / 2 * x)) FROM shares) <= 4 AS good
        FROM repeats WHERE step < 40)
), chosen AS (
  SELECT CASE WHEN (SELECT max(exp((a - 1) * x)) / sum(exp(a * x)) FROM shares) <= 4 THEN a
              ELSE (SELECT least(1.0, ceil(high * 1000000) / 1000000) FROM repeats WHERE step = 40) END AS a
  FROM by_entropy
), plan AS (
  SELECT source, tokens, CAST(floor(exp(a * x) / (SELECT sum(exp(a * x)) FROM shares) * t) AS BIGINT) AS budget
  FROM shares, chosen, total
), uses AS (
  SELECT s.doc_id, s.source, s.n_tokens, p.tokens, p.budget, CAST(e.epoch AS INTEGER) AS epoch,
    md5(concat('1:', e.epoch, ':', coalesce(CAST(s.doc_id AS VARCHAR), ''))) AS order_key
  FROM sizes s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source,
    LATERAL (SELECT unnest(range(CAST(ceil(p.budget / p.tokens) AS BIGINT))) AS epoch) e
), placed AS (
  SELECT *, CAST(epoch * tokens + coalesce(sum(n_tokens) OVER (
    PARTITION BY source, epoch ORDER BY order_key, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS stream_start
  FROM uses
)
SELECT doc_id, source, epoch, n_tokens, stream_start,
  CAST(stream_start * greatest(1, CAST(ceil((SELECT t FROM total) / 1000000) AS BIGINT)) // budget AS BIGINT) AS block
FROM placed WHERE stream_start < budget
"""


def op5_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_js", "word_js")


def op6_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(id_remainder(5) != 0)
    scored = quality_model.score_quality(docs, quality_model.train(docs, labels))
    held_out = F.coalesce(id_remainder(5) == 0, F.lit(False))
    score = F.col("quality_score")
    return scored.select("doc_id", held_out.alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


def op7_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_records(table(spark, sf_dir, "documents"), default_path())


def op9_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)


def op10_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"), default_path())


def op11_frequency_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


# CRC-32 by its byte table; words with a letter left open or left out meet their near words.
OP11_SQL = r"""
WITH RECURSIVE digits(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM digits WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS t FROM digits WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run
), coded AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM counted, crc_table
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM coded
  ) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), gaps AS (
  SELECT word, n, substr(word, 1, i) || '_' || substr(word, i + 2) AS hole, substr(word, 1, i) || substr(word, i + 2) AS less FROM words, range(length(word)) r(i)
), near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT DISTINCT a.word, b.word, b.n FROM gaps a JOIN words b ON a.less = b.word
  UNION SELECT DISTINCT b.word, a.word, a.n FROM gaps a JOIN words b ON a.less = b.word
), ranked AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS best, max(other_n) AS best_n FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * w.n THEN best END AS form, CASE WHEN best_n >= 5 * w.n THEN best_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word
), chains(word, here, steps) AS (
  SELECT word, word, 0 FROM formed
  UNION ALL SELECT c.word, f.form, c.steps + 1 FROM chains c JOIN formed f ON f.word = c.here WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, (SELECT arg_max(here, steps) FROM chains c WHERE c.word = f.word) AS root, f.n, f.n_near, f.form_n FROM formed f
"""


def op12_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ngram_lm.score_texts(table(spark, sf_dir, "documents"), id_remainder(10) != 0)
    held_out = F.coalesce(id_remainder(10) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), found AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term FROM found GROUP BY lang, term HAVING count(DISTINCT id) >= 3
), used AS (
  SELECT lang, source, term, count(*) AS n FROM found SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), spoken AS (
  SELECT lang, term, sum(n)::BIGINT AS n FROM used GROUP BY lang, term
), sizes AS (SELECT lang, count(*) AS terms FROM kept GROUP BY lang),
named AS (SELECT DISTINCT lang, source FROM d),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(u.n, 0) + 1)) // (sum(coalesce(u.n, 0)) OVER (PARTITION BY g.lang, g.source) + s.terms)::HUGEINT AS p
  FROM named g JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term
), overall AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + terms)::HUGEINT AS q FROM spoken JOIN sizes USING (lang)
), valued AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v.value, 0)::BIGINT AS value
  FROM named a JOIN named b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
  UNION ALL
  SELECT s.lang, s.source, 'term', s.term, (((p - q) * (p - q)) // q)::BIGINT FROM shares s JOIN overall o ON o.lang = s.lang AND o.term = s.term WHERE s.n > 0 AND p > q
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM valued
)
SELECT lang, source, part, item, value, rank FROM placed WHERE part = 'pair' OR rank <= 200
"""


def all_queries() -> dict[str, tuple[Run, str | None]]:
    return {
        "op1_pivot_search": (op1_pivot_search, OP1_SQL),
        "op2_language_filters": (op2_language_filters, None),
        "op3_url_filter": (op3_url_filter, OP3_SQL),
        "op4_temperature_mixing": (op4_temperature_mixing, OP4_SQL),
        "op5_divergence_rules": (op5_divergence_rules, None),
        "op6_rule_ensemble": (op6_rule_ensemble, None),
        "op7_warc_packages": (op7_warc_packages, None),
        "op8_token_records": (op8_token_records, None),
        "op9_lsh_forest": (op9_lsh_forest, None),
        "op10_vector_packing": (op10_vector_packing, None),
        "op11_frequency_trie": (op11_frequency_trie, OP11_SQL),
        "op12_backoff_automaton": (op12_backoff_automaton, None),
        "op13_source_divergence": (op13_source_divergence, OP13_SQL),
    }
