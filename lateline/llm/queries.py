"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from lateline.llm import (
    centroids, decontamination, exact_dedup, filter_audit, html_text, mixing, pii, simhash,
    substring_dedup, token_counts, token_files, toxicity, url_filter,
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


#: Where the public vocabularies lie; a parameter of the deployment.
TOKENIZERS = os.environ.get("TOKENIZERS", "/opt/tokenizers")


def query(name: str, tables: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = lambda spark, sf_dir: build(
            *(spark.read.parquet(f"{sf_dir}/{table}.parquet") for table in tables.split()))
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


@query("op1_token_counts", "documents")
def op1(documents: DataFrame) -> DataFrame:
    vocabulary = token_counts.load_vocabulary(f"{TOKENIZERS}/piece_bpe_32k.model")
    return token_counts.token_counts(documents, vocabulary)


@query("op2_decontamination", "documents benchmark")
def op2(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return decontamination.find_leaks(documents, benchmark)


@query("op3_substring_dedup", "documents")
def op3(documents: DataFrame) -> DataFrame:
    return substring_dedup.dedup_substrings(documents).drop("kept_text")


@query("op5_html_text", "pages")
def op5(pages: DataFrame) -> DataFrame:
    return html_text.visible_text(pages)


@query("op6_toxicity", "documents labels")
def op6(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return toxicity.toxicity(documents, labels)


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS n FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]
  AS DOUBLE) AS weight, 3 * n AS cap FROM s),
l AS (SELECT *, cap / weight AS ratio,
  (sum(n) OVER () - coalesce(sum(cap) OVER before, 0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM w WINDOW before AS (ORDER BY cap / weight, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, n, CASE WHEN ratio <= shared THEN cap
  ELSE least(cap, coalesce(shared, ratio) * weight) END AS target
  FROM (SELECT *, max(CASE WHEN level * weight <= cap THEN level END) OVER () AS shared FROM l)),
f AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS whole FROM t),
r AS (SELECT d.doc_id, d.size, f.n, f.target, f.whole, f.target - f.whole * f.n AS rest,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, d.size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size / 2 AS middle
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(n AS BIGINT) AS source_size, target,
  CAST(size * (whole + CASE WHEN rest > 0 AND middle < rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r"""


@query("op4_mix_sources", "documents", MIX_SQL)
def op4(documents: DataFrame) -> DataFrame:
    mixed = mixing.mix_sources(documents)
    return mixed.select("doc_id", "size", "source_size", "target",
                        (F.col("size") * F.col("copies")).alias("taken"))


@query("op7_url_filter", "pages", r"""
WITH p AS (SELECT page_id,
  translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT DISTINCT host, path FROM p),
b AS (SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, rules.p)
  GROUP BY host, path),
m AS (SELECT host, path, min(x) AS phrase FROM u JOIN (VALUES
  ('cheap-pills', 'cheap-pills'), ('spam-farm', 'spam-farm'), ('online-casino', 'online-casino'),
  ('free-*-download', 'free-.*-download')) AS t(x, r)
  ON regexp_matches(host || chr(10) || path, '(^|[^A-Za-z0-9])' || r || '([^A-Za-z0-9]|$)')
  GROUP BY host, path)
SELECT page_id, p.host, p.path, rule,
  coalesce(v, CASE WHEN phrase IS NULL THEN 'allow' ELSE 'block' END) AS verdict, phrase
FROM p LEFT JOIN b ON p.host = b.host AND p.path = b.path
  LEFT JOIN m ON p.host = m.host AND p.path = m.path""")
def op7(pages: DataFrame) -> DataFrame:
    return url_filter.filter_urls(pages)


@query("op8_exact_dedup", "documents", r"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op8(documents: DataFrame) -> DataFrame:
    found = exact_dedup.exact_dedup(documents)
    return found.select("doc_id", "keep_id", "group_size", "kept",
                        F.lower(F.hex("digest")).alias("text_sha256"))


@query("op9_pii", "documents")
def op9(documents: DataFrame) -> DataFrame:
    found = pii.find_pii(documents)
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{kind}")
                                    for k, kind in enumerate(pii.BASE_KINDS)],
                        F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"),
                        pii.spans_text(F.col("spans")).alias("spans"))


@query("op10_simhash", "documents")
def op10(documents: DataFrame) -> DataFrame:
    return simhash.near_dedup(documents)


def _cluster_sql(rounds: int) -> str:
    nearest = """(SELECT rid, vec_id, p, min(CAST(list_inner_product(p, p)
  - 2 * list_inner_product(p, q) + list_inner_product(q, q) AS BIGINT) * 16 + c) AS m
  FROM v, c{k} GROUP BY rid, vec_id, p)"""
    ctes = ["""v AS (SELECT row_number() OVER () AS rid, vec_id,
  [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS p FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64)""",
            """c0 AS (SELECT row_number() OVER (ORDER BY h, p) - 1 AS c, p AS q FROM
  (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, p FROM v ORDER BY h, p LIMIT 16))"""]
    for k in range(rounds):
        ctes += [f"a{k} AS {nearest.format(k=k)}",
                 f"""c{k + 1} AS (SELECT c{k}.c, coalesce(n.q, c{k}.q) AS q FROM c{k} LEFT JOIN
  (SELECT c, list(x ORDER BY i) AS q FROM (SELECT m % 16 AS c, i, floor(sum(p[i]) / count(*)) AS x
    FROM a{k}, range(1, 65) AS r(i) GROUP BY m % 16, i) GROUP BY c) n ON n.c = c{k}.c)"""]
    return f"""WITH {", ".join(ctes)}, f AS {nearest.format(k=rounds)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, m // 16 AS distance,
  CAST(sum(m // 16) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(m // 16) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string([CAST(x AS BIGINT) FOR x IN q], ',')) AS centroid_sha256
FROM f JOIN c{rounds} ON c = m % 16"""


@query("op11_centroids", "embeddings", _cluster_sql(3))
def op11(embeddings: DataFrame) -> DataFrame:
    return centroids.cluster(embeddings, k=16, rounds=3).drop("centroid")


@query("op12_token_files", "documents")
def op12(documents: DataFrame) -> DataFrame:
    definition = token_files.load_tokenizer(f"{TOKENIZERS}/byte_bpe_50k.json")
    return token_files.round_trip(documents, definition, end_id=2)


@query("op13_filter_audit", "documents labels", r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
  max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
rows AS (SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
  + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS fails FROM d),
p AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS n_good,
  sum(coalesce(toxic, 0)) AS n_toxic
  FROM rows LEFT JOIN marks ON rows.doc_id = marks.doc_id GROUP BY part, fails),
f(x, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.b | b.b | c.b | d.b | e.b = 31),
s AS (SELECT filter_order, k AS step, substr(filter_order, k, 1) AS filter, bits[k] AS own,
  coalesce(list_sum(bits[1:k - 1]), 0)::INTEGER AS before FROM o, range(1, 6) AS r(k)),
c AS (SELECT part, filter_order, step, filter,
  sum(CASE WHEN fails & (own | before) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN fails & own <> 0 AND fails & before = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN fails & own <> 0 AND fails & before <> 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN fails & own <> 0 AND fails & before = 0 THEN n_good ELSE 0 END) AS good_lost,
  sum(CASE WHEN fails & own <> 0 AND fails & before = 0 THEN n_toxic ELSE 0 END) AS toxic_lost
  FROM p, s GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter, CAST(kept AS BIGINT) AS kept,
  CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM c""")
def op13(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return filter_audit.audit(documents, labels)
