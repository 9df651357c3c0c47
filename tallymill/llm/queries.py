"""Registered queries of the numbered operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, lexical, mixing, nbsvm, onebit, recompress, sharding, simhash, template, urlfilter, vafile, warc
from .common import table

VOCABULARY = "byte_bpe_50k.tiktoken"
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: The block list's rule: its hosts, their sections, and the number below which pages are listed. It knows nothing of the table that is judged.
BLOCK_HOSTS = tuple(f"{name}.example.{end}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for end in ("com", "net", "org"))
BLOCK_SECTIONS, BLOCK_NUMBERS = ("de", "en", "es", "fr"), 10_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    judged = urlfilter.judge(pages, RULES, urlfilter.url_list(spark, BLOCK_HOSTS, BLOCK_SECTIONS, BLOCK_NUMBERS))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


def op5_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.summaries(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op7_nb_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = nbsvm.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return nbsvm.score(docs, model).select(
        "doc_id", nbsvm.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= nbsvm.THRESHOLD).cast("int").alias("predicted")
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary_path())


def op9_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onebit.nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = lexical.index(table(spark, sf_dir, "documents", "doc_id", "text"))
    return lexical.search(lists, table(spark, sf_dir, "benchmark", "item_id", "text"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc, op2_va_file, op3_url_filter, op4_mixing, op5_recompression, op6_templates, op7_nb_svm, op8_byte_bpe, op9_one_bit_codes, op10_simhash,
        op11_jump_hash, op12_hybrid_search, op13_filter_audit,
    )
}

_HOST_PATH = """
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages) AS u
"""
ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN p.page_id > f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id > f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest""",
    "op2_va_file": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
      FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op3_url_filter": f"""
WITH u AS ({_HOST_PATH}),
k AS (SELECT *, concat(regexp_replace(host, '^(www|m)\\.', ''), regexp_replace(path, '/+$', '')) AS url_key FROM u),
listed AS (SELECT h || '/' || s || '/' || n || CASE WHEN n % 4 = 2 THEN '.html' ELSE '' END AS url_key
  FROM (SELECT unnest({list(BLOCK_HOSTS)}) AS h), (SELECT unnest({list(BLOCK_SECTIONS)}) AS s), range(0, {BLOCK_NUMBERS}, 2) AS r(n)),
ruled AS (SELECT k.*, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM k)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN listed.url_key IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN listed ON ruled.url_key = listed.url_key""",
    "op11_jump_hash": """
WITH RECURSIVE bits AS (SELECT unnest(range(256))::BIGINT AS i, 0 AS k, unnest(range(256))::BIGINT AS c
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
steps AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT r, doc_id, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS size,
  xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT)),
    lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS INTEGER) + 1]), 4294967295), 4294967295) AS text_crc32,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS UBIGINT) AS seed FROM d, steps),
walk AS (SELECT r, CAST(seed AS HUGEINT) AS state, CAST(-1 AS BIGINT) AS spot, CAST(0 AS BIGINT) AS next FROM f
  UNION ALL SELECT r, s, next, CAST(floor((next + 1) * (2147483648.0::DOUBLE / ((s // 8589934592) + 1))) AS BIGINT)
  FROM (SELECT r, next, (state * 2862933555777941757 + 1) % 18446744073709551616 AS s FROM walk WHERE next < 17)),
j AS (SELECT r, CAST(max(spot) FILTER (spot < 16) AS INTEGER) AS shard, CAST(max(spot) AS INTEGER) AS grown_shard FROM walk GROUP BY r)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS LAST, text_crc32, size) - 1 AS slot, grown_shard FROM f JOIN j USING (r)""",
    "op12_hybrid_search": """
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
g AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM n),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term, nn),
q AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
m AS (SELECT doc_id, 75 + (25 * n * nn) // ll AS m FROM n, g),
s AS (SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 20""",
    "op13_filter_audit": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic,
  (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END)
  || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
  || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x AS a, x AS b, x AS c, x AS d, x AS e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(k AS INTEGER) AS step, substr(filter_order, k, 1) AS y, left(filter_order, k - 1) AS b FROM o, range(1, 6) AS r(k)),
r AS (SELECT *, strpos(fails, y) > 0 AS hit, b <> '' AND fails <> '' AND len(list_intersect(string_split(b, ''), string_split(fails, ''))) > 0 AS gone FROM c, s),
a AS (SELECT part, filter_order, step, y, coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND hit), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (gone AND hit), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = y), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (NOT gone AND hit), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND hit), 0)::BIGINT AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, y)::BIGINT AS shapley FROM a""",
}
