"""Queries of name mapping and planning, each with its SQL.

The catalog lists each brand's part names as columns; the log uses them in five spellings: as they are, in capitals with
blanks, by a glossary term, with a missing or changed end, and as names that say nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import names as N
from .operators import mapping as M
from .operators import planning as P
from .operators import scoring as S
from .register import query, read
from .registry import COUNTS, EDGES, part_waves, statement_table_counts, supplier_edges


def part_column():
    return F.expr("replace(p_name, ' ', '_')")


def part_catalog(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_brand").alias("table_key"), part_column().alias("col")).distinct()


def part_glossary(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.concat(F.lit("old_"), part_column()).alias("term"), part_column().alias("target")).distinct()


def part_domains(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("p_brand").endswith("1"), "Technical Debt").when(F.col("p_brand") < "Brand#2", "Sales").otherwise("Operations")
    return read(spark, sf_dir, "part").select(F.col("p_brand").alias("table_key"), kind.alias("domain")).distinct()


def part_usage(spark, sf_dir) -> DataFrame:
    k, n, line = F.col("l_orderkey"), part_column(), F.col("l_linenumber")
    spelling = F.when(k % 7 == 0, F.concat(F.lit("flag_"), line)).when(k % 5 == 2, F.upper("p_name")).when(k % 5 == 3, F.concat(F.lit("old_"), n))
    spelling = spelling.when((k % 5 == 4) & (line % 2 == 0), F.concat(F.substring(n, 1, 4), F.lit("_zz"))).when(k % 5 == 4, F.expr("substring(replace(p_name, ' ', '_'), 2)")).otherwise(n)
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    uses = [F.count_if(F.col("l_returnflag") == flag).alias(c) for flag, c in zip("NRA", M.USES)]
    return rows.groupBy(F.col("p_brand").alias("table_key"), spelling.alias("name")).agg(*uses)


def part_mapping(spark, sf_dir) -> DataFrame:
    """The mapping by edit distance, which both engines have."""
    return M.resolve_names(part_usage(spark, sf_dir), part_catalog(spark, sf_dir), part_glossary(spark, sf_dir), M.scored(N.edit_ratio))


def part_importance(spark, sf_dir) -> DataFrame:
    uses = F.sum("l_quantity").cast("long")
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    per = rows.groupBy(F.col("p_brand").alias("table_key"), part_column().alias("col")).agg(uses.alias("n"))
    return per.select("table_key", "col", F.round(F.col("n") / (F.col("n") + 1000.0), 4).alias("score"), (F.col("n") < 100).alias("dead"))


def part_volume(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("p_brand").alias("table_key")).agg(F.count_distinct("l_orderkey").alias("query_count"))


CATALOG = "cat AS (SELECT DISTINCT p_brand AS table_key, replace(p_name, ' ', '_') AS col FROM part), glo AS (SELECT DISTINCT concat('old_', replace(p_name, ' ', '_')) AS term, replace(p_name, ' ', '_') AS target FROM part), dom AS (SELECT DISTINCT p_brand AS table_key, CASE WHEN p_brand LIKE '%1' THEN 'Technical Debt' WHEN p_brand < 'Brand#2' THEN 'Sales' ELSE 'Operations' END AS domain FROM part)"
USAGE = """lp AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, p_brand AS table_key, p_name, replace(p_name, ' ', '_') AS col FROM lineitem JOIN part ON l_partkey = p_partkey),
u AS (SELECT table_key, CASE WHEN l_orderkey % 7 = 0 THEN concat('flag_', l_linenumber) WHEN l_orderkey % 5 = 2 THEN upper(p_name) WHEN l_orderkey % 5 = 3 THEN concat('old_', col)
  WHEN l_orderkey % 5 = 4 AND l_linenumber % 2 = 0 THEN concat(substring(col, 1, 4), '_zz') WHEN l_orderkey % 5 = 4 THEN substring(col, 2) ELSE col END AS name,
  count(*) FILTER (WHERE l_returnflag = 'N') AS n_select, count(*) FILTER (WHERE l_returnflag = 'R') AS n_where, count(*) FILTER (WHERE l_returnflag = 'A') AS n_join FROM lp GROUP BY 1, 2)"""
MAPPING = f"""{CATALOG}, {USAGE},
k AS (SELECT table_key, name, lower(replace(trim(name), ' ', '_')) AS key FROM u),
g AS (SELECT k.table_key, k.name, glo.target FROM k JOIN glo ON glo.term = k.key JOIN cat ON cat.table_key = k.table_key AND cat.col = glo.target),
x AS (SELECT k.table_key, k.name, cat.col AS target FROM k JOIN cat ON cat.table_key = k.table_key AND cat.col = k.key),
p AS (SELECT k.table_key, k.name, cat.col AS target, 1.0 - levenshtein(k.key, cat.col) / greatest(length(k.key), length(cat.col)) AS score FROM k JOIN cat ON cat.table_key = k.table_key),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_key, name ORDER BY score DESC, target) AS rn FROM p) q WHERE rn = 1),
c AS (SELECT k.table_key, k.name, coalesce(g.target, x.target, b.target) AS target, g.target IS NOT NULL OR x.target IS NOT NULL AS sure,
  round(CASE WHEN g.target IS NOT NULL THEN 0.95 WHEN x.target IS NOT NULL THEN 0.98 ELSE b.score * CASE WHEN regexp_matches(k.name, '^flag_\\d+$') THEN 0.35 ELSE 1.0 END END, 6) AS confidence,
  CASE WHEN g.target IS NOT NULL THEN 'glossary' WHEN x.target IS NOT NULL THEN 'exact' ELSE 'blended' END AS strategy
  FROM k LEFT JOIN g ON g.table_key = k.table_key AND g.name = k.name LEFT JOIN x ON x.table_key = k.table_key AND x.name = k.name LEFT JOIN b ON b.table_key = k.table_key AND b.name = k.name),
m AS (SELECT u.table_key, u.name, n_select, n_where, n_join, target, confidence, strategy, confidence < 0.8 AS needs_review, CASE WHEN sure OR confidence >= 0.8 THEN 'merged' WHEN confidence < 0.4 THEN 'trash' ELSE 'review' END AS bucket FROM u JOIN c ON c.table_key = u.table_key AND c.name = u.name)"""
MERGED = MAPPING + """, mg AS (SELECT table_key, target, CAST(sum(n_select) AS BIGINT) AS n_select, CAST(sum(n_where) AS BIGINT) AS n_where, CAST(sum(n_join) AS BIGINT) AS n_join, max(confidence) AS confidence, bool_or(needs_review) AS needs_review,
  string_agg(DISTINCT name, ', ' ORDER BY name) AS sources, string_agg(DISTINCT strategy, ', ' ORDER BY strategy) AS strategies FROM m WHERE bucket = 'merged' GROUP BY 1, 2)"""
IMPORTANCE = "i AS (SELECT table_key, col, round(n / (n + 1000.0), 4) AS score, n < 100 AS dead FROM (SELECT table_key, col, CAST(sum(l_quantity) AS BIGINT) AS n FROM lp GROUP BY 1, 2) z)"
VOLUME = "v AS (SELECT table_key, count(DISTINCT l_orderkey) AS query_count FROM lp GROUP BY 1)"
HUMAN = "array_to_string(list_transform(string_split(target, '_'), lambda w: concat(upper(w[1]), lower(w[2:]))), ' ')"
CARDS = MERGED + f""", cards AS (SELECT kind, {HUMAN} AS term, legacy, target, confidence, domain, table_key FROM (
  SELECT 'confirmed' AS kind, sources AS legacy, target, confidence, dom.domain, mg.table_key FROM mg JOIN dom ON dom.table_key = mg.table_key
  UNION ALL SELECT 'review', name, target, confidence, dom.domain, m.table_key FROM m JOIN dom ON dom.table_key = m.table_key WHERE bucket = 'review'
  UNION ALL SELECT 'glossary_source', term, target, 1.0, 'Glossary inventory', '' FROM glo) y)"""


@query(f"WITH {MAPPING} SELECT * FROM m")
def name_mapping(spark, sf_dir):
    return part_mapping(spark, sf_dir)


@query()
def nearest_names(spark, sf_dir):
    """The eight columns nearest to the name of each part type, by hashed vectors, which SQL lacks; tested against plain Python."""
    names = read(spark, sf_dir, "part").select(F.col("p_brand").alias("table_key"), F.col("p_type").alias("name")).distinct()
    return M.nearest_names(names, part_catalog(spark, sf_dir))


@query()
def name_mapping_blended(spark, sf_dir):
    """The mapping by hashed vectors and matching blocks, which SQL lacks; tested against plain Python."""
    return M.resolve_names(part_usage(spark, sf_dir), part_catalog(spark, sf_dir), part_glossary(spark, sf_dir))


@query(f"WITH {MERGED} SELECT * FROM mg")
def merged_mappings(spark, sf_dir):
    return M.merged(part_mapping(spark, sf_dir))


@query(f"WITH {MERGED}, {IMPORTANCE}, {VOLUME} SELECT concat(mg.table_key, ' :: ', mg.target) AS label, mg.table_key, mg.target, mg.confidence, coalesce(i.score, 0.0) AS importance, coalesce(v.query_count, 0) AS query_volume FROM mg LEFT JOIN i ON i.table_key = mg.table_key AND i.col = mg.target LEFT JOIN v ON v.table_key = mg.table_key")
def impact_readiness(spark, sf_dir):
    return M.impact_rows(M.merged(part_mapping(spark, sf_dir)), part_importance(spark, sf_dir), part_volume(spark, sf_dir))


@query(f"WITH {MERGED}, {IMPORTANCE}, a AS (SELECT 'Confirmed' AS section, table_key, target, sources AS legacy, confidence, strategies AS strategy FROM mg UNION ALL SELECT 'Review', table_key, target, name, confidence, strategy FROM m WHERE bucket = 'review') SELECT section, a.table_key, target, legacy, confidence, coalesce(i.score, 0.0) AS importance, strategy FROM a LEFT JOIN i ON i.table_key = a.table_key AND i.col = a.target")
def migration_map(spark, sf_dir):
    return M.sort_map(M.migration_map(part_mapping(spark, sf_dir), part_importance(spark, sf_dir)))


def part_cards(spark, sf_dir) -> DataFrame:
    return M.term_cards(part_mapping(spark, sf_dir), part_glossary(spark, sf_dir), part_domains(spark, sf_dir))


@query(f"WITH {CARDS} SELECT * FROM cards")
def term_cards(spark, sf_dir):
    return part_cards(spark, sf_dir)


GROUPED = CARDS + ", gc AS (SELECT kind, lower(target) AS target, legacy, term, count(DISTINCT nullif(table_key, '')) AS n_tables, coalesce(string_agg(DISTINCT nullif(table_key, ''), ', ' ORDER BY nullif(table_key, '')), '') AS tables, string_agg(DISTINCT domain, ', ' ORDER BY domain) AS domain, max(confidence) AS confidence, count(*) AS cards FROM cards GROUP BY 1, 2, 3, 4)"


@query(f"WITH {GROUPED} SELECT kind, target, legacy, term, tables, domain, confidence, cards FROM gc")
def grouped_cards(spark, sf_dir):
    g = M.grouped_cards(part_cards(spark, sf_dir))
    return g.select("kind", "target", "legacy", "term", F.array_join("tables", ", ").alias("tables"), F.array_join("domains", ", ").alias("domain"), "confidence", "cards")


@query(f"WITH {GROUPED} SELECT term, domain, target, legacy, CAST(n_tables AS INTEGER) AS n_tables, tables, CASE WHEN n_tables = 1 THEN tables WHEN n_tables > 1 THEN '(multiple)' ELSE '-' END AS \"primary\", round(confidence, 4) AS confidence, CASE kind WHEN 'confirmed' THEN 'Confirmed' WHEN 'review' THEN 'Needs review' ELSE 'Glossary file' END AS status FROM gc")
def mapping_index(spark, sf_dir):
    return M.mapping_index(M.grouped_cards(part_cards(spark, sf_dir)))


BUCKETS = "count(*) FILTER (WHERE bucket = 'merged') AS n_merged, count(*) FILTER (WHERE bucket = 'review') AS n_review, count(*) FILTER (WHERE bucket = 'trash') AS n_trash, round(100.0 * count(*) FILTER (WHERE bucket = 'merged') / count(*), 2) AS pct_confirmed"


@query(f"WITH {MAPPING} SELECT table_key, {BUCKETS} FROM m GROUP BY table_key")
def bucket_counts(spark, sf_dir):
    return M.bucket_counts(part_mapping(spark, sf_dir), "table_key")


@query(f"WITH {MAPPING}, {IMPORTANCE}, n AS (SELECT domain, {BUCKETS} FROM m JOIN dom ON dom.table_key = m.table_key GROUP BY domain), a AS (SELECT domain, round(avg(score), 4) AS avg_importance FROM i JOIN dom ON dom.table_key = i.table_key GROUP BY domain) SELECT n.*, a.avg_importance, CASE WHEN n.domain = 'Technical Debt' THEN 'High' WHEN pct_confirmed >= 70 THEN 'Low' WHEN pct_confirmed >= 40 THEN 'Medium' ELSE 'High' END AS risk FROM n JOIN a ON a.domain = n.domain")
def domain_risk(spark, sf_dir):
    return M.domain_risk(part_mapping(spark, sf_dir), part_importance(spark, sf_dir), part_domains(spark, sf_dir))


@query(f"""WITH {MAPPING}, {IMPORTANCE}, n AS (SELECT {BUCKETS} FROM m), t AS (SELECT count(*) AS columns, count(*) FILTER (WHERE dead) AS dead, round(sum(score), 4) AS total FROM i)
SELECT metric, CAST(value AS DOUBLE) AS value FROM (SELECT 'columns' AS metric, columns AS value FROM t UNION ALL SELECT 'confirmed', n_merged FROM n UNION ALL SELECT 'pct_confirmed', round(100.0 * n_merged / columns, 2) FROM n, t UNION ALL SELECT 'review', n_review FROM n UNION ALL SELECT 'trash', n_trash FROM n
UNION ALL SELECT 'dead', dead FROM t UNION ALL SELECT 'pct_dead', round(100.0 * dead / columns, 2) FROM t UNION ALL SELECT 'total_importance', total FROM t) q""")
def executive_metrics(spark, sf_dir):
    return M.executive_metrics(part_mapping(spark, sf_dir), part_importance(spark, sf_dir))


@query(f"WITH {MAPPING} SELECT table_key, max(confidence) AS confidence FROM m GROUP BY table_key")
def top_confidence(spark, sf_dir):
    return M.top_confidence(part_mapping(spark, sf_dir))


@query(f"WITH {MAPPING}, d AS (SELECT count(DISTINCT table_key) AS tables_merged FROM m WHERE bucket = 'merged'), t AS (SELECT count(DISTINCT table_key) AS tables FROM cat) SELECT CASE WHEN tables_merged = 0 THEN 'none' WHEN tables_merged = 1 THEN 'single_table' WHEN tables_merged < tables THEN 'several_tables' ELSE 'all_tables' END AS mode, tables_merged, tables FROM d, t")
def merge_scope(spark, sf_dir):
    return M.merge_scope(part_mapping(spark, sf_dir), part_catalog(spark, sf_dir))


@query(f"WITH {MAPPING}, w AS (SELECT table_key AS item, name, n_select + n_where + n_join AS uses, bucket AS category FROM m WHERE bucket <> 'merged') SELECT item, name, category, round(uses * 1.0 / max(uses) OVER (PARTITION BY item), 6) AS score, uses = 0 AS dead FROM w")
def unmapped_importance(spark, sf_dir):
    rows = M.unmapped(part_mapping(spark, sf_dir))
    return S.importance(rows).join(rows.select("item", "name", "category"), ["item", "name"]).select("item", "name", "category", "score", "dead")


@query(
    f"""WITH {MAPPING}, s AS (SELECT *, CASE WHEN bucket <> 'review' THEN NULL WHEN length(name) % 4 = 0 THEN 'approved' WHEN length(name) % 4 = 1 THEN 'rejected' WHEN length(name) % 4 = 2 THEN 'green' END AS act FROM m)
SELECT table_key, name, CASE WHEN act IN ('approved', 'green') THEN least(greatest(confidence, 0.85), 0.98) ELSE confidence END AS confidence, CASE WHEN act IN ('approved', 'green') THEN 'merged' WHEN act = 'rejected' THEN 'trash' ELSE bucket END AS bucket, CASE WHEN act IN ('approved', 'green') THEN 'hitl_approved' WHEN act = 'rejected' THEN 'hitl_rejected' ELSE bucket END AS category FROM s"""
)
def reviewed_mapping(spark, sf_dir):
    rows = part_mapping(spark, sf_dir)
    n = F.length("name") % 4
    chosen = rows.where("bucket = 'review'").select(M.signature(F.col("table_key"), F.col("name"), F.col("target")).alias("signature"), F.when(n == 0, "approved").when(n == 1, "Rejected ").alias("action"), F.when(n == 2, "green").when(n == 3, "yellow").alias("queue"))
    return M.apply_decisions(rows, chosen).select("table_key", "name", "confidence", "bucket", "category")


@query("SELECT DISTINCT c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN concat('c', c_custkey) WHEN c_custkey % 3 = 1 THEN concat('client_', c_custkey) ELSE lower(regexp_replace(c_name, '[^A-Za-z0-9]+', '_', 'g')) END AS alias, CASE WHEN c_custkey % 3 = 1 THEN 'glossary' ELSE 'transliteration' END AS source, 1.0 AS confidence, false AS warning FROM customer")
def rename_mapping(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    known = c.where("c_custkey % 3 = 0").select(F.col("c_name").alias("name"), F.concat(F.lit("c"), "c_custkey").alias("alias"))
    terms = c.where("c_custkey % 3 = 1").select(F.col("c_name").alias("term"), F.concat(F.lit("Client-"), "c_custkey").alias("target"))
    return M.rename_mapping(c.select(F.col("c_name").alias("name")), known, terms)


CONCEPTS = {"terms": ["license", "copyright"], "people": ["customer", "client", "user"]}


@query(
    "WITH t AS (SELECT doc_id AS key, lower(text) AS text FROM documents) "
    + " UNION ALL ".join(f"SELECT '{q}' AS query, key FROM t WHERE " + " OR ".join(f"contains(text, '{w}')" for w in words) for q, words in CONCEPTS.items())
)
def concept_search(spark, sf_dir):
    return M.concept_hits(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text"), CONCEPTS)


LISTED = "man AS (SELECT s_suppkey AS item FROM supplier WHERE s_acctbal >= 0), inv AS (SELECT s_suppkey AS item, CAST(s_nationkey AS VARCHAR) AS domain, s_acctbal AS priority, s_name AS description FROM supplier WHERE s_suppkey % 3 <> 0), sym AS (SELECT a AS src, b AS dst FROM e UNION ALL SELECT b, a FROM e)"


def supplier_manifest(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("item"))


def listed_suppliers(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0")
    return rows.select(F.col("s_suppkey").alias("item"), F.col("s_nationkey").cast("string").alias("domain"), F.col("s_acctbal").alias("priority"), F.col("s_name").alias("description"))


@query(f"WITH {EDGES}, {LISTED} SELECT DISTINCT src AS item FROM sym WHERE src NOT IN (SELECT item FROM man) AND src NOT IN (SELECT item FROM inv)")
def ghost_endpoints(spark, sf_dir):
    return P.ghosts(supplier_edges(spark, sf_dir), supplier_manifest(spark, sf_dir), listed_suppliers(spark, sf_dir))


@query(f"WITH {EDGES}, {LISTED} SELECT item FROM (SELECT item FROM b UNION SELECT src FROM sym) q WHERE item NOT IN (SELECT item FROM man)")
def gap_tables(spark, sf_dir):
    return P.gap_tables(statement_table_counts(spark, sf_dir), supplier_edges(spark, sf_dir), supplier_manifest(spark, sf_dir))


@query(
    f"""WITH {EDGES}, {LISTED}, away AS (SELECT src AS item, dst AS other, row_number() OVER (PARTITION BY src ORDER BY dst) AS rn FROM sym WHERE dst NOT IN (SELECT item FROM man)),
few AS (SELECT item, count(*) AS n_missing, string_agg(CAST(other AS VARCHAR), ', ' ORDER BY other) FILTER (WHERE rn <= 8) AS names FROM away GROUP BY item)
SELECT inv.item, inv.item NOT IN (SELECT item FROM man) AS unlisted, coalesce(n_missing, 0) AS n_missing, concat_ws('; ', CASE WHEN inv.item NOT IN (SELECT item FROM man) THEN 'not in the manifest' END, CASE WHEN n_missing > 0 THEN concat('missing: ', names) END) AS reason FROM inv LEFT JOIN few ON few.item = inv.item"""
)
def neighbour_breakage(spark, sf_dir):
    return P.breakage(listed_suppliers(spark, sf_dir), supplier_edges(spark, sf_dir), supplier_manifest(spark, sf_dir))


@query(f"WITH {COUNTS}, man AS (SELECT s_suppkey AS item FROM supplier WHERE s_acctbal >= 0) SELECT count(*) AS n, count(man.item) AS listed, round(count(man.item) / count(*), 6) AS share, count(*) < 10 OR count(man.item) / count(*) >= 0.05 AS enforce FROM c LEFT JOIN man ON man.item = c.item")
def manifest_overlap(spark, sf_dir):
    return P.overlap(statement_table_counts(spark, sf_dir), supplier_manifest(spark, sf_dir))


WAVES = """n AS (SELECT p_partkey, p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part),
ch AS (SELECT DISTINCT p_brand, (n - 1) // 20 AS chunk FROM n), f AS (SELECT p_brand, p_retailprice, p_partkey FROM n WHERE n = 1),
w AS (SELECT ch.p_brand, chunk, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey, chunk) AS wave FROM ch JOIN f ON f.p_brand = ch.p_brand),
pl AS (SELECT p_partkey AS item, CAST(wave AS INTEGER) AS wave FROM n JOIN w ON w.p_brand = n.p_brand AND w.chunk = (n.n - 1) // 20)"""


def planned_parts(spark, sf_dir) -> DataFrame:
    """Every part with its wave; the cap on waves is the planning query's alone."""
    return part_waves(spark, sf_dir, None).select(F.col("p_partkey").alias("item"), "wave")


@query(f"WITH {WAVES}, gap AS (SELECT s_suppkey AS item FROM supplier WHERE s_acctbal < 0 ORDER BY 1 LIMIT 20) SELECT item, wave, false AS gap FROM pl UNION ALL SELECT item, (SELECT max(wave) FROM pl) + 1, true FROM gap WHERE (SELECT max(wave) FROM pl) < 10000")
def gap_wave(spark, sf_dir):
    missing = read(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("item"))
    return P.with_gap_wave(planned_parts(spark, sf_dir), missing, 20, 10_000)


PARTS_SEEN = "seen AS (SELECT l_partkey AS item, count(*) AS query_count FROM lineitem GROUP BY 1)"


def seen_parts(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(F.count("*").alias("query_count"))


def part_rows(spark, sf_dir) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_retailprice").alias("priority"), F.col("p_size").alias("size"), F.col("p_name").alias("description"), F.col("p_type").alias("status"))
    return p.join(seen_parts(spark, sf_dir), "item", "left")


@query(
    f"WITH {WAVES}, {PARTS_SEEN} SELECT wave, count(*) AS tables, CAST(coalesce(sum(query_count), 0) AS BIGINT) AS queries, round(avg(p_retailprice), 6) AS avg_priority, round(min(p_retailprice), 2) AS min_priority, round(max(p_retailprice), 2) AS max_priority, count(*) FILTER (WHERE p_size > 45) AS hot, count(*) FILTER (WHERE p_size < 20) AS mapped, count(*) FILTER (WHERE query_count IS NULL) AS broken FROM pl JOIN part ON p_partkey = pl.item LEFT JOIN seen ON seen.item = pl.item GROUP BY wave"
)
def wave_metrics(spark, sf_dir):
    rows = part_rows(spark, sf_dir)
    return P.wave_metrics(planned_parts(spark, sf_dir), rows, rows.where("size > 45"), rows.where("size < 20"), rows.where("query_count is null"), digits=6)


@query(f"WITH {WAVES} SELECT wave, count(*) FILTER (WHERE p_size > 30) AS green, count(*) FILTER (WHERE p_size BETWEEN 16 AND 30) AS yellow, count(*) FILTER (WHERE p_size BETWEEN 6 AND 15) AS red, count(*) FILTER (WHERE p_size < 6) AS unknown FROM pl JOIN part ON p_partkey = item GROUP BY wave")
def queues_by_wave(spark, sf_dir):
    scored = part_rows(spark, sf_dir).select("item", F.when(F.col("size") > 30, "green").when(F.col("size") > 15, "yellow").when(F.col("size") > 5, "red").alias("queue"))
    return P.queues_by_wave(planned_parts(spark, sf_dir), scored)


@query(f"WITH {WAVES}, {PARTS_SEEN} SELECT pl.item, wave, CASE WHEN p_size > 25 THEN concat('sheet of ', p_name) ELSE p_name END AS context, concat_ws(' - ', p_type, CASE WHEN query_count > 0 THEN concat(query_count, ' merge cluster(s)') END) AS note FROM pl JOIN part ON p_partkey = pl.item LEFT JOIN seen ON seen.item = pl.item")
def planned_tables(spark, sf_dir):
    rows = part_rows(spark, sf_dir)
    facts = rows.where("size > 25").select("item", F.concat(F.lit("sheet of "), "description").alias("text"))
    return P.enrich(planned_parts(spark, sf_dir), facts, rows, seen_parts(spark, sf_dir).withColumnRenamed("query_count", "n"))


@query(f"WITH {PARTS_SEEN} SELECT item, query_count, p_name AS text FROM seen JOIN part ON p_partkey = item ORDER BY query_count DESC, item LIMIT 24")
def fact_sheets(spark, sf_dir):
    return P.fact_sheets(seen_parts(spark, sf_dir), read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("text")), 24)


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn, count(*) OVER (PARTITION BY p_brand) AS tables FROM part) SELECT p_brand AS domain, CAST(row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS position, tables, p_retailprice AS top_priority FROM r WHERE rn = 1")
def domain_order(spark, sf_dir):
    return P.domain_order(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("domain"), F.col("p_retailprice").alias("priority")))


STATUS = "CASE WHEN o_orderkey % 997 = 5 THEN 'HITL_REQUIRED' WHEN o_orderstatus = 'P' THEN 'PARTIAL' WHEN o_orderkey % 1009 = 3 THEN NULL ELSE 'SUCCESS' END"


@query(
    f"""WITH s AS (SELECT date_trunc('month', o_orderdate) AS wave, coalesce({STATUS}, 'PENDING') AS st FROM orders),
p AS (SELECT wave, count(*) AS n, CASE WHEN bool_or(st = 'HITL_REQUIRED') THEN 'HITL_REQUIRED' WHEN bool_and(st = 'SUCCESS') THEN 'SUCCESS' ELSE 'PENDING' END AS status, bool_and(st IN ('SUCCESS', 'PARTIAL')) AS ready FROM s GROUP BY wave)
SELECT *, coalesce(bool_or(NOT ready) OVER (ORDER BY wave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS blocked FROM p"""
)
def wave_status(spark, sf_dir):
    return P.wave_status(read(spark, sf_dir, "orders").withColumn("month", F.date_trunc("month", "o_orderdate")), "month", F.expr(STATUS))


KEYS = "c AS (SELECT p_partkey AS pos, p_brand AS table_key, concat(p_type, '_id') AS col, p_size % 9 = 0 AS is_key FROM part), k AS (SELECT lower(col) AS k, table_key AS parent, min(pos) AS pos FROM c WHERE is_key GROUP BY 1, 2), d AS (SELECT DISTINCT table_key AS child, col FROM c WHERE NOT is_key)"


@query(f"WITH {KEYS}, f AS (SELECT child, col, parent, row_number() OVER (PARTITION BY child, col ORDER BY pos, parent) AS rn FROM d JOIN k ON k.k = lower(d.col) AND parent <> child) SELECT child, parent, col FROM f WHERE rn = 1")
def foreign_keys(spark, sf_dir):
    c = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("table_key"), F.concat("p_type", F.lit("_id")).alias("col"), (F.col("p_size") % 9 == 0).alias("is_key"))
    return P.foreign_keys(c, c.limit(0).select(F.col("table_key").alias("child"), F.col("table_key").alias("parent"), "col"))


@query("SELECT p_partkey, p_brand AS table_key, p_name AS col, CASE WHEN (p_brand, p_name) IN (SELECT DISTINCT p_brand, p_name FROM part WHERE p_size = 7) THEN 1 ELSE 0 END AS is_key FROM part")
def key_flags(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("table_key"), F.col("p_name").alias("col"), "p_size")
    return P.key_flags(p.drop("p_size"), p.where("p_size = 7")).select("p_partkey", "table_key", "col", "is_key")


@query("SELECT p_brand AS domain, lower(p_name) AS col, concat(min(upper(p_type)), ' / ', max(upper(p_type))) AS example, count(DISTINCT upper(p_type)) AS types, count(DISTINCT p_partkey) AS tables FROM part GROUP BY 1, 2 HAVING count(DISTINCT upper(p_type)) > 1")
def type_conflicts(spark, sf_dir):
    return P.type_conflicts(read(spark, sf_dir, "part").select(F.col("p_brand").alias("domain"), F.col("p_name").alias("col"), F.col("p_type").alias("type"), F.col("p_partkey").alias("table_key")))


@query("SELECT CAST(event_id AS VARCHAR) AS model, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS n FROM events")
def run_row_counts(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return P.run_rows(e.select(F.col("event_id").cast("string").alias("model"), F.regexp_replace("props", '"k"', '"rows"').alias("response")))


@query("WITH t AS (SELECT event_type AS agent, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS tokens, count(*) AS calls FROM events GROUP BY 1) SELECT agent, tokens, round(tokens / 2000.0 * (0.0002 + 0.0008), 6) AS cost, calls, round(tokens / sum(tokens) OVER (), 6) AS share FROM t")
def token_rollup(spark, sf_dir):
    return P.token_rollup(read(spark, sf_dir, "events").select(F.col("event_type").alias("agent"), F.floor("value").alias("tokens")), 0.0002, 0.0008)


@query("WITH r AS (SELECT o_orderstatus AS schema, count(*) AS tables, CAST(sum(o_custkey) AS BIGINT) AS queries, round(100.0 * count(*) FILTER (WHERE o_orderpriority = '1-URGENT') / count(*), 2) AS pct_ready FROM orders GROUP BY 1) SELECT * FROM r")
def schema_breakdown(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return P.schema_breakdown(o.select(F.col("o_orderkey").alias("item"), F.col("o_orderstatus").alias("schema"), F.col("o_custkey").alias("query_count"), F.when(F.col("o_orderpriority") == "1-URGENT", "Ready").alias("status")))


@query("SELECT p_brand AS key, count(DISTINCT p_type) AS n, sha256(string_agg(DISTINCT p_type, chr(10) ORDER BY p_type)) AS digest FROM part GROUP BY p_brand")
def rules_hash(spark, sf_dir):
    return P.rules_hash(read(spark, sf_dir, "part").select("p_brand", F.col("p_type").alias("rule")), "p_brand")
