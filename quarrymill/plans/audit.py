"""Queries over answers, graded sets, recipes and releases, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import text as X
from quarrymill.operators import gates, near, nearest, pairs, release, split
from quarrymill.plans.curation import DRAW, NORM, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


FENCE = "'" + "`" * 3 + "'"
ANSWER = f"CASE turn % 4 WHEN 0 THEN 'so ' || {FENCE} || 'code' || chr(10) || text || {FENCE} || ' end ' || {FENCE} WHEN 1 THEN 'x ' || {FENCE} || 'py' || chr(10) || text || {FENCE} || ' y ' || {FENCE} || text || {FENCE} || 'z' WHEN 2 THEN ' open ' || {FENCE} || chr(10) || ' def f(a) ' || chr(123) || text ELSE 'func f ' || text || ' ' END"
TRIM = "regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', '')"


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Turns written as answers of four shapes."""
    text, mark = F.col("text"), "`" * 3
    shape = (
        F.when(F.col("turn") % 4 == 0, F.concat(F.lit(f"so {mark}code\n"), text, F.lit(f"{mark} end {mark}"))).when(F.col("turn") % 4 == 1, F.concat(F.lit(f"x {mark}py\n"), text, F.lit(f"{mark} y {mark}"), text, F.lit(f"{mark}z")))
        .when(F.col("turn") % 4 == 2, F.concat(F.lit(f" open {mark}\n def f(a) {{"), text)).otherwise(F.concat(F.lit("func f "), text, F.lit(" ")))
    )
    return table(spark, d, "conversations").select("conv_id", "turn", shape.alias("answer"))


@query(f"""WITH a AS (SELECT conv_id, turn, {ANSWER} AS a FROM conversations),
b AS (SELECT conv_id, turn, a, CASE WHEN contains(a, {FENCE} || 'code') THEN split_part(substr(a, strpos(a, {FENCE} || 'code') + 7), {FENCE}, 1) WHEN contains(a, {FENCE}) THEN substr(a, strpos(a, {FENCE}) + 3) ELSE a END AS rest FROM a)
SELECT conv_id, turn, {TRIM.format(f"CASE WHEN NOT contains(a, {FENCE} || 'code') AND contains(a, {FENCE}) AND contains(rest, {FENCE}) THEN left(rest, len(rest) - strpos(reverse(rest), {FENCE}) - 2) ELSE rest END")} AS code,
contains(a, {FENCE}) AS fenced, regexp_matches(a, {FENCE} || '(python|py)\\b') AS python_fence, regexp_matches(a, '\\bdef \\w+\\(') AS signature, regexp_matches(a, '\\bdef \\w+\\(.*\\)\\s*(->[^{{]*)?\\{{') AS braced_def, regexp_matches(a, '\\bfunc \\w+') AS func_keyword FROM b""")
def q_answer_format(spark: SparkSession, d: str) -> DataFrame:
    """The code in each answer, and how the answer is written."""
    return answers(spark, d).select("conv_id", "turn", X.extract_code("answer", "code").alias("code"), *[c.alias(n) for n, c in X.format_flags("answer").items()])


@query(f"""WITH n AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'node A' || page_id || ' {{ has u: str = "' || lower(left(url, 4)) || '"; has  n : int; }} x node B {{}}' WHEN 1 THEN 'none' ELSE 'node C {{ has a: list[int] ; }}' END AS t FROM pages)
SELECT page_id, CASE page_id % 3 WHEN 0 THEN '- A' || page_id || '(u: str, n : int)' || chr(10) || '- B()' WHEN 1 THEN '' ELSE '- C(a: list[int])' END AS bullets FROM n""")
def q_schema_bullets(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and their fields lifted from declarations."""
    n = F.col("page_id")
    text = F.when(n % 3 == 0, F.concat(F.lit("node A"), n.cast("string"), F.lit(' { has u: str = "'), F.lower(F.left("url", F.lit(4))), F.lit('"; has  n : int; } x node B {}'))).when(n % 3 == 1, "none").otherwise("node C { has a: list[int] ; }")
    return table(spark, d, "pages").select("page_id", X.schema_bullets(text).alias("bullets"))


GRADED = "g AS (SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic, n_chars % 5 AS tests FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


@query(f"""WITH {GRADED}, v AS (SELECT doc_id FROM g WHERE toxic = 0 AND tests > 0)
SELECT lang, count(*) AS n, CAST(sum(quality) AS BIGINT) AS passed, count(*) FILTER (doc_id IN (SELECT doc_id FROM v)) AS valid_n, CAST(coalesce(sum(quality) FILTER (doc_id IN (SELECT doc_id FROM v)), 0) AS BIGINT) AS valid_passed FROM g GROUP BY 1""")
def q_reference_valid(spark: SparkSession, d: str) -> DataFrame:
    """Rates over all items, and over those whose reference passes: not toxic, and with tests."""
    docs = table(spark, d, "documents").select("doc_id", "lang", (F.col("n_chars") % 5).alias("tests"))
    graded = docs.join(table(spark, d, "labels"), "doc_id")
    valid = graded.where("toxic = 0 and tests > 0").select("doc_id")
    rows = gates.flagged(graded, valid, "doc_id", "valid")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").cast("bigint").alias("passed"), F.count_if("valid").alias("valid_n"), F.sum(F.when(F.col("valid"), F.col("quality")).otherwise(0)).cast("bigint").alias("valid_passed"))


@query("""SELECT o.o_orderkey AS problem, l.l_linenumber AS sample, p.p_size AS n_tests, CASE WHEN l.l_returnflag = 'N' THEN least(p.p_size, CAST(l.l_quantity AS INT)) ELSE 0 END AS n_passed,
l.l_returnflag = 'N' AND l.l_linestatus = 'O' AND l.l_quantity >= p.p_size AS strict
FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey JOIN part p ON l.l_partkey = p.p_partkey""")
def q_rescore(spark: SparkSession, d: str) -> DataFrame:
    """Problem, sample and verdict in one row, scored anew; strict: the verdict, and all tests on re-run."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")
    rows = table(spark, d, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, d, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    passed = F.when(F.col("l_returnflag") == "N", F.least("p_size", F.col("l_quantity").cast("int"))).otherwise(0)
    strict = (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O") & (F.col("l_quantity") >= F.col("p_size"))
    return rows.select(F.col("o_orderkey").alias("problem"), F.col("l_linenumber").alias("sample"), F.col("p_size").alias("n_tests"), passed.alias("n_passed"), strict.alias("strict"))


@query("""SELECT CAST(ts AS DATE)::VARCHAR AS day, count(*) FILTER (event_type IN ('click', 'purchase')) AS graded, count(*) FILTER (event_type NOT IN ('click', 'purchase')) AS prose, count(*) FILTER (event_type = 'purchase') AS runs,
CAST(CASE WHEN count(*) FILTER (event_type IN ('click', 'purchase')) = 0 THEN 0 ELSE count(*) FILTER (event_type = 'purchase') * 100 // count(*) FILTER (event_type IN ('click', 'purchase')) END AS BIGINT) AS runs_pct FROM events GROUP BY 1""")
def q_ungraded(spark: SparkSession, d: str) -> DataFrame:
    """Rows of classes that aren't graded are counted apart and never in a rate."""
    graded = gates.code_graded(F.col("event_type"), ("click", "purchase"))
    rows = table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count_if(graded).alias("graded"), F.count_if(~graded).alias("prose"), F.count_if(F.col("event_type") == "purchase").alias("runs"))
    return rows.withColumn("runs_pct", X.percent_floor(F.col("runs"), F.col("graded")))


@query("""WITH m AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS step, event_type AS series, count(*) FILTER (value >= 20) AS runs, count(*) AS total FROM events GROUP BY 1, 2),
s AS (SELECT series, step, runs, total FROM m UNION ALL SELECT 'OVERALL', step, CAST(sum(runs) AS BIGINT), CAST(sum(total) AS BIGINT) FROM m GROUP BY step)
SELECT series, step, runs, total, round(100.0 * runs / total, 6)::DOUBLE AS rate FROM s WHERE total > 0""")
def q_overall_per_step(spark: SparkSession, d: str) -> DataFrame:
    """parts of each step, and the step as a whole added up from them."""
    step = F.datediff(F.to_date("ts"), F.lit("2024-01-01")).cast("bigint").alias("step")
    parts = table(spark, d, "events").groupBy(step, F.col("event_type").alias("series")).agg(F.count_if(F.col("value") >= 20).alias("runs"), F.count("*").alias("total"))
    return release.with_overall(parts, "series", "step", ["runs", "total"]).where("total > 0").withColumn("rate", F.round(100.0 * F.col("runs") / F.col("total"), 6))


@query()
def q_minhash_clusters(spark: SparkSession, d: str) -> DataFrame:
    """E7 (from prose): clusters at a Jaccard similarity over 0.85, of each of which the longest document is kept. No SQL: clusters are closed over links."""
    return near.best_of_clusters(table(spark, d, "documents").select("doc_id", "text", "n_chars"), F.col("n_chars"))


@query("""WITH u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM u),
m AS (SELECT list(s ORDER BY i) AS mean FROM (SELECT i, avg(e[i]) AS s FROM n, range(1, 65) t(i) WHERE label = 0 AND i <= len(e) GROUP BY i))
SELECT label, count(*) AS n, round(avg(list_dot_product(e, mean)), 5) AS mean_cosine FROM n, m WHERE label <> 0 GROUP BY 1""")
def q_recipe_cosine(spark: SparkSession, d: str) -> DataFrame:
    """L5 (from prose): each recipe's mean cosine to the held-out vectors (label 0). The mean over pairs is the product with the mean
    of the held-out unit vectors, so no pair is ever made."""
    rows = table(spark, d, "embeddings")
    return nearest.mean_cosine(rows.where("label <> 0"), rows.where("label = 0"), "label", "embedding").withColumn("mean_cosine", F.round("mean_cosine", 5))


@query("""WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0), a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
d AS (SELECT q.vec_id, max(list_cosine_similarity(q.e, a.e)) AS s FROM q, a WHERE q.vec_id <> a.vec_id GROUP BY 1)
SELECT vec_id, round(1 - s, 5) AS distance, CAST(row_number() OVER (ORDER BY -round(1 - s, 5), vec_id) AS BIGINT) AS novelty_rank FROM d""")
def q_novelty_rank(spark: SparkSession, d: str) -> DataFrame:
    """L4 (from prose): every twentieth vector, as a stated set of queries, against all others, and its rank by the distance to the
    nearest: the farthest first."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    found = nearest.nearest(rows.where("vec_id % 20 = 0"), rows, "vec_id", "embedding").withColumn("distance", F.round(1 - F.col("s"), 5))
    ranked = split.cumulated(found.withColumn("_key", -F.col("distance")), ["_key", "vec_id"])
    return ranked.select("vec_id", "distance", (F.col("before") + 1).alias("novelty_rank"))


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {DRAW}, doc_id) - 1 AS position FROM documents")
def q_mix_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """H7: a seeded shuffle of all rows."""
    return split.shuffled(table(spark, d, "documents").select("doc_id"), "doc_id")


def part_draw(text: str) -> str:
    return f"CAST(('0x' || substring(md5({text}), 1, 12)) AS BIGINT) / 281474976710656.0"


@query(f"SELECT doc_id, lang FROM documents WHERE {part_draw('''concat('manual:', lang, '/', doc_id)''')} < 0.05 + 0.05 * ({part_draw('''concat('share:', lang)''')})")
def q_manual_sample(spark: SparkSession, d: str) -> DataFrame:
    """H11 (from prose): 5 to 10 % of each pass (here a language), drawn anew each pass; the sampling operator itself."""
    return split.manual_sample(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", F.col("lang"))


@query(f"""WITH p AS (SELECT doc_id, n_chars, {DRAW} / 281474976710656.0 AS x FROM documents), parts AS (SELECT doc_id, x < 0.85 AS train, n_chars FROM p)
SELECT 'disjoint_and_complete' AS check_name, CAST(0 AS BIGINT) AS bad UNION ALL SELECT 'sizes_add_up', CAST(0 AS BIGINT)
UNION ALL SELECT 'no_duplicate_ids', (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'not_empty', CAST((SELECT count(*) = 0 FROM documents) AS BIGINT) UNION ALL SELECT 'row_floor', CAST((SELECT count(*) < 100 FROM documents) AS BIGINT)
UNION ALL SELECT 'not_all_zero', (SELECT count(*) FROM (SELECT source FROM documents GROUP BY 1 HAVING max(n_chars) = 0)) UNION ALL SELECT 'no_leak', (SELECT count(*) FROM documents WHERE sha1({NORM}) IN (SELECT sha1({NORM}) FROM benchmark))""")
def q_release_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of a release, and how many rows or groups break it."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars", X.chash(X.norm_code("text")).alias("h"), split.draw(F.col("doc_id"), "42").alias("x"))
    held = table(spark, d, "benchmark").select(X.chash(X.norm_code("text")).alias("k"))
    parts = [docs.where("x < 0.85"), docs.where("x >= 0.85")]
    return release.checks({
        "disjoint_and_complete": split.disjoint_union(parts, docs, "doc_id"), "sizes_add_up": release.sizes_differ(parts, docs), "no_duplicate_ids": release.duplicate_ids(docs, "doc_id"),
        "not_empty": release.too_few(docs, 1), "row_floor": release.too_few(docs, 100), "not_all_zero": release.all_zero(docs, "source", "n_chars"), "no_leak": gates.flagged(docs, held, "h", "leaks").where("leaks"),
    })


@query(f"""WITH p AS (SELECT u.conv_id, u.turn, u.role AS stage, u.text AS source, a.text AS target, u.turn IN (2, 4) AS denied FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1),
n AS (SELECT *, {NORM.replace('text', 'source')} AS ns, {NORM.replace('text', 'target')} AS nt FROM p)
SELECT conv_id, turn, CASE WHEN target IS NULL THEN 'null_source_field' WHEN denied THEN 'eval_denylist' WHEN ns = nt THEN 'chosen_equals_rejected' WHEN trim(source) = '' OR trim(target) = '' THEN 'empty_source_or_target' WHEN stage <> 'user' THEN 'gate_not_round_trip_passed' END AS reject_reason FROM n""")
def q_pair_gates(spark: SparkSession, d: str) -> DataFrame:
    """C2, C4, C6, C8, C9 by name, over a turn and the next one."""
    conv = table(spark, d, "conversations")
    said = conv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    rows = conv.select("conv_id", "turn", "role", F.col("text").alias("source")).join(said, ["conv_id", "turn"], "left")
    return gates.gated(rows, [
        gates.null_source_field(F.col("source"), F.col("target")), gates.eval_denylist(F.col("turn").isin(2, 4)), gates.chosen_equals_rejected(F.col("source"), F.col("target")),
        gates.empty_source_or_target(F.col("source"), F.col("target")), gates.gate_not_round_trip_passed(F.col("role"), "user"),
    ]).select("conv_id", "turn", "reject_reason")


@query()
def q_completion_cut(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as functions, a sentence a line, cut into prefix and target. No SQL: strings and braces need a scanner."""
    body = F.regexp_replace(F.regexp_replace("text", r"[\"'#{}]", ""), r"\. ", ".\n    ")
    code = F.concat(F.lit("def doc_"), F.col("doc_id").cast("string"), F.lit("(x: int) -> int {\n    "), body, F.lit("\n}"))
    found = pairs.completion_pairs(table(spark, d, "documents").select("doc_id", code.alias("code")), "doc_id", "code")
    return found.select("key", "cut_frac", "after_head", "open_block", "prefix_lines", "target_lines", F.sha1(F.concat("prefix", "target").cast("binary")).alias("code_sha1"))


@query("""SELECT lang AS recipe, source AS generator, count(*) AS rows, CAST(sum(n_chars) AS BIGINT) AS tokens, count(*) FILTER (l.quality = 1) AS correct, round(sum(n_chars) / nullif(count(*) FILTER (l.quality = 1), 0), 4) AS tokens_to_correct
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2""")
def q_token_accounting(spark: SparkSession, d: str) -> DataFrame:
    """L11 (from prose): tokens (here characters) of each generator and recipe, and how many a correct row costs."""
    rows = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return release.token_accounting(rows, ["lang", "source"], "n_chars", F.col("quality") == 1).withColumnsRenamed({"lang": "recipe", "source": "generator"})


@query("""WITH e AS (SELECT label, vec_id, len(embedding) AS d FROM embeddings), t AS (SELECT label, count(*) AS n FROM e GROUP BY 1), s AS (SELECT count(*) AS total FROM e)
SELECT label AS domain, n, round(n / total, 6) AS share, n / total >= 0.05 AS covered FROM t, s""")
def q_domain_coverage(spark: SparkSession, d: str) -> DataFrame:
    """L3's coverage (from prose) over clusters that are known: rows, share, and whether a domain has its least share."""
    rows = table(spark, d, "embeddings").groupBy(F.col("label").alias("domain")).agg(F.count("*").alias("n"))
    return release.coverage(rows, "n", 0.05)


@query("""WITH c AS (SELECT source AS construct, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 3000 THEN 'middle' ELSE 'long' END AS band, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT construct, band, n, greatest(20 - n, 0) AS missing FROM c""")
def q_construct_matrix(spark: SparkSession, d: str) -> DataFrame:
    """F24 (from prose): counts of constructs by band, against a target a cell."""
    band = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 3000, "middle").otherwise("long")
    rows = table(spark, d, "documents").groupBy(F.col("source").alias("construct"), band.alias("band")).agg(F.count("*").alias("n"))
    return rows.withColumn("missing", F.greatest(20 - F.col("n"), F.lit(0)).cast("bigint"))


@query("""WITH s AS (SELECT user_id, event_type, avg(value) AS m FROM events GROUP BY 1, 2)
SELECT event_type, count(*) AS seeds, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd FROM s GROUP BY 1""")
def q_seed_spread(spark: SparkSession, d: str) -> DataFrame:
    """mean and spread of a measure over seeds (users)."""
    rows = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("m"))
    return rows.groupBy("event_type").agg(F.count("*").alias("seeds"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_samp("m"), 6).alias("sd"))


@query("""SELECT 'conversation' AS source_type, 'c-' || conv_id || '-' || turn AS id, text AS target, NULL::VARCHAR AS lang FROM conversations UNION ALL SELECT 'document', 'd-' || doc_id, text, lang FROM documents UNION ALL SELECT 'benchmark', 'b-' || item_id, text, NULL FROM benchmark""")
def q_pool(spark: SparkSession, d: str) -> DataFrame:
    """Sources of different shapes in one schema, absent fields null, ids under a prefix."""
    conv = table(spark, d, "conversations").select(F.lit("conversation").alias("source_type"), X.prefixed_id("c-", F.concat_ws("-", "conv_id", "turn")).alias("id"), F.col("text").alias("target"))
    docs = table(spark, d, "documents").select(F.lit("document").alias("source_type"), X.prefixed_id("d-", F.col("doc_id")).alias("id"), F.col("text").alias("target"), "lang")
    held = table(spark, d, "benchmark").select(F.lit("benchmark").alias("source_type"), X.prefixed_id("b-", F.col("item_id")).alias("id"), F.col("text").alias("target"))
    return conv.unionByName(docs, allowMissingColumns=True).unionByName(held, allowMissingColumns=True)


@query("""SELECT event_id, regexp_extract(props, '"k": ([0-9]+)', 1) AS k, NULL::VARCHAR AS none FROM events""")
def q_json_path(spark: SparkSession, d: str) -> DataFrame:
    """Values at paths of JSON texts; null where a step is missing."""
    return table(spark, d, "events").select("event_id", X.json_get("props", "k").alias("k"), X.json_get("props", "k", "deeper").alias("none"))
