"""Evaluation queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.functions import stats, text as X
from quarrymill.operators import curves, spectrum
from quarrymill.plans.curation import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents: lang as category, source as class, quality as the verdict of whether a row runs."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return docs.join(table(spark, d, "labels"), "doc_id")


JUDGED = "j AS (SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


@query(f"WITH {JUDGED} SELECT coalesce(lang, '__overall__') AS category, coalesce(source, '__overall__') AS gate_class, count(*) AS total, CAST(sum(quality) AS BIGINT) AS runs, CAST(sum(quality) * 100 // count(*) AS BIGINT) AS runs_pct FROM j GROUP BY GROUPING SETS ((lang, source), ())")
def q_bucket_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates by category and class with an overall row."""
    rows = judged(spark, d).groupingSets([[F.col("lang"), F.col("source")], []], "lang", "source").agg(F.count("*").alias("total"), F.sum("quality").cast("bigint").alias("runs"))
    name = lambda c: F.coalesce(c, F.lit("__overall__"))
    return rows.select(name("lang").alias("category"), name("source").alias("gate_class"), "total", "runs", X.percent_floor(F.col("runs"), F.col("total")).alias("runs_pct"))


WILSON = "round((k / n + 1.96 * 1.96 / (2 * n) {s} 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 6)"


@query(f"WITH {JUDGED}, r AS (SELECT coalesce(lang, 'all') AS lang, CAST(sum(quality) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM j GROUP BY GROUPING SETS ((lang), ())) SELECT lang, CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n, round(k / n, 6) AS rate, {WILSON.format(s='-')} AS low, {WILSON.format(s='+')} AS high FROM r")
def q_rate_wilson(spark: SparkSession, d: str) -> DataFrame:
    """F5, S1."""
    rows = judged(spark, d).groupingSets([[F.col("lang")], []], "lang").agg(F.sum("quality").cast("bigint").alias("k"), F.count("*").alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return rows.select(F.coalesce("lang", F.lit("all")).alias("lang"), "k", "n", F.round(F.col("k") / F.col("n"), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


# fixed values: coefficients of the same fit as functions.stats.erfc
ERFC = "t * exp(-x * x - 1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277)))))))))"


@query(f"""WITH {JUDGED}, r AS (SELECT lang, CAST(sum(quality) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM j GROUP BY 1),
p AS (SELECT a.lang AS a, b.lang AS b, a.k / a.n - b.k / b.n AS diff, (a.k + b.k) / (a.n + b.n) AS pool, 1 / a.n + 1 / b.n AS inv FROM r a JOIN r b ON a.lang < b.lang),
z AS (SELECT a, b, CASE WHEN pool * (1 - pool) > 0 THEN diff / sqrt(pool * (1 - pool) * inv) ELSE 0 END AS z FROM p), x AS (SELECT a, b, z, abs(z) / sqrt(2.0) AS x, 1 / (1 + 0.5 * (abs(z) / sqrt(2.0))) AS t FROM z)
SELECT a, b, round(z, 5) AS z, round({ERFC}, 5) AS p FROM x""")
def q_two_prop_z(spark: SparkSession, d: str) -> DataFrame:
    """S3: every pair of languages, from one row that lists their counts; no join."""
    r = judged(spark, d).groupBy("lang").agg(F.sum("quality").cast("double").alias("k"), F.count("*").cast("double").alias("n"))
    every = r.agg(F.collect_list(F.struct("lang", "k", "n")).alias("all"))
    pairs = every.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).where("a.lang < b.lang")
    z, p = stats.two_proportions(F.col("a.k"), F.col("a.n"), F.col("b.k"), F.col("b.n"))
    return pairs.select(F.col("a.lang").alias("a"), F.col("b.lang").alias("b"), F.round(z, 5).alias("z"), F.round(p, 5).alias("p"))


@query(f"""WITH {JUDGED}, c AS (SELECT coalesce(lang, 'all') AS lang, count(*) FILTER (quality = 1 AND toxic = 0) AS both_, count(*) FILTER (quality = 1 AND toxic = 1) AS a_only, count(*) FILTER (quality = 0 AND toxic = 0) AS b_only, count(*) FILTER (quality = 0 AND toxic = 1) AS neither FROM j GROUP BY GROUPING SETS ((lang), ()))
SELECT lang, both_, a_only, b_only, neither, round(CASE WHEN a_only + b_only = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(a_only, b_only) + 1), lambda i: exp(lgamma(a_only + b_only + 1) - lgamma(i + 1) - lgamma(a_only + b_only - i + 1) - (a_only + b_only) * ln(2))))) END, 7)::DOUBLE AS p FROM c""")
def q_paired_mcnemar(spark: SparkSession, d: str) -> DataFrame:
    """Two verdicts on the same item, good and not toxic."""
    a, b = F.col("quality") == 1, F.col("toxic") == 0
    rows = judged(spark, d).groupingSets([[F.col("lang")], []], "lang").agg(F.count_if(a & b).alias("both_"), F.count_if(a & ~b).alias("a_only"), F.count_if(~a & b).alias("b_only"), F.count_if(~a & ~b).alias("neither"))
    return rows.select(F.coalesce("lang", F.lit("all")).alias("lang"), "both_", "a_only", "b_only", "neither", F.round(stats.mcnemar(F.col("a_only"), F.col("b_only")), 7).alias("p"))


@query(f"WITH {JUDGED} SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS compiles, count(*) FILTER (quality = 1 AND toxic = 0) AS passes, round(count(*) FILTER (quality = 1 AND toxic = 0) / nullif(count(*) FILTER (quality = 1), 0), 6) AS of_those FROM j GROUP BY 1")
def q_conditional_rate(spark: SparkSession, d: str) -> DataFrame:
    """F6, F17."""
    good = F.col("quality") == 1
    rows = judged(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(good).alias("compiles"), F.count_if(good & (F.col("toxic") == 0)).alias("passes"))
    return rows.withColumn("of_those", F.round(F.col("passes") / F.when(F.col("compiles") > 0, F.col("compiles")), 6))


@query("""WITH t AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS p FROM lineitem GROUP BY 1)
SELECT CAST(sum(p) AS BIGINT) AS passed, CAST(sum(n) AS BIGINT) AS tests, round(sum(p) / sum(n), 9) AS micro, round(sum(CASE WHEN n > 0 THEN p / n ELSE 0 END) / count(*), 9) AS macro, count(*) FILTER (p = n) AS strict FROM t""")
def q_micro_macro(spark: SparkSession, d: str) -> DataFrame:
    """Orders as tasks, lines as tests; the macro mean's denominator keeps tasks without tests."""
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("p"))
    each = F.sum(F.when(F.col("n") > 0, F.col("p") / F.col("n")).otherwise(0.0)) / F.count("*")
    return t.agg(F.sum("p").alias("passed"), F.sum("n").alias("tests"), F.round(F.sum("p") / F.sum("n"), 9).alias("micro"), F.round(each, 9).alias("macro"), F.count_if(F.col("p") == F.col("n")).alias("strict"))


OUTPUT = """CASE event_id % 4 WHEN 0 THEN 'checking' || chr(10) || 'error[E' || user_id % 9 || ']: name ''' || props || ''' is unknown' || chr(10) || 'error[E99]: more' WHEN 1 THEN 'error[E50]: return type ' || event_type || ' ''k'' but got ' || CAST(event_id % 3 AS VARCHAR) WHEN 2 THEN 'note' || chr(10) || '  ' || event_type || ' errors found' || chr(13) || chr(10) ELSE '' END"""


@query(f"""WITH o AS (SELECT event_type, {OUTPUT} AS out FROM events), t AS (SELECT event_type, out, regexp_extract(out, 'error\\[(E[0-9]+)\\]: ([^\\n]*)', 1) AS code, regexp_extract(out, 'error\\[(E[0-9]+)\\]: ([^\\n]*)', 2) AS msg FROM o),
f AS (SELECT event_type, CASE WHEN code <> '' THEN code || ': ' || msg ELSE left(regexp_extract(regexp_replace(out, '\\s+$', ''), '([^\\n\\r]*)$', 1), 120) END AS first FROM t),
s AS (SELECT event_type, left(regexp_replace(regexp_replace(first, '''[^'']{{2,}}''', '''x''', 'g'), 'return type .* but', 'return type T but', 'g'), 80) AS sig, count(*) AS n FROM f GROUP BY 1, 2)
SELECT event_type, sig, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY event_type ORDER BY n DESC, sig) AS INT) AS rank FROM s) WHERE rank <= 6""")
def q_error_signatures(spark: SparkSession, d: str) -> DataFrame:
    """The six commonest signatures of the first errors of each kind of event's output. Signatures are counted before
    they are ranked, so a window holds a row a signature."""
    props, kind, i = F.col("props"), F.col("event_type"), F.col("event_id")
    out = (
        F.when(i % 4 == 0, F.concat(F.lit("checking\nerror[E"), (F.col("user_id") % 9).cast("string"), F.lit("]: name '"), props, F.lit("' is unknown\nerror[E99]: more")))
        .when(i % 4 == 1, F.concat(F.lit("error[E50]: return type "), kind, F.lit(" 'k' but got "), (i % 3).cast("string"))).when(i % 4 == 2, F.concat(F.lit("note\n  "), kind, F.lit(" errors found\r\n"))).otherwise("")
    )
    rows = table(spark, d, "events").select("event_type", X.error_signature(X.first_error(out)).alias("sig")).groupBy("event_type", "sig").agg(F.count("*").alias("n"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), "sig"))).where("rank <= 6")


@query("""WITH s AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS c FROM events GROUP BY 1),
p AS (SELECT n, c, 1 - CASE WHEN n < 1 THEN NULL ELSE (n - c) / n END AS p1, CASE WHEN n < 8 THEN NULL WHEN n - c < 8 THEN 1 ELSE 1 - exp(list_sum(list_transform(range(0, 8), lambda i: ln((n - c - i) / (n - i))))) END AS p8, c > 0 AS any_ FROM s)
SELECT count(*) AS problems, round(avg(p1), 6) AS pass_1, round(avg(p8), 6) AS pass_8, round(avg(any_::INT), 6) AS oracle, round(avg(p8) - avg(p1), 6) AS gap FROM p""")
def q_pass_at_k(spark: SparkSession, d: str) -> DataFrame:
    """users as problems, events as samples, purchases as successes."""
    s = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("c"))
    n, c = F.col("n"), F.col("c")
    p = s.select(stats.pass_at_k(n, c, 1).alias("p1"), stats.pass_at_k(n, c, 8).alias("p8"), (c > 0).cast("int").alias("any"))
    return p.agg(F.count("*").alias("problems"), F.round(F.avg("p1"), 6).alias("pass_1"), F.round(F.avg("p8"), 6).alias("pass_8"), F.round(F.avg("any"), 6).alias("oracle"), F.round(F.avg("p8") - F.avg("p1"), 6).alias("gap"))


@query("SELECT event_id, round(CASE WHEN sd > 1e-12 THEN (value - m) / sd ELSE 0 END, 4)::DOUBLE AS advantage FROM (SELECT event_id, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE)))")
def q_group_advantage(spark: SparkSession, d: str) -> DataFrame:
    """Rewards within a user's day."""
    events = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return events.select("event_id", F.round(stats.advantage(F.col("value"), "user_id", "day"), 4).alias("advantage"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS offset_ FROM events")
def q_curve_ffill(spark: SparkSession, d: str) -> DataFrame:
    """The latest sign-up's value carried forward within each user's stream."""
    events = table(spark, d, "events")
    return curves.filled(events, F.when(F.col("event_type") == "signup", F.col("value")), ["user_id"], "event_id", "offset_").select("event_id", "offset_")


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def q_last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    """E5, D14, M6."""
    return curves.last_write(table(spark, d, "events").select("user_id", "event_type", "event_id", "value", F.col("event_id").alias("o")), ["user_id", "event_type"], "o").select("user_id", "event_type", "event_id", "value")


@query("""WITH r AS (SELECT *, coalesce(sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run_id FROM events),
t AS (SELECT user_id, CAST(run_id AS BIGINT) AS run_id, count(*) AS rows, max(event_type = 'error') AS complete FROM r GROUP BY 1, 2)
SELECT user_id, run_id, rows, complete, complete AND rows = max(CASE WHEN complete THEN rows END) OVER (PARTITION BY user_id) AS full_ FROM t""")
def q_run_scope(spark: SparkSession, d: str) -> DataFrame:
    """Runs that end with an error event; a run is full if none of its user's complete ones is longer."""
    t = curves.runs(table(spark, d, "events"), F.col("event_type") == "error", ["user_id"], "event_id").groupBy("user_id", "run_id").agg(F.count("*").alias("rows"), F.max(F.col("event_type") == "error").alias("complete"))
    longest = F.max(F.when(F.col("complete"), F.col("rows"))).over(Window.partitionBy("user_id"))
    return t.withColumn("full_", F.when(F.col("complete"), F.col("rows") == longest).otherwise(False))


DAILY = "daily AS (SELECT event_type, CAST(ts AS DATE) AS day, (CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) * 100 // count(*)) / 10000.0::DOUBLE AS m FROM events GROUP BY 1, 2)"


def daily(spark: SparkSession, d: str) -> DataFrame:
    """Daily means, floored to 4 digits over whole hundredths, so that no order of adding changes them."""
    hundredths = F.sum(F.round(F.col("value") * 100).cast("bigint"))
    return table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(hundredths.alias("s"), F.count("*").alias("n")).select("event_type", "day", (F.expr("s * 100 div n") / 10000.0).alias("m"))


@query(f"""WITH {DAILY}, b AS (SELECT *, m < greatest(5.0, 0.95 * first_value(m) OVER w) AS below FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY day))
SELECT event_type, CAST(day AS VARCHAR) AS day, m, below, below AND coalesce(lag(below) OVER (PARTITION BY event_type ORDER BY day), false) AS fires FROM b""")
def q_streak_gate(spark: SparkSession, d: str) -> DataFrame:
    """G5, M5."""
    out = curves.streak_gate(daily(spark, d), "m", ["event_type"], "day", 5.0, 0.95)
    return out.select("event_type", F.col("day").cast("string").alias("day"), "m", "below", "fires")


@query(f"""WITH {DAILY}, b AS (SELECT event_type, day, m, max(m) OVER (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING) AS best FROM daily)
SELECT event_type, CAST(day AS VARCHAR) AS day, best, (SELECT CAST(min(x.day) AS VARCHAR) FROM daily x WHERE x.event_type = b.event_type AND x.m = b.best) AS best_at FROM b""")
def q_running_best(spark: SparkSession, d: str) -> DataFrame:
    """The best so far and the first day that reached it."""
    out = curves.running_best(daily(spark, d).withColumn("n", F.datediff("day", F.lit("1970-01-01"))), "m", ["event_type"], "n")
    return out.select("event_type", F.col("day").cast("string").alias("day"), "best", F.date_add(F.lit("1970-01-01").cast("date"), F.col("best_at")).cast("string").alias("best_at"))


@query(f"WITH {DAILY} SELECT event_type, CAST(day AS VARCHAR) AS day, m, round(avg(m) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS rolling FROM daily")
def q_rolling_check(spark: SparkSession, d: str) -> DataFrame:
    """F23 (from prose): each batch against the mean of the five before."""
    w = Window.partitionBy("event_type").orderBy("day").rowsBetween(-5, -1)
    return daily(spark, d).select("event_type", F.col("day").cast("string").alias("day"), "m", F.round(F.avg("m").over(w), 6).alias("rolling"))


@query("""WITH s AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY 1, 2), z AS (SELECT user_id, CASE WHEN stddev_pop(v) OVER w > 0 THEN (v - avg(v) OVER w) / stddev_pop(v) OVER w ELSE 0 END AS z FROM s WINDOW w AS (PARTITION BY event_type)),
m AS (SELECT user_id, avg(z) AS score, count(*) AS modules FROM z GROUP BY 1), r AS (SELECT user_id, score, modules, CAST(row_number() OVER (ORDER BY round_even(score, 9) DESC, user_id) AS INT) AS rank FROM m)
SELECT user_id, round(score, 6) AS score, modules, rank, rank <= 16 AS chosen FROM r""")
def q_layer_zscore_topk(spark: SparkSession, d: str) -> DataFrame:
    """Users as layers, kinds of events as modules."""
    s = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    return spectrum.layer_ranks(s, "user_id", "event_type", "v", 16).select("user_id", F.round("score", 6).alias("score"), "modules", "rank", "chosen")


@query()
def q_snr(spark: SparkSession, d: str) -> DataFrame:
    """Each label's embeddings as a matrix; singular values are no SQL."""
    return spectrum.snr_by_group(table(spark, d, "embeddings"), "label", "embedding").select(F.col("g").alias("label"), F.round("snr", 6).alias("snr"), "n_signal", F.round("edge", 6).alias("edge"))


@query("SELECT event_type, count(*) AS n, median(value) AS median, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def q_medians(spark: SparkSession, d: str) -> DataFrame:
    """Exact medians."""
    events = table(spark, d, "events").select("event_type", "value", "user_id")
    rest = events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.var_pop("value"), 4).alias("variance"), F.countDistinct("user_id").alias("users"))
    return rest.join(stats.medians(events, "event_type", "value"), "event_type").select("event_type", "n", "median", "mean", "variance", "users")


@query("SELECT o.o_orderkey, coalesce(c.c_mktsegment, 'none') AS segment, CASE WHEN c.c_custkey IS NULL THEN 'bare' WHEN c.c_acctbal < 0 THEN 'floor' ELSE 'full' END AS tier FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal < 5000")
def q_left_enrich(spark: SparkSession, d: str) -> DataFrame:
    """Optional enrichment picks a template."""
    some = table(spark, d, "customer").where("c_acctbal < 5000").select("c_custkey", "c_mktsegment", "c_acctbal")
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(some, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select("o_orderkey", F.coalesce("c_mktsegment", F.lit("none")).alias("segment"), F.when(F.col("c_custkey").isNull(), "bare").when(F.col("c_acctbal") < 0, "floor").otherwise("full").alias("tier"))


@query("SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R') AS returned FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity >= 50)")
def q_semi_anti_orders(spark: SparkSession, d: str) -> DataFrame:
    """An existence flag and an anti join in one aggregate of the large side."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max(F.col("l_returnflag") == "R").alias("r"), F.max(F.col("l_quantity") >= 50).alias("big"))
    rows = table(spark, d, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").where("not coalesce(big, false)")
    return rows.select("o_orderkey", F.coalesce("r", F.lit(False)).alias("returned"))


@query("""SELECT 'both' AS part, n FROM (SELECT DISTINCT c_nationkey AS n FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'customer_only', n FROM (SELECT DISTINCT c_nationkey AS n FROM customer EXCEPT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'neither', n FROM (SELECT n_nationkey AS n FROM nation EXCEPT SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)""")
def q_set_ops(spark: SparkSession, d: str) -> DataFrame:
    """I1-I6."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("n"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n"))
    all_ = table(spark, d, "nation").select(F.col("n_nationkey").alias("n"))
    named = lambda df, part: df.select(F.lit(part).alias("part"), "n")
    return named(c.intersect(s), "both").unionByName(named(c.distinct().subtract(s), "customer_only")).unionByName(named(all_.subtract(c).subtract(s), "neither"))


@query("""WITH k AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) AS r FROM lineitem)
SELECT k.l_partkey, p.p_brand, count(*) AS last_of FROM k JOIN part p ON k.l_partkey = p.p_partkey WHERE r = 1 GROUP BY 1, 2""")
def q_index_last_write(spark: SparkSession, d: str) -> DataFrame:
    """A hash index where the last row of a key wins, then an inner join."""
    last = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("l_partkey"))
    return last.join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_partkey", "p_brand").agg(F.count("*").alias("last_of"))


@query("""WITH h AS (SELECT embedding AS e FROM embeddings WHERE label = 0)
SELECT vec_id, round(max(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[]))), 4) AS nearest, max(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[]))) > 0.92 AS flagged FROM embeddings, h WHERE label <> 0 GROUP BY 1""")
def q_cosine_flag(spark: SparkSession, d: str) -> DataFrame:
    """E8 (from prose): cosine of every vector to the nearest held-out one (label 0). The held-out set is the stated set that all
    others meet in blocks."""
    from quarrymill.operators.nearest import nearest

    vectors = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    found = nearest(vectors.where("label <> 0"), vectors.where("label = 0"), "vec_id", "embedding")
    return found.select("vec_id", F.round("s", 4).alias("nearest"), (F.col("s") > 0.92).alias("flagged"))


@query("""SELECT epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def q_stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """Extension: the batch twin of streaming.windows.tumbling."""
    w = F.window("ts", "1 hour")
    return table(spark, d, "events").groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_timestamp("window.start").alias("start"), "event_type", "n", "total")


@query(f"WITH {JUDGED} SELECT lang, count(*) AS n, count(*) FILTER ((quality = 1) = (toxic = 0)) AS agree, count(*) FILTER (quality > 1 - toxic) AS wins, count(*) FILTER (quality < 1 - toxic) AS losses, round(avg(quality - (1 - toxic)), 6) AS delta, round(avg(quality - (1 - toxic)) / nullif(stddev_samp(quality - (1 - toxic)) / sqrt(count(*)), 0), 4) AS t FROM j GROUP BY 1")
def q_agreement(spark: SparkSession, d: str) -> DataFrame:
    """two verdicts on the same items: agreement, wins and losses, the paired difference and its t."""
    from quarrymill.functions.similarity import paired_t

    rows = judged(spark, d).withColumn("d", (F.col("quality") - (1 - F.col("toxic"))).cast("double"))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("d") == 0).alias("agree"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"), F.round(F.avg("d"), 6).alias("delta"), F.round(paired_t("d"), 4).alias("t"))


@query(f"WITH {JUDGED} SELECT doc_id, CAST(c AS INT) AS copy, CASE WHEN score <= 2 THEN 'reject' WHEN score >= 4 THEN 'accept' ELSE 'review' END AS route FROM (SELECT doc_id, 3 + quality - 2 * toxic AS score, unnest(range(1, 3 + quality - 2 * toxic)) AS c FROM j)")
def q_route_and_weigh(spark: SparkSession, d: str) -> DataFrame:
    """L2, L9 (from prose): a score routes a document, and a weight drops or repeats it."""
    from quarrymill.operators import release

    rows = judged(spark, d).withColumn("score", 3 + F.col("quality") - 2 * F.col("toxic"))
    return release.weighted(rows, F.col("score") - 1).select("doc_id", "copy", release.routed(F.col("score")).alias("route"))


@query("SELECT conv_id, turn, CAST(floor(coalesce(sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 256) AS BIGINT) AS win, CAST(floor(conv_id / 32) AS BIGINT) AS chunk FROM conversations")
def q_token_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of characters within a conversation, and batches of 32."""
    from quarrymill.operators import release

    rows = table(spark, d, "conversations").withColumn("size", F.length(F.coalesce("text", F.lit(""))))
    return release.token_windows(rows, "conv_id", "turn", "size", 256).select("conv_id", "turn", F.col("window").alias("win"), release.chunks(F.col("conv_id")).alias("chunk"))


@query("SELECT props, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1")
def q_duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    """E4, K1."""
    from quarrymill.operators import release

    return release.duplicate_ids(table(spark, d, "events"), "props")


@query("""SELECT 'customer' AS side, k AS nation FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal < 0)
UNION ALL SELECT 'supplier', k FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)""")
def q_missing_keys(spark: SparkSession, d: str) -> DataFrame:
    """D12, D13, I6."""
    from quarrymill.operators import release

    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"))
    c = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("nation"))
    s = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("nation"))
    return release.missing_keys(nations, c, "nation").select(F.lit("customer").alias("side"), "nation").unionByName(release.missing_keys(nations, s, "nation").select(F.lit("supplier").alias("side"), "nation"))


@query()
def q_credibility_rank(spark: SparkSession, d: str) -> DataFrame:
    """S11 (from prose): ranks over the links of customers and the priorities of their orders."""
    from quarrymill.operators.graphs import pagerank

    edges = table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("a"), F.col("o_orderpriority").alias("b"))
    return pagerank(edges).select("node", F.round("rank", 6).alias("rank"))


@query("SELECT label, count(*) AS n, round(sum(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 3) AS energy FROM embeddings GROUP BY 1")
def q_energy(spark: SparkSession, d: str) -> DataFrame:
    """F15's sum over vectors, JVM-side."""
    e = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(e), 3).alias("energy"))
