"""Curation queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.base import cut
from quarrymill.functions import text as X
from quarrymill.operators import dedup, gates, split

QUERIES: dict = {}
SQL: dict[str, str] = {}

WS = X.WS_RE2
NORM = f"trim(regexp_replace(regexp_replace(coalesce(text, ''), '#[^\\n]*', '', 'g'), '{WS}+', ' ', 'g'))"
NORM_TEXT = f"lower(trim(regexp_replace(coalesce(text, ''), '{WS}+', ' ', 'g')))"
#: Licenses that may be trained on.
PERMISSIVE = ("APACHE", "MIT", "BSD", "ISC", "CC0")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query(f"SELECT doc_id, sha1({NORM}) AS norm_hash, sha1(coalesce(text, '')) AS text_hash, sha1(concat(coalesce(lang, ''), chr(0), {NORM})) AS content_key FROM documents")
def q_norm_hash(spark: SparkSession, d: str) -> DataFrame:
    """B1, B2, B3."""
    docs = table(spark, d, "documents")
    norm = X.norm_code("text")
    return docs.select("doc_id", X.chash(norm).alias("norm_hash"), X.chash("text").alias("text_hash"), X.content_key(F.coalesce("lang", F.lit("")), norm).alias("content_key"))


LICENSE_SQL = "upper(regexp_extract(coalesce(text, ''), '(?i)(?:licensed under(?: the)?|released under the) ([A-Za-z0-9 .\\-]*?)(?: Public)?(?: License|,|\\.$|\\.\\n)', 1))"
ALLOWED_SQL = "(lic = '' OR " + " OR ".join(f"lic LIKE '{p}%'" for p in PERMISSIVE) + ")"


def allowed(name) -> F.Column:
    ok = name == ""
    for p in PERMISSIVE:
        ok = ok | name.startswith(p)
    return ok


@query(f"SELECT lic AS license, {ALLOWED_SQL} AS allowed, count(*) AS n FROM (SELECT {LICENSE_SQL} AS lic FROM documents) GROUP BY 1, 2")
def q_license_gate(spark: SparkSession, d: str) -> DataFrame:
    """C3 over a license lifted by B17's kind of pattern; blank counts as allowed here as these texts mostly have no line."""
    return table(spark, d, "documents").select(X.license_line("text").alias("license")).groupBy("license", allowed(F.col("license")).alias("allowed")).agg(F.count("*").alias("n"))


REASONS_SQL = f"""
held AS (SELECT DISTINCT sha1({NORM_TEXT}) AS h FROM benchmark),
lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
base AS (SELECT d.*, {LICENSE_SQL} AS lic, {NORM} AS norm, sha1({NORM_TEXT}) AS h FROM documents d),
gated AS (SELECT base.doc_id, base.source, base.lang, base.norm, CASE
  WHEN norm = '' THEN 'empty_target' WHEN n_chars < 20 THEN 'below_length_cutoff' WHEN NOT {ALLOWED_SQL} THEN 'license_not_permissive'
  WHEN held.h IS NOT NULL THEN 'holdout_leak' WHEN lab.doc_id IS NULL THEN 'no_signal' WHEN lab.quality = 0 THEN 'low_quality' WHEN lab.toxic = 1 THEN 'toxic' END AS reject_reason
  FROM base LEFT JOIN held ON base.h = held.h LEFT JOIN lab ON base.doc_id = lab.doc_id)"""


def gated_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their reject_reason, gates in order: C1, C7, C3, C5, C10, then the labels'."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars", X.norm_code("text").alias("norm"), X.license_line("text").alias("lic"), X.chash(X.norm_text("text")).alias("h"))
    held = table(spark, d, "benchmark").select(X.chash(X.norm_text("text")).alias("key"))
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"), F.lit(True).alias("known"))
    docs = gates.flagged(docs, held, "h", "leaks").join(labels, "doc_id", "left")
    return gates.gated(docs, [
        ("empty_target", F.col("norm") == ""), ("below_length_cutoff", F.col("n_chars") < 20), ("license_not_permissive", ~allowed(F.col("lic"))),
        ("holdout_leak", F.col("leaks")), ("no_signal", F.col("known").isNull()), ("low_quality", F.col("quality") == 0), ("toxic", F.col("toxic") == 1),
    ])


@query(f"WITH {REASONS_SQL} SELECT source, coalesce(reject_reason, 'kept') AS reason, count(*) AS n FROM gated GROUP BY 1, 2")
def q_gate_reasons(spark: SparkSession, d: str) -> DataFrame:
    """C1-C10, F1."""
    return gated_documents(spark, d).groupBy("source", F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {REASONS_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, sha1(norm) ORDER BY CAST(replace(source, 'src', '') AS INT), doc_id) AS r FROM gated WHERE reject_reason IS NULL),
every AS (SELECT source, reject_reason AS reason, count(*) AS n FROM gated WHERE reject_reason IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT source, CASE WHEN r > 1 THEN 'global_duplicate_content' ELSE '-> pool' END, count(*) FROM ranked GROUP BY 1, 2)
SELECT source AS stage, 'in' AS reason, CAST(sum(n) AS BIGINT) AS delta FROM every GROUP BY 1 UNION ALL SELECT source, reason, -n FROM every""")
def q_curation_funnel(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: gates, priority deduplication (E3), and a funnel that closes (F2, K10). Texts are read and gated once; rows that
    pass are folded by key and source before the shuffle, so a key with a third of all rows is a row a source and task."""
    gated = gated_documents(spark, d).select("doc_id", "source", "lang", X.chash("norm").alias("h"), "reject_reason")
    order = F.struct(F.regexp_replace("source", "src", "").cast("int").alias("p"), "doc_id")
    passed = F.col("reject_reason").isNull()
    own = cut(gated.groupBy("source", "reject_reason", F.when(passed, F.col("lang")).alias("lang"), F.when(passed, F.col("h")).alias("h")).agg(F.count("*").alias("n"), F.min(order).alias("best")))
    winner = own.where("reject_reason is null").groupBy("lang", "h").agg(F.min("best").alias("w")).withColumnsRenamed({"lang": "wl", "h": "wh"})
    out = own.join(winner, (F.col("h") == F.col("wh")) & F.col("lang").eqNullSafe(F.col("wl")), "left")
    wins = (passed & (F.col("best") == F.col("w"))).cast("int")
    kinds = F.array(F.struct(F.col("reject_reason").alias("r"), F.when(passed, wins).otherwise(F.col("n")).cast("bigint").alias("n")), F.struct(F.lit("global_duplicate_content").alias("r"), F.when(passed, F.col("n") - wins).otherwise(0).cast("bigint").alias("n")))
    return gates.funnel(out.select("source", F.inline(kinds)), "source", "r", "n")


@query(f"SELECT min(doc_id) AS doc_id, h, count(*) AS copies FROM (SELECT doc_id, sha1({NORM}) AS h FROM documents) GROUP BY h")
def q_dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each content hash, and how many there are."""
    docs = table(spark, d, "documents").select("doc_id", X.chash(X.norm_code("text")).alias("h"))
    return docs.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "h", "copies")


@query(f"""SELECT doc_id, lang, source FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, sha1({NORM}) ORDER BY CAST(replace(source, 'src', '') AS INT), doc_id) AS r FROM documents) WHERE r = 1""")
def q_dedup_priority(spark: SparkSession, d: str) -> DataFrame:
    """E3."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", X.content_key(F.coalesce("lang", F.lit("")), X.norm_code("text")).alias("k"))
    return dedup.keep_first(docs, [F.col("k")], F.struct(F.regexp_replace("source", "src", "").cast("int").alias("p"), "doc_id")).select("doc_id", "lang", "source")


@query()
def q_dedup_greedy_or(spark: SparkSession, d: str) -> DataFrame:
    """Greedy by (source, length) or content hash; no SQL, as what is kept depends on what was kept before."""
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", "n_chars").alias("a"), X.chash(X.norm_code("text")).alias("b"))
    return dedup.greedy_two_keys(docs, "doc_id", "a", "b").select("doc_id")


@query("SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def q_no_signal_anti(spark: SparkSession, d: str) -> DataFrame:
    """D4, D7, C10."""
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query(f"""WITH held AS (SELECT DISTINCT sha1({NORM_TEXT}) AS h FROM benchmark), ids AS (SELECT DISTINCT item_id FROM benchmark),
first_lines AS (SELECT DISTINCT lower(trim(split_part(text, '.', 1))) AS f FROM benchmark)
SELECT doc_id, concat_ws(',', CASE WHEN h IN (SELECT h FROM held) THEN 'content' END, CASE WHEN doc_id IN (SELECT item_id FROM ids) THEN 'id' END, CASE WHEN f IN (SELECT f FROM first_lines) THEN 'first_sentence' END) AS reasons
FROM (SELECT doc_id, sha1({NORM_TEXT}) AS h, lower(trim(split_part(coalesce(text, ''), '.', 1))) AS f FROM documents)""")
def q_holdout_surfaces(spark: SparkSession, d: str) -> DataFrame:
    """On which surfaces a document meets the held-out items; a row may hit several."""
    held = table(spark, d, "benchmark")
    first = F.lower(F.trim(F.split_part(F.coalesce("text", F.lit("")), F.lit("."), F.lit(1))))
    docs = table(spark, d, "documents").select("doc_id", X.chash(X.norm_text("text")).alias("h"), first.alias("f"))
    for on, keys, flag in (("h", held.select(X.chash(X.norm_text("text")).alias("k")), "content"), ("doc_id", held.select("item_id"), "id"), ("f", held.select(first.alias("k")), "sentence")):
        docs = gates.flagged(docs, keys, on, flag)
    hit = gates.reasons(("content", F.col("content")), ("id", F.col("id")), ("first_sentence", F.col("sentence")))
    return docs.select("doc_id", F.array_join(hit, ",").alias("reasons"))


SPLIT = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"


@query(f"""WITH h AS (SELECT {SPLIT} AS w FROM benchmark), keys AS (SELECT DISTINCT array_to_string(w[i:i+13], ' ') AS s FROM (SELECT w, unnest(range(1, len(w) - 12)) AS i FROM h)),
d AS (SELECT doc_id, {SPLIT} AS w FROM documents), own AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+13], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 12)) AS i FROM d))
SELECT doc_id, CAST(count(keys.s) AS INT) AS shared, CAST(count(*) AS INT) AS total, count(keys.s) > 0.5 * count(*) AS flagged FROM own LEFT JOIN keys ON own.s = keys.s GROUP BY 1 HAVING count(keys.s) > 0""")
def q_shingle_contamination(spark: SparkSession, d: str) -> DataFrame:
    """E6 (from prose): documents that share 14-word shingles with held-out items; flagged over one half."""
    def words(df: DataFrame) -> F.Column:
        return F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[ \t\n\x0B\f\r]+"), lambda x: x != "")

    docs, held = table(spark, d, "documents"), table(spark, d, "benchmark")
    found = dedup.contamination(docs.select("doc_id", words(docs).alias("words")), held.select(words(held).alias("words")))
    return found.withColumn("flagged", F.col("shared") > 0.5 * F.col("total"))


LINES = "regexp_split_to_array(coalesce(text, ''), '\\n')"


@query(f"""SELECT doc_id, round(list_avg(list_transform({LINES}, lambda x: length(x))), 6) AS avg_line, CAST(list_max(list_transform({LINES}, lambda x: length(x))) AS INT) AS max_line,
round(length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) / greatest(length(coalesce(text, '')), 1), 6) AS alpha FROM documents""")
def q_structural_filter(spark: SparkSession, d: str) -> DataFrame:
    """L1 (from prose): line lengths and share of letters."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(x))
    total = F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + x)
    alpha = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")) / F.greatest(F.length(F.coalesce("text", F.lit(""))), F.lit(1))
    return table(spark, d, "documents").select("doc_id", F.round(total / F.size(lines), 6).alias("avg_line"), F.array_max(lines).alias("max_line"), F.round(alpha, 6).alias("alpha"))


@query(f"""WITH t AS (SELECT lang, array_to_string(w[i:i+2], ' ') AS g FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT lang, {SPLIT} AS w FROM documents))),
c AS (SELECT lang, g, count(*) AS n FROM t GROUP BY 1, 2), s AS (SELECT lang, sum(n) AS total, count(*) AS kinds FROM c GROUP BY 1)
SELECT c.lang, CAST(any_value(kinds) AS BIGINT) AS kinds, round(-sum(n / total * ln(n / total)) / greatest(ln(any_value(total)), 1e-9), 4) AS entropy FROM c JOIN s ON c.lang = s.lang GROUP BY 1""")
def q_trigram_entropy(spark: SparkSession, d: str) -> DataFrame:
    """F22 (from prose): normalised entropy of word trigrams by language."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[ \t\n\x0B\f\r]+"), lambda x: x != "")
    grams = F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.array_join(F.slice("w", i, 3), " ")))
    count = table(spark, d, "documents").select("lang", words.alias("w")).select("lang", F.explode(grams).alias("g")).groupBy("lang", "g").agg(F.count("*").alias("n"))
    # -sum(p ln p) = ln N - sum(n ln n) / N: one pass, no join of totals
    total = F.sum("n")
    return count.groupBy("lang").agg(F.count("*").alias("kinds"), F.round((F.log(total) - F.sum(F.col("n") * F.log("n")) / total) / F.greatest(F.log(total), F.lit(1e-9)), 4).alias("entropy"))


@query("""WITH t(lang, target) AS (VALUES ('en', 0.55), ('de', 0.2), ('fr', 0.15), ('es', 0.1)), c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), s AS (SELECT sum(n) AS total FROM c)
SELECT t.lang, coalesce(n, 0) AS n, round(coalesce(n, 0) / total, 6) AS share, round(target * 1.0, 6)::DOUBLE AS target, abs(coalesce(n, 0) / total - target) <= 0.05 AS within FROM t LEFT JOIN c ON t.lang = c.lang, s""")
def q_balance_check(spark: SparkSession, d: str) -> DataFrame:
    """F22, F24 (from prose): shares of bands against targets with a tolerance."""
    target = spark.createDataFrame([("en", 0.55), ("de", 0.2), ("fr", 0.15), ("es", 0.1)], "lang string, target double")
    docs = table(spark, d, "documents")
    total = docs.count()
    joined = target.join(docs.groupBy("lang").agg(F.count("*").alias("n")), "lang", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = F.col("n") / F.lit(max(total, 1))
    return joined.select("lang", "n", F.round(share, 6).alias("share"), "target", (F.abs(share - F.col("target")) <= 0.05).alias("within"))


@query("""SELECT conv_id, count(*) AS turns, max(turn) AS last_turn, min(CASE WHEN role = 'user' THEN turn END) AS first_user, arg_max(text, turn) AS answer, count(*) FILTER (role = 'assistant' AND trim(coalesce(text, '')) <> '') AS replies
FROM conversations GROUP BY 1""")
def q_prompt_answer_extract(spark: SparkSession, d: str) -> DataFrame:
    """B21's reading side: a conversation's last message by position; aggregated before the shuffle, no lists of messages."""
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.max("turn").alias("last_turn"), F.min(F.when(F.col("role") == "user", F.col("turn"))).alias("first_user"),
        F.max_by("text", "turn").alias("answer"), F.count_if((F.col("role") == "assistant") & (F.trim(F.coalesce("text", F.lit(""))) != "")).alias("replies"),
    )


@query("""SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS answer FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant' AND trim(u.text) <> '' AND trim(a.text) <> '' AND u.text <> a.text""")
def q_chat_release(spark: SparkSession, d: str) -> DataFrame:
    """Released pairs of a prompt and the answer that follows it, neither blank, not equal."""
    conv = table(spark, d, "conversations")
    asked = conv.where("role = 'user' and trim(text) <> ''").select("conv_id", "turn", F.col("text").alias("prompt"))
    said = conv.where("role = 'assistant' and trim(text) <> ''").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(said, ["conv_id", "turn"]).where("prompt <> answer").select("conv_id", "turn", "prompt", "answer")


@query(f"SELECT conv_id, turn, len({SPLIT}) AS approx_tokens, len({SPLIT}) >= 60 AS dropped FROM conversations")
def q_prompt_length_guard(spark: SparkSession, d: str) -> DataFrame:
    """C13 by a stand-in: words between blanks, not a tokenizer's tokens."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[ \t\n\x0B\f\r]+"), lambda x: x != "")
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(words).cast("long").alias("approx_tokens"), (F.size(words) >= 60).alias("dropped"))


@query("WITH n AS (SELECT count(*) AS n FROM documents), t AS (SELECT greatest(least(CAST(round_even(n * 0.85, 0) AS BIGINT), n - 1), 1) AS train, n FROM n) SELECT 'train' AS split, train AS n FROM t UNION ALL SELECT 'valid', n - train FROM t")
def q_split_sizes(spark: SparkSession, d: str) -> DataFrame:
    """H4: an exact 85/15 split; members follow from a hash of the id, sizes are the reference's."""
    return split.exact_split(table(spark, d, "documents").select("doc_id"), "doc_id", 0.85).groupBy("split").agg(F.count("*").alias("n"))


DRAW = "CAST(('0x' || substring(md5('42:' || doc_id), 1, 12)) AS BIGINT)"


@query(f"""SELECT doc_id, CASE WHEN i <= round_even(n * 0.9, 0) THEN 'train' WHEN i <= round_even(n * 0.9500000000000001, 0) THEN 'valid' ELSE 'test' END AS split
FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY {DRAW}, doc_id) AS i, count(*) OVER (PARTITION BY lang, source) AS n FROM documents)""")
def q_split_stratified(spark: SparkSession, d: str) -> DataFrame:
    """H9 (from prose)."""
    return split.stratified(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id", ["lang", "source"]).select("doc_id", "split")


@query("SELECT doc_id FROM documents WHERE doc_id % 40 IN (0, 1)")
def q_systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    """The sampling operator itself."""
    return split.systematic(table(spark, d, "documents").select("doc_id"), "doc_id")


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100")
def q_first_n(spark: SparkSession, d: str) -> DataFrame:
    """A11, H2."""
    return split.first_n(table(spark, d, "documents").select("doc_id", "source"), "doc_id", 100)


@query(f"SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY {DRAW}, doc_id LIMIT 50)")
def q_replay_sample(spark: SparkSession, d: str) -> DataFrame:
    """H6, H7: exactly k rows without replacement."""
    return split.sample_k(table(spark, d, "documents").select("doc_id"), "doc_id", 50)


CUT = "CAST(floor(length(text) * (0.2 + 0.4 * (CAST(('0x' || substring(md5('fim:' || doc_id), 1, 12)) AS BIGINT) / 281474976710656.0))) AS INT)"


@query(f"SELECT doc_id, cut, length(text) - cut AS rest, md5(left(text, cut)) AS prefix_md5 FROM (SELECT doc_id, coalesce(text, '') AS text, {CUT} AS cut FROM documents)")
def q_fim_cut(spark: SparkSession, d: str) -> DataFrame:
    """L6, H8 (from prose): each text cut at a share drawn from its id."""
    text = F.coalesce("text", F.lit(""))
    cut = F.floor(F.length(text) * (F.lit(0.2) + F.lit(0.4) * split.draw(F.col("doc_id"), "fim"))).cast("int")
    docs = table(spark, d, "documents").select("doc_id", text.alias("text"), cut.alias("cut"))
    return docs.select("doc_id", "cut", (F.length("text") - F.col("cut")).cast("long").alias("rest"), F.md5(F.expr("left(text, cut)").cast("binary")).alias("prefix_md5"))


@query(f"SELECT a.doc_id AS chosen, b.doc_id AS rejected, a.lang FROM (SELECT doc_id, lang, source, sha1({NORM}) AS h FROM documents) a JOIN (SELECT min(doc_id) AS doc_id, h FROM (SELECT doc_id, sha1({NORM}) AS h FROM documents) GROUP BY h) f ON a.h = f.h JOIN documents b ON b.doc_id = f.doc_id WHERE a.doc_id <> b.doc_id AND a.source <> b.source")
def q_seam_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Copies across sources, each paired with the first of its content, not with each other."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", X.chash(X.norm_code("text")).alias("h"))
    first = docs.groupBy("h").agg(F.min(F.struct("doc_id", "source")).alias("f"))
    pairs = docs.join(first, "h").where("doc_id <> f.doc_id and source <> f.source")
    return pairs.select(F.col("doc_id").alias("chosen"), F.col("f.doc_id").alias("rejected"), "lang")


@query("SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, len(regexp_extract_all(html, '<a href=')) AS links, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages")
def q_page_lift(spark: SparkSession, d: str) -> DataFrame:
    """B17, B26 on pages: structure lifted from text by patterns."""
    pages = table(spark, d, "pages")
    return pages.select("page_id", F.regexp_extract("url", "^(https?)://", 1).alias("scheme"), F.lower(F.regexp_extract("url", "^https?://([^/?#]+)", 1)).alias("host"), F.regexp_count("html", F.lit("<a href=")).cast("long").alias("links"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"))
