"""Release steps: lookups that must hit, templates, truncation, routing, weights, windows of tokens, and checks between key sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.operators.split import draw


def lookup(key: Column, mapping: dict[str, str], what: str) -> Column:
    """A key's value in a fixed mapping; a key that is missing fails the query."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(pairs[key], F.raise_error(F.concat(F.lit(f"no {what} for "), F.coalesce(key, F.lit("null")))))


def operations_prompt(entity: Column, operations: Column, tag: Column) -> Column:
    """An instruction from an entity and a map of operation to handler, operations in a fixed order, absent ones left out."""
    lines = [F.when(F.map_contains_key(operations, op), F.concat(F.lit(f"- {op}: "), operations[op])) for op in ("create", "list", "update", "delete")]
    return F.concat_ws("\n", F.concat(F.lit("Write handlers for "), entity), *lines, F.when(tag.isNotNull(), F.concat(F.lit("- tag field: "), tag)))


def sections(first: Column, second: Column) -> Column:
    """Two trimmed sections, a blank line between."""
    return F.concat(F.regexp_replace(first, r"\s+$", ""), F.lit("\n\n"), F.regexp_replace(second, r"^\s+|\s+$", ""))


def head(c: Column, n: int) -> Column:
    """The first n characters."""
    return F.substring(c, 1, n)


def tail(c: Column, n: int) -> Column:
    """The last n characters."""
    return F.right(c, F.lit(n))


def answer_lengths(generated: Column, extracted: Column) -> dict[str, Column]:
    """B22."""
    return {"gen_len": F.length(generated), "extracted_len": F.length(extracted), "fenced": generated.contains("```")}


def task_of(id_: Column, prefixes: dict[str, str], otherwise: str) -> Column:
    """A task by the prefix of its id."""
    out = F.lit(otherwise)
    for prefix, task in prefixes.items():
        out = F.when(id_.startswith(prefix), task).otherwise(out)
    return out


def decoded_step(step: Column) -> tuple[Column, Column]:
    """(step, scope): full evaluations stored a million (last) or half a million (best) ahead."""
    scope = F.when(step >= 1_000_000, "last").when(step >= 500_000, "best").otherwise("snapshot")
    return F.when(step >= 1_000_000, step - 1_000_000).when(step >= 500_000, step - 500_000).otherwise(step), scope


def static_features(code: Column) -> dict[str, Column]:
    """Constructs that occur in a piece of code."""
    return {"return_type": code.rlike(r"\)\s*->"), "union_type": code.rlike(r"\w\s*\|\s*\w"), "isinstance_": code.contains("isinstance("), "match_": code.rlike(r"(?m)^\s*match\s"), "lambda_": code.rlike(r"\blambda\b")}


def routed(score: Column) -> Column:
    """L2 (from prose): at most 2 rejected, 3 reviewed, 4 and more accepted; no score is reviewed."""
    return F.when(score <= 2, "reject").when(score >= 4, "accept").otherwise("review")


def weighted(df: DataFrame, weight: Column) -> DataFrame:
    """L9 (from prose): each row as often as its weight says: 0 drops it, 1 keeps it, more repeat it."""
    return df.withColumn("copy", F.explode(F.when(weight > 0, F.sequence(F.lit(1), F.greatest(weight, F.lit(1)))).otherwise(F.array().cast("array<int>"))))


def bounded_slice(df: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    """L7 (from prose): at most so many rows of each class; the cap is the feature."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def token_windows(df: DataFrame, by: str, order: str, tokens: str, width: int = 4096) -> DataFrame:
    """L10 (from prose): the window in which each row's first token falls when a class's rows follow each other."""
    before = F.coalesce(F.sum(tokens).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("window", F.floor(before / width).cast("long"))


def chunks(ordinal: Column, size: int = 32) -> Column:
    """The batch a row falls in, in file order."""
    return F.floor(ordinal / size).cast("long")


def grid(a: DataFrame, b: DataFrame, most: int = 10_000) -> DataFrame:
    """All combinations of two tiny frames, for a report; an error if they aren't tiny."""
    left, right = a.limit(most + 1).collect(), b.limit(most + 1).collect()
    if len(left) * len(right) > most:
        raise ValueError(f"over {most} combinations")
    spark, schema = a.sparkSession, a.schema.fields + b.schema.fields
    from pyspark.sql.types import StructType

    return spark.createDataFrame([(*x, *y) for x in left for y in right], StructType(schema))


def missing_keys(have: DataFrame, want: DataFrame, key: str) -> DataFrame:
    """Keys of `have` that `want` lacks; a subset gives none."""
    return have.select(key).distinct().join(want.select(key), key, "left_anti")


def same_keys(a: DataFrame, b: DataFrame, key: str) -> bool:
    """D13."""
    return missing_keys(a, b, key).isEmpty() and missing_keys(b, a, key).isEmpty()


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """Ids that occur more than once, and how often."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def numeric_ids(df: DataFrame, by: str, id_: str) -> DataFrame:
    """How many ids of each source could be meant by a list of numbers."""
    return df.groupBy(by).agg(F.count_if(F.col(id_).try_cast("bigint").isNotNull()).alias("numeric"), F.count("*").alias("n"))


def with_overall(parts: DataFrame, series: str, step: str, sums: list[str], name: str = "OVERALL") -> DataFrame:
    """a step's parts, and a row that adds them up."""
    whole = parts.groupBy(step).agg(*[F.sum(c).cast("bigint").alias(c) for c in sums]).withColumn(series, F.lit(name))
    return parts.select(series, step, *sums).unionByName(whole.select(series, step, *sums))


def sizes_differ(parts: list[DataFrame], whole: DataFrame) -> DataFrame:
    """A row if the parts' sizes don't add up to the whole's; none if they do."""
    rows = [p.agg(F.count("*").alias("n")) for p in parts] + [whole.agg((-F.count("*")).alias("n"))]
    return reduce(DataFrame.unionByName, rows).agg(F.sum("n").alias("off")).where("off <> 0")


def too_few(df: DataFrame, least: int) -> DataFrame:
    """A row if there are fewer rows than a run that did its work gives."""
    return df.agg(F.count("*").alias("n")).where(F.col("n") < least)


def all_zero(df: DataFrame, by: str, value: str) -> DataFrame:
    """Artifacts of which every value is 0 or null."""
    return df.groupBy(by).agg(F.max(F.abs(F.coalesce(F.col(value), F.lit(0)))).alias("most")).where("most = 0")


def checks(bad: dict[str, DataFrame]) -> DataFrame:
    """(check_name, bad): for each check how many rows its frame of offenders has."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("bad")).select(F.lit(name).alias("check_name"), "bad") for name, df in bad.items()])


def refused(found: DataFrame) -> DataFrame:
    """Checks of which none is broken; running it fails otherwise and names the first."""
    return found.where(F.when(F.col("bad") > 0, F.raise_error(F.concat(F.col("check_name"), F.lit(" does not hold"))).cast("boolean")).otherwise(True))


def token_accounting(rows: DataFrame, by: list[str], tokens: str, correct: Column) -> DataFrame:
    """L11 (from prose): rows, tokens, correct rows and tokens a correct row, by generator and recipe."""
    out = rows.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(tokens).cast("bigint").alias("tokens"), F.count_if(correct).alias("correct"))
    return out.withColumn("tokens_to_correct", F.round(F.col("tokens") / F.when(F.col("correct") > 0, F.col("correct")), 4))


def coverage(counts: DataFrame, n: str, least: float) -> DataFrame:
    """L3 (from prose): each domain's share, and whether it has the least share. counts: a row a domain."""
    total = counts.agg(F.sum(n).alias("_total"))
    return counts.join(F.broadcast(total), F.lit(True)).withColumn("share", F.round(F.col(n) / F.col("_total"), 6)).withColumn("covered", F.col(n) / F.col("_total") >= least).drop("_total")


def documented(code: Column) -> dict[str, Column]:
    """L12 (from prose): whether a piece of code returns a value, and whether it says in words what it does."""
    return {"returns": code.rlike(r"(?m)^[ \t]*return[ \t]+[^;\s]"), "docstring": code.rlike(r'(?s)"""\s*\S.{9,}?"""|(?m)^[ \t]*#[ \t]*\S.{9,}$')}


def fim(text: Column, cut: Column, end: Column, key: Column, share: float = 0.5) -> Column:
    """L6 (from prose): prefix, suffix and middle behind their marks, for a share of the rows that their key draws; others as they are."""
    marked = F.concat(F.lit("<PRE>"), F.substring(text, F.lit(1), cut), F.lit("<SUF>"), F.substring(text, end + 1, F.length(text)), F.lit("<MID>"), F.substring(text, cut + 1, end - cut))
    return F.when(draw(key, "fim") < share, marked).otherwise(text)
