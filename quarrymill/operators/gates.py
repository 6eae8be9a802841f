"""Ordered gates that name the reason a row is rejected for, existence flags against key sets, and the funnel."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.text import norm_code


def first_reason(gates: Iterable[tuple[str, Column]]) -> Column:
    """The name of the first gate that rejects, null if none does. A null condition doesn't reject."""
    out = None
    for name, rejects in gates:
        out = F.when(F.coalesce(rejects, F.lit(False)), name) if out is None else out.when(F.coalesce(rejects, F.lit(False)), name)
    return out if out is not None else F.lit(None).cast("string")


def gated(df: DataFrame, gates: Iterable[tuple[str, Column]], reason_col: str = "reject_reason") -> DataFrame:
    """All rows with the reason of the first gate that rejects them. Pool and rejects are two filters over it."""
    return df.withColumn(reason_col, first_reason(gates))


def flagged(df: DataFrame, keys: DataFrame, on: str, flag: str, small: bool = False) -> DataFrame:
    """Df with a flag that says whether its key occurs in `keys` (one column). Null keys never do, and never give a null
    flag. Keys known to be few may be broadcast; otherwise the plan decides by their size."""
    key = keys.columns[0]
    right = keys.select(F.col(key).alias("_key")).where("_key is not null").distinct().withColumn("_there", F.lit(True))
    right = F.broadcast(right) if small else right
    return df.join(right, df[on] == right["_key"], "left").withColumn(flag, F.coalesce("_there", F.lit(False))).drop("_key", "_there")


def reasons(*flags: tuple[str, Column]) -> Column:
    """All surfaces on which a row is hit, in order."""
    return F.filter(F.array(*[F.when(hit, name) for name, hit in flags]), lambda x: x.isNotNull())


def funnel(df: DataFrame, stage_col: str, reason_col: str = "reject_reason", n_col: str | None = None) -> DataFrame:
    """(stage, reason, delta): rows in, minus those each reason took, and those kept; a stage's deltas close to zero. `n_col`:
    how many rows a row stands for. One pass; what came in is added up from the counts by stage and reason."""
    n = F.sum(n_col) if n_col else F.count("*")
    counted = df.groupBy(F.col(stage_col).alias("stage"), F.coalesce(F.col(reason_col), F.lit("-> pool")).alias("reason")).agg(n.alias("n")).where("n > 0")
    rows = F.collect_list(F.struct("reason", (-F.col("n")).alias("delta")))
    every = counted.groupBy("stage").agg(F.concat(F.array(F.struct(F.lit("in").alias("reason"), F.sum("n").alias("delta"))), rows).alias("rows"))
    return every.select("stage", F.inline("rows"))


#: C1-C10 by name: what rejects a row, over columns that the caller names. A blank text counts as missing.
def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def empty_target(target: Column) -> tuple[str, Column]:
    return "empty_target", blank(target)


def null_source_field(*fields: Column) -> tuple[str, Column]:
    return "null_source_field", reduce(lambda a, b: a | b, [f.isNull() for f in fields])


def license_not_permissive(name: Column, allowed: list[str]) -> tuple[str, Column]:
    return "license_not_permissive", ~F.coalesce(F.upper(F.trim(name)).isin(*[a.upper() for a in allowed]), F.lit(False))


def eval_denylist(denied: Column) -> tuple[str, Column]:
    return "eval_denylist", denied


def holdout_leak(leaks: Column) -> tuple[str, Column]:
    return "holdout_leak", leaks


def chosen_equals_rejected(chosen: Column, rejected: Column) -> tuple[str, Column]:
    """Equal after norm_code, so comments and blanks make no difference."""
    return "chosen_equals_rejected", norm_code(chosen) == norm_code(rejected)


def below_test_count_cutoff(tests: Column, least: int) -> tuple[str, Column]:
    return "below_test_count_cutoff", F.coalesce(tests, F.lit(-1)) < least


def empty_source_or_target(source: Column, target: Column) -> tuple[str, Column]:
    return "empty_source_or_target", blank(source) | blank(target)


def gate_not_round_trip_passed(stage: Column, passed: str) -> tuple[str, Column]:
    return "gate_not_round_trip_passed", ~F.coalesce(stage == passed, F.lit(False))


def no_work_join_no_test_signal(joined: Column) -> tuple[str, Column]:
    return "no_work_join_no_test_signal", ~F.coalesce(joined, F.lit(False))


def code_graded(gate_class: Column, classes: tuple[str, ...] = ("behavioral", "compile_project", "compile_only")) -> Column:
    """Whether a row is graded as code; others are counted apart as prose."""
    return F.coalesce(gate_class.isin(*classes), F.lit(False))


def checked(df: DataFrame, condition: Column, what: str) -> DataFrame:
    """K1-K5: df unless some row breaks the condition, when running it fails and says what is wrong."""
    bad = F.when(~F.coalesce(condition, F.lit(False)), F.raise_error(F.lit(what)).cast("boolean")).otherwise(True)
    return df.where(bad)
