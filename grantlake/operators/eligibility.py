"""Eligibility: four axes and the program rules, each three-valued, then reasons and buckets.

Unknown never rejects: a criterion that can't be checked gives ``review``. Every function is a column
over a row that holds a record and a profile, so one profile or many are evaluated in the same scan. The
clock is a parameter.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlake.functions.constants import BLOCKING_REASONS, EXCLUSIVE_PROGRAMS, PROGRAM_SEQUENCES

AXES = ("age", "income", "region", "recruit")


def finite(c: Column) -> Column:
    """True for a number that is neither null nor NaN nor infinite."""
    c = c.cast("double")
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def age_reason(age_min: Column, age_max: Column, nationwide: Column, age: Column) -> Column:
    """Null if the age fits, else why not or why unknown. Bounds are inclusive; no bounds at all suit nationwide records."""
    none = age_min.isNull() & age_max.isNull()
    usable = finite(age) & F.coalesce(age >= 0, F.lit(False))
    return (
        F.when(none & F.coalesce(nationwide, F.lit(False)), None)
        .when(none | ~usable, "AGE_UNKNOWN")
        .when(age < age_min, "AGE_BELOW_MIN")
        .when(age > age_max, "AGE_ABOVE_MAX")
    )


def income_reason(kind: Column, max_ratio: Column, max_amount: Column, ratio: Column, amount: Column) -> Column:
    """Null if the income fits. A limit that isn't a finite number is unknown, as NaN would compare as larger."""
    limit = F.when(kind == "medianRatio", max_ratio).when(kind == "amountMax", max_amount).cast("double")
    own = F.when(kind == "medianRatio", ratio).when(kind == "amountMax", amount).cast("double")
    return (
        F.when(kind == "none", None)
        .when(~finite(limit), "INCOME_UNKNOWN")
        .when(~finite(own), "INCOME_PROFILE_MISSING")
        .when(own > limit, "INCOME_OVER_LIMIT")
    )


def usable_region(code: Column) -> Column:
    """A region code as it is, or null where it is blank."""
    return F.when(F.trim(code) != "", code)


def region_reason(codes: Column, nationwide: Column, code: Column) -> Column:
    """Null if the region fits. Unknown codes are not nationwide."""
    return (
        F.when(F.coalesce(nationwide, F.lit(False)), None)
        .when(F.coalesce(F.size(codes), F.lit(0)) <= 0, "REGION_UNKNOWN")
        .when(F.coalesce(code, F.lit("")) == "", "REGION_PROFILE_MISSING")
        .when(~F.coalesce(F.array_contains(codes, code), F.lit(False)), "REGION_MISMATCH")
    )


def recruit_status(kind: Column, start: Column, end: Column, today: date, soon_days: int = 7) -> Column:
    """now, soon, closed or unknown on a calendar day. A start to come is soon, however far off."""
    now = F.lit(today)
    left = F.datediff(end, now)
    return (
        F.when(kind == "always", "now")
        .when(~F.coalesce(kind == "dated", F.lit(False)), "unknown")
        .when((start.isNull() & end.isNull()) | F.coalesce(end < start, F.lit(False)), "unknown")
        .when(start > now, "soon")
        .when(end.isNull(), "now")
        .when(left < 0, "closed")
        .when(left <= soon_days, "soon")
        .otherwise("now")
    )


def recruit_reason(status: Column) -> Column:
    return F.when(status == "closed", "RECRUIT_CLOSED").when(status == "unknown", "RECRUIT_UNKNOWN")


def exclusive_reason(program: Column, active: Column, group: list[str] = EXCLUSIVE_PROGRAMS) -> Column:
    """Programs of one group exclude each other. A null history is unknown, an empty one known to be empty."""
    in_group = F.coalesce(program.isin(group), F.lit(False))
    others = F.exists(active, lambda a: a.isin(group) & (a != program))
    return (
        F.when(~in_group, None)
        .when(active.isNull() | F.coalesce(F.array_contains(active, program), F.lit(False)), "PREREQ_UNKNOWN")
        .when(F.coalesce(others, F.lit(False)), "DUPLICATE_EXCLUSIVE")
    )


def sequence_reason(program: Column, completed: Column, target: str, requires: str) -> Column:
    return (
        F.when(~F.coalesce(program == target, F.lit(False)), None)
        .when(completed.isNull(), "PREREQ_UNKNOWN")
        .when(~F.coalesce(F.array_contains(completed, requires), F.lit(False)), "PREREQ_NOT_MET")
    )


def rule_reasons(program: Column, active: Column, completed: Column) -> Column:
    every = [exclusive_reason(program, active), *[sequence_reason(program, completed, t, r) for t, r in PROGRAM_SEQUENCES]]
    return F.array_compact(F.array(*every))


RULES = "place int, kind string, target string, related array<string>"
MOST_RULES = 100_000  # programs that have rules, to be broadcast


def program_rules(exclusive: list[list[str]] = [EXCLUSIVE_PROGRAMS], sequences: list[tuple[str, str]] = PROGRAM_SEQUENCES) -> list[tuple]:  # noqa: B006
    """Rule rows in order: for an exclusive group a row for each of its programs, for a sequence one for the program that requires another."""
    rows = [(k, "exclusive", target, group) for k, group in enumerate(exclusive) for target in group]
    return rows + [(len(exclusive) + k, "sequence", target, [requires]) for k, (target, requires) in enumerate(sequences)]


def with_rule_reasons(rows: DataFrame, rules: DataFrame, program: Column, active: Column, completed: Column, most: int = MOST_RULES) -> DataFrame:
    """Rows with ``rule_reasons`` by a table of rules (place, kind, target, related), in the order of their places.

    The rules of a program are one row, which meets the rows of that program: rows aren't shuffled as long as
    the programs with rules are few enough to broadcast. An unknown kind of rule and a null program give no reason.
    """
    of = rules.filter("target IS NOT NULL").groupBy(F.col("target").alias("_target")).agg(F.sort_array(F.collect_list(F.struct("place", "kind", "related"))).alias("_rules"))
    if of.count() <= most:
        of = F.broadcast(of)

    def reason(rule: Column) -> Column:
        others = F.exists(active, lambda a: F.array_contains(rule["related"], a) & (a != program))
        lacking = F.exists(rule["related"], lambda r: ~F.coalesce(F.array_contains(completed, r), F.lit(False)))
        exclusive = F.when(active.isNull() | F.coalesce(F.array_contains(active, program), F.lit(False)), "PREREQ_UNKNOWN").when(F.coalesce(others, F.lit(False)), "DUPLICATE_EXCLUSIVE")
        sequence = F.when(completed.isNull(), "PREREQ_UNKNOWN").when(lacking, "PREREQ_NOT_MET")
        return F.when(rule["kind"] == "exclusive", exclusive).when(rule["kind"] == "sequence", sequence)

    met = rows.withColumn("_program", program).join(of, F.col("_program") == F.col("_target"), "left")
    reasons = F.coalesce(F.array_compact(F.transform("_rules", reason)), F.array().cast("array<string>"))
    return met.withColumn("rule_reasons", reasons).drop("_program", "_target", "_rules")


def is_blocking(reason: Column) -> Column:
    return reason.isin(BLOCKING_REASONS)


def reasons_in_order(axes: list[Column], rules: Column) -> Column:
    """Blocking reasons first, then the others, both in the order of axes and rules."""
    every = F.concat(F.array_compact(F.array(*axes)), rules)
    return F.concat(F.filter(every, is_blocking), F.filter(every, lambda r: ~is_blocking(r)))


def bucket(reasons: Column, status: Column) -> Column:
    return (
        F.when(F.exists(reasons, is_blocking), "blocked")
        .when(F.size(reasons) > 0, "review")
        .when(status == "soon", "soon")
        .otherwise("now")
    )


def axis_results(axes: dict[str, Column]) -> Column:
    """array<struct(axis, verdict, reason)> in fixed order."""
    verdict = lambda r: F.when(r.isNull(), "pass").when(is_blocking(r), "blocked").otherwise("review")
    return F.array(*[F.struct(F.lit(a).alias("axis"), verdict(axes[a]).alias("verdict"), axes[a].alias("reason")) for a in AXES])


def evaluate(pairs: DataFrame, today: date, soon_days: int = 7, rules: DataFrame | None = None) -> DataFrame:
    """Adds status, axes, reasons and bucket to rows of a record and a profile.

    Record: id, age_min, age_max, income struct, region_codes, is_nationwide, recruit struct, program_key.
    Profile: struct ``profile`` of age, region_code, median_ratio, amount, active_programs, completed_programs.
    A row without an id, an income or a recruit struct is broken: it is kept, for review. ``rules``: a table of
    program rules in place of those that are built in.
    """
    c, p = F.col, lambda name: F.col(f"profile.{name}")
    status = recruit_status(c("recruit.kind"), c("recruit.start"), c("recruit.end"), today, soon_days)
    broken = c("id").isNull() | c("income").isNull() | c("recruit").isNull()
    axes = {
        "age": age_reason(c("age_min"), c("age_max"), c("is_nationwide"), p("age")),
        "income": income_reason(c("income.kind"), c("income.max_ratio"), c("income.max_amount"), p("median_ratio"), p("amount")),
        "region": region_reason(c("region_codes"), c("is_nationwide"), p("region_code")),
        "recruit": recruit_reason(status),
    }
    programs = (c("program_key"), p("active_programs"), p("completed_programs"))
    if rules is not None:
        pairs = with_rule_reasons(pairs, rules, *programs)
    reasons = reasons_in_order(list(axes.values()), rule_reasons(*programs) if rules is None else c("rule_reasons"))
    return (
        pairs.withColumn("status", F.when(broken, "unknown").otherwise(status))
        .withColumn("axes", F.when(~broken, axis_results(axes)))
        .withColumn("reasons", F.when(broken, F.array(F.lit("RECRUIT_UNKNOWN"))).otherwise(reasons))
        .withColumn("bucket", bucket(c("reasons"), c("status")))
        .drop(*["rule_reasons"] * (rules is not None))
    )
