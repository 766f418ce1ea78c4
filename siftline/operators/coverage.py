"""Grading rules by their text, and how well tests cover them.

Rules are rows (rule_name, formula, fields array, risk_level, ...) and tests are
rows (test_id, rule_name, test_type, category, risk_level, scenario, ...).
Tables are combined as tagged unions that are grouped once, not by joins of
single-row summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import fixed, values

_OR = "or("
_AND = "and("


def _lower(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit("")))


def _both(text: Column) -> Column:
    return (text.contains(_AND) & text.contains(_OR)) | (text.contains("_and") & text.contains("_or"))


def _either(text: Column) -> Column:
    return text.contains(_AND) | text.contains(_OR) | text.contains("_and") | text.contains("_or")


def _field_count() -> Column:
    return F.greatest(F.size("fields"), F.lit(0))


# --- grading a rule ---------------------------------------------------------------------


def rule_risk() -> Column:
    """Additive score over name, formula and number of fields: high from 5, medium from 3."""
    name, text, n = _lower("rule_name"), _lower("formula"), _field_count()
    score = (
        F.when(values.contains_any(name, fixed.HIGH_RISK_WORDS), 3).otherwise(0)
        + F.when(values.contains_any(name, fixed.MEDIUM_RISK_WORDS), 2).otherwise(0)
        + F.when(_both(text), 2).when(_either(text), 1).otherwise(0)
        + F.when(text.contains("blank"), 2).otherwise(0)
        + F.when(text.contains("parent.") | F.coalesce(F.col("logic_type"), F.lit("")).contains("lookup"), 2).otherwise(0)
        + F.when(n > 3, 2).when(n > 1, 1).otherwise(0)
    )
    return F.when(score >= 5, "high").when(score >= 3, "medium").otherwise("low")


def rule_risk_by_words() -> Column:
    """Simpler form: words of the name, then blank tests combined with AND."""
    name, text = _lower("rule_name"), _lower("formula")
    return (
        F.when(values.contains_any(name, fixed.HIGH_RISK_WORDS), "high")
        .when(values.contains_any(name, fixed.MEDIUM_RISK_WORDS), "medium")
        .when(text.contains("blank") & (text.contains(_AND) | text.contains("_and")), "high")
        .otherwise("low")
    )


def rule_logic_type() -> Column:
    """First kind of test the formula shows."""
    t = _lower("formula")
    return (
        F.when(t.contains("ispickval"), "picklist_validation")
        .when(t.contains("isblank"), "required_field")
        .when(t.contains(_AND) | t.contains(_OR), "conditional_logic")
        .when(t.contains("isnew()"), "record_creation")
        .when(t.contains("parent."), "relationship_validation")
        .when(t.rlike("[<>]|=="), "range_validation")
        .otherwise("business_rule")
    )


def rule_scenario() -> Column:
    """Business scenario by the first word the name holds."""
    name = _lower("rule_name")
    chain = F.when(F.lit(False), "")
    for word, scenario in fixed.SCENARIOS:
        chain = chain.when(name.contains(word), scenario)
    return chain.otherwise(fixed.DEFAULT_SCENARIO)


def rule_impact() -> Column:
    name = _lower("rule_name")
    return (
        F.when(values.contains_any(name, fixed.HIGH_RISK_WORDS), "high")
        .when(values.contains_any(name, fixed.MEDIUM_RISK_WORDS), "medium")
        .when(F.col("risk_level") == "high", "high")
        .otherwise("low")
    )


def rule_complexity() -> Column:
    """Weighted functions in the formula plus the number of fields."""
    t = _lower("formula")
    weights = {_AND: 2, _OR: 2, "if(": 3, "ispickval": 1, "isblank": 1, "parent.": 3}
    return sum((F.when(t.contains(w), p).otherwise(0) for w, p in weights.items()), _field_count())


def rule_effectiveness(impact: Column, risk: Column, complexity: Column) -> Column:
    def grade(c: Column) -> Column:
        return F.when(c == "high", 3).when(c == "medium", 2).otherwise(1)

    score = grade(impact) + grade(risk) + F.when(complexity >= 10, 3).when(complexity >= 6, 2).otherwise(1)
    return values.band(
        score, [(8, "Highly Effective"), (6, "Effective"), (4, "Moderately Effective")], "Limited Effectiveness"
    )


def grade_rules(rules: DataFrame) -> DataFrame:
    """All gradings of a (rule_name, formula, fields) table."""
    graded = rules.withColumn("logic_type", rule_logic_type())
    graded = graded.withColumn("risk_level", rule_risk()).withColumn("simple_risk", rule_risk_by_words())
    graded = graded.withColumns(
        {"scenario": rule_scenario(), "impact": rule_impact(), "complexity": rule_complexity()}
    )
    return graded.withColumn(
        "effectiveness", rule_effectiveness(F.col("impact"), F.col("risk_level"), F.col("complexity"))
    )


def rule_patterns(rules: DataFrame) -> DataFrame:
    """(pattern, field, rules): fields of picklist rules, required fields, dependencies, constraints.

    Fields of one pattern are counted, and the rules behind them stay rows of
    ``rule_pattern_members``.
    """
    return rule_pattern_members(rules).groupBy("pattern", "field").agg(F.count("*").alias("rules"))


def rule_pattern_members(rules: DataFrame) -> DataFrame:
    """(pattern, field, rule_name)."""
    kind = F.col("logic_type")
    pattern = (
        F.when(kind == "picklist_validation", "picklist_field")
        .when(kind == "required_field", "required_field")
        .when(kind == "conditional_logic", "conditional_dependency")
        .when(kind == "business_rule", "business_constraint")
    )
    return rules.select(pattern.alias("pattern"), F.explode("fields").alias("field"), "rule_name").filter(
        F.col("pattern").isNotNull()
    )


def risk_areas(rules: DataFrame) -> DataFrame:
    """High-risk rules with their risk factors; those without factors are left out."""
    name, text, n = _lower("rule_name"), _lower("formula"), _field_count()
    kind = F.coalesce(F.col("logic_type"), F.lit(""))
    factors = F.array_compact(
        F.array(
            F.when(name.contains("restrict") | name.contains("required"), "Data access restriction"),
            F.when(text.contains("blank") & (n > 1), "Multiple field dependency"),
            F.when(_both(text), "Complex conditional logic"),
            F.when(text.contains("parent.") | kind.contains("lookup"), "Cross-object validation"),
            F.when(n > 3, "Multiple field validation"),
            F.when(kind == "formula_validation", "Complex formula logic").when(
                kind == "required_field_validation", "Critical field validation"
            ),
        )
    )
    return (
        rules.filter("risk_level = 'high'")
        .select("rule_name", "fields", factors.alias("risk_factors"), F.lit("high").alias("test_priority"))
        .filter(F.size("risk_factors") > 0)
    )


# --- tests against rules -------------------------------------------------------------------


def _tested() -> Column:
    return F.nullif(F.col("rule_name"), F.lit(""))


def _names(tests: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per rule name: is it a rule, is it tested."""
    both = rules.select("rule_name", F.lit(True).alias("r"), F.lit(False).alias("t")).unionByName(
        tests.select(_tested().alias("rule_name"), F.lit(False).alias("r"), F.lit(True).alias("t"))
    )
    return (
        both.filter(F.col("rule_name").isNotNull())
        .groupBy("rule_name")
        .agg(F.bool_or("r").alias("is_rule"), F.bool_or("t").alias("is_tested"))
    )


def rule_coverage(tests: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules, tested names, covered rules, percent and level, one row."""
    total = F.count_if("is_rule")
    covered = F.count_if(F.col("is_rule") & F.col("is_tested"))
    share = covered * 100.0 / F.greatest(total, F.lit(1))
    return _names(tests, rules).agg(
        total.alias("total_rules"),
        F.count_if("is_tested").alias("tested_rules"),
        covered.alias("covered_rules"),
        share.alias("coverage_percentage"),
        values.band(share, fixed.COVERAGE_LEVELS, fixed.COVERAGE_LOWEST).alias("coverage_level"),
    )


def uncovered_rules(tests: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct rule names no test names."""
    return rules.select("rule_name").distinct().join(
        tests.select(_tested().alias("rule_name")).distinct(), "rule_name", "left_anti"
    )


def coverage_gaps(tests: DataFrame, rules: DataFrame) -> DataFrame:
    """(gap_type, rule_name, risk_level, business_impact, priority): untested rules, few negative or edge tests."""
    tested = tests.select(_tested().alias("rule_name")).filter(F.col("rule_name").isNotNull()).distinct()
    missing = rules.join(tested, "rule_name", "left_anti").select(
        F.lit("missing_validation_test").alias("gap_type"),
        "rule_name",
        "risk_level",
        rule_impact().alias("business_impact"),
        F.when(F.col("risk_level") == "high", "high").otherwise("medium").alias("priority"),
    )
    test_id = F.coalesce(F.col("test_id").cast("string"), F.lit(""))
    positive = (F.col("test_type") == "positive") | test_id.contains("POS_")
    negative = (F.col("test_type") == "negative") | test_id.contains("NEG_")
    edge = _lower("test_category").contains("edge") | test_id.contains("EDGE_")
    tagged = tests.select(positive.alias("p"), negative.alias("n"), edge.alias("e"), F.lit(False).alias("r")).unionByName(
        rules.select(F.lit(False).alias("p"), F.lit(False).alias("n"), F.lit(False).alias("e"), F.lit(True).alias("r"))
    )
    counts = tagged.agg(*[F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in "pner"])

    def gap(kind: str, risk: str, priority: str) -> Column:
        return F.struct(
            F.lit(kind).alias("gap_type"),
            F.lit("general").alias("rule_name"),
            F.lit(risk).alias("risk_level"),
            F.lit("medium").alias("business_impact"),
            F.lit(priority).alias("priority"),
        )

    general = counts.select(
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("p") > F.col("n") * 2, gap("insufficient_negative_tests", "medium", "medium")),
                    F.when(F.col("e") < F.col("r") * 0.5, gap("insufficient_edge_cases", "low", "low")),
                )
            )
        ).alias("g")
    ).select("g.*")
    return missing.unionByName(general)


def alignment_score(tests: DataFrame, rules: DataFrame) -> DataFrame:
    """0.5 coverage + 0.3 risk + 0.2 scenario alignment, in percent, one row."""
    names = _names(tests, rules).agg(
        F.count_if("is_rule").alias("rules"), F.count_if(F.col("is_rule") & F.col("is_tested")).alias("covered")
    )
    risks = (
        rules.select(F.lit("r").alias("side"), "risk_level")
        .unionByName(tests.select(F.lit("t").alias("side"), "risk_level"))
        .agg(
            F.count_if((F.col("side") == "r") & (F.col("risk_level") == "high")).alias("high_rules"),
            F.count_if((F.col("side") == "t") & (F.col("risk_level") == "high")).alias("high_tests"),
        )
    )
    scenarios = (
        rules.select(rule_scenario().alias("s"), F.lit(True).alias("r"), F.lit(False).alias("t"))
        .unionByName(tests.select(F.col("scenario").alias("s"), F.lit(False).alias("r"), F.lit(True).alias("t")))
        .filter(F.col("s").isNotNull())
        .groupBy("s")
        .agg(F.bool_or("r").alias("r"), F.bool_or("t").alias("t"))
        .agg(F.count_if("r").alias("scenarios"), F.count_if(F.col("r") & F.col("t")).alias("shared"))
    )
    m = _one_row([names, risks, scenarios])
    one = F.lit(1)
    coverage = F.col("covered") / F.greatest("rules", one)
    risk = F.least(F.col("high_tests") / F.greatest("high_rules", one), F.lit(1.0))
    scenario = F.col("shared") / F.greatest("scenarios", one)
    return m.select(
        coverage.alias("coverage_score"),
        risk.alias("risk_score"),
        scenario.alias("scenario_score"),
        F.least((coverage * 0.5 + risk * 0.3 + scenario * 0.2) * 100, F.lit(100.0)).alias("alignment_score"),
    )


def _one_row(parts: list[DataFrame]) -> DataFrame:
    """Single-row tables side by side: each as (name, value) rows, folded once."""
    names = [c for p in parts for c in p.columns]
    long = None
    for p in parts:
        pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in p.columns])
        rows = p.select(F.inline(pairs))
        long = rows if long is None else long.unionByName(rows)
    return long.agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])


def suite_overview(results: DataFrame) -> DataFrame:
    """Per suite: tests, passed, failed, pass rate; status compared without case."""
    passed = F.count_if(F.upper("status") == "PASS")
    total = F.count("*")
    return results.groupBy("suite").agg(
        total.alias("total_tests"),
        passed.alias("passed"),
        (total - passed).alias("failed"),
        values.percent(passed, total).alias("pass_rate"),
    )


def suite_totals(results: DataFrame) -> DataFrame:
    """All suites together, one row."""
    return suite_overview(results).agg(
        F.count("*").alias("total_suites"),
        F.sum("total_tests").alias("total_tests"),
        F.sum("passed").alias("passed"),
        F.sum("failed").alias("failed"),
        values.percent(F.sum("passed"), F.sum("total_tests")).alias("pass_rate"),
    )


def suite_quality(tests: DataFrame, rules: DataFrame) -> DataFrame:
    """Coverage, business and risk coverage and the weighted quality score, one row.

    Tests carry ``rule_name``, ``scenario``, ``risk_level``, ``pattern_type`` and
    ``enhanced``. Weights: 25 size, 30 coverage, 20 patterns, 15 business, 10
    enhanced tests.
    """
    named = _tested().isNotNull()
    tested_names = _names(tests, rules).agg(F.count_if("is_tested").alias("tested_names"))
    counts = tests.agg(
        F.count("*").alias("total_tests"),
        F.count_if(named).alias("validation_tests"),
        F.count_if(F.col("scenario").isNotNull()).alias("business_tests"),
        F.count_if(F.col("risk_level") == "high").alias("high_risk_tests"),
        F.count_if(F.col("pattern_type").isNotNull()).alias("pattern_tests"),
        F.count_if(F.coalesce(F.col("enhanced"), F.lit(False))).alias("enhanced_tests"),
    )
    of_rules = rules.agg(F.count("*").alias("rules"), F.count_if(F.col("risk_level") == "high").alias("high_rules"))
    m = _one_row([tested_names, counts, of_rules])
    c = F.col

    def capped(value: Column, top: float) -> Column:
        return F.least(value, F.lit(top))

    coverage = F.when(c("rules") > 0, c("tested_names") * 100 / F.greatest(c("rules"), F.lit(1.0))).otherwise(0.0)
    business = F.when(c("rules") > 0, capped(c("business_tests") * 100 / F.greatest(c("rules"), F.lit(1.0)), 100.0)).otherwise(
        F.when(c("business_tests") > 0, 50.0).otherwise(0.0)
    )
    risk = F.when(c("high_rules") > 0, capped(c("high_risk_tests") * 100 / F.greatest(c("high_rules"), F.lit(1.0)), 100.0)).otherwise(
        F.when(c("high_risk_tests") > 0, 30.0).otherwise(0.0)
    )
    tests_n = F.greatest(c("total_tests"), F.lit(1.0))
    score = capped(
        capped(c("total_tests") / F.greatest(c("rules"), F.lit(5.0)) * 25, 25.0)
        + coverage * 0.3
        + capped(c("pattern_tests") / tests_n * 20, 20.0)
        + capped(business * 0.15, 15.0)
        + capped(c("enhanced_tests") / tests_n * 10, 10.0),
        100.0,
    )
    enhanced, validated, patterned = c("enhanced_tests") > 0, c("validation_tests") > 0, c("pattern_tests") > 0
    level = (
        F.when(enhanced & validated & patterned, "High")
        .when(enhanced & (validated | patterned), "Medium")
        .when(enhanced, "Basic")
        .otherwise("Low")
    )
    return m.select(
        c("total_tests").cast("long").alias("total_tests"),
        c("validation_tests").cast("long").alias("validation_tests"),
        c("pattern_tests").cast("long").alias("pattern_tests"),
        c("high_risk_tests").cast("long").alias("high_risk_tests"),
        c("enhanced_tests").cast("long").alias("enhanced_tests"),
        coverage.alias("validation_coverage"),
        business.alias("business_coverage"),
        risk.alias("risk_coverage"),
        F.when(c("total_tests") > 0, score).otherwise(0.0).alias("quality_score"),
        level.alias("integration_level"),
    )
