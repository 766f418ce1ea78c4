"""Column mapping: applying, undoing, suggesting and reviewing it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import fixed


# --- applying ---------------------------------------------------------------------


def usable(mapping: dict[str, str], columns: list[str]) -> dict[str, str]:
    return {s: t for s, t in mapping.items() if t and t != fixed.SKIP_FIELD and s in columns}


def apply_mapping(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Only the mapped columns that exist, under their target names."""
    pairs = usable(mapping, df.columns)
    if not pairs:
        raise ValueError("none of the mapped columns exist in the data")
    targets = list(pairs.values())
    twice = sorted({t for t in targets if targets.count(t) > 1})
    if twice:
        raise ValueError(f"several columns are mapped to the same target: {', '.join(twice)}")
    return df.select(*[F.col(f"`{s}`").alias(t) for s, t in pairs.items()])


def ignored_mappings(df: DataFrame, mapping: dict[str, str]) -> list[str]:
    """Mapped source columns that the data does not have."""
    return [s for s in mapping if s not in df.columns]


def unapply_mapping(
    df: DataFrame, mapping: dict[str, str], original: DataFrame | None = None, row_id: str | None = None
) -> DataFrame:
    """Target names back to source names, skipping a name that is taken.

    Unmapped source columns come back from ``original`` by row key.
    """
    renames: dict[str, str] = {}
    for source, target in mapping.items():
        if target and target in df.columns and target != source:
            if source not in df.columns and source not in renames.values():
                renames[target] = source
    out = df.select(*[F.col(f"`{c}`").alias(renames.get(c, c)) for c in df.columns])
    if original is None:
        return out
    if row_id is None:
        raise ValueError("row_id is needed to bring back unmapped columns")
    extra = [c for c in original.columns if c not in out.columns and c not in mapping and c != row_id]
    if not extra:
        return out
    back = original.select(F.col(row_id).alias("_rid"), *[F.col(f"`{c}`") for c in extra])
    return out.join(back, F.col(row_id) == F.col("_rid"), "left").drop("_rid")


# --- suggesting ---------------------------------------------------------------------
#
# Every suggestion is one aggregate over the catalogue: for each source column the
# best field by (score, then catalogue position). No column x field pairs are made.


def _position(catalog: DataFrame) -> Column:
    return F.col("position") if "position" in catalog.columns else F.lit(0)


def _squash(text: str, drop: str) -> str:
    return "".join(ch for ch in text.lower() if ch not in drop)


def _best(catalog: DataFrame, scores: dict[str, tuple[Column, Column]], threshold: int) -> DataFrame:
    """(column, field, score): per column the field of the highest score.

    ``scores`` holds (score, tie rank) per column; ties go to the lower rank,
    then to the earlier and alphabetically smaller field. Below the threshold
    the column is skipped.
    """
    scored = catalog.select(
        "name",
        _position(catalog).alias("_p"),
        *[e.alias(f"{k}{i}") for i, pair in enumerate(scores.values()) for k, e in zip("sr", pair)],
    )
    # The smallest (-score, rank, position, name) is the best match.
    best = [
        F.min(
            F.when(
                F.col(f"s{i}") >= threshold,
                F.struct((-F.col(f"s{i}")).alias("s"), F.col(f"r{i}").alias("r"), F.col("_p"), F.col("name")),
            )
        ).alias(f"b{i}")
        for i in range(len(scores))
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("column"),
                F.coalesce(F.col(f"b{i}.name"), F.lit(fixed.SKIP_FIELD)).alias("field"),
                F.coalesce(-F.col(f"b{i}.s"), F.lit(0)).alias("score"),
            )
            for i, name in enumerate(scores)
        ]
    )
    return scored.agg(*best).select(F.inline(rows))


def suggest_mapping_scored(columns: dict[str, str], catalog: DataFrame, threshold: int = 50) -> DataFrame:
    """Best field per column; ``columns`` is name to detected type.

    100 same name, 90 common alias, 80 / 60 / 50 fitting type, 70 name inside name.
    """
    lower = F.lower("name")
    plain = F.regexp_replace(lower, "[_ -]", "")
    base = F.replace(lower, F.lit("__c"), F.lit(""))
    kind = F.lower(F.coalesce(F.col("type"), F.lit("")))
    scores = {}
    for name, detected in columns.items():
        key = _squash(name, "_ -")
        aliases = fixed.FIELD_ALIASES.get(key, [])
        alias_rank = F.lit(None).cast("int")
        for i, alias in reversed(list(enumerate(aliases))):
            alias_rank = F.when(F.col("name") == alias, i).otherwise(alias_rank)
        by_type = F.lit(0)
        if detected.startswith("Number"):
            by_type = F.when(kind.isin("double", "currency", "percent", "int"), 50).otherwise(0)
        elif detected == "Checkbox (Boolean)":
            by_type = F.when(kind == "boolean", 60).otherwise(0)
        elif detected.startswith("Date"):
            by_type = F.when(kind.isin("date", "datetime"), 60).otherwise(0)
        elif detected in ("Email", "Phone", "URL"):
            by_type = F.when(kind == detected.lower(), 80).otherwise(0)
        inside = lower.contains(key) | F.contains(F.lit(key), base)
        score = (
            F.when(plain == key, 100)
            .when(alias_rank.isNotNull(), 90)
            .when(by_type == 80, 80)
            .when(inside, 70)
            .otherwise(by_type)
        )
        rank = F.when(score == 90, alias_rank).otherwise(0)
        scores[name] = (score, rank)
    return _best(catalog, scores, threshold)


def suggest_mapping_name(columns: list[str], catalog: DataFrame, threshold: int = 40) -> DataFrame:
    """Best field per column by name: 100 equal, 80 inside, 60 label, 40 shared keyword."""
    field = F.lower("name")
    base = F.replace(field, F.lit("__c"), F.lit(""))
    label = F.lower(F.coalesce(F.col("label"), F.lit("")))
    scores = {}
    for name in columns:
        key = _squash(name, " _.-")
        shared = F.lit(False)
        for word in fixed.NAME_KEYWORDS:
            if word in key:
                shared = shared | field.contains(word)
        score = (
            F.when(base == key, 100)
            .when(field.contains(key) | F.contains(F.lit(key), field), 80)
            .when(label.contains(key) | F.contains(F.lit(key), label), 60)
            .when(shared, 40)
            .otherwise(0)
        )
        scores[name] = (score, F.lit(0))
    return _best(catalog, scores, threshold)


def suggest_mapping_first(columns: list[str], catalog: DataFrame) -> DataFrame:
    """First hit: same name, then same label, then one inside the other (3, 2, 1)."""
    field = F.lower("name")
    label = F.lower(F.coalesce(F.col("label"), F.lit("")))
    plain_label = F.regexp_replace(label, "[_ ]", "")
    spaceless = F.replace(label, F.lit(" "), F.lit(""))
    scores = {}
    for name in columns:
        key = _squash(name, "_ ")
        inside = (
            field.contains(key) | label.contains(key) | F.contains(F.lit(key), field) | F.contains(F.lit(key), spaceless)
        )
        score = F.when(field == key, 3).when(plain_label == key, 2).when(inside, 1).otherwise(0)
        scores[name] = (score, F.lit(0))
    return _best(catalog, scores, 1)


def suggest_mapping_alias(columns: list[str], catalog: DataFrame) -> DataFrame:
    """Common alias (2), else the first field whose name contains or is contained (1)."""
    field = F.lower("name")
    scores = {}
    for name in columns:
        key = _squash(name, "_ ")
        alias = fixed.FIELD_ALIASES.get(key, [None])[0]
        inside = field.contains(key) | F.contains(F.lit(key), field)
        score = F.when(inside, 1).otherwise(0)
        if alias is not None:
            score = F.when(F.col("name") == alias, 2).otherwise(score)
        scores[name] = (score, F.lit(0))
    return _best(catalog, scores, 1)


# --- defaults from the catalogue -----------------------------------------------------


def default_mapping(
    catalog: DataFrame,
    kind: str = "identity",
    include_system: bool = False,
    include_readonly: bool = False,
    name_filter: str | None = None,
) -> DataFrame:
    """(source, target) from the catalogue itself.

    ``identity`` maps a field to itself, ``label`` maps its label to it.
    System-named and read-only fields are left out unless asked for.
    """
    out = catalog
    if not include_system:
        for prefix in fixed.SYSTEM_PREFIXES:
            out = out.filter(~F.col("name").startswith(prefix))
    if not include_readonly:
        out = out.filter(F.coalesce(F.col("updateable"), F.lit(False)) | (F.col("name") == "Id"))
    if name_filter:
        wanted = F.lit(False)
        for term in name_filter.split(","):
            wanted = wanted | F.lower("name").contains(term.strip().lower())
        out = out.filter(wanted)
    source = F.col("name") if kind == "identity" else F.coalesce("label", "name")
    return out.select(source.alias("source"), F.col("name").alias("target"))


def loadable_mapping(catalog: DataFrame) -> DataFrame:
    """Id first, then updateable fields without excluded words, plus external ids: (position, source, target)."""
    lower = F.lower("name")
    excluded = F.lit(False)
    for word in fixed.EXCLUDED_FIELD_WORDS:
        excluded = excluded | lower.contains(word)
    usable_field = F.coalesce(F.col("updateable"), F.lit(False)) & ~excluded
    external = F.coalesce(F.col("external_id"), F.lit(False))
    kept = catalog.filter((F.col("name") != "Id") & (usable_field | external)).select(
        F.when(usable_field, 1).otherwise(2).alias("position"), F.col("name").alias("source"), F.col("name").alias("target")
    )
    first = catalog.sparkSession.createDataFrame([(0, "Id", "Id")], "position int, source string, target string")
    return first.unionByName(kept).dropDuplicates(["source", "position"])


# --- reviewing ------------------------------------------------------------------------


def mapping_counts(mappings: DataFrame) -> DataFrame:
    """Objects, mapped fields and mean fields per object of (object, source, target) rows."""
    per_object = mappings.groupBy("object").agg(F.count("source").alias("fields"))
    return per_object.agg(
        F.count("*").alias("total_mappings"),
        F.coalesce(F.sum("fields"), F.lit(0)).alias("total_fields"),
        F.coalesce(F.avg("fields"), F.lit(0.0)).alias("average_fields"),
    )


def mapping_top(mappings: DataFrame, side: str, n: int = 10) -> DataFrame:
    """The ``n`` most used source or target fields."""
    return (
        mappings.filter(F.col(side).isNotNull())
        .groupBy(F.col(side).alias("field"))
        .agg(F.count("*").alias("mappings"))
        .orderBy(F.desc("mappings"), "field")
        .limit(n)
    )


def mapping_issues(mappings: DataFrame) -> DataFrame:
    """Targets used twice and sources without target: (object, issue, field, occurrences)."""
    empty = F.col("target").isNull() | (F.col("target") == "")
    twice = (
        mappings.filter(~empty)
        .groupBy("object", F.col("target").alias("field"))
        .agg(F.count("*").alias("occurrences"))
        .filter("occurrences > 1")
        .select("object", F.lit("Duplicate Target Fields").alias("issue"), "field", "occurrences")
    )
    missing = mappings.filter(empty).select(
        "object", F.lit("Empty Target Fields").alias("issue"), F.col("source").alias("field"), F.lit(1).cast("long").alias("occurrences")
    )
    return twice.unionByName(missing)
