"""Dataset registry: listing, search, upserts, categorisation rules, settings."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statspine.functions.columns import contains_ci, nulls_last, ratio
from statspine.operators.aggregates import limit_offset
from statspine.operators.keywords import KEY, keyword_hits, text_key

DEFAULT_CATEGORY, DEFAULT_PRIORITY = "altro", 1
HIGH_PRIORITY = 7

# fixed values: default categorisation rules (rule id, category, priority, keywords)
DEFAULT_RULES = [
    (
        "pop_rule",
        "popolazione",
        10,
        [
            "popolazione", "popul", "residente", "demografic", "demo", "nascite", "morti", "stranieri",
            "cittadini", "anagrafe", "matrimoni", "divorzi", "migrazioni", "natalità", "mortalità",
        ],
    ),
    (
        "econ_rule",
        "economia",
        9,
        [
            "pil", "gdp", "economia", "economic", "inflazione", "prezzi", "price", "reddito", "income", "consumi",
            "spesa", "export", "import", "commercio", "bilancia", "prodotto_interno",
        ],
    ),
    (
        "work_rule",
        "lavoro",
        8,
        [
            "lavoro", "occupazione", "disoccupazione", "employment", "unemploy", "forze_lavoro", "attività",
            "inattivi", "occupati", "cerca_lavoro", "tasso_occupazione",
        ],
    ),
    (
        "terr_rule",
        "territorio",
        7,
        [
            "regione", "provincia", "comune", "territorial", "geographic", "territorio", "amministrativo",
            "confini", "enti_locali", "municipalità", "circoscrizione",
        ],
    ),
    (
        "edu_rule",
        "istruzione",
        6,
        [
            "istruzione", "scuola", "università", "education", "student", "studenti", "alunni", "laureati",
            "diploma", "formazione", "educazione", "insegnanti", "docenti",
        ],
    ),
    (
        "health_rule",
        "salute",
        5,
        [
            "sanita", "salute", "ospedale", "health", "medical", "sanitario", "medico", "malattie", "ricoveri",
            "cure", "farmaci", "prevenzione", "mortalità", "cause_morte",
        ],
    ),
]


def list_datasets(
    registry: DataFrame,
    category: str | None = None,
    active_only: bool = True,
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """Datasets by priority (highest first), then name."""
    rows = registry
    if category:
        rows = rows.where(F.col("category") == category)
    if active_only:
        rows = rows.where("is_active")
    return limit_offset(rows, ["-priority", "name", "dataset_id"], limit, offset if limit else 0)


def categories(registry: DataFrame) -> DataFrame:
    return registry.where("is_active AND category IS NOT NULL AND category <> ''").select("category").distinct()


def search(registry: DataFrame, text: str, category: str | None = None, columns: tuple[str, ...] = ("name", "description", "dataset_id")) -> DataFrame:
    """Datasets whose name, description or id contains the text, in any case."""
    rows = registry.where(F.col("category") == category) if category else registry
    wanted = text.strip()
    hit = F.lit(False)
    for c in columns:
        hit = hit | contains_ci(c, wanted)
    return rows.where(hit)


def registry_summary(registry: DataFrame) -> DataFrame:
    return registry.agg(
        F.count("*").alias("total_datasets"),
        F.count_if("is_active").alias("active_datasets"),
        F.count_distinct("category").alias("categories"),
        F.sum("record_count").alias("total_records"),
        ratio(F.sum(F.col("quality_score").cast("decimal(20,6)")), F.count("quality_score")).alias("avg_quality_score"),
        F.max("last_updated").alias("last_processing"),
    )


def categories_summary(registry: DataFrame) -> DataFrame:
    return registry.groupBy("category").agg(F.count("*").alias("dataset_count"))


def datasets_by_category(registry: DataFrame, category: str) -> DataFrame:
    return registry.where(F.col("category") == category)


def high_priority(registry: DataFrame, limit: int | None = None) -> DataFrame:
    rows = registry.where(F.coalesce("priority", F.lit(5)) >= HIGH_PRIORITY)
    return rows.orderBy(*nulls_last("-priority", "dataset_id")).limit(limit) if limit else rows


def upsert_latest(stored: DataFrame, incoming: DataFrame, key: str = "dataset_id", version: str = "updated_at") -> DataFrame:
    """Insert or replace whole rows: an incoming row wins over the stored one and is active.

    Several incoming rows for a key: the newest wins. One aggregate, so a key with
    many versions shrinks before the shuffle.
    """
    both = stored.withColumn("_new", F.lit(0)).unionByName(
        incoming.withColumn("is_active", F.lit(True)).withColumn("_new", F.lit(1))
    )
    rest = [c for c in stored.columns if c not in (key, version)]
    newest = both.groupBy(key).agg(F.max(F.struct("_new", version, *rest)).alias("r"))
    return newest.select(*[F.col(c) if c == key else F.col(f"r.{c}") for c in stored.columns])


# fixed values: columns a conflicting insert overwrites; the others keep their stored value
UPSERT_COLUMNS = (
    "dataset_name", "category", "priority", "description", "completeness_score", "data_quality_score",
    "processing_status", "updated_at",
)


def upsert_partial(
    stored: DataFrame, incoming: DataFrame, key: str = "dataset_id", overwrite: tuple[str, ...] = UPSERT_COLUMNS
) -> DataFrame:
    """Insert new keys; for a stored key overwrite only the named columns (also with NULL).

    Incoming rows of one key take effect as if applied one after another: by ``updated_at`` where there is one,
    then by all other columns in their order, NULL first. The last sets the overwritten columns, the first of a
    new key the others.
    """
    rest = [c for c in incoming.columns if c != key]
    row = F.struct(*sorted(rest, key=lambda c: c != "updated_at"))
    i = incoming.groupBy(F.col(key).alias("_key")).agg(F.min(row).alias("_first"), F.max(row).alias("_last"))
    joined = stored.join(i, F.col(key) == F.col("_key"), "full")
    is_new, is_kept = F.col(key).isNull(), F.col("_key").isNull()

    def pick(name: str) -> Column:
        old = F.col(name)
        if name == key:
            return F.coalesce(old, F.col("_key")).alias(name)
        if name not in rest:
            return F.when(is_new, F.lit(None)).otherwise(old).alias(name)
        if name in overwrite:
            return F.when(is_kept, old).otherwise(F.col(f"_last.{name}")).alias(name)
        return F.when(is_new, F.col(f"_first.{name}")).otherwise(old).alias(name)

    return joined.select(*[pick(c) for c in stored.columns])


def with_insert_defaults(rows: DataFrame) -> DataFrame:
    """Missing category, priority, name and status of an incoming metadata row."""
    defaults = {"dataset_name": "", "category": DEFAULT_CATEGORY, "priority": DEFAULT_PRIORITY, "processing_status": "processed"}
    for name, value in defaults.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(value))
    return rows


def update_stats(registry: DataFrame, changes: DataFrame, as_of: datetime, key: str = "dataset_id") -> DataFrame:
    """Apply a change set (record_count, quality_score, last_updated); NULL leaves a field as it is.

    Several changes of one key take effect one after another, by last_updated (NULL first), then record_count,
    then quality_score: each field gets its last value.
    """
    fields = [c for c in ("record_count", "quality_score", "last_updated") if c in changes.columns]
    order = F.struct(*sorted(fields, key=lambda c: c != "last_updated"))
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"_{c}") for c in fields]
    renamed = changes.groupBy(F.col(key).alias("_key")).agg(*last)
    joined = registry.join(renamed, F.col(key) == F.col("_key"), "left")
    changed = F.lit(False)
    for c in fields:
        changed = changed | F.col(f"_{c}").isNotNull()
    stamp = F.lit(as_of).cast(registry.schema["updated_at"].dataType)
    out = {c: F.coalesce(f"_{c}", c) for c in fields} | {"updated_at": F.when(changed, stamp).otherwise(F.col("updated_at"))}
    return joined.withColumns(out).drop("_key", *[f"_{c}" for c in fields])


def soft_delete(registry: DataFrame, ids: DataFrame, as_of: datetime, key: str = "dataset_id") -> DataFrame:
    """Mark the given ids inactive; no row is removed."""
    gone = ids.select(F.col(key).alias("_gone")).distinct()
    joined = registry.join(gone, F.col(key) == F.col("_gone"), "left")
    hit = F.col("_gone").isNotNull()
    stamp = F.lit(as_of).cast(registry.schema["updated_at"].dataType)
    return joined.withColumns(
        {
            "is_active": F.when(hit, F.lit(False)).otherwise(F.col("is_active")),
            "updated_at": F.when(hit, stamp).otherwise(F.col("updated_at")),
        }
    ).drop("_gone")


def retain_since(df: DataFrame, column: str, as_of: datetime, days: int) -> DataFrame:
    """Rows not older than ``days`` at ``as_of``."""
    cutoff = F.lit(as_of - timedelta(days=days)).cast(df.schema[column].dataType)
    return df.where(F.col(column) >= cutoff)


def with_analytics(registry: DataFrame, stats: DataFrame, present: bool | None = None) -> DataFrame:
    """Registry rows with their analytics statistics; optionally only with / without data.

    One grouped job feeds ``stats`` for all datasets.
    """
    numbers = ["record_count", "territory_count", "measure_count"]
    joined = registry.drop("record_count").join(stats, "dataset_id", "left")
    joined = joined.withColumns({n: F.coalesce(n, F.lit(0)) for n in numbers if n in stats.columns})
    joined = joined.withColumn("has_analytics_data", F.col("record_count") > 0)
    return joined if present is None else joined.where(F.col("has_analytics_data") == present)


def default_rules(spark) -> DataFrame:
    rows = [(r, c, k, p, True, datetime(2000, 1, 1)) for r, c, p, k in DEFAULT_RULES]
    return spark.createDataFrame(
        rows, "rule_id string, category string, keywords array<string>, priority int, is_active boolean, created_at timestamp"
    )


def normalise_rules(rules: DataFrame) -> DataFrame:
    """Keywords lowercased, trimmed, empties dropped; a rule without any is rejected."""
    cleaned = F.filter(F.transform("keywords", lambda k: F.trim(F.lower(k))), lambda k: k != "")
    return rules.withColumn("keywords", cleaned).where(F.size("keywords") > 0)


def active_rules(rules: DataFrame, category: str | None = None, active_only: bool = True) -> DataFrame:
    """Rules by priority (highest first), then age."""
    rows = rules.where(F.col("category") == category) if category else rules
    if active_only:
        rows = rows.where("is_active")
    return rows.orderBy(*nulls_last("-priority", "created_at", "rule_id"))


def categorise(datasets: DataFrame, rules: DataFrame, text_columns: list[str]) -> DataFrame:
    """Category, priority and score of every dataset by keyword rules.

    The highest-priority active rule with a keyword in the text wins; score is the number of its keywords found; no hit
    gives the default category. Keywords meet the vocabulary of all texts, not each text (``keyword_hits``), so thousands of
    rules cost no more passes over the texts than one. An empty keyword is in no text.
    """
    text = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in text_columns]))
    order = F.struct((-F.col("priority")).alias("o"), "created_at", "rule_id", "category").alias("rule")
    listed = rules.where("is_active").select(order, F.explode("keywords").alias("keyword"))
    times = listed.groupBy("rule", "keyword").agg(F.count("*").alias("n"))
    hits = keyword_hits(datasets.select(text.alias("t")), times.select("keyword").distinct())
    # rules are few against texts and their hits; a rule's keywords in a text come together as a count
    scored = hits.join(times, "keyword").groupBy(*KEY, "rule").agg(F.sum("n").cast("int").alias("score"))
    best = scored.groupBy(*KEY).agg(F.min(F.struct("rule", "score")).alias("_hit")).withColumnsRenamed({k: f"_{k}" for k in KEY})
    keyed = datasets.select("*", *text_key(text))
    joined = keyed.join(best, [F.col(k) == F.col(f"_{k}") for k in KEY], "left")
    return joined.withColumns(
        {
            "category": F.coalesce("_hit.rule.category", F.lit(DEFAULT_CATEGORY)),
            "priority": F.coalesce(-F.col("_hit.rule.o"), F.lit(DEFAULT_PRIORITY)),
            "score": F.coalesce("_hit.score", F.lit(0)),
        }
    ).drop("_hit", *KEY, *[f"_{k}" for k in KEY])


def validate_dataset_ids(df: DataFrame, column: str = "dataset_id") -> DataFrame:
    """Problem (first rule broken, or ``valid``) and a normalised suggestion for every id."""
    c = F.trim(F.coalesce(F.col(column), F.lit("")))
    problem = (
        F.when(c == "", "empty")
        .when(~c.rlike(r"^[A-Za-z0-9_-]+$"), "invalid_characters")
        .when(F.length(c) < 3, "too_short")
        .when(F.length(c) > 50, "too_long")
        .when(c.rlike(r"^[_-]"), "leading_separator")
        .when(c.rlike(r"[_-]$"), "trailing_separator")
        .when(c.rlike(r"[_-]{2}"), "consecutive_separators")
        .otherwise("valid")
    )
    # every run of characters other than letters and digits is one separator; none at the ends
    s = F.array_join(F.regexp_extract_all(F.col(column), F.lit("[A-Za-z0-9]+"), F.lit(0)), "_")
    return df.withColumns({"problem": problem, "suggestion": F.when(F.length(s) >= 3, F.upper(s))})


def preference_stats(preferences: DataFrame) -> DataFrame:
    return preferences.agg(
        F.count_distinct("user_id").alias("total_users"),
        F.count("*").alias("total_preferences"),
        F.count_distinct("preference_key").alias("unique_keys"),
        ratio(F.count_if(F.col("preference_type") == "json"), F.count("*")).alias("json_ratio"),
        F.count_if("is_encrypted").alias("encrypted_count"),
    )


def users_with_preferences(preferences: DataFrame) -> DataFrame:
    return preferences.select("user_id").distinct()


# fixed values: texts read as true
TRUE_TEXTS = ["true", "1", "yes", "on"]


def typed_settings(settings: DataFrame, key: str, value: str, kind: str, key_pattern: str | None = None) -> DataFrame:
    """Setting text as typed columns; text that does not parse stays in ``text_value``."""
    rows = settings.where(F.col(key).like(key_pattern)) if key_pattern else settings
    v, k = F.col(value), F.col(kind)
    numeric = k.isin("number", "integer")
    has_point = v.contains(".")
    integer = F.when(numeric & ~has_point, v.try_cast("long"))
    number = F.when(numeric & has_point, v.try_cast("double"))
    boolean = F.when(k == "boolean", F.lower(v).isin(TRUE_TEXTS))
    is_json = (k == "json") & F.try_parse_json(v).isNotNull()
    typed = integer.isNotNull() | number.isNotNull() | boolean.isNotNull() | is_json
    return rows.withColumns(
        {
            "integer_value": integer,
            "number_value": number,
            "boolean_value": boolean,
            "json_value": F.when(is_json, v),
            "text_value": F.when(~typed | typed.isNull(), v),
        }
    )


def key_usage_stats(keys: DataFrame, as_of: datetime) -> DataFrame:
    """Totals over API keys: active, revoked, used in 7 days, total / mean / largest use."""
    active = F.col("is_active")
    recent = active & (F.col("last_used") > F.lit(as_of - timedelta(days=7)).cast(keys.schema["last_used"].dataType))
    usage = F.when(active, F.col("usage_count"))
    return keys.agg(
        F.count("*").alias("total_keys"),
        F.count_if(active).alias("active_keys"),
        F.count_if(~active).alias("revoked_keys"),
        F.count_if(recent).alias("recently_used"),
        F.sum(usage).alias("total_usage"),
        ratio(F.sum(usage), F.count_if(active)).alias("avg_usage"),
        F.max(usage).alias("max_usage"),
        F.max_by("name", F.when(active, F.struct("usage_count", "name"))).alias("most_used"),
    )


def keys_per_scope(keys: DataFrame) -> DataFrame:
    return keys.where("is_active").select(F.explode("scopes").alias("scope")).groupBy("scope").agg(F.count("*").alias("key_count"))
