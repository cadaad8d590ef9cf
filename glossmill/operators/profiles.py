"""Marking profiles as VARIANT: migration of older and partial ones, and a strict form that sees missing and unknown fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .projection import CHANNELS

# The fields of a profile, their choices, ranges and defaults.
MODES, TRIGGERS, PLACES = ["auto", "both", "en", "zh-Hant"], ["adaptive-hover", "explicit-only", "hybrid"], ["top-right", "top-left", "bottom-right", "inline"]
SWITCHES = [*CHANNELS, "learningState"]
BUDGETS = {"maxTextNodes": 24, "maxCharacters": 12_000, "maxSentences": 24, "maxSemanticTokens": 600, "maxShardIds": 24, "timeSliceMs": 8, "maxQueuedRoots": 200, "viewportBufferPx": 1200}
LIMITS = {"maxTextNodes": (50, 2000, 600), "maxMarkedTokens": (100, 10_000, 3000)}
UNITS = {"density": 0.65, "minConfidence": 0.6}
CHOICES = {"languageMode": (MODES, "both"), "triggerMode": (TRIGGERS, "hybrid"), "labelPosition": (PLACES, "top-right")}
FIELDS = ["schemaVersion", "profileId", "profileRevision", "enabled", "languageMode", "triggerMode", "sitePolicy", "channels", "density", "minConfidence", "labelPosition", "runtimeBudgets", *LIMITS]
NESTED = {"channels": SWITCHES, "runtimeBudgets": list(BUDGETS), "sitePolicy": ["schemaVersion", "userDenylist"]}
DEFAULT_ID, MIGRATED_ID = "default", "migrated"
SAFE = 2**53 - 1


PATHS = [*FIELDS, *(f"{name}.{field}" for name, fields in NESTED.items() for field in fields)]
OLDER = {"posLabel": "posLabels", "posColor": "posColors"}
WHOLE = "_whole"
NUMBERS = [*UNITS, *LIMITS, *(f"runtimeBudgets.{k}" for k in BUDGETS)]


def at(path: str, kind: str = "variant", column: str = "profile") -> Column:
    """The value at a path as a kind; null where there is none or where it is something else."""
    return F.try_variant_get(F.col(column), f"$.{path}", kind)


def _own(what: str, path: str) -> str:
    return f"_{what}_{path.replace('.', '_')}"


def opened(raw: DataFrame, numbers: bool = True) -> DataFrame:
    """raw(.., profile) with what kind_of() and number() read: columns that hold whether it is an object, each field's kind, and the numbers.

    A field is looked up once for a row; as columns, schemas and kinds are not spelled again in each rule that asks for them.
    """
    paths = [*PATHS, *OLDER.values()]
    out = raw.withColumns({_own("schema", p): F.schema_of_variant(at(p)) for p in paths} | {WHOLE: F.coalesce(F.schema_of_variant("profile").startswith("OBJECT"), F.lit(False))})
    out = out.withColumns({_own("kind", p): _kind(F.col(_own("schema", p))) for p in paths}).drop(*(_own("schema", p) for p in paths))
    return out.withColumns({_own("number", p): _number(p) for p in NUMBERS}) if numbers else out


def closed(rows: DataFrame) -> DataFrame:
    """rows without the columns of opened()."""
    return rows.drop(WHOLE, *(_own("kind", p) for p in [*PATHS, *OLDER.values()]), *(_own("number", p) for p in NUMBERS))


def _kind(found: Column) -> Column:
    return (
        F.when(found == "BOOLEAN", "boolean").when(found == "BIGINT", "integer").when(found.rlike("^(DOUBLE|DECIMAL|FLOAT)"), "number").when(found == "STRING", "string")
        .when(found.startswith("OBJECT"), "object").when(found.startswith("ARRAY"), "array").when(found == "VOID", "null")
    )


def kind_of(path: str) -> Column:
    """boolean, integer, number, string, object, array, null, or SQL null where there is no such field; for opened() rows."""
    return F.col(_own("kind", path))


def _number(path: str) -> Column:
    kind = kind_of(path)
    text = F.trim(at(path, "string"))
    return F.when(kind.isin("integer", "number"), at(path, "double")).when(kind == "string", F.when(text == "", 0.0).otherwise(text.try_cast("double"))).when(kind == "boolean", at(path, "boolean").cast("double")).when(kind == "null", 0.0)


def number(path: str) -> Column:
    """The number that a value stands for: numbers, numerals, true and false, null as 0; for opened() rows."""
    return F.col(_own("number", path))


def clamped(path: str, low: float, high: float, default: float) -> Column:
    found = number(path)
    finite = found.isNotNull() & ~F.isnan(found) & (F.abs(found) != float("inf"))
    return F.when(finite, F.least(F.greatest(found, F.lit(float(low))), F.lit(float(high)))).otherwise(float(default))


def rounded(value: Column) -> Column:
    """Halves go up."""
    return F.floor(value + 0.5).cast("int")


def parsed(raw: DataFrame, text: str = "json") -> DataFrame:
    """raw with profile, the VARIANT of its JSON text; null where that is no JSON."""
    return raw.withColumn("profile", F.try_parse_json(text))


def per_text(raw: DataFrame, of: Callable[[DataFrame], DataFrame], text: str = "json", rows: int = 10_000) -> DataFrame:
    """raw with the columns that of() adds to a table of its distinct texts, so that a profile that many rows spell is read once.

    Up to so many distinct texts are broadcast, more are joined by shuffle. Distinct texts are exchanged into all partitions, as
    few bytes make much work. Rows whose text is null get what of() makes of null.
    """
    found = X.small(X.settled(of(X.by_key(raw.select(text).distinct(), text)).withColumnRenamed(text, "_text")), rows)
    return raw.join(found, F.col(text).eqNullSafe(F.col("_text"))).drop("_text")


def migrated(raw: DataFrame) -> DataFrame:
    """raw(.., profile) with the fields of a current profile, from a current, partial or older one.

    Older names are posLabels, posColors and the mode zh; learning state is always off. A profile that is no object counts as
    empty. Columns: profile_id, profile_revision, enabled, language_mode, trigger_mode, label_position, density,
    min_confidence, channels (map), runtime_budgets (map), max_text_nodes, max_marked_tokens.
    """
    def switch(name: str) -> Column:
        if name == "learningState":
            return F.lit(False)
        default = F.lit(name in OLDER)
        own = F.when(kind_of(f"channels.{name}") == "boolean", at(f"channels.{name}", "boolean"))
        return F.coalesce(own, *([F.when(kind_of(OLDER[name]) == "boolean", at(OLDER[name], "boolean"))] if name in OLDER else []), default)

    def choice(name: str, text: Column) -> Column:
        options, default = CHOICES[name]
        return F.when(text.isin(options), text).otherwise(default)

    text = lambda name: F.when(kind_of(name) == "string", at(name, "string"))
    mode = F.when(text("languageMode") == "zh", "zh-Hant").otherwise(text("languageMode"))
    name = F.nullif(F.trim(text("profileId")), F.lit(""))
    current = F.coalesce((kind_of("schemaVersion") == "integer") & (at("schemaVersion", "bigint") == 2), F.lit(False))
    revision = F.when((kind_of("profileRevision") == "integer") & at("profileRevision", "bigint").between(0, SAFE), at("profileRevision", "bigint")).otherwise(0)
    pairs = lambda values: F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v)))
    budgets = {k: rounded(clamped(f"runtimeBudgets.{k}", k != "viewportBufferPx", most, most)) for k, most in BUDGETS.items()}
    return closed(opened(raw).withColumns({
        "profile_id": F.coalesce(name, F.when(current, DEFAULT_ID).otherwise(MIGRATED_ID)), "profile_revision": revision.cast("long"), "enabled": F.coalesce(F.when(kind_of("enabled") == "boolean", at("enabled", "boolean")), F.lit(True)),
        "language_mode": choice("languageMode", mode), "trigger_mode": choice("triggerMode", text("triggerMode")), "label_position": choice("labelPosition", text("labelPosition")),
        "density": clamped("density", 0, 1, UNITS["density"]), "min_confidence": clamped("minConfidence", 0, 1, UNITS["minConfidence"]),
        "channels": pairs({c: switch(c) for c in SWITCHES}), "runtime_budgets": pairs(budgets), "max_text_nodes": rounded(clamped("maxTextNodes", *LIMITS["maxTextNodes"])), "max_marked_tokens": rounded(clamped("maxMarkedTokens", *LIMITS["maxMarkedTokens"])),
    }))


def _rules() -> dict[str, Column]:
    """What holds for each field of the strict form."""
    whole = lambda path, low, high: (kind_of(path) == "integer") & at(path, "bigint").between(low, high)
    text = lambda path: F.when(kind_of(path) == "string", at(path, "string"))
    hosts = at("sitePolicy.userDenylist", "array<string>")
    rules = {
        "schemaVersion": whole("schemaVersion", 2, 2), "profileId": F.trim(text("profileId")) != "", "profileRevision": whole("profileRevision", 0, SAFE), "enabled": kind_of("enabled") == "boolean",
        **{k: text(k).isin(options) for k, (options, _) in CHOICES.items()}, **{k: kind_of(k).isin("integer", "number") & at(k, "double").between(0, 1) for k in UNITS}, **{k: whole(k, low, high) for k, (low, high, _) in LIMITS.items()},
        "sitePolicy.schemaVersion": whole("sitePolicy.schemaVersion", 1, 1), "sitePolicy.userDenylist": (hosts == F.array_sort(F.array_distinct(hosts))) & F.forall(hosts, lambda h: h.rlike("^[a-z0-9-]+([.][a-z0-9-]+)*$")),
        **{f"channels.{c}": kind_of(f"channels.{c}") == "boolean" for c in SWITCHES}, **{f"runtimeBudgets.{k}": whole(f"runtimeBudgets.{k}", int(k != "viewportBufferPx"), most) for k, most in BUDGETS.items()},
    }
    return rules


def violations(raw: DataFrame) -> DataFrame:
    """raw(.., profile) with codes, in order: what keeps a profile from being a current one.

    OBJECT:path where an object should be, MISSING:path, UNKNOWN:path, INVALID:path. Fields inside what is no object are not named.
    """
    whole = F.col(WHOLE)
    inside = {name: F.coalesce(kind_of(name) == "object", F.lit(False)) for name in NESTED}
    found = [F.when(~whole, F.lit("OBJECT:profile"))]
    keys = lambda value: F.coalesce(F.json_object_keys(F.to_json(value)), F.array().cast("array<string>"))
    others = lambda value, known, head: F.transform(F.array_except(keys(value), F.lit(known)), lambda k: F.concat(F.lit(f"UNKNOWN:{head}"), k))
    unknown = [F.when(whole, others(F.col("profile"), FIELDS, ""))]
    for name, fields in NESTED.items():
        found.append(F.when(whole & kind_of(name).isNotNull() & ~inside[name], F.lit(f"OBJECT:{name}")))
        unknown.append(F.when(inside[name], others(at(name), fields, f"{name}.")))
    rules = _rules()
    for path in PATHS:
        there = inside[path.split(".")[0]] if "." in path else whole
        found.append(F.when(there & kind_of(path).isNull(), F.lit(f"MISSING:{path}")))
        if path in rules:
            found.append(F.when(there & kind_of(path).isNotNull() & ~F.coalesce(rules[path], F.lit(False)), F.lit(f"INVALID:{path}")))
    none = F.array().cast("array<string>")
    return closed(opened(raw, numbers=False).withColumn("codes", F.array_sort(F.concat(F.array_compact(F.array(*found)), *(F.coalesce(u, none) for u in unknown)))))
