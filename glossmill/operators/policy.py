"""URL policy: decomposition, denylist, service registry, category rules and the decision, in one projection.

Rule tables are small and fixed, so they stand in the plan as literals: a table of any size is classified
without a shuffle. Hosts must be ASCII; internationalised ones count as invalid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

# Category rules in order: category, host labels, path labels, how both combine, whether .gov counts as host.
CATEGORY_RULES = [
    ("banking", "bank banking onlinebanking", "", "any", False),
    ("payment-checkout", "pay payment payments checkout", "checkout payment payments", "any", False),
    ("password-manager", "1password bitwarden dashlane keeper lastpass password-manager", "", "any", False),
    ("authentication", "", "auth login signin sign-in password-reset", "any", False),
    ("webmail", "mail webmail", "", "any", False),
    ("private-messaging", "chat messages messenger private-messaging", "", "any", False),
    ("medical-insurance", "health medical patient insurance", "", "any", False),
    ("government-personal-data", "gov government", "account benefits identity personal-data tax", "both", True),
    ("developer-secrets", "cloud console developer", "access-keys api-keys credentials secrets", "both", False),
]

# Service rules in order: category, exact hosts, hosts with subdomains, route labels of which one must occur.
SERVICE_RULES = [
    ("banking", "", "bankofamerica.com barclays.co.uk chase.com citibank.com ctbcbank.com hsbc.com wellsfargo.com", ""),
    ("payment-checkout", "", "checkout.com paypal.com stripe.com", ""),
    ("password-manager", "app.dashlane.com my.1password.com vault.bitwarden.com vault.lastpass.com", "", ""),
    ("webmail", "mail.google.com mail.proton.me outlook.live.com outlook.office.com", "", ""),
    ("private-messaging", "discord.com", "", "channels"),
    ("private-messaging", "messages.google.com web.telegram.org web.whatsapp.com", "", ""),
    ("medical-insurance", "myaccount.uhc.com", "", "member"),
    ("medical-insurance", "", "mychart.com", ""),
    ("government-personal-data", "secure.ssa.gov", "", "myaccount"),
    ("government-personal-data", "sa.www4.irs.gov", "", "account signin"),
    ("developer-secrets", "console.aws.amazon.com", "", "secretsmanager secrets-manager"),
    ("developer-secrets", "console.cloud.google.com", "", "secret-manager secrets"),
    ("developer-secrets", "portal.azure.com", "", "keyvault secrets secretlistblade"),
]

MOST_DENIED = 128
LABEL = r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?$"


def valid_host(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.coalesce((F.char_length(host).between(1, 253)) & F.forall(labels, lambda x: x.rlike(LABEL) & (F.char_length(x) <= 63)), F.lit(False))


def clean_host(host: Column) -> Column:
    """Lower-cased host without a final dot, or null where it is not valid."""
    bare = F.lower(F.regexp_replace(host, r"\.$", ""))
    return F.when(valid_host(bare), bare)


def normalize_denylist(entries: DataFrame) -> DataFrame:
    """Distinct valid hosts of entries(host), sorted; more than MOST_DENIED entries are an error, never cut."""
    if entries.limit(MOST_DENIED + 1).count() > MOST_DENIED:
        raise ValueError(f"a denylist holds {MOST_DENIED} entries at most")
    return entries.select(clean_host(F.col("host")).alias("host")).where("host is not null").distinct().orderBy("host")


def decompose(urls: DataFrame) -> DataFrame:
    """urls(url, ...) with scheme, host, routes (labels of path, query and fragment) and url_reason, null where usable."""
    url = F.col("url")
    scheme = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    web = scheme.isin("http", "https")
    host = F.lower(F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"\.$", ""))
    path = F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    query = F.coalesce(F.concat(F.lit("?"), F.try_parse_url(url, F.lit("QUERY"))), F.lit(""))
    fragment = F.coalesce(F.concat(F.lit("#"), F.try_parse_url(url, F.lit("REF"))), F.lit(""))
    decode = lambda c: F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    rows = urls.withColumn("_raw", F.concat(path, F.lit("|"), query, F.lit("|"), fragment))
    rows = rows.withColumn("_once", decode(F.col("_raw"))).withColumn("_route", F.lower("_once"))
    rows = rows.withColumn("routes", F.filter(F.split("_route", r"[^\p{L}\p{N}-]+"), lambda x: x != ""))
    invalid = url.isNull() | (F.char_length(url) > 4096) | url.rlike(r"[\x00-\x1f\x7f]") | (scheme == "") | (web & ~valid_host(host))
    encoded = url.rlike("(?i)%(2f|5c|2e)")
    owner = F.try_parse_url(url, F.lit("USERINFO")).isNotNull()
    changed = F.col("_once") != F.col("_raw")
    twice = changed & (~decode(F.col("_once")).eqNullSafe(F.col("_once")))
    loose = web & (F.col("_once").isNull() | twice | F.col("_route").contains("\\") | (F.size("routes") > 128) | F.exists("routes", lambda x: F.char_length(x) > 128))
    hard = url.isNull() | (F.char_length(url) > 4096) | url.rlike(r"[\x00-\x1f\x7f]")
    reason = F.when(hard, "INVALID_URL").when(encoded, "AMBIGUOUS_URL").when(F.coalesce(invalid, F.lit(True)), "INVALID_URL").when(F.coalesce(owner | loose, F.lit(True)), "AMBIGUOUS_URL")
    return rows.withColumns({"scheme": scheme, "host": host, "url_reason": reason}).drop("_raw", "_once", "_route")


def host_suffixes(labels: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def forged_positions(labels: Column, known: list[str]) -> Column:
    """Places of labels that spell a known host left of the right edge."""
    n = F.size(labels)

    def places(host):
        own = F.lit(host.split("."))
        k = len(host.split("."))
        starts = F.filter(F.sequence(F.lit(0), F.greatest(n - k - 1, F.lit(0))), lambda s: (s <= n - k - 1) & (F.slice(labels, s + 1, k) == own))
        return F.flatten(F.transform(starts, lambda s: F.sequence(s, s + k - 1)))

    return F.flatten(F.array(*(places(h) for h in known)))


def category(host: Column, routes: Column, services=SERVICE_RULES, rules=CATEGORY_RULES) -> Column:
    """struct(category, evidence) of the first rule that fits, or null."""
    found = lambda name, evidence: F.struct(F.lit(name).alias("category"), evidence.alias("evidence"))
    both, by_host, by_path = F.lit("HOST_AND_PATH_LABEL"), F.lit("HOST_LABEL"), F.lit("PATH_LABEL")
    known = sorted({h for _, exact, suffix, _ in services for h in (exact + " " + suffix).split()})

    def of(s):
        labels, suffixes = s["labels"], s["suffixes"]
        overlap = lambda xs, text: F.arrays_overlap(xs, F.lit(text.split())) if text else F.lit(False)
        out = None
        for name, exact, suffix, needed in services:
            hit = (F.lit(False) if not exact else host.isin(exact.split())) | overlap(suffixes, suffix)
            hit = hit & overlap(routes, needed) if needed else hit
            value = found(name, both if needed else by_host)
            out = F.when(hit, value) if out is None else out.when(hit, value)
        gov = F.element_at(labels, -1) == "gov"
        out = out.when((F.size(s["forged"]) > 0) & gov, found("government-personal-data", by_host)) if out is not None else F.when(F.lit(False), found("", by_host))
        clear = F.filter(labels, lambda x, i: ~F.array_contains(s["forged"], i))
        for name, hosts, paths, how, tld in rules:
            on_host = overlap(clear, hosts) | (gov if tld else F.lit(False))
            on_path = overlap(routes, paths)
            hit = on_host & on_path if how == "both" else on_host | on_path
            out = out.when(hit, found(name, F.when(on_host & on_path, both).when(on_host, by_host).otherwise(by_path)))
        return out

    labels = F.split(host, r"\.")
    return let(F.struct(labels.alias("labels"), host_suffixes(labels).alias("suffixes"), forged_positions(labels, known).alias("forged")), of)


def classify(urls: DataFrame, denylist: list[str] | None = None, services=SERVICE_RULES, rules=CATEGORY_RULES) -> DataFrame:
    """urls(url, and if at hand signals and scan_failure) with allow, category, reason_code, evidence_kind; errors block."""
    denied = sorted(set(denylist or []))
    if len(denied) > MOST_DENIED:
        raise ValueError(f"a denylist holds {MOST_DENIED} hosts at most")
    rows = decompose(urls)
    if "signals" not in urls.columns:
        rows = rows.withColumn("signals", F.array().cast("array<string>"))
    if "scan_failure" not in urls.columns:
        rows = rows.withColumn("scan_failure", F.lit(None).cast("string"))
    rows = rows.withColumn("_cat", F.when(F.col("url_reason").isNull() & F.col("scheme").isin("http", "https"), category(F.col("host"), F.col("routes"), services, rules)))
    is_denied = F.arrays_overlap(host_suffixes(F.split(F.coalesce("host", F.lit("")), r"\.")), F.lit(denied)) if denied else F.lit(False)
    decision = lambda a, c, r, e: F.struct(F.lit(a).alias("allow"), (c if isinstance(c, Column) else F.lit(c)).alias("category"), (r if isinstance(r, Column) else F.lit(r)).alias("reason_code"), (e if isinstance(e, Column) else F.lit(e)).alias("evidence_kind"))
    found = (
        F.when(F.col("url_reason").isNotNull(), decision(False, "policy-error", F.col("url_reason"), "POLICY_ERROR"))
        .when(~F.col("scheme").isin("http", "https"), decision(False, "unsupported", "UNSUPPORTED_PROTOCOL", "URL_PROTOCOL"))
        .when(is_denied, decision(False, "user-denylist", "USER_DENYLIST", "HOST_LABEL"))
        .when(F.col("_cat").isNotNull(), decision(False, F.col("_cat.category"), "SENSITIVE_URL_CATEGORY", F.col("_cat.evidence")))
        .when(F.col("scan_failure").isNotNull(), decision(False, "policy-error", F.col("scan_failure"), "POLICY_ERROR"))
        .when(F.size("signals") > 0, decision(False, "sensitive-form", "SENSITIVE_FORM_ATTRIBUTE", "FORM_ATTRIBUTE"))
        .when(F.size("signals") == 0, decision(True, "public", "ALLOW", "NONE"))
        .otherwise(decision(False, "policy-error", "POLICY_INPUT_ERROR", "POLICY_ERROR"))
    )
    return rows.withColumn("_d", found).select(*urls.columns, "host", "_d.*")


def topmost(paths: DataFrame, key: str = "batch") -> DataFrame:
    """Distinct paths(key, path) without those under another one of the same batch; ancestors meet by equality."""
    own = paths.select(key, "path").distinct()
    parts = F.split("path", "/")
    above = own.select(key, "path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("up")).where("up <> path and up <> ''")
    below = above.join(own.select(key, F.col("path").alias("up")), [key, "up"], "left_semi").select(key, "path").distinct()
    return own.join(below, [key, "path"], "left_anti")
