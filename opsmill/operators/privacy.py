"""Privacy, compliance and audit operators (SURVEY 2.14: G1-G16; G7-G10 live in
``documents`` and ``folds``).

Every policy date is an explicit ``as_of``; salts and secrets are parameters and never
appear in outputs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsmill.session import bounded

# Consent purposes tracked per user.
CONSENT_TYPES = ["marketing_emails", "analytics_tracking", "third_party_sharing", "profiling"]

# Audit events required per area.
REQUIRED_AUDIT_EVENTS = {
    "authentication": ["login_success", "login_failure", "logout", "password_change", "mfa_enabled", "mfa_disabled"],
    "authorization": ["access_granted", "access_denied", "permission_changed", "role_assigned", "role_revoked"],
    "data_access": ["data_viewed", "data_exported", "data_modified", "data_deleted", "bulk_operation"],
    "compliance": ["consent_given", "consent_withdrawn", "data_request", "data_erasure", "privacy_settings_changed"],
}

# Training modules required every 365 days.
REQUIRED_TRAINING = ["HIPAA Privacy Rule", "HIPAA Security Rule", "PHI Handling Procedures", "Breach Notification",
                     "Patient Rights", "Minimum Necessary Standard"]

# Card data that must never be stored.
PROHIBITED_CARD_FIELDS = ["cvv", "cvv2", "cvc2", "cid", "pin", "pin_block"]

# PCI merchant levels by yearly transactions (lower bound, level).
PCI_LEVELS = [(6_000_000, "Level 1"), (1_000_000, "Level 2"), (20_000, "Level 3"), (0, "Level 4")]

# Licences allowed for dependencies.
LICENSE_ALLOWLIST = ["MIT", "Apache-2.0", "BSD-3-Clause", "ISC"]


def consent_current(consents: DataFrame, user: str = "user_id", ctype: str = "consent_type", ts: str = "ts",
                    tie: str | None = "event_id") -> DataFrame:
    """G1: the latest consent record per (user, purpose) from the append-only log;
    ``active`` = granted and not withdrawn."""
    order = F.struct(F.col(ts), F.col(tie)) if tie else F.col(ts)
    last = consents.groupBy(user, ctype).agg(F.max_by(F.struct("granted", "withdrawn", ts), order).alias("c"))
    return last.select(user, ctype, F.col("c.granted").alias("granted"), F.col("c.withdrawn").alias("withdrawn"),
                       F.col(f"c.{ts}").alias("updated_at"),
                       (F.col("c.granted") & ~F.coalesce(F.col("c.withdrawn"), F.lit(False))).alias("active"))


def consent_rate(current: DataFrame, ctype: str = "consent_type") -> DataFrame:
    """Share of users with active consent, per purpose."""
    return current.groupBy(ctype).agg(F.count(F.lit(1)).alias("users"), F.avg(F.when(F.col("active"), 1.0).otherwise(0.0)).alias("rate"))


def erasure_apply(profiles: DataFrame, content: DataFrame, analytics: DataFrame, requests: DataFrame, user: str = "user_id",
                  anonymize: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Right to erasure. Profiles and analytics rows of the requesting users are
    dropped (anti join), their content is kept but anonymised (user id and the listed
    columns nulled), and a log row per request lists the categories handled."""
    req = requests.select(user).distinct()
    flagged = content.join(req.withColumn("__erase", F.lit(True)), user, "left")
    anon = flagged.select(*[
        (F.when(F.col("__erase"), F.lit(None)).otherwise(F.col(c)).cast(content.schema[c].dataType).alias(c)
         if c == user or c in anonymize else F.col(c)) for c in content.columns])
    log = req.withColumn("data_categories", F.array(*[F.lit(x) for x in ("profile", "content_anonymized", "analytics",
                                                                         "backups_scheduled")])).withColumn("status", F.lit("completed"))
    return {"profiles": profiles.join(req, user, "left_anti"), "content": anon, "analytics": analytics.join(req, user, "left_anti"),
            "log": log}


def pseudonymize(df: DataFrame, id_col: str, salt: str, age_col: str | None = None, region_col: Column | None = None,
                 keep: Sequence[str] = ()) -> DataFrame:
    """16 hex characters of sha256(id + salt), an age group and a region; direct
    identifiers are not carried over."""
    cols = [F.substring(F.sha2(F.concat(F.col(id_col).cast("string"), F.lit(salt)), 256), 1, 16).alias("pseudonym")]
    if age_col:
        a = F.col(age_col)
        cols.append(F.when(a < 18, "<18").when(a < 30, "18-29").when(a < 45, "30-44").when(a < 65, "45-64").otherwise("65+")
                    .alias("age_group"))
    if region_col is not None:
        cols.append(region_col.alias("region"))
    return df.select(*cols, *keep)


def column_minimize(df: DataFrame, allowed: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Keep only allow-listed columns; also return the dropped column names."""
    keep = [c for c in df.columns if c in set(allowed)]
    return df.select(*keep), [c for c in df.columns if c not in set(allowed)]


def mask_pan(col) -> Column:
    """G6: 'XXXX-XXXX-XXXX-' + last four digits of a card number (never the rest)."""
    digits = F.regexp_replace(F.col(col) if isinstance(col, str) else col, r"[^0-9]", "")
    return F.concat(F.lit("XXXX-XXXX-XXXX-"), F.right(digits, F.lit(4)))


def drop_prohibited(df: DataFrame, prohibited: Sequence[str] = PROHIBITED_CARD_FIELDS) -> DataFrame:
    """Remove sensitive authentication data columns."""
    return df.drop(*[c for c in df.columns if c.lower() in set(prohibited)])


def license_violations(packages: DataFrame, license_col: str = "license", allowed: Sequence[str] = LICENSE_ALLOWLIST) -> DataFrame:
    """Packages whose licence is not allow-listed."""
    return packages.filter(~F.col(license_col).isin(list(allowed)) | F.col(license_col).isNull())


def audit_event_coverage(spark: SparkSession, events: DataFrame, type_col: str = "event_type") -> DataFrame:
    """Per (area, required event type) the number of observed events, zero-filled."""
    req = spark.createDataFrame([(a, e) for a, es in REQUIRED_AUDIT_EVENTS.items() for e in es], "area string, event_type string")
    seen = events.groupBy(F.col(type_col).alias("event_type")).agg(F.count(F.lit(1)).alias("observed"))
    return bounded(req, 100).join(seen, "event_type", "left").select("area", "event_type",
                                                                      F.coalesce("observed", F.lit(0)).alias("observed"))


def training_status(spark: SparkSession, employees: DataFrame, completions: DataFrame, as_of: str, employee: str = "employee_id",
                    modules: Sequence[str] = REQUIRED_TRAINING, valid_days: int = 365) -> DataFrame:
    """Per employee and required module: completed when the latest completion lies
    within ``valid_days`` before as_of, otherwise pending. The module list is a bounded
    literal, broadcast to every employee partition."""
    mods = bounded(spark.createDataFrame([(m,) for m in modules], "module string"), 100)
    last = completions.groupBy(employee, "module").agg(F.max("completed_at").alias("last_completed"))
    cutoff = F.to_timestamp(F.lit(as_of)) - F.make_interval(days=F.lit(valid_days))
    return (employees.select(employee).distinct().join(mods, how="inner")
            .join(last, [employee, "module"], "left")
            .withColumn("status", F.when(F.col("last_completed") > cutoff, "completed").otherwise("pending")))


def pci_level(yearly_transactions) -> Column:
    """Merchant level by yearly card transactions."""
    c = F.col(yearly_transactions) if isinstance(yearly_transactions, str) else yearly_transactions
    expr = None
    for lo, lvl in PCI_LEVELS:
        cond = c > lo if lo > 0 else F.lit(True)
        expr = F.when(cond, lvl) if expr is None else expr.when(cond, lvl)
    return expr


def regulation_applicability(facts: DataFrame, rules: DataFrame, fact_key: str = "fact") -> DataFrame:
    """Business facts x applicability rules (a small literal table of (fact,
    regulation, priority)) -> applicable regulations, highest priority first per entity."""
    return facts.join(bounded(rules, 1000), fact_key)


def period_report(requests: DataFrame, kind: str, opened: str, closed: str, start: str, end: str, sla_days: int = 30) -> DataFrame:
    """Requests opened in [start, end) by kind: count, average response days and SLA
    breaches (open requests count as breaches once past the SLA at ``end``)."""
    p = requests.filter((F.col(opened) >= F.to_timestamp(F.lit(start))) & (F.col(opened) < F.to_timestamp(F.lit(end))))
    done = F.coalesce(F.col(closed), F.to_timestamp(F.lit(end)))
    days = (F.unix_timestamp(done) - F.unix_timestamp(F.col(opened))) / 86400.0
    return p.groupBy(kind).agg(F.count(F.lit(1)).alias("requests"), F.avg(days).alias("avg_response_days"),
                               F.count_if(days > sla_days).alias("breaches"))


def access_violations(access: DataFrame, grants: DataFrame, user: str, subject: str, ts: str, purpose: str,
                      valid_hours: int = 24) -> DataFrame:
    """Accesses without a grant for the same (user, subject, purpose) issued at most
    ``valid_hours`` before the access. The join is an equi join on the three keys plus a
    time-range predicate - never a product of all accesses and grants."""
    g = grants.select(user, subject, purpose, F.col("granted_at"))
    ok = (access.join(g, [user, subject, purpose])
          .filter((F.col(ts) >= F.col("granted_at")) & (F.col(ts) < F.col("granted_at") + F.make_interval(hours=F.lit(valid_hours))))
          .select(user, subject, purpose, ts).distinct())
    return access.join(ok, [user, subject, purpose, ts], "left_anti")


def retention_candidates(records: DataFrame, ts: str, as_of: str, keep_days: int, holds: DataFrame | None = None,
                         key: str | None = None) -> DataFrame:
    """Records older than the retention period and not under legal hold."""
    old = records.filter(F.col(ts) < F.to_timestamp(F.lit(as_of)) - F.make_interval(days=F.lit(keep_days)))
    return old.join(holds.select(key).distinct(), key, "left_anti") if holds is not None else old
