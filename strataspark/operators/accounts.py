"""Account and subscription rules over tables of users, events and invoices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import company_key, email_domain

# What users are told of trials and plans.
OWN_TRIAL = "A trial has already been used for this account."
SHARED_TRIAL = "A trial has already been used for this company or email domain."
MAY_TRY = "Eligible for trial"
PLAN_LABELS = {"trial": "Free Trial", "monthly": "$99 / month", "annual": "$999 / year", "none": "No active plan"}


def normalised(users: DataFrame) -> DataFrame:
    """Users with clean e-mail, company and domain; one row for each e-mail (the smallest id)."""
    u = users.withColumn("email", F.lower(F.trim("email"))).withColumn("company_key", company_key(F.col("company_name"))).withColumn("domain", email_domain(F.col("email")))
    first = u.groupBy("email").agg(F.min("id").alias("id"))
    return u.join(first, ["email", "id"], "left_semi")


def trial_eligibility(users: DataFrame) -> DataFrame:
    """id, eligible, reason: own trial unused, and no other user with a used one shares e-mail, domain or company.

    A key stands with the two outermost of its users who used a trial, so one held by many costs one row.
    """
    keys = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, c in ((1, "email"), (2, "domain"), (3, "company_key"))))).alias("k")
    k = users.select("id", "trial_used", keys).select("id", "trial_used", "k.kind", "k.key").where("key is not null")
    spent = k.where("trial_used = 1").groupBy("kind", "key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    hit = k.join(spent, ["kind", "key"]).where("lo <> id or hi <> id").select("id").distinct().withColumn("shared", F.lit(True))
    j = users.join(hit, "id", "left")
    own = F.coalesce(F.col("trial_used"), F.lit(0)) == 1
    return j.select("id", (~own & F.col("shared").isNull()).alias("eligible"), F.when(own, OWN_TRIAL).when(F.col("shared"), SHARED_TRIAL).otherwise(MAY_TRY).alias("reason"))


def countdown(ends: Column, as_of: Column) -> Column:
    """days, hours, expired; null without an end."""
    left = F.floor((F.unix_micros(ends.cast("timestamp")) - F.unix_micros(as_of)) / 1_000_000)
    rest = F.greatest(F.lit(0), left)
    return F.when(ends.isNotNull(), F.struct(F.floor(rest / 86400).alias("days"), F.floor(rest % 86400 / 3600).alias("hours"), (left <= 0).alias("expired")))


def access_allowed(status: Column) -> Column:
    return F.coalesce(F.lower(status).isin("trialing", "active"), F.lit(False))


def plan_label(plan: Column) -> Column:
    labels = F.create_map(*(F.lit(x) for pair in PLAN_LABELS.items() for x in pair))
    return F.coalesce(F.element_at(labels, plan), F.lit(PLAN_LABELS["none"]))


def invoices(raw: DataFrame) -> DataFrame:
    """id, number, amount_paid, currency, status, created_at, hosted_invoice_url, invoice_pdf; empty values count as absent."""
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    day = F.date_format(F.timestamp_seconds(F.when(F.col("created") != 0, F.col("created"))), "yyyy-MM-dd")
    return raw.select(
        "id", F.coalesce(given("number"), "id").alias("number"), (F.coalesce("amount_paid", F.lit(0)) / 100.0).alias("amount_paid"), F.upper(F.coalesce(given("currency"), F.lit("usd"))).alias("currency"),
        F.coalesce("status", F.lit("")).alias("status"), F.coalesce(day, F.lit("")).alias("created_at"), "hosted_invoice_url", "invoice_pdf")


def account_stats(users: DataFrame) -> DataFrame:
    return users.agg(F.count(F.lit(1)).alias("total"), F.count_if(access_allowed(F.col("status"))).alias("active"), F.count("customer").alias("with_customer"))


def plan_of(events: DataFrame, prices: dict[str, str]) -> DataFrame:
    t = events.sparkSession.createDataFrame(list(prices.items()), "price_id string, plan string")
    return events.join(F.broadcast(t), "price_id", "left").withColumn("plan", F.coalesce("plan", F.lit("none")))


def owned(events: DataFrame, users: DataFrame) -> DataFrame:
    """Events with user_id: the one they name, else the user of their subscription, else (unless they end it) of their customer; events of nobody are left out.

    users has id, subscription_id and customer_id; of several users with one of these the smallest id counts.
    """
    of = lambda key, name: users.where(F.col(key).isNotNull()).groupBy(F.col(key)).agg(F.min("id").alias(name))
    j = events.join(of("subscription_id", "_s"), "subscription_id", "left").join(of("customer_id", "_c"), "customer_id", "left")
    found = F.coalesce("user_id", "_s", F.when(F.col("event_type") != "deleted", F.col("_c")))
    return j.withColumn("user_id", found).where("user_id is not null").drop("_s", "_c")


def subscription_fold(events: DataFrame) -> DataFrame:
    """user_id, status, plan, trial_end, trial_used from events of user_id, created, seq, event_type, status, plan, trial_end: the latest by time, then seq.

    An event that ends a subscription leaves the trial's end as it was.
    """
    gone, when = F.col("event_type") == "deleted", F.struct("created", "seq")
    status = F.when(gone, "canceled").otherwise(F.lower(F.coalesce("status", F.lit("none"))))
    e = events.where("user_id is not null").withColumn("s", F.struct(status.alias("status"), F.when(gone, "none").otherwise(F.col("plan")).alias("plan")))
    g = e.groupBy("user_id").agg(
        F.max_by("s", when).alias("s"), F.max_by(F.struct("trial_end"), F.when(~gone, when)).alias("t"), F.max(F.when(~gone & (F.lower("status") == "trialing"), 1).otherwise(0)).alias("trial_used"))
    return g.select("user_id", "s.status", "s.plan", "t.trial_end", "trial_used")
