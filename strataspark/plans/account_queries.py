"""Queries of accounts and subscriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounts
from .registry import query, whole
from .standins import USERS, t, users


@query("acc_trial", f"""WITH {USERS}, k AS (SELECT id, trial_used, 1 AS kind, email AS key FROM users UNION ALL SELECT id, trial_used, 2, domain FROM users UNION ALL SELECT id, trial_used, 3, company_key FROM users),
h AS (SELECT DISTINCT a.id FROM k a JOIN k b ON a.kind = b.kind AND a.key = b.key AND b.trial_used = 1 AND a.id <> b.id)
SELECT u.id, trial_used = 0 AND h.id IS NULL AS eligible, CASE WHEN trial_used = 1 THEN 'A trial has already been used for this account.' WHEN h.id IS NOT NULL THEN 'A trial has already been used for this company or email domain.' ELSE 'Eligible for trial' END AS reason
FROM users u LEFT JOIN h ON h.id = u.id""")
def acc_trial(spark, sf):
    return accounts.trial_eligibility(accounts.normalised(users(spark, sf)))


@query("acc_users", f"""WITH {USERS} SELECT id, email, domain, company_key FROM users""")
def acc_users(spark, sf):
    return accounts.normalised(users(spark, sf)).select("id", "email", "domain", "company_key")


@query("acc_stats", f"""WITH {USERS} SELECT count(*) AS total, count(*) FILTER (status IN ('trialing', 'active')) AS active, count(customer) AS with_customer FROM users""")
def acc_stats(spark, sf):
    return accounts.account_stats(accounts.normalised(users(spark, sf)))


@query("acc_countdown", """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN epoch(o_orderdate) - epoch(TIMESTAMP '1999-01-01 12:30:00') END AS s FROM orders)
SELECT o_orderkey, CAST(floor(greatest(0, s) / 86400) AS BIGINT) AS days, CAST(floor(greatest(0, s) % 86400 / 3600) AS BIGINT) AS hours, s <= 0 AS expired FROM o WHERE s IS NOT NULL UNION ALL SELECT o_orderkey, NULL, NULL, NULL FROM o WHERE s IS NULL""")
def acc_countdown(spark, sf):
    ends = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate"))
    return t(spark, sf, "orders").select("o_orderkey", accounts.countdown(ends, F.to_timestamp(F.lit("1999-01-01 12:30:00"))).alias("c")).select("o_orderkey", "c.*")


@query("acc_access", """SELECT o_orderkey, o_orderkey % 3 < 2 AS allowed, CASE o_orderkey % 6 WHEN 0 THEN 'Free Trial' WHEN 1 THEN '$99 / month' WHEN 2 THEN '$999 / year' ELSE 'No active plan' END AS plan FROM orders""")
def acc_access(spark, sf):
    k = F.col("o_orderkey")
    status = F.when(k % 3 == 0, "Trialing").when(k % 3 == 1, "ACTIVE")
    plan = F.when(k % 6 == 0, "trial").when(k % 6 == 1, "monthly").when(k % 6 == 2, "annual").when(k % 6 == 3, "none").when(k % 6 == 4, "gold")
    return t(spark, sf, "orders").select("o_orderkey", accounts.access_allowed(status).alias("allowed"), accounts.plan_label(plan).alias("plan"))


@query("acc_invoices", """SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority ELSE CAST(o_orderkey AS VARCHAR) END AS number, round(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE CAST(round(o_totalprice * 100) AS BIGINT) / 100 END, 2) AS amount_paid,
  CASE o_orderkey % 3 WHEN 0 THEN 'EUR' ELSE 'USD' END AS currency, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '' END AS status, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS created_at,
  'https://pay/' || o_orderkey AS hosted_invoice_url, CAST(NULL AS VARCHAR) AS invoice_pdf FROM orders""")
def acc_invoices(spark, sf):
    k = F.col("o_orderkey")
    raw = t(spark, sf, "orders").select(
        k.cast("string").alias("id"), F.when(k % 4 == 0, F.col("o_orderpriority")).when(k % 4 == 1, "").alias("number"), F.when(k % 5 != 0, F.round(F.col("o_totalprice") * 100).cast("long")).alias("amount_paid"),
        F.when(k % 3 == 0, "eur").when(k % 3 == 1, "").alias("currency"), F.when(k % 2 == 0, F.col("o_orderstatus")).alias("status"), F.when(k % 11 != 0, F.unix_timestamp("o_orderdate")).otherwise(F.when(k % 2 == 0, 0)).alias("created"),
        F.concat(F.lit("https://pay/"), k.cast("string")).alias("hosted_invoice_url"), F.lit(None).cast("string").alias("invoice_pdf"))
    return accounts.invoices(raw).withColumn("amount_paid", F.round("amount_paid", 2))


@query("acc_subscriptions", f"""WITH {USERS}, raw AS (SELECT *, 'sub_' || (o_custkey // 5 * 5) AS sub, CASE WHEN o_custkey % 4 = 1 THEN 'Customer#' || lpad(CAST(o_custkey - 1 AS VARCHAR), 9, '0') END AS cust FROM orders),
own AS (SELECT r.*, CASE WHEN o_orderkey % 10 = 0 THEN o_custkey END AS named, s.id AS by_sub, c.id AS by_cust FROM raw r LEFT JOIN (SELECT id FROM users WHERE id % 5 = 0) s ON 'sub_' || s.id = r.sub AND o_orderkey % 3 = 0 LEFT JOIN (SELECT min(id) AS id, customer FROM users GROUP BY 2) c ON c.customer = r.cust),
e AS (SELECT coalesce(named, by_sub, CASE WHEN o_orderstatus <> 'F' THEN by_cust END) AS user_id, o_orderdate AS created, o_orderkey AS seq, o_orderstatus = 'F' AS gone, CASE o_orderstatus WHEN 'O' THEN 'trialing' ELSE 'active' END AS status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'monthly' WHEN '2-HIGH' THEN 'annual' ELSE 'none' END AS plan, CASE WHEN o_orderstatus = 'O' THEN o_orderkey + 86400 END AS trial_end FROM own),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created DESC, seq DESC) AS k, row_number() OVER (PARTITION BY user_id, gone ORDER BY created DESC, seq DESC) AS kk, max(CASE WHEN NOT gone AND status = 'trialing' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS trial_used FROM e WHERE user_id IS NOT NULL)
SELECT n.user_id, CASE WHEN n.gone THEN 'canceled' ELSE n.status END AS status, CASE WHEN n.gone THEN 'none' ELSE n.plan END AS plan, o.trial_end, CAST(n.trial_used AS BIGINT) AS trial_used FROM n LEFT JOIN n o ON o.user_id = n.user_id AND NOT o.gone AND o.kk = 1 WHERE n.k = 1""")
def acc_subscriptions(spark, sf):
    u = accounts.normalised(users(spark, sf)).select("id", "subscription_id", F.col("customer").alias("customer_id"))
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    sub = F.when(k % 3 == 0, F.concat(F.lit("sub_"), (F.floor(c / 5) * 5).cast("string")))
    customer = F.when(c % 4 == 1, F.concat(F.lit("Customer#"), F.lpad((c - 1).cast("string"), 9, "0")))
    o = t(spark, sf, "orders").select(
        F.when(k % 10 == 0, c).alias("user_id"), sub.alias("subscription_id"), customer.alias("customer_id"), F.col("o_orderdate").alias("created"), k.alias("seq"), F.when(F.col("o_orderstatus") == "F", "deleted").otherwise("updated").alias("event_type"),
        F.when(F.col("o_orderstatus") == "O", "Trialing").otherwise("active").alias("status"), F.col("o_orderpriority").alias("price_id"), F.when(F.col("o_orderstatus") == "O", k + 86400).alias("trial_end"))
    return whole(accounts.subscription_fold(accounts.plan_of(accounts.owned(o, u), {"1-URGENT": "monthly", "2-HIGH": "annual"})), "trial_used")
