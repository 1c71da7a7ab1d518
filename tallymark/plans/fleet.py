"""Queries on the relational tables.

An order is a session, its customer the account, the customer's nation the
machine, its region the fleet group; a line item is usage of a model
(``l_returnflag``) on a day; ``o_orderpriority`` is the host of a snapshot.
Amounts are whole cents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.operators import accounts, fleet, months
from tallymark.session import table



def cents(column: str):
    """An amount in whole cents."""
    return F.round(F.col(column) * 100).cast("long")


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumns({"cents": cents("o_totalprice"), "day": F.to_date("o_orderdate")})


def _usage(spark, sf_dir):
    """Line items with their order's customer, nation and region."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", cents("l_extendedprice").alias("cents"), F.col("l_quantity").cast("long").alias("qty"), "l_returnflag", F.to_date("l_shipdate").alias("day"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    regions = table(spark, sf_dir, "region")
    met = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return met.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(regions, F.col("n_regionkey") == F.col("r_regionkey"))


def month_volume_start_rule(spark, sf_dir):
    return months.volume_by_start(_orders(spark, sf_dir), "o_orderdate", F.col("cents"))


def month_days_own_rule(spark, sf_dir):
    return months.days_by_own(table(spark, sf_dir, "lineitem"), F.to_date("l_shipdate"))


def month_buckets(spark, sf_dir):
    return months.buckets(month_volume_start_rule(spark, sf_dir), month_days_own_rule(spark, sf_dir))


MEASURES = ["sessions", "volume", "projects", "active_days"]


def _snapshots(spark, sf_dir):
    """A snapshot per month and host."""
    o = _orders(spark, sf_dir).withColumn("month", F.date_format("day", "yyyy-MM"))
    return o.groupBy("month", F.col("o_orderpriority").alias("host")).agg(F.count(F.lit(1)).alias("sessions"), F.sum("cents").alias("volume"), F.count_distinct("o_custkey").alias("projects"), F.count_distinct("day").alias("active_days"))


def timeline_merge_hosts(spark, sf_dir):
    return months.merge_hosts(_snapshots(spark, sf_dir), MEASURES)


def lifetime_fold(spark, sf_dir):
    return months.lifetime(months.merge_hosts(_snapshots(spark, sf_dir), MEASURES), MEASURES)


def month_merge_max(spark, sf_dir):
    """Snapshots of all orders, and of a later scan that has lost the early half of each month and two hosts."""
    o = _orders(spark, sf_dir).where("day(o_orderdate) > 15 and o_orderpriority not in ('1-URGENT', '5-LOW')").withColumn("month", F.date_format("day", "yyyy-MM"))
    again = o.groupBy("month", F.col("o_orderpriority").alias("host")).agg(F.count(F.lit(1)).alias("sessions"), (F.sum("cents") * 2).alias("volume"))
    return months.merge_rescans(_snapshots(spark, sf_dir), again, ["month", "host"], ["sessions", "volume"])


def velocity_mom(spark, sf_dir):
    return months.change(_snapshots(spark, sf_dir), ["host"], ["sessions", "volume"])


def velocity_slope(spark, sf_dir):
    return months.trend(_snapshots(spark, sf_dir), ["host"], "sessions")


def own_rank(spark, sf_dir):
    return months.own_rank(_snapshots(spark, sf_dir), ["host"], "volume")


def timeline_tail(spark, sf_dir):
    return months.tail(_snapshots(spark, sf_dir), ["host"], 6).select("host", "month", "sessions")


def account_rollup(spark, sf_dir):
    return accounts.fold(_usage(spark, sf_dir), ["o_custkey", "l_returnflag"], ["cents", "qty"])


def _counters(spark, sf_dir):
    """A customer's counter is a thousand times the account balance, if that is above 0, up to a date."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return c.select(F.col("c_custkey").alias("account"), (cents("c_acctbal") * 1000).alias("counter"), F.date_add(F.lit("1996-01-01").cast("date"), (F.col("c_custkey") % 1500).cast("int")).alias("last_computed"))


def _order_days(spark, sf_dir):
    """Cents of each order and day, summed before they meet their order's customer."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", cents("l_extendedprice").alias("cents"), F.to_date("l_shipdate").alias("day"))
    sums = items.groupBy("l_orderkey", "day").agg(F.sum("cents").alias("value"))
    return sums.join(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("account")), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("account", "day").agg(F.sum("value").alias("value"))


def _days(spark, sf_dir):
    return _order_days(spark, sf_dir)


def account_floor(spark, sf_dir):
    return accounts.floor(_days(spark, sf_dir), _counters(spark, sf_dir))


def account_floor_total(spark, sf_dir):
    return accounts.floor_total(account_floor(spark, sf_dir))


def counter_claimed_once(spark, sf_dir):
    """A nation's suppliers share its number of customers; the first supplier claims it."""
    n = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.count(F.lit(1)).alias("counter"))
    s = table(spark, sf_dir, "supplier").join(n, "s_nationkey", "left")
    return accounts.claim_once(s, "s_nationkey", ["s_suppkey"], "counter").select("s_suppkey", "s_nationkey", "counter")


def machine_floor(spark, sf_dir):
    where = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("account"), F.col("n_name").alias("machine"))
    days = _order_days(spark, sf_dir).join(where, "account")
    other = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("machine"), cents("s_acctbal").alias("value"))
    return fleet.machine_floor(days, _counters(spark, sf_dir).join(where, "account"), other)


def machine_provider_matrix(spark, sf_dir):
    return fleet.matrix(_usage(spark, sf_dir), "n_name", "l_returnflag", "cents")


def fleet_hierarchy(spark, sf_dir):
    return fleet.hierarchy(_usage(spark, sf_dir), ["r_name", "n_name", "l_returnflag"], ["cents"])


def roster_never_scanned(spark, sf_dir):
    """Customers who are in no order of 1997 and in no nation of a supplier with a balance above 7000."""
    orders = table(spark, sf_dir, "orders").where("year(o_orderdate) = 1997").select("o_custkey", F.lit(None).cast("int").alias("s_nationkey"))
    suppliers = table(spark, sf_dir, "supplier").where("s_acctbal > 7000").select(F.lit(None).cast("long").alias("o_custkey"), "s_nationkey")
    roster = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return fleet.never_scanned(roster, orders.unionByName(suppliers), {"c_custkey": "o_custkey", "c_nationkey": "s_nationkey"})


def prefix_relabel(spark, sf_dir):
    """Each customer's name cut to 16 or 17 characters meets the supplier registry's longer names."""
    registry = table(spark, sf_dir, "supplier").select(F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("full"), F.col("s_name").alias("label"), "s_suppkey")
    short = table(spark, sf_dir, "customer").select("c_custkey", F.substring(F.col("c_name"), F.lit(1), F.when(F.col("c_custkey") % 2 == 0, 16).otherwise(17)).alias("prefix"))
    return fleet.prefix_relabel(short, registry, "prefix", "full", "label", "s_suppkey")


def missing_accounts(spark, sf_dir):
    """Part types, first words and brands that stand in no supplier's or customer's segment or part's name."""
    needles = table(spark, sf_dir, "part").select(F.explode(F.array(F.lower("p_type"), F.element_at(F.split("p_name", " "), 1), F.lower("p_brand"))).alias("needle")).distinct()
    return fleet.not_contained(needles, "needle", table(spark, sf_dir, "part"), "p_name")


def fleet_distinct(spark, sf_dir):
    return fleet.distinct_over(_usage(spark, sf_dir), ["o_custkey", "l_returnflag", "day"], ["cents"])


def fleet_gate(spark, sf_dir):
    """Orders whose line items do not add up to the whole, were the whole the rounded total price."""
    parts = table(spark, sf_dir, "lineitem").select("l_orderkey", cents("l_extendedprice").alias("cents"))
    wholes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), cents("o_totalprice").alias("cents"))
    bad = fleet.unequal_parts(parts, wholes, ["l_orderkey"], "cents")
    return bad.agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("added").isNull()).alias("no_parts"), F.sum("added").cast("long").alias("added"), F.sum("stated").cast("long").alias("stated"))


QUERIES = {f.__name__: f for f in (month_volume_start_rule, month_days_own_rule, month_buckets, timeline_merge_hosts, lifetime_fold, month_merge_max, velocity_mom, velocity_slope, own_rank, timeline_tail, account_rollup, account_floor, account_floor_total, counter_claimed_once, machine_floor, machine_provider_matrix, fleet_hierarchy, roster_never_scanned, prefix_relabel, missing_accounts, fleet_distinct, fleet_gate)}

_O = "o AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CAST(o_orderdate AS DATE) AS day, strftime(o_orderdate, '%Y-%m') AS month FROM orders)"
_VOL = "vol AS (SELECT month, count(*) AS sessions, CAST(sum(cents) AS BIGINT) AS volume FROM o GROUP BY month)"
_OWN = "own AS (SELECT strftime(d, '%Y-%m') AS month, count(*) AS active_days FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem) GROUP BY month)"
_SNAP = f"{_O}, sn AS (SELECT month, o_orderpriority AS host, count(*) AS sessions, CAST(sum(cents) AS BIGINT) AS volume, count(DISTINCT o_custkey) AS projects, count(DISTINCT day) AS active_days FROM o GROUP BY ALL)"
_TL = "tl AS (SELECT month, count(*) AS hosts, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(volume) AS BIGINT) AS volume, max(projects) AS projects, max(active_days) AS active_days FROM sn GROUP BY month)"
_U = "u AS (SELECT CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS qty, l_returnflag, CAST(l_shipdate AS DATE) AS day, o_custkey, n_name, r_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_C = "c AS (SELECT c_custkey AS account, c_nationkey, CAST(round(c_acctbal * 100) AS BIGINT) * 1000 AS counter, DATE '1996-01-01' + CAST(c_custkey % 1500 AS INT) AS last_computed FROM customer WHERE c_acctbal > 0)"
_FL = f"""{_U}, {_C}, dy AS (SELECT o_custkey AS account, day, sum(cents) AS value FROM u GROUP BY ALL),
f AS (SELECT coalesce(dy.account, c.account) AS account, CAST(coalesce(sum(value), 0) AS BIGINT) AS measured, CAST(coalesce(sum(value) FILTER (WHERE day > last_computed), 0) AS BIGINT) AS after, max(counter) AS counter FROM dy FULL JOIN c ON dy.account = c.account GROUP BY 1),
fl AS (SELECT account, measured, after, counter, CASE WHEN counter IS NULL THEN measured ELSE greatest(counter + after, measured) END AS floor FROM f)"""


def _pct(m: str) -> str:
    lag = f"lag({m}) OVER (PARTITION BY host ORDER BY month)"
    return f"CASE WHEN {lag} > 0 THEN CAST(floor(({m} - {lag}) * 100.0::DOUBLE / {lag} + 0.5) AS BIGINT) END AS {m}_pct"


ORACLES = {
    "month_volume_start_rule": f"WITH {_O}, {_VOL} SELECT * FROM vol",
    "month_days_own_rule": f"WITH {_OWN} SELECT * FROM own",
    "month_buckets": f"WITH {_O}, {_VOL}, {_OWN} SELECT month, coalesce(sessions, 0) AS sessions, coalesce(volume, 0) AS volume, coalesce(active_days, 0) AS active_days FROM vol FULL JOIN own USING (month)",
    "timeline_merge_hosts": f"WITH {_SNAP}, {_TL} SELECT * FROM tl",
    "lifetime_fold": f"WITH {_SNAP}, {_TL} SELECT count(*) AS months, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(volume) AS BIGINT) AS volume, max(projects) AS projects, CAST(sum(active_days) AS BIGINT) AS active_days FROM tl",
    "month_merge_max": f"WITH {_SNAP}, ag AS (SELECT month, o_orderpriority AS host, count(*) AS sessions, CAST(sum(cents) * 2 AS BIGINT) AS volume FROM o WHERE day(o_orderdate) > 15 AND o_orderpriority NOT IN ('1-URGENT', '5-LOW') GROUP BY ALL) SELECT month, host, max(sessions) AS sessions, max(volume) AS volume FROM (SELECT month, host, sessions, volume FROM sn UNION ALL SELECT * FROM ag) GROUP BY ALL",
    "velocity_mom": f"WITH {_SNAP} SELECT host, month, {_pct('sessions')}, {_pct('volume')} FROM sn",
    "velocity_slope": f"WITH {_SNAP}, x AS (SELECT host, month, sessions, row_number() OVER (PARTITION BY host ORDER BY month) - 1 AS i FROM sn) SELECT host, count(*) AS months, max(month) AS latest, round(regr_slope(sessions, i), 4) AS slope FROM x GROUP BY host",
    "own_rank": f"WITH {_SNAP}, a AS (SELECT host, max_by(volume, month) AS latest, count(*) AS months, max(volume) AS best FROM sn GROUP BY host) SELECT a.host, months, latest >= best AS is_best, CAST(floor(count(*) FILTER (WHERE volume < latest) * 100.0::DOUBLE / months + 0.5) AS BIGINT) AS above_pct FROM a JOIN sn ON a.host = sn.host WHERE months >= 3 GROUP BY a.host, months, latest, best",
    "timeline_tail": f"WITH {_SNAP} SELECT host, month, sessions FROM sn QUALIFY row_number() OVER (PARTITION BY host ORDER BY month DESC) <= 6",
    "account_rollup": f"WITH {_U} SELECT o_custkey, l_returnflag, count(*) AS n_rows, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(qty) AS BIGINT) AS qty FROM u GROUP BY ALL",
    "account_floor": f"WITH {_FL} SELECT * FROM fl",
    "account_floor_total": f"WITH {_FL} SELECT CAST(sum(measured) AS BIGINT) AS measured, CAST(sum(coalesce(floor, measured)) AS BIGINT) AS floored FROM fl",
    "counter_claimed_once": "WITH n AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) SELECT s_suppkey, s_nationkey, CASE WHEN row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) = 1 THEN n END AS counter FROM supplier LEFT JOIN n ON c_nationkey = s_nationkey",
    "machine_floor": f"""WITH {_U}, {_C}, a AS (SELECT n_name AS machine, o_custkey AS account, sum(cents) AS measured, coalesce(sum(cents) FILTER (WHERE day > last_computed), 0) AS after, max(counter) AS counter FROM u LEFT JOIN c ON c.account = o_custkey GROUP BY ALL),
m AS (SELECT machine, CAST(sum(measured) AS BIGINT) AS measured, CAST(sum(greatest(measured, coalesce(counter + after, measured))) AS BIGINT) AS floored FROM a GROUP BY machine),
x AS (SELECT n_name AS machine, CAST(sum(CAST(round(s_acctbal * 100) AS BIGINT)) AS BIGINT) AS other FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT machine, coalesce(measured, 0) AS measured, coalesce(other, 0) AS other, coalesce(floored, 0) + coalesce(other, 0) AS floor FROM m FULL JOIN x USING (machine)""",
    "machine_provider_matrix": f"WITH {_U} SELECT n_name, l_returnflag, CAST(sum(cents) AS BIGINT) AS cents FROM u GROUP BY ALL",
    "fleet_hierarchy": f"WITH {_U} SELECT r_name, n_name, l_returnflag, count(*) AS n_rows, CAST(sum(cents) AS BIGINT) AS cents, 3 - grouping(r_name) - grouping(n_name) - grouping(l_returnflag) AS level FROM u GROUP BY ROLLUP (r_name, n_name, l_returnflag)",
    "roster_never_scanned": "SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1997) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > 7000)",
    "prefix_relabel": "WITH r AS (SELECT replace(s_name, 'Supplier', 'Customer') AS f, s_name, s_suppkey FROM supplier), s AS (SELECT c_custkey, substr(c_name, 1, CASE WHEN c_custkey % 2 = 0 THEN 16 ELSE 17 END) AS prefix FROM customer), b AS (SELECT prefix, min_by(s_name, s_suppkey) AS label FROM (SELECT DISTINCT prefix FROM s) JOIN r ON starts_with(f, prefix) GROUP BY prefix) SELECT c_custkey, s.prefix, label FROM s LEFT JOIN b ON s.prefix = b.prefix",
    "missing_accounts": "WITH n AS (SELECT DISTINCT unnest([lower(p_type), string_split(p_name, ' ')[1], lower(p_brand)]) AS needle FROM part), w AS (SELECT DISTINCT lower(p_name) AS w FROM part) SELECT needle FROM n WHERE NOT EXISTS (SELECT 1 FROM w WHERE contains(w, needle))",
    "fleet_distinct": f"WITH {_U} SELECT count(DISTINCT o_custkey) AS n_o_custkey, count(DISTINCT l_returnflag) AS n_l_returnflag, count(DISTINCT day) AS n_day, CAST(sum(cents) AS BIGINT) AS cents FROM u",
    "fleet_gate": "WITH p AS (SELECT l_orderkey AS k, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS added FROM lineitem GROUP BY 1), w AS (SELECT o_orderkey AS k, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS stated FROM orders GROUP BY 1) SELECT count(*) AS orders, count(*) FILTER (WHERE added IS NULL) AS no_parts, CAST(sum(added) AS BIGINT) AS added, CAST(sum(stated) AS BIGINT) AS stated FROM p FULL JOIN w USING (k) WHERE added IS DISTINCT FROM stated",
}
