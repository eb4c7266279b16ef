"""DuckDB twins of the registered queries.

Each entry is plain SQL over the driver's pre-registered views (``customer``,
``orders``, ``lineitem``, ``events`` …).  The fixture views are repeated as
``WITH`` clauses in DuckDB's dialect; the query bodies are written
independently of the Spark code paths they check.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# fixture views (DuckDB dialect)
# --------------------------------------------------------------------------

U = "CAST('0x' || substr(md5(CAST({id} AS VARCHAR) || ':{seed}'), 1, 8) AS BIGINT)"


def u(id_expr: str, seed: str | int = 42) -> str:
    return U.format(id=id_expr, seed=seed)


FIXTURES = {
    "fx_base": """
  SELECT c_custkey AS case_id,
         CAST(c_custkey % 92 AS INTEGER) AS WEEK_NUM,
         DATE '2019-01-01' + CAST(7 * (c_custkey % 92) AS INTEGER) AS date_decision,
         CAST(year(DATE '2019-01-01' + CAST(7 * (c_custkey % 92) AS INTEGER)) * 100
              + month(DATE '2019-01-01' + CAST(7 * (c_custkey % 92) AS INTEGER)) AS INTEGER) AS "MONTH",
         CAST(c_acctbal < 0 AS INTEGER) AS target,
         CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS maininc_215A,
         CAST(100 * (c_custkey % 50) AS DOUBLE) AS currdebt_22A,
         CASE WHEN c_custkey % 11 = 0 THEN 'a55475b1' ELSE c_mktsegment END AS segment_1M,
         CASE WHEN c_custkey % 10 = 0 THEN c_acctbal END AS sparse_2A
  FROM customer""",
    "fx_depth1": """
  SELECT o_custkey AS case_id,
         o_orderkey AS num_group1,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS totalprice_3A,
         CAST(o_orderdate AS DATE) AS orderdate_4D,
         CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END AS priority_5M,
         CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE o_orderkey % 4 END AS items_6L,
         o_orderkey % 3 AS shard,
         o_orderkey
  FROM orders""",
    "fx_depth2": """
  SELECT d.case_id, d.num_group1,
         CAST(l.l_linenumber - 1 AS INTEGER) AS num_group2,
         l.l_extendedprice AS amount_7A, l.l_quantity AS qty_8L,
         CAST(l.l_shipdate AS DATE) AS ship_9D, l.l_returnflag AS flag_10M
  FROM lineitem l JOIN fx_depth1 d ON l.l_orderkey = d.o_orderkey""",
    "fx_label": """
  SELECT l_orderkey,
         CAST(avg(CAST(round(l_discount * 100) AS INTEGER)) >= 8 AS INTEGER) AS actual_label
  FROM lineitem GROUP BY l_orderkey""",
    "fx_scores": "\n  SELECT l_orderkey AS case_id, actual_label,\n" + ",\n".join(
        f"         CAST({u('l_orderkey', s)} % 800 + 200 * actual_label AS DOUBLE) / 1000.0 AS score_{s}"
        for s in "abcde") + "\n  FROM fx_label",
    "fx_score_a": """
  SELECT case_id, score_a AS score, actual_label FROM fx_scores""",
}

# fixture dependencies, in definition order
FIXTURE_DEPS = {
    "fx_base": [],
    "fx_depth1": [],
    "fx_depth2": ["fx_depth1"],
    "fx_label": [],
    "fx_scores": ["fx_label"],
    "fx_score_a": ["fx_scores"],
}


def with_fixtures(body: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with the fixture CTEs it needs (plus optional extra CTEs)."""
    ordered: list[str] = []

    def add(n: str) -> None:
        for d in FIXTURE_DEPS[n]:
            add(d)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({FIXTURES[n]}\n)" for n in ordered]
    ctes += [f"{n} AS (\n{sql}\n)" for n, sql in (extra or [])]
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body


def nunique(c: str) -> str:
    return f"CAST(count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT)"


def date_mean(c: str) -> str:
    return (f"DATE '1970-01-01' + CAST(floor(avg(datediff('day', DATE '1970-01-01', {c}))) AS INTEGER)")


def snap(expr: str) -> str:
    """Same two-step half-up rounding as ``functions.exprs.snap``."""
    x = f"CAST({expr} AS DOUBLE)"
    return (f"CASE WHEN abs({x}) < 1e9 THEN floor(floor({x} * 1e9 + CAST(0.5 AS DOUBLE)) / 1e9 * 1e6"
            f" + CAST(0.5 AS DOUBLE)) / 1e6 ELSE {x} END")


def snapped(sql: str, cols: list[str]) -> str:
    """Wrap a query so the listed double columns are snapped like the Spark side."""
    repl = ", ".join(f"{snap(c)} AS {c}" for c in cols)
    return f"SELECT * REPLACE ({repl}) FROM (\n{sql}\n) q"


# roll-up bodies, written out column by column
ROLLUP_D1 = f"""
  SELECT case_id,
         max(num_group1) AS num_group1_max,
         {nunique('num_group1')} AS num_group1_nunique,
         avg(totalprice_3A) AS totalprice_3A_mean,
         max(totalprice_3A) AS totalprice_3A_max,
         min(totalprice_3A) AS totalprice_3A_min,
         stddev_samp(totalprice_3A) AS totalprice_3A_std,
         {date_mean('orderdate_4D')} AS orderdate_4D_mean,
         arg_min_null(priority_5M, num_group1) AS priority_5M_first,
         arg_max_null(priority_5M, num_group1) AS priority_5M_last,
         {nunique('priority_5M')} AS priority_5M_nunique,
         CAST(coalesce(sum(items_6L), 0) AS BIGINT) AS items_6L_sum,
         max(items_6L) AS items_6L_max,
         min(items_6L) AS items_6L_min,
         count(*) AS record_count
  FROM {{src}} GROUP BY case_id"""

ROLLUP_D2 = f"""
  SELECT case_id,
         max(num_group1) AS num_group1_max,
         {nunique('num_group1')} AS num_group1_nunique,
         max(num_group2) AS num_group2_max,
         {nunique('num_group2')} AS num_group2_nunique,
         avg(amount_7A) AS amount_7A_mean,
         max(amount_7A) AS amount_7A_max,
         min(amount_7A) AS amount_7A_min,
         stddev_samp(amount_7A) AS amount_7A_std,
         CAST(coalesce(sum(qty_8L), 0) AS DOUBLE) AS qty_8L_sum,
         max(qty_8L) AS qty_8L_max,
         min(qty_8L) AS qty_8L_min,
         {date_mean('ship_9D')} AS ship_9D_mean,
         arg_min_null(flag_10M, (num_group1, num_group2, flag_10M)) AS flag_10M_first,
         arg_max_null(flag_10M, (num_group1, num_group2, flag_10M)) AS flag_10M_last,
         {nunique('flag_10M')} AS flag_10M_nunique,
         count(*) AS record_count
  FROM {{src}} GROUP BY case_id"""



FIXTURES["fx_case_scores"] = f"""
  SELECT case_id, CAST({u('case_id', 's')} % 800 + 200 * target AS DOUBLE) / 1000.0 AS score,
         target AS actual_label
  FROM fx_base"""
FIXTURE_DEPS["fx_case_scores"] = ["fx_base"]


def _day(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


FIXTURES["fx_rfm"] = f"""
  SELECT user_id AS case_id,
         CASE WHEN user_id % 17 = 0 THEN 'bad'
              ELSE {_day("max(CASE WHEN event_type = 'error' THEN ts END)")} END AS lastrejectdate_50D,
         {_day("max(CASE WHEN event_type = 'purchase' THEN ts END)")} AS lastapprdate_640D,
         {_day("max(CASE WHEN event_type = 'click' THEN ts END)")} AS dtlastpmtallstes_4499206D,
         {_day("min(CASE WHEN event_type = 'view' THEN ts END)")} AS datefirstoffer_1144D,
         {_day("max(CASE WHEN event_type = 'signup' THEN ts END)")} AS datelastunpaid_3546854D,
         {_day("min(ts)")} AS dateofcredstart_739D,
         CAST(count_if(event_type = 'signup') AS BIGINT) AS applications30d_658L,
         CAST(count_if(event_type = 'error') AS BIGINT) AS numrejects9m_859L,
         CAST(count_if(event_type = 'purchase') AS BIGINT) AS cntpmts24_3658933L,
         CAST(count_if(event_type = 'click') AS BIGINT) AS numincomingpmts_3546848L,
         CAST(count_if(event_type = 'view') AS BIGINT) AS numinstpaidearly5d_1087L,
         count(*) AS numinstls_657L,
         CAST(count_if(event_type = 'error') AS BIGINT) AS numinstunpaidmax_3546851L,
         count(DISTINCT event_type) AS numactivecreds_622L,
         count(DISTINCT CAST(ts AS DATE)) AS opencred_647L,
         sum(value) AS credamount_770A,
         max(value) AS maininc_215A,
         avg(value) AS outstandingamount_362A_mean,
         avg(CASE WHEN event_type = 'purchase' THEN value END) AS avgpmtlast12m_4525200A,
         sum(CASE WHEN event_type = 'view' THEN value END) AS amtinstpaidbefduel24m_4187115A,
         sum(CASE WHEN event_type = 'error' THEN value END) AS currdebt_22A,
         min(value) AS amtdepositbalance_4809441A,
         sum(CASE WHEN event_type = 'click' THEN value END) AS annuity_780A
  FROM events GROUP BY user_id"""
FIXTURE_DEPS["fx_rfm"] = []

FIXTURES["fx_flags"] = """
  SELECT event_id AS case_id,
         CASE WHEN event_type = 'purchase' THEN 'approved' ELSE event_type END AS application_status,
         CASE WHEN event_type IN ('click', 'view') THEN 'active' ELSE 'closed' END AS contract_status,
         ts AS event_date
  FROM events"""
FIXTURE_DEPS["fx_flags"] = []

FIXTURES["fx_strings"] = """
  SELECT event_id AS case_id,
         CASE WHEN event_id % 17 = 0 THEN 'bad' ELSE CAST(value AS VARCHAR) END AS value_txt,
         props, event_type
  FROM events"""
FIXTURE_DEPS["fx_strings"] = []

# build_base as CTEs: d1s, d2s, r1, r2, bb
BB_CTES = [
    ("d1s", "  SELECT * FROM fx_depth1 WHERE case_id IN (SELECT case_id FROM fx_base)"),
    ("d2s", "  SELECT * FROM fx_depth2 WHERE case_id IN (SELECT case_id FROM fx_base)"),
    ("r1", ROLLUP_D1.format(src="d1s")),
    ("r2", ROLLUP_D2.format(src="d2s")),
    ("bb", """  SELECT b.*,
       r1.num_group1_max AS d1_num_group1_max, r1.num_group1_nunique AS d1_num_group1_nunique,
       r1.totalprice_3A_mean, r1.totalprice_3A_max, r1.totalprice_3A_min, r1.totalprice_3A_std,
       r1.orderdate_4D_mean, r1.priority_5M_first, r1.priority_5M_last, r1.priority_5M_nunique,
       r1.items_6L_sum, r1.items_6L_max, r1.items_6L_min, r1.record_count AS d1_record_count,
       r2.num_group1_max AS d2_num_group1_max, r2.num_group1_nunique AS d2_num_group1_nunique,
       r2.num_group2_max, r2.num_group2_nunique,
       r2.amount_7A_mean, r2.amount_7A_max, r2.amount_7A_min, r2.amount_7A_std,
       r2.qty_8L_sum, r2.qty_8L_max, r2.qty_8L_min, r2.ship_9D_mean,
       r2.flag_10M_first, r2.flag_10M_last, r2.flag_10M_nunique, r2.record_count AS d2_record_count
  FROM fx_base b
  LEFT JOIN r1 ON b.case_id = r1.case_id
  LEFT JOIN r2 ON b.case_id = r2.case_id"""),
]

# columns of the merged table and their kinds
BB_COLS = [
    ("case_id", "bigint"), ("WEEK_NUM", "int"), ("date_decision", "date"), ("MONTH", "int"), ("target", "int"),
    ("maininc_215A", "double"), ("currdebt_22A", "double"), ("segment_1M", "string"), ("sparse_2A", "double"),
    ("d1_num_group1_max", "bigint"), ("d1_num_group1_nunique", "bigint"),
    ("totalprice_3A_mean", "double"), ("totalprice_3A_max", "double"), ("totalprice_3A_min", "double"),
    ("totalprice_3A_std", "double"), ("orderdate_4D_mean", "date"), ("priority_5M_first", "string"),
    ("priority_5M_last", "string"), ("priority_5M_nunique", "bigint"), ("items_6L_sum", "bigint"),
    ("items_6L_max", "bigint"), ("items_6L_min", "bigint"), ("d1_record_count", "bigint"),
    ("d2_num_group1_max", "bigint"), ("d2_num_group1_nunique", "bigint"), ("num_group2_max", "int"),
    ("num_group2_nunique", "bigint"), ("amount_7A_mean", "double"), ("amount_7A_max", "double"),
    ("amount_7A_min", "double"), ("amount_7A_std", "double"), ("qty_8L_sum", "double"), ("qty_8L_max", "double"),
    ("qty_8L_min", "double"), ("ship_9D_mean", "date"), ("flag_10M_first", "string"), ("flag_10M_last", "string"),
    ("flag_10M_nunique", "bigint"), ("d2_record_count", "bigint"),
]
D1_DOUBLES = ["totalprice_3A_mean", "totalprice_3A_std"]
D2_DOUBLES = ["amount_7A_mean", "amount_7A_std", "qty_8L_sum"]
BB_DOUBLES = D1_DOUBLES + D2_DOUBLES
NUMERIC_KINDS = ("bigint", "int", "double")
IDS = ("target", "case_id", "date_decision", "MONTH", "WEEK_NUM")
SQL_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE"}


def bb_sql(body: str, *more: str, extra: list[tuple[str, str]] | None = None) -> str:
    return with_fixtures(body, "fx_base", "fx_depth2", *more, extra=BB_CTES + (extra or []))


# cleaned merged table: drop sparse_2A (90% null), sentinel -> null, numeric nulls -> 0
CB_COLS = [(c, k) for c, k in BB_COLS if c != "sparse_2A"]


def _clean_expr(c: str, k: str) -> str:
    if k in NUMERIC_KINDS:
        return f"CAST(coalesce({c}, 0) AS {SQL_TYPE[k]}) AS {c}"
    if k == "string":
        return f"nullif({c}, 'a55475b1') AS {c}"
    return c


CB_CTE = ("cb", "  SELECT " + ",\n         ".join(_clean_expr(c, k) for c, k in CB_COLS) + "\n  FROM bb")
WINSOR_COLS = [c for c, k in CB_COLS if k in NUMERIC_KINDS and c not in IDS]
INT_COLS = [c for c, k in CB_COLS if k in ("bigint", "int")]


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def rank_u(partition: str | None, src: str, key: str = "case_id", seed: str = "42") -> str:
    part = f"PARTITION BY {partition} " if partition else ""
    return f"row_number() OVER ({part}ORDER BY {u(key, seed)}, {key})"


def _r(a: str, b: str) -> str:
    """coalesce(a / b, 0) in double."""
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"


ORACLE: dict[str, str] = {}

# ------------------------------------------------------------------ roll-ups
ORACLE["rollup_depth1"] = with_fixtures(snapped("SELECT * FROM r1", D1_DOUBLES), "fx_depth1",
                                        extra=[("r1", ROLLUP_D1.format(src="fx_depth1"))])
ORACLE["rollup_depth2"] = with_fixtures(snapped("SELECT * FROM r2", D2_DOUBLES), "fx_depth2",
                                        extra=[("r2", ROLLUP_D2.format(src="fx_depth2"))])
ORACLE["rollup_exact"] = ORACLE["rollup_depth1"]
ORACLE["build_base"] = bb_sql(snapped("SELECT * FROM bb", BB_DOUBLES))

ORACLE["date_mean"] = with_fixtures(f"""
SELECT case_id, {date_mean('orderdate_4D')} AS orderdate_4D_mean, count(*) AS record_count
FROM fx_depth1 GROUP BY case_id""", "fx_depth1")

ORACLE["first_last"] = with_fixtures(f"""
SELECT case_id,
       max(num_group1) AS num_group1_max, {nunique('num_group1')} AS num_group1_nunique,
       max(num_group2) AS num_group2_max, {nunique('num_group2')} AS num_group2_nunique,
       arg_min_null(flag_10M, (num_group1, num_group2, flag_10M)) AS flag_10M_first,
       arg_max_null(flag_10M, (num_group1, num_group2, flag_10M)) AS flag_10M_last,
       {nunique('flag_10M')} AS flag_10M_nunique,
       count(*) AS record_count
FROM fx_depth2 GROUP BY case_id""", "fx_depth2")

ORACLE["nunique_with_null"] = with_fixtures(f"""
SELECT case_id,
       max(num_group1) AS num_group1_max, {nunique('num_group1')} AS num_group1_nunique,
       arg_min_null(priority_5M, num_group1) AS priority_5M_first,
       arg_max_null(priority_5M, num_group1) AS priority_5M_last,
       {nunique('priority_5M')} AS priority_5M_nunique,
       count(*) AS record_count
FROM fx_depth1 GROUP BY case_id""", "fx_depth1")

PARTIAL_D1 = ROLLUP_D1.replace("SELECT case_id,", "SELECT case_id, shard,").replace(
    "GROUP BY case_id", "GROUP BY case_id, shard")


def _partials(batch: int) -> str:
    return f"""
  SELECT case_id, CAST(floor(shard / {batch}) AS BIGINT) AS chunk,
         avg(num_group1_max) AS num_group1_max,
         CAST(sum(num_group1_nunique) AS BIGINT) AS num_group1_nunique,
         avg(totalprice_3A_mean) AS totalprice_3A_mean,
         avg(totalprice_3A_max) AS totalprice_3A_max,
         avg(totalprice_3A_min) AS totalprice_3A_min,
         avg(totalprice_3A_std) AS totalprice_3A_std,
         {date_mean('orderdate_4D_mean')} AS orderdate_4D_mean,
         CAST(NULL AS VARCHAR) AS priority_5M_first,
         CAST(NULL AS VARCHAR) AS priority_5M_last,
         CAST(sum(priority_5M_nunique) AS BIGINT) AS priority_5M_nunique,
         CAST(sum(items_6L_sum) AS BIGINT) AS items_6L_sum,
         avg(items_6L_max) AS items_6L_max,
         avg(items_6L_min) AS items_6L_min,
         CAST(sum(record_count) AS BIGINT) AS record_count
  FROM pf GROUP BY case_id, CAST(floor(shard / {batch}) AS BIGINT)"""


PARTIAL_DOUBLES = ["num_group1_max", "totalprice_3A_mean", "totalprice_3A_max", "totalprice_3A_min",
                   "totalprice_3A_std", "items_6L_max", "items_6L_min"]
ORACLE["rollup_partials"] = with_fixtures(snapped("SELECT * FROM parts", PARTIAL_DOUBLES), "fx_depth1", extra=[
    ("pf", PARTIAL_D1.format(src="fx_depth1")), ("parts", _partials(2))])


def _fold(col: str) -> str:
    # fold of non-null values v1..vk in chunk order: v1 / 2^(k-1) + sum_{j>=2} vj / 2^(k-j+1)
    return (f"sum(CASE WHEN {col} IS NULL THEN NULL WHEN rk_{col} = 1 THEN CAST({col} AS DOUBLE) / pow(2, k_{col} - 1) "
            f"ELSE CAST({col} AS DOUBLE) / pow(2, k_{col} - rk_{col} + 1) END)")


FOLD_NUM = ["num_group1_max", "num_group1_nunique", "totalprice_3A_mean", "totalprice_3A_max", "totalprice_3A_min",
            "totalprice_3A_std", "priority_5M_nunique", "items_6L_sum", "items_6L_max", "items_6L_min", "record_count"]
_fold_rank = ",\n         ".join(
    f"CASE WHEN {c} IS NULL THEN NULL ELSE count({c}) OVER (PARTITION BY case_id, {c} IS NULL ORDER BY chunk "
    f"ROWS UNBOUNDED PRECEDING) END AS rk_{c}, count({c}) OVER (PARTITION BY case_id) AS k_{c}"
    for c in FOLD_NUM + ["od"])
ORACLE["fold_chunks"] = with_fixtures(snapped("""
SELECT case_id, """ + ",\n       ".join(f"{_fold(c)} AS {c}" for c in FOLD_NUM) + """,
       DATE '1970-01-01' + CAST(floor(""" + _fold("od") + """) AS INTEGER) AS orderdate_4D_mean,
       CAST(NULL AS VARCHAR) AS priority_5M_first, CAST(NULL AS VARCHAR) AS priority_5M_last
FROM ranked GROUP BY case_id""", FOLD_NUM), "fx_depth1", extra=[
    ("pf", PARTIAL_D1.format(src="fx_depth1")), ("parts", _partials(1)),
    ("parts2", "  SELECT *, CAST(datediff('day', DATE '1970-01-01', orderdate_4D_mean) AS DOUBLE) AS od FROM parts"),
    ("ranked", "  SELECT *, " + _fold_rank + " FROM parts2"),
])

ORACLE["dedup_first"] = """
SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, o_orderstatus,
                               o_totalprice, o_orderpriority) AS rn
  FROM orders) WHERE rn = 1"""

# ------------------------------------------------------------------ sources, projections
ORACLE["scan_base"] = with_fixtures("SELECT * FROM fx_base", "fx_base")
ORACLE["union_shards"] = with_fixtures(
    "SELECT case_id, num_group1, totalprice_3A, orderdate_4D, priority_5M, items_6L, shard FROM fx_depth1", "fx_depth1")
ORACLE["union_relaxed"] = with_fixtures(snapped("""
SELECT case_id, num_group1, totalprice_3A, orderdate_4D, priority_5M, items_6L, shard FROM fx_depth1 WHERE shard = 0
UNION ALL BY NAME
SELECT case_id, num_group1, CAST(CAST(totalprice_3A AS FLOAT) AS DOUBLE) AS totalprice_3A, orderdate_4D, items_6L, shard
FROM fx_depth1 WHERE shard = 1
UNION ALL BY NAME
SELECT case_id, num_group1, totalprice_3A, priority_5M, CAST(items_6L AS INTEGER) AS items_6L, shard
FROM fx_depth1 WHERE shard = 2""", ["totalprice_3A"]), "fx_depth1")
ORACLE["csv_lineage"] = """
SELECT c.*, 'file_' || f.rank || '.csv' AS file_name FROM customer c JOIN (
  SELECT c_nationkey, row_number() OVER (ORDER BY 'nation=' || c_nationkey || '/') AS rank
  FROM (SELECT DISTINCT c_nationkey FROM customer)) f USING (c_nationkey)"""
ORACLE["select_allowlist"] = bb_sql(snapped(
    "SELECT case_id, target, maininc_215A, totalprice_3A_mean, amount_7A_std, d1_record_count FROM bb",
    ["totalprice_3A_mean", "amount_7A_std"]))
ORACLE["project_features"] = bb_sql(snapped(
    "SELECT case_id, target, date_decision, amount_7A_mean, totalprice_3A_max, items_6L_sum AS items_total FROM bb",
    ["amount_7A_mean"]))
ORACLE["filter_label"] = with_fixtures("SELECT * FROM fx_base WHERE target = 1", "fx_base")

# ------------------------------------------------------------------ cleaning
ORACLE["null_profile"] = bb_sql(snapped(_union([
    f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS null_count, "
    f"CAST(count(*) - count({c}) AS DOUBLE) / count(*) AS null_ratio, "
    f"CAST(count(*) - count({c}) AS DOUBLE) / count(*) <= 0.8 AS keep FROM bb" for c, _ in BB_COLS]),
    ["null_ratio"]))
ORACLE["drop_sparse"] = bb_sql(snapped("SELECT * EXCLUDE (sparse_2A) FROM bb", BB_DOUBLES))
ORACLE["sentinel_null"] = with_fixtures(
    "SELECT * REPLACE (nullif(segment_1M, 'a55475b1') AS segment_1M) FROM fx_base", "fx_base")
ORACLE["fill_zero"] = bb_sql(snapped("SELECT " + ", ".join(
    f"CAST(coalesce({c}, 0) AS {SQL_TYPE[k]}) AS {c}" if k in NUMERIC_KINDS else c for c, k in BB_COLS)
    + " FROM bb", BB_DOUBLES))

_bounds = ", ".join(f"quantile_disc({c}, 0.01) AS lo_{c}, quantile_disc({c}, 0.99) AS hi_{c}" for c in WINSOR_COLS)
_clip = {c: f"CASE WHEN {c} < lo_{c} THEN lo_{c} WHEN {c} > hi_{c} THEN hi_{c} ELSE {c} END AS {c}"
         for c in WINSOR_COLS}
ORACLE["winsorize"] = bb_sql(snapped("SELECT " + ", ".join(_clip.get(c, c) for c, _ in CB_COLS) + " FROM cb, qb",
                                     [c for c in BB_DOUBLES]), extra=[CB_CTE, ("qb", f"  SELECT {_bounds} FROM cb")])
ORACLE["quantile_bounds"] = bb_sql(snapped(_union([
    f"SELECT '{c}' AS \"column\", CAST(quantile_disc({c}, 0.01) AS DOUBLE) AS q_low, "
    f"CAST(quantile_disc({c}, 0.99) AS DOUBLE) AS q_high FROM cb" for c in WINSOR_COLS]), ["q_low", "q_high"]),
    extra=[CB_CTE])
_shrink = ("CASE WHEN min_value >= -128 AND max_value <= 127 THEN 'tinyint' "
           "WHEN min_value >= -32768 AND max_value <= 32767 THEN 'smallint' "
           "WHEN min_value >= -2147483648 AND max_value <= 2147483647 THEN 'int' ELSE 'bigint' END")
ORACLE["shrink_types"] = bb_sql(f"SELECT \"column\", min_value, max_value, {_shrink} AS shrunk_type FROM (\n" + _union([
    f"SELECT '{c}' AS \"column\", CAST(min({c}) AS BIGINT) AS min_value, CAST(max({c}) AS BIGINT) AS max_value FROM cb"
    for c in INT_COLS]) + "\n) t", extra=[CB_CTE])
_int_type = _shrink.replace("min_value", "CAST(min({c}) AS BIGINT)").replace("max_value", "CAST(max({c}) AS BIGINT)")
ORACLE["shrink_table"] = bb_sql(snapped(_union([
    f"SELECT '{c}' AS \"column\", " + (_int_type.replace("{c}", c) if c in INT_COLS else
    f"CASE WHEN count_if(CAST(CAST({c} AS FLOAT) AS DOUBLE) IS DISTINCT FROM {c}) = 0 THEN 'float' ELSE 'double' END")
    + f" AS type, CAST(sum({c}) AS DOUBLE) AS total, count({c}) AS n FROM cb" for c in dict.fromkeys([*INT_COLS, *WINSOR_COLS])]),
    ["total"]), extra=[CB_CTE])
ORACLE["numeric_features"] = bb_sql(snapped("SELECT case_id, " + ", ".join(WINSOR_COLS) + " FROM cb",
                                            [c for c in BB_DOUBLES]), extra=[CB_CTE])

RFM_STRINGS = ["lastrejectdate_50D", "lastapprdate_640D", "dtlastpmtallstes_4499206D", "datefirstoffer_1144D",
               "datelastunpaid_3546854D", "dateofcredstart_739D"]
RFM_NUMERIC = ["case_id", "applications30d_658L", "numrejects9m_859L", "cntpmts24_3658933L",
               "numincomingpmts_3546848L", "numinstpaidearly5d_1087L", "numinstls_657L", "numinstunpaidmax_3546851L",
               "numactivecreds_622L", "opencred_647L", "credamount_770A", "maininc_215A",
               "outstandingamount_362A_mean", "avgpmtlast12m_4525200A", "amtinstpaidbefduel24m_4187115A",
               "currdebt_22A", "amtdepositbalance_4809441A", "annuity_780A"]
ORACLE["infer_types"] = with_fixtures(snapped(_union(
    [f"SELECT '{c}' AS \"column\", s AS parsed_share, CASE WHEN s >= 0.5 THEN 'date' ELSE 'categorical' END AS inferred "
     f"FROM (SELECT coalesce(CAST(count_if(TRY_CAST({c} AS DATE) IS NOT NULL) AS DOUBLE) / nullif(count({c}), 0), 0.0) AS s "
     f"FROM fx_rfm)" for c in RFM_STRINGS]
    + [f"SELECT '{c}' AS \"column\", CAST(NULL AS DOUBLE) AS parsed_share, 'numeric' AS inferred" for c in RFM_NUMERIC]),
    ["parsed_share"]), "fx_rfm")
ORACLE["flag_features"] = with_fixtures("""
SELECT *, CAST(application_status = 'approved' AS TINYINT) AS is_approved,
       CAST(contract_status = 'active' AS TINYINT) AS is_active,
       CAST(date_sub('day', event_date, TIMESTAMP '2024-12-31 00:00:00') <= 180 AS TINYINT) AS event_last_6m,
       CAST(date_sub('day', event_date, TIMESTAMP '2024-12-31 00:00:00') <= 365 AS TINYINT) AS event_last_1y
FROM fx_flags""", "fx_flags")


def _holdout_test(src: str) -> list[tuple[str, str]]:
    return [
        ("hn", f"  SELECT count(*) // 10 AS n_test FROM {src}"),
        ("hr", f"  SELECT case_id, target, {rank_u('target', src)} AS rn FROM {src}"),
        ("htest", "  SELECT case_id FROM hr, hn WHERE (target = 1 AND rn <= n_test // 10) "
                  "OR (target = 0 AND rn <= n_test - n_test // 10)"),
    ]


_mode = lambda c: (f"(SELECT {c} FROM train WHERE {c} IS NOT NULL GROUP BY {c} "  # noqa: E731
                   f"ORDER BY count(*) DESC, {c} ASC LIMIT 1)")
ORACLE["impute_median_mode"] = bb_sql(snapped(f"""
SELECT case_id, target,
       coalesce(maininc_215A, m1) AS maininc_215A, coalesce(sparse_2A, m2) AS sparse_2A,
       coalesce(totalprice_3A_mean, m3) AS totalprice_3A_mean,
       coalesce(priority_5M_last, {_mode('priority_5M_last')}) AS priority_5M_last,
       coalesce(segment_1M, {_mode('segment_1M')}) AS segment_1M
FROM src, fit""", ["maininc_215A", "sparse_2A", "totalprice_3A_mean"]), extra=[
    ("src", "  SELECT case_id, target, maininc_215A, sparse_2A, totalprice_3A_mean, priority_5M_last, "
            "nullif(segment_1M, 'a55475b1') AS segment_1M FROM bb"),
    *_holdout_test("src"),
    ("train", "  SELECT * FROM src WHERE case_id NOT IN (SELECT case_id FROM htest)"),
    ("fit", "  SELECT quantile_cont(maininc_215A, 0.5) AS m1, quantile_cont(sparse_2A, 0.5) AS m2, "
            "quantile_cont(totalprice_3A_mean, 0.5) AS m3 FROM train"),
])
ORACLE["coerce_numeric"] = with_fixtures("""
SELECT case_id, coalesce(TRY_CAST(value_txt AS DOUBLE), 0.0) AS value_txt,
       coalesce(TRY_CAST(props AS DOUBLE), 0.0) AS props, event_type
FROM fx_strings""", "fx_strings")
ORACLE["cast_columns"] = with_fixtures("""
SELECT case_id, CAST(WEEK_NUM AS VARCHAR) AS WEEK_NUM, date_decision, "MONTH", CAST(target AS FLOAT) AS target,
       CAST(maininc_215A AS FLOAT) AS maininc_215A, CAST(currdebt_22A AS FLOAT) AS currdebt_22A,
       segment_1M, sparse_2A
FROM fx_base""", "fx_base")

# ------------------------------------------------------------------ joins and splits
ORACLE["join_static"] = with_fixtures("""
SELECT b.case_id, b.WEEK_NUM, b.date_decision, b."MONTH", b.target,
       b.maininc_215A, b.currdebt_22A, b.segment_1M, b.sparse_2A,
       c.opened_14D, c.cb_orderkey, c.status_12M, c.price_13A
FROM fx_base b LEFT JOIN cbf c ON b.case_id = c.case_id""", "fx_base", extra=[
    ("cbf", """  SELECT case_id, opened_14D, cb_orderkey, status_12M, price_13A FROM (
    SELECT o_custkey AS case_id, CAST(o_orderdate AS DATE) AS opened_14D, o_orderkey AS cb_orderkey,
           o_orderstatus AS status_12M, o_totalprice AS price_13A,
           row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey,
                              o_orderstatus, o_totalprice) AS rn
    FROM orders) WHERE rn = 1""")])
_CASE_COLS = ", ".join(f'"{c}"' for c, _ in BB_COLS[:9])
ORACLE["merge_stage"] = (f"SELECT * FROM ({ORACLE['join_static']}) j JOIN (SELECT case_id, * EXCLUDE ({_CASE_COLS}) "
                         f"FROM ({ORACLE['build_base']})) r USING (case_id)")
_sample = [("sn", f"  SELECT case_id FROM (SELECT case_id, {rank_u(None, 'fx_base')} AS rn FROM fx_base) "
                  "WHERE rn <= (SELECT count(*) // 3 FROM fx_base)")]
ORACLE["sample_n"] = with_fixtures("SELECT * FROM fx_base WHERE case_id IN (SELECT case_id FROM sn)", "fx_base",
                                   extra=_sample)
ORACLE["semi_sampled"] = with_fixtures(
    "SELECT case_id, num_group1, totalprice_3A, orderdate_4D, priority_5M, items_6L, shard FROM fx_depth1 "
    "WHERE case_id IN (SELECT case_id FROM sn)", "fx_base", "fx_depth1", extra=_sample)
ORACLE["holdout_split"] = with_fixtures("""
SELECT *, CASE WHEN case_id IN (SELECT case_id FROM htest) THEN 'test' ELSE 'train' END AS split
FROM fx_base""", "fx_base", extra=_holdout_test("fx_base"))
ORACLE["anti_holdout"] = with_fixtures("SELECT * FROM fx_base WHERE case_id NOT IN (SELECT case_id FROM htest)",
                                       "fx_base", extra=_holdout_test("fx_base"))
ORACLE["join_scores"] = with_fixtures("SELECT case_id, actual_label, " + ", ".join(
    f"CAST(score_{s} >= 0.5 AS INTEGER) AS prediction_{s}" for s in "abcde") + " FROM fx_scores", "fx_scores")
_class_rank = [("cr", f"  SELECT case_id, target, {rank_u('target', 'fx_base')} AS rn, "
                      "count(*) OVER (PARTITION BY target) AS nc FROM fx_base")]
ORACLE["stratified_split"] = with_fixtures(
    "SELECT case_id, target, CAST(rn <= ceil(0.2 * nc) AS INTEGER) AS is_valid FROM cr", "fx_base", extra=_class_rank)
ORACLE["stratified_kfold"] = with_fixtures(
    "SELECT case_id, target, CAST((rn - 1) % 5 AS INTEGER) AS fold FROM cr", "fx_base", extra=_class_rank)
ORACLE["undersample"] = with_fixtures("""
SELECT case_id, target, maininc_215A FROM fx_base WHERE case_id IN (
  SELECT case_id FROM cr, (SELECT count_if(target = 1) AS n1, count_if(target = 0) AS n0 FROM fx_base) c
  WHERE (target = 1 AND rn <= n1)
     OR (target = 0 AND rn <= least(n0, CAST(floor(CAST(n1 AS DOUBLE) / CAST(0.2 AS DOUBLE)) AS BIGINT))))""",
                                      "fx_base", extra=_class_rank)
ORACLE["permute_labels"] = with_fixtures("""
SELECT a.case_id, a.target, b.target AS permuted_target
FROM (SELECT case_id, target, row_number() OVER (ORDER BY case_id) AS p FROM fx_base) a
JOIN (SELECT target, """ + rank_u(None, "fx_base") + """ AS p FROM fx_base) b ON a.p = b.p""", "fx_base")

# ------------------------------------------------------------------ class tables, scaling, economics
ORACLE["class_weights"] = with_fixtures(snapped("""
SELECT target AS class, count(*) AS n, CAST(count(*) AS DOUBLE) / t.total AS share,
       CASE WHEN target = 1 THEN CAST(t.n0 AS DOUBLE) / nullif(t.n1, 0) ELSE 1.0 END AS weight_ratio,
       CASE WHEN target = 1 THEN (1 - CAST(t.n1 AS DOUBLE) / t.total) / nullif(CAST(t.n1 AS DOUBLE) / t.total, 0)
            ELSE 1.0 END AS weight_odds,
       CAST(t.total AS DOUBLE) / (CAST(t.k AS DOUBLE) * count(*)) AS weight_balanced
FROM fx_base, (SELECT count(*) AS total, count(DISTINCT target) AS k, count_if(target = 0) AS n0,
                      count_if(target = 1) AS n1 FROM fx_base) t
GROUP BY target, t.total, t.k, t.n0, t.n1""", ["share", "weight_ratio", "weight_odds", "weight_balanced"]), "fx_base")
ORACLE["class_profile"] = with_fixtures(snapped("""
SELECT n_rows, n_pos, n_neg, coalesce(CAST(n_pos AS DOUBLE) / nullif(n_rows, 0), 0.0) AS pos_share,
       r AS minority_ratio, CAST(r < 0.2 AS INTEGER) AS is_imbalanced,
       CASE WHEN r < 0.2 THEN 'f1' ELSE 'accuracy' END AS secondary_metric
FROM (SELECT *, coalesce(CAST(least(n_pos, n_neg) AS DOUBLE) / nullif(greatest(n_pos, n_neg), 0), 0.0) AS r
      FROM (SELECT count(*) AS n_rows, CAST(count_if(target = 1) AS BIGINT) AS n_pos,
                   CAST(count_if(target = 0) AS BIGINT) AS n_neg FROM fx_base))""",
                                                ["pos_share", "minority_ratio"]), "fx_base")

ECON_CTES = [
    ("fe", """  SELECT case_id, target, currdebt_22A, totalprice_3A_mean AS residualamount_856A_mean,
         amount_7A_max AS collater_valueofguarantee_1124L_sum, d1_num_group1_max AS maxdpdlast6m_474P,
         items_6L_sum AS pmts_overdue_1140A_mean, qty_8L_max AS nominalrate_281L_max FROM bb"""),
    ("ei0", """  SELECT *, CAST(residualamount_856A_mean AS DOUBLE) + CAST(currdebt_22A AS DOUBLE) AS EAD,
         1.0 / (1.0 + exp(-(0.02 * coalesce(CAST(maxdpdlast6m_474P AS DOUBLE), 0.0)
                           + 0.001 * coalesce(CAST(pmts_overdue_1140A_mean AS DOUBLE), 0.0)))) AS PD
  FROM fe"""),
    ("ei1", """  SELECT *, 1.0 - CAST(collater_valueofguarantee_1124L_sum AS DOUBLE) / (EAD + 1e-6) AS lgd_raw FROM ei0"""),
    ("ei", """  SELECT case_id, target, EAD,
         CASE WHEN lgd_raw IS NULL THEN NULL ELSE least(greatest(lgd_raw, 0.0), 1.0) END AS LGD, PD,
         EAD * (CASE WHEN lgd_raw IS NULL THEN NULL ELSE least(greatest(lgd_raw, 0.0), 1.0) END) * PD AS ELI_raw,
         CAST(residualamount_856A_mean AS DOUBLE) * CAST(nominalrate_281L_max AS DOUBLE) AS BI_raw
  FROM ei1"""),
    ("mm", "  SELECT min(ELI_raw) AS le, max(ELI_raw) AS he, min(BI_raw) AS lb, max(BI_raw) AS hb FROM ei"),
    ("sc", """  SELECT case_id, target, (ELI_raw - le) / (he - le + 1e-6) AS ELI, (BI_raw - lb) / (hb - lb + 1e-6) AS BI
  FROM ei, mm"""),
    ("es", "  SELECT target, avg(ELI) AS avg_eli, avg(BI) AS avg_bi, count(*) AS user_count FROM sc GROUP BY target"),
]
ORACLE["econ_indices"] = bb_sql(snapped("SELECT case_id, EAD, LGD, PD, ELI_raw, BI_raw FROM ei",
                                        ["EAD", "LGD", "PD", "ELI_raw", "BI_raw"]), extra=ECON_CTES)
ORACLE["minmax_norm"] = bb_sql(snapped("SELECT case_id, ELI, BI FROM sc", ["ELI", "BI"]), extra=ECON_CTES)
ORACLE["econ_summary"] = bb_sql(snapped("SELECT * FROM es", ["avg_eli", "avg_bi"]), extra=ECON_CTES)

_std_cols = ["maininc_215A", "currdebt_22A", "totalprice_3A_mean"]
ORACLE["standardize"] = bb_sql(snapped("SELECT case_id, target, " + ", ".join(
    f"({c} - m_{c}) / CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 1.0 ELSE s_{c} END AS {c}" for c in _std_cols)
    + " FROM zf, st", _std_cols), extra=[
    ("zf", "  SELECT case_id, target, " + ", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE) AS {c}" for c in _std_cols)
     + " FROM bb"),
    ("zr", f"  SELECT *, {rank_u('target', 'zf')} AS rn, count(*) OVER (PARTITION BY target) AS nc FROM zf"),
    ("st", "  SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _std_cols)
     + " FROM zr WHERE rn > ceil(0.2 * nc)"),
])

# ------------------------------------------------------------------ features
ORACLE["days_diff"] = bb_sql("SELECT case_id, " + ", ".join(
    f"CAST(date_diff('day', {c}, DATE '2024-12-31') AS BIGINT) AS {c}_days_diff"
    for c in ("date_decision", "orderdate_4D_mean", "ship_9D_mean")) + " FROM bb")


def _sd(n: str, d: str) -> str:
    return f"CAST({n} AS DOUBLE) / nullif(CAST({d} AS DOUBLE) + 1.0, 0)"


CREDIT = {
    "totalprice_3A_max": "annuity_780A", "totalprice_3A_min": "annuitynextmonth_57A",
    "totalprice_3A_mean": "avgpmtlast12m_4525200A", "amount_7A_mean": "avginstallast24m_3658937A",
    "items_6L_sum": "numberofqueries_373L", "d1_record_count": "clientscnt3m_3712950L",
    "d1_num_group1_max": "maxdpdlast12m_727P", "num_group2_max": "maxdpdtolerance_374P",
    "amount_7A_min": "credacc_credlmt_575A_mean", "totalprice_3A_std": "monthlyinstlamount_674A_mean",
    "amount_7A_std": "totaloutstanddebtvalue_668A_mean", "sparse_2A": "totaldebtoverduevalue_178A_mean",
    "qty_8L_min": "numinstpaidearly_338L", "qty_8L_sum": "numinstls_657L", "qty_8L_max": "numinstpaidlate1d_3546852L",
    "d2_record_count": "clientscnt12m_3712952L", "priority_5M_nunique": "applicationscnt_1086L",
    "flag_10M_nunique": "actualdpd_943P_max", "amount_7A_max": "credamount_770A",
    "items_6L_max": "credacc_transactions_402L_sum",
}
RATIOS = {
    "annuity_ratio_next_vs_current": _sd("annuitynextmonth_57A", "annuity_780A"),
    "payment_to_install_ratio": _sd("avgpmtlast12m_4525200A", "avginstallast24m_3658937A"),
    "debt_to_income_ratio": _sd("currdebt_22A", "maininc_215A"),
    "payment_to_debt_ratio": _sd("avgpmtlast12m_4525200A", "currdebt_22A"),
    "queries_per_client_3m": _sd("numberofqueries_373L", "clientscnt3m_3712950L"),
    "dpd_tolerance_gap": "CAST(maxdpdlast12m_727P AS DOUBLE) - CAST(maxdpdtolerance_374P AS DOUBLE)",
    "active_credit_util_ratio": _sd("currdebt_22A", "credacc_credlmt_575A_mean"),
    "monthly_payment_capacity": _sd("maininc_215A", "monthlyinstlamount_674A_mean"),
    "debt_pressure_index": _sd("CAST(currdebt_22A AS DOUBLE) + CAST(totaldebtoverduevalue_178A_mean AS DOUBLE)",
                               "maininc_215A"),
    "installment_completion_rate": _sd("numinstpaidearly_338L", "numinstls_657L"),
    "late_installment_ratio": _sd("numinstpaidlate1d_3546852L", "numinstls_657L"),
    "active_clients_ratio_12m": _sd("clientscnt12m_3712952L", "applicationscnt_1086L"),
    "dpd_relative_to_limit": _sd("actualdpd_943P_max", "credacc_credlmt_575A_mean"),
    "annuity_to_credit_ratio": _sd("annuity_780A", "credamount_770A"),
    "credit_utilization_fluctuation": _sd("credacc_transactions_402L_sum", "credacc_credlmt_575A_mean"),
    "monthly_burden_index": _sd("monthlyinstlamount_674A_mean", "maininc_215A"),
    "pmt_over_debt_ratio": _sd("avgpmtlast12m_4525200A", "totaldebtoverduevalue_178A_mean"),
}
ORACLE["ratio_features"] = bb_sql(snapped("SELECT case_id, " + ", ".join(f"{e} AS {n}" for n, e in RATIOS.items())
                                          + " FROM fc", list(RATIOS)), extra=[
    ("fc", "  SELECT case_id, maininc_215A, currdebt_22A, " + ", ".join(f"{a} AS {b}" for a, b in CREDIT.items())
     + " FROM bb")])

_rec = [("lastrejectdate_50D", "days_since_last_reject"), ("lastapprdate_640D", "days_since_last_approval"),
        ("dtlastpmtallstes_4499206D", "days_since_last_payment"), ("datefirstoffer_1144D", "days_since_first_offer"),
        ("datelastunpaid_3546854D", "days_since_last_unpaid"), ("dateofcredstart_739D", "days_since_first_credit")]
RFM = {n: f"CAST(date_diff('day', TRY_CAST({c} AS DATE), DATE '2024-12-31') AS BIGINT)" for c, n in _rec}
RFM_DOUBLES = {
    "application_freq_30d": "CAST(applications30d_658L AS DOUBLE) / 30.0",
    "reject_freq_9m": "CAST(numrejects9m_859L AS DOUBLE) / 270.0",
    "instalment_freq": "CAST(cntpmts24_3658933L AS DOUBLE) / 24.0",
    "payment_incoming_freq": "CAST(numincomingpmts_3546848L AS DOUBLE) / 12.0",
    "early_pmt_freq": _sd("numinstpaidearly5d_1087L", "numinstls_657L"),
    "unpaid_install_freq": _sd("numinstunpaidmax_3546851L", "numinstls_657L"),
    "active_credit_ratio": _sd("numactivecreds_622L", "opencred_647L"),
    "loan_to_income_ratio": _sd("credamount_770A", "maininc_215A"),
    "outstanding_to_loan_ratio": _sd("outstandingamount_362A_mean", "credamount_770A"),
    "pmt_to_outstanding_ratio": _sd("avgpmtlast12m_4525200A", "outstandingamount_362A_mean"),
    "early_payment_amount_ratio": _sd("numinstpaidearly5d_1087L", "amtinstpaidbefduel24m_4187115A"),
    "debt_vs_deposit_ratio": _sd("currdebt_22A", "amtdepositbalance_4809441A"),
    "monthly_income_to_annuity": _sd("maininc_215A", "annuity_780A"),
}
ORACLE["rfm_features"] = with_fixtures(snapped("SELECT case_id, " + ", ".join(
    f"{e} AS {n}" for n, e in {**RFM, **RFM_DOUBLES}.items()) + " FROM fx_rfm", list(RFM_DOUBLES)), "fx_rfm")

_d = "orderdate_4D"
ORACLE["date_parts"] = with_fixtures(f"""
SELECT case_id, num_group1,
       CAST(year({_d}) AS INTEGER) AS {_d}_year, CAST(month({_d}) AS INTEGER) AS {_d}_month,
       CAST(day({_d}) AS INTEGER) AS {_d}_day, CAST(isodow({_d}) - 1 AS INTEGER) AS {_d}_dayofweek,
       CAST(quarter({_d}) AS INTEGER) AS {_d}_quarter, CAST(isodow({_d}) - 1 >= 5 AS INTEGER) AS {_d}_is_weekend,
       CAST(weekofyear({_d}) AS INTEGER) AS {_d}_weekofyear, CAST(day({_d}) = 1 AS INTEGER) AS {_d}_is_month_start,
       CAST({_d} = last_day({_d}) AS INTEGER) AS {_d}_is_month_end,
       CAST({_d} = CAST(date_trunc('quarter', {_d}) AS DATE) AS INTEGER) AS {_d}_is_quarter_start,
       CAST({_d} = CAST(date_trunc('quarter', {_d}) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS INTEGER)
         AS {_d}_is_quarter_end,
       CAST(day(last_day({_d})) AS INTEGER) AS {_d}_days_in_month
FROM fx_depth1""", "fx_depth1")
ORACLE["label_encode"] = with_fixtures("""
SELECT case_id, num_group1,
       CAST(dense_rank() OVER (ORDER BY coalesce(priority_5M, 'None')) - 1 AS INTEGER) AS priority_5M
FROM fx_depth1""", "fx_depth1")
ORACLE["category_codes"] = with_fixtures("""
SELECT d.case_id, d.num_group1, CAST(coalesce(c.code, -1) AS INTEGER) AS priority_5M
FROM fx_depth1 d LEFT JOIN (
  SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code
  FROM (SELECT DISTINCT priority_5M AS v FROM fx_depth1 WHERE priority_5M IS NOT NULL)) c ON d.priority_5M = c.v""",
                                         "fx_depth1")
ORACLE["one_hot"] = with_fixtures("""
SELECT case_id, num_group1, num_group2,
       CAST(flag_10M = 'A' AS INTEGER) AS flag_10M_A, CAST(flag_10M = 'N' AS INTEGER) AS flag_10M_N,
       CAST(flag_10M = 'R' AS INTEGER) AS flag_10M_R
FROM fx_depth2""", "fx_depth2")
ORACLE["apply_threshold"] = with_fixtures("""
SELECT case_id, actual_label, CAST(score >= 0.5 AS INTEGER) AS label_ge, CAST(score > 0.518 AS INTEGER) AS label_gt
FROM fx_score_a""", "fx_score_a")
ORACLE["focal_loss"] = with_fixtures(snapped("""
SELECT avg(y * (-0.25 * pow(1 - p, 2.0) * ln(p)) + (1 - y) * (-0.75 * pow(p, 2.0) * ln(1 - p))) AS focal_loss,
       count(*) AS n
FROM (SELECT CAST(actual_label AS DOUBLE) AS y, least(greatest(score, 1e-7), 0.9999999) AS p FROM fx_score_a)""",
                                             ["focal_loss"]), "fx_score_a")

# ------------------------------------------------------------------ metrics
_HARD = [("hl", "  SELECT case_id, actual_label, CAST(score >= 0.5 AS INTEGER) AS predicted_label FROM fx_score_a")]
_CM = ("cm", """  SELECT CAST(count_if(actual_label = 0 AND predicted_label = 0) AS BIGINT) AS tn,
         CAST(count_if(actual_label = 0 AND predicted_label = 1) AS BIGINT) AS fp,
         CAST(count_if(actual_label = 1 AND predicted_label = 0) AS BIGINT) AS fn,
         CAST(count_if(actual_label = 1 AND predicted_label = 1) AS BIGINT) AS tp FROM hl""")


def metric_sql(tn="tn", fp="fp", fn="fn", tp="tp") -> str:
    pe = f"(CAST({tp} AS DOUBLE) / ({tp} + {fp} + 1e-8))"
    re = f"(CAST({tp} AS DOUBLE) / ({tp} + {fn} + 1e-8))"
    return ", ".join([
        f"{_r(f'{tp} + {tn}', f'{tp} + {tn} + {fp} + {fn}')} AS accuracy",
        f"{_r(tp, f'{tp} + {fp}')} AS precision",
        f"{_r(tp, f'{tp} + {fn}')} AS recall",
        f"{_r(f'2 * {tp}', f'2 * {tp} + {fp} + {fn}')} AS f1",
        f"({_r(tp, f'{tp} + {fn}')} + {_r(tn, f'{tn} + {fp}')}) / 2 AS balanced_accuracy",
        f"{_r(fn, f'{fn} + {tp}')} AS fnr",
        f"2 * {pe} * {re} / ({pe} + {re} + 1e-8) AS f1_incremental",
    ])


METRIC_NAMES = ["accuracy", "precision", "recall", "f1", "balanced_accuracy", "fnr", "f1_incremental"]
ORACLE["confusion"] = with_fixtures("SELECT * FROM cm", "fx_score_a", extra=_HARD + [_CM])
ORACLE["label_metrics"] = with_fixtures(snapped(f"SELECT tn, fp, fn, tp, {metric_sql()} FROM cm", METRIC_NAMES),
                                        "fx_score_a", extra=_HARD + [_CM])
ORACLE["class_report"] = with_fixtures(snapped(f"""
SELECT 1 AS class, {_r('tp', 'tp + fp')} AS precision, {_r('tp', 'tp + fn')} AS recall,
       {_r('2 * tp', '2 * tp + fp + fn')} AS f1, tp + fn AS support FROM cm
UNION ALL
SELECT 0 AS class, {_r('tn', 'tn + fn')} AS precision, {_r('tn', 'tn + fp')} AS recall,
       {_r('2 * tn', '2 * tn + fn + fp')} AS f1, tn + fp AS support FROM cm""", ["precision", "recall", "f1"]),
                                       "fx_score_a", extra=_HARD + [_CM])


def curve_ctes(src: str, score: str = "score", label: str = "actual_label", tag: str = "") -> list[tuple[str, str]]:
    return [
        (f"sc{tag}", f"""  SELECT CAST({score} AS DOUBLE) AS score, CAST(sum({label}) AS BIGINT) AS pos,
         CAST(sum(1 - {label}) AS BIGINT) AS neg FROM {src} WHERE {score} IS NOT NULL GROUP BY 1"""),
        (f"cu{tag}", f"""  SELECT score, pos, neg,
         CAST(sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_pos,
         CAST(sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_neg,
         CAST(sum(pos) OVER () AS BIGINT) AS total_pos, CAST(sum(neg) OVER () AS BIGINT) AS total_neg
  FROM sc{tag}"""),
        (f"cs{tag}", f"""  SELECT sum(neg * (cum_pos - pos / 2.0)) / (CAST(max(total_pos) AS DOUBLE) * max(total_neg)) AS roc_auc,
         sum(pos * CAST(cum_pos AS DOUBLE) / (cum_pos + cum_neg)) / CAST(max(total_pos) AS DOUBLE) AS average_precision,
         greatest(max({_r('cum_pos', 'total_pos')} - {_r('cum_neg', 'total_neg')}), 0.0) AS ks
  FROM cu{tag}"""),
    ]


ORACLE["roc_auc"] = with_fixtures(snapped("SELECT roc_auc, 2 * roc_auc - 1 AS gini, average_precision, ks FROM cs",
                                          ["roc_auc", "gini", "average_precision", "ks"]), "fx_score_a",
                                  extra=curve_ctes("fx_score_a"))
ORACLE["label_auc"] = with_fixtures(snapped("SELECT roc_auc AS label_auc FROM cs", ["label_auc"]), "fx_score_a",
                                    extra=_HARD + curve_ctes("hl", score="predicted_label"))
_models = [("ms", "  SELECT case_id, actual_label, " + ", ".join(f"score_{s}" for s in "abcde") + " FROM fx_scores")]
_all_curves = [c for s in "abcde" for c in curve_ctes("ms", score=f"score_{s}", tag=s)]
ORACLE["average_precision"] = with_fixtures(snapped(_union(
    [f"SELECT '{s}' AS model, average_precision FROM cs{s}" for s in "abcde"]), ["average_precision"]),
    "fx_scores", extra=_models + _all_curves)
ORACLE["ks_roc"] = with_fixtures(snapped(_union([f"SELECT '{s}' AS model, ks FROM cs{s}" for s in "abcde"]), ["ks"]),
                                 "fx_scores", extra=_models + _all_curves)
ORACLE["roc_curve"] = with_fixtures(snapped(f"""
SELECT score AS threshold, cum_pos AS tp, cum_neg AS fp, {_r('cum_pos', 'total_pos')} AS tpr,
       {_r('cum_neg', 'total_neg')} AS fpr FROM cu""", ["threshold", "tpr", "fpr"]), "fx_score_a",
                                    extra=curve_ctes("fx_score_a"))
_PR = ("pr", f"""  SELECT score AS threshold, {_r('cum_pos', 'cum_pos + cum_neg')} AS precision,
         {_r('cum_pos', 'total_pos')} AS recall FROM cu""")
ORACLE["pr_curve"] = with_fixtures(snapped(
    "SELECT threshold, precision, recall, 2 * precision * recall / (precision + recall + 1e-8) AS f1 FROM pr",
    ["threshold", "precision", "recall", "f1"]), "fx_score_a", extra=curve_ctes("fx_score_a") + [_PR])
ORACLE["best_f1_threshold"] = with_fixtures(snapped("""
SELECT threshold, precision, recall, f1 FROM (
  SELECT threshold, precision, recall, 2 * precision * recall / (precision + recall + 1e-8) AS f1 FROM pr)
ORDER BY f1 DESC, threshold ASC LIMIT 1""", ["threshold", "precision", "recall", "f1"]), "fx_score_a",
                                            extra=curve_ctes("fx_score_a") + [_PR])


def _grid_values(values: list[float]) -> str:
    return "VALUES " + ", ".join(f"({k}, CAST('{v!r}' AS DOUBLE))" for k, v in enumerate(values))


def _grid_counts(src: str, grid_cte: str) -> str:
    return f"""  SELECT g.k, g.threshold,
         CAST(count_if(s.actual_label = 0 AND NOT s.score >= g.threshold) AS BIGINT) AS tn,
         CAST(count_if(s.actual_label = 0 AND s.score >= g.threshold) AS BIGINT) AS fp,
         CAST(count_if(s.actual_label = 1 AND NOT s.score >= g.threshold) AS BIGINT) AS fn,
         CAST(count_if(s.actual_label = 1 AND s.score >= g.threshold) AS BIGINT) AS tp
  FROM {grid_cte} g, {src} s WHERE s.score IS NOT NULL GROUP BY g.k, g.threshold"""


def _grid_list() -> list[float]:
    import numpy as np
    return [float(x) for x in np.arange(0.1, 0.9, 0.05)]


_gm = ["f1", "accuracy", "precision", "recall", "balanced_accuracy"]
ORACLE["grid_threshold"] = with_fixtures(snapped("SELECT metric, threshold, value FROM (\n" + _union([
    f"SELECT '{m}' AS metric, threshold, {m} AS value, row_number() OVER (ORDER BY {m} DESC, k ASC) AS rn FROM gm"
    for m in _gm]) + "\n) WHERE rn = 1", ["threshold", "value"]), "fx_score_a", extra=[
    ("grid", f"  SELECT * FROM ({_grid_values(_grid_list())}) g(k, threshold)"),
    ("gc", _grid_counts("fx_score_a", "grid")),
    ("gm", f"  SELECT k, threshold, {metric_sql()} FROM gc"),
])
ORACLE["cost_threshold"] = bb_sql(snapped("""
SELECT threshold, cost, tn, fp, fn, tp FROM (
  SELECT *, row_number() OVER (ORDER BY cost ASC, k ASC) AS rn FROM (
    SELECT gc.*, fp * (SELECT avg_bi FROM es WHERE target = 0) + fn * (SELECT avg_eli FROM es WHERE target = 1) AS cost
    FROM gc)) WHERE rn = 1""", ["threshold", "cost"]), "fx_case_scores", extra=ECON_CTES + [
    ("cgrid", "  SELECT CAST(i AS INTEGER) AS k, CASE WHEN i = 999 THEN 1.0 ELSE CAST(i AS DOUBLE) * (1.0 / 999) END "
              "AS threshold FROM range(1000) t(i)"),
    ("gc", _grid_counts("fx_case_scores", "cgrid")),
])
ORACLE["ks_cumulative"] = with_fixtures(snapped(f"""
SELECT max(abs({_r('cum_pos', 'total_pos')} - {_r('cum_neg', 'total_neg')})) AS ks FROM cu""", ["ks"]),
                                        "fx_score_a", extra=_HARD + curve_ctes("hl", score="predicted_label"))
_CMP_PARTS = []
for s in "abcde":
    _CMP_PARTS.append(f"""SELECT 'model_{s}' AS model, {len(_CMP_PARTS)} AS i, accuracy, precision, recall, f1,
       cs{s}.roc_auc, cs{s}.average_precision AS pr_auc, cs{s}.ks
FROM (SELECT {metric_sql()} FROM (
  SELECT count_if(actual_label = 0 AND NOT score_{s} >= 0.5) AS tn, count_if(actual_label = 0 AND score_{s} >= 0.5) AS fp,
         count_if(actual_label = 1 AND NOT score_{s} >= 0.5) AS fn, count_if(actual_label = 1 AND score_{s} >= 0.5) AS tp
  FROM ms)), cs{s}""")
ORACLE["compare_models"] = with_fixtures(snapped("""
SELECT model, accuracy, precision, recall, f1, roc_auc, pr_auc, ks,
       CAST(model = first_value(model) OVER (ORDER BY pr_auc DESC, i ASC
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS INTEGER) AS is_best
FROM (""" + _union(_CMP_PARTS) + ")", ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "ks"]),
                                         "fx_scores", extra=_models + _all_curves)
ORACLE["evaluate_common"] = ORACLE["compare_models"].replace(
    "fx_scores AS (", "fx_scores AS (SELECT * FROM (", 1).replace(
    "  FROM fx_label\n)", "  FROM fx_label\n) WHERE case_id % 7 != 0 AND case_id % 8 != 0 AND case_id % 9 != 0 "
    "AND case_id % 10 != 0 AND case_id % 11 != 0)", 1)
ORACLE["cum_gain"] = with_fixtures(snapped(f"""
SELECT score, pos, neg, {_r('cum_pos', 'total_pos')} AS cum_bad, {_r('cum_neg', 'total_neg')} AS cum_good FROM cu""",
                                           ["score", "cum_bad", "cum_good"]), "fx_score_a", extra=curve_ctes("fx_score_a"))
ORACLE["score_histogram"] = with_fixtures(snapped("""
SELECT b.bin, lo + b.bin * ((hi - lo) / 50) AS lower, lo + (b.bin + 1) * ((hi - lo) / 50) AS upper,
       CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM (SELECT CAST(i AS INTEGER) AS bin FROM range(50) t(i)) b
CROSS JOIN mm
LEFT JOIN (
  SELECT CAST(CASE WHEN hi > lo THEN least(floor((score - lo) / (hi - lo) * 50), 49) ELSE 0 END AS INTEGER) AS bin,
         count(*) AS n
  FROM pos, mm GROUP BY 1) c ON b.bin = c.bin""", ["lower", "upper"]), "fx_score_a", extra=[
    ("pos", "  SELECT score FROM fx_score_a WHERE actual_label = 1 AND score IS NOT NULL"),
    ("mm", "  SELECT min(score) AS lo, max(score) AS hi FROM pos"),
])
ORACLE["two_stage_bands"] = with_fixtures(snapped("""
SELECT band, count(*) AS n, CAST(sum(actual_label) AS BIGINT) AS n_bad, CAST(sum(actual_label) AS DOUBLE) / count(*) AS bad_rate
FROM (SELECT actual_label,
             CASE WHEN NOT score_a >= 0.4 THEN 'approve_stage1' WHEN score_b < 0.5 THEN 'approve'
                  WHEN score_b < 0.8 THEN 'limit' ELSE 'reject' END AS band FROM fx_scores)
GROUP BY band""", ["bad_rate"]), "fx_scores")

# ------------------------------------------------------------------ selection
_ADV = [
    CB_CTE,
    ("av", "  SELECT CAST(WEEK_NUM >= 65 AS INTEGER) AS y, " + ", ".join(WINSOR_COLS) + " FROM cb"),
    ("lg", _union([f"  SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, y FROM av" for c in WINSOR_COLS])),
    ("vals", "  SELECT feature, value, count(*) AS n, sum(y) AS pos FROM lg GROUP BY feature, value"),
    ("known", """  SELECT *, sum(n) OVER (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING) AS cum_n,
         sum(n) OVER (PARTITION BY feature) AS total_n FROM vals WHERE value IS NOT NULL"""),
    ("binned", """  SELECT feature, pos, n, CAST(floor((cum_n - n) * 255 / total_n) AS INTEGER) AS bin FROM known
  UNION ALL
  SELECT feature, pos, n, -1 AS bin FROM vals WHERE value IS NULL"""),
    ("pb", "  SELECT feature, bin, sum(pos) AS pos, sum(n) AS n FROM binned GROUP BY feature, bin"),
    ("bs", """  SELECT feature, CAST(pos AS DOUBLE) / n AS score, sum(pos) AS pos, sum(n - pos) AS neg
  FROM pb GROUP BY feature, CAST(pos AS DOUBLE) / n"""),
    ("acu", """  SELECT *, sum(pos) OVER (PARTITION BY feature ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_pos,
         sum(pos) OVER (PARTITION BY feature) AS tp, sum(neg) OVER (PARTITION BY feature) AS tn FROM bs"""),
    ("adv", """  SELECT feature, sum(neg * (cum_pos - pos / 2.0)) / nullif(CAST(max(tp) AS DOUBLE) * max(tn), 0) AS auc
  FROM acu GROUP BY feature"""),
]
ORACLE["adversarial_auc"] = bb_sql(snapped(
    "SELECT feature, auc, CAST(coalesce(auc, 0.5) < 0.65 AS INTEGER) AS keep FROM adv", ["auc"]), extra=_ADV)
ORACLE["topk_features"] = bb_sql(snapped(
    "SELECT feature, auc, CAST(coalesce(auc, 0.5) < 0.65 AS INTEGER) AS keep FROM adv "
    "ORDER BY auc DESC NULLS LAST, feature LIMIT 20", ["auc"]), extra=_ADV)

ORACLE["sink_round_trip"] = with_fixtures("SELECT case_id, target, maininc_215A, segment_1M, date_decision, "
                                          + rank_u(None, "fx_base") + " AS position FROM fx_base", "fx_base")

# ------------------------------------------------------------------ neighbours (all pairs here)
_features = [c for c in WINSOR_COLS]
_points = ("pts", "  SELECT case_id, target, " + ", ".join(f"{snap(c)} AS {c}" for c in _features) + " FROM cb")
_distance = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in _features)


def _near(name: str, where: str) -> tuple[str, str]:
    return (name, f"  SELECT a.case_id, b.case_id AS neighbour, b.target, row_number() OVER (PARTITION BY a.case_id ORDER BY "
                  f"{_distance}, b.case_id) AS rank FROM pts a JOIN pts b ON a.case_id <> b.case_id WHERE a.target = 1 {where} QUALIFY rank <= 5")


_density = [CB_CTE, _points, _near("near_all", ""),
            ("own", "  SELECT case_id, CAST(count_if(target = 0) AS BIGINT) AS majority, count(*) AS k FROM near_all GROUP BY case_id"),
            ("due", "  SELECT CAST(greatest(0, trunc(count_if(target = 0) * CAST(0.5 AS DOUBLE) - count_if(target = 1))) AS DOUBLE) AS wanted, "
                    "(SELECT sum(majority) FROM own) AS total FROM pts"),
            ("density", "  SELECT case_id, majority, CAST(majority AS DOUBLE) / k AS share, "
                        "CAST(coalesce(round_even(majority * wanted / nullif(CAST(total AS DOUBLE), 0), 0), 0) AS INTEGER) AS copies FROM own, due")]
ORACLE["adasyn_density"] = bb_sql(snapped("SELECT case_id, majority, share, copies FROM density", ["share"]), extra=_density)
_made = _density + [
    _near("near_own", "AND b.target = 1"),
    ("made", "  SELECT case_id, copy, CAST(case_id AS VARCHAR) || '-' || CAST(copy AS VARCHAR) AS name FROM "
             "(SELECT case_id, unnest(range(1, copies + 1)) AS copy FROM density)"),
    ("chosen", f"  SELECT m.case_id, m.copy, {u('m.name', '42-step')} / CAST(4294967296 AS DOUBLE) AS step, n.neighbour FROM made m "
               "JOIN (SELECT case_id, max(rank) AS k FROM near_own GROUP BY case_id) c USING (case_id) "
               f"JOIN near_own n ON n.case_id = m.case_id AND n.rank = {u('m.name', '42-near')} % c.k + 1")]
ORACLE["adasyn"] = bb_sql(snapped("SELECT c.case_id, CAST(c.copy AS INTEGER) AS copy, c.neighbour, " + ", ".join(
    f"a.{f} + c.step * (b.{f} - a.{f}) AS {f}" for f in _features) + " FROM chosen c JOIN pts a ON a.case_id = c.case_id "
    "JOIN pts b ON b.case_id = c.neighbour", _features), extra=_made)

# ------------------------------------------------------------------ lasso: coordinate descent on the Gram matrix
_p = len(WINSOR_COLS)
_list = lambda items: "[" + ", ".join(items) + "]"
_LASSO = [CB_CTE, *_class_rank,
          ("tr", "  SELECT cb.* FROM cb JOIN cr USING (case_id) WHERE rn > ceil(0.2 * nc)"),
          ("va", "  SELECT cb.* FROM cb JOIN cr USING (case_id) WHERE rn <= ceil(0.2 * nc)"),
          ("stat", "  SELECT avg(CAST(target AS DOUBLE)) AS my, " + ", ".join(
              f"avg(CAST({c} AS DOUBLE)) AS m{i}, stddev_pop(CAST({c} AS DOUBLE)) AS s{i}" for i, c in enumerate(WINSOR_COLS)) + " FROM tr"),
          ("z", "  SELECT CAST(target AS DOUBLE) AS y, " + ", ".join(
              f"(CAST({c} AS DOUBLE) - m{i}) / CASE WHEN s{i} = 0 THEN 1 ELSE s{i} END AS z{i}" for i, c in enumerate(WINSOR_COLS)) + " FROM tr, stat"),
          ("gram", "  SELECT " + _list(_list(f"avg(z{i} * z{j})" for j in range(_p)) for i in range(_p)) + " AS g, "
           + _list(f"avg(z{i} * (y - my))" for i in range(_p)) + " AS b FROM z, (SELECT my FROM stat)"),
          ("descent", f"""
  WITH RECURSIVE d(step, w) AS (
    SELECT 0, list_transform(range(0, {_p}), lambda i: CAST(0 AS DOUBLE))
    UNION ALL
    SELECT step + 1, list_concat(w[1:step % {_p}], [
        CASE WHEN g[step % {_p} + 1][step % {_p} + 1] <= 0 THEN 0.0 ELSE
          sign(b[step % {_p} + 1] - list_dot_product(g[step % {_p} + 1], w) + g[step % {_p} + 1][step % {_p} + 1] * w[step % {_p} + 1])
          * greatest(abs(b[step % {_p} + 1] - list_dot_product(g[step % {_p} + 1], w)
                         + g[step % {_p} + 1][step % {_p} + 1] * w[step % {_p} + 1]) - 0.005, 0.0) / g[step % {_p} + 1][step % {_p} + 1] END],
        w[step % {_p} + 2:])
    FROM d, gram WHERE step < {400 * _p})
  SELECT w FROM d WHERE step = {400 * _p}""")]
ORACLE["lasso_select"] = bb_sql(snapped(
    "SELECT feature, coefficient, CAST(abs(coefficient) >= 1e-5 OR top < 1e-5 AS INTEGER) AS selected FROM (SELECT unnest("
    + _list(f"'{c}'" for c in WINSOR_COLS) + ") AS feature, unnest(w) AS coefficient, list_max(list_transform(w, lambda x: abs(x))) AS top "
    "FROM descent)", ["coefficient"]), extra=_LASSO)
_lasso_score = "my + " + " + ".join(
    f"w[{i + 1}] * (CAST({c} AS DOUBLE) - m{i}) / CASE WHEN s{i} = 0 THEN 1 ELSE s{i} END" for i, c in enumerate(WINSOR_COLS))
ORACLE["lasso_score"] = bb_sql(snapped(
    f"SELECT case_id, score, CAST(score >= 0.5 AS INTEGER) AS predicted_label, CAST(target AS INTEGER) AS actual_label FROM "
    f"(SELECT case_id, target, {_lasso_score} AS score FROM va, stat, descent)", ["score"]), extra=_LASSO)

# ------------------------------------------------------------------ streaming
ORACLE["incremental_f1"] = with_fixtures(snapped("""
SELECT tp, fp, fn, tn, pe AS precision_eps, re AS recall_eps, 2 * pe * re / (pe + re + 1e-8) AS f1_incremental
FROM (SELECT *, CAST(tp AS DOUBLE) / (tp + fp + 1e-8) AS pe, CAST(tp AS DOUBLE) / (tp + fn + 1e-8) AS re FROM (
  SELECT CAST(count_if(actual_label = 1 AND score > 0.5) AS BIGINT) AS tp,
         CAST(count_if(actual_label = 0 AND score > 0.5) AS BIGINT) AS fp,
         CAST(count_if(actual_label = 1 AND NOT score > 0.5) AS BIGINT) AS fn,
         CAST(count_if(actual_label = 0 AND NOT score > 0.5) AS BIGINT) AS tn
  FROM fx_score_a))""", ["precision_eps", "recall_eps", "f1_incremental"]), "fx_score_a")
