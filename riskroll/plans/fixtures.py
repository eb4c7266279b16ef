"""Fixture views: stand-in inputs in the shapes the operators expect.

They only reshape the driver's tables (customer, orders, lineitem, events,
embeddings) into a case table, child histories at two depths and score
tables; all the work the queries name runs afterwards in the operators.
Every fixture has a textual DuckDB twin in ``plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskroll.functions.exprs import hash_uniform

# Fixed values of the fixture definitions.
SENTINEL = "a55475b1"
BASE_START = "2019-01-01"
SCORE_SEEDS = ("a", "b", "c", "d", "e")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fx_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    week = (key % 92).cast("int")
    decision = F.date_add(F.lit(BASE_START).cast("date"), (week * 7).cast("int"))
    return c.select(
        key.alias("case_id"),
        week.alias("WEEK_NUM"),
        decision.alias("date_decision"),
        (F.year(decision) * 100 + F.month(decision)).cast("int").alias("MONTH"),
        (F.col("c_acctbal") < 0).cast("int").alias("target"),
        F.when(key % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("c_acctbal")).alias("maininc_215A"),
        (F.lit(100.0) * (key % 50)).cast("double").alias("currdebt_22A"),
        F.when(key % 11 == 0, F.lit(SENTINEL)).otherwise(F.col("c_mktsegment")).alias("segment_1M"),
        F.when(key % 10 == 0, F.col("c_acctbal")).alias("sparse_2A"),
    )


def fx_depth1(spark: SparkSession, sf_dir: str, keep_orderkey: bool = False) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    cols = [
        F.col("o_custkey").alias("case_id"),
        F.col("o_orderkey").alias("num_group1"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("o_totalprice")).alias("totalprice_3A"),
        F.col("o_orderdate").cast("date").alias("orderdate_4D"),
        F.when(F.col("o_orderkey") % 9 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("o_orderpriority")).alias("priority_5M"),
        F.when(F.col("o_custkey") % 13 == 0, F.lit(None).cast("bigint"))
         .otherwise(F.col("o_orderkey") % 4).alias("items_6L"),
        (F.col("o_orderkey") % 3).alias("shard"),
    ]
    if keep_orderkey:
        cols.append(F.col("o_orderkey"))
    return o.select(*cols)


def fx_depth2(spark: SparkSession, sf_dir: str, depth1: DataFrame | None = None) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    d1 = depth1 if depth1 is not None else fx_depth1(spark, sf_dir, keep_orderkey=True)
    d1 = d1.select(F.col("o_orderkey").alias("l_orderkey"), "case_id", "num_group1")
    return li.join(d1, "l_orderkey").select(
        "case_id", "num_group1",
        (F.col("l_linenumber") - 1).cast("int").alias("num_group2"),
        F.col("l_extendedprice").alias("amount_7A"),
        F.col("l_quantity").alias("qty_8L"),
        F.col("l_shipdate").cast("date").alias("ship_9D"),
        F.col("l_returnflag").alias("flag_10M"),
    )


def fx_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score table ``case_id, actual_label, score_a … score_e`` (one row per order)."""
    li = table(spark, sf_dir, "lineitem")
    per_order = li.groupBy("l_orderkey").agg(
        (F.avg(F.round(F.col("l_discount") * 100).cast("int")) >= 8).cast("int").alias("actual_label"))
    cols = [F.col("l_orderkey").alias("case_id"), F.col("actual_label")]
    for s in SCORE_SEEDS:
        cols.append(((hash_uniform("l_orderkey", s) % 800 + 200 * F.col("actual_label")) / 1000.0)
                    .alias(f"score_{s}"))
    return per_order.select(*cols)


def score_table(spark: SparkSession, sf_dir: str, seed: str = "a") -> DataFrame:
    """One model's score table ``case_id, score, actual_label``."""
    return fx_scores(spark, sf_dir).select("case_id", F.col(f"score_{seed}").alias("score"), "actual_label")


def fx_case_scores(spark: SparkSession, sf_dir: str, seed: str = "s") -> DataFrame:
    """Case-level score table ``case_id, score, actual_label`` over the customers."""
    base = fx_base(spark, sf_dir)
    return base.select("case_id",
                       ((hash_uniform("case_id", seed) % 800 + 200 * F.col("target")) / 1000.0).alias("score"),
                       F.col("target").alias("actual_label"))


# Stand-in names: merged-table columns renamed to the catalogue inputs of the ratio features.
CREDIT_RENAMES = {
    "totalprice_3A_max": "annuity_780A",
    "totalprice_3A_min": "annuitynextmonth_57A",
    "totalprice_3A_mean": "avgpmtlast12m_4525200A",
    "amount_7A_mean": "avginstallast24m_3658937A",
    "items_6L_sum": "numberofqueries_373L",
    "d1_record_count": "clientscnt3m_3712950L",
    "d1_num_group1_max": "maxdpdlast12m_727P",
    "num_group2_max": "maxdpdtolerance_374P",
    "amount_7A_min": "credacc_credlmt_575A_mean",
    "totalprice_3A_std": "monthlyinstlamount_674A_mean",
    "amount_7A_std": "totaloutstanddebtvalue_668A_mean",
    "sparse_2A": "totaldebtoverduevalue_178A_mean",
    "qty_8L_min": "numinstpaidearly_338L",
    "qty_8L_sum": "numinstls_657L",
    "qty_8L_max": "numinstpaidlate1d_3546852L",
    "d2_record_count": "clientscnt12m_3712952L",
    "priority_5M_nunique": "applicationscnt_1086L",
    "flag_10M_nunique": "actualdpd_943P_max",
    "amount_7A_max": "credamount_770A",
    "items_6L_max": "credacc_transactions_402L_sum",
}

# Stand-in names: merged-table columns renamed to the six inputs of the economic indices.
ECON_RENAMES = {
    "totalprice_3A_mean": "residualamount_856A_mean",
    "amount_7A_max": "collater_valueofguarantee_1124L_sum",
    "d1_num_group1_max": "maxdpdlast6m_474P",
    "items_6L_sum": "pmts_overdue_1140A_mean",
    "qty_8L_max": "nominalrate_281L_max",
}


def build_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged case table (base ⟕ roll-ups of both depths); one depth-1 plan feeds both families."""
    from riskroll.operators.joins import build_case_table
    d1 = fx_depth1(spark, sf_dir, keep_orderkey=True)
    return build_case_table(fx_base(spark, sf_dir), {"d1": d1.drop("o_orderkey"),
                                                     "d2": fx_depth2(spark, sf_dir, depth1=d1)})


def _renamed(df: DataFrame, renames: dict, keep: list[str]) -> DataFrame:
    return df.select(*keep, *[F.col(a).alias(b) for a, b in renames.items()])


def fx_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _renamed(build_base(spark, sf_dir), CREDIT_RENAMES, ["case_id", "maininc_215A", "currdebt_22A"])


def fx_econ(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _renamed(build_base(spark, sf_dir), ECON_RENAMES, ["case_id", "target", "currdebt_22A"])


def fx_rfm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user of ``events``: last/first event dates as ISO strings (every 17th user's
    reject date is unparsable), event counts as ``…L`` and value sums as ``…A`` inputs."""
    ev = table(spark, sf_dir, "events")
    t = F.col("event_type")

    def day(c):
        return F.date_format(c, "yyyy-MM-dd")

    reject = day(F.max(F.when(t == "error", F.col("ts"))))
    return ev.groupBy("user_id").agg(
        F.when(F.col("user_id") % 17 == 0, F.lit("bad")).otherwise(reject).alias("lastrejectdate_50D"),
        day(F.max(F.when(t == "purchase", F.col("ts")))).alias("lastapprdate_640D"),
        day(F.max(F.when(t == "click", F.col("ts")))).alias("dtlastpmtallstes_4499206D"),
        day(F.min(F.when(t == "view", F.col("ts")))).alias("datefirstoffer_1144D"),
        day(F.max(F.when(t == "signup", F.col("ts")))).alias("datelastunpaid_3546854D"),
        day(F.min("ts")).alias("dateofcredstart_739D"),
        F.count_if(t == "signup").alias("applications30d_658L"),
        F.count_if(t == "error").alias("numrejects9m_859L"),
        F.count_if(t == "purchase").alias("cntpmts24_3658933L"),
        F.count_if(t == "click").alias("numincomingpmts_3546848L"),
        F.count_if(t == "view").alias("numinstpaidearly5d_1087L"),
        F.count(F.lit(1)).alias("numinstls_657L"),
        F.count_if(t == "error").alias("numinstunpaidmax_3546851L"),
        F.count_distinct(t).alias("numactivecreds_622L"),
        F.count_distinct(F.to_date("ts")).alias("opencred_647L"),
        F.sum("value").alias("credamount_770A"),
        F.max("value").alias("maininc_215A"),
        F.avg("value").alias("outstandingamount_362A_mean"),
        F.avg(F.when(t == "purchase", F.col("value"))).alias("avgpmtlast12m_4525200A"),
        F.sum(F.when(t == "view", F.col("value"))).alias("amtinstpaidbefduel24m_4187115A"),
        F.sum(F.when(t == "error", F.col("value"))).alias("currdebt_22A"),
        F.min("value").alias("amtdepositbalance_4809441A"),
        F.sum(F.when(t == "click", F.col("value"))).alias("annuity_780A"),
    ).withColumnRenamed("user_id", "case_id")


def fx_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as applications: status strings and an event date."""
    ev = table(spark, sf_dir, "events")
    t = F.col("event_type")
    return ev.select(
        F.col("event_id").alias("case_id"),
        F.when(t == "purchase", F.lit("approved")).otherwise(t).alias("application_status"),
        F.when(t.isin("click", "view"), F.lit("active")).otherwise(F.lit("closed")).alias("contract_status"),
        F.col("ts").alias("event_date"),
    )


def fx_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a numeric text column (every 17th value unparsable) and JSON text."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("case_id"),
        F.when(F.col("event_id") % 17 == 0, F.lit("bad")).otherwise(F.col("value").cast("string")).alias("value_txt"),
        F.col("props"),
        F.col("event_type"),
    )
