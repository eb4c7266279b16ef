"""Derived features (F1-F15) as column expressions.

Every feature is guarded by a presence check against the schema (resolved on
the driver, no data read), and all new columns are added in one ``select``.
Division is ``try_divide``: a zero denominator gives null instead of an ANSI
error (the single-machine original produced inf/NaN there).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskroll.functions.exprs import days_between, is_date_type, lenient_date, safe_div

# Fixed values of the feature catalogue.
REFERENCE_DATE = "2024-12-31"

# basic ratios (numerator, denominator, name), n / (d + 1)
BASIC_RATIOS = [
    ("loan_amount", "income_total", "loan_income_ratio"),
    ("total_payment", "total_debt", "payment_debt_ratio"),
    ("loan_amount", "total_assets", "loan_asset_ratio"),
    ("credit_card_limit", "income_total", "credit_limit_income_ratio"),
]

# ratio catalogue.  ("div", numerator terms, denominator, name) = sum(terms) / (den + 1);
# ("diff", a, b, name) = a - b.
RATIO_CATALOGUE = [
    ("div", ["annuitynextmonth_57A"], "annuity_780A", "annuity_ratio_next_vs_current"),
    ("div", ["avgpmtlast12m_4525200A"], "avginstallast24m_3658937A", "payment_to_install_ratio"),
    ("div", ["currdebt_22A"], "maininc_215A", "debt_to_income_ratio"),
    ("div", ["avgpmtlast12m_4525200A"], "currdebt_22A", "payment_to_debt_ratio"),
    ("div", ["numberofqueries_373L"], "clientscnt3m_3712950L", "queries_per_client_3m"),
    ("diff", "maxdpdlast12m_727P", "maxdpdtolerance_374P", "dpd_tolerance_gap"),
    ("div", ["currdebt_22A"], "credacc_credlmt_575A_mean", "active_credit_util_ratio"),
    ("div", ["residualamount_856A_mean"], "totaloutstanddebtvalue_668A_mean", "residual_debt_ratio"),
    ("div", ["maininc_215A"], "monthlyinstlamount_674A_mean", "monthly_payment_capacity"),
    ("div", ["currdebt_22A", "totaldebtoverduevalue_178A_mean"], "maininc_215A", "debt_pressure_index"),
    ("div", ["numinstpaidearly_338L"], "numinstls_657L", "installment_completion_rate"),
    ("div", ["numinstpaidlate1d_3546852L"], "numinstls_657L", "late_installment_ratio"),
    ("div", ["clientscnt12m_3712952L"], "applicationscnt_1086L", "active_clients_ratio_12m"),
    ("div", ["actualdpd_943P_max"], "credacc_credlmt_575A_mean", "dpd_relative_to_limit"),
    ("div", ["annuity_780A"], "credamount_770A", "annuity_to_credit_ratio"),
    ("div", ["residualamount_856A_mean"], "totaldebtoverduevalue_178A_mean", "residual_to_totaldebt_ratio"),
    ("div", ["credacc_transactions_402L_sum"], "credacc_credlmt_575A_mean", "credit_utilization_fluctuation"),
    ("div", ["monthlyinstlamount_674A_mean"], "maininc_215A", "monthly_burden_index"),
    ("div", ["outstandingamount_362A_mean"], "avginstallast24m_3658937A", "outstanding_to_installment_ratio"),
    ("div", ["avgpmtlast12m_4525200A"], "totaldebtoverduevalue_178A_mean", "pmt_over_debt_ratio"),
]

# F6 recency: (date column, feature name)
RECENCY = [
    ("lastrejectdate_50D", "days_since_last_reject"),
    ("lastapprdate_640D", "days_since_last_approval"),
    ("dtlastpmtallstes_4499206D", "days_since_last_payment"),
    ("datefirstoffer_1144D", "days_since_first_offer"),
    ("datelastunpaid_3546854D", "days_since_last_unpaid"),
    ("dateofcredstart_739D", "days_since_first_credit"),
    ("birthdate_574D", "days_since_birthdate"),
]

# F6 frequency: (numerator, denominator column or a number, name); a number divides plainly
FREQUENCY = [
    ("applications30d_658L", 30, "application_freq_30d"),
    ("numrejects9m_859L", 270, "reject_freq_9m"),
    ("cntpmts24_3658933L", 24, "instalment_freq"),
    ("numincomingpmts_3546848L", 12, "payment_incoming_freq"),
    ("numinstpaidearly5d_1087L", "numinstls_657L", "early_pmt_freq"),
    ("numinstunpaidmax_3546851L", "numinstls_657L", "unpaid_install_freq"),
    ("numactivecreds_622L", "opencred_647L", "active_credit_ratio"),
]

# F6 monetary: n / (d + 1)
MONETARY = [
    ("credamount_770A", "maininc_215A", "loan_to_income_ratio"),
    ("outstandingamount_362A_mean", "credamount_770A", "outstanding_to_loan_ratio"),
    ("avgpmtlast12m_4525200A", "outstandingamount_362A_mean", "pmt_to_outstanding_ratio"),
    ("numinstpaidearly5d_1087L", "amtinstpaidbefduel24m_4187115A", "early_payment_amount_ratio"),
    ("currdebt_22A", "amtdepositbalance_4809441A", "debt_vs_deposit_ratio"),
    ("maininc_215A", "annuity_780A", "monthly_income_to_annuity"),
]

# PD coefficients; F13: epsilon
PD_ALPHA_DPD = 0.02
PD_ALPHA_OVERDUE = 0.001
ECON_EPS = 1e-6


def _ref(ref_date: str) -> Column:
    return F.lit(ref_date).cast("date")


def days_diff(df: DataFrame, ref_date: str = REFERENCE_DATE) -> DataFrame:
    """``{col}_days_diff`` = whole days from every date/timestamp column to ``ref_date``."""
    new = []
    for f in df.schema.fields:
        if is_date_type(f.dataType):
            is_ts = not isinstance(f.dataType, T.DateType)
            ref = _ref(ref_date).cast(f.dataType) if is_ts else _ref(ref_date)
            new.append(days_between(F.col(f.name), ref, is_ts).alias(f"{f.name}_days_diff"))
    return df.select("*", *new)


def basic_ratios(df: DataFrame) -> DataFrame:
    """the four basic guarded ratios, each only when both inputs exist."""
    have = set(df.columns)
    return df.select("*", *[safe_div(F.col(n), F.col(d)).alias(name)
                            for n, d, name in BASIC_RATIOS if n in have and d in have])


def ratio_features(df: DataFrame) -> DataFrame:
    """The guarded ratio / difference catalogue (absent inputs -> feature skipped)."""
    have = set(df.columns)
    new = []
    for kind, a, b, name in RATIO_CATALOGUE:
        if kind == "diff":
            if a in have and b in have:
                new.append((F.col(a).cast("double") - F.col(b).cast("double")).alias(name))
        elif all(t in have for t in a) and b in have:
            num = F.col(a[0]).cast("double")
            for t in a[1:]:
                num = num + F.col(t).cast("double")
            new.append(safe_div(num, F.col(b)).alias(name))
    return basic_ratios(df).select("*", *new)


def rfm_features(df: DataFrame, ref_date: str = REFERENCE_DATE) -> DataFrame:
    """F6 + F7: recency (days since a leniently parsed date), frequency, monetary ratios."""
    types = {f.name: f.dataType for f in df.schema.fields}
    new = []
    for col, name in RECENCY:
        if col in types:
            d = lenient_date(F.col(col), types[col])
            new.append(F.datediff(_ref(ref_date), d).cast("bigint").alias(name))
    for n, d, name in FREQUENCY:
        if n not in types:
            continue
        if isinstance(d, (int, float)):
            new.append((F.col(n).cast("double") / F.lit(float(d))).alias(name))
        elif d in types:
            new.append(safe_div(F.col(n), F.col(d)).alias(name))
    for n, d, name in MONETARY:
        if n in types and d in types:
            new.append(safe_div(F.col(n), F.col(d)).alias(name))
    return df.select("*", *new)


def flag_features(df: DataFrame, ref_date: str = REFERENCE_DATE) -> DataFrame:
    """Approval / activity flags and event-recency flags as tinyint."""
    types = {f.name: f.dataType for f in df.schema.fields}
    new = []
    if "application_status" in types and "contract_status" in types:
        new += [(F.col("application_status") == "approved").cast("tinyint").alias("is_approved"),
                (F.col("contract_status") == "active").cast("tinyint").alias("is_active")]
    if "event_date" in types:
        t = types["event_date"]
        is_ts = not isinstance(t, T.DateType)
        days = days_between(F.col("event_date"), _ref(ref_date).cast(t) if is_ts else _ref(ref_date), is_ts)
        new += [(days <= 180).cast("tinyint").alias("event_last_6m"),
                (days <= 365).cast("tinyint").alias("event_last_1y")]
    return df.select("*", *new)


DATE_PARTS = ("year", "month", "day", "dayofweek", "quarter", "is_weekend", "weekofyear",
              "is_month_start", "is_month_end", "is_quarter_start", "is_quarter_end", "days_in_month")


def date_part_exprs(c: Column, name: str) -> list[Column]:
    d = c.cast("date")
    dow = F.weekday(d)  # Monday = 0
    return [
        F.year(d).alias(f"{name}_year"),
        F.month(d).alias(f"{name}_month"),
        F.dayofmonth(d).alias(f"{name}_day"),
        dow.alias(f"{name}_dayofweek"),
        F.quarter(d).alias(f"{name}_quarter"),
        (dow >= 5).cast("int").alias(f"{name}_is_weekend"),
        F.weekofyear(d).alias(f"{name}_weekofyear"),
        (F.dayofmonth(d) == 1).cast("int").alias(f"{name}_is_month_start"),
        (d == F.last_day(d)).cast("int").alias(f"{name}_is_month_end"),
        (d == F.trunc(d, "quarter")).cast("int").alias(f"{name}_is_quarter_start"),
        (d == F.date_sub(F.add_months(F.trunc(d, "quarter"), 3), 1)).cast("int").alias(f"{name}_is_quarter_end"),
        F.dayofmonth(F.last_day(d)).alias(f"{name}_days_in_month"),
    ]


def date_parts(df: DataFrame, columns: Sequence[str], drop: bool = True) -> DataFrame:
    """F8: twelve calendar parts per date column (unparsable strings -> null parts)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    new = []
    for c in columns:
        new += date_part_exprs(lenient_date(F.col(c), types[c]), c)
    keep = [c for c in df.columns if not (drop and c in columns)]
    return df.select(*keep, *new)


def econ_indices(df: DataFrame) -> DataFrame:
    """F12 + F13: EAD, LGD, PD and the raw loss / benefit indices (before min-max)."""
    residual = F.col("residualamount_856A_mean").cast("double")
    ead = residual + F.col("currdebt_22A").cast("double")
    lgd_raw = F.lit(1.0) - F.col("collater_valueofguarantee_1124L_sum").cast("double") / (ead + F.lit(ECON_EPS))
    lgd = F.least(F.greatest(lgd_raw, F.lit(0.0)), F.lit(1.0))
    lgd = F.when(lgd_raw.isNull(), F.lit(None).cast("double")).otherwise(lgd)
    linear = (F.lit(PD_ALPHA_DPD) * F.coalesce(F.col("maxdpdlast6m_474P").cast("double"), F.lit(0.0))
              + F.lit(PD_ALPHA_OVERDUE) * F.coalesce(F.col("pmts_overdue_1140A_mean").cast("double"), F.lit(0.0)))
    pd_ = F.lit(1.0) / (F.lit(1.0) + F.exp(-linear))
    return df.select("*", ead.alias("EAD"), lgd.alias("LGD"), pd_.alias("PD"),
                     (ead * lgd * pd_).alias("ELI_raw"),
                     (residual * F.col("nominalrate_281L_max").cast("double")).alias("BI_raw"))


def apply_threshold(score: Column, threshold: float, strict: bool = False) -> Column:
    """hard label from a score (``>=`` by default, ``>`` when ``strict``)."""
    return (score > F.lit(threshold) if strict else score >= F.lit(threshold)).cast("int")
