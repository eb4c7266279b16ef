"""Query catalog: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the driver's tables through the fixture views and then runs
the library operator it is named after over the whole input.  Double columns
are snapped to 6 decimals at the edge so the result compares with the DuckDB
twin in ``plans.oracle`` independent of summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskroll import sources
from riskroll.functions import features as fe
from riskroll.functions.exprs import hash_unit, round_doubles, snap
from riskroll.operators import boosting, classes, clean, encode, joins, metrics as me, models as mo
from riskroll.operators import neighbours as nb, rollup as ru, sampling as sa, selection as se
from riskroll.plans import fixtures as fx
from riskroll.session import ensure_checkpoint_dir

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(name: str, rounded: bool = True):
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return round_doubles(df) if rounded else df
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return run
    return deco


def shards(spark, sf_dir):
    d1 = fx.fx_depth1(spark, sf_dir)
    return [d1.where(F.col("shard") == i) for i in range(3)]


def materialized(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (shared ``spark.checkpoint.dir``) of an input that several passes re-read;
    taken after the projection so only the needed columns are computed and written."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def merged(spark, sf_dir) -> DataFrame:
    """The merged table as the cleaning stage sees it: materialised once (reliable checkpoint in
    the shared ``spark.checkpoint.dir``) so the profile passes re-read it instead of re-running
    the merge, as the merge stage's parquet output would be in production."""
    ensure_checkpoint_dir(spark)
    return fx.build_base(spark, sf_dir).checkpoint(eager=True)


def clean_base(spark, sf_dir) -> DataFrame:
    """E2 cleaning: drop sparse -> sentinel -> fill 0 (winsorising is its own query)."""
    return clean.fill_zero(clean.sentinel_null(clean.drop_sparse(merged(spark, sf_dir))))


def holdout_params(df: DataFrame) -> tuple[int, int]:
    n = df.count()
    n_test = n // 10
    return n_test, n_test // 10


# --------------------------------------------------------------------------
# roll-ups and the flagship merge
# --------------------------------------------------------------------------

@query("rollup_depth1")
def q_rollup_depth1(spark, sf_dir):
    """A1: suffix-driven roll-up of the depth-1 history (orders) to one row per case."""
    return ru.rollup(fx.fx_depth1(spark, sf_dir))


@query("rollup_depth2")
def q_rollup_depth2(spark, sf_dir):
    """A1: suffix-driven roll-up of the depth-2 history (lineitems) to one row per case."""
    return ru.rollup(fx.fx_depth2(spark, sf_dir))


@query("build_base")
def q_build_base(spark, sf_dir):
    """J4 + A1 + J1/J2: base ⟕ roll-up(depth 1) ⟕ roll-up(depth 2), clashing names prefixed."""
    return fx.build_base(spark, sf_dir)


@query("date_mean")
def q_date_mean(spark, sf_dir):
    """Mean order date per case (date suffix only)."""
    return ru.rollup(fx.fx_depth1(spark, sf_dir).select("case_id", "orderdate_4D"))


@query("first_last")
def q_first_last(spark, sf_dir):
    """Null-keeping first / last of a category in (num_group1, num_group2) order."""
    return ru.rollup(fx.fx_depth2(spark, sf_dir).select("case_id", "num_group1", "num_group2", "flag_10M"))


@query("nunique_with_null")
def q_nunique_with_null(spark, sf_dir):
    """A1d: distinct count with null as a value (and the other category aggregates)."""
    return ru.rollup(fx.fx_depth1(spark, sf_dir).select("case_id", "num_group1", "priority_5M"))


@query("rollup_partials")
def q_rollup_partials(spark, sf_dir):
    """A2: per-shard roll-ups merged per batch of two shards (sums add, the rest averages)."""
    return ru.rollup_partials(fx.fx_depth1(spark, sf_dir), "shard", batch_size=2)


@query("fold_chunks")
def q_fold_chunks(spark, sf_dir):
    """A3: running pairwise mean over per-shard chunks, in chunk order."""
    return ru.fold_chunks(ru.rollup_partials(fx.fx_depth1(spark, sf_dir), "shard", batch_size=1))


@query("rollup_exact")
def q_rollup_exact(spark, sf_dir):
    """A4: exact roll-up over the union of the shards (independent of the file layout)."""
    return ru.rollup(sources.union_strict(shards(spark, sf_dir)).drop("shard"))


@query("dedup_first")
def q_dedup_first(spark, sf_dir):
    """A5: first order per customer by (order date, order key)."""
    o = fx.table(spark, sf_dir, "orders")
    return joins.dedup_first(o, "o_custkey", ["o_orderdate", "o_orderkey"])


# --------------------------------------------------------------------------
# sources (S1-S4, S7) and projections
# --------------------------------------------------------------------------

@query("scan_base")
def q_scan_base(spark, sf_dir):
    """The base table read from parquet."""
    return fx.fx_base(spark, sf_dir)


@query("union_shards")
def q_union_shards(spark, sf_dir):
    """Strict vertical concat of the three shards of the depth-1 family."""
    return sources.union_strict(shards(spark, sf_dir))


@query("union_relaxed")
def q_union_relaxed(spark, sf_dir):
    """S3: shards with different column sets and types, unioned by name to common supertypes."""
    s0, s1, s2 = shards(spark, sf_dir)
    s1 = s1.drop("priority_5M").withColumn("totalprice_3A", F.col("totalprice_3A").cast("float"))
    s2 = s2.drop("orderdate_4D").withColumn("items_6L", F.col("items_6L").cast("int"))
    return sources.union_relaxed([s0, s1, s2])


@query("csv_lineage")
def q_csv_lineage(spark, sf_dir):
    """A folder of CSV files (customers, a file per nation) read as one frame with ``file_name = file_{rank}``."""
    customer, path = spark.read.parquet(f"{sf_dir}/customer.parquet"), boosting.shared_folder(spark, "csv-lineage")
    customer.withColumn("nation", F.col("c_nationkey")).repartition("nation").write.partitionBy("nation").csv(path, header=True)
    return sources.read_with_lineage(spark, path, schema=customer.schema, recursiveFileLookup="true")


ALLOWLIST = ["case_id", "target", "maininc_215A", "totalprice_3A_mean", "no_such_feature",
             "amount_7A_std", "d1_record_count"]


@query("select_allowlist")
def q_select_allowlist(spark, sf_dir):
    """Keep the features that exist of a name table (a sheet read from CSV; unknown names skipped)."""
    path = boosting.shared_folder(spark, "allowlist")
    sources.write_csv(spark.createDataFrame([(n,) for n in ALLOWLIST], "Feature_Name string").coalesce(1), path)
    names = sources.allowlist_names(spark.read.schema("Feature_Name string").csv(path, header=True))
    return sources.select_allowlist(fx.build_base(spark, sf_dir), names)


@query("sink_round_trip")
def q_sink_round_trip(spark, sf_dir):
    """S5 + S6 + R8: the shuffled case table written as parquet and a part of it as CSV, both read back: every row with
    its place in the parquet sink."""
    base, path = fx.fx_base(spark, sf_dir), boosting.shared_folder(spark, "sink")
    sources.write_parquet(sa.shuffle_rows(base.select("case_id", "target", "maininc_215A")), f"{path}/parquet")
    sources.write_csv(base.select("case_id", "segment_1M", "date_decision"), f"{path}/csv")
    rows = sources.read_in_order(spark, f"{path}/parquet")
    return rows.join(spark.read.schema("case_id long, segment_1M string, date_decision date").csv(f"{path}/csv", header=True), "case_id")


@query("project_features")
def q_project_features(spark, sf_dir):
    """Final projection: ids first, a feature list in order, one column renamed."""
    bb = fx.build_base(spark, sf_dir)
    return bb.select("case_id", "target", "date_decision", "amount_7A_mean", "totalprice_3A_max",
                     "items_6L_sum").withColumnRenamed("items_6L_sum", "items_total")


@query("filter_label")
def q_filter_label(spark, sf_dir):
    """The positive cases."""
    return fx.fx_base(spark, sf_dir).where(F.col("target") == 1)


# --------------------------------------------------------------------------
# cleaning (P3-P15, A9)
# --------------------------------------------------------------------------

@query("null_profile")
def q_null_profile(spark, sf_dir):
    """Null count and share of every column of the merged table."""
    return clean.null_profile(fx.build_base(spark, sf_dir))


@query("drop_sparse")
def q_drop_sparse(spark, sf_dir):
    """Drop columns more than 80% null."""
    return clean.drop_sparse(merged(spark, sf_dir))  # merged once: the null counts and the result both read it


@query("sentinel_null")
def q_sentinel_null(spark, sf_dir):
    """The sentinel string becomes null in every string column."""
    return clean.sentinel_null(fx.fx_base(spark, sf_dir))


@query("fill_zero")
def q_fill_zero(spark, sf_dir):
    """P5: numeric nulls become 0 in the merged table."""
    return clean.fill_zero(fx.build_base(spark, sf_dir))


@query("winsorize")
def q_winsorize(spark, sf_dir):
    """Clip every numeric non-id column of the cleaned table to its q01 / q99."""
    return clean.winsorize(clean_base(spark, sf_dir))


@query("quantile_bounds")
def q_quantile_bounds(spark, sf_dir):
    """Exact q01 / q99 (percentile_disc) of every numeric non-id column."""
    df = clean_base(spark, sf_dir)
    return clean.quantile_bounds(df, clean.numeric_columns(df, clean.NEVER_FEATURES))


@query("shrink_types")
def q_shrink_types(spark, sf_dir):
    """Narrowest integer type per integer column (min / max and the chosen type)."""
    return clean.shrink_plan(clean_base(spark, sf_dir))


@query("shrink_table")
def q_shrink_table(spark, sf_dir):
    """The shrunk table itself: every numeric column's type in it, its sum and its number of values."""
    small = clean.shrink_types(clean_base(spark, sf_dir))
    cols = clean.numeric_columns(small, ())
    one = small.agg(*[F.sum(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)],
                    *[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)])
    types = dict(small.dtypes)
    return one.selectExpr("stack({}, {}) as (`column`, type, total, n)".format(
        len(cols), ", ".join(f"'{c}', '{types[c]}', s{i}, n{i}" for i, c in enumerate(cols))))


@query("numeric_features")
def q_numeric_features(spark, sf_dir):
    """The id plus every numeric column that may be a feature."""
    df = clean_base(spark, sf_dir)
    return df.select("case_id", *clean.numeric_features(df))


@query("infer_types")
def q_infer_types(spark, sf_dir):
    """P10: date / categorical / numeric inference per column (parse share over the column)."""
    return clean.infer_types(fx.fx_rfm(spark, sf_dir))


@query("flag_features")
def q_flag_features(spark, sf_dir):
    """Approval, activity and 180 / 365-day event flags."""
    return fe.flag_features(fx.fx_flags(spark, sf_dir))


IMPUTE_COLUMNS = ["case_id", "target", "maininc_215A", "sparse_2A", "totalprice_3A_mean",
                  "priority_5M_last", "segment_1M"]


@query("impute_median_mode")
def q_impute_median_mode(spark, sf_dir):
    """Median / mode fitted on the train split, applied to every row."""
    df = materialized(clean.sentinel_null(fx.build_base(spark, sf_dir).select(*IMPUTE_COLUMNS)))
    n_test, n_pos = holdout_params(df)
    split = sa.holdout_split(df, n_test, n_pos)
    imputer = clean.fit_imputer(split.where(F.col("split") == "train").drop("split"))
    return imputer.apply(df)


@query("coerce_numeric")
def q_coerce_numeric(spark, sf_dir):
    """Text -> double, unparsable -> 0."""
    return clean.coerce_numeric(fx.fx_strings(spark, sf_dir), ["value_txt", "props"])


@query("cast_columns")
def q_cast_columns(spark, sf_dir):
    """Label -> float, features -> float, category -> string."""
    return clean.cast_columns(fx.fx_base(spark, sf_dir), {"target": "float", "maininc_215A": "float",
                                                          "currdebt_22A": "float", "WEEK_NUM": "string"})


# --------------------------------------------------------------------------
# joins (J1, J3, J4, J5) and splits
# --------------------------------------------------------------------------

def _static_inputs(spark, sf_dir):
    """Base keys, a static table and bureau rows (several per case)."""
    b = fx.fx_base(spark, sf_dir)
    base = b.select("case_id", "WEEK_NUM", "date_decision", "MONTH", "target")
    static = b.select("case_id", "WEEK_NUM", "maininc_215A", "currdebt_22A", "segment_1M", "sparse_2A")
    cb = fx.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("case_id"), F.col("o_orderdate").cast("date").alias("opened_14D"),
        F.col("o_orderkey").alias("cb_orderkey"), F.col("o_orderstatus").alias("status_12M"),
        F.col("o_totalprice").alias("price_13A"))
    return base, static, cb


@query("join_static")
def q_join_static(spark, sf_dir):
    """J1 + P9 + A5: base ⟕ (static ⟕ first bureau row per case), common columns removed."""
    return joins.join_static(*_static_inputs(spark, sf_dir), cb_order=["opened_14D", "cb_orderkey"])


@query("merge_stage")
def q_merge_stage(spark, sf_dir):
    """Depth 0 (static and bureau tables) and the roll-ups of depths 1 and 2 merged onto the base."""
    from riskroll.plans import flows

    base, static, cb = _static_inputs(spark, sf_dir)
    d1 = fx.fx_depth1(spark, sf_dir, keep_orderkey=True)
    families = {"d1": d1.drop("o_orderkey"), "d2": fx.fx_depth2(spark, sf_dir, depth1=d1)}
    return flows.merge_stage(base, families, static, cb, cb_order=["opened_14D", "cb_orderkey"])


@query("sample_n")
def q_sample_n(spark, sf_dir):
    """Exactly a third of the base (the smallest hash values)."""
    base = fx.fx_base(spark, sf_dir)
    return sa.sample_n(base, base.count() // 3)


@query("semi_sampled")
def q_semi_sampled(spark, sf_dir):
    """Depth-1 history of the sampled cases (semi-join on the sampled keys)."""
    base = fx.fx_base(spark, sf_dir)
    keys = sa.sample_n(base.select("case_id"), base.count() // 3)
    return joins.semi_join_keys(fx.fx_depth1(spark, sf_dir), keys)


@query("holdout_split")
def q_holdout_split(spark, sf_dir):
    """R2 + U1: fixed-size test set with a fixed number of positives; the rest is train."""
    base = fx.fx_base(spark, sf_dir)
    n_test, n_pos = holdout_params(base)
    return sa.holdout_split(base, n_test, n_pos)


@query("anti_holdout")
def q_anti_holdout(spark, sf_dir):
    """train = all cases minus the test keys (anti-join)."""
    base = fx.fx_base(spark, sf_dir)
    n_test, n_pos = holdout_params(base)
    test = sa.holdout_split(base, n_test, n_pos).where(F.col("split") == "test")
    return joins.anti_join_keys(base, test)


@query("join_scores")
def q_join_scores(spark, sf_dir):
    """J3 + A5 + P1: five score files deduplicated, renamed and inner-joined on the case."""
    s = fx.fx_scores(spark, sf_dir)
    out = None
    for seed in fx.SCORE_SEEDS:
        t = s.select("case_id", "actual_label",
                     (F.col(f"score_{seed}") >= 0.5).cast("int").alias("predicted_label"))
        t = joins.dedup_first(t, "case_id").withColumnRenamed("predicted_label", f"prediction_{seed}")
        out = t if out is None else out.join(t.drop("actual_label"), "case_id", "inner")
    return out


@query("stratified_split")
def q_stratified_split(spark, sf_dir):
    """Per-class 80 / 20 split with exact class counts."""
    return sa.stratified_split(fx.fx_base(spark, sf_dir).select("case_id", "target"))


@query("stratified_kfold")
def q_stratified_kfold(spark, sf_dir):
    """Five stratified folds."""
    return sa.stratified_kfold(fx.fx_base(spark, sf_dir).select("case_id", "target"))


@query("undersample")
def q_undersample(spark, sf_dir):
    """All positives and n_pos / 0.2 negatives."""
    return sa.undersample(fx.fx_base(spark, sf_dir).select("case_id", "target", "maininc_215A"), 0.2)


@query("permute_labels")
def q_permute_labels(spark, sf_dir):
    """Seeded permutation of the label against the cases."""
    return sa.permute_labels(fx.fx_base(spark, sf_dir).select("case_id", "target"))


# --------------------------------------------------------------------------
# class tables and scaling
# --------------------------------------------------------------------------

@query("class_weights")
def q_class_weights(spark, sf_dir):
    """Class counts and the three class weightings."""
    return classes.class_weights(fx.fx_base(spark, sf_dir))


@query("class_profile")
def q_class_profile(spark, sf_dir):
    """Class shares, minority ratio, imbalance flag and secondary metric."""
    return classes.class_profile(fx.fx_base(spark, sf_dir))


@query("econ_indices")
def q_econ_indices(spark, sf_dir):
    """F12 + F13: EAD, LGD, PD, raw loss and benefit indices per case."""
    e = fe.econ_indices(fx.fx_econ(spark, sf_dir))
    return e.select("case_id", "EAD", "LGD", "PD", "ELI_raw", "BI_raw")


@query("minmax_norm")
def q_minmax_norm(spark, sf_dir):
    """A10: min-max scaling of the raw loss / benefit indices (ELI, BI)."""
    e = materialized(fe.econ_indices(fx.fx_econ(spark, sf_dir)).select("case_id", "ELI_raw", "BI_raw"))
    scaled = classes.fit_minmax(e, ["ELI_raw", "BI_raw"]).apply(e)
    return scaled.withColumnRenamed("ELI_raw", "ELI").withColumnRenamed("BI_raw", "BI")


@query("econ_summary")
def q_econ_summary(spark, sf_dir):
    """Mean ELI, mean BI and count per class."""
    return classes.econ_summary(materialized(fe.econ_indices(fx.fx_econ(spark, sf_dir))))


STANDARDIZE_COLUMNS = ["maininc_215A", "currdebt_22A", "totalprice_3A_mean"]


@query("standardize")
def q_standardize(spark, sf_dir):
    """Z-scores with mean / population std fitted on the train split."""
    df = materialized(clean.fill_zero(fx.build_base(spark, sf_dir).select("case_id", "target", *STANDARDIZE_COLUMNS)))
    split = sa.stratified_split(df)
    st = classes.fit_standardizer(split.where(F.col("is_valid") == 0), STANDARDIZE_COLUMNS)
    return st.apply(df)


# --------------------------------------------------------------------------
# features (F1-F11, F14, F15)
# --------------------------------------------------------------------------

@query("days_diff")
def q_days_diff(spark, sf_dir):
    """whole days from every date column of the merged table to 2024-12-31."""
    df = fe.days_diff(fx.build_base(spark, sf_dir))
    return df.select("case_id", *[c for c in df.columns if c.endswith("_days_diff")])


@query("ratio_features")
def q_ratio_features(spark, sf_dir):
    """Guarded ratio / difference catalogue (absent inputs skip their feature)."""
    src = fx.fx_credit(spark, sf_dir)
    out = fe.ratio_features(src)
    return out.select("case_id", *[c for c in out.columns if c not in src.columns])


@query("rfm_features")
def q_rfm_features(spark, sf_dir):
    """F6 + F7: recency from leniently parsed date strings, frequency and monetary ratios."""
    src = fx.fx_rfm(spark, sf_dir)
    out = fe.rfm_features(src)
    return out.select("case_id", *[c for c in out.columns if c not in src.columns])


@query("date_parts")
def q_date_parts(spark, sf_dir):
    """F8: twelve calendar parts of the order date."""
    d1 = fx.fx_depth1(spark, sf_dir).select("case_id", "num_group1", "orderdate_4D")
    return fe.date_parts(d1, ["orderdate_4D"])


@query("label_encode")
def q_label_encode(spark, sf_dir):
    """label codes in sorted order of the string form (null is the class 'None')."""
    d1 = fx.fx_depth1(spark, sf_dir).select("case_id", "num_group1", "priority_5M")
    return encode.fit_label_encoder(d1, ["priority_5M"], null_as="None").apply(d1)


@query("category_codes")
def q_category_codes(spark, sf_dir):
    """category codes from one dictionary for train and test, null -> -1."""
    d1 = fx.fx_depth1(spark, sf_dir).select("case_id", "num_group1", "priority_5M")
    return encode.fit_label_encoder(d1, ["priority_5M"], null_as=None).apply(d1)


@query("one_hot")
def q_one_hot(spark, sf_dir):
    """one column per category fitted on train (null is a category; unseen -> all zero)."""
    d2 = fx.fx_depth2(spark, sf_dir).select("case_id", "num_group1", "num_group2", "flag_10M")
    train = d2.where(hash_unit("case_id", "onehot") < 0.8)      # 80% of the cases fit the dictionary
    return encode.fit_one_hot(train, ["flag_10M"]).apply(d2)


@query("apply_threshold")
def q_apply_threshold(spark, sf_dir):
    """hard labels at 0.5 (>=) and at 0.518 (strict >)."""
    s = fx.score_table(spark, sf_dir, "a")
    return s.select("case_id", "actual_label", fe.apply_threshold(F.col("score"), 0.5).alias("label_ge"),
                    fe.apply_threshold(F.col("score"), 0.518, strict=True).alias("label_gt"))


@query("focal_loss")
def q_focal_loss(spark, sf_dir):
    """mean binary focal loss (gamma 2, alpha 0.25) of a score table."""
    return me.focal_loss(fx.score_table(spark, sf_dir, "a"))


# --------------------------------------------------------------------------
# metrics (M1-M14, W1, W3, A12, T11)
# --------------------------------------------------------------------------

def hard_labels(spark, sf_dir, seed="a", threshold=0.5):
    s = fx.score_table(spark, sf_dir, seed)
    return s.select("case_id", "actual_label", (F.col("score") >= threshold).cast("int").alias("predicted_label"))


@query("confusion")
def q_confusion(spark, sf_dir):
    """M1: tn, fp, fn, tp at threshold 0.5."""
    return me.confusion(hard_labels(spark, sf_dir))


@query("label_metrics")
def q_label_metrics(spark, sf_dir):
    """M2 + M15: accuracy, precision, recall, F1, balanced accuracy, FNR, ε-F1."""
    return me.label_metrics(hard_labels(spark, sf_dir))


@query("class_report")
def q_class_report(spark, sf_dir):
    """Precision, recall, F1, support per class."""
    return me.class_report(hard_labels(spark, sf_dir))


@query("roc_auc")
def q_roc_auc(spark, sf_dir):
    """M3 + M5 + M6 + M12: ROC AUC (ties ½), gini, average precision, KS."""
    return me.curve_summary(fx.score_table(spark, sf_dir, "a"))


@query("label_auc")
def q_label_auc(spark, sf_dir):
    """M4: ROC AUC of the hard labels (equals balanced accuracy)."""
    return me.label_curve(hard_labels(spark, sf_dir)).select("label_auc")


@query("average_precision")
def q_average_precision(spark, sf_dir):
    """M6: average precision (PR AUC) of every model's scores (one pass for all models)."""
    long = me.stack_scores(fx.fx_scores(spark, sf_dir), {s: f"score_{s}" for s in fx.SCORE_SEEDS})
    return me.curve_summary(long, group_cols=["model"]).select("model", "average_precision")


@query("roc_curve")
def q_roc_curve(spark, sf_dir):
    """M7: ROC points per distinct score."""
    return me.roc_curve(fx.score_table(spark, sf_dir, "a"))


@query("pr_curve")
def q_pr_curve(spark, sf_dir):
    """M7: precision / recall / F1 per distinct score."""
    return me.pr_curve(fx.score_table(spark, sf_dir, "a"))


@query("best_f1_threshold")
def q_best_f1_threshold(spark, sf_dir):
    """M8: F1-optimal threshold from the PR curve."""
    return me.best_f1_threshold(fx.score_table(spark, sf_dir, "a"))


@query("grid_threshold")
def q_grid_threshold(spark, sf_dir):
    """M9: best grid threshold (0.10 … 0.85) for each of the five metrics."""
    return me.grid_threshold(fx.score_table(spark, sf_dir, "a"), list(me.GRID_METRICS))


@query("cost_threshold")
def q_cost_threshold(spark, sf_dir):
    """Economic-cost threshold: FP · mean BI of the good + FN · mean ELI of the bad."""
    inputs = materialized(fx.fx_econ(spark, sf_dir))
    summary = {r["target"]: r for r in classes.econ_summary(fe.econ_indices(inputs)).collect()}
    benefit_good = summary[0]["avg_bi"] if 0 in summary else 0.0
    loss_bad = summary[1]["avg_eli"] if 1 in summary else 0.0
    return me.cost_threshold(fx.fx_case_scores(spark, sf_dir), benefit_good, loss_bad)


@query("ks_cumulative")
def q_ks_cumulative(spark, sf_dir):
    """KS from cumulative class shares of the hard labels."""
    return me.label_curve(hard_labels(spark, sf_dir)).select("ks")


@query("ks_roc")
def q_ks_roc(spark, sf_dir):
    """KS = max(tpr - fpr) of every model's scores (one pass for all models)."""
    long = me.stack_scores(fx.fx_scores(spark, sf_dir), {s: f"score_{s}" for s in fx.SCORE_SEEDS})
    return me.curve_summary(long, group_cols=["model"]).select("model", "ks")


@query("compare_models")
def q_compare_models(spark, sf_dir):
    """Metric table of the five models and the best by PR AUC."""
    long = me.stack_scores(fx.fx_scores(spark, sf_dir), {f"model_{s}": f"score_{s}" for s in fx.SCORE_SEEDS})
    return me.compare_models(long)


@query("evaluate_common")
def q_evaluate_common(spark, sf_dir):
    """The five models, each scoring other cases with repeats, compared on the cases that all of them scored."""
    from riskroll.plans import flows

    tables = {}
    for i, s in enumerate(fx.SCORE_SEEDS):
        t = fx.score_table(spark, sf_dir, s).where(F.col("case_id") % (7 + i) != 0)
        tables[f"model_{s}"] = t.unionByName(t.where(F.col("case_id") % 5 == 0))
    return flows.evaluation_stage(tables)


@query("cum_gain")
def q_cum_gain(spark, sf_dir):
    """Cumulative bad / good shares by descending score."""
    return me.cum_gain(fx.score_table(spark, sf_dir, "a"))


@query("score_histogram")
def q_score_histogram(spark, sf_dir):
    """50-bin histogram of the positives' scores."""
    s = fx.score_table(spark, sf_dir, "a").where(F.col("actual_label") == 1)
    return me.score_histogram(s)


@query("two_stage_bands")
def q_two_stage_bands(spark, sf_dir):
    """Stage-1 flags (score_a >= 0.4), stage-2 grades the flagged into bands; counts and bad rate."""
    s = fx.fx_scores(spark, sf_dir)
    return me.two_stage_bands(s, "score_a", "score_b", stage1_threshold=0.4, approve_below=0.5,
                              reject_from=0.8)


# --------------------------------------------------------------------------
# selection (L1-L4, W3) and models (T1-T10, S8); model keys are rows-only checks
# --------------------------------------------------------------------------

def model_frame(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    """Cleaned merged table with its feature list, split 80 / 20 per class (``is_valid``)."""
    cb = clean_base(spark, sf_dir)
    feats = clean.numeric_features(cb)
    return sa.stratified_split(cb.select("case_id", "target", "WEEK_NUM", *feats)), feats


@query("adversarial_auc")
def q_adversarial_auc(spark, sf_dir):
    """L2: per-feature AUC of a binned one-feature model for WEEK_NUM >= 65; keep < 0.65."""
    cb = clean_base(spark, sf_dir)
    return se.adversarial_auc(cb, clean.numeric_features(cb))


@query("topk_features")
def q_topk_features(spark, sf_dir):
    """The 20 features that separate the late period best (adversarial AUC)."""
    cb = clean_base(spark, sf_dir)
    return se.top_features(se.adversarial_auc(cb, clean.numeric_features(cb)), "auc", 20)


@query("null_importance")
def q_null_importance(spark, sf_dir):
    """L1: real vs permuted-label importance (3 seeded permutations); keep ratio > 1.5."""
    df, feats = model_frame(spark, sf_dir)
    return se.null_importance(df, feats)


@query("importance_topk")
def q_importance_topk(spark, sf_dir):
    """L3: the 60 features with the most splits."""
    df, feats = model_frame(spark, sf_dir)
    return se.importance_topk(df, feats)


def train_valid(spark, sf_dir) -> tuple[DataFrame, DataFrame, list[str]]:
    df, feats = model_frame(spark, sf_dir)
    df = materialized(df)
    return df.where(F.col("is_valid") == 0), df.where(F.col("is_valid") == 1), feats


@query("lasso_select")
def q_lasso_select(spark, sf_dir):
    """L4: lasso (alpha 0.005) coefficients on standardised features and the kept set."""
    train, _, feats = train_valid(spark, sf_dir)
    return mo.lasso_table(mo.fit_lasso(train, feats), spark)


@query("lasso_score")
def q_lasso_score(spark, sf_dir):
    """The lasso as a scorer on the validation rows (score = prediction)."""
    train, valid, feats = train_valid(spark, sf_dir)
    return mo.lasso_scores(train, valid, feats)


@query("svm_score")
def q_svm_score(spark, sf_dir):
    """Undersample -> scale -> lasso selection -> class-balanced linear SVM; margin scores."""
    train, valid, feats = train_valid(spark, sf_dir)
    return mo.svm_pipeline(train, valid, feats)[0]


def tree_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame, list[str], list[str]]:
    """Train and test rows of the hold-out split (R2) with their numeric and categorical features, nulls kept."""
    cb = clean.sentinel_null(clean.drop_sparse(merged(spark, sf_dir)))
    feats = clean.numeric_features(cb)
    cats = [f.name for f in cb.schema.fields if f.dataType.simpleString() == "string"]
    df = cb.select("case_id", "target", *feats, *cats)
    split = materialized(sa.holdout_split(df, *holdout_params(df)))
    return split.where("split = 'train'").drop("split"), split.where("split = 'test'").drop("split"), feats, cats


@query("gbt_score")
def q_gbt_score(spark, sf_dir):
    """Medians and modes of the train rows fill both tables (P12); class-weighted (n0/n1) boosted trees with indexed
    categoricals, grown until 100 rounds bring no gain of AUC on 20 % of the train rows; F1-optimal threshold on those;
    the test rows scored."""
    train, test, feats, cats = tree_tables(spark, sf_dir)
    fills = clean.fit_imputer(train)
    return mo.boosted_scores(fills.apply(train), fills.apply(test), feats, cats, mo.GBTParams())


@query("gbt_score_b")
def q_gbt_score_b(spark, sf_dir):
    """Second boosted-tree setting ((1-p)/p weights, learning rate 0.03, up to 4000 trees, patience 300; nulls are
    left to the trees)."""
    train, test, feats, cats = tree_tables(spark, sf_dir)
    return mo.boosted_scores(train, test, feats, cats, GBT_B)


GBT_B = mo.GBTParams(max_iter=4000, max_depth=6, step_size=0.03, weighting="weight_odds", patience=300)


@query("importance_table")
def q_importance_table(spark, sf_dir):
    """Splits per feature of the boosted trees of T2, descending."""
    df, feats = model_frame(spark, sf_dir)
    return mo.gbt_importances(boosting.fit_boosted(df, feats, mo.GBTParams()).pipeline(), feats, spark)


@query("mlp_score")
def q_mlp_score(spark, sf_dir):
    """T4: undersample (0.2) -> ADASYN (0.5) -> scale -> MLP [n, 64, 32, 2]; label = p > 0.518."""
    return mo.mlp_pipeline(*train_valid(spark, sf_dir))


def snapped_features(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    """The cleaned table's numeric features, rounded so that another engine measures the same distances."""
    cb = clean_base(spark, sf_dir)
    feats = clean.numeric_features(cb)
    return materialized(cb.select("case_id", "target", *[snap(F.col(f)).alias(f) for f in feats])), feats


@query("adasyn_density")
def q_adasyn_density(spark, sf_dir):
    """Majority rows among the 5 nearest neighbours of every minority row, and the synthetic rows due to it."""
    return nb.adasyn_density(*snapped_features(spark, sf_dir))


@query("adasyn")
def q_adasyn(spark, sf_dir):
    """The synthetic minority rows."""
    return nb.adasyn_rows(*snapped_features(spark, sf_dir))


STACK_BASES = {"gbt": mo.GBTParams(), "mlp": mo.MLPParams()}


@query("stack_oof")
def q_stack_oof(spark, sf_dir):
    """T5 + T6: 5-fold out-of-fold probabilities of a boosted-tree base and an MLP base."""
    train, _, feats = train_valid(spark, sf_dir)
    return mo.stack_oof(train, feats, STACK_BASES)


@query("stack_score")
def q_stack_score(spark, sf_dir):
    """Meta logistic regression over the bases' probabilities scores the validation rows."""
    return mo.stack_score(*train_valid(spark, sf_dir), STACK_BASES)


@query("random_search")
def q_random_search(spark, sf_dir):
    """15 seeded random draws of tree settings scored by mean PR AUC over 5 stratified folds."""
    train, _, feats = train_valid(spark, sf_dir)
    return mo.random_search(train, feats)


@query("mlp_search")
def q_mlp_search(spark, sf_dir):
    """20 seeded random draws of hidden layers and iterations of the network, mean PR AUC over 3 folds."""
    train, _, feats = train_valid(spark, sf_dir)
    return mo.mlp_search(train, feats)


@query("batch_score")
def q_batch_score(spark, sf_dir):
    """S8 + T8: grow, save the pipeline to the shared checkpoint folder, load it back, score."""
    import uuid

    df, feats = model_frame(spark, sf_dir)
    df = materialized(df)
    model = boosting.fit_boosted(df, feats, mo.GBTParams()).pipeline()
    path = f"{ensure_checkpoint_dir(spark)}/models/gbt-{uuid.uuid4().hex}"
    mo.save_model(model, path)
    return mo.batch_score(mo.load_model(path), df.where(F.col("is_valid") == 1), 0.5)


@query("incremental_f1")
def q_incremental_f1(spark, sf_dir):
    """Tp / fp / fn / tn and ε-F1 accumulated over micro-batches of score files
    (Structured Streaming, state in the shared checkpoint folder); prediction = score > 0.5."""
    import uuid

    from riskroll.streaming import run_incremental_f1

    work = f"{ensure_checkpoint_dir(spark)}/stream-f1-{uuid.uuid4().hex}"
    scores = fx.score_table(spark, sf_dir, "a")
    # the score table lands as Spark partitions it: each file becomes one micro-batch
    scores.write.parquet(f"{work}/source")
    final, _ = run_incremental_f1(spark, f"{work}/source", "case_id long, score double, actual_label int",
                                  threshold=0.5, files_per_batch=1, work_dir=work)
    return final


@query("feature_table")
def q_feature_table(spark, sf_dir):
    """E2 end to end: hold-out split, clean, derive (days-diff, ratios, RFM), clean again, numeric filter, the three
    selectors in turn (null importance, adversarial validation, top 60 by splits) and projection of the whole merged
    table."""
    from riskroll.plans import flows

    return flows.feature_stage(merged(spark, sf_dir)).table
