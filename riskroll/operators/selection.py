"""Feature selectors (L1-L3) that return name tables, not data.

* L1 null importance: importance with the real labels against the mean
  importance over seeded label permutations (R7).
* L2 adversarial validation: how well each single feature separates a late
  period from the rest, for all features in one job (no per-feature loop).
* L3 top-k by model importance.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskroll.operators import boosting, sampling
from riskroll.operators.ordered import MAX_OFFSET_ROWS, bounded_collect, running_sums

# Fixed values of the original selectors
NULL_IMPORTANCE_RATIO = 1.5
NULL_IMPORTANCE_EPS = 1e-5
ADVERSARIAL_CUT = 65
ADVERSARIAL_KEEP_BELOW = 0.65
ADVERSARIAL_BINS = 255


def null_importance(df: DataFrame, features: Sequence[str], label: str = "target", rounds: int = 3, trees: int = 500,
                    depth: int = 5, key: str = "case_id", threads: int = 2) -> DataFrame:
    """L1: ``feature, real_importance, null_importance, score, keep`` with
    ``score = real / (mean null + 1e-5)`` and ``keep = score > 1.5``.

    Importance is the number of splits on a feature.  Only importance is wanted, so ``trees`` random trees of about
    31 leaves take the place of serial boosting.  The real and the permuted labels stand side by side in one matrix;
    ``threads`` labels are fitted at a time, each by one small forest after the other.
    """
    slim = df.select(key, label)
    labels = slim.withColumnRenamed(label, "_y0")
    for r in range(rounds):
        permuted = sampling.permute_labels(slim, label, key, seed=f"null{r}", name=f"_y{r + 1}")
        labels = labels.join(permuted.select(key, f"_y{r + 1}"), key)
    ys = [f"_y{r}" for r in range(rounds + 1)]
    made = boosting.matrix(df.select(key, *features).join(labels, key), features, ys)
    counts = boosting.in_parallel(df.sparkSession, [
        (lambda y: lambda: boosting.forest_split_counts(made.rows, features, y, trees, depth, made.max_bins, threads=1))(y)
        for y in ys], threads)
    rows = []
    for f in features:
        real, null = float(counts[0][f]), sum(c[f] for c in counts[1:]) / rounds
        score = real / (null + NULL_IMPORTANCE_EPS)
        rows.append((f, real, null, score, int(score > NULL_IMPORTANCE_RATIO)))
    return df.sparkSession.createDataFrame(
        rows, "feature string, real_importance double, null_importance double, score double, keep int")


def importance_topk(df: DataFrame, features: Sequence[str], k: int = 60, label: str = "target", trees: int = 1000,
                    depth: int = 5) -> DataFrame:
    """L3: the ``k`` features with the most splits in ``trees`` random trees (ties by name)."""
    made = boosting.matrix(df, features, [label])
    counts = boosting.forest_split_counts(made.rows, features, label, trees, depth, made.max_bins)
    table = df.sparkSession.createDataFrame([(f, int(counts[f])) for f in features], "feature string, importance long")
    return table.orderBy(F.col("importance").desc(), "feature").limit(k)


def adversarial_auc(df: DataFrame, features: Sequence[str], period_col: str = "WEEK_NUM",
                    cut: int = ADVERSARIAL_CUT, bins: int = ADVERSARIAL_BINS, exact_bins: bool = True) -> DataFrame:
    """L2: per feature, the in-sample AUC of a one-feature equal-frequency-bin model that
    predicts ``period >= cut``; ``keep = auc < 0.65``.

    All features together, in ``bins`` equal-frequency bins each: a value's bin is the share of values below it, in
    ``bins``-ths (ties never split).  The bin edges are exact ranks of the column (``equal_frequency_cuts``), so no
    table of values is made; the bin's share of ``y = 1`` is the score, and the AUC of that score is taken per
    feature with the same distinct-score prefix sums as ``metrics.curve_summary``.  Null values form a bin of their
    own.

    ``exact_bins=False`` cuts the bins at per-feature ``percentile_approx``
    points instead (one sketch aggregate per feature, ``bins - 1`` cut points each, as histogram-based boosting bins
    its inputs), which saves two passes.
    """
    y = (F.col(period_col) >= F.lit(cut)).cast("int")
    pairs = ", ".join(f"'{f}', CAST(`{f}` AS DOUBLE)" for f in features)
    long = df.select(y.alias("y"), *[F.col(f) for f in features]).selectExpr(
        "y", f"stack({len(features)}, {pairs}) AS (feature, value)")
    if not exact_bins:
        return _auc_from_bins(_sketch_bins(long, bins))
    cuts = equal_frequency_cuts(df, features, bins)
    edges = {f: [-math.inf, *sorted({math.nextafter(c, math.inf) for c in cuts[f] if c < math.inf}), math.inf] for f in features}
    joined = [f for f in features if math.inf not in cuts[f]]  # NaN is above all; only a cut at infinity parts it from the rest
    return _auc_from_bins(_bucketed(df.withColumn("_y", y), edges, ["_y"], nan_last=joined).groupBy("feature", "bucket").agg(
        F.sum("_y").alias("pos"), F.count(F.lit(1)).alias("n")).withColumnRenamed("bucket", "bin"))


# Probes lie this share around a wanted rank (the sketch errs by half of it), a bucket that is too large is
# cut into this many, and at most so many values of a bucket are sorted in one group.
PROBE_SHARE = 2e-4
SKETCH_ACCURACY = 10_000
REFINE = 256
GROUP_VALUES = 10_000


def _bucketed(df: DataFrame, splits: dict[str, list[float]], keep: Sequence[str] = (), values: bool = False,
              infinite: bool = False, nan_last: Sequence[str] = ()) -> DataFrame:
    """``feature, bucket`` (and ``value``) beside ``keep``, a row per row and feature.

    Bucket i holds ``splits[i] <= value < splits[i + 1]`` (binary search in the JVM), null values are in bucket -1.
    With ``infinite``, infinity and NaN have the two buckets beyond the last; otherwise infinity is in the last one and
    NaN beyond it, or in the last one too for the features of ``nan_last``."""
    names = list(splits)

    def bucket(i: int, f: str) -> Column:
        v, beyond = F.col(f"_v{i}"), max(len(splits[f]), 3) - 1
        out = F.when(v.isNull(), -1)
        if infinite:
            out = out.when(F.isnan(v), beyond + 1).when(v == math.inf, beyond)
        elif f in nan_last:
            out = out.when(F.isnan(v), beyond - 1)
        return out.otherwise(F.col(f"_b{i}").cast("int")).alias("bucket")

    wide = df.select(*keep, *[F.col(f"`{f}`").cast("double").alias(f"_v{i}") for i, f in enumerate(names)])
    made = Bucketizer(splitsArray=[splits[f] if len(splits[f]) > 2 else [-math.inf, 0.0, math.inf] for f in names],
                      inputCols=[f"_v{i}" for i in range(len(names))], outputCols=[f"_b{i}" for i in range(len(names))],
                      handleInvalid="keep").transform(wide)
    cells = F.explode(F.array(*[F.struct(
        F.lit(f).alias("feature"), bucket(i, f), *[F.col(f"_v{i}").alias("value")] * values) for i, f in enumerate(names)])).alias("cell")
    return made.select(*keep, cells).select(*keep, "cell.*")


def _splits(probes: set[float]) -> tuple[list[float], list[float | None]]:
    """Bucket edges that give every probe a bucket of its own, and the value each bucket holds (None: an open one)."""
    edges, value = [-math.inf], [None]
    for p in sorted(probes):
        if p == edges[-1]:
            value[-1] = p
        elif p < math.inf:
            edges.append(p)
            value.append(p)
        after = math.nextafter(p, math.inf)
        if after < math.inf:
            edges.append(after)
            value.append(None)
    return edges + [math.inf], value


def equal_frequency_cuts(df: DataFrame, features: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Per feature, its values (as doubles) of rank ``ceil(b n / bins)``, b from 1 to bins - 1, among n non-null ones.

    Many exact ranks of many columns at once: a sketch per column gives probes around every rank; one pass counts the
    rows at and between the probes (map-side; at most ``6 bins`` counts a feature reach the driver); a bucket between
    two probes that holds a wanted rank and more than ``GROUP_VALUES`` values is cut by a sketch of its own and counted
    again; of the small ones left, about 4 in 100 rows in all, each is sorted in a group of its own.  The same steps
    run at every size, and no table of values is written.
    """
    shares = [i / bins + d for i in range(1, bins) for d in (-PROBE_SHARE, 0.0, PROBE_SHARE)]
    shares = sorted({min(1.0, max(0.0, x)) for x in shares})
    whole = {f: [-math.inf, 0.0, math.inf] for f in features}
    known = _bucketed(df, whole, values=True).where(F.col("value").isNotNull())
    probes: dict[str, set[float]] = {f: set() for f in features}
    for r in known.groupBy("feature").agg(F.percentile_approx("value", shares, SKETCH_ACCURACY).alias("at")).collect():
        probes[r["feature"]] = {x for x in r["at"] if x < math.inf}
    while True:
        made = {f: _splits(probes[f] or {0.0}) for f in features}
        splits = {f: edges for f, (edges, _) in made.items()}
        counts: dict[str, dict[int, int]] = {f: {} for f in features}
        for r in bounded_collect(_bucketed(df, splits, infinite=True).where("bucket >= 0").groupBy("feature", "bucket").count(),
                                 MAX_OFFSET_ROWS, "bucket counts (features x probes)"):
            counts[r["feature"]][r["bucket"]] = r["count"]
        cuts: dict[str, list[float]] = {f: [] for f in features}
        wanted: dict[tuple[str, int], list[int]] = {}  # ranks inside the open buckets
        for f in features:
            n = sum(counts[f].values())
            ranks = iter(sorted({-(-b * n // bins) for b in range(1, bins)} - {0}))
            rank, before = next(ranks, None), 0
            for bucket in sorted(counts[f]):
                upto, value = before + counts[f][bucket], made[f][1]
                while rank is not None and rank <= upto:
                    if bucket < len(value) and value[bucket] is not None:
                        cuts[f].append(value[bucket])
                    elif bucket == len(value):
                        cuts[f].append(math.inf)
                    elif bucket < len(value):  # else it is NaN: no value is larger
                        wanted.setdefault((f, bucket), []).append(rank - before)
                    rank = next(ranks, None)
                before = upto
        if not wanted:
            return cuts
        large = [(f, b) for f, b in wanted if counts[f][b] > GROUP_VALUES]
        chosen = df.sparkSession.createDataFrame(
            [(f, b, wanted[f, b]) for f, b in large or wanted], "feature string, bucket int, ranks array<int>")
        inside = _bucketed(df, splits, values=True, infinite=True).join(F.broadcast(chosen), ["feature", "bucket"])  # features x bins rows
        if not large:
            held = inside.groupBy("feature", "bucket").agg(F.sort_array(F.collect_list("value")).alias("held"), F.first("ranks").alias("ranks"))
            for r in held.select("feature", F.transform("ranks", lambda k: F.element_at("held", k)).alias("cuts")).collect():
                cuts[r["feature"]] += r["cuts"]
            return cuts
        grid = [i / REFINE for i in range(REFINE + 1)]
        for r in inside.groupBy("feature", "bucket").agg(F.percentile_approx("value", grid, SKETCH_ACCURACY).alias("at")).collect():
            probes[r["feature"]].update(r["at"])


def _sketch_bins(long: DataFrame, bins: int) -> DataFrame:
    """``feature, bin, pos, n`` with bins cut at approximate per-feature quantiles (nulls: bin -1)."""
    probs = [i / bins for i in range(1, bins)]
    cuts = long.where(F.col("value").isNotNull()).groupBy("feature").agg(
        F.array_distinct(F.percentile_approx("value", probs, 10000)).alias("cuts"))
    # one row of cut points per feature: bounded by the number of features
    joined = long.join(F.broadcast(cuts), "feature", "left")
    bin_ = F.when(F.col("value").isNull(), F.lit(-1)).otherwise(
        F.size(F.filter(F.col("cuts"), lambda c: c <= F.col("value"))))
    return joined.groupBy("feature", bin_.alias("bin")).agg(F.sum("y").alias("pos"),
                                                           F.count(F.lit(1)).alias("n"))


def _auc_from_bins(binned: DataFrame) -> DataFrame:
    """Per feature: the bin's positive share is the score; AUC of that score against y."""
    per_bin = binned.groupBy("feature", "bin").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    scored = per_bin.select("feature", (F.col("pos") / F.col("n")).alias("score"), "pos",
                            (F.col("n") - F.col("pos")).alias("neg"))
    by_score = scored.groupBy("feature", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    cum = running_sums(by_score, "score", ["pos", "neg"], group_cols=["feature"], descending=True, totals=True)
    auc_term = F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0)
    auc = cum.groupBy("feature").agg(
        F.try_divide(F.sum(auc_term), F.max(F.col("total_pos").cast("double")) * F.max("total_neg")).alias("auc"))
    return auc.select("feature", "auc", (F.coalesce(F.col("auc"), F.lit(0.5)) < ADVERSARIAL_KEEP_BELOW)
                      .cast("int").alias("keep"))


def top_features(table: DataFrame, value_col: str, k: int = 20) -> DataFrame:
    """The ``k`` largest ``value_col`` rows (ties by feature name)."""
    return table.orderBy(F.col(value_col).desc(), F.col("feature")).limit(k)

