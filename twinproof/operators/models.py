"""Model-based metrics with distributed random forests.

Training follows the score definitions; forests (``forests``) learn from every row
and are not bit-equal to other libraries. Whole tables are used, nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.functions.scalar import attack_score, efficacy_score, ratio
from twinproof.operators import encoding, fairness, forests, privacy, sampling, utility
from twinproof.operators.distributions import unpivoted
from twinproof.operators.running import column_quantiles
from twinproof.session import new_path, settle

TREES = 100
SEED = 42
MAX_BINS = 64
DEPTH = 12  # deep trees: a weak attacker would flatter the synthetic table
DRAW = "_draw"


def feature_frames(
    real: DataFrame, synth: DataFrame, numeric: Sequence[str], categorical: Sequence[str], keep: Sequence[str] = (), fill: str = "median"
) -> tuple[DataFrame, DataFrame]:
    """Both tables with a ``features`` vector and the ``keep`` columns; all others are dropped.

    Labels are coded on the union; missing numbers (NaN too) take their own table's
    median, which is only computed when there are any, or with ``fill="zero"`` 0.
    """
    if fill not in ("median", "zero"):
        raise ValueError("fill is median or zero")
    columns = list(dict.fromkeys([*numeric, *categorical]))
    kept = [F.col(c).alias(f"_keep_{c}") for c in keep]
    out = []
    codes = encoding.dictionary([real, synth], categorical) if categorical else None
    for df in (real, synth):
        floats = {f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")}
        one = df.select(*[F.nanvl(F.col(c), F.lit(None)).alias(c) if c in floats else c for c in columns], *kept)
        if codes is not None:
            one = encoding.encode(one, codes, list(categorical))
        nulls = one.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in numeric]).first() if numeric else {}
        gaps = [c for c in numeric if nulls[c]]
        if gaps and fill == "zero":
            one = one.fillna(0.0, gaps)
        elif gaps:
            counts = unpivoted(one, gaps, "double").groupBy("column", "value").agg(F.count("*").alias("n"))
            fills = {r["column"]: r["quantile"] for r in column_quantiles(counts, ["column"], "value", "n", [0.5]).collect()}
            one = one.fillna({c: fills.get(c, 0.0) for c in gaps})
        vectors = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="error").transform(one)
        kept_now = [F.col(f"_keep_{c}").alias(c) for c in keep]
        out.append(settle(vectors.select("features", *kept_now), "features"))
    return out[0], out[1]


def forest(trees: int = TREES, depth: int = DEPTH, label: str = "label", regression: bool = False):
    kind = RandomForestRegressor if regression else RandomForestClassifier
    # cached node ids: rows do not walk down from the root again for every level; the model is the same
    return kind(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, maxBins=MAX_BINS, seed=SEED, cacheNodeIds=True)


def grown(rows: DataFrame, label: str = "label", trees: int = TREES, depth: int = DEPTH, regression: bool = False) -> forests.Forest:
    """A forest trained on every one of ``rows``, however many; the seed repeats it however the table is stored."""
    return forests.grow(rows, label, trees, depth, MAX_BINS, SEED, regression)


def fit_sample(rows: DataFrame, fit_rows: int) -> DataFrame:
    """For callers that ask for a bounded draw; no query does. About ``fit_rows`` rows at most, with their place in the layout. Of n equal rows
    n times the share stay, rounded up or down by a hash of their content, so copies are
    neither all in nor all out, and the draw does not depend on how the table is stored."""
    n = rows.count()
    if n <= fit_rows:
        return rows.withColumn(DRAW, F.xxhash64(vector_to_array("features")))
    others = [c for c in rows.columns if c != "features"]
    counted = rows.select(vector_to_array("features").alias("_x"), *others).groupBy("_x", *others).agg(F.count("*").alias("_n"))
    spot = F.pmod(F.xxhash64("_x", *others), F.lit(1_000_003)) / 1_000_003
    kept = counted.withColumn("_n", F.floor(F.col("_n") * F.lit(fit_rows / n) + spot).cast("int")).where("_n > 0")
    copies = kept.select("_x", *others, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy"))
    return copies.select(array_to_vector("_x").alias("features"), *others, F.xxhash64("_x", "_copy").alias(DRAW))


def fit(learner, rows: DataFrame):
    """Train a learner of Spark ML on all rows, laid out by a hash of their content, so that
    the seed repeats the model however the table is stored. Queries use ``grown``."""
    spark = rows.sparkSession
    drawn = rows.withColumn(DRAW, F.xxhash64(vector_to_array("features")))
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    order = [DRAW, *(c for c in ("is_real", "label") if c in rows.columns)]
    return learner.fit(drawn.repartition(parts, DRAW).sortWithinPartitions(*order))


def _trees(model, spark) -> list[tuple[np.ndarray, ...]]:
    """The trees of a fitted forest, as its writer stores them: (feature, edge, children, value) by node.

    A leaf is its own child; children are (above the edge, up to it). The value is the share of
    each class, or the prediction of a regression. Their size follows trees and depth, not rows.
    """
    path = new_path(spark, "forest")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").withColumn("edge", F.get("split.leftCategoriesOrThreshold", F.lit(0)))
    nodes = nodes.select("treeID", "id", "prediction", "impurityStats", "leftChild", "rightChild", "split.featureIndex", "split.numCategories", "edge")
    table = nodes.orderBy("treeID", "id").toArrow()
    stats = table.column("impurityStats").combine_chunks().flatten().to_numpy().reshape(len(table), -1)
    tree_of, low, high, axis, kinds, edges, guess = (
        table.column(c).to_numpy() for c in ("treeID", "leftChild", "rightChild", "featureIndex", "numCategories", "edge", "prediction")
    )
    leaves = low < 0
    if (kinds[~leaves] != -1).any():
        raise ValueError("features of a forest are numbers")
    trees = []
    for first, last in zip(*(np.searchsorted(tree_of, np.unique(tree_of), side) for side in ("left", "right"))):
        part = slice(first, last)
        own, leaf = np.arange(last - first), leaves[part]
        feature, edge = np.where(leaf, 0, axis[part]), np.where(leaf, np.inf, edges[part])
        children = np.stack([np.where(leaf, own, high[part]), np.where(leaf, own, low[part])], axis=1).ravel()
        value = guess[part][:, None]
        if not isinstance(model, RandomForestRegressionModel):
            total = np.zeros(len(own))
            for k in range(stats.shape[1]):  # in the order of the model's own sum
                total += stats[part, k]
            value = np.divide(stats[part], total[:, None], out=np.zeros((len(own), stats.shape[1])), where=total[:, None] != 0)
        trees.append((feature.astype(np.int32), edge, children.astype(np.int32), value))
    return trees


def _sums(x: np.ndarray, trees) -> np.ndarray:
    """Values of the leaves each row falls into, added up tree by tree as the model does."""
    flat, first = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
    out = np.zeros((len(x), trees[0][3].shape[1]))
    for feature, edge, children, value in trees:
        at = np.zeros(len(x), np.int64)
        while True:
            below = children[2 * at + (flat[first + feature[at]] <= edge[at])]
            if np.array_equal(below, at):
                break
            at = below
        out += value[at]
    return out


def scored(model, rows: DataFrame, keep: Sequence[str], score: str | None = None) -> DataFrame:
    """The ``keep`` columns of every row with the model's ``prediction`` and, in a column of
    the name ``score``, a classification's probability of class 1. The same numbers as the model's
    own transform: tasks walk the trees for a batch of rows at once, not row by row."""
    spark = rows.sparkSession
    own = isinstance(model, forests.Forest)
    sent = spark.sparkContext.broadcast(model.trees if own else _trees(model, spark))
    regression = model.regression if own else isinstance(model, RandomForestRegressionModel)
    names = [*keep, "prediction", *([score] if score else [])]
    given = rows.select(*keep, vector_to_array("features").alias("_x"))

    def run(batches):
        for batch in batches:
            points = batch.column(len(keep))
            x = points.flatten().to_numpy(zero_copy_only=False).reshape(len(points), -1) if len(points) else np.zeros((0, 1))
            sums = _sums(x, sent.value)
            found = [sums[:, 0] / len(sent.value) if regression else sums.argmax(axis=1).astype(float)]
            if score:
                total = np.zeros(len(sums))
                for k in range(sums.shape[1]):
                    total += sums[:, k]
                found.append(sums[:, 1] / np.where(total == 0, 1, total))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(f) for f in found]], names=names)

    types = [f"`{c}` {t}" for c, t in given.dtypes[:-1]] + [f"`{c}` double" for c in names[len(keep) :]]
    return given.mapInArrow(run, ", ".join(types))


def _attack(rows: DataFrame, depth: int) -> DataFrame:
    """Train on all ``is_train`` rows; (is_real, predicted, score) of the others."""
    model = grown(rows.where("is_train"), "is_real", depth=depth)
    tested = scored(model, rows.where(~F.col("is_train")), ["is_real"], "score")
    return settle(tested.select("is_real", F.col("prediction").alias("predicted"), "score"), "attack")


def attack_predictions(
    real: DataFrame, synth: DataFrame, numeric: Sequence[str], categorical: Sequence[str], test_share: float = 0.3, depth: int = DEPTH
) -> DataFrame:
    """(is_real, predicted, score) of the held-out rows of a forest telling real rows from synthetic ones."""
    r, s = feature_frames(real, synth, numeric, categorical)
    arrays = [df.select(vector_to_array("features").alias("x")) for df in (r, s)]
    both = sampling.split(sampling.balanced_union(*arrays), test_share, ["is_real"])
    rows = settle(
        both.select(array_to_vector("x").alias("features"), "is_real", "is_train"), "attack-rows"
    )
    return _attack(rows, depth)


def membership_inference(
    real: DataFrame, synth: DataFrame, numeric: Sequence[str], categorical: Sequence[str], test_share: float = 0.3, depth: int = DEPTH
) -> DataFrame:
    """Attack result of that forest."""
    return privacy.attack_result(attack_predictions(real, synth, numeric, categorical, test_share, depth), "is_real", "predicted")


def membership_inference_evaluator(
    real: DataFrame, synth: DataFrame, numeric: Sequence[str], categorical: Sequence[str], depth: int = DEPTH
) -> DataFrame:
    """Evaluator variant: accuracy, AUC and score over all rows that were not trained on."""
    r, s = feature_frames(real, synth, numeric, categorical)
    arrays = [df.select(vector_to_array("features").alias("x")) for df in (r, s)]
    both = sampling.split(sampling.labelled_union(*arrays), 0.3)
    rows = settle(
        both.select(array_to_vector("x").alias("features"), "is_real", "is_train"), "attack-rows"
    )
    tested = _attack(rows, depth)
    auc = privacy.roc_auc(tested, "is_real", "score").scalar()
    accuracy = F.col("attack_accuracy")
    return privacy.attack_result(tested, "is_real", "predicted").select(
        accuracy.alias("mia_accuracy"), auc.alias("mia_auc"), attack_score(accuracy).alias("privacy_score")
    )


def efficacy_predictions(
    real: DataFrame,
    synth: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    target: str,
    classification: bool = True,
    test_share: float = 0.3,
    depth: int = DEPTH,
) -> DataFrame:
    """(model, label, prediction) of the held-out real rows: by a model trained on
    synthetic rows, and by one trained on the other real rows ("baseline")."""
    numbers = [c for c in numeric if c != target]
    labels = [c for c in categorical if c != target]
    parts = sampling.split(real, test_share)
    coded_real, coded_synth = parts, synth
    if classification:
        codes = encoding.dictionary([real, synth], [target])
        coded_real = encoding.encode(parts.withColumn("label", F.col(target)), _as_label(codes, target), ["label"])
        coded_synth = encoding.encode(synth.withColumn("label", F.col(target)), _as_label(codes, target), ["label"])
    else:
        coded_real = parts.withColumn("label", F.col(target).cast("double"))
        coded_synth = synth.withColumn("label", F.col(target).cast("double"))
    r, s = feature_frames(coded_real, coded_synth.withColumn("is_train", F.lit(True)), numbers, labels, ["label", "is_train"])
    test = r.where(~F.col("is_train"))
    learners = {"baseline": r.where("is_train"), "synthetic": s}
    out = None
    for name, train in learners.items():
        model = grown(train.where(F.col("label").isNotNull()), depth=depth, regression=not classification)
        part = scored(model, test, ["label"]).select(F.lit(name).alias("model"), "label", "prediction")
        out = part if out is None else out.unionByName(part)
    return settle(out, "scored")


def train_on_synthetic(
    real: DataFrame,
    synth: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    target: str,
    classification: bool = True,
    test_share: float = 0.3,
    depth: int = DEPTH,
) -> DataFrame:
    """Train on synthetic, test on real, against a model trained on real rows."""
    judged = efficacy_predictions(real, synth, numeric, categorical, target, classification, test_share, depth)

    def of(measure: str, name: str):
        return F.max(F.when(F.col("model") == name, F.col(measure)))

    if classification:
        table = utility.classification_scores(judged, "label", "prediction", by=["model"])
        out = table.agg(
            of("accuracy", "baseline").alias("baseline_accuracy"),
            of("weighted_f1", "baseline").alias("baseline_f1"),
            of("accuracy", "synthetic").alias("synthetic_accuracy"),
            of("weighted_f1", "synthetic").alias("synthetic_f1"),
        ).withColumns(
            {
                "efficacy_ratio": ratio(F.col("synthetic_accuracy"), F.col("baseline_accuracy")),
                "f1_ratio": ratio(F.col("synthetic_f1"), F.col("baseline_f1")),
            }
        )
    else:
        table = utility.regression_scores(judged, "label", "prediction", by=["model"])
        out = table.agg(
            of("r2", "baseline").alias("baseline_r2"),
            of("rmse", "baseline").alias("baseline_rmse"),
            of("r2", "synthetic").alias("synthetic_r2"),
            of("rmse", "synthetic").alias("synthetic_rmse"),
        ).withColumn(
            "efficacy_ratio",
            F.when(F.col("baseline_r2") > 0, F.greatest(F.lit(0.0), F.col("synthetic_r2") / F.nullif(F.col("baseline_r2"), F.lit(0.0)))).otherwise(F.lit(0.0)),
        )
    q = F.col("efficacy_ratio")
    return out.withColumns({"score": efficacy_score(q), "passed": q >= 0.7})


def _as_label(codes: DataFrame, target: str) -> DataFrame:
    return codes.withColumn("column", F.when(F.col("column") == target, F.lit("label")).otherwise(F.col("column")))


def evaluator_predictions(
    real: DataFrame, synth: DataFrame, numeric: Sequence[str], target: str, classification: bool, depth: int = DEPTH
) -> DataFrame:
    """(label, prediction) of all real rows by a model of number features trained on all synthetic rows."""
    numbers = [c for c in numeric if c != target]
    if classification:
        codes = _as_label(encoding.dictionary([real, synth], [target]), target)
        r0 = encoding.encode(real.withColumn("label", F.col(target)), codes, ["label"])
        s0 = encoding.encode(synth.withColumn("label", F.col(target)), codes, ["label"])
    else:
        r0 = real.withColumn("label", F.col(target).cast("double"))
        s0 = synth.withColumn("label", F.col(target).cast("double"))
    r, s = feature_frames(r0, s0, numbers, [], ["label"])
    model = grown(s, depth=depth, regression=not classification)
    return settle(scored(model, r, ["label"]), "scored")


def evaluator_efficacy(
    real: DataFrame, synth: DataFrame, numeric: Sequence[str], target: str, classification: bool, depth: int = DEPTH
) -> DataFrame:
    """Evaluator variant: number features only, trained on all synthetic rows and tested on all real ones."""
    tested = evaluator_predictions(real, synth, numeric, target, classification, depth)
    if classification:
        out = utility.classification_scores(tested, "label", "prediction")
        return out.select("accuracy", F.col("weighted_f1").alias("f1_score"), (F.col("accuracy") * 100).alias("ml_efficacy_score"))
    out = utility.regression_scores(tested, "label", "prediction")
    return out.select("rmse", "normalized_rmse", F.greatest(F.lit(0.0), 100 - F.col("normalized_rmse") * 100).alias("ml_efficacy_score"))


def equal_opportunity(
    real: DataFrame,
    synth: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    protected: Sequence[str],
    target: str,
    positive_code: int = 1,
    depth: int = DEPTH,
) -> DataFrame:
    """Equal opportunity of a 50-tree model trained on the synthetic table.

    Neither target nor protected columns are features, so one model serves
    all attributes. The positive class is the second label in sort order.
    """
    skip = {target, *protected}
    numbers = [c for c in numeric if c not in skip]
    labels = [c for c in categorical if c not in skip]
    if not numbers and not labels:
        raise ValueError("no feature columns left")
    codes = _as_label(encoding.dictionary([real, synth], [target]), target)
    r0 = encoding.encode(real.withColumn("label", F.col(target)), codes, ["label"])
    s0 = encoding.encode(synth.withColumn("label", F.col(target)), codes, ["label"])
    r, s = feature_frames(r0, s0, numbers, labels, ["label", *protected], fill="zero")
    model = grown(s, trees=50, depth=depth)
    tested = settle(scored(model, r, ["label", *protected]), "predicted")
    rates = None
    for a in protected:
        part = fairness.true_positive_rates(tested, a, "label", "prediction", positive_code)
        rates = part if rates is None else rates.unionByName(part)
    return fairness.equal_opportunity(rates)
