"""Learners over feature tables, on pyspark.ml; forecasts out of
fold and stacking (M11, M12) by the fits of ``nested``.

A feature table has match_id, an order (place, from decisions.ordered_place) and numeric
columns; labels are 0 home, 1 draw, 2 away. Every fit sees only rows before the ones it
scores. A fit is a few passes over its training rows; what reaches the driver is the model
and statistics of columns, never rows.

Nulls in features are imputed by the training median, then 0; rows with a null label are not
trained on. A training set with a single class gives that class, clipped like any forecast.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from terrace.operators import boosting, nested, ranks

SIDES = ("home", "draw", "away")
P = ("p_home", "p_draw", "p_away")
#: Never features: keys, dates and what is known only after the match.
OUTCOMES = ("match_id", "match_date", "dn", "season", "place", "total", "fold", "outcome", "home_team", "away_team", "goals_home", "goals_away", "ht_goals_home", "ht_goals_away", "home_points", "away_points", "total_goals", "over_2_5", "btts")
LOW, HIGH = 0.02, 0.96
LEAST_VARIANCE, MOST_CORRELATED = 1e-10, 0.95
TAILS = (0.001, 0.999)
#: A fit is many short passes over its rows: a task of a pass takes about this many at least.
#: Rows stay where they lie, so that no fit leaves shuffle files; only those of fewer files
#: than cores are dealt anew.
ROWS_A_TASK = 50_000
#: Independent fits that run at once, and rows that they may hold together: each keeps its
#: training vectors, and the learner its own form of them, in memory while it runs.
FITS, ROWS_HELD = 8, 8_000_000


def at_once(df: DataFrame, work, items: list, rows: int = 0) -> list:
    """work of every item on df's session, in the order of items, as many at a time as FITS and
    ROWS_HELD allow where a fit takes up to so many rows."""
    if not items:
        return []
    with ThreadPool(min(FITS, max(1, ROWS_HELD // max(1, rows)), len(items))) as pool:
        return pool.map(inheritable_thread_target(df.sparkSession)(work), items, chunksize=1)


def _dealt(df: DataFrame, n: int) -> DataFrame:
    """n rows in tasks that are worth their start."""
    need, has = max(1, -(-n // ROWS_A_TASK)), df.rdd.getNumPartitions()
    if has > need:
        return df.coalesce(need)
    few = min(need, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(few) if has < few else df


def feature_columns(df: DataFrame, leave: Iterable[str] = OUTCOMES) -> list[str]:
    """Numeric columns of the schema, but for the named ones."""
    out = set(leave)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in out]


@dataclass
class Cleaning:
    """M7's state: what training rows decided, applied to any rows."""

    features: list[str]
    medians: dict[str, float]
    low: dict[str, float]
    high: dict[str, float]

    def apply(self, df: DataFrame) -> DataFrame:
        filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])) for c in self.features}
        return df.withColumns({c: F.least(F.greatest(x, F.lit(self.low[c])), F.lit(self.high[c])) for c, x in filled.items()})

    def matrix(self, columns: list[pa.Array]) -> np.ndarray:
        """``apply`` on doubles in a task: some forty such expressions make a method that the JVM only
        interprets. NaN counts as the largest value, as in SQL."""
        limits = ((self.medians[c], self.low[c], self.high[c]) for c in self.features)
        return np.column_stack([np.fmin(np.maximum(x.fill_null(m).to_numpy(zero_copy_only=False), a), b) for x, (m, a, b) in zip(columns, limits)])


def _products(df: DataFrame, features: list[str], target: str, shift: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """(count, sums and squares of the features over all rows; count, sums and products of
    features and target over rows that have one), all of filled and shifted values: one pass."""
    d = len(features)
    centre = np.array([shift[c] for c in features])

    def run(batches):
        spread, joint = np.zeros(1 + 2 * d), np.zeros((d + 2, d + 2))
        for batch in batches:
            x = np.stack([c.fill_null(float(m)).to_numpy(zero_copy_only=False) for c, m in zip(batch.columns, centre)], 1) - centre
            spread += np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])
            own = batch.column(d).is_valid().to_numpy(zero_copy_only=False)
            y = batch.column(d).fill_null(0.0).to_numpy(zero_copy_only=False)[own]
            z = np.column_stack([np.ones(len(y)), x[own], y])
            joint += z.T @ z
        yield pa.record_batch({"sums": pa.array([np.concatenate([spread, joint.ravel()]).tobytes()], pa.binary())})

    rows = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col(target).cast("double").alias("y"))
    total = sum((np.frombuffer(r.sums) for r in rows.mapInArrow(run, "sums binary").collect()), np.zeros(1 + 2 * d + (d + 2) ** 2))  # one row a task
    return total[: 1 + 2 * d], total[1 + 2 * d :].reshape(d + 2, d + 2)


def clean(train: DataFrame, features: list[str], target: str) -> Cleaning:
    """M7: columns that are null throughout go; medians fill the rest; columns that don't vary
    go, but live_ ones; of two that correlate over 0.95 the one nearer the target stays; what
    stays is cut at the 0.1 % and 99.9 % quantiles. Quantiles are exact ranks with bounded state
    (``ranks``); counts, variances and correlations take one pass."""
    if not features:
        return Cleaning([], {}, {}, {})
    double = {c: F.col(c).cast("double") for c in features}
    # The rank of a tail among values and filled gaps is one among values below the median, and
    # less the gaps one above it.
    at = lambda n, rows: [-(-n // 2), *[r for q in TAILS for r in (math.ceil(q * rows), math.ceil(q * rows) - rows + n)]]
    found = {c: v for c, v in ranks.exact(train, double, at).items() if v is not None}
    medians = {c: v[0] for c, v in found.items()}
    kept = list(medians)
    if not kept:
        return Cleaning([], {}, {}, {})
    spread, joint = _products(train, kept, target, medians)
    n, d = spread[0], len(kept)
    with np.errstate(invalid="ignore", divide="ignore"):
        variance = (spread[d + 1 :] - spread[1 : d + 1] ** 2 / n) / (n - 1) if n > 1 else np.zeros(d)
        varied = [c for c, v in zip(kept, variance) if v >= LEAST_VARIANCE]
        at = [1 + kept.index(c) for c in varied] + [d + 1]
        within = (joint - np.outer(joint[0], joint[0]) / joint[0, 0])[np.ix_(at, at)]
        r = np.abs(within / np.sqrt(np.outer(np.diag(within), np.diag(within))))
    gone: set[str] = set()
    for j, col in enumerate(varied):
        for i, other in enumerate(varied[:j]):
            if r[i, j] > MOST_CORRELATED and other not in gone and col not in gone:
                gone.add(other if r[j, -1] >= r[i, -1] else col)
    kept = [c for c in kept if c not in gone and (c in varied or c.startswith("live_"))]
    tails = {c: [low if low < m else high if high > m else m for low, high in ((found[c][1], found[c][2]), (found[c][3], found[c][4]))] for c, m in medians.items()}
    return Cleaning(kept, {c: medians[c] for c in kept}, {c: tails[c][0] for c in kept}, {c: tails[c][1] for c in kept})


def learners(n_features: int, seed: int = 42) -> dict[str, object]:
    """Base learners on (_x, _scaled, _label, _weight). Boosted trees are binary here, so
    they go one against the rest. ``boosting.FAMILIES`` has those that pyspark.ml lacks: they
    take the features themselves, missing ones too, and can be named wherever these can."""
    common = {"labelCol": "_label", "predictionCol": "_pick"}
    prob = {"probabilityCol": "_chances", "rawPredictionCol": "_raw"}
    return {
        "logistic": LogisticRegression(featuresCol="_scaled", weightCol="_weight", regParam=0.01, maxIter=20, **common, **prob),
        "tree": DecisionTreeClassifier(featuresCol="_x", weightCol="_weight", maxDepth=5, seed=seed, **common, **prob),
        "forest": RandomForestClassifier(featuresCol="_x", weightCol="_weight", numTrees=40, maxDepth=6, seed=seed, **common, **prob),
        "boosted": OneVsRest(featuresCol="_x", labelCol="_label", predictionCol="_pick", rawPredictionCol="_raw", classifier=GBTClassifier(predictionCol="_is", maxIter=10, maxDepth=3, seed=seed).setRawPredictionCol("_raw").setProbabilityCol("_one")),
        "network": MultilayerPerceptronClassifier(featuresCol="_scaled", layers=[n_features, 16, 3], maxIter=60, seed=seed, **common, **prob),
    }


def clipped(p: list) -> list:
    """Within LOW and HIGH, then to a sum of 1; null where a chance is."""
    cut = [F.when(x.isNotNull(), F.greatest(F.lit(LOW), F.least(F.lit(HIGH), x))) for x in p]
    return [x / sum(cut[1:], cut[0]) for x in cut]


def _prepared(df: DataFrame, label: str, weight: str | None) -> DataFrame:
    return df.withColumns({"_label": F.col(label).cast("double"), "_weight": F.col(weight) if weight else F.lit(1.0)})


def fit_learner(train: DataFrame, learner, features: list[str], label: str = "outcome", weight: str | None = None):
    """A fitted pipeline of a learner, by name or as an estimator on the same columns; a class
    number where training rows have just one class, -1 where there are none."""
    if isinstance(learner, str) and learner in boosting.FAMILIES:
        return boosting.fit(train, features, learner, label, weight)
    rows = _prepared(train.where(F.col(label).isNotNull()), label, weight)
    low, high, n = rows.agg(F.min("_label"), F.max("_label"), F.count("*")).first()
    if low is None or low == high or not features:
        return -1 if low is None or low != high else int(low)
    assembler = VectorAssembler(inputCols=features, outputCol="_x")
    vectors = assembler.transform(_dealt(rows.select(*features, "_label", "_weight"), n)).select("_x", "_label", "_weight")
    estimator = learners(len(features))[learner] if isinstance(learner, str) else learner
    stages = [assembler]
    if estimator.getFeaturesCol() == "_scaled":
        stages.append(StandardScaler(inputCol="_x", outputCol="_scaled", withMean=True).fit(vectors))
        vectors = stages[-1].transform(vectors).drop("_x")
    ready = vectors.persist()
    try:
        return PipelineModel([*stages, estimator.fit(ready)])
    finally:
        ready.unpersist()


def chances(model, df: DataFrame, keep: list[str], prefix: str = "p_") -> DataFrame:
    """keep and the clipped chances of a fitted learner for every row of df."""
    if isinstance(model, int):
        p = [F.lit(1 / 3 if model < 0 else float(k == model)) for k in range(3)]
        return df.select(*keep, *[x.alias(f"{prefix}{s}") for x, s in zip(clipped(p), SIDES)])
    scored = model.transform(df if isinstance(model, boosting.Scorer) else _prepared(df, "match_id", None))
    if "_chances" in scored.columns:
        p = F.col("_chances") if isinstance(model, boosting.Scorer) else vector_to_array("_chances")
        one = [F.coalesce(F.get(p, F.lit(k)), F.lit(0.0)) for k in range(3)]
    else:  # one against the rest: margins, each to a chance
        p = vector_to_array("_raw")
        odds = [1 / (1 + F.exp(-2 * F.coalesce(F.get(p, F.lit(k)), F.lit(-3.0)))) for k in range(3)]
        one = [x / (odds[0] + odds[1] + odds[2]) for x in odds]
    return scored.select(*keep, *[x.alias(f"{prefix}{s}") for x, s in zip(clipped(one), SIDES)])


def _edges(df: DataFrame, folds: int) -> dict[int, int]:
    """The first place of each fold that has rows."""
    return {r.fold: r.edge for r in df.where(F.col("fold").between(0, folds - 1)).groupBy("fold").agg(F.min("place").alias("edge")).collect()}


def out_of_fold(df: DataFrame, names: list[str], features: list[str], folds: int = 5, weight: str | None = None, ask: bool = False, state: Cleaning | None = None) -> DataFrame:
    """match_id, fold, outcome and name_home, _draw, _away of every learner, each row
    scored by a fit on earlier rows alone. df carries ``fold`` (decisions.fold) and ``place``.
    Earlier folds' training rows are among later ones', so all folds are fitted side by side
    (``nested``). With ``ask`` the chances of the QUESTIONS follow, by boosted trees: those of a
    class against the rest are the same fits as the learner's. Features of df are cleaned by
    ``state``, if given, where they are read."""
    edges = _edges(df, folds)
    if not edges:
        return df.where("1 = 0").select("match_id", "fold", "outcome", *[F.lit(0.0).alias(f"{n}_{s}") for n in names for s in SIDES], *[F.lit(0.0).alias(q) for q in QUESTIONS if ask])
    order, how = sorted(edges, key=edges.get), {"matrix": state.matrix} if state else {}
    models = dict(zip(order, nested.fit(df, [*names, *(["boosted"] if ask and "boosted" not in names else [])], features, [edges[k] for k in order], weight=weight, **how)))
    scored = nested.forecasts(df, ["match_id", "fold", "outcome"], features, models, names, SIDES, QUESTIONS if ask else None, **how)
    p = [x.alias(f"{n}_{s}") for n in names for x, s in zip(clipped([F.col(f"{n}_{s}") for s in SIDES]), SIDES)]
    return scored.select("match_id", "fold", "outcome", *p, *(QUESTIONS if ask else []))


def _rps(name: str):
    hit = lambda k: (F.col("outcome") <= k).cast("double")
    return (F.pow(F.col(f"{name}_home") - hit(0), 2) + F.pow(F.col(f"{name}_home") + F.col(f"{name}_draw") - hit(1), 2)) / 2


def voting_weights(oof: DataFrame, names: list[str], gate: float = 1.5) -> dict[str, float]:
    """Weights by the inverse fourth power of each learner's ranked score; learners worse
    than ``gate`` times the best have none."""
    row = oof.agg(*[F.avg(_rps(n)).alias(n) for n in names]).first()
    scores = {n: row[n] for n in names if row[n] is not None}
    if not scores:
        return {n: 1 / len(names) for n in names}
    least = max(min(scores.values()), 1e-9)
    raw = {n: max(scores[n], 1e-9) ** -4 if n in scores and scores[n] <= gate * least else 0.0 for n in names}
    return {n: w / sum(raw.values()) for n, w in raw.items()}


def voted(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """df with the weighted average of the learners as p_home, p_draw, p_away."""
    p = [sum((F.lit(w) * F.col(f"{n}_{s}") for n, w in weights.items()), F.lit(0.0)) for s in SIDES]
    return df.withColumns(dict(zip(P, clipped(p))))


def stacked(oof: DataFrame, names: list[str], held: str = "fold >= 3", keep: tuple[str, ...] = ("match_id", "fold", "outcome")) -> DataFrame:
    """A multinomial meta-learner over the learners' chances, fitted on the other folds."""
    x = [f"{n}_{s}" for n in names for s in SIDES]
    return chances(nested.fit(oof.where(f"not ({held})"), ["logistic"], x)[0]["logistic"], oof.where(held), list(keep))


#: Yes-or-no questions about the outcome, a class and whether it is the one asked for;
#: their chances join the learners' in stacking.
QUESTIONS = {"is_home": (0, True), "is_away": (2, True), "is_draw": (1, True), "not_away": (2, False)}
#: Meta-learners over the learners' chances, and those over chances and answers.
META, AUGMENTED = ("logistic", "network", "boosted", "forest"), ("logistic", "boosted")


def yes(model, df: DataFrame, name: str) -> DataFrame:
    """df with the chance of label 1 by a two-class fit; half where nothing was trained on."""
    if isinstance(model, int):
        return df.withColumn(name, F.lit(0.5 if model < 0 else float(model)))
    return model.transform(_prepared(df, "match_id", None)).select(*df.columns, F.get(vector_to_array("_chances"), F.lit(1)).alias(name))


def answered(df: DataFrame, features: list[str], folds: int = 5, weight: str | None = None) -> DataFrame:
    """match_id and the chance of each question, by boosted trees on earlier rows alone.
    df carries ``fold`` and ``place``."""
    return out_of_fold(df, [], features, folds, weight, ask=True).select("match_id", *QUESTIONS)


def meta_stacked(oof: DataFrame, names: list[str], fit_on: str = "fold < 2", weigh_on: str = "fold = 2", held: str = "fold >= 3") -> DataFrame:
    """oof's weigh_on and held rows with p_home, p_draw, p_away: the average of the META
    learners by the inverse fourth power of their ranked score on weigh_on, or that of the
    AUGMENTED ones, which also see the questions of ``answered``, where its score there is
    lower. oof carries the chances of ``out_of_fold`` and the answers; no held row is fitted or
    weighed on."""
    plain = [f"{n}_{s}" for n in names for s in SIDES]
    fits = [(m, plain, f"meta_{m}") for m in META] + [(m, [*plain, *QUESTIONS], f"more_{m}") for m in AUGMENTED]
    early = oof.where(fit_on)
    by = {kind: nested.fit(early, list(learners), x)[0] for kind, learners, x in (("meta", META, plain), ("more", AUGMENTED, [*plain, *QUESTIONS]))}
    scored, ends = oof.where(f"({weigh_on}) or ({held})"), oof.columns
    for m, _, name in fits:
        scored = chances(by[name[:4]][m], scored, scored.columns, f"{name}_")
    weighed = scored.where(weigh_on).persist()
    sets = [[name for _, _, name in fits if name.startswith(kind)] for kind in ("meta_", "more_")]
    mixes = [voting_weights(weighed, names_, gate=float("inf")) for names_ in sets]
    worth = [voted(weighed, mix).agg(F.avg(_rps("p"))).first()[0] for mix in mixes]
    weighed.unpersist()
    better = worth[0] is not None and worth[1] < worth[0]
    return voted(scored, mixes[1] if better else mixes[0]).select(*ends, *P)


def calibrated(fit_on: DataFrame, df: DataFrame) -> DataFrame:
    """An isotonic curve for each class from fit_on, applied to df and renormalised. df
    comes back as it is where accuracy on fit_on falls or its ranked score passes 1.05 times."""

    def put(rows: DataFrame, curves: list) -> DataFrame:
        for p, curve in zip(P, curves):
            rows = curve.transform(rows.withColumn("_f", F.col(p))).drop("_f").withColumnRenamed("prediction", f"_{p}")
        new = clipped([F.col(f"_{p}") for p in P])
        return rows.withColumns({f"_{p}": x for p, x in zip(P, new)})

    if fit_on.where("outcome is not null").isEmpty():
        return df
    curves = []
    for k, p in enumerate(P):
        rows = fit_on.where("outcome is not null").select(F.col(p).alias("_f"), (F.col("outcome") == k).cast("double").alias("_label"))
        curves.append(IsotonicRegression(featuresCol="_f", labelCol="_label").fit(rows))
    pick = lambda q: F.when((q[0] >= q[1]) & (q[0] >= q[2]), 0).when(q[1] >= q[2], 1).otherwise(2)
    score = lambda q: (F.pow(q[0] - (F.col("outcome") <= 0).cast("int"), 2) + F.pow(q[0] + q[1] - (F.col("outcome") <= 1).cast("int"), 2)) / 2
    old, new = [F.col(p) for p in P], [F.col(f"_{p}") for p in P]
    r = put(fit_on, curves).agg(*[f.alias(n) for n, f in (("a0", F.avg((pick(old) == F.col("outcome")).cast("double"))), ("a1", F.avg((pick(new) == F.col("outcome")).cast("double"))), ("r0", F.avg(score(old))), ("r1", F.avg(score(new))))]).first()
    if r.a1 < r.a0 or r.r1 > 1.05 * r.r0:
        return df
    return put(df, curves).withColumns({p: F.col(f"_{p}") for p in P}).drop(*[f"_{p}" for p in P])


def adversarial_weights(train: DataFrame, test: DataFrame, features: list[str]) -> DataFrame:
    """match_id and weight of every training row: the odds p / (1 - p) of belonging to
    test, within 0.5 and 5, when the two sets can be told apart (accuracy over 0.65); else 1."""
    both = train.select("match_id", *features, F.lit(0).alias("outcome")).unionByName(test.select("match_id", *features, F.lit(1).alias("outcome")))
    model = fit_learner(both, "logistic", features)
    if isinstance(model, int):
        return train.select("match_id", F.lit(1.0).alias("weight"))
    scored = model.transform(_prepared(both, "outcome", None)).select("match_id", "_label", F.get(vector_to_array("_chances"), F.lit(1)).alias("p"))
    accuracy = scored.agg(F.avg(((F.col("p") > 0.5).cast("double") == F.col("_label")).cast("double"))).first()[0]
    odds = F.greatest(F.lit(0.5), F.least(F.lit(5.0), F.col("p") / (1 - F.least(F.col("p"), F.lit(1 - 1e-9))))) if accuracy > 0.65 else F.lit(1.0)
    return scored.where("_label = 0").select("match_id", odds.alias("weight"))


def important(train: DataFrame, features: list[str], drop: float = 0.05) -> list[str]:
    """The features but for the least important share, by a forest."""
    model = fit_learner(train, "forest", features)
    if isinstance(model, int):
        return features
    worth = model.stages[-1].featureImportances.toArray()
    order = sorted(range(len(features)), key=lambda i: (worth[i], features[i]))
    gone = set(order[: int(len(features) * drop)])
    return [c for i, c in enumerate(features) if i not in gone]


def goal_forecast(train: DataFrame, test: DataFrame, features: list[str]) -> DataFrame:
    """match_id, ml_xg_home and ml_xg_away from boosted trees, in [0.2, 5] and [0.1, 5]."""
    out = VectorAssembler(inputCols=features, outputCol="_x").transform(test).select("match_id", "_x")
    for side, least in (("home", 0.2), ("away", 0.1)):
        rows = VectorAssembler(inputCols=features, outputCol="_x").transform(train.where(f"goals_{side} is not null"))
        model = GBTRegressor(featuresCol="_x", labelCol=f"goals_{side}", predictionCol="_y", maxIter=10, maxDepth=3, seed=42).fit(rows)
        out = model.transform(out).withColumn(f"ml_xg_{side}", F.greatest(F.lit(least), F.least(F.lit(5.0), F.col("_y")))).drop("_y")
    return out.drop("_x")


def walk_forward(df: DataFrame, features: list[str], target: str = "outcome", by: str = "season", steps: int | None = 5, learner: str = "logistic", least: int = 100) -> DataFrame:
    """Forecasts of the last ``steps`` values of ``by`` (seasons, or blocks of gameweeks; all
    without steps), each by a fit on all rows of earlier values, cleaned by those rows. A value with fewer
    than ``least`` rows before it is left out."""
    values = [r[0] for r in df.select(by).where(F.col(by).isNotNull()).distinct().orderBy(F.desc(by)).collect()][:steps]

    def forecast(v):
        before = df.where(F.col(by) < v)
        if before.count() < least:
            return None
        state = clean(before, features, target)
        model = fit_learner(state.apply(before), learner, state.features, target)
        return chances(model, state.apply(df.where(F.col(by) == v)), ["match_id", by, target])

    out = [found for found in at_once(df, forecast, sorted(values), df.count()) if found is not None]
    return reduce(DataFrame.unionByName, out) if out else df.where("1 = 0").select("match_id", by, target, *[F.lit(0.0).alias(p) for p in P])


def hierarchical(train: DataFrame, test: DataFrame, features: list[str]) -> DataFrame:
    """First draw or not, then the winner among decided matches; chances are products."""
    drawn = fit_learner(train.withColumn("_d", F.when(F.col("outcome").isNotNull(), (F.col("outcome") == 1).cast("int"))), "logistic", features, "_d")
    home = fit_learner(train.where("outcome <> 1").withColumn("_h", (F.col("outcome") == 0).cast("int")), "logistic", features, "_h")
    both = yes(home, yes(drawn, test, "_d"), "_h")
    d, h = F.col("_d"), F.col("_h")
    return both.select("match_id", *[x.alias(p) for p, x in zip(P, clipped([(1 - d) * h, d, (1 - d) * (1 - h)]))])


def latest_block(df: DataFrame, week: str = "gameweek", weeks: int = 3) -> DataFrame:
    """M18's second form: the current season in blocks of gameweeks, as ``block``; all earlier
    seasons are block -1."""
    last = F.broadcast(df.agg(F.max("season").alias("_last")))
    return df.crossJoin(last).withColumn("block", F.when(F.col("season") < F.col("_last"), -1).otherwise(F.floor((F.col(week) - 1) / weeks)).cast("int")).drop("_last")
