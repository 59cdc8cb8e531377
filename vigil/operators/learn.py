"""Violent-incident classifiers and count regression with Spark ML.

Feature preparation is a Pipeline (indexers, one-hot encoders, assembler,
scaler) fitted once over all the rows a model will see, so every stage of a
warm-started transfer run shares the same feature width. All fitting is
distributed (tree/gradient aggregation over partitions).
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil import fixed_values as FV
from vigil.functions import temporal as T
from vigil.operators.sequence import rank_within
from vigil.sources.files import path_exists

NUMERIC = ["hour", "day_of_week", "month", "latitude", "longitude"]
CATEGORICAL = ["location_name", "source"]


def violent_label(df: DataFrame, category: str = "category") -> DataFrame:
    """``is_violent`` = category is one of the violent categories (0/1)."""
    return df.withColumn("is_violent", F.col(category).isin(FV.VIOLENT_CATEGORIES).cast("int"))


def feature_frame(df: DataFrame, id_col: str = "incident_id", ts: str = "date") -> DataFrame:
    """Date parts, numeric nulls → 0, text columns dropped, label added.
    ``category`` is the label source and is kept out of the features."""
    cats = [c for c in CATEGORICAL if c in df.columns]
    out = violent_label(df).select(
        id_col, T.hour_of(ts).alias("hour"), T.weekday_index(ts).alias("day_of_week"),
        T.month_of(ts).alias("month"), "latitude", "longitude", *cats, "is_violent")
    return out.na.fill(0, subset=NUMERIC)


def hash_split(df: DataFrame, id_col: str = "incident_id", train_pct: int = 80,
               seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Reproducible split independent of partitioning (unlike randomSplit): the
    first 32 bits of the md5 of ``seed:id``, modulo 100; rows without an id train."""
    digits = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"))
    b = F.coalesce(F.conv(F.substring(digits, 1, 8), 16, 10).cast("long") % 100, F.lit(0))
    return df.filter(b < train_pct), df.filter(b >= train_pct)


def one_hot(df: DataFrame, col: str, *, id_col: str = "incident_id") -> DataFrame:
    """All levels kept (``dropLast=False``): one 0/1 column per level named
    ``<col>_<level>``. Levels come from the fitted indexer (a distributed
    distinct count; the vocabulary is the only thing held by the driver)."""
    idx = StringIndexer(inputCol=col, outputCol="_idx", handleInvalid="keep",
                        stringOrderType="alphabetAsc").fit(df)
    enc = OneHotEncoder(inputCols=["_idx"], outputCols=["_vec"], dropLast=False).fit(idx.transform(df))
    arr = vector_to_array(F.col("_vec"))
    out = enc.transform(idx.transform(df)).withColumn("_arr", arr)
    return out.select(id_col, *[F.col("_arr")[i].cast("int").alias(f"{col}_{lvl}")
                                for i, lvl in enumerate(idx.labels)])


def one_hot_levels(df: DataFrame, cols: list[str]) -> DataFrame:
    """``column, level, n, level_id``: the levels of the columns, numbered from 0
    in alphabetical order by distributed ranks (a vocabulary of any size)."""
    levels = None
    for c in cols:
        part = df.filter(F.col(c).isNotNull()).groupBy(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")).agg(F.count("*").alias("n"))
        levels = part if levels is None else levels.unionByName(part)
    return rank_within(levels, "column", ["level"], out="level_id").withColumn("level_id", F.col("level_id") - 1)


def one_hot_long(df: DataFrame, cols: list[str], *, id_col: str = "incident_id") -> DataFrame:
    """Sparse one-hot rows ``id, column, level_id``: a 1 for each id and column
    that has a level; no column per level, nothing held by the driver."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in cols])
    rows = df.select(id_col, F.explode(entries).alias("e")).select(id_col, "e.column", "e.level").filter(F.col("level").isNotNull())
    return rows.join(one_hot_levels(df, cols).drop("n"), ["column", "level"]).select(id_col, "column", "level_id")


def standard_scaled(df: DataFrame, cols: list[str], *, id_col: str = "incident_id") -> DataFrame:
    """``(x - mean) / population sd``; zero variance → 0. Means and sds are
    one aggregate row read as a scalar subquery."""
    stats = df.agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in cols],
                            *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])).scalar()
    out = []
    for c in cols:
        m, s = stats.getField(f"m_{c}"), stats.getField(f"s_{c}")
        out.append(F.when(s > 0, (F.col(c) - m) / s).otherwise(F.lit(0.0)).alias(c))
    return df.select(id_col, *out)


def feature_pipeline(cats: list[str], numeric: list[str] = NUMERIC) -> list:
    stages, vecs = [], []
    for c in cats:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep"),
                   OneHotEncoder(inputCols=[f"{c}_idx"], outputCols=[f"{c}_vec"], dropLast=False)]
        vecs.append(f"{c}_vec")
    stages += [VectorAssembler(inputCols=numeric + vecs, outputCol="raw", handleInvalid="keep"),
               StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)]
    return stages


def _estimator(kind: str, n_features: int | None = None, *, weight_col: str | None = None,
               max_iter: int = 100, seed: int = 42, initial_weights=None):
    if kind == "rf":
        est = RandomForestClassifier(labelCol="is_violent", featuresCol="features", numTrees=100, seed=seed)
    elif kind == "logreg":
        est = LogisticRegression(labelCol="is_violent", featuresCol="features", maxIter=max_iter)
    elif kind == "mlp":
        est = MultilayerPerceptronClassifier(labelCol="is_violent", featuresCol="features",
                                             layers=[n_features, 64, 32, 16, 2], maxIter=max_iter,
                                             seed=seed, blockSize=128)
        if initial_weights is not None:
            est.setInitialWeights(initial_weights)
        return est
    else:
        raise ValueError(kind)
    if weight_col:
        est.setWeightCol(weight_col)
    return est


def fit_features(df: DataFrame) -> PipelineModel:
    cats = [c for c in CATEGORICAL if c in df.columns]
    return Pipeline(stages=feature_pipeline(cats)).fit(df)


def n_features(feat_model: PipelineModel, sample: DataFrame) -> int:
    return len(feat_model.transform(sample.limit(1)).select("features").first()[0])


def train_violent(df: DataFrame, kind: str = "rf", *, weight_col: str | None = None,
                  max_iter: int = 100) -> PipelineModel:
    """Feature pipeline + classifier fitted on ``df`` (feature frame)."""
    feats = fit_features(df)
    width = n_features(feats, df) if kind == "mlp" else None
    est = _estimator(kind, width, weight_col=weight_col, max_iter=max_iter)
    return PipelineModel(stages=[*feats.stages, est.fit(feats.transform(df))])


def accuracy(predictions: DataFrame) -> float:
    return MulticlassClassificationEvaluator(labelCol="is_violent", predictionCol="prediction",
                                             metricName="accuracy").evaluate(predictions)


def transfer_train(own: DataFrame, external: list[DataFrame], *, base_iter: int = 50,
                   tune_iter: int = 20, seed: int = 42):
    """Base MLP on ``own`` train → fine-tune on each external dataset in turn
    (warm start from the previous weights) → re-tune on ``own`` → evaluate on
    ``own`` test. The feature pipeline is fitted on the union of all data so
    that every stage has the same input width.

    Returns ``(feature_model, mlp_model, stages)`` where ``stages`` lists
    ``(stage, rows, test_accuracy)``.
    """
    train, test = hash_split(own, seed=seed)
    everything = own
    for ext in external:
        everything = everything.unionByName(ext)
    feats = fit_features(everything)
    width = n_features(feats, own)
    ft = lambda d: feats.transform(d)
    stages = []
    model = _estimator("mlp", width, max_iter=base_iter, seed=seed).fit(ft(train))
    stages.append(("base", accuracy(model.transform(ft(test)))))
    for i, ext in enumerate(external):
        model = _estimator("mlp", width, max_iter=tune_iter, seed=seed,
                           initial_weights=model.weights).fit(ft(ext))
        stages.append((f"fine_tune_{i + 1}", accuracy(model.transform(ft(test)))))
    model = _estimator("mlp", width, max_iter=tune_iter, seed=seed,
                       initial_weights=model.weights).fit(ft(train))
    stages.append(("retune_own", accuracy(model.transform(ft(test)))))
    return feats, model, stages


def count_ridge(counts: DataFrame, *, reg: float = 1.0) -> tuple[PipelineModel, float]:
    """Ridge regression of daily counts on weekday and place; returns the
    fitted pipeline and the hold-out RMSE."""
    train, test = hash_split(counts, id_col="row_key")
    pipe = Pipeline(stages=[
        StringIndexer(inputCol="location_name", outputCol="loc_idx", handleInvalid="keep"),
        OneHotEncoder(inputCols=["loc_idx"], outputCols=["loc_vec"], dropLast=False),
        VectorAssembler(inputCols=["day_of_week", "loc_vec"], outputCol="features"),
        LinearRegression(featuresCol="features", labelCol="n", regParam=reg, elasticNetParam=0.0)])
    model = pipe.fit(train)
    rmse = RegressionEvaluator(labelCol="n", predictionCol="prediction",
                               metricName="rmse").evaluate(model.transform(test))
    return model, rmse


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_models(models: dict[str, PipelineModel], path: str) -> None:
    """Named models under one folder; a model saved before is replaced, the
    others stay."""
    for name, model in models.items():
        save_model(model, f"{path.rstrip('/')}/{name}")


def load_models(spark: SparkSession, path: str, names: list[str]) -> dict[str, PipelineModel]:
    """Those of the named models that exist (with metadata written whole); an
    empty dict, hence false, when there is none."""
    base = path.rstrip("/")
    return {n: load_model(f"{base}/{n}") for n in names if path_exists(spark, f"{base}/{n}/metadata/_SUCCESS")}
