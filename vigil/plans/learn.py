"""Registered feature and model queries.

Transforms with an exact SQL form carry an oracle; fitted models (MLP,
random forest, logistic, ridge, transfer) are checked by row count only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.numeric import round6
from vigil.operators import learn as M
from vigil.operators import regions as R
from vigil.plans.registry import query
from vigil.plans.regions import _incident_regions
from vigil.plans.sql_bindings import INCIDENTS
from vigil.sources import bindings as B

_W = f"with inc as ({INCIDENTS})"
_LEVELS = ["assault", "murder", "robbery", "shooting", "theft"]   # categories of the binding


def _inc(spark, sf):
    return B.incidents(spark, sf)


@query("violent_label", f"""{_W} select incident_id, case when category in ('murder', 'assault', 'shooting')
then 1 else 0 end as is_violent from inc""")
def q_violent_label(spark, sf):
    return M.violent_label(_inc(spark, sf)).select("incident_id", "is_violent")


@query("one_hot_category", f"{_W} select incident_id, " + ", ".join(
    f"case when category = '{c}' then 1 else 0 end as category_{c}" for c in _LEVELS) + " from inc")
def q_one_hot(spark, sf):
    return M.one_hot(_inc(spark, sf), "category")


_LONG = ("category", "location_name", "source")


@query("one_hot_long", f"""{_W}, l as (select incident_id, 'category' as "column", category as level from inc
union all select incident_id, 'location_name', location_name from inc union all select incident_id, 'source', source from inc),
k as (select "column", level, row_number() over (partition by "column" order by level) - 1 as level_id
      from (select distinct "column", level from l where level is not null) z)
select l.incident_id, l."column", k.level_id from l join k on k."column" = l."column" and k.level = l.level""")
def q_one_hot_long(spark, sf):
    return M.one_hot_long(_inc(spark, sf), list(_LONG))


_SCALE_COLS = ["hour", "day_of_week", "month", "latitude", "longitude"]
_SCALE_SQL = f"""{_W}, f as (select incident_id, cast(hour(date) as double) as hour, cast(isodow(date) - 1 as double) as day_of_week,
cast(month(date) as double) as month, latitude, longitude from inc),
st as (select {', '.join(f'avg({c}) as m_{c}, stddev_pop({c}) as s_{c}' for c in _SCALE_COLS)} from f)
select incident_id, {', '.join(f'round(case when s_{c} > 0 then ({c} - m_{c})/s_{c} else 0e0 end, 6) as {c}' for c in _SCALE_COLS)}
from f cross join st"""


@query("scaled_features", _SCALE_SQL)
def q_scaled(spark, sf):
    f = M.feature_frame(_inc(spark, sf)).select("incident_id", *[F.col(c).cast("double") for c in _SCALE_COLS])
    s = M.standard_scaled(f, _SCALE_COLS)
    return s.select("incident_id", *[round6(c).alias(c) for c in _SCALE_COLS])


@query("train_test_split", f"""{_W} select incident_id,
case when cast('0x' || substr(md5('42:' || cast(incident_id as varchar)), 1, 8) as bigint) % 100 < 80
     then 'train' else 'test' end as part from inc""")
def q_split(spark, sf):
    train, test = M.hash_split(M.feature_frame(_inc(spark, sf)))
    return (train.select("incident_id", F.lit("train").alias("part"))
            .unionByName(test.select("incident_id", F.lit("test").alias("part"))))


@query("training_features")
def q_training_features(spark, sf):
    f = M.feature_frame(_inc(spark, sf))
    model = M.fit_features(f)
    return model.transform(f).select("incident_id", "features", "is_violent")


def _classifier(spark, sf, kind, **kw):
    f = M.feature_frame(_inc(spark, sf))
    train, test = M.hash_split(f)
    model = M.train_violent(train, kind, **kw)
    return model.transform(test).select("incident_id", "is_violent",
                                        F.col("prediction").cast("int").alias("prediction"))


@query("violent_rf")
def q_rf(spark, sf):
    return _classifier(spark, sf, "rf")


@query("violent_logreg")
def q_logreg(spark, sf):
    return _classifier(spark, sf, "logreg")


@query("violent_mlp")
def q_mlp(spark, sf):
    return _classifier(spark, sf, "mlp", max_iter=50)


@query("model_accuracy")
def q_model_accuracy(spark, sf):
    preds = _classifier(spark, sf, "logreg")
    return preds.agg(F.avg((F.col("prediction") == F.col("is_violent")).cast("double")).alias("accuracy"),
                     F.count("*").alias("test_rows"))


@query("transfer_model")
def q_transfer(spark, sf):
    rows = M.feature_frame(_incident_regions(spark, sf))
    regions = _incident_regions(spark, sf).select("incident_id", "region")
    rows = rows.join(regions, "incident_id")
    edges = R.region_edges(R.region_docs(B.region_similarity_edges(spark, sf)))
    target = "EUROPE"
    similar = [r[0] for r in edges.filter(F.col("region") == target)
               .orderBy(F.desc("weight"), "similar_region").select("similar_region").collect()]
    own = rows.filter(F.col("region") == target).drop("region")
    ext = [rows.filter(F.col("region") == s).drop("region") for s in similar]
    _, _, stages = M.transfer_train(own, ext, base_iter=30, tune_iter=10)
    return spark.createDataFrame(stages, "stage string, test_accuracy double")


@query("count_ridge")
def q_ridge(spark, sf):
    from vigil.operators import regions as RG
    counts = RG.daily_counts(_inc(spark, sf), keys=("location_name",)) \
        .withColumn("day_of_week", F.weekday("day").cast("double")) \
        .withColumn("row_key", F.xxhash64("location_name", "day")) \
        .withColumn("n", F.col("n").cast("double"))
    _, rmse = M.count_ridge(counts)
    return spark.createDataFrame([(float(rmse),)], "rmse double")


@query("violent_logreg_weighted")
def q_logreg_weighted(spark, sf):
    """Transfer by weighted union: the target region's rows (weight 1) plus
    every similar region's rows weighted by similarity, one logistic fit
    with ``weightCol``; evaluated on the target region's hold-out rows."""
    target = "EUROPE"
    rows = M.feature_frame(_incident_regions(spark, sf))
    ts = R.region_training_set(_incident_regions(spark, sf), B.region_similarity_edges(spark, sf))
    weighted = rows.join(ts.filter(F.col("target_region") == target).select("incident_id", "weight"),
                         "incident_id")
    train, test = M.hash_split(weighted)
    model = M.train_violent(train, "logreg", weight_col="weight")
    own_test = test.filter(F.col("weight") == 1.0)
    return model.transform(own_test).select("incident_id", "is_violent",
                                            F.col("prediction").cast("int").alias("prediction"))
