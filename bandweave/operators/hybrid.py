"""The hybrid regressor as one persisted pipeline: neighbours for small fields, a forest for large ones.

`training_rows` adds crops of the fields to their feature rows; `pipeline` puts four own stages together:

1. RobustArray: scales an array column by median and interquartile range of the small original fields;
2. VectorForest: one forest for all targets on all rows, crops included;
3. NeighborMean: stored neighbour indexes on the small original fields, one for each fold left out, and the crops of large
   ones; a prediction is the mean over the indexes;
4. ByEdge: picks by field size and brings predictions back to the targets' units.

Every stage saves and loads itself, so `PipelineModel.save` and `.load` carry the whole regressor between sessions. Rows move only
for quantiles, histograms and the neighbour search; model data on the driver are feature widths and forest nodes. A row without an
edge counts as large; a null feature array has no prediction. Columns named as the output (`model`, <target>_hat, _near, _forest) are
replaced, other columns stay.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.param import Param, Params
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandweave import SMALL_EDGE, TARGET_MAXIMA, TARGETS
from bandweave.functions import arrays as ar
from bandweave.operators import augment, features, forest, neighbor_index, neighbors
from bandweave.operators.folds import kfold
from bandweave.operators.pixels import field_size
from bandweave.operators.ranks import exact_quantiles, literal_array
from bandweave.operators.scaling import long_features
from bandweave.session import materialize


class _Writer(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.save_data(self.sparkSession, f"{path}/data")


class _Reader(DefaultParamsReader):
    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.cls()
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        stage.load_data(self.sparkSession, f"{path}/data")
        return stage


class _Stage(Params, MLReadable, MLWritable):
    """Settings as Params, fitted data in a folder beside them."""

    limit = Param(Params._dummy(), "limit", "largest edge of a small field")
    source = Param(Params._dummy(), "source", "array column with the features")
    defaults: dict = {}

    def __init__(self, **settings):
        super().__init__()
        self._setDefault(limit=float(SMALL_EDGE), **self.defaults)
        self._set(**settings)

    def of(self, name: str):
        return self.getOrDefault(name)

    def small(self) -> Column:
        return F.coalesce(F.col("edge") <= F.lit(self.of("limit")), F.lit(False))

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader(cls)

    def save_data(self, spark: SparkSession, path: str) -> None:
        """Nothing but settings."""

    def load_data(self, spark: SparkSession, path: str) -> None:
        """Nothing but settings."""


class _RobustSettings(_Stage):
    name = Param(Params._dummy(), "name", "column of the scaled array")
    defaults = {"source": "near_features", "name": "scaled"}


class RobustArray(_RobustSettings, Estimator):
    def _fit(self, dataset: DataFrame) -> RobustArrayModel:
        own = dataset.where(self.small() & ~F.col("crop"))
        q = exact_quantiles(long_features(own, self.of("source")), ["feature"], "v", [0.25, 0.5, 0.75])
        fitted = {r["feature"]: r["q"] for r in q.collect()}  # as many as the array is wide
        if not fitted:
            raise ValueError("no small original field to fit the scaler on")
        model = self._copyValues(RobustArrayModel())
        model.center = [fitted[i][1] for i in sorted(fitted)]
        model.scale = [(fitted[i][2] - fitted[i][0]) or 1.0 for i in sorted(fitted)]
        return model


class RobustArrayModel(_RobustSettings, Model):
    center: list[float]
    scale: list[float]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        moved = F.zip_with(self.of("source"), literal_array(self.center), lambda v, c: v - c)
        return dataset.withColumn(self.of("name"), F.zip_with(moved, literal_array(self.scale), lambda v, s: v / s))

    def save_data(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.center, self.scale)], "center array<double>, scale array<double>").write.parquet(path)

    def load_data(self, spark: SparkSession, path: str) -> None:
        self.center, self.scale = (list(x) for x in spark.read.parquet(path).first())


class _ForestSettings(_Stage):
    trees = Param(Params._dummy(), "trees", "trees of the forest")
    depth = Param(Params._dummy(), "depth", "levels below the root")
    seed = Param(Params._dummy(), "seed", "seed of the bootstrap")
    defaults = {"source": "forest_features", "trees": 1000, "depth": 10, "seed": 0}


class VectorForest(_ForestSettings, Estimator):
    def _fit(self, dataset: DataFrame) -> VectorForestModel:
        model = self._copyValues(VectorForestModel())
        rows = dataset.select("sample_index", *TARGETS, self.of("source"))
        model.forest = forest.fit(rows, TARGETS, self.of("trees"), self.of("depth"), seed=self.of("seed"), features=self.of("source"))
        return model


class VectorForestModel(_ForestSettings, Model):
    """Adds <target>_forest, null for small fields."""

    forest: forest.Forest

    def _transform(self, dataset: DataFrame) -> DataFrame:
        marked = dataset.drop(*[f"{c}_{kind}" for c in TARGETS for kind in ("hat", "forest")]).withColumn("_large", F.when(~self.small(), F.col(self.of("source"))))
        return forest.predict(self.forest, marked, "_large").withColumnsRenamed({f"{c}_hat": f"{c}_forest" for c in TARGETS}).drop("_large")

    def save_data(self, spark: SparkSession, path: str) -> None:
        self.forest.save(spark, path)

    def load_data(self, spark: SparkSession, path: str) -> None:
        self.forest = forest.load(spark, path)


class _NeighborSettings(_Stage):
    k = Param(Params._dummy(), "k", "neighbours")
    folds = Param(Params._dummy(), "folds", "indexes, each leaving out one fold of the small fields; 1 leaves out none")
    seed = Param(Params._dummy(), "seed", "seed of the folds")
    defaults = {"source": "scaled", "k": 170, "folds": 5, "seed": 0}


class NeighborMean(_NeighborSettings, Estimator):
    def _fit(self, dataset: DataFrame) -> NeighborMeanModel:
        folds, source = self.of("folds"), self.of("source")
        rows = dataset.where(self.small() != F.col("crop")).select("sample_index", "crop", source, *TARGETS)  # small originals, crops of large
        rows = materialize(rows, "neighbor-rows")
        dealt = kfold(rows.where("not crop"), folds, self.of("seed")).select("sample_index", "fold") if folds > 1 else None
        model = self._copyValues(NeighborMeanModel())
        model.labels = materialize(rows.select("sample_index", *TARGETS), "neighbor-labels")
        model.indexes = []
        for i in range(folds):
            kept = rows if dealt is None else rows.join(dealt.where(F.col("fold") == i), "sample_index", "left_anti")
            model.indexes.append(neighbor_index.build(kept, self.of("k"), vector=source))
        return model


class NeighborMeanModel(_NeighborSettings, Model):
    """Adds <target>_near, null for large fields."""

    labels: DataFrame
    indexes: list[neighbor_index.Index]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        source = self.of("source")
        asked = materialize(dataset.where(self.small() & F.col(source).isNotNull()).select("sample_index", source), "asked")
        parts = [neighbors.knn_regress(self.labels, asked, self.of("k"), vector=source, index=i) for i in self.indexes]
        mean = reduce(DataFrame.unionByName, parts).groupBy("sample_index").agg(*[F.avg(c).alias(f"{c}_near") for c in TARGETS])
        return dataset.drop(*[f"{c}_near" for c in TARGETS]).join(mean, "sample_index", "left")

    def save_data(self, spark: SparkSession, path: str) -> None:
        self.labels.write.parquet(f"{path}/labels")
        for i, index in enumerate(self.indexes):
            for part in ("blocks", "about"):
                spark.read.parquet(f"{index.path}/{part}").write.parquet(f"{path}/index-{i}/{part}")

    def load_data(self, spark: SparkSession, path: str) -> None:
        self.labels = spark.read.parquet(f"{path}/labels")
        self.indexes = [neighbor_index.load(spark, f"{path}/index-{i}") for i in range(self.of("folds"))]


class ByEdge(_Stage, Transformer):
    """Adds `model` and <target>_hat, times the targets' maxima, and drops what the stages before added."""

    maxima = Param(Params._dummy(), "maxima", "JSON object of each target's maximum")
    defaults = {"maxima": json.dumps(TARGET_MAXIMA)}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        maxima = json.loads(self.of("maxima"))
        picked = [(F.when(self.small(), F.col(f"{c}_near")).otherwise(F.col(f"{c}_forest")) * F.lit(float(maxima[c]))).alias(f"{c}_hat") for c in TARGETS]
        added = {f"{c}_{kind}" for c in TARGETS for kind in ("near", "forest", "hat")} | {"model"}
        return dataset.select(*[c for c in dataset.columns if c not in added], F.when(self.small(), "neighbors").otherwise("forest").alias("model"), *picked)


def pipeline(limit: float = SMALL_EDGE, k: int = 170, folds: int = 5, trees: int = 1000, depth: int = 10, seed: int = 0, maxima=TARGET_MAXIMA) -> Pipeline:
    """Fit on rows with sample_index, edge, crop, near_features, forest_features and scaled targets; the search comes last, so that
    fitting never asks the indexes."""
    steps = [
        RobustArray(limit=float(limit)),
        VectorForest(limit=float(limit), trees=trees, depth=depth, seed=seed),
        NeighborMean(limit=float(limit), k=k, folds=folds, seed=seed),
        ByEdge(limit=float(limit), maxima=json.dumps(dict(maxima))),
    ]
    return Pipeline(stages=steps)


def feature_rows(pixels: DataFrame) -> DataFrame:
    """sample_index, edge, crop (false), near_features and forest_features of each field."""
    blocks = features.features(pixels, "forest")
    arrays = [ar.concat_blocks(features.BLOCKS[layout]).alias(name) for layout, name in (("knn", "near_features"), ("forest", "forest_features"))]
    edges = field_size(pixels).select("sample_index", "edge")
    return blocks.select("sample_index", F.lit(False).alias("crop"), *[F.transform(a, lambda v: F.coalesce(v, F.lit(0.0))).alias(n) for a, n in zip(arrays, ("near_features", "forest_features"))]).join(edges, "sample_index")


def training_rows(pixels: DataFrame, targets: DataFrame, draws: int = 1, edge: int = SMALL_EDGE, tries: int = 10, jitter: float = 0.001, seed: int = 0) -> DataFrame:
    """Feature rows of all fields with their scaled targets, and `draws` crops of each with slightly moved targets.

    A crop's sample_index is -(sample_index * draws + draw) - 1, its `edge` that of its field: it decides which model learns it.
    """
    own = feature_rows(pixels).join(targets.select("sample_index", *TARGETS), "sample_index")
    if not draws:
        return own
    number = -(F.col("sample_index") * draws + F.col("draw")) - 1
    cropped = augment.crop_augment(pixels, edge, tries, draws, seed).withColumn("sample_index", number)
    of = F.floor((-F.col("sample_index") - 1) / draws).cast("bigint")
    cut = feature_rows(materialize(cropped, "crops")).drop("edge").withColumns({"crop": F.lit(True), "_of": of})
    labels = own.select(F.col("sample_index").alias("_of"), "edge", *TARGETS)
    cut = augment.jitter_targets(cut.join(labels, "_of"), "relative", jitter, seed + 1).drop("_of")
    return own.unionByName(cut)
