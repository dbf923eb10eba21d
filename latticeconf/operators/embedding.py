"""Embeddings: halves, pooling, PCA and stratification by k-means."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K, PRE_PCA, SEED = 15, 80, 42


def halves(df: DataFrame, emb: str, size: int) -> DataFrame:
    """Adds emb_global and emb_local: the first and second half."""
    return df.withColumns({"emb_global": F.slice(emb, 1, size // 2), "emb_local": F.slice(emb, size // 2 + 1, size - size // 2)})


def pooled_vectors(df: DataFrame, emb: str, scale: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, grid_row, grid_col, emb): mean vector by window, as partial sums of whole vectors on the map side."""
    at = df.select(*keys, F.floor(F.col("grid_row") / scale).cast("long").alias("grid_row"), F.floor(F.col("grid_col") / scale).cast("long").alias("grid_col"), array_to_vector(F.col(emb).cast("array<double>")).alias("v"))
    return at.groupBy(*keys, "grid_row", "grid_col").agg(Summarizer.mean(F.col("v")).alias("v")).select(*keys, "grid_row", "grid_col", vector_to_array("v").alias("emb"))


def pool_mean(df: DataFrame, emb: str, scale: int, keys: Sequence[str] = ()) -> DataFrame:
    """As pooled_vectors, a row for each component: (keys, grid_row, grid_col, place, value)."""
    return pooled_vectors(df, emb, scale, keys).select(*keys, "grid_row", "grid_col", F.posexplode("emb").alias("place", "value"))


def stored(spark: SparkSession, path: str, fit: Callable[[], PipelineModel]) -> PipelineModel:
    """The model at path; where there is none, fit() makes it and it is put there."""
    try:
        return PipelineModel.load(path)
    except Exception as e:
        if not re.search("does not exist|PATH_NOT_FOUND|FileNotFound", str(e)):
            raise
    model = fit()
    model.write().save(path)
    return model


def reduce_slides(slides: DataFrame, rois: DataFrame, emb: str, size: int, k: int, path: str, scales: Sequence[int] = (1,)) -> DataFrame:
    """(kind, scale, ..) with reduced: one model of all slides' vectors, made once, applied to slides and ROIs at every scale.

    slides and rois have slide_id, grid_row, grid_col and emb; of rois, roi_idx as well.
    """
    as_vectors = lambda df: halves(df, emb, size).withColumns({c: array_to_vector(F.col(c).cast("array<double>")) for c in ("emb_global", "emb_local")})
    model = stored(slides.sparkSession, path, lambda: pca_pipeline(["emb_global", "emb_local"], k).fit(as_vectors(slides)))
    out = None
    for kind, df, keys in (("slide", slides, ["slide_id"]), ("roi", rois, ["slide_id", "roi_idx"])):
        for scale in scales:
            pooled = pooled_vectors(df, emb, scale, keys)
            one = model.transform(as_vectors(pooled.withColumnRenamed("emb", emb) if emb != "emb" else pooled))
            roi = F.col("roi_idx") if kind == "roi" else F.lit(None).cast("int")
            one = one.select(F.lit(kind).alias("kind"), F.lit(scale).alias("scale"), "slide_id", roi.alias("roi_idx"), "grid_row", "grid_col", vector_to_array("reduced").alias("reduced"))
            out = one if out is None else out.unionByName(one)
    return out


def pca_pipeline(columns: Sequence[str], k: int) -> Pipeline:
    """Centred PCA of each vector column to k components, put side by side as reduced."""
    stages = []
    for c in columns:  # PCA's transform doesn't centre by itself
        stages += [StandardScaler(inputCol=c, outputCol=f"{c}_centred", withMean=True, withStd=False), PCA(k=k, inputCol=f"{c}_centred", outputCol=f"{c}_pca")]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=[f"{c}_pca" for c in columns], outputCol="reduced")])


def reduce_halves(df: DataFrame, emb: str, size: int, k: int):
    """The fitted model and df with reduced, 2 k components."""
    both = halves(df, emb, size).withColumns({c: array_to_vector(F.col(c).cast("array<double>")) for c in ("emb_global", "emb_local")})
    model = pca_pipeline(["emb_global", "emb_local"], k).fit(both)
    return model, model.transform(both)


def stratify(df: DataFrame, features: str, size: int, k: int = K, seed: int = SEED):
    """k-means strata; features of more than PRE_PCA components are reduced first."""
    stages, at = [], features
    if size > PRE_PCA:
        stages, at = [StandardScaler(inputCol=features, outputCol="_centred", withMean=True, withStd=False), PCA(k=PRE_PCA, inputCol="_centred", outputCol="_pre")], "_pre"
    model = Pipeline(stages=[*stages, KMeans(k=k, seed=seed, featuresCol=at, predictionCol="cluster")]).fit(df)
    return model, model.transform(df)


def mixture(df: DataFrame, columns: Sequence[str], k: int = 3, seed: int = 45) -> DataFrame:
    """Labels of a Gaussian mixture over columns."""
    v = VectorAssembler(inputCols=list(columns), outputCol="_gmm", handleInvalid="skip").transform(df)
    return GaussianMixture(k=k, seed=seed, featuresCol="_gmm", predictionCol="label").fit(v).transform(v).drop("_gmm", "probability")


def mixture_likelihood(df: DataFrame, columns: Sequence[str], k: int = 3, seed: int = 45) -> float:
    """Log-likelihood of the rows under the mixture fitted on them; one component is the rows' own normal distribution."""
    if k == 1:
        row = df.agg(F.count(F.lit(1)), *(F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")) for a in columns for b in columns)).collect()[0]
        d = len(columns)
        return float(-row[0] / 2 * (d * np.log(2 * np.pi) + np.linalg.slogdet(np.array(row[1:], float).reshape(d, d))[1] + d))
    v = VectorAssembler(inputCols=list(columns), outputCol="_gmm", handleInvalid="skip").transform(df)
    return GaussianMixture(k=k, seed=seed, featuresCol="_gmm").fit(v).summary.logLikelihood


def component_facts(df: DataFrame, column: str) -> DataFrame:
    """(place, mean, variance) of a vector column: facts that don't depend on signs."""
    return df.select(F.posexplode(vector_to_array(column)).alias("place", "x")).groupBy("place").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("variance"))
