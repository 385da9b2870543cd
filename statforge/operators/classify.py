"""Screen classification: a multinomial logistic model over numeric features of frames."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fitted(frames: DataFrame, label: str, features: list[str], penalty: float = 0.001) -> PipelineModel:
    """A model of ``label`` from the frames that have one; features must not be null."""
    return Pipeline(
        stages=[
            StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="keep"),
            VectorAssembler(inputCols=features, outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="_x", withMean=True),
            LogisticRegression(featuresCol="_x", labelCol="_y", family="multinomial", regParam=penalty, maxIter=50),
        ]
    ).fit(frames.filter(F.col(label).isNotNull()).dropna(subset=features))


def classified(model: PipelineModel, frames: DataFrame, key: str, label: str) -> DataFrame:
    """key, screen (the likeliest label) and its probability for each frame."""
    names = model.stages[0].labels
    scored = model.transform(frames).withColumn("_p", F.slice(vector_to_array("probability"), 1, len(names)))
    best = F.array_max("_p")
    screen = F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position("_p", best).cast("int"))
    return scored.select(key, screen.alias("screen"), best.alias("probability"))
