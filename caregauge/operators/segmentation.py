"""Patient segments by K-Means on standardised features."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import average_money, cents_sum, cents_to_double, rows
from ..session import layout, settled, stage
from .artefacts import kept
from .fixed import COMPLEX_CARE, FREQUENT, HIGH_VALUE, LOW_ENGAGEMENT

FEATURES = ("total_spend", "visits", "avg_los", "readmissions", "age")
PROFILE = ("total_spend", "visits", "avg_los")

# K-Means runs at a time.
SIDE_BY_SIDE = 5


@dataclass
class Segments:
    """Means and deviations that standardise the features, and centres in those units; all in feature order."""

    means: list[float]
    deviations: list[float]
    centres: list[list[float]]
    columns: tuple[str, ...] = FEATURES

    def table(self, spark: SparkSession) -> DataFrame:
        """A row per centre: segment, centre, and the scale of its units."""
        made = [(i, list(c), self.means, self.deviations, list(self.columns)) for i, c in enumerate(self.centres)]
        schema = "segment int, centre array<double>, means array<double>, deviations array<double>, columns array<string>"
        return spark.createDataFrame(made, schema)

    @classmethod
    def from_table(cls, table: DataFrame) -> Segments:
        """One row per segment reaches the driver."""
        found = table.orderBy("segment").collect()
        return cls(list(found[0].means), list(found[0].deviations), [list(r.centre) for r in found], tuple(found[0].columns))

    def standardised(self) -> list[Column]:
        """The features in units of their deviation; a feature without any is 0."""
        return [
            (F.col(c).cast("double") - F.lit(m)) / F.lit(d) if d else F.lit(0.0)
            for c, m, d in zip(self.columns, self.means, self.deviations, strict=True)
        ]

    def distances(self) -> Column:
        """Squared distances to the centres, as an array."""
        at = self.standardised()
        return F.array(
            *(sum(((a - F.lit(x)) * (a - F.lit(x)) for a, x in zip(at, c, strict=True)), F.lit(0.0)) for c in self.centres)
        )

    def assign(self, features: DataFrame) -> DataFrame:
        """Add `segment`, the nearest centre (of equals the first), and `distance`, its squared distance."""
        measured = features.withColumn("_distances", self.distances())
        least = F.array_min("_distances")
        return measured.select(
            *features.columns,
            (F.array_position("_distances", least) - 1).cast("int").alias("segment"),
            least.alias("distance"),
        )


def segments_of(features: DataFrame, segment: str, columns: Sequence[str] = FEATURES) -> Segments:
    """Centres of given segments: the means of their rows in standard units."""
    doubles = features.select(segment, *(F.col(c).cast("double").alias(c) for c in columns))
    scale = doubles.agg(*(F.avg(c) for c in columns), *(F.stddev_samp(c) for c in columns)).first()
    means, deviations = list(scale[: len(columns)]), list(scale[len(columns) :])
    made = Segments(means, deviations, [], tuple(columns))
    averages = [F.avg(a).alias(c) for a, c in zip(made.standardised(), columns, strict=True)]
    made.centres = [list(r[1:]) for r in doubles.groupBy(segment).agg(*averages).orderBy(segment).collect()]
    return made


def fit_segments(
    features: DataFrame,
    k: int = 4,
    restarts: int = 10,
    seed: int = 42,
    key: str = "patient_id",
    partitions: int | None = None,
) -> Segments:
    """Centres of the best of several K-Means runs.

    The first centres are drawn per partition, so the points are dealt by key into partitions whose number is
    `layout` of the rows unless given.
    """
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="_raw").transform(features)
    scaler = StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True).fit(assembled)
    scaled = scaler.transform(assembled).select(key, "features")
    parts = partitions or layout(features.count())
    # Kept for all runs; a lost block is read again from the staged table.
    points = settled(scaled, key, parts).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # Runs are many small jobs; side by side they fill the cores that one leaves idle.
        def run(i: int):
            return KMeans(k=k, seed=seed + i, predictionCol="segment").fit(points)

        points.count()
        with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
            runs = list(pool.map(inheritable_thread_target(points.sparkSession)(run), range(restarts)))
        best = min(runs, key=lambda model: model.summary.trainingCost)
    finally:
        points.unpersist()
    centres = [[float(x) for x in c] for c in best.clusterCenters()]
    return Segments([float(x) for x in scaler.mean], [float(x) for x in scaler.std], centres)


def segment_patients(
    features: DataFrame,
    k: int = 4,
    restarts: int = 10,
    seed: int = 42,
    key: str = "patient_id",
    partitions: int | None = None,
) -> DataFrame:
    """Add `segment`, the nearest of the fitted centres. The centres are fitted once for these rows and settings."""
    staged = stage(features)
    n = staged.count()
    settings = {"k": k, "restarts": restarts, "seed": seed, "key": key, "rows": n, "partitions": partitions or layout(n)}
    model = kept(
        staged.select(key, *FEATURES),
        "segments",
        settings,
        lambda: fit_segments(staged, k, restarts, seed, key, settings["partitions"]),
        lambda made, path: made.table(staged.sparkSession).write.mode("overwrite").parquet(path),
        lambda path: Segments.from_table(staged.sparkSession.read.parquet(path)),
    )
    return model.assign(staged).drop("distance")


def segment_labels(segments: DataFrame) -> DataFrame:
    """Add segment_label. When one cluster earns several names, the later rule below wins."""
    means = segments.groupBy("segment").agg(
        average_money("total_spend").alias("spend"),
        F.avg("visits").alias("visits"),
        F.avg("avg_los").alias("los"),
    )

    def highest(column: str):  # the lower segment number on ties
        return F.max_by("segment", F.struct(F.col(column), -F.col("segment")))

    winners = means.agg(
        F.struct(
            highest("spend").alias("spend"),
            highest("visits").alias("visits"),
            highest("los").alias("los"),
            F.min_by("segment", F.struct("spend", "segment")).alias("least"),
        )
    ).scalar()
    named = segments.withColumn("_winners", winners)
    label = (
        F.when(F.col("segment") == F.col("_winners.least"), LOW_ENGAGEMENT)
        .when(F.col("segment") == F.col("_winners.los"), COMPLEX_CARE)
        .when(F.col("segment") == F.col("_winners.visits"), FREQUENT)
        .when(F.col("segment") == F.col("_winners.spend"), HIGH_VALUE)
        .otherwise(F.concat(F.lit("Segment "), F.col("segment").cast("string")))
    )
    return named.withColumn("segment_label", label).drop("_winners")


def segment_summary(labelled: DataFrame) -> DataFrame:
    return (
        labelled.groupBy("segment_label")
        .agg(
            rows().alias("patients"),
            average_money("total_spend").alias("avg_spend"),
            cents_to_double(cents_sum("total_spend")).alias("total_revenue"),
        )
        .orderBy("segment_label")
    )


def segment_profile_minmax(labelled: DataFrame, columns: Sequence[str] = PROFILE) -> DataFrame:
    """Label means scaled to 0..1 across the labels; the tiny term keeps equal means at 0."""
    means = labelled.groupBy("segment_label").agg(*(F.avg(c).alias(c) for c in columns))
    labels = W.partitionBy()

    def scaled(column: str):
        low, high = F.min(column).over(labels), F.max(column).over(labels)
        return ((F.col(column) - low) / (high - low + F.lit(1e-9))).alias(column)

    return means.select("segment_label", *(scaled(c) for c in columns)).orderBy("segment_label")
