"""Training frames, presence models, random forests and their evaluation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdance.operators.spatial import count_within, far_from
from verdance.operators.zonal import zonal_mean_sd

#: Weight of a background row against a presence row: background stands for the whole area.
BACKGROUND_WEIGHT = 100.0


def classes_of(df: DataFrame, field: str, classes: Iterable[str | Iterable[str]]) -> DataFrame:
    """Rows whose field is one of the classes; a class given as several synonyms is named by the first."""
    names = {s: (c if isinstance(c, str) else list(c)[0]) for c in classes for s in ([c] if isinstance(c, str) else c)}
    case = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col(field))
    return df.filter(F.col(field).isin(*names)).withColumn("class", case)


def usable_tiles(tiles: DataFrame, points: DataFrame, layers: int = 23, least_points: int = 2, tile: str = "tile") -> DataFrame:
    """Tiles (tile, layers) with exactly so many predictor layers and at least ``least_points`` points."""
    counts = points.groupBy(tile).agg(F.count("*").alias("points")).filter(F.col("points") >= least_points)
    return tiles.filter(F.col("layers") == layers).join(counts, tile).select(tile, "points")


def systematic_cells(cells: DataFrame, zone: str, n: int) -> DataFrame:
    """About ``n`` cells of each zone, evenly spaced in the order of the cells, each once."""
    each = cells.select(zone, "cell").distinct()
    order = Window.partitionBy(zone).orderBy("cell")
    step = F.greatest(F.floor(F.count("*").over(Window.partitionBy(zone)) / n), F.lit(1))
    return each.withColumn("_n", F.row_number().over(order) - 1).withColumn("_step", step).filter(F.col("_n") % F.col("_step") == 0).drop("_n", "_step")


def training_frame(presence: DataFrame, background: DataFrame, avoid: DataFrame, covariates: list[str], class_name: str, n: int, distance: float = 20.0, seed: int | None = 0) -> DataFrame:
    """pres 1 and 0 rows with covariates: presence cells as they are, and ``n`` random background cells.

    Background leaves out presence cells, cells at most ``distance`` from the points to avoid and rows with missing
    covariates. Fewer than a hundredth of ``n`` rows is an error.
    """
    order = [F.col("cell")] if seed is None else [F.xxhash64(F.lit(seed), "cell"), F.col("cell")]
    others = background.join(presence.select("cell").distinct(), "cell", "left_anti")
    drawn = others.orderBy(*order).limit(n)
    absent = far_from(drawn, avoid, distance, "cell").dropna(subset=covariates)
    found = absent.count()  # at most n rows
    if found == 0 or found < n / 100:
        raise ValueError(f"{found} background rows of {n} are left")
    part = lambda df, pres: df.select("cell", F.lit(pres).alias("pres"), *covariates, F.lit(class_name).alias("class"))
    return part(presence, 1).unionByName(part(absent, 0))


def expanded(df: DataFrame, covariates: list[str], knots: int = 3) -> tuple[dict[str, Column], list[str]]:
    """Linear, square and hinge features of covariates on a 0..1 scale, with limits from the data."""
    limits = df.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{n}{k}") for k, c in enumerate(covariates) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    columns: dict[str, Column] = {}
    for k, c in enumerate(covariates):
        lo, hi = float(limits[f"lo{k}"] or 0.0), float(limits[f"hi{k}"] or 0.0)
        x = (F.col(f"`{c}`").cast("double") - lo) / (hi - lo if hi > lo else 1.0)
        columns[f"f{k}"] = x
        columns[f"f{k}_2"] = x * x
        for h in range(1, knots + 1):
            columns[f"f{k}_h{h}"] = F.greatest(x - h / (knots + 1), F.lit(0.0))
    return columns, list(columns)


class PresenceModel:
    """Presence against background: L1 logistic regression on expanded covariates, background rows weighted up.

    With heavily weighted background this is the point-process form of the maximum-entropy model; its output is a relative
    intensity on 0..1.
    """

    def __init__(self, columns: dict[str, Column], model: PipelineModel):
        self.columns, self.model = columns, model

    @classmethod
    def fit(cls, frame: DataFrame, covariates: list[str], presence: str = "pres", l1: float = 1e-4, weight: float = BACKGROUND_WEIGHT) -> PresenceModel:
        columns, names = expanded(frame, covariates)
        rows = frame.dropna(subset=covariates).withColumns(columns).withColumn("_w", F.when(F.col(presence) == 1, 1.0).otherwise(weight)).withColumn("_y", F.col(presence).cast("double"))
        steps = [VectorAssembler(inputCols=names, outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=l1, elasticNetParam=1.0, maxIter=50)]
        return cls(columns, Pipeline(stages=steps).fit(rows))

    def predict(self, df: DataFrame, out: str = "p", byte: bool = False, weight: float = BACKGROUND_WEIGHT) -> DataFrame:
        """Adds the relative intensity; ``byte`` scales it to 0..255, halves to even. Rows with missing covariates get null."""
        ok = F.lit(True)
        for c in self.columns.values():
            ok = ok & c.isNotNull()
        scored = self.model.transform(df.withColumns({n: F.coalesce(c, F.lit(0.0)) for n, c in self.columns.items()}).withColumn("_ok", ok))
        share = vector_to_array("probability")[1]
        p = F.when(F.col("_ok"), weight * share / (1 - share + weight * share))
        return scored.select(*df.columns, (F.bround(255 * p).cast("short") if byte else p).alias(out))


def fit_by_class(frame: DataFrame, covariates: list[str], class_field: str = "class") -> dict[str, PresenceModel]:
    """One model for each class; classes are few and known from the frame."""
    names = [r[0] for r in frame.select(class_field).distinct().orderBy(class_field).collect()]
    return {n: PresenceModel.fit(frame.filter(F.col(class_field) == n), covariates) for n in names}


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def train_forest(pixels: DataFrame, zones: DataFrame, bands: list[str], label: str, key: str = "fid", trees: int = 100, seed: int = 0) -> PipelineModel:
    """Random forest over the bands' means and deviations by zone; ``zones`` (key, label)."""
    features = zonal_mean_sd(pixels, key, bands).join(zones.select(key, label), key).dropna()
    names = [c for c in features.columns if c not in (key, label)]
    indexer = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(features)
    forest = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, featureSubsetStrategy="sqrt", seed=seed)
    back = IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels)
    return Pipeline(stages=[indexer, VectorAssembler(inputCols=names, outputCol="_x"), forest, back]).fit(features)


def classify_zones(pixels: DataFrame, zones: DataFrame, bands: list[str], model: PipelineModel, key: str = "fid", target: str | None = None) -> DataFrame:
    """Zones with their predicted class; only those of ``target`` if given."""
    features = zonal_mean_sd(pixels, key, bands).dropna()
    steps = PipelineModel([s for s in model.stages if not s.uid.startswith("StringIndexer")])
    out = zones.join(steps.transform(features).select(key, "predicted"), key)
    return out if target is None else out.filter(F.col("predicted") == target)


def error_observations(points: DataFrame, cells: DataFrame, radius: float, n_absent: int, seed: int | None = 0) -> DataFrame:
    """(vis, pred, class): presence cells within ``radius`` of each reference point (vis 1) and of pseudo-absences (vis 0).

    Pseudo-absences are random cells farther than twice the radius from all points.
    """
    present = cells.filter("presence").select("x", "y")
    seen = count_within(points.select("fid", "x", "y", "class"), present, radius, out="pred").select(F.lit(1).alias("vis"), "pred", "class")
    order = [F.col("cell")] if seed is None else [F.xxhash64(F.lit(seed), "cell"), F.col("cell")]
    far = far_from(cells.select("cell", "x", "y"), points, 2 * radius, "cell").orderBy(*order).limit(n_absent)
    unseen = count_within(far, present, radius, "cell", "pred")
    names = points.select("class").distinct()
    return seen.unionByName(unseen.select(F.lit(0).alias("vis"), "pred").join(names, how="cross").select("vis", "pred", "class"))  # n_absent rows by the few classes


def error_rates(observations: DataFrame) -> DataFrame:
    """By class: omission (reference points without a presence) and commission (pseudo-absences with one)."""
    hit = (F.col("pred") > 0).cast("double")
    return observations.groupBy("class").agg(
        F.round(1 - F.avg(F.when(F.col("vis") == 1, hit)), 6).alias("omission"), F.round(F.avg(F.when(F.col("vis") == 0, hit)), 6).alias("commission"), F.count("*").alias("n")
    )
