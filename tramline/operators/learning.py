"""Preparing, weighting and evaluating travel-mode classifiers; the rule classifier and a trained one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.schemas import POINT_FEATURES, STATS


def encode_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """label and label_id, from 0 in the order of the names. The distinct labels are few."""
    names = df.select(label).where(F.col(label).isNotNull()).distinct()
    return names.withColumn("label_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(label)) - 1)


def split(df: DataFrame, key: str, label: str = "label", seed: int = 42, shares: tuple[float, float] = (0.7, 0.1)) -> DataFrame:
    """Adds split (train, valid, test) to each row, by a hash of label and key: in each label the shares hold on average.

    A row belongs to a share if its hash, as a fraction, does. So no label has to be sorted,
    and a row keeps its place as others come; a label of a few rows may have none in a share.
    """
    spot = F.conv(F.substring(F.md5(F.concat(F.col(label), F.lit("|"), F.col(key), F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return df.withColumn("split", F.when(spot < shares[0], "train").when(spot < sum(shares), "valid").otherwise("test"))


def scaling(df: DataFrame, columns: list[str], least: float = 1e-6, add: float = 0.0) -> DataFrame:
    """One row for each column: mean and divisor (population deviation; 1 if under ``least``; plus ``add``)."""
    sums = df.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns))
    divisor = lambda c: F.when(F.col(f"s_{c}") < least, 1.0).otherwise(F.col(f"s_{c}")) + add
    return sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("mean"), divisor(c).alias("divisor")) for c in columns))).alias("r")).select("r.*")


def standardise(df: DataFrame, train: DataFrame, columns: list[str], least: float = 1e-6, add: float = 0.0) -> DataFrame:
    """Columns by mean and divisor of the training rows, which come as one row of scalars."""
    mean = {c: train.agg(F.avg(c)).scalar() for c in columns}
    dev = {c: train.agg(F.stddev_pop(c)).scalar() for c in columns}
    return df.withColumns({c: (F.col(c) - mean[c]) / (F.when(dev[c] < least, 1.0).otherwise(dev[c]) + add) for c in columns})


def class_weights(df: DataFrame, mode: str = "inverse", label: str = "label", beta: float = 0.9999) -> DataFrame:
    """Weight of each label, their mean 1. mode: inverse, sqrt_inverse, effective."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).cast("double").alias("n"))
    every = Window.partitionBy(F.lit(0))
    share = F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))
    raw = {"inverse": share, "sqrt_inverse": F.sqrt(share), "effective": (1.0 - beta) / (1.0 - F.pow(F.lit(beta), F.col("n")))}[mode]
    weighted = counts.withColumn("_raw", raw)
    return weighted.select(label, F.col("n").cast("long").alias("n"), (F.col("_raw") / F.avg("_raw").over(every)).alias("weight"))


def rule_mode(avg_speed: Column, max_speed: Column, stop_ratio: Column, spatial: bool = False) -> Column:
    """Travel mode by speed: train, subway (only with spatial features) or car, bus or car by stops, bike, walk."""
    return (
        F.when(max_speed > 45, "train").when(avg_speed > 16, "subway" if spatial else "car")
        .when(avg_speed > 7, F.when(stop_ratio > 0.15, "bus").otherwise("car")).when(avg_speed > 3.5, "bike").otherwise("walk")
    )


def rule_confidence(avg_speed: Column, max_speed: Column, stop_ratio: Column, spatial: bool = False) -> Column:
    """The fixed confidence of each rule."""
    return (
        F.when(max_speed > 45, 0.92).when(avg_speed > 16, 0.91 if spatial else 0.81)
        .when(avg_speed > 7, F.when(stop_ratio > 0.15, 0.82).otherwise(0.84)).when(avg_speed > 3.5, 0.86).otherwise(0.94)
    )


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits."""
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def argmax(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def focal_loss(probabilities: Column, truth: Column, n_classes: int, gamma: float = 2.0, smoothing: float = 0.1, weights: Column | None = None) -> Column:
    """Label-smoothed focal loss of a row: an array of probabilities, the number of the true class, weights by class if given."""
    def term(p: Column, k: Column) -> Column:
        target = F.when(k == truth, 1 - smoothing + smoothing / n_classes).otherwise(smoothing / n_classes)
        loss = -F.pow(1 - p, F.lit(gamma)) * target * F.log(p + 1e-8)
        return loss if weights is None else loss * F.get(weights, k)

    return F.aggregate(F.transform(probabilities, term), F.lit(0.0), lambda a, x: a + x)


def weighted_cross_entropy(probabilities: Column, truth: Column, weights: Column) -> Column:
    """Of a row; the mean over rows is the sum of these by the sum of the true classes' weights."""
    return -F.get(weights, truth) * F.log(F.get(probabilities, truth) + 1e-8)


def _unit(*parts: Column) -> Column:
    """A fraction between 0 and 1 from the MD5 digest of the parts, as other engines can compute it too."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def _warped(points: DataFrame, keys: list[str], order: str, factor: Column) -> DataFrame:
    """Point features drawn on lines to ``factor`` times the rows of the segment (10 at least), and these back to its own rows."""
    columns = [c for c in POINT_FEATURES if c in points.columns]
    by = Window.partitionBy(*keys)
    rows = points.withColumns({"_i": F.row_number().over(by.orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(by)})
    values = rows.select(*keys, F.col("_i").alias("_r"), *columns, *(F.lead(c).over(by.orderBy("_i")).alias(f"_{c}") for c in columns))
    drawn = rows.withColumn("_m", F.greatest(F.floor(F.col("_n") * factor), F.lit(10)))
    spot = F.coalesce(F.try_divide(F.col("_i") * (F.col("_m") - 1.0), F.col("_n") - 1.0), F.lit(0.0))
    drawn = drawn.withColumns({"_low": F.floor(spot), "_part": spot - F.floor(spot)})
    # A row lies between two drawn ones, and each of these between two rows.
    sides = F.array(F.struct(F.col("_low").alias("at"), (1 - F.col("_part")).alias("share")), F.struct(F.least(F.col("_low") + 1, F.col("_m") - 1).alias("at"), F.col("_part").alias("share")))
    place = F.col("_s.at") * (F.col("_n") - 1.0) / (F.col("_m") - 1.0)
    asked = drawn.select(*keys, "_i", F.explode(sides).alias("_s"), "_n", "_m").select(*keys, "_i", "_s.share", place.alias("_place")).withColumn("_r", F.floor("_place").cast("int"))
    between = lambda c: F.col(c) + (F.col("_place") - F.col("_r")) * (F.coalesce(f"_{c}", c) - F.col(c))
    bent = asked.join(values, [*keys, "_r"]).groupBy(*keys, "_i").agg(*(F.sum(F.col("share") * between(c)).alias(c) for c in columns))
    return rows.drop(*columns, "_n").join(bent, [*keys, "_i"]).select(*points.columns)


def augment(points: DataFrame, kind: str, keys: list[str], order: str = "step", seed: int = 42) -> DataFrame:
    """A changed copy of each segment: scale (speed and acceleration by 0.85 to 1.15), noise (0.05 on motion), flip (backwards),
    time_warp (point features drawn out or pressed to 0.8 to 1.2 times their number, and back).

    What is random comes from a hash of the segment, the row and the seed, so a lost task
    gives the same values again.
    """
    own = [F.col(k) for k in keys]
    if kind == "scale":
        factor = 0.85 + 0.3 * _unit(*own, F.lit("scale"), F.lit(seed))
        return points.withColumns({c: F.col(c) * factor for c in ("speed", "acceleration")})
    if kind == "noise":
        def normal(c: str) -> Column:
            spot = lambda part: _unit(*own, F.col(order), F.lit(c), F.lit(part), F.lit(seed))
            return F.sqrt(-2 * F.log(spot(1))) * F.cos(6.283185307179586 * spot(2))

        return points.withColumns({c: F.col(c) + 0.05 * normal(c) for c in ("speed", "acceleration", "bearing_change", "distance", "time_diff")})
    if kind == "time_warp":
        return _warped(points, keys, order, 0.8 + 0.4 * _unit(*own, F.lit("warp"), F.lit(seed)))
    if kind == "flip":
        last = F.max(order).over(Window.partitionBy(*keys)) + F.min(order).over(Window.partitionBy(*keys))
        return points.withColumn(order, last - F.col(order))
    raise ValueError(kind)


def oversample(segments: DataFrame, key: str, label: str = "label", ratio: float = 0.3) -> DataFrame:
    """Rows (key, label, copy): copies 1, 2, ... of segments of rare labels, so that with the originals each label has ``ratio`` of the largest."""
    counts = segments.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    wanted = counts.withColumn("_need", F.floor(F.max("_n").over(Window.partitionBy(F.lit(0))) * ratio) - F.col("_n")).where("_need > 0")
    # The labels in need are rare, so their rows can be numbered label by label.
    numbered = segments.select(key, label).join(wanted, label).withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy(key)) - 1)
    copies = F.floor(F.col("_need") / F.col("_n")) + F.when(F.col("_r") < F.col("_need") % F.col("_n"), 1).otherwise(0)
    return numbered.withColumn("_copies", copies).where("_copies > 0").select(key, label, F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("copy"))


def confusion(predictions: DataFrame, truth: str = "true_label", guess: str = "pred_label") -> DataFrame:
    return predictions.groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))


def report(predictions: DataFrame, truth: str = "true_label", guess: str = "pred_label") -> DataFrame:
    """precision, recall, f1, support of each label, then macro avg, weighted avg and accuracy; 0 where nothing divides."""
    cells = confusion(predictions, truth, guess)
    right = F.sum(F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0))
    actual = cells.groupBy(F.col(truth).alias("label")).agg(F.sum("n").alias("support"), right.alias("hits"))
    guessed = cells.groupBy(F.col(guess).alias("label")).agg(F.sum("n").alias("guesses"))
    by = actual.join(guessed, "label", "full").na.fill(0, ["support", "hits", "guesses"])
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    by = by.withColumns({"precision": div(F.col("hits"), F.col("guesses")), "recall": div(F.col("hits"), F.col("support"))})
    by = by.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    names = ("precision", "recall", "f1")
    per = by.select("label", *names, "support", "hits")
    total = F.sum("support")
    mean = per.agg(*(F.avg(c).alias(c) for c in names), total.alias("support")).select(F.lit("macro avg").alias("label"), *names, "support")
    weighted = per.agg(*(div(F.sum(F.col(c) * F.col("support")), total).alias(c) for c in names), total.alias("support")).select(F.lit("weighted avg").alias("label"), *names, "support")
    right_share = per.agg(div(F.sum("hits"), total).alias("a"), total.alias("support")).select(F.lit("accuracy").alias("label"), *(F.col("a").alias(c) for c in names), "support")
    return per.drop("hits").union(mean).union(weighted).union(right_share)


def train_classifier(train: DataFrame, label: str = "label", columns: tuple[str, ...] = STATS, depth: int = 8, trees: int = 40, seed: int = 42):
    """A random forest on the segment statistics, trained by Spark ML; returns the fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler

    index = StringIndexer(inputCol=label, outputCol="label_id", stringOrderType="alphabetAsc", handleInvalid="keep").fit(train)
    return Pipeline(stages=[
        index, VectorAssembler(inputCols=list(columns), outputCol="features"), RandomForestClassifier(labelCol="label_id", maxDepth=depth, numTrees=trees, seed=seed),
        IndexToString(inputCol="prediction", outputCol="pred_label", labels=index.labels)]).fit(train)
