"""Models over messages: isolation forest, k-means, density and hierarchical clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, PCA, CountVectorizer, NGram, Normalizer, RegexTokenizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailrace.functions.text import STOP_WORDS
from tailrace.operators.dedup import dbscan

#: Rows of the sample that a forest is grown from, of each tree, and trees.
SAMPLE_ROWS, TREE_ROWS, TREES = 20_000, 256, 100
#: Density clusters of texts: the distance within which texts are near, and how many make a core.
EPS, NEAR = 0.5, 5


def path_bound(n: int) -> float:
    """The mean depth of an unsuccessful search among n."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class IsolationForest:
    """Isolation forest (Liu, Ting, Zhou 2008). Higher scores are more isolated."""

    def __init__(self, trees: list, rows: int) -> None:
        self.trees, self.rows = trees, rows

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 42) -> IsolationForest:
        rng, rows = np.random.default_rng(seed), min(rows, len(x))
        deepest = int(np.ceil(np.log2(max(rows, 2))))

        def grow(part: np.ndarray, depth: int) -> tuple:
            low, high = part.min(axis=0), part.max(axis=0)
            split = np.flatnonzero(high > low)
            if depth >= deepest or len(part) < 2 or not len(split):
                return (depth + path_bound(len(part)),)
            f = int(rng.choice(split))
            at = float(rng.uniform(low[f], high[f]))
            left = part[:, f] < at
            return f, at, grow(part[left], depth + 1), grow(part[~left], depth + 1)

        return cls([grow(x[rng.choice(len(x), rows, replace=False)], 0) for _ in range(trees)], rows)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))

        def fall(node: tuple, at: np.ndarray) -> None:
            if len(node) == 1:
                total[at] += node[0]
            elif len(at):
                left = x[at, node[0]] < node[1]
                fall(node[2], at[left])
                fall(node[3], at[~left])

        for t in self.trees:
            fall(t, np.arange(len(x)))
        return 2 ** (-total / len(self.trees) / max(path_bound(self.rows), 1e-9))


def predict_anomalies(logs: DataFrame, column: str = "template", contamination: float = 0.05, vocabulary: int = 256, seed: int = 42) -> DataFrame:
    """logs with anomaly_score and prediction (1: abnormal, about the share `contamination`): counts of
    the template's words through an isolation forest. It is grown from a bounded random sample and
    scores every row; the limit is the exact percentile of the scores."""
    text = logs.withColumn("__text", F.coalesce(column, F.lit("")))
    model = Pipeline(stages=[RegexTokenizer(inputCol="__text", outputCol="__words", pattern=r"\W+"), CountVectorizer(inputCol="__words", outputCol="__counts", vocabSize=vocabulary)]).fit(text)
    rows = model.transform(text).withColumn("__x", vector_to_array("__counts", "float32")).drop("__text", "__words", "__counts")
    sample = [r["__x"] for r in rows.select("__x", "_id").orderBy(F.xxhash64("_id", F.lit(seed))).limit(SAMPLE_ROWS).collect()]
    if not sample:
        return logs.withColumn("anomaly_score", F.lit(None).cast("double")).withColumn("prediction", F.lit(0))
    forest = IsolationForest.fit(np.array(sample), seed=seed)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(forest.scores(np.stack(x.to_numpy())))

    scored = rows.withColumn("anomaly_score", score("__x")).drop("__x")
    # a bounded sketch: the limit's rank is off by one in a million rows at most
    limit = scored.agg(F.percentile_approx("anomaly_score", 1 - contamination, 1_000_000)).first()[0]
    return scored.withColumn("prediction", (F.col("anomaly_score") > limit).cast("int"))


def features(column: str = "template", grams: int = 1, most: int = 1000, min_df: float = 1.0, max_df: float = 2.0**62) -> Pipeline:
    """Texts to unit tf-idf vectors in `features`, single words and sequences up to `grams`. min_df and max_df are shares below 1, numbers of texts from 1 on."""
    stages = [RegexTokenizer(inputCol=column, outputCol="__words", pattern=r"\W+"), StopWordsRemover(inputCol="__words", outputCol="__kept", stopWords=STOP_WORDS["en"])]
    last = "__kept"
    if grams > 1:
        stages.append(NGram(inputCol="__kept", outputCol="__grams", n=grams))
        last = "__grams"
    stages += [CountVectorizer(inputCol=last, outputCol="__tf", vocabSize=most, minDF=min_df, maxDF=max_df), IDF(inputCol="__tf", outputCol="__idf"), Normalizer(inputCol="__idf", outputCol="features")]
    return Pipeline(stages=stages)


def vectorise(rows: DataFrame, column: str = "template", **how: float) -> DataFrame:
    text = rows.withColumn("__text", F.coalesce(column, F.lit("")))
    return features("__text", **how).fit(text).transform(text).drop("__text", "__words", "__kept", "__grams", "__tf", "__idf")


def cluster(rows: DataFrame, column: str = "template", k: int | None = None, method: str = "kmeans", seed: int = 42) -> DataFrame:
    """rows with cluster_id by k-means, bisecting (hierarchical) k-means or density (dbscan) on
    tf-idf; k defaults to min(20, rows // 100 + 5), at most the number of different texts. dbscan takes
    no k: unit vectors within EPS are near, NEAR of them make a core, -1 is noise."""
    if method == "dbscan":
        # each text once, with its number; on unit vectors a distance of EPS is a cosine of 1 - EPS^2 / 2
        named = rows.withColumn("__key", F.coalesce(column, F.lit("")))
        x = vectorise(named, "__key").groupBy("__key").agg(F.first("features").alias("features"), F.count("*").alias("copies"))
        found = dbscan(x.select(F.col("__key").alias("id"), vector_to_array("features").alias("vector"), "copies"), 1 - EPS**2 / 2, NEAR)
        return named.join(found.select(F.col("id").alias("__key"), F.col("dup_cluster_id").alias("cluster_id")), "__key").drop("__key")
    seen = rows.agg(F.count("*").alias("n"), F.count_distinct(column).alias("different")).first()
    k = max(2, min(k or min(20, seen["n"] // 100 + 5), seen["different"] or 2))
    if seen["different"] < 2:
        return rows.withColumn("cluster_id", F.lit(0))
    x = vectorise(rows, column)
    made = {"kmeans": KMeans, "hierarchical": BisectingKMeans}[method](k=k, seed=seed, featuresCol="features", predictionCol="cluster_id")
    return made.fit(x).transform(x).drop("features")


def optimise_k(rows: DataFrame, column: str = "template", least: int = 2, most: int = 8, step: int = 2, criterion: str = "silhouette", seed: int = 42) -> DataFrame:
    """(k, silhouette, inertia, best) for each k tried. Best: the highest silhouette, or the k at
    which the inertia's curve bends most."""
    x = vectorise(rows, column).select("features").persist()
    out = []
    for k in range(least, most + 1, step):
        model = KMeans(k=k, seed=seed).fit(x)
        out.append((k, float(ClusteringEvaluator().evaluate(model.transform(x))), float(model.summary.trainingCost)))
    x.unpersist()
    if criterion == "silhouette" or len(out) < 3:
        best = max(out, key=lambda o: o[1])[0]
    else:
        bends = [out[i - 1][2] - 2 * out[i][2] + out[i + 1][2] for i in range(1, len(out) - 1)]
        best = out[1 + int(np.argmax(bends))][0]
    return rows.sparkSession.createDataFrame([(*o, o[0] == best) for o in out], "k int, silhouette double, inertia double, best boolean")


def cluster_features(rows: DataFrame, column: str = "template", n: int = 5) -> DataFrame:
    """(cluster_id, word, weight, rank): the words with the highest mean tf-idf of each cluster."""
    words = rows.select("_id", "cluster_id", F.explode(F.split(F.lower(column), r"\W+")).alias("word")).where("word <> ''")
    size = rows.groupBy("cluster_id").agg(F.count("*").alias("size"))
    tf = words.groupBy("cluster_id", "word").agg(F.count("*").alias("tf"))
    df = words.groupBy("word").agg(F.count_distinct("_id").alias("df"))
    total = F.broadcast(rows.agg(F.count("*").alias("total")))
    weighed = tf.join(df, "word").join(size, "cluster_id").join(total, F.lit(True)).withColumn("weight", F.col("tf") / F.col("size") * (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.col("weight").desc(), "word"))
    return weighed.withColumn("rank", rank).where(F.col("rank") <= n).select("cluster_id", "word", "weight", "rank")


def nearest_label(points: DataFrame, labelled: DataFrame, most_labelled: int = 20_000) -> DataFrame:
    """points(id, vector) with the label of the nearest labelled vector (euclidean), for models that
    cannot predict. The labelled set is bounded and goes to every task."""
    known = labelled.select("vector", "label").limit(most_labelled + 1).collect()
    if len(known) > most_labelled:
        raise ValueError("too many labelled vectors for a nearest-label search")
    v, labels = np.array([r["vector"] for r in known], dtype=np.float64), np.array([r["label"] for r in known])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("vector").to_pylist(), dtype=np.float64).reshape(b.num_rows, -1)
            at = ((v**2).sum(axis=1)[None, :] - 2 * x @ v.T).argmin(axis=1) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(labels[at].astype(np.int64) if b.num_rows else [], pa.int64())], names=["id", "label"])

    return points.select("id", "vector").mapInArrow(run, f"id {dict(points.dtypes)['id']}, label long")


def plane(rows: DataFrame, column: str = "template") -> DataFrame:
    """(_id, x, y): the two principal components of the tf-idf vectors, what a scatter plot draws."""
    x = vectorise(rows, column)
    flat = PCA(k=2, inputCol="features", outputCol="__p").fit(x).transform(x).withColumn("__p", vector_to_array("__p"))
    return flat.select("_id", F.col("__p")[0].alias("x"), F.col("__p")[1].alias("y"))
