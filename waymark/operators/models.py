"""Learned detectors: journey risk and friction types on boosted trees, text themes on pyspark.ml, and what drove a score."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, NGram, Normalizer, RegexTokenizer, SQLTransformer, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark import vocab
from waymark.config import DEFAULTS, Settings
from waymark.operators import boosting
from waymark.operators.metrics import is_calibration, is_test
from waymark.session import checkpointed

RISK_FEATURES = list(vocab.FEATURE_COLUMNS)
FRICTION_FEATURES = [*vocab.FEATURE_COLUMNS, *vocab.JOIN_COLUMNS]


def _vector(features: Sequence[str]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])


def _scored(df: DataFrame, found: dict[str, boosting.Ensemble], features: Sequence[str], name: str) -> DataFrame:
    """Add `name`: the models' log odds, in the order of `found`. The trees travel to the tasks once."""
    sent = df.sparkSession.sparkContext.broadcast(list(found.values()))

    @F.pandas_udf("array<double>")
    def odds(x: pd.Series) -> pd.Series:
        rows = np.stack(x.to_list()) if len(x) else np.empty((0, len(features)))
        places = sent.value[0].places(rows)  # models of one node table share their borders
        return pd.Series(list(np.stack([e.score(rows, places) for e in sent.value], 1)))

    return df.withColumn(name, odds(_vector(features)))


def _probability(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


# --- risk ------------------------------------------------------------------------------------------------

@dataclass
class RiskModel:
    """Boosted trees on session prefixes with isotonic calibration on sessions of their own."""

    nodes: DataFrame
    calibration: IsotonicRegressionModel
    features: list[str] = field(default_factory=lambda: list(RISK_FEATURES))

    @classmethod
    def fit(cls, frame: DataFrame, s: Settings = DEFAULTS, features: Sequence[str] = RISK_FEATURES, rounds: int = 300,
            leaves: int = 31, task_rows: int = boosting.TASK_ROWS) -> "RiskModel":
        """frame: session_id, label and the feature columns (see `joins.risk_frame`). The trees see all rows outside of the test and
        calibration splits; beyond `task_rows` they are fitted by many tasks."""
        train = frame.filter(~is_test(F.col("session_id"), s))
        held = is_calibration(F.col("session_id"))
        named = train.filter(~held).withColumn("risk", F.col("label"))
        nodes = checkpointed(boosting.fit(named, "session_id", features, ["risk"], boosting.Growth(rounds, leaves, seed=s.seed), task_rows))
        raw = cls._raw(train.filter(held), nodes, features).select("_raw", F.col("label").cast("double").alias("label"))
        return cls(nodes, IsotonicRegression(featuresCol="_raw", labelCol="label").fit(raw), list(features))

    @staticmethod
    def _raw(df: DataFrame, nodes: DataFrame, features: Sequence[str]) -> DataFrame:
        return _scored(df, boosting.ensembles(nodes), features, "_raw").withColumn("_raw", _probability(F.get("_raw", 0)))

    def score(self, df: DataFrame, name: str = "risk") -> DataFrame:
        out = self.calibration.setPredictionCol("_cal").transform(self._raw(df, self.nodes, self.features))
        return out.withColumn(name, F.least(F.greatest("_cal", F.lit(0.0)), F.lit(1.0))).drop("_raw", "_cal")

    def save(self, folder: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{folder}/trees")
        self.calibration.write().overwrite().save(f"{folder}/calibration")

    @classmethod
    def load(cls, spark: SparkSession, folder: str, features: Sequence[str] = RISK_FEATURES) -> "RiskModel":
        return cls(spark.read.schema(boosting.NODES).parquet(f"{folder}/trees"), IsotonicRegressionModel.load(f"{folder}/calibration"), list(features))


# --- friction types ----------------------------------------------------------------------------------------

@dataclass
class FrictionModel:
    """One model per friction, so that the probabilities are independent. All are one node table and are fitted at once."""

    nodes: DataFrame
    features: list[str]
    frictions: list[str]

    @classmethod
    def fit(cls, frame: DataFrame, labels: DataFrame, s: Settings = DEFAULTS,
            features: Sequence[str] = FRICTION_FEATURES, rounds: int = 200, leaves: int = 31,
            frictions: Sequence[str] = vocab.FRICTIONS, task_rows: int = boosting.TASK_ROWS) -> "FrictionModel":
        """frame: session_id and features; labels: session_id and one 0/1 column per friction."""
        joined = frame.join(labels.select("session_id", *frictions), "session_id", "left").na.fill(0, list(frictions))
        train = joined.filter(~is_test(F.col("session_id"), s))
        nodes = boosting.fit(train, "session_id", features, list(frictions), boosting.Growth(rounds, leaves, seed=s.seed), task_rows)
        return cls(checkpointed(nodes), list(features), list(frictions))

    def score(self, df: DataFrame) -> DataFrame:
        """Add friction_probs, rounded to four digits."""
        found = boosting.ensembles(self.nodes)
        out = _scored(df, {f: found[f] for f in self.frictions}, self.features, "_odds")
        pairs = [x for i, f in enumerate(self.frictions) for x in (F.lit(f), F.round(_probability(F.get("_odds", i)), 4))]
        return out.withColumn("friction_probs", F.create_map(*pairs)).drop("_odds")

    def save(self, folder: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{folder}/trees")

    @classmethod
    def load(cls, spark: SparkSession, folder: str, features: Sequence[str] = FRICTION_FEATURES,
             frictions: Sequence[str] = vocab.FRICTIONS) -> "FrictionModel":
        return cls(spark.read.schema(boosting.NODES).parquet(f"{folder}/trees"), list(features), list(frictions))


def top_frictions(probs: Column, k: int = 2) -> Column:
    """Most probable frictions, taxonomy order on ties."""
    rows = F.array(*[F.struct((-F.coalesce(F.try_element_at(probs, F.lit(f)), F.lit(0.0))).alias("p"),
                              F.lit(i).alias("i"), F.lit(f).alias("f")) for i, f in enumerate(vocab.FRICTIONS)])
    return F.slice(F.transform(F.array_sort(rows), lambda r: r["f"]), 1, k)


# --- text themes --------------------------------------------------------------------------------------------

def text_vectors(size: int = 4096) -> Pipeline:
    """Hashed word and word-pair counts, normalised; stands in where no embedding column is given."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="_w", pattern=r"[^\p{L}\p{N}]+"), NGram(n=2, inputCol="_w", outputCol="_w2"),
        SQLTransformer(statement="SELECT *, concat(_w, _w2) AS _t FROM __THIS__"),
        HashingTF(inputCol="_t", outputCol="_tf", numFeatures=size), Normalizer(inputCol="_tf", outputCol="_x")])


@dataclass
class ThemeModel:
    """Logistic regression over embeddings (array column) or over hashed text."""

    vectors: PipelineModel | None
    regression: LogisticRegressionModel
    classes: list[str]

    @classmethod
    def fit(cls, texts: DataFrame, label: str = "theme_label", embedding: str | None = None, c: float = 4.0,
            max_iter: int = 3000) -> "ThemeModel":
        vectors = None
        # the rows of a few large files are dealt out evenly, since every iteration is as slow as the largest part
        spark = texts.sparkSession
        parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        texts = texts.select(label, embedding or "text").repartition(parts)
        if embedding:
            data = texts.withColumn("_x", array_to_vector(F.col(embedding).cast("array<double>")))
        else:
            vectors = text_vectors().fit(texts)
            data = vectors.transform(texts)
        indexer = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(data)
        # on disk, since the fit keeps its own blocks of all rows in memory
        data = indexer.transform(data).select("_x", "_y").persist(StorageLevel.DISK_ONLY)
        try:
            # the penalty is given per data set (C); here it is per row
            penalty = 1.0 / (c * max(data.count(), 1))
            model = LogisticRegression(featuresCol="_x", labelCol="_y", family="multinomial", regParam=penalty,
                                       maxIter=max_iter).fit(data)
        finally:
            data.unpersist()
        return cls(vectors, model, list(indexer.labels))

    def classify(self, texts: DataFrame, embedding: str | None = None, s: Settings = DEFAULTS) -> DataFrame:
        """Add predicted, theme, theme_prob, theme_method. Unsure texts fall back to `other`."""
        if embedding:
            data = texts.withColumn("_x", array_to_vector(F.col(embedding).cast("array<double>")))
        else:
            data = self.vectors.transform(texts)
        names = F.array(*[F.lit(c) for c in self.classes])
        self.regression.setProbabilityCol("_p").setPredictionCol("_c").setRawPredictionCol("_r")
        out = self.regression.transform(data).withColumns({
            "predicted": F.get(names, F.col("_c").cast("int")), "_max": F.array_max(vector_to_array("_p"))})
        sure = F.col("_max") >= s.theme_min_prob
        return out.withColumns({
            "theme": F.when(sure, F.col("predicted")).otherwise("other"), "theme_prob": F.round("_max", 4),
            "theme_method": F.when(sure, "classifier").otherwise("fallback"),
        }).drop("_x", "_w", "_w2", "_t", "_tf", "_p", "_c", "_r", "_max")


def classify_distinct(model: ThemeModel, texts: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Score every distinct text once and join the result back."""
    scored = model.classify(texts.select("text").distinct(), s=s)
    return texts.join(scored.select("text", "theme", "theme_prob", "theme_method"), "text", "left")


# --- attribution ----------------------------------------------------------------------------------------------

SIGNAL = "array<struct<feature:string,value:double>>"


def attributed(df: DataFrame, nodes: DataFrame, features: Sequence[str], wanted: str | None = None, k: int = 5) -> DataFrame:
    """session_id, signals: for each model of a node table (or those in the row's `wanted` list) the k features that pushed the row's
    score up the most on its way through the trees.

    All ensembles travel to the tasks once, as a broadcast; a batch is walked once per model, by the rows that want it.
    """
    shared = df.sparkSession.sparkContext.broadcast(boosting.ensembles(nodes))
    names = list(features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch["_x"].to_list()) if len(batch) else np.empty((0, len(names)))
            lists = [list(w) if w is not None else [] for w in batch[wanted]] if wanted else [list(shared.value)] * len(batch)
            found: list[dict] = [{} for _ in lists]
            for model, trees in shared.value.items():
                rows = np.array([i for i, w in enumerate(lists) if model in w], dtype=int)
                if not len(rows):
                    continue
                c = trees.contributions(x[rows])
                best = np.argsort(-c, axis=1, kind="stable")[:, :k]
                for i, row, order in zip(rows.tolist(), c, best, strict=True):
                    found[i][model] = [{"feature": names[j], "value": round(float(row[j]), 4)} for j in order if row[j] > 0]
            yield pd.DataFrame({"session_id": batch["session_id"], "signals": found})

    rows = df.select("session_id", _vector(names).alias("_x"), *([wanted] if wanted else []))
    return rows.mapInPandas(run, f"session_id string, signals map<string,{SIGNAL}>")


# --- scoring all sessions ---------------------------------------------------------------------------------------

def score_sessions(features: DataFrame, prefixes: DataFrame, sessions: DataFrame, risk: RiskModel,
                   friction: FrictionModel) -> DataFrame:
    """session_id, risk_score, friction_probs: full sessions for the cause, the final prefix for the risk.

    A session without a prefix is scored on zeros; post-purchase sessions take their largest friction probability.
    """
    probs = friction.score(features).select("session_id", "friction_probs")
    last = prefixes.filter("is_final").select("session_id", *risk.features)
    view = features.select("session_id").join(last, "session_id", "left").na.fill(0.0)
    scored = risk.score(view).select("session_id", "risk")
    kinds = sessions.select("session_id", "session_kind")
    joined = probs.join(scored, "session_id").join(kinds, "session_id")
    own = F.when(F.col("session_kind") == "post_purchase", F.array_max(F.map_values("friction_probs"))).otherwise(F.col("risk"))
    return joined.select("session_id", F.round(own, 4).alias("risk_score"), "friction_probs")


def with_signals(scores: DataFrame, features: DataFrame, prefixes: DataFrame, risk: RiskModel, friction: FrictionModel) -> DataFrame:
    """Add top_signals (risk) and friction_signals (of the two most probable frictions)."""
    last = features.select("session_id").join(
        prefixes.filter("is_final").select("session_id", *risk.features), "session_id", "left").na.fill(0.0)
    own = attributed(last, risk.nodes, risk.features).select("session_id", F.col("signals")["risk"].alias("top_signals"))
    out = scores.join(own, "session_id", "left").withColumn("_top", top_frictions(F.col("friction_probs")))
    rows = features.select("session_id", *friction.features).join(out.select("session_id", "_top"), "session_id")
    lists = attributed(rows, friction.nodes, friction.features, "_top")
    return out.join(lists.withColumnRenamed("signals", "friction_signals"), "session_id", "left").drop("_top")
