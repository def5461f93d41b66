"""Random forests over all rows of a table: Spark fits them level by level, tasks judge rows with a small copy of the trees.

Features are codes of fixed bins (``EDGES``), declared nominal, so no split, edge or leaf comes from a sample of the rows, and counts
are whole numbers: the trees do not depend on how rows are dealt.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, shared_dir

#: Numbers to 19 have a bin each, larger ones share bins.
EDGES = np.array([*np.arange(-0.5, 20), 24, 29, 34, 39, 49, 64, 99, 199], dtype=np.float32)
BINS = len(EDGES) + 1


def codes(x: np.ndarray) -> np.ndarray:
    return np.searchsorted(EDGES, x).astype(np.int8)


@dataclass
class Forest:
    """Nodes of all trees: a row goes left if ``goes_left`` has the code of its ``feature``; leaves lead to themselves."""

    feature: np.ndarray
    goes_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray
    roots: np.ndarray
    depth: int

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Of label 1, for each row of features."""
        return self.judged(codes(x))

    def judged(self, coded: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(coded)), np.arange(len(coded))
        for root in self.roots:
            node = np.full(len(coded), root)
            for _ in range(self.depth):
                node = np.where(self.goes_left[node, coded[rows, self.feature[node]]], self.left[node], self.right[node])
            total += self.share[node]
        return total / len(self.roots)


def fit(rows: DataFrame, width: int, trees: int = 20, depth: int = 8, seed: int = 7) -> Forest:
    """A forest from ``rows(label, codes array<tinyint>)`` with both labels, ``width`` codes each; all of them are used for every tree."""
    spark = rows.sparkSession
    attrs = {"ml_attr": {"attrs": {"nominal": [{"idx": i, "name": f"f{i}", "num_vals": BINS} for i in range(width)]}, "num_attrs": width}}
    label = F.col("label").cast("double").alias("label", metadata={"ml_attr": {"type": "nominal", "name": "label", "num_vals": 2}})
    vectors = rows.select(label, array_to_vector(F.col("codes").cast("array<double>")).alias("x")).select("label", F.col("x").alias("x", metadata=attrs))
    maker = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, maxBins=BINS, bootstrap=False, subsamplingRate=1.0, featureSubsetStrategy="onethird", minInstancesPerNode=2, maxMemoryInMB=128, seed=seed)
    path = shared_dir(spark)
    maker.fit(vectors).save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()  # trees * 2 ** (depth + 1) at most
    drop(spark, path)
    place = {(n.treeID, n.id): i for i, n in enumerate(nodes)}
    goes_left = np.zeros((len(nodes), BINS), dtype=bool)
    for i, n in enumerate(nodes):
        goes_left[i, [int(c) for c in n.split.leftCategoriesOrThreshold]] = True
    to = lambda side: np.array([place.get((n.treeID, n[side]), i) for i, n in enumerate(nodes)])
    share = np.array([n.impurityStats[1] / sum(n.impurityStats) for n in nodes])
    return Forest(np.array([max(0, n.split.featureIndex) for n in nodes]), goes_left, to("leftChild"), to("rightChild"), share, np.array([i for i, n in enumerate(nodes) if n.id == 0]), depth)
