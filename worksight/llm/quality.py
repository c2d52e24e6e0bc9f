"""Quality by a sparse rule ensemble.

Shallow trees over text statistics are grown on all training labels.  Each
path from a root is a rule, a conjunction of comparisons.  A logistic model
with a lasso penalty keeps a few rules, and these are compiled into one
Spark column expression, so scoring is plain column arithmetic.
"""

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from .statistics import NAMES, add_statistics

c = F.col
Condition = tuple[str, str, float]


def tree_rules(tree) -> set[tuple[Condition, ...]]:
    """The conditions on the way to each node but the root, redundant ones merged."""
    found = set()

    def walk(node, path: dict):
        if path:
            found.add(tuple(sorted((name, op, cut) for (name, op), cut in path.items())))
        if node.numDescendants() == 0:
            return
        split = node.split()
        name, cut = NAMES[split.featureIndex()], split.threshold()
        walk(node.leftChild(), path | {(name, "<="): min(cut, path.get((name, "<="), cut))})
        walk(node.rightChild(), path | {(name, ">"): max(cut, path.get((name, ">"), cut))})

    walk(tree._call_java("rootNode"), {})
    return found


def rule_column(rule: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for name, op, cut in rule:
        out &= (c(name) <= F.lit(cut)) if op == "<=" else (c(name) > F.lit(cut))
    return out


@dataclass
class RuleEnsemble:
    """An intercept and weighted rules."""
    intercept: float
    rules: list[tuple[tuple[Condition, ...], float]]

    def score(self) -> Column:
        """The probability of label 1, over the statistics' columns."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total += F.when(rule_column(rule), F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(train: DataFrame, label: str, trees: int = 20, depth: int = 3, penalty: float = 0.002, seed: int = 5) -> RuleEnsemble:
    """``train``: statistics and a 0/1 label.  One class only gives its constant; no rows give 0.5."""
    counts = {int(x[0]): x[1] for x in train.where(c(label).isin(0, 1)).groupBy(label).count().collect()}
    if len(counts) < 2:
        return RuleEnsemble(0.0 if not counts else 6.0 if 1 in counts else -6.0, [])
    rows = VectorAssembler(inputCols=list(NAMES), outputCol="_x").transform(
        train.where(c(label).isin(0, 1)).select(c(label).cast("double").alias("_y"), *NAMES))
    forest = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed,
                                    featureSubsetStrategy="onethird", minInstancesPerNode=5).fit(rows)
    rules = sorted(set().union(*(tree_rules(t) for t in forest.trees)))
    hits = VectorAssembler(inputCols=[f"_r{i}" for i in range(len(rules))], outputCol="_r").transform(
        rows.select("_y", *[rule_column(r).cast("double").alias(f"_r{i}") for i, r in enumerate(rules)])).select("_y", "_r")
    model = LogisticRegression(featuresCol="_r", labelCol="_y", regParam=penalty, elasticNetParam=1.0,
                               standardization=True, maxIter=60).fit(hits)
    weights = model.coefficients.toArray()
    return RuleEnsemble(float(model.intercept), [(r, float(w)) for r, w in zip(rules, weights, strict=True) if w])


def fold(id: Column, of: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")), F.lit(of))


def score(docs: DataFrame, labels: DataFrame, train: Column, measured: DataFrame | None = None, id: str = "doc_id", text: str = "text",
          label: str = "quality", **options) -> DataFrame:
    """id, statistics and score of each row of ``docs``.

    ``labels`` (id, label) of the rows that ``train`` selects by their id teach
    the rules; all of them do, there is no sample.  Rows whose label is null or
    not 0 or 1 teach nothing; a label given twice counts twice.  Null and empty texts have
    zero statistics and are scored like any other.  ``measured`` may pass the
    stored result of ``add_statistics``.
    """
    measured = add_statistics(docs, text, [id]) if measured is None else measured
    known = labels.select(c(f"`{id}`").alias(id), c(f"`{label}`").alias("_label")).where(train)
    model = fit(measured.join(known, id).select("_label", *NAMES), "_label", **options)
    return measured.withColumn("score", model.score())
