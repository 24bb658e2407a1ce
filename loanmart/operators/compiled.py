"""Fitted classifiers as SQL text over the encoded columns.

A linear model becomes a weighted sum, a tree nested CASE expressions, an ensemble the sum of its trees.  The text is the same
for Spark and other engines but for the quotes of its names, so scoring is a projection inside generated code: no vectors, no
Python workers, and a scan reads only the columns the model looks at.

A row that is NULL in a column the model reads gets a NULL prediction.  NaN is above every number, as in Spark's order.  Further
columns of a frame, whatever their names, change nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassificationModel, LinearSVCModel, LogisticRegressionModel
from pyspark.sql import Column, functions as F

from .boosting import BoostedModel

# larger ensembles are scored from their node table: text of this size is still planned in seconds
MOST_NODES = 20_000


@dataclass(frozen=True)
class Split:
    """Rows that pass ``column test cut`` go left."""

    column: str
    test: str
    cut: float
    left: "Split | float"
    right: "Split | float"


@dataclass(frozen=True)
class Compiled:
    """The margin is ``bias`` plus weighted columns plus weighted trees; ``says`` tells class 1 by the margin."""

    bias: float
    weights: dict[str, float]
    trees: tuple[tuple[float, Split | float], ...]
    says: str

    @property
    def reads(self) -> list[str]:
        """Columns the model looks at, in their order of first use."""
        found = dict.fromkeys(self.weights)
        for _, tree in self.trees:
            waiting = [tree]
            while waiting:
                node = waiting.pop()
                if isinstance(node, Split):
                    found[node.column] = None
                    waiting += [node.right, node.left]
        return list(found)

    def margin_sql(self, quote: str = "`") -> str:
        terms = [_number(self.bias)]
        terms += [f"{_number(w)} * {_name(c, quote)}" for c, w in self.weights.items()]
        terms += [f"{_number(w)} * {_tree_sql(tree, quote)}" for w, tree in self.trees]
        return " + ".join(terms)

    def prediction_sql(self, quote: str = "`") -> str:
        missing = " or ".join(f"{_name(c, quote)} is null" for c in self.reads)
        skip = f"when {missing} then null " if missing else ""
        return f"case {skip}when {self.says.format(margin=self.margin_sql(quote))} then 1 else 0 end"

    def prediction(self) -> Column:
        return F.expr(self.prediction_sql()).cast("int")


def _number(v: float) -> str:
    text = repr(float(v))
    return f"({text if 'e' in text else text + 'e0'})"


def _name(column: str, quote: str) -> str:
    return f"{quote}{column.replace(quote, quote * 2)}{quote}"


def _tree_sql(node: Split | float, quote: str) -> str:
    if not isinstance(node, Split):
        return _number(node)
    test = f"{_name(node.column, quote)} {node.test} {_number(node.cut)}"
    return f"(case when {test} then {_tree_sql(node.left, quote)} else {_tree_sql(node.right, quote)} end)"


def compile_model(model, features: list[str], most_nodes: int = MOST_NODES) -> Compiled | None:
    """The model over the columns its vector was assembled from; None for other kinds and for ensembles beyond ``most_nodes``."""
    if isinstance(model, LogisticRegressionModel) and model.numClasses == 2:
        # through the logistic function, as the model does, so that ties at the threshold fall alike
        says = f"1.0e0 / (1.0e0 + exp(-({{margin}}))) > {_number(model.getThreshold())}"
        return _linear(model, features, says)
    if isinstance(model, LinearSVCModel):
        return _linear(model, features, f"{{margin}} > {_number(model.getThreshold())}")
    if isinstance(model, BoostedModel):
        if len(model.trees.feature) > most_nodes:
            return None
        return Compiled(0.0, {}, tuple((1.0, _boosted_tree(model, int(root), features)) for root in model.trees.start), "{margin} > 0")
    if isinstance(model, GBTClassificationModel):
        if model.totalNumNodes > most_nodes:
            return None
        trees = tuple((w, _spark_tree(t._java_obj.rootNode(), features)) for w, t in zip(model.treeWeights, model.trees))
        return Compiled(0.0, {}, trees, "{margin} > 0")
    return None


def _linear(model: Model, features: list[str], says: str) -> Compiled:
    weights = {c: float(w) for c, w in zip(features, model.coefficients.toArray(), strict=True)}
    return Compiled(float(model.intercept), {c: w for c, w in weights.items() if w}, (), says)


def _boosted_tree(model: BoostedModel, at: int, features: list[str]) -> Split | float:
    t = model.trees
    if t.feature[at] < 0:
        return float(t.value[at])
    left = int(t.left[at])
    sides = (_boosted_tree(model, left, features), _boosted_tree(model, left + 1, features))
    return Split(features[int(t.feature[at])], "<", float(t.cut[at]), *sides)


def _spark_tree(node, features: list[str]) -> Split | float:
    """Splits are numeric: encoded columns carry no nominal attributes."""
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    sides = (_spark_tree(node.leftChild(), features), _spark_tree(node.rightChild(), features))
    return Split(features[split.featureIndex()], "<=", split.threshold(), *sides)
