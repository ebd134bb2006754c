"""Quality classifier: a sparse ensemble of rules taken from trees, weighted by lasso logistic regression."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import sampled_texts, written
from rillwork.llm.quality_rules import THRESHOLDS, ratios
from rillwork.llm.text_stats import counts

STATISTICS = [*(name for _, name, _, _ in THRESHOLDS), "n_words", "n_lines", "n_symbols"]


@dataclass(frozen=True)
class RuleParams:
    """max_labelled bounds the rows that trees and weights are fitted on, chosen by the hash of their id."""

    max_labelled: int = 40_000
    trees: int = 12
    depth: int = 3
    lasso: float = 2e-3
    seed: int = 3


#: A condition: (statistic, "<=" or ">", bound).
Rule = tuple[tuple[str, str, float], ...]


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    out = counts(docs, keep)
    return out.select(*keep, *[c.cast("double").alias(k) for k, c in ratios().items()], *[F.col(c).cast("double").alias(c) for c in ("n_words", "n_lines", "n_symbols")])


def rules_of(debug: str, names: list[str]) -> set[Rule]:
    """Every path from a root to a node of the printed trees, as a conjunction with one bound per side."""
    out: set[Rule] = set()
    path: list[tuple[int, tuple[str, str, float]]] = []
    for line in debug.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-\d.Ee]+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        path = [x for x in path if x[0] < depth] + [(depth, (names[int(m[2])], m[3], float(m[4])))]
        bounds: dict[tuple[str, str], float] = {}
        for _, (name, op, value) in path:
            old = bounds.get((name, op))
            bounds[name, op] = value if old is None else (min if op == "<=" else max)(old, value)
        out.add(tuple(sorted((n, op, v) for (n, op), v in bounds.items())))
    return out


def compiled(rule: Rule) -> Column:
    """A rule as 0.0 or 1.0."""
    c = F.lit(True)
    for name, op, value in rule:
        c = c & (F.col(name) <= value if op == "<=" else F.col(name) > value)
    return c.cast("double")


@dataclass
class RuleModel:
    rules: list[tuple[Rule, float]]
    intercept: float

    def probability(self) -> Column:
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            total = total + F.lit(float(weight)) * compiled(rule)
        return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, p: RuleParams | None = None) -> RuleModel:
    """Trees over the statistics of the documents (doc_id, text) that ``labels`` (doc_id, label) marks; their paths
    become 0/1 columns of a lasso logistic regression.

    Labels other than 0 and 1 say nothing. With one class only, or none, there is no rule: every text scores the share of label 1 (0.5 without labels).
    """
    p = p or RuleParams()
    known = labels.where("label in (0, 1)")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = p.max_labelled / max(1, sum(sizes.values()))
    data = written(statistics(sampled_texts(docs, known, dict.fromkeys(sizes, share), 2 * p.max_labelled, p.seed), ["label"]))
    shares = {r["label"]: r["count"] for r in data.groupBy("label").count().collect()}
    if len(shares) < 2:
        return RuleModel([], 0.0 if not shares else (20.0 if 1 in shares else -20.0))
    vector = data.select(F.col("label").cast("double").alias("label"), array_to_vector(F.array(*STATISTICS)).alias("features"), *STATISTICS)
    forest = RandomForestClassifier(numTrees=p.trees, maxDepth=p.depth, maxBins=64, seed=p.seed, featureSubsetStrategy="0.5").fit(vector)
    rules = sorted(rules_of(forest.toDebugString, STATISTICS))
    if not rules:
        return RuleModel([], 0.0)
    coded = vector.select("label", array_to_vector(F.array(*[compiled(r) for r in rules])).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=p.lasso, maxIter=40, standardization=False).fit(coded)
    weights = lasso.coefficients.toArray().tolist()
    return RuleModel([(r, w) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-9], float(lasso.intercept))


def score(docs: DataFrame, model: RuleModel, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the probability of label 1 of every row's whole text, all in built-in functions.

    Null and empty texts have statistics of zero and a score like any other; repeated rows stay; other columns are
    ignored; an empty table gives no row.
    """
    return statistics(docs, keep).select(*keep, model.probability().alias("score"))
