"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of whole texts are taken once, into a narrow table. Shallow trees are grown on the
labelled rows, and every path from a root becomes a rule, a conjunction of thresholds. A
logistic regression with a lasso penalty gives each rule a weight and most rules none. What
stays is one Spark column expression. Trees and weights are fitted on all labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterops.llm.frames import arrow_of, batch_of, pick, size_blocks, stored, table_rows, texts_of

TREES, DEPTH, PENALTY = 12, 3, 0.002
BATCH_CHARS = 1 << 22
STATISTICS = [
    "size", "words", "word_size", "distinct_words", "repeated_words", "lines", "distinct_lines",
    "line_words", "capitals", "digits", "stops", "marks", "symbols", "other_bytes",
]
_CAPITALS, _SMALL, _DIGITS = slice(65, 91), slice(97, 123), slice(48, 58)
_STOPS, _MARKS = np.frombuffer(b".,;:", np.uint8), np.frombuffer(b"!?", np.uint8)
_SYMBOLS = np.frombuffer(b"#$%&*+/<=>@[\\]^_{|}~", np.uint8)


def statistics_of(text: str) -> list[float]:
    """The statistics of one whole text; an empty one has zeros."""
    data = text.encode()
    words, lines = data.split(), data.split(b"\n")
    n, bytes_, rows = max(1, len(words)), max(1, len(data)), max(1, len(lines))
    signs = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    letters = max(1, int(signs[_CAPITALS].sum() + signs[_SMALL].sum()))
    return [
        float(np.log1p(len(data))), float(np.log1p(len(words))), sum(map(len, words)) / n, len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n, float(np.log1p(len(lines))), len(set(lines)) / rows, len(words) / rows,
        signs[_CAPITALS].sum() / letters, signs[_DIGITS].sum() / bytes_, signs[_STOPS].sum() / n, signs[_MARKS].sum() / n,
        signs[_SYMBOLS].sum() / n, signs[128:].sum() / bytes_,
    ]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the statistics of every row, from whole texts (null: empty)."""
    texts = texts_of(docs, id_col, text_col)
    layout = ", ".join([f"doc_id {texts.schema['doc_id'].dataType.simpleString()}", *[f"{name} double" for name in STATISTICS]])
    schema = arrow_of(texts.sparkSession.createDataFrame([], layout))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in size_blocks(table_rows(batches), lambda row: len(row[1]), BATCH_CHARS):
            yield batch_of([(doc_id, *map(float, statistics_of(text))) for doc_id, text in block], schema)

    return stored(texts.mapInArrow(measure, layout), "statistics")


Rule = tuple[tuple[str, str, float], ...]


@dataclass(frozen=True)
class Ensemble:
    """Rules with their weights, and the intercept: all that scoring needs."""

    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def score(self) -> Column:
        """Probability of label 1 as a column over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule), F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def holds(rule: Rule) -> Column:
    """A rule as a column."""
    out = F.lit(True)
    for name, sign, bound in rule:
        out = out & (F.col(name) <= bound if sign == "<=" else F.col(name) > bound)
    return out


def tree_rules(text: str, names: list[str]) -> list[Rule]:
    """Every path of a tree, from its printed form, where depth is shown by indentation."""
    path: list[tuple[int, tuple[str, str, float]]] = []
    rules: list[Rule] = []
    for line in text.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if found:
            depth = len(found[1])
            path = [(d, c) for d, c in path if d < depth] + [(depth, (names[int(found[2])], found[3], float(found[4])))]
            rules.append(_tightest(tuple(c for _, c in path)))
    return rules


def _tightest(rule: Rule) -> Rule:
    """One bound for each statistic and direction."""
    bounds: dict[tuple[str, str], float] = {}
    for name, sign, bound in rule:
        known = bounds.get((name, sign), bound)
        bounds[name, sign] = min(known, bound) if sign == "<=" else max(known, bound)
    return tuple(sorted((name, sign, bound) for (name, sign), bound in bounds.items()))


def fit(rows: DataFrame, label: str = "label", trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> Ensemble:
    """Rules and weights from rows with the statistics and a label of 0 or 1; rows with a null
    label are left out. With one label only, or no row, the score is that label's share (0.5
    without rows) for every text."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = rows.filter(F.col(label).isNotNull()).select(*STATISTICS, F.col(label).cast("double").alias("label"))
    n, ones = rows.agg(F.count("label"), F.sum("label")).first()
    if not n or ones in (0, n):
        share = min(max((ones or 0) / n if n else 0.5, 1e-6), 1 - 1e-6)
        return Ensemble((), float(np.log(share / (1 - share))))
    seen = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(rows).select("features", "label")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="0.6", minInstancesPerNode=5, seed=7).fit(seen)
    rules = sorted({rule for tree in forest.trees for rule in tree_rules(tree.toDebugString, STATISTICS)})
    names = [f"r{k}" for k in range(len(rules))]
    marked = rows.select("label", *[holds(rule).cast("double").alias(name) for rule, name in zip(rules, names, strict=True)])
    marked = VectorAssembler(inputCols=names, outputCol="features").transform(marked).select("features", "label")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60).fit(marked)
    kept = tuple((rule, float(w)) for rule, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w)
    return Ensemble(kept, float(lasso.intercept))


def labelled(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Statistics with a ``label`` for each row that has one; a document with several labels
    gets the majority's, 1 in a tie. Null ids have none."""
    each = pick(labels, doc_id=id_col, label=label_col).filter("doc_id is not null and label is not null")
    one = each.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    return stats.join(one, "doc_id")
