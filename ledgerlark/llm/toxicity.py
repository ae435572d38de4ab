"""Toxicity from a lexicon trie met by Levenshtein automata, with quotation told from abuse.

The lexicon is learned from labelled documents: words, and beginnings of words, that toxic
documents hold far more often than chance allows. Scoring walks each distinct word's
Levenshtein automaton through the lexicon's trie, so misspelled terms count too; a window of
words around each hit tells whether it is quoted or reported, and a logistic model weighs both.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.common import table, written

#: Labelled rows that the lexicon and the model are fitted on, at most; by hash of the id.
MAX_TRAINING_ROWS = 20_000
#: Every n-th id by checksum is held out from learning.
HELD_OUT = 5
#: Words on each side of a hit that decide whether it is quoted.
CONTEXT = 6
#: Shortest term that a misspelling may differ from, in one place.
FUZZY_LENGTH = 5
_STEMS = (4, 5)

#: Marks of quotation and words that report speech.
QUOTES = "\"“”„«»‹›"
REPORTING = frozenset(
    "said says wrote writes quoted quote called calls word term sagte sagt schrieb nannte zitat wort "
    "dit disait écrit citation mot appelé dijo dice escribió llamó cita palabra".split()
)

_TOKEN = re.compile(rf"\w+|[{QUOTES}]")


def _terms(text: str) -> set[str]:
    """The distinct words of a text and, with a star, their beginnings."""
    seen = {w for w in _TOKEN.findall(text.lower()) if len(w) > 2}
    return seen | {f"{w[:k]}*" for w in seen for k in _STEMS if len(w) >= k}


class Lexicon:
    """A trie of weighted terms; terms that end in a star match every word they begin."""

    def __init__(self, weights: dict[str, float], memo: int = 300_000):
        self.root: dict = {}
        for term, weight in weights.items():
            node = self.root
            for c in term.removesuffix("*"):
                node = node.setdefault(c, {})
            node["*" if term.endswith("*") else ""] = weight
        self.memo: dict[str, tuple[float, bool] | None] = {}
        self.limit = memo

    def look_up(self, word: str) -> tuple[float, bool] | None:
        """(weight, spelled as in the lexicon) of the best term for a word, if any."""
        if word not in self.memo:
            if len(self.memo) >= self.limit:
                self.memo.clear()
            self.memo[word] = self._walk(word)
        return self.memo[word]

    def _walk(self, word: str) -> tuple[float, bool] | None:
        node, best = self.root, None
        for k, c in enumerate(word):
            node = node.get(c)
            if node is None:
                break
            if "*" in node:
                best = max(best or 0.0, node["*"])
        else:
            if "" in node:
                best = max(best or 0.0, node[""])
        if best is not None:
            return best, True
        n = len(word)
        if n < FUZZY_LENGTH - 1:
            return None
        # states of the automaton for one edit: (trie node, place in the word, edits made, depth)
        todo = [(self.root, 0, 0, 0)]
        while todo:
            node, i, edits, depth = todo.pop()
            if n - i + edits <= 1 and depth >= FUZZY_LENGTH and "" in node:
                best = max(best or 0.0, node[""])
            if edits:
                nxt = node.get(word[i]) if i < n else None
                if nxt is not None:
                    todo.append((nxt, i + 1, 1, depth + 1))
                continue
            if i < n:
                todo.append((node, i + 1, 1, depth))  # a letter too many
            for c, nxt in node.items():
                if len(c) != 1 or c == "*":
                    continue
                if i < n and c == word[i]:
                    todo.append((nxt, i + 1, 0, depth + 1))
                else:
                    todo.append((nxt, i, 1, depth + 1))  # a letter left out
                    if i < n:
                        todo.append((nxt, i + 1, 1, depth + 1))  # another letter
        return None if best is None else (best, False)

    def features(self, text: str) -> list[float]:
        tokens = _TOKEN.findall(text.lower())
        look_up = self.look_up
        hits = [(i, found) for i, w in enumerate(tokens) if (found := look_up(w))]
        if not hits:
            return [0.0] * N_FEATURES
        marks = np.cumsum([t in QUOTES for t in tokens]) if any(q in text for q in QUOTES) else None
        direct = quoted = fuzzy = strongest = 0.0
        distinct = set()
        for i, (weight, spelled) in hits:
            near = tokens[max(0, i - CONTEXT) : i + CONTEXT + 1]
            inside = marks is not None and marks[i] % 2 == 1 and marks[-1] > marks[i]
            if inside or not REPORTING.isdisjoint(near):
                quoted += 1
                continue
            direct += weight
            strongest = max(strongest, weight)
            fuzzy += not spelled
            distinct.add(tokens[i])
        return [
            math.log1p(direct), strongest, math.log1p(len(distinct)), math.log1p(fuzzy), math.log1p(quoted),
            100.0 * len(hits) / len(tokens),
        ]


N_FEATURES = 6


def _is_held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % HELD_OUT == 0, F.lit(False))


def training_rows(documents: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """doc_id, text, toxic of at most `most` labelled documents that aren't held out.

    Of several texts of one doc_id the one of least hash is taken, whatever order tasks end in.
    """
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .filter(~_is_held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text"))
    return texts.groupBy("doc_id").agg(one.alias("text"), F.first("toxic").alias("toxic"))


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Terms with their log odds, from training rows that hold at most MAX_TRAINING_ROWS.

    Every term stays for which so many toxic documents among those that hold it can't be chance,
    given how many terms are as frequent; the training rows bound how many these are.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic: Counter[str] = Counter()
            clean: Counter[str] = Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if label else clean).update(_terms(text))
            names = list(toxic | clean)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array([toxic[t] for t in names]), pa.array([clean[t] for t in names])],
                names=["term", "toxic", "clean"],
            )

    totals = rows.agg(F.sum(F.col("toxic")), F.count(F.lit(1))).first()
    p, n = totals[0] or 0, totals[1]
    if not 0 < p < n:
        return {}
    base = p / n
    terms = (
        rows.select("text", "toxic")
        .mapInArrow(count, "term string, toxic long, clean long")
        .groupBy("term")
        .agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
        .filter("a + b >= 3")
    )
    share = F.col("a") / (F.col("a") + F.col("b"))
    rest = F.when(F.col("b") > 0, F.col("b") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    evidence = F.when(share > base, F.col("a") * F.log(share / base) + rest).otherwise(0.0)
    scored = written(terms.withColumn("evidence", evidence).withColumn("df", F.col("a") + F.col("b")), "terms")
    frequent = sorted((r[0], r[1]) for r in scored.groupBy("df").count().collect())  # at most a row for each count of rows
    found = scored.filter("evidence >= 6").orderBy(F.desc("evidence"), "term").collect()
    dfs = np.array([x for x, _ in frequent])
    as_frequent = np.cumsum([x for _, x in frequent][::-1])[::-1]
    out: dict[str, float] = {}
    for r in found:
        if r.evidence >= math.log(as_frequent[np.searchsorted(dfs, r.df)]) + 1:
            out[r.term] = math.log((r.a + 0.5) / (p + 1)) - math.log((r.b + 0.5) / (n - p + 1))
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, the intercept last, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _featured(rows: DataFrame, lexicon: dict[str, float], model: list[float] | None) -> DataFrame:
    """keep, then the features or, with a model, the score of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lexicon(lexicon)
        for batch in batches:
            values = [lookup.features(text.as_py() or "") for text in batch.column(1)]
            if model is not None:
                z = np.array(values, float).reshape(-1, N_FEATURES) @ np.array(model[:-1]) + model[-1]
                column = pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())
            else:
                column = pa.array(values, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), column], names=["keep", "value"])

    kind = "array<double>" if model is None else "double"
    return rows.mapInArrow(run, f"keep long, value {kind}")


def score_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Learns from the labels of documents that aren't held out, MAX_TRAINING_ROWS of them at most,
    and reads only texts when it scores. Null and empty texts have no hits and get the model's
    base score. A document with several labels is toxic if one says so. Without toxic and clean
    training rows the score is the share of toxic ones, or 0. Repeated documents are rows of
    their own; a null doc_id isn't held out.
    """
    train = written(training_rows(documents, labels), "toxic-train")
    lexicon = learn_lexicon(train)
    rows = _featured(train.select("toxic", "text"), lexicon, None).collect()  # at most MAX_TRAINING_ROWS
    y = np.array([r[0] for r in rows], float)
    if 0 < y.sum() < len(y):
        model = fit_logistic(np.array([r[1] for r in rows], float), y).tolist()
    else:
        model = [0.0] * N_FEATURES + [30.0 if len(y) and y[0] else -30.0]
    scored = _featured(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lexicon, model)
    return scored.select(F.col("keep").alias("doc_id"), F.col("value").alias("score")).select(
        "doc_id", _is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op6_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
