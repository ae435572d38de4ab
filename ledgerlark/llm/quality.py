"""Quality rules by weak supervision, in DataFrame and SQL functions alone.

Rules vote good (1), bad (-1) or abstain (0) on each document. Votes are counted by pattern,
of which there are at most 3 ** rules, and expectation-maximisation over those counts
estimates how often each rule votes either way, or abstains, on good and on bad documents
(Dawid and Skene's model). A document is kept when its posterior probability of being good
is high enough, so no single rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.common import table, words, written

MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
THRESHOLD = 0.5
ITERATIONS = 25
#: Added to each vote's expected count, so that an unseen vote keeps a small probability.
SMOOTHING = 1.0

_FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: name: (votes bad when, votes good when), over the features; between the two a rule abstains. The
#: fixed values are thresholds. Rules overlap on purpose: how far a vote can be trusted is told by how
#: often the others agree with it.
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words < 80", "n_words >= 150"),
    "word_length": (
        "word_chars < 3 * n_words OR word_chars > 10 * n_words",
        "2 * word_chars >= 7 * n_words AND word_chars <= 8 * n_words AND n_words > 0",
    ),
    "symbols": ("40 * n_symbols > n_words", "100 * n_symbols <= n_words AND n_words > 0"),
    "symbol_density": ("60 * n_symbols > word_chars", "400 * n_symbols <= word_chars AND n_words > 0"),
    "repetition": ("3 * n_repeat_words > n_words", "6 * n_repeat_words <= n_words AND n_words > 0"),
    "vocabulary": (
        "2 * n_dup_lines > n_lines OR (n_words BETWEEN 100 AND 2000 AND 5 * n_distinct < n_words)",
        "4 * n_dup_lines <= n_lines AND (n_words > 1000 OR 4 * n_distinct >= n_words) AND n_words > 0",
    ),
    "case": ("3 * n_upper > word_chars", "10 * n_upper <= word_chars AND n_words > 0"),
    "sentences": ("3 * n_stops > n_words OR 200 * n_stops < n_words", "50 * n_stops >= n_words AND 4 * n_stops <= n_words AND n_words > 0"),
}


def _count(characters: str) -> Column:
    """How many characters of a class the text has."""
    return F.length(F.regexp_replace("_t", f"[^{characters}]+", "")).cast("long")


def features(documents: DataFrame) -> DataFrame:
    """The rows of documents with the features of their whole texts in one struct, _f.

    word_chars: code points in words; n_symbols: characters of SYMBOLS; n_dup_lines: lines
    with a word that equal an earlier line; n_repeat_words: words in three-word windows that
    occur twice or more, the first included. A null or empty text has zeros.
    """
    # A window's hash sits above its place in one long, so that sorting plain longs brings equal
    # windows together; the words themselves are compared before windows count as equal.
    packed = "array_sort(transform(h, (x, i) -> shiftleft(x, b) | CAST(i AS BIGINT)))"
    same = " AND ".join(f"w[CAST(x & m AS INT) + {i}] = w[CAST(y & m AS INT) + {i}]" for i in range(3))
    found = (
        "filter(zip_with(slice(p, 1, size(p) - 1), slice(p, 2, size(p) - 1), (x, y) -> "
        f"CASE WHEN shiftright(x, b) = shiftright(y, b) AND {same} "
        "THEN array(x & m, (x & m) + 1, (x & m) + 2, y & m, (y & m) + 1, (y & m) + 2) END), v -> v IS NOT NULL)"
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashes = (
        "CASE WHEN size(w) >= 4 THEN transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) "
        "ELSE array() END"
    )
    # exploding one element keeps the optimizer from computing it again for each use
    once = lambda c: F.explode(F.array(c))
    return (
        # the rows' own columns wait in a struct, so that none can have a name used here
        documents.select(F.struct("*").alias("_doc"), text.alias("_t"))
        .withColumn("_s", once(F.struct(words(F.col("_t")).alias("w"), lines.alias("l"))))
        .withColumns({"w": F.col("_s.w"), "_lines": F.col("_s.l")})
        .withColumn("h", once(F.expr(hashes)))
        .withColumn("b", F.expr("CAST(ceil(log2(size(w) + 1)) AS INT)"))
        .withColumn("m", F.expr("shiftleft(1L, b) - 1"))
        # most texts repeat no window, which the set of their hashes tells at little cost
        .withColumn("p", once(F.expr(f"CASE WHEN size(array_distinct(h)) < size(h) THEN {packed} ELSE array() END")))
        .withColumn(
            "_again",
            F.expr(f"CASE WHEN size(p) = 0 THEN 0L ELSE CAST(size(array_distinct(flatten({found}))) AS BIGINT) END"),
        )
        .withColumn(
            "_f",
            F.struct(
                F.size("w").cast("long").alias("n_words"),
                F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
                _count(SYMBOLS).alias("n_symbols"),
                (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                F.col("_again").alias("n_repeat_words"),
                F.size("_lines").cast("long").alias("n_lines"),
                _count(r"\p{Lu}").alias("n_upper"),
                _count(".!?").alias("n_stops"),
                F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
            ),
        )
        .select("_doc.*", "_f")
    )


def votes(feature: str = "_f") -> Column:
    """The rules' votes on the features in a struct column, as an array of -1, 0 and 1."""

    def one(bad: str, good: str) -> str:
        for name in [*_FEATURES, "n_lines", "n_upper", "n_stops", "n_distinct"]:
            bad, good = (
                x.replace(name, f"{feature}.{name}") if f"{feature}.{name}" not in x else x for x in (bad, good)
            )
        return f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END"

    return F.expr(f"array({', '.join(one(*r) for r in RULES.values())})")


def posteriors(patterns: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """From vote patterns (votes, n): votes and posterior, by expectation-maximisation.

    It starts in doubt about documents with one bad vote and against those with several. At most
    3 ** rules patterns meet in one row, whatever the number of documents, and the iterations
    are one SQL aggregate.
    """
    r = len(RULES)
    bad = "size(filter(p.votes, v -> v = -1))"
    start = f"transform(pats, p -> CASE {bad} WHEN 0 THEN 0.9D WHEN 1 THEN 0.5D ELSE 0.1D END)"

    def likelihood(weight: str) -> str:
        # of each rule's three votes under one class, smoothed, in rule-major order
        total = f"aggregate(z, 0D, (s, x) -> s + x.p.n * {weight})"
        one = (
            f"aggregate(z, {SMOOTHING}D, (s, x) -> s + CASE WHEN x.p.votes[CAST(t DIV 3 AS INT)] = t % 3 - 1 "
            f"THEN x.p.n * {weight} ELSE 0D END)"
        )
        return f"transform(sequence(0, {3 * r - 1}), t -> ln({one} / ({total} + {3 * SMOOTHING}D)))"

    zipped = "transform(pats, (p, i) -> named_struct('p', p, 'w', acc[i]))"
    prior = (
        "ln((aggregate(z, 1D, (s, x) -> s + x.p.n * x.w)) / (aggregate(z, 1D, (s, x) -> s + x.p.n * (1 - x.w))))"
    )
    # each transform over a one-element array names a value, so that it is computed once
    model = (
        f"transform(array({zipped}), z -> named_struct('o', {prior}, "
        f"'g', {likelihood('x.w')}, 'b', {likelihood('(1 - x.w)')}))[0]"
    )
    odds = (
        f"e.o + aggregate(sequence(0, {r - 1}), 0D, (s, j) -> "
        "s + e.g[j * 3 + p.votes[j] + 1] - e.b[j * 3 + p.votes[j] + 1])"
    )
    step = f"transform(array({model}), e -> transform(pats, p -> 1D / (1D + exp(-({odds})))))[0]"
    fitted = f"aggregate(sequence(1, {iterations}), {start}, (acc, it) -> {step})"
    return (
        patterns.select(F.struct("votes", F.col("n").cast("double").alias("n")).alias("p"))
        .agg(F.array_sort(F.collect_list("p")).alias("pats"))
        .withColumn("w", F.expr(fitted))
        .select(F.explode(F.arrays_zip("pats", "w")).alias("x"))
        .select(F.col("x.pats.votes").alias("_votes"), F.col("x.w").alias("_posterior"))
    )


def judge(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents with the struct _f of features, _base_failed, _posterior and _kept.

    _base_failed: under MIN_WORDS words, or over half of them in repeated windows; such rows are
    never kept. The texts are read once, and the rows with their votes written for the second
    look; nothing but the counts of vote patterns is shuffled. Null texts count as empty,
    repeated rows as rows of their own; columns of any other name pass through. An empty table
    gives an empty result.
    """
    return _judged(features(documents), threshold)


def _judged(rows: DataFrame, threshold: float) -> DataFrame:
    voted = written(rows.withColumn("_votes", votes()), "votes")
    counts = voted.groupBy(F.col("_votes").alias("votes")).agg(F.count(F.lit(1)).alias("n"))
    failed = F.expr(f"_f.n_words < {MIN_WORDS} OR 100 * _f.n_repeat_words > 50 * _f.n_words")
    return (
        voted.join(F.broadcast(posteriors(counts)), "_votes", "left")
        .drop("_votes")
        .withColumn("_base_failed", failed)
        .withColumn("_kept", ~F.col("_base_failed") & (F.coalesce(F.col("_posterior"), F.lit(0.0)) >= threshold))
    )


def op9_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _judged(features(docs).drop("text"), THRESHOLD).select(
        "doc_id",
        *[F.col(f"_f.{c}").alias(c) for c in _FEATURES],
        F.col("_base_failed").alias("base_failed"),
        F.col("_kept").alias("kept"),
    )
