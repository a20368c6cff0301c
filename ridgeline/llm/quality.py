"""Quality rules combined by weak supervision.

Each rule votes good (+1), bad (-1) or abstains (0) from text statistics, and no
two rules from one statistic, as votes count as independent given the text.  Vote
vectors are counted over the whole corpus - at most 3**len(RULES) of them,
however large it is - and expectation-maximisation estimates, without labels,
how often each rule votes each way on good and on bad texts.  The posterior
probability of a good text then replaces a conjunction of filters.

Statistics, votes and posteriors are DataFrame expressions; the driver only
runs the iteration over the counted vote vectors.

Defined results: a null or empty text has no words; an empty table gives an
empty table; every row is judged by its own text, a very long one as a whole,
so repeated ids and rows do not matter; a posterior equal to the bound is kept.
Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import result

GAP = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
#: Hash of a window of three words, by those of the words.
WINDOW = "xxhash64(h[i], h[i + 1], h[i + 2])"


@dataclass(frozen=True)
class Rule:
    """``bad`` and ``good`` are SQL conditions over the statistics; a text that
    meets neither gets no vote."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("length", f"n_words < {MIN_WORDS}", "n_words >= 80"),
    Rule("word_length", "word_chars < 2.5 * n_words OR word_chars > 10 * n_words", "word_chars BETWEEN 3 * n_words AND 8 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0 AND n_lines > 2"),
    Rule("repeated_words", "10 * n_repeat_words > 3 * n_words", "20 * n_repeat_words <= n_words"),
    Rule("line_ends", "5 * n_ended < n_lines", "10 * n_ended >= 8 * n_lines AND n_lines > 0"),
    Rule("variety", "10 * n_distinct < n_words", "3 * n_distinct > n_words"),
    Rule("digits", "5 * n_digits > word_chars", "50 * n_digits <= word_chars"),
)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole-text counts that the rules use, one row per row of ``docs``."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.array_remove(F.split(text, GAP), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda l: l.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).alias("n_symbols"),
        F.length(F.regexp_replace(text, r"[^0-9]+", "")).alias("n_digits"),
    )
    hashed = base.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    grams = hashed.withColumn(
        "g", F.expr(f"CASE WHEN size(h) >= 3 THEN transform(sequence(0, size(h) - 3), i -> {WINDOW}) END")
    )
    # only texts with two windows of one hash sort theirs, by hash and then words,
    # so that windows count as equal by their words alone
    window = "struct(x AS x, array(words[i], words[i + 1], words[i + 2]) AS w, i AS i)"
    ranked = grams.withColumn("p", F.expr(f"CASE WHEN size(array_distinct(g)) < size(g) THEN sort_array(transform(g, (x, i) -> {window})) END"))
    again = ranked.withColumn(
        "at",
        F.expr(
            "sort_array(transform(filter(p, (e, j) -> (j > 0 AND p[greatest(j - 1, 0)].w = e.w) "
            "OR (j < size(p) - 1 AND p[least(j + 1, size(p) - 1)].w = e.w)), e -> e.i))"
        ),
    )
    repeat = F.expr(
        "aggregate(at, named_struct('n', 0L, 'upto', 0), (a, i) -> "
        "named_struct('n', a.n + i + 3 - greatest(i, a.upto), 'upto', i + 3), a -> a.n)"
    )
    count = lambda c: F.size(c).cast("long")
    return again.select(
        "id",
        count("words").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (count("lines") - count(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.coalesce(repeat, F.lit(0)).cast("long").alias("n_repeat_words"),
        count("lines").alias("n_lines"),
        count(F.filter("lines", lambda l: l.rlike(r"[.!?:;\"'’”)][\x20\x09-\x0D]*$"))).alias("n_ended"),
        count(F.array_distinct("words")).alias("n_distinct"),
        F.col("n_digits").cast("long").alias("n_digits"),
    )


def vote(rule: Rule) -> Column:
    return F.when(F.expr(rule.bad), -1).when(F.expr(rule.good), 1).otherwise(0)


@dataclass(frozen=True)
class LabelModel:
    """Log-odds of a good text: ``prior`` plus, per rule, a weight per vote."""

    prior: float
    weights: tuple[dict[int, float], ...]

    def probability(self, votes: list[Column]) -> Column:
        logit = F.lit(self.prior)
        for v, w in zip(votes, self.weights):
            logit = logit + F.when(v < 0, w[-1]).when(v > 0, w[1]).otherwise(w[0])
        return 1 / (1 + F.exp(-logit))


def fit(counts: list[tuple[tuple[int, ...], int]], rounds: int = 100, trust: float = 0.02) -> LabelModel:
    """Expectation-maximisation over counted vote vectors.

    Every rule starts with accuracy 0.7; ``trust`` is the share of the corpus
    that is added as imagined votes of that accuracy, which keeps the meaning
    of good and bad from swapping and rare votes from extreme weights.
    """
    n_rules = len(counts[0][0]) if counts else len(RULES)
    total = sum(n for _, n in counts) or 1
    unsure, right = trust * total + 1, 0.7
    prior = 0.5
    start = {1: {1: right, -1: 1 - right, 0: 1.0}, 0: {1: 1 - right, -1: right, 0: 1.0}}
    table = [{y: dict(p) for y, p in start.items()} for _ in range(n_rules)]
    for _ in range(rounds):
        mass = [{y: {v: unsure * start[y][v] / 2 for v in (1, -1, 0)} for y in (0, 1)} for _ in range(n_rules)]
        good = 0.0
        for votes, n in counts:
            logit = math.log(prior / (1 - prior)) + sum(math.log(t[1][v] / t[0][v]) for t, v in zip(table, votes))
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, logit))))
            good += n * p
            for m, v in zip(mass, votes):
                m[1][v] += n * p
                m[0][v] += n * (1 - p)
        new = (good + unsure / 2) / (total + unsure)
        table = [{y: {v: m[y][v] / sum(m[y].values()) for v in (1, -1, 0)} for y in (0, 1)} for m in mass]
        done = abs(new - prior) < 1e-7
        prior = new
        if done:
            break
    return LabelModel(math.log(prior / (1 - prior)), tuple({v: math.log(t[1][v] / t[0][v]) for v in (1, -1, 0)} for t in table))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Statistics, ``base_failed``, ``quality`` (posterior) and ``kept``.

    The base fails texts under 50 words or with over half of their words in
    repeated three-word windows; these are never kept.
    """
    drawn = result(statistics(docs, id_col, text_col))
    names = [f"v{i}" for i in range(len(RULES))]
    voted = drawn.select("*", *[vote(r).cast("int").alias(n) for r, n in zip(RULES, names)])
    counts = voted.groupBy(*names).count().collect()
    model = fit([(tuple(r[n] for n in names), r["count"]) for r in counts])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = voted.withColumn("quality", model.probability([F.col(n) for n in names])).withColumn("base_failed", failed)
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & (F.col("quality") >= least)).alias("kept"), "quality",
        F.array(*names).alias("votes"),
    )
