"""Quality rules: robust multivariate outliers per language and source.

Each document becomes a vector of transformed statistics: mean word length, and
the square roots of its symbol, repeated-line and repeated-word shares. For each
(lang, source) the minimum covariance determinant of three quarters of the
vectors is sought by concentration steps from two deterministic starts, the
coordinate medians and the plain moments, each until its determinant falls no more; the
start that ends with the smaller determinant gives centre and scatter. A document is rejected if its squared
Mahalanobis distance passes the 0.9999 quantile of chi-squared.

All of it is DataFrame work. A step sums moments per (group, start, distance
bin): bins are few, so a hot group is folded on the map side. The subset is the lowest
bins that hold three quarters; the last of them counts by the share of it that is needed, so
that every subset has the same size, however many rows tie, and determinants can be
compared. Shares are mostly zero, so each variance gets a floor, a parameter (a regularised
determinant), which also keeps the matrices of small or constant groups invertible. With
these floors no single share can reject a document that passes the base rules by a
repeated-word share alone; several together can.

Defined results: null and empty texts have zero counts and fail the base rules;
null lang and source form groups of their own; documents that fail the base
rules are not part of any estimate; very long texts are counted whole; ties in distance
share a bin; repeated rows count once each; an empty table gives an empty result. Columns
that are not kept are not read; kept ones may not be called like a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulary.llm.arrowmap import written

SPACE = r"[\x20\x09-\x0D]+"
VECTOR = ("x0", "x1", "x2", "x3")
#: Variance floor of each coordinate: what varies less than this is taken to vary so much.
FLOOR = (0.16, 0.0035, 0.03, 0.03)
SUBSET = 0.75
#: A start has settled when a step lowers the logarithm of its determinant by no more than this; the most steps.
SETTLED, MOST_STEPS = 1e-6, 100
#: chi-squared with 4 degrees of freedom: quantiles 0.75 and 0.9999.
CHI2_SUBSET, CHI2_CUT = 5.385, 23.513
_BINS = 32


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words within a window of three words that occurs twice or more in the text."""

    def marked(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def count(s: Column) -> Column:
            last = F.size(s) - 1
            twin = lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(s, k + 1)["h"] == x["h"]))
            at = F.filter(F.transform(s, lambda x, k: F.when(twin(x, k), x["i"])), lambda i: i.isNotNull())
            return _let(at, lambda a: F.size(F.array_distinct(F.flatten(F.array(a, F.transform(a, lambda i: i + 1), F.transform(a, lambda i: i + 2))))))

        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(_let(pairs, count))

    grams = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(_let(grams(words), marked))


def text_counts(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of a text."""
    clean = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(clean, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def made(words: Column) -> Column:
        return _let(lines, lambda ln: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(clean, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.size(ln).cast("long").alias("n_lines"),
            (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
        ))

    return _let(F.filter(F.split(clean, SPACE), lambda x: x != ""), made)


def with_statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keep`` columns, the counts of ``text_counts``, base_failed and the vector x0 .. x3."""
    d = docs.select(*keep, text_counts(F.col(text_col)).alias("__c")).select(*keep, "__c.*")
    share = lambda a, b: F.sqrt(F.least(F.col(a) / F.greatest(F.col(b), F.lit(1)), F.lit(1.0)))
    return d.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "x0": F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
        "x1": share("n_symbols", "word_chars"),
        "x2": share("n_dup_lines", "n_lines"),
        "x3": share("n_repeat_words", "n_words"),
    })


def _moments() -> list[Column]:
    first = [F.sum(x).alias(f"s{i}") for i, x in enumerate(VECTOR)]
    second = [F.sum(F.col(a) * F.col(VECTOR[j])).alias(f"s{i}{j}") for i, a in enumerate(VECTOR) for j in range(i + 1)]
    return [F.count("*").alias("n"), *first, *second]


def _resum() -> list[Column]:
    names = [f"s{i}" for i in range(4)] + [f"s{i}{j}" for i in range(4) for j in range(i + 1)]
    return [F.sum(F.col("n") * F.col("part")).alias("n"), *(F.sum(F.col(c) * F.col("part")).alias(c) for c in names)]


def _estimate(sums: DataFrame, keys: list[str], floor: tuple[float, ...]) -> DataFrame:
    """Centre m0 .., lower Cholesky factor c00 .. of the floored covariance, log determinant."""
    means = sums.select(*keys, "n", *((F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(4)), *(f"s{i}{j}" for i in range(4) for j in range(i + 1)))
    cov = {}
    for i in range(4):
        for j in range(i + 1):
            cov[f"v{i}{j}"] = F.col(f"s{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}") + F.lit(floor[i] if i == j else 0.0)
    out = means.withColumns(cov)
    for j in range(4):
        inner = lambda i, j: sum((F.col(f"c{i}{k}") * F.col(f"c{j}{k}") for k in range(j)), F.lit(0.0))
        out = out.withColumn(f"c{j}{j}", F.sqrt(F.greatest(F.col(f"v{j}{j}") - inner(j, j), F.lit(1e-9))))
        for i in range(j + 1, 4):
            out = out.withColumn(f"c{i}{j}", (F.col(f"v{i}{j}") - inner(i, j)) / F.col(f"c{j}{j}"))
    det = sum((F.log(f"c{j}{j}") for j in range(4)), F.lit(0.0))
    return out.select(*keys, *(f"m{i}" for i in range(4)), *(f"c{i}{j}" for i in range(4) for j in range(i + 1)), det.alias("log_det"))


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    y: list[Column] = []
    for i, x in enumerate(VECTOR):
        rest = sum((F.col(f"c{i}{k}") * y[k] for k in range(i)), F.lit(0.0))
        y.append((F.col(x) - F.col(f"m{i}") - rest) / F.col(f"c{i}{i}"))
    return sum((v * v for v in y), F.lit(0.0))


def _near(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Join on null-safe equality of ``keys``, keeping those of ``a``."""
    other = b.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in b.columns if c not in keys))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return a.join(other, on).drop(*(f"__{k}" for k in keys))


def _medians(rows: DataFrame, keys: list[str], floor: tuple[float, ...]) -> DataFrame:
    """Start from coordinate medians (by bins of a hundredth), with the floors as scatter."""
    long = rows.select(*keys, F.inline(F.array(*(F.struct(F.lit(i).alias("i"), F.round(F.col(x) * 100).alias("b")) for i, x in enumerate(VECTOR)))))
    at = long.groupBy(*keys, "i").agg((F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY b)") / 100).alias("m"))
    wide = at.groupBy(*keys).agg(*(F.max(F.when(F.col("i") == i, F.col("m"))).alias(f"m{i}") for i in range(4)))
    chol = [F.lit(floor[i] ** 0.5 if i == j else 0.0).alias(f"c{i}{j}") for i in range(4) for j in range(i + 1)]
    return wide.select(*keys, *(f"m{i}" for i in range(4)), *chol, F.lit(0.0).alias("log_det"))


def _step(rows: DataFrame, now: DataFrame, keys: list[str], floor: tuple[float, ...]) -> DataFrame:
    """One concentration step of each (group, start) of ``now``: the moments of the nearest three quarters."""
    placed = _near(rows, now.drop("log_det"), keys).withColumn("d2", _distance()).withColumn("bin", F.floor(F.log(F.col("d2") + 1e-6) * _BINS))
    sums = placed.groupBy(*keys, "start", "bin").agg(*_moments())
    w = Window.partitionBy(*keys, "start")
    ranked = sums.select("*", (F.sum("n").over(w.orderBy("bin")) - F.col("n")).alias("before"), F.sum("n").over(w).alias("all"))
    core = ranked.where(F.col("before") < SUBSET * F.col("all")).withColumn("part", F.least(F.lit(1.0), (SUBSET * F.col("all") - F.col("before")) / F.col("n")))
    return _estimate(core.groupBy(*keys, "start").agg(*_resum()), [*keys, "start"], floor)


def _settled(rows: DataFrame, starts: DataFrame, keys: list[str], floor: tuple[float, ...]) -> DataFrame:
    """Each (group, start) after as many steps as its determinant needs to fall no more.

    Groups that have settled take no part in further steps.
    """
    now, done = written(starts.withColumn("log_det", F.lit(float("inf"))), "starts"), None
    for _ in range(MOST_STEPS):
        was = now.select(*keys, "start", F.col("log_det").alias("was"))
        now = written(_near(_step(rows, now, keys, floor), was, [*keys, "start"]), "estimates")
        falls = F.col("was") - F.col("log_det") > SETTLED
        still = now.where(~falls).drop("was")
        done = still if done is None else done.unionByName(still)
        now = now.where(falls).drop("was")
        if now.isEmpty():
            break
    return done.unionByName(now)


def robust_estimates(rows: DataFrame, keys: list[str], floor: tuple[float, ...] = FLOOR) -> DataFrame:
    """Per group of ``keys``: centre, Cholesky factor, and ``scale`` of the distances; ``floor`` is added to the variances."""
    plain = _estimate(rows.groupBy(*keys).agg(*_moments()), keys, floor)
    now = _settled(rows, _medians(rows, keys, floor).withColumn("start", F.lit(0)).unionByName(plain.withColumn("start", F.lit(1))), keys, floor)
    fields = [c for c in now.columns if c not in keys and c != "log_det"]
    best = written(now.groupBy(*keys).agg(F.min(F.struct("log_det", *fields)).alias("b")).select(*keys, "b.*"), "best")
    bins = _near(rows, best, keys).groupBy(*keys, F.floor(F.log(_distance() + 1e-6) * _BINS).alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    ranked = bins.select("*", F.sum("n").over(w.orderBy("bin")).alias("upto"), F.sum("n").over(w).alias("all"))
    edge = ranked.where(F.col("upto") >= SUBSET * F.col("all")).groupBy(*keys).agg(F.min("bin").alias("bin"))
    scale = edge.select(*keys, F.greatest(F.lit(1.0), F.exp((F.col("bin") + 1) / _BINS) / CHI2_SUBSET).alias("scale"))
    return written(_near(best, scale, keys), "robust")


def judge(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source"), keys: tuple[str, ...] = ("lang", "source"),
          floor: tuple[float, ...] = FLOOR) -> DataFrame:
    """``keep`` columns with the statistics of each document, ``distance`` (squared, scaled;
    null for documents that fail the base rules) and ``kept``."""
    rows = written(with_statistics(docs, text_col, keep), "statistics")
    found = robust_estimates(rows.where("not base_failed"), list(keys), floor)
    passed = _near(rows.where("not base_failed"), found, list(keys)).select(*rows.columns, (_distance() / F.col("scale")).alias("distance"))
    failed = rows.where("base_failed").withColumn("distance", F.lit(None).cast("double"))
    return passed.unionByName(failed).withColumn("kept", F.coalesce(F.col("distance") <= CHI2_CUT, F.lit(False)))


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
