"""Quality rules with robust outliers: minimum-covariance-determinant estimates for each language and source.

Only DataFrame functions: the statistics, the concentration steps and the distances are columns and sums.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import fits_broadcast
from .common import stored

GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Rule before the method: too few words, or more than so many percent of them repeated.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Share of a group that the estimate rests on, steps, and how many rows its wider group's estimate counts for: a group of n rows
#: weighs n / (n + PRIOR_ROWS) against it.
SUBSET, STEPS, PRIOR_ROWS = 0.75, 4, 100
#: Rows beyond this share of the chi-square distribution are rejected.
INLIERS = 0.999
#: Least standard deviations of the transformed statistics, a twentieth of the range of a share's root and less of the others:
#: they keep the matrix regular where a statistic is the same nearly everywhere, and leave each able to reject alone.
FLOORS = {"x0": 0.1, "x1": 0.03, "x2": 0.02, "x3": 0.05, "x4": 0.05}
X = list(FLOORS)
ALL = "all"


def chi_square(x: float, d: int) -> float:
    """P(chi-square of ``d`` degrees <= x), by the series of the lower incomplete gamma function."""
    s, half = d / 2, x / 2
    term = total = 1 / s
    k = 0
    while term > 1e-17 * total:
        k += 1
        term *= half / (s + k)
        total += term
    return min(1.0, total * math.exp(s * math.log(half) - half - math.lgamma(s))) if x > 0 else 0.0


def chi_square_at(p: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, d) < p else (low, mid)
    return high


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of ``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines of whole texts.

    A window of three words is told by 64 bits of hash, among the windows of its own text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(*keep, text.alias("_t")).withColumn("_w", F.array_remove(F.split("_t", GAP), ""))
    base = base.withColumn("_n", F.size("_w")).withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.col("_n") - 2
    zipped = F.arrays_zip(*[F.slice("_w", k, n).alias(f"w{k}") for k in (1, 2, 3)])
    hashes = F.transform(zipped, lambda x: F.xxhash64(x["w1"], x["w2"], x["w3"]))
    base = base.withColumn("_h", F.when(F.col("_n") >= 3, hashes).otherwise(F.array().cast("array<bigint>")))
    # Windows in order of hash: equal ones are neighbours.
    ordered = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    base = base.withColumn("_o", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), ordered).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    m = F.size("_o")
    pairs = F.arrays_zip(F.slice("_o", 1, m - 1).alias("a"), F.slice("_o", 2, m - 1).alias("b"))
    same = F.filter(pairs, lambda p: p["a"]["h"] == p["b"]["h"])
    words = F.flatten(F.transform(same, lambda p: F.flatten(F.array(*[F.array(p[k]["i"], p[k]["i"] + 1, p[k]["i"] + 2) for k in ("a", "b")]))))
    repeated = F.when(m > 1, F.size(F.array_distinct(words))).otherwise(0)
    return base.select(
        *keep,
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def transformed() -> list[Column]:
    """Logs of sizes and roots of shares."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    shares = [F.col("n_symbols") / chars, F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), F.col("n_repeat_words") / words]
    out = [F.log(words.cast("double")), F.log(chars / words), *map(F.sqrt, shares)]
    return [c.alias(name) for c, name in zip(out, X, strict=True)]


def _distance(lower: bool) -> Column:
    """Squared distance from the group's centre ``m`` over its Cholesky factor ``l`` (or over scales alone)."""
    z: list[Column] = []
    for i, x in enumerate(X):
        rest = F.col(x) - F.col(f"m{i}")
        if lower:
            for j in range(i):
                rest = rest - F.col(f"l{i}{j}") * z[j]
        z.append(rest / F.col(f"l{i}{i}"))
    out = z[0] * z[0]
    for c in z[1:]:
        out = out + c * c
    return out


def _with_factor(groups: DataFrame, scale: float, floors: bool = True) -> DataFrame:
    """The Cholesky factor of each group's covariance times ``scale`` plus the floors, one column for each entry."""
    for i in range(len(X)):
        for j in range(i + 1):
            c = F.col(f"c{i}{j}") * scale
            if i == j and floors:
                c = F.greatest(c, F.lit(0.0)) + FLOORS[X[i]] ** 2
            for k in range(j):
                c = c - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            c = F.sqrt(F.greatest(c, F.lit(1e-9))) if i == j else c / F.col(f"l{j}{j}")
            groups = groups.withColumn(f"l{i}{j}", c)
    return groups


def estimates(rows: DataFrame, keys: Column, subset: float = SUBSET, steps: int = STEPS) -> DataFrame:
    """Centre ``m`` and factor ``l`` of every group of ``rows`` (columns X); ``keys`` is an array of the groups of a row.

    Deterministic start: the ``subset`` of a group nearest to its medians in units of the median deviation. A step takes the mean and
    covariance of the nearest ones so far and finds the nearest anew, which never raises the determinant. Nearness is
    cut at a percentile for each group, so groups of any size are sums that tasks begin.
    """
    d = len(X)
    rows = rows.select(F.explode(keys).alias("key"), *X)
    start = rows.groupBy("key").agg(F.count("*").alias("rows"), *[F.percentile_approx(x, 0.5, 2000).alias(f"m{i}") for i, x in enumerate(X)])
    start = stored(start, "medians")
    few = fits_broadcast(rows.sparkSession, start.count(), 40)

    def at(groups: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(groups) if few else groups, "key")

    spread = at(start).groupBy("key").agg(*[(1.4826 * F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, 2000) + FLOORS[x]).alias(f"l{i}{i}") for i, x in enumerate(X)])
    groups = stored(start.join(spread, "key"), "scales")
    scale = subset / chi_square(chi_square_at(subset, d), d + 2)
    for step in range(steps):
        near = at(groups).withColumn("d", _distance(step > 0))
        cut = near.groupBy("key").agg(F.percentile_approx("d", subset, 2000).alias("cut"))
        chosen = near.join(F.broadcast(cut) if few else cut, "key").where("d <= cut")
        # Sums of differences from the last centre: no digits are lost.
        y = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(X)]
        first = [F.avg(c).alias(f"a{i}") for i, c in enumerate(y)]
        second = [F.avg(y[i] * y[j]).alias(f"b{i}{j}") for i in range(d) for j in range(i + 1)]
        sums = chosen.groupBy("key").agg(*first, *second, *[F.first(f"m{i}").alias(f"o{i}") for i in range(d)], F.first("rows").alias("rows"))
        centre = [(F.col(f"o{i}") + F.col(f"a{i}")).alias(f"m{i}") for i in range(d)]
        covariance = [(F.col(f"b{i}{j}") - F.col(f"a{i}") * F.col(f"a{j}")).alias(f"c{i}{j}") for i in range(d) for j in range(i + 1)]
        groups = _with_factor(sums.select("key", "rows", *centre, *covariance), scale)
        factors = [f"l{i}{j}" for i in range(d) for j in range(i + 1)]
        groups = stored(groups.select("key", "rows", *[f"m{i}" for i in range(d)], *factors), "groups")
    return groups


def shrunk(groups: DataFrame, wider: DataFrame, prior_rows: float = PRIOR_ROWS) -> DataFrame:
    """Estimates (key, parent, rows, m, l) mixed with those of ``wider`` (key) that their ``parent`` names.

    Centres and covariances are means with the weights n and ``prior_rows``; the distance of the two centres counts in the covariance.
    A group without a wider one stays as it is.
    """
    d = len(X)
    lower = [(i, j) for i in range(d) for j in range(i + 1)]
    other = wider.select(F.col("key").alias("parent"), *[F.col(f"m{i}").alias(f"p{i}") for i in range(d)], *[F.col(f"l{i}{j}").alias(f"q{i}{j}") for i, j in lower])
    both = groups.join(other, "parent", "left").withColumn("w", F.when(F.col("p0").isNull(), 1.0).otherwise(F.col("rows") / (F.col("rows") + prior_rows)))

    def entry(name: str, i: int, j: int) -> Column:  # of L·Lᵀ
        terms = [F.coalesce(F.col(f"{name}{i}{k}") * F.col(f"{name}{j}{k}"), F.lit(0.0)) for k in range(j + 1)]
        return sum(terms[1:], terms[0])

    w = F.col("w")
    apart = [F.coalesce(F.col(f"m{i}") - F.col(f"p{i}"), F.lit(0.0)) for i in range(d)]
    centre = [(F.col(f"m{i}") - (1 - w) * apart[i]).alias(f"m{i}") for i in range(d)]
    mixed = [(w * entry("l", i, j) + (1 - w) * entry("q", i, j) + w * (1 - w) * apart[i] * apart[j]).alias(f"c{i}{j}") for i, j in lower]
    out = _with_factor(both.select("key", "rows", *centre, *mixed), 1.0, floors=False)
    return out.select("key", "rows", *[f"m{i}" for i in range(d)], *[f"l{i}{j}" for i, j in lower])


def verdicts(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns of ``keep``, the statistics, base_failed, distance and kept of every row of ``docs`` (text, lang, source).

    A row is kept if it doesn't fail the rule and its squared distance from its group's centre is within the chi-square
    bound. Groups are language and source. The estimate of a group is mixed with that of its language, and this one with that of all
    rows, by their numbers of rows (see ``shrunk``): no size decides which is taken. Estimates rest on the rows that don't fail.
    Null language or source is a group of its own. A null or empty text fails. Long texts are taken whole. Repeated rows count each.
    Other columns, whatever their names, don't matter. An empty table gives no rows.
    """
    keep = ["doc_id"] if keep is None else keep
    own = F.concat_ws("\t", F.lit("s"), F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")))
    wide = F.concat_ws("\t", F.lit("l"), F.coalesce("lang", F.lit("")))
    named = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], own.alias("_own"), wide.alias("_wide"), "text")
    ids = [f"_k{i}" for i in range(len(keep))]
    table = stored(with_statistics(named, [*ids, "_own", "_wide"]).withColumn("base_failed", base_failed()).select("*", *transformed()), "statistics")
    groups = estimates(table.where("not base_failed"), F.array("_own", "_wide", F.lit(ALL)))
    languages = shrunk(groups.where("key like 'l\t%'").withColumn("parent", F.lit(ALL)), groups.where(F.col("key") == ALL))
    parents = table.groupBy(F.col("_own").alias("key")).agg(F.first("_wide").alias("parent"))
    best = stored(shrunk(groups.where("key like 's\t%'").join(parents, "key"), languages), "estimates").withColumnRenamed("key", "_own")
    if fits_broadcast(docs.sparkSession, best.count(), 40):
        best = F.broadcast(best)
    measured = table.join(best, "_own", "left").withColumn("distance", _distance(True))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi_square_at(INLIERS, len(X)), F.lit(True))
    numbers = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return measured.select(*[F.col(k).alias(c) for k, c in zip(ids, keep, strict=True)], *numbers, "base_failed", kept.alias("kept"), "distance")
