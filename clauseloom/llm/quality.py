"""Quality rules and robust multivariate outliers.

Per language and source, location and scatter of the documents' transformed statistics are estimated by
the minimum covariance determinant: concentration steps from coordinate-wise medians, each keeping the
``SUPPORT`` share of rows with the least Mahalanobis distances, then one reweighted estimate. Documents far
from their group's centre are rejected.

A group's estimate is drawn towards its language's, and that towards the whole corpus', as if the wider
group added ``PRIOR_ROWS`` rows to it: a group of any size has an estimate of its own, small ones mostly
their language's, and nothing changes at a certain size.

The groups are never gathered. A step is one pass that sums counts, values and products by group and by
bin of the distance (1/64 of a power of two); the quantile and the new estimate come from these sums,
some hundred rows a group. So one group with most of the rows is no more work in any task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mapped

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
X = ("x0", "x1", "x2", "x3", "x4")
P = len(X)
#: Least standard deviations of the transformed statistics (a quarter of a unit of log length, 5 % of a mean word
#: length, 0.6 % of symbols, one repeated line in two, 2 % of repeated words), so that one that is nearly
#: constant doesn't reject by itself.
FLOORS = (0.25, 0.05, 0.08, 0.5, 0.15)
SUPPORT = 0.75
#: Rows that a wider group's estimate counts for.
PRIOR_ROWS = 50
#: Rejected beyond the quantile of this chance: one row in ten million of a clean, normal corpus. The statistics have
#: longer tails than that, so a larger chance would reject clean documents.
CHANCE = 1e-7
ALL = "all"


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """The counts of ``COUNTS`` for a text; null counts as empty."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    words = data.split()
    n = len(words)
    spaces = len(data) - sum(map(len, words))
    lines, dup_lines = text.split("\n"), 0
    if len(set(lines)) < len(lines):
        seen: set[str] = set()
        for line in lines:
            if line in seen:
                dup_lines += bool(line.encode("utf-8", "replace").split())
            seen.add(line)
    repeats = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) < len(windows):
        often, reach = Counter(windows), 0
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeats += i + 3 - max(i, reach)
                reach = i + 3
    return n, len(text) - spaces, len(data) - len(data.translate(None, SYMBOLS)), dup_lines, repeats


def with_statistics(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, len(batch), 500):
                part = batch.slice(row, 500)
                counts = zip(*map(statistics, part.column(len(keep)).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *[pa.array(c, pa.int64()) for c in counts]], [*keep, *COUNTS])

    return mapped(docs.select(*keep, F.col("text").alias("_text")), run, types + "".join(f", {c} long" for c in COUNTS))


def chi2_below(x: float, k: int) -> float:
    """Chance that a chi-square variable with ``k`` degrees of freedom is below ``x``."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= z / n
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 1e-9, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_below(mid, k) < p else (low, mid)
    return high


def first_estimate(rows: DataFrame) -> DataFrame:
    """(grp, n, m0.., v0_0..): medians, and squared scaled median deviations on the diagonal, from counts on a grid of 1/64."""
    cells = rows.select("grp", F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.round(F.col(x) * 64).cast("long").alias("bin")) for i, x in enumerate(X)])))
    cells = cells.groupBy("grp", "i", "bin").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("grp", "i")

    def median(order: str, name: str, cells: DataFrame) -> DataFrame:
        upto = F.sum("n").over(by.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        cells = cells.withColumns({"upto": upto, "all": F.sum("n").over(by)})
        return cells.withColumn(name, F.min(F.when(F.col("upto") * 2 >= F.col("all"), F.col(order))).over(by))

    cells = median("bin", "median", cells)
    cells = median("off", "spread", cells.withColumn("off", F.abs(F.col("bin") - F.col("median"))))
    out = cells.groupBy("grp").agg(
        F.max("all").alias("n"),
        *[F.max(F.when(F.col("i") == i, F.col("median") / 64)).alias(f"m{i}") for i in range(P)],
        *[F.max(F.when(F.col("i") == i, F.pow(F.col("spread") / 64 * 1.4826, 2))).alias(f"v{i}_{i}") for i in range(P)],
    )
    return out.withColumns({f"v{i}_{j}": F.lit(0.0) for i in range(P) for j in range(i)})


NAMES = [f"m{i}" for i in range(P)] + [f"v{i}_{j}" for i in range(P) for j in range(i + 1)]
INVERSE = ["grp", *[n.replace("v", "w") for n in NAMES]]
INVERSES = "grp string" + "".join(f", {n} double" for n in INVERSE[1:])


def inverses(grp: pa.Array, values: np.ndarray, scale: float) -> pa.RecordBatch:
    """Rows ``INVERSE`` from rows of ``NAMES``: centres and inverse scatters; the scatter is scaled and gets the floors on its diagonal."""
    v, places = np.zeros((len(values), P, P)), [(i, j) for i in range(P) for j in range(i + 1)]
    for k, (i, j) in enumerate(places):
        v[:, i, j] = v[:, j, i] = values[:, P + k] * scale
    w = np.linalg.inv(v + np.diag(np.square(FLOORS))) if len(v) else v
    return pa.RecordBatch.from_arrays([grp, *[pa.array(values[:, i].copy()) for i in range(P)], *[pa.array(w[:, i, j].copy()) for i, j in places]], INVERSE)


def inverted(estimate: DataFrame, scale: float) -> DataFrame:
    """Rows ``INVERSE`` of estimates (grp, ``NAMES``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield inverses(batch.column(0), np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1), scale)

    return mapped(estimate.select("grp", *NAMES), run, INVERSES)


def drawn(estimate: DataFrame, within: DataFrame, scale: float) -> DataFrame:
    """:func:`inverted` of all groups of ``within`` (lang, level, grp), each estimate first drawn towards its wider group's.

    Level 0 is the corpus, 1 a language, 2 a language and source; a language's rows stand together, itself first.
    A group none of whose rows is near its centre has no estimate of its own and takes the wider one.
    """
    estimate = cut(estimate)
    top = estimate.where(F.col("grp") == ALL).select(*NAMES).first()
    corpus = np.array(top or [0.0] * len(NAMES), float)
    rows = within.join(estimate, "grp", "left").select("lang", "level", "grp", F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang = corpus
        for batch in batches:
            level, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 3))
            own = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[4:]], axis=1)
            weight = (n / (n + PRIOR_ROWS))[:, None]
            values = np.where((level == 0)[:, None], own, weight * own + (1 - weight) * corpus)
            above = np.maximum.accumulate(np.where(level == 1, np.arange(len(level)) + 1, 0))
            langs = np.concatenate([lang[None], values])[above]
            values = np.where((level == 2)[:, None], weight * own + (1 - weight) * langs, values)
            lang = langs[-1] if len(langs) else lang
            yield inverses(batch.column(2), values, scale)

    dealt = rows.repartition("lang").sortWithinPartitions("lang", "level")
    return mapped(dealt, run, INVERSES)


def distance(rows: DataFrame, inverse: DataFrame) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance."""
    off = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(X)]
    d2 = sum((off[i] * off[j] * F.col(f"w{i}_{j}") * (1 if i == j else 2) for i in range(P) for j in range(i + 1)), F.lit(0.0))
    return rows.join(inverse, "grp", "left").withColumn("d2", d2).drop(*[c for c in inverse.columns if c != "grp"])


def step(rows: DataFrame, inverse: DataFrame, support: float | None, most: float = 0.0) -> DataFrame:
    """The next estimate: from the share ``support`` of each group's rows that are nearest, or from those nearer than ``most``."""
    bins = F.floor(F.log2(F.col("d2") + 1e-9) * 64).cast("long").alias("bin")
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(X)] + [F.sum(F.col(X[i]) * F.col(X[j])).alias(f"q{i}_{j}") for i in range(P) for j in range(i + 1)]
    cells = distance(rows, inverse).groupBy("grp", bins).agg(F.count(F.lit(1)).alias("n"), *sums)
    by = Window.partitionBy("grp")
    if support is None:
        inner = cells.where(F.col("bin") <= math.floor(math.log2(most) * 64))
    else:
        before = F.coalesce(F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        inner = cells.withColumns({"before": before, "all": F.sum("n").over(by)}).where(F.col("before") < F.col("all") * support)
    total = inner.groupBy("grp").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in cells.columns if c[0] in "sq"])
    mean = [F.col(f"s{i}") / F.col("n") for i in range(P)]
    return total.select("grp", "n", *[m.alias(f"m{i}") for i, m in enumerate(mean)], *[(F.col(f"q{i}_{j}") / F.col("n") - mean[i] * mean[j]).alias(f"v{i}_{j}") for i in range(P) for j in range(i + 1)])


def judged(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), steps: int = 4) -> DataFrame:
    """``keep``, the counts, base_failed, d2 and kept for each row of ``docs``.

    base_failed: under 50 words, or over half of the words in three-word windows that repeat. Those rows
    have no d2 and aren't kept. The others are kept unless their squared distance is beyond the chi-square
    quantile. Groups are (lang, source), nulls being values of their own. Null and empty texts fail;
    repeated rows stay and count each; other columns are ignored; an empty table gives an empty result.
    """
    n = F.greatest(F.col("n_words"), F.lit(1))
    own = ("lang", "source")
    named = docs.select(*keep, *[F.col(c).alias(f"_{c}") for c in own], "text") if "text" not in keep else docs.withColumns({f"_{c}": F.col(c) for c in own})
    rows = with_statistics(named, (*keep, "_lang", "_source"))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    measures = [F.log1p("n_words"), F.log(F.col("word_chars") / n + 1e-9), F.sqrt(F.col("n_symbols") / n), F.log1p("n_dup_lines"), F.sqrt(F.col("n_repeat_words") / n)]
    rows = rows.withColumns(dict(zip(X, measures, strict=True)))
    named = {c: F.coalesce(F.concat(F.lit("="), F.col(f"_{c}")), F.lit("null")) for c in own}
    wider, name = named["lang"], F.concat(named["lang"], F.lit("\u0001"), named["source"])
    rows = cut(rows.withColumns({"grp": F.when(~F.col("base_failed"), name), "wider": wider}).drop("_lang", "_source"))
    good = rows.where("not base_failed")
    level = lambda k, lang, grp: F.struct(lang.alias("lang"), F.lit(k).alias("level"), grp.alias("grp"))
    levels = F.array(level(2, F.col("wider"), F.col("grp")), level(1, F.col("wider"), F.col("wider")), level(0, F.lit(ALL), F.lit(ALL)))
    within = cut(good.select(F.inline(levels)).distinct())
    good = good.select(F.explode(F.array("grp", "wider", F.lit(ALL))).alias("grp"), *X)
    rows = rows.drop("wider")

    inverse = cut(drawn(first_estimate(good), within, 1.0))
    # the nearest rows of a normal sample have less scatter than all of it
    shrunk = SUPPORT / chi2_below(chi2_quantile(SUPPORT, P), P + 2)
    for _ in range(steps):
        inverse = cut(drawn(step(good, inverse, SUPPORT), within, shrunk))
    inverse = cut(drawn(step(good, inverse, None, chi2_quantile(0.975, P)), within, 0.975 / chi2_below(chi2_quantile(0.975, P), P + 2)))
    out = distance(rows, inverse).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= chi2_quantile(1 - CHANCE, P), ~F.col("base_failed")))
    return out.select(*keep, *COUNTS, "base_failed", F.when(~F.col("base_failed"), F.col("d2")).alias("d2"), "kept")
