"""Change of each measurement row: value, p and sign."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.scalars import sign_by_p, sign_by_threshold

MODES = [
    "as-is-single-value", "arithmetic-mean", "geometric-mean", "max", "difference-of-means", "fold-change-of-mean",
    "significant-change-of-mean", "significant-change-of-mean-paired", "signed-p-values", "correlation",
]
#: Types whose values are categories: their numbers have no order that a t-test could use.
CATEGORICAL = ["mutation", "dna_cna"]
P_MODES = {"significant-change-of-mean", "significant-change-of-mean-paired", "signed-p-values"}


def _test(x: Column) -> Column:
    return F.when(F.col("grp") == "test", x)


def _control(x: Column) -> Column:
    return F.when(F.col("grp") == "control", x)


V = "value"


def first_value(values: DataFrame) -> DataFrame:
    return values.groupBy("row_id").agg(F.min_by(V, "sample_idx").alias(V))


def arithmetic_mean(values: DataFrame) -> DataFrame:
    return values.groupBy("row_id").agg(F.avg(V).alias(V))


def geometric_mean(values: DataFrame) -> DataFrame:
    """Mean of fold changes: x < 0 stands for -1/x; a result under 1 becomes its negative inverse. One column stays as it is."""
    x = F.col(V)
    fold = F.when(x < 0, -1 / x).otherwise(x)
    out = values.groupBy("row_id").agg(F.count("*").alias("n"), F.exp(F.avg(F.ln(fold))).alias("g"), F.min(F.when(fold == 0, 0.0)).alias("zero"), F.max(V).alias("only"))
    g = F.coalesce("zero", "g")
    return out.select("row_id", F.when(F.col("n") == 1, F.col("only")).when(g < 1, -F.try_divide(F.lit(1.0), g)).otherwise(g).alias(V))


def max_abs(values: DataFrame) -> DataFrame:
    """The value of largest size, the first of equal ones; 0 if all are missing."""
    best = F.max_by(V, F.when(F.col(V).isNotNull(), F.struct(F.abs(V), -F.col("sample_idx"))))
    return values.groupBy("row_id").agg(F.coalesce(best, F.lit(0.0)).alias(V))


def difference_of_means(values: DataFrame) -> DataFrame:
    return values.groupBy("row_id").agg((F.avg(_test(F.col(V))) - F.avg(_control(F.col(V)))).alias(V))


def fold_change_of_mean(values: DataFrame) -> DataFrame:
    t, c = F.col("t"), F.col("c")
    means = values.groupBy("row_id").agg(F.avg(_test(F.col(V))).alias("t"), F.avg(_control(F.col(V))).alias("c"))
    return means.select("row_id", F.when(t > c, F.try_divide(t, c)).otherwise(-F.try_divide(c, t)).alias(V))


def welch(values: DataFrame, min_sample: int = 0, by: tuple[str, ...] = ("row_id", "replicate")) -> DataFrame:
    """row_id, replicate (or other keys), diff, t, df of test against control; null with under two values or fewer than min_sample in a group, or no variance."""
    x = F.col(V)
    got = values.groupBy(*by).agg(
        F.avg(_test(x)).alias("mt"), F.avg(_control(x)).alias("mc"), F.var_samp(_test(x)).alias("vt"), F.var_samp(_control(x)).alias("vc"), F.count(_test(x)).alias("nt"), F.count(_control(x)).alias("nc")
    )
    a, b = F.col("vt") / F.col("nt"), F.col("vc") / F.col("nc")
    ok = (F.least("nt", "nc") >= max(2, min_sample)) & (a + b > 0)
    return got.select(
        *by, (F.col("mt") - F.col("mc")).alias("diff"),
        F.when(ok, (F.col("mt") - F.col("mc")) / F.sqrt(a + b)).alias("t"),
        F.when(ok, (a + b) ** 2 / (a * a / (F.col("nt") - 1) + b * b / (F.col("nc") - 1))).alias("df"),
    )


def paired(values: DataFrame, min_sample: int = 0) -> DataFrame:
    """The same for pairs: the i-th control with the i-th test sample; pairs with a missing value don't count."""
    place = F.row_number().over(W.partitionBy("row_id", "replicate", "grp").orderBy("sample_idx"))
    placed = values.where("grp IN ('control', 'test')").withColumn("pair", place)
    pairs = placed.groupBy("row_id", "replicate", "pair").agg((F.max(_test(F.col(V))) - F.max(_control(F.col(V)))).alias("d"))
    got = pairs.groupBy("row_id", "replicate").agg(F.avg("d").alias("diff"), F.stddev_samp("d").alias("sd"), F.count("d").alias("n"))
    ok = (F.col("n") >= max(2, min_sample)) & (F.col("sd") > 0)
    return got.select("row_id", "replicate", "diff", F.when(ok, F.col("diff") / (F.col("sd") / F.sqrt("n"))).alias("t"), F.when(ok, (F.col("n") - 1).cast("double")).alias("df"))


def combine_repeats(tests: DataFrame) -> DataFrame:
    """Tests (row_id, diff, p) of one row by Stouffer's method, two-sided and signed; one test stays as it is.

    The value keeps the mean difference, turned round if the combined sign disagrees.
    """
    z = F.signum("diff") * stats.z_of_p(F.col("p"))
    sums = tests.where("p IS NOT NULL").withColumn("z", z).groupBy("row_id").agg(F.count("*").alias("n"), (F.sum("z") / F.sqrt(F.count("*"))).alias("z"), F.avg("diff").alias("mean"), F.first("p").alias("only"))
    sums = sums.withColumn("p", F.when(F.col("n") == 1, F.col("only")).otherwise(stats.normal_p(F.col("z"))))
    agrees = (F.col("n") == 1) | (F.signum("z") == F.signum("mean"))
    return sums.select("row_id", F.when(agrees, F.col("mean")).otherwise(-F.col("mean")).alias("diff"), "p")


def significant_change(values: DataFrame, pairs: bool = False, min_sample: int = 0) -> DataFrame:
    """value = sign * -ln p and p of the t-test; repeats combined."""
    tests = (paired if pairs else welch)(values, min_sample)
    tests = tests.withColumn("p", stats.t_p(F.col("t"), F.col("df"))).select("row_id", "diff", "p")
    merged = values.select("row_id").distinct().join(combine_repeats(tests), "row_id", "left")
    return merged.select("row_id", stats.signed_log(F.col("p"), F.signum("diff")).alias(V), "p", "diff")


def signed_p_values(values: DataFrame) -> DataFrame:
    x = F.min_by(V, "sample_idx")
    return values.groupBy("row_id").agg(x.alias("x")).select("row_id", stats.signed_log(F.abs("x"), F.when(F.col("x") < 0, -1).otherwise(1)).alias(V), F.abs("x").alias("p"))


def contingency(values: DataFrame, min_sample: int = 0) -> DataFrame:
    """row_id, n_categories, n, g, chi2, df, diff of categories (value) by group; null statistics with one category or group."""
    known = values.where("value IS NOT NULL AND grp IN ('control', 'test')")
    cells = known.groupBy("row_id", V).agg(F.count(_test(F.col(V))).cast("double").alias("t"), F.count(_control(F.col(V))).cast("double").alias("c"))
    total = cells.groupBy("row_id").agg(F.sum("t").alias("all_t"), F.sum("c").alias("all_c"), F.count("*").alias("n_categories"))
    both = cells.join(total, "row_id")
    row, n = F.col("t") + F.col("c"), F.col("all_t") + F.col("all_c")
    part = lambda o, of: F.when(F.col(o) > 0, F.col(o) * F.ln(F.col(o) * n / (row * F.col(of)))).otherwise(0.0)
    chi = lambda o, of: F.try_divide((F.col(o) - row * F.col(of) / n) ** 2, row * F.col(of) / n)
    out = both.groupBy("row_id", "all_t", "all_c", "n_categories").agg(
        (2 * F.sum(part("t", "all_t") + part("c", "all_c"))).alias("g"), F.sum(chi("t", "all_t") + chi("c", "all_c")).alias("chi2"),
        (F.try_divide(F.sum(F.col(V) * F.col("t")), F.max("all_t")) - F.try_divide(F.sum(F.col(V) * F.col("c")), F.max("all_c"))).alias("diff"),
        F.min(F.struct(V, "t", "c")).alias("first"), F.max(F.struct(V, "t", "c")).alias("last"),
    )
    ok = (F.col("n_categories") > 1) & (F.col("all_t") > 0) & (F.col("all_c") > 0) & (F.least("all_t", "all_c") >= min_sample)
    return out.select(
        "row_id", "n_categories", (F.col("all_t") + F.col("all_c")).alias("n"), F.when(ok, F.col("g")).alias("g"), F.when(ok, F.col("chi2")).alias("chi2"),
        (F.col("n_categories") - 1).cast("double").alias("df"), "diff", "first", "last",
    )


def extremized_g(a: Column, b: Column, c: Column, d: Column) -> Column:
    """G of the most uneven 2x2 table with these margins: the rarer outcome all in the smaller group, as far as it goes."""
    rare, small, n = F.least(a + c, b + d), F.least(a + b, c + d), a + b + c + d
    inside = F.least(rare, small)
    cells = [(inside, small, rare), (small - inside, small, n - rare), (rare - inside, n - small, rare), (n - small - rare + inside, n - small, n - rare)]
    return 2 * sum((F.when(o > 0, o * F.ln(o * n / (r * k))).otherwise(0.0) for o, r, k in cells), F.lit(0.0))


def categorical_change(values: DataFrame, sufficiency: float = 0.001, min_sample: int = 0) -> DataFrame:
    """G-test of two categories, if their numbers could reach ``sufficiency``; chi-square of more."""
    got = contingency(values, min_sample)
    f, last = F.col("first"), F.col("last")
    can = stats.chi2_p(extremized_g(f["t"], f["c"], last["t"], last["c"]), F.lit(1.0))
    got = got.withColumn("can", can).withColumn("p_raw", stats.chi2_p(F.when(F.col("n_categories") == 2, F.col("g")).otherwise(F.col("chi2")), F.col("df")))
    p = F.when((F.col("n_categories") != 2) | (F.col("can") <= sufficiency), F.col("p_raw"))
    got = got.withColumn("p", p)
    return got.select("row_id", stats.signed_log(F.col("p"), F.signum("diff")).alias(V), "p", "diff")


def presence(values: DataFrame, rows: DataFrame) -> DataFrame:
    """Values as 1 (measured) or 0; null where no row of the data type has a value in the sample. Values may name their data type themselves."""
    typed = values if "data_type" in values.columns else values.join(rows.select("row_id", "data_type"), "row_id")
    seen = typed.groupBy("data_type", "replicate", "sample_idx").agg(F.max(F.col(V).isNotNull().cast("int")).alias("seen"))
    flag = F.when(F.col("seen") == 1, F.col(V).isNotNull().cast("double"))
    # one row for each data type and sample
    return typed.join(F.broadcast(seen), ["data_type", "replicate", "sample_idx"]).select("row_id", "replicate", "sample_idx", "grp", flag.alias(V))


def fisher(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two tests (row_id, p, diff) of each row by Fisher's method, with the sign of the first; a missing side doesn't count."""
    both = first.select("row_id", "p", "diff").join(second.select("row_id", F.col("p").alias("p2"), F.col("diff").alias("diff2")), "row_id", "full")
    x = -2 * (F.ln(F.greatest("p", F.lit(1e-300))) + F.ln(F.greatest("p2", F.lit(1e-300))))
    both = both.withColumn("p12", stats.chi2_p(x, F.lit(4.0)))
    p = F.coalesce("p12", "p", "p2")
    return both.select("row_id", F.coalesce(F.when(F.col("p").isNotNull(), F.col("diff")), F.col("diff2"), F.col("diff")).alias("diff"), p.alias("p"))


def with_missing_value_test(values: DataFrame, rows: DataFrame, sufficiency: float = 0.001, min_sample: int = 0, pairs: bool = False, by_tables: DataFrame | None = None) -> DataFrame:
    """The t-test combined with the test of presence, or with p-values from random tables, ``by_tables(row_id, p)`` (``presence.missing_p``)."""
    flags = presence(values, rows)
    second = categorical_change(flags, sufficiency) if by_tables is None else difference_of_means(flags).withColumnRenamed(V, "diff").join(by_tables, "row_id")
    both = fisher(significant_change(values, pairs, min_sample), second)
    return both.select("row_id", stats.signed_log(F.col("p"), F.signum("diff")).alias(V), "p", "diff")


def summarize(values: DataFrame, mode: str, min_sample: int = 0) -> DataFrame:
    """row_id, value, p (null where the mode has none) by value-transformation."""
    made = {
        "as-is-single-value": first_value, "arithmetic-mean": arithmetic_mean, "geometric-mean": geometric_mean, "max": max_abs,
        "difference-of-means": difference_of_means, "fold-change-of-mean": fold_change_of_mean, "signed-p-values": signed_p_values,
        "significant-change-of-mean": lambda v: significant_change(v, False, min_sample), "significant-change-of-mean-paired": lambda v: significant_change(v, True, min_sample),
    }
    if mode not in made:
        raise ValueError(f"unknown value-transformation: {mode}")
    out = made[mode](values)
    p = F.col("p") if "p" in out.columns else F.lit(None).cast("double")
    return out.select("row_id", V, p.alias("p"))


def _by_kind(rows: DataFrame, values: DataFrame, mode: str, min_sample: int) -> DataFrame:
    """``summarize``, but with the tests of categories for rows of CATEGORICAL types where changes are tested."""
    if not mode.startswith("significant-change"):
        return summarize(values, mode, min_sample)
    kinds = rows.select("row_id", F.col("data_type").isin(CATEGORICAL).alias("__category"))
    typed = values.join(kinds, "row_id")
    numbers, categories = (typed.where(c).drop("__category") for c in (~F.col("__category"), F.col("__category")))
    return summarize(numbers, mode, min_sample).unionByName(categorical_change(categories, min_sample=min_sample).select("row_id", V, "p"))


def changes(rows: DataFrame, values: DataFrame, mode: str, thresholds: dict[str, float], min_sample: int = 0, activity_threshold: float = 0.1) -> DataFrame:
    """row_id, value, p, sign. Types without a threshold have sign 0; activity rows go by their first value at 0.1.

    Tests of change take rows of CATEGORICAL types by their categories.
    """
    measured = _by_kind(rows, values, mode, min_sample)
    limits = {**thresholds, "activity": activity_threshold}
    pairs = [F.lit(x) for k, v in limits.items() for x in (k, float(v))]
    kept = rows.select("row_id", "data_type").withColumn("limit", F.create_map(*pairs)[F.col("data_type")])
    joined = kept.join(measured, "row_id", "left")
    if mode in P_MODES:
        active = kept.where("data_type = 'activity'").select("row_id").join(first_value(values), "row_id", "left").withColumnRenamed(V, "a")
        joined = joined.join(active, "row_id", "left").withColumn(V, F.coalesce("a", V))
        by_p = sign_by_p(F.col(V), F.col("p"), F.col("limit"))
        sign = F.when(F.col("data_type") == "activity", sign_by_threshold(F.col(V), F.col("limit"))).otherwise(by_p)
    else:
        sign = sign_by_threshold(F.col(V), F.col("limit"))
    return joined.select("row_id", V, "p", F.coalesce(sign, F.lit(0)).cast("int").alias("sign"))


def stdev_filter(rows: DataFrame, values: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Rows whose sample standard deviation reaches the limit of their type; those of limited types without one go.

    A deviation of the limit itself may come out a rounding below it, by the
    order in which values are summed: within 1e-12 of the limit it is reached.
    """
    if not limits:
        return rows
    sd = values.groupBy("row_id").agg(F.stddev_samp(V).alias("__sd"))
    limit = F.create_map(*[F.lit(x) for k, v in limits.items() for x in (k, float(v))])[F.col("data_type")]
    return rows.join(sd, "row_id", "left").where(limit.isNull() | (F.col("__sd") >= limit - F.abs(limit) * 1e-12)).select(*rows.columns)


def stdev_histogram(rows: DataFrame, values: DataFrame, width: float = 0.05) -> DataFrame:
    sd = values.groupBy("row_id").agg(F.stddev_samp(V).alias("sd")).where("sd IS NOT NULL").join(rows.select("row_id", "data_type"), "row_id")
    return sd.groupBy("data_type", F.floor(F.round(F.col("sd") / width, 6)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def box_plots(values: DataFrame) -> DataFrame:
    """Five numbers of each row and group, for plotting."""
    cuts = F.percentile(V, F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))
    got = values.where("value IS NOT NULL").groupBy("row_id", "grp").agg(cuts.alias("q"), F.count("*").alias("n"))
    return got.select("row_id", "grp", "n", *(F.col("q")[i].alias(c) for i, c in enumerate(("low", "q1", "median", "q3", "high"))))
