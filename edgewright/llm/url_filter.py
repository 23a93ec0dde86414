"""URL filter: host and path rules, then gradient-boosted trees on lexical features."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host and path prefix)
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
FOLDS = 5
FEATURES = ["length", "host_length", "path_length", "depth", "labels", "hyphens", "digit_ratio", "host_digit_ratio", "entropy", "params", "suffix_rate", "suffix_rows"]


def host_of(url: Column) -> Column:
    """Between the first :// and / ? # or the end, A-Z lower-cased; '' without :// or for null."""
    after = F.when(F.instr(url, "://") > 0, F.substring_index(F.substring(url, F.instr(url, "://") + 3, F.length(url)), "/", 1))
    return F.coalesce(F.translate(F.substring_index(F.substring_index(after, "?", 1), "#", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? or # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.coalesce(F.when(F.instr(rest, "/") > 0, F.substring(rest, F.instr(rest, "/"), F.length(rest))), F.lit(""))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null if none does; of equal ones, block wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):
        name, slash, prefix = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def lexical(rows: DataFrame) -> DataFrame:
    """Add the features that a url has by itself to ``rows(url, host, path)``."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    share = lambda of, among: (F.length(of) - F.length(F.translate(of, among, ""))) / F.greatest(F.length(of), F.lit(1))
    letters = F.array_sort(F.split(url, ""))
    each = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / n)
    entropy = F.aggregate(F.when(F.length(url) > 0, each), F.lit(0.0), lambda a, p: a - p * F.log2(p))
    query = F.when(F.instr(url, "?") > 0, F.substring_index(F.substring_index(url, "#", 1), "?", -1)).otherwise("")
    return rows.withColumns(
        {
            "length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)).cast("double"),
            "labels": F.size(F.split("host", r"\.")).cast("double"),
            "hyphens": (F.length("host") - F.length(F.translate("host", "-", ""))).cast("double"),
            "digit_ratio": share(url, "0123456789"),
            "host_digit_ratio": share(F.col("host"), "0123456789"),
            "entropy": F.coalesce(entropy, F.lit(0.0)),
            "params": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
            "suffix": F.substring_index("host", ".", -2),
        }
    )


def with_suffix(rows: DataFrame, stats: DataFrame, prior: float) -> DataFrame:
    """Add what the labelled rows say of the host's last two labels; stats has at most one row for each labelled row."""
    return rows.join(F.broadcast(stats), "suffix", "left").withColumns({"suffix_rate": F.coalesce("suffix_rate", F.lit(prior)), "suffix_rows": F.coalesce("suffix_rows", F.lit(0.0))})


def train(labelled: DataFrame, trees: int = 12, depth: int = 4) -> tuple[GBTClassificationModel, DataFrame, float] | None:
    """Trees, suffix statistics and share of blocks from ``labelled(url, host, path, label)``; None unless both labels occur."""
    spark = labelled.sparkSession
    n, blocks = labelled.agg(F.count("*"), F.sum("label")).first()
    if not n or not 0 < blocks < n:
        return None
    rows = lexical(labelled)
    prior = blocks / n
    found = rows.groupBy("suffix").agg(F.sum("label").alias("blocks"), F.count("*").alias("rows"))
    found = found.select("suffix", ((F.col("blocks") + 10 * prior) / (F.col("rows") + 10)).alias("suffix_rate"), F.log1p("rows").alias("suffix_rows"))
    stats = spark.createDataFrame(found.collect(), found.schema)  # at most as many rows as labels, which are bounded
    # a url must not see its own label: in training, a suffix has the statistics of the other folds
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("url", F.lit(11)), F.lit(FOLDS)))
    whole = rows.groupBy("suffix").agg(F.sum("label").alias("b"), F.count("*").alias("k"))
    own = rows.groupBy("suffix", "fold").agg(F.sum("label").alias("own_b"), F.count("*").alias("own_k"))
    rest = own.join(whole, "suffix").withColumns({"b": F.col("b") - F.col("own_b"), "k": F.col("k") - F.col("own_k")})
    rest = rest.select("suffix", "fold", ((F.col("b") + 10 * prior) / (F.col("k") + 10)).alias("suffix_rate"), F.log1p("k").alias("suffix_rows"))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.join(rest, ["suffix", "fold"])).select("features", "label").coalesce(1)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, seed=5, labelCol="label", featuresCol="features").fit(vectors)
    return model, stats, prior


def judged(pages: DataFrame, rules: list[tuple[str, str]] | None = None, labelled: DataFrame | None = None, max_labels: int = 4000, threshold: float = 0.5) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for each row of ``pages(page_id, url)``.

    A url that a rule fits takes its verdict. Others take that of the trees:
    block where the probability reaches ``threshold``. The trees learn from
    ``labelled(url, label)`` (1: block), or else from the urls that rules
    decide, at most ``max_labels`` of them by hash. Where only one label or
    none is known, other urls are allowed (score 0). Null urls have empty host
    and path; equal urls get equal rows, repeated rows repeat; an empty table
    gives an empty one.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = rule_columns(F.col("host"), F.col("path"), RULES if rules is None else rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    if labelled is None:
        known = rows.where("ruled IS NOT NULL").select("url", "host", "path", (F.col("ruled") == "block").cast("double").alias("label"))
    else:
        known = labelled.select(F.col("url").cast("string"), F.col("label").cast("double")).dropna()
        known = known.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    known = known.distinct().orderBy(F.xxhash64("url"), "url", "label").limit(max_labels)
    known = pages.sparkSession.createDataFrame(known.collect(), known.schema)
    learned = train(known)
    if learned is None:
        scored = rows.withColumn("score", F.lit(0.0))
    else:
        model, stats, prior = learned
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_suffix(lexical(rows), stats, prior))
        scored = model.transform(vectors).withColumn("score", vector_to_array("probability")[1])
    decided = F.coalesce("ruled", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", decided.alias("verdict"), "score")
