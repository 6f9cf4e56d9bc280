"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

Rules name a host and a path prefix; the longest that fits decides. The URLs
that rules decide are the labelled URLs on which the trees are trained:
length, depth, digit ratio, entropy, parameter counts, and how often other URLs
of the same host suffix were blocked.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import smallest_hashes, written, written_and_told

#: labelled URLs that fitting sees at most; weight of the overall rate in a suffix's rate; folds that rate each other
MAX_ROWS, SMOOTHING, FOLDS = 200_000, 20.0, 5
TREES, DEPTH = 12, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("url_length", "host_length", "path_length", "labels", "depth", "digits", "host_digits", "entropy", "host_entropy",
            "parameters", "query_length", "fragment", "hyphens", "longest_word", "suffix1_rate", "suffix2_rate")


def host_and_path(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, what follows the path): all empty for null and where there is no "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = rest.substr(F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(after, r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path, after.substr(F.length(path) + 1, F.length(after))


def entropy(s: Column) -> Column:
    """Bits per character of a string; 0 for an empty one."""
    n = F.length(s)
    share = F.transform(F.array_distinct(F.split(s, "")), lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n)
    bits = F.aggregate(share, F.lit(0.0), lambda a, p: a + F.when(p > 0, -p * F.log2(p)).otherwise(0.0))
    return F.when(n > 0, bits).otherwise(0.0)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host, path) that fits, else nulls."""
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(what).alias("verdict")))
            for what, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))]
    first = F.coalesce(*fits)
    return first["rule"], first["verdict"]


def lexical(df: DataFrame, url: str) -> DataFrame:
    """df with columns _host, _path and the lexical features (prefix _f_) of its URL."""
    u = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    host, path, tail = host_and_path(u)
    out = df.withColumns({"_u": u, "_host": host, "_path": path, "_tail": tail})
    query = F.regexp_extract(F.col("_tail"), r"^\?([^#]*)", 1)
    labels = F.split("_host", r"\.")
    ratio = lambda c: F.when(F.length(c) > 0, F.length(F.regexp_replace(c, r"[^0-9]", "")) / F.length(c)).otherwise(0.0)
    cols = {
        "url_length": F.length("_u"), "host_length": F.length("_host"), "path_length": F.length("_path"), "labels": F.size(labels),
        "depth": F.length(F.regexp_replace("_path", r"/+$", "")) - F.length(F.replace(F.regexp_replace("_path", r"/+$", ""), F.lit("/"), F.lit(""))),
        "digits": ratio(F.col("_u")), "host_digits": ratio(F.col("_host")), "entropy": entropy(F.col("_u")), "host_entropy": entropy(F.col("_host")),
        "parameters": F.when(F.length(query) > 0, F.size(F.split(query, "&"))).otherwise(0), "query_length": F.length(query),
        "fragment": F.contains(F.col("_tail"), F.lit("#")).cast("int"), "hyphens": F.length("_u") - F.length(F.replace(F.col("_u"), F.lit("-"), F.lit(""))),
        "longest_word": F.array_max(F.transform(F.split("_u", r"[^A-Za-z0-9]"), F.length)),
    }
    out = out.withColumns({f"_f_{k}": c.cast("double") for k, c in cols.items()})
    return out.withColumns({"_s1": F.element_at(labels, -1), "_s2": F.substring_index("_host", ".", -2)})


def suffix_rates(labelled: DataFrame, k: str) -> DataFrame:
    """(suffix, fold, rate): the smoothed share of blocked URLs per suffix, for URLs of
    each fold from those of the other folds, and under fold -1 from all.

    A fitted URL's rate thus never holds its own label. Rows: suffixes times folds."""
    rate = labelled.agg(F.avg("_y")).first()[0] or 0.0
    of = labelled.groupBy(f"_s{k}", "_fold").agg(F.sum("_y").alias("y"), F.count(F.lit(1)).alias("n"))
    whole = of.groupBy(f"_s{k}").agg(F.sum("y").alias("y"), F.sum("n").alias("n"))
    folds = F.explode(F.array(*[F.lit(x) for x in range(-1, FOLDS)])).alias("_fold")
    each = whole.select(f"_s{k}", F.col("y").alias("ty"), F.col("n").alias("tn"), folds).join(of, [f"_s{k}", "_fold"], "left")
    left = lambda t, own: F.col(t) - F.coalesce(F.col(own), F.lit(0))
    return each.select(f"_s{k}", "_fold", ((left("ty", "y") + SMOOTHING * rate) / (left("tn", "n") + SMOOTHING)).alias(f"_f_suffix{k}_rate"))


def judge(df: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", max_rows: int = MAX_ROWS) -> DataFrame:
    """df's columns and host, path, rule, score, verdict.

    score: the trees' probability of "block" (null where a rule decides).
    The fit sees at most max_rows rule-decided URLs, those with the smallest
    hash; suffix statistics see all. Where rules decide no URL, or all the
    same way, there is nothing to learn: the rest are allowed. Null URLs and
    URLs without "://" have empty host and path and are judged by features.
    Input columns named host, path, rule, score or verdict are replaced."""
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "score", "verdict")]
    rows = lexical(df, url)
    rule, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    rows = rows.withColumns({"_rule": rule, "_verdict": verdict})
    rows = rows.withColumn("_y", F.when(F.col("_verdict").isNotNull(), (F.col("_verdict") == "block").cast("double")))
    rows = rows.withColumn("_fold", F.when(F.col("_y").isNotNull(), F.pmod(F.xxhash64("_u", F.lit(3)), F.lit(FOLDS)).cast("int")).otherwise(-1))
    # what the fit needs of the URLs that rules decide, written once: hashes, suffixes, labels
    labelled, told = written_and_told(rows.where("_y is not null").select("_s1", "_s2", "_y", "_fold", F.xxhash64("_u").alias("_r")), "labelled",
                                      n=F.count(F.lit(1)), low=F.min("_y"), high=F.max("_y"))
    if not told["n"] or told["low"] == told["high"]:
        scored = rows.withColumn("_p", F.lit(0.0))
    else:
        rate = labelled.agg(F.avg("_y")).first()[0]
        rates = {k: written(suffix_rates(labelled, k), "suffixes") for k in ("1", "2")}
        for k, of in rates.items():
            rows = rows.join(of, [f"_s{k}", "_fold"], "left")
        rows = rows.fillna(rate, [f"_f_suffix{k}_rate" for k in rates])
        rows = VectorAssembler(inputCols=[f"_f_{f}" for f in FEATURES], outputCol="_features").transform(rows)
        sample = rows.where("_y is not null").select("_features", "_y", F.xxhash64("_u").alias("_r"))
        if told["n"] > max_rows:
            cut = smallest_hashes(labelled, "_r", told["n"], max_rows)
            sample = sample.where(F.col("_r") <= F.lit(cut)).orderBy("_r").limit(max_rows)  # equal hashes: equal URLs
        # written, so that each of the trees' jobs reads max_rows vectors and no page again
        model = GBTClassifier(featuresCol="_features", labelCol="_y", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7, checkpointInterval=-1).fit(written(sample.select("_features", "_y"), "sample"))
        scored = model.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("_prob").transform(rows).withColumn("_p", vector_to_array("_prob")[1])
    decided = F.coalesce("_verdict", F.when(F.col("_p") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select(*[F.col(f"`{c}`") for c in kept], F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"),
                         F.when(F.col("_verdict").isNull(), F.col("_p")).alias("score"), decided.alias("verdict"))
