"""Operator 7: URL filter (DataFrame functions only on the main path).

Rules (host, path prefix) decide first; the longest rule that fits wins.  Other
URLs are scored by a logistic regression on hashed character n-grams of host
and path.  The n-grams, their hashes and the weighted sum are built-in
functions; the weights are one array literal of ``DIM`` doubles.  Training
reads a small labelled URL table (at most ``MOST_LABELLED`` rows): its features
come from the same expressions, its fit is a few matrix products on the driver.

Defined results: a null url, or one without ``://``, has empty host and path,
fits no rule and is judged by the method; an empty table gives an empty table;
repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER
from .linear import fit

DIM = 4096
SIZES = (3, 4, 5)
MOST_LABELLED = 2000
MOST_RULES = 1000

#: Fixed values of the contract: (verdict, host, path prefix).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))

# The labelled URL table: unwanted hosts by what their names say, and ordinary ones.  Written for this operator.
UNWANTED = ("casino-win casino-royal best-casino online-casino slots-win jackpot-win poker-win free-bets sport-bets "
            "live-bets bets-now free-spins cheap-pills buy-pills pills-online cheap-meds adult-x adult-cam adult-video "
            "xxx-video porn-tube spam-farm link-farm content-farm seo-spam ads-track ad-server track-click click-ads "
            "ads-serve popup-ads fast-loans win-prize free-money").split()
ORDINARY = ("library museum weather gardening recipes history school university news journal science cooking travel "
            "music theatre harbour village forest mountain river thetion anderth onthere intheon erention thering "
            "thanhe ouhath ndthre tionhere therein areathe entles letter reading sports chess football tracker-dog "
            "advice address winter window better alphabet pillow spring").split()
PREFIXES = ("", "www.", "m.", "blog.")
DOMAINS = ("example.com", "example.net", "example.org")
PATHS = ("/en/12", "/de/771.html", "/fr/4409/", "/es/93", "/", "/a/b.html")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): 1 for unwanted."""
    rows = [(f"https://{PREFIXES[(i + j) % 4]}{h}.{d}{PATHS[(2 * i + j) % 6]}", label)
            for label, hosts in ((1, UNWANTED), (0, ORDINARY)) for i, h in enumerate(hosts) for j, d in enumerate(DOMAINS)]
    return spark.createDataFrame(rows, "url string, label int")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``rule`` and ``_ruled`` (its verdict) to rows with host and path; null where no rule fits."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [(F.col("host") == h) | F.col("host").endswith("." + h) for _, h, _ in ranked]
    fits = [f & F.col("path").startswith(p) for f, (_, _, p) in zip(fits, ranked, strict=True)]
    first = lambda value: F.coalesce(*[F.when(f, F.lit(value(r))) for f, r in zip(fits, ranked, strict=True)],
                                     F.lit(None).cast("string"))
    return pages.withColumns({"rule": first(lambda r: r[1] + r[2]), "_ruled": first(lambda r: r[0])})


def features(host: Column, path: Column) -> Column:
    """Distinct hashed n-grams (0 to DIM - 1) of host and path, with marked ends."""
    line = F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$"))
    grams = F.flatten(F.array(*[F.regexp_extract_all(line, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in SIZES]))
    return F.array_distinct(F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(DIM)).cast("int")))


def train(labelled: DataFrame, l2: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and bias from (url, label); the table is small by contract."""
    rows = labelled.select("url", F.col("label").cast("int").alias("label"),
                           features(host_of(F.col("url")), path_of(F.col("url"))).alias("f")).filter(
        "label is not null").limit(MOST_LABELLED + 1).collect()
    if len(rows) > MOST_LABELLED:
        raise ValueError(f"at most {MOST_LABELLED} labelled URLs")
    rows.sort(key=lambda r: (r["url"] or "", r["label"]))
    x = np.zeros((len(rows), DIM))
    for i, r in enumerate(rows):
        x[i, r["f"]] = 1 / np.sqrt(max(1, len(r["f"])))
    return fit(x, np.array([r["label"] for r in rows], float), l2)


def judge_urls(pages: DataFrame, labelled: DataFrame, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): score is the chance that a URL is unwanted."""
    weights, bias = train(labelled)
    w = F.split(F.lit(",".join(f"{x:.9g}" for x in weights)), ",").cast("array<double>")
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = with_rule(split, rules).withColumn("_f", features(F.col("host"), F.col("path")))
    total = F.aggregate("_f", F.lit(0.0), lambda acc, i: acc + F.element_at(w, i + 1))
    z = total / F.sqrt(F.greatest(F.size("_f"), F.lit(1)).cast("double")) + F.lit(bias)
    return (ruled.withColumn("score", F.round(1 / (1 + F.exp(-z)), 9))
            .select("page_id", "host", "path", "rule", F.coalesce("_ruled", F.when(
                F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score"))
