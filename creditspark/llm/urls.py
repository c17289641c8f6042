"""URL filter: rules first, then gradient-boosted trees on lexical features.

Host: what follows the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; path: from there up to `?`, `#` or the end.  A rule
fits its host and all subdomains if the path starts with the rule's; the longest rule wins.  The verdict
of other URLs comes from Spark's gradient-boosted trees on length, depth, digit ratio, entropy, parameter
counts and statistics of the host's suffixes, trained on labelled URLs.

Suffix statistics: among the labelled URLs, the smoothed share of blocked ones per last label and per last two labels
of the host; a suffix that is not among them has the share of all.  The table is as small as the labelled set.

Defined cases: a null URL, or one without `://`, has an empty host and path, no rule, and is judged on its (empty) features;
repeated rows are judged each; an empty labelled set, or one of a single class, gives that class (allow if empty)
without a fit; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path), as given.
RULES = (
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
)
TREES, DEPTH = 20, 3
#: Labelled rows the fit reads at most, by hash of the URL.
FIT_ROWS = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Site names of the labelled URLs (fixed values of this module).
_GOOD = ("library", "weather", "thetimes", "northern", "gardenia", "histories", "openmaps", "oration", "readers", "museum",
         "physics", "cooking", "sherring", "tionally", "river-museum", "thorough", "anthology", "lindenau", "escuela", "bretagne")
_BAD = ("cheap-meds", "win-casino", "free-slots", "ads-serve", "track-clicks", "xxx-cams", "hot-deals24", "spam-links", "loan-4-you",
        "best-pills", "cash-now", "pay-day-loan", "adult-cam", "bet-free", "click-farm", "get-rich7", "mega-win", "vip-escort", "dl-warez", "seo-boost")


def host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as host and path in one string; null if none does."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in longest]
    return reduce(lambda rest, x: F.when(x[0], F.lit(x[1][1] + x[1][2])).otherwise(rest),
                  reversed(list(zip(fits, longest))), F.lit(None).cast("string"))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url and label (1: to be blocked), built from the site names; suffixes, paths and protocols are spread evenly."""
    rows = []
    paths = ("/en/{n}", "/de/{n}/", "/fr/{n}.html", "/es/{n}?page=2&ref=x", "/en/{n}#top", "/about/{n}?utm_source=feed")
    for label, names in ((0, _GOOD), (1, _BAD)):
        for i, (name, end, front) in enumerate(product(names, ("com", "org", "net"), ("", "www.", "blog.", "m."))):
            at = paths[i % len(paths)].format(n=37 * i % 1000)
            rows.append((f"http{'s' * (i % 2)}://{front}{name}.example.{end}{at}", label))
    return spark.createDataFrame(rows, "url string, label int")


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def _count(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{pattern}]", "")).cast("double")


def lexical(urls: DataFrame) -> DataFrame:
    """`urls` (a column url) with host, path, the suffixes and the lexical features; no Python, no shuffle."""
    df = urls.withColumn("_u", F.coalesce("url", F.lit(""))).withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    query = F.regexp_extract("_u", r"(?s)^[^?#]*\?([^#]*)", 1)
    n = F.length("_u")
    letters = F.array_distinct(F.split(F.col("_u"), ""))
    p = F.transform(F.filter(letters, lambda c: c != ""), lambda c: (n - F.length(F.replace(F.col("_u"), c, F.lit("")))) / n)
    labels = F.split("host", r"\.")
    longest = F.array_max(F.transform(labels, lambda x: F.length(x)))
    return df.withColumns({
        "f_length": n.cast("double"),
        "f_host": F.length("host").cast("double"),
        "f_label": F.coalesce(longest, F.lit(0)).cast("double"),
        "f_path": F.length("path").cast("double"),
        "f_depth": _count(F.regexp_replace(F.col("path"), "/+$", ""), "/"),
        "f_labels": _count(F.col("host"), "."),
        "f_digits": _share(_count(F.col("_u"), "0-9"), n),
        "f_host_digits": _share(_count(F.col("host"), "0-9"), F.length("host")),
        "f_hyphens": _count(F.col("host"), "-"),
        "f_entropy": -F.aggregate(p, F.lit(0.0), lambda a, x: a + x * F.log2(x)),
        "f_parameters": F.when(query == "", 0.0).otherwise(_count(query, "&") + 1),
        "_s1": F.element_at(labels, -1),
        "_s2": F.substring_index("host", ".", -2),
    }).drop("_u")


def _with_suffixes(df: DataFrame, stats: dict[str, DataFrame], rate: float) -> DataFrame:
    for name, table in stats.items():
        df = df.join(F.broadcast(table), name, "left").withColumn(  # one row per suffix of the labelled set
            f"f{name}", F.coalesce(f"f{name}", F.lit(rate)))
    return df


FEATURES = ("f_length", "f_host", "f_label", "f_path", "f_depth", "f_labels", "f_digits", "f_host_digits", "f_hyphens",
            "f_entropy", "f_parameters", "f_s1", "f_s2")


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (of the trees, 0 to 1, higher: block) of every row."""
    labelled = labelled_urls(pages.sparkSession) if labelled is None else labelled
    sample = labelled.where("label in (0, 1)").orderBy(F.xxhash64("url"), "url").limit(FIT_ROWS)
    known = lexical(sample).persist()
    rows = lexical(pages.select("page_id", "url"))
    try:
        n, bad = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
        if bad in (0, n):
            scored = rows.withColumn("score", F.lit(1.0 if n and bad == n else 0.0))
        else:
            rate = bad / n
            stats = {s: known.groupBy(s).agg(((F.sum("label") + 10 * rate) / (F.count(F.lit(1)) + 10)).alias(f"f{s}"))
                     for s in ("_s1", "_s2")}
            gather = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
            points = gather.transform(_with_suffixes(known, stats, rate)).select("features", F.col("label").cast("double"))
            model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=3).fit(points.repartition(1).persist())
            points.unpersist()
            scored = model.transform(gather.transform(_with_suffixes(rows, stats, rate)))
            scored = scored.withColumn("score", vector_to_array("probability")[1])
    finally:
        known.unpersist()
    verdicts = {h + p: v for v, h, p in rules}
    by_rule = reduce(lambda rest, kv: F.when(F.col("rule") == kv[0], F.lit(kv[1])).otherwise(rest), verdicts.items(),
                     F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.withColumn("rule", rule(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", "rule", by_rule.alias("verdict"), "score")
