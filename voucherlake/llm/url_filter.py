"""URL filter: allow and block rules, and for the rest a logistic regression on hashed character n-grams.

Everything is a DataFrame expression or a Spark ML stage: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hashed dimensions of n-grams, and the sizes of n-grams.
DIMENSIONS, GRAMS = 1 << 14, (3, 4, 5)
#: So many rules stand in the plan itself; more are joined by host.
INLINE_RULES = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# A small labelled URL table. Names as hosts of advertising, pills, betting, adult sites, spam and fraud have
# them, and English names of ordinary sites; each stands under several subdomains, endings and paths (see labelled_urls), which
# thereby tell nothing. Words of the one kind also stand in names of the other (free-software, link-farm and farmers-market).
BLOCKED_NAMES = [
    "adserver", "ad-network", "ads-popup", "banner-ads", "clicktracker", "track-users", "pixel-track", "popunder", "cheap-meds", "cheap-viagra",
    "online-pills", "pill-shop", "discount-pharma", "free-casino", "royal-casino", "casino-bonus", "win-big", "win-cash", "poker-room",
    "slots-jackpot", "sports-bets", "betting-odds", "live-bets", "free-spins", "adult-video", "adult-chat", "adult-dates", "adult-movies", "xxx-tube", "x-rated", "sex-cams",
    "escort-dates", "spam-mail", "spam-relay", "link-farm", "click-farm", "payday-loans", "replica-watches", "warez-crack", "phish-login",
    "malware-drop", "miracle-diet",
]
ORDINARY_NAMES = [
    "library", "weather", "history-notes", "school", "garden", "museum", "travel-notes", "recipes", "science", "city-hall", "newsroom",
    "cycling", "books", "open-data", "mountain", "river-walks", "theatre", "northern-lights", "teacher", "kitchen", "hospital", "university",
    "railway", "farmers-market", "free-software", "winter-sports", "railway-tracks", "adult-education", "health", "forum", "music", "photos",
    "maps", "chess", "astronomy", "biology", "translation", "dictionary", "bread", "tea-house", "harbour", "lighthouse", "anthology", "thread",
    "thunder", "together", "southern-coast", "weekend", "gathering", "feathers", "another-day", "meditation", "stationery", "nation-parks",
    "athletics", "mathematics", "orchestra", "heritage", "threshold", "shoreline", "what-is-new", "hat-makers",
]
SUBDOMAINS = ["", "www.", "blog.", "m."]
ENDINGS = [".example.com", ".example.net", ".example.org"]
PATHS = ["/en/{n}", "/de/{n}/", "/fr/{n}.html", "/es/{n}?page=2&ref=x", "/en/{n}#top", "/{n}?utm_source=feed"]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): label 1 for the hosts to block, 0 for ordinary ones."""
    rows = [
        (f"https://{SUBDOMAINS[(i + k) % 4]}{name}{ENDINGS[(i + k) % 3]}{PATHS[(i + k) % 6].format(n=37 * i + 11 * k)}", label)
        for label, names in ((1.0, BLOCKED_NAMES), (0.0, ORDINARY_NAMES))
        for i, name in enumerate(names)
        for k in range(6)
    ]
    return spark.createDataFrame(rows, "url string, label double")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) after the first `://` and the path up to `?` or `#`; both empty without one."""
    cut = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(text, cut, 1), UPPER, LOWER), F.regexp_extract(text, cut, 2)


def _grams(text: Column, mark: str) -> Column:
    """The character n-grams of a text, with its ends marked."""
    signs = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
    size = F.size(signs)

    def of(n: int) -> Column:
        starts = F.when(size >= n, F.sequence(F.lit(0), size - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), *[F.get(signs, i + k) for k in range(n)]))

    return F.concat(*[of(n) for n in GRAMS])


def _hashed(pages: DataFrame, host: str, path: str) -> DataFrame:
    grams = pages.withColumn("__grams", F.concat(_grams(F.col(host), "h"), _grams(F.col(path), "p")))
    return HashingTF(numFeatures=DIMENSIONS, binary=True, inputCol="__grams", outputCol="__features").transform(grams)


def train(labelled: DataFrame) -> LogisticRegressionModel:
    """A logistic regression over labelled (url, label); it is a small table, by contract of the filter."""
    host, path = host_and_path(F.col("url"))
    rows = _hashed(labelled.select(host.alias("__host"), path.alias("__path"), "label"), "__host", "__path")
    return LogisticRegression(featuresCol="__features", labelCol="label", maxIter=60, regParam=0.01).fit(rows)


def _inline(rules: list[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """The longest rule (verdict, host, path) that fits, as a struct (rule, verdict), or null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))
    table = F.array(
        *[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for v, h, p in ordered]
    )
    fits = F.filter(table, lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"]))
    return F.get(fits, 0)


def _joined(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(__host, __path, __rule, __verdict) of the distinct hosts and paths that a rule fits, by a join on host suffixes."""
    keys = urls.select("__host", "__path").distinct()
    labels = F.split("__host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    cut = keys.select("__host", "__path", F.explode(suffixes).alias("host"))
    found = cut.join(rules, "host").where(F.col("__path").startswith(F.col("path")))
    text = F.concat("host", "path")
    best = F.min(F.struct((-F.length(text)).alias("n"), text.alias("rule"), F.col("verdict").alias("verdict")))
    return found.groupBy("__host", "__path").agg(best.alias("b")).select("__host", "__path", F.col("b.rule").alias("__rule"), F.col("b.verdict").alias("__verdict"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of pages (page_id, url).

    rules: (verdict, host, path) rows; a rule fits its host and all subdomains if the path starts with its own; of those
    that fit the longest text wins, of equals the first by text, then by verdict. Without a fitting rule, rule is null and the
    verdict is `block` if the score (the probability of a host to block) is 0.5 or more. Null, empty and other urls without
    `://` have empty host and path and are judged by the score of those. Rows keep their count; page_id may be null or
    repeat; other columns are not read. No rules, or an empty table, are fine.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("__host"), path.alias("__path"))
    if isinstance(rules, DataFrame):
        some = rules.select("verdict", "host", "path").distinct().limit(INLINE_RULES + 1).collect()
        rules = [tuple(r) for r in some] if len(some) <= INLINE_RULES else rules.select("verdict", "host", "path")
    if isinstance(rules, DataFrame):
        ruled = urls.join(_joined(urls, rules), ["__host", "__path"], "left")
    elif rules:
        ruled = urls.withColumn("__r", _inline(rules, F.col("__host"), F.col("__path")))
        ruled = ruled.select("page_id", "__host", "__path", F.col("__r.rule").alias("__rule"), F.col("__r.verdict").alias("__verdict"))
    else:
        ruled = urls.withColumns({"__rule": F.lit(None).cast("string"), "__verdict": F.lit(None).cast("string")})
    model = train(labelled if labelled is not None else labelled_urls(spark))
    model = model.setFeaturesCol("__features").setProbabilityCol("__p").setPredictionCol("").setRawPredictionCol("")
    scored = model.transform(_hashed(ruled, "__host", "__path"))
    score = vector_to_array("__p")[1]
    return scored.select(
        "page_id",
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.col("__rule").alias("rule"),
        F.coalesce("__verdict", F.when(score >= 0.5, "block").otherwise("allow")).alias("verdict"),
        score.alias("score"),
    )
