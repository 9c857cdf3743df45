"""Operator 5 [native]: URL filter of rules and a logistic regression on character n-grams."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Verdict and rule (host, then path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: The labelled URLs: 1 is blocked. Words of the subjects that block lists commonly have (games of chance, adult, pills, loans,
#: pirated goods, fraud, advertising and tracking), and three plain words for each; the plain ones' share makes the model allow
#: a host that it knows nothing of. Hosts are made up and taken from no table.
_BLOCKED_WORDS = tuple(
    """casino poker jackpot roulette gambling betting slots lottery pills viagra pharmacy loan payday cash adult dating xxx
    keygen warez torrent replica spam scam phishing malware clickbait ads adserver popup banner tracker tracking""".split()
)
_PLAIN_WORDS = tuple(
    """library weather museum garden school history recipes travel science music blog news sports health forum docs
    kitchen village church river mountain theatre cinema gallery archive letters university college research physics
    chemistry biology medicine hospital council transport railway harbour airport market farming fishing forest
    cycling walking football tennis chess painting poetry novels grammar language teacher student parents children
    society coffee bread cheese orchard meadow valley island ocean desert castle bridge tower station
    street square camera pencil paper window carpet furniture clothing winter summer autumn spring morning evening
    planet comet galaxy insect bird horse sheep violin piano guitar choir opera dancing sculpture weaving pottery""".split()
)
#: Shapes of hosts, alike for both labels.
_SHAPES = ("{}", "my-{}", "{}-online", "best-{}", "{}4you")
_PLACES = ("com", "net", "org")
_PATHS = ("/en/12", "/de/7541/", "/fr/825", "/es/3210.html", "")
BUCKETS = 1 << 14
GRAMS = (3, 4, 5)


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without "://" or for null."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to "?", "#" or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """(verdict, rule) of the longest rule whose host is the url's or above it, and whose path the url's starts with."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def _cut(part: Column, at: Column, n: int, mark: str) -> Column:
    return F.transform(at, lambda i: F.concat(F.lit(mark), F.substring(part, i, F.lit(n))))


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, marked with the part they are from."""
    parts = []
    for mark, part in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(F.lit("^"), F.regexp_replace(path, "[0-9]+", "0"), F.lit("$")))):
        for n in GRAMS:
            at = F.when(F.length(part) >= n, F.sequence(F.lit(1), F.length(part) - n + 1)).otherwise(F.array().cast("array<int>"))
            parts.append(_cut(part, at, n, mark))
    return F.concat(*parts)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table: every word with every path, each under another shape and place (670 rows)."""
    rows = [
        (f"https://{'www.' * (i % 2)}{_SHAPES[(i + j) % 5].format(word)}.example{i % 3 or ''}.{_PLACES[(i + j) % 3]}{path}", label)
        for label, words in ((1.0, _BLOCKED_WORDS), (0.0, _PLAIN_WORDS))
        for i, word in enumerate(words)
        for j, path in enumerate(_PATHS)
    ]
    return spark.createDataFrame(rows, "url string, label double")


def _features(urls: DataFrame) -> DataFrame:
    return HashingTF(inputCol="__grams", outputCol="__features", numFeatures=BUCKETS, binary=True).transform(urls.withColumn("__grams", grams(host_of(F.col("url")), path_of(F.col("url")))))


def fit(labelled: DataFrame) -> LogisticRegressionModel:
    """Logistic regression on (url, label 0/1); rows with a null in either are left out."""
    rows = labelled.select("url", F.col("label").cast("double").alias("label")).where("url is not null and label is not null").coalesce(1)
    return LogisticRegression(featuresCol="__features", labelCol="label", regParam=0.001, maxIter=60).fit(_features(rows))


def weights(model: LogisticRegressionModel) -> tuple[list[float], float]:
    """The weight of each bucket of ``grams``, and the intercept."""
    return list(map(float, model.coefficients.toArray())), float(model.intercept)


def judge(pages: DataFrame, model: LogisticRegressionModel, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """``page_id`` with host, path, rule, verdict and the model's chance that the url is to be blocked.

    The longest fitting rule decides, else the model. Null urls and urls
    without "://" have an empty host and path, fit no rule and are judged by
    the model like any other. Repeated rows stay repeated; an empty table
    gives an empty result; extra columns are ignored.
    """
    from pyspark.ml.functions import vector_to_array

    urls = pages.select("page_id", "url")
    parts = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    ruled = parts.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    scored = model.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("__p").transform(_features(ruled))
    score = vector_to_array("__p")[1]
    return scored.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.when(score > 0.5, "block").otherwise("allow")).alias("verdict"), score.alias("block_score")
    )
