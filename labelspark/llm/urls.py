"""URL filters: explicit rules first, then a linear model over character n-grams.

The model is a logistic regression over hashed n-grams of host and path, fitted
on a small labelled table.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspark.session import new_folder

GRAMS = (3, 4, 5)
BUCKETS = 1 << 14
RIDGE = 0.01

# Labelled URLs: what a filter for training data should keep and should not.
BLOCKED = [
    "http://www.online-casino.test/", "https://casino-royal.test/en/1", "http://m.best-casino.test/slots/22",
    "http://casino-bonus.test/win/7", "https://play-poker.test/de/77", "http://www.free-poker.test/table/5",
    "https://sports-bets.test/fr/12", "http://best-bets.test/en/today", "http://bets-online.test/8", "https://blog.win-bets.test/es/3",
    "http://cheap-meds.test/en/44", "https://www.pills-shop.test/9", "http://discount-pills.test/fr/10", "http://buy-pills.test/en/1",
    "https://cheap-viagra.test/order/2", "http://www.cheap-watches.test/sale/30",
    "http://ads-server.test/click/1", "https://ads-network.test/en/99", "http://m.track-ads.test/7", "http://pixel-track.test/p/1",
    "http://click-track.test/en/6", "https://banner-ads.test/44",
    "http://xxx-videos.test/1", "https://www.adult-cams.test/en/5", "http://free-porn.test/de/8", "http://adult-x.test/en/40",
    "https://m.adult-chat.test/fr/2", "http://www.adult-x-tube.test/1", "https://adult-dating.test/es/3", "https://hot-singles.test/fr/6",
    "http://free-money.test/en/2", "https://win-prizes.test/es/81", "http://fast-loans.test/en/15", "https://www.payday-loans.test/3",
    "http://free-downloads-crack.test/10", "http://warez-crack.test/en/7", "https://lottery-win.test/en/4", "http://jackpot-win.test/2",
]
ALLOWED = [
    "http://www.city-library.test/en/1", "https://university.test/de/12", "http://blog.gardening.test/fr/3", "https://news.daily.test/es/44",
    "http://recipes.test/en/7", "https://www.museum.test/en/15", "http://history.test/fr/8", "https://m.weather.test/de/9",
    "http://science.test/en/22", "https://blog.travel.test/es/5", "http://www.school.test/en/31", "https://poetry.test/de/6",
    "http://mountain.test/en/100", "https://station.test/fr/71", "http://www.then.test/en/5", "https://blog.thering.test/de/61",
    "http://nation.test/es/2", "https://m.other.test/en/18", "http://motion.test/fr/33", "https://thand.test/en/250",
    "http://www.theory.test/en/3000", "https://ether.test/de/411", "http://blog.ontion.test/en/95", "http://weather.test/es/1234",
    "https://thonster.test/en/6652.html", "http://m.athena.test/fr/7424/", "https://www.inthe.test/de/890", "http://erring.test/en/8",
    "https://stand.test/en/1921", "http://blog.orthern.test/de/7", "https://tions.test/es/4163", "http://handle.test/fr/2",
    "https://www.butter.test/en/1", "http://bridge.test/en/64",
]

# (action, host, path); a rule covers its host, all subdomains, and paths it starts
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = _rest(url)
    end = F.regexp_instr(rest, F.lit("[/?#]"))
    host = F.when(end > 0, F.substring(rest, F.lit(1), end - 1)).otherwise(rest)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty where there is none."""
    return F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as struct(rule, action), or null.

    ``rules`` is a short list that becomes part of the expression.
    """
    out = F.lit(None).cast("struct<rule: string, action: string>")
    for action, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def _gram(text: Column, mark: str, n: int):
    return lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n)))


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, marked by part, without digits.

    Numbers in a path say nothing about a site. Empty parts give no n-gram.
    """
    found = []
    for mark, part in (("h", host), ("p", path)):
        letters = F.regexp_replace(part, "[0-9]+", "0")
        framed = F.concat(F.lit("^"), letters, F.lit("$"))
        for n in GRAMS:
            places = F.when(
                (F.length(letters) > 0) & (F.length(framed) >= n), F.sequence(F.lit(1), F.length(framed) - (n - 1))
            ).otherwise(F.array().cast("array<int>"))
            found.append(F.transform(places, _gram(framed, mark, n)))
    return F.concat(*found)


def fit(spark: SparkSession, blocked: list[str] = BLOCKED, allowed: list[str] = ALLOWED) -> PipelineModel:
    """Fit the model on a small labelled table, which fits one partition.

    It is saved and loaded again: a model that was just fitted holds on to the tables of
    its fit, which must not travel with the tasks that score.
    """
    rows = [(u, 1.0) for u in blocked] + [(u, 0.0) for u in allowed]
    table = spark.createDataFrame(rows, "url string, label double").coalesce(1)
    table = table.select(grams(host_of(F.col("url")), path_of(F.col("url"))).alias("_grams"), "label")
    hashed = HashingTF(inputCol="_grams", outputCol="_vector", numFeatures=BUCKETS, binary=True)
    linear = LogisticRegression(featuresCol="_vector", labelCol="label", probabilityCol="_chances", rawPredictionCol="_raw",
                                predictionCol="_class", regParam=RIDGE, standardization=False, maxIter=100)
    path = new_folder(spark, "url-model")
    Pipeline(stages=[hashed, linear]).fit(table).save(path)
    return PipelineModel.load(path)


def judge(pages: DataFrame, rules: list[Rule], model: PipelineModel) -> DataFrame:
    """``page_id`` with host, path, rule, verdict and the model's chance of block.

    A null url, or one without ``://``, has an empty host and path. It fits no
    rule and has no n-gram; the verdict is then the model's for no evidence. Other
    columns are not read; repeated rows are judged alike.
    """
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ready = split.withColumn("_grams", grams(F.col("host"), F.col("path")))
    scored = model.transform(ready).withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    chance = F.element_at(vector_to_array("_chances"), 2)
    verdict = F.coalesce("_rule.action", F.when(chance >= 0.5, "block").otherwise("allow"))
    return scored.select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), chance.alias("block_chance")
    )
