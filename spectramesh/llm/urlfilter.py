"""URL filter: rules first, else logistic regression on hashed character n-grams of host and path (operator 5, native).

Everything is a Column or SQL expression. The model is trained by full-batch gradient descent, folded over the epochs inside one
expression on a one-row DataFrame, from a labelled URL table that is small by its purpose (a row per known site); the driver reads
one row of weights and puts it into the scoring expression as a constant. Scoring is a projection: no shuffle and no join.

Null urls and urls without `://` have an empty host and path and are judged on those: verdict allow, as they hold no n-gram that
training blocked. Equal urls get equal verdicts. An empty labelled table: the method allows everything. Other columns of
the pages are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectramesh.llm.common import let, materialize

BUCKETS = 1 << 16
ORDERS = (3, 4, 5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words that tell a site's kind, the labelled table's whole knowledge: gambling, adult content, drugs by post, advertising and fraud against
#: everyday subjects. They were written down without a look at any table of pages.
UNWANTED = """casino poker slots roulette blackjack jackpot bingo betting bookmaker lottery gambling wager baccarat sportsbook bets
porn xxx sex nude erotic escorts webcams camgirls hentai fetish milf adult hookup lesbian lingerie
viagra cialis pharmacy pills steroids xanax tramadol weightloss painkillers meds
adserver adclick popunder banners tracker affiliate pixel adnetwork retargeting ads clicks
spam backlinks phishing malware keygen warez torrent cracked scam giveaway prizes followers"""
ORDINARY = """news times post herald journal magazine press radio weather science physics chemistry biology history geography math library university college school academy museum gallery theatre orchestra
garden kitchen recipes cooking bakery coffee wine travel hotel airline railway bus maps city council government parliament court police hospital clinic health medicine dentist nursing
software linux python database cloud developer engineering robotics electronics camera photo video music guitar piano choir film cinema books reading poetry writers dictionary grammar
football rugby tennis cycling running swimming hiking climbing sailing chess toys games kids family parents wedding fashion shoes jewelry furniture carpentry plumbing roofing painting
farm dairy forest river ocean birds horses dogs cats insects flowers trees energy solar climate recycling charity church temple mosque volunteer archive encyclopedia finance bank insurance taxes
market auction jobs career estate rental architecture bridge car motor bicycle train aviation space astronomy language translation culture philosophy religion society law notary"""
#: What surrounds the words in turn, the same for both kinds, so that it tells nothing.
NAMES = ("{}", "my{}", "{}online", "best-{}", "{}24", "the{}club", "{}-shop", "top{}", "{}world", "city-{}", "{}hub", "go{}")
SUFFIXES = (".com", ".org", ".net", ".example.com", ".info", ".co.uk", ".example.org", ".de", ".example.net")
PREFIXES, PATH_FORMS = ("", "www.", "m.", "blog."), ("/", "/en/{}", "/de/{}.html", "/fr/{}/", "/es/{}")
#: Urls of a word.
EACH = 4


def made_urls() -> list[tuple[str, int]]:
    """(url, label) of the table, 1: block. A word's place in its own list decides what surrounds it."""
    out = []
    for label, text in ((1, UNWANTED), (0, ORDINARY)):
        for i, word in enumerate(text.split()):
            for k in range(EACH):
                j = 5 * i + 7 * k
                host = PREFIXES[(i + k) % len(PREFIXES)] + NAMES[j % len(NAMES)].format(word) + SUFFIXES[(i + 2 * k) % len(SUFFIXES)]
                out.append((f"https://{host}{PATH_FORMS[(i + k) % len(PATH_FORMS)].format(100 + 37 * j % 9000)}", label))
    return out


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url, label of the table."""
    rows = [{"url": u, "label": y} for u, y in made_urls()]
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<url:string,label:int>>")))


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end; A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def grams(host: Column, path: Column) -> Column:
    """The distinct buckets of the n-grams of `^host$` and of the path, kept apart by a prefix."""

    def of(mark: str, text: Column, n: int) -> Column:
        last = F.length(text) - (n - 1)
        found = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.conv(F.substr(F.md5(F.concat(F.lit(mark), F.substr(text, i, F.lit(n)))), F.lit(1), F.lit(4)), 16, 10).cast("int"))
        return F.when(last >= 1, found).otherwise(F.array().cast("array<int>"))

    whole = F.concat(F.lit("^"), host, F.lit("$"))
    return F.array_distinct(F.concat(*(of("h", whole, n) for n in ORDERS), *(of("p", path, n) for n in ORDERS)))


def train(labelled: DataFrame, epochs: int = 200, rate: float = 1.0, decay: float = 1e-3) -> tuple[list[float], float]:
    """Weights by bucket, and the bias. labelled: url, label; rows with a null label are left out."""
    rows = labelled.where(F.col("label").isNotNull()).select("url", F.col("label").cast("double").alias("y"), grams(host_of(F.col("url")), path_of(F.col("url"))).alias("f"))
    # The labelled table is small by its purpose; its rows and its n-grams get numbers, and each list of the others' numbers is one shuffle.
    rows = materialize(rows.withColumn("i", F.row_number().over(Window.orderBy("url", "y")) - 1), "urls")
    seen = rows.select(F.explode("f").alias("h")).distinct().withColumn("k", F.row_number().over(Window.orderBy("h")) - 1)
    pairs = materialize(rows.select("i", F.explode("f").alias("h")).join(seen, "h"), "url_grams")
    listed = lambda key, other: F.sort_array(F.collect_list(F.struct(key, *other)))
    at = rows.select("i", "y").join(pairs.groupBy("i").agg(F.sort_array(F.collect_list("k")).alias("at")), "i", "left").withColumn("at", F.coalesce("at", F.array().cast("array<int>"))).agg(listed("i", ("y", "at")).alias("rows"), F.count("*").alias("n"))
    inside = pairs.groupBy("k", "h").agg(F.sort_array(F.collect_list("i")).alias("ids")).agg(listed("k", ("h", "ids")).alias("all"))
    table = at.crossJoin(inside).select("rows", "n", F.transform("all", lambda x: x["h"]).alias("seen"), F.transform("all", lambda x: x["ids"]).alias("inside"))
    table = materialize(table, "urls")  # a row; without a table between them, each epoch would compute the one before anew

    def sigmoid(z: Column) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def epoch(s: Column, _: Column) -> Column:
        left = F.transform("rows", lambda r: r["y"] - sigmoid(s["b"] + F.aggregate(r["at"], F.lit(0.0), lambda z, i: z + F.get(s["w"], i))))
        return let(
            left,
            lambda r: F.struct(
                F.transform("inside", lambda ids, i: F.get(s["w"], i) * (1 - rate * decay) + F.aggregate(ids, F.lit(0.0), lambda z, j: z + F.get(r, j)) * (F.lit(rate) / F.col("n"))).alias("w"),
                (s["b"] + F.aggregate(r, F.lit(0.0), lambda z, v: z + v) * (F.lit(rate) / F.col("n"))).alias("b"),
            ),
        )

    start = F.struct(F.transform("seen", lambda _: F.lit(0.0)).alias("w"), F.lit(0.0).alias("b"))
    model = table.where("n > 0").select("seen", F.aggregate(F.sequence(F.lit(1), F.lit(epochs)), start, epoch).alias("m")).select("seen", "m.w", "m.b").first()
    if model is None:
        return [0.0] * BUCKETS, -1.0
    weights = [0.0] * BUCKETS
    for at, w in zip(model.seen, model.w, strict=True):
        weights[at] = w
    return weights, model.b


def probability(url: Column, weights: list[float], bias: float) -> Column:
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    z = F.aggregate(grams(host_of(url), path_of(url)), F.lit(bias), lambda s, i: s + F.get(table, i))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict. rules: (`host/path`, verdict); a host's rule holds for its subdomains."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(slash + p))
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score (the model's, also where a rule decides)."""
    weights, bias = train(labelled_urls(pages.sparkSession) if labelled is None else labelled)
    parts = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    name, says = rule_of(F.col("host"), F.col("path"), rules)
    scored = parts.select("page_id", "host", "path", name.alias("rule"), says.alias("says"), probability(F.col("url"), weights, bias).alias("score"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("says", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
