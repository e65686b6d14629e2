"""URL filters: host and path rules, and for the rest a ratio of character language models, with DataFrame functions only.

URLs that a rule decides are the accepted and rejected examples (the rules stand for a curated list). Each class gets a
variable-order Markov model: a character's probability given up to four before it mixes with the one given fewer,
weighted by how often and with how many followers the longer context was seen (Witten-Bell), down to a uniform one. A URL's
score is the mean log-likelihood difference per character. The models learn from four fifths of the distinct example
URLs; on the others the scores' means and deviations calibrate the threshold between the classes.

Defined results: a null url or one without "://" has an empty host and path and no rule; URLs are scored as host and path, an
empty one with 0.0; without examples of both classes the threshold is 0.0; repeated rows are judged each; an empty
table gives no rows; extra columns are kept by judge() unless their names clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import FEW_ROWS, lower_ascii, scratch, stored

#: The rules of the contract.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
ORDER = 5
START, END = "\x02", "\x03"
UNIFORM = 1 / 256
SALTS = 16  # parts of a gram's rows, where the ratios are too many to broadcast


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return lower_ascii(host), path


def _fits(host: Column, path: Column, rule: str) -> Column:
    domain, _, rest = rule.partition("/")
    return ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit("/" + rest))


def _grams(text: Column) -> Column:
    """The text's ORDER-grams, one for each character and the end."""
    chars = F.split(F.concat(F.lit(START * (ORDER - 1)), text, F.lit(END)), "")
    chars = F.filter(chars, lambda c: c != "")
    # the characters are bound to a variable, else they would be split again for each gram
    made = F.transform(F.array(chars), lambda own: F.transform(F.slice(own, 1, F.size(own) - ORDER + 1), lambda c, i: F.concat(*(F.get(own, i + k) for k in range(ORDER)))))
    return F.get(made, F.lit(0))


def _ratios(examples: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, ratio) for the wanted grams: log P(accepted) - log P(rejected) of the last character."""
    top = stored(examples.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r")), "url-grams")
    found = wanted
    for k in range(1, ORDER + 1):
        level = top.groupBy(F.substring("gram", ORDER - k + 1, k).alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        context = level.groupBy(F.substring("g", 1, k - 1).alias("h")).agg(
            *(F.sum(c).alias(f"n{c}") for c in "ar"), *(F.sum((F.col(c) > 0).cast("long")).alias(f"t{c}") for c in "ar")
        )
        known = level.join(context, F.substring("g", 1, k - 1) == F.col("h")).drop("h")
        here = F.substring("gram", ORDER - k + 1, k)
        found = found.join(known.select("g", *(F.col(c).alias(f"{c}{k}") for c in "ar")), here == F.col("g"), "left").drop("g")
        found = found.join(context.select("h", *(F.col(c).alias(f"{c}{k}") for c in ("na", "nr", "ta", "tr"))), F.substring("gram", ORDER - k + 1, k - 1) == F.col("h"), "left").drop("h")

    def probability(c: str) -> Column:
        p = F.lit(UNIFORM)
        for k in range(1, ORDER + 1):
            n, total, types = (F.coalesce(F.col(x), F.lit(0)) for x in (f"{c}{k}", f"n{c}{k}", f"t{c}{k}"))
            p = F.when(total > 0, (n + types * p) / (total + types)).otherwise(p)
        return p

    return found.select("gram", (F.ln(probability("a")) - F.ln(probability("r"))).alias("ratio"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages with host, path, rule, url_score and verdict."""
    pages = pages.drop("host", "path", "rule", "url_score", "verdict")
    host, path = parts(F.col("url"))
    located = pages.withColumn("host", host).withColumn("path", path)
    longest = sorted(rules, key=lambda r: -len(r[0]))
    rule = reduce(lambda rest, r: F.when(_fits(F.col("host"), F.col("path"), r[0]), F.lit(r[0])).otherwise(rest), reversed(longest), F.lit(None).cast("string"))
    ruled = located.withColumn("rule", rule).withColumn("_text", F.concat("host", "path"))
    verdict = reduce(lambda rest, r: F.when(F.col("rule") == r[0], F.lit(r[1])).otherwise(rest), rules, F.lit(None).cast("string"))

    with scratch(pages.sparkSession):
        scores, threshold = _scores(ruled, verdict)
    scored = ruled.join(scores.select("_text", "url_score"), "_text", "left")
    method = F.when(F.coalesce("url_score", F.lit(0.0)) >= threshold, "allow").otherwise("block")
    return scored.withColumn("verdict", F.coalesce(verdict, method)).drop("_text")


def _scores(ruled: DataFrame, verdict: Column) -> tuple[DataFrame, float]:
    """(_text, known, url_score) of what the models judge, stored, and the threshold between the classes."""
    texts = ruled.groupBy("_text").agg(F.max(verdict).alias("known"))
    texts = stored(texts.withColumn("part", F.when(F.col("known").isNull(), -1).otherwise(F.pmod(F.xxhash64("_text"), F.lit(5)).cast("int"))), "url-texts")
    dealt = texts.repartition(int(ruled.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_text")  # few bytes, many grams
    yes = lambda c: (F.col("known") == c).cast("long")
    examples = dealt.where("part > 0").select(F.explode(_grams(F.col("_text"))).alias("gram"), yes("allow").alias("a"), yes("block").alias("r"))
    judged = dealt.where("part <= 0").select("_text", "known", F.explode(_grams(F.col("_text"))).alias("gram"))
    ratios = stored(_ratios(examples, judged.select("gram").distinct()), "url-ratios")
    if ratios.count() <= FEW_ROWS:
        valued = judged.join(F.broadcast(ratios), "gram")
    else:  # the grams that begin every URL would meet in one task
        salted = ratios.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        valued = judged.withColumn("salt", F.pmod(F.xxhash64("_text"), F.lit(SALTS)).cast("int")).join(salted, ["gram", "salt"])
    scores = stored(valued.groupBy("_text", "known").agg(F.avg("ratio").alias("url_score")), "url-scores", keep=True)

    stats = {r["known"]: r for r in scores.where("known is not null").groupBy("known").agg(F.avg("url_score").alias("mean"), F.stddev_pop("url_score").alias("sd")).collect()}
    threshold = 0.0
    if len(stats) == 2:
        (ma, sa), (mr, sr) = ((stats[k]["mean"], stats[k]["sd"] + 1e-3) for k in ("allow", "block"))
        threshold = (ma * sr + mr * sa) / (sa + sr)
    return scores, threshold


def digest(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
