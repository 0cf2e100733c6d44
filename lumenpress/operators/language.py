"""Language of texts by profiles of characters: naive Bayes over runs of one to three letters, trained on labelled texts.

Defined cases: texts under 20 characters and null ones are "unknown" with confidence 0, and so is a text without any known
run; of equal sums the first language by name wins; a null label trains nothing; without training rows all are unknown.
Ids are unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..scratch import saved

# Characters that are looked at, and the fewest that are judged.
SAMPLE, LEAST = 500, 20
#: Runs kept of each language, the most frequent; bounds what every task gets by the number of languages.
PROFILE = 3000
#: Log probabilities in whole millionths, so that sums are the same in any order.
UNIT = 1_000_000


def sample(text: Column) -> Column:
    return F.substring(F.trim(F.coalesce(text, F.lit(""))), 1, SAMPLE)


def runs(text: Column) -> Column:
    """Runs of one to three characters of the sample in lower case, all but letters as one space, a space at both ends."""
    text = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(sample(text)), r"[^\p{L}]+", " ")), F.lit(" "))

    def of(t: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))

    return F.filter(X.once(text, lambda t: F.concat(*(of(t, n) for n in (1, 2, 3)))), lambda g: F.trim(g) != "")


def profiles(labelled: DataFrame) -> DataFrame:
    """(gram, language, weight) of labelled texts (text, language): log of (count + 1) / (total + kept), for each kept run and language.

    Runs are those among the PROFILE most frequent of some language. A written table.
    """
    each = labelled.filter("language is not null").select("language", F.explode(runs(F.col("text"))).alias("gram")).groupBy("language", "gram").agg(F.count(F.lit(1)).alias("n"))
    each = saved(each, "language-runs")
    best = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "gram"))
    grams = each.withColumn("r", best).filter(F.col("r") <= PROFILE).select("gram").distinct()
    kept = each.join(grams, "gram", "left_semi")
    total = kept.groupBy("language").agg(F.sum("n").alias("total"))
    totals = total.agg(F.collect_list(F.struct("language", "total")).alias("t")).scalar()  # a row per language
    size = grams.agg(F.count(F.lit(1)).alias("n")).scalar()
    # every language has a weight for every run, also for those it doesn't have; both tables are bounded
    d = grams.withColumn("total", F.explode(totals)).select("gram", "total.*").join(kept, ["gram", "language"], "left")
    return saved(d.select("gram", "language", F.round(F.log((F.coalesce("n", F.lit(0)) + 1) / (F.col("total") + size)) * UNIT).cast("long").alias("weight")), "language-profiles")


def detect(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(id, language, confidence) of docs (id, text) by profiles."""
    short = F.length(sample(F.col("text"))) < LEAST
    each = docs.filter(~short).select("id", F.explode(runs(F.col("text"))).alias("gram")).groupBy("id", "gram").agg(F.count(F.lit(1)).alias("n"))
    sums = each.join(F.broadcast(known), "gram").groupBy("id", "language").agg(F.sum(F.col("n") * F.col("weight")).alias("s"))
    top = sums.groupBy("id").agg(F.max("s").alias("top"))
    d = sums.join(top, "id").groupBy("id").agg(F.min(F.when(F.col("s") == F.col("top"), F.col("language"))).alias("language"), F.round(1 / F.sum(F.exp((F.col("s") - F.col("top")) / UNIT)), 4).alias("confidence"))
    return docs.select("id").join(d, "id", "left").select("id", F.coalesce("language", F.lit("unknown")).alias("language"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
