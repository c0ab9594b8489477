"""What columns hold by the evidence of their words: person names, birth dates, and the region of phone numbers.

Lexicons are tables (word, kind), not code: words of values are rows that meet the lexicon in a join, which Spark
broadcasts while the lexicon is small and shuffles when it is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.functions import phones as P
from lakeward.functions.addresses import address_strength
from lakeward.functions.dates import parse_date, plain_text
from lakeward.functions.evidence import BORN_MEDIAN, BORN_RECENT, BORN_SPREAD, ENTITIES, GIVEN, NAME_SHARE, PARTICLES, RECENT_YEAR, SURNAMES, TITLES

GIVEN_SHARE, ENTITY_SHARE = 0.25, 0.2
#: Shares of values that are addresses, and of strong ones where weak ones count; and strong values in running texts.
ADDRESS_SHARE, MIXED_SHARE, MIXED_STRONG, TEXT_COUNT, TEXT_SHARE = 0.5, 0.8, 0.25, 3, 0.1
_NAME_WORD = "^\\p{Lu}[\\p{L}'’.-]*$"


def small_lexicon(spark: SparkSession) -> DataFrame:
    """Some common words; a real lexicon is a table of the same columns (word without marks and in lower case, kind)."""
    kinds = {"given": GIVEN, "family": SURNAMES, "title": TITLES, "particle": PARTICLES, "entity": ENTITIES}
    return spark.createDataFrame([(w, kind) for kind, words in kinds.items() for w in sorted(words)], "word string, kind string")


def name_columns(values: DataFrame, lexicon: DataFrame) -> DataFrame:
    """object, field, n, named, given, entities, person_name for columns of values (object, field, value).

    A value counts as a name if it has one to five words without titles and particles, all written like names, of
    which one is a given or family name. A column holds names if most values do, some of them
    given names, and few name a place or a company. Values are counted once for each time they occur.
    """
    known = values.where("value is not null and trim(value) <> ''").groupBy("object", "field", "value").agg(F.count("*").alias("n"))
    words = F.filter(F.split("value", "[\\s,]+"), lambda w: w != "")
    places = known.select("object", "field", "value", F.posexplode(words).alias("place", "word")).withColumn("folded", F.regexp_replace(plain_text(F.col("word")), "[.]+$", ""))
    met = places.join(lexicon.withColumnRenamed("word", "folded"), "folded", "left")
    is_kind = lambda *kinds: F.coalesce(F.bool_or(F.col("kind").isin(*kinds)), F.lit(False))
    by_word = met.groupBy("object", "field", "value", "place").agg(
        is_kind("title", "particle").alias("aside"), is_kind("given").alias("given"), is_kind("family").alias("family"), is_kind("entity").alias("entity"), F.bool_or(F.col("word").rlike(_NAME_WORD)).alias("shaped"),
    )
    core = ~F.col("aside")
    some = lambda c: F.coalesce(F.bool_or(core & F.col(c)), F.lit(False))
    by_value = by_word.groupBy("object", "field", "value").agg(
        (F.count_if(core).between(1, 5) & F.bool_and(F.col("aside") | F.col("shaped"))).alias("shaped"), some("given").alias("given"), some("family").alias("family"), some("entity").alias("entity"),
    )
    counted = known.join(by_value, ["object", "field", "value"], "left")  # a value without any word has no evidence
    yes = lambda c: F.sum(F.when(F.coalesce(c, F.lit(False)), F.col("n")).otherwise(0)).cast("long")
    stats = counted.groupBy("object", "field").agg(
        F.sum("n").cast("long").alias("n"), yes(F.col("shaped") & (F.col("given") | F.col("family"))).alias("named"), yes(F.col("shaped") & F.col("given")).alias("given"), yes(F.col("entity")).alias("entities")
    )
    decided = (F.col("named") >= NAME_SHARE * F.col("n")) & (F.col("given") >= GIVEN_SHARE * F.col("n")) & (F.col("entities") < ENTITY_SHARE * F.col("n"))
    return stats.withColumn("person_name", decided)


def birth_date_columns(values: DataFrame) -> DataFrame:
    """object, field, n, dated, low, middle, high (years at the first tenth, the middle and the last tenth), birth_date.

    Years are counted before they are ranked, so a column has at most 131 rows to rank.
    """
    read = values.where("value is not null and trim(value) <> ''").select("object", "field", parse_date(F.col("value")).alias("d"))
    by_year = read.groupBy("object", "field", F.col("d.year").alias("year")).agg(F.count("*").alias("k"), F.count_if(F.col("d.day") > 1).alias("other"))
    listed = by_year.groupBy("object", "field").agg(
        F.sum("k").cast("long").alias("n"), F.coalesce(F.sum(F.when(F.col("year").isNotNull(), F.col("k"))), F.lit(0)).cast("long").alias("dated"),
        F.coalesce(F.sum(F.when(F.col("year") >= RECENT_YEAR, F.col("k"))), F.lit(0)).alias("recent"), F.sum(F.when(F.col("year").isNotNull(), F.col("other"))).alias("other"), F.max("year").alias("latest"),
        F.sort_array(F.collect_list(F.when(F.col("year").isNotNull(), F.struct("year", "k")))).alias("ys"),
    )
    d = F.col("dated")

    def at(index: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("y"))
        step = lambda s, x: F.struct((s["seen"] + x["k"]).alias("seen"), F.when(s["y"].isNull() & (s["seen"] + x["k"] > index), x["year"]).otherwise(s["y"]).alias("y"))
        return F.aggregate("ys", start, step)["y"]

    ranked = listed.withColumns({"low": at(F.floor(d / 10)), "middle": at(F.floor(d / 2)), "high": at(F.least(F.floor(9 * d / 10), d - 1))})
    born = (2 * d >= F.col("n")) & (F.col("middle") <= BORN_MEDIAN) & (F.col("high") - F.col("low") >= BORN_SPREAD) & (F.col("recent") <= BORN_RECENT * d) & (F.col("latest") <= 2026) & (F.col("other") > 0)
    return ranked.select("object", "field", "n", "dated", "low", "middle", "high", F.coalesce(born, F.lit(False)).alias("birth_date"))


def phone_regions(numbers: DataFrame) -> DataFrame:
    """object, field, region, votes, numbers: the region of each column of phone numbers (object, field, raw).

    A number votes for the region of its country code, or for those in which it is written like that. A region needs at
    least half of the votes, and more than any other; international votes decide between equal ones.
    """
    intl = P.phone_region(F.col("raw"))
    regions = F.when(intl.isNotNull(), F.array(intl)).otherwise(P.national_regions(F.col("raw")))
    # Numbers are graded once and counted by the regions they vote for; what follows is some rows for each column.
    voted = numbers.groupBy("object", "field", regions.alias("regions"), intl.isNotNull().alias("abroad")).agg(F.count("*").alias("k"))
    totals = voted.groupBy("object", "field").agg(F.sum("k").alias("numbers"))
    votes = voted.select("object", "field", "abroad", "k", F.explode("regions").alias("region")).groupBy("object", "field", "region").agg(
        F.sum("k").alias("votes"), F.sum(F.when(F.col("abroad"), F.col("k")).otherwise(0)).alias("abroad")
    )
    best = votes.groupBy("object", "field").agg(F.max(F.struct("votes", "abroad")).alias("most"))
    first = votes.join(best, ["object", "field"]).where((F.col("votes") == F.col("most.votes")) & (F.col("abroad") == F.col("most.abroad")))
    one = first.groupBy("object", "field").agg(F.min("region").alias("region"), F.count("*").alias("_equal"), F.max("votes").alias("votes"))
    chosen = one.where("_equal = 1").drop("_equal")
    decided = totals.join(chosen, ["object", "field"], "left")
    enough = 2 * F.col("votes") >= F.col("numbers")
    return decided.select("object", "field", F.when(enough, F.col("region")).alias("region"), F.coalesce("votes", F.lit(0)).cast("long").alias("votes"), "numbers")


def regional_phones(numbers: DataFrame) -> DataFrame:
    """The numbers with the region of their column, a second grade (what fits the region is one better, what does not
    one worse, null for none), and their E.164 form, which is one for both ways to write a number."""
    regions = phone_regions(numbers).select("object", "field", "region")
    met = numbers.join(F.broadcast(regions), ["object", "field"])  # one row for each column; dealt by column, its numbers would meet in one task
    first = P.phone_grade(F.col("raw"))
    fits = F.coalesce(P.phone_region(F.col("raw")) == F.col("region"), F.array_contains(P.national_regions(F.col("raw")), F.col("region")))
    second = F.when(F.col("region").isNull(), first).when(fits, F.least(first + 1, F.lit(P.STRONG))).when(first > P.WEAK, first - 1)
    return met.select("object", "field", "raw", "region", second.alias("grade"), P.e164(F.col("raw"), F.col("region")).alias("e164"))


def counted_numbers(phones: DataFrame) -> DataFrame:
    """object, field, region, grade, n, numbers (different E.164 forms) of what `regional_phones` gives.

    Numbers are dealt by their E.164 form before they are counted, so a task holds a share of the different numbers of a
    column, however few tasks read them; a frequent one (or null) is dealt to several.
    """
    by = ["object", "field", "region", "grade"]
    each = phones.select(*by, "e164").repartition("e164", F.monotonically_increasing_id() % 16).groupBy(*by, "e164").agg(F.count("*").alias("n"))
    return each.groupBy(*by).agg(F.sum("n").cast("long").alias("n"), F.count("e164").alias("numbers"))


def address_columns(values: DataFrame) -> DataFrame:
    """object, field, n, strong, weak, postal_address: columns half of whose values are addresses beyond doubt, or nearly all of
    whose values are at least likely ones, or in which some texts hold one."""
    graded = values.where("value is not null and trim(value) <> ''").select("object", "field", address_strength(F.col("value")).alias("s"))
    stats = graded.groupBy("object", "field").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("s") == "strong", F.lit(False))).alias("strong"), F.count_if(F.coalesce(F.col("s") == "weak", F.lit(False))).alias("weak"))
    strong, n = F.col("strong"), F.col("n")
    mixed = (strong + F.col("weak") >= MIXED_SHARE * n) & (strong >= MIXED_STRONG * n)
    return stats.withColumn("postal_address", (strong >= ADDRESS_SHARE * n) | mixed | ((strong >= TEXT_COUNT) & (strong >= TEXT_SHARE * n)))
