"""Discovery: columns are sampled, their values scanned, and each column is decided on.

Values are scanned in built-in functions; a column's evidence is one grouped aggregate with map-side
partial sums, so a table with one huge column needs no more memory than any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeward.functions import detectors as D
from lakeward.functions import masking as M
from lakeward.functions import phones as P
from lakeward.functions.hints import hints

#: Most values of a column that are sampled, most masked samples and fingerprints that are kept.
SAMPLE_ROWS, MASKED_SAMPLES, FINGERPRINTS = 10_000, 5, 50

# Reported shares and counts (see SURVEY §2.4).
EMBEDDED_SHARE, EMBEDDED_COUNT = 0.05, 3
PHONE_SHARE, PHONE_COUNT, PHONE_LEAST_SHARE = 0.3, 3, 0.01
CLASSIFIERS = ("email", "card_number", "phone", "iban", "nir", "aws_key", "password_hash")
#: Columns of `column_statistics` that tell whether all matches are the same.
CODES = ("least_code_0", "greatest_code_0", "least_code_1", "greatest_code_1")
_LETTERS = "(?:\\p{L}[^\\p{L}]*){3}"


def sampled(frame: DataFrame, keys: list[str], rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of least key hash (as many as `rows`, and ties), so a sample does not depend on partitioning.

    Only keys are ranked. The table is counted first (from its footers), and keys whose hash is above three times the
    wanted share are left out before that, so the task that ranks gets some 3 * `rows` keys, however many tasks scan.
    """
    digest = F.md5(F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))
    hashes = frame.select(digest.alias("h"))
    least = lambda some: some.orderBy("h").limit(rows).agg(F.max("h").alias("h"), F.count("*").alias("n")).first()
    total = frame.count()
    if total < rows:
        return frame
    last = least(hashes.where(F.col("h") < f"{min(3 * rows * 16**12 // total, 16**12 - 1):012x}")) if total > 3 * rows else None
    if last is None or last["n"] < rows:  # few different keys
        last = least(hashes)
    return frame.where(digest <= last["h"])


def long_form(tables: dict[str, DataFrame], columns: dict[str, list[str]], keys: dict[str, list[str]], rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per sampled value: object, field, value. The samples are small and are dealt out evenly, since
    scanning them costs more than moving them."""
    parts = []
    for name, frame in tables.items():
        pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns[name]])
        parts.append(sampled(frame, keys[name], rows).select(F.lit(name).alias("object"), F.explode(pairs).alias("p")).select("object", "p.field", "p.value"))
    values = reduce(DataFrame.unionByName, parts)
    return values.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def scanned(values: DataFrame, classifiers: tuple[str, ...] = CLASSIFIERS, whole: bool = False) -> DataFrame:
    """object, field, value, placeholder, worded (three letters or more), and `found`: for each classifier the
    valid matches, whether there are candidates (which include invalid ones), and the best grade of a phone.

    Each pattern is searched once: candidates are columns, and what is valid is filtered from them. Values are searched to their
    end if `whole`, else in their first bytes only (`detectors.scan_prefix`).
    """
    folded = D.typographic_fold(F.col("value"))
    rows = values.where("value is not null and value <> ''").withColumn("text", folded if whole else D.scan_prefix(folded))
    shapes = {"iban": D.IBAN_SEARCH, "nir": D.NIR_SHAPE, "aws_key": D.AWS_ID, "password_hash": D.HASH_SEARCH}
    for c in classifiers:
        if c == "email":
            rows = rows.withColumn("_email", D.email_candidates(F.col("text")))
        elif c == "card_number":
            rows = rows.withColumn("_card_number", D.card_candidates(F.col("text")))
        elif c == "phone":
            rows = rows.withColumn("_phone", D.extract(F.col("text"), P.PHONE_SEARCH))
        else:
            rows = rows.withColumn(f"_{c}", D.extract(F.col("text"), shapes[c]))
    if "phone" in classifiers:
        graded = F.transform("_phone", lambda v: F.struct(v.alias("raw"), P.phone_grade(v).alias("grade")))
        rows = rows.withColumn("_phone", F.filter(graded, lambda p: p["grade"].isNotNull()))
    true = lambda test: lambda v: F.coalesce(test(v), F.lit(False))
    hits = {
        "email": lambda c: F.filter(c, true(lambda v: D.valid_email(v) & D.personal_mailbox(v))),
        "card_number": lambda c: F.filter(F.transform(c, lambda p: p["number"]), lambda v: v.isNotNull()),
        "phone": lambda c: F.transform(c, lambda p: p["raw"]),
        "iban": lambda c: F.filter(c, true(D.valid_iban)),
        "nir": lambda c: F.filter(c, true(D.valid_nir)),
        "aws_key": lambda c: c,
        "password_hash": lambda c: c,
    }
    structs = [
        F.struct(
            F.lit(c).alias("classifier"),
            hits[c](F.col(f"_{c}")).alias("hits"),
            (F.size(f"_{c}") > 0).alias("candidates"),
            (F.array_max(F.transform("_phone", lambda p: p["grade"])) if c == "phone" else F.lit(None).cast("int")).alias("grade"),
        )
        for c in classifiers
    ]
    return rows.select("object", "field", "value", D.is_placeholder(F.col("value")).alias("placeholder"), F.col("text").rlike(_LETTERS).alias("worded"), F.array(*structs).alias("found"))


def column_statistics(scan: DataFrame) -> DataFrame:
    """For each column and classifier: sampled and n (no placeholders) values, matched values and those with
    candidates, valid matches, phone values by grade, and least and greatest codes of matches: two 64-bit hashes, so
    that matches are all the same if least and greatest are equal in both."""
    # `found` is never empty; a plain explode would first filter on its size, which runs every pattern again.
    rows = scan.select("object", "field", "placeholder", "worded", F.explode_outer("found").alias("f")).withColumn("real", ~F.col("placeholder"))
    hit = F.col("real") & (F.size("f.hits") > 0)
    count = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    formatted = F.col("real") & (F.col("f.grade") >= P.NORMAL)
    # Least and greatest strings have no place in a hash aggregate: each task would sort all of its values.
    codes = lambda salt: [F.xxhash64(F.lit(salt), v) for v in (F.array_min("f.hits"), F.array_max("f.hits"))]
    return rows.groupBy("object", "field", F.col("f.classifier").alias("classifier")).agg(
        F.count("*").alias("sampled"),
        count(F.col("real")).alias("n"),
        count(hit).alias("matched"),
        count(F.col("real") & F.col("f.candidates")).alias("candidates"),
        F.sum(F.when(F.col("real"), F.size("f.hits")).otherwise(0)).cast("long").alias("valid"),
        count(F.col("real") & (F.col("f.grade") == P.STRONG)).alias("strong"),
        count(formatted).alias("formatted"),
        count(formatted & F.col("worded")).alias("in_text"),
        *[a for salt in (0, 1) for a in (F.min(F.when(hit, F.least(*codes(salt)))).alias(f"least_code_{salt}"), F.max(F.when(hit, F.greatest(*codes(salt)))).alias(f"greatest_code_{salt}"))],
    )


def hinted(columns: dict[str, list[str]]) -> Column:
    """Whether a column's name speaks for the classifier of a row (object, field, classifier)."""
    known = [F.lit(x) for table, names in columns.items() for name in names for c in sorted(hints(name)) for x in (f"{table}.{name}.{c}",)]
    return F.concat_ws(".", "object", "field", "classifier").isin(*known) if known else F.lit(False)


def decide(stats: DataFrame, hint: Column | None = None) -> DataFrame:
    """Which columns are reported, and with what confidence (three decimals)."""
    hint = F.lit(False) if hint is None else hint
    share = lambda k: F.when(F.col("n") > 0, F.col(k) / F.col("n")).otherwise(F.lit(0.0))
    ratio, some = share("matched"), F.col("matched") > 0
    constant = (F.col("matched") >= EMBEDDED_COUNT) & (F.col("least_code_0") == F.col("greatest_code_0")) & (F.col("least_code_1") == F.col("greatest_code_1"))
    telling = lambda k: (F.col(k) >= PHONE_COUNT) & (share(k) >= PHONE_LEAST_SHARE)
    reported = (
        F.when(F.col("classifier") == "email", ~constant & (hint | (ratio >= EMBEDDED_SHARE) | (F.col("matched") >= EMBEDDED_COUNT)))
        .when(F.col("classifier") == "phone", hint | (share("formatted") >= PHONE_SHARE) | telling("strong") | telling("in_text"))
        .when(F.col("classifier").isin("card_number", "iban", "nir"), 2 * F.col("matched") >= F.col("candidates"))
        .otherwise(F.lit(True))
    )
    h = F.when(hint, 1.0).otherwise(0.0)
    confidence = F.when(F.col("classifier") == "phone", 0.4 + 0.4 * ratio + 0.2 * h).otherwise(0.6 + 0.35 * ratio + 0.05 * h)
    return stats.withColumn("reported", F.coalesce(some & reported, F.lit(False))).withColumn("confidence", F.round(F.least(F.lit(1.0), confidence), 3))


def findings(values: DataFrame, classifiers: tuple[str, ...] = CLASSIFIERS, hint: Column | None = None) -> DataFrame:
    return decide(column_statistics(scanned(values, classifiers)), hint).where("reported").drop("reported", *CODES)


def hits(scan: DataFrame) -> DataFrame:
    """One row per valid match: object, field, classifier, raw."""
    rows = scan.where("not placeholder").select("object", "field", F.explode_outer("found").alias("f"))
    return rows.select("object", "field", F.col("f.classifier").alias("classifier"), F.explode("f.hits").alias("raw"))


def masked_evidence(scan: DataFrame, rank, samples: int = MASKED_SAMPLES) -> DataFrame:
    """For each column and classifier the masked samples of least rank; `rank` hashes a raw value."""
    masked = hits(scan).withColumn("masked", M.mask_as(F.col("classifier"), F.col("raw")))
    best = masked.groupBy("object", "field", "classifier", "masked").agg(F.min(rank(F.concat_ws("\x1f", "field", "raw"))).alias("rank"))
    order = Window.partitionBy("object", "field", "classifier").orderBy("rank", "masked")
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= samples).drop("rank")


def fingerprints(scan: DataFrame, digest, most: int = FINGERPRINTS) -> DataFrame:
    """The least distinct digests of each column and classifier, sorted: bounded by a top-k."""
    values = hits(scan).select("object", "field", "classifier", digest(M.normalize(F.col("classifier"), F.col("raw"))).alias("fingerprint")).distinct()
    order = Window.partitionBy("object", "field", "classifier").orderBy("fingerprint")
    least = values.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return least.groupBy("object", "field", "classifier").agg(F.sort_array(F.collect_list("fingerprint")).alias("fingerprints"))
