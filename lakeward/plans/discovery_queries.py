"""Discovery queries over documents, pages, conversations and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.functions import detectors as D
from lakeward.functions import masking as M
from lakeward.functions import names as N
from lakeward.functions.evidence import decide_evidence
from lakeward.operators import discovery as V
from lakeward.operators import serving
from lakeward.plans.base import read

_COLUMNS = {"documents": ["text"], "pages": ["html", "url"], "conversations": ["text"], "customer": ["c_name", "c_mktsegment"]}
_KEYS = {"documents": ["doc_id"], "pages": ["page_id"], "conversations": ["conv_id", "turn"], "customer": ["c_custkey"]}
_KEY = b"an example key"
_FEW = ("email", "card_number", "phone")


def sampled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.long_form({t: read(spark, sf_dir, t) for t in _COLUMNS}, _COLUMNS, _KEYS)


def discover_email_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = V.scanned(sampled_values(spark, sf_dir), _FEW[:2])
    return V.decide(V.column_statistics(scan), V.hinted(_COLUMNS)).select("object", "field", "classifier", "sampled", "n", "matched", "candidates", "reported", "confidence")


def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.column_statistics(V.scanned(sampled_values(spark, sf_dir), _FEW)).select("object", "field", "classifier", "sampled", "n", "matched", "candidates", "valid", "strong", "formatted")


def all_classifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.findings(sampled_values(spark, sf_dir), hint=V.hinted(_COLUMNS))


def _planted(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] = ()) -> DataFrame:
    """Orders as a table of identifiers of every kind (or of these fields), valid and not: some with separators, some in words."""
    key = F.col("o_orderkey")
    digits = F.lpad(key.cast("string"), 9, "0")
    body = F.concat(F.lit("411111"), digits)
    check = lambda b: (10 - F.aggregate(F.transform(F.split(F.reverse(b), ""), lambda c, i: F.when(i % 2 == 0, (2 * c.cast("int")) % 10 + F.floor(2 * c.cast("int") / 10)).otherwise(c.cast("int"))), F.lit(0).cast("bigint"), lambda s, x: s + x) % 10) % 10
    card = F.concat(body, check(body).cast("string"))
    spaced = F.regexp_replace(card, "(.{4})(.{4})(.{4})(.{4})", "$1 $2 $3 $4")
    number = F.lpad((key % 100_000_000).cast("string"), 8, "0")
    nir_body = F.concat(F.lit("1"), F.lpad((key % 90 + 10).cast("string"), 2, "0"), F.lit("05"), F.lit("75"), F.lpad((key % 1_000_000).cast("string"), 6, "0"))
    nir = F.concat(nir_body, F.lpad((97 - nir_body.cast("bigint") % 97).cast("string"), 2, "0"))
    account = F.concat(F.lit("37040044"), F.lpad(key.cast("string"), 10, "0"))
    iban = F.concat(F.lit("DE"), F.lpad((98 - F.concat(account, F.lit("131400")).cast("decimal(38,0)") % 97).cast("int").cast("string"), 2, "0"), account)
    phone = F.concat(F.lit("0"), (key % 9 + 1).cast("string"), F.regexp_replace(number, "(..)", " $1"))
    cut = lambda c: F.when(key % 5 == 0, F.overlay(c, F.lit("9"), F.lit(9))).otherwise(c)
    columns = {
        "card": F.when(key % 2 == 0, spaced).otherwise(cut(card)), "nir": nir, "iban": F.when(key % 7 == 0, F.lower(iban)).otherwise(F.concat(F.lit("to "), iban, F.lit(" now"))),
        "phone": F.when(key % 4 == 0, F.concat(F.lit("call +33"), F.substring(phone, 2, 20))).otherwise(phone), "aws": F.concat(F.lit("AKIA"), F.upper(F.substring(F.md5(key.cast("string")), 1, 16))),
        "hash": F.when(key % 3 == 0, F.concat(F.lit("{SSHA}"), F.md5(key.cast("string")))).otherwise(F.concat(F.lit("$2b$12$"), F.md5(key.cast("string")), F.substring(F.md5(key.cast("string")), 1, 21))),
        "note": F.when(key % 6 == 0, F.lit("n/a")).otherwise(F.concat(F.lit("mail né"), key.cast("string"), F.lit("@exämple.org"))), "digits": F.concat(F.lit("4"), F.lpad(key.cast("string"), 24, "7")),
    }
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), c.alias("value")) for n, c in columns.items() if not fields or n in fields])
    # Keys are small and are dealt out evenly, since what is built from them and scanned costs more than moving them.
    orders = read(spark, sf_dir, "orders").select("o_orderkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    return orders.select(F.lit("orders").alias("object"), F.explode(pairs).alias("p")).select("object", "p.field", "p.value")


def planted_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All classifiers over identifiers that are built from order keys."""
    return V.findings(_planted(spark, sf_dir), hint=V.hinted({"orders": ["card", "nir", "iban", "phone", "aws", "hash", "note", "digits"]}))


def evidence_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, addresses and birth dates have no SQL form; order dates stand for a date column."""
    orders = read(spark, sf_dir, "orders").select(F.lit("orders").alias("object"), F.lit("o_orderdate").alias("field"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("value"))
    return decide_evidence(sampled_values(spark, sf_dir).unionByName(orders))


def placeholder_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.regexp_replace("o_orderpriority", "^4-.*", "N/A").alias("v"))
    return orders.agg(F.count("*").alias("n"), F.sum(D.is_placeholder(F.col("v")).cast("long")).alias("placeholders"))


def nanp_phone_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("source", F.size(D.find_phones(D.scan_prefix(F.coalesce("text", F.lit(""))))).alias("n"))
    return docs.groupBy("source").agg(F.count("*").alias("sampled"), F.sum((F.col("n") > 0).cast("long")).alias("matched"), F.sum("n").cast("long").alias("hits"))


def _masked(spark: SparkSession, sf_dir: str, find, mask) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(find(F.coalesce("text", F.lit("")))).alias("pos", "raw"))
    return docs.select("doc_id", F.col("pos").cast("long").alias("pos"), mask(F.col("raw")).alias("masked"), M.conforms(mask(F.col("raw"))).alias("conforms"))


def mask_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir, D.find_emails, M.mask_email).drop("conforms")


def mask_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir, D.find_cards, M.mask_card).drop("conforms")


def mask_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir, D.find_phones, M.mask_phone).drop("conforms")


def sample_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = V.scanned(read(spark, sf_dir, "documents").select(F.lit("documents").alias("object"), F.lit("text").alias("field"), F.col("text").alias("value")), ("email",))
    return V.masked_evidence(scan, lambda c: F.sha2(c, 256)).select("object", "field", "classifier", "masked", F.col("place").cast("long").alias("place"))


def keyed_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HMAC fingerprints; the key is a parameter of the operator."""
    found = V.fingerprints(V.scanned(sampled_values(spark, sf_dir), _FEW), M.keyed_digest(_KEY, "value"))
    return found.select("object", "field", "classifier", F.array_join("fingerprints", ",").alias("fingerprints"))


def identifier_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of account and social security numbers, each of which is written in three ways."""
    spaced = lambda c, sep: F.regexp_replace(c, "(....)", f"$1{sep}")
    rows = _planted(spark, sf_dir).where("field in ('iban', 'nir')").withColumn("value", F.regexp_extract("value", "(?i)([a-z]{2}[0-9]{20}|[0-9]{15})", 1))
    nir = F.regexp_replace("value", "(.)(..)(..)(..)(...)(...)(..)", "$1 $2 $3 $4 $5 $6 $7")
    forms = F.array("value", F.when(F.col("field") == "nir", nir).otherwise(spaced(F.col("value"), "-")), F.when(F.col("field") == "nir", F.regexp_replace(nir, " ", "-")).otherwise(spaced(F.col("value"), " ")))
    found = V.fingerprints(V.scanned(rows.withColumn("value", F.explode(forms)), ("iban", "nir")), M.keyed_digest(_KEY, "value"))
    return found.select("object", "field", "classifier", F.array_join("fingerprints", ",").alias("fingerprints"))


def personal_mailboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "documents").select(F.explode(D.find_emails(F.coalesce("text", F.lit("")))).alias("raw"))
    return found.groupBy(D.personal_mailbox(F.col("raw")).alias("personal"), F.substring_index("raw", "@", -1).alias("domain")).agg(F.count("*").alias("n"))


def client_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "documents").select(F.explode(D.extract(F.coalesce("text", F.lit("")), r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b")).alias("address"))
    return found.select(N.network_v4(F.col("address")).alias("network")).where("network is not null").groupBy("network").agg(F.count("*").alias("n"))


def fold_name_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeward.plans.base import access_events, sample_findings

    left = access_events(spark, sf_dir).groupBy(N.fold_name(F.col("object")).alias("name")).agg(F.count("*").alias("events"))
    right = sample_findings(spark, sf_dir).groupBy(N.fold_name(F.concat("object", F.lit("  "))).alias("name")).agg(F.count("*").alias("findings"))
    return left.join(right, "name")


def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer").where(N.glob_match(F.col("c_name"), "*1?5") | N.glob_match(F.col("c_name"), "CUSTOMER#*00"))
    return customers.select("c_custkey", "c_name")


def eval_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected symbols against the quality label, as an evaluation of a classifier at row level."""
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    truth = docs.where("quality = 0").select("doc_id", F.lit("junk").alias("classifier"))
    found = docs.where(F.length(F.regexp_replace("text", "[^#*$%&|<>]", "")) * 20 > F.length("text")).select("doc_id", F.lit("junk").alias("classifier"))
    return serving.evaluate(found, truth, ["doc_id"])


QUERIES = {
    f.__name__: f
    for f in (
        discover_email_card, column_stats, all_classifiers, planted_identifiers, evidence_columns, placeholder_share, nanp_phone_columns, mask_email, mask_card, mask_phone,
        sample_bottom_k, keyed_fingerprints, identifier_fingerprints, personal_mailboxes, client_networks, fold_name_join, glob_filter, eval_precision_recall,
    )
}

# ---- SQL ----------------------------------------------------------------------------------------
from lakeward.plans.base import EVENTS_SQL, FINDINGS_SQL  # noqa: E402

from lakeward.plans import detector_sql as Q  # noqa: E402

_EMAIL_OK = Q.valid_email("x")
_FOLD, _PREFIX_OF = Q.FOLD, Q.PREFIX_OF
_SAMPLE = Q.sample_sql(_COLUMNS, _KEYS, V.SAMPLE_ROWS)
_INNER, _OUTER = (pad.hex() for pad in M.keyed_pads(_KEY, "value"))
_PLANT = """key AS (SELECT o_orderkey AS k, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS d9, lpad(CAST(o_orderkey % 100000000 AS VARCHAR), 8, '0') AS n8, md5(CAST(o_orderkey AS VARCHAR)) AS h FROM orders),
  bd AS (SELECT *, '411111' || d9 AS body, '1' || lpad(CAST(k % 90 + 10 AS VARCHAR), 2, '0') || '05' || '75' || lpad(CAST(k % 1000000 AS VARCHAR), 6, '0') AS nb, '37040044' || lpad(CAST(k AS VARCHAR), 10, '0') AS acc FROM key),
  ck AS (SELECT *, body || CAST((10 - list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 1 THEN (2 * CAST(substr(body, 16 - i, 1) AS INTEGER)) % 10 + (2 * CAST(substr(body, 16 - i, 1) AS INTEGER)) // 10
    ELSE CAST(substr(body, 16 - i, 1) AS INTEGER) END)) % 10) % 10 AS VARCHAR) AS card,
    'DE' || lpad(CAST(98 - CAST(acc || '131400' AS HUGEINT) % 97 AS VARCHAR), 2, '0') || acc AS iban,
    '0' || CAST(k % 9 + 1 AS VARCHAR) || regexp_replace(n8, '(..)', ' \\1', 'g') AS phone FROM bd),
  smp AS (SELECT 'orders' AS object, unnest(['card', 'nir', 'iban', 'phone', 'aws', 'hash', 'note', 'digits']) AS field, unnest([
    CASE WHEN k % 2 = 0 THEN regexp_replace(card, '(.{4})(.{4})(.{4})(.{4})', '\\1 \\2 \\3 \\4') WHEN k % 5 = 0 THEN left(card, 8) || '9' || substr(card, 10) ELSE card END,
    nb || lpad(CAST(97 - CAST(nb AS BIGINT) % 97 AS VARCHAR), 2, '0'),
    CASE WHEN k % 7 = 0 THEN lower(iban) ELSE 'to ' || iban || ' now' END,
    CASE WHEN k % 4 = 0 THEN 'call +33' || substr(phone, 2, 20) ELSE phone END,
    'AKIA' || upper(left(h, 16)),
    CASE WHEN k % 3 = 0 THEN '{SSHA}' || h ELSE '$2b$12$' || h || left(h, 21) END,
    CASE WHEN k % 6 = 0 THEN 'n/a' ELSE 'mail né' || CAST(k AS VARCHAR) || '@exämple.org' END,
    '4' || lpad(CAST(k AS VARCHAR), 24, '7')]) AS value FROM ck)"""
_FOUND = "SELECT object, field, classifier, sampled, n, matched, candidates, valid, strong, formatted, in_text, confidence FROM (SELECT *, {decided} FROM st) WHERE reported"
_WILSON = "round(CASE WHEN {n} > 0 THEN ({p} / {n} + 1.96 * 1.96 / (2 * {n}) - 1.96 * sqrt({p} / {n} * (1 - {p} / {n}) / {n} + 1.96 * 1.96 / (4 * {n} * {n}))) / (1 + 1.96 * 1.96 / {n}) ELSE 0.0 END, 6)"

ORACLE_SQL = {
    "discover_email_card": f"WITH {Q.scan_sql(_SAMPLE, _FEW[:2])} SELECT object, field, classifier, sampled, n, matched, candidates, {Q.decided()} FROM st",
    "column_stats": f"WITH {Q.scan_sql(_SAMPLE, _FEW)} SELECT object, field, classifier, sampled, n, matched, candidates, valid, strong, formatted FROM st",
    "all_classifiers": f"WITH {Q.scan_sql(_SAMPLE, V.CLASSIFIERS)} {_FOUND.format(decided=Q.decided())}",
    "planted_identifiers": f"""WITH {Q.scan_sql(_PLANT, V.CLASSIFIERS)} {_FOUND.format(decided=Q.decided("((field = 'card' AND classifier = 'card_number') OR (field = classifier AND field IN ('nir', 'iban', 'phone')) OR (field = 'aws' AND classifier = 'aws_key') OR (field = 'hash' AND classifier = 'password_hash'))"))}""",
    "keyed_fingerprints": f"""WITH {Q.scan_sql(_SAMPLE, _FEW)}, nf AS (SELECT DISTINCT object, field, classifier, CASE WHEN classifier = 'email' THEN lower(trim(raw)) ELSE regexp_replace(raw, '[^0-9]', '', 'g') END AS v
      FROM tok JOIN vals USING (rid) WHERE ok AND NOT ph), fp AS (SELECT DISTINCT object, field, classifier, 'hmac-sha256:' || sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(v)))) AS f FROM nf)
      SELECT object, field, classifier, string_agg(f, ',' ORDER BY f) AS fingerprints FROM (SELECT * FROM fp QUALIFY row_number() OVER (PARTITION BY object, field, classifier ORDER BY f) <= 50) GROUP BY 1, 2, 3""",
    "identifier_fingerprints": f"""WITH {_PLANT}, nf AS (SELECT DISTINCT object, field, field AS classifier, upper(regexp_extract(value, '(?i)([a-z]{{2}}[0-9]{{20}}|[0-9]{{15}})', 1)) AS v FROM smp WHERE field IN ('iban', 'nir')),
      fp AS (SELECT object, field, classifier, 'hmac-sha256:' || sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(v)))) AS f FROM nf)
      SELECT object, field, classifier, string_agg(f, ',' ORDER BY f) AS fingerprints FROM (SELECT * FROM fp QUALIFY row_number() OVER (PARTITION BY object, field, classifier ORDER BY f) <= 50) GROUP BY 1, 2, 3""",
    "placeholder_share": """SELECT count(*) AS n, CAST(sum(CASE WHEN o_orderpriority LIKE '4-%' THEN 1 ELSE 0 END) AS BIGINT) AS placeholders FROM orders""",
    "nanp_phone_columns": f"""SELECT source, count(*) AS sampled, CAST(sum(CASE WHEN len(h) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS matched, CAST(sum(len(h)) AS BIGINT) AS hits
      FROM (SELECT source, regexp_extract_all({_PREFIX_OF.format('t')}, '{D.NANP}') AS h FROM (SELECT source, coalesce(text, '') AS t FROM documents)) GROUP BY source""",
    "mask_email": f"""SELECT doc_id, pos - 1 AS pos, left(x, 1) || '***@' || left(d, 1) || '***.' || split_part(d, '.', -1) AS masked FROM (
      SELECT doc_id, unnest(range(1, len(h) + 1)) AS pos, unnest(h) AS x, split_part(unnest(h), '@', -1) AS d FROM (
      SELECT doc_id, list_filter(regexp_extract_all(text, '{D.EMAIL}'), lambda x: {_EMAIL_OK}) AS h FROM documents))""",
    "mask_card": f"""WITH smp AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), cut AS (SELECT row_number() OVER () AS rid, doc_id, text AS t FROM smp), {Q.card_sql()}
      SELECT doc_id, row_number() OVER (PARTITION BY rid ORDER BY k) - 1 AS pos, trim(regexp_replace(repeat('*', length(p) - 4) || right(p, 4), '(.{{4}})', '\\1 ', 'g')) AS masked FROM cg JOIN cp USING (k) JOIN cut USING (rid)""",
    "mask_phone": f"""SELECT doc_id, pos - 1 AS pos, '** ** ** ' || right(x, 2) AS masked FROM (
      SELECT doc_id, unnest(range(1, len(h) + 1)) AS pos, unnest(h) AS x FROM (SELECT doc_id, regexp_extract_all(text, '{D.NANP}') AS h FROM documents))""",
    "sample_bottom_k": f"""WITH h AS (SELECT unnest(list_filter(regexp_extract_all(t, '{D.EMAIL}'), lambda x: {_EMAIL_OK})) AS raw FROM (
      SELECT {_PREFIX_OF.format('v')} AS t FROM (SELECT {_FOLD.format('text')} AS v FROM documents WHERE text <> ''))),
      m AS (SELECT left(raw, 1) || '***@' || left(split_part(raw, '@', -1), 1) || '***.' || split_part(split_part(raw, '@', -1), '.', -1) AS masked, sha256('text' || chr(31) || raw) AS r FROM h)
      SELECT 'documents' AS object, 'text' AS field, 'email' AS classifier, masked, place FROM (
      SELECT masked, row_number() OVER (ORDER BY min(r), masked) AS place FROM m GROUP BY masked) WHERE place <= 5""",
    "personal_mailboxes": f"""WITH h AS (SELECT unnest(list_filter(regexp_extract_all(text, '{D.EMAIL}'), lambda x: {_EMAIL_OK})) AS raw FROM documents),
      p AS (SELECT split_part(raw, '@', -1) AS domain, lower(split_part(raw, '@', 1)) AS l, lower(split_part(raw, '.', -1)) AS e FROM h)
      SELECT l NOT IN {D.SYSTEM_MAILBOXES} AND NOT regexp_matches(l, '^[0-9a-f-]{{16,}}$') AND e NOT IN {D.FILE_ENDINGS} AS personal, domain, count(*) AS n FROM p GROUP BY 1, 2""",
    "client_networks": f"""SELECT regexp_extract(a, '^(\\d+\\.\\d+\\.\\d+)\\.', 1) || '.0/24' AS network, count(*) AS n FROM (
      SELECT unnest(regexp_extract_all(text, '\\b[0-9]{{1,3}}(?:\\.[0-9]{{1,3}}){{3}}\\b')) AS a FROM documents) WHERE regexp_matches(a, '^{N.IPV4}$') GROUP BY 1""",
    "fold_name_join": f"""WITH {EVENTS_SQL}, {FINDINGS_SQL} SELECT name, events, findings FROM (SELECT lower(object) AS name, count(*) AS events FROM ev GROUP BY 1)
      JOIN (SELECT lower(rtrim(object)) AS name, count(*) AS findings FROM fi GROUP BY 1) USING (name)""",
    "glob_filter": f"""SELECT c_custkey, c_name FROM customer WHERE regexp_matches(lower(c_name), '{N.glob_to_regex("*1?5")}') OR regexp_matches(lower(c_name), '{N.glob_to_regex("CUSTOMER#*00")}')""",
    "eval_precision_recall": f"""WITH d AS (SELECT quality = 0 AS t, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) * 20 > length(text) AS f FROM documents JOIN labels USING (doc_id)),
      c AS (SELECT CAST(sum(CASE WHEN t AND f THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN f AND NOT t THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN t AND NOT f THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM d)
      SELECT 'junk' AS classifier, tp, fp, fn, {_WILSON.format(p='tp', n='(tp + fp)')} AS precision_bound, {_WILSON.format(p='tp', n='(tp + fn)')} AS recall_bound FROM c""",
}
