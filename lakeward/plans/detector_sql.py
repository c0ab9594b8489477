"""DuckDB SQL of the discovery scan, with the patterns of `functions/detectors.py`: one row for each token."""

from __future__ import annotations

from lakeward.functions import detectors as D
from lakeward.functions import phones as P


def luhn(x: str) -> str:
    digit = f"CAST(substr({x}, length({x}) + 1 - i, 1) AS INTEGER)"
    return f"(list_sum(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {digit} WHEN 2 * {digit} > 9 THEN 2 * {digit} - 9 ELSE 2 * {digit} END)) % 10 = 0)"


def card_prefix(x: str) -> str:
    return "(" + " OR ".join(f"(regexp_matches({x}, '{p}') AND length({x}) IN ({', '.join(map(str, n))}))" for p, n in D.CARD_RANGES) + ")"


def valid_email(x: str) -> str:
    local, domain = f"split_part({x}, '@', 1)", f"split_part({x}, '@', -1)"
    return (
        f"(strlen({x}) <= 254 AND strlen({local}) <= 64 AND NOT regexp_matches({domain}, '[^.]{{64}}') AND NOT starts_with({local}, '.') AND NOT ends_with({local}, '.') "
        f"AND NOT contains({local}, '..') AND NOT regexp_matches({domain}, '(?:^|[.])-|-(?:[.]|$)'))"
    )


def personal(x: str) -> str:
    local, ending = f"lower(split_part({x}, '@', 1))", f"lower(split_part({x}, '.', -1))"
    return f"({local} NOT IN {D.SYSTEM_MAILBOXES} AND NOT regexp_matches({local}, '^[0-9a-f-]{{16,}}$') AND {ending} NOT IN {D.FILE_ENDINGS})"


def valid_nir(x: str) -> str:
    bare = f"upper(regexp_replace({x}, '[ ./-]', '', 'g'))"
    body = f"replace(replace(substr({bare}, 1, 13), '2A', '19'), '2B', '18')"
    shape = "^[12][0-9]{2}(?:0[1-9]|1[0-2]|[2-3][0-9]|4[0-2]|[5-9][0-9])(?:[0-9]{2}|2[AB])[0-9]{8}$"
    return f"coalesce(regexp_matches({bare}, '{shape}') AND TRY_CAST(substr({bare}, 14, 2) AS BIGINT) = 97 - TRY_CAST({body} AS BIGINT) % 97, false)"


def valid_iban(x: str) -> str:
    bare = f"upper(regexp_replace({x}, '[ .-]', '', 'g'))"
    number = "CASE WHEN c BETWEEN '0' AND '9' THEN TRY_CAST(c AS BIGINT) ELSE ascii(c) - 55 END"
    return f"(list_reduce(list_transform(string_split(substr({bare}, 5) || substr({bare}, 1, 4), ''), lambda c: {number}), lambda a, y: (a * CASE WHEN y > 9 THEN 100 ELSE 10 END + y) % 97) = 1)"


def _when(cases: list, otherwise) -> str:
    plain = lambda v: "NULL" if v is None else str(v)
    return "CASE " + " ".join(f"WHEN {test} THEN {plain(value)}" for test, value in cases) + f" ELSE {plain(otherwise)} END"


PHONE_FORM = P.Form(
    match=lambda v, p: f"regexp_matches({v}, '{p}')",
    drop=lambda v, p: f"regexp_replace({v}, '{p}', '', 'g')",
    when=_when,
    both=lambda a, b: f"({a} AND {b})",
    length=lambda v: f"length({v})",
    luhn=luhn,
)


FOLD = "translate({0}, chr(160) || chr(8199) || chr(8239) || chr(8208) || chr(8209) || chr(8210) || chr(8211) || chr(8722), '   -----')"
# The first 8192 bytes in whole characters, by the number of characters that end within them.
PREFIX_OF = (
    "CASE WHEN strlen({0}) <= 8192 THEN {0} ELSE rtrim(left({0}, CAST(list_count(list_filter(list_transform(range(4096, 8193), "
    "lambda n: CASE WHEN strlen(left({0}, n)) <= 8192 THEN 1 END), lambda y: y IS NOT NULL)) + 4095 AS BIGINT))) END"
)
PLACEHOLDER = "(lower(trim({0})) IN ('', " + ", ".join(f"'{p}'" for p in D.PLACEHOLDERS) + ") OR regexp_matches(trim({0}), '^(?:" + "|".join(f"{d}{{{{5,}}}}" for d in range(10)) + ")$'))"


def sample_sql(columns: dict[str, list[str]], keys: dict[str, list[str]], rows: int) -> str:
    parts = []
    for table, names in columns.items():
        key = " || '/' || ".join(f"CAST({k} AS VARCHAR)" for k in keys[table])
        parts += [f"SELECT '{table}' AS object, '{c}' AS field, CAST({c} AS VARCHAR) AS value FROM {table} QUALIFY rank() OVER (ORDER BY md5({key})) <= {rows}" for c in names]
    return "smp AS (" + " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts) + ")"


def card_sql() -> str:
    """CTEs cg (candidate runs, in order of k) and cp (the number of each that has one) over cut (rid, t)."""
    return f"""cr AS (SELECT *, row_number() OVER () AS k FROM (SELECT rid, unnest(regexp_extract_all(t, '{D.CARD_RUN}')) AS x FROM cut)),
  cg AS (SELECT rid, k, x, regexp_replace(x, '[^0-9]', '', 'g') AS d, string_split_regex(x, '[ -]') AS g FROM cr WHERE NOT starts_with(x, '+') AND NOT starts_with(x, '00') AND NOT {valid_nir("regexp_replace(x, '[^0-9]', '', 'g')")}),
  cp AS (SELECT k, arg_max(p, length(p)) AS p FROM (SELECT k, array_to_string(list_slice(g, 1, i), '') AS p FROM (SELECT k, g, unnest(range(1, len(g) + 1)) AS i FROM cg))
    WHERE length(p) BETWEEN 13 AND 19 AND {luhn('p')} AND {card_prefix('p')} GROUP BY k)"""


def scan_sql(sample: str, classifiers: tuple[str, ...], whole: bool = False) -> str:
    """CTEs vals (rid, object, field, ph), tok (rid, classifier, raw, ok, grade) and st (statistics); of whole values, or of their prefixes."""
    phones = f"SELECT rid, x, {PHONE_FORM.grade('x')} AS grade FROM (SELECT rid, unnest(regexp_extract_all(t, '{P.PHONE}')) AS x FROM cut)"
    plain = lambda c, pattern, ok: f"SELECT rid, '{c}' AS classifier, x AS raw, {ok} AS ok, NULL AS grade FROM (SELECT rid, unnest(regexp_extract_all(t, '{pattern}')) AS x FROM cut)"
    tokens = {
        "email": plain("email", D.EMAIL, f"{valid_email('x')} AND {personal('x')}"),
        "card_number": "SELECT rid, 'card_number' AS classifier, p AS raw, p IS NOT NULL AS ok, NULL AS grade FROM cg LEFT JOIN cp USING (k) WHERE p IS NOT NULL OR length(d) BETWEEN 13 AND 19",
        "phone": f"SELECT rid, 'phone' AS classifier, x AS raw, true AS ok, grade FROM ({phones}) WHERE grade IS NOT NULL",
        "iban": plain("iban", D.IBAN_SHAPE, valid_iban("x")),
        "nir": plain("nir", D.NIR_SHAPE, valid_nir("x")),
        "aws_key": plain("aws_key", D.AWS_ID, "true"),
        "password_hash": plain("password_hash", D.PASSWORD_HASH, "true"),
    }
    yes = lambda test: f"CAST(sum(CASE WHEN {test} THEN 1 ELSE 0 END) AS BIGINT)"
    return f"""{sample},
  vals AS (SELECT row_number() OVER () AS rid, object, field, value, {PLACEHOLDER.format('value')} AS ph FROM smp WHERE value <> ''),
  cut AS (SELECT rid, {'v' if whole else PREFIX_OF.format('v')} AS t FROM (SELECT rid, {FOLD.format('value')} AS v FROM vals)),
  {card_sql()},
  tok AS ({" UNION ALL ".join(tokens[c] for c in classifiers)}),
  per AS (SELECT rid, classifier, count(*) FILTER (ok) AS valid, min(raw) FILTER (ok) AS lo, max(raw) FILTER (ok) AS hi, max(grade) AS grade, true AS cand FROM tok GROUP BY 1, 2),
  st AS (SELECT object, field, classifier, count(*) AS sampled, {yes('NOT ph')} AS n, {yes('NOT ph AND valid > 0')} AS matched, {yes('NOT ph AND cand')} AS candidates,
    CAST(sum(CASE WHEN ph THEN 0 ELSE coalesce(valid, 0) END) AS BIGINT) AS valid, {yes('NOT ph AND grade = 3')} AS strong, {yes('NOT ph AND grade >= 2')} AS formatted,
    {yes("NOT ph AND grade >= 2 AND regexp_matches(t, '(?:[\\p{L}][^\\p{L}]*){3}')")} AS in_text, min(CASE WHEN NOT ph THEN lo END) AS lo, max(CASE WHEN NOT ph THEN hi END) AS hi
    FROM vals JOIN cut USING (rid) CROSS JOIN (VALUES {", ".join(f"('{c}')" for c in classifiers)}) c(classifier) LEFT JOIN per USING (rid, classifier) GROUP BY 1, 2, 3)"""


def decided(hint: str = "false") -> str:
    """SELECT list entries `reported` and `confidence` over st."""
    telling = lambda k: f"({k} >= 3 AND {k} / n >= 0.01)"
    return f"""matched > 0 AND CASE classifier
      WHEN 'email' THEN NOT (matched >= 3 AND lo = hi) AND ({hint} OR matched / n >= 0.05 OR matched >= 3)
      WHEN 'phone' THEN {hint} OR formatted / n >= 0.3 OR {telling('strong')} OR {telling('in_text')}
      WHEN 'aws_key' THEN true WHEN 'password_hash' THEN true ELSE 2 * matched >= candidates END AS reported,
    round(least(1.0, CASE WHEN classifier = 'phone' THEN 0.4 + 0.4 * (CASE WHEN n > 0 THEN matched / n ELSE 0.0 END) + 0.2 * CAST({hint} AS INTEGER)
      ELSE 0.6 + 0.35 * (CASE WHEN n > 0 THEN matched / n ELSE 0.0 END) + 0.05 * CAST({hint} AS INTEGER) END), 3) AS confidence"""
