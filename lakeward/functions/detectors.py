"""Sensitive-value detectors as column expressions.

Each `find_*` gives the array of valid matches in a text, each `*_candidates` that of all that have the
shape. Patterns keep to what Java and RE2 read alike (the SQL of the queries uses the same ones); their forms
named `*_SEARCH` find the same: `EMAIL_SEARCH` adds a lookbehind and a possessive repeat, so that a long run of letters
is read once, the others a look at the first characters, so that most places of a text are left at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeward.functions.hash_formats import HASH_SEARCH, PASSWORD_HASH  # noqa: F401

#: An address of RFC 5322 in its plain form: atoms with dots between (of the characters that are not used to
#: set off an address in running text), and a domain of at least two labels, the last one of letters.
_LOCAL, _EDGE = "[\\p{L}\\p{N}%+_.-]", "[\\p{L}\\p{N}]"
_LABEL = f"{_EDGE}(?:[\\p{{L}}\\p{{N}}-]*{_EDGE})?"
EMAIL = f"{_LOCAL}+@(?:{_LABEL}[.])+\\p{{L}}{{2,}}"
EMAIL_SEARCH = f"(?<!{_LOCAL}){_LOCAL}++@(?:{_LABEL}[.]){{1,126}}\\p{{L}}{{2,}}"
CARD_RUN = "\\+?\\b[0-9](?:[ -]?[0-9]){11,22}\\b"
#: The fields of a French social security number: sex, year, month, department, commune, order, key; one
#: separator may stand before each.
NIR_FIELDS = ("[12]", "[0-9]{2}", "[0-9]{2}", "(?:[0-9]{2}|2[AaBb])", "[0-9]{3}", "[0-9]{3}", "[0-9]{2}")
NIR_SHAPE = "\\b" + "[ ./-]?".join(NIR_FIELDS) + "\\b"
#: Prefixes of access key ids, as the provider documents them.
AWS_ID = "\\b(?:AKIA|ASIA|ABIA|ACCA|A3T[A-Z0-9])[A-Z0-9]{16}\\b"
NANP = "\\([2-9][0-9]{2}\\) [2-9][0-9]{2}-[0-9]{4}"

# Lengths of national account numbers in the ISO 13616 registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22,
    "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}
# Words that stand for no value.
PLACEHOLDERS = (
    "n/a", "na", "n.a.", "n.a", "none", "null", "nil", "-", "--", "---", "?", "??", "unknown", "inconnu", "inconnue", "non renseigné", "non renseigne", "nr", "tbd", "todo",
    "0000-00-00", "0000-00-00 00:00:00", "undefined", "(null)", "<null>", "empty", "vide", "x", "xx", "xxx", "s/o", "sans objet", "not available", "not applicable", "redacted",
    "[redacted]", "***", "0", "nan", "\\n", "#n/a", "#na", "#null!", "#value!", "(empty)", "<empty>", "(none)", "<none>", "\u2014", "\u2013", "_", "...", "\u2026", "n.c.", "n.c", "nc",
    "n/c", "néant", "neant", "aucun", "aucune", "not provided", "none provided", "not set", "not specified", "missing", "no data", "sin datos", "keine", "k.a.", "withheld",
)
# An IBAN of each length of the registry, with single separators.
_BY_LENGTH = {n: [c for c, m in IBAN_LENGTHS.items() if m == n] for n in sorted(set(IBAN_LENGTHS.values()))}
IBAN_SHAPE = "(?i)\\b(?:" + "|".join(f"(?:{'|'.join(c)})[0-9]{{2}}(?:[ .-]?[A-Z0-9]){{{n - 4}}}" for n, c in _BY_LENGTH.items()) + ")\\b"
IBAN_SEARCH = IBAN_SHAPE.replace("(?i)\\b", "(?i)\\b(?=[A-Z]{2}[0-9]{2})", 1)

#: Only so many bytes of a value are scanned.
SCAN_BYTES = 8192


def scan_prefix(text: Column) -> Column:
    """The part of a value that is scanned: whole characters within the first 8 KiB."""
    cut = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, SCAN_BYTES).cast("string"))
    return F.when(F.octet_length(text) <= SCAN_BYTES, text).otherwise(F.rtrim(F.regexp_replace(cut, "\ufffd+$", "")))


def extract(text: Column, pattern: str) -> Column:
    flags = "(?i)" if pattern.startswith("(?i)") else ""
    return F.regexp_extract_all(text, F.lit(f"{flags}({pattern.removeprefix(flags)})"), F.lit(1))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def email_candidates(text: Column) -> Column:
    """Only texts with an @ are searched."""
    return F.when(text.isNotNull() & ~text.contains("@"), F.array().cast("array<string>")).otherwise(extract(text, EMAIL_SEARCH))


def valid_email(value: Column) -> Column:
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    bounded = (F.octet_length(value) <= 254) & (F.octet_length(local) <= 64) & ~domain.rlike("[^.]{64}")
    return bounded & ~local.startswith(".") & ~local.endswith(".") & ~local.contains("..") & ~domain.rlike("(?:^|[.])-|-(?:[.]|$)")


def find_emails(text: Column) -> Column:
    return F.filter(email_candidates(text), valid_email)


# Issuer ranges of card schemes (ISO/IEC 7812 and the schemes' public documents): a pattern of
# the first digits, and the lengths that go with it.
CARD_RANGES = (
    ("^4", (13, 16, 19)), ("^5[1-5]", (16,)), ("^(?:222[1-9]|22[3-9]|2[3-6]|27[01]|2720)", (16,)), ("^5(?:0|[6-8])", range(13, 20)), ("^3[47]", (15,)),
    ("^35(?:2[89]|[3-8])", range(16, 20)), ("^3(?:0[0-5]|[689])", range(14, 20)), ("^(?:6011|64[4-9]|65|62|67|6304)", range(13, 20)),
)


def card_prefix(value: Column) -> Column:
    """Issuer ranges of the large schemes, by length."""
    known = F.lit(False)
    for pattern, lengths in CARD_RANGES:
        known |= value.rlike(pattern) & F.length(value).isin(*lengths)
    return known


def luhn(value: Column) -> Column:
    return F.call_function("luhn_check", value)


def valid_card(value: Column) -> Column:
    return F.length(value).between(13, 19) & luhn(value) & card_prefix(value)


def card_number(run: Column) -> Column:
    """The digits of the longest leading groups of a run that are a card number, or null."""
    leading = lambda groups: F.transform(F.sequence(F.lit(1), F.size(groups)), lambda i: F.array_join(F.slice(groups, F.lit(1), i), ""))
    of_groups = F.transform(F.array(F.split(run, "[ -]")), lambda groups: F.try_element_at(F.filter(leading(groups), valid_card), F.lit(-1)))
    return F.when(run.rlike("[ -]"), F.get(of_groups, F.lit(0))).when(valid_card(run), run)


def card_candidates(text: Column) -> Column:
    """Runs of digits with single separators; neither after a plus nor with two leading zeros (phones), nor
    a social security number. Each is (run, number), and the number null where none is valid."""
    run = lambda x: ~x.startswith("+") & ~x.startswith("00") & ~F.coalesce(valid_nir(x), F.lit(False))
    pairs = F.transform(F.filter(extract(text, CARD_RUN), run), lambda x: F.struct(x.alias("run"), card_number(x).alias("number")))
    return F.filter(pairs, lambda p: p["number"].isNotNull() | F.length(digits_of(p["run"])).between(13, 19))


def find_cards(text: Column) -> Column:
    return F.filter(F.transform(card_candidates(text), lambda p: p["number"]), lambda x: x.isNotNull())


def find_phones(text: Column) -> Column:
    """North American numbers with the area code in parentheses."""
    return extract(text, NANP)


def _of_bare(value: Column, separators: str, test: Callable[[Column], Column]) -> Column:
    """The test of a value in capitals without separators; these are taken out once, however often it looks at the value."""
    return F.exists(F.array(F.upper(F.translate(value, separators, ""))), test)


def valid_iban(value: Column) -> Column:
    """Country length and the remainder of 97: at once if at most 18 digits are the account, else digit by digit."""

    def valid(bare: Column) -> Column:
        known = F.concat(F.substring(bare, 1, 2), F.length(bare).cast("string")).isin(*[f"{c}{n}" for c, n in IBAN_LENGTHS.items()])
        turned = F.split(F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4)), "")
        number = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        rest = F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), lambda r, c: (F.when(number(c) > 9, r * 100).otherwise(r * 10) + number(c)) % 97)
        letter = lambda i: F.ascii(F.substring(bare, i, 1)) - 55
        country = (letter(1) * 100 + letter(2)) * 100 + F.substring(bare, 3, 2).try_cast("int")
        short = bare.rlike("^[A-Z]{2}[0-9]{3,20}\\z")
        return known & F.when(short, (F.substr(bare, F.lit(5)).try_cast("bigint") % 97 * 1_000_000 + country) % 97 == 1).otherwise(rest == 1)

    return _of_bare(value, " .-", valid)


def find_ibans(text: Column) -> Column:
    return F.filter(extract(text, IBAN_SEARCH), lambda v: F.coalesce(valid_iban(v), F.lit(False)))


def valid_nir(value: Column) -> Column:
    """Sex, month (also the codes of unknown months) and key, which is 97 less the remainder of the number;
    Corsican departments count as 19 and 18. Separators are left out."""

    def valid(bare: Column) -> Column:
        body = F.replace(F.replace(F.substring(bare, 1, 13), F.lit("2A"), F.lit("19")), F.lit("2B"), F.lit("18"))
        key = F.substring(bare, 14, 2).try_cast("int")
        shape = bare.rlike("^[12][0-9]{2}(?:0[1-9]|1[0-2]|[2-3][0-9]|4[0-2]|[5-9][0-9])(?:[0-9]{2}|2[AB])[0-9]{8}$")
        return (F.length(bare) == 15) & shape & (key == 97 - body.try_cast("bigint") % 97)

    return _of_bare(value, " ./-", valid)


def find_nirs(text: Column) -> Column:
    return F.filter(extract(text, NIR_SHAPE), lambda v: F.coalesce(valid_nir(v), F.lit(False)))


def find_aws_ids(text: Column) -> Column:
    return extract(text, AWS_ID)


#: A secret key is forty characters of base64 that stand alone, with letters of both cases and digits.
AWS_SECRET, AWS_CONTEXT = "(?:^|[^A-Za-z0-9/+=])([A-Za-z0-9/+]{40})(?:[^A-Za-z0-9/+=]|$)", "(?i:secret|aws)|\\bA(?:KIA|SIA)[A-Z0-9]{16}\\b"


def find_aws_secrets(text: Column) -> Column:
    """Secret keys in texts that speak of them or hold a key id."""
    found = F.regexp_extract_all(F.regexp_replace(text, "([^A-Za-z0-9/+=])", "$1$1"), F.lit(AWS_SECRET), F.lit(1))  # neighbours may share what stands between
    mixed = lambda v: v.rlike("[A-Z]") & v.rlike("[a-z]") & v.rlike("[0-9]")
    return F.when(text.rlike(AWS_CONTEXT), F.filter(found, mixed)).when(text.isNotNull(), F.array().cast("array<string>"))


def find_password_hashes(text: Column) -> Column:
    return extract(text, HASH_SEARCH)


def is_placeholder(value: Column) -> Column:
    """A word that stands for no value (or no word at all), or one digit repeated five times or more."""
    return F.lower(F.trim(value)).isin("", *PLACEHOLDERS) | F.trim(value).rlike("^(?:0{5,}|1{5,}|2{5,}|3{5,}|4{5,}|5{5,}|6{5,}|7{5,}|8{5,}|9{5,})$")


def typographic_fold(value: Column) -> Column:
    """No-break spaces become spaces, typographic dashes hyphens."""
    folded = F.translate(value, "\u00a0\u2007\u202f\u2010\u2011\u2012\u2013\u2212", "   -----")
    return F.when(F.octet_length(value) == F.length(value), value).otherwise(folded)  # ASCII has none of them


# Mailboxes of systems, and endings of file names that look like domains.
SYSTEM_MAILBOXES = ("noreply", "no-reply", "donotreply", "postmaster", "mailer-daemon", "root", "daemon", "admin", "webmaster", "abuse", "hostmaster", "support", "info")
FILE_ENDINGS = ("png", "jpg", "jpeg", "gif", "svg", "js", "css", "html", "json", "xml", "csv", "txt", "zip", "gz")
TICKET = "^(?:TGT|ST|PT|PGT|PGTIOU|OC|AT|RT)-[0-9]+-[A-Za-z0-9-]{8,}$"


def personal_mailbox(value: Column) -> Column:
    """An address of a person: no system's mailbox, no generated local part, no file name."""
    local, ending = F.lower(F.substring_index(value, "@", 1)), F.lower(F.substring_index(value, ".", -1))
    return ~local.isin(*SYSTEM_MAILBOXES) & ~local.rlike("^[0-9a-f-]{16,}$") & ~ending.isin(*FILE_ENDINGS)


def loose_phone(value: Column) -> Column:
    """A whole value of 7 to 15 digits and separators, for columns whose name speaks of phones."""
    return value.rlike("^\\+?[0-9 ().-]+$") & F.length(F.regexp_replace(value, "[^0-9]", "")).between(7, 15)


def is_ticket(value: Column) -> Column:
    return value.rlike(TICKET)


def screen_tickets(values: DataFrame, key: list[str]) -> DataFrame:
    """Values without tickets; a column with a strict ticket is dropped whole."""
    tainted = values.where(is_ticket(F.col("value"))).select(*key).distinct()
    return values.join(tainted, key, "left_anti")
