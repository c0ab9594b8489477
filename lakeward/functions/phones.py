"""Telephone numbers: ITU-T E.164 and E.123, the North American plan, and how some countries write their own.

One pattern, compiled from the tables, finds what is written like a number; the grade asks whether the
number exists in its plan and how it is grouped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WEAK, NORMAL, STRONG = 1, 2, 3

# Country codes of two digits, and the first digits of those of three (ITU-T E.164).
TWO_DIGIT_CODES = (
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58",
    "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
)
THREE_DIGIT_ZONES = ("21", "22", "23", "24", "25", "26", "29", "35", "37", "38", "42", "50", "59", "67", "68", "69", "80", "85", "87", "88", "96", "97", "99")
# Region of a code, and the digits of its national numbers (fewest, most).
REGIONS = {
    "1": ("US", 10, 10), "7": ("RU", 10, 10), "30": ("GR", 10, 10), "31": ("NL", 9, 9), "32": ("BE", 8, 9), "33": ("FR", 9, 9), "34": ("ES", 9, 9), "36": ("HU", 8, 9), "39": ("IT", 6, 11),
    "40": ("RO", 9, 9), "41": ("CH", 9, 9), "43": ("AT", 7, 12), "44": ("GB", 9, 10), "45": ("DK", 8, 8), "46": ("SE", 7, 9), "47": ("NO", 8, 8), "48": ("PL", 9, 9), "49": ("DE", 7, 11),
    "52": ("MX", 10, 10), "55": ("BR", 10, 11), "61": ("AU", 9, 9), "81": ("JP", 9, 10), "86": ("CN", 10, 11), "91": ("IN", 10, 10), "212": ("MA", 9, 9), "213": ("DZ", 8, 9), "216": ("TN", 8, 8),
    "351": ("PT", 9, 9), "352": ("LU", 5, 11), "353": ("IE", 7, 9), "358": ("FI", 5, 12), "420": ("CZ", 9, 9), "421": ("SK", 9, 9),
}
OTHER_LENGTHS = (5, 12)
#: How national numbers are written: d any digit, A 1 to 9, N 2 to 9; a space stands for one separator, a
#: slash for a separator that may be a slash too.
WRITTEN = {
    "US": ("Ndd Ndd dddd", "1 Ndd Ndd dddd"),
    "FR": ("0A dd dd dd dd",),
    "BE": ("0A/ddd dd dd", "0Ad/dd dd dd", "04dd/dd dd dd"),
    "NL": ("0Ad ddd dddd", "0Add dddddd", "06 dddddddd"),
    "GB": ("0Ad dddd dddd", "0Add ddd dddd", "0Addd dddddd", "0Addd ddd ddd"),
    "DE": ("0Ad/ddddddd", "0Ad/dddddddd", "0Add/ddddddd", "0Add/dddd dddd", "0Addd/dddddd"),
    "CH": ("0Ad ddd dd dd",),
    "IT": ("0A dddddddd", "3dd ddd dddd", "3dd ddddddd"),
    "ES": ("6dd ddd ddd", "7Ad ddd ddd", "9Ad ddd ddd", "6dd dd dd dd", "7Ad dd dd dd", "8Ad dd dd dd", "9Ad dd dd dd"),
    "PT": ("9Ad ddd ddd", "2Ad ddd ddd"),
}
_CLASSES = {"d": "[0-9]", "A": "[1-9]", "N": "[2-9]", " ": "[ .-]", "/": "[ ./-]"}


def compiled(template: str) -> str:
    """A template as a pattern; runs of one class are counted."""
    out, at = "", 0
    while at < len(template):
        to = at
        while to < len(template) and template[to] == template[at]:
            to += 1
        out += _CLASSES.get(template[at], template[at]) + (f"{{{to - at}}}" if to - at > 1 else "")
        at = to
    return out


def in_brackets(template: str) -> str:
    """The template with its first group in brackets."""
    first, rest = template.split(" ", 1) if " " in template else template.split("/", 1)
    return f"[(]{compiled(first)}[)][ .-]?{compiled(rest)}"


CODE = f"(?:1|7|{'|'.join(TWO_DIGIT_CODES)}|(?:{'|'.join(THREE_DIGIT_ZONES)})[0-9])"
INTERNATIONAL = f"(?:[+]|\\b00){CODE}(?:[ ./-]?[(]?[0-9][)]?){{5,14}}\\b"
NATIONAL = {region: "|".join([*map(in_brackets, (t for t in templates if t[0] != "1")), *(f"\\b{compiled(t)}\\b" for t in templates)]) for region, templates in WRITTEN.items()}
#: Ten or eleven digits behind a trunk zero, in one run.
BARE = "\\b0[1-9][0-9]{8,9}\\b"
PHONE = "|".join([INTERNATIONAL, *NATIONAL.values(), BARE])


def _by_beginning() -> str:
    """`PHONE` with its alternatives, in their order, under the characters that they begin with; the shortest has seven."""
    bracketed = "|".join(in_brackets(t) for templates in WRITTEN.values() for t in templates if t[0] != "1")
    plain = lambda zero: [f"\\b{compiled(t)}\\b" for templates in WRITTEN.values() for t in templates if (t[0] == "0") == zero]
    ways = (("[+0]", INTERNATIONAL), ("[(]", bracketed), ("0", "|".join([*plain(True), BARE])), ("[1-9]", "|".join(plain(False))))
    return "(?=[+(]|\\b[0-9])(?=.[0-9 ./()-]{6})(?:" + "|".join(f"(?={first})(?:{some})" for first, some in ways) + ")"


#: What is searched for: it finds what `PHONE` does, and leaves most places of a text after a look at a character or seven.
PHONE_SEARCH = _by_beginning()
EXISTING = "^(?:" + "|".join(f"{code}[0-9]{{{lo},{hi}}}" for code, (_, lo, hi) in REGIONS.items()) + ")$"
LISTED = "^(?:" + "|".join(REGIONS) + ")"
AREA_CODES = "^1?[2-9](?:[02-9][0-9]|1[02-9])[2-9](?:[02-9][0-9]|1[02-9])[0-9]{4}$"  # no N11, which is a service


class Form:
    """The operations that the grade is made of; Spark and SQL have one each."""

    def __init__(self, match: Callable, drop: Callable, when: Callable, both: Callable, length: Callable, luhn: Callable) -> None:
        self.match, self.drop, self.when, self.both, self.length, self.luhn = match, drop, when, both, length, luhn

    def grade(self, value):
        """WEAK, NORMAL or STRONG; null if no plan has such a number."""
        match, drop, both = self.match, self.drop, self.both
        digits = drop(value, "[^0-9]")
        abroad = drop(drop(value, "[(]0[)]"), "^00|[^0-9]")
        exists = self.when([(match(abroad, LISTED), match(abroad, EXISTING))], match(abroad, f"^[0-9]{{{OTHER_LENGTHS[0] + 3},{OTHER_LENGTHS[1] + 3}}}$"))
        american = match(value, f"^(?:{NATIONAL['US']})$")
        company = both(match(value, "^[0-9]{3}[^0-9][0-9]{3}[^0-9][0-9]{3}$"), self.luhn(digits))  # a French SIREN
        # One kind of separator, apart from what follows an area code or a leading 1.
        alike = match(drop(value, "^1[ .-]|^[(][0-9]+[)][ .-]?|^[0-9]+/|[0-9]"), "^(?: *|[.]*|-*)$")
        return self.when(
            [
                (match(value, "^(?:[+]|00)"), self.when([(exists, self.when([(match(value, "^[+]"), STRONG), (match(value, "[^0-9]"), NORMAL)], WEAK))], None)),
                (american, self.when([(both(match(digits, AREA_CODES), alike), self.when([(match(value, "[(]"), STRONG)], NORMAL))], None)),
                (match(value, "^[0-9]+$"), WEAK),
                (both(alike, self.when([(company, False)], True)), self.when([(match(value, "^[(]"), STRONG)], NORMAL)),
            ],
            None,
        )


def _spark_when(cases: list, otherwise) -> Column:
    chain = F
    for test, value in cases:
        chain = chain.when(test, value)
    return chain.otherwise(otherwise)


SPARK = Form(
    match=lambda v, p: v.rlike(p),
    drop=lambda v, p: F.regexp_replace(v, p, ""),
    when=_spark_when,
    both=lambda a, b: a & b,
    length=F.length,
    luhn=lambda v: F.call_function("luhn_check", v),
)


def phone_grade(value: Column) -> Column:
    return SPARK.grade(value)


def phone_region(value: Column) -> Column:
    """The region of an international number, or null. A national number has the regions of `national_regions`."""
    abroad = F.regexp_replace(value, "^00|[^0-9]", "")
    chain = F
    for code, (region, _, _) in sorted(REGIONS.items(), key=lambda x: -len(x[0])):
        chain = chain.when(abroad.startswith(code), F.lit(region))
    return F.when(value.rlike("^(?:[+]|00)"), chain.otherwise(F.lit(None)))


def national_regions(value: Column) -> Column:
    """The regions in which a national number is written like that."""
    return F.filter(F.array(*[F.when(value.rlike(f"^(?:{p})$"), F.lit(region)) for region, p in NATIONAL.items()]), lambda r: r.isNotNull())


#: Regions whose national numbers begin with a trunk zero that is left out behind the country code.
TRUNK_ZERO = ("FR", "BE", "NL", "GB", "DE", "CH", "AT")


def e164(value: Column, region: Column) -> Column:
    """Country code and national number, digits only: of an international number its own, of a national one that of the
    region; null where no region is known."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    abroad = F.regexp_replace(F.regexp_replace(value, "[(]0[)]", ""), "^00|[^0-9]", "")
    codes = F.create_map(*[F.lit(x) for code, (name, _, _) in REGIONS.items() for x in (name, code)])
    national = F.when(region.isin(*TRUNK_ZERO), F.regexp_replace(digits, "^0", "")).when(region == "US", F.substring(digits, -10, 10)).otherwise(digits)
    return F.when(value.rlike("^(?:[+]|00)"), abroad).otherwise(F.concat(F.try_element_at(codes, region), national))
