"""Dates as people write them, read in built-in functions: year, month, day, and what time of day stands with them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months by number in English, French, German, Spanish, Italian, Portuguese and Dutch, without marks.
MONTHS = {
    1: "january janvier januar enero gennaio janeiro januari jan janv", 2: "february fevrier februar febrero febbraio fevereiro februari feb fevr", 3: "march mars marz marzo marco maart mar mrz",
    4: "april avril abril aprile apr avr", 5: "may mai mayo maggio maio mei", 6: "june juin juni junio giugno junho jun", 7: "july juillet juli julio luglio julho jul juil", 8: "august aout agosto augustus aug ago",
    9: "september septembre septiembre settembre setembro sep sept", 10: "october octobre oktober octubre ottobre outubro oct okt", 11: "november novembre noviembre novembro nov", 12: "december decembre dezember diciembre dicembre dezembro dec dez",
}
FIRST_YEAR, LAST_YEAR = 1900, 2030
_MARKED, _PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn"
_TIME = "(?:[t ]([0-9]{2}):([0-9]{2})(?::[0-9]{2}(?:[.][0-9]+)?)?(?:z|[+-][0-9]{2}:?[0-9]{2})?)?"
_WORD, _ORDINAL = "([a-z]+)[.]?", "(?:st|nd|rd|th|er|o|[.])?"
_WEEKDAY = "^[a-z]+[.]?, ?"
#: Patterns with the groups of year, month and day; the last two of a numeric one are hour and minute.
_NUMERIC = {
    "ymd": ("^[0-9]{4}(?:-[0-9]{1,2}-|/[0-9]{1,2}/|[.][0-9]{1,2}[.])[0-9]{1,2}" + _TIME + "$", "^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})", (1, 2, 3)),
    "dmy": ("^[0-9]{1,2}(?:-[0-9]{1,2}-|/[0-9]{1,2}/|[.][0-9]{1,2}[.])[0-9]{4}" + _TIME + "$", "^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})", (3, 2, 1)),
    "compact": ("^(?:19|20)[0-9]{6}$", "^([0-9]{4})([0-9]{2})([0-9]{2})", (1, 2, 3)),
}
_TEXTUAL = {
    "dmy": (f"^([0-9]{{1,2}}){_ORDINAL}[ -](?:de )?{_WORD}[ -](?:de )?([0-9]{{4}})$", (3, 2, 1)),
    "mdy": (f"^{_WORD} ([0-9]{{1,2}}){_ORDINAL},? ([0-9]{{4}})$", (3, 1, 2)),
    "ymd": (f"^([0-9]{{4}})-{_WORD}-([0-9]{{1,2}})$", (1, 2, 3)),
}
_LABEL = "\\b(?:born(?: on)?|birth ?date|date of birth|dob|birthday|ne(?:e)? le|date de naissance|geboren(?: am)?|geburtsdatum|nacid[oa](?: el)?|fecha de nacimiento|nat[oa] il|nascid[oa] em)\\b[^0-9a-z]{0,4}"
_DATE_IN = "[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}|[0-9]{1,2}(?:st|nd|rd|th|er|[.])?[ -](?:de )?[a-z]+[.]?[ -](?:de )?[0-9]{4}|[a-z]+ [0-9]{1,2}(?:st|nd|rd|th)?,? [0-9]{4}"


def plain_text(text: Column) -> Column:
    return F.translate(F.lower(F.trim(text)), _MARKED, _PLAIN)


def _month(word: Column) -> Column:
    table = F.create_map(*[F.lit(x) for n, names in MONTHS.items() for name in dict.fromkeys(names.split()) for x in (name, n)])
    return F.try_element_at(table, word)


def parse_date(text: Column) -> Column:
    """Struct of year, month, day and timed (`none`, `whole_hour`, `other`); null if the text is no date from
    1900 to 2030. Of two small numbers the first is the day, unless the second can be no month."""
    t = F.regexp_replace(plain_text(text), _WEEKDAY, "")
    number = lambda p, g: F.regexp_extract(t, p, g).try_cast("int")
    made, kind = F, "year int, month int, day int, timed string"
    for name, (whole, parts, (y, m, d)) in _NUMERIC.items():
        year, month, day = number(parts, y), number(parts, m), number(parts, d)
        if name == "dmy":
            swap = (month > 12) & (day <= 12)
            month, day = F.when(swap, day).otherwise(month), F.when(swap, month).otherwise(day)
        hour, minute = (F.regexp_extract(t, whole, 1), F.regexp_extract(t, whole, 2)) if "(" in whole and name != "compact" else (F.lit(""), F.lit(""))
        timed = F.when(F.coalesce(hour, F.lit("")) == "", "none").when(minute == "00", "whole_hour").otherwise("other")
        made = made.when(t.rlike(whole), F.struct(year.alias("year"), month.alias("month"), day.alias("day"), timed.alias("timed")))
    for pattern, (y, m, d) in _TEXTUAL.values():
        made = made.when(t.rlike(pattern), F.struct(number(pattern, y).alias("year"), _month(F.regexp_extract(t, pattern, m)).alias("month"), number(pattern, d).alias("day"), F.lit("none").alias("timed")))
    found = made.otherwise(F.lit(None).cast(f"struct<{kind.replace(' ', ':').replace(',:', ',')}>"))
    return F.transform(F.array(found), lambda s: F.when(_exists(s), s))[0]


def _exists(s: Column) -> Column:
    month_ok = s["month"].between(1, 12) & s["year"].between(FIRST_YEAR, LAST_YEAR)
    days = F.when(s["month"] == 2, F.when((s["year"] % 4 == 0) & ((s["year"] % 100 != 0) | (s["year"] % 400 == 0)), 29).otherwise(28)).when(s["month"].isin(4, 6, 9, 11), 30).otherwise(31)
    return F.coalesce(month_ok & s["day"].between(1, days), F.lit(False))


def labelled_birth_date(text: Column) -> Column:
    """The date that stands right behind a birth label, as `parse_date` gives it."""
    return parse_date(F.regexp_extract(plain_text(text), f"{_LABEL}({_DATE_IN})", 1))
