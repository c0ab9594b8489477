"""Evidence that built-in functions cannot read off a value: names, addresses, dates, phone plans.

`scan_evidence` is one Arrow-batched UDF over distinct values. Word lists are short lists of our own from
general knowledge; a column's decision needs the shares of `decide_evidence`, not single values.
"""

from __future__ import annotations

import re
import unicodedata
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeward.functions.detectors import SCAN_BYTES

# Common given names, surnames, titles, particles, street words, months.
GIVEN = frozenset("anna ben clara daniel david emma eva felix hannah hugo ines james jan jean john jose julia karl laura lea leo lisa louis lucas lucia maria marie mark martin max mia michael nina noah paul peter pierre robert sara sarah sofia thomas tom william".split())
SURNAMES = frozenset("bernard brown davis dubois durand fernandez fischer garcia gomez hoffmann johnson jones leroy lopez martin martinez meyer miller moreau muller perez petit robert rodriguez roux sanchez schmidt schneider simon smith taylor weber williams wilson".split())
TITLES = frozenset("mr mrs ms dr prof herr frau m mme mlle sr sra don".split())
PARTICLES = frozenset("de del der den di du la le van von y zu".split())
ENTITIES = frozenset("paris london berlin madrid google microsoft amazon france germany spain europe bank company gmbh inc ltd".split())
STREET = "street|st|road|rd|avenue|ave|lane|drive|boulevard|blvd|rue|place|chemin|allee|allée|strasse|straße|weg|platz|calle|plaza|avenida|via|piazza"
# Month names by number in English, French, German, Spanish.
MONTHS = {
    1: "january janvier januar enero jan", 2: "february février fevrier februar febrero feb", 3: "march mars märz marzo mar", 4: "april avril abril apr", 5: "may mai mayo", 6: "june juin juni junio jun",
    7: "july juillet juli julio jul", 8: "august août aout agosto aug", 9: "september septembre septiembre sep", 10: "october octobre oktober octubre oct", 11: "november novembre noviembre nov",
    12: "december décembre decembre dezember diciembre dec",
}
_MONTH = {name: n for n, names in MONTHS.items() for name in names.split()}
_ISO = re.compile(r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ](\d{2}):(\d{2}).*)?$")
_DMY = re.compile(r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})(?: (\d{2}):(\d{2}).*)?$")
_TEXTUAL = re.compile(r"^(\d{1,2})(?:st|nd|rd|th|er|\.)?\s+([^\W\d]+)\.?,?\s+(\d{4})$")
_NUMBERED = re.compile(rf"(?:^|\W)(?:\d{{1,4}}[a-z]?(?:\s*(?:bis|ter))?,?\s+(?:\S+\s+){{0,3}}(?:{STREET})\b|(?:{STREET})\s+(?:\S+\s+){{0,3}}\d{{1,4}}\b|\S+(?:strasse|straße|weg|platz)\s+\d{{1,4}}\b)", re.I)
_POST_BOX = re.compile(r"\b(?:p\.?\s?o\.?\s?box|postfach|boîte postale|apartado)\s+\d+", re.I)
_POSTCODE = re.compile(r"\b(?:\d{5}|[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2})\s+[^\W\d]+")
_PHONES = (
    ("strong", re.compile(r"(?<![\w+])\+[1-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\w)")),
    ("strong", re.compile(r"(?<!\w)\([2-9]\d{2}\) ?[2-9]\d{2}-\d{4}(?!\w)")),
    ("normal", re.compile(r"(?<![\w.])0[1-9](?:[ .-]\d{2}){4}(?!\w)")),
    ("normal", re.compile(r"(?<![\w.-])[2-9]\d{2}-[2-9]\d{2}-\d{4}(?![\w-])")),
    ("weak", re.compile(r"(?<![\w.,-])\d{3}[ .]\d{3}[ .]\d{3,4}(?![\w.,-])")),
)
_LABEL = re.compile(r"\b(?:phone|tel|tél|telephone|mobile|cell|fax|telefon|teléfono)\b\W{0,3}$", re.I)
_AWS_SECRET = re.compile(r"(?<![A-Za-z0-9/+=])(?=[A-Za-z0-9/+]*[A-Z])(?=[A-Za-z0-9/+]*[a-z])(?=[A-Za-z0-9/+]*\d)[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])")
_AWS_CONTEXT = re.compile(r"A(?:KIA|SIA)[A-Z2-7]{16}|secret|aws", re.I)
_BORN = re.compile(r"\b(?:born|birth ?date|date of birth|dob|né(?:e)? le|geboren(?: am)?|nacid[oa](?: el)?)\b\W{0,4}", re.I)
_DATE_IN = re.compile(r"\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[./-]\d{1,2}[./-]\d{4}|\d{1,2}(?:st|nd|rd|th|er|\.)?\s+[^\W\d]+\.?,?\s+\d{4}")
EVIDENCE = "phone string, year int, month int, day int, timed string, given boolean, surname boolean, entity boolean, name_shape boolean, address string, aws_secret boolean, born boolean"


def fold_word(word: str) -> str:
    """Lower case without marks; sharp s and ligatures spelled out."""
    plain = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))
    return plain.replace("ß", "ss").replace("æ", "ae").replace("œ", "oe").replace("ø", "o")


def parse_date(text: str) -> tuple[int, int, int, str] | None:
    """Year, month, day and whether a time of day stands with it (none, whole hour, other)."""
    text = text.strip()
    if m := _ISO.match(text):
        y, mo, d, h, mi = m.groups()
    elif m := _DMY.match(text):
        d, mo, y, h, mi = m.groups()
    elif (m := _TEXTUAL.match(text)) and m[2].lower() in _MONTH:
        d, mo, y, h, mi = m[1], _MONTH[m[2].lower()], m[3], None, None
    else:
        return None
    try:
        found = date(int(y), int(mo), int(d))
    except ValueError:
        return None
    if not 1900 <= found.year <= 2030:
        return None
    return found.year, found.month, found.day, "none" if h is None else "whole_hour" if mi == "00" else "other"


def name_evidence(text: str) -> tuple[bool, bool, bool, bool]:
    """(given, surname, entity, shape) of a whole value of one to five words."""
    words = [w for w in re.split(r"[\s,]+", text.strip()) if w]
    core = [w for w in words if fold_word(w.rstrip(".")) not in TITLES and fold_word(w) not in PARTICLES]
    folded = [fold_word(w) for w in core]
    shape = 1 <= len(core) <= 5 and all(re.fullmatch(r"[^\W\d_][^\W\d_'’.-]*(?:[-'’][^\W\d_]+)*\.?", w) and w[0].isupper() for w in core)
    return any(w in GIVEN for w in folded), any(w in SURNAMES for w in folded), any(w in ENTITIES for w in folded), shape


def address_evidence(text: str) -> str | None:
    if _NUMBERED.search(text) or _POST_BOX.search(text):
        return "strong"
    return "weak" if _POSTCODE.search(text) else None


def phone_evidence(text: str) -> str | None:
    """Strongest plan that matches; a label before the number makes any plan strong."""
    best = None
    for strength, plan in _PHONES:
        for m in plan.finditer(text):
            if 7 <= sum(c.isdigit() for c in m[0]) <= 15:
                if strength == "strong" or _LABEL.search(text, 0, m.start()):
                    return "strong"
                best = best or strength
    return best


def evidence(text: str) -> tuple:
    text = unicodedata.normalize("NFC", text.encode()[:SCAN_BYTES].decode(errors="ignore"))
    found = parse_date(text)
    given, surname, entity, shape = name_evidence(text)
    label = _BORN.search(text)
    inside = _DATE_IN.match(text, label.end()) if label else None
    born = bool(inside and parse_date(inside[0]))
    secret = bool(_AWS_SECRET.search(text) and _AWS_CONTEXT.search(text))
    y, m, d, timed = found or (None, None, None, None)
    return phone_evidence(text), y, m, d, timed, given, surname, entity, shape, address_evidence(text), secret, born


def _scan(values: pd.Series) -> pd.DataFrame:
    known = {v: evidence(v) for v in values.dropna().unique()}
    empty = (None,) * len(EVIDENCE.split(", "))
    out = pd.DataFrame([known.get(v, empty) for v in values], columns=[c.split()[0] for c in EVIDENCE.split(", ")])
    for c in ("year", "month", "day"):
        out[c] = out[c].astype("Int32")
    return out


def scan_evidence(value: Column) -> Column:
    return F.pandas_udf(_scan, EVIDENCE)(value)


#: Shares and ages that a column has to have (see SURVEY §2.4).
NAME_SHARE, ADDRESS_SHARE, BORN_MEDIAN, BORN_RECENT, RECENT_YEAR, BORN_SPREAD = 0.7, 0.5, 2002, 0.15, 2015, 10


def decide_evidence(values: DataFrame) -> DataFrame:
    """Per column (object, field): whether it holds person names, postal addresses or birth dates.

    The age rule takes the years' exact ranks: median at index n/2, deciles at n/10 and 9n/10. Years are
    counted first, so at most 131 of them are collected for a column.
    """
    e = values.where("value is not null and value <> ''").withColumn("e", scan_evidence(F.col("value"))).select("object", "field", "value", "e.*")
    yes = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    stats = e.groupBy("object", "field").agg(
        F.count("*").alias("n"),
        yes(F.col("name_shape") & (F.col("given") | F.col("surname"))).alias("named"),
        yes(F.col("given")).alias("given"),
        yes(F.col("entity")).alias("entities"),
        yes(F.col("address") == "strong").alias("addresses"),
        yes(F.col("year").isNotNull()).alias("dated"),
        yes(F.col("year") >= RECENT_YEAR).alias("recent"),
        yes(F.col("day") > 1).alias("other_days"),
        F.max("year").alias("latest"),
        yes(F.col("phone") == "strong").alias("phones"),
        yes(F.col("aws_secret")).alias("secrets"),
    )
    years = e.where("year is not null").groupBy("object", "field", "year").agg(F.count("*").alias("k"))
    listed = years.groupBy("object", "field").agg(F.sort_array(F.collect_list(F.struct("year", "k"))).alias("ys"))
    at = lambda index: F.aggregate(
        "ys",
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("y")),
        lambda s, x: F.struct((s["seen"] + x["k"]).alias("seen"), F.when(s["y"].isNull() & (s["seen"] + x["k"] > index), x["year"]).otherwise(s["y"]).alias("y")),
    )["y"]
    d = F.col("dated")
    both = stats.join(listed, ["object", "field"], "left")
    low, middle, high = at(F.floor(d / 10)), at(F.floor(d / 2)), at(F.least(F.floor(9 * d / 10), d - 1))
    born = (2 * d >= F.col("n")) & (middle <= BORN_MEDIAN) & (high - low >= BORN_SPREAD) & (F.col("recent") <= BORN_RECENT * d) & (F.col("latest") <= 2026) & (F.col("other_days") > 0)
    return both.select(
        "object", "field", "n",
        F.coalesce((F.col("named") >= NAME_SHARE * F.col("n")) & (F.col("given") >= 0.25 * F.col("n")) & (F.col("entities") < 0.2 * F.col("n")), F.lit(False)).alias("person_name"),
        (F.col("addresses") >= ADDRESS_SHARE * F.col("n")).alias("postal_address"),
        F.coalesce(born, F.lit(False)).alias("birth_date"),
        (F.col("phones") >= 3).alias("phone"),
        (F.col("secrets") > 0).alias("aws_key"),
    )
