"""Postal addresses as they are written in a few countries: house number and street, post box, postcode and town.

The patterns keep to what Java and RE2 read alike; the SQL of the queries uses the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words for streets that stand before or behind a name, and endings that are written onto one.
STREETS = (
    "street", "st", "road", "rd", "avenue", "ave", "lane", "drive", "boulevard", "blvd", "court", "square", "terrace", "way", "rue", "place", "chemin", "allee", "allée", "impasse", "quai", "route", "cours", "calle", "plaza", "avenida",
    "paseo", "via", "piazza", "viale", "corso", "rua", "praça", "straat", "laan",
)
ENDINGS = ("straße", "strasse", "str", "weg", "platz", "allee", "gasse", "ring", "straat", "laan", "plein")
BOXES = ("p[.]?o[.]? ?box", "post ?box", "postfach", "boîte postale", "bp", "apartado", "casella postale", "postbus")

_WORD, _NUMBER = "[\\p{L}'’.-]+", "[0-9]{1,4} ?[a-z]?(?: ?(?:bis|ter|quater))?"
_STREET, _ENDING = "|".join(STREETS), "|".join(ENDINGS)
#: Number before a street, a street and a number behind it, a name that ends as a street and a number, a box.
STRONG = (
    f"(?i)(?:^|[^\\p{{L}}0-9]){_NUMBER},? (?:{_WORD} ){{0,4}}(?:{_STREET})(?:[^\\p{{L}}]|$)",
    f"(?i)(?:^|[^\\p{{L}}])(?:{_STREET}) (?:{_WORD} ){{0,4}}{_WORD},? (?:n[o°.]* ?)?[0-9]{{1,4}}[a-z]?(?:[^\\p{{L}}0-9]|$)",
    f"(?i)(?:^|[^\\p{{L}}])[\\p{{L}}-]+(?:{_ENDING})[.]? [0-9]{{1,4}} ?[a-z]?(?:[^\\p{{L}}0-9]|$)",
    f"(?i)(?:^|[^\\p{{L}}])(?:{'|'.join(BOXES)}) (?:n[o°.]* ?)?[0-9]+(?:[^\\p{{L}}0-9]|$)",
)
#: A postcode (five digits, or the British form) and a town.
WEAK = "(?:^|[^\\p{L}0-9])(?:[0-9]{5}|[0-9]{4} ?[A-Z]{2}|[A-Z]{1,2}[0-9][A-Z0-9]? ?[0-9][A-Z]{2}) \\p{Lu}\\p{L}+"


def address_strength(value: Column) -> Column:
    """`strong`, `weak`, or null for no address."""
    strong = value.rlike(STRONG[0])
    for pattern in STRONG[1:]:
        strong = strong | value.rlike(pattern)
    return F.when(strong, "strong").when(value.rlike(WEAK), "weak")
