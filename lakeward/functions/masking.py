"""Masks, canonical forms and keyed fingerprints of values."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

STARS = "***"


def mask_email(value: Column) -> Column:
    """First letters of mailbox and domain, and the last label: j***@e***.com."""
    domain = F.substring_index(value, "@", -1)
    return F.concat(F.substring(value, 1, 1), F.lit("***@"), F.substring(domain, 1, 1), F.lit("***."), F.substring_index(domain, ".", -1))


def mask_card(value: Column) -> Column:
    """All but the last four digits, in groups of four."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    stars = F.concat(F.repeat(F.lit("*"), F.length(digits) - 4), F.substring(digits, -4, 4))
    return F.trim(F.regexp_replace(stars, "(.{4})", "$1 "))


def bare_identifier(value: Column) -> Column:
    """Without the separators that IBANs and social security numbers may have; upper case."""
    return F.upper(F.regexp_replace(value, "[ ./-]", ""))


def mask_iban(value: Column) -> Column:
    bare = bare_identifier(value)
    stars = F.concat(F.substring(bare, 1, 2), F.repeat(F.lit("*"), F.length(bare) - 6), F.substring(bare, -4, 4))
    return F.trim(F.regexp_replace(stars, "(.{4})", "$1 "))


def mask_phone(value: Column) -> Column:
    """The country code of an international number, and the last two digits."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    tail = F.concat(F.lit("** ** ** "), F.substring(digits, -2, 2))
    return F.when(value.startswith("+"), F.concat(F.regexp_extract(value, "^(\\+[0-9]{1,2})", 1), F.lit(" "), tail)).otherwise(tail)


def mask_name(value: Column) -> Column:
    """Initials of at most four words: J*** D***."""
    words = F.slice(F.filter(F.split(F.trim(value), " +"), lambda w: w != ""), 1, 4)
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lit(STARS))), " ")


def conforms(masked: Column) -> Column:
    """ASCII, at most 128 characters, half of them stars without spaces, no long run of others."""
    stars = F.length(F.regexp_replace(masked, "[^*]", ""))
    solid = F.length(F.regexp_replace(masked, "[ @.+-]", ""))
    return ~masked.rlike("[^\\x20-\\x7e]") & (stars >= 1) & (F.length(masked) <= 128) & (2 * stars >= solid) & ~masked.rlike("[A-Za-z0-9]{5,}")


def mask_as(classifier: Column, value: Column) -> Column:
    """A value that has not the shape of its classifier is masked whole."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    masked = (
        F.when((classifier == "email") & value.rlike("^[^@\\s]+@[^@\\s]+\\.[A-Za-z]{2,}$"), mask_email(value))
        .when((classifier == "card_number") & (digits >= 12), mask_card(value))
        .when((classifier == "iban") & (F.length(value) >= 15), mask_iban(value))
        .when((classifier == "phone") & (digits >= 6), mask_phone(value))
        .when(classifier == "person_name", mask_name(value))
        .when(classifier == "nir", F.lit("* ** ** ** *** *** **"))
        .when(classifier == "birth_date", F.lit("****-**-**"))
        .when(classifier == "aws_key", F.concat(F.substring(value, 1, 4), F.repeat(F.lit("*"), 16)))
        .when(classifier == "password_hash", F.lit("********"))
        .otherwise(F.lit(STARS))
    )
    return F.when(conforms(masked), masked).otherwise(F.lit(STARS))


def normalize(classifier: Column, value: Column) -> Column:
    """The form of a value that its fingerprint is taken of."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (
        F.when(classifier == "email", F.lower(F.trim(value)))
        .when(classifier.isin("card_number", "phone"), digits)
        .when(classifier.isin("iban", "nir"), bare_identifier(value))
        .when(classifier == "person_name", F.lower(F.regexp_replace(F.trim(value), " +", " ")))
        .otherwise(F.trim(value))
    )


def keyed_pads(key: bytes, domain: str) -> tuple[bytes, bytes]:
    """What HMAC-SHA256 puts before a message (with the domain's head), and before the inner digest."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    head = b"lakeward\0" + domain.encode() + b"\0"
    return bytes(b ^ 0x36 for b in block) + head, bytes(b ^ 0x5C for b in block)


def keyed_digest(key: bytes, domain: str):
    """Column function: HMAC-SHA256 of a value in a domain of its own, as two built-in digests."""
    inner, outer = keyed_pads(key, domain)

    def digest(value: Column) -> Column:
        first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(value, "UTF-8")), 256))
        return F.concat(F.lit("hmac-sha256:"), F.sha2(F.concat(F.lit(bytearray(outer)), first), 256))

    return digest
