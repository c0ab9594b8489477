"""Name folding, globs, and reductions of applications and addresses."""

from __future__ import annotations

import ipaddress
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def fold_name(name: Column) -> Column:
    """Trailing spaces off, lower case, one form of sigma: the identity of a name."""
    return F.replace(F.lower(F.rtrim(name)), F.lit("ς"), F.lit("σ"))


def glob_to_regex(glob: str, fold: bool = True, trim: bool = False) -> str:
    """Anchored regular expression of a glob with * ? and a backslash that escapes the next character."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append("[\\s\\S]*")
        elif c == "?":
            out.append("[\\s\\S]")
        else:
            if c == "\\" and i + 1 < len(glob):
                i += 1
                c = glob[i]
            c = c.lower().replace("ς", "σ") if fold else c
            out.append(c if c.isalnum() or ord(c) > 127 else "\\" + c)
        i += 1
    return "^" + "".join(out) + (" *" if trim else "") + "$"


def glob_match(name: Column, glob: str, fold: bool = True, trim: bool = True) -> Column:
    """Whether a name matches the glob. Newlines are ordinary characters."""
    value = F.replace(F.lower(name), F.lit("ς"), F.lit("σ")) if fold else name
    return value.rlike(glob_to_regex(glob, fold, trim).removesuffix("$") + "\\z")


def globs_overlap(a: str, b: str) -> bool:
    """Whether some name matches both globs (names are compared as they stand)."""

    def tokens(glob: str) -> list[str]:
        return [m[0] if len(m[0]) == 1 else "=" + m[0][1] for m in re.finditer(r"\\[\s\S]|[\s\S]", glob)]

    x, y = ([t if t in "*?" and len(t) == 1 else "=" + t[-1] for t in tokens(g)] for g in (a, b))
    reach = {(0, 0)}
    seen = set(reach)
    while reach:
        i, j = reach.pop()
        if i == len(x) and j == len(y):
            return True
        steps = []
        if i < len(x) and x[i] == "*":
            steps += [(i + 1, j)] + ([(i, j + 1)] if j < len(y) else [])
        if j < len(y) and y[j] == "*":
            steps += [(i, j + 1)] + ([(i + 1, j)] if i < len(x) else [])
        if i < len(x) and j < len(y) and "*" not in (x[i], y[j]) and ("?" in (x[i], y[j]) or x[i] == y[j]):
            steps.append((i + 1, j + 1))
        for s in steps:
            if s not in seen:
                seen.add(s)
                reach.add(s)
    return False


def reduce_application(name: Column) -> Column:
    """Characters of an application name that may be kept, at most 64; null if none is left."""
    kept = F.substring(F.regexp_replace(name, "[^A-Za-z0-9 ._:/+-]", ""), 1, 64)
    return F.when(kept != "", kept)


_V4 = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"{_V4}\.{_V4}\.{_V4}\.{_V4}"


def network_v4(address: Column) -> Column:
    """The /24 network of an IPv4 address; null for anything else."""
    return F.when(address.rlike(f"^{IPV4}$"), F.concat(F.regexp_extract(address, r"^(\d+\.\d+\.\d+)\.", 1), F.lit(".0/24")))


@F.pandas_udf(StringType())
def _literal(address: pd.Series) -> pd.Series:
    def one(text: str) -> str | None:
        try:
            return str(ipaddress.ip_address(text))
        except ValueError:
            return None

    return address.map(one, na_action="ignore")


def client_literal(address: Column) -> Column:
    """The address of a client as a literal in its usual form, or `local` for a socket; null for host names and all else.
    Only what has a colon is read in Python."""
    text = F.trim(address)
    return F.when(text.isin("[local]", "local"), "local").when(text.rlike(f"^{IPV4}$"), text).when(text.contains(":"), _literal(text))


@F.pandas_udf(StringType())
def _network(address: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        try:
            ip = ipaddress.ip_address(text)
        except ValueError:
            return text
        ip = getattr(ip, "ipv4_mapped", None) or ip
        return str(ipaddress.ip_network((ip, 24 if ip.version == 4 else 64), strict=False))

    return address.map(one, na_action="ignore")


def client_network(address: Column) -> Column:
    """IPv4 /24, IPv6 /64, mapped IPv6 as IPv4; `local` and others as they are. Only colons reach Python."""
    return F.coalesce(network_v4(address), F.when(address.contains(":"), _network(address)).otherwise(address))
