"""Formats of stored passwords, as their public documents describe them: prefix, options, salt, digest.

crypt(5), the PHC string format, RFC 2307 and RFC 5803, and the formats of frameworks and databases.
"""

from __future__ import annotations

_A64 = "[./0-9A-Za-z]"  # the alphabet of crypt
_B64 = "[0-9A-Za-z+/.]"  # base64, or its variant with a dot
_HEX = "[0-9a-f]"
_D = "[$]"


def crypt(prefix: str, options: str = "", salt: tuple[int, int] | None = None, digest: int | tuple[int, int] = 22) -> str:
    """$prefix$options salt$digest, in the alphabet of crypt."""
    size = lambda n: f"{{{n}}}" if isinstance(n, int) else f"{{{n[0]},{n[1]}}}"
    middle = "" if salt is None else f"{_A64}{size(salt)}{_D}"
    return f"{_D}{prefix}{_D}{options}{middle}{_A64}{size(digest)}"


def phc(names: str, parameters: str) -> str:
    """$name$v=version$parameters$salt$digest."""
    return f"{_D}(?:{names})(?:{_D}v=[0-9]+)?{_D}{parameters}{_D}{_B64}{{4,}}=*{_D}{_B64}{{4,}}=*"


_ROUNDS = f"(?:rounds=[0-9]+{_D})?"
_NAMED = "[a-z]+=[0-9]+(?:,[a-z]+=[0-9]+)*"
_BCRYPT = crypt("2[abxy]?", f"[0-9]{{2}}{_D}", None, 53)

FORMATS: dict[str, str] = {
    # crypt(5)
    "bcrypt": _BCRYPT,
    "yescrypt": f"{_D}g?y{_D}{_A64}+{_D}{_A64}{{0,86}}{_D}{_A64}{{43}}",
    "scrypt": crypt("7", "", (11, 97), 43),
    "sha512crypt": crypt("6", _ROUNDS, (1, 16), 86),
    "sha256crypt": crypt("5", _ROUNDS, (1, 16), 43),
    "sha1crypt": crypt("sha1", f"[0-9]+{_D}", (1, 64), 28),
    "sunmd5": f"{_D}md5(?:,rounds=[0-9]+)?{_D}{_A64}{{1,8}}{_D}{{1,2}}{_A64}{{22}}",
    "md5crypt": crypt("(?:1|apr1)", "", (1, 8), 22),
    "nt": f"{_D}3{_D}{_D}{_HEX}{{32}}",
    # portable PHP hashes, and those of Drupal 7
    "phpass": crypt("[PH]", "", None, 31),
    "drupal": f"U?{crypt('S', '', None, 52)}",
    # PHC strings, in Django's and passlib's wrappers too
    "phc": phc("argon2(?:id|i|d)|scrypt|pbkdf2(?:-sha(?:1|256|512))?", f"(?:{_NAMED}|[0-9]+)"),
    "wrapped": f"(?:bcrypt(?:_sha256)?{_D}{_BCRYPT}|argon2{phc('argon2(?:id|i|d)', _NAMED)})",
    # Django and Werkzeug: algorithm, cost, salt, digest
    "django": f"\\bpbkdf2_sha(?:1|256|512){_D}[0-9]+{_D}{_B64}+{_D}{_B64}{{20,}}=*|\\bscrypt{_D}[0-9]+{_D}{_B64}+{_D}[0-9]+{_D}[0-9]+{_D}{_B64}{{40,}}=*",
    "salted": f"\\b(?:unsalted_)?(?:md5|sha1|sha256){_D}{_B64}{{0,64}}{_D}{_HEX}{{32,64}}",
    "werkzeug": f"\\b(?:pbkdf2:sha(?:1|256|512)(?::[0-9]+)?|scrypt:[0-9]+:[0-9]+:[0-9]+){_D}{_B64}+{_D}{_HEX}{{32,256}}",
    # RFC 5803, and verifiers of databases
    "scram": f"\\bSCRAM-SHA-(?:1|256|512){_D}[0-9]+:{_B64}+=*{_D}{_B64}+=*:{_B64}+=*",
    "md5 verifier": "\\b[Mm][Dd]5[0-9A-Fa-f]{32}\\b",
    "sha1 verifier": "[*][0-9A-F]{40}\\b",
    "spec4 verifier": "\\bS:[0-9A-F]{60}\\b",
    # RFC 2307: a scheme in braces
    "directory": "[{](?:S?(?:SHA(?:224|256|384|512)?|MD5)|(?:BLF-|DES-|MD5-|SHA256-|SHA512-)?CRYPT|BCRYPT|PKCS5S2|PBKDF2(?:-SHA(?:1|256|512))?|ARGON2(?:ID|I|D)?|SCRAM-SHA-(?:1|256))[}][0-9A-Za-z+/.$=,-]{8,}",
}
PASSWORD_HASH = "(?:" + "|".join(FORMATS[k] for k in ("directory", "wrapped", *(f for f in FORMATS if f not in ("directory", "wrapped")))) + ")"
#: The same behind a look at the first characters that these formats have.
HASH_SEARCH = "(?=[$*{UMSmpsu]|bcrypt|argon2)" + PASSWORD_HASH
