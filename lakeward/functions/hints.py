"""What a column's name says about its content: one call for each column, on the driver."""

from __future__ import annotations

import re
import unicodedata

# Words of column names, by classifier, and words that speak against any.
DIRECT = {
    "email": {"email", "mail", "emailaddress", "mailaddress", "courriel", "mel", "correo", "epost"},
    "phone": {"phone", "phonenumber", "tel", "telephone", "mobile", "mobil", "cell", "cellphone", "fax", "telefon", "telefono", "handy", "gsm", "portable", "msisdn"},
    "card_number": {"card", "cardnumber", "pan", "creditcard", "cardno", "ccnumber", "carte", "kreditkarte", "tarjeta"},
    "iban": {"iban", "ibannumber", "bankaccount"},
    "nir": {"nir", "insee", "ssn", "numsecu", "nss", "securitesociale", "socialsecurity"},
    "birth_date": {"birthdate", "birthday", "dob", "birth", "born", "naissance", "datenaissance", "geburtsdatum", "geburtstag", "nacimiento"},
    "person_name": {"firstname", "lastname", "surname", "fullname", "givenname", "familyname", "middlename", "holder", "prenom", "nomfamille", "vorname", "nachname", "apellido", "apellidos"},
    "postal_address": {"address", "street", "adresse", "zip", "zipcode", "postalcode", "postcode", "city", "town", "ville", "rue", "strasse", "plz", "ort", "direccion", "calle", "ciudad"},
    "aws_key": {"aws", "accesskey", "accesskeyid", "secretkey", "secretaccesskey"},
    "password_hash": {"password", "passwd", "pwd", "hash", "passwordhash", "passhash", "motdepasse", "kennwort", "passwort", "contrasena"},
}
NEGATIVE = {"id", "count", "flag", "verified", "template", "opt", "extension", "type", "status", "ref", "sent", "enabled", "length", "format", "attempts", "expires"}
#: Words that name something if they stand together.
TOGETHER = {"aws_key": ({"access", "key"}, {"secret", "key"}, {"secret", "aws"}), "person_name": ({"first", "name"}, {"last", "name"}, {"full", "name"}, {"customer", "name"}, {"user", "nom"})}
#: A hash of a file or of content is no password.
NOT_PASSWORDS = {"file", "content", "commit", "block", "image", "etag", "git"}


def name_tokens(name: str) -> list[str]:
    """Words of a name: camel and snake case taken apart, compatibility forms resolved."""
    plain = unicodedata.normalize("NFKC", name)
    parts = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", plain)
    return [w for w in re.split(r"[^a-z0-9]+", "".join(c for c in unicodedata.normalize("NFD", parts.lower()) if not unicodedata.combining(c))) if w]


def hints(name: str) -> set[str]:
    """Classifiers that the name speaks for; none if a word speaks against it."""
    words = name_tokens(name)
    if any(w in NEGATIVE for w in words):
        return set()
    joined = {"".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, min(i + 3, len(words)) + 1)}
    found = {c for c, listed in DIRECT.items() if joined & listed} | {c for c, groups in TOGETHER.items() if any(g <= set(words) for g in groups)}
    wrong = ({"password_hash"} if NOT_PASSWORDS & set(words) else set()) | ({"postal_address"} if "email" in found else set())
    return found - wrong
