"""Text functions as columns: normal form, tokens, slugs, paths, redaction, escapes."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, functions as F


def _decompositions() -> tuple[str, str]:
    """Latin letters whose compatibility form is one ASCII letter and marks, and those letters."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        kept = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(kept) == 1 and kept.isascii():
            pairs.append((chr(code), kept.lower()))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _decompositions()
MARKS = "[\\u0300-\\u036f]"


def normalise(value: Column) -> Column:
    """Lower case without accents. Letters outside of Latin blocks stay as they are."""
    folded = F.regexp_replace(F.translate(F.lower(value), ACCENTED, PLAIN), MARKS, "")
    return F.when(F.octet_length(value) == F.char_length(value), F.lower(value)).otherwise(folded)  # nothing to fold in ASCII


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once for each row. A plain column would be copied to each place that names it, and
    within a lambda function be computed for each element."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


# --- tokens ---------------------------------------------------------------------------------------------------------

# Stop words of document search and of flow search, and words that stand for another one.
STOP_WORDS = ("para", "como", "desde", "sobre")
FLOW_STOP_WORDS = ("de", "del", "el", "la", "los", "las", "para", "flujo")
ADMIN_WORDS = ("administracion", "administrativo", "administrativos")
PERMISSION_WORDS = ("permiso", "permisos")


def _split(value: Column, separators: str, least: int) -> Column:
    return F.array_distinct(F.filter(F.split(normalise(value), separators), lambda t: F.length(t) >= least))


def tokens(value: Column) -> Column:
    """Distinct words of three characters or more, with dots, dashes and slashes inside."""
    return _split(value, "[^a-z0-9_./-]+", 3)


def query_tokens(value: Column) -> Column:
    """Words of a document query, with what they stand for."""
    own = F.filter(tokens(value), lambda t: ~t.isin(*STOP_WORDS))
    some = lambda words: F.exists(own, lambda t: t.isin(*words))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(own, F.when(some(ADMIN_WORDS), F.array(F.lit("admin"))).otherwise(none), F.when(some(PERMISSION_WORDS), F.array(F.lit("permission"), F.lit("permissions"))).otherwise(none)))


def capability_tokens(value: Column) -> Column:
    """Words of a capability query."""
    return F.array_distinct(F.filter(F.transform(tokens(value), lambda t: F.when((t == "administracion") | t.startswith("administrativ"), "admin").otherwise(t)), lambda t: ~t.isin(*STOP_WORDS)))


def flow_tokens(value: Column) -> Column:
    """Words of a flow query or of a route."""
    own = F.filter(_split(value, "[^a-z0-9]+", 2), lambda t: ~t.isin(*FLOW_STOP_WORDS))
    return F.array_distinct(F.concat(own, F.when(normalise(value).rlike("administracion|administrativo"), F.array(F.lit("admin"))).otherwise(F.array().cast("array<string>"))))


def prefix_match(a: Column, b: Column) -> Column:
    return (F.length(a) >= 4) & (F.length(b) >= 4) & (a.startswith(b) | b.startswith(a))


def estimate_tokens(value: Column) -> Column:
    return F.ceil(F.octet_length(value) / 4).cast("long")


# --- names and paths ------------------------------------------------------------------------------------------------


def safe_segment(value: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("item"))


def title(slug: Column) -> Column:
    """Words of a slug, each with a capital."""
    return F.array_join(F.transform(F.split(slug, "[-_.]+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " ")


def capability_slug(path: Column) -> Column:
    """The first part of a route that is neither 'api' nor a version."""
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace(path, "^/", ""), "[{}]", ""), "/"), lambda p: (p != "api") & ~p.rlike("^v[0-9]+$"))
    return F.coalesce(F.nullif(F.lower(F.regexp_replace(F.get(parts, F.lit(0)), "[^A-Za-z0-9._-]+", "-")), F.lit("")), F.lit("capacidad-sin-nombre"))


# Each of these names its value as seldom as it can: an expression that is named twice is computed twice.


def _slashes(path: Column) -> Column:
    """No double slash, and none at the end of more than a slash."""
    return F.regexp_replace(F.regexp_replace(path, "/{2,}", "/"), "(?<=.)/$", "")


def normalise_path(value: Column) -> Column:
    """One slash in front, no double slash, none at the end."""
    return _slashes(F.concat(F.lit("/"), value))


def join_route(prefix: Column, path: Column) -> Column:
    return _slashes(F.concat(prefix, F.lit("/"), path))


_URL, _VARIABLE = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+", r"^\$\{[^}]+\}"


def url_base(value: Column) -> Column:
    """scheme://host:port, or null."""
    return F.lower(F.regexp_substr(value, F.lit(_URL)))


def call_base(value: Column) -> Column:
    """The variable in front of a call's path, or the URL's base, or null."""
    return F.coalesce(F.regexp_substr(value, F.lit(_VARIABLE)), url_base(value))


def call_path(value: Column) -> Column:
    """The path of a call, without variable and base; null if there is none."""
    of_url = F.when(value.rlike(_URL), F.regexp_replace(F.regexp_replace(value, _URL, "/"), "[?#].*$", ""))
    rest = F.coalesce(of_url, F.regexp_replace(value, _VARIABLE, ""))
    return normalise_path(F.regexp_substr(rest, F.lit("(?s)^/.*$")))


def normalise_alias(value: Column) -> Column:
    return F.coalesce(url_base(value), F.regexp_replace(F.lower(F.trim(value)), "/$", ""))


def simple_type(value: Column) -> Column:
    """A type's name without package, generics and nullability."""
    return F.element_at(F.split(F.regexp_replace(F.regexp_replace(value, "<.*$", ""), "[?\\[\\]\\s]", ""), "[.]"), -1)


def receiver(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, "^this[.]", ""))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), "[^.](\\.[^.]*)$", 1))


# --- redaction ------------------------------------------------------------------------------------------------------

_SECRET_NAMES = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|account[_-]?key|client[_-]?secret|private[_-]?key|authorization|credential|connection[_-]?string"
# What counts as a secret, in this order, and what stands in its place.
SECRETS = (
    ("-----BEGIN(?: [A-Z0-9]+)? PRIVATE KEY-----[\\s\\S]*?-----END(?: [A-Z0-9]+)? PRIVATE KEY-----", "[REDACTED PRIVATE KEY]"),
    ("(?i)([a-z][a-z0-9+.-]*://)([^\\s/@:]+):([^\\s/@]+)@", "$1[REDACTED]@[REDACTED-HOST]/"),
    ("(?i)\\bBearer\\s+[A-Za-z0-9._~+/=-]{12,}", "Bearer [REDACTED]"),
    ("(?i)\\bBasic\\s+[A-Za-z0-9+/=]{8,}", "Basic [REDACTED]"),
    ("\\beyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\b", "[REDACTED JWT]"),
    ("\\b(?:AKIA|ASIA)[A-Z0-9]{16}\\b", "[REDACTED ACCESS KEY]"),
    ("\\bgh[pousr]_[A-Za-z0-9]{20,}\\b", "[REDACTED TOKEN]"),
    ("(?i)\\b[a-z0-9]{52}\\b", "[REDACTED]"),
    (f"(?im)(^|[\\s,{{;])({_SECRET_NAMES})\\s*[:=]\\s*(?:\"[^\"]*\"|'[^']*'|[^\\s,;}}]+)", "$1$2=[REDACTED]"),
)


# Parts of secret names, one of which each of them holds.
_NAME_PARTS = ("passw", "pwd", "secret", "token", "key", "authorization", "credential", "string")


def _may_hold_secret(value: Column) -> Column:
    """Whether a rule of SECRETS could match: what each needs, searched as plain text. False means that none does."""
    has = lambda text, part: F.contains(text, F.lit(part))

    def hints(low: Column) -> Column:
        some = lambda *parts: reduce(Column.__or__, (has(low, p) for p in parts))
        return some("-----begin", "bearer", "basic", "eyj") | (some("@") & some("://")) | (some(":", "=") & some(*_NAME_PARTS))

    return (
        let(F.lower(value), hints) | has(value, "AKIA") | has(value, "ASIA") | (has(value, "_") & value.rlike("gh[pousr]_"))
        | value.rlike(SECRETS[7][0])  # the long word: its rule begins at words only
    )


def redact(value: Column) -> Column:
    """A text with marks for its secrets. One that can't hold any isn't given to the rules."""
    return let(value, lambda x: F.when(_may_hold_secret(x), reduce(lambda text, rule: F.regexp_replace(text, *rule), SECRETS, x)).otherwise(x))


def has_secret(value: Column) -> Column:
    """Whether a text still holds a secret. A mark that redact() has left is none."""

    def found(x: Column) -> Column:
        bare = F.regexp_replace(x, f"(?i)({_SECRET_NAMES})=\\[REDACTED\\]", "")
        return _may_hold_secret(x) & bare.rlike("|".join(f"(?:{pattern})" for pattern, _ in SECRETS))  # one pass; a flag holds within its brackets

    return let(value, found)


def value_redactor() -> Callable[[Any], Any]:
    """A function of a JSON value: any value of a secret name is replaced whole, and every rule holds within strings."""
    name = re.compile(_SECRET_NAMES, re.IGNORECASE | re.ASCII)
    rules = [(re.compile(pattern, re.ASCII), re.sub(r"\$(\d)", r"\\\1", mark)) for pattern, mark in SECRETS]

    def redacted(value: str) -> str:
        for pattern, mark in rules:
            value = pattern.sub(mark, value)
        return value

    known: dict[str, str] = {}  # short strings of late: names and paths come again in a file's facts
    secret: dict[str, bool] = {}

    def is_secret(key: str) -> bool:
        if (told := secret.get(key)) is None:
            if len(secret) >= 10_000:
                secret.clear()
            told = secret[key] = name.search(key) is not None
        return told

    def walk(value: Any) -> Any:
        if isinstance(value, str):
            if len(value) > 200:
                return redacted(value)
            if (told := known.get(value)) is None:
                if len(known) >= 10_000:
                    known.clear()
                told = known[value] = redacted(value)
            return told
        if isinstance(value, list):
            return [walk(x) for x in value]
        if isinstance(value, dict):
            return {k: "[REDACTED]" if is_secret(k) else walk(x) for k, x in value.items()}
        return value

    return walk


def redact_json(value_json: Column) -> Column:
    """The text of a JSON value, redacted at any depth. A value that names no secret and holds none stays as it is; only the others
    are walked, in batches, as regular expressions don't nest. A text that is no JSON is redacted as a text."""
    walk = value_redactor()

    def run(values: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            try:
                value = json.loads(text)
            except ValueError:
                return walk(text)
            return json.dumps(walk(value), ensure_ascii=False, separators=(",", ":"))

        return values.map(one, na_action="ignore")

    # what a rule could meet: escapes count, as they may hide a line's or a word's beginning
    strange = value_json.rlike("|".join([f"(?i:{_SECRET_NAMES})", r"\\\\u00", *(f"(?:{pattern})" for pattern, _ in SECRETS[:-1])]))
    return F.coalesce(F.pandas_udf(run, "string")(F.when(strange, value_json)), value_json)


def sanitise_diagnostic(value: Column) -> Column:
    return F.substring(F.regexp_replace(redact(value), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "�"), 1, 4096)


# --- escapes --------------------------------------------------------------------------------------------------------


def markdown_cell(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, "\\|", "\\\\|"), "[\r\n]", " ")


def mermaid_label(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, '"', "'"), "[\r\n\\[\\]{}|<>]", " ")
