"""Column transforms and masks, their order in a pipeline, and the classes of sensitive column names."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REDACTED = "***REDACTED***"


def bit_to_bool(x: Column) -> Column:
    return x.cast("boolean")


def money_to_decimal(x: Column) -> Column:
    """Money as text, with or without a currency sign and separators, or as a number."""
    return F.regexp_replace(x.cast("string"), r"[$,\s]", "").try_cast("decimal(19,4)")


def datetime_to_utc(x: Column) -> Column:
    return F.to_utc_timestamp(x.cast("timestamp"), "UTC")


def strip_trailing_nulls(x: Column) -> Column:
    return F.regexp_replace(x, "\u0000+$", "")


def nullify(x: Column) -> Column:
    return F.lit(None).cast("string")


def redact(x: Column) -> Column:
    return F.when(x.isNotNull(), REDACTED)


def sha256_text(x: Column) -> Column:
    return F.sha2(x.cast("string"), 256)


def tokenize(x: Column) -> Column:
    return F.concat(F.lit("TOK_"), F.substring(F.sha2(x.cast("string"), 256), 1, 12))


def partial_email(x: Column) -> Column:
    """The first letter and the domain; without an @ all is redacted."""
    local, domain = F.substring_index(x, "@", 1), F.regexp_replace(x, "^[^@]*@", "")
    return F.when(~x.contains("@"), REDACTED).when(local == "", F.concat(F.lit("*@"), domain)).otherwise(F.concat(F.substring(local, 1, 1), F.lit("***@"), domain))


def last_four(x: Column) -> Column:
    """The last four digits after a mark; a value of four digits or fewer is hidden whole."""
    digits = F.regexp_replace(x.cast("string"), "[^0-9]", "")
    return F.when(F.length(digits) > 4, F.concat(F.lit("****"), F.right(digits, F.lit(4)))).when(x.isNotNull(), "****")


def fpe_numeric(x: Column, salt: str = "") -> Column:
    """A text of the same shape, its digits replaced in order by those of the hash of its digits; a text without digits is redacted, an empty one stays."""
    value = x.cast("string")
    digits = F.regexp_replace(value, "[^0-9]", "")
    digest = F.sha2(F.concat(F.lit(salt), digits), 256)
    chars = F.split(value, "")
    # Each character with the number of digits before it, so that separators don't move the digits.
    placed = F.aggregate(
        chars, F.struct(F.lit("").alias("text"), F.lit(0).alias("n")),
        lambda at, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(at["text"], (F.conv(F.substring(digest, at["n"] % 64 + 1, F.lit(1)), 16, 10).cast("int") % 10).cast("string")).alias("text"), (at["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(at["text"], c).alias("text"), at["n"].alias("n"))),
    )["text"]
    return F.when((digits == "") & (value != ""), REDACTED).otherwise(placed)


TRANSFORMS = {"identity": lambda x: x, "bit_to_bool": bit_to_bool, "money_to_decimal": money_to_decimal, "datetime_to_utc": datetime_to_utc, "strip_trailing_nulls": strip_trailing_nulls, "nullify": nullify, "redact": redact, "hash": sha256_text, "tokenize": tokenize, "partial_email": partial_email, "last_four": last_four, "fpe_numeric": fpe_numeric}

# Patterns of column names, tried in this order, with class and reason; masks by class.
CLASSES = (
    (r"(?i)(ssn|social.?security|national.?id|tax.?id|passport)", "pii", "government ID"),
    (r"(?i)(email|e_mail|mail_addr)", "pii", "email address"),
    (r"(?i)(phone|mobile|cell|fax|telephone)", "pii", "phone number"),
    (r"(?i)(first.?name|last.?name|full.?name|given.?name|surname)", "pii", "personal name"),
    (r"(?i)(address|street|zip|postal|city|state|country)", "pii", "location data"),
    (r"(?i)(dob|date.?of.?birth|birth.?date)", "pii", "date of birth"),
    (r"(?i)(card.?number|credit.?card|pan|cvv|cvc)", "pci", "payment card"),
    (r"(?i)(iban|bank.?account|routing)", "pci", "financial account"),
    (r"(?i)(diagnosis|patient|medical|health|mrn|npi)", "phi", "health data"),
    (r"(?i)(password|passwd|secret|token|api.?key)", "credential", "credential"),
)
CLASS_MASKS = {"pii": "hash", "phi": "nullify", "pci": "fpe_numeric", "credential": "nullify"}


def classify(name: Column) -> Column:
    """(class, reason) of a column name by the first pattern that it has."""
    out = F.struct(F.lit("none").alias("class"), F.lit("").alias("reason"))
    for pattern, kind, reason in reversed(CLASSES):
        out = F.when(name.rlike(pattern), F.struct(F.lit(kind).alias("class"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def default_mask(name: str) -> str | None:
    """The mask of the class of a column's name; None for names that are not sensitive."""
    return next((CLASS_MASKS[kind] for pattern, kind, _ in CLASSES if re.search(pattern, name)), None)


def apply_pipeline(df: DataFrame, type_defaults: Mapping[str, str], sensitivity: Mapping[str, str], explicit: Mapping[str, Sequence[str]]) -> DataFrame:
    """Each column's transforms in order: of its type, of its sensitivity (or an override), and explicit ones; one projection."""
    out = []
    for f in df.schema.fields:
        x = F.col(f.name)
        steps = [type_defaults.get(f.dataType.simpleString()), sensitivity.get(f.name), *explicit.get(f.name, ())]
        for step in filter(None, steps):
            x = TRANSFORMS[step](x)
        out.append(x.alias(f.name))
    return df.select(*out)


def mask_policy(columns: Sequence[str], policy: str, overrides: Mapping[str, str]) -> dict[str, str]:
    """Masks by column under a policy: none; auto masks sensitive columns; strict also refuses identity on them."""
    if policy == "none":
        return {}
    out = {}
    for c in columns:
        mask = default_mask(c)
        chosen = overrides.get(c, mask)
        if policy == "strict" and mask and chosen in (None, "identity"):
            raise ValueError(f"{c} is sensitive and must be masked")
        if chosen:
            out[c] = chosen
    return out
