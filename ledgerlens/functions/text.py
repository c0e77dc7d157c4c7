"""Text shapes and column-name tokens, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Column names that hold personal data, and name parts that mark them.
SENSITIVE_NAMES = (
    "emplid", "name", "employee_name", "worker_name", "worker_alias", "email", "phone", "mobile", "ssn", "national_id", "date_of_birth", "dob", "home_address",
)
SENSITIVE_PARTS = "(email|phone|ssn|passport|birth)"


def value_shape(value: Column) -> Column:
    r"""The value as a pattern: each digit run becomes ``\d{n}``, every other character stays, escaped."""
    runs = F.regexp_extract_all(value, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def part(run):
        literal = F.regexp_replace(run, r"([.^$*+?{}\[\]\\|()])", r"\\$1")
        return F.when(run.rlike("^[0-9]"), F.concat(F.lit(r"\d{"), F.length(run).cast("string"), F.lit("}"))).otherwise(literal)

    return F.concat(F.lit("^"), F.array_join(F.transform(runs, part), ""), F.lit("$"))


def digit_mask(value: Column) -> Column:
    """The value with every digit as 0. Two values have the same shape exactly when their masks are equal."""
    return F.translate(value, "123456789", "000000000")


#: One part of a column or concept name: capitals with what follows them, or capitals alone.
NAME_PART = "[A-Z]*[a-z0-9]+|[A-Z]+"


def name_tokens(name: Column) -> Column:
    """Lower-case parts of a camel-case or underscored name."""
    return F.transform(F.regexp_extract_all(name, F.lit(NAME_PART), F.lit(0)), F.lower)


def is_sensitive(name: Column) -> Column:
    lowered = F.array_join(name_tokens(name), "_")
    return lowered.isin(*SENSITIVE_NAMES) | lowered.rlike(SENSITIVE_PARTS)


def humanize(name: Column) -> Column:
    """Readable fallback name: tokens with the first letter raised."""
    words = F.array_join(name_tokens(name), " ")
    return F.when(words == "", name).otherwise(F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 10_000)))
