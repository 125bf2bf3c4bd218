"""Scalar rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from railwatch.schema import CATEGORY_LABELS

_WHITESPACE = " \t\n\r\x0b\x0c"

# Status spellings folded into one vocabulary.
STATUS_SYNONYMS = {
    "SETTLED": ("SETTLED", "COMPLETE", "COMPLETED", "POSTED", "SUCCESS", "SUCCESSFUL"),
    "PENDING": ("PENDING", "PROCESSING", "INITIATED", "IN_PROGRESS"),
    "FAILED": ("FAILED", "REJECTED", "DECLINED", "RETURNED", "CANCELLED"),
}
# Texts read as booleans.
TRUE_TEXTS = ("true", "1", "yes", "y", "t")
FALSE_TEXTS = ("false", "0", "no", "n", "f")

_NUMBER_TEXT = r"(?i)^[+-]?(nan|inf|infinity|(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?)$"
# Date, hour, minute, second, fraction and zone of an ISO text, with or without its dashes and colons.
_ISO_DATE = r"^(\d{4})(-?)(\d{2})\2(\d{2})"
_PLAIN_ZONE = r"(?:Z|[+-][0-9]{2}:[0-9]{2})$"
_PLAIN_TEXT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?(?:Z|[+-][0-9]{2}:[0-9]{2})?$"
_ISO_TEXT = (
    _ISO_DATE + r"(?:[T ](\d{2})(?:(:?)(\d{2})(?:\6(\d{2})(?:[.,](\d{1,6})\d*)?)?)?"
    r"(?:(Z)|([+-]\d{2})(?::?(\d{2}))?)?)?$"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_WHITESPACE))


def is_missing(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def non_empty(text: Column) -> Column:
    """The text, or null where it is empty (an empty text counts as false)."""
    return F.when(text != "", text)


def labelled(labels: dict[str, str], key: Column) -> Column:
    """Look ``key`` up in a small literal table; null where it is absent."""
    result = F.lit(None).cast("string")
    for name, label in labels.items():
        result = F.when(key == name, F.lit(label)).otherwise(result)
    return result


def normalized_status(text: Column) -> Column:
    spelled = F.replace(F.upper(strip(text)), F.lit(" "), F.lit("_"))
    result = spelled
    for status, spellings in STATUS_SYNONYMS.items():
        result = F.when(spelled.isin(*spellings), F.lit(status)).otherwise(result)
    return result


def masked_last4(text: Column) -> Column:
    return F.concat(F.lit("****"), F.right(strip(text), F.lit(4)))


def to_boolean(text: Column) -> Column:
    """The boolean a text spells, or null where it spells none."""
    lowered = F.lower(strip(text))
    return F.when(lowered.isin(*TRUE_TEXTS), F.lit(True)).when(lowered.isin(*FALSE_TEXTS), F.lit(False))


def to_number(text: Column) -> Column:
    """The double a text spells, or null where it spells none."""
    stripped = strip(text)
    digits = F.replace(stripped, F.lit("_"), F.lit(""))
    return F.when(stripped.rlike(_NUMBER_TEXT), digits.try_cast("double"))


def parse_iso(text: Column) -> Column:
    """An instant from an ISO text; no zone means UTC, unreadable means null.

    Dashes and colons may be left out, minutes and seconds too, also in the
    zone. Fractions are cut to microseconds. The plain extended form, which most
    texts have, is cast as it is; only others are taken apart.
    """
    plain = F.when(text.rlike(_PLAIN_TEXT), text).try_cast("timestamp")
    return F.coalesce(plain, _instant(text, zoned=True))


def _instant(text: Column, zoned: bool) -> Column:
    # Missing groups become empty texts, which the pads turn into zeros.
    parts = F.regexp_replace(text, _ISO_TEXT, "$1-$3-$4|$5|$7|$8|$9|$11|$12")
    cells = F.split(parts, r"\|")
    hour, minute, second, fraction, zone, zone_minute = (F.try_element_at(cells, F.lit(i)) for i in range(2, 8))
    clock = F.concat_ws(":", *(F.lpad(c, 2, "0") for c in (hour, minute, second)))
    offset = F.when(zone == "", "Z").otherwise(F.concat(zone, F.lit(":"), F.lpad(zone_minute, 2, "0")))
    whole = F.concat(cells[0], F.lit("T"), clock, F.lit("."), F.rpad(fraction, 6, "0"), offset if zoned else F.lit("Z"))
    return F.when(text.rlike(_ISO_TEXT), whole).try_cast("timestamp")


def wall_clock(text: Column) -> Column:
    """The instant's own local reading, with its zone offset dropped."""
    plain = F.when(text.rlike(_PLAIN_TEXT), F.regexp_replace(text, _PLAIN_ZONE, "")).try_cast("timestamp")
    return F.coalesce(plain, _instant(text, zoned=False))


def week_start(instant: Column) -> Column:
    """Monday 00:00 of the instant's week."""
    return F.date_trunc("week", instant)


def local_week_start(text: Column) -> Column:
    """Monday 00:00 on the text's own wall clock, as an instant."""
    instant, wall = parse_iso(text), wall_clock(text)
    offset = F.unix_micros(wall) - F.unix_micros(instant)
    zoned = F.timestamp_micros(F.unix_micros(week_start(wall)) - offset)
    return F.when(text.endswith("Z"), week_start(instant)).otherwise(zoned)


def map_value_by_suffix(entries: Column, suffix: str) -> Column:
    """Value of the first key that ends with ``suffix``."""
    matching = F.map_filter(entries, lambda key, _value: key.endswith(suffix))
    return F.try_element_at(F.map_values(matching), F.lit(1))


def anomaly_band(score: Column) -> Column:
    return (
        F.when(score < 30.0, "Normal").when(score < 60.0, "Low-Medium").when(score < 80.0, "High").otherwise("Critical")
    )


def priority_level(score: Column) -> Column:
    return F.when(score >= 85.0, "Critical").when(score >= 60.0, "High").when(score >= 35.0, "Medium").otherwise("Low")


def health_band(score: Column) -> Column:
    return F.when(score >= 85.0, "Healthy").when(score >= 70.0, "Watch").when(score >= 50.0, "At Risk").otherwise("Critical")


def observation_tier(total: Column) -> Column:
    return F.when(total > 200, "FULL_MODEL").when(total >= 50, "ENTITY_SPECIFIC").otherwise("SEGMENT_BASELINE")


def drift_scale(mean_abs_z: Column) -> Column:
    """Mean |z|, capped at 5, on a 0-100 scale."""
    return F.least(mean_abs_z, F.lit(5.0)) / 5.0 * 100.0


def timeout_severity(z: Column) -> Column:
    return F.least(F.lit(100.0), F.abs(z) * 20.0)


def cluster_signal(changed: Column) -> Column:
    return F.when(changed, 100.0).otherwise(0.0)


def percent_share(value: Column, total: Column) -> Column:
    """Share of a total in percent, at most 100; null over a zero total."""
    return F.when(total != 0, F.bround(F.least(value / total, F.lit(1.0)) * 100.0, 1))


def account_type(flags: Column) -> Column:
    return F.coalesce(F.try_element_at(flags, F.lit("account_type")), F.try_element_at(flags, F.lit("entity_account_type")))


def category_label(category: Column) -> Column:
    """Display text of a case category, title-cased where none is fixed."""
    fallback = F.initcap(F.replace(category, F.lit("_"), F.lit(" ")))
    return F.coalesce(labelled(CATEGORY_LABELS, category), fallback)


def case_title(category: Column, rail: Column) -> Column:
    return F.concat_ws(" ", rail, category_label(category), F.lit("Cluster"))


def pattern_title(category: Column, rail: Column) -> Column:
    band = F.initcap(F.replace(category, F.lit("FRAUD_"), F.lit("")))
    label = F.when(category.startswith("FRAUD_"), F.concat(band, F.lit(" anomaly cluster"))).otherwise(
        category_label(category)
    )
    return F.concat_ws(" ", rail, label)


def iso_text(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss'Z'")
