"""Small text expressions shared by the jobs. All are native columns; nothing runs in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Risk cuts and the words printed for them.
CRITICAL, HIGH, MEDIUM = 0.75, 0.45, 0.20
REDACTED = "R*******"


def or_else(c: Column, default: str) -> Column:
    """The text, or a default when it is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def spaced(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def humanize(code: Column) -> Column:
    return spaced(or_else(code, "unknown"))


def title_label(code: Column) -> Column:
    # initcap starts a word after blanks only, so underscores go first
    return F.initcap(spaced(code))


def redact_name(name: Column) -> Column:
    words = F.filter(F.split(name, r"(?U)\s+"), lambda w: w != "")
    masked = F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lit("***")))
    return F.when(name.isNull() | (name == ""), F.lit(REDACTED)).otherwise(F.array_join(masked, " "))


def iso_time(ts: Column, fmt: str = "yyyy-MM-dd'T'HH:mm:ss'Z'") -> Column:
    """A timestamp as UTC text, whatever the zone of the session."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), fmt)


def short_time(ts: Column) -> Column:
    return F.when(F.length(ts) >= 16, F.substring(ts, 12, 5)).otherwise(ts)


def ellipsize(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def risk_percent(score: Column) -> Column:
    """Whole percent, ties to even; a null score counts as 0."""
    return F.concat(F.bround(F.coalesce(score, F.lit(0.0)) * 100).cast("int").cast("string"), F.lit("%"))


def risk_level(score: Column) -> Column:
    return (F.when(score >= CRITICAL, "critical").when(score >= HIGH, "high")
            .when(score >= MEDIUM, "medium").otherwise("low"))


def risk_tier(score: Column) -> Column:
    return F.when(score >= CRITICAL, "critical").when(score >= HIGH, "risk").otherwise("safe")


def in_risk_band(score: Column, level: str) -> Column | None:
    """Half-open band predicate; an unknown level means no filter. A null score is in no band."""
    bands = {
        "critical": score >= CRITICAL,
        "high": (score >= HIGH) & (score < CRITICAL),
        "medium": (score >= MEDIUM) & (score < HIGH),
        "low": score < MEDIUM,
    }
    return bands.get(level)


def fill(template: str, **parts: Column) -> Column:
    """Column text from a template with {name} slots."""
    pieces: list[Column] = []
    rest = template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        slot, _, rest = rest.partition("}")
        if head:
            pieces.append(F.lit(head))
        pieces.append(parts[slot])
    if rest:
        pieces.append(F.lit(rest))
    return F.concat(*pieces)


def by_case(key: Column, templates: dict[str, str], default: str, **parts: Column) -> Column:
    """One filled template per key value, else the filled default."""
    chain = None
    for value, template in templates.items():
        text = fill(template, **parts)
        chain = F.when(key == value, text) if chain is None else chain.when(key == value, text)
    return chain.otherwise(fill(default, **parts))


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Constant map access; an unknown or null key gives null."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(entries, key)
