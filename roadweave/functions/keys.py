"""Column names, keys and casts: aliases, required columns, trimmed and padded codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rename_aliases(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Each target takes the first of its aliases that the table has, whatever its case; targets that exist stay."""
    have = {c.strip().lower(): c for c in df.columns}
    for target, names in aliases.items():
        if target.lower() in have:
            found = have[target.lower()]
        else:
            found = next((have[n.lower()] for n in names if n.lower() in have), None)
        if found and found != target:
            df = df.withColumnRenamed(found, target)
    return df


def year_column(df: DataFrame, name: str, year: int) -> str:
    """``name``, else ``name_year``, else the first column that starts with ``name_``."""
    for c in (name, f"{name}_{year}"):
        if c in df.columns:
            return c
    found = sorted(c for c in df.columns if c.startswith(f"{name}_"))
    if not found:
        raise ValueError(f"no column for {name}")
    return found[0]


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def number(c: Column | str, default: float | None = None) -> Column:
    """A double where the value reads as one; else null, or ``default``."""
    out = F.expr(f"try_cast(`{c}` AS DOUBLE)") if isinstance(c, str) else c.try_cast("double")
    return out if default is None else F.coalesce(out, F.lit(default))


def fips(c: Column, width: int = 5) -> Column:
    """Trimmed; numeric codes shorter than ``width`` are padded with zeros."""
    t = F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
    return F.when(t.rlike("^[0-9]+$") & (F.length(t) < width), F.lpad(t, width, "0")).otherwise(t)


def zone(c: Column) -> Column:
    """Trimmed, without a trailing .0 and leading zeros; a zone of zeros is 0."""
    t = F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
    return F.when(t.rlike("^0+$"), F.lit("0")).otherwise(F.regexp_replace(t, "^0+", ""))


def last_five_digits(c: Column) -> Column:
    return F.lpad(F.right(F.regexp_replace(c.cast("string"), "[^0-9]", ""), F.lit(5)), 5, "0")


def safe_event_id(c: Column, default: str = "event_000001") -> Column:
    """Only letters, digits, _ and -; blanks and nulls become ``default``."""
    return F.coalesce(F.nullif(F.regexp_replace(F.trim(c), "[^A-Za-z0-9_-]", "_"), F.lit("")), F.lit(default))


#: Freight modes by code.
MODES = {"1": "truck", "2": "rail", "3": "water", "4": "air", "5": "multiple modes", "6": "pipeline", "7": "other"}


def mode_is(c: Column, mode: str) -> Column:
    """The column holds the mode's code or label, whatever its case."""
    want = mode.strip().lower()
    code = next((k for k, v in MODES.items() if want in (k, v)), want)
    return F.lower(F.trim(c.cast("string"))).isin(code, MODES.get(code, code))


def commodity_group(c: Column) -> Column:
    """The five groups of two-digit commodity codes; text that starts with sctg passes; other codes raise an error."""
    text = F.lower(F.trim(c.cast("string")))
    n = F.regexp_replace(text, r"\.0$", "").try_cast("int")
    # The groups' bounds.
    groups = ((1, 9, "sctg0109"), (10, 14, "sctg1014"), (15, 19, "sctg1519"), (20, 33, "sctg2033"), (34, 99, "sctg3499"))
    out = F.when(text.startswith("sctg"), text)
    for lo, hi, name in groups:
        out = out.when(n.between(lo, hi), F.lit(name))
    return out.otherwise(F.raise_error(F.concat(F.lit("no commodity group for "), F.coalesce(text, F.lit("null")))))
