"""Plot identities spelled in file names, labels and reference-sheet cells, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# The name patterns every written file follows.
PLOT_PATTERN = r"(?i)plot\s*\(\s*(\d+)\s*\)"
AUG_PATTERN = r"(?i)aug\s*\(\s*(\d+)\s*\)"
BARE_NUMBER_PATTERN = r"^\s*(-?\d+)(?:\.0+)?\s*$"


@dataclass(frozen=True)
class LabelFormat:
    """A number written between fixed ``start`` and ``end`` text."""

    start: str = "plot("
    end: str = ")"

    @property
    def pattern(self) -> str:
        return "(?i)" + quoted(self.start) + r"\s*(-?\d+)\s*" + quoted(self.end)


@dataclass(frozen=True)
class KeyFormat:
    """A required column number and an optional row number read from the same text."""

    col: LabelFormat = field(default_factory=LabelFormat)
    row: LabelFormat | None = None


def quoted(text: str) -> str:
    """``text`` as a literal inside a regular expression (empty text matches nothing extra)."""
    return rf"\Q{text}\E" if text else ""


def _group_or_null(text: Column, pattern: str) -> Column:
    # the first of all matches, since nullif of regexp_extract spells the text out twice, and nested ones double at every level
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(0))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once per row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def plot_number(name: Column) -> Column:
    """The integer inside ``plot(...)``, else null."""
    return _group_or_null(name, PLOT_PATTERN).try_cast("int")


def aug_number(name: Column) -> Column:
    """The integer inside ``aug(...)``, else null."""
    return _group_or_null(name, AUG_PATTERN).try_cast("int")


def aug_level(name: Column) -> Column:
    """The copy number with originals as level 0."""
    return F.coalesce(aug_number(name), F.lit(0))


def label_number(text: Column, fmt: LabelFormat | None = None) -> Column:
    """The number spelled in ``fmt`` anywhere in the text, or the whole text as a bare integer."""
    fmt = fmt or LabelFormat()
    numbers = lambda t: F.coalesce(_group_or_null(t, fmt.pattern), _group_or_null(t, BARE_NUMBER_PATTERN))
    return _once(text.cast("string"), numbers).try_cast("int")


def plot_key(text: Column, fmt: KeyFormat) -> Column:
    """``struct(col, row)``; null as a whole when the column number is missing."""
    def pair(t: Column) -> Column:
        row = label_number(t, fmt.row) if fmt.row is not None else F.lit(None).cast("int")
        return F.struct(label_number(t, fmt.col).alias("col"), row.alias("row"))

    return _once(_once(text, pair), lambda key: F.when(key["col"].isNotNull(), key))


def packed_key(col: Column, row: Column, stride: Column) -> Column:
    """``row * stride + col``, or ``col`` for single-numbered sources."""
    return F.coalesce(row * stride + col, col)


def base_name(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*/", "")


def stem(name: Column) -> Column:
    """The file name without folder and last extension."""
    return F.regexp_replace(base_name(name), r"^(.+)\.[^.]+$", "$1")


def aug_name(original: Column, aug_id: Column, suffix: str = ".laz") -> Column:
    return F.concat(stem(original), F.lit("_aug("), aug_id.cast("string"), F.lit(")" + suffix))


def copy_name(original: Column, suffix: str = ".laz") -> Column:
    return F.concat(stem(original), F.lit(suffix))


def plot_name(label: Column, universal: str = "", suffix: str = ".laz") -> Column:
    return F.concat(F.lit("plot("), label.cast("string"), F.lit(")" + universal + suffix))


def group_label(name: Column) -> Column:
    """The leakage group of a row: its plot, or the row itself when the name carries none."""
    return F.coalesce(F.concat(F.lit("plot:"), plot_number(name).cast("string")), F.concat(F.lit("row:"), name))


def group_number(grp: Column) -> Column:
    """The integer after the last ``:``, null for groups ordered by text."""
    tail = F.regexp_extract(grp, r"([^:]*)$", 1)
    return F.nullif(F.regexp_extract(tail, r"^\s*([+-]?\d+)\s*$", 1), F.lit("")).try_cast("bigint")


def group_order(grp: Column) -> list[Column]:
    """Sort columns: numbered groups by number first, the others by text after them."""
    number = group_number(grp)
    return [number.isNull().asc(), number.asc(), grp.asc()]


def natural_key(path: Column) -> Column:
    """Sortable array in which digit runs compare as numbers and text runs without case."""
    runs = F.regexp_extract_all(path, F.lit(r"(\d+|\D+)"))
    return F.transform(runs, lambda run: F.struct(
        run.rlike(r"^\D").cast("int").alias("is_text"),
        F.coalesce(run.try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias("number"),
        F.when(run.rlike(r"^\D"), F.lower(run)).otherwise(F.lit("")).alias("text"),
    ))
