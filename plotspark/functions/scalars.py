"""Row-level rules that are not about names: units, targets, formatting, small geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Source unit names and metres per unit.
UNIT_SCALES = {
    "Already in metres": 1.0,
    "Millimetres → metres": 0.001,
    "Centimetres → metres": 0.01,
    "Feet → metres": 0.3048,
}

# Chart abbreviations of the models.
MODEL_ABBREVIATIONS = {
    "pls": "PLS", "elastic_net": "Elastic", "lasso": "Lasso", "ridge": "Ridge", "knn": "kNN",
    "svr": "SVR", "random_forest": "RF", "hist_gbt": "HistGBT", "gpr": "GPR",
}


def unit_name(text: Column) -> Column:
    """The unit meant by free text; unknown text means metres."""
    wanted = F.replace(F.replace(F.lower(F.trim(text)), F.lit("->"), F.lit("→")), F.lit(" "), F.lit(""))
    found = F.lit(None).cast("string")
    for name in UNIT_SCALES:
        found = F.coalesce(F.when(wanted == name.lower().replace(" ", ""), F.lit(name)), found)
    return F.coalesce(found, F.lit("Already in metres"))


def unit_scale(text: Column) -> Column:
    name, scale = unit_name(text), F.lit(1.0)
    for unit, factor in UNIT_SCALES.items():
        scale = F.when(name == unit, F.lit(factor)).otherwise(scale)
    return scale


def numeric_or_null(value: Column) -> Column:
    """Text or number as double; non-numeric text and NaN become null."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def log_target(y: Column) -> Column:
    return F.log1p(y)


def from_log_target(z: Column, factor: Column | float = 1.0, clip_zero: bool = True) -> Column:
    raw = F.exp(z) * (factor if isinstance(factor, Column) else F.lit(float(factor))) - F.lit(1.0)
    return F.greatest(raw, F.lit(0.0)) if clip_zero else raw


def error_pct(actual: Column, predicted: Column) -> Column:
    return F.when(actual != 0, F.try_divide(F.abs(predicted - actual), F.abs(actual)) * 100.0)


def balance_index(positive: Column, negative: Column) -> Column:
    """Share of the majority side minus the minority side; null without points."""
    return F.try_divide((positive - negative).cast("double"), (positive + negative).cast("double"))


def edge_length(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt(F.pow(bx - ax, 2) + F.pow(by - ay, 2))


def box_sides(corners: Column) -> tuple[Column, Column]:
    """(short, long) edge of a four-corner box."""
    p = [corners[i] for i in range(3)]
    first = edge_length(p[0]["x"], p[0]["y"], p[1]["x"], p[1]["y"])
    second = edge_length(p[1]["x"], p[1]["y"], p[2]["x"], p[2]["y"])
    return F.least(first, second), F.greatest(first, second)


def box_angle(corners: Column) -> Column:
    """Direction of the long edge in degrees, folded into (-90, 90]."""
    p = [corners[i] for i in range(3)]
    first = edge_length(p[0]["x"], p[0]["y"], p[1]["x"], p[1]["y"])
    second = edge_length(p[1]["x"], p[1]["y"], p[2]["x"], p[2]["y"])
    use_first = first >= second
    dx = F.when(use_first, p[1]["x"] - p[0]["x"]).otherwise(p[2]["x"] - p[1]["x"])
    dy = F.when(use_first, p[1]["y"] - p[0]["y"]).otherwise(p[2]["y"] - p[1]["y"])
    angle = F.degrees(F.atan2(dy, dx))
    return F.when(angle > 90, angle - 180).when(angle <= -90, angle + 180).otherwise(angle)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _units(value: Column, places: Column) -> Column:
    """|value| in units of 10^-places, rounded to an integer from the exact binary value, ties to even.

    The product with the power of ten is split into its rounded value and its exact error, so 379.45 (a little less
    than its decimal text) rounds down at one digit.
    """
    v = F.abs(value)
    scale = F.pow(F.lit(10.0), places.cast("double"))

    def rounded(q: Column) -> Column:
        high = q["c"] - (q["c"] - q["v"])  # the upper half of the bits
        error = (high * q["s"] - q["p"]) + (q["v"] - high) * q["s"]
        rest = (q["p"] - F.floor(q["p"])) + error
        return F.floor(q["p"]) + F.when(rest > 0.5, 1).when(rest < 0.5, 0).otherwise(F.floor(q["p"]) % 2)

    return _let(F.struct(v.alias("v"), scale.alias("s"), (v * scale).alias("p"), (v * 134217729.0).alias("c")), rounded)


def _from_units(units: Column, places: Column) -> Column:
    text = units.cast("string")
    padded = F.lpad(text, F.greatest(F.length(text), places + 1), F.lit("0"))
    return _let(padded, lambda t: F.when(places == 0, t).otherwise(
        F.concat(F.substr(t, F.lit(1), F.length(t) - places), F.lit("."), F.right(t, places))))


def fixed_format(value: Column, digits: int, plus: bool = False) -> Column:
    """``%.<digits>f`` text (``%+.<digits>f`` with ``plus``)."""
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit("+" if plus else ""))
    exact = F.concat(sign, _from_units(_units(value, F.lit(digits)), F.lit(digits)))
    return F.when(F.abs(value) < 1e11, exact).when(value.isNotNull(), F.format_string(f"%{'+' if plus else ''}.{digits}f", value))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def general_format(value: Column, digits: int) -> Column:
    """``%.<digits>g`` text: scientific outside 1e-5 < |v| < 10^digits, trailing zeros removed."""
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    exponent = F.regexp_extract(F.format_string("%.16e", F.abs(value)), r"e([+-]\d+)$", 1).try_cast("int")

    def scientific(v: Column) -> Column:
        return _let(F.format_string(f"%.{digits - 1}e", v), lambda t: F.concat(
            _trimmed(F.regexp_extract(t, r"^([^e]+)e", 1)), F.regexp_extract(t, r"(e[+-]\d+)$", 1)))

    def shown(q: Column) -> Column:
        next_power = q["u"] >= 10 ** digits  # rounding reached the next power of ten
        plain = q["e"].between(-4, digits - 1) & ~((q["e"] == digits - 1) & next_power)
        return (
            F.when(plain, F.concat(sign, F.when(q["e"] == digits - 1, q["u"].cast("string")).otherwise(_trimmed(_from_units(q["u"], q["places"])))))
            .when((q["e"] == -5) & next_power, F.concat(sign, F.lit("0.0001")))
            .when((q["e"] == digits - 1) & next_power, F.concat(sign, F.lit(f"1e+{digits:02d}"))).otherwise(scientific(value)))

    places = F.greatest(F.lit(digits - 1) - F.least(exponent, F.lit(digits - 1)), F.lit(0))
    bounded = F.when(exponent.between(-5, digits - 1), value).otherwise(F.lit(0.0))
    text = _let(F.struct(exponent.alias("e"), F.least(places, F.lit(digits + 4)).alias("places"), bounded.alias("b")), lambda q: _let(
        F.struct(q["e"].alias("e"), q["places"].alias("places"), _units(q["b"], q["places"]).alias("u")), shown))
    return F.when(value.isNotNull(), F.when(value == 0, F.lit("0")).otherwise(text))


def display_value(value: Column, mode: str, is_plot: bool = False) -> Column:
    """One map label: z-score, percentile or raw; empty text when there is no value."""
    if mode == "z":
        text = fixed_format(value, 2, plus=True)
    elif mode == "percentile":
        text = F.concat(fixed_format(value, 0), F.lit("%"))
    elif is_plot:
        text = F.rint(value).cast("bigint").cast("string")
    else:
        wide = (F.abs(value) >= 1000) | ((F.abs(value) < 0.01) & (value != 0))
        text = F.when(wide, general_format(value, 2)).otherwise(fixed_format(value, 1))
    return F.when(value.isNull() | F.isnan(value), F.lit("")).otherwise(text)


def effective_aug(setting: Column, had_augmented: Column) -> Column:
    """A switched-on setting counts as off when the run had no augmented rows; unknown stays unknown."""
    return F.when(setting & (had_augmented == F.lit(False)), F.lit(False)).otherwise(setting)


def toggles_meaningful(has_cube: Column, had_augmented: Column) -> Column:
    return has_cube & F.coalesce(had_augmented, F.lit(True))


def model_abbreviation(model_key: Column) -> Column:
    label = F.initcap(F.replace(model_key, F.lit("_"), F.lit(" ")))
    for key, text in MODEL_ABBREVIATIONS.items():
        label = F.when(model_key == key, F.lit(text)).otherwise(label)
    return label


def run_label(model_key: Column, augmented: Column, nested: Column, target: Column, rrmse: Column, saved_at: Column) -> Column:
    """The one-line text a saved run is listed under (fixed value: its wording)."""
    return F.concat(
        F.lit("[ML] "), model_key, F.when(augmented, F.lit(" (AUG)")).otherwise(F.lit("")),
        F.when(nested, F.lit(" (nested CV)")).otherwise(F.lit("")), F.lit(" — "), target,
        F.lit(" (rRMSE "), general_format(rrmse, 3), F.lit("%, "), saved_at, F.lit(")"),
    )


def safe_run_name(name: Column) -> Column:
    """A typed run name as a Parquet folder name: words of letters, digits, ``.`` and ``-``, joined by ``_``."""
    words = F.regexp_extract_all(name, F.lit(r"[\p{L}\p{N}][\p{L}\p{N}.\-]*"), 0)
    return F.array_join(F.transform(words, lambda w: F.rtrim(w, F.lit(".-"))), "_")
