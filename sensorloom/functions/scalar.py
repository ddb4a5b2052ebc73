"""Column expressions. All are built-in functions, so they stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Clipping bounds of the logit, of the training loss and of the reported log loss.
LOGIT_BOUND = 30.0
LOSS_EPSILON = 1e-7
LOG_LOSS_EPSILON = 2.220446049250313e-16
# End of fixed values.

# Spark also accepts Java literals such as "1.5d" as doubles; only plain decimal, exponent,
# NaN and infinity spellings count as numbers here.
NUMBER_PATTERN = r"(?i)^\s*[+-]?(\d+\.?\d*([e][+-]?\d+)?|\.\d+([e][+-]?\d+)?|inf|infinity|nan)\s*$"


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def nan_to_null(value: str | Column) -> Column:
    value = _col(value)
    return F.when(~F.isnan(value), value)


def lenient_double(text: str | Column) -> Column:
    """Text to double; anything that is not a number becomes NULL."""
    text = _col(text)
    return nan_to_null(F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double")))


def is_finite(value: str | Column) -> Column:
    value = _col(value)
    return F.coalesce(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.lit(False))


def epoch_seconds(timestamp: str | Column) -> Column:
    """Seconds since 1970 of a zone-less timestamp, as a double."""
    origin = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return F.timestamp_diff("MICROSECOND", origin, _col(timestamp)) / F.lit(1e6)


def entity_id(number: str | Column, prefix: str = "p_", width: int = 2) -> Column:
    """Zero-padded id; longer numbers are never truncated."""
    return F.format_string(f"{prefix}%0{width}d", _col(number).cast("long"))


def label_of(condition: str | Column, labels: Mapping[str, int]) -> Column:
    """Class label of a condition name; NULL for a name outside the map."""
    condition = _col(condition)
    result = F.lit(None).cast("int")
    for name, label in labels.items():
        result = F.when(condition == name, F.lit(int(label))).otherwise(result)
    return result


def clip(value: str | Column, low: float, high: float) -> Column:
    value = _col(value)
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def sigmoid(logit: str | Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(logit, -LOGIT_BOUND, LOGIT_BOUND)))


def _cross_entropy(target: str | Column, probability: str | Column, epsilon: float) -> Column:
    p = clip(probability, epsilon, 1.0 - epsilon)
    y = _col(target)
    return -(y * F.log(p) + (1.0 - y) * F.log(1.0 - p))


def binary_cross_entropy_term(target: str | Column, probability: str | Column) -> Column:
    """Per-row training loss; its ``avg`` is the binary cross-entropy."""
    return _cross_entropy(target, probability, LOSS_EPSILON)


def log_loss_term(target: str | Column, probability: str | Column) -> Column:
    """Per-row reported log loss; clipped only at double precision."""
    return _cross_entropy(target, probability, LOG_LOSS_EPSILON)


def predicted_class(probability: str | Column, threshold: float = 0.5) -> Column:
    return (_col(probability) >= F.lit(threshold)).cast("int")


def half_even_count(total: str | Column, fraction: float) -> Column:
    """``max(1, round(total * fraction))`` with ties going to the even neighbour."""
    return F.greatest(F.lit(1), F.bround(_col(total) * F.lit(fraction), 0).cast("long"))
