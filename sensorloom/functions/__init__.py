from sensorloom.functions.scalar import (
    binary_cross_entropy_term,
    clip,
    entity_id,
    epoch_seconds,
    half_even_count,
    is_finite,
    label_of,
    lenient_double,
    log_loss_term,
    nan_to_null,
    predicted_class,
    sigmoid,
)

__all__ = [
    "binary_cross_entropy_term",
    "clip",
    "entity_id",
    "epoch_seconds",
    "half_even_count",
    "is_finite",
    "label_of",
    "lenient_double",
    "log_loss_term",
    "nan_to_null",
    "predicted_class",
    "sigmoid",
]
