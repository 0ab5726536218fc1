"""Column expressions over scores, score arrays and token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from utterlake.functions.text import _col, bind


def sigmoid(value: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(value)))


def softmax(scores: Column | str) -> Column:
    """Probabilities of a score array; the largest score is taken off first."""

    def shares(values: Column) -> Column:
        top = F.array_max(values)
        return bind(
            F.transform(values, lambda v: F.exp(v - top)),
            lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, x: a + x)),
        )

    return bind(_col(scores).cast("array<double>"), shares)


def argmax(scores: Column | str) -> Column:
    """Zero-based place of the largest score, the first one on ties."""
    value = _col(scores)
    return (F.array_position(value, F.array_max(value)) - 1).cast("int")


def fixed4(value: Column | str) -> Column:
    return F.format_string("%.4f", _col(value).cast("double"))


def pad_truncate(tokens: Column | str, length: int, pad: int = 0) -> Column:
    """Token array cut or filled to ``length``."""
    value = _col(tokens)
    filled = F.concat(value, F.array_repeat(F.lit(pad).cast("int"), length))
    return F.slice(filled, 1, length)


def attention_mask(tokens: Column | str, length: int) -> Column:
    """1 for kept tokens, 0 for fill."""
    kept = F.least(F.size(_col(tokens)), F.lit(length))
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.when(i <= kept, 1).otherwise(0))


def safe_ratio(top: Column, bottom: Column) -> Column:
    """Quotient, 0 when the divisor is 0."""
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(0.0))
