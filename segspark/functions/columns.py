"""Column expressions shared by the operators. `n` is the class count: when it
is given, the sum over classes is written out so that it stays in generated
code; otherwise the array functions are used."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UNROLL_LIMIT = 32


def sum_over(arr: Column, f, n: int | None = None) -> Column:
    if n is not None and n <= UNROLL_LIMIT:
        return reduce(lambda a, b: a + b, [f(F.get(arr, F.lit(i))) for i in range(n)])
    return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + f(v))


def log_sum_exp(logits: Column, n: int | None = None) -> Column:
    top = F.array_max(logits)
    return top + F.log(sum_over(logits, lambda v: F.exp(v - top), n))


def softmax(logits: Column, n: int | None = None) -> Column:
    if n is not None and n <= UNROLL_LIMIT:
        lse = log_sum_exp(logits, n)
        return F.array(*[F.exp(F.get(logits, F.lit(i)) - lse) for i in range(n)])
    # The inner struct binds the sum once per row instead of once per element.
    bound = F.transform(F.array(logits), lambda l: F.struct(l.alias("l"), log_sum_exp(l).alias("s")))
    return F.get(F.transform(bound, lambda b: F.transform(b["l"], lambda v: F.exp(v - b["s"]))), F.lit(0))


def softmax_at(logits: Column, index: Column, n: int | None = None) -> Column:
    """Probability of one class, without building the whole array."""
    return F.exp(F.get(logits, index) - log_sum_exp(logits, n))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def bce_logits(x: Column, target: Column) -> Column:
    """Stable binary cross-entropy with logits."""
    return F.greatest(x, F.lit(0.0)) - x * target + F.log1p(F.exp(-F.abs(x)))


def argmax(arr: Column) -> Column:
    """Index of the largest entry; the lowest class wins ties."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def ln(x: Column) -> Column:
    """Natural logarithm with IEEE results: -inf at 0, NaN below."""
    return (F.when(x > 0, F.log(x)).when(x == 0, F.lit(float("-inf")))
            .when(x.isNotNull(), F.lit(float("nan"))))


def dot(a: Column, b: Column, n: int | None = None) -> Column:
    if n is not None and n <= UNROLL_LIMIT:
        return reduce(lambda p, q: p + q, [F.get(a, F.lit(i)).cast("double") * F.get(b, F.lit(i)).cast("double") for i in range(n)])
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def unit_draw(seed: int, *keys: Column) -> Column:
    """Reproducible draw in [0, 1) from a seed and row keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def hashed(seed: int):
    """Draw function (salt, *keys) -> [0, 1) that random operators use unless the caller brings one."""
    return lambda salt, *keys: unit_draw(seed, F.lit(salt), *keys)


def lookup(value: Column, mapping: dict[int, int], default: Column | None = None) -> Column:
    """Literal map lookup; ids not listed pass through, or take `default`."""
    pairs = [F.lit(i) for kv in mapping.items() for i in kv]
    found = F.try_element_at(F.create_map(*pairs), value)
    return F.coalesce(found, value if default is None else default)


def zfill(text: Column, width: int) -> Column:
    """Pad with zeros on the left; longer text stays whole."""
    text = text.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def snap(x: Column, digits: int) -> Column:
    """Half-up rounding in plain arithmetic (cheap in generated code)."""
    unit = float(10**digits)
    return F.floor(x * unit + 0.5) / unit
