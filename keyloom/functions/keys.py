"""Key rules: which types order, how keys compare, and encodings for types Spark lacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNSIGNED_64 = T.DecimalType(20, 0)
BIG_INTEGER = T.DecimalType(38, 0)
#: Unsigned widths by bits: the next wider signed type holds them.
UNSIGNED = {8: T.ShortType(), 16: T.IntegerType(), 32: T.LongType(), 64: UNSIGNED_64}
COMPLEX = T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])


def is_complex(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and kind.fieldNames() == ["re", "im"]


def is_key_type(kind: T.DataType) -> bool:
    """Whether values of `kind` are ordered. Complex numbers, maps and variants are not."""
    if is_complex(kind) or isinstance(kind, (T.MapType, T.VariantType)):
        return False
    if isinstance(kind, T.ArrayType):
        return is_key_type(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(is_key_type(f.dataType) for f in kind.fields)
    return True


def check_keys(schema: T.StructType, keys: list[str]) -> None:
    for k in keys:
        if not is_key_type(schema[k].dataType):
            raise TypeError(f"column {k} of type {schema[k].dataType.simpleString()} cannot be a key: it has no order")


def same_key(left: Column, right: Column, kind: T.DataType) -> Column:
    """Probe equality: null finds null, NaN finds nothing, -0.0 finds 0.0."""
    return left.eqNullSafe(right) & findable(left, kind)


def packed_key(columns: Sequence[Column | str]) -> Column:
    """Key columns as one struct. Structs compare null fields as equal, so plain equality of such keys is null-safe, and an aggregate and
    a join by it share one shuffle."""
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"k{i}") for i, c in enumerate(columns)])


def findable(probe: Column, kind: T.DataType) -> Column:
    """Whether a probe can be found at all: NaN can't."""
    return ~F.coalesce(F.isnan(probe), F.lit(False)) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.lit(True)


def either_left(value: Column, right_type: T.DataType | str) -> Column:
    """Tag first, so that every left orders before every right."""
    return F.struct(F.lit(0).alias("tag"), value.alias("left"), F.lit(None).cast(right_type).alias("right"))


def either_right(value: Column, left_type: T.DataType | str) -> Column:
    return F.struct(F.lit(1).alias("tag"), F.lit(None).cast(left_type).alias("left"), value.alias("right"))


def complex_of(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def unsigned(value: Column, bits: int) -> Column:
    """`value` in the type that holds unsigned integers of `bits`; out of range raises."""
    wide = value.cast(BIG_INTEGER)
    limit = F.lit(str(2**bits - 1)).cast(BIG_INTEGER)
    bad = F.raise_error(F.concat(F.lit(f"not an unsigned {bits}-bit integer: "), wide.cast("string")))
    return F.when(wide.isNull() | ((wide >= 0) & (wide <= limit)), wide).otherwise(bad).cast(UNSIGNED[bits])


def exact_sum(value: Column) -> Column:
    """A sum of 64-bit integers that cannot overflow before 38 digits."""
    return F.sum(value.cast(BIG_INTEGER))
