"""Models: a row type with a key, declared over a Spark schema."""

import keyword
import re
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from poolwright.errors import ConfigError

# Types that may order a change stream, and types that may cross
# the wire between programs of different languages.
CURSOR_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.TimestampType, T.TimestampNTZType, T.DateType)
WIRE_TYPES = (*CURSOR_TYPES, T.BooleanType, T.StringType, T.FloatType, T.DoubleType, T.NullType)
SYSTEM = ("_expires_at", "_epoch")


def check_cursor(kind: T.DataType) -> None:
    """Cursors are integers, times and tuples of two to four of these."""
    if isinstance(kind, T.StructType):
        if not 2 <= len(kind.fields) <= 4:
            raise ConfigError("a composite cursor has two to four parts")
        for part in kind.fields:
            check_cursor(part.dataType)
    elif not isinstance(kind, CURSOR_TYPES) or (isinstance(kind, T.DecimalType) and kind.scale):
        raise ConfigError(f"{kind.simpleString()} cannot be a cursor")


def is_wire_portable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return is_wire_portable(kind.elementType)
    if isinstance(kind, T.MapType):
        return is_wire_portable(kind.keyType) and is_wire_portable(kind.valueType)
    if isinstance(kind, T.StructType):
        return len(kind.fields) <= 12 and all(is_wire_portable(f.dataType) for f in kind.fields)
    return isinstance(kind, WIRE_TYPES)


@dataclass(frozen=True)
class Model:
    """A row type: name, schema and key; optionally a cursor column
    (``watermark``) and the promise that its columns are wire-portable."""

    name: str
    schema: T.StructType
    key: str | tuple[str, ...] = "id"
    watermark: str | None = None
    wire_portable: bool = False
    keys: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "keys", (self.key,) if isinstance(self.key, str) else tuple(self.key))
        names = self.schema.names
        if not self.name:
            raise ConfigError("a model has a name")
        if not isinstance(self.schema, T.StructType) or not names:
            raise ConfigError("a model has named columns")
        if len(set(names)) < len(names):
            raise ConfigError("column names repeat")
        if any(n.startswith("_") for n in names):
            raise ConfigError("column names that begin with _ are reserved")
        if not self.keys or any(k not in names for k in self.keys):
            raise ConfigError(f"no key column {self.key!r}")
        if any(isinstance(self.schema[k].dataType, (T.MapType, T.VariantType)) for k in self.keys):
            raise ConfigError("a key is comparable")
        if self.watermark is not None:
            if self.watermark not in names:
                raise ConfigError(f"no cursor column {self.watermark!r}")
            check_cursor(self.schema[self.watermark].dataType)
        if self.wire_portable:
            for f in self.schema.fields:
                if not is_wire_portable(f.dataType):
                    raise ConfigError(f"column {f.name} is not wire-portable")

    @cached_property
    def fields(self) -> "Fields":
        return Fields(self.schema)

    def columns(self) -> list[str]:
        return list(self.schema.names)

    def check(self, df: DataFrame) -> DataFrame:
        """``df`` with this model's columns, or an error where they differ."""
        got = {f.name: f for f in df.schema.fields}
        for want in self.schema.fields:
            if want.name not in got:
                raise ConfigError(f"{self.name}: no column {want.name}")
            if got[want.name].dataType != want.dataType:
                raise ConfigError(f"{self.name}.{want.name}: {got[want.name].dataType.simpleString()}, not {want.dataType.simpleString()}")
        return df.select(*(f"`{n}`" for n in self.schema.names))


class Fields:
    """The columns of a model as attributes, each a typed predicate field."""

    def __init__(self, schema: T.StructType):
        from poolwright.functions.predicate import Field

        for f in schema.fields:
            name = f"{f.name}_" if keyword.iskeyword(f.name) or not re.fullmatch(r"[A-Za-z_]\w*", f.name) else f.name
            setattr(self, name, Field(f.name, f.dataType, f.nullable))
        self._names = {f.name: Field(f.name, f.dataType, f.nullable) for f in schema.fields}

    def __getitem__(self, name: str):
        return self._names[name]


def unsigned(bits: int) -> T.DataType:
    """The Spark type that holds unsigned integers of so many bits."""
    return {8: T.ShortType(), 16: T.IntegerType(), 32: T.LongType(), 64: T.DecimalType(20, 0), 128: T.DecimalType(38, 0)}[bits]
