"""Names and constructors of data types, fields and schemas, over Spark's own types."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the accepted names of primitive types
NAMES = {
    "int8": T.ByteType(), "i8": T.ByteType(), "int16": T.ShortType(), "i16": T.ShortType(), "int32": T.IntegerType(), "int": T.IntegerType(), "i32": T.IntegerType(), "int64": T.LongType(), "i64": T.LongType(),
    "uint8": T.ShortType(), "u8": T.ShortType(), "uint16": T.IntegerType(), "u16": T.IntegerType(), "uint32": T.LongType(), "uint": T.LongType(), "u32": T.LongType(), "uint64": T.DecimalType(20, 0), "u64": T.DecimalType(20, 0),
    "float16": T.FloatType(), "float32": T.FloatType(), "f32": T.FloatType(), "float64": T.DoubleType(), "float": T.DoubleType(), "f64": T.DoubleType(), "str": T.StringType(), "utf8": T.StringType(), "bool": T.BooleanType(),
    "binary": T.BinaryType(), "null": T.NullType(), "date32": T.DateType(), "date64": T.TimestampNTZType(),
}
NUMERIC = (T.NumericType,)


class DataType:
    """A Spark type by the name of a primitive type, or around one that a constructor below made."""

    def __init__(self, kind: str | T.DataType | DataType):
        if isinstance(kind, DataType):
            kind = kind.spark
        if isinstance(kind, str):
            if kind.lower() not in NAMES:
                raise ValueError(f"no type is named {kind!r}")
            kind = NAMES[kind.lower()]
        self.spark = kind

    def is_numeric(self) -> bool:
        return isinstance(self.spark, NUMERIC)

    def to_json(self) -> str:
        return self.spark.json()

    @staticmethod
    def from_json(text: str) -> DataType:
        return DataType(T.StructType.fromJson({"type": "struct", "fields": [{"name": "x", "type": json.loads(text), "nullable": True, "metadata": {}}]})["x"].dataType)

    def __eq__(self, other) -> bool:
        return isinstance(other, DataType) and self.spark == other.spark

    def __hash__(self) -> int:
        return hash(self.spark)

    def __repr__(self) -> str:
        return f"DataType({self.spark.simpleString()})"


class Field:
    """A named type; not nullable unless said so."""

    def __init__(self, name: str, datatype: str | DataType, nullable: bool = False, qualifier: str | None = None):
        self.name, self.qualifier, self._type, self._nullable = name, qualifier, DataType(datatype), nullable

    def is_nullable(self) -> bool:
        return self._nullable

    def datatype(self) -> DataType:
        return self._type

    @property
    def spark(self) -> T.StructField:
        return T.StructField(self.name, self._type.spark, self._nullable, {"qualifier": self.qualifier} if self.qualifier else None)

    def to_json(self) -> str:
        return self.spark.json()

    @staticmethod
    def of(field: T.StructField) -> Field:
        return Field(field.name, DataType(field.dataType), field.nullable, (field.metadata or {}).get("qualifier"))

    @staticmethod
    def from_json(text: str) -> Field:
        return Field.of(T.StructField.fromJson(json.loads(text)))

    def __eq__(self, other) -> bool:
        return isinstance(other, Field) and self.spark == other.spark and self.qualifier == other.qualifier

    def __hash__(self) -> int:
        return hash((self.name, self.qualifier))


class Schema:
    """Fields in order, with metadata."""

    def __init__(self, *fields: Field, **metadata: str):
        self.fields, self.metadata = list(fields), dict(metadata)

    @property
    def spark(self) -> T.StructType:
        return T.StructType([f.spark for f in self.fields])

    def to_json(self) -> str:
        return json.dumps({"schema": json.loads(self.spark.json()), "metadata": self.metadata})

    @staticmethod
    def from_json(text: str) -> Schema:
        d = json.loads(text)
        return Schema(*map(Field.of, T.StructType.fromJson(d["schema"])), **d["metadata"])

    def __eq__(self, other) -> bool:
        return isinstance(other, Schema) and (self.fields, self.metadata) == (other.fields, other.metadata)

    __hash__ = None


class DFSchema:
    """Qualified fields: of Field objects or dicts, or of a schema under one qualifier; a join puts two together."""

    def __init__(self, *fields: Field | dict, qualifier: str | None = None, schema: Schema | None = None):
        if schema is not None and fields:
            raise ValueError("give fields or a schema, not both")
        made = [f if isinstance(f, Field) else Field(f["name"], f["datatype"], f.get("nullable", False), f.get("qualifier")) for f in fields or (schema.fields if schema else ())]
        self.fields = [Field(f.name, f.datatype(), f.is_nullable(), qualifier or f.qualifier) for f in made]
        names = [(f.qualifier, f.name) for f in self.fields]
        if len(set(names)) < len(names):
            raise ValueError("two fields have one name")

    @staticmethod
    def of(schema: T.StructType, qualifier: str | None = None) -> DFSchema:
        return DFSchema(*map(Field.of, schema), qualifier=qualifier)

    def join(self, other: DFSchema) -> DFSchema:
        return DFSchema(*self.fields, *other.fields)

    @property
    def spark(self) -> T.StructType:
        return T.StructType([f.spark for f in self.fields])


def _sized(n: int) -> int:
    if n < 0:
        raise ValueError("a size can't be negative")
    return n


def List(item: Field) -> DataType:
    return DataType(T.ArrayType(item.datatype().spark, item.is_nullable()))


LargeList = List


def FixedSizeList(item: Field, size: int) -> DataType:
    """An array; check_size holds a column of it to the length."""
    _sized(size)
    return List(item)


def check_size(column: Column, size: int) -> Column:
    """The arrays of the column, an error where one has another length; null stays null."""
    return F.when(F.size(column) == _sized(size), column).when(column.isNotNull(), F.raise_error(F.format_string("an array of %d values where %d are due", F.size(column), F.lit(size))))


def FixedSizeBinary(size: int) -> DataType:
    _sized(size)
    return DataType(T.BinaryType())


def Interval(unit: str = "DayTime") -> DataType:
    if unit not in ("DayTime", "YearMonth"):
        raise ValueError(f"no interval unit is named {unit!r}")
    return DataType(T.YearMonthIntervalType() if unit == "YearMonth" else T.DayTimeIntervalType())


def Date(date32: bool = False) -> DataType:
    return DataType("date32" if date32 else "date64")


UNITS = ("Second", "Millisecond", "Microsecond", "Nanosecond")


def _unit(unit: str) -> None:
    if unit not in UNITS:
        raise ValueError(f"no time unit is named {unit!r}")


def Time(unit: str = "Millisecond", time32: bool = True) -> DataType:
    _unit(unit)
    if time32 != (unit in UNITS[:2]):
        raise ValueError("32 bits hold seconds and milliseconds, 64 bits the rest")
    return DataType(T.TimeType() if hasattr(T, "TimeType") else T.LongType())


def Duration(unit: str = "Millisecond") -> DataType:
    _unit(unit)
    return DataType(T.DayTimeIntervalType())


def Timestamp(unit: str = "Microsecond", timezone: str | None = None) -> DataType:
    """Microseconds in any case; with a time zone an instant, without one a wall-clock time."""
    _unit(unit)
    return DataType(T.TimestampType() if timezone else T.TimestampNTZType())


def Struct(*fields: Field) -> DataType:
    if not fields:
        raise ValueError("a struct needs a field")
    return DataType(T.StructType([f.spark for f in fields]))


def Union(*fields: Field) -> DataType:
    """A struct whose fields are the arms, all nullable."""
    if not fields:
        raise ValueError("a union needs a field")
    return DataType(T.StructType([T.StructField(f.name, f.datatype().spark, True) for f in fields]))


def Dictionary(key: DataType, value: DataType) -> DataType:
    """The value's type: how values are stored is the file's business."""
    return DataType(value)


def Decimal(precision: int, scale: int) -> DataType:
    return DataType(T.DecimalType(precision, scale))
