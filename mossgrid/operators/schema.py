"""Record schemas: named fields of a kind, compiled to Spark types and coercions."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mossgrid.functions import money

KINDS = ("text", "number", "url", "list")
#: Fixed value: names of fields that tell whether an item is in stock.
STOCK_FIELD = "stock|availab|voorraad|verf(?:ü|u)gbar|disponib|lager|lieferbar"


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "text"
    hint: str = ""

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"a field's kind is one of {', '.join(KINDS)}, not {self.kind!r}")

    @property
    def is_money(self) -> bool:
        return self.kind == "number" or re.search(money.MONEY_FIELD, self.name, re.IGNORECASE) is not None

    @property
    def is_stock(self) -> bool:
        return re.search(STOCK_FIELD, self.name, re.IGNORECASE) is not None


def spec_id(spec: str) -> str:
    """The name of an unnamed schema, made of its fields."""
    return "custom-" + hashlib.sha256(spec.encode()).hexdigest()[:10]


def spec_id_column(spec: Column) -> Column:
    return F.concat(F.lit("custom-"), F.substring(F.sha2(spec, 256), 1, 10))


@dataclass(frozen=True)
class Schema:
    name: str
    fields: tuple[Field, ...]
    required: tuple[str, ...] = ()
    asked_for: bool = False

    @classmethod
    def of(cls, names, name: str | None = None, required=None) -> "Schema":
        """``["title", "salary:number", "tags:list"]``; the first field is required unless told otherwise."""
        fields = tuple(Field(n.partition(":")[0].strip(), n.partition(":")[2].strip() or "text") for n in map(str, names))
        return cls(name or spec_id("|".join(f"{f.name}:{f.kind}" for f in fields)), fields, tuple(required or [f.name for f in fields[:1]]), True)

    @property
    def expected(self) -> tuple[str, ...]:
        """Fields that a complete recipe knows."""
        return tuple(f.name for f in self.fields) if self.asked_for else self.required

    @property
    def lists(self) -> frozenset[str]:
        return frozenset(f.name for f in self.fields if f.kind == "list")

    def prompt_lines(self) -> str:
        """The fields as a compiler of recipes is asked for them, one a line."""
        many = " (every match)"
        return "\n".join(f'"{f.name}": a CSS selector or null{": " + f.hint if f.hint else ""}{many if f.kind == "list" else ""}' for f in self.fields)

    def struct_type(self) -> T.StructType:
        """The typed row: numbers as decimals with the text beside them, money with its note."""
        out = []
        for f in self.fields:
            kind = T.ArrayType(T.StringType()) if f.kind == "list" else T.DecimalType(38, 9) if f.kind == "number" else T.StringType()
            out.append(T.StructField(f.name, kind))
            out += [T.StructField(f"{f.name}_text", T.StringType())] * (f.kind == "number")
            out += [T.StructField(f"{f.name}_note", T.StringType())] * f.is_money
        return T.StructType(out)

    def coerced(self, read: Column | str) -> list[Column]:
        """The typed columns of a ``map<string,string>`` of values as read (lists joined by U+001F)."""
        read = F.col(read) if isinstance(read, str) else read
        out = []
        for f in self.fields:
            raw = read[f.name]
            if f.kind == "list":
                out.append(F.split(raw, "\x1f").alias(f.name))
                continue
            if f.is_money:
                clean = money.clean_money(raw)
                value = clean["value"]
                note = clean["note"].alias(f"{f.name}_note")
            else:
                value, note = money.strip_label(raw), None
            if f.kind == "number":
                number = money.parse_price(value)
                plain = money.plain_number(value)
                # whether the text says more is decided on the number as written, scale included
                out += [number.alias(f.name), F.when(number.isNotNull() & (money.stripped(value) != plain), value).alias(f"{f.name}_text")]
            else:
                out.append(value.alias(f.name))
            out += [note] if note is not None else []
        return out

    def typed(self, df: DataFrame, read: str = "read") -> DataFrame:
        return df.select(*[c for c in df.columns if c != read], *self.coerced(read))

    def satisfied(self, df: DataFrame) -> Column:
        """Every required field answers, or has a note that answers in its place."""
        from mossgrid.operators.coverage import answered

        kinds, out = dict(df.dtypes), F.lit(True)
        for name in self.required:
            hit = answered(name, kinds[name])
            if f"{name}_note" in kinds:
                hit = hit | answered(f"{name}_note", "string")
            out &= hit
        return out


PRODUCT = Schema("product", (Field("title"), Field("price", "number"), Field("brand"), Field("images", "list"), Field("description"), Field("sku")), ("title", "price"))
