"""Tables as catalogs describe them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from sparkferry.functions.types import spark_type


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = True
    primary: bool = False
    default: str | None = None
    auto_increment: bool = False
    generated: str | None = None
    ordinal: int = 0
    length: int | None = None
    precision: int | None = None
    scale: int | None = None
    collation: str | None = None
    comment: str | None = None
    #: The type in the destination's dialect, once it is mapped.
    mapped: str = ""


@dataclass(frozen=True)
class Index:
    name: str
    columns: tuple[str, ...]
    unique: bool = False
    primary: bool = False
    definition: str = ""


@dataclass(frozen=True)
class Constraint:
    name: str
    kind: str  # PRIMARY KEY, UNIQUE, FOREIGN KEY or CHECK
    columns: tuple[str, ...] = ()
    definition: str = ""
    to_table: str = ""
    to_columns: tuple[str, ...] = ()
    on_delete: str = ""
    on_update: str = ""


@dataclass(frozen=True)
class Table:
    name: str
    dialect: str
    columns: tuple[Column, ...] = ()
    indexes: tuple[Index, ...] = ()
    constraints: tuple[Constraint, ...] = ()

    @property
    def key(self) -> list[str]:
        """Primary key columns in their declared order."""
        declared = next((c.columns for c in self.constraints if c.kind == "PRIMARY KEY"), ())
        return list(declared) or [c.name for c in sorted(self.columns, key=lambda c: c.ordinal) if c.primary]

    @property
    def foreign_keys(self) -> list[Constraint]:
        return [c for c in self.constraints if c.kind == "FOREIGN KEY"]

    def schema(self) -> T.StructType:
        """Spark's schema of the table; what Spark has no place for is metadata."""
        kept = ("type", "default", "generated", "auto_increment", "collation", "comment", "length")
        fields = []
        for c in self.columns:
            meta = {k: v for k in kept if (v := getattr(c, k)) not in (None, "", False)}
            fields.append(T.StructField(c.name, T._parse_datatype_string(spark_type(c.type, self.dialect)), c.nullable, meta))
        return T.StructType(fields)


@dataclass
class Result:
    """What became of one table."""

    table: str
    schema_error: str | None = None
    data_error: str | None = None
    constraint_error: str | None = None
    other_error: str | None = None
    skipped: str | None = None
    rows: int = 0
    batches: int = 0
    #: Rows with a value that the destination's type can't hold.
    unfit: int = 0
    seconds: float = 0.0
    statements: list[str] = field(default_factory=list)

    @property
    def status(self) -> str:
        """Errors outrank having been skipped."""
        if self.schema_error or self.data_error or self.other_error:
            return "failed"
        if self.constraint_error:
            return "constraint_failed"
        return "skipped" if self.skipped else "ok"


def exit_code(results: list[Result]) -> int:
    """0 all well or nothing to do, 1 a schema or data failure, 2 only constraints failed, 3 all skipped."""
    found = [r.status for r in results]
    if "failed" in found:
        return 1
    if "constraint_failed" in found:
        return 2
    return 3 if found and set(found) == {"skipped"} else 0
