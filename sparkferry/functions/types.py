"""Type names of three SQL dialects: canonical names, families, and mapping between dialects.

Every rule exists once, as data: the same tables serve the Python functions (a table's few columns) and the DataFrame
forms (a catalog's many). compat=True gives the documented tool's literal results where its maps miss their own keys.
"""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkferry.functions.tokens import depths, tokens, written

APPLY, IGNORE, TARGET = "apply_source", "ignore_source", "use_target_defined"

# Spellings of one type.
ALIASES = {
    "character varying": "varchar", "double precision": "double", "boolean": "bool", "timestamp with time zone": "timestamptz",
    "timestamp without time zone": "timestamp", "time with time zone": "timetz", "time without time zone": "time", "integer": "int",
    "int4": "int", "int8": "bigint", "serial4": "serial", "serial8": "bigserial", "character": "char", "bit varying": "varbit",
}

# What each type becomes, by pair of dialects. Each entry is source names, target, and what happens to the source's modifier.
RULES = {
    ("mysql", "postgres"): [
        (("bit",), "VARBIT", APPLY), (("tinyint", "smallint"), "SMALLINT", APPLY), (("mediumint", "int", "integer"), "INTEGER", APPLY), (("bigint",), "BIGINT", APPLY), (("float",), "REAL", APPLY),
        (("double",), "DOUBLE PRECISION", APPLY), (("decimal", "numeric"), "NUMERIC", APPLY), (("char",), "CHAR", APPLY), (("varchar",), "VARCHAR", APPLY), (("tinytext", "text", "mediumtext", "longtext"), "TEXT", IGNORE),
        (("binary", "varbinary"), "BYTEA", APPLY), (("tinyblob", "blob", "mediumblob", "longblob"), "BYTEA", IGNORE), (("json",), "JSONB", IGNORE), (("enum",), "VARCHAR(255)", TARGET), (("set",), "TEXT", IGNORE),
        (("date",), "DATE", IGNORE), (("time",), "TIME WITHOUT TIME ZONE", APPLY), (("datetime",), "TIMESTAMP WITHOUT TIME ZONE", APPLY), (("timestamp",), "TIMESTAMP WITH TIME ZONE", APPLY),
        (("year",), "SMALLINT", IGNORE), (("geometry", "linestring", "polygon"), "geometry", IGNORE), (("point",), "point", IGNORE),
    ],
    ("postgres", "mysql"): [
        (("smallint", "int2"), "SMALLINT", APPLY), (("integer", "int4"), "INT", APPLY), (("bigint", "int8"), "BIGINT", APPLY), (("real", "float4"), "FLOAT", APPLY), (("double precision", "float8"), "DOUBLE", APPLY),
        (("numeric", "decimal"), "DECIMAL", APPLY), (("smallserial",), "SMALLINT", IGNORE), (("serial",), "INT", IGNORE), (("bigserial",), "BIGINT", IGNORE), (("varchar",), "VARCHAR", APPLY), (("char", "bpchar"), "CHAR", APPLY),
        (("text",), "LONGTEXT", IGNORE), (("bytea",), "LONGBLOB", IGNORE), (("json", "jsonb"), "JSON", IGNORE), (("uuid",), "CHAR(36)", TARGET), (("date",), "DATE", IGNORE), (("time", "timetz"), "TIME", APPLY),
        (("timestamp",), "DATETIME", APPLY), (("timestamptz",), "TIMESTAMP", APPLY), (("bool",), "TINYINT(1)", TARGET), (("interval",), "VARCHAR(100)", TARGET), (("money",), "DECIMAL(19,2)", TARGET), (("bit",), "BIT", APPLY),
        (("varbit",), "VARBINARY", APPLY), (("inet", "cidr"), "VARCHAR(43)", TARGET), (("macaddr",), "VARCHAR(17)", TARGET), (("macaddr8",), "VARCHAR(23)", TARGET),
        (("text[]", "varchar[]", "integer[]", "bigint[]", "boolean[]", "numeric[]", "date[]", "timestamp[]", "timestamptz[]"), "JSON", IGNORE),
        (("geometry",), "GEOMETRY", IGNORE), (("point",), "POINT", IGNORE), (("linestring",), "LINESTRING", IGNORE), (("polygon",), "POLYGON", IGNORE),
    ],
    ("sqlite", "postgres"): [
        (("integer", "int"), "BIGINT", IGNORE), (("real",), "DOUBLE PRECISION", IGNORE), (("text", "varchar", "char"), "TEXT", IGNORE), (("blob",), "BYTEA", IGNORE), (("numeric", "decimal"), "NUMERIC", IGNORE),
        (("datetime", "timestamp"), "TIMESTAMP WITHOUT TIME ZONE", IGNORE), (("date",), "DATE", IGNORE), (("boolean",), "BOOLEAN", IGNORE),
    ],
    ("sqlite", "mysql"): [
        (("integer", "int"), "BIGINT", IGNORE), (("real",), "DOUBLE", IGNORE), (("text", "varchar", "char"), "LONGTEXT", IGNORE), (("blob",), "LONGBLOB", IGNORE), (("numeric", "decimal"), "DECIMAL(38,18)", TARGET),
        (("datetime", "timestamp"), "DATETIME(6)", TARGET), (("date",), "DATE", IGNORE), (("boolean",), "TINYINT(1)", TARGET),
    ],
}
#: Rules that look at the whole type, before the names.
SPECIAL = {("mysql", "postgres"): [(r"^tinyint\(1\)$", "BOOLEAN", TARGET)]}
# Fixed value: how PostgreSQL turns a column's values into the new type, where a plain cast is not enough.
USING = {("mysql", "postgres", "datetime"): "CAST(REPLACE(CAST({column} AS TEXT), ' ', 'T') AS TIMESTAMP WITHOUT TIME ZONE)"}

_SIGN = re.compile(r"\s(unsigned|zerofill)")
_MODIFIED = re.compile(r"^([a-z][a-z\s]*?)\s*\(\s*\d+(?:\s*,\s*\d+)?\s*\)(.*)$")
_ARGUMENTS = re.compile(r"\(([^)]*)\)")


def normalize(name: str) -> str:
    """The canonical name: lower case, without sign words and one numeric modifier, single spaces, one spelling."""
    name = _SIGN.sub("", re.sub(r"\s+", " ", name.strip().lower())).strip()
    if m := _MODIFIED.match(name):
        name = f"{m[1]} {m[2].strip()}".strip()
    return ALIASES.get(name, name)


def normalized(name: Column) -> Column:
    """normalize() for a column."""
    plain = F.regexp_replace(F.trim(F.lower(F.regexp_replace(name, r"\s+", " "))), r"\s(unsigned|zerofill)", "")
    plain = F.trim(F.regexp_replace(F.trim(plain), r"^([a-z][a-z\s]*?)\s*\(\s*\d+(?:\s*,\s*\d+)?\s*\)\s*(.*)$", "$1 $2"))
    out = plain
    for a, b in ALIASES.items():
        out = F.when(plain == a, F.lit(b)).otherwise(out)
    return out


# What is known of each canonical type: its family, and what a modifier of it says. Where that is None, a modifier is only a
# width for display or a list of values, and nothing of it carries over.
_KNOWN = {
    ("text", "length"): ("char", "varchar", "bpchar", "nchar", "nvarchar"),
    ("text", None): ("text", "tinytext", "mediumtext", "longtext", "clob", "json", "jsonb", "xml", "uuid", "enum", "set"),
    ("bytes", "length"): ("binary", "varbinary", "bit", "varbit"),
    ("bytes", None): ("bytea", "blob", "tinyblob", "mediumblob", "longblob"),
    ("integer", None): ("tinyint", "smallint", "mediumint", "int", "bigint", "int2", "smallserial", "serial", "bigserial"),
    ("decimal", "scale"): ("decimal", "numeric"),
    ("real", "digits"): ("float", "double", "real", "float4", "float8"),
    ("real", None): ("money",),
    ("clock", "precision"): ("time", "timetz", "datetime", "timestamp", "timestamptz"),
    ("calendar", None): ("date", "year"),
    ("boolean", None): ("bool",),
}
FAMILIES = {name: known for known, names in _KNOWN.items() for name in names}
#: Families whose values are numbers.
NUMBERS = ("integer", "decimal", "real")
OTHER = ("other", "unknown")


def family(type_: str) -> str:
    return FAMILIES.get(normalize(type_), OTHER)[0]


def says(type_: str) -> str | None:
    """What a modifier of the type says: length, scale, digits, precision, nothing (None), or unknown."""
    return FAMILIES.get(normalize(type_), OTHER)[1]


def is_flag(type_: str) -> bool:
    """A boolean, or MySQL's stand-in for one."""
    return family(type_) == "boolean" or re.sub(r"\s", "", type_.lower()) == "tinyint(1)"


#: Words that begin what a catalog appends to the type of a generated or identity column.
_CLAUSES = ("generated", "as", "identity", "virtual", "stored", "persistent")


def base_of_generated(full: str) -> str:
    """The type before a GENERATED, IDENTITY, AS, VIRTUAL, STORED or PERSISTENT clause; without a clause or a type, the trimmed text."""
    found = tokens(full.strip())
    at = next((i for i, (t, depth) in enumerate(zip(found, depths(found), strict=True)) if t.low in _CLAUSES and not depth), 0)
    return written(found[:at]) if at else full.strip()


def _split(mapped: str) -> tuple[str, str]:
    """(base, modifier) of a mapped type."""
    m = re.match(r"^(.+?)\s*\((.+)\)$", mapped)
    return (m[1].strip(), m[2].strip()) if m else (mapped.strip(), "")


def _numbers(modifier: str) -> list[int] | None:
    return [int(x) for x in modifier.split(",")] if re.fullmatch(r"\s*\d+(\s*,\s*\d+)?\s*", modifier) else None


def _fits(target: str, numbers: list[int], dialect: str) -> bool:
    """Whether a modifier is right for a target type."""
    match says(target):
        case "length":
            return len(numbers) == 1
        case "scale":
            return numbers[0] > 0 and (len(numbers) == 1 or numbers[1] <= numbers[0])
        case "precision":
            return len(numbers) == 1 and dialect != "sqlite" and (dialect != "mysql" or numbers[0] <= 6 and normalize(target) in ("datetime", "timestamp", "time"))
    return False


def with_modifier(source: str, mapped: str, dialect: str, strategy: str, compat: bool = False) -> str:
    """The mapped type with the source's modifier, as the strategy wants it.

    Where the modifier doesn't carry over the mapped type stays; where it doesn't fit the target, the target's bare name does.
    A zone phrase keeps its place behind the modifier (compat: the modifier comes last).
    """
    if strategy in (TARGET, IGNORE):
        return mapped
    if strategy != APPLY:
        raise ValueError(f"unknown strategy {strategy!r}")
    base, own = _split(mapped)
    found = _ARGUMENTS.search(source)
    modifier, kind = (found[1].strip() if found else ""), normalize(source.split("(")[0])
    numbers = _numbers(modifier)
    if not modifier or numbers is None and (own or kind in ("enum", "set") or not re.fullmatch(r"-?\d+", modifier)) or says(kind) is None:
        return mapped
    if numbers is None or not _fits(base, numbers, dialect):
        return base
    if not compat and (zone := re.match(r"(?i)^(time|timestamp)(\s+with(?:out)? time zone)$", base)):
        return f"{zone[1]}({modifier}){zone[2]}"
    return f"{base}({modifier})"


@dataclass(frozen=True)
class Mapped:
    type: str
    rule: str | None
    using: str | None = None


#: An unsigned integer needs the next wider type.
WIDER = {"smallint": {"postgres": "INTEGER"}, "int": {"postgres": "BIGINT"}, "bigint": {"postgres": "NUMERIC(20,0)"}}


@dataclass(frozen=True)
class TypeMap:
    """Which type each type becomes, by pair of dialects: rules as in RULES, patterns as in SPECIAL, and casts as in USING."""

    rules: Mapping[tuple[str, str], list] = field(default_factory=lambda: RULES)
    patterns: Mapping[tuple[str, str], list] = field(default_factory=lambda: SPECIAL)
    using: Mapping[tuple[str, str, str], str] = field(default_factory=lambda: USING)

    def table(self, pair: tuple[str, str], compat: bool = False) -> dict[str, tuple[str, str]]:
        """Canonical name to (target, strategy); compat: names as they are listed."""
        out = {}
        for names, target, strategy in self.rules.get(pair, []):
            for n in names:
                item = n.removesuffix("[]")
                out[n if compat else normalize(item) + "[]" * (item != n)] = (target, strategy)
        return out

    @classmethod
    def load(cls, path: str) -> TypeMap:
        """A JSON list of {source, target, types: {name: {type, modifier, using}}, patterns: [{pattern, type, modifier}]}, which goes
        before the built-in map: a name or pattern that the file lacks keeps its built-in rule.

        Without a modifier strategy it is `apply_source`; an unknown one is logged and counts as that. A pair of dialects
        that doesn't exist, an entry without a type, or a pattern that is no regular expression raises ValueError.
        """
        with open(path, encoding="utf-8") as f:
            entries = json.load(f)
        rules, patterns, using = {k: list(v) for k, v in RULES.items()}, {k: list(v) for k, v in SPECIAL.items()}, dict(USING)

        def checked(what: str, entry) -> tuple[str, str]:
            if not isinstance(entry, dict) or not str(entry.get("type") or "").strip():
                raise ValueError(f"{path}: {what} has no type")
            strategy = entry.get("modifier") or APPLY
            if strategy not in (APPLY, IGNORE, TARGET):
                logging.getLogger("sparkferry.types").warning("%s: unknown modifier strategy %r of %s counts as %s", path, strategy, what, APPLY)
                strategy = APPLY
            return entry["type"], strategy

        for entry in entries:
            pair = (str(entry.get("source", "")).lower(), str(entry.get("target", "")).lower())
            if not set(pair) <= {"mysql", "postgres", "sqlite"}:
                raise ValueError(f"{path}: no such pair of dialects: {pair}")
            own = {name: checked(name, e) for name, e in entry.get("types", {}).items()}
            rules.setdefault(pair, []).extend(((name,), *rule) for name, rule in own.items())  # later rules win
            using |= {(*pair, normalize(name)): e["using"] for name, e in entry.get("types", {}).items() if e.get("using")}
            for e in entry.get("patterns", []):
                try:
                    re.compile(e.get("pattern") or "(")
                except re.error as error:
                    raise ValueError(f"{path}: {e.get('pattern')!r} is no pattern: {error}") from None
                patterns.setdefault(pair, []).insert(0, (e["pattern"], *checked(e["pattern"], e)))
        return cls(rules, patterns, using)


BUILT_IN = TypeMap()


def fallback(dialect: str) -> str:
    return "LONGTEXT" if dialect == "mysql" else "TEXT"


def map_type(source: str, src: str, dst: str, length: int | None = None, precision: int | None = None, scale: int | None = None, compat: bool = False, types: TypeMap = BUILT_IN) -> Mapped:
    """A source type in the destination's dialect. length, precision and scale stand in for a modifier that the type's name lacks."""
    src, dst = src.lower(), dst.lower()
    full = source.strip().lower()
    for pattern, target, strategy in types.patterns.get((src, dst), []):
        if re.search(pattern, full):
            return Mapped(with_modifier(source, target, dst, strategy, compat), pattern)
    key = normalize(source)
    if not compat and (listed := re.match(r"(enum|set)\s*\(", key)):
        key = listed[1]
    if not compat and key.endswith("[]"):
        key = normalize(key[:-2]) + "[]"
    rule = types.table((src, dst), compat).get(key)
    if rule is None:
        return Mapped(source if src == dst else fallback(dst), None)
    if not compat and "(" not in source:
        if family(key) == "text" and length is not None:
            source = f"{source}({length})"
        elif family(key) == "decimal" and precision is not None:
            source = f"{source}({precision},{scale or 0})"
    if not compat and re.search(r"\sunsigned", full) and (wide := WIDER.get(key, {}).get(dst)):
        return Mapped(wide, key)
    return Mapped(with_modifier(source, rule[0], dst, rule[1], compat), key, types.using.get((src, dst, key)))


def rules_frame(spark: SparkSession, types: TypeMap = BUILT_IN) -> DataFrame:
    """All rules as (src, dst, key, target, strategy): about a hundred rows, whatever the data."""
    rows = [F.struct(*[F.lit(x).alias(c) for c, x in zip(("src", "dst", "key", "target", "strategy"), (*pair, key, *rule), strict=True)]) for pair in types.rules for key, rule in types.table(pair).items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def map_columns(columns: DataFrame, spark: SparkSession, src: str, dst: str, types: TypeMap = BUILT_IN) -> DataFrame:
    """columns (with `type`) with key, target and strategy; the rules' side is small by construction, so Spark broadcasts it."""
    rules = rules_frame(spark, types).where((F.col("src") == src) & (F.col("dst") == dst)).select("key", "target", "strategy")
    key = normalized(F.col("type"))
    key = F.when(key.rlike(r"^(enum|set)\s*\("), F.regexp_extract(key, r"^(enum|set)", 1)).otherwise(key)
    out = columns.withColumn("key", key).join(rules, "key", "left")
    for pattern, target, strategy in types.patterns.get((src, dst), []):
        special = F.lower(F.trim("type")).rlike(pattern)
        out = out.withColumn("target", F.when(special, F.lit(target)).otherwise(F.col("target"))).withColumn("strategy", F.when(special, F.lit(strategy)).otherwise(F.col("strategy")))
    return out.withColumn("target", F.coalesce("target", F.col("type") if src == dst else F.lit(fallback(dst))))


_NUMBER = {"tinyint": "byte", "smallint": "short", "mediumint": "int", "int": "int", "bigint": "long", "smallserial": "short", "serial": "int", "bigserial": "long", "year": "short", "float": "float", "real": "float", "double": "double", "float4": "float", "float8": "double", "int2": "short"}
_OTHER = {"bool": "boolean", "boolean": "boolean", "date": "date", "datetime": "timestamp_ntz", "timestamptz": "timestamp", "binary": "binary", "varbinary": "binary", "bytea": "binary", "geometry": "binary", "point": "binary", "linestring": "binary", "polygon": "binary"}


def spark_type(source: str, dialect: str) -> str:
    """The Spark type that holds a dialect's type."""
    full, key = source.strip().lower(), normalize(source)
    if dialect == "mysql" and full == "tinyint(1)":
        return "boolean"
    if key.endswith("[]"):
        return f"array<{spark_type(key[:-2], dialect)}>"
    if dialect == "sqlite" and "int" in key:  # SQLite's own rule of affinity
        return "long"
    if dialect == "sqlite" and key in ("real", "float", "double"):
        return "double"
    if key in _NUMBER:
        wider = {"byte": "short", "short": "int", "int": "long", "long": "decimal(20,0)"}
        return wider[_NUMBER[key]] if "unsigned" in full and _NUMBER[key] in wider else _NUMBER[key]
    if family(key) == "decimal" or key == "money":
        numbers = _numbers(m[1]) if (m := _ARGUMENTS.search(full)) else None
        p, s = (*numbers, 0)[:2] if numbers else (19, 2) if key == "money" else (38, 18)
        return f"decimal({min(p, 38)},{min(s, 38)})"
    if key == "timestamp":
        return "timestamp" if dialect == "mysql" else "timestamp_ntz"
    return "binary" if key.endswith("blob") else _OTHER.get(key, "string")
