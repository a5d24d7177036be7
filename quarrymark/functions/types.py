"""Type classes of columns, which pairs of them are comparable, and predicates on names."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F, types as T

#: Declared types of each class (lower case); a name starting with "timestamp" is a TIMESTAMP, any other unknown is STRING_LONG.
DECLARED = {
    "INT_NARROW": ("integer", "smallint", "int", "int2", "int4"),
    "INT_WIDE": ("bigint", "int8"),
    "UUID": ("uuid",),
    "DATE": ("date",),
    "BOOL": ("boolean", "bool"),
    "FLOAT": ("numeric", "decimal", "double precision", "float8", "real", "float4", "money"),
    "BINARY": ("bytea",),
    "JSONB": ("jsonb", "json"),
}
TEXT_TYPES = ("character varying", "varchar", "character", "char", "text", "bpchar")
SHORT_LENGTH = 64
ELIGIBLE = ("INT_NARROW", "INT_WIDE", "UUID", "STRING_SHORT", "DATE", "TIMESTAMP")
#: Classes whose columns may refer to each other share a group; classes without group are never compared.
COMPATIBLE = {"INT_NARROW": "INT", "INT_WIDE": "INT", "STRING_SHORT": "STRING", "STRING_LONG": "STRING", "UUID": "UUID", "DATE": "DATE", "TIMESTAMP": "TIMESTAMP"}
#: Reasons for which a table is left out, in order, with their patterns.
EXCLUSIONS = (
    ("log_pattern", r"_log(_.*)?$"), ("temp_pattern", r"^temp_"), ("tmp_pattern", r"^tmp_"), ("backup_pattern", r"_bak(_.*|\d*)?$"),
    ("archive_pattern", r"_archive(_.*)?$"), ("events_pattern", r"_events(_.*)?$"), ("etl_pattern", r"^etl_"), ("migrations_pattern", r"^migrations(_.*|$)"),
)
#: Patterns of column names.
POINTER_NAME = r"(?i)^(id|uuid|guid|oid|pk|fk|sid|gid)$|_(id|uuid|guid|oid|pk|fk|sid|gid|ref)$"
KEY_NAME = r"(?i)^(id|uuid|guid|oid|pk|fk|sid|gid|hash|key)$|_(id|uuid|guid|oid|pk|fk|sid|gid|ref|hash|key)$"
CREDENTIAL_NAME = (
    r"(?i)^(password|passwd|pwd|user_?pass|hashed_password|password_hash|password_digest|passwd_hash|pwd_hash|password_salt|passwd_salt|pwd_salt|salt|"
    r"password_iterations|pbkdf2_iterations|kdf_iterations|secret_hash|credentials?_hash|auth_hash)$|_(password|passwd|password_hash|password_digest|pwd_hash|password_salt|password_iterations)$"
)
FREE_TEXT_NAME = (
    r"(?i)^(description|desc|comments?|notes?|body|text|content|message|summary|subject|label|title|name|file_?name|category|status|created_by|modified_by|updated_by|deleted_by|owner|"
    r"reason|remark|remarks|memo)$|_(description|desc|comments?|notes?|body|text|content|message|summary|subject|label|title|name|category|reason|remark|remarks|memo)$"
)
TEMPORAL_NAME = r"(?i)^(modified_date|modified_at|updated_at|updated_date|last_modified|last_updated|last_changed|date_modified)$"


def type_class(data_type: Column, max_length: Column) -> Column:
    """The class of a declared type."""
    kind = F.lower(F.trim(data_type))
    out = F.when(kind.startswith("timestamp"), "TIMESTAMP")
    for name, declared in DECLARED.items():
        out = out.when(kind.isin(*declared), name)
    return out.when(kind.isin(*TEXT_TYPES) & (max_length <= SHORT_LENGTH), "STRING_SHORT").otherwise("STRING_LONG")


def is_eligible(tclass: Column, column_name: Column, is_pk: Column, is_unique: Column) -> Column:
    """Whether a column may be part of a foreign key: by its class; or promoted as a key (any class), or as ``id``/``*_id`` of STRING_LONG."""
    promoted = F.coalesce(is_pk, F.lit(False)) | F.coalesce(is_unique, F.lit(False))
    named = (tclass == "STRING_LONG") & (F.lower(column_name).isin("id") | F.lower(column_name).endswith("_id"))
    return tclass.isin(*ELIGIBLE) | promoted | named


def compat_group(tclass: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, group in COMPATIBLE.items():
        out = F.when(tclass == name, group).otherwise(out)
    return out


def spark_class(kind: T.DataType, longest: int | None = None) -> str:
    """The class of a Spark column; strings by their longest value where that is known."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return "INT_NARROW"
    if isinstance(kind, T.LongType):
        return "INT_WIDE"
    if isinstance(kind, T.DateType):
        return "DATE"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "TIMESTAMP"
    if isinstance(kind, T.BooleanType):
        return "BOOL"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "FLOAT"
    if isinstance(kind, T.BinaryType):
        return "BINARY"
    if isinstance(kind, T.VariantType):
        return "JSONB"
    return "STRING_SHORT" if isinstance(kind, T.StringType) and longest is not None and longest <= SHORT_LENGTH else "STRING_LONG"


def family(kind: T.DataType) -> str:
    """Physical family: columns of different families are never compared, whatever a cast would allow."""
    if isinstance(kind, T.IntegralType):
        return "INTEGER"
    if isinstance(kind, (T.FractionalType,)):
        return "FLOAT"
    for kinds, name in (((T.DateType,), "DATE"), ((T.TimestampType, T.TimestampNTZType), "TIMESTAMP"), ((T.BooleanType,), "BOOLEAN"), ((T.StringType, T.BinaryType), "STRING")):
        if isinstance(kind, kinds):
            return name
    return "OTHER"


def physical_name(kind: T.DataType) -> str:
    """Name under which a Parquet column is recorded."""
    if isinstance(kind, T.LongType):
        return "BIGINT"
    if isinstance(kind, T.IntegralType):
        return "INTEGER"
    if isinstance(kind, (T.DoubleType, T.DecimalType)):
        return "DOUBLE"
    for kinds, name in ((T.FloatType, "REAL"), (T.DateType, "DATE"), ((T.TimestampType, T.TimestampNTZType), "TIMESTAMP"), (T.BinaryType, "BLOB"), (T.BooleanType, "BOOLEAN")):
        if isinstance(kind, kinds):
            return name
    return "VARCHAR"


def exclusion_reason(table_name: Column) -> Column:
    """Reason for which a table is left out, by the first pattern that its name matches; null if none does."""
    out = F.lit(None).cast("string")
    for reason, pattern in reversed(EXCLUSIONS):
        out = F.when(table_name.rlike("(?i)" + pattern), reason).otherwise(out)
    return out


def excluded(table_name: str) -> str | None:
    return next((reason for reason, p in EXCLUSIONS if re.search(p, table_name, re.I)), None)
