"""Canonical text of typed values and the SHA-256 identities built from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_MARK = "\\N"
SEPARATOR = "\x1f"


def escaped(c: Column) -> Column:
    """Text without separators; only a NULL becomes a single backslash and N."""
    text = F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\"))
    return F.coalesce(F.replace(text, F.lit(SEPARATOR), F.lit("\\u")), F.lit(NULL_MARK))


def canonical(name: str, kind: T.DataType) -> Column:
    """Text that is equal exactly when the values are, of one type.

    Doubles keep every digit that tells them apart (both zeros are one value), times are UTC, arrays keep
    their order and NULLs.
    """
    c = F.col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        text = F.when(c == 0, F.lit("0.0")).otherwise(c.cast("string"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        items = F.transform(c, lambda x: F.replace(escaped(x), F.lit(","), F.lit("\\c")))
        text = F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        text = F.to_json(c, {"ignoreNullFields": "false"})
    elif isinstance(kind, T.BinaryType):
        text = F.hex(c)
    elif isinstance(kind, T.StringType):
        return escaped(c)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(NULL_MARK))


def row_text(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Values of the (sorted) columns joined by an unprintable separator."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    names = sorted(columns or kinds)
    return F.concat_ws(SEPARATOR, *[canonical(n, kinds[n]) for n in names])


def row_hash(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    return F.sha2(row_text(df, columns), 256)


def content_key(*parts: Column) -> Column:
    """SHA-256 of the parts joined by colons; colons inside a part are escaped, NULL has a text of its own."""
    texts = [F.replace(escaped(p), F.lit(":"), F.lit("\\c")) for p in parts]
    return F.sha2(F.concat_ws(":", *texts), 256)


def is_sha256(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike("^[0-9a-f]{64}$"), F.lit(False))


def name_based_id(namespace_hex: str, name: Column) -> Column:
    """UUID of the name-based SHA-1 kind: version and variant bits over the digest."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex.replace("-", ""))), F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(F.substr(variant, nibble + 1, F.lit(1)), F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )
