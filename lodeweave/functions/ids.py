"""Content-derived identifiers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "lodeweave:chunk")


def digest(content: Column, limit: int | None = None) -> Column:
    """SHA-256 of the first limit bytes (of text: characters); None takes all of it."""
    return F.sha2(F.substring(content, 1, limit) if limit else content, 256)


def block_id(document: Column, page: Column, block: Column, text: Column) -> Column:
    return F.concat(document.cast("string"), F.lit(":p"), page.cast("string"), F.lit(":b"), block.cast("string"), F.lit(":"), F.substring(F.sha2(text, 256), 1, 12))


def uuid5(name: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """Hexadecimal UUIDv5 of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.conv((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 8).cast("string"), 10, 16))
    return F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))


def chunk_id(document: Column, index: Column, text: Column, tenant: Column | None = None) -> Column:
    """From document, index and content; the tenant takes part where it is given, so that tenants never overwrite each other."""
    parts = [document.cast("string"), index.cast("string"), F.sha2(text, 256)]
    return uuid5(F.concat_ws("|", *([tenant] if tenant is not None else []), *parts))
