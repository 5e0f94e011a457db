"""Small building blocks for column expressions."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

LOOKUP_BUCKETS_PER_ENTRY = 2


def constant(value, ddl: str) -> Column:
    """A nested constant (lists, dicts) that the optimizer folds into one literal."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lookup(key: Column, table: Mapping[str, str]) -> Column:
    """``table[key]``, or ``key`` itself where it is missing.

    A map literal is searched entry by entry, so the table is cut into many short lists of
    forms and of targets, and the right ones are picked by checksum.
    """
    if not table:
        return key
    size = LOOKUP_BUCKETS_PER_ENTRY * len(table)
    forms: list[list[str]] = [[] for _ in range(size)]
    targets: list[list[str]] = [[] for _ in range(size)]
    for form, target in table.items():
        slot = zlib.crc32(form.encode()) % size
        forms[slot].append(form)
        targets[slot].append(target)

    def bucket(lists: list[list[str]]) -> Column:
        number = F.pmod(F.crc32(key.cast("binary")), F.lit(size)).cast("int")
        return F.get(constant(lists, "array<array<string>>"), number)

    place = F.array_position(bucket(forms), key).cast("int") - 1
    # Most keys are no forms, which a set tells at once.
    return F.when(key.isin(list(table)), F.coalesce(F.get(bucket(targets), place), key)).otherwise(key)
