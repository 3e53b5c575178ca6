"""Leaf readers over a parsed feature document (VariantType), P3-P11.

Every reader is a plain column expression: a missing path, a JSON null or a
leaf of the wrong shape gives null instead of failing the job (D4).  The
``strict`` reader raises on a missing path, as a contract check.

A document is a variant column, or ``Leaves``: a table whose typed columns hold
the leaves already (``sources.documents.shred``).  The readers are the same.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: Column | str) -> Column:
    """Text -> variant; malformed JSON -> null."""
    col = F.col(text) if isinstance(text, str) else text
    return F.try_parse_json(col)


def _p(path: str) -> str:
    return path if path.startswith("$") else "$." + path


class Leaves:
    """The columns of a shredded table, one for each leaf path and type."""

    KINDS = {"double": "n", "string": "s", "array<double>": "a", "array<array<double>>": "m"}

    @classmethod
    def name(cls, path: str, kind: str) -> str:
        plain = re.sub(r"[^A-Za-z0-9_]", lambda m: {".": "__", "[": "_at_", "]": ""}.get(m.group(), f"_{ord(m.group()):x}_"), _p(path)[2:])
        return f"{cls.KINDS[kind]}_{plain}"

    def leaf(self, path: str, kind: str) -> Column:
        return F.col(self.name(path, kind))


class Wanted(Leaves):
    """Notes which leaves a projection reads."""

    def __init__(self) -> None:
        self.leaves: dict[str, tuple[str, str]] = {}

    def leaf(self, path: str, kind: str) -> Column:
        self.leaves[self.name(path, kind)] = (_p(path), kind)
        return F.lit(None).cast(kind)


def leaf(doc: Column | Leaves, path: str, kind: str) -> Column:
    """The value at a path as ``double``, ``string``, ``array<double>`` or ``array<array<double>>``, else null."""
    return doc.leaf(path, kind) if isinstance(doc, Leaves) else F.try_variant_get(doc, _p(path), kind)


def scalar(doc: Column, path: str) -> Column:
    """Number at a dotted path."""
    return leaf(doc, path, "double")


def strict_scalar(doc: Column, path: str) -> Column:
    """P3 strict form: a missing or non-numeric leaf raises."""
    v = leaf(doc, path, "double")
    return F.when(v.isNotNull(), v).otherwise(
        F.raise_error(F.lit(f"missing feature leaf {path}")).cast("double"))


def scalar_or_first(doc: Column, path: str) -> Column:
    """Scalar -> itself, list -> first element, object -> null."""
    return F.coalesce(scalar(doc, path), scalar(doc, path + "[0]"))


def peak_value(doc: Column, path: str) -> Column:
    """P5: scalar, list head, or stat object (median preferred over mean)."""
    return F.coalesce(scalar(doc, path), scalar(doc, path + "[0]"),
                      scalar(doc, path + ".median"), scalar(doc, path + ".mean"))


def stat(doc: Column, path: str, name: str) -> Column:
    """One statistic of a stat object."""
    return scalar(doc, f"{path}.{name}")


def array_leaf(doc: Column, path: str) -> Column:
    """Numeric array leaf, flattened like ``ravel``: a 2-D leaf gives its rows one
    after another, a scalar gives a one-element array."""
    scalar_ = leaf(doc, path, "double")
    nested = leaf(doc, path + "[0]", "array<double>").isNotNull()
    return (F.when(scalar_.isNotNull(), F.array(scalar_))
            .when(nested, F.flatten(leaf(doc, path, "array<array<double>>")))
            .otherwise(leaf(doc, path, "array<double>")))


def matrix_leaf(doc: Column, path: str) -> Column:
    return leaf(doc, path, "array<array<double>>")


# Pitch classes in chromatic order from C (key names as written
# in the documents, lower case).
CHROMATIC_SCALE = ["c", "c#", "d", "d#", "e", "f", "f#", "g", "g#", "a", "a#", "b"]


def key_vector(key: Column, scale: Column, strength: Column) -> list[Column]:
    """Tonal key as a point on the circle of fifths, scaled by strength.

    Minor keys move three semitones up to the relative major; the z part is
    +0.5 for major and -0.5 for any other scale.  Unknown key text or a null
    part gives a null vector.
    """
    idx = F.array_position(F.array(*[F.lit(k) for k in CHROMATIC_SCALE]), F.lower(key)) - 1
    known = (idx >= 0) & scale.isNotNull() & strength.isNotNull()
    major_pc = F.when(scale == "minor", F.pmod(idx + 3, F.lit(12))).otherwise(idx)
    # stepping a fifth is 7 semitones, so the circle position is 7*pc mod 12
    theta = F.pmod(major_pc * 7, F.lit(12)).cast("double") * F.lit(2 * math.pi / 12)
    z = F.when(scale == "major", F.lit(0.5)).otherwise(F.lit(-0.5))
    return [F.when(known, strength * F.cos(theta)),
            F.when(known, strength * F.sin(theta)),
            F.when(known, strength * z)]
