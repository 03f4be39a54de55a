"""Label tables and packed-label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The public label scheme's class names, raw ids of the classes, and raw id -> class.
NAMES = (
    "unknown", "car", "bicycle", "motorcycle", "truck", "other-vehicle", "person", "bicyclist", "motorcyclist", "road",
    "parking", "sidewalk", "other-ground", "building", "fence", "vegetation", "trunk", "terrain", "pole", "traffic-sign",
)
RAW_OF_CLASS = (0, 10, 11, 15, 18, 20, 30, 31, 32, 40, 44, 48, 49, 50, 51, 70, 71, 72, 80, 81)
CLASS_OF_RAW = {
    0: 0, 1: 0, 10: 1, 11: 2, 13: 5, 15: 3, 16: 5, 18: 4, 20: 5, 30: 6, 31: 7, 32: 8, 40: 9, 44: 10, 48: 11, 49: 12,
    50: 13, 51: 14, 52: 0, 60: 9, 70: 15, 71: 16, 72: 17, 80: 18, 81: 19, 99: 0, 252: 1, 253: 7, 254: 6, 255: 8,
    256: 5, 257: 5, 258: 4, 259: 5,
}
THINGS = tuple(range(1, 9))
OBJECTS = (*THINGS, 18, 19)
GROUND_CLASSES = (9, 10, 11, 12, 17)
UNKNOWN, GROUND, NONGROUND = 0, 1, 2
STATIONARY, MOVING = 1, 2


def class_of_raw(raw: Column) -> Column:
    """Learning class of a raw id; null if the id is not in the scheme."""
    table = F.create_map(*[F.lit(x) for kv in CLASS_OF_RAW.items() for x in kv])
    return F.try_element_at(table, raw.cast("int"))


def raw_of_class(cls: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, RAW_OF_CLASS)), cls.cast("int") + 1)


def decode(packed: Column) -> dict[str, Column]:
    """semantic, motion, instance of a packed 32-bit label (semantic null: unsupported id)."""
    raw = packed.cast("long").bitwiseAND(F.lit(0xFFFF))
    semantic = class_of_raw(raw)
    motion = F.when(raw.between(252, 259), MOVING).when(semantic == 0, UNKNOWN).otherwise(STATIONARY)
    return {"semantic": semantic, "motion": motion, "instance": F.shiftright(packed.cast("long"), 16).cast("int")}
