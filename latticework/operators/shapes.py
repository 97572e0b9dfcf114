"""What decorators and class marks imply: kinds of functions, members that a dataclass gets without writing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Decorator -> kind of function.
KINDS = (("staticmethod", "StaticMethod"), ("classmethod", "ClassMethod"), ("property", "Property"), ("cached_property", "Property"))
GENERATED = ("__eq__", "__init__", "__repr__")


def function_kind(decorators: Column, in_class: Column) -> Column:
    """Kind by the last part of the first decorator that tells, else Method or Free."""
    names = F.transform(decorators, lambda d: F.regexp_extract(d, r"^(?:.*\.)?(\w+)(?:\(.*\))?$", 1))
    out = F.when(~in_class, "Free").when(F.exists(decorators, lambda d: F.endswith(d, F.lit(".setter"))), "Setter")
    for mark, kind in KINDS:
        out = out.when(F.array_contains(names, mark), kind)
    return out.otherwise("Method")


def generated_methods(units: DataFrame) -> DataFrame:
    """(class_id, id, name) of the methods that dataclasses get and don't define themselves."""
    made = units.where("kind = 'class' and is_dataclass").select(F.col("id").alias("class_id"), F.explode(F.array(*[F.lit(g) for g in GENERATED])).alias("name"))
    own = units.where("kind = 'function' and parent_class is not null").select(F.col("parent_class").alias("class_id"), "name")
    return made.join(own, ["class_id", "name"], "left_anti").select("class_id", F.concat_ws(".", "class_id", "name").alias("id"), "name")
