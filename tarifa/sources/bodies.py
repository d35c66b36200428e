"""JSON bodies with a schema: typed fields and error rows in one pass (SRC-10, VAL-01)."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LARGEST = 99_999_999
# Fixed values of the plans that can be bought, and the default of the billing period
PLANS, BILLING = ("STARTER", "PRO", "ENTERPRISE"), ("monthly", "yearly")
_UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


class Field(NamedTuple):
    """A field of a body: its JSON type, whether it may be missing or null, a check of its value with the problem's name, and a default."""

    name: str
    kind: str
    optional: bool = False
    nullable: bool = False
    check: Callable[[Column], Column] | None = None
    problem: str = ""
    default: str | None = None


def is_url(x: Column) -> Column:
    """A scheme and something after it; web addresses need a host."""
    return x.rlike(r"(?i)^[a-z][a-z0-9+.-]*:\S+$") & (~x.rlike("(?i)^https?:") | x.rlike(r"(?i)^https?://[^\s/?#]+"))


SCHEMAS: dict[str, tuple[Field, ...]] = {
    "add": (Field("productUrl", "string", check=is_url, problem="url"),),
    "update": (
        Field("cost", "double", True, True, lambda x: x.between(0, LARGEST), "range"), Field("ownPrice", "double", True, False, lambda x: (x > 0) & (x <= LARGEST), "range"),
    ),
    "compare": (Field("productId", "string", check=lambda x: x.rlike(_UUID), problem="uuid"),),
    "checkout": (Field("planId", "string", check=lambda x: x.isin(*PLANS), problem="plan"), Field("billing", "string", True, check=lambda x: x.isin(*BILLING), problem="billing", default="monthly")),
    "settings": (
        Field("telegramChatId", "string", True), Field("webhookUrl", "string", True, check=lambda x: (x == "") | is_url(x), problem="url"), Field("emailNotifications", "boolean", True),
        Field("telegramNotifications", "boolean", True), Field("webhookNotifications", "boolean", True),
    ),
}
#: Bodies that need one of their fields at least.
NEEDS_ONE = {"update": "nothing to update"}
_TYPES = {"string": ("STRING",), "boolean": ("BOOLEAN",), "double": ("BIGINT", "DOUBLE", "DECIMAL")}


def read(bodies: DataFrame, kind: str) -> DataFrame:
    """(key, ok, problems, corrupt, and the kind's fields) of bodies (key, body) of one kind.

    `corrupt` is the body where it is no JSON object. A problem is `field: what`, in the order of fields; a field with a
    problem is null. Fields that the schema doesn't name are dropped; of repeated names the last counts. Every body gives
    one row, refused ones too.
    """
    fields = SCHEMAS[kind]
    # the permissive reader keeps what it can't read; presence and types of single fields come from the variant
    parsed = bodies.select("key", "body", F.try_parse_json("body").alias("v"), F.json_object_keys("body").alias("names"))
    broken = F.col("names").isNull() | F.col("v").isNull()
    out, problems = [], []
    for f in fields:
        v = F.try_variant_get("v", f"$.{f.name}", "variant")
        there = F.coalesce(F.array_contains("names", f.name), F.lit(False))
        is_null, type_ = F.is_variant_null(v), F.schema_of_variant(v)
        fits = ~is_null & type_.rlike("^(?:" + "|".join(_TYPES[f.kind]) + ")")
        value = F.when(fits, v.cast("string").try_cast(f.kind))
        good = f.check(value) if f.check else F.lit(True)
        problem = F.when(broken, None).when(~there, None if f.optional else "required").when(is_null, None if f.nullable else "type").when(~fits, "type").when(~F.coalesce(good, F.lit(False)), f.problem)
        problems.append(F.concat(F.lit(f"{f.name}: "), problem))
        kept = F.when(problem.isNull(), value)
        out.append((F.when(broken | there, kept).otherwise(f.default) if f.default else kept).alias(f.name))
    if kind in NEEDS_ONE:
        none = ~F.arrays_overlap("names", F.array(*[F.lit(f.name) for f in fields]))
        problems.append(F.when(~broken & none, NEEDS_ONE[kind]))
    problems = F.when(broken, F.array(F.lit("not an object"))).otherwise(F.array_compact(F.array(*problems)))
    return parsed.select("key", (F.size(problems) == 0).alias("ok"), problems.alias("problems"), F.when(broken, F.col("body")).alias("corrupt"), *out)
