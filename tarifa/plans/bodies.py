"""Queries of JSON bodies, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import bodies as b
from ..sources import tables as t
from .queries import query

#: Bodies of price updates; %d is a number of the row.
_UPDATES = [
    '{"cost": %d.5}', '{"ownPrice": %d}', '{"cost": null, "ownPrice": 1%d.25, "other": {"a": [1]}}', '{"cost": -%d}', '{"ownPrice": 0}', '{"ownPrice": null}', '{"cost": "%d"}', '{}', '{"note": %d}',
    '{"cost": 100000000, "ownPrice": 99999999}', '[%d]', '{"cost": %d', '', '"%d"', 'null', '{"cost": 0, "ownPrice": true}', '{"cost": {"x": %d}}',
]
_CHECKOUTS = ['{"planId": "PRO"}', '{"planId": "STARTER", "billing": "yearly"}', '{"planId": "FREE", "billing": "weekly"}', '{"billing": "monthly"}', '{"planId": 3, "billing": null}', 'x%d', '{"planId": "ENTERPRISE", "billing": 7}']
_SETTINGS = ['{"webhookUrl": "https://h%d.example.com/x", "emailNotifications": true}', '{"webhookUrl": "", "telegramChatId": "%d"}', '{"webhookUrl": "https:///x", "telegramNotifications": "yes"}', '{"telegramChatId": %d, "webhookNotifications": false}', '{"webhookUrl": "not a url"}', '{}', '[]', '{"webhookUrl": "mailto:a%d"}']
_list = lambda x: ", ".join(f"'{v}'" for v in x)


def _bodies(spark, d, templates):
    k = F.col("o_orderkey")
    body = F.replace(F.element_at(F.array(*[F.lit(x) for x in templates]), (1 + k % len(templates)).cast("int")), F.lit("%d"), (1 + k % 9).cast("string"))
    return t.read(spark, d, "orders").select(k.alias("key"), body.alias("body"))


def _sql(templates, fields: dict[str, str], none: str = "NULL") -> str:
    """Each field as {'p': problem or null, 'v': value or null}, over the JSON document j; an object's fields only."""
    cols = ", ".join(f"{sql} AS {name}" for name, sql in fields.items())
    problems = ", ".join(f"'{n}: ' || {n}.p" for n in fields)
    values = ", ".join(f'{n}.v AS "{n}"' for n in fields)
    return f"""WITH g AS (SELECT o_orderkey AS key, replace([{_list(templates)}][1 + o_orderkey % {len(templates)}], '%d', (1 + o_orderkey % 9)::VARCHAR) AS body FROM orders), j AS (SELECT key, body, CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT' THEN body::JSON END AS j FROM g), f AS (SELECT *, {cols} FROM j),
    r AS (SELECT *, CASE WHEN j IS NULL THEN ['not an object'] ELSE list_filter([{problems}, {none}], lambda x: x IS NOT NULL) END AS problems FROM f)
    SELECT key, len(problems) = 0 AS ok, array_to_string(problems, '; ') AS problems, CASE WHEN j IS NULL THEN body END AS corrupt, {values} FROM r"""


def _number(name: str, good: str, null: str) -> str:
    v = f"TRY_CAST(json_extract_string(j, '$.{name}') AS DOUBLE)"
    return f"CASE json_type(j, '$.{name}') WHEN 'NULL' THEN {{'p': {null}, 'v': NULL::DOUBLE}} ELSE CASE WHEN json_type(j, '$.{name}') IS NULL THEN {{'p': NULL, 'v': NULL::DOUBLE}} WHEN json_type(j, '$.{name}') NOT IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN {{'p': 'type', 'v': NULL::DOUBLE}} WHEN {v} {good} THEN {{'p': NULL, 'v': {v}}} ELSE {{'p': 'range', 'v': NULL::DOUBLE}} END END"


def _text(name: str, good: str, problem: str, missing: str = "NULL", default: str = "NULL") -> str:
    v = f"json_extract_string(j, '$.{name}')"
    return f"CASE WHEN j IS NULL THEN {{'p': NULL, 'v': NULL::VARCHAR}} WHEN json_type(j, '$.{name}') IS NULL THEN {{'p': {missing}, 'v': {default}::VARCHAR}} WHEN json_type(j, '$.{name}') <> 'VARCHAR' THEN {{'p': 'type', 'v': NULL::VARCHAR}} WHEN {good.format(v)} THEN {{'p': NULL, 'v': {v}}} ELSE {{'p': '{problem}', 'v': NULL::VARCHAR}} END"


def _flag(name: str) -> str:
    return f"CASE WHEN json_type(j, '$.{name}') IS NULL THEN {{'p': NULL, 'v': NULL::BOOLEAN}} WHEN json_type(j, '$.{name}') <> 'BOOLEAN' THEN {{'p': 'type', 'v': NULL::BOOLEAN}} ELSE {{'p': NULL, 'v': json_extract_string(j, '$.{name}') = 'true'}} END"


_URL = "(regexp_matches({0}, '(?i)^[a-z][a-z0-9+.-]*:[^ ]+$') AND (NOT regexp_matches({0}, '(?i)^https?:') OR regexp_matches({0}, '(?i)^https?://[^ /?#]+')))"


def _joined(df):
    return df.withColumn("problems", F.array_join("problems", "; "))


@query(_sql(_UPDATES, {"cost": _number("cost", "BETWEEN 0 AND 99999999", "NULL"), "ownPrice": _number("ownPrice", "BETWEEN 1e-300 AND 99999999", "'type'")}, "CASE WHEN json_type(j, '$.cost') IS NULL AND json_type(j, '$.ownPrice') IS NULL THEN 'nothing to update' END"))
def body_updates(spark, d):
    """SRC-10, VAL-01: bodies of price updates, valid and refused."""
    return _joined(b.read(_bodies(spark, d, _UPDATES), "update"))


@query(_sql(_CHECKOUTS, {"planId": _text("planId", "{0} IN ('STARTER', 'PRO', 'ENTERPRISE')", "plan", "'required'"), "billing": _text("billing", "{0} IN ('monthly', 'yearly')", "billing", "NULL", "'monthly'")}))
def body_checkouts(spark, d):
    """SRC-10: bodies of purchases."""
    return _joined(b.read(_bodies(spark, d, _CHECKOUTS), "checkout"))


@query(_sql(_SETTINGS, {"telegramChatId": _text("telegramChatId", "true", "x"), "webhookUrl": _text("webhookUrl", "({0} = '' OR " + _URL + ")", "url"), "emailNotifications": _flag("emailNotifications"), "telegramNotifications": _flag("telegramNotifications"), "webhookNotifications": _flag("webhookNotifications")}))
def body_settings(spark, d):
    """SRC-10: bodies of settings."""
    return _joined(b.read(_bodies(spark, d, _SETTINGS), "settings"))
