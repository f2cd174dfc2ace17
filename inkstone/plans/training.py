"""Queries pN_ of the general training-data problems, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.heavy_keys import heavy_keys, key_totals
from ..operators.packed_values import CLOSING, ESCAPE, OPENING, QUOTES, SEPARATORS, split_values
from ..sources.tables import once, paragraph_rows, table
from .reference import _WS

KEYS = ("rhythmic", "author")


def _sized(spark: SparkSession, d: str) -> DataFrame:
    n = F.coalesce(F.size("paragraphs"), F.lit(0))
    return table(spark, d, "ci").select("rec_id", *KEYS, F.greatest(n, F.lit(0)).cast("long").alias("elements"), F.length(F.concat_ws("", "paragraphs")).cast("long").alias("chars"))


def _plain_values(spark: SparkSession, d: str) -> DataFrame:
    """The values of p4_found out of elements that hold no quotes, brackets or escapes, which SQL can split."""
    rows = paragraph_rows(spark, d, "tang_poem", "ci")
    elements = once(rows).select("rec_id", F.posexplode("paragraphs").alias("elem_pos", "element"))
    signs = "".join(f"\\{c}" for c in QUOTES + OPENING + CLOSING + ESCAPE)
    plain = elements.where(~F.col("element").rlike(f"[{signs}]")).select("rec_id", F.col("elem_pos").cast("long").alias("elem_pos"))
    return split_values(rows).join(plain, ["rec_id", "elem_pos"], "left_semi")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p4_found": lambda s, d: split_values(paragraph_rows(s, d, "tang_poem", "ci")),
        "p4_plain": _plain_values,
        "p6_found": lambda s, d: heavy_keys(table(s, d, "ci"), KEYS),
        "p6_key_totals": lambda s, d: key_totals(_sized(s, d), KEYS, ("elements", "chars")),
    }


_LONG = """
records AS (SELECT rec_id, any_value(rhythmic) AS rhythmic, any_value(author) AS author, any_value(coalesce(len(paragraphs), 0)) AS elements,
  any_value(coalesce(length(list_aggregate(list_filter(paragraphs, lambda x: x IS NOT NULL), 'string_agg', '')), 0)) AS chars
  FROM ci WHERE rec_id IS NOT NULL GROUP BY rec_id),
keyed AS (SELECT 'rhythmic' AS key_field, rhythmic AS key_value, elements, chars FROM records
  UNION ALL SELECT 'author', author, elements, chars FROM records)"""


def oracle_sql() -> dict[str, str]:
    marks = ", ".join(f"chr({ord(c)})" for c in QUOTES + OPENING + CLOSING + ESCAPE)
    separators = "|".join(f"\\x{{{ord(c):04x}}}" for c in SEPARATORS)
    return {
        "p4_plain": f"""WITH rows_ AS (SELECT rec_id, paragraphs FROM tang_poem UNION ALL SELECT rec_id, paragraphs FROM ci), records AS (SELECT rec_id, any_value(paragraphs) AS paragraphs FROM rows_ WHERE rec_id IS NOT NULL GROUP BY rec_id),
            elements AS (SELECT rec_id, unnest(paragraphs) AS element, unnest(range(len(paragraphs))) AS elem_pos FROM records),
            split AS (SELECT rec_id, elem_pos, list_transform(regexp_split_to_array(element, '\\r\\n|{separators}'), lambda v: trim(v, {_WS})) AS vs FROM elements WHERE len(list_filter([{marks}], lambda m: contains(element, m))) = 0),
            several AS (SELECT * FROM split WHERE len(list_filter(vs, lambda v: v <> '')) > 1), each AS (SELECT rec_id, elem_pos, unnest(vs) AS value, unnest(range(len(vs))) AS value_pos FROM several)
            SELECT rec_id, elem_pos, value_pos, value FROM each WHERE value <> ''""",
        "p6_found": f"WITH {_LONG} SELECT key_field, key_value FROM keyed WHERE key_value IS NOT NULL GROUP BY ALL HAVING count(*) * 100 >= 2 * (SELECT count(*) FROM records)",
        "p6_key_totals": f"WITH {_LONG} SELECT key_field, key_value, count(*) AS records, sum(elements)::BIGINT AS elements, sum(chars)::BIGINT AS chars FROM keyed WHERE key_value IS NOT NULL GROUP BY ALL",
    }
