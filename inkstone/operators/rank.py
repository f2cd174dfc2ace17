"""Search-rank side data: result counts out of pages, per-engine columns, repair, merges by position."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import ENGINES, PLACE

# How each engine's page shows the number of results, and the counts that are asked again.
COUNT_PATTERNS = {
    "baidu": r"百度为您找到相关结果约([\d,]+)个",
    "so360": r"找到相关结果约([\d,]+)个",
    "google": r"(?:找到约|About)?\s*([\d,]+)\s*(?:条结果|results)",
    "bing": r"(?i)>([\d,]+)\s*(?:results|条结果)</span>",
    "bing_en": r"(?i)>([\d,]+)\s*(?:results|条结果)</span>",
}
SCRIPT_BLOCK = r"(?s)<(script|style)[^>]*>.*?</\1>"
LOW_COUNTS = {"baidu": (0, 100), "google": (0, 500), "bing": (0, 200), "bing_en": (0, 200), "so360": (0, 200)}
#: Engines of which each has a narrow file; bing's holds bing_en too. Later ones win in a merge.
MERGED = ("baidu", "so360", "bing", "google")


def without_scripts(html: Column) -> Column:
    return F.regexp_replace(html, SCRIPT_BLOCK, "")


def result_count(html: Column, engine: str) -> Column:
    """The first count on a page, 0 where there is none; scripts and styles are left out except on the bing_en page."""
    page = html if engine == "bing_en" else without_scripts(html)
    digits = F.replace(F.regexp_extract(F.coalesce(page, F.lit("")), COUNT_PATTERNS[engine], 1), F.lit(","))
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def is_low(engine: str, limits: Mapping[str, tuple[int, int]] = LOW_COUNTS, special: Sequence[int] = ()) -> Column:
    """A count within the limits (both included) or one of the special numbers; false for a missing one. bing also looks at bing_en."""
    names = ("bing", "bing_en") if engine == "bing" else (engine,)
    out = F.lit(False)
    for n in names:
        out = out | F.coalesce(F.col(n).between(*limits[n]), F.lit(False))
        if special:
            out = out | F.coalesce(F.col(n).isin(*special), F.lit(False))
    return out


def low_counts(df: DataFrame, limits: Mapping[str, tuple[int, int]] = LOW_COUNTS, engines: Sequence[str] = MERGED) -> DataFrame:
    """engine, source_file, low: rows of a file that are to be asked again, where there are any."""
    flags = F.array(*[F.struct(F.lit(e).alias("engine"), is_low(e, limits).alias("low")) for e in engines])
    each = df.select("source_file", F.explode(flags).alias("f"))
    return each.groupBy("f.engine", "source_file").agg(F.count_if("f.low").alias("low")).where("low > 0")


def any_zero(df: DataFrame, columns: Sequence[str] = ENGINES) -> DataFrame:
    """Rows in which some count is exactly 0."""
    return df.where(F.exists(F.array(*columns), lambda x: F.coalesce(x == 0, F.lit(False))))


def long_counts(df: DataFrame, keep: Sequence[str] = (*PLACE, "author", "rhythmic"), engines: Sequence[str] = ENGINES) -> DataFrame:
    """Wide to long: one row for each engine's non-null count."""
    return df.unpivot(list(keep), list(engines), "engine", "n").where("n is not null")


def narrow(df: DataFrame, engine: str) -> DataFrame:
    """The columns of one engine's file."""
    counts = ("bing", "bing_en") if engine == "bing" else (engine,)
    return df.select(*PLACE, "author", "rhythmic", *counts)


def merge_engines(long: DataFrame, needed: Sequence[str] = MERGED, check: bool = False) -> DataFrame:
    """Long to wide by position: source_file, rec_pos, author, rhythmic, one column for each engine.

    Only files that all needed engines have are merged. author and rhythmic come from the last of
    the needed engines that has the position. With check, engines that disagree about them at a
    position are an error. A count given twice for a position and engine counts as the larger.
    """
    order = F.array_position(F.array(*map(F.lit, needed)), F.when(F.col("engine") == "bing_en", "bing").otherwise(F.col("engine")))
    whole = long.groupBy("source_file").agg(F.size(F.array_intersect(F.collect_set("engine"), F.array(*map(F.lit, needed)))).alias("k")).where(F.col("k") == len(needed)).select("source_file")
    who = F.struct("author", "rhythmic")
    cells = [F.max(F.when(F.col("engine") == e, F.col("n"))).alias(e) for e in ENGINES]
    out = long.withColumn("_o", order).groupBy(*PLACE).agg(F.max_by(who, F.struct("_o", "author", "rhythmic")).alias("w"), F.min(who).alias("low"), F.max(who).alias("high"), *cells)
    if check:
        agree = F.coalesce(F.col("low") == F.col("high"), F.lit(True))
        told = F.concat(F.lit("bad info "), F.col("source_file"), F.lit(" at "), F.col("rec_pos").cast("string"))
        out = out.withColumn("w", F.when(agree, F.col("w")).otherwise(F.raise_error(told).cast("struct<author:string,rhythmic:string>")))
    return out.join(whole, "source_file", "left_semi").select(*PLACE, "w.author", "w.rhythmic", *ENGINES)


def conflicts(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Positions at which two tables hold different values, with both sides' values."""
    pairs = [F.struct(F.col(f"a.{c}").alias("x"), F.col(f"b.{c}").alias("y")) for c in columns]
    differ = None
    for c in columns:
        d = ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        differ = d if differ is None else differ | d
    met = a.alias("a").join(b.alias("b"), list(PLACE)).where(differ)
    return met.select(*PLACE, *[p["x"].alias(f"{c}_a") for p, c in zip(pairs, columns, strict=True)], *[p["y"].alias(f"{c}_b") for p, c in zip(pairs, columns, strict=True)])


def attach(side: DataFrame, main: DataFrame, columns: Sequence[str]) -> DataFrame:
    """side with columns of main at the same position; positions that only one has stay, with nulls."""
    return side.join(main.select(*PLACE, *columns), list(PLACE), "full_outer")


def memo_misses(wanted: DataFrame, memo: DataFrame, key: str = "kd") -> DataFrame:
    """Distinct keys that the memo doesn't hold: what remains to be computed."""
    return wanted.where(F.col(key).isNotNull()).select(key).distinct().join(memo.select(key), key, "left_anti")


def memo_lookup(wanted: DataFrame, memo: DataFrame, computed: DataFrame, key: str = "kd") -> DataFrame:
    """wanted with the memo's value or else the computed one. Both have the same columns, one row for each key."""
    return wanted.join(memo.unionByName(computed.join(memo.select(key), key, "left_anti")), key, "left")


def upsert_max(old: DataFrame, new: DataFrame, columns: Sequence[str] = ENGINES, key: Sequence[str] = PLACE) -> DataFrame:
    """old with each count replaced by the new one where that is larger (or the old one is missing); rows only new has are added.

    A key that repeats counts once, with its largest counts.
    """
    top = lambda d, tag: d.groupBy(*key).agg(*[F.max(c).alias(f"{tag}_{c}") for c in columns])
    return top(old, "o").join(top(new, "n"), list(key), "full_outer").select(*key, *[F.greatest(f"o_{c}", f"n_{c}").alias(c) for c in columns])


def duplicate_counts(df: DataFrame, columns: Sequence[str] = ("bing", "bing_en"), above: int = 10_000) -> DataFrame:
    """num, count of counts above a bound that occur more than once in the columns."""
    return df.select(F.explode(F.array(*columns)).alias("num")).where(F.col("num") > above).groupBy("num").agg(F.count("*").alias("count")).where(F.col("count") > 1)


def ranked(df: DataFrame) -> DataFrame:
    """Most frequent first, ties by the lesser number."""
    return df.orderBy(F.desc("count"), F.asc("num"))


def rank_file_name(name: Column, engine: str = "") -> Column:
    """ci.song.N.json -> ci.song.rank[.engine].N.json, poet.tang.N.json -> poet.tang.rank[.engine].N.json."""
    tag = f".rank.{engine}" if engine else ".rank"
    return F.regexp_replace(name, r"^(.*?)(ci\.song|poet\.(?:song|tang))", f"$1$2{tag}")


def zero_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r"^(.*?)(ci\.song|poet\.(?:song|tang))", "$1$2.zero")


def with_query_key(df: DataFrame, author: str = "author", title: str = "rhythmic") -> DataFrame:
    return df.withColumn("kd", T.query_key(F.col(author), F.col(title)))
