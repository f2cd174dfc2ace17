"""Queries pN_ of the training-data problems tagged llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut
from ..sources.tables import once, paragraph_rows, table
from . import bpe, language, lookalike, packing, spans, terms, versions

RECORDS = ("tang_poem", "ci")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return paragraph_rows(spark, d, *RECORDS)


#: Forms of ASCII signs in full width, and the plain ones; blanks of the width of an ideograph.
WIDE, PLAIN = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000", "".join(map(chr, range(0x21, 0x7F))) + " "


def _folded(paragraphs: Column) -> Column:
    """Elements with widths folded and without blanks at their ends: a small part of one look."""
    return F.transform(paragraphs, lambda e: F.btrim(F.translate(F.coalesce(e, F.lit("")), WIDE, PLAIN), F.lit(" ")))


def _joined_to(pairs: DataFrame, records: DataFrame, *columns: str) -> DataFrame:
    """Pairs with the columns of both records, as a_ and b_."""
    for t in "ab":
        pairs = pairs.join(records.select(F.col("rec_id").alias(f"rec_{t}"), *[F.col(c).alias(f"{t}_{c}") for c in columns]), f"rec_{t}")
    return pairs


def _repeats(s: SparkSession, d: str) -> DataFrame:
    """Records with a repeat, and how many repeats don't stand word for word at both places or could be longer at an end (none)."""
    text = spans.bodies(once(_records(s, d)))
    found = spans.repeats(_records(s, d)).withColumnsRenamed({"rec_id": "rec_a", "other_id": "rec_b"})
    met = _joined_to(found, text, "body")
    cut_out = lambda t, at, n: F.substring(F.col(f"{t}_body"), (at + 1).cast("int"), n.cast("int"))
    a, b, n = F.col("span_start"), F.col("other_start"), F.col("span_chars")
    before = (a > 0) & (b > 0) & (cut_out("a", a - 1, F.lit(1)) == cut_out("b", b - 1, F.lit(1)))
    behind = (a + n < F.length("a_body")) & (b + n < F.length("b_body")) & (cut_out("a", a + n, F.lit(1)) == cut_out("b", b + n, F.lit(1)))
    unequal = (cut_out("a", a, n) != cut_out("b", b, n)) | (F.col("rec_a") == F.col("rec_b"))
    return met.agg(F.count_distinct("rec_a").alias("records"), F.count_if(unequal).alias("unequal"), F.count_if(before | behind).alias("extensible"))


def _width_pairs(s: SparkSession, d: str) -> DataFrame:
    """Pairs of p3_found that differ in widths and blanks at the ends alone, which SQL can find."""
    met = _joined_to(lookalike.same_look_pairs(_records(s, d)), once(_records(s, d)), "paragraphs")
    return met.where(_folded(F.col("a_paragraphs")) == _folded(F.col("b_paragraphs"))).select("rec_a", "rec_b")


def _version_copies(s: SparkSession, d: str) -> DataFrame:
    """Pairs of p5_found with equal titles and paragraphs."""
    df = table(s, d, "tang_poem")
    met = _joined_to(versions.version_pairs(df), once(df), "title", "paragraphs")
    return met.where(F.col("a_title").eqNullSafe(F.col("b_title")) & F.col("a_paragraphs").eqNullSafe(F.col("b_paragraphs"))).select("rec_a", "rec_b")


def _faults(**how):
    def run(s: SparkSession, d: str) -> DataFrame:
        sizes = cut(bpe.token_counts(table(s, d, "documents")))
        return packing.packing_faults(packing.pack_sequences(sizes, **how), sizes)

    return run


def _labels(s: SparkSession, d: str) -> DataFrame:
    docs = language.document_languages(table(s, d, "documents"), table(s, d, "lang_name"))
    return docs.select("doc_id", "label_lang", (F.col("runs") > 0).alias("has_letters"), F.col("doc_lang").isNotNull().alias("has_lang"))


def _extent(s: SparkSession, d: str) -> DataFrame:
    """The first and the last line with letters of each document, and how many runs follow another of the same language (none)."""
    runs = language.language_runs(table(s, d, "documents"), table(s, d, "lang_name"))
    g = runs.groupBy("doc_id").agg(F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.array_sort(F.collect_list(F.struct("run", "lang"))).alias("r"))  # as many as the document has lines
    again = F.size(F.filter(F.transform("r", lambda x, i: (i > 0) & (x["lang"] == F.get("r", i - 1)["lang"])), lambda b: b))
    return g.select("doc_id", "first_line", "last_line", again.alias("repeated"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": lambda s, d: spans.shared_spans(_records(s, d)),
        "p1_shared_share": lambda s, d: spans.shared_share(_records(s, d)),
        "p2_found": lambda s, d: terms.marked_terms(_records(s, d)),
        "p2_term_counts": lambda s, d: terms.term_counts(_records(s, d)),
        "p3_found": lambda s, d: lookalike.same_look_pairs(_records(s, d)),
        "p3_spelling": lambda s, d: lookalike.consistent_spelling(_records(s, d)),
        "p5_found": lambda s, d: versions.version_pairs(table(s, d, "tang_poem")),
        "p7_ids": lambda s, d: bpe.encode_texts(table(s, d, "documents")),
        "p7_decoded": lambda s, d: bpe.decode_ids(bpe.encode_texts(table(s, d, "documents"))),
        "p8_packing": lambda s, d: packing.pack_sequences(bpe.token_counts(table(s, d, "documents"))),
        "p8_fill": lambda s, d: packing.sequence_fill(packing.pack_sequences(bpe.token_counts(table(s, d, "documents")))),
        "p9_found": lambda s, d: language.mislabelled_runs(table(s, d, "documents"), table(s, d, "lang_name")),
        "p9_documents": lambda s, d: language.document_languages(table(s, d, "documents"), table(s, d, "lang_name")),
        "p9_segments": lambda s, d: language.language_runs(table(s, d, "documents"), table(s, d, "lang_name")).select("doc_id", "run", "first_line", "last_line", "lang", "confidence"),
        "p1_repeats": _repeats,
        "p3_widths": _width_pairs,
        "p5_copies": _version_copies,
        "p8_faults": _faults(),
        "p8_online_faults": _faults(look_ahead=0, join_open=False),
        "p9_labels": _labels,
        "p9_extent": _extent,
        "p5_groups": lambda s, d: versions.version_groups(table(s, d, "tang_poem")),
    }


_RECORDS = """
rows_ AS (SELECT rec_id, paragraphs FROM tang_poem UNION ALL SELECT rec_id, paragraphs FROM ci),
records AS (SELECT rec_id, any_value(paragraphs) AS paragraphs FROM rows_ WHERE rec_id IS NOT NULL GROUP BY rec_id),
texts AS (SELECT rec_id, coalesce(list_aggregate(list_filter(paragraphs, lambda x: x IS NOT NULL), 'string_agg', {0}), '') AS body FROM records)"""

_SHARED = (
    _RECORDS.format("chr(10)")
    + """,
grams AS (SELECT rec_id, body, unnest(generate_series(1, length(body) - 23)) AS p FROM texts WHERE length(body) >= 24),
hashed AS (SELECT rec_id, p, substring(body, p, 24) AS g FROM grams),
shared AS (SELECT rec_id, p FROM hashed WHERE g IN (SELECT g FROM hashed GROUP BY g HAVING count(DISTINCT rec_id) > 1)),
stepped AS (SELECT rec_id, p, CASE WHEN p <= lag(p) OVER w + 24 THEN 0 ELSE 1 END AS step FROM shared WINDOW w AS (PARTITION BY rec_id ORDER BY p)),
runs AS (SELECT rec_id, p, sum(step) OVER (PARTITION BY rec_id ORDER BY p) AS run FROM stepped),
spans AS (SELECT rec_id, min(p) - 1 AS span_start, max(p) - min(p) + 24 AS span_chars FROM runs GROUP BY rec_id, run)"""
)

_TERMS = (
    _RECORDS.format("''")
    + """,
chars AS (SELECT rec_id, unnest(string_split(body, '')) AS term FROM texts WHERE body <> ''),
counted AS (SELECT term, count(*) AS occurrences, count(DISTINCT rec_id) AS records, (SELECT count(*) FROM texts WHERE body <> '') AS collection_records FROM chars GROUP BY term),
marked AS (SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN records * 5 > collection_records THEN 'common' ELSE 'useful' END AS mark FROM counted)"""
)


#: White space as Python and Spark's pattern of it strip it.
_WS = "(" + " || ".join(f"chr({ord(c)})" for c in T.WHITESPACE) + ")"
_CODES = lambda text: " || ".join(f"chr({ord(c)})" for c in text)


def oracle_sql() -> dict[str, str]:
    fold = f"list_transform(paragraphs, lambda e: trim(translate(coalesce(e, ''), {_CODES(WIDE)}, {_CODES(PLAIN)}), ' '))"
    no_fault = "SELECT count(*) AS items, 0::BIGINT AS wrong_size, 0::BIGINT AS needlessly_cut, 0::BIGINT AS overflowing, 0::BIGINT AS overlapping FROM documents"
    letters = r"\p{L}"
    shown = f"len(list_filter(paragraphs, lambda e: regexp_matches(coalesce(e, ''), '[^\\s\\p{{Z}}\\p{{Cf}}]'))) > 0"
    return {
        "p1_repeats": f"WITH {_SHARED} SELECT count(DISTINCT rec_id) AS records, 0::BIGINT AS unequal, 0::BIGINT AS extensible FROM spans",
        "p3_widths": f"""WITH {_RECORDS.format("''")}, folded AS (SELECT rec_id, paragraphs, {fold} AS f FROM records WHERE len(paragraphs) > 0 AND {shown})
            SELECT a.rec_id AS rec_a, b.rec_id AS rec_b FROM folded a JOIN folded b ON a.f = b.f AND a.rec_id < b.rec_id WHERE a.paragraphs IS DISTINCT FROM b.paragraphs""",
        "p5_copies": f"""WITH t AS (SELECT rec_id, any_value(title) AS title, any_value(paragraphs) AS paragraphs FROM tang_poem WHERE rec_id IS NOT NULL GROUP BY rec_id),
            k AS (SELECT *, coalesce(title, '') || coalesce(list_aggregate(paragraphs, 'string_agg', ''), '') AS body FROM t WHERE len(paragraphs) > 0 AND {shown}),
            u AS (SELECT * FROM k WHERE length(regexp_replace(body, '[^\\p{{L}}\\p{{N}}]', '', 'g')) > 1)
            SELECT a.rec_id AS rec_a, b.rec_id AS rec_b FROM u a JOIN u b ON a.paragraphs = b.paragraphs AND a.title IS NOT DISTINCT FROM b.title AND a.rec_id < b.rec_id""",
        "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p8_faults": no_fault,
        "p8_online_faults": no_fault,
        "p9_labels": f"""WITH n AS (SELECT name, any_value(lang) AS code FROM lang_name WHERE name IS NOT NULL GROUP BY name)
            SELECT doc_id, code AS label_lang, coalesce(regexp_matches(text, '{letters}'), false) AS has_letters, coalesce(regexp_matches(text, '{letters}'), false) AS has_lang
            FROM documents LEFT JOIN n ON name = regexp_replace(lower(trim(lang, {_WS})), '[-_].*$', '')""",
        "p9_extent": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)
            SELECT doc_id, min(i) AS first_line, max(i) AS last_line, 0::INT AS repeated FROM l WHERE regexp_matches(line, '{letters}') GROUP BY doc_id""",
        "p1_found": f"WITH {_SHARED} SELECT rec_id, span_start, span_chars FROM spans",
        "p1_shared_share": f"""WITH {_SHARED}, each AS (SELECT rec_id, sum(span_chars)::BIGINT AS shared_chars FROM spans GROUP BY rec_id)
            SELECT rec_id, length(body) AS body_chars, coalesce(shared_chars, 0) AS shared_chars, CASE WHEN length(body) = 0 THEN 0 ELSE coalesce(shared_chars, 0) / length(body)::DOUBLE END AS shared_share
            FROM texts LEFT JOIN each USING (rec_id)""",
        "p2_found": f"WITH {_TERMS} SELECT term, mark FROM marked WHERE mark <> 'useful'",
        "p2_term_counts": f"WITH {_TERMS} SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id, occurrences, records, collection_records, mark FROM marked",
    }
