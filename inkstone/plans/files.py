"""Queries for sources, sinks and streams: tables are written as files, read back by the operator, and compared with the tables.

The files lie in a new folder of the shared one (see session.scratch).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics as M
from ..operators import rank as R
from ..operators import tokens as V
from ..operators.corpus import corpus_blocks
from ..schemas import ENGINES, METRICS, PLACE
from ..session import scratch
from ..sources import json_records as J
from ..sources import sinks
from ..sources.catalog import Catalog, Dataset, body_lines, by_ids, several
from ..sources.tables import table
from ..streaming import enrich as E
from .reference import _CHARS, _CI, _DOCS, _KEY, _LOG, _POEMS, _RANK, _WS, _ci, _docs, _log, _poems, _rank, _vocab

TANG = "author string, title string, id string, paragraphs array<string>"
#: Scans of the folder of both sides' files: name, glob, pattern on the path, files left out.
SCANS = (
    ("ci files", J.CI_FILES, None, None),
    ("song files of poets", J.POET_FILES, None, None),
    ("no such files", "none.*.json", None, None),
    ("ci by pattern", None, J.CI_PATTERN, None),
    ("poets by pattern", None, J.POET_PATTERN, None),
    ("all but one", None, None, ["ci.song.1000.json"]),
)
#: Names that are looked up, of which two are in no catalog.
LOOKED_UP = ("lakeci", "gatefu", "nowhere", "papermix", "")
#: Counts that are asked again whatever their size, and the engine they are looked for in.
SPECIAL = {"baidu": (1_000_000, 54_321), "bing": (100_000, 7)}


def _folder(s: SparkSession, d: str) -> str:
    """A folder with the JSON array files of both record tables."""
    folder = scratch(s, "files")
    both = _ci(s, d).select(*PLACE, "author", "rhythmic", "paragraphs").unionByName(_poems(s, d).select(*PLACE, "author", "title", "id", "paragraphs"), allowMissingColumns=True)
    sinks.write_array_files(both, folder)
    return folder


def _lines(c: str) -> F.Column:
    return F.when(F.col(c).isNotNull(), F.array_join(c, "\n"))


def _scan(s: SparkSession, d: str) -> DataFrame:
    df = J.json_array(s, _folder(s, d), TANG, glob="poet.tang.*.json")
    return df.select(*PLACE, "author", "title", "id", _lines("paragraphs").alias("lines"), F.size("paragraphs").alias("n_lines"))


def _scan_counts(s: SparkSession, d: str) -> DataFrame:
    folder, out = _folder(s, d), None
    for name, glob, pattern, excludes in SCANS:
        found = J.json_array(s, folder, TANG, glob, pattern, excludes)
        part = found.agg(F.count_distinct("source_file").alias("files"), F.count("*").alias("records")).select(F.lit(name).alias("scan"), "files", "records")
        out = part if out is None else out.unionByName(part)
    return out


def _loader(s: SparkSession, d: str) -> Catalog:
    """Datasets over the files: a folder without one file, a folder, a single file; two of them without excludes."""
    folder = scratch(s, "datasets")
    sinks.write_array_files(_ci(s, d).select(*PLACE, "author", "paragraphs"), f"{folder}/ci")
    sinks.write_array_files(_poems(s, d).select(*PLACE, "title", "paragraphs"), f"{folder}/tang")
    return Catalog([Dataset("ci", 0, "ci/", "paragraphs", ("ci.song.1000.json",)), Dataset("tang", 1, "tang/", "paragraphs"), Dataset("first", 7, "tang/poet.tang.0.json", "paragraphs")], folder)


def _counted(lines: DataFrame) -> DataFrame:
    return lines.groupBy("target_pos", "dataset", *PLACE).agg(F.count("*").alias("n_lines"), F.max("line_pos").alias("last_pos"), F.sum(F.coalesce(F.length("line"), F.lit(0))).alias("n_chars"))


def _catalog_lookup(s: SparkSession, d: str) -> DataFrame:
    c = Catalog.from_table(table(s, d, "dataset_catalog"))
    rows = []
    for name in LOOKED_UP:
        try:
            rows.append((name, True, c.get(name).path, len(c.get(name).excludes)))
        except ValueError:
            rows.append((name, False, None, None))
    return s.createDataFrame(rows, "name string, known boolean, path string, n_excludes int")


def _spread(s: SparkSession, d: str) -> DataFrame:
    records = J.json_array(s, _folder(s, d), TANG, glob="poet.tang.*.json")
    return body_lines(records, "title", spread=True).where("line <> ''").select(*PLACE, "line_pos", F.col("line").alias("ch"))


def _written(s: SparkSession, d: str) -> str:
    path = f"{scratch(s, 'corpus')}/corpus"
    sinks.write_corpus(_docs(s, d), path, ["doc_id"])
    return path


def _corpus_pieces(s: SparkSession, d: str) -> DataFrame:
    return J.corpus_text(s, _written(s, d)).select(T.strip(F.col("text")).alias("piece")).where("piece <> ''").groupBy("piece").agg(F.count("*").alias("n"))


def _corpus_bytes(s: SparkSession, d: str) -> DataFrame:
    return J.file_sizes(s, f"{_written(s, d)}/part-*").agg(F.sum("bytes").cast("long").alias("bytes"))


def _records(s: SparkSession, d: str) -> DataFrame:
    path, cols = f"{scratch(s, 'records')}/records", ("rec_id", *PLACE, "author", "title", "paragraphs")
    df = _poems(s, d).select(*cols)
    sinks.write_records(df, path)
    return s.read.schema(df.schema).json(path).select("rec_id", *PLACE, "author", "title", _lines("paragraphs").alias("lines"))


def _array_lines(s: SparkSession, d: str) -> DataFrame:
    path = f"{scratch(s, 'array')}/array"
    sinks.write_json_array(_poems(s, d).select("rec_id", "author", F.col("rec_id").alias("n")), path, ["rec_id"])
    lines = s.read.text(path)
    record = F.from_json(F.regexp_replace("value", r"^[\[,]|\]$", ""), "author string, n bigint")
    return lines.select(record["n"].alias("rec_id"), record["author"].alias("author"), F.col("value").startswith("[").alias("opens"), F.col("value").endswith("}]").alias("closes"))


def _artefact(s: SparkSession, d: str) -> DataFrame:
    path = f"{scratch(s, 'vocab')}/vocab"
    sinks.write_vocab(V.vocab_artefact(_vocab(s, d), "documents"), path)
    read = s.read.schema("input_file string, vocab_size bigint, stoi map<string,int>, itos map<string,string>").json(path)
    each = read.select("input_file", "vocab_size", "itos", F.explode("stoi").alias("ch", "id"))
    return each.select("input_file", "vocab_size", "ch", F.col("id").cast("bigint").alias("id"), F.col("itos")[F.col("id").cast("string")].alias("back"))


def _positions(s: SparkSession, d: str) -> DataFrame:
    """pos, id of every character of the corpus."""
    blocks = corpus_blocks(_docs(s, d), 4096)
    chars = blocks.select((F.col("block") * 4096).alias("base"), F.posexplode(T.characters(F.col("text"))).alias("i", "ch")).where("ch <> ''")
    return chars.join(F.broadcast(_vocab(s, d)), "ch").select((F.col("base") + F.col("i")).alias("pos"), "id")  # characters: bounded by the code space


def _preview(s: SparkSession, d: str) -> DataFrame:
    docs = _docs(s, d)
    total = V.total_chars(docs).first()[0]
    first = corpus_blocks(docs, 200).where("block = 0").first()
    out = V.encoded_preview(_positions(s, d), first.text if first else "", int(total * (1 - 0.1)))
    return out.select("first_chars", *[F.array_join(V.long_ids(F.col(c)).cast("array<string>"), " ").alias(c) for c in ("first_encoded_ids", "train_preview_ids", "val_preview_ids")])


def _metric_files(s: SparkSession, d: str) -> DataFrame:
    folder, log, out = scratch(s, "metrics"), _log(s, d), None
    for r in log.select("run").distinct().collect():  # a run has a file
        sinks.write_metric_csv(log.where(F.col("run") == r.run), f"{folder}/{r.run}")
        part = J.metric_csv(s, f"{folder}/{r.run}").withColumn("run", F.lit(r.run))
        out = part if out is None else out.unionByName(part)
    return out.select("run", "step", *METRICS)


def _inspected(s: SparkSession, d: str) -> DataFrame:
    df = J.inspect(s, f"{_folder(s, d)}/*.json")
    return df.select("source_file", "top", F.col("records").cast("bigint").alias("records"), F.array_join(F.array_sort("keys"), ",").alias("keys"), F.col("first")["author"].alias("author"), F.col("first")["paragraphs"].alias("paragraphs"))


def _missing(s: SparkSession, d: str) -> DataFrame:
    names = lambda t: table(s, d, t).select("source_file").distinct()
    return sinks.not_yet_written(names("ci").unionByName(names("tang_poem")), names("ci_rank"))


def _special(s: SparkSession, d: str) -> DataFrame:
    flags = F.array(*[F.struct(F.lit(e).alias("engine"), R.is_low(e, special=n).alias("low")) for e, n in SPECIAL.items()])
    return _rank(s, d).select(*PLACE, F.explode(flags).alias("f")).where("f.low").select(*PLACE, "f.engine")


def _unknown(s: SparkSession, d: str) -> DataFrame:
    poems = _poems(s, d).select(F.concat_ws("\n", "paragraphs").alias("text"))
    return V.unknown_characters(_docs(s, d), V.char_vocab(poems, "text", "\n"))


def _steps(s: SparkSession, d: str) -> DataFrame:
    return _log(s, d).where("train_loss is not null").select("run", "step", M.step_line(F.col("step"), F.col("train_loss")).alias("line"))


def _escaped(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", T.escape_newlines(F.col("text")).alias("text"), F.substring("text", 1, 30).alias("first_30"))


def _engine_stream(s: SparkSession, d: str, engines: tuple[str, ...]) -> tuple[str, list[str]]:
    """Run an enrichment for each engine over files of ci records; the folder with memo and output of each."""
    folder = scratch(s, "stream")
    _ci(s, d).select("rec_id", "author", "rhythmic").repartition(5, "rec_id").write.json(f"{folder}/in")
    rank = R.with_query_key(_rank(s, d))
    started = []
    for e in engines:
        counts = rank.groupBy("kd").agg(F.max(e).alias("n"))

        def compute(keys: DataFrame, counts: DataFrame = counts) -> DataFrame:
            return keys.join(counts, "kd", "left").select("kd", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))

        records = R.with_query_key(E.record_stream(s, f"{folder}/in", "rec_id bigint, author string, rhythmic string", 2))
        started.append(E.enrich(records, compute, f"{folder}/{e}/memo", f"{folder}/{e}/out", f"{folder}/{e}/checkpoint", ["rec_id"], every=2))
    E.finish(started)
    return folder, list(engines)


def _stream_enrich(s: SparkSession, d: str) -> DataFrame:
    folder, engines = _engine_stream(s, d, ("baidu", "google"))
    out = None
    for e in engines:
        part = s.read.schema("rec_id bigint, kd string, n bigint").parquet(f"{folder}/{e}/out").select(F.lit(e).alias("engine"), "rec_id", "kd", "n")
        out = part if out is None else out.unionByName(part)
    return out


def _stream_memo(s: SparkSession, d: str) -> DataFrame:
    folder, (e,) = _engine_stream(s, d, ("bing",))
    return E.memo(s, f"{folder}/{e}/memo").read()


def _stream_repair(s: SparkSession, d: str) -> DataFrame:
    folder = scratch(s, "repair")
    cols = [*PLACE, *ENGINES]
    types = "source_file string, rec_pos int, " + ", ".join(f"{e} bigint" for e in ENGINES)
    table(s, d, "ci_rank").select(*cols).repartition(5).write.json(f"{folder}/in")
    E.finish([E.repair(E.record_stream(s, f"{folder}/in", types), f"{folder}/state", f"{folder}/checkpoint", ENGINES, PLACE, every=2)])
    return E.largest(s, f"{folder}/state", ENGINES, PLACE, types)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "json_scan": _scan,
        "scan_counts": _scan_counts,
        "dataset_lines": lambda s, d: _counted(several(s, _loader(s, d), ["ci", "tang", "first", "ci"])),
        "dataset_by_ids": lambda s, d: _counted(by_ids(s, _loader(s, d), [7, 0])),
        "catalog_lookup": _catalog_lookup,
        "spread_body": _spread,
        "corpus_pieces": _corpus_pieces,
        "corpus_bytes": _corpus_bytes,
        "records_sink": _records,
        "array_sink": _array_lines,
        "vocab_artefact": _artefact,
        "encoded_preview": _preview,
        "metric_files": _metric_files,
        "inspect_files": _inspected,
        "missing_outputs": _missing,
        "special_counts": _special,
        "out_of_vocabulary": _unknown,
        "step_lines": _steps,
        "escaped_texts": _escaped,
        "base_names": lambda s, d: J.json_array(s, _folder(s, d), TANG).select("source_file").distinct(),
        "stream_enrich": _stream_enrich,
        "stream_memo": _stream_memo,
        "stream_repair": _stream_repair,
    }


# --- SQL ---------------------------------------------------------------------------------------

_JOINED = "CASE WHEN paragraphs IS NOT NULL THEN coalesce(list_aggregate(list_filter(paragraphs, lambda x: x IS NOT NULL), 'string_agg', chr(10)), '') END"
_ALL = f"{_POEMS}, {_CI}, both_ AS (SELECT source_file, rec_pos, author FROM poems UNION ALL SELECT source_file, rec_pos, author FROM cis)"


def _scanned(name: str, glob: str | None, pattern: str | None, excludes: list[str] | None) -> str:
    cond = "true"
    if glob:
        cond = f"source_file GLOB '{glob}'"
    if pattern:
        cond = f"regexp_matches(source_file, '{pattern}')"
    if excludes:
        cond = "source_file NOT IN (" + ", ".join(f"'{e}'" for e in excludes) + ")"
    return f"SELECT '{name}' AS scan, count(DISTINCT source_file) AS files, count(*) AS records FROM both_ WHERE {cond}"


def _loaded(k: int, name: str, of: str, cond: str = "true") -> str:
    return f"SELECT {k} AS target_pos, '{name}' AS dataset, source_file, rec_pos, unnest(paragraphs) AS line, unnest(range(len(paragraphs))) AS line_pos FROM {of} WHERE {cond}"


def _lines_sql(*parts: str) -> str:
    return f"WITH {_POEMS}, {_CI}, l AS ({' UNION ALL '.join(parts)}) SELECT target_pos, dataset, source_file, rec_pos, count(*) AS n_lines, max(line_pos)::INT AS last_pos, sum(coalesce(length(line), 0))::BIGINT AS n_chars FROM l GROUP BY ALL"


def oracle_sql() -> dict[str, str]:
    no_1000, only_0 = "source_file <> 'ci.song.1000.json'", "source_file = 'poet.tang.0.json'"
    low = {e: " OR ".join(f"coalesce({n} BETWEEN {R.LOW_COUNTS[n][0]} AND {R.LOW_COUNTS[n][1]} OR {n} IN {SPECIAL[e]}, false)" for n in (("bing", "bing_en") if e == "bing" else (e,))) for e in SPECIAL}
    keys = f"memo AS (SELECT {_KEY.format('ranks')} AS kd, * FROM ranks)"
    return {
        "json_scan": f"WITH {_POEMS} SELECT source_file, rec_pos, author, title, id, {_JOINED} AS lines, len(paragraphs)::INT AS n_lines FROM poems",
        "scan_counts": f"WITH {_ALL} " + " UNION ALL ".join(_scanned(*x) for x in SCANS),
        "dataset_lines": _lines_sql(_loaded(0, "ci", "cis", no_1000), _loaded(1, "tang", "poems"), _loaded(2, "first", "poems", only_0), _loaded(3, "ci", "cis", no_1000)),
        "dataset_by_ids": _lines_sql(_loaded(0, "first", "poems", only_0), _loaded(1, "ci", "cis", no_1000)),
        "catalog_lookup": f"SELECT l.name AS name, c.name IS NOT NULL AS known, c.path AS path, CASE WHEN c.name IS NOT NULL THEN coalesce(len(c.excludes), 0) END::INT AS n_excludes FROM (VALUES {', '.join(f'({n!r})' for n in LOOKED_UP)}) l(name) LEFT JOIN dataset_catalog c ON l.name = c.name",
        "spread_body": f"WITH {_POEMS}, c AS (SELECT source_file, rec_pos, unnest(string_split(title, '')) AS ch, unnest(range(length(title)))::INT AS line_pos FROM poems WHERE title <> '') SELECT source_file, rec_pos, line_pos, ch FROM c",
        "corpus_pieces": f"WITH {_DOCS}, p AS (SELECT trim(unnest(string_split(text, chr(10) || chr(10))), {_WS}) AS piece FROM docs) SELECT piece, count(*) AS n FROM p WHERE piece <> '' GROUP BY piece",
        "corpus_bytes": f"WITH {_DOCS} SELECT sum(strlen(text) + 2)::BIGINT AS bytes FROM docs",
        "records_sink": f"WITH {_POEMS} SELECT rec_id, source_file, rec_pos, author, title, {_JOINED} AS lines FROM poems",
        "array_sink": f"WITH {_POEMS} SELECT rec_id, author, rec_id = min(rec_id) OVER () AS opens, rec_id = max(rec_id) OVER () AS closes FROM poems",
        "vocab_artefact": f"WITH {_CHARS} SELECT 'documents' AS input_file, (SELECT count(*) FROM vocab) AS vocab_size, ch, id, ch AS back FROM vocab",
        "encoded_preview": f"""WITH {_CHARS}, c AS (SELECT string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS t FROM docs), k AS (SELECT floor(length(t) * (1 - 0.1::DOUBLE))::BIGINT AS k FROM c),
            g AS (SELECT unnest(string_split(t, '')) AS ch, unnest(range(length(t))) AS pos FROM c), n AS (SELECT pos, id, k FROM g JOIN vocab USING (ch), k)
            SELECT (SELECT substring(t, 1, 200) FROM c) AS first_chars, string_agg(id::VARCHAR, ' ' ORDER BY pos) FILTER (WHERE pos < 200) AS first_encoded_ids,
            string_agg(id::VARCHAR, ' ' ORDER BY pos) FILTER (WHERE pos < least(100, k)) AS train_preview_ids, string_agg(id::VARCHAR, ' ' ORDER BY pos) FILTER (WHERE pos >= k AND pos < k + 100) AS val_preview_ids FROM n""",
        "metric_files": f"WITH {_LOG} SELECT run, step, {', '.join(METRICS)} FROM logged",
        "inspect_files": f"""WITH {_POEMS}, {_CI}, r AS (SELECT source_file, rec_pos, paragraphs, author, [CASE WHEN author IS NOT NULL THEN 'author' END, CASE WHEN id IS NOT NULL THEN 'id' END, CASE WHEN paragraphs IS NOT NULL THEN 'paragraphs' END, CASE WHEN title IS NOT NULL THEN 'title' END] AS ks FROM poems
            UNION ALL SELECT source_file, rec_pos, paragraphs, author, [CASE WHEN author IS NOT NULL THEN 'author' END, CASE WHEN paragraphs IS NOT NULL THEN 'paragraphs' END, CASE WHEN rhythmic IS NOT NULL THEN 'rhythmic' END] FROM cis)
            SELECT f.source_file AS source_file, 'array' AS top, n AS records, list_aggregate(list_filter(ks, lambda x: x IS NOT NULL), 'string_agg', ',') AS keys, author, CASE WHEN paragraphs IS NOT NULL THEN to_json(paragraphs)::VARCHAR END AS paragraphs
            FROM r f JOIN (SELECT source_file, count(*) AS n FROM r GROUP BY source_file) c ON f.source_file = c.source_file WHERE rec_pos = 0""",
        "missing_outputs": "SELECT source_file FROM (SELECT source_file FROM ci UNION SELECT source_file FROM tang_poem) WHERE source_file NOT IN (SELECT source_file FROM ci_rank WHERE source_file IS NOT NULL)",
        "special_counts": f"WITH {_RANK} " + " UNION ALL ".join(f"SELECT source_file, rec_pos, '{e}' AS engine FROM ranks WHERE {c}" for e, c in low.items()),
        "out_of_vocabulary": f"WITH {_CHARS}, {_POEMS}, known AS (SELECT DISTINCT unnest(string_split(list_aggregate(paragraphs, 'string_agg', chr(10)), '')) AS ch FROM poems UNION SELECT chr(10)) SELECT ch, count(*) AS n FROM chars WHERE ch NOT IN (SELECT ch FROM known WHERE ch IS NOT NULL) GROUP BY ch",
        "step_lines": f"WITH {_LOG} SELECT run, step, printf('Step %05d: %.6f', step, train_loss) AS line FROM logged WHERE train_loss IS NOT NULL",
        "escaped_texts": f"WITH {_DOCS} SELECT doc_id, replace(text, chr(10), '\\n') AS text, substring(text, 1, 30) AS first_30 FROM docs",
        "base_names": "SELECT DISTINCT source_file FROM (SELECT source_file FROM ci UNION SELECT source_file FROM tang_poem)",
        "stream_enrich": f"WITH {_CI}, {_RANK}, {keys} " + " UNION ALL ".join(f"SELECT '{e}' AS engine, rec_id, k.kd AS kd, coalesce(n, 0) AS n FROM (SELECT rec_id, {_KEY.format('cis')} AS kd FROM cis) k LEFT JOIN (SELECT kd, max({e}) AS n FROM memo GROUP BY kd) m ON k.kd = m.kd" for e in ("baidu", "google")),
        "stream_memo": f"WITH {_CI}, {_RANK}, {keys} SELECT k.kd AS kd, coalesce(n, 0) AS n FROM (SELECT DISTINCT {_KEY.format('cis')} AS kd FROM cis) k LEFT JOIN (SELECT kd, max(bing) AS n FROM memo GROUP BY kd) m ON k.kd = m.kd",
        "stream_repair": f"SELECT source_file, rec_pos, {', '.join(f'max({e}) AS {e}' for e in ENGINES)} FROM ci_rank GROUP BY source_file, rec_pos",
    }
