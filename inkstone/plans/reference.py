"""Queries for the corpus, rank, metric and decoding operators, over whole tables, with equivalent SQL for DuckDB.

Records that were sent again count once. SQL works out the same results in its own way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify as K
from ..operators import corpus as C
from ..operators import decoding as D
from ..operators import metrics as M
from ..operators import rank as R
from ..operators import stats as S
from ..operators import tokens as V
from ..operators.model import Shape, generate, random_weights
from ..schemas import ENGINES, PLACE
from ..sources.catalog import Catalog, without
from ..sources.tables import once, table

MIB = 1 << 20
TARGETS = (("1_5mb", int(1.5 * MIB)), ("5mb", 5 * MIB), ("10mb", 10 * MIB))
#: Window length and number of windows of the sampled training batches.
CONTEXT, BATCH, BATCHES = 64, 32, 4
#: Characters generated after each document.
NEW_CHARS = 200
#: Sources that the dataset queries leave out.
EXCLUDED = ("northkiln_commentary_1", "lampwell_export_3")


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "source", T.unix_newlines(F.coalesce("text", F.lit(""))).alias("text"), F.col("text").alias("raw"))


def _poems(s: SparkSession, d: str) -> DataFrame:
    return once(table(s, d, "tang_poem"))


def _ci(s: SparkSession, d: str) -> DataFrame:
    return once(table(s, d, "ci"))


def _rank(s: SparkSession, d: str) -> DataFrame:
    """Rank rows: the largest counts at a position, author and rhythmic of the greatest pair."""
    r = table(s, d, "ci_rank")
    who = F.max(F.struct("author", "rhythmic")).alias("w")
    return r.groupBy(*PLACE).agg(who, *[F.max(e).alias(e) for e in ENGINES]).select(*PLACE, "w.author", "w.rhythmic", *ENGINES)


def _strain(s: SparkSession, d: str) -> DataFrame:
    best = F.max_by(F.struct("strains", "id"), F.struct(F.size("strains"), F.coalesce("id", F.lit("")), F.array_join(F.coalesce("strains", F.array()), "\n"))).alias("b")
    return table(s, d, "strain").groupBy(*PLACE).agg(best).select(*PLACE, "b.strains", F.col("b.id").alias("strain_id"))


def _page(e: str) -> F.Column:
    """A result page that shows the engine's count, with a misleading count in a script."""
    n = F.format_number(F.col(e), 0)
    shown = {
        "baidu": F.concat(F.lit("<div>百度为您找到相关结果约"), n, F.lit("个</div>")),
        "so360": F.concat(F.lit("<p>找到相关结果约"), n, F.lit("个</p>")),
        "google": F.concat(F.lit("<div>找到约 "), n, F.lit(" 条结果</div>")),
        "bing": F.concat(F.lit('<span class="n">'), n, F.lit(" Results</span>")),
        "bing_en": F.concat(F.lit("<span>"), n, F.lit(" results</span>")),
    }[e]
    return F.coalesce(F.concat(F.lit('<html><style type="a">p{}</style><script>\nx="<b>7 results</span>找到相关结果约7个百度为您找到相关结果约7个"\n</script>'), shown, F.lit("</html>")), F.lit("<html>none</html>"))


def _page_counts(s: SparkSession, d: str) -> DataFrame:
    pages = _rank(s, d).select(*PLACE, *[_page(e).alias(e) for e in ENGINES])
    return pages.select(*PLACE, *[R.result_count(F.col(e), e).alias(e) for e in ENGINES])


def _long(s: SparkSession, d: str) -> DataFrame:
    return R.long_counts(_rank(s, d))


def _merge_conflicts(s: SparkSession, d: str) -> DataFrame:
    return R.conflicts(_ci(s, d), _rank(s, d), ("author", "rhythmic"))


def _enrich(s: SparkSession, d: str) -> DataFrame:
    out = R.attach(_strain(s, d), _poems(s, d), ("rec_id", "id"))
    return out.select(*PLACE, F.array_join("strains", "\n").alias("strains"), "strain_id", "rec_id", "id")


def _halves(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = table(s, d, "ci_rank")
    cut = F.lit("2024-03-15").cast("timestamp_ntz")
    early = F.coalesce(F.col("fetched_at").cast("timestamp_ntz") < cut, F.lit(False))  # rows without a time are new ones
    return r.where(early), r.where(~early)


def _misses(s: SparkSession, d: str) -> DataFrame:
    have = R.with_query_key(_rank(s, d)).select("kd").distinct()
    return R.memo_misses(R.with_query_key(_ci(s, d)), have)


def _lookup(s: SparkSession, d: str) -> DataFrame:
    """Each ci record with the largest baidu count known under its query key; keys without one get 0."""
    memo = R.with_query_key(_rank(s, d)).groupBy("kd").agg(F.max("baidu").alias("n"))
    wanted = R.with_query_key(_ci(s, d)).select("rec_id", "kd")
    fresh = R.memo_misses(wanted, memo).withColumn("n", F.lit(0).cast("bigint"))
    return R.memo_lookup(wanted, memo, fresh).select("rec_id", "kd", "n")


def _upsert(s: SparkSession, d: str) -> DataFrame:
    old, new = _halves(s, d)
    return R.upsert_max(old, new)


def _log(s: SparkSession, d: str) -> DataFrame:
    return M.logged_once(table(s, d, "metric_log"))


def _bpc(s: SparkSession, d: str) -> DataFrame:
    return M.validated(_log(s, d)).select("run", "step", F.round(M.bits_per_char(F.col("train_loss")), 6).alias("train_bpc"), F.round(M.bits_per_char(F.col("avg_val_loss")), 6).alias("val_bpc"))


def _vocab(s: SparkSession, d: str) -> DataFrame:
    return V.char_vocab(_docs(s, d), "text", "\n")


def _encoded(s: SparkSession, d: str) -> DataFrame:
    docs = _docs(s, d)
    return V.encode(docs, V.char_vocab(docs, "text", "\n")).select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


def _decoded(s: SparkSession, d: str) -> DataFrame:
    docs = _docs(s, d)
    vocab = V.char_vocab(docs, "text", "\n")
    return V.decode(V.encode(docs, vocab), vocab)


def _total(s: SparkSession, d: str) -> int:
    return V.total_chars(_docs(s, d)).first()[0]


def _grid(s: SparkSession, d: str) -> DataFrame:
    """Windows at 100 starts spread evenly over the corpus."""
    last = _total(s, d) - CONTEXT - 1
    starts = s.range(100).select((F.col("id") * last / 99).cast("long").alias("start")).distinct()
    return C.windows(_docs(s, d), starts, CONTEXT)


def _cover(s: SparkSession, d: str) -> DataFrame:
    """Windows at every CONTEXT-th character, which cover the corpus but for an end that fills none: each block, and its shift by the next one's first character."""
    blocks = C.corpus_blocks(_docs(s, d), CONTEXT)
    after = blocks.select((F.col("block") - 1).alias("block"), F.substring("text", 1, 1).alias("first"))
    x = F.col("text")
    met = blocks.join(after, "block").where((F.length(x) == CONTEXT) & (F.length("first") == 1))
    return met.select((F.col("block") * CONTEXT).alias("start"), x.alias("x"), F.concat(F.substring(x, 2, CONTEXT), "first").alias("y"))


def _split(s: SparkSession, d: str) -> DataFrame:
    """Characters of each document in the training and in the validation part of the corpus."""
    placed = C.offsets(_docs(s, d), "doc_id", F.length("text"), 2)
    return C.split_sizes(placed, _total(s, d)).select("doc_id", F.col("start").alias("doc_start"), "train_chars", "val_chars")


def _argmax(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", D.argmax(F.col("embedding")).cast("bigint").alias("best"))


def _topk(s: SparkSession, d: str) -> DataFrame:
    kept = table(s, d, "embeddings").select("vec_id", F.posexplode(D.top_k(F.col("embedding"), 10)).alias("id", "logit")).where("logit > double('-inf')")
    return kept.select("vec_id", F.col("id").cast("bigint").alias("id"), F.round("logit", 6).alias("logit"))


def _softmax(s: SparkSession, d: str) -> DataFrame:
    p = D.softmax(D.scaled(F.col("embedding"), 0.1))
    return table(s, d, "embeddings").select("vec_id", F.posexplode(p).alias("id", "p")).select("vec_id", F.col("id").cast("bigint").alias("id"), F.round("p", 9).alias("p"))


def _settings(s: SparkSession, d: str) -> DataFrame:
    out = D.compare_settings(table(s, d, "embeddings").select("vec_id", "embedding"), "embedding")
    return out.select("vec_id", "setting", F.col("choices").cast("bigint").alias("choices"), F.round("best_prob", 9).alias("best_prob"))


def _draws(s: SparkSession, d: str) -> DataFrame:
    """One draw for each vector by a number that depends on its id."""
    u = (F.pmod(F.col("vec_id") * 7919, F.lit(10007)) + 0.5) / 10007
    x = table(s, d, "embeddings").select("vec_id", D.softmax(F.transform("embedding", lambda v: v.cast("double"))).alias("p"), u.alias("u"))
    return x.select("vec_id", D.draw(F.col("p"), F.col("u")).cast("bigint").alias("drawn"))


def _loss(s: SparkSession, d: str) -> DataFrame:
    """Mean cross-entropy of the vectors against their label, by batches of equal label."""
    x = table(s, d, "embeddings").select("label", M.cross_entropy(F.col("embedding"), F.col("label")).alias("loss"))
    return M.mean_of_means(x, "label", "loss").select(F.round("avg_loss", 9).alias("avg_loss"))


def _reports(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "embeddings").select("vec_id", D.argmax(F.col("embedding")).alias("best"))
    odd = F.col("vec_id") % 2 == 1
    text = D.report(F.lit("Sample"), F.lit("base4.pt"), F.lit(10000), F.lit("一\n二"), F.lit(1), F.col("best").cast("string"), F.when(odd, F.lit("0.8")), F.when(odd, F.lit(20)))
    return x.select("vec_id", text.alias("report"))


def _generated(s: SparkSession, d: str) -> DataFrame:
    """n_ids, generated: the characters that a model with random weights puts after every document; none after an empty one."""
    docs = _docs(s, d)
    vocab = V.char_vocab(docs, "text", "\n")
    shape = Shape(vocab=vocab.count(), context=16, width=16, layers=1, heads=2)
    out = generate(V.encode(docs, vocab), random_weights(shape), shape, new=NEW_CHARS, temperature=0.8, k=20, key="doc_id")
    new = out.select(F.struct("doc_id", F.size("ids").alias("n_ids")).alias("doc"), F.slice("ids", -NEW_CHARS, NEW_CHARS).alias("ids"))
    return V.decode(new, vocab, key="doc").select("doc.doc_id", "doc.n_ids", F.col("text").alias("generated"))


def _catalog(s: SparkSession, d: str) -> DataFrame:
    """The catalog in order of its numbers, as the loader sees it."""
    c = Catalog.from_table(table(s, d, "dataset_catalog"))
    rows = [(n, c.get(n).path, c.get(n).tag, len(c.get(n).excludes)) for n in c.named(sorted(c.by_id))]
    return s.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos int, name string, path string, tag string, n_excludes int")


def _file_names(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "ci").select("source_file").unionByName(table(s, d, "tang_poem").select("source_file")).distinct()
    c = F.col("source_file")
    return f.select("source_file", R.rank_file_name(c).alias("merged"), R.rank_file_name(c, "bing").alias("bing"), R.zero_file_name(c).alias("zero"), T.padded(F.regexp_extract(c, r"\d+", 0), 6).alias("padded"))


def _first(s: SparkSession, d: str) -> DataFrame:
    return S.first_n(_poems(s, d), "rec_pos", 5).select(*PLACE, "author", "title", F.length(T.poem_text(F.col("paragraphs"))).alias("chars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    first = lambda df: df.select(*[c for c in df.columns if c != "first"])
    return {
        "corpus_basic_stats": lambda s, d: S.corpus_basics(_docs(s, d), raw="raw"),
        "lines_per_poem_dist": lambda s, d: first(S.lines_per_poem(_docs(s, d))),
        "lines_per_poem_top10": lambda s, d: first(S.top_n(S.lines_per_poem(_docs(s, d)), 10)),
        "line_length_top15": lambda s, d: first(S.top_n(S.line_lengths(_docs(s, d)), 15)),
        "bare_line_length_dist": lambda s, d: first(S.line_lengths(_docs(s, d), bare=True)),
        "sublines_per_record_dist": lambda s, d: first(S.sublines_per_record(_poems(s, d))),
        "subline_length_dist": lambda s, d: first(S.subline_lengths(_poems(s, d))),
        "subline_length_top15": lambda s, d: first(S.top_n(S.subline_lengths(_poems(s, d)), 15)),
        "record_texts": lambda s, d: _ci(s, d).select("rec_id", T.poem_text(F.col("paragraphs")).alias("text")),
        "export_summary": lambda s, d: S.export_summary(_ci(s, d)),
        "first_records": _first,
        "classify_records": lambda s, d: K.classify(_poems(s, d)).select("rec_id", "reason", "num_sublines", "subline_length", F.array_join("sublines", "|").alias("sublines")),
        "classify_loose": lambda s, d: K.classify(_ci(s, d), counts=(1, 4, 8), lengths=None).select("rec_id", "reason", "num_sublines", "subline_length"),
        "candidate_flags": lambda s, d: K.is_candidate(_poems(s, d)).select("rec_id", "is_candidate"),
        "candidate_records": lambda s, d: K.candidates(_poems(s, d), (*PLACE, "author", "title", "id")).drop("sublines"),
        "rejection_counts": lambda s, d: K.rejection_counts(K.classify(_poems(s, d))),
        "source_rejections": lambda s, d: K.source_summary(K.classify(_poems(s, d))).select("source_file", "total", "passed", F.to_json("rejections").alias("rejections")),
        "passed_by_count": lambda s, d: K.passed_by(K.classify(_poems(s, d)), "num_sublines"),
        "passed_by_length": lambda s, d: K.passed_by(K.classify(_poems(s, d)), "subline_length"),
        "subset_by_bytes": lambda s, d: C.subset_by_bytes(_docs(s, d), TARGETS),
        "char_vocab": _vocab,
        "total_chars": lambda s, d: V.total_chars(_docs(s, d)),
        "encode_docs": _encoded,
        "decode_docs": _decoded,
        "train_val_split": _split,
        "bigram_counts": lambda s, d: V.bigram_counts(_docs(s, d)),
        "window_grid": _grid,
        "window_cover": _cover,
        "page_counts": _page_counts,
        "query_keys": lambda s, d: R.with_query_key(_ci(s, d)).select("rec_id", "kd"),
        "low_count_tally": lambda s, d: R.low_counts(_rank(s, d)),
        "zero_rows": lambda s, d: R.any_zero(_rank(s, d)).select(*PLACE, *ENGINES),
        "engine_split": lambda s, d: _long(s, d).select(*PLACE, "engine", "n"),
        "engine_narrow": lambda s, d: R.narrow(_rank(s, d), "bing"),
        "engine_merge": lambda s, d: R.merge_engines(_long(s, d)),
        "merge_checked": lambda s, d: R.merge_engines(_long(s, d), check=True),
        "merge_conflicts": _merge_conflicts,
        "positional_enrich": _enrich,
        "rank_of_records": lambda s, d: _ci(s, d).select("rec_id", *PLACE).join(_rank(s, d), list(PLACE), "left").select("rec_id", *ENGINES),
        "memo_misses": _misses,
        "memo_lookup": _lookup,
        "upsert_max": _upsert,
        "duplicate_counts": lambda s, d: R.duplicate_counts(table(s, d, "ci_rank")),
        "file_names": _file_names,
        "metric_bpc": _bpc,
        "metric_summary": lambda s, d: M.history_summary(_log(s, d)).select("run", "metric", "steps", "first", "last", "least", "most", F.round("mean", 9).alias("mean")),
        "best_checkpoints": lambda s, d: M.best_checkpoints(_log(s, d), 50),
        "saved_steps": lambda s, d: M.every(_log(s, d), 50).select("run", "step", "train_loss"),
        "decode_argmax": _argmax,
        "decode_topk": _topk,
        "decode_softmax": _softmax,
        "decode_settings": _settings,
        "decode_draws": _draws,
        "decode_reports": _reports,
        "cross_entropy": _loss,
        "generate": _generated,
        "dataset_union_exclude": lambda s, d: without(table(s, d, "documents"), "source", EXCLUDED).select("doc_id", "source"),
        "catalog_order": _catalog,
    }


# --- SQL ---------------------------------------------------------------------------------------

_WS = "(" + " || ".join(f"chr({ord(c)})" for c in T.WHITESPACE) + ")"
_PUNCT = T.PUNCTUATION.replace("'", "''")
_DOCS = "docs AS (SELECT doc_id, source, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents)"


def _once(name: str, of: str, *cols: str) -> str:
    return f"{name} AS (SELECT rec_id, {', '.join(f'any_value({c}) AS {c}' for c in cols)} FROM {of} WHERE rec_id IS NOT NULL GROUP BY rec_id)"


_POEMS = _once("poems", "tang_poem", "source_file", "rec_pos", "author", "title", "id", "paragraphs")
_CI = _once("cis", "ci", "source_file", "rec_pos", "author", "rhythmic", "paragraphs")
_PIECES = f"""{_DOCS}, pieces AS (SELECT doc_id, i AS poem_pos, list_filter(string_split(p, chr(10)), lambda l: trim(l, {_WS}) <> '') AS ls FROM
  (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM (SELECT doc_id, list_filter(string_split(trim(text, {_WS}), chr(10) || chr(10)), lambda p: trim(p, {_WS}) <> '') AS ps FROM docs)))"""
_LINES = f"{_PIECES}, ls AS (SELECT doc_id, poem_pos, unnest(ls) AS line, unnest(range(len(ls))) AS line_pos FROM pieces)"
_BARE = "translate({}, '" + _PUNCT + "', '')"


def _subs(of: str) -> str:
    split = f"list_filter(list_transform(regexp_split_to_array(x, '[{T.SPLIT_MARKS}]'), lambda y: trim(y, {_WS})), lambda y: y <> '')"
    return f"subs AS (SELECT *, CASE WHEN coalesce(len(paragraphs), 0) > 0 THEN flatten(list_transform(list_filter(paragraphs, lambda x: x IS NOT NULL), lambda x: {split})) END AS s FROM {of})"


def _classified(of: str, counts: str = "4, 8", lengths: str | None = "5, 7") -> str:
    named = counts.replace(", ", "_or_")
    allowed = f"l[1] IN ({lengths})" if lengths else "l[1] > 0"
    miss = f"uniform_but_not_{lengths.replace(', ', '_or_')}" if lengths else "zero_length"
    return f"""{_subs(of)}, lens AS (SELECT *, list_distinct(list_transform(s, lambda x: length({_BARE.format("x")}))) AS l FROM subs),
    judged AS (SELECT *, CASE WHEN s IS NULL THEN 'empty_paragraphs' WHEN len(s) NOT IN ({counts}) THEN 'not_{named}_sublines' WHEN len(l) = 0 THEN 'no_lengths'
      WHEN len(l) > 1 THEN 'mixed_subline_lengths' WHEN NOT ({allowed}) THEN '{miss}' ELSE 'passed' END AS reason FROM lens),
    classified AS (SELECT *, CASE WHEN reason = 'passed' THEN len(s)::INT END AS num_sublines, CASE WHEN reason = 'passed' THEN l[1]::INT END AS subline_length FROM judged)"""


_TANG_CLASSES = f"{_POEMS}, {_classified('poems')}"
_RANK = f"""ranks AS (SELECT source_file, rec_pos, w.author AS author, w.rhythmic AS rhythmic, {", ".join(ENGINES)} FROM
  (SELECT source_file, rec_pos, first({{'author': author, 'rhythmic': rhythmic}} ORDER BY author DESC NULLS LAST, rhythmic DESC NULLS LAST) AS w, {", ".join(f"max({e}) AS {e}" for e in ENGINES)} FROM ci_rank GROUP BY ALL))"""
_LONG = f"{_RANK}, counts AS (" + " UNION ALL ".join(f"SELECT source_file, rec_pos, author, rhythmic, '{e}' AS engine, {e} AS n FROM ranks WHERE {e} IS NOT NULL" for e in ENGINES) + ")"
_MERGE = f"""WITH {_LONG}, whole AS (SELECT source_file FROM counts WHERE engine IN ('baidu', 'so360', 'bing', 'google') GROUP BY source_file HAVING count(DISTINCT engine) = 4)
  SELECT source_file, rec_pos, any_value(author) AS author, any_value(rhythmic) AS rhythmic, {", ".join(f"max(n) FILTER (WHERE engine = '{e}') AS {e}" for e in ENGINES)}
  FROM counts WHERE source_file IN (FROM whole) GROUP BY source_file, rec_pos"""
_KEY = "url_encode(coalesce({0}.author, '') || ' ' || coalesce({0}.rhythmic, ''))"
for _coded, _plain in (("%21", "!"), ("%2A", "*"), ("%27", "''"), ("%28", "("), ("%29", ")")):
    _KEY = f"replace({_KEY}, '{_coded}', '{_plain}')"
_LOG = "logged AS (SELECT run, step, max(train_loss) AS train_loss, max(train_bpc) AS train_bpc, max(avg_val_loss) AS avg_val_loss, max(avg_val_bpc) AS avg_val_bpc FROM metric_log GROUP BY run, step)"
_CHARS = f"{_DOCS}, chars AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, unnest(range(length(text))) AS i FROM docs WHERE text <> ''), vocab AS (SELECT ch, row_number() OVER (ORDER BY ch) - 1 AS id FROM (SELECT DISTINCT ch FROM (SELECT ch FROM chars UNION ALL SELECT chr(10))))"
_PLACED = f"{_DOCS}, placed AS (SELECT doc_id, text, length(text) AS size, sum(length(text) + 2) OVER (ORDER BY doc_id) - length(text) - 2 AS start FROM docs), total AS (SELECT sum(size) + 2 * (count(*) - 1) AS n FROM placed)"
_LOGITS = "logits AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS id FROM embeddings)"
_SPLIT_DATE = "TIMESTAMP '2024-03-15'"


def _probabilities(temperature: float, k: int | None) -> str:
    kept = f"QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, id) <= {k}" if k else ""
    return f"""kept AS (SELECT vec_id, id, v / {temperature} AS v FROM logits {kept}), probs AS (SELECT vec_id, id, exp(v - max(v) OVER (PARTITION BY vec_id)) AS e FROM kept)"""


def _tally(engine: str) -> str:
    names = ("bing", "bing_en") if engine == "bing" else (engine,)
    cond = " OR ".join(f"coalesce({n} BETWEEN {R.LOW_COUNTS[n][0]} AND {R.LOW_COUNTS[n][1]}, false)" for n in names)
    return f"SELECT '{engine}' AS engine, source_file, count(*) AS low FROM ranks WHERE {cond} GROUP BY source_file"


def oracle_sql() -> dict[str, str]:
    upserted = ", ".join(f"greatest(max(o_{e}), max(n_{e})) AS {e}" for e in ENGINES)
    halves = " UNION ALL ".join(
        f"SELECT source_file, rec_pos, {', '.join(f'{e} AS {p}_{e}, NULL AS {q}_{e}' for e in ENGINES)} FROM ci_rank WHERE {cond}" for p, q, cond in (("o", "n", f"fetched_at < {_SPLIT_DATE}"), ("n", "o", f"fetched_at IS NULL OR fetched_at >= {_SPLIT_DATE}"))
    )
    halves = f"SELECT source_file, rec_pos, {', '.join(f'o_{e}, n_{e}' for e in ENGINES)} FROM ({halves.split(' UNION ALL ')[0]}) UNION ALL SELECT source_file, rec_pos, {', '.join(f'o_{e}, n_{e}' for e in ENGINES)} FROM ({halves.split(' UNION ALL ')[1]})"
    draws = f"""WITH {_LOGITS}, {_probabilities(1.0, None)}, cum AS (SELECT vec_id, id, sum(e) OVER (PARTITION BY vec_id ORDER BY id) / sum(e) OVER (PARTITION BY vec_id) AS c FROM probs)
      SELECT vec_id, min(id)::BIGINT AS drawn FROM cum WHERE c > ((vec_id * 7919) % 10007 + 0.5::DOUBLE) / 10007 GROUP BY vec_id"""
    settings = " UNION ALL ".join(
        [f"SELECT vec_id, 'greedy' AS setting, 1::BIGINT AS choices, 1::DOUBLE AS best_prob FROM embeddings"]
        + [
            f"SELECT * FROM (WITH {_probabilities(t, k)} SELECT vec_id, '{n}' AS setting, count(*) AS choices, round(max(e) / sum(e), 9) AS best_prob FROM probs GROUP BY vec_id)"
            for n, t, k in D.SETTINGS
            if t is not None
        ]
    )
    return {
        "corpus_basic_stats": f"""WITH {_PIECES}, n AS (SELECT (SELECT coalesce(sum(strlen(text)), 0)::BIGINT FROM documents) AS bytes, count(*) AS poems, coalesce(sum(len(ls)), 0)::BIGINT AS lines,
            coalesce(sum(list_sum(list_transform(ls, lambda l: length(l)))), 0)::BIGINT AS chars FROM pieces)
            SELECT *, CASE WHEN poems = 0 THEN 0 ELSE lines / poems::DOUBLE END AS lines_per_poem, CASE WHEN lines = 0 THEN 0 ELSE chars / lines::DOUBLE END AS chars_per_line FROM n""",
        "lines_per_poem_dist": f"WITH {_PIECES} SELECT len(ls) AS n_lines, count(*) AS freq FROM pieces GROUP BY ALL",
        "lines_per_poem_top10": f"WITH {_PIECES} SELECT len(ls) AS n_lines, count(*) AS freq FROM pieces GROUP BY len(ls) ORDER BY freq DESC, min((doc_id, poem_pos)) LIMIT 10",
        "line_length_top15": f"WITH {_LINES} SELECT length(line) AS length, count(*) AS freq FROM ls GROUP BY length(line) ORDER BY freq DESC, min((doc_id, poem_pos, line_pos)) LIMIT 15",
        "bare_line_length_dist": f"WITH {_LINES} SELECT length({_BARE.format('line')}) AS length, count(*) AS freq FROM ls GROUP BY ALL",
        "sublines_per_record_dist": f"WITH {_POEMS}, {_subs('poems')} SELECT coalesce(len(s), 0) AS n_sublines, count(*) AS freq FROM subs GROUP BY ALL",
        "subline_length_dist": f"WITH {_POEMS}, {_subs('poems')} SELECT length({_BARE.format('u')}) AS length, count(*) AS freq FROM (SELECT unnest(s) AS u FROM subs) GROUP BY ALL",
        "subline_length_top15": f"WITH {_POEMS}, {_subs('poems')} SELECT length({_BARE.format('u')}) AS length, count(*) AS freq FROM (SELECT rec_id, unnest(s) AS u, unnest(range(len(s))) AS i FROM subs) GROUP BY length({_BARE.format('u')}) ORDER BY freq DESC, min((rec_id, i)) LIMIT 15",
        "record_texts": f"WITH {_CI} SELECT rec_id, CASE WHEN coalesce(len(paragraphs), 0) > 0 THEN coalesce(list_aggregate(list_filter(paragraphs, lambda x: x IS NOT NULL), 'string_agg', chr(10)), '') END AS text FROM cis",
        "export_summary": f"WITH {_CI}, h AS (SELECT source_file, coalesce(len(paragraphs), 0) > 0 AS ok FROM cis) SELECT source_file, grouping(source_file)::INT AS is_total, count(*) AS scanned, count(*) FILTER (WHERE ok) AS exported, count(*) FILTER (WHERE NOT ok) AS skipped FROM h GROUP BY ROLLUP (source_file)",
        "first_records": f"WITH {_POEMS} SELECT source_file, rec_pos, author, title, CASE WHEN coalesce(len(paragraphs), 0) > 0 THEN coalesce(length(list_aggregate(list_filter(paragraphs, lambda x: x IS NOT NULL), 'string_agg', chr(10))), 0) END AS chars FROM poems WHERE rec_pos < 5",
        "classify_records": f"WITH {_TANG_CLASSES} SELECT rec_id, reason, num_sublines, subline_length, CASE WHEN reason = 'passed' THEN list_aggregate(s, 'string_agg', '|') END AS sublines FROM classified",
        "classify_loose": f"WITH {_CI}, {_classified('cis', '1, 4, 8', None)} SELECT rec_id, reason, num_sublines, subline_length FROM classified",
        "candidate_flags": f"WITH {_TANG_CLASSES} SELECT rec_id, reason = 'passed' AS is_candidate FROM classified",
        "candidate_records": f"WITH {_TANG_CLASSES} SELECT source_file, rec_pos, author, title, id, num_sublines, subline_length FROM classified WHERE reason = 'passed'",
        "rejection_counts": f"WITH {_TANG_CLASSES} SELECT reason, count(*) AS records FROM classified WHERE reason <> 'passed' GROUP BY ALL",
        "source_rejections": f"""WITH {_TANG_CLASSES}, e AS (SELECT source_file, reason, count(*) AS n FROM classified GROUP BY ALL)
            SELECT source_file, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (WHERE reason = 'passed'), 0)::BIGINT AS passed,
            '{{' || coalesce(string_agg('"' || reason || '":' || n, ',' ORDER BY reason) FILTER (WHERE reason <> 'passed'), '') || '}}' AS rejections FROM e GROUP BY source_file""",
        "passed_by_count": f"WITH {_TANG_CLASSES} SELECT num_sublines, count(*) AS records FROM classified WHERE reason = 'passed' GROUP BY ALL",
        "passed_by_length": f"WITH {_TANG_CLASSES} SELECT subline_length, count(*) AS records FROM classified WHERE reason = 'passed' GROUP BY ALL",
        "subset_by_bytes": f"""WITH {_DOCS}, targets(subset, t) AS (VALUES {", ".join(f"('{n}', {b})" for n, b in TARGETS)}),
            cum AS (SELECT doc_id, sum(strlen(text) + 2) OVER (ORDER BY doc_id) - 2 AS e FROM docs), both_ AS (SELECT doc_id, e, coalesce(lag(e) OVER (ORDER BY doc_id), 0) AS p FROM cum)
            SELECT subset, doc_id FROM both_, targets WHERE e <= t OR (p <= t AND abs(t - e) < abs(t - p))""",
        "char_vocab": f"WITH {_CHARS} SELECT ch, id FROM vocab",
        "total_chars": f"WITH {_DOCS} SELECT (sum(length(text)) + 2 * (count(*) - 1))::BIGINT AS total FROM docs",
        "encode_docs": f"WITH {_CHARS} SELECT doc_id, coalesce(string_agg(id::VARCHAR, ' ' ORDER BY i), '') AS ids FROM docs LEFT JOIN (SELECT doc_id, i, id FROM chars JOIN vocab USING (ch)) USING (doc_id) GROUP BY doc_id",
        "decode_docs": f"WITH {_DOCS} SELECT doc_id, text FROM docs",
        "train_val_split": f"WITH {_PLACED}, cutoff AS (SELECT floor(n * (1 - 0.1::DOUBLE))::BIGINT AS k FROM total), v AS (SELECT doc_id, start::BIGINT AS doc_start, size, greatest(0, least(size, k - start))::BIGINT AS t FROM placed, cutoff) SELECT doc_id, doc_start, t AS train_chars, size - t AS val_chars FROM v",
        "bigram_counts": f"""WITH {_DOCS}, c AS (SELECT string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS t FROM docs), chars AS (SELECT unnest(string_split(t, '')) AS x, unnest(range(length(t))) AS i FROM c),
            p AS (SELECT x, lead(x) OVER (ORDER BY i) AS y FROM chars) SELECT x, y, count(*) AS n FROM p WHERE y IS NOT NULL GROUP BY ALL""",
        "window_grid": f"""WITH {_DOCS}, c AS (SELECT string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS t FROM docs), n AS (SELECT t, length(t) - {CONTEXT} - 1 AS last FROM c),
            g AS (SELECT DISTINCT t, floor(k * last / 99)::BIGINT AS start FROM n, range(100) r(k)) SELECT start, substring(t, start + 1, {CONTEXT}) AS x, substring(t, start + 2, {CONTEXT}) AS y FROM g""",
        "window_cover": f"""WITH {_DOCS}, c AS (SELECT string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS t FROM docs), chars AS (SELECT unnest(string_split(t, '')) AS ch, unnest(range(length(t))) AS pos FROM c),
            xs AS (SELECT pos // {CONTEXT} AS k, string_agg(ch, '' ORDER BY pos) AS x FROM chars GROUP BY k), ys AS (SELECT (pos - 1) // {CONTEXT} AS k, string_agg(ch, '' ORDER BY pos) AS y FROM chars WHERE pos > 0 GROUP BY k)
            SELECT k * {CONTEXT} AS start, x, y FROM xs JOIN ys USING (k) WHERE length(y) = {CONTEXT}""",
        "page_counts": f"WITH {_RANK} SELECT source_file, rec_pos, {', '.join(f'coalesce({e}, 0) AS {e}' for e in ENGINES if e != 'bing_en')}, CASE WHEN bing_en IS NULL THEN 0 ELSE 7 END::BIGINT AS bing_en FROM ranks",
        "query_keys": f"WITH {_CI} SELECT rec_id, {_KEY.format('cis')} AS kd FROM cis",
        "low_count_tally": f"WITH {_RANK} {' UNION ALL '.join(map(_tally, R.MERGED))}",
        "zero_rows": f"WITH {_RANK} SELECT source_file, rec_pos, {', '.join(ENGINES)} FROM ranks WHERE {' OR '.join(f'coalesce({e} = 0, false)' for e in ENGINES)}",
        "engine_split": f"WITH {_LONG} SELECT source_file, rec_pos, engine, n FROM counts",
        "engine_narrow": f"WITH {_RANK} SELECT source_file, rec_pos, author, rhythmic, bing, bing_en FROM ranks",
        "engine_merge": _MERGE,
        "merge_checked": _MERGE,
        "merge_conflicts": f"""WITH {_CI}, {_RANK} SELECT source_file, rec_pos, c.author AS author_a, c.rhythmic AS rhythmic_a, r.author AS author_b, r.rhythmic AS rhythmic_b FROM cis c JOIN ranks r USING (source_file, rec_pos)
            WHERE c.author IS DISTINCT FROM r.author OR c.rhythmic IS DISTINCT FROM r.rhythmic""",
        "positional_enrich": f"""WITH {_POEMS}, best AS (SELECT source_file, rec_pos, strains, id AS strain_id FROM strain
            QUALIFY row_number() OVER (PARTITION BY source_file, rec_pos ORDER BY coalesce(len(strains), -1) DESC, coalesce(id, '') DESC, coalesce(list_aggregate(strains, 'string_agg', chr(10)), '') DESC) = 1)
            SELECT source_file, rec_pos, CASE WHEN strains IS NOT NULL THEN coalesce(list_aggregate(list_filter(strains, lambda x: x IS NOT NULL), 'string_agg', chr(10)), '') END AS strains, strain_id, rec_id, id FROM best FULL OUTER JOIN poems USING (source_file, rec_pos)""",
        "rank_of_records": f"WITH {_CI}, {_RANK} SELECT rec_id, {', '.join(ENGINES)} FROM cis LEFT JOIN ranks USING (source_file, rec_pos)",
        "memo_misses": f"WITH {_CI}, {_RANK} SELECT DISTINCT {_KEY.format('cis')} AS kd FROM cis WHERE {_KEY.format('cis')} NOT IN (SELECT {_KEY.format('ranks')} FROM ranks)",
        "memo_lookup": f"WITH {_CI}, {_RANK}, memo AS (SELECT {_KEY.format('ranks')} AS kd, max(baidu) AS n, 1 AS hit FROM ranks GROUP BY 1) SELECT rec_id, k.kd AS kd, CASE WHEN hit = 1 THEN n ELSE 0 END AS n FROM (SELECT rec_id, {_KEY.format('cis')} AS kd FROM cis) k LEFT JOIN memo USING (kd)",
        "upsert_max": f"WITH h AS ({halves}) SELECT source_file, rec_pos, {upserted} FROM h GROUP BY source_file, rec_pos",
        "duplicate_counts": "SELECT num, count(*) AS count FROM (SELECT bing AS num FROM ci_rank UNION ALL SELECT bing_en FROM ci_rank) WHERE num > 10000 GROUP BY num HAVING count(*) > 1",
        "file_names": """WITH f AS (SELECT source_file AS s FROM ci UNION SELECT source_file FROM tang_poem), g AS (SELECT s, CASE WHEN s LIKE 'ci.song%' THEN 'ci.song' WHEN s LIKE 'poet.song%' THEN 'poet.song' ELSE 'poet.tang' END AS h FROM f)
            SELECT s AS source_file, replace(s, h, h || '.rank') AS merged, replace(s, h, h || '.rank.bing') AS bing, replace(s, h, h || '.zero') AS zero, lpad(regexp_extract(s, '\\d+'), 6, ' ') AS padded FROM g""",
        "metric_bpc": f"WITH {_LOG} SELECT run, step, round(train_loss / ln(2), 6) AS train_bpc, round(avg_val_loss / ln(2), 6) AS val_bpc FROM logged WHERE avg_val_loss IS NOT NULL AND avg_val_bpc IS NOT NULL",
        "metric_summary": f"""WITH {_LOG}, long AS ({" UNION ALL ".join(f"SELECT run, step, '{m}' AS metric, {m} AS v FROM logged WHERE {m} IS NOT NULL" for m in M.METRICS)})
            SELECT run, metric, count(*) AS steps, arg_min(v, step) AS first, arg_max(v, step) AS last, min(v) AS least, max(v) AS most, round(avg(v), 9) AS mean FROM long GROUP BY run, metric""",
        "best_checkpoints": f"""WITH {_LOG}, v AS (SELECT run, step, avg_val_loss AS l FROM logged WHERE avg_val_loss IS NOT NULL),
            b AS (SELECT run, step AS best_step, l AS best_loss FROM v QUALIFY row_number() OVER (PARTITION BY run ORDER BY l, step) = 1),
            s AS (SELECT run, step AS best_saved_step, l AS best_saved_loss FROM v WHERE step % 50 = 0 QUALIFY row_number() OVER (PARTITION BY run ORDER BY l, step) = 1),
            f AS (SELECT run, step AS final_step, l AS final_loss FROM v QUALIFY row_number() OVER (PARTITION BY run ORDER BY step DESC) = 1)
            SELECT * FROM b LEFT JOIN s USING (run) LEFT JOIN f USING (run)""",
        "saved_steps": f"WITH {_LOG} SELECT run, step, train_loss FROM logged WHERE step % 50 = 0",
        "decode_argmax": "SELECT vec_id, list_position(embedding, list_max(embedding))::BIGINT - 1 AS best FROM embeddings",
        "decode_topk": f"WITH {_LOGITS} SELECT vec_id, id::BIGINT AS id, round(v, 6) AS logit FROM logits QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, id) <= 10",
        "decode_softmax": f"WITH {_LOGITS}, {_probabilities(0.1, None)} SELECT vec_id, id::BIGINT AS id, round(e / sum(e) OVER (PARTITION BY vec_id), 9) AS p FROM probs",
        "decode_settings": f"WITH {_LOGITS} {settings}",
        "decode_draws": draws,
        "decode_reports": """SELECT vec_id, '=== Sample ===' || chr(10) || 'Checkpoint: base4.pt' || chr(10) || 'Checkpoint step: 10000' || chr(10) || 'Prompt: ''一\\n二''' || chr(10) || 'Max new chars: 1' || chr(10)
            || CASE WHEN vec_id % 2 = 1 THEN 'Temperature: 0.8' || chr(10) || 'Top-k: 20' || chr(10) ELSE '' END || chr(10) || '=== Generated text ===' || chr(10) || (list_position(embedding, list_max(embedding)) - 1) || chr(10) AS report FROM embeddings""",
        "cross_entropy": f"""WITH {_LOGITS}, t AS (SELECT vec_id, label, max(v) AS m FROM logits GROUP BY ALL), z AS (SELECT vec_id, label, ln(sum(exp(v - m))) + any_value(m) - max(v) FILTER (WHERE id = label) AS loss FROM logits JOIN t USING (vec_id, label) GROUP BY vec_id, label)
            SELECT round(avg(a), 9) AS avg_loss FROM (SELECT label, avg(loss) AS a FROM z GROUP BY label)""",
        "dataset_union_exclude": f"SELECT doc_id, source FROM documents WHERE source IS NULL OR source NOT IN ({', '.join(repr(x) for x in EXCLUDED)})",
        "catalog_order": "SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS pos, name, path, tag, coalesce(len(excludes), 0)::INT AS n_excludes FROM dataset_catalog",
    }
