"""Queries for sampled batches, ordered outputs and the character model.

SQL repeats the draws from the generator's raw 32-bit words, and the model's forward pass as joins
over weights that both sides make by one rule.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify as K
from ..operators import corpus as C
from ..operators import decoding as D
from ..operators import metrics as M
from ..operators import rank as R
from ..operators import stats as S
from ..operators import tokens as V
from ..operators.model import Shape, generate, last_logits, load_model, save_model
from ..session import scratch
from ..sources.tables import table
from .reference import _CHARS, _DOCS, _TANG_CLASSES, BATCH, BATCHES, CONTEXT, _docs, _poems, _total, _vocab

SEED = 42
#: A short training run: rows of a batch, steps, how often it is validated and with how many batches; the second run resumes it.
PLAN_ROWS, PLAN_EVERY, PLAN_BATCHES = 3, 4, 2
RUNS = (("fresh", 1, 5), ("resumed", 4, 9))
#: The model that SQL works out too: shape, characters generated.
SMALL = Shape(vocab=13, context=4, width=4, layers=2, heads=2)
PROTOTYPE = Shape(vocab=13, context=4, width=4, layers=1, heads=1, prototype=True)
STEPS = 3
#: Prompts that a report shows in quotes.
PROMPTS = ("一\n二", "it's", 'say "x"', "both ' and \"", "back\\slash\ttab\r", "　春\u200b", "𤗀\u2028é", "")


def _starts(s: SparkSession, d: str) -> DataFrame:
    starts = V.batch_starts(_total(s, d), CONTEXT, BATCH, BATCHES, SEED)
    return s.createDataFrame(starts, "batch int, row int, start long")


def _windows(s: SparkSession, d: str) -> DataFrame:
    starts = _starts(s, d)
    distinct = C.windows(_docs(s, d), starts.select("start").distinct(), CONTEXT)
    return starts.join(distinct, "start").select("batch", "row", "start", "x", "y")


def _first_window(s: SparkSession, d: str) -> DataFrame:
    start = V.first_start(_total(s, d), CONTEXT)
    return C.windows(_docs(s, d), s.createDataFrame([(start,)], "start long"), CONTEXT)


def _parts(s: SparkSession, d: str) -> tuple[int, int]:
    """Characters of the training and of the validation part."""
    total = _total(s, d)
    at = int(total * (1 - 0.1))
    return at, total - at


def _plan(s: SparkSession, d: str) -> DataFrame:
    train, val = _parts(s, d)
    rows = [(name, *r) for name, a, b in RUNS for r in V.batch_plan(train, val, CONTEXT, PLAN_ROWS, a, b, PLAN_EVERY, PLAN_BATCHES, SEED)]
    return s.createDataFrame(rows, "run string, step int, split string, batch int, row int, start long")


def _batches(s: SparkSession, d: str) -> DataFrame:
    """The batches of the plan with their windows, a text below the other, and the identifiers as 64-bit integers."""
    train, _ = _parts(s, d)
    plan = _plan(s, d).withColumn("start", F.col("start") + F.when(F.col("split") == "val", train).otherwise(0))
    found = C.windows(_docs(s, d), plan.select("start").distinct(), CONTEXT)
    stacked = V.batch_rows(plan.join(found, "start"), ("run", "step", "split", "batch"))
    first = V.encode(stacked.select(F.struct("run", "step", "split", "batch").alias("k"), F.element_at("x", 1).alias("text")), _vocab(s, d), key="k")
    ids = first.select("k.*", F.array_join(V.long_ids(F.col("ids")).cast("array<string>"), " ").alias("first_ids"))
    joined = stacked.select("run", "step", "split", "batch", F.size("x").alias("n_rows"), F.array_join("x", "|").alias("x"), F.array_join("y", "|").alias("y"))
    return joined.join(ids, ["run", "step", "split", "batch"])


def _rejections_ranked(s: SparkSession, d: str) -> DataFrame:
    """Reasons, the most frequent first, ties by name."""
    return S.numbered(K.rejection_counts(K.classify(_poems(s, d))), F.desc("records"), F.asc("reason"))


def _duplicates_ranked(s: SparkSession, d: str) -> DataFrame:
    return S.numbered(R.ranked(R.duplicate_counts(table(s, d, "ci_rank"))), F.desc("count"), F.asc("num"))


def rule_weights(shape: Shape) -> dict[str, np.ndarray]:
    """Small weights in 64 bits by a rule: entry (i, j) of the k-th matrix is ((7 i + 3 j + 5 k + i j) mod 11 - 5) / 8."""
    c, k = shape.width, iter(range(100))

    def mat(*size: int) -> np.ndarray:
        i, j = np.indices(size if len(size) == 2 else (1, size[0]))
        out = ((7 * i + 3 * j + 5 * next(k) + i * j) % 11 - 5) / 8
        return out if len(size) == 2 else out[0]

    norm = np.stack([np.ones(c), np.zeros(c)])
    w = {"token": mat(shape.vocab, c), "place": mat(shape.context, c)}
    for n in range(shape.layers):
        w |= {f"{n}.norm1": norm, f"{n}.norm2": norm, f"{n}.qkv": mat(c, 3 * c)}
        if not shape.prototype:
            w |= {f"{n}.out": mat(c, c), f"{n}.out_bias": mat(c)}
        w |= {f"{n}.up": mat(c, 4 * c), f"{n}.up_bias": mat(4 * c), f"{n}.down": mat(4 * c, c), f"{n}.down_bias": mat(c)}
    return w | {"norm": norm, "head": mat(c, shape.vocab), "head_bias": mat(shape.vocab)}


def _coded(s: SparkSession, d: str) -> DataFrame:
    """Every document's characters by code point modulo the small vocabulary."""
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    return _docs(s, d).select("doc_id", F.transform(chars, lambda c: F.ascii(c) % SMALL.vocab).alias("ids"))


def _logits(shape: Shape):
    def run(s: SparkSession, d: str) -> DataFrame:
        out = last_logits(_coded(s, d), rule_weights(shape), shape, "doc_id")
        return out.where("logits is not null").select("doc_id", F.posexplode("logits").alias("id", "logit")).select("doc_id", F.col("id").cast("bigint").alias("id"), F.round("logit", 6).alias("logit"))

    return run


def _greedy(s: SparkSession, d: str) -> DataFrame:
    out = generate(_coded(s, d), rule_weights(SMALL), SMALL, new=STEPS, key="doc_id")
    return out.where("size(ids) > 0").select("doc_id", (F.size("ids") - STEPS).alias("n_prompt"), F.array_join(F.slice("ids", -STEPS, STEPS).cast("array<string>"), " ").alias("new_ids"))


def _quoted(s: SparkSession, d: str) -> DataFrame:
    """A report's line for each prompt."""
    rows = s.createDataFrame(list(enumerate(PROMPTS)), "n int, prompt string")
    text = D.report(F.lit("Sample"), F.lit("base4.pt"), F.lit(1), F.col("prompt"), F.lit(0), F.lit(""), F.lit(None).cast("double"), F.lit(None).cast("int"))
    return rows.select("n", F.regexp_extract(text, "(?s)Prompt: (.*?)\nMax new chars", 1).alias("shown"))


def _kept(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "model")
    save_model(s, path, rule_weights(SMALL), SMALL, _vocab(s, d))
    weights, shape, vocab = load_model(s, path)
    heads = float(weights["head"].sum())
    return vocab.select("ch", "id", F.lit(shape.width).alias("width"), F.lit(shape.layers).alias("layers"), F.lit(len(weights)).alias("matrices"), F.lit(heads).alias("head_sum"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "char_windows": _windows,
        "first_window": _first_window,
        "batch_plan": _plan,
        "training_batches": _batches,
        "rejections_ranked": _rejections_ranked,
        "passed_by_count_ordered": lambda s, d: S.numbered(K.passed_by(K.classify(_poems(s, d)), "num_sublines"), F.asc("num_sublines")),
        "duplicates_ranked": _duplicates_ranked,
        "metric_steps_ordered": lambda s, d: S.numbered(M.logged_once(table(s, d, "metric_log")).select("run", "step"), F.asc("run"), F.asc("step")),
        "model_logits": _logits(SMALL),
        "prototype_logits": _logits(PROTOTYPE),
        "greedy_ids": _greedy,
        "kept_model": _kept,
        "quoted_prompts": _quoted,
    }


# --- SQL ---------------------------------------------------------------------------------------

_CORPUS = f"{_DOCS}, c AS (SELECT string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS t FROM docs)"


def _words(n: int) -> str:
    rng = random.Random(SEED)
    return "words(i, w) AS (VALUES " + ", ".join(f"({i}, {rng.getrandbits(32)}::BIGINT)" for i in range(n)) + ")"


def _bits(n: str) -> str:
    """Bits that a number from 0 to below n takes in the generator: as many as n has."""
    return f"length(ltrim(bin({n}), '0'))"


def _plan_sql() -> str:
    """The draws of each run, one word after the other: a word beyond the range is passed over."""
    draws, rows = [], []
    for name, a, b in RUNS:
        k = 0
        for step in range(a, b + 1):
            for split, batches in (("train", 1), *((("val", PLAN_BATCHES),) if step % PLAN_EVERY == 0 else ())):
                for batch in range(batches):
                    for row in range(PLAN_ROWS):
                        rows.append(f"('{name}', {k}, {step}, '{split}', {batch}, {row})")
                        k += 1
        draws.append(k)
    return f"""{_words(4 * max(draws) + 100)}, draws(run, k, step, split, batch, row) AS (VALUES {", ".join(rows)}),
      parts AS (SELECT length(t) AS n, floor(length(t) * (1 - 0.1::DOUBLE))::BIGINT AS train FROM c),
      ranged AS (SELECT d.*, CASE WHEN split = 'train' THEN train ELSE n - train END - {CONTEXT} AS m FROM draws d, parts),
      walk(run, i, k, got) AS (SELECT DISTINCT run, -1, 0, NULL::BIGINT FROM draws UNION ALL
        SELECT walk.run, w.i, walk.k + CASE WHEN (w.w >> (32 - {_bits("r.m")})) < r.m THEN 1 ELSE 0 END, CASE WHEN (w.w >> (32 - {_bits("r.m")})) < r.m THEN w.w >> (32 - {_bits("r.m")}) END
        FROM walk JOIN words w ON w.i = walk.i + 1 JOIN ranged r ON r.run = walk.run AND r.k = walk.k),
      plan AS (SELECT r.run AS run, step, split, batch, row, got AS start, train FROM ranged r JOIN walk ON walk.run = r.run AND walk.k = r.k + 1 AND got IS NOT NULL, parts)"""


def _matrix(k: int, i: str, j: str) -> str:
    return f"((7 * {i} + 3 * {j} + {5 * k} + {i} * {j}) % 11 - 5) / 8.0::DOUBLE"


def _forward(shape: Shape, tag: str, source: str) -> str:
    """CTEs from source(doc_id, t, id) to {tag}z(doc_id, id, v), the logits behind the last place."""
    c, d, k = shape.width, shape.width // shape.heads, iter(range(100))
    token, place = next(k), next(k)
    out, x = [f"{tag}h AS (SELECT doc_id, t, j, {_matrix(token, 'id', 'j')} + {_matrix(place, 't', 'j')} AS v FROM {source}, range({c}) r(j))"], f"{tag}h"

    def norm(of: str, to: str) -> None:
        out.append(f"{to} AS (SELECT doc_id, t, j, (v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-5::DOUBLE) AS v FROM {of} WINDOW w AS (PARTITION BY doc_id, t))")

    def product(of: str, to: str, width: int, matrix: int, bias: int | None, relu: bool = False, add: str | None = None) -> None:
        v = f"sum(x.v * {_matrix(matrix, 'x.j', 'r.j')})" + (f" + {_matrix(bias, '0', 'r.j')}" if bias is not None else "")
        v = f"greatest({v}, 0)" if relu else v
        plain = f"SELECT x.doc_id, x.t, r.j AS j, {v} AS v FROM {of} x, range({width}) r(j) GROUP BY x.doc_id, x.t, r.j"
        out.append(f"{to} AS ({plain})" if add is None else f"{to} AS (SELECT p.doc_id, p.t, p.j, p.v + a.v AS v FROM ({plain}) p JOIN {add} a USING (doc_id, t, j))")

    for n in range(shape.layers):
        p = f"{tag}{n}"
        qkv = next(k)
        norm(x, f"{p}n")
        product(f"{p}n", f"{p}q", 3 * c, qkv, None)
        scale = c if shape.prototype else d
        out.append(f"{p}s AS (SELECT q.doc_id, q.t, y.t AS u, q.j // {d} AS h, sum(q.v * y.v) / sqrt({scale}) AS s FROM {p}q q JOIN {p}q y ON q.doc_id = y.doc_id AND y.j = q.j + {c} AND y.t <= q.t WHERE q.j < {c} GROUP BY ALL)")
        out.append(f"{p}w AS (SELECT doc_id, t, u, h, exp(s - max(s) OVER w) AS e FROM {p}s WINDOW w AS (PARTITION BY doc_id, t, h))")
        out.append(f"{p}a AS (SELECT w.doc_id, w.t, y.j - {2 * c} AS j, sum(w.e * y.v) / sum(w.e) AS v FROM {p}w w JOIN {p}q y ON w.doc_id = y.doc_id AND y.t = w.u AND y.j >= {2 * c} AND (y.j - {2 * c}) // {d} = w.h GROUP BY ALL)")
        if shape.prototype:
            out.append(f"{p}x AS (SELECT doc_id, t, j, a.v + b.v AS v FROM {p}a a JOIN {x} b USING (doc_id, t, j))")
        else:
            product(f"{p}a", f"{p}x", c, next(k), next(k), add=x)
        norm(f"{p}x", f"{p}m")
        product(f"{p}m", f"{p}u", 4 * c, next(k), next(k), relu=True)
        product(f"{p}u", f"{p}y", c, next(k), next(k), add=f"{p}x")
        x = f"{p}y"
    norm(x, f"{tag}f")
    product(f"{tag}f", f"{tag}l", shape.vocab, next(k), next(k))
    out.append(f"{tag}z AS (SELECT doc_id, j AS id, v FROM {tag}l QUALIFY t = max(t) OVER (PARTITION BY doc_id))")
    return ", ".join(out)


def _seen(of: str, context: int) -> str:
    """The last places of of(doc_id, p, id), numbered from 0."""
    return f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS t, id FROM (SELECT * FROM {of} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p DESC) <= {context})"


def oracle_sql() -> dict[str, str]:
    coded = f"{_DOCS}, coded0 AS (SELECT doc_id, unnest(range(length(text))) AS p, unicode(unnest(string_split(text, ''))) % {SMALL.vocab} AS id FROM docs WHERE text <> '')"
    n = f"(length(t) - {CONTEXT})"
    window = f"substring(t, (start + 1)::BIGINT, {CONTEXT}) AS x, substring(t, (start + 2)::BIGINT, {CONTEXT}) AS y"
    greedy = coded
    for k in range(STEPS):
        greedy += f", seen{k} AS ({_seen(f'coded{k}', SMALL.context)}), {_forward(SMALL, f'g{k}_', f'seen{k}')}, new{k} AS (SELECT doc_id, arg_min(id, (-round(v, 9), id)) AS id FROM g{k}_z GROUP BY doc_id)"
        greedy += f", coded{k + 1} AS (SELECT * FROM coded{k} UNION ALL SELECT n.doc_id, (SELECT max(p) FROM coded{k} c WHERE c.doc_id = n.doc_id) + 1, n.id FROM new{k} n)"
    at = "start + CASE WHEN split = 'val' THEN train ELSE 0 END"
    logits = lambda shape: f"WITH {coded}, seen AS ({_seen('coded0', shape.context)}), {_forward(shape, 'm_', 'seen')} SELECT doc_id, id, round(v, 6) AS logit FROM m_z"
    head = float(rule_weights(SMALL)["head"].sum())
    return {
        "char_windows": f"""WITH {_CORPUS}, {_words(8 * BATCH * BATCHES)}, drawn AS (SELECT i, w >> (32 - {_bits(n)}) AS start, t FROM words, c WHERE (w >> (32 - {_bits(n)})) < {n}),
            kept AS (SELECT row_number() OVER (ORDER BY i) - 1 AS k, start, t FROM drawn) SELECT (k // {BATCH})::INT AS batch, (k % {BATCH})::INT AS row, start, {window} FROM kept WHERE k < {BATCH * BATCHES}""",
        "first_window": f"WITH {_CORPUS} SELECT 0::BIGINT AS start, substring(t, 1, {CONTEXT}) AS x, substring(t, 2, {CONTEXT}) AS y FROM c",
        "batch_plan": f"WITH RECURSIVE {_CORPUS}, {_plan_sql()} SELECT run, step, split, batch, row, start FROM plan",
        "training_batches": f"""WITH RECURSIVE {_CHARS}, c AS (SELECT string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS t FROM docs), {_plan_sql()}, placed AS (SELECT run, step, split, batch, row, {at} AS start FROM plan),
            w AS (SELECT p.*, {window} FROM placed p, c), f AS (SELECT run, step, split, batch, string_agg(v.id::VARCHAR, ' ' ORDER BY o) AS first_ids FROM (SELECT run, step, split, batch, unnest(string_split(x, '')) AS ch, unnest(range(length(x))) AS o FROM w WHERE row = 0) JOIN vocab v USING (ch) GROUP BY ALL)
            SELECT run, step, split, batch, count(*)::INT AS n_rows, string_agg(x, '|' ORDER BY row) AS x, string_agg(y, '|' ORDER BY row) AS y, any_value(first_ids) AS first_ids FROM w JOIN f USING (run, step, split, batch) GROUP BY run, step, split, batch""",
        "rejections_ranked": f"WITH {_TANG_CLASSES}, r AS (SELECT reason, count(*) AS records FROM classified WHERE reason <> 'passed' GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY records DESC, reason) - 1 AS pos FROM r",
        "passed_by_count_ordered": f"WITH {_TANG_CLASSES}, r AS (SELECT num_sublines, count(*) AS records FROM classified WHERE reason = 'passed' GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY num_sublines) - 1 AS pos FROM r",
        "duplicates_ranked": "SELECT *, row_number() OVER (ORDER BY count DESC, num) - 1 AS pos FROM (SELECT num, count(*) AS count FROM (SELECT bing AS num FROM ci_rank UNION ALL SELECT bing_en FROM ci_rank) WHERE num > 10000 GROUP BY num HAVING count(*) > 1)",
        "metric_steps_ordered": "SELECT run, step, row_number() OVER (ORDER BY run, step) - 1 AS pos FROM (SELECT DISTINCT run, step FROM metric_log)",
        "model_logits": logits(SMALL),
        "prototype_logits": logits(PROTOTYPE),
        "greedy_ids": f"WITH {greedy} SELECT doc_id, (count(*) - {STEPS})::INT AS n_prompt, string_agg(id::VARCHAR, ' ' ORDER BY p) FILTER (WHERE p >= n) AS new_ids FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) - {STEPS} AS n FROM coded{STEPS}) GROUP BY doc_id",
        "quoted_prompts": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{shown}')" for i, shown in enumerate(repr(x).replace("'", "''") for x in PROMPTS)) + ") v(n, shown)",
        "kept_model": f"WITH {_CHARS} SELECT ch, id, {SMALL.width}::INT AS width, {SMALL.layers}::INT AS layers, {len(rule_weights(SMALL))}::INT AS matrices, {head}::DOUBLE AS head_sum FROM vocab",
    }
