"""Choosing the next token from logits, as array expressions; identifiers count from 0."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def argmax(logits: Column) -> Column:
    """The most likely identifier, the least one of several; null for an empty or null list."""
    return F.when(F.size(logits) > 0, (F.array_position(logits, F.array_max(logits)) - 1).cast("int"))


def scaled(logits: Column, temperature: float) -> Column:
    if temperature <= 0:
        raise ValueError("the temperature must be positive")
    return F.transform(logits, lambda v: v.cast("double") / F.lit(float(temperature)))


def top_k(logits: Column, k: int | None) -> Column:
    """All but the k greatest logits become -inf (ties: the lesser identifiers stay); None or k <= 0 keeps all.

    A k above the number of logits is an error.
    """
    if k is None or k <= 0:
        return logits
    low = F.lit(float("-inf"))

    def chosen(x: Column) -> Column:
        ranked = F.array_sort(F.transform(x, lambda v, i: F.struct((-v).alias("v"), i.alias("i"))))
        kept = F.transform(F.slice(ranked, 1, k), lambda s: s["i"])
        kept = F.when(F.size(x) < k, F.raise_error(F.lit("k is greater than the number of logits")).cast("array<int>")).otherwise(kept)
        return let(kept, lambda ids: F.transform(x, lambda v, i: F.when(F.array_contains(ids, i), v.cast("double")).otherwise(low)))

    return let(logits, chosen)


def softmax(logits: Column) -> Column:
    """Shares of the exponentials, the greatest logit taken off first."""

    def exponentials(x: Column) -> Column:
        return let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))

    def shares(e: Column) -> Column:
        return let(F.aggregate(e, F.lit(0.0), lambda a, v: a + v), lambda total: F.transform(e, lambda v: v / total))

    return let(logits, lambda x: let(exponentials(x), shares))


def draw(probabilities: Column, uniform: Column) -> Column:
    """Multinomial draw by a number in [0, 1): the first identifier whose cumulative probability exceeds it."""
    start = F.struct(F.lit(0.0).alias("c"), F.lit(-1).alias("at"), F.lit(0).alias("i"), F.lit(-1).alias("last"))

    def step(a, p):
        c = a["c"] + p
        at = F.when((a["at"] < 0) & (c > uniform), a["i"]).otherwise(a["at"])
        return F.struct(c.alias("c"), at.alias("at"), (a["i"] + 1).alias("i"), F.when(p > 0, a["i"]).otherwise(a["last"]).alias("last"))

    return F.aggregate(probabilities, start, step, lambda a: F.when(a["at"] >= 0, a["at"]).otherwise(a["last"]))


#: Settings that are compared: name, temperature, k; a null temperature is greedy.
SETTINGS = (("greedy", None, None), ("t08_k20", 0.8, 20), ("t10_k50", 1.0, 50))


def compare_settings(df: DataFrame, logits: str, settings: Sequence[tuple[str, float | None, int | None]] = SETTINGS) -> DataFrame:
    """One row for each row and setting: setting, choices (identifiers that may be drawn), best_prob (probability of the likeliest)."""
    out = None
    x = F.transform(F.col(logits), lambda v: v.cast("double"))
    for name, temperature, k in settings:
        if temperature is None:
            part = df.withColumns({"setting": F.lit(name), "choices": F.lit(1), "best_prob": F.lit(1.0)})
        else:
            p = softmax(top_k(scaled(x, temperature), k))
            part = df.withColumn("_p", p).withColumns({"setting": F.lit(name), "choices": F.size(F.filter("_p", lambda v: v > 0)), "best_prob": F.array_max("_p")}).drop("_p")
        out = part if out is None else out.unionByName(part)
    return out


def report(title: Column, path: Column, step: Column, prompt: Column, n: Column, text: Column, temperature: Column, k: Column) -> Column:
    """Report on a generated text; lines without a value (temperature, k) are left out."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c.cast("string"))
    head = F.concat(F.lit("=== "), title, F.lit(" ==="))
    return F.concat_ws("\n", head, line("Checkpoint", path), line("Checkpoint step", step), line("Prompt", T.quoted(prompt)), line("Max new chars", n), line("Temperature", temperature), line("Top-k", k), F.lit(""), F.lit("=== Generated text ==="), text, F.lit(""))
