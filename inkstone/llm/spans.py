"""Long exact spans shared between records: seed and extend.

Seed: of every body the minimisers (winnowed anchors) of its ANCHOR-grams are taken, over windows so
wide that any stretch of the threshold length contains an anchor, and equal stretches contain equal
anchors. Round an anchor that two records share, each stretch of the threshold length that covers it
is a seed, and is told one other record and place that holds the same stretch.

Extend: the seeds of a record that lie on one diagonal of another are walked, character by
character, to the left and to the right end of the match in both bodies, which gives a maximal
repeat. Every shared stretch lies in a maximal repeat with the record it was told of, so their union
is all that is shared.

No pairs of records are formed: a stretch is told one other holder however many there are (the one
before it in the order of the records, so nobody is everybody's partner), and a passage that a third
of all records share costs as much as any other text of the same length. Before each shuffle a block
of rows settles what it can by itself and sends one row for each hash that it holds more than once.
Behind it rows arrive in order of their hash and are settled batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import batch_of, code_points, gram_hashes, group_starts, mix, sliding, starts_of

#: Length of an anchor in characters.
ANCHOR = 8
_PROBE, _SETTLED = 0, 1
#: A place and, once it is settled, the place of another record that holds the same.
_SENT = "key long, check int, rec_id long, pos int, other long, other_pos int, state byte"
_FOUND = "rec_id long, pos int, other long, other_pos int"
_KINDS = {"key": pa.int64(), "check": pa.int32(), "rec_id": pa.int64(), "pos": pa.int32(), "other": pa.int64(), "other_pos": pa.int32(), "state": pa.int8()}


def bodies(df: DataFrame, least: int = 24) -> DataFrame:
    """rec_id, body: non-null elements joined by one line feed; bodies below the least length hold no shared span."""
    return (
        df.where("rec_id is not null and paragraphs is not null")
        .select("rec_id", F.concat_ws("\n", "paragraphs").alias("body"))
        .where(F.length("body") >= least)
    )


def _partners(key: np.ndarray, check: np.ndarray, rec: np.ndarray) -> np.ndarray:
    """For each row of a sorted block a row with the same hash and another record, -1 without one: the last of the record before, or the first of the one after."""
    n = len(key)
    group = group_starts(key, check)
    own = group_starts(key, check, rec)
    start = np.repeat(own, np.diff(np.append(own, n)))
    end = np.repeat(np.append(own[1:], n), np.diff(np.append(own, n)))
    first = np.repeat(group, np.diff(np.append(group, n)))
    last = np.repeat(np.append(group[1:], n), np.diff(np.append(group, n)))
    return np.where(start > first, start - 1, np.where(end < last, end, -1))


def _sent(key: np.ndarray, check: np.ndarray, rec: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """What a block sends: every place that it can't settle, every one that it could, and one probe for each hash among the latter."""
    order = np.lexsort((pos, rec, check, key))
    key, check, rec, pos = key[order], check[order], rec[order], pos[order]
    with_ = _partners(key, check, rec)
    has = with_ >= 0
    probe = ~has
    probe[group_starts(key, check)] = True
    anywhere = mix(key + pos.astype(np.uint64) * np.uint64(31) + rec.astype(np.uint64))  # settled places need no company
    both = lambda x, y: np.concatenate([x[probe], y[has]])
    columns = {"key": both(key, anywhere).view(np.int64), "check": both(check, check), "rec_id": both(rec, rec), "pos": both(pos, pos), "state": np.repeat(np.array([_PROBE, _SETTLED], np.int8), [probe.sum(), has.sum()])}
    told = np.concatenate([np.zeros(probe.sum(), bool), np.ones(has.sum(), bool)])
    columns["other"] = pa.array(np.concatenate([np.zeros(probe.sum(), np.int64), rec[with_[has]]]), pa.int64(), mask=~told)
    columns["other_pos"] = pa.array(np.concatenate([np.zeros(probe.sum(), np.int32), pos[with_[has]]]), pa.int32(), mask=~told)
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[n], pa.Array) else pa.array(c, k) for n, k in _KINDS.items()], names=list(_KINDS))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places whose hash another record holds as well, with one such place. Rows arrive in the order of hash and record.

    Of the rows of a hash that goes on in the next batch only those of its first record wait, and
    only while no other record has come; else one row stays behind to tell the rest.
    """
    waiting = None
    for b in batches:
        settled = b.column("state").to_numpy() == _SETTLED
        if settled.any():
            yield b.filter(pa.array(settled)).select(["rec_id", "pos", "other", "other_pos"])
        rows = np.flatnonzero(~settled)
        now = [b.column(c).to_numpy()[rows] for c in ("key", "check", "rec_id", "pos")] + [np.zeros(len(rows), bool)]
        if not len(rows):
            continue
        key, check, rec, pos, told = map(np.concatenate, zip(waiting, now, strict=True)) if waiting else now
        with_ = _partners(key, check, rec)
        out = np.flatnonzero((with_ >= 0) & ~told)
        yield batch_of({"rec_id": (rec[out], pa.int64()), "pos": (pos[out], pa.int32()), "other": (rec[with_[out]], pa.int64()), "other_pos": (pos[with_[out]], pa.int32())})
        at = int(group_starts(key, check)[-1])
        stay = np.arange(at, len(key)) if with_[-1] < 0 else np.array([with_[-1], len(key) - 1])
        waiting = [x[stay] for x in (key, check, rec, pos)] + [with_[stay] >= 0]


def _anchors(least: int):
    width = least - ANCHOR + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rec = b.column("rec_id").to_numpy()
            points, lengths = code_points(b.column("body").to_pylist())
            if len(points) < least:
                continue
            row = np.repeat(np.arange(len(rec), dtype=np.int32), lengths)
            h = gram_hashes(points, ANCHOR, 1)
            h[row[: len(h)] != row[ANCHOR - 1 :]] = np.iinfo(np.uint64).max
            low = sliding(np.minimum, h, width)
            low[row[: len(low)] != row[least - 1 :]] = 0
            pad = np.zeros(width - 1, np.uint64)
            chosen = np.flatnonzero((sliding(np.maximum, np.concatenate([pad, low, pad]), width) == h) & (h != np.iinfo(np.uint64).max))
            at = row[chosen]
            yield _sent(h[chosen], np.zeros(len(chosen), np.int32), rec[at], (chosen - starts_of(lengths)[at]).astype(np.int32))

    return run


def _stretches(least: int):
    reach = least - ANCHOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rec = b.column("rec_id").to_numpy()
            points, lengths = code_points(b.column("body").to_pylist())
            begin = starts_of(lengths)
            lists = b.column("anchors")
            at = np.repeat(np.arange(len(rec)), np.diff(lists.offsets.to_numpy()))
            p = lists.flatten().to_numpy().astype(np.int64)
            cover = np.zeros(len(points) + 1, np.int64)
            np.add.at(cover, begin[at] + np.maximum(p - reach, 0), 1)
            np.add.at(cover, begin[at] + np.minimum(p, lengths[at] - least) + 1, -1)
            start = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
            row = np.repeat(np.arange(len(rec), dtype=np.int32), lengths)[start]
            key = gram_hashes(points, least, 2)[start]
            check = (gram_hashes(points, least, 3)[start] >> np.uint64(33)).astype(np.int32)
            yield _sent(key, check, rec[row], (start - begin[row]).astype(np.int32))

    return run


def _diagonals(least: int):
    """Seeds of each record, joined along the diagonals of its partners: rec_id, body, other, start, other_start, chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("seeds")
            at = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            pos, other, other_pos = (flat.field(i).to_numpy().astype(np.int64) for i in range(3))
            order = np.lexsort((pos, pos - other_pos, other, at))
            at, pos, other, other_pos = at[order], pos[order], other[order], other_pos[order]
            new = np.ones(len(pos), bool)
            new[1:] = (at[1:] != at[:-1]) | (other[1:] != other[:-1]) | (np.diff(pos - other_pos) != 0) | (pos[1:] > pos[:-1] + least)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(pos)) - 1
            own = pa.array(at[first])
            yield pa.RecordBatch.from_arrays(
                [b.column("rec_id").take(own), b.column("body").take(own), pa.array(other[first]), pa.array(pos[first]), pa.array(other_pos[first]), pa.array(pos[last] + least - pos[first])],
                names=["rec_id", "body", "other", "start", "other_start", "chars"],
            )

    return run


def extended(body: np.ndarray, other: np.ndarray, start: int, other_start: int, chars: int) -> list[tuple[int, int]]:
    """(start, chars) of the maximal matches of two texts on the diagonal of a seed that touch it."""
    low, high = -min(start, other_start), min(len(body) - start, len(other) - other_start)
    differ = np.flatnonzero(body[start + low : start + high] != other[other_start + low : other_start + high]) + low
    inside = differ[(differ >= 0) & (differ < chars)]
    before, after = differ[differ < 0], differ[differ >= chars]
    edges = [int(before[-1]) + 1 if len(before) else low]
    for d in inside.tolist():
        edges += [d, d + 1]
    edges.append(int(after[0]) if len(after) else high)
    return [(start + i, j - i) for i, j in zip(edges[::2], edges[1::2], strict=True)]


def _extended(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            start, other_start, chars = (b.column(c).to_numpy() for c in ("start", "other_start", "chars"))
            points = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in b.column("body").to_pylist()]
            others = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in b.column("other_body").to_pylist()]
            for i, (x, y) in enumerate(zip(points, others, strict=True)):
                out += [(i, s, n, s - int(start[i]) + int(other_start[i])) for s, n in extended(x, y, int(start[i]), int(other_start[i]), int(chars[i])) if n >= least]
            i, s, n, o = (np.array(c, np.int64) for c in (zip(*out, strict=True) if out else ([], [], [], [])))
            yield pa.RecordBatch.from_arrays([b.column("rec_id").take(pa.array(i)), pa.array(s), pa.array(n), b.column("other").take(pa.array(i)), pa.array(o)], names=["rec_id", "span_start", "span_chars", "other_id", "other_start"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union of each record's repeats."""
    for b in batches:
        lists = b.column("spans")
        at = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
        flat = lists.flatten()
        start, chars = (flat.field(i).to_numpy() for i in range(2))
        order = np.lexsort((start, at))
        at, start, end = at[order], start[order], (start + chars)[order]
        high = int(end.max(initial=0)) + 1
        reach = np.maximum.accumulate(end + at * high) - at * high  # the farthest end so far within the record
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (start[1:] > reach[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        yield pa.RecordBatch.from_arrays([b.column("rec_id").take(pa.array(at[first])), pa.array(start[first], pa.int64()), pa.array(reach[last] - start[first], pa.int64())], names=["rec_id", "span_start", "span_chars"])


def repeats(df: DataFrame, least: int = 24) -> DataFrame:
    """rec_id, span_start, span_chars, other_id, other_start: maximal repeats of at least `least` characters between two records.

    Together they cover everything that records share. A passage that many records hold is reported
    for each of them with one or a few other holders, not with all. See shared_spans for the rows.
    """
    if least < ANCHOR + 1:
        raise ValueError(f"least must be above {ANCHOR}")
    text = bodies(df, least).dropDuplicates(["rec_id"])
    met = lambda sent: sent.repartition("key").sortWithinPartitions("key", "check", "rec_id", "pos").mapInArrow(_met, _FOUND)
    seeds = met(text.mapInArrow(_anchors(least), _SENT)).groupBy("rec_id").agg(F.collect_set("pos").alias("anchors"))
    # In order, so that a task that runs again forms the same blocks and sends the same rows.
    found = met(text.join(seeds, "rec_id").select("rec_id", "body", "anchors").sortWithinPartitions("rec_id").mapInArrow(_stretches(least), _SENT))
    each = found.groupBy("rec_id").agg(F.collect_list(F.struct("pos", "other", "other_pos")).alias("seeds"))  # as many as the record has characters
    along = text.join(each, "rec_id").select("rec_id", "body", "seeds").mapInArrow(_diagonals(least), "rec_id long, body string, other long, start long, other_start long, chars long")
    other = text.select(F.col("rec_id").alias("other"), F.col("body").alias("other_body"))
    return along.join(other, "other").select(*along.columns, "other_body").mapInArrow(_extended(least), "rec_id long, span_start long, span_chars long, other_id long, other_start long")


def shared_spans(df: DataFrame, least: int = 24) -> DataFrame:
    """rec_id, span_start, span_chars of the longest runs of characters that other records hold too.

    df has rec_id and paragraphs (array of strings); further columns are ignored. A character is
    shared if it lies in a stretch of at least `least` characters that the body of another rec_id
    holds. Null rec_ids and null paragraphs have no spans, nor have bodies shorter than `least`;
    null elements are left out, empty ones count as empty lines. Rows that repeat a record don't
    make it shared, and no row is returned twice. An empty table gives an empty result.
    """
    spans = repeats(df, least).groupBy("rec_id").agg(F.collect_set(F.struct("span_start", "span_chars")).alias("spans"))
    return spans.mapInArrow(_runs, "rec_id long, span_start long, span_chars long")


def shared_share(df: DataFrame, least: int = 24) -> DataFrame:
    """rec_id, body_chars, shared_chars, shared_share of every record once; 0 where nothing is shared or the body is empty."""
    sizes = df.where("rec_id is not null").groupBy("rec_id").agg(F.max(F.coalesce(F.length(F.concat_ws("\n", "paragraphs")), F.lit(0))).cast("long").alias("body_chars"))
    shared = shared_spans(df, least).groupBy("rec_id").agg(F.sum("span_chars").alias("shared_chars"))
    joined = sizes.join(shared, "rec_id", "left")
    n = F.coalesce("shared_chars", F.lit(0).cast("long"))
    return joined.select("rec_id", "body_chars", n.alias("shared_chars"), F.coalesce(F.try_divide(n, F.col("body_chars")), F.lit(0.0)).alias("shared_share"))
