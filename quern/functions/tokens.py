"""Token-sequence functions over ARRAY<BIGINT> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let as _let

IGNORE = -100
#: Columns that hold a value for each token.
SEQUENCES = ("input_ids", "labels", "attention_mask", "position_ids")


def positions(ids: Column, token: int) -> Column:
    """0-based places of a token."""
    return F.filter(F.transform(ids, lambda x, i: F.when(x == token, i)), lambda i: i.isNotNull())


def _pieces(xs: Column, starts: Column, ends, filled) -> Column:
    """``xs`` with the stretch from starts[k] up to ends(k) replaced by the array ``filled(k)``. Stretches are in order and
    apart, so every value is copied once, however many there are; the rest stays as it is."""
    zero = F.lit(0)
    before = lambda k: F.when(k == 0, zero).otherwise(ends(k - 1))
    part = lambda s, k: F.concat(F.slice(xs, before(k) + 1, F.greatest(s - before(k), zero)), filled(k))
    last = F.when(F.size(starts) == 0, zero).otherwise(ends(F.size(starts) - 1))
    return F.concat(F.flatten(F.transform(starts, part)), F.slice(xs, last + 1, F.greatest(F.size(xs) - last, zero)))


def prefix_sums(counts: Column) -> Column:
    """For each count the sum of those before it, without a sum for each: the counts are laid out as runs, one longer than
    they say so that none is empty, and the places where runs begin are read off."""
    laid = F.flatten(F.transform(counts, lambda n, k: F.array_repeat(k, n.cast("int") + 1)))
    begins = _let(laid, lambda owner: F.filter(F.transform(owner, lambda k, i: F.when((i == 0) | (F.get(owner, i - 1) != k), i)), lambda i: i.isNotNull()))
    return F.transform(begins, lambda i, k: (i - k).cast("long"))


def expand_attachments(ids: Column, counts: Column, token: int) -> Column:
    """The k-th attachment token becomes counts[k] copies of itself; without counts the ids stay."""

    def grow(at: Column) -> Column:
        copies = lambda k: F.array_repeat(F.lit(token).cast("long"), F.get(counts, k).cast("int"))
        grown = _pieces(ids, at, lambda k: F.get(at, k) + 1, copies)
        return F.when(F.size(at) == F.size(counts), grown).otherwise(F.raise_error(F.lit("attachment tokens and attachments differ in number")))

    return F.when(F.size(counts) == 0, ids).otherwise(_let(positions(ids, token), grow))


def token_ranges(ids: Column, counts: Column, token: int) -> Column:
    """(start, end) of each attachment's run of tokens in expanded ids, end excluded."""

    def ranges(of: Column) -> Column:
        def one(n: Column, k: Column) -> Column:
            start = F.get(of["at"], F.get(of["skipped"], k).cast("int")).cast("long")
            return F.struct(start.alias("start"), (start + n).alias("end"))

        return F.transform(counts, one)

    return _let(F.struct(positions(ids, token).alias("at"), prefix_sums(counts).alias("skipped")), ranges)


def tag_positions(ids: Column, tag: list[int]) -> Column:
    """0-based places at which the tag's tokens stand in a row."""
    hit = lambda x, i: x == tag[0]
    if len(tag) > 1:
        whole = F.array(*(F.lit(t).cast("long") for t in tag))
        hit = lambda x, i: (x == tag[0]) & (F.slice(ids, i + 1, len(tag)) == whole)
    return F.filter(F.transform(ids, lambda x, i: F.when(hit(x, i), i)), lambda i: i.isNotNull())


def tag_spans(ids: Column, left: list[int], right: list[int]) -> Column:
    """(s, e) from each left tag to the end of the first right tag that starts there or later, in order; a span that isn't
    closed is an error.

    Both kinds of places are sorted together. The k-th left tag stands there at k plus the right tags before it, and that
    number is the place of its right tag among theirs; so no tag is searched for.
    """

    def close(of: Column) -> Column:
        shut = lambda n: F.coalesce(F.get(of["ends"], n), F.raise_error(F.lit("a tag isn't closed")).cast("int"))
        marks = F.array_sort(F.concat(F.transform(of["starts"], lambda s: 2 * s), F.transform(of["ends"], lambda e: 2 * e + 1)))
        lefts = _let(marks, lambda m: F.filter(F.transform(m, lambda x, j: F.when(x % 2 == 0, F.struct((x / 2).cast("int").alias("s"), j.alias("j")))), lambda p: p.isNotNull()))
        return F.transform(lefts, lambda p, k: F.struct(p["s"].alias("s"), (shut(p["j"] - k) + len(right)).alias("e")))

    return _let(F.struct(tag_positions(ids, left).alias("starts"), tag_positions(ids, right).alias("ends")), close)


def mask_between(labels: Column, ids: Column, left: list[int], right: list[int]) -> Column:
    """IGNORE over each span from a left tag to the end of the first right tag after it (see tag_spans). Ends never go
    back, so what a span adds to those before it lies behind them. ``labels`` may be masked ones: they are made once a row,
    not once a span."""

    def mask(of: Column, spans: Column) -> Column:
        end = lambda k: F.get(spans, k)["e"]
        begin = lambda p, k: F.when(k == 0, p["s"]).otherwise(F.greatest(p["s"], end(k - 1)))
        starts = F.transform(spans, begin)
        return _let(starts, lambda at: _pieces(of, at, end, lambda k: F.array_repeat(F.lit(IGNORE).cast("long"), F.greatest(end(k) - F.get(at, k), F.lit(0)))))

    return _let(labels, lambda of: _let(tag_spans(ids, left, right), lambda spans: mask(of, spans)))


def pad(ids: Column, length: Column, value: int, side: str = "right") -> Column:
    fill = F.array_repeat(F.lit(value).cast("long"), F.greatest(length - F.size(ids), F.lit(0)).cast("int"))
    return F.concat(ids, fill) if side == "right" else F.concat(fill, ids)


def truncate(ids: Column, n: int) -> Column:
    return F.slice(ids, 1, n)


def truncated(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` with every column of SEQUENCES that they have cut on the right to ``n`` values."""
    return rows.withColumns({c: truncate(F.col(c), n) for c in SEQUENCES if c in rows.columns})


def position_ids(mask: Column) -> Column:
    """Running count of ones less one, 0 where the mask is 0, for a mask of zeros and ones in any order."""
    zero = F.lit(0).cast("long")
    parts = lambda m: F.struct(positions(m, 1).alias("at"), F.transform(m, lambda x: zero).alias("zeros"))
    of = lambda p: _pieces(p["zeros"], p["at"], lambda k: F.get(p["at"], k) + 1, lambda k: F.array(k.cast("long")))
    return F.when(F.size(mask) == 0, mask.cast("array<bigint>")).otherwise(_let(_let(mask.cast("array<bigint>"), parts), of))


def range_positions(ranges: Column) -> Column:
    """All places of the ranges, in order."""
    return F.flatten(F.transform(ranges, lambda r: F.when(r["end"] > r["start"], F.sequence(r["start"], r["end"] - 1)).otherwise(F.array().cast("array<bigint>"))))
