"""Winnowing fingerprints in DataFrame operations only, and the order of documents by id that compares neighbours.

The characters of a text, each lower-cased by itself, give a polynomial rolling hash (Karp-Rabin, modulo a prime) for every
K characters in a row; of every WINDOW hashes in a row the least is chosen, the rightmost of equal ones, with its position.
Two texts that share K + WINDOW - 1 characters in a row are thus sure to share a chosen hash, and the positions say where.

A hash rolls by doubling: that of 2n characters is that of the first n times BASE^n plus that of the next n, for all places
at once. The values are those that rolling on by one character gives, and no step depends on the one before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewright.llm.common import let

K, WINDOW = 16, 16
BASE, PRIME = 1_103_515_245, (1 << 31) - 1
POSITION = (1 << 31) - 1  # the low bits of a chosen value hold POSITION - position, the high 31 bits the hash
PIECE = 1 << 15  # windows made at once: bounds the memory of a long text
LONGS = "array<long>"


def chain(value: Column, steps: list[Callable[[Column], Column]]) -> Column:
    """The steps one after the other, each value computed once."""
    return steps[-1](value) if len(steps) == 1 else let(steps[0](value), lambda v: chain(v, steps[1:]))


def codes(text: Column) -> Column:
    """The code points of the characters, each lower-cased by itself. That is the text lower-cased at once but where it has one of
    two letters: the sigma, whose lower case depends on its neighbours, and the dotted I, whose lower case is two characters."""
    of = lambda text, lowered: F.transform(F.split(text, ""), lambda c: F.ascii(lowered(c)).cast("long"))
    alone = F.contains(text, F.lit("\u03a3")) | F.contains(text, F.lit("\u0130"))
    return F.when(alone, of(text, F.lower)).otherwise(of(F.lower(text), lambda c: c))


def doubled(n: int, of: Callable[[Column, Column], Column] = lambda h, i: h) -> Callable[[Column], Column]:
    """From the hashes of n characters of() those of 2n and their places (from 0). The array keeps its length: null where the
    characters end before, with as many nulls behind as there were."""
    up = pow(BASE, n, PRIME)
    return lambda h: F.transform(h, lambda x, i: of((x * up + F.get(h, i + n)) % PRIME, i))


def least_of(n: int, most: int) -> Callable[[Column], Column]:
    """From the least of each n values in a row those of most (at most 2 n). The array keeps its length: fewer at its end."""
    return lambda g: F.transform(g, lambda x, i: F.least(x, F.get(g, i + (most - n))))


def minima(text: Column, before: Column, k: int, window: int) -> Column:
    """The distinct least packed hashes of the whole windows of a text of k + window - 1 characters or more that stands behind `before` others."""
    if k & (k - 1):
        raise ValueError("k must be a power of two")
    return let(F.lit(POSITION) - before, lambda first: minima_from(text, first, k, window))


def minima_from(text: Column, first: Column, k: int, window: int) -> Column:
    """minima(), with what the first character's hash holds as its position."""
    packed = lambda h, i: h * (1 << 31) + (first - i)
    steps, n = [codes], 1
    if k == 1:
        steps.append(lambda h: F.transform(h, packed))
    while n < k:
        steps.append(doubled(n, packed) if 2 * n == k else doubled(n))
        n *= 2
    n = 1
    while n < window:
        steps.append(least_of(n, min(2 * n, window)))
        n = min(2 * n, window)
    # the windows that the end cuts stand behind the whole ones; positions never fall, so what only they chose stands behind too
    whole = lambda g: let(F.get(g, F.size(g) - (k + window - 1)), lambda last: F.filter(F.array_distinct(g), lambda c: position(c) <= position(last)))
    return chain(text, [*steps, whole])


def windows(text: Column, before: Column, k: int, window: int) -> Column:
    """The chosen values of all whole windows, PIECE windows at a time; none where the text is too short for one."""
    reach = k + window - 2
    starts = F.sequence(F.lit(1), F.length(text) - reach, F.lit(PIECE))
    piece = lambda at: minima(F.substring(text, at, F.lit(PIECE + reach)), before + at - 1, k, window)
    return F.when(F.length(text) > reach, F.array_distinct(F.flatten(F.transform(starts, piece)))).otherwise(F.array().cast(LONGS))


def short(text: Column, k: int) -> Column:
    """The chosen value of a text with no whole window: the least of its hashes; that of all of it where it has under k characters."""
    roll = lambda of: F.aggregate(of, F.lit(0).cast("long"), lambda a, x: (a * BASE + x) % PRIME)
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - (k - 1), F.lit(1))), lambda i: roll(F.slice(c, i, k)) * (1 << 31) + (POSITION - i + 1))
    return F.when(F.length(text) > 0, F.array(let(codes(text), lambda c: F.array_min(grams(c))))).otherwise(F.array().cast(LONGS))


def chosen(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """array<long>: the chosen hashes with their positions, in order of position; empty for the empty text.

    Fewer than k characters are one gram, fewer than `window` grams one window.
    """
    return F.when(F.length(text) > k + window - 2, windows(text, F.lit(0), k, window)).otherwise(short(text, k))


def first_of(own: Column, window_at: Column, window: int) -> Column:
    """Of a fingerprint the values that its windows up to the one at window_at (from 0) chose: positions never fall from window to
    window, so those up to the value that this one chose, the least in its reach."""
    at_last = let(window_at, lambda at: F.array_min(F.filter(own, lambda c: position(c).between(at, at + window - 1))))
    return let(position(at_last), lambda end: F.filter(own, lambda c: position(c) <= end))


def chosen_across(own: Column, keep: Column, text: Column, next_own: Column, k: int = K, window: int = WINDOW) -> Column:
    """chosen() of a text that is the first `keep` characters of a text with the fingerprint `own`, then the start of one with the
    fingerprint `next_own`.

    Windows within either part choose what they chose before, so only those over the seam are made anew.
    """
    reach = k + window - 2
    seam = windows(F.substring(text, keep - reach + 1, F.lit(2 * reach)), keep - reach, k, window)
    more = F.length(text) - keep - reach  # the windows that lie within the second part
    after = let(more, lambda n: F.when(n > 0, F.transform(first_of(next_own, n - 1, window), lambda c: c - keep)).otherwise(F.array().cast(LONGS)))
    return F.when(keep > reach, F.array_distinct(F.concat(first_of(own, keep - reach - 1, window), seam, after))).otherwise(chosen(text, k, window))


def position(chosen_: Column) -> Column:
    return F.lit(POSITION) - chosen_.bitwiseAND(F.lit(POSITION))


def hashes_of(chosen_: Column) -> Column:
    return F.transform(chosen_, lambda c: F.shiftright(c, 31))


def printed(chosen_: Column) -> Column:
    """The chosen values, blank-separated: hash x 2^31 + POSITION - position."""
    return F.array_join(chosen_.cast("array<string>"), " ")


def likeness(a: Column, b: Column) -> Column:
    """Share of common among all hashes of two fingerprints; 1 for two empty ones."""
    together = F.size(F.array_union(a, b))
    return F.when(together == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / together)


def in_order(docs: DataFrame, per_bucket: int = 1024, most_cuts: int = 1000) -> DataFrame:
    """docs with _seg, _sub (a bucket of neighbouring ids), _tie and _guest; each bucket also has, as its last row (_guest),
    the first row of the next bucket, after the last bucket the first. Ordered by _guest, doc_id (nulls last) and _tie
    within its bucket, every row that isn't a guest has its successor behind it.

    Segments lie between quantiles of doc_id, and are cut into equal ranges of ids where there are more rows than
    most_cuts x per_bucket; a million buckets at most, so the table of their first rows can be broadcast. Rows without an
    id, and those of an id that several quantiles fall on, are cut by ranges of _tie (a hash of the text) instead.
    """
    n, with_id = docs.agg(F.count("*"), F.count("doc_id")).first()
    cuts = max(1, min(most_cuts, n // per_bucket))
    subs = max(1, min(1000, -(-n // (cuts * per_bucket))))
    at = docs.agg(F.percentile_approx("doc_id", [i / cuts for i in range(cuts + 1)], 10_000)).first()[0] or [0, 0]
    points = F.array(*[F.lit(x) for x in at[:-1]])
    rows = docs.withColumn("_tie", F.xxhash64("text"))
    rows = rows.withColumn("_seg", F.when(F.col("doc_id").isNull(), cuts + 1).otherwise(F.size(F.filter(points, lambda p: p <= F.col("doc_id")))).cast("int"))
    low, high = (F.element_at(F.array(*[F.lit(float(x)) for x in [at[0], *at]]), F.least(F.col("_seg") + i, F.lit(cuts + 2))) for i in (1, 2))
    within = F.greatest(F.lit(0), F.least(F.lit(subs - 1), F.floor((F.col("doc_id").cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * subs)))
    tie = lambda many: F.floor((F.col("_tie") / float(1 << 63) + 1) / 2 * many * 0.999999)
    share = lambda rows: max(1, min(100_000, -(-rows // per_bucket)))
    repeated = {x: share(at.count(x) * -(-n // cuts)) for x in at if at.count(x) > 1}
    own_id = F.create_map(*[F.lit(y) for x in repeated.items() for y in x])[F.col("doc_id")] if repeated else F.lit(None).cast("int")
    rows = rows.withColumn("_sub", F.when(F.col("doc_id").isNull(), tie(share(n - with_id))).when(own_id.isNotNull(), tie(own_id)).otherwise(within + max(repeated.values(), default=0)).cast("int"))
    heads = rows.groupBy("_seg", "_sub").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_tie").alias("tie"))).alias("head"))
    in_seg = Window.partitionBy("_seg").orderBy("_sub")
    heads = heads.select("_seg", "_sub", "head", F.lag(F.struct("_seg", "_sub")).over(in_seg).alias("before"))
    lasts = heads.groupBy("_seg").agg(F.max("_sub").alias("_sub"))
    all_segs = Window.partitionBy(F.lit(0)).orderBy("_seg")  # most_cuts + 2 rows at most
    last = F.struct("_seg", "_sub")
    ends = lasts.select(F.col("_seg").alias("_of"), F.coalesce(F.lag(last).over(all_segs), F.last(last).over(all_segs.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("end"))
    guests = heads.join(F.broadcast(ends), F.col("_seg") == F.col("_of")).select(F.col("head.id").alias("_id"), F.col("head.tie").alias("_head"), F.coalesce("before", "end").alias("_into"))
    rows = rows.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_tie") == F.col("_head")), "left")
    own = F.struct("_seg", "_sub", F.lit(False).alias("_guest"))
    guest = F.struct(F.col("_into._seg").alias("_seg"), F.col("_into._sub").alias("_sub"), F.lit(True).alias("_guest"))
    places = F.explode(F.when(F.col("_into").isNull(), F.array(own)).otherwise(F.array(own, guest)))
    return rows.select(*docs.columns, "_tie", places.alias("_place")).select(*docs.columns, "_tie", "_place._seg", "_place._sub", "_place._guest")


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, text and chosen (array of hash with position), a row per row; null texts are empty, other columns left out."""
    return docs.select("doc_id", "text", chosen(F.coalesce("text", F.lit("")), k, window).alias("chosen"))


def edited_and_next(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Per row: fingerprints of the text and of its edit, whose last quarter is the start of the next document's text, and
    the likeness of the first to the edit's and to the next document's.

    The next document is the one with the next doc_id (rows of the same id by a hash of the text, null ids last, then the
    first again). A null text is empty; two empty fingerprints are alike (1). Repeated rows get the same texts to compare
    with but for the last of them, whose next is another. Other columns than doc_id and text are left out, an empty table
    stays empty. Texts are read whole, PIECE windows at a time; they are shuffled once. Rows equal in id and text share a
    bucket.
    """
    rows = in_order(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    order = Window.partitionBy("_seg", "_sub").orderBy("_guest", F.col("doc_id").asc_nulls_last(), "_tie")
    rows = rows.withColumn("next_text", F.lead("text").over(order))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    rows = rows.select("doc_id", "_tie", "_seg", "_sub", "_guest", n.alias("n"), cut.alias("cut"), edited.alias("edited"), chosen(F.col("text"), k, window).alias("chosen"))
    rows = rows.withColumn("next_chosen", F.lead("chosen").over(order)).filter(~F.col("_guest"))
    rows = rows.withColumn("chosen_edited", chosen_across(F.col("chosen"), F.col("n") - F.col("cut"), F.col("edited"), F.col("next_chosen"), k, window))
    hashes = hashes_of(F.col("chosen"))
    return rows.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "chosen", "chosen_edited",
        likeness(hashes, hashes_of(F.col("chosen_edited"))).alias("near_edited"), likeness(hashes, hashes_of(F.col("next_chosen"))).alias("near_next"),
    )


def digest(compared: DataFrame) -> DataFrame:
    return compared.select("doc_id", "n_chars", "edited_sha256", printed(F.col("chosen")).alias("fingerprint"), printed(F.col("chosen_edited")).alias("edited_fingerprint"), "near_edited", "near_next")
