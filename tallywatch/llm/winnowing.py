"""Benchmark decontamination by winnowing, in DataFrame expressions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.joins import spread_join
from .graph import saved

#: What lies between words: ASCII characters other than lower-case letters and digits.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NO_SPANS, _NO_ITEMS = "array<struct<begin:int,end:int>>", "array<bigint>"
_LEAST_BITS, _MOST_BITS, _BLOCK_BITS = 1 << 16, 1 << 28, 8 * 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case; none of a null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), APART), "")


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Rows with one more column. It is computed once for each row: expressions on it cannot pull it into their own loops."""
    return rows.withColumn(name, F.explode(F.array(value)))


def _count_up(first: Column, last: Column) -> Column:
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def fingerprints(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """Rows (with their ``words``) and ``prints``: what winnowing keeps of them.

    Each window of ``window`` words keeps the least hash of the runs of ``gram``
    words in it. Neighbouring windows that keep the same hash are one entry
    (size, hash, first window, last window). Two texts that share ``window``
    words in a row keep the same hash for it, wherever it stands.
    """
    gram = min(gram, window)
    n_grams, inner = F.size("words") - (gram - 1), window - gram + 1
    hashed = F.transform(
        _count_up(F.lit(0), n_grams - 1), lambda i: F.xxhash64(F.lit(window), *[F.get("words", i + k) for k in range(gram)])
    )
    rows = _once(rows, "_grams", hashed)
    n_windows = F.size("_grams") - (inner - 1)
    least = F.transform(
        _count_up(F.lit(0), n_windows - 1),
        lambda i: F.least(*[F.get("_grams", i + k) for k in range(inner)]) if inner > 1 else F.get("_grams", i),
    )
    rows = _once(rows, "_least", least)
    firsts = F.filter(_count_up(F.lit(0), F.size("_least") - 1), lambda i: (i == 0) | (F.get("_least", i) != F.get("_least", i - 1)))
    rows = _once(rows, "_firsts", firsts)
    prints = F.transform("_firsts", lambda at, place: F.struct(
        F.lit(window).alias("size"), F.get("_least", at).alias("hash"), at.alias("first"),
        (F.coalesce(F.get("_firsts", place + 1), F.size("_least")) - 1).alias("last"),
    ))
    return rows.withColumn("prints", prints).drop("_grams", "_least", "_firsts")


def _all_prints(rows: DataFrame, sizes: list[int], gram: int) -> DataFrame:
    """The same for several window sizes, in one column."""
    names = []
    for size in sizes:
        names.append(f"_prints{size}")
        rows = fingerprints(rows, size, gram).withColumnRenamed("prints", names[-1])
    return rows.withColumn("prints", F.concat(*names)).drop(*names)


def _run(at: Column, size: Column) -> Column:
    """The words of a window, with spaces between: words hold no space, so equal runs are equal texts."""
    return F.array_join(F.slice("words", at + 1, size), " ")


def item_words(items: DataFrame) -> DataFrame:
    """item_id and words of the items that have both."""
    rows = items.where(F.col("item_id").isNotNull()).select("item_id", words_of(F.col("text")).alias("_w"))
    return _once(rows, "words", F.col("_w")).drop("_w").where(F.size("words") > 0)


def item_windows(items: DataFrame, sizes: list[int], window: int, gram: int) -> DataFrame:
    """item_id, size, run (the words of a window) and hash (what winnowing keeps of it), each once.

    An item with fewer words than a window is one window.
    """
    parts = []
    for size in sizes:
        fits = items.where(F.size("words") >= size) if size == window else items.where(F.size("words") == size)
        each = fingerprints(fits, size, gram).select("item_id", "words", F.inline("prints"))
        each = each.select("item_id", "words", "size", "hash", F.explode(F.sequence("first", "last")).alias("at"))
        parts.append(each.select("item_id", "size", _run(F.col("at"), F.col("size")).alias("run"), "hash"))
    return reduce(DataFrame.unionByName, parts).distinct()


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, and key of the row's id and text."""
    text = F.coalesce("text", F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), key.alias("key"), text.alias("text"))


def with_words(rows: DataFrame) -> DataFrame:
    return _once(rows.withColumn("_w", words_of(F.col("text"))).drop("text"), "words", F.col("_w")).drop("_w")


def likely(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key may be among the given ones; only some sixteenth of the others stays.

    The keys make a bit field of 16 bits each, at most 32 MB, in blocks of 4 KB;
    the blocks are broadcast. A fuller field lets more rows through, never fewer.
    """
    n, bits = keys.count(), _LEAST_BITS
    while bits < 16 * n and bits < _MOST_BITS:
        bits *= 2
    place = F.pmod(F.xxhash64("key"), F.lit(bits))
    spot = lambda c: c.select("*", F.floor(place / _BLOCK_BITS).alias("block"), (place % _BLOCK_BITS).alias("place"))
    field = spot(keys).groupBy("block").agg(F.bitmap_construct_agg("place").alias("field"))
    byte = F.conv(F.hex(F.expr("substring(field, CAST(place DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, (F.col("place") % 8).cast("int")).bitwiseAND(1) == 1
    return spot(rows).join(F.broadcast(field), "block").where(hit).drop("block", "place", "field")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, gram: int = 5) -> DataFrame:
    """Which words of each document lie in a run of ``window`` words that an item has too.

    Result, one row per row of ``docs``: doc_id, n_words long, spans
    array<struct<begin, end>> (the hit words, maximal and ascending, end
    excluded), item_ids array<bigint> (items with a run in the document,
    ascending). Words are runs of ASCII letters, digits and characters beyond
    ASCII, compared with A-Z in lower case.

    Method: documents and items keep the least hash of the ``gram``-word runs in
    each window (``fingerprints``). Kept hashes are joined; a document's hits are
    then extended to the whole windows they were kept for, and these are compared
    word by word with the items' windows. Each stretch of ``window`` shared words
    keeps the same hash on both sides, so none is missed, and hash collisions
    find nothing that the words do not bear out. Items shorter than a window are
    one window of their own size; documents are winnowed for every size that
    occurs, at most ``window`` of them.

    Windows that many items share are joined as one row: items are told apart
    only for each distinct collection of item lists. A document's row is found by
    a digest of its id and text, so a common text does not make a hot key.

    Null or empty texts have no words and no hits. Rows that repeat, or share
    their doc_id, are judged each by its own text; rows without a doc_id too.
    Items without item_id are left out; rows of one item_id are one item. Empty
    tables give no row, or no hit. Only doc_id, item_id and text are read, so
    other columns do not matter. Texts of any length are read whole.
    """
    whole = item_words(items)
    # at most ``window`` numbers
    sizes = sorted(r[0] for r in whole.select(F.least(F.size("words"), F.lit(window)).alias("size")).distinct().collect())
    texts = keyed_texts(docs)
    rows = with_words(texts)
    if not sizes:
        return rows.select(
            "doc_id", F.size("words").cast("bigint").alias("n_words"), F.array().cast(_NO_SPANS).alias("spans"),
            F.array().cast(_NO_ITEMS).alias("item_ids"),
        )
    windows = saved(item_windows(whole, sizes, window, gram), "item-windows")
    kept = _all_prints(rows, sizes, gram)
    kept = saved(kept.select("doc_id", "key", F.size("words").cast("bigint").alias("n_words"), "prints"), "prints")

    known = saved(windows.select("hash").distinct(), "item-prints")
    found = kept.select("key", F.inline("prints")).join(known, "hash", "left_semi")
    found = saved(found.select("key", F.struct("size", "first", "last").alias("range")).distinct()
                  .groupBy("key").agg(F.collect_list("range").alias("ranges")), "candidates")

    # only documents with a kept hash in common are read into words once more, after the join
    texts = spread_join(likely(texts.select("key", "text"), found.select("key")), found, ["key"], "inner")
    texts = with_words(texts).select("key", "words", F.inline("ranges"))
    candidates = texts.select("key", "words", "size", F.explode(F.sequence("first", "last")).alias("begin"))
    candidates = candidates.select("key", "size", "begin", _run(F.col("begin"), F.col("size")).alias("run"))

    # a list: the items that share a window, named by their number and two order-free digests
    bits = [F.bit_xor(F.xxhash64(F.lit(seed), "item_id")).cast("string") for seed in (1, 2)]
    lists = saved(windows.groupBy("run").agg(F.concat_ws("_", F.count("*").cast("string"), *bits).alias("list")), "item-lists")
    hits = saved(candidates.join(lists, "run").select("key", "begin", (F.col("begin") + F.col("size")).alias("end"), "list").distinct(), "hits")

    spans = _spans(hits)
    sets = hits.groupBy("key").agg(F.sort_array(F.collect_set("list")).alias("lists"))
    sets = saved(sets.withColumn("set", F.sha2(F.array_join("lists", ","), 256)), "item-sets")
    members = _members(sets, lists, windows)
    hit = spans.join(sets.select("key", "set"), "key").join(members, "set")
    return spread_join(kept.select("doc_id", "key", "n_words"), hit, ["key"], "left").select(
        "doc_id", "n_words",
        F.coalesce("spans", F.array().cast(_NO_SPANS)).alias("spans"),
        F.coalesce("item_ids", F.array().cast(_NO_ITEMS)).alias("item_ids"),
    )


def _spans(hits: DataFrame) -> DataFrame:
    """key and its maximal spans: windows that touch or overlap become one."""
    by = Window.partitionBy("key").orderBy("begin", "end")
    ranges = hits.groupBy("key", "begin").agg(F.max("end").alias("end"))
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    opened = ranges.withColumn("new", F.when(F.col("begin") <= before, 0).otherwise(1))
    numbered = opened.withColumn("span", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("key", "span").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return merged.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))


def _members(sets: DataFrame, lists: DataFrame, windows: DataFrame) -> DataFrame:
    """set and its item_ids. Documents with the same lists share a set, so a common window meets its items once for each set."""
    one = lists.groupBy("list").agg(F.min("run").alias("run"))
    items = one.join(windows.select("run", "item_id").distinct(), "run").select("list", "item_id")
    distinct = sets.groupBy("set").agg(F.first("lists").alias("lists"))
    pairs = distinct.select("set", F.explode("lists").alias("list")).join(items, "list").select("set", "item_id").distinct()
    return pairs.groupBy("set").agg(F.sort_array(F.collect_list(F.col("item_id").cast("bigint"))).alias("item_ids"))
