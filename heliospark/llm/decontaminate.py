"""Benchmark decontamination in DataFrame functions alone.

Every window of `size` words of a benchmark item (the whole item where it has fewer) is hashed, from the hashes of its
words. A document's words are hashed once, and its windows, of each length that the items' windows have, as they leave the scan. A
bitmap of the benchmark's hashes (at most BITS) in the expression lets few windows become rows that do not hit; these meet the broadcast
hash set by that one long, and hits are verified word by word against the benchmark's window before they count. A
hash set of more than BROADCAST_BYTES meets the documents' hashes in a shuffled, salted join instead; only hashes
and places are shuffled there, and the texts of the documents that hit.

Defined cases: a null text has no words; an item without words has no window; several items may hold one
window, and each counts; repeated rows of a document give a row each; an empty benchmark leaves every
document clean; texts of any length are scanned whole; other columns of the input pass through
`drop_contaminated` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliospark.llm.shared import ascii_lower, fresh, let, small, stored

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Of words, items and hashes in the hash set, up to which it is broadcast; salts of the join beyond; bits of the bitmap.
BROADCAST_BYTES, SALTS, BITS = 64 << 20, 8, 1 << 22


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), NOT_WORD), "")


def windows_of(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """(hash, win, items): the distinct windows and the items that hold them, as a stored table."""
    w = benchmark.select(F.col("item_id"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))).alias("i"))
    w = w.select("item_id", F.slice("w", F.col("i"), size).alias("win")).groupBy("win").agg(F.collect_set("item_id").alias("items"))
    return stored(w.select(window_hash(F.col("win")).alias("hash"), "win", "items"))


def window_hash(window: Column) -> Column:
    return F.xxhash64(F.transform(window, lambda w: F.xxhash64(w)))


def bitmap(wins: DataFrame) -> tuple[Column, int]:
    """An array of longs, a constant, with a bit for the hash of each window, and its size; bits are 64 times as many as windows, or else BITS."""
    words = 1
    while words * 64 < min(BITS, 64 * wins.count()):
        words *= 2
    one = F.lit(1).cast("long")
    slots = wins.groupBy(F.shiftright("hash", 6).bitwiseAND(F.lit(words - 1)).cast("int").alias("slot")).agg(F.bit_or(F.call_function("shiftleft", one, F.col("hash").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    held = dict(slots.collect())
    return F.split(F.lit(",".join(str(held.get(k, 0)) for k in range(words))), ",").cast("array<bigint>"), words


def hashes(words: Column, lengths: list[int], bits: tuple[Column, int] | None = None) -> Column:
    """(hash, start, length) of all windows of these lengths, or of those whose bit is set; starts count from 0."""

    def told(x: Column) -> Column:
        slot = F.call_function("shiftright", x, F.lit(6)).bitwiseAND(F.lit(bits[1] - 1)).cast("int")
        return F.call_function("shiftright", F.get(bits[0], slot), x.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    def of(h: Column, length: int) -> Column:
        at = F.when(F.size(h) >= length, F.sequence(F.lit(0), F.size(h) - length)).otherwise(F.array().cast("array<int>"))
        hash_at = lambda i: F.xxhash64(F.slice(h, i + 1, length))
        if bits is not None:
            at = F.array_compact(F.transform(F.transform(at, hash_at), lambda x, i: F.when(told(x), i)))
        return F.transform(at, lambda i: F.struct(hash_at(i).alias("hash"), i.alias("start"), F.lit(length).alias("length")))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.concat(*[of(h, x) for x in lengths])) if lengths else F.array().cast("array<struct<hash:bigint,start:int,length:int>>")


def scan(docs: DataFrame, benchmark: DataFrame, size: int = 10, doc_id: str = "doc_id", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per distinct doc_id and text: doc_id, __hs_text (a hash of the text), n_words, rows, hits (array of start, length, items)."""
    wins = windows_of(benchmark, size)
    lengths = sorted(r[0] for r in wins.select(F.size("win")).distinct().collect())  # at most `size` of them
    held = wins.agg(F.sum(F.octet_length(F.concat_ws(" ", "win")) + 40 * F.size("items") + 64)).first()[0] or 0
    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("__hs_text"), words_of(F.col(f"`{text}`")).alias("w"))
    hit = F.struct("start", "length", "items")
    if held > broadcast_bytes:
        at = d.select("doc_id", "__hs_text", F.explode(F.array_distinct(hashes(F.col("w"), lengths))).alias("x")).select("doc_id", "__hs_text", "x.*").withColumn("salt", F.pmod("start", F.lit(SALTS)))
        keys = wins.select("hash", F.size("win").alias("length"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        met = stored(at.join(keys.hint("shuffle_hash"), ["hash", "length", "salt"]).select("doc_id", "__hs_text", "hash", "start", "length").distinct())
        who = met.select("doc_id", "__hs_text").distinct().select(F.col("doc_id").alias("i"), F.col("__hs_text").alias("t"))
        texts = d.join(small(stored(who)), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("__hs_text") == F.col("t")), "left_semi").dropDuplicates(["doc_id", "__hs_text"])
        found = met.alias("m").join(texts.alias("d"), F.col("m.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("m.__hs_text") == F.col("d.__hs_text")))
        found = found.select("m.*", F.slice("w", F.col("start") + 1, F.col("length")).alias("win")).join(wins, ["hash", "win"])
        found = found.groupBy("doc_id", "__hs_text").agg(F.collect_set(hit).alias("hits")).select(F.col("doc_id").alias("i"), F.col("__hs_text").alias("t"), "hits")
        rows = d.groupBy("doc_id", "__hs_text").agg(F.max(F.size("w")).cast("long").alias("n_words"), F.count("*").alias("rows"))
        out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("__hs_text") == F.col("t")), "left").drop("i", "t")
        return out.withColumn("hits", F.coalesce("hits", F.array().cast(out.schema["hits"].dataType)))
    # a window of no words, which each document has once, brings its row through the join
    none = F.array().cast("array<string>")
    end = wins.sparkSession.range(1).select(window_hash(none).alias("hash"), none.alias("win"), F.array().cast(wins.schema["items"].dataType).alias("items"))
    table = F.broadcast(wins.unionByName(end))
    last = F.array(F.struct(window_hash(none).alias("hash"), F.lit(0).alias("start"), F.lit(0).alias("length")))
    at = d.select("doc_id", "__hs_text", "w", F.explode(F.concat(hashes(F.col("w"), lengths, bitmap(wins) if lengths else None), last)).alias("x")).select("doc_id", "__hs_text", "w", "x.*")
    # not said as an equality, which would be made a key that is built for every window
    there = F.slice("w", F.col("start") + 1, F.col("length"))
    met = at.join(table, "hash").where((there >= F.col("win")) & (there <= F.col("win")))
    return met.groupBy("doc_id", "__hs_text").agg(
        F.max(F.size("w")).cast("long").alias("n_words"), F.sum(F.when(F.col("length") == 0, 1).otherwise(0)).alias("rows"), F.collect_set(F.when(F.col("length") > 0, hit)).alias("hits")
    )


def report(docs: DataFrame, benchmark: DataFrame, size: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of the contract for op4."""
    found = scan(docs, benchmark, size, broadcast_bytes=broadcast_bytes)
    places = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1))))
    items = F.array_sort(F.transform(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))), lambda x: x.cast("string")))
    return (
        found.select("doc_id", "n_words", "rows", places.alias("places"), items.alias("items"))
        .select(
            "doc_id",
            "n_words",
            F.size("places").cast("long").alias("n_hit"),
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            (F.size("places") > 0).alias("contaminated"),
            F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))).alias("row"),
        )
        .drop("row")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, most_percent: int = 0) -> DataFrame:
    """docs without those of which more than most_percent of the words lie in benchmark windows."""
    places = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1)))))
    names = [fresh(c, docs.columns) for c in ("__hs_id", "__hs_hash")]
    bad = scan(docs, benchmark, size).where((F.size("hits") > 0) & (100 * places > most_percent * F.col("n_words"))).select(F.col("doc_id").alias(names[0]), F.col("__hs_text").alias(names[1]))
    bad = small(stored(bad))
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col(names[0])) & (F.xxhash64(docs["text"]) == F.col(names[1])), "left_anti")
