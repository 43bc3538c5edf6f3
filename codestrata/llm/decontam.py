"""Benchmark decontamination by a prefix-filtered set join (operator 9).

DataFrame functions only. Every benchmark item is cut into windows of
``window`` consecutive words (a shorter item is one window), a window into
shingles of up to three words.

1. The documents' shingles that occur in any window are kept with their
   positions: one pass over the texts, one hash join with the distinct shingles.
2. Shingles are ordered by rarity, their number in the documents. Containment
   must be whole, so the necessary prefix of a window is its one rarest shingle.
3. Joining the prefixes with the kept positions gives candidates; the prefix's
   place in the window gives the start, and starts before the text or ends
   beyond it are dropped (positional and length bounds).
4. Candidates are verified word by word against the text.

Everything after step 1 works on narrow rows; a text is moved once, to meet its
own candidates. The shingle table is written first, so that Spark knows its
size and broadcasts it only below its own threshold.

Defined results: a null or empty text has no words and is not contaminated; one
row per input row (repeated rows get the same result); null or empty items have
no windows; hits of an item with a null id count, but it cannot be listed; with
an empty benchmark nothing is contaminated. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import materialize

WINDOW = 13
SHINGLE = 3
#: Benchmark windows whose shingles go to one file of the shingle table.
WINDOWS_PER_FILE = 100_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case; none for null."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    small = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, upper, lower))
    return F.array_remove(F.split(small, SEPARATORS), "")


def window_table(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """``(item, n, words)``: the windows of every item; n is their length."""
    cut = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where("size(w) > 0")
    n = F.least(F.size("w"), F.lit(window))
    starts = cut.select("item", "w", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("i"))
    return starts.select("item", "n", F.slice("w", F.col("i"), F.col("n")).alias("words")).distinct()


def token(words: Column, at: Column | int, size: Column) -> Column:
    """Hash of the ``size`` (at most SHINGLE) words from ``at`` (from 1) on."""
    return F.xxhash64(size, *[F.when(size > k, F.get(words, at - 1 + k)) for k in range(SHINGLE)])


def occurring_shingles(docs: DataFrame, tokens: DataFrame, sizes: list[int]) -> DataFrame:
    """``(id, k, pos, token)``: the places (from 0) of the documents' shingles
    that are in ``tokens``. ``docs`` has id, k and w (words)."""
    shifted = [F.col("w"), *[F.slice("w", 1 + j, F.greatest(F.size("w") - j, F.lit(0))) for j in range(1, max(sizes))]]
    zipped = F.arrays_zip(*[c.alias(f"w{j}") for j, c in enumerate(shifted)])
    shifted_docs = docs.select("id", "k", F.posexplode(zipped).alias("pos", "s"))
    own = [F.col(f"s.{name}") for name in [f.name for f in shifted_docs.schema["s"].dataType.fields]]

    def hashed(size: int) -> Column:
        parts = [*own[:size], *[F.lit(None).cast("string")] * (SHINGLE - size)]
        return F.when(own[size - 1].isNotNull(), F.xxhash64(F.lit(size), *parts))

    hashes = [hashed(s) for s in sizes]
    one = shifted_docs.select("id", "k", "pos", hashes[0].alias("token")) if len(sizes) == 1 else shifted_docs.select("id", "k", "pos", F.explode(F.array(*hashes)).alias("token"))
    return one.join(tokens, "token").select("id", "k", "pos", "token")


def decontaminate(df: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of ``df``: the id, ``n_words``, ``n_hit`` (words inside
    any occurring window), ``n_items``, ``items`` (their ids, sorted as
    strings)."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("k", F.xxhash64("id", "text"))
    windows = materialize(window_table(items, window, item_col, item_text), "windows")
    size = F.least(F.col("n"), F.lit(SHINGLE))
    distinct = windows.select("words", "n", size.alias("s")).distinct()
    shingles = distinct.select("words", "n", "s", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("s") + 1)).alias("i"))
    shingles = shingles.select("words", "n", "i", token(F.col("words"), F.col("i"), F.col("s")).alias("token"))
    files = max(1, windows.count() // WINDOWS_PER_FILE)
    tokens = materialize(shingles.select("token").distinct().repartition(files), "shingles")
    sizes = sorted(r.s for r in distinct.select("s").distinct().collect()) or [1]  # at most SHINGLE values

    found = materialize(occurring_shingles(docs.select("id", "k", words_of(F.col("text")).alias("w")), tokens, sizes), "places")
    rarity = found.groupBy("token").agg(F.count("*").alias("seen"))
    # a window with a shingle that no document has cannot occur
    ranked = shingles.join(rarity, "token", "left").groupBy("words", "n").agg(F.min_by(F.struct("token", "i"), F.struct(F.coalesce("seen", F.lit(0)), "i")).alias("p"), F.min(F.coalesce("seen", F.lit(0))).alias("least"))
    prefixes = materialize(ranked.where("least > 0").select(F.col("p.token").alias("token"), F.col("p.i").alias("i"), "n", F.array_join("words", " ").alias("words")).repartition(files), "prefixes")
    starts = found.join(prefixes, "token").select("id", "k", (F.col("pos") - F.col("i") + 1).alias("a"), "n", "words").where("a >= 0").distinct()
    # the candidates of one document are bounded by its length
    held = starts.groupBy("id", "k").agg(F.collect_list(F.struct("a", "n", "words")).alias("c")).withColumnsRenamed({"id": "cid", "k": "ck"})

    joined = docs.join(held, (F.col("k") == F.col("ck")) & F.col("id").eqNullSafe(F.col("cid")), "left")
    split = joined.select("id", "k", words_of(F.col("text")).alias("w"), "c")
    there = F.filter("c", lambda x: (x.a + x.n <= F.size("w")) & (F.array_join(F.slice("w", x.a + 1, x.n), " ") == x.words))
    checked = split.select("id", "k", F.size("w").alias("n_words"), F.when(F.col("c").isNotNull(), there).alias("c"))
    spans = F.array_sort(F.transform("c", lambda x: F.struct(x.a.alias("a"), (x.a + x.n).alias("z"))))
    union = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end")),
        lambda s, x: F.struct((s.hit + F.greatest(F.lit(0), x.z - F.greatest(x.a, s.end))).alias("hit"), F.greatest(s.end, x.z).alias("end")),
    )
    found_windows = F.array_distinct(F.transform("c", lambda x: x.words))
    base = materialize(checked.select("id", "k", "n_words", F.when(F.col("c").isNotNull(), union.hit).otherwise(0).alias("n_hit"), found_windows.alias("windows")), "hits")

    named = windows.where("item is not null").select("item", F.array_join("words", " ").alias("window"))
    listed = base.where("size(windows) > 0").select("id", "k", F.explode("windows").alias("window")).distinct()
    listed = listed.join(named, "window").groupBy("id", "k").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumnsRenamed({"id": "cid", "k": "ck"})
    out = base.join(listed, (F.col("k") == F.col("ck")) & F.col("id").eqNullSafe(F.col("cid")), "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), items_of.alias("items"))


def contaminated(share: int = 20) -> Column:
    """Some word is hit, and at least one in ``share`` words."""
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
