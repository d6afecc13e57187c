"""Document fingerprints: 64-bit SimHash, and all fingerprints within a Hamming radius.

Every distinct word of a text votes on 64 bits with its length as weight, so short and common words
count for little. The votes are 32 sums of two 32-bit lanes each, added up by one partial aggregate:
a text's words are never shuffled, only its sums. A bit is set if more than half of the weight voted
for it.

Radius search: the 64 bits are cut into BLOCKS blocks. Fingerprints within the radius agree on at
least BLOCKS - radius blocks, so each row goes into one table per choice of that many blocks, keyed
by those bits alone, and pairs meet by an equi join. A pair counts in the first table where it
meets, so no second pass removes repeats. Equal fingerprints are one row with a count.

Defined results: null text is empty and has fingerprint 0; texts are ordered by document, then by
hash of the text, nulls first; rows with equal document and text hold one place in that order, and
each still gets its row. After the last document comes the first; a single document follows itself.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from depscope.llm.common import fresh, ranked, words_of
from depscope.scratch import materialize

BITS, LANES = 64, 32
RADIUS, BLOCKS = 3, 6


def simhash(terms: DataFrame, keys: list[str], term: str, weight: Column) -> DataFrame:
    """(keys, fingerprint: bigint) from one row per distinct term; weights add up to less than 2 ** 31."""
    mask = F.lit((1 << 32) | 1)
    hashed, heavy = fresh(terms, "_hash", "_weight")
    rows = terms.select(*keys, F.xxhash64(term).alias(hashed), weight.cast("long").alias(heavy))
    lanes = [F.sum(F.shiftright(hashed, k).bitwiseAND(mask) * F.col(heavy)).alias(f"lane{k}") for k in range(LANES)]
    sums = rows.groupBy(*keys).agg(F.sum(heavy).alias("all"), *lanes)
    bits = F.lit(0).cast("long")
    for k in range(LANES):
        low, high = F.col(f"lane{k}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"lane{k}", 32)
        for lane, at in ((low, k), (high, k + LANES)):
            bit = F.lit((1 << at) - (1 << BITS if at == BITS - 1 else 0)).cast("long")
            bits = bits.bitwiseOR(F.when(2 * lane > F.col("all"), bit).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, bits.alias("fingerprint"))


def fingerprint_texts(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, fingerprint) of whole texts; texts without words have 0. Keys tell rows apart."""
    word = fresh(texts, "_word")[0]
    # A row without words keeps one empty term of weight 0.
    words = F.concat(F.array_distinct(words_of(F.col(text))), F.array(F.lit("")))
    terms = texts.select(*keys, F.explode(words).alias(word))
    return simhash(terms, keys, word, F.length(word))


def likeness(a: Column, b: Column) -> Column:
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / float(BITS)


def to_text(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def _masks(radius: int, blocks: int) -> list[int]:
    """Bit masks of the tables, as signed 64-bit numbers."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    cells = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(cells, blocks - radius)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def within_radius(queries: DataFrame, table: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, found, distance): all distinct fingerprints of `table` near each one of `queries`.

    Both have a column `fingerprint`. Itself is found too.
    """
    if not 0 <= radius < blocks:
        raise ValueError("the radius must be smaller than the number of blocks")
    masks = _masks(radius, blocks)

    def tabled(df, name):
        keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col(name).bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])
        return df.select(F.col("fingerprint").alias(name)).distinct().select(name, F.explode(keys).alias(f"{name}_in"))

    left, right = tabled(queries, "query"), tabled(table, "found")
    apart = F.col("query").bitwiseXOR(F.col("found"))
    first = F.lit(len(masks))
    for i in reversed(range(len(masks))):
        first = F.when(apart.bitwiseAND(F.lit(masks[i])) == 0, i).otherwise(first)
    met = (F.col("query_in.t") == F.col("found_in.t")) & (F.col("query_in.k") == F.col("found_in.k"))
    return left.join(right, met & (F.bit_count(apart) <= radius) & (first == F.col("query_in.t"))).select(
        "query", "found", F.bit_count(apart).alias("distance"))


def followers(keys: DataFrame, order: list[str], key: str) -> DataFrame:
    """(key, next): each key and the one after it in the order, which includes it; the first follows the last."""
    line = ranked(keys.select(*order).distinct(), [], order, "order", "place")
    total = line.count()
    after = line.select(F.col(key).alias("next"), F.pmod(F.col("place") - 1, F.lit(max(total, 1))).alias("before"))
    return line.join(after, F.col("place") == F.col("before")).select(key, "next")


def edit_from_next(texts: DataFrame, order: DataFrame) -> DataFrame:
    """(key, text, edited): the last quarter of each text replaced by the start of the next text.

    `texts` has (key, text), `order` has (key, next, n_chars). Texts are dealt by key once, for both
    joins; only starts of texts travel a second time.
    """
    asks = order.select(F.col("key").alias("to"), F.col("next").alias("key"), F.floor(F.col("n_chars") / 4).cast("int").alias("take"))
    starts = texts.join(asks.hint("shuffle_hash"), "key").select(F.col("to").alias("key"), F.left("text", "take").alias("start"))
    # Rows that repeat a document bring equal starts.
    starts = starts.groupBy("key").agg(F.min("start").alias("start"))
    size = F.length("text")
    kept = F.left("text", (size - F.floor(size / 4)).cast("int"))
    return texts.join(starts.hint("shuffle_hash"), "key").select("key", "text", F.concat(kept, "start").alias("edited"))


def op9_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """All documents and their edited texts; of ids divisible by 50 also how many documents lie within the radius."""
    text = F.coalesce("text", F.lit(""))
    digest = F.hex(F.xxhash64(text))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), digest).alias("key"), "doc_id", text.alias("text"))
    rows = materialize(docs.select("key", "doc_id", F.length("text").cast("long").alias("n_chars")), "documents")
    order = followers(rows, ["doc_id", "key"], "key")
    order = materialize(order.join(rows.select("key", "n_chars").distinct(), "key"), "order")
    # One row per document and text: copies of a row would add up their weights.
    edited = edit_from_next(docs.select("key", "text"), order).dropDuplicates(["key"])
    kinds = F.array(
        F.struct(F.lit(False).alias("edited"), F.col("text").alias("text"), F.lit(None).cast("string").alias("sha")),
        F.struct(F.lit(True).alias("edited"), F.col("edited").alias("text"), F.sha2("edited", 256).alias("sha")))
    both = edited.select("key", F.explode(kinds).alias("x")).select("key", "x.edited", "x.sha", "x.text")
    prints = fingerprint_texts(both, ["key", "edited", "sha"], "text")
    prints = materialize(prints.groupBy("key").agg(
        F.max("sha").alias("edited_sha256"), F.max(F.when(~F.col("edited"), F.col("fingerprint"))).alias("own"),
        F.max(F.when(F.col("edited"), F.col("fingerprint"))).alias("changed")), "fingerprints")
    after = order.select("key", F.col("next")).join(
        prints.select(F.col("key").alias("next"), F.col("own").alias("next_own")), "next").select("key", "next_own")
    every = rows.join(prints, "key").select(F.col("own").alias("fingerprint"), "doc_id")
    counted = every.groupBy("fingerprint").count()
    asked = every.where("doc_id % 50 = 0").select("fingerprint").distinct()
    near = within_radius(asked, counted).join(counted.withColumnRenamed("fingerprint", "found"), "found")
    near = near.groupBy("query").agg(F.sum("count").alias("n_within")).withColumnRenamed("query", "own")
    return rows.join(prints, "key").join(after, "key").join(near, "own", "left").select(
        "doc_id", "n_chars", "edited_sha256", to_text(F.col("own")).alias("fingerprint"),
        to_text(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
        F.when(F.col("doc_id") % 50 == 0, F.col("n_within")).alias("n_within"))
