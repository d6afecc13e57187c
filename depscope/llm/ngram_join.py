"""N-gram Jaccard join: exact classes and links of documents whose word shingles overlap by 80 % or more.

Rare-first prefix filtering finds candidates. A set of n shingles is ordered by how often the bucket
of each shingle's hash occurs over all documents, then by hash: one global order, known from a count
table of fixed size. Two sets that link share one of their first n - ceil(0.8 n) + 1 shingles. Sets
meet on those, and pairs go on if they pass the length filter, the positional filter (what can still
be shared before and after the meeting point) and the suffix filter (bits of the parity of the sets'
shingles by hash range differ at most as often as the sets do). Each pair left is verified once.

Groups of copies do not become pairs. Equal sets are one set from the start. In a round each set is
paired with one set at most: of the heads of its prefix lists (a row each, another one every round) that
lie in another component, the one it meets most often. Links found contract components, and lists
within one component go. Rounds end when most pairs fail. Then the rest is gone through in whole: rows of short lists are
joined, and pairs go on if they meet often enough; rows of long lists are compared in blocks, where first each row keeps its closest
partner in every other component, and after another contraction all pairs that still cross components go on.
What is left out is never a link between different components.

The number of links of a document covers all of them, also inside a component: sets of one component are compared in
blocks of bounded bytes, and a task emits one number per set. `linked_pairs` gives the links themselves.

Whole sets are read again, from the texts, for the sets of pairs that are left only. A bitmap of
fixed size (one bit per hash range of the document) spares the other texts; it never grows, and
where it is full more sets are read than needed.

Shingles are compared by 64-bit hashes. Defined results: null and blank texts have no shingles and
link with nothing; texts of fewer words than a shingle are one shingle; repeated rows and equal
texts are one class and link with each other; a null document is in its class but never names it; an empty table gives
an empty result; columns of any other name do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from depscope.llm.common import fresh
from depscope.llm.shingling import shingle_sets
from depscope.scratch import drop, materialize, release_shuffles

WORDS = 5
# Links have NUM * intersection size >= DEN * (size + size): 100 i >= 80 u is 9 i >= 4 (a + b).
NUM, DEN = 9, 4
# Buckets of the shingle counts: a table of 1 MB, whatever the input.
BUCKET_BITS, SLICES = 18, 64
# Bits of the suffix filter, and rows of a prefix list that one task compares with as many others.
PARITY_WORDS, BLOCK = 8, 2048
# Bits of the map of wanted documents: 4 MB.
WANTED_BITS = 25
# Sets that one task remembers, to emit copies once; rows of an Arrow batch that a task makes at once.
_SEEN, _ROWS = 1 << 16, 512
# Rows of a prefix list whose pairs are joined at once; longer lists are compared in blocks.
SHORT = 16
# Rounds go on while more than one in so many proposed pairs links; what a task compares at once inside a component.
WORTH, SETS_AT_ONCE, BYTES_AT_ONCE = 3, 1024, 4 << 20


def set_key(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def prefix_size(n: int) -> int:
    """How many of the first shingles of n must meet one of a partner's: at least 0.8 n are shared."""
    return n - (DEN * n + NUM - DEN - 1) // (NUM - DEN) + 1


def prefix_column(n: Column) -> Column:
    return n - F.floor((DEN * n + NUM - DEN - 1) / (NUM - DEN)) + 1


def parity(hashes: np.ndarray, words: int = PARITY_WORDS) -> bytes:
    """Bit k: whether an odd number of shingles fall into hash range k, of 64 * words ranges (a power of two)."""
    bits = 64 * words
    at = ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def wide_words(n: int) -> int:
    """Words of the wide parity of n shingles: two to four bits for each, so that it does not fill up."""
    return max(PARITY_WORDS, 1 << max(0, (n - 1) // 32).bit_length())


def fewest_apart(x: bytes, y: bytes) -> int:
    """A lower bound of how many shingles only one of two sets has, from their wide parities.

    Two neighbouring ranges are one range of half as many; its parity is theirs combined.
    """
    a, b = (np.unpackbits(np.frombuffer(v, dtype=np.uint8)) for v in (x, y))
    while len(a) > len(b):
        a = a[::2] ^ a[1::2]
    while len(b) > len(a):
        b = b[::2] ^ b[1::2]
    return int(np.count_nonzero(a != b))


def _batches(columns: list[str], rows: Iterator[tuple], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size."""
    kept: list[tuple] = []
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*kept, strict=True), kinds, strict=True)], names=columns)
    for row in rows:
        kept.append(row)
        if len(kept) >= _ROWS:
            yield make()
            kept.clear()
    if kept:
        yield make()


def read_sets(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, key, bits, wide) of every row, and (slice, counts) of the shingle buckets over all of them; one pass over the texts."""
    names = ["slice", "doc_id", "n", "key", "bits", "wide"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, dtype=np.int64)

        def rows(batch):
            for doc, h in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), words), strict=True):
                np.add.at(counts, _bucket(h), 1)
                yield None, doc, len(h), set_key(h), parity(h), parity(h, wide_words(len(h)))

        for batch in batches:
            yield from _batches(names, rows(batch), kinds)
        if counts.any():
            yield from _batches(names, ((i, None, None, None, part.tobytes(), None) for i, part in enumerate(counts.reshape(SLICES, -1))), kinds)
        pa.default_memory_pool().release_unused()

    read = materialize(docs.mapInArrow(work, "slice int, doc_id long, n int, key long, bits binary, wide binary"), "sets")
    return read.where("slice IS NULL").drop("slice"), read.where("slice IS NOT NULL").select("slice", F.col("bits").alias("counts"))


def bucket_counts(slices: DataFrame) -> np.ndarray:
    """How often each bucket occurs: the tasks' counts are added per slice, and the driver gets one table of fixed size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counts in zip(batch.column("slice").to_pylist(), batch.column("counts"), strict=True):
                part = np.frombuffer(counts.as_py(), dtype=np.int64)
                sums[at] = sums[at] + part if at in sums else part
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["slice", "counts"])

    out = np.zeros(1 << BUCKET_BITS, dtype=np.int64).reshape(SLICES, -1)
    for row in slices.repartition(SLICES, "slice").mapInArrow(add, "slice int, counts binary").collect():
        out[row["slice"]] += np.frombuffer(row["counts"], dtype=np.int64)
    return out.reshape(-1)


def prefix_rows(docs: DataFrame, counts: np.ndarray, words: int) -> DataFrame:
    """(token, key, n, pos): the rarest shingles of each set, with their place in the global order."""
    ranks = np.empty(len(counts), dtype=np.int32)
    ranks[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.int32)
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen, kept, held = sent.value, set(), [], 0
        make = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*kept, strict=True)], names=["token", "key", "n", "pos"])
        for batch in batches:
            for h in shingle_sets(batch.column("text"), words):
                n, key = len(h), set_key(h)
                # Copies that one task meets give one set of rows; those of other tasks are harmless.
                if not n or key in seen:
                    continue
                if len(seen) < _SEEN:
                    seen.add(key)
                rank, p = order[_bucket(h)], prefix_size(n)
                chosen = np.argpartition(rank, p - 1)[:p] if p < n else np.arange(n)
                if p < n:
                    # All shingles of the last bucket in reach compete by hash.
                    edge = rank[chosen].max()
                    chosen = np.nonzero(rank <= edge)[0]
                first = chosen[np.lexsort((h[chosen], rank[chosen]))][:p]
                kept.append((h[first].view(np.int64), np.full(p, key, dtype=np.int64), np.full(p, n, dtype=np.int32), np.arange(p, dtype=np.int32)))
                held += p
                if held >= 1 << 16:
                    yield make()
                    kept.clear()
                    held = 0
        if kept:
            yield make()
        pa.default_memory_pool().release_unused()

    return docs.select("text").mapInArrow(work, "token long, key long, n int, pos int")


def may_link(na, nb, ia, ib):
    """Length and positional filter of sets of sizes na and nb that meet at places ia and ib (columns or arrays)."""
    least = F.least if not isinstance(na, np.ndarray) else np.minimum
    before, after = least(ia, ib), least(na - ia, nb - ib)
    return ((NUM - DEN) * na >= DEN * nb) & ((NUM - DEN) * nb >= DEN * na) & (NUM * (before + after) >= DEN * (na + nb))


def meetings(rows: DataFrame) -> DataFrame:
    """The prefix rows of lists with several sets. Lists are summed up in parts, and a long list's rows are joined in many tasks."""
    lists = rows.groupBy("token").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("token")
    met = materialize(rows.join(lists, "token"), "meetings")
    release_shuffles(rows.sparkSession)
    # Rows of one set may come from several tasks.
    shared = materialize(met.distinct(), "shared")
    drop(met)
    return shared


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(token, key, n, pos, component); a set without a label is a component of its own."""
    joined = rows.select("token", "key", "n", "pos").join(labels, "key", "left")
    return materialize(joined.select("token", "key", "n", "pos", F.coalesce("component", "key").alias("component")), "rows")


def proposals(rows: DataFrame, labels: DataFrame | None, turn: int) -> tuple[DataFrame, DataFrame]:
    """(a, b), a < b: each set with one head at most, of the heads in other components that have a fitting length the one it meets most often.

    Also the rows of lists that hold several components, stored. The head of a list is the row whose key comes first under a mask
    that all lists share and that changes every turn.
    """
    mask = F.lit(xxhash.xxh3_64_intdigest(b"heads", seed=turn) - (1 << 63))
    lists = rows.groupBy("token").agg(
        F.min(F.col("key").bitwiseXOR(mask)).alias("head"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    mixed = materialize(rows.join(lists.where("lo <> hi").select("token", F.col("head").bitwiseXOR(mask).alias("other")), "token"), "mixed")
    votes = mixed.groupBy("key", "n", "component", "other").agg(F.count(F.lit(1)).alias("met"))
    if labels is None:
        votes = votes.where("other <> key")
    else:
        of_other = labels.select(F.col("key").alias("other"), F.col("component").alias("there"))
        votes = votes.join(of_other, "other", "left").where(F.coalesce("there", "other") != F.col("component"))
    best = votes.groupBy("key").agg(F.max(F.struct("met", "other"))["other"].alias("other"))
    return best.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct(), mixed


def _wanted_map(chosen: DataFrame) -> np.ndarray:
    """Bitmap of the hash ranges of the chosen documents, of fixed size."""
    at = _range_of(F.col("least"))
    words = chosen.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63))).alias("bit"))
    out = np.zeros(1 << (WANTED_BITS - 6), dtype=np.int64)
    # At most one row per word of the map.
    for row in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        out[row["word"]] = row["bits"]
    return out


def _range_of(doc_id):
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(doc_id, F.lit(-1).cast("long"))), 64 - WANTED_BITS).cast("int")


def set_contents(docs: DataFrame, chosen: DataFrame, words: int) -> DataFrame:
    """(key, n, hashes) of the chosen sets (key, least: a document that has it); one row per set."""
    sent = docs.sparkSession.sparkContext.broadcast(_wanted_map(chosen))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        for batch in batches:
            at = batch.column("at").to_numpy()
            places = np.nonzero((wanted[at >> 6] >> (at & 63)) & 1)[0]
            for s in range(0, len(places), 64):
                got = shingle_sets(batch.column("text").take(pa.array(places[s : s + 64])), words)
                yield from _batches(["key", "n", "hashes"], ((set_key(h), len(h), h.tobytes()) for h in got), [pa.int64(), pa.int32(), pa.binary()])
        pa.default_memory_pool().release_unused()

    read = docs.select(_range_of(F.col("doc_id")).alias("at"), "text").mapInArrow(work, "key long, n int, hashes binary")
    return read.join(chosen.select("key"), "key", "left_semi").dropDuplicates(["key"])


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the pairs that link. Pairs are distinct, a <> b."""
    side = lambda name: sets.select(F.col("key").alias(name), F.col("n").alias(f"n{name}"), F.col("hashes").alias(f"h{name}"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            last, x = None, np.empty(0, dtype=np.uint64)
            for a, ha, hb in zip(batch.column("a").to_pylist(), batch.column("ha"), batch.column("hb"), strict=True):
                if a != last:
                    last, x = a, np.frombuffer(ha.as_py(), dtype=np.uint64)
                y = np.frombuffer(hb.as_py(), dtype=np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(NUM * shared >= DEN * (len(x) + len(y)))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", "ha", "hb").mapInArrow(work, "a long, b long")


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(key, component): for every key of the links (a, b), the least key it can reach.

    Labels pass to neighbours and then jump along themselves, so rounds grow with the logarithm of
    the distance; each round is written, and ends when no label changes.
    """
    both = links.select("a", "b").union(links.select("b", "a"))
    edges = materialize(both.distinct(), f"{label}-edges")
    labels = materialize(edges.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.col("key")).alias("component")), label)
    while True:
        told = edges.join(labels, F.col("b") == F.col("key")).groupBy("a").agg(F.min("component").alias("heard"))
        heard = labels.join(told, F.col("key") == F.col("a")).select("key", F.col("component").alias("was"), F.least("component", "heard").alias("component"))
        heard = materialize(heard, label)
        jump = heard.select(F.col("key").alias("component"), F.col("component").alias("beyond"))
        new = materialize(heard.join(jump, "component").select("key", "was", F.least("component", "beyond").alias("component")), label)
        labels = new.select("key", "component")
        if new.where("was <> component").isEmpty():
            return labels


def sized_lists(rows: DataFrame) -> DataFrame:
    """Rows of lists that hold several components, with the list's size."""
    lists = rows.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("least"), F.max("component").alias("most"))
    return materialize(rows.join(lists.where("least <> most").select("token", "size"), "token"), "sized")


def short_list_pairs(rows: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of different components that meet on lists of at most SHORT rows and share enough prefix shingles.

    All common prefix shingles of a pair are its m meetings here, and at most as many as either set has on longer lists.
    After the last of them the smaller-ranked prefix has no common shingle left, so no more can be shared than the
    rest of one set from there on and the part of the other behind its prefix.
    """
    short = rows.where(F.col("size") <= SHORT)
    longer = rows.where(F.col("size") > SHORT).groupBy("key").agg(F.count(F.lit(1)).alias("unseen"))
    side = lambda s: short.select("token", *[F.col(c).alias(c + s) for c in ("key", "n", "pos", "component")])
    met = side("a").join(side("b"), "token").where("keya < keyb AND componenta <> componentb")
    met = met.where(((NUM - DEN) * F.col("na") >= DEN * F.col("nb")) & ((NUM - DEN) * F.col("nb") >= DEN * F.col("na")))
    pairs = met.groupBy("keya", "keyb", "na", "nb").agg(F.count(F.lit(1)).alias("m"), F.max("posa").alias("ia"), F.max("posb").alias("ib"))
    for s in "ab":
        pairs = pairs.join(longer.select(F.col("key").alias(f"key{s}"), F.col("unseen").alias(f"u{s}")), f"key{s}", "left")
    unseen = F.least(F.coalesce("ua", F.lit(0)), F.coalesce("ub", F.lit(0)))
    behind = lambda n: n - prefix_column(n)
    na, nb, ia, ib = (F.col(c) for c in ("na", "nb", "ia", "ib"))
    rest = F.greatest(F.least(behind(na), nb - 1 - ib), F.least(na - 1 - ia, behind(nb)))
    # Meetings not seen here may lie behind the last one seen.
    rest = F.when(unseen > 0, F.least(na, nb)).otherwise(rest)
    return pairs.where(NUM * (F.col("m") + rest) >= DEN * (na + nb)).select(F.col("keya").alias("a"), F.col("keyb").alias("b"))


def cross_pairs(rows: DataFrame, sets: DataFrame, best: bool = False) -> DataFrame:
    """(a, b), a < b: pairs of different components that pass all filters; rows from sized_lists.

    With `best` only the closest one, by parities, of each row and other component in a block.
    A list is cut into blocks by hash of the set, and each pair of blocks is a task's unit, so a
    list of any length spreads over many tasks.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("key"), blocks).cast("int")
    cut = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cut = cut.select("token", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "key", "n", "pos", "component")
    full = cut.join(sets.select("key", "bits", "wide"), "key")
    dealt = full.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi")

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, n, pos, comp = (t.column(c).to_numpy() for c in ("key", "n", "pos", "component"))
        mine, lo, hi = (t.column(c).to_numpy() for c in ("mine", "lo", "hi"))
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), dtype=np.uint64).reshape(len(key), PARITY_WORDS)
        n, pos, wide = n.astype(np.int64), pos.astype(np.int64), t.column("wide").to_pylist()
        left = np.nonzero(mine == lo)[0]
        right = left if lo[0] == hi[0] else np.nonzero(mine == hi)[0]
        # Most rows of a block may lie in one component: only the others need partners.
        names, counts = np.unique(comp, return_counts=True)
        stray = comp != names[counts.argmax()]
        sides = [(left[stray[left]], right), (right[stray[right]], left[~stray[left]])]
        found_a, found_b = [], []
        for i, partners in ((side[s : s + 256], partners) for side, partners in sides for s in range(0, len(side), 256)):
            ok = (comp[i][:, None] != comp[partners][None, :]) & may_link(n[i][:, None], n[partners][None, :], pos[i][:, None], pos[partners][None, :])
            x, y = np.nonzero(ok)
            x, y = i[x], partners[y]
            apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
            fits = NUM * apart <= n[x] + n[y]
            x, y = x[fits], y[fits]
            if best and len(x):
                order = np.lexsort((apart[fits], comp[y], x))
                x, y = x[order], y[order]
                first = np.concatenate([[True], (x[1:] != x[:-1]) | (comp[y[1:]] != comp[y[:-1]])])
                x, y = x[first], y[first]
            # The short parities of large sets are full; the wide ones are compared for what is left.
            sure = np.array([NUM * fewest_apart(wide[i], wide[j]) <= n[i] + n[j] for i, j in zip(x.tolist(), y.tolist(), strict=True)], dtype=bool)
            found_a.append(key[x[sure]])
            found_b.append(key[y[sure]])
        if not found_a:
            return
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        for start in range(0, len(pairs), 1 << 16):
            part = pairs[start : start + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(part[:, 0])), pa.array(np.ascontiguousarray(part[:, 1]))], names=["a", "b"])

    work = _by_group(["token", "lo", "hi"], compare)
    return dealt.mapInArrow(work, "a long, b long").distinct()


def _by_group(columns: list[str], each):
    """A function for mapInArrow that hands rows standing side by side with equal `columns` to `each` as one table, across batches.

    A group's rows are kept as they came until it ends, so groups must be of bounded size.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            values = [batch.column(c).to_numpy() for c in columns]
            changed = np.zeros(batch.num_rows - 1, dtype=bool)
            for v in values:
                changed |= v[1:] != v[:-1]
            starts = [0, *(np.nonzero(changed)[0] + 1).tolist(), batch.num_rows]
            for s, e in zip(starts, starts[1:], strict=False):
                name = tuple(int(v[s]) for v in values)
                if parts and name != last:
                    yield from each(pa.Table.from_batches(parts).combine_chunks())
                    parts = []
                last = name
                parts.append(batch.slice(s, e - s))
        if parts:
            yield from each(pa.Table.from_batches(parts).combine_chunks())
        pa.default_memory_pool().release_unused()

    return work


def _suffix_filter(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose wide parities differ no more often than linked sets may."""
    half = lambda name: sets.select(F.col("key").alias(name), F.col("n").alias(f"n{name}"), F.col("wide").alias(f"w{name}"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()
            apart = [fewest_apart(x.as_py(), y.as_py()) for x, y in zip(batch.column("wa"), batch.column("wb"), strict=True)]
            yield batch.filter(pa.array(NUM * np.array(apart, dtype=np.int64) <= total)).select(["a", "b"])

    joined = pairs.join(half("a"), "a").join(half("b"), "b")
    fits = ((NUM - DEN) * F.col("na") >= DEN * F.col("nb")) & ((NUM - DEN) * F.col("nb") >= DEN * F.col("na"))
    joined = joined.where(fits)
    return joined.select("a", "b", "na", "nb", "wa", "wb").mapInArrow(work, "a long, b long")


def contracted(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(key, component) after more links (a, b): components become one row each, and only those rows are linked."""
    if labels is None:
        return components(links)
    if links.isEmpty():
        return labels
    # What was a component's least key stands for it.
    at = lambda name: labels.select(F.col("key").alias(name), F.col("component").alias(f"c{name}"))
    between = links.join(at("a"), "a", "left").join(at("b"), "b", "left")
    between = between.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
    moved = components(between)
    to = moved.select(F.col("key").alias("component"), F.col("component").alias("to"))
    old = labels.join(to, "component", "left").select("key", F.coalesce("to", "component").alias("component"))
    return materialize(old.union(moved.join(labels, "key", "left_anti")), "labels")


class _Contents:
    """Whole sets by key; those that pairs ask for are read once."""

    def __init__(self, docs: DataFrame, sets: DataFrame, words: int):
        self.docs, self.sets, self.words, self.known = docs, sets, words, None

    def verified(self, pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
        if self.known is not None:
            ends = ends.join(self.known.select("key"), "key", "left_anti")
        wanted = materialize(self.sets.join(ends, "key", "left_semi").select("key", "least"), "wanted")
        if self.known is None or not wanted.isEmpty():
            new = materialize(set_contents(self.docs, wanted, self.words), "contents")
            self.known = new if self.known is None else self.known.union(new)
        return materialize(verify(pairs, self.known), "links")


def linked_sets(docs: DataFrame, sets: DataFrame, slices: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """(key, component) of all sets that link, and the whole sets (key, n, hashes) of those and more.

    `sets` has (key, least, n, bits, wide), one row per set.
    """
    contents, labels, turn = _Contents(docs, sets, words), None, 0
    shared = meetings(prefix_rows(docs, bucket_counts(slices), words))
    rows = shared.withColumn("component", F.col("key"))
    while True:
        asked, mixed = proposals(rows, labels, turn)
        drop(shared if turn == 0 else rows)
        asked = materialize(_suffix_filter(asked, sets), "proposals")
        links = contents.verified(asked)
        labels = contracted(labels, links)
        rows, turn = labelled(mixed, labels), turn + 1
        drop(mixed)
        release_shuffles(docs.sparkSession)
        if links.count() * WORTH <= asked.count():
            break
    sized = sized_lists(rows)
    drop(rows)
    long = sized.where(F.col("size") > SHORT)
    short = _suffix_filter(short_list_pairs(sized), sets)
    links = contents.verified(materialize(short.union(cross_pairs(long, sets, best=True)).distinct(), "pairs"))
    labels = contracted(labels, links)
    rows = labelled(long, labels)
    left = sized_lists(rows)
    drop(sized, rows)
    links = contents.verified(materialize(cross_pairs(left, sets), "pairs"))
    labels = contracted(labels, links)
    drop(left)
    release_shuffles(docs.sparkSession)
    return labels, contents.known


def _blocks_of_components(labels: DataFrame, contents: DataFrame, copies: DataFrame) -> DataFrame:
    """Sets of components of several, as rows (component, lo, hi, mine, key, n, hashes, copies) of pairs of blocks of bounded bytes."""
    rows = labels.join(contents, "key").join(copies.select("key", "copies"), "key")
    load = rows.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum(F.length("hashes")).alias("bytes")).where("size > 1")
    load = load.select("component", F.greatest(F.ceil(F.col("size") / SETS_AT_ONCE), F.ceil(F.col("bytes") / BYTES_AT_ONCE)).cast("int").alias("blocks"))
    rows = rows.join(load, "component").withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other")).drop("other", "blocks")
    keys = ["component", "lo", "hi"]
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of some sets shares with each of others."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    sides = []
    for sets in (left, right):
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        sides.append((np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64), owner))
    both = np.intersect1d(sides[0][0], sides[1][0])
    placed = []
    for values, owner in sides:
        at = np.searchsorted(both, values)
        at[at == len(both)] = 0
        hit = both[at] == values if len(both) else np.zeros(len(values), dtype=bool)
        order = np.argsort(at[hit], kind="stable")
        placed.append((at[hit][order], owner[hit][order]))
    for start in range(0, len(both), 1024):
        parts = []
        for (at, owner), sets in zip(placed, (left, right), strict=True):
            s, e = np.searchsorted(at, (start, start + 1024))
            part = np.zeros((len(sets), min(1024, len(both) - start)), dtype=np.float32)
            part[owner[s:e], at[s:e] - start] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _compared(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left rows, right rows, linked, shared, n) of a pair of blocks."""
    sets, n, mine = [np.frombuffer(h.as_py(), dtype=np.uint64) for h in t.column("hashes")], t.column("n").to_numpy().astype(np.int64), t.column("mine").to_numpy()
    left = np.nonzero(mine == t.column("lo")[0].as_py())[0]
    right = left if t.column("lo")[0].as_py() == t.column("hi")[0].as_py() else np.nonzero(mine == t.column("hi")[0].as_py())[0]
    shared = _shared_counts([sets[i] for i in left], [sets[i] for i in right]).astype(np.int64)
    linked = (NUM * shared >= DEN * (n[left][:, None] + n[right][None, :])) & (left[:, None] != right[None, :])
    return left, right, linked, shared, n


def link_counts(blocks: DataFrame) -> DataFrame:
    """(key, linked_sets, linked_rows): how many other sets each set links with, and how many rows have them."""

    def count(t: pa.Table) -> Iterator[pa.RecordBatch]:
        left, right, linked, _, _ = _compared(t)
        key, copies = t.column("key").to_numpy(), t.column("copies").to_numpy()
        found = [(key[left], linked.sum(axis=1), linked @ copies[right])]
        if right is not left:
            found.append((key[right], linked.sum(axis=0), linked.T @ copies[left]))
        yield from (pa.RecordBatch.from_arrays([pa.array(np.asarray(c, dtype=np.int64)) for c in part], names=["key", "linked_sets", "linked_rows"]) for part in found)

    parts = blocks.mapInArrow(_by_group(["component", "lo", "hi"], count), "key long, linked_sets long, linked_rows long")
    return parts.groupBy("key").agg(F.sum("linked_sets").alias("linked_sets"), F.sum("linked_rows").alias("linked_rows"))


def linked_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(a, b, shared, total): every link between different sets once, by the least documents that have them; total is the size of the union.

    There are as many rows as links, so a group of near copies may give the square of its size. Copies of a document are not expanded.
    """
    docs = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    known, slices = read_sets(docs, words)
    sets = _distinct(known)
    labels, contents = linked_sets(docs, sets, slices, words)

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        left, right, linked, shared, n = _compared(t)
        key = t.column("key").to_numpy()
        x, y = np.nonzero(linked & (key[left][:, None] < key[right][None, :]) if right is left else linked)
        for s in range(0, len(x), 1 << 16):
            i, j = x[s : s + (1 << 16)], y[s : s + (1 << 16)]
            met = shared[i, j]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key[left][i], key[right][j], met, n[left][i] + n[right][j] - met)], names=["a", "b", "shared", "total"])

    found = _blocks_of_components(labels, contents, sets).mapInArrow(_by_group(["component", "lo", "hi"], pairs), "a long, b long, shared long, total long")
    named = lambda name: sets.select(F.col("key").alias(name), F.col("least").alias(f"d{name}"))
    found = found.join(named("a"), "a").join(named("b"), "b")
    return found.select(F.least("da", "db").alias("a"), F.when(F.least("da", "db") == F.col("da"), F.col("db")).otherwise(F.col("da")).alias("b"), "shared", "total")


def _distinct(known: DataFrame) -> DataFrame:
    """One row per set, so that copies weigh once from here on."""
    return materialize(known.where("n > 0").groupBy("key", "n").agg(
        F.min("doc_id").alias("least"), F.min("bits").alias("bits"), F.min("wide").alias("wide"), F.count(F.lit(1)).alias("copies")), "distinct")


def _classes(docs: DataFrame, words: int, count: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows of read_sets, and (key, component_id, head) of every set: the class's least document and the first set that it has.

    With `count` also n_links: the other rows that a row of the set links with.
    """
    known, slices = read_sets(docs, words)
    sets = _distinct(known)
    labels, contents = linked_sets(docs, sets, slices, words)
    joined = sets.select("key", "least", "copies").join(labels, "key", "left").withColumn("component", F.coalesce("component", "key"))
    named = joined.groupBy("component").agg(
        F.min("least").alias("component_id"), F.min(F.struct(F.col("least").isNull(), "least", "key"))["key"].alias("head"))
    of_set = joined.join(named, "component").select("key", "component_id", "head", "copies")
    if count:
        linked = link_counts(_blocks_of_components(labels, contents, sets))
        of_set = of_set.join(linked, "key", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("linked_rows", F.lit(0)))
    return known, materialize(of_set.drop("copies", "linked_sets", "linked_rows"), "classes")


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row; the component is named by its least document.

    `n_links` is the number of other rows that the row links with, equal texts included.
    """
    docs = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    known, of_set = _classes(docs, words, count=True)
    size = F.col("n").cast("long").alias("n_shingles")
    blank = known.where("n = 0").select("doc_id", size, F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return known.where("n > 0").join(of_set, "key").select("doc_id", size, "component_id", "n_links").union(blank)


def op5_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def with_keys(docs: DataFrame, name: str, words: int = WORDS) -> DataFrame:
    """Add the key of each text's set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [set_key(h) for h in shingle_sets(batch.column("text"), words)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def keep_one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class one row, of the document that names it; blank documents stay, repeated rows leave one.

    Rows are known by document and set, so different texts under one number, or under none, are
    kept or dropped each for itself. Of several sets of the naming document in its class, and of
    classes without a number, the set with the least key stays.
    """
    columns = docs.columns
    key, number = fresh(docs, "_key", "_number")
    _, of_set = _classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), WORDS)
    named = lambda c: F.coalesce(c.cast("long").cast("string"), F.lit("none"))
    heads = of_set.where("key = head").select(named(F.col("component_id")).alias(number), F.col("key").alias(key))
    blank = F.coalesce(F.col("text"), F.lit("")).rlike(r"^[ \t-\r]*$")
    keyed = with_keys(docs.where(~blank), key).withColumn(number, named(F.col("doc_id")))
    # Rows are dealt once, by number and set: copies of a text lie in many tasks, and repeated rows in one.
    first = keyed.join(heads, [number, key], "left_semi").dropDuplicates([number, key])
    return first.select(*columns).unionByName(docs.where(blank))


ORACLE = r"""
WITH lowered AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda w: w <> '') AS words FROM lowered
), sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS grams
  FROM split
), grams AS (
  SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS met
  FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared WHERE 100 * met >= 80 * (na + nb - met)
), reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM r JOIN links l ON l.a = r.b) SELECT a, min(b) AS b FROM r GROUP BY a
)
SELECT s.doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(b, s.doc_id)) AS component_id, coalesce(n_links, 0) AS n_links
FROM sets s LEFT JOIN reach ON a = s.doc_id LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) l ON l.a = s.doc_id
"""
