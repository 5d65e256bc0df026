"""Near-duplicate test of given pairs of texts, and classes of a whole table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.batches import pieces
from vellum.functions.text import match_text, tokens
from vellum.operators.joins import hinted, is_small
from vellum.operators.staging import scratch, settled, staged

CONTAINED_CHARS, SAME_SHARE = 40, 0.9
#: Bytes of a gram; a window of ``CONTAINED_CHARS`` bytes is known by the least hash of its grams.
GRAM = 16
#: Windows of a text among which the rarest is sought in other texts.
PROBES = 16
KEYS_PER_BATCH = 100_000
#: Words whose frequencies order the words of a text; the others count as rarer.
COMMON_WORDS = 100_000
#: Word sets in which frequencies are counted, about.
SAMPLED_SETS = 20_000
#: Bits that tell which windows are sought; 16 MB.
SLOTS = 1 << 27
#: Bits of a word set, one for each class of hashes; and fewer of them, which go with each of its first words.
PARITY_BITS, FIRST_BITS = 1024, 128
FIRST = [f"bits_{k}" for k in range(FIRST_BITS // 64)]
#: Numbers that are broadcast at most, 8 bytes each.
FEW_ENDS = 1_000_000

Keep = Callable[[DataFrame], DataFrame]


def are_near(a: Column, b: Column) -> Column:
    """Equal, one of enough characters inside the other, or nine tenths of the words in common; both sides in match form."""
    left, right = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    inside = ((F.length(a) >= CONTAINED_CHARS) & F.contains(b, a)) | ((F.length(b) >= CONTAINED_CHARS) & F.contains(a, b))
    share = F.try_divide(F.size(F.array_intersect(left, right)).cast("double"), F.size(F.array_union(left, right)).cast("double"))
    return (a == b) | inside | F.coalesce(share >= SAME_SHARE, F.lit(False))


def near_duplicate_pairs(texts: DataFrame, pairs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``left_id, right_id, duplicate`` of the given pairs."""
    own = texts.select(F.col(id_col).alias("id"), match_text(F.col(text_col)).alias("m"))
    both = pairs.join(own.select(F.col("id").alias("left_id"), F.col("m").alias("a")), "left_id").join(own.select(F.col("id").alias("right_id"), F.col("m").alias("b")), "right_id")
    return both.select("left_id", "right_id", are_near(F.col("a"), F.col("b")).alias("duplicate"))


def window_keys(text: str) -> np.ndarray:
    """Distinct least gram hashes of all windows of ``CONTAINED_CHARS`` bytes; those of a text are among those of any text around it."""
    raw = np.frombuffer(text.encode(), np.uint8)
    hashes = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    step = 1
    while step < GRAM:
        hashes = hashes[:-step] * np.uint64(0xBF58476D1CE4E5B9) + (hashes[step:] ^ (hashes[step:] >> np.uint64(29)))
        step *= 2
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0x94D049BB133111EB)
    width, step = CONTAINED_CHARS - GRAM + 1, 1
    while 2 * step <= width:
        hashes = np.minimum(hashes[:-step], hashes[step:])
        step *= 2
    rest = width - step
    least = np.minimum(hashes[: len(hashes) - rest], hashes[rest:])
    return np.unique(least).view(np.int64)


def with_windows(nodes: DataFrame, most: int | None = None, sought: Broadcast | None = None) -> DataFrame:
    """``n, chars, key`` of the windows of each text that is long enough; ``most`` keeps the least keys only, ``sought`` those whose bit is set."""
    schema = pa.schema([("n", pa.int64()), ("chars", pa.int32()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if sought is None else np.frombuffer(sought.value, np.uint8)
        for batch in batches:
            own, held = [], 0
            for n, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                keys = window_keys(text)[:most]
                if bits is not None:
                    slot = keys & (SLOTS - 1)
                    keys = keys[(bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1]
                own.append((np.full(len(keys), n), np.full(len(keys), len(text), np.int32), keys))
                held += len(keys)
                if held >= KEYS_PER_BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*own, strict=True)], schema=schema)
                    own, held = [], 0
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*own, strict=True)], schema=schema)

    return nodes.filter(F.length("m") >= CONTAINED_CHARS).select("n", "m").mapInArrow(run, "n bigint, chars int, key bigint")


def key_bits(keys: DataFrame) -> Broadcast:
    """One bit of ``SLOTS`` for each key; a bit may be shared, so it rules keys out only. Its size doesn't depend on the rows."""
    slot = F.col("key").bitwiseAND(SLOTS - 1)
    parts = keys.select(F.shiftright(slot, 15).alias("part"), slot.bitwiseAND((1 << 15) - 1).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = bytearray(SLOTS // 8)
    for part, bits in parts.collect():
        out[part << 12 : (part + 1) << 12] = bits
    return keys.sparkSession.sparkContext.broadcast(bytes(out))


def contained_candidates(nodes: DataFrame, keep: Keep = staged) -> DataFrame:
    """``a, b``: all pairs in which ``a`` may lie inside ``b``. A text is sought by the rarest of some of its windows, and only if none of them is its own alone.

    Only windows that some text is sought by are shuffled.
    """
    probes = keep(with_windows(nodes, PROBES))
    windows = keep(with_windows(nodes, sought=key_bits(probes)))
    counts = windows.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > 1)
    found = probes.join(counts, "key", "left")
    rarest = found.groupBy("n").agg(F.min_by("key", F.struct("df", "key")).alias("key"), F.max("chars").alias("size"), F.count(F.lit(1)).alias("sought"), F.count("df").alias("found"))
    needles = settled(rarest.filter(F.col("sought") == F.col("found")).select(F.col("n").alias("a"), "key", "size"))
    return windows.join(hinted(needles, is_small(needles)), "key").filter(F.col("chars") > F.col("size")).select("a", F.col("n").alias("b"))


def word_sets(nodes: DataFrame, keep: Keep = staged) -> DataFrame:
    """``n, set, words`` of each text: a digest of its distinct words, and their 64-bit hashes in order. Texts are taken apart only here."""
    words = F.array_distinct(tokens(F.col("m")))
    rows = nodes.select("n", words.alias("words"))
    return keep(rows.select("n", F.unhex(F.sha2(F.array_join(F.array_sort("words"), " "), 256)).alias("set"), F.sort_array(F.transform("words", lambda w: F.xxhash64(w))).alias("words"))).filter(F.size("words") > 0)


def common_words(sets: DataFrame) -> Broadcast:
    """Hashes of words in ascending order, and in how many sets of a sample each is.

    They only put words in an order, and any order is complete, so a sample
    costs no pair.
    """
    size = sets.count()
    some = sets.sample(min(1.0, SAMPLED_SETS / size), seed=1) if size else sets
    rows = some.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "word").limit(COMMON_WORDS).collect()
    found = np.array(sorted(map(tuple, rows)) or [(0, 0)], np.int64)
    return sets.sparkSession.sparkContext.broadcast((found[:, 0].copy(), found[:, 1].copy()))


def parities(batch: pa.RecordBatch, bits: int) -> np.ndarray:
    """For each row of ``n, words``, whether an odd number of its words fall on each bit, as 64-bit numbers."""
    size = np.asarray(batch.column(1).value_lengths())
    slot = np.repeat(np.arange(len(size)) * bits, size) + (batch.column(1).flatten().to_numpy() & (bits - 1))
    odd = np.bincount(slot, minlength=len(size) * bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(size), bits // 64)


def first_words(sets: DataFrame) -> DataFrame:
    """``n, size, at, word``: the rarest tenth of each set's words, with the set's parities in ``FIRST``. Sets of fewer than nine words are within nine tenths of equal sets only."""
    known = common_words(sets)
    schema = pa.schema([("n", pa.int64()), ("size", pa.int32()), ("at", pa.int32()), ("word", pa.int64()), *((c, pa.int64()) for c in FIRST)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, df = known.value
        for batch in (piece for whole in batches for piece in pieces(whole)):
            n, words = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy()
            size = np.asarray(batch.column(1).value_lengths())
            place = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
            row = np.repeat(np.arange(len(n)), size)
            words = words[np.lexsort((words, np.where(keys[place] == words, df[place], 0), row))]
            at = np.arange(len(words)) - np.repeat(np.cumsum(size) - size, size)
            first = at < (size - (9 * size + 9) // 10 + 1)[row]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((n[row[first]], size[row[first]].astype(np.int32), at[first].astype(np.int32), words[first], *parities(batch, FIRST_BITS)[row[first]].T), schema, strict=True)], schema=schema)

    return sets.filter(F.size("words") >= 9).select("n", "words").mapInArrow(run, ", ".join(["n bigint", "size int", "at int", "word bigint", *(f"{c} bigint" for c in FIRST)]))


def with_parities(sets: DataFrame) -> DataFrame:
    """``n, size, bits``: whether an odd number of a set's words fall on each bit. Two sets differ in no fewer words than bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole)):
            bits = pa.FixedSizeListArray.from_arrays(pa.array(parities(batch, PARITY_BITS).ravel()), PARITY_BITS // 64).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).value_lengths().cast(pa.int32()), bits], names=["n", "size", "bits"])

    return sets.select("n", "words").mapInArrow(run, "n bigint, size int, bits array<bigint>")


def word_candidates(sets: DataFrame, keep: Keep = staged) -> DataFrame:
    """``a, b``: all pairs of word sets that may share nine tenths; a prefix filter.

    In any one order of words two such sets meet in their first tenths. The
    rarest words come first, so that few others meet there. Most pairs that
    meet by chance are told by parities: by a few where they meet, so that they
    don't become rows, and then by all.
    """
    firsts = keep(first_words(sets))
    left, right = (firsts.select(F.col("n").alias(x), F.col("size").alias(f"{x}_size"), F.col("at").alias(f"{x}_at"), "word", *(F.col(c).alias(f"{x}_{c}") for c in FIRST)) for x in "ab")
    a, b = F.col("a_size"), F.col("b_size")
    ahead = F.least(a - F.col("a_at"), b - F.col("b_at"))
    # The most words in common if this is the first one.
    meets = (10 * a >= 9 * b) & ((a < b) | ((a == b) & (F.col("a") < F.col("b")))) & (19 * ahead >= 9 * (a + b))
    few_apart = reduce(Column.__add__, [F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in FIRST])
    pairs = keep(left.join(right, "word").filter(meets & (19 * few_apart <= a + b)).select("a", "b").distinct())
    known = keep(with_parities(sets))
    for x in "ab":
        pairs = pairs.join(known.select(F.col("n").alias(x), F.col("size").alias(f"{x}_size"), F.col("bits").alias(f"{x}_bits")), x)
    apart = F.aggregate(F.zip_with("a_bits", "b_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return pairs.filter(19 * apart <= a + b).select("a", "b")


def of_ends(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows whose ``n`` is an end of a pair."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("n")).distinct()
    return rows.join(hinted(ends, is_small(ends, FEW_ENDS)), "n", "left_semi")


def sharing(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` that share nine tenths of their words."""
    asked = of_ends(sets, pairs)
    left, right = (asked.select(F.col("n").alias(x), F.col("words").alias(f"{x}_words")) for x in "ab")
    shared = F.size(F.array_intersect("a_words", "b_words"))
    return settled(pairs.join(left, "a").join(right, "b").filter(19 * shared >= 9 * (F.size("a_words") + F.size("b_words"))).select("a", "b"))


def holding(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` of which ``a`` lies inside ``b``."""
    asked = of_ends(texts, pairs)
    left, right = (asked.select(F.col("n").alias(x), F.col("m").alias(f"{x}_text")) for x in "ab")
    return settled(pairs.join(left, "a").join(right, "b").filter(F.contains("b_text", F.col("a_text"))).select("a", "b"))


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends no link has joined yet; the others would add nothing."""
    a_root, b_root = (roots.select(F.col("n").alias(x), F.col("root").alias(f"{x}_root")) for x in "ab")
    return settled(pairs.join(a_root, "a", "left").join(b_root, "b", "left").filter(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b"))


def least_reachable(links: DataFrame) -> DataFrame:
    """``n, root`` of every end of the links ``a, b``: the least one reachable, by rounds of star contraction."""
    edges, before = settled(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), None
    while True:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = around.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select("m", F.explode(F.array("a", "b")).alias("b")).filter(F.col("m") != F.col("b"))
        edges = settled(small.select(F.col("m").alias("a"), "b").distinct())
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return edges.select(F.col("b").alias("n"), F.col("a").alias("root"))
        before = state


def without(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Rows whose ``n`` is not among the others, which are mostly few."""
    return rows.join(hinted(others, is_small(others, FEW_ENDS)), "n", "left_anti")


def near_duplicate_classes(texts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, class_size`` of every row: classes joined by all near-duplicate pairs of the table.

    No link is lost: equal texts are one node, equal word sets are linked, and
    the candidate searches for contained texts and shared words are complete;
    texts, or hashes of all words, then decide as ``are_near`` does. Each set is
    compared with one candidate first; texts and words are not sent for pairs
    that this has joined already. A class's id is the least id in it, null if it
    has no other. A null text is near to nothing and a class of its own. The
    number of candidate pairs grows with the square of a group of unequal texts
    that all hold the same rare words or windows.
    """
    forms = texts.select(F.col(id_col).alias("doc_id"), match_text(F.col(text_col)).alias("m"))
    with scratch(texts.sparkSession) as keep:
        with scratch(texts.sparkSession) as keep_texts:
            rows = keep_texts(forms.select(F.monotonically_increasing_id().alias("n"), "doc_id", F.unhex(F.sha2("m", 256)).alias("sha"), "m"))
            keyed = rows.select("n", "doc_id", "sha").filter(F.col("sha").isNotNull())
            of_sha = settled(keyed.select("n", "sha").join(keyed.groupBy("sha").agg(F.min("n").alias("node")), "sha").select("n", "node"))
            nodes = without(rows.select("n", "m").filter(F.col("m").isNotNull()), of_sha.filter(F.col("n") != F.col("node")).select("n"))
            with scratch(texts.sparkSession) as keep_windows:
                inside = settled(contained_candidates(nodes, keep_windows))
            ends = keep(of_ends(nodes, inside))
            worded = word_sets(nodes, keep)
            owned = settled(keyed.select("n", "doc_id").join(of_sha, "n").select("doc_id", "node"))
            alone = settled(rows.filter(F.col("sha").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size")))
        members = worded.select("n", "set")
        same_words = settled(members.join(members.groupBy("set").agg(F.min("n").alias("a")), "set").filter(F.col("n") != F.col("a")).select("a", F.col("n").alias("b")))
        sets = without(worded.select("n", "words"), same_words.select(F.col("b").alias("n")))
        with scratch(texts.sparkSession) as keep_words:
            pairs = settled(word_candidates(sets, keep_words))
        found = same_words.unionByName(sharing(sets, settled(pairs.groupBy("b").agg(F.min("a").alias("a")))))
        joined = least_reachable(found)
        links = found.unionByName(sharing(sets, apart(pairs, joined))).unionByName(holding(ends, apart(inside, joined)))
    roots = least_reachable(links).withColumnRenamed("n", "node")
    held = owned.join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))
    classes = held.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return held.join(classes, "root").select("doc_id", "class_id", "class_size").unionByName(alone)
