"""SimHash near-duplicates: fingerprints, a binary trie self-join, and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import cut, join_by_size, map_rows, quoted, text_of
from vellum.llm.components import components

BITS = 64
HALF = BITS // 2
SEED = 42
#: Pairs of nodes that are compared value by value once their product is this small.
LEAF_PAIRS = 64
#: Fingerprints that a node has at most when node pairs are dealt out.
NODE_SIZE = 1 << 15
#: Levels at which node pairs may be dealt out.
DEEPEST = 16
#: Node pairs, or pairs of values, that are handled at once.
PAIRS_AT_ONCE = 1 << 17
#: Rows of node pairs that a task walks together.
ROWS_AT_ONCE = 500_000
PAIR = ("half", "low", "high")


def fingerprint(text: str, width: int = 3) -> int:
    """Bits that are set in over half of the hashes of the text's word shingles."""
    words = text.encode().lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], dtype=">u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        some = hashes[at : at + 4096]
        ones += np.unpackbits(some.view(np.uint8).reshape(len(some), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``doc_id, fp``; the 64 bits are stored as a signed integer."""

    def start():
        def one(doc_id: int | None, text: str) -> Iterator[tuple]:
            fp = fingerprint(text, width)
            yield doc_id, fp - (fp >> 63 << 64)

        return one

    return map_rows(docs, [F.col(quoted(id_col)).cast("bigint"), text_of(quoted(text_col))], "doc_id bigint, fp bigint", start)


class Forest:
    """Union-find over positions, a batch of links at a time; the links that are kept form a spanning forest."""

    def __init__(self, size: int) -> None:
        self.parent = np.arange(size)

    def roots(self, of: np.ndarray) -> np.ndarray:
        while (up := self.parent[of]).size and (up != of).any():
            of = up
        return of

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        """Hang the greater root of each link on the least root that it is linked with, until every link lies in one tree."""
        ends = np.concatenate([left, right])
        while len(left):
            a, b = self.roots(left), self.roots(right)
            apart = a != b
            left, right, a, b = left[apart], right[apart], a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
        self.parent[ends] = self.roots(ends)


def trie_links(values: np.ndarray, pairs: tuple[np.ndarray, ...], budget: int, forest: Forest) -> tuple[int, int]:
    """Link the values below each pair of nodes that differ in at most ``budget`` bits, half of them in the upper half.

    ``pairs`` holds the bounds ``a0, a1, b0, b1`` of sorted ranges. A range is
    read as a binary trie: a node is a range of values with a common prefix.
    All node pairs of one depth are walked together. A pair of sides 0 and 1
    costs one bit; a pair over the budget (of its half), or with an empty side,
    is dropped with all that lies below it. Small pairs are compared value by
    value. Returns how many node pairs were visited and how many pairs of
    values compared.
    """
    keep = (pairs[1] > pairs[0]) & (pairs[3] > pairs[2])
    stack = [(BITS - 1, *(x[keep] for x in pairs), np.zeros(int(keep.sum()), np.int8))]
    visited = compared = 0
    while stack:
        bit, a0, a1, b0, b1, cost = stack.pop()
        if len(a0) == 0:
            continue
        if len(a0) > PAIRS_AT_ONCE:
            half = len(a0) // 2
            stack += [(bit, a0[s], a1[s], b0[s], b1[s], cost[s]) for s in (slice(half, None), slice(0, half))]
            continue
        visited += len(a0)
        small = ((a1 - a0) * (b1 - b0) <= LEAF_PAIRS) | (bit < 0)
        compared += compare_leaves(values, a0[small], a1[small], b0[small], b1[small], budget, forest)
        a0, a1, b0, b1, cost = (x[~small] for x in (a0, a1, b0, b1, cost))
        if len(a0) == 0:
            continue
        am, bm = first_with_bit(values, a0, a1, bit), first_with_bit(values, b0, b1, bit)
        same = (a0 == b0) & (a1 == b1)
        cross = cost < (budget // 2 if bit >= HALF else budget)
        parts = [(a0, am, b0, bm, cost, slice(None)), (am, a1, bm, b1, cost, slice(None)), (a0, am, bm, b1, cost + np.int8(1), cross), (am, a1, b0, bm, cost + np.int8(1), cross & ~same)]
        nxt = [np.concatenate([p[k][p[5]] for p in parts]) for k in range(5)]
        some = (nxt[1] > nxt[0]) & (nxt[3] > nxt[2])
        stack.append((bit - 1, *(x[some] for x in nxt)))
    return visited, compared


def first_with_bit(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """In each sorted range of equal higher bits, the place of the first value with ``bit`` set."""
    lo, hi = lo.copy(), hi.copy()
    mask = np.uint64(1 << bit)
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        one = open_ & ((values[np.minimum(mid, len(values) - 1)] & mask) != 0)
        hi = np.where(one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def compare_leaves(values: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, budget: int, forest: Forest) -> int:
    """Compare all pairs of the given ranges, a bounded number at a time; returns their number."""
    if len(a0) == 0:
        return 0
    size = (a1 - a0) * (b1 - b0)
    ends = np.cumsum(size)
    done = 0
    while done < len(size):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS_AT_ONCE, side="right")))
        part = slice(done, upto)
        n = size[part]
        which = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        wide = (b1 - b0)[part][which]
        left, right = a0[part][which] + within // wide, b0[part][which] + within % wide
        near = (left != right) & (np.bitwise_count(values[left] ^ values[right]) <= budget)
        forest.link(left[near], right[near])
        done = upto
    return int(ends[-1])


def dealing_depth(turned: DataFrame, node_size: int) -> int:
    """The least depth at which no node of either trie has more than ``node_size`` values; at most ``DEEPEST``."""
    lowest = F.shiftrightunsigned("turned", BITS - DEEPEST)
    counts = turned.groupBy("half", lowest.alias("node")).agg(F.count(F.lit(1)).alias("n"))
    above = counts.select("half", "node", "n", F.explode(F.sequence(F.lit(0), F.lit(DEEPEST))).alias("depth"))
    node = F.expr(f"shiftrightunsigned(node, {DEEPEST} - depth)")
    largest = above.groupBy("half", "depth", node.alias("node")).agg(F.sum("n").alias("n")).groupBy("depth").agg(F.max("n").alias("n"))
    found = largest.filter(F.col("n") <= node_size).agg(F.min("depth")).first()[0]
    return DEEPEST if found is None else found


def links(distinct: DataFrame, *, budget: int = 3, node_size: int = NODE_SIZE) -> DataFrame:
    """Links ``a, b`` that join all fingerprints ``fp`` within ``budget`` bits of each other.

    Two such fingerprints differ in at most ``budget // 2`` bits of one of their
    halves. So there are two binary tries over all distinct fingerprints, one of
    them with the halves exchanged, and in each the walk over node pairs may
    spend that many bits on the upper half and the whole budget in all. The
    pairs of nodes of one depth that the upper half's budget allows are dealt
    out, and each task walks down from its pairs: at depth ``d`` a fingerprint
    goes to ``1 + d`` of them for the default budget. The depth follows the
    largest node, so a task's share does not grow with the table. A task keeps a
    spanning forest of the links it finds, which joins the same fingerprints as
    all of them.
    """
    fp = F.col("fp")
    exchanged = F.shiftleft(fp, HALF).bitwiseOR(F.shiftrightunsigned(fp, HALF))
    turned = distinct.select(F.posexplode(F.array(fp, exchanged)).alias("half", "turned"))
    depth = dealing_depth(turned, node_size)
    near = [x for x in range(1 << depth) if x.bit_count() <= budget // 2]
    own = F.shiftrightunsigned("turned", BITS - depth) if depth else F.lit(0).cast("bigint")
    dealt = turned.withColumn("own", own).withColumn("other", F.explode(F.array(*[F.col("own").bitwiseXOR(F.lit(x)) for x in near])))
    dealt = dealt.select("half", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("side"), "turned")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def join(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        values = rows["turned"].view(np.uint64)
        lo = np.flatnonzero(np.concatenate([[True], np.any([rows[n][1:] != rows[n][:-1] for n in PAIR], axis=0)]))
        hi = np.concatenate([lo[1:], [len(values)]])
        apart = rows["low"][lo] != rows["high"][lo]
        middle = lo + np.add.reduceat(~rows["side"], lo, dtype=np.int64)
        forest = Forest(len(values))
        trie_links(values, (lo, np.where(apart, middle, hi), np.where(apart, middle, lo), hi), budget, forest)
        child = np.flatnonzero(forest.parent != np.arange(len(values)))
        if len(child):
            first = rows["half"][child] == 0
            ends = [np.where(first, x, (x << np.uint64(HALF)) | (x >> np.uint64(HALF))).view(np.int64) for x in (values[forest.parent[child]], values[child])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in ends], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] | None = None
        for batch in batches:
            new = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in (*PAIR, "side", "turned")}
            kept = new if kept is None else {n: np.concatenate([kept[n], new[n]]) for n in new}
            if len(kept["turned"]) < ROWS_AT_ONCE:
                continue
            last = np.flatnonzero(np.any([kept[n] != kept[n][-1] for n in PAIR], axis=0))
            at = int(last[-1]) + 1 if len(last) else 0
            if at:
                yield from join({n: x[:at] for n, x in kept.items()})
                kept = {n: x[at:] for n, x in kept.items()}
        if kept is not None and len(kept["turned"]):
            yield from join(kept)

    order = [*map(F.col, PAIR), F.col("turned").bitwiseXOR(F.lit(-(2**63)))]
    return dealt.repartition(*PAIR).sortWithinPartitions(*order).mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 3, node_size: int = NODE_SIZE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    A component joins fingerprints by links of at most ``budget`` differing
    bits; its id is the least id in it. Documents of one fingerprint are one
    node, so a group of copies is never expanded. A text without words, or null,
    has fingerprint zero and is linked like any other. Null ids are ignored in
    the least id; a component without any other id has a null one.
    """
    rows = cut(fingerprints(docs, id_col=id_col, text_col=text_col, width=width))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size")))
    roots = components(links(nodes.select("fp"), budget=budget, node_size=node_size))
    joined = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "size", F.coalesce("root", "fp").alias("root"))
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = cut(joined.join(ids, "root").select("fp", "component_id", "size"))
    return join_by_size(rows, of_fp, ["fp"], "size").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
