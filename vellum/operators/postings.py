"""A stored inverted index for lexical search (J6, A1-A4, W4, W5): searches read postings and never texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.text import STOP_WORDS, tokens
from vellum.functions.varints import gaps, heads, pack, summed, unpack
from vellum.operators.joins import hinted, is_small
from vellum.operators.lexical import CANDIDATES, MAX_TERMS, PART, chosen_terms, idf, parts, query_terms, searchable
from vellum.operators.staging import staged
from vellum.sources.versions import Versions

#: Folders of postings, by a hash of the token; a search opens those of its tokens.
BUCKETS = 64
#: Postings of a block, more only where a slice of a batch holds more at once.
BLOCK = 4_096
#: Chunks fall into so many slices by a hash of their id; a block holds whole slices, or a part of one.
SLICES = 64
#: Tokens of a batch that are grouped at once.
TOKENS_AT_ONCE = 500_000
#: Blocks that are decoded at once.
BLOCKS_AT_ONCE = 256
#: A token with more postings than this is spread over tasks by slices when the index is written.
SPREAD = 1_000_000
#: A query's rarest terms are read whole until they have this many times the wanted results.
LEAD = 8
#: Bounds, which are sums of doubles, and scores differ from the true sums by less.
MARGIN = 1e-9

GROUPED = "token string, searchable boolean, slice int, n int, ids array<bigint>, counts array<int>, places array<int>"
BLOCKS = "token string, searchable boolean, bucket int, slice_low int, slice_high int, first bigint, last bigint, n int, ids binary, counts binary, places binary"


def mixed(ids: np.ndarray) -> np.ndarray:
    """A slice number for each id, from the id alone."""
    x = ids.astype(np.uint64)
    for _ in range(2):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return ((x ^ (x >> np.uint64(33))) % np.uint64(SLICES)).astype(np.int32)


@F.pandas_udf(T.IntegerType())
def slice_of(ids: pd.Series) -> pd.Series:
    return pd.Series(mixed(ids.to_numpy(np.int64)))


def lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values, kind))


def group(batch: pa.RecordBatch, sizes: np.ndarray) -> pa.RecordBatch:
    """Groups of a batch whose chunk ids ascend; ``sizes`` has its chunks' numbers of tokens."""
    users, ids, ready, words = batch.columns
    ids, flat, owners = ids.to_numpy(), words.flatten().dictionary_encode(), users.dictionary_encode()
    owner_codes = np.nan_to_num(owners.indices.to_numpy(zero_copy_only=False), nan=len(owners.dictionary)).astype(np.int64)
    chunk = np.repeat(np.arange(len(ids)), sizes)
    place = np.arange(len(chunk)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = (owner_codes * 2 + ready.to_numpy(zero_copy_only=False).astype(np.int64)) * SLICES + mixed(ids)
    key = flat.indices.to_numpy().astype(np.int64) * (2 * SLICES * (len(owners.dictionary) + 1)) + own[chunk]
    by = np.argsort(key, kind="stable")  # chunks and places stay ascending within a key
    key, chunk, place = key[by], chunk[by], place[by]
    posting = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])]))
    first = np.flatnonzero(np.concatenate([[True], key[posting][1:] != key[posting][:-1]]))  # of each group, among postings
    head = posting[first]
    at, word = chunk[head], flat.indices.to_numpy()[by][head]
    counts = np.diff(np.append(posting, len(key)))
    numbers = np.diff(np.append(first, len(posting))).astype(np.int32)
    columns = [users.take(pa.array(at)), flat.dictionary.take(pa.array(word)), ready.take(pa.array(at)), pa.array(mixed(ids[at])), pa.array(numbers)]
    columns += [lists(ids[chunk[posting]], first, pa.int64()), lists(counts, first, pa.int32()), lists(place, head, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["user_id", "token", "searchable", "slice", "n", "ids", "counts", "places"])


def grouped(chunks: DataFrame) -> DataFrame:
    """Each batch's postings by tenant, token, readiness and slice: chunk ids, and each one's places of the token."""
    owner = chunks.schema["user_id"].dataType
    schema = T.StructType([T.StructField("user_id", owner), *T._parse_datatype_string(GROUPED).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column(1)))
            sizes = pc.fill_null(pc.list_value_length(batch.column(3)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            piece = np.cumsum(sizes) // TOKENS_AT_ONCE
            cuts = np.flatnonzero(np.diff(piece, prepend=-1, append=-1))
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if sizes[low:high].any():
                    yield group(batch.slice(low, high - low), sizes[low:high])

    return chunks.mapInArrow(run, schema)


def changes(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before."""
    codes = column.dictionary_encode()
    numbers = np.nan_to_num(codes.indices.to_numpy(zero_copy_only=False), nan=-1).astype(np.int64)
    return np.diff(numbers, prepend=-2) != 0


def blocks_of(rows: DataFrame) -> DataFrame:
    """Blocks from groups that lie sorted by bucket, tenant, token, readiness and slice.

    A rare token's slices share one block; a frequent one's are parted where a
    block is full. Each batch is coded as a whole, so a token's block may end
    with it.
    """
    schema = T.StructType([rows.schema["user_id"], *T._parse_datatype_string(BLOCKS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            user, bucket, token, ready, slices, n, ids, counts, places = (batch.column(batch.schema.get_field_index(c)) for c in ("user_id", "bucket", "token", "searchable", "slice", "n", "ids", "counts", "places"))
            n = n.to_numpy().astype(np.int64)
            new = changes(token) | changes(user) | changes(ready)
            before = heads(n)
            run_starts = np.flatnonzero(new)
            full = (before - np.repeat(before[run_starts], np.diff(np.append(run_starts, len(n))))) // BLOCK
            starts = np.flatnonzero(new | (np.diff(full, prepend=0) != 0))
            of_row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(n))))
            of_posting = np.repeat(of_row, n)
            ids, counts, places = (x.flatten().to_numpy().astype(np.int64) for x in (ids, counts, places))
            by = np.lexsort((ids, of_posting))
            moved = np.repeat(heads(counts)[by] - heads(counts[by]), counts[by]) + np.arange(len(places))
            ids, counts, places = ids[by], counts[by], places[moved]
            sizes = np.bincount(of_posting, minlength=len(starts))
            first = heads(sizes)
            ends = np.append(starts[1:], len(n)) - 1
            steps = gaps(ids, first)
            steps[first] = 0
            of_block = heads(np.add.reduceat(counts, first))
            at = pa.array(starts)
            columns = [user.take(at), token.take(at), ready.take(at), bucket.take(at), slices.take(at), slices.take(pa.array(ends)), pa.array(ids[first]), pa.array(ids[first + sizes - 1]), pa.array(sizes.astype(np.int32))]
            columns += [pack(steps, first), pack(counts, first), pack(gaps(places, heads(counts)), of_block)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)


def decoded(blocks: DataFrame, *, places: bool = False) -> DataFrame:
    """``user_id, token, searchable, segment, chunk_id`` of each posting, and on demand its ``places``."""
    keep = ["user_id", "token", "searchable", "segment"]
    schema = T.StructType([*[blocks.schema[c] for c in keep], T.StructField("chunk_id", T.LongType()), *([T.StructField("places", T.ArrayType(T.IntegerType()))] if places else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCKS_AT_ONCE):
                part = batch.slice(low, BLOCKS_AT_ONCE)
                sizes = part.column(5).to_numpy().astype(np.int64)
                steps = unpack(part.column(6))
                steps[heads(sizes)] = part.column(4).to_numpy()
                rows = pa.array(np.repeat(np.arange(part.num_rows), sizes))
                columns = [*[part.column(i).take(rows) for i in range(4)], pa.array(summed(steps, sizes))]
                if places:
                    counts = unpack(part.column(7))
                    columns.append(lists(summed(unpack(part.column(8)), counts), heads(counts), pa.int32()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return blocks.select(*keep, "first", "n", "ids", *(["counts", "places"] if places else [])).mapInArrow(run, schema)


class PostingsIndex:
    """Postings of all chunks in a folder, changed document by document, and read by version.

    Each change is a segment: blocks of postings partitioned by a bucket of the
    token, with gap-coded chunk ids and places; the documents that the chunks
    belong to; each tenant's change in chunks (A1). A segment may replace
    documents of earlier ones, whose chunks are then listed as dead. Postings of
    documents that search may show (P1) lie in blocks of their own, so how many
    chunks have a term (A2) is read from the blocks' numbers where nothing is
    dead. A score is a sum over distinct terms, so a term's IDF is the bound of
    each of its blocks.

    Chunk ids are whole numbers; document ids and tenants are of any type.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Versions(spark, path)

    def folder(self, part: str, segment: str) -> str:
        return f"{self.path}/{part}/segment={segment}"

    def live(self, part: str, segments: list[str]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{part}").parquet(*[self.folder(part, s) for s in segments]).withColumn("segment", F.col("segment").cast("string"))

    def update(self, chunks: DataFrame, documents: DataFrame) -> int:
        """Index the chunks of ``documents``, in place of what the index has of these; documents without chunks only go.

        ``chunks`` has ``chunk_id, document_id, user_id, text``; ``documents`` has
        ``document_id, user_id, status, is_active, chunk_count``. The segment is
        written first and committed last; another writer's commit in between
        makes the list of dead chunks anew.
        """
        name = "s" + uuid.uuid4().hex
        ready = searchable(documents).select("user_id", "document_id", F.lit(True).alias("is_ready"))
        known = documents.select("user_id", "document_id").distinct()
        flagged = chunks.filter(F.col("chunk_id").isNotNull()).join(known, ["user_id", "document_id"], "left_semi").join(ready, ["user_id", "document_id"], "left").withColumn("searchable", F.coalesce("is_ready", F.lit(False)))
        flagged.select("user_id", "document_id", "chunk_id").write.parquet(self.folder("owners", name))
        counted = documents.withColumn("counted", F.when((F.col("status") == "ready") & F.col("is_active"), F.coalesce("chunk_count", F.lit(0))))
        counted.select("user_id", "document_id", F.col("counted").cast("bigint")).write.parquet(self.folder("documents", name))
        self.write_blocks(grouped(flagged.select("user_id", "chunk_id", "searchable", tokens(F.col("text")).alias("tokens"))), name)
        return self.publish(name)

    def write_blocks(self, pieces: DataFrame, name: str) -> None:
        """Sort pieces into blocks; a token with very many postings is dealt to several tasks by its slices."""
        pieces = staged(pieces.withColumn("bucket", self.bucket()))
        wide = pieces.groupBy("token").agg(F.sum("n").alias("total")).filter(F.col("total") > SPREAD).select("token", F.lit(True).alias("wide"))
        dealt = pieces.join(hinted(wide, is_small(wide)), "token", "left").withColumn("part", F.when(F.col("wide"), F.col("slice")).otherwise(-1)).drop("wide")
        dealt = dealt.repartition("bucket", "part").sortWithinPartitions("bucket", "user_id", "token", "searchable", "slice")
        blocks_of(dealt).write.partitionBy("bucket").parquet(self.folder("postings", name))

    def has_postings(self, name: str) -> bool:
        return any(f.isDirectory() for f in self.versions.files.listStatus(self.versions.hadoop(self.folder("postings", name))))

    def remove(self, documents: DataFrame) -> int:
        """Take documents, given by ``user_id, document_id``, out of the index."""
        none = documents.select("user_id", "document_id", F.lit("removed").alias("status"), F.lit(False).alias("is_active"), F.lit(0).alias("chunk_count"))
        schema = self.live("owners", self.versions.state()["segments"][:1]).schema
        chunks = self.spark.createDataFrame([], T.StructType([*[f for f in schema if f.name != "segment"], T.StructField("text", T.StringType())]))
        return self.update(chunks, none)

    @staticmethod
    def bucket():  # noqa: ANN205
        return F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int")

    def publish(self, name: str) -> int:
        def step(state: dict) -> dict:
            before = state.get("segments", [])
            new = self.live("documents", [name])
            change, hidden = new.select("user_id", F.col("counted").alias("n")), f"{name}-{len(before)}-{uuid.uuid4().hex[:8]}"
            dirty: list[str] = []
            if before:
                # A document's last word is in the newest segment that names it.
                order = F.create_map(*[F.lit(x) for i, s in enumerate(before) for x in (s, i)])
                last = self.live("documents", before).groupBy("user_id", "document_id").agg(F.max_by(F.struct("segment", "counted"), order[F.col("segment")]).alias("last"))
                old = staged(last.join(new.select("user_id", "document_id").distinct(), ["user_id", "document_id"], "left_semi").select("user_id", "document_id", "last.*"))
                change = change.unionByName(old.select("user_id", (-F.col("counted")).alias("n")))
                dead = self.live("owners", before).join(old.select("user_id", "document_id", "segment"), ["user_id", "document_id", "segment"], "left_semi").select(F.col("segment").alias("dead_segment"), "chunk_id")
                dead.write.parquet(self.folder("dead", hidden))
                dirty = [r[0] for r in self.live("dead", [hidden]).select("dead_segment").distinct().collect()]  # at most the number of segments
            change.groupBy("user_id").agg(F.sum("n").alias("n")).write.parquet(self.folder("sizes", hidden))
            filled = [*state.get("filled", []), *([name] if self.has_postings(name) else [])]
            return {"segments": [*before, name], "filled": filled, "sizes": [*state.get("sizes", []), hidden], "dead": [*state.get("dead", []), *([hidden] if dirty else [])], "dirty": sorted({*state.get("dirty", []), *dirty})}

        return self.versions.change(step)["version"]

    def merge(self) -> int:
        """Write all segments as one without what is dead; the old ones stay for readers of earlier versions.

        Another writer's commit in between makes this a no-op, to be tried again.
        """
        state = self.versions.state()
        segments, name = state.get("segments", []), "s" + uuid.uuid4().hex
        if len(segments) < 2 or not state["filled"]:
            return state["version"]
        live = self.alive(decoded(self.live("postings", state["filled"]), places=True), state)
        one = live.select("user_id", "token", "searchable", slice_of("chunk_id").alias("slice"), F.lit(1).alias("n"), F.array("chunk_id").alias("ids"), F.array(F.size("places")).alias("counts"), "places")
        self.write_blocks(one, name)
        owners = self.alive(self.live("owners", segments), state)
        owners.select("user_id", "document_id", "chunk_id").write.parquet(self.folder("owners", name))
        order = F.create_map(*[F.lit(x) for i, s in enumerate(segments) for x in (s, i)])
        last = self.live("documents", segments).groupBy("user_id", "document_id").agg(F.max_by(F.struct("counted"), order[F.col("segment")]).alias("last"))
        last.select("user_id", "document_id", "last.counted").write.parquet(self.folder("documents", name))
        self.live("sizes", state["sizes"]).groupBy("user_id").agg(F.sum("n").alias("n")).write.parquet(self.folder("sizes", name))

        def step(now: dict) -> dict | None:
            return {"segments": [name], "filled": [name] if self.has_postings(name) else [], "sizes": [name], "dead": [], "dirty": []} if now.get("segments") == segments else None

        return self.versions.change(step)["version"]

    def alive(self, rows: DataFrame, state: dict) -> DataFrame:
        """Rows by ``segment, chunk_id`` that no later segment has replaced."""
        if not state["dead"]:
            return rows
        dead = self.live("dead", state["dead"]).select(F.col("dead_segment").alias("segment"), "chunk_id").distinct()
        return rows.join(hinted(dead, is_small(dead)), ["segment", "chunk_id"], "left_anti")

    def frequencies(self, blocks: DataFrame, state: dict) -> DataFrame:
        """``user_id, term, df`` of single tokens that occur; numbers of blocks are summed where nothing is dead, ids are read elsewhere."""
        dirty = F.col("segment").isin(state["dirty"])
        shown = F.when(F.col("searchable"), F.col("n")).otherwise(0)
        parts = [blocks.filter(~dirty).select("user_id", "token", shown.alias("n"))]
        if state["dirty"]:
            parts.append(self.alive(decoded(blocks.filter(dirty)), state).select("user_id", "token", F.col("searchable").cast("int").alias("n")))
        return reduce(DataFrame.unionByName, parts).groupBy("user_id", F.col("token").alias("term")).agg(F.sum("n").cast("double").alias("df"))

    def phrases(self, blocks: DataFrame, phrases: DataFrame, state: dict, small: bool) -> DataFrame:
        """``user_id, term, searchable, segment, chunk_id`` where a phrase's tokens stand side by side."""
        parts = phrases.select("user_id", "term", F.size(F.split("term", " ")).alias("length"), F.posexplode(F.split("term", " ")).alias("nth", "token"))
        hits = self.alive(decoded(blocks.join(hinted(parts.select("user_id", "token").distinct(), small), ["user_id", "token"], "left_semi"), places=True), state)
        starts = hits.join(hinted(parts, small), ["user_id", "token"]).select("user_id", "term", "searchable", "segment", "chunk_id", "length", "nth", F.explode("places").alias("place"))
        whole = starts.groupBy("user_id", "term", "searchable", "segment", "chunk_id", "length", (F.col("place") - F.col("nth")).alias("start")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == F.col("length"))
        return whole.select("user_id", "term", "searchable", "segment", "chunk_id").distinct()

    def search(self, queries: DataFrame, *, limit: int = CANDIDATES, max_terms: int = MAX_TERMS, stop_words: list[str] = STOP_WORDS, scope: DataFrame | None = None, version: int | None = None) -> DataFrame:
        """What ``lexical_search`` gives, from the index alone.

        A query's rarest terms are read first, until they have several times the
        wanted results. If all its other terms together can't lift a chunk that
        has none of these above the worst result so far, then only those blocks
        of the others are read that hold a slice of a chunk still in the
        running. Any other query reads all its blocks; so none loses a result.
        """
        state = self.versions.state(version)
        if not state.get("filled"):
            raise ValueError(f"{self.path} has no chunks yet")
        terms = staged(query_terms(queries, stop_words=stop_words))
        small = is_small(terms)
        asked = terms.select("user_id", F.explode(F.split("term", " ")).alias("token")).distinct()
        buckets = [r[0] for r in asked.select(self.bucket().alias("b")).distinct().collect()]  # at most BUCKETS numbers
        stored = self.live("postings", state["filled"]).filter(F.col("bucket").isin(buckets))
        blocks = stored.join(hinted(asked, small), ["user_id", "token"], "left_semi")
        sizes = self.live("sizes", state["sizes"]).groupBy("user_id").agg(F.sum("n").cast("double").alias("n")).filter("n is not null")
        found = self.frequencies(blocks, state)
        phrases = staged(terms.filter(F.contains("term", F.lit(" "))).select("user_id", "term").distinct())
        pieces = None
        if not phrases.isEmpty():
            pieces = staged(self.phrases(blocks, phrases, state, small))
            found = found.unionByName(pieces.groupBy("user_id", "term").agg(F.sum(F.col("searchable").cast("int")).cast("double").alias("df")))
        weights = found.join(sizes, "user_id").withColumn("idf", idf(F.col("n"), F.col("df"))).select("user_id", "term", "df", "idf")
        chosen = staged(self.parted(chosen_terms(terms, weights, max_terms), limit))
        hits = self.hits(blocks, pieces, chosen.filter("leads"), state, small)
        if scope is not None:
            wanted = scope.select("query_id", "document_id").distinct()
            in_scope = self.alive(self.live("owners", state["segments"]), state).join(hinted(wanted, is_small(wanted)), "document_id").select("query_id", "segment", "chunk_id")
            hits = hits.join(in_scope, ["query_id", "segment", "chunk_id"], "left_semi")
        partial = staged(hits.groupBy("query_id", "user_id", "segment", "chunk_id").agg(F.sum(parts(F.col("idf"))).alias("sum")).withColumn("score", F.col("sum") / PART))
        worst = partial.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))).filter(F.col("place") == limit).select("query_id", F.col("score").alias("worst"))
        rest = chosen.groupBy("query_id").agg(F.max("rest").alias("rest"))
        bounds = staged(rest.join(worst, "query_id", "left").withColumn("closed", F.coalesce(F.col("rest") + MARGIN < F.col("worst"), F.lit(False))))
        others = chosen.filter(~F.col("leads")).join(hinted(bounds, small), "query_id")
        running = partial.join(hinted(bounds, small), "query_id").filter(~F.col("closed") | (F.col("score") + F.col("rest") + MARGIN >= F.col("worst"))).select("query_id", "user_id", "segment", "chunk_id", "sum", "closed")
        running = staged(running)
        needed = self.needed(running.filter("closed"), others.filter("closed"), small)
        open_tokens = others.filter(~F.col("closed")).select("user_id", F.col("term").alias("token")).distinct()
        late = self.covering(blocks, needed, open_tokens, small)
        more = self.hits(late, pieces, others, state, small)
        if scope is not None:
            more = more.join(in_scope, ["query_id", "segment", "chunk_id"], "left_semi")
        # A closed query's further hits count for chunks in the running only.
        more = more.join(bounds.select("query_id", "closed"), "query_id")
        own = more.filter(~F.col("closed")).select("query_id", "segment", "chunk_id", "idf").unionByName(more.filter("closed").join(running.select("query_id", "segment", "chunk_id"), ["query_id", "segment", "chunk_id"], "left_semi").select("query_id", "segment", "chunk_id", "idf"))
        own = own.select("query_id", "segment", "chunk_id", parts(F.col("idf")).alias("sum"))
        total = running.select("query_id", "segment", "chunk_id", "sum").unionByName(own).groupBy("query_id", "segment", "chunk_id").agg((F.sum("sum") / PART).alias("score"))
        best = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "chunk_id")
        top = staged(total.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit))
        owners = self.live("owners", state["segments"]).select("segment", "chunk_id", "document_id")
        return owners.join(hinted(top, is_small(top)), ["segment", "chunk_id"]).select("query_id", "chunk_id", "document_id", "score", "rank")

    @staticmethod
    def parted(chosen: DataFrame, limit: int) -> DataFrame:
        """Mark each query's leading terms, the rarest, and add the sum of the others' IDF as ``rest``."""
        by = Window.partitionBy("query_id").orderBy(F.col("idf").desc(), "term", F.col("priority").desc())
        before = F.coalesce(F.sum("df").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        marked = chosen.withColumn("leads", before < LEAD * limit)
        return marked.withColumn("rest", F.coalesce(F.sum(F.when(~F.col("leads"), F.col("idf"))).over(Window.partitionBy("query_id")), F.lit(0.0)))

    def hits(self, blocks: DataFrame, pieces: DataFrame | None, terms: DataFrame, state: dict, small: bool) -> DataFrame:
        """``query_id, user_id, segment, chunk_id, idf`` for each searchable chunk and term."""
        own = terms.select("query_id", "user_id", "term", "idf")
        single = own.withColumnRenamed("term", "token")
        read = self.alive(decoded(blocks.filter("searchable").join(hinted(single.select("user_id", "token").distinct(), small), ["user_id", "token"], "left_semi")), state)
        out = read.join(hinted(single, small), ["user_id", "token"]).select("query_id", "user_id", "segment", "chunk_id", "idf")
        if pieces is None:
            return out
        return out.unionByName(pieces.filter("searchable").join(hinted(own, small), ["user_id", "term"]).select("query_id", "user_id", "segment", "chunk_id", "idf"))

    @staticmethod
    def needed(running: DataFrame, others: DataFrame, small: bool) -> DataFrame:
        """Slices of each token in which a chunk is still in the running."""
        slices = running.select("query_id", slice_of("chunk_id").alias("slice")).distinct()
        return slices.join(hinted(others.select("query_id", "user_id", F.col("term").alias("token")), small), "query_id").select("user_id", "token", "slice").distinct()

    @staticmethod
    def covering(blocks: DataFrame, needed: DataFrame, open_tokens: DataFrame, small: bool) -> DataFrame:
        """Blocks with a needed slice, and all of the open tokens."""
        name = ["user_id", "token", "searchable", "segment", "slice_low", "first"]
        heads = blocks.filter("searchable").select(*name, "slice_high")
        some = heads.withColumn("slice", F.explode(F.sequence("slice_low", "slice_high"))).join(needed, ["user_id", "token", "slice"], "left_semi").select(*name)
        whole = heads.join(hinted(open_tokens, small), ["user_id", "token"], "left_semi").select(*name)
        wanted = staged(some.unionByName(whole).distinct())
        return blocks.join(hinted(wanted, is_small(wanted)), name, "left_semi")
