"""Groups of documents whose sets of word n-grams have a high Jaccard similarity.

Which documents must meet. Documents with equal sets are one class. If two sets are
similar enough, they share one of the few rarest n-grams of each (in any one order of all
n-grams). The order is by document frequency, counted over the whole corpus for the
n-grams whose hash lies in a fixed range wide enough to fill nearly every document's
share; the others come last, by hash. N-grams that one document alone has link nothing
and are left out. Documents that meet form clusters (connected components).

T-occurrence search. Within a cluster, a document that shares at least T n-grams with a
query is found in T of the query's inverted lists. The long lists, L of them, are set
aside; the short ones are merged, and what occurs in T - L of them is looked up in the
long ones by bisection (DivideSkip). Linked documents leave the index and become queries
themselves, so a group of thousands of near copies costs about one pass over its lists.

Large clusters are cut into chunks of bounded size. Each chunk is searched by itself and
with the first document of its cluster as a query; documents outside the main group of
the cluster are then queries to all chunks. Any link is found in one of the two steps,
unless both documents are in the same group already.

Null and blank texts have empty sets: linked with nothing, components of their own.
Repeated rows are rows of their own. Ids may repeat; null ids are ignored for the
smallest id of a component unless it has no other. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ridestats.llm.blocks import ROW_BITS, cut, runs_of, shard_count, text_size
from ridestats.llm.components import Forest, components
from ridestats.llm.packing import (
    give_back, hashes, joined, mix, pack_ints, pack_sorted, spans, split_words, unpack_ints, unpack_sorted, unpack_strings,
)
from ridestats.sources.scratch import stage

BLOCK_BYTES = 3 << 20  # text in a block
CHUNK = 1 << 21  # n-grams in a chunk of a cluster
LONG_LIST = 512  # entries of a list that is searched rather than merged


class _Sets:
    """The sorted distinct n-gram hashes of each document of a block."""

    def __init__(self, row: dict, k: int):
        counts = unpack_ints(row["counts"]).astype(np.int64)
        self.words = hashes(unpack_strings(row["words"]))[unpack_ints(row["codes"])]
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        self.k, self.grams = k, _runs(self.words, k)

    def __len__(self) -> int:
        return len(self.ends)

    def __getitem__(self, i: int) -> np.ndarray:
        n = int(self.ends[i] - self.starts[i])
        if not n:
            return np.empty(0, np.uint64)
        if n < self.k:
            return _runs(self.words[self.starts[i] : self.ends[i]], n)
        return np.unique(self.grams[self.starts[i] : self.ends[i] - self.k + 1])


def _runs(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of the ``k`` words from each place on."""
    grams = words
    for j in range(1, k):
        grams = joined(grams[:-1], words[j:]) if len(words) > j else words[:0]
    return grams


def _share(n: np.ndarray | int, num: int, den: int):
    """How many n-grams a similar document need not have, plus one."""
    return n - -(-n * num // den) + 1


def _limit(num: int, den: int) -> int:
    """Hashes below are counted: two and a half times the share of the rarest."""
    return min(2**64 - 1, int(2**64 * min(1.0, 2.5 * (den - num) / den)))


_BLOCK = ("block", "counts", "codes", "words")


def jaccard_groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Two documents are linked when ``den * intersection >= num * union`` of their sets of
    distinct ``k``-word n-grams (words in lower case, A-Z only; a text with fewer words
    is one n-gram). component_id is the smallest id that links lead to, its own included.
    """
    if not 0 < num <= den or k < 1:
        raise ValueError("0 < num <= den and k >= 1 are needed")
    n_shards = shard_count(text_size(docs, text_col))
    blocks = cut(docs, split_words, id_col, text_col, label="shingle-blocks", block_bytes=BLOCK_BYTES)
    sizes, rarity = _profiles(blocks, k, num, den, n_shards)
    classes = sizes.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("node").alias("rep"))
    classes = stage(classes, "set-classes")
    meeting = _meeting(blocks, rarity, classes, k, num, den)
    links = _links(blocks, meeting, k, num, den)
    roots = components(links).select(F.col("node").alias("rep"), "root")
    grouped = classes.join(roots, "rep", "left").select("s1", "s2", "n", F.coalesce("root", "rep").alias("root"))
    placed = sizes.join(grouped, ["s1", "s2", "n"], "left").select("id", "n", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    return placed.join(least, "root").select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with all their columns, one of each group of similar documents.

    The row with the smallest id stays (null ids first, equal ids by a hash of the text);
    all rows without words stay.
    """
    digest = F.xxhash64(F.col(text_col).cast("string"))
    own = docs.select(F.struct(*docs.columns).alias("row"), F.struct(F.col(id_col).alias("id"), digest.alias("digest")).alias("key"), F.col(text_col).alias("text"))
    groups = jaccard_groups(own.select("key", "text"), k, num, den, "key", "text")
    keys = groups.groupBy(F.col("doc_id.id").alias("_id"), F.col("doc_id.digest").alias("_digest")).agg(
        F.first("doc_id").alias("key"), F.min("component_id").alias("least"), F.count_if(F.col("n_shingles") > 0).alias("times"))
    keys = stage(keys.filter(F.col("key").eqNullSafe(F.col("least"))).select("_id", "_digest", "times"), "kept-keys")
    kept = own.join(keys, F.col("key.id").eqNullSafe(F.col("_id")) & (F.col("key.digest") == F.col("_digest")))
    if not keys.filter("times > 1").isEmpty():  # equal rows: their keys say nothing about which of them stays
        kept = kept.filter("times <= 1").unionByName(kept.filter("times > 1").dropDuplicates(["_id", "_digest"]))
    return kept.select("row.*")


def _profiles(blocks: DataFrame, k: int, num: int, den: int, n_shards: int) -> tuple[DataFrame, DataFrame]:
    """Size and digest of every set; and for each block the frequencies of its n-grams."""
    limit = np.uint64(_limit(num, den))
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, row in enumerate(batch.select(_BLOCK).to_pylist()):
                give_back()
                sets, block = _Sets(row, k), row["block"]
                n, digests, counted = np.zeros(len(sets), np.int64), np.zeros((2, len(sets)), np.uint64), []
                for i in range(len(sets)):
                    own = sets[i]
                    n[i] = len(own)
                    for digest, salt in zip(digests, (0x5A17, 0xC0FFEE)):
                        digest[i] = np.bitwise_xor.reduce(mix(own ^ np.uint64(salt)), initial=np.uint64(0))
                    counted.append(own[: np.searchsorted(own, limit)].copy())
                del sets
                ids = batch["ids"].slice(at, 1).flatten()
                nulls = pa.nulls(len(n), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), block)), pa.nulls(len(n), pa.int32()), ids, pa.array(block << ROW_BITS | np.arange(len(n))),
                     pa.array(n), *(pa.array(d.view(np.int64)) for d in digests), nulls, nulls], names=names)
                keys, counts = np.unique(np.concatenate(counted or [np.empty(0, np.uint64)]), return_counts=True)
                del counted
                # Shards take equal ranges of the counted hashes.
                shards = ((keys >> np.uint64(32)) * np.uint64(n_shards) // np.uint64((int(limit) >> 32) + 1)).astype(np.int64)
                for shard, a, b in runs_of(shards):
                    none = {c: pa.nulls(1, t) for c, t in (("node", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()))}
                    parts = {"block": pa.array([block]), "shard": pa.array([shard], pa.int32()), "id": pa.nulls(1, ids.type), **none,
                             "keys": pa.array([pack_sorted(keys[a:b])], pa.binary()), "counts": pa.array([pack_ints(counts[a:b].astype(np.uint32))], pa.binary())}
                    yield pa.RecordBatch.from_arrays([parts[c] for c in names], names=names)

    names = ["block", "shard", "id", "node", "n", "s1", "s2", "keys", "counts"]
    both = stage(blocks.select("ids", *_BLOCK).mapInArrow(
        profile, f"block long, shard int, id {kind}, node long, n long, s1 long, s2 long, keys binary, counts binary"), "set-profiles")

    def count(group: pa.Table) -> pa.Table:
        asked = [unpack_sorted(x.as_py()) for x in group["keys"]]
        store, at = np.unique(np.concatenate(asked), return_inverse=True)
        totals = np.bincount(at, np.concatenate([unpack_ints(x.as_py()) for x in group["counts"]])).astype(np.uint32)
        ends = np.cumsum([len(x) for x in asked])[:-1]
        return pa.table({"block": group["block"], "shard": group["shard"],
                         "totals": pa.array([pack_ints(totals[x]) for x in np.split(at, ends)], pa.binary())})

    rarity = both.filter(F.col("shard").isNotNull()).select("block", "shard", "keys", "counts").groupBy("shard").applyInArrow(
        count, "block long, shard int, totals binary")
    return both.filter(F.col("shard").isNull()).select("id", "node", "n", "s1", "s2"), rarity


def _rows_of(nodes: DataFrame, *more: str) -> DataFrame:
    """Nodes by block: which of its rows, and further columns in the same order."""
    rows = F.struct((F.col("node") % (1 << ROW_BITS)).cast("int").alias("row"), *more)
    return nodes.select(F.shiftright("node", ROW_BITS).alias("block"), rows.alias("r")).groupBy("block").agg(F.collect_list("r").alias("rows"))


def _meeting(blocks: DataFrame, rarity: DataFrame, classes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(node, cluster, n) of the documents that share one of their rarest n-grams with others."""
    limit = np.uint64(_limit(num, den))

    def rarest(own: pa.Table, told: pa.Table) -> pa.Table:
        give_back()
        out = [[], [], []]
        if own.num_rows:
            (row,), told = own.to_pylist(), told.to_pylist()
            sets = _Sets(row, k)
            counted = [own[: np.searchsorted(own, limit)].copy() for own in map(sets.__getitem__, range(len(sets)))]
            keys = np.unique(np.concatenate(counted)) if counted else np.empty(0, np.uint64)
            parts = [unpack_ints(r["totals"]) for r in sorted((r for r in told if r["totals"] is not None), key=lambda r: r["shard"])]
            totals = np.concatenate(parts) if parts else np.empty(0, np.uint32)
            for r in (r for x in told for r in x["rows"] or ()):
                i = r["row"]
                have = totals[np.searchsorted(keys, counted[i])]
                own = sets[i]
                share = _share(len(own), num, den)
                order = np.argsort(have, kind="stable")[:share]
                grams = counted[i][order][have[order] > 1]
                if len(order) < share:
                    grams = np.concatenate([grams, own[len(counted[i]) :][: share - len(order)]])
                out[0].append(grams.view(np.int64))
                out[1].append(np.full(len(grams), row["block"] << ROW_BITS | i))
                out[2].append(np.full(len(grams), len(own)))
        return pa.table({c: pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for c, x in zip(("gram", "node", "n"), out)})

    reps = _rows_of(classes.select(F.col("rep").alias("node")))
    told = rarity.select("block", "shard", "totals", F.lit(None).cast("array<struct<row:int>>").alias("rows")).unionByName(
        reps.select("block", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("binary").alias("totals"), "rows"))
    postings = stage(blocks.select(*_BLOCK).groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        rarest, "gram long, node long, n long"), "rarest")
    first = postings.groupBy("gram").agg(F.min("node").alias("first"), F.count("*").alias("size")).filter("size > 1")
    meet = postings.join(first, "gram").select(F.col("node").alias("a"), F.col("first").alias("b"), "n")
    meet = stage(meet.distinct(), "meetings")
    clusters = components(meet.filter("a <> b"))
    sizes = meet.select(F.col("a").alias("node"), "n").distinct()
    return sizes.join(clusters, "node", "left").select("node", "n", F.coalesce("root", "node").alias("cluster"))


def _links(blocks: DataFrame, meeting: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that connect each group of similar documents of a cluster."""
    meeting = stage(meeting, "meeting")
    clusters = meeting.groupBy("cluster").agg(F.sum("n").alias("total"), F.min("node").alias("lead"))
    total = clusters.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    bins = max(1, -(-2 * total // CHUNK))
    chunks = F.ceil(F.col("total") * 2 / F.lit(CHUNK)).cast("long")
    clusters = stage(clusters.select("cluster", "lead", F.when(F.col("total") > CHUNK, chunks).otherwise(F.lit(1)).alias("chunks")), "clusters")
    spread = meeting.join(clusters, "cluster").select(
        "node", "cluster", "chunks", (F.col("node") == F.col("lead")).alias("lead"),
        F.when(F.col("chunks") > 1, F.pmod(F.xxhash64("node"), F.col("chunks"))).otherwise(F.lit(0)).alias("chunk"))

    def fetch(own: pa.Table, asked: pa.Table) -> pa.Table:
        give_back()
        out = []
        if own.num_rows and asked.num_rows:
            (row,) = own.to_pylist()
            sets = _Sets(row, k)
            for r in (r for x in asked["rows"].to_pylist() for r in x):
                out.append({**r, "node": row["block"] << ROW_BITS | r["row"], "grams": sets[r["row"]].tobytes()})
        return pa.Table.from_pylist(out, fetched)

    fetched = pa.schema([("node", pa.int64()), ("cluster", pa.int64()), ("chunks", pa.int64()), ("lead", pa.bool_()),
                         ("chunk", pa.int64()), ("grams", pa.binary())])
    asked = _rows_of(spread, "cluster", "chunks", "lead", "chunk")
    sets = blocks.select(*_BLOCK).groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(
        fetch, "node long, cluster long, chunks long, lead boolean, chunk long, grams binary")
    sets = stage(sets, "cluster-sets")

    # Whole clusters, many to a task; chunks of large ones, with the lead in each of them.
    copies = F.when(F.col("lead") & (F.col("chunks") > 1), F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array("chunk"))
    place = F.when(F.col("chunks") > 1, F.xxhash64("cluster", "at")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(bins)))
    within = sets.select("node", "cluster", "grams", "chunks", F.explode(copies).alias("at")).select(
        "node", "cluster", "grams", place.alias("unit"), F.lit(True).alias("index"), F.lit(True).alias("query"), F.lit(0).cast("long").alias("group"))
    links = stage(within.groupBy("unit").applyInArrow(_searcher(num, den), "a long, b long"), "links")
    large = sets.filter("chunks > 1")
    if large.isEmpty():
        return links
    # Documents outside the main group of a large cluster ask all of its chunks.
    groups = components(links)
    large = stage(large.join(groups, "node", "left").withColumn("group", F.coalesce("root", "node")).drop("root"), "large-clusters")
    main = large.groupBy("cluster", "group").count().groupBy("cluster").agg(F.max_by("group", F.struct("count", "group")).alias("main"))
    outside = large.join(main, "cluster").filter("group <> main")
    parts = outside.groupBy("cluster").agg(F.ceil(F.sum(F.length("grams")) / F.lit(4 * CHUNK)).cast("long").alias("parts"))
    asks = outside.join(parts, "cluster").select(
        "node", "cluster", "grams", "group", F.pmod(F.xxhash64("node"), "parts").alias("part"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("index"), F.lit(True).alias("query"))
    told = large.join(parts, "cluster").select(
        "node", "cluster", "grams", "group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
        "chunk", F.lit(True).alias("index"), F.lit(False).alias("query"))
    across = asks.unionByName(told).select("node", "cluster", "grams", F.xxhash64("cluster", "chunk", "part").alias("unit"), "index", "query", "group")
    more = across.groupBy("unit").applyInArrow(_searcher(num, den), "a long, b long")
    return links.unionByName(stage(more, "links-across"))


def _searcher(num: int, den: int):
    def search(group: pa.Table) -> pa.Table:
        give_back()
        a, b = [], []
        clusters = np.asarray(group["cluster"])
        order = np.argsort(clusters, kind="stable")
        cuts = np.flatnonzero(np.diff(clusters[order])) + 1
        nodes, labels = np.asarray(group["node"]), np.asarray(group["group"])
        index, query = (np.asarray(group[c]) for c in ("index", "query"))
        grams = group["grams"]
        for rows in np.split(order, cuts):
            sets = [np.frombuffer(grams[i].as_py(), np.uint64) for i in rows.tolist()]
            if index[rows].all() and query[rows].all():
                found = spanning_links(sets, num, den)
            else:
                found = links_between(sets, index[rows], labels[rows], num, den)
            for x, y in found:
                a.append(int(nodes[rows[x]]))
                b.append(int(nodes[rows[y]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return search


class Inverted:
    """Inverted lists of some sets, and T-occurrence search in them."""

    def __init__(self, sets: list[np.ndarray], members: np.ndarray):
        self.members, self.sizes = members, np.array([len(sets[i]) for i in members], np.int64)
        grams = np.concatenate([sets[i] for i in members]) if len(members) else np.empty(0, np.uint64)
        order = np.argsort(grams, kind="stable")
        self.docs = np.repeat(np.arange(len(members)), self.sizes)[order]
        grams = grams[order]
        first = np.ones(len(grams), bool)
        first[1:] = grams[1:] != grams[:-1]
        self.starts = np.flatnonzero(first)
        self.grams = grams[self.starts]
        self.lengths = np.diff(np.append(self.starts, len(grams)))

    def similar(self, query: np.ndarray, num: int, den: int) -> np.ndarray:
        """Places in ``members`` of the sets similar enough to the query."""
        if not len(self.grams) or not len(query):
            return np.empty(0, np.int64)
        at = np.searchsorted(self.grams, query)
        at[at == len(self.grams)] = 0
        lists = at[self.grams[at] == query]
        least = -(-len(query) * num // den)  # T: common n-grams of any similar set
        if len(lists) < least:
            return np.empty(0, np.int64)
        lengths = self.lengths[lists]
        by_length = np.argsort(lengths, kind="stable")
        lists, lengths = lists[by_length], lengths[by_length]
        n_long = min(least - 1, int((lengths > LONG_LIST).sum()))
        short = len(lists) - n_long
        merged = self.docs[spans(self.starts[lists[:short]], lengths[:short])]
        counts = np.bincount(merged, minlength=len(self.members))
        found = np.flatnonzero(counts >= least - n_long)
        common = counts[found]
        for left, (start, length) in zip(range(n_long - 1, -1, -1), zip(self.starts[lists[short:]], lengths[short:])):
            if not len(found):
                break
            entries = self.docs[start : start + length]
            place = np.searchsorted(entries, found)
            place[place == length] = 0
            common = common + (entries[place] == found)
            enough = common + left >= least
            found, common = found[enough], common[enough]
        union = len(query) + self.sizes[found] - common
        return found[den * common >= num * union]


def spanning_links(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect whatever is connected by similarity; each set is a query once."""
    links, rest = [], np.arange(len(sets))
    index = Inverted(sets, rest)
    free = np.ones(len(sets), bool)
    for start in range(len(sets)):
        if not free[start]:
            continue
        free[start] = False
        queue = [start]
        while queue:
            query = queue.pop()
            left = int(free.sum())
            if not left:
                break
            if left * 2 <= len(index.members):
                index = Inverted(sets, np.flatnonzero(free))
            found = index.members[index.similar(sets[query], num, den)]
            found = found[free[found]]
            free[found] = False
            links += [(query, int(x)) for x in found]
            queue += found.tolist()
        if not free.any():
            break
    return links


def links_between(sets: list[np.ndarray], index: np.ndarray, labels: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links of the queries to indexed sets of other groups, one per pair of groups."""
    inverted, forest, links = Inverted(sets, np.flatnonzero(index)), Forest(), []
    for query in np.flatnonzero(~index).tolist():
        for other in inverted.members[inverted.similar(sets[query], num, den)].tolist():
            if labels[other] != labels[query] and forest.join(int(labels[query]), int(labels[other])):
                links.append((query, other))
    return links
