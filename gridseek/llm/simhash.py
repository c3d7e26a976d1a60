"""SimHash near-duplicates: 64-bit fingerprints, BK-trees and connected components (operator 7).

A document's fingerprint is the bitwise majority of the XXH64 values of its three-word shingles. Two
fingerprints that differ in at most ``RADIUS`` bits are linked. Distinct fingerprints are dealt into groups of
about ``GROUP`` values so that every link lies inside one: of ``RADIUS + s`` bit blocks any two linked values
agree on ``s``, and a group is a choice of blocks with the first bits of each. A group has a BK-tree, or one
for each of its shards of ``SHARD`` values, with children keyed by their integer Hamming distance to the
parent; a search follows only edges within the radius. A task holds many groups and builds and searches
their trees together, level by level. It sends on one edge to the local root for each fingerprint rather than
all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridseek.operators.components import connected_components, local_roots
from gridseek.plans.durable import broadcast_if_small, materialize, unused

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Values that a group is to have if fingerprints were spread evenly, and values that one tree holds at most.
GROUP, SHARD = 512, 20_000
#: Values of whole groups that a task searches at once.
TASK_VALUES = 100_000
_SPREAD = np.array([sum((v >> i & 1) << (8 * i) for i in range(8)) for v in range(256)], dtype=np.uint64)


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive runs of ``sizes`` hashes; a run of none gives zero."""
    out = np.zeros(len(sizes), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full]
    parts = (n + 254) // 255  # counters of a byte each hold 255 at most
    first = np.cumsum(n) - n
    inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    lanes = np.add.reduceat(_SPREAD[hashes.view(np.uint8).reshape(-1, 8)], np.repeat(first, parts) + 255 * inner, axis=0)
    ones = np.add.reduceat(lanes.view(np.uint8).astype(np.int64), np.cumsum(parts) - parts, axis=0)
    out[full] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def shingle_hashes(text: str | None) -> np.ndarray:
    """XXH64 of each three-word shingle of the lower-cased text; of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    rows = map(b" ".join, zip(words, words[1:], words[2:]))
    return np.fromiter(map(xxhash.xxh64_intdigest, rows, repeat(SEED)), np.uint64, len(words) - SHINGLE + 1)


@F.pandas_udf(T.LongType())
def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The fingerprints of texts, as signed integers."""
    for batch in texts:
        done, held, size = [], [], 0
        for text in batch:
            held.append(shingle_hashes(text))
            size += len(held[-1])
            if size > 200_000:
                done.append(majority(np.concatenate(held), np.array([len(h) for h in held])))
                held, size = [], 0
        if held:
            done.append(majority(np.concatenate(held), np.array([len(h) for h in held])))
        yield pd.Series(np.concatenate(done).view(np.int64) if done else np.zeros(0, np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` of every row. Null and wordless texts have fingerprint zero."""
    return docs.select(F.col(id_col), fingerprint(F.col(text_col)).alias("fp"))


class BKForest:
    """BK-trees over the distinct 64-bit values of each group, built and searched level by level."""

    def __init__(self, values: np.ndarray, group: np.ndarray):
        self.values = values
        order, dist = np.arange(len(values)), np.zeros(len(values), dtype=np.int64)
        parent = -1 - group.astype(np.int64)  # the roots' parents are the groups
        keys, kids = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        while len(order):
            slot, first, inverse = np.unique(parent[order] * 65 + dist[order], return_index=True, return_inverse=True)
            chosen = order[first]  # the first value of each (parent, distance) becomes the node there
            keys.append(slot)
            kids.append(chosen)
            owner = chosen[inverse]
            rest = owner != order
            order, owner = order[rest], owner[rest]
            parent[order] = owner
            dist[order] = np.bitwise_count(values[order] ^ values[owner])
        keys, kids = np.concatenate(keys), np.concatenate(kids)
        by_key = np.argsort(keys, kind="stable")
        self.keys, self.kids = keys[by_key], kids[by_key]

    def within(self, queries: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query position, value position) of a group at Hamming distance ``radius`` or less."""
        root = (-1 - group.astype(np.int64)) * 65
        at = np.minimum(np.searchsorted(self.keys, root), max(len(self.keys) - 1, 0))
        q = np.flatnonzero(self.keys[at] == root) if len(self.keys) else np.zeros(0, dtype=np.int64)
        node = self.kids[at[q]]
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            near = d <= radius
            found.append((q[near], node[near]))
            low = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), side="right")
            n = high - low
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            q, node = np.repeat(q, n), self.kids[np.repeat(low, n) + step]
        return tuple(np.concatenate(x) for x in zip(*found))


def group_edges(values: np.ndarray, group: np.ndarray, held: np.ndarray, asks: np.ndarray, radius: int = RADIUS, chunk: int = 4096):
    """Star edges (value, least value of its local set) for the links of each group from ``asks`` to ``held`` rows."""
    forest, asked, owner = BKForest(values[held], group[held]), values[asks], group[asks]
    src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(asked), chunk):
        q, node = forest.within(asked[at : at + chunk], owner[at : at + chunk], radius)
        a, b = asked[q + at].view(np.int64), forest.values[node].view(np.int64)
        a, b = local_roots(a[a != b], b[a != b])
        src.append(a)
        dst.append(b)
    return local_roots(np.concatenate(src), np.concatenate(dst))


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges of rows ``(key, a, b, shard, fp)`` sorted by group, some whole groups at a time."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch])
        rest = rows
        if len(rows) >= TASK_VALUES:
            last = rows[["key", "a", "b"]].iloc[-1]
            open_ = (rows["key"] == last["key"]) & (rows["a"] == last["a"]) & (rows["b"] == last["b"])
            rest = rows[open_]
            if len(rest) < len(rows):
                yield _found(rows[~open_])
    if rest is not None and len(rest):
        yield _found(rest)


def _found(rows: pd.DataFrame) -> pd.DataFrame:
    k, a, b, shard = (rows[c].to_numpy() for c in ("key", "a", "b", "shard"))
    new = np.ones(len(rows), dtype=np.int64)
    new[1:] = (k[1:] != k[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    src, dst = group_edges(rows["fp"].to_numpy().view(np.uint64), np.cumsum(new), shard == a, shard == b)
    return pd.DataFrame({"src": src, "dst": dst})


def block_keys(bits: int, fp: str = "fp") -> "F.Column":
    """Keys of ``bits`` bits or a little more of which any two values within ``RADIUS`` bits share one."""
    shared = next(s for s in (1, 2, 3) if s == 3 or bits <= s * (64 // (RADIUS + s)))
    blocks = RADIUS + shared
    wide = 64 // blocks
    used = min(-(-bits // shared), wide)  # of each block
    parts = [F.shiftrightunsigned(F.col(fp), i * wide).bitwiseAND(F.lit((1 << used) - 1)) for i in range(blocks)]
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), shared)):
        key = F.lit(k).cast("long")
        for i in chosen:
            key = F.shiftleft(key, used).bitwiseOR(parts[i])
        keys.append(key)
    return F.array(*keys)


def linked_fingerprints(fps: DataFrame, shard: int = SHARD, group: int = GROUP) -> DataFrame:
    """Edges ``(src, dst)`` that connect all distinct ``fp`` values within the radius of each other."""
    values = materialize(fps.select("fp").distinct())
    bits = max(1, int(np.ceil(np.log2(max(values.count(), 1) / group + 1))))
    dealt = values.select("fp", F.explode(block_keys(bits)).alias("key"))
    large = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard)
    large = broadcast_if_small(materialize(large.select("key", F.ceil(F.col("n") / shard).cast("int").alias("shards"))))
    held = dealt.join(large, "key", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    held = held.withColumn("shard", F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int"))
    asked = held.select("fp", "key", "shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("other"))
    asked = asked.select("key", F.least("shard", "other").alias("a"), F.greatest("shard", "other").alias("b"), "shard", "fp")
    sorted_ = asked.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return sorted_.mapInPandas(_edges, "src long, dst long")


def fingerprint_roots(fps: DataFrame, shard: int = SHARD) -> DataFrame:
    """``(node, component)``: linked ``fp`` values and the least value that each can reach."""
    return connected_components(linked_fingerprints(fps, shard))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row of ``docs``.

    ``component_id`` is the least id reachable over links, the row's own included. Null and empty texts
    have fingerprint zero and are linked like any other. Rows with a null id are linked too, but name no
    component unless nothing else in it has an id. Repeated rows come out as often as they come in; an
    empty table gives an empty one; other columns are ignored.
    """
    fps = materialize(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("fp")))
    least = fps.groupBy("fp").agg(F.min("id").alias("first"))
    roots = fingerprint_roots(fps, shard)
    named = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    named = materialize(named)
    owner = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(owner, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their component: the one of the least id, once.

    Columns are those of ``docs``. Rows that repeat an id and a text come out once; rows of one id with
    different texts are told apart and stay where that id is the least. Rows with a null id stay only
    where no row of the component has an id.
    """
    key, mark = unused(docs.columns, "key", "mark")
    # a struct is a join key that may be null inside, so that one shuffle by it serves the join and the repeats
    stay = near_duplicates(docs, id_col, text_col).select(F.struct(F.col("component_id").alias("id")).alias(key)).distinct()
    marked = docs.withColumns({key: F.struct(F.col(id_col).alias("id")), mark: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    return marked.join(stay, key, "left_semi").dropDuplicates([key, mark]).drop(key, mark)
