"""Benchmark decontamination by training suffix arrays (operator 6).

Each task turns its documents, in shards of a bounded number of words, into a suffix array over word
numbers and binary-searches every suffix of the benchmark items in it. The best place gives the longest
verbatim match of a suffix; the range of suffixes that begin with a whole window gives every place
where the window occurs, and the neighbours of a place among the test suffixes its longest match. Suffixes are
compared by hashes of their prefixes, so that a long item that was copied costs no more steps than its
length has bits; windows are compared word by word in the end. Only runs of benchmark words that are long
enough for the shortest window are sorted, as no other training suffix can hold one. The benchmark is
broadcast in blocks of ``BLOCK_WORDS`` words at most; more blocks are further rounds, which write the hits of
the texts that have some.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridseek.plans.durable import broadcast_if_small, materialize, unused

WINDOW = 13
#: A document is contaminated if its hit words, times this, are at least its words.
SHARE = 20
#: Words of the documents that one suffix array holds.
SHARD_WORDS = 1_000_000
#: Words of the benchmark that are broadcast at once.
BLOCK_WORDS = 2_000_000
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and all non-ASCII characters, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split() if text else []


#: Odd multiplier of the prefix hashes and those of the mixing function. Fixed values.
_BASE, _MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Prefixes:
    """Hashes of all parts of a sequence of word numbers."""

    def __init__(self, tokens: np.ndarray):
        self.tokens = tokens
        h = (tokens.astype(np.uint64) + np.uint64(1)) * _MIX_A
        h = (h ^ (h >> np.uint64(29))) * _MIX_B
        ahead = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(tokens), _BASE))])
        back = np.uint64(pow(int(_BASE), -1, 1 << 64))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((h ^ (h >> np.uint64(32))) * ahead[:-1], dtype=np.uint64)])
        self.back = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(tokens), back))])

    def part(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.back[at]


def common(a: Prefixes, at: np.ndarray, b: Prefixes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Common lengths, up to ``size``, of the parts of ``a`` from ``at`` and of ``b`` from ``start``."""
    low, high = np.zeros(len(at), dtype=np.int64), np.minimum(size, np.minimum(len(a.tokens) - at, len(b.tokens) - start))
    while len(live := np.flatnonzero(low < high)):
        mid = (low[live] + high[live] + 1) // 2
        same = a.part(at[live], mid) == b.part(start[live], mid)
        low[live] = np.where(same, mid, low[live])
        high[live] = np.where(same, high[live], mid - 1)
    return low


@dataclass
class TestIndex:
    """The items of one block: word numbers from 1, items one after another, each followed by a 0."""

    items: list[tuple[int, list[bytes]]]
    vocabulary: dict[bytes, int] = field(init=False)

    def __post_init__(self):
        vocabulary: dict[bytes, int] = {}
        self.names = [i for i, _ in self.items]
        sizes = np.array([len(w) for _, w in self.items], dtype=np.int64)
        flat = [0] * int(sizes.sum() + len(sizes))
        at = 0
        for _, words in self.items:
            flat[at : at + len(words)] = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
            at += len(words) + 1
        self.flat = np.array(flat, dtype=np.int32)
        self.vocabulary = vocabulary
        begin = np.cumsum(sizes + 1) - sizes - 1
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.start = begin[self.owner] + self.place
        self.left = sizes[self.owner] - self.place
        self.need = np.minimum(sizes, WINDOW)[self.owner]
        self.whole = self.left >= self.need
        self.longest = int(sizes.max(initial=0))
        self.shortest = int(np.minimum(sizes, WINDOW).min(initial=WINDOW))
        self.prefixes = Prefixes(self.flat)
        rank = np.empty(len(self.flat), dtype=np.int64)
        rank[suffix_array(self.flat, self.longest + 1)] = np.arange(len(self.flat))
        self.order = np.argsort(rank[self.start])  # of the suffixes that begin with a word


def runs_of(tokens: np.ndarray, least: int) -> np.ndarray:
    """Places in runs of at least ``least`` numbers other than 0."""
    edge = np.diff(np.concatenate([[0], (tokens > 0).astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = end - begin >= least
    begin, size = begin[keep], (end - begin)[keep]
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``tokens`` in the order of their suffixes, told apart by ``depth`` numbers at least."""
    rank, h = tokens.astype(np.int64), 1
    while True:
        ahead = np.zeros_like(rank)
        ahead[: max(len(rank) - h, 0)] = rank[h:] + 1
        distinct, rank = np.unique(rank * (int(ahead.max(initial=0)) + 1) + ahead, return_inverse=True)
        h *= 2
        if h >= depth or len(distinct) == len(rank):
            return np.argsort(rank, kind="stable")


def _bound(train: Prefixes, order: np.ndarray, test: Prefixes, start: np.ndarray, size: np.ndarray, after: bool) -> np.ndarray:
    """Binary search: the first suffix not below (or, ``after``, above) each test prefix."""
    low, high = np.zeros(len(start), dtype=np.int64), np.full(len(start), len(order), dtype=np.int64)
    while len(live := np.flatnonzero(low < high)):
        mid = (low[live] + high[live]) // 2
        at, begin, n = order[mid], start[live], size[live]
        same = common(train, at, test, begin, n)
        inside = np.minimum(same, n - 1)
        sign = np.where(same == n, 0, np.sign(train.tokens[np.minimum(at + inside, len(train.tokens) - 1)].astype(np.int64) - test.tokens[begin + inside]))
        right = sign <= 0 if after else sign < 0
        low[live[right]] = mid[right] + 1
        high[live[~right]] = mid[~right]
    return low


@dataclass
class Found:
    """What a shard of documents and a block of the benchmark share."""

    best: np.ndarray  # the longest match of each test suffix
    where: np.ndarray  # and its place
    groups: list[np.ndarray]  # the items of each window that occurs
    spots: np.ndarray  # places of occurrences
    sizes: np.ndarray  # words of the window there
    group: np.ndarray  # and its number
    longest: np.ndarray  # the longest match that begins there
    suffix: np.ndarray  # and its test suffix


def search(tokens: np.ndarray, index: TestIndex) -> Found:
    """Longest match and its place for every test suffix, and all places of every whole window."""
    places = runs_of(tokens, index.shortest)
    gap = np.flatnonzero(np.diff(places) != 1) + 1
    train = Prefixes(np.append(np.insert(tokens[places], gap, 0), 0).astype(np.int32))
    back = np.append(np.insert(places, gap, -1), -1)
    order = suffix_array(train.tokens, index.longest + 1)
    order = order[train.tokens[order] > 0]
    n = len(index.start)
    best, where, nothing = np.zeros(n, dtype=np.int64), np.full(n, -1, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if not len(order) or not n:
        return Found(best, where, [], nothing, nothing, nothing, nothing, nothing)
    at = _bound(train, order, index.prefixes, index.start, index.left, False)
    for near in (at - 1, at):
        spot = order[np.clip(near, 0, len(order) - 1)]
        same = common(train, spot, index.prefixes, index.start, np.where((near >= 0) & (near < len(order)), index.left, 0))
        better = same > best
        best[better], where[better] = same[better], back[spot[better]]

    found = np.flatnonzero(index.whole & (best >= index.need))
    low = _bound(train, order, index.prefixes, index.start[found], index.need[found], False)
    # windows of the same words have the same range, which is listed once
    _, first, group = np.unique(low * (WINDOW + 1) + index.need[found], return_index=True, return_inverse=True)
    high = _bound(train, order, index.prefixes, index.start[found[first]], index.need[found[first]], True)
    by_group = np.argsort(group, kind="stable")
    groups = np.split(index.owner[found[by_group]], np.cumsum(np.bincount(group, minlength=len(first)))[:-1]) if len(found) else []
    many = high - low[first]
    ranks = np.repeat(low[first] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    own = np.repeat(np.arange(len(first)), many)
    begin, size = index.start[found[first]][own], index.need[found[first]][own]
    exact = np.ones(len(own), dtype=bool)
    for k in range(WINDOW):
        exact &= (k >= size) | (train.tokens[np.minimum(order[ranks] + k, len(train.tokens) - 1)] == index.flat[np.minimum(begin + k, len(index.flat) - 1)])
    ranks, own, size = ranks[exact], own[exact], size[exact]

    # of all test suffixes those next to a place in order have the longest match there
    after = np.searchsorted(at[index.order], ranks, side="right")
    longest, suffix = np.zeros(len(ranks), dtype=np.int64), np.zeros(len(ranks), dtype=np.int64)
    for near in (after - 1, after):
        test = index.order[np.clip(near, 0, n - 1)]
        same = common(train, order[ranks], index.prefixes, index.start[test], np.where((near >= 0) & (near < n), index.left[test], 0))
        better = same > longest
        longest[better], suffix[better] = same[better], test[better]
    return Found(best, where, groups, back[order[ranks]], size, own, longest, suffix)


def _shards(texts: pd.Series, vocabulary: dict[bytes, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Word numbers of some documents, each followed by a 0, their first places and their lengths."""
    held, sizes = [], []
    for text in texts:
        words = words_of(text)
        held.append(_numbers(words, vocabulary))
        sizes.append(len(words))
        if sum(sizes) > SHARD_WORDS:
            yield _joined(held, sizes)
            held, sizes = [], []
    if held:
        yield _joined(held, sizes)


def _numbers(words: list[bytes], vocabulary: dict[bytes, int]) -> np.ndarray:
    get = vocabulary.get
    return np.array([get(w, 0) for w in words] + [0], dtype=np.int32)


def _joined(held: list[np.ndarray], sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.array(sizes, dtype=np.int64)
    return np.concatenate(held), np.cumsum(n + 1) - n - 1, n


_LONGEST = ("match_words", "match_place", "match_item", "match_item_place")
_HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("starts", "ends", "items")),
        *(T.StructField(c, T.LongType()) for c in _LONGEST),
    ]
)


def _hits(texts: pd.Series, index: TestIndex) -> list[tuple]:
    """For each document its words, the runs of hit words, the items with windows there and the longest match."""
    out = []
    for tokens, begin, sizes in _shards(texts, index.vocabulary):
        got = search(tokens, index)
        edge = np.zeros(len(tokens) + 1, dtype=np.int64)
        np.add.at(edge, got.spots, 1)
        np.add.at(edge, got.spots + got.sizes, -1)
        change = np.diff(np.concatenate([[0], (np.cumsum(edge)[:-1] > 0).astype(np.int8), [0]]))
        first, last = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        run = np.searchsorted(np.searchsorted(begin, first, side="right") - 1, np.arange(len(sizes) + 1))
        doc = np.searchsorted(begin, got.spots, side="right") - 1
        by_doc = np.lexsort((got.spots, -got.longest, doc))
        cut = np.searchsorted(doc[by_doc], np.arange(len(sizes) + 1))
        for i, size in enumerate(sizes.tolist()):
            if run[i] == run[i + 1]:
                out.append((size, [], [], [], 0, None, None, None))
                continue
            a, mine = slice(run[i], run[i + 1]), by_doc[cut[i] : cut[i + 1]]
            items = np.unique(np.concatenate([got.groups[g] for g in np.unique(got.group[mine]).tolist()]))
            top = mine[0]  # the longest, of equal ones the first
            match = (int(got.longest[top]), int(got.spots[top] - begin[i]), index.names[index.owner[got.suffix[top]]], int(index.place[got.suffix[top]]))
            out.append((size, (first[a] - begin[i]).tolist(), (last[a] - begin[i]).tolist(), sorted({index.names[k] for k in items.tolist()}), *match))
    return out


def _hits_udf(shared):
    @F.pandas_udf(_HITS)
    def hits(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_hits(texts, shared.value), columns=_HITS.names).astype({c: "Int64" for c in _LONGEST})

    return hits


_REPORT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("longest_run", T.LongType()),
        *(T.StructField(c, T.LongType()) for c in _LONGEST),
        T.StructField("items", T.ArrayType(T.LongType())),
    ]
)


def _report(n_words: int, parts: list[tuple]) -> tuple:
    """Merge what all blocks found, ``(starts, ends, items, longest match)``, and judge the document."""
    hit = longest = 0
    begin = end = -1
    for a, b in sorted((a, b) for starts, ends, *_ in parts for a, b in zip(starts, ends)):
        if a > end:
            begin, end = a, a
        hit += max(b - end, 0)
        end = max(end, b)
        longest = max(longest, end - begin)
    names = sorted({str(i): i for _, _, items, *_ in parts for i in items}.items())
    digest = hashlib.sha256(",".join(k for k, _ in names).encode()).hexdigest()
    match = min((tuple(m) for *_, m in parts if m[0]), key=lambda m: (-m[0], *m[1:]), default=(0, None, None, None))
    return n_words, hit, len(names), digest, hit > 0 and SHARE * hit >= n_words, longest, *match, [i for _, i in names]


def _reports(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_REPORT.names).astype({c: "Int64" for c in _LONGEST})


def _test_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[TestIndex]:
    """The benchmark in blocks of bounded size, read partition by partition."""
    held, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("long"), F.col(text_col)).where(F.col(item_col).isNotNull())
    for item, text in rows.toLocalIterator():
        words = words_of(text)
        if not words:
            continue
        if held and size + len(words) > block_words:
            yield TestIndex(held)
            held, size = [], 0
        held.append((item, words))
        size += len(words)
    yield TestIndex(held)


def _with_report(docs: DataFrame, benchmark: DataFrame, name: str, text_col: str, item_col: str, item_text: str, block_words: int) -> DataFrame:
    """``docs`` and a struct column ``name``, which is none of theirs."""
    spark = docs.sparkSession.sparkContext
    blocks = _test_blocks(benchmark, item_col, item_text, block_words)
    index = next(blocks)
    following = next(blocks, None)
    if following is None:  # one block: search and judge in one go
        shared = spark.broadcast(index)

        @F.pandas_udf(_REPORT)
        def judged(texts: pd.Series) -> pd.DataFrame:
            return _reports([_report(n, [(a, b, items, match)]) for n, a, b, items, *match in _hits(texts, shared.value)])

        return docs.withColumn(name, judged(F.col(text_col)))

    # hits depend on the text alone, which its two hashes name
    keys = [F.xxhash64(text_col).alias("k1"), F.xxhash64(F.col(text_col), F.lit(2)).alias("k2")]
    found = None
    while index is not None:
        shared = spark.broadcast(index)
        hits = docs.select(*keys, _hits_udf(shared)(F.col(text_col)).alias("hits")).where(F.size("hits.starts") > 0).dropDuplicates(["k1", "k2"])
        part = materialize(hits)
        shared.unpersist()
        found = part if found is None else found.union(part)
        index, following = following, next(blocks, None)
    found = materialize(found.groupBy("k1", "k2").agg(F.collect_list("hits").alias("hits")))  # one for each block at most
    size = F.aggregate("hits", F.lit(0), lambda s, h: s + F.size(h["starts"]) + F.size(h["items"]))
    k1, k2, held = unused([*docs.columns, name], "k1", "k2", "hits")
    found = broadcast_if_small(found, held=found.agg(F.sum(size)).first()[0] or 0).withColumnsRenamed({"k1": k1, "k2": k2, "hits": held})
    out = docs.withColumns({k1: keys[0], k2: keys[1]}).join(found, [k1, k2], "left")

    @F.pandas_udf(_REPORT)
    def merged(texts: pd.Series, hits: pd.Series) -> pd.DataFrame:
        rows = []
        for text, parts in zip(texts, hits):
            parts = [] if parts is None else list(parts)
            n = parts[0]["n_words"] if parts else len(words_of(text))
            rows.append(_report(n, [(p["starts"], p["ends"], p["items"], [p[c] for c in _LONGEST]) for p in parts]))
        return _reports(rows)

    return out.withColumn(name, merged(F.col(text_col), F.col(held))).drop(k1, k2, held)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``(id, n_words, n_hit, n_items, items_sha256, contaminated, longest_run, match_..., items)`` for every row.

    A document word is hit if an occurrence of a window of an item covers it; an item shorter than a
    window is one window. ``longest_run`` is the longest run of hit words. ``match_words`` is the longest
    verbatim match with an item that begins with a window, of equal ones the first in the document;
    ``match_place`` is its first word there, ``match_item`` and ``match_item_place`` are an item and its word
    that it begins with (of several any one). Null and wordless texts have
    no words and are clean; items without words or id count for nothing; an empty benchmark finds
    nothing; rows that repeat come out as often as they come in; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = _with_report(rows, benchmark, "report", "text", item_col, item_text, block_words)
    return rows.select(F.col("id").alias(id_col), "report.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns.

    Null and wordless texts, null ids and repeated rows stay or go like any other; an empty table stays one.
    """
    (name,) = unused(docs.columns, "report")
    return _with_report(docs, benchmark, name, text_col, item_col, "text", BLOCK_WORDS).where(~F.col(f"{name}.contaminated")).drop(name)


_MATCH = "item_id long, item_start long, n_words long, doc_id long, doc_start long"


def longest_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The longest verbatim match of each item in the documents: ``(item_id, item_start, n_words, doc_id, doc_start)``.

    Of equal lengths the least item start, document and document start of those that shards report win, each
    of which reports one for a suffix. Matches without a run of benchmark words as long as the shortest window
    are not looked for.
    """
    spark = docs.sparkSession.sparkContext
    found = None
    for index in _test_blocks(benchmark, "item_id", "text", BLOCK_WORDS):
        shared = spark.broadcast(index)

        def matches(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = shared.value
            for batch in batches:
                at = 0
                for tokens, begin, sizes in _shards(batch["text"], index.vocabulary):
                    got = search(tokens, index)
                    hit = np.flatnonzero(got.best > 0)
                    doc = np.searchsorted(begin, got.where[hit], side="right") - 1
                    yield pd.DataFrame(
                        {
                            "item_id": np.array(index.names, dtype=np.int64)[index.owner[hit]],
                            "item_start": index.place[hit],
                            "n_words": got.best[hit],
                            "doc_id": batch["doc_id"].iloc[at : at + len(sizes)].to_numpy()[doc] if len(hit) else np.zeros(0, np.int64),
                            "doc_start": got.where[hit] - begin[doc] if len(hit) else np.zeros(0, np.int64),
                        }
                    )
                    at += len(sizes)

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(matches, _MATCH)
        found = part if found is None else found.union(part)
    best = F.min(F.struct((-F.col("n_words")).alias("less"), "item_start", "doc_id", "doc_start", "n_words")).alias("best")
    return found.groupBy("item_id").agg(best).select("item_id", "best.item_start", "best.n_words", "best.doc_id", "best.doc_start")
