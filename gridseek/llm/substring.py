"""Substring dedup by fixed-block anchors (operator 9).

Windows of ``WINDOW`` words that also start earlier are removed. Every document's non-overlapping blocks
of ``BLOCK`` words are the index, and every rolling block of all documents probes it: a repeated window
holds one whole index block of its earlier place, whatever the alignment. Anchors are blocks with a hit
outside their own place. A hit is extended to both sides over the rolling blocks that recur as well, and of
that stretch the windows are compared, by 96 bits of hash, and by (document, start). Removed windows that
overlap add up to the maximal repeats.

Tasks read the texts as they come and cut them into shards of ``SHARD_WORDS`` words, whatever their ids. Texts
are read once: a shard is kept as word numbers and its vocabulary, from which the kept words are written in the
end, so that texts are never shuffled. It sends its block hashes sorted,
without local copies and delta-coded, one binary cell for each hash range, so that neither a hot passage nor a
large group of copies makes a hot task, and gets back one bit for each hash it sent. Ranges are as many as the
bytes of the texts ask for. A shard sends ``CELLS`` cells at most, whatever the input: where more ranges are asked
for, a cell spans several of them, and cells of one span from as many shards are merged and cut anew on the way,
so that cells hold as many hashes in a large input as in a small one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridseek.plans.durable import materialize

WINDOW, BLOCK = 20, 10
#: Multiplier of the rolling hash, and those of the mixing function (the finaliser of SplitMix64). Fixed values.
_BASE, _MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bits of a block's hash that are sent; a chance match only costs a comparison of windows.
BLOCK_BITS = 40
#: Words of a shard, and bytes of text for each hash range.
SHARD_WORDS, RANGE_BYTES = 1_000_000, 12_000_000
#: Cells of a shard at most.
CELLS = 1024
#: Stands for a null id, which sorts first.
_NULL_ID = -(1 << 63)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX_A
    h = (h ^ (h >> np.uint64(27))) * _MIX_B
    return h ^ (h >> np.uint64(31))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Unmixed polynomial hash of every run of ``n`` values; none if there are fewer."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        out *= _BASE
        out += h[k : len(h) - n + 1 + k]
    return out


def _power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def pack(sorted_values: np.ndarray) -> bytes:
    """Sorted unsigned values as compressed byte planes of their differences."""
    steps = np.diff(sorted_values, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(cell: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(cell), dtype=np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_bits(bits: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(bits).tobytes())


def unpack_bits(cell: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(cell), dtype=np.uint8), count=n).astype(bool)


def _squeezed(values: np.ndarray) -> bytes:
    """Compressed byte planes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unsqueezed(cell: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(cell), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


_BODY = (("ids", np.int64), ("sizes", np.int64), ("codes", np.uint32))


class _Shard:
    """Documents of one shard as word numbers, and the hashes of their rolling blocks."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray, words: list[bytes]):
        self.ids, self.sizes, self.codes, self.words = ids, sizes, codes, words
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        self.blocks_of = np.maximum(sizes - BLOCK + 1, 0)
        self.begin = np.cumsum(self.blocks_of) - self.blocks_of
        self.offset = np.arange(self.blocks_of.sum()) - np.repeat(self.begin, self.blocks_of)
        places = np.repeat(np.cumsum(sizes) - sizes, self.blocks_of) + self.offset  # blocks don't run over two documents
        self.raw = rolling(hashes[codes], BLOCK)[places] if len(places) else np.zeros(0, np.uint64)

    @classmethod
    def of_texts(cls, ids: list[int], texts: list[list[bytes]]) -> "_Shard":
        known: dict[bytes, int] = {}
        codes = np.array([known.setdefault(w, len(known)) for words in texts for w in words], dtype=np.uint32)
        return cls(np.array(ids, np.int64), np.array([len(w) for w in texts], np.int64), codes, list(known))

    @classmethod
    def of_row(cls, row: pd.Series) -> "_Shard":
        words = zstandard.ZstdDecompressor().decompress(row["words"]).split(b" ")
        return cls(*(_unsqueezed(row[name], kind) for name, kind in _BODY), words if words != [b""] else [])

    def row(self) -> dict[str, bytes]:
        return {name: _squeezed(getattr(self, name)) for name, _ in _BODY} | {"words": zstandard.ZstdCompressor(level=1).compress(b" ".join(self.words))}

    def blocks(self) -> tuple[np.ndarray, ...]:
        """Distinct block hashes in order, which of them recur here, which are index blocks; each place's number among them."""
        value, inverse, count = np.unique(_mix(self.raw) >> np.uint64(64 - BLOCK_BITS), return_inverse=True, return_counts=True)
        index = np.zeros(len(value), dtype=bool)
        index[inverse[self.offset % BLOCK == 0]] = True
        return value, count > 1, index, inverse

    def windows(self, recurs: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document number and start of every window that holds an anchor and whose blocks all recur."""
        span = WINDOW - BLOCK + 1
        if len(self.raw) < span:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        whole = np.concatenate([[0], np.cumsum(recurs)])
        held = np.concatenate([[0], np.cumsum(anchor)])
        good = (whole[span:] - whole[:-span] == span) & (held[span:] > held[:-span])
        doc = np.repeat(np.arange(len(self.ids)), self.blocks_of)
        good &= doc[: len(good)] == doc[span - 1 :]
        at = np.flatnonzero(good)
        return doc[at], self.offset[at]

    def window_hashes(self, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit hash of each given window, and 32 bits more."""
        at = self.begin[doc] + start
        left, right = self.raw[at], self.raw[at + WINDOW - BLOCK]
        return _mix(left * _power(_BASE, WINDOW - BLOCK) + right), ((_mix(left ^ _MIX_A) * _MIX_B + _mix(right)) >> np.uint64(32)).astype(np.uint32)


def _cells(value: np.ndarray, bits: int, buckets: int) -> list[tuple[int, slice]]:
    """The parts of sorted values of ``bits`` bits by equal hash ranges."""
    edges = [min(-(-(b << bits) // buckets), (1 << bits) - 1) for b in range(1, buckets)]
    cuts = [0, *np.searchsorted(value, np.array(edges, dtype=np.uint64)).tolist(), len(value)]
    return [(b, slice(x, y)) for b, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]


_ENCODED = T.StructType(
    [
        T.StructField("shard", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType()),
        *(T.StructField(c, T.BinaryType()) for c in ("cell", "again", "index", *(name for name, _ in _BODY), "words")),
    ]
)


def _rows_of(shard: _Shard, number: int, buckets: int) -> pd.DataFrame:
    """The cells of a shard's block hashes, and a row of no bucket with its word numbers."""
    value, again, index, _ = shard.blocks()
    cells = [
        {"shard": number, "bucket": b, "n": s.stop - s.start, "cell": pack(value[s]), "again": pack_bits(again[s]), "index": pack_bits(index[s])}
        for b, s in _cells(value, BLOCK_BITS, buckets)
    ]
    body = {"shard": number, "bucket": -1, "n": len(shard.ids)} | shard.row()
    return pd.DataFrame([*cells, body], columns=_ENCODED.names)


def _encode(batches: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    """Cut a task's texts into shards and read their words."""
    number = TaskContext.get().partitionId() << 32
    ids, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch["key"], batch["text"]):
            ids.append(key)
            texts.append(text.encode("utf-8", "surrogatepass").split() if text else [])
            size += len(texts[-1])
            if size >= SHARD_WORDS:
                yield _rows_of(_Shard.of_texts(ids, texts), number, buckets)
                number += 1
                ids, texts, size = [], [], 0
    if ids:
        yield _rows_of(_Shard.of_texts(ids, texts), number, buckets)


#: What a block's or a window's cell holds for each hash besides it: single bits, or numbers.
_BLOCK_PARTS = (("again", None), ("index", None))
_WINDOW_PARTS = (("low", np.uint32), ("ids", np.int64), ("start", np.uint32))


def _opened(rows: pd.DataFrame, parts: tuple) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The hashes of some cells and their parts, one cell after another, and the cells' sizes."""
    n = rows["n"].to_numpy(dtype=np.int64)
    values = np.concatenate([unpack(c) for c in rows["cell"]])
    held = [np.concatenate([unpack_bits(c, k) if kind is None else _unsqueezed(c, kind) for c, k in zip(rows[name], n)]) for name, kind in parts]
    return values, held, n


def _split_masks(rows: pd.DataFrame, n: np.ndarray, masks: dict[str, np.ndarray]) -> pd.DataFrame:
    """One bit for each hash of each cell."""
    cut = np.cumsum(n)[:-1]
    packed = {name: [pack_bits(x) for x in np.split(mask, cut)] for name, mask in masks.items()}
    return pd.DataFrame({"shard": rows["shard"], "bucket": rows["bucket"], "n": n} | packed)


def _match_blocks(rows: pd.DataFrame) -> pd.DataFrame:
    """For each cell, which hashes recur anywhere and which of those are index blocks somewhere."""
    values, (again, index), n = _opened(rows, _BLOCK_PARTS)
    distinct, inverse = np.unique(values, return_inverse=True)
    recurs = np.bincount(inverse, weights=1 + again, minlength=len(distinct)) > 1
    anchor = recurs & (np.bincount(inverse, weights=index, minlength=len(distinct)) > 0)
    return _split_masks(rows, n, {"recurs": recurs[inverse], "anchor": anchor[inverse]})


def _merge(rows: pd.DataFrame, parts: tuple, bits: int, cells: int, fine: int) -> pd.DataFrame:
    """Cells of one span from several shards, merged and cut into ``fine`` ranges; the team is the shard of what comes out."""
    values, held, _ = _opened(rows.sort_values("shard"), parts)
    order = np.argsort(values, kind="stable")
    values, held = values[order], [h[order] for h in held]
    span, team = int(rows["bucket"].iloc[0]), int(rows["team"].iloc[0])
    inner = range(span * fine + 1, span * fine + fine)
    edges = [min(-(-(b << bits) // (cells * fine)), (1 << bits) - 1) for b in inner]
    cuts = [0, *np.searchsorted(values, np.array(edges, dtype=np.uint64)).tolist(), len(values)]
    out = []
    for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
        if y > x:
            told = [pack_bits(h[x:y]) if kind is None else _squeezed(h[x:y]) for h, (_, kind) in zip(held, parts)]
            out.append((team, span * fine + k, y - x, pack(values[x:y]), *told))
    return pd.DataFrame(out, columns=["shard", "bucket", "n", "cell", *(name for name, _ in parts)])


def _part_again(rows: pd.DataFrame, answers: pd.DataFrame, names: tuple[str, ...]) -> pd.DataFrame:
    """The bits of merged cells, back in the order of the cells they were merged from."""
    rows = rows.sort_values("shard")
    values, _, n = _opened(rows, ())
    order = np.argsort(values, kind="stable")
    masks = {}
    for name, mask in zip(names, _read_masks(answers, names)):
        masks[name] = np.empty(len(mask), dtype=bool)
        masks[name][order] = mask
    return _split_masks(rows, n, masks)


def _answered(sent: DataFrame, match, parts: tuple, names: tuple[str, ...], bits: int, cells: int, fine: int, teams: int) -> DataFrame:
    """``(shard, bucket, n, *names)``: what ``match`` says of each cell, given all cells of its hash range."""
    answer = "shard long, bucket int, n long" + "".join(f", {name} binary" for name in names)
    if fine == 1:
        return sent.groupBy("bucket").applyInPandas(match, answer)
    sent = sent.withColumn("team", F.pmod(F.xxhash64("shard"), F.lit(teams)))
    merged = sent.groupBy("bucket", "team").applyInPandas(
        partial(_merge, parts=parts, bits=bits, cells=cells, fine=fine), "shard long, bucket int, n long, cell binary" + "".join(f", {name} binary" for name, _ in parts)
    )
    found = merged.groupBy("bucket").applyInPandas(match, answer)
    spans = found.withColumns({"span": F.floor(F.col("bucket") / fine).cast("int"), "team": F.col("shard")}).groupBy("span", "team")
    return sent.select("shard", "bucket", "team", "n", "cell").groupBy("bucket", "team").cogroup(spans).applyInPandas(partial(_part_again, names=names), answer)


def _read_masks(masks: pd.DataFrame, names: tuple[str, ...]) -> list[np.ndarray]:
    masks = masks.sort_values("bucket")
    return [np.concatenate([np.zeros(0, bool), *(unpack_bits(c, k) for c, k in zip(masks[x], masks["n"]))]) for x in names]


def _candidates(rows: pd.DataFrame, masks: pd.DataFrame) -> tuple:
    """The shard, its candidate windows (document, start) and, by hash, the distinct ones with their least place."""
    shard = _Shard.of_row(rows.iloc[0])
    inverse = shard.blocks()[3]
    recurs, anchor = _read_masks(masks, ("recurs", "anchor"))
    doc, start = shard.windows(recurs[inverse], anchor[inverse])
    high, low = shard.window_hashes(doc, start)
    order = np.lexsort((start, shard.ids[doc], low, high))
    high, low = high[order], low[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    return shard, doc, start, order, np.flatnonzero(new), np.cumsum(new) - 1, high, low


_WINDOW_COLUMNS = ["bucket", "shard", "n", "cell", "low", "ids", "start"]


def _send_windows(rows: pd.DataFrame, masks: pd.DataFrame, buckets: int) -> pd.DataFrame:
    if not len(rows) or not len(masks):
        return pd.DataFrame([], columns=_WINDOW_COLUMNS)
    shard, doc, start, order, first, _, high, low = _candidates(rows, masks)
    ids, at = shard.ids[doc[order[first]]], start[order[first]]
    high, low = high[first], low[first]
    return pd.DataFrame(
        [
            (b, int(rows["shard"].iloc[0]), s.stop - s.start, pack(high[s]), _squeezed(low[s]), _squeezed(ids[s]), _squeezed(at[s].astype(np.uint32)))
            for b, s in _cells(high, 64, buckets)
        ],
        columns=_WINDOW_COLUMNS,
    )


def _match_windows(rows: pd.DataFrame) -> pd.DataFrame:
    """For each cell, which windows have an equal one at an earlier place in another shard."""
    high, (low, ids, start), n = _opened(rows, _WINDOW_PARTS)
    order = np.lexsort((start, ids, low, high))
    h, l, d, s = high[order], low[order], ids[order], start[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (l[1:] != l[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = np.zeros(len(order), dtype=bool)
    later[order] = (d != d[first]) | (s != s[first])
    return _split_masks(rows, n, {"later": later})


def _gone(shard: _Shard, candidates: tuple, later: pd.DataFrame) -> np.ndarray:
    """Which words of a shard go."""
    doc, start, order, first, group = candidates
    (elsewhere,) = _read_masks(later, ("later",))
    ids, at = shard.ids[doc[order]], start[order]
    lead = first[group] if len(order) else first
    gone = elsewhere[group] | (ids != ids[lead]) | (at != at[lead]) if len(order) else np.zeros(0, dtype=bool)
    edge = np.zeros(len(shard.codes) + 1, dtype=np.int64)
    place = (np.cumsum(shard.sizes) - shard.sizes)[doc[order[gone]]] + at[gone]
    np.add.at(edge, place, 1)
    np.add.at(edge, place + WINDOW, -1)
    return np.cumsum(edge)[:-1] > 0


_KEPT = "key long, n_words long, n_removed long, kept_sha256 string, kept string"


def _finish(rows: pd.DataFrame, masks: pd.DataFrame, with_text: bool) -> pd.DataFrame:
    """What is left of every document of a shard."""
    blocks, later = masks[masks["recurs"].notna()], masks[masks["later"].notna()]
    if len(blocks):
        shard, *candidates, _, _ = _candidates(rows, blocks)
        gone = _gone(shard, tuple(candidates), later)
    else:  # no document is as long as a block
        shard = _Shard.of_row(rows.iloc[0])
        gone = np.zeros(len(shard.codes), dtype=bool)
    words = np.array([*shard.words, None], dtype=object)  # an array of bytes would drop zeros at their ends
    out, begin = [], np.cumsum(shard.sizes) - shard.sizes
    for key, at, n in zip(shard.ids.tolist(), begin.tolist(), shard.sizes.tolist()):
        left = shard.codes[at : at + n][~gone[at : at + n]]
        body = b" ".join(words[left].tolist())
        out.append((key, n, n - len(left), hashlib.sha256(body).hexdigest(), body.decode("utf-8", "replace") if with_text else None))
    return pd.DataFrame(out, columns=["key", "n_words", "n_removed", "kept_sha256", "kept"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(id, n_words, n_removed, kept_sha256[, kept])`` for every row of ``docs``.

    A word goes if a window of ``WINDOW`` words that covers it also starts earlier: in a row of smaller
    id, or of the same id at an earlier start. Null and empty texts have no words. A null id sorts before
    all others. Rows that repeat an id and a text stand at the same place, so neither removes the other.
    An empty table gives none; other columns are ignored.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("key"), F.col(text_col).alias("text"))
    ranges = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // range_bytes))
    fine = -(-ranges // CELLS)  # ranges of a cell
    cells = -(-ranges // fine)
    encoded = materialize(rows.mapInPandas(partial(_encode, buckets=cells), _ENCODED))
    bodies = encoded.where("bucket < 0").select("shard", *(name for name, _ in _BODY), "words").groupBy("shard")
    sent = encoded.where("bucket >= 0").select("bucket", "shard", "n", "cell", "again", "index")
    teams = 1 if fine == 1 else max(1, -(-encoded.where("bucket < 0").count() // fine))
    blocks = materialize(_answered(sent, _match_blocks, _BLOCK_PARTS, ("recurs", "anchor"), BLOCK_BITS, cells, fine, teams))
    windows = bodies.cogroup(blocks.groupBy("shard")).applyInPandas(
        partial(_send_windows, buckets=cells), "bucket int, shard long, n long, cell binary, low binary, ids binary, start binary"
    )
    windows = windows if fine == 1 else materialize(windows)  # it is read twice then
    later = _answered(windows, _match_windows, _WINDOW_PARTS, ("later",), 64, cells, fine, teams)
    masks = blocks.unionByName(later, allowMissingColumns=True)
    left = bodies.cogroup(masks.groupBy("shard")).applyInPandas(partial(_finish, with_text=with_text), _KEPT)
    names = ["n_words", "n_removed", "kept_sha256", *["kept"] * with_text]
    return left.select(F.when(F.col("key") != _NULL_ID, F.col("key")).alias(id_col), *names)
