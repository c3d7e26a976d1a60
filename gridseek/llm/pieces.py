"""SentencePiece encoding and decoding of merge-type (BPE) models (operator 13).

A merge encoding has two properties. Any run of its tokens is the encoding of the text that they cover, and a
row of tokens is an encoding if every two neighbours are the encoding of their own joined text. So every prefix
of a text has one last token: of all tokens that end there, the one that is compatible with the last token of
the prefix before it. An automaton finds the tokens that end at each place, a table keeps the last token of
each prefix, and the ids are read off backwards from the end of the text. Time and memory are linear in the
text, however long a word is, as no queue of merges is kept.

No merge crosses a place between two characters that stand side by side in no piece. Texts are cut at such
places, as far as the model has them: before space marks, and between letters and other characters. The ids of
short parts are remembered, as words recur.
"""

from __future__ import annotations

import gc
import hashlib
import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridseek.plans.durable import unused

SPACE = "▁"
#: Parts of each of two generations that are remembered, tested pairs of a task at most, and characters of a part that is remembered.
PARTS, PAIRS, SHORT = 80_000, 250_000, 24
#: Rows whose decoded texts are held as strings.
ROWS = 500
#: Bytes of a model file at most, as it is broadcast.
MODEL_BYTES = 64 << 20
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6  # kinds of pieces in model files


class Encoder:
    """Prefix-table encoding by one model.

    A model has to be of merge type, with spaces marked and no other change of characters, and without pieces
    that users defined or that are unused; another one raises ``ValueError``.
    """

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        how = proto.normalizer_spec
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE:
            raise ValueError("not a merge-type model")
        if how.precompiled_charsmap or how.remove_extra_whitespaces or not how.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a model that changes characters")
        if any(p.type not in (_NORMAL, _UNKNOWN, 3, _BYTE) for p in proto.pieces):
            raise ValueError("a model with user-defined or unused pieces")
        self.start = SPACE if how.add_dummy_prefix else ""
        self.pieces = [p.piece if p.type == _NORMAL else "" for p in proto.pieces]
        self.scores = [p.score for p in proto.pieces]
        self.ids = {p: i for i, p in enumerate(self.pieces) if p}
        bytes_at = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _BYTE}
        self.byte_ids = [bytes_at[f"<0x{b:02X}>"] for b in range(256)] if proto.trainer_spec.byte_fallback else None
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == _UNKNOWN)
        # characters that occur in pieces only, not as one, are tokens while merges run
        for c in sorted({c for p in self.ids for c in p} - set(self.ids)):
            self.ids[c] = len(self.pieces)
            self.pieces.append(c)
        self.sizes = [len(p) for p in self.pieces]
        self._link()
        self.parts = re.compile(self._cuts()).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.made: dict[int, list[tuple[float, str, str]] | None] = {}

    def _link(self) -> None:
        """The automaton: a state for each start of a token, whose tokens are those that end there, the longest first."""
        self.steps: list[dict[str, int]] = [{}]
        ends: list[int | None] = [None]
        for piece, i in self.ids.items():
            state = 0
            for c in piece:
                if c not in self.steps[state]:
                    self.steps[state][c] = len(self.steps)
                    self.steps.append({})
                    ends.append(None)
                state = self.steps[state][c]
            ends[state] = i
        self.shorter = [0] * len(self.steps)  # the state of the longest other end of the same text
        self.tokens: list[tuple[tuple[int, int], ...]] = [()] * len(self.steps)
        row = [0]
        for state in row:
            row += self.steps[state].values()
            if ends[state] is not None:
                self.tokens[state] = ((ends[state], self.sizes[ends[state]]),)
            if state:
                self.tokens[state] += self.tokens[self.shorter[state]]
            for c, after in self.steps[state].items():
                self.shorter[after] = self._step(self.shorter[state], c) if state else 0
        self.jumps = 0

    def _step(self, state: int, c: str) -> int:
        while c not in self.steps[state] and state:
            state = self.shorter[state]
        return self.steps[state].get(c, 0)

    def _jump(self, state: int, c: str) -> int:
        """A step that no token has, which is remembered."""
        after = self._step(state, c)
        if after and self.jumps < PAIRS:
            self.steps[state][c] = after
            self.jumps += 1
        return after

    def _cuts(self) -> str:
        """A pattern of parts: runs of the largest group of characters that pieces join, or of others, after space marks."""
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            return "(?s:.+)"
        group = {c: c for p in self.ids for c in p}

        def top(c: str) -> str:
            while group[c] != c:
                group[c] = c = group[group[c]]
            return c

        for p in self.ids:
            bare = p.lstrip(SPACE)
            for a, b in zip(bare, bare[1:]):
                group[top(a)] = top(b)
        most = Counter(top(c) for c in group if c != SPACE).most_common(1)
        if not most:
            return "(?s:.+)"
        own = re.escape("".join(sorted(c for c in group if c != SPACE and top(c) == most[0][0])))
        return f"{SPACE}*[{own}]+|{SPACE}*[^{own}{SPACE}]+|{SPACE}+"

    def merges(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """What is left of a short text by the model's rule, the best score first and of equal ones the leftmost, and its
        merges: the score of each, and the first and the last symbol after it."""
        row, steps = list(text), []
        while True:
            best, at = None, -1
            for k in range(len(row) - 1):
                i = self.ids.get(row[k] + row[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if best is None:
                return row, steps
            row[at : at + 2] = [row[at] + row[at + 1]]
            steps.append((best, row[0], row[-1]))

    def _steps(self, token: int) -> list[tuple[float, str, str]] | None:
        """The merges of a token's own text, closed by one that never comes; None if they don't lead to the token."""
        if token not in self.made:
            row, steps = self.merges(self.pieces[token])
            self.made[token] = [*steps, (-math.inf, "", "")] if len(row) == 1 else None
        return self.made[token]

    def compatible(self, last: int, token: int) -> bool:
        """Whether both tokens, or ``token`` alone if ``last`` is -1, are the encoding of their joined text.

        The merges of both go on side by side, the better score first and the left one of equals. They are
        compatible unless, at some time, the symbols that meet between them form a piece that comes before both
        next merges.
        """
        right, key = self._steps(token), last * len(self.pieces) + token
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        if right is None or last < 0:
            self.pairs[key] = right is not None
        else:
            self.pairs[key] = self._apart(self._steps(last), right, self.pieces[last][-1], self.pieces[token][0])
        return self.pairs[key]

    def _apart(self, left, right, end: str, begin: str) -> bool:
        ids, scores, i, j = self.ids, self.scores, 0, 0
        while True:
            ahead, behind, across = left[i][0], right[j][0], ids.get(end + begin)
            if across is not None and scores[across] > ahead and scores[across] >= behind:
                return False
            if ahead >= behind:
                if ahead == -math.inf:
                    return True
                end, i = left[i][2], i + 1
            else:
                begin, j = right[j][1], j + 1

    def _part(self, text: str) -> tuple[int, ...]:
        # -1 at the start and after a character that no piece has
        last = [-1] * (len(text) + 1) if len(text) < 1000 else array("i", [-1]) * (len(text) + 1)
        steps, tokens, tested, width, state = self.steps, self.tokens, self.pairs.get, len(self.pieces), 0
        for at, c in enumerate(text, 1):
            after = steps[state].get(c)
            state = self._jump(state, c) if after is None else after
            for token, size in tokens[state]:
                before = last[at - size]
                fits = tested(before * width + token)
                if fits or (fits is None and self.compatible(before, token)):
                    last[at] = token
                    break
        sizes = self.sizes
        out, at = [] if len(text) < 1000 else array("i"), len(text)
        while at:
            token = last[at]
            if 0 <= token < len(self.scores):
                out.append(token)
                at -= sizes[token]
            else:
                at -= 1
                out.extend(reversed([self.byte_ids[b] for b in text[at].encode()]) if self.byte_ids else [self.unknown])
        out.reverse()
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, without begin or end ids; an empty text has none."""
        out: list[int] = []
        if not text:
            return out
        known = self.known
        for part in self.parts(self.start + text.replace(" ", SPACE)):
            ids = known.get(part)
            if ids is None:
                ids = self.older.get(part) or self._part(part)
                if len(part) <= SHORT:
                    if len(known) >= PARTS:
                        self.older = known
                        self.known = known = {}
                    known[part] = ids
            out += ids
        return out


_READY: dict[str, tuple[Encoder, sentencepiece.SentencePieceProcessor]] = {}


def _ready(model: bytes) -> tuple[Encoder, sentencepiece.SentencePieceProcessor]:
    """The encoder and decoder of a model, made once in a worker."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _READY:
        _READY[key] = Encoder(model), sentencepiece.SentencePieceProcessor(model_proto=model)
        gc.freeze()  # the automaton's many small tables stay; collections needn't look at them
    return _READY[key]


_CODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


def coded(docs: DataFrame, model_path: str, text: Column) -> Column:
    """A struct of the ids of ``text`` and of the text that the library decodes from them.

    The driver reads the model's file, so that no executor needs it; a null text counts as empty.
    """
    with open(model_path, "rb") as file:
        model = file.read(MODEL_BYTES + 1)
    if len(model) > MODEL_BYTES:
        raise ValueError("the model's file is too large to broadcast")
    Encoder(model)  # an unfit model fails here
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(_CODED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, library = _ready(shared.value)
        for texts in batches:
            # texts become strings one by one, and results arrays some rows at a time
            flat, ends, decoded, done = array("i"), array("i", [0]), [], [pa.array([], pa.string())]
            for text in texts:
                ids = encoder.encode(text.as_py())
                flat.extend(ids)
                ends.append(len(flat))
                decoded.append(library.decode(ids) if ids else "")
                if len(decoded) == ROWS:
                    done.append(pa.array(decoded, pa.string()))
                    decoded = []
            done.append(pa.array(decoded, pa.string()))
            lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))
            yield pa.StructArray.from_arrays([lists, pa.concat_arrays(done)], _CODED.names)

    return run(F.coalesce(text, F.lit("")))


def encode_documents(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` and two columns, ``ids`` and ``decoded`` (with underscores added where they have such names).

    Null and empty texts have no ids and decode to an empty text; every row is encoded by itself, whole,
    whatever its length; an empty table stays one.
    """
    made, ids, decoded = unused(docs.columns, "made", "ids", "decoded")
    out = docs.withColumn(made, coded(docs, model_path, F.col(text_col)))
    return out.withColumns({ids: F.col(made)["ids"], decoded: F.col(made)["decoded"]}).drop(made)


def piece_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` of every row; other columns are ignored."""
    rows = encode_documents(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model_path)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select(
        F.col("id").alias(id_col),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
