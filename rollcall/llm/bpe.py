"""Byte-level BPE by merge replay over the distinct words of a task's documents."""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import batched

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import Memo, Shipped, few_rows, ids_by_chunk, packed, passing, texts_of, unpacked, with_text

MOST_CHUNKS = 400_000  # chunks of text whose ids a Python worker keeps
DOCS_AT_ONCE = 512
# Texts are cut between an ASCII letter or digit and an ASCII mark.
CUT = tuple(np.array([c < 128 and chr(c).isalnum() == wanted and 32 < c < 127 for c in range(256)]) for wanted in (True, False))
# White space beyond ASCII, in UTF-8
WIDE_BLANK = re.compile(rb"\xC2[\x85\xA0]|\xE1\x9A\x80|\xE2\x80[\x80-\x8A\xA8\xA9\xAF]|\xE2\x81\x9F|\xE3\x80\x80")
LISTS = 1 << 22  # symbols up to which the faster lists are used


class Vocabulary:
    """Ranks of a tiktoken file: token bytes per id, and the id that each pair of
    ids merges into."""

    def __init__(self, content: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        # \s as the White_Space property, which the regex module's own \s exceeds
        white = pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
        self.pattern = regex.compile(white)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        # What an id merges into with the id to its right, or to its left.
        self.with_right: dict[int, dict[int, int]] = {}
        self.with_left: dict[int, dict[int, int]] = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    self.with_right.setdefault(left, {})[right] = rank
                    self.with_left.setdefault(right, {})[left] = rank
        self.first = np.full((256, 256), -1, dtype=np.int32)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.first[token[0], token[1]] = rank
        self.chunks = Memo(self._chunks, MOST_CHUNKS)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (not empty), as little-endian 32-bit integers.

        All words lie end to end as one chain of symbols per word. An index holds
        the positions of each pair that can merge; the pairs are taken from the
        lowest rank up, all positions of a pair from the left, and a merge only
        touches the pairs to its left and right. A merge that makes a pair of a
        lower rank possible hands over to it first, as it would within its word.
        """
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        stop = size.cumsum()
        n = len(data)
        pair = np.full(n, -1, dtype=np.int32)
        pair[:-1] = self.first[data[:-1], data[1:]]
        pair[stop - 1] = -1
        after = np.arange(1, n + 1, dtype=np.int32)
        after[stop - 1] = -1
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[stop - size] = -1

        at = np.flatnonzero(pair >= 0)
        at = at[np.argsort(pair[at], kind="stable")]
        ranks, starts = np.unique(pair[at], return_index=True)
        index = dict(zip(ranks.tolist(), (x.tolist() for x in np.split(at, starts[1:])))) if len(at) else {}
        heap = list(index)
        heapify(heap)

        chain = (lambda a: a.tolist()) if n <= LISTS else (lambda a: array("i", a.astype(np.int32).tobytes()))
        symbol, pair, after, before = map(chain, (self.byte[data], pair, after, before))
        none: dict[int, int] = {}
        while heap:
            rank = heappop(heap)
            places = index.pop(rank)
            places.sort()
            rightward, leftward = self.with_right.get(rank, none).get, self.with_left.get(rank, none).get
            for k, p in enumerate(places):
                if pair[p] != rank:
                    continue  # a neighbour's merge took it
                q = after[p]
                s = after[q]
                symbol[p], symbol[q], pair[q], after[p] = rank, -1, -1, s
                lower = False
                if s >= 0:
                    before[s] = p
                    pair[p] = new = rightward(symbol[s], -1)
                    if new >= 0:
                        at = index.get(new)
                        if at is None:
                            index[new] = [p]
                            heappush(heap, new)
                            lower = new < rank
                        else:
                            at.append(p)
                else:
                    pair[p] = -1
                o = before[p]
                if o >= 0:
                    pair[o] = new = leftward(symbol[o], -1)
                    if new >= 0:
                        at = index.get(new)
                        if at is None:
                            index[new] = [o]
                            heappush(heap, new)
                            lower = lower or new < rank
                        else:
                            at.append(o)
                if lower:
                    index[rank] = places[k + 1:]
                    heappush(heap, rank)
                    break
        symbol = np.array(symbol, dtype="<i4")
        alive = symbol >= 0
        ends = 4 * np.add.reduceat(alive, stop - size).cumsum()
        ids = symbol[alive].tobytes()
        return [ids[a:b] for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist())]

    def _matches(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each distinct match."""
        distinct = list(dict.fromkeys(words))
        return dict(zip(distinct, self.replay([w.encode() for w in distinct]))) if distinct else {}

    def _chunks(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of chunks (:func:`rollcall.llm.common.chunks_of`). A match of the
        pattern never reaches from other characters into blanks, nor from letters or
        digits into marks, and looks no further than the next character, so chunks
        can be matched one by one."""
        words = [self.pattern.findall(c.decode()) for c in chunks]
        ids = self._matches([w for some in words for w in some])
        return [ids[some[0]] if len(some) == 1 else b"".join([ids[w] for w in some]) for some in words]

    def _plain(self, text: bytes) -> bytes:
        """Ids of a text match by match."""
        out = []
        for some in batched(self.pattern.finditer(text.decode()), 1 << 16):
            words = [m.group() for m in some]
            out.append(b"".join(map(self._matches(words).__getitem__, words)))
        return b"".join(out)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text (UTF-8), as little-endian 32-bit integers. Texts with
        other white space than ASCII blanks, which can join them in one match,
        aren't cut at blanks."""
        whole = [i for i, t in enumerate(texts) if not t.isascii() and WIDE_BLANK.search(t)]
        out = ids_by_chunk([b"" if i in set(whole) else t for i, t in enumerate(texts)] if whole else texts, self.chunks.of, CUT)
        for i in whole:
            out[i] = self._plain(texts[i])
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def _vocabulary(file: Shipped, pattern: str) -> Vocabulary:
    """Built once per Python worker."""
    return Vocabulary(file.content, pattern)


def _ids_array(ids: list[bytes]) -> pa.ListArray:
    offsets = np.append(0, np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in passing(batches):
        for start in range(0, batch.num_rows, DOCS_AT_ONCE):
            yield batch.slice(start, DOCS_AT_ONCE)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array<int>), the tokens of each whole text, and with
    ``decoded`` also that column (binary), the bytes that the ids stand for.

    ``path`` is a tiktoken rank file read by the driver; each match of ``pattern``
    is encoded separately, without special tokens. A task replays the merges over
    the distinct words of some hundred documents at a time (:meth:`Vocabulary.replay`)
    and keeps the ids of at most ``MOST_CHUNKS`` chunks. No shuffle.

    Null texts count as empty and have no ids; invalid UTF-8 is read with
    replacement characters. Rows keep all their columns, repeated ones too; own
    columns ``ids`` and ``decoded`` of ``docs`` are replaced. An empty table gives no rows.
    """
    file = Shipped(docs.sparkSession, path)
    rows, nth = with_text(docs.drop("ids", "decoded"), text)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(file, pattern)
        for batch in _slices(batches):
            ids = vocabulary.encode([t.decode("utf-8", "replace").encode() for t in texts_of(batch.column("row").field(nth))])
            columns = [batch.column("row"), _ids_array(ids)]
            if decoded:
                columns.append(pa.array([vocabulary.decode(np.frombuffer(x, dtype="<i4").tolist()) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["row", "ids", "decoded"][: len(columns)])

    schema = T.StructType([rows.schema["row"]]).add("ids", T.ArrayType(T.IntegerType()))
    schema = schema.add("decoded", T.BinaryType()) if decoded else schema
    return unpacked(rows.mapInArrow(add, schema), *schema.names[1:])


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``tokens`` with ``decoded`` (binary): the bytes of each row's ids. Null ids
    count as empty; an id outside the vocabulary is an error."""
    file = Shipped(tokens.sparkSession, path)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(file, pattern)
        for batch in _slices(batches):
            data = [vocabulary.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(data, pa.binary())], names=["row", "decoded"])

    rows = packed(few_rows(tokens).drop("decoded"), ids=F.col(f"`{ids}`"))
    return unpacked(rows.mapInArrow(add, rows.select("row").schema.add("decoded", T.BinaryType())), "decoded")


def digests(tokens: DataFrame) -> DataFrame:
    """``tokens(ids, decoded)`` with n_tokens, and SHA-256 of the decimal ids joined by
    commas and of the decoded bytes."""
    return tokens.withColumns({
        "n_tokens": F.size("ids").cast("long"),
        "ids_sha256": F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256),
        "decoded_sha256": F.sha2("decoded", 256),
    })
