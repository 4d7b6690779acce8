"""Byte-level BPE as a streaming transducer with bounded lookahead.

Encoding. A text is read in slices. A small pre-tokenizer cuts the characters
into pieces and keeps the running piece open across slices. The bytes of every
piece, short or long, go into one machine, :class:`Transducer`, and the end of a
piece is a flush mark in its input. The machine is the only place where tokens
are made. What it made of a whole short piece is kept in a bounded store, so that
a piece seen again is read from there.

Lookahead. What stands to the right of a byte can change the tokens left of it
only through a chain of merges, each of a later rank than the one before and
each one token further left: the first merge touches the unseen bytes; the next
joins the left neighbour ``t`` to a token that begins with the left part of the
merge before. :func:`sufficient_lookahead` takes the longest such chain, in
bytes, over the merge list (one pass in rank order). A token that ends at least
that many bytes before the last byte read is final; at a flush mark no byte
follows, and every token is. These two are the stability rule. Merging may start
again at any final boundary, for no merge crosses it, so the machine holds the
undecided bytes of one window and nothing else, however long the piece.

Decoding is a state machine over bytes: token bytes go in, whole characters
come out, and the state is the at most three bytes of an unfinished one.

Defined results: null text counts as empty and has no tokens; the strings of
added tokens in a text become those tokens, as the tokenizers library does by
default. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import sys
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm._worker import Recent, once_per_worker


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeTable:
    """Tokens as ids, merges as ``(left, right) -> (rank, merged)``."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        stands_for = byte_alphabet()
        raw = lambda token: bytes(stands_for[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.token_bytes: dict[int, bytes] = {i: raw(t) for t, i in vocab.items()}
        self.byte_id = [vocab[c] for c, _ in sorted(stands_for.items(), key=lambda x: x[1])]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes |= {i: t.encode() for t, i in self.added.items()}
        self.lookahead = sufficient_lookahead(self.merges, {i: len(b) for i, b in self.token_bytes.items()})


def sufficient_lookahead(merges: dict[tuple[int, int], tuple[int, int]], length: dict[int, int]) -> int:
    """Bytes of right context after which a token boundary no longer changes."""
    left_of: dict[int, int] = {}  # the left part of each merged token
    reach: dict[int, int] = {}  # the longest chain whose last merge has this left part
    longest = 0
    for (a, b), (rank, merged) in sorted(merges.items(), key=lambda m: m[1][0]):
        for part in (a, b):
            made = left_of.get(part)
            if made is None and length[part] > 1:
                raise ValueError(f"merge {rank} uses a token that no earlier merge makes")
        chain, head = length[b], b
        while head is not None:
            chain = max(chain, reach.get(head, 0))
            head = left_of.get(head)
        reach[a] = max(reach.get(a, 0), length[a] + chain)
        longest = max(longest, reach[a])
        left_of.setdefault(merged, a)
    return longest + 1


def merge_piece(data: bytes, table: MergeTable) -> list[int]:
    """All merges of one piece: lowest rank first, leftmost first among equals."""
    merges, ids = table.merges, [table.byte_id[b] for b in data]
    if len(ids) > 96:
        return _merge_long(ids, merges)
    none = (sys.maxsize, 0)
    ranks = [merges.get(pair, none) for pair in zip(ids, ids[1:])]
    while ranks:
        best = min(ranks)
        if best is none:
            break
        at = ranks.index(best)
        ids[at : at + 2] = [best[1]]
        del ranks[at]
        if at:
            ranks[at - 1] = merges.get((ids[at - 1], ids[at]), none)
        if at < len(ranks):
            ranks[at] = merges.get((ids[at], ids[at + 1]), none)
    return ids


def _merge_long(ids: list[int], merges) -> list[int]:
    """The same by a heap over a linked list: n log n for long windows."""
    n = len(ids)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = []

    def offer(at: int) -> None:
        if at >= 0 and after[at] < n and (found := merges.get((ids[at], ids[after[at]]))):
            heapq.heappush(heap, (found[0], at, ids[at], ids[after[at]], found[1]))

    for at in range(n - 1):
        offer(at)
    while heap:
        _, at, left, right, merged = heapq.heappop(heap)
        if not alive[at] or ids[at] != left or after[at] >= n or ids[after[at]] != right:
            continue
        gone = after[at]
        alive[gone], ids[at], after[at] = False, merged, after[gone]
        if after[at] < n:
            before[after[at]] = at
        offer(before[at])
        offer(at)
    return [x for x, live in zip(ids, alive) if live]


class Transducer:
    """Bytes go in, tokens come out once no later byte can change them.

    ``settled`` counts the tokens that came out for want of nothing but
    ``lookahead`` bytes behind them, ``flushed`` those that a mark let out; there
    is no other way out. ``window`` bytes are read between two looks, so memory
    is ``window + lookahead`` bytes and every byte is merged about 4/3 times.
    """

    def __init__(self, table: MergeTable):
        self.table, self.held = table, b""
        self.window = max(4 * table.lookahead, 256)
        self.settled = self.flushed = 0

    def feed(self, data: bytes) -> list[int]:
        """The tokens that these bytes make final."""
        out: list[int] = []
        for at in range(0, len(data), self.window):
            self.held += data[at : at + self.window]
            if len(self.held) > self.window:
                out += self._stable(len(self.held) - self.table.lookahead)
        self.settled += len(out)
        return out

    def _stable(self, limit: int) -> list[int]:
        out, end = [], 0
        for token in merge_piece(self.held, self.table):
            size = len(self.table.token_bytes[token])
            if end + size > limit:
                break
            out.append(token)
            end += size
        self.held = self.held[end:]
        return out

    def mark(self) -> list[int]:
        """The end of a piece: no merge crosses it, so what is held is final."""
        out = merge_piece(self.held, self.table)
        self.held = b""
        self.flushed += len(out)
        return out


def _unassigned_letters() -> str:
    """Letters and digits that Unicode added after this Python's own tables; to the tokenizer they are symbols."""
    free = "".join(chr(c) for c in range(0x10FFFF + 1) if unicodedata.category(chr(c)) == "Cn")
    return "".join(regex.findall(r"[\p{L}\p{N}]", free))


class StreamEncoder:
    """Texts to ids: streaming pre-tokenizer, transducer, store of its results.

    ``feed``/``finish`` take a text in slices of any size. The store is bounded
    (see :class:`Recent`); without one (``entries=0``) every piece runs through
    the machine.
    """

    OPEN = 8  # characters of an unfinished piece that are sure not to be part of a contraction

    def __init__(self, table: MergeTable, entries: int = 100_000, longest: int = 32, slice_chars: int = 1 << 16):
        self.table, self.entries, self.longest, self.slice_chars = table, entries, longest, slice_chars
        self.fast = self._compiled()
        self.exact = None
        self.added = regex.compile("|".join(map(regex.escape, sorted(table.added, key=len, reverse=True)))) if table.added else None
        self.holdback = max(map(len, table.added), default=1) - 1
        self.known = Recent(entries)
        self.machine = Transducer(table)
        self.reset()

    def reset(self) -> None:
        self.rest = ""  # characters whose piece, or added token, is not settled
        self.machine.held = b""
        self.kind = ""  # of the piece that is open in the machine: S (white space), L, N or O (other)

    def _grammar(self, text: str):
        """The pattern of pieces, and of a run of each class, for this text."""
        try:
            text.encode("latin-1")
            return self.fast
        except UnicodeEncodeError:
            if self.exact is None:
                new = regex.escape(_unassigned_letters())
                letter, digit = (rf"(?:(?![{new}])\p{{{c}}})" if new else rf"\p{{{c}}}" for c in "LN")
                other = rf"(?:[^\s\p{{L}}\p{{N}}]|[{new}])" if new else r"[^\s\p{L}\p{N}]"
                self.exact = self._compiled(letter, digit, other)
            return self.exact

    @staticmethod
    def _compiled(letter: str = r"\p{L}", digit: str = r"\p{N}", other: str = r"[^\s\p{L}\p{N}]"):
        pieces = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{digit}+| ?{other}+|\s+(?!\S)|\s+")
        return pieces, {k: regex.compile(c + "*") for k, c in (("S", r"\s"), ("L", letter), ("N", digit), ("O", other))}

    def _ids(self, piece: str) -> bytes:
        return self._bytes(self.machine.feed(piece.encode()) + self.machine.mark())

    def pieces(self, found: list[str]) -> bytes:
        """Ids of whole pieces, as little-endian 32-bit integers."""
        if not self.entries:
            return b"".join(map(self._ids, found))
        try:
            return b"".join(map(self.known.young.__getitem__, found))
        except KeyError:
            pass
        long = {}
        new = self.known.missing(set(found))
        young = self.known.young
        for piece in new:
            (young if len(piece) <= self.longest else long)[piece] = self._ids(piece)
        if not long:
            return b"".join(map(young.__getitem__, found))
        return b"".join([long[p] if p in long else young[p] for p in found])

    # -- a text at once, slice by slice --

    def encode(self, text: str) -> Iterator[bytes]:
        """Id bytes of a text, slice by slice."""
        for at in range(0, len(text), self.slice_chars):
            yield self.feed(text[at : at + self.slice_chars])
        yield self.finish()

    def feed(self, text: str) -> bytes:
        return self._advance(self.rest + text, last=False)

    def finish(self) -> bytes:
        out = self._advance(self.rest, last=True)
        self.reset()
        return out

    def _advance(self, text: str, last: bool) -> bytes:
        out, at = [], 0
        if self.added:
            for m in self.added.finditer(text):
                out.append(self._plain(text[at : m.start()], last=True))
                out.append(np.array([self.table.added[m[0]]], "<u4").tobytes())
                at = m.end()
        text = text[at:]
        if last:
            self.rest = ""
            out.append(self._plain(text, last=True))
            return b"".join(out)
        # the end may begin an added token; what precedes it may go on
        keep = min(len(text), self.holdback)
        settled, tail = text[: len(text) - keep], text[len(text) - keep :]
        done = self._plain(settled, last=False)
        self.rest += tail
        out.append(done)
        return b"".join(out)

    def _plain(self, text: str, last: bool) -> bytes:
        """Pieces of text free of added tokens; unless ``last``, the open end stays in ``rest``."""
        out, self.rest = [], ""
        if self.kind:
            taken = self._grammar(text)[1][self.kind].match(text).end()
            over = taken < len(text)
            if self.kind == "S" and taken and not (last and not over):
                taken -= 1  # the last white space may go with what follows
            out.append(self._bytes(self.machine.feed(text[:taken].encode())))
            text = text[taken:]
            if not (over or last):
                self.rest = text
                return b"".join(out)
            out.append(self._bytes(self.machine.mark()))
            self.kind = ""
        pattern, runs = self._grammar(text)
        found = pattern.findall(text)
        if last:
            out.append(self.pieces(found))
            return b"".join(out)
        # the last piece may grow, and a lone apostrophe before it may turn out to be a contraction
        tail = found.pop() if found else ""
        if len(tail) > self.OPEN:
            out.append(self.pieces(found))
            self.kind = next(k for k, run in runs.items() if run.match(tail[-1]).end())
            cut = len(tail) - (self.kind == "S")
            out.append(self._bytes(self.machine.feed(tail[:cut].encode())))
            self.rest = tail[cut:]
            return b"".join(out)
        if found and found[-1] == "'":
            tail = found.pop() + tail
        out.append(self.pieces(found))
        self.rest = tail
        return b"".join(out)

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()


class StreamDecoder:
    """Ids to text, a slice at a time; broken characters become U+FFFD."""

    def __init__(self, table: MergeTable):
        size = max(table.token_bytes) + 1
        self.tokens = [table.token_bytes.get(i, b"") for i in range(size)]
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join(map(self.tokens.__getitem__, ids)))

    def finish(self) -> str:
        out = self.machine.decode(b"", True)
        self.machine.reset()
        return out


def _machines(definition: str) -> tuple[StreamEncoder, StreamDecoder]:
    table = MergeTable(definition)
    return StreamEncoder(table), StreamDecoder(table)


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256; with ``with_ids`` also ids and decoded text."""
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: a few MB, whatever the corpus
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = definition.value
        encoder, decoder = once_per_worker(("bpe", zlib.crc32(text.encode())), lambda: _machines(text))
        encoder.reset()
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [], [])
            for text in batch.column(1):
                n, ids_sha, text_sha, ids, texts = 0, hashlib.sha256(), hashlib.sha256(), [], []
                for raw in encoder.encode(text.as_py() or ""):
                    n += len(raw) // 4
                    ids_sha.update(raw)
                    part = np.frombuffer(raw, "<u4").tolist()
                    decoded = decoder.feed(part)
                    text_sha.update(decoded.encode())
                    if with_ids:
                        ids += part
                        texts.append(decoded)
                decoded = decoder.finish()
                text_sha.update(decoded.encode())
                values = (n, ids_sha.hexdigest(), text_sha.hexdigest(), ids, "".join([*texts, decoded]))
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            arrays = [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())]
            if with_ids:
                arrays += [pa.array(columns[3], pa.list_(pa.int32())), pa.array(columns[4], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in fields])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, T.StructType(fields))


def op4_bpe_stream(spark, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path)
