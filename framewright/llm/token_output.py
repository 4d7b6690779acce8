"""Token ids as range-coded blocks: a static range asymmetric numeral system.

Layout. Documents are range-partitioned and sorted by id; each partition is a
*shard*. Every shard holds blocks; a block is coded by itself with frequency
tables shared by the whole output (counted over all ids). Within a block,
symbol ``i`` belongs to lane ``i % lanes`` and all lanes advance together, so a
step is a handful of array operations. A block carries: where its ids start in
the whole sequence, the segments of documents it holds, the words of the coded
stream, *checkpoints* (lane states and word offset every ``checkpoint_steps``
steps, the first being the start) from each of which decoding can begin, and a
CRC-32 of its ids, which every full decode verifies.

The blocks are written by Spark's own writer to the shared folder, as one row a
block, so any store that Spark can write will do. ``start`` orders the blocks.

Defined results: null text is an empty document (its end id alone). Ids sort
ascending with nulls first; rows with equal ids sort by text. An empty table
writes no blocks. A document longer than a block is cut into segments; memory
is bounded by the block size and the longest text. Ids are held in 16 bits: a
vocabulary of more than 65,536 ids is refused. A text is encoded piece by piece
only with a tokenizer that normalises and splits as ``NORMALIZER`` and ``PRE_TOKENIZER``
say, whole with any other. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import json
import os
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm._worker import Recent, once_per_worker
from framewright.runtime import materialize

SLOT_BITS = 18
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)


# --- the coder -------------------------------------------------------------


def quantize(counts: np.ndarray, bits: int = SLOT_BITS) -> np.ndarray:
    """Integer frequencies that sum to ``2**bits``; every counted symbol gets one at least."""
    counts = np.asarray(counts, dtype=np.int64)
    slots, total = 1 << bits, int(counts.sum())
    if total == 0:
        return np.zeros(len(counts), np.int64)
    if int((counts > 0).sum()) > slots:
        raise ValueError("more symbols than slots")
    freq = np.where(counts > 0, np.maximum(1, (counts.astype(np.float64) * slots / total).astype(np.int64)), 0)
    excess = int(freq.sum()) - slots
    order = np.argsort(-freq, kind="stable")
    if excess < 0:
        freq[order[0]] -= excess
    for at in order:
        if excess <= 0:
            break
        cut = min(excess, int(freq[at]) - 1)
        freq[at] -= cut
        excess -= cut
    return freq


class Tables:
    """Frequencies, their running sums and the slot-to-symbol table."""

    def __init__(self, freq: np.ndarray, bits: int = SLOT_BITS):
        self.bits = np.uint64(bits)
        self.freq = np.asarray(freq, np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.limit = self.freq << np.uint64(63 - bits)
        self.mask = np.uint64((1 << bits) - 1)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), np.asarray(freq, np.int64))


def lanes_for(n: int, most: int = 2048) -> int:
    """Interleaved lanes for ``n`` ids: enough work per lane to pay for its state."""
    return int(max(1, min(most, n // 64)))


def encode_block(ids: np.ndarray, tables: Tables, lanes: int, checkpoint_steps: int = 128) -> tuple[bytes, list[tuple[int, int, bytes]]]:
    """The coded words, and checkpoints as (step, words before it, lane states)."""
    n = len(ids)
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, np.uint64)
    groups: list[np.ndarray] = []
    marks: list[tuple[int, bytes]] = []
    for step in range(steps - 1, -1, -1):
        symbols = ids[step * lanes : (step + 1) * lanes]
        live = len(symbols)
        x, f = state[:live], tables.freq[symbols]
        full = x >= tables.limit[symbols]
        groups.append(x[full].astype(np.uint32))
        x = np.where(full, x >> WORD, x)
        q = x // f
        state[:live] = (q << tables.bits) + (x - q * f) + tables.cum[symbols]
        if step % checkpoint_steps == 0:
            marks.append((step, state.astype("<u8").tobytes()))
    groups.reverse()
    marks.reverse()
    before = np.concatenate([[0], np.cumsum([len(g) for g in groups])]).astype(int)
    words = np.concatenate(groups).astype("<u4").tobytes() if groups else b""
    return words, [(step, int(before[step]), states) for step, states in marks]


def decode_block(words: bytes, n: int, lanes: int, checkpoints, tables: Tables, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids from checkpoint ``first`` up to checkpoint ``last`` (exclusive; None: the end)."""
    steps = -(-n // lanes)
    if n == 0:
        return np.zeros(0, np.uint32)
    step, at, states = checkpoints[first]
    stop = steps if last is None else checkpoints[last][0]
    stream = np.frombuffer(words, "<u4").astype(np.uint64)
    state = np.frombuffer(states, "<u8").astype(np.uint64)
    begin = step * lanes
    out = np.empty(min(n, stop * lanes) - begin, np.uint32)
    for step in range(step, stop):
        live = min(lanes, n - step * lanes)
        x = state[:live]
        slot = x & tables.mask
        symbols = tables.symbol[slot]
        out[step * lanes - begin : step * lanes - begin + live] = symbols
        x = tables.freq[symbols] * (x >> tables.bits) + slot - tables.cum[symbols]
        empty = np.flatnonzero(x < LOW)
        if len(empty):
            x[empty] = (x[empty] << WORD) | stream[at : at + len(empty)]
            at += len(empty)
        state[:live] = x
    return out


# --- tokenising ------------------------------------------------------------


#: What stands before the model in a definition whose pieces :func:`pieces_of` finds.
WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}, BYTES]}

#: Bytes of plain chunks: ASCII, and the letters from À to ÿ, whose second bytes then follow 0xC3 alone.
SPACES = b"\t\n\v\f\r "
PLAIN = bytes({*range(0x80), 0xC3, *range(0x80, 0xC0)} - {0x97, 0xB7})  # 0xC3 before these two: × and ÷
SPACE, LETTER, DIGIT, MARK = range(4)
KINDS = bytes(SPACE if b in SPACES else DIGIT if chr(b) in "0123456789" else MARK if b < 0x80 and not chr(b).isalpha() else LETTER for b in range(256))
OTHERS = bytes(b not in PLAIN for b in range(256))
LOWER = bytes(b + 32 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" or 0x80 <= b <= 0x9E else b for b in range(256))


def little_endian(values: array) -> bytes:
    if sys.byteorder == "big":
        values.byteswap()
    return values.tobytes()


def all_bytes(values: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of all values, of texts in UTF-8, and where each begins and the last ends; null is empty."""
    held = values.cast(pa.large_binary()).fill_null(b"")
    if not len(held):
        return b"", np.zeros(1, np.int64)
    _, offsets, data = held.buffers()
    cuts = np.frombuffer(offsets, np.int64)[held.offset : held.offset + len(held) + 1]
    return (data.slice(int(cuts[0]), int(cuts[-1] - cuts[0])).to_pybytes() if cuts[-1] > cuts[0] else b""), cuts - cuts[0]


def is_plain(raw: bytes) -> bool:
    """Whether no other letters or marks are in it, and no added token."""
    return not raw.translate(None, PLAIN) and b"<|" not in raw


def pieces_of(raw: bytes, cuts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts, and how many end with each text or before.

    In chunks of plain bytes they are those that ``WORDS`` finds in lower case: a run of
    bytes of one kind, a digit by itself, or one of the endings behind an apostrophe that
    no other mark stands before. A chunk (what stands between ASCII white space) with
    other bytes, or with what may be an added token, is one piece as it stands.
    """
    n, starts = len(raw), cuts[:-1]
    kind = np.frombuffer(raw.translate(KINDS), np.uint8)
    first = np.zeros(n + 3, bool)
    first[cuts] = True
    edge = kind == DIGIT
    edge[1:] |= kind[1:] != kind[:-1]
    edge[starts[starts < n]] = True
    if b"'" in raw:
        low = np.frombuffer(raw.translate(LOWER) + bytes(3), np.uint8)
        at = np.flatnonzero(low == ord("'"))
        at = at[edge[at] & ~first[at + 1]]
        one, two = low[at + 1], low[at + 2]
        short = np.isin(one, list(b"stmd"))
        long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))) & ~first[at + 2]
        edge[at[short | long] + 1] = False
        behind = np.concatenate([at[short] + 2, at[long] + 3])
        behind = behind[behind < n]
        edge[behind[kind[behind] == LETTER]] = True
    body = raw.translate(LOWER, SPACES)
    if not is_plain(raw):
        codes = np.frombuffer(raw, np.uint8)
        other = np.frombuffer(raw.translate(OTHERS), bool).copy()
        other[:-1] |= (codes[:-1] == ord("<")) & (codes[1:] == ord("|")) & ~first[1:n]
        solid = kind != SPACE
        opens = solid & first[:n]
        opens[1:] |= solid[1:] & ~solid[:-1]
        chunk = np.cumsum(opens, dtype=np.int32)
        inside = solid & (np.bincount(chunk[other], minlength=chunk[-1] + 1) > 0)[chunk]
        edge[inside] = opens[inside]
        body = np.where(inside, codes, np.frombuffer(raw.translate(LOWER), np.uint8)).tobytes().translate(None, SPACES)
    edges = np.flatnonzero(edge)
    solid = kind[edges] != SPACE
    offsets = np.concatenate([[0], np.cumsum(np.diff(edges, append=n)[solid])]).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(body)])
    return pieces, np.searchsorted(edges[solid], cuts[1:])


class ChunkEncoder:
    """Ids by the tokenizers library, which encodes every distinct piece once.

    The tokenizer that ``NORMALIZER`` and ``PRE_TOKENIZER`` describe never joins across
    white space or across what :func:`pieces_of` parts, so the ids of a text are
    those of its pieces in order. Other tokenizers are given whole texts. The store of
    pieces is bounded (see :class:`Recent`).
    """

    def __init__(self, definition: str, entries: int = 300_000, longest: int = 48):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known = Recent(entries)
        self.longest = longest
        parsed = json.loads(definition)
        model = parsed["model"]
        if max(model["vocab"].values(), default=0) >= 1 << 16:
            raise ValueError("ids of more than 16 bits")
        added = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or any(map(str.isspace, t["content"]))) for t in parsed["added_tokens"])
        self.in_pieces = added and parsed["normalizer"] == NORMALIZER and parsed["pre_tokenizer"] == PRE_TOKENIZER
        suffix = model.get("end_of_word_suffix")
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for t, i in model["vocab"].items() if suffix and t.endswith(suffix)]] = True

    def _word_ids(self, words: list[str], at_once: int = 500) -> list[bytes]:
        """Ids of plain pieces: encoded in long texts, cut where a word's last token ends."""
        texts = [" ".join(words[i : i + at_once]) for i in range(0, len(words), at_once)]
        ids = array("H", [x for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) for x in e.ids])
        stops = (np.flatnonzero(self.ends[np.frombuffer(ids, np.uint16)]) + 1) * 2
        if len(stops) != len(words):  # a tokenizer without word ends, or one that parts words otherwise
            return self._ids(words)
        raw, cuts = little_endian(ids), [0, *stops.tolist()]
        return [raw[i:j] for i, j in zip(cuts, cuts[1:])]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [little_endian(array("H", e.ids)) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 16-bit ids of each text, encoded whole."""
        return self._ids([t or "" for t in texts])

    def _piece_ids(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces; all but long ones are kept for later texts."""
        new = self.known.missing(set(pieces))
        other = [] if is_plain(b" ".join(new)) else [p for p in new if not is_plain(p)]
        plain = list(new.difference(other))
        ids = dict(zip(plain, self._word_ids([p.decode() for p in plain]), strict=True)) | dict(zip(other, self._ids([p.decode() for p in other]), strict=True))
        young = self.known.young
        young.update((p, i) for p, i in ids.items() if len(p) <= self.longest)
        return [young[p] if p in young else ids[p] for p in pieces]

    def encode_column(self, texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """16-bit ids of all texts, each with ``end`` behind it, and how many there are of each."""
        if not self.in_pieces:
            whole = [x + end for x in self.encode(texts.to_pylist())]
            return np.frombuffer(b"".join(whole), "<u2"), np.array([len(x) // 2 for x in whole], np.int64)
        pieces, stops = pieces_of(*all_bytes(texts))
        coded = pieces.dictionary_encode()
        held = self._piece_ids(coded.dictionary.to_pylist())
        held.append(end)
        sizes = np.array([len(x) // 2 for x in held], np.int64)
        order = np.insert(coded.indices.to_numpy(), stops, len(held) - 1)
        n = sizes[order]
        done = np.cumsum(n)
        where = np.repeat((np.cumsum(sizes) - sizes)[order] - (done - n), n)
        where += np.arange(len(where))
        return np.frombuffer(b"".join(held), "<u2")[where], np.diff(done[stops + np.arange(len(stops))], prepend=0)


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``most`` bytes in a column of texts, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def _schema(id_type) -> T.StructType:
    return T.StructType([T.StructField("doc", id_type), T.StructField("shard", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, shard, start (ids before it in its shard), n, ids (16-bit), sorted by doc in each shard."""
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: a few MB, whatever the corpus
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = definition.value
        encoder = once_per_worker(("chunks", zlib.crc32(text.encode())), lambda: ChunkEncoder(text))
        shard, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, 1):
                ids, n = encoder.encode_column(part.column(1), end)
                stops = np.concatenate([[0], np.cumsum(n)])
                kept = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(2 * stops), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(n), shard, np.int32)), pa.array(start + stops[:-1]), pa.array(n), kept], ["doc", "shard", "start", "n", "ids"])
                start += int(stops[-1])

    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("body"))
    ordered = rows.repartitionByRange("doc").sortWithinPartitions("doc", "body")
    return ordered.mapInArrow(run, _schema(docs.schema[id_col].dataType))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        ids = np.frombuffer(all_bytes(batch.column(0))[0], "<u2")
        for at in range(0, len(ids), 1 << 20):
            total += np.bincount(ids[at : at + (1 << 20)], minlength=1 << 16)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["id", "n"])


def shared_tables(tokens: DataFrame) -> np.ndarray:
    """Quantised frequencies over all ids: at most 65,536 numbers reach the driver."""
    counted = tokens.select("ids").mapInArrow(_counts, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 << 16, np.int64)
    for row in counted:
        counts[row.id] = row.n
    return quantize(counts)


_MARKS = pa.list_(pa.struct([("step", pa.int64()), ("word", pa.int64()), ("states", pa.binary())]))


def write_blocks(tokens: DataFrame, block_ids: int = 1 << 19) -> tuple[DataFrame, np.ndarray]:
    """Write the blocks; return a DataFrame that reads them, and the shared frequencies."""
    spark, id_type = tokens.sparkSession, tokens.schema["doc"].dataType
    freq = shared_tables(tokens)
    shipped = spark.sparkContext.broadcast(freq)
    before, offsets = 0, {}
    for row in tokens.groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect():  # a row a task
        offsets[row.shard], before = before, before + row.n
    offsets = spark.sparkContext.broadcast(offsets)
    segment = T.ArrayType(T.StructType([T.StructField("doc", id_type), T.StructField("n", T.LongType()), T.StructField("before", T.LongType()), T.StructField("crc_before", T.LongType()), T.StructField("ends", T.BooleanType())]))
    mark = T.ArrayType(T.StructType([T.StructField("step", T.LongType()), T.StructField("word", T.LongType()), T.StructField("states", T.BinaryType())]))
    schema = T.StructType([T.StructField("start", T.LongType()), T.StructField("n", T.LongType()), T.StructField("lanes", T.IntegerType()), T.StructField("crc32", T.LongType()), T.StructField("words", T.BinaryType()), T.StructField("checkpoints", mark), T.StructField("segments", segment)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, shift, arrow_segment = Tables(shipped.value), offsets.value, None
        parts: list[np.ndarray] = []
        segments: list[dict] = []
        held, begin, expected = 0, 0, None

        def flush():
            nonlocal parts, segments, held
            ids = np.concatenate(parts)
            lanes = lanes_for(len(ids))
            words, marks = encode_block(ids, tables, lanes)
            values = [[begin], [len(ids)], [lanes], [zlib.crc32(ids.astype("<u4").tobytes())], [words], [[{"step": a, "word": b, "states": c} for a, b, c in marks]], [segments]]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), _MARKS, arrow_segment]
            parts, segments, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], schema.names)

        for batch in batches:
            arrow_segment = pa.list_(pa.struct([("doc", batch.schema.field("doc").type), ("n", pa.int64()), ("before", pa.int64()), ("crc_before", pa.int64()), ("ends", pa.bool_())]))
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for doc, shard, start, n, raw in zip(*columns, batch.column(4), strict=True):
                start += shift[shard]
                if held and start != expected:
                    yield flush()
                if not held:
                    begin = start
                expected = start + n
                ids, done, crc = np.frombuffer(raw.as_buffer(), "<u2"), 0, 0
                while done < n:
                    take = min(n - done, block_ids - held)
                    piece = ids[done : done + take]
                    parts.append(piece)
                    segments.append({"doc": doc, "n": take, "before": done, "crc_before": crc, "ends": done + take == n})
                    done, held = done + take, held + take
                    if held == block_ids:
                        yield flush()
                        begin = start + done
                    if done < n:
                        crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
        if held:
            yield flush()

    return materialize(tokens.mapInArrow(run, schema), "rans-blocks"), freq


def read_blocks(blocks: DataFrame, freq: np.ndarray) -> DataFrame:
    """doc, start, n, crc32 of every document, decoded from the blocks and verified."""
    shipped = blocks.sparkSession.sparkContext.broadcast(freq)
    id_type = blocks.schema["segments"].dataType.elementType["doc"].dataType
    schema = T.StructType([T.StructField("doc", id_type), T.StructField("start", T.LongType()), T.StructField("n", T.LongType()), T.StructField("crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(shipped.value)
        for batch in batches:
            kind = batch.schema.field("segments").type.value_type.field("doc").type
            for row in range(batch.num_rows):
                block = {name: batch.column(i)[row].as_py() for i, name in enumerate(batch.schema.names)}
                marks = [(m["step"], m["word"], m["states"]) for m in block["checkpoints"]]
                raw = memoryview(decode_block(block["words"], block["n"], block["lanes"], marks, tables).astype("<u4").tobytes())
                if zlib.crc32(raw) != block["crc32"]:
                    raise ValueError(f"block at {block['start']}: checksum mismatch")
                at, out = 0, ([], [], [], [])
                for s in block["segments"]:
                    if s["ends"]:
                        crc = zlib.crc32(raw[4 * at : 4 * (at + s["n"])], s["crc_before"])
                        for column, value in zip(out, (s["doc"], block["start"] + at - s["before"], s["before"] + s["n"], crc), strict=True):
                            column.append(value)
                    at += s["n"]
                yield pa.RecordBatch.from_arrays([pa.array(out[0], kind), *(pa.array(c, pa.int64()) for c in out[1:])], ["doc", "start", "n", "crc32"])

    return blocks.mapInArrow(run, schema)


def op8_token_output(spark, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokens = materialize(token_table(docs, tokenizer_path, end_id=1), "token-ids")
    found = read_blocks(*write_blocks(tokens))
    return found.select(F.col("doc").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.col("crc32").alias("ids_crc32"))
