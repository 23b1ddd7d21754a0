"""Token ids in canonical, length-limited Huffman code with independently decodable blocks.

A written dataset has two tables: ``codebook`` (id, bits) and ``segments``, whose ``payload`` is a
self-contained binary file:

    magic 4s | docs u32 | tokens u64 | blocks u32 | block tokens u32 | bits u64
    ids present u8 * docs | doc ids i64 * docs | tokens per document u32 * docs
    bit offset u64 * blocks | code bits, most significant first, padded with 8 zero bytes

Every block of ``block tokens`` ids starts at its bit offset, so blocks decode alone and in step.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchloom.llm.common import Workspace, hand_back, sized, worker_state

HEADER = struct.Struct("<4sIQIIQ")
MAGIC = b"WLH1"
END_ID = 2
#: Tokens of a segment (cut at document ends once reached) and of a block.
SEGMENT_TOKENS, BLOCK_TOKENS = 1 << 20, 128
#: Tokens packed at once, a multiple of BLOCK_TOKENS.
PACKED = 1 << 15
#: Bytes of text encoded at once; a longer text is cut at blanks.
STEP_BYTES = 4 << 20
#: Distinct chunks, and words, whose ids a worker remembers between steps; beyond that the half met in most
#: steps, late ones counting more, stays. Others are encoded again, with the same ids.
CACHE = 400_000
#: Longer chunks and words are not remembered, so that the number bounds the bytes.
KEPT_BYTES = 64
#: Share of an entry's count that a step leaves.
FADE = 0.95
#: Words encoded in one call; calls of 5,000 took a third more time.
CALL_WORDS = 500
BLANKS = re.compile(rb"[\x09-\x0d\x20]")
#: Pre-tokenizer pattern under which blanks separate a text for good, and words from punctuation.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A word of letters that normalisation does no more to than lower-case, and punctuation after it.
PLAIN = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<rest>[!-&(-/:-@\[-`{-~]*)$"


def tokenizer_file(path: str) -> str:
    """The tokenizer's JSON, read once on the driver; executors get the text, not the path."""
    with open(path, encoding="utf-8") as f:
        return f.read()


class Known:
    """Ids (bytes) by string, as Arrow arrays: a step looks up all its distinct strings at once."""

    def __init__(self):
        self.keys, self.ids, self.met = pa.array([], pa.string()), pa.array([], pa.binary()), np.zeros(0, np.float32)

    def ids_of(self, wanted: pa.Array, encode: Callable[[pa.Array], pa.Array]) -> pa.Array:
        """The ids of distinct strings; ``encode`` gives those of the ones that are not known."""
        at = pc.index_in(wanted, self.keys)
        missing = at.is_null().to_numpy(zero_copy_only=False)
        place = at.fill_null(0).to_numpy().astype(np.int64)
        self.met *= np.float32(FADE)
        self.met[place[~missing]] += 1
        if not missing.any():
            return self.ids.take(pa.array(place))
        new = wanted.filter(pa.array(missing))
        ids = encode(new)
        place[missing] = len(self.keys) + np.arange(len(new))
        out = pa.concat_arrays([self.ids, ids]).take(pa.array(place))
        short = pc.less_equal(pc.binary_length(new), KEPT_BYTES)
        self.keys, self.ids = pa.concat_arrays([self.keys, new.filter(short)]), pa.concat_arrays([self.ids, ids.filter(short)])
        self.met = np.r_[self.met, np.ones(len(self.keys) - len(self.met), np.float32)]
        if len(self.keys) > CACHE:
            half = CACHE // 2
            stay = pa.array(np.sort(np.argpartition(self.met, -half)[-half:]))
            self.keys, self.ids, self.met = self.keys.take(stay), self.ids.take(stay), self.met[stay.to_numpy()]
        return out


class ChunkEncoder:
    """Encodes texts with the tokenizers library and remembers what it has encoded.

    A tokenizer with WORD_PATTERN normalises, splits and merges within runs of non-blank characters
    only, so the ids of a text are those of its chunks between blanks, and the ids of a plain chunk
    are those of its word and its punctuation. Chunks are split, told apart and put together again
    as Arrow columns; Python sees only words and chunks that are new. New words are encoded many at
    a time; the end-of-word mark tells their ids apart. Other tokenizers encode whole texts.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        parts, suffix = json.loads(spec), json.loads(spec)["model"].get("end_of_word_suffix")
        split = [p.get("pattern", {}).get("Regex") for p in (parts.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_word = bool(suffix) and WORD_PATTERN in split
        self.chunks, self.words = Known(), Known()
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if self.by_word:
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of every text and END_ID, as bytes of ``dtype``."""
        column = pa.array([t and t.encode("utf-8", "replace") for t in texts], pa.binary()).cast(pa.string())
        return [x for at, n in steps(column) for x in self.encode_step(column.slice(at, n))]

    def encode_step(self, texts: pa.Array) -> list[bytes]:
        """``encode`` of a column that ``steps`` cut."""
        end, texts = np.array([END_ID], self.dtype).tobytes(), texts.cast(pa.string()).fill_null("")
        if not self.by_word:
            return [x + end for x in self._whole(texts.to_pylist())]
        if len(texts) > 1:
            return [x + end for x in self._by_chunk(texts)]
        return [b"".join(x for part in pieces(t.as_buffer().to_pybytes()) for x in self._by_chunk(pa.array([part], pa.string()))) + end for t in texts]

    def _by_chunk(self, texts: pa.Array) -> list[bytes]:
        lists = pc.ascii_split_whitespace(texts)
        chunks = lists.flatten().dictionary_encode()
        known = self.chunks.ids_of(chunks.dictionary, self._resolve)
        _, at, data = known.take(chunks.indices).buffers()
        if not len(chunks) or data is None:
            return [b""] * len(texts)
        docs = lists.offsets.to_numpy()
        cuts = np.frombuffer(at, np.int32, len(chunks) + 1)[docs - docs[0]].tolist()
        raw = memoryview(data)
        return [bytes(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def _whole(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), 1000):
            out += [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts[at : at + 1000], add_special_tokens=False)]
        return out

    def _resolve(self, chunks: pa.Array) -> pa.Array:
        """The ids of chunks: of words and punctuation that are known, then of the new ones."""
        parts = pc.extract_regex(chunks, PLAIN)
        plain = parts.is_valid()
        word, rest = pc.struct_field(parts.filter(plain), 0), pc.struct_field(parts.filter(plain), 1)
        both = pa.concat_arrays([pc.utf8_lower(word), rest]).dictionary_encode()
        ids = self.words.ids_of(both.dictionary, self._encode_parts).take(both.indices)
        joined = pc.binary_join_element_wise(ids[: len(word)], ids[len(word) :], pa.scalar(b"", pa.binary()))
        return merged(plain, joined, self._whole(chunks.filter(pc.invert(plain)).to_pylist()))

    def _encode_parts(self, parts: pa.Array) -> pa.Array:
        """The ids of lower-case words and of punctuation."""
        word = pc.match_substring_regex(parts, "^[a-zß-öø-ÿ]+$")
        return merged(word, self._encode_words(parts.filter(word).to_pylist()), self._whole(parts.filter(pc.invert(word)).to_pylist()))

    def _encode_words(self, words: list[str]) -> pa.Array:
        out = [pa.array([], pa.binary())]
        for at in range(0, len(words), CALL_WORDS):
            part = words[at : at + CALL_WORDS]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize
            if len(cuts) == len(part):
                out.append(pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(np.r_[0, cuts].astype(np.int32)), pa.py_buffer(ids)]))
            else:
                out.append(pa.array(self._whole(part), pa.binary()))
        return pa.concat_arrays(out)


def merged(first: pa.Array, yes: pa.Array, no: list[bytes]) -> pa.Array:
    """The values of ``yes`` where ``first`` holds, of ``no`` elsewhere, each in its order."""
    if not no:
        return yes
    mask = first.to_numpy(zero_copy_only=False)
    place = np.where(mask, np.cumsum(mask) - 1, len(yes) + np.cumsum(~mask) - 1)
    return pa.concat_arrays([yes, pa.array(no, pa.binary())]).take(pa.array(place))


def pieces(raw: bytes) -> Iterator[bytes]:
    """A text in pieces of about STEP_BYTES, cut at blanks."""
    at = 0
    while len(raw) - at > STEP_BYTES:
        blank = BLANKS.search(raw, at + STEP_BYTES)
        if blank is None:
            break
        yield raw[at : blank.start()]
        at = blank.end()
    yield raw[at:]


def steps(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, rows) of runs of texts of about STEP_BYTES; a longer text is a run of its own."""
    size = pc.fill_null(pc.cast(pc.binary_length(texts), pa.int64()), 0).to_numpy(zero_copy_only=False)
    turn, long = np.cumsum(size) // STEP_BYTES, size > STEP_BYTES
    cuts = np.r_[0, np.flatnonzero((np.diff(turn) > 0) | long[1:] | long[:-1]) + 1, len(turn)] if len(turn) else np.zeros(0, int)
    yield from zip(cuts[:-1].tolist(), np.diff(cuts).tolist(), strict=True)


def _encoder(spec: str) -> ChunkEncoder:
    return worker_state(("tokens", hash(spec)), lambda: ChunkEncoder(spec))


STAGED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("counts", T.BinaryType())])


def _tokenize(spec, size: int):
    """Rows (doc_id, compressed ids) and, last in a partition, one row with the counts of all its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, zip_, counts = _encoder(spec.value), zstandard.ZstdCompressor(level=3), np.zeros(size, np.int64)

        def rows(names: pa.Array, ids: list, count: bytes | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([names, pa.array(ids, pa.binary()), pa.array([count] * len(ids), pa.binary())], STAGED.names)

        for batch in batches:
            for at, n in steps(batch.column(1)):
                part = batch.slice(at, n)
                found = encoder.encode_step(part.column(1))
                counts += np.bincount(np.frombuffer(b"".join(found), encoder.dtype), minlength=size)
                yield rows(part.column(0), [zip_.compress(x) for x in found], None)
                hand_back()
        yield rows(pa.array([None], pa.int64()), [None], zip_.compress(counts.tobytes()))

    return run


def _sum_counts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("token counts")  # lets go of the encoder
        total, unzip = np.zeros(size, np.int64), zstandard.ZstdDecompressor()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(unzip.decompress(x), np.int64)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(total[ids])], ["id", "n"])

    return run


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.uint8)
    if n > 1 << limit:
        raise ValueError("too many symbols for the length limit")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([leaves, packages])
        by = np.argsort(merged, kind="stable")
        levels.append(by < n)
        merged = merged[by]
        packages = merged[0 : len(merged) // 2 * 2 : 2] + merged[1 : len(merged) // 2 * 2 : 2]
    take, lengths = 2 * (n - 1), np.zeros(n, np.uint8)
    for is_leaf in reversed(levels):
        own = int(is_leaf[:take].sum())
        lengths[order[:own]] += 1
        take = 2 * (take - own)
    return lengths


class Code:
    """Canonical code: ids by (length, id) get consecutive codes."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        ids, bits = ids[order].astype(np.int64), bits[order].astype(np.int64)
        self.limit = int(bits.max(initial=1))
        size = np.int64(1) << (self.limit - bits)
        first = np.cumsum(size) - size
        top = int(ids.max(initial=0)) + 1
        self.bits, self.codes = np.zeros(top, np.int64), np.zeros(top, np.uint64)
        self.bits[ids], self.codes[ids] = bits, (first >> (self.limit - bits)).astype(np.uint64)
        self.table = np.zeros(1 << self.limit, np.uint32)  # id << 8 | length, by the next ``limit`` bits
        self.table[: int(size.sum())] = np.repeat(ids << 8 | bits, size)


def pack(code: Code, ids: np.ndarray) -> tuple[bytes, np.ndarray, int]:
    """Code bits, the bit offset of every block, and the number of bits."""
    total = int(code.bits[ids].sum()) if len(ids) else 0
    words, offsets, base = np.zeros((total >> 5) + 4, np.uint64), [], 0
    for a in range(0, len(ids), PACKED):  # so that a step's arrays stay in cache
        part = ids[a : a + PACKED]
        bits = code.bits[part]
        at = np.cumsum(bits) - bits + base
        value = code.codes[part] << (64 - (at & 31) - bits).astype(np.uint64)
        word = at >> 5
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        words[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
        words[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
        offsets.append(at[::BLOCK_TOKENS])
        base = int(at[-1] + bits[-1])
    return words.astype(">u4").tobytes()[: (total + 7) // 8 + 8], np.concatenate([*offsets, np.zeros(0, np.int64)]).astype("<u8"), total


def unpack(code: Code, data: bytes, offsets: np.ndarray, tokens: int) -> np.ndarray:
    """All ids: the blocks are decoded in step, a table look-up each."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    out, pos = np.zeros((len(offsets), BLOCK_TOKENS), np.uint32), offsets.astype(np.int64)
    shift = np.uint32(32 - code.limit)
    for step in range(BLOCK_TOKENS):
        if step == tokens - (len(offsets) - 1) * BLOCK_TOKENS:  # the last block has ended
            pos = pos[:-1]
        if not len(pos):
            break
        entry = code.table[(window[pos >> 3] << (pos & 7).astype(np.uint32)) >> shift]
        out[: len(pos), step] = entry >> 8
        pos = pos + (entry & 255)
    return out.reshape(-1)[:tokens]


def write_segment(code: Code, doc_ids: list[int | None], docs: list[np.ndarray]) -> bytes:
    ids = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    data, offsets, total = pack(code, ids)
    have = np.array([x is not None for x in doc_ids], np.uint8)
    names = np.array([x or 0 for x in doc_ids], "<i8")
    return b"".join([HEADER.pack(MAGIC, len(docs), len(ids), len(offsets), BLOCK_TOKENS, total), have.tobytes(), names.tobytes(), np.array([len(d) for d in docs], "<u4").tobytes(), offsets.tobytes(), data])


def read_segment(code: Code, payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, tokens of each, and all ids of a segment."""
    magic, docs, tokens, blocks, _, _ = HEADER.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a segment")
    at = HEADER.size

    def part(dtype: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, dtype, n, at)
        at += out.nbytes
        return out

    have, names, sizes, offsets = part("u1", docs), part("<i8", docs), part("<u4", docs), part("<u8", blocks)
    return [x if h else None for h, x in zip(have, names.tolist(), strict=True)], sizes.astype(np.int64), unpack(code, payload[at:], offsets, tokens)


SEGMENTS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("docs", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("payload", T.BinaryType())])


def _segments(code, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("token segments")
        part, unzip, seq = TaskContext.get().partitionId(), zstandard.ZstdDecompressor(), 0
        names: list[int | None] = []
        docs: list[np.ndarray] = []
        size = 0

        def cut() -> pa.RecordBatch:
            row = [[part], [seq], [len(docs)], [size], [write_segment(code.value, names, docs)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], SEGMENTS.names)

        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names.append(name)
                docs.append(np.frombuffer(unzip.decompress(blob), dtype))
                size += len(docs[-1])
                if size >= SEGMENT_TOKENS:
                    yield cut()
                    names, docs, size, seq = [], [], 0, seq + 1
        if docs:
            yield cut()

    return run


def _decode(code):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("token segments")
        for batch in batches:
            for begin, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names, sizes, ids = read_segment(code.value, payload)
                ends = np.cumsum(sizes)
                raw = ids.astype("<u4", copy=False)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(begin + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, ws: Workspace, out: str) -> None:
    """Encodes every text, appends END_ID and writes the dataset under ``out`` in ascending doc_id.

    Nulls come first in that order and rows with equal doc_id next to each other, by a hash of their
    ids; null and empty texts have END_ID alone, and very long texts are encoded in pieces. The code
    comes from the counts of all ids (at most a row for each id of the vocabulary reaches the
    driver). Documents are range-partitioned by id, then that hash and their place in the input, so
    that rows of one id, or repeated rows, are split too; a task holds one segment at a time.
    """
    spark = docs.sparkSession
    text = tokenizer_file(tokenizer_path)
    encoder = ChunkEncoder(text)
    size, dtype = max(encoder.tokenizer.get_vocab_size(), END_ID + 1), encoder.dtype.str
    spec = spark.sparkContext.broadcast(text)  # the vocabulary file
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    staged = ws.store(rows.mapInArrow(_tokenize(spec, size), STAGED), "none")
    counts = staged.where("counts is not null").select("counts").mapInArrow(_sum_counts(size), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    ids, n = np.array([r[0] for r in counts], np.int64), np.array([r[1] for r in counts], np.int64)
    bits = code_lengths(n, max(16, int(np.ceil(np.log2(max(len(n), 1) + 1))) + 3))
    spark.createDataFrame([(int(i), int(b)) for i, b in zip(ids, bits, strict=True)], "id int, bits int").coalesce(1).write.parquet(f"{out}/codebook")
    code = spark.sparkContext.broadcast(Code(ids, bits))  # bounded by the vocabulary
    keyed = staged.where("ids is not null").select("doc_id", "ids", F.xxhash64("ids").alias("h"), F.monotonically_increasing_id().alias("n"))
    dealt = keyed.repartitionByRange("doc_id", "h", "n").sortWithinPartitions("doc_id", "h", "n").select("doc_id", "ids")
    dealt.mapInArrow(_segments(code, dtype), SEGMENTS).write.option("compression", "none").parquet(f"{out}/segments")
    ws.drop(staged)


def read_tokens(spark, ws: Workspace, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a written dataset."""
    book = spark.read.parquet(f"{out}/codebook").collect()  # a row for each id of the vocabulary
    code = spark.sparkContext.broadcast(Code(np.array([r[0] for r in book], np.int64), np.array([r[1] for r in book], np.int64)))
    segments = spark.read.schema(SEGMENTS).parquet(f"{out}/segments")
    sizes = segments.select("part", "seq", "tokens")
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("tokens").alias("all"))
    before = parts.select("part", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    starts = sizes.select("part", "seq", F.coalesce(F.sum("tokens").over(within), F.lit(0)).alias("own")).join(before, "part")
    starts = sized(ws.store(starts.select("part", "seq", (F.col("base") + F.col("own")).alias("begin"))))
    placed = segments.join(starts, ["part", "seq"]).select("begin", "payload")
    return placed.mapInArrow(_decode(code), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_index(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of documents, from the files just written.

    See ``write_tokens`` for nulls, ties and repeated rows; an empty table gives no rows and other
    columns are ignored.
    """
    ws = Workspace(docs.sparkSession)
    out = ws.path("tokens")
    write_tokens(docs, tokenizer_path, ws, out)
    return read_tokens(docs.sparkSession, ws, out)
