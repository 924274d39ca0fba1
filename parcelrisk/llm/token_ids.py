"""Token ids of whole texts in a compact binary file format, and back.

Format: ``<path>/ids`` holds blocks of consecutive documents (ascending id) as
Parquet rows, so that any store Spark reaches will do; ``<path>/ranks`` maps
ranks to token ids.  A block's ids are replaced by their frequency rank (the
most frequent id is 0, so nearly all take one byte) and coded with one to four
data bytes each; the two-bit lengths stand apart in control bytes, four to a
byte, low bits first.  A control byte looks up its four lengths in a table, so
numpy decodes a block without a loop.

Texts are cut at ASCII white space, where no token of a white-space-dropping
vocabulary can cross; each batch encodes its different words once.

Edge cases: a null or empty text has only the end id.  Null ids come first;
rows of one id follow each other by a hash of their ids and then as read, and
repeated rows are all written.  Very long texts are cut into segments at white
space.  Input columns other than id and text are not read.  An empty table
gives empty files that read back as no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, written

_CHUNK = 1 << 20             # bytes encoded at a time
_GROUP = 8                   # so many chunks look up their words at once
_SLICE = 1 << 14             # texts that are Python strings at a time
_BLOCK_IDS = 1 << 20         # a block is closed when it has so many ids
#: Data bytes of the four values that a control byte describes.
_LENGTHS = (np.arange(256)[:, None] >> (2 * np.arange(4))[None, :]) % 4 + 1


# The pre-tokenizer pattern that ``_PIECE`` follows, and the kinds
# of steps it goes with.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PRE_TOKENIZERS = ["Split", "ByteLevel"]
#: Lines (words) of these characters only: ASCII, and Latin-1 letters in both cases.
_PLAIN = re.compile(r"[\n!-~À-ÖØ-öø-ÿ]*").fullmatch
#: The pattern for such lines in lower case; a line's end is a piece.
_PIECES = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\n]+|\n").findall


#: The byte-level alphabet: printable bytes stand for themselves, the others
#: for the code points from 256 on.
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
del _BYTE_LETTERS[0x0A]      # ends a line here, and is part of no word


def _binaries(offsets: np.ndarray, data: pa.Buffer | None) -> pa.Array:
    """The values of ``data`` between the offsets."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [
        None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), data or pa.py_buffer(b"")])


def _offsets(values: pa.Array) -> np.ndarray:
    """Where the values of a large binary begin and the last ends in its data."""
    at = values.buffers()[1]
    return np.frombuffer(at, np.int64)[values.offset:values.offset + len(values) + 1] if at else np.zeros(1, np.int64)


_NONE = pa.array([], pa.large_binary())


def _slices(texts: pa.Array) -> Iterator[list[str]]:
    for at in range(0, len(texts), _SLICE):
        yield texts.slice(at, _SLICE).to_pylist()


class _Lately:
    """Codes (ids as bytes) of the texts seen most of late.  They are Arrow arrays,
    which take a tenth of the memory of a dict."""

    def __init__(self):
        self.texts = pa.array([], pa.large_string())
        self.codes = pa.array([], pa.large_binary())
        self.seen = np.zeros(0, np.int64)        # how often, what is past at half its weight

    @property
    def index(self) -> dict[str, bytes]:
        return dict(zip(self.texts.to_pylist(), self.codes.to_pylist()))

    def look_up(self, chunks: list[pa.DictionaryArray], encode, limit: int) -> tuple[list[pa.Array], pa.Array]:
        """(places of each chunk's texts among the codes, codes); different texts
        that are not kept are encoded once for all chunks."""
        n = len(self.texts)
        kept = pa.DictionaryArray.from_arrays(pa.array([], pa.int32()), self.texts)
        chunks = pa.chunked_array([kept, *chunks]).unify_dictionaries().chunks[1:]
        texts = chunks[0].dictionary             # the kept ones are the first
        codes = pa.concat_arrays([self.codes, encode(texts.slice(n))])
        seen = np.zeros(len(texts), np.int64)
        seen[:n] = self.seen // 2
        for c in chunks:
            seen += np.bincount(c.indices.to_numpy(), minlength=len(seen))
        if len(texts) > limit:
            most = np.sort(np.argpartition(-seen, limit)[:limit])
            self.texts, self.codes, self.seen = texts.take(pa.array(most)), codes.take(pa.array(most)), seen[most]
        else:
            self.texts, self.codes, self.seen = texts, codes, seen
        return [c.indices for c in chunks], codes


class WordTokenizer:
    """A tokenizer file, applied word by word.

    Ids of words are kept from batch to batch.  Where the file's steps are the
    ones known here, a plain word is cut into its pre-tokens first: these are
    encoded independently, and far fewer of them differ."""

    WORDS, PIECES = 80_000, 100_000          # so many are kept

    def __init__(self, path: str, delimiter: str = "<|endoftext|>"):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.delimiter = delimiter
        self.delimiter_id = self.tokenizer.token_to_id(delimiter)
        self.mark = delimiter[:2]
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = "<u2" if size <= 1 << 16 else "<u4"
        spec = json.loads(self.tokenizer.to_str())
        steps = [(spec.get(k) or {}).get(v, []) for k, v in (
            ("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        self.known = [[x["type"] for x in s] for s in steps] == [_NORMALIZERS, _PRE_TOKENIZERS] \
            and steps[1][0]["pattern"] == {"Regex": _PATTERN}
        self.width = np.dtype(self.dtype).itemsize
        self.words, self.pieces = _Lately(), _Lately()

    def _cut(self, lengths: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The codes of texts that have so many ids each."""
        return _binaries(np.r_[0, np.cumsum(lengths)] * self.width, pa.py_buffer(ids.astype(self.dtype).tobytes()))

    def _encode(self, texts: list[str], group: int = 4096) -> pa.Array:
        """The code of each text.

        Many are encoded at once, parted by a special token, which tokenizers
        cut out before anything else; texts that might hold one are encoded
        by themselves."""
        lengths, ids, run = [], [], []

        def close():
            got = np.array(self.tokenizer.encode(
                self.delimiter.join(run), add_special_tokens=False).ids, np.int64)
            cut = np.flatnonzero(got == self.delimiter_id)
            lengths.append(np.diff(np.r_[-1, cut, len(got)]) - 1)
            ids.append(np.delete(got, cut))
            run.clear()

        for t in texts:
            odd = self.mark in t
            if run and (odd or len(run) == group):
                close()
            if odd:
                got = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int64)
                lengths.append(np.array([len(got)]))
                ids.append(got)
            else:
                run.append(t)
        if run:
            close()
        return self._cut(np.concatenate(lengths), np.concatenate(ids)) if lengths else _NONE

    def _encode_pieces(self, pieces: pa.Array) -> pa.Array:
        """As ``_encode``, by the file's model alone: plain pieces are in lower
        case and one pre-token each, so only the byte alphabet is left to do.
        The end of a line has no ids."""
        out = [_NONE]
        for some in _slices(pieces):
            spelled = ["" if p == "\n" else p for p in some]
            wide = [i for i, p in enumerate(some) if not p.isascii()]
            if wide:
                text = "\n".join([some[i] for i in wide]).encode().decode("latin-1")
                for i, p in zip(wide, text.translate(_BYTE_LETTERS).split("\n")):
                    spelled[i] = p
            got = list(map(self.tokenizer.model.tokenize, spelled))
            out.append(self._cut(
                np.fromiter(map(len, got), np.int64, len(got)),
                np.fromiter(map(attrgetter("id"), chain.from_iterable(got)), np.int64)))
        return pa.concat_arrays(out)

    def _encode_plain(self, words: list[pa.DictionaryArray]) -> list[pa.Array]:
        """The codes of the words of each list, which stand as their pieces, each
        word with the end of a line behind it."""
        if not words:
            return []
        ends = [np.flatnonzero(w.indices.to_numpy() == w.dictionary.index("\n").as_py()) for w in words]
        places, codes = self.pieces.look_up(words, self._encode_pieces, self.PIECES)
        out = []
        for at, end in zip(places, ends):
            taken = codes.take(at)
            out.append(_binaries(_offsets(taken)[np.r_[0, end + 1]], taken.buffers()[2]))
        return out

    def _encode_words(self, words: pa.Array) -> pa.Array:
        plain, pieces, hard = [], [], [_NONE]
        for some in _slices(words):
            text = "\n".join(some)
            if not self.known:
                of = np.zeros(len(some), bool)
            elif _PLAIN(text) and self.mark not in text:
                of = np.ones(len(some), bool)
            else:
                of = np.array([bool(_PLAIN(w)) and self.mark not in w for w in some])
                text = "\n".join([w for w, p in zip(some, of) if p])
            if of.any():
                pieces.append(pa.array(_PIECES(text.lower() + "\n"), pa.large_string()).dictionary_encode())
            if not of.all():
                hard.append(self._encode([w for w, p in zip(some, of) if not p]))
            plain.append(of)
        codes = pa.concat_arrays([*self._encode_plain(pieces), *hard])
        if len(hard) == 1:
            return codes
        # the plain words' codes are the first, those of the others follow
        place = np.argsort(np.argsort(~np.concatenate(plain), kind="stable"), kind="stable")
        return codes.take(pa.array(place))

    def codes(self, words: list[pa.DictionaryArray]) -> tuple[list[pa.Array], pa.Array]:
        """(places of each chunk's words among the codes, the ids of each word as bytes)."""
        return self.words.look_up(words, self._encode_words, self.WORDS)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of words, one after the other."""
        (places,), codes = self.codes([pa.array(words, pa.large_string()).dictionary_encode()])
        taken = codes.take(places)
        return np.diff(_offsets(taken)) // self.width, np.frombuffer(taken.buffers()[2] or b"", self.dtype)


_LOADED: dict[str, WordTokenizer] = {}


def load(path: str) -> WordTokenizer:
    """One tokenizer per file and worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def _chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(rows, texts) of about ``_CHUNK`` bytes; a longer text comes in segments
    that end at white space."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    long = size > _CHUNK
    part = np.cumsum(np.where(long, 0, size)) // _CHUNK
    new = (part[1:] != part[:-1]) | long[1:] | long[:-1]
    cuts = np.r_[0, np.flatnonzero(new) + 1, len(texts)].tolist()
    for s, e in zip(cuts[:-1], cuts[1:]):
        if e == s + 1 and long[s]:
            for segment in _segments(texts[s].as_py()):
                yield np.array([s]), pa.array([segment], pa.large_string())
        elif e > s:
            yield np.arange(s, e), pc.fill_null(texts.slice(s, e - s), "").cast(pa.large_string())
            pa.default_memory_pool().release_unused()


def _segments(text: str) -> Iterator[str]:
    start = 0
    while start < len(text):
        end = len(text)
        if end - start > _CHUNK:
            end = text.rfind(" ", start, start + _CHUNK) + 1
            if end <= start:
                end = text.find(" ", start + _CHUNK) + 1 or len(text)
        yield text[start:end]
        start = end


def encode_texts(tok: WordTokenizer, texts: list[str | None] | pa.Array) -> Iterator[
        tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, lengths, ids) for lists of texts or segments; a row may come in several."""
    for rows, bounds, codes, places in _coded(tok, texts):
        taken = codes.take(places)
        at = _offsets(taken)[bounds] // tok.width
        ids = np.frombuffer(taken.buffers()[2] or b"", tok.dtype)
        yield rows, np.diff(at), ids[at[0]:at[-1]]


def _coded(tok: WordTokenizer, texts) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]]:
    """(rows, where each begins and the last ends among the words, the codes of the
    different words, which of them the words are).  Words are looked up for
    several chunks at once, each of which is held as numbers of words only."""
    if not isinstance(texts, pa.Array):
        texts = pa.array(texts, pa.large_string())
    held = []

    def coded():
        places, codes = tok.codes([words for _, _, words in held])
        for (rows, bounds, _), at in zip(held, places):
            yield rows, bounds, codes, at
        held.clear()

    for rows, some in _chunks(texts):
        split = pc.ascii_split_whitespace(some)
        at = split.offsets.to_numpy()
        held.append((rows, at - at[0], split.flatten().dictionary_encode()))
        if len(held) == _GROUP:
            yield from coded()
    if held:
        yield from coded()


def token_counts(docs: DataFrame, tokenizer_path: str, text_col: str = "text",
                 extra: int = 0) -> DataFrame:
    """The other columns of ``docs`` with ``n_tokens`` in place of the text;
    ``extra`` ids are added per document."""
    rest = [c for c in docs.columns if c != text_col]
    src = docs.select(col(text_col).cast("string").alias(text_col), *map(col, rest))
    schema = src.select(*map(col, rest), F.lit(0).cast("long").alias("n_tokens")).schema

    def run(batches):
        for b in batches:
            tok = load(tokenizer_path)
            n = np.full(b.num_rows, extra, np.int64)
            for rows, bounds, codes, places in _coded(tok, b.column(0)):
                size = pc.binary_length(codes).to_numpy(zero_copy_only=False) // tok.width
                total = np.r_[0, np.cumsum(size[places.to_numpy(zero_copy_only=False)])]
                np.add.at(n, rows, np.diff(total[bounds]))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n)], [*rest, "n_tokens"])
            pa.default_memory_pool().release_unused()

    return src.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str,
                     end_id: int) -> DataFrame:
    """(id, ids): the ids of each document, end id included, as a binary of
    little-endian 16- or 32-bit numbers."""
    src = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    schema = T.StructType([src.schema["id"], T.StructField("ids", T.BinaryType())])

    def run(batches):
        for b in batches:
            tok = load(tokenizer_path)
            last = np.array([end_id], tok.dtype).tobytes()
            done, parts = 0, []                       # rows given out, parts of the next one
            for rows, lengths, ids in encode_texts(tok, b.column(1)):
                raw, ends = ids.tobytes(), (np.cumsum(lengths) * tok.width).tolist()
                out = []
                for row, s, e in zip(rows.tolist(), [0, *ends], ends):
                    if row > done:
                        out.append(b"".join(parts) + last)
                        done, parts = row, []
                    parts.append(raw[s:e])
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(done - len(out), len(out)), pa.array(out, pa.binary())], ["id", "ids"])
            if b.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(done, 1), pa.array([b"".join(parts) + last], pa.binary())], ["id", "ids"])
            pa.default_memory_pool().release_unused()

    return src.mapInArrow(run, schema)


def rank_table(encoded: DataFrame, dtype: str) -> DataFrame:
    """(rank, token): tokens by falling frequency, ties by id.  At most as many
    rows as the vocabulary."""
    def count(batches):
        seen = np.zeros(0, np.int64)
        for b in batches:
            for x in b.column(0):
                n = np.bincount(np.frombuffer(x.as_buffer(), dtype), minlength=len(seen))
                n[:len(seen)] += seen
                seen = n
        token = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(seen[token])], ["token", "n"])

    n = encoded.select("ids").mapInArrow(count, "token long, n long")
    n = n.groupBy("token").agg(F.sum("n").alias("n"))
    order = Window.orderBy(F.desc("n"), "token")
    return n.select((F.row_number().over(order) - 1).cast("long").alias("rank"), "token")


def pack_bytes(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of numbers below 2**32."""
    v = np.ascontiguousarray(values, "<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[:len(v)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    used = np.arange(4) < size[:, None]
    return control.astype(np.uint8).tobytes(), v.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack_bytes(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of a control and a data stream."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < size[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` and write the files; see the module text for the format."""
    spark = docs.sparkSession
    dtype = load(tokenizer_path).dtype
    encoded = written(encode_documents(docs, tokenizer_path, id_col, text_col, end_id).withColumn(
        "place", F.monotonically_increasing_id()), "token-ids")
    rank_table(encoded, dtype).write.parquet(f"{path}/ranks")
    pairs = spark.read.parquet(f"{path}/ranks").collect()      # bounded by the vocabulary
    rank_of = np.zeros(max((r["token"] for r in pairs), default=0) + 1, np.int64)
    for r in pairs:
        rank_of[r["token"]] = r["rank"]
    shared = spark.sparkContext.broadcast(rank_of)
    id_type = encoded.schema["id"].dataType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("doc_ids", T.ArrayType(id_type)),
        T.StructField("counts", T.ArrayType(T.LongType())),
        T.StructField("control", T.BinaryType()), T.StructField("data", T.BinaryType())])

    def blocks(batches):
        part, block, start = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        held: list[np.ndarray] = []
        size = 0

        def close():
            nonlocal block, start, ids, held, size
            control, data = pack_bytes(shared.value[np.concatenate(held)])
            counts = [len(x) for x in held]
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()),
                 pa.array([start], pa.int64()), pa.array([ids], pa.list_(id_arrow)),
                 pa.array([counts], pa.list_(pa.int64())), pa.array([control], pa.binary()),
                 pa.array([data], pa.binary())], schema.names)
            block, start = block + 1, start + size
            ids, held, size = [], [], 0
            return row

        for b in batches:
            id_arrow = b.column(0).type
            for name, x in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(name)
                held.append(np.frombuffer(x.as_buffer(), dtype))
                size += len(held[-1])
                if size >= _BLOCK_IDS:
                    yield close()
            held = [x.copy() for x in held]      # don't keep the batch
        if ids:
            yield close()

    order = ["id", F.xxhash64("ids"), "place"]
    dealt = encoded.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "ids")
    dealt.mapInArrow(blocks, schema).write.option("compression", "uncompressed").parquet(
        f"{path}/ids")


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ``start``, ``n_tokens``, ``ids``): of each document the number of
    ids of all documents before it, its number of ids, and these as a binary
    of little-endian 32-bit numbers."""
    blocks = spark.read.parquet(f"{path}/ids")
    pairs = spark.read.parquet(f"{path}/ranks").collect()      # bounded by the vocabulary
    token_of = np.zeros(len(pairs) + 1, np.uint32)
    for r in pairs:
        token_of[r["rank"]] = r["token"]
    shared = spark.sparkContext.broadcast(token_of)
    id_type = blocks.schema["doc_ids"].dataType.elementType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("id", id_type),
        T.StructField("within", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType())])

    def decode(batches):
        for b in batches:
            at = dict(zip(b.schema.names, b.columns))
            for i in range(b.num_rows):
                counts = at["counts"][i].values.to_numpy(zero_copy_only=False)
                ranks = unpack_bytes(at["control"][i].as_py(), at["data"][i].as_py(),
                                     int(counts.sum()))
                raw = shared.value[ranks].astype("<u4").tobytes()
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(counts), at["part"][i].as_py(), np.int32)),
                     at["doc_ids"][i].values, pa.array(ends - counts + at["start"][i].as_py()),
                     pa.array(counts),
                     pa.array([raw[4 * (e - n):4 * e] for n, e in zip(counts, ends)],
                              pa.binary())], schema.names)

    docs = blocks.mapInArrow(decode, schema)
    # one row per written part: the ids of all parts before it.  A part is a
    # partition of the write, so spark.sql.shuffle.partitions bounds their number
    size = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    totals = blocks.select("part", size.alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")
                                    ).alias("before"))
    return docs.join(F.broadcast(before), "part").select(
        F.col("id").alias(id_col), (F.col("before") + F.col("within")).alias("start"),
        "n_tokens", "ids")
