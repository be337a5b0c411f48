"""Token-ID output: one zstandard frame a document, a shared dictionary, an offset index.

Layout of a store (a folder that Spark writes and reads, on any file system):

``shards/``      Parquet, one row a block of consecutive documents: ``part`` and
                 ``block`` number it, ``doc_ids`` / ``counts`` / ``offsets`` index its
                 documents, ``payload`` holds their frames one after another,
                 ``dictionary`` is the SHA-256 of the dictionary they need, ``width``
                 the bytes of an id (little-endian), ``before`` the ids of the part
                 that precede the block, ``ids`` how many the block has, ``least`` and
                 ``most`` the range of its doc_ids, by which readers skip files.
``dictionary/``  one row: the dictionary's bytes and its SHA-256.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import documents, new_path

END = 0
#: The dictionary is trained on about this many documents, chosen by a hash of doc_id.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 800, 32 << 10, 64 << 10
LEVEL = 3
BLOCK_BYTES = 1 << 20
#: Bytes that a worker spends on remembering the ids of chunks between spaces (one worker a core).
REMEMBERED = 256 << 20
#: About what an entry takes besides the characters and ids: two objects' heads and its place in the map.
ENTRY = 190

#: Letters of Latin-1 and a mark.
MARKED = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[,.]")

_state: dict = {}


class Encoder:
    """Ids of whole texts by the tokenizers library, chunk by chunk.

    The byte-level pre-tokenizer always cuts before a space that stands alone,
    so a text whose white space comes one character at a time is the
    concatenation of its chunks; texts with longer runs of white space or with
    the literal of a special token are encoded in one piece.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join([r"\s\s", *special]))
        self.heads: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}
        self.marks = {m: self._ids(m) for m in ",."}
        self.size = 0

    def _ids(self, text: str) -> bytes:
        # One text a call: batches of short texts spend more on their threads than on encoding.
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, known: dict[str, bytes], wanted: set[str], lead: str) -> list[str]:
        """Make ``known`` hold all wanted chunks; those that are over what is remembered are returned, to be forgotten.

        A mark that follows letters is cut off by the pre-tokenizer, so a word is
        encoded once for all marks.
        """
        new: dict[str, bytes] = {}
        for chunk in wanted.difference(known):
            if MARKED.fullmatch(chunk):
                word = chunk[:-1]
                ids = known.get(word) or new.get(word)
                if ids is None:
                    ids = new[word] = self._ids(lead + word)
                new[chunk] = ids + self.marks[chunk[-1]]
            elif chunk not in new:
                new[chunk] = self._ids(lead + chunk)
        known.update(new)
        if self.size > REMEMBERED:
            return list(new)
        self.size += sum(map(len, new)) + sum(map(len, new.values())) + ENTRY * len(new)
        return []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[bytes] = [b""] * len(texts)
        split: dict[int, list[str]] = {}
        for i, text in enumerate(texts):
            if self.whole.search(text):
                out[i] = self._ids(text)
            else:
                split[i] = text.split(" ")
        over = self._learn(self.heads, {c[0] for c in split.values()}, "")
        late = self._learn(self.rest, set().union(*(c[1:] for c in split.values())), " ")
        for i, c in split.items():
            out[i] = self.heads[c[0]] + b"".join(map(self.rest.__getitem__, c[1:]))
        for known, gone in ((self.heads, over), (self.rest, late)):
            for chunk in gone:
                del known[chunk]
        end = np.array([END], self.dtype).tobytes()
        return [np.frombuffer(ids + end, self.dtype) for ids in out]


def _encoder(path: str) -> Encoder:
    if _state.get("path") != path:
        _state.update(path=path, encoder=Encoder(path))
    return _state["encoder"]


def train_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """A dictionary for serialized id arrays; empty if the sample is too small to train one.

    The driver holds at most 2 * SAMPLE texts of at most SAMPLE_BYTES each: drawn by a
    hash of doc_id, and in its order.  Longer texts need no dictionary of their own.
    """
    total = docs.count()
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    short = docs.where((lot < SAMPLE / max(1, total)) & (F.octet_length("text") <= SAMPLE_BYTES))
    rows = short.select(F.xxhash64("doc_id").alias("lot"), "doc_id", "text").orderBy("lot", "doc_id", "text").limit(2 * SAMPLE).collect()
    samples = [ids.tobytes() for ids in Encoder(tokenizer).encode([r.text for r in rows])] if rows else []
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_store(docs: DataFrame, path: str, tokenizer: str) -> str:
    """Encode every text (null: empty), append END, and write the store in ascending doc_id order.

    Null ids come first; rows of equal id are in the order of their texts.
    Texts are encoded whole, one after another, so a very long one takes memory
    in proportion; other columns are not read, and an empty table gives an empty store.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer)
    digest = hashlib.sha256(dictionary).hexdigest()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(tokenizer), TaskContext.get().partitionId()
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True)
        frames: list[bytes] = []
        ids: list = []
        counts: list[int] = []
        size = before = block = 0

        def flush():
            nonlocal frames, ids, counts, size, before, block
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])])
            row = {
                "part": part, "block": block, "doc_ids": ids, "counts": counts, "offsets": offsets.tolist(), "payload": b"".join(frames),
                "dictionary": digest, "width": encoder.dtype.itemsize, "before": before, "ids": sum(counts),
                "least": min((i for i in ids if i is not None), default=None), "most": max((i for i in ids if i is not None), default=None),
            }
            before, block = before + row["ids"], block + 1
            frames, ids, counts, size = [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = None
        for whole in batches:
            if schema is None:
                schema = pa.schema(
                    [
                        ("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(whole.schema.field("doc_id").type)), ("counts", pa.list_(pa.int64())),
                        ("offsets", pa.list_(pa.int64())), ("payload", pa.binary()), ("dictionary", pa.string()), ("width", pa.int32()), ("before", pa.int64()), ("ids", pa.int64()),
                        ("least", whole.schema.field("doc_id").type), ("most", whole.schema.field("doc_id").type),
                    ]
                )
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                tokens = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
                for doc_id, array in zip(batch.column("doc_id").to_pylist(), tokens):
                    frame = packer.compress(array.tobytes())
                    frames.append(frame)
                    ids.append(doc_id)
                    counts.append(len(array))
                    size += len(frame)
                    if size >= BLOCK_BYTES:
                        yield flush()
        if frames:
            yield flush()

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"part int, block int, doc_ids array<{kind}>, counts array<long>, offsets array<long>, payload binary, dictionary string, width int, before long, ids long, least {kind}, most {kind}"
    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(encode, fields).write.option("compression", "uncompressed").parquet(f"{path}/shards")
    spark.createDataFrame([(digest, bytearray(dictionary))], "dictionary string, bytes binary").coalesce(1).write.parquet(f"{path}/dictionary")
    return path


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Rows doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit) of a store, read from its files."""
    digest, dictionary = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(dictionary)
    shards = spark.read.parquet(f"{path}/shards")
    totals = shards.groupBy("part").agg(F.sum("ids").alias("total"))
    # One row a part: the first id of each part, by a running sum.
    begins = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("begin"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        reader = zstandard.ZstdDecompressor(dict_data=shared)
        for batch in batches:
            for row in range(batch.num_rows):
                r = {c: batch.column(c)[row] for c in batch.schema.names}
                if r["dictionary"].as_py() != digest:
                    raise ValueError("the shard was written with another dictionary")
                payload, offsets = memoryview(r["payload"].as_buffer()), r["offsets"].as_py()
                dtype = np.dtype(f"<u{r['width'].as_py()}")
                arrays = [np.frombuffer(reader.decompress(payload[a:b]), dtype).astype("<u4") for a, b in zip(offsets[:-1], offsets[1:])]
                counts = np.array([len(a) for a in arrays], np.int64)
                if counts.tolist() != r["counts"].as_py():
                    raise ValueError("the index doesn't fit the frames")
                start = r["begin"].as_py() + r["before"].as_py() + np.cumsum(counts) - counts
                yield pa.RecordBatch.from_arrays(
                    [r["doc_ids"].values, pa.array(start), pa.array(counts), pa.array([a.tobytes() for a in arrays], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"]
                )

    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    return shards.join(F.broadcast(begins), "part").mapInArrow(decode, f"doc_id {kind}, start long, n_tokens long, ids binary")


def read_document(spark: SparkSession, path: str, doc_id: int) -> np.ndarray | None:
    """The ids of one document, from its own frame only; None if there is no such id, the first by text of several.

    Documents are in order, so the statistics of ``least`` and ``most`` leave one file, and these columns one block of it.
    """
    block = (F.col("least") <= doc_id) & (F.col("most") >= doc_id) & F.array_contains("doc_ids", F.lit(doc_id))
    row = spark.read.parquet(f"{path}/shards").where(block).orderBy("part", "block").limit(1).select(
        "width", F.expr(f"array_position(doc_ids, {int(doc_id)}) as at"), "offsets", "payload"
    )
    frame = row.selectExpr("width", "substring(payload, int(offsets[int(at) - 1]) + 1, int(offsets[int(at)] - offsets[int(at) - 1])) as frame").first()
    if frame is None:
        return None
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["bytes"])
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return np.frombuffer(zstandard.ZstdDecompressor(dict_data=shared).decompress(bytes(frame.frame)), f"<u{frame.width}")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``write_store`` of documents, read back by ``read_store``; edge cases as there."""
    path = write_store(documents(spark, sf_dir), new_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
