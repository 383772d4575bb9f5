"""Token ids in Arrow IPC files of fixed-size lists, for zero-copy random access to equal-length sequences and masks.

Documents are dealt into shards by ranges of doc_id, so that shards in order hold the documents in ascending order. Each
shard is two files. `<shard>.seq.arrow` has one row per sequence: `ids`, a fixed-size list of `length` unsigned ids,
and `mask`, a fixed-size list of as many bits, false on the padding after a shard's last id. `<shard>.doc.arrow` has one
row per document: doc_id, the start of its ids among the shard's ids and their number. The bodies are uncompressed, so a
memory-mapped reader takes sequence i as a slice of the buffer, without a copy. Ids are 16 bits wide when the
vocabulary allows it, else 32.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import KEPT, few_decoded, shared_dir, table, tidied, written

END_ID = 1
#: Ids per sequence, and per record batch of sequences.
LENGTH, BATCH = 2048, 64
#: Words whose ids are remembered by a task; the memory is emptied when it is full.
WORDS_KEPT = 700_000


#: Pieces and gaps of the texts by which a tokenizer shows whether it splits at white space first.
_PIECES = "a B the words don't x1 9.5% ,, ... (q) é ß 日本 -- #tag low-er UPPER \u0301 ü.".split(" ")
_GAPS = (" ", "  ", "\n", "\t ", " \r\n", "   \n\n")


def splits_first(tokenizer) -> bool:
    """Whether a tokenizer splits at white space before all else and drops it: texts of any pieces and gaps have their pieces' ids in a row.

    Told by what it does with every two of some pieces, over every gap, also at a text's ends. Tokens added to it that hold white space, or reach for it, say no.
    """
    if any(t.lstrip or t.rstrip or any(c.isspace() for c in t.content) for t in tokenizer.get_added_tokens_decoder().values()):
        return False
    ids = [e.ids for e in tokenizer.encode_batch(_PIECES, add_special_tokens=False)]
    pairs = [(i, j) for i in range(len(_PIECES)) for j in range(len(_PIECES))]
    for k, gap in enumerate(_GAPS):
        ends = ("", gap) if k % 2 else (gap, "")
        got = tokenizer.encode_batch([f"{ends[0]}{_PIECES[i]}{gap}{_PIECES[j]}{ends[1]}" for i, j in pairs], add_special_tokens=False)
        if any(e.ids != ids[i] + ids[j] for e, (i, j) in zip(got, pairs, strict=True)):
            return False
    return True


class WordMemory:
    """Encodes with a tokenizer of the tokenizers library, each whitespace-separated piece once while it is remembered.

    That is for tokenizers that split at white space before all else and drop it, as word_bpe_49k does: there, a text's
    ids are its pieces' ids in a row. Others, as splits_first() tells, encode whole texts. Pieces are told apart at space, tab, newline and return alone. A piece of letters
    with one mark after it has the ids of the letters, then the mark's; where the tokenizer lower-cases, ASCII letters
    are looked up in lower case. Pieces of letters are encoded together, and their ids told apart by the ends of words.
    """

    def __init__(self, path: str, dtype: np.dtype):
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.known = Tokenizer.from_file(path), dtype, {"": b""}
        self.whole = not splits_first(self.tokenizer)
        model = self.tokenizer.model
        self.ends = None
        if suffix := getattr(model, "end_of_word_suffix", None):
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
        self.lowers = "Lowercase" in str(self.tokenizer.normalizer)

    def encode(self, text: str) -> bytes:
        if self.whole:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        pieces = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        try:
            return b"".join([self.known[p] for p in pieces])
        except KeyError:
            pass
        if len(self.known) > WORDS_KEPT:
            self.known = {"": b""}
        self._learn(p for p in set(pieces) if p not in self.known)
        return b"".join([self.known[p] for p in pieces])

    def _learn(self, new: Iterator[str]) -> None:
        known, split, words, others = self.known, [], set(), set()
        for p in new:
            core, tail = (p[:-1], p[-1]) if p[-1] in ".,;:!?" and p[:-1].isalpha() else (p, "")
            if self.lowers and core.isascii() and core.isalpha():
                core = core.lower()
            split.append((p, core, tail))
            for part in (core, tail):
                if part not in known:
                    (words if part.isalpha() else others).add(part)
        if self.ends is None or not self._words(list(words)):
            others |= words
        rest = list(others)
        for p, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else (), strict=True):
            known[p] = np.array(e.ids, dtype=self.dtype).tobytes()
        for p, core, tail in split:
            known[p] = known[core] + known[tail]

    def _words(self, words: list[str]) -> bool:
        """Learns pieces of letters; False, and nothing learnt, if their ids don't show where each ends."""
        if not words:
            return True
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words) or stops[-1] != len(ids):
            return False
        raw, at = ids.astype(self.dtype).tobytes(), 0
        for w, stop in zip(words, (stops * self.dtype.itemsize).tolist(), strict=True):
            self.known[w] = raw[at:stop]
            at = stop
        return True


#: The name under which workers keep what they have learnt.
KEEP = "tokens"


def _memory(path: str, dtype: np.dtype) -> WordMemory:
    """The worker's memory, kept from task to task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    known = KEPT.setdefault(KEEP, {})
    if (path, dtype.str) not in known:
        known[path, dtype.str] = WordMemory(path, dtype)
    return known[path, dtype.str]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write(uri: str, name: str, write) -> None:
    """Writes a file under a name that no other attempt of the task has: it is read only if the manifest names it."""
    files, root = _filesystem(uri)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/{name}") as sink:
        write(sink)


class _Sequences:
    """Collects ids and writes them as batches of whole sequences."""

    def __init__(self, sink, dtype: np.dtype, length: int):
        kind = pa.uint16() if dtype == np.uint16 else pa.uint32()
        self.schema = pa.schema([pa.field("ids", pa.list_(kind, length)), pa.field("mask", pa.list_(pa.bool_(), length))])
        self.writer, self.dtype, self.length, self.rest = pa.ipc.new_file(sink, self.schema), dtype, length, bytearray()

    def add(self, ids: bytes, last: bool = False) -> None:
        self.rest += ids
        step = self.length * self.dtype.itemsize * BATCH
        whole = len(self.rest) // step * step
        for k in range(0, whole, step):
            self._batch(bytes(self.rest[k : k + step]))
        del self.rest[:whole]
        if last:
            if self.rest:
                self._batch(bytes(self.rest))
            self.writer.close()

    def _batch(self, raw: bytes) -> None:
        ids = np.frombuffer(raw, dtype=self.dtype)
        rows = -(-len(ids) // self.length)
        padded = np.zeros(rows * self.length, dtype=self.dtype)
        padded[: len(ids)] = ids
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(a), self.length) for a in (padded, np.arange(len(padded)) < len(ids))]
        self.writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))


def write_tokens(docs: DataFrame, uri: str, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, vocabulary: int = 49_408, order: list[Column] | None = None) -> DataFrame:
    """Encodes docs (doc_id, text) into the files under `uri`; returns their manifest: shard, name, n_docs, n_tokens.

    Documents are written in ascending doc_id order, or in that of the columns `order`. A null text is empty; every document gets at least the end id. Documents of equal doc_id, also null ones (which
    come first), follow one another in the order of their texts' hashes. A file has the name of one attempt, which the manifest tells: what lost attempts wrote isn't read. Other columns are ignored. An empty table makes no
    files. The manifest is a table in the shared folder: reading it doesn't encode again.
    """
    dtype = np.dtype(np.uint16 if vocabulary <= 1 << 16 else np.uint32)
    end = np.array([end_id], dtype=dtype).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        shard = task.partitionId()
        name, ids, starts, at = f"{shard:06d}-{uuid.uuid4().hex}", [], [], 0
        memory = _memory(tokenizer, dtype)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def sequences(sink) -> None:
            nonlocal at
            store = _Sequences(sink, dtype, length)
            for batch in chain((first,), batches):
                at = _fill(store, batch, memory, end, ids, starts, at)
            store.add(b"", last=True)

        def index(sink) -> None:
            columns = {"doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(np.diff([*starts, at]), pa.int64())}
            with pa.ipc.new_file(sink, pa.schema([(k, v.type) for k, v in columns.items()])) as w:
                w.write_table(pa.table(columns), max_chunksize=1 << 16)

        _write(uri, f"{name}.seq.arrow", sequences)
        _write(uri, f"{name}.doc.arrow", index)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "name": [name], "n_docs": [len(ids)], "n_tokens": [at]}, schema=pa.schema([("shard", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    parts = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = [c.alias(f"order{k}") for k, c in enumerate(order or [F.col("doc_id").cast("long")])]
    text = F.coalesce(F.col("text"), F.lit(""))
    # rows of one id, also those without, are dealt over ranges by their texts' hashes
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *by, F.xxhash64(text).alias(f"order{len(by)}"))
    names = [f"order{k}" for k in range(len(by) + 1)]
    dealt = rows.repartitionByRange(parts, *names).sortWithinPartitions(*names, "text").select("doc_id", "text")
    return written(dealt.mapInArrow(tidied(write, KEEP), "shard int, name string, n_docs long, n_tokens long"), "manifest")


def _fill(store: _Sequences, batch: pa.RecordBatch, memory: WordMemory, end: bytes, ids: list, starts: list, at: int) -> int:
    width = store.dtype.itemsize
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        got = memory.encode(text.as_py()) + end
        store.add(got)
        ids.append(doc_id)
        starts.append(at)
        at += len(got) // width
    return at


class Shard:
    """Random access to one shard's files: sequences and masks as views of the mapped file, documents by their index."""

    def __init__(self, uri: str, name: str):
        files, root = _filesystem(uri)
        open_ = (lambda p: pa.memory_map(p)) if files.type_name == "local" else files.open_input_file
        self.seq = pa.ipc.open_file(open_(f"{root}/{name}.seq.arrow"))
        self.docs = pa.ipc.open_file(open_(f"{root}/{name}.doc.arrow"))
        self.length = self.seq.schema.field("ids").type.list_size

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view) and mask of sequence i; every batch but the last holds BATCH of them."""
        batch = self.seq.get_batch(i // BATCH)
        return batch.column(0)[i % BATCH].values.to_numpy(zero_copy_only=True), batch.column(1)[i % BATCH].values

    def span(self, start: int, stop: int) -> np.ndarray:
        """The shard's ids from start to stop; a view where one batch holds them."""
        per = BATCH * self.length
        parts = []
        for k in range(start // per, -(-stop // per)):
            flat = self.seq.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)
            parts.append(flat[max(0, start - k * per) : stop - k * per])
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint16)


def read_tokens(spark: SparkSession, uri: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start (over all shards), n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), read from the files."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # one row per shard: the window's single task reads as many rows as there are files
    base = manifest.select("name", "n_docs", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        for batch in batches:
            for name, base_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(uri, name)
                for k in range(shard.docs.num_record_batches):
                    d = shard.docs.get_batch(k)
                    starts, counts = d.column(1).to_numpy(), d.column(2).to_numpy()
                    crcs = [crc32(shard.span(s, s + n).astype("<u4")) for s, n in zip(starts, counts, strict=True)]
                    yield pa.RecordBatch.from_arrays([d.column(0), pa.array(starts + base_), d.column(2), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = base.select("name", "base").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "name")
    return spread.mapInArrow(tidied(read, KEEP), "doc_id long, start long, n_tokens long, ids_crc32 long")


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    """The path of a vocabulary file of the public_tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written and read back."""
    few_decoded(spark)
    docs, uri = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/tokens"
    return read_tokens(spark, uri, write_tokens(docs, uri, public_tokenizer()))
