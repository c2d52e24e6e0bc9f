"""Token ids in Arrow files of equal-length sequences.

A file is an Arrow IPC file: record batches with two fixed-size lists of
``length`` places, ``ids`` (uint16 or uint32) and ``mask`` (one bit each, 0
for padding).  Sequence i of a file is at a fixed place in a fixed batch, so
a reader maps the file and takes it without a copy.  The texts of a range
of ids follow one another in its file; beside it lies an index file with
the id, first place and number of ids of each document.

Tasks write through Arrow's file systems to the shared folder, under names
of their own; the manifest, which Spark commits, names the files that
count.  A task that is lost and run again leaves a file nobody reads.
"""

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..plans.materialize import materialize, scratch_dir

c = F.col
MANIFEST = "part long, file string, index string, n_docs long, n_tokens long, first_id long"
BATCH_ROWS = 64
CACHED_WORDS = 1_500_000
#: ASCII signs, without the apostrophe, which may begin a contraction.
SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
LAST_SIGNS = re.compile(rb"([a-z])(?=[" + re.escape(SIGNS) + rb"]+$)", re.MULTILINE)
_tokenizers: dict[str, tuple] = {}


class Encoder:
    """Ids of whole texts.

    The tokenizer drops white space and never joins what stands on its two
    sides, so a text's ids are those of its white-space separated pieces, in
    order.  Pieces recur, so their ids are kept until there are too many.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.wide = self.model.get_vocab_size() > 1 << 16
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.known: dict[bytes, bytes] = {b"": b""}     # at the ends of a text stands an empty piece
        words = self.model.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, dtype=bool)
        self.ends[[i for word, i in words.items() if word.endswith("</w>")]] = True

    def _learn(self, pieces: list[bytes]) -> None:
        """Pieces of ASCII letters are one word each, and the last id of a word says so: many fit into one call."""
        plain = [p for p in pieces if p.isalpha()]
        for i in range(0, len(plain), 500):
            part = plain[i:i + 500]
            ids = np.array(self.model.encode(b" ".join(part).decode(), add_special_tokens=False).ids)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):         # a vocabulary without such ids
                plain = plain[:i]
                break
            whole, at = ids.astype(self.dtype).tobytes(), [0, *(stops * self.dtype.itemsize).tolist()]
            self.known.update((p, whole[x:y]) for p, x, y in zip(part, at, at[1:]))
        done = set(plain)
        rest = [p for p in pieces if p not in done]
        for i in range(0, len(rest), 20_000):
            part = rest[i:i + 20_000]
            for piece, x in zip(part, self.model.encode_batch_fast([p.decode() for p in part], add_special_tokens=False), strict=True):
                self.known[piece] = np.array(x.ids, dtype=self.dtype).tobytes()

    def _add(self, new: list[bytes]) -> None:
        """Learns pieces by their parts: lower case, and ASCII signs after a final ASCII letter on their own, as the
        tokenizer splits them.  A piece that may hold one of its special strings is left as it is."""
        special = [p for p in new if b"<|" in p]
        if special:
            self._learn(special)
            new = [p for p in new if b"<|" not in p]
        # A piece holds no white space, so all of them are split in one pass: a line each, with a blank between two parts.
        whole = LAST_SIGNS.sub(rb"\1 ", b"\n".join(new).lower())
        self._learn([x for x in set(whole.split()) if x not in self.known])
        known = self.known
        for p, line in zip(new, whole.split(b"\n")):
            if line in known:
                known[p] = known[line]
            else:
                body, signs = line.split()
                known[p] = known[body] + known[signs]

    def __call__(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """Each distinct piece is looked up once; the ids are put in place by number."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        pieces = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        numbered = pieces.flatten().dictionary_encode()
        every = numbered.dictionary.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_numpy(zero_copy_only=False).tolist()
        new = [p for p in every if p not in self.known]
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known, new = {b"": b""}, [p for p in every if p]
        if new:
            self._add(new)
        found = [self.known[p] for p in every]
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        at, which = np.cumsum(size) - size, numbered.indices.to_numpy()
        n = size[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = np.frombuffer(b"".join(found), dtype=self.dtype)[np.repeat(at[which] - ends[:-1], n) + np.arange(ends[-1])]
        stops = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(pieces).to_numpy())])]
        return [ids[x:y] for x, y in zip(stops.tolist(), stops[1:].tolist())]


def encoder(path: str) -> Encoder:
    if path not in _tokenizers:
        _tokenizers[path] = Encoder(path)
    return _tokenizers[path]


class _Writer:
    """Packs ids into sequences; a batch goes out as soon as it is full."""

    def __init__(self, out, length: int, dtype: np.dtype):
        self.length, self.dtype = length, dtype
        self.schema = pa.schema([("ids", pa.list_(pa.uint32() if dtype.itemsize == 4 else pa.uint16(), length)),
                                 ("mask", pa.list_(pa.bool_(), length))])
        self.out, self.held, self.n, self.total = pa.ipc.new_file(out, self.schema), [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        self.total += len(ids)
        size = self.length * BATCH_ROWS
        if self.n >= size:
            whole = np.concatenate(self.held)
            for i in range(0, len(whole) - size + 1, size):
                self._batch(whole[i:i + size], size)
            self.held = [whole[len(whole) // size * size:]]
            self.n = len(self.held[0])

    def _batch(self, ids: np.ndarray, n: int) -> None:
        mask = np.arange(len(ids)) < n
        self.out.write_batch(pa.RecordBatch.from_arrays(
            [pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length),
             pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))

    def close(self) -> None:
        if self.n:
            ids = np.concatenate(self.held)
            self._batch(np.concatenate([ids, np.zeros(-len(ids) % self.length, dtype=self.dtype)]), len(ids))
        self.out.close()


def write(docs: DataFrame, tokenizer: str, folder: str, id: str = "doc_id", text: str = "text", end_id: int = 2,
          length: int = 2048) -> DataFrame:
    """Writes ids and index files under ``folder``, in ascending id order, and returns the stored manifest.

    A null text is encoded as an empty one and has the end id only.  Rows with
    the same id follow one another, by a hash of their text; a null id comes
    first.  An empty table gives an empty manifest.  Other columns take no part.
    """
    rows = docs.select(c(f"`{id}`").cast("long").alias("id"), c(f"`{text}`").cast("string").alias("text"))
    mark = F.xxhash64("text")
    ranged = rows.repartitionByRange(c("id").asc_nulls_first(), mark).sortWithinPartitions(c("id").asc_nulls_first(), mark)

    def pack(batches):
        disk, root = fs.FileSystem.from_uri(folder)
        encode, writer, name, ids, sizes = encoder(tokenizer), None, uuid.uuid4().hex, [], []
        disk.create_dir(root, recursive=True)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                ids += part.column("id").to_pylist()
                for x in encode(part.column("text")):
                    if writer is None:
                        out = disk.open_output_stream(f"{root}/{name}.arrow")
                        writer = _Writer(out, length, x.dtype)
                    writer.add(np.append(x, np.array(end_id, dtype=x.dtype)))
                    sizes.append(len(x) + 1)
        if writer is None:
            return
        writer.close()
        out.close()
        index = pa.table({"id": pa.array(ids, pa.int64()), "n": pa.array(sizes, pa.int64())})
        with disk.open_output_stream(f"{root}/{name}.index") as stream, pa.ipc.new_file(stream, index.schema) as sink:
            sink.write_table(index)
        yield pa.RecordBatch.from_pylist(
            [{"part": 0, "file": f"{name}.arrow", "index": f"{name}.index", "n_docs": len(ids), "n_tokens": sum(sizes),
              "first_id": ids[0]}],
            schema=pa.schema([("part", pa.int64()), ("file", pa.string()), ("index", pa.string()), ("n_docs", pa.int64()),
                              ("n_tokens", pa.int64()), ("first_id", pa.int64())]))
    written = ranged.mapInArrow(pack, MANIFEST).withColumn("part", F.spark_partition_id().cast("long"))
    written = materialize(written, "token-manifest")
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))   # a row for each file
    return materialize(written.withColumn("start", F.coalesce(before, F.lit(0))), "token-manifest")


def read(manifest: DataFrame, folder: str, id: str = "doc_id") -> DataFrame:
    """id, start, n_tokens and ids_crc32 of each document, from the files of a manifest."""
    def unpack(batches):
        disk, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with disk.open_input_file(f"{root}/{row['index']}") as source:
                    index = pa.ipc.open_file(source).read_all()
                names, sizes = index["id"].combine_chunks(), index["n"].to_numpy()
                stops = np.cumsum(sizes)
                starts, crcs, done = stops - sizes, np.zeros(len(sizes), dtype=np.int64), 0
                with disk.open_input_file(f"{root}/{row['file']}") as source:
                    reader, held, at, x = pa.ipc.open_file(source), np.zeros(0, "<u4"), 0, 0
                    for i in range(reader.num_record_batches):      # ``held``: the ids from place ``at`` on
                        part = reader.get_batch(i)
                        valid = part.column("mask").flatten().to_numpy(zero_copy_only=False)
                        held = np.concatenate([held, part.column("ids").flatten().to_numpy()[valid].astype("<u4")])
                        while x < len(stops) and stops[x] <= at + len(held):
                            crcs[x] = zlib.crc32(held[starts[x] - at:stops[x] - at].tobytes())
                            x += 1
                        done = (starts[x] if x < len(starts) else at + len(held)) - at
                        held, at = held[done:], at + done
                yield pa.RecordBatch.from_arrays([names if isinstance(names, pa.Array) else names.chunk(0),
                                                  pa.array(row["start"] + starts), pa.array(sizes), pa.array(crcs)],
                                                 [id, "start", "n_tokens", "ids_crc32"])
    files = manifest.sparkSession.sparkContext.defaultParallelism
    return manifest.repartition(max(files, 1) * 2, "file").mapInArrow(unpack, f"`{id}` long, start long, n_tokens long, ids_crc32 long")


def sequence(path: str, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of sequence i of a file, mapped without a copy of the ids."""
    reader = pa.ipc.open_file(pa.memory_map(path))
    batch = reader.get_batch(i // BATCH_ROWS)
    row = i % BATCH_ROWS
    return (batch.column("ids")[row].values.to_numpy(), batch.column("mask")[row].values.to_numpy(zero_copy_only=False))


def folder_of(spark) -> str:
    """A new folder below the shared one."""
    root = scratch_dir(spark)
    return f"{root if '://' in root or root.startswith('file:') else 'file://' + root}/tokens-{uuid.uuid4().hex}"
