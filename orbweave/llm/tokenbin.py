"""Operator 3, token-ID / binary output: flat unsigned files with 64-bit offsets.

Each partition encodes its documents and writes three flat files to the shared folder:
``.tok`` (uint16 identifiers, uint32 for vocabularies beyond 65,536), ``.off`` (n + 1 int64
token offsets within the file) and ``.ids`` (n int64 doc_ids, -1 for null). File names carry the run and the task attempt, and only
those of attempts whose rows were committed enter the manifest, so a lost or repeated
task leaves nothing that is read; leftovers of this run's own attempts are deleted, other files never. A folder that
already holds anything is refused. Bases of the files are exclusive prefix sums of their
token and document counts, so a document's global offset is its file's base plus its own.

A null or empty text has zero tokens and keeps its row; a null doc_id is -1 in ``.ids`` and null in the result. Special-token
strings are ordinary text. Very long texts are encoded whole, one at a time. Repeated rows and ties of doc_id are written as often as they
come, each with a place of its own; documents lie in the order of the input's partitions. An empty table gives no
rows and a manifest without files. Extra columns are ignored, also such with clashing names.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import delete, join_checked, pick, scratch_path, ship, shipped, stored

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_encoding(path: str = TOKENIZER, pattern: str = PATTERN):
    """A byte-level BPE encoding from a file of base64 tokens and ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _writer(folder: str, run: str, tokenizer: str, pattern: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = load_encoding(shipped(tokenizer), pattern)
        kind = np.uint16 if enc.n_vocab <= 1 << 16 else np.uint32
        task = TaskContext.get()
        part = task.partitionId()
        name = f"{run}-{part:06d}-{task.attemptNumber()}-{uuid.uuid4().hex[:8]}"
        at, root = fs.FileSystem.from_uri(folder)
        out, offsets, ids, pos, seq = None, [np.zeros(1, np.int64)], [], 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                at.create_dir(root, recursive=True)
                out = at.open_output_stream(f"{root}/{name}.tok")
            sizes = np.zeros(b.num_rows, np.int64)
            for i, text in enumerate(b.column(1)):
                if t := text.as_py():
                    tokens = enc.encode_to_numpy(t, disallowed_special=())
                    out.write(tokens.astype(kind).tobytes())
                    sizes[i] = len(tokens)
            ends = pos + np.cumsum(sizes)
            offsets.append(ends)
            ids.append(b.column(0).fill_null(-1).to_numpy())
            yield pa.record_batch(
                [b.column(0), pa.array(np.full(b.num_rows, part, np.int32)), pa.array([name] * b.num_rows), pa.array(np.arange(seq, seq + b.num_rows)), pa.array(ends - sizes), pa.array(sizes)],
                names=["doc_id", "part", "shard", "seq", "start", "n_tokens"],
            )
            pos, seq = int(ends[-1]), seq + b.num_rows
        if out is not None:
            out.close()
            for kind_, data in (("off", offsets), ("ids", ids)):
                with at.open_output_stream(f"{root}/{name}.{kind_}") as f:
                    f.write(np.concatenate(data).astype(np.int64).tobytes())

    return write


def write_tokens(docs: DataFrame, folder: str | None = None, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """Encode and write all documents. One row per document: (doc_id, shard, doc_index, token_offset, n_tokens),
    the offsets counting over all files in the order of ``manifest.json``."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    at, root = fs.FileSystem.from_uri(folder)
    if at.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        raise FileExistsError(f"{folder} is not empty")
    run = f"run{uuid.uuid4().hex[:12]}"
    rows = pick(docs, doc_id="bigint", text="string")
    index = stored(rows.mapInArrow(_writer(folder, run, ship(spark, tokenizer), pattern), "doc_id bigint, part int, shard string, seq bigint, start bigint, n_tokens bigint"), "tokens-index")
    # One row per file: the window needs one partition, whose size is the number of input partitions.
    shards = index.groupBy("part", "shard").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    before = W.orderBy("part", "shard").rowsBetween(W.unboundedPreceding, -1)
    bases = stored(
        shards.select("shard", "part", "docs", "tokens", F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("doc_base"), F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("token_base")),
        "tokens-bases",
    )
    _manifest(folder, run, bases, tokenizer)
    return join_checked(index, bases.select("shard", "doc_base", "token_base"), "shard", "inner", 80).select(
        "doc_id", "shard", (F.col("doc_base") + F.col("seq")).alias("doc_index"), (F.col("token_base") + F.col("start")).alias("token_offset"), "n_tokens"
    )


def _manifest(folder: str, run: str, bases: DataFrame, tokenizer: str) -> None:
    at, root = fs.FileSystem.from_uri(folder)
    at.create_dir(root, recursive=True)
    shards = [r.asDict() for r in bases.orderBy("token_base", "part").collect()]
    keep = {s["shard"] for s in shards}
    for f in at.get_file_info(fs.FileSelector(root)):
        if f.base_name.startswith(f"{run}-") and f.base_name.rpartition(".")[0] not in keep:
            at.delete_file(f.path)  # of attempts that were not committed
    wide = load_encoding(tokenizer).n_vocab > 1 << 16
    with at.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"dtype": "uint32" if wide else "uint16", "tokenizer": tokenizer, "shards": shards}).encode())


class TokenStore:
    """Reads what :func:`write_tokens` wrote, memory-mapped. For folders mounted as local paths."""

    def __init__(self, folder: str):
        self.root = folder.removeprefix("file://")
        with open(f"{self.root}/manifest.json") as f:
            m = json.load(f)
        self.kind, self.shards = np.dtype(m["dtype"]), m["shards"]
        self.base = np.array([s["doc_base"] for s in self.shards] + [sum(s["docs"] for s in self.shards)])

    def __len__(self) -> int:
        return int(self.base[-1])

    def _map(self, shard: str, kind: str, dtype) -> np.ndarray:
        path = f"{self.root}/{shard}.{kind}"
        import os

        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)

    def __getitem__(self, i: int) -> tuple[int, np.ndarray]:
        """(doc_id, tokens) of the document with global index ``i``."""
        k = int(np.searchsorted(self.base, i, "right")) - 1
        s, j = self.shards[k]["shard"], i - int(self.base[k])
        off = self._map(s, "off", np.int64)
        return int(self._map(s, "ids", np.int64)[j]), self._map(s, "tok", self.kind)[off[j] : off[j + 1]]


__all__ = ["TokenStore", "delete", "load_encoding", "write_tokens"]
