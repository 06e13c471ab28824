"""Token ids as flat binary files with 64-bit document offsets, written by tasks and memory-mapped by readers."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from pathlib import Path
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._stage import keep_until_release, shared_dir, shuffles_removed, small_batches, worker_state
from ._units import WIDE_SPACE, ByteLevel, Units, UnitTable
from ._words import Texts, ranges
from .packing import vocabulary_path

#: Texts are tokenized in runs of about this many bytes, so that units repeat within one.
RUN_BYTES = 1 << 20
#: Rows a reader returns at a time.
READ_ROWS = 8192


class UnitIds(UnitTable):
    """The ids of each different unit by a byte-level vocabulary."""

    def __init__(self, path: str) -> None:
        self.tokens = ByteLevel(path, special=True)
        #: Ids have 2 bytes where the vocabulary allows it, else 4.
        self.wide = 2 if len(self.tokens.sizes) <= 1 << 16 else 4
        #: Special tokens within a text keep their own ids, so such texts are one unit.
        self.odd = re.compile(b"|".join([WIDE_SPACE, *map(re.escape, self.tokens.special)]))
        super().__init__()

    def clear(self) -> None:
        super().clear()
        self.ids, self.counts = np.zeros(0, dtype=f"<u{self.wide}"), np.zeros(0, dtype=np.int64)

    def add(self, units: list[bytes], whole: np.ndarray) -> None:
        ids, counts = self.tokens.encode(units, whole)
        self.ids = np.concatenate([self.ids, ids.astype(self.ids.dtype)])
        self.counts = np.concatenate([self.counts, counts])
        self.starts = np.cumsum(self.counts) - self.counts

    def of(self, texts: Texts, a: int, b: int, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts ``a .. b`` end to end, each text's followed by ``end_id``, and how many each has."""
        units = Units(texts, a, b, self.odd)
        number = self.numbers(units)
        each = self.counts[number]
        counts = np.bincount(units.owner, weights=each, minlength=b - a).astype(np.int64) + 1
        out = np.full(int(counts.sum()), end_id, dtype=self.ids.dtype)
        if len(number):
            at = np.cumsum(each) - each + units.owner  # a text before adds one end
            out[ranges(at, each)] = self.ids[ranges(self.starts[number], each)]
        return out, counts


def mounted(folder: str) -> Path:
    """The local path of a shared folder: files can be mapped where it is mounted under the same path on all machines."""
    place = urlparse(folder)
    if place.scheme not in ("", "file"):
        raise ValueError(f"token files are memory-mapped: give a folder that is mounted on all machines, not {folder}")
    return Path(unquote(place.path))


class _Part:
    """The files of one part, under names of this attempt until all is written."""

    def __init__(self, folder: str, number: int) -> None:
        self.stem = f"{folder}/part-{number:06d}"
        self.attempt = f".{uuid.uuid4().hex[:12]}.tmp"
        self.files = {kind: open(f"{self.stem}.{kind}{self.attempt}", "wb") for kind in ("ids", "offsets", "docs")}  # noqa: SIM115
        self.files["offsets"].write(bytes(8))
        self.docs = self.nulls = self.tokens = 0

    def write(self, doc_ids: pa.Array, counts: np.ndarray, ids: np.ndarray) -> None:
        self.files["ids"].write(ids.tobytes())
        self.files["offsets"].write((self.tokens + np.cumsum(counts)).astype("<i8").tobytes())
        self.files["docs"].write(doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
        self.docs += len(counts)
        self.nulls += doc_ids.null_count
        self.tokens += int(counts.sum())

    def publish(self) -> None:
        for kind, f in self.files.items():
            f.flush()
            os.fsync(f.fileno())
            f.close()
            os.replace(f.name, f"{self.stem}.{kind}")

    def abandon(self) -> None:
        for f in self.files.values():
            f.close()
            Path(f.name).unlink(missing_ok=True)


_PARTS = "part int, id_bytes int, n_docs long, n_null long, n_tokens long"


def _write(path: str, folder: str, end_id: int):
    schema = pa.schema([("part", pa.int32()), ("id_bytes", pa.int32()), ("n_docs", pa.int64()), ("n_null", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        kept = worker_state("token_files")
        if (tokens := kept.get(("ids", path))) is None:
            tokens = kept["ids", path] = UnitIds(path)
        number, part = TaskContext.get().partitionId(), None
        try:
            for batch in batches:
                if not len(batch):
                    continue
                part = part or _Part(folder, number)
                texts = Texts(batch.column("text"))
                for a, b in texts.runs(RUN_BYTES):
                    ids, counts = tokens.of(texts, a, b, end_id)
                    part.write(batch.column("doc_id").slice(a, b - a), counts, ids)
            if part:
                part.publish()
                row = ([number], [tokens.wide], [part.docs], [part.nulls], [part.tokens])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, schema, strict=True)], schema=schema)
                part = None
        finally:
            if part:
                part.abandon()

    return run


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 0) -> None:
    """Write the token ids of all documents, in ascending doc_id order, to ``folder``.

    A part of the documents has three flat little-endian files: ``part-N.ids``,
    its documents' ids end to end, each document followed by ``end_id`` (unsigned,
    16 bits where the vocabulary allows it, else 32); ``part-N.offsets``, where
    each document starts among them, and their number (64 bits); ``part-N.docs``,
    the doc_ids (64 bits).  ``manifest`` is a Parquet table of a row per part:
    ``part, id_bytes, n_docs, n_null, n_tokens, first_doc, base``; ``base``, the
    ids of all parts before, is a prefix sum over that table.

    Texts are dealt by ranges of (doc_id, hash of the text), so that rows of one
    doc_id can lie in several parts; equal doc_ids are ordered by that hash, then
    by text.  Tasks write under names of their own and rename at the end, so a
    task that runs again or twice leaves the same files.  ``folder`` has to be
    mounted under one path on all machines.

    A null or empty text has ``end_id`` alone.  Null doc_ids come first; the
    manifest's ``n_null`` counts them, and they stand as 0 among the docs.  Rows
    repeated whole are written each; other columns are ignored; an empty table
    gives a manifest without rows.  Special tokens within a text have their own ids.
    """
    spark = docs.sparkSession
    small_batches(spark)
    place = mounted(folder)
    place.mkdir(parents=True, exist_ok=True)
    if any(place.iterdir()):
        raise FileExistsError(f"{place} is not empty")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    key = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = texts.repartitionByRange(*key).sortWithinPartitions(*key, "text")
    written = f"{folder}/written"
    with shuffles_removed(spark):
        dealt.mapInArrow(_write(path or vocabulary_path("byte_bpe_50k.json"), str(place), end_id), _PARTS).write.parquet(written)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = spark.read.schema(_PARTS).parquet(written)
    bases = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for c, n in (("n_docs", "first_doc"), ("n_tokens", "base"))]
    parts.select("*", *bases).write.parquet(f"{folder}/manifest")


def _read(folder: str):
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches):
        for batch in batches:
            for part in batch.to_pylist():
                stem, n = f"{folder}/part-{part['part']:06d}", part["n_docs"]
                ids = np.memmap(f"{stem}.ids", dtype=f"<u{part['id_bytes']}", mode="r")
                offsets = np.memmap(f"{stem}.offsets", dtype="<i8", mode="r")
                docs = np.memmap(f"{stem}.docs", dtype="<i8", mode="r")
                if not len(offsets) == n + 1 == len(docs) + 1 or offsets[-1] != len(ids):
                    raise ValueError(f"{stem}: ids, offsets and docs do not fit together")
                for a in range(0, n, READ_ROWS):
                    cuts = offsets[a : a + READ_ROWS + 1].tolist()
                    crc = [zlib.crc32(ids[s:e].astype("<u4")) for s, e in zip(cuts, cuts[1:], strict=False)]
                    starts = np.array(cuts[:-1], dtype=np.int64)
                    null = np.arange(a, a + len(starts)) < part["n_null"]
                    columns = [
                        pa.array(np.array(docs[a : a + len(starts)]), pa.int64(), mask=null),
                        pa.array(starts + part["base"]),
                        pa.array(np.diff(cuts)),
                        pa.array(crc, pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of token files: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is the CRC-32
    of the document's ids as little-endian unsigned 32-bit integers.  One task a
    part maps its files; nothing is read whole into memory.
    """
    parts = spark.read.parquet(f"{folder}/manifest").select("part", "id_bytes", "n_docs", "n_null", "base")
    dealt = parts.repartition(max(1, parts.count()))
    return dealt.mapInArrow(_read(str(mounted(folder))), "doc_id long, start long, n_tokens long, ids_crc32 long")


def document_ids(folder: str, part: int, row: int, id_bytes: int = 2) -> np.ndarray:
    """One document's ids with the end id, as a view of the mapped file."""
    stem = f"{mounted(folder)}/part-{part:06d}"
    offsets = np.memmap(f"{stem}.offsets", dtype="<i8", mode="r")
    return np.memmap(f"{stem}.ids", dtype=f"<u{id_bytes}", mode="r")[offsets[row] : offsets[row + 1]]


def token_files(docs: DataFrame, path: str | None = None, end_id: int = 0) -> DataFrame:
    """Write the documents to a new folder in the shared one, and read them back; ``release`` removes the folder."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/quillon/token-files-{uuid.uuid4().hex[:12]}"
    keep_until_release(spark, folder)
    write_token_files(docs, folder, path, end_id)
    return read_token_files(spark, folder)
