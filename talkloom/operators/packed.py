"""An exchange of wide rows that keeps the first row per key: rows travel once, packed by destination and compressed."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from talkloom.operators.lookup import free_name

#: Bytes of rows that a task packs at once.
PACK_BYTES = 16 << 20
_PACKS = pa.schema([("to", pa.int32()), ("keys", pa.binary()), ("rest", pa.binary())])
_codec = pa.Codec("zstd", compression_level=3)


def _written(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    raw = sink.getvalue()
    return raw.size.to_bytes(8, "little") + _codec.compress(raw, asbytes=True)


def _read(packed: pa.Buffer) -> pa.Table:
    size = int.from_bytes(packed.slice(0, 8).to_pybytes(), "little")
    return pa.ipc.open_stream(_codec.decompress(packed.slice(8), size)).read_all()


def _leaves(column: pa.ChunkedArray) -> list[pa.ChunkedArray]:
    """A column that can be sorted by, or those a struct consists of, which are null where it is."""
    if not pa.types.is_struct(column.type):
        return [column]
    return [leaf for field in column.flatten() for leaf in _leaves(field)]


def first_of_key(key: pa.ChunkedArray, order: pa.ChunkedArray) -> np.ndarray:
    """Of each row, whether it is the first of its key in ``order``; nulls come first and are equal."""
    # No key has these many fields: a null one is told apart by a column of its own.
    by = [key.is_null(), key, *_leaves(order)]
    rows = pa.table(by, [str(i) for i in range(len(by))])
    at = pc.sort_indices(rows, sort_keys=[(name, "ascending") for name in rows.column_names], null_placement="at_start")
    in_order = key.take(at)
    first = np.zeros(len(key), bool)
    if len(key):
        one, other = in_order.slice(1), in_order.slice(0, len(key) - 1)
        differs = pc.fill_null(pc.not_equal(one, other), pa.scalar(False)).to_numpy() | (
            one.is_null().to_numpy() != other.is_null().to_numpy())
        first[at.to_numpy()] = np.concatenate([[True], differs])
    return first


def _packer(key: str, order: str, to: str):
    def packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches).combine_chunks()
        # A key that is in very many rows goes to its task once per pack.
        kept = np.flatnonzero(first_of_key(rows[key], rows[order]))
        places = rows[to].to_numpy()[kept]
        kept = kept[np.argsort(places, kind="stable")]
        places, counts = np.unique(places, return_counts=True)
        narrow, wide = rows.select([key, order]), rows.drop_columns([key, order, to])
        cuts = [pa.array(at) for at in np.split(kept, np.cumsum(counts)[:-1])]
        return pa.RecordBatch.from_arrays([
            pa.array(places, pa.int32()), pa.array([_written(narrow.take(at)) for at in cuts], pa.binary()),
            pa.array([_written(wide.take(at)) for at in cuts], pa.binary()),
        ], schema=_PACKS)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= PACK_BYTES:
                done, held, size = packed(held), [], 0
                del batch
                pa.default_memory_pool().release_unused()
                yield done
        if size or any(batch.num_rows for batch in held):
            yield packed(held)

    return pack


def _unpacker(key: str, order: str, columns: list[str]):
    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rests = [], []
        for batch in batches:
            keys += [_read(x.as_buffer()) for x in batch.column("keys")]
            rests += [x.as_buffer() for x in batch.column("rest")]
        if not keys:
            return
        narrow = pa.concat_tables(keys)
        first, at = first_of_key(narrow[key], narrow[order]), 0
        # What is wide stays packed but for one pack.
        for known, rest in zip(keys, rests):
            kept = first[at:at + len(known)]
            at += len(known)
            if kept.any():
                rows = _read(rest)
                for name in (key, order):
                    rows = rows.append_column(name, known[name])
                yield from rows.select(columns).filter(pa.array(kept)).to_batches()
        pa.default_memory_pool().release_unused()

    return unpack


def exchange_first(df: DataFrame, key: str, order: str, to: Column, parts: int) -> DataFrame:
    """The first row per ``key`` by the column ``order``, each in the partition ``to`` of ``parts``, which depends on the key alone.

    Rows pass Python as Arrow columns. A task holds its packs compressed and, of all their rows, key and order.
    """
    place = free_name("_to", df)
    placed = df.withColumn(place, F.coalesce(to, F.lit(0)).cast("int"))
    packs = placed.mapInArrow(_packer(key, order, place), "to int, keys binary, rest binary")
    return packs.repartitionById(parts, F.col("to")).mapInArrow(_unpacker(key, order, df.columns), df.schema)
