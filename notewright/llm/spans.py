"""Spans of code points in texts: finding, numbering of rows, and the joined form."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:int,end:int,key:long>"
SPAN_ARROW = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("key", pa.int64())])


def key_of(text: str) -> int:
    """64 bits that name a value."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def joined(spans: list[tuple], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in sorted(spans, key=lambda x: (x[1], rank[x[0]], x[2])))


def joined_column(spans: Column, kinds: tuple[str, ...]) -> Column:
    """The same of an array of spans."""
    rank = lambda k: F.array_position(F.array(*[F.lit(x) for x in kinds]), k)
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("s"), rank(x["kind"]).alias("r"), x["end"].alias("e"), x["kind"].alias("k"))))
    return F.array_join(F.transform(keyed, lambda x: F.concat_ws(":", x["k"], x["s"], x["e"])), ",")


def rows_with_spans(find: Callable[[str], tuple[list[tuple], list]], extra: pa.DataType, kinds: tuple[str, ...]):
    """mapInArrow over (id, ..., text): row, the columns before the text, base spans and their hash, and what else find returns.

    row numbers the rows of this run; it holds once the result has been written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            base, sha, more = [], [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                spans, rest = find(text or "")
                base.append([{"kind": k, "start": s, "end": e, "key": h} for k, s, e, h in spans])
                sha.append(hashlib.sha256(joined(spans, kinds).encode()).hexdigest())
                more.append(rest)
            n = batch.num_rows
            kept, names = batch.columns[:-1], batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(row, row + n), pa.int64()), *kept, pa.array(base, pa.list_(SPAN_ARROW)), pa.array(sha, pa.string()), pa.array(more, extra)],
                names=["row", *names, "base", "base_sha256", "more"],
            )
            row += n

    return run
