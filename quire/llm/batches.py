"""Arrow batches of documents in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Characters of text that one slice holds at most, but for a single longer text.
SLICE_CHARS = 1_000_000




def sliced(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batches cut into slices, each with its texts (null: empty)."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).to_pylist()
        start = size = 0
        for i, n in enumerate([*sizes, None]):
            if i == len(sizes) or (i > start and size + (n or 0) > limit):
                if i > start:
                    part = batch.slice(start, i - start)
                    yield part, [t or "" for t in part.column(text).to_pylist()]
                start, size = i, 0
            size += n or 0


def records(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
