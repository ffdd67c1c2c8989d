"""Texts of an Arrow batch, a few at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Rows, and bytes of texts, that are Python strings at once (one row at least).
ROWS, BYTES = 512, 4 << 20


def parts(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in parts of bounded rows and bytes."""
    begin = held = 0
    for at, size in enumerate(pc.binary_length(texts).to_pylist()):
        if at > begin and (held + (size or 0) > BYTES or at - begin >= ROWS):
            yield texts.slice(begin, at - begin)
            begin = at
            held = 0
        held += size or 0
    if begin < len(texts):
        yield texts.slice(begin)


def mapped(texts: pa.Array, f: Callable[[str | None], object], kind: pa.DataType) -> pa.Array:
    """``f`` of each text; only results stay while the next part is worked on."""
    done = [pa.array([f(t) for t in part.to_pylist()], kind) for part in parts(texts)]
    return pa.concat_arrays(done) if done else pa.array([], kind)
