"""64-bit fingerprints of texts from their word frequencies."""

from __future__ import annotations

import hashlib
import string
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from jobscope.functions.batches import mapped

BITS = 64


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


#: Tokens whose bits a Python worker remembers.
KNOWN = 1 << 17


#: Longest token that is remembered, in characters.
KNOWN_CHARS = 32

#: Bytes of UTF-8 with a space for each that is no part of a word.
_WORDS = bytes(c if chr(c) in string.ascii_lowercase + string.digits else ord(" ") for c in range(256))

_MD5: dict[str, bytes] = {}
_BLAKE2B: dict[str, bytes] = {}


def _fingerprints(texts: pd.Series, digest: Callable[[bytes], bytes], known: dict[str, bytes]) -> pd.Series:
    """``_fingerprint`` of each text."""
    return texts.map(_fingerprint(digest, known))


def _fingerprint(digest: Callable[[bytes], bytes], known: dict[str, bytes]) -> Callable[[str | None], int]:
    """A bit is set if the words that have it outweigh those that don't; a text without words has fingerprint 0.

    ``known`` holds the bits of tokens that the worker has met, at most ``KNOWN`` of at most ``KNOWN_CHARS`` characters.
    """

    def one(text: str | None) -> int:
        counts = Counter((text or "").lower().encode().translate(_WORDS).decode("ascii").split())
        if not counts:
            return 0
        if len(known) > KNOWN:
            known.clear()
        bits = []
        for w in counts:
            value = known.get(w)
            if value is None:
                value = digest(w.encode())
                if len(w) <= KNOWN_CHARS:
                    known[w] = value
            bits.append(value)
        hashes = np.frombuffer(b"".join(bits), np.uint8).reshape(-1, 8)
        weights = np.fromiter(counts.values(), np.float64, len(counts))
        more = 2 * (weights @ np.unpackbits(hashes, axis=1)) > weights.sum()
        return int(np.packbits(more).view(">i8")[0])

    return one


@F.arrow_udf(LongType())
def simhash_by_md5(texts: pa.Array) -> pa.Array:
    """The fingerprint with the first 64 bits of each token's md5 (Arrow-batched, no shuffle), as signed 64 bits."""
    return mapped(texts, _fingerprint(lambda w: hashlib.md5(w).digest()[:8], _MD5), pa.int64())


@F.arrow_udf(LongType())
def simhash_by_blake2b(texts: pa.Array) -> pa.Array:
    """The fingerprint with 8-byte blake2b token hashes (Arrow-batched), as signed 64 bits."""
    return mapped(texts, _fingerprint(lambda w: hashlib.blake2b(w, digest_size=8).digest(), _BLAKE2B), pa.int64())
