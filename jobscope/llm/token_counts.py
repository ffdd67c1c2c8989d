"""Exact token counts at every prefix, by dynamic programming over byte-pair prefixes.

The encoding of a byte string under byte-pair merges ends with exactly one token that is compatible
with the last token of the rest, so ``count[k] = count[k - len(last)] + 1`` holds for every prefix.
A text is cut into *atoms* (a run of white space with the word after it) at places where no prefix
is cut in another way; the deltas of each distinct atom are worked out once per Python worker and
joined by position. One signed byte per character is stored, so later questions (how many tokens has
this cut, where does a budget end) need no encoding at all: see ``tokens_at`` and ``chars_within``.

Cases: a null text counts as empty (zero tokens, empty deltas); the string of an added token is one
token, as the library has it, and a prefix that ends inside it is ordinary text; repeated rows and
null ids are kept as they are. The caches are emptied when full, which costs time only.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.llm.common import GROUP, WordTable, per_slice, text_of

MAX_ATOMS, MAX_PREFIXES = 300_000, 400_000

#: Prefixes of at most so many bytes are remembered with their counts.
KEPT = 16

#: How the tokenizer file's byte-level splitter cuts a text (fixed value of the file format).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ATOM = regex.compile(r"(?:\s*[^\S ])?(?:'s|'t|'re|'ve|'m|'ll|'d)|\s*(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s+")
_SPLIT = regex.compile(SPLIT)
_SPACE = regex.compile(r"\s*")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class PrefixCounter:
    """Token counts of all prefixes of texts under a byte-level byte-pair tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_letters())}
        plain = lambda s: bytes(back[c] for c in s)
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.rank = {(plain(a), plain(b)): i for i, (a, b) in enumerate(spec["model"]["merges"])}
        self.vocab = {plain(t) for t in spec["model"]["vocab"] if t not in self.added}
        self.longest = max(map(len, self.vocab))
        self.made = {a + b: i for (a, b), i in reversed(self.rank.items())}
        self.parts = {a + b: (a, b) for a, b in reversed(self.rank)}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.seen: dict[bytes, bytes] = {}
        self.atoms = WordTable(lambda new: [self._deltas(a) for a in new], MAX_ATOMS)
        self.added_split = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None

    def compatible(self, a: bytes, b: bytes) -> bool:
        """Whether two tokens stay apart when their bytes are encoded together.

        Undoes the merges on both sides of the border, latest first (on a tie the right one, as the
        left was merged first); the tokens stay apart if no facing pair could merge before the merge
        that was just undone.
        """
        rank, made, parts = self.rank, self.made, self.parts
        before, left, right = 1 << 60, a, b
        while True:
            m = rank.get((left, right))
            if m is not None and m < before:
                return False
            x, y = made.get(left, -1), made.get(right, -1)
            if x < 0 and y < 0:
                return True
            if x > y:
                left, before = parts[left][1], x
            else:
                right, before = parts[right][0], y + 1

    def prefixes(self, chunk: bytes) -> list[int]:
        """Token counts of ``chunk[:k]`` for every k from 0 on."""
        seen, vocab, fits = self.seen, self.vocab, self.fits
        if len(seen) >= MAX_PREFIXES:
            seen.clear()
        if len(fits) >= MAX_PREFIXES:
            fits.clear()
        size = len(chunk)
        ends = b"\0"  # by prefix: the length of its last token
        for k in range(min(size, KEPT), 1, -1):
            if (known := seen.get(chunk[:k])) is not None:
                ends = known
                break
        if len(ends) <= size:
            grown = bytearray(ends)
            for k in range(len(ends), size + 1):
                for at in range(max(0, k - self.longest), k):
                    token = chunk[at:k]
                    if token not in vocab:
                        continue
                    if at:
                        pair = chunk[at - grown[at] : at], token
                        ok = fits.get(pair)
                        if ok is None:
                            ok = fits[pair] = self.compatible(*pair)
                        if not ok:
                            continue
                    grown.append(k - at)
                    break
                if k <= KEPT:
                    seen[chunk[:k]] = bytes(grown)
            ends = grown
        counts = [0]
        for k in range(1, size + 1):
            counts.append(counts[k - ends[k]] + 1)
        return counts

    def _of_chunk(self, chunk: str) -> list[int]:
        """Counts at each character of one chunk of the splitter, as the end of a text."""
        raw = chunk.encode()
        counts = self.prefixes(raw)
        if len(raw) == len(chunk):
            out = counts
        else:
            ends = np.cumsum([0, *(len(c.encode()) for c in chunk)])
            out = [counts[e] for e in ends]
        if chunk in ("'re", "'ve", "'ll"):  # its first two characters alone are cut apart
            out = [*out[:2], 2, out[3]]
        return out

    def _deltas(self, atom: str) -> bytes:
        """Signed bytes: by how many tokens each character of an atom changes the count."""
        space = _SPACE.match(atom).end()
        if space == 0 or space == len(atom) or space == 1 and atom[0] == " ":
            own = self._of_chunk(atom)
            return bytes([b - a & 255 for a, b in zip(own, own[1:], strict=False)])
        counts, base, at = [0], 0, 0
        chunks = _SPLIT.findall(atom)
        counts = self._of_chunk(atom[:space])  # a prefix that ends in the white space has it as one chunk
        while at < space:
            piece = chunks.pop(0)
            own = self._of_chunk(piece)
            if at + len(piece) > space:
                counts += [base + c for c in own[space - at + 1 :]]
            at, base = at + len(piece), base + own[-1]
        for piece in chunks:
            own = self._of_chunk(piece)
            counts += [base + c for c in own[1:]]
            base += own[-1]
        return np.diff(np.array(counts)).astype(np.int8).tobytes()

    def _plain(self, texts: list[str]) -> list[bytes]:
        found: list[bytes] = []
        for at in range(0, len(texts), GROUP):
            found += self.atoms.joined([_ATOM.findall(t) for t in texts[at : at + GROUP]])
        return found

    def deltas(self, texts: list[str]) -> list[bytes]:
        """For each text, one signed byte per character; their running sum is the token count of each prefix."""
        special = [i for i, t in enumerate(texts) if any(x in t for x in self.added)]
        out = self._plain([t if i not in special else "" for i, t in enumerate(texts)] if special else texts)
        for i in special:
            out[i] = self._around_added(texts[i])
        return out

    def _around_added(self, text: str) -> bytes:
        """A text with added tokens in it: what stands between them is cut apart by itself."""
        parts = self.added_split.split(text)
        out = []
        for plain, added in zip(parts[::2], [*parts[1::2], ""], strict=True):
            if not added:
                out += self._plain([plain])
                continue
            before, own = self._plain([plain, plain + added[:-1]])
            total = lambda d: int(np.frombuffer(d, np.int8).sum(dtype=np.int64))
            out += [own, np.int8(total(before) + 1 - total(own)).tobytes()]
        return b"".join(out)


def tokens_at(deltas: bytes, chars: int) -> int:
    """Tokens of the first ``chars`` characters."""
    return int(np.frombuffer(deltas, np.int8)[:chars].sum(dtype=np.int64))


def chars_within(deltas: bytes, budget: int) -> int:
    """The longest prefix, in characters, that has ``budget`` tokens at most."""
    counts = np.cumsum(np.frombuffer(deltas, np.int8), dtype=np.int64)
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter for each tokenizer file and Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def with_prefix_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id``, ``text`` and ``prefix_deltas``: the stored form of all prefix counts."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(tokenizer)
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"], pa.array(c.deltas(batch["text"].to_pylist()), pa.binary())], ["doc_id", "text", "prefix_deltas"])

    return text_of(docs).mapInArrow(per_slice(work), "doc_id long, text string, prefix_deltas binary")


def token_count_table(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """Counts of whole texts and where the budget ``limit`` ends, from the prefix counts alone.

    ``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit`` tokens) and
    ``limit_chars``, the longest prefix within the limit.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(tokenizer)
        texts = batch["text"].to_pylist()
        stored = c.deltas(texts)
        totals = [tokens_at(d, len(d)) for d in stored]
        sizes = [len(t.encode()) for t in texts]
        cuts = [chars_within(d, limit) for d in stored]
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals]), pa.array(cuts, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_chars"])

    return text_of(docs).mapInArrow(per_slice(work), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, limit_chars long")


def within_budget(stored: DataFrame, budget: int) -> DataFrame:
    """Cut each text of ``with_prefix_counts`` to the longest prefix within the budget, without encoding."""

    @F.pandas_udf("int")
    def cut(deltas: pd.Series) -> pd.Series:
        return deltas.map(lambda d: chars_within(bytes(d), budget))

    size: Column = cut(F.col("prefix_deltas"))
    return stored.withColumn("text", F.col("text").substr(F.lit(1), size))
