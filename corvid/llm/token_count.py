"""Token counts that follow edits: pre-token trees per document, re-encoded only where an edit reaches.

A text's tokens are the sum over its pre-tokens. The tree's leaves are blocks of pre-tokens with their text and tokens,
its inner nodes sums of code points and tokens. An edit finds its block by descending on code points, scans again from a
few pre-tokens before it until a new boundary falls on an old one behind it, encodes only the pre-tokens in between and
updates the sums on the paths to the root; the rest of the text isn't touched. Trees are kept in a table beside their
documents, from which later versions are counted.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import accumulate, pairwise
from math import isqrt

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.shared import in_slices, table, written

#: The usual pre-token pattern of byte-level vocabularies; no alternative looks more than REACH characters past its match.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REACH = 4
BLOCK = 32
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


class Counter:
    """Tokens of a pre-token; known ones are remembered, up to a limit."""

    def __init__(self, vocabulary: bytes, most: int = 1 << 18):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.encode = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, int] = {}
        self.most, self.encoded = most, 0
        self.scan = regex.compile(PATTERN)

    def __call__(self, pieces: list[str]) -> list[int]:
        known = self.known
        out = list(map(known.get, pieces))
        if None in out:
            for k, n in enumerate(out):
                if n is None:
                    n = known.get(p := pieces[k]) or len(self.encode(p))
                    out[k] = n
                    if len(p) <= 32:
                        if len(known) >= self.most:
                            known.clear()
                        known[p] = n
        return out


class PieceTree:
    """A document's pre-tokens with subtree sums of code points and tokens."""

    def __init__(self, text: str, count: Counter, kept: tuple[list[int], list[int]] | None = None):
        """From a text, or from a text and the lengths and tokens of its pre-tokens that were kept."""
        self.count, self.rescanned = count, 0
        if kept is None:
            pieces = count.scan.findall(text)
            self._build(pieces, count(pieces))
        else:
            ends = list(accumulate(kept[0], initial=0))
            self._build([text[a:b] for a, b in pairwise(ends)], kept[1])

    def _build(self, pieces: list[str], tokens: list[int]) -> None:
        n = max(1, -(-len(pieces) // BLOCK))
        self.size = 1 << (n - 1).bit_length()
        #: pre-tokens that a leaf may grow to before the tree is built anew
        self.most = max(8 * BLOCK, isqrt(len(pieces)))
        self.leaves = [(pieces[k * BLOCK : (k + 1) * BLOCK], tokens[k * BLOCK : (k + 1) * BLOCK]) for k in range(self.size)]
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for k in range(self.size):
            self._leaf_sum(k)
        for k in range(self.size - 1, 0, -1):
            self._sum(k)

    def _leaf_sum(self, k: int) -> None:
        pieces, tokens = self.leaves[k]
        self.chars[self.size + k], self.tokens[self.size + k] = sum(map(len, pieces)), sum(tokens)

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(p for pieces, _ in self.leaves for p in pieces)

    def kept(self) -> tuple[list[int], list[int]]:
        """Lengths and tokens of the pre-tokens, from which the tree can be had again with the text."""
        return [len(p) for pieces, _ in self.leaves for p in pieces], [n for _, tokens in self.leaves for n in tokens]

    def _find(self, at: int) -> tuple[int, int, int]:
        """Block, place in it and start of the pre-token that holds code point `at`, or the end of the last block."""
        k, start = 1, 0
        while k < self.size:
            k *= 2
            if at - start >= self.chars[k] and self.chars[k + 1]:
                start += self.chars[k]
                k += 1
        pieces = self.leaves[k - self.size][0]
        for i, p in enumerate(pieces):
            if at < start + len(p):
                return k - self.size, i, start
            start += len(p)
        return k - self.size, len(pieces), start

    def _from(self, block: int, place: int) -> Iterator[tuple[int, int, str]]:
        """The pre-tokens from a place on, each with the block and place behind it."""
        for b in range(block, self.size):
            pieces = self.leaves[b][0]
            for i in range(place if b == block else 0, len(pieces)):
                yield b, i + 1, pieces[i]

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces code points start to end by `new`."""
        block, place, at = self._find(max(0, start - REACH))
        rest, old, old_end, behind = self._from(block, place), [], at, {}
        tail, more = "", 64
        while True:  # old text is read on, twice as much each time, until a new boundary falls on an old one
            want, done = max(end, old_end) + more, False
            while old_end < want:
                step = next(rest, None)
                if step is None:
                    done = True
                    break
                old.append(step[2])
                old_end += len(step[2])
                if old_end >= end:
                    behind[old_end] = step[:2]
            text = "".join(old)
            head, tail = text[: start - at], text[end - at :]
            shift = len(new) - (end - start)
            buffer, fresh, here, stop = head + new + tail, [], at, None
            for m in self.count.scan.finditer(buffer):
                # A match is sure if what follows it, as far as the pattern looks, is known.
                if not done and m.end() + REACH > len(buffer):
                    break
                fresh.append(m[0])
                here = at + m.end()
                if here >= start + len(new) and here - shift in behind:
                    stop = behind[here - shift]
                    break
            if stop is None and done:
                stop = (self.size - 1, len(self.leaves[-1][0]))
            if stop is not None:
                break
            more *= 2
        self.rescanned += sum(map(len, fresh))
        b, i = stop
        first, last = (tuple(x[:place] for x in self.leaves[block]), tuple(x[i:] for x in self.leaves[b]))
        for k in range(block + 1, b + 1):
            self.leaves[k] = ([], [])
        self.leaves[block] = (first[0] + fresh + last[0], first[1] + self.count(fresh) + last[1])
        if len(self.leaves[block][0]) > self.most:
            self._build([x for a, _ in self.leaves for x in a], [x for _, a in self.leaves for x in a])
            return
        for k in range(block, b + 1):
            self._leaf_sum(k)
        lo, hi = (self.size + block) // 2, (self.size + b) // 2
        while lo:
            for k in range(lo, hi + 1):
                self._sum(k)
            lo, hi = lo // 2, hi // 2


Edits = Callable[[str], list[tuple[int, int, str]]]


def masking_edits(text: str) -> list[tuple[int, int, str]]:
    """The query's edits, in order: mail addresses, network addresses and long numbers become placeholders; none overlap."""
    numbers = [(m.start(), m.end(), "<number>") for m in _NUMBER.finditer(text)]
    mails = [(m.start(), m.end(), "<mail>") for m in _MAIL.finditer(text)] if "@" in text else []
    out, k = mails[:], 0
    for x in numbers:  # both lists are in order: one pass leaves out the numbers inside addresses
        while k < len(mails) and mails[k][1] <= x[0]:
            k += 1
        if k == len(mails) or mails[k][0] >= x[1]:
            out.append(x)
    return sorted(out)


_NUMBER = re.compile(r"[0-9]{9,}|[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
_MAIL = re.compile(r"[A-Za-z0-9._-]{1,64}@[A-Za-z0-9.-]{1,255}")


def _pack(numbers: list[int]) -> bytes:
    """The numbers in as few bytes each as the largest needs, 1, 2 or 4, which the first byte tells."""
    most = max(numbers, default=0)
    code = "B" if most < 1 << 8 else "H" if most < 1 << 16 else "I"
    return code.encode() + array(code, numbers).tobytes()


def _unpack(data: bytes) -> list[int]:
    return array(chr(data[0]), data[1:]).tolist()


def _ranks(vocabulary: str) -> bytes:
    with open(vocabulary, "rb") as f:
        return f.read()


def build_trees(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, text, n_tokens, lengths and tokens (of the tree's pre-tokens, packed).

    The vocabulary file is read where the query starts and sent along (it is under 1 MB). Null and empty texts have 0
    tokens and a null text stays null; repeated rows and null ids stay; other columns are not read; no rows give no rows.
    """
    ranks = _ranks(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(ranks)
        for b in in_slices(batches, "text"):
            totals, lengths, tokens = [], [], []
            for t in b.column("text").to_pylist():
                pieces = count.scan.findall(t or "")
                n = count(pieces)
                totals.append(sum(n))
                lengths.append(_pack(list(map(len, pieces))))
                tokens.append(_pack(n))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(totals, pa.int64()), pa.array(lengths, pa.binary()), pa.array(tokens, pa.binary())], ["doc_id", "text", "n_tokens", "lengths", "tokens"])

    kept = docs.select("doc_id", F.col(text).cast("string").alias("text"))
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, text string, n_tokens bigint, lengths binary, tokens binary")


def recount(trees: DataFrame, vocabulary: str = VOCABULARY, edits: Edits = masking_edits) -> DataFrame:
    """The next version of each row of build_trees (or of this): doc_id, text, n_tokens, lengths, tokens of the edited text,
    n_tokens_before, n_edits, n_chars_rescanned.

    edits gives a text's replacements (start, end, new), in order and apart; they apply from the last to the first. Only
    what they touch is encoded. Null texts have no edits and stay null; no rows give no rows.
    """
    ranks = _ranks(vocabulary)
    names = ["doc_id", "text", "n_tokens", "lengths", "tokens", "n_tokens_before", "n_edits", "n_chars_rescanned"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(ranks)
        for b in in_slices(batches, "text", 1 << 20):
            out: list[list] = [[] for _ in names[1:]]
            for t, before, *kept in zip(*(b.column(c).to_pylist() for c in ("text", "n_tokens", "lengths", "tokens")), strict=True):
                changes = edits(t) if t else []
                row = [t, before, *kept, before, len(changes), 0]
                if changes:
                    tree = PieceTree(t, count, tuple(map(_unpack, kept)))
                    for change in reversed(changes):
                        tree.edit(*change)
                    row[:4] = tree.text, tree.total, *map(_pack, tree.kept())
                    row[6] = tree.rescanned
                for o, v in zip(out, row, strict=True):
                    o.append(v)
            kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, out, kinds)], names)

    kind = trees.schema["doc_id"].dataType.simpleString()
    return trees.select(names[:5]).mapInArrow(run, f"doc_id {kind}, text string, n_tokens bigint, lengths binary, tokens binary, n_tokens_before bigint, n_edits bigint, n_chars_rescanned bigint")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents, their trees kept in a table, and from it those after the masking edits."""
    trees = written(build_trees(table(spark, sf_dir, "documents")), "trees")
    return recount(trees).select("doc_id", F.col("n_tokens_before").alias("n_tokens"), "n_edits", F.col("n_tokens").alias("n_tokens_edited"), "n_chars_rescanned")
