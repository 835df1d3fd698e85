"""SentencePiece encoding and decoding of merge-type (BPE) models, exact, by backtracking instead of a merge queue.

A sequence of pieces is what merging makes of a text if and only if merging makes of each two adjacent pieces' text these
two pieces again. So the encoder takes at each place the longest piece that an Aho-Corasick pass found there, checks it
against the piece before by merging the two once more (the outcome is remembered), else tries the next shorter piece, and
steps back where none is left. A place from which there was no way on is marked in a bitfield and never entered again, as the
pieces up to a place are the same whatever follows; so the work is linear in the text.

A text is cut where no piece can lie across: before spaces that follow something else, where the model has no piece with
a space after another character, and around characters in no piece of several. Pieces of one cut don't depend on the others,
so short cuts that were seen already are looked up.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, pairwise
from math import inf

import ahocorasick
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.shared import in_slices, table

SPACE = "▁"
VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
#: How many cuts and pairs a task remembers; these are of LONGEST characters at most.
KNOWN, LONGEST = 1 << 19, 32


class Model:
    """Pieces, their scores and the ways between texts and ids; the library only reads the file."""

    def __init__(self, data: bytes):
        lib = sentencepiece.SentencePieceProcessor(model_proto=data)
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(k) for k in range(n)]
        self.bytes = {int(self.pieces[k][1:-1], 16): k for k in range(n) if lib.is_byte(k)}
        self.unknown = lib.unk_id()
        plain = [k for k in range(n) if not (lib.is_byte(k) or lib.is_control(k) or lib.is_unknown(k))]
        if lib.normalize("a  b ") != f"{SPACE}a{SPACE}{SPACE}b{SPACE}" or lib.normalize("ﬁ①") != f"{SPACE}ﬁ①" or any(lib.is_unused(k) for k in plain):
            raise ValueError("only models that keep texts as they are, with one space before, and use all their pieces are supported")
        self.ids = {self.pieces[k]: k for k in plain}
        self.rank = {self.pieces[k]: -lib.get_score(k) for k in plain}
        self.find = ahocorasick.Automaton()
        for p, k in self.ids.items():
            self.find.add_word(p, k)
        self.find.make_automaton()
        self.lengths = list(map(len, self.pieces))
        #: the next shorter piece that a piece begins with, or -1
        self.shorter = [next((self.ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), -1) for p in self.pieces]
        self.shorter[self.unknown] = -1
        self.surface = [self._surface(k, lib) for k in range(n)]
        self.cut = self._cuts()
        self._agree: dict[int, bool] = {}
        #: the ids of cuts that were seen, packed; those seen last, and those before
        self._known: dict[str, bytes] = {}
        self._before: dict[str, bytes] = {}

    def _surface(self, k: int, lib: sentencepiece.SentencePieceProcessor) -> bytes:
        if lib.is_byte(k):
            return bytes([int(self.pieces[k][1:-1], 16)])
        if lib.is_unknown(k):
            return " ⁇ ".encode()
        return b"" if lib.is_control(k) else self.pieces[k].replace(SPACE, " ").encode()

    def _cuts(self) -> re.Pattern[str]:
        """Where texts are cut: no piece has two neighbours that lie on different sides."""
        neighbours = {(a, b) for p in self.ids for a, b in pairwise(p)}
        beside = {c for pair in neighbours for c in pair}
        kind = "".join(re.escape(c) for c in map(chr, range(128)) if c not in beside and c != " ")
        one = f"|[{kind}]" if kind else ""
        if any(b == SPACE != a for a, b in neighbours):
            return re.compile(f"[^{kind}]+{one}" if kind else r"(?s:.+)")
        return re.compile(f"[ {SPACE}]*[^ {SPACE}{kind}]+|[ {SPACE}]+{one}")

    # --- encoding

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short text: the best-scored adjacent pair first, of equal ones the leftmost."""
        parts, rank = list(text), self.rank.get
        while len(parts) > 1:
            ranks = [rank(a + b, inf) for a, b in pairwise(parts)]
            best = min(ranks)
            if best == inf:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def agree(self, before: int, piece: int) -> bool:
        """Whether the two pieces stay as they are when their text is merged; before -1, whether the piece alone does."""
        known = self._agree.get(before * len(self.pieces) + piece)
        if known is None:
            pair = [self.pieces[k] for k in (before, piece) if k >= 0]
            known = piece != self.unknown and self.merged("".join(pair)) == pair
            if len(self._agree) >= KNOWN:
                self._agree.clear()
            self._agree[before * len(self.pieces) + piece] = known
        return known

    def backtrack(self, text: str) -> list[int]:
        """The pieces of a text; characters that are no piece become their bytes and part what is before from what follows."""
        lengths, shorter, unknown, n, agreed, many = self.lengths, self.shorter, self.unknown, len(text), self._agree.get, len(self.pieces)
        longest = array("i", [unknown]) * (n + 1)
        for end, k in self.find.iter(text):  # ends ascend, so the last piece from a place is the longest
            longest[end + 1 - lengths[k]] = k
        failed, any_failed = bytearray(n // 8 + 1), False
        out, at, piece, before = [], 0, longest[0], -1
        while at < n:
            fits = agreed(before * many + piece)
            if fits is None:
                fits = self.agree(before, piece)
            end = at + lengths[piece]
            if fits and not (any_failed and failed[end >> 3] >> (end & 7) & 1):
                out.append(piece)
                at, before, piece = end, piece, longest[end]
                continue
            if piece == unknown:
                out += self._bytes_of(text[at])
                at, before, piece = at + 1, -1, longest[at + 1]
                continue
            piece = shorter[piece]
            while piece < 0:
                failed[at >> 3] |= 1 << (at & 7)
                any_failed = True
                at -= lengths[before]
                piece = shorter[out.pop()]
                before = out[-1] if at and longest[at - 1] != unknown else -1
        return out

    def _bytes_of(self, char: str) -> list[int]:
        return [self.bytes.get(b, self.unknown) for b in char.encode()] if self.bytes else [self.unknown]

    def _encode_cut(self, text: str) -> bytes:
        known = self._known.get(text) or self._before.get(text) or array("i", self.backtrack(text.replace(" ", SPACE))).tobytes()
        if len(text) <= LONGEST:
            if len(self._known) >= KNOWN:  # what isn't met again before the next KNOWN others goes
                self._before, self._known = self._known, {}
            self._known[text] = known
        return known

    def encode(self, text: str) -> array:
        """The ids of a text, without begin and end; a space stands before the text, spaces are a character of their own."""
        return array("i", self.encoded(text))

    def encoded(self, text: str) -> bytes:
        """The ids as 32-bit numbers."""
        if not text:
            return b""
        cuts = self.cut.findall(" " + text)
        found = list(map(self._known.get, cuts))
        if None in found:
            found = [self._encode_cut(c) if x is None else x for c, x in zip(cuts, found, strict=True)]
        return b"".join(found)

    # --- decoding

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: the space before the text goes, bytes that are no UTF-8 become one U+FFFD each."""
        start = next((k for k, x in enumerate(ids) if self.surface[x]), len(ids))
        data = b"".join(map(self.surface.__getitem__, ids[start:]))
        if start < len(ids) and self.pieces[ids[start]].startswith(SPACE):
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return self._decode_odd(data)

    @staticmethod
    def _decode_odd(data: bytes) -> str:
        out, at = [], 0
        while at < len(data):
            try:
                out.append(data[at:].decode())
                break
            except UnicodeDecodeError as e:
                out.append(data[at : at + e.start].decode() + "�")
                at += e.start + 1
        return "".join(out)


@lru_cache(maxsize=2)
def _model(data: bytes) -> Model:
    """A worker's model, kept from task to task."""
    return Model(data)


def encode(docs: DataFrame, model: str = VOCABULARY, text: str = "text") -> DataFrame:
    """doc_id, ids (array of int) per row of docs, exactly the ids of the library without begin, end and sampling.

    The model file (half a megabyte) is read where the query starts and sent along. Null and empty texts have no ids;
    repeated rows and null doc_ids stay; other columns are not read; no rows give no rows. A task holds one long text and its ids.
    """
    data = _read(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _model(data)
        for b in in_slices(batches, "text", 1 << 20):
            found = [coder.encoded(t or "") for t in b.column("text").to_pylist()]
            ends = list(accumulate((len(x) // 4 for x in found), initial=0))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(found))]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids], ["doc_id", "ids"])

    rows = docs.select("doc_id", F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model: str = VOCABULARY) -> DataFrame:
    """encoded's rows (doc_id, ids) with the text of the ids, as the library's decode gives it; null ids have the text ''."""
    data = _read(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _model(data)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = part.column("ids")
                values, ends = ids.flatten().to_pylist(), list(accumulate(ids.value_lengths().fill_null(0).to_pylist(), initial=0))
                texts = [coder.decode(values[a:z]) for a, z in pairwise(ends)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")


def _read(model: str) -> bytes:
    with open(model, "rb") as f:
        return f.read()


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, and decoded again from their ids."""
    back = decode(encode(table(spark, sf_dir, "documents")))
    return back.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
