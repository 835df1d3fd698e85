"""Tokenisation and token columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The 48 known words of the compatibility tokenizer; their ids start at 4, after four special tokens.
COMPAT_WORDS = (
    "the a an and or but in on at to for of with by from as is was are were be been being have has had do does did will would should could may might must can this that these those i you he she it we they"
).split()
SPECIAL = ("<pad>", "<unk>", "<bos>", "<eos>")
WHITE = r"[ \t\n\r\f]+"
_IN_WORDS = ~np.isin(np.arange(256), np.frombuffer(b" \t\n\r\f", np.uint8))


def words(text: Column) -> Column:
    """Lower-case words between white space; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WHITE), lambda w: w != "")


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """words() in a task, of texts that are lower-case and not null: the words of all, and how many each text has."""
    if not len(texts):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    texts = texts.cast(pa.string())
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends -= ends[0]
    inside = _IN_WORDS[raw]  # white space is one byte in UTF-8, and no part of another character
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = ends[:-1][ends[:-1] < len(raw)]
    first[begins] = inside[begins]
    upto = np.concatenate(([0], np.cumsum(inside, dtype=np.int32)))
    offsets = np.append(upto[:-1][first], upto[-1]).astype(np.int32)
    found = pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    return found, np.diff(np.concatenate(([0], np.cumsum(first)))[ends])


def slices(texts: pa.Array, size: int) -> list[tuple[int, int]]:
    """(start, length) of consecutive rows of about so many bytes; a longer text is alone."""
    sizes, out, at = np.cumsum(np.asarray(pc.binary_length(texts), np.int64)), [], 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + size, "right")))
        out.append((at, to - at))
        at = to
    return out


def known(word: Column) -> Column:
    return word.isin(COMPAT_WORDS)


def compat_terms(text: Column) -> Column:
    """Words that the compatibility tokenizer knows; it drops the rest when it decodes."""
    return F.filter(words(text), known)


def compat_count(text: Column) -> Column:
    """Tokens of the compatibility tokenizer: one for a known word, one per character of any other."""
    return F.aggregate(words(text), F.lit(0).cast("long"), lambda n, w: n + F.when(known(w), 1).otherwise(F.char_length(w)).cast("long"))


def compat_encode(text: Column) -> Column:
    """Token ids: a known word's, or <unk> for each character."""
    ids = F.create_map(*(F.lit(x) for k, w in enumerate(COMPAT_WORDS) for x in (w, k + len(SPECIAL))))
    each = F.transform(words(text), lambda w: F.when(known(w), F.array(ids[w])).otherwise(F.array_repeat(F.lit(1), F.char_length(w).cast("int"))))
    return F.flatten(each)


def compat_decode(ids: Column) -> Column:
    """Words of the ids, special tokens and unknown ids dropped, joined by spaces."""
    names = F.array(*(F.lit(w) for w in COMPAT_WORDS))
    real = F.filter(ids, lambda i: (i >= len(SPECIAL)) & (i < len(SPECIAL) + len(COMPAT_WORDS)))
    return F.array_join(F.transform(real, lambda i: F.get(names, i - len(SPECIAL))), " ")


def chunks(text: Column, size: int = 512, overlap: int = 50) -> Column:
    """Overlapping pieces of `size` code points; none for null and empty texts."""
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size is needed")
    step = size - overlap
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))


def word_chunks(w: Column, size: int = 512, overlap: int = 50) -> Column:
    """Overlapping pieces of `size` words, joined by spaces."""
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size is needed")
    starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.transform(F.sequence(i, F.least(i + size, F.size(w)) - 1), lambda j: F.get(w, j)), " "))


def id_chunks(text: Column, size: int = 512, overlap: int = 50) -> Column:
    """Overlapping pieces of `size` token ids of the compatibility tokenizer, decoded; unknown words decode to nothing."""
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size is needed")

    def cut(ids: Column) -> Column:
        starts = F.when(F.size(ids) > 0, F.sequence(F.lit(0), F.size(ids) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: compat_decode(F.slice(ids, i + 1, F.lit(size))))

    return F.element_at(F.transform(F.array(compat_encode(text)), cut), 1)  # binds the ids, which would else be made for each piece


def chunk_documents(docs: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """(id, text, meta) per piece of docs (id, text, meta map<string,string>): the piece's number is in its id and, with the
    number of pieces, in its meta beside the document's own; null meta counts as empty; null and empty texts have no pieces."""
    rows = docs.select("id", "meta", F.explode(F.array(chunks(F.col("text"), size, overlap))).alias("c")).select("id", "meta", F.size("c").alias("n"), F.posexplode("c").alias("k", "piece"))
    own = F.map_filter(F.coalesce("meta", F.create_map().cast("map<string,string>")), lambda key, _: ~key.isin("chunk_idx", "total_chunks"))
    meta = F.map_concat(own, F.create_map(F.lit("chunk_idx"), F.col("k").cast("string"), F.lit("total_chunks"), F.col("n").cast("string")))
    return rows.select(F.concat_ws("_chunk_", "id", "k").alias("id"), F.col("piece").alias("text"), meta.alias("meta"))


def strip_tags(html: Column) -> Column:
    """Text between tags, white space as one space, trimmed."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"<[^>]+>", "")
    return F.trim(F.regexp_replace(bare, r"[ \t\n\r\f]+", " "))


def parse_size(text: Column) -> Column:
    """10k is 10 000 and 2m is 2 000 000; null if it is no number."""
    t = F.lower(F.trim(text))
    number = F.regexp_replace(t, "[km]$", "").try_cast("double")
    return (number * F.when(t.endswith("k"), 1000).when(t.endswith("m"), 1000000).otherwise(1)).cast("long")


def varint_bytes(value: Column) -> Column:
    """Bytes of a non-negative number in base-128 groups."""
    out = F.lit(1)
    for k in range(1, 9):
        out = out + F.when(value >= (1 << (7 * k)), 1).otherwise(0)
    return out.cast("long")


def varint_encode(value: Column) -> Column:
    """A non-negative number as bytes: groups of 7 bits, the lowest first, with the high bit set on all but the last."""
    group = lambda k: F.shiftrightunsigned(value, 7 * k).bitwiseAND(F.lit(127))
    more = lambda k: F.when(F.shiftrightunsigned(value, 7 * (k + 1)) > 0, 128).otherwise(0)
    digits = [F.when(F.shiftrightunsigned(value, 7 * k) > 0, F.lpad(F.hex(group(k) + more(k)), 2, "0")).otherwise("") for k in range(1, 9)]
    return F.unhex(F.concat(F.lpad(F.hex(group(0) + more(0)), 2, "0"), *digits))


def varint_decode(data: Column) -> Column:
    """The numbers that stand in a row of varint_encode's bytes; a cut off last one is left out."""
    digits = F.hex(data)
    places = F.when(F.octet_length(data) > 0, F.sequence(F.lit(0), F.octet_length(data) - 1)).otherwise(F.array().cast("array<int>"))
    numbers = F.transform(places, lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("long"))

    def step(s: Column, x: Column) -> Column:
        value = s["value"] + x.bitwiseAND(F.lit(127)) * F.pow(F.lit(128), s["place"]).cast("long")
        last = x < 128
        out = F.when(last, F.concat(s["out"], F.array(value))).otherwise(s["out"])
        return F.struct(out.alias("out"), F.when(last, F.lit(0).cast("long")).otherwise(value).alias("value"), F.when(last, F.lit(0)).otherwise(s["place"] + 1).alias("place"))

    start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("long").alias("value"), F.lit(0).alias("place"))
    return F.aggregate(numbers, start, step, lambda s: s["out"])


def zigzag(value: Column) -> Column:
    return F.shiftleft(value, 1).bitwiseXOR(F.shiftright(value, 63))


def unzigzag(value: Column) -> Column:
    return F.shiftrightunsigned(value, 1).bitwiseXOR(-value.bitwiseAND(F.lit(1)))


def trailing_id(text: Column) -> Column:
    """The number at the end of names like a_b_123; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?:^|_)(\d+)$", 1), F.lit("")).try_cast("long")
