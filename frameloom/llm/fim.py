"""Fill-in-the-middle: cuts by succinct rank and select over packed bitvectors of token and character starts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import slices, utf8

#: Markers of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that stay plain, and percent of the others whose suffix stands first.
PLAIN_PERCENT, SUFFIX_FIRST_PERCENT = 10, 20
#: Bytes of a bitvector in a block of the directory.
BLOCK = 64
_POPCOUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class Bits:
    """A packed bitvector with the number of ones before each block."""

    def __init__(self, flags: np.ndarray):
        packed = np.packbits(flags)
        self.packed = np.pad(packed, (0, -len(packed) % BLOCK + BLOCK))  # a block of zeros at the end
        ones = _POPCOUNT[self.packed].reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])
        self.total = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        byte = at >> 3
        block = byte // BLOCK
        own = np.cumsum(_POPCOUNT[self.packed.reshape(-1, BLOCK)[block]], axis=1, dtype=np.int64)
        inside = byte % BLOCK
        whole = np.where(inside > 0, own[np.arange(len(at)), inside - 1], 0)
        return self.before[block] + whole + _POPCOUNT[self.packed[byte] & (0xFF00 >> (at & 7) & 0xFF).astype(np.uint8)]

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the one that has k ones before it (k below total): the block by the directory, then the byte, then the bit."""
        block = np.searchsorted(self.before, k, "right") - 1
        left = k - self.before[block]
        own = np.cumsum(_POPCOUNT[self.packed.reshape(-1, BLOCK)[block]], axis=1, dtype=np.int64)
        byte = (own <= left[:, None]).sum(axis=1)
        left = left - np.where(byte > 0, own[np.arange(len(k)), byte - 1], 0)
        bits = np.cumsum(np.unpackbits(self.packed[block * BLOCK + byte][:, None], axis=1), axis=1)
        return 8 * (block * BLOCK + byte) + (bits <= left[:, None]).sum(axis=1)


def _starts(data: np.ndarray, places: np.ndarray) -> tuple[Bits, Bits]:
    """Bitvectors over UTF-8 bytes: where tokens start and where characters start."""
    letter = _LETTER[data]
    char = (data & 0xC0) != 0x80
    token = char.copy()
    token[1:] &= ~(letter[1:] & letter[:-1])
    heads = places[:-1][np.diff(places) > 0]
    token[heads] = True  # a letter that opens a text goes on with nothing
    return Bits(token), Bits(char)


def _draws(doc_id: Column) -> list[Column]:
    """Four numbers of 32 bits from the sha256 of the id; a null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"_h{k + 1}") for k in range(4)]


_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _cut(part: pa.RecordBatch, plain_percent: int, suffix_first: int) -> pa.RecordBatch:
    """One slice of (doc_id, text, h1 to h4)."""
    data, places = utf8(part.column(1))
    rows = len(places) - 1
    h = [part.column(2 + k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)]
    tokens, chars = _starts(data, places)
    first = tokens.rank(places)  # tokens before each text, and in all
    n = np.diff(first)
    x, y = h[0] % (n + 1), h[1] % (n + 1)
    low, high = first[:-1] + np.minimum(x, y), first[:-1] + np.maximum(x, y)

    def place(k):
        """The byte where token k of all starts, or where its text ends if it is the next one's."""
        inside = k < first[1:]
        out = places[1:].copy()
        out[inside] = tokens.select(k[inside])
        return out

    a, b = place(low), place(high)
    size = [chars.rank(at) for at in (places[:-1], a, b)]
    whole = data.tobytes()
    forms, outputs, prefix_chars, middle_chars = [], [], [], []
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    for r in range(rows):
        start, end = int(places[r]), int(places[r + 1])
        text = whole[start:end]
        if not text or h[2][r] % 100 >= 100 - plain_percent or any(m in text for m in marks):
            forms.append("plain")
            outputs.append(text)
            prefix_chars.append(None)
            middle_chars.append(None)
            continue
        prefix, middle, suffix = text[: a[r] - start], text[a[r] - start : b[r] - start], text[b[r] - start :]
        spm = h[3][r] % 100 < suffix_first
        forms.append("spm" if spm else "psm")
        outputs.append(b"".join((marks[1], suffix, marks[0], prefix, marks[2], middle) if spm else (marks[0], prefix, marks[1], suffix, marks[2], middle)))
        prefix_chars.append(int(size[1][r] - size[0][r]))
        middle_chars.append(int(size[2][r] - size[1][r]))
    columns = [part.column(0), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix_chars, pa.int64()), pa.array(middle_chars, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, plain_percent: int = PLAIN_PERCENT, suffix_first: int = SUFFIX_FIRST_PERCENT) -> DataFrame:
    """A row per row of docs: doc_id, n (tokens), form, prefix_chars, middle_chars, output.

    Tokens are runs of ASCII letters and single other characters. Null and empty texts have no token and stay plain with an empty
    output; a null id draws like an empty one; repeated rows stay, equal ids draw alike; columns other than doc_id and text
    aren't read. A narrow map over record batches: a task holds about SLICE_BYTES of text, or one longer text, and its bitvectors.
    """

    def run(batches):
        for part in slices(batches):
            yield _cut(part, plain_percent, suffix_first)

    ids = F.col("doc_id").cast("long")
    return docs.select(ids.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *_draws(ids)).mapInArrow(run, _OUT)


def restored(output: Column, form: Column) -> Column:
    """The exact text from an output and its form. No marker is part of the text, so the first of each kind ends its part."""
    body = F.substr(output, F.lit(4))

    def parts(first: str, second: str):
        one = F.substring_index(body, first, 1)
        rest = F.substr(body, F.length(one) + 4)
        two = F.substring_index(rest, second, 1)
        return one, two, F.substr(rest, F.length(two) + 4)

    p, s, m = parts(SUFFIX, MIDDLE)
    s2, p2, m2 = parts(PREFIX, MIDDLE)
    return F.when(form == "psm", F.concat(p, m, s)).when(form == "spm", F.concat(p2, m2, s2)).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """fill_in_middle with sha256 digests of the output and of the text rebuilt from it."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    made = fill_in_middle(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: The same by lists of tokens, in DuckDB SQL.
ORACLE = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    t AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS w, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
      CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
    c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b FROM t),
    p AS (SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
      coalesce(list_aggregate(w[1:a], 'string_agg', ''), '') AS pre, coalesce(list_aggregate(w[a + 1:b], 'string_agg', ''), '') AS mid, coalesce(list_aggregate(w[b + 1:n], 'string_agg', ''), '') AS suf FROM c)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
    FROM p
"""
