"""Words of Arrow text columns as integer codes, without a Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))

#: Bytes to lower-case bytes; everything that parts words becomes a space.
ALNUM_WORDS = bytes(
    b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32
    for b in range(256)
)
#: The same with only space and 0x09 to 0x0D between words.
SPACED_WORDS = bytes(
    32 if b == 32 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)


def filled(texts: pa.Array | pa.ChunkedArray) -> pa.StringArray:
    """Texts as one Arrow string array, null as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.string()), "")


def translated(texts: pa.StringArray, table: bytes) -> pa.StringArray:
    """Every byte replaced by the table's; the table keeps bytes from 0x80 on."""
    if len(texts) == 0:
        return texts
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = bytes(memoryview(data)[ends[0] : ends[-1]]) if data is not None else b""
    return pa.StringArray.from_buffers(
        len(texts), pa.py_buffer((ends - ends[0]).astype(np.int32)), pa.py_buffer(raw.translate(table))
    )


def word_codes(texts: pa.StringArray, table: bytes) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """Codes of all words in order, words per text, and the distinct words the codes point to."""
    lists = pc.split_pattern(translated(texts, table), " ")
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    per_text = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    empty = pc.index(coded.dictionary, "").as_py() if len(coded.dictionary) else -1
    if empty >= 0:
        keep = codes != empty
        owner = np.repeat(np.arange(len(texts)), per_text)[keep]
        codes, per_text = codes[keep], np.bincount(owner, minlength=len(texts))
    return codes, per_text.astype(np.int64), coded.dictionary
