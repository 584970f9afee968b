"""Substring dedup: seed and extend on winnowed anchors over words.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes if a window of ``window`` consecutive words of one document
covers it and the same word sequence starts anywhere else too, in the same or another document; so nothing is kept as
the one copy. Windows are judged on the input. Documents with fewer words than a window lose nothing.

Cases: a null or empty text has no words; a text of any length is processed whole; repeated rows (equal doc_id or
text) are documents like any other, so their windows repeat; a null doc_id stays null; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import _chunks as C
from ._repeats import repeated
from ._runtime import table
from ._text import SPACE, Texts, word_hashes, words

WINDOW, GRAM = 35, 10
SCHEMA = "doc_id long, kept string, n_words long, n_removed long"
DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _units(texts: Texts):
    ws, we, offsets = words(texts.data, texts.offsets, SPACE_INSIDE)
    return word_hashes(texts.data, ws, we), offsets, (ws, we)


SPACE_INSIDE = ~SPACE


def _finish(digest: bool):
    def finish(chunk: C.Chunk, _, offsets: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
        kept, removed = [], []
        for i in range(len(chunk.texts)):
            w = chunk.texts.bytes(i).split()
            g = gone[offsets[i] : offsets[i + 1]]
            removed.append(int(g.sum()))
            if removed[-1]:
                w = [x for x, r in zip(w, g.tolist(), strict=True) if not r]
            text = b" ".join(w)
            kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8", "replace"))
        ids, n, r, k = chunk.id_column(), pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())
        columns = [ids, n, r, k] if digest else [ids, k, n, r]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in (DIGEST if digest else SCHEMA).split(", ")])

    return finish


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """One row per document: doc_id, kept (the words left, joined by one space), n_words, n_removed.

    ``digest`` gives kept_sha256 in place of the text.
    """
    return repeated(docs, _units, _finish(digest), DIGEST if digest else SCHEMA, window, gram, False, 0.2)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), digest=True)
