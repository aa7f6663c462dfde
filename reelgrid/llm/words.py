"""Places of words in a task's own word list, and labelled samples of bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGES = bytes(b for b in range(33, 127) if not chr(b).isalpha())


class WordIndex:
    """Numbers the words of texts in order of first sight."""

    def __init__(self):
        self.place: dict[bytes, int] = {}

    def __len__(self):
        return len(self.place)

    def look_up(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Places of all words, number of words of each text, and the words not seen before."""
        place, new, at = self.place, [], []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            words = text.split()
            counts[k] = len(words)
            for w in words:
                n = place.get(w)
                if n is None:
                    n = place[w] = len(place)
                    new.append(w)
                at.append(n)
        return np.array(at, np.int64), counts, new


def grown(array: np.ndarray, rows: int) -> np.ndarray:
    """The array with room for ``rows`` rows at least."""
    if rows <= len(array):
        return array
    more = np.zeros((max(rows, 2 * len(array)) - len(array), *array.shape[1:]), array.dtype)
    return np.concatenate([array, more])


def bare(word: bytes) -> bytes:
    """A-Z lower-cased, ASCII signs and digits gone from both ends."""
    return word.lower().strip(EDGES)


def remainder(doc_id, of: int):
    """crc32 of the id as text, modulo ``of``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % of, F.lit(-1))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, taught, per_class: int,
                    doc_id: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` with their label as ``taught_label``: of each class at most
    ``per_class`` ids, those least by hash among the ids ``taught`` admits.

    An id labelled both ways, a null label or id, and an id with several rows teach nothing
    or once. The picked ids are few by that bound and are broadcast.
    """
    known = (labels.where(taught & F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
             .groupBy(F.col(doc_id).alias("taught_id"))
             .agg(F.min(label).alias("taught_label"), F.max(label).alias("most"))
             .where("taught_label = most").drop("most"))
    picked = None
    for value in (0, 1):
        part = (known.where(F.col("taught_label") == value)
                .orderBy(F.xxhash64("taught_id"), "taught_id").limit(per_class))
        picked = part if picked is None else picked.unionByName(part)
    return (docs.join(F.broadcast(picked), docs[doc_id] == picked["taught_id"])
            .dropDuplicates(["taught_id"]))
