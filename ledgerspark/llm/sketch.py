"""Operator 10: threshold-scaled sketches of word shingles.

Every hash of a five-word shingle below a fixed fraction of the hash range is kept, so a sketch grows with its text,
the union of two sketches is the sketch of both texts, and the share of the smaller sketch found in the larger one
estimates how much of the smaller text the larger one contains, however unequal they are.

A fingerprint is text: 16 hexadecimal digits that identify the whole text, a colon, and the kept hashes in ascending
order, 48 bits each, in base 64. Texts too short to keep a hash are compared by the identifying digits alone.

Defined results: a null text is an empty text; a text with fewer words than a shingle has one shingle of all its
words, and a text without words has none; repeated rows are fingerprinted each and follow one another; a null id
sorts before all others; ids are whole numbers or text of them, and others end in an error of the cast, as the order of
documents is that of numbers; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import BoundedCache, arrow_rows, fields

#: Share of all shingle hashes that is kept.
FRACTION = 0.25
SHINGLE_WORDS = 5
#: Documents in a range of ids, and the most ranges whose bounds the driver holds. Ranges are sorted and streamed, so larger ones are fine.
RANGE_ROWS, MOST_RANGES = 512, 65_536
LOWEST_ID = -(2**63)

_STEP = np.uint64(0x9E3779B97F4A7C15)
_word_hash = BoundedCache(xxhash.xxh64_intdigest)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly; a bijection."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_hashes(text: str, words: int = SHINGLE_WORDS) -> np.ndarray:
    """One 64-bit hash for each run of ``words`` words, repeats included."""
    found = text.encode().split()
    if not found:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(_word_hash.__getitem__, found), np.uint64, len(found))
    span = min(words, len(found))
    with np.errstate(over="ignore"):
        total = np.full(len(found) - span + 1, span, np.uint64)
        for place in range(span):
            total = total * _STEP + each[place : place + len(total)]
        return mixed(total)


def sketch(text: str, fraction: float = FRACTION, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct 48-bit shingle hashes below ``fraction`` of their range, ascending."""
    hashes = shingle_hashes(text, words) >> np.uint64(16)
    return np.unique(hashes[hashes < np.uint64(int(fraction * 2**48))])


def merged(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.union1d(left, right)


def containment(left: np.ndarray, right: np.ndarray) -> float:
    """Share of the smaller sketch that the other holds; 0 if either is empty."""
    smaller = min(len(left), len(right))
    return len(np.intersect1d(left, right, assume_unique=True)) / smaller if smaller else 0.0


def as_text(text: str, kept: np.ndarray) -> str:
    body = kept.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()
    return f"{xxhash.xxh64_hexdigest(text)}:{base64.b64encode(body).decode()}"


def parsed(fingerprint: str) -> tuple[str, np.ndarray]:
    name, _, body = fingerprint.partition(":")
    data = np.frombuffer(base64.b64decode(body), np.uint8).reshape(-1, 6)
    padded = np.zeros((len(data), 8), np.uint8)
    padded[:, 2:] = data
    return name, padded.view(">u8").ravel().astype(np.uint64)


def likeness(left: str, right: str) -> float:
    """Likeness of two fingerprints: 1 for one and the same text, else the containment of their sketches."""
    (name, kept), (other_name, other) = parsed(left), parsed(right)
    return 1.0 if name == other_name else containment(kept, other)


def fingerprints(
    documents: DataFrame, fraction: float = FRACTION, words: int = SHINGLE_WORDS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The fingerprint of each whole text. Narrow: no shuffle."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        texts = [text or "" for text in rows["text"]]
        return {"doc_id": rows["doc_id"], "fingerprint": [as_text(t, sketch(t, fraction, words)) for t in texts]}

    kind = documents.schema[id_column].dataType.simpleString()
    return arrow_rows(fields(documents, doc_id=id_column, text=text_column), f"doc_id {kind}, fingerprint string", work)


def in_id_ranges(documents: DataFrame) -> DataFrame:
    """Rows (range, tail, doc_id, text) of an input (doc_id, text), dealt by ranges of ids and sorted within them.

    The last row of a range, marked as tail, is a copy of the document that follows the range; the first document
    follows the last one. Texts are shuffled once; the driver holds two integers a range.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST_ID))
    ids = documents.select(key.alias("key"))
    rows = ids.count()
    ranges = max(1, min(MOST_RANGES, -(-rows // RANGE_ROWS)))
    bounds = np.zeros(0, np.int64)
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        bounds = np.unique(np.array(ids.select(F.percentile_approx("key", shares, 20 * ranges)).first()[0], dtype=np.int64))

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy()).astype(np.int32))

    firsts = ids.groupBy(range_of("key").alias("range")).agg(F.min("key").alias("key")).collect()
    heads = np.array(sorted(row.key for row in firsts), dtype=np.int64)
    before = np.roll(np.array(sorted(row.range for row in firsts), dtype=np.int32), 1)

    @F.pandas_udf("array<struct<range:int,tail:boolean>>")
    def places(keys: pd.Series) -> pd.Series:
        values = keys.to_numpy()
        own = np.searchsorted(bounds, values)
        head = np.minimum(np.searchsorted(heads, values), max(len(heads) - 1, 0))
        return pd.Series(
            [
                [{"range": int(r), "tail": False}] + ([{"range": int(before[h]), "tail": True}] if heads[h] == value else [])
                for value, r, h in zip(values, own, head)
            ]
        )

    dealt = documents.withColumn("place", F.explode(places(key)))
    rows_in_ranges = dealt.select("place.range", "place.tail", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows_in_ranges.repartition("range").sortWithinPartitions("range", "tail", "doc_id", "text")


def edited_text(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as many first characters of ``following``."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def compare_with_edits(
    documents: DataFrame, fraction: float = FRACTION, words: int = SHINGLE_WORDS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Fingerprint each text and its edited form, and compare the text with that form and with the next document."""
    source = fields(documents, doc_id=id_column, text=text_column)
    kind = documents.schema[id_column].dataType.simpleString()
    schema = StructType.fromDDL(
        f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double"
    )
    arrow = to_arrow_schema(schema)

    def row(doc_id, text: str, kept: np.ndarray, following: str, next_kept: np.ndarray) -> tuple:
        edited = edited_text(text, following)
        edited_kept = kept if edited == text else sketch(edited, fraction, words)
        return (
            doc_id,
            len(text),
            hashlib.sha256(edited.encode()).hexdigest(),
            as_text(text, kept),
            as_text(edited, edited_kept),
            1.0 if edited == text else containment(kept, edited_kept),
            1.0 if following == text else containment(kept, next_kept),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous = None
        for batch in batches:
            out = []
            for place, tail, doc_id, text in zip(*(column.to_pylist() for column in batch.columns)):
                if previous and previous[0] == place and previous[1]:
                    continue  # a second copy of the document after the range
                kept = sketch(text, fraction, words)
                if previous and previous[0] == place:
                    out.append(row(*previous[2:], text, kept))
                previous = (place, tail, doc_id, text, kept)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return in_id_ranges(source).mapInArrow(run, schema)
