"""Best-two-fit packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathweave.llm.scratch import save
from pathweave.llm.words import Words, chunks, tidy, utf8
from pathweave.session import ship_package

SEQUENCE = 2048
#: The id that ends each document.
END_ID = 0
#: Words that a worker remembers the ids of (about 50 bytes each); full, it starts anew.
MEMO_WORDS = 1_200_000


def tokenizer_path() -> str:
    """The production vocabulary's file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Tokenizer:
    """Ids of whole texts; a word that was met before is not tokenised again.

    A word between white space has the same ids wherever it stands, as long as its text has no
    characters beyond U+023F and no control characters; other texts go through the library
    whole.
    """

    def __init__(self, path: str):
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self._clear()

    def _clear(self) -> None:
        # sorted hashes and, for each, the word's number; by number, where its ids lie in flat
        self.hash, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, at: np.ndarray, words: list[str]) -> None:
        found = [e.ids for k in range(0, len(words), 2048) for e in self.library.encode_batch(words[k : k + 2048], add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        self.hash = np.insert(self.hash, at, hashes)
        self.number = np.insert(self.number, at, len(self.size) + np.arange(len(found)))
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(size.sum()))])

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        data, offsets = utf8(column)
        words = Words(data, offsets)
        odd = (data >= 0xC9) | _CONTROL[data]
        odd[:-1] |= (data[:-1] == 0xC2) & (data[1:] <= 0xA0)
        count = np.concatenate([[0], np.cumsum(odd)])
        whole = count[offsets[1:]] > count[offsets[:-1]]
        kept = np.repeat(~whole, np.diff(words.first))
        start, end = words.start[kept], words.end[kept]
        uniq, where, inverse = np.unique(words.hash[kept], return_index=True, return_inverse=True)
        if len(self.hash) + len(uniq) > MEMO_WORDS:
            self._clear()
        at = np.searchsorted(self.hash, uniq)
        new = np.ones(len(uniq), dtype=bool)
        inside = at < len(self.hash)
        new[inside] = self.hash[at[inside]] != uniq[inside]
        if new.any():
            raw = words.data.tobytes()
            self._learn(uniq[new], at[new], [raw[start[i] : end[i]].decode() for i in where[new]])
        token = self.number[np.searchsorted(self.hash, uniq)][inverse]
        size = self.size[token]
        after = np.cumsum(size)
        total = int(after[-1]) if len(after) else 0
        ids = self.flat[np.repeat(self.first[token] - (after - size), size) + np.arange(total)]
        bounds = np.concatenate([[0], after])[np.concatenate([[0], np.cumsum(kept)])[words.first]]
        out = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for i in np.flatnonzero(whole):
            out[i] = np.array(self.library.encode(column[i].as_py(), add_special_tokens=False).ids, dtype=np.uint32)
        return out


_tokenizers: dict[str, Tokenizer] = {}


def worker_tokenizer(path: str) -> Tokenizer:
    """The worker's tokenizer: one for all its tasks, and so are the words it remembers."""
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path)
    return _tokenizers[path]


_CONTROL = np.zeros(256, dtype=bool)
_CONTROL[[*range(9), *range(14, 32), 127]] = True


def tokenize_pieces(docs: DataFrame, path: str | None = None, length: int = SEQUENCE) -> DataFrame:
    """``doc_id, piece, start, length, ids``: each row's whole text as ids, then ``END_ID``.

    A document longer than ``length`` ids is cut into pieces of ``length``, the last of which
    may be shorter.  Null and empty texts are the end alone.  Repeated rows give their pieces
    again; an empty table gives none.
    """
    path = path or tokenizer_path()
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    end = np.array([END_ID], dtype="<u4").tobytes()
    schema = "doc_id long, piece int, start long, length long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tokenizer(path)
        for batch in chunks(batches):
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), tokenizer.encode(batch.column(1)), strict=True):
                ids = ids.astype("<u4").tobytes() + end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append((doc, k, at // 4, len(part) // 4, part))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    ship_package(source.sparkSession)
    return source.mapInArrow(tidy(run), schema)


def plan_bins(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[dict[int, int], int]]:
    """Bins as ({length: times}, number of such bins) that hold ``counts`` pieces by length.

    Best-two-fit: a bin is filled greedily, the longest piece that fits first; then its
    smallest piece gives way to the two unpacked pieces that fit the widened gap best, if they
    fill more.  Equal bins are made together, so the work depends on ``size`` and not on the
    number of pieces.
    """
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    bins = []
    while left.any():
        content: dict[int, int] = {}

        def take(length: int, n: int, content: dict[int, int] = content) -> None:
            content[length] = content.get(length, 0) + n
            left[length] -= n

        gap = size
        while gap and (fits := np.flatnonzero(left[: gap + 1])).size:
            length = int(fits[-1])
            n = min(gap // length, int(left[length])) if content else 1
            take(length, n)
            gap -= n * length
        if gap and len(content) > 1 or sum(content.values()) > 1 and gap:
            smallest = min(content)
            room = gap + smallest
            # the largest unpacked length up to x, for each x
            best = np.maximum.accumulate(np.where(left > 0, np.arange(size + 1), 0))[: room + 1]
            first = np.flatnonzero(left[: room + 1])
            second = best[room - first]
            alone = (second == first) & (left[first] < 2)
            if alone.any():
                for i in np.flatnonzero(alone):
                    lower = np.flatnonzero(left[: first[i]])
                    second[i] = lower[-1] if lower.size else 0
            both = np.where(second > 0, first + second, 0)
            if both.size and both.max() > smallest:
                i = int(both.argmax())
                content[smallest] -= 1
                left[smallest] += 1
                if not content[smallest]:
                    del content[smallest]
                take(int(first[i]), 1)
                take(int(second[i]), 1)
        more = min(int(left[length]) // n for length, n in content.items())
        for length, n in content.items():
            left[length] -= more * n
        bins.append((content, more + 1))
    return bins


def _slots(bins: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Where the pieces of a length go by rank: from rank ``rank`` on, to the sequences from
    ``sequence`` on, at ``offset``."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for content, times in bins:
        offset = 0
        for length in sorted(content, reverse=True):
            for _ in range(content[length]):
                rows.append((length, used.get(length, 0), sequence, offset))
                used[length] = used.get(length, 0) + times
                offset += length
        sequence += times
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 48) + table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def place_pieces(pieces: DataFrame, size: int = SEQUENCE, scope: str = "query") -> DataFrame:
    """The columns of ``pieces`` (``doc_id``, ``piece``, ``length`` from 1 to ``size``, more as
    they are), ``sequence_id`` and ``offset``.

    Only the number of pieces of each length (``size`` numbers at most) comes to the driver.
    The bins for it are planned there, and each piece finds its place by its rank among the
    pieces of its length: ranks are counted in each part that wrote pieces, and the parts'
    numbers are summed up.  Equal pieces and repeated rows get places of their own.  No pieces,
    no sequences.
    """
    names = [f.name for f in pieces.schema]
    stored = save(pieces.withColumn("_part", F.spark_partition_id()), "pieces", scope)
    parts = stored.groupBy("_part", "length").agg(F.count("*").alias("_n"))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots = _slots(plan_bins(counts, size))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = stored.withColumn("_rank", F.row_number().over(Window.partitionBy("_part", "length").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(bases, ["_part", "length"]).select(*names, (F.col("_base") + F.col("_rank")).alias("_rank"))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(slots["key"], (length << 48) + rank, side="right") - 1
            sequence = slots["sequence"][at] + rank - slots["rank"][at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(slots["offset"][at])], [*names, "sequence_id", "offset"])

    ship_package(ranked.sparkSession)
    return ranked.mapInArrow(tidy(run), schema)


def with_crc(pieces: DataFrame) -> DataFrame:
    """``ids`` gives way to ``ids_crc32``, the checksum of its bytes."""
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))


def pack(docs: DataFrame, scope: str = "query") -> DataFrame:
    """The contract's rows for ``docs``: every piece with its sequence and offset."""
    return place_pieces(with_crc(tokenize_pieces(docs)), scope=scope)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
