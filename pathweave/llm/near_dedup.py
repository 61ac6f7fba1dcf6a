"""Near duplicates: MinHash signatures, banding, verification, star components."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.llm.scratch import save
from pathweave.llm.words import Words, chunks, mix, tidy, utf8
from pathweave.session import ship_package

SHINGLE = 5
#: A link needs 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
#: 32 bands of 4 minima: two texts at similarity 0.75 share no band with probability 5e-6.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Minima that must agree before full sets are compared; at similarity 0.75, 96 of 128 agree on
#: average, and fewer than 70 with a probability below 1e-7.
LEAST_AGREEMENT = 70
#: Bytes of shingles and minima in a block of a bucket's members.
BLOCK_BYTES = 2 << 20
#: The largest bitmap of ids that workers get (16 MB).
MAX_BITS = 1 << 27

_draw = np.random.RandomState(11)
_A = (_draw.randint(0, 1 << 31, HASHES).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _draw.randint(0, 1 << 31, HASHES).astype(np.uint32) * np.uint32(2) + _draw.randint(0, 2, HASHES).astype(np.uint32)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Per text, the sorted distinct 64-bit hashes of its shingles."""
    words = Words(*utf8(column))
    n = np.diff(words.first)
    hashes, place = words.windows(SHINGLE)
    owner = np.searchsorted(words.first, place, side="right") - 1
    bounds = np.searchsorted(owner, np.arange(len(n) + 1))
    sets = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    for size in range(1, SHINGLE):
        short = np.flatnonzero(n == size)
        if len(short):
            hashes, place = words.windows(size)
            at = np.searchsorted(place, words.first[short])
            for text, h in zip(short, mix(hashes[at] + np.uint64(size)), strict=True):
                sets[text] = np.array([h], dtype=np.uint64)
    return sets


def signature(values: np.ndarray) -> np.ndarray:
    """The minima of the universal hashes a * x + b over a set."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 2048):
        best = np.minimum(best, (x[at : at + 2048, None] * _A + _B).min(axis=0))
    return best


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set_digest, signature`` of every row; the last two are null for a
    text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            sets = shingle_sets(batch.column(1))
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            minima = [signature(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(minima, pa.binary())],
                ["doc_id", "n_shingles", "set_digest", "signature"],
            )

    ship_package(docs.sparkSession)
    return _texts(docs).mapInArrow(tidy(run), "doc_id long, n_shingles long, set_digest binary, signature binary")


def _bands(reps: DataFrame) -> DataFrame:
    """A row for each representative and ``band``; ``key`` is the hash of the band's minima."""
    keys = [F.xxhash64(F.lit(i), F.substring(F.col("signature"), 4 * ROWS * i + 1, 4 * ROWS)) for i in range(BANDS)]
    return reps.select("rep", F.col("n_shingles").cast("int").alias("n_shingles"), F.posexplode(F.array(*keys)).alias("band", "key"))


Batches = Iterator[pa.RecordBatch]


def _among(frame: DataFrame, column: str, ids: DataFrame, then: Callable[[Batches], Batches] | None = None, schema: str = "") -> DataFrame:
    """The rows of ``frame`` whose ``column`` is in ``ids`` (``id``), and maybe a few others.

    A bitmap of hashed ids of ``MAX_BITS`` bits at most drops most other rows before they are
    shuffled; if there are too many ids for it, the rows are semi-joined.  ``then`` maps the
    kept batches to ``schema`` in the same worker: a step of its own would take a second one.
    """
    n = ids.count()
    bits = 1 << max(16, (16 * n).bit_length())
    if bits > MAX_BITS:
        kept = frame.join(ids.withColumnRenamed("id", column), column, "left_semi").select(frame.columns)
        return kept if then is None else kept.mapInArrow(tidy(then), schema)
    place = F.pmod(F.xxhash64(F.col("id")), F.lit(bits))
    words = ids.select(place.alias("at")).selectExpr("at div 64 AS w", "shiftleft(1L, int(at % 64)) AS b")
    found = words.groupBy("w").agg(F.expr("bit_or(b)").alias("b")).toArrow()
    bitmap = np.zeros(bits // 64, dtype=np.int64)
    bitmap[found.column("w").to_numpy()] = found.column("b").to_numpy()
    names = frame.columns

    def kept(batches: Batches) -> Batches:
        for batch in batches:
            at = batch.column(len(names)).to_numpy()
            keep = pa.array((bitmap[at >> 6] >> (at & 63)) & 1 == 1)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in range(len(names))], names)

    def run(batches: Batches) -> Batches:
        return kept(batches) if then is None else then(kept(batches))

    hashed = frame.where(F.col(column).isNotNull()).select(*names, F.pmod(F.xxhash64(F.col(column)), F.lit(bits)).alias("_at"))
    return hashed.mapInArrow(tidy(run), schema or frame.schema)


def _agree(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of which enough minima agree."""
    side = lambda c: signatures.select(F.col("rep").alias(c), F.col("signature").alias(f"s{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, HASHES) for i in (2, 3))
            keep = pa.array((sa == sb).sum(axis=1) >= LEAST_AGREEMENT)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], ["a", "b"])

    return joined.mapInArrow(tidy(run), "a long, b long")


def _links(docs: DataFrame, pairs: DataFrame, scope: str) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            sets = [s.tobytes() for s in shingle_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= SIMILARITY * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["a", "b"])

    sets = save(_among(_texts(docs), "doc_id", ids, read, "doc_id long, shingles binary"), "shingles", scope)
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"s{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")
    return joined.mapInArrow(tidy(compare), "a long, b long").distinct()


def components(edges: DataFrame, scope: str = "query") -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a``, ``b``, longs) but the smallest
    node of its component, by alternating large-star and small-star until nothing changes.

    A star's centre may have any number of neighbours: minima are aggregated before the
    shuffle and written, and Spark splits a large centre's rows in the joins.  Loops, repeated
    and reversed edges and rows with a null make no difference; no edges, no nodes.
    """
    star = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    star, before = save(star, "edges", scope), None
    while True:
        state = tuple(star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            return star.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
        both = star.unionAll(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = save(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least", scope)
        # large-star: a node's larger neighbours go to the least of the node and its neighbours
        large = save(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large", scope)
        least = save(large.groupBy("u").agg(F.min("v").alias("m")), "least", scope)
        # small-star: a node and its smaller neighbours go to the least of them
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        star = save(small.select("e.u", "e.v").where("u != v").distinct(), "edges", scope)


def _forest(band: int, left: np.ndarray, right: np.ndarray, component: np.ndarray, signatures: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between members ``left`` and ``right`` that each bring two components together.

    A pair is compared in the first band that it shares, if enough minima agree, and a link is
    confirmed on the full sets.  So there are fewer links than members, whatever the pairs.
    """
    n = np.array([len(s) for s in sets])
    shingles = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start = np.cumsum(n) - n
    marked = np.zeros(int(shingles.max(initial=-1)) + 1, dtype=bool)
    label, links = component.copy(), []
    for x in left:
        y = right[right > x] if left is right else right
        y = y[(label[y] != label[x]) & (100 * np.minimum(n[y], n[x]) >= SIMILARITY * np.maximum(n[y], n[x]))]
        if not len(y):
            continue
        same = signatures[y] == signatures[x]
        y = y[(same.sum(axis=1) >= LEAST_AGREEMENT) & (same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band)]
        if not len(y):
            continue
        marked[shingles[start[x] : start[x] + n[x]]] = True
        first = np.cumsum(n[y]) - n[y]
        both = np.add.reduceat(marked[shingles[np.repeat(start[y] - first, n[y]) + np.arange(n[y].sum())]], first, dtype=np.int64)
        marked[shingles[start[x] : start[x] + n[x]]] = False
        for z in y[100 * both >= SIMILARITY * (n[x] + n[y] - both)]:
            if label[z] != label[x]:
                links.append((int(x), int(z)))
                label[label == label[z]] = label[x]
    return links


def _cross_links(docs: DataFrame, shared: DataFrame, labels: DataFrame, reps: DataFrame, scope: str) -> DataFrame:
    """Links ``a, b`` between different components of one bucket that the first round left open.

    The first round compared each member of a bucket with its least member only.  The members
    of a bucket that still holds several components are dealt into blocks of about
    ``BLOCK_BYTES`` of shingles, and a task compares two blocks at a time by :func:`_forest`:
    it holds no more than these, whatever the bucket's size, and gives out fewer links than it
    has members, never the pairs.  ``shared`` has the buckets of several members.
    """
    rows = shared.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    rows = save(rows, "labelled", scope)
    size = F.sum(F.lit(8) * F.col("n_shingles") + 4 * HASHES)
    open_ = rows.groupBy("band", "key").agg(size.alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    open_ = open_.where("lo != hi").select("band", "key", F.ceil(F.col("size") / BLOCK_BYTES).cast("int").alias("blocks"))
    members = save(rows.join(open_, ["band", "key"]), "open", scope)
    ids = save(members.select(F.col("rep").alias("id")).distinct(), "open-ids", scope)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            sets = [s.tobytes() for s in shingle_sets(batch.column(1))]
            digests = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], ["set_digest", "shingles"])

    sets = _among(_texts(docs), "doc_id", ids, read, "set_digest binary, shingles binary")
    sets = sets.groupBy("set_digest").agg(F.first("shingles").alias("shingles"))
    sets = save(sets.join(reps, "set_digest").select("rep", F.col("n_shingles").cast("int").alias("n_shingles"), "signature", "shingles"), "open-sets", scope)
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = ["band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left")]
    dealt = dealt.join(sets, ["rep", "n_shingles"]).select(*group, "rep", "component", "signature", "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.table({})
        for batch in itertools.chain(batches, [None]):
            table = held if batch is None else pa.Table.from_batches([batch]) if not held.num_rows else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not table.num_rows:
                continue
            group = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("band", "key", "i", "j")])
            edges = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1).tolist(), table.num_rows]
            # the last group may go on in the next batch
            held = table.slice(0, 0) if batch is None else table.slice(edges[-2])
            found: list[list[int]] = [[], []]
            for at, end in itertools.pairwise(edges if batch is None else edges[:-1]):
                part, (band, _, i, j) = table.slice(at, end - at), group[:, at]
                rep, component, left = (part.column(c).to_numpy() for c in ("rep", "component", "left"))
                signatures = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)
                sets = [np.frombuffer(s, np.uint64) for s in part.column("shingles").to_pylist()]
                one, two = np.flatnonzero(left), np.flatnonzero(~left)
                for x, y in _forest(int(band), one, one if i == j else two, component, signatures, sets):
                    found[0].append(rep[x])
                    found[1].append(rep[y])
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], ["a", "b"])

    return dealt.repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j").mapInArrow(tidy(compare), "a long, b long")


def near_duplicates(docs: DataFrame, scope: str = "query") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs`` (``doc_id``, ``text``).

    A row's set holds the distinct shingles of ``SHINGLE`` words of its whole text (A-Z
    lower-cased), or the whole sequence of fewer words.  Rows with similar sets are linked;
    ``component_id`` is the smallest doc_id that links reach.  Equal sets are one
    representative; representatives that share a band's minima are compared with the least
    one of their bucket, by signature and then by full sets; buckets that still hold several
    components are compared in full, in blocks.  A text of any length is one set; its worker
    holds 16 bytes a word or so while it is hashed.  Null and empty texts have an empty set and no links.  Rows
    that repeat a doc_id are one document with the links of all its texts.  Rows without
    doc_id are linked with nothing and have no component.  An empty table gives none.
    """
    found = save(sketches(docs), "sketches", scope)
    full = found.where("doc_id IS NOT NULL AND n_shingles > 0")
    reps = full.groupBy("set_digest").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"))
    reps = save(reps, "representatives", scope)
    members = full.select("doc_id", "set_digest").join(reps.select("set_digest", "rep"), "set_digest").select("doc_id", "rep")
    rows = _bands(reps)
    leaders = rows.groupBy("band", "key").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1").select("band", "key", "a")
    leaders = save(leaders, "leaders", scope)
    # most buckets have one member; from here on only the others are carried
    shared = save(rows.join(leaders, ["band", "key"]), "shared", scope)
    signatures = save(_among(reps.select("rep", "signature"), "rep", shared.select(F.col("rep").alias("id")).distinct()), "signatures", scope)
    pairs = shared.where("a != rep").select("a", F.col("rep").alias("b")).distinct()
    agreed = save(_agree(save(pairs, "pairs", scope), signatures), "agreed", scope)
    links = save(_links(docs, agreed, scope), "links", scope)
    # a doc_id with several texts joins their representatives
    several = save(members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a != z").select("doc_id", "a"), "several", scope)
    links = links.unionAll(members.join(several, "doc_id").select("a", F.col("rep").alias("b")))
    labels = components(links, scope)
    more = save(_cross_links(docs, shared.drop("a"), labels, reps, scope), "cross-links", scope)
    if more.limit(1).count():
        labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more), scope)
    named = reps.select("set_digest", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    named = save(named.select("set_digest", F.coalesce("component", "rep").alias("component")), "components", scope)
    # texts without words would all meet in one task
    out = found.where("set_digest IS NOT NULL").join(named, "set_digest", "left")
    out = out.unionByName(found.where("set_digest IS NULL").withColumn("component", F.lit(None).cast("long")))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, scope: str = "query") -> DataFrame:
    """The documents that stay: the smallest doc_id of each component, with their own columns.
    Rows without doc_id stay."""
    gone = near_duplicates(docs, scope).where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), r AS (
  SELECT doc_id, doc_id AS reached FROM n
  UNION
  SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached
), m AS (
  SELECT doc_id, min(reached) AS least FROM r GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.least, d.doc_id) AS component_id, d.doc_id = coalesce(m.least, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
