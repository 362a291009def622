"""Exact dedup by an extendible-hash index on shared files.

1. Windows. Each task merges equal texts among its own rows, a bounded window at a time, and writes
   one entry a distinct text and window: hash, the best row, the members' ids. A text that makes up
   a third of all rows so shrinks to an entry a window before anything is shuffled.
2. Directory. It starts with one bucket; a bucket over its capacity is split by the next bit of the
   hash and the directory doubles when that bit is new to it. Only byte counts of hash prefixes
   reach the driver, as arrays, and finer ones only for prefixes that are still overfull. It has at most
   2 ** DEEPEST cells, enough for hundreds of terabytes; buckets that are overfull even then cost no memory, as
   owners read them in the order of hashes.
3. Owners. A task owns a range of neighbouring buckets, so a range of keys, cut where their bytes add up to its
   share. It reads entries in the order of buckets and hashes, chains those of one hash and compares their
   bytes, so a collision never merges two texts. It holds one hash's chain at a time.
4. Decisions go back to members in a join on the entry's number, which no key can make hot.

Equal texts are those identical without the characters of ``SPACES``; null counts as empty. The row
with the most code points in the original text stays, then the smallest doc_id (a null after all
others), then the first met; just one row of each class has ``kept``, repeated rows included. An
empty table gives an empty result. Other columns don't matter to the decisions and may have any names:
within the index columns are known by their places."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.llm import common

WINDOW_BYTES = 32 << 20
WINDOW_ROWS = 200_000
#: A bucket's capacity, at most; smaller where that gives each owner task several buckets.
BUCKET_BYTES = 64 << 20
BUCKET_LEAST = 16 << 10
OWNER_BYTES = 128 << 20
BUCKETS_PER_OWNER = 16
#: The directory has at most 2 ** DEEPEST cells, so its broadcast at most 64 MB of rows.
DEEPEST = 22

_DELETED = common.SPACES.encode()
#: Columns of an entry beside the row's own, which are named by place: c0, c1 and so on.
ENTRY = [("rep", "long"), ("h", "long"), ("n_bytes", "long"), ("length", "long"), ("best", "int"), ("members", "array<long>")]
ASSIGNED = "rep long, keep_rep long, keep_id long, group_size long, text_sha256 string"


def normalised(text: bytes) -> bytes:
    return text.translate(None, _DELETED)


def _rank(length: int, doc_id: int | None) -> tuple:
    return -length, doc_id is None, doc_id or 0


def _windows(schema: pa.Schema, text_at: int, id_at: int, length_at: int, payload: int):
    """payload: the first so many columns are the row's own and stay with the best member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        classes: dict[bytes, list] = {}  # normalised text: [rank, best member's place, place of its row, members]
        size = rows = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, classes, size, rows, number
            table = pa.Table.from_batches(held)
            found = list(classes.items())
            own = table.take(pa.array([c[2] for _, c in found], pa.int64())).combine_chunks()
            arrays = [own.column(i).combine_chunks() if own.num_rows else pa.array([], schema.field(i).type) for i in range(payload)]
            arrays += [
                pa.array([(task << 33) + number + k for k in range(len(found))], pa.int64()),
                pa.array([xxhash.xxh3_64_intdigest(t) - (1 << 63) for t, _ in found], pa.int64()),
                pa.array([len(t) for t, _ in found], pa.int64()),
                pa.array([-c[0][0] for _, c in found], pa.int64()),
                pa.array([c[1] for _, c in found], pa.int32()),
                pa.array([c[3] for _, c in found], pa.list_(pa.int64())),
            ]
            number += len(found)
            held, classes, size, rows = [], {}, 0, 0
            return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

        for batch in batches:
            texts, ids, lengths = batch.column(text_at).cast(pa.binary()), batch.column(id_at).to_pylist(), batch.column(length_at).to_pylist()
            held.append(batch)
            for i, text in enumerate(texts):
                t = normalised(text.as_py() or b"")
                rank = _rank(lengths[i], ids[i])
                c = classes.get(t)
                if c is None:
                    classes[t] = [rank, 0, rows + i, [ids[i]]]
                    size += len(t)
                else:
                    if rank < c[0]:
                        c[0], c[1], c[2] = rank, len(c[3]), rows + i
                    c[3].append(ids[i])
            rows += batch.num_rows
            if size >= WINDOW_BYTES or rows >= WINDOW_ROWS:
                yield flush()
        if held:
            yield flush()

    return run


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named by place."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def index_entries(docs: DataFrame, id_at: int, text_at: int) -> DataFrame:
    """The entries of all windows of a table whose columns are named by place, written to the shared folder."""
    spark = docs.sparkSession
    common.ship(spark)
    payload = len(docs.columns)
    schema = T.StructType(docs.schema.fields + T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in ENTRY)).fields)
    arrow = to_arrow_schema(schema)
    read = docs.select("*", F.length(F.coalesce(F.col(f"c{text_at}"), F.lit(""))).cast("long").alias("length"))
    return common.written(read.mapInArrow(common.tidied(_windows(arrow, text_at, id_at, payload, payload)), schema), "entries")


class Directory:
    """Cells of the hash's leading bits; cell -> bucket. A bucket is a prefix of some depth, with its bytes."""

    def __init__(self) -> None:
        self.depths, self.prefixes, self.sizes = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, depth: int, prefixes: np.ndarray, sizes: np.ndarray) -> None:
        self.depths = np.concatenate([self.depths, np.full(len(prefixes), depth)])
        self.prefixes, self.sizes = np.concatenate([self.prefixes, prefixes]), np.concatenate([self.sizes, sizes])

    @property
    def depth(self) -> int:
        return int(self.depths.max())

    def cells(self, owners: int) -> pa.Table:
        """cell, bucket and owner of all 2 ** depth cells; buckets and owners count up along the key range."""
        wide = self.depth - self.depths
        order = np.argsort(self.prefixes << wide)
        sizes = self.sizes[order]
        owner = (np.cumsum(sizes) - sizes) * owners // max(1, sizes.sum())
        bucket = np.repeat(np.arange(len(order)), 1 << wide[order])
        return pa.table({"cell": np.arange(len(bucket)), "bucket": bucket, "owner": np.minimum(owner, owners - 1)[bucket]})


def _prefix(bits: int):
    return F.shiftrightunsigned(F.col("h") + F.lit(0), 64 - bits) if bits else F.lit(0).cast("long")


def directory(entries: DataFrame, capacity: int = BUCKET_BYTES, step: int = 6, deepest: int | None = None) -> Directory:
    """Splits overfull buckets until what each holds beside its heaviest hash fits.

    Entries of one hash can't be parted by more bits; they overflow their bucket, as chains do, so the directory
    doesn't double for their sake."""
    found, spark = Directory(), entries.sparkSession
    deepest = DEEPEST if deepest is None else deepest
    by_hash = entries.groupBy("h").agg(F.sum("n_bytes").alias("n"))
    depth, over = 0, np.zeros(1, np.int64)
    while len(over):
        fine, some = min(depth + step, deepest), by_hash
        if depth:
            some = some.withColumn("over", _prefix(depth)).join(F.broadcast(spark.createDataFrame(pa.table({"over": over}))), "over", "left_semi")
        rows = some.groupBy(_prefix(fine).alias("p")).agg(F.sum("n").alias("n"), F.max("n").alias("top")).toArrow()
        rows = rows.sort_by("p")
        levels = [tuple(rows.column(c).to_numpy() for c in ("p", "n", "top"))]
        for _ in range(fine - depth):
            p, at = np.unique(levels[0][0] >> 1, return_inverse=True)
            n, top = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
            np.add.at(n, at, levels[0][1])
            np.maximum.at(top, at, levels[0][2])
            levels.insert(0, (p, n, top))
        for k, (p, n, top) in enumerate(levels):
            size, rest = np.zeros(len(over), np.int64), np.zeros(len(over), np.int64)
            there = np.isin(over, p)
            at = np.searchsorted(p, over[there])
            size[there], rest[there] = n[at], (n - top)[at]
            fits = (rest <= capacity) | (depth + k >= deepest)
            found.add(depth + k, over[fits], size[fits])
            over = over[~fits]
            if k < len(levels) - 1:
                over = np.sort(np.concatenate([2 * over, 2 * over + 1]))
        depth = fine
    return found


def _owner(schema: pa.Schema, columns: list[str], text_at: int, id_at: int, rows: bool):
    """Decides the classes of each hash, whose entries come one after another."""
    at = {c: i for i, c in enumerate(columns)}

    def decided(done: list[list]) -> pa.RecordBatch:
        if rows:
            held = {id(c[3]): c[3] for c in done}
            parts = [batch.take(pa.array(sorted(c[4] for c in done if c[3] is batch), pa.int64())).select(schema.names).cast(schema) for batch in held.values()]
            return pa.Table.from_batches(parts, schema).combine_chunks()
        out = [(rep, c[2], c[1][2] if not c[1][1] else None, c[5], c[7]) for c in done for rep in c[6]]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, chain, done = None, [], []
        for batch in batches:
            reps, hashes = (batch.column(at[c]).to_pylist() for c in ("rep", "h"))
            lengths, members = batch.column(at["length"]).to_pylist(), batch.column(at["members"])
            ids, texts = batch.column(at[f"c{id_at}"]).to_pylist(), batch.column(at[f"c{text_at}"]).cast(pa.binary())
            sizes = members.value_lengths().to_pylist()
            for i, own in enumerate(hashes):
                if own != h:
                    done += chain
                    h, chain = own, []
                text = normalised(texts[i].as_py() or b"")
                rank = (*_rank(lengths[i], ids[i]), reps[i])
                c = next((c for c in chain if c[0] == text), None)
                if c is None:
                    chain.append([text, rank, reps[i], batch, i, sizes[i], [reps[i]], hashlib.sha256(text).hexdigest()])
                    continue
                c[5] += sizes[i]
                c[6].append(reps[i])
                if rank < c[1]:
                    c[1:5] = rank, reps[i], batch, i
            if done:
                yield from decided(done).to_batches()
                done = []
        if chain:
            yield from decided(chain).to_batches()

    return run


def _owned(docs: DataFrame, id_at: int, text_at: int, rows: bool) -> tuple[DataFrame, DataFrame]:
    """The entries, and what owners decide: rows that stay, or an assignment for each entry."""
    spark = docs.sparkSession
    entries = index_entries(docs, id_at, text_at)
    total = entries.agg(F.sum("n_bytes")).first()[0] or 0
    owners = max(common.partitions(spark), -(-total // OWNER_BYTES))
    found = directory(entries, min(BUCKET_BYTES, max(BUCKET_LEAST, total // (BUCKETS_PER_OWNER * owners))))
    cells = F.broadcast(spark.createDataFrame(found.cells(owners)))
    routed = entries if rows else entries.select(f"c{id_at}", f"c{text_at}", *(n for n, _ in ENTRY))
    routed = routed.withColumn("cell", _prefix(found.depth)).join(cells, "cell")
    routed = routed.repartitionById(owners, F.col("owner").cast("int")).sortWithinPartitions("bucket", "h")
    out = docs.schema if rows else T._parse_datatype_string(ASSIGNED)
    return entries, routed.mapInArrow(common.tidied(_owner(to_arrow_schema(out), routed.columns, text_at, id_at, rows)), out)


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    entries, assigned = _owned(placed(docs.select(F.col(id_column).cast("long"), F.col(text_column))), 0, 1, False)
    members = entries.select("rep", "best", F.posexplode("members").alias("at", "doc_id"))
    assigned = common.written(assigned, "assigned")
    return members.join(assigned, "rep").select("doc_id", "keep_id", "group_size", ((F.col("rep") == F.col("keep_rep")) & (F.col("at") == F.col("best"))).alias("kept"), "text_sha256")


def without_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns; the texts pass through the index once."""
    return _owned(placed(docs), docs.columns.index(id_column), docs.columns.index(text_column), True)[1].toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(common.documents(spark, sf_dir))


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha
  FROM documents
), r AS (
  SELECT *, row_number() OVER (PARTITION BY sha ORDER BY len DESC, doc_id) AS rn,
    first_value(doc_id) OVER (PARTITION BY sha ORDER BY len DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY sha) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha AS text_sha256 FROM r
"""
