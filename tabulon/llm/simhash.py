"""SimHash near-duplicate groups.

Fingerprints of 64 bits link when at most two bits differ. Of four blocks of 16 bits, two at least are
then equal, so that equal block pairs (six tables) hold every link. Inside such a bucket fingerprints
are compared bit-sliced: their bits are stored as vertical planes, the distances of a whole block are
counted at once by carry-save counters of two bits, and a block is left as soon as all its distances
exceed the radius.

Copies of a fingerprint are one row before any comparison. A bucket of more than ``most`` distinct
fingerprints is not compared pair by pair: there, each fingerprint names every value within one bit of
it, and two fingerprints link exactly if they name a common value. A value is named by 33 fingerprints
at most, so this way is exact and linear, whatever the size of the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import pack, spread_join, table, unpack, written
from tabulon.llm.graph import components

RADIUS = 2
BLOCK_PAIRS = list(combinations(range(4), 2))
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
ABANDON_EVERY = 8
SMALL_BUCKET = 48
#: Code points of a block's texts, and blocks of a task that reads them again.
BLOCK_CHARS = 1 << 22
TASK_BLOCKS = 4


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text, as an unsigned number."""
    parts = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    if not parts:
        return 0
    flat = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    k = min(words, len(parts))
    begins = np.concatenate([[0], ends[:-1] + 1])[: len(parts) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(flat[i:j], seed) for i, j in zip(begins, ends[k - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp bigint) of every row; the bits of fp are those of the unsigned fingerprint."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words, seed) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp bigint")


def planes(values: np.ndarray) -> np.ndarray:
    """The 64 bit planes of fingerprints, each a row of 64-bit words (padded with zeros)."""
    n = -len(values) % 64
    bits = np.unpackbits(np.concatenate([values, np.zeros(n, np.uint64)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view(np.uint64)


def near(differ: Iterator[np.ndarray], exceed: np.ndarray) -> np.ndarray:
    """The bits whose count over all difference planes is at most RADIUS. exceed: bits that are out from the start."""
    ones, twos = np.zeros_like(exceed), np.zeros_like(exceed)
    for k, d in enumerate(differ):
        carry = ones & d
        ones ^= d
        exceed |= twos & carry
        twos ^= carry
        if k % ABANDON_EVERY == ABANDON_EVERY - 1 and ((exceed | (ones & twos)) == FULL).all():
            return np.zeros_like(exceed)
    return ~(exceed | (ones & twos))


def set_bits(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def bucket_pairs(values: np.ndarray, rows: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i < j) within RADIUS in one bucket: blocks of rows against the planes of all."""
    p, n = planes(values), len(values)
    width = p.shape[1]
    left, right = [], []
    for i in range(0, n, rows):
        q = values[i : i + rows]
        later = np.arange(width * 64)[None, :] > np.arange(i, i + len(q))[:, None]
        out = np.ascontiguousarray(np.packbits(~(later & (np.arange(width * 64) < n)), axis=1, bitorder="little")).view(np.uint64)
        sign = np.where((q[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), FULL, np.uint64(0))
        at = set_bits(near((p[k] ^ sign[:, k : k + 1] for k in range(64)), out).ravel())
        left.append(i + at // (width * 64))
        right.append(at % (width * 64))
    return np.concatenate(left), np.concatenate(right)


def shifted_pairs(values: np.ndarray, bucket: np.ndarray, block: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """The pairs within RADIUS in many small buckets, which lie one after the other: each row against the row s further on."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in range(1, int(np.bincount(bucket).max())):
        i = np.flatnonzero(bucket[:-s] == bucket[s:])
        for k in range(0, len(i), block):
            part = i[k : k + block]
            p = planes(values[part] ^ values[part + s])
            out = np.packbits(np.arange(p.shape[1] * 64) >= len(part), bitorder="little").view(np.uint64)
            hit = part[set_bits(near(iter(p), out))]
            left.append(hit)
            right.append(hit + s)
    return np.concatenate(left), np.concatenate(right)


def stars(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least member of each of n rows' component under the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one array of distinct fingerprints (a bucket) to star edges (a, b)."""
    for batch in batches:
        lists = batch.column(0)
        values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        sizes = np.diff(lists.offsets.to_numpy())
        starts = np.cumsum(sizes) - sizes
        bucket = np.repeat(np.arange(len(sizes)), sizes)
        small = np.flatnonzero((sizes <= SMALL_BUCKET)[bucket])
        pairs = []
        if len(small):
            i, j = shifted_pairs(values[small], bucket[small])
            pairs.append((small[i], small[j]))
        for b in np.flatnonzero(sizes > SMALL_BUCKET):
            i, j = bucket_pairs(values[starts[b] : starts[b] + sizes[b]])
            pairs.append((starts[b] + i, starts[b] + j))
        if not pairs:
            continue
        label = stars(len(values), np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))
        at = np.flatnonzero(label != np.arange(len(values)))
        signed = values.view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(signed[at]), pa.array(signed[label[at]])], names=["a", "b"])


def _block(i: int) -> Column:
    return F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))


def links(distinct: DataFrame, most: int = 4096) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that give the components of all links."""
    keys = [F.lit(n << 32).bitwiseOR(F.shiftleft(_block(i), 16)).bitwiseOR(_block(j)) for n, (i, j) in enumerate(BLOCK_PAIRS)]
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    large = written(keyed.groupBy("key").count().where(F.col("count") > most).select("key"), "large")
    buckets = keyed.join(large, "key", "left_anti").groupBy("key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    edges = buckets.mapInArrow(link_batches, "a bigint, b bigint")
    pair = F.shiftrightunsigned("key", 32).cast("int")
    free = F.array(*(F.array(*(F.lit(16 * b + k) for b in range(4) if b not in bp for k in range(16))) for bp in BLOCK_PAIRS))
    flips = F.transform(F.element_at(free, pair + 1), lambda b: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b)))
    named = keyed.join(large, "key", "left_semi").select("key", "fp", F.explode(F.concat(F.array("fp"), flips)).alias("value"))
    shared = named.groupBy("key", "value").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    rest = shared.select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).where("a <> b").select("a", "b")
    return edges.unionByName(rest)


def labelled(prints: DataFrame, most: int = 4096) -> DataFrame:
    """``prints`` (a written table with doc_id and fp) with root, the component's least fingerprint, and component_id.

    Rows of common fingerprints meet their label where they are, so that none gathers more than a thousandth of the rows.
    """
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "distinct")
    member = written(components(links(distinct.select("fp"), most)).withColumnRenamed("node", "fp"), "members")
    named = member.join(distinct, "fp").groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = member.join(named, "root").select("fp", "root", "component_id")
    label = distinct.join(linked, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "rep").alias("component_id"))
    return spread_join(prints, written(label, "labels"), "fp", "n", prints.count()).drop("n")


def groups(docs: DataFrame, words: int = 3, seed: int = 42, most: int = 4096, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (the least doc_id that links reach, its own included).

    A null text has fingerprint zero, as a text without words has, and links like any other. Repeated
    rows share a fingerprint and so a component; rows with a null doc_id take part but never name a
    component, which is null only if no member has an id. Other columns are not read. Empty in, empty out.
    """
    return labelled(written(fingerprints(docs, words, seed, id_col, text), "prints"), most).select("doc_id", "fp", "component_id")


def blocked(whole: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """block, pack, prints: rows of ``whole`` (doc_id, hash, text, all) in blocks of some megabytes, compressed, with what each is judged by.

    Blocks are cut as a task reads its rows, so the table is written before it is used.
    """
    kind = whole.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k, size = TaskContext.get().partitionId(), 0, 0
        held: list[pa.RecordBatch] = []
        prints: list[tuple] = []
        parts: list[pa.Array] = []

        def emit() -> pa.RecordBatch:
            nonlocal k, size, held, prints, parts
            ids = pa.concat_arrays(parts)
            rows = pa.StructArray.from_arrays([ids, pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64())], names=["doc_id", "hash", "fp"])
            out = pa.RecordBatch.from_arrays([pa.array([task << 32 | k]), pa.array([pack(held)], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)], names=["block", "pack", "prints"])
            k, size, held, prints, parts = k + 1, 0, [], [], []
            return out

        for batch in batches:
            begin = 0
            for i, (h, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))):
                text = text.as_py()
                prints.append((h, int(np.uint64(fingerprint(text, words, seed)).astype(np.int64))))
                size += len(text or "")
                if size >= BLOCK_CHARS or i + 1 == batch.num_rows:
                    part = batch.slice(begin, i + 1 - begin)
                    held.append(part.select([3]))
                    parts.append(part.column(0))
                    begin = i + 1
                if size >= BLOCK_CHARS:
                    yield emit()
        if held:
            yield emit()

    return whole.mapInArrow(run, f"block bigint, pack binary, prints array<struct<doc_id:{kind},hash:bigint,fp:bigint>>")


def deduplicate(docs: DataFrame, words: int = 3, seed: int = 42, most: int = 4096) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document of least doc_id, once.

    A row without doc_id can't be judged and stays. Rows that share an id are held by their texts: in one component
    one of them stays, that of the least hash over its columns; in two components one stays in each. Null, empty and
    wordless texts have one fingerprint and are one component. Columns may have any names besides doc_id and text.
    Empty in, empty out.

    Rows are read once, into compressed blocks. What decides is a few numbers a row; the places that stay then meet
    their block, so that texts move compressed, a few blocks to a task, whatever the number of copies.
    """
    plain = [F.to_json(f"`{c}`") if "map<" in t else F.col(f"`{c}`") for c, t in docs.dtypes]
    whole = docs.select("doc_id", F.xxhash64(*plain).alias("hash"), F.col("text").cast("string").alias("text"), F.struct("*").alias("all"))
    blocks = written(blocked(whole, words, seed), "blocks")
    prints = written(blocks.select("block", F.posexplode("prints").alias("at", "p")).select("block", "at", "p.doc_id", "p.hash", "p.fp"), "prints")
    found = labelled(prints, most)
    heads = found.where("doc_id = component_id").groupBy("doc_id", "root").agg(F.min(F.struct("hash", "block", "at")).alias("m")).select("m.block", "m.at")
    stay = heads.unionByName(prints.where("doc_id is null").select("block", "at"))
    tasks = max(1, -(-blocks.count() // TASK_BLOCKS))
    places = stay.repartition(tasks, "block").groupBy("block").agg(F.sort_array(F.collect_list("at")).alias("places"))
    met = blocks.select("block", "pack").repartition(tasks, "block").join(places, "block").select("pack", "places")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, places in zip(batch.column(0), batch.column(1)):
                at, begin = places.values.to_numpy(), 0
                for part in unpack(piece.as_py()):
                    own = at[(at >= begin) & (at < begin + part.num_rows)] - begin
                    begin += part.num_rows
                    if len(own):
                        yield pa.RecordBatch.from_arrays(part.column(0).take(pa.array(own)).flatten(), names=names)

    return met.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
