"""Merkle manifest of a dataset, built and verified by supersteps over a vertex RDD (operator 13).

A vertex is named by (group, place): leaves are the rows of a source in order, and the vertex above places 3j to 3j+2 is j.
Up, every vertex sends its digest to the one above; one whose children are all there hashes them and sends on. Down, every
vertex sends each child the digests of that child's siblings, followed by its own path. Neighbours whose messages meet
within HEIGHT levels share a block, so a superstep carries messages over HEIGHT levels and only then over the network.
The sources' tops form one more tree over themselves. A block never holds more than FAN ** HEIGHT vertices, so a hot source
is only more blocks.
"""

from __future__ import annotations

import hashlib
import zlib
from binascii import hexlify

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

#: Vertices hashed into one; levels that a superstep climbs: a block has at most FAN ** HEIGHT vertices.
FAN, HEIGHT = 3, 6
#: Columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(*values) -> Column:
    """Hex digest over each value: `-` if null, else its UTF-8 byte count, `:` and the value."""
    each = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in (F.col(v) if isinstance(v, str) else v for v in values)]
    return F.sha2(F.concat(*each).cast("binary"), 256)


def hashed(digests: list[bytes]) -> bytes:
    """H of digests, which go in as hex text."""
    return hashlib.sha256(hexlify(b"".join(digests))).digest()


def placed(rows: DataFrame, group: str, order: list) -> DataFrame:
    """rows with place, their number within their group by `order`, and size, the group's number of rows.

    Rows are dealt to ranges of the whole order and kept; the numbers of a range's groups are summed over ranges, so no
    task orders a group, whatever its size."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group).asc_nulls_first(), *order]
    d = checkpointed(rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys))
    d = d.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    parts = d.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_p")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy("_group")
    parts = parts.withColumns({"_before": F.coalesce(F.sum("_n").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "size": F.sum("_n").over(w)})
    d = d.join(parts, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_group")))
    return d.select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("place"), "size")


def _dealt(key) -> int:
    return zlib.crc32(repr(key).encode("utf-8", "surrogatepass"))


def _layers(digests: list[bytes], size: int, height: int) -> list[list[bytes]]:
    """The digests of a block and of the vertices above them, level by level, in a level of `size` vertices."""
    layers = [digests]
    while size > 1 and len(layers) <= height:
        low = layers[-1]
        layers.append([hashed(low[i : i + FAN]) for i in range(0, len(low), FAN)])
        size = -(-size // FAN)
    return layers


def _paths(layers: list[list[bytes]], path: bytes) -> list[bytes]:
    """The path of every vertex of the lowest layer, from that of the block's top."""
    paths = [path]
    for low in reversed(layers[:-1]):
        paths = [b"".join([*low[i - i % FAN : i], *low[i + 1 : i - i % FAN + FAN], paths[i // FAN]]) for i in range(len(low))]
    return paths


class Forest:
    """A tree for each group of leaves ((group, place), (size, digest, extra)), where extra goes along to `paths`."""

    def __init__(self, nodes: RDD, size: int, tasks: int, height: int = HEIGHT):
        self.tasks, self.height, self.blocks, tops = tasks, height, [], []
        most = FAN**height
        while True:  # one superstep for `height` levels
            sent = nodes.map(lambda v: ((v[0][0], v[0][1] // most), (v[0][1] % most, *v[1])))
            block = sent.groupByKey(tasks, _dealt).mapValues(_gathered)
            up = block.mapValues(lambda b: (b[0], _layers(b[1], b[0], height)[-1][0]))
            self.blocks.append(block)
            tops.append(up.filter(lambda v: v[1][0] <= most).map(lambda v, step=len(tops): (v[0][0], (step, v[1][1]))))
            if size <= most:
                break
            nodes, size = up.filter(lambda v: v[1][0] > most).mapValues(lambda v: (-(-v[0] // most), v[1], None)), -(-size // most)
        #: (group, (superstep, digest)) of every group's top.
        self.tops = block.context.union(tops)

    def paths(self, above: RDD) -> RDD:
        """(group, place, size, digest, extra, path, more) of every leaf, from above: (group, (superstep, path, more)).

        path are the siblings' digests from the leaf's up to the group's top and on along `path` of above."""
        known, height = None, self.height
        for step in range(len(self.blocks) - 1, -1, -1):
            begin = above.filter(lambda t, step=step: t[1][0] == step).map(lambda t: ((t[0], 0), (None, *t[1][1:])))
            sent = begin if known is None else begin.union(known)
            met = self.blocks[step].union(sent).groupByKey(self.tasks, _dealt).flatMap(lambda m: _delivered(m, height))
            known = met.map(lambda v: ((v[0], v[1]), (None, *v[5:])))
        return met


def _gathered(got):
    """(size of the level, digests, extras) of the vertices of a block, in order."""
    got = sorted(got, key=lambda v: v[0])
    return got[0][1], [v[2] for v in got], [v[3] for v in got]


def _delivered(met, height: int):
    """A block and the path of its top, in either order, as rows of `Forest.paths`."""
    (group, place), got = met
    (size, digests, extras), (_, path, more) = sorted(got, key=lambda x: x[0] is None)
    for i, (digest, extra, own) in enumerate(zip(digests, extras, _paths(_layers(digests, size, height), path))):
        yield group, place * FAN**height + i, size, digest, extra, own, more


def fold(digest: bytes, path: bytes, *trees: tuple[int, int]) -> bytes:
    """The top that follows from a leaf's digest and its path through trees of (place, size), the leaf's own first."""
    at = 0
    for place, size in trees:
        while size > 1:
            first = place - place % FAN
            width = min(FAN, size - first)
            run = [path[at + 32 * i : at + 32 * (i + 1)] for i in range(width - 1)]
            at += 32 * (width - 1)
            run.insert(place - first, digest)
            digest, place, size = hashed(run), place // FAN, -(-size // FAN)
    return digest


def manifest(rows: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(id, leaf, subroot, root, proof, folded_root, verified) of rows (id, source, leaf, other): hex digests, and proof, the
    bytes of the siblings' digests in order.

    Leaves of a source are ordered by id (null first), then leaf, so rows that repeat have places of their own; sources by
    their bytes, null first. folded_root is what `other` (null: leaf) and the path give. An empty table gives no rows.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    leaves = placed(rows.select("id", "source", F.unhex("leaf").alias("leaf"), F.unhex("other").alias("other")), "source", [F.col("id").asc_nulls_first(), "leaf"])
    largest = leaves.agg(F.max("size")).first()[0]
    kind = "id long, leaf string, subroot string, root string, proof binary, folded_root string, verified boolean"
    if not largest:
        return spark.createDataFrame([], kind)
    own = Forest(leaves.rdd.map(lambda r: ((r[1], r[4]), (r[5], bytes(r[2]), (r[0], r[3] and bytes(r[3]))))), largest, tasks, height)
    tops = checkpointed(own.tops.map(lambda t: (t[0], *t[1])).toDF("source string, step int, subroot binary"))
    ranked = placed(tops.withColumn("all", F.lit(0)), "all", [F.col("source").asc_nulls_first()])
    n = ranked.count()
    whole = Forest(ranked.rdd.map(lambda r: ((0, r.place), (r.size, bytes(r.subroot), (r.source, r.step)))), n, tasks, height)
    root = whole.tops.first()[1][1]  # one digest
    ends = whole.paths(whole.tops.mapValues(lambda t: (t[0], b"", None)))
    # A source's top goes on with what folding needs of the tree above it.
    ends = checkpointed(ends.map(lambda e: (*e[4], e[5], e[3], e[1])).toDF("source string, step int, path binary, subroot binary, rank long"))
    above = ends.rdd.map(lambda r: (r.source, (r.step, bytes(r.path), (bytes(r.subroot), r.rank))))

    def judged(v):
        _, place, size, leaf, (key, other), path, (subroot, rank) = v
        got = fold(other or leaf, path, (place, size), (rank, n))
        return key, leaf.hex(), subroot.hex(), root.hex(), path, got.hex(), got == root

    return own.paths(above).map(judged).toDF(kind)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every document; ties and odd rows as in `manifest`.

    Where the checksum of doc_id is even, the row is verified with a text that has lost its newlines; a null doc_id is not
    tampered with."""
    d = table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    changed = F.when(even, leaf_hash(*[F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS]))
    m = manifest(d.select(F.col("doc_id").alias("id"), "source", leaf_hash(*map(F.col, FIELDS)).alias("leaf"), changed.alias("other")))
    return m.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.lower(F.hex("proof")).cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")
