"""Prefix trie of conversations, so that shared beginnings are seen and counted once.

Each conversation gets a chain of cryptographic digests, one per prefix; every prefix is exploded into a row, and rows
grouped by (depth, digest) are the nodes. A node is named by its smallest member, its owner: nodes of one owner form one
downward path, namely the end of that conversation from some depth on. So a subtree sum is a sum along the owner's path
plus the totals of paths that branch off it, and it is these path totals that are exploded to all ancestors, one row per
path above. A path with k paths above it is at least k turns deep, hence these rows never outnumber the turns, where single
nodes times their ancestors would grow with the square of a long conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.chat import turns
from tallyframe.llm.shared import materialize, partitions, rows


@dataclass(frozen=True)
class TrieParams:
    hot_share: int = 1000  # nodes that hold more than one in so many prefixes are joined by broadcast: fewer than that many
    chunk_ids: int = 100_000  # ids of conversations that end at a node are joined to texts of at most so many


PREFIXES = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("digest", pa.binary()), ("words", pa.int64()), ("last", pa.bool_())])
_ROOT = hashlib.sha256(b"").digest()


def chained(parent: bytes, role: str, text: str) -> bytes:
    """The digest of a prefix from that of the prefix before it; roles and texts are told apart by the role's length."""
    role = role.encode()
    return hashlib.sha256(b"%s%d:%s%s" % (parent, len(role), role, text.encode())).digest()


def prefixes(arranged: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, words of the last turn, whether the conversation ends here) of every prefix, the empty one too.

    ``arranged``: conv_id, real, role, text, with a conversation's rows together and in order in one partition; a row that is
    not real is no turn. Conversations are streamed.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        last: tuple | None = None
        for batch in batches:
            for conv_id, real, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "real", "role", "text"))):
                if last is None or last[0] != conv_id:
                    if last is not None:
                        made.append((*last, True))
                    last = conv_id, 0, _ROOT, 0
                if real:
                    made.append((*last, False))
                    last = conv_id, last[1] + 1, chained(last[2], role, text), len(text.encode().split())
            if made:
                yield rows(PREFIXES, list(zip(*made)))
                made = []
        if last is not None:
            yield rows(PREFIXES, list(zip(*[(*last, True)])))

    return arranged.mapInArrow(task, "conv_id long, depth long, digest binary, words long, last boolean")


def rebuilt(conversations: DataFrame, *, family: int = 20, shares: int = 4) -> DataFrame:
    """Conversations that begin as the first of their family does: c begins with the first h turns of c - c % family, with
    h = crc32(decimal c) % shares, and goes on with its own turns after its first h. Rows without conv_id belong to none.

    Returns conv_id, at (place of a row), real, role, text; each conversation has a row that is not real.
    """
    place = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    own = turns(conversations).where("conv_id IS NOT NULL").select("conv_id", F.row_number().over(place).alias("at"), "role", "text")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % shares
    first = own.where(F.col("at") < shares).select(F.col("conv_id").alias("_base"), F.col("at").alias("_at"), F.col("role").alias("_role"), F.col("text").alias("_text"))
    known = own.where("at = 1").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    lent = known.join(first, (F.col("base") == F.col("_base")) & (F.col("_at") <= F.col("h")))
    return (
        own.where(F.col("at") > h).select("conv_id", F.col("at").cast("long").alias("at"), F.lit(True).alias("real"), "role", "text")
        .unionByName(lent.select("conv_id", F.col("_at").cast("long").alias("at"), F.lit(True).alias("real"), F.col("_role").alias("role"), F.col("_text").alias("text")))
        .unionByName(known.select("conv_id", F.lit(0).cast("long").alias("at"), F.lit(False).alias("real"), F.lit("").alias("role"), F.lit("").alias("text")))
    )


CHUNKS = pa.schema([("digest", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
ENDS = pa.schema([("digest", pa.binary()), ("ends_sha256", pa.string())])


def end_digests(prefix: DataFrame, params: TrieParams) -> DataFrame:
    """(digest, ends_sha256) of nodes at which conversations end: the digest of their ids, ascending, joined by commas.

    Ids are sorted by range over (digest, conv_id), so a node with very many ends is dealt over many tasks; each joins its
    stretch to texts, and one task hashes the few texts of a node in order, which a digest cannot do otherwise.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, ids, made = None, [], []
        for batch in batches:
            for found, conv_id in zip(batch.column("digest").to_pylist(), batch.column("conv_id").to_pylist()):
                if ids and (found != digest or len(ids) >= params.chunk_ids):
                    made.append((digest, ids[0], ",".join(map(str, ids))))
                    ids = []
                digest = found
                ids.append(conv_id)
            if made:
                yield rows(CHUNKS, list(zip(*made)))
                made = []
        if ids:
            yield rows(CHUNKS, list(zip(*[(digest, ids[0], ",".join(map(str, ids)))])))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, running, made = None, None, []
        for batch in batches:
            for found, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist()):
                if found != digest:
                    if running is not None:
                        made.append((digest, running.hexdigest()))
                    digest, running = found, hashlib.sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
            if made:
                yield rows(ENDS, list(zip(*made)))
                made = []
        if running is not None:
            yield rows(ENDS, list(zip(*[(digest, running.hexdigest())])))

    n = partitions(prefix.sparkSession)
    ordered = prefix.where("last").select("digest", "conv_id").repartitionByRange(n, "digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    joined = ordered.mapInArrow(chunks, "digest binary, first long, ids string")
    return joined.repartition(n, "digest").sortWithinPartitions("digest", "first").mapInArrow(hashed, "digest binary, ends_sha256 string")


def trie(conversations: DataFrame, params: TrieParams = TrieParams()) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text), turns ordered by turn (null first), then role and text.

    Null role or text: empty. Rows without conv_id belong to no conversation. Repeated rows are turns like others. Empty
    table: no nodes, not even the root. See ``nodes`` for the columns.
    """
    own = turns(conversations).where("conv_id IS NOT NULL").withColumns({"at": F.lit(1), "real": F.lit(True)})
    return nodes(own.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text"), params)


def nodes(arranged: DataFrame, params: TrieParams = TrieParams()) -> DataFrame:
    """Nodes of the trie: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``saved_tokens`` of a node sums, over its subtree, (members - 1) times the words of the last turn: what need not be read
    again. ``arranged`` as in ``prefixes``. Prefixes of a node that holds more than a thousandth of all are joined to it by
    broadcast, since fewer than a thousand nodes can; others are shuffled.
    """
    prefix = materialize(prefixes(arranged.select("conv_id", "real", "role", "text")), "trie-prefixes")
    node = materialize(prefix.groupBy("depth", "digest").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs")), "trie-nodes")
    bound = prefix.count() // params.hot_share
    hot, cold = node.where(F.col("n_convs") > bound), node.where(F.col("n_convs") <= bound)
    is_hot = F.broadcast(hot.select("depth", "digest"))
    known = prefix.join(F.broadcast(hot), ["depth", "digest"]).unionByName(prefix.join(is_hot, ["depth", "digest"], "left_anti").join(cold, ["depth", "digest"]))
    up = Window.partitionBy("conv_id").orderBy("depth")
    placed = materialize(known.select("conv_id", "depth", "digest", "words", "owner", "n_convs", F.lag("owner").over(up).alias("parent_conv_id")), "trie-placed")
    own = placed.where("conv_id = owner").drop("owner").withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    children = own.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    own = materialize(own.join(children, ["conv_id", "depth"], "left").fillna(0, "n_children").withColumn("leaf", (F.col("n_children") == 0).cast("long")), "trie-own")
    totals = own.groupBy("conv_id").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    above = placed.where("conv_id <> owner").groupBy("conv_id", "owner").agg(F.max("depth").alias("depth"))  # where a path above is left
    side = above.join(totals, "conv_id").groupBy(F.col("owner").alias("conv_id"), "depth").agg(F.sum("leaf").alias("side_leaf"), F.sum("saved").alias("side_saved"))
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = own.join(side, ["conv_id", "depth"], "left").fillna(0, ["side_leaf", "side_saved"])
    summed = summed.withColumns({"n_leaves": F.sum(F.col("leaf") + F.col("side_leaf")).over(below), "saved_tokens": F.sum(F.col("saved") + F.col("side_saved")).over(below)})
    return summed.join(end_digests(prefix, params), "digest", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    )


def rebuilt_trie(conversations: DataFrame, params: TrieParams = TrieParams()) -> DataFrame:
    """The trie of the conversations that ``rebuilt`` makes."""
    return nodes(rebuilt(conversations).repartition("conv_id").sortWithinPartitions("conv_id", "at"), params)
