"""Operator 12: the prefix trie of conversations by truncation peeling.

A turn is the digest of its role and text; a path is the chain of its turns'
digests, PATH_BYTES for each depth, so equal prefixes have equal digests (the
first 16 bytes of SHA-256).  Equal conversations are one row from the start.

``peel`` descends from the greatest depth: the conversations that end at a depth
join the nodes that survive from below, rows of one digest are merged (smallest
member, members, children, leaves, saved tokens), the merged rows are the
nodes of that depth, and their last turn is stripped so that they regroup one
depth higher.  Nodes are found and aggregated in that one pass.

A row that is alone under its first turn above the floor of a band of depths can
meet no other row within the band, so all its turns in the band are stripped at
once; only rows that share are peeled level by level, band by halved band.  A
few very long conversations so cost a few jobs, not one for each turn.  Every
merge is a grouped sum with map-side combination: a first turn (or a whole
conversation) that a third of all rows share is merged in each task first.
What each round makes is written to the shared folder.

The ids of the conversations that end at a node are sorted by range over many
tasks, joined to texts of at most ID_RUN ids there, and only these texts are
streamed through the node's SHA-256, which must be computed in sequence.

Defined results: rows without a conv_id belong to no conversation and are left
out; null role or text is empty; turns are ordered by turn (null first), then
by digest, so tied and repeated rows have a fixed order; remainders of
negative ids are cut towards zero, as in SQL; an empty table gives no rows;
other columns are ignored.  A conversation's path (16 bytes for each turn) is
one row; its texts never are.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prlens.llm.common import map_batches, stored, table
from prlens.llm.registry import register

#: Rebuilding: the first (crc32 of the id) % HEADS turns of conversation c - c % FAMILY.
FAMILY, HEADS = 100, 6

#: Bytes of a digest; conversation ids in one joined text.
PATH_BYTES, ID_RUN = 16, 10_000

NO_ENDS = hashlib.sha256(b"").hexdigest()

STATE = ["conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


# ---- conversations -> paths


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 0, digest, points) of every turn; no text from here on."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("conv_id IS NOT NULL")
    # The length of the role, then both: no two (role, text) give the same bytes.
    said = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    rows = rows.select("conv_id", "turn", F.unhex(F.sha2(said, 256)).alias("digest"),
                       F.length("text").cast("long").alias("points"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return rows.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("place"), "digest", "points")


def rebuilt(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth from 1, digest, points) of the rebuilt turns, and (conv_id) of every conversation."""
    own = stored(turns(conversations), "turns")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = own.groupBy("conv_id").agg(F.lit(1)).select(
        "conv_id", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    bases = (own.filter((F.col("conv_id") % family == 0) & (F.col("place") < heads - 1)).groupBy("conv_id")
             .agg(F.sort_array(F.collect_list(F.struct("place", "digest", "points"))).alias("start"))
             .select(F.col("conv_id").alias("base"), "start"))
    convs = stored(convs.join(bases, "base", "left").select(
        "conv_id", "h", F.expr("coalesce(slice(start, 1, cast(h AS int)), array())").alias("start")), "heads")
    first = convs.select("conv_id", F.explode("start").alias("t")).select(
        "conv_id", (F.col("t.place") + 1).alias("depth"), "t.digest", "t.points")
    rest = own.join(convs.select("conv_id", "h", F.size("start").alias("m")), "conv_id").filter("place >= h").select(
        "conv_id", (F.col("m") + F.col("place") - F.col("h") + 1).alias("depth"), "digest", "points")
    return first.unionByName(rest), convs.select("conv_id")


def paths(turn_rows: DataFrame) -> DataFrame:
    """(conv_id, depth, path binary, upto array<long>) of each conversation with turns: the chained
    digests and the code points up to each turn, made while the sorted turns stream by."""
    def run(batches):
        current, chain, path, upto = None, b"", [], []
        names = ["conv_id", "depth", "path", "upto"]

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([current], pa.int64()), pa.array([len(upto)], pa.int32()),
                 pa.array([b"".join(path)], pa.binary()), pa.array([upto], pa.list_(pa.int64()))], names)

        done = []
        for batch in batches:
            for conv, digest, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "digest", "points")),
                                       strict=True):
                if conv != current:
                    if current is not None:
                        done.append(row())
                    current, chain, path, upto = conv, b"", [], []
                chain = hashlib.sha256(chain + digest).digest()[:PATH_BYTES]
                path.append(chain)
                upto.append(n + upto[-1] if upto else n)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                done = []
        if current is not None:
            yield row()

    ordered = turn_rows.repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    return map_batches(ordered, run, "conv_id long, depth int, path binary, upto array<long>")


# ---- peeling


def _digest(depth: Column | str) -> Column:
    """The path's digest at a depth (empty at 0: the root)."""
    depth = F.col(depth) if isinstance(depth, str) else depth
    return F.substring(F.col("path"), (depth - 1) * PATH_BYTES + 1, F.lit(PATH_BYTES))


def _parent(depth: Column | str) -> Column:
    depth = F.col(depth) if isinstance(depth, str) else depth
    return F.when(depth > 1, _digest(depth - 1)).otherwise(F.lit(b""))


def _points(depth: Column | str) -> Column:
    """Code points of a path's turns from a depth to its end."""
    depth = F.col(depth) if isinstance(depth, str) else depth
    return F.element_at("upto", -1) - F.when(depth > 1, F.try_element_at("upto", depth - 1)).otherwise(0)


def _merged(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in STATE[1:]),
        *([] if "path" in keys else [F.any_value("path").alias("path"), F.any_value("upto").alias("upto")]))


NODE = ["depth", "digest", "parent", *STATE]


class Peeling:
    """Nodes found so far, as tables in the shared folder."""

    def __init__(self):
        self.nodes: list[DataFrame] = []

    def _emit(self, nodes: DataFrame) -> None:
        self.nodes.append(nodes.select(*NODE))

    def level(self, rows: DataFrame, depth: int) -> DataFrame:
        """Rows of one depth merge to its nodes; without their last turn they regroup one depth higher."""
        met = _merged(rows.withColumn("digest", _digest(F.lit(depth))), "digest")
        nodes = stored(met.withColumn("depth", F.lit(depth)).withColumn("parent", _parent("depth"))
                       .withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")))
                       .withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * _points("depth")),
                       "nodes")
        self._emit(nodes)
        return nodes.select(
            (F.col("depth") - 1).alias("depth"), F.substring("path", 1, (depth - 1) * PATH_BYTES).alias("path"),
            F.slice("upto", 1, depth - 1).alias("upto"), "conv_id", "n_convs",
            F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens")

    def chains(self, rows: DataFrame, floor: int) -> DataFrame:
        """Rows that meet no other above ``floor`` are stripped down to it at once."""
        rows = rows.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long"))
        at = F.col("at")
        self._emit(rows.select("*", F.explode(F.sequence(F.lit(floor + 1), F.col("depth"))).alias("at")).select(
            at.alias("depth"), _digest(at).alias("digest"), _parent(at).alias("parent"), "conv_id", "n_convs",
            F.when(at == F.col("depth"), F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves",
            (F.col("saved_tokens") + (F.col("n_convs") - 1) * _points(at)).alias("saved_tokens")))
        return rows.select(
            F.lit(floor).alias("depth"), F.substring("path", 1, floor * PATH_BYTES).alias("path"),
            F.slice("upto", 1, floor).alias("upto"), "conv_id", "n_convs",
            F.lit(1).cast("long").alias("n_children"), "n_leaves",
            (F.col("saved_tokens") + (F.col("n_convs") - 1) * _points(F.lit(floor + 1))).alias("saved_tokens"))

    def peel(self, rows: DataFrame, floor: int, top: int) -> DataFrame | None:
        """Peel rows with depths in (floor, top]; what regroups at ``floor`` (None: there are no rows)."""
        if top - floor == 1:
            return self.level(rows, top)
        key = _digest(F.lit(floor + 1))
        alone = rows.groupBy(key.alias("key")).count().select(F.col("key").alias("k"), (F.col("count") == 1).alias("alone"))
        split = stored(rows.withColumn("key", key).join(alone.hint("shuffle_merge"), F.col("key") == F.col("k"))
                       .drop("key", "k"), "band")
        deepest = dict(split.groupBy("alone").agg(F.max("depth")).collect())
        out = [self.chains(split.filter("alone").drop("alone"), floor)] if True in deepest else []
        if False in deepest:
            rest, top = split.filter("NOT alone").drop("alone"), deepest[False]
            middle = (floor + top) // 2
            if middle > floor:
                upper = self.peel(rest.filter(F.col("depth") > middle), middle, top)
                rest = rest.filter(F.col("depth") <= middle).unionByName(upper)
                out.append(self.peel(rest, floor, middle))
            else:
                out.append(self.level(rest, top))
        rows = None
        for part in out:
            rows = part if rows is None else rows.unionByName(part)
        return rows


# ---- ids that end at a node


def id_digests(ends: DataFrame) -> DataFrame:
    """(digest, ends_sha256) of (digest, conv_id): SHA-256 of the sorted ids, comma-joined."""
    def runs(batches):
        """Neighbouring ids of a node as one text."""
        key, first, ids, out = None, None, [], []
        for batch in batches:
            for digest, conv in zip(batch.column("digest").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if digest != key or len(ids) >= ID_RUN:
                    if ids:
                        out.append((key, first, ",".join(ids)))
                    key, first, ids = digest, conv, []
                ids.append(str(conv))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["digest", "first", "ids"])
                out = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([first]), pa.array([",".join(ids)])],
                                             ["digest", "first", "ids"])

    def hashed(batches):
        key, state, out = None, None, []
        for batch in batches:
            for digest, ids in zip(batch.column("digest").to_pylist(), batch.column("ids"), strict=True):
                if digest != key:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state = digest, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_buffer())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["digest", "ends_sha256"])
                out = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["digest", "ends_sha256"])

    ordered = ends.select("digest", "conv_id").repartitionByRange("digest", "conv_id").sortWithinPartitions(
        "digest", "conv_id")
    texts = map_batches(ordered, runs, "digest binary, first long, ids string")
    return map_batches(texts.repartition("digest").sortWithinPartitions("digest", "first"), hashed,
                       "digest binary, ends_sha256 string")


def trie(turn_rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the conversations with these turns (conv_id, depth from 1, digest, points):
    depth, digest and parent (path digests; empty: root, null: above it), conv_id,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    whole = stored(paths(turn_rows), "paths")
    turnless = convs.join(whole.select("conv_id"), "conv_id", "left_anti")
    ends = stored(whole.select(_digest("depth").alias("digest"), "conv_id")
                  .unionByName(turnless.select(F.lit(b"").alias("digest"), "conv_id")), "ends")
    new = [F.lit(1).cast("long").alias("n_convs"), *(F.lit(0).cast("long").alias(c) for c in STATE[2:])]
    single = whole.select("depth", "path", "upto", "conv_id", *new)
    rows = _merged(single.withColumn("digest", _digest("depth")), "digest", "depth").drop("digest")
    deepest = whole.agg(F.max("depth")).first()[0]
    peeling = Peeling()
    at_root = turnless.select("conv_id", *new)
    if deepest:
        at_root = at_root.unionByName(peeling.peel(stored(rows, "conversations"), 0, deepest).select(*STATE))
    root = (at_root.agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in STATE[1:]))
            .filter("conv_id IS NOT NULL")
            .withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long"))
            .select(F.lit(0).alias("depth"), F.lit(b"").alias("digest"), F.lit(None).cast("binary").alias("parent"), *STATE))
    nodes = root
    for found in peeling.nodes:
        nodes = nodes.unionByName(found)
    nodes = stored(nodes, "trie")
    above = nodes.select(F.col("digest").alias("p"), F.col("conv_id").alias("parent_conv_id"))
    ended = id_digests(ends).withColumnRenamed("digest", "e")
    return (nodes.join(above.hint("shuffle_merge"), F.col("parent") == F.col("p"), "left")
            .join(ended.hint("shuffle_merge"), F.col("digest") == F.col("e"), "left").drop("p", "e")
            .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))))


OP12_SQL = """
WITH c AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(
                      length(coalesce(role, '')), ':', role, text))) AS place
           FROM conversations WHERE conv_id IS NOT NULL),
w AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY place) AS turns FROM c GROUP BY conv_id),
-- CRC-32 of the id's decimal characters, a bit at a time: each byte is followed by seven steps without one.
b AS (SELECT conv_id, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
             lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])) AS steps FROM w),
h AS (SELECT conv_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), steps),
             lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295) % 6 AS h FROM b),
r AS (SELECT w.conv_id, list_concat(coalesce(list_slice(g.turns, 1, h.h), []),
                                    list_slice(w.turns, h.h + 1, len(w.turns))) AS turns
      FROM w JOIN h USING (conv_id) LEFT JOIN w g ON g.conv_id = w.conv_id - w.conv_id % 100),
p AS (SELECT conv_id, d AS depth, list_slice(turns, 1, d) AS path, d = len(turns) AS ends
      FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), ''))
                 AS ends_sha256
      FROM p GROUP BY path, depth),
k AS (SELECT list_slice(path, 1, depth - 1) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children,
             CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(n.path[depth].text) END AS own
      FROM n LEFT JOIN k ON n.path = k.path),
s AS (SELECT list_slice(path, 1, d) AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
             sum(own) AS saved_tokens
      FROM (SELECT path, n_children, own, unnest(range(0, depth + 1)) AS d FROM f) GROUP BY 1)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s ON f.path = s.path
LEFT JOIN f u ON f.depth > 0 AND u.depth = f.depth - 1 AND u.path = list_slice(f.path, 1, f.depth - 1)
"""


@register("op12_prefix_trie", OP12_SQL)
def q_prefix_trie(spark, sf_dir):
    """Operator 12 over all conversations, rebuilt with the first turns of their family."""
    return trie(*rebuilt(table(spark, sf_dir, "conversations"))).select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        "saved_tokens", "ends_sha256")
