"""A z-fast trie over conversations, built in batches by joins.

A conversation is its sequence of turns.  Each turn has a digest, and the combined digests of the
first d turns name the prefix of that length, so two prefixes are equal when their names are.  Nodes
of the compacted trie are where conversations part or end.  A node's handle is the prefix whose
length is the two-fattest number (that with the most trailing zero bits) of its edge, and a table from
handles to nodes answers a fat binary search: a conversation of n turns finds the node where it
leaves the trie by looking up the names of about log2(n) prefixes.

All conversations that are not yet in the trie search at once, each step one join for the names and one
with the handles.  A batch then splits each edge at all the depths where conversations leave it, and inserts
one new leaf per place and next turn.  Which of the conversations at a place that is decides a hash
of their ids, so that their number about halves from batch to batch and few batches are needed,
however deep the trie.  Sums over subtrees come from pointer doubling over the compacted nodes, and only
then edges are expanded into one row per prefix.

Turns go by ``turn``, nulls first, then by the SHA-256 of role and text.  Null roles and texts are
empty, rows without a conversation id take no part, repeated rows are turns of their own, and an empty
table has no nodes.  Other columns are not read.  Only digests and word counts are shuffled, never texts;
a conversation of any length is cut into blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm.store import kept
from strandmill.operators import blocked
from strandmill.operators.spread import spread_join

GROUP = 20  # conversations of so many ids share their first turns
RUN = 4096  # depths of a conversation in one task
EDGE = 256  # depths of an edge in one row of a join
WORD = r"[^\x20\x09-\x0D]+"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _name(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def _root() -> Column:
    return _name(F.lit(0).cast("long"), F.lit(0).cast("long"))


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, position from 0, a, b, words): digests and word counts in the order of turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = kept(
        conversations.where(F.col("conv_id").isNotNull()).select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
            digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
        .select("conv_id", "turn", "words", *[F.conv(F.substring("digest", at, 15), 16, 10).cast("long").alias(c) for at, c in ((1, "a"), (16, "b"))]),
        "turns")
    order = [F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")]
    # Ranges follow the order, so they serve as blocks also where turns are null or tie.
    dealt = kept(rows.repartitionByRange("conv_id", *order).withColumn("range", F.spark_partition_id()), "ranges")
    return blocked.position(dealt, ["conv_id"], order, F.col("range")).select("conv_id", "position", "a", "b", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, size, depth from 1, a, b, words) and (conv_id, size): each conversation c with the first
    h turns of conversation c - c % GROUP in place of its own first h."""
    head = F.when(F.col("position") < 3, F.struct("position", "a", "b", "words"))
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(head)).alias("head"))
    convs = kept(convs.withColumns({
        "base": F.col("conv_id") - F.col("conv_id") % GROUP, "h": (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")}), "heads")
    heads = convs.select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"))
    convs = convs.drop("head").join(heads, "base", "left").withColumn("start", F.slice(F.coalesce("base_head", F.array()), 1, F.col("h")))
    convs = convs.withColumn("size", (F.size("start") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long"))
    first = convs.select("conv_id", "size", F.posexplode("start").alias("at", "t")).select(
        "conv_id", "size", (F.col("at") + 1).cast("long").alias("depth"), "t.a", "t.b", "t.words")
    of = convs.select("conv_id", "size", "n", "h", F.size("start").alias("given"))
    own = spread_join(turns, of, ["conv_id"], "n", ["position"]).where(F.col("position") >= F.col("h")).select(
        "conv_id", "size", (F.col("given") + F.col("position") - F.col("h") + 1).cast("long").alias("depth"), "a", "b", "words")
    return first.unionByName(own), convs.select("conv_id", "size")


def places_of(rows: DataFrame) -> DataFrame:
    """(conv, size, depth, name, words, total): the name and the words of each prefix."""
    tagged = rows.select(
        F.col("conv_id").alias("conv"), "size", "depth", "words",
        F.xxhash64("depth", "a", "b").alias("a"), F.xxhash64(F.lit("b"), "b", "a", "depth").alias("b"))
    run = blocked.running(tagged.withColumnsRenamed({"a": "ta", "b": "tb"}), ["conv"], ["depth"], blocked.block_of("depth", RUN),
                          {"a": ("xor", F.col("ta")), "b": ("xor", F.col("tb")), "total": ("sum", F.col("words"))}, inclusive=True)
    return run.select("conv", "size", "depth", _name(F.col("a"), F.col("b")).alias("name"), "words", "total")


def fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] with the most trailing zero bits."""
    shift = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high, shift), shift)


def _at(places: DataFrame, rows: DataFrame, conv: str, depth: str, name: str) -> DataFrame:
    """``rows`` with the name of the prefix of ``depth`` turns of ``conv``, null if it has fewer."""
    return rows.join(places.select(F.col("conv").alias(conv), F.col("depth").alias(depth), F.col("name").alias(name)), [conv, depth], "left")


def _by_name(rows: DataFrame, nodes: DataFrame, on: list[str]) -> DataFrame:
    """Left join; rows without a key are spread over all tasks."""
    key = F.coalesce(F.col(on[-1]), _name(F.col("conv"), F.lit(-1).cast("long")))
    return rows.withColumn(on[-1], key).join(nodes, on, "left")


def locate(pending: DataFrame, places: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv, size, seat, seat_name): the deepest node that is a prefix of each conversation.

    Fat binary search between the last known node and the conversation's end.
    """
    grips = nodes.where("extent > 0").select(
        F.col("handle").alias("probe"), F.col("grip").alias("probe_name"),
        F.struct("extent", "name", "low", "up").alias("hit"))
    search = pending.select("*", F.col("seat").alias("lo"), F.col("size").alias("hi"), F.lit(None).cast(grips.schema["hit"].dataType).alias("found"))
    done = []
    while True:
        search = search.withColumn("probe", fattest(F.col("lo"), F.col("hi")))
        search = _by_name(_at(places, search, "conv", "probe", "probe_name"), grips, ["probe", "probe_name"])
        search = kept(search.select(
            "conv", "size", "seat", "seat_name", F.coalesce("hit.extent", "lo").alias("lo"),
            F.when(F.col("hit").isNull(), F.col("probe") - 1).otherwise(F.col("hi")).alias("hi"), F.coalesce("hit", "found").alias("found")), "search")
        done.append(search.where("lo >= hi"))
        search = search.where("lo < hi")
        if search.isEmpty():
            break
    state = reduce(DataFrame.unionByName, done)
    # The last node found is a prefix itself, or the conversation leaves the trie within its edge.
    state = _at(places, state.withColumn("last", F.coalesce("found.extent", F.lit(-1))), "conv", "last", "own")
    some, whole = F.col("found").isNotNull(), F.coalesce(F.col("own") == F.col("found.name"), F.lit(False))
    return state.select("conv", "size", *[
        F.when(some & whole, F.col(f"found.{here}")).when(some, F.col(f"found.{above}")).otherwise(F.col(seat)).alias(seat)
        for seat, here, above in (("seat", "extent", "low"), ("seat_name", "name", "up"))])


def exits(located: DataFrame, places: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds where each conversation parts from the edge below its node: ``next_name`` (of one more turn),
    ``parts`` and ``parts_name`` (the depth up to which it follows the edge), and the edge's node
    (``c_*``), null if no edge starts with its next turn."""
    edges = nodes.where("extent > 0").select(
        F.col("first").alias("next_name"), *[F.col(c).alias(f"c_{c}") for c in ("name", "extent", "rep")])
    rows = _at(places, located.where("size > seat").withColumn("next", F.col("seat") + 1), "conv", "next", "next_name")
    rows = kept(_by_name(rows, edges, ["next_name"]).drop("next"), "edges")
    on_edge = rows.where(F.col("c_name").isNotNull()).select("conv", "seat", "c_rep", F.least("c_extent", "size").alias("last"))
    steps = places.select("conv", "depth", "name").join(on_edge, "conv").where((F.col("depth") > F.col("seat")) & (F.col("depth") <= F.col("last")))
    same = steps.join(places.select(F.col("conv").alias("c_rep"), "depth", "name"), ["c_rep", "depth", "name"], "left_semi")
    reached = same.groupBy("conv").agg(F.max(F.struct("depth", "name")).alias("reached"))
    return rows.join(reached, "conv", "left").select(
        "*", F.coalesce("reached.depth", "seat").alias("parts"), F.coalesce("reached.name", "seat_name").alias("parts_name")).drop("reached")


def filled(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """Nodes (low, up, extent, rep) with their names: of the whole, of the handle and of the first turn."""
    handle = fattest(F.col("low"), F.col("extent"))
    asked = nodes.select("low", "up", "extent", "rep", handle.alias("handle"), F.explode(F.array(
        F.struct(F.lit("name").alias("kind"), F.col("extent").alias("depth")), F.struct(F.lit("grip").alias("kind"), handle.alias("depth")),
        F.struct(F.lit("first").alias("kind"), (F.col("low") + 1).alias("depth")))).alias("ask"))
    found = asked.select("*", "ask.kind", "ask.depth").join(
        places.select(F.col("conv").alias("rep"), "depth", F.col("name").alias("found")), ["rep", "depth"])
    return found.groupBy("rep", "extent", "low", "up", "handle").agg(
        *[F.max(F.when(F.col("kind") == kind, F.col("found"))).alias(kind) for kind in ("name", "grip", "first")])


_NODE = ["name", "extent", "low", "up", "handle", "grip", "first", "rep"]


def insert(left: DataFrame, places: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One batch: the nodes with split edges and new leaves, and the conversations still to come."""
    cut = left.where(F.col("c_name").isNotNull() & (F.col("parts") < F.col("c_extent")))
    cuts = cut.select(F.col("c_name").alias("edge"), F.col("parts").alias("extent"), F.col("parts_name").alias("own")).distinct()
    edges = nodes.join(cuts.select(F.col("edge").alias("name")).distinct(), "name", "left_semi")
    marks = cuts.unionByName(edges.select(F.col("name").alias("edge"), "extent", F.col("name").alias("own")))
    marks = blocked.running(marks, ["edge"], ["extent"], blocked.block_of("extent", RUN), {"before": ("max", F.struct("extent", "own"))})
    of = edges.select(F.col("name").alias("edge"), F.col("low").alias("e_low"), F.col("up").alias("e_up"), "rep")
    pieces = marks.join(of, "edge").select(
        F.coalesce("before.extent", "e_low").alias("low"), F.coalesce("before.own", "e_up").alias("up"), "extent", "rep")
    # Who goes on past the place where it parts asks for a leaf there; a hash decides between equals.
    on = left.where((F.col("size") > F.col("parts")) & (F.col("c_name").isNull() | (F.col("parts") < F.col("c_extent"))))
    on = _at(places, on.withColumn("after", F.col("parts") + 1), "conv", "after", "branch")
    leaves = on.groupBy("branch").agg(F.min(F.struct(F.xxhash64("conv").alias("h"), "conv", "size", "parts", "parts_name")).alias("l"))
    leaves = kept(leaves.select(F.col("l.parts").alias("low"), F.col("l.parts_name").alias("up"), F.col("l.size").alias("extent"), F.col("l.conv").alias("rep")), "leaves")
    new = filled(pieces.unionByName(leaves), places)
    grown = nodes.join(cuts.select(F.col("edge").alias("name")).distinct(), "name", "left_anti").select(_NODE).unionByName(new.select(_NODE))
    rest = left.where("size > parts").join(leaves.select(F.col("rep").alias("conv")), "conv", "left_anti").select(
        "conv", "size", F.col("parts").alias("seat"), F.col("parts_name").alias("seat_name"))
    return kept(grown, "nodes"), kept(rest, "pending")


def build(pending: DataFrame, places: DataFrame) -> DataFrame:
    """The compacted nodes, root included, over different conversations (conv, size)."""
    spark = places.sparkSession
    none = "struct<a:long,b:long>"
    nodes = spark.range(1).select(
        _root().alias("name"), F.lit(0).cast("long").alias("extent"), F.lit(-1).cast("long").alias("low"), F.lit(None).cast(none).alias("up"),
        F.lit(None).cast("long").alias("handle"), F.lit(None).cast(none).alias("grip"), F.lit(None).cast(none).alias("first"), F.lit(None).cast("long").alias("rep"))
    pending = pending.select("conv", "size", F.lit(0).cast("long").alias("seat"), _root().alias("seat_name"))
    located = pending
    while not pending.isEmpty():
        left = kept(exits(located, places, nodes), "exits")
        nodes, pending = insert(left, places, nodes)
        if pending.isEmpty():
            break
        here = kept(places.join(pending.select("conv"), "conv", "left_semi"), "here")
        located = locate(pending, here, nodes)
    return nodes


def summed(nodes: DataFrame, sums: list[str], least: list[str]) -> DataFrame:
    """Each of the columns over whole subtrees, by pointer doubling along ``up``."""
    folds = [*[F.sum(c).alias(f"s_{c}") for c in sums], *[F.min(c).alias(f"s_{c}") for c in least]]
    state = kept(nodes.select("name", F.col("up").alias("far"), *sums, *least), "sums")
    while state.where(F.col("far").isNotNull()).limit(1).count():
        below = kept(state.where(F.col("far").isNotNull()).groupBy(F.col("far").alias("name")).agg(*folds, F.count("*").alias("copies")), "below")
        jumps = below.select("name", "copies").join(state.select("name", F.col("far").alias("next")), "name").withColumnRenamed("name", "far")
        moved = spread_join(state.where(F.col("far").isNotNull()), jumps, ["far"], "copies", ["name"]).withColumn("far", F.col("next"))
        moved = moved.select(state.columns).unionByName(state.where(F.col("far").isNull()))
        state = kept(moved.join(below, "name", "left").select(
            "name", "far", *[(F.col(c) + F.coalesce(f"s_{c}", F.lit(0))).alias(c) for c in sums], *[F.least(c, f"s_{c}").alias(c) for c in least]), "sums")
    return state.drop("far")


def end_digests(ends: DataFrame) -> DataFrame:
    """(name, ends): SHA-256 of the ids that end at each node, ascending and joined by commas.

    Ids are joined in ranges of 65,536, and the ranges of a node pass through its hash in order."""
    parts = ends.groupBy("name", F.floor(F.col("conv_id") / 65_536).alias("range")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            names, out = [], []
            for name, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if name == now:
                    state.update(b",")
                else:
                    if state:
                        names.append(now)
                        out.append(state.hexdigest())
                    now, state = name, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, batch.column("name").type), pa.array(out, pa.string())], ["name", "ends"])
        if state:
            kind = pa.struct([("a", pa.int64()), ("b", pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([state.hexdigest()])], ["name", "ends"])

    ordered = parts.repartition("name").sortWithinPartitions("name", "range").select("name", "ids")
    return ordered.mapInArrow(digests, "name struct<a:long,b:long>, ends string")


def prefix_nodes(conversations: DataFrame) -> DataFrame:
    """One row per different prefix: conv_id (the smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    rows, sizes = rebuilt(turns_of(conversations))
    places = kept(places_of(rows), "places")
    last = places.where("depth = size").select(F.col("conv").alias("conv_id"), "size", "name", "total")
    ends = kept(last.unionByName(sizes.where("size = 0").select("conv_id", "size", _root().alias("name"), F.lit(0).cast("long").alias("total"))), "ends")
    classes = kept(ends.groupBy("name", "size", "total").agg(F.count("*").alias("members"), F.min("conv_id").alias("conv")), "classes")
    known = classes.where("size > 0").select("conv", "size")
    # Copies of a conversation are one from here on.
    places = kept(spread_join(places.drop("size"), known, ["conv"], "size", ["depth"]).select("conv", "depth", "name", "words", "total"), "prefixes")
    nodes = build(known, places)

    def total(rows: DataFrame, depth: str, name: str) -> DataFrame:
        found = places.select(F.col("conv").alias("rep"), F.col("depth").alias(depth), F.col("total").alias(name))
        return rows.join(found, ["rep", depth], "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))

    zero = F.lit(0).cast("long")
    children = nodes.groupBy(F.col("up").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = total(total(nodes.select("name", "extent", "low", "up", "rep"), "extent", "t_last"), "low", "t_first")
    nodes = nodes.join(children, "name", "left").join(classes.select("name", "members", F.col("conv").alias("conv_id")), "name", "left")
    nodes = kept(nodes.withColumns({
        "n_children": F.coalesce("n_children", zero), "n_convs": F.coalesce("members", zero), "width": F.col("t_last") - F.col("t_first")}).withColumns({
        "n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "member_words": F.col("n_convs") * F.col("t_last"), "widths": F.col("width")}), "nodes")
    sums = summed(nodes, ["n_convs", "n_leaves", "member_words", "widths"], ["conv_id"])
    nodes = kept(nodes.drop("n_convs", "n_leaves", "member_words", "widths", "conv_id").join(sums, "name"), "nodes")
    nodes = nodes.where(F.col("conv_id").isNotNull())  # an empty table has no root
    parents = nodes.where("n_children > 0").select(F.col("name").alias("up"), F.col("conv_id").alias("up_conv"), F.col("n_children").alias("copies"))
    below = F.col("member_words") - F.col("n_convs") * F.col("t_last") - (F.col("widths") - F.col("width"))
    root = nodes.where("extent = 0").withColumn("up_conv", F.lit(None).cast("long"))
    inner = spread_join(nodes.where("extent > 0"), parents, ["up"], "copies", ["name"]).drop("copies")
    nodes = root.unionByName(inner).join(end_digests(ends.select("name", "conv_id")), "name", "left").withColumn("below", below)
    block = F.explode(F.sequence(F.floor((F.col("low") + 1) / EDGE), F.floor(F.col("extent") / EDGE)))
    edges = nodes.where("extent > 0").withColumn("block", block).withColumnRenamed("rep", "conv")
    steps = places.withColumn("block", F.floor(F.col("depth") / EDGE)).select("conv", "block", "depth", "words", "total")
    expanded = steps.join(edges, ["conv", "block"]).where((F.col("depth") > F.col("low")) & (F.col("depth") <= F.col("extent")))
    root = nodes.where("extent = 0").withColumns({"depth": zero, "words": zero, "total": zero})
    every = ["conv_id", "depth", "low", "extent", "up_conv", "n_convs", "n_children", "n_leaves", "below", "t_last", "words", "total", "ends"]
    out, at_end = expanded.select(every).unionByName(root.select(every)), F.col("depth") == F.col("extent")
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("low") + 1, F.col("up_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs", F.when(at_end, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves",
        (F.col("below") + (F.col("n_convs") - 1) * (F.col("t_last") - F.col("total") + F.col("words"))).alias("saved_tokens"),
        F.when(at_end & F.col("ends").isNotNull(), F.col("ends")).otherwise(NO_ENDS).alias("ends_sha256"))


def oracle_sql() -> str:
    return r"""
    WITH turns AS (SELECT conv_id AS c, turn, coalesce(text, '') AS text, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS x
        FROM conversations WHERE conv_id IS NOT NULL),
    lists AS (SELECT c, list({'x': x, 'w': len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))} ORDER BY turn NULLS FIRST, sha256(x)) AS l FROM turns GROUP BY c),
    heads AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)),
        lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT) % 4 AS h FROM lists),
    full_lists AS (SELECT i.c, list_concat(coalesce(b.l[1:i.h], []), i.l[i.h + 1:]) AS l FROM heads i LEFT JOIN lists b ON b.c = i.c - i.c % 20),
    prefixes AS (SELECT c, d, l[1:d] AS k, len(l) = d AS ends FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM full_lists)),
    nodes AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '') AS ids FROM prefixes GROUP BY d, k),
    linked AS (SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.k = n.k[1:n.d - 1]),
    children AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
    below AS (SELECT e AS d, k[1:e] AS k, sum(leaf) AS n_leaves, sum(saved) AS saved FROM
        (SELECT n.k, CASE WHEN c.n IS NULL THEN 1 ELSE 0 END AS leaf, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * n.k[n.d].w END AS saved, unnest(range(0, n.d + 1)) AS e
         FROM nodes n LEFT JOIN children c USING (d, k)) GROUP BY 1, 2)
    SELECT conv_id, d AS depth, parent_conv_id, n_convs, coalesce(c.n, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
        CAST(saved AS BIGINT) AS saved_tokens, sha256(ids) AS ends_sha256
    FROM linked LEFT JOIN children c USING (d, k) JOIN below USING (d, k)"""
