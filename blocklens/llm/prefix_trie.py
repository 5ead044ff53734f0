"""Prefix trie of conversations, built as a distributed z-fast trie.

A conversation is its sequence of turns (role, text).  Every prefix has a
128-bit hash, the XOR of its turns' hashes salted by their places, so equal
prefixes are equal hashes and no text is moved.

* *Nodes.*  The trie is compacted: a node is the end of a conversation or a
  place where conversations part; its edge spans depths (p, e].  The node's
  handle is the prefix at the 2-fattest depth of the edge (the number in
  (p, e] that the highest power of two divides); a table keyed by (depth, hash)
  of the handles is the dictionary.
* *Locating.*  A conversation's exit node is found by fat binary search: probe
  the 2-fattest depth of what is left of its length, go on behind the node's
  end on a hit, before the probed depth on a miss.  That takes a logarithm of
  its length in joins, each with one row a conversation.  A second dictionary,
  of first turns of edges, gives the edge that is left half-way.
* *Batches.*  All pending conversations are located at once.  Edges are split
  wherever some leave them, and of those that leave at one place by one turn a
  random one (by hash) is inserted as a leaf; the others go into the next
  batch.  The number of batches is logarithmic in the conversations, whatever
  the shape of the trie.
* *Totals.*  Members, leaves and saved text of subtrees are summed by pointer
  doubling over the compacted nodes, then edges are expanded to one row a depth.

A row holds at most ``CHUNK`` prefixes: a longer conversation is one row per
``CHUNK`` depths, and the depths at multiples of ``CHUNK`` are nodes of their
own.  Turns are numbered by a range sort of small rows, so a conversation with
a third of all turns is never in one task; equal conversations are one row
before any batch.  Dictionaries are broadcast only up to a measured size.

Defined results: rows without a conv_id belong to no conversation and are
left out; null role or text counts as empty; a null turn comes first; turns
of one number follow in the order of their hashes; a repeated row is a turn of
its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blocklens.llm.common import drop_stage, session, stage
from blocklens.operators.ordinals import dense_ordinal

#: prefixes that one row holds (24 bytes each)
CHUNK = 4096
#: dictionaries are broadcast up to this many prefixes in all (24 bytes each: 12 MB)
BROADCAST_PREFIXES = 500_000
#: ids of a node's ends that one row holds as text
LIST_IDS = 50_000
KEY = ["e", "e1", "e2"]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] with the most trailing zero bits; needs low < high."""
    shift = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high, shift), shift)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, h1, h2, chars): turns by their place in the conversation, from 0."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        "conv_id", "turn", F.xxhash64(role, text).alias("h1"),
        F.xxhash64(F.lit(11), text, role).alias("h2"), F.char_length(text).cast("long").alias("chars"))
    # identical rows may change places; the number only lets a range cut them apart
    rows = stage(rows.withColumn("tie", F.monotonically_increasing_id()), "turns")
    rows = stage(dense_ordinal(rows, ["conv_id", "turn", "h1", "h2", "tie"], "ord"), "ordered-turns")
    first = rows.groupBy("conv_id").agg(F.min("ord").alias("first"))
    return stage(rows.join(first, "conv_id").select(
        "conv_id", (F.col("ord") - F.col("first")).alias("pos"), "h1", "h2", "chars"), "turns-at")


def share_openings(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the opening of the first of each ``group`` of ids.

    (conv_id, length) and (conv_id, depth, h1, h2, chars) of conversations that
    begin with the first h turns of conversation c - c % group and go on with
    their own turns after the first h; h is crc32(c) % ``most``.
    """
    c = F.col("conv_id")
    sizes = stage(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size")), "conversations")
    convs = sizes.withColumn("h", F.crc32(c.cast("string")) % most).withColumn(
        "base", c - c % F.lit(group).cast("long"))
    of_base = sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    convs = convs.join(of_base, "base", "left").withColumn(
        "opening", F.least("h", F.coalesce("base_size", F.lit(0).cast("long"))))
    convs = stage(convs.select("conv_id", "h", "base", "opening", (
        F.col("opening") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("length")), "openings")
    own = turns.join(convs.select("conv_id", "h", "opening"), "conv_id").where("pos >= h").select(
        "conv_id", (F.col("opening") + F.col("pos") - F.col("h") + 1).alias("depth"), "h1", "h2", "chars")
    start = turns.where(F.col("pos") < most).withColumnRenamed("conv_id", "base")
    start = start.join(convs.where("opening > 0").select("conv_id", "base", "opening"), "base") \
        .where("pos < opening").select("conv_id", (F.col("pos") + 1).alias("depth"), "h1", "h2", "chars")
    return convs.select("conv_id", "length"), own.unionByName(start)


def prefix_rows(steps: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, a, k1, k2, kd, path): up to ``chunk`` prefixes of a conversation.

    ``path`` holds (p1, p2, d) for depths a + 1, a + 2, ...: the prefix's hash
    and its code points; k1, k2 and kd are those of depth a.
    """
    depth = F.col("depth")
    rows = steps.select("conv_id", "depth", F.floor((depth - 1) / chunk).alias("part"), "chars",
                        F.xxhash64(depth, "h1", "h2").alias("g1"),
                        F.xxhash64(depth, "h2", "h1", F.lit(7)).alias("g2"))
    within = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("conv_id", "part", "depth", F.bit_xor("g1").over(within).alias("p1"),
                       F.bit_xor("g2").over(within).alias("p2"), F.sum("chars").over(within).alias("d"))
    paths = rows.groupBy("conv_id", "part").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("depth", "p1", "p2", "d"))),
        lambda x: F.struct(x["p1"].alias("p1"), x["p2"].alias("p2"), x["d"].alias("d"))).alias("path"))
    paths = stage(paths, "paths")
    # what the chunks before add; a conversation of n turns has n / chunk rows here
    ends = paths.select("conv_id", "part", F.element_at("path", -1).alias("end"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    long = ends.where("part > 0").select("conv_id").distinct()
    added = ends.join(long, "conv_id", "left_semi").select(
        "conv_id", "part", F.bit_xor("end.p1").over(before).alias("k1"),
        F.bit_xor("end.p2").over(before).alias("k2"), F.sum("end.d").over(before).alias("kd"))
    zero = F.lit(0).cast("long")
    later = paths.where("part > 0").join(added, ["conv_id", "part"]).withColumn(
        "path", F.transform("path", lambda x: F.struct(
            x["p1"].bitwiseXOR(F.col("k1")).alias("p1"), x["p2"].bitwiseXOR(F.col("k2")).alias("p2"),
            (x["d"] + F.col("kd")).alias("d"))))
    first = paths.where("part = 0").select("*", zero.alias("k1"), zero.alias("k2"), zero.alias("kd"))
    return first.unionByName(later).select(
        "conv_id", (F.col("part") * chunk).alias("a"), "k1", "k2", "kd", "path")


def _at(path: Column, a: Column, depth: Column, field: str) -> Column:
    """A field of the prefix at ``depth`` of a path that begins behind depth ``a``."""
    return F.get(path, (depth - a - 1).cast("int"))[field]


def _handles(nodes: DataFrame) -> DataFrame:
    """The dictionary of handles: (f, f1, f2) and the node's key and edge start."""
    f = two_fattest(F.col("p"), F.col("e"))
    return nodes.select(f.alias("f"), _at(F.col("path"), F.col("p"), f, "p1").alias("f1"),
                        _at(F.col("path"), F.col("p"), f, "p2").alias("f2"),
                        *[F.col(c).alias(f"n_{c}") for c in ("p", *KEY)])


def _located(pending: DataFrame, nodes: DataFrame, steps: int, small: bool) -> DataFrame:
    """Where every pending path leaves the trie: its edge, if any (p, key, edge),
    and the depth m of the last prefix that it shares with the trie."""
    hint = (lambda df: F.broadcast(df)) if small else (lambda df: df.hint("merge"))
    a, path = F.col("a"), F.col("path")
    state = pending.select("*", a.alias("lo"), F.col("b").alias("hi"), *[
        F.lit(None).cast("long").alias(f"c_{c}") for c in ("p", *KEY)])
    handles = _handles(nodes)
    for _ in range(steps):
        f = F.when(F.col("lo") < F.col("hi"), two_fattest(F.col("lo"), F.col("hi")))
        state = state.withColumn("probe", f)
        on = (state["probe"] == handles["f"]) & (_at(path, a, state["probe"], "p1") == handles["f1"]) & (
            _at(path, a, state["probe"], "p2") == handles["f2"])
        hit = F.col("n_e").isNotNull()
        state = state.join(hint(handles), on, "left").select(
            *pending.columns, F.when(hit, F.least("n_e", "hi")).otherwise(F.col("lo")).alias("lo"),
            F.when(F.col("probe").isNotNull() & ~hit, F.col("probe") - 1).otherwise(F.col("hi")).alias("hi"),
            *[F.when(hit, F.col(f"n_{c}")).otherwise(F.col(f"c_{c}")).alias(f"c_{c}") for c in ("p", *KEY)])
    # the node found last may end beyond what the path shares with its edge
    none = F.col("c_e").isNull()
    whole = none | ((F.col("c_e") <= F.col("b")) & (_at(path, a, F.col("c_e"), "p1") == F.col("c_e1"))
                    & (_at(path, a, F.col("c_e"), "p2") == F.col("c_e2")))
    state = state.withColumn("start", F.when(whole, F.coalesce("c_e", "a")).otherwise(F.col("c_p")))
    starts = nodes.select(F.col("p").alias("n_p"), F.get("path", 0)["p1"].alias("s1"),
                          F.get("path", 0)["p2"].alias("s2"), F.col("path").alias("edge"),
                          *[F.col(c).alias(f"n_{c}") for c in KEY])
    on = (state["start"] == starts["n_p"]) & (_at(path, a, state["start"] + 1, "p1") == starts["s1"]) & (
        _at(path, a, state["start"] + 1, "p2") == starts["s2"])
    shared = F.size(F.filter("edge", lambda x, i: F.coalesce(
        (x["p1"] == _at(path, a, F.col("n_p") + 1 + i, "p1"))
        & (x["p2"] == _at(path, a, F.col("n_p") + 1 + i, "p2")), F.lit(False))))
    return state.join(hint(starts), on, "left").select(
        *pending.columns, "n_p", *[f"n_{c}" for c in KEY],
        F.when(F.col("n_e").isNull(), F.col("start")).otherwise(F.col("n_p") + shared).alias("m"))


def _leaves(leaving: DataFrame) -> DataFrame:
    """One new leaf for every place and turn by which paths leave, with its item."""
    a, m, path = F.col("a"), F.col("m"), F.col("path")
    here = lambda field, key: F.when(m == a, F.col(key)).otherwise(_at(path, a, m, field))
    leaf = F.struct(
        F.col("item"), F.col("b").alias("e"), F.element_at("path", -1)["p1"].alias("e1"),
        F.element_at("path", -1)["p2"].alias("e2"), m.alias("p"), here("p1", "k1").alias("q1"),
        here("p2", "k2").alias("q2"), here("d", "kd").alias("pd"),
        F.slice("path", (m - a + 1).cast("int"), (F.col("b") - m).cast("int")).alias("path"))
    return leaving.groupBy(m, _at(path, a, m + 1, "p1"), _at(path, a, m + 1, "p2")).agg(
        F.min_by(leaf, F.xxhash64("item")).alias("leaf")).select("leaf.*")


def _split(nodes: DataFrame, cuts: DataFrame) -> DataFrame:
    """``nodes`` with the edges of ``cuts`` (key, m) cut at their depths m."""
    marks = cuts.groupBy(*[f"n_{c}" for c in KEY]).agg(
        F.sort_array(F.collect_set("m")).alias("marks"))        # at most an edge's depths
    on = nodes["e"] == F.col("n_e")
    for c in ("e1", "e2"):
        on = on & (nodes[c] == F.col(f"n_{c}"))
    joined = nodes.join(marks, on, "left")
    same = joined.where("marks is null").select(nodes.columns)
    ends = F.concat("marks", F.array("e"))
    low, high, p = F.col("low"), F.col("high"), F.col("p")
    pieces = joined.where("marks is not null").select("*", F.posexplode(ends).alias("i", "high")).withColumn(
        "low", F.when(F.col("i") == 0, p).otherwise(F.get("marks", F.col("i") - 1)))
    at = lambda depth, field: _at(F.col("path"), p, depth, field)
    first = low == p
    return same.unionByName(pieces.select(
        high.alias("e"), at(high, "p1").alias("e1"), at(high, "p2").alias("e2"), low.alias("p"),
        F.when(first, F.col("q1")).otherwise(at(low, "p1")).alias("q1"),
        F.when(first, F.col("q2")).otherwise(at(low, "p2")).alias("q2"),
        F.when(first, F.col("pd")).otherwise(at(low, "d")).alias("pd"),
        F.slice("path", (low - p + 1).cast("int"), (high - low).cast("int")).alias("path")))


def build(paths: DataFrame) -> DataFrame | None:
    """The compacted nodes (e, e1, e2, p, q1, q2, pd, path) of the trie of all
    ``paths`` (rows of :func:`prefix_rows`), staged; None without paths.

    e1, e2 are the hash of the node's prefix, q1, q2 that of its parent's, pd
    the code points up to depth p, path the prefixes of the edge.
    """
    end = F.element_at("path", -1)
    items = paths.select("a", "k1", "k2", "kd", "path", (F.col("a") + F.size("path")).alias("b"),
                         end["p1"].alias("b1"), end["p2"].alias("b2"))
    # equal paths are one: what their last prefix says of all before
    items = items.dropDuplicates(["a", "b", "b1", "b2"]).drop("b1", "b2")
    pending = stage(items.withColumn("item", F.monotonically_increasing_id()), "pending")
    left, longest = pending.agg(F.count(F.lit(1)), F.max(F.col("b") - F.col("a"))).first()
    if not left:
        return None
    steps = int(longest).bit_length()
    nodes, prefixes = None, 0
    while left:
        if nodes is None:
            found = pending.withColumn("m", F.col("a"))
        else:
            found = stage(_located(pending, nodes, steps, prefixes <= BROADCAST_PREFIXES), "located")
        leaving = found.where("m < b")
        leaves = stage(_leaves(leaving), "leaves")
        fresh = leaves.drop("item")
        if nodes is not None:
            cuts = found.where("m < n_e").select("m", *[f"n_{c}" for c in KEY]).distinct()
            fresh = fresh.unionByName(_split(nodes, cuts))
        old, nodes = nodes, stage(fresh, "nodes")
        prefixes = nodes.agg(F.sum(F.size("path"))).first()[0]
        rest = leaving.select(*pending.columns).join(
            leaves.select("item").hint("shuffle_hash"), "item", "left_anti")
        gone, pending = pending, stage(rest, "pending")
        left = pending.count()
        for table in [t for t in (gone, old, leaves, found if old is not None else None) if t is not None]:
            drop_stage(table)
    return nodes


def _subtrees(own: DataFrame) -> DataFrame:
    """Totals of every node's subtree by pointer doubling.

    ``own`` (id, up, n, dsum, chars, leaves, conv) has each node's own values
    and its parent's id; the same columns come back summed (conv: the least).
    """
    sums = ["n", "dsum", "chars", "leaves"]
    table = stage(own, "subtrees")
    while table.where("up is not null").limit(1).count():
        add = table.where("up is not null").groupBy(F.col("up").alias("to")).agg(
            *[F.sum(c).alias(f"add_{c}") for c in sums], F.min("conv").alias("add_conv"))
        jump = table.where("up is not null").select(F.col("id").alias("via"), F.col("up").alias("far"))
        new = table.join(add, table["id"] == add["to"], "left").select(
            "id", "up", *[(F.col(c) + F.coalesce(f"add_{c}", F.lit(0))).alias(c) for c in sums],
            F.least("conv", "add_conv").alias("conv"))
        new = new.join(jump, new["up"] == jump["via"], "left").select(
            "id", F.col("far").alias("up"), *sums, "conv")
        old, table = table, stage(new, "subtrees")
        drop_stage(old)
    return table


def _lists(batches):
    """Sorted (id, conv_id) -> (id, first, ids): comma-joined runs of a node's ids."""
    held, node, first = [], None, None

    def out():
        return pa.RecordBatch.from_pydict({
            "id": pa.array([node], pa.int64()), "first": pa.array([first], pa.int64()),
            "ids": pa.array([",".join(map(str, held))], pa.string())})

    for batch in batches:
        for i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held and (i != node or len(held) >= LIST_IDS):
                yield out()
                held = []
            if not held:
                node, first = i, c
            held.append(c)
    if held:
        yield out()


def _hashed(batches):
    """Sorted (id, first, ids) -> (id, sha): a running SHA-256 over each node's runs."""
    node, sha = None, None
    ids, shas = [], []

    def out():
        return pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "sha": pa.array(shas, pa.string())})

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if sha is not None and i == node:
                sha.update(b"," + text.encode())
                continue
            if sha is not None:
                ids.append(node)
                shas.append(sha.hexdigest())
            node, sha = i, hashlib.sha256(text.encode())
            if len(ids) >= 10_000:
                yield out()
                ids, shas = [], []
    if sha is not None:
        ids.append(node)
        shas.append(sha.hexdigest())
    if ids:
        yield out()


def ends_digests(ends: DataFrame) -> DataFrame:
    """(id, sha): SHA-256 of a node's conv_ids, ascending, comma-joined.

    Ids are joined where they lie after a range sort; what one task then runs
    through for a node are these runs, one after the other.
    """
    runs = ends.select("id", "conv_id").repartitionByRange("id", "conv_id").sortWithinPartitions(
        "id", "conv_id").mapInArrow(_lists, "id long, first long, ids string")
    return runs.repartition("id").sortWithinPartitions("id", "first").mapInArrow(
        _hashed, "id long, sha string")


def trie_nodes(lengths: DataFrame, steps: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per distinct prefix of the conversations (conv_id, length) with the
    turns ``steps`` (conv_id, depth, h1, h2, chars): (conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    session(lengths)
    paths = stage(prefix_rows(steps, chunk), "prefixes")
    nodes = build(paths)
    zero = F.lit(0).cast("long")
    root = lengths.limit(1).select(zero.alias("e"), zero.alias("e1"), zero.alias("e2"),
                                   F.lit(-1).cast("long").alias("p"), zero.alias("q1"), zero.alias("q2"),
                                   zero.alias("pd"), F.lit(None).cast(paths.schema["path"].dataType).alias("path"))
    nodes = root if nodes is None else nodes.unionByName(root)
    nodes = stage(nodes.withColumn("id", F.monotonically_increasing_id()), "trie")
    last = F.element_at("path", -1)
    ends = paths.join(lengths, "conv_id").where(F.col("a") + F.size("path") == F.col("length")).select(
        "conv_id", F.col("length").alias("e"), last["p1"].alias("e1"), last["p2"].alias("e2"))
    ends = ends.unionByName(lengths.where("length = 0").select(
        "conv_id", zero.alias("e"), zero.alias("e1"), zero.alias("e2")))
    ends = stage(ends.join(nodes.select(*KEY, "id"), KEY).select("id", "conv_id"), "ends")
    here = ends.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv"))
    up = nodes.select(F.col("e").alias("p"), F.col("e1").alias("q1"), F.col("e2").alias("q2"),
                      F.col("id").alias("up"))
    # a root's p is no depth, so it finds no parent
    linked = nodes.join(up, ["p", "q1", "q2"], "left")
    linked = stage(linked.select("id", "up", "p", "e", "pd", "path", F.coalesce(
        last["d"], zero).alias("d")), "linked")
    children = stage(linked.where("up is not null").groupBy(F.col("up").alias("id")).agg(
        F.count(F.lit(1)).alias("children")), "children")
    own = linked.join(here, "id", "left").join(children, "id", "left").select(
        "id", "up", F.coalesce("n", zero).alias("n"), (F.coalesce("n", zero) * F.col("d")).alias("dsum"),
        (F.col("d") - F.col("pd")).alias("chars"),
        F.when(F.col("children").isNull(), 1).otherwise(0).cast("long").alias("leaves"), "conv")
    totals = _subtrees(own).drop("up")
    parent = totals.select(F.col("id").alias("up"), F.col("conv").alias("up_conv"))
    full = linked.join(totals, "id").join(parent, "up", "left").join(children, "id", "left") \
        .join(ends_digests(ends), "id", "left")
    rows = full.withColumn("depth", F.explode(F.sequence(F.col("p") + 1, F.col("e"))))
    depth, top = F.col("depth"), F.col("depth") == F.col("p") + 1
    before = F.when(top, F.col("pd")).otherwise(_at(F.col("path"), F.col("p"), depth - 1, "d"))
    below = F.col("chars") - (F.col("d") - F.col("pd"))       # of the nodes under the edge
    at_end = depth == F.col("e")
    return rows.select(
        F.col("conv").alias("conv_id"), "depth",
        F.when(top, F.col("up_conv")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(at_end, F.coalesce("children", zero)).otherwise(F.lit(1).cast("long")).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("dsum") - F.col("n") * before - below - (F.col("d") - before)).alias("saved_tokens"),
        F.when(at_end, F.coalesce("sha", F.lit(EMPTY_SHA))).otherwise(F.lit(EMPTY_SHA)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, group: int = 100, most: int = 6,
                      chunk: int = CHUNK) -> DataFrame:
    """The trie of ``conversations`` rebuilt by :func:`share_openings`."""
    session(conversations)
    lengths, steps = share_openings(numbered_turns(conversations), group, most)
    return trie_nodes(lengths, steps, chunk)
