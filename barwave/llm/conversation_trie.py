"""Prefix trie of conversations: blocks of several turns are hashed and grouped first, single turns only where siblings diverge."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwave.llm.common import attach, cut, n_words, running, shuffles

BLOCK = 4  # turns hashed as one
CHUNK = 4096  # ids of one node that are joined at a time


def added(a: Column, b: Column) -> Column:
    return a + b


def mixed(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv, pos, digest, words`` of ``conv_id, turn, role, text``: the place of each turn from 1, by turn, null first.

    Null role or text is empty. Turns that repeat a number follow the order of their digest, md5 of "<length of role>:<role><text>";
    rows equal in all that are turns of their own. Rows without a conv_id belong to no conversation and are left out. Other columns are ignored.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn", digest.alias("digest"), n_words(text).alias("words"), F.lit(1).alias("one"), F.monotonically_increasing_id().alias("row")
    )
    placed = running(cut(rows), ["conv"], ["turn", "digest", "row"], {"before": ("one", F.sum, added)})
    return cut(placed.select("conv", (F.col("before") + 1).alias("pos"), "digest", "words"))


def rebuilt_turns(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin alike: the first h turns of conversation c - c % ``every``, then c's own after its first h; h = crc32(c) % ``most``.

    ``turns`` has ``conv, pos, digest, words``. Returns ``conv, depth, digest, words`` and the table of all ``conv``, turnless ones
    too. Where the other conversation has fewer turns all of them are taken, where it is absent none.
    """
    convs = cut(turns.groupBy("conv").agg(F.count("*").alias("n_own")))
    shared = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h")
    base = convs.select(F.col("conv").alias("base"), F.col("n_own").alias("n_base"))
    plan = convs.select("conv", "n_own", shared, (F.col("conv") - F.col("conv") % every).alias("base")).join(base, "base", "left")
    plan = cut(plan.withColumn("n_head", F.least(F.col("h"), F.coalesce("n_base", F.lit(0)))))
    heads = turns.filter((F.col("conv") % every == 0) & (F.col("pos") < most)).withColumnRenamed("conv", "base")
    taken = plan.filter("n_head > 0").select("conv", "base", "h").join(heads, "base").filter("pos <= h").select("conv", F.col("pos").alias("depth"), "digest", "words")
    own = attach(turns, plan.select("conv", "n_own", "h", "n_head"), ["conv"], "n_own").filter("pos > h")
    own = own.select("conv", (F.col("pos") - F.col("h") + F.col("n_head")).alias("depth"), "digest", "words")
    return cut(taken.unionByName(own)), plan.select("conv")


def inner_nodes(blocks: DataFrame) -> DataFrame:
    """One row per turn of each block: ``depth``, the hash of the turns up to it (x, y) and before it (x0, y0), words before it and its own."""
    each = blocks.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("turns"))))
    before, turn = F.slice("turns", F.lit(1), F.col("i") - 1), F.element_at("turns", F.col("i"))
    x0, y0 = F.aggregate(before, F.col("px"), lambda a, t: a.bitwiseXOR(t["x"])), F.aggregate(before, F.col("py"), lambda a, t: a.bitwiseXOR(t["y"]))
    each = each.withColumns({"x0": x0, "y0": y0, "x": x0.bitwiseXOR(turn["x"]), "y": y0.bitwiseXOR(turn["y"])})
    words = F.aggregate(before, F.col("pw"), lambda a, t: a + t["words"])
    return each.withColumn("words_before", words).withColumn("words", turn["words"]).withColumn("depth", turn["depth"])


def trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """All nodes of the prefix trie of ``turns`` (``conv, depth, digest, words``; depth from 1 without gaps), and the conversations' ends.

    Nodes: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes in the
    subtree), ``saved_tokens`` (over the subtree: words of a node's last turn times members but one), and the hash ``x, y``. Ends: ``conv, depth, x, y``.

    A prefix is known by the exclusive-or of two 64-bit hashes of (place, digest) of its turns, so the hash of a long prefix is
    that of its blocks, and blocks of one conversation are hashed by different tasks. Blocks of ``block`` turns are grouped with those after the same prefix.
    Where all of them are equal, the nodes inside have the same members, and one of the blocks tells them. Only where they differ are turns grouped.
    A node belongs to its smallest member; a conversation owns its path from some depth on. With Q the words of a conversation
    above what it owns and W those before a node, the subtree saves sum(Q) - Q(owner) - (members - 1) * W, so sums over
    members, taken in the same two steps, give it without walking the tree. No step has one task per conversation, prefix or level.

    Without conversations there are no nodes; turnless ones are members of the root only.
    """
    hashed = turns.select(
        "conv", ((F.col("depth") - 1) / block).cast("long").alias("k"),
        F.struct("depth", F.xxhash64(F.lit(1), "depth", "digest").alias("x"), F.xxhash64(F.lit(2), "depth", "digest").alias("y"), "words").alias("turn"),
    )
    blocks = hashed.groupBy("conv", "k").agg(
        F.sort_array(F.collect_list("turn")).alias("turns"), F.bit_xor("turn.x").alias("bx"), F.bit_xor("turn.y").alias("by"), F.sum("turn.words").alias("bw")
    )
    totals = {"px": ("bx", F.bit_xor, mixed), "py": ("by", F.bit_xor, mixed), "pw": ("bw", F.sum, added)}
    blocks = cut(running(cut(blocks), ["conv"], ["k"], totals))

    sums = blocks.groupBy("conv").agg(F.sum(F.size("turns")).alias("depth"), F.bit_xor("bx").alias("x"), F.bit_xor("by").alias("y"), F.sum("bw").alias("all_words"), F.count("*").alias("n_blocks"))
    ends = cut(convs.join(sums, "conv", "left").select("conv", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("depth", "x", "y", "all_words", "n_blocks")]))

    prefix = ["k", "px", "py"]
    form = F.struct(F.size("turns").alias("size"), "bx", "by")
    groups = blocks.groupBy(*prefix).agg(F.count("*").alias("n"), F.min("conv").alias("owner"), F.min(form).alias("low"), F.max(form).alias("high"))
    groups = cut(groups.withColumn("calm", F.col("low") == F.col("high")).drop("low", "high"))
    calm = inner_nodes(blocks.join(groups.filter("calm").withColumnRenamed("owner", "conv"), [*prefix, "conv"]))
    calm = calm.select("depth", "x", "y", "x0", "y0", F.col("conv").alias("conv_id"), F.col("n").alias("n_convs"), "words", "words_before")
    shared = cut(attach(blocks, groups.filter("n > 1"), prefix, "n").filter("n > 1"))
    wild = inner_nodes(shared.filter("not calm")).groupBy("depth", "x", "y")
    wild = wild.agg(*[F.min(c).alias(c) for c in ("x0", "y0")], F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.min("words_before").alias("words_before"))
    zero = F.lit(0).cast("long")
    root = ends.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in ("depth", "x", "y", "x0", "y0")], "conv_id", "n_convs", zero.alias("words"), zero.alias("words_before"))
    n_ends = ends.groupBy("depth", "x", "y").agg(F.count("*").alias("n_ends"))
    nodes = calm.unionByName(wild).unionByName(root).join(n_ends, ["depth", "x", "y"], "left")
    nodes = cut(nodes.withColumn("leaf", F.when(F.col("n_ends") == F.col("n_convs"), 1).otherwise(0)).drop("n_ends"))

    owned = nodes.groupBy(F.col("conv_id").alias("conv")).agg(F.sum("words").alias("own_words"), F.max("leaf").alias("leaf"), F.count("*").alias("n_nodes"))
    facts = ends.join(owned, "conv", "left").select(
        "conv", "n_blocks", (F.col("all_words") - F.coalesce("own_words", zero)).alias("q"), F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("n_nodes", zero).alias("n_nodes")
    )
    facts = cut(facts)

    known = attach(shared, facts.select("conv", "n_blocks", "q", "leaf"), ["conv"], "n_blocks")
    over_members = [F.sum("leaf").alias("n_leaves"), F.sum("q").alias("sum_q"), F.min("conv").alias("conv_id")]
    calm_sums = known.filter("calm").groupBy(*prefix).agg(*over_members, F.min(F.size("turns")).alias("size"))
    calm_sums = calm_sums.withColumn("depth", F.explode(F.sequence(F.col("k") * block + 1, F.col("k") * block + F.col("size"))))
    wild_sums = inner_nodes(known.filter("not calm")).groupBy("depth", "x", "y").agg(*over_members)
    root_sums = facts.select(F.lit(0).cast("long").alias("depth"), "conv", "q", "leaf").groupBy("depth").agg(*over_members)
    columns = ["conv_id", "depth", "n_leaves", "sum_q"]
    member_sums = calm_sums.select(*columns).unionByName(wild_sums.select(*columns)).unionByName(root_sums.select(*columns))

    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("x0").alias("x"), F.col("y0").alias("y")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["depth", "x", "y"], "left").join(member_sums, ["conv_id", "depth"], "left")
    nodes = cut(nodes.withColumn("n_children", F.coalesce("n_children", zero)))
    parents = nodes.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    lower = attach(nodes.drop("n_children").filter("depth > 0"), parents.withColumnRenamed("n_children", "siblings"), ["depth", "x0", "y0"], "siblings")
    lower = lower.join(nodes.select("depth", "x", "y", "n_children"), ["depth", "x", "y"]).drop("siblings")
    nodes = lower.unionByName(nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    owners = facts.filter("n_nodes > 0").select(F.col("conv").alias("conv_id"), F.col("q").alias("own_q"), "n_nodes")
    nodes = attach(nodes, owners, ["conv_id"], "n_nodes")
    saved = F.coalesce(F.col("sum_q") - F.col("own_q") - (F.col("n_convs") - 1) * F.col("words_before"), zero)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), saved.alias("saved_tokens"), "x", "y"), ends.select("conv", "depth", "x", "y")


def joined_sha256(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``depth, x, y, ends_sha256``: SHA-256 (hex) of the decimal ids that end at a node, ascending, comma-joined.

    Ids are ranked over all tasks and joined by ``chunk``; a node of more than one chunk is hashed as a stream of its chunks, so no task holds all its ids.
    """
    node = ["depth", "x", "y"]
    ranked = running(ends.withColumn("one", F.lit(1)), node, ["conv"], {"before": ("one", F.sum, added)})
    parts = ranked.groupBy(*node, (F.col("before") / chunk).cast("long").alias("part")).agg(F.sort_array(F.collect_list("conv")).alias("ids"), F.count("*").alias("n_ids"))
    parts = cut(parts.select(*node, "part", "n_ids", F.array_join(F.transform("ids", lambda c: c.cast("string")), ",").alias("ids")))
    many = parts.filter((F.col("part") > 0) | (F.col("n_ids") == chunk)).drop("n_ids")
    one = parts.filter((F.col("part") == 0) & (F.col("n_ids") < chunk)).select(*node, F.sha2("ids", 256).alias("ends_sha256"))
    streamed = many.repartition(shuffles(many), *node).sortWithinPartitions(*node, "part").mapInArrow(stream_sha256, "depth long, x long, y long, ends_sha256 string")
    return one.unionByName(streamed)


def stream_sha256(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order of node and part; only the state of one node's hash is kept."""
    now, state = None, None
    for batch in batches:
        done = []
        for row in batch.select(["depth", "x", "y", "ids"]).to_pylist():
            node = (row["depth"], row["x"], row["y"])
            if node == now:
                state.update(b",")
            else:
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = node, hashlib.sha256()
            state.update(row["ids"].encode())
        yield as_batch(done)
    if now is not None:
        yield as_batch([(*now, state.hexdigest())])


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([("depth", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("ends_sha256", pa.string())])
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)


def conversation_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie of ``conversations`` (``conv_id, turn, role, text``) as they are, each node with the role and text of its last turn (root: null).

    Nulls, ties and odd rows as in ``ordered_turns``; an empty table has no node. A node's turns are those of ``conv_id`` up to ``depth``.
    """
    turns = ordered_turns(conversations)
    nodes, _ = trie(turns.withColumnRenamed("pos", "depth"), turns.select("conv").distinct(), block)
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    texts = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), digest.alias("digest"), role.alias("role"), text.alias("text")).dropDuplicates(["conv", "digest"])
    last = nodes.drop("x", "y").join(turns.select(F.col("conv").alias("conv_id"), F.col("pos").alias("depth"), "digest"), ["conv_id", "depth"], "left")
    return last.join(texts.withColumnRenamed("conv", "conv_id"), ["conv_id", "digest"], "left").drop("digest")


def rebuilt_trie(conversations: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """The trie of ``conversations`` rebuilt by ``rebuilt_turns``, with ``ends_sha256`` for the conversations that end at each node."""
    turns, convs = rebuilt_turns(ordered_turns(conversations))
    nodes, ends = trie(turns, convs, block)
    sealed = nodes.join(joined_sha256(ends, chunk), ["depth", "x", "y"], "left").drop("x", "y")
    return sealed.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


ORACLE_SQL = r"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
  crc AS (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v FROM (SELECT unnest(range(0, 256)) AS i)),
  m AS (SELECT list(v ORDER BY i) AS crc_of FROM crc),
  n AS (SELECT DISTINCT c FROM t),
  h AS (SELECT c, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
      lambda a, b: xor(a // 256, crc_of[xor(a, b) % 256 + 1])), 4294967295) % 4 AS h, c - c % 20 AS base FROM n, m),
  r AS (SELECT h.c, t.pos, 0 AS own, t.role, t.text FROM h JOIN t ON t.c = h.base AND t.pos <= h.h
    UNION ALL SELECT h.c, t.pos, 1, t.role, t.text FROM h JOIN t ON t.c = h.c AND t.pos > h.h),
  s AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS depth FROM r),
  p AS (SELECT c, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
      list({'role': role, 'text': text}) OVER (PARTITION BY c ORDER BY depth) AS path FROM s
    UNION ALL SELECT c, 0, 0, [] FROM n),
  g AS (SELECT depth, path, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM p GROUP BY depth, path),
  e AS (SELECT p.c, p.depth, g.conv_id FROM p JOIN g USING (depth, path)),
  z AS (SELECT conv_id, depth, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT e.*, max(depth) OVER (PARTITION BY c) AS last FROM e) WHERE depth = last GROUP BY ALL),
  u AS (SELECT g.conv_id, g.depth, up.conv_id AS parent_conv_id FROM g LEFT JOIN e AS up ON up.c = g.conv_id AND up.depth = g.depth - 1),
  k AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY ALL),
  b AS (SELECT up.conv_id, up.depth, sum((g.n_convs - 1) * g.words) AS saved_tokens, count(*) FILTER (WHERE k.n_children IS NULL) AS n_leaves
    FROM g JOIN e AS up ON up.c = g.conv_id AND up.depth <= g.depth LEFT JOIN k ON k.conv_id = g.conv_id AND k.depth = g.depth GROUP BY ALL)
SELECT g.conv_id, CAST(g.depth AS BIGINT) AS depth, u.parent_conv_id, g.n_convs, CAST(coalesce(k.n_children, 0) AS BIGINT) AS n_children,
  CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(z.ids, '')) AS ends_sha256
FROM g JOIN u USING (conv_id, depth) JOIN b USING (conv_id, depth) LEFT JOIN k USING (conv_id, depth) LEFT JOIN z USING (conv_id, depth)
"""
