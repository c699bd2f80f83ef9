"""Merkle manifest of a table and inclusion proofs by a recursive query.

``build`` turns every row into a leaf and stores two tables: ``leaves`` and
``nodes``. Rows are sorted by (group, id), so every node covers a run of leaf
numbers; a node is known by its level and the first leaf (in the trees of the
groups) or the first group (in the tree over their roots) below it. A node
row holds the link to its parent, its place among the parent's children and
the digests of its own children, of which there are at most ``FAN``.

``climb`` is one recursive query: every leaf starts with the digest to be
proved and meets, step by step, the node row that its link names; a step
folds the siblings found there with what it carries and appends them, by the
node row and the place they stand beside, to the path of the leaf. ``proofs``
writes the siblings of every path out.

All leaves end at one root, so links alone would bring the whole table to
one task. Leaves are dealt by (link, slot), a slot being ``SLOT`` consecutive
leaves, and node rows lie ready once per slot that they cover: about one row
for ``SLOT`` leaves and level beyond the nodes themselves. A step so moves
the small state of a leaf and never gathers more than ``SLOT`` of them, and
the siblings themselves (up to 15 digests a level and leaf) are never dealt:
paths meet the few node rows of their slot.

Digests are carried as 32 bytes and hashed as lower-case hex text.

Defined cases: a null column is ``-`` and an empty text ``0:``, so they
differ; groups are ordered null first, then bytewise, rows by id, null first,
then by leaf digest, so rows that share an id are separate leaves in a stable
order (equal rows are equal leaves, interchangeable); a group of one row is
its own subroot, a table of one row its own root, with the digest of nothing
as its proof; a null id is never tampered with; an empty table gives no rows;
other columns, whatever their names, take no part.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.ordered import with_global_index

from .common import staged, temporary

FAN = 16
SLOT = 512
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = 32  # levels of the tree over the groups are numbered from here
LEVEL_BITS = 57  # bits of a node's number below its level

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(value: Column) -> Column:
    """SHA-256 of a text or of bytes, as 32 bytes."""
    return F.unhex(F.sha2(value, 256))


def hex_text(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf_digest(columns: list[Column]) -> Column:
    """Digest of a row: of its values in turn, each with its length in bytes."""
    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return digest(F.concat(*[part(c) for c in columns]))


def _node(level: int, number: Column) -> Column:
    return F.lit(level << LEVEL_BITS) + number


def _levels(tips: DataFrame, base: int, fan: int) -> tuple[list[DataFrame], int]:
    """Levels of all trees at once. ``tips``: ``(tree, size, pos, hash, lo,
    hi)``, a tree's members numbered from 0; ``tree`` is the number of its
    first member. Gives node rows ``(tree, node, parent, place, children,
    hash, lo, hi)``, level by level, and the greatest size."""
    size = tips.agg(F.max("size")).first()[0] or 0
    out, level, width, left = [], 0, 1, size
    rows = tips
    while left > 1:
        level, width, left = level + 1, width * fan, -(-left // fan)
        run = F.floor(F.col("pos") / fan)
        grouped = rows.filter("size > 1").groupBy("tree", "size", run.alias("run")).agg(
            F.array_sort(F.collect_list(F.struct((F.col("pos") % fan).alias("place"), "hash"))).alias("_c"),  # at most `fan`
            F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        children = F.reduce("_c", F.lit(b""), lambda a, x: F.concat(a, x["hash"]))
        up = F.ceil(F.col("size") / fan)
        made = grouped.select(
            "tree", up.alias("size"), F.col("run").alias("pos"),
            _node(base + level, F.col("tree") + F.col("run") * width).alias("node"),
            F.when(up > 1, _node(base + level + 1, F.col("tree") + F.floor(F.col("run") / fan) * (width * fan))).alias("parent"),
            (F.col("run") % fan).cast("int").alias("place"), children.alias("children"), "lo", "hi")
        rows = staged(made.withColumn("hash", digest(hex_text(F.col("children")))))
        out.append(rows)
    return out, size


def _parent(level: int, pos: Column, tree: Column, size: Column, fan: int) -> Column:
    """Link of a member of a tree (level 0); null where it is alone."""
    return F.when(size > 1, _node(level + 1, tree + F.floor(pos / fan) * fan))


def build(docs: DataFrame, tampered: Column | None = None, id_col: str = "doc_id", group_col: str = "source",
          columns: tuple[str, ...] = COLUMNS, text_col: str = "text", fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """``leaves``: ``(leaf long, id, hash, folded, parent, place, subroot)``
    in the order of their numbers, ``folded`` being the digest of the row with
    ``tampered`` as its text; ``nodes``: ``(node, parent, place, children,
    hash, is_subroot, lo, hi)`` over leaves ``lo`` to ``hi``. Both staged."""
    spark = docs.sparkSession
    col = {c: F.col(f"`{c}`") for c in {*columns, id_col, group_col, text_col}}
    changed = col | ({text_col: tampered} if tampered is not None else {})
    slim = docs.select(col[id_col].alias("id"), col[group_col].alias("grp"),
                       leaf_digest([col[c] for c in columns]).alias("hash"),
                       leaf_digest([changed[c] for c in columns]).alias("folded"))
    with temporary(spark):
        numbered = with_global_index(slim, ["grp", "id", "hash", "folded"], idx="leaf")
        groups = numbered.groupBy("grp").agg(F.min("leaf").alias("tree"), F.count(F.lit(1)).alias("size"))
        groups = staged(with_global_index(groups, ["tree"], idx="t"))
        # a group's row lies ready once per slot of its leaves, so a hot group is not one key
        spread = slots(groups.select(F.col("grp").alias("_g"), "tree", "size", "t", F.col("tree").alias("lo"),
                                     (F.col("tree") + F.col("size") - 1).alias("hi")))
        tips = numbered.withColumn("_slot", F.floor(F.col("leaf") / SLOT)).join(
            spread, F.col("grp").eqNullSafe(F.col("_g")) & (F.col("_slot") == F.col("slot"))).select(
            "leaf", "id", "hash", "folded", "tree", "size", "t", (F.col("leaf") - F.col("tree")).alias("pos"))
        tips = staged(tips)
        low, _ = _levels(tips.select("tree", "size", "pos", "hash", F.col("leaf").alias("lo"), F.col("leaf").alias("hi")),
                         0, fan)
        alone = tips.filter("size = 1").select("t", "hash", F.col("leaf").alias("lo"), F.col("leaf").alias("hi"))
        link = groups.select(F.col("tree").alias("_tree"), "t")
        subroots = alone
        for rows in low:
            subroots = subroots.unionByName(rows.filter("parent IS NULL").join(link, F.col("tree") == F.col("_tree"))
                                            .select("t", "hash", "lo", "hi"))
        n = groups.count()
        top, _ = _levels(subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(n).cast("long").alias("size"),
                                         F.col("t").alias("pos"), "hash", "lo", "hi"), TOP, fan)
        over = _parent(TOP, F.col("t"), F.lit(0), F.lit(n), fan)  # where a subroot hangs
        at = (F.col("t") % fan).cast("int")
        names = ["node", "parent", "place", "children", "hash", "is_subroot", "lo", "hi"]
        nodes = None
        for rows in low:
            is_top = F.col("parent").isNull()
            inner = rows.filter(~is_top).withColumn("is_subroot", F.lit(False)).select(*names)
            ends = rows.filter(is_top).drop("parent", "place").join(link, F.col("tree") == F.col("_tree")).select(
                "node", over.alias("parent"), at.alias("place"), "children", "hash", F.lit(True).alias("is_subroot"), "lo", "hi")
            nodes = inner.unionByName(ends) if nodes is None else nodes.unionByName(inner).unionByName(ends)
        for rows in top:
            rows = rows.withColumn("is_subroot", F.lit(False)).select(*names)
            nodes = rows if nodes is None else nodes.unionByName(rows)
        if nodes is None:
            nodes = spark.createDataFrame([], "node long, parent long, place int, children binary, hash binary, "
                                              "is_subroot boolean, lo long, hi long")
        nodes = staged(nodes, outlives=True)
        single = F.col("size") == 1
        leaves = tips.select(
            "leaf", "id", "hash", "folded",
            F.coalesce(_parent(0, F.col("pos"), F.col("tree"), F.col("size"), fan), over).alias("parent"),
            F.when(single, at).otherwise((F.col("pos") % fan).cast("int")).alias("place"),
            F.when(single, F.col("hash")).alias("subroot"))
        return staged(leaves, outlives=True), nodes


def slots(rows: DataFrame) -> DataFrame:
    """Every row once per slot that ``lo`` to ``hi`` touch; lists of slots
    are made in two steps, so that none is long."""
    block = SLOT << 10
    blocks = rows.select("*", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor(F.col("hi") / block))).alias("_b"))
    first = F.greatest(F.floor(F.col("lo") / SLOT), F.col("_b") * 1024)
    last = F.least(F.floor(F.col("hi") / SLOT), F.col("_b") * 1024 + 1023)
    return blocks.select("*", F.explode(F.sequence(first, last)).alias("slot")).drop("_b", "lo", "hi")


CLIMB = """
WITH RECURSIVE climb(leaf, slot, step, node, spot, parent, place, folded, subroot, root) AS (
  SELECT leaf, leaf DIV {slot}, 0, CAST(NULL AS LONG), CAST(NULL AS INT), parent, place, folded, subroot,
         IF(parent IS NULL, hash, NULL)
  FROM {leaves}
  UNION ALL
  SELECT c.leaf, c.slot, c.step + 1, n.node, c.place, n.parent, n.place,
         unhex(sha2(lower(hex(concat(substring(n.children, 1, 32 * c.place), c.folded,
                                     substring(n.children, 32 * c.place + 33)))), 256)),
         IF(n.is_subroot, n.hash, NULL), IF(n.parent IS NULL, n.hash, NULL)
  FROM climb AS c JOIN {nodes} AS n ON c.parent = n.node AND c.slot = n.slot)
SELECT * FROM climb"""


def climb(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(leaf, slot, step, node, spot, folded, subroot, root)``: a row per
    leaf and level. The siblings of a step are the children of ``node`` but
    for the one at ``spot``; ``subroot`` and ``root`` are given where the
    level has them."""
    spark: SparkSession = leaves.sparkSession
    names = {k: f"merkle_{k}_{uuid.uuid4().hex}" for k in ("leaves", "nodes")}
    leaves.createOrReplaceTempView(names["leaves"])
    slots(nodes).createOrReplaceTempView(names["nodes"])
    try:
        return spark.sql(CLIMB.format(slot=SLOT, **names)).drop("parent", "place")
    finally:
        for name in names.values():
            spark.catalog.dropTempView(name)


def proofs(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(id, leaf, subroot, root, proof, folded_root)``, digests as 32
    bytes, ``proof`` being all siblings in a row. Staged."""
    spark = leaves.sparkSession
    limit = "spark.sql.cteRecursionRowLimit"
    old = spark.conf.get(limit, None)
    spark.conf.set(limit, "-1")  # a row per leaf and level is what is asked for
    try:
        path = F.array_sort(F.collect_list(F.when(F.col("step") > 0, F.struct("step", "node", "spot"))))  # one per level
        got = climb(leaves, nodes).groupBy("slot", "leaf").agg(
            path.alias("_path"), F.max_by("folded", "step").alias("folded_root"), F.max("subroot").alias("_sub"),
            F.max("root").alias("root"))
        # the node rows of a slot: fewer than its leaves and one a level
        near = slots(nodes).groupBy(F.col("slot").alias("_slot")).agg(
            F.map_from_entries(F.collect_list(F.struct("node", "children"))).alias("_near"))

        def beside(x: Column) -> Column:
            children = F.col("_near")[x["node"]]
            return F.concat(F.substr(children, F.lit(1), 32 * x["spot"]), F.substr(children, 32 * x["spot"] + 33))
        siblings = F.reduce("_path", F.lit(b""), lambda a, x: F.concat(a, beside(x)))
        got = got.join(near, F.col("slot") == F.col("_slot"), "left").select(
            F.col("leaf").alias("_leaf"), "_sub", "root", digest(hex_text(siblings)).alias("proof"), "folded_root")
        return staged(leaves.select("id", "leaf", "hash").join(got, F.col("leaf") == F.col("_leaf")).select(
            "id", F.col("hash").alias("leaf"), F.col("_sub").alias("subroot"), "root", "proof", "folded_root"), outlives=True)
    finally:
        spark.conf.unset(limit) if old is None else spark.conf.set(limit, old)


def verify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """One row per input row: the manifest's digests as lower-case hex, the
    root recomputed from the row as it is after tampering, and whether it is
    still the root. Rows whose id has a CRC-32 divisible by 5 are tampered
    with: A-Z of the text become lower case."""
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    hit = F.coalesce(F.crc32(F.encode(ident.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))
    changed = F.when(hit, F.translate(text, UPPER, LOWER)).otherwise(text)
    with temporary(docs.sparkSession):
        leaves, nodes = build(docs, changed, id_col, text_col=text_col, **names)
        found = proofs(leaves, nodes)
    return found.select(F.col("id").alias(id_col), hex_text(F.col("leaf")).alias("leaf"),
                        hex_text(F.col("subroot")).alias("subroot"), hex_text(F.col("root")).alias("root"),
                        hex_text(F.col("proof")).alias("proof_sha256"), hex_text(F.col("folded_root")).alias("folded_root"),
                        (F.col("folded_root") == F.col("root")).alias("verified"))
