"""Merkle manifest of a table: leaves, one subtree per group, one root, and a proof for every row.

Rows are ranked by id in their group. The binary digits of the rank are columns;
within a block of 2**DIGITS neighbours they are grouped away one after the
other, the lowest first, and each step nests the children it hashes in one
struct. All steps of a block run on one exchange, as its key is part of every
key. Blocks become the leaves of the next round until a group has one node; the
groups' subroots are the leaves of the last tree. On the way back a transform
over the nested structs gives every leaf the siblings on its path and explodes
them; what lies above a block reaches it by grouping on the block, not by a join.

A proof is an array of (left, right): the hex digests that stand before and
after the node when it is hashed, both empty where it is hashed alone.

Cases: a null field is hashed as ``-`` (so it differs from the text ``-``), a
null group is a group of its own and the first, a null id ranks first. Rows of
one id rank by their leaf; equal rows have equal leaves and take neighbouring
places. Texts of any length are hashed whole. An empty table has no tree and
gives no row. Columns other than the named fields are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .rows import running_sum

#: Children of a node.
FAN = 2
#: Digits that are grouped away within a block: it has FAN ** DIGITS leaves at most.
DIGITS = 8
#: What a leaf hashes, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

STEP = "struct<left: string, right: string>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts one after the other, as UTF-8."""
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """``-`` for null, else byte count, colon, value."""
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _siblings(kids: Column, i: Column) -> Column:
    """(left, right) of child i: the digests of the children before and after it."""
    hashes = F.transform(kids, lambda k: k["node"]["h"])
    before = F.slice(hashes, F.lit(1), i)
    after = F.slice(hashes, i + 2, F.size(hashes))
    return F.struct(F.array_join(before, "").alias("left"), F.array_join(after, "").alias("right"))


def _rollup(nodes: DataFrame, group: str) -> DataFrame:
    """One row per block: group, n (nodes of the group), block, tree.

    ``nodes`` has group, n, rank and a struct ``node`` with the digest ``h``. A
    level hashes only in groups that still have several nodes on it.
    """
    at = nodes.select(group, "n", "node", F.floor(F.col("rank") / FAN**DIGITS).alias("block"),
                      *[F.pmod(F.floor(F.col("rank") / FAN**j), F.lit(FAN)).alias(f"d{j}") for j in range(DIGITS)])
    at = at.repartition(group, "block")
    for j in range(DIGITS):
        rest = [f"d{k}" for k in range(j + 1, DIGITS)]
        kids = F.sort_array(F.collect_list(F.struct(F.col(f"d{j}").alias("digit"), "node"))).alias("kids")  # digits differ
        h = F.when(F.col("n") > FAN**j, F.sha2(F.array_join(F.transform("kids", lambda k: k["node"]["h"]), ""), 256)).otherwise(
            F.col("kids")[0]["node"]["h"])
        at = at.groupBy(group, "n", "block", *rest).agg(kids).select(group, "n", "block", *rest, F.struct(h.alias("h"), "kids").alias("node"))
    return at.withColumnRenamed("node", "tree")


def _paths(node: Column, above: Column, n: Column, level: int = DIGITS) -> Column:
    """All leaves below a node of that level, in order, as an array of (node, path)."""
    if level == 0:
        return F.array(F.struct(node.alias("node"), above.alias("path")))
    kids, power = node["kids"], FAN**(level - 1)

    def child(kid: Column, i: Column) -> Column:
        step = F.when(n > power, F.array(_siblings(kids, i))).otherwise(F.array().cast(f"array<{STEP}>"))
        return _paths(kid["node"], F.concat(step, above), n, level - 1)

    return F.flatten(F.transform(kids, child))


def _ranked(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    return running_sum(rows.withColumn("__one", F.lit(1).cast("long")), group, order, "__one", "rank", total="n").drop("__one")


def _proofs(nodes: DataFrame, group: str) -> tuple[DataFrame, list[DataFrame]]:
    """The tops of the groups (group, h) and the written rounds of blocks, lowest first."""
    rounds: list[DataFrame] = []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        blocks = cut(_rollup(nodes, group), "merkle-blocks")
        rounds.append(blocks)
        most = -(-most // FAN**DIGITS)
        if most <= 1:
            return blocks.select(group, F.col("tree.h").alias("h")), rounds
        nodes = blocks.select(group, F.ceil(F.col("n") / FAN**DIGITS).alias("n"), F.col("block").alias("rank"),
                              F.struct(F.col("tree.h").alias("h")).alias("node"))


def _unfold(rounds: list[DataFrame], above: DataFrame, group: str, carry: list[str]) -> DataFrame:
    """(group, carried columns, node, path) of the lowest leaves; ``above`` has the groups' own paths."""
    above = above.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        known = [F.col(c) for c in (*carry, "path")]
        kinds = {f.name: f.dataType for f in above.schema.fields}
        trees = blocks.select(group, "block", "n", "tree", *[F.lit(None).cast(kinds[c]).alias(c) for c in (*carry, "path")])
        tops = above.select(group, "block", F.lit(None).cast(blocks.schema["n"].dataType).alias("n"),
                            F.lit(None).cast(blocks.schema["tree"].dataType).alias("tree"), *known)
        met = trees.union(tops).groupBy(group, "block").agg(
            *[F.first(c, ignorenulls=True).alias(c) for c in ("n", "tree", *carry, "path")])
        leaves = met.select(group, *carry, "block", F.posexplode(_paths(F.col("tree"), F.col("path"), F.col("n"))).alias("place", "leaf"))
        above = leaves.select(group, *carry, (F.col("block") * FAN**DIGITS + F.col("place")).alias("block"),
                              F.col("leaf.node").alias("node"), F.col("leaf.path").alias("path"))
    return above


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def manifest(docs: DataFrame, claimed: Column | None = None, fields=FIELDS, group: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """doc_id, the group, leaf, claimed_leaf, subroot, root and ``proof`` of every row.

    ``claimed`` is a digest to verify in place of the leaf (null: the leaf
    itself); it is computed from the row's own columns.
    """
    leaf = digest(*[field(F.col(c)) for c in fields])
    made = docs.select(F.col(id_col).alias("__id"), F.col(group).cast("string").alias("__g"), leaf.alias("__leaf"),
                       (F.lit(None).cast("string") if claimed is None else claimed).alias("__claimed"))
    leaves = cut(made, "merkle-leaves")  # ranking samples it; the texts are hashed once
    ranked = _ranked(leaves, ["__g"], ["__id", "__leaf", "__claimed"])
    nodes = cut(ranked.select("__g", "n", "rank", F.struct(F.col("__leaf").alias("h"), "__id", "__claimed").alias("node")), "merkle-nodes")
    tops, rounds = _proofs(nodes, "__g")
    # the same once more over the subroots, which form one group
    ranked = _ranked(tops.select("__g", "h"), [], ["__g"])
    over = ranked.select(F.lit(0).alias("__all"), "n", "rank", F.struct("h", "__g").alias("node"))
    root, upper = _proofs(cut(over, "merkle-subroots"), "__all")
    above = root.select("__all", F.col("h").alias("root"), F.array().cast(f"array<{STEP}>").alias("path"))
    groups = _unfold(upper, above, "__all", ["root"]).select(
        F.col("node.__g").alias("__g"), F.col("node.h").alias("subroot"), "root", "path")
    out = _unfold(rounds, groups, "__g", ["subroot", "root"])
    return out.select(F.col("node.__id").alias("doc_id"), F.col("__g").alias("group"), F.col("node.h").alias("leaf"),
                      F.col("node.__claimed").alias("claimed_leaf"), "subroot", "root", F.col("path").alias("proof"))


def verify(proofs: DataFrame) -> DataFrame:
    """Add proof_sha256 (all siblings, bottom up, left to right), folded_root and verified."""
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    return proofs.withColumns({
        "proof_sha256": F.sha2(siblings, 256),
        "folded_root": fold(F.coalesce("claimed_leaf", "leaf"), F.col("proof")),
    }).withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_leaf(fields=FIELDS, id_col: str = "doc_id", number: str = "n_chars", every: int = 7) -> Column:
    """The leaf with 1 added to ``number``, where ``every`` divides the crc32 of the decimal id; else null."""
    more = (F.col(number).cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    changed = digest(*[field(more if c == number else F.col(c)) for c in fields])
    return F.when(F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0, changed)


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """Proofs of all documents, verified against rows of which some were tampered with."""
    out = verify(manifest(docs, tampered_leaf()))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


ORACLE_SQL = """
WITH RECURSIVE bits AS (
  SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)::BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384)) AS v FROM range(256) t(i)),
tab AS (SELECT list(v ORDER BY i) AS t FROM bits),
ids AS (SELECT DISTINCT doc_id FROM documents),
crc AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) AS c
  FROM ids, tab),
f AS (
  SELECT doc_id, lang,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS n,
    coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS n1,
    coalesce(strlen(text) || ':' || text, '-') AS z
  FROM documents),
l AS (
  SELECT f.doc_id, lang, sha256(a || n || z) AS leaf, CASE WHEN c % 7 = 0 THEN sha256(a || n1 || z) ELSE sha256(a || n || z) END AS claimed
  FROM f LEFT JOIN crc USING (doc_id)),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM l),
up AS (
  SELECT lang, n, 0 AS lv, i, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, ((n + 1) // 2)::BIGINT, lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY lang, n, lv, i // 2),
subs AS (
  SELECT lang, lv AS top, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
up2 AS (
  SELECT n, 0 AS lv, i, subroot AS h FROM subs
  UNION ALL
  SELECT ((n + 1) // 2)::BIGINT, lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM up2 WHERE n > 1 GROUP BY n, lv, i // 2),
walk AS (
  SELECT doc_id, lang, i, 0 AS lv, leaf, claimed, claimed AS h, '' AS sib, i AS pos FROM leaves
  UNION ALL
  SELECT w.doc_id, w.lang, w.i, w.lv + 1, w.leaf, w.claimed,
    CASE WHEN s.h IS NULL THEN sha256(w.h) WHEN w.pos % 2 = 1 THEN sha256(s.h || w.h) ELSE sha256(w.h || s.h) END,
    w.sib || coalesce(s.h, ''), w.pos // 2
  FROM walk w JOIN subs t ON t.lang IS NOT DISTINCT FROM w.lang AND w.lv < t.top
  LEFT JOIN up s ON s.lang IS NOT DISTINCT FROM w.lang AND s.lv = w.lv AND s.i = xor(w.pos, 1)),
low AS (
  SELECT w.doc_id, w.leaf, w.h, w.sib, t.i AS pos, t.subroot FROM walk w JOIN subs t ON t.lang IS NOT DISTINCT FROM w.lang AND w.lv = t.top),
high AS (
  SELECT doc_id, leaf, h, sib, pos, subroot, 0 AS lv FROM low
  UNION ALL
  SELECT w.doc_id, w.leaf,
    CASE WHEN s.h IS NULL THEN sha256(w.h) WHEN w.pos % 2 = 1 THEN sha256(s.h || w.h) ELSE sha256(w.h || s.h) END,
    w.sib || coalesce(s.h, ''), w.pos // 2, w.subroot, w.lv + 1
  FROM high w JOIN (SELECT max(lv) AS top FROM up2) m ON w.lv < m.top LEFT JOIN up2 s ON s.lv = w.lv AND s.i = xor(w.pos, 1)),
root AS (SELECT h AS root FROM up2 WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, h AS folded_root, h = root AS verified
FROM high, root WHERE lv = (SELECT max(lv) FROM up2)
"""
