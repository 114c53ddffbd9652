"""A dataset manifest as a Merkle tree: digests of all rows, one root, and a proof for any row.

A leaf is the SHA-256 of a row's fields. Leaves stand in order in a tree of each language, the subroots of
the languages in one more tree. Where several nodes are left, each two neighbours (or a last one alone)
become the digest of their digests.

Trees are built in segments of 1,024 neighbouring nodes: a task reduces a segment by ten levels, and the
segments' digests are the nodes of the next tier. Each tier is one grouping by segment, so no key holds more
than a segment however many rows a language has. The store of a tier keeps, under the digest of a segment,
the children level by level.

A proof is found by descent: requests begin at the root and go to the child that the next digits of their
rank name; the store is asked by digest, the children not chosen are collected, and at the leaf the path is
reversed. Requests that share a segment descend it once, and each carries its claim down, so a path of
siblings is never shuffled with its row. Everything is expressions; nothing but the number of nodes of the
largest tree goes to the driver.

Cases: a null field is ``-``, an empty text ``0:``; rows with the same id stand in the order of their digests,
so repeated rows have equal leaves and proofs of their own; null ids and the null language come first; a
language with one row has its leaf as subroot, a dataset with one language its subroot as root; an empty
table gives no rows; other columns, whatever their names, are not read. Texts of any length are digested whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quireworks.llm.common import held_out, table
from quireworks.staging import stage

#: Levels of a segment, and the fields of a leaf.
BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_LEVELS = """
aggregate(sequence(1, {bits}), array(nodes.digest), (levels, level) -> IF(level > height, levels, concat(levels, array(
  transform(sequence(0, CAST((size(element_at(levels, -1)) + 1) DIV 2 AS INT) - 1), i -> sha2(concat(
    get(element_at(levels, -1), 2 * i), coalesce(get(element_at(levels, -1), 2 * i + 1), '')), 256))))))
"""
_STEPS = """
transform(asked, a -> named_struct('digit', a.digit, 'claim', a.claim, 'digest', get(levels[0], a.digit), 'path', concat(path,
  transform(reverse(slice(levels, 1, size(levels) - 1)), (level, k) -> named_struct(
    'right', (shiftright(a.digit, size(levels) - 2 - k) & 1) = 1,
    'sibling', coalesce(get(level, shiftright(a.digit, size(levels) - 2 - k) ^ 1), ''))))))
"""
_PATH = "array<struct<right: boolean, sibling: string>>"


def leaf_digest(**changed: Column) -> Column:
    """SHA-256 of the fields, each with its length; ``changed`` replaces some."""
    texts = [changed.get(name, F.col(name)).cast("string") for name in FIELDS]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)).cast("binary"), 256)


def ranked(nodes: DataFrame, *order: str) -> DataFrame:
    """Adds ``rank`` within ``tree`` (from 0, in the given order) and ``size``, the tree's number of nodes.

    Rows are sorted over all partitions; a row's rank is its place in the partition and what lies before it.
    """
    sorted_nodes = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = stage(sorted_nodes.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "sorted")
    runs = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("tree").orderBy("part")) - F.col("n")
    runs = runs.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(Window.partitionBy("tree")).alias("size"))
    return placed.join(runs, ["tree", "part"]).withColumn("rank", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def build(nodes: DataFrame, bits: int = BITS) -> tuple[list[DataFrame], DataFrame]:
    """Trees over ``nodes`` (tree, rank, digest, size): the store of each tier (digest, levels), and (tree, digest) of the roots."""
    most = nodes.agg(F.max("size")).first()[0] or 1
    nodes = nodes.select("tree", "rank", "digest", "size")
    store = []
    while True:
        segments = nodes.groupBy("tree", F.shiftright("rank", bits).alias("segment")).agg(
            F.array_sort(F.collect_list(F.struct("rank", "digest"))).alias("nodes"), F.max("size").alias("size")
        )
        height = F.when(F.col("size") > 1 << bits, bits).otherwise(F.length(F.conv((F.col("size") - 1).cast("string"), 10, 2)))
        segments = segments.withColumn("height", F.when(F.col("size") == 1, 0).otherwise(height).cast("int"))
        segments = segments.withColumn("levels", F.expr(_LEVELS.format(bits=bits)))
        tier = stage(segments.select("tree", "segment", "size", F.expr("element_at(levels, -1)[0]").alias("digest"), "levels"), "segments")
        store.append(tier.select("digest", "levels"))
        nodes = tier.select("tree", F.col("segment").alias("rank"), "digest", F.expr(f"(size + {(1 << bits) - 1}) div {1 << bits}").alias("size"))
        if most <= 1 << bits:
            return store, nodes.select("tree", "digest")
        most = -(-most >> bits)


def descend(store: list[DataFrame], roots: DataFrame, requests: DataFrame, bits: int = BITS) -> DataFrame:
    """From ``roots`` (tree, digest, path, any others) to the asked leaves.

    ``requests`` (tree, rank, claim) may ask for any leaves. The result has tree, rank, claim, the leaf's
    ``digest``, its ``path`` from the root down, and the other columns of its root.
    """
    carried = [c for c in roots.columns if c not in ("tree", "digest", "path")]
    found = roots.withColumn("rank", F.lit(0).cast("bigint"))
    for t in reversed(range(len(store))):
        wanted = requests.select("tree", F.shiftright("rank", bits * t).alias("node"), *(["claim"] if t == 0 else []))
        if t:
            wanted = wanted.distinct().withColumn("claim", F.lit(None).cast(requests.schema["claim"].dataType))
        digit = F.col("node").bitwiseAND((1 << bits) - 1).cast("int").alias("digit")
        asked = wanted.groupBy("tree", F.shiftright("node", bits).alias("rank")).agg(F.collect_list(F.struct(digit, "claim")).alias("asked"))
        records = store[t].groupBy("digest").agg(F.any_value("levels").alias("levels"))
        here = found.join(asked, ["tree", "rank"]).join(records, "digest")
        # outer: an inner explode would work out all paths once more to see whether there are any
        steps = here.select("tree", "rank", *carried, F.explode_outer(F.expr(_STEPS)).alias("step"))
        rank = (F.shiftleft("rank", bits) + F.col("step.digit")).alias("rank")
        found = steps.select("tree", rank, *carried, *(["step.claim"] if t == 0 else []), "step.digest", "step.path")
    return found


def fold(leaf: str, path: str) -> Column:
    """The root that ``leaf`` has with the siblings of ``path``."""
    return F.expr(f"aggregate(reverse({path}), {leaf}, (digest, s) -> sha2(IF(s.right, concat(s.sibling, digest), concat(digest, s.sibling)), 256))")


def verify(docs: DataFrame, tampered: Column) -> DataFrame:
    """A manifest of ``docs`` and a check of each row, with ``n_chars`` one too high where ``tampered``.

    (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified).
    """
    one_more = F.col("n_chars").cast("decimal(38,0)") + 1
    told = F.when(tampered & F.col("n_chars").isNotNull(), leaf_digest(n_chars=one_more))
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))  # null before all others
    leaves = docs.select("doc_id", tree.alias("tree"), leaf_digest().alias("digest"), told.alias("told"))
    leaves = ranked(stage(leaves, "leaves"), "doc_id", "digest")
    store, subroots = build(leaves)
    langs = ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "digest"), "lang")
    langs = stage(langs, "langs")
    top_store, root = build(langs)
    start = root.select("tree", "digest", F.expr(f"CAST(array() AS {_PATH})").alias("path"), F.col("digest").alias("root"))
    of_langs = descend(top_store, start, langs.select("tree", "rank", F.struct("lang").alias("claim")))
    of_langs = of_langs.select(F.col("claim.lang").alias("tree"), "digest", "path", "root", F.col("digest").alias("subroot"))
    claims = leaves.select("tree", "rank", F.struct("doc_id", F.coalesce("told", "digest").alias("told")).alias("claim"))
    proved = descend(store, stage(of_langs, "roots"), claims)
    proof = F.sha2(F.expr("array_join(transform(reverse(path), s -> s.sibling), '')").cast("binary"), 256)
    return proved.select(
        F.col("claim.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root",
        proof.alias("proof_sha256"), fold("claim.told", "path").alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify(table(spark, sf_dir, "documents").select(*FIELDS), held_out(F.col("doc_id"), 7, 0))


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in FIELDS) + ")"
_TOLD = "sha256(" + " || ".join(_FIELD.format("(n_chars + 1)" if f == "n_chars" else f) for f in FIELDS) + ")"
SQL = rf"""
WITH RECURSIVE checked AS (
  SELECT *, list_reduce(
    list_concat([4294967295], list_transform(range(8 * strlen(doc_id::VARCHAR)), lambda i: (ascii((doc_id::VARCHAR)[i // 8 + 1]) >> (i % 8)::INTEGER) & 1)),
    lambda crc, bit: xor(crc >> 1, CASE WHEN xor(crc, bit) & 1 = 1 THEN 3988292384 ELSE 0 END)) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, lang, {_LEAF} AS leaf, CASE WHEN xor(crc, 4294967295) % 7 = 0 AND n_chars IS NOT NULL THEN {_TOLD} ELSE {_LEAF} END AS told,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, {_LEAF}) - 1 AS pos
  FROM checked
), nodes AS (
  SELECT lang, 0 AS lvl, pos, leaf AS digest, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  UNION ALL
  SELECT lang, lvl + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, lvl, pos // 2, n
), subroots AS (
  SELECT lang, lvl AS height, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS lvl, pos, subroot AS digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY lvl, pos // 2, n
), steps AS (
  SELECT l.doc_id, l.leaf, l.pos, l.lang, a.lvl, (l.pos >> a.lvl) % 2 AS bit, coalesce(b.digest, '') AS sibling
  FROM leaves l JOIN nodes a ON a.lang IS NOT DISTINCT FROM l.lang AND a.pos = l.pos >> a.lvl AND a.n > 1
  LEFT JOIN nodes b ON b.lang IS NOT DISTINCT FROM l.lang AND b.lvl = a.lvl AND b.pos = xor(a.pos, 1)
  UNION ALL
  SELECT l.doc_id, l.leaf, l.pos, l.lang, s.height + a.lvl, (s.pos >> a.lvl) % 2, coalesce(b.digest, '')
  FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN tops a ON a.pos = s.pos >> a.lvl AND a.n > 1
  LEFT JOIN tops b ON b.lvl = a.lvl AND b.pos = xor(a.pos, 1)
), paths AS (
  SELECT lang, pos, list(bit::VARCHAR || sibling ORDER BY lvl) AS path, string_agg(sibling, '' ORDER BY lvl) AS siblings FROM steps GROUP BY lang, pos
), folded AS (
  SELECT l.doc_id, l.leaf, s.subroot, (SELECT digest FROM tops WHERE n = 1) AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256,
    list_reduce(list_prepend(l.told, coalesce(p.path, [])), lambda digest, s: sha256(CASE WHEN s[1] = '0' THEN digest || s[2:] ELSE s[2:] || digest END)) AS folded_root
  FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM l.lang AND p.pos = l.pos
)
SELECT *, folded_root = root AS verified FROM folded
"""
