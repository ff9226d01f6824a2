"""A Merkle manifest of a dataset: every row's leaf, its proof, and the root over all groups.

The leaves of a group, in the order of their key, are dealt to aligned blocks of 256. A block
keeps each of its levels as one string of hexadecimal digests. A parent is the hash of a
fixed-width substring of two digests; the flanking substring is a node's sibling, and those
of a block form a segment of its leaves' proofs. What blocks come to are the leaves of
the next round, until each group has one node; the groups' nodes are then leaves of a
tree themselves. Proofs are put together from the top down, by joins of blocks with
their parents' segments. Places in the order are counted by range partitions, so neither a
group nor a level is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_for, stored

LEVELS = 8  # of a block, which has 2^LEVELS leaves
DIGEST = 64  # hexadecimal digits
ROW_BYTES = 300  # of a leaf's row, about
PART_BYTES = 32 << 20
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs).cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` for null, else the value's byte count, a colon and the value, so that no two rows read alike."""
    return F.coalesce(F.concat(F.octet_length(value.cast("string")).cast("string"), F.lit(":"), value.cast("string")), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def _at(place: Column, level: Column) -> Column:
    """1 where the node above `level` levels of a place is a right one."""
    return F.call_function("shiftright", place, level).bitwiseAND(F.lit(1).cast("long"))


def _numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """`nodes` with `place`, from 0 in each group by `order`, and the group's `total`.

    Rows that are equal in all of `order` are alike, so it doesn't matter which is first; they are
    told apart by a number of their own for the dealing, as one range could not hold very many.
    """
    spark = nodes.sparkSession
    keys = ["group", *order, "tie"]
    n = parts_for(spark, nodes.count() * ROW_BYTES, PART_BYTES)
    dealt = nodes.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    dealt = stored(dealt.drop("tie").withColumn("row", F.monotonically_increasing_id()), "merkle-ordered").withColumn("part", F.call_function("shiftright", "row", F.lit(33)))
    spans = dealt.groupBy("group", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))  # a row for each partition and group in it
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumns({"base": F.coalesce(F.sum("n").over(before), F.lit(0)), "total": F.sum("n").over(Window.partitionBy("group"))})
    return dealt.join(spans.drop("n"), ["group", "part"]).withColumn("place", F.col("base") + F.col("row") - F.col("first")).drop("part", "row", "first", "base")


def _lift(level: Column) -> Column:
    """The level above one: each pair of digests, or a last one alone, becomes its hash."""
    pairs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / (2 * DIGEST)).cast("int"))
    return F.array_join(F.transform(pairs, lambda i: digest(F.substring(level, i * 2 * DIGEST + 1, F.lit(2 * DIGEST)))), "")


def _height(total: Column) -> Column:
    return F.when(total > 1, F.length(F.bin(total - 1))).otherwise(0)


def _rounds(leaves: DataFrame) -> list[DataFrame]:
    """A stored table of blocks for each round: group, block, members (place, node, item), total and levels.

    `leaves` has group, place, total, node and item. In the last table each group has one block.
    """
    most = leaves.agg(F.max(_height(F.col("total")))).first()[0] or 0
    nodes, found = leaves.select("group", "place", "total", "node", "item"), []
    for turn in range(max(1, -(-most // LEVELS))):
        blocks = nodes.groupBy("group", F.call_function("shiftright", "place", F.lit(LEVELS)).alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "node", "item"))).alias("members"), F.first("total").alias("total"))
        lifts = F.greatest(F.least(_height(F.col("total")) - turn * LEVELS, F.lit(LEVELS)), F.lit(0))
        first = F.array(F.array_join(F.transform("members", lambda m: m["node"]), ""))
        levels = F.when(lifts > 0, F.aggregate(F.sequence(F.lit(1), lifts), first, lambda all_, _: F.concat(all_, F.array(_lift(F.element_at(all_, -1)))))).otherwise(first)
        found.append(stored(blocks.withColumn("levels", levels), "merkle-blocks"))
        nodes = found[-1].select("group", F.col("block").alias("place"), "total", F.element_at("levels", -1).alias("node"), F.lit(None).alias("item"))
    return found


def _tops(rounds: list[DataFrame]) -> DataFrame:
    return rounds[-1].select("group", F.element_at("levels", -1).alias("top"))


def _proofs(rounds: list[DataFrame], crowns: DataFrame) -> DataFrame:
    """item, node, `siblings` (hash and whether it is on the left, from the leaf up) and crown of each leaf.

    `crowns` has a row for each group: what its node's siblings are, and any `crown`.
    """
    above = crowns.withColumn("block", F.lit(0).cast("long"))
    for turn, blocks in reversed(list(enumerate(rounds))):

        def member(m: Column) -> Column:
            place = m["place"]
            inner = place.bitwiseAND(F.lit((1 << LEVELS) - 1).cast("long"))

            def flank(level: Column, j: Column) -> Column:
                node = F.call_function("shiftright", inner, j)
                other = node.bitwiseXOR(F.lit(1).cast("long")).cast("int")
                return F.struct(F.substring(level, other * DIGEST + 1, F.lit(DIGEST)).alias("hash"), (_at(inner, j) == 1).alias("left"))

            segment = F.transform(F.slice("levels", F.lit(1), F.size("levels") - 1), flank)
            return F.struct(place.alias("block"), m["node"].alias("node"), m["item"].alias("item"), F.concat(segment, F.col("siblings")).alias("siblings"))

        # named columns only, as the next round joins on them
        below = blocks.join(above, ["group", "block"]).select("group", F.explode(F.transform("members", member)).alias("m"), "crown")
        kept = ["m.block", "m.siblings", "crown"] if turn else ["m.item", "m.node", "m.siblings", "crown"]
        above = below.select("group", *kept)
    return above


def fold(node: Column, siblings: Column) -> Column:
    """What a leaf and its siblings come to; a sibling that isn't there is empty."""
    return F.aggregate(siblings, node, lambda a, s: F.when(s["left"], digest(s["hash"], a)).otherwise(digest(a, s["hash"])))


def manifest(rows: DataFrame) -> DataFrame:
    """item, leaf, `siblings`, subroot and root of every row of `rows` (group, key, leaf, item).

    Groups are strings or null, which comes first; leaves ascend by key, null first, and by
    their hash where keys are equal, so repeated rows have neighbouring places and the result
    doesn't depend on their order. A lone leaf is its group's subroot, a lone group's subroot
    the root; an empty table has no rows. `item` is a struct of what else to carry.
    """
    # a key that isn't null and sorts like the group
    rows = stored(rows.select(F.coalesce(F.concat(F.lit("+"), F.col("group")), F.lit("")).alias("group"), "key", F.col("leaf").alias("node"), "item"), "merkle-leaves")
    rounds = _rounds(_numbered(rows, ["key", "node"]))
    tops = _tops(rounds).select(F.lit("").alias("group"), F.col("group").alias("key"), F.col("top").alias("node"), F.struct(F.col("group").alias("of")).alias("item"))
    top_rounds = _rounds(_numbered(stored(tops, "merkle-subroots"), ["key"]))
    none = F.array().cast("array<struct<hash:string,left:boolean>>")
    roots = _tops(top_rounds).select("group", none.alias("siblings"), F.struct(F.col("top").alias("root")).alias("crown"))
    crowns = _proofs(top_rounds, roots).select(F.col("item.of").alias("group"), "siblings", F.struct(F.col("node").alias("subroot"), F.col("crown.root").alias("root")).alias("crown"))
    return _proofs(rounds, stored(crowns, "merkle-crowns")).select("item", F.col("node").alias("leaf"), "siblings", "crown.subroot", "crown.root")


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    values = [F.col(c) for c in FIELDS]
    changed = [F.col("n_chars").cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf(*changed))
    rows = docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("key"), leaf(*values).alias("leaf"), F.struct("doc_id", tampered.alias("tampered")).alias("item"))
    found = manifest(rows).select(F.col("item.doc_id").alias("doc_id"), "leaf", "subroot", "root", "siblings", F.coalesce("item.tampered", "leaf").alias("shown"))
    proof = F.sha2(F.array_join(F.transform("siblings", lambda s: s["hash"]), "").cast("binary"), 256)
    folded = found.withColumn("folded_root", fold(F.col("shown"), F.col("siblings")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP12_SQL = r"""
WITH RECURSIVE crc_table AS (
    SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
    FROM range(256) AS r(i)
),
rows_ AS (
    SELECT doc_id, lang, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ord(d) AS BIGINT))),
                                         lambda c, b: xor(t[CAST(xor(c & 255, b) AS INTEGER) + 1], c >> 8)), 4294967295) % 7 = 0 AS tamper,
           coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
           coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS chars,
           coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS chars_1,
           coalesce(strlen(text) || ':' || text, '-') AS tail
    FROM documents, crc_table
),
leaves AS (
    SELECT doc_id, lang, sha256(head || chars || tail) AS leaf, CASE WHEN tamper THEN sha256(head || chars_1 || tail) ELSE sha256(head || chars || tail) END AS shown,
           row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, sha256(head || chars || tail)) - 1 AS place
    FROM rows_
),
levels AS (
    SELECT lang, 0 AS level, list(leaf ORDER BY place) AS nodes FROM leaves GROUP BY lang
    UNION ALL
    SELECT lang, level + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM levels WHERE len(nodes) > 1
),
subroots AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS lang_place FROM levels WHERE len(nodes) = 1),
tops AS (
    SELECT 0 AS level, list(subroot ORDER BY lang_place) AS nodes FROM subroots
    UNION ALL
    SELECT level + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM tops WHERE len(nodes) > 1
),
proofs AS (
    SELECT doc_id, l.lang, place, 0 AS half, level, CASE WHEN (place >> level) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(nodes[xor(place >> level, 1) + 1], '') AS sibling
    FROM leaves l JOIN levels v ON v.lang IS NOT DISTINCT FROM l.lang AND len(nodes) > 1
    UNION ALL
    SELECT doc_id, l.lang, place, 1, level, CASE WHEN (lang_place >> level) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(nodes[xor(lang_place >> level, 1) + 1], '')
    FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN tops ON len(nodes) > 1
),
listed AS (SELECT lang, place, list(sibling ORDER BY half, level) AS siblings FROM proofs GROUP BY lang, place),
folded AS (
    SELECT doc_id, leaf, subroot, coalesce(siblings, []) AS siblings,
           list_reduce(list_prepend(shown, coalesce(siblings, [])), lambda a, s: CASE WHEN s[1] = 'L' THEN sha256(s[2:] || a) ELSE sha256(a || s[2:]) END) AS folded_root
    FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang LEFT JOIN listed p ON p.lang IS NOT DISTINCT FROM l.lang AND p.place = l.place
)
SELECT doc_id, leaf, subroot, nodes[1] AS root, sha256(array_to_string(list_transform(siblings, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = nodes[1] AS verified
FROM folded, tops WHERE len(nodes) = 1
"""
