"""A Merkle manifest of a dataset: digests of rows, roots of parts and of the whole, and a proof for each row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.operators.rank import ranked, ranked_within

from .common import ascii_lower, discard, written

#: Nodes that a node of the next level covers, and levels that are nested in one row: 512 leaves at most.
FAN, LEVELS = 8, 3
BLOCK = FAN**LEVELS


def row_digest(columns: list[Column]) -> Column:
    """SHA-256 of the values one after another, each as its length in bytes, a colon and itself, or - if null."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in columns]), 256)


def joined(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda k: k["h"]), "")


def beside(kids: Column, i: Column) -> Column:
    """The hashes before and after the i-th of a run of nodes."""
    return F.struct(joined(F.slice(kids, F.lit(1), i)).alias("before"), joined(F.slice(kids, i + 2, F.lit(FAN))).alias("after"))


def rolled_up(nodes: DataFrame, name: str) -> DataFrame:
    """(part, block, n, kids, h), written, from (part, pos, n, h, ...): the block's nodes nested in structs, and its hash.

    A place in the part is a block's number and a digit a level. One digit after another is grouped away: the nodes that
    differ in it alone become an array within their parent. All groupings keep part and block, by which rows are dealt
    once. A level of a single node (n, how many the part has at the lowest level, tells) is not hashed again."""
    digits = [f"_d{i}" for i in range(LEVELS)]
    rest = [c for c in nodes.columns if c not in ("part", "pos", "n", "h")]
    level = nodes.select("part", "n", F.floor(F.col("pos") / BLOCK).alias("block"), *[F.pmod(F.floor(F.col("pos") / FAN**i), F.lit(FAN)).cast("int").alias(d) for i, d in enumerate(digits)], F.struct("h", *rest).alias("node"))
    level = level.repartition("part", "block")
    for i, d in enumerate(digits):
        kid = F.struct(F.col(d).alias("d"), "node.*") if not i else F.struct(F.col(d).alias("d"), "h", "kids")
        level = level.groupBy("part", "block", "n", *digits[i + 1 :]).agg(F.sort_array(F.collect_list(kid)).alias("kids"))
        more = F.col("n") > FAN**i
        level = level.withColumn("h", F.when(more, F.sha2(joined(F.col("kids")), 256)).otherwise(F.col("kids")[0]["h"]))
    return written(level, name)


def proofs(blocks: DataFrame, paths: DataFrame | None) -> DataFrame:
    """(part, pos, node, path): each nested node with its siblings, lowest level first, to the part's only node.

    paths: (part, block, path) of the blocks themselves. A block meets its path by grouping, and one explode gives its nodes."""
    tree = blocks.select("part", "block", "n", "kids", F.lit(None).cast("array<struct<before:string,after:string>>").alias("path"))
    if paths is not None:
        above = paths.select("part", F.col("pos").alias("block"), F.lit(None).cast(tree.schema["n"].dataType).alias("n"), F.lit(None).cast(tree.schema["kids"].dataType).alias("kids"), "path")
        one = lambda c: F.first(c, ignorenulls=True).alias(c)
        tree = tree.unionByName(above).groupBy("part", "block").agg(one("n"), one("kids"), one("path"))
    on = lambda i, side: F.when(F.col("n") > FAN**i, side)
    up = F.coalesce("path", F.array().cast("array<struct<before:string,after:string>>"))

    def leaves(x: Column, i: Column) -> Column:
        return F.flatten(F.transform(x["kids"], lambda y, j: F.transform(y["kids"], lambda z, k: F.struct(
            (((F.col("block") * FAN + x["d"]) * FAN + y["d"]) * FAN + z["d"]).alias("pos"), z.alias("node"),
            F.filter(F.array(on(0, beside(y["kids"], k)), on(1, beside(x["kids"], j)), on(2, beside(F.col("kids"), i))), lambda s: s.isNotNull()).alias("path")))))

    flat = tree.select("part", up.alias("_up"), F.explode(F.flatten(F.transform("kids", leaves))).alias("x"))
    return flat.select("part", "x.pos", "x.node", F.concat("x.path", "_up").alias("path"))


def tree(nodes: DataFrame, name: str) -> tuple[DataFrame, Callable[[DataFrame | None], DataFrame]]:
    """(part, h) of the parts' top nodes, and a function from the paths of parts to the proofs of all nodes.

    Blocks are rolled up and their hashes are the nodes of the next turn, so a turn's rows are a 512th of those before
    it, until each part is one block."""
    turns = [rolled_up(nodes, name)]
    while not turns[-1].filter(F.col("n") > BLOCK).isEmpty():
        turns.append(rolled_up(turns[-1].select("part", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), "h"), name))

    def down(paths: DataFrame | None) -> DataFrame:
        """paths: (part, path) of the parts."""
        at = None if paths is None else paths.select("part", F.lit(0).cast("long").alias("pos"), "path")
        for t in turns[:0:-1]:
            at = written(proofs(t, at).drop("node"), f"{name}-paths")
        return proofs(turns[0], at)

    return turns[-1].select("part", "h"), down


def merkle_manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), doc_id: str = "doc_id", part: str = "lang", text: str = "text", tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of docs.

    A leaf is row_digest of the fields. Within a part (lang) leaves follow by doc_id; while several nodes remain, each
    run of eight becomes the SHA-256 of its digests; what remains is the part's subroot. Subroots, ordered by part, give
    the root likewise. proof_sha256 is the SHA-256 of a leaf's siblings on its way to the root. Then the manifest is
    put to the test: where `tampered` holds (by default where 3 divides the CRC-32 of doc_id as text), A-Z of the text
    are lower-cased, and folded_root is what the leaf as found and the original siblings give; verified tells whether
    it is the root.

    Only digests move, not texts. Places in a part come from ranges of the order, so a part may hold any share of all
    rows; digits of the place are grouped away within blocks of 512 leaves, which nest their nodes, and one explode
    emits proofs, without joins. Null part: first of all. Null ids stand first in their part and are not tampered with;
    rows of one id follow by leaf, equal rows in any order (their proofs are told apart by place alone). Null or empty
    texts are leaves as all else. An empty table gives no rows; other columns are ignored.
    """
    odd = F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 0 if tampered is None else tampered
    values = lambda change: [F.when(odd, ascii_lower(F.col(c))).otherwise(F.col(c)) if change and c == text else F.col(c).cast("string") for c in fields]
    leaves = docs.select(F.struct(F.col(part).isNotNull().alias("on"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("name")).alias("part"), F.col(doc_id).alias("id"), row_digest(values(False)).alias("h"), F.when(odd, row_digest(values(True))).alias("now"))
    leaves = written(leaves, "merkle-leaves")
    placed = written(ranked_within(leaves, ["part"], [F.col("id").asc_nulls_first(), "h"], "pos"), "merkle-places")
    discard(leaves)
    sizes = placed.groupBy("part").agg(F.max("pos").alias("n"))
    nodes = placed.join(sizes, "part").select("part", (F.col("pos") - 1).alias("pos"), "n", "h", "id", "now")
    tops, down = tree(nodes, "merkle-blocks")
    discard(placed)
    parts = written(ranked(tops.select(F.col("part").alias("of"), "h"), ["of"], "pos"), "merkle-parts")
    whole = parts.select(F.lit(0).alias("part"), (F.col("pos") - 1).alias("pos"), F.lit(parts.count()).alias("n"), "h", "of")
    top, parts_down = tree(whole, "merkle-top")
    root = F.lit(next((r["h"] for r in top.collect()), None)).cast("string")  # one row, none for an empty table
    above = parts_down(None).select(F.col("node.of").alias("part"), F.struct("node.h", "path").alias("to"))
    paths = written(above.select("part", F.concat(F.array(F.struct(F.col("to.h").alias("before"), F.lit(None).cast("string").alias("after"))), "to.path").alias("path")), "merkle-subroots")
    found = down(paths)
    # the entry without `after` is no level of siblings but carries the subroot on the way
    levels, mark = F.filter("path", lambda s: s["after"].isNotNull()), F.filter("path", lambda s: s["after"].isNull())
    folded = F.aggregate(levels, F.coalesce("node.now", "node.h"), lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))
    siblings = F.sha2(F.array_join(F.transform(levels, lambda s: F.concat(s["before"], s["after"])), ""), 256)
    out = found.select(F.col("node.id").alias("doc_id"), F.col("node.h").alias("leaf"), mark[0]["before"].alias("subroot"), root.alias("root"), siblings.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
