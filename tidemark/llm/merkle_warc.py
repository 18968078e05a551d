"""Fixity of web archives by Merkle trees, in DataFrame functions only.

Pages are laid out as records of archive files in order. Each record is hashed. A node of the tree is a range of
page_ids: 32 ids, a file, 32 files and so on up to one root; its digest covers its children in order, each with its offset
in the node, its size and digest. Offsets count from the node's own start, so a page that is gone or new changes the nodes
above it and no neighbour. Two replicas are compared from the root down: only the children of nodes that differ are
looked at on the next level, until the records that differ and their offsets are found.

Equal records of a page_id are one node with a count. Records without a page_id, and those of a page_id that has over
`per_file` of them, go to files of their own (negative numbers) by their digest, about `per_file` in each.

Defined cases: null url or html counts as empty. Pages that repeat a page_id are ordered by digest. Of the records under
one page_id, as many as both replicas have are `ok`; those left over are `corrupt` as far as the other replica has some
left, then `missing` or `added`. Records in negative files are known by their content only, so never `corrupt`. Extra
columns are dropped. An empty table gives an empty audit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release

RECORDS = 1024
FAN = 32
#: Copies of one record that are spelt out by one task.
STRETCH = 65_536


def records(pages: DataFrame) -> DataFrame:
    """page_id, size, digest of each page's record, equal ones once with their number (copies)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), text("url").alias("url"), text("html").alias("html"))
    body = F.encode("html", "UTF-8")
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.col("url"), F.lit("\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    record = F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))
    light = rows.select("page_id", F.octet_length(record).cast("long").alias("size"), F.sha2(record, 256).alias("digest"))
    return light.groupBy("page_id", "size", "digest").agg(F.count("*").alias("copies"))


def laid_out(both: DataFrame, per_file: int = RECORDS) -> DataFrame:
    """both (side, page_id, size, digest, copies) with file, range (its 32nd part) and crowded (known by content only)."""
    file, part = F.floor(F.col("page_id") / per_file), F.floor(F.pmod("page_id", F.lit(per_file)) * FAN / per_file)
    counts = both.groupBy("side", "page_id").agg(F.sum("copies").alias("n"))
    crowded = counts.where(F.col("page_id").isNull() | (F.col("n") > per_file)).groupBy("page_id").agg(F.max("n").alias("n"))
    crowded = materialize(crowded.select(F.col("page_id").alias("id_"), "n"), "merkle-crowded")
    total = crowded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return both.select("*", file.alias("file"), part.alias("range"), F.lit(False).alias("crowded"))
    # below the files of all ids
    below = min(0, both.agg(F.min("page_id")).first()[0] or 0) // per_file
    own = F.lit(below - 1) - F.pmod(F.xxhash64("digest"), F.lit(-(-total // per_file)))
    # an id of very many records is spread by their digests before it meets its row
    spread = both.withColumn("salt_", F.pmod(F.xxhash64("digest"), F.lit(FAN)))
    ids = crowded.select("id_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(FAN - 1).cast("long"))).alias("at_"))
    met = spread.join(ids, F.col("page_id").eqNullSafe(F.col("id_")) & (F.col("salt_") == F.col("at_")), "left").withColumn("crowded", F.col("at_").isNotNull())
    in_own = F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(FAN))
    return met.select(*both.columns, F.when(F.col("crowded"), own).otherwise(file).alias("file"), F.when(F.col("crowded"), in_own).otherwise(part).alias("range"), "crowded")


def parents(nodes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Nodes of the children that share keys: a digest of the ordered children with their offsets in the node, and a size."""
    seen = F.array_sort(F.collect_list(F.struct(*order, "digest", "size")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text"))
    each = lambda a, x: F.struct((a["at"] + x["size"]).alias("at"), F.sha2(F.concat_ws(":", a["text"], a["at"], x["size"], x["digest"]), 256).alias("text"))
    up = nodes.groupBy(*keys).agg(seen.alias("c")).select(*keys, F.aggregate("c", start, each).alias("n"))
    return up.select(*keys, F.col("n.text").alias("digest"), F.col("n.at").alias("size"))


def tree(leaves: DataFrame, least: int, most: int) -> list[tuple[DataFrame, list[str]]]:
    """Levels above the records with their keys: ranges, files, then ever wider ranges of files up to one root a side."""
    rows = leaves.select("side", "file", "range", "page_id", (F.col("size") * F.col("copies")).alias("size"), F.concat_ws("x", "digest", "copies").alias("digest"))
    levels = [(materialize(parents(rows, ["side", "file", "range"], ["page_id"]), "merkle-level"), ["file", "range"])]
    levels.append((materialize(parents(levels[0][0], ["side", "file"], ["range"]), "merkle-level"), ["file"]))
    wide = most - least + 1
    while wide > 1:
        up = levels[-1][0].withColumn("below", F.col("file")).withColumn("file", F.floor((F.col("file") - least) / FAN))
        levels.append((materialize(parents(up, ["side", "file"], ["below"]), "merkle-level"), ["file"]))
        wide, least = -(-wide // FAN), 0
    return levels


def differing(levels: list[tuple[DataFrame, list[str]]], least: int) -> DataFrame:
    """file, range of the lowest nodes that differ, found from the roots down."""
    bad = None
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("digest")))
    for n in range(len(levels) - 1, -1, -1):
        nodes, keys = levels[n]
        if bad is not None:
            # a file's ranges bear its number; wider nodes number those below
            up = F.col("file") if n == 0 else F.floor((F.col("file") - (least if n == 1 else 0)) / FAN)
            nodes = nodes.withColumn("up", up).join(bad.select(F.col("file").alias("up")), "up", "left_semi")
        pair = nodes.groupBy(*keys).agg(of(0).alias("a"), of(1).alias("b"))
        last, bad = bad, materialize(pair.where(~F.col("a").eqNullSafe(F.col("b"))).select(*keys), "merkle-differ")
        if last is not None:
            release(last)
    return bad


def judged(records: DataFrame) -> DataFrame:
    """Of the records in differing ranges: copies that are ok and corrupt on side 0, and added on side 1."""
    of = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("copies"))), F.lit(0))
    both = records.groupBy("file", "page_id", "digest", "crowded").agg(of(0).alias("a"), of(1).alias("b"))
    ok = F.least("a", "b")
    both = both.select("file", "page_id", "digest", "crowded", ok.alias("ok"), (F.col("a") - ok).alias("left"), (F.col("b") - ok).alias("right"))
    # an id's files are bounded, so is what meets here
    ids = Window.partitionBy("file", "page_id")
    before = ids.orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    known = ~F.col("crowded")
    both = both.withColumns({"others": F.sum("right").over(ids), "ours": F.sum("left").over(ids), "left_before": F.coalesce(F.sum("left").over(before), F.lit(0)), "right_before": F.coalesce(F.sum("right").over(before), F.lit(0))})
    paired = lambda own, others, prior: F.least(own, F.greatest(F.lit(0), F.col(others) - F.col(prior)))
    corrupt, met = paired(F.col("left"), "others", "left_before"), paired(F.col("right"), "ours", "right_before")
    return both.select(
        "file", "page_id", "digest", F.col("ok").alias("ok_copies"), F.when(known, corrupt).otherwise(0).alias("corrupt_copies"), (F.col("right") - F.when(known, met).otherwise(0)).alias("added_copies"),
    )


def audit(first: DataFrame, second: DataFrame, per_file: int = RECORDS) -> DataFrame:
    """file, number, offset, size, page_id, status of every record of either replica; place and offset are those in its
    replica's file."""
    both = first.withColumn("side", F.lit(0)).unionByName(second.withColumn("side", F.lit(1)))
    both = materialize(both, "merkle-folded")
    leaves = materialize(laid_out(both, per_file), "merkle-records")
    top = leaves.agg(F.max("file"), F.min("file"), F.max("copies")).first()
    least, most = (top[1], top[0]) if top[0] is not None else (0, 0)
    bad = differing(tree(leaves, least, most), least)
    status = judged(leaves.join(bad, ["file", "range"], "left_semi")).withColumnsRenamed({"file": "f_", "page_id": "p_", "digest": "d_"})
    prior = Window.partitionBy("side", "file").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda x: F.coalesce(F.sum(x).over(prior), F.lit(0))
    placed = leaves.withColumns({"number": sums("copies"), "offset": sums(F.col("copies") * F.col("size"))})
    found = placed.join(status, (F.col("file") == F.col("f_")) & F.col("page_id").eqNullSafe(F.col("p_")) & (F.col("digest") == F.col("d_")), "left")
    found = found.where((F.col("side") == 0) | (F.col("added_copies") > 0))
    start = F.when(F.col("side") == 0, F.lit(0)).otherwise(F.col("copies") - F.col("added_copies"))
    found = found.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / STRETCH)))).withColumn("start", start)
    if (top[2] or 0) > STRETCH:
        found = found.repartition(F.xxhash64("file", "page_id", "digest", "from"))
    nth = found.withColumn("nth", F.explode(F.sequence(F.col("from") * STRETCH, F.least(F.col("copies"), (F.col("from") + 1) * STRETCH) - 1))).where("nth >= start")
    kind = F.when(F.col("side") == 1, "added").when(F.col("ok_copies").isNull() | (F.col("nth") < F.col("ok_copies")), "ok").when(F.col("nth") < F.col("ok_copies") + F.col("corrupt_copies"), "corrupt").otherwise("missing")
    return nth.select("file", (F.col("number") + F.col("nth")).alias("number"), (F.col("offset") + F.col("nth") * F.col("size")).alias("offset"), "size", "page_id", kind.alias("status"))
