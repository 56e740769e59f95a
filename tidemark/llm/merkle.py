"""Merkle manifest of a table: leaves in order, blocks of 8^4 leaves hashed by DuckDB inside tasks, block roots combined by Spark.

H is the lower-case hex SHA-256 of its inputs concatenated, digests taken as their hex text. A row's leaf is H of its columns,
each written as `-` if null, else its UTF-8 byte count, `:` and its value. Rows of one group ascend by key; equal keys by their
leaf, so repeated rows are interchangeable and null keys come first. While several nodes remain, each 8 consecutive ones become
their H. What remains is the group's subroot; subroots by group (null first, bytewise) give the root in the same way.

Null texts and columns are `-`, an empty text is `0:`. Long texts are hashed in the scan and go no further. An empty table gives
an empty result. Other columns are ignored. Rows with a null key are never tampered with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup_join, settle

#: Children of a node, and levels of one aligned block, the unit that one DuckDB call hashes: a task's memory does not grow with the table.
WIDTH, LEVELS = 8, 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_ENGINE = []


def _engine():
    """This worker's DuckDB, in memory and with one thread."""
    import duckdb

    if not _ENGINE:
        _ENGINE.append(duckdb.connect(":memory:", config={"threads": 1}))
    return _ENGINE[0]


def leaf(**changed: Column) -> Column:
    """The digest of a row; `changed` replaces columns."""
    texts = [changed.get(c, F.col(c)).cast("string") for c in COLUMNS]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """`df`, settled, with the place of each row (from 0) in the order of those columns.

    One range exchange; only the row counts of the partitions reach the driver.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = settle(dealt.withColumn("part", F.spark_partition_id()).withColumn("within", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), name)
    offsets, total = [], 0
    for row in sorted(dealt.groupBy("part").count().collect()):
        offsets.append((row["part"], total))
        total += row["count"]
    known = spark.createDataFrame(offsets, "part int, offset long")
    return dealt.join(F.broadcast(known), "part").withColumn("place", F.col("offset") + F.col("within")).drop("part", "within", "offset")


def _runs(con, depth: int, alone: bool) -> int:
    """Tables run0, run1, ... of the registered view `leaves`: the joined digests of each run of a level. Returns how many."""
    left = con.execute("SELECT count(*) FROM leaves").fetchall()[0][0]
    source, made = "SELECT pos, leaf AS digest FROM leaves", 0
    while made < depth and not (alone and left == 1):
        con.execute(f"CREATE OR REPLACE TEMP TABLE run{made} AS SELECT pos // {WIDTH} AS up, string_agg(digest, '' ORDER BY pos) AS run FROM ({source}) GROUP BY 1")
        source = f"SELECT up AS pos, sha256(run) AS digest FROM run{made}"
        left, made = -(-left // WIDTH), made + 1
    return made


def _block_root(levels: int):
    """One block's root: the node of level 4, or the subroot if the group has no other block."""

    def run(key, block):
        import pyarrow as pa

        con = _engine()
        con.register("leaves", block)
        width = block.column("width")[0].as_py()
        made = _runs(con, levels, width == 1)
        digest = con.execute(f"SELECT sha256(run) FROM run{made - 1}").fetchall()[0][0] if made else block.column("leaf")[0].as_py()
        con.unregister("leaves")
        return pa.table({"no": pa.array([key[0].as_py()], pa.int64()), "idx": pa.array([key[1].as_py()], pa.int64()), "width": pa.array([width], pa.int64()), "digest": [digest]})

    return run


def _fold(levels: int):
    """Proofs of one block's leaves, and the roots that their present rows lead to."""

    def run(key, block, outer):
        import pyarrow as pa

        con = _engine()
        con.register("leaves", block)
        made = _runs(con, levels, block.column("width")[0].as_py() == 1)
        above = outer.to_pylist()[0]
        at = [f"CAST(64 * ((x.pos // {WIDTH**k}) % {WIDTH}) AS BIGINT)" for k in range(made)]
        sides = [(f"substr(run{k}.run, 1, {a})", f"substr(run{k}.run, {a} + 65)") for k, a in enumerate(at)]
        given: list[str] = [text for s in above["steps"] for text in (s["l"], s["r"])]
        proof = "||".join([f"{a}||{b}" for a, b in sides] + ["?"]) if sides else "?"
        now = "coalesce(x.tampered, x.leaf)"
        for a, b in sides:
            now = f"sha256({a}||{now}||{b})"
        joins = "".join(f" JOIN run{k} ON run{k}.up = x.pos // {WIDTH ** (k + 1)}" for k in range(made))
        con.execute(f"CREATE OR REPLACE TEMP TABLE folded AS SELECT x.doc_id, x.leaf, sha256({proof}) AS proof_sha256, {now} AS now FROM leaves x{joins}", ["".join(given)])
        for s in above["steps"]:
            con.execute("UPDATE folded SET now = sha256(? || now || ?)", [s["l"], s["r"]])
        found = con.execute("SELECT doc_id, leaf, ?, ?, proof_sha256, now, now = ? FROM folded", [above["subroot"], above["root"], above["root"]]).fetchall()
        names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
        out = pa.table([pa.array(x) for x in zip(*found, strict=True)], names=names).cast(pa.schema([("doc_id", block.schema.field("doc_id").type), *[(n, pa.string()) for n in names[1:6]], ("verified", pa.bool_())]))
        con.unregister("leaves")
        return out

    return run


def _above(nodes: DataFrame, widest: int, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """Levels over `nodes` (no, idx, width, digest), width being the nodes of its tree on that level, up to one node each.

    Returns the tops, and for each level its nodes with the digests left and right of them in their run.
    """
    steps = []
    while widest > 1:
        run = F.sort_array(F.collect_list(F.struct("idx", "digest")))
        runs = nodes.groupBy("no", F.floor(F.col("idx") / WIDTH).alias("up")).agg(F.max("width").alias("width"), run.alias("run"))
        digests = F.transform("run", lambda x: x["digest"])
        runs = settle(runs.select("no", "up", "width", F.transform("run", lambda x: x["idx"]).alias("ids"), digests.alias("run")), name)
        several = F.col("width") > 1
        children = runs.select("no", "up", "width", "run", F.posexplode("ids").alias("k", "idx"))
        sides = [F.array_join(F.slice("run", F.lit(1), F.col("k")), ""), F.array_join(F.slice("run", F.col("k") + 2, F.lit(WIDTH)), "")]
        step = F.when(several, F.array(F.struct(sides[0].alias("l"), sides[1].alias("r")))).otherwise(F.array().cast("array<struct<l:string,r:string>>"))
        steps.append(children.select("no", "idx", "up", step.alias("step")))
        nodes = runs.select("no", F.col("up").alias("idx"), F.ceil(F.col("width") / WIDTH).alias("width"), F.when(several, F.sha2(F.array_join("run", ""), 256)).otherwise(F.col("run")[0]).alias("digest"))
        widest = -(-widest // WIDTH)
    return nodes, steps


def _below(tops: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """Carries `steps` and the other columns of the tops down to the lowest nodes."""
    for level in reversed(steps):
        parents = tops.withColumnRenamed("idx", "up")
        kept = [c for c in tops.columns if c not in ("no", "idx", "steps")]
        tops = level.join(parents, ["no", "up"]).select("no", "idx", F.concat("step", "steps").alias("steps"), *kept)
    return tops


def manifest(docs: DataFrame, tampered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 of each row, and the root that the row as it is now leads to.

    `tampered` is the row's present leaf where it may differ from the original one (null: unchanged). Leaves are grouped by
    lang and ordered by doc_id. Two passes over the narrow leaf table: block roots, then proofs once the digests outside a
    block are known, so no proof is ever stored as text.
    """
    size = WIDTH**levels
    group = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-"))  # '-' sorts before '='
    leaves = docs.select(group.alias("grp"), "doc_id", leaf().alias("leaf"), (tampered if tampered is not None else F.lit(None).cast("string")).alias("tampered"))
    leaves = ranked(leaves.withColumn("rid", F.monotonically_increasing_id()), ["grp", "doc_id", "leaf", "rid"], "leaves").drop("rid")
    groups = leaves.groupBy("grp").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    groups = settle(ranked(groups, ["grp"], "groups").withColumnRenamed("place", "no"), "groups")
    extent = groups.agg(F.max("n").alias("most"), F.count("*").alias("groups")).first()
    dealt = lookup_join(leaves, groups, "grp", salt=F.col("place"))
    idx = F.col("place") - F.col("first")
    dealt = dealt.select("no", F.floor(idx / size).alias("idx"), F.ceil(F.col("n") / size).alias("width"), F.pmod(idx, F.lit(size)).alias("pos"), "doc_id", "leaf", "tampered")
    blocks = dealt.select("no", "idx", "width", "pos", "leaf").groupBy("no", "idx").applyInArrow(_block_root(levels), "no long, idx long, width long, digest string")
    subroots, inner = _above(settle(blocks, "blocks"), -(-(extent["most"] or 0) // size), "runs")
    subroots = settle(subroots.select("no", "idx", "digest"), "subroots")
    over, outer = _above(subroots.select(F.lit(0).cast("long").alias("no"), F.col("no").alias("idx"), F.lit(extent["groups"]).cast("long").alias("width"), "digest"), extent["groups"], "runs")
    none = F.array().cast("array<struct<l:string,r:string>>").alias("steps")
    paths = _below(over.select("no", "idx", none, F.col("digest").alias("root")), outer).select(F.col("idx").alias("no"), "steps", "root")
    tops = subroots.withColumnRenamed("digest", "subroot").join(paths, "no").select("no", "idx", "steps", "subroot", "root")
    found = settle(_below(tops, inner), "paths")
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return dealt.groupBy("no", "idx").cogroup(found.groupBy("no", "idx")).applyInArrow(_fold(levels), schema)


def lowered_third() -> Column:
    """The leaf of a row whose text has A-Z lower-cased, where 3 divides crc32 of the decimal doc_id; null elsewhere."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0, leaf(text=lower))
