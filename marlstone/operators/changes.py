"""Only new or changed records: a Merkle tree over key-range hashes.

A record's key is hashed into a 64-bit space; a leaf is a range of that space
and its digest is an order-free sum over the records in it. A node's digest is
made of its children's. A run makes the tree of its records, reads the saved
digests of the last one and compares the two from the root down: only children
of differing nodes are looked at, and only records of differing leaves are
compared one by one. Output and tree are published together by one commit, so a
failed run leaves the old tree and its records come again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators.versions import Versions
from marlstone.session import scratch, written

#: Children of a node, as a power of two, and levels below the root.
FAN_BITS, DEPTH = 6, 3
#: Folders that saved records lie in, as a power of two: more for more records.
FOLDER_BITS = 4


def normal_path(name: Column) -> Column:
    """``\\\\?\\`` prefix off, forward slashes only, runs of slashes as one."""
    return F.regexp_replace(F.regexp_replace(F.replace(name, F.lit("\\"), F.lit("/")), r"^/+\?/+", ""), "/{2,}", "/")


def with_leaf(rows: DataFrame, key: str, depth: int = DEPTH) -> DataFrame:
    """``rows`` with ``__leaf``, the key range that a record falls in."""
    return rows.withColumn("__leaf", F.shiftrightunsigned(F.xxhash64(key), 64 - FAN_BITS * depth))


SIDES = ("now", "saved")


def _digests(h: Column, n: Column, side: str = "") -> list[Column]:
    """An order-free sum, an exclusive or, a count.

    The sum runs over 32 bits of a hash, so it can't overflow below 2**31
    members a node; the other half goes into the exclusive or.
    """
    return [F.sum(F.shiftrightunsigned(h, 32)).alias(f"sum{side}"), F.bit_xor(h).alias(f"xor{side}"), F.sum(n).alias(f"n{side}")]


def leaf_digests(rows: DataFrame, key: str, state: str) -> DataFrame:
    """``node, sum, xor, n``: one row per leaf that holds records of ``rows`` (with ``__leaf``), combined before the shuffle."""
    return rows.groupBy(F.col("__leaf").alias("node")).agg(*_digests(F.xxhash64(key, state), F.lit(1)))


def side_by_side(now: DataFrame, saved: DataFrame) -> DataFrame:
    """Leaves of two trees: ``node`` and the digests of both sides, null where a side has none."""
    named = [x.select("node", *[F.col(k).alias(f"{k}_{side}") for k in ("sum", "xor", "n")]) for x, side in zip((now, saved), SIDES, strict=True)]
    return named[0].join(named[1], "node", "full")


def parents(level: DataFrame) -> DataFrame:
    """The level above in both trees: digests of digests."""
    digests = []
    for side in SIDES:
        h = F.when(F.col(f"n_{side}").isNotNull(), F.xxhash64("node", f"sum_{side}", f"xor_{side}", f"n_{side}"))
        digests += _digests(h, F.col(f"n_{side}"), f"_{side}")
    return level.groupBy(F.shiftright("node", FAN_BITS).alias("node")).agg(*digests)


def differing_leaves(leaves: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``node`` of the leaves (of ``side_by_side``) whose digests differ, found from the root down.

    The upper levels have 1, 64, ... nodes; only children of differing nodes
    are compared.
    """
    levels = [leaves]
    for _ in range(depth):
        levels.append(parents(levels[-1]))
    same = F.lit(True)
    for k in ("sum", "xor", "n"):
        same = same & F.col(f"{k}_now").eqNullSafe(F.col(f"{k}_saved"))
    open_nodes = levels[-1].where(~same).select("node")
    for level in levels[-2::-1]:
        up = open_nodes.select(F.col("node").alias("up"))
        open_nodes = level.join(up, F.shiftright("node", FAN_BITS) == F.col("up"), "left_semi").where(~same).select("node")
    return open_nodes


def compared(now: DataFrame, saved: DataFrame, key: str, state: str) -> DataFrame:
    """Records of two sides one by one: the key, ``change`` (added, updated, removed), ``state_now``, ``state_saved``."""
    sides = now.select(key, state, F.lit(True).alias("in_now")).unionByName(saved.select(key, state, F.lit(False).alias("in_now")))
    both = sides.groupBy(key).agg(*[
        x for side, mine in (("now", F.col("in_now")), ("saved", ~F.col("in_now")))
        for x in (F.bool_or(mine).alias(f"in_{side}_tree"), F.max(F.when(mine, F.col(state))).alias(f"state_{side}"))
    ])
    change = (
        F.when(~F.col("in_saved_tree"), "added")
        .when(~F.col("in_now_tree"), "removed")
        .when(~F.col("state_now").eqNullSafe(F.col("state_saved")), "updated")
    )
    return both.withColumn("change", change).where(F.col("change").isNotNull()).select(key, "change", "state_now", "state_saved")


class Published:
    """Versions of an output with the tree that it was made for, in one folder.

    ``root/v-<id>/{output,saved,leaves}`` is written first; then one commit
    (``versions``) makes it live. A reader sees the old three or the new ones,
    never a part; a run that dies before leaves a folder that nothing points
    to, and the next run compares with the old tree, so nothing is skipped.

    ``saved`` lies in folders by ranges of leaves, in their order, so only the
    folders of differing leaves are read again; ``leaves`` are the saved digests.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, state: str, depth: int = DEPTH, folder_bits: int = FOLDER_BITS):
        self.spark, self.root, self.key, self.state, self.depth = spark, root.rstrip("/"), key, state, depth
        self._shift = FAN_BITS * depth - folder_bits
        self.versions = Versions(spark, root)

    def current(self) -> str | None:
        return self.versions.current()[1]

    def _at(self, version: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{version}/{name}")

    def output(self) -> DataFrame:
        """The changes that the live version was published with."""
        return self._at(self.current(), "output")

    def saved(self) -> DataFrame:
        """The records of the live tree."""
        version = self.current()
        if not self._has_rows(version):
            return self.output().limit(0).select(self.key, F.col("state_now").alias(self.state))
        return self._at(version, "saved").select(self.key, self.state)

    def _write_tree(self, version: str, rows: DataFrame) -> None:
        """Records with a key, unique by it, and the digests of their leaves."""
        kept = with_leaf(rows.select(self.key, self.state).where(F.col(self.key).isNotNull()), self.key, self.depth)
        top = F.shiftrightunsigned("__leaf", self._shift).cast("int")
        kept.withColumn("__top", top).repartition("__top").sortWithinPartitions("__top", "__leaf").write.partitionBy("__top").parquet(f"{self.root}/{version}/saved")
        schema = kept.withColumn("__top", top).schema
        again = self.spark.read.schema(schema).parquet(f"{self.root}/{version}/saved")
        leaf_digests(again, self.key, self.state).write.parquet(f"{self.root}/{version}/leaves")

    def _none(self, like: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = with_leaf(like.select(self.key, self.state), self.key, self.depth).withColumn("__top", F.lit(0)).limit(0)
        return rows, leaf_digests(rows, self.key, self.state)

    def start(self, saved: DataFrame) -> None:
        """The first version, from records that are known to be processed; it has no output."""
        version = f"v-{uuid.uuid4().hex}"
        self._write_tree(version, saved)
        none = self._none(saved)[0]
        compared(none, none, self.key, self.state).write.parquet(f"{self.root}/{version}/output")
        self.versions.commit(version, 0)

    def advance(self, now: DataFrame) -> DataFrame:
        """Publishes what changed from the saved records to ``now``, with the tree of ``now``; gives the changes.

        ``now`` is unique by its key; a null key belongs to no record and is
        left out; a null state is a value like others; empty tables are empty
        trees. Saved digests are read, not made again, and of the saved records
        only those in the folders of differing leaves.
        """
        base, old = self.versions.current()
        version = f"v-{uuid.uuid4().hex}"
        self._write_tree(version, now)
        mine = self._at(version, "saved") if self._has_rows(version) else self._none(now)[0]
        theirs, leaves = (self._at(old, "saved"), self._at(old, "leaves")) if old and self._has_rows(old) else self._none(now)
        both = written(side_by_side(self._at(version, "leaves"), leaves), "leaves")  # 64**depth rows at most, and all levels come from it
        pick = written(differing_leaves(both, self.depth), "differing")
        tops = [r[0] for r in pick.select(F.shiftrightunsigned("node", self._shift).cast("int")).distinct().collect()]  # 2**folder_bits at most
        sides = [
            x.where(F.col("__top").isin(tops)).join(F.broadcast(pick.select(F.col("node").alias("__leaf"))), "__leaf", "left_semi")  # 64**depth rows at most
            for x in (mine, theirs)
        ]
        compared(*sides, self.key, self.state).write.parquet(f"{self.root}/{version}/output")
        self.versions.commit(version, base)
        return self._at(version, "output")

    def _has_rows(self, version: str) -> bool:
        """Whether any folder of records was written: an empty table has none."""
        return any(x.isDirectory() for x in self.versions.fs.listStatus(self.versions.path(f"{version}/saved")))


def delta(now: DataFrame, saved: DataFrame, key: str, state: str, depth: int = DEPTH) -> DataFrame:
    """What changed from ``saved`` to ``now``, both unique by ``key``, by way of two published trees in the shared folder."""
    run = Published(now.sparkSession, scratch(now.sparkSession, "trees"), key, state, depth)
    run.start(saved)
    return run.advance(now)


def latest_sightings(scan: DataFrame) -> DataFrame:
    """``filename, modified_at`` of files whose last sighting is ``present``.

    The latest ``seen_at`` counts, among equals the highest ``scan_id``; a null
    ``seen_at`` is older than any. Pre-aggregated, so a file that is seen very
    often costs one row a task.
    """
    last = F.max(F.struct("seen_at", "scan_id", "change", "modified_at")).alias("last")
    return (
        scan.select(normal_path(F.col("filename")).alias("filename"), "seen_at", "scan_id", "change", "modified_at")
        .where(F.col("filename").isNotNull())
        .groupBy("filename").agg(last)
        .where(F.col("last.change") == "present")
        .select("filename", "last.modified_at")
    )


def unsafe_runs(runs: DataFrame) -> DataFrame:
    """``start_at, end_at`` of the runs that did not end well; no end is null.

    A run without ``finished_at`` lasts until the next one starts. Runs are one
    row per run of the whole pipeline, so ordering them in one task is bounded
    by the number of runs, not of records.
    """
    once = runs.dropDuplicates(["run_id"])
    following = F.lead("started_at").over(Window.partitionBy(F.lit(0)).orderBy("started_at", "run_id"))
    return (
        once.select(F.col("started_at").alias("start_at"), F.coalesce("finished_at", following).alias("end_at"), "status")
        .where(F.coalesce(F.col("status") != "ok", F.lit(True)) & F.col("start_at").isNotNull())
        .select("start_at", "end_at")
    )


def safely_indexed(documents: DataFrame, runs: DataFrame) -> DataFrame:
    """Documents whose ``indexed_at`` is set and lies in no unsafe run, ends included.

    Closed runs are laid out by day and met by an equi-join on the day; a run
    without end is the last one, so it is a bound that one aggregate gives.
    """
    bad = unsafe_runs(runs)
    day = lambda c: F.unix_date(F.to_date(c))
    closed = bad.where(F.col("end_at").isNotNull()).select(
        "start_at", "end_at", F.explode(F.sequence(day("start_at"), F.greatest(day("end_at"), day("start_at")))).alias("__day")
    )
    set_ = documents.where(F.col("indexed_at").isNotNull()).withColumn("__day", day("indexed_at"))
    within = (set_["__day"] == closed["__day"]) & (set_["indexed_at"] >= closed["start_at"]) & (set_["indexed_at"] <= closed["end_at"])
    endless = bad.where(F.col("end_at").isNull()).agg(F.min("start_at").alias("since")).select("since", F.lit(1).alias("__one"))
    return (
        set_.join(closed, within, "left_anti")
        .withColumn("__one", F.lit(1))
        .join(F.broadcast(endless), "__one", "left")  # one row by construction
        .where(F.col("since").isNull() | (F.col("indexed_at") < F.col("since")))
        .drop("__day", "__one", "since")
    )


def files_to_process(scan: DataFrame, documents: DataFrame, runs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``filename, change`` of exactly the files that the next run has to process.

    The saved tree holds the documents of runs that ended well; what a failed
    run wrote counts as not saved, so it comes again and nothing is skipped. A
    version of a file is its modification time in whole seconds.
    """
    second = F.unix_seconds(F.col("modified_at").cast("timestamp")).alias("version")
    now = latest_sightings(scan).select("filename", second)
    saved = (
        safely_indexed(documents.select("filename", "modified_at", "indexed_at"), runs)
        .select(normal_path(F.col("filename")).alias("filename"), second)
        .groupBy("filename").agg(F.max("version").alias("version"))
    )
    return delta(now, saved, "filename", "version", depth).where(F.col("change") != "removed").select("filename", "change")
