"""References to records that do not exist: direct orphans, and orphans they leave behind.

A foreign key says which rows of one table point to which rows of another, at what time. A row whose
reference finds no row of the parent that is there at the time of the row is a direct orphan; a row whose
parents exist but are all orphans themselves is an inherited one. The cascade runs level by level down the
graph of foreign keys until no row is added.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators.skew import PARTS_OF_TASK, salted_join
from quillon.storage import keep

#: References that one (key, day) should bring to a task; more are spread over several tasks.
REFS_PER_TASK = 250_000

SCHEMA = "child_table string, row_id long, parent_table string, kind string, origin string, depth int, at timestamp"


@dataclass(frozen=True)
class ForeignKey:
    """child.key points to parent.parent_key. Keys and times are Columns over the tables' own columns.

    at: when the child row refers; since, until: from when and up to when (not including) the parent row is
    there. Without at, time is set aside. strict=False: the parent need not exist, but orphans hand on.
    """

    child: str
    key: Column
    parent: str
    parent_key: Column
    at: Column | None = None
    since: Column | None = None
    until: Column | None = None
    strict: bool = True


def direct_orphans(child: DataFrame, parent: DataFrame, fk: ForeignKey, row_id: str = "row_id") -> DataFrame:
    """Rows of child whose reference finds no parent row that is there: (row_id, kind, at).

    kind: missing (no parent row ever has the key), not_yet (all come later), deleted (one came, none is left),
    undated (the parent is known, the child has no time). A null key is no reference. A parent row without
    `since` is never there; one with until <= since came and went at once. Repeated rows are reported each.

    Physical form: a sweep over time. Comings and goings are summed by (key, day), accumulated over the days
    of each key (a table of days, however many rows a key has), and only then merged with the references of
    the same (key, day), so that a key with a third of all rows is spread over its days; a day of one key with
    more than REFS_PER_TASK references is salted on top.
    """
    refs = child.select(F.col(row_id).alias("row_id"), fk.key.alias("k"), (fk.at if fk.at is not None else F.lit(None).cast("timestamp")).alias("t")).where("k is not null")
    if fk.at is None:
        known = parent.select(fk.parent_key.alias("k")).where("k is not null").distinct()
        return salted_join(refs, known, "k", "left_anti").select("row_id", F.lit("missing").alias("kind"), F.col("t").alias("at"))
    kind = parent.select(fk.since).schema[0].dataType  # times without a zone must not meet one: a union would read them in the session's
    until = fk.until if fk.until is not None else F.lit(None).cast(kind)
    rows = parent.select(fk.parent_key.alias("k"), fk.since.alias("a"), until.alias("b")).where("k is not null")
    steps = rows.select("k", F.explode(F.array(
        F.struct(F.col("a").alias("t"), F.when(F.col("b") <= F.col("a"), 0).otherwise(1).alias("open"), F.lit(1).alias("seen")),
        F.struct(F.when(F.col("b") > F.col("a"), F.col("b")).alias("t"), F.lit(-1).alias("open"), F.lit(0).alias("seen")),
    )).alias("s")).select("k", "s.t", "s.open", "s.seen").where("t is not null")
    day = F.unix_date(F.to_date("t")).alias("d")
    dated = refs.where("t is not null")
    sums = steps.groupBy("k", day).agg(F.sum("open").alias("open"), F.sum("seen").alias("seen"), F.lit(0).cast("long").alias("refs")).unionByName(
        dated.groupBy("k", day).agg(F.lit(0).cast("long").alias("open"), F.lit(0).cast("long").alias("seen"), F.count("*").alias("refs"))
    ).groupBy("k", "d").agg(F.sum("open").alias("open"), F.sum("seen").alias("seen"), F.sum("refs").alias("refs"))
    before = Window.partitionBy("k").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    days = keep(sums.select(
        "k", "d", "refs",
        F.coalesce(F.sum("open").over(before), F.lit(0)).alias("open"),
        F.coalesce(F.sum("seen").over(before), F.lit(0)).alias("seen"),
        F.sum("seen").over(Window.partitionBy("k")).alias("ever"),
    ).where("refs > 0"), "days")
    total, largest = days.agg(F.coalesce(F.sum("refs"), F.lit(0)), F.coalesce(F.max("refs"), F.lit(0))).first()
    most = max(REFS_PER_TASK, total // (PARTS_OF_TASK * int(days.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if largest <= most:
        cut = lambda x: x.withColumn("parts", F.lit(1))
    else:  # at most PARTS_OF_TASK hot days for each shuffle partition
        hot = F.broadcast(days.where(F.col("refs") > most).select("k", "d", F.ceil(F.col("refs") / F.lit(most)).cast("int").alias("parts")))
        cut = lambda x: x.join(hot, ["k", "d"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    spread = lambda x: cut(x).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    none = F.lit(0).cast("long")
    line = (
        spread(days.select("k", "d", F.lit(None).cast(kind).alias("t"), F.lit(0).alias("turn"), "open", "seen", "ever", F.lit(None).cast("long").alias("row_id")))
        .unionByName(spread(steps.select("k", day, "t", F.lit(0).alias("turn"), F.col("open").cast("long"), F.col("seen").cast("long"), none.alias("ever"), F.lit(None).cast("long").alias("row_id"))))
        .unionByName(cut(dated.select("k", day, "t", F.lit(1).alias("turn"), none.alias("open"), none.alias("seen"), none.alias("ever"), F.col("row_id").cast("long"))).withColumn("salt", F.pmod(F.xxhash64("row_id"), F.col("parts")).cast("int")).drop("parts"))
    )
    sweep = Window.partitionBy("k", "d", "salt").orderBy(F.col("t").asc_nulls_first(), "turn").rowsBetween(Window.unboundedPreceding, 0)
    late = line.select("turn", "row_id", "t", *[F.sum(c).over(sweep).alias(c) for c in ("open", "seen", "ever")]).where("turn = 1 and open <= 0").select(
        "row_id", F.when(F.col("ever") == 0, "missing").when(F.col("seen") == 0, "not_yet").otherwise("deleted").alias("kind"), F.col("t").alias("at"))
    known = rows.where("a is not null").select("k").distinct().withColumn("known", F.lit(True))
    undated = salted_join(refs.where("t is null"), known, "k", "left").select("row_id", F.when(F.col("known"), "undated").otherwise("missing").alias("kind"), F.col("t").alias("at"))
    return late.unionByName(undated)


def all_direct_orphans(tables: dict[str, DataFrame], keys: list[ForeignKey], row_id: str = "row_id") -> DataFrame:
    """The direct orphans of all strict keys: SCHEMA, at depth 0."""
    parts = [
        direct_orphans(tables[fk.child], tables[fk.parent], fk, row_id).select(
            F.lit(fk.child).alias("child_table"), "row_id", F.lit(fk.parent).alias("parent_table"), "kind", F.lit("direct").alias("origin"), F.lit(0).alias("depth"), "at")
        for fk in keys if fk.strict
    ]
    return reduce(DataFrame.unionByName, parts) if parts else next(iter(tables.values())).sparkSession.createDataFrame([], SCHEMA)


def orphan_cascade(tables: dict[str, DataFrame], keys: list[ForeignKey], row_id: str = "row_id", max_depth: int = 50) -> DataFrame:
    """All orphans of the tables: SCHEMA; one row per orphaned row and parent table it lacks.

    Level 0 are the direct orphans. Each further level takes the keys of the parent rows that the level before orphaned, and
    of these the ones all of whose rows are orphans by now; their children are new orphans of that depth. Only foreign keys
    whose parent table the level before touched take part. It ends when a level adds none (at max_depth levels with an error, as
    a cycle of keys cannot need more than it has rows). Tables must have row_id, unique within each. Other columns may have
    any names. Empty tables and nulls are fine.
    """
    written: dict[tuple, DataFrame] = {}

    def refs(fk: ForeignKey, side: str) -> DataFrame:
        if (at := (id(fk), side)) not in written:
            table, k = (fk.parent, fk.parent_key) if side == "parent" else (fk.child, fk.key)
            when = fk.at if side == "child" and fk.at is not None else F.lit(None).cast("timestamp")
            written[at] = keep(tables[table].select(F.col(row_id).alias("row_id"), k.alias("k"), when.alias("at")).where("k is not null"), f"{side}-keys")
        return written[at]

    found = new = keep(all_direct_orphans(tables, keys, row_id), "orphans")
    for depth in range(1, max_depth + 1):
        touched = {r["child_table"] for r in new.select("child_table").distinct().collect()}  # table names
        due = [fk for fk in keys if fk.parent in touched]
        if not due:
            return found
        gone = found.select("child_table", "row_id").distinct()
        level = []
        for fk in due:
            parent, kids = refs(fk, "parent"), refs(fk, "child")
            lost = gone.where(F.col("child_table") == fk.parent).select("row_id", F.lit(1).alias("lost"))
            late = new.where(F.col("child_table") == fk.parent).select("row_id")
            keys_hit = parent.join(late, "row_id", "left_semi").select("k").distinct()
            dead = salted_join(parent, keys_hit, "k", "left_semi").join(lost, "row_id", "left").groupBy("k").agg(F.count("*").alias("n"), F.count("lost").alias("lost")).where("n = lost").select("k")
            own = gone.where(F.col("child_table") == fk.child).select("row_id")
            level.append(salted_join(kids, dead, "k", "left_semi").join(own, "row_id", "left_anti").select(
                F.lit(fk.child).alias("child_table"), "row_id", F.lit(fk.parent).alias("parent_table"), F.lit("parent_orphaned").alias("kind"), F.lit("inherited").alias("origin"), F.lit(depth).alias("depth"), "at"))
        new = keep(reduce(DataFrame.unionByName, level), f"orphans-{depth}")
        if new.isEmpty():
            return found
        found = found.unionByName(new)
    raise ValueError(f"the cascade did not end within {max_depth} levels")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts by table, parent, month (yyyy-MM; null without a time), kind and origin."""
    return orphans.groupBy("child_table", "parent_table", F.date_format("at", "yyyy-MM").alias("month"), "kind", "origin").agg(F.count("*").alias("n_rows"))


def file_reference(col: Column) -> Column:
    """A reference without outer blanks, then without a final .txt, then without an ending _chunk<digits>."""
    from quillon.functions.text import BLANK, strip_chunk_suffix

    bare = F.regexp_replace(col, f"^{BLANK}+|{BLANK}+$", "")
    return strip_chunk_suffix(F.regexp_replace(bare, r"\.txt\z", ""))
