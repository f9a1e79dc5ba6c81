"""Questions about versions, asked of a table of them.

The table has ``dataset, version, parent, operation, config, created_at``, one row per
version; ``(dataset, version)`` is unique and ``parent`` is null at a root. A registry of
any size works: everything is a filter, a join on ``(dataset, version)`` or an aggregate.

Joins of whole tables of versions are merge joins by hint. The optimizer knows only the size of the files, in which names take a small part of what they
take in memory, and not how many rows a block or a level makes of one; it would send such a side through the driver to all executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut_lineage

VERSIONS_SCHEMA = (
    "dataset string, version string, parent string, operation string, config string, created_at timestamp_ntz"
)
NUMBERED = "dataset string, version string, enter long, leave long, depth long, given boolean"
TOGETHER = 2_000_000  # versions of a dataset that one task walks through
SPAN_ROWS = 2_000_000  # of the result, that the versions of a span of the walk make on average
LEAST_IN_SPAN, MOST_IN_SPAN = 1_000, 50_000  # versions
MAX_SPAN_TASKS = 4_000
AT_ONCE = 200_000  # members of paths that a task hands on together


def datasets(versions: DataFrame) -> DataFrame:
    return versions.select("dataset").distinct()


def listing(versions: DataFrame, dataset: str | None = None) -> DataFrame:
    """``(dataset, version, created_at)`` in order of creation within each dataset."""
    rows = versions if dataset is None else versions.where(F.col("dataset") == dataset)
    return rows.select("dataset", "version", "created_at").orderBy(
        "dataset", F.col("created_at").asc_nulls_first(), "version"
    )


def metadata(versions: DataFrame, dataset: str, version: str) -> dict:
    row = versions.where((F.col("dataset") == dataset) & (F.col("version") == version)).first()
    if row is None:
        raise ValueError(f"version {version!r} of {dataset!r} does not exist")
    return row.asDict()


def graph(versions: DataFrame) -> DataFrame:
    return versions.select("dataset", "version", "parent")


def intervals(versions: DataFrame) -> DataFrame:
    """``(dataset, version, enter, leave, depth)``: when a walk through a dataset's trees comes to a version and leaves it for good, as a table.

    One row per version, whatever the depth: a version is an ancestor of another exactly if its interval holds the other's. Parents that are
    not among the versions have a row too. Datasets of up to ``TOGETHER`` versions are walked in one task each; larger ones by ranking the list of the walk's
    steps. A cycle is an error.
    """
    return _numbered(versions).drop("given")


def _numbered(versions: DataFrame) -> DataFrame:
    """The intervals, and with ``given`` whether a version is a row of its own or only named as a parent."""
    known = versions.select("dataset", "version", "parent")
    large = cut_lineage(known.groupBy("dataset").count().where(F.col("count") > TOGETHER).select("dataset"))
    if large.isEmpty():
        out = cut_lineage(known.groupBy("dataset").applyInArrow(_walked, NUMBERED))
    else:
        small = known.join(large, "dataset", "left_anti").groupBy("dataset").applyInArrow(_walked, NUMBERED)
        out = cut_lineage(small.union(_ranked(known, large)))
    if not out.where("enter < 0").isEmpty():
        raise ValueError("the parents form a cycle")
    return out


def _walked(group: pa.Table) -> pa.Table:
    """The walk through one dataset, a level of its trees at a time; versions it cannot reach enter at -1."""
    version, parent = group["version"].combine_chunks(), group["parent"].combine_chunks()
    named = parent.drop_null().unique()
    names = pa.concat_arrays([version, named.filter(pc.invert(pc.is_in(named, value_set=version)))])
    up = np.full(len(names), -1)
    up[: len(version)] = pc.index_in(parent, value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)
    by_name = pc.array_sort_indices(names).to_numpy()
    below = by_name[np.argsort(up[by_name], kind="stable")]  # the children of a version side by side, in order of name
    ends = np.cumsum(np.bincount(up + 1, minlength=len(names) + 1))
    levels = [below[: ends[0]]]
    while len(levels[-1]):
        first, counts = ends[levels[-1]], ends[levels[-1] + 1] - ends[levels[-1]]
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        levels.append(below[np.repeat(first, counts) + within])
    size = np.ones(len(names), dtype=np.int64)
    for level in reversed(levels[1:]):
        np.add.at(size, up[level], size[level])
    enter, leave, depth = (np.full(len(names), -1) for _ in range(3))
    for at, level in enumerate(levels[:-1]):
        before = np.cumsum(2 * size[level]) - 2 * size[level]
        own = np.maximum.accumulate(np.where(np.diff(up[level], prepend=-2) != 0, before, 0))  # where the first sibling starts
        enter[level] = before - own + (enter[up[level]] + 1 if at else 0)
        leave[level] = enter[level] + 2 * size[level] - 1
        depth[level] = at
    given = np.arange(len(names)) < len(version)
    return pa.table({"dataset": pa.repeat(group["dataset"][0], len(names)), "version": names, "enter": enter, "leave": leave, "depth": depth, "given": given})


def _ranked(known: DataFrame, large: DataFrame) -> DataFrame:
    """The same from a ranking of the steps: a version's step down goes on with its first child, its step up with its next sibling or its parent's step up.

    Versions are numbers here; names are met once, to find parents. Siblings are ordered inside buckets, and the buckets of a parent by number, so that no
    parent's children meet in one task. No step is pointed at twice.
    """
    large = cut_lineage(large.withColumn("tree", F.monotonically_increasing_id()))
    rows = cut_lineage(known.join(large, "dataset").select("tree", "version", "parent", (F.monotonically_increasing_id() * 2).alias("id")))
    ids = rows.select("tree", F.col("version").alias("parent"), F.col("id").alias("up"))
    rows = cut_lineage(rows.join(ids.hint("merge"), ["tree", "parent"], "left").withColumn("given", F.lit(True)))
    absent = rows.where("parent IS NOT NULL AND up IS NULL").select("tree", "parent").distinct()
    absent = cut_lineage(absent.withColumn("found", F.monotonically_increasing_id() * 2 + 1))
    if not absent.isEmpty():
        rows = rows.join(absent.hint("merge"), ["tree", "parent"], "left").withColumn("up", F.coalesce("up", "found")).drop("found")
        rows = rows.unionByName(absent.select("tree", F.lit(None).cast("string").alias("parent"), F.col("parent").alias("version"), F.col("found").alias("id"), F.lit(None).cast("long").alias("up"), F.lit(False).alias("given")))
    nodes = cut_lineage(rows.select("tree", "version", "id", F.coalesce("up", -1 - F.col("tree")).alias("up"), "given"))  # roots are siblings, below a number of their tree
    lengths = cut_lineage(nodes.groupBy("tree").agg((2 * F.count("*")).alias("length")))
    bucket = F.pmod(F.xxhash64("version"), F.lit(-(-nodes.count() // TOGETHER)))
    inner = Window.partitionBy("up", "bucket").orderBy("version")
    sided = nodes.withColumn("bucket", bucket).select("id", "up", "bucket", F.lead("id").over(inner).alias("beside"), F.row_number().over(inner).alias("nth"))
    sided = cut_lineage(sided)
    along = Window.partitionBy("up").orderBy("bucket")  # one row per bucket of a parent
    firsts = sided.where("nth = 1").select("up", "bucket", F.col("id").alias("first"), F.lead("id").over(along).alias("following"), F.row_number().over(along).alias("bucket_no"))
    firsts = cut_lineage(firsts)
    last = sided.where("beside IS NULL").join(firsts.select("up", "bucket", "following").hint("merge"), ["up", "bucket"]).select("id", "up", F.col("following").alias("beside"))
    step_up = sided.where("beside IS NOT NULL").select("id", "up", "beside").union(last).select(
        (F.col("id") * 2 + 1).alias("step"), F.when(F.col("beside").isNotNull(), F.col("beside") * 2).when(F.col("up") >= 0, F.col("up") * 2 + 1).alias("next"), F.lit(-1).cast("long").alias("height")
    )
    child = firsts.where("bucket_no = 1 AND up >= 0").select(F.col("up").alias("id"), "first")
    step_down = nodes.select("id").join(child.hint("merge"), "id", "left").select(
        (F.col("id") * 2).alias("step"), F.coalesce(F.col("first") * 2, F.col("id") * 2 + 1).alias("next"), F.lit(1).cast("long").alias("height")
    )
    ranks = _suffix_sums(step_down.union(step_up).withColumn("behind", F.lit(1).cast("long")))
    down = F.col("step") % 2 == 0
    both = ranks.groupBy(F.shiftright("step", 1).alias("id")).agg(
        F.max(F.when(down, F.col("behind"))).alias("enter"), F.max(F.when(~down, F.col("behind"))).alias("leave"), F.max(F.when(down, -F.col("height"))).alias("depth")
    )
    both = nodes.join(both.hint("merge"), "id").join(lengths.join(large, "tree"), "tree")
    columns = [F.coalesce(F.col("length") - F.col(c), F.lit(-1)).alias(c) for c in ("enter", "leave")]
    return both.select("dataset", "version", *columns, F.coalesce("depth", F.lit(-1)).alias("depth"), "given")


def _suffix_sums(steps: DataFrame) -> DataFrame:
    """``(step, height, behind)``: sums from every step of lists to the end of its list; null on a circle. No step is ``next`` of two.

    Every step draws a coin in each round; one with heads whose predecessor has tails leaves, and its predecessor points past it. A quarter of the steps leaves
    in a round, so all rounds together move a few rows per step. What few are left are added up in one task, and those that left take their sums from
    the step they pointed at, in reverse.
    """
    live, left, no = steps, [], 0
    while True:
        circle = F.col("next") == F.col("step")
        values = [F.when(~F.coalesce(circle, F.lit(False)), F.col(c)).alias(c) for c in ("height", "behind")]
        live = cut_lineage(live.select("step", F.when(~circle, F.col("next")).alias("next"), *values))
        if live.where("next IS NOT NULL").count() <= TOGETHER:  # the others are the ends of lists, of which a tree of versions has one
            break
        heads, next_heads = (F.xxhash64(c, F.lit(no)) % 2 == 0 for c in ("step", "next"))
        meets = F.col("next").isNotNull() & next_heads  # a hash of null is a number
        before = live.where(~heads & meets).select(F.col("step").alias("a"), F.col("next").alias("step"), F.col("height").alias("a_height"), F.col("behind").alias("a_behind"))
        met = cut_lineage(live.where(heads).join(before.hint("merge"), "step", "left"))
        sums = [(F.col(c) + F.col(f"a_{c}")).alias(c) for c in ("height", "behind")]
        live = live.where(~heads & ~meets).union(met.where("a IS NULL").select("step", "next", "height", "behind")).union(met.where("a IS NOT NULL").select(F.col("a").alias("step"), "next", *sums))
        left.append(met.where("a IS NOT NULL").select("step", "next", "height", "behind"))
        no += 1
    done = cut_lineage(live.groupBy().applyInArrow(_added_up, "step long, height long, behind long"))
    for gone in reversed(left):
        ahead = done.select(F.col("step").alias("next"), F.col("height").alias("b_height"), F.col("behind").alias("b_behind"))
        sums = [(F.col(c) + F.when(F.col("next").isNull(), 0).otherwise(F.col(f"b_{c}"))).alias(c) for c in ("height", "behind")]
        done = done.union(cut_lineage(gone.join(ahead.hint("merge"), "next", "left").select("step", *sums)))
    return done


def _added_up(steps: pa.Table) -> pa.Table:
    """The sums of few lists: every step takes over what the step it points at has seen, and its pointer."""
    step, following = steps["step"].to_numpy(), steps["next"]
    order = np.argsort(step)
    at = np.searchsorted(step, following.fill_null(-1).to_numpy(), sorter=order)
    n = len(step)
    at = np.append(np.where(following.is_null().to_numpy(), n, order[np.minimum(at, n - 1)]), n)  # the last place is the end
    on_circle = np.append(steps["behind"].is_null().to_numpy(), False)
    sums = [np.append(steps[c].fill_null(0).to_numpy(), 0) for c in ("height", "behind")]
    for _ in range(n.bit_length() + 1):
        sums, on_circle, at = [s + s[at] for s in sums], on_circle | on_circle[at], at[at]
    bad = (on_circle | (at != n))[:n]
    return pa.table({"step": step, **{c: pa.array(s[:n], mask=bad) for c, s in zip(("height", "behind"), sums)}})


def _stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The paths of versions that come in the walk's order: a version's ancestors are the last ones seen at each smaller depth.

    Only one path is carried from batch to batch. A path is handed on in pieces of at most ``AT_ONCE`` members.
    """
    carried = None
    for batch in batches:
        dataset, depths, version, asked = (batch[c] for c in ("dataset", "depth", "version", "asked"))
        depths, asked = depths.to_numpy(), asked.to_pylist()
        held = 0 if carried is None else len(carried)
        pool = version if carried is None else pa.concat_arrays([carried, version])
        stack = np.zeros(max(held, int(depths.max(initial=0)) + 1), dtype=np.int64)
        stack[:held] = np.arange(held)
        members, n = np.empty(AT_ONCE, dtype=np.int64), 0
        rows, starts, ends = [], [], [0]

        def piece():
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pool.take(pa.array(members[:n])))
            at = pa.array(rows, pa.int64())
            return pa.RecordBatch.from_arrays(
                [dataset.take(at), version.take(at), pa.array(depths[rows]), pa.array(starts, pa.int64()), lists], ["dataset", "version", "depth", "start", "members"]
            )

        for i, depth in enumerate(depths.tolist()):
            stack[depth] = held + i
            if not asked[i]:
                continue
            start = 0
            while start <= depth:
                if n == AT_ONCE or start == 0 and n + depth >= AT_ONCE and n:
                    yield piece()
                    n, rows, starts, ends = 0, [], [], [0]
                many = min(depth + 1 - start, AT_ONCE - n)
                members[n : n + many] = stack[start : start + many]
                rows.append(i)
                starts.append(start)
                n += many
                ends.append(n)
                start += many
        if rows:
            yield piece()
        if len(depths):
            carried = pool.take(pa.array(stack[: depths[-1] + 1]))


def _paths(numbered: DataFrame) -> DataFrame:
    """``(dataset, version, depth, step, member)`` of the versions that are ``asked``.

    The walk's time is cut into spans. A task goes through the versions of a span in the walk's order and needs, besides them, the versions that are open when the
    span begins: one path. So what is shuffled is a row per version, and one per span and open version; the rows of the result are made where they are used.
    """
    versions, total = numbered.agg(F.count("*"), F.sum(F.col("depth") + 1)).first()
    total = total or 0
    width = 2 * min(MOST_IN_SPAN, max(LEAST_IN_SPAN, SPAN_ROWS * (versions or 1) // max(1, total)))
    parts = max(int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MAX_SPAN_TASKS, total // SPAN_ROWS))
    first, last = (F.floor(F.col(c) / width).cast("long") for c in ("enter", "leave"))
    own = numbered.select("dataset", first.alias("span"), F.col("enter").alias("at"), "depth", "version", "asked")
    through = numbered.where(last > first).select("dataset", F.explode(F.sequence(first + 1, last)).alias("span"), F.lit(-1).cast("long").alias("at"), "depth", "version", F.lit(False).alias("asked"))
    rows = own.union(through).repartition(parts, "dataset", "span").sortWithinPartitions("span", "dataset", "at", "depth")
    found = rows.select("dataset", "depth", "version", "asked").mapInArrow(_stacked, "dataset string, version string, depth long, start long, members array<string>")
    found = found.select("dataset", "version", "depth", "start", F.posexplode("members").alias("pos", "member"))
    return found.select("dataset", "version", "depth", (F.col("start") + F.col("pos")).alias("step"), "member")


def _asked(numbered: DataFrame, of: DataFrame) -> DataFrame:
    of = of.select("dataset", "version").distinct().withColumn("asked", F.lit(True))
    return numbered.join(of.hint("merge"), ["dataset", "version"], "left").withColumn("asked", F.coalesce("asked", F.lit(False)))


def paths(numbered: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``(dataset, version, step, member)`` from :func:`intervals`: which intervals hold the versions (``of`` these only).

    The result has a row per version and ancestor; nothing else does.
    """
    return _paths(numbered.withColumn("asked", F.lit(True)) if of is None else _asked(numbered, of)).drop("depth")


def ancestors(versions: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``(dataset, version, ancestor, distance)``, each version being its own ancestor at 0; ``of`` limits the versions. A cycle is an error."""
    numbered = _numbered(versions)
    found = _paths(numbered.withColumnRenamed("given", "asked") if of is None else _asked(numbered, of))
    return found.select("dataset", "version", F.col("member").alias("ancestor"), (F.col("depth") - F.col("step")).alias("distance"))


def depths(versions: DataFrame) -> DataFrame:
    """``(dataset, version, depth)``: links up to the root.

    Every version points at an ancestor and knows the distance; in a round each takes over its pointer's pointer. One row
    per version and round, and as many rounds as the depth has binary digits. The right side of a round's join is unique, so
    a popular ancestor is a skewed key of the left side only, which the optimizer splits. A cycle is an error.
    """
    known = versions.select("dataset", "version", F.col("parent").alias("up"), F.col("parent").isNotNull().cast("long").alias("depth"))
    rounds = max(1, versions.count()).bit_length() + 1
    for _ in range(rounds):
        known = cut_lineage(known)
        moving = known.where("up IS NOT NULL")
        if moving.isEmpty():
            return known.select("dataset", "version", "depth")
        below_root = known.where("depth > 0").select("dataset", F.col("version").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        further = moving.join(below_root.hint("merge"), ["dataset", "up"], "left")
        further = further.select("dataset", "version", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        known = known.where("up IS NULL").unionByName(further)
    raise ValueError("the parents form a cycle")


def lineage(versions: DataFrame, dataset: str | None = None, version: str | None = None) -> DataFrame:
    """``(dataset, version, step, member)``: the path from the root (step 0) to each version.

    With a dataset only its versions are read; with a version its path is a filter of the intervals.
    """
    if dataset is not None:
        versions = versions.where(F.col("dataset") == dataset)
    if version is None:
        return _paths(_numbered(versions).withColumnRenamed("given", "asked")).drop("depth")
    of = versions.where(F.col("version") == version)
    if of.isEmpty():
        raise ValueError(f"version {version!r} does not exist")
    numbered = intervals(versions)
    own = numbered.where(F.col("version") == version).select("dataset", "version", F.col("enter").alias("at"))  # one row per dataset
    held = numbered.select("dataset", F.col("version").alias("member"), F.col("depth").alias("step"), "enter", "leave").join(own, "dataset")
    return held.where("enter <= at AND at <= leave").select("dataset", "version", "step", "member")


def removable(versions: DataFrame) -> DataFrame:
    """Versions that are nobody's parent; ``raw`` never is one."""
    parents = versions.where("parent IS NOT NULL").select("dataset", F.col("parent").alias("version")).distinct()
    return versions.where("version <> 'raw'").join(parents.hint("merge"), ["dataset", "version"], "left_anti")


def search(versions: DataFrame, text: str = "", operation: str | None = None) -> DataFrame:
    """Names containing ``text`` in any case, of one operation if given."""
    rows = versions.where(F.lower("version").contains(text.lower())) if text else versions
    return rows if operation is None else rows.where(F.col("operation") == operation)


def by_time(versions: DataFrame, newest_first: bool = True) -> DataFrame:
    """Sorted by creation; a missing time counts as the earliest."""
    time = F.col("created_at")
    order = time.desc_nulls_last() if newest_first else time.asc_nulls_first()
    return versions.orderBy(order, "dataset", "version")


def forest(versions: DataFrame) -> DataFrame:
    """``(dataset, version, shown_parent, depth)``: a version whose parent is not among the rows is a root."""
    here = versions.select("dataset", F.col("version").alias("parent"), F.lit(True).alias("found"))
    linked = versions.join(here.hint("merge"), ["dataset", "parent"], "left").select(
        "dataset", "version", F.when(F.col("found"), F.col("parent")).alias("parent")
    )
    return linked.join(depths(linked).hint("merge"), ["dataset", "version"]).select(
        "dataset", "version", F.col("parent").alias("shown_parent"), "depth"
    )


def operations(versions: DataFrame) -> DataFrame:
    return versions.select(F.coalesce("operation", F.lit("unknown")).alias("operation")).distinct().orderBy("operation")
