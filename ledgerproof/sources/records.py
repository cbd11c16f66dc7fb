"""Records of a CSV file that may span lines, found without reading a file in one task.

Where a line starts (outside or inside a quoted cell) decides where it ends, so a line is a map from {outside, inside}
to {outside, inside}: it keeps the state, turns it, or leads to one state whatever came before. Such maps
compose, so they are combined first within each split of a file, then over the splits (one row each), and only then is
it known of each line whether it begins a record. A record cut by a split's edge is stitched to its beginning. Most files lie within
one split, which begins outside: their records are known from the split alone, by one shuffle.

A quote counts at the beginning of a cell only; inside a quoted cell two quotes are one, and any line end reads as a line feed. Where a file ends inside a
quoted cell, the lines from that record's first on stay lines of their own. Only files with a line that ends inside a cell
take part; the lines of all others pass as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerproof.session import broadcast_if_small, materialise

# The inside of a quoted cell; whole cells with their commas, then the beginning of a quoted cell that isn't closed.
_IN = r'(?:[^"]++|"")*+'
_OPENS = rf'(?:(?:"{_IN}"[^,]*+|(?!")[^,]*+),)*+"{_IN}\z'
FROM_OUTSIDE = rf"^{_OPENS}"
FROM_INSIDE = rf'^{_IN}(?:\z|"[^,]*+,{_OPENS})'


def ends_inside(line: Column, started_inside: bool) -> Column:
    quoted = line.contains('"')
    if started_inside:
        return F.when(quoted, line.rlike(FROM_INSIDE)).otherwise(True)
    return F.when(quoted, line.rlike(FROM_OUTSIDE)).otherwise(False)


def _composed(turns: str, settled: str, window) -> tuple[Column, Column]:
    """The lines (or splits) of a window's frame as one map: whether it leads to one state, and that state, or whether it turns."""
    before = F.last(settled, ignorenulls=True).over(window)
    n = F.sum(turns).over(window)
    turned = (n - F.coalesce(before["turns"], F.lit(0))) % 2 == 1
    return before.isNotNull(), F.coalesce(before["inside"], F.lit(False)) != turned


def _with_maps(df: DataFrame, outside: Column, inside: Column, window) -> DataFrame:
    """_turns (0 or 1), and _settled (turns so far, inside) where the map leads to one state."""
    df = df.withColumn("_turns", (outside & ~inside).cast("int")).withColumn("_so_far", F.sum("_turns").over(window))
    settled = F.when(outside == inside, F.struct(F.col("_so_far").alias("turns"), outside.alias("inside")))
    return df.withColumn("_settled", settled).drop("_so_far")


def whole_records(lines: DataFrame) -> DataFrame:
    """lines (path, line_no of block and row, line), with the lines of each record joined by line feeds at its first line_no."""
    opens, cut = F.max(ends_inside(F.col("line"), False)), F.min("line_no.block") != F.max("line_no.block")
    files = materialise(lines.groupBy("path").agg(F.when(~opens, "plain").when(cut, "cut").otherwise("whole").alias("kind")), "line_files")
    found = {r["kind"]: r["count"] for r in files.groupBy("kind").count().collect()}
    if not found.keys() - {"plain"}:
        return lines
    lines = lines.select("path", "line_no", "line")
    read = {"plain": lambda rows: rows, "whole": _within_splits, "cut": _stitched}
    parts = [read[kind](_lines_of(lines, files, kind, found)) for kind in sorted(found)]
    return reduce(DataFrame.unionByName, parts)


def _lines_of(lines: DataFrame, files: DataFrame, kind: str, found: dict[str, int]) -> DataFrame:
    """The lines of one kind of files: by a list of these files or of all others, whichever is shorter."""
    n, others = found[kind], sum(found.values()) - found[kind]
    if not others:
        return lines
    if n <= others:
        return lines.join(broadcast_if_small(files.filter(F.col("kind") == kind).select("path"), n), "path", "left_semi")
    return lines.join(broadcast_if_small(files.filter(F.col("kind") != kind).select("path"), others), "path", "left_anti")


def _with_states(lines: DataFrame) -> DataFrame:
    """_block, _row, and _map: the lines of a split up to each line as one map."""
    c = F.col
    so_far = W.partitionBy("path", "_block").orderBy("_row").rowsBetween(W.unboundedPreceding, W.currentRow)
    maps = lines.withColumns({"_block": c("line_no.block"), "_row": c("line_no.row"), "_0": ends_inside(c("line"), False), "_1": ends_inside(c("line"), True)})
    maps = _with_maps(maps, c("_0"), c("_1"), so_far)
    fixed, state = _composed("_turns", "_settled", so_far)
    return maps.withColumn("_map", F.struct(fixed.alias("fixed"), state.alias("state")))


def _within_splits(lines: DataFrame) -> DataFrame:
    """Records of files that lie within one split: it starts outside, so the state after each line is that of its map."""
    c = F.col
    order = W.partitionBy("path", "_block").orderBy("_row")
    rows = _with_states(lines).withColumn("_inside", c("_map.state"))
    rows = rows.withColumn("_first", ~F.coalesce(F.lag("_inside").over(order), F.lit(False)))
    own = F.last(F.when(c("_first"), c("_row")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("_record", own)
    # Where the file ends inside a cell, the last record's lines stay alone.
    split = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    unclosed = F.last("_inside").over(split) & (c("_record") == F.last("_record").over(split))
    rows = rows.withColumn("_record", F.when(unclosed, c("_row")).otherwise(c("_record")))
    parts = F.array_sort(F.collect_list(F.struct("_row", "line")))
    joined = rows.groupBy("path", "_block", "_record").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("line"))
    return joined.select("path", F.struct(c("_block").alias("block"), c("_record").alias("row")).alias("line_no"), "line")


def _stitched(lines: DataFrame) -> DataFrame:
    c = F.col
    split = W.partitionBy("path", "_block").orderBy("_row")
    maps = _with_states(lines)
    maps = maps.withColumn("_before", F.lag("_map").over(split))
    maps = materialise(maps.select("path", "_block", "_row", "line", "_map", "_before"), "line_states")

    # One row per split: the state it starts in, and the state the file ends in.
    splits = maps.groupBy("path", "_block").agg(F.max_by("_map", "_row").alias("m"))
    order = W.partitionBy("path").orderBy("_block")
    earlier = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    from_outside = c("m.state")
    from_inside = F.when(c("m.fixed"), c("m.state")).otherwise(~c("m.state"))
    splits = _with_maps(splits, from_outside, from_inside, earlier)
    splits = splits.withColumn("_after", _composed("_turns", "_settled", earlier)[1])
    splits = splits.select("path", "_block", F.coalesce(F.lag("_after").over(order), F.lit(False)).alias("_start"), F.last("_after").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_unclosed"))

    def placed(m: str) -> Column:
        """The state after a map, from the state its split starts in."""
        return F.when(c(f"{m}.fixed"), c(f"{m}.state")).otherwise(c(f"{m}.state") != c("_start"))

    rows = maps.join(materialise(splits, "split_states"), ["path", "_block"])
    rows = rows.withColumns({"_first": ~F.when(c("_before").isNull(), c("_start")).otherwise(placed("_before")), "_inside": placed("_map")})
    rows = materialise(rows.select("path", "_block", "_row", "line", "_first", "_inside", "_unclosed"), "record_lines")

    # The last record begun in each split, and the last of the file.
    begun = rows.filter("_first").groupBy("path", "_block").agg(F.max("_row").alias("_row"))
    at = F.struct(c("_block").alias("block"), c("_row").alias("row"))
    begun = splits.select("path", "_block").join(begun.withColumn("_at", at).drop("_row"), ["path", "_block"], "left")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    begun = begun.withColumns({"_carried": F.last("_at", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)), "_last": F.max("_at").over(whole)})
    rows = rows.join(begun.drop("_at"), ["path", "_block"])
    own = F.last(F.when(c("_first"), at), ignorenulls=True).over(W.partitionBy("path", "_block").orderBy("_row").rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("_record", F.coalesce(own, c("_carried")))
    alone = (c("_first") & ~c("_inside")) | (c("_unclosed") & (c("_record") == c("_last")))
    rows = rows.withColumn("_alone", alone)
    single = rows.filter("_alone").select("path", at.alias("line_no"), "line")
    parts = F.array_sort(F.collect_list(F.struct("_block", "_row", "line")))
    joined = rows.filter("not _alone").groupBy("path", "_record").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("line"))
    return single.unionByName(joined.select("path", c("_record").alias("line_no"), "line"))
