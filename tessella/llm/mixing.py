"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a share of all words by its weight, at most ``most`` times its own
size.  A document's expected number of copies is target / size of its source; the whole
part is certain, and the fraction is rounded by the pivotal method: two documents trade words
at random, without bias, until one has a whole number of copies, so a source's words stay as
they are.  Documents are dealt to groups of about ``group_rows``; each group leaves at most one
undecided document, and the residuals meet in further groups of 64, level by level, until a
source has one.  All draws come from hashes of ids, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut
from tessella.operators.hilbert import row_index

WORD = r"[^\x20\x09-\x0D]+"
_FAN_IN = 64
#: Rows, or copies of a row, that one part of a large set of repeats has.
_PART_ROWS = 10_000


def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """Per source: ``source_size``, ``target``, ``n_rows`` and ``number`` (by code point, null last).

    ``sizes`` has ``source`` and ``size``.  A target stops at ``most`` times the source's size and the excess is
    shared again by weight: words left over are dealt to the sources that are not full, until no further one fills up
    (each round is one aggregate over a row a source).  Sources are numbered by a range sort, so neither needs
    all sources in one task.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("number"), F.lit(len(weights))) + 1)
    numbered = row_index(per, [F.col("source").isNull(), F.col("source")], "number", start=0).withColumn("number", F.col("number").cast("int"))
    per = cut(numbered.withColumn("weight", w))
    full = F.lit(float(most)) * F.col("source_size")
    total, weight = per.agg(F.sum("source_size"), F.sum("weight")).first()
    level, known = (total / weight if weight else 0.0), 0
    while True:
        is_full = F.col("weight") * F.lit(level) >= full
        n, size, free = per.agg(F.count_if(is_full), F.sum(F.when(is_full, F.col("source_size"))), F.sum(F.when(~is_full, F.col("weight")))).first()
        if n == known:
            break
        level, known = ((total - most * size) / free if free else float("inf")), n
    return per.select("source", "source_size", F.least(full, F.col("weight") * F.lit(level)).alias("target"), "n_rows", "number")


def pivot(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> int:
    """Rounds the fractions ``p`` in place, keeping ``sum(p * size)``; index left undecided or -1."""
    at = -1
    for j in range(len(p)):
        if not 0.0 < p[j] < 1.0:
            continue
        if at < 0:
            at = j
            continue
        a, b = p[at] * size[at], p[j] * size[j]
        up = min(size[at] - a, b)  # words from j to at
        down = min(a, size[j] - b)
        if draws[j] * (up + down) < down:
            if size[at] - a <= b:
                p[at], p[j] = 1.0, (b - up) / size[j]
            else:
                p[at], p[j] = (a + up) / size[at], 0.0
        elif a <= size[j] - b:
            p[at], p[j] = 0.0, (b + down) / size[j]
        else:
            p[at], p[j] = (a - down) / size[at], 1.0
        at = next((k for k in (at, j) if 1e-12 < p[k] < 1 - 1e-12), -1)
    return at


def _rounded(last: bool):
    """Group function: rounds the fractions ``p`` of a group into ``extra``; at most one row stays open."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["draw", "size", "p"], kind="stable")
        p = pdf["p"].to_numpy(float).copy()
        draw = (pdf["draw"].to_numpy(np.int64).astype(np.uint64) >> np.uint64(11)).astype(float) / 2.0**53
        at = pivot(p, pdf["size"].to_numpy(float), np.roll(draw, 1))
        if last and at >= 0:
            p[at], at = float(draw[at] < p[at]), -1
        pdf["open"] = np.arange(len(p)) == at
        pdf["extra"] = np.where(pdf["open"], 0, np.rint(p)).astype(np.int64)
        pdf["p"] = p
        return pdf

    return run


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, group_rows: int = 4096, seed: int = 0,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, source, size, source_size, target, copies, taken``.

    Null texts and texts without words have size 0 and take no words; a null source is a source.
    Rows of equal id, source and size are one unit of that many rows: their certain copies are
    shared out evenly, and one fraction is rounded, so a huge set of repeats is one row here.  Ties in all
    draws are broken by ids and sizes.  Texts of any length are counted whole; an empty table gives an empty
    result, and columns other than the three named are left alone.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"))
    units = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    return _mix_units(rows, units, weights, most, group_rows, seed)


def _mix_units(rows: DataFrame, units: DataFrame, weights: tuple, most: float, group_rows: int, seed: int) -> DataFrame:
    targets = source_targets(rows, weights, most)
    known = targets.agg(F.count("*").alias("n"), F.max("n_rows").alias("rows")).first()
    if not known["n"]:
        return units.select("doc_id", "source", "size").withColumns(
            {"source_size": F.lit(0).cast("bigint"), "target": F.lit(0.0), "copies": F.lit(0).cast("bigint"), "taken": F.lit(0).cast("bigint")}
        )
    if known["n"] <= 10_000:  # a checked size; more sources are joined by a shuffle
        targets = F.broadcast(targets)
    groups = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / group_rows))
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    kind, source_kind = (units.schema[c].dataType.simpleString() for c in ("doc_id", "source"))
    dealt = (
        units.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("f", F.least(factor, F.lit(float(most))))
        # each row's certain copies; then the unit's further whole copies and its fraction
        .withColumn("whole", F.floor(F.col("f") + 1e-9))
        .withColumn("rest", F.greatest(F.lit(0.0), (F.col("f") - F.col("whole")) * F.col("rows")))
        .withColumn("more", F.floor(F.col("rest") + 1e-9))
        .withColumn("p", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), F.col("rest") - F.col("more"))).otherwise(F.lit(0.0)))
        .withColumn("draw", F.xxhash64("doc_id", "size", F.lit(seed)))
        .withColumn("unit_group", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed + 1)), groups).cast("bigint"))
        .select("doc_id", "source", "size", "rows", "source_size", "target", "number", "whole", "more", "p", "draw", "unit_group")
    )
    schema = (
        f"doc_id {kind}, source {source_kind}, size bigint, rows bigint, source_size bigint, target double, number int, "
        "whole bigint, more bigint, p double, draw bigint, unit_group bigint, open boolean, extra bigint"
    )
    # every level of the tree and the last join read it: rounding is done once
    first = cut(dealt.groupBy("number", "unit_group").applyInPandas(_rounded(False), schema))

    small = "number int, unit_group bigint, size bigint, p double, draw bigint, level_group bigint, open boolean, extra bigint"
    left = first.where("open").select("number", "unit_group", "size", "p", "draw", F.col("unit_group").alias("level_group"))
    number, decided = -(-known["rows"] // group_rows), None
    while True:
        number = -(-number // _FAN_IN)
        done = left.withColumn("level_group", F.floor(F.col("level_group") / _FAN_IN)).groupBy("number", "level_group").applyInPandas(
            _rounded(number <= 1), small
        )
        part = done.where(~F.col("open")).select("number", "unit_group", F.col("extra").alias("late"))
        decided = part if decided is None else decided.unionByName(part)
        if number <= 1:
            break
        left = done.where("open").select(*left.columns)

    # each row's copies: an equal share of the unit's further copies, the first rows one more
    units = first.join(decided, ["number", "unit_group"], "left").withColumn(
        "further", F.col("more") + F.when(F.col("open"), F.coalesce("late", F.lit(0))).otherwise(F.col("extra"))
    )
    spread = units.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / _PART_ROWS)))).withColumn(
        "_row", F.explode(F.sequence(F.col("_block") * _PART_ROWS, F.least(F.col("rows"), (F.col("_block") + 1) * _PART_ROWS) - 1))
    )
    copies = F.col("whole") + F.floor(F.col("further") / F.col("rows")) + (F.col("_row") < F.pmod("further", "rows")).cast("bigint")
    return spread.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` with their columns, each as often as the mix takes it.

    Texts are sent once, to be joined with the number of copies.  Rows of equal id, source and size are alike to the
    mix: only those are numbered, equal ones together, to share the copies; they are dealt to parts of about
    ``_PART_ROWS`` by a hash of the row, so a huge set of them (say, of the null id) is never in one task.  Null texts and
    texts without words are taken like others by their source's factor, sources and ids may be null, an empty table
    gives an empty result, and columns may have any names.
    """
    taken = cut(mix(docs, id_col, text_col, source_col, **options))
    key = ["doc_id", "source", "size"]
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"))
    # all rows of a unit have ``low`` copies, ``extra`` of them one more
    low = F.min("copies")
    units = taken.groupBy(*key).agg(F.count("*").alias("rows"), low.alias("low"), (F.sum("copies") - low * F.count("*")).alias("extra"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    of_unit = lambda df, units: df.alias("a").join(units.alias("b"), same[0] & same[1] & same[2])
    single = of_unit(rows, units.where("rows = 1 and low > 0"))
    out = single.select("a.row", F.explode(F.sequence(F.lit(1), F.col("b.low")))).select("row.*")
    repeated = cut(units.where("rows > 1"))
    if not repeated.isEmpty():
        parts = F.ceil(F.col("rows") / _PART_ROWS)
        alike = of_unit(rows, repeated).select("a.*", "b.rows", "b.low", "b.extra").groupBy(*key, "rows", "low", "extra", "row").agg(F.count("*").alias("n"))
        alike = cut(alike.withColumn("hash", F.xxhash64("row")).withColumn("part", F.pmod(F.col("hash"), parts)))
        ahead = (Window.unboundedPreceding, -1)
        first = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("part").rowsBetween(*ahead)), F.lit(0))
        begins = alike.groupBy(*key, "part").agg(F.sum("n").alias("n")).select(*key, "part", first.alias("begin"))
        inside = F.coalesce(F.sum("n").over(Window.partitionBy(*key, "part").orderBy("hash").rowsBetween(*ahead)), F.lit(0))
        placed = of_unit(alike.withColumn("inside", inside), begins.withColumnRenamed("part", "_part")).where("part = _part")
        place = F.col("begin") + F.col("inside")
        total = F.col("low") * F.col("n") + F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - place))
        several = placed.select("row", "hash", total.alias("total")).where("total > 0")
        dealt = several.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / _PART_ROWS)))).repartition("hash", "block")
        number = F.least(F.lit(_PART_ROWS), F.col("total") - F.col("block") * _PART_ROWS)
        out = out.unionByName(dealt.select("row", F.explode(F.sequence(F.lit(1), number))).select("row.*"))
    return out
