"""Shards of near-equal bytes by a histogram sort, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.llm.common import cut, text_or_empty

#: A splitter is good if the bytes below it miss the target by no more than this share of a shard.
TOLERANCE = 0.001
#: Candidate boundaries that a round puts between the bounds of one splitter.
PROBES = 256
#: The lowest value of a level of the key.
_LOWEST = -(1 << 63)
#: Levels of the key: text checksum, doc_id, and a number that tells rows apart that agree in both.
LEVELS = ("major", "minor", "row")


def _reached(bounds: list[tuple[int, ...]], *key: Column) -> Column:
    """How many of the sorted bounds a key has reached; there is at most one bound a shard."""
    out = F.lit(0)
    for bound in bounds:
        above = F.lit(True)
        for b, k in reversed(list(zip(bound, key))):
            above = (k > b) | ((k == b) & above)
        out = out + above.cast("int")
    return out


def splitters(rows: DataFrame, targets: list[float], slack: float) -> list[tuple[int, ...]]:
    """The keys (major, minor, row) at which the bytes below come within ``slack`` of each target, or else next to it.

    ``rows`` has long columns of LEVELS and size. A round puts PROBES candidates between the bounds of every open
    target, counts the exact bytes between neighbouring candidates over all partitions, and narrows the bounds. Where a single row holds more than the slack, the nearer side of it is taken; where
    rows of a single value do, the same goes on over the next level within that value, for all such values in the same rounds. What comes to the driver
    is PROBES sums per target and round, and there are as many targets as shards, less one, however many rows.
    """
    done: dict[int, tuple[int, ...]] = {}
    # targets by the values that their key is known to begin with: number and bytes below those rows
    waiting: dict[tuple[int, ...], dict[int, int]] = {(): dict.fromkeys(range(len(targets)), 0)} if targets else {}
    for depth, key in enumerate(LEVELS):
        if not waiting:
            break
        prefixes = sorted(waiting)
        group = F.lit(None).cast("int")
        for g, prefix in enumerate(prefixes):
            inside = F.lit(True)
            for name, value in zip(LEVELS, prefix):
                inside &= F.col(name) == value
            group = F.when(inside, g).otherwise(group)
        level = rows.select(group.alias("g"), F.col(key).alias("k"), "size").where("g IS NOT NULL")
        ends = {r["g"]: (r["low"], r["high"] + 1) for r in level.groupBy("g").agg(F.min("k").alias("low"), F.max("k").alias("high")).collect()}
        state = {i: (g, *ends[g], below) for g, prefix in enumerate(prefixes) for i, below in waiting[prefix].items()}
        deeper: dict[tuple[int, ...], dict[int, int]] = {}
        while state:
            closed, deep, state = _round(level, state, targets, slack, depth == len(LEVELS) - 1)
            for i, (g, at) in closed.items():
                done[i] = (*prefixes[g], at) + (_LOWEST,) * (len(LEVELS) - 1 - depth)
            for i, (g, at, below) in deep.items():
                deeper.setdefault((*prefixes[g], at), {})[i] = below
        waiting = deeper
    return [done[i] for i in range(len(targets))]


def _round(level: DataFrame, state: dict[int, tuple[int, int, int, int]], targets: list[float], slack: float, last: bool):
    """One round over rows of g, k and size: counts between candidates of all open targets (group, bounds, bytes below). Returns the targets that are found, those to be sought within a value, and the others with narrower bounds."""
    # open bounds never overlap in part
    edges = sorted({(g, lo, hi) for g, lo, hi, _ in state.values()})
    widths = [max(1, -(-(hi - lo) // PROBES)) for _, lo, hi in edges]
    grid = {edge: (n, width) for n, (edge, width) in enumerate(zip(edges, widths))}
    at = _reached([(g, lo) for g, lo, _ in edges], F.col("g"), F.col("k")) - 1
    of = lambda numbers: F.get(F.lit([int(x) for x in numbers]).cast("array<bigint>"), F.col("n"))
    found = level.select(at.alias("n"), "g", "k", "size").where((F.col("n") >= 0) & (F.col("g") == of(g for g, _, _ in edges)) & (F.col("k") < of(hi for _, _, hi in edges)))
    cells = found.groupBy("n", F.call_function("div", F.col("k") - of(lo for _, lo, _ in edges), of(widths)).alias("cell")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    counted: dict[int, dict[int, tuple[int, int]]] = {}
    for r in cells.collect():
        counted.setdefault(r["n"], {})[r["cell"]] = (r["bytes"], r["rows"])
    closed, deep, left = {}, {}, {}
    for i, (g, lo, hi, below) in state.items():
        n, width = grid[(g, lo, hi)]
        for cell in sorted(counted.get(n, {})):
            weight, held = counted[n][cell]
            if below + weight > targets[i]:
                break
            below += weight
        at = lo + cell * width
        under, over = targets[i] - below, below + weight - targets[i]
        if under <= slack or ((held == 1 or (last and width == 1)) and under <= over):
            closed[i] = (g, at)
        elif over <= slack or held == 1 or (last and width == 1):
            closed[i] = (g, at + width)
        elif width > 1:
            left[i] = (g, at, min(hi, at + width), below)
        else:
            deep[i] = (g, at, below)
    return closed, deep, left


def histogram_shards(df: DataFrame, n_shards: int, text: str = "text", doc_id: str = "doc_id", tolerance: float = TOLERANCE) -> DataFrame:
    """Put documents into ``n_shards`` shards of near-equal bytes, sorted by (text_crc32, doc_id) over all shards.

    Texts with equal checksums are neighbours in that order, by doc_id, so equal texts share a shard unless a boundary has to cut among
    those of their checksum; texts that differ may share a checksum. The rounds of ``splitters`` find the boundaries; then one exchange by range of the whole key sorts the
    rows, and a row's slot is its number in its range plus the rows of the shard in earlier ranges. Only ids, checksums and sizes are exchanged, never texts.

    Returns doc_id, size (UTF-8 bytes plus 8), text_crc32, law ('bytes'), shard, slot, grown_shard (null). A null
    text has no bytes; a null doc_id sorts first; repeated rows are kept and neighbours, and a boundary may lie between them; an empty table gives no rows.
    """
    body = text_or_empty(text)
    rows = cut(
        df.select(F.col(doc_id).cast("long").alias("doc_id"), F.crc32(F.encode(body, "UTF-8")).alias("major"), (F.octet_length(body) + 8).cast("long").alias("size")).withColumns(
            {"minor": F.coalesce("doc_id", F.lit(_LOWEST + 1)), "row": F.monotonically_increasing_id()}
        )
    )
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    keys = splitters(rows, [total * i / n_shards for i in range(1, n_shards)], tolerance * total / n_shards) if n else []
    key = [F.col(c) for c in LEVELS]
    ranged = rows.withColumn("shard", _reached(keys, *key)).repartitionByRange(*key).sortWithinPartitions(*key)
    numbered = cut(ranged.select("doc_id", "size", "major", "shard", F.monotonically_increasing_id().alias("at")))
    # the upper bits of a row's number are its range's
    place = F.shiftright("at", 33)
    counts = numbered.groupBy(place.alias("range"), "shard").agg(F.count("*").alias("rows"), F.min("at").alias("from"))
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("range", "shard", (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("from")).alias("base"))
    placed = numbered.withColumn("range", place).join(F.broadcast(bases), ["range", "shard"])
    return placed.select("doc_id", "size", F.col("major").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("at")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
