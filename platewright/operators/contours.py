"""Contours of label rasters: crack edges between pixels, chains between nodes, closed loops around regions.

A crack lies between two pixels of different labels (no pixel beyond the page's own counts as a label of
its own) and runs in two directions.  Its number packs its place, whether it runs across (0) or down (1),
and the direction (0 right or down, 1 left or up), so a crack's other direction is the number with the
last bit turned.  What follows a directed crack is known at the corner where it ends.  Tiles find their
cracks and put them in order by pointer doubling; lists that cross tiles are joined by pointer doubling
over the places where they enter a tile, so no task ever walks a page.

Places are whole numbers of 0 up to 2^28.  Pages may have any form; a null label is none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewright.operators import tiles
from platewright.operators.lines import along

#: Bits of a place along one axis.
BITS = 29


def local_lists(nxt: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, pos, length, ring, ahead) of lists given by each item's next one, -1 at the end, by pointer doubling.

    `key` is a list's last item or a ring's of least id, where it begins; `ahead` are the steps to the last item.
    """
    here = np.arange(len(nxt))
    at, ahead, low, away, step, before = np.where(nxt < 0, here, nxt), (nxt >= 0).astype(np.int64), here, np.zeros(len(nxt), np.int64), 1, -1
    while True:
        lower = ids[low[at]] < ids[low]
        low, away = np.where(lower, low[at], low), np.where(lower, step + away[at], away)
        at, ahead, step = at[at], ahead + ahead[at], 2 * step
        ring = nxt[at] >= 0
        left = int(ring.sum())
        if not lower.any() and left in (0, before):
            break
        before = left
    key = np.where(ring, low, at)
    length = np.bincount(key, minlength=len(key))[key] if len(key) else np.zeros(0, np.int64)
    return key, np.where(ring, (length - away) % np.maximum(length, 1), length - 1 - ahead), length, ring, ahead


#: What a tile knows of its items' lists; `exit` is the item beyond the tile with which a list goes on.
LOCAL = "list long, pos long, length long, closed boolean, least long, ahead long, exit long"


def _listed(ids: np.ndarray, nxt: np.ndarray, exits: np.ndarray) -> list[pa.Array]:
    """Columns of LOCAL for items with their next one in the tile (-1: none there) and its id beyond the tile (-1: none)."""
    key, pos, length, ring, ahead = local_lists(nxt, ids)
    least = ids.copy()
    np.minimum.at(least, key, ids)
    last = np.where(ring, -1, exits[key])
    return [pa.array(ids[key]), pa.array(pos), pa.array(length), pa.array(ring), pa.array(least[key]), pa.array(ahead), pa.array(last, mask=last < 0)]


def _across(local: DataFrame) -> DataFrame:
    """Tiles' items with their lists of the whole page: `list`, `pos`, `length`, `closed` and `least`, the least id of a list.

    Items with which a list enters a tile are nodes, weighed with the items up to the next one; only they
    take rounds of pointer doubling.
    """
    others = [c for c in local.columns if c not in ("list", "pos", "length", "closed", "least", "ahead", "exit")]
    local = local.checkpoint()
    entered = local.where("exit is not null").select("page", F.col("exit").alias("id")).distinct()
    state = local.join(entered, ["page", "id"]).select("page", "id", F.col("exit").alias("at"), F.col("id").alias("low"), F.lit(0).cast("long").alias("away"), (F.col("ahead") + 1).alias("n"), F.col("list").alias("last")).checkpoint()
    before = -1
    while True:
        there = state.select("page", F.col("id").alias("at"), F.col("at").alias("_at"), F.col("low").alias("_low"), F.col("away").alias("_away"), F.col("n").alias("_n"), F.col("last").alias("_last"))
        met = state.join(there, ["page", "at"], "left")
        lower = F.col("_low") < F.col("low")
        state = met.select("page", "id", F.col("_at").alias("at"), F.coalesce(F.least("low", "_low"), "low").alias("low"), F.when(lower, F.col("n") + F.col("_away")).otherwise(F.col("away")).alias("away"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), F.coalesce("_last", "last").alias("last"), F.coalesce(lower, F.lit(False)).alias("_new")).checkpoint()
        left, new = state.where("at is not null").agg(F.count("*"), F.count_if("_new")).first()
        state = state.drop("_new")
        if not new and left in (0, before):
            break
        before = left
    known = state.select("page", F.col("id").alias("exit"), F.col("at").isNotNull().alias("_ring"), F.col("low").alias("_low"), "away", "n", "last")
    d = local.join(known, ["page", "exit"], "left").withColumn("_ring", F.coalesce("_ring", F.lit(False)))
    ahead = F.col("ahead") + 1
    d = d.withColumns({"_key": F.when(F.col("_ring"), F.col("_low")).otherwise(F.coalesce("last", "list")), "_to": F.when(F.col("_ring"), ahead + F.col("away")).otherwise(ahead + F.coalesce("n", F.lit(0)))})
    w = Window.partitionBy("page", "_key")
    d = d.withColumns({"_n": F.count("*").over(w), "_least": F.min("id").over(w), "_begin": F.min_by("_to", "id").over(w)})
    pos = F.when(F.col("closed"), F.col("pos")).when(F.col("_ring"), F.pmod(F.col("_begin") - F.col("_to"), F.col("_n"))).otherwise(F.col("_n") - F.col("_to"))
    return d.select("page", *(c for c in others if c != "page"), F.when(F.col("_ring"), F.col("_least")).otherwise(F.col("_key")).alias("list"), pos.alias("pos"), F.col("_n").alias("length"), (F.col("closed") | F.col("_ring")).alias("closed"), F.col("_least").alias("least"))


def ranked(links: DataFrame, low: int = 2, bits: int = tiles.BITS) -> DataFrame:
    """(page, id, list, pos, length, closed) of lists given by (page, id, next).

    An id is a place, y and x in BITS bits each, with `low` more bits.  Lists are put in order within tiles of
    places first; what crosses tiles is put in order by its entries.  A list that ends is named by its
    last id; a ring by its least id, where it begins.
    """
    place = F.shiftright("id", low)
    d = links.select("page", "id", "next", tiles.of(F.shiftright(place, BITS), bits).alias("_ty"), tiles.of(place.bitwiseAND(F.lit((1 << BITS) - 1)), bits).alias("_tx"))

    def work(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        ids, after = table.column("id").to_numpy(), table.column("next").combine_chunks().fill_null(-1).to_numpy()
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
        codes = np.unique(np.concatenate([ids, after]), return_inverse=True)[1]
        own, asked = group * (2 * len(ids)) + codes[: len(ids)], group * (2 * len(ids)) + codes[len(ids) :]
        order = np.argsort(own, kind="stable")
        found = order[np.minimum(np.searchsorted(own[order], asked), len(ids) - 1)]
        nxt = np.where((own[found] == asked) & (after >= 0), found, -1)
        return pa.RecordBatch.from_arrays([table.column("page").combine_chunks(), pa.array(ids), *_listed(ids, nxt, np.where(nxt < 0, after, -1))], ["page", "id", *(c.split()[0] for c in LOCAL.split(", "))])

    local = along(d, ["page", "_ty", "_tx"], [], work, f"page {dict(links.dtypes)['page']}, id long, {LOCAL}").checkpoint()
    if local.where("exit is not null").take(1):
        local = _across(local)
    return local.select("page", "id", "list", "pos", "length", "closed")


def _traced(labels: DataFrame, looped: bool, bits: int) -> DataFrame:
    """Directed cracks (page, id, x0, y0, x1, y1, left, right) with `list`, `pos`, `length`, `closed` and `least`, in the order of chains or of loops.

    A tile finds the cracks at its places, what follows each at the corner where it ends, and the order
    of what stays in the tile.
    """
    known = labels.select("page", "x", "y", "label").where(F.col("label").isNotNull())
    kinds = dict(labels.dtypes)

    def work(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        coded = table.column("label").combine_chunks().dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary).to_numpy()
        code = np.argsort(order)[coded.indices.to_numpy()]
        names = coded.dictionary.take(pa.array(order))
        made, first, count = [], [], 0
        for lo, hi, tx, ty, x, y in tiles.each(table, starts):
            ox, oy = int(x.min()) - 1, int(y.min()) - 1
            label = np.full((int(y.max()) - oy + 2, int(x.max()) - ox + 2), -1, np.int64)
            label[y - oy, x - ox] = code[lo:hi]
            if (label[y - oy, x - ox] != code[lo:hi]).any():  # a pixel given twice
                np.maximum.at(label, (y - oy, x - ox), code[lo:hi])
            nw, ne, sw, se = label[:-1, :-1], label[:-1, 1:], label[1:, :-1], label[1:, 1:]
            # what leaves each corner to the right, down, left and up
            there = np.stack([ne != se, sw != se, nw != sw, nw != ne])
            left, right = np.stack([ne, se, sw, nw]), np.stack([se, sw, nw, ne])
            to, i, j = np.nonzero(there & (left >= 0) if looped else there)
            x0, y0 = ox + 1 + j, oy + 1 + i
            number = lambda to, x, y: ((y - (to == 3) << BITS) + (x - (to == 2)) << 2) + 2 * (to & 1) + (to >> 1)
            cx, cy = x0 - (to == 2), y0 - (to == 3)
            own = (cx >> bits == tx) & (cy >> bits == ty)
            to, i, j, x0, y0 = to[own], i[own], j[own], x0[own], y0[own]
            if not len(to):
                continue
            index = np.full(there.shape, -1)
            index[to, i, j] = np.arange(count, count + len(to))
            ei, ej = i + np.array([0, 1, 0, -1])[to], j + np.array([1, 0, -1, 0])[to]
            then = np.full(len(to), -1)
            if looped:  # left turns first
                for turn in (-1, 0, 1):
                    q = (to + turn) % 4
                    then = np.where((then < 0) & there[q, ei, ej] & (left[q, ei, ej] == left[to, i, j]), q, then)
            else:
                two = there.sum(0)[ei, ej] == 2
                for q in range(4):
                    then = np.where(two & there[q, ei, ej] & (q != (to + 2) % 4), q, then)
            nxt = np.where(then < 0, -1, index[then, ei, ej])
            exits = np.where((then >= 0) & (nxt < 0), number(then, ox + 1 + ej, oy + 1 + ei), -1)
            made.append((number(to, x0, y0), x0, y0, ox + 1 + ej, oy + 1 + ei, left[to, i, j], right[to, i, j], nxt, exits))
            first.append(np.full(len(to), lo))
            count += len(to)
        ids, x0, y0, x1, y1, left, right, nxt, exits = (np.concatenate(c) for c in zip(*made, strict=True)) if made else (np.zeros(0, np.int64),) * 9
        named = lambda codes: names.take(pa.array(codes, mask=codes < 0))
        pages = table.column("page").combine_chunks().take(pa.array(np.concatenate(first) if first else np.zeros(0, np.int64)))
        return pa.RecordBatch.from_arrays([pages, *map(pa.array, (ids, x0, y0, x1, y1)), named(left), named(right), *_listed(ids, nxt, exits)], ["page", "id", "x0", "y0", "x1", "y1", "left", "right", *(c.split()[0] for c in LOCAL.split(", "))])

    local = tiles.tiled(known, ("page",), 1, work, f"page {kinds['page']}, id long, x0 long, y0 long, x1 long, y1 long, left {kinds['label']}, right {kinds['label']}, {LOCAL}", bits)
    return _across(local) if tiles.several(known, bits) else local.drop("ahead", "exit")


def chains(labels: DataFrame, bits: int = tiles.BITS) -> DataFrame:
    """(page, chain, pos, x0, y0, x1, y1, left, right, length, closed): cracks in the order of their chains.

    A chain joins two nodes, where other than two cracks meet, or is a ring without nodes, and parts the
    same two labels all along.  Of its two directions the one stays in which its least crack runs right
    or down; that crack names the chain.
    """
    one = _traced(labels, False, bits).where(F.col("least").bitwiseAND(1) == 0)
    return one.select("page", F.col("least").alias("chain"), "pos", "x0", "y0", "x1", "y1", "left", "right", "length", "closed")


def points(chained: DataFrame) -> DataFrame:
    """(page, chain, pos, x, y, length, closed): corners of chains in order, the last one too; a ring ends where it begins."""
    first = F.struct("pos", F.col("x0").alias("x"), F.col("y0").alias("y"))
    last = F.struct((F.col("pos") + 1).alias("pos"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    both = F.when(F.col("pos") == F.col("length") - 1, F.array(first, last)).otherwise(F.array(first))
    return chained.select("page", "chain", F.explode(both).alias("p"), "length", "closed").select("page", "chain", "p.*", "length", "closed")


def loops(labels: DataFrame, bits: int = tiles.BITS) -> DataFrame:
    """(page, label, loop, pos, x0, y0, x1, y1, length): closed outlines with their region on the left; where a region meets itself in a corner it turns left, so diagonal pixels are apart."""
    return _traced(labels, True, bits).select("page", F.col("left").alias("label"), F.col("list").alias("loop"), "pos", "x0", "y0", "x1", "y1", "length")


def loop_areas(looped: DataFrame) -> DataFrame:
    """(page, label, loop, area, length): a loop's area, negative around holes."""
    twice = F.sum(F.col("x1") * F.col("y0") - F.col("x0") * F.col("y1"))
    return looped.groupBy("page", "label", "loop").agg((twice / 2).alias("area"), F.count("*").alias("length"))


def regions(looped: DataFrame) -> DataFrame:
    """(page, label, outlines, holes, area, longest) of each label of a page; the area is its number of pixels."""
    return loop_areas(looped).groupBy("page", "label").agg(F.count_if(F.col("area") > 0).alias("outlines"), F.count_if(F.col("area") < 0).alias("holes"), F.sum("area").cast("long").alias("area"), F.max("length").alias("longest"))
