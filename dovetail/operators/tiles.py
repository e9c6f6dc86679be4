"""Links of images that share a band, by tiles: a bucket's images, in bounded pieces, against themselves and each other.

A bucket of many near images has links in the square of its size, so they are never rows. ``ties`` gives enough of them to know the
components: in a tile, images are taken in from a front of those found, compared with those not found yet, which are soon none where
all are near. ``link_counts`` compares all of a tile, and keeps two numbers for each image. Either is exact; a tile is a few hundred KB in one
task, and a bucket is as many tasks as it has pairs of tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dovetail.functions import scoring
from dovetail.sources import shared

#: Images in a tile, on average.
TILE = 8192
_NONE = -(1 << 63)


def _tiles(bands: DataFrame, size: int) -> DataFrame:
    """i, v, cell (of the shape), c and the images x of each tile of buckets that have two images."""
    rows = bands if "orig" in bands.columns else bands.withColumn("orig", F.lit(None).cast("long"))
    rows = rows if "old" in rows.columns else rows.withColumn("old", F.lit(False))
    ratio = F.try_divide("width", "height")
    lower = [F.xxhash64(scoring.band(F.col("phash"), k)).alias(f"b{k}") for k in range(3)]
    x = F.struct("id", scoring.bits(F.col("phash")).alias("p"), scoring.bits(F.col("dhash")).alias("d"), F.char_length("dhash").cast("long").alias("n"), "ratio", *lower, F.coalesce("orig", F.lit(_NONE)).alias("orig"), F.col("old").cast("long").alias("old"))
    rows = rows.withColumn("ratio", ratio).where("ratio > 0 and dhash <> '' and length(dhash) <= 16")
    # shapes that agree within one in a hundred are in the same step of a twentieth of their logarithm, or in the next
    rows = shared.stash(rows.select("i", "v", F.floor(20 * F.ln("ratio")).alias("cell"), x.alias("x")), "band-points")
    counts = rows.groupBy("i", "v", "cell").agg(F.count("*").alias("k"), F.bool_and(F.col("x.old") == 1).alias("known"))
    live = counts.groupBy("i", "v").agg(F.sum("k").alias("all"), F.bool_and("known").alias("known")).where("all > 1 and not known").select("i", "v")
    dealt = rows.join(counts.join(live, ["i", "v"]).select("i", "v", "cell", F.ceil(F.col("k") / size).alias("parts")), ["i", "v", "cell"])
    dealt = dealt.withColumn("c", F.pmod(F.xxhash64("x.id"), F.col("parts")))
    return shared.stash(dealt.groupBy("i", "v", "cell", "c").agg(F.collect_list("x").alias("x"), F.min("x.old").alias("known")), "tiles")


def _screen(linked: Callable, most: int = 1024) -> Callable:
    """Which tiles, or pairs of them where ``paired``, may have a link that no lower band has had. ``left``, ``right``: where each one's images begin and end
    in ``x``. Up to ``most`` pairs of images of a tile are looked at, those of all tiles at once; a larger tile may have one. Most buckets hold a few
    unrelated images, and taking up each by itself costs more than looking at its pairs."""

    def maybe(x: dict, bands, left: tuple, right: tuple, paired):  # noqa: ANN001, ANN202
        import numpy as np

        wide = right[1] - right[0]
        pairs = (left[1] - left[0]).astype(np.int64) * wide
        out = pairs > most
        rows = np.flatnonzero(~out)
        of = np.repeat(rows, pairs[rows])
        k = np.arange(len(of)) - np.repeat(np.cumsum(pairs[rows]) - pairs[rows], pairs[rows])
        f, u = left[0][of] + k // wide[of], right[0][of] + k % wide[of]
        new = paired[of] | (f < u)
        for j in range(3):
            new &= (bands[of] <= j) | (x[f"b{j}"][f] != x[f"b{j}"][u])
        of, f, u = of[new], f[new], u[new]
        ok, _ = linked({**x, "mixed": True, "edited": True, "grown": True}, f, u)
        out[of[ok]] = True
        return out

    return maybe


def _over_tiles(bands: DataFrame, size: int, linked: Callable, run: Callable[[int, dict, int], Iterator], schema: str, name: str) -> DataFrame:
    """What ``run`` gives for each tile, and for each pair of tiles of a bucket that have near shapes: band, columns of images, and how many are the first tile's."""
    tiles, maybe = _tiles(bands, size), _screen(linked)

    def task(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def columns(lists) -> tuple[dict, object, object]:  # noqa: ANN001
            """The images of all rows of a batch, and where each row's begin and end."""
            at, struct = lists.offsets.to_numpy(), lists.values
            out = {f.name: struct.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(struct.type)}
            return {k: v.view(np.uint64) if k in ("p", "d") else v for k, v in out.items()}, at[:-1], at[1:]

        for batch in batches:
            bands_, paired = batch.column(0).to_numpy(), batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            lefts, a0, a1 = columns(batch.column(1))
            rights, b0, b1 = columns(batch.column(2))
            every = {k: np.concatenate([lefts[k], rights[k]]) for k in lefts}
            b0, b1 = np.where(paired, b0 + len(lefts["id"]), a0), np.where(paired, b1 + len(lefts["id"]), a1)
            for r in np.flatnonzero(maybe(every, bands_, (a0, a1), (b0, b1), paired)):
                i, n = int(bands_[r]), int(a1[r] - a0[r])
                both = {k: v[a0[r] : a1[r]] for k, v in every.items()}
                if paired[r]:
                    both = {k: np.concatenate([both[k], v[b0[r] : b1[r]]]) for k, v in every.items()}
                    # a lower band that all have in common has had these pairs
                    if any((both[f"b{k}"] == both[f"b{k}"][0]).all() for k in range(i)):
                        continue
                elif n < 2 or any((both[f"b{k}"] == both[f"b{k}"][0]).all() for k in range(i)):
                    continue
                for found in run(i, both, n):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.values()], names=list(found))

    key = F.struct("cell", "c")
    keys = tiles.select("i", "v", "cell", "c", key.alias("at"), "known")
    met = keys.alias("a").join(keys.alias("b"), (F.col("a.i") == F.col("b.i")) & (F.col("a.v") == F.col("b.v")) & (F.abs(F.col("a.cell") - F.col("b.cell")) <= 1) & (F.col("a.at") < F.col("b.at")) & ((F.col("a.known") == 0) | (F.col("b.known") == 0)))
    met = met.select("a.i", "a.v", F.col("a.cell").alias("cell1"), F.col("a.c").alias("c1"), F.col("b.cell").alias("cell2"), F.col("b.c").alias("c2"))
    first = tiles.select("i", "v", F.col("cell").alias("cell1"), F.col("c").alias("c1"), F.col("x").alias("x1"))
    second = tiles.select("i", "v", F.col("cell").alias("cell2"), F.col("c").alias("c2"), F.col("x").alias("x2"))
    pairs = met.join(first, ["i", "v", "cell1", "c1"]).join(second, ["i", "v", "cell2", "c2"]).select("i", "x1", "x2")
    alone = tiles.where("size(x) > 1 and known = 0").select("i", F.col("x").alias("x1"), F.lit(None).cast(tiles.schema["x"].dataType).alias("x2"))
    with shared.small_batches(bands.sparkSession):
        return shared.stash(alone.unionByName(pairs).mapInArrow(task, schema), name)


def _links(phash_most: int, band_width: int, dhash_most: int) -> Callable:
    """Which images of ``f`` and ``u`` (places in the columns, of shapes that go together) are linked, and how far their first hashes are apart."""

    def linked(x: dict, f, u):  # noqa: ANN001, ANN202
        import numpy as np

        apart = np.bitwise_count(x["p"][f] ^ x["p"][u])
        ok = (apart <= phash_most + band_width) & (np.bitwise_count(x["d"][f] ^ x["d"][u]) <= dhash_most)
        if x["mixed"]:
            r, s = x["ratio"][f], x["ratio"][u]
            ok &= (np.abs(r - s) / np.maximum(r, s) <= 0.01) & (x["n"][f] == x["n"][u])
        if x["edited"]:
            ok &= (x["orig"][f] != x["id"][u]) & (x["id"][f] != x["orig"][u])
        if x["grown"]:
            ok &= (x["old"][f] + x["old"][u]) < 2
        return ok, apart

    return linked


def _told() -> Callable:
    """The columns of a tile, and what has to be looked at in them."""
    none = _NONE

    def told(x: dict) -> dict:
        differ = lambda k: bool((x[k] != x[k][0]).any())
        return {**x, "mixed": differ("ratio") or differ("n"), "edited": bool((x["orig"] != none).any()), "grown": bool(x["old"].any())}

    return told


def ties(bands: DataFrame, phash_most: int = 6, band_width: int = 4, dhash_most: int = 8, tile: int = TILE) -> DataFrame:
    """a, b, weak: pairs with the components of all links of ``bands`` (see ``duplicates.bands``); ``weak`` at one pair of those of a tile that a link
    beyond ``phash_most`` is among. ``orig``, where it is a column: the file that an edited one was made from, which it has no link with. ``old``: images
    whose links among themselves are known, and left out."""
    linked, told = _links(phash_most, band_width, dhash_most), _told()

    def run(i: int, x: dict, n: int) -> Iterator:
        import numpy as np

        x = told(x)
        rest = np.arange(len(x["id"]))
        a, b, weak = [], [], []
        while len(rest):
            front, rest = rest[:1], rest[1:]
            parts, far = [front], False
            while len(front) and len(rest):
                f, front = front[:16], front[16:]
                ok, apart = linked(x, f[:, None], rest)
                hit = ok.any(0)
                far = far or bool((ok & (apart > phash_most)).any())
                front = np.append(front, rest[hit])
                parts.append(rest[hit])
                rest = rest[~hit]
            found = np.concatenate(parts)
            if len(found) < 2:
                continue
            for k in range(0, len(found), 64):
                if far:
                    break
                ok, apart = linked(x, found[k : k + 64, None], found[k:])
                far = bool((ok & (apart > phash_most)).any())
            ids = x["id"][found]
            least = ids.argmin()  # stars around their smallest ids are what components end as
            a.append(np.full(len(found) - 1, ids[least]))
            b.append(np.delete(ids, least))
            weak.append(np.arange(len(found) - 1) < far)
        if a:
            yield {"a": np.concatenate(a), "b": np.concatenate(b), "weak": np.concatenate(weak)}

    return _over_tiles(bands, tile, linked, run, "a long, b long, weak boolean", "ties")


def link_counts(bands: DataFrame, phash_most: int = 6, band_width: int = 4, dhash_most: int = 8, tile: int = TILE) -> DataFrame:
    """id, n_links, n_weak of images of ``bands`` that have a link: how many, and how many of those beyond ``phash_most``."""
    linked, told = _links(phash_most, band_width, dhash_most), _told()

    def run(i: int, x: dict, n: int) -> Iterator:
        import numpy as np

        x = told(x)
        size = len(x["id"])
        u = np.arange(size) if n == size else np.arange(n, size)
        links, weak = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for k in range(0, n, 128):
            f = np.arange(k, min(k + 128, n))
            ok, apart = linked(x, f[:, None], u)
            for j in range(i):  # a pair counts at the first of its bands
                ok &= x[f"b{j}"][f][:, None] != x[f"b{j}"][u]
            if n == size:
                ok[np.arange(len(f)), f] = False
            far = ok & (apart > phash_most)
            links[f] += ok.sum(1)
            weak[f] += far.sum(1)
            if n < size:
                links[u] += ok.sum(0)
                weak[u] += far.sum(0)
        some = links > 0
        yield {"id": x["id"][some], "n_links": links[some], "n_weak": weak[some]}

    each = _over_tiles(bands, tile, linked, run, "id long, n_links long, n_weak long", "link-counts")
    return each.groupBy("id").agg(F.sum("n_links").alias("n_links"), F.sum("n_weak").alias("n_weak"))
