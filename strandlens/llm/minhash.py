"""Near-duplicate documents by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, written
from .components import components

#: Coordinates of a sketch; a power of two, at most 128. Bands of ROWS coordinates: a pair of
#: similarity 0.75 shares none of 32 bands of 4 with probability 0.000005.
COORDINATES, ROWS = 128, 4
BANDS = COORDINATES // ROWS
#: Pairs that agree in fewer coordinates than this are not verified in the second round; a pair of
#: similarity 0.75 agrees in 96 on average, in fewer than 68 with probability under 1e-7.
AGREE = 68
#: Pairs with one text that are verified in one task; rows of a broadcast table; bytes hashed at once.
PER_TASK, KEYS, BLOCK = 256, 200_000, 1 << 20
#: Shingles of the members of a tile, as a mean; a member's own apart.
TILE_SHINGLES = 1 << 20

_U = np.uint64
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def _stream(seed: int, n: int) -> np.ndarray:
    return mix(_U(seed) + np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))


_BYTE = _stream(11, 256)
_ROUND = _stream(12, 2 * COORDINATES)
_PLACE = _stream(13, 5) | _U(1)
_SHORT = _stream(14, 5)
_BAND = _stream(15, BANDS)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        up, down = np.full(size, _BASE, _U), np.full(size, _INVERSE, _U)
        up[0] = down[0] = 1
        _POWERS.clear()
        _POWERS[size] = np.cumprod(up), np.cumprod(down)
    return _POWERS[size]


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each word of lower-cased bytes: a polynomial hash from one sum."""
    space = _SPACE[data]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return start, np.zeros(0, _U)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return start, mix((total[end] - total[start]) * down[start])


def _shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of the five words from each place on; not for the last four."""
    out = words[:-4] * _PLACE[0]
    for k in range(1, 5):
        out += words[k : len(words) - 4 + k] * _PLACE[k]
    return mix(out)


def _short(words: np.ndarray) -> np.ndarray:
    n = len(words)
    return mix((words * _PLACE[:n]).sum(dtype=_U, keepdims=True) + _SHORT[n : n + 1]) if n else words


def hashed_words(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The word hashes of each text. Letters A-Z are lower-cased, words are runs of other bytes than
    space and 9-13. Texts are hashed together in blocks of about a megabyte; a longer text is cut
    at spaces into such blocks, so temporary arrays stay small."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < BLOCK):
            size += len(texts[end]) + 1
            end += 1
        if end == at + 1 and len(texts[at]) > BLOCK:
            words, pos, text = [], 0, texts[at]
            while pos < len(text):
                stop = min(len(text), pos + BLOCK)
                while stop < len(text) and not _SPACE[text[stop]]:
                    stop += 1
                words.append(_words(_LOWER[np.frombuffer(text, np.uint8, stop - pos, pos)])[1])
                pos = stop
            yield np.concatenate(words)
        else:
            data = _LOWER[np.frombuffer(b" ".join(texts[at:end]), np.uint8)]
            starts, words = _words(data)
            edges = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts[at:end])]))
            for a, b in zip(edges, edges[1:], strict=False):
                yield words[a:b]
        at = end


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: those of its runs of five words; of under
    five words the whole sequence is one, of none the set is empty."""
    return [np.unique(_shingle_hashes(w)) if len(w) > 4 else _short(w) for w in hashed_words(texts)]


def fast_sketch(items: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketch of a non-empty set of 64-bit hashes: t values.

    In rounds 0..t-1 every item falls into a hashed bin; a bin keeps the smallest hash of the first
    round that reaches it. Rounds t..2t-1 put all items into one bin each, so every bin is filled.
    Two sketches agree in each coordinate with the sets' Jaccard similarity as probability. A value
    is (round, hash), under the bin's number; the rounds stop when all bins are filled. Small sets
    take several rounds at once; nothing but the bin stands above the round, so values don't depend
    on how many.
    """
    shift = _U(64 - (t.bit_length() - 1))
    edges = np.arange(t, dtype=_U) << shift
    low48 = (_U(1) << _U(48)) - _U(1)
    clear = edges[-1] | low48
    out, empty = np.zeros(t, _U), np.ones(t, bool)
    i = 0
    while i < t and empty.any():
        r = min(t - i, max(1, 4 * t // len(items)))
        keys = mix(items[None, :] ^ _ROUND[i : i + r, None]) & clear
        keys |= np.arange(i, i + r, dtype=_U)[:, None] << _U(48)
        keys = np.sort(keys, axis=None)
        first = np.searchsorted(keys, edges)
        ok = first < len(keys)
        value = keys[np.minimum(first, len(keys) - 1)]
        ok &= (value >> shift) == np.arange(t, dtype=_U)
        fill = ok & empty
        out[fill] = value[fill]
        empty &= ~fill
        i += r
    for b in np.flatnonzero(empty):
        out[b] = edges[b] | _U(t + b) << _U(48) | (mix(items ^ _ROUND[t + b]) & low48).min()
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    return mix((sketch.reshape(BANDS, ROWS) * _PLACE[:ROWS]).sum(axis=1, dtype=_U) ^ _BAND).view(np.int64)


def fingerprint(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def chunks(batch: pa.RecordBatch, column: int, size: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of parts of a batch of about ``size`` bytes."""
    texts, at, total = [], 0, 0
    for i, x in enumerate(batch.column(column)):
        text = x.as_buffer()
        text = b"" if text is None else text.to_pybytes()
        texts.append(text)
        total += len(text)
        if total >= size:
            yield at, texts
            texts, at, total = [], i + 1, 0
    if texts:
        yield at, texts


SKETCHES = "doc_id bigint, text_key bigint, n_shingles bigint, fp binary, bands array<bigint>, marks binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in chunks(batch, 2):
            n, fps, bands, marks = [], [], [], []
            for items in shingle_sets(texts):
                n.append(len(items))
                if len(items):
                    sketch = fast_sketch(items)
                    fps.append(fingerprint(items))
                    bands.append(band_keys(sketch))
                    marks.append(mix(sketch).astype(np.uint8).tobytes())
                else:
                    fps.append(None)
                    bands.append(None)
                    marks.append(None)
            part = batch.slice(at, len(texts))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(fps, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                names=["doc_id", "text_key", "n_shingles", "fp", "bands", "marks"],
            )


def _text_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(wanted, text) where the text's set has the wanted fingerprint."""
    for batch in batches:
        keep = []
        for at, texts in chunks(batch, 1):
            for i, items in enumerate(shingle_sets(texts)):
                if len(items) and fingerprint(items) == batch.column(0)[at + i].as_py():
                    keep.append(at + i)
        yield batch.take(pa.array(keep, pa.int64()))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, in whole numbers, of two sorted sets."""
    if not len(a) or not len(b) or 4 * min(len(a), len(b)) < 3 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, link) of (a, b, text_a, text_b), with the sets of the last texts kept at hand."""
    cache: OrderedDict[bytes, np.ndarray] = OrderedDict()

    def of(fp: bytes, text) -> np.ndarray:
        if fp in cache:
            cache.move_to_end(fp)
        else:
            cache[fp] = shingle_sets([text.as_buffer().to_pybytes()])[0]
            if len(cache) > 32:
                cache.popitem(last=False)
        return cache[fp]

    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        link = [linked(of(x, batch.column(2)[i]), of(y, batch.column(3)[i])) for i, (x, y) in enumerate(zip(a, b, strict=True))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(link)], names=["a", "b", "link"])


TILE = "bucket bigint, kind int, tile_a int, tile_b int"
MEMBERS = f"{TILE}, side int, fp binary, label binary, bands array<bigint>, marks binary"


class _Tile:
    """Members of a tile, as arrays: which pairs are in different components and near by sketch.

    Kind 0 has two sides, of which each member of one is compared with each of the other; kind 1 has
    one side, or two parts of it, and compares all different ones. A pair counts in the first
    bucket that it shares alone.
    """

    def __init__(self, where: tuple, rows: list[tuple]) -> None:
        self.bucket, self.whole = where[0], where[1] == 1 and where[2] == where[3]
        self.side, self.fp = np.array([r[0] for r in rows]), [r[1] for r in rows]
        self.label = np.unique([r[2].hex() for r in rows], return_inverse=True)[1]
        self.bands, self.marks = np.stack([r[3] for r in rows]), np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1)

    def near(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(first, second) members of such pairs, in blocks; labels may change in between."""
        n = len(self.fp)
        step = max(1, (1 << 23) // (n * self.marks.shape[1]))
        for i in range(0, n, step):
            ask = (self.label[i : i + step, None] != self.label[None, :]) & (np.arange(i, min(n, i + step))[:, None] < np.arange(n)[None, :])
            if not self.whole:
                ask &= self.side[i : i + step, None] != self.side[None, :]
            if ask.any():
                ask &= (self.marks[i : i + step, None, :] == self.marks[None, :, :]).sum(axis=2) >= AGREE
                x, y = ask.nonzero()
                x += i
                first = self.bands[x, (self.bands[x] == self.bands[y]).argmax(axis=1)] == self.bucket
                yield x[first], y[first]


def _tiles(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[tuple[tuple, _Tile, list[bytes]]]:
    """The tiles of rows that come sorted by TILE, with their members' texts if there are any."""
    where, rows, texts = None, [], []
    for batch in batches:
        head = list(zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True))
        side, fp, label = (c.to_pylist() for c in batch.columns[4:7])
        for i, key in enumerate(head):
            if key != where:
                if len(rows) > 1:
                    yield where, _Tile(where, rows), texts
                where, rows, texts = key, [], []
            rows.append((side[i], fp[i], label[i], batch.column(7)[i].values.to_numpy(), batch.column(8)[i].as_py()))
            if with_text:
                texts.append(batch.column(9)[i].as_buffer().to_pybytes())
    if len(rows) > 1:
        yield where, _Tile(where, rows), texts


def _near_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(TILE, fp) of the members that are near another one of their tile."""
    for where, tile, _ in _tiles(batches, False):
        found = sorted({i for x, y in tile.near() for i in (*x.tolist(), *y.tolist())})
        columns = [pa.array([v] * len(found), t) for v, t in zip(where, (pa.int64(), *[pa.int32()] * 3), strict=True)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([tile.fp[i] for i in found], pa.binary())], names=["bucket", "kind", "tile_a", "tile_b", "fp"])


def _close_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) that link, of near members of tiles with their texts: a spanning forest of each tile's
    components, so that pairs don't leave it."""
    for _, tile, texts in _tiles(batches, True):
        sets: dict[int, np.ndarray] = {}
        a, b = [], []
        for x, y in tile.near():
            for u, v in zip(x.tolist(), y.tolist(), strict=True):
                if tile.label[u] == tile.label[v]:
                    continue
                for k in (u, v):
                    if k not in sets:
                        sets[k] = shingle_sets([texts[k]])[0]
                if linked(sets[u], sets[v]):
                    a.append(max(tile.fp[u], tile.fp[v]))
                    b.append(min(tile.fp[u], tile.fp[v]))
                    tile.label[tile.label == tile.label[v]] = tile.label[u]
            if sum(map(len, sets.values())) > TILE_SHINGLES:
                sets.clear()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _open_tiles(label: DataFrame, tile: int) -> tuple[DataFrame, DataFrame]:
    """(TILE, side, fp, label) of (bucket, fp, label, n_shingles): what is to be compared in the buckets
    of several components (None if there are none), and the written table of those buckets.

    Members of a bucket's largest component need no comparison with each other, so they are dealt in
    chunks of about ``tile``, each of which meets each chunk of the other members (kind 0); those
    meet among themselves (kind 1). A bucket of one large component and few others grows with its
    members, not their square.
    """
    load = F.greatest(F.count(F.lit(1)) / tile, F.sum("n_shingles") / TILE_SHINGLES)
    sizes = label.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), load.alias("load"))
    several = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("labels"), F.sum("load").alias("total"), F.max(F.struct("n", "label", "load")).alias("top")).where("labels > 1")
    several = written(several.select("bucket", F.col("top.label").alias("major"), F.ceil("top.load").cast("int").alias("majors"), F.greatest(F.ceil(F.col("total") - F.col("top.load")), F.lit(1)).cast("int").alias("minors")), "open")
    many = several.count()
    rows = label.drop("n_shingles").join(F.broadcast(several) if many <= KEYS else several, "bucket").withColumn("side", (F.col("label") == F.col("major")).cast("int"))
    parts = F.when(F.col("side") == 1, F.col("majors")).otherwise(F.col("minors"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("fp"), parts.cast("long")).cast("int"))
    chunks = lambda n: F.sequence(F.lit(0), n - 1)
    spot = lambda kind, a, b, side: F.struct(F.lit(kind).alias("kind"), a.alias("tile_a"), b.alias("tile_b"), side.alias("side"))
    part = F.col("part")
    against = F.when(F.col("side") == 1, F.transform(chunks(F.col("minors")), lambda i: spot(0, i, part, F.lit(1)))).otherwise(
        F.concat(F.transform(chunks(F.col("majors")), lambda j: spot(0, part, j, F.lit(0))), F.transform(chunks(F.col("minors")), lambda j: spot(1, F.least(part, j), F.greatest(part, j), part)))
    )
    return rows.select("bucket", "fp", "label", F.explode(against).alias("at")).select("bucket", "at.kind", "at.tile_a", "at.tile_b", "at.side", "fp", "label") if many else None, several


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, link of distinct pairs (a, b) of fingerprints; texts has fp and text.

    A text in more than PER_TASK pairs is sent several times, each time for a part of its pairs, so
    that no task gets a centre's pairs as a whole.
    """
    hot = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PER_TASK)
    many = hot.count()
    split = [written(hot.select("fp", F.ceil(F.col("n") / PER_TASK).alias("parts")), "split")] if many else []

    def with_text(rows: DataFrame, side: str) -> DataFrame:
        own = texts.select(F.col("fp").alias(side), F.col("text").alias(f"text_{side}"))
        if not many:
            return rows.join(own, side)
        parts = (F.broadcast(split[0]) if many <= KEYS else split[0]).select(F.col("fp").alias(side), "parts")
        rows = rows.join(parts, side, "left").withColumn("part", F.pmod(F.xxhash64("a", "b"), F.coalesce("parts", F.lit(1)))).drop("parts")
        own = own.join(parts, side, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        return rows.join(own, [side, "part"]).drop("part")

    both = with_text(with_text(pairs, "b"), "a").select("a", "b", "text_a", "text_b")
    done = written(both.mapInArrow(_verify, "a binary, b binary, link boolean"), "verified")
    drop_written(*split)
    return done


def _texts_of(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """fp, text of one document for each wanted (fp, doc_id, text_key)."""
    rows = docs.select(F.col("doc_id").alias("_id"), _text_key(text_col).alias("_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if wanted.count() <= KEYS:
        wanted = F.broadcast(wanted)
    found = rows.join(wanted, (F.col("_key") == F.col("text_key")) & F.col("_id").eqNullSafe(F.col("doc_id"))).select("fp", "text")
    return written(found.mapInArrow(_fingerprints, "fp binary, text string").dropDuplicates(["fp"]), "texts")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = 256) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_key (a hash of the text) for every document.

    Documents link if their sets of five-word shingles have a similarity of 0.75 or more; a
    component is what links connect, component_id its smallest doc_id, kept whether it is the
    document's own. Null or empty texts have no shingles, link with nothing and are kept under
    their own id, null ids take part in links but never name a component of which any id is known,
    repeated rows repeat the result, other columns are ignored, an empty table gives an empty one.

    1. Each text is sketched in one pass. Documents of equal sets form a class, counted map-side;
       from here on a class is one node, so copies cost nothing.
    2. Classes that share a band form a bucket. Each bucket proposes links to two centres, the
       class with most copies and one chosen by hash: pairs grow with the members, not their
       square. Exact verification on the full sets, then components.
    3. Members of a bucket that are still in different components are compared by sketch in tiles of
       bounded size, the largest component's only with the others', each pair in the first bucket
       it shares. Members that are near another one come back with their texts and are verified in
       their tile on the full sets; only links leave a tile, and no link is lost to step 2.
    """
    docs = docs.withColumn("doc_id", F.col(id_col).cast("long"))
    rows = docs.select("doc_id", _text_key(text_col).alias("text_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sketches = written(rows.mapInArrow(_sketch, SKETCHES), "sketches")
    classes = written(
        sketches.where("fp is not null")
        .groupBy("fp")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("marks").alias("marks"))
        .select("fp", "rep.doc_id", "rep.text_key", "copies", "n_shingles", "bands", "marks"),
        "classes",
    )
    members = classes.select(F.explode("bands").alias("bucket"), "fp", "copies", "n_shingles")
    hashed = F.xxhash64("fp", "bucket")
    buckets = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.max_by("fp", F.struct("copies", "fp")).alias("center"), F.min_by("fp", F.struct(hashed, F.col("fp"))).alias("other")).where("size > 1")
    members = written(members.select("bucket", "fp", "n_shingles").join(buckets, "bucket"), "members")
    star = members.select("fp", F.explode(F.array_distinct(F.array("center", "other"))).alias("to")).where("fp <> to")
    pairs = written(star.select(F.greatest("fp", "to").alias("a"), F.least("fp", "to").alias("b")).distinct(), "pairs")
    in_buckets = members.select("fp").distinct()
    texts = _texts_of(docs, in_buckets.join(classes.select("fp", "doc_id", "text_key"), "fp"), text_col)
    first = _verified(pairs, texts)
    links = components(first.where("link"))

    label = members.where("size > 2").join(links.select(F.col("node").alias("fp"), "root"), "fp", "left").select("bucket", "fp", F.coalesce("root", "fp").alias("label"), "n_shingles")
    at, spread = ["bucket", "kind", "tile_a", "tile_b"], ["side", "fp", "label", "bands", "marks"]
    tiles, several = _open_tiles(label, tile)
    dealt = lambda df: df.repartition(*at).sortWithinPartitions(*at)
    more: list[DataFrame] = []
    if tiles:
        tiles = written(tiles.join(classes.select("fp", "bands", "marks"), "fp").select(*at, *spread), "tiles")
        near = written(dealt(tiles).mapInArrow(_near_members, f"{TILE}, fp binary"), "near")
        more = [tiles, near]
        if near.limit(1).count():
            close = tiles.join(near, [*at, "fp"], "left_semi").join(texts, "fp").select(*at, *spread, "text")
            more.append(written(dealt(close).mapInArrow(_close_links, "a binary, b binary"), "links"))
            links = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more[-1]))

    own = classes.select("fp", "doc_id")
    linked_to = links.select(F.col("node").alias("fp"), "root").unionByName(links.select(F.col("root").alias("fp"), "root").distinct())
    smallest = written(own.join(linked_to, "fp").groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest")  # a row for each component of several
    few = F.broadcast(smallest) if smallest.count() <= KEYS else smallest
    named = own.join(linked_to.join(few, "root"), "fp", "left").select("fp", F.coalesce("component_id", "doc_id").alias("component_id"))
    named = written(named, "named")
    drop_written(classes, members, pairs, texts, first, several, smallest, *more)
    found = sketches.select("doc_id", "n_shingles", "fp", "text_key").join(named, "fp", "left")
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.coalesce(F.col("doc_id") == component, component.isNull())
    return found.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "text_key")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one document of each component: rows stay if their id names the
    component, rows of null id if no id of the component is known. Of rows repeated with equal id
    and text one stays. Texts are shuffled only if more than 200,000 rows go or rows repeat."""
    found = near_duplicates(docs, id_col, text_col)
    gone = written(found.where("not kept").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct(), "gone")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (_text_key(text_col) == F.col("__key"))
    kept = docs.join(F.broadcast(gone) if gone.count() <= 200_000 else gone, same, "left_anti")
    twice = docs.groupBy(id_col).count().where("count > 1").limit(1).count()
    return kept.dropDuplicates([id_col, text_col]) if twice else kept
