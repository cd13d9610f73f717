"""SimHash near-duplicates by multi-index hashing: small Hamming balls within fingerprint segments."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add, and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewrack.llm import components, scratch

SHINGLE = 3
DISTANCE = 2
BLOCK = 1 << 15
#: Up to so many fingerprints a table bucket is verified pair by pair; larger ones go the exact way of _crowded.
CROWD = 64
#: For near copies: words of a shingle, the Jaccard similarity that links, fingerprints of 64 bits, bits of a segment,
#: and the bits of all fingerprints, and of the first, in which pairs may differ: 29 of 192 (10 of 64) with a deviation
#: of 5 (3) are to be expected at that similarity, 25 at 0.85, 41 at 0.65, and 96 (32) for texts with nothing in common.
WORDS, SIMILARITY = 5, 0.8
LANES, SEGMENT, APART, LANE_APART = 3, 21, 36, 20
#: Texts of a crowded segment from which its middle is found.
SAMPLE = 16
#: A text belongs to a middle that differs from it in so many bits of a segment, and of all fingerprints, at most. Where
#: it belongs decides how it meets others, not whether. Texts with nothing in common differ in 96 bits (deviation 7).
REACH, FAMILY = 3, 70
GOLDEN, MIX = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: So many hashes of texts, 8 bytes each, may be broadcast to pick the texts out.
FEW = 1 << 20


def _hashes(text: str | None, words: int, seed: int) -> Iterator[np.ndarray]:
    """The XXH64 of all word shingles of a text, repeats included, in blocks; none without words.

    ASCII letters are lower-cased and words end at ASCII white space. Fewer words than a shingle has make one. The
    shingles are slices of the words joined by spaces, so a long text needs no more memory."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    k = min(words, len(parts))
    starts, ends = (ends - lengths)[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), BLOCK):
        yield np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)], np.uint64)


def _ones(block: np.ndarray) -> np.ndarray:
    """How often each of 64 bits is set."""
    return np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, words: int = SHINGLE, seed: int = 42) -> int:
    """64 bits: the majority of the XXH64 of all word shingles, as a signed long; 0 without words."""
    ones, count = np.zeros(64, np.int64), 0
    for block in _hashes(text, words, seed):
        ones += _ones(block)
        count += len(block)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp), one row per row of ``docs``, as a working table."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in scratch.bounded(batches):
            fp = pa.array([fingerprint(t.as_py(), words) for t in b.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), fp], ["doc_id", "text_hash", "fp"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return scratch.table(rows.mapInArrow(digest, f"doc_id {kind}, text_hash long, fp long"), "fingerprints")


def _high(fp: Column) -> Column:
    return F.shiftrightunsigned(fp, 32)


def _low(fp: Column) -> Column:
    """The lower half, with a mark that keeps its keys apart from the upper half's."""
    return fp.bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(1 << 32))


def links(fps: DataFrame) -> DataFrame:
    """All pairs needed to connect the distinct fingerprints ``fps`` (fp) that differ in 2 bits or fewer: (u, v).

    Two halves: of two such fingerprints either the upper halves differ in 1 bit or none, or both differing bits
    are there and the lower halves are equal. So the ball of radius 1 about the upper half (33 keys) and the lower
    half itself meet every such pair in the table of halves; complete distances are then verified.

    Where more than ``CROWD`` fingerprints share a half, pairs within it could number its square. Those that such a
    bucket holds or meets are linked by the whole fingerprint's balls instead: two fingerprints lie within 2 bits
    just when their balls of radius 1 share a point, a point has 65 fingerprints at most, and a star joins them.
    """
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << b).cast("long") for b in range(32)))
    ball = F.transform(flips, lambda m: _high(F.col("fp")).bitwiseXOR(m))
    probes = fps.select("fp", F.explode(F.concat(ball, F.array(_low(F.col("fp"))))).alias("half"))
    table = fps.select(F.col("fp").alias("found"), F.explode(F.array(_high(F.col("fp")), _low(F.col("fp")))).alias("half"))
    crowds = scratch.table(table.groupBy("half").count().filter(F.col("count") > CROWD).select("half"), "crowds")
    near = probes.join(table.join(crowds, "half", "left_anti"), "half").filter("fp <> found").filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("found"))) <= DISTANCE)
    pairs = near.select(F.col("fp").alias("u"), F.col("found").alias("v"))
    if crowds.limit(1).count():
        pairs = pairs.unionByName(_crowded(probes.join(crowds, "half", "left_semi").select("fp").distinct()))
    return scratch.table(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")


def _crowded(fps: DataFrame) -> DataFrame:
    flips = F.array(F.lit(0).cast("long"), *(F.lit((1 << b) - ((1 << 64) if b == 63 else 0)).cast("long") for b in range(64)))
    points = fps.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
    stars = points.groupBy("point").agg(F.min("fp").alias("v"), F.collect_list("fp").alias("members")).filter(F.size("members") > 1)
    return stars.select(F.explode("members").alias("u"), "v").filter("u <> v").distinct()


def classes(rows: DataFrame) -> DataFrame:
    """(fp, root) for every distinct fingerprint of ``rows``: equal roots are one component."""
    fps = scratch.table(rows.select("fp").distinct(), "distinct")
    found = components.roots(links(fps))
    joined = fps.join(found, fps["fp"] == found["node"], "left")
    return joined.select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits) and component_id, the smallest id reachable over
    links of 2 bits or fewer.

    Null and empty texts have fingerprint zero and are linked like any others. A null id never names a component;
    a component without any id has a null one. Repeated rows stay. An empty table gives no rows.
    """
    rows = fingerprints(docs, id_col, text_col, words)
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = classes(rows).join(least, "fp")
    named = scratch.table(named, "named")
    heads = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = scratch.table(named.join(heads, "root").select("fp", "component_id"), "labels")
    return rows.join(labels, "fp").select(F.col("doc_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The XXH64 of each distinct word shingle of a text, as signed longs; none without words. Words, lower case and
    short texts are as in ``fingerprint``."""
    return np.unique(np.concatenate([*_hashes(text, words, 42), np.zeros(0, np.uint64)])).view(np.int64)


def lanes(text: str | None, words: int) -> list[int]:
    """``LANES`` fingerprints of a text as signed longs: the shingles' hashes, scrambled anew for each."""
    ones, count = np.zeros((LANES, 64), np.int64), 0
    for block in _hashes(text, words, 42):
        for lane in range(LANES):
            mixed = (block + np.uint64(GOLDEN * (lane + 1) % (1 << 64))) * np.uint64(MIX[0])
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(MIX[1])
            ones[lane] += _ones(mixed ^ (mixed >> np.uint64(32)))
        count += len(block)
    return [int(np.packbits(2 * lane > count, bitorder="little").view(np.int64)[0]) for lane in ones] if count else [0] * LANES


def _segments() -> list[Column]:
    """The keys of a row's segments: ``SEGMENT`` bits of a lane, marked with the segment's number."""
    at = [(lane, k) for lane in range(LANES) for k in range(64 // SEGMENT)]
    return [F.shiftrightunsigned(f"f{lane}", k * SEGMENT).bitwiseAND(F.lit((1 << SEGMENT) - 1)).bitwiseOR(F.lit(n << SEGMENT)) for n, (lane, k) in enumerate(at)]


def _sets(ids: DataFrame, fps: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(id, set): the sets of shingles of the texts whose numbers are ``ids`` (id), as a working table."""
    wanted = scratch.table(fps.join(ids, "id", "left_semi").select("id", "text_hash"), "wanted")
    texts = docs.select(F.xxhash64("text").alias("text_hash"), "text")
    if wanted.count() <= FEW:
        texts = texts.join(F.broadcast(wanted.select("text_hash")), "text_hash", "left_semi")
    texts = wanted.join(texts.dropDuplicates(["text_hash"]), "text_hash").select("id", "text")

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in scratch.bounded(batches):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([shingle_set(t.as_py(), words) for t in b.column("text")], pa.list_(pa.int64()))], ["id", "set"])

    return scratch.table(texts.mapInArrow(taken, "id long, set array<long>"), "shingles")


def _alike(both: Column, a: Column, b: Column) -> Column:
    """Whether sets of ``a`` and ``b`` items that share ``both`` are similar to ``SIMILARITY``."""
    return both >= F.lit(SIMILARITY) * (a + b - both)


def _similar(near: DataFrame, fps: DataFrame, docs: DataFrame, words: int, known: DataFrame | None) -> DataFrame:
    """The links (u, v) among ``near`` (x, y, apart; x > y), x and y being numbers of ``fps``, whose sets of shingles
    have a Jaccard similarity of ``SIMILARITY`` or more and that, with ``known`` links, connect what is to be connected.

    A text's nearest partner is verified first; of the other pairs, only those that are still apart."""
    ends = near.select(F.col("x").alias("id")).distinct().unionByName(near.select(F.col("y").alias("id")).distinct()).distinct()
    sets = _sets(ends, fps, docs, words)

    def verified(pairs: DataFrame) -> DataFrame:
        met = pairs.join(sets.select(F.col("id").alias("x"), F.col("set").alias("a")), "x").join(sets.select(F.col("id").alias("y"), F.col("set").alias("b")), "y")
        return met.filter(_alike(F.size(F.array_intersect("a", "b")), F.size("a"), F.size("b"))).select(F.col("x").alias("u"), F.col("y").alias("v"))

    best = near.groupBy("x").agg(F.min(F.struct("apart", "y")).alias("best"))
    links = verified(best.select("x", F.col("best.y").alias("y")))
    links = scratch.table(links if known is None else links.unionByName(known), "sure")
    roots = components.roots(links)
    side = lambda s: roots.select(F.col("node").alias(s), F.col("root").alias(f"{s}_root"))
    open_pairs = near.select("x", "y").join(side("x"), "x", "left").join(side("y"), "y", "left")
    open_pairs = open_pairs.filter(F.coalesce("x_root", "x") != F.coalesce("y_root", "y")).select("x", "y")
    return scratch.table(links.unionByName(verified(open_pairs)), "similar")


def _centres(fps: DataFrame) -> DataFrame:
    """(key, head) of segments that more than ``CROWD`` texts share: the text of each that has the least distance to a
    sample of them, one for each of ``SAMPLE`` hash classes. Texts made from one differ more from each other than from
    it, so the one in the middle is like most of them."""
    lanes_of = F.array(*(F.col(f"f{k}") for k in range(LANES)))
    entries = fps.select("id", lanes_of.alias("lanes"), F.explode(F.array(*_segments())).alias("key"))
    crowds = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD).select("key")
    own = scratch.table(entries.join(crowds, "key"), "crowded")
    sample = own.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(SAMPLE)).alias("class")).agg(F.min_by("lanes", "id").alias("lanes")).groupBy("key").agg(F.collect_list("lanes").alias("sample"))
    apart = lambda a, b: reduce(add, (F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(LANES)))
    total = F.aggregate("sample", F.lit(0), lambda t, other: t + apart(F.col("lanes"), other))
    return own.join(sample, "key").groupBy("key").agg(F.min(F.struct(total.alias("total"), F.col("id"))).alias("best")).select("key", F.col("best.id").alias("head"))


def _apart(a: Callable[[int], Column], b: Callable[[int], Column]) -> Column:
    """In how many bits the fingerprints of two texts differ; ``a`` and ``b`` give those of a lane."""
    return reduce(add, (F.bit_count(a(k).bitwiseXOR(b(k))) for k in range(LANES)))


def _members(known: DataFrame, balls: Column, crowds: DataFrame) -> DataFrame:
    """(id, root, hub, hub_root) of the texts of crowded segments and of those like them, as a working table. Crowds
    whose heads are connected have one hub, the head of most of them. What is connected with a hub belongs to it. A text
    that is not belongs to it where a ball reaches; and one that no hub is connected with to the hub of most crowds
    among those it resembles (``REACH``, ``FAMILY``), since copies with changes of their own mostly lie outside of
    crowded segments and would meet each other there in pairs. Hubs that all of theirs are connected with are left out."""
    rooted = known.select(F.col("id").alias("head"), F.col("root").alias("hub_root"))
    hubs = crowds.groupBy("head").agg(F.count(F.lit(1)).alias("n")).join(rooted, "head").groupBy("hub_root").agg(F.max_by("head", F.struct("n", "head")).alias("hub"), F.sum("n").alias("n"))
    hubs = scratch.table(hubs, "hubs")
    keys = scratch.table(crowds.join(rooted, "head").join(hubs, "hub_root").select("key", "hub", "hub_root"), "hub_keys")
    own = known.join(hubs, known["root"] == hubs["hub_root"]).select("id", "root", "hub", "hub_root")
    both = known.select("id", "root", F.explode(F.array(*_segments())).alias("key")).join(keys, "key").filter("root <> hub_root")
    asking = known.select("id", "root", F.explode(balls).alias("key")).join(keys, "key").filter("root <> hub_root")

    # Hubs are few beside texts: their segments are laid out by all changes, and a text is met once a segment at most.
    lanes_of = F.array(*(F.col(f"f{k}") for k in range(LANES)))
    changes = known.sparkSession.range(1 << SEGMENT).filter(F.bit_count("id") <= REACH).select(F.col("id").alias("change"))
    places = known.join(hubs, F.col("id") == F.col("hub")).select("hub", "hub_root", "n", lanes_of.alias("hub_f"), F.explode(F.array(*_segments())).alias("at"))
    places = places.crossJoin(F.broadcast(changes)).select("hub", "hub_root", "n", "hub_f", F.col("at").bitwiseXOR(F.col("change")).alias("near_key"))
    free = known.join(hubs.select(F.col("hub_root").alias("root")), "root", "left_anti")
    free = free.select("id", "root", lanes_of.alias("own_f"), F.explode(F.array(*_segments())).alias("own_key"))
    like = free.join(places, (F.col("own_key") == F.col("near_key")) & (_apart(lambda k: F.col("own_f")[k], lambda k: F.col("hub_f")[k]) <= FAMILY))
    like = like.groupBy("id", "root").agg(F.max(F.struct("n", "hub", "hub_root")).alias("most")).select("id", "root", "most.hub", "most.hub_root")
    members = scratch.table(reduce(DataFrame.unionByName, (own, both.drop("key"), asking.drop("key"), like)).distinct(), "members")
    return scratch.table(members.join(members.filter("root <> hub_root").select("hub").distinct(), "hub", "left_semi").select(*members.columns), "hub_members")


def _within(members: DataFrame, fps: DataFrame, docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """(links, pairs): of the ``members`` of each hub, (u, v) that are similar to the hub, and candidates (id, other)
    among which is every other similar pair of the hub's that is needed to connect what is to be connected.

    Copies of one text share most of their shingles with each other, similar or not, so those tell nothing. A member
    is taken as the items in which its set and the hub's differ: two members differ just where these differences do.
    Sets of n and m items are similar if they differ in (n + m) * r items or fewer. One that is not similar to the hub
    differs from it in more, so a partner has more than half of its own differences, give or take what it is longer, in
    common with it: one of the rarest half, which in a copy with changes of its own no other has. Positions among the
    differences, rarest first, bound what can be shared. No pair is missed, and a group costs what its differences
    are, not what its pairs are."""
    sets = _sets(members.select("id").unionByName(members.select(F.col("hub").alias("id"))).distinct(), fps, docs, words)
    middle = scratch.table(sets.join(members.select(F.col("hub").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("hub"), F.col("set").alias("middle")), "middle")
    met = members.join(sets, "id").join(middle, "hub")
    n, m, less = F.size("set"), F.size("middle"), F.array_except("middle", "set")
    met = met.select("id", "root", "hub", (F.col("root") != F.col("hub_root")).alias("open"), n.alias("n"), m.alias("m"), F.size(less).alias("less"), F.concat(F.array_except("set", "middle"), less).alias("items"))
    alike = _alike(F.col("m") - F.col("less"), F.col("n"), F.col("m"))
    met = scratch.table(met.withColumns({"alike": alike, "d": F.size("items")}), "differences")
    links = met.filter("open and alike").select(F.col("id").alias("u"), F.col("hub").alias("v"))

    # An item of one member only is shared by none: it counts in positions, as the rarest, and is not laid out.
    each = met.select("id", "root", "hub", (F.col("open") & ~F.col("alike")).alias("open"), "n", "m", "d", F.explode("items").alias("item"))
    common = each.groupBy("hub", "item").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    member = Window.partitionBy("hub", "id")
    placed = each.join(common, ["hub", "item"]).withColumn("at", F.col("d") - F.count(F.lit(1)).over(member) + F.row_number().over(member.orderBy("often", "item")) - 1)
    r, slack = (1 - SIMILARITY) / (1 + SIMILARITY), 1e-6
    first = F.col("open") & (F.col("at") <= F.col("d") - F.greatest(F.lit(1), F.col("d") - F.col("n") * (1 - SIMILARITY) / SIMILARITY) + slack)
    second = F.col("at") <= (F.col("d") + (F.col("n") - F.col("m")) * r) / 2 + slack
    placed = scratch.table(placed.withColumns({"first": first, "second": second}).filter("first or second").drop("often", "m"), "items")
    side = lambda s: placed.filter(s).select("hub", "item", *(F.col(c).alias(f"{s}_{c}") for c in ("id", "root", "open", "n", "d", "at")))
    most = F.least(F.col("first_d") - F.col("first_at"), F.col("second_d") - F.col("second_at"))
    reach = 2 * most >= F.col("first_d") + F.col("second_d") - (F.col("first_n") + F.col("second_n")) * r - slack
    once = ~F.col("second_open") | (F.col("second_id") < F.col("first_id"))
    found = side("first").join(side("second"), ["hub", "item"]).filter(once & (F.col("first_root") != F.col("second_root")) & reach)
    return links, found.select(F.col("first_id").alias("id"), F.col("second_id").alias("other"))


def near_copies(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text_hash, root), one row per row of ``docs``: rows of one root are connected by texts whose sets of
    ``words``-word shingles are similar to ``SIMILARITY`` or more.

    Multi-index hashing over longer fingerprints, as such texts differ in an eighth of all bits or so: ``LANES``
    of 64 bits in segments of ``SEGMENT`` bits. Each segment's ball of radius 1 is looked up in the table of segments,
    full distances are verified, and then the sets themselves: what is linked is similar for certain. A pair is missed
    where every segment differs in two bits or more. Texts of one segment are met with one of
    them first, in a segment of more than ``CROWD`` texts with the one in their middle. What this leaves apart meets
    the others that a ball reaches, those of crowded segments by what they differ in from the middle (``_within``).

    Null and empty texts are alike and connected. An empty table gives no rows."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    names = [f"f{lane}" for lane in range(LANES)]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in scratch.bounded(batches):
            found = [lanes(t.as_py(), words) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), *(pa.array([f[k] for f in found], pa.int64()) for k in range(LANES))], ["doc_id", "text_hash", *names])

    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = scratch.table(rows.mapInArrow(digest, f"doc_id {kind}, text_hash long, {', '.join(f'{n} long' for n in names)}"), "lanes")
    fps = rows.groupBy(*names).agg(F.min("text_hash").alias("text_hash")).select(F.monotonically_increasing_id().alias("id"), *names, "text_hash")
    fps = scratch.table(fps, "distinct_lanes")
    entries = fps.select("id", "f0", F.explode(F.array(*_segments())).alias("key"))
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("head")).filter("n > 1")
    crowds = scratch.table(_centres(fps), "crowds")
    heads = scratch.table(shared.filter(F.col("n") <= CROWD).select("key", "head").unionByName(crowds), "heads")

    def near(pairs: DataFrame, most: int = APART) -> DataFrame:
        side = lambda s: fps.select(F.col("id").alias(s), F.array(*names).alias(f"{s}_f"))
        met = pairs.select(F.greatest("id", "other").alias("x"), F.least("id", "other").alias("y")).distinct().join(side("x"), "x").join(side("y"), "y")
        apart = reduce(add, (F.bit_count(F.col("x_f")[k].bitwiseXOR(F.col("y_f")[k])) for k in range(LANES)))
        return scratch.table(met.withColumn("apart", apart).filter(F.col("apart") <= most).select("x", "y", "apart"), "near")

    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << b).cast("long") for b in range(SEGMENT)))
    ball = lambda key: F.transform(flips, lambda m: key.bitwiseXOR(m))
    balls = F.flatten(F.array(*map(ball, _segments())))
    close = F.bit_count(F.col("f0").bitwiseXOR(F.col("other_f0"))) <= LANE_APART
    links = _similar(near(entries.join(heads, "key").filter("id <> head").select("id", F.col("head").alias("other"))), fps, docs, words, None)
    # What the heads of segments have connected need not meet again. What is still apart meets wherever a ball reaches.
    roots = components.roots(links).select(F.col("node").alias("id"), "root")
    known = scratch.table(fps.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")).select("id", "f0", "root", *names[1:]), "rooted")
    pairs = None
    if crowds.limit(1).count():
        members = _members(known, balls, crowds)
        more, pairs = _within(members, fps, docs, words)
        links = scratch.table(links.unionByName(more), "links")
        known = scratch.table(known.join(members.groupBy("id").agg(F.collect_list("hub").alias("hubs")), "id", "left"), "hubs_of")
    else:
        known = known.withColumn("hubs", F.lit(None).cast("array<long>"))
    probes = known.select("id", "f0", "root", "hubs", F.explode(balls).alias("key"))
    table = known.select(*(F.col(c).alias(f"other{t}") for c, t in (("id", ""), ("f0", "_f0"), ("root", "_root"), ("hubs", "_hubs"))), F.explode(F.array(*_segments())).alias("key"))
    # What has a hub in common has met there.
    apart = (F.col("root") != F.col("other_root")) & (F.col("id") < F.col("other")) & ~F.coalesce(F.arrays_overlap("hubs", "other_hubs"), F.lit(False))
    met = near(probes.join(table.join(crowds, "key", "left_anti"), "key").filter(close & apart).select("id", "other"))
    if pairs is not None:
        met = met.unionByName(near(pairs, 64 * LANES))
    roots = components.roots(_similar(met, fps, docs, words, links))
    named = fps.join(roots, fps["id"] == roots["node"], "left").select(*(F.col(n).alias(f"n_{n}") for n in names), F.coalesce("root", "id").alias("root"))
    same = reduce(and_, (F.col(n) == F.col(f"n_{n}") for n in names))
    return scratch.table(rows.join(scratch.table(named, "named"), same).select("doc_id", "text_hash", "root"), "near_copies")


def keep_first(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` with one document of each group of near copies (see ``near_copies``): the one of the smallest id, a null
    id last, then of the smallest text hash. If that very row is repeated, one of its copies stays. All columns are
    kept as they are, whatever else they are called; null and empty texts are near copies of each other; an empty
    table stays so."""
    rows = near_copies(docs, words)
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
    heads = rows.groupBy("root").agg(F.min(rank).alias("first")).select(F.col("first.doc_id").alias("k_id"), F.col("first.text_hash").alias("k_hash"))
    counts = rows.groupBy("doc_id", "text_hash").count()
    counts = counts.select(F.col("doc_id").alias("c_id"), F.col("text_hash").alias("c_hash"), (F.col("count") > 1).alias("repeated"))
    kept = heads.join(counts, F.col("k_id").eqNullSafe(F.col("c_id")) & (F.col("k_hash") == F.col("c_hash")))
    id_name, hash_name, own = scratch.fresh(docs, "k_id", "k_hash", "own_hash")
    kept = scratch.table(kept.select(F.col("k_id").alias(id_name), F.col("k_hash").alias(hash_name), "repeated"), "kept")
    same = docs["doc_id"].eqNullSafe(kept[id_name]) & (F.xxhash64(docs["text"]) == kept[hash_name])
    once = docs.join(kept.filter("not repeated"), same, "left_semi")
    again = kept.filter("repeated")
    if not again.limit(1).count():
        return once
    copies = docs.join(again, same, "left_semi")
    return once.unionByName(copies.withColumn(own, F.xxhash64("text")).dropDuplicates(["doc_id", own]).drop(own))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate components of all documents."""
    return near_duplicates(scratch.dealt(spark.read.parquet(f"{sf_dir}/documents.parquet")))
