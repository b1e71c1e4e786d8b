"""Near-duplicates by BagMinHash: signatures of shingle multisets, banding, verification of the multiset overlap, classes.

Signatures. The weight of a shingle is how often it stands in a text. Each shingle has a Poisson process over (weight, time), keyed by its
digest and built hierarchically: the weight axis is cut into [0,1), [1,2), [2,4), [4,8) ... with one process each, and a part that a text's
weight covers only in part keeps the points below that weight. Every point has a slot; a slot's signature is the earliest point in it, so two
texts agree in a slot with probability equal to their weighted Jaccard similarity. Points are drawn in order of time and only up to the time
by which all slots are full, so a text costs its shingles plus about slots * log(slots) points.

Classes. Texts with equal multisets are one node. Nodes that share a band are candidates; links are candidates whose multiset overlap,
counted on the shingles themselves, is `SIMILARITY` or more; a class is a connected component of links. A crowded bucket, such as that of a
large group of near copies, is first taken apart by the rare shingles of its members, which loses no link (see `rare_buckets`). Pairs inside a
bucket are not all emitted: in `STARS` rounds one leader of each bucket is compared with its members of other components, and components
merge. What is left of a small bucket is compared pair by pair. A crowded bucket is cut into slices of bounded size, each pair of slices meets
in one task with its multisets (see `linked_inside`), and only links that join components come out of it. So every candidate pair is verified
or already known to be in one class, and the rows grow with the members of buckets, not with their pairs.

Results in special cases: null, empty and blank texts have no shingles and are never duplicates; a text of one to four words is one
shingle; rows that agree in doc_id and text are one document; classes are named by their smallest doc_id (rows without id: by the smallest
that has one, else null); an empty table gives no rows; clashing extra columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewise.llm.common import keyed, stored, unpacked, whole_rows, with_rows
from gradewise.llm.textual import Bounded, mixed, slices, texts, words

#: 20 bands of 4: a pair at similarity 0.8 is missed with probability (1 - 0.8 ** 4) ** 20 = 3e-5.
SHINGLE, BANDS, ROWS, SIMILARITY = 5, 20, 4, 0.8
SLOTS = BANDS * ROWS
#: Buckets with more members are taken apart by rare shingles, and compared inside tasks.
CROWD = 8
#: Members of a slice of a crowded bucket, and shingles of them all.
SLICE_ROWS, SLICE_SHINGLES = 512, 2_000_000
#: Keys of this many documents at most are sent to all executors.
SENT_ROWS = 500_000
#: Rounds in which a leader of each bucket is compared with its other members.
STARS = 2
#: Links that go into one file of the small tables of a round.
LINKS_A_FILE = 200_000

_STEP, _LEVEL, _COPY, _ODD = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
_WORDS = Bounded(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")), 500_000)


def bag(text: str, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Digests of a text's distinct shingles, in order, and how often each stands in it."""
    ws = words(text)
    if not ws:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes = np.array([_WORDS[w] for w in ws], np.uint64)
    n = max(1, len(codes) - width + 1)
    code = np.full(n, min(len(codes), width), np.uint64)
    for k in range(min(len(codes), width)):
        code = code * _ODD + codes[k : n + k]
    return np.unique(mixed(code), return_counts=True)


def elements(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The multiset as a sorted set: the j-th copy of a shingle is an element of its own."""
    which = np.repeat(np.arange(len(counts)), counts)
    copy = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.where(copy == 0, shingles[which], mixed(shingles[which] + copy.astype(np.uint64) * _COPY))
    return np.sort(out)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """(texts, slots): the digest of the earliest point of each slot; 0 for texts without shingles."""
    which, seed, rate, low, weight = [], [], [], [], []
    for d, (shingles, counts) in enumerate(bags):
        level = 0
        while len(shingles):
            first = 0 if level == 0 else 1 << (level - 1)
            over = counts > first
            shingles, counts = shingles[over], counts[over]
            which.append(np.full(len(shingles), d))
            seed.append(mixed(shingles + np.array([level], np.uint64) * _LEVEL))
            size = max(first, 1)
            rate.append(np.full(len(shingles), float(size)))
            low.append(np.full(len(shingles), float(first)))
            weight.append(counts.astype(float))
            level += 1
    ident = np.zeros((len(bags), slots), np.uint64)
    if not which:
        return ident
    which, seed, rate, low, weight = map(np.concatenate, (which, seed, rate, low, weight))
    total = np.array([c.sum() for _, c in bags], float)
    with np.errstate(divide="ignore"):
        limit = slots * (np.log(slots) + 4) / total
    best = np.full(len(bags) * slots, np.inf)
    number = np.zeros(len(seed), np.uint64)
    point = mixed(seed + _STEP)
    unit = lambda x: ((x >> np.uint64(11)).astype(float) + 0.5) / 9007199254740992.0
    time = -np.log(unit(point)) / rate
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    alive = np.arange(len(seed))
    while len(alive):
        now = alive[time[alive] <= limit[which[alive]]]
        while len(now):
            mark = mixed(point[now] ^ _LEVEL)
            slot = ((mark >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
            at = low[now] + (mark & np.uint64(0xFFFFFFFF)).astype(float) / 4294967296.0 * rate[now]
            good = at < weight[now]
            key = which[now][good] * slots + slot[good].astype(np.int64)
            np.minimum.at(best, key, time[now][good])
            kept.append((key, time[now][good], point[now][good]))
            number[now] += np.uint64(1)
            point[now] = mixed(seed[now] + (number[now] + np.uint64(1)) * _STEP)
            time[now] -= np.log(unit(point[now])) / rate[now]
            now = now[time[now] <= limit[which[now]]]
        short = np.isinf(best).reshape(len(bags), slots).any(1)
        alive = alive[short[which[alive]]]
        limit[short] *= 2
    flat = ident.reshape(-1)
    for key, when, what in kept:
        first = when == best[key]
        flat[key[first]] = what[first]
    return ident


def bands(ident: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(texts, bands): digests of each band of a signature."""
    parts = ident.reshape(len(ident), -1, rows)
    code = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(rows):
        code = mixed(code * _ODD + parts[:, :, r])
    return code


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, th, node, rest, weight, bands) of every row; node and rest: digest of the multiset, null without shingles."""
    rows = keyed(docs)
    schema = T.StructType([rows.schema["doc_id"], rows.schema["th"]]).add("node", "long").add("rest", "long").add("weight", "integer").add("bands", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bags = [bag(t) for t in texts(batch)]
            code = bands(signatures(bags)).view(np.int64)
            full = [xxhash.xxh3_128_digest(s.tobytes() + c.tobytes()) if len(s) else None for s, c in bags]
            node, rest = ([x and int.from_bytes(x[k : k + 8], "little", signed=True) for x in full] for k in (0, 8))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("th"),
                    pa.array(node, pa.int64()),
                    pa.array(rest, pa.int64()),
                    pa.array([int(c.sum()) for _, c in bags], pa.int32()),
                    pa.array([list(x) if len(c) else None for x, (_, c) in zip(code, bags, strict=True)], pa.list_(pa.int64())),
                ],
                names=schema.names,
            )

    return rows.mapInArrow(run, schema)


def shingled(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, elements): the multisets of the documents (doc_id, th, node) in `wanted`, as packed sorted 64-bit digests."""
    # the text is read again for these rows only, and moved only if they are too many to be sent to where it lies
    key = wanted.select(F.col("doc_id").alias("_doc_id"), F.col("th").alias("_th"), "node")
    key = F.broadcast(key) if key.count() <= SENT_ROWS else key
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("th") == F.col("_th"))
    rows = keyed(docs).join(key, same).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            packed = [elements(*bag(t)).tobytes() for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(packed, pa.binary())], names=["node", "elements"])

    # repeated rows give a set twice
    return rows.mapInArrow(run, "node long, elements binary").dropDuplicates(["node"])


def rare_buckets(sets: DataFrame, crowded: DataFrame, least: float) -> DataFrame:
    """(bucket, node, weight): a bucket for each rare shingle of the nodes in `crowded` (node, weight).

    If the overlap of two multisets is at least `least`, then, in any fixed order of shingles, the first n - ceil(least * n) + 1 of each, n
    its size, have one in common. In the order of rising frequency these are shingles that few share, so a crowded bucket falls apart
    into small ones without losing a link. A shingle that one node alone has takes its place in the order but needs no bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            each = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("elements")]
            node = batch.column("node").take(pa.array(np.repeat(np.arange(len(each)), [len(x) for x in each])))
            yield pa.RecordBatch.from_arrays([node, pa.array(np.concatenate(each))], names=["node", "e"])

    each = sets.join(crowded.select("node"), "node", "left_semi").mapInArrow(run, "node long, e long")
    common = each.groupBy("e").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = each.join(common, "e").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "e"))).alias("own"))
    own = own.join(crowded, "node")
    prefix = F.col("weight") - F.ceil(F.col("weight") * F.lit(least) - 1e-9) + 1
    wanted = F.greatest(prefix - (F.col("weight") - F.size("own")), F.lit(0)).cast("int")
    rows = own.select(F.explode(F.slice("own", F.lit(1), wanted)).alias("x"), "node", "weight").select(
        F.xxhash64("x.e", F.lit(1)).alias("bucket"), "node", "weight"
    )
    rows = stored(rows, "dup-rare")
    # the shingles around one edit have the same members: one bucket of them is enough, and none is needed for a member alone
    same = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    alike = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *same).where("n > 1")
    one = alike.groupBy("n", "x1", "x2").agg(F.min("bucket").alias("bucket")).select("bucket")
    return rows.join(one, "bucket", "left_semi")


def linked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose multisets have a Jaccard similarity of at least `least`."""
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                common = int((q[at] == p).sum())
                good.append(common >= least * (len(p) + len(q) - common) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def forest(sets: list[np.ndarray], part: np.ndarray, own: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of rows that are linked and join components: `part` is the component of each row so far. Rows of one slice are compared with
    each other if all are of one slice, else with those of the other slice."""
    n, sizes = len(sets), np.array([len(x) for x in sets])
    _, code, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    shared = df[code] > 1  # what one row has alone is in no overlap
    code, row = code[shared], row[shared]
    by_code = row[np.argsort(code, kind="stable")]
    edges = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(df)))])
    starts = np.searchsorted(row, np.arange(n + 1))
    cross = bool((own != own[0]).any())
    _, label = np.unique(part, return_inverse=True)
    found = []
    for i in range(n - 1):
        mine = code[starts[i] : starts[i + 1]]
        length = edges[mine + 1] - edges[mine]
        first = np.repeat(edges[mine] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) if len(mine) else length
        common = np.bincount(by_code[first + np.arange(len(first))], minlength=n)
        good = (common >= least * (sizes[i] + sizes - common) - 1e-9) & (label != label[i])
        good[: i + 1] = False
        if cross:
            good &= own != own[i]
        for j in np.flatnonzero(good):
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                found.append((i, int(j)))
    return found


def linked_inside(now: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that join parts inside the buckets of `now` (bucket, node, part, weight, n, shingles).

    A bucket is cut into slices of about `SLICE_ROWS` members and `SLICE_SHINGLES` shingles, and each pair of slices meets in one task.
    """
    slices_of = F.ceil(F.greatest(F.col("n") / SLICE_ROWS, F.col("shingles") / SLICE_SHINGLES)).cast("int")
    whole = now.withColumn("s", slices_of).withColumn("own", F.pmod(F.xxhash64("node"), F.col("s")).cast("int")).join(sets, "node")
    dealt = whole.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1))).select(
        "bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "part", "elements"
    )
    keys = ["bucket", "lo", "hi"]

    def links(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        each = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["elements"]]
        node, part, own = (rows[c].to_numpy() for c in ("node", "part", "own"))
        found = forest(each, part, own, least) if len(each) > 1 else []
        ends = [node[[p[k] for p in found]].astype(np.int64) if found else np.zeros(0, np.int64) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(*ends)), pa.array(np.maximum(*ends))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, parts = None, []
        for batch in batches:
            marks = [batch.column(c).to_numpy() for c in keys]
            starts = [0, *np.flatnonzero(np.any([np.diff(m, prepend=m[:1]) != 0 for m in marks], axis=0)), batch.num_rows]
            for at, end in zip(starts, starts[1:], strict=False):
                if at == end:
                    continue
                here = tuple(m[at] for m in marks)
                if here != place and parts:
                    yield links(parts)
                    parts = []
                place = here
                parts.append(batch.slice(at, end - at))
        if parts:
            yield links(parts)

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def merged(parts: DataFrame, links: DataFrame, n_links: int) -> DataFrame:
    """(node, part) after `n_links` links (a, b) have joined parts: smallest labels spread along links, with jumps along labels."""
    files = 1 + n_links // LINKS_A_FILE
    of = lambda c: parts.select(F.col("node").alias(c), F.col("part").alias(f"{c}_part"))
    edges = links.join(of("a"), "a").join(of("b"), "b").where("a_part <> b_part").select("a_part", "b_part").distinct()
    ends = F.array(F.struct(F.col("a_part").alias("u"), F.col("b_part").alias("v")), F.struct(F.col("b_part").alias("u"), F.col("a_part").alias("v")))
    both = stored(edges.select(F.inline(ends)).coalesce(files), "dup-edges")
    names = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("l"))
    names = stored(names.coalesce(files), "dup-labels")
    moved = 1
    while moved:
        near = both.join(names.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        jump = names.select(F.col("u").alias("l"), F.col("l").alias("ll"))
        step = names.join(near, "u").join(jump, "l", "left").select("u", F.least("l", "m", "ll").alias("new"), "l")
        seen = Observation()
        step = step.coalesce(files).observe(seen, F.count_if(F.col("new") != F.col("l")).alias("moved"))
        names = stored(step, "dup-labels").select("u", F.col("new").alias("l"))
        moved = seen.get["moved"]
    new = names.select(F.col("u").alias("part"), F.col("l"))
    return stored(parts.join(new, "part", "left").select("node", F.coalesce("l", "part").alias("part")), "dup-parts")


def _ordered(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def candidate_parts(docs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(node, part) of every node that shares a bucket with another. `nodes`: node, doc_id, th, weight, bands."""
    # the digest of a band holds its number, so it names the bucket
    members = nodes.select(F.explode("bands").alias("bucket"), "node", "weight")
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).cast("int").alias("n")).where("n > 1")
    members = stored(members.join(shared, "bucket"), "dup-buckets")
    some = members.groupBy("node", "weight").agg(F.max("n").alias("n"))
    parts = stored(some.select("node", F.col("node").alias("part"), "weight", "n"), "dup-parts")
    sets = stored(shingled(docs, nodes.select("doc_id", "th", "node").join(parts, "node", "left_semi")), "dup-sets")
    crowded = parts.where(F.col("n") > CROWD).select("node", "weight")
    parts = parts.select("node", "part")
    small = members.where(F.col("n") <= CROWD).select("bucket", "node", "weight")
    members = small.unionAll(rare_buckets(sets, crowded, least))
    seen: DataFrame | None = None
    for number in range(STARS + 1):
        now = stored(members.join(parts, "node"), "dup-members")  # with the components so far
        sizes = now.groupBy("bucket").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("weight").cast("long")).alias("shingles"), F.min("part").alias("p"), F.max("part").alias("q")
        )
        is_open = stored(sizes.where("p <> q").drop("p", "q"), "dup-open")
        if is_open.isEmpty():
            return parts
        now = now.join(is_open, "bucket")
        last = number == STARS
        few = now.where(F.col("n") <= CROWD) if last else now
        if last:
            lead = few.select("bucket", F.col("node").alias("leader"), F.col("weight").alias("lw"), F.col("part").alias("lp"))
            apart = F.col("part") < F.col("lp")
        else:
            # one leader of each bucket: the first by a digest that all buckets share
            place = F.xxhash64("node", F.lit(number))
            lead = now.groupBy("bucket").agg(F.min(F.struct(place.alias("h"), "node", "weight", "part")).alias("m"))
            lead = lead.select("bucket", F.col("m.node").alias("leader"), F.col("m.weight").alias("lw"), F.col("m.part").alias("lp"))
            apart = F.col("part") != F.col("lp")
        near = F.least("weight", "lw") >= F.greatest("weight", "lw") * least - 1e-9
        pairs = few.join(lead, "bucket").where(apart & near).select(*_ordered(F.col("node"), F.col("leader"))).distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = stored(pairs, "dup-pairs")
        links = linked(pairs, sets, least)
        if last:
            links = links.unionAll(linked_inside(now.where(F.col("n") > CROWD), sets, least))
        found = Observation()
        links = stored(links.observe(found, F.count(F.lit(1)).alias("n")), "dup-links")
        if found.get["n"]:
            parts = merged(parts, links, found.get["n"])
        seen = pairs if seen is None else seen.union(pairs)
    return parts


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per row of `docs`: doc_id, th, class_id, class_size (distinct documents), first (is it the one that stays?)."""
    rows = stored(sketched(docs), "dup-sketches")
    place = F.struct("doc_id", "th")
    full = rows.where(F.col("node").isNotNull())
    nodes = full.groupBy("node", "rest").agg(F.min(place).alias("p"), F.first("weight").alias("weight"), F.first("bands").alias("bands"))
    nodes = stored(nodes.select("node", "p.*", "weight", "bands"), "dup-nodes")
    parts = candidate_parts(docs, nodes, least)
    named = nodes.join(parts, "node", "left").select("node", "doc_id", "th", F.coalesce("part", "node").alias("part"))
    # null ids sort first, but a class is named and kept by a row that has an id if there is one
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th")
    best = full.groupBy("node").agg(F.min(order).alias("f"), F.count_distinct("doc_id", "th").alias("k"))
    named = named.select("node", "part").join(best, "node")
    classes = named.groupBy("part").agg(F.min("f").alias("f"), F.sum("k").alias("class_size"))
    of_node = named.select("node", "part").join(classes, "part").select("node", "f", "class_size")
    out = rows.join(of_node, "node", "left")
    alone = F.col("f").isNull()
    same = F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("th") == F.col("f.th"))
    return out.select(
        "doc_id",
        "th",
        F.when(alone, F.col("doc_id")).otherwise(F.col("f.doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        (alone | same).alias("first"),
    )


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "class_id", "class_size", F.col("first").alias("kept"))


def one_of_each(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` less near-duplicates: of each class the document with the smallest doc_id, of repeated rows one."""
    found = near_duplicates(docs, least).groupBy("doc_id", "th").agg(F.first("first").alias("first"), F.count(F.lit(1)).alias("times"))
    both = with_rows(whole_rows(docs), found).where("first")
    once = both.where("times = 1").select("row")
    again = both.where("times > 1").dropDuplicates(["doc_id", "th"]).select("row")
    return unpacked(once.unionAll(again), docs.columns)
