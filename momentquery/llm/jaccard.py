"""Jaccard self-join on word shingles by grouped prefixes, and the components of its links.

A document's set holds its distinct shingles of `width` successive words, as 64-bit hashes (words are runs of other
than ASCII white space, A-Z in lower case); with fewer words, the whole sequence is the one shingle. Two documents
link when 100 * |A and B| >= percent * |A or B|.

Documents of one set are one class, a node, named by a 64-bit digest of the set. Shingles have one global order:
frequent ones last, where "frequent" is a list of bounded length, gathered from what single tasks see often; any
order gives the same links, this one keeps passages that many documents share out of the prefixes. Two sets can only
link if they share a shingle in their first |A| - ceil(t |A|) + 1 ones.

Classes with the same prefix and size are one group. Only groups have postings, and only groups meet, on shared
prefix shingles. A pair of groups is left out by their sizes, by the places of the shingle, and by marks: bits with
the parity of a set's hashes, whose differing places bound the sets' difference from below. A group has the marks of
its first member and the radius that holds those of all others, so two groups whose marks differ by more than a link
allows and both radii have no link between their members. Only the pairs of groups that are left are expanded to
members, which meet the same filters and then have their whole sets compared. Members of one group meet there.

Families of near copies never become all their pairs: groups first meet each shingle's first group only, and members
their group's first (as many pairs as there are rows), and what remains are pairs whose members are not yet in one
component. So every link between different texts is either found or spanned by other links. A key where many still
meet is dealt out by size bands and salted.

Nulls: null or empty texts and texts without words have empty sets, link with nothing, and are their own component;
rows without an id have a null component and link with nothing. Rows that repeat an id are documents of their own:
with the same text they have the same component, with another text that text's. An empty table gives no rows. Extra
columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .common import prepared, settled, written
from .components import connected

#: The frequent shingles whose order is by count, at most; all others come before them, by hash.
FREQUENT = 200_000
#: A task reports a shingle that so many of its documents have.
SEEN_IN_TASK = 4
#: Bytes of text that are hashed at once.
SPAN = 1 << 19
#: Bits of the coarse marks, and most bits of the fine ones, which a set has as many of as shingles or more.
MARKS, FINE = 1024, 1 << 17
#: Buckets of ids that tell which documents' sets are needed; those that share one by chance are sorted out later.
BUCKETS = 1 << 20
#: Rows that may meet at a key with nothing but the filters by size and place, and that meet in one task at a key
#: with more.
HOT, SALT = 16, 1024
#: Rounds of pairs with a first class, before the remaining pairs are listed.
STARS = 2


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def _span_sets(x: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """Shingle sets of the texts x[at[i]:at[i + 1]]."""
    _, _, a, first = words.found(x, at)
    whole = np.full(max(0, len(a) - width + 1), width, np.uint64)
    for j in range(width):
        whole = words.mixed(whole * words.ODD + a[j : j + len(whole)])
    sets = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= width:
            sets.append(_distinct(whole[lo : hi - width + 1]))
        elif hi > lo:
            h = np.full(1, hi - lo, np.uint64)
            for j in range(lo, hi):
                h = words.mixed(h * words.ODD + a[j])
            sets.append(h)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; the number of words is part of a hash, so shorter sequences
    differ from all others."""
    return [s for _, x, at in words.spans(texts, SPAN) for s in _span_sets(x, at, width)]


def _sets(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    return shingle_sets(batch.column("text"), width)


def frequent(documents: DataFrame, width: int) -> np.ndarray:
    """At most FREQUENT hashes, rarest first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often: dict[int, int] = {}
        held: list[np.ndarray] = []

        def flush() -> None:
            if held:
                h, n = np.unique(np.concatenate(held), return_counts=True)
                for x, m in zip(h[n >= SEEN_IN_TASK].view(np.int64).tolist(), n[n >= SEEN_IN_TASK].tolist()):
                    often[x] = often.get(x, 0) + m
                held.clear()

        size = 0
        for batch in batches:
            for s in _sets(batch, width):
                held.append(s)
                size += len(s)
                if size > 4_000_000:
                    flush()
                    size = 0
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(list(often), pa.int64()), pa.array(list(often.values()), pa.int64())], ["token", "n"])

    rows = (
        documents.select("text")
        .mapInArrow(count, "token long, n long")
        .groupBy("token")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "token")
        .limit(FREQUENT)
        .toArrow()
    )
    return rows["token"].to_numpy().view(np.uint64)[::-1].copy()


def node(s: np.ndarray) -> int | None:
    """A set's number; None for the empty one."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None


def text_key(text: Column) -> Column:
    """What tells apart rows that share an id."""
    return F.xxhash64(text)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def marks(s: np.ndarray, bits: int) -> np.ndarray:
    """The parity of a set's hashes in so many bits, packed. Halves folded by exclusive or are those of half the bits."""
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, 8)[:, ::-1]).reshape(-1)


def fine_bits(n: int) -> int:
    return min(FINE, max(MARKS, 1 << max(0, n - 1).bit_length()))


@F.arrow_udf(T.LongType())
def _fine_difference(a: pa.Array, b: pa.Array) -> pa.Array:
    """How many bits of two sets' fine marks differ, at the width of the narrower ones."""
    out = []
    for x, y in zip(a, b):
        x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
        n = min(len(x), len(y))
        x, y = (np.bitwise_xor.reduce(z.reshape(-1, n), axis=0) for z in (x, y))
        out.append(int(np.bitwise_count(x ^ y).sum()))
    return pa.array(out, pa.int64())


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)), pa.array(flat.view(np.int64)))


def shingled(documents: DataFrame, last: np.ndarray, width: int, percent: int) -> DataFrame:
    """doc_id, text_key, n, node (null for empty sets), group (of size and prefix), coarse marks, fine marks (null where
    the coarse ones are as wide), prefix (in the global order)."""
    shared = documents.sparkSession.sparkContext.broadcast(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(shared.value, kind="stable")
        known = shared.value[order]
        for batch in batches:
            n, nodes, groups, coarse, fine, prefixes = [], [], [], [], [], []
            for s in _sets(batch, width):
                p = s[: prefix_length(len(s), percent)] if len(s) else s
                if len(known) and len(s):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    often = known[at] == s
                    if often.any():
                        p = s[np.argsort(np.where(often, order[at] + 1, 0), kind="stable")[: len(p)]]
                n.append(len(s))
                nodes.append(node(s))
                groups.append(node(np.append(p, np.uint64(len(s)))))
                coarse.append(marks(s, MARKS).view(np.int64))
                fine.append(marks(s, fine_bits(len(s))).tobytes() if len(s) > MARKS else None)
                prefixes.append(p)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(groups, pa.int64()), _lists(coarse), pa.array(fine, pa.binary()), _lists(prefixes)],
                ["doc_id", "text_key", "n", "node", "group", "marks", "fine", "prefix"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    return rows.mapInArrow(run, "doc_id long, text_key long, n long, node long, group long, marks array<long>, fine binary, prefix array<long>")


def _may_link(n_a: Column, n_b: Column, percent: int) -> Column:
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


def _may_overlap(n_a: Column, i: Column, n_b: Column, j: Column, percent: int) -> Column:
    """Sets that share the shingles at places i and j share no more than this from before, there, and after."""
    most = F.least(i, j) + 1 + F.least(n_a - i - 1, n_b - j - 1)
    return (100 + percent) * most >= percent * (n_a + n_b)


def _needed_sets(documents: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """node, shingles for needed(node, lead), where lead is the id of a document of the class. Other texts stay where
    they are read: a broadcast list of at most BUCKETS buckets says which may be needed, the join with the nodes is
    exact."""
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")
    wanted = needed.select(bucket("lead").alias("bucket")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _sets(batch, width)
            yield pa.RecordBatch.from_arrays([batch.column("lead"), pa.array([node(s) for s in sets], pa.int64()), _lists(sets)], ["lead", "node", "shingles"])

    rows = documents.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("lead"), "text")
    rows = rows.withColumn("bucket", bucket("lead")).join(F.broadcast(wanted), "bucket", "left_semi").select("lead", "text")
    return rows.mapInArrow(run, "lead long, node long, shingles array<long>").join(needed, ["lead", "node"], "left_semi").dropDuplicates(["node"]).drop("lead")


def _within_fine_marks(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b, na, nb) whose fine marks, where both have them, differ in no more places than a link's."""
    wide = (F.col("na") > MARKS) & (F.col("nb") > MARKS)
    fine = classes.filter(F.col("fine").isNotNull()).select("node", "fine")
    both = (
        pairs.filter(wide)
        .join(fine.select(F.col("node").alias("a"), F.col("fine").alias("fa")), "a")
        .join(fine.select(F.col("node").alias("b"), F.col("fine").alias("fb")), "b")
        .filter(_few(_fine_difference("fa", "fb"), percent))
    )
    return pairs.filter(~wide).select("a", "b").unionByName(both.select("a", "b"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b) whose whole sets link."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_sb"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("_sa", "_sb"))
    union = F.size("_sa") + F.size("_sb") - shared
    return both.filter(100 * shared >= percent * union).select("a", "b")


#: Columns of the coarse marks.
_MARKS = [f"m{k}" for k in range(MARKS // 64)]


def _spread(marks: str = "marks") -> list[Column]:
    return [F.element_at(marks, k + 1).alias(m) for k, m in enumerate(_MARKS)]


def _differ(names: list[str]) -> Column:
    """In how many places marks of a and b differ."""
    return sum((F.bit_count(F.col(f"{m}a").bitwiseXOR(F.col(f"{m}b"))) for m in names), F.lit(0))


def _few(differ: Column, percent: int) -> Column:
    """Whether sets that differ in so many shingles at least may link."""
    return (100 + percent) * differ <= (100 - percent) * (F.col("na") + F.col("nb"))


def _may_meet(percent: int) -> Column:
    """Whether a and b, groups or members that meet at a key, may have a link between different components, which lie
    between low and high."""
    na, nb = F.col("na"), F.col("nb")
    same = (F.col("lowa") == F.col("higha")) & (F.col("lowb") == F.col("highb")) & (F.col("lowa") == F.col("lowb"))
    return ~same & _may_link(na, nb, percent) & _may_overlap(na, F.col("placea"), nb, F.col("placeb"), percent)


_AT = ("id", "n", "place", "low", "high", "lead")


def _side(rows: DataFrame, x: str, *more: Column) -> DataFrame:
    """rows with a side's letter at the names of _AT."""
    return rows.select(F.col("key").alias(f"key{x}"), *[F.col(c).alias(f"{c}{x}") for c in _AT], *more)


def _star_pairs(at: DataFrame, step: int, percent: int) -> DataFrame:
    """at(key, id, n, place, low, high, lead) -> ida, idb: one id of each key with the key's others. It is the one of
    the earliest document, as copies come after what they are made from; in the next step, one of the last component,
    which is another one than the first where there are two. It is found by partial sums, so no key is ever in one task."""
    one = F.max(F.struct("low", "id", "n", "place", "high", "lead")) if step % 2 else F.min(F.struct("lead", "id", "n", "place", "low", "high"))
    hub = at.groupBy(F.col("key").alias("keya")).agg(one.alias("hub"))
    hub = hub.select("keya", *[F.col(f"hub.{c}").alias(f"{c}a") for c in _AT])
    both = _side(at, "b").join(hub, (F.col("keya") == F.col("keyb")) & (F.col("ida") != F.col("idb")) & _may_meet(percent))
    return both.select("ida", "idb").distinct()


def _all_pairs(at: DataFrame, marked: DataFrame, percent: int) -> DataFrame:
    """at(key, id, n, place, low, high, lead, df), marked(id, radius, marks) -> ida, idb that meet at a key and may link. df:
    rows at the key, or more.

    A key with more than HOT rows would make the square of them: there the marks, halves folded onto each other, are
    part of the join's condition, rows only meet those of their own size band or the next one, and a key's rows are
    salted, SALT to a task."""
    fit = _may_meet(percent)
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("ida") < F.col("idb")))
    few = at.filter(F.col("df") <= HOT)
    cold = _side(few, "a").join(_side(few, "b"), (F.col("keya") == F.col("keyb")) & smaller & fit)

    half = len(_MARKS) // 2
    names = _MARKS[:half]
    folded = marked.select(F.col("id").alias("_id"), "radius", *[F.col(m).bitwiseXOR(F.col(f"m{k + half}")).alias(m) for k, m in enumerate(names)])
    band = F.floor(F.log("n") / F.lit(math.log(100 / percent)) + 1e-9)
    hot = at.filter(F.col("df") > HOT).join(folded, F.col("id") == F.col("_id"))
    hot = hot.withColumn("band", band).withColumn("salts", F.ceil(F.col("df") / SALT).cast("int"))
    marks = lambda x: [F.col(m).alias(f"{m}{x}") for m in [*names, "radius"]]
    # The smaller one of a pair looks in its own band and the next, under every salt; the other has one.
    spread = hot.withColumn("look", F.explode(F.array("band", F.col("band") + 1))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    left = _side(spread, "a", F.col("look").alias("banda"), F.col("salt").alias("salta"), *marks("a"))
    right = _side(hot, "b", F.col("band").alias("bandb"), F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("saltb"), *marks("b"))
    meet = (F.col("keya") == F.col("keyb")) & (F.col("banda") == F.col("bandb")) & (F.col("salta") == F.col("saltb"))
    near = _few(_differ(names) - F.col("radiusa") - F.col("radiusb"), percent)
    warm = left.join(right, meet & smaller & fit & near)
    return cold.select("ida", "idb").unionByName(warm.select("ida", "idb")).distinct()


def _grouped(classes: DataFrame) -> DataFrame:
    """group, n, size, its first and last node (by their earliest documents), marks of the first, and the radius about
    them that holds all members'."""
    groups = classes.groupBy("group").agg(
        F.min(F.struct("lead", "node", "marks")).alias("first"), F.max(F.struct("lead", "node")).alias("last"), F.first("n").alias("n"), F.count("*").alias("size")
    )
    groups = groups.select("group", "n", "size", F.col("first.node").alias("first"), F.col("last.node").alias("last"), F.col("first.marks").alias("marks"))
    many = groups.filter("size > 1").select("group", F.col("marks").alias("_marks"))
    differ = F.aggregate(F.zip_with("marks", "_marks", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    radius = classes.select("group", "marks").join(many, "group").groupBy("group").agg(F.max(differ).alias("radius"))
    return groups.join(radius, "group", "left").na.fill(0, ["radius"])


def _expanded(pairs: DataFrame, first: DataFrame, second: DataFrame, percent: int) -> DataFrame:
    """pairs(ida, idb) of groups as pairs of their members first(group, node, n, component, marks) and second: a, b, na,
    nb. Members of one component, and those whose marks tell them apart, never leave the join."""

    def side(of: DataFrame, x: str) -> DataFrame:
        return of.select(F.col("group").alias(f"group{x}"), F.col("node").alias(x), *[F.col(c).alias(f"{c}{x}") for c in ("n", "component", *_MARKS)])

    fit = (F.col("componenta") != F.col("componentb")) & _few(_differ(_MARKS), percent)
    both = pairs.join(side(first, "a"), F.col("ida") == F.col("groupa")).join(side(second, "b"), (F.col("idb") == F.col("groupb")) & fit)
    turned = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x)
    return both.select(pick("a", "b"), pick("b", "a"), pick("na", "nb"), pick("nb", "na")).distinct()


def links(documents: DataFrame, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents by class, classes, components of classes).

    The first: doc_id, text_key, n, node (null for empty sets and null ids). The second: node, lead (smallest id of
    the class), and what else is known of its set. The third: node, component; a class that links with no other is
    not in it.
    """
    documents = documents.select("doc_id", "text")
    prepared(documents.sparkSession)
    settled(documents.sparkSession)  # what ran before
    rows = written(shingled(documents, frequent(documents, width), width, percent), "shingled")
    some = rows.filter("n > 0 and doc_id is not null")
    per_class = [F.first(c).alias(c) for c in ("n", "group", "marks", "fine")]
    classes = written(some.groupBy("node").agg(F.min("doc_id").alias("lead"), *per_class), "classes")
    groups = written(_grouped(classes), "groups")

    # Only groups have postings; one document of the group's first class gives them.
    leads = groups.select(F.col("first").alias("node")).join(classes.select("node", F.col("lead").alias("doc_id")), "node")
    prefixes = some.select("doc_id", "node", "n", "prefix", "group").join(leads, ["doc_id", "node"]).dropDuplicates(["group"])
    postings = prefixes.select(F.col("group").alias("id"), F.col("doc_id").alias("lead"), F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("place", "key"))
    postings = written(postings.withColumn("df", F.count("*").over(W.partitionBy("key"))).filter("df > 1"), "postings")
    members = classes.select("node", "group", "lead", F.col("n").cast("int").alias("n"), *_spread())
    marked = groups.select(F.col("group").alias("id"), "radius", *_spread())
    settled(documents.sparkSession)

    found: DataFrame | None = None
    component: DataFrame | None = None
    for step in range(STARS + 1):
        of = members if component is None else members.join(component, "node", "left")
        of = written(of.withColumn("component", F.col("node") if component is None else F.coalesce("component", "node")), "members")
        span = of.groupBy("group").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        at = written(postings.join(span, F.col("id") == F.col("group")).select("key", *_AT, "df"), "meeting")
        many = groups.filter("size > 1").select("group", "size").join(span.filter("low <> high"), "group")
        if step < STARS:
            # The first group's first member stands for it; its other members meet that one in their own group.
            one = groups.select(F.col("last" if step % 2 else "first").alias("node")).join(of, "node")
            met = _star_pairs(at, step, percent).unionByName(many.select(F.col("group").alias("ida"), F.col("group").alias("idb")))
            pairs = _expanded(met, one, of, percent)
        else:
            pairs = _expanded(_all_pairs(at, marked, percent), of, of, percent)
            # Members of one group meet at the group, where all places are shared.
            inside = of.join(many.select("group", "size"), "group").select(
                F.col("group").alias("key"), F.col("node").alias("id"), "n", F.lit(0).alias("place"),
                F.col("component").alias("low"), F.col("component").alias("high"), "lead", F.col("size").alias("df"),
            )
            inner = _all_pairs(inside, of.select(F.col("node").alias("id"), F.lit(0).alias("radius"), *_MARKS), percent)
            size = classes.select("node", F.col("n").cast("int").alias("n"))
            inner = inner.select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b"))
            inner = inner.join(size.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
            pairs = pairs.unionByName(inner).distinct()
        pairs = written(_within_fine_marks(written(pairs, "met"), classes, percent), "pairs")
        if found is not None and pairs.isEmpty():
            continue
        settled(documents.sparkSession)
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        sets = _needed_sets(documents, written(nodes.join(classes.select("node", "lead"), "node"), "needed"), width)
        new = written(_verified(pairs, written(sets, "sets"), percent), "links")
        found = new if found is None else found.unionByName(new)
        settled(documents.sparkSession)
        component = connected(found)
        settled(documents.sparkSession)
    return rows.select("doc_id", "text_key", "n", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")), classes, component


def components(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, and text_key, which tells apart rows that share an id."""
    rows, classes, component = links(documents, width, percent)
    linked = classes.select("node", "lead").join(component, "node")
    least = linked.groupBy("component").agg(F.min("lead").alias("least"))
    labels = classes.select("node", "lead").join(linked.select("node", "component").join(least, "component").select("node", "least"), "node", "left")
    labels = written(labels.select("node", F.coalesce("least", "lead").alias("label")), "labels")
    return rows.join(labels, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id"), "text_key")
