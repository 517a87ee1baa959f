"""Exact Jaccard join of documents on word shingles, by adaptive prefixes with multiple matches.

All sets are sorted by one order. Shingles whose hash lies below a fixed share of all hashes come
first, the rarer (by the documents that have it, counted exactly) before the more frequent; the others
follow by hash. The share is a little more than a prefix needs, so the prefixes of nearly all
documents consist of counted shingles. If x and y are similar enough they share the first l of their
common shingles within the first |x| - need(x) + l and |y| - need(y) + l places, for every l. Each document
picks the l that it expects to cost least: a longer prefix meets more postings, but a candidate must
then share l of them. Shingles that one document alone has take places but need no posting.

Lists of few documents give their pairs at once; a pair goes on to the comparison only if the parities
of its sets, folded to 128 bits, differ in no more places than the sets of a similar pair can.
For the longer lists the result is components of links, so equal sets are one vertex, and first each document is
compared with one document that leads the lists it is in, another one each round.
Lists whose documents are in one component are left behind after each round. The lists still open then are put
together by their leaders: lists that share most of their documents share the leader, too, so two documents meet once for each leader
and not once for each word that they share. Such a group is dealt into blocks of sets and every two blocks are compared in one
place, which gives only the links that join components; no rows are made for pairs.
Links are counted once the components are known, by the blocks of each component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, released, uid_of, written
from .graphs import components
from .repeats import BROADCAST_KEYS, as_long, mixed, only

#: Counted shingles, as a multiple of the share of a set that a prefix takes.
COUNTED = 1.5
MAX_MATCHES = 4
#: Price of comparing two sets, in postings read, for each shingle of the set.
VERIFY_COST = 0.25
#: Rounds of comparing with one leader before what is still open is compared in blocks.
ROUNDS = 3
#: Documents in a list that gives its pairs at once.
FEW = 8
#: The blocks are compared without such rounds where lists hold at most so many pairs across components for each posting.
DIRECT = 1
#: A leader is worth comparing with when it shares more than one in so many of the places of a prefix.
PROMISING = 4

#: Bytes of a group's sets that are compared with as many others in one place.
BLOCK = 1 << 20
#: Sets of more hashes are also compared by their parities in 2 to the power of WIDE places.
FOLDED, WIDE = 100, 11

_MUL = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the size-word shingles of each text; shorter sequences are one shingle.

    Words are runs of characters other than ASCII white space, A-Z in lower case; texts without
    words (and nulls) have an empty set.
    """
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    bounds = np.asarray(lists.offsets).astype(np.int64)
    bounds -= bounds[0]
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    codes = np.asarray(coded.indices)
    if "" in words:
        keep = codes != words.index("")
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        codes = codes[keep]
    h = table[codes]
    with np.errstate(over="ignore"):
        rolled = mixed(h)
        for _ in range(size - 1):  # shingle i from the hash of one word less at i + 1
            nxt = np.concatenate([rolled[1:], np.zeros(1, np.uint64)])
            rolled = mixed(h * _MUL[0] + nxt)
        out = []
        for a, e in zip(bounds[:-1], bounds[1:]):
            if e - a >= size:
                out.append(np.unique(rolled[a : e - size + 1]))
            elif e > a:
                one = np.uint64(e - a) * _MUL[1]
                for x in h[a:e]:
                    one = mixed(one * _MUL[2] + x)
                out.append(np.atleast_1d(one))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def folded(sets: list[np.ndarray], bits: int = 7) -> np.ndarray:
    """Longs for each set: the parities of its hashes by their first bits, two for 7. Sets with d hashes of their own differ in d of these at most."""
    width = 1 << bits
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    cell = (np.concatenate([*sets, np.zeros(0, np.uint64)]) >> np.uint64(64 - bits)).astype(np.int64)
    odd = (np.bincount(own * width + cell, minlength=width * len(sets)) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(len(sets), width // 64)


def _posts(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """uid, n, set hashes a and b, parities p and q of every row, and the hashes that can get into its prefix.

    post holds the first `counted` hashes, which are those below a fixed bound, and further ones where they
    can't fill a prefix.
    """
    bound = np.uint64(min(1.0, COUNTED * (100 - percent) / 100) * (2**64 - 2**12))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column(1), size)
            counted = [int(np.searchsorted(s, bound)) for s in sets]
            post = [s[: max(c, len(s) * (100 - percent) // 100 + MAX_MATCHES)].view(np.int64) for s, c in zip(sets, counted)]
            whole = [np.array([f(s) for s in sets], np.uint64) for f in (lambda s: np.add.reduce(mixed(s)), lambda s: np.bitwise_xor.reduce(mixed(s * _MUL[1])))]
            bits = folded(sets)
            cols = [b.column(0), pa.array([len(s) for s in sets], pa.int64()), *map(as_long, whole), pa.array(bits[:, 0]), pa.array(bits[:, 1]), pa.array(counted, pa.int32()), pa.array(post, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["uid", "n", "a", "b", "p", "q", "counted", "post"])

    return rows.select("uid", "text").mapInArrow(scan, "uid long, n long, a long, b long, p long, q long, counted int, post array<long>")


def _prefixes(posts: DataFrame, percent: int) -> DataFrame:
    """uid, n, p, q, matches, prefix (array of place, token) of the rows whose prefix has a token that others have, too."""
    posted = posts.select("uid", F.posexplode("post").alias("at", "token"), "counted")
    posted = posted.select("uid", "token", F.when(F.col("at") >= F.col("counted"), F.col("at")).alias("late"))
    shared = written(posted.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    own = posted.join(shared, "token").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("late", "df", "token"))).alias("own"))
    free = F.col("n") - F.floor((percent * F.col("n") + 99) / 100)
    most = F.least(F.lit(MAX_MATCHES), F.col("n") - F.col("free"))
    # The counted tokens that no one else has come first, then those in own.
    alone = F.col("counted") - F.size(F.filter("own", lambda x: x["late"].isNull()))
    items = F.transform("own", lambda x, i: F.struct(F.coalesce(x["late"], F.col("alone") + i).alias("place"), x["token"].alias("token"), x["df"].alias("df")))
    rows = posts.drop("post").join(own, "uid").withColumns({"free": free, "alone": alone}).withColumn("most", most)
    rows = rows.withColumn("items", F.filter(items, lambda x: x["place"] < F.col("free") + F.col("most"))).where(F.size("items") > 0)
    reach = lambda k: F.aggregate("items", F.lit(0).cast("double"), lambda t, x: t + F.when(x["place"] < F.col("free") + k, x["df"] - 1).otherwise(0))
    priced = F.array_min(F.transform(F.sequence(F.lit(1), F.col("most").cast("int")), lambda k: F.struct((reach(k) * (1 + VERIFY_COST * F.col("n") / k)).alias("cost"), k.alias("k"))))
    rows = rows.withColumn("matches", priced["k"])
    prefix = F.transform(F.filter("items", lambda x: x["place"] < F.col("free") + F.col("matches")), lambda x: F.struct(x["place"].alias("place"), x["token"].alias("token")))
    return rows.select("uid", "n", "p", "q", "matches", prefix.alias("prefix"))


def _sets(rows: DataFrame, size: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in shingle_sets(b.column(1), size)], pa.binary())], ["uid", "items"])

    return rows.select("uid", "text").mapInArrow(scan, "uid long, items binary")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(s) > len(t):
                    s, t = t, s
                at = np.searchsorted(t, s)
                both = int((t[np.minimum(at, len(t) - 1)] == s).sum()) if len(t) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("uid").alias("u"), F.col("items").alias("x")), "u").join(sets.select(F.col("uid").alias("v"), F.col("items").alias("y")), "v")
    return written(both.select("u", "v", "x", "y").mapInArrow(scan, "u long, v long"), "links")


def _fits(percent: int, a: str, b: str):
    """Sizes that can reach the similarity, whichever is larger."""
    return (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))


def _need(percent: int):
    """Shingles that a similar pair of sets of x.n and y.n shares at least."""
    return F.floor((percent * (F.col("x.n") + F.col("y.n")) + 99 + percent) / (100 + percent))


def _early(x: str, percent: int, matches):
    """Whether x's token is among those in which a similar pair of these sizes shares its first matches."""
    return F.col(f"{x}.place") < F.col(f"{x}.n") - _need(percent) + matches


def _near(percent: int):
    """Whether the parities differ in no more bits than a similar pair of sets of these sizes has hashes of their own."""
    differ = lambda c: F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}")))
    return differ("p") + differ("q") <= F.col("x.n") + F.col("y.n") - 2 * _need(percent)


def _met(lists: DataFrame, percent: int) -> DataFrame:
    """u, v: pairs of documents that meet in lists and could be similar.

    Sizes of similar sets are in the same or in neighbouring classes, which are part of the join's key.
    """
    kind = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(percent / 100)) + 1e-9).cast("int") if percent < 100 else F.col("n").cast("int")
    lists = lists.withColumn("kind", kind)
    x, y = lists.alias("x"), lists.withColumn("kind", F.explode(F.array(F.col("kind") - 1, F.col("kind"), F.col("kind") + 1))).alias("y")
    least = F.least("x.matches", "y.matches")
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.kind") == F.col("y.kind")) & (F.col("x.uid") < F.col("y.uid")) & _fits(percent, "x.n", "y.n") & _early("x", percent, least) & _early("y", percent, least) & _near(percent))
    return met.select(F.col("x.uid").alias("u"), F.col("y.uid").alias("v")).distinct()


def _overlaps(s: np.ndarray, items: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hashes that s shares with each of the sets that follow each other in items; they have n hashes, none 0."""
    return np.add.reduceat(s[np.minimum(np.searchsorted(s, items), len(s) - 1)] == items, np.cumsum(n) - n, dtype=np.int64)


def _cells(sets: DataFrame, group: str) -> DataFrame:
    """Rows of sets (items and others) dealt into blocks by their bytes in the group, once for every two blocks i and j that hold the row's own."""
    many = written(sets.groupBy(group).agg(F.ceil(F.sum(F.length("items")) / BLOCK).alias("blocks")).where("blocks > 1"), "many")
    large = F.broadcast(many) if many.count() <= BROADCAST_KEYS else many
    dealt = sets.join(large, group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long"))).withColumn("block", F.pmod(F.xxhash64("uid"), "blocks"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return cells.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")


def _between(sets: DataFrame, percent: int) -> DataFrame:
    """Similar pairs (u, v) of each group of sets (lead, uid, comp, items), as many as join the components that are linked in it.

    All pairs across components are compared, those alone in full whose sizes and parities allow it. What
    is joined in a cell counts as one component there, so a cell gives fewer pairs than it has sets.
    """

    def cell(key, t):
        t = t.take(np.argsort(pc.binary_length(t.column("items")), kind="stable"))
        sets = [np.frombuffer(x, np.uint64) for x in t.column("items").to_pylist()]
        uid, block, n = np.asarray(t.column("uid")), np.asarray(t.column("block")), np.array([len(s) for s in sets])
        comp = np.unique(np.asarray(t.column("comp")), return_inverse=True)[1]
        one, wide = key[1].as_py() == key[2].as_py(), int(np.searchsorted(n, FOLDED, "right"))
        parities = [(0, folded(sets).view(np.uint64)), (wide, folded(sets[wide:], WIDE).view(np.uint64))]
        ends = np.searchsorted(percent * n, 100 * n, "right")
        u, v = [], []
        for k, end in enumerate(ends):
            at = np.arange(k + 1, end)
            at = at[(comp[at] != comp[k]) & (one | (block[at] != block[k]))]
            most = n[k] + n[at] - 2 * ((percent * (n[k] + n[at]) + 99 + percent) // (100 + percent))
            for first, bits in parities:
                if k >= first and len(at):
                    near = np.bitwise_count(bits[at - first] ^ bits[k - first]).sum(axis=1) <= most
                    at, most = at[near], most[near]
            if len(at):
                both = _overlaps(sets[k], np.concatenate([sets[x] for x in at]), n[at])
                at = at[(both > 0) & (100 * both >= percent * (n[k] + n[at] - both))]
                joined, least = np.unique(comp[at], return_index=True)
                u += [uid[k]] * len(least)
                v += list(uid[at[least]])
                comp[np.isin(comp, joined)] = comp[k]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    cells = _cells(sets, "lead").select("lead", "i", "j", "uid", "comp", "block", "items")
    return written(cells.groupBy("lead", "i", "j").applyInArrow(cell, "u long, v long"), "links")


def _degrees(sets: DataFrame, percent: int) -> DataFrame:
    """rep, d: documents with similar sets, for distinct sets (uid, comp, copies, items); 0 is left out.

    Only sets of one component can be similar. No task holds more than two blocks, and no pairs are written.
    """

    def cell(key, t):
        sets = [np.frombuffer(x, np.uint64) for x in t.column("items").to_pylist()]
        block, copies = np.asarray(t.column("block")), np.asarray(t.column("copies"))
        one = key[1].as_py() == key[2].as_py()
        left = np.arange(len(sets)) if one else np.flatnonzero(block == key[1].as_py())
        right = left if one else np.flatnonzero(block == key[2].as_py())
        total = np.zeros(len(sets), np.int64)
        if len(left) and len(right):
            items = np.concatenate([sets[k] for k in right])
            n = np.array([len(sets[k]) for k in right])
            for k in left:
                both = _overlaps(sets[k], items, n)
                near = (both > 0) & (100 * both >= percent * (len(sets[k]) + n - both)) & (right != k)
                total[k] += copies[right][near].sum()
                if not one:
                    total[right[near]] += copies[k]
        return pa.table({"uid": t.column("uid"), "d": pa.array(total)})

    cells = _cells(sets, "comp").select("comp", "i", "j", "uid", "block", "copies", "items")
    found = cells.groupBy("comp", "i", "j").applyInArrow(cell, "uid long, d long")
    return written(found.where("d > 0").groupBy(F.col("uid").alias("rep")).agg(F.sum("d").alias("d")), "degrees")


def grouped(rows: DataFrame, plain: bool, size: int, percent: int, counted: bool = False) -> DataFrame:
    """uid, n, comp (least uid of the group) and if counted links for rows (uid, text); plain: no two rows share a uid."""
    spark = rows.sparkSession
    arrow_rows(spark)
    once = (lambda df: df) if plain else (lambda df: df.dropDuplicates(["uid"]))
    every = written(_posts(rows, size, percent), "posts")
    full = every.where("n > 0")
    classes = full.groupBy("a", "b", "n").agg(F.min("uid").alias("rep"), (F.count("*") if plain else F.count_distinct("uid")).alias("copies"))
    classes = written(classes, "classes")
    spare = written(full.select("uid", "a", "b", "n").join(classes.where("copies > 1"), ["a", "b", "n"]).where("uid != rep").select("uid").distinct(), "spare")
    found = written(_prefixes(once(only(full, spare, "left_anti")), percent), "prefixes")
    posted = found.select("uid", "n", "matches", "p", "q", F.explode("prefix").alias("x")).select("uid", "n", "matches", "p", "q", "x.*")
    members = posted.groupBy("token").agg(F.count("*").alias("members")).where("members > 1")
    lists = written(posted.join(members, "token"), "lists")

    def sets_of(uids: DataFrame) -> tuple[DataFrame, DataFrame]:
        asked = written(uids.distinct(), "asked")
        return asked, written(once(_sets(only(rows, asked), size)), "sets")

    def compared(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "pairs")
        asked, sets = sets_of(pairs.select(F.explode(F.array("u", "v")).alias("uid")))
        links = _links(pairs, sets, percent)
        released(pairs, asked, sets)
        return links

    # A similar pair meets in a short list or in a long one.
    links = compared(_met(lists.where(F.col("members") <= FEW), percent))
    labels = components(spark.createDataFrame([], "uid long, comp long"), links)
    open_ = lists.where(F.col("members") > FEW).drop("members")
    for k in range(ROUNDS + 1):
        moved = labels.where("uid != comp")
        moved = F.broadcast(moved) if moved.count() <= BROADCAST_KEYS else moved
        known = open_.join(moved, "uid", "left").withColumn("comp", F.coalesce("comp", "uid"))
        rank = F.col("uid") if k == 0 else F.xxhash64("uid", F.lit(k))  # another leader each time
        parted = known.groupBy("token", "comp").agg(F.count("*").alias("c"), F.min(F.struct(rank.alias("rank"), "uid", "n", "comp")).alias("lead"))
        # A list whose documents are in one component has nothing to add, now or later.
        apart = parted.groupBy("token").agg(F.count("*").alias("comps"), F.sum("c").alias("c"), F.sum(F.col("c").cast("double") * F.col("c")).alias("same"), F.min("lead").alias("lead")).where("comps > 1")
        apart = written(apart, "apart")
        load = apart.agg(F.sum("c").alias("postings"), F.sum((F.col("c").cast("double") * F.col("c") - F.col("same")) / 2).alias("across")).first()
        if not load["postings"]:
            break
        left = written(known.join(apart.select("token", "lead"), "token"), "open")
        released(lists, apart)
        lists, open_ = left, left.drop("lead", "comp")
        last = k == ROUNDS or load["across"] <= DIRECT * load["postings"]
        if last:
            groups = written(left.select(F.col("lead.uid").alias("lead"), "uid", "comp").distinct(), "groups")
            asked, sets = sets_of(groups.select("uid"))
            labels = components(labels, _between(groups.join(sets, "uid"), percent))
            released(groups, asked, sets)
            break
        met = left.where((F.col("comp") != F.col("lead.comp")) & _fits(percent, "n", "lead.n"))
        met = met.groupBy("uid", F.col("lead.uid").alias("v"), "n").agg(F.count("*").alias("c"))
        met = met.where(F.col("c") * 100 * PROMISING > F.col("n") * (100 - percent))
        pairs = met.groupBy(F.col("uid").alias("u")).agg(F.max(F.struct("c", "v")).alias("best")).select("u", "best.v")
        labels = components(labels, compared(pairs))
    released(lists, found, spare)
    tops = classes.join(labels.select(F.col("uid").alias("rep"), "comp"), "rep", "left").select("a", "b", "n", "rep", F.coalesce("comp", "rep").alias("comp"), "copies")
    placed = every.select("uid", "n", "a", "b").distinct()
    if not counted:
        return placed.join(tops, ["a", "b", "n"], "left").select("uid", "n", F.coalesce("comp", "uid").alias("comp"))
    members = written(labels.join(classes.select(F.col("rep").alias("uid"), "copies"), "uid"), "members")
    sets = written(once(_sets(only(rows, members.select("uid")), size)).join(members, "uid"), "sets")
    tops = tops.join(_degrees(sets, percent), "rep", "left")
    links = F.coalesce("d", F.lit(0)) + F.col("copies") - 1
    return placed.join(tops, ["a", "b", "n"], "left").select("uid", "n", F.coalesce("comp", "uid").alias("comp"), F.coalesce(links, F.lit(0)).alias("links"))


def similar_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row of docs (doc_id, text).

    Documents link when 100 * shared >= percent * all their distinct shingles. component_id is the
    least doc_id reachable by links (null if the group has none but null). n_links counts the other
    documents that the document links with. Texts without words link with nothing;
    rows with equal ids are documents of their own, equal rows one.
    """
    uid, plain = uid_of(docs)
    rows = docs.select("doc_id", uid.alias("uid"), F.coalesce("text", F.lit("")).alias("text"))
    placed = grouped(rows, plain, size, percent, counted=True)
    if plain:
        return placed.select(F.col("uid").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.col("links").alias("n_links"))
    named = rows.select("doc_id", "uid").join(written(placed, "placed"), "uid")
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("links").alias("n_links"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of similar documents, that of the least doc_id; the columns of docs.

    Where ids repeat or are null, the row is the one with the least hash of id and text.
    """
    uid, plain = uid_of(docs)
    placed = grouped(docs.select(uid.alias("uid"), F.coalesce("text", F.lit("")).alias("text")), plain, size, percent)
    keep = written(placed.where("uid = comp").select(F.col("uid").alias("_th_uid")), "keep")
    left = only(docs.withColumn("_th_uid", uid), keep, key="_th_uid")
    return (left if plain else left.dropDuplicates(["_th_uid"])).select(*(F.col(f"`{c}`") for c in docs.columns))
