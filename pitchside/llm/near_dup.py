"""Operator 3: grouped prefix join for n-gram Jaccard similarity.

Documents are sets of word shingles. Exact copies of a set become one class.
Shingles get one global order (frequent ones, by a sketch of all counts, last, and
long ones before short ones); a class's prefix is so many
of its rarest shingles that two classes over the threshold must share one.
Classes with the same prefix and size form a group; groups that share a prefix
shingle are filtered as pairs by size and position, the pairs that remain are
expanded to their members, filtered by parity bitmaps (a lower bound of the
symmetric difference, so nothing is lost) and verified on the whole sets. Short
posting lists give their group pairs as they come out of the shuffle; long ones
are dealt into blocks of members that meet pairwise.

Postings are keyed by shingle and size class, a factor 1/t wide: sets that link
are in one class or in neighbouring ones. The smaller set of a pair needs only
its shorter indexing prefix, so it is posted under its own and the next class
with that, and the larger one under its own class with its whole prefix.

Links are needed up to connectivity. A first pass verifies all pairs of short
lists and one spanning forest per block of long ones; the second verifies every
remaining pair of long lists whose classes are still in different components. So no group of copies is expanded into all its
pairs, and no link between different texts is lost.

Edge cases: a null or blank text has an empty set, links with nothing and is its
own component; repeated rows and copies share a class; ``component_id`` is the
smallest id in the component (a null id counts only if there is no other);
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchside.llm.common import U64, Words, components, flat_bytes, importable, mix, slices, unused, written

#: log2 of the slots of the frequency sketch, and the most slots the driver gathers (12 bytes each).
SKETCH_BITS, SKETCH_KEPT = 22, 1 << 18
#: Most members of a posting list that gives its pairs of groups at once; members compared in one block of a longer
#: list, which is cut into blocks that meet pairwise.
SHORT, BLOCK = 8, 1024
#: Rows of a posting list from which it leaves its task in parts.
CUT = 100_000
#: Most rows (id and digest, some 50 bytes) of the list of texts to verify that are broadcast; a longer list is shuffled.
BROADCAST_ROWS = 200_000


def _heavy_slots(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the frequency sketch that stand out, and their levels (log2 of the count).

    Only the order of shingles follows from it, never which pairs are found, so a bounded number of slots suffices.
    """
    def count(batches):
        sums = np.zeros(1 << SKETCH_BITS, np.int32)
        for b in slices(batches):
            h, _ = Words(*flat_bytes(b.column(0))).shingles(k)
            slot, n = np.unique((h >> U64(64 - SKETCH_BITS)).astype(np.int64), return_counts=True)
            sums[slot] += n
        at = np.flatnonzero(sums >= 4 * sums.mean() + 4)
        for s in range(0, len(at), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[s:s + 50_000]), pa.array(sums[at[s:s + 50_000]].astype(np.int64))], names=["slot", "n"])

    part = docs.select("text").mapInArrow(count, "slot long, n long")
    top = part.groupBy("slot").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "slot").limit(SKETCH_KEPT).toPandas()
    level = np.minimum(np.log2(np.maximum(top["n"].to_numpy(np.float64), 1)), 62).astype(np.int8)
    return top["slot"].to_numpy(np.int64), level


def _tokens(words: Words, k: int, levels: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Shingles as int64 whose natural order is the global order: level first, then long ones first (they are
    rarer), then 52 bits of the hash."""
    h, off = words.shingles(k)
    t = (h & U64((1 << 52) - 1)).astype(np.int64)
    t |= (31 - np.minimum(words.shingle_bytes(k) // 2, 31)) << 52
    if levels is not None:
        t |= levels[(h >> U64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.int64) << 57
    return t, off


def _prefix_len(n: int, num: int, den: int) -> int:
    """n - ceil(t n) + 1 for the threshold t = num / den."""
    return n - -(-num * n // den) + 1


def _index_len(n, num: int, den: int):
    """n - ceil(2t / (1 + t) n) + 1: the prefix of the smaller set of a pair."""
    return n + 1 + (-2 * num * n // (num + den))


def _size_class(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Classes such that den * small >= num * large implies classes that differ by one at most.

    Bounds grow by whole numbers: a class from lo holds sizes up to floor(lo * den / num), or lo alone."""
    bounds, lo, top = [], 1, int(n.max(initial=1))
    while lo <= top:
        bounds.append(lo)
        lo = lo * den // num + 1
    return np.searchsorted(np.array(bounds), n, side="right")


def _bitmap(tokens: np.ndarray) -> bytes:
    """Parity bitmap of max(64, 2^ceil(log2 n)) bits: XOR of two has at most as many bits as the sets differ in."""
    bits = max(64, 1 << (len(tokens) - 1).bit_length())
    odd = np.bincount(tokens & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _level_table(bc) -> np.ndarray:
    levels = np.zeros(1 << SKETCH_BITS, np.int8)
    slot, level = bc.value
    levels[slot] = level
    return levels


def _signatures(docs: DataFrame, bc, k: int, num: int, den: int) -> DataFrame:
    """Per row: id, shingles n, digest of the set, group (prefix and size), prefix, bitmap; for empty sets nulls."""
    def run(batches):
        levels = _level_table(bc)
        for b in slices(batches, "text"):
            t, off = _tokens(Words(*flat_bytes(b.column(b.schema.get_field_index("text")))), k, levels)
            n, digest, gid, prefix, bitmap = [], [], [], [], []
            for i in range(len(off) - 1):
                s = np.unique(t[off[i]:off[i + 1]])
                n.append(len(s))
                if not len(s):
                    for x in (digest, gid, prefix, bitmap):
                        x.append(None)
                    continue
                p = s[:_prefix_len(len(s), num, den)]
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                gid.append(xxhash.xxh3_128_digest(p.tobytes() + len(s).to_bytes(8, "little")))
                prefix.append(p)
                bitmap.append(_bitmap(s))
            yield pa.RecordBatch.from_arrays([
                b.column(b.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                pa.array(gid, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bitmap, pa.binary())],
                names=["doc_id", "n", "digest", "gid", "prefix", "bitmap"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n long, digest binary, gid binary, prefix array<long>, bitmap binary")


def _posted(groups: DataFrame, num: int, den: int) -> DataFrame:
    """Postings of groups (g, n, m, prefix) whose list may hold a pair, or is over CUT rows long: key, g, n, pos, up (posted
    from the class below), m."""
    most = CUT

    def post(batches):
        for b in batches:
            if not b.num_rows:
                continue
            g, n, m = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()
            token = b.column(3).flatten().to_numpy()
            length = np.asarray(pc.list_value_length(b.column(3)), np.int64)
            row = np.repeat(np.arange(len(g)), length)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
            level = _size_class(n, num, den).astype(np.uint64)
            short = np.flatnonzero(pos < _index_len(n, num, den)[row])
            at = np.concatenate([np.arange(len(row)), short])
            up = np.concatenate([np.zeros(len(row), np.int8), np.ones(len(short), np.int8)])
            key = mix(token[at].astype(np.uint64) + (level[row[at]] + up.astype(np.uint64)) * U64(0x9E3779B97F4A7C15))
            for s in range(0, len(at), 200_000):
                i = at[s:s + 200_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array(key[s:s + 200_000].view(np.int64)), pa.array(g[row[i]]), pa.array(n[row[i]].astype(np.int32)),
                    pa.array(pos[i].astype(np.int32)), pa.array(up[s:s + 200_000]), pa.array(m[row[i]].astype(np.int32))],
                    names=["key", "g", "n", "pos", "up", "m"])

    def matched(batches):
        held: list[pa.RecordBatch] = []
        cut = None  # key of a list that was too long to be held whole

        def lists(final: bool):
            """Pairs of groups of the held short lists, rows of the long ones; the last list stays held unless final or long."""
            nonlocal held, cut
            t = pa.Table.from_batches(held).combine_chunks()
            key = t["key"].to_numpy()
            start = np.r_[0, np.flatnonzero(np.diff(key)) + 1]
            stop = np.r_[start[1:], len(key)]
            longer = len(key) - start[-1] > most
            whole = len(start) if final or longer else len(start) - 1
            held = t.slice(int(start[whole])).to_batches() if whole < len(start) else []
            if not whole:
                return
            t, key, start, stop = t.slice(0, int(stop[whole - 1])), key[:stop[whole - 1]], start[:whole], stop[:whole]
            g, m, own = t["g"].to_numpy(), t["m"].to_numpy().astype(np.int64), t["up"].to_numpy() == 0
            n, pos = t["n"].to_numpy().astype(np.int64), t["pos"].to_numpy().astype(np.int64)
            long = np.add.reduceat(m, start) > SHORT
            part = np.zeros(len(start), bool)  # only a part of its list
            part[0] = key[0] == cut
            part[-1] |= longer and not final
            long |= part
            cut = key[-1] if longer and not final else cut
            which = np.repeat(np.arange(len(start)), stop - start)
            in_short = ~long[which]
            small = pos < _index_len(n, num, den)
            # several members of one group
            own_pair = np.flatnonzero(in_short & (m > 1) & own & (pos == 0))
            one, two = [own_pair], [own_pair]
            size = int((stop - start)[~long].max(initial=0))
            for d in range(1, size):
                i = np.flatnonzero(in_short[:-d] & (which[:-d] == which[d:]))
                j = i + d
                ok = (small[i] & (n[i] <= n[j]) & own[j]) | (own[i] & small[j] & (n[j] <= n[i]))
                total = n[i] + n[j]
                need = -(-num * total // (num + den))
                ok &= (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need) & (den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j])) & (g[i] != g[j])
                one.append(i[ok])
                two.append(j[ok])
            one, two = np.concatenate(one), np.concatenate(two)
            if len(one):
                pairs = np.unique(np.stack([np.minimum(g[one], g[two]), np.maximum(g[one], g[two])]), axis=1)
                zero = np.zeros(pairs.shape[1], np.int32)
                yield pa.RecordBatch.from_arrays([*map(pa.array, pairs), pa.array(zero), pa.array(zero), pa.array(zero.astype(np.int8)), pa.array(zero)], names=names)
            # a long list has a pair only with a smaller set and one of its own class; parts cannot tell
            alive = part | long & (np.add.reduceat(small.astype(np.int64), start) > 0) & (np.add.reduceat(own.astype(np.int64), start) > 0)
            yield from t.filter(pa.array(alive[which])).combine_chunks().to_batches()

        for b in batches:
            if b.num_rows:
                held.append(b)
                if sum(x.num_rows for x in held) > most // 2:
                    yield from lists(False)
        if held:
            yield from lists(True)

    names = ["key", "g", "n", "pos", "up", "m"]
    schema = "key long, g long, n int, pos int, up byte, m int"
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return groups.select("g", "n", "m", "prefix").mapInArrow(post, schema).repartition(parts, "key").sortWithinPartitions("key").mapInArrow(matched, schema)


def _members_of_pairs(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of classes, by digest, of the pairs of groups (a, b) that pass the bitmap filter."""
    def run(batches):
        for b in batches:
            x, y = (flat_bytes(b.column(i)) for i in (4, 5))
            total = (b.column(2).to_numpy() + b.column(3).to_numpy()).astype(np.int64)
            most = total - 2 * -(-num * total // (num + den))
            ok = np.zeros(b.num_rows, bool)
            wx, wy = np.diff(x[1]) // 8, np.diff(y[1]) // 8
            words = [np.ascontiguousarray(z[0]).view(np.uint64) for z in (x, y)]
            for p, r in {*zip(wx.tolist(), wy.tolist())}:
                for at in np.array_split(i := np.flatnonzero((wx == p) & (wy == r)), 1 + len(i) * (p + r) // (1 << 20)):
                    u = words[0][x[1][at][:, None] // 8 + np.arange(p)]
                    v = words[1][y[1][at][:, None] // 8 + np.arange(r)]
                    w = min(p, r)
                    ok[at] = np.bitwise_count(_fold(u, w) ^ _fold(v, w)).sum(axis=1, dtype=np.int64) <= most[at]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok))

    one = classes.select(F.col("g").alias("a"), F.col("digest").alias("da"), F.col("n").alias("na"), F.col("bitmap").alias("ba"))
    two = classes.select(F.col("g").alias("b"), F.col("digest").alias("db"), F.col("n").alias("nb"), F.col("bitmap").alias("bb"))
    both = pairs.join(one, "a").join(two, "b").where("a <> b AND da <> db OR a = b AND da < db")
    return both.select("da", "db", "na", "nb", "ba", "bb").mapInArrow(run, "a binary, b binary").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


class _Members:
    """Members of a posting list: sizes, positions, roles, and bitmaps as one matrix per width."""

    def __init__(self, t: pa.Table, at: np.ndarray, num: int, den: int):
        self.at = at
        self.n = t["n"].to_numpy().astype(np.int64)[at]
        self.pos = t["pos"].to_numpy().astype(np.int64)[at]
        self.own = t["up"].to_numpy()[at] == 0
        self.small = self.pos < _index_len(self.n, num, den)
        bits = t["bitmap"].combine_chunks() if isinstance(t["bitmap"], pa.ChunkedArray) else t["bitmap"]
        raw, off = flat_bytes(bits)
        words = raw.view(np.uint64) if raw.flags.c_contiguous else np.ascontiguousarray(raw).view(np.uint64)
        off = off // 8
        width = np.diff(off)[at]
        self.place = np.zeros(len(at), np.int64)  # row in the matrix of its width
        self.width, self.rows, self.matrix = width, {}, {}
        for w in np.unique(width).tolist():
            r = np.flatnonzero(width == w)
            self.rows[w] = r
            self.place[r] = np.arange(len(r))
            self.matrix[w] = words[off[at[r]][:, None] + np.arange(w)]


def _fold(v: np.ndarray, width: int) -> np.ndarray:
    while v.shape[-1] > width:
        half = v.shape[-1] // 2
        v = v[..., :half] ^ v[..., half:]
    return v


def _passing(a: _Members, b: _Members, num: int, den: int, same: bool):
    """(i, js): members of ``a`` and ``b`` that pass the filters: first the pairs of groups by role, size and position,
    then the members by bitmap."""
    for i in range(len(a.n)):
        n, ok = b.n, (a.small[i] & (a.n[i] <= b.n) & b.own) | (a.own[i] & b.small & (b.n <= a.n[i]))
        if same:
            ok[:i + 1] = False
        total = n + a.n[i]
        need = -(-num * total // (num + den))  # least intersection
        ok &= (np.minimum(a.n[i] - a.pos[i], n - b.pos) >= need) & (den * np.minimum(n, a.n[i]) >= num * np.maximum(n, a.n[i]))
        if not ok.any():
            continue
        mine, got = a.matrix[int(a.width[i])][a.place[i]], []
        for w, rows in b.rows.items():
            at = rows[ok[rows]]
            if len(at):
                narrow = min(w, len(mine))
                differ = np.bitwise_count(_fold(b.matrix[w][b.place[at]], narrow) ^ _fold(mine, narrow)).sum(axis=1, dtype=np.int64)
                got.append(at[differ <= total[at] - 2 * need[at]])
        js = np.concatenate(got) if got else []
        if len(js):
            yield i, js


def _pairs_of_block(t: pa.Table, num: int, den: int, forest: bool) -> list:
    """Candidate pairs of one block of one posting list. side 0: within; 1 and 2: the two sides of a pair of blocks.
    forest: only a spanning forest of them, else only those across components."""
    side, root, digest = t["side"].to_numpy(), t["root"].to_pylist(), t["digest"].to_pylist()
    same = bool((side == 0).any())
    one = _Members(t, np.flatnonzero(side == (0 if same else 1)), num, den)
    two = one if same else _Members(t, np.flatnonzero(side == 2), num, den)
    out, parent = [], list(range(len(digest)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, js in _passing(one, two, num, den, same):
        a = int(one.at[i])
        for b in two.at[js].tolist():
            if digest[a] == digest[b] or root[a] is not None and root[a] == root[b]:
                continue
            if forest:
                x, y = top(a), top(b)
                if x == y:
                    continue
                parent[max(x, y)] = min(x, y)
            out.append((digest[a], digest[b]) if digest[a] < digest[b] else (digest[b], digest[a]))
    return out


def _candidates(lists: DataFrame, num: int, den: int, forest: bool) -> DataFrame:
    """Distinct candidate pairs (a, b) of class digests. ``lists``: key, df, digest, n, pos, up, bitmap, root.

    A list of up to BLOCK members is one block. A longer one is dealt by digest into so many blocks that
    each has about BLOCK members, and every pair of blocks meets in a task of its own."""
    def run(key, t):
        got = _pairs_of_block(t, num, den, forest)
        return pa.table({"a": pa.array([x for x, _ in got], pa.binary()), "b": pa.array([y for _, y in got], pa.binary())})

    cols = ["key", "digest", "n", "pos", "up", "bitmap", "root"]
    dealt = lists.withColumn("k", F.ceil(F.col("df") / BLOCK).cast("int")).withColumn("s", F.pmod(F.xxhash64("digest"), "k").cast("int"))
    dealt = dealt.select(*cols, "s", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o"))
    dealt = dealt.select(*cols, F.least("s", "o").alias("s1"), F.greatest("s", "o").alias("s2"),
                         F.expr("CASE WHEN s = o THEN 0 WHEN s < o THEN 1 ELSE 2 END").alias("side"))
    return dealt.groupBy("key", "s1", "s2").applyInArrow(run, "a binary, b binary").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, bc, k: int, num: int, den: int) -> DataFrame:
    """Those pairs whose whole sets link. Sets are made anew from the texts of the classes in question."""
    need = pairs.select(F.col("a").alias("digest")).unionAll(pairs.select("b")).distinct()
    need = written(need.join(classes.select("digest", "rep"), "digest"), "op3-need")
    n_need = need.count()
    rep = F.broadcast(need) if n_need <= BROADCAST_ROWS else need
    texts = docs.select("doc_id", "text").join(rep, F.col("doc_id").eqNullSafe(F.col("rep"))).select("digest", "text")

    def sets(batches):
        levels = _level_table(bc)
        for b in slices(batches, "text"):
            want = b.column(0).to_pylist()
            t, off = _tokens(Words(*flat_bytes(b.column(1))), k, levels)
            got = []
            for i, d in enumerate(want):
                s = np.unique(t[off[i]:off[i + 1]])
                if xxhash.xxh3_128_digest(s.tobytes()) == d:
                    got.append((d, s))
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in got], pa.binary()), pa.array([s.tobytes() for _, s in got], pa.binary())], names=["digest", "tokens"])

    have = written(texts.mapInArrow(sets, "digest binary, tokens binary").dropDuplicates(["digest"]), "op3-sets")
    both = (pairs.join(have.select(F.col("digest").alias("a"), F.col("tokens").alias("ta")), "a")
            .join(have.select(F.col("digest").alias("b"), F.col("tokens").alias("tb")), "b"))

    def check(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                both_ = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * both_ >= num * (len(x) + len(y) - both_))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(check, "a binary, b binary")


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, class_id (hex digest
    of the set, null for the empty set), where two documents link if den * |intersection| >= num * |union|
    of their sets of k-word shingles."""
    return _labelled(docs, k, num, den)[0].drop("_root")


def _labelled(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame, object]:
    """The result of ``jaccard_components`` with the class that stands for the component (_root), the classes, and the
    broadcast order of shingles."""
    spark = importable(docs.sparkSession)
    bc = spark.sparkContext.broadcast(_heavy_slots(docs, k))
    sig = written(_signatures(docs, bc, k, num, den), "op3-signatures")
    full = sig.where("digest IS NOT NULL")
    # exact copies: one row per class
    low = full.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    classes = written(full.select("digest", "n", "gid", "prefix", "bitmap").dropDuplicates(["digest"]).join(low, "digest"), "op3-classes")
    # groups of classes with one prefix and size, posted under the shingles of the prefix. g is a short name of a group:
    # should two groups share it, their members are only compared more often
    classes = classes.withColumn("g", F.xxhash64("gid"))
    groups = classes.groupBy("gid").agg(F.first("g").alias("g"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.count("*").cast("int").alias("m"))
    posted = written(_posted(groups, num, den), "op3-postings")
    short = posted.where("m = 0").select(F.col("key").alias("a"), F.col("g").alias("b")).distinct()
    long = posted.where("m > 0")
    # lists that came in parts are judged here: a smaller set and one of the list's own class
    small = f"pos < n + 1 - (2 * {num} * cast(n AS long) + {num + den - 1}) div {num + den}"
    sizes = long.groupBy("key").agg(F.sum("m").alias("df"), F.bool_or(F.expr(small)).alias("small"), F.bool_or(F.expr("up = 0")).alias("own"))
    sizes = sizes.where("small AND own").select("key", "df")

    def lists(of: DataFrame, members: DataFrame) -> DataFrame:
        return of.select("key", "g", "pos", "up").join(sizes, "key").join(members.select("g", "digest", "n", "bitmap", "root"), "g")

    alone = classes.withColumn("root", F.lit(None).cast("binary"))
    first = _members_of_pairs(short, classes, num, den).unionAll(_candidates(lists(long, alone), num, den, True)).distinct()
    first = written(first, "op3-pairs")
    links = written(_verified(first, docs, classes, bc, k, num, den), "op3-links")
    comp = components(links, "op3-components")
    # second pass: long lists that still hold two components
    named = classes.join(comp.select(F.col("node").alias("digest"), "root"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    mixed = long.select("key", "g").join(named.select("g", "root"), "g").groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    more = _candidates(lists(long.join(mixed.where("lo <> hi").select("key"), "key"), named), num, den, False)
    more = written(more.join(first, ["a", "b"], "left_anti"), "op3-pairs")
    if not more.isEmpty():
        links = links.unionAll(written(_verified(more, docs, classes, bc, k, num, den), "op3-links"))
        comp = components(links, "op3-components")

    ids = classes.select("digest", "rep").join(comp.select(F.col("node").alias("digest"), "root"), "digest", "left")
    ids = ids.withColumn("root", F.coalesce("root", "digest"))
    ids = ids.join(ids.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("digest", "component_id", F.col("root").alias("_root"))
    got = (sig.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(ids, "digest", "left")
            .select("doc_id", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                    F.hex("digest").alias("class_id"), "_root"))
    return got, classes, bc


def keep_one_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of their component; a repeated row (same id and
    text) stays once. Documents with an empty set all stay. Ids are taken to name one text each; a document
    without id stays only if no other of its component has one, and then one text of the component."""
    got, classes, bc = _labelled(docs.select("doc_id", "text"), k, num, den)
    keep = got.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).where("doc_id IS NOT NULL OR n_shingles = 0")
    ident, is_blank, text = (unused(x, docs) for x in ("_id", "_blank", "_text"))
    keep = keep.select(F.col("doc_id").alias(ident), (F.col("n_shingles") == 0).alias(is_blank)).distinct()
    blank = F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    kept = docs.join(keep, F.col("doc_id").eqNullSafe(F.col(ident)) & (blank == F.col(is_blank)), "left_semi")
    if not classes.where("rep IS NULL").isEmpty():
        # components without ids: the smallest text of the smallest class of each
        without = got.where("doc_id IS NULL AND component_id IS NULL AND n_shingles > 0").groupBy("_root").agg(F.min("class_id").alias("_class"))
        texts = docs.where("doc_id IS NULL").select(F.col("text").alias("doc_id"), "text").distinct()
        texts = _signatures(texts, bc, k, num, den).select(F.col("doc_id").alias("_text"), F.hex("digest").alias("_class"))
        texts = written(texts.join(without, "_class").groupBy("_class").agg(F.min("_text").alias(text)).select(text), "op3-no-ids")
        kept = kept.unionAll(docs.where("doc_id IS NULL").join(texts, F.col("text") == F.col(text), "left_semi"))
    return kept.dropDuplicates(["doc_id", "text"])
