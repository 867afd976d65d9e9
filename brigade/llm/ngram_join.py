"""Operator 7: n-gram Jaccard self-join as a blocked sparse product of documents and shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .shared import byte_batches, documents, numbered, stash, tagged
from .words import mix, shingles, word_hashes

#: So many of the most frequent shingles (by a count over one document in SHARE) come last in the order of shingles.
FREQUENT, SHARE = 1 << 20, 16


def _sets(col: pa.Array, k: int):
    """(distinct shingle hashes row by row, bounds): in a row they ascend."""
    h, row = shingles(*word_hashes(col), k)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
        h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(col) + 1))


def _set_hashes(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each whole set and its size."""
    part = mix(h * np.uint64(0x9E3779B97F4A7C15))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)])
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64))


def _least(n, most: int = 16):
    """So many leading shingles a set of size ``n`` must have in common with a partner of its size or more."""
    return np.clip(1 + n // 25, 1, most)


def _least_column(n):
    """The same as a column expression."""
    return F.least(F.lit(16), 1 + F.floor(n / 25)).cast("int")


def _fewest(n: str, num: int, den: int):
    """So many leading shingles a set of size ``n`` must have in common with any partner, smaller ones too."""
    return _least_column(F.ceil(F.col(n) * num / den))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _frequent(docs: DataFrame, k: int):
    """Sorted hashes and counts of the most frequent shingles of one document in SHARE.

    They only order the shingles, rare before frequent; any order gives the same links.
    """

    def count(batches):
        for whole in batches:
            for b in byte_batches(whole, most=1 << 20):
                h, _ = _sets(b.column(1), k)
                u, c = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(u)), pa.array(c.astype(np.int64))], names=["s", "c"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SHARE)) == 0).mapInArrow(count, "s long, c long")
    top = some.groupBy("s").agg(F.sum("c").alias("c")).where("c > 1").orderBy(F.desc("c"), "s").limit(FREQUENT).toArrow()
    s = top.column("s").to_numpy().view(np.uint64)
    order = np.argsort(s)
    return s[order], top.column("c").to_numpy()[order]


def _incidence(docs: DataFrame, k: int, num: int, den: int, frequent, most: int) -> DataFrame:
    """Rows (kind, a, b, n): kind 0 a document (its number, its set's hash, the set's size; kind 3
    where it has no number), kind 1
    an entry of the incidence matrix (shingle, set's hash, size), with the part p of its column that
    it is dealt to where that is likely to have more than ``most`` sets (else -1). Documents are dealt by their sets' hashes.

    Only a set's first n - ceil(t n) + l shingles in the common order are needed: sets that overlap
    enough share l of those, l = _least(n). Copies of a set within a task give its entries once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        top, counts = shared.value
        seen: set[int] = set()
        for whole in batches:
            for b in byte_batches(whole, most=1 << 20):
                h, bounds = _sets(b.column(1), k)
                n, sig = np.diff(bounds), _set_hashes(h, bounds)
                row = np.repeat(np.arange(len(n)), n)
                kind = np.where(b.column(0).is_null().to_numpy(zero_copy_only=False), 3, 0).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(kind), b.column(0).fill_null(0), pa.array(_signed(sig)), pa.array(n.astype(np.int32)), pa.array((sig & np.uint64(0xFFFF)).astype(np.int32))], names=["kind", "a", "b", "n", "p"])
                fresh = np.zeros(len(n), bool)
                for i, (x, m) in enumerate(zip(sig.tolist(), n.tolist())):
                    if m and x not in seen:
                        fresh[i] = True
                        if len(seen) < 1 << 20:
                            seen.add(x)
                keep = fresh[row]
                h, row = h[keep], row[keep]
                if not len(h):
                    continue
                rank = np.zeros(len(h), np.int64)
                if len(top):
                    at = np.minimum(np.searchsorted(top, h), len(top) - 1)
                    rank = np.where(top[at] == h, counts[at], 0)
                order = np.lexsort((h, rank, row))
                h, row, rank = h[order], row[order], rank[order]
                first = np.searchsorted(row, row)
                need = n + (num * n // -den) + _least(n)  # n - ceil(t n) + l
                lead = np.arange(len(h)) - first < need[row]
                h, row, rank = h[lead], row[lead], rank[lead]
                parts = rank * SHARE // most
                part = np.where(parts > 0, (sig[row] >> np.uint64(16)) % (parts + 1).astype(np.uint64), 0).astype(np.int32) - (parts == 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(h), np.int8)), pa.array(_signed(h)), pa.array(_signed(sig[row])), pa.array(n[row].astype(np.int32)), pa.array(part.astype(np.int32))], names=["kind", "a", "b", "n", "p"])

    return docs.mapInArrow(run, "kind byte, a long, b long, n int, p int")


def _runs(batches, keys: int, most: int = 1 << 18):
    """Rows in order of their first ``keys`` columns, cut between values of these where that is
    possible; a value with more rows comes whole."""
    held, size = [], 0
    for b in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        size += b.num_rows
        if size >= most:
            cols = [np.concatenate(c) for c in zip(*held)]
            cut = int(np.flatnonzero(_heads(*cols[:keys]))[-1])
            if cut:
                yield [c[:cut] for c in cols]
                cols = [c[cut:] for c in cols]
            held, size = [cols], len(cols[0])
    if size:
        yield [np.concatenate(c) for c in zip(*held)]


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any of the columns."""
    new = np.zeros(len(columns[0]), bool)
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    new[:1] = True
    return new


def _shared_columns(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Of the incidence entries only those whose shingle several sets have (kind 1), and for each
    set and column a candidate (kind 2: a, b the sets' hashes, n of the first, m of the other):
    the column's sets of the smallest and the largest hash, which near copies mostly have in common,
    if the sizes allow it. A column of many sets so gives two candidates a set, not their square.
    The parts of a frequent column are in tasks of their own and have smallest and largest sets of
    their own: candidates only say which sets to take first, links don't depend on them."""

    def work(batches):
        for a, p, b, n, kind in _runs(batches, 2):
            for k in (0, 3):
                if (doc := kind == k).any():
                    yield _rows(k, a[doc], b[doc], n[doc], np.zeros(int(doc.sum()), np.int32))
            doc = kind != 1
            a, p, b, n = a[~doc], p[~doc], b[~doc], n[~doc]
            if not len(a):
                continue
            new = _heads(a, p, b)
            a, p, b, n = a[new], p[new], b[new], n[new]
            first = np.flatnonzero(_heads(a, p))
            size = np.diff(np.append(first, len(a)))
            many = np.repeat(size > 1, size) | (p >= 0)  # a part's column has more sets in other parts
            a, p, b, n = a[many], p[many], b[many], n[many]
            if not len(a):
                continue
            yield _rows(1, a, b, n, np.zeros(len(a), np.int32))
            head = np.flatnonzero(_heads(a, p))
            tail = np.append(head[1:], len(a)) - 1
            for ends in (head, tail):
                lead = np.repeat(ends, tail - head + 1)
                x, y = n[lead].astype(np.int64), n.astype(np.int64)
                pair = (lead != np.arange(len(a))) & (den * np.minimum(x, y) >= num * np.maximum(x, y))
                yield _rows(2, b[lead[pair]], b[pair], n[lead[pair]], n[pair])

    keyed = rows.select("a", "p", "b", "n", "kind").repartition("a", "p").sortWithinPartitions("a", "p", "kind", "b")
    return keyed.mapInArrow(work, "kind byte, a long, b long, n int, m int")


def _rows(kind, a, b, n, m):
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a), pa.array(b), pa.array(n.astype(np.int32)), pa.array(m.astype(np.int32))], names=["kind", "a", "b", "n", "m"])


def _unit_links(a: np.ndarray, bounds: np.ndarray, sig: np.ndarray, part: np.ndarray, num: int, den: int):
    """Of the sets of a unit (each of bounds' slices of ``a``) links that connect what is linked, and
    each set's number of links: overlap counts come from products of the incidence matrix, some
    thousand columns at a time. A unit of two parts has the links between them only, those within
    a part are in its own unit: each link counts once."""
    n = np.diff(bounds)
    row = np.repeat(np.arange(len(n)), n)
    order = np.argsort(a, kind="stable")
    col = np.cumsum(_heads(a[order])) - 1
    row = row[order]
    common = np.bincount(col)[col] > 1
    col, row = col[common], row[common]
    col = np.cumsum(_heads(col)) - 1 if len(col) else col
    overlap = np.zeros((len(n), len(n)), np.float32)
    step = 4096
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, step):
        i, j = np.searchsorted(col, [lo, lo + step])
        x = np.zeros((len(n), step), np.float32)
        x[row[i:j], col[i:j] - lo] = 1
        overlap += x @ x.T
    common = overlap.astype(np.int64)
    linked = den * common >= num * (n[:, None] + n[None, :] - common)
    np.fill_diagonal(linked, False)
    if part.min() != part.max():
        linked &= part[:, None] != part[None, :]
    left = np.ones(len(n), bool)
    out = []
    while left.any():  # a spanning tree of each component, breadth first
        edge = [int(np.flatnonzero(left)[0])]
        left[edge[0]] = False
        while edge:
            i = edge.pop()
            new = np.flatnonzero(linked[i] & left)
            left[new] = False
            edge += new.tolist()
            out += [(sig[i], sig[j]) for j in new]
    return out, linked.sum(1)


def _cluster_links(clusters: DataFrame, sets: DataFrame, num: int, den: int, block: int = 256, block_bytes: int = 32 << 20) -> DataFrame:
    """Rows (a, b, n) of each cluster (node, component): links that connect all that is linked
    within it, with n null, and the number n of links that a set has to others of its part or to
    those of one other, with b null.

    A cluster is cut into blocks of about ``block`` sets, or of ``block_bytes`` where its sets are
    large, and each two of its blocks are multiplied in a task of their own, so that no task holds a
    cluster and no pair becomes a row.
    """
    sized = clusters.join(sets.select(F.col("sig").alias("node"), "size"), "node")
    number = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / block_bytes))
    parts = sized.groupBy("component").agg(number.cast("int").alias("nb"))
    dealt = stash(sized.join(parts, "component").select(F.col("node").alias("sig"), "component", "nb", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int").alias("p")), "blocks")
    units = dealt.select("sig", "component", F.explode(F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda q: F.struct(F.least("p", q).alias("p"), F.greatest("p", q).alias("q")))).alias("u"), "p")

    def run(t: pa.Table) -> pa.Table:
        sig = t.column("sig").to_numpy()
        s = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("s").combine_chunks()]
        got, degree = _unit_links(np.concatenate(s), np.concatenate([[0], np.cumsum([len(x) for x in s])]), sig, t.column("p").to_numpy(), num, den)
        some = np.flatnonzero(degree)
        a, b, n = [x for x, _ in got] + sig[some].tolist(), [y for _, y in got] + [None] * len(some), [None] * len(got) + degree[some].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    return units.join(sets.select("sig", "s").hint("merge"), "sig").groupBy("component", "u").applyInArrow(run, "a long, b long, n long")


def _cross(columns: DataFrame, reps: DataFrame, clusters: DataFrame, num: int, den: int, block: int = 256, wide: int = 256) -> DataFrame:
    """Rows (a, b, n, m, c) for the pairs of a column's sets (of ``reps``) of different clusters; the sum of c
    is the number of leading columns that a pair shares. A set of no cluster is one of its own.

    Columns of a single cluster are dropped before anything is sorted: pairs wanted here share
    none of them. Of a set's remaining columns, from those of few sets to those of many, all but the
    last ``_fewest`` - 1 lead: a pair that shares enough columns shares a leading one, and a column
    of many sets leads only where a set has little else. Leading columns are multiplied,
    those of up to ``block`` sets side by side; of one of more than ``wide`` sets each two blocks of
    so many meet in a task of their own. Pairs are dropped by their sizes and where the clusters,
    which are settled, are the same.
    """
    labels = reps.select(F.col("sig").alias("node")).join(clusters.select("node", F.col("component").alias("cluster")), "node", "left")
    known = stash(columns.join(labels, columns.b == labels.node).select("a", "b", "n", F.coalesce("cluster", "node").alias("cluster")), "columns")
    mixed = stash(known.groupBy("a").agg(F.min("cluster").alias("from"), F.max("cluster").alias("to"), F.count("*").alias("sets")).where("from <> to").select("a", "sets"), "mixed")
    last = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("sets"), F.desc("a")))
    leading = stash(known.join(mixed, "a").withColumn("last", last).where(F.col("last") >= _fewest("n", num, den)).select("a", "b", "n", "cluster"), "leading")
    blocks = stash(leading.groupBy("a").agg(F.ceil(F.count("*") / wide).cast("int").alias("nb")), "blocks")
    part = F.pmod(F.xxhash64("b"), F.col("nb")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    dealt = leading.join(blocks, "a").select("a", "b", "n", "cluster", part.alias("part"), other.alias("other"))
    unit = F.col("a"), F.least("part", "other").alias("u"), F.greatest("part", "other").alias("v")
    open_ = dealt.select(*unit, "b", "n", "cluster", "part").repartition("a", "u", "v").sortWithinPartitions("a", "u", "v", "n", "b")

    def work(batches):
        for a, u, v, b, n, g, part in _runs(batches, 3):
            apart = u != v  # two blocks: pairs within either are in its own unit
            first = np.append(np.flatnonzero(_heads(a, u, v)), len(a))
            size = np.repeat(np.diff(first), np.diff(first))
            end = np.repeat(first[1:], np.diff(first))
            got = []
            small = np.flatnonzero(size <= block)
            for d in range(1, int(size[small].max()) if len(small) else 0):  # columns side by side, d rows apart
                small = small[small + d < end[small]]
                y = small + d
                ok = (g[small] != g[y]) & ~(apart[small] & (part[small] == part[y])) & (den * n[small].astype(np.int64) >= num * n[y].astype(np.int64))
                got.append((small[ok], y[ok]))
                small = small[den * n[small].astype(np.int64) >= num * n[y].astype(np.int64)]
                if sum(len(x) for x, _ in got) > 1 << 18:
                    yield from _pairs(got, b, n)
                    got = []
            for lo, hi in zip(first, first[1:]):
                for y in range(lo + 1, hi) if hi - lo > block else ():
                    start = lo + int(np.searchsorted(n[lo:hi], (num * int(n[y]) + den - 1) // den))
                    x = start + np.flatnonzero((g[start:y] != g[y]) & ~(apart[y] & (part[start:y] == part[y])))
                    got.append((x, np.full(len(x), y)))
                    if sum(len(x) for x, _ in got) > 1 << 18:
                        yield from _pairs(got, b, n)
                        got = []
            yield from _pairs(got, b, n)

    return open_.mapInArrow(work, "a long, b long, n int, m int, c long")


def _pairs(got, b, n):
    if got:
        x, y = (np.concatenate(z) for z in zip(*got))
        order = np.lexsort((b[y], b[x]))
        x, y = x[order], y[order]
        first = np.flatnonzero(_heads(b[x]) | _heads(b[y]))
        c = np.diff(np.append(first, len(x)))
        x, y = x[first], y[first]
        yield pa.RecordBatch.from_arrays([pa.array(b[x]), pa.array(b[y]), pa.array(n[x]), pa.array(n[y]), pa.array(c.astype(np.int64))], names=["a", "b", "n", "m", "c"])


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets overlap enough."""
    left, right = sets.select(F.col("sig").alias("a"), F.col("s").alias("sa")), sets.select(F.col("sig").alias("b"), F.col("s").alias("sb"))
    both = pairs.select("a", "b").join(right.hint("merge"), "b").join(left.hint("merge"), "a")

    def check(batches):
        for t in batches:
            keep = []
            for x, y in zip(t.column(2), t.column(3)):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(den * common >= num * (len(x) + len(y) - common))
            ok = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column(0).filter(ok), t.column(1).filter(ok)], names=["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")


def ngram_components(docs: DataFrame, *, text: str = "text", key: str = "doc_id", words: int = 5, threshold: tuple[int, int] = (4, 5), part: int = 4096, wide: int = 256) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, class_id, n_links), one for each input row.

    Sets of ``words``-word shingles are linked where their Jaccard similarity is at least
    ``threshold`` (a fraction); component_id is the smallest key reachable by links. class_id is the
    smallest key with the very same set, and n_links how many other classes a class is linked to, all
    of them counted.

    Documents with one set are one row of the matrix. The product document by shingle is taken
    column by column. First every set of a column meets only those of the smallest and the
    largest hash; overlaps are counted, and each set keeps its best candidates. Sets joined by candidates that have much in
    common form clusters, whose part of the product is taken block by block with whole sets. Then only columns
    that hold several clusters are multiplied out between those, where they lead, overlaps are counted
    again, pairs below the bound are discarded, and the rest compared one by one. No pair within the bounds is left out.
    A column of more than about ``part`` sets is dealt to several tasks, and one of more than ``wide``
    is multiplied out block by block, so that no task holds a frequent column.

    Null or empty texts, and those of white space, have no shingles and stay alone. Repeated rows
    share a component; a set that only rows of null keys have is linked to no other, and a null key
    names no component but theirs. Extra columns are ignored; an empty table gives an empty result.
    """
    num, den = threshold
    own = tagged(docs, text, key)
    rows = _incidence(own, words, num, den, _frequent(own, words), part)
    made = stash(_shared_columns(rows, num, den), "columns", by="kind")
    members = made.where("kind in (0, 3)").select(F.when(F.col("kind") == 0, F.col("a")).alias("doc_id"), F.col("b").alias("sig"), "n")
    columns = made.where("kind = 1").select("a", "b", "n")
    counted = made.where("kind = 2").groupBy("a", "b", "n", "m").count()
    best = counted.groupBy("b", (F.col("a") < F.col("b")).alias("low")).agg(F.max(F.struct("count", "a", "n", "m")).alias("x")).select("b", "x.a", "x.count", F.greatest("x.n", "x.m").alias("n"))
    best = stash(best, "candidates")
    # an eighth of the leading shingles in common, 3 at least: likely of one family, kept together as a cluster
    close = F.col("count") >= F.greatest(F.lit(3), (F.col("n") * (den - num) / den + _least_column(F.col("n"))) / 8)
    clusters = stash(components(best.where(close), "a", "b"), "clusters")
    classes = members.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"))
    # who has too few shingles in common with all others together has no partner
    wanted = columns.groupBy(F.col("b").alias("sig"), "n").count().where(F.col("count") >= _fewest("n", num, den)).select("sig")
    reps = stash(classes.join(wanted, "sig", "left_semi"), "representatives")

    def whole(batches):
        for w in batches:
            for b in byte_batches(w, most=1 << 20):
                h, bounds = _sets(b.column(1), words)
                same = pa.array(_signed(_set_hashes(h, bounds)) == b.column(2).to_numpy())  # a repeated key may have another text
                s = pa.array([h[i:j].tobytes() for i, j in zip(bounds, bounds[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(2).filter(same), s.filter(same), pa.array(np.diff(bounds) * 8, pa.int64()).filter(same)], names=["sig", "s", "size"])

    # sort-merge joins wherever texts or sets are joined: one plan for every size
    texts = own.join(reps.hint("merge"), "doc_id").select("doc_id", "text", "sig")
    sets = stash(texts.mapInArrow(whole, "sig long, s binary, size long"), "sets")
    inside = stash(_cluster_links(clusters, sets, num, den), "links")
    # behind its leading columns a set has at most _fewest - 1 more in common with a partner
    behind = F.greatest(_fewest("n", num, den), _fewest("m", num, den)) - 1
    enough = F.col("count") + behind >= F.least(_least_column(F.col("n")), _least_column(F.col("m")))
    crossed = stash(_cross(columns, reps, clusters, num, den, wide=wide).groupBy("a", "b", "n", "m").agg(F.sum("c").alias("count")).where(enough), "candidates")
    links = stash(_verified(crossed, sets, num, den), "links")
    named = reps.select(F.col("sig").alias("a"), F.col("sig").alias("b"))
    labels = stash(components(inside.where("n is null").select("a", "b").unionByName(links).unionByName(named), "a", "b"), "labels")
    each = inside.where("n is not null").select(F.col("a").alias("sig"), "n").union(links.select("a", F.lit(1))).union(links.select("b", F.lit(1)))
    degree = each.groupBy("sig").agg(F.sum("n").alias("n_links"))
    firsts = labels.withColumnRenamed("node", "sig").join(classes, "sig", "right").select("sig", "doc_id", F.coalesce("component", "sig").alias("component"))
    firsts = stash(firsts, "classes")
    lowest = stash(firsts.groupBy("component").agg(F.min("doc_id").alias("component_id")), "lowest")
    known = stash(firsts.join(lowest, "component").join(degree, "sig", "left").select("sig", F.col("doc_id").alias("class_id"), "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "known")
    none = members.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    some = members.where("n > 0").join(known, "sig").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "class_id", F.col("n_links").cast("long").alias("n_links"))
    return some.unionByName(none)


def drop_near_copies(docs: DataFrame, *, text: str = "text", key: str = "doc_id", words: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """The rows of ``docs``, with all their columns, one of each component of linked texts: the one of
    the smallest key, a null key after all others, and of several such the first row.

    Rows go, not keys: other rows of a dropped row's key stay. Texts without words are linked to
    nothing and all stay. An empty table gives an empty result.
    """
    rows, row = numbered(docs)
    parts = ngram_components(rows, text=text, key=row, words=words, threshold=threshold).select(F.col("doc_id").alias(row), "component_id")
    keys = rows.select(row, F.col(f"`{key}`").alias("key"))
    named = stash(parts.join(keys, row), "named-rows")
    best = named.groupBy("component_id").agg(F.count("*").alias("n"), F.min(F.struct(F.col("key").isNull().alias("last"), "key", row)).alias("best")).where("n > 1")
    best = stash(best, "best-rows")  # a join of two tables, whose large partitions Spark can split
    gone = stash(named.join(best, "component_id").where(F.col(row) != F.col(f"best.{row}")).select(row), "dropped-rows")
    return rows.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(documents(spark, sf_dir), words=4, threshold=(85, 100))
