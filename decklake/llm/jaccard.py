"""N-gram Jaccard join over a token-group matrix.

Documents are sets of hashed word shingles; equal sets form a class. Two classes can only be linked if the smaller one
has at least 2t/(1+t) of its tokens in common with the other, and the larger one t of its tokens.

1. Tokens are dealt by hash range; a range's task finds the tokens that two classes or more hold. This is the matrix of
   tokens against everything else: a class whose shared tokens fall short of the bound is in no link and drops out.
2. The remaining classes order their shared tokens rarest first. Each is compared with a leader, up to STARS times, and what
   is linked that way forms groups of similar classes; a large group of near copies costs a comparison a member and round,
   not one a pair.
3. For each group the union of its tokens is stored. A query class is held against the groups of others with which it
   shares a prefix token: overlap with the union bounds the overlap with any member. Only groups that reach the bound
   are opened, and only members with a common prefix token that leaves room for enough others are verified, on all their shared tokens.

Components of all verified links come from star rounds. Nothing is capped, and nothing but counts reaches the driver.

Memory: a task of step 1 holds the tokens of one hash range, in all about 16 bytes times the tokens of the corpus over
spark.sql.shuffle.partitions. Copies are dropped where they are read and again per range, so a class with a third of
all rows weighs as one. Classes have 64-bit names.

Edge cases: null or wordless texts have no tokens, size 0, and are linked with nothing, not even each other; texts
under K words are one token; null ids are kept (a class of null ids only has a null component); repeated rows get a
row each; an empty table gives no rows; only id and text are read; texts of any length are hashed whole, by themselves if they are very long. deduplicated() keeps one row of each component, whatever
ids its rows have: that with the least id, null ids last, of those that with the least hash, of equal rows any one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, shuffle_partitions, stored, text_of
from .components import components
from .shingles import lists, shingle_sets, word_hashes

#: Words in a shingle, and the link's condition 100 * intersection >= PERCENT * union.
K = 5
PERCENT = 75
#: Rounds of comparing classes with leaders, at most; a round that links nothing is the last.
STARS = 3
#: Tokens of a group's union that are kept as one array.
UNION = 65_536
_COLS = ["kind", "part", "class", "id", "n", "tokens", "extra", "row"]
_SCHEMA = "kind int, part int, class long, id long, n int, tokens binary, extra binary, row long"
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]
MEMBER, TOKENS = 0, 1


def least_of_larger(n: int, percent: int) -> int:
    """Tokens that a class of n has in common with a partner of at most n."""
    return -(-percent * n // 100)


def least_of_smaller(n: int, percent: int) -> int:
    """The same with a partner of at least n."""
    return -(-2 * percent * n // (100 + percent))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_COLS)


def _planes(tokens: np.ndarray) -> bytes:
    """Sorted tokens byte by byte, the like high bytes together: they compress in the shuffle."""
    return tokens.view(np.uint8).reshape(-1, 8).T.tobytes()


def _tokens(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()


def _dealt(parts: int, k: int):
    """Documents to member rows, and to one row of tokens for each batch and hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        seen: set[int] = set()
        for whole in batches:
            for a, b in lists([len(t) for t in whole.column(1).to_pylist()], 256):
                batch = whole.slice(a, b - a)
                ids, marks = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                sets = shingle_sets(*word_hashes([t.encode("utf-8", "surrogatepass").lower() for t in batch.column(1).to_pylist()]), k)
                rows, fresh, names, sizes = [], [], [], []
                for i, mark, s in zip(ids, marks, sets, strict=True):
                    name = xxh64_intdigest(s.tobytes(), 7) >> 1 if len(s) else None
                    rows.append((MEMBER, mark % parts, name, i, len(s), None, None, mark))
                    if len(s) and name not in seen:
                        seen.add(name)
                        fresh.append(s)
                        names.append(name)
                        sizes.append(len(s))
                if fresh:
                    t = np.concatenate(fresh)
                    owner = np.repeat(np.arange(len(fresh), dtype=np.uint16), sizes)
                    order = np.argsort(t)
                    t, owner = t[order], owner[order]
                    part = ((t >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                    cuts = np.flatnonzero(np.diff(part, prepend=-1))
                    names_, sizes_ = np.array(names, np.int64), np.array(sizes, np.int64)
                    for a, b in zip(cuts, [*cuts[1:], len(t)], strict=True):
                        used, local = np.unique(owner[a:b], return_inverse=True)
                        extra = names_[used].tobytes() + sizes_[used].tobytes() + local.astype(np.uint16).tobytes()
                        rows.append((TOKENS, int(part[a]), None, None, len(used), _planes(t[a:b]), extra, None))
                yield _batch(rows)

    return run


def _shared(parts: int):
    """All rows of a hash range to rows of the tokens that two classes or more hold, one a class; members pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, classes, sizes = [], [], {}
        for batch in batches:
            kind = batch.column(0).to_numpy()
            if (kind == MEMBER).any():
                yield batch.filter(pa.array(kind == MEMBER))
            for row in batch.filter(pa.array(kind == TOKENS)).select(["n", "tokens", "extra"]).to_pylist():
                n, extra = row["n"], row["extra"]
                names = np.frombuffer(extra, np.int64, n)
                sizes.update(zip(names.tolist(), np.frombuffer(extra, np.int64, n, 8 * n).tolist(), strict=True))
                tokens.append(_tokens(row["tokens"]))
                classes.append(names[np.frombuffer(extra, np.uint16, -1, 16 * n)])
        if not tokens:
            return
        t, c = np.concatenate(tokens), np.concatenate(classes)
        del tokens, classes
        order = np.argsort(t, kind="stable")
        t, c = t[order], c[order]
        # only tokens that come twice are of interest; few remain to be put in order with their classes
        twice = np.zeros(len(t), bool)
        twice[1:] = t[1:] == t[:-1]
        twice[:-1] |= twice[1:]
        t, c = t[twice], c[twice]
        order = np.lexsort((c, t))
        t, c = t[order], c[order]
        first = np.ones(len(t), bool)
        first[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
        t, c = t[first], c[first]
        begins = np.flatnonzero(np.diff(t, prepend=t[:1] + np.uint64(1))) if len(t) else np.zeros(0, np.int64)
        df = np.repeat(np.diff(np.append(begins, len(t))), np.diff(np.append(begins, len(t)))) if len(t) else np.zeros(0, np.int64)
        t, c, df = t[df > 1], c[df > 1], df[df > 1]
        if not len(c):  # no two classes have a token of this range in common
            return
        order = np.lexsort((t, c))
        t, c, df = t[order], c[order], df[order].astype(np.uint32)
        cuts = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        rows = []
        for a, b in zip(cuts, [*cuts[1:], len(c)], strict=True):
            name = int(c[a])
            rows.append((TOKENS, name % parts, name, None, sizes[name], t[a:b].tobytes(), df[a:b].tobytes(), None))
            if len(rows) == 5000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return run


def _bounded(percent: int):
    """Rows in order of class to the classes that reach the bound, shared tokens rarest first; members pass."""
    names = ["class", "id", "n", "tokens", "as_smaller", "as_larger", "row"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> list[tuple]:
            name, n = held[0][:2]
            t = np.frombuffer(b"".join(x[2] for x in held), np.uint64)
            df = np.frombuffer(b"".join(x[3] for x in held), np.uint32)
            alone = n - len(t)
            as_smaller = n - least_of_smaller(n, percent) + 1 - alone
            as_larger = n - least_of_larger(n, percent) + 1 - alone
            if as_larger <= 0:
                return []
            return [(name, None, n, t[np.lexsort((t, df))].view(np.int64), max(0, as_smaller), as_larger, None)]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            kind = batch.column(0).to_numpy()
            if (kind == MEMBER).any():
                m = batch.filter(pa.array(kind == MEMBER))
                empty = [pa.nulls(m.num_rows, t) for t in types[3:6]]
                yield pa.RecordBatch.from_arrays([m.column("class"), m.column("id"), m.column("n"), *empty, m.column("row")], names=names)
            rows = []
            for x in batch.filter(pa.array(kind == TOKENS)).select(["class", "n", "tokens", "extra"]).to_pylist():
                if held and held[0][0] != x["class"]:
                    rows += flush()
                    held.clear()
                held.append((x["class"], x["n"], x["tokens"], x["extra"]))
            if rows:
                yield out(rows)
        if held and (rows := flush()):
            yield out(rows)

    return run, "class long, id long, n int, tokens array<bigint>, as_smaller int, as_larger int, row long"


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those that are linked. Both tokens that two sets have in common are shared ones, so these suffice."""
    side = lambda x: sets.select(F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}"))
    both = F.size(F.array_intersect("ta", "tb"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where((100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na")))
    return met.withColumn("both", both).where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _spread(sets: DataFrame, upto: str) -> DataFrame:
    """(token, class, n, alone, rest) of the first tokens of each set: rest is what can be common if this is the first common token."""
    first = F.posexplode(F.expr(f"slice(tokens, 1, {upto})")).alias("at", "token")
    return sets.where(F.col(upto) > 0).select("class", "n", F.size("tokens").alias("size"), first).select("token", "class", "n", (F.col("n") - F.col("size")).alias("alone"), (F.col("size") - F.col("at")).alias("rest"))


def _overlaps(asked: DataFrame, sets: DataFrame, of: DataFrame) -> DataFrame:
    """asked (q, nq, group) with overlap: how many tokens of the class the group's union has.

    Unions of up to UNION tokens are compared as arrays, a row a question; larger ones token by token."""
    spread = sets.select("class", F.explode("tokens").alias("token")).join(of, "class").join(asked.select("group").distinct(), "group", "left_semi")
    union = stored(spread.select("group", "token").distinct())
    small = union.groupBy("group").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") <= UNION).select("group")
    arrays = union.join(small, "group", "left_semi").groupBy("group").agg(F.collect_list("token").alias("union"))
    own = sets.select(F.col("class").alias("q"), "tokens")
    whole = asked.join(own, "q").join(arrays, "group").select("q", "nq", "group", F.size(F.array_intersect("tokens", "union")).cast("long").alias("overlap"))
    single = asked.join(small, "group", "left_anti").join(own, "q").select("q", "nq", "group", F.explode("tokens").alias("token"))
    met = single.join(union, ["group", "token"]).groupBy("q", "nq", "group").agg(F.count(F.lit(1)).alias("overlap"))
    return whole.unionByName(met)


def links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between classes that connect whatever is linked: to leaders, and between groups where a group was opened."""
    entries = _spread(sets, "as_larger").withColumn("group", F.col("class"))
    found, roots = None, None
    for k in range(STARS):
        # the fewer tokens a class has to itself, the nearer it is to the middle of its kind; later rounds shuffle this a little
        rank = F.col("alone") + F.pmod(F.xxhash64(F.lit(k), "class"), F.lit(1 + 2 * k))
        lead = F.min(F.struct(rank.alias("rank"), "class", "n", "group")).alias("lead")
        # tokens that lie in one group only can link no other
        wide = entries.join(entries.groupBy("token").agg(F.min("group").alias("g0"), F.max("group").alias("g1"), lead).where("g0 != g1"), "token")
        other = wide.where((F.col("group") != F.col("lead.group")) & (100 * F.col("n") >= percent * F.col("lead.n")) & (100 * F.col("lead.n") >= percent * F.col("n")))
        led = other.groupBy("class").agg(F.min("lead").alias("lead")).select(F.col("class").alias("a"), F.col("lead.class").alias("b"))
        new = stored(_verified(led, sets, percent))
        if k and new.isEmpty():
            break
        found = found.union(new) if found is not None else new
        roots = stored(components(found).select(F.col("node").alias("class"), F.col("root").alias("group")))
        entries = stored(wide.select("token", "class", "n", "alone", "rest").join(roots, "class", "left").withColumn("group", F.coalesce("group", "class")))
    of = sets.select("class").join(roots, "class", "left").select("class", F.coalesce("group", "class").alias("group"))
    wide = stored(entries.groupBy("token").agg(F.min("group").alias("g0"), F.max("group").alias("g1")).where("g0 != g1").select("token"))
    q = stored(_spread(sets, "as_smaller").join(wide, "token", "left_semi").join(of, "class").select("token", F.col("class").alias("q"), F.col("n").alias("nq"), F.col("rest").alias("rest_q"), F.col("group").alias("gq")))
    d = stored(entries.join(wide, "token", "left_semi").select("token", F.col("class").alias("d"), F.col("n").alias("nd"), F.col("rest").alias("rest_d"), "group"))
    rows = d.groupBy("token", "group").agg(F.max("nd").alias("most"), F.min("nd").alias("fewest"), F.max("rest_d").alias("rest"))
    # of a pair's common tokens the first one in order leaves room for all others, on both sides
    sizes = percent * (F.col("nq") + F.greatest("fewest", "nq"))
    room = (F.col("rest_q") * (100 + percent) >= sizes) & (F.col("rest") * (100 + percent) >= sizes)
    near = (F.col("most") >= F.col("nq")) & (percent * F.col("fewest") <= 100 * F.col("nq")) & (F.col("group") != F.col("gq")) & room
    asked = stored(q.join(rows, "token").where(near).select("q", "nq", "group").distinct())
    overlap = _overlaps(asked, sets, of)
    opened = overlap.where(F.col("overlap") * (100 + percent) >= 2 * percent * F.col("nq")).select("q", "group")
    fits = ((F.col("nd") > F.col("nq")) | ((F.col("nd") == F.col("nq")) & (F.col("d") != F.col("q")))) & (percent * F.col("nd") <= 100 * F.col("nq"))
    least = percent * (F.col("nq") + F.col("nd"))
    room = (F.col("rest_q") * (100 + percent) >= least) & (F.col("rest_d") * (100 + percent) >= least)
    pairs = q.join(opened, ["q"]).join(d, ["token", "group"]).where(fits & room).select(F.col("q").alias("a"), F.col("d").alias("b")).distinct()
    return found.union(_verified(pairs, sets, percent))


def _classed(docs: DataFrame, id: str, text: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(members: id, n, class, row), (roots: class, root): each row's class of equal sets, each class's component."""
    parts = shuffle_partitions(docs.sparkSession)
    body = docs.select(F.col(id).cast("long").alias("id"), text_of(text).alias("text"), _mark(id, text).alias("row"))
    dealt = body.mapInArrow(_dealt(parts, k), _SCHEMA).repartitionById(parts, F.col("part"))
    shared = dealt.mapInArrow(_shared(parts), _SCHEMA).repartitionById(parts, F.col("part")).sortWithinPartitions("kind", "class")
    table = stored(shared.mapInArrow(*_bounded(percent)))
    sets, members = table.where("tokens is not null").drop("id", "row"), table.where("tokens is null").select("id", "n", "class", "row")
    found = components(links(sets, percent)).select(F.col("node").alias("class"), "root")
    return members, found


def _mark(id: str, text: str) -> Column:
    return F.xxhash64(F.col(id).cast("long"), text_of(text))


def join(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) of each row; component_id is the smallest id that links reach. id must be a whole number."""
    members, found = _classed(docs, id, text, k, percent)
    lowest = members.where("class is not null").groupBy("class").agg(F.min("id").alias("least"))
    rooted = lowest.join(found, "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("class", "component_id")
    out = members.join(named, "class", "left")
    return out.select(F.col("id").alias(id), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component; documents without words all stay. Columns may have any names.

    Where a row's text is kept, the row is found by a hash of id and text; equal rows are then told apart by their number."""
    members, found = _classed(docs, id, text, k, percent)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    lowest = members.where("class is not null").groupBy("class").agg(first).join(found, "class", "left")
    chosen = lowest.groupBy(F.coalesce("root", "class").alias("root")).agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"), F.lit(True).alias("once"))
    wordless = members.where("class is null").select("row", F.lit(False).alias("once")).distinct()
    mark, kept, once, rank = fresh(docs, "mark", "kept", "once", "rank")
    names = chosen.union(wordless).select(F.col("row").alias(kept), F.col("once").alias(once))
    met = docs.withColumn(mark, _mark(id, text)).join(names, F.col(mark) == F.col(kept))
    ranked = met.withColumn(rank, F.row_number().over(Window.partitionBy(mark).orderBy(F.lit(0))))
    return ranked.where((F.col(rank) == 1) | ~F.col(once)).select(*docs.columns)
