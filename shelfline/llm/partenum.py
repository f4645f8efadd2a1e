"""Jaccard join of word n-gram sets by PartEnum signatures, as connected components.

Sizes fall into bands so that similar sets lie in the same or in neighbouring
bands; each pair of neighbouring bands is an instance with a bound k on the number
of elements in which two of its similar sets differ. An instance cuts the domain
of elements into n1 parts, one of which differs in k2 elements at most, and each
part into n2 pieces; the signatures of a set are all choices of n2 - k2 pieces of
a part. Similar sets share one.

Sets with a signature in common are first compared with one leader: within each
batch of documents, then the batches' leaders among each other, so that a
signature on very many sets makes no more comparisons than it has sets. What that
links is joined to components. A second round, exact and over the compared sets
alone, takes every signature that more than one component still has and compares
across components, after the sizes and a parity sketch (whose difference never
exceeds that of the sets) allow it. A signature that many sets have would make as
many comparisons as the square of their number. Its sets are first told apart by
the elements in which they differ from a leader, a prefix filter over those
differences, and once more where such elements are common too (``_differing``).

Defined cases: null texts and texts without words have an empty set and link with
nothing; shorter texts than an n-gram are one element; rows without an id link
with nothing and have no component; the rows of a repeated id are one document,
linked by what any of them links; an empty table gives no rows. Other columns of
the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfline.llm.exchange import from_planes, planes, removed, stored
from shelfline.llm.support import released, small
from shelfline.llm.wordhash import mix, pair, windows, words_of
from shelfline.session import small_side

#: Elements below this bound, about one in eight, are compared before the whole sets: two sets differ in no fewer elements.
LIGHT = np.uint64(1 << 61)
#: Signatures that a task gathers before it sends them, and texts that it knows to have signed.
HELD, KNOWN = 400_000, 20_000
#: Text that a task works on at a time.
TEXT_BYTES = 1 << 20
#: Buckets for each shuffle partition, as bits.
BUCKET_BITS = 2
#: Rows of ``_candidates``: a pair, or a document of a signature that others have too.
PAIR, SHARED = 0, 1
#: What the buckets of signatures get besides: signatures with a leader and a count.
LEADERS = 2
PARITY = 16
#: Sets up to which those of a signature are all compared; others are told apart by what they differ in from a leader,
#: over so many orders of the elements.
STRAIGHT, PARTITIONS = 128, 2
#: Sets of a signature: similar to none that is known, to the leader, or compared with the latter kind alone; linked with the leader anew.
APART, DEEP, LINKED, DIRECT = 0, 1, 2, 3
#: Tasks that share the copies of one text.
SALTS = 16
PARITIES = tuple(f"parity{n}" for n in range(PARITY))


def _reordered(elements: np.ndarray, partition: int) -> np.ndarray:
    return pair(elements, np.uint64(partition), 5)


class Sets:
    """The n-gram sets of consecutive rows, each sorted."""

    def __init__(self, first: int, begins: np.ndarray, elements: np.ndarray) -> None:
        self.first, self.begins, self.elements = first, begins, elements
        self.sizes = np.diff(begins)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)


    def moved(self, partition: int) -> Sets:
        """The same sets over a domain in another order, so that parts hold other elements."""
        if not partition:
            return self
        elements = _reordered(self.elements, partition)
        return Sets(self.first, self.begins, elements[np.lexsort((elements, self.row_of()))])


def sets_of(texts: pa.Array, size: int) -> Iterator[Sets]:
    for words in words_of(texts, lower=True):
        grams, at = windows(words, size)
        row = words.row_of()[at]
        lengths = np.diff(words.begins)
        short = np.flatnonzero((lengths > 0) & (lengths < size))
        if len(short):
            # Too few words: the whole sequence, told apart by its length.
            whole = []
            for r in short:
                h = np.uint64(lengths[r])
                for word in words.hashes[words.begins[r] : words.begins[r + 1]]:
                    h = pair(np.array([h]), np.array([word]))[0]
                whole.append(h)
            place = np.searchsorted(row, short)
            grams, row = np.insert(grams, place, np.array(whole, np.uint64)), np.insert(row, place, short)
        begins = np.searchsorted(row, np.arange(words.rows + 1))
        for i, j in zip(begins[:-1], begins[1:]):
            grams[i:j].sort()
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
        counts = np.concatenate([[0], np.cumsum(new)])
        yield Sets(words.first, counts[begins], grams[new])


def digests(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums that stand for a whole set."""
    out = []
    for salt in (1, 2):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(pair(sets.elements, np.uint64(salt), salt), dtype=np.uint64)])
        out.append(mix(sums[sets.begins[1:]] - sums[sets.begins[:-1]]).view(np.int64))
    return out[0], out[1]


class Scheme:
    """Bands and signatures for links of ``num / den`` or more."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def lows(self, largest: int) -> np.ndarray:
        """The smallest size of each band, up to one band past ``largest``."""
        lows = [1]
        while lows[-1] <= largest:
            lows.append(lows[-1] * self.den // self.num + 1)
        return np.array([*lows, lows[-1] * self.den // self.num + 1])

    def parts(self, highest: int) -> tuple[int, int, int]:
        """n1, n2, k2 for an instance whose sets have ``highest`` elements at most."""
        k = int(self.differing(highest, highest))
        if k == 0:
            return 1, 1, 0
        return k // 2 + 1, 4, 1

    def differing(self, sizes, highest: int):
        """The number of elements in which sets of ``sizes`` differ at most from similar ones of up to ``highest`` elements."""
        return (sizes + np.minimum(sizes * self.den // self.num, highest)) * (self.den - self.num) // (self.den + self.num)

    def signatures(self, sets: Sets, chosen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, signature) of the ``chosen`` rows that aren't empty."""
        chosen = chosen[sets.sizes[chosen] > 0]
        if not len(chosen):
            return
        lows = self.lows(int(sets.sizes[chosen].max()))
        bands = np.searchsorted(lows, sets.sizes[chosen], "right") - 1
        for band in np.unique(bands):
            rows = chosen[bands == band]
            sizes = sets.sizes[rows]
            local = np.repeat(np.arange(len(rows)), sizes)
            index = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(sets.begins[rows], sizes)
            elements = sets.elements[index]
            for instance in (int(band), int(band) + 1):
                highest = int(lows[instance + 1]) - 1 if instance + 1 < len(lows) else int(lows[-1] * self.den // self.num)
                n1, n2, k2 = self.parts(highest)
                pieces = n1 * n2
                # Elements are sorted, so those of a piece are neighbours.
                place = local * pieces + ((elements >> np.uint64(32)) * np.uint64(pieces) >> np.uint64(32)).astype(np.int64)
                begins = np.flatnonzero(np.diff(place, prepend=-1))
                sums = np.zeros(len(rows) * pieces, np.uint64)
                sums[place[begins]] = np.add.reduceat(pair(elements, np.uint64(instance), 3), begins)
                sums = sums.reshape(len(rows), n1, n2)
                whole = sums.sum(axis=2, dtype=np.uint64)
                part = np.arange(n1, dtype=np.uint64)[None, :]
                values = [whole - sum((sums[:, :, j] for j in left_out), np.uint64(0)) for left_out in combinations(range(n2), k2)]
                # All sets would share what stands for no elements. Similar sets agree in so many parts; one that has fewer
                # parts with such a value finds them all by other values, which those that send these values send as well.
                agree = n1 - self.differing(sizes, highest) // (k2 + 1)
                needed = np.logical_or.reduce([value == 0 for value in values]).sum(axis=1) >= agree
                for n, value in enumerate(values):
                    named = pair(pair(value, np.broadcast_to(part, value.shape)), np.full(value.shape, instance * 64 + n, np.uint64))
                    sent = (value != 0) | needed[:, None]
                    yield np.broadcast_to(rows[:, None], sent.shape)[sent], named[sent]


def _stars(signature: np.ndarray, ids: np.ndarray, counts: np.ndarray):
    """Distinct signatures with their smallest id and their count, the (signature, id) of the others, and the distinct pairs of both ids."""
    order = np.lexsort((ids, signature))
    signature, ids = signature[order], ids[order]
    begins = np.flatnonzero(np.diff(signature, prepend=~signature[:1]))
    leader = np.repeat(ids[begins], np.diff(np.append(begins, len(ids))))
    other = leader != ids
    pairs = np.unique(np.stack([leader[other], ids[other]]), axis=1)
    return (signature[begins], ids[begins], np.add.reduceat(counts[order], begins)), (signature[other], ids[other]), (pairs[0], pairs[1])


def _batch(bucket: list[int], kind: int, payload: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([kind] * len(bucket), pa.int32()), pa.array(payload, pa.binary())], names=["bucket", "kind", "payload"])


def _candidates(rows: DataFrame, size: int, scheme: Scheme) -> DataFrame:
    """(a, b, kind): pairs of a leader and another document that share a signature, a < b.

    Rows of kind SHARED have a signature as ``a`` and a document as ``b``: all documents of the signatures that three or
    more have, and some of those that two have. Rows may come up again.
    """
    # Some buckets for each partition, as a bucket is worked on whole.
    bits = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1, 1).bit_length() + BUCKET_BITS

    def sent(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        signature, ids = (np.concatenate(x) for x in zip(*found))
        (signature, leader, total), others, pairs = _stars(signature, ids, np.ones(len(ids), np.int32))
        edges = np.searchsorted(signature, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        edges = [0, *edges.tolist(), len(signature)]
        spans = [(n, i, j) for n, (i, j) in enumerate(zip(edges[:-1], edges[1:])) if j > i]
        yield _batch([n for n, _, _ in spans], LEADERS, [planes(signature[i:j], leader[i:j], total[i:j].astype(np.int32)) for _, i, j in spans])
        # What many have in common goes to no single bucket.
        for kind, (a, b) in ((PAIR, pairs), (SHARED, others)):
            a, b = a.view(np.int64), b.view(np.int64)
            dealt = (pair(a.view(np.uint64), b.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(dealt, kind="stable")
            numbers, begins = np.unique(dealt[order], return_index=True)
            parts = np.split(order, begins[1:]) if len(numbers) else []
            yield _batch(numbers.tolist(), kind, [planes(a[part], b[part], ordered=False) for part in parts])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, known = [], 0, set()
        for batch in (part for whole in batches for part in small(whole, "text", TEXT_BYTES)):
            ids = batch.column("id").to_numpy()
            for sets in sets_of(batch.column("text"), size):
                mark = list(zip(*(d.tolist() for d in digests(sets))))
                own = ids[sets.first : sets.first + len(sets.sizes)]
                # Of equal sets one is enough; the others are linked by their digests.
                chosen = []
                for r, m in enumerate(mark):
                    if m not in known:
                        if len(known) >= KNOWN:
                            known.clear()
                        known.add(m)
                        chosen.append(r)
                for row, signature in scheme.signatures(sets, np.array(chosen, np.int64)):
                    found.append((signature, own[row]))
                    held += len(row)
                    if held >= HELD:
                        yield from sent(found)
                        found, held = [], 0
        if found:
            yield from sent(found)

    def meet(table: pa.Table) -> pa.Table:
        kinds, payloads = table.column("kind").to_numpy(), table.column("payload").to_pylist()
        leaders = [from_planes(p, np.uint64, np.int64, np.int32) for p, k in zip(payloads, kinds) if k == LEADERS]
        found = [(*from_planes(p, np.int64, np.int64, ordered=False), k) for p, k in zip(payloads, kinds) if k != LEADERS]
        if leaders:
            signature, ids, counts = (np.concatenate(x) for x in zip(*leaders))
            (own, _, total), _, pairs = _stars(signature, ids, counts)
            often = total[np.searchsorted(own, signature)] >= 3
            found += [(*pairs, PAIR), (signature[often].view(np.int64), ids[often], SHARED)]
        a, b = (np.concatenate(x) for x in list(zip(*found))[:2])
        return pa.table({"a": a, "b": b, "kind": np.repeat([k for _, _, k in found], [len(a) for a, _, _ in found]).astype(np.int32)})

    return rows.mapInArrow(released(sign), "bucket int, kind int, payload binary").groupBy("bucket").applyInArrow(meet, "a bigint, b bigint, kind int")


def _members(rows: DataFrame, size: int) -> DataFrame:
    """(id, n, one, two, light, parity...) of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in small(whole, "text", TEXT_BYTES)):
            sizes, marks, light, parity = [], [], [], []
            for sets in sets_of(batch.column("text"), size):
                marks.append(np.stack(digests(sets)))
                bit = (sets.elements & np.uint64(64 * PARITY - 1)).astype(np.int64)
                odd = np.bincount(sets.row_of() * 64 * PARITY + bit, minlength=len(sets.sizes) * 64 * PARITY) & 1
                parity.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).reshape(-1, PARITY))
                sizes.append(sets.sizes)
                own = [sets.elements[i:j] for i, j in zip(sets.begins[:-1], sets.begins[1:])]
                light += [planes(e[: np.searchsorted(e, LIGHT)]) for e in own]
            if not sizes:
                continue
            words, (one, two) = np.concatenate(parity), np.concatenate(marks, axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *map(pa.array, (np.concatenate(sizes), one, two)), pa.array(light, pa.binary()), *(pa.array(words[:, n]) for n in range(PARITY))],
                names=["id", "n", "one", "two", "light", *PARITIES],
            )

    return rows.mapInArrow(released(run), f"id bigint, n bigint, one bigint, two bigint, light binary, {', '.join(f'{p} bigint' for p in PARITIES)}")


def _whole(rows: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, one, two, elements) of the rows with these ids, stored, from their texts: sets take more room than texts, and few are needed whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in small(whole, "text", TEXT_BYTES)):
            for sets in sets_of(batch.column("text"), size):
                elements = [planes(sets.elements[i:j]) for i, j in zip(sets.begins[:-1], sets.begins[1:])]
                own = batch.column("id").slice(sets.first, len(elements))
                yield pa.RecordBatch.from_arrays([own, *map(pa.array, digests(sets)), pa.array(elements, pa.binary())], names=["id", "one", "two", "elements"])

    some = stored(ids.select("id").distinct(), "ids")
    sets = stored(rows.join(small_side(some), "id", "left_semi").mapInArrow(released(run), "id bigint, one bigint, two bigint, elements binary"), "whole")
    removed(some)
    return sets


def _may_link(x: list, y: list, scheme: Scheme):
    """Whether sizes and parities allow a link; a parity sketch differs in no more places than the sets."""
    num, den = scheme.num, scheme.den
    differ = sum((F.bit_count(p.bitwiseXOR(q)) for p, q in zip(x[1:], y[1:])), F.lit(0))
    return (x[0] * den >= y[0] * num) & (y[0] * den >= x[0] * num) & (differ * (den + num) <= (x[0] + y[0]) * (den - num))


def _links(pairs: DataFrame, members: DataFrame, rows: DataFrame, size: int, scheme: Scheme) -> DataFrame:
    """The pairs whose sets are similar enough, stored: by sizes and parities, then by a part of the sets, then by all of them."""
    num, den = scheme.num, scheme.den

    def common(x: bytes, y: bytes) -> tuple[int, int]:
        one, two = from_planes(x, np.uint64)[0], from_planes(y, np.uint64)[0]
        return np.count_nonzero(np.diff(np.sort(np.concatenate([one, two]))) == 0), len(one) + len(two)

    def filtered(test):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("x", "y", "size")]
                kept = [test(*common(x, y), size) for x, y, size in zip(*columns)]
                yield batch.select(["a", "b", "size"]).filter(pa.array(kept, pa.bool_()))

        return run

    def with_sets(found: DataFrame, sets: DataFrame, column: str) -> DataFrame:
        for id_, name in (("a", "x"), ("b", "y")):
            found = found.join(sets.select(F.col("id").alias(id_), F.col(column).alias(name)), id_)
        return found.select("a", "b", "size", "x", "y")

    slim = [members.drop("one", "two", "light").withColumnsRenamed({"id": id_, **{c: f"{c}_{id_}" for c in ("n", *PARITIES)}}) for id_ in ("a", "b")]
    may = _may_link(*([F.col(f"{c}_{id_}") for c in ("n", *PARITIES)] for id_ in ("a", "b")), scheme)
    near = pairs.join(slim[0], "a").join(slim[1], "b").where(may).select("a", "b", (F.col("n_a") + F.col("n_b")).alias("size")).distinct()
    schema = "a bigint, b bigint, size bigint"
    near = stored(near, "near")
    likely = with_sets(near, members, "light").mapInArrow(filtered(lambda same, both, size: (both - 2 * same) * (den + num) <= size * (den - num)), schema)
    likely = stored(likely, "likely")
    whole = _whole(rows, likely.select(F.explode(F.array("a", "b")).alias("id")), size)
    alike = with_sets(likely, whole, "elements").mapInArrow(filtered(lambda same, both, size: den * same >= num * (both - same)), schema)
    links = stored(alike.select("a", "b").distinct(), "links")
    removed(near, likely, whole)
    return links


def connected(links: DataFrame) -> DataFrame:
    """(id, component) of every document in ``links`` (a, b), stored, by alternating large and small stars."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        before, edges = edges, stored(small.select("e.*").where("u != v").distinct(), "edges")
        removed(before)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if now == state:
            break
        state = now
    # Every document now points at the smallest of its component.
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    found = stored(found, "components")
    removed(edges)
    return found


def _shared(signed: DataFrame) -> DataFrame:
    """The rows whose signature more than one component has, with the number of its ``sets`` that are to be compared."""
    numbers = [F.count_if(F.col("kind") == kind).alias(name) for kind, name in ((APART, "apart"), (DEEP, "deep"), (LINKED, "linked"))]
    found = signed.groupBy("signature").agg(F.min("component").alias("low"), F.max("component").alias("high"), *numbers)
    sets = F.col("apart") + F.when(F.col("linked") > 0, F.col("deep") + F.when(F.col("apart") + F.col("deep") > 0, F.col("linked")).otherwise(0)).otherwise(0)
    found = found.where("low < high").select("signature", sets.alias("sets"), F.col("linked") > 0, F.col("apart") + F.col("deep") > 0).toDF("signature", "sets", "linked", "others")
    compared = (F.col("kind") == APART) | (F.col("kind") == DEEP) & F.col("linked") | (F.col("kind") == LINKED) & F.col("others")
    return signed.join(found.where("sets > 1"), "signature").where(compared).drop("linked", "others")


def _differing(common: DataFrame, rows: DataFrame, size: int, partition: int, scheme: Scheme) -> DataFrame:
    """(signature, id, one, two, component, kind, leader) of sets by elements in which they differ from a leader, stored.

    The leader of a common signature is that of its sets which shares most signatures
    with others, for it has least of its own to differ in. Sets x and y
    that differ from it in X and Y differ in |X| + |Y| - 2 |X and Y| elements from
    each other. So those that are similar, not both to the leader, have so many
    elements of X and Y in common that one is among the first of either, in an
    order of the elements; these elements and the leader are the new signatures.
    """
    total, rest = scheme.den + scheme.num, scheme.den - scheme.num

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in small(whole, "elements")):
            if not batch.num_rows:
                continue
            numbers, named, kinds = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("elements", "of_leader", "mark", "component", "beside")]
            for n, (own, leading, mark, component, beside) in enumerate(zip(*columns)):
                x, p = from_planes(own, np.uint64)[0], from_planes(leading, np.uint64)[0]
                elements, place, times = np.unique(np.concatenate([x, p]), return_index=True, return_counts=True)
                differ, of_leader = elements[times == 1], place[times == 1] >= len(x)
                # Those that the leader hasn't come first, for fewer sets have them.
                differ = differ[np.lexsort((_reordered(differ, partition), of_leader))]
                beyond, bound = total * len(differ) - rest * len(x), rest * len(p)
                least = -(-(beyond + bound + 1) // (2 * total))  # elements in common with a set that isn't similar to the leader
                first = max(len(differ) - least + 1, 0)
                kind = np.full(first, LINKED if beyond <= bound else APART, np.int32)
                if beyond > bound and component != beside:
                    # Sets similar to the leader may have fewer in common with this one.
                    deep = len(differ) - -(-(beyond - bound) // (total + rest)) + 1
                    kind = np.append(kind, np.full(max(deep - first, 0), DEEP, np.int32))
                told = pair(np.full(len(kind), mark, np.int64).view(np.uint64), differ[: len(kind)], partition)
                if beyond <= bound and component != beside:
                    kind, told = np.append(kind, np.int32(DIRECT)), np.append(told, np.uint64(0))
                numbers.append(np.full(len(kind), n))
                named.append(told)
                kinds.append(kind)
            taken = batch.select(["id", "one", "two", "component", "leader"]).take(pa.array(np.concatenate(numbers)))
            signature, kind = pa.array(np.concatenate(named).view(np.int64)), pa.array(np.concatenate(kinds).astype(np.int32))
            yield pa.RecordBatch.from_arrays([signature, *taken.columns[:4], kind, taken.columns[4]], names=["signature", *taken.schema.names[:4], "kind", "leader"])

    set_ = F.struct("id", "one", "two", "component")
    shared = common.groupBy("id", "one", "two", "component").agg(F.sum("sets").alias("shared"))
    led = common.join(shared.drop("component"), ["id", "one", "two"]).groupBy("signature").agg(F.max(F.struct("shared", set_.alias("set"))).alias("most"))
    led = led.select("signature", F.col("most.set").alias("leader"))
    led = common.join(led, "signature").select("id", "one", "two", "leader").distinct().where(F.struct("id", "one", "two") != F.struct("leader.id", "leader.one", "leader.two"))
    led = stored(led, "led")
    needed = shared.select("id", "one", "two", "component")  # leaders are among them
    whole = _whole(rows, needed, size)
    sets = stored(whole.join(needed, ["id", "one", "two"]).dropDuplicates(["id", "one", "two"]), "sets")
    removed(whole)
    leaders = sets.select(F.struct("id", "one", "two", "component").alias("leader"), F.col("elements").alias("of_leader"))
    both = led.join(sets, ["id", "one", "two"]).join(leaders, "leader")
    both = both.select("id", "one", "two", "component", "elements", "of_leader", F.xxhash64("leader").alias("mark"), F.col("leader.component").alias("beside"), F.col("leader.id").alias("leader"))
    differing = stored(both.mapInArrow(released(run), "signature bigint, id bigint, one bigint, two bigint, component bigint, kind int, leader bigint"), "differing")
    removed(led, sets)
    return differing


def _left_over(shared: DataFrame, members: DataFrame, rows: DataFrame, components: DataFrame, tested: DataFrame, size: int, scheme: Scheme) -> DataFrame:
    """Pairs of different components that share a signature and weren't compared, stored."""
    # Of equal sets one row is enough; which of them were compared depends on the batches they came in.
    ids = tested.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    compared = members.select("id", "one", "two", "n").join(ids, "id", "left_semi")
    one_each = compared.groupBy("one", "two", "n").agg(F.min("id").alias("id"))
    one_each = one_each.join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = stored(compared.withColumnRenamed("id", "signed").join(one_each, ["one", "two", "n"]), "placed")
    # Where an id has several texts, its signatures count for each of them.
    signed = shared.join(placed.select("signed", "id", "one", "two", "component"), "signed").drop("signed").distinct()
    signed = stored(signed.withColumn("kind", F.lit(APART)), "signed")
    open_ = stored(_shared(signed), "open")
    removed(signed)
    straight, direct, used = [], [], [placed, open_]
    for partition in range(1, PARTITIONS + 1):
        common = open_.where(F.col("sets") > STRAIGHT)
        if common.isEmpty():
            break
        straight.append(open_.where(F.col("sets") <= STRAIGHT))
        differing = _differing(common, rows, size, partition, scheme)
        direct.append(differing.where(F.col("kind") == DIRECT).select(F.least("leader", "id").alias("a"), F.greatest("leader", "id").alias("b")).where("a < b"))
        open_ = stored(_shared(differing.where(F.col("kind") != DIRECT).drop("leader")), "open")
        used += [differing, open_]
    straight.append(open_)

    sketches = members.join(placed.where("signed = id").select("id", "one", "two", "n").distinct(), ["id", "one", "two", "n"]).select("id", "n", *PARITIES)
    sized = reduce(DataFrame.unionByName, straight).select("signature", "id", "component", "kind").distinct().join(sketches, "id")
    sized = stored(sized, "sized")
    x, y = sized.alias("x"), sized.alias("y")
    may = _may_link(*([F.col(f"{side}.{c}") for c in ("n", *PARITIES)] for side in ("x", "y")), scheme)
    kinds = F.greatest("x.kind", "y.kind") == APART
    kinds = kinds | ((F.col("x.kind") == LINKED) != (F.col("y.kind") == LINKED))
    may = (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component")) & kinds & may
    pairs = x.join(y, (F.col("x.signature") == F.col("y.signature")) & may).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    pairs = stored(reduce(DataFrame.unionByName, [*direct, pairs]).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
    removed(*used, sized)
    return pairs


def components(docs: DataFrame, size: int = 4, num: int = 85, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row; documents link at ``num / den`` of common shingles or more."""
    scheme = Scheme(num, den)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    named = rows.where("id is not null")
    met = stored(_candidates(named, size, scheme), "met")
    pairs = stored(met.where(F.col("kind") == PAIR).select("a", "b").distinct(), "pairs")
    shared = met.where(F.col("kind") == SHARED).select(F.col("a").alias("signature"), F.col("b").alias("signed"))
    members = stored(_members(rows, size), "members")
    facts = stored(members.select("id", F.col("n").alias("n_shingles"), "one", "two"), "facts")
    marked = facts.where("id is not null and n_shingles > 0")
    first = marked.groupBy("one", "two", "n_shingles").agg(F.min("id").alias("v"), F.count("*").alias("times")).where("times > 1").drop("times")
    # The copies of one text may be a third of all rows.
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    marked = marked.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    copies = stored(marked.join(first, ["one", "two", "n_shingles", "salt"]).where("id != v").select(F.col("id").alias("u"), "v").distinct(), "copies")
    links = _links(pairs, members, named, size, scheme)
    copied = copies.select(F.col("v").alias("a"), F.col("u").alias("b"))
    found = connected(links.unionByName(copied))
    left_over = _left_over(shared, members, named, found, pairs, size, scheme)
    more = _links(left_over, members, named, size, scheme)
    if not more.isEmpty():
        before, found = found, connected(links.unionByName(copied).unionByName(more))
        removed(before)
    removed(met, pairs, members, links, left_over, more, copies)
    labelled = facts.select("id", "n_shingles").join(found, "id", "left")
    return labelled.select(F.col("id").alias(key), "n_shingles", F.coalesce("component", "id").alias("component_id"))
