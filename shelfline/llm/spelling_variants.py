"""Groups of spelling variants: words one edit apart, each led to its commonest neighbour.

The vocabulary becomes a trie held as a table: a node is a prefix, with the
next two letters of the words below it and, where a word ends, that word's count.
All words walk it together, one level a step, as states (word, node, what is left of the
word, edits). A state joins its node's row. Without an edit yet it goes on along
its own word and also tries other letters: put in, put in place of the next one,
or met after leaving the next one out. With one edit it goes on only along what
is left. A state that has made one edit and ends where a word ends has found a
neighbour. A letter counts as put in or left out at the end of a run of equal
ones, so every neighbour is found once.

Near the root a node has very many words and letters below it. So a word's first
half takes no edit on the way forward: words walk the trie of the words read
backward too, and make the edits of their first half there. Both tries are one
table; a mark before a node's letters tells the way.

Words over ``LONG`` letters would need as many steps. Their neighbours are found
by the hashes of the word and of the word without each of its letters instead.

Defined cases: null and empty texts have no words; a null key counts as an empty
one where misspellings are planted; repeated rows count each; of neighbours of
equal count the first by code points leads; an empty table has no words; columns
other than key and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfline.llm.exchange import stored
from shelfline.llm.support import small
from shelfline.session import list_folders, work_folder

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
#: Words up to here walk the trie.
LONG = 48
#: Levels that one job walks before the states are stored.
LEVELS = 4
#: Words that a task counts before it sends them on.
HELD = 200_000
_PRIME, _BASES = (1 << 61) - 1, (0x9E3779B97F4A7C1, 0xBF58476D1CE4E5B)


def misspelt(word: str, key: int | None, every: int) -> str:
    """The word without one letter if ``every`` divides the crc32 of ``<key>:<word>``."""
    code = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
    at = code % len(word)
    return word if code % every else word[:at] + word[at + 1 :]


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LETTERS, planted: int | None = None) -> DataFrame:
    """(word, n) of the words of at least ``least`` letters, A-Z lower-cased.

    With ``planted``, a share of one in so many (key, word) pairs is misspelt first.
    """
    find = re.compile(f"[{LETTERS}]{{{least},}}").findall

    def sent(held: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for rows in small(batch, "text"):
                for number, body in zip(rows.column("key").to_pylist(), rows.column("text").to_pylist()):
                    before = zlib.crc32(b":" if number is None else b"%d:" % number)
                    for found, times in Counter(find(body or "")).items():
                        word = found.encode().lower()
                        if planted and not zlib.crc32(word, before) % planted:
                            word = misspelt(word.decode(), number, planted).encode()
                            if len(found) <= least:
                                continue
                        held[word] += times
                    if len(held) > HELD:
                        yield sent(held)
                        held.clear()
        if held:
            yield sent(held)

    counted = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


FORWARD, BACKWARD = ">", "<"


def _both_ways(words: DataFrame) -> DataFrame:
    """Every word as it is read forward and backward, after the mark of the way; ``half`` is where its edits begin."""
    size = F.char_length("word")
    ways = [(F.lit(FORWARD), F.col("word"), F.floor(size / 2)), (F.lit(BACKWARD), F.reverse("word"), F.ceil(size / 2))]
    read = F.explode(F.array(*[F.struct(F.concat(way, letters).alias("read"), half.cast("int").alias("half")) for way, letters, half in ways]))
    return words.select("word", "n", size.alias("size"), read.alias("r")).select("word", "n", "size", "r.*")


def _trie(read: DataFrame) -> str:
    """The tries' nodes (node, next, n), stored by depth; ``next`` has the next two letters of the words below, one at a word's end.

    A word's neighbours are at most one letter shorter, so none walks above half of that.
    """
    depth = F.explode(F.sequence(F.greatest(F.floor((F.col("size") - 1) / 2).cast("int"), F.lit(0)), F.col("size"))).alias("depth")
    steps = read.select("read", "n", "size", depth).select(
        "depth",
        F.expr("substring(read, 1, depth + 1)").alias("node"),
        F.expr("nullif(substring(read, depth + 2, 2), '')").alias("two"),
        F.expr("if(depth = size, n, null)").alias("n"),
    )
    # The map tasks keep one set a node.
    nodes = steps.groupBy("depth", "node").agg(F.collect_set("two").alias("next"), F.max("n").alias("n"))
    path = work_folder(read.sparkSession, "trie")
    # A task has few depths, so there are about as many files as tasks and depths together.
    nodes.repartitionByRange("depth", "node").write.partitionBy("depth").parquet(path)
    return path


_STATE = "struct<node:string,rest:string,edits:int,near:string,near_n:bigint>"


def _state(node: Column, rest: Column, edits: int) -> Column:
    nothing = F.lit(None)
    return F.struct(node.alias("node"), rest.alias("rest"), F.lit(edits).alias("edits"), nothing.alias("near"), nothing.alias("near_n")).cast(_STATE)


def _step(states: DataFrame, nodes: DataFrame) -> DataFrame:
    """All states one level further down; those that found a neighbour stay as they are."""
    node, rest = F.col("node"), F.col("rest")
    head, tail = F.substring(rest, 1, 1), F.expr("substring(rest, 2)")
    second, after, third = F.substring(rest, 2, 1), F.expr("substring(rest, 3)"), F.substring(rest, 3, 1)
    last, more = F.expr("right(node, 1)"), rest != ""
    clean, forward, none = F.col("edits") == 0, F.startswith(node, F.lit(FORWARD)), F.array().cast(f"array<{_STATE}>")
    # Read backward, a run's last letter comes first, and the half itself belongs to the way forward.
    may_leave_out = F.when(forward, head != second).otherwise(head != last)
    may_put_in = forward | (F.char_length(node) - 1 > F.ceil(F.char_length("word") / 2))

    def only(condition: Column, state: Column) -> Column:
        return F.when(condition, F.array(state)).otherwise(none)

    def tried(allowed: Column, beside: Column, then: Column, left: Column) -> Column:
        others = F.filter("next", lambda two: (F.substring(two, 1, 1) != beside) & (F.substring(two, 2, 1) == then))
        return F.when(allowed, F.transform(others, lambda two: _state(F.concat(node, F.substring(two, 1, 1)), left, 1))).otherwise(none)

    word = F.expr("if(startswith(node, '" + FORWARD + "'), substring(node, 2), reverse(substring(node, 2)))")
    found = F.struct(F.lit(None).alias("node"), F.lit("").alias("rest"), F.lit(1).alias("edits"), word.alias("near"), F.col("n").alias("near_n")).cast(_STATE)
    at_end = F.when(clean, (F.char_length(rest) == 1) & (forward | may_leave_out)).otherwise(~more) & F.col("n").isNotNull()
    every = F.concat(
        only(more & clean, _state(F.concat(node, head), tail, 0)),
        only(more & ~clean & F.array_contains("next", F.concat(head, second)), _state(F.concat(node, head), tail, 1)),
        only(at_end, found),
        tried(clean & more, head, second, tail),
        tried(clean & may_put_in, F.when(forward, head).otherwise(last), head, rest),
        only(clean & (second != "") & may_leave_out & F.array_contains("next", F.concat(second, third)), _state(F.concat(node, second), after, 1)),
    )
    same = F.array(F.struct("node", "rest", "edits", "near", "near_n").cast(_STATE))
    joined = states.join(nodes, "node", "left")
    return joined.select("word", F.explode(F.when(F.col("near").isNotNull(), same).otherwise(every)).alias("s")).select("word", "s.*")


def _walked(words: DataFrame) -> DataFrame:
    """(word, near, near_n) of neighbours among words of up to LONG letters."""
    spark = words.sparkSession
    # As many tasks as shuffles have: few bytes of words make much work.
    read = stored(_both_ways(words).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "read"), "read")
    path = _trie(read)
    depths = sorted(int(name.partition("=")[2]) for name in list_folders(spark, path) if "=" in name)
    nothing = F.lit(None)
    starts = read.select(
        "half",
        "word",
        F.expr("substring(read, 1, half + 1)").alias("node"),
        F.expr("substring(read, half + 2)").alias("rest"),
        F.lit(0).alias("edits"),
        nothing.cast("string").alias("near"),
        nothing.cast("bigint").alias("near_n"),
    )
    states, found = starts.where(F.lit(False)).drop("half"), None
    for number, level in enumerate(depths):  # a depth without nodes has no states
        nodes = spark.read.schema("node string, next array<string>, n bigint").parquet(f"{path}/depth={level}")
        states = _step(states.unionByName(starts.where(F.col("half") == level).drop("half")), nodes)
        if number % LEVELS == LEVELS - 1 or level == depths[-1]:
            made = stored(states, "states")
            ended, states = made.where("near IS NOT NULL"), made.where("near IS NULL")
            found = ended if found is None else found.unionByName(ended)
    return found.select("word", "near", "near_n")


def _rolled(word: str, base: int) -> tuple[int, list[int]]:
    """Hash of a word, and of the word without each of its letters."""
    before, behind, power = [0], [0], [1]
    for letter in word:
        before.append((before[-1] * base + ord(letter)) % _PRIME)
        power.append(power[-1] * base % _PRIME)
    for at, letter in enumerate(reversed(word)):
        behind.append((behind[-1] + ord(letter) * power[at]) % _PRIME)
    size = len(word)
    return before[-1], [(before[at] * power[size - 1 - at] + behind[size - 1 - at]) % _PRIME for at in range(size)]


def _hashed(words: DataFrame) -> DataFrame:
    """(word, near, near_n) of neighbours of which one at least has more than LONG letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                (whole, gaps), (second, others) = (_rolled(word, base) for base in _BASES)
                size = len(word)
                columns = [
                    pa.array([word] * (size + 1)),
                    pa.array([n] * (size + 1), pa.int64()),
                    pa.array([size] + [size - 1] * size, pa.int32()),
                    pa.array([-1, *range(size)], pa.int32()),
                    pa.array([whole, *gaps], pa.int64()),
                    pa.array([second, *others], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "size", "gap", "first", "second"])

    keys = stored(words.mapInArrow(run, "word string, n bigint, size int, gap int, first bigint, second bigint"), "gaps")
    place = ["size", "first", "second"]
    whole = keys.where("gap < 0").select(*place, F.col("word").alias("near"), F.col("n").alias("near_n"))
    gaps = keys.where("gap >= 0")
    shorter = gaps.dropDuplicates(["word", *place]).join(whole, place)
    longer = shorter.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    # Words with one letter replaced at the same place: at most as many as there are letters.
    others = gaps.select(*place, "gap", F.col("word").alias("near"), F.col("n").alias("near_n"))
    replaced = gaps.join(others, [*place, "gap"]).where("word != near")
    links = shorter.select("word", "near", "near_n").unionByName(longer).unionByName(replaced.select("word", "near", "near_n"))
    return links.where((F.char_length("word") > LONG) | (F.char_length("near") > LONG))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near, near_n) of all pairs in ``words`` (word, n) that differ by one letter put in, left out or replaced."""
    short, long = words.where(F.char_length("word") <= LONG), words.where(F.char_length("word") >= LONG)
    links = _walked(short) if not short.isEmpty() else None
    if not long.where(F.char_length("word") > LONG).isEmpty():
        links = _hashed(long) if links is None else links.unionByName(_hashed(long))
    return links if links is not None else words.select("word", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the stored ``words`` (word, n).

    ``form`` is the commonest neighbour if it is ``ratio`` times as common at
    least; ``root`` is where the forms end. Each step multiplies the count, so
    few doublings of the pointers reach it.
    """
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("_best")
    about = neighbours(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    leads = -F.col("_best.less") >= ratio * F.col("n")
    formed = words.join(about, "word", "left").select(
        "word",
        F.when(leads, F.col("_best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(leads, -F.col("_best.less")).alias("form_n"),
    )
    formed = stored(formed, "forms")
    pointers = stored(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "pointers")
    while True:
        ahead = pointers.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        jumped = stored(pointers.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "pointers")
        pointers = jumped.drop("_moved")
        if jumped.where("_moved").isEmpty():
            break
    return formed.join(pointers, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_spellings(docs: DataFrame, key: str = "doc_id", text: str = "text", least_count: int = LEAST_COUNT, planted: int | None = None) -> DataFrame:
    """The :func:`variants` of the words of ``text`` that come up ``least_count`` times or more."""
    return variants(stored(count_words(docs, key, text, planted=planted).where(F.col("n") >= least_count), "words"))
