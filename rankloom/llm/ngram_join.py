"""N-gram Jaccard join by chosen paths.

Texts are sets of five-word shingles; two texts are linked when the Jaccard
likeness of their sets is at least ``threshold``. ``near_copies`` returns one row
per document: its class (linked texts, through any number of links) and its
number of links.

1. Equal texts become one representative. Each gets ``COORDINATES`` min-hashes,
   so a set is embedded as that many tokens, and four bits of each as a sketch.
2. Chosen paths: at a node of the search tree every set goes to the children
   named by the tokens that the node samples: one, or two, ``1 / threshold`` on
   average, so linked sets are expected to stay together at least once, with
   little variance. Nodes of at most ``SMALL_NODE`` sets are compared by brute
   force, by sketch, many nodes at a time. In a large node all members are held
   against its pivot, and the few that are far from it against all others; a node
   with many such is split again. What is near is told by a spanning tree of the
   node, never by its pairs, and pivots are the least keys, so repeats name the
   same trees. Independent repeats bring the recall to its target: the deeper a
   set sat in split nodes, the more repeats it gets (``survival``). What is left
   after ``MOST_LEVELS`` is connected whole and left to the exact check.
3. An exact check follows. What the paths connected is compared by whole shingle
   sets, in blocks of at most about ``BLOCK`` sets: each pair of a group meets in
   exactly one block, so links are counted there and only numbers per document
   leave it. No list of pairs is made.

A hot token is split by the paths and a hot text is one representative. Nodes are
counted by partial aggregates; large ones and the few rows about them are
broadcast behind a count, with a shuffled join beyond it. Only groups of near
copies are read as text again.

Defined results: words are lower-cased and separated by blanks; a text of one to
four words is one shingle; texts without words (null counts as empty) are equal
to one another and to nothing else; copies of a document are links too; the
class id is the smallest id in the class (null if all are null); repeated rows
are copies; null ids come after all others; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_names, freeing, in_small_batches, stored, text_of

SHINGLE = 5
THRESHOLD = 0.8
COORDINATES = 64
RECALL = 0.999
#: Nodes of at most so many sets are compared all with all.
SMALL_NODE = 4096
#: Members of small nodes that one call compares, about.
PACK_ROWS = 16384
#: Sketch coordinates that may differ: 12 are expected at a likeness of 0.8, with deviation 3.1.
DIFFERENT = 25
#: The same for a large node's pivot: 22 at 0.64, the least between two sets that a third is linked to; 50 at 0.16.
LOOSE = 33
#: So many far members of a large node are held against all others before it is split.
FEW_FAR = 16
BLOCK = 1024
#: At most so many rows of numbers (at most 64 bytes each) are broadcast.
BROADCAST_ROWS = 500_000
MOST_LEVELS = 40
#: Words that a worker remembers; longer ones than LONG_WORD characters are hashed anew.
MEMO, LONG_WORD = 150_000, 64

_BLANK = re.compile(r"[\x20\x09-\x0D]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240817)
_FACTORS = _RNG.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64)


class _Codes(dict):
    """A 64-bit hash of each word, remembered."""

    def __missing__(self, word: str) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= LONG_WORD:
            self[word] = h
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(text: str, codes: _Codes) -> np.ndarray:
    found = [w for w in _BLANK.split(text.lower()) if w]
    return np.fromiter(map(codes.__getitem__, found), np.uint64, len(found))


def shingles(words: np.ndarray) -> np.ndarray:
    """The sorted distinct hashes of runs of five words; of all words where they are fewer."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    width = min(n, SHINGLE)
    h = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        h = _mixed(h * _MIX + words[k : n - width + 1 + k])
    return np.unique(h)


def _key(words: np.ndarray, powers: np.ndarray) -> int:
    """A 64-bit hash of the word sequence, as a signed number."""
    total = np.atleast_1d((words * powers[: len(words)]).sum(dtype=np.uint64)) + np.full(1, len(words), np.uint64) * _MIX
    return int(_mixed(total).view(np.int64)[0])


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, _MIX, np.uint64))


class _Reader:
    """Word hashes and keys of texts."""

    def __init__(self) -> None:
        self.codes, self.powers = _Codes(), _powers(1 << 12)

    def words(self, text: str) -> tuple[np.ndarray, int]:
        if len(self.codes) > MEMO:
            self.codes.clear()
        words = _words(text, self.codes)
        if len(words) > len(self.powers):
            self.powers = _powers(2 * len(words))
        return words, _key(words, self.powers)


_SKETCH = ("s0", "s1", "s2", "s3")


def _signed(texts: DataFrame) -> DataFrame:
    """``texts`` (id, text, mark) to (id, mark, key, n, sketch, tokens): the key of the text, its number of shingles, sketch and min-hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        shifts = np.arange(64, dtype=np.uint64)
        for batch in batches:
            keys, sizes, tokens = [], [], np.zeros((batch.num_rows, COORDINATES), np.uint64)
            for k, text in enumerate(batch.column(1).to_pylist()):
                words, key = reader.words(text)
                found = shingles(words)
                keys.append(key)
                sizes.append(len(found))
                for at in range(0, len(found), 4096):
                    part = (found[None, at : at + 4096] * _FACTORS[:, None] + _OFFSETS[:, None]).min(axis=1)
                    tokens[k] = part if at == 0 else np.minimum(tokens[k], part)
            mixed = _mixed(tokens)
            bits = ((((mixed >> np.uint64(b)) & np.uint64(1)) << shifts).sum(axis=1, dtype=np.uint64).view(np.int64) for b in range(len(_SKETCH)))
            flat = pa.array((mixed >> np.uint64(32)).astype(np.uint32).view(np.int32).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * COORDINATES), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), *map(pa.array, bits), lists], names=["id", "mark", "key", "n", *_SKETCH, "tokens"])

    return in_small_batches(texts).mapInArrow(freeing(run), f"id {texts.schema['id'].dataType.simpleString()}, mark long, key long, n long, {', '.join(f'{s} long' for s in _SKETCH)}, tokens array<int>")


# -- chosen paths -------------------------------------------------------------


def runs_for(recall: float, per_run: float) -> int:
    """How many repeats bring pairs at the threshold together with this chance."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - per_run)))


def survival(levels: int, threshold: float = THRESHOLD) -> float:
    """The chance that one run keeps a pair at the threshold together through so many levels of nodes."""
    two, s = 1 / threshold - 1, 1.0
    for _ in range(levels):
        s = (1 - two) * threshold * s + two * (1 - (1 - threshold * s) ** 2)
    return s


def _different(a: Column, b: Column) -> Column:
    """In how many coordinates two sketches differ."""
    out = F.lit(0).cast("long")
    for name in _SKETCH:
        out = out.bitwiseOR(a[name].bitwiseXOR(b[name]))
    return F.bit_count(out)


def _near(df: DataFrame, n: int) -> DataFrame:
    """``df`` of ``n`` narrow rows, broadcast where they are few."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def chosen_paths(sets: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 11) -> DataFrame:
    """``sets`` (key, sketch, tokens) to edges (a, b), a > b: spanning trees of what is near by sketch.

    Every set takes part in the repeats for one level of nodes. A set that sat in
    split nodes takes part in as many more as the level after its deepest calls for, and
    so on until no set has too few: two linked sets stay together no deeper than either of
    them goes, so both take part in the repeats that the pair needs.
    """
    second = 1 / threshold - 1
    order = np.random.default_rng(seed).permutation(COORDINATES).tolist()
    # the repeats for sets that sat in nodes of so many levels, MOST_LEVELS and one at most
    needs = [runs_for(recall, survival(k + 1, threshold)) for k in range(MOST_LEVELS + 1)]
    sampled = [r for r in range(needs[-1]) for _ in range(1 + (math.floor((r + 1) * second) > math.floor(r * second)))]
    starts = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(order[k % COORDINATES]).alias("i")) for k, r in enumerate(sampled)))
    todo = sets.select("key", *_SKETCH, "tokens", F.lit(0).alias("done"), F.lit(needs[0]).alias("need"))
    edges = []
    while True:
        mine = F.filter(starts, lambda x: (x["r"] >= F.col("done")) & (x["r"] < F.col("need")))
        paths = F.transform(mine, lambda x: F.xxhash64(x["r"], x["i"], F.get("tokens", x["i"])))
        found, split = _searched(todo.select("key", *_SKETCH, F.explode(paths).alias("path")), sets, second)
        if found:
            edges.append(stored(reduce(DataFrame.unionAll, found).filter("a > b").distinct()))
        if not split:
            break
        deepest = reduce(DataFrame.unionAll, split).groupBy(F.col("key").alias("of")).agg(F.max("levels").alias("levels"))
        at = lambda levels: F.element_at(F.array(*map(F.lit, needs)), F.least(levels, F.lit(MOST_LEVELS)) + 1)
        # some sets go a level deeper in the repeats to come: one level more than is due keeps the rounds few
        due = todo.select("key", F.col("need").alias("done")).join(deepest, F.col("key") == F.col("of")).filter(at(F.col("levels")) > F.col("done"))
        short = stored(due.select("of", "done", at(F.col("levels") + 1).alias("need")))
        n = short.count()
        if not n:
            break
        todo = sets.join(_near(short, n), F.col("key") == F.col("of")).select("key", *_SKETCH, "tokens", "done", "need")
    if not edges:
        return sets.limit(0).select(F.col("key").alias("a"), F.col("key").alias("b"))
    return edges[0] if len(edges) == 1 else stored(reduce(DataFrame.unionAll, edges).distinct())


def _searched(entries: DataFrame, sets: DataFrame, second: float) -> tuple[list[DataFrame], list[DataFrame]]:
    """The trees under ``entries`` (key, sketch, path): edges, and (key, levels) of sets in nodes that were split at so many levels."""
    edges, deep = [], []
    for level in range(MOST_LEVELS + 1):
        # the pivot is the least key: a hash of the text, so a random member, but the same one in every node
        nodes = stored(entries.groupBy(F.col("path").alias("node")).agg(F.count(F.lit(1)).alias("size"), F.min("key").alias("pivot")).filter("size > 1"))
        is_small = F.col("size") <= SMALL_NODE
        n, n_small, rows = nodes.agg(F.count(F.lit(1)), F.count_if(is_small), F.sum(F.when(is_small, F.col("size")))).first()
        if n_small:
            members = entries.join(_near(nodes.filter(is_small).select("node"), n_small), F.col("path") == F.col("node"), "left_semi").select("path", "key", *_SKETCH)
            edges.append(_small_nodes(members, rows))
        if n == n_small:
            break
        pivots = nodes.filter(~is_small).join(sets.select(F.col("key").alias("of"), F.struct(*_SKETCH).alias("s")), F.col("pivot") == F.col("of")).select("node", "pivot", "s")
        large = stored(entries.join(_near(pivots, n - n_small), F.col("path") == F.col("node")).select("path", "key", *_SKETCH, "pivot", (_different(F.struct(*_SKETCH), F.col("s")) <= LOOSE).alias("near")))
        if level == MOST_LEVELS:
            edges.append(large.select(F.col("key").alias("a"), F.col("pivot").alias("b")))
            break
        edges.append(large.filter("near").select(F.col("key").alias("a"), F.col("pivot").alias("b")))
        # nodes with members far from the pivot: few of them meet all others, many mean another split
        far = stored(large.groupBy(F.col("path").alias("node")).agg(F.count_if(~F.col("near")).alias("far")).filter("far > 0"))
        few, many = far.agg(F.count_if(F.col("far") <= FEW_FAR), F.count_if(F.col("far") > FEW_FAR)).first()
        if few:
            edges.append(_few_far(large.join(_near(far.filter(F.col("far") <= FEW_FAR).select("node"), few), F.col("path") == F.col("node"), "left_semi").select("path", "key", *_SKETCH, "near"), few))
        if not many:
            break
        again = large.join(_near(far.filter(F.col("far") > FEW_FAR).select("node"), many), F.col("path") == F.col("node"), "left_semi").select(F.col("key").alias("of"), "path")
        deep.append(again.select(F.col("of").alias("key"), F.lit(level + 1).alias("levels")).distinct())
        one = F.pmod(F.xxhash64("path"), F.lit(COORDINATES)).cast("int")
        two = F.pmod(one + 1 + F.pmod(F.xxhash64("path", F.lit(1)), F.lit(COORDINATES - 1)), F.lit(COORDINATES)).cast("int")
        samples = F.when(F.pmod(F.xxhash64("path", F.lit(2)), F.lit(1 << 20)) < int(second * (1 << 20)), F.array(one, two)).otherwise(F.array(one))
        split = again.join(sets, F.col("of") == F.col("key")).withColumn("i", F.explode(samples))
        entries = stored(split.select("key", *_SKETCH, F.xxhash64(F.col("path"), F.lit(level), F.col("i"), F.get("tokens", F.col("i"))).alias("path")))
    return edges, deep


def _few_far(members: DataFrame, n: int) -> DataFrame:
    """Edges of nodes, ``members`` (path, key, sketch, near), whose few members far from the pivot are held against all.

    Members near the pivot are connected already: a far one needs one of them at most.
    """
    held = members.filter("not near").groupBy(F.col("path").alias("node")).agg(F.collect_list(F.struct("key", *_SKETCH)).alias("m"))
    met = F.filter("m", lambda y: (y["key"] != F.col("key")) & (_different(F.struct(*_SKETCH), y) <= DIFFERENT))
    pairs = members.join(_near(held, n * FEW_FAR), F.col("path") == F.col("node")).select("path", "key", "near", F.explode(F.transform(met, lambda y: y["key"])).alias("other"))
    one = pairs.groupBy("path", "other", F.when(~F.col("near"), F.col("key")).alias("own")).agg(F.min("key").alias("key"))
    return one.select(F.greatest("key", "other").alias("a"), F.least("key", "other").alias("b"))


def _small_nodes(members: DataFrame, rows: int) -> DataFrame:
    """Edges of ``rows`` members (path, key, sketch) of small nodes: from each to the least key that it reaches in its node."""

    def compared(table: pa.Table) -> pa.Table:
        path, key = table.column("path").to_numpy(), table.column("key").to_numpy()
        order = np.lexsort((key, path))
        path, key = path[order], key[order]
        root = near_roots(path, [table.column(s).to_numpy()[order] for s in _SKETCH])
        tied = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": key[tied], "b": key[root[tied]]})

    packed = members.withColumn("pack", F.pmod(F.xxhash64("path"), F.lit(max(1, rows // PACK_ROWS))))
    return packed.groupBy("pack").applyInArrow(compared, "a long, b long")


def near_roots(path: np.ndarray, sketch: list[np.ndarray]) -> np.ndarray:
    """For rows sorted by node: the first row of the node that each reaches through near sketches."""
    n = len(path)
    first = np.searchsorted(path, path, "left")

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        differing = np.zeros(len(i), np.int64)
        for s in sketch:
            differing |= s[i] ^ s[j]
        return np.bitwise_count(differing.view(np.uint64)) <= DIFFERENT  # of a signed number numpy counts the absolute value

    # rows near the first one are connected by it and need not meet each other
    star = near(np.arange(n), first)
    pairs = [(first[star], np.flatnonzero(star))]
    i = np.arange(n)
    for step in range(1, n):
        i = i[i + step < n]
        i = i[path[i] == path[i + step]]
        if not len(i):
            break
        open_ = i[~(star[i] & star[i + step])]
        open_ = open_[near(open_, open_ + step)]
        pairs.append((open_, open_ + step))
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for end in (a, b, root[a], root[b]):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


# -- groups -------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to (node, root): large-star and small-star rounds until nothing changes.

    Each round joins every edge to the least neighbour of its end: by broadcast
    while there are few edges, else by a shuffle that adaptive execution splits
    where a node is hot.
    """
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        n = now[0]
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("p")).agg(F.min("v").alias("m")).select("p", F.least("p", "m").alias("m"))
        large = both.filter("v > u").join(_near(least, 2 * n), F.col("u") == F.col("p")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        first = large.groupBy(F.col("u").alias("p")).agg(F.min("v").alias("m"))
        small = large.join(_near(first, 2 * n), F.col("u") == F.col("p")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        e = stored(small.unionAll(first.select(F.col("p").alias("u"), F.col("m").alias("v"))).distinct())


def shared_counts(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """How many elements each set of ``left`` shares with each of ``right`` (or with the others of ``left``)."""
    both = left if right is None else [*left, *right]
    rows = np.repeat(np.arange(len(both)), [len(x) for x in both])
    values, column = np.unique(np.concatenate(both), return_inverse=True)
    often = np.bincount(column, minlength=len(values)) > 1  # others are shared by none
    number = np.cumsum(often) - 1
    keep = often[column]
    rows, column = rows[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    out = np.zeros((len(left), len(left if right is None else right)), np.float32)
    for at in range(0, int(often.sum()), 2048):
        a, b = np.searchsorted(column, (at, at + 2048))
        m = np.zeros((len(both), 2048), np.float32)
        m[rows[a:b], column[a:b] - at] = 1
        out += m @ m.T if right is None else m[: len(left)] @ m[len(left) :].T
    return out


def _local_roots(linked: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The smallest key that each row reaches through ``linked`` (square, with the diagonal)."""
    rank = np.argsort(np.argsort(keys))
    root = rank.copy()
    while True:
        new = np.where(linked, root[None, :], len(keys)).min(axis=1)
        new = np.minimum(new, root)
        if (new == root).all():
            return np.sort(keys)[root]
        root = new


def _compared(keys, copies, sets, block, cell: tuple[int, int], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of the rows of one block of a group, or of two blocks held against each other."""
    sizes = np.array([len(x) for x in sets], np.float64)
    if cell[0] != cell[1]:
        a, b = (np.flatnonzero(block == side) for side in cell)
        if not len(a) or not len(b):
            return np.zeros(len(keys), np.int64), keys
        shared = np.zeros((len(keys), len(keys)), np.float64)
        shared[np.ix_(a, b)] = shared_counts([sets[i] for i in a], [sets[i] for i in b])
        shared += shared.T
    else:
        shared = shared_counts(sets).astype(np.float64)
    linked = shared * (1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-9
    np.fill_diagonal(linked, False)
    links = (linked * copies[None, :]).sum(axis=1).astype(np.int64)
    np.fill_diagonal(linked, True)
    return links, _local_roots(linked, keys)


def _checked(members: DataFrame, threshold: float) -> DataFrame:
    """``members`` (comp, parts, key, copies, text of the representative) to (key, links, class)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen = _Reader(), set()
        for batch in batches:
            rows = []
            for k, text in enumerate(batch.column(4).to_pylist()):
                key = batch.column(2)[k].as_py()
                if key not in seen:  # repeated rows of a representative
                    seen.add(key)
                    rows.append((k, shingles(reader.words(text)[0]).view(np.int64)))
            at = pa.array([k for k, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(4)), pa.array([s for _, s in rows], pa.list_(pa.int64()))], names=["comp", "parts", "key", "copies", "grams"])

    sets = in_small_batches(members.select("comp", "parts", "key", "copies", "text")).mapInArrow(freeing(read), "comp long, parts int, key long, copies long, grams array<long>")
    packs = max(1, members.count() // BLOCK)
    own = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    dealt = sets.withColumn("own", own).withColumn("cell", F.explode(others)).select(
        "comp", "parts", "key", "copies", "grams", "own", F.when(F.col("parts") == 1, F.pmod(F.xxhash64("comp"), F.lit(packs))).otherwise(F.col("comp")).alias("pack"), F.col("parts").alias("of"), "cell.i", "cell.j"
    )

    def block(table: pa.Table) -> pa.Table:
        names = ("comp", "key", "copies", "own", "parts")
        comp, key, copies, own, parts = (table.column(c).to_numpy() for c in names)
        grams = table.column("grams").combine_chunks()
        cell = (table.column("i")[0].as_py(), table.column("j")[0].as_py())
        offsets, flat = grams.offsets.to_numpy(), grams.values.to_numpy()
        out = []
        for c in np.unique(comp):
            at = np.flatnonzero(comp == c)
            at = at[np.unique(key[at], return_index=True)[1]]  # repeated rows of a representative
            links, root = _compared(key[at], copies[at], [flat[offsets[i] : offsets[i + 1]] for i in at], own[at], cell, threshold)
            out.append((key[at], links, root, parts[at]))
        columns = [np.concatenate([o[k] for o in out]) for k in range(4)]
        return pa.table({"key": columns[0], "links": columns[1].astype(np.int64), "root": columns[2], "parts": columns[3].astype(np.int32)})

    found = checkpointed(dealt.groupBy("pack", "of", "i", "j").applyInArrow(block, "key long, links long, root long, parts int"))
    totals = found.groupBy("key").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.max("parts").alias("parts"))
    if found.filter("parts > 1").isEmpty():
        return totals.select("key", "links", F.col("root").alias("class"))
    # where a group was cut into blocks, its classes join what the blocks found
    joined = components(found.filter("parts > 1").select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnRenamed("root", "joint")
    return totals.join(joined, F.col("key") == F.col("node"), "left").select("key", "links", F.when(F.col("parts") == 1, F.col("root")).otherwise(F.coalesce("joint", "key")).alias("class"))


def near_copies(docs: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of ``docs``: the id, class_id (the smallest id of its class), n_links."""
    return _classes(docs, threshold, recall, id_column, text_column).select(F.col("id").alias(id_column), "class_id", "n_links")


def deduplicated(docs: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one document of each class, that of the smallest id (null ids last; of equal ids, by a hash of the text).

    Of rows alike in id and text one stays.
    """
    classes = checkpointed(_classes(docs, threshold, recall, id_column, text_column).select("id", "mark", "stays"))
    of_id, of_mark = free_names(docs, "of_id", "of_mark")
    pairs = classes.groupBy(F.col("id").alias(of_id), F.col("mark").alias(of_mark)).agg(F.bool_and("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
    mark = F.xxhash64(docs[text_column])
    same = docs[id_column].eqNullSafe(F.col(of_id)) & (mark == F.col(of_mark))
    gone, twice = (checkpointed(pairs.filter(x).select(of_id, of_mark)) for x in ("not stays", "stays and n > 1"))
    n, n_twice = gone.count(), twice.count()
    kept = docs.join(_near(gone, n), same, "left_anti")
    if not n_twice:
        return kept
    one = docs.join(_near(twice, n_twice), same, "left_semi").withColumn(of_mark, mark).dropDuplicates([id_column, of_mark]).drop(of_mark)
    return kept.join(_near(twice, n_twice), same, "left_anti").unionAll(one)


def _classes(docs: DataFrame, threshold: float, recall: float, id_column: str, text_column: str) -> DataFrame:
    """(id, mark, class_id, n_links, stays) of every row; mark is a hash of the text as it stands, stays says whether the row's id and mark are the least of its class."""
    texts = docs.select(docs[id_column].alias("id"), text_of(text_column).alias("text"), F.xxhash64(docs[text_column]).alias("mark"))
    signed = checkpointed(_signed(texts))
    row = F.struct(F.col("id").isNull().alias("none"), "id", "mark")
    reps = checkpointed(signed.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min(row).alias("rep"), F.first(F.struct("n", *_SKETCH, "tokens")).alias("s")).select("key", "copies", "rep", "s.*"))
    edges = chosen_paths(reps.filter("n > 0").select("key", *_SKETCH, "tokens"), threshold=threshold, recall=recall)
    grouped = checkpointed(components(edges))
    sizes = grouped.groupBy(F.col("root").alias("comp")).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(BLOCK))).cast("int").alias("parts"))
    members = grouped.join(sizes, F.col("root") == F.col("comp")).join(reps.select("key", "copies", "rep"), F.col("node") == F.col("key"))
    members = checkpointed(members.select("comp", "parts", "key", "copies", "rep"))
    with_text = texts.join(_near(members, members.count()), F.col("id").eqNullSafe(F.col("rep.id")) & (F.col("mark") == F.col("rep.mark")))
    checked = checkpointed(_checked(with_text, threshold))
    # texts that have copies or links; the others are their own class
    linked = checked.select(F.col("key").alias("of"), "links", "class")
    special = reps.join(linked, F.col("key") == F.col("of"), "left").filter((F.col("copies") > 1) | F.col("of").isNotNull())
    special = special.select("key", "rep", F.coalesce("class", "key").alias("class"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    least = special.groupBy(F.col("class").alias("c")).agg(F.min("rep").alias("least"))
    info = checkpointed(special.join(least, F.col("class") == F.col("c")).select(F.col("key").alias("of"), "least", "n_links"))
    out = signed.select("id", "mark", "key").join(info, F.col("key") == F.col("of"), "left")
    stays = F.col("of").isNull() | (F.col("id").eqNullSafe(F.col("least.id")) & (F.col("mark") == F.col("least.mark")))
    return out.select("id", "mark", F.when(F.col("of").isNull(), F.col("id")).otherwise(F.col("least.id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), stays.alias("stays"))
