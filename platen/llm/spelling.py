"""Spelling variants: words one edit apart, found in k-d trees over their letter counts.

One inserted, deleted or replaced letter changes two letter counts by one at most, one up and one down. Words
are points, a tree for each length; a word looks in the tree of its own length for points at most two away (L1),
and in the next length's for points that have one letter more. Boxes that lie further off are left out, and of
the points that are left the order of the letters is compared.

The upper part of the trees is built by Spark: as long as a node holds more than LEAF words, a histogram of
letter counts splits it most evenly. Splits are few (see ``splits``) and go to all tasks; words are dealt to
their leaf, and to each leaf that their search reaches, and a leaf's words make a small tree of their own.

Letters beyond a to z share dimensions. That can only bring points nearer, so nothing is lost.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, parts, release, slices, stage

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
DIMENSIONS, MOST = 64, 30_000  # counts above MOST count as MOST
#: Words of a leaf and of a bucket in a leaf's own tree.
LEAF, BUCKET = 5_000, 64
#: A node that is split holds more than one in so many of all words: what goes to all tasks stays small.
MOST_SPLITS = 20_000
#: Different words that a task holds before it hands on their counts.
HELD = 200_000

_LOWER = {c: c + 32 for c in range(65, 91)}


def word_counts(df: DataFrame, key: str = "doc_id", text: str = "text", slips: int = 0, least: int = 5) -> DataFrame:
    """word, n: how often each run of letters of at least ``least`` code points occurs, A to Z in lower case.

    With ``slips`` every so many-th word of a text, by the hash h of key and word, loses its letter h % length,
    which plants misspellings. Null texts have no words, a null key hashes as an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for part in slices(batches, 1):
            for id_, text_ in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                own: Counter[str] = Counter()
                for word, k in Counter(LETTERS.findall(text_.as_py() or "")).items():
                    own[word.lower() if word.isascii() else word.translate(_LOWER)] += k
                seed = zlib.crc32(f"{'' if id_ is None else id_}:".encode())
                for word, k in own.items():
                    if slips and (h := zlib.crc32(word.encode(), seed)) % slips == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= least:
                        held[word] += k
                if len(held) > HELD:
                    yield _counted(held)
                    held.clear()
            release()
        yield _counted(held)

    rows = df.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(held: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")


def points(words: list[str]) -> np.ndarray:
    """The letter counts of each word: a to z, and what is left folded into the other dimensions."""
    codes = _codes(words).astype(np.int64)
    letter = np.where((codes >= 97) & (codes <= 122), codes - 97, 26 + codes % (DIMENSIONS - 26))
    row = np.repeat(np.arange(len(words)), np.array([len(w) for w in words], np.int64))
    counts = np.bincount(row * DIMENSIONS + letter, minlength=len(words) * DIMENSIONS)
    return np.minimum(counts, MOST).astype(np.int16).reshape(-1, DIMENSIONS)


#: Splits by node: the dimension, the largest count that goes left, the left and the right node. A length's
#: whole tree is the node of minus that length; other nodes count from 1.
Splits = dict[int, tuple[int, int, int, int]]


def _leaves(tree: Splits, top: int, at: np.ndarray, rows: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
    """The leaves below top and, of the rows, those that reach each with so many counts up and down at most."""
    todo = [(top, rows, {})]
    while todo:
        node, own, box = todo.pop()
        if not len(own):
            continue
        if node not in tree:
            yield node, own
            continue
        d, value, left, right = tree[node]
        low, high = box.get(d, (0, MOST))
        for child, bounds in ((left, (low, min(high, value))), (right, (max(low, value + 1), high))):
            inner = box | {d: bounds}
            ups, downs = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            for k, (a, b) in inner.items():
                ups += np.maximum(a - at[own, k], 0)
                downs += np.maximum(at[own, k] - b, 0)
            todo.append((child, own[(ups <= up) & (downs <= down)], inner))


def splits(words: DataFrame, total: int, leaf: int = LEAF) -> Splits:
    """The splits of all nodes that hold more than ``leaf`` of the words, and more than one in MOST_SPLITS.

    A level has at most MOST_SPLITS of them. Nodes whose words all have the same letters stay whole.
    """
    most = max(leaf, total // MOST_SPLITS)
    tree: Splits = {}
    large = {-r["length"] for r in words.groupBy(F.length("word").alias("length")).count().filter(F.col("count") > most).collect()}
    fresh = 0
    while large:
        counted = words.mapInArrow(_histograms(dict(tree), large), "node long, d int, value int, n long").groupBy("node", "d", "value").agg(F.sum("n").alias("n"))
        order = Window.partitionBy("node", "d").orderBy("value")
        below = counted.withColumn("left", F.sum("n").over(order)).withColumn("all", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        best = below.filter("left < all").groupBy("node").agg(F.min(F.struct(F.abs(2 * F.col("left") - F.col("all")).alias("uneven"), "d", "value", "left", "all")).alias("best"))
        large = set()
        for r in best.select("node", "best.*").orderBy("node").collect():
            left, right = fresh + 1, fresh + 2
            fresh += 2
            tree[r["node"]] = (r["d"], r["value"], left, right)
            large |= {node for node, n in ((left, r["left"]), (right, r["all"] - r["left"])) if n > most}
    return tree


def _histograms(tree: Splits, large: set[int]):
    """How often each count of each letter occurs in the large nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            if not words:
                continue
            at, lengths = points(words), np.array([len(w) for w in words])
            rows: list[tuple[int, int, int, int]] = []
            for length in np.unique(lengths).tolist():
                for node, own in _leaves(tree, -length, at, np.flatnonzero(lengths == length), 0, 0):
                    if node in large:
                        for d in range(DIMENSIONS):
                            values, n = np.unique(at[own, d], return_counts=True)
                            rows += [(node, d, v, k) for v, k in zip(values.tolist(), n.tolist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["node", "d", "value", "n"])

    return run


def _dealt(tree: Splits):
    """node, looks, word, n: every word in its leaf, and as one that looks in each leaf that it can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            if not words:
                continue
            at, lengths = points(words), np.array([len(w) for w in words])
            for length in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == length)
                for looks, top, up, down in ((False, -length, 0, 0), (True, -length, 1, 1), (True, -length - 1, 1, 0)):
                    for node, rows in _leaves(tree, top, at, own, up, down):
                        taken = batch.take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), node, np.int64)), pa.array(np.full(len(rows), looks)), taken.column(0), taken.column(1)], ["node", "looks", "word", "n"])

    return run


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of codes differ by one replaced letter, or b has one letter more than a."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    head = np.cumprod(a == b[:, :-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    tail = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    return head + tail >= a.shape[1]


def _by_halves(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that agree in the letters before or behind the middle, as one edit leaves one of them."""
    half, more = a.shape[1] // 2, b.shape[1] - a.shape[1]
    found = []
    for x, y in ((a[:, :half], b[:, :half]), (a[:, half:], b[:, half + more :])):
        both = np.unique(np.concatenate([x, y]), axis=0, return_inverse=True)[1].ravel()
        left, right = both[: len(a)], both[len(a) :]
        order = np.argsort(right, kind="stable")
        first, end = np.searchsorted(right[order], left, "left"), np.searchsorted(right[order], left, "right")
        rows = np.repeat(np.arange(len(a)), end - first)
        found.append(np.stack([rows, order[np.arange(len(rows)) - np.repeat(np.cumsum(end - first) - (end - first), end - first) + np.repeat(first, end - first)]], axis=1))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _search(members: list[str], lookers: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places (of a looker, of a member) of all words one edit apart; all members have one length, all lookers too."""
    at, to = points(lookers), points(members)
    a, b = _codes(lookers).reshape(len(lookers), -1), _codes(members).reshape(len(members), -1)
    down = 1 if a.shape[1] == b.shape[1] else 0
    found = [np.zeros((0, 2), np.int64)]

    def check(i: np.ndarray, j: np.ndarray) -> None:
        for k in range(0, len(i), 1 << 16):
            good = _one_edit(a[i[k : k + (1 << 16)]], b[j[k : k + (1 << 16)]])
            found.append(np.stack([i[k : k + (1 << 16)][good], j[k : k + (1 << 16)][good]], axis=1))

    todo = [(np.arange(len(members)), np.arange(len(lookers)))]
    while todo:
        inside, near = todo.pop()
        box = to[inside]
        low, high = box.min(axis=0), box.max(axis=0)
        ups = np.maximum(low - at[near], 0).sum(axis=1)
        downs = np.maximum(at[near] - high, 0).sum(axis=1)
        near = near[(ups <= 1) & (downs <= down)]
        if not len(near):
            continue
        spread = np.flatnonzero(low < high)
        if not len(spread):  # the same letters in every member
            if len(inside) > BUCKET:
                i, j = _by_halves(a[near], b[inside])
                check(near[i], inside[j])
            else:
                check(np.repeat(near, len(inside)), np.tile(inside, len(near)))
        elif len(inside) <= BUCKET:
            rest = np.flatnonzero(low == high)
            base = np.abs(at[near][:, rest] - low[rest]).sum(axis=1)
            for k in range(0, len(near), 4096):
                own = near[k : k + 4096]
                apart = np.abs(at[own][:, None, spread] - box[None, :, spread]).sum(axis=2) + base[k : k + 4096, None]
                i, j = np.nonzero(apart <= 1 + down)
                check(own[i], inside[j])
        else:
            middle = np.median(box[:, spread], axis=0)
            middle = np.minimum(np.maximum(np.floor(middle), low[spread]), high[spread] - 1)
            share = np.abs((box[:, spread] <= middle).mean(axis=0) - 0.5)
            d = int(share.argmin())
            left = box[:, spread[d]] <= middle[d]
            todo += [(inside[left], near), (inside[~left], near)]
    pairs = np.concatenate(found)
    return pairs[:, 0], pairs[:, 1]


def _near(group: pa.Table) -> pa.Table:
    """word, other, other_n of all words one edit apart, of which one is in the leaf; words of the leaf's length meet from both sides."""
    looks = group.column("looks").to_numpy()
    members = group.filter(pa.array(~looks))
    out = []
    if members.num_rows:
        words, n = members.column("word").to_pylist(), members.column("n").to_numpy()
        lookers = group.filter(pa.array(looks))
        others, k = lookers.column("word").to_pylist(), lookers.column("n").to_numpy()
        lengths = np.array([len(w) for w in others], np.int64)
        for length in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == length)
            i, j = _search(words, [others[x] for x in own.tolist()])
            i = own[i]
            a, b = lookers.column("word").take(pa.array(i)), members.column("word").take(pa.array(j))
            out.append((a, b, n[j]))
            if length != len(words[0]):
                out.append((b, a, k[i]))
    arrays = [pa.concat_arrays([c for x in out for c in x[i].chunks] or [pa.array([], pa.string())]) for i in range(2)]
    return pa.table([*arrays, pa.array(np.concatenate([np.zeros(0, np.int64), *(x[2] for x in out)]))], ["word", "other", "other_n"])


def near_words(words: DataFrame, leaf: int = LEAF) -> DataFrame:
    """word, other, other_n of all pairs of the words (word, n; different ones, staged) that are one edit apart, both ways round."""
    total = words.count()
    tree = splits(words, total, leaf)
    dealt = words.select("word", "n").repartition(parts(total, 50_000, 12)).mapInArrow(_dealt(tree), "node long, looks boolean, word string, n long")
    return dealt.groupBy("node").applyInArrow(_near, "word string, other string, other_n long")


def variants(counts: DataFrame, least: int = 3, times: int = 2, leaf: int = LEAF) -> DataFrame:
    """word, n, form, form_n, n_near and root of every word that occurs at least ``least`` times.

    Two words are near if one edit (one code point inserted, deleted or replaced) makes one the other. A word's
    form is its near word of the largest n, among equal ones the smallest in code-point order, if that n is at
    least ``times`` its own; root follows forms to the last. ``counts`` holds word and n, a row a word; rows
    without a word or n are left out.

    Forms at least double, so chains are short; they are followed by doubling, and words that many point to
    are joined in place.
    """
    if times < 2:
        raise ValueError("forms have to be more frequent: times is at least 2")
    words = stage(counts.select("word", "n").filter(F.col("word").isNotNull() & (F.col("n") >= least)), "spelling-words")
    near = near_words(words, leaf).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    joined = words.join(near, "word", "left").withColumn("good", -F.col("best.minus") >= F.lit(times) * F.col("n"))
    formed = joined.select("word", "n", F.when(F.col("good"), F.col("best.other")).alias("form"), F.when(F.col("good"), -F.col("best.minus")).alias("form_n"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"))
    formed = stage(formed, "spelling-forms")
    steps = formed.select("word", F.coalesce("form", "word").alias("to"))
    total = moved = words.count()
    while moved:
        refs = steps.groupBy("to").agg(F.count(F.lit(1)).alias("n"))
        ahead = steps.select(F.col("word").alias("to"), F.col("to").alias("next")).join(refs, "to")
        ahead = stage(join_counted(steps, ahead, "to", "n", total), "spelling-steps")
        moved = ahead.filter("to != next").limit(1).count()
        steps = ahead.select("word", F.col("next").alias("to"))
    return formed.join(steps.withColumnRenamed("to", "root"), "word")
