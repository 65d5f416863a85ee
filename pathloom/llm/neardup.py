"""N-gram Jaccard join: a MinHash LSH forest proposes, exact verification decides.

Each text is the set of its five-word shingles (64-bit hashes; words are runs of letters, digits and
underscores, without regard to ASCII case; a shorter text is one shingle). Equal sets form a copy class and go
on as one row with a signature of ``4 * trees`` MinHash labels. Each of ``trees`` prefix tries holds all classes under a
label sequence of its own (the signature read from another label on, four labels further for each trie).

The join looks up every class under a prefix of its sequence and shortens the prefix label by label. At each length, classes
under one trie node are compared: a task sorts its rows by their sequences, so a node is a run of rows. Pairs whose
signatures agree as often as the threshold asks for are counted by the number of tries that hold them together; those in one
or two tries tell how many are in none (Chao's estimate, made cautious by three more singletons), which is
the measured recall. The prefix is short enough once that reaches the target for near, nearer and nearest pairs each, or once
pairs exactly at the threshold are found with that chance whatever the data.

Nodes only propose: pairs whose whole signatures agree far less often than the threshold asks (by
several standard deviations) are left out, and what remains is joined to groups. Within a group the
Jaccard similarity of every pair is computed exactly. Nodes and groups beyond ``block`` rows are dealt out as pairs of
blocks. A task returns how many links each row has, and links of rows to the least row that is reached, never all pairs; a pair of
blocks only links what hangs together inside each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import batches, cut, texts, utf8
from pathloom.operators.components import components
from pathloom.plans.lineage import unbound

PIECE = 1 << 21
_NUMBERS = np.random.default_rng(20240311)
BYTES = _NUMBERS.integers(0, 2**64, 256, np.uint64)
ODD = _NUMBERS.integers(0, 2**64, 4096, np.uint64) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.array([chr(i).isalnum() or i == 95 if i < 128 else True for i in range(256)])


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of some rows, laid end to end, and each word's row."""
    inside = IN_WORD[data]
    place = np.flatnonzero(inside)
    if not len(place):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts = np.zeros(len(data) + 1, bool)
    starts[offsets[:-1]] = True
    first = np.concatenate([[True], (place[1:] != place[:-1] + 1) | starts[place[1:]]])
    begin = np.flatnonzero(first)
    inner = np.arange(len(place)) - np.repeat(begin, np.diff(np.append(begin, len(place))))
    powers = np.cumprod(np.full(int(inner.max()) + 1, STEP, np.uint64))
    hashes = scramble(np.add.reduceat(BYTES[LOWER[data[place]]] * powers[inner], begin))
    return hashes, np.searchsorted(offsets, place[begin], "right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted set of each row's shingles of n words; empty for a row without words."""
    hashes, rows = words(data, offsets)
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    starts = np.cumsum(counts) - counts
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    rolled = sum(padded[k : k + len(hashes)] * ODD[k] for k in range(n))
    found = []
    for start, count in zip(starts.tolist(), counts.tolist(), strict=True):
        if count >= n:
            found.append(np.unique(scramble(rolled[start : start + count - n + 1])))
        elif count:
            found.append(scramble(np.array([sum(int(h) * int(o) for h, o in zip(hashes[start : start + count], ODD, strict=False)) + count & 2**64 - 1], np.uint64)))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The shingles of each text of a column, a few million bytes at a time."""
    data, offsets = utf8(column)
    row = 0
    while row < len(offsets) - 1:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        yield from shingles(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], n)
        row = end


OWN_LABELS = 4


def safe_depth(threshold: float, recall: float, trees: int, longest: int = 12) -> int:
    """The longest prefix with which a pair at the threshold shares a node of some trie with the chance asked for."""
    for depth in range(longest, 1, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    return 1


def _signatures(n: int, labels: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            sets = list(shingle_sets(batch.column("text"), n))
            full = [i for i, s in enumerate(sets) if len(s)]
            digests: list[bytes | None] = [None] * len(sets)
            counts = pa.array([len(s) for s in sets], pa.int64())
            signatures: list[bytes | None] = [None] * len(sets)
            if full:
                sizes = np.array([len(sets[i]) for i in full])
                starts = np.cumsum(sizes) - sizes
                flat = np.concatenate([sets[i] for i in full])
                least = np.stack([np.minimum.reduceat(flat * ODD[16 + j], starts) for j in range(labels)], axis=1)
                sums = [np.add.reduceat(scramble(flat ^ ODD[j]), starts) for j in (8, 9)]
                pair = np.stack([sums[0] + sizes.astype(np.uint64), sums[1]], axis=1)
                short = scramble(least).astype("<u2")
                for k, i in enumerate(full):
                    digests[i], signatures[i] = pair[k].tobytes(), short[k].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()), counts], names=["doc_id", "key", "digest", "signature", "shingles"])

    return run


class Trees:
    """Union-find over positions: each one's root is the least position that is linked to it."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: int, others: np.ndarray) -> None:
        roots = np.unique(self.root[np.append(others, a)])
        if len(roots) > 1:
            self.root[np.isin(self.root, roots)] = roots[0]


def new_links(within: Trees, whole: Trees, across: bool) -> np.ndarray:
    """The positions to link to their root: all that are no root or, in a pair of blocks, roots of one block alone.

    What is linked inside a block the task of that block says, so a pair of blocks that hang together adds one link.
    """
    place = np.arange(len(whole.root))
    return np.flatnonzero((whole.root != place) & ((within.root == place) | (not across)))


def groups(parts: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of a sorted stream, split where a key changes."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches(parts):
        columns = [np.asarray(batch.column(k)) for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        edges = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def dealt(rows: DataFrame, keys: list[str], count: Column, id_col: str, block: int) -> DataFrame:
    """Rows under a key, once for each pair of blocks that they are part of (first, second; own), sorted by key and pair.

    A key of up to ``block`` rows is one block and one pair.
    """
    blocks = F.ceil(count / block).cast("int")
    own = F.pmod(F.xxhash64(F.col(id_col), F.lit("block")), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("first"), F.greatest(o, F.col("own")).alias("second")))
    spread = rows.withColumn("blocks", blocks).withColumn("own", own).withColumn("pair", F.explode(pairs)).select(*rows.columns, "own", "pair.first", "pair.second")
    return spread.repartition(*keys, "first", "second").sortWithinPartitions(*keys, "first", "second")


def sequences(trees: int, depth: int) -> np.ndarray:
    """Which labels of a signature the first ``depth`` places of each trie's sequence are."""
    return (OWN_LABELS * np.arange(trees)[:, None] + np.arange(depth)) % (OWN_LABELS * trees)


def strata(threshold: float) -> list[float]:
    """Lower bounds of near, nearer and nearest pairs."""
    return [threshold, threshold + (1 - threshold) / 3, threshold + 2 * (1 - threshold) / 3]


def _propose(trees: int, depth: int, least: int, threshold: float):
    """Links (a, b) to the least id that nodes hold together, and rows without a link that count pairs: stratum, once, twice, all."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        labels, places = OWN_LABELS * trees, sequences(trees, depth)
        bounds = np.array([b * labels for b in strata(threshold)])
        counts = np.zeros((len(bounds), 3))
        for table in groups(parts, ["tree", "node", "first", "second"]):
            table = table.sort_by("id")
            ids, own = np.asarray(table.column("id")), np.asarray(table.column("own"))
            signatures = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u2").reshape(len(ids), labels)
            across = table.column("first")[0] != table.column("second")[0]
            within, whole = Trees(len(ids)), Trees(len(ids))
            for i in range(len(ids) - 1):
                equal = signatures[i + 1 :] == signatures[i]
                agree = equal.sum(axis=1)
                whole.join(i, np.flatnonzero(agree >= least) + i + 1)
                if across:
                    same = own[i + 1 :] == own[i]
                    within.join(i, np.flatnonzero((agree >= least) & same) + i + 1)
                    agree[same] = -1
                linked = np.flatnonzero(agree >= bounds[0])
                if len(linked):
                    held = equal[linked][:, places].all(axis=2).sum(axis=1)  # tries that hold the pair together
                    stratum = np.searchsorted(bounds, agree[linked], "right") - 1
                    for k, chosen in enumerate((held == 1, held == 2, held > 0)):
                        counts[:, k] += np.bincount(stratum[chosen], weights=1 / held[chosen], minlength=len(bounds))
            linked = new_links(within, whole, across)
            left += ids[linked].tolist()
            right += ids[whole.root[linked]].tolist()
        n, m = len(left), len(bounds)
        yield pa.RecordBatch.from_arrays(
            [pa.array(left + [None] * m, pa.int64()), pa.array(right + [None] * m, pa.int64()), pa.array([None] * n + list(range(m)), pa.int32()), *(pa.array([None] * n + counts[:, k].tolist(), pa.float64()) for k in range(3))],
            names=["a", "b", "stratum", "once", "twice", "pairs"])

    return run


def measured_recall(once: float, twice: float, pairs: float) -> float:
    """The share of pairs that some trie holds together, from those held by one and by two; three more singletons than seen, so few pairs prove little."""
    missed = (once + 3) * (once + 2) / (2 * (twice + 1))
    return pairs / (pairs + missed)


def proposals(sets: DataFrame, threshold: float, trees: int, recall: float, slack: float, block: int) -> tuple[DataFrame, list[tuple[int, float]]]:
    """Links (a, b) between classes (id, signature), and the prefix lengths tried with the recall measured at each."""
    safe = safe_depth(threshold, recall, trees)
    depth, tried = min(safe + 2, 2 * OWN_LABELS), []
    around = F.concat("signature", F.substring("signature", 1, 4 * OWN_LABELS))
    while True:
        under = F.explode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(F.substring(around, 2 * OWN_LABELS * t + 1, F.lit(2 * depth))).alias("node"))))
        nodes = sets.select("id", under.alias("at")).select("id", "at.tree", "at.node")
        shared = nodes.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        members = nodes.join(unbound(shared, "tree", "node"), ["tree", "node"]).join(sets.select("id", "signature"), "id").select("tree", "node", "members", "id", "signature")
        found = cut(dealt(members, ["tree", "node"], F.col("members"), "id", block).mapInArrow(_propose(trees, depth, int((threshold - slack) * trees * OWN_LABELS), threshold), "a long, b long, stratum int, once double, twice double, pairs double"))
        counted = found.where("stratum IS NOT NULL").groupBy("stratum").agg(F.sum("once"), F.sum("twice"), F.sum("pairs")).collect()
        tried.append((depth, min((measured_recall(*row[1:]) for row in counted), default=0.0)))
        if tried[-1][1] >= recall or depth <= safe:
            return found.where("a IS NOT NULL").select("a", "b"), tried
        depth -= 1


def _verify(threshold: float):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(parts, ["root", "first", "second"]):
            ids, first = np.unique(np.asarray(table.column("id")), return_index=True)
            raw = table.column("shingles").take(pa.array(first)).to_pylist()
            copies, own = np.asarray(table.column("copies"))[first], np.asarray(table.column("own"))[first]
            across = bool((np.asarray(table.column("first")) != np.asarray(table.column("second"))).any())
            sizes = np.array([len(r) // 8 for r in raw])
            flat = np.unique(np.frombuffer(b"".join(raw), np.uint64), return_inverse=True)[1]
            starts = np.cumsum(sizes) - sizes
            marks = np.zeros(int(flat.max()) + 1, np.int32)
            links, within, whole = np.zeros(len(ids), np.int64), Trees(len(ids)), Trees(len(ids))
            for i in range(len(ids) - 1):
                mine = flat[starts[i] : starts[i] + sizes[i]]
                marks[mine] = 1
                shared = np.add.reduceat(marks[flat[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1])
                marks[mine] = 0
                union = sizes[i] + sizes[i + 1 :] - shared
                linked = shared >= threshold * union
                whole.join(i, np.flatnonzero(linked) + i + 1)
                if across:
                    same = own[i + 1 :] == own[i]
                    within.join(i, np.flatnonzero(linked & same) + i + 1)
                    linked &= ~same
                found = np.flatnonzero(linked) + i + 1
                links[i] += copies[found].sum()
                links[found] += copies[i]
            joined = np.zeros(len(ids), bool)
            joined[new_links(within, whole, across)] = True
            some = np.flatnonzero((links > 0) | joined)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some], pa.int64()), pa.array(links[some], pa.int64()), pa.array(ids[whole.root[some]], pa.int64(), mask=~joined[some])], names=["id", "links", "other"])

    return run


def _classes(docs: DataFrame, threshold: float = 0.8, n: int = 5, trees: int = 22, recall: float = 0.9999, block: int = 256, node_block: int = 400, slack: float = 0.26) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id (long), key (MD5 of the text), text. Rows (doc_id, key, digest), and classes (digest, set, copy_id, root, class_id, n_links)."""
    signed = cut(docs.mapInArrow(_signatures(n, trees * OWN_LABELS), "doc_id long, key binary, digest binary, signature binary, shingles long"))
    named = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    sets = signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min(named).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("signature").alias("signature"), F.first("shingles").alias("shingles"))
    sets = cut(sets.withColumn("id", F.monotonically_increasing_id()))
    proposed, _ = proposals(sets, threshold, trees, recall, slack, node_block)
    candidates = cut(components(proposed))

    # A group of long texts counts as more rows, so that no block holds more than block * 4096 shingles on average.
    grouped = candidates.join(sets.select("id", "first", "digest", "copies", "shingles"), "id")
    sizes = grouped.groupBy("root").agg(F.greatest(F.count(F.lit(1)), F.ceil(F.sum("shingles") / 4096)).alias("members"))
    wanted = grouped.drop("shingles").join(unbound(sizes, "root"), "root")
    verified = cut(dealt(_with_shingles(docs, wanted, n), ["root"], F.col("members"), "id", block).mapInArrow(_verify(threshold), "id long, links long, other long"))
    links = verified.groupBy("id").agg(F.sum("links").alias("links"))
    roots = cut(components(verified.select(F.col("id").alias("a"), F.col("other").alias("b"))))
    leasts = roots.join(sets.select("id", "first"), "id").groupBy("root").agg(F.min("first.doc_id").alias("class_id"))
    linked = roots.join(leasts, "root")
    return signed.select("doc_id", "key", "digest"), sets.join(links, "id", "left").join(linked, "id", "left").select(
        "digest", F.col("id").alias("set"), F.col("first.doc_id").alias("copy_id"), F.coalesce("root", "id").alias("root"),
        F.when(F.col("root").isNull(), F.col("first.doc_id")).otherwise(F.col("class_id")).alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = texts(docs, id_col, text_col)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5("text")).alias("key"), "text")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """doc_id, class_id, n_links, copy_id for every row.

    n_links: how many other rows have a similarity of ``threshold`` or more; class_id: the least id that is reached
    over such links; copy_id: the least id with the same set of shingles. A text without words (null, empty) has no links and is its
    own class. Repeated rows are copies of each other, rows of one id with different texts are different documents. Ids are
    integers; a null id is never the least, and a class of null ids alone has a null class_id. An empty table gives no rows.
    """
    rows, classes = _classes(keyed(docs, id_col, text_col), **settings)
    known = classes.drop("set", "root").withColumn("known", F.lit(True))
    joined = rows.select("doc_id", "digest").join(unbound(known, "digest"), "digest", "left")
    or_own = lambda c: F.when(F.col("known"), F.col(c)).otherwise(F.col("doc_id")).alias(c)
    return joined.select("doc_id", or_own("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), or_own("copy_id"))


def _with_shingles(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The rows of wanted (id, first, digest, ...) with the shingles of their text."""
    names = [c for c in wanted.columns if c not in ("first", "digest")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            sets = list(shingle_sets(batch.column("text"), n))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([s.tobytes() for s in sets], pa.binary())], names=[*names, "shingles"])

    joined = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["first.doc_id"]) & (docs["key"] == wanted["first.key"])).select(*names, "text")
    return joined.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema if f.name in names) + ", shingles binary")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs, with all their columns, less those whose class keeps another row.

    A class keeps the row with its least id (null ids come last; of one id, the text with the least MD5 digest), and of rows that
    repeat both id and text a single one. Rows are told apart by id and text, so two documents that share an id
    are two. Texts without words (null, empty) are in no class and all stay. An empty table gives no rows.
    """
    rows, classes = _classes(keyed(docs, id_col, text_col), **settings)
    rooted = rows.join(unbound(classes.select("digest", "root"), "digest"), "digest")
    each = cut(rooted.groupBy("root", "doc_id", "key").agg(F.count(F.lit(1)).alias("n")))
    named = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    leaders = each.groupBy("root").agg(F.min(named).alias("leader"), F.sum("n").alias("rows")).where("rows > 1").select("root", "leader")
    marked = cut(each.join(unbound(leaders, "root"), "root").select("doc_id", "key", (named == F.col("leader")).alias("leads"), "n"))
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("key"))

    def matching(rows: DataFrame, which: DataFrame, how: str) -> DataFrame:
        which = which.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"))
        return rows.join(which, rows["id"].eqNullSafe(which["__id"]) & (rows["key"] == which["__key"]), how)

    again = marked.where("leads AND n > 1")
    if again.head(1):
        dropped = marked.where("NOT leads OR n > 1")
        kept = matching(whole, dropped, "left_anti").unionByName(matching(whole, again, "left_semi").dropDuplicates(["id", "key"]))
    else:
        kept = matching(whole, marked.where("NOT leads"), "left_anti")
    return kept.select("row.*")
